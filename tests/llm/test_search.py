"""Ranked search against plain scoring of every document for every item."""

import math
import random
import re

import numpy as np
import pytest

from lexweave.llm import lexical
from tests_odd import ODD

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return re.sub("[A-Z]+", lambda m: m.group().lower(), " ".join(TERM.findall(text or ""))).split(" ") if TERM.search(text or "") else []


def slow(docs, items, best=10):
    found = [(i, terms(t)) for i, t in docs]
    n_docs, n_terms = sum(bool(w) for _, w in found), sum(len(w) for _, w in found)
    having = {}
    for _, w in found:
        for x in set(w):
            having[x] = having.get(x, 0) + 1
    out = []
    for item, text in items:
        ranked = []
        for doc, w in found:
            m = 25 + (75 * len(w) * n_docs) // n_terms
            score = 0
            for x in terms(text):
                if tf := w.count(x):
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * having[x] + 1))) * ((10**9 * tf) // (1000 * tf + 8 * m))
            if score > 0:
                ranked.append((-score, doc is None, doc or 0, doc))
        out += [(item, n + 1, r[3], -r[0]) for n, r in enumerate(sorted(ranked)[:best])]
    return sorted(out, key=str)


def tables():
    rnd = random.Random(3)
    vocabulary = ["the", "of", "THE", "ß", "Été", "x1", "中", "Zed"] + [f"w{k}" for k in range(60)]
    say = lambda n: rnd.choice([" ", "-", "\n", "_"]).join(rnd.choices(vocabulary, k=n))
    items = [(k, say(rnd.choice([1, 2, 5, 12]))) for k in range(25)] + [(30, None), (31, ""), (32, "absent"), (33, "the the the"), (33, "w1"), (None, "w2 w3")]
    docs = [(k, say(rnd.randint(0, 40))) for k in range(120)] + [(500 + k, "w5 w5 the") for k in range(15)] + [(600, "w5 the"), (600, "w5 the"), (None, "w5 w5 the")]
    return docs + ODD, items


@pytest.mark.parametrize(("cells", "most"), [(lexical.CELLS, 50_000), (40, 7)])
def test_ranking_against_brute_force(spark, make_docs, monkeypatch, cells, most):
    """Also with few documents at a time and an index in several parts."""
    monkeypatch.setattr(lexical, "CELLS", cells)
    monkeypatch.setattr(lexical, "INDEX_ITEMS", most)
    docs, items = tables()
    benchmark = spark.createDataFrame([(*r, 1, "x") for r in items], "item_id long, text string, doc_id long, n string")
    got = lexical.search(make_docs(docs), benchmark)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == slow(docs, items)
    assert lexical.search(make_docs(docs).where("doc_id = -1"), benchmark).count() == 0
    assert lexical.search(make_docs(docs), benchmark.where("item_id = -1")).count() == 0


def test_whole_numbers_with_and_without_doubles():
    """Sums that doubles can't hold are added as integers, with equal results."""
    docs, items = tables()
    index = lexical.Index(items)
    sizes, text, term, times = index.counts([t for _, t in docs])
    fast = lexical.Scorer(index, 100, 5000, dict.fromkeys(range(len(index.terms)), 3))
    index.longest = 1 << 50
    whole = lexical.Scorer(index, 100, 5000, dict.fromkeys(range(len(index.terms)), 3))
    assert (fast.kind, whole.kind) == (np.float64, np.int64)
    assert (fast.scores(sizes, text, term, times) == whole.scores(sizes, text, term, times)).all()


def test_heaps_keep_ties_by_id():
    rnd = np.random.default_rng(0)
    scores, docs = rnd.integers(0, 5, size=(300, 4)), rnd.permutation(300)
    heaps = lexical.Heaps(4, 10)
    for at in range(0, 300, 37):
        heaps.push(docs[at : at + 37], scores[at : at + 37])
    for item in range(4):
        want = sorted((-s, d) for s, d in zip(scores[:, item], docs) if s)[:10]
        got = sorted((-s, d) for k, s, d in zip(heaps.item, heaps.score, heaps.doc) if k == item)
        assert got == want
