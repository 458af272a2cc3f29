"""Near-dedup of one large group of near copies: pairs that cannot change a component are not counted."""

import random

import pytest

from lexweave.llm import similar

GROUP = 300


@pytest.fixture
def counted(monkeypatch):
    """Sizes of the sets of all pairs whose similarity is counted."""
    links, seen = similar.links, []

    def count(pairs, sets, least):
        size = {r.node: len(r.members) for r in sets.collect()}
        seen.extend((size[r.a], size[r.b]) for r in pairs.collect())
        return links(pairs, sets, least)

    monkeypatch.setattr(similar, "links", count)
    return seen


def test_a_large_group_is_connected_by_a_few_pairs_a_row(spark, make_docs, counted):
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(4000)]
    base = rnd.choices(words, k=200)
    docs = [(0, " ".join(base))]
    for i in range(1, GROUP):
        copy = list(base)
        for at in rnd.sample(range(0, 200, 6), rnd.randint(1, 3)):
            copy[at] = rnd.choice(words)
        docs.append((i, " ".join(copy)))
    docs += [(GROUP + i, " ".join(rnd.choices(words, k=80))) for i in range(50)]
    kept = sorted(r.doc_id for r in similar.keep_first(make_docs(docs)).collect())
    assert kept == [0, *range(GROUP, GROUP + 50)]
    assert len(counted) <= 16 * GROUP  # far more if the buckets of all runs give their pairs


def test_sizes_that_exclude_a_link_are_not_counted(spark, make_docs, counted):
    rnd = random.Random(12)
    words = [f"w{i}" for i in range(4000)]
    docs = []
    for k in range(30):
        base = rnd.choices(words, k=200)
        docs += [(4 * k + n, " ".join(base[: round(200 * part)])) for n, part in enumerate((1, 0.86, 0.72, 0.6))]
    kept = sorted(r.doc_id for r in similar.keep_first(make_docs(docs)).collect())
    assert kept == [4 * k for k in range(30)]  # each is linked to the next longer one
    assert counted and all(min(x) >= 0.8 * max(x) for x in counted)
