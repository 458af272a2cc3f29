"""Near copies of the pipeline stage against brute-force Jaccard similarity."""

import random

import numpy as np

import corpus_pipeline
from lexweave.llm import similar, simhash


def grams(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def copies():
    """Texts of 200 words in groups whose members differ from the first in one to five words."""
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    docs = []
    for _ in range(40):
        base = rnd.choices(words, k=200)
        docs.append((len(docs), " ".join(base)))
        for _ in range(3):
            copy = list(base)
            for at in rnd.sample(range(0, 200, 8), rnd.randint(1, 6)):
                copy[at] = rnd.choice(words)
            docs.append((len(docs), " ".join(copy)))
    return [*docs, (900, None), (901, ""), (902, "one"), (903, "ONE"), (904, docs[0][1].upper()), (None, docs[9][1])]


def test_near_copies_against_brute_force(spark, make_docs, monkeypatch):
    docs = copies()
    named = [(i, grams(t)) for i, t in docs if i is not None]
    root = {i: i for i, _ in named}
    many_bits = 0
    for n, (i, a) in enumerate(named):
        for j, b in named[:n]:
            if (len(a & b) / len(a | b) if a | b else 1) >= 0.8:
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = {k: new if v == old else v for k, v in root.items()}
                x, y = simhash.fingerprints([dict(docs)[i], dict(docs)[j]])
                many_bits += int(x ^ y).bit_count() > 3
    assert many_bits > 20
    got = similar.keep_first(make_docs(docs)).collect()
    assert sorted(r.doc_id for r in got) == sorted(set(root.values()))
    monkeypatch.setattr(similar, "LISTED", 1)  # every bucket by its tree
    assert sorted(r.doc_id for r in similar.keep_first(make_docs(docs)).collect()) == sorted(set(root.values()))


def test_large_buckets_connect_like_listed_ones(monkeypatch):
    rnd = np.random.default_rng(1)
    base = rnd.integers(0, 1 << 63, size=(6, 2), dtype=np.uint64)
    checks = base[rnd.integers(0, 6, size=300)] ^ (np.uint64(1) << rnd.integers(0, 64, size=(300, 2), dtype=np.uint64))
    group = np.repeat([1, 2, 5], 100)
    found = []
    for listed in (0, 1000):
        monkeypatch.setattr(similar, "LISTED", listed)
        a, b = similar.near_pairs(group, checks)
        assert (group[a] == group[b]).all() and (similar._far(checks, a, b) <= similar.NEAR).all()
        found.append((len(a), int(similar._far(checks, a, b).sum())))
    assert found[0] == found[1]


def test_near_copies_through_the_chained_stages(spark, tmp_path):
    """Documents of many lines with near copies: line dedup and then the near-dedup stage leave one of each group."""
    rnd = random.Random(7)
    words = [f"w{i}" for i in range(3000)]
    line = lambda: " ".join(rnd.choices(words, k=rnd.randint(8, 16)))
    rows, groups = [], []
    for k in range(25):
        lines = [line() for _ in range(30)]
        rows.append((3 * k, "\n".join(lines)))
        for n in (1, 2):
            copy = list(lines)
            for at in rnd.sample(range(30), n):
                words_of = copy[at].split()
                words_of[rnd.randrange(len(words_of))] = rnd.choice(words)
                copy[at] = " ".join(words_of)
            rows.append((3 * k + n, "\n".join(copy)))
        groups.append({3 * k, 3 * k + 1, 3 * k + 2})
    rows += [(200 + k, "\n".join(line() for _ in range(10))) for k in range(20)]
    data = [(i, t, "en", "s", len(t)) for i, t in rows]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    cut = corpus_pipeline.written(corpus_pipeline.line_stage(spark, docs, str(tmp_path)), "cut")
    assert sum(r.n_chars for r in cut.collect()) < sum(len(t) for _, t in rows) / 2
    left = {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, cut, str(tmp_path)).collect()}
    caught = sum(len(g - left) for g in groups)
    assert caught >= 0.9 * 50 and all(min(g) in left for g in groups) and {200 + k for k in range(20)} <= left


def test_near_pairs_come_through_the_gray_index(monkeypatch):
    """The stage searches op4's hierarchical index; the pairs connect what all near pairs connect, also over two ranges."""
    rnd = np.random.default_rng(5)
    base = rnd.integers(0, 1 << 63, size=(40, 2), dtype=np.uint64)
    checks = base[rnd.integers(0, 40, size=600)]
    for _ in range(12):
        checks = checks ^ (np.uint64(1) << rnd.integers(0, 64, size=(600, 2), dtype=np.uint64))
    group, side = np.repeat([7, 3, 5], 200), np.tile([0, 1], 300)
    asked = []
    search = simhash.search
    monkeypatch.setattr(simhash, "search", lambda *args: asked.append(args[4]) or search(*args))

    def classes(pairs):
        root = list(range(600))
        for a, b in pairs:
            old, new = root[a], root[b]
            root = [new if x == old else x for x in root]
        return {frozenset(i for i in range(600) if root[i] == r) for r in root}

    far = np.bitwise_count(checks[:, None] ^ checks[None]).sum(axis=2)
    near = (far <= similar.NEAR) & (group[:, None] == group[None])
    for listed in (0, 64):
        monkeypatch.setattr(similar, "LISTED", listed)
        monkeypatch.setattr(similar, "AT_ONCE", 5000)
        a, b = similar.near_pairs(group, checks)
        assert near[a, b].all() and classes(zip(a, b)) == classes(zip(*np.nonzero(near)))
        a, b = similar.near_pairs(group, checks, side)
        across = near & (side[:, None] != side[None])
        assert across[a, b].all() and classes(zip(a, b)) == classes(zip(*np.nonzero(across)))
    assert asked == [similar.NEAR] * 4


def test_large_buckets_are_cut_into_ranges(spark, make_docs, monkeypatch):
    docs = copies()
    expected = sorted(r.doc_id for r in similar.keep_first(make_docs(docs)).collect())
    dealt, cut = simhash.dealt, []
    monkeypatch.setattr(simhash, "RANGE", 2)
    monkeypatch.setattr(simhash, "dealt", lambda *args: cut.append(1) or dealt(*args))
    assert sorted(r.doc_id for r in similar.keep_first(make_docs(docs)).collect()) == expected and cut
