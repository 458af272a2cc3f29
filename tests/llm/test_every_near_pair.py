"""Near-dedup counts every near pair of different classes, also those that no bucket needs to connect its rows."""

import random

import numpy as np

from lexweave.llm import similar


def chains(rnd, number=12, length=25):
    """Texts of 120 words of which each differs from the one before in two or three words."""
    words = [f"w{i}" for i in range(3000)]
    docs = []
    for _ in range(number):
        text = rnd.choices(words, k=120)
        for _ in range(length):
            docs.append((len(docs), " ".join(text)))
            for at in rnd.sample(range(0, 120, 6), rnd.choice((2, 2, 3))):
                text[at] = rnd.choice(words)
    return docs


def test_components_are_those_of_all_near_pairs(spark, make_docs, monkeypatch):
    monkeypatch.setattr(similar, "WHOLE", 0)  # every bucket by the closest pairs that connect it
    docs = chains(random.Random(5))
    sets = [similar.shingle_set(t) for _, t in docs]
    codes = similar.fingerprints(sets)
    runs = np.ascontiguousarray(codes[:, : similar.RUN_WORDS]).view("<u2")
    root = list(range(len(docs)))
    for b in range(len(docs)):
        for a in range(b):
            near = np.bitwise_count(codes[a, similar.RUN_WORDS :] ^ codes[b, similar.RUN_WORDS :]).sum() <= similar.NEAR
            if near and (runs[a] == runs[b]).any() and similar.similarity(sets[a], sets[b]) >= similar.LEAST:
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = [new if x == old else x for x in root]
    kept = sorted(r.doc_id for r in similar.keep_first(make_docs(docs)).collect())
    assert kept == sorted(set(root)) and len(kept) < len(docs) / 2


def test_bitmaps_never_exclude_a_link(monkeypatch):
    monkeypatch.setattr(similar, "BITS_AT_ONCE", 7)
    rnd = np.random.default_rng(2)
    sets = [np.zeros(0, "<u8")]
    for n in (3, 90, 120, 130, 700, 900, 6000, 9000):
        base = rnd.integers(0, 1 << 63, n).astype("<u8")
        sets += [np.unique(np.append(base[rnd.random(n) < part], rnd.integers(0, 1 << 63, n // 9).astype("<u8"))) for part in (1, 0.95, 0.8, 0.5)]
    a, b = np.triu_indices(len(sets), 1)
    size = np.array([len(s) for s in sets], dtype=np.int32)
    most = similar.most_common(size, [np.frombuffer(similar.bitmap(s.view(np.int64)), "<u8") for s in sets], a, b)
    common = np.array([len(np.intersect1d(sets[x], sets[y])) for x, y in zip(a, b)])
    assert (most >= common).all() and (most < np.minimum(size[a], size[b])).sum() > len(a) / 2
