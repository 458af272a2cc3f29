"""SimHash, embeddings, components, line dedup, decontamination against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from lexweave.llm import components, decontam, embed, linededup, simhash
from tests_odd import ODD


def smallest_reachable(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_chains_stars_and_cliques(spark):
    rnd = random.Random(5)
    links = [(i, i + 1) for i in range(100, 160)] + [(200, i) for i in range(201, 300)] + [(rnd.randint(0, 90), rnd.randint(0, 90)) for _ in range(60)] + [(5, 5), (None, 3)]
    found = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    assert found == smallest_reachable({x for link in real for x in link}, real)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def fingerprint(text):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("size", [8, 4096])
def test_simhash_against_brute_force(spark, make_docs, monkeypatch, size):
    """With small ranges, buckets are cut by Gray rank."""
    rnd = random.Random(size)
    words = [f"w{i}" for i in range(400)]
    docs = list(ODD)
    for k in range(6):
        base = rnd.choices(words, k=300)
        for _ in range(25):
            copy = list(base)
            for _ in range(rnd.randint(0, 3)):
                copy[rnd.randrange(300)] = rnd.choice(words)
            docs.append((100 + len(docs), " ".join(copy)))
    monkeypatch.setattr(simhash, "RANGE", size)
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicates(make_docs(docs)).collect()}
    fps = [(i, fingerprint(t)) for i, t in docs]
    values = sorted({f for _, f in fps})
    root = smallest_reachable(values, [(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 3])
    first = {}
    for i, f in fps:
        if i is not None:
            first[root[f]] = min(i, first.get(root[f], i))
    assert got == {(i, f"{f:016x}"): first.get(root[f]) for i, f in fps}
    assert len(set(root.values())) < len(values)
    kept = simhash.keep_first(make_docs(docs)).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in kept) == sorted((first.get(c) is not None, first.get(c, 0)) for c in {root[f] for _, f in fps})


def test_lower_index_finds_all_and_prunes():
    rnd = np.random.default_rng(0)
    base = rnd.integers(0, 2**63, 200, dtype=np.uint64)
    codes = [base]
    for k in range(1, 6):
        x = base.copy()
        for _ in range(k):
            x ^= np.uint64(1) << rnd.integers(0, 64, len(x), dtype=np.uint64)
        codes.append(x)
    codes = np.unique(np.concatenate(codes))
    group = np.sort(rnd.integers(0, 4, len(codes)))
    order = np.lexsort((simhash.gray_rank(codes), group))
    codes = codes[order]
    found = [(a, b) for q, n in simhash.search(codes, group, codes, group) for a, b in zip(q.tolist(), n.tolist())]
    near = (np.bitwise_count(codes[:, None] ^ codes[None]) <= 3) & (group[:, None] == group[None])
    assert sorted(found) == list(zip(*(x.tolist() for x in np.nonzero(near))))


def test_empty_tables(make_docs, spark):
    none = make_docs([(1, "x")]).where("doc_id = 2")
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_first(none).count() == 0
    assert linededup.dedup_lines(none).count() == 0
    assert embed.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontam.find(none, items).count() == 0
    found = decontam.find(make_docs([(1, "a b c")]), items.where("item_id = 9")).first().found
    assert (found.n_words, found.spans, found["items"]) == (3, [], [])


@pytest.mark.parametrize("block", [16, 4096])
def test_embeddings_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embed, "BLOCK", block)
    rnd = np.random.default_rng(block)
    base = rnd.normal(size=(40, 24))
    rows = [base]
    for cosine in (0.89, 0.905, 0.93, 0.99):
        noise = rnd.normal(size=base.shape)
        noise -= (noise * base).sum(1, keepdims=True) / (base * base).sum(1, keepdims=True) * base
        noise *= np.linalg.norm(base, axis=1, keepdims=True) / np.linalg.norm(noise, axis=1, keepdims=True)
        rows.append(cosine * base + np.sqrt(1 - cosine**2) * noise)
    rows += [np.repeat(base[:1], 30, axis=0), 1e-30 * base[1:3], base[:1] + 0.05 * rnd.normal(size=(60, 24))]
    vectors = np.concatenate(rows).astype(np.float32)
    data = [(i, v.tolist(), 0) for i, v in enumerate(vectors)]
    odd = [(900, None), (901, []), (902, [0.0] * 24), (903, [1.0, None]), (904, [float("nan")] * 24), (905, [float("inf")] * 24), (906, vectors[0].tolist()[:20])]
    df = spark.createDataFrame([*data, *((i, v, 1) for i, v in odd), (None, vectors[5].tolist(), 2)], "vec_id long, embedding array<float>, node int").repartition(3)
    got = {r.vec_id: r for r in embed.near_duplicates(df).collect()}
    units = vectors.astype(np.float64)
    units /= np.abs(units).max(1, keepdims=True)
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    near = units @ units.T >= 0.9
    np.fill_diagonal(near, False)
    extra = near[5].astype(int) + (np.arange(len(vectors)) == 5)  # the row without an id is a copy of row 5
    root = smallest_reachable(range(len(vectors)), zip(*(x.tolist() for x in np.nonzero(near))))
    links = np.array([got[i].n_links for i in range(len(vectors))])
    assert (links <= near.sum(1) + extra).all()
    assert links.sum() >= 0.97 * (near.sum() + extra.sum())
    assert np.mean([got[i].component_id == root[i] for i in range(len(vectors))]) > 0.97
    for i, _ in odd:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)


def blocks_removed(docs, least=10):
    """Lines of a later document that lie in a run of at least ``least`` words that an earlier one has as well."""
    lines = {i: [" ".join(x.split()) for x in (t or "").split("\n")] for i, t in docs}
    out = {}
    for d in sorted(lines):
        gone = set()
        for e in (e for e in sorted(lines) if e < d):
            for i in range(len(lines[d])):
                for j in range(len(lines[e])):
                    n = 0
                    while i + n < len(lines[d]) and j + n < len(lines[e]) and lines[d][i + n] == lines[e][j + n] and lines[d][i + n]:
                        n += 1
                    if sum(len(x.split()) for x in lines[d][i : i + n]) >= least:
                        gone |= set(range(i, i + n))
        out[d] = gone
    return out


def test_line_dedup_against_brute_force(make_docs):
    rnd = random.Random(8)
    line = lambda k=None: " ".join(rnd.choices("alpha beta gamma delta epsilon zeta eta theta iota kappa mu nu".split(), k=k or rnd.randint(3, 9))) + str(rnd.random())
    common = line(14)
    passage = [line() for _ in range(6)]
    docs = {}
    for d in range(40):
        own = [line() for _ in range(rnd.randint(1, 10))]
        if d % 3 == 0:
            own[rnd.randrange(len(own) + 1) : 0] = passage
        if d % 2 == 0:
            own.insert(rnd.randrange(len(own) + 1), "  " + common.replace(" ", "  "))
        if d % 7 == 0 and d:
            own = docs[d - 7].split("\n") + own
        if d % 11 == 10:
            own = own[::-1]
        docs[d] = "\n".join(own)
    docs[50] = docs[3]
    docs[51] = "short\nline\n\nof words"
    docs[52] = "short\nline\n\nof words"
    rows = linededup.dedup_lines(make_docs([*docs.items(), (53, None), (54, ""), (None, docs[3]), (60, docs[3])])).collect()
    found = {r.doc_id: r for r in rows}
    want = blocks_removed(list(docs.items()))
    missed = 0
    for d, gone in want.items():
        got = set(found[d]._removed or [])
        assert got <= gone
        missed += len(gone - got)
        left = [x for k, x in enumerate(docs[d].split("\n")) if k not in got]
        assert found[d].text == ("\n".join(left) if any(x.strip() for x in left) else "")
    assert missed == 0
    assert found[53].text is None and found[54].text == "" and found[None].text == docs[3] and found[60].text == ""


def test_alignment_keeps_order():
    rnd = random.Random(2)
    for _ in range(300):
        a, b = ([rnd.randint(0, 9) for _ in range(rnd.randint(0, 14))] for _ in range(2))
        pairs = linededup.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(i < k and j < m for (i, j), (k, m) in zip(pairs, pairs[1:]))
        assert len(linededup.align(a, a)) == len(a)


WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def slow_hits(text, items, window):
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    hit, named = set(), set()
    for item, t in items:
        own = WORDS.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        n = min(window, len(own))
        for k in range(len(own) - n + 1) if own and item is not None else ():
            for s in range(len(words) - n + 1):
                if words[s : s + n] == own[k : k + n]:
                    hit |= set(range(s, s + n))
                    named.add(item)
    return len(words), len(hit), len(named), hashlib.sha256(",".join(sorted(map(str, named))).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block_bytes", [60, 1 << 20])
def test_decontamination_against_brute_force(spark, make_docs, monkeypatch, block_bytes):
    """Small lanes, and with few bytes a block several passes over the documents."""
    monkeypatch.setattr(decontam, "LANE", 8)
    rnd = random.Random(4)
    vocabulary = ["the", "of", "a", "ß", "Été", "x1", "y", "中", "Zed", "q"]
    say = lambda n: rnd.choice([" ", "-", "\n"]).join(rnd.choices(vocabulary, k=n))
    items = [(k, say(rnd.choice([0, 1, 2, 3, 5, 6, 9]))) for k in range(12)] + [(20, None), (21, "the the the the the"), (21, "the of"), (None, "a")]
    docs = [(k, say(rnd.randint(0, 60))) for k in range(60)] + [(100, None), (101, "")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.find(make_docs(docs), benchmark, window=5, block_bytes=block_bytes)
    got = {r.doc_id: tuple(r)[1:] for r in decontam.digests(found).collect()}
    assert got == {i: slow_hits(t, items, 5) for i, t in docs}
    clean = decontam.clean(make_docs(docs), benchmark, window=5)
    assert {r.doc_id for r in clean.collect()} == {i for i, t in docs if not slow_hits(t, items, 5)[-1]}
    assert clean.columns == make_docs(docs).columns
