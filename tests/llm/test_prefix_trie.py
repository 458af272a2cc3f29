"""The trie of conversation prefixes against a plain walk over all prefixes."""

import hashlib
import random
import zlib

import pytest

from lexweave.llm import prefixtrie

SCHEMA = "conv_id long, turn long, role string, text string, conv long, depth string, len int, k1 string"


def turns_of(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, x) for *_, r, x in sorted(t, key=lambda t: t[:2])] for c, t in own.items()}


def slow_rebuilt(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def slow_trie(built):
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for key, inside in members.items():
        below = [k for k in members if k[: len(key)] == key]
        children = [k for k in below if len(k) == len(key) + 1]
        leaves = [k for k in below if not any(len(x) == len(k) + 1 and x[: len(k)] == k for x in members)]
        saved = sum((len(members[k]) - 1) * len(k[-1][1].encode()) for k in below if k)
        ends = ",".join(str(c) for c in sorted(inside) if len(built[c]) == len(key))
        out.append((min(inside), len(key), min(members[key[:-1]]) if key else None, len(inside), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, "y") for r in rows], SCHEMA).repartition(5)


def found(df):
    return sorted((tuple(r)[:8] for r in df.collect()), key=str)


def table(seed, convs):
    rnd = random.Random(seed)
    rows = []
    for c in convs:
        for turn in range(rnd.choice([1, 1, 2, 3, 5, 9, 12])):
            rows.append((c, turn, rnd.choice(["user", "assistant", None]), rnd.choice([None, "", "a", "ß", "a long one", f"own {c % 7}"])))
    return rows


@pytest.mark.parametrize(("seed", "stretch", "chunk"), [(1, 4096, 4096), (2, 2, 2)])
def test_rebuilt_tries_against_brute_force(spark, monkeypatch, seed, stretch, chunk):
    monkeypatch.setattr(prefixtrie, "STRETCH", stretch)
    monkeypatch.setattr(prefixtrie, "CHUNK", chunk)
    rows = table(seed, [*range(-12, 60), 100_003, 2**40 + 1]) + [(7, None, "user", "first"), (None, 0, "user", "nobody's"), (61, None, None, None)]
    assert found(prefixtrie.trie(frame(spark, rows))) == slow_trie(slow_rebuilt(turns_of(rows)))


def test_plain_trie_of_copies_long_and_repeated(spark, monkeypatch):
    """A third of all conversations alike, one of very many turns, prefixes of each other, repeated rows."""
    monkeypatch.setattr(prefixtrie, "STRETCH", 16)
    monkeypatch.setattr(prefixtrie, "CHUNK", 8)
    rows = [(c, t, "user", f"same {t}") for c in range(40) for t in range(3)]
    rows += [(100 + c, t, "user", f"same {t}") for c in range(6) for t in range(c)]
    rows += [(200, t, "user", f"turn {t % 4}") for t in range(90)] + [(201, t, "user", f"turn {t % 4}") for t in range(70)]
    rows += [(300, 0, "user", "twice")] * 2 + [(301, 0, "user", "twice"), (301, 1, "user", "twice")]
    got = found(prefixtrie.trie(frame(spark, rows), rebuild=False))
    assert got == slow_trie(turns_of(rows))
    assert prefixtrie.trie(frame(spark, rows).where("conv_id > 1000")).count() == 0
