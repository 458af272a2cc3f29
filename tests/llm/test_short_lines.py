"""Short lines that very many documents have."""

import random
from collections import defaultdict

import pytest

from lexweave.llm import linededup


def removed(docs, least, often):
    """Lines that lie in a common run of ``least`` words with an earlier document, or that ``often`` documents have."""
    lines = {i: [" ".join(x.split()) for x in t.split("\n")] for i, t in docs.items()}
    having = defaultdict(set)
    for i, rows in lines.items():
        for x in rows:
            having[x].add(i)
    out = {}
    for d in lines:
        out[d] = {k for k, x in enumerate(lines[d]) if x and len(x.split()) < least and len(having[x]) >= often and min(having[x]) < d}
        for e in (e for e in lines if e < d):
            for i in range(len(lines[d])):
                for j in range(len(lines[e])):
                    n = 0
                    while i + n < len(lines[d]) and j + n < len(lines[e]) and lines[d][i + n] == lines[e][j + n] != "":
                        n += 1
                    if sum(len(x.split()) for x in lines[d][i : i + n]) >= least:
                        out[d] |= set(range(i, i + n))
    return out


@pytest.mark.parametrize("least, often", [(10, 25), (4, 6), (7, 12)])
def test_frequent_short_lines_against_brute_force(make_docs, least, often):
    rnd = random.Random(least)
    short = [" ".join(f"s{k}w{i}" for i in range(rnd.randint(1, 9))) for k in range(12)]
    docs = {}
    for d in range(60):
        own = [f"own line {d} {k} of this one document" for k in range(rnd.randint(0, 4))]
        for k, line in enumerate(short):
            if rnd.random() < k / 12:
                own.insert(rnd.randrange(len(own) + 1), f"  {line} ")
        docs[d] = "\n".join(own)
    want = removed(docs, least, often)
    assert sum(map(len, want.values())) > 100
    found = {r.doc_id: r for r in linededup.dedup_lines(make_docs(list(docs.items())), least, often=often).collect()}
    assert {d: set(r._removed or []) for d, r in found.items()} == want


def test_default_deletes_a_short_line_of_many_documents(make_docs):
    docs = [(d, f"text {d} of its own\nAll rights reserved.") for d in range(40)] + [(None, "All rights reserved.")]
    found = {r.doc_id: r for r in linededup.dedup_lines(make_docs(docs)).collect()}
    assert [d for d in range(40) if not found[d]._removed] == [0] and found[None].text == "All rights reserved."
