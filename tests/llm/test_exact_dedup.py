"""Exact dedup against a dictionary of normalised texts."""

import hashlib
import random
import re

import pytest

from lexweave.llm import exactdedup
from tests_odd import ODD


def slow(docs):
    groups = {}
    for i, t in docs:
        groups.setdefault(re.sub("[\x20\x09-\x0d]+", "", t or ""), []).append((-len(t or ""), i is None, i or 0, i))
    out = []
    for norm, rows in groups.items():
        keep = min(rows)[3]
        for n, row in enumerate(sorted(rows)):
            out.append((row[3], keep, len(rows), n == 0, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


def texts():
    rnd = random.Random(5)
    white = [" ", "  ", "\t", "\n", "\x0b", "\x0c", "\r", " ", " "]
    docs = []
    for k in range(400):
        words = ["a", "b", "the start that all have in common", "ß", "中文"][: rnd.randint(1, 5)] if rnd.random() < 0.7 else ["hot", "copy"]
        docs.append((k, rnd.choice(white).join(words) + rnd.choice(["", " ", "\n\n"])))
    return docs


@pytest.mark.parametrize("piece", [2, 64])
def test_groups_against_brute_force(make_docs, monkeypatch, piece):
    monkeypatch.setattr(exactdedup, "PIECE", piece)
    docs = texts() + texts()[7:8] + [*ODD, (None, "a"), (None, "hot copy")]
    df = make_docs(docs)
    got = exactdedup.classes(df)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == slow(docs)
    assert exactdedup.classes(df.where("doc_id = -1")).count() == 0


@pytest.mark.parametrize("piece", [2, 64])
def test_rows_that_stay_keep_all_their_columns(spark, make_docs, monkeypatch, piece):
    monkeypatch.setattr(exactdedup, "PIECE", piece)
    docs = texts()
    names = ["key", "Size", "run", "n", "best", "whole", "row", "norm", "kept", "hot"]
    df = make_docs(docs).selectExpr("doc_id", "text", *(f"doc_id * 2 AS `{n}`" for n in names))
    rows = exactdedup.keep_one(df)
    assert rows.columns == ["doc_id", "text", *names]
    assert {r.doc_id for r in rows.collect()} == {keep for _, keep, *_ in slow(docs)}
    assert all(r.text == dict(docs)[r.doc_id] and r.whole == 2 * r.doc_id for r in rows.collect())


def test_a_group_of_copies_is_cut_into_pieces(make_docs):
    docs = [(k, "one text that a third of all rows have") for k in range(1000)] + [(2000 + k, f"text {k}") for k in range(2000)]
    runs = exactdedup._runs(make_docs(docs), "doc_id", "text")
    sizes = [r["count"] for r in runs.where("divided").groupBy("prefix", "key", "piece").count().collect()]
    assert len(sizes) > 10 and max(sizes) < 150
    assert runs.where("divided AND place > 1 AND whole IS NOT NULL").count() == 0
