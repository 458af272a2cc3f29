"""Columns of the caller with any names; near copies that an earlier step has cut."""

import random

import pytest

from lexweave.llm import common, decontam, linededup, quality, similar, simhash

NAMES = ["_id", "_hash", "_id2", "_hash2", "_doc", "_key", "_found", "_score", "row", "doc", "text_hash", "numbers", "node", "Score"]


@pytest.fixture(scope="module")
def named(spark):
    rnd = random.Random(1)
    rows = [(i, " ".join(rnd.choices("a b c d e f g h i j k l m n o p".split(), k=30)) + "\nlast line") for i in range(20)]
    rows += [(30, rows[3][1]), (31, rows[4][1])]
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", *(f"concat('{n}', doc_id) AS `{n}`" for n in NAMES))


def own(rows):
    return all(r[n] == f"{n}{r.doc_id}" for r in rows for n in NAMES)


@pytest.mark.parametrize("keep", [simhash.keep_first, similar.keep_first, lambda df: similar.keep_first(df, earlier=df)])
def test_rows_kept_have_their_own_columns(named, keep):
    rows = keep(named)
    assert rows.columns == named.columns
    rows = rows.collect()
    assert own(rows) and sorted(r.doc_id for r in rows) == list(range(20))


def test_other_operators_keep_columns(spark, named):
    rows = linededup.dedup_lines(named)
    assert rows.columns == [*named.columns, "_removed"] and own(rows.collect())
    with pytest.raises(ValueError):
        linededup.dedup_lines(named.withColumnRenamed("_id", "_Removed"))
    clean = decontam.clean(named, spark.createDataFrame([(1, "not there at all")], "item_id long, text string"))
    assert clean.columns == named.columns and own(clean.collect())
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    good = quality.keep(named.drop("Score"), labels)
    assert good.columns == [n for n in named.columns if n != "Score"]


@pytest.mark.parametrize("rows", [0, 1000])
def test_links_by_earlier_texts(spark, monkeypatch, rows):
    """Near copies of which line dedup left a rest are linked by what they were, with and without broadcasts."""
    monkeypatch.setattr(similar, "BROADCAST_ROWS", rows)
    monkeypatch.setattr(common, "BROADCAST_ROWS", rows)
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(2000)]
    line = lambda: " ".join(rnd.choices(words, k=12))
    before, after = [], []
    for k in range(30):
        lines = [line() for _ in range(30)]
        changed = list(lines)
        changed[k % 10] = line()
        before += [(k, "\n".join(lines)), (100 + k, "\n".join(changed))]
        after += [(k, "\n".join(lines)), (100 + k, changed[k % 10])]
    alone = [(500, line()), (501, None), (502, ""), (None, line())]
    df = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = lambda earlier: {r.doc_id for r in similar.keep_first(df(after + alone), earlier=earlier).collect()}
    assert kept(None) == {*range(30), *range(100, 130), 500, 501, None}
    assert kept(df([*before, (500, "another"), (900, before[0][1]), (None, before[2][1])])) == {*range(30), 500, 501, None}
    assert kept(df(before).where("doc_id < 0")) == kept(None)
    twice = df([(1, line()), (1, line()), (2, line())])
    assert similar.keep_first(twice, earlier=twice).count() == similar.keep_first(twice).count() == 3
