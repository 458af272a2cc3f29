"""The building blocks for hot keys, checked against brute force on skewed data."""

import functools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lexweave.operators import contours as ct, lists as li, series as sr
from lexweave.plans import scale


@pytest.fixture(scope="module")
def skewed(spark):
    """Half of the rows belong to one key."""
    rng = np.random.default_rng(3)
    n = 6000
    pdf = pd.DataFrame(
        {
            "k": np.where(rng.random(n) < 0.5, 0, rng.integers(1, 300, n)),
            "t": rng.permutation(n).astype("float64"),
            "x": np.round(rng.normal(size=n), 1),
        }
    )
    return spark.createDataFrame(pdf), pdf


def test_exact_quantile(skewed):
    df, pdf = skewed
    for p in (0.0, 0.1, 0.5, 0.95, 1.0):
        got = {r["k"]: (r["q"], r["n"]) for r in scale.exact_quantile(df, ["k"], "x", "q", p).collect()}
        for k, g in pdf.groupby("k"):
            assert abs(got[k][0] - np.quantile(g["x"], p)) < 1e-9 and got[k][1] == len(g)


def test_exact_quantile_of_a_large_group(spark):
    """Beyond SMALL_GROUP only the values near the rank are kept; one value makes up a third of the rows."""
    n = 3 * scale.SMALL_GROUP
    rng = np.random.default_rng(9)
    x = np.where(np.arange(n) % 3 == 0, 1.25, rng.normal(size=n))
    df = spark.createDataFrame(pd.DataFrame({"k": 1, "x": x}))
    for p in (0.0, 0.25, 0.5, 0.9, 1.0):
        got = scale.exact_quantile(df, ["k"], "x", "q", p).first()["q"]
        assert abs(got - np.quantile(x, p)) < 1e-12


def test_exact_quantile_ignores_nulls_and_takes_constants(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 2.0), (1, None), (2, 5.0), (3, 1.0), (3, 2.0)], "k int, x double")
    got = {r["k"]: r["m"] for r in scale.exact_quantile(df, ["k"], "x", "m").collect()}
    assert got == {1: 2.0, 2: 5.0, 3: 1.5}


def test_scan(skewed):
    df, pdf = skewed
    binned = df.withColumn("b", F.floor(F.col("t") / 250))
    out = scale.scan(binned, ["k"], "b", ["t"], lag={"p": "x"}, lead={"n": "x"}, running={"s": F.col("x")})
    w = Window.partitionBy("k").orderBy("t")
    plain = binned.select(
        "*", F.lag("x").over(w).alias("p"), F.lead("x").over(w).alias("n"),
        F.sum("x").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s"),
    )
    a = out.orderBy("t").toPandas()[["k", "t", "p", "n", "s"]]
    b = plain.orderBy("t").toPandas()[["k", "t", "p", "n", "s"]]
    pd.testing.assert_frame_equal(a, b)


def test_scan_carries_a_null(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (1, 5, None), (1, 20, 3.0)], "k int, t int, x double")
    out = scale.scan(df.withColumn("b", F.floor(F.col("t") / 10)), ["k"], "b", ["t"], lag={"p": "x"})
    assert [r["p"] for r in out.orderBy("t").collect()] == [None, 1.0, None]


def test_salted_join(skewed):
    df, _ = skewed
    facts = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    assert scale.salted_join(df, facts, ["k"]).count() == df.count()
    some = facts.where("k < 10")
    assert scale.salted_join(df, some, ["k"], "left").where("n is null").count() == df.where("k >= 10").count()
    assert scale.salted_join(df, some.select("k"), ["k"], "left_semi").count() == df.where("k < 10").count()


def test_numbered_dense_and_sparse(skewed):
    df, pdf = skewed
    order = df.withColumn("major", (F.col("k") % 3).cast("int")).withColumn("minor", F.col("t").cast("long"))
    sparse = scale.numbered(order.withColumn("minor", F.col("minor") * 1_000_003), "major", "minor")
    assert sorted(r["id"] for r in sparse.select("id").collect()) == list(range(1, len(pdf) + 1))
    assert "SinglePartition" not in sparse._jdf.queryExecution().toString()
    assert scale.numbered(order.where("k < -1"), "major", "minor").count() == 0
    out = scale.numbered(order, "major", "minor")
    rows = out.select("id", "major", "minor").orderBy("id").collect()
    assert [r["id"] for r in rows] == list(range(1, len(pdf) + 1))
    assert [(r["major"], r["minor"]) for r in rows] == sorted((r["major"], r["minor"]) for r in rows)


def test_peaks_across_chunks(spark):
    rng = np.random.default_rng(1)
    db = rng.normal(size=500)
    df = spark.createDataFrame(pd.DataFrame({"clip_id": 1, "idx": np.arange(500), "db": db}))
    got = {r["idx"]: r["prominence"] for r in sr.peaks(df, reach=40, chunk=64).collect()}
    want = {
        i: db[i] - max(db[max(0, i - 40) : i + 1].min(), db[i : i + 41].min())
        for i in range(1, 499)
        if db[i] >= db[i - 1] and db[i] > db[i + 1]
    }
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-12 for i in want)


def test_segments(spark):
    rows = [("c", 18, 0.0, 1.0, 2), ("c", 18, 1.1, 2.0, 2), ("c", 18, 3.0, 4.0, 2), ("c", 18, 5.0, 5.1, 2), ("c", 20, 0.0, 1.0, 2)]
    segs = spark.createDataFrame(rows, "clip_id string, threshold int, start double, end double, expected int")
    r = sr.merge_segments(segs, bin_width=1.0).first()
    assert (r["threshold"], r["n"], r["fits"]) == (18, 2, True)


def test_measure_vowels(spark):
    frames = spark.createDataFrame([(1, i / 100, float(i)) for i in range(300)], "clip_id int, t double, st double")
    letters = spark.createDataFrame([(1, 0, 0.5, 1.5), (1, 1, 2.0, 2.04), (1, 2, 9.0, 9.5)], "clip_id int, i int, start double, end double")
    out = {r["i"]: r for r in sr.measure_vowels(frames, letters).collect()}
    assert out[0]["frames"] == 100 and out[0]["pitch"] == 99.5 and out[0]["pitch_1"] == 74.5 and out[0]["pitch_2"] == 124.5
    assert out[1]["frames"] == 4 and out[2]["frames"] == 0 and out[2]["pitch"] is None


def cheapest_path(a, b):
    """Mean cost of the best way to walk both series to their ends, a step moving on in one or in both."""

    @functools.cache
    def rest(i, j):
        steps = [rest(x, y) for x, y in ((i + 1, j), (i, j + 1), (i + 1, j + 1)) if x < len(a) and y < len(b)]
        return abs(a[i] - b[j]) + min(steps, default=0.0)

    return rest(0, 0) / (len(a) + len(b))


@pytest.mark.parametrize("distance", ["l1", "dtw"])
def test_closest_against_brute_force(spark, monkeypatch, distance):
    monkeypatch.setattr(ct, "CHUNK", 7)
    rng = np.random.default_rng(5)
    t = [(i, i % 4, rng.normal(size=8).tolist(), 3) for i in range(20)]
    r = [(100 + i, 0 if i < 12 else i % 6, 0 if i < 12 else i % 6, rng.normal(size=8).tolist(), 2 + i % 3) for i in range(30)]
    targets = spark.createDataFrame(t, "id bigint, word bigint, contour array<double>, vowels bigint")
    refs = spark.createDataFrame(r, "recording bigint, id bigint, ord bigint, contour array<double>, vowels bigint")
    got = {}
    for row in ct.closest(targets, refs, k=3, distance=distance).collect():
        got.setdefault(row["target"], {})[row["rank"]] = (row["ref"], row["dist"])
    for tid, word, c, v in t:
        best = {}
        for _, rid, _, rc, rv in r:
            if rid == word:
                continue
            d = sum(abs(a - b) for a, b in zip(c, rc)) if distance == "l1" else cheapest_path(c, rc)
            best[rid] = min(best.get(rid, np.inf), round(d + 0.5 * abs(v - rv), 2))
        want = sorted(best.items(), key=lambda x: (x[1], x[0]))[:3]
        assert [got[tid][k][0] for k in (1, 2, 3)] == [w for w, _ in want]
        assert np.allclose([got[tid][k][1] for k in (1, 2, 3)], [d for _, d in want])


def test_knn_tie_goes_to_the_nearest(spark):
    ex = spark.createDataFrame([(1, 10, [0.0], "H"), (2, 11, [1.0], "L"), (3, 12, [2.0], "LL")], "id bigint, word bigint, features array<double>, pattern string")
    f = spark.createDataFrame([(7, 99, [0.6], None), (8, 99, [0.6], 2), (9, 11, [1.0], 1)], "id bigint, word bigint, features array<double>, moras int")
    got = {r["id"]: r["pattern"] for r in ct.knn_vote(f, ex, k=3, weights=(1.0,)).collect()}
    assert got == {7: "L", 8: "LL", 9: "H"}


def test_no_plan_collects_a_context(spark, skewed):
    """Medians by context must not run through a plain percentile over the whole context."""
    df, _ = skewed
    v = df.select(F.col("k").alias("clip_id"), F.lit("contrastive").alias("context"), (F.col("x") + 10).alias("dur"))
    plan = sr.length_by_context(v)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert " percentile(" not in plan


def test_cap_is_cut_before_the_shuffle(spark, skewed):
    df, _ = skewed
    capped = sr.cap_per_group(df, ["k"], 2, ["t"])
    plan = capped._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert capped.groupBy("k").count().agg(F.max("count")).first()[0] == 2


def test_a_recording_that_does_not_fit_lends_no_distance(spark):
    t = spark.createDataFrame([(1, 9, [0.0], 1, "12")], "id bigint, word bigint, contour array<double>, vowels bigint, signature string")
    r = [(10, 1, 1, [0.1], 1, "1"), (11, 1, 1, [5.0], 1, "2"), (12, 2, 2, [0.2], 1, "1")]
    refs = spark.createDataFrame(r, "recording bigint, id bigint, ord bigint, contour array<double>, vowels bigint, signature string")
    assert [tuple(x) for x in ct.closest(t, refs, k=3, distance="l1", by_signature=True).collect()] == [(1, 1, 1, 5.0)]


def test_annotations_follow_the_numbers_of_old_ids(spark):
    new = spark.createDataFrame([(4, "a", "m", "s")], "id bigint, plain string, meaning string, source string")
    ids = ["9", "10", "1-10", "1-2", "1-3"]
    old = spark.createDataFrame([(i, "a", "m", "y" + i, "", "", "") for i in ids], "id string, plain string, meaning string, your_marking string, heard string, recording string, notes string")
    got = {x.id: x.your_marking for x in li.merge_annotations(new, old).collect()}
    assert got == {"4": "y10", "4-2": "y1-2", "4-3": "y1-3", "4-4": "y1-10"}
