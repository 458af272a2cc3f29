"""The warped distances of the query, at the reference's 40 points."""

import functools

import numpy as np

from lexweave.operators import contours
from lexweave.queries import registry


def warped(a, b):
    @functools.cache
    def rest(i, j):
        steps = [rest(x, y) for x, y in ((i + 1, j), (i, j + 1), (i + 1, j + 1)) if x < len(a) and y < len(b)]
        return abs(a[i] - b[j]) + min(steps, default=0.0)

    return rest(0, 0) / (len(a) + len(b))


def test_dtw_refs_at_40_points(spark, tmp_path):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(14, 64)).astype(np.float32)
    rows = [(i, v.tolist(), i % 7) for i, v in enumerate(vectors)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    points = [np.interp(np.linspace(0, 63, 40), np.arange(64), v.astype(float)) for v in vectors]
    got = {(r["target"], r["rank"]): (r["ref"], r["dist"]) for r in registry.QUERIES["dtw_refs"](spark, str(tmp_path)).collect()}
    for t in range(14):
        best = {}
        for r in range(14):
            if r % 7 != t % 7:
                d = round(warped(points[t], points[r]) + 0.5 * abs(t % 5 + 2 - (r % 7 % 4 + 2)), 2)
                best[r % 7] = min(best.get(r % 7, np.inf), d)
        want = sorted(best.items(), key=lambda x: (x[1], x[0]))[:3]
        assert np.allclose([got[t, k][1] for k in (1, 2, 3)], [d for _, d in want])
        assert [got[t, k][0] for k in (1, 2, 3)] == [w for w, _ in want]


def test_dtw_by_diagonals_and_its_bounds():
    rng = np.random.default_rng(5)
    for n, m in ((40, 40), (7, 12), (12, 7), (1, 4), (4, 1), (1, 1)):
        x, y = rng.normal(size=(5, n)), rng.normal(size=(9, m))
        x[0], y[0], y[1] = 50.0, -50.0, 50.0
        want = np.array([[warped(tuple(a), tuple(b)) for b in y] for a in x])
        assert np.allclose(contours.dtw(x, y), want)
        for i, low, high in contours.dtw_bounds(x, y):
            assert (low <= want[i : i + len(low)]).all() and (want[i : i + len(low)] <= high).all()
            assert (high - low <= 0.1 * (x.max() - x.min())).all()


def test_dtw_is_counted_for_few_pairs(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(6)
    counted, pairs = [], contours.dtw_pairs
    monkeypatch.setitem(contours.PRUNED, "dtw", (contours.dtw_bounds, lambda x, y, t, r: counted.append(len(t)) or pairs(x, y, t, r)))
    x = rng.normal(size=(300, 40)).cumsum(axis=1)
    rows = [(i, i, x[i].tolist(), 3) for i in range(300)]
    targets = spark.createDataFrame(rows, "id long, word long, contour array<double>, vowels int")
    refs = spark.createDataFrame([(i, i, i, v.tolist(), 3) for i, v in enumerate(x)], "recording long, id long, ord long, contour array<double>, vowels int")
    monkeypatch.setattr(contours, "block_join", in_one_block)
    got = {(r["target"], r["rank"]): (r["ref"], r["dist"]) for r in contours.closest(targets, refs, distance="dtw").collect()}
    exact = np.round(contours.dtw(x, x), 2)
    np.fill_diagonal(exact, np.inf)
    for t in range(300):
        assert [got[t, k] for k in (1, 2, 3)] == [(int(r), exact[t, r]) for r in np.argsort(exact[t], kind="stable")[:3]]
    assert 900 <= sum(counted) < 0.2 * 300 * 300


def in_one_block(targets, refs, fn, schema, *_):
    spark = targets.sparkSession
    return spark.createDataFrame(fn(targets.toPandas(), refs.toPandas()), schema)
