"""Embedding near-duplicates by cross-polytope hashing after fast Hadamard rotations.

Every table of the index has a pair of cross-polytope functions: the nearest signed axis after three rounds of random signs
and a Hadamard transform. A vector stands in its own bucket of each table and asks there and in the next nearest buckets.
Vectors that meet are verified by their cosine in double precision; of all buckets in which a pair meets, only the first
counts it, so links can be counted where they are found and no pair is ever a row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from lexweave.llm.common import batch_of, whole_groups, written
from lexweave.llm.components import components, forest

THRESHOLD = 0.9
TABLES, PROBES, ROUNDS, SEED = 6, 4, 3, 17
#: Vectors of one side of a block; a larger bucket becomes several blocks.
BLOCK = 4096
#: Rows of a block that are compared with its other side at once.
COMPARED = 256


def hadamard(x: np.ndarray) -> np.ndarray:
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x


def _axes(x: np.ndarray, signs: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest signed axes after a rotation, and how much further each is than the first."""
    for s in signs:
        x = hadamard(x * s) / np.sqrt(x.shape[1])
    order = np.argsort(-np.abs(x), axis=1, kind="stable")[:, :probes]
    value = np.take_along_axis(x, order, 1)
    return order * 2 + (value < 0), np.abs(value[:, :1]) - np.abs(value)


def buckets(vectors: np.ndarray, tables: int = TABLES, probes: int = PROBES, seed: int = SEED) -> np.ndarray:
    """Buckets of unit vectors, shape (n, tables, probes): the own one first, then the next nearest."""
    n, size = vectors.shape
    wide = 1 << max(1, (size - 1).bit_length())
    x = np.zeros((n, wide))
    x[:, :size] = vectors
    signs = np.random.default_rng([seed, wide]).choice([-1.0, 1.0], (tables, 2, ROUNDS, wide))
    out = np.empty((n, tables, probes), dtype=np.int32)
    for t in range(tables):
        (a, far_a), (b, far_b) = (_axes(x, s, probes) for s in signs[t])
        code = (a[:, :, None] * (2 * wide) + b[:, None, :]).reshape(n, -1)
        far = (far_a[:, :, None] ** 2 + far_b[:, None, :] ** 2).reshape(n, -1)
        best = np.argsort(far, axis=1, kind="stable")[:, :probes]
        found = np.take_along_axis(code, best, 1)
        out[:, t, : found.shape[1]] = found
        out[:, t, found.shape[1] :] = found[:, :1]
    return out


def _matrix(column: pa.ChunkedArray | pa.Array, rows: np.ndarray) -> np.ndarray:
    """Vectors of equal length as doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    taken = column.take(pa.array(rows))
    return taken.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of very large or small components stay finite
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def with_buckets(classes: DataFrame, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """``classes(node, weight, embedding)`` with ``codes``: tables x probes buckets, one after another."""
    names = classes.columns

    def run(batches):
        for batch in batches:
            column = batch.column("embedding")
            sizes = np.array([len(x) for x in column])
            codes = np.zeros((batch.num_rows, tables * probes), dtype=np.int32)
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                codes[rows] = buckets(_units(_matrix(column, rows)), tables, probes).reshape(len(rows), -1)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(codes.ravel()), tables * probes).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*names, "codes"])

    return classes.mapInArrow(run, T.StructType([*classes.schema, T.StructField("codes", T.ArrayType(T.IntegerType()))]))


def _first_meeting(own: np.ndarray, asked: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Table and bucket in which pairs a-b meet first; own is (n, tables), asked (n, tables, probes)."""
    at_b = (own[b][:, :, None] == asked[a]).any(axis=2)
    at_a = (own[a][:, :, None] == asked[b]).any(axis=2)
    table = np.argmax(at_a | at_b, axis=1)
    pick = np.arange(len(a))
    none = np.iinfo(np.int32).max
    code = np.minimum(np.where(at_b[pick, table], own[b, table], none), np.where(at_a[pick, table], own[a, table], none))
    return table, code


def links(hashed: DataFrame, threshold: float, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """Rows (a, b, n): n for links of node a found in one place, weighted by the copies of the others; a and b linked."""
    asks = F.posexplode(F.transform("codes", lambda c: c))
    rows = hashed.select("node", "weight", "embedding", "codes", asks.alias("_i", "code"))
    rows = rows.select(
        "node", "weight", "embedding", "codes", F.size("embedding").alias("size"), (F.col("_i") / probes).cast("int").alias("t"),
        "code", (F.col("_i") % probes == 0).alias("own"),
    )
    key = ["size", "t", "code"]
    met = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("rows"), F.count_if("own").alias("owners"))
    met = met.where("rows > 1 AND owners > 0").select(*key, F.ceil(F.col("rows") / BLOCK).cast("int").alias("parts"))
    rows = rows.join(met, key).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    blocks = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: F.struct(F.least(i, "part").alias("i"), F.greatest(i, "part").alias("j")))
    rows = rows.withColumn("block", F.explode(blocks))
    dealt = rows.select(
        F.xxhash64(*key, "block").alias("bucket"), "t", "code", "node", "weight", "own", (F.col("part") == F.col("block.j")).alias("second"),
        (F.col("block.i") == F.col("block.j")).alias("alone"), "codes", "embedding",
    )
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def run(batches):
        for table in whole_groups(batches, "bucket", 2 * BLOCK):
            key = table.column("bucket").to_numpy()
            edges = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
            out = [block(table.slice(s, e - s)) for s, e in zip(edges[:-1].tolist(), edges[1:].tolist()) if e - s > 1]
            if out := [x for x in out if x]:
                a, b, n = (pa.concat_arrays([x[k] for x in out]) for k in range(3))
                yield batch_of(schema, a, b, n)

    def block(table: pa.Table):
        own = table.column("own").to_numpy(zero_copy_only=False)
        second = table.column("second").to_numpy(zero_copy_only=False)
        alone = table.column("alone")[0].as_py()
        left, right = (np.arange(len(own)),) * 2 if alone else (np.flatnonzero(~second), np.flatnonzero(second))
        if not own.any() or not len(left) or not len(right):
            return None
        here = table.column("t")[0].as_py(), table.column("code")[0].as_py()
        node, weight = table.column("node").to_numpy(), table.column("weight").to_numpy()
        units = _units(_matrix(table.column("embedding"), np.arange(len(own))))
        asked = np.stack(table.column("codes").to_numpy()).reshape(len(own), tables, probes)
        count, root = np.zeros(len(own), dtype=np.int64), np.arange(len(own))
        for i in range(0, len(left), COMPARED):
            some = left[i : i + COMPARED]
            a, b = np.nonzero(units[some] @ units[right].T >= threshold)
            a, b = some[a], right[b]
            keep = (own[a] | own[b]) & (node[a] != node[b])
            if alone:
                keep &= a < b
            a, b = a[keep], b[keep]
            for j in range(0, len(a), 100_000):
                p, q = a[j : j + 100_000], b[j : j + 100_000]
                t, code = _first_meeting(asked[:, :, 0], asked, p, q)
                first = (t == here[0]) & (code == here[1])
                p, q = p[first], q[first]
                np.add.at(count, p, weight[q])
                np.add.at(count, q, weight[p])
                if len(p):
                    root = forest(root[p], root[q], len(own))[root]
        has, linked = np.flatnonzero(count), np.flatnonzero(root != np.arange(len(root)))
        a = np.concatenate((node[has], node[linked]))
        b = pa.concat_arrays([pa.nulls(len(has), pa.int64()), pa.array(node[root[linked]], pa.int64())])
        n = pa.concat_arrays([pa.array(count[has]), pa.nulls(len(linked), pa.int64())])
        return pa.array(a), b, n

    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "a long, b long, n long")


def near_duplicates(
    df: DataFrame, threshold: float = THRESHOLD, id_column: str = "vec_id", vector_column: str = "embedding", tables: int = TABLES, probes: int = PROBES
) -> DataFrame:
    """Per row: vec_id, n_links (other vectors linked directly), component_id (smallest id reachable), kept.

    A vector that is null, empty or zero, or holds a null or non-finite component, links with nothing; so do vectors of
    different lengths. Equal vectors are one node with a weight: copies are counted, never paired. Rows with a null id are
    vectors like any other but name no component; repeated rows come back as often as they occur.
    """
    rows = df.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).alias("embedding"))
    parts = F.col("embedding")
    finite = F.forall(parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.coalesce(finite & F.exists(parts, lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("good", good)
    groups = rows.where("good").groupBy("embedding").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("weight"))
    classes = written(groups.withColumn("node", F.monotonically_increasing_id()), "vectors")
    found = written(links(with_buckets(classes.select("node", "weight", "embedding"), tables, probes), threshold, tables, probes), "vector-links")
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    reached = components(found.where("b IS NOT NULL").select("a", "b"))
    named = classes.join(counts, "node", "left").join(reached, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = named.join(names, "component").select("embedding", "component_id", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    linked = rows.where("good").join(named, "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.union(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
