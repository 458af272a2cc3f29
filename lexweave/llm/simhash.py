"""SimHash near-duplicates: fingerprints by bit majority, links by a hierarchical index over Gray order.

Two fingerprints that differ in at most 3 of 64 bits agree on one of four runs of 16 bits. Fingerprints therefore meet in
buckets of one run's value. A bucket of many fingerprints is cut into ranges of Gray rank; the bits that all of a range share
are its node in the upper index, and two ranges whose nodes already differ in more than 3 shared bits never meet. Within a
task the ranges hold the lower index: fingerprints in Gray order, nodes over nodes, each with the bits its members share
beyond its parent's; a query adds up its differences on the way down and leaves a group when they exceed 3.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from lexweave.llm.common import batch_of, text_slices, whole_groups, written
from lexweave.llm.components import components, forest

SEED = 42
SHINGLE = 3
BITS, MOST, RUN = 64, 3, 16
#: Children of a node of the lower index.
FAN = 8
#: Fingerprints of one range of a bucket.
RANGE = 4096
#: Queries that go down the lower index at once.
QUERIES = 2048

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)


# --- fingerprints ---------------------------------------------------------------------------------------------------


def shingles(text: str | None, width: int = SHINGLE) -> list[bytes]:
    """Word shingles of the lower-cased text, repeats included; of fewer words, the one sequence; of none, nothing."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if len(words) < width:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(width)))))


def fingerprints(texts: list[str | None], width: int = SHINGLE) -> np.ndarray:
    """One bit for each bit that over half the shingles' hashes have; zero without shingles."""
    hashes, sizes = [], []
    for text in texts:
        found = shingles(text, width)
        sizes.append(len(found))
        hashes.append(np.fromiter(map(xxhash.xxh64_intdigest, found, repeat(SEED)), dtype="<u8", count=len(found)))
    if not texts:
        return np.zeros(0, dtype=np.uint64)
    sizes = np.array(sizes)
    octets = np.concatenate(hashes).view(np.uint8).reshape(-1, 8)
    owner = np.repeat(np.arange(len(texts)), sizes) * 256
    ones = np.empty((len(texts), 8, 8))
    for k in range(8):  # how often each value of byte k occurs in a text gives the counts of its 8 bits
        ones[:, k] = np.bincount(owner + octets[:, k], minlength=256 * len(texts)).reshape(-1, 256) @ _BYTE_BITS
    bits = ones.reshape(-1, BITS) * 2 > sizes[:, None]
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()


def with_fingerprints(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = SHINGLE) -> DataFrame:
    """``id, text_hash, fp`` (the 64 bits as a long) of every row."""
    schema = pa.schema([("id", pa.int64()), ("text_hash", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for batch in batches:
            for part in text_slices(batch):
                yield batch_of(schema, part.column("id"), part.column("text_hash"), fingerprints(part.column("text").to_pylist(), width).view(np.int64))

    rows = df.select(F.col(id_column).cast("long").alias("id"), F.xxhash64(text_column).alias("text_hash"), F.col(text_column).alias("text"))
    return rows.mapInArrow(run, "id long, text_hash long, fp long")


# --- the lower index ------------------------------------------------------------------------------------------------


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of a code in Gray order: neighbours in this order differ in one bit."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def gray_order(codes: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Places of codes, of one word or a row of words each, by group and Gray order."""
    words = codes[:, None] if codes.ndim == 1 else codes
    ranks, odd = [], np.zeros(len(words), dtype=np.uint64)
    for w in range(words.shape[1]):  # after an odd number of ones the words to come run backwards
        ranks.append(gray_rank(words[:, w]) ^ (np.uint64(0) - odd))
        odd ^= np.bitwise_count(words[:, w]).astype(np.uint64) & np.uint64(1)
    return np.lexsort((*reversed(ranks), group))


def _ones(x: np.ndarray) -> np.ndarray:
    """Set bits of every code."""
    return np.bitwise_count(x) if x.ndim == 1 else np.bitwise_count(x).sum(axis=-1, dtype=np.uint8)


def index(codes: np.ndarray, group: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """Levels from the roots down: first child, end of children, bits beyond the parent's, pattern. Leaves are the codes.

    ``codes``, of one word or a row of words each, lie in Gray order within each ``group``; no node covers two groups.
    """
    ones, zeros = codes, ~codes
    starts, ends, owner = np.arange(len(codes)), np.arange(1, len(codes) + 1), group
    levels = []
    while True:
        levels.append((starts, ends, ones | zeros, ones))
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, int)
        place = np.arange(len(owner)) - np.repeat(first, np.diff(np.append(first, len(owner))))
        if not len(owner) or place.max() < FAN:
            break
        heads = np.flatnonzero(place % FAN == 0)
        ones, zeros = np.bitwise_and.reduceat(ones, heads), np.bitwise_and.reduceat(zeros, heads)
        starts, ends, owner = heads, np.append(heads[1:], len(owner)), owner[heads]
    levels.reverse()
    out = [(*levels[0][:2], levels[0][2], levels[0][3])]
    for (s, e, parent, _), (s2, e2, mask, ones) in zip(levels, levels[1:]):
        out.append((s2, e2, mask & ~np.repeat(parent, e - s, axis=0), ones))
    return out + [owner]


def _expand(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which range, and the members of all ranges one after another."""
    sizes = ends - starts
    which = np.repeat(np.arange(len(starts)), sizes)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[which]


def search(queries: np.ndarray, query_group: np.ndarray, codes: np.ndarray, group: np.ndarray, most: int = MOST, at_once: int | None = None):
    """Blocks of pairs (query, code) of one group that differ in at most ``most`` bits.

    A block goes down the index for ``QUERIES`` queries, or for so many that their groups have about ``at_once`` codes.
    """
    *levels, owner = index(codes, group)
    first, end = np.searchsorted(owner, query_group, side="left"), np.searchsorted(owner, query_group, side="right")
    cuts = list(range(0, len(queries), QUERIES))
    if at_once:
        met = np.searchsorted(group, query_group, side="right") - np.searchsorted(group, query_group, side="left")
        block = np.cumsum(met) // at_once
        cuts = np.flatnonzero(np.append(True, block[1:] != block[:-1])).tolist() if len(block) else []
    for at, stop in zip(cuts, [*cuts[1:], len(queries)]):
        q, node = _expand(first[at:stop], end[at:stop])
        q += at
        far = np.zeros(len(q), dtype=np.uint8)
        for depth, (starts, ends, mask, ones) in enumerate(levels):
            far = far + _ones((queries[q] ^ ones[node]) & mask[node])
            near = far <= most
            q, node, far = q[near], node[near], far[near]
            if depth + 1 < len(levels):
                which, node = _expand(starts[node], ends[node])
                q, far = q[which], far[which]
        yield q, node


# --- Spark jobs -----------------------------------------------------------------------------------------------------


def _runs(fps: DataFrame) -> DataFrame:
    runs = F.array(*(F.struct(F.lit(i).cast("byte").alias("run"), F.shiftrightunsigned("fp", RUN * i).bitwiseAND(0xFFFF).cast("int").alias("value")) for i in range(BITS // RUN)))
    return fps.select("fp", F.explode(runs).alias("r")).select("r.run", "r.value", "fp")


def _gray(fp: str):
    rank = F.col(fp)
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, shift))
    return F.shiftrightunsigned(rank, 1)  # keeps the order and fits a signed long


def range_marks(rows: DataFrame) -> DataFrame:
    """``run, value, marks``: where buckets of more than ``RANGE`` of ``rows(run, value, g)`` are cut, ``g`` being Gray rank.

    Ranges are bounded by quantiles that Spark merges from sketches, so no task sorts a bucket whole; their exact place does
    not matter, as every two ranges with near nodes meet.
    """
    sizes = rows.groupBy("run", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > RANGE)
    big = rows.join(sizes, ["run", "value"])
    parts = F.ceil(F.max("n") / RANGE).cast("int")
    marks = big.groupBy("run", "value").agg(F.percentile_approx("g", F.array(*(F.lit(i / 256) for i in range(1, 256))), 4096).alias("q"), parts.alias("parts"))
    return marks.select("run", "value", F.array_distinct(F.filter("q", lambda x, i: (i + 1) % F.greatest(F.lit(1), F.floor(F.lit(256) / F.col("parts")).cast("int")) == 0)).alias("marks"))


def dealt(rows: DataFrame, marks: DataFrame, words: list[str], most: int, *carried: str) -> DataFrame:
    """``bucket, side`` and the columns of ``rows(run, value, g, *words, *carried)``: a bucket, or two of its ranges that may be near.

    The bits that all codes of a range share, over all their ``words``, are its node; two ranges whose nodes differ in more
    than ``most`` shared bits never meet.
    """
    own = [*words, *carried]
    chunk = F.coalesce(F.size(F.filter("marks", lambda x: x < F.col("g"))), F.lit(0))
    rows = rows.join(marks, ["run", "value"], "left").select("run", "value", F.greatest(chunk, F.lit(0)).alias("chunk"), *own, F.col("marks").isNotNull().alias("cut"))
    shared = [x for i, w in enumerate(words) for x in (F.bit_and(w).alias(f"ones{i}"), F.bit_and(F.bitwise_not(w)).alias(f"zeros{i}"))]
    nodes = rows.where("cut").groupBy("run", "value", "chunk").agg(*shared)
    other = nodes.select("run", "value", *(F.col(c).alias(f"{c}_2") for c in nodes.columns[2:])).withColumnRenamed("chunk_2", "chunk2")
    apart = sum((F.bit_count(F.expr(f"(ones{i} & zeros{i}_2) | (zeros{i} & ones{i}_2)")) for i in range(len(words))), F.lit(0))
    near = nodes.join(other, ["run", "value"]).where(F.col("chunk") <= F.col("chunk2")).where(apart <= most)
    near = near.select("run", "value", F.explode(F.array(F.struct(F.col("chunk").alias("chunk"), F.lit(0).alias("side")), F.struct(F.col("chunk2").alias("chunk"), F.lit(1).alias("side")))).alias("c"), F.concat_ws("-", "chunk", "chunk2").alias("pair"))
    near = near.select("run", "value", "c.chunk", "c.side", "pair").distinct()
    met = rows.where("cut").join(near, ["run", "value", "chunk"]).select("run", "value", "pair", "side", *own)
    single = rows.where("NOT cut").select("run", "value", F.lit("").alias("pair"), F.lit(0).alias("side"), *own)
    return single.union(met).select(F.xxhash64("run", "value", "pair").alias("bucket"), "side", *own)


def asked_and_told(group: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of queries and of codes: in a group of two ranges the second asks the first, elsewhere all ask all."""
    double = np.zeros(group[-1] + 1, dtype=bool) if len(group) else np.zeros(0, dtype=bool)
    double[group[side == 1]] = True
    return np.flatnonzero((side == 1) | ~double[group]), np.flatnonzero((side == 0) | ~double[group])


def links(fps: DataFrame, most: int = MOST) -> DataFrame:
    """``a, b``: fingerprints that differ in 1 to 3 bits, enough of them to connect all that such links connect.

    ``fps.fp`` must be distinct.
    """
    rows = _runs(fps).withColumn("g", _gray("fp"))
    keyed = dealt(rows, range_marks(rows), ["fp"], most).repartition("bucket").sortWithinPartitions("bucket")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def join(batches):
        for table in whole_groups(batches, "bucket", 4 * RANGE):
            yield from found(table)

    def found(table: pa.Table):
        bucket, side = table.column("bucket").to_numpy(), table.column("side").to_numpy()
        codes = table.column("fp").to_numpy().view(np.uint64)
        group = np.cumsum(np.append(0, bucket[1:] != bucket[:-1]))
        order = gray_order(codes, group)
        codes, group, side = codes[order], group[order], side[order]
        ask, told = asked_and_told(group, side)
        root = np.arange(len(codes))
        for q, node in search(codes[ask], group[ask], codes[told], group[told], most):
            a, b = ask[q], told[node]
            differ = codes[a] != codes[b]
            a, b = root[a[differ]], root[b[differ]]
            if len(a):
                root = forest(a, b, len(codes))[root]
        linked = np.flatnonzero(root != np.arange(len(root)))
        yield batch_of(schema, codes[linked].view(np.int64), codes[root[linked]].view(np.int64))

    return keyed.mapInArrow(join, "a long, b long").where("a <> b").distinct()


def _named(df: DataFrame, id_column: str, text_column: str, width: int, most: int) -> DataFrame:
    """id, text_hash, fp, component_id and component (a name that is never null) of every row."""
    rows = written(with_fingerprints(df, id_column, text_column, width), "fingerprints")
    classes = written(rows.groupBy("fp").agg(F.min("id").alias("first")), "classes")
    reached = components(links(classes.select("fp"), most))
    named = classes.join(reached.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    names = named.groupBy("component").agg(F.min("first").alias("component_id"))
    return rows.join(named.join(names, "component").select("fp", "component", "component_id"), "fp")


def near_duplicates(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = SHINGLE, most: int = MOST) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hexadecimal digits), component_id, the smallest id reachable by links.

    Null, empty and blank texts have fingerprint zero and link like any other. Rows with a null id count as members of
    their fingerprint but never name a component; a component of such rows alone has a null name. Repeated rows come back
    as often as they occur.
    """
    out = _named(df, id_column, text_column, width, most)
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = SHINGLE, most: int = MOST) -> DataFrame:
    """One row of each component, with its own columns: that of the smallest id, of several of this id one text, once."""
    rows = _named(df, id_column, text_column, width, most)
    leaders = rows.where("id <=> component_id").groupBy("component").agg(F.min("component_id").alias("_id"), F.min("text_hash").alias("_hash"))
    keyed = df.select(F.struct("*").alias("row"), F.col(id_column).cast("long").alias("_id"), F.xxhash64(text_column).alias("_hash"))
    leaders = leaders.select(F.col("_id").alias("_id2"), F.col("_hash").alias("_hash2"))
    kept = keyed.join(leaders, F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_hash") == F.col("_hash2")), "left_semi")
    return kept.dropDuplicates(["_id", "_hash"]).select("row.*")
