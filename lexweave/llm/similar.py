"""Near copies by the words they share: SimHash finds the candidates, their Jaccard similarity decides.

Two documents are linked if at least 0.8 of their distinct five-word shingles are common. At that similarity a bit of their
SimHash differs with a chance of about 0.15, so 64 bits differ in about 10: too many for an index over one short fingerprint.
A document therefore has a fingerprint of 18 times 64 bits. It meets others in one bucket for each of 64 runs of 16 bits; a
pair of similarity 0.8 agrees on at least one run with a chance of about 0.99, closer pairs nearly always. Within a bucket the
other 128 bits tell which pairs are near: they are searched in the hierarchical index over Gray order of ``simhash``, with its
ranges of large buckets and its pruning by accumulated differences. Near pairs are candidates, of more than 16 rows that such
pairs connect in a bucket only the closest that connect them.
The similarity of candidates is counted exactly. The buckets of a few runs come first: what their links connect is one class,
and of the buckets of all other runs only pairs of different classes are candidates, as no other pair can change a component.
Nor are pairs of sets of which the smaller has less than 0.8 of the members of the larger.
A closest pair that connects may fall short of 0.8 where another near pair does not. So the rows of near pairs that were no
candidates go through all their buckets once more, and every near pair of different classes is counted then, but for those
that a bitmap of their members excludes.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from lexweave.llm import simhash
from lexweave.llm.common import BROADCAST_ROWS, batch_of, drop_encoders, small, text_slices, whole_groups, written
from lexweave.llm.components import components, forest
from lexweave.llm.simhash import SEED, _BYTE_BITS, shingles

SHINGLE, LEAST = 5, 0.8
#: Words of 64 bits that make the runs, and those that are compared within a bucket.
RUN_WORDS, CHECK_WORDS = 16, 2
#: Differing bits of 128 up to which a pair is a candidate: at similarity 0.8 about 19 differ, give or take 4.
NEAR = 36
#: Near pairs a row that are held at once; of more, the closest that connect them stay.
LISTED = 64
#: Rows that near pairs connect within a bucket up to which every near pair is a candidate.
WHOLE = 16
#: Pairs that go down the index at once, and those that are looked at one by one before the connected ones are left out.
AT_ONCE, SOME = 1_000_000, 4096
#: Rows of buckets that a task looks at together.
ROWS = 16384
#: Runs of 16 bits, and those of them whose buckets are searched first.
RUNS, FIRST_RUNS = 4 * RUN_WORDS, 8
#: Least and most bytes of a set's bitmap, and pairs whose bitmaps are compared at once.
LEAST_BITS, MOST_BITS, BITS_AT_ONCE = 16, 512, 20_000


# --- fingerprints ---------------------------------------------------------------------------------------------------


def shingle_set(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """Hashes of the distinct shingles, sorted."""
    found = shingles(text, width)
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, found, repeat(SEED)), dtype="<u8", count=len(found)))


def _mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """The ``k``-th of many hashes that behave like independent ones."""
    x = hashes + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """One row of 18 words per set: each bit is one that over half the hashes have; zero for an empty set."""
    n, words = len(sets), RUN_WORDS + CHECK_WORDS
    out = np.zeros((n, words), dtype="<u8")
    sizes = np.array([len(s) for s in sets])
    if not sizes.sum():
        return out
    hashes = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes) * 256
    for w in range(words):
        octets = _mixed(hashes, w).view(np.uint8).reshape(-1, 8)
        ones = np.empty((n, 8, 8))
        for k in range(8):
            ones[:, k] = np.bincount(owner + octets[:, k], minlength=256 * n).reshape(-1, 256) @ _BYTE_BITS
        out[:, w] = np.packbits(ones.reshape(-1, 64) * 2 > sizes[:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


_SET_ROW = "id long, text_hash long, node long, size int, check1 long, check2 long, runs array<smallint>"


def with_fingerprints(df: DataFrame, id_column: str, text_column: str, width: int) -> DataFrame:
    """Per row ``node`` (a hash of the set of shingles), the set's size, the two check words and the values of the 64 runs."""
    longs = lambda *names: ((c, pa.int64()) for c in names)
    schema = pa.schema([*longs("id", "text_hash", "node"), ("size", pa.int32()), *longs("check1", "check2"), ("runs", pa.list_(pa.int16()))])

    def run(batches):
        drop_encoders()
        for batch in batches:
            for part in text_slices(batch, most=2_000_000):
                sets = [shingle_set(t, width) for t in part.column("text").to_pylist()]
                codes = fingerprints(sets)
                node = [xxhash.xxh64_intdigest(s.tobytes(), seed=SEED) - (1 << 63) for s in sets]
                values = np.ascontiguousarray(codes[:, :RUN_WORDS]).view("<i2")
                ends = pa.array(np.arange(len(sets) + 1) * values.shape[1], pa.int32())
                checks = (pa.array(codes[:, RUN_WORDS + k].copy().view(np.int64)) for k in range(CHECK_WORDS))
                yield batch_of(schema, part.column("id"), part.column("text_hash"), node, list(map(len, sets)), *checks, pa.ListArray.from_arrays(ends, pa.array(values.ravel())))

    rows = df.select(F.col(id_column).cast("long").alias("id"), F.xxhash64(text_column).alias("text_hash"), F.col(text_column).alias("text"))
    return rows.mapInArrow(run, _SET_ROW)


# --- candidates -----------------------------------------------------------------------------------------------------


def _far(checks: np.ndarray, a, b) -> np.ndarray:
    return np.bitwise_count(checks[a] ^ checks[b]).sum(axis=-1, dtype=np.int64)


def _spanning(a: np.ndarray, b: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Places of the closest pairs that connect all that the pairs connect."""
    order = np.lexsort((b, a, far)) if len(far) < SOME else np.argsort(far, kind="stable")
    n = int(max(a.max(), b.max())) + 1 if len(far) else 0
    root, out = np.arange(n), []
    while len(order):
        head, order = order[: max(SOME, n)], order[max(SOME, n) :]
        up = root.tolist()
        for k, x, y in zip(head.tolist(), a[head].tolist(), b[head].tolist()):
            while up[x] != x:
                up[x] = x = up[up[x]]
            while up[y] != y:
                up[y] = y = up[up[y]]
            if x != y:
                up[max(x, y)] = min(x, y)
                out.append(k)
        root = np.array(up)
        while (root != (further := root[root])).any():
            root = further
        order = order[root[a[order]] != root[b[order]]]  # what is connected by now needs no look
    return np.array(out, dtype=np.int64)


def _connecting(a: np.ndarray, b: np.ndarray, far: np.ndarray, n: int, whole: int) -> np.ndarray:
    """Places of all pairs where pairs connect at most ``whole`` of ``n`` rows, elsewhere of the closest that connect them."""
    if not len(a):
        return np.zeros(0, dtype=np.int64)
    root = forest(a, b, n)
    large = np.bincount(root, minlength=n)[root[a]] > whole
    at = np.flatnonzero(large)
    return np.append(np.flatnonzero(~large), at[_spanning(a[at], b[at], far[at])])


def _near_blocks(group: np.ndarray, checks: np.ndarray, side: np.ndarray | None):
    """Blocks of all near pairs of places within the groups, with their differing bits.

    They are found in the Gray-order index of ``simhash``, over the check words. Where ``side`` tells two ranges of a bucket
    apart, rows of the one meet rows of the other.
    """
    group = np.cumsum(np.append(0, group[1:] != group[:-1])) if len(group) else group
    order = simhash.gray_order(checks, group)
    codes, group = checks[order], group[order]
    side = np.zeros(len(group), dtype=np.int64) if side is None else side[order]
    ask, told = simhash.asked_and_told(group, side)
    both = (side[ask] == 1).any()
    for q, node in simhash.search(codes[ask], group[ask], codes[told], group[told], NEAR, AT_ONCE):
        x, y = ask[q], told[node]
        once = (x < y) | (side[x] == 1) if both else x < y
        x, y = x[once], y[once]
        far = _far(codes, x, y).astype(np.uint8)
        x, y = order[x], order[y]
        yield np.minimum(x, y), np.maximum(x, y), far


def near_pairs(group: np.ndarray, checks: np.ndarray, side: np.ndarray | None = None, whole: int = 0, left_out=None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places within the groups, which lie together: candidates that connect all that candidates connect.

    Where these are at most ``whole`` rows, all pairs. All other near pairs go to ``left_out``, a function of two arrays of
    places.
    """
    a = b = far = np.zeros(0, dtype=np.int64)

    def connecting():
        keep = _connecting(a, b, far, len(group), whole)
        if left_out and len(keep) < len(a):
            others = np.ones(len(a), dtype=bool)
            others[keep] = False
            left_out(a[others], b[others])
        return a[keep], b[keep], far[keep]

    for x, y, apart in _near_blocks(group, checks, side):
        a, b, far = np.append(a, x), np.append(b, y), np.append(far, apart)
        if len(a) > LISTED * len(group):
            a, b, far = connecting()
    return connecting()[:2]


_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _keyed(nodes: DataFrame, first: int, end: int, *more: str) -> DataFrame:
    """``bucket, side`` and what a task compares, the rows of a bucket together: of every node one row for each run from ``first`` to before ``end``.

    Buckets of many rows are cut into ranges of Gray rank as in ``simhash.links``, and only ranges that may be near meet.
    """
    own = ["node", "class", "size", *more]
    met = nodes.select("check1", "check2", *own, F.posexplode(F.slice("runs", first + 1, end - first)).alias("run", "value"))
    met = met.select("run", F.col("value").cast("int").alias("value"), simhash._gray("check1").alias("g"), "check1", "check2", *own)
    marks = written(simhash.range_marks(met), "range-marks")
    if marks.isEmpty():
        keyed = met.select(F.xxhash64("run", "value").alias("bucket"), F.lit(0).alias("side"), "check1", "check2", *own)
    else:
        keyed = simhash.dealt(met, small(marks), ["check1", "check2"], NEAR, *own)
    return keyed.repartition("bucket").sortWithinPartitions("bucket", "node")


def _may_link(table: pa.Table, least: float):
    """Whether the rows at two places are of different classes and of sizes that do not exclude a link."""
    known, none = table.column("class").fill_null(0).to_numpy(), table.column("class").is_null().to_numpy()
    size = table.column("size").to_numpy()

    def may(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        alike = np.minimum(size[a], size[b]) / np.maximum(1, np.maximum(size[a], size[b])) >= least
        return alike & ((known[a] != known[b]) | none[a] | none[b])

    return may


def _compared(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket, check words and side of the rows of a task."""
    checks = np.column_stack([table.column(c).to_numpy().view(np.uint64) for c in ("check1", "check2")])
    return table.column("bucket").to_numpy(), checks, table.column("side").to_numpy()


def candidates(nodes: DataFrame, first: int = 0, end: int = RUNS, least: float = LEAST) -> DataFrame:
    """``a, b`` with a < b, of ``nodes(node, size, class, check1, check2, runs)``, one row each, by the runs from ``first`` to before ``end``.

    Left out are pairs of the same ``class`` (a node whose class is null is in none) and those whose sizes alone make them less
    similar than ``least``. Of all other near pairs that are no candidates either node comes as a row with a = b.
    """

    def run(batches):
        drop_encoders()
        for table in whole_groups(batches, "bucket", ROWS):
            group, checks, side = _compared(table)
            may, more = _may_link(table, least), np.zeros(len(group), dtype=bool)

            def mark(a, b):
                open_ = may(a, b)
                more[a[open_]] = more[b[open_]] = True

            a, b = near_pairs(group, checks, side, WHOLE, mark)
            node = table.column("node").to_numpy()
            kept = may(a, b)
            a, b = node[a[kept]], node[b[kept]]
            differ, marked = a != b, node[more]  # a row of both sides meets itself
            yield batch_of(_PAIR, np.append(np.minimum(a, b)[differ], marked), np.append(np.maximum(a, b)[differ], marked))

    return _keyed(nodes, first, end).mapInArrow(run, "a long, b long").distinct()


def bitmap(members: np.ndarray) -> bytes:
    """A bit for every member by its lowest bits; the more members, the more bytes, a power of two."""
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (len(members) - 1).bit_length() if len(members) else 0))
    bits = np.zeros(8 * size, dtype=bool)
    bits[members.view(np.uint64) & np.uint64(8 * size - 1)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _folded(bits: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps of ``width`` words from those of as many or more: members keep their lowest bits."""
    return np.bitwise_or.reduce(bits.reshape(len(bits), -1, width), axis=1)


def most_common(size: np.ndarray, bits: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """At most so many members do the sets at places ``a`` and ``b`` share: a bit that one lacks is a member of the other alone."""
    out = np.minimum(size[a], size[b]).astype(np.int64)
    width = np.array([len(x) for x in bits])
    for one in np.unique(width[a]):
        for two in np.unique(width[b[width[a] == one]]):
            at = np.flatnonzero((width[a] == one) & (width[b] == two))
            for k in range(0, len(at), BITS_AT_ONCE):
                some = at[k : k + BITS_AT_ONCE]
                x, y = (_folded(np.stack([bits[i] for i in places]), min(one, two)) for places in (a[some], b[some]))
                alone = [np.bitwise_count(p & ~q).sum(axis=1, dtype=np.int64) for p, q in ((x, y), (y, x))]
                out[some] = np.minimum(size[a[some]] - alone[0], size[b[some]] - alone[1])
    return out


def open_pairs(nodes: DataFrame, least: float = LEAST) -> DataFrame:
    """``a, b`` with a < b: every near pair of ``nodes(node, size, class, check1, check2, runs, bits)`` that may still link two classes."""

    def run(batches):
        drop_encoders()
        for table in whole_groups(batches, "bucket", ROWS):
            group, checks, side = _compared(table)
            may, size, node = _may_link(table, least), table.column("size").to_numpy(), table.column("node").to_numpy()
            bits = [np.frombuffer(x, dtype="<u8") for x in table.column("bits").to_pylist()]
            for a, b, _ in _near_blocks(group, checks, side):
                kept = may(a, b) & (node[a] != node[b])
                a, b = a[kept], b[kept]
                common = most_common(size, bits, a, b)
                kept = common / np.maximum(1, size[a].astype(np.int64) + size[b] - common) >= least
                a, b = node[a[kept]], node[b[kept]]
                yield batch_of(_PAIR, np.minimum(a, b), np.maximum(a, b))

    return _keyed(nodes, 0, RUNS, "bits").mapInArrow(run, "a long, b long").distinct()


def with_bits(sets: DataFrame) -> DataFrame:
    """``node, bits`` of ``sets(node, members)``."""
    schema = pa.schema([("node", pa.int64()), ("bits", pa.binary())])

    def run(batches):
        for batch in batches:
            members = batch.column("members")
            flat, ends = members.flatten().to_numpy(), np.cumsum(np.append(0, members.value_lengths().to_numpy()))
            yield batch_of(schema, batch.column("node"), [bitmap(flat[i:j]) for i, j in zip(ends, ends[1:])])

    return sets.mapInArrow(run, "node long, bits binary")


# --- the similarity -------------------------------------------------------------------------------------------------


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Common of all members of two sorted sets; two empty ones are equal."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common) if len(a) or len(b) else 1.0


#: Stands for a null id in keys.
NO_ID = -(1 << 63)


def _key():
    return F.coalesce("id", F.lit(NO_ID))


def _sets(texts: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``node, members`` of the written table ``wanted(node, key, text_hash)``."""
    schema = pa.schema([("node", pa.int64()), ("members", pa.list_(pa.int64()))])

    def run(batches):
        drop_encoders()
        for batch in batches:
            for part in text_slices(batch, most=1_000_000):
                sets = [shingle_set(t, width).view(np.int64) for t in part.column("text").to_pylist()]
                ends = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
                yield batch_of(schema, part.column("node"), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets))))

    keyed = texts.select(_key().alias("key"), F.xxhash64("text").alias("text_hash"), "text")
    found = keyed.join(small(wanted), ["key", "text_hash"]).dropDuplicates(["key", "text_hash"])  # repeated rows are one
    return found.select("node", "text").mapInArrow(run, "node long, members array<bigint>")


def links(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of ``pairs(a, b)`` whose sets are similar enough.

    Common members are counted row by row inside Spark: batches of thousands of pairs with both sets never go to a worker.
    """
    both = pairs.join(sets.withColumnsRenamed({"node": "a", "members": "one"}), "a").join(sets.withColumnsRenamed({"node": "b", "members": "two"}), "b")
    common = F.size(F.array_intersect("one", "two"))
    members = F.size("one") + F.size("two") - common
    return both.where((members == 0) | (F.try_divide(common, members) >= least)).select("a", "b")


def keep_first(
    df: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = SHINGLE, least: float = LEAST, earlier: DataFrame | None = None
) -> DataFrame:
    """One row of each component, with its own columns: that of the smallest id, of several of this id one text, once.

    Texts of the same set of shingles are one node, those without words too. Of a component of null ids alone one row stays.
    ``earlier`` may hold the texts that the documents had before something was cut out of them, under the same ids: then
    documents are also linked if those are similar. Ids that ``earlier`` lacks or alone has change nothing.
    """
    texts = df.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    rows = written(with_fingerprints(texts, "id", "text", width), "wide-fingerprints").withColumn("old", F.lit(False))
    every, own = rows, None
    if earlier is not None:
        before = earlier.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text")).where("id IS NOT NULL")
        now = written(rows.select("id", F.col("text_hash").alias("now"), F.col("node").alias("a")).where("id IS NOT NULL").distinct(), "now")
        # only texts that have changed matter, and if the ids fit into a broadcast no other is looked at
        known = now.select("id", "now")
        changed = before.join(F.broadcast(known), (before["id"] == known["id"]) & (F.xxhash64(before["text"]) != known["now"]), "left_semi") if now.count() <= BROADCAST_ROWS else before
        found = written(with_fingerprints(changed, "id", "text", width), "earlier-fingerprints").withColumn("old", F.lit(True))
        found = found.join(now.select("id", F.col("now").alias("text_hash")), ["id", "text_hash"], "left_anti")
        both = found.join(now, "id").where("node <> a")
        own = written(both.select("a", F.col("node").alias("b")).distinct(), "own-links")
        every = rows.union(found.join(now.select("id").distinct(), "id", "left_semi").select(rows.columns))
    nodes = every.groupBy("node").agg(
        F.first("size").alias("size"), F.first("check1").alias("check1"), F.first("check2").alias("check2"), F.first("runs").alias("runs"),
        F.min(F.when(~F.col("old"), F.col("id"))).alias("first"), F.min(F.struct("old", _key().alias("key"), "text_hash")).alias("one"),
    )
    nodes = written(nodes, "nodes")

    def sets_of(asked: DataFrame) -> DataFrame:
        wanted = written(nodes.join(asked, "node", "left_semi").select("node", "one.old", "one.key", "one.text_hash"), "wanted")
        sets = _sets(texts, wanted.where("NOT old").drop("old"), width)
        if earlier is not None:
            sets = sets.union(_sets(before, wanted.where("old").drop("old"), width))
        return written(sets, "shingle-sets")

    def linked(pairs: DataFrame) -> DataFrame:
        return links(pairs, sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()), least)

    first = written(candidates(nodes.withColumn("class", F.lit(None).cast("long")), 0, FIRST_RUNS, least), "candidates")
    pairs = first.where("a < b")
    if own is not None:  # these are linked already
        pairs = pairs.join(own.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    found = linked(pairs)
    classes = written(components(found if own is None else found.union(own)), "classes").withColumnRenamed("component", "class")
    other = written(candidates(nodes.join(small(classes), "node", "left"), FIRST_RUNS, least=least), "candidates")
    reached = written(components(linked(other.where("a < b")).union(classes.select("node", "class"))), "classes")
    counted = first.union(other)
    marked = written(counted.where("a = b").select(F.col("a").alias("node")).distinct(), "marked")
    if not marked.isEmpty():
        sets = sets_of(marked)
        classes = nodes.join(small(marked), "node").join(reached.withColumnRenamed("component", "class"), "node", "left")
        pairs = open_pairs(written(classes.join(with_bits(sets), "node"), "marked-nodes"), least).join(counted, ["a", "b"], "left_anti")
        reached = components(links(written(pairs, "candidates"), sets, least).union(reached.select("node", "component")))
    named = nodes.select("node", "first").join(reached, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = named.groupBy("component").agg(F.min("first").alias("component_id"))
    members = rows.select("id", "text_hash", "node").join(named.join(names, "component").select("node", "component", "component_id"), "node")
    leaders = members.where("id <=> component_id").groupBy("component").agg(F.min(_key()).alias("_id"), F.min("text_hash").alias("_hash"))
    leaders = written(leaders.select("_id", "_hash"), "leaders")
    id_, text = F.col(id_column).cast("long"), F.col(text_column).cast("string")
    keyed = df.select(F.struct("*").alias("row"), F.coalesce(id_, F.lit(NO_ID)).alias("_id"), F.xxhash64(text).alias("_hash"))
    return keyed.join(small(leaders), ["_id", "_hash"]).dropDuplicates(["_id", "_hash"]).select("row.*")
