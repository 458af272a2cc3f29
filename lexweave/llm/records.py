"""Token ids as length-delimited binary records, with a separate offset index for shuffled reads.

A record is ``length (u64) | masked CRC-32C of these 8 bytes (u32) | payload | masked CRC-32C of the payload (u32) | 0x0A``,
all little-endian. The payload is ``doc_id (i64) | flags (u8) | ids``: flag 1 marks a null id, flag 2 ids of four bytes
instead of two. A masked checksum is the checksum turned right by 15 bits plus a constant, as is usual for records that may
hold checksums themselves. Files are written through Spark's own committed writer, so any file system of the cluster will do
and a repeated task leaves nothing behind.
"""

from __future__ import annotations

import functools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lexweave.llm.common import batch_of, encoder, text_slices, texts, written

END_ID = 0
RECORDS_PER_FILE = 2048
#: Pieces of text whose ids a worker keeps here, and as many older ones.
KEPT = 600_000
#: Bytes of text that one file partition is meant to hold.
PARTITION_BYTES = 64 << 20
LANE = 512
MASK_DELTA = 0xA282EAD8
HEADER, OVERHEAD = 12, 17


# --- checksums ------------------------------------------------------------------------------------------------------


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The state after two more bytes, by its low 16 bits; for each power of two, the state after so many zero bytes by its four bytes."""
    state = np.arange(1 << 16, dtype=np.uint32)
    for _ in range(16):
        state = (state >> 1) ^ np.where(state & 1, np.uint32(0x82F63B78), np.uint32(0))
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    step = bits  # after one zero byte, by bit
    for _ in range(8):
        step = (step >> 1) ^ np.where(step & 1, np.uint32(0x82F63B78), np.uint32(0))
    powers = []
    for _ in range(40):
        tables = np.zeros((4, 256), dtype=np.uint32)
        for k in range(32):
            tables[k // 8] ^= np.where(np.arange(256) >> (k % 8) & 1, step[k], 0).astype(np.uint32)
        powers.append(tables)
        step = _apply(tables, step)
    return state, np.array(powers)


def _apply(tables: np.ndarray, state: np.ndarray) -> np.ndarray:
    return tables[0][state & 0xFF] ^ tables[1][state >> 8 & 0xFF] ^ tables[2][state >> 16 & 0xFF] ^ tables[3][state >> 24]


def crc32c(data: bytes, starts: np.ndarray, lengths: np.ndarray, lane: int = LANE) -> np.ndarray:
    """CRC-32C of many pieces of ``data``: lanes of equal length side by side, joined by shifting the states."""
    two, powers = _tables()
    lengths = np.asarray(lengths, dtype=np.int64)
    lanes = -(-lengths // lane)
    ends = np.cumsum(lanes)
    flat = np.zeros(int(ends[-1]) * lane if len(ends) else 0, dtype=np.uint8)
    source = np.frombuffer(data, dtype=np.uint8)
    for s, n, e in zip(np.asarray(starts).tolist(), lengths.tolist(), (ends * lane).tolist()):
        flat[e - n : e] = source[s : s + n]  # zeros in front leave a state of zero
    state = np.zeros(len(flat) // lane, dtype=np.uint32)
    for column in np.ascontiguousarray(flat.view("<u2").reshape(-1, lane // 2).T):
        state = two[(state ^ column) & 0xFFFF] ^ (state >> 16)
    out = np.zeros(len(lengths), dtype=np.uint32)
    for back in range(int(lanes.max(initial=0)), 0, -1):
        has = np.flatnonzero(lanes >= back)
        out[has] = _shift(out[has], powers, lane) ^ state[ends[has] - back]
    first = np.full(len(lengths), 0xFFFFFFFF, dtype=np.uint32)
    for k in range(int(lengths.max(initial=0)).bit_length()):
        has = np.flatnonzero(lengths >> k & 1)
        first[has] = _apply(powers[k], first[has])
    return out ^ first ^ np.uint32(0xFFFFFFFF)


def _shift(state: np.ndarray, powers: np.ndarray, n: int) -> np.ndarray:
    for k in range(n.bit_length()):
        if n >> k & 1:
            state = _apply(powers[k], state)
    return state


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> 15) | (crc << np.uint32(17))) + np.uint32(MASK_DELTA)


def frame(payloads: list[bytes]) -> list[bytes]:
    """Records without their last byte, which Spark's line writer adds."""
    lengths = np.array([len(p) for p in payloads], dtype=np.int64)
    heads = lengths.astype("<u8").tobytes()
    head_sums = masked(crc32c(heads, np.arange(len(payloads)) * 8, np.full(len(payloads), 8), 8)).astype("<u4").tobytes()
    sums = masked(crc32c(b"".join(payloads), np.cumsum(lengths) - lengths, lengths)).astype("<u4").tobytes()
    return [heads[8 * i : 8 * i + 8] + head_sums[4 * i : 4 * i + 4] + p + sums[4 * i : 4 * i + 4] for i, p in enumerate(payloads)]


def walk(data: bytes) -> Iterator[tuple[int, int]]:
    """Offset and payload length of each record of a file."""
    at = 0
    while at < len(data):
        (n,) = struct.unpack_from("<Q", data, at)
        if at + OVERHEAD + n > len(data) or data[at + OVERHEAD + n - 1] != 0x0A:
            raise ValueError(f"broken record at byte {at}")
        yield at, n
        at += OVERHEAD + n


def check(data: bytes, offsets: np.ndarray, lengths: np.ndarray) -> None:
    """Raises at the first record whose checksums do not fit."""
    for what, starts, sizes, lane in (("length", offsets, np.full(len(offsets), 8), 8), ("payload", offsets + HEADER, lengths, LANE)):
        found = masked(crc32c(data, starts, sizes, lane))
        said = np.array([struct.unpack_from("<I", data, s + n)[0] for s, n in zip(starts.tolist(), sizes.tolist())], dtype=np.uint32)
        if (found != said).any():
            raise ValueError(f"checksum of the {what} at byte {offsets[np.flatnonzero(found != said)[0]]}")


# --- Spark jobs -----------------------------------------------------------------------------------------------------


def write_records(
    df: DataFrame, path: str, tokenizer: str, id_column: str = "doc_id", text_column: str = "text", partitions: int | None = None
) -> None:
    """Writes ``path/records`` in ascending id order (null ids first, rows of one id by a hash of their text) and ``path/index``.

    A null text is empty; every document ends with id 0, so an empty one is that id alone. An empty table leaves files
    without records. Other columns are ignored. Ranges of ids are sorted apart, so no task sees more than a range, and a
    text is never more than one cell.
    """
    rows = df.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    if partitions is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        partitions = max(df.sparkSession.sparkContext.defaultParallelism, -(-size // PARTITION_BYTES))
    schema = pa.schema([("record", pa.binary())])

    def encode(batches):
        enc = encoder(tokenizer, KEPT)
        wide = enc.dtype.itemsize == 4
        end = np.array([END_ID], dtype=enc.dtype).tobytes()
        for batch in batches:
            for part in text_slices(batch, most=1_000_000):
                ids = part.column("doc_id").to_pylist()
                found = enc.encode(texts(part.column("text")))
                yield batch_of(schema, frame([struct.pack("<qB", i or 0, (i is None) + 2 * wide) + x.tobytes() + end for i, x in zip(ids, found)]))

    ordered = rows.repartitionByRange(partitions, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    records = ordered.mapInArrow(encode, "record binary").select(F.col("record").cast("string").alias("value"))
    records.write.option("maxRecordsPerFile", RECORDS_PER_FILE).text(f"{path}/records")
    build_index(df.sparkSession, path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """``part, piece`` give a file's place in the order; ``content`` its bytes, at most ``RECORDS_PER_FILE`` records."""
    files = spark.read.format("binaryFile").load(f"{path}/records")
    number = lambda pattern: F.regexp_extract("path", pattern, 1).cast("long")
    return files.select("path", number(r"part-(\d+)").alias("part"), number(r"-c(\d+)\.txt").alias("piece"), "content")


def build_index(spark: SparkSession, path: str) -> None:
    """``path/index``: doc_id, file, offset and bytes of each record, n_tokens, and start, the ids of all records before it."""
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.int64()), ("piece", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("bytes", pa.int64()), ("n_tokens", pa.int64()), ("before", pa.int64())])

    def scan(batches):
        for batch in batches:
            for name, part, piece, content in zip(*(batch.column(c) for c in ("path", "part", "piece", "content"))):
                data, before, rows = content.as_py(), 0, []
                for at, n in walk(data):
                    doc, flags = struct.unpack_from("<qB", data, at + HEADER)
                    tokens = (n - 9) // (4 if flags & 2 else 2)
                    rows.append((None if flags & 1 else doc, part.as_py(), piece.as_py(), name.as_py(), at, n + OVERHEAD, tokens, before))
                    before += tokens
                if rows:
                    yield batch_of(schema, *map(list, zip(*rows)))

    scanned = _files(spark, path).mapInArrow(scan, "doc_id long, part long, piece long, file string, offset long, bytes long, n_tokens long, before long")
    scanned = written(scanned, "index")
    totals = scanned.groupBy("part", "piece").agg(F.sum("n_tokens").alias("n"))
    # one row per file of many records: the only sum that runs over all of them
    starts = totals.withColumn("base", F.sum("n").over(Window.orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, -1))).drop("n")
    index = scanned.join(starts, ["part", "piece"]).withColumn("start", F.coalesce("base", F.lit(0)) + F.col("before"))
    index.drop("base", "before").write.parquet(f"{path}/index")


def read_records(spark: SparkSession, path: str, keep_ids: bool = True) -> DataFrame:
    """Every record, its checksums verified: doc_id, part, piece, offset, n_tokens, ids_crc32 and, if kept, the ids."""
    fields = [(c, pa.int64()) for c in ("doc_id", "part", "piece", "offset", "n_tokens", "ids_crc32")]
    schema = pa.schema([*fields, ("ids", pa.list_(pa.int32()))] if keep_ids else fields)

    def read(batches):
        for batch in batches:
            for part, piece, content in zip(*(batch.column(c) for c in ("part", "piece", "content"))):
                data, part, piece = content.as_py(), part.as_py(), piece.as_py()
                spans = np.array(list(walk(data)), dtype=np.int64).reshape(-1, 2)
                for i in range(0, len(spans), 512):
                    some = spans[i : i + 512]
                    check(data, some[:, 0], some[:, 1])
                    docs, ids = [], []
                    for at, n in some.tolist():
                        doc, flags = struct.unpack_from("<qB", data, at + HEADER)
                        docs.append(None if flags & 1 else doc)
                        kind = np.dtype("<u4" if flags & 2 else "<u2")
                        ids.append(np.frombuffer(data, kind, (n - 9) // kind.itemsize, at + HEADER + 9).astype("<u4"))
                    sizes = [len(x) for x in ids]
                    columns = [docs, [part] * len(docs), [piece] * len(docs), some[:, 0], sizes, [zlib.crc32(x.tobytes()) for x in ids]]
                    if keep_ids:
                        columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(np.concatenate(ids).view(np.int32))))
                    yield batch_of(schema, *columns)

    kinds = "doc_id long, part long, piece long, offset long, n_tokens long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return _files(spark, path).mapInArrow(read, kinds)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """Per record, from the files: doc_id, start, n_tokens, ids_crc32; start by way of the index."""
    index = spark.read.parquet(f"{path}/index").select("part", "piece", "offset", "start")
    return read_records(spark, path, keep_ids=False).join(index, ["part", "piece", "offset"]).select("doc_id", "start", "n_tokens", "ids_crc32")


def read_at(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """doc_id, start and ids of the records of ``wanted.doc_id``, by the index: a file that holds none is not opened on."""
    index = spark.read.parquet(f"{path}/index").join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    spots = index.groupBy("part", "piece").agg(F.collect_list(F.struct("offset", "bytes", "start")).alias("spots"))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def pick(batches):
        for batch in batches:
            for content, spots in zip(batch.column("content"), batch.column("spots").to_pylist()):
                data, rows = content.as_py(), []
                for spot in spots:
                    at, n = spot["offset"], spot["bytes"] - OVERHEAD
                    check(data, np.array([at]), np.array([n]))
                    doc, flags = struct.unpack_from("<qB", data, at + HEADER)
                    kind = np.dtype("<u4" if flags & 2 else "<u2")
                    rows.append((doc, spot["start"], np.frombuffer(data, kind, (n - 9) // kind.itemsize, at + HEADER + 9).tolist()))
                yield batch_of(schema, *map(list, zip(*rows)))

    return _files(spark, path).join(spots, ["part", "piece"]).mapInArrow(pick, "doc_id long, start long, ids array<int>")
