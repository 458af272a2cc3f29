"""Shared helpers: written intermediate tables, the tokenizer inside tasks, Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from array import array
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Pieces of text whose ids one Python worker keeps, and as many older ones.
CHUNK_CACHE = 400_000


_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; only a local session may do without it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _LOCAL:
        _LOCAL[context.applicationId] = tempfile.mkdtemp(prefix="lexweave-")
    return _LOCAL[context.applicationId]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read back: its lineage is cut, and a lost executor takes nothing along."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a few numbers each that are broadcast at most, some 50 MB; beyond, the join shuffles.
BROADCAST_ROWS = 2_000_000


def small(table: DataFrame) -> DataFrame:
    """A written table of ids and hashes, broadcast if it has at most ``BROADCAST_ROWS`` rows."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores a name that no column of ``df`` has, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def texts(column: pa.Array) -> list[str]:
    """Strings of an Arrow column; null is the empty text."""
    return ["" if x is None else x for x in column.to_pylist()]


def slices(items: Sequence, size: int) -> Iterator[Sequence]:
    for i in range(0, len(items), size):
        yield items[i : i + size]


def text_slices(batch: pa.RecordBatch, column: str = "text", most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most about ``most`` bytes of text each, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


# --- tokenizer ------------------------------------------------------------------------------------------------------


class Encoder:
    """Ids of whole texts by a file of the tokenizers library, a byte-level one whose words begin with their space.

    The library's splitting of such files never joins what stands before a single space or newline with what follows it.
    A text is therefore cut there, and the library encodes every distinct piece once per worker. A text in which white
    space meets white space, or which begins or ends with it, goes to the library whole.
    """

    def __init__(self, path: str, kept: int = CHUNK_CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.kept = kept
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.firsts: dict[str, bytes] = {}
        self.marks = dict(zip(",.", self._raw([",", "."])))
        vocabulary = self.tokenizer.get_vocab()  # written with one letter a byte, space and newline as these two
        self.begins = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.begins[[i for token, i in vocabulary.items() if token[:1] in ("\u0120", "\u010a")]] = True

    def _raw(self, texts: list[str]) -> list[bytes]:
        code = "H" if self.dtype.itemsize == 2 else "I"
        return [array(code, x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def _plain(piece: str) -> bool:
        body = piece[1:] if piece[:1] == "\n" else piece
        return bool(body) and not body[0].isspace() and not body[-1].isspace()

    def _joined(self, pieces: list[str]) -> Iterator[bytes]:
        """Ids of plain pieces, each with its space or newline in front, many encoded as one text.

        Only the first byte of a piece is a space or newline, so its first id is the only one that begins with such a byte.
        """
        size = self.dtype.itemsize
        groups = list(slices(pieces, 512))
        for some in slices(groups, 16):
            for group, found in zip(some, self.tokenizer.encode_batch_fast(["".join(g) for g in some], add_special_tokens=False)):
                ids = np.array(found.ids, dtype=self.dtype)
                at = np.flatnonzero(self.begins[ids])
                if len(at) != len(group):  # the library has split otherwise: one by one
                    yield from self._raw(group)
                    continue
                raw, ends = ids.tobytes(), [*(at * size).tolist(), len(ids) * size]
                yield from (raw[i:j] for i, j in zip(ends, ends[1:]))

    def _learn(self, cache: dict[str, bytes], new: Iterable[str], lead: str) -> None:
        """Pieces that aren't plain get no ids: ``b""``, which no piece of a text has."""
        plain = []
        for p in new:
            if p[:-1].isalpha() and p[-1] in ",." and p[:-1] in cache:  # a letter and a mark are never one token
                cache[p] = cache[p[:-1]] + self.marks[p[-1]]
            elif self._plain(p):
                plain.append(p)
            else:
                cache[p] = b""
        led = [p if p[0] == "\n" else lead + p for p in plain]
        cache.update(zip(plain, self._joined(led) if lead else self._raw(led)))

    def encode(self, texts: Iterable[str]) -> list[np.ndarray]:
        gc.disable()  # nothing here is cyclic, and a collection would go through all pieces kept
        try:
            return self._encode(texts)
        finally:
            gc.enable()

    def _encode(self, texts: Iterable[str]) -> list[np.ndarray]:
        if len(self.pieces) > self.kept:  # pieces that are met again move over from the older half
            self.older, self.pieces = self.pieces, {}
        if len(self.firsts) > self.kept:
            self.firsts.clear()
        out: list = []
        later, whole, firsts, rest = [], [], set(), set()
        for text in texts:
            parts = text.replace("\n", " \n").split(" ")
            found = list(map(self.pieces.get, parts))
            found[0] = self.firsts.get(parts[0])
            if None in found:
                missing = [i for i, ids in enumerate(found) if ids is None]
                firsts.add(parts[0])
                rest.update([parts[i] for i in missing if i])
                later.append((len(out), text, parts, found, missing))
                out.append(None)
            elif b"" in found:
                whole.append((len(out), text))
                out.append(None)
            else:
                out.append(b"".join(found))
        again = {p: ids for p in rest if (ids := self.older.get(p)) is not None}
        self.pieces.update(again)
        self._learn(self.pieces, [p for p in rest if p not in again], " ")
        self._learn(self.firsts, [p for p in firsts if p not in self.firsts], "")
        for i, text, parts, found, missing in later:
            for k in missing:
                found[k] = self.pieces[parts[k]] if k else self.firsts[parts[0]]
            if b"" in found:
                whole.append((i, text))
            else:
                out[i] = b"".join(found)
        for (i, _), ids in zip(whole, self._raw([text for _, text in whole])):
            out[i] = ids
        return [np.frombuffer(x, dtype=self.dtype) for x in out]


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, kept: int = CHUNK_CACHE) -> Encoder:
    """The worker's own encoder for a file, which keeps about ``kept`` pieces and as many older ones."""
    if (path, kept) not in _ENCODERS:
        drop_encoders()
        _ENCODERS[path, kept] = Encoder(path, kept)
    return _ENCODERS[path, kept]


def drop_encoders() -> None:
    """Gives back what a worker holds of earlier work, kept pieces and freed memory, before it goes on to other work."""
    if _ENCODERS:
        _ENCODERS.clear()
        gc.collect()
    give_back()


def give_back() -> None:
    """Returns freed memory to the system, which Arrow and the C library else hold for as long as the worker lives."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only the GNU library has it
    if trim:
        trim(0)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def whole_groups(batches: Iterable[pa.RecordBatch], key: str, rows: int) -> Iterator[pa.Table]:
    """Tables of at least ``rows`` rows, if there are so many, that never cut a group; batches come sorted by ``key``."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        keys = table.column(key).to_numpy()
        whole = int(np.searchsorted(keys, keys[-1]))  # the last group may go on in the next batch
        if whole:
            yield table.slice(0, whole)
        held, n = table.slice(whole).to_batches(), n - whole
    if held:
        yield pa.Table.from_batches(held)
