"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are windows of consecutive words of the benchmark items. Their last words form a block; a shift table tells for a
block under the scan how many words no window can end, a block that ends a window opens the bucket of its hash, and the
windows there are compared word by word. All lanes of a batch, equal stretches of the documents, move at once.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lexweave.llm.common import batch_of, drop_encoders, free_name, text_slices

WINDOW = 10
#: Bytes of benchmark text that one pass holds; a larger benchmark takes more passes over the documents.
BLOCK_BYTES = 32 << 20
#: Words of a lane: each is scanned on its own, with the words before that a window may reach back to.
LANE = 256
#: Candidate windows compared at once.
COMPARED = 100_000

_KEEP = set(range(0x30, 0x3A)) | set(range(0x41, 0x5B)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
WORD_BYTES = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if b in _KEEP else 0x20 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of all other characters beyond ASCII, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


@dataclass
class Tables:
    """Windows of one length: shift table by block, windows in order of their last block, where each bucket begins."""

    length: int
    block: int
    shift: np.ndarray
    windows: np.ndarray
    last: np.ndarray
    number: np.ndarray

    @classmethod
    def build(cls, windows: np.ndarray, number: np.ndarray) -> Tables:
        length = windows.shape[1]
        block = min(length, 2)
        size = 1 << max(12, int(4 * len(windows) * length).bit_length())
        shift = np.full(size, length - block + 1, dtype=np.int16)
        for end in range(block, length + 1):  # a block that ends here lets the window end so many words later
            np.minimum.at(shift, _slots(_hash(windows[:, end - block : end]), size), length - end)
        last = _hash(windows[:, length - block :])
        order = np.argsort(last, kind="stable")
        return cls(length, block, shift, windows[order], last[order], number[order])


def _hash(blocks: np.ndarray) -> np.ndarray:
    out = np.zeros(blocks.shape[0], dtype=np.uint64)
    for k in range(blocks.shape[1]):
        out = (out ^ blocks[:, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def _slots(hashes: np.ndarray, size: int) -> np.ndarray:
    return (hashes & np.uint64(size - 1)).astype(np.int64)


class Patterns:
    """The windows of some benchmark items, ready to be sought; it goes to the tasks as one broadcast."""

    def __init__(self, items: list[tuple[int, str | None]], window: int = WINDOW):
        self.window = window
        self.ids: dict[bytes, int] = {}
        found: dict[int, dict[tuple[int, ...], int]] = {}
        members: list[set[int]] = []
        self.items = sorted({i for i, _ in items if i is not None})
        place = {i: k for k, i in enumerate(self.items)}
        for item, text in items:
            if item is None:
                continue
            codes = [self.ids.setdefault(w, len(self.ids) + 1) for w in words(text)]
            length = min(window, len(codes))
            for k in range(len(codes) - length + 1) if codes else ():
                known = found.setdefault(length, {})
                n = known.setdefault(tuple(codes[k : k + length]), len(members))
                if n == len(members):
                    members.append(set())
                members[n].add(place[item])
        self.members = [np.array(sorted(m)) for m in members]
        self.tables = [Tables.build(np.array(list(w), dtype=np.int32).reshape(-1, n), np.array(list(w.values()))) for n, w in sorted(found.items())]

    def search(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """Occurrences in the documents codes[start:end]: first word, length and number of the window."""
        for t in self.tables:
            lanes = [(np.arange(s + t.length, e + 1, LANE), e) for s, e in zip(starts.tolist(), ends.tolist()) if e - s >= t.length]
            if not lanes:
                continue
            at = np.concatenate([a for a, _ in lanes])  # where a window would end
            stop = np.minimum(at + LANE, np.repeat([e + 1 for _, e in lanes], [len(a) for a, _ in lanes]))
            while len(at):
                blocks = np.stack([codes[at - t.block + k] for k in range(t.block)], axis=1)
                hashes = _hash(blocks)
                shift = t.shift[_slots(hashes, len(t.shift))]
                hit = np.flatnonzero(shift == 0)
                if len(hit):
                    yield from self._compare(t, codes, at[hit], hashes[hit])
                at = at + np.maximum(shift, 1)
                on = at < stop
                at, stop = at[on], stop[on]

    @staticmethod
    def _compare(t: Tables, codes: np.ndarray, at: np.ndarray, hashes: np.ndarray):
        low, high = np.searchsorted(t.last, hashes, side="left"), np.searchsorted(t.last, hashes, side="right")
        ends = np.cumsum(high - low)
        first = 0
        while first < len(at):
            upto = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + COMPARED, side="right")))
            sizes = (high - low)[first:upto]
            end = np.repeat(at[first:upto], sizes)
            window = np.arange(len(end)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(low[first:upto], sizes)
            for k in range(t.length):  # most differ at the first words
                same = codes[end - t.length + k] == t.windows[window, k]
                end, window = end[same], window[same]
            if len(end):
                yield end - t.length, t.length, t.number[window]
            first = upto

    def hits(self, texts: list[str | None], kept: list) -> list[dict]:
        """Per text: n_words, spans of hit words as flat [first, end, ...], and item ids; spans and items join those kept."""
        found = [words(x) for x in texts]
        sizes = np.array([len(w) for w in found], dtype=np.int64)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        codes = np.fromiter((c for w in found for c in map(self.ids.get, w, repeat(0))), dtype=np.int32, count=int(sizes.sum()))
        marks = np.zeros(len(codes) + 1, dtype=np.int64)
        items: dict[int, set[int]] = {}
        for first, length, number in self.search(codes, starts, ends):
            np.add.at(marks, first, 1)
            np.add.at(marks, first + length, -1)
            doc = np.searchsorted(ends, first, side="right")
            for d, n in set(zip(doc.tolist(), number.tolist())):
                items.setdefault(d, set()).update(self.members[n].tolist())
        out = []
        covered = np.cumsum(marks[:-1]) > 0
        for i, (s, e) in enumerate(zip(starts.tolist(), ends.tolist())):
            hit = covered[s:e].copy()
            old = kept[i] or {"spans": [], "items": []}
            for a, b in zip(old["spans"][::2], old["spans"][1::2]):
                hit[a:b] = True
            edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
            named = {self.items[k] for k in items.get(i, ())} | set(old["items"])
            out.append({"n_words": e - s, "spans": edges.tolist(), "items": sorted(named, key=str)})
        return out


FOUND = "struct<n_words:bigint,spans:array<bigint>,items:array<bigint>>"
_FOUND = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.int64()))])


def _blocks(benchmark: DataFrame, id_column: str, text_column: str, most: int):
    """Parts of the benchmark of at most about ``most`` bytes, one after another; the driver holds one at a time."""
    rows = benchmark.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-size // most) or 1
    for k in range(parts):
        yield [(r.id, r.text) for r in rows.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == k).collect()]


def find(
    df: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_column: str = "text", item_column: str = "item_id",
    item_text: str = "text", block_bytes: int = BLOCK_BYTES, found_column: str = "found",
) -> DataFrame:
    """``df`` with ``found``: n_words, spans (first and end of each run of hit words) and the ids of items that occur.

    An item of fewer than ``window`` words is one window; one without words, a null text or a null id is never found. A
    null text has no words. Items may repeat. An existing column ``found_column`` is replaced; all others stay.
    """
    names = [c for c in df.columns if c != found_column]
    rows = df.select(*names, F.lit(None).cast(FOUND).alias(found_column))
    context = df.sparkSession.sparkContext
    for items in _blocks(benchmark, item_column, item_text, block_bytes):
        patterns = context.broadcast(Patterns(items, window))

        def run(batches, patterns=patterns):
            drop_encoders()
            for batch in batches:
                for part in text_slices(batch, text_column):
                    found = patterns.value.hits(part.column(text_column).to_pylist(), part.column(found_column).to_pylist())
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(found, _FOUND)], names=[*names, found_column])

        rows = rows.mapInArrow(run, rows.schema)
    return rows


def n_hit(found: str = "found"):
    """Number of hit words, from the spans."""
    edges = F.col(f"{found}.spans")
    return F.aggregate(edges, F.lit(0).cast("long"), lambda acc, x: x - acc)


def digests(found: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of a table with ``found``."""
    named = F.array_join(F.transform("found.items", lambda x: x.cast("string")), ",")
    return found.select(
        F.col(id_column).alias("doc_id"), F.col("found.n_words").alias("n_words"), n_hit().alias("n_hit"),
        F.size("found.items").cast("long").alias("n_items"), F.sha2(named, 256).alias("items_sha256"), (F.size("found.spans") > 0).alias("contaminated"),
    )


def clean(df: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Only documents in which no window occurs, with their own columns."""
    found = free_name(df, "_found")
    return find(df, benchmark, found_column=found, **options).where(F.size(f"{found}.spans") == 0).drop(found)
