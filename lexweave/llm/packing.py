"""Packing of documents into sequences of a fixed number of tokens by bin completion.

What the search sees is the histogram of piece lengths: one number for each length up to the capacity, whatever the number
of documents. Its answer is a list of fillings, each with the number of sequences filled that way; Spark ranks the pieces of
each length and gives every rank its place.
"""

from __future__ import annotations

import bisect
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from lexweave.llm.common import CHUNK_CACHE, batch_of, drop_encoders, encoder, give_back, text_slices, texts, written

END_ID = 0
CAPACITY = 2048
#: Steps of each search for fillings before the best solution so far is taken.
STEPS = 200_000
#: Pieces of one length that one task ranks.
RANKED = 2_000

Filling = tuple[tuple[int, int], ...]
Solution = list[tuple[Filling, int]]


# --- search ---------------------------------------------------------------------------------------------------------


def bins(solution: Solution) -> int:
    return sum(n for _, n in solution)


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """For each threshold k: pieces over capacity - k stand alone, and those from k on must fit beside the other large ones."""
    sizes = np.array(sorted(counts), dtype=np.int64)
    numbers = np.array([counts[s] for s in sizes.tolist()], dtype=np.int64)
    best = 0
    for k in [0, *sizes[sizes <= capacity // 2].tolist()]:
        alone = numbers[sizes > capacity - k].sum()
        large = (sizes <= capacity - k) & (2 * sizes > capacity)
        small = (2 * sizes <= capacity) & (sizes >= k)
        room = capacity * numbers[large].sum() - (sizes * numbers)[large].sum()
        over = (sizes * numbers)[small].sum() - room
        best = max(best, int(alone + numbers[large].sum() + max(0, -(-int(over) // capacity))))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> Solution:
    """Longest first, each into the fullest sequence with room; sequences that look alike are handled together."""
    rooms: list[int] = []
    at: dict[int, list[tuple[Filling, int]]] = {}

    def put(room: int, filling: Filling, n: int) -> None:
        if n:
            if room not in at:
                bisect.insort(rooms, room)
            at.setdefault(room, []).append((filling, n))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            i = bisect.bisect_left(rooms, length)
            if i < len(rooms):
                room = rooms[i]
                filling, n = at[room].pop()
                if not at[room]:
                    del at[room], rooms[i]
            else:
                room, filling, n = capacity, (), left
            each = room // length
            full = min(n, left // each)
            left -= full * each
            put(room - each * length, (*filling, (length, each)), full)
            some = left if full < n and left < each else 0
            put(room - some * length, (*filling, (length, some)), 1 if some else 0)
            left -= some
            if filling:
                put(room, filling, n - full - bool(some))
    return [x for found in at.values() for x in found]


def _dominated(filling: list[int], slack: int, spare: list[int]) -> bool:
    """Whether a piece left out could take the place of some pieces of less length, or of none."""
    sums = 1
    for length in filling:
        sums |= sums << length
    for x in spare:
        low = max(0, x - slack)
        if sums >> low & (1 << (x - low)) - 1:
            return True
    return False


def _fillings(counts: dict[int, int], longest: int, room: int, least: int, steps: list[int]) -> Iterator[list[int]]:
    """Undominated fillings of ``room`` beside one piece ``longest``, the fullest first, of one sum the longest pieces first.

    ``counts`` is the search's own, which stands as it stood whenever the next filling is asked for; ``steps[0]`` counts down.
    """
    have = lambda s: counts[s] - (s == longest)
    sizes = array("H" if room < 1 << 16 else "Q", [s for s in sorted(counts, reverse=True) if s <= room and have(s)])
    sums = 1
    for s in sizes:
        grown = sums
        for _ in range(min(have(s), room // s)):
            grown |= sums << s
            sums, before = grown, sums
            if sums == before:
                break
        sums &= (1 << (room + 1)) - 1

    def exact(total: int, first: int, used: list[int]) -> Iterator[list[int]]:
        if not total:
            yield used
            return
        for i in range(first, len(sizes)):
            s = sizes[i]
            if s > total or not sums >> (total - s) & 1:
                continue
            steps[0] -= 1
            if steps[0] < 0:
                return
            if used.count(s) < have(s):
                yield from exact(total - s, i, [*used, s])

    for total in range(room, max(0, least) - 1, -1):
        if sums >> total & 1:
            for filling in exact(total, 0, []):
                spare = [s for s in sizes if have(s) > filling.count(s)]
                if not _dominated(filling, room - total, spare):
                    yield list(filling)
        if steps[0] < 0:
            return


def solve(counts: dict[int, int], capacity: int = CAPACITY, steps: int = STEPS) -> Solution:
    """Bin completion: fill around the longest piece left, branch over fillings, cut branches by the waste they allow.

    Two searches, whatever the number of pieces: one repeats each filling as often as it fits, the other has each smaller
    number of repeats as a branch too. The best-fit solution is the first incumbent. Exact if the second search ends within
    ``steps``; otherwise never worse than best fit.
    """
    counts = {s: n for s, n in counts.items() if n}
    if any(s > capacity or s < 1 for s in counts):
        raise ValueError("a piece must have from 1 token to the capacity")
    best = best_fit(counts, capacity)
    bound = lower_bound(counts, capacity)
    for fewer in (False, True):
        if bins(best) > bound:
            best = _search(dict(counts), capacity, steps, best, bound, fewer)
    return best


def _search(counts: dict[int, int], capacity: int, steps: int, best: Solution, bound: int, fewer: bool) -> Solution:
    """The better of ``best`` and what is found; without ``fewer`` only with each filling repeated as often as it fits."""
    budget, total = [steps], sum(s * n for s, n in counts.items())
    stack: list[Iterator[Filling]] = []
    taken: Solution = []
    left, used = total, 0
    skipped: Filling | None = None  # repeating it once more is the branch before

    def apply(filling: Filling, n: int) -> None:
        nonlocal left, used
        for s, k in filling:
            counts[s] -= n * k
        left, used = left - n * sum(s * k for s, k in filling), used + n

    def following(fillings: Iterator[list[int]], longest: int, skip: Filling | None = None) -> Iterator[Filling]:
        for found in fillings:
            uses: dict[int, int] = {}
            for s in (longest, *found):
                uses[s] = uses.get(s, 0) + 1
            if tuple(uses.items()) != skip:
                yield tuple(uses.items())

    while budget[0] >= 0:
        if left == 0 and used < bins(best):
            best = list(taken)
            if used == bound:
                break
        waste = (bins(best) - 1) * capacity - total - (used * capacity - (total - left))  # what a better solution may still waste
        filling = None
        if left and waste >= 0:
            longest = max(s for s, n in counts.items() if n)
            room = capacity - longest
            stack.append(following(_fillings(counts, longest, room, room - waste, budget), longest, skipped))
            filling = next(stack[-1], None)
        skipped = None
        while filling is None:
            if len(stack) > len(taken):  # no filling left here
                stack.pop()
            if not taken:
                return best
            before, n = taken.pop()
            apply(before, -n)
            if fewer and n > 1:
                budget[0] -= 1
                apply(before, n - 1)
                taken.append((before, n - 1))
                skipped = before
                break
            filling = next(stack[-1], None)
        if filling is not None:
            n = min(counts[s] // k for s, k in filling)
            apply(filling, n)
            taken.append((filling, n))
    return best


class Places:
    """For each length, which ranks go to which sequence and offset; its size follows the number of fillings."""

    def __init__(self, solution: Solution):
        rows, sequence, ranks = [], 0, {}
        for filling, n in solution:
            offset = 0
            for length, k in filling:
                rank = ranks.get(length, 0)
                rows.append((length, rank, sequence, k, offset))
                ranks[length] = rank + n * k
                offset += length * k
            sequence += n
        rows.sort()
        self.length, self.rank, self.sequence, self.each, self.offset = np.array(rows, dtype=np.int64).reshape(-1, 5).T

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.searchsorted((self.length << 44) | self.rank, (length << 44) | rank, side="right") - 1
        nth = rank - self.rank[i]
        return self.sequence[i] + nth // self.each[i], self.offset[i] + nth % self.each[i] * length


# --- Spark jobs -----------------------------------------------------------------------------------------------------


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of a document of ``n`` tokens: full ones, after a shorter first one if need be."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(
    df: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_column: str = "doc_id", text_column: str = "text", keep_ids: bool = False,
    kept: int = CHUNK_CACHE,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document, and with ``keep_ids`` its ids.

    A worker keeps the ids of about ``kept`` pieces of text and as many older ones: fewer take less memory and more time.
    """
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema([*fields, ("ids", pa.list_(pa.int32()))] if keep_ids else fields)

    def split(batches):
        enc = encoder(tokenizer, kept)
        for batch in batches:
            give_back()
            for part in text_slices(batch, most=1_000_000):
                rows = []
                for doc, ids in zip(part.column("doc_id").to_pylist(), enc.encode(texts(part.column("text")))):
                    ids = np.append(ids, np.array([END_ID], dtype=ids.dtype)).astype("<u4")
                    for i, (start, n) in enumerate(cut(len(ids), capacity)):
                        piece = ids[start : start + n]
                        rows.append((doc, i, start, n, zlib.crc32(piece.tobytes()), *([piece.astype(np.int32)] if keep_ids else [])))
                yield batch_of(schema, *map(list, zip(*rows)))

    rows = df.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return rows.mapInArrow(split, kinds)


def pack(df: DataFrame, tokenizer: str, capacity: int = CAPACITY, keep_ids: bool = False, kept: int = CHUNK_CACHE, **columns: str) -> DataFrame:
    """The pieces of all documents with sequence_id and offset, in as few sequences as the search finds.

    A null text is empty: id 0 alone. Repeated rows are packed as often as they occur; a null id stays null; other columns
    are ignored; an empty table gives no row.
    """
    spark = df.sparkSession
    all_pieces = pieces(df, tokenizer, capacity, keep_ids=keep_ids, kept=kept, **columns)
    rows = written(all_pieces.withColumn("_n", F.monotonically_increasing_id()), "pieces")
    histogram = {r.length: r.n for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each length up to the capacity
    places = Places(solve(histogram, capacity))
    parts = spark.createDataFrame([(s, -(-n // RANKED)) for s, n in histogram.items()], "length long, _parts long")
    dealt = rows.join(F.broadcast(parts), "length").withColumn("_part", F.pmod(F.xxhash64("_n"), "_parts")).drop("_parts")
    sums = dealt.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("length", "_part", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_base"))
    nth = F.row_number().over(Window.partitionBy("length", "_part").orderBy("_n")) - 1
    ranked = dealt.withColumn("_rank", nth).join(sums, ["length", "_part"]).withColumn("_rank", F.col("_rank") + F.col("_base"))
    names = [*all_pieces.columns, "_rank"]
    schema = T.StructType([*all_pieces.schema, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches):
        drop_encoders()
        for batch in batches:
            found = places.find(*(batch.column(c).to_numpy() for c in ("length", "_rank")))
            kept = [batch.column(c) for c in names[:-1]]
            yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, found)], names=[*names[:-1], "sequence_id", "offset"])

    return ranked.select(*names).mapInArrow(place, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """The token sequences themselves: sequence_id, ids, and the doc_ids in their order; needs ``pack(keep_ids=True)``."""
    inside = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    grouped = packed.groupBy("sequence_id").agg(inside.alias("_p"))
    return grouped.select("sequence_id", F.flatten("_p.ids").alias("ids"), F.col("_p.doc_id").alias("doc_ids"))
