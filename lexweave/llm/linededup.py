"""Line dedup by pairwise alignment: a block of lines that an earlier document has is deleted from the later one.

Lines are compared by a hash of their words. The shortest runs of lines with enough words, from each line on and back from
each line, propose the partners: the first document that has such a run is aligned with every later one. A run is rare as
single short lines are not, and pairs grow with the lines, never with the square of a group; yet every line of a common
block lies in such a run. A pair is aligned by patience diff: the rarest common lines, as a rule those that occur once on
either side, are the anchors, and common starts and ends of the stretches between them follow.
"""

from __future__ import annotations

import struct
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from lexweave.llm.common import batch_of, drop_encoders, free_name, text_slices, written

#: Words of the shortest block that is deleted.
BLOCK_WORDS = 10
#: Documents that make a line of fewer words boilerplate.
FREQUENT = 25


# --- alignment ------------------------------------------------------------------------------------------------------


def _anchors(a: list[int], b: list[int], a0: int, a1: int, b0: int, b1: int) -> list[tuple[int, int]]:
    """The longest chain, increasing on both sides, of the rarest common lines of a[a0:a1] and b[b0:b1]."""
    times_a, times_b = Counter(a[a0:a1]), Counter(b[b0:b1])
    times = {h: max(n, times_b[h]) for h, n in times_a.items() if h in times_b}
    rarest = min(times.values(), default=0)
    at_a, at_b = ({h: k for k, h in reversed(list(enumerate(x, start)))} for x, start in ((a[a0:a1], a0), (b[b0:b1], b0)))
    both = sorted((at_a[h], at_b[h]) for h, n in times.items() if n == rarest)
    tops: list[int] = []
    last: list[int] = []
    before: list[int] = []
    for n, (_, j) in enumerate(both):
        k = bisect_left(tops, j)
        before.append(last[k - 1] if k else -1)
        tops[k : k + 1], last[k : k + 1] = [j], [n]
    chain, n = [], last[-1] if last else -1
    while n >= 0:
        chain.append(both[n])
        n = before[n]
    return chain[::-1]


def align(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Pairs of places with equal lines, increasing on both sides."""
    out, open_ = [], [(0, len(a), 0, len(b))]
    while open_:
        a0, a1, b0, b1 = open_.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 < a1 and b0 < b1:
            chain = _anchors(a, b, a0, a1, b0, b1)
            out += chain
            edges = [(a0 - 1, b0 - 1), *chain, (a1, b1)]
            if chain:
                open_ += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:]) if i + 1 < k and j + 1 < m]
    return sorted(out)


def common_blocks(later: list[tuple[int, int, int]], earlier: list[tuple[int, int]], least: int = BLOCK_WORDS) -> set[int]:
    """Places of the later document in blocks of at least ``least`` words that the earlier one has as well.

    ``later`` has place, hash and words of its shared lines, ``earlier`` place and hash; places count lines that aren't
    blank. What is found is set aside and the rest of the later document aligned again: a block that moved or that is
    repeated is found too. Lines left over are looked at one by one, as an alignment keeps an order and blocks may overlap.
    """
    words, gone, left = {p: n for p, _, n in later}, set(), later
    while left and earlier:
        blocks: list[list[tuple[int, int]]] = []
        for i, j in align([x[1] for x in left], [x[1] for x in earlier]):
            pair = left[i][0], earlier[j][0]
            if blocks and blocks[-1][-1] == (pair[0] - 1, pair[1] - 1):
                blocks[-1].append(pair)
            else:
                blocks.append([pair])
        found = {p for b in blocks if sum(words[p] for p, _ in b) >= least for p, _ in b}
        if not found:
            break
        gone |= found
        left = [x for x in left if x[0] not in gone]
    here, there, places = {p: h for p, h, _ in later}, dict(earlier), {}
    for q, h in earlier:
        places.setdefault(h, []).append(q)
    for p, h, _ in left:
        for q in places.get(h, ()):
            first, last = 0, 0
            while p + first - 1 in here and here[p + first - 1] == there.get(q + first - 1):
                first -= 1
            while p + last + 1 in here and here[p + last + 1] == there.get(q + last + 1):
                last += 1
            if sum(words[x] for x in range(p + first, p + last + 1)) >= least:
                gone.add(p)
                break
    return gone


# --- Spark jobs -----------------------------------------------------------------------------------------------------


def line_hashes(text: str) -> tuple[list[int], list[int], list[int]]:
    """Number, hash and words of each line that isn't blank; white space between and around words does not count."""
    numbers, hashes, sizes = [], [], []
    for n, line in enumerate(text.encode("utf-8", "surrogatepass").split(b"\n")):
        if found := line.split():
            numbers.append(n)
            hashes.append(xxhash.xxh64_intdigest(b" ".join(found)) - (1 << 63))
            sizes.append(len(found))
    return numbers, hashes, sizes


def runs(sizes: list[int], least: int) -> list[tuple[int, int]]:
    """First and last line of the shortest runs of at least ``least`` words from each line on, and back from each line."""
    out, total, first = set(), 0, 0
    for last, n in enumerate(sizes):
        total += n
        while total - sizes[first] >= least:  # the shortest run that ends here
            total -= sizes[first]
            first += 1
        if total >= least:
            out.add((first, last))
    total, last = 0, len(sizes) - 1
    for first in range(len(sizes) - 1, -1, -1):
        total += sizes[first]
        while total - sizes[last] >= least:
            total -= sizes[last]
            last -= 1
        if total >= least:
            out.add((first, last))
    return sorted(out)


_LINE = "array<struct<place:int,h:bigint,words:int,number:int>>"


def _runs(rows: DataFrame, least: int) -> DataFrame:
    """One row per run: doc, text_hash, key and its lines."""
    line = pa.struct([("place", pa.int32()), ("h", pa.int64()), ("words", pa.int32()), ("number", pa.int32())])
    schema = pa.schema([("doc", pa.int64()), ("text_hash", pa.int64()), ("key", pa.int64()), ("lines", pa.list_(line))])

    def run(batches):
        drop_encoders()
        for batch in batches:
            for part in text_slices(batch):
                docs, hashes_, keys, places, h, words, numbers, ends = [], [], [], [], [], [], [], [0]
                for doc, text_hash, text in zip(*(part.column(c).to_pylist() for c in ("doc", "text_hash", "text"))):
                    number, hashes, sizes = line_hashes(text)
                    for first, last in runs(sizes, least):
                        some = hashes[first : last + 1]
                        docs.append(doc)
                        hashes_.append(text_hash)
                        keys.append(some[0] if first == last else xxhash.xxh64_intdigest(struct.pack(f"<{len(some)}q", *some)) - (1 << 63))
                        places += range(first, last + 1)
                        h += some
                        words += sizes[first : last + 1]
                        numbers += number[first : last + 1]
                        ends.append(len(h))
                inner = pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip((places, h, words, numbers), line)], fields=list(line))
                yield batch_of(schema, docs, hashes_, keys, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), inner))

    return rows.mapInArrow(run, f"doc long, text_hash long, key long, lines {_LINE}")


def frequent_lines(rows: DataFrame, least: int, often: int) -> DataFrame:
    """``doc, text_hash, numbers``: lines of under ``least`` words that ``often`` documents or more have, in all but the first."""
    schema = pa.schema([("doc", pa.int64()), ("text_hash", pa.int64()), ("h", pa.int64()), ("number", pa.int32())])

    def run(batches):
        for batch in batches:
            for part in text_slices(batch):
                out = []
                for doc, text_hash, text in zip(*(part.column(c).to_pylist() for c in ("doc", "text_hash", "text"))):
                    out += [(doc, text_hash, h, number) for number, h, n in zip(*line_hashes(text)) if n < least]
                if out:
                    yield batch_of(schema, *map(list, zip(*out)))

    lines = written(rows.mapInArrow(run, "doc long, text_hash long, h long, number int"), "short-lines")
    spread = lines.select("h", "doc").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("first"))
    found = written(spread.where(F.col("n") >= often).select("h", "first"), "frequent-lines")
    later = lines.join(found, "h").where("doc > first")  # of two written tables: Spark splits the rows of a very common line
    return later.groupBy("doc", "text_hash").agg(F.collect_set("number").alias("numbers"))


def deletions(rows: DataFrame, least: int = BLOCK_WORDS, often: int = FREQUENT) -> DataFrame:
    """``doc, text_hash, numbers``: lines to delete, of ``rows(doc, text_hash, text)``; documents that lose none are absent.

    Documents come in the order of their ids; rows of one id are never aligned with each other, and a null id with nothing.
    """
    rows = rows.where("doc IS NOT NULL AND text IS NOT NULL")
    found = written(_runs(rows, least), "runs")
    spread = found.groupBy("key").agg(F.min("doc").alias("first"), F.max("doc").alias("final")).where("first < final").select("key", "first")
    shared = found.join(spread, "key")
    lines = F.array_sort(F.array_distinct(F.flatten(F.collect_list("lines"))))
    per_doc = written(shared.groupBy("doc", "text_hash").agg(lines.alias("lines"), F.collect_set("first").alias("firsts")), "shared-lines")
    later = per_doc.select("doc", "text_hash", "lines", F.explode(F.filter("firsts", lambda x: x < F.col("doc"))).alias("partner"))
    later = later.select("doc", "text_hash", "partner", "lines.place", "lines.h", "lines.words", "lines.number")
    # a document may be the partner of very many: an equi-join, whose large keys Spark splits
    earlier = per_doc.select(F.col("doc").alias("partner"), F.col("lines.place").alias("place2"), F.col("lines.h").alias("h2"))
    pairs = later.join(earlier, "partner")
    schema = pa.schema([("doc", pa.int64()), ("text_hash", pa.int64()), ("numbers", pa.list_(pa.int32()))])

    def run(batches):
        for batch in batches:
            out = []
            columns = (batch.column(c).to_pylist() for c in ("doc", "text_hash", "place", "h", "words", "number", "place2", "h2"))
            for doc, key, place, h, words, number, place2, h2 in zip(*columns):
                gone = common_blocks(list(zip(place, h, words)), list(zip(place2, h2)), least)
                if gone:
                    out.append((doc, key, [n for p, n in zip(place, number) if p in gone]))
            if out:
                yield batch_of(schema, *map(list, zip(*out)))

    gone = pairs.mapInArrow(run, "doc long, text_hash long, numbers array<int>").union(frequent_lines(rows, least, often))
    return gone.groupBy("doc", "text_hash").agg(F.array_distinct(F.flatten(F.collect_list("numbers"))).alias("numbers"))


def dedup_lines(
    df: DataFrame, least: int = BLOCK_WORDS, id_column: str = "doc_id", text_column: str = "text", often: int = FREQUENT, removed_column: str = "_removed"
) -> DataFrame:
    """All rows and columns, the text without the lines deleted, and ``removed_column``, their numbers from 0 (null: none).

    A null or empty text stays as it is. Blank lines stay unless all other lines of a document go; then the text is empty.
    Other columns may have any names but that of ``removed_column``.
    """
    if free_name(df, removed_column) != removed_column:
        raise ValueError(f"there is a column {removed_column} already: name another removed_column")
    source = df.select(F.struct("*").alias("row"), F.col(id_column).cast("long").alias("doc"), F.xxhash64(text_column).alias("text_hash"), F.col(text_column).alias("text"))
    gone = deletions(source.select("doc", "text_hash", "text"), least, often)
    lines = F.split(F.col("text"), "\n", -1)
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "numbers"), lambda i: F.get(lines, i))
    left = F.array_join(kept, "\n")
    blank = F.trim(F.regexp_replace(left, r"\s+", " ")) == ""
    text = F.when(F.col("numbers").isNull(), F.col("text")).otherwise(F.when(blank, F.lit("")).otherwise(left))
    columns = [text.alias(c) if c == text_column else F.col("row").getField(c).alias(c) for c in df.columns]
    return source.join(gone, ["doc", "text_hash"], "left").select(*columns, F.col("numbers").alias(removed_column))
