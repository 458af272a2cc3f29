"""Ranked lexical search, reversed: the queries' terms are the index, and the documents stream through it.

The inverted index over the items' terms is broadcast. A first pass over the documents counts, per document, its terms and the
occurrences of indexed ones, and writes these short rows; from them come the statistics of the whole corpus. A second pass
streams the counts through the index: every task keeps, per item, the best documents it has met, and hands on no more than
those. The heaps of all tasks are merged by a ranking per item.
"""

from __future__ import annotations

import math
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lexweave.llm.common import batch_of, text_slices, written
from lexweave.llm.decontam import words

BEST = 10
#: Bytes of item texts, and items, of one broadcast index; more items take more passes over the documents.
INDEX_BYTES, INDEX_ITEMS = 8 << 20, 50_000
#: Scores that a task holds at once.
CELLS = 2_000_000
#: A term that at least one item of so many has is added by a matrix product.
COMMON = 64
NO_ID = np.iinfo(np.int64).max


class Index:
    """Term numbers, and per term the items that have it and how often."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        self.item_ids = [i for i, _ in items]
        self.terms: dict[bytes, int] = {}
        entries: dict[tuple[int, int], int] = {}
        sizes = [0]
        for k, (_, text) in enumerate(items):
            found = words(text)
            sizes.append(len(found))
            for w in found:
                at = self.terms.setdefault(w, len(self.terms)), k
                entries[at] = entries.get(at, 0) + 1
        self.longest = max(sizes)
        order = sorted(entries)
        self.term, self.item = np.array(order, dtype=np.int64).reshape(-1, 2).T
        self.times = np.array([entries[x] for x in order], dtype=np.int64)
        self.starts = np.searchsorted(self.term, np.arange(len(self.terms) + 1))

    def counts(self, texts: list[str | None]) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
        """Terms of each text; text, term and occurrences of each indexed term, in this order."""
        found = [words(x) for x in texts]
        sizes = [len(w) for w in found]
        codes = np.fromiter((c for w in found for c in map(self.terms.get, w, repeat(-1))), dtype=np.int64, count=sum(sizes))
        text = np.repeat(np.arange(len(texts)), sizes)
        known = codes >= 0
        keys, times = np.unique(text[known] * max(1, len(self.terms)) + codes[known], return_counts=True)
        return sizes, keys // max(1, len(self.terms)), keys % max(1, len(self.terms)), times


class Scorer:
    """Scores of documents for all items of an index, in whole numbers."""

    def __init__(self, index: Index, documents: int, terms: int, having: dict[int, int]):
        self.index, self.documents, self.all_terms = index, documents, terms
        weight = [math.floor(1000 * math.log((2 * documents + 2) / (2 * having[t] + 1))) if t in having else 0 for t in range(len(index.terms))]
        self.weight = np.array(weight, dtype=np.int64)
        # sums below 2^53 are exact in doubles, for which the matrix product is fast
        self.kind = np.float64 if index.longest * max(weight, default=0) * 10**6 < 1 << 53 else np.int64
        self.items = len(index.item_ids)
        spread = np.diff(index.starts)
        self.place = np.where(spread * COMMON >= max(1, self.items), np.cumsum(spread * COMMON >= max(1, self.items)) - 1, -1)
        self.matrix = np.zeros((int(self.place.max(initial=-1)) + 1, self.items), dtype=self.kind)
        dense = self.place[index.term] >= 0
        self.matrix[self.place[index.term[dense]], index.item[dense]] = index.times[dense]

    def scores(self, sizes: list[int], text: np.ndarray, term: np.ndarray, times: np.ndarray) -> np.ndarray:
        """One row of scores per document, one column per item."""
        length = np.array([25 + 75 * n * self.documents // self.all_terms for n in sizes], dtype=np.int64)
        value = self.weight[term] * ((1_000_000_000 * times) // (1000 * times + 8 * length[text]))
        place = self.place[term]
        common = np.zeros((len(sizes), len(self.matrix)), dtype=self.kind)
        common[text[place >= 0], place[place >= 0]] = value[place >= 0]
        out = (common @ self.matrix).astype(np.int64)
        text, term, value = (x[place < 0] for x in (text, term, value))
        first, n = self.index.starts[term], np.diff(self.index.starts)[term]
        posting = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        np.add.at(out, (np.repeat(text, n), self.index.item[posting]), np.repeat(value, n) * self.index.times[posting])
        return out


class Heaps:
    """The best documents per item: highest score first, of equal scores the smallest id."""

    def __init__(self, items: int, best: int):
        self.best = best
        self.item, self.score, self.doc = (np.zeros(0, dtype=np.int64) for _ in range(3))
        self.least = np.ones(items, dtype=np.int64)  # the score that a document needs at least

    def push(self, docs: np.ndarray, scores: np.ndarray) -> None:
        row, item = np.nonzero(scores >= self.least)
        if not len(row):
            return
        item = np.concatenate((self.item, item))
        score = np.concatenate((self.score, scores[row, item[len(self.item) :]]))
        doc = np.concatenate((self.doc, docs[row]))
        order = np.lexsort((doc, -score, item))
        item, score, doc = item[order], score[order], doc[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        self.item, self.score, self.doc = (x[rank < self.best] for x in (item, score, doc))
        full = rank == self.best - 1
        self.least[item[full]] = score[full]


def _blocks(items: DataFrame, id_column: str, text_column: str):
    """Parts of the items of bounded size; the driver holds one at a time."""
    rows = items.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text")).where("text IS NOT NULL")
    size = rows.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    parts = max(1, -(-(size.bytes or 0) // INDEX_BYTES), -(-size.n // INDEX_ITEMS))
    for k in range(parts):
        yield [(r.id, r.text) for r in rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == k).collect()]


def term_counts(docs: DataFrame, index: Index, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document: id, n (all its terms), terms and times (the indexed ones)."""
    fields = [("id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("times", pa.list_(pa.int32()))]
    schema, shared = pa.schema(fields), docs.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        for batch in batches:
            for part in text_slices(batch):
                sizes, text, term, times = shared.value.counts(part.column("text").to_pylist())
                ends = pa.array(np.searchsorted(text, np.arange(len(sizes) + 1)), pa.int32())
                lists = (pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (term, times))
                yield batch_of(schema, part.column("id"), sizes, *lists)

    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, n long, terms array<int>, times array<int>")


def heaps(counts: DataFrame, scorer: Scorer, best: int = BEST) -> DataFrame:
    """``item, item_id, doc_id, score``: per task and item, the best documents of the task's rows of ``counts``."""
    fields = [("item", pa.int64()), ("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())]
    schema, shared = pa.schema(fields), counts.sparkSession.sparkContext.broadcast(scorer)

    def run(batches):
        scorer = shared.value
        step = max(1, CELLS // max(1, scorer.items))
        found = Heaps(scorer.items, best)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                docs = part.column("id").fill_null(NO_ID).to_numpy()
                terms, times = (part.column(c).flatten().to_numpy().astype(np.int64) for c in ("terms", "times"))
                text = np.repeat(np.arange(part.num_rows), part.column("terms").value_lengths().to_numpy())
                found.push(docs, scorer.scores(part.column("n").to_pylist(), text, terms, times))
        ids = [scorer.index.item_ids[k] for k in found.item.tolist()]
        yield batch_of(schema, found.item, ids, pa.array(found.doc, mask=found.doc == NO_ID), found.score)

    return counts.mapInArrow(run, "item long, item_id long, doc_id long, score long")


def search(
    docs: DataFrame, items: DataFrame, best: int = BEST, id_column: str = "doc_id", text_column: str = "text",
    item_column: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """``item_id, rank, doc_id, score`` of the ``best`` documents for each item with a score above 0.

    Every row of ``items`` is searched for on its own, repeated ones too; a null or wordless text finds nothing. A null text
    of a document has no terms and isn't counted; repeated documents rank side by side; a null id comes after all others of
    its score. Without documents or items there is no row. Further columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in _blocks(items, item_column, item_text):
        index = Index(block)
        counts = written(term_counts(docs, index, id_column, text_column), "term-counts")
        total = counts.agg(F.count_if(F.col("n") > 0).alias("documents"), F.sum("n").alias("terms")).first()
        if not total.terms:
            continue
        having = counts.select(F.explode("terms").alias("term")).groupBy("term").count()  # at most a row for each term of the index
        scorer = Scorer(index, total.documents, total.terms, {r.term: r["count"] for r in having.collect()})
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = heaps(counts, scorer, best).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
        out = out.union(ranked.select("item_id", "rank", "doc_id", "score"))
    return out
