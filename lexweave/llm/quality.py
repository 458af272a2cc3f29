"""Quality classifier: histogram gradient-boosted trees over statistics of a document's words, lines and characters."""

from __future__ import annotations

from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lexweave.llm import boosting
from lexweave.llm.common import drop_encoders, free_name, text_slices, texts

#: Labelled rows that a fit may see, at most.
SAMPLE = 12_000
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3

_GROUPS = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,", b"!?", b";:'\"()-", b"#$%&*+=@^~", b"|/\\<>[]{}_`", b"\n", b" \t", bytes(range(0x80, 0xC0)), bytes(range(0xC0, 0x100)))
_CLASSES = np.array([[b in g for g in _GROUPS] for b in range(256)], dtype=np.float64)
NAMES = (
    "words chars word_length distinct top_word adjacent_repeats distinct_pairs capital_words short_words odd_ends plain_ends "
    "no_letters lines distinct_lines line_words longest_line short_lines closed_lines sentence_words longest_word "
    "capitals digits stops cries marks symbols brackets breaks blanks trailing leading"
).split()


def statistics(text: str) -> list[float]:
    """One row of features, named in NAMES; an empty text gives zeros."""
    raw = text.encode("utf-8", "surrogatepass")
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    octets = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256) @ _CLASSES / len(raw)
    counts = Counter(words)
    ends = Counter([w[-1] for w in words])
    plain = sum(k for c, k in ends.items() if c.isalpha())
    odd = sum(k for c, k in ends.items() if not c.isalnum() and c not in ".,;:?\"')")
    lines = [x for x in map(str.strip, text.split("\n")) if x]
    sizes = [x.count(" ") + 1 for x in lines]
    lengths = Counter(map(len, words))
    stops = text.count(".") + text.count("!") + text.count("?")
    return [
        np.log1p(n), np.log1p(len(raw)), sum(k * c for k, c in lengths.items()) / n, len(counts) / n, max(counts.values()) / n,
        sum(map(eq, words, words[1:])) / n, len(set(zip(words, words[1:]))) / max(1, n - 1), sum(c for w, c in counts.items() if w.isupper() and len(w) > 1) / n,
        sum(c for k, c in lengths.items() if k <= 3) / n, odd / n, plain / n,
        sum(c for w, c in counts.items() if not w[0].isalpha() and not any(map(str.isalpha, w))) / n, np.log1p(len(lines)), len(set(lines)) / len(lines),
        n / len(lines), max(sizes) / n, sum(s <= 3 for s in sizes) / len(sizes), sum(x[-1] in ".!?" for x in lines) / len(lines), n / (stops + 1), np.log1p(max(lengths)),
        *octets,
    ]


def with_statistics(df: DataFrame, *carried: str) -> DataFrame:
    """``carried`` columns and ``features`` of each row's ``text``."""
    source = df.select(*carried, "text")
    schema = source.drop("text").schema

    def run(batches):
        drop_encoders()
        for batch in batches:
            for part in text_slices(batch):
                rows = np.array([statistics(x) for x in texts(part.column("text"))], dtype=np.float64).reshape(-1, len(NAMES))
                lists = pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * len(NAMES), pa.array(rows.ravel()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carried), lists], names=[*carried, "features"])

    return source.mapInArrow(run, schema.simpleString()[7:-1].replace(":", " ") + ", features array<double>")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, label: str = "quality", **columns: str) -> boosting.Trees:
    """Trees from at most ``sample`` labelled rows outside the held-out fold; the driver holds their features only."""
    usable = boosting.fold(F.col("id"), FOLDS) != HELD_OUT
    rows = with_statistics(boosting.labelled_sample(docs, labels, label, usable, sample, **columns), "id", "y").collect()
    rows.sort(key=lambda r: (r.id, r.y, r.features))
    x = np.array([r.features for r in rows], dtype=np.float64).reshape(-1, len(NAMES))
    return boosting.fit(x, np.array([r.y for r in rows], dtype=np.float64))


def score(df: DataFrame, model: boosting.Trees, text_column: str = "text", score_column: str = "score") -> DataFrame:
    """``df`` with the probability of label 1; a null text is empty. An existing ``score_column`` is replaced."""
    names = [c for c in df.columns if c != score_column]
    source = df.select(*names)
    out = df.select(*names, F.lit(0.0).alias(score_column)).schema

    def run(batches):
        drop_encoders()
        for batch in batches:
            for part in text_slices(batch, text_column):
                rows = np.array([statistics(x) for x in texts(part.column(text_column))], dtype=np.float64).reshape(-1, len(NAMES))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.probability(rows))], names=[*names, score_column])

    return source.mapInArrow(run, out)


def digests(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; rows with a null id are scored and never held out."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    held = F.coalesce(boosting.fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with a score of at least ``threshold``, with their own columns."""
    own = free_name(docs, "_score")
    return score(docs, fit(docs, labels), score_column=own).where(F.col(own) >= threshold).drop(own)
