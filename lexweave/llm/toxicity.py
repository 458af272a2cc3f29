"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

The lexicon is learned from labelled documents: whole words, and word beginnings for languages that inflect, by how much
likelier they are in toxic ones. A learning document's own label never counts for its own features.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lexweave.llm import boosting
from lexweave.llm.common import batch_of, text_slices, texts, written

#: Labelled rows that a fit may see, and entries of its lexicon, at most.
SAMPLE, ENTRIES = 12_000, 20_000
FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7
BEGINNINGS = (4, 5, 6)
#: Log odds from which an entry counts, and from which it counts as strong; documents besides the one at hand that must have it.
SOME, STRONG, LEAST = 1.5, 3.0, 2
NEAR = 4
#: Second-person words of the four languages.
SECOND_PERSON = frozenset("you your yours u ur du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos ti tus usted ustedes vosotros".split())
#: Signs that stand for letters.
SIGNS = str.maketrans("013457@$!*", "oieastasi_")
MEMORY = 300_000

_WORD = re.compile(r"[^\W\d_]+")
_MIXED = re.compile(r"(?<!\S)(?=\S*[^\W\d_])(?:[^\W\d_]*[0-9@$*!]+[^\W\d_]+)+\S*")
_SPACED = re.compile(r"\b(?:[^\W\d_][.\-_* ]){3,}[^\W\d_]\b")
NAMES = (
    "words hits density distinct strongest sum strong strong_density strong_distinct second_person near_second "
    "capitals capital_words cries questions marks mixed hidden_hits spaced stretched"
).split()


def terms(words: set[str]) -> set[str]:
    """A word, and with a hyphen its beginnings if it goes on."""
    return words | {w[:k] + "-" for w in words for k in BEGINNINGS if len(w) > k}


class Lexicon:
    """Entries with the toxic and the other documents of the sample that have them."""

    def __init__(self, entries: dict[str, tuple[int, int]], toxic: int, other: int):
        self.entries, self.toxic, self.other = entries, toxic, other
        self.known: dict[str, float] = {}

    def odds(self, word: str, label: int | None = None) -> float:
        """The largest log odds of the word and its beginnings, without the one document of ``label``."""
        if label is None and word in self.known:
            return self.known[word]
        best = 0.0
        for term in (word, *(word[:k] + "-" for k in BEGINNINGS if len(word) > k)):
            if term in self.entries:
                a, b = self.entries[term]
                a, b = a - (label == 1), b - (label == 0)
                if a >= LEAST:
                    best = max(best, math.log((a + 0.5) / (self.toxic + 1)) - math.log((b + 0.5) / (self.other + 1)))
        best = best if best >= SOME else 0.0
        if label is None:
            if len(self.known) > MEMORY:
                self.known.clear()
            self.known[word] = best
        return best

    def features(self, text: str, label: int | None = None) -> list[float]:
        """One row of features, named in NAMES; an empty text gives zeros. ``label`` is that of a document learned from."""
        words = _WORD.findall(text.lower())
        n = max(1, len(words))
        counts = Counter(words)
        hits = {w: v for w in counts if (v := self.odds(w, label))}
        strong = {w for w, v in hits.items() if v >= STRONG}
        seconds = [i for i, w in enumerate(words) if w in SECOND_PERSON] if hits else []
        near = 0
        if seconds:
            close = {j for i in seconds for j in range(i - NEAR, i + NEAR + 1)}
            near = sum(1 for i, w in enumerate(words) if w in hits and i in close)
        mixed = _MIXED.findall(text) if any(c in text for c in "013457@$*!") else []
        hidden = sum(1 for m in mixed for w in _WORD.findall(m.lower().translate(SIGNS)) if self.odds(w, label) >= SOME)
        spaced = _SPACED.findall(text)
        hidden += sum(1 for m in spaced if self.odds("".join(_WORD.findall(m.lower())), label) >= SOME)
        capitals = sum(map(str.isupper, text)) if text.isascii() is False else len(text) - len(text.translate(_NO_CAPITALS))
        times = sum(counts[w] for w in hits)
        strong_times = sum(counts[w] for w in strong)
        return [
            math.log1p(len(words)), times, times / n, len(hits), max(hits.values(), default=0.0), sum(sorted(hits.values())[-5:]),
            strong_times, strong_times / n, len(strong), (sum(counts[w] for w in SECOND_PERSON if w in counts)) / n, near,
            capitals / max(1, len(text)), sum(1 for w in text.split() if len(w) > 2 and w.isupper()) / n,
            text.count("!") / n, text.count("?") / n, sum(map(text.count, ".,;:")) / n, len(mixed) / n, hidden, len(spaced), len(_STRETCHED.findall(text)) / n,
        ]


_NO_CAPITALS = str.maketrans("", "", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_STRETCHED = re.compile(r"([^\W\d_])\1\1")


class Model:
    def __init__(self, lexicon: Lexicon, trees: boosting.Trees, calibration: boosting.Isotonic):
        self.lexicon, self.trees, self.calibration = lexicon, trees, calibration

    def score(self, texts: list[str]) -> np.ndarray:
        rows = np.array([self.lexicon.features(x) for x in texts], dtype=np.float64).reshape(-1, len(NAMES))
        return self.calibration(self.trees.raw(rows))


def learn_lexicon(sample: DataFrame, most: int = ENTRIES) -> Lexicon:
    """Counts documents by term and label; of terms likelier in toxic documents, the ``most`` with the most evidence stay."""
    schema = pa.schema([("term", pa.string()), ("toxic", pa.int64()), ("other", pa.int64())])

    def count(batches):
        for batch in batches:
            found = Counter(), Counter()
            for text, y in zip(texts(batch.column("text")), batch.column("y").to_pylist()):
                found[y].update(terms(set(_WORD.findall(text.lower()))))
            names = list(found[0].keys() | found[1].keys())
            yield batch_of(schema, names, [found[1][t] for t in names], [found[0][t] for t in names])

    totals = {r.y: r["count"] for r in sample.groupBy("y").count().collect()}
    toxic, other = totals.get(1, 0), totals.get(0, 0)
    sums = sample.mapInArrow(count, "term string, toxic long, other long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("other") + 0.5) / (other + 1))
    kept = sums.where(F.col("toxic") > LEAST - 1).withColumn("odds", odds).where(F.col("odds") >= SOME)
    kept = kept.orderBy(F.desc(F.col("odds") * F.log1p("toxic")), "term").limit(most)
    return Lexicon({r.term: (r.toxic, r.other) for r in kept.collect()}, toxic, other)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, label: str = "toxic", **columns: str) -> Model:
    """Lexicon, trees and calibration from at most ``sample`` labelled rows outside the held-out fold.

    The calibration is fitted to scores of rows that the trees behind them did not see.
    """
    usable = boosting.fold(F.col("id"), FOLDS) != HELD_OUT
    rows = written(boosting.labelled_sample(docs, labels, label, usable, sample, **columns), "toxic-sample")
    lexicon = learn_lexicon(rows)
    schema = pa.schema([("id", pa.int64()), ("y", pa.int32()), ("features", pa.list_(pa.float64()))])

    def run(batches):
        for batch in batches:
            y = batch.column("y").to_pylist()
            yield batch_of(schema, batch.column("id"), y, [lexicon.features(x, k) for x, k in zip(texts(batch.column("text")), y)])

    found = rows.mapInArrow(run, "id long, y int, features array<double>").collect()
    found.sort(key=lambda r: (r.id, r.y, r.features))
    x = np.array([r.features for r in found], dtype=np.float64).reshape(-1, len(NAMES))
    y = np.array([r.y for r in found], dtype=np.float64)
    unseen = np.zeros(len(y))
    for k in range(3):
        out = np.arange(len(y)) % 3 == k
        unseen[out] = boosting.fit(x[~out], y[~out], depth=3).raw(x[out])
    return Model(lexicon, boosting.fit(x, y, depth=3), boosting.isotonic(unseen, y))


def score(df: DataFrame, model: Model, text_column: str = "text", score_column: str = "score") -> DataFrame:
    """``df`` with the calibrated probability of label 1; a null text is empty. An existing ``score_column`` is replaced."""
    names = [c for c in df.columns if c != score_column]
    out = df.select(*names, F.lit(0.0).alias(score_column)).schema
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, text_column):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(shared.value.score(texts(part.column(text_column))))], names=[*names, score_column])

    return df.select(*names).mapInArrow(run, out)


def digests(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; rows with a null id are scored and never held out."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    held = F.coalesce(boosting.fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
