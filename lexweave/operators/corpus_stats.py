"""Corpus statistics: counts, trigger words and their coverage, vocabulary sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions import text as tx
from lexweave.plans.scale import stored

TRIGGER_CANDIDATES = 20


def word_freq(t: DataFrame) -> DataFrame:
    """A1. ``word, n`` over a token table."""
    return t.where(F.col("punct_type").isNull()).groupBy(F.col("lower").alias("word")).agg(
        F.count(F.lit(1)).alias("n")
    )


def frequent_words(
    words: DataFrame, minimum: int = 5, top: int = 1000, shortest: int = 2, without: str | None = "[qx]"
) -> DataFrame:
    """K3. The report of the most frequent words: at least ``minimum`` times, at most ``top`` rows."""
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.where((F.col("n") >= minimum) & (F.length("word") >= shortest))
    if without:
        counts = counts.where(~F.col("word").rlike(without))
    return counts.orderBy(F.desc("n"), "word").limit(top)


def _target(mark: str):
    return F.col("text").endswith(mark)


def trigger_scores(s: DataFrame, mark: str, minimum: int) -> DataFrame:
    """Words of sentences ending in ``mark``: ``word, tc, ratio, coverage`` (K1 order not yet applied).

    One pass over the text counts every piece between blanks on both sides (merged map-side) and, as a piece that is null,
    the sentences. The words are read from the counted pieces, which are written once; totals come from the counts as scalar
    subqueries: no join carries them.
    """
    sides = s.select(_target(mark).alias("hit"), (F.length("text") > 8).alias("long"), tx.raw_frequency_pieces(F.col("text")).alias("_p"))
    pieces = sides.where(F.col("hit") | F.col("long")).select("hit", F.explode(F.array_append("_p", F.lit(None).cast("string"))).alias("piece"))
    pieces = pieces.groupBy("hit", "piece").agg(F.count(F.lit(1)).alias("n"))
    pieces = stored(pieces, "pieces")
    sides = pieces.select("hit", "n", F.explode(tx.raw_frequency_words(F.col("piece"))).alias("_raw")).where(F.length("_raw") > 1)
    sides = sides.select("hit", "n", tx.word_of(F.col("_raw")).alias("word")).where(~F.col("word").rlike(r"^\d+$"))
    counts = sides.groupBy("word").agg(
        F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0)).alias("tc"), F.sum(F.when(F.col("hit"), 0).otherwise(F.col("n"))).alias("oc")
    )
    totals = counts.agg(F.struct(F.sum("tc").alias("t"), F.sum("oc").alias("o")).alias("s"))
    targets = pieces.where(F.col("hit") & F.col("piece").isNull()).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    scored = (
        counts.where((F.col("tc") >= minimum) & (F.length("word") >= 2))
        .withColumn("_s", totals.scalar())
        .withColumn("_n", targets.scalar())
    )
    t_total = F.greatest(F.col("_s.t"), F.lit(1))
    o_total = F.greatest(F.col("_s.o"), F.lit(1))
    return scored.select(
        "word",
        "tc",
        ((F.col("tc") / t_total) / ((F.col("oc") + 0.5) / o_total)).alias("ratio"),
        (F.col("tc") * 100.0 / F.col("_n")).alias("coverage"),
        F.col("_n").alias("targets"),
    )


K1 = (F.desc, ("ratio", "tc", "coverage", "word"))


def _best_first(scores: DataFrame) -> list:
    make, names = K1
    return [make(n) for n in names]


def trigger_words(s: DataFrame, mark: str = "?", minimum: int = 4, top: int = 40) -> DataFrame:
    """A2 + K1. Words over-represented in sentences that end in ``mark``; words with digits are not shown."""
    scores = trigger_scores(s, mark, minimum)
    shown = scores.where(~F.col("word").rlike(r"\d")).orderBy(*_best_first(scores)).limit(top)
    return shown.select(
        "word",
        F.col("tc").alias("count"),
        F.round("ratio", 6).alias("ratio"),
        F.round("coverage", 6).alias("coverage"),
    )


def trigger_coverage(s: DataFrame, mark: str = "?", minimum: int = 4, top: int = 40) -> DataFrame:
    """A3. For the best 20 triggers: sentences with the word, and with it or any better one.

    The candidate list is at most 20 words, so it travels as one array literal (a scalar subquery) and each
    sentence is tested in its own row; only 20 counters are shuffled.
    """
    scores = trigger_scores(s, mark, minimum)
    best = scores.orderBy(*_best_first(scores)).limit(top)
    order = Window.orderBy(*_best_first(scores))
    ranked = best.withColumn("rank", F.row_number().over(order)).where(~F.col("word").rlike(r"\d"))
    ranked = ranked.withColumn("rank", F.row_number().over(Window.orderBy("rank"))).where(
        F.col("rank") <= TRIGGER_CANDIDATES
    )
    listed = ranked.agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]).alias("w")
    )
    sent = s.where(_target(mark)).select(
        F.array_intersect(listed.scalar(), tx.frequency_words(F.col("text"))).alias("found")
    ).where(F.size("found") > 0)
    hits = sent.select(F.posexplode("found").alias("_at", "word")).groupBy("word").agg(
        F.count(F.lit(1)).alias("alone"), F.count_if(F.col("_at") == 0).alias("first")
    )
    out = ranked.select("word", "rank", "targets").join(F.broadcast(hits), "word", "left")
    running = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("cumulative", F.sum(F.coalesce("first", F.lit(0))).over(running))
    return out.select(
        "word",
        "rank",
        F.coalesce("alone", F.lit(0)).alias("alone"),
        "cumulative",
        F.round(F.coalesce("alone", F.lit(0)) * 100.0 / F.col("targets"), 6).alias("pct_alone"),
        F.round(F.col("cumulative") * 100.0 / F.col("targets"), 6).alias("pct_cumulative"),
    )


def vocab_ops(a: DataFrame, b: DataFrame, word: str = "word") -> DataFrame:
    """U2. Union of two vocabularies, each word labelled ``both``, ``first`` or ``second``."""
    both = a.select(word, F.lit(1).alias("_side")).unionByName(b.select(word, F.lit(2).alias("_side")))
    seen = both.groupBy(word).agg(F.bit_or("_side").alias("_m"))
    return seen.select(
        word, F.when(F.col("_m") == 3, "both").when(F.col("_m") == 1, "first").otherwise("second").alias("side")
    )


def tag_profile(t: DataFrame, by: Sequence[str] = ("pos", "noun_class")) -> DataFrame:
    """A4. Counts by every combination of tag columns, with subtotals (``cube``)."""
    return t.cube(*by).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))
