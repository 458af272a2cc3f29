"""Measured vowels and frames.

A clip is a key that may be hot. Medians go through ``exact_quantile``, neighbours and running sums along a
clip through ``scan`` over time bins, joins of per-clip facts through ``salted_join``. Only groups that are
small by nature (the letters of one word, the frames of one letter) use a plain window or percentile.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions import series as se
from lexweave.functions.text import VOWELS
from lexweave.plans.scale import exact_quantile, salted_join, scan, with_median

CONTEXTS = ["word-initial", "word-final", "contrastive", "before NC", "after CG"]


def to_semitones(frames: DataFrame, clip: Sequence[str] = ("clip_id",), f0: str = "f0") -> DataFrame:
    """W14. ``st``: semitones of ``f0`` against the clip's median."""
    out = with_median(frames, clip, f0, "_median")
    return out.withColumn("st", se.semitones(F.col(f0), F.col("_median"))).drop("_median")


def length_by_context(
    v: DataFrame, clip: Sequence[str] = ("clip_id",), contexts: Sequence[str] = CONTEXTS
) -> DataFrame:
    """A12. Duration over the clip's median, then count, median and mean per context in a fixed order.

    A handful of contexts share all rows; their medians are exact and no task holds a whole context.
    ``v`` should keep the vowel's number, by which a long clip is spread out.
    """
    rel = with_median(v, clip, "dur", "_rate")
    rel = rel.select("context", (F.col("dur") / F.col("_rate")).alias("rel")).where(F.col("context").isin(*contexts))
    means = rel.groupBy("context").agg(F.avg("rel").alias("mean"))
    medians = exact_quantile(rel, ["context"], "rel", "median")
    rank = F.create_map(*[F.lit(x) for i, c in enumerate(contexts, 1) for x in (c, i)])
    out = medians.join(F.broadcast(means), "context").withColumn("ord", F.element_at(rank, F.col("context")))
    return out.select(
        "ord", "context", "n", F.round("median", 6).alias("median"), F.round("mean", 6).alias("mean")
    ).orderBy("ord")


def vowel_context(
    letters: DataFrame, clip: Sequence[str] = ("clip_id",), bin_words: int = 512, final: int = 2
) -> DataFrame:
    """W13. ``context`` of every vowel from its neighbours in the word; the clip's last two are marked.

    Input ``clip, word, pos, ch`` (``pos`` counts letters in the word). Words are small; the last vowels of
    a clip are found per block of words first, so a long clip reaches one task as two rows per block.
    """
    w = Window.partitionBy(*clip, "word").orderBy("pos")
    near = letters.select(
        "*",
        F.lag("ch", 1).over(w).alias("_p"), F.lag("ch", 2).over(w).alias("_pp"),
        F.lead("ch", 1).over(w).alias("_n"), F.lead("ch", 2).over(w).alias("_nn"),
    )
    vowel = f"^[{VOWELS}]$"
    context = (
        F.when(F.col("_p").isNull(), "word-initial")
        .when(F.col("_n").isNull(), "word-final")
        .when(F.col("_n").isin("m", "n") & ~F.col("_nn").rlike(vowel) & (F.col("_nn") != "y"), "before NC")
        .when(F.col("_p").isin("w", "y") & ~F.col("_pp").rlike(vowel), "after CG")
        .otherwise("contrastive")
    )
    vowels = near.where(F.col("ch").rlike(vowel)).withColumn("context", context).drop("_p", "_pp", "_n", "_nn")
    block = F.floor(F.col("word") / bin_words)
    in_block = Window.partitionBy(*clip, "_block").orderBy(F.desc("word"), F.desc("pos"))
    in_clip = Window.partitionBy(*clip).orderBy(F.desc("word"), F.desc("pos"))
    tails = vowels.select(*clip, block.alias("_block"), "word", "pos")
    tails = tails.withColumn("_r", F.row_number().over(in_block)).where(F.col("_r") <= final)
    tails = tails.withColumn("_r", F.row_number().over(in_clip)).where(F.col("_r") <= final)
    tails = tails.select(*clip, "word", "pos", F.lit(" (phrase-final)").alias("_final"))
    j = vowels.join(tails, [*clip, "word", "pos"], "left")
    return j.withColumn("context", F.concat("context", F.coalesce("_final", F.lit("")))).drop("_final")


def measure_vowels(
    frames: DataFrame, letters: DataFrame, clip: Sequence[str] = ("clip_id",), bin_width: float = 1.0,
    digits: int = 2,
) -> DataFrame:
    """J16. Interval join of frames with letters, then pitch of the whole letter and of its halves.

    ``frames``: clip, t, st (null if unvoiced). ``letters``: clip, i, start, end. A letter is repeated once
    per time bin it touches and meets the frames of that bin by an equi-join on ``(clip, bin)``: the key is
    as fine as the bin, so a long clip is spread out, and every frame meets a letter at most once.
    """
    first, last = F.floor(F.col("start") / bin_width), F.floor(F.col("end") / bin_width)
    spans = letters.withColumn("_bin", F.explode(F.sequence(first, last)))
    f = frames.select(*clip, F.col("t").alias("_t"), F.col("st").alias("_st")).withColumn(
        "_bin", F.floor(F.col("_t") / bin_width)
    )
    hits = spans.join(f, [*clip, "_bin"]).where((F.col("_t") >= F.col("start")) & (F.col("_t") < F.col("end")))
    middle = (F.col("start") + F.col("end")) / 2
    measured = hits.groupBy(*clip, "i").agg(
        F.count(F.lit(1)).alias("frames"),
        F.percentile("_st", 0.5).alias("pitch"),
        F.percentile(F.when(F.col("_t") < middle, F.col("_st")), 0.5).alias("pitch_1"),
        F.percentile(F.when(F.col("_t") >= middle, F.col("_st")), 0.5).alias("pitch_2"),
    )
    out = letters.join(measured, [*clip, "i"], "left")
    rounded = [F.bround(c, digits).alias(c) for c in ("pitch", "pitch_1", "pitch_2")]
    return out.select(
        *letters.columns, F.coalesce("frames", F.lit(0)).alias("frames"),
        F.bround(F.col("end") - F.col("start"), 3).alias("dur"), *rounded,
    )


def suggest_marking(
    v: DataFrame, clip: Sequence[str] = ("clip_id",), long_ratio: float = 1.6, high_st: float = 1.5
) -> DataFrame:
    """W15. ``is_long, is_high, high_1, high_2`` per vowel.

    Long: longer than ``long_ratio`` times the median of the clip's other vowels (the last one is left out);
    high: more than ``high_st`` above the clip's least-squares line, or its mean with fewer than 3 points.
    """
    facts = v.groupBy(*clip).agg(
        F.max("start").alias("_last"), F.count(F.lit(1)).alias("_n"), F.count("pitch").alias("_np"),
        F.regr_slope("pitch", "start").alias("_slope"), F.regr_intercept("pitch", "start").alias("_icpt"),
        F.avg("pitch").alias("_mean"),
    )
    j = salted_join(v, facts, clip).withColumn("_is_last", F.col("start") == F.col("_last"))
    counted = j.where(~F.col("_is_last") | (F.col("_n") <= 2))
    medians = exact_quantile(counted, clip, "dur", "_med").drop("n")
    j = salted_join(j, medians, clip, "left")
    line = se.trend(F.col("_slope"), F.col("_icpt"), F.col("_mean"), F.col("_np"), F.col("start"))
    is_long = ~F.col("_is_last") & (F.col("dur") > long_ratio * F.col("_med"))

    def high(p: str) -> Column:
        return F.coalesce(F.col(p) - line > high_st, F.lit(False))

    halves = [high(p).alias(f"high_{k}") for k, p in ((1, "pitch_1"), (2, "pitch_2")) if p in v.columns]
    return j.select(*v.columns, is_long.alias("is_long"), high("pitch").alias("is_high"), *halves)


def vowel_features(v: DataFrame, word: Sequence[str] = ("clip_id", "word"), order: str = "i") -> DataFrame:
    """W16. Per vowel: pitch against the word's other vowels, against the previous one, the slope inside
    it, and its place (0 first, 1 middle, 2 last). Words are small, so this is a plain window."""
    one, two = F.coalesce("pitch_1", "pitch"), F.coalesce("pitch_2", "pitch")
    mid = F.when(one.isNull(), two).when(two.isNull(), one).otherwise((one + two) / 2)
    whole = Window.partitionBy(*word)
    w = whole.orderBy(order)
    s = v.withColumn("_mid", mid)
    m = F.col("_mid")
    n, total = F.count(m).over(whole), F.sum(m).over(whole)
    s = s.select(
        "*", n.alias("_n"), total.alias("_sum"), F.lag("_mid").over(w).alias("_prev"),
        F.row_number().over(w).alias("_r"), F.count(F.lit(1)).over(whole).alias("_all"),
    )
    rel = F.when(m.isNotNull() & (F.col("_n") > 1), m - (F.col("_sum") - m) / (F.col("_n") - 1)).otherwise(0.0)
    return s.select(
        *v.columns,
        rel.alias("rel"),
        F.coalesce(m - F.col("_prev"), F.lit(0.0)).alias("step"),
        F.coalesce(two - one, F.lit(0.0)).alias("slope"),
        F.when(F.col("_r") == 1, 0).when(F.col("_r") == F.col("_all"), 2).otherwise(1).alias("place"),
    )


def merge_segments(
    segs: DataFrame,
    clip: Sequence[str] = ("clip_id",),
    gap: float = 0.25,
    min_len: float = 0.15,
    expected: str = "expected",
    bin_width: float = 600.0,
) -> DataFrame:
    """W17. Pieces closer than ``gap`` are one; short ones are dropped; the threshold whose count fits wins.

    ``segs``: clip, threshold, start, end, expected. Gaps and islands over a scan in time bins: a clip of
    any length is cut, and the island number is a running sum carried from bin to bin.
    """
    keys = [*clip, "threshold"]
    s = segs.withColumn("_bin", F.floor(F.col("start") / bin_width))
    s = scan(s, keys, "_bin", ["start", "end"], lag={"_prev_end": "end"})
    fresh = F.coalesce(F.col("start") - F.col("_prev_end") >= gap, F.lit(True)).cast("int")
    s = scan(s, keys, "_bin", ["start", "end"], running={"_island": fresh})
    islands = s.groupBy(*keys, "_island").agg(
        F.min("start").alias("start"), F.max_by("end", F.struct("start", "end")).alias("end"),
        F.first(expected).alias("expected"),
    )
    kept = (F.col("end") - F.col("start")) > min_len
    counts = islands.groupBy(*keys).agg(F.count_if(kept).alias("n"), F.first("expected").alias("expected"))
    off = F.abs(F.col("n") - F.col("expected"))
    return counts.groupBy(*clip).agg(
        F.min_by(F.struct("threshold", "n"), F.struct(off, F.col("threshold"))).alias("_b"),
        F.first("expected").alias("expected"),
    ).select(
        *clip, F.col("_b.threshold").alias("threshold"), F.col("_b.n").alias("n"), "expected",
        (F.col("_b.n") == F.col("expected")).alias("fits"),
    )


def peaks(
    frames: DataFrame, clip: Sequence[str] = ("clip_id",), index: str = "idx", value: str = "db", reach: int = 40,
    chunk: int = 4096,
) -> DataFrame:
    """W18. Local maxima with their height above the higher of the two minima within ``reach`` frames.

    ``index`` numbers the frames of a clip without gaps. A clip is cut into chunks; the frames near a cut
    are copied into the neighbour chunk, so every window is complete and no task holds a whole clip.
    """
    at = F.col(index)
    own = F.floor(at / chunk)
    inside = at % chunk
    members = F.array_compact(
        F.array(
            own,
            F.when((inside < reach) & (own > 0), own - 1),
            F.when(inside >= chunk - reach, own + 1),
        )
    )
    s = frames.withColumn("_own", own).withColumn("_chunk", F.explode(members))
    w = Window.partitionBy(*clip, "_chunk").orderBy(index)
    x = F.col(value)
    s = s.select(
        *frames.columns, "_own", "_chunk",
        F.lag(value).over(w).alias("_p"), F.lead(value).over(w).alias("_n"),
        F.min(value).over(w.rowsBetween(-reach, 0)).alias("_left"),
        F.min(value).over(w.rowsBetween(0, reach)).alias("_right"),
    )
    top = (F.col("_own") == F.col("_chunk")) & (x >= F.col("_p")) & (x > F.col("_n"))
    return s.where(top).select(
        *clip, index, value, (x - F.greatest("_left", "_right")).alias("prominence")
    )


def melody_targets(v: DataFrame, clip: Sequence[str] = ("clip_id",)) -> DataFrame:
    """W20. Duration over the clip's median, and the pitch points (place in the vowel, semitones)."""
    rel = with_median(v, clip, "dur", "_med").withColumn("rel", F.col("dur") / (F.col("_med") + 1e-9))

    def point(place: float, p: str) -> Column:
        return F.when(F.col(p).isNotNull(), F.struct(F.lit(place).alias("at"), F.col(p).alias("pitch")))

    halves = F.array_compact(F.array(point(0.3, "pitch_1"), point(0.75, "pitch_2")))
    whole = F.array_compact(F.array(point(0.5, "pitch")))
    return rel.withColumn("targets", F.when(F.size(halves) > 0, halves).otherwise(whole)).drop("_med")


def occurrences(v: DataFrame, clip: Sequence[str] = ("clip_id",)) -> DataFrame:
    """Vowels of the word occurrences that count for A13: not the clip's last word, every pitch measured.

    Adds the place of the vowel, the number of vowels, centred pitch and rate-normalised length.
    """
    last = v.groupBy(*clip).agg(F.max("word").alias("_last"))
    rates = exact_quantile(v, clip, "dur", "_rate").drop("n")
    facts = last.join(rates, list(clip))
    word = Window.partitionBy(*clip, "word")
    s = salted_join(v, facts, clip).where(F.col("word") < F.col("_last"))
    s = s.select(
        "*", F.row_number().over(word.orderBy("i")).alias("place"), F.count(F.lit(1)).over(word).alias("vowels"),
        F.count("pitch").over(word).alias("_voiced"), F.avg("pitch").over(word).alias("_centre"),
    ).where(F.col("_voiced") == F.col("vowels"))
    return s.select(
        *clip, "word", "w", "place", "vowels", (F.col("pitch") - F.col("_centre")).alias("pitch"),
        (F.col("dur") / F.col("_rate")).alias("length"),
    )


def consistency(v: DataFrame, clip: Sequence[str] = ("clip_id",), least: int = 10) -> DataFrame:
    """A13. ``1 - mean(variance per place) / variance`` of pitch and length, per word said often enough.

    Only occurrences with as many vowels as the word's first one count. Everything after the occurrence
    step is counts, means and variances per (word, vowels, place), merged map-side: a frequent word costs
    a few rows per task.
    """
    o = occurrences(v, clip)
    when = F.struct(*clip, "word")
    per = o.groupBy("w", "vowels", "place").agg(
        F.count(F.lit(1)).alias("n"), F.min(when).alias("_first"),
        F.avg("pitch").alias("mp"), F.var_pop("pitch").alias("vp"),
        F.avg("length").alias("ml"), F.var_pop("length").alias("vl"),
    )
    n = F.sum("n")

    def share(mean: str, var: str) -> Column:
        total = F.sum(F.col("n") * (F.col(var) + F.col(mean) * F.col(mean))) / n - F.pow(
            F.sum(F.col("n") * F.col(mean)) / n, F.lit(2)
        )
        return F.when(total > 1e-12, 1 - F.avg(var) / total).otherwise(0.0)

    groups = per.groupBy("w", "vowels").agg(
        F.max("n").alias("n"), F.min("_first").alias("_first"),
        share("mp", "vp").alias("pitch_c"), share("ml", "vl").alias("length_c"),
    )
    said = groups.groupBy("w").agg(
        F.sum("n").alias("said"), F.min_by(F.struct("vowels", "n", "pitch_c", "length_c"), "_first").alias("_b")
    )
    out = said.where((F.col("said") >= least) & (F.col("_b.vowels") >= 2))
    return out.select(
        "w", "said", F.col("_b.n").alias("n"), F.col("_b.vowels").alias("vowels"),
        F.round("_b.pitch_c", 6).alias("pitch_c"), F.round("_b.length_c", 6).alias("length_c"),
    )


def consistency_report(c: DataFrame, top: int = 25) -> DataFrame:
    """K4. The most frequent words of A13."""
    return c.orderBy(F.desc("n"), "w").limit(top)


def consistency_overall(c: DataFrame) -> DataFrame:
    """A13. The line above the report: the words of ``consistency`` and the means of their shares, each word counting once.

    No words give no means. The chance level of shuffled vowels is left out: it depends on the random draw.
    """
    return c.agg(
        F.count(F.lit(1)).alias("words"), F.round(F.avg("pitch_c"), 4).alias("pitch_c"), F.round(F.avg("length_c"), 4).alias("length_c")
    )


def mean_pattern(v: DataFrame, clip: Sequence[str] = ("clip_id",)) -> DataFrame:
    """A14. Mean centred pitch and mean length per word, number of vowels and place."""
    return occurrences(v, clip).groupBy("w", "vowels", "place").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("pitch"), 6).alias("pitch"),
        F.round(F.avg("length"), 6).alias("length"),
    )


def cap_per_group(df: DataFrame, keys: Sequence[str], n: int, order: Sequence[str]) -> DataFrame:
    """W9. The first ``n`` rows of every group in input order (Spark cuts to ``n`` before the shuffle too)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def contour_slopes(v: DataFrame, keys: Sequence[str] = ("speaker", "w")) -> DataFrame:
    """A15. Per speaker and word: n, median of second minus first half, share that rise."""
    s = v.where(F.col("pitch_1").isNotNull() & F.col("pitch_2").isNotNull())
    s = s.select(*keys, (F.col("pitch_2") - F.col("pitch_1")).alias("_slope"))
    rising = s.groupBy(*keys).agg(F.avg((F.col("_slope") > 0).cast("double")).alias("_r"))
    out = exact_quantile(s, keys, "_slope", "_m").join(rising, list(keys))
    return out.select(*keys, "n", F.round("_m", 6).alias("median_slope"), F.round("_r", 6).alias("rising"))


def number_frames(
    frames: DataFrame, clip: Sequence[str], time: str, order: Sequence[str], bin_width: float, out: str = "idx"
) -> DataFrame:
    """Gapless frame numbers from 0 along each clip."""
    s = frames.withColumn("_bin", F.floor(F.col(time) / bin_width))
    s = scan(s, clip, "_bin", order, running={out: F.lit(1)})
    return s.withColumn(out, F.col(out) - 1).drop("_bin")
