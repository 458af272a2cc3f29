"""Measured-series operators. ``events`` is read as a generic series: user = clip, time = order, value = the
measured quantity, event type = context; letters come from the words of ``conversations``."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexweave.operators import series as sr
from lexweave.queries.base import query, table
from lexweave.plans.scale import spread

DAY = 86400.0
EPOCH = 1704067200  # 2024-01-01


def frames(spark, sf):
    """``clip_id, t`` (seconds), ``f0, kind, event_id``."""
    e = table(spark, sf, "events", "event_id", "ts", "user_id", "event_type", "value")
    t = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)") / 1e6
    return spread(e).select(
        F.col("user_id").alias("clip_id"), t.alias("t"), F.col("value").alias("f0"), F.col("event_type").alias("kind"),
        "event_id",
    )


FRAMES = f"""fr AS (SELECT user_id AS clip_id, (epoch_us(ts) - {EPOCH}000000) / 1e6 AS t, value AS f0, event_type AS kind, event_id FROM events)"""


@query(
    "semitones",
    f"""WITH {FRAMES}, m AS (SELECT clip_id, quantile_cont(f0, 0.5) AS med FROM fr GROUP BY clip_id)
SELECT event_id, clip_id, round(12 * log2(f0 / med), 6) AS st FROM fr JOIN m USING (clip_id)""",
)
def semitones(spark, sf):
    out = sr.to_semitones(frames(spark, sf))
    return out.select("event_id", "clip_id", F.round("st", 6).alias("st"))


KINDS = ["view", "click", "purchase", "error", "signup"]


@query(
    "length_by_context",
    f"""WITH {FRAMES}, m AS (SELECT clip_id, quantile_cont(f0, 0.5) AS med FROM fr GROUP BY clip_id), r AS (SELECT kind, f0 / med AS rel FROM fr JOIN m USING (clip_id))
SELECT list_position({KINDS}, kind)::INTEGER AS ord, kind AS context, count(*) AS n, round(quantile_cont(rel, 0.5), 6) AS median, round(avg(rel), 6) AS mean FROM r GROUP BY kind""",
)
def length_by_context(spark, sf):
    v = frames(spark, sf).select(
        "clip_id", F.col("event_id").alias("i"), F.col("kind").alias("context"), F.col("f0").alias("dur")
    )
    return sr.length_by_context(v, contexts=KINDS)


LETTERS = """le AS (SELECT conv_id * 1000 + turn AS clip_id, w.no AS word, (p - 1)::INTEGER AS pos, substr(w.w, p, 1) AS ch FROM conversations,
 LATERAL (SELECT unnest(l) AS w, unnest(range(0, len(l))) AS no FROM (SELECT list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\\p{L}\\s]+', '', 'g'), '\\s+'), lambda x: x <> '') AS l)) w,
 LATERAL (SELECT unnest(range(1, length(w.w) + 1)) AS p))"""


def letters(spark, sf):
    c = spread(table(spark, sf, "conversations", "conv_id", "turn", "text"))
    plain = F.regexp_replace(F.lower("text"), r"[^\p{L}\s]+", "")
    words = c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("clip_id"),
        F.posexplode(F.filter(F.split(plain, r"\s+"), lambda w: w != "")).alias("word", "w"),
    )
    return words.select(
        "clip_id", F.col("word").cast("long").alias("word"),
        F.posexplode(F.filter(F.split("w", ""), lambda x: x != "")).alias("pos", "ch"),
    )


@query(
    "vowel_context",
    f"""WITH {LETTERS}, n AS (SELECT *, lag(ch) OVER w AS p, lag(ch, 2) OVER w AS pp, lead(ch) OVER w AS nx, lead(ch, 2) OVER w AS nn FROM le WINDOW w AS (PARTITION BY clip_id, word ORDER BY pos)),
v AS (SELECT clip_id, word, pos, ch, CASE WHEN p IS NULL THEN 'word-initial' WHEN nx IS NULL THEN 'word-final' WHEN nx IN ('m', 'n') AND nn NOT IN ('a','e','i','o','u','y') THEN 'before NC'
 WHEN p IN ('w', 'y') AND pp NOT IN ('a','e','i','o','u') THEN 'after CG' ELSE 'contrastive' END AS c FROM n WHERE ch IN ('a','e','i','o','u'))
SELECT clip_id, word, pos, ch, c || CASE WHEN row_number() OVER (PARTITION BY clip_id ORDER BY word DESC, pos DESC) <= 2 THEN ' (phrase-final)' ELSE '' END AS context FROM v""",
)
def vowel_context(spark, sf):
    return sr.vowel_context(letters(spark, sf))


SPAN = 0.5 * DAY


@query(
    "frame_interval_join",
    f"""WITH {FRAMES}, le AS (SELECT clip_id, event_id AS i, t AS start, t + {SPAN} AS "end" FROM fr WHERE kind = 'signup'),
h AS (SELECT le.clip_id, i, start, "end", f.t, f.f0 FROM le LEFT JOIN fr f ON f.clip_id = le.clip_id AND f.kind <> 'signup' AND f.t >= start AND f.t < "end")
SELECT clip_id, i, count(t) AS frames, round(max("end") - max(start), 3) AS dur, round(quantile_cont(f0, 0.5), 4) AS pitch, round(quantile_cont(f0, 0.5) FILTER (WHERE t < (start + "end") / 2), 4) AS pitch_1,
 round(quantile_cont(f0, 0.5) FILTER (WHERE t >= (start + "end") / 2), 4) AS pitch_2 FROM h GROUP BY clip_id, i""",
)
def frame_interval_join(spark, sf):
    """Each signup opens a letter of half a day; the other events are the frames."""
    f = frames(spark, sf)
    le = f.where("kind = 'signup'").select(
        "clip_id", F.col("event_id").alias("i"), F.col("t").alias("start"), (F.col("t") + SPAN).alias("end")
    )
    fr = f.where("kind <> 'signup'").select("clip_id", "t", F.col("f0").alias("st"))
    out = sr.measure_vowels(fr, le, bin_width=DAY / 4, digits=4)
    return out.select("clip_id", "i", "frames", "dur", "pitch", "pitch_1", "pitch_2")


VOWELS = f"""{FRAMES}, vo AS (SELECT clip_id, floor(t / {DAY})::BIGINT AS word, event_id AS i, t / {DAY} AS start, 5 + f0 AS dur, CASE WHEN kind = 'error' THEN NULL ELSE f0 END AS pitch,
 CASE WHEN kind IN ('view', 'error') THEN NULL ELSE f0 * 0.5 END AS pitch_1, CASE WHEN kind IN ('click', 'error') THEN NULL ELSE f0 * 0.75 END AS pitch_2, kind, 'w' || (floor(t / {DAY})::BIGINT % 7) AS w FROM fr)"""


def vowels(spark, sf):
    """The same shape as a measured-vowel table: a day is a word, an event a vowel."""
    f = frames(spark, sf)
    x, kind = F.col("f0"), F.col("kind")
    day = F.floor(F.col("t") / DAY)
    return f.select(
        "clip_id", day.alias("word"), F.col("event_id").alias("i"), (F.col("t") / DAY).alias("start"),
        (x + 5).alias("dur"), F.when(kind != "error", x).alias("pitch"),
        F.when(~kind.isin("view", "error"), x * 0.5).alias("pitch_1"),
        F.when(~kind.isin("click", "error"), x * 0.75).alias("pitch_2"), "kind",
        F.concat(F.lit("w"), (day % 7).cast("string")).alias("w"),
    )


@query(
    "trend_marks",
    f"""WITH {VOWELS}, c AS (SELECT clip_id, max(start) AS last, count(*) AS n, count(pitch) AS np, regr_slope(pitch, start) AS sl, regr_intercept(pitch, start) AS ic, avg(pitch) AS mean FROM vo GROUP BY clip_id),
j AS (SELECT vo.*, c.* EXCLUDE (clip_id), start = last AS is_last FROM vo JOIN c USING (clip_id)), m AS (SELECT clip_id, quantile_cont(dur, 0.5) AS med FROM j WHERE NOT is_last OR n <= 2 GROUP BY clip_id),
k AS (SELECT *, CASE WHEN np >= 3 THEN ic + sl * start ELSE mean END AS line FROM j LEFT JOIN m USING (clip_id))
SELECT clip_id, i, NOT is_last AND dur > 1.6 * med AS is_long, coalesce(pitch - line > 1.5, FALSE) AS is_high, coalesce(pitch_1 - line > 1.5, FALSE) AS high_1, coalesce(pitch_2 - line > 1.5, FALSE) AS high_2 FROM k""",
)
def trend_marks(spark, sf):
    return sr.suggest_marking(vowels(spark, sf)).select("clip_id", "i", "is_long", "is_high", "high_1", "high_2")


@query(
    "vowel_features",
    f"""WITH {VOWELS}, a AS (SELECT *, coalesce(pitch_1, pitch) AS one, coalesce(pitch_2, pitch) AS two FROM vo), b AS (SELECT *, CASE WHEN one IS NULL THEN two WHEN two IS NULL THEN one ELSE (one + two) / 2 END AS mid FROM a),
c AS (SELECT *, count(mid) OVER g AS nm, sum(mid) OVER g AS s, lag(mid) OVER o AS pv, row_number() OVER o AS r, count(*) OVER g AS n FROM b WINDOW g AS (PARTITION BY clip_id, word), o AS (PARTITION BY clip_id, word ORDER BY i))
SELECT clip_id, word, i, round(CASE WHEN mid IS NOT NULL AND nm > 1 THEN mid - (s - mid) / (nm - 1) ELSE 0 END, 9) AS rel, round(coalesce(mid - pv, 0), 9) AS step, round(coalesce(two - one, 0), 9) AS slope,
 (CASE WHEN r = 1 THEN 0 WHEN r = n THEN 2 ELSE 1 END)::INTEGER AS place FROM c""",
)
def vowel_features(spark, sf):
    rounded = [F.round(c, 9).alias(c) for c in ("rel", "step", "slope")]
    return sr.vowel_features(vowels(spark, sf)).select("clip_id", "word", "i", *rounded, "place")


GAP, MIN_LEN = 3 * 3600.0, 600.0
THRESHOLDS = [0.0, 5.0, 10.0, 20.0]


@query(
    "segment_merge",
    f"""WITH {FRAMES}, s AS (SELECT clip_id, th AS threshold, t AS start, t + f0 * 100 AS "end", clip_id % 20 + 5 AS expected FROM fr, (SELECT unnest({THRESHOLDS}) AS th) WHERE f0 >= th),
l AS (SELECT *, CASE WHEN start - lag("end") OVER w < {GAP} THEN 0 ELSE 1 END AS fresh FROM s WINDOW w AS (PARTITION BY clip_id, threshold ORDER BY start, "end")),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY clip_id, threshold ORDER BY start, "end") AS island FROM l),
i AS (SELECT clip_id, threshold, island, min(start) AS a, arg_max("end", start) AS b, max(expected) AS expected FROM g GROUP BY ALL),
c AS (SELECT clip_id, threshold, count(*) FILTER (WHERE b - a > {MIN_LEN}) AS n, max(expected) AS expected FROM i GROUP BY ALL)
SELECT clip_id, threshold::DOUBLE AS threshold, n, expected::BIGINT AS expected, n = expected AS fits FROM c QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY abs(n - expected), threshold) = 1""",
)
def segment_merge(spark, sf):
    f = frames(spark, sf).withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in THRESHOLDS])))
    segs = f.where(F.col("f0") >= F.col("threshold")).select(
        "clip_id", "threshold", F.col("t").alias("start"), (F.col("t") + F.col("f0") * 100).alias("end"),
        (F.col("clip_id") % 20 + 5).alias("expected"),
    )
    return sr.merge_segments(segs, gap=GAP, min_len=MIN_LEN, bin_width=DAY)


@query(
    "peaks",
    f"""WITH {FRAMES}, n AS (SELECT clip_id, f0 AS db, row_number() OVER (PARTITION BY clip_id ORDER BY t, event_id) - 1 AS idx FROM fr),
w AS (SELECT *, lag(db) OVER o AS p, lead(db) OVER o AS nx, min(db) OVER (PARTITION BY clip_id ORDER BY idx ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS l, min(db) OVER (PARTITION BY clip_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS r FROM n WINDOW o AS (PARTITION BY clip_id ORDER BY idx))
SELECT clip_id, idx, db, round(db - greatest(l, r), 6) AS prominence FROM w WHERE db >= p AND db > nx""",
)
def peaks(spark, sf):
    """A reach of 5 and chunks of 16 frames, so that the short clips of the sample are cut as well."""
    n = sr.number_frames(frames(spark, sf), ["clip_id"], "t", ["t", "event_id"], DAY)
    out = sr.peaks(n.select("clip_id", "idx", F.col("f0").alias("db")), reach=5, chunk=16)
    return out.withColumn("prominence", F.round("prominence", 6))


@query(
    "melody_targets",
    f"""WITH {VOWELS}, m AS (SELECT clip_id, quantile_cont(dur, 0.5) AS med FROM vo GROUP BY clip_id)
SELECT clip_id, i, round(dur / (med + 1e-9), 6) AS rel, CASE WHEN pitch_1 IS NULL AND pitch_2 IS NULL THEN CASE WHEN pitch IS NULL THEN 0 ELSE 1 END ELSE (pitch_1 IS NOT NULL)::INT + (pitch_2 IS NOT NULL)::INT END::INTEGER AS points,
 round(CASE WHEN pitch_1 IS NULL AND pitch_2 IS NULL THEN pitch ELSE coalesce(pitch_1, pitch_2) END, 6) AS first_pitch, (CASE WHEN pitch_1 IS NOT NULL THEN 0.3 WHEN pitch_2 IS NOT NULL THEN 0.75 WHEN pitch IS NOT NULL THEN 0.5 END)::DOUBLE AS first_at FROM vo JOIN m USING (clip_id)""",
)
def melody_targets(spark, sf):
    out = sr.melody_targets(vowels(spark, sf))
    first = F.get("targets", F.lit(0))
    return out.select(
        "clip_id", "i", F.round("rel", 6).alias("rel"), F.size("targets").alias("points"),
        F.round(first["pitch"], 6).alias("first_pitch"), first["at"].alias("first_at"),
    )


OCC = f"""{VOWELS}, vv AS (SELECT clip_id, word, w, i, dur, pitch FROM vo), la AS (SELECT clip_id, max(word) AS last, quantile_cont(dur, 0.5) AS rate FROM vv GROUP BY clip_id),
oc AS (SELECT vv.*, rate, row_number() OVER (PARTITION BY clip_id, word ORDER BY i) AS place, count(*) OVER (PARTITION BY clip_id, word) AS vowels, count(pitch) OVER (PARTITION BY clip_id, word) AS voiced, avg(pitch) OVER (PARTITION BY clip_id, word) AS centre
 FROM vv JOIN la USING (clip_id) WHERE word < last),
o AS (SELECT clip_id, word, w, place, vowels, pitch - centre AS pitch, dur / rate AS length FROM oc WHERE voiced = vowels)"""


CONSISTENCY = f"""WITH {OCC}, said AS (SELECT w, count(DISTINCT (clip_id, word)) AS said, arg_min(vowels, (clip_id, word)) AS fv FROM o GROUP BY w),
k AS (SELECT o.*, said FROM o JOIN said USING (w) WHERE vowels = fv AND said >= 10 AND fv >= 2),
per AS (SELECT w, place, var_pop(pitch) AS vp, var_pop(length) AS vl FROM k GROUP BY ALL), mv AS (SELECT w, avg(vp) AS vp, avg(vl) AS vl FROM per GROUP BY w),
tot AS (SELECT w, max(said) AS said, count(DISTINCT (clip_id, word)) AS n, max(vowels) AS vowels, var_pop(pitch) AS tp, var_pop(length) AS tl FROM k GROUP BY w)
SELECT w, said, n, vowels, round(CASE WHEN tp > 1e-12 THEN 1 - vp / tp ELSE 0 END, 6) AS pitch_c, round(CASE WHEN tl > 1e-12 THEN 1 - vl / tl ELSE 0 END, 6) AS length_c FROM tot JOIN mv USING (w)"""


@query("consistency", f"{CONSISTENCY} ORDER BY n DESC, w LIMIT 25")
def consistency(spark, sf):
    """K4 on A13: the report of at most 25 words."""
    return sr.consistency_report(sr.consistency(vowels(spark, sf)))


@query(
    "consistency_overall",
    f"SELECT count(*) AS words, round(avg(pitch_c), 4) AS pitch_c, round(avg(length_c), 4) AS length_c FROM ({CONSISTENCY})",
)
def consistency_overall(spark, sf):
    """A13's means over all words said often enough, not only those of the report."""
    return sr.consistency_overall(sr.consistency(vowels(spark, sf)))


@query(
    "mean_pattern",
    f"WITH {OCC} SELECT w, vowels, place::INTEGER AS place, count(*) AS n, round(avg(pitch), 6) AS pitch, round(avg(length), 6) AS length FROM o GROUP BY w, vowels, place",
)
def mean_pattern(spark, sf):
    return sr.mean_pattern(vowels(spark, sf))


@query(
    "contour_slopes",
    f"""WITH {VOWELS}, s AS (SELECT kind AS speaker, w, pitch_2 - pitch_1 AS slope FROM vo WHERE pitch_1 IS NOT NULL AND pitch_2 IS NOT NULL)
SELECT speaker, w, count(*) AS n, round(quantile_cont(slope, 0.5), 6) AS median_slope, round(avg((slope > 0)::INT), 6) AS rising FROM s GROUP BY ALL""",
)
def contour_slopes(spark, sf):
    return sr.contour_slopes(vowels(spark, sf).withColumnRenamed("kind", "speaker"))


@query(
    "cap_per_group",
    f"WITH {FRAMES} SELECT event_id, clip_id, kind FROM fr QUALIFY row_number() OVER (PARTITION BY clip_id, kind ORDER BY t, event_id) <= 3",
)
def cap_per_group(spark, sf):
    """The feature itself is the cap: at most 3 per (clip, kind)."""
    return sr.cap_per_group(frames(spark, sf), ["clip_id", "kind"], 3, ["t", "event_id"]).select(
        "event_id", "clip_id", "kind"
    )
