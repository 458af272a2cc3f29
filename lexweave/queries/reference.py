"""Reference matching and tone marks. ``embeddings`` are contours, their labels the reference words; marks are
read from the words of ``documents`` (accents and doubled vowels occur in them)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexweave.functions import series as fse
from lexweave.operators import contours as ct, marks as mk
from lexweave.plans.scale import salted_join, spread
from lexweave.queries.base import query, table
from lexweave.queries.text_core import VOCAB, vocabularies
from lexweave.queries.vocab import V, vocabulary
from lexweave.sources import fixed

PATTERNS = ["L", "H", "LL", "HL", "LH", "HH"]


def vectors(spark, sf):
    return spread(table(spark, sf, "embeddings", "vec_id", "embedding", "label"))


def contour_tables(spark, sf):
    v = vectors(spark, sf)
    contour = F.col("embedding").cast("array<double>").alias("contour")
    targets = v.select(
        F.col("vec_id").alias("id"), F.col("label").cast("long").alias("word"), contour,
        (F.col("vec_id") % 5 + 2).alias("vowels"),
    )
    refs = v.select(
        F.col("vec_id").alias("recording"), F.col("label").cast("long").alias("id"),
        F.col("label").cast("long").alias("ord"), contour, (F.col("label") % 4 + 2).cast("long").alias("vowels"),
    )
    return targets, refs


PAIRS = """v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label::BIGINT AS label FROM embeddings),
d AS (SELECT t.vec_id AS target, r.label AS ref, min(list_sum([abs(t.e[i] - r.e[i]) for i in range(1, 65)]) + 0.5 * abs(t.vec_id % 5 + 2 - (r.label % 4 + 2))) AS raw FROM v t JOIN v r ON t.label <> r.label GROUP BY ALL)"""


@query(
    "closest_refs",
    f"""WITH {PAIRS}, x AS (SELECT target, ref, round_even(raw, 2) AS dist FROM d)
SELECT target, row_number() OVER (PARTITION BY target ORDER BY dist, ref)::INTEGER AS rank, ref, dist FROM x QUALIFY rank <= 3""",
)
def closest_refs(spark, sf):
    """Held out: a label is never compared with its own recordings."""
    return ct.closest(*contour_tables(spark, sf), k=3)


@query(
    "closest_same_ending",
    """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label::BIGINT AS label, ['12', '121', '21', '1121'][vec_id % 4 + 1] AS ts, ['1', '21', '221', '12'][label % 4 + 1] AS rs FROM embeddings),
d AS (SELECT t.vec_id AS target, r.label AS ref, min(round_even(list_sum([abs(t.e[i] - r.e[i]) for i in range(1, 65)]) + 0.5 * abs(t.vec_id % 5 + 2 - (r.label % 4 + 2)), 2)) AS dist,
 right(t.ts, least(length(t.ts), length(r.rs))) = right(r.rs, least(length(t.ts), length(r.rs))) AS fits FROM v t JOIN v r ON t.label <> r.label GROUP BY t.vec_id, t.ts, r.label, r.rs),
k AS (SELECT *, bool_or(fits) OVER (PARTITION BY target) AS fit_any FROM d)
SELECT target, row_number() OVER (PARTITION BY target ORDER BY dist, ref)::INTEGER AS rank, ref, dist FROM k WHERE fits OR NOT fit_any QUALIFY rank <= 2""",
)
def closest_same_ending(spark, sf):
    targets, refs = contour_tables(spark, sf)
    ts = F.element_at(F.array(*[F.lit(x) for x in ("12", "121", "21", "1121")]), (F.col("id") % 4 + 1).cast("int"))
    rs = F.element_at(F.array(*[F.lit(x) for x in ("1", "21", "221", "12")]), (F.col("id") % 4 + 1).cast("int"))
    return ct.closest(
        targets.withColumn("signature", ts), refs.withColumn("signature", rs), k=2, by_signature=True
    )


@query("dtw_refs")
def dtw_refs(spark, sf):
    """Warped distance on contours resampled to 40 points; checked against brute force in the tests."""
    targets, refs = (
        df.withColumn("contour", fse.resample(F.col("contour"), 40)) for df in contour_tables(spark, sf)
    )
    return ct.closest(targets, refs, k=3, distance="dtw")


@query(
    "resample_contours",
    """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT vec_id, e, j, j * 63 / 39.0::DOUBLE AS x FROM v, (SELECT unnest(range(0, 40)) AS j)),
q AS (SELECT *, floor(x)::INT AS lo FROM p)
SELECT vec_id, j::INTEGER AS point, round(e[lo + 1] + (e[least(lo + 1, 63) + 1] - e[lo + 1]) * (x - lo), 6) AS value FROM q""",
)
def resample_contours(spark, sf):
    v = vectors(spark, sf)
    points = fse.resample(F.col("embedding").cast("array<double>"), 40)
    return v.select("vec_id", F.posexplode(points).alias("point", "_v")).select(
        "vec_id", "point", F.round("_v", 6).alias("value")
    )


@query(
    "knn_vote",
    f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label, {PATTERNS}[label % 6 + 1] AS pattern, CASE vec_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 END AS moras FROM embeddings),
f AS (SELECT *, [list_sum(e[1:16]), list_sum(e[17:32]), list_sum(e[33:48]), list_sum(e[49:64])] AS x FROM v),
d AS (SELECT t.vec_id AS id, r.vec_id AS ex, r.pattern, abs(t.x[1] - r.x[1]) + abs(t.x[2] - r.x[2]) + abs(t.x[3] - r.x[3]) + 4 * abs(t.x[4] - r.x[4]) AS dist FROM f t JOIN f r ON t.vec_id <> r.vec_id AND (t.moras IS NULL OR t.moras = length(r.pattern))),
n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, ex) AS r FROM d QUALIFY r <= 3), g AS (SELECT id, pattern, count(*) AS votes, min(r) AS f FROM n GROUP BY ALL)
SELECT id, pattern, votes FROM g QUALIFY row_number() OVER (PARTITION BY id ORDER BY votes DESC, f) = 1""",
)
def knn_vote(spark, sf):
    """Four block sums of the vector stand for the four vowel features; the last one weighs four times."""
    v = vectors(spark, sf)
    e = F.col("embedding").cast("array<double>")
    sums = F.array(
        *[F.aggregate(F.slice(e, 16 * b + 1, 16), F.lit(0.0), lambda a, x: a + x) for b in range(4)]
    )
    pattern = F.element_at(F.array(*[F.lit(p) for p in PATTERNS]), F.col("label") % 6 + 1)
    rows = v.select(
        F.col("vec_id").alias("id"), F.col("vec_id").alias("word"), sums.alias("features"), pattern.alias("pattern"),
        F.when(F.col("vec_id") % 3 == 0, 1).when(F.col("vec_id") % 3 == 1, 2).alias("moras"),
    )
    return ct.knn_vote(rows, rows)


METHODS = ["plain", "length", "marked", "rules"]


@query(
    "compare_methods",
    """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings),
d AS (SELECT vec_id AS id, m, list_sum(list_transform(e[m * 16 - 15:m * 16], lambda x: abs(x))) AS dist FROM v, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE NOT (label = 3 AND m = 2)),
w AS (SELECT id, max(dist) FILTER (WHERE m = 1) AS a, max(dist) FILTER (WHERE m = 2) AS b, max(dist) FILTER (WHERE m = 3) AS c, max(dist) FILTER (WHERE m = 4) AS d FROM d GROUP BY id HAVING count(*) = 4),
x AS (SELECT *, list_position([a, b, c, d], least(a, b, c, d)) AS win FROM w), l AS (SELECT unnest([1, 2, 3, 4]) AS ord, unnest([a, b, c, d]) AS dist, win, a FROM x)
SELECT ord::INTEGER AS ord, ['plain', 'length', 'marked', 'rules'][ord] AS method, count(*) AS n, round(avg(dist), 6) AS mean_dist, count(*) FILTER (WHERE win = ord) AS wins, count(*) FILTER (WHERE dist < a) AS closer FROM l GROUP BY ord""",
)
def compare_methods(spark, sf):
    """Four parts of each vector are four methods; label 3 lacks the second one and is dropped."""
    v = vectors(spark, sf)
    e = F.col("embedding").cast("array<double>")
    parts = F.array(
        *[
            F.struct(
                F.lit(m).alias("method"), F.lit(i).alias("no"),
                F.aggregate(F.slice(e, 16 * i + 1, 16), F.lit(0.0), lambda a, x: a + F.abs(x)).alias("dist"),
            )
            for i, m in enumerate(METHODS)
        ]
    )
    d = v.select(F.col("vec_id").alias("id"), "label", F.explode(parts).alias("_m"))
    d = d.where(~((F.col("label") == 3) & (F.col("_m.no") == 1))).select("id", "_m.method", "_m.dist")
    return ct.compare_methods(d, METHODS, "plain")


# --- marks, in SQL ------------------------------------------------------------------------------------

ACC = "́"


def dec_sql(w: str) -> str:
    out = f"translate(lower({w}), '{mk.PLAIN_FROM}', '{mk.PLAIN_TO}')"
    for v in "aeiou":
        out = f"regexp_replace({out}, '[{mk.ACUTE[v]}{mk.CIRCUMFLEX[v]}]', '{v}{ACC}', 'g')"
    return out


RUN = "|".join(f"{v}{ACC}?(?:{v}{ACC}?)?" for v in "aeiou")


def moras_sql(w: str) -> str:
    return (
        f"list_transform(regexp_extract_all({dec_sql(w)}, '{RUN}'), "
        f"lambda r: regexp_replace(regexp_replace(r, '[aeiou]{ACC}', 'H', 'g'), '[aeiou]', 'L', 'g'))"
    )


def plain_sql(w: str) -> str:
    out = f"replace({dec_sql(w)}, '{ACC}', '')"
    for v in "aeiou":
        out = f"regexp_replace({out}, '{v}{v}', '{v}', 'g')"
    return out


MARKED = f"{V}, mw AS MATERIALIZED (SELECT word, {plain_sql('word')} AS plain, {moras_sql('word')} AS m FROM vocab)"


@query(
    "marks_explode",
    f"""WITH {MARKED} SELECT word, plain, unnest(range(1, len(m) + 1))::INTEGER AS vowel_no, unnest(regexp_extract_all(plain, '[aeiou]')) AS letter, unnest(m) AS moras FROM mw WHERE len(m) > 0""",
)
def marks_explode(spark, sf):
    return mk.marks_explode(vocabulary(spark, sf))


def write_sql(source: str, key: str, p: str, m: str, out: str) -> str:
    """Marked words of (key, plain, moras) by weaving letters and moras in a join."""
    return f"""wl AS (SELECT {key}, i, substr({p}, i, 1) AS c, {m} AS m, CASE WHEN substr({p}, i, 1) IN ('a','e','i','o','u') THEN length(regexp_replace(substr({p}, 1, i), '[^aeiou]', '', 'g')) END AS k FROM {source}, LATERAL (SELECT unnest(range(1, length({p}) + 1)) AS i)),
wr AS (SELECT {key}, i, CASE WHEN k IS NULL OR m[k] IS NULL THEN c ELSE array_to_string(list_transform(string_split(m[k], ''), lambda x: CASE x WHEN 'H' THEN translate(c, 'aeiou', 'áéíóú') ELSE c END), '') END AS s FROM wl),
{out} AS (SELECT {key}, string_agg(s, '' ORDER BY i) AS marked FROM wr GROUP BY {key})"""


@query("marks_write", f"WITH {MARKED}, {write_sql('mw', 'word', 'plain', 'm', 'done')} SELECT word, marked FROM done")
def marks_write(spark, sf):
    """Reading a word and writing it back: accents become acute, everything else is kept."""
    v = vocabulary(spark, sf).select("word")
    read = v.select("word", mk.plain(F.col("word")).alias("plain"), mk.moras(F.col("word")).alias("moras"))
    return mk.marks_write(read).select("word", "marked")


def forced_sql(p: str) -> str:
    v = "('a','e','i','o','u')"
    return f"""list_transform(list_filter(range(1, length({p}) + 1), lambda i: substr({p}, i, 1) IN {v}), lambda k: CASE WHEN k = 1 THEN 1 WHEN k = length({p}) THEN 1
 WHEN k + 2 <= length({p}) AND substr({p}, k + 1, 1) IN ('m', 'n') AND substr({p}, k + 2, 1) NOT IN ('a','e','i','o','u','w','y') THEN 2
 WHEN k >= 3 AND substr({p}, k - 1, 1) IN ('w', 'y') AND substr({p}, k - 2, 1) NOT IN {v} AND substr({p}, k - 2, 2) NOT IN ('ny', 'hy') THEN 2 END)"""


@query(
    "forced_length",
    f"""WITH {MARKED}, f AS (SELECT word, plain, {forced_sql('plain')} AS r FROM mw)
SELECT word, unnest(range(1, len(r) + 1))::INTEGER AS vowel_no, unnest(r)::INTEGER AS forced FROM f WHERE len(r) > 0""",
)
def forced_length(spark, sf):
    v = vocabulary(spark, sf).select("word")
    rules = mk.forced_length(mk.plain(F.col("word")))
    rows = v.select("word", F.posexplode(rules).alias("_at", "forced"))
    return rows.select("word", (F.col("_at") + 1).alias("vowel_no"), "forced")


@query(
    "length_signature",
    f"""WITH {MARKED} SELECT array_to_string(list_transform(m, lambda x: length(x)::VARCHAR), '') AS signature, count(*) AS words, min(word) AS example FROM mw GROUP BY 1""",
)
def length_signature(spark, sf):
    v = vocabulary(spark, sf).select("word", mk.length_signature(F.col("word")).alias("signature"))
    return v.groupBy("signature").agg(F.count(F.lit(1)).alias("words"), F.min("word").alias("example"))


SIGN = "array_to_string(list_transform({}, lambda x: length(x)::VARCHAR), '')"


@query(
    "same_ending",
    f"""WITH {VOCAB}, t AS (SELECT DISTINCT {SIGN.format(moras_sql('word'))} AS signature FROM dvocab), r AS (SELECT {SIGN.format(moras_sql('word'))} AS s FROM bvocab),
tt AS (SELECT * FROM t WHERE signature <> ''), rr AS (SELECT s, count(*) AS n FROM r WHERE s <> '' GROUP BY s),
c AS (SELECT signature, sum(n)::BIGINT AS n FROM tt JOIN rr ON right(signature, least(length(signature), length(s))) = right(s, least(length(signature), length(s))) GROUP BY signature)
SELECT signature, coalesce(c.n, (SELECT sum(n) FROM rr))::BIGINT AS candidates, (SELECT sum(n) FROM rr)::BIGINT AS all_refs, c.n IS NOT NULL AS any_fit FROM tt LEFT JOIN c USING (signature)""",
)
def same_ending(spark, sf):
    docs, bench = vocabularies(spark, sf)
    sign = mk.length_signature(F.col("word")).alias("signature")
    t = docs.select(sign).where("signature <> ''")
    return ct.same_ending(t, bench.select(sign).where("signature <> ''"))


@query(
    "marking_variants",
    f"""WITH {MARKED}, n AS (SELECT word, plain, length(regexp_replace(plain, '[^aeiou]', '', 'g')) AS n FROM mw),
o AS (SELECT word, plain, n, unnest([0, n - 1, n, CASE WHEN n >= 2 THEN n - 1 ELSE n END, CASE WHEN n >= 2 THEN n - 1 ELSE n END, CASE WHEN n >= 2 THEN n - 1 ELSE n END]) AS at_, unnest(['L', 'H', 'H', 'LL', 'HL', 'LH']) AS mo, unnest([1, 2, 3, 4, 5, 6]) AS ord FROM n WHERE n >= 1),
oo AS (SELECT word, plain, word || '#' || ord AS id, ord, list_transform(range(1, n + 1), lambda j: CASE WHEN j = at_ THEN mo ELSE 'L' END) AS m FROM o WHERE ord <> 2 OR n >= 2),
{write_sql('oo', 'id, word, ord', 'plain', 'm', 'done')},
alls AS (SELECT word, ord, marked FROM done UNION ALL SELECT word, 1, plain FROM n WHERE n = 0),
u AS (SELECT word, marked AS marking, min(ord) AS ord FROM alls GROUP BY ALL)
SELECT word, row_number() OVER (PARTITION BY word ORDER BY ord)::INTEGER AS rank, marking FROM u""",
)
def marking_variants(spark, sf):
    return mk.marking_variants(vocabulary(spark, sf))


FIT = """CASE WHEN a IS NULL THEN replace(b, 'H', 'L') WHEN NOT own THEN a WHEN length(a) = length(b) THEN a WHEN length(b) = 1 THEN CASE WHEN contains(a, 'H') THEN 'H' ELSE 'L' END WHEN a = 'H' THEN 'HL' ELSE 'LL' END"""
OBEY = """CASE WHEN n = 2 AND length(x) = 1 THEN x || 'L' WHEN n = 1 AND length(x) = 2 THEN CASE WHEN contains(x, 'H') THEN 'H' ELSE 'L' END ELSE x END"""


def vowels_sql(word: str) -> str:
    return f"length(regexp_replace({word}, '[^aeiou]', '', 'g'))"


GUESSED = "CASE " + " ".join(
    f"WHEN starts_with(rp, '{p}') AND length(rp) > {len(p)}{f" AND substr(rp, {len(p) + 1}, 1) <> 'y'" if p in ('in', 'im') else ''} THEN '{p}'" for p in fixed.SPLIT_PREFIXES
) + " ELSE '' END"


def transfer_cte(pairs: str) -> str:
    """From ``pairs(id, reference, target)`` to ``done(id, marked)``."""
    bare = "replace({}, '-', '')"
    return f"""tp AS MATERIALIZED (SELECT id, {plain_sql(bare.format('target'))} AS plain, {plain_sql(bare.format('reference'))} AS rp, {moras_sql(bare.format('reference'))} AS r, {moras_sql(bare.format('target'))} AS t,
  CASE WHEN contains(target, '-') THEN {vowels_sql(plain_sql("split_part(target, '-', 1)"))} END AS tpre, CASE WHEN contains(reference, '-') THEN {vowels_sql(plain_sql("split_part(reference, '-', 1)"))} END AS rpre FROM {pairs}),
tv AS (SELECT id, plain, r, t, {forced_sql('plain')} AS rules, len(list_filter(t, lambda y: length(y) = 2)) > 0 AS own, coalesce(tpre, len(t) - least(len(t), len(r))) AS t0,
  CASE WHEN tpre IS NULL THEN len(r) - least(len(t), len(r)) ELSE coalesce(rpre, {vowels_sql(GUESSED)}) END AS r0 FROM tp),
te AS (SELECT id, plain, i, t[i] AS b, rules[i] AS n, own, CASE WHEN i - 1 >= t0 AND i - 1 - t0 + r0 < len(r) THEN r[i - t0 + r0] END AS a FROM tv, LATERAL (SELECT unnest(range(1, len(t) + 1)) AS i)),
tf AS (SELECT *, {FIT} AS x FROM te), tg AS (SELECT id, plain, i, {OBEY} AS x FROM tf), th AS (SELECT id, plain, list(x ORDER BY i) AS m FROM tg GROUP BY ALL),
{write_sql('th', 'id', 'plain', 'm', 'done')}"""


FAMILY = f"""{MARKED}, fam AS (SELECT word, plain, m, right(plain, 2) AS family FROM mw WHERE len(m) > 0), refs AS (SELECT family, min(word) AS reference FROM fam GROUP BY family),
bare AS (SELECT word, plain, list_transform(m, lambda x: replace(x, 'H', 'L')) AS m, family FROM fam)"""


def family_words(spark, sf):
    w = vocabulary(spark, sf).select("word").where(F.size(mk.moras(F.col("word"))) > 0)
    members = w.select(F.col("word").alias("marked"), F.right(mk.plain(F.col("word")), F.lit(2)).alias("family"))
    return members, members.groupBy("family").agg(F.min("marked").alias("reference"))


@query(
    "transfer",
    f"""WITH {FAMILY}, pr AS (SELECT word AS id, reference, plain AS target FROM fam JOIN refs USING (family)), {transfer_cte('pr')} SELECT id AS word, marked AS marking FROM done""",
)
def transfer(spark, sf):
    """Every word, unmarked, gets the marks of the first word with its last two letters."""
    members, refs = family_words(spark, sf)
    pairs = salted_join(members, refs, ["family"]).withColumn("target", mk.plain(F.col("marked")))
    return mk.transfer(pairs).select(F.col("marked").alias("word"), "marking")


@query(
    "family_accuracy",
    f"""WITH {FAMILY}, bt AS (SELECT word, family, m FROM bare), {write_sql('(SELECT b.word, b.plain, b.m FROM bare b)', 'word', 'plain', 'm', 'un')},
pr AS (SELECT un.word AS id, reference, un.marked AS target FROM un JOIN fam USING (word) JOIN refs USING (family)), {transfer_cte('pr').replace('wl AS', 'wl2 AS').replace('FROM wl)', 'FROM wl2)').replace('wr AS', 'wr2 AS').replace('FROM wr ', 'FROM wr2 ')},
ok AS (SELECT fam.family, {plain_sql('done.marked')} = {plain_sql("replace(fam.word, '-', '')")} AND {moras_sql('done.marked')} = {moras_sql("replace(fam.word, '-', '')")} AS ok FROM done JOIN fam ON fam.word = done.id)
SELECT family, count(*) AS n, count(*) FILTER (WHERE ok) AS reproduced, round(avg(ok::INT), 6) AS share FROM ok GROUP BY family""",
)
def family_accuracy(spark, sf):
    return mk.family_accuracy(*family_words(spark, sf))
