"""Vocabulary operators over the words of ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexweave.operators import tokens as tk, vocab as vb
from lexweave.queries import sqltext as sq
from lexweave.queries.base import documents, query, table
from lexweave.sources import fixed

V = f"""{sq.tokens_cte()}, vocab AS (SELECT lower AS word, count(*) AS n FROM tokens WHERE punct_type IS NULL GROUP BY lower)"""


def vocabulary(spark, sf):
    return tk.stored_vocabulary(tk.sentences(documents(spark, sf)))


@query(
    "fold",
    f"""WITH {sq.tokens_cte()}, forms AS (SELECT surface, count(*) AS n FROM tokens WHERE punct_type IS NULL GROUP BY surface)
SELECT translate(lower(surface), 'āēīōū', 'aeiou') AS folded, count(*) AS forms, sum(n)::BIGINT AS n FROM forms GROUP BY 1""",
)
def fold(spark, sf):
    """The words as they are written, in mixed case."""
    words = tk.tokenize(tk.sentences(documents(spark, sf))).where("punct_type IS NULL").groupBy(F.col("surface").alias("word")).agg(F.count(F.lit(1)).alias("n"))
    return vb.fold_words(words).groupBy("folded").agg(F.count(F.lit(1)).alias("forms"), F.sum("n").alias("n"))


@query(
    "hiatus_words",
    f"""WITH {V} SELECT word, n, CASE WHEN p[1] = 'u' THEN 'glide u to w' WHEN p[1] = 'i' THEN 'glide i to y'
 WHEN p = 'ai' THEN 'fuse a+i to e' ELSE 'elide a' END AS repair
FROM (SELECT *, regexp_extract(word, '[aeiou]{{2}}') AS p FROM vocab) WHERE p <> ''""",
)
def hiatus_words(spark, sf):
    return vb.hiatus_words(vocabulary(spark, sf))


@query(
    "bad_clusters",
    f"""WITH {V}, g AS (SELECT word, i::INTEGER AS pos, substr(word, i + 1, 2) AS pair FROM vocab, LATERAL (SELECT unnest(range(0, length(word) - 1)) AS i) )
SELECT word, pos, pair FROM g WHERE regexp_full_match(pair, '[b-df-hj-np-tv-z]{{2}}') AND NOT regexp_matches(pair, '^[mn]|[yw]$|^sh$|^ts$|^pf$')""",
)
def bad_clusters(spark, sf):
    return vb.bad_clusters(vocabulary(spark, sf))


ORTHO_SQL = f"""WITH {V}, g AS (SELECT word, i AS pos, substr(word, i + 1, 1) AS c, substr(word, i + 2, 1) AS c1, substr(word, i + 3, 1) AS c2,
 CASE WHEN i > 0 THEN substr(word, i, 1) ELSE '' END AS b FROM vocab, LATERAL (SELECT unnest(range(0, length(word))) AS i)),
h AS (SELECT word, pos, unnest([
 CASE WHEN c IN ('a','e','i','o','u') AND c1 IN ('a','e','i','o','u') THEN '1.1/2.1:VV_HIATUS' END,
 CASE WHEN c = 'n' THEN CASE c1 WHEN 'f' THEN '3.3.1:NASAL_ASSIM' WHEN 'p' THEN '3.3.2:NASAL_ASSIM' WHEN 'b' THEN '3.3.3:NASAL_ASSIM'
  WHEN 'h' THEN '3.3.4:NASAL_ASSIM' WHEN 'v' THEN '3.3.5:NASAL_ASSIM' WHEN 'c' THEN '3.6.2:C_NOT_SH' END END,
 CASE WHEN c = 'n' AND c1 IN ('m', 'n') AND pos = 1 AND b = 'i' THEN '3.1:NASAL_ELISION' END,
 CASE WHEN c1 = 'y' THEN CASE c WHEN 'd' THEN '3.9.1:CY_UNFUSED' WHEN 'g' THEN '3.9.2:CY_UNFUSED' WHEN 's' THEN '3.9.6:CY_UNFUSED'
  WHEN 'z' THEN '3.9.11:CY_UNFUSED' WHEN 'k' THEN '3.9.7:CY_UNFUSED' WHEN 't' THEN '3.9.10:CY_UNFUSED' END END,
 CASE WHEN c = 'n' AND c1 = 't' AND c2 = 's' THEN '3.6.1:STOP_UNDELETED' WHEN c = 'm' AND c1 = 'p' AND c2 = 'f' THEN '3.6.3:STOP_UNDELETED' END,
 CASE WHEN pos > 0 AND contains(word, 'o') AND c = 'i' AND b NOT IN ('a','e','i','o','u') AND (c1 = 'r' OR (c1 = 's' AND c2 = 'h')) THEN '1.3.1:VOWEL_ASSIM' END,
 CASE WHEN c = 'l' AND strpos(word, 'l') = pos + 1 THEN '2.3:LETTER_L' END]) AS v FROM g)
SELECT word, split_part(v, ':', 1) AS rule_id, split_part(v, ':', 2) AS type, pos::INTEGER AS pos FROM h WHERE v IS NOT NULL"""


@query("ortho_scan", ORTHO_SQL)
def ortho_scan(spark, sf):
    return vb.ortho_scan(vocabulary(spark, sf))


def step_sql(w: str) -> str:
    rx = "^(.*?)(n[fbpvh]|[dgszkt]y|nts|nc|mpf)(.*)$"
    run, head, tail = (f"regexp_extract({w}, '{rx}', {i})" for i in (2, 1, 3))
    simple = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in vb.REPAIRS)
    return f"""CASE WHEN starts_with({w}, 'inm') OR starts_with({w}, 'inn') THEN 'i' || substr({w}, 3)
 WHEN {run} <> '' THEN {head} || CASE WHEN {run} = 'ky' AND ends_with({head}, 'n') THEN 's'
  WHEN {run} = 'ty' AND ends_with({head}, 'a') AND regexp_matches({tail}, '^[aeiou]') THEN 'sh' ELSE CASE {run} {simple} END END || {tail}
 WHEN contains({w}, 'o') THEN regexp_replace({w}, '^(.*?[^aeiou])i(r|sh)(.*)$', '\\1e\\2\\3') ELSE {w} END"""


ROUNDS = ", ".join(
    f"r{i} AS (SELECT word, {step_sql('w')} AS w FROM {'(SELECT word, word AS w FROM vocab)' if i == 1 else f'r{i - 1}'})"
    for i in range(1, 9)
)


@query("ortho_repair", f"WITH {V}, {ROUNDS} SELECT word, w AS fixed, ({step_sql('w')}) = w AS settled FROM r8")
def ortho_repair(spark, sf):
    return vb.ortho_repair(vocabulary(spark, sf))


@query(
    "illegal_l",
    f"""WITH {sq.tokens_cte()} SELECT lower AS word, count(*) AS n FROM tokens
WHERE punct_type IS NULL AND NOT is_proper_noun AND contains(lower, 'l') GROUP BY lower""",
)
def illegal_l(spark, sf):
    t = tk.tokens(table(spark, sf, "documents", "doc_id", "text"))
    return vb.illegal_l(t).groupBy(F.col("lower").alias("word")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "check_spelling",
    f"""WITH {V}, m AS (SELECT word AS plain, replace(replace(word, 'a', 'áa'), 'ee', 'êê') AS marked FROM vocab)
SELECT plain, marked FROM m WHERE list_reduce(['aa', 'ee', 'ii', 'oo', 'uu'], lambda t, p: replace(t, p, p[1]),
 translate(lower(marked), 'áéíóúâêîôû-', 'aeiouaeiou')) <> lower(plain)""",
)
def check_spelling(spark, sf):
    """Annotations made from the words by doubling each a; words with a doubled vowel no longer spell."""
    words = vocabulary(spark, sf).select(F.col("word").alias("plain"))
    marked = words.withColumn("marked", F.replace(F.replace("plain", F.lit("a"), F.lit("áa")), F.lit("ee"), F.lit("êê")))
    return vb.check_spelling(marked, "plain", "marked")


PHON = sq.values(fixed.PHONEMES, "grapheme, token, ipa")
GRAPHEMES = "|".join(g for g, _, _ in fixed.PHONEMES)


@query(
    "phonemes",
    f"""WITH {V}, p AS ({sq.numbered(f"regexp_extract_all(word, '{GRAPHEMES}')", "vocab", "word", "pos", "grapheme")})
SELECT word, pos, grapheme, token, ipa FROM p JOIN {PHON} t USING (grapheme)""",
)
def phonemes(spark, sf):
    return vb.phonemes(vocabulary(spark, sf))


@query(
    "phoneme_profile",
    f"""WITH g AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{GRAPHEMES}')) AS grapheme FROM documents),
c AS (SELECT doc_id, token, count(*) AS n FROM g JOIN {PHON} t USING (grapheme) GROUP BY ALL)
SELECT doc_id, token, n, round(n / sum(n) OVER (PARTITION BY doc_id), 6)::DOUBLE AS share FROM c""",
)
def phoneme_profile(spark, sf):
    return vb.phoneme_profile(documents(spark, sf))


def normalize_sql(text: str) -> str:
    units = "[" + ", ".join(f"'{u}'" for u in fixed.UNITS) + "]"
    tens = "[" + ", ".join(f"'{t}'" for t in fixed.TENS) + "]"
    v = "TRY_CAST(p AS BIGINT)"
    th, hu, te, un = f"({v} // 1000)", f"({v} // 100 % 10)", f"({v} // 10 % 10)", f"({v} % 10)"
    number = f"""CASE WHEN {v} = 0 THEN 'zeru' ELSE array_to_string(list_filter([
 CASE WHEN {th} = 1 THEN 'igihumbi' WHEN {th} > 1 THEN 'ibihumbi ' || {units}[{th} + 1] END,
 CASE WHEN {hu} = 1 THEN 'ijana' WHEN {hu} > 1 THEN 'amagana ' || {units}[{hu} + 1] END,
 CASE WHEN {te} > 0 THEN {tens}[{te} + 1] END, CASE WHEN {un} > 0 THEN {units}[{un} + 1] END], lambda x: x IS NOT NULL), ' na ') END"""
    short = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in fixed.ABBREVIATIONS)
    whole = f"regexp_replace(regexp_replace(regexp_replace({text}, '([nNyY])''', '\\1a ', 'g'), '([kKmM])''', '\\1u ', 'g'), '([A-Za-z])''', '\\1 ', 'g')"
    pieces = f"regexp_extract_all({whole}, '[0-9]+|[A-Za-z]+|[^0-9A-Za-z]+')"
    said = f"""array_to_string(list_transform({pieces}, lambda p: CASE WHEN regexp_full_match(p, '[0-9]+') THEN
 CASE WHEN {v} <= 9999 THEN {number} ELSE p END WHEN regexp_full_match(p, '[A-Za-z]+') THEN CASE lower(p) {short} ELSE p END ELSE p END), '')"""
    marks = f"regexp_replace(regexp_replace(regexp_replace({said}, '[.!?]', ' .', 'g'), ',', ' ,', 'g'), '[-;:]', ' ', 'g')"
    return f"trim(regexp_replace({marks}, '[ \\t\\n\\r]+', ' ', 'g'), ' ')"


@query("normalize_corpus", f"SELECT doc_id, {normalize_sql('text')} AS text FROM documents")
def normalize_corpus(spark, sf):
    return vb.normalize_corpus(documents(spark, sf))


@query(
    "phonemize",
    f"""WITH n AS (SELECT doc_id, lower({normalize_sql('text')}) AS t FROM documents),
w AS ({sq.numbered("regexp_split_to_array(t, '[ \\t]+')", "n", "doc_id", "wno", "word")}),
p AS (SELECT doc_id, wno, word, unnest(range(1, len(l) + 1)) AS pos, unnest(l) AS grapheme FROM (SELECT *, regexp_extract_all(word, '{GRAPHEMES}|[.]|,') AS l FROM w)),
s AS (SELECT doc_id, wno, string_agg(coalesce(token, grapheme), ' ' ORDER BY pos) AS said FROM p LEFT JOIN {PHON} t USING (grapheme) GROUP BY ALL)
SELECT d.doc_id, coalesce(string_agg(said, ' | ' ORDER BY wno), '') AS phonemes FROM documents d LEFT JOIN s USING (doc_id) GROUP BY ALL""",
)
def phonemize(spark, sf):
    return vb.normalize_corpus(documents(spark, sf)).select(
        "doc_id", vb.phoneme_string(F.col("text")).alias("phonemes")
    )
