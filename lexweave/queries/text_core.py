"""Text core: lines, sentences, tokens, word counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexweave.operators import corpus_stats, tokens as tk
from lexweave.queries import sqltext as sq
from lexweave.queries.base import documents, query, table
from lexweave.plans.scale import cluster
from lexweave.sources import corpus

FUSED = ["the", "and", "und", "les", "des", "para"]


@query(
    "corpus_lines",
    f"""WITH l AS ({sq.numbered("regexp_split_to_array(text, '\\r?\\n')", "documents", "doc_id", "line_no", "raw")}),
t AS (SELECT doc_id, line_no, {sq.trim('raw')} AS text FROM l)
SELECT doc_id, line_no, text FROM t WHERE text <> '' AND NOT starts_with(text, '#')""",
)
def corpus_lines(spark, sf):
    return corpus.corpus_lines(documents(spark, sf))


@query("sentences", f"WITH {sq.sentences_cte()} SELECT doc_id, sent_no, text FROM sentences")
def sentences(spark, sf):
    return tk.sentences(documents(spark, sf))


@query("sentences_freq", f"WITH {sq.freq_sentences_cte()} SELECT doc_id, sent_no, text FROM fsent")
def sentences_freq(spark, sf):
    return tk.sentences_freq(documents(spark, sf))


@query(
    "tokens",
    f"""WITH {sq.tokens_cte()} SELECT doc_id, sent_no, tok_no, surface, lower, punct_type, preceded_by_apostrophe,
is_initial, is_proper_noun, is_sent_boundary, is_clause_boundary, is_quote_open, is_quote_close FROM tokens""",
)
def tokens(spark, sf):
    return tk.tokens(table(spark, sf, "documents", "doc_id", "text"))


@query(
    "split_fused",
    f"""WITH {sq.sentences_cte()},
f AS (SELECT doc_id, sent_no, regexp_replace(regexp_replace(text, '(^|[^\\p{{L}}])(para|and|des|les|the|und)(\\p{{L}})', '\\1\\2 \\3', 'gi'),
 '(^|[^\\p{{L}}])(para|and|des|les|the|und)(\\p{{L}})', '\\1\\2 \\3', 'gi') AS text FROM sentences),
w AS (SELECT unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS word FROM f)
SELECT word, count(*) AS n FROM w GROUP BY word""",
)
def split_fused(spark, sf):
    """Applied twice: the second pass cuts a form that the first cut laid bare."""
    s = tk.sentences(documents(spark, sf))
    s = tk.split_fused(tk.split_fused(s, FUSED), FUSED)
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1))).alias("word")
    return s.select(words).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


CLEAN = f"""{sq.freq_sentences_cte()},
clean AS (SELECT doc_id, sent_no, text, unnest({sq.freq_words('text')}) AS word FROM fsent)"""


@query("clean_tokens", f"WITH {CLEAN} SELECT doc_id, sent_no, word, count(*) AS n FROM clean GROUP BY ALL")
def clean_tokens(spark, sf):
    """Counted per sentence inside the sentence's own partition: documents are clustered first."""
    s = tk.sentences_freq(cluster(table(spark, sf, "documents", "doc_id", "text"), "doc_id"))
    return tk.clean_tokens(s).groupBy("doc_id", "sent_no", "word").agg(F.count(F.lit(1)).alias("n"))


@query(
    "word_freq",
    f"WITH {sq.tokens_cte()} SELECT lower AS word, count(*) AS n FROM tokens WHERE punct_type IS NULL GROUP BY lower",
)
def word_freq(spark, sf):
    return corpus_stats.word_freq(tk.tokenize(tk.sentences(documents(spark, sf))))


@query(
    "frequent_words",
    f"""WITH {CLEAN}, c AS (SELECT word, count(*) AS n FROM clean GROUP BY word)
SELECT word, n FROM c WHERE n >= 5 AND length(word) >= 2 AND NOT regexp_matches(word, '[qx]')
ORDER BY n DESC, word LIMIT 1000""",
)
def frequent_words(spark, sf):
    return corpus_stats.frequent_words(tk.clean_tokens(tk.sentences_freq(documents(spark, sf))), 5, 1000, 2, "[qx]")


def trigger_sql(mark: str, minimum: int) -> str:
    return f"""{CLEAN},
marked AS (SELECT *, ends_with(text, '{mark}') AS hit, length(text) > 8 AS long FROM clean),
per AS (SELECT word, count(*) FILTER (WHERE hit) AS tc, count(*) FILTER (WHERE NOT hit AND long) AS oc FROM marked GROUP BY word),
tot AS (SELECT greatest(sum(tc), 1) AS t_total, greatest(sum(oc), 1) AS o_total FROM per),
target AS (SELECT count(*) AS n FROM fsent WHERE ends_with(text, '{mark}')),
scored AS (SELECT word, tc, (tc / t_total) / ((oc + 0.5) / o_total) AS ratio, tc * 100.0 / target.n AS coverage
 FROM per, tot, target WHERE tc >= {minimum} AND length(word) >= 2)"""


@query(
    "trigger_words",
    f"""WITH {trigger_sql('!', 4)}
SELECT word, tc AS count, round(ratio, 6)::DOUBLE AS ratio, round(coverage, 6)::DOUBLE AS coverage FROM scored
WHERE NOT regexp_matches(word, '\\d') ORDER BY scored.ratio DESC, tc DESC, scored.coverage DESC, word DESC LIMIT 40""",
)
def trigger_words(spark, sf):
    return corpus_stats.trigger_words(tk.sentences_freq(documents(spark, sf)), mark="!", minimum=4, top=40)


@query(
    "trigger_coverage",
    f"""WITH {trigger_sql('!', 4)},
top AS (SELECT *, row_number() OVER (ORDER BY ratio DESC, tc DESC, coverage DESC, word DESC) AS rk FROM scored),
cand AS (SELECT word, row_number() OVER (ORDER BY rk) AS rank FROM top WHERE rk <= 40 AND NOT regexp_matches(word, '\\d')),
first20 AS (SELECT * FROM cand WHERE rank <= 20),
hits AS (SELECT DISTINCT doc_id, sent_no, word, rank FROM marked JOIN first20 USING (word) WHERE hit),
firsts AS (SELECT doc_id, sent_no, min(rank) AS rank FROM hits GROUP BY ALL)
SELECT f.word, f.rank::INTEGER AS rank, (SELECT count(*) FROM hits h WHERE h.word = f.word) AS alone,
 (SELECT count(*) FROM firsts g WHERE g.rank <= f.rank) AS cumulative,
 round((SELECT count(*) FROM hits h WHERE h.word = f.word) * 100.0 / target.n, 6)::DOUBLE AS pct_alone,
 round((SELECT count(*) FROM firsts g WHERE g.rank <= f.rank) * 100.0 / target.n, 6)::DOUBLE AS pct_cumulative
FROM first20 f, target""",
)
def trigger_coverage(spark, sf):
    return corpus_stats.trigger_coverage(tk.sentences_freq(documents(spark, sf)), mark="!", minimum=4, top=40)


VOCAB = f"""{sq.tokens_cte()}, dvocab AS (SELECT DISTINCT lower AS word FROM tokens WHERE punct_type IS NULL),
bsent AS ({sq.numbered(sq.sentence_list('text'), 'benchmark', 'item_id', 'sent_no', 'text')}),
bvocab AS (SELECT DISTINCT translate(lower(w), 'āēīōū', 'aeiou') AS word FROM (SELECT unnest(regexp_extract_all(text, '[^ \\t\\n\\r{sq.STOPS}''’]+')) AS w FROM bsent))"""


def benchmark_vocabulary(spark, sf):
    bench = table(spark, sf, "benchmark", "item_id", "text")
    return tk.stored_vocabulary(tk.sentences(bench, ids=["item_id"])).select("word")


def vocabularies(spark, sf):
    return tk.stored_vocabulary(tk.sentences(documents(spark, sf))).select("word"), benchmark_vocabulary(spark, sf)


@query(
    "vocab_ops",
    f"""WITH {VOCAB}
SELECT word, CASE WHEN a AND b THEN 'both' WHEN a THEN 'first' ELSE 'second' END AS side FROM
(SELECT word, bool_or(s = 1) AS a, bool_or(s = 2) AS b FROM (SELECT word, 1 AS s FROM dvocab UNION ALL SELECT word, 2 FROM bvocab) GROUP BY word)""",
)
def vocab_ops(spark, sf):
    return corpus_stats.vocab_ops(*vocabularies(spark, sf))


@query("vocab_intersect", f"WITH {VOCAB} SELECT word FROM dvocab INTERSECT SELECT word FROM bvocab")
def vocab_intersect(spark, sf):
    a, b = vocabularies(spark, sf)
    return a.intersect(b)


@query("vocab_except", f"WITH {VOCAB} SELECT word FROM bvocab EXCEPT SELECT word FROM dvocab")
def vocab_except(spark, sf):
    a, b = vocabularies(spark, sf)
    return b.exceptAll(a)


@query(
    "with_context",
    f"""WITH {sq.tokens_cte()}, c AS (SELECT *, lag(lower) OVER w AS prev_lower, lead(lower) OVER w AS next_lower,
 lag(CASE WHEN punct_type IS NULL THEN lower END IGNORE NULLS) OVER w AS prev_word,
 lead(CASE WHEN punct_type IS NULL THEN lower END IGNORE NULLS) OVER w AS next_word,
 coalesce(lag(punct_type) OVER w = 'COMMA', FALSE) AS preceded_by_comma, lead(punct_type) OVER w AS next_punct
 FROM tokens WINDOW w AS (PARTITION BY doc_id, sent_no ORDER BY tok_no))
SELECT doc_id, sent_no, tok_no, lower, prev_lower, next_lower, prev_word, next_word, preceded_by_comma, next_punct FROM c""",
)
def with_context(spark, sf):
    c = tk.with_context(tk.tokens(table(spark, sf, "documents", "doc_id", "text")))
    return c.select(
        "doc_id", "sent_no", "tok_no", "lower", "prev_lower", "next_lower", "prev_word", "next_word",
        "preceded_by_comma", "next_punct",
    )


@query(
    "propagate_proper",
    f"""WITH {sq.tokens_cte()}, names AS (SELECT DISTINCT doc_id, lower FROM tokens WHERE is_proper_noun)
SELECT doc_id, sent_no, tok_no, surface FROM tokens JOIN names USING (doc_id, lower) WHERE punct_type IS NULL""",
)
def propagate_proper(spark, sf):
    t = tk.propagate_proper(tk.tokens(table(spark, sf, "documents", "doc_id", "text")))
    return t.where("is_proper_noun").select("doc_id", "sent_no", "tok_no", "surface")
