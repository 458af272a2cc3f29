"""Grammar and punctuation rules over ``documents``, tagged with the sample word lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexweave.operators import lexicon as lx, report as rp, rules as ru, tokens as tk
from lexweave.queries import sample_lexicon as sl, sqltext as sq
from lexweave.queries.base import query, table
from lexweave.queries.lexicon import INV, KNO, PRO, first, lst, sample_dims
from lexweave.sources.dimensions import first_hits

TABLES = ru.RuleTables(
    roles=tuple(sl.ROLES),
    connectors=tuple(sl.CONNECTORS),
    elided=(("d", 2), ("l", 4)),
    elision=tuple(sl.ELISION),
    concords=tuple((c, p) for p, c, *_ in sl.PREFIXES),
    place_copula=(("in", "inne"), ("on", "onne")),
    place_long=("en",),
    destination=("at",),
    walk_stems=("retion", "tion", "ere", "and", "heth"),
    go_stems=("th", "re", "er", "on", "an", "st"),
)


def sample_tokens(spark, sf, docs=None):
    """Tokens with tags, all in place: three broadcast joins and column rules, no shuffle of tokens."""
    t = tk.tokens(docs if docs is not None else table(spark, sf, "documents", "doc_id", "text"))
    inv, pro, kno = (first_hits(d) for d in sample_dims(spark))
    inv = F.broadcast(inv.select(F.col("word").alias("lower"), F.col("pos").alias("_i")))
    pro = F.broadcast(
        pro.select(F.col("word").alias("lower"), F.col("pron_type").alias("_pt"), F.col("noun_class").alias("_pc"))
    )
    kno = F.broadcast(
        kno.select(F.col("word").alias("lower"), F.col("noun_class").alias("_kc"), F.col("stem").alias("_ks"))
    )
    j = t.join(inv, "lower", "left").join(pro, "lower", "left").join(kno, "lower", "left")
    low, n = F.col("lower"), F.length("lower")
    is_word = F.col("punct_type").isNull()
    j = j.withColumn("_c", F.when(is_word, lx.noun_class_column(low, sl.PREFIXES)))
    kind = (
        F.when(~is_word, "PUNCTUATION").when(low.rlike("^[0-9]+$"), "NUMBER").when(F.col("_i").isNotNull(), F.col("_i"))
        .when(F.col("_pt").isNotNull(), "PRONOUN").when(F.col("_ks").isNotNull(), "NOUN")
        .when(low.endswith(sl.VERB_ENDING), "VERB_CONJ").when(low.endswith(sl.ADJ_ENDING), "ADJECTIVE")
        .when(low.endswith(sl.INF_ENDING) & (n >= 5), "VERB_INF").when(F.col("_c").isNotNull(), "NOUN").otherwise("FOREIGN")
    )
    j = j.withColumn("pos", kind)
    open_verb = (F.col("pos") == "VERB_CONJ") & F.col("_i").isNull()
    tense = F.element_at(
        F.array(F.lit("PRESENT"), F.lit("PAST_PERF"), F.lit("SUBJUNCTIVE"), F.lit("FUTURE")), n % 4 + 1
    )
    return j.select(
        *t.columns, "pos",
        F.when(F.col("pos") == "PRONOUN", F.col("_pt")).alias("pron_type"),
        F.when(F.col("pos") == "PRONOUN", F.col("_pc")).when(F.col("_ks").isNotNull() & (F.col("pos") == "NOUN"), F.col("_kc"))
        .when(F.col("_i").isNull() & F.col("pos").isin("NOUN", "VERB_CONJ", "ADJECTIVE"), F.col("_c")).alias("noun_class"),
        F.when(open_verb, F.expr("left(lower, length(lower) - 3)")).when(F.col("pos") == "ADJECTIVE", F.expr("left(lower, length(lower) - 2)"))
        .otherwise(F.col("_ks")).alias("stem"),
        F.when(open_verb, tense).alias("verb_tense"),
        F.when(open_verb & (n > 6), n % 12 + 1).alias("obj_class"),
    )


def class_case(word: str) -> str:
    arms = []
    for p, c, n, after, ending, _ in sl.PREFIXES:
        cond = f"starts_with({word}, '{p}') AND length({word}) >= {n}"
        nxt = f"substr({word}, {len(p) + 1}, 1)"
        if after == "V":
            cond += f" AND {nxt} IN ('a','e','i','o','u')"
        if after == "C":
            cond += f" AND {nxt} <> '' AND {nxt} NOT IN ('a','e','i','o','u')"
        if ending == "N":
            cond += f" AND right({word}, 1) NOT IN ('a', 'e')"
        arms.append(f"WHEN {cond} THEN {c}")
    return "CASE " + " ".join(arms) + " END"


TAGGED = f"""{sq.tokens_cte()},
j AS (SELECT t.*, i.pos AS i_pos, p.pron_type AS p_type, p.noun_class AS p_class, k.noun_class AS k_class, k.stem AS k_stem,
 CASE WHEN punct_type IS NULL THEN {class_case('lower')} END AS o_class
 FROM tokens t LEFT JOIN {first(sl.INVARIABLES, INV)} i ON t.lower = i.word LEFT JOIN {first(sl.PRONOUNS, PRO)} p ON t.lower = p.word
 LEFT JOIN {first(sl.KNOWN_WORDS, KNO)} k ON t.lower = k.word),
j2 AS (SELECT *, CASE WHEN punct_type IS NOT NULL THEN 'PUNCTUATION' WHEN regexp_full_match(lower, '[0-9]+') THEN 'NUMBER' WHEN i_pos IS NOT NULL THEN i_pos
 WHEN p_type IS NOT NULL THEN 'PRONOUN' WHEN k_stem IS NOT NULL THEN 'NOUN' WHEN ends_with(lower, 'ing') THEN 'VERB_CONJ' WHEN ends_with(lower, 'ed') THEN 'ADJECTIVE'
 WHEN ends_with(lower, 'er') AND length(lower) >= 5 THEN 'VERB_INF' WHEN o_class IS NOT NULL THEN 'NOUN' ELSE 'FOREIGN' END AS pos FROM j),
tagged AS MATERIALIZED (SELECT doc_id, sent_no, tok_no, surface, lower, punct_type, is_sent_boundary, is_clause_boundary, is_proper_noun, preceded_by_apostrophe, pos,
 CASE WHEN pos = 'PRONOUN' THEN p_type END AS pron_type,
 CASE WHEN pos = 'PRONOUN' THEN p_class WHEN k_stem IS NOT NULL AND pos = 'NOUN' THEN k_class WHEN i_pos IS NULL AND pos IN ('NOUN', 'VERB_CONJ', 'ADJECTIVE') THEN o_class END AS noun_class,
 CASE WHEN pos = 'VERB_CONJ' AND i_pos IS NULL THEN left(lower, length(lower) - 3) WHEN pos = 'ADJECTIVE' THEN left(lower, length(lower) - 2) ELSE k_stem END AS stem,
 CASE WHEN pos = 'VERB_CONJ' AND i_pos IS NULL THEN ['PRESENT', 'PAST_PERF', 'SUBJUNCTIVE', 'FUTURE'][length(lower) % 4 + 1] END AS verb_tense,
 CASE WHEN pos = 'VERB_CONJ' AND i_pos IS NULL AND length(lower) > 6 THEN length(lower) % 12 + 1 END AS obj_class FROM j2)"""


def role(col: str, *names: str) -> str:
    words = sorted({w for w, r in sl.ROLES if r in names})
    return f"coalesce({col} IN {lst(words)}, FALSE)"


def conn(cls: str) -> str:
    return f"CASE {cls} " + " ".join(f"WHEN {c} THEN '{w}'" for c, w in sl.CONNECTORS) + " END"


# Plain words come numbered by their own count, so "next word" is an equi-join in the oracle and not a window
WORDS = f"""{TAGGED}, me AS (SELECT *, tok_no AS tn FROM tagged),
wn AS (SELECT *, count(*) FILTER (WHERE punct_type IS NULL) OVER (PARTITION BY doc_id, sent_no ORDER BY tok_no) AS wno FROM me),
pw AS (SELECT * FROM wn WHERE punct_type IS NULL)"""


def nth(alias: str, offset: int) -> str:
    return f"LEFT JOIN me {alias} ON {alias}.doc_id = t.doc_id AND {alias}.sent_no = t.sent_no AND {alias}.tok_no = t.tok_no + {offset}"


def word_at(alias: str, shift_word: int, shift_mark: int) -> str:
    return (
        f"LEFT JOIN pw {alias} ON {alias}.doc_id = t.doc_id AND {alias}.sent_no = t.sent_no AND {alias}.wno = t.wno + "
        f"CASE WHEN t.punct_type IS NULL THEN {shift_word} ELSE {shift_mark} END"
    )


CTX = f"""{WORDS}, ctx AS MATERIALIZED (SELECT t.*, p1.pos AS p1_pos, p1.noun_class AS p1_class, p1.punct_type AS p1_kind, p1.lower AS p1_lower,
 p2.pos AS p2_pos, p2.noun_class AS p2_class, p2.pron_type AS p2_type, p2.lower AS p2_lower, p3.pos AS p3_pos, p3.noun_class AS p3_class,
 n1.pos AS n1_pos, n1.lower AS n1_lower, n1.punct_type AS n1_kind, n1.tn AS n1_tok, n1.noun_class AS n1_class, n1.pron_type AS n1_type,
 pc.pos AS pc_pos, pc.stem AS pc_stem, pc.tn AS pc_tok, nc.pos AS nc_pos, nc.pron_type AS nc_type, nc.lower AS nc_lower, nc.tn AS nc_tok, nc.is_proper_noun AS nc_proper,
 nc2.pos AS nc2_pos, nc2.is_proper_noun AS nc2_proper
 FROM wn t {nth('p1', -1)} {nth('p2', -2)} {nth('p3', -3)} {nth('n1', 1)} {word_at('pc', -1, 0)} {word_at('nc', 1, 1)} {word_at('nc2', 2, 2)})"""

GLIDE = "regexp_replace(regexp_replace(regexp_replace(c, '^ki$', 'cy'), 'u$', 'w'), 'i$', 'y')"
CONCORD = "CASE p1_class " + " ".join(f"WHEN {c} THEN '{p}'" for p, c, *_ in sl.PREFIXES) + " END"
POSS_TYPES = "('POSSESSIVE', 'REFLEXIVE')"
W5_SQL = f"""SELECT doc_id, sent_no, tok_no, 'ADJ_AGREEMENT' AS type,
 CASE WHEN stem IS NOT NULL THEN (CASE WHEN regexp_matches(stem, '^[aeiou]') AND p1_class IN (1,3,4,7,8,11,13,14,15) THEN {GLIDE.replace('(c,', '(' + CONCORD + ',')} ELSE {CONCORD} END) || stem END AS corrected_word
 FROM ctx WHERE p1_pos = 'NOUN' AND pos = 'ADJECTIVE' AND p1_class <> noun_class
UNION ALL SELECT doc_id, sent_no, tok_no, 'POSS_AGREEMENT', NULL FROM ctx WHERE p1_pos = 'NOUN' AND p1_class IS NOT NULL AND pos = 'PRONOUN' AND pron_type IN {POSS_TYPES} AND noun_class IS NOT NULL
 AND NOT ((p1_class = 9 AND noun_class = 10) OR (p1_class = 10 AND noun_class = 9)) AND ({conn('p1_class')}) <> ({conn('noun_class')})
 AND NOT coalesce((CASE WHEN p2_pos = 'PRONOUN' AND p2_type IN {POSS_TYPES} THEN ({conn('p2_class')}) WHEN p2_pos = 'CONJUNCTION' THEN CASE p2_lower WHEN 'd' THEN 'de' WHEN 'l' THEN 'la' END END) = ({conn('noun_class')})
  AND p3_pos = 'NOUN' AND ({conn('p3_class')}) = ({conn('noun_class')}), FALSE)"""


def compat(a: str, b: str) -> str:
    return (
        f"({a} = {b} OR ({a} IN (1,3) AND {b} IN (1,3)) OR ({a} IN (4,9) AND {b} IN (4,9)) OR ({a} IN (9,10) AND {b} IN (9,10)) "
        f"OR ({b} = 6 AND {a} IN (1,3,9)))"
    )


SKIP = """CASE WHEN punct_type IS NOT NULL THEN NOT (is_sent_boundary OR is_clause_boundary) ELSE pos IN ('ADJECTIVE','ADVERB','CONJUNCTION','LOCATIVE','PRONOUN') END"""
W6_CTE = f"""sg AS (SELECT *, sum(is_sent_boundary::INT) OVER (PARTITION BY doc_id, sent_no ORDER BY tok_no) - is_sent_boundary::INT AS seg FROM tagged),
stops AS (SELECT v.doc_id, v.sent_no, v.tok_no AS vtok, v.noun_class AS vc, max(s.tok_no) AS stok FROM sg v JOIN sg s ON s.doc_id = v.doc_id AND s.sent_no = v.sent_no AND s.tok_no < v.tok_no AND NOT ({SKIP.replace('punct_type', 's.punct_type').replace('is_sent_boundary', 's.is_sent_boundary').replace('is_clause_boundary', 's.is_clause_boundary').replace(' pos ', ' s.pos ')})
 WHERE v.pos = 'VERB_CONJ' AND v.noun_class IS NOT NULL GROUP BY ALL),
cand AS (SELECT st.*, s.noun_class AS nc, s.seg FROM stops st JOIN sg s ON s.doc_id = st.doc_id AND s.sent_no = st.sent_no AND s.tok_no = st.stok WHERE s.pos = 'NOUN' AND s.noun_class IS NOT NULL AND NOT {compat('s.noun_class', 'st.vc')})"""
W6_SQL = f"""SELECT doc_id, sent_no, vtok AS tok_no, 'SUBJ_VERB_AGREEMENT' AS type, NULL AS corrected_word FROM cand c
 WHERE NOT EXISTS (SELECT 1 FROM sg r WHERE r.doc_id = c.doc_id AND r.sent_no = c.sent_no AND r.seg = c.seg AND r.tok_no < c.stok AND r.pos IN ('NOUN', 'VERB_CONJ') AND {compat('r.noun_class', 'c.vc')})
 AND NOT (vc = 2 AND nc IN (1, 3) AND EXISTS (SELECT 1 FROM sg r JOIN sg k ON k.doc_id = r.doc_id AND k.sent_no = r.sent_no AND k.seg = r.seg AND k.pos = 'CONJUNCTION' AND k.tok_no > r.tok_no
  WHERE r.doc_id = c.doc_id AND r.sent_no = c.sent_no AND r.seg = c.seg AND k.tok_no < c.stok AND r.pos IN ('NOUN', 'VERB_CONJ') AND r.noun_class IN (1, 3)))"""

BOUND = "(is_sent_boundary OR is_clause_boundary)"
W7_CTE = f"""pq AS (SELECT t.doc_id, t.sent_no, t.tok_no FROM ctx t LEFT JOIN me b ON b.doc_id = t.doc_id AND b.sent_no = t.sent_no AND b.tok_no = t.tok_no - 1
 WHERE t.pos = 'VERB_PARTICLE' AND {role('t.lower', 'PURPOSE')} AND ((t.pc_pos = 'VERB_INF' AND t.pc_stem = 'gir') OR (t.tok_no > 1 AND NOT (b.is_sent_boundary OR b.is_clause_boundary)))),
aft AS (SELECT DISTINCT v.doc_id, v.sent_no, v.tok_no FROM pq JOIN me v ON v.doc_id = pq.doc_id AND v.sent_no = pq.sent_no AND v.tok_no > pq.tok_no AND v.tok_no <= pq.tok_no + 4
 WHERE v.pos = 'VERB_CONJ' AND v.verb_tense IN ('PRESENT','PRESENT_NORA','PAST_PERF','PAST_IMPF','FUTURE')
 AND NOT EXISTS (SELECT 1 FROM me b WHERE b.doc_id = v.doc_id AND b.sent_no = v.sent_no AND b.tok_no > pq.tok_no AND b.tok_no < v.tok_no
  AND NOT CASE WHEN b.punct_type IS NOT NULL THEN NOT (b.is_sent_boundary OR b.is_clause_boundary) ELSE b.pos IN ('NOUN', 'PRONOUN') END))"""
W7_SQL = "SELECT doc_id, sent_no, tok_no, 'WRONG_VERB_MOOD' AS type, NULL AS corrected_word FROM aft"

COMMON = "(nc_pos = 'NOUN' AND NOT nc_proper)"
W8_SQL = f"""SELECT doc_id, sent_no, tok_no, 'VOWEL_HIATUS' AS type, NULL AS corrected_word FROM ctx WHERE punct_type IS NULL AND lower IN {lst([f for f, _ in sl.ELISION])}
 AND n1_tok IS NOT NULL AND n1_kind IS NULL AND n1_pos <> 'NUMBER' AND regexp_matches(n1_lower, '^[aeiou]')
UNION ALL SELECT doc_id, sent_no, tok_no, 'WRONG_LOCATIVE', NULL FROM ctx WHERE pos = 'LOCATIVE' AND ((lower IN ('in', 'on') AND nc_pos = 'PRONOUN' AND nc_type = 'PERSONAL') OR (lower = 'en' AND {COMMON}))
UNION ALL SELECT doc_id, sent_no, tok_no, 'VERB_SELECTION', NULL FROM ctx WHERE pos = 'VERB_CONJ' AND stem IN {lst(TABLES.walk_stems)} AND ({COMMON} OR (nc_pos = 'LOCATIVE' AND nc_lower = 'at' AND (nc2_proper OR nc2_pos = 'NOUN')))
UNION ALL SELECT doc_id, sent_no, tok_no, 'MISSING_LOCATIVE', NULL FROM ctx WHERE pos = 'VERB_CONJ' AND stem IN {lst(TABLES.go_stems)} AND {COMMON}"""

VERB2 = "('VERB_CONJ', 'VERB_INF')"
NOCOMMA = "punct_type IS NULL AND tok_no > 1 AND p1_kind IS DISTINCT FROM 'COMMA'"
W10_SQL = f"""SELECT doc_id, sent_no, tok_no, 'MISSING_COMMA' AS type, NULL AS corrected_word FROM ctx WHERE {NOCOMMA} AND {role('lower', 'ADVERSATIVE')}
UNION ALL SELECT doc_id, sent_no, tok_no, 'MISSING_COMMA', NULL FROM ctx WHERE {NOCOMMA} AND {role('lower', 'COORDINATOR')} AND pc_pos IN {VERB2} AND nc_pos IN {VERB2}
UNION ALL SELECT doc_id, sent_no, tok_no, 'MISSING_COMMA', NULL FROM ctx WHERE {NOCOMMA} AND {role('lower', 'SEQUENTIAL')} AND pc_pos = 'VERB_CONJ'
UNION ALL SELECT doc_id, sent_no, tok_no, 'EXTRA_PUNCT', NULL FROM ctx WHERE punct_type = 'COMMA' AND pc_pos = 'NOUN' AND nc_pos = 'ADJECTIVE'"""

LIGHT = "('INTERJECTION','ADVERB','ADVERB_TIME','VERB_PARTICLE','CONJUNCTION')"
NOMINAL = "('NOUN','RELATIVE_NOUN','ADJECTIVE','PRONOUN','ADVERB','ADVERB_TIME','LOCATIVE','PREPOSITION')"
SENT_CTE = f"""sf AS MATERIALIZED (SELECT doc_id, sent_no, max(tok_no) AS last_tok, max(tok_no) FILTER (WHERE punct_type IS NULL) AS last_word,
 max(tok_no) FILTER (WHERE NOT is_sent_boundary) AS last_inner, max(tok_no) FILTER (WHERE is_sent_boundary) AS final_tok, arg_max(punct_type, tok_no) FILTER (WHERE is_sent_boundary) AS final_kind,
 bool_or(pos IN {VERB2}) AS has_verb, bool_or(punct_type IS NULL AND {role('lower', 'INTERROGATIVE')}) AS asks,
 bool_or(punct_type IS NULL AND {role('lower', 'EXCLAMATIVE')}) OR coalesce({role("arg_min(lower, tok_no) FILTER (WHERE punct_type IS NULL)", 'INITIAL_EXCLAMATIVE')}, FALSE) AS exclaims,
 count(*) FILTER (WHERE punct_type IS NULL AND pos <> 'NUMBER') AS content_count, bool_and(punct_type IS NOT NULL OR pos IN {LIGHT}) AS all_light,
 bool_or(pos IN ('NOUN', 'RELATIVE_NOUN')) AND bool_or(pos = 'ADJECTIVE') AND bool_and(punct_type IS NOT NULL OR pos = 'NUMBER' OR pos IN {NOMINAL}) AS is_nominal,
 count(*) FILTER (WHERE punct_type = 'QUOTE_OPEN') AS qo, count(*) FILTER (WHERE punct_type = 'QUOTE_CLOSE') AS qc, count(*) FILTER (WHERE punct_type = 'PAREN_OPEN') AS po,
 count(*) FILTER (WHERE punct_type = 'PAREN_CLOSE') AS pcl, count(*) FILTER (WHERE punct_type = 'DASH' AND pc_tok IS NOT NULL AND nc_tok IS NOT NULL) AS dashes FROM ctx GROUP BY doc_id, sent_no)"""
MISSING_VERB = "(NOT has_verb AND NOT (all_light OR content_count <= 1 OR is_nominal))"
A7_SQL = """SELECT doc_id, sent_no, coalesce(last_inner, 1) AS tok_no, 'UNBALANCED_QUOTE' AS type, NULL AS corrected_word FROM sf WHERE qo <> qc
UNION ALL SELECT doc_id, sent_no, coalesce(last_inner, 1), 'UNBALANCED_PAREN', NULL FROM sf WHERE po <> pcl
UNION ALL SELECT doc_id, sent_no, coalesce(last_inner, 1), 'WRONG_PUNCT', NULL FROM sf WHERE dashes % 2 = 1"""
A8_SQL = """SELECT doc_id, sent_no, final_tok AS tok_no, 'MISSING_QMARK' AS type, NULL AS corrected_word FROM sf WHERE asks AND final_kind = 'PERIOD'
UNION ALL SELECT doc_id, sent_no, final_tok, 'MISSING_EXCLAIM', NULL FROM sf WHERE exclaims AND NOT asks AND final_kind = 'PERIOD'
UNION ALL SELECT doc_id, sent_no, last_word, 'MISSING_PERIOD', NULL FROM sf WHERE final_tok IS NULL AND last_word IS NOT NULL"""
PRED = f"(x.pos = 'VERB_CONJ' OR {role('x.lower', 'COPULA')})"
SAME = "x.doc_id = t.doc_id AND x.sent_no = t.sent_no"
ENDS = "(y.is_sent_boundary OR y.punct_type = 'SEMICOLON')"
BETWEEN = f"NOT EXISTS (SELECT 1 FROM me y WHERE y.doc_id = t.doc_id AND y.sent_no = t.sent_no AND {ENDS} AND y.tok_no > least(x.tok_no, t.tok_no) AND y.tok_no < greatest(x.tok_no, t.tok_no))"
W11_CTE = """dep AS (SELECT doc_id, sent_no, tok_no, punct_type, sum(CASE punct_type WHEN 'PAREN_OPEN' THEN 1 WHEN 'PAREN_CLOSE' THEN -1 ELSE 0 END) OVER (PARTITION BY doc_id, sent_no ORDER BY tok_no) AS depth FROM me)"""
W11_SQL = f"""SELECT doc_id, sent_no, tok_no, 'MISSING_COLON' AS type, NULL AS corrected_word FROM ctx WHERE punct_type IS NULL AND {role('lower', 'SPEECH')} AND NOT coalesce(n1_kind IN ('COLON', 'QUOTE_OPEN'), FALSE)
UNION ALL SELECT t.doc_id, t.sent_no, t.tok_no, 'MISSING_COLON', NULL FROM ctx t JOIN sf USING (doc_id, sent_no) WHERE punct_type IS NULL AND {role('lower', 'LIST_PREDICATE')} AND nc_tok IS NULL AND final_kind = 'PERIOD'
UNION ALL SELECT doc_id, sent_no, tok_no, 'WRONG_PUNCT', NULL FROM ctx WHERE punct_type = 'SEMICOLON' AND {role('nc_lower', 'ADVERSATIVE', 'COORDINATOR', 'SEQUENTIAL')}
UNION ALL SELECT doc_id, sent_no, tok_no, 'WRONG_PUNCT', NULL FROM ctx t WHERE punct_type = 'SEMICOLON' AND NOT (EXISTS (SELECT 1 FROM me x WHERE {SAME} AND x.tok_no < t.tok_no AND {PRED} AND {BETWEEN})
 AND EXISTS (SELECT 1 FROM me x WHERE {SAME} AND x.tok_no > t.tok_no AND {PRED} AND {BETWEEN}))
UNION ALL SELECT d.doc_id, d.sent_no, d.tok_no, 'WRONG_PUNCT', NULL FROM dep d JOIN sf USING (doc_id, sent_no) WHERE d.punct_type IN ('PERIOD','QUESTION','EXCLAIM') AND d.depth > 0
 AND last_word > (SELECT min(z.tok_no) FROM dep z WHERE z.doc_id = d.doc_id AND z.sent_no = d.sent_no AND z.tok_no > d.tok_no AND z.punct_type = 'PAREN_CLOSE' AND z.depth = 0)"""
WORD_SQL = """SELECT doc_id, sent_no, tok_no, 'UNKNOWN_WORD' AS type, NULL AS corrected_word FROM me WHERE pos = 'FOREIGN' AND NOT is_proper_noun
UNION ALL SELECT doc_id, sent_no, tok_no, 'VOWEL_HIATUS', NULL FROM me WHERE punct_type IS NULL AND NOT is_proper_noun AND pos NOT IN ('FOREIGN', 'INTERJECTION') AND regexp_matches(lower, '[aeiou]{2}')
UNION ALL SELECT doc_id, sent_no, tok_no, 'SPELLING', NULL FROM me WHERE punct_type IS NULL AND NOT is_proper_noun AND pos <> 'FOREIGN' AND contains(lower, 'l')"""
NO_VERB_SQL = f"SELECT doc_id, sent_no, -1 AS tok_no, 'NO_VERB' AS type, NULL AS corrected_word FROM sf WHERE {MISSING_VERB}"

COLS = "doc_id, sent_no::INTEGER AS sent_no, tok_no::INTEGER AS tok_no, type, corrected_word::VARCHAR AS corrected_word"
ALL_CTE = f"{CTX}, {W6_CTE}, {W7_CTE}, {SENT_CTE}, {W11_CTE}"
ERRORS_CTE = f"""{ALL_CTE}, errors AS MATERIALIZED (SELECT {COLS} FROM (""" + " UNION ALL ".join(
    f"({q})" for q in (W5_SQL, W6_SQL, W7_SQL, W8_SQL, W10_SQL, W11_SQL, A7_SQL, A8_SQL, WORD_SQL, NO_VERB_SQL)
) + "))"


@query("agreement", f"WITH {CTX} SELECT {COLS} FROM ({W5_SQL})")
def agreement(spark, sf):
    return ru.agreement(sample_tokens(spark, sf), TABLES)


@query("subject_verb", f"WITH {TAGGED}, {W6_CTE} SELECT {COLS} FROM ({W6_SQL})")
def subject_verb(spark, sf):
    return ru.subject_verb(sample_tokens(spark, sf))


@query("clause_rules", f"WITH {CTX}, {W7_CTE} SELECT {COLS} FROM ({W7_SQL})")
def clause_rules(spark, sf):
    return ru.clause_rules(sample_tokens(spark, sf), TABLES)


@query("pair_rules", f"WITH {CTX} SELECT {COLS} FROM ({W8_SQL})")
def pair_rules(spark, sf):
    return ru.pair_rules(sample_tokens(spark, sf), TABLES)


@query("comma_rules", f"WITH {CTX} SELECT {COLS} FROM ({W10_SQL})")
def comma_rules(spark, sf):
    return ru.comma_rules(sample_tokens(spark, sf), TABLES)


@query("clause_punct", f"WITH {CTX}, {SENT_CTE}, {W11_CTE} SELECT {COLS} FROM ({W11_SQL})")
def clause_punct(spark, sf):
    return ru.clause_punct(sample_tokens(spark, sf), TABLES)


# The sample text is balanced, so the check reads it with some closing marks taken out
DROPPED = [(") 5", " 5"), ('" ', " ")]
UNBALANCED = "documents"
for _old, _new in DROPPED:
    UNBALANCED = f"(SELECT doc_id, replace(text, '{_old}', '{_new}') AS text FROM {UNBALANCED})"


@query(
    "balance_check",
    f"WITH {CTX}, {SENT_CTE} SELECT {COLS} FROM ({A7_SQL})".replace("FROM documents)", f"FROM {UNBALANCED})"),
)
def balance_check(spark, sf):
    docs = table(spark, sf, "documents", "doc_id", "text")
    for old, new in DROPPED:
        docs = docs.withColumn("text", F.replace("text", F.lit(old), F.lit(new)))
    return ru.balance_check(sample_tokens(spark, sf, docs))


@query("terminal_check", f"WITH {CTX}, {SENT_CTE} SELECT {COLS} FROM ({A8_SQL})")
def terminal_check(spark, sf):
    return ru.terminal_check(sample_tokens(spark, sf), TABLES)


@query(
    "sentence_flags",
    f"""WITH {CTX}, {SENT_CTE} SELECT doc_id, sent_no::INTEGER AS sent_no, last_tok::INTEGER AS token_count, has_verb, all_light,
content_count::INTEGER AS content_count, is_nominal, {MISSING_VERB} AS missing_verb FROM sf""",
)
def sentence_flags(spark, sf):
    return ru.sentence_flags(sample_tokens(spark, sf), TABLES)


@query(
    "gram_roles",
    f"""WITH {TAGGED}, me AS (SELECT * FROM tagged),
mk AS (SELECT t.doc_id, t.sent_no, t.tok_no FROM me t LEFT JOIN me b ON b.doc_id = t.doc_id AND b.sent_no = t.sent_no AND b.tok_no = t.tok_no - 1
 WHERE (t.pos = 'CONJUNCTION' AND {role('t.lower', 'CONDITIONAL')}) OR ({role('t.lower', 'INITIAL_CONDITIONAL')} AND (t.tok_no = 1 OR b.pos = 'CONJUNCTION'))),
cl AS (SELECT mk.doc_id, mk.sent_no, min(v.tok_no) AS tok_no FROM mk JOIN me v ON v.doc_id = mk.doc_id AND v.sent_no = mk.sent_no AND v.tok_no > mk.tok_no AND v.tok_no <= mk.tok_no + 3 AND v.pos = 'VERB_CONJ' GROUP BY mk.doc_id, mk.sent_no, mk.tok_no),
comp AS (SELECT DISTINCT v.doc_id, v.sent_no, v.tok_no FROM me v JOIN me p ON p.doc_id = v.doc_id AND p.sent_no = v.sent_no AND p.tok_no < v.tok_no AND p.tok_no >= v.tok_no - 3 AND p.pos = 'VERB_PARTICLE' AND {role('p.lower', 'COMPLEMENT')}
 WHERE v.pos IN {VERB2} AND NOT EXISTS (SELECT 1 FROM me b WHERE b.doc_id = v.doc_id AND b.sent_no = v.sent_no AND b.tok_no > p.tok_no AND b.tok_no < v.tok_no AND b.pos IN {VERB2}))
SELECT doc_id, CASE WHEN (t.doc_id, t.sent_no, t.tok_no) IN (SELECT (doc_id, sent_no, tok_no) FROM comp) THEN 'COMPLEMENT' WHEN coalesce(stem IN ('b', 'ri'), FALSE) THEN 'AUXILIARY' ELSE 'MAIN_VERB' END AS gram_role,
 (t.doc_id, t.sent_no, t.tok_no) IN (SELECT (doc_id, sent_no, tok_no) FROM cl) AS is_conditional_clause, count(*) AS n FROM me t WHERE pos IN {VERB2} GROUP BY ALL""",
)
def gram_roles(spark, sf):
    t = ru.gram_roles(sample_tokens(spark, sf), TABLES).where(F.col("pos").isin(*ru.VERBS))
    return t.groupBy("doc_id", "gram_role", "is_conditional_clause").agg(F.count(F.lit(1)).alias("n"))


@query(
    "resolve_subject",
    f"""WITH {TAGGED}, v AS (SELECT *, CASE WHEN obj_class % 3 = 0 THEN 6 WHEN obj_class % 3 = 1 THEN 4 ELSE noun_class END AS vc FROM tagged WHERE pos = 'VERB_CONJ'),
near AS (SELECT v.doc_id, v.sent_no, v.tok_no, v.vc, v.lower, v.verb_tense,
 arg_max(n.noun_class, n.tok_no) FILTER (WHERE n.noun_class IN (1,4,6,9)) AS ya, arg_max(n.noun_class, n.tok_no) FILTER (WHERE n.noun_class IN (4,9)) AS i4,
 arg_max(n.noun_class, n.tok_no) FILTER (WHERE n.noun_class IN (9,1)) AS y1, arg_max(n.noun_class, n.tok_no) FILTER (WHERE n.noun_class = 3) AS u3
 FROM v LEFT JOIN tagged n ON n.doc_id = v.doc_id AND n.sent_no = v.sent_no AND n.tok_no < v.tok_no AND n.pos = 'NOUN' GROUP BY ALL)
SELECT doc_id, sent_no, tok_no, CASE WHEN vc = 6 AND verb_tense IN ('PAST_PERF','PAST_PERF_LOC','PAST_IMPF','COPULA_PAST') THEN coalesce(ya, vc) WHEN vc = 4 AND i4 = 9 THEN 9
 WHEN vc IS NULL AND starts_with(lower, 'y') AND y1 = 9 THEN 9 WHEN vc IS NULL AND starts_with(lower, 'y') AND y1 = 1 AND verb_tense IN ('PRESENT', 'PRESENT_NORA') THEN 1
 WHEN vc = 3 AND NOT starts_with(lower, 'wa') AND u3 IS NULL THEN NULL ELSE vc END::INTEGER AS noun_class FROM near""",
)
def resolve_subject(spark, sf):
    """The sample verbs are given the ambiguous classes 6 and 4 by their length."""
    t = sample_tokens(spark, sf)
    verb, k = F.col("pos") == "VERB_CONJ", F.col("obj_class") % 3
    vc = F.when(verb & (k == 0), 6).when(verb & (k == 1), 4).otherwise(F.col("noun_class"))
    out = ru.resolve_subject(t.withColumn("noun_class", vc.cast("int")))
    return out.where(verb).select("doc_id", "sent_no", "tok_no", "noun_class")


STEMS = [("tion", 5), ("there", 3), ("thing", 4), ("enten", 7), ("thene", 9), ("atthe", 9)]
PLACES = [(w, c) for w, c in STEMS]


@query(
    "retag",
    f"""WITH RECURSIVE {TAGGED},
seq AS MATERIALIZED (SELECT *, CASE WHEN length(lower) >= 5 AND (starts_with(lower, 'the') OR ends_with(lower, 'ing')) THEN length(lower) % 12 + 1 END AS sc FROM tagged),
a AS MATERIALIZED (SELECT *, coalesce(lag(pos) OVER w = 'PRONOUN' AND lag(pron_type) OVER w IN ('DEMONSTRATIVE', 'RELATIVE'), FALSE) AND pos <> 'NOUN' AND punct_type IS NULL AND sc IS NOT NULL AS hit FROM seq WINDOW w AS (PARTITION BY doc_id, sent_no ORDER BY tok_no)),
b AS MATERIALIZED (SELECT * REPLACE (CASE WHEN hit THEN 'NOUN' ELSE pos END AS pos, CASE WHEN hit THEN sc ELSE noun_class END AS noun_class, CASE WHEN hit THEN NULL ELSE obj_class END AS obj_class) FROM a),
c AS MATERIALIZED (SELECT *, coalesce(lag(pos) OVER w = 'LOCATIVE' AND lag(lower) OVER w IN ('in', 'en'), FALSE) AND sc IS NOT NULL AND (pos = 'VERB_CONJ' OR (pos = 'LOCATIVE' AND coalesce(lead(pron_type) OVER w = 'POSSESSIVE', FALSE))) AS hit2 FROM b WINDOW w AS (PARTITION BY doc_id, sent_no ORDER BY tok_no)),
d AS MATERIALIZED (SELECT * REPLACE (CASE WHEN hit2 THEN 'NOUN' ELSE pos END AS pos, CASE WHEN hit2 THEN sc ELSE noun_class END AS noun_class, CASE WHEN hit2 THEN NULL ELSE obj_class END AS obj_class) FROM c),
e AS MATERIALIZED (SELECT *, lag(CASE WHEN punct_type IS NULL THEN lower END IGNORE NULLS) OVER (PARTITION BY doc_id, sent_no ORDER BY tok_no) AS bw FROM d),
f AS MATERIALIZED (SELECT *, punct_type IS NULL AND coalesce(bw = 'on', FALSE) AND regexp_matches(lower, '(mwe|biri|tandatu|tatu|tanu|rindwi|nani|yenda|wenda|enye|ne)$') AS hit3 FROM e),
g AS MATERIALIZED (SELECT * REPLACE (CASE WHEN hit3 THEN 'PRONOUN' ELSE pos END AS pos, CASE WHEN hit3 THEN 'NUMERICAL' ELSE pron_type END AS pron_type, CASE WHEN hit3 THEN NULL ELSE noun_class END AS noun_class, CASE WHEN hit3 THEN NULL ELSE obj_class END AS obj_class) FROM f),
l AS MATERIALIZED (SELECT *, coalesce(lag(pron_type) OVER w = 'POSSESSIVE' AND lag(pos, 2) OVER w = 'NOUN' AND lag(noun_class, 2) OVER w IS NOT NULL AND pos = 'NOUN' AND NOT is_proper_noun
 AND (lag(noun_class) OVER w IS NULL OR lag(noun_class) OVER w = lag(noun_class, 2) OVER w), FALSE) AS lk FROM g WINDOW w AS (PARTITION BY doc_id, sent_no ORDER BY tok_no)),
chain AS (SELECT doc_id, sent_no, tok_no, 1 AS nth FROM l x WHERE lk AND NOT EXISTS (SELECT 1 FROM l y WHERE y.doc_id = x.doc_id AND y.sent_no = x.sent_no AND y.tok_no = x.tok_no - 2 AND y.lk)
 UNION ALL SELECT l.doc_id, l.sent_no, l.tok_no, nth + 1 FROM chain JOIN l ON l.doc_id = chain.doc_id AND l.sent_no = chain.sent_no AND l.tok_no = chain.tok_no + 2 AND l.lk),
h AS MATERIALIZED (SELECT l.* REPLACE (CASE WHEN chain.nth % 2 = 1 THEN 'RELATIVE_NOUN' ELSE pos END AS pos) FROM l LEFT JOIN chain USING (doc_id, sent_no, tok_no)),
v AS (SELECT *, lead(pos) OVER w AS p1, lead(noun_class) OVER w AS c1, lead(pos, 2) OVER w AS p2, lead(noun_class, 2) OVER w AS c2 FROM h WINDOW w AS (PARTITION BY doc_id, sent_no ORDER BY tok_no)),
r AS (SELECT v.*, CASE WHEN pos = 'VERB_CONJ' AND obj_class IS NOT NULL AND (coalesce(p1 = 'PRONOUN' AND c1 = obj_class, FALSE) OR ((coalesce(p1 = 'VERB_CONJ' AND c1 = obj_class, FALSE) OR coalesce(p2 = 'VERB_CONJ' AND c2 = obj_class, FALSE))
 AND NOT EXISTS (SELECT 1 FROM h k WHERE k.doc_id = v.doc_id AND k.sent_no = v.sent_no AND k.tok_no < v.tok_no AND k.pos = 'NOUN' AND k.noun_class = v.obj_class))) THEN 'VERBAL_NOUN' END AS gram_role FROM v)
SELECT r.doc_id, r.sent_no, r.tok_no, r.pos, r.pron_type, r.noun_class::INTEGER AS noun_class, gram_role FROM r""",
)
def retag(spark, sf):
    """Known noun stems: words of five letters or more with two common beginnings or endings."""
    t = sample_tokens(spark, sf)
    words = t.where("punct_type is null").select("lower").distinct().where(
        (F.length("lower") >= 5) & (F.col("lower").startswith("the") | F.col("lower").endswith("ing"))
    )
    stems = words.select("lower", (F.length("lower") % 12 + 1).cast("int").alias("stem_class"))
    return ru.retag(t, stems, TABLES).select("doc_id", "sent_no", "tok_no", "pos", "pron_type", "noun_class", "gram_role")


@query("violations", f"WITH {ERRORS_CTE} SELECT doc_id, sent_no, type, count(*) AS n, min(tok_no) AS first_tok, max(corrected_word) AS corrected FROM errors GROUP BY ALL")
def violations(spark, sf):
    """All rules in one pass, per sentence and type (grouped inside the sentence's own partition)."""
    e = ru.violations(sample_tokens(spark, sf), TABLES)
    return e.groupBy("doc_id", "sent_no", "type").agg(
        F.count(F.lit(1)).alias("n"), F.min("tok_no").alias("first_tok"), F.max("corrected_word").alias("corrected")
    )


PUNCT_TYPES = "('MISSING_COMMA','EXTRA_PUNCT','MISSING_COLON','WRONG_PUNCT','UNBALANCED_QUOTE','UNBALANCED_PAREN','MISSING_QMARK','MISSING_EXCLAIM','MISSING_PERIOD')"


@query(
    "violation_rollup",
    f"""WITH {ERRORS_CTE} SELECT doc_id, sent_no, grouping(doc_id, sent_no)::INTEGER AS level, count(*) AS total, count(*) FILTER (WHERE type NOT IN {PUNCT_TYPES}) AS grammar,
 count(*) FILTER (WHERE type IN {PUNCT_TYPES}) AS punctuation FROM errors GROUP BY ROLLUP (doc_id, sent_no)""",
)
def violation_rollup(spark, sf):
    return rp.violation_report(ru.violations(sample_tokens(spark, sf), TABLES))


@query(
    "context_rates",
    f"""WITH {TAGGED}, c AS (SELECT lower, punct_type, lag(punct_type) OVER w AS p, lead(punct_type) OVER w AS n FROM tagged WINDOW w AS (PARTITION BY doc_id, sent_no ORDER BY tok_no))
SELECT lower AS word, count(*) AS n, round(avg((coalesce(p = 'COMMA', FALSE))::INT), 6) AS comma_before, round(avg(coalesce(n IN ('QUOTE_OPEN', 'COLON'), FALSE)::INT), 6) AS speech_after
FROM c WHERE punct_type IS NULL AND lower IN ('and', 'et', 'und', 'y', 'but', 'que', 'as') GROUP BY lower""",
)
def context_rates(spark, sf):
    t = tk.tokens(table(spark, sf, "documents", "doc_id", "text"))
    return ru.context_rates(t, ["and", "et", "und", "y", "but", "que", "as"])


@query(
    "place_counts",
    f"""WITH {TAGGED}, c AS (SELECT lower, punct_type, lead(CASE WHEN punct_type IS NULL THEN coalesce(pron_type, pos) END IGNORE NULLS) OVER (PARTITION BY doc_id, sent_no ORDER BY tok_no) AS next_kind FROM tagged)
SELECT lower AS word, next_kind, count(*) AS n FROM c WHERE punct_type IS NULL AND lower IN ('in', 'en', 'dans', 'at', 'on') GROUP BY ALL""",
)
def place_counts(spark, sf):
    return ru.place_counts(sample_tokens(spark, sf), ["in", "en", "dans", "at", "on"])


SEP = """CASE WHEN tok_no = first_tok THEN '' WHEN preceded_by_apostrophe THEN '''' WHEN punct_type IS NOT NULL AND punct_type <> 'QUOTE_OPEN' THEN '' ELSE ' ' END"""


@query(
    "corrected_sentences",
    f"""WITH {ERRORS_CTE}, fix AS (SELECT doc_id, sent_no, tok_no, min(corrected_word) AS word FROM errors WHERE type IN ('SPELLING', 'ADJ_AGREEMENT') AND corrected_word <> '' GROUP BY ALL),
u AS (SELECT t.*, coalesce(fix.word, t.surface) AS word, min(tok_no) OVER (PARTITION BY doc_id, sent_no) AS first_tok, fix.word IS NOT NULL AS fixed FROM tagged t LEFT JOIN fix USING (doc_id, sent_no, tok_no))
SELECT doc_id, sent_no, string_agg({SEP} || word, '' ORDER BY tok_no) AS corrected, bool_or(fixed) AS changed FROM u GROUP BY doc_id, sent_no""",
)
def corrected_sentences(spark, sf):
    return rp.correct(sample_tokens(spark, sf), TABLES)


@query(
    "reassemble",
    f"""WITH {TAGGED}, u AS (SELECT *, min(tok_no) OVER (PARTITION BY doc_id, sent_no) AS first_tok, surface AS word FROM tagged)
SELECT doc_id, sent_no, string_agg({SEP} || word, '' ORDER BY tok_no) AS text FROM u GROUP BY doc_id, sent_no""",
)
def reassemble(spark, sf):
    t = tk.tokens(table(spark, sf, "documents", "doc_id", "text"))
    return rp.reassemble(t, F.col("surface"), "text")


@query(
    "error_context",
    f"""WITH {CTX}, e AS (SELECT doc_id, sent_no, tok_no, type FROM ({W5_SQL})),
w AS (SELECT e.doc_id, e.sent_no, e.tok_no, e.type, t.tok_no AS spot, CASE WHEN t.tok_no = e.tok_no THEN '>>' || surface || '<<' ELSE surface END AS piece FROM e JOIN tagged t ON t.doc_id = e.doc_id AND t.sent_no = e.sent_no AND abs(t.tok_no - e.tok_no) <= 3)
SELECT doc_id, sent_no, tok_no, type, string_agg(piece, ' ' ORDER BY spot) AS context FROM w GROUP BY ALL""",
)
def error_context(spark, sf):
    return rp.error_context(ru.context(sample_tokens(spark, sf)), ru.agreement_rules(TABLES))


@query(
    "gloss_sentence",
    f"""WITH {TAGGED}, g AS (SELECT t.doc_id, sent_no, tok_no, punct_type, CASE WHEN pos = 'PUNCTUATION' THEN surface WHEN pos IN ('NOUN', 'RELATIVE_NOUN') THEN coalesce(o.gloss, surface)
 WHEN pos = 'VERB_CONJ' THEN coalesce(CASE verb_tense WHEN 'PAST_PERF' THEN '(past) ' WHEN 'FUTURE' THEN '(will) ' WHEN 'SUBJUNCTIVE' THEN '(should) ' ELSE '' END || v.gloss, surface)
 WHEN pos = 'VERB_INF' THEN coalesce('to ' || v.gloss, surface) WHEN pos = 'ADJECTIVE' THEN '[' || coalesce(o.gloss, t.stem, surface) || ']'
 WHEN w.gloss IS NOT NULL THEN w.gloss WHEN pos = 'PRONOUN' THEN surface ELSE '[' || surface || ']' END AS piece
FROM tagged t LEFT JOIN {first(sl.GLOSS_VERBS, 'key, gloss', 'key')} v ON t.stem = v.key LEFT JOIN {first(sl.GLOSS_NOUNS, 'key, gloss', 'key')} o ON t.stem = o.key
LEFT JOIN {first(sl.GLOSS_WORDS, 'key, gloss', 'key')} w ON t.lower = w.key)
SELECT doc_id, sent_no, trim(string_agg(CASE WHEN punct_type IS NULL THEN ' ' ELSE '' END || piece, '' ORDER BY tok_no), ' ') AS gloss FROM g GROUP BY ALL""",
)
def gloss_sentence(spark, sf):
    from lexweave.sources.dimensions import with_order

    dims = [with_order(spark, x, "key string, gloss string") for x in (sl.GLOSS_VERBS, sl.GLOSS_NOUNS, sl.GLOSS_WORDS)]
    return rp.gloss_sentence(sample_tokens(spark, sf), *dims)
