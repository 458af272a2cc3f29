"""Lexicon joins and word tagging over the words of ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexweave.operators import corpus_stats, lexicon as lx, paradigms as pg, tokens as tk, verbforms
from lexweave.queries import sample_lexicon as sl, sqltext as sq
from lexweave.queries.base import documents, query, table
from lexweave.queries.text_core import VOCAB, benchmark_vocabulary, vocabularies
from lexweave.queries.vocab import V, vocabulary
from lexweave.sources import fixed
from lexweave.sources.dimensions import with_order


def ordered(rows, columns):
    return sq.values([(i, *r) for i, r in enumerate(rows, 1)], "ord, " + columns)


def first(rows, columns, key="word"):
    return f"(SELECT * FROM {ordered(rows, columns)} QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY ord) = 1)"


INV, PRO, KNO = "word, pos", "word, pron_type, noun_class", "word, noun_class, stem"


def sample_dims(spark):
    return (
        with_order(spark, sl.INVARIABLES, "word string, pos string"),
        with_order(spark, sl.PRONOUNS, "word string, pron_type string, noun_class int"),
        with_order(spark, sl.KNOWN_WORDS, "word string, noun_class int, stem string"),
    )


TAG_SQL = f"""SELECT v.word, v.n, CASE WHEN i.pos IS NOT NULL THEN i.pos WHEN p.pron_type IS NOT NULL THEN 'PRONOUN' WHEN k.stem IS NOT NULL THEN 'NOUN' END AS pos,
 CASE WHEN i.pos IS NULL THEN p.pron_type END AS pron_type,
 CASE WHEN i.pos IS NOT NULL THEN NULL WHEN p.pron_type IS NOT NULL THEN p.noun_class ELSE k.noun_class END::INTEGER AS noun_class,
 CASE WHEN i.pos IS NULL AND p.pron_type IS NULL THEN k.stem END AS stem
FROM vocab v LEFT JOIN {first(sl.INVARIABLES, INV)} i USING (word) LEFT JOIN {first(sl.PRONOUNS, PRO)} p USING (word) LEFT JOIN {first(sl.KNOWN_WORDS, KNO)} k USING (word)"""


@query("lexicon_tag", f"WITH {V} {TAG_SQL}")
def lexicon_tag(spark, sf):
    return lx.lexicon_tag(vocabulary(spark, sf), *sample_dims(spark))


def prefix_sql(rules, form="word", source="vocab"):
    guard = f"""length({form}) >= shortest AND (after <> 'V' OR regexp_matches(substr({form}, length(prefix) + 1, 1), '[aeiou]'))
 AND (after <> 'C' OR regexp_matches(substr({form}, length(prefix) + 1, 1), '[^aeiou]')) AND (ending <> 'N' OR right({form}, 1) NOT IN ('a', 'e'))"""
    return f"""SELECT word, noun_class::INTEGER AS noun_class, prefix, substr({form}, strip + 1) AS stem, ord FROM {source}
 JOIN {ordered(rules, 'prefix, noun_class, shortest, after, ending, strip')} r ON starts_with({form}, prefix) WHERE {guard}"""


RELAXED = [(p, c, 4, "C", "", 2) for p, c in lx.RELAXED]


def noun_class_sql(rules):
    return f"""WITH {V}, nka AS (SELECT word, substr(word, 4) AS form FROM vocab WHERE starts_with(word, 'nka') AND length(word) > 6),
c AS (SELECT *, 0 AS step FROM ({prefix_sql(rules)}) UNION ALL SELECT *, 1 FROM ({prefix_sql(rules, 'form', 'nka')})
 UNION ALL SELECT *, 2 FROM ({prefix_sql(RELAXED, 'form', 'nka')}))
SELECT word, noun_class, prefix, stem FROM c QUALIFY row_number() OVER (PARTITION BY word ORDER BY step, ord) = 1"""


@query("noun_prefix_class", noun_class_sql(fixed.NOUN_PREFIXES))
def noun_prefix_class(spark, sf):
    return lx.noun_class(vocabulary(spark, sf))


@query("noun_prefix_class_sample", noun_class_sql(sl.PREFIXES))
def noun_prefix_class_sample(spark, sf):
    """The same operator with a prefix table of other languages."""
    return lx.noun_class(vocabulary(spark, sf), sl.PREFIXES)


INFINITIVE_SQL = f"""WITH {V}, b AS (SELECT word, CASE WHEN length(word) > 5 AND regexp_matches(word, 'a(ho|mo|yo)$') THEN substr(word, 1, length(word) - 2) ELSE word END AS base FROM vocab),
p AS (SELECT *, CASE WHEN regexp_matches(base, '^(re|en|in|st)') THEN substr(base, 1, 2) WHEN regexp_matches(base, '^th') AND length(base) > 4 THEN 'th' END AS prefix FROM b WHERE length(base) >= 4),
i AS (SELECT *, substr(base, length(prefix) + 1) AS inner_ FROM p WHERE prefix IS NOT NULL),
s AS (SELECT word, prefix, CASE WHEN length(inner_) < 2 THEN NULL WHEN ends_with(inner_, 'a') THEN inner_[:-2] WHEN length(base) < 6 THEN NULL
 WHEN ends_with(inner_, 'ye') AND length(inner_) >= 3 THEN inner_[:-3] WHEN ends_with(inner_, 'tse') AND length(inner_) >= 4 THEN inner_[:-4]
 WHEN ends_with(inner_, 'we') AND length(inner_) >= 3 THEN inner_[:-3] WHEN ends_with(inner_, 'e') THEN inner_[:-2] END AS stem FROM i)
SELECT word, prefix, stem FROM s WHERE stem IS NOT NULL"""


@query("infinitives", INFINITIVE_SQL)
def infinitives(spark, sf):
    """With prefixes that occur in the sample text; the language's own pattern is covered by tests."""
    return lx.infinitives(vocabulary(spark, sf), pattern="^(re|en|in|st|th(?=.{3}))(.{2,})$")


ADJ = f"""{V}, apx AS {ordered(fixed.ADJ_PREFIXES, 'prefix, noun_class')}, rst AS {sq.values(fixed.ADJ_RESTORED, 'prefix, letter')},
ast AS {sq.values([(s,) for s in fixed.ADJ_STEMS], 'stem')},
cand AS (SELECT word, noun_class, a.ord, a.prefix, substr(word, length(a.prefix) + 1) AS rest, letter FROM vocab JOIN apx a ON starts_with(word, a.prefix) LEFT JOIN rst USING (prefix)),
opts AS (SELECT word, noun_class, ord, 0 AS o, rest AS stem FROM cand UNION ALL SELECT word, noun_class, ord, 1, letter || rest FROM cand
 UNION ALL SELECT word, noun_class, ord, 2, s.stem FROM cand JOIN ast s ON rest = s.stem || prefix || s.stem)"""


@query(
    "adjectives",
    f"""WITH {ADJ} SELECT word, noun_class::INTEGER AS noun_class, stem FROM opts SEMI JOIN ast USING (stem)
QUALIFY row_number() OVER (PARTITION BY word ORDER BY ord, o) = 1""",
)
def adjectives(spark, sf):
    return lx.adjectives(vocabulary(spark, sf))


PAIR_WORDS = "SELECT DISTINCT word || 's' AS plural, word AS singular, substr(word, 2) AS stem FROM bvocab WHERE length(word) > 3"


@query(
    "plural_lookup",
    f"""WITH {VOCAB}, pairs AS ({PAIR_WORDS}),
side AS (SELECT singular AS word, stem, 1 AS noun_class, 'singular' AS side FROM pairs UNION ALL SELECT plural, stem, 2, 'plural' FROM pairs)
SELECT word, stem, noun_class::INTEGER AS noun_class, side FROM dvocab JOIN side USING (word)
QUALIFY row_number() OVER (PARTITION BY word ORDER BY side DESC) = 1""",
)
def plural_lookup(spark, sf):
    docs, bench = vocabularies(spark, sf)
    pairs = bench.where(F.length("word") > 3).select(
        F.col("word").alias("singular"), F.concat("word", F.lit("s")).alias("plural"),
        F.substr("word", F.lit(2)).alias("stem"), F.lit(1).alias("sg_class"), F.lit(2).alias("pl_class"),
        F.lit(1).alias("ord"),
    )
    return lx.plural_lookup(docs, pairs)


VERB_PATTERNS = [(t, only, rx.replace("?:", ""), test) for t, only, rx, test in fixed.TENSE_PATTERNS]


def lst(items):
    return "(" + ", ".join(f"'{x}'" for x in items) + ")"


JOIN_SQL = """CASE WHEN NOT (regexp_matches(prefix, '[aeiou]$') AND regexp_matches(stem, '^[aeiou]')) THEN prefix || stem
 WHEN ends_with(prefix, 'u') THEN CASE WHEN regexp_matches(prefix, '[kgh]u$') AND regexp_matches(stem, '^[ou]') THEN prefix[:-2] || stem ELSE prefix[:-2] || 'w' || stem END
 WHEN ends_with(prefix, 'ki') THEN CASE WHEN regexp_matches(stem, '^[ie]') THEN prefix[:-3] || 'k' || stem ELSE prefix[:-3] || 'cy' || stem END
 WHEN ends_with(prefix, 'ji') AND starts_with(stem, 'e') THEN prefix[:-3] || 'g' || stem
 WHEN ends_with(prefix, 'i') THEN prefix[:-2] || 'y' || stem
 WHEN NOT regexp_matches(prefix, '[yw].$') AND starts_with(stem, 'i') THEN prefix[:-2] || 'e' || stem[2:] ELSE prefix[:-2] || stem END"""


def seam_of(prefix: str, rest: str, out: str, source: str) -> str:
    """``source`` with a column ``out``: prefix and rest of a verb with their contact settled."""
    return f"""(SELECT * EXCLUDE (prefix, stem), CASE WHEN prefix = '' THEN stem WHEN prefix <> 'n' THEN {JOIN_SQL}
 WHEN regexp_matches(stem, '^(pf|h|r|c|ts)') THEN CASE stem[1] WHEN 'p' THEN 'm' WHEN 'h' THEN 'mp' WHEN 'r' THEN 'nd' WHEN 'c' THEN 'nsh' ELSE 'n' END || CASE WHEN stem[1] = 't' THEN stem[2:][2:] ELSE stem[2:] END
 WHEN regexp_matches(stem, '^[bfpv]') THEN 'm' || stem WHEN regexp_matches(stem, '^[mn]') THEN stem ELSE 'n' || stem END AS {out}
 FROM (SELECT *, {prefix} AS prefix, {rest} AS stem FROM {source}))"""


def fused_sql(expr: str) -> str:
    for pattern, replacement, times in verbforms.FUSIONS:
        for _ in range(times):
            expr = f"regexp_replace({expr}, '{pattern}', '{replacement.replace('$', chr(92))}', 'g')"
    return f"replace({expr}, '|', '')"


FORM_CTES = f"""fsub AS {sq.values(verbforms.subjects(), 'sp, noun_class, s_ord, past_only, past')},
fom AS {sq.values([('', None), *((f, c) for f, _, c in fixed.OBJECT_MARKERS)], 'object, obj_class')},
ften AS {ordered(fixed.TENSE_SLOTS, 'plain, marker, final, placed, scope')},
fkind AS {sq.values([(k,) for k in verbforms.KINDS], 'kind')}, fmark AS (SELECT DISTINCT marker FROM ften),
fh0 AS (SELECT * FROM {seam_of('object', 'kind', 'x', '(SELECT * FROM fom, fkind)')}),
fh1 AS (SELECT * FROM {seam_of('marker', 'x', 'x2', '(SELECT * FROM fh0, fmark)')}),
fhead AS (SELECT * FROM {seam_of('sp', 'x2', 'head', '(SELECT * FROM fh1, fsub)')}),
fext AS {sq.values([('', None), *fixed.EXTENSIONS], 'ext, ext_name')},
ffin AS {ordered(fixed.FINAL_FORMS, 'final, written, needs')},
fplace AS {sq.values([('',), *((x,) for x in fixed.PLACE_SUFFIXES)], 'place')},
ftail0 AS (SELECT stem, ext, ext_name, final, f.ord AS f_ord, CASE WHEN written = 'ye' THEN {fused_sql("stem || CASE WHEN ext <> '' THEN '|' || ext ELSE '' END || '|ye'")} ELSE stem || ext || written END AS core
 FROM fstem, fext, ffin f WHERE needs = '' OR regexp_matches(stem || ext, needs)),
ftail AS (SELECT * EXCLUDE (core), core || place AS tail, CASE WHEN final <> 'ye' THEN 0 WHEN NOT starts_with(core, stem || ext) THEN -1 WHEN core = stem || ext || 'e' THEN 1 ELSE 0 END AS kept FROM ftail0, fplace),
fkt AS (SELECT *, CASE WHEN regexp_matches(tail, '^(ts|pf)') THEN tail[1:2] ELSE tail[1] END AS kind, tail[length(kind) + 1:] AS rest FROM ftail),
fcut AS (SELECT word, is_negative, base[1:n] AS head, base[n + 1:] AS rest FROM (SELECT word, is_negative, base, unnest(range(1, least({verbforms.LONGEST}, length(base) - 1) + 1)) AS n FROM b)),
fmet AS (SELECT word, is_negative, sp AS prefix, noun_class::INTEGER AS noun_class, marker, object, obj_class::INTEGER AS obj_class, stem, ext_name AS ext, final, place, CASE WHEN place = '' THEN plain ELSE placed END AS tense,
  array_to_string(list_filter([sp, marker, object, stem, ext, final, place], lambda x: x <> ''), '|') AS morphemes,
  [CASE WHEN object <> '' THEN 1 ELSE 0 END + CASE WHEN ext <> '' THEN 2 ELSE 0 END, s_ord, CASE WHEN past AND plain = 'PAST_PERF' THEN 0 ELSE 1 END,
   CASE WHEN kept = 1 AND ends_with(stem || ext, 'y') AND sp IN {tuple(fixed.Y_PAST_PREFIXES)} THEN 0 ELSE kept END, -length(stem), t.ord, f_ord] AS o, stem AS o1, object AS o2, ext AS o3
 FROM fcut JOIN fhead USING (head) JOIN fkt USING (kind, rest) JOIN ften t USING (marker, final)
 WHERE (place = '' OR placed <> '') AND CASE scope WHEN 'past' THEN past_only WHEN '!past' THEN NOT past_only ELSE TRUE END),
fread AS (SELECT * EXCLUDE (o, o1, o2, o3, q), row_number() OVER (PARTITION BY word ORDER BY o, o1, o2, o3)::INTEGER AS rank FROM
 (SELECT *, row_number() OVER (PARTITION BY word, prefix, noun_class, marker, object, stem, ext, final, place, tense ORDER BY o, o1, o2, o3) AS q FROM fmet) WHERE q = 1)"""
BASE_CTES = """vbase AS (SELECT word, CASE WHEN regexp_matches(word, '^nt[aiu].') OR (starts_with(word, 'si') AND length(word) > 4) THEN 2 ELSE 0 END AS cut FROM dvocab),
b AS (SELECT word, cut > 0 AS is_negative, substr(word, cut + 1) AS base FROM vbase WHERE length(word) - cut >= 3)"""

OM_FORMS = [(f, c) for f, _, c in fixed.OBJECT_MARKERS] + [(v, c) for f, v, c in fixed.OBJECT_MARKERS if v != f]
#: Reads ``dvocab(word)`` and ``known(stem)``.
VERB_BODY = f"""fstem AS (SELECT stem FROM known WHERE stem <> ''), {BASE_CTES}, {FORM_CTES},
neg AS (SELECT word, stem FROM (SELECT word, o1, substr(word, length(x) + 1, length(word) - length(x) - 1) AS stem FROM b, (SELECT unnest(['mwi', 'twi', 'wi']) AS x, unnest([0, 1, 2]) AS o1) WHERE starts_with(word, x) AND ends_with(word, 'a'))
 SEMI JOIN known USING (stem) QUALIFY row_number() OVER (PARTITION BY word ORDER BY o1) = 1),
form AS (SELECT * FROM fread ANTI JOIN neg USING (word) WHERE rank = 1),
free AS (SELECT * FROM b ANTI JOIN neg USING (word) ANTI JOIN form USING (word)),
heads AS (SELECT free.*, p.prefix, p.noun_class, p.ord, substr(base, length(p.prefix) + 1) AS rest FROM free JOIN {ordered(fixed.SUBJECT_PREFIXES, 'prefix, noun_class')} p ON starts_with(base, p.prefix)
 WHERE length(base) >= length(p.prefix) + 2),
m AS (SELECT h.*, t.tense, t.test, t.ord AS o2, regexp_extract(rest, t.rx, 1) AS stem FROM heads h JOIN {ordered(VERB_PATTERNS, 'tense, scope, rx, test')} t ON regexp_matches(rest, t.rx)
 WHERE CASE WHEN scope = 'ara' THEN prefix = 'ara' WHEN prefix = 'ara' THEN FALSE WHEN scope = 'u' THEN prefix IN ('u', 'nu')
 WHEN scope = 'past' THEN prefix IN {lst(fixed.PAST_PREFIXES)} WHEN scope = 'pastonly' THEN prefix IN {lst(fixed.PAST_ONLY_PREFIXES)}
 WHEN scope = '!ka' THEN prefix NOT IN ('ka', 'ga') ELSE TRUE END),
alls AS (SELECT word, is_negative, noun_class, stem, tense, test, ord AS o1, o2 FROM m WHERE stem <> ''
 UNION ALL SELECT word, is_negative, 0, base[:-2], CASE WHEN ends_with(base, 'a') THEN 'IMPERATIVE' ELSE 'SUBJUNCTIVE' END, 'bare', 0, 0 FROM free WHERE right(base, 1) IN ('a', 'e')),
k AS (SELECT a.*, known.stem IS NOT NULL AS known FROM alls a LEFT JOIN known USING (stem)),
ok AS (SELECT *, CASE WHEN test = 'bare' THEN 2 WHEN test = 'last' AND NOT known THEN 3 ELSE 1 END AS o0 FROM k
 WHERE CASE WHEN test IN ('known', 'bare') THEN known WHEN test = 'known1' THEN length(stem) >= 2 OR known ELSE TRUE END),
best AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY word ORDER BY o0, o1, o2) = 1),
om AS (SELECT word, f, c FROM best JOIN {ordered(OM_FORMS, 'f, c')} x ON starts_with(stem, f) AND length(stem) > length(f) QUALIFY row_number() OVER (PARTITION BY word ORDER BY x.ord) = 1),
ex AS (SELECT word, e, n FROM best JOIN {ordered(fixed.EXTENSIONS, 'e, n')} x ON ends_with(stem, e) AND length(stem) >= length(e) + 2 QUALIFY row_number() OVER (PARTITION BY word ORDER BY x.ord) = 1),
o AS (SELECT word, 0 AS rank, stem AS bare, NULL AS obj_class, NULL AS ext FROM best
 UNION ALL SELECT word, 1, substr(stem, length(f) + 1), c, NULL FROM best JOIN om USING (word) WHERE NOT known
 UNION ALL SELECT word, 2, substr(stem, 1, length(stem) - length(e)), NULL, n FROM best JOIN ex USING (word) WHERE NOT known
 UNION ALL SELECT word, 3, substr(stem, length(f) + 1, length(stem) - length(f) - length(e)), c, n FROM best JOIN om USING (word) JOIN ex USING (word) WHERE NOT known AND length(stem) > length(f) + length(e)),
oo AS (SELECT o.*, known.stem IS NOT NULL AS hit FROM o LEFT JOIN known ON o.bare = known.stem),
pick AS (SELECT * FROM oo WHERE rank = 0 OR hit QUALIFY row_number() OVER (PARTITION BY word ORDER BY CASE WHEN hit THEN rank ELSE 9 END, rank) = 1)"""
VERB_SELECT = """SELECT word, pick.bare AS stem, CASE WHEN noun_class > 0 THEN noun_class END::INTEGER AS noun_class, tense, obj_class::INTEGER AS obj_class, ext, is_negative, hit AS stem_known
FROM best JOIN pick USING (word)
UNION ALL SELECT word, stem, NULL, 'NEG_IMPERATIVE', NULL, NULL, TRUE, TRUE FROM neg
UNION ALL SELECT word, stem, CASE WHEN noun_class > 0 THEN noun_class END, tense, obj_class, ext, is_negative, TRUE FROM form"""


VERB_SQL = f"""WITH {VOCAB}, known AS (SELECT DISTINCT left(word, length(word) - 1) AS stem FROM bvocab WHERE length(word) > 1), {VERB_BODY}
{VERB_SELECT}"""


@query("verb_parse", VERB_SQL)
def verb_parse(spark, sf):
    """Known stems: the words of ``benchmark`` without their last letter."""
    docs, bench = vocabularies(spark, sf)
    stems = bench.where(F.length("word") > 1).select(F.expr("left(word, length(word) - 1)").alias("stem"))
    return lx.verbs(docs, stems)


@query(
    "paradigm_tags",
    f"""WITH {VOCAB}, fstem AS (SELECT DISTINCT left(word, length(word) - 1) AS stem FROM bvocab WHERE length(word) > 1), {BASE_CTES}, {FORM_CTES}
SELECT word, rank, is_negative, prefix, noun_class, marker, object, obj_class, stem, ext, final, place, tense, morphemes FROM fread""",
)
def paradigm_tags(spark, sf):
    """Every reading of every word of ``documents`` as a generated form of the stems of ``benchmark``."""
    docs, bench = vocabularies(spark, sf)
    stems = bench.where(F.length("word") > 1).select(F.expr("left(word, length(word) - 1)").alias("stem"))
    return verbforms.analyses(docs, stems)


DEV_SQL = f"""WITH {VOCAB}, known AS (SELECT DISTINCT left(word, length(word) - 1) AS root FROM bvocab WHERE length(word) > 2),
s AS (SELECT word AS stem, length(word) AS n, word[:-2] AS root FROM dvocab WHERE length(word) >= 3 AND regexp_matches(word, '[aeiou]$') AND word NOT IN {lst(fixed.PRIMARY_NOUN_STEMS)}),
o AS (SELECT stem, 1 AS rank, root[:-2] || 'r' AS key, root[:-2] || 'r' AS cite FROM s WHERE ends_with(stem, 'ze') AND n >= 3
 UNION ALL SELECT stem, 2, root[:-3], root[:-3] FROM s WHERE ends_with(stem, 'ano') AND n >= 6
 UNION ALL SELECT stem, 3, root, root FROM s WHERE n >= 3
 UNION ALL SELECT stem, 4, 'w' || root, root FROM s WHERE n >= 3 AND starts_with(root, 'i')
 UNION ALL SELECT stem, 5, CASE WHEN regexp_matches(stem, '^ti[aeiou]') THEN root[3:] ELSE 'i' || root[3:] END, CASE WHEN regexp_matches(stem, '^ti[aeiou]') THEN root[3:] ELSE 'i' || root[3:] END FROM s WHERE n >= 5 AND starts_with(stem, 'ti')
 UNION ALL SELECT stem, 6, root[3:], root[3:] FROM s WHERE n >= 5 AND regexp_matches(stem, '^da[^aeiou]')
 UNION ALL SELECT stem, 7, root[:-2] || 'g', root[:-2] || 'g' FROM s WHERE n >= 4 AND ends_with(stem, 'zi')
 UNION ALL SELECT stem, 8, root[:-2] || 'r', root[:-2] || 'r' FROM s WHERE n >= 4 AND ends_with(stem, 'zi'))
SELECT stem, cite AS verb_root FROM o JOIN known ON key = known.root WHERE length(key) >= 2 QUALIFY row_number() OVER (PARTITION BY stem ORDER BY rank) = 1"""


@query("deverbatives", DEV_SQL)
def deverbatives(spark, sf):
    docs, bench = vocabularies(spark, sf)
    stems = bench.where(F.length("word") > 2).select(F.expr("left(word, length(word) - 1)").alias("stem"))
    return lx.deverbatives(docs.withColumnRenamed("word", "stem"), stems)


@query(
    "unknown_words",
    f"""WITH {VOCAB} SELECT doc_id, count(*) AS n, count(DISTINCT lower) AS forms FROM tokens
WHERE punct_type IS NULL AND NOT is_proper_noun AND lower NOT IN (SELECT word FROM bvocab) GROUP BY doc_id""",
)
def unknown_words(spark, sf):
    """The words of ``benchmark`` are the dictionary; unknown tokens are counted per document."""
    t = tk.tokens(table(spark, sf, "documents", "doc_id", "text"))
    dictionary = benchmark_vocabulary(spark, sf)
    return lx.unknown_words(t, dictionary).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("lower").alias("forms")
    )


@query("in_vocabulary", f"WITH {VOCAB} SELECT word FROM dvocab WHERE word IN (SELECT word FROM bvocab)")
def in_vocabulary(spark, sf):
    return lx.in_vocabulary(*vocabularies(spark, sf))


@query(
    "prefix_splits",
    f"""WITH {V}, h AS (SELECT word, prefix, substr(word, length(prefix) + 1) AS stem, ord FROM vocab JOIN {ordered([(p,) for p in fixed.SPLIT_PREFIXES], 'prefix')} p ON starts_with(word, prefix)
 WHERE NOT contains(word, '-') AND length(word) > length(prefix) AND NOT (prefix IN ('in', 'im') AND word[3] = 'y')),
alls AS (SELECT word, prefix, stem, row_number() OVER (PARTITION BY word ORDER BY ord) AS rank FROM h
 UNION ALL SELECT word, '', word, 1 FROM vocab WHERE NOT contains(word, '-') AND word NOT IN (SELECT word FROM h)
 UNION ALL SELECT word, substr(word, 1, strpos(word, '-') - 1), substr(word, strpos(word, '-') + 1), 1 FROM vocab WHERE contains(word, '-'))
SELECT word, prefix, stem, rank::INTEGER AS rank FROM alls""",
)
def prefix_splits(spark, sf):
    return lx.prefix_splits(vocabulary(spark, sf))


SUBJECTS = [("ba", 2), ("ki", 7), ("u", 3), ("n", 0)]
TENSES = [("", "PRESENT_NORA", "a"), ("ra", "PRESENT", "a"), ("za", "FUTURE", "a"), ("", "PAST_PERF", "ye")]


def seam_sql(expr: str, nine: bool = False) -> str:
    """The rule chain as nested replacements."""
    out = f"replace(translate(lower({expr}), '-', '|'), '0', '')"
    for when, rx, rep, times in fixed.SEAM_RULES:
        if when == ("!9" if nine else "9"):
            continue
        rep = rep.replace("$", "\\")
        for _ in range(times):
            out = f"regexp_replace({out}, '{rx}', '{rep}', 'g')"
    return out


@query(
    "paradigm_surface",
    f"""WITH {VOCAB}, stems AS (SELECT DISTINCT left(word, length(word) - 1) AS stem FROM bvocab WHERE length(word) > 3),
c AS (SELECT stem, prefix, noun_class::INTEGER AS noun_class, marker, tense, ending FROM stems, {sq.values(SUBJECTS, 'prefix, noun_class')}, {sq.values(TENSES, 'marker, tense, ending')}),
f AS (SELECT *, prefix || CASE WHEN marker <> '' THEN '|' || marker ELSE '' END || '|' || stem || '|' || ending AS morphemes FROM c)
SELECT stem, prefix, noun_class, marker, tense, ending, morphemes, {seam_sql('morphemes')} AS surface FROM f""",
)
def paradigm_surface(spark, sf):
    bench = benchmark_vocabulary(spark, sf)
    stems = bench.where(F.length("word") > 3).select(F.expr("left(word, length(word) - 1)").alias("stem")).distinct()
    return pg.expand_paradigms(stems, SUBJECTS, TENSES)


NOUN_FORMS = [(c, n, f, p) for c, *_ in fixed.NOUN_CLASSES for n, f in (("singular", c), ("plural", dict(fixed.PLURAL_CLASSES).get(c))) for f2, p, *_ in fixed.NOUN_CLASSES if f == f2]
NOUN_CTES = f"""{VOCAB}, nstem AS (SELECT DISTINCT left(word, length(word) - 1) AS stem FROM bvocab WHERE length(word) > 3),
nform AS (SELECT stem, noun_class::INTEGER AS noun_class, number, form_class::INTEGER AS form_class, prefix || '|' || stem AS morphemes FROM nstem, {sq.values(NOUN_FORMS, 'noun_class, number, form_class, prefix')}),
nsurf AS (SELECT *, {seam_sql('morphemes')} AS surface FROM nform WHERE form_class NOT IN (9, 10) UNION ALL SELECT *, {seam_sql('morphemes', True)} FROM nform WHERE form_class IN (9, 10))"""


def noun_stems(bench):
    """The words of ``benchmark`` without their last letter as stems of every class."""
    classes = F.explode(F.array(*[F.lit(c) for c, *_ in fixed.NOUN_CLASSES])).alias("noun_class")
    return bench.where(F.length("word") > 3).select(F.expr("left(word, length(word) - 1)").alias("stem")).distinct().select("stem", classes)


@query("noun_paradigm", f"WITH {NOUN_CTES} SELECT * FROM nsurf")
def noun_paradigm(spark, sf):
    return pg.expand_nouns(noun_stems(benchmark_vocabulary(spark, sf)))


@query("noun_forms", f"WITH {NOUN_CTES} SELECT word, stem, noun_class, number, form_class, morphemes FROM dvocab JOIN nsurf ON word = surface")
def noun_forms(spark, sf):
    """The words of ``documents`` that are generated noun forms."""
    docs, bench = vocabularies(spark, sf)
    return pg.noun_forms(docs, noun_stems(bench))


JOIN_PREFIXES = ["ba", "mu", "ku", "ki", "bi", "ya", "n", "tu", "ka"]


@query(
    "vowel_join",
    f"""WITH {VOCAB}, c AS (SELECT prefix, word AS stem FROM dvocab, {sq.values([(p,) for p in JOIN_PREFIXES], 'prefix')})
SELECT prefix, stem, {JOIN_SQL} AS surface FROM c""",
)
def vowel_join(spark, sf):
    docs, _ = vocabularies(spark, sf)
    prefixes = F.explode(F.array(*[F.lit(p) for p in JOIN_PREFIXES])).alias("prefix")
    return pg.join_pairs(docs.select(prefixes, F.col("word").alias("stem")))


@query(
    "gloss",
    f"""WITH {V}, tagged AS ({TAG_SQL}),
t AS (SELECT word AS lower, n, coalesce(pos, CASE WHEN ends_with(word, 'ing') THEN 'VERB_CONJ' ELSE 'NOUN' END) AS pos, coalesce(stem, right(word, 4)) AS stem FROM tagged)
SELECT lower, n, pos, t.stem, coalesce(CASE WHEN pos IN ('VERB_CONJ', 'VERB_INF') THEN v.gloss WHEN pos IN ('NOUN', 'RELATIVE_NOUN', 'ADJECTIVE') THEN o.gloss ELSE w.gloss END, '[?]') AS gloss
FROM t LEFT JOIN {first(sl.GLOSS_VERBS, 'key, gloss', 'key')} v ON t.stem = v.key LEFT JOIN {first(sl.GLOSS_NOUNS, 'key, gloss', 'key')} o ON t.stem = o.key
LEFT JOIN {first(sl.GLOSS_WORDS, 'key, gloss', 'key')} w ON t.lower = w.key""",
)
def gloss(spark, sf):
    tagged = lx.lexicon_tag(vocabulary(spark, sf), *sample_dims(spark))
    guess = F.when(F.col("word").endswith("ing"), "VERB_CONJ").otherwise("NOUN")
    t = tagged.select(
        F.col("word").alias("lower"), "n", F.coalesce("pos", guess).alias("pos"),
        F.coalesce("stem", F.expr("right(word, 4)")).alias("stem"),
    )
    dims = [with_order(spark, x, "key string, gloss string") for x in (sl.GLOSS_VERBS, sl.GLOSS_NOUNS, sl.GLOSS_WORDS)]
    return lx.gloss(t, *dims).select("lower", "n", "pos", "stem", "gloss")


@query(
    "tag_profile",
    f"""WITH {V}, tagged AS ({TAG_SQL}), k AS (SELECT pos, noun_class, n FROM tagged)
SELECT pos, noun_class, count(*) AS n, grouping(pos, noun_class)::BIGINT AS level FROM k GROUP BY CUBE (pos, noun_class)""",
)
def tag_profile(spark, sf):
    return corpus_stats.tag_profile(lx.lexicon_tag(vocabulary(spark, sf), *sample_dims(spark)))
