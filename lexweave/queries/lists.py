"""Word lists, takes, scores and logs over the sample tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexweave.operators import lists as li, marks as mk
from lexweave.plans.scale import spread
from lexweave.queries import sample_lexicon as sl
from lexweave.queries.base import query, table
from lexweave.queries.reference import MARKED, moras_sql, plain_sql
from lexweave.queries.lexicon import lst
from lexweave.queries.series import VOWELS, vowels
from lexweave.queries.text_core import VOCAB, benchmark_vocabulary, vocabularies
from lexweave.queries.vocab import vocabulary
from lexweave.sources import tables as tb

WORD = r"regexp_extract_all(lower(text), '\p{L}+')"
SOURCES = f"""w1 AS (SELECT item_id * 100000 + unnest(range(1, len(l) + 1)) AS ord, unnest(l) AS plain FROM (SELECT item_id, {WORD} AS l FROM benchmark)),
w2 AS (SELECT (conv_id * 1000 + turn) * 100000 + unnest(range(1, len(l) + 1)) AS ord, unnest(l) AS plain, role FROM (SELECT conv_id, turn, role, {WORD} AS l FROM conversations)),
src AS (SELECT 1 AS prio, ord, plain, CASE WHEN length(plain) % 2 = 0 THEN 'even' ELSE '' END AS meaning, 'benchmark (words)' AS source FROM w1
 UNION ALL SELECT 2, ord, plain, CASE WHEN length(plain) % 3 = 0 THEN role ELSE '' END, 'talk, ' || role FROM w2),
one AS (SELECT * FROM src QUALIFY row_number() OVER (PARTITION BY plain, meaning ORDER BY prio, ord) = 1),
wordlist AS (SELECT row_number() OVER (ORDER BY prio, ord) AS id, plain, meaning, source FROM one)"""


def sources(spark, sf):
    letters = F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1))
    b = spread(table(spark, sf, "benchmark", "item_id", "text")).select(
        "item_id", F.posexplode(letters).alias("p", "plain")
    )
    b = b.select(
        (F.col("item_id") * 100000 + F.col("p") + 1).alias("ord"), "plain",
        F.when(F.length("plain") % 2 == 0, "even").otherwise("").alias("meaning"),
        F.lit("benchmark (words)").alias("source"),
    )
    c = spread(table(spark, sf, "conversations", "conv_id", "turn", "role", "text")).select(
        "conv_id", "turn", "role", F.posexplode(letters).alias("p", "plain")
    )
    c = c.select(
        ((F.col("conv_id") * 1000 + F.col("turn")) * 100000 + F.col("p") + 1).alias("ord"), "plain",
        F.when(F.length("plain") % 3 == 0, F.col("role")).otherwise("").alias("meaning"),
        F.concat(F.lit("talk, "), "role").alias("source"),
    )
    return [b, c]


@query("build_wordlist", f"WITH {SOURCES} SELECT id, plain, meaning, source FROM wordlist")
def build_wordlist(spark, sf):
    return li.build_wordlist(sources(spark, sf))


OLD = """old AS (SELECT plain, meaning, (id * 7)::VARCHAR || CASE WHEN id % 3 = 1 THEN '-2' ELSE '' END AS id, 'm' || id AS your_marking, CASE WHEN id % 2 = 0 THEN 'h' ELSE '' END AS heard, 'r' || id AS recording, '' AS notes FROM wordlist)"""


@query(
    "merge_annotations",
    f"""WITH {SOURCES}, {OLD}, b AS (SELECT * FROM old WHERE NOT contains(id, '-')), w AS (SELECT * FROM old WHERE contains(id, '-'))
SELECT n.id::VARCHAR AS id, n.plain, n.meaning, n.source, coalesce(b.your_marking, '') AS your_marking, coalesce(b.heard, '') AS heard, coalesce(b.recording, '') AS recording, coalesce(b.notes, '') AS notes FROM wordlist n LEFT JOIN b USING (plain, meaning)
UNION ALL SELECT n.id || '-2', n.plain, n.meaning, n.source, w.your_marking, w.heard, w.recording, w.notes FROM wordlist n JOIN w USING (plain, meaning)""",
)
def merge_annotations(spark, sf):
    """The list rebuilt over an older one: every word annotated, a third as second ways."""
    new = li.build_wordlist(sources(spark, sf))
    text = F.col("id").cast("string")
    old = new.select(
        "plain", "meaning",
        F.concat((F.col("id") * 7).cast("string"), F.when(F.col("id") % 3 == 1, "-2").otherwise("")).alias("id"),
        F.concat(F.lit("m"), text).alias("your_marking"), F.when(F.col("id") % 2 == 0, "h").otherwise("").alias("heard"),
        F.concat(F.lit("r"), text).alias("recording"), F.lit("").alias("notes"),
    )
    return li.merge_annotations(new, old)


@query("source_counts", f"WITH {SOURCES} SELECT split_part(split_part(source, ' (', 1), ',', 1) AS name, count(*) AS n FROM wordlist GROUP BY 1")
def source_counts(spark, sf):
    return li.source_counts(li.build_wordlist(sources(spark, sf)))


@query(
    "recordings",
    """WITH r AS (SELECT doc_id AS id, 'normal' AS kind, source AS recording FROM documents UNION ALL SELECT doc_id, 'melody', CASE WHEN lang = 'en' THEN lang ELSE '' END FROM documents
 UNION ALL SELECT doc_id, CASE WHEN toxic = 1 THEN 'radio' ELSE 'normal' END, 'q' || quality FROM labels)
SELECT id, kind, recording FROM r WHERE recording <> '' AND kind IN ('melody', 'radio')""",
)
def recordings(spark, sf):
    d = table(spark, sf, "documents", "doc_id", "lang", "source")
    anchors = d.select(
        F.col("doc_id").alias("id"), F.col("source").alias("recording"),
        F.when(F.col("lang") == "en", F.col("lang")).otherwise("").alias("melody_recording"),
    )
    refs = table(spark, sf, "labels", "doc_id", "quality", "toxic").select(
        F.col("doc_id").alias("id"), F.when(F.col("toxic") == 1, "radio").otherwise("normal").alias("kind"),
        F.concat(F.lit("q"), F.col("quality").cast("string")).alias("recording"),
    )
    return li.recordings(anchors, refs, ["melody", "radio"])


@query(
    "documented_union",
    f"""WITH {SOURCES}, f AS (SELECT ord, plain AS marked, 'family' AS category FROM w1 WHERE length(plain) > 6), nw AS (SELECT ord, plain AS marked, 'word' AS category FROM w2),
p AS (SELECT ord, plain AS marked, 'pair' AS category FROM w1 WHERE length(plain) <= 6), fresh AS (SELECT min(ord) AS ord, marked, 'word' AS category FROM nw WHERE marked NOT IN (SELECT marked FROM f) GROUP BY marked),
u AS (SELECT 1 AS prio, * FROM f UNION ALL SELECT 2, * FROM fresh UNION ALL SELECT 3, * FROM p) SELECT row_number() OVER (ORDER BY prio, ord) AS id, marked, category FROM u""",
)
def documented_union(spark, sf):
    b, c = sources(spark, sf)

    def part(df, name):
        return df.select("ord", F.col("plain").alias("marked"), F.lit(name).alias("category"))

    return li.documented_union(
        part(b.where(F.length("plain") > 6), "family"), part(c, "word"), part(b.where(F.length("plain") <= 6), "pair")
    )


@query(
    "minimal_pairs",
    f"""WITH {MARKED}, v AS (SELECT DISTINCT plain, word AS marked, length(word)::VARCHAR AS meaning FROM mw),
s AS (SELECT plain, count(*) AS variants, string_agg(marked || '=' || meaning, '; ' ORDER BY marked, meaning) AS ways FROM v GROUP BY plain)
SELECT plain, variants, ways FROM s WHERE variants > 1""",
)
def minimal_pairs(spark, sf):
    w = vocabulary(spark, sf).select(
        mk.plain(F.col("word")).alias("plain"), F.col("word").alias("marked"),
        F.length("word").cast("string").alias("meaning"),
    )
    pairs = li.minimal_pairs(w)
    return pairs.withColumn("ways", F.array_join(F.transform("ways", lambda x: F.concat(x["marked"], F.lit("="), x["meaning"])), "; "))


@query(
    "word_status",
    f"""WITH {VOCAB}, a AS (SELECT DISTINCT {plain_sql('word')} AS p, {moras_sql('word')} AS m FROM bvocab), d AS (SELECT word, {plain_sql('word')} AS p, {moras_sql('word')} AS m, length(word) AS n FROM dvocab)
SELECT d.word AS id, CASE WHEN a.p IS NOT NULL THEN 'standard' WHEN n % 2 = 0 AND n % 3 = 0 THEN 'verified' WHEN n % 2 = 0 THEN 'confirmed' ELSE 'none' END AS status FROM d LEFT JOIN a ON a.p = d.p AND a.m = d.m""",
)
def word_status(spark, sf):
    """Two takes per word; only the later one says whether the speaker agrees."""
    docs, bench = vocabularies(spark, sf)
    documented = docs.select(F.col("word").alias("id"), F.col("word").alias("plain"), F.col("word").alias("marked"))
    n = F.length("word")
    take = F.explode(
        F.array(
            F.struct(F.lit(1).alias("seq"), F.lit("yes").alias("speaker_agrees"), F.lit("yes").alias("vowel_ok")),
            F.struct(
                F.lit(2).alias("seq"), F.when(n % 2 == 0, "yes").otherwise("no").alias("speaker_agrees"),
                F.when(n % 3 == 0, "yes").otherwise("no").alias("vowel_ok"),
            ),
        )
    )
    takes = docs.select(F.col("word").alias("id"), take.alias("_t")).select(
        "id", "_t.seq", "_t.speaker_agrees", "_t.vowel_ok", F.lit("no").alias("whole_ok")
    )
    anchors = bench.select(F.col("word").alias("plain"), F.col("word").alias("example"))
    return li.word_status(documented, anchors, takes).select("id", "status")


@query(
    "mine_exemplars",
    f"""WITH {VOCAB}, c AS (SELECT conv_id * 1000 + turn AS clip_id, role AS speaker, regexp_split_to_array(lower(text), '\\s+') AS l FROM conversations),
r AS (SELECT clip_id, speaker, l, unnest(range(0, len(l))) AS pos, unnest(l) AS word FROM c),
h AS (SELECT clip_id, speaker, pos, word FROM r WHERE pos < len(l) - 1 AND (pos = 0 OR l[pos] NOT IN {lst(sl.CONNECTIVES)}) AND word IN (SELECT word FROM bvocab))
SELECT clip_id, speaker, pos::INTEGER AS pos, word FROM h QUALIFY row_number() OVER (PARTITION BY word, speaker ORDER BY clip_id, pos) <= 5""",
)
def mine_exemplars(spark, sf):
    """At most 5 per word and speaker: the cap is the operator."""
    clips = spread(table(spark, sf, "conversations", "conv_id", "turn", "role", "text")).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("clip_id"), F.col("role").alias("speaker"),
        F.lower("text").alias("text"),
    )
    return li.mine_exemplars(clips, benchmark_vocabulary(spark, sf), 5, sl.CONNECTIVES)


HEARD = "replace(replace(word, 'é', 'e'), 'ee', 'e')"


@query(
    "agreement_totals",
    f"""WITH {MARKED}, g AS (SELECT word AS gold, {HEARD} AS heard FROM vocab), m AS (SELECT gold, heard, {moras_sql('gold')} AS a, {moras_sql('heard')} AS b FROM g),
t AS (SELECT *, len(a) = len(b) AND list_bool_and(list_concat([TRUE], [length(a[i]) = length(b[i]) for i in range(1, len(a) + 1)])) AS la,
 len(a) = len(b) AND list_bool_and(list_concat([TRUE], [contains(a[i], 'H') = contains(b[i], 'H') AND (length(a[i]) = 1 OR a[i] = b[i]) for i in range(1, len(a) + 1)])) AS ta FROM m)
SELECT count(*) AS n, count(*) FILTER (WHERE gold = heard) AS exact, count(*) FILTER (WHERE la) AS length, count(*) FILTER (WHERE ta) AS tone FROM t""",
)
def agreement_totals(spark, sf):
    words = vocabulary(spark, sf).select(
        F.col("word").alias("gold"), F.replace(F.replace("word", F.lit("é"), F.lit("e")), F.lit("ee"), F.lit("e")).alias("heard")
    )
    return li.agreement_totals(li.agreement(words))


@query(
    "score_by_kind",
    """SELECT lang AS kind, count(*) FILTER (WHERE quality = 1) AS right_n, count(*) AS n, floor(100 * count(*) FILTER (WHERE quality = 1) / count(*))::BIGINT AS percent
FROM documents JOIN labels USING (doc_id) GROUP BY lang""",
)
def score_by_kind(spark, sf):
    """Takes are labelled documents: language is the kind, quality 1 a right answer."""
    docs = table(spark, sf, "documents", "doc_id", "lang")
    labels = table(spark, sf, "labels", "doc_id", "quality")
    takes = docs.join(labels, "doc_id").select(F.col("lang").alias("kind"), (F.col("quality") == 1).alias("correct"))
    return li.score_by_kind(takes)


@query(
    "word_summary",
    """WITH e AS (SELECT *, user_id AS id FROM events), a AS (SELECT DISTINCT user_id AS id FROM events)
SELECT a.id, count(*) FILTER (WHERE event_type IN ('signup', 'error')) AS extra, count(*) FILTER (WHERE event_type = 'view') AS radio, count(*) FILTER (WHERE event_type IN ('click', 'purchase')) AS tests,
 count(*) FILTER (WHERE event_type IN ('click', 'purchase') AND value > 10) AS right_n, arg_max(props, event_id) FILTER (WHERE event_type IN ('click', 'purchase')) AS last_prediction,
 arg_max(value > 10, event_id) FILTER (WHERE event_type IN ('click', 'purchase')) AS last_ok FROM a JOIN e USING (id) GROUP BY a.id""",
)
def word_summary(spark, sf):
    """Events read as logs: signup and error rows are extra takes, views radio takes, the rest tests."""
    e = spread(table(spark, sf, "events", "event_id", "user_id", "event_type", "value", "props")).withColumnRenamed("user_id", "id")
    kind = F.col("event_type")
    refs = e.where(kind.isin("signup", "error", "view")).select(
        "id", F.when(kind == "view", "radio").otherwise("normal").alias("kind")
    )
    takes = e.where(kind.isin("click", "purchase")).select(
        "id", F.col("event_id").alias("seq"), F.col("props").alias("predicted"), (F.col("value") > 10).alias("correct")
    )
    return li.word_summary(e.select("id").distinct(), refs, takes)


@query("latest_take", "SELECT user_id AS id, arg_max(event_id, ts) AS event_id, arg_max(value, ts) AS value, arg_max(event_type, ts) AS event_type FROM events GROUP BY user_id")
def latest_take(spark, sf):
    log = spread(table(spark, sf, "events", "event_id", "ts", "user_id", "event_type", "value"))
    return li.latest_take(log.withColumnRenamed("user_id", "id"), ["id"], "ts", ["event_id", "value", "event_type"])


DONE = "(quality IS NOT NULL)"
WORDS = """ws AS (SELECT d.doc_id AS id, CASE WHEN quality IS NOT NULL THEN 'r' || d.doc_id ELSE '' END AS recording, CASE WHEN quality = 1 THEN 'm' ELSE '' END AS your_marking,
 CASE WHEN lang = 'fr' THEN source ELSE '' END AS pair, CASE WHEN lang <> 'en' THEN lang ELSE '' END AS family FROM documents d LEFT JOIN labels l USING (doc_id))"""


def words(spark, sf):
    d = table(spark, sf, "documents", "doc_id", "lang", "source")
    j = d.join(table(spark, sf, "labels", "doc_id", "quality"), "doc_id", "left")
    return j.select(
        F.col("doc_id").alias("id"),
        F.when(F.col("quality").isNotNull(), F.concat(F.lit("r"), F.col("doc_id").cast("string"))).otherwise("").alias("recording"),
        F.when(F.col("quality") == 1, "m").otherwise("").alias("your_marking"),
        F.when(F.col("lang") == "fr", F.col("source")).otherwise("").alias("pair"),
        F.when(F.col("lang") != "en", F.col("lang")).otherwise("").alias("family"),
    )


@query("progress", f"WITH {WORDS} SELECT count(*) AS n, count(*) FILTER (WHERE recording <> '') AS recorded, count(*) FILTER (WHERE recording <> '' AND your_marking <> '') AS marked FROM ws")
def progress(spark, sf):
    return li.progress(words(spark, sf))


@query(
    "worklist",
    f"""WITH {WORDS} SELECT 'all' AS show, id FROM ws UNION ALL SELECT 'recorded', id FROM ws WHERE recording <> '' UNION ALL SELECT 'not recorded', id FROM ws WHERE recording = ''
UNION ALL SELECT 'review', id FROM ws WHERE recording <> '' AND your_marking = '' UNION ALL SELECT 'pairs', id FROM ws WHERE pair <> '' UNION ALL SELECT 'families', id FROM ws WHERE family <> ''""",
)
def worklist(spark, sf):
    """Every filter, labelled, in one pass."""
    shown = F.array_compact(F.array(*[F.when(li.show_filter(s), F.lit(s)) for s in li.SHOWS]))
    return words(spark, sf).select(F.explode(shown).alias("show"), "id")


@query(
    "clip_names",
    f"WITH {SOURCES}, {OLD} SELECT id, lpad(split_part(id, '-', 1), greatest(4, length(split_part(id, '-', 1)))::INTEGER, '0') || CASE WHEN contains(id, '-') THEN '-' || split_part(id, '-', 2) ELSE '' END || '_' || plain || '.wav' AS name FROM old",
)
def clip_names(spark, sf):
    new = li.build_wordlist(sources(spark, sf))
    way = F.concat((F.col("id") * 7).cast("string"), F.when(F.col("id") % 3 == 1, "-2").otherwise(""))
    old = new.select("plain", way.alias("id"))
    return old.select("id", li.clip_name(F.col("id"), F.col("plain")).alias("name"))


@query(
    "violations_per_window",
    "SELECT time_bucket(INTERVAL '6 hours', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL",
)
def violations_per_window(spark, sf):
    return li.per_window(spread(table(spark, sf, "events", "ts", "event_type")), "ts", "6 hours", ["event_type"])


@query(
    "aligned_documents",
    f"""WITH {VOWELS} SELECT clip_id, i // 64 AS part, count(*) AS vowels, min(i) AS first_i, max(i) AS last_i, round(sum(dur), 4) AS dur FROM vo GROUP BY clip_id, part""",
)
def aligned_documents(spark, sf):
    """Nested and unnested again; the parts are compared."""
    docs = tb.nest_aligned(vowels(spark, sf), part=64)
    total = F.aggregate("vowels", F.lit(0.0), lambda a, x: a + x["dur"])
    return docs.select(
        "clip_id", "part", F.size("vowels").cast("bigint").alias("vowels"), F.col("vowels")[0]["i"].alias("first_i"),
        F.element_at("vowels", -1)["i"].alias("last_i"), F.round(total, 4).alias("dur"),
    )
