"""Words joined with lexicon and affix tables.

All of these work on a vocabulary (one row per form, already hash-partitioned by ``word`` after counting).
Prefix tests are equi-joins: the first one to four letters of a word are exploded and looked up. Picking
the first match groups by ``word`` again, on the partitioning that is already there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions.text import VOWELS
from lexweave.operators import verbforms
from lexweave.plans.scale import BROADCAST_ROWS, bounded, local_table, salted_join
from lexweave.sources import fixed
from lexweave.sources.dimensions import first_hits, with_order

V1 = f"^[{VOWELS}]"


def at(word: Column, n: int) -> Column:
    """Letter ``n`` counted from 0."""
    return F.substring(word, n + 1, 1)


def prefix_candidates(vocab: DataFrame, table: DataFrame, longest: int, word: str = "word") -> DataFrame:
    """Every row of ``table`` whose ``prefix`` starts the word, with the rest of the word."""
    sizes = F.sequence(F.lit(1), F.least(F.lit(longest), F.length(word)))
    starts = vocab.withColumn("prefix", F.explode(F.transform(sizes, lambda n: F.substr(F.col(word), F.lit(1), n))))
    hits = starts.join(table, "prefix")
    return hits.withColumn("rest", F.substr(word, F.length("prefix") + 1))


def pick_first(rows: DataFrame, key: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    best = rows.groupBy(key).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("_b"))
    return best.select(key, *[F.col("_b")[c].alias(c) for c in columns])


def lexicon_tag(vocab: DataFrame, invariables: DataFrame, pronouns: DataFrame, known: DataFrame) -> DataFrame:
    """J1. First hit by priority: invariable, pronoun, known word."""
    inv = first_hits(invariables).select("word", F.col("pos").alias("_inv"))
    pro = first_hits(pronouns).select("word", F.col("pron_type").alias("_pt"), F.col("noun_class").alias("_pc"))
    kno = first_hits(known).select("word", F.col("noun_class").alias("_kc"), F.col("stem").alias("_ks"))
    # one row per form on both sides, so no key is hot; Spark broadcasts the lists that are small
    j = vocab.join(inv, "word", "left").join(pro, "word", "left").join(kno, "word", "left")
    is_inv, is_pro = F.col("_inv").isNotNull(), F.col("_pt").isNotNull()
    is_kno = F.col("_kc").isNotNull()
    pos = F.when(is_inv, F.col("_inv")).when(is_pro, "PRONOUN").when(is_kno, "NOUN")
    return j.select(
        *vocab.columns,
        pos.alias("pos"),
        F.when(~is_inv & is_pro, F.col("_pt")).alias("pron_type"),
        F.when(is_inv, None).when(is_pro, F.col("_pc")).otherwise(F.col("_kc")).alias("noun_class"),
        F.when(~is_inv & ~is_pro, F.col("_ks")).alias("stem"),
    )


# Two-letter prefixes accepted after the comparison particle, with their class.
COMPARISON = "nka"
RELAXED = [
    ("ba", 2), ("ma", 6), ("bi", 8), ("ki", 7), ("bu", 14), ("ru", 11), ("ha", 16), ("mu", 1), ("mi", 4), ("ri", 5),
    ("zi", 10), ("gi", 7),
]


def noun_class(vocab: DataFrame, prefixes: list[tuple] | None = None) -> DataFrame:
    """J2. ``word, noun_class, prefix, stem`` by the first prefix rule that holds.

    A rule asks for a shortest word length, the kind of the next letter, and sometimes that the word does
    not end like a verb. After the comparison particle the rest of the word is tested, with looser rules last.
    """
    rules = fixed.NOUN_PREFIXES if prefixes is None else prefixes
    size = len(rules)
    relaxed = [(size + i, p, c, 4, "C", "", 2, True) for i, (p, c) in enumerate(RELAXED, 1)]
    table = local_table(
        vocab.sparkSession,
        [(i, *r, False) for i, r in enumerate(rules, 1)] + relaxed,
        "ord int, prefix string, noun_class int, shortest int, after string, ending string, strip int, loose boolean",
    )
    compared = F.col("word").startswith(COMPARISON) & (F.length("word") > 6)
    forms = F.array_compact(
        F.array(
            F.struct(F.col("word").alias("form"), F.lit(0).alias("step")),
            F.when(compared, F.struct(F.substr("word", F.lit(4)).alias("form"), F.lit(1).alias("step"))),
        )
    )
    rows = vocab.select("word", F.explode(forms).alias("_f")).select("word", "_f.form", "_f.step")
    longest = max(len(r[0]) for r in rules)
    hits = prefix_candidates(rows, table, longest, "form")
    following, last = F.substring("rest", 1, 1), F.right("form", F.lit(1))
    ok = (
        (F.length("form") >= F.col("shortest"))
        & ((F.col("after") != "V") | following.rlike(V1))
        & ((F.col("after") != "C") | ((following != "") & ~following.rlike(V1)))
        & ((F.col("ending") != "N") | ~last.isin("a", "e"))
        & (~F.col("loose") | (F.col("step") == 1))
    )
    hits = hits.where(ok).withColumn("stem", F.substr("form", F.col("strip") + 1))
    return pick_first(hits, "word", ["step", "ord"], ["noun_class", "prefix", "stem"])


# Infinitive prefixes before a vowel, before a consonant, and fused with a round vowel.
INFINITIVE = "^([kg]w(?=[aeiou])|[kg]u(?=[^aeiou])|k(?=[ou].{3}))(.{2,})$"


def noun_class_column(word: Column, prefixes: Sequence[tuple]) -> Column:
    """J2 for a short prefix table, in the row itself: the class of the first rule that holds, or null."""
    last = F.right(word, F.lit(1))

    def holds(prefix: str, shortest: int, after: str, ending: str) -> Column:
        ok = word.startswith(prefix) & (F.length(word) >= shortest)
        if after:
            ok = ok & word.rlike(f"^{prefix}[{'' if after == 'V' else '^'}{VOWELS}]")
        return ok & ~last.isin("a", "e") if ending == "N" else ok

    return F.coalesce(*[F.when(holds(p, n, a, e), F.lit(c)) for p, c, n, a, e, _ in prefixes])


def infinitives(vocab: DataFrame, stems: DataFrame | None = None, pattern: str = INFINITIVE) -> DataFrame:
    """J3. ``word, prefix, stem`` of infinitives; ``stems`` keeps only those with a known stem.

    A place suffix after -a is taken off first. The stem ends before -a, or in words of six letters or more
    before -ye, -tse, -we or -e. ``pattern`` has the prefix and the rest as its two groups.
    """
    base = F.regexp_replace("word", "^(.{3,}a)(?:ho|mo|yo)$", "$1")
    rows = vocab.select("word", base.alias("base")).where(F.length("base") >= 4)
    rows = rows.where(F.col("base").rlike(pattern))
    rest = F.regexp_extract("base", pattern, 2)
    stem = F.when(F.length("base") >= 6, F.regexp_extract(rest, "^(.+?)(?:a|ye|tse|we|e)$", 1)).otherwise(
        F.regexp_extract(rest, "^(.+)a$", 1)
    )
    out = rows.select("word", F.regexp_extract("base", pattern, 1).alias("prefix"), stem.alias("stem"))
    out = out.where(F.col("stem") != "")
    return out.join(stems.select("stem").distinct(), "stem", "left_semi") if stems is not None else out


NEGATIVE_IMPERATIVE = ["mwi", "twi", "wi"]


def verbs(
    vocab: DataFrame,
    stems: DataFrame,
    prefixes: list[tuple] | None = None,
    patterns: list[tuple] | None = None,
) -> DataFrame:
    """J4. ``word, stem, noun_class, tense, obj_class, ext, is_negative, stem_known``.

    Order of choice: negative imperative; the best reading as a generated form of a known stem (``verbforms``); for words
    that are none, subject prefix in table order and tense pattern in table order, then a bare known stem, and last the
    habitual present on an unknown stem. Tables given for another language leave the generated forms out.
    """
    generated = prefixes is None and patterns is None
    prefixes = fixed.SUBJECT_PREFIXES if prefixes is None else prefixes
    patterns = fixed.TENSE_PATTERNS if patterns is None else patterns
    known = bounded(stems.select("stem").distinct().withColumn("_known", F.lit(True)))
    w = F.col("word")
    strip = F.when(w.rlike("^nt[aiu].") | (w.startswith("si") & (F.length(w) > 4)), 2).otherwise(0)
    base = vocab.select("word", (strip > 0).alias("is_negative"), F.substr(w, strip + 1).alias("base")).where(
        F.length("base") >= 3
    )
    forbidden = [
        F.when(w.startswith(x) & w.endswith("a"), F.substr(w, F.lit(len(x) + 1), F.length(w) - len(x) - 1))
        for x in NEGATIVE_IMPERATIVE
    ]
    forbidden = base.select("word", F.posexplode(F.array(*forbidden)).alias("o1", "stem")).join(known, "stem")
    forbidden = pick_first(forbidden, "word", ["o1"], ["stem"]).select(
        "word", "stem", F.lit(None).cast("int").alias("noun_class"), F.lit("NEG_IMPERATIVE").alias("tense"),
        F.lit(None).cast("int").alias("obj_class"), F.lit(None).cast("string").alias("ext"), F.lit(True).alias("is_negative"),
        F.lit(True).alias("stem_known"),
    )
    base = base.join(forbidden.select("word"), "word", "left_anti")
    forms = forbidden
    if generated:
        read = verbforms.analyses(base.select("word"), stems).where("rank = 1")
        read = read.withColumn("stem_known", F.lit(True)).withColumn("noun_class", F.when(F.col("noun_class") > 0, F.col("noun_class")))
        forms = forbidden.unionByName(read.select(*forbidden.columns))
        base = base.join(read.select("word"), "word", "left_anti")
    return forms.unionByName(pattern_verbs(base, known, prefixes, patterns).select(*forms.columns))


def pattern_verbs(base: DataFrame, known: DataFrame, prefixes: list[tuple], patterns: list[tuple]) -> DataFrame:
    """The part of J4 for words without a generated form; ``base`` has word, is_negative and the word without negation."""
    heads = prefix_candidates(base, with_order(base.sparkSession, prefixes, "prefix string, noun_class int"), 3, "base")
    p = F.col("prefix")
    allowed = {
        "": F.lit(True),
        "ara": p == "ara",
        "!ara": p != "ara",
        "u": p.isin("u", "nu"),
        "past": p.isin(*fixed.PAST_PREFIXES),
        "pastonly": p.isin(*fixed.PAST_ONLY_PREFIXES),
        "!ka": ~p.isin("ka", "ga", "ara"),
    }
    readings = F.array(
        *[
            F.struct(
                F.lit(i).alias("rank"), F.lit(t).alias("tense"), F.lit(test).alias("test"),
                F.when(allowed[only], F.regexp_extract("rest", rx, 1)).alias("stem"),
            )
            for i, (t, only, rx, test) in enumerate(patterns, 1)
        ]
    )
    found = heads.where(F.length("rest") >= 2).withColumn("_r", F.explode(readings)).where(F.col("_r.stem") != "")
    found = found.select(
        "word", "is_negative", "noun_class", "_r.stem", "_r.tense", "_r.test", F.col("ord").alias("o1"),
        F.col("_r.rank").alias("o2"),
    )
    endings = [
        F.when(
            F.col("base").endswith(v),
            F.struct(F.substr("base", F.lit(1), F.length("base") - 1).alias("stem"), F.lit(t).alias("tense")),
        )
        for v, t in (("a", "IMPERATIVE"), ("e", "SUBJUNCTIVE"))
    ]
    bare = base.select("word", "is_negative", F.explode(F.array_compact(F.array(*endings))).alias("_x")).select(
        "word", "is_negative", F.lit(0).alias("noun_class"), "_x.stem", "_x.tense", F.lit("bare").alias("test"),
        F.lit(0).alias("o1"), F.lit(0).alias("o2"),
    )
    rows = found.unionByName(bare).join(known, "stem", "left").withColumn("known", F.coalesce("_known", F.lit(False)))
    test, size = F.col("test"), F.length("stem")
    passes = (
        F.when(test.isin("known", "bare"), F.col("known")).when(test == "known1", (size >= 2) | F.col("known")).otherwise(True)
    )
    level = F.when(test == "bare", 2).when((test == "last") & ~F.col("known"), 3).otherwise(1)
    rows = rows.where(passes).withColumn("o0", level)
    best = pick_first(
        rows, "word", ["o0", "o1", "o2"], ["stem", "noun_class", "tense", "is_negative", "known"]
    )
    return strip_affixes(best, known).withColumn(
        "noun_class", F.when(F.col("noun_class") > 0, F.col("noun_class"))
    ).select("word", "stem", "noun_class", "tense", "obj_class", "ext", "is_negative", "stem_known")


def strip_affixes(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Object marker off the front and extension off the end, when only that leaves a known stem."""
    spark = rows.sparkSession
    forms = [(f, c) for f, _, c in fixed.OBJECT_MARKERS] + [(v, c) for f, v, c in fixed.OBJECT_MARKERS if v != f]
    marker = F.array(*[F.struct(F.lit(f).alias("f"), F.lit(c).alias("c")) for f, c in forms])
    ending = F.array(*[F.struct(F.lit(e).alias("e"), F.lit(n).alias("n")) for e, n in fixed.EXTENSIONS])
    s = F.col("stem")
    om = F.get(F.filter(marker, lambda m: s.startswith(m["f"]) & (F.length(s) > F.length(m["f"]))), F.lit(0))
    ex = F.get(F.filter(ending, lambda e: s.endswith(e["e"]) & (F.length(s) >= F.length(e["e"]) + 2)), F.lit(0))
    r = rows.withColumn("_om", om).withColumn("_ex", ex)
    head, tail = F.coalesce(F.length("_om.f"), F.lit(0)), F.coalesce(F.length("_ex.e"), F.lit(0))

    def option(rank: int, a: Column, b: Column, cls: Column, ext: Column) -> Column:
        return F.struct(
            F.lit(rank).alias("rank"), F.substr(s, a + 1, F.length(s) - a - b).alias("bare"),
            cls.cast("int").alias("obj_class"), ext.cast("string").alias("ext"),
        )

    none, zero = F.lit(None), F.lit(0)
    options = F.array_compact(
        F.array(
            option(0, zero, zero, none, none),
            F.when(~F.col("known") & F.col("_om").isNotNull(), option(1, head, zero, F.col("_om.c"), none)),
            F.when(~F.col("known") & F.col("_ex").isNotNull(), option(2, zero, tail, none, F.col("_ex.n"))),
            F.when(
                ~F.col("known") & F.col("_om").isNotNull() & F.col("_ex").isNotNull()
                & (F.length(s) > head + tail),
                option(3, head, tail, F.col("_om.c"), F.col("_ex.n")),
            ),
        )
    )
    keep = [c for c in rows.columns if c not in ("stem", "known")]
    exploded = r.select(*keep, "known", F.explode(options).alias("_o"))
    exploded = exploded.select(*keep, "known", "_o.*")
    marks = known.select(F.col("stem").alias("bare"), F.col("_known").alias("_hit"))
    joined = exploded.join(marks, "bare", "left")
    hit = F.coalesce("_hit", F.lit(False))
    joined = joined.withColumn("stem_known", hit).withColumn("_order", F.when(hit, F.col("rank")).otherwise(9))
    joined = joined.where((F.col("rank") == 0) | hit)
    others = [c for c in keep if c != "word"]
    out = pick_first(
        joined, "word", ["_order", "rank"], [*others, "bare", "obj_class", "ext", "stem_known"]
    )
    return out.withColumnRenamed("bare", "stem")


def adjectives(vocab: DataFrame, prefixes: list[tuple] | None = None, stems: list[str] | None = None) -> DataFrame:
    """J5. ``word, noun_class, stem`` of concord prefix plus known adjective stem."""
    spark = vocab.sparkSession
    prefixes = fixed.ADJ_PREFIXES if prefixes is None else prefixes
    stems = fixed.ADJ_STEMS if stems is None else stems
    hits = prefix_candidates(
        vocab.select("word"), with_order(spark, prefixes, "prefix string, noun_class int"),
        max(len(p) for p, _ in prefixes),
    )
    restored = F.create_map(*[F.lit(x) for pair in fixed.ADJ_RESTORED for x in pair])
    rest, p = F.col("rest"), F.col("prefix")
    half = F.floor((F.length(rest) - F.length(p)) / 2).cast("int")
    once = F.substr(rest, F.lit(1), F.greatest(half, F.lit(0)))
    options = F.array(
        F.struct(F.lit(0).alias("o"), rest.alias("stem")),
        F.struct(F.lit(1).alias("o"), F.concat(F.element_at(restored, p), rest).alias("stem")),
        F.struct(F.lit(2).alias("o"), F.when(rest == F.concat(once, p, once), once).alias("stem")),
    )
    rows = hits.withColumn("_s", F.explode(options)).select("word", "noun_class", "ord", "_s.o", "_s.stem")
    rows = rows.join(local_table(spark, [(s,) for s in stems], "stem string"), "stem", "left_semi")
    return pick_first(rows, "word", ["ord", "o"], ["noun_class", "stem"])


def plural_lookup(vocab: DataFrame, pairs: DataFrame) -> DataFrame:
    """J6. A word found in either column of the pair table, with stem, class and side."""
    singular = pairs.select(
        F.col("singular").alias("word"), "stem", F.col("sg_class").alias("noun_class"), F.lit("singular").alias("side"),
        (F.col("ord") * 2).alias("ord"),
    )
    plural = pairs.where(F.col("plural").isNotNull()).select(
        F.col("plural").alias("word"), "stem", F.col("pl_class").alias("noun_class"), F.lit("plural").alias("side"),
        (F.col("ord") * 2 + 1).alias("ord"),
    )
    return vocab.join(first_hits(singular.unionByName(plural)).drop("ord"), "word")


def deverbatives(nouns: DataFrame, stems: DataFrame, stop: list[str] | None = None) -> DataFrame:
    """J7. Nouns derived from a verb: ``nouns`` columns plus ``verb_root``; ``nouns`` has ``stem``."""
    stop = fixed.PRIMARY_NOUN_STEMS if stop is None else stop
    known = bounded(stems.select(F.col("stem").alias("_root")).distinct())
    s = F.col("stem")
    n = F.length(s)
    root, last = F.substr(s, F.lit(1), n - 1), F.right(s, F.lit(1))
    size = n - 1
    after_two = F.substr(s, F.lit(3), n - 3)

    def option(rank: int, when: Column, value: Column) -> Column:
        return F.when(when, F.struct(F.lit(rank).alias("rank"), value.alias("key"), value.alias("cite")))

    options = F.array_compact(
        F.array(
            option(1, (last == "e") & root.endswith("z") & (size >= 2), F.concat(F.substr(root, F.lit(1), size - 1), F.lit("r"))),
            option(2, (last == "o") & root.endswith("an") & (size >= 5), F.substr(root, F.lit(1), size - 2)),
            option(3, size >= 2, root),
            F.when(
                (size >= 2) & root.startswith("i"),
                F.struct(F.lit(4).alias("rank"), F.concat(F.lit("w"), root).alias("key"), root.alias("cite")),
            ),
            option(5, s.startswith("ti") & (n >= 5) & at(s, 2).rlike(V1), after_two),
            option(5, s.startswith("ti") & (n >= 5) & ~at(s, 2).rlike(V1), F.concat(F.lit("i"), after_two)),
            option(6, s.startswith("da") & (n >= 5) & ~at(s, 2).rlike(V1), after_two),
            option(7, s.endswith("zi") & (n >= 4), F.concat(F.substr(s, F.lit(1), n - 2), F.lit("g"))),
            option(8, s.endswith("zi") & (n >= 4), F.concat(F.substr(s, F.lit(1), n - 2), F.lit("r"))),
        )
    )
    words = nouns.where(n >= 3).where(last.rlike(V1) & ~s.isin(*stop))
    distinct = words.select("stem").distinct()
    rows = distinct.select("stem", F.explode(options).alias("_o")).select("stem", "_o.rank", "_o.key", "_o.cite")
    rows = rows.join(known, rows["key"] == known["_root"]).where(F.length("key") >= 2)
    roots = pick_first(rows, "stem", ["rank"], ["cite"]).withColumnRenamed("cite", "verb_root")
    return nouns.join(roots, "stem")


def unknown_words(t: DataFrame, dictionary: DataFrame) -> DataFrame:
    """J8. Word tokens in no dictionary that are no names.

    A dictionary of checked size is broadcast. A larger one is matched against the vocabulary first, and
    the unknown forms go back to the tokens by a salted semi join, so a frequent form is spread out.
    """
    words = t.where(F.col("punct_type").isNull() & ~F.col("is_proper_noun"))
    forms = dictionary.select(F.col("word").alias("lower")).distinct()
    if forms.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return words.join(F.broadcast(forms), "lower", "left_anti")
    unknown = words.select("lower").distinct().join(forms, "lower", "left_anti")
    return salted_join(words, unknown, ["lower"], "left_semi")


def in_vocabulary(df: DataFrame, other: DataFrame, word: str = "word") -> DataFrame:
    """J10. Rows whose word also occurs in another vocabulary."""
    return df.join(other.select(word).distinct(), word, "left_semi")


def gloss(t: DataFrame, verbs: DataFrame, nouns: DataFrame, words: DataFrame, missing: str = "[?]") -> DataFrame:
    """J12. English gloss by part of speech: stems for verbs, nouns and adjectives, the form for the rest."""
    v = first_hits(verbs, "key").select(F.col("key").alias("stem"), F.col("gloss").alias("_gv"))
    n = first_hits(nouns, "key").select(F.col("key").alias("stem"), F.col("gloss").alias("_gn"))
    w = first_hits(words, "key").select(F.col("key").alias("lower"), F.col("gloss").alias("_gw"))
    j = t.join(bounded(v), "stem", "left").join(bounded(n), "stem", "left").join(bounded(w), "lower", "left")
    pos = F.col("pos")
    found = (
        F.when(pos.isin("VERB_CONJ", "VERB_INF"), F.col("_gv"))
        .when(pos.isin("NOUN", "RELATIVE_NOUN", "ADJECTIVE"), F.col("_gn"))
        .otherwise(F.col("_gw"))
    )
    return j.withColumn("gloss", F.coalesce(found, F.lit(missing))).drop("_gv", "_gn", "_gw")


def prefix_splits(vocab: DataFrame, prefixes: list[str] | None = None) -> DataFrame:
    """J20. ``word, prefix, stem, rank``: every possible split, longest prefix first; no prefix if none fits."""
    prefixes = fixed.SPLIT_PREFIXES if prefixes is None else prefixes
    table = with_order(vocab.sparkSession, [(p,) for p in prefixes], "prefix string")
    words = vocab.select("word")
    marked = F.instr("word", "-")
    by_hand = words.where(marked > 0).select(
        "word", F.substr("word", F.lit(1), marked - 1).alias("prefix"), F.substr("word", marked + 1).alias("stem"),
        F.lit(1).alias("rank"),
    )
    plain = words.where(marked == 0)
    hits = prefix_candidates(plain, table, max(len(p) for p in prefixes))
    hits = hits.where((F.col("rest") != "") & ~(F.col("prefix").isin("in", "im") & F.col("rest").startswith("y")))
    grouped = hits.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("ord", "prefix", "rest"))).alias("_c"))
    all_words = plain.join(grouped, "word", "left")
    empty = F.array(F.struct(F.lit(0).alias("ord"), F.lit("").alias("prefix"), F.col("word").alias("rest")))
    rows = all_words.select("word", F.posexplode(F.coalesce("_c", empty)).alias("_at", "_s"))
    rows = rows.select(
        "word", F.col("_s.prefix").alias("prefix"), F.col("_s.rest").alias("stem"), (F.col("_at") + 1).alias("rank")
    )
    return rows.unionByName(by_hand)
