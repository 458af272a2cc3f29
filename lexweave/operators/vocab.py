"""Word-level operators over a vocabulary (P4, P8-P13, A25) and text normalisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions import text as tx
from lexweave.plans.scale import local_table
from lexweave.sources import fixed

VOWEL = f"[{tx.VOWELS}]"


def fold_words(vocab: DataFrame) -> DataFrame:
    """P4. ``word, folded``: lower case, macron vowels reduced."""
    return vocab.withColumn("folded", tx.fold(F.col("word")))


def hiatus_words(vocab: DataFrame) -> DataFrame:
    """P9. Words with two vowels side by side, and the repair their first pair calls for."""
    return vocab.where(tx.has_hiatus(F.col("word"))).withColumn("repair", tx.hiatus_rule(F.col("word")))


def grams(vocab: DataFrame, size: int) -> DataFrame:
    """``word, pos, gram`` for every run of ``size`` letters; ``pos`` counts from 0."""
    n = F.length("word") - (size - 1)
    long_enough = vocab.where(n > 0)
    at = long_enough.select("*", F.explode(F.sequence(F.lit(0), n - 1)).alias("pos"))
    return at.withColumn("gram", F.substr("word", F.col("pos") + 1, F.lit(size)))


def legal_pairs(letters: Sequence[str] = tuple("bcdfghjklmnpqrstvwxyz")) -> list[tuple[str]]:
    """Consonant pairs that may stand side by side: m or n first, y or w second, and sh, ts, pf."""
    pairs = [a + b for a in letters for b in letters if a in "mn" or b in "yw"]
    return [(p,) for p in pairs] + [("sh",), ("ts",), ("pf",)]


def bad_clusters(vocab: DataFrame) -> DataFrame:
    """P10. ``word, pos, pair`` for consonant pairs outside the legal ones (anti join to their table)."""
    spark = vocab.sparkSession
    pairs = grams(vocab.select("word"), 2).where(F.col("gram").rlike("^[b-df-hj-np-tv-z]{2}$"))
    legal = local_table(spark, legal_pairs(), "gram string")
    return pairs.join(legal, "gram", "left_anti").select("word", "pos", F.col("gram").alias("pair"))


def ortho_scan(vocab: DataFrame, rules: list[tuple] | None = None) -> DataFrame:
    """P11. ``word, rule_id, type, pos``: every spelling rule broken, with the 0-based position.

    Words are cut into runs of one to three letters and joined with the rule table on the run itself, so
    the work is one hash lookup per letter whatever the number of rules.
    """
    rules = fixed.ORTHO_RULES if rules is None else rules
    spark = vocab.sparkSession
    words = vocab.select("word")
    sizes = sorted({len(r[2]) for r in rules})
    n = F.length("word")
    runs = words.select("word", F.explode(F.sequence(F.lit(0), n - 1)).alias("pos")).where(n > 0)
    cut = [F.substr("word", F.col("pos") + 1, F.lit(k)) for k in sizes]
    runs = runs.select("word", "pos", F.explode(F.array_distinct(F.array(*cut))).alias("gram"))
    hits = runs.join(local_table(spark, rules, "rule_id string, type string, gram string, place string"), "gram")
    before = F.when(F.col("pos") > 0, F.substr("word", F.col("pos"), F.lit(1))).otherwise("")
    holds = (
        F.when(F.col("place") == "start", (F.col("pos") == 1) & F.col("word").startswith("i"))
        .when(
            F.col("place") == "o",
            (F.col("pos") > 0) & F.col("word").contains("o") & ~before.rlike(VOWEL),
        )
        .when(F.col("place") == "first", F.instr("word", F.col("gram")) == F.col("pos") + 1)
        .otherwise(True)
    )
    return hits.where(holds).select("word", "rule_id", "type", F.col("pos").cast("int").alias("pos"))


# What a fixable run becomes.
REPAIRS = [
    ("nf", "mf"), ("nb", "mb"), ("np", "mp"), ("nv", "mv"), ("nh", "mp"), ("dy", "z"), ("gy", "z"), ("sy", "sh"),
    ("zy", "j"), ("ky", "ts"), ("ty", "s"), ("nts", "ns"), ("nc", "nsh"), ("mpf", "mf"),
]
FIXABLE = "^(.*?)(n[fbpvh]|[dgszkt]y|nts|nc|mpf)(.*)$"
ASSIMILATE = f"^(.*?[^{tx.VOWELS}])i(r|sh)(.*)$"


def repair_once(word: Column) -> Column:
    """The leftmost fixable violation repaired; the word itself if there is none."""
    head, run, tail = (F.regexp_extract(word, FIXABLE, i) for i in (1, 2, 3))
    table = F.create_map(*[F.lit(x) for pair in REPAIRS for x in pair])
    after_n = head.endswith("n")
    fixed_run = (
        F.when((run == "ky") & after_n, "s")
        .when((run == "ty") & head.endswith("a") & tail.rlike(f"^{VOWEL}"), "sh")
        .otherwise(F.element_at(table, run))
    )
    return (
        F.when(word.rlike("^in[mn]"), F.concat(F.lit("i"), F.substr(word, F.lit(3))))
        .when(run != "", F.concat(head, fixed_run, tail))
        .when(word.contains("o"), F.regexp_replace(word, ASSIMILATE, "$1e$2$3"))
        .otherwise(word)
    )


def repair(word: Column, rounds: int = 8) -> Column:
    """P12 on one column: one repair per round. The rounds are a fold, so the expression stays small."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), word, lambda w, _: repair_once(w))


def ortho_repair(vocab: DataFrame) -> DataFrame:
    """P12. ``word, fixed, settled``; ``settled`` is false if one more round would still change the word."""
    out = vocab.select("word").withColumn("fixed", repair(F.col("word")))
    return out.withColumn("settled", repair_once(F.col("fixed")) == F.col("fixed"))


def illegal_l(t: DataFrame) -> DataFrame:
    """P13. Tokens with the letter l that are no proper names."""
    return t.where(F.col("punct_type").isNull() & ~F.col("is_proper_noun") & F.col("lower").contains("l"))


def check_spelling(df: DataFrame, plain: str, marked: str) -> DataFrame:
    """P13. Rows whose annotation does not spell the plain word once accents and doubling are undone."""
    bare = F.translate(F.lower(F.col(marked)), "áéíóúâêîôû-", "aeiouaeiou")
    letters = F.regexp_replace(bare, f"({VOWEL})\\1", "$1")
    return df.where(letters != F.lower(F.col(plain)))


def _by_first_letter(graphemes: Sequence[str]) -> str:
    """A pattern that finds what the graphemes, tried in order, find: a letter looks only at those that begin with it."""
    rests: dict[str, list[str]] = {}
    for g in graphemes:
        rests.setdefault(g[0], []).append(g[1:])
    alike: dict[tuple[str, ...], str] = {}
    for letter, tails in rests.items():
        alike[tuple(tails)] = alike.get(tuple(tails), "") + letter
    return "|".join(f"[{letters}](?:{'|'.join(tails)})" for tails, letters in alike.items())


LETTERS = "".join(dict.fromkeys(g[0] for g, _, _ in fixed.PHONEMES))
GRAPHEME = "(" + _by_first_letter([g for g, _, _ in fixed.PHONEMES]) + ")"
# Stand around each phoneme while a text is read.
OPEN, CLOSE = "\u0002", "\u0003"


def phonemes(vocab: DataFrame, word: str = "word") -> DataFrame:
    """P8. ``word, pos, grapheme, token, ipa``: longest match first; letters outside the table are skipped."""
    parts = vocab.select(
        F.col(word).alias("word"),
        F.posexplode(F.regexp_extract_all(F.lower(F.col(word)), F.lit(GRAPHEME), F.lit(1))).alias("_at", "grapheme"),
    )
    table = local_table(vocab.sparkSession, fixed.PHONEMES, "grapheme string, token string, ipa string")
    return parts.join(table, "grapheme").select(
        "word", (F.col("_at") + 1).cast("int").alias("pos"), "grapheme", "token", "ipa"
    )


def phoneme_string(text: Column) -> Column:
    """The phonemes of a text as one string, ``|`` between words; pauses stay as marks.

    The text is read in a few passes over the whole of it, not letter by letter: phonemes are marked, all else but blanks goes,
    and what stands between two of them becomes their separator.
    """
    read = F.lower(text)
    for mark in (OPEN, CLOSE):
        read = F.replace(read, F.lit(mark), F.lit("\u0004"))
    read = F.regexp_replace(read, GRAPHEME[:-1] + r"|\.|,)", f"{OPEN}$1{CLOSE}")
    read = F.regexp_replace(read, f"[^{LETTERS}., \t{OPEN}{CLOSE}]+", "")
    for g, t, _ in fixed.PHONEMES:
        if g != t:
            read = F.replace(read, F.lit(OPEN + g + CLOSE), F.lit(OPEN + t + CLOSE))
    read = F.replace(read, F.lit(CLOSE + OPEN), F.lit(" "))
    read = F.regexp_replace(read, f"{CLOSE}[ \t]+{OPEN}", " | ")
    return F.btrim(read, F.lit(f"{OPEN}{CLOSE} \t"))


def phoneme_profile(df: DataFrame, text: str = "text", ids: Sequence[str] = ("doc_id",)) -> DataFrame:
    """A25. Count and share of every phoneme per document.

    Graphemes never span two words, so they are read from the whole text; each document leaves its task as
    at most one row per phoneme, and the share is a window over those few rows.
    """
    parts = df.select(
        *ids, F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(GRAPHEME), F.lit(1))).alias("grapheme")
    )
    table = local_table(
        df.sparkSession, [(g, t) for g, t, _ in fixed.PHONEMES], "grapheme string, token string"
    )
    counts = parts.groupBy(*ids, "grapheme").agg(F.count(F.lit(1)).alias("n")).join(table, "grapheme")
    total = F.sum("n").over(Window.partitionBy(*ids))
    return counts.select(*ids, "token", "n", F.round(F.col("n") / total, 6).alias("share"))


def number_words(n: Column) -> Column:
    """0-9999 as words: thousands, hundreds, tens and units, "na" between the parts that are there."""
    units = F.array(*[F.lit(u) for u in fixed.UNITS])
    tens = F.array(*[F.lit(t) for t in fixed.TENS])

    def digit(k: int) -> Column:
        return F.floor(n / F.lit(10**k)).cast("int") % 10

    def unit(k: int) -> Column:
        return F.element_at(units, digit(k) + 1)

    parts = F.array(
        F.when(digit(3) == 1, "igihumbi").when(digit(3) > 1, F.concat(F.lit("ibihumbi "), unit(3))),
        F.when(digit(2) == 1, "ijana").when(digit(2) > 1, F.concat(F.lit("amagana "), unit(2))),
        F.when(digit(1) > 0, F.element_at(tens, digit(1) + 1)),
        F.when(digit(0) > 0, unit(0)),
    )
    return F.when(n == 0, fixed.UNITS[0]).otherwise(F.array_join(F.array_compact(parts), " na "))


def normalize(text: Column) -> Column:
    """P7 on one column: clitics, numbers, abbreviations, marks, blanks."""
    whole = F.regexp_replace(text, "([nNyY])'", "$1a ")
    whole = F.regexp_replace(whole, "([kKmM])'", "$1u ")
    whole = F.regexp_replace(whole, "([A-Za-z])'", "$1 ")
    # numbers, abbreviations that stand alone, and all between them in one piece
    known = "(?i:" + "|".join(a for a, _ in fixed.ABBREVIATIONS) + ")(?![A-Za-z])"
    between = f"(?:[^0-9A-Za-z]++|(?!{known})[A-Za-z]++)++"
    pieces = F.regexp_extract_all(F.when(text.contains("'"), whole).otherwise(text), F.lit(f"([0-9]+|{known}|{between})"), F.lit(1))
    short = F.create_map(*[F.lit(x) for pair in fixed.ABBREVIATIONS for x in pair])

    def piece(p: Column) -> Column:
        value = F.try_to_number(p, F.lit("9" * 18)).cast("bigint")
        return (
            F.when(p.rlike("^[0-9]+$"), F.when(value <= 9999, number_words(value)).otherwise(p))
            .when(p.rlike("^[A-Za-z]+$"), F.coalesce(F.element_at(short, F.lower(p)), p))
            .otherwise(p)
        )

    out = F.array_join(F.transform(pieces, piece), "")
    for mark, said in (("!", "."), ("?", "."), (".", " ."), (",", " ,"), ("-", " "), (";", " "), (":", " ")):
        out = F.replace(out, F.lit(mark), F.lit(said))
    return F.btrim(F.regexp_replace(out, r"[ \t\n\r]+", " "))


def normalize_corpus(df: DataFrame, text: str = "text") -> DataFrame:
    """P7. The text ready to be read aloud. Row by row: nothing is exploded, joined or shuffled."""
    return df.withColumn(text, normalize(F.col(text)))
