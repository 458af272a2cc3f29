"""Tone and length marks of words.

A marked word is read into its plain letters and one mora string per vowel ("L", "H", "LL", "HL", "LH", "HH").
All of it is array expressions in the row: nothing is exploded or joined to mark, compare or transfer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions.text import VOWELS
from lexweave.plans.scale import salted_join
from lexweave.sources import fixed

HIGH = "́"
# Accents that mean nothing here are taken off; acute and circumflex both mean High.
PLAIN_FROM, PLAIN_TO = "àäãåāèëēìïīòöõōùüūçñ", "aaaaaeeeiiioooouuucn"
ACUTE = dict(zip("aeiou", "áéíóú"))
CIRCUMFLEX = dict(zip("aeiou", "âêîôû"))

VOWEL_RUN = "(" + "|".join(f"{v}{HIGH}?(?:{v}{HIGH}?)?" for v in VOWELS) + ")"


def decompose(word: Column) -> Column:
    """Lower case, High written as a combining accent after its vowel."""
    out = F.translate(F.lower(word), PLAIN_FROM, PLAIN_TO)
    for v in VOWELS:
        out = F.regexp_replace(out, f"[{ACUTE[v]}{CIRCUMFLEX[v]}]", v + HIGH)
    return F.regexp_replace(out, "[̂]", HIGH)


def moras(word: Column) -> Column:
    """Mora string of every vowel; a doubled vowel is one long vowel."""
    runs = F.regexp_extract_all(decompose(word), F.lit(VOWEL_RUN), F.lit(1))
    return F.transform(runs, lambda r: F.regexp_replace(F.regexp_replace(r, f"[{VOWELS}]{HIGH}", "H"), f"[{VOWELS}]", "L"))


def plain(word: Column) -> Column:
    """The letters the word is spelled with: accents off, doubled vowels single."""
    return F.regexp_replace(F.replace(decompose(word), F.lit(HIGH), F.lit("")), f"([{VOWELS}])\\1", "$1")


def vowel_letters(plain_word: Column) -> Column:
    return F.regexp_extract_all(plain_word, F.lit(f"([{VOWELS}])"), F.lit(1))


def written(letter: Column, mora: Column) -> Column:
    """One vowel with its marks: the letter per mora, with an acute where it is High."""
    return F.replace(F.replace(mora, F.lit("H"), F.translate(letter, "aeiou", "áéíóú")), F.lit("L"), letter)


def write(plain_word: Column, mora: Column) -> Column:
    """Plain letters and mora strings back to a marked word: what stands between the vowels, woven with them."""
    between = F.split(plain_word, f"[{VOWELS}]", -1)
    marked = F.zip_with(vowel_letters(plain_word), mora, lambda c, m: F.coalesce(written(c, m), c))
    return F.array_join(
        F.zip_with(between, marked, lambda b, v: F.concat(b, F.coalesce(v, F.lit("")))), ""
    )


def marks_explode(words: DataFrame, word: str = "word") -> DataFrame:
    """P15. ``word, plain, vowel_no, letter, moras``: one row per vowel."""
    m = words.select(F.col(word).alias("word"), plain(F.col(word)).alias("plain"), moras(F.col(word)).alias("_m"))
    pairs = F.arrays_zip(vowel_letters(F.col("plain")).alias("l"), F.col("_m").alias("m"))
    rows = m.select("word", "plain", F.posexplode(pairs).alias("_at", "_v"))
    return rows.select(
        "word", "plain", (F.col("_at") + 1).alias("vowel_no"), F.col("_v")["l"].alias("letter"),
        F.col("_v")["m"].alias("moras"),
    )


def marks_write(words: DataFrame, plain_col: str = "plain", moras_col: str = "moras", out: str = "marked") -> DataFrame:
    """P15 inverse. ``moras`` is the array of mora strings."""
    return words.withColumn(out, write(F.col(plain_col), F.col(moras_col)))


def length_signature(word: Column) -> Column:
    """P17. Moras per vowel as digits, "121" for a word with a long second vowel."""
    return F.array_join(F.transform(moras(word), lambda m: F.length(m).cast("string")), "")


def marking_variants(words: DataFrame, word: str = "word", most: int = 10) -> DataFrame:
    """P16. Candidate markings in the order a learner tries them, equal ones once, at most ten:
    unmarked, one short High on either of the last two vowels, then one long vowel low, falling, rising."""
    low = words.select(F.col(word).alias("word"), plain(F.col(word)).alias("plain"))
    n = F.size(vowel_letters(F.col("plain")))
    low = low.withColumn("_n", n)

    def one(i: Column, mora: str) -> Column:
        slots = F.sequence(F.lit(0), F.col("_n") - 1)
        return F.transform(slots, lambda j: F.when(j == i, F.lit(mora)).otherwise(F.lit("L")))

    last, before = F.col("_n") - 1, F.col("_n") - 2
    long_at = F.when(F.col("_n") >= 2, before).otherwise(last)
    some, two = F.col("_n") >= 1, F.col("_n") >= 2
    options = F.array_compact(
        F.array(
            F.when(some, one(F.lit(-1), "L")),
            F.when(two, one(before, "H")),
            F.when(some, one(last, "H")),
            *[F.when(some, one(long_at, m)) for m in ("LL", "HL", "LH")],
        )
    )
    rows = low.withColumn("_o", F.transform(options, lambda m: write(F.col("plain"), m)))
    rows = rows.withColumn("_o", F.when(some, F.col("_o")).otherwise(F.array(F.col("plain"))))
    rows = rows.select("word", F.posexplode(F.slice(F.array_distinct("_o"), 1, most)).alias("_at", "marking"))
    return rows.select("word", (F.col("_at") + 1).alias("rank"), "marking")


FREE, SHORT, LONG = "\ue100", "\ue101", "\ue102"
# The length rules, in the order they may overwrite a vowel.
LENGTH_RULES = [
    (f"(?<!^)[{VOWELS}](?=[mn][^{VOWELS}wy])", LONG),
    (f"(?<=[^{VOWELS}{LONG}][wy])(?<!ny)(?<!hy)[{VOWELS}](?!$)", LONG),
    (f"^[{VOWELS}]|[{VOWELS}]$", SHORT),
    (f"[{VOWELS}]", FREE),
]


def forced_length(plain_word: Column) -> Column:
    """W12. Per vowel of one word: 1 or 2 moras where a rule fixes the length, null where it is contrastive.

    Every vowel is replaced by a sign for its rule, then the signs are read off.
    """
    out = plain_word
    for pattern, sign in LENGTH_RULES:
        out = F.regexp_replace(out, pattern, sign)
    signs = F.regexp_extract_all(out, F.lit(f"([{FREE}{SHORT}{LONG}])"), F.lit(1))
    return F.transform(signs, lambda s: F.when(s == SHORT, 1).when(s == LONG, 2))


def forced_lengths(text: Column) -> Column:
    """W12 over all words of a text, one after the other."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.flatten(F.transform(words, forced_length))


def fit(mora: Column, n: Column) -> Column:
    """A reference vowel's tone on a vowel of ``n`` moras; the vowel's own length wins."""
    return (
        F.when(F.length(mora) == n, mora)
        .when(n == 1, F.when(mora.contains("H"), "H").otherwise("L"))
        .when(mora == "H", "HL")
        .otherwise("LL")
    )


def obey(mora: Column, n: Column) -> Column:
    """A vowel's moras made to follow the length rule ``n`` (null: free)."""
    return (
        F.when((n == 2) & (F.length(mora) == 1), F.concat(mora, F.lit("L")))
        .when((n == 1) & (F.length(mora) == 2), F.when(mora.contains("H"), "H").otherwise("L"))
        .otherwise(mora)
    )


def first_split(plain_word: Column) -> Column:
    """Vowels in the longest prefix that can be split off the word."""
    table = F.array(*[F.lit(p) for p in fixed.SPLIT_PREFIXES])
    fits = F.filter(
        table,
        lambda p: plain_word.startswith(p)
        & (F.length(plain_word) > F.length(p))
        & ~(p.isin("in", "im") & (F.substr(plain_word, F.length(p) + 1, F.lit(1)) == "y")),
    )
    prefix = F.coalesce(F.get(fits, F.lit(0)), F.lit(""))
    return F.size(vowel_letters(prefix))


def before_hyphen(word: Column) -> Column:
    """Number of vowels before the first hyphen."""
    return F.size(vowel_letters(plain(F.regexp_extract(word, "^([^-]*)-", 1))))


def transfer(pairs: DataFrame, reference: str = "reference", target: str = "target", out: str = "marking") -> DataFrame:
    """J19. The reference's vowel patterns on the target's vowels, lined up from the right edge.

    A hyphen in the target lines up stems at their first vowel instead; the reference's stem then begins at its own hyphen,
    or after its longest prefix. If the target shows long vowels its
    lengths are kept and only tone is taken; otherwise lengths come along. Then the length rules hold.
    """
    ref, tgt = F.replace(F.col(reference), F.lit("-"), F.lit("")), F.replace(F.col(target), F.lit("-"), F.lit(""))
    p = pairs.select(
        "*", moras(ref).alias("_r"), moras(tgt).alias("_t"), plain(tgt).alias("_p"), plain(ref).alias("_rp"),
        F.col(target).contains("-").alias("_hyphen"),
        before_hyphen(F.col(target)).alias("_tpre"), before_hyphen(F.col(reference)).alias("_rpre"),
        F.col(reference).contains("-").alias("_rhyphen"),
    )
    nr, nt = F.size("_r"), F.size("_t")
    k = F.least(nr, nt)
    stem = F.when(F.col("_rhyphen"), F.col("_rpre")).otherwise(first_split(F.col("_rp")))
    r0 = F.when(F.col("_hyphen"), stem).otherwise(nr - k)
    t0 = F.when(F.col("_hyphen"), F.col("_tpre")).otherwise(nt - k)
    p = p.select(
        "*", r0.alias("_r0"), t0.alias("_t0"), F.exists("_t", lambda m: F.length(m) == 2).alias("_own"),
        forced_lengths(F.col("_p")).alias("_rules"),
    )

    # three small steps instead of one lambda: what each step computed is then a variable, not copied code
    def counterpart(_: Column, i: Column) -> Column:
        j = i - F.col("_t0")
        return F.when((j >= 0) & (j + F.col("_r0") < nr), F.get(F.col("_r"), j + F.col("_r0")))

    def take(m: Column, a: Column) -> Column:
        low = F.replace(m, F.lit("H"), F.lit("L"))
        return F.when(a.isNull(), low).when(F.col("_own"), fit(a, F.length(m))).otherwise(a)

    taken = F.zip_with("_t", F.transform("_t", counterpart), take)
    p = p.withColumn("_m", F.zip_with(taken, "_rules", obey))
    return p.withColumn(out, write(F.col("_p"), F.col("_m"))).drop(
        "_r", "_t", "_p", "_rp", "_hyphen", "_tpre", "_rpre", "_rhyphen", "_r0", "_t0", "_own", "_rules", "_m"
    )


def same_marking(a: Column, b: Column) -> Column:
    """Equal letters and moras; hyphens do not matter."""
    x, y = F.replace(a, F.lit("-"), F.lit("")), F.replace(b, F.lit("-"), F.lit(""))
    return (plain(x) == plain(y)) & (moras(x) == moras(y))


def unmarked(word: Column) -> Column:
    """The word with its long vowels but no tone."""
    return write(plain(word), F.transform(moras(word), lambda m: F.regexp_replace(m, "H", "L")))


def family_accuracy(members: DataFrame, references: DataFrame) -> DataFrame:
    """A24. Per family: members, and how many get their own marking from their reference word.

    ``members``: family, marked; ``references``: family, reference (one row each). A large family is spread
    over many tasks by the salted join; counting merges map-side.
    """
    pairs = salted_join(members, references, ["family"]).withColumn("_bare", unmarked(F.col("marked")))
    done = transfer(pairs, "reference", "_bare").withColumn("ok", same_marking(F.col("marking"), F.col("marked")))
    return done.groupBy("family").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("reproduced"),
        F.round(F.avg(F.col("ok").cast("double")), 6).alias("share"),
    )
