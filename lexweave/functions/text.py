"""Column expressions for text: splitting, folding, spelling tests. All run inside Spark SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEP = "\u0001"
VOWELS = "aeiou"

# Punctuation marks and their types.
MARKS = {
    ",": "COMMA",
    ".": "PERIOD",
    "?": "QUESTION",
    "!": "EXCLAIM",
    ";": "SEMICOLON",
    ":": "COLON",
    "(": "PAREN_OPEN",
    ")": "PAREN_CLOSE",
    '"': "QUOTE",
    "“": "QUOTE_OPEN",
    "”": "QUOTE_CLOSE",
    "‘": "QUOTE_OPEN",
    "’": "QUOTE_CLOSE",
    "«": "QUOTE_OPEN",
    "»": "QUOTE_CLOSE",
    "<<": "QUOTE_OPEN",
    ">>": "QUOTE_CLOSE",
    "–": "DASH",
    "—": "DASH",
    "--": "DASH",
}
TERMINAL = ("PERIOD", "QUESTION", "EXCLAIM")
CLAUSE = ("COMMA", "SEMICOLON")

# Marks that end a word wherever they stand.
STOPS = '.,!?;:()"“”«»–—'
# Stands for a right single quote that closes a quotation (it did not follow a letter).
CLOSING = "\ue000"
BLANKS = " \t\n\r"
ASCII_BLANKS = BLANKS + "\x0b\f"
DOUBLED = "(<<|>>|--)"
LOOSE_QUOTE = f"(^|[{BLANKS}{STOPS}‘])’"
AFTER_APOSTROPHE = f"(['’])[{BLANKS}]+"
OPENING = f"(?<![^{BLANKS}])‘"
LONE_APOSTROPHE = f"(?<![^{BLANKS}])['’]+(?![^{BLANKS}])"


def ascii_trim(c: Column) -> Column:
    return F.btrim(c, F.lit(ASCII_BLANKS))


def split_lines(text: Column) -> Column:
    return F.split(text, r"\r?\n")


def split_sentences(text: Column, blank: str = r"[ \n]+") -> Column:
    """Array of sentences: a terminal mark followed by blanks ends one; blanks in between are dropped."""
    marked = F.regexp_replace(text, f"([.!?]){blank}", f"$1{SEP}")
    parts = F.transform(F.split(marked, SEP), ascii_trim)
    return F.filter(parts, lambda s: s != "")


def blank_numbers(text: Column) -> Column:
    """Replace digit runs that stand alone by a space."""
    return F.regexp_replace(text, r"\d(?<![\p{L}\p{N}_].)\d*(?![\p{L}\p{N}_])", " ")


def token_strings(text: Column) -> Column:
    """Array of raw tokens; a leading apostrophe is kept as a sign that one was split there.

    Marks are set apart by blanks and the text is cut at blanks. The patterns for doubled marks, apostrophes
    and single quotes run only on texts that have one: native searches instead of patterns over every character.
    """
    rare = F.lit(False)
    for mark in ("<<", ">>", "--", "'", "’", "‘"):
        rare = rare | text.contains(mark)
    full = F.regexp_replace(text, DOUBLED, " $1 ")
    full = F.regexp_replace(full, LOOSE_QUOTE, f"$1 {CLOSING} ")
    full = F.regexp_replace(F.regexp_replace(full, AFTER_APOSTROPHE, "$1"), "(['’]+)", " $1")
    full = F.regexp_replace(full, f"([{STOPS}{CLOSING}])", " $1 ")
    full = F.regexp_replace(F.regexp_replace(full, OPENING, " ‘ "), OPENING, " ‘ ")
    full = F.regexp_replace(full, LONE_APOSTROPHE, " ")
    common = F.regexp_replace(text, f"([{STOPS}])", " $1 ")
    spaced = F.btrim(F.when(rare, full).otherwise(common), F.lit(BLANKS))
    return F.array_remove(F.split(spaced, f"[{BLANKS}]+"), "")


def _one_blank(text: Column, blanks: str) -> Column:
    for blank in blanks[1:]:
        text = F.replace(text, F.lit(blank), F.lit(blanks[0]))
    return text


def blank_pieces(text: Column) -> Column:
    """Array of what stands between blanks; after an apostrophe nothing is cut, as the next word belongs to it. May hold empty pieces.

    Cutting at one fixed character is a native search; the pattern runs only where an apostrophe stands before a blank.
    """
    flat = _one_blank(text, BLANKS)
    held = flat.contains("' ") | flat.contains("’ ")
    return F.when(held, F.split(flat, "(?<!['’ ]) +")).otherwise(F.split(flat, " "))


def mark_type(surface: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in MARKS.items() for x in pair])
    return F.when(F.length(surface) <= 2, F.element_at(table, surface))


def word_of(raw: Column) -> Column:
    """A raw corpus-count word without the marks around it, lower case."""
    return F.btrim(F.lower(raw), F.lit(".,;:!?() \t"))


def raw_frequency_words(sentence: Column) -> Column:
    """Array of raw words for corpus counts: quotes and lone numbers out."""
    return F.split(blank_numbers(F.regexp_replace(sentence, "[«»\"“”']+", " ")), r"\s+")


def raw_frequency_pieces(sentence: Column) -> Column:
    """Array of what stands between white space: its ``raw_frequency_words`` are those of the sentence. May hold empty pieces."""
    return F.split(_one_blank(sentence, ASCII_BLANKS), " ")


def frequency_words(sentence: Column) -> Column:
    """Array of words for corpus counts: marks stripped, lower case, single characters and numbers out."""
    raw = F.filter(raw_frequency_words(sentence), lambda w: F.length(w) > 1)
    return F.filter(F.transform(raw, word_of), lambda w: ~w.rlike(r"^\d+$"))


def fold(c: Column) -> Column:
    """Lower case with macron vowels reduced to plain ones."""
    low = F.lower(c)
    return F.when(F.octet_length(c) == F.length(c), low).otherwise(F.translate(low, "āēīōū", "aeiou"))


def split_fused(text: Column, forms: list[str]) -> Column:
    """Put a space after a known form that was written together with the next word; longest form first."""
    longest = sorted(forms, key=lambda f: (-len(f), f))
    return F.regexp_replace(text, r"(?i)(?<![\p{L}])(" + "|".join(longest) + r")(?=\p{L})", "$1 ")


def has_hiatus(word: Column) -> Column:
    return word.rlike(f"[{VOWELS}]{{2}}")


def hiatus_rule(word: Column) -> Column:
    """The repair that the first pair of adjacent vowels calls for."""
    pair = F.regexp_extract(word, f"([{VOWELS}]{{2}})", 1)
    first = F.substring(pair, 1, 1)
    return (
        F.when(pair == "", None)
        .when(first == "u", "glide u to w")
        .when(first == "i", "glide i to y")
        .when(pair == "ai", "fuse a+i to e")
        .otherwise("elide a")
    )


def bad_cluster(word: Column) -> Column:
    """P10 as a test of one word: two consonants side by side that may not be (not m/n first, not y/w
    second, not sh, ts or pf)."""
    return word.rlike(r"(?!sh|ts|pf)[b-df-hj-lp-tv-z][b-df-hj-np-tvxz]")


def vowel_join(prefix: Column, stem: Column) -> Column:
    """Join two morphemes and settle the contact of two vowels at the seam."""
    last, before = F.right(prefix, F.lit(1)), F.substring(prefix, -2, 1)
    before = F.when(F.length(prefix) > 1, before).otherwise("")
    body = F.substr(prefix, F.lit(1), F.length(prefix) - 1)
    head = F.substr(prefix, F.lit(1), F.length(prefix) - 2)
    first, rest = F.substring(stem, 1, 1), F.substr(stem, F.lit(2))
    contact = last.rlike(f"^[{VOWELS}]$") & first.rlike(f"^[{VOWELS}]$")
    after_u = F.when(first.isin("o", "u") & before.isin("k", "g", "h"), F.concat(body, stem)).otherwise(
        F.concat(body, F.lit("w"), stem)
    )
    after_i = (
        F.when((before == "k") & first.isin("i", "e"), F.concat(head, F.lit("k"), stem))
        .when(before == "k", F.concat(head, F.lit("cy"), stem))
        .when((before == "j") & (first == "e"), F.concat(head, F.lit("g"), stem))
        .otherwise(F.concat(body, F.lit("y"), stem))
    )
    after_a = F.when(~before.isin("y", "w") & (first == "i"), F.concat(body, F.lit("e"), rest)).otherwise(
        F.concat(body, stem)
    )
    return (
        F.when(~contact, F.concat(prefix, stem))
        .when(last == "u", after_u)
        .when(last == "i", after_i)
        .otherwise(after_a)
    )
