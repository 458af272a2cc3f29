"""The library's front door: documents in, analysed tables out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.functions import text as tx
from lexweave.operators import paradigms as pg
from lexweave.operators import report as rp
from lexweave.operators import rules as ru
from lexweave.operators import tokens as tk
from lexweave.operators import vocab as vb
from lexweave.plans.scale import cluster, stored
from lexweave.sources import fixed
from lexweave.sources.corpus import corpus_lines
from lexweave.sources.dimensions import load_dimensions

TAGS = ["pos", "pron_type", "noun_class", "stem", "verb_tense", "obj_class", "verb_ext", "is_negative"]
STRETCH = 32  # sentences that share one lookup of tags


def tagged_vocabulary(s: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
    """The tags of every form of the sentences, worked out once per form and written to the shared folder."""
    return stored(pg.tag_words(tk.stored_vocabulary(s).select("word"), dims), "tagged-words")  # many joins read the words


def tag_lookups(s: DataFrame, tags: DataFrame, ids: Sequence[str]) -> DataFrame:
    """``ids, lookups``: per document an array with, for each stretch of sentences, a map from its forms to their tags.

    Only the distinct forms of a stretch travel, one small row each; a form that very many stretches have is a skewed join
    key of two plain shuffles, which Spark splits. A map is bounded by its stretch, so looking up stays cheap in long texts.
    """
    words = tk.tokenize(s, [*ids, "_stretch"]).where(F.col("punct_type").isNull()).select(*ids, "_stretch", "lower").distinct()
    found = words.join(tags.withColumnRenamed("word", "lower"), "lower")
    entry = F.struct("lower", F.struct(*TAGS))
    maps = cluster(found.select(*ids, "_stretch", entry.alias("_e")), *ids).groupBy(*ids, "_stretch")
    maps = maps.agg(F.map_from_entries(F.collect_list("_e")).alias("_m"))
    return maps.groupBy(*ids).agg(F.map_from_entries(F.collect_list(F.struct("_stretch", "_m"))).alias("_lookups"))


def analyze(
    df: DataFrame,
    text: str = "text",
    ids: Sequence[str] = ("doc_id",),
    dims: dict[str, DataFrame] | None = None,
    rules: ru.RuleTables = ru.RULES,
) -> dict[str, DataFrame]:
    """Tokens with all tags, errors, and sentence facts of a document table; ``ids`` name a document, rows without one are left out.

    One shuffle of the raw documents; the tags come to them as maps of their own forms, and every token, window and rule
    works inside a document's partition.
    """
    ids = list(ids)
    dims = dims or load_dimensions(df.sparkSession)
    named_rows = " AND ".join(f"`{c}` IS NOT NULL" for c in ids)
    docs = cluster(df.select(*ids, F.col(text).alias("text")).where(named_rows), *ids)
    stretch = F.floor((F.col("sent_no") - 1) / STRETCH).cast("int").alias("_stretch")
    plain = tk.split_fused(tk.sentences(docs, "text", ids), fixed.FUSED_FORMS)
    lookups = tag_lookups(plain.select("*", stretch), tagged_vocabulary(plain, dims), ids)
    looked = tk.gathered(docs, "text", ids).join(lookups, ids, "left")
    s = tk.sentence_groups(looked, [*ids, "_lookups"], fixed.FUSED_FORMS)
    s = s.select(*ids, "sent_no", "_parts", F.element_at("_lookups", stretch).alias("_tags"))
    t = tk.flagged_tokens(s, ids, "_tags", "_tag")
    tagged = t.select("*", *[F.col(f"_tag.{c}").alias(c) for c in TAGS]).drop("_tag")
    tagged = tagged.withColumn("pos", F.when(F.col("punct_type").isNotNull(), "PUNCTUATION").otherwise(F.col("pos")))
    named = F.col("is_proper_noun") & F.col("pos").isin("FOREIGN", "NOUN", "ADJECTIVE")
    phonotactic = (
        (F.col("pos") == "FOREIGN") & F.col("surface").rlike("^[A-Z]") & ~tx.has_hiatus(F.col("lower"))
        & ~tx.bad_cluster(F.col("lower"))
    )
    name = F.coalesce(named | phonotactic, F.lit(False))
    tagged = tagged.select(
        *[c for c in tagged.columns if c not in ("is_proper_noun", "noun_class", "pos")],
        (F.col("is_proper_noun") | phonotactic).alias("is_proper_noun"),
        F.when(~name, F.col("noun_class")).alias("noun_class"), F.when(name, "NOUN").otherwise(F.col("pos")).alias("pos"),
    )
    tagged = ru.retag(tagged, rules=rules, ids=ids)
    tagged = tk.propagate_proper(tagged, [*ids, "sent_no"])
    tagged = ru.gram_roles(ru.resolve_subject(tagged, rules, ids), rules, ids)
    return {
        "tokens": tagged,
        "errors": ru.violations(tagged, rules, ids, rp.harmony_rules()),
        "sentence_facts": ru.sentence_flags(tagged, rules, ids),
    }


def correct(df: DataFrame, text: str = "text", ids: Sequence[str] = ("doc_id",), **options) -> DataFrame:
    """``ids, sent_no, corrected``."""
    tagged = analyze(df, text, ids, **options)["tokens"]
    return rp.correct(tagged, options.get("rules", ru.RULES), ids).drop("changed")


def validate(df: DataFrame, text: str = "text", ids: Sequence[str] = ("doc_id",), lines: bool = True, **options) -> DataFrame:
    """The violation report: per sentence, per document, overall.

    A document is read line by line, as a file is: blank lines and ``#`` comments are left out, every other line is a text
    of its own with its ``line_no``. With ``lines=False`` the whole text is one.
    """
    if lines:
        df, text, ids = corpus_lines(df, text, tuple(ids)), "text", [*ids, "line_no"]
    return rp.violation_report(analyze(df, text, ids, **options)["errors"], ids)


def phonemize(df: DataFrame, text: str = "text", ids: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``ids, phonemes``: the text normalised and read as phonemes, ``|`` between words."""
    return vb.normalize_corpus(df, text).select(*ids, vb.phoneme_string(F.col(text)).alias("phonemes"))


def tag_words(df: DataFrame, word: str = "word", dims: dict[str, DataFrame] | None = None) -> DataFrame:
    """Tags of a word list."""
    dims = dims or load_dimensions(df.sparkSession)
    words = stored(df.select(tx.fold(F.col(word)).alias("word")).distinct(), "words")  # many joins read it
    return pg.tag_words(words, dims)


def gloss(df: DataFrame, text: str = "text", ids: Sequence[str] = ("doc_id",), dims: dict | None = None, **options) -> DataFrame:
    """A rough English line per sentence."""
    dims = dims or load_dimensions(df.sparkSession)
    tagged = analyze(df, text, ids, dims=dims, **options)["tokens"]
    return rp.gloss_sentence(tagged, dims["gloss_verbs"], dims["gloss_nouns"], dims["gloss_words"], ids)


__all__ = ["analyze", "correct", "gloss", "phonemize", "tag_words", "validate"]
