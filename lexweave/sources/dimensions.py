"""S7. Dimension tables with their match order.

Closed tables come from ``fixed``. Open word lists are parameters: tab-separated files with a header in a
lexicon folder on any file system that Spark reads, in match order. A folder without one of the lists is an error,
unless the caller names the list as optional: then it is empty, and rules that need it simply do not fire.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.plans.scale import BROADCAST_ROWS, local_table
from lexweave.sources import fixed

# file name -> schema of the open lists
LEXICON_FILES = {
    "invariables": "word string, pos string",
    "pronouns": "word string, pron_type string, noun_class int",
    "known_words": "word string, noun_class int, stem string",
    "verb_stems": "stem string",
    "gloss_verbs": "key string, gloss string",
    "gloss_nouns": "key string, gloss string",
    "gloss_words": "key string, gloss string",
    "documented": "plain string, marked string, meaning string, category string, family string, pair string",
}


def with_order(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    numbered = [(i, *r) for i, r in enumerate(rows, 1)]
    return local_table(spark, numbered, "ord int, " + schema)


def first_hits(dim: DataFrame, key: str = "word") -> DataFrame:
    """One row per key, the first in match order: a join must not multiply rows, and the first hit wins."""
    others = [c for c in dim.columns if c != key]
    best = dim.groupBy(key).agg(F.min_by(F.struct(*others), "ord").alias("_b"))
    return best.select(key, *[F.col("_b")[c].alias(c) for c in others])


def possessives() -> list[tuple]:
    """Possessive pronouns by rule: the connector of each class without its vowel plus the person's part."""
    persons = ["anjye", "ange", "awe", "e", "acu", "anyu", "abo"]
    rows = []
    for number, _, _, _, connector, _ in fixed.NOUN_CLASSES:
        rows.append((connector, "POSSESSIVE", number))
        rows += [(connector[:-1] + p, "REFLEXIVE", number) for p in persons]
    return rows


def read_list(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """One open list, numbered by its place in the file. A list is a dimension: more rows than may be
    broadcast is an error, not something to cut."""
    df = spark.read.csv(
        f"{folder.rstrip('/')}/{name}.tsv", sep="\t", header=True, schema=schema, comment="#", enforceSchema=True
    )
    rows = df.take(BROADCAST_ROWS + 1)
    if len(rows) > BROADCAST_ROWS:
        raise ValueError(f"{name} has more than {BROADCAST_ROWS} rows: too large for a lexicon list")
    return with_order(spark, [tuple(r) for r in rows], schema)


def load_dimensions(
    spark: SparkSession, lexicon_dir: str | None = None, optional: Collection[str] = ()
) -> dict[str, DataFrame]:
    """All dimension tables by name; each small enough to broadcast, which is checked on load.

    Without a folder all open lists are empty; in a folder only those named in ``optional`` may be missing.
    """
    dims = {
        "noun_classes": with_order(
            spark, fixed.NOUN_CLASSES,
            "noun_class int, prefix string, marker string, adj string, connector string, subject string",
        ),
        "adj_stems": with_order(spark, [(s,) for s in fixed.ADJ_STEMS], "stem string"),
        "adj_prefixes": with_order(spark, fixed.ADJ_PREFIXES, "prefix string, noun_class int"),
        "noun_stems": with_order(spark, fixed.NOUN_STEMS, "stem string, noun_class int"),
        "noun_prefixes": with_order(
            spark, fixed.NOUN_PREFIXES,
            "prefix string, noun_class int, shortest int, after string, ending string, strip int",
        ),
        "plural_pairs": with_order(
            spark, fixed.PLURAL_PAIRS,
            "singular string, plural string, stem string, sg_class int, pl_class int",
        ),
        "object_markers": with_order(spark, fixed.OBJECT_MARKERS, "form string, vowel_form string, noun_class int"),
        "subject_prefixes": with_order(spark, fixed.SUBJECT_PREFIXES, "prefix string, noun_class int"),
        "rule_words": with_order(spark, fixed.RULE_WORDS, "word string, role string"),
        "elision": with_order(spark, fixed.ELISION, "full string, elided string"),
        "phonemes": with_order(spark, fixed.PHONEMES, "grapheme string, token string, ipa string"),
        "rule_pronouns": with_order(spark, possessives(), "word string, pron_type string, noun_class int"),
    }
    for name, schema in LEXICON_FILES.items():
        dims[name] = spark.createDataFrame([], "ord int, " + schema)
        if lexicon_dir:
            try:
                dims[name] = read_list(spark, lexicon_dir, name, schema)
            except AnalysisException as e:
                if name not in optional or e.getCondition() != "PATH_NOT_FOUND":
                    raise
    return dims
