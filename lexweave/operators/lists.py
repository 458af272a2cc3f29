"""Word lists, takes and scores (U1, U3, U4, J11, J17, J18, J21, A16-A18, A22, A23, P14, R2, R6 in batch)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.operators import marks as mk
from lexweave.operators.series import cap_per_group
from lexweave.plans.scale import BROADCAST_ROWS, numbered, salted_join

def build_wordlist(sources: Sequence[DataFrame]) -> DataFrame:
    """U1. One list from sources in priority order: the first (plain, meaning) wins, ids run in list order.

    Each source has ``ord, plain, meaning, source``.
    """
    parts = [s.select(F.lit(i).alias("prio"), "ord", "plain", "meaning", "source") for i, s in enumerate(sources, 1)]
    rows = reduce(DataFrame.unionByName, parts).where(F.col("plain") != "")
    first = rows.groupBy("plain", "meaning").agg(
        F.min(F.struct("prio", "ord")).alias("_at"), F.min_by("source", F.struct("prio", "ord")).alias("source")
    )
    flat = first.select("plain", "meaning", "source", F.col("_at.prio").alias("prio"), F.col("_at.ord").alias("ord"))
    return numbered(flat, "prio", "ord").select("id", "plain", "meaning", "source")


ANNOTATIONS = ["your_marking", "heard", "recording", "notes"]


def merge_annotations(new: DataFrame, old: DataFrame, keep: Sequence[str] = ANNOTATIONS) -> DataFrame:
    """J11. The new list with earlier annotations of the same (plain, meaning); extra ways of saying a word
    (old ids like ``31-2``) are attached under the word's new id.

    Old ids run in list order: of equal words the last row counts, and ways keep their order, both by number.
    """
    key = ["plain", "meaning"]

    def part(n: int) -> Column:
        return F.split_part("id", F.lit("-"), F.lit(n)).cast("bigint")

    base = old.where(~F.col("id").contains("-")).groupBy(*key).agg(F.max_by(F.struct(*keep), part(1)).alias("_o"))
    j = new.join(base, key, "left")
    main = j.select(
        F.col("id").cast("string").alias("id"), *key, "source",
        *[F.coalesce(F.col("_o")[c], F.lit("")).alias(c) for c in keep],
    )
    ways = old.where(F.col("id").contains("-"))
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(part(1), part(2))) + 1
    ways = ways.select(*key, *keep, nth.alias("_n"))
    extra = new.join(ways, key).select(
        F.concat(F.col("id").cast("string"), F.lit("-"), F.col("_n").cast("string")).alias("id"), *key, "source", *keep
    )
    return main.unionByName(extra)


KINDS = {"normal": "recording", "melody": "melody_recording"}


def recordings(anchors: DataFrame, refs: DataFrame, kinds: Sequence[str] = ("normal", "melody", "radio")) -> DataFrame:
    """U3. ``id, kind, recording``: the two columns of the word table and the extra rows, by kind."""
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("recording")) for k, c in KINDS.items()])
    own = anchors.select("id", F.explode(pairs).alias("_r")).select("id", "_r.kind", "_r.recording")
    rows = own.unionByName(refs.select("id", "kind", "recording"))
    return rows.where(F.col("kind").isin(*kinds) & (F.coalesce("recording", F.lit("")) != ""))


def documented_union(families: DataFrame, words: DataFrame, pairs: DataFrame) -> DataFrame:
    """U4. Families first, then words whose marking is new, then all pairs, numbered in that order.

    Inputs have ``ord, marked, category``; of equal new words the first counts.
    """
    seen = families.select("marked").distinct()
    fresh = words.join(seen, "marked", "left_anti").groupBy("marked").agg(
        F.min("ord").alias("ord"), F.min_by("category", "ord").alias("category")
    )
    parts = [d.select(F.lit(i).alias("prio"), "ord", "marked", "category") for i, d in enumerate((families, fresh, pairs), 1)]
    return numbered(reduce(DataFrame.unionByName, parts), "prio", "ord").select("id", "marked", "category")


def minimal_pairs(words: DataFrame) -> DataFrame:
    """J17. Spellings with more than one marking or meaning: ``plain, variants, ways``, all ways of one spelling in one row.

    Variants are made distinct before they are gathered, so a row holds the few ways one spelling is marked and meant, in
    order; any two of them are a pair.
    """
    variants = words.select("plain", "marked", "meaning").distinct()
    ways = F.array_sort(F.collect_list(F.struct("marked", "meaning")))
    out = variants.groupBy("plain").agg(F.count(F.lit(1)).alias("variants"), ways.alias("ways"))
    return out.where("variants > 1")


def word_status(documented: DataFrame, anchors: DataFrame, takes: DataFrame) -> DataFrame:
    """J18. standard / verified (book, speaker and engine) / confirmed (book and speaker) / none.

    ``documented``: id, plain, marked; ``anchors``: plain, example; ``takes``: id, seq, speaker_agrees,
    vowel_ok, whole_ok (the latest one counts).
    """
    def key(c: str) -> Column:
        bare = F.replace(F.col(c), F.lit("-"), F.lit(""))
        return F.concat_ws("/", mk.plain(bare), F.array_join(mk.moras(bare), "."))

    standard = anchors.select(key("example").alias("_key")).distinct().withColumn("_std", F.lit(True))
    last = latest_take(takes, ["id"], "seq", ["speaker_agrees", "vowel_ok", "whole_ok"])
    j = documented.withColumn("_key", key("marked")).join(standard, "_key", "left").join(last, "id", "left")
    agrees = F.coalesce(F.col("speaker_agrees") == "yes", F.lit(False))
    engine = F.coalesce((F.col("vowel_ok") == "yes") | (F.col("whole_ok") == "yes"), F.lit(False))
    status = (
        F.when(F.col("_std"), "standard").when(agrees & engine, "verified").when(agrees, "confirmed").otherwise("none")
    )
    return j.select(*documented.columns, status.alias("status"))


def mine_exemplars(
    clips: DataFrame, words: DataFrame, n: int, connectives: Sequence[str], speaker: str = "speaker"
) -> DataFrame:
    """J21. Standard words inside clips: not last, not right after a connective, at most ``n`` per word and
    speaker. ``clips``: clip_id, speaker, text. Words and their neighbours are paired in the clip's row, before words become rows."""
    cut = clips.select("clip_id", speaker, F.split("text", r"\s+").alias("_w"))
    inside = F.greatest(F.size("_w") - 1, F.lit(0))  # all but the last
    before = F.concat(F.array(F.lit(None).cast("string")), "_w")
    pairs = F.arrays_zip(F.slice("_w", 1, inside).alias("word"), F.slice(before, 1, inside).alias("before"))
    rows = cut.select("clip_id", speaker, F.posexplode(pairs).alias("pos", "_p"))  # what stands beside it would be worked out per word
    rows = rows.select("clip_id", speaker, "pos", "_p.word", "_p.before")
    inner = rows.where(F.coalesce(~F.col("before").isin(*connectives), F.lit(True))).drop("before")
    standard = words.select("word").distinct()
    small = standard.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    hits = (
        inner.join(F.broadcast(standard), "word", "left_semi") if small
        else salted_join(inner, standard, ["word"], "left_semi")
    )
    return cap_per_group(hits, ["word", speaker], n, ["clip_id", "pos"])


def agreement(words: DataFrame, gold: str = "gold", heard: str = "heard") -> DataFrame:
    """A16. Per word whether length, tone and everything agree, compared vowel by vowel in the row; words without a gold marking are left out."""
    g, h = mk.moras(F.col(gold)), mk.moras(F.col(heard))
    s = words.where(F.col(gold) != "").withColumn("_v", F.arrays_zip(g.alias("g"), h.alias("h"))).withColumn("_same", F.size(g) == F.size(h))

    def every(test) -> Column:
        return F.col("_same") & F.forall("_v", test)

    length = every(lambda v: F.length(v["g"]) == F.length(v["h"]))
    tone = every(
        lambda v: (v["g"].contains("H") == v["h"].contains("H")) & ((F.length(v["g"]) == 1) | (v["g"] == v["h"]))
    )
    return s.select(
        *words.columns, length.alias("length_agrees"), tone.alias("tone_agrees"),
        (F.col(gold) == F.col(heard)).alias("exact"),
    )


def agreement_totals(a: DataFrame) -> DataFrame:
    """A16. The counts over all words."""
    return a.agg(
        F.count(F.lit(1)).alias("n"), F.count_if("exact").alias("exact"), F.count_if("length_agrees").alias("length"),
        F.count_if("tone_agrees").alias("tone"),
    )


def score_by_kind(takes: DataFrame, kind: str = "kind", correct: str = "correct") -> DataFrame:
    """A17. Right answers, takes and floor percent per kind."""
    label = F.coalesce(F.when(F.col(kind) != "", F.col(kind)), F.lit("normal"))
    s = takes.groupBy(label.alias("kind")).agg(F.count_if(F.col(correct)).alias("right_n"), F.count(F.lit(1)).alias("n"))
    return s.withColumn("percent", F.floor(100 * F.col("right_n") / F.col("n")).cast("bigint"))


def word_summary(anchors: DataFrame, refs: DataFrame, takes: DataFrame) -> DataFrame:
    """A18. Per word: extra takes, radio examples, tests, correct ones, last prediction."""
    r = refs.groupBy("id").agg(
        F.count_if(F.col("kind") != "radio").alias("extra"), F.count_if(F.col("kind") == "radio").alias("radio")
    )
    t = takes.groupBy("id").agg(
        F.count(F.lit(1)).alias("tests"), F.count_if("correct").alias("right_n"),
        F.max_by("predicted", "seq").alias("last_prediction"), F.max_by("correct", "seq").alias("last_ok"),
    )
    j = anchors.join(r, "id", "left").join(t, "id", "left")
    return j.select(
        *anchors.columns, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("extra", "radio", "tests", "right_n")],
        "last_prediction", "last_ok",
    )


def source_counts(words: DataFrame, source: str = "source") -> DataFrame:
    """A22. Words per source: the text before the first " (" and then before the first ","."""
    name = F.split_part(F.split_part(F.col(source), F.lit(" ("), F.lit(1)), F.lit(","), F.lit(1))
    return words.groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name")


def progress(words: DataFrame) -> DataFrame:
    """A23. All, recorded, and recorded with a marking."""
    done = F.coalesce("recording", F.lit("")) != ""
    return words.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(done).alias("recorded"),
        F.count_if(done & (F.coalesce("your_marking", F.lit("")) != "")).alias("marked"),
    )


def show_filter(show: str) -> Column:
    """P14. The review filters."""
    done = F.coalesce("recording", F.lit("")) != ""
    filters = {
        "all": F.lit(True),
        "recorded": done,
        "not recorded": ~done,
        "review": done & (F.coalesce("your_marking", F.lit("")) == ""),
        "pairs": F.coalesce("pair", F.lit("")) != "",
        "families": F.coalesce("family", F.lit("")) != "",
    }
    return filters[show]


SHOWS = ["all", "recorded", "not recorded", "review", "pairs", "families"]


def worklist(words: DataFrame, show: str) -> DataFrame:
    """P14. The words a filter shows."""
    return words.where(show_filter(show))


def clip_name(word_id: Column, plain: Column) -> Column:
    """File name of a recording: ``0031_word.wav``, ``0031-2_word.wav`` for a second way of saying it."""
    number = F.split_part(word_id, F.lit("-"), F.lit(1))
    base = F.when(F.length(number) < 4, F.lpad(number, 4, "0")).otherwise(number)
    way = F.split_part(word_id, F.lit("-"), F.lit(2))
    return F.concat(base, F.when(way != "", F.concat(F.lit("-"), way)).otherwise(""), F.lit("_"), plain, F.lit(".wav"))


def latest_take(log: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """R2. The last row of an append log per key (an aggregate, so a hot key is merged map-side)."""
    best = log.groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("_b"))
    return best.select(*keys, *[F.col("_b")[c].alias(c) for c in columns])


def per_window(log: DataFrame, time: str, width: str, by: Sequence[str]) -> DataFrame:
    """R6 in batch. Counts per time bucket."""
    return log.groupBy(F.window(time, width).alias("_w"), *by).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("_w.start").alias("window_start"), *by, "n"
    )
