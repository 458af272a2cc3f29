"""Exact dedup by content sort: normalised bytes are range-partitioned and sorted, and equal neighbours are one group.

Texts are equal when they are identical without white space. Spark samples the splitters of the ranges; their key is bounded:
the first characters of the normalised text, then its hash, which tells apart texts that begin alike. Every range is sorted by
the whole normalised text (Spark's sort spills to disk), equal texts lie side by side, and each row is compared in full with
the one before it. A hash that very many rows have gets a third part of the key, a piece number by the row's id, so that a
splitter can fall inside a group of copies; such a group's pieces are then joined by their first rows' whole texts.

Column expressions, windows, joins and aggregations only; a row's text is shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lexweave.llm.common import written

WHITE = " \t\n\x0b\x0c\r"
#: Characters of the normalised text that a splitter may hold.
PREFIX = 16
#: Rows of one hash from which they are dealt in pieces, and the largest number of hashes so dealt.
PIECE, HOT = 64, 1 << 16


def normal(text: Column) -> Column:
    """The text without any of the six white-space characters; null is empty."""
    out = F.coalesce(text, F.lit(""))
    for c in WHITE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def _order() -> list[Column]:
    """Of equal texts the longest original first, then the smallest id; a null id comes last."""
    return [F.desc("size"), F.asc_nulls_last("id")]


def _runs(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """A row per row of ``df``: row (all its columns), id, size, sha, its run (prefix, key, piece, run), place and n within it, best, and on a divided run's first row ``whole``."""
    source = df.select(F.struct("*").alias("row"), F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    key = F.xxhash64(normal(F.col("text")))
    most = max(PIECE, -(-df.count() // HOT))
    # at most HOT hashes have more rows than that
    hot = written(source.groupBy(key.alias("hot")).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > most), "hot-hashes")
    rows = source.withColumns({"norm": normal(F.col("text")), "size": F.char_length(F.coalesce("text", F.lit("")))}).drop("text").withColumn("key", F.xxhash64("norm"))
    rows = rows.join(F.broadcast(hot), F.col("key") == F.col("hot"), "left")
    pieces = F.ceil(F.col("rows") / most)
    rows = rows.select(
        "row", "id", "size", "norm", "key", F.substring("norm", 1, PREFIX).alias("prefix"), F.col("rows").isNotNull().alias("divided"),
        F.when(F.col("rows").isNull(), 0).otherwise(F.pmod(F.xxhash64("id"), pieces)).cast("long").alias("piece"),
    )
    ranged = rows.repartitionByRange("prefix", "key", "piece")
    inside = ["prefix", "key", "piece"]
    sorted_ = Window.partitionBy(*inside).orderBy("norm", *_order())
    before = F.lag("norm").over(sorted_)
    marked = ranged.withColumn("starts", before.isNull() | (F.col("norm") != before))
    marked = marked.withColumn("run", F.sum(F.col("starts").cast("long")).over(sorted_.rowsBetween(Window.unboundedPreceding, 0)))
    marked = marked.select(*inside, "run", "row", "id", "size", "divided", F.sha2("norm", 256).alias("sha"), F.when(F.col("divided") & F.col("starts"), F.col("norm")).alias("whole"))
    run = Window.partitionBy(*inside, "run").orderBy(*_order())
    everything = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    best = F.struct((-F.col("size")).alias("less"), F.col("id").isNull().alias("none"), F.col("id").alias("id"))
    return marked.withColumns({"place": F.row_number().over(run), "n": F.count(F.lit(1)).over(everything), "own": best}).withColumn("best", F.first("own").over(everything))


def _classes(runs: DataFrame) -> DataFrame:
    """``runs`` with group_size, keep_id and kept, the pieces of divided groups put together."""
    names = ["prefix", "key", "piece", "run"]
    firsts = runs.where("divided AND place = 1").select(*names, "whole", "n", "best")
    sums = firsts.groupBy("key", "whole").agg(F.sum("n").alias("all_n"), F.min("best").alias("all_best"))
    joined = firsts.join(sums, ["key", "whole"]).select(*names, "all_n", "all_best")
    out = runs.join(joined, names, "left").withColumns({"group_size": F.coalesce("all_n", "n"), "best": F.coalesce("all_best", "best")})
    return out.withColumns({"keep_id": F.col("best.id"), "kept": (F.col("place") == 1) & F.col("own").eqNullSafe(F.col("best"))})


def classes(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: doc_id, keep_id (the id of the row that stays), group_size, kept, text_sha256 of the normalised text.

    Null, empty and blank texts are one group, the empty text. Of a group the row with the most code points stays, of these the
    smallest id; a null id comes after all others and names the group only if it has no other. Of repeated rows of that id and
    length one is kept. An empty table gives no row; further columns are ignored, whatever their names.
    """
    slim = df.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    runs = _runs(slim, "doc_id", "text").drop("row")
    return _classes(written(runs, "runs")).select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


def keep_one(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows that stay, with all their own columns."""
    runs = _runs(df, id_column, text_column)
    runs = written(runs.withColumn("row", F.when(F.col("place") == 1, F.col("row"))), "runs")
    return _classes(runs).where("kept").select("row.*")
