"""Building blocks that keep hot keys from landing in one task.

Every operator that groups by a key which may hold a large share of the table (a clip, a context, a
word) goes through one of these instead of a plain window or ``percentile``:

* ``salted_join``    – join a large table to per-key facts, the hot key spread over many tasks
* ``exact_quantile`` – exact interpolated quantile per key; a task sees only the values near the rank
* ``scan``           – lag/lead/running sums along a long series cut into bounded bins
* ``bounded``        – a broadcast hint only after the row count was checked
* ``numbered``       – a running number over a whole table without one window over it
* ``stored``         – a table that is used several times, written once to the shared folder
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SALTS = 16
BROADCAST_ROWS = 200_000
SKETCH = 10_000          # accuracy of the sketch that brackets a quantile: rank error <= n / SKETCH
MARGIN = 10.0 / SKETCH   # the bracket is ten times wider than that error
SMALL_GROUP = 10_000     # groups up to this size are ranked whole; the bracket is many ranks wide beyond it


def spread(df: DataFrame, by: str | None = None) -> DataFrame:
    """Even out a scan before an expensive per-row explode.

    A table of many files is left alone: it already has more splits than cores. Only a scan with fewer
    splits than cores is redistributed, on its raw rows, before they fan out into tokens.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, by) if by else df.repartition(cores)


def cluster(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition raw rows once, so every later window on keys plus more columns needs no exchange.

    The partition count is the session's own ``spark.sql.shuffle.partitions``: given as a number, AQE does not
    merge partitions by the size of the raw rows, which is about a tenth of what they fan out to.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def bounded(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` if it has at most ``max_rows`` rows; otherwise leave the join to Catalyst and AQE."""
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df


def local_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A small fixed table held in the plan itself; safe to broadcast because its size is known."""
    if len(rows) > BROADCAST_ROWS:
        raise ValueError("a local table must stay small: read it from storage instead")
    return F.broadcast(spark.createDataFrame(list(rows), schema))


_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only a local session may do without one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _LOCAL:
        _LOCAL[context.applicationId] = tempfile.mkdtemp(prefix="lexweave-")
    return _LOCAL[context.applicationId]


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: what is used several times is computed once, and a lost
    executor takes nothing along."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, *order: str, out: str = "id") -> DataFrame:
    """All rows numbered from 1 in the order of ``order``, which holds no ties.

    Ranges of the order are sorted apart and written with their place; a row is shifted by the rows of the ranges before its
    own. Only one count per range meets anywhere, however sparse or dense the order is.
    """
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranges = stored(ranges.withColumns({"_part": F.spark_partition_id(), "_n": F.monotonically_increasing_id()}), "numbered")
    bases, before = [], 0
    for r in ranges.groupBy("_part").agg(F.count(F.lit(1)).alias("rows"), F.min("_n").alias("first")).orderBy("_part").collect():
        bases.append((r["_part"], before - r["first"] + 1))
        before += r["rows"]
    shifts = local_table(df.sparkSession, bases or [(0, 0)], "_part int, _base bigint")
    return ranges.join(shifts, "_part").withColumn(out, F.col("_n") + F.col("_base")).drop("_part", "_n", "_base")


def salted_join(
    big: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "inner", salts: int = SALTS
) -> DataFrame:
    """Join on ``keys`` with the rows of one key spread over ``salts`` tasks.

    ``small`` has at most one row per key and is repeated ``salts`` times; ``big`` takes the salt from a
    hash of its whole row, so the same row always gets the same salt, also when a task is run again. Rows of
    a key must therefore differ in some column: keep an id or position in ``big``, or merge equal rows first.
    """
    seed = [F.col(c) for c, t in big.dtypes if not t.startswith("map")]
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*seed), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def exact_quantile(
    df: DataFrame, keys: Sequence[str], value: str, out: str = "median", p: float = 0.5
) -> DataFrame:
    """``keys, out, n``: the interpolated quantile of ``value`` per key, exact, whatever the group size.

    A sketch (merged map-side) first gives two values that surely enclose the wanted rank. Values outside
    only need counting; values inside are counted per distinct value and ranked. So the one ordered pass
    per key covers about ``2 * MARGIN`` of the group instead of all of it. Equal values are merged before the
    salted join: one value may make up a third of all rows.
    """
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    low, high = max(p - MARGIN, 0.0), min(p + MARGIN, 1.0)
    bracket = rows.groupBy(*keys).agg(
        F.percentile_approx("_v", [low, high], SKETCH).alias("_b"), F.count(F.lit(1)).alias("n")
    )
    side = (
        F.when(F.col("n") <= SMALL_GROUP, 0)
        .when(F.col("_v") < F.col("_b")[0], -1)
        .when(F.col("_v") > F.col("_b")[1], 1)
        .otherwise(0)
    )
    values = rows.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_m"))
    counted = (
        salted_join(values, bracket, keys)
        .withColumn("_side", side)
        .withColumn("_v", F.when(F.col("_side") == 0, F.col("_v")))
        .groupBy(*keys, "_side", "_v")
        .agg(F.sum("_m").alias("_c"), F.first("n").alias("n"))
    )
    order = Window.partitionBy(*keys).orderBy("_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
    rank = F.lit(p) * (F.col("n") - 1)
    inside = F.col("_side") == 0
    reached = counted.withColumn("_cum", F.sum("_c").over(order)).groupBy(*keys).agg(
        F.first("n").alias("n"),
        F.min(F.when(inside & (F.col("_cum") > F.floor(rank)), F.col("_v"))).alias("_lo"),
        F.min(F.when(inside & (F.col("_cum") > F.ceil(rank)), F.col("_v"))).alias("_hi"),
        F.max(F.when(F.col("_side") < 0, F.col("_cum"))).alias("_below"),
    )
    missed = (F.coalesce("_below", F.lit(0)) > F.floor(rank)) | F.col("_lo").isNull() | F.col("_hi").isNull()
    quantile = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (rank - F.floor(rank))
    return reached.select(
        *keys,
        F.when(missed, F.raise_error(F.lit("quantile bracket missed the rank")).cast("double"))
        .otherwise(quantile)
        .alias(out),
        "n",
    )


def with_median(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """``df`` plus the exact median of ``value`` in its group."""
    medians = exact_quantile(df, keys, value, out).drop("n")
    return salted_join(df, medians, keys, "left")


def scan(
    df: DataFrame,
    keys: Sequence[str],
    bin_col: str,
    order: Sequence[str],
    *,
    lag: dict[str, str] | None = None,
    lead: dict[str, str] | None = None,
    running: dict[str, Column] | None = None,
    offsets: int = 1,
) -> DataFrame:
    """Neighbours and running sums along a series whose key may be hot.

    The series is cut at ``bin_col`` (a function of the order column). Windows run inside one bin; what a
    bin needs from its neighbours is a summary row per bin (its last and first ``offsets`` rows, its sum),
    chained by a window over bins, which is as many rows per key as there are bins.
    ``lag``/``lead``: new column -> source column (offset 1). ``running``: new column -> summed expression,
    the sum including the current row.
    """
    lag, lead, running = lag or {}, lead or {}, running or {}
    keys = list(keys)
    group = [*keys, bin_col]
    inner = Window.partitionBy(*group).orderBy(*order)
    at = F.struct(*order)
    summary = df.groupBy(*group).agg(
        *[F.max_by(F.struct(F.col(src).alias("v")), at).alias(f"_t_{new}") for new, src in lag.items()],
        *[F.min_by(F.struct(F.col(src).alias("v")), at).alias(f"_h_{new}") for new, src in lead.items()],
        *[F.sum(expr).alias(f"_s_{new}") for new, expr in running.items()],
    )
    outer = Window.partitionBy(*keys).orderBy(bin_col)
    before = outer.rowsBetween(Window.unboundedPreceding, -1)
    summary = summary.select(
        *group,
        *[F.lag(f"_t_{new}").over(outer).alias(f"_t_{new}") for new in lag],
        *[F.lead(f"_h_{new}").over(outer).alias(f"_h_{new}") for new in lead],
        *[F.coalesce(F.sum(f"_s_{new}").over(before), F.lit(0)).alias(f"_s_{new}") for new in running],
    )
    local = df.select(
        "*",
        *[F.lag(F.struct(F.col(src).alias("v"))).over(inner).alias(f"_l_{new}") for new, src in lag.items()],
        *[F.lead(F.struct(F.col(src).alias("v"))).over(inner).alias(f"_n_{new}") for new, src in lead.items()],
        *[
            F.sum(expr).over(inner.rowsBetween(Window.unboundedPreceding, 0)).alias(f"_r_{new}")
            for new, expr in running.items()
        ],
    )
    joined = local.join(summary, group, "left")
    return joined.select(
        *df.columns,
        *[F.coalesce(f"_l_{new}", f"_t_{new}")["v"].alias(new) for new in lag],
        *[F.coalesce(f"_n_{new}", f"_h_{new}")["v"].alias(new) for new in lead],
        *[(F.col(f"_r_{new}") + F.col(f"_s_{new}")).alias(new) for new in running],
    )
