"""Tables in and out: delimited files (S2), append logs (S4), whole-table replace (S5), nested documents."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(
    spark: SparkSession, path: str, columns: Sequence[str], sep: str = "\t", header: bool = True, comment: str = "#"
) -> DataFrame:
    """S2. A delimited table as text columns: comment lines dropped, missing columns and values empty."""
    if header:
        df = spark.read.csv(path, sep=sep, header=True, comment=comment, quote='"')
        have = set(df.columns)
        return df.select(
            *[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) if c in have else F.lit("").alias(c) for c in columns]
        )
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    df = spark.read.csv(path, sep=sep, header=False, comment=comment, schema=schema)
    return df.select(*[F.trim(F.coalesce(c, F.lit(""))).alias(c) for c in columns])


def append_log(df: DataFrame, path: str) -> None:
    """S4. Append rows to a log."""
    df.write.mode("append").parquet(path)


def replace_table(df: DataFrame, path: str) -> None:
    """S5. Replace a whole table that ``df`` may be read from: write beside it first, then swap the contents.

    Readers see the old rows until the second write commits.
    """
    spark = df.sparkSession
    staging = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(staging)
    spark.read.schema(df.schema).parquet(staging).write.mode("overwrite").parquet(path)
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(staging)
    fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(fs_path, True)


VOWEL = "struct<word:bigint,w:string,i:bigint,ch:string,start:double,dur:double,pitch:double,pitch_1:double,pitch_2:double,context:string,conf:double>"
PART = 4096  # vowels in one nested document


def nest_aligned(v: DataFrame, part: int = PART, clip: str = "clip_id", order: str = "i") -> DataFrame:
    """S6. ``clip_id, part, vowels``: ordered vowels of a clip, a long clip in parts so that no row grows
    without bound. ``order`` numbers the vowels of a clip."""
    columns = [order, *[c for c in v.columns if c not in (clip, order)]]
    rows = v.withColumn("part", F.floor(F.col(order) / part).cast("bigint"))
    return rows.groupBy(clip, "part").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("vowels"))


def unnest_aligned(docs: DataFrame, clip: str = "clip_id") -> DataFrame:
    """S6. One row per vowel again."""
    return docs.select(clip, F.explode("vowels").alias("_v")).select(clip, "_v.*")


def write_aligned(v: DataFrame, path: str, part: int = PART) -> None:
    nest_aligned(v, part).write.mode("overwrite").json(path)


def read_aligned(spark: SparkSession, path: str, vowel: str = VOWEL) -> DataFrame:
    docs = spark.read.schema(f"clip_id bigint, part bigint, vowels array<{vowel}>").json(path)
    return unnest_aligned(docs)
