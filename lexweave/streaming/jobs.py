"""Streams (R1-R6): arriving text and append logs.

Row-frame windows are not allowed on streams, so the text job stays stateless: it splits, tokenises, tags by
stream-static joins and scans spelling, one row at a time. State is kept only as counts or one struct per key.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexweave.functions import text as tx
from lexweave.operators import lists as li
from lexweave.operators import tokens as tk
from lexweave.operators.lexicon import lexicon_tag
from lexweave.operators.vocab import ortho_scan


def read_lines(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Arriving text files, one row per line; the file is the document."""
    lines = spark.readStream.option("maxFilesPerTrigger", max_files).text(path)
    return lines.select(F.input_file_name().alias("doc_id"), F.col("value").alias("text"))


def clean_lines(lines: DataFrame) -> DataFrame:
    """Arriving lines trimmed; blank and ``#`` lines dropped."""
    clean = lines.withColumn("text", tx.ascii_trim(F.col("text")))
    return clean.where((F.col("text") != "") & ~F.col("text").startswith("#"))


def stream_tokens(lines: DataFrame, ids: Sequence[str] = ("doc_id",)) -> DataFrame:
    """R1, first half: lines to sentences to typed tokens, stateless."""
    return tk.tokenize(tk.sentences(clean_lines(lines), ids=ids), ids=ids)


def stream_analyze(
    lines: DataFrame, invariables: DataFrame, pronouns: DataFrame, known: DataFrame, ids: Sequence[str] = ("doc_id",)
) -> DataFrame:
    """R1. Tagged word tokens of arriving lines; the lexicon tables are static and small."""
    t = stream_tokens(lines, ids).where(F.col("punct_type").isNull()).withColumn("word", F.col("lower"))
    return lexicon_tag(t, invariables, pronouns, known)


def stream_ortho(lines: DataFrame, ids: Sequence[str] = ("doc_id",)) -> DataFrame:
    """R1. Spelling violations of arriving lines, one row per word and rule."""
    t = stream_tokens(lines, ids).where(F.col("punct_type").isNull())
    return ortho_scan(t.select(F.col("lower").alias("word")))


def sentence_checks(lines: DataFrame, interrogative: Sequence[str], ids: Sequence[str] = ("doc_id",)) -> DataFrame:
    """R1. Sentence checks that need the whole sentence, done on its token array inside the row: unequal
    parentheses, a question word before a full stop, no final mark."""
    s = tk.sentences(clean_lines(lines), ids=ids).withColumn("_t", tx.token_strings(F.col("text")))
    t = F.col("_t")

    def count(mark: str):
        return F.size(F.filter(t, lambda x: x == mark))

    asks = F.exists(t, lambda x: F.lower(x).isin(*interrogative))
    marks = F.filter(t, lambda x: x.isin(".", "?", "!"))
    last = F.get(marks, F.size(marks) - 1)
    found = F.array_compact(
        F.array(
            F.when(count("(") != count(")"), F.lit("UNBALANCED_PAREN")),
            F.when(asks & (last == "."), F.lit("MISSING_QMARK")),
            F.when(F.size(marks) == 0, F.lit("MISSING_PERIOD")),
        )
    )
    return s.select(*ids, "sent_no", F.explode(found).alias("type"))


def latest_take(log: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """R2. The last row per key; write it in update mode."""
    return li.latest_take(log, keys, order, columns)


def stream_score(log: DataFrame, kind: str = "kind", correct: str = "correct") -> DataFrame:
    """R3. The running score per kind; write it in complete mode."""
    return li.score_by_kind(log, kind, correct)


def stream_cap(stream: DataFrame, keys: Sequence[str], n: int, order: Sequence[str]) -> DataFrame:
    """R4. Pass at most ``n`` rows per key over the life of the stream.

    A batch is first cut to ``n`` per key inside every task, so a hot key sends at most ``n`` rows per task
    to its state; the state of a key is one count.
    """
    keys, order, columns = list(keys), list(order), list(stream.columns)

    def trim(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = pd.DataFrame(columns=columns)
        for pdf in batches:
            kept = pdf if kept.empty else pd.concat([kept, pdf], ignore_index=True)
            kept = kept.sort_values(order, kind="stable").groupby(keys, sort=False, dropna=False).head(n)
        if len(kept):
            yield kept[columns]

    def take(_key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        used = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches), ignore_index=True).sort_values(order, kind="stable").head(n - used)
        state.update((used + len(rows),))
        if len(rows):
            yield rows[columns]

    trimmed = stream.mapInPandas(trim, stream.schema)
    return trimmed.groupBy(*keys).applyInPandasWithState(
        take, stream.schema, "used int", "append", GroupStateTimeout.NoTimeout
    )


def append_once(stream: DataFrame, path: str, keys: Sequence[str], checkpoint: str):
    """R5. Append results with ids exactly once: a batch that is tried again writes the same folder again,
    and a key that an earlier batch has written is left out."""
    keys = list(keys)

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(keys)
        if batch_id > 0:
            try:
                done = spark.read.parquet(path).where(F.col("batch") < batch_id).select(*keys)
                fresh = fresh.join(done, keys, "left_anti")
            except Exception as error:  # nothing written yet
                if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
                    raise
        fresh.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch_id}")

    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)


def violations_per_window(
    errors: DataFrame, time: str, width: str, by: Sequence[str], late: str = "10 minutes"
) -> DataFrame:
    """R6. Counts per time bucket, dropped from state once the watermark has passed. (Logs carry a time; the
    buckets are this library's addition.)"""
    return li.per_window(errors.withWatermark(time, late), time, width, by)


def takes_per_session(log: DataFrame, time: str, gap: str, by: Sequence[str], late: str = "10 minutes") -> DataFrame:
    """R6. Takes per sitting: rows less than ``gap`` apart belong together."""
    s = log.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("_w"), *by)
    return s.agg(F.count(F.lit(1)).alias("n")).select(
        F.col("_w.start").alias("session_start"), F.col("_w.end").alias("session_end"), *by, "n"
    )
