"""The registered queries of the operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexweave.llm import chat, decontam, embed, exactdedup, lexical, linededup, packing, prefixtrie, quality, records, simhash, sqltext, toxicity, urlfilter
from lexweave.llm.common import default_tokenizer, documents, fresh_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {"op11_prefix_trie": sqltext.PREFIX_TRIE, "op12_exact_dedup": sqltext.EXACT_DEDUP, "op13_search": sqltext.SEARCH}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_records(spark, sf):
    path = fresh_path(spark, "records")
    records.write_records(documents(spark, sf), path, default_tokenizer())
    return records.digests(spark, path)


@query
def op4_simhash(spark, sf):
    return simhash.near_duplicates(documents(spark, sf))


@query
def op8_packing(spark, sf):
    return packing.pack(documents(spark, sf), default_tokenizer())


@query
def op6_embeddings(spark, sf):
    return embed.near_duplicates(spark.read.parquet(f"{sf}/embeddings.parquet"))


@query
def op7_decontamination(spark, sf):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    return decontam.digests(decontam.find(documents(spark, sf).select("doc_id", "text"), items))


@query
def op9_line_dedup(spark, sf):
    """The lines deleted from each document and a digest of the text that is left."""
    out = linededup.dedup_lines(documents(spark, sf).select("doc_id", "text"))
    removed = F.coalesce(F.array_sort("_removed"), F.array().cast("array<int>"))
    return out.select("doc_id", F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")


@query
def op2_toxicity(spark, sf):
    return toxicity.digests(documents(spark, sf), labels(spark, sf))


@query
def op10_quality(spark, sf):
    return quality.digests(documents(spark, sf), labels(spark, sf))


@query
def op3_chat(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    path = fresh_path(spark, "chat")
    chat.write_chat(turns.union(added), path)
    return chat.digests(spark, path)


@query
def op5_urls(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")
    return urlfilter.judge(pages, urlfilter.own_labels(spark)).select("page_id", "host", "path", "rule", "verdict", "score")


@query
def op11_prefix_trie(spark, sf):
    return prefixtrie.trie(spark.read.parquet(f"{sf}/conversations.parquet")).drop("k1", "k2")


@query
def op12_exact_dedup(spark, sf):
    return exactdedup.classes(documents(spark, sf))


@query
def op13_search(spark, sf):
    return lexical.search(documents(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet"))
