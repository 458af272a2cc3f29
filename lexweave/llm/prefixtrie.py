"""The trie of conversation prefixes, by collapse of whole sequences.

Identical conversations become one weighted sequence with the list of conversations that end there. Only one sequence of each
kind is spelled out into its prefixes; a prefix is named by its length and a 128-bit fingerprint, the exclusive or of one hash
per (place, turn), so it needs no order to be summed up and no text to be carried. Sequences that are no proper prefix of
another (an anti-join) are the leaves. What a node sums over its subtree is a sum over the sequences that pass through it:

* a node belongs to the sequence with the smallest id through it, and what belongs to a sequence is the end of its path;
* so the bytes of all different nodes below a node are, per sequence, the bytes of its path below the node and below the last
  node that isn't its own.

All steps are joins and aggregations that combine before the shuffle; a long conversation is cut into stretches.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from lexweave.llm.common import batch_of, written

#: Turns of a stretch of one conversation that a window sees together, ids of one chunk of an end list.
STRETCH, CHUNK = 4096, 4096
#: Conversations of a family, and the number of lengths that an inherited beginning may have.
FAMILY, LENGTHS = 5, 9
EMPTY = hashlib.sha256(b"").hexdigest()


# --- sequences ------------------------------------------------------------------------------------------------------


def numbered(conversations: DataFrame) -> DataFrame:
    """``conv, place, t1, t2, bytes``: the turns of each conversation numbered from 0 in order of ``turn`` (null first).

    Turns of one number are ordered by a hash of role and text. A null role or text is empty; rows without a conv_id are no
    conversation. Ranges are sorted apart and numbered by their offsets, so a conversation of any length is spread.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), F.xxhash64(role, text).alias("t1"),
        F.xxhash64(F.lit("second"), text, role).alias("t2"), F.octet_length(text).cast("long").alias("bytes"),
    )
    order = ["conv", "turn", "t1", "t2"]
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"part": F.spark_partition_id(), "n": F.monotonically_increasing_id()})
    ranges = written(ranges.drop("turn"), "turns")
    sums = ranges.groupBy("conv", "part").agg(F.min("n").alias("first"), F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("conv", "part", (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("base"))
    return ranges.join(base, ["conv", "part"]).select("conv", (F.col("n") + F.col("base")).alias("place"), "t1", "t2", "bytes")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations ``conv, place, t1, t2, bytes``, and the ids of all of them, turnless ones too.

    Conversation c begins with the first h turns of conversation c - c % 5, h being crc32 of its decimal id modulo 9, and
    goes on with its own turns after its first h.
    """
    known = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    heads = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(LENGTHS))
    facts = known.select("conv", heads.alias("h"), (F.col("conv") - F.col("conv") % FAMILY).alias("base"))
    bases = known.select(F.col("conv").alias("base"), F.col("n").alias("there"))
    facts = written(facts.join(bases, "base", "left").select("conv", "h", F.least("h", F.coalesce("there", F.lit(0))).alias("got")), "conversations")
    own = turns.join(facts, "conv").where("place >= h").select("conv", (F.col("place") - F.col("h") + F.col("got")).alias("place"), "t1", "t2", "bytes")
    near = F.sequence(F.col("conv") - (FAMILY - 1), F.col("conv") + (FAMILY - 1))
    heirs = turns.where((F.col("place") < LENGTHS - 1) & (F.col("conv") % FAMILY == 0)).select(F.explode(F.filter(near, lambda c: c - c % FAMILY == F.col("conv"))).alias("conv"), "place", "t1", "t2", "bytes")
    inherited = heirs.join(facts, "conv").where("place < h").select("conv", "place", "t1", "t2", "bytes")
    return own.union(inherited), facts.select("conv")


def _mark(k: int) -> Column:
    return F.xxhash64(F.lit(k), "place", "t1", "t2")


def sequences(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """``conv, len, k1, k2, total``: every conversation's length, fingerprint and bytes."""
    sums = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("len"), F.bit_xor(_mark(1)).alias("k1"), F.bit_xor(_mark(2)).alias("k2"), F.sum("bytes").alias("total"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return ids.join(sums, "conv", "left").select("conv", *map(zero, ("len", "k1", "k2", "total")))


def prefixes(turns: DataFrame, weighted: DataFrame) -> DataFrame:
    """Per sequence of ``weighted(conv, weight, len, total)`` and depth from 0 on: the prefix's k1, k2, its bytes and those before its last turn."""
    rows = turns.join(weighted, "conv").select("conv", "weight", "len", "total", "place", F.floor(F.col("place") / STRETCH).alias("stretch"), "bytes", _mark(1).alias("f1"), _mark(2).alias("f2"))
    sums = rows.groupBy("conv", "stretch").agg(F.bit_xor("f1").alias("s1"), F.bit_xor("f2").alias("s2"), F.sum("bytes").alias("s3"))
    before = Window.partitionBy("conv").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    begins = sums.select("conv", "stretch", F.bit_xor("s1").over(before).alias("b1"), F.bit_xor("s2").over(before).alias("b2"), F.sum("s3").over(before).alias("b3"))
    upto = Window.partitionBy("conv", "stretch").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    own = rows.withColumns({"f1": F.bit_xor("f1").over(upto), "f2": F.bit_xor("f2").over(upto), "f3": F.sum("bytes").over(upto)}).join(begins, ["conv", "stretch"])
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    cum = F.col("f3") + zero("b3")
    own = own.select("conv", "weight", "len", "total", (F.col("place") + 1).alias("depth"), F.col("f1").bitwiseXOR(zero("b1")).alias("k1"), F.col("f2").bitwiseXOR(zero("b2")).alias("k2"), cum.alias("cum"), (cum - F.col("bytes")).alias("prev"))
    root = weighted.select("conv", "weight", "len", "total", *(F.lit(0).cast("long").alias(c) for c in ("depth", "k1", "k2", "cum", "prev")))
    return own.union(root)


# --- nodes ----------------------------------------------------------------------------------------------------------


def end_digests(all_sequences: DataFrame) -> DataFrame:
    """``depth, k1, k2, ends_sha256``: the digest of the ids that end at a node, ascending.

    Sorted ranges first write the ids as chunks of text; a node's chunks stream in order through one task, as a hash over
    all of them must, one chunk at a time.
    """
    name = ["len", "k1", "k2"]
    rows = all_sequences.select(*name, "conv").repartitionByRange(*name, "conv").sortWithinPartitions(*name, "conv")
    fields = [(c, pa.int64()) for c in name]
    chunks_schema = pa.schema([*fields, ("first", pa.int64()), ("chunk", pa.string())])
    out_schema = pa.schema([("depth", pa.int64()), *fields[1:], ("ends_sha256", pa.string())])

    def cut(batches):
        for batch in batches:
            out, at = [], None
            for *node, conv in zip(*(batch.column(c).to_pylist() for c in (*name, "conv"))):
                if node != at or len(out[-1][4]) == CHUNK:
                    out.append((*node, conv, []))
                    at = node
                out[-1][4].append(str(conv))
            if out:
                *columns, ids = zip(*out)
                yield batch_of(chunks_schema, *map(list, columns), [",".join(x) for x in ids])

    def digest(batches):
        at, sha = None, None
        for batch in batches:
            out = []
            for *node, chunk in zip(*(batch.column(c).to_pylist() for c in (*name, "chunk"))):
                if node != at:
                    if at:
                        out.append((*at, sha.hexdigest()))
                    at, sha = node, hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(chunk.encode())
            if out:
                yield batch_of(out_schema, *map(list, zip(*out)))
        if at:
            yield batch_of(out_schema, *map(lambda x: [x], (*at, sha.hexdigest())))

    chunks = rows.mapInArrow(cut, "len long, k1 long, k2 long, first long, chunk string")
    dealt = chunks.repartition(*name).sortWithinPartitions(*name, "first").drop("first")
    return dealt.mapInArrow(digest, "depth long, k1 long, k2 long, ends_sha256 string")


def nodes(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """The trie over ``turns(conv, place, t1, t2, bytes)`` of the conversations ``ids(conv)``, one row per node.

    conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and the
    node's fingerprint k1, k2. Without conversations there is no node.
    """
    turns = written(turns, "rebuilt")
    every = written(sequences(turns, ids), "sequences")
    name, node = ["len", "k1", "k2"], ["depth", "k1", "k2"]
    weighted = written(every.groupBy(*name).agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("weight"), F.first("total").alias("total")), "weighted")
    paths = written(prefixes(turns, weighted.select("conv", "weight", "len", "total")), "prefixes")
    inner = paths.where("depth < len").select(F.col("depth").alias("len"), "k1", "k2").distinct()
    leaves = weighted.join(inner, name, "left_anti").select("conv", F.lit(1).cast("long").alias("leaf"))
    first = written(paths.groupBy(*node).agg(F.min("conv").alias("owner")), "first-members")  # of two written tables Spark splits the rows of a very common prefix
    foreign = paths.join(first, node).where("owner <> conv").groupBy("conv").agg(F.max("depth").alias("last"), F.max("cum").alias("last_cum"), F.max_by("owner", "depth").alias("last_owner"))
    own = weighted.select("conv").join(foreign, "conv", "left").join(leaves, "conv", "left")
    own = own.select("conv", F.coalesce("last", F.lit(-1).cast("long")).alias("last"), F.coalesce("last_cum", F.lit(0).cast("long")).alias("last_cum"), "last_owner", F.coalesce("leaf", F.lit(0).cast("long")).alias("leaf"))
    through = paths.join(written(own, "owners"), "conv")
    saved = F.col("weight") * (F.col("total") - F.col("prev")) - (F.col("total") - F.greatest("last_cum", "prev"))
    parent = F.when(F.col("depth") > F.col("last"), F.when(F.col("depth") - 1 > F.col("last"), F.col("conv")).otherwise(F.col("last_owner")))
    out = through.groupBy(*node).agg(
        F.min("conv").alias("conv_id"), F.max(parent).alias("parent_conv_id"), F.sum("weight").alias("n_convs"),
        F.count_if((F.col("depth") >= F.col("last")) & (F.col("depth") < F.col("len"))).alias("n_children"), F.sum("leaf").alias("n_leaves"), F.sum(saved).alias("saved_tokens"),
    )
    out = out.join(end_digests(every), node, "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"), "k1", "k2")


def trie(conversations: DataFrame, rebuild: bool = True) -> DataFrame:
    """Nodes of the trie of ``conversations(conv_id, turn, role, text)``, rebuilt from their families unless told otherwise.

    Repeated rows are repeated turns; other columns are ignored; see ``numbered`` for nulls and ties. An empty table has no
    node, not even a root.
    """
    turns = written(numbered(conversations), "numbered")
    return nodes(*(rebuilt(turns) if rebuild else (turns, turns.select("conv").distinct())))
