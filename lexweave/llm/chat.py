"""Chat formatting: a finite-state machine over roles checks the order of turns, a template gives text segments with loss flags.

A conversation may be of any length: its turns lie in ranges of (conversation, turn), and a range runs the machine from every
state it might begin in. One row per range then tells in which it does begin.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lexweave.llm.common import batch_of, written

#: Bytes of text that one range of turns is meant to hold.
RANGE_BYTES = 32 << 20


@dataclass(frozen=True)
class Template:
    """Marks around the texts of each role, the roles under the loss mask, and which role may follow in which state.

    ``next_state[state][role]`` is the state after a turn that may come there; any other turn is out of order, and the state
    after it is ``after[role]``, or stays for a role unknown. A conversation is complete in a state of ``complete``. Roles
    without marks, null among them (read as the empty role), stand between ``other`` marks with their name.
    """

    marks: dict[str, tuple[str, str]] = field(default_factory=lambda: {"system": ("<s>[SYS]", "[/SYS]</s>"), "user": ("<s>[INST]", "[/INST]</s>"), "assistant": ("<s>[OUT]", "[/OUT]</s>")})
    other: tuple[str, str, str] = ("<s>[ROLE]", "[/ROLE]", "[END]</s>")
    control: tuple[str, ...] = ("<s>", "</s>", "[SYS]", "[/SYS]", "[INST]", "[/INST]", "[OUT]", "[/OUT]", "[ROLE]", "[/ROLE]", "[END]")
    loss: frozenset[str] = frozenset({"assistant"})
    start: str = "start"
    next_state: dict[str, dict[str, str]] = field(
        default_factory=lambda: {"start": {"system": "system", "user": "user"}, "system": {"user": "user"}, "user": {"assistant": "assistant"}, "assistant": {"user": "user"}}
    )
    after: dict[str, str] = field(default_factory=lambda: {"system": "system", "user": "user", "assistant": "assistant"})
    complete: frozenset[str] = frozenset({"assistant"})

    @property
    def states(self) -> list[str]:
        return sorted(self.next_state)

    def step(self, state: str, role: str) -> tuple[str, bool]:
        """The state after a turn, and whether the turn was in order."""
        following = self.next_state[state].get(role)
        return (following, True) if following else (self.after.get(role, state), False)

    def escape(self, text: str) -> str:
        r"""A backslash becomes two; ``\.`` after the first character of a control string breaks it, wherever one begins."""
        begins = "|".join(map(re.escape, self.control))
        return re.sub(f"(?s)(?=(?:{begins}))(.)", r"\1\\.", text.replace("\\", "\\\\"))

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(\\|\.)", lambda m: "\\" if m[1] == "\\" else "", text)

    def segments(self, role: str, text: str) -> list[tuple[str, str, bool]]:
        """Kind (open, text, close), content and loss flag."""
        if role in self.marks:
            first, last = self.marks[role]
        else:
            first, last = self.other[0] + self.escape(role) + self.other[1], self.other[2]
        return [("open", first, False), ("text", self.escape(text), role in self.loss), ("close", last, False)]

    def role_of(self, mark: str) -> str:
        known = {first: role for role, (first, _) in self.marks.items()}
        return known[mark] if mark in known else self.unescape(mark[len(self.other[0]) : len(mark) - len(self.other[1])])

    def parse(self, formatted: str) -> list[tuple[str, str]]:
        """Roles and texts of a whole formatted conversation."""
        out, at = [], 0
        ends = {first: (role, last) for role, (first, last) in self.marks.items()}
        while at < len(formatted):
            first = next((f for f in ends if formatted.startswith(f, at)), None)
            if first:
                role, last = ends[first]
                at += len(first)
            elif formatted.startswith(self.other[0], at):
                stop = formatted.index(self.other[1], at)
                role, last = self.unescape(formatted[at + len(self.other[0]) : stop]), self.other[2]
                at = stop + len(self.other[1])
            else:
                raise ValueError(f"no turn begins at {at}")
            stop = formatted.index(last, at)
            out.append((role, self.unescape(formatted[at:stop])))
            at = stop + len(last)
        return out


def _ordered(df: DataFrame, template: Template, partitions: int | None) -> DataFrame:
    """Turns in order: conv_id, part, place, role, text, ok (by the state the range began in), ends (on a range's last row)."""
    rows = df.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    if partitions is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        partitions = max(df.sparkSession.sparkContext.defaultParallelism, -(-size // RANGE_BYTES))
    order = ["conv_id", "turn", "tie", "role", "text"]
    rows = rows.withColumn("tie", F.xxhash64("role", "text"))
    rows = rows.repartitionByRange(partitions, "conv_id", "turn", "tie").sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    states = template.states
    fields = [("conv_id", pa.int64()), ("part", pa.int32()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("ok", pa.list_(pa.bool_())), ("first", pa.bool_()), ("ends", pa.list_(pa.string()))]
    schema = pa.schema(fields)

    def run(batches):
        """``first``: the conversation is the range's first, the only one that may have begun before it."""
        place, now, conv, first, held = 0, [], None, True, None
        for batch in batches:
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "role", "text"))):
                if place == 0 or row[0] != conv:
                    first, conv = place == 0, row[0]
                    now = list(states) if first else [template.start] * len(states)
                steps = [template.step(s, row[2]) for s in now]
                now = [s for s, _ in steps]
                if held:
                    out.append(held)
                held = (row[0], row[1], place, row[2], row[3], [ok for _, ok in steps], first, None)
                place += 1
            if out:
                yield batch_of(schema, *map(list, zip(*out)))
        if held:
            yield batch_of(schema, *map(lambda x: [x], (*held[:-1], now)))

    kinds = "conv_id long, part int, place long, role string, text string, ok array<boolean>, first boolean, ends array<string>"
    return rows.select("conv_id", "part", "role", "text").mapInArrow(run, kinds)


def write_chat(df: DataFrame, path: str, template: Template | None = None, partitions: int | None = None) -> None:
    """Writes the segments of all conversations to ``path``: conv_id, part, place, segment, kind, content, loss, in_order, complete.

    ``df`` has conv_id, turn, role, text. Order of a conversation: turn (null first), then a hash of role and text, so that
    repeated rows are repeated turns. A null text is empty, a null role the empty role; null ids are one conversation.
    ``part, place, segment`` order the output; ``in_order`` is the turn's verdict, ``complete`` is set on the last segment
    of a range: whether the conversation may end there.
    """
    template = template or Template()
    turns = written(_ordered(df, template, partitions), "turns")
    ends = turns.where("ends IS NOT NULL").select("part", F.col("conv_id").alias("last"), F.col("first").alias("only"), "ends")
    heads = turns.where("place = 0").select("part", F.col("conv_id").alias("head"))
    begins, states = {}, template.states
    carried, state = object(), template.start
    for r in ends.join(heads, "part").orderBy("part").collect():  # one row per range
        begins[r.part] = states.index(state if r.head == carried else template.start)
        state = r.ends[begins[r.part]] if r.only else r.ends[0]
        carried = r.last
    names = ("conv_id", "part", "place", "role", "text", "ok", "first", "ends")
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("place", pa.int64()), ("segment", pa.int32()), ("kind", pa.string()), ("content", pa.string()), ("loss", pa.bool_()), ("in_order", pa.bool_()), ("complete", pa.bool_())])

    def run(batches):
        for batch in batches:
            out = []
            for conv, part, place, role, text, ok, first, end in zip(*(batch.column(c).to_pylist() for c in names)):
                k = begins[part] if first else 0
                for n, (kind, content, loss) in enumerate(template.segments(role, text)):
                    out.append((conv, part, place, n, kind, content, loss, ok[k], end[k] in template.complete if end and n == 2 else None))
            if out:
                yield batch_of(schema, *map(list, zip(*out)))

    kinds = "conv_id long, part int, place long, segment int, kind string, content string, loss boolean, in_order boolean, complete boolean"
    turns.select(*names).mapInArrow(run, kinds).write.parquet(path)


def digests(spark: SparkSession, path: str, template: Template | None = None) -> DataFrame:
    """Per conversation, read back from ``path``: digests of turns and of the text under the loss mask, lengths, n_out_of_order.

    A digest runs over a conversation from its first turn to its last, so its rows stream through one task, sorted by Spark
    and held one at a time; the formatting itself is not bound to that.
    """
    template = template or Template()
    rows = spark.read.parquet(path).select("conv_id", "part", "place", "segment", "kind", "content", "loss", "in_order")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "part", "place", "segment")
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_out_of_order", pa.int64())])

    def segments(batches):
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "kind", "content", "loss", "in_order")))

    def run(batches):
        out = []
        for conv, group in groupby(segments(batches), key=lambda r: r[0]):
            turns, masked = hashlib.sha256(), hashlib.sha256()
            n = loss_chars = chars = bad = 0
            for _, kind, content, loss, in_order in group:
                chars += len(content)
                if kind == "open":
                    turns.update(template.role_of(content).encode("utf-8", "surrogatepass") + b"\n")
                    n, bad = n + 1, bad + (not in_order)
                elif kind == "text":
                    text = template.unescape(content)
                    raw = text.encode("utf-8", "surrogatepass")
                    turns.update(raw + b"\n")
                    if loss:
                        masked.update(raw)
                        loss_chars += len(text)
            out.append((conv, n, turns.hexdigest(), loss_chars, masked.hexdigest(), chars, bad))
            if len(out) == 5000:
                yield batch_of(schema, *map(list, zip(*out)))
                out = []
        if out:
            yield batch_of(schema, *map(list, zip(*out)))

    return rows.drop("part", "place", "segment").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_out_of_order long")
