"""Chat formatting: a finite-state machine over roles and a declarative template.

The machine checks the order of turns; the template gives each turn's marks and whether its text bears loss.
A conversation streams through one task in turn order, a row at a time, so that its length needs no memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table


@dataclass(frozen=True)
class Mark:
    """What stands before and after a turn's text, and whether the text bears loss."""

    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """marks: by role; {role} in another role's mark is its escaped name. next: the roles that may follow a state."""

    marks: dict[str, Mark]
    other: Mark
    controls: tuple[str, ...]
    next: dict[str, tuple[str, ...]]
    escape: str = "\\"


#: Instruction marks with a closing mark for every turn; all but spaces and line ends in them is a control string.
INSTRUCT = Template(
    marks={"system": Mark("<<SYS>>\n", "\n<</SYS>>\n"), "user": Mark("<s>[INST] ", " [/INST]"), "assistant": Mark("[ANS] ", " </s>", loss=True)},
    other=Mark("<|role|>{role}<|text|>", "<|end|>"),
    controls=("<<SYS>>", "<</SYS>>", "<s>", "</s>", "[INST]", "[/INST]", "[ANS]", "<|role|>", "<|text|>", "<|end|>"),
    next={"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
)


class Chat:
    """The machine for one template: render() writes a turn, Reader reads turns back."""

    def __init__(self, template: Template = INSTRUCT):
        self.t = template
        self.control = re.compile("|".join(map(re.escape, sorted(template.controls, key=len, reverse=True))))
        self.escaped = re.compile(re.escape(template.escape) + "(.)", re.S)

    def hide(self, text: str) -> str:
        """text without control strings: the escape sign is doubled, and put after the first sign of a control string."""
        e = self.t.escape
        return self.control.sub(lambda m: m[0][0] + e + m[0][1:], text.replace(e, e + e))

    def show(self, text: str) -> str:
        return self.escaped.sub(r"\1", text) if self.t.escape in text else text

    def follows(self, state: str, role: str) -> bool:
        return role in self.t.next.get(state, ())

    def render(self, role: str, text: str) -> list[tuple[str, bool]]:
        """The segments of one turn, each with its loss flag."""
        mark = self.t.marks.get(role)
        if mark:
            return [(mark.before, False), (self.hide(text), mark.loss), (mark.after, False)]
        head, _, tail = self.t.other.before.partition("{role}")
        return [(head, False), (self.hide(role), False), (tail, False), (self.hide(text), self.t.other.loss), (self.t.other.after, False)]


    def read(self, formatted: str, at: int = 0) -> tuple[str, str, int]:
        """(role, text, end) of the turn that begins at a place of the formatted output."""
        for role, mark in self.t.marks.items():
            if formatted.startswith(mark.before, at):
                break
        else:
            head, _, tail = self.t.other.before.partition("{role}")
            if not formatted.startswith(head, at):
                raise ValueError(f"no turn begins at {at}")
            cut = formatted.index(tail, at + len(head))
            role, mark = self.show(formatted[at + len(head) : cut]), self.t.other
            at = cut + len(tail) - len(mark.before)
        start = at + len(mark.before)
        # Hidden text holds no control string, so the first one is the closing mark's.
        stop = self.control.search(formatted, start)
        end = stop.start() - mark.after.index(stop[0])
        return role, self.show(formatted[start:end]), end + len(mark.after)


def in_order(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Rows dealt by conversation and sorted by turn (nulls first), ties by role and text."""
    columns = [F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")]
    return df.select(*columns).repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")


def format_chat(df: DataFrame, template: Template = INSTRUCT, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows (conv, ordinal, segment, loss, in_order): the segments of each conversation, joined by ordinal its output.

    in_order: false on the segments of a turn that the machine doesn't allow there; the turn is still written.
    Null role or text: empty. Null turn: first. Null conv: one conversation. Ties: by role, then text; repeated rows
    are turns of their own. Empty table: empty result.
    """
    small_batches(df.sparkSession)
    chat = Chat(template)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, n = (), "", 0
        for batch in batches:
            out: list[tuple] = []
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if last != (conv,):
                    last, state, n = (conv,), "", 0
                fits = chat.follows(state, role)
                for segment, loss in chat.render(role, text):
                    out.append((conv, n, segment, loss, fits))
                    n += 1
                state = role
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), (batch.schema.field(0).type, pa.int64(), pa.string(), pa.bool_(), pa.bool_()), strict=True)], ["conv", "ordinal", "segment", "loss", "in_order"])

    kind = df.schema[conv_col].dataType.simpleString()
    return in_order(df, conv_col, turn_col, role_col, text_col).mapInArrow(run, f"conv {kind}, ordinal long, segment string, loss boolean, in_order boolean")


def read_back(segments: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """Digests of what format_chat() wrote, taken from its segments in order: one row for each conversation.

    (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, order_errors). The segments of one
    conversation must come together and in order, as format_chat() gives them; a turn is read as soon as it is whole.
    """
    chat = Chat(template)
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "order_errors"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = ()
        closing = {chat.t.other.after, *(m.after for m in chat.t.marks.values())}
        for batch in batches:
            rows = []
            for conv, segment, loss, fits in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                if last != (conv,):
                    if last:
                        rows.append((last[0], n, turns.hexdigest(), masked_n, masked.hexdigest(), chars, wrong))
                    last, n, turns, masked, masked_n, chars, wrong, held = (conv,), 0, hashlib.sha256(), hashlib.sha256(), 0, 0, 0, []
                held.append(segment)
                chars += len(segment)
                if loss:
                    text = chat.show(segment)
                    masked.update(text.encode())
                    masked_n += len(text)
                if segment in closing and not loss:
                    whole = "".join(held)
                    try:
                        role, text, end = chat.read(whole)
                    except ValueError:
                        continue
                    if end == len(whole):
                        turns.update(f"{role}\n{text}\n".encode())
                        n, wrong, held = n + 1, wrong + (not fits), []
            if rows:
                yield records(rows, batch.schema.field(0).type)
            kind = batch.schema.field(0).type
        if last:
            yield records([(last[0], n, turns.hexdigest(), masked_n, masked.hexdigest(), chars, wrong)], kind)

    def records(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        kinds = (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    kind = segments.schema["conv"].dataType.simpleString()
    return segments.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, order_errors long")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one whose texts hold control strings, formatted and read back."""
    hard = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    return read_back(format_chat(rows.unionByName(more)))
