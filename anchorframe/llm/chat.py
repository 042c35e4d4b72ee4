"""Conversations as single texts with turn marks and a loss mask, and back again, in Spark expressions only.

A conversation's rows are collected as structs and sorted by turn (rows with one turn by role, then text); neighbours of one role
are merged into a block by an array aggregation, and blocks are concatenated: opening mark, role, mark, the texts of its rows
with a mark between them, closing mark. So merging loses no row: all can be read back.

Marks inside roles and texts are escaped: a backslash is doubled, and a mark gets a backslash behind its first character. No mark has a
backslash or starts as it ends, so escaped texts hold no mark, a single backslash is one that was put in, and undoing it is exact.

The loss mask is a list of spans (start, length in code points) of the formatted text: one for each text of the learned role, without marks.

Null texts and roles are empty ones; rows with a null id are one conversation; repeated rows are turns of their own; an empty table
gives an empty result. Columns other than those named are not read. A conversation is one row, so it must fit in one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorframe.session import materialize


@dataclass(frozen=True)
class Marks:
    """Control strings: before a block's role, behind it, between a block's texts, behind a block; ``foreign`` ones are only escaped."""

    opening: str = "<s>"
    says: str = "[INST]"
    more: str = "[/INST]"
    closing: str = "</s>"
    foreign: tuple[str, ...] = ("<<SYS>>", "<</SYS>>")

    def __post_init__(self):
        for mark in self.every:
            if len(mark) < 2 or "\\" in mark or any(mark.endswith(mark[:n]) for n in range(1, len(mark))):
                raise ValueError(f"not fit for a mark: {mark!r}")
        own = self.every[:4]
        if any(a != b and (a in b or any(a.endswith(b[:n]) for n in range(1, len(b)))) for a in own for b in own):
            raise ValueError("marks hold or continue each other")

    @property
    def every(self) -> tuple[str, ...]:
        return (self.opening, self.says, self.more, self.closing, *self.foreign)


def escaped(text: Column, marks: Marks) -> Column:
    """The text without marks in it."""
    out = F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for mark in marks.every:
        out = F.replace(out, F.lit(mark), F.lit(mark[0] + "\\" + mark[1:]))
    return out


def unescaped(text: Column) -> Column:
    """What ``escaped`` was given (null as an empty text)."""
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def _merged(turns: Column) -> Column:
    """Sorted turns (turn, role, text) as blocks (role, texts) of neighbours with one role."""
    none = F.array().cast("array<struct<role:string,texts:array<string>>>")

    def step(blocks: Column, turn: Column) -> Column:
        last = F.get(blocks, F.size(blocks) - 1)
        joined = F.concat(F.slice(blocks, 1, F.size(blocks) - 1), F.array(F.struct(last["role"].alias("role"), F.concat(last["texts"], F.array(turn["text"])).alias("texts"))))
        alone = F.concat(blocks, F.array(F.struct(turn["role"].alias("role"), F.array(turn["text"]).alias("texts"))))
        return F.when(last["role"] == turn["role"], joined).otherwise(alone)

    return F.aggregate(turns, none, step)


def _spans(blocks: Column, learned: str, marks: Marks) -> Column:
    """Spans (start, length) of the learned role's texts in the concatenated blocks."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    kind = "struct<at:int,spans:array<struct<start:int,length:int>>>"

    def of_text(state: Column, text: Column) -> Column:
        length = F.length(text)
        spans = F.concat(state["spans"], F.array(F.struct(state["at"].alias("start"), length.alias("length"))))
        return F.struct((state["at"] + length + len(marks.more)).alias("at"), spans.alias("spans")).cast(kind)

    def of_block(state: Column, block: Column) -> Column:
        first = state["at"] + len(marks.opening) + F.length(block["role"]) + len(marks.says)
        inside = F.aggregate(block["texts"], F.struct(first.alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")).cast(kind), of_text)
        spans = F.when(block["role"] == learned, F.concat(state["spans"], inside["spans"])).otherwise(state["spans"])
        return F.struct((inside["at"] - len(marks.more) + len(marks.closing)).alias("at"), spans.alias("spans")).cast(kind)

    return F.aggregate(blocks, start.cast(kind), of_block)["spans"]


def formatted(rows: DataFrame, marks: Marks = Marks(), learned: str = "assistant", id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
              text_col: str = "text") -> DataFrame:
    """The id, ``formatted`` and ``loss`` (spans of the learned role's texts) of each conversation."""
    turn = F.struct(F.col(turn_col).alias("turn"), escaped(F.col(role_col), marks).alias("role"), escaped(F.col(text_col), marks).alias("text"))
    turns = rows.select(F.col(id_col).alias("conv"), turn.alias("one")).groupBy("conv").agg(F.sort_array(F.collect_list("one")).alias("turns"))
    # Evaluated once: a later expression that names a column twice would evaluate it twice.
    blocks = turns.select("conv", F.explode(F.array(_merged(F.col("turns")))).alias("blocks"))
    said = F.transform("blocks", lambda b: F.concat(F.lit(marks.opening), b["role"], F.lit(marks.says), F.array_join(b["texts"], marks.more), F.lit(marks.closing)))
    return blocks.select(F.col("conv").alias(id_col), F.array_join(said, "").alias("formatted"), _spans(F.col("blocks"), _plain(learned, marks), marks).alias("loss"))


def _plain(text: str, marks: Marks) -> str:
    """``escaped`` for a Python string."""
    text = text.replace("\\", "\\\\")
    for mark in marks.every:
        text = text.replace(mark, mark[0] + "\\" + mark[1:])
    return text


def read_back(texts: DataFrame, marks: Marks = Marks(), id_col: str = "conv_id") -> DataFrame:
    """The id, turns (role, text) in order, and the texts under the loss mask of each formatted conversation."""
    def turns_of(block: Column) -> Column:
        sides = F.split(F.substring(block, len(marks.opening) + 1, 2147483647), re.escape(marks.says), 2)
        role = unescaped(F.get(sides, F.lit(0)))
        return F.transform(F.split(F.get(sides, F.lit(1)), re.escape(marks.more), -1), lambda t: F.struct(role.alias("role"), unescaped(t).alias("text")))

    blocks = F.split("formatted", re.escape(marks.closing), -1)
    turns = F.flatten(F.transform(F.slice(blocks, 1, F.size(blocks) - 1), turns_of))
    under = F.transform("loss", lambda s: unescaped(F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    return texts.select(id_col, turns.alias("turns"), under.alias("learned"))


def digests(rows: DataFrame, marks: Marks = Marks(), learned: str = "assistant") -> DataFrame:
    """Formats conversations (conv_id, turn, role, text), writes them, and returns what is read back from the files, in numbers and hashes."""
    written = materialize(formatted(rows, marks, learned))
    back = read_back(written, marks).join(written.select(F.col("conv_id").alias("id"), F.length("formatted").cast("long").alias("formatted_chars")), F.col("conv_id").eqNullSafe(F.col("id")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("learned", "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
                       F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), "formatted_chars")
