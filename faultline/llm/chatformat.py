"""Conversations formatted as one string each, with the mask of the text to learn, by Spark expressions only.

A block holds the adjacent turns of one role. The template puts marks around every block and between its
turns. Marks that occur in a text or a role are escaped by a backslash in front; the template's own marks
always follow a space or another mark. So a mark is the template's exactly if no backslash stands before it,
and every text can be read back.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: entries that a running sum goes through at once
CHUNK = 256


@dataclass(frozen=True)
class Template:
    """Marks of the template. No mark holds a space or a backslash, and none begins inside another."""

    roles: tuple[tuple[str, str, str], ...] = (("system", "<<SYS>>", "<</SYS>>"), ("user", "[INST]", "[/INST]"), ("assistant", "<s>", "</s>"))
    other: tuple[str, str, str] = ("<role>", "<is>", "</role>")
    between: str = "<turn>"
    learned: str = "assistant"

    @property
    def marks(self) -> list[str]:
        return [*(m for _, *pair in self.roles for m in pair), *self.other, self.between]

    @property
    def closing(self) -> list[str]:
        return [*(close for *_, close in self.roles), self.other[2]]


def _any(marks: list[str]) -> str:
    """A Java pattern for any of the marks, by Spark's literal rules."""
    return "(?:" + "|".join(re.sub(r"([\[\]/<>])", r"\\\1", m) if m[0] == "[" else m for m in marks) + ")"


def escaped(text: Column, template: Template) -> Column:
    return F.regexp_replace(text, f"({_any(template.marks)})", r"\\$1")


def unescaped(text: Column, template: Template) -> Column:
    return F.regexp_replace(text, rf"\\({_any(template.marks)})", "$1")


def running_sums(values: Column) -> Column:
    """For every entry of an array the sum of those before it, in chunks, so that no long array is copied per entry."""

    def sums(xs: Column) -> Column:
        return F.aggregate(xs, F.array(F.lit(0).cast("long")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))

    def shifted(parts: Column) -> Column:
        before = sums(F.transform(parts, lambda p: F.element_at(p, -1)))
        return F.transform(
            F.arrays_zip(parts.alias("p"), F.slice(before, 1, F.size(parts)).alias("b")),
            lambda z: F.transform(F.slice(z["p"], 1, F.size(z["p"]) - 1), lambda x: x + z["b"]),
        )

    def chunked(xs: Column) -> Column:
        n = F.size(xs)
        starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(CHUNK))).otherwise(F.array().cast("array<int>"))
        return F.flatten(_let(F.transform(starts, lambda s: sums(F.slice(xs, s + 1, CHUNK))), shifted))

    return _let(values, chunked)


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once, also inside the lambdas of body."""
    return F.transform(F.array(value), body)[0]


def _blocks(turns: Column) -> Column:
    """Adjacent turns of one role as (role, texts), from sorted turns."""
    n = F.size(turns)
    heads = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(turns, i)["role"] != F.get(turns, i - 1)["role"]))

    def cut(heads: Column) -> Column:
        ends = F.concat(F.slice(heads, 2, F.size(heads)), F.array(n))
        return F.transform(
            F.arrays_zip(heads.alias("h"), ends.alias("e")),
            lambda z: F.struct(
                F.get(turns, z["h"])["role"].alias("role"),
                F.transform(F.slice(turns, z["h"] + 1, z["e"] - z["h"]), lambda t: t["text"]).alias("texts"),
            ),
        )

    return _let(heads, cut)


def _opening(role: Column, template: Template) -> Column:
    known = None
    for name, start, _ in template.roles:
        known = (F if known is None else known).when(role == name, start + " ")
    return known.otherwise(F.concat(F.lit(template.other[0] + " "), role, F.lit(f" {template.other[1]} ")))


def _ending(role: Column, template: Template) -> Column:
    known = None
    for name, _, end in template.roles:
        known = (F if known is None else known).when(role == name, " " + end)
    return known.otherwise(" " + template.other[2])


def format_chats(
    turns: DataFrame,
    template: Template = Template(),
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """(conv_id, formatted, blocks): one row per conversation.

    Turns are collected per conversation, sorted by (turn, role, text) with nulls first, and merged where
    neighbours have one role. ``blocks`` has for every block its role (as escaped), its ``start`` and ``length``
    in code points of ``formatted`` and ``loss``: the [start, end) of each learned text, counted from the block.
    A null or empty text is an empty turn, a null role an empty role. Rows with a null conversation id form one
    conversation; repeated rows are repeated turns; other columns are ignored; an empty table gives no rows.

    A conversation is one string, so its rows meet in one row. Sums over blocks go through chunks; merged turns
    inside one block are summed likewise.
    """
    rows = turns.select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.struct(
            F.col(turn_col).cast("long").alias("turn"),
            escaped(F.coalesce(F.col(role_col), F.lit("")), template).alias("role"),
            escaped(F.coalesce(F.col(text_col).cast("string"), F.lit("")), template).alias("text"),
        ).alias("t"),
    )
    each = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    gap = f" {template.between} "

    def written(b: Column) -> Column:
        opening = _opening(b["role"], template)
        sizes = F.transform(b["texts"], lambda x: F.char_length(x).cast("long") + len(gap))
        at = F.char_length(opening).cast("long")
        spans = F.transform(
            F.arrays_zip(running_sums(sizes).alias("s"), sizes.alias("n")),
            lambda z: F.struct((at + z["s"]).alias("start"), (at + z["s"] + z["n"] - len(gap)).alias("end")),
        )
        return F.struct(
            b["role"].alias("role"),
            F.concat(opening, F.array_join(b["texts"], gap), _ending(b["role"], template)).alias("text"),
            F.when(b["role"] == template.learned, spans).otherwise(F.array().cast(SPANS)).alias("loss"),
        )

    def laid(blocks: Column) -> Column:
        sizes = F.transform(blocks, lambda b: F.char_length(b["text"]).cast("long"))
        return F.struct(
            F.array_join(F.transform(blocks, lambda b: b["text"]), "").alias("formatted"),
            F.transform(
                F.arrays_zip(blocks.alias("b"), sizes.alias("n"), running_sums(sizes).alias("s")),
                lambda z: F.struct(z["b"]["role"].alias("role"), z["s"].alias("start"), z["n"].alias("length"), z["b"]["loss"].alias("loss")),
            ).alias("blocks"),
        )

    whole = each.select("conv_id", _let(F.transform(_blocks(F.col("turns")), written), laid).alias("c"))
    return whole.select("conv_id", "c.formatted", "c.blocks")


SPANS = "array<struct<start: bigint, end: bigint>>"


def _pieces(formatted: Column, template: Template) -> Column:
    """The blocks' texts, cut behind every closing mark that is not escaped."""
    behind = "|".join(rf"(?<=(?<!\\){_any([m])})" for m in template.closing)
    return F.filter(F.split(formatted, behind, -1), lambda x: x != "")


def read_turns(formatted: Column, template: Template = Template()) -> Column:
    """The turns (role, text) of a formatted string, unescaped and in order."""

    def turns(piece: Column) -> Column:
        role, rest = None, None
        for name, start, end in template.roles:
            here = piece.startswith(start + " ")
            inner = F.substring(piece, F.lit(len(start) + 2), F.char_length(piece) - (len(start) + len(end) + 2))
            role = (F if role is None else role).when(here, F.lit(name))
            rest = (F if rest is None else rest).when(here, inner)
        start, sep, end = template.other
        inner = F.substring(piece, F.lit(len(start) + 2), F.char_length(piece) - (len(start) + len(end) + 2))
        parts = F.split(inner, f" {_any([sep])} ", 2)
        role, rest = role.otherwise(parts[0]), rest.otherwise(parts[1])
        texts = F.split(rest, rf" {_any([template.between])} ", -1)
        return _let(
            F.struct(role.alias("r"), texts.alias("x")),
            lambda v: F.transform(v["x"], lambda x: F.struct(unescaped(v["r"], template).alias("role"), unescaped(x, template).alias("text"))),
        )

    return F.flatten(F.transform(_pieces(formatted, template), turns))


def read_learned(formatted: Column, blocks: Column, template: Template = Template()) -> Column:
    """The texts under the mask, unescaped and in order."""
    pairs = F.arrays_zip(_pieces(formatted, template).alias("p"), blocks.alias("b"))
    texts = F.transform(
        pairs,
        lambda z: F.transform(
            z["b"]["loss"],
            lambda s: unescaped(F.substring(z["p"], (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")), template),
        ),
    )
    return F.flatten(texts)


def chat_digests(chats: DataFrame, template: Template = Template()) -> DataFrame:
    """Per formatted conversation: digests of its turns and of the text under the mask, read back from it."""
    back = chats.select(
        "conv_id",
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        read_turns(F.col("formatted"), template).alias("turns"),
        F.array_join(read_learned(F.col("formatted"), F.col("blocks"), template), "").alias("learned"),
    )
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
