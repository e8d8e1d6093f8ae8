"""Chat formatting: prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, and only its text
is trainable. If a conversation ends with other turns, one more example holds them, with nothing to
train, so that the examples give back the whole conversation.

Template of a turn: ``<|role|>text<|end|>``. In texts and roles ``\\`` and ``<`` are written with a
``\\`` before them, in roles ``|`` too, so that no text can hold a control string; a null role is written
``\\0``. Reading undoes this exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

END = "<|end|>"
ESCAPED = re.compile(r"\\(.)", re.DOTALL)
TURN = re.compile(r"<\|((?:[^\\|]|\\.)*)\|>((?:[^\\<]|\\.)*)<\|end\|>", re.DOTALL)


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\<"))


def unescaped(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def parsed(formatted: str) -> list[tuple[str | None, str]]:
    """Role and text of every turn; ValueError if it isn't of the template."""
    out, at = [], 0
    while at < len(formatted):
        found = TURN.match(formatted, at)
        if not found:
            raise ValueError(f"no turn at {at}")
        out.append((None if found[1] == "\\0" else unescaped(found[1]), unescaped(found[2])))
        at = found.end()
    return out


def format_conversations(df: DataFrame, *, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", target_role: str = "assistant") -> DataFrame:
    """Examples: conversation, example (position of its last turn, from 1), last, formatted, loss_start, loss_end.

    Spans are in code points; an example without a target has loss_start = loss_end. Turns go by turn
    number, then role and text; nulls first. Null texts are empty. Rows without a conversation id form
    one conversation. An empty table gives no examples. The expansion holds each context once for every
    reply after it, so it grows with the square of a conversation's replies, as the method asks. A very long
    text is part of each example after it; repeated rows are turns of their own; further columns are not read.
    """
    head = lambda role: F.concat(F.lit("<|"), F.coalesce(F.replace(escaped(role), F.lit("|"), F.lit("\\|")), F.lit("\\0")), F.lit("|>"))
    rows = df.select(F.col(conversation).alias("_conv"), F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("_row"))
    whole = rows.groupBy("_conv").agg(F.array_sort(F.collect_list("_row")).alias("_turns"))
    whole = whole.select("_conv", "_turns", F.transform("_turns", lambda t: F.concat(head(t["role"]), escaped(t["text"]), F.lit(END))).alias("_parts"), F.size("_turns").alias("_n"))
    # Only turns that give an example are multiplied; each then takes the parts up to its own.
    given = F.filter(F.sequence(F.lit(1), F.col("_n")), lambda k: F.coalesce(F.element_at("_turns", k)["role"] == target_role, F.lit(False)) | (k == F.col("_n")))
    each = whole.select("_conv", "_n", "_turns", "_parts", F.explode(given).alias("example")).withColumn("_own", F.element_at("_turns", F.col("example")))
    each = each.select("_conv", "_n", "example", F.array_join(F.slice("_parts", F.lit(1), F.col("example")), "").alias("formatted"), F.coalesce(F.col("_own.role") == target_role, F.lit(False)).alias("_target"), escaped(F.col("_own.text")).alias("_body"))
    stop = (F.length("formatted") - len(END)).cast("long")
    return each.select(
        F.col("_conv").alias(conversation), "example", (F.col("example") == F.col("_n")).alias("last"), "formatted",
        F.when(F.col("_target"), stop - F.length("_body")).otherwise(stop).alias("loss_start"), stop.alias("loss_end"),
    )


def read_examples(examples: DataFrame, *, conversation: str = "conv_id") -> DataFrame:
    """What each example says: conversation, example, chars, loss (text under the mask), turns (role, \\n, text, \\n each; of last examples only), n_turns."""
    kind = examples.schema[conversation].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "formatted"):
            texts = batch.column("formatted").to_pylist()
            loss = [unescaped(t[a:b]) for t, a, b in zip(texts, batch.column("loss_start").to_pylist(), batch.column("loss_end").to_pylist(), strict=True)]
            turns = [parsed(t) if last else None for t, last in zip(texts, batch.column("last").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([
                batch.column(conversation), batch.column("example"), pa.array([len(t) for t in texts], pa.int64()), pa.array(loss, pa.string()),
                pa.array([None if t is None else "".join(f"{r or ''}\n{x}\n" for r, x in t) for t in turns], pa.string()), pa.array([None if t is None else len(t) for t in turns], pa.int64()),
            ], names=[conversation, "example", "chars", "loss", "turns", "n_turns"])

    return examples.mapInArrow(run, f"{conversation} {kind}, example int, chars long, loss string, turns string, n_turns long")


def conversation_digests(examples: DataFrame, *, conversation: str = "conv_id") -> DataFrame:
    """By conversation, read back from its examples: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "")
    found = read_examples(examples, conversation=conversation).groupBy(conversation).agg(F.max("n_turns").alias("n_turns"), F.max("turns").alias("turns"), said.alias("loss"), F.sum("chars").alias("formatted_chars"))
    return found.select(conversation, "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
