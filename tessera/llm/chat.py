"""Chat formatting with one training example for each assistant turn."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    r"""Doubles backslashes, then writes <\| for <|: no control string is left, and unescape gives the text back."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    r"""After < an escaped text has one backslash before | only where <| was: those go first, then each pair is one."""
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def expand(turns: DataFrame, turns_a_part: int = 1024) -> tuple[DataFrame, DataFrame]:
    """Format conversations (conv_id, turn, role, text) and explode every assistant turn into its own example.

    Returns (transcripts, examples). transcripts holds each formatted turn once: conv_id, place (from 0), start (its first
    code point in the conversation), formatted. examples: conv_id, target (its place), length, loss_start, loss_end: the
    example is the transcript's first `length` code points, that is all preceding turns and the reply, and only
    [loss_start, loss_end), the reply's text, is trainable. As every example is a prefix of the transcript, the output grows
    with the input, not with the square of a conversation's turns; texts() writes them out.

    Turns are in order of turn, then role and text; a null turn comes first, null roles and texts are empty. Turns of a null
    conv_id are one conversation. A line end in a role is written as backslash and n. Turns are placed by parts of turns_a_part
    turn numbers, so a long conversation is the work of many tasks.
    """
    role = F.replace(escape(F.coalesce("role", F.lit(""))), F.lit("\n"), F.lit("\\n"))
    formatted = F.concat(F.lit(START), role, F.lit("\n"), escape(F.coalesce("text", F.lit(""))), F.lit(END + "\n"))
    # a null conversation is one of its own, in two columns that joins and windows take as they are
    own = [F.coalesce("conv_id", F.lit(0)).alias("_conv"), F.col("conv_id").isNull().alias("_none"), F.coalesce(F.floor(F.col("turn") / turns_a_part), F.lit(-(1 << 62))).alias("_part")]
    rows = turns.select("conv_id", "turn", "role", "text", formatted.alias("formatted"), (F.length(role) + len(START) + 1).alias("_head"), *own)
    # sums by part of the turn numbers, then over parts: no conversation is ordered in one task
    parts = rows.groupBy("_conv", "_none", "_part").agg(F.count(F.lit(1)).alias("_n"), F.sum(F.length("formatted").cast("long")).alias("_size"))
    before = Window.partitionBy("_conv", "_none").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = parts.select("_conv", "_none", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_place"), F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    order = Window.partitionBy("_conv", "_none", "_part").orderBy("turn", "role", "text")
    inside = F.coalesce(F.sum(F.length("formatted")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.join(first, ["_conv", "_none", "_part"]).select(
        "conv_id", (F.col("_place") + F.row_number().over(order) - 1).cast("long").alias("place"), (F.col("_start") + inside).cast("long").alias("start"), "formatted", "role", "_head",
    )
    end = F.col("start") + F.length("formatted")
    examples = placed.where(F.col("role") == "assistant").select(
        "conv_id", F.col("place").alias("target"), end.alias("length"), (F.col("start") + F.col("_head")).alias("loss_start"), (end - len(END) - 1).alias("loss_end")
    )
    return placed.select("conv_id", "place", "start", "formatted"), examples


def texts(transcripts: DataFrame, examples: DataFrame) -> DataFrame:
    """The examples written out: conv_id, target, text, loss_start, loss_end. Grows with the square of a conversation's turns."""
    t, e = transcripts.alias("t"), examples.alias("e")
    joined = e.join(t, F.col("e.conv_id").eqNullSafe(F.col("t.conv_id")) & (F.col("t.place") <= F.col("e.target")))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t.place", "t.formatted"))), lambda x: x["formatted"]), "")
    return joined.groupBy("e.conv_id", "e.target", "e.loss_start", "e.loss_end").agg(whole.alias("text")).select("conv_id", "target", "text", "loss_start", "loss_end")


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(transcripts: DataFrame, examples: DataFrame) -> DataFrame:
    """DIGEST of each conversation, parsed from the formatted output.

    Roles and texts are cut from the formatted turns and unescaped. Each example is read from its own record: its text is the
    transcript up to its length, which must end with the turn that it targets, and its trainable text is cut at its loss range; a
    record that doesn't fit its transcript raises ValueError. A task streams its conversations in order and keeps two hashes,
    whatever their length; as the digests are those of whole conversations, one conversation is one task's work here.
    """
    inner = F.substring(F.col("formatted"), F.lit(len(START) + 1), F.length("formatted") - len(START) - len(END) - 1)
    role = F.substring_index(inner, "\n", 1)
    # in an escaped role an odd run of backslashes before n is a line end
    plain_role = unescape(F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"))
    body = F.substring(inner, F.length(role) + 2, F.length(inner))
    t, e = transcripts.alias("t"), examples.alias("e")
    cut_from = (F.col("e.loss_start") - F.col("t.start") + 1).cast("int")
    loss = F.when(F.col("e.target").isNotNull(), unescape(F.substring(F.col("formatted"), cut_from, (F.col("e.loss_end") - F.col("e.loss_start")).cast("int"))))
    rows = t.join(e, F.col("t.conv_id").eqNullSafe(F.col("e.conv_id")) & (F.col("t.place") == F.col("e.target")), "left").select(
        F.col("t.conv_id").alias("conv_id"), F.col("t.place").alias("place"), F.concat(plain_role, F.lit("\n"), unescape(body), F.lit("\n")).alias("turn"), loss.alias("loss"), F.length("formatted").alias("chars"), F.col("e.length").alias("length")
    )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = object(), None
        out: list[tuple] = []

        def close() -> None:
            if state is not None:
                n, turns, loss_chars, losses, chars = state
                out.append((at, n, turns.hexdigest(), loss_chars, losses.hexdigest(), chars))

        for batch in batches:
            for conv, turn, own, chars, length in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5)), strict=True):
                if state is None or conv != at:
                    close()
                    at, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[0] += 1
                state[1].update(turn.encode())
                if own is not None:
                    state[2] += len(own)
                    state[3].update(own.encode())
                state[4] += chars
                if length is not None and length != state[4]:
                    raise ValueError("an example must end with the turn that it targets")
            if len(out) > 1000:
                yield _batch(out)
                out.clear()
        close()
        if out:
            yield _batch(out)

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "place").mapInArrow(digest, DIGEST)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
