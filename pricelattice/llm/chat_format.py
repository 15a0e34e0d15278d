"""Chat formatting with Spark expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template: a block is START role \n text (SEP text)* END \n. An escaped text never holds "<|".
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"


def escape(text: Column) -> Column:
    r"""``\`` becomes ``\\``, and ``<|`` becomes ``<\|``: no control string is left, and :func:`unescape` reverts it."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    r"""The inverse of :func:`escape`. Every ``\`` begins an escape, so a split at ``\\`` from the left is exact."""
    parts = F.transform(F.split(text, r"\\\\", -1), lambda p: F.replace(p, F.lit("<\\|"), F.lit("<|")))
    return F.array_join(parts, "\\")


def escape_role(role: Column) -> Column:
    r"""As :func:`escape`; a line end, which would end the role, becomes ``\n``."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    """The inverse of :func:`escape_role`."""
    parts = F.transform(
        F.split(role, r"\\\\", -1),
        lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("<\\|"), F.lit("<|")),
    )
    return F.array_join(parts, "\\")


def format_chats(conversations: DataFrame) -> DataFrame:
    """One row for each ``conv_id`` with its ``formatted`` text.

    Turn structs are collected, sorted by turn (NULL first; ties by role, then text), and
    adjacent turns of one role share a block, their texts kept apart by a separator. NULL role or
    text: empty. Repeated rows stay turns of their own. Rows with NULL ``conv_id`` form one conversation.
    Each turn sees only its two neighbours in the array, so the work is linear in the turns.
    One conversation is one output string, so it must fit a row, as any string in Spark.
    Other columns are ignored; an empty table gives an empty result.
    """
    turns = conversations.select(
        F.col("conv_id"),
        F.struct(
            F.col("turn").alias("turn"),
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).alias("t"),
    )
    chats = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def piece(t: Column, i: Column) -> Column:
        role = t["role"]
        first = (i == 0) | (F.get("turns", i - 1)["role"] != role)
        last = (i == F.size("turns") - 1) | (F.get("turns", i + 1)["role"] != role)
        return F.concat(
            F.when(first, F.concat(F.lit(START), escape_role(role), F.lit("\n"))).otherwise(F.lit(SEP)),
            escape(t["text"]),
            F.when(last, F.lit(END + "\n")).otherwise(F.lit("")),
        )

    return chats.select("conv_id", F.array_join(F.transform("turns", piece), "").alias("formatted"))


def read_chats(formatted: DataFrame) -> DataFrame:
    """Parse ``formatted`` back into ``turns``, an array of (role, text), unescaped, a struct for each original turn."""
    blocks = F.slice(F.split("formatted", r"<\|im_start\|>", -1), F.lit(2), F.greatest(F.size(F.split("formatted", r"<\|im_start\|>", -1)) - 1, F.lit(0)))
    split = formatted.select("conv_id", "formatted", blocks.alias("_blocks"))

    def turns(block: Column) -> Column:
        role = F.substring_index(block, "\n", 1)
        body = F.substring(block, F.length(role) + 2, F.length(block) - F.length(role) - 2 - len(END))
        return F.transform(
            F.split(body, r"<\|im_sep\|>", -1),
            lambda t: F.struct(unescape_role(role).alias("role"), unescape(t).alias("text")),
        )

    return split.select("conv_id", "formatted", F.flatten(F.transform("_blocks", turns)).alias("turns"))


def chat_digests(formatted: DataFrame, assistant: str = "assistant") -> DataFrame:
    """What the output holds when it is read back: turns, and the text under the loss mask (assistant texts)."""
    return (
        read_chats(formatted)
        .withColumn("_loss", F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == assistant), lambda t: t["text"]), ""))
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
            F.length("_loss").cast("long").alias("loss_chars"),
            F.sha2("_loss", 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
        )
    )
