"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted; adjacent turns of one role share a block:

    <|im_start|>role<|im_sep|>text<|im_part|>text<|im_end|>\\n

Inside roles and texts a backslash goes before each backslash and between `<` and `|`, so no text can hold a
control string, and taking one backslash from each pair gives the text back. The loss mask is a list of code
point ranges: the texts of the trained role, without the control strings between them.

Null texts and roles count as empty, a null turn comes first; rows equal in turn are sorted by role, then text,
so repeated rows stay repeated. Rows with a null id form one conversation. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, PART, END = "<|im_start|>", "<|im_sep|>", "<|im_part|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _quoted(mark: str) -> str:
    return mark.replace("|", r"\|")


def format_conversations(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """conv_id, formatted and loss (array of start and length, in code points of `formatted`)."""
    text, role = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("role"), F.lit(""))
    rows = turns.select("conv_id", F.struct(F.col("turn").alias("turn"), role.alias("role"), text.alias("text")).alias("t"))
    sorted_rows = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def piece(t: Column, i: Column) -> Column:
        """The control strings before a turn's text, and the text."""
        joins = (i > 0) & (F.get("turns", i - 1)["role"] == t["role"])
        opens = F.concat(F.when(i > 0, F.lit(END)).otherwise(F.lit("")), F.lit(START), escape(t["role"]), F.lit(SEP))
        return F.struct(F.when(joins, F.lit(PART)).otherwise(opens).alias("before"), escape(t["text"]).alias("text"), (t["role"] == trained_role).alias("trained"))

    pieces = sorted_rows.select("conv_id", F.transform("turns", piece).alias("pieces"))
    whole = F.concat(F.array_join(F.transform("pieces", lambda p: F.concat(p["before"], p["text"])), ""), F.lit(END))
    none = F.array().cast("array<struct<start: int, length: int>>")

    def step(acc: Column, p: Column) -> Column:
        start, size = acc["at"] + F.length(p["before"]), F.length(p["text"])
        own = F.array(F.struct(start.alias("start"), size.alias("length")))
        return F.struct((start + size).alias("at"), F.when(p["trained"], F.concat(acc["spans"], own)).otherwise(acc["spans"]).alias("spans"))

    spans = F.aggregate("pieces", F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda acc: acc["spans"])
    return pieces.select("conv_id", whole.alias("formatted"), spans.alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (array of role and text) and trained (the texts under the loss mask), from the output alone."""

    def block(b: Column) -> Column:
        role = F.substring_index(F.substring(b, F.lit(len(START) + 1), F.length(b)), SEP, 1)
        texts = F.split(F.substring(b, F.length(role) + len(START + SEP) + 1, F.length(b)), _quoted(PART), -1)
        return F.transform(texts, lambda t: F.struct(unescape(role).alias("role"), unescape(t).alias("text")))

    parts = F.split("formatted", _quoted(END), -1)
    blocks = F.filter(parts, lambda b: b != "")
    trained = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    return formatted.select("conv_id", F.flatten(F.transform(blocks, block)).alias("turns"), trained.alias("trained"), F.length("formatted").alias("formatted_chars"))


def digests(turns: DataFrame) -> DataFrame:
    """What the formatted conversations give when read back."""
    got = read_back(format_conversations(turns))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("trained", "")
    return got.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )
