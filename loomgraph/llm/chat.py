"""Chat formatting with Spark expressions only: reversible templates and loss masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, SEP, CLOSE = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"


def escape(c: Column) -> Column:
    r"""Backslash becomes \s, line feeds of roles stay to the caller, and <| becomes <\|; no control string is left."""
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\s")), F.lit("<|"), F.lit("<\\|"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("<\\|"), F.lit("<|")), F.lit("\\s"), F.lit("\\"))


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit("\\n"))


def unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit("\\n"), F.lit("\n")))


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_role: str = "assistant") -> DataFrame:
    """One row for each conversation: conv, formatted, and loss_spans (start, end in code points of formatted).

    Turns are sorted by turn, then role, then text (null turns first); adjacent turns of one role share a
    header and are joined by a separator that keeps them apart, so that reading gives every row back. Null
    roles and texts are empty. Loss spans cover the escaped texts of loss_role, one for each turn. Rows
    with a null conversation make one conversation; repeated rows are turns of their own; an empty table
    gives no rows; other columns are ignored.
    """
    rows = turns.select(
        F.col(conv).alias("conv"),
        F.struct(F.col(turn).alias("turn"), escape_role(F.coalesce(F.col(role), F.lit(""))).alias("role"), escape(F.coalesce(F.col(text), F.lit(""))).alias("text")).alias("t"),
    )
    chats = rows.groupBy("conv").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    role_at = lambda i: F.get(F.col("ts"), i)["role"]
    head = lambda t, i: F.when((i == 0) | (role_at(i - 1) != t["role"]), F.concat(F.lit(OPEN), t["role"], F.lit("\n"))).otherwise(F.lit(SEP))
    tail = lambda t, i: F.when((i == F.size("ts") - 1) | (role_at(i + 1) != t["role"]), F.lit(CLOSE)).otherwise(F.lit(""))
    parts = chats.select("conv", F.transform("ts", lambda t, i: F.struct(head(t, i).alias("head"), t["text"].alias("body"), tail(t, i).alias("tail"), (t["role"] == escape_role(F.lit(loss_role))).alias("loss"))).alias("ps"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))
    mark = lambda a, p: F.struct(
        (a["at"] + F.length(p["head"]) + F.length(p["body"]) + F.length(p["tail"])).alias("at"),
        F.when(p["loss"], F.concat(a["spans"], F.array(F.struct((a["at"] + F.length(p["head"])).alias("start"), (a["at"] + F.length(p["head"]) + F.length(p["body"])).alias("end"))))).otherwise(a["spans"]).alias("spans"),
    )
    return parts.select(
        F.col("conv").alias(conv),
        F.array_join(F.transform("ps", lambda p: F.concat(p["head"], p["body"], p["tail"])), "").alias("formatted"),
        F.aggregate("ps", start, mark, lambda a: a["spans"]).alias("loss_spans"),
    )


def read_chats(chats: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Reads formatted chats back: conv, turns (role, text in order) and loss_texts (under loss_spans), unescaped."""
    blocks = F.filter(F.split("formatted", r"<\|im_end\|>\n", -1), lambda b: b != "")
    turn = lambda b: F.transform(
        F.split(F.substr(b, F.locate("\n", b) + 1), r"<\|im_sep\|>", -1),
        lambda x: F.struct(unescape_role(F.substr(b, F.lit(len(OPEN) + 1), F.locate("\n", b) - len(OPEN) - 1)).alias("role"), unescape(x).alias("text")),
    )
    return chats.select(
        F.col(conv),
        F.flatten(F.transform(blocks, turn)).alias("turns"),
        F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int")))).alias("loss_texts"),
        F.col("formatted"),
    )
