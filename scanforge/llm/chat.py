"""Chat formatting (operator 1), in DataFrame functions alone.

A message is an array of typed parts, struct<kind, text, ref, units>: kind is text, image, audio or
document; units are an attachment's patches, audio frames or pages. A visitor flattens them: texts
are escaped, attachments become ordered placeholders, and their references and expanded token counts
are recorded. format_chat wraps each turn in control strings, and keeps a loss mask.

Escaping is reversible: inside a control string found in a text, the run of backslashes after its
first character gets one more, so `</s>` becomes `<\\/s>` and `<\\/s>` becomes `<\\\\/s>`; unescaping
takes one off. No escaped text holds a control string, so the output splits back exactly.

A conversation may hold a third of all rows: turns are formatted row by row, joined in chunks of
CHUNK turn numbers, and only the chunks of a conversation meet in one group, whose one string is
the result. Turns come in order of turn, ties by role and text; null turns come first; null texts
and roles are empty; repeated rows count each time; null conv_ids are one conversation. Empty
tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, ROLE_OPEN, ROLE_CLOSE = "<s>", "</s>", "[ROLE]", "[/ROLE]"
PLACEHOLDERS = {"image": "[IMAGE]", "audio": "[AUDIO]", "document": "[DOCUMENT]"}
#: Tokens for each unit of an attachment: patches, frames, pages.
UNIT_TOKENS = {"image": 1, "audio": 1, "document": 256}
#: Whole control strings, in two halves: the first character, then the rest.
_ANGLE, _SQUARE = r"/?s>", r"(?:/?INST|/?ROLE|IMAGE|AUDIO|DOCUMENT)\]"
CHUNK = 256
LOSS_ROLE = "assistant"
PART = "struct<kind:string,text:string,ref:string,units:long>"
BACKSLASH = "\\"


def escape(text: Column) -> Column:
    text = F.regexp_replace(text, rf"<(\\*)({_ANGLE})", r"<\\$1$2")
    return F.regexp_replace(text, rf"\[(\\*)({_SQUARE})", r"[\\$1$2")


def unescape(text: Column) -> Column:
    text = F.regexp_replace(text, rf"<\\(\\*)({_ANGLE})", r"<$1$2")
    return F.regexp_replace(text, rf"\[\\(\\*)({_SQUARE})", r"[$1$2")


def text_parts(text: Column) -> Column:
    """A plain message as parts."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("units")))


def flatten_parts(parts: Column) -> Column:
    """struct<text, attachments array<struct<kind, ref, tokens>>>: attachments stand in the order of their placeholders.

    Null parts and messages are empty; an unknown kind counts as text.
    """
    parts = F.coalesce(parts, F.array().cast(f"array<{PART}>"))
    placeholder, tokens = F.lit(None).cast("string"), F.lit(0).cast("long")
    for kind, mark in PLACEHOLDERS.items():
        placeholder = lambda p, kind=kind, mark=mark, rest=placeholder: F.when(p["kind"] == kind, F.lit(mark)).otherwise(rest(p) if callable(rest) else rest)
        tokens = lambda p, kind=kind, rest=tokens: F.when(p["kind"] == kind, F.coalesce(p["units"], F.lit(1)) * UNIT_TOKENS[kind]).otherwise(rest(p) if callable(rest) else rest)
    text = F.array_join(F.transform(parts, lambda p: F.coalesce(placeholder(p), escape(F.coalesce(p["text"], F.lit(""))), F.lit(""))), "")
    attached = F.transform(F.filter(parts, lambda p: placeholder(p).isNotNull()), lambda p: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), tokens(p).alias("tokens")))
    return F.struct(text.alias("text"), attached.alias("attachments"))


def format_chat(turns: DataFrame, parts: Column | None = None, loss_role: str = LOSS_ROLE) -> DataFrame:
    """A row per conversation: formatted, n_turns, spans, attachments.

    spans has an entry for each turn: where its text stands within the turn's string (offset, length)
    and whether it is under the loss mask. Token counts of attachments are those of the expansion.
    """
    message = flatten_parts(text_parts(F.col("text")) if parts is None else parts)
    t = turns.select(F.col("conv_id").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), message.alias("m"))
    t = t.withColumn("said", unescape(F.col("m.text")))
    head = F.concat(F.lit(OPEN + ROLE_OPEN), escape(F.col("role")), F.lit(ROLE_CLOSE))
    t = t.select(
        "conv_id", "turn", "role", F.floor(F.coalesce("turn", F.lit(-(1 << 62))) / CHUNK).cast("long").alias("chunk"), "said",
        F.concat(head, F.col("m.text"), F.lit(CLOSE)).alias("line"), F.col("m.attachments").alias("attached"),
        F.struct(F.char_length(head).cast("long").alias("offset"), F.char_length("m.text").cast("long").alias("length"), (F.col("role") == loss_role).alias("loss")).alias("span"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "said", "line", "span", "attached")))
    chunks = t.groupBy("conv_id", "chunk").agg(ordered.alias("rows")).select(
        "conv_id", "chunk", F.array_join(F.transform("rows", lambda r: r["line"]), "").alias("part"), F.size("rows").cast("long").alias("n"),
        F.transform("rows", lambda r: r["span"]).alias("spans"), F.flatten(F.transform("rows", lambda r: r["attached"])).alias("attached"),
    )
    whole = F.array_sort(F.collect_list(F.struct("chunk", "part", "n", "spans", "attached")))
    return chunks.groupBy("conv_id").agg(whole.alias("c")).select(
        "conv_id", F.array_join(F.transform("c", lambda x: x["part"]), "").alias("formatted"), F.aggregate("c", F.lit(0).cast("long"), lambda s, x: s + x["n"]).alias("n_turns"),
        F.flatten(F.transform("c", lambda x: x["spans"])).alias("spans"), F.flatten(F.transform("c", lambda x: x["attached"])).alias("attachments"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """format_chat's rows with turns array<struct<role, text>> and loss_text, both parsed from formatted."""
    lines = F.filter(F.split("formatted", CLOSE), lambda x: x != "")
    # Each turn is zipped with its span, so that no lambda looks into the whole string again.
    zipped = F.arrays_zip(lines.alias("line"), F.col("spans").alias("span"))
    f = formatted.withColumn("_turns", zipped)
    role = lambda x: unescape(F.substring_index(F.substring(x["line"], len(OPEN + ROLE_OPEN) + 1, 1 << 30), ROLE_CLOSE, 1))
    text = lambda x: unescape(F.substring(x["line"], x["span"]["offset"].cast("int") + 1, x["span"]["length"].cast("int")))
    body = lambda x: unescape(F.substring(x["line"], F.locate(ROLE_CLOSE, x["line"]) + len(ROLE_CLOSE), F.lit(1 << 30)))
    return f.select(
        *formatted.columns, F.transform("_turns", lambda x: F.struct(role(x).alias("role"), body(x).alias("text"))).alias("turns"),
        F.array_join(F.transform(F.filter("_turns", lambda x: x["span"]["loss"]), text), "").alias("loss_text"),
    )
