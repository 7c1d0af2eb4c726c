"""Chat formatting with typed content parts.

A turn is a list of parts ``struct<type, text, ref, units>``.  A visitor (one
``transform`` over the parts) flattens them in order: text is escaped, an
image, audio or document part becomes its placeholder string.  Attachments are
recorded in the order of their placeholders with the number of tokens that the
placeholder stands for (``units`` times the rate of the type, at least one).

Template::

    <s>role[SEP][INST]text[/INST]</s>        every role but the assistant
    <s>assistant[SEP]text</s>                under the loss mask

A backslash in a text is doubled and every control string of the template gets
a backslash after its first character, so no text holds a control string and
one regular expression takes the escapes back.

Conversations are gathered by ``conv_id`` with one shuffle; a conversation is
one output string, so it is in one task by its nature, conversations are not.

Defined cases: null text and null role are empty strings; a part of unknown
type counts as text; turns are ordered by ``turn`` (null first), role, text, and
repeated turns are all kept; null ``conv_id`` is a conversation of its own; an
empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PLACEHOLDERS = {"image": "[IMAGE]", "audio": "[AUDIO]", "document": "[DOCUMENT]"}
#: tokens for each unit of an attachment: a tile, a second, a page
TOKENS_PER_UNIT = {"image": 256, "audio": 25, "document": 512}
CONTROL = r"(<)(/?s>)|(\[)(/?INST\]|SEP\]|IMAGE\]|AUDIO\]|DOCUMENT\])"
PART = "struct<type:string,text:string,ref:string,units:bigint>"


def escape(text: Column) -> Column:
    doubled = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, CONTROL, r"$1$3\\$2$4")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def text_parts(text: Column) -> Column:
    """A plain text as a list of one text part."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"),
                            F.lit(None).cast("bigint").alias("units"))).cast(f"array<{PART}>")


def flatten_parts(parts: Column) -> Column:
    """The visitor: parts in order as one escaped string."""

    def visit(p: Column) -> Column:
        out = escape(p["text"])
        for kind, mark in PLACEHOLDERS.items():
            out = F.when(p["type"] == kind, F.lit(mark)).otherwise(out)
        return out

    return F.array_join(F.transform(F.coalesce(parts, F.array().cast(f"array<{PART}>")), visit), "")


def attachments(turn: Column, parts: Column) -> Column:
    """Type, reference and expanded tokens of every part that has a placeholder."""
    found = F.filter(parts, lambda p: p["type"].isin(list(PLACEHOLDERS)))

    def record(p: Column) -> Column:
        rate = F.lit(0)
        for kind, n in TOKENS_PER_UNIT.items():
            rate = F.when(p["type"] == kind, F.lit(n)).otherwise(rate)
        return F.struct(turn.alias("turn"), p["type"].alias("type"), p["ref"].alias("ref"),
                        (rate * F.greatest(F.coalesce(p["units"], F.lit(1)), F.lit(1))).cast("bigint").alias("n_tokens"))

    return F.transform(F.coalesce(found, F.array().cast(f"array<{PART}>")), record)


def format_conversations(turns: DataFrame) -> DataFrame:
    """``turns(conv_id, turn, role, parts)`` to one row per conversation:
    ``conv_id, formatted, turns array<struct<start, chars, loss>>, attachments,
    expanded_tokens``; start and chars count code points of ``formatted``."""
    role = F.coalesce(F.col("role"), F.lit(""))
    loss = role == "assistant"
    body = flatten_parts(F.col("parts"))
    rows = (
        turns.select("conv_id", "turn", "role", "parts")
        .select("conv_id", "turn", loss.alias("loss"), escape(role).alias("who"), body.alias("body"),
                attachments(F.col("turn"), F.col("parts")).alias("files"))
        .withColumn("head", F.concat(F.lit("<s>"), "who", F.when(F.col("loss"), "[SEP]").otherwise("[SEP][INST]")))
        .withColumn("tail", F.when(F.col("loss"), "</s>").otherwise("[/INST]</s>"))
        .withColumn("chars", F.length("body"))
        .withColumn("size", F.length("head") + F.col("chars") + F.length("tail"))
    )
    before = Window.partitionBy("conv_id").orderBy("turn", "who", "body").rowsBetween(Window.unboundedPreceding, -1)
    row = F.struct("at", F.concat("head", "body", "tail").alias("string"),
                   F.struct((F.col("at") + F.length("head")).alias("start"), "chars", "loss").alias("map"), "files", "turn")
    gathered = (
        rows.withColumn("at", F.coalesce(F.sum("size").over(before), F.lit(0)))
        .groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    )
    return gathered.select(
        "conv_id",
        F.array_join(F.col("rows.string"), "").alias("formatted"),
        F.col("rows.map").alias("turns"),
        F.flatten("rows.files").alias("attachments"),
    ).withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("bigint"), lambda a, x: a + x["n_tokens"]))


def parse_conversations(formatted: DataFrame) -> DataFrame:
    """Read formatted strings back: adds ``parsed array<struct<role, text,
    loss>>`` with escapes taken back.  Raises where the turn map and the string
    disagree.  Placeholders stay as they are."""

    def read(segment: Column, i: Column) -> Column:
        inner = F.substring(segment, 4, 2_000_000_000)
        who = F.substring_index(inner, "[SEP]", 1)
        rest = F.substr(inner, F.length(who) + 6)
        framed = rest.startswith("[INST]")
        text = F.when(framed, F.substr(rest, F.lit(7), F.length(rest) - 13)).otherwise(rest)
        span = F.get(F.col("turns"), i)
        return F.struct(unescape(who).alias("role"), unescape(text).alias("text"),
                        F.when(F.length(text) == span["chars"], span["loss"])
                        .otherwise(F.raise_error(F.lit("turn map and formatted string disagree")).cast("boolean"))
                        .alias("loss"))

    segments = F.filter(F.split("formatted", "</s>"), lambda s: s != "")
    return formatted.withColumn("parsed", F.transform(segments, read))
