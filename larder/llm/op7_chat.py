"""Chat formatting with typed content parts, by DataFrame functions only.

A turn is `<turn:ROLE>` + content + `</turn>`. Inside roles and contents `\\`, `<` and `>` are written
`\\b`, `\\l` and `\\g`, so every `<` of the output belongs to the template, whatever a text holds, and
the texts can be read back exactly. A visitor over a turn's parts renders text as itself and images,
audio and documents as numbered placeholders `<image:2>`, recording what is attached and how many
tokens each placeholder stands for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
KINDS = ("image", "audio", "document")
#: Tokens of an attachment: image per 28 x 28 patch, audio per second, document per page.
PATCH, PER_SECOND, PER_PAGE = 28, 25, 512


def escape(text: Column) -> Column:
    for plain, written in (("\\", "\\b"), ("<", "\\l"), (">", "\\g")):
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescape(text: Column) -> Column:
    for plain, written in ((">", "\\g"), ("<", "\\l"), ("\\", "\\b")):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def text_parts(text: Column) -> Column:
    """A plain text as a turn's only part; null counts as empty."""
    none = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), none.cast("string").alias("ref"), none.cast("int").alias("width"), none.cast("int").alias("height"), none.cast("double").alias("seconds"), none.cast("int").alias("pages")))


def part_tokens(p: Column) -> Column:
    """Expanded tokens of a part: words of a text, and the constants above for the other types."""
    patches = F.ceil(F.coalesce(p["width"], F.lit(0)) / PATCH) * F.ceil(F.coalesce(p["height"], F.lit(0)) / PATCH)
    return (
        F.when(p["type"] == "image", patches)
        .when(p["type"] == "audio", F.ceil(F.coalesce(p["seconds"], F.lit(0.0)) * PER_SECOND))
        .when(p["type"] == "document", F.coalesce(p["pages"], F.lit(0)) * PER_PAGE)
        .otherwise(F.coalesce(F.regexp_count(p["text"], F.lit(r"\S+")), F.lit(0)))
        .cast("long")
    )


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, spans, attachments, tokens, one row per conversation.

    turns: conv_id, turn, role, parts (array of PART). spans has one (turn, start, length) per assistant
    turn in order: code points of its content inside its own turn's text, and `at`, the same start
    inside formatted. attachments: (number, type, ref, tokens) in order of appearance.
    Null roles and texts count as empty, null parts as none; null turns come first; equal turn numbers
    go by role, then content; rows with a null conv_id are one conversation; unknown part types render
    as their text; further columns are left out; empty in, empty out. A conversation is one output string,
    so it must fit into a row.
    """
    is_attached = lambda p: F.coalesce(p["type"].isin(*KINDS), F.lit(False))
    parts = F.coalesce("parts", F.array().cast(f"array<{PART}>"))
    flat = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), parts.alias("parts"))
    flat = flat.withColumn("plain", F.array_join(F.transform("parts", lambda p: F.coalesce(p["text"], F.lit(""))), ""))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "plain", F.to_json("parts"))
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    flat = flat.withColumns(
        {
            "number": F.row_number().over(order),
            "seen": F.coalesce(F.sum(F.size(F.filter("parts", is_attached))).over(earlier), F.lit(0)),
        }
    )
    # Attachments before part i of this turn: those of the parts up to it.
    body = F.array_join(
        F.transform(
            "parts",
            lambda p, i: F.when(
                is_attached(p),
                F.concat(F.lit("<"), p["type"], F.lit(":"), (F.col("seen") + F.size(F.filter(F.slice("parts", 1, i + 1), is_attached))).cast("string"), F.lit(">")),
            ).otherwise(escape(F.coalesce(p["text"], F.lit("")))),
        ),
        "",
    )
    head = F.concat(F.lit("<turn:"), escape(F.col("role")), F.lit(">"))
    flat = flat.withColumns({"head": head, "body": body}).withColumn("written", F.concat("head", "body", F.lit("</turn>")))
    flat = flat.withColumn("before", F.coalesce(F.sum(F.length("written")).over(earlier), F.lit(0)))
    start = F.length("head")
    own = F.filter(F.transform("parts", lambda p, i: F.struct((F.col("seen") + F.size(F.filter(F.slice("parts", 1, i + 1), is_attached))).alias("number"), p["type"].alias("type"), p["ref"].alias("ref"), part_tokens(p).alias("tokens"))), lambda a: F.coalesce(a["type"].isin(*KINDS), F.lit(False)))
    tokens = F.aggregate(F.transform("parts", part_tokens), F.lit(0).cast("long"), lambda a, b: a + b)
    row = F.struct("number", "written", F.when(F.col("role") == "assistant", F.struct(F.col("number").alias("turn"), start.alias("start"), F.length("body").alias("length"), (F.col("before") + start).alias("at"))).alias("span"), own.alias("own"), tokens.alias("tokens"))
    gathered = flat.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    return gathered.select(
        "conv_id",
        F.array_join("rows.written", "").alias("formatted"),
        F.filter("rows.span", lambda s: s.isNotNull()).alias("spans"),
        F.flatten("rows.own").alias("attachments"),
        F.aggregate("rows.tokens", F.lit(0).cast("long"), lambda a, b: a + b).alias("tokens"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role, text), loss (assistant texts under the spans, in order) from formatted and spans alone."""
    segments = F.slice(F.split("formatted", "</turn>"), 1, F.greatest(F.size(F.split("formatted", "</turn>")) - 1, F.lit(0)))
    cut = formatted.withColumn("segments", segments)
    turn = lambda s: F.struct(
        unescape(F.substring_index(F.substring(s, 7, 2**31 - 1), ">", 1)).alias("role"),
        unescape(F.substr(s, F.locate(">", s) + 1)).alias("text"),
    )
    under = lambda s: unescape(F.substr(F.element_at("segments", s["turn"]), s["start"] + 1, s["length"]))
    return cut.select("conv_id", "formatted", F.transform("segments", turn).alias("turns"), F.transform("spans", under).alias("loss"))


def digest(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the output."""
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss", "")
    return read_back(formatted).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(told, "UTF-8"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(F.encode(loss, "UTF-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
