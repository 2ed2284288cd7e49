"""Chat formatting of typed content parts, in DataFrame functions only.

A turn's content is an array of typed parts. The visitor `flatten_parts` maps
each part by its type: neighbouring texts are joined and escaped, image, audio
and document parts become ordered placeholders; it records the attachment references and the tokens that
the placeholders will expand to. Turns are framed by control strings:

    <|turn|>role<|text|>content<|end|>

Control strings inside texts get one backslash after their first character
(after any there already), which `unescape` takes out again, so formatting is
reversible whatever the texts say. A placeholder names its part's type only by
letters, digits and `_`, so no type can forge a control string; the recorded
attachment keeps the type as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
# What opens a control string here or in common templates.
_TAILS = r"(\||/?s>|/?INST\]|</?SYS>>)"
_ESCAPE = r"([<\[])(\\*)" + _TAILS
_UNESCAPE = r"([<\[])\\(\\*)" + _TAILS
# Tokens an attachment stands for when its part doesn't say.
DEFAULT_TOKENS = {"image": 256, "audio": 128, "document": 512}
PART_TYPE = "array<struct<type: string, text: string, ref: string, tokens: int>>"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, _ESCAPE, r"$1$2\\$3")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, _UNESCAPE, r"$1$2$3")


def text_part(text: Column) -> Column:
    """A plain text as a one-part content array."""
    none = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), none.cast("string").alias("ref"), none.cast("int").alias("tokens")))


def _tokens(part: Column) -> Column:
    default = F.coalesce(*[F.when(part["type"] == k, F.lit(v)) for k, v in DEFAULT_TOKENS.items()])
    return F.coalesce(part["tokens"], default, F.lit(0))


def flatten_parts(parts: Column) -> Column:
    """struct(text, attachments array<struct<index, type, ref, tokens>>,
    expanded_tokens) of a content array. Null parts or texts are empty; a part
    without a type is text; an attachment of unknown type is a placeholder of
    its own type name, other characters than letters, digits and `_` made `_`.

    Neighbouring texts are one text before they are escaped, so no cut through
    a control string can forge one."""
    parts = F.coalesce(parts.cast(PART_TYPE), F.array().cast(PART_TYPE))
    is_text = lambda p: F.coalesce(p["type"], F.lit("text")) == "text"
    attached = F.filter(F.transform(parts, lambda p, i: F.struct(i.alias("at"), p.alias("p"))), lambda x: ~is_text(x["p"]))
    attachments = F.transform(
        attached,
        lambda x, i: F.struct(
            (i + 1).alias("index"), x["p"]["type"].alias("type"), x["p"]["ref"].alias("ref"), _tokens(x["p"]).alias("tokens")
        ),
    )
    kind = lambda a: F.regexp_replace(a["type"], "[^A-Za-z0-9_]", "_")
    placeholders = F.transform(attachments, lambda a: F.concat(F.lit("<|"), kind(a), F.lit(":"), a["index"].cast("string"), F.lit("|>")))
    texts = F.transform(parts, lambda p: F.when(is_text(p), F.coalesce(p["text"], F.lit(""))).otherwise(F.lit("")))
    places = F.transform(attached, lambda x: x["at"])
    begins, ends = F.concat(F.array(F.lit(0)), F.transform(places, lambda at: at + 1)), F.concat(places, F.array(F.size(parts)))
    runs = F.zip_with(begins, ends, lambda b, e: escape(F.array_join(F.slice(texts, b + 1, e - b), "")))
    rest = F.zip_with(placeholders, F.slice(runs, F.lit(2), F.size(places)), lambda p, r: F.concat(p, r))
    text = F.concat(F.get(runs, F.lit(0)), F.array_join(rest, ""))
    total = F.aggregate(attachments, F.lit(0).cast("long"), lambda m, a: m + a["tokens"])
    return F.struct(text.alias("text"), attachments.alias("attachments"), total.alias("expanded_tokens"))


def format_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, parts) -> one row per conversation: formatted,
    loss_spans array<struct<start, length>> (code points of the formatted
    string that assistants said), attachments, expanded_tokens.

    Turns order by turn, a null one first, ties by role, then content. Null
    roles are empty; turns without a conv_id are one conversation; an empty
    table gives an empty result; other columns are not read. A conversation
    is one output value, so it has to fit a task."""
    flat = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), flatten_parts(F.col("parts")).alias("c"))
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT))
    flat = flat.withColumn("head", head).withColumn("piece", F.concat("head", F.col("c.text"), F.lit(END)))
    upto = F.sum(F.length("piece")).over(
        Window.partitionBy("conv_id").orderBy("turn", "role", "piece").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    placed = flat.withColumn("start", upto - F.length("piece"))
    said = F.when(
        (F.col("role") == "assistant") & (F.length("c.text") > 0),
        F.struct((F.col("start") + F.length("head")).cast("int").alias("start"), F.length("c.text").alias("length")),
    )
    turn = F.struct("start", "piece", said.alias("said"), F.col("c.attachments").alias("a"), F.col("c.expanded_tokens").alias("n"))
    whole = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    return whole.select(
        "conv_id",
        F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("formatted"),
        F.array_compact(F.transform("t", lambda x: x["said"])).alias("loss_spans"),
        F.flatten(F.transform("t", lambda x: x["a"])).alias("attachments"),
        F.aggregate("t", F.lit(0).cast("long"), lambda n, x: n + x["n"]).alias("expanded_tokens"),
    )


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation."""
    pieces = F.split(formatted, r"<\|end\|>")
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        sides = F.split(F.substring(piece, len(TURN) + 1, 2**31 - 1), r"<\|text\|>", 2)
        return F.struct(unescape(sides[0]).alias("role"), unescape(sides[1]).alias("text"))

    return F.transform(pieces, turn)


def masked_text(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped span by span."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")


def digest(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and
    formatted_chars, all read back from the formatted output; then
    n_attachments, expanded_tokens and attachments_sha256 (of type, ref and
    tokens by line) as the visitor recorded them."""
    turns = read_back(F.col("formatted"))
    recorded = lambda a: F.concat_ws(" ", a["type"], F.coalesce(a["ref"], F.lit("")), F.concat(a["tokens"].cast("string"), F.lit("\n")))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = formatted.withColumn("turns", turns).withColumn("loss", masked_text(F.col("formatted"), F.col("loss_spans")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.size("attachments").cast("long").alias("n_attachments"),
        "expanded_tokens",
        F.sha2(F.array_join(F.transform("attachments", recorded), ""), 256).alias("attachments_sha256"),
    )
