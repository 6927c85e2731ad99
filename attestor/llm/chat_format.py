"""Conversations of typed content parts as one training text each, with a loss mask and attachment references.

The template opens a turn with <|turn:ROLE|> and closes it with <|end|>; attachments become <|image|>, <|audio|> or
<|document|>. Every control string starts with "<", and texts and roles never hold a bare "<": "&", "<" and "["
are written as entities (so the marks of other templates cannot occur either), and a role's "|" is too. The reverse
replacement gives the text back exactly. All of it is Column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, NAMED, CLOSE = "<|turn:", "|>", "<|end|>"
#: Replaced in this order, and put back in the opposite order.
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lbr;"), ("|", "&bar;"))
#: Fields of a content part that matter here.
PART = "struct<type:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>"


def escape(text: Column, role: bool = False) -> Column:
    for plain, entity in ENTITIES[: 4 if role else 3]:
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def unescape(text: Column) -> Column:
    for plain, entity in reversed(ENTITIES):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def text_part(text: Column) -> Column:
    """An array of one text part."""
    names = [f.split(":")[0] for f in PART[7:-1].split(",")]
    made = F.struct(*(F.lit("text").alias(n) if n == "type" else text.alias(n) if n == "text" else F.lit(None).alias(n) for n in names))
    return F.array(made.cast(PART))


def part_tokens(part: Column, patch: int, rate: float, page: int) -> Column:
    """The tokens that an attachment's placeholder expands to; at least one, and one where its size is unknown."""
    kind = part["type"]
    image = F.ceil(part["width"] / F.lit(patch)) * F.ceil(part["height"] / F.lit(patch))
    tokens = F.when(kind == "image", image).when(kind == "audio", F.ceil(part["seconds"] * F.lit(rate))).when(kind == "document", part["pages"].cast("long") * F.lit(page))
    return F.greatest(F.coalesce(tokens.cast("long"), F.lit(1)), F.lit(1)).cast("long")


def visit(part: Column) -> Column:
    """What a part becomes in the text. A null type is text; an unknown type is an attachment of that type."""
    known = part["type"].isin("image", "audio", "document")
    mark = F.concat(F.lit("<|"), F.when(known, part["type"]).otherwise("other"), F.lit("|>"))
    return F.when(is_text(part), F.coalesce(escape(part["text"]), F.lit(""))).otherwise(mark)


def is_text(part: Column) -> Column:
    return F.coalesce(part["type"], F.lit("text")) == "text"


def format_conversations(rows: DataFrame, learned: tuple[str, ...] = ("assistant",), patch: int = 14, rate: float = 25.0, page: int = 512) -> DataFrame:
    """Formats rows (conv_id, turn, role, parts array of PART) into one row for each conv_id.

    Returns conv_id, n_turns, segments (array of text, loss: their texts joined are the formatted text, and loss is the
    mask over each), formatted, attachments (array of turn, part, type, uri, tokens; the k-th belongs to the k-th
    placeholder) and attachment_tokens (their sum). Turns are ordered by turn, then role, then content, nulls first, so
    ties and repeated rows have one result. A null role counts as empty, null parts as no content; a null conv_id is a
    conversation of its own. Other columns are ignored. The formatted text of a conversation is one value by nature;
    everything before it is done row by row ahead of the shuffle.
    """
    part = F.col("parts")
    attached = F.filter(F.transform(part, lambda p, i: F.struct(F.col("turn").alias("turn"), i.alias("part"), p["type"].alias("type"), p["uri"].alias("uri"), F.when(~is_text(p), part_tokens(p, patch, rate, page)).alias("tokens"))), lambda a: a["tokens"].isNotNull())
    one = rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.array_join(F.transform(part, visit), ""), F.lit("")).alias("body"), F.coalesce(attached, F.array().cast("array<struct<turn:bigint,part:int,type:string,uri:string,tokens:bigint>>")).alias("attached"),
    )
    turns = one.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "body", "attached"))).alias("turns"))
    segments = F.flatten(F.transform("turns", lambda t: F.array(
        F.struct(F.concat(F.lit(OPEN), escape(t["role"], True), F.lit(NAMED)).alias("text"), F.lit(False).alias("loss")),
        F.struct(t["body"].alias("text"), t["role"].isin(*learned).alias("loss")),
        F.struct(F.lit(CLOSE).alias("text"), F.lit(False).alias("loss")),
    )))
    out = turns.select("conv_id", F.size("turns").cast("long").alias("n_turns"), segments.alias("segments"), F.flatten("turns.attached").alias("attachments"))
    return out.select("*", F.array_join("segments.text", "").alias("formatted"), F.aggregate("attachments.tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("attachment_tokens"))


def turns_of(formatted: Column) -> Column:
    """Reads role and text of each turn back from a formatted text without attachments."""
    pieces = F.filter(F.split(formatted, r"<\|turn:"), lambda _, i: i > 0)
    return F.transform(pieces, lambda p: F.struct(unescape(F.substring_index(p, NAMED, 1)).alias("role"), unescape(F.regexp_replace(F.regexp_replace(p, r"^[^|]*\|>", ""), r"<\|end\|>$", "")).alias("text")))


def learned_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return unescape(F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: s["text"]), ""))
