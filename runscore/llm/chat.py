"""Chat formatting with Spark expressions only.

The turns of a conversation are collected and sorted; an array aggregation
merges adjacent turns of one role into a block, another one adds up where each
text begins, and the pieces of all blocks are concatenated:

    <|im_start|>role
    text<|im_turn|>text of the next turn of that role<|im_end|>

Inside roles and texts every backslash is doubled and "<|" becomes "<\\|", so no
text can write a control string and the original comes back exactly. A line end
inside a role becomes "<\\n>", which no escaped text contains. The loss mask is a
list of byte spans, one per assistant turn, without any control string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, TURN, END = "<|im_start|>", "<|im_turn|>", "<|im_end|>\n"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("<\\n>"))


def unescaped_role(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit("<\\n>"), F.lit("\n")))


_BLOCKS = "array<struct<role:string,texts:array<string>>>"
_SPANS = "struct<at:bigint,spans:array<struct<start:bigint,bytes:bigint>>>"


def merged_turns(turns: Column) -> Column:
    """Blocks (role, texts) of an ordered array of turns: adjacent turns of one role share a block."""

    def add(blocks: Column, turn: Column) -> Column:
        last = F.get(blocks, F.size(blocks) - 1)
        grown = F.struct(last["role"].alias("role"), F.concat(last["texts"], F.array(turn["text"])).alias("texts"))
        own = F.struct(turn["role"].alias("role"), F.array(turn["text"]).alias("texts"))
        same = F.coalesce(last["role"] == turn["role"], F.lit(False))
        kept = F.when(same, F.slice(blocks, 1, F.size(blocks) - 1)).otherwise(blocks)
        return F.concat(kept, F.array(F.when(same, grown).otherwise(own))).cast(_BLOCKS)

    return F.aggregate(turns, F.array().cast(_BLOCKS), add)


def block_pieces(block: Column, trained_role: str) -> Column:
    """One piece per text of a block: head, body, tail and whether it is trained on."""
    last = F.size(block["texts"]) - 1
    opening = F.concat(F.lit(START), escaped_role(block["role"]), F.lit("\n"))
    return F.transform(
        block["texts"],
        lambda text, i: F.struct(
            F.when(i == 0, opening).otherwise(F.lit(TURN)).alias("head"),
            escaped(text).alias("body"),
            F.when(i == last, F.lit(END)).otherwise(F.lit("")).alias("tail"),
            (block["role"] == trained_role).alias("trained"),
        ),
    )


def trained_spans(pieces: Column) -> Column:
    """Byte spans of the bodies that are trained on, in the joined pieces."""

    def add(done: Column, piece: Column) -> Column:
        begin = done["at"] + F.octet_length(piece["head"])
        body = F.octet_length(piece["body"]).cast("long")
        span = F.array(F.struct(begin.alias("start"), body.alias("bytes")))
        return F.struct(
            (begin + body + F.octet_length(piece["tail"])).alias("at"),
            F.when(piece["trained"], F.concat(done["spans"], span)).otherwise(done["spans"]).alias("spans"),
        ).cast(_SPANS)

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().alias("spans")).cast(_SPANS)
    return F.aggregate(pieces, start, add)["spans"]


def format_chats(conversations: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_spans(start, bytes) of every conversation.

    Turns are ordered by turn (null first), then role and text; repeated rows
    stay repeated. Null roles and texts count as empty; rows with null conv_id
    form one conversation. Other columns are not read. The turns of one
    conversation meet in one array, as its formatted text is one value.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            F.col("turn").cast("long").alias("turn"),
            F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        ).alias("said"),
    )
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("said")).alias("turns"))
    blocks = turns.select("conv_id", merged_turns(F.col("turns")).alias("blocks"))
    pieces = blocks.select(
        "conv_id", F.flatten(F.transform("blocks", lambda b: block_pieces(b, trained_role))).alias("pieces")
    )
    return pieces.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], p["tail"])), "").alias("formatted"),
        trained_spans(F.col("pieces")).alias("loss_spans"),
    )


def read_chats(formatted: DataFrame) -> DataFrame:
    """conv_id, turns(role, text) and the text under the loss mask, from format_chats output."""
    blocks = F.filter(F.split("formatted", r"<\|im_end\|>\n"), lambda b: b != "")
    parsed = formatted.withColumn(
        "blocks",
        F.transform(
            blocks,
            lambda b: F.struct(
                unescaped_role(F.substring_index(b.substr(F.lit(len(START) + 1), F.length(b)), "\n", 1)).alias("role"),
                F.split(b.substr(F.instr(b, "\n") + F.lit(1), F.length(b)), r"<\|im_turn\|>").alias("texts"),
            ),
        ),
    )
    return parsed.select(
        "conv_id",
        "formatted",
        F.flatten(
            F.transform(
                "blocks",
                lambda b: F.transform(
                    b["texts"], lambda t: F.struct(b["role"].alias("role"), unescaped(t).alias("text"))
                ),
            )
        ).alias("turns"),
        F.array_join(
            F.transform(
                "loss_spans",
                lambda s: unescaped(
                    F.substring(F.col("formatted").cast("binary"), s["start"].cast("int") + 1, s["bytes"].cast("int")).cast("string")
                ),
            ),
            "",
        ).alias("loss_text"),
    )


def chat_digests(formatted: DataFrame) -> DataFrame:
    """Digests of what read_chats gets back, per conversation."""
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read_chats(formatted).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
