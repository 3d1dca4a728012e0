"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs, sorted, and merged into blocks
of adjacent turns of one role; blocks are concatenated into one string.  The
template marks blocks as

    <s>[ROLE] role\\n text <+> text </s>

where <+> parts merged turns.  Texts and roles are escaped reversibly: the
backslash, '<', '[' and the line end become a backslash and a letter, so no
control string inside a text stays one, and reading back is exact.

The loss mask is an array of (start, end), code points of the formatted string:
the escaped text of each assistant turn, without marks.

Defined cases: null or absent text is empty; null role is empty and like any
other role; turns order by (turn, role, text), null turn first; repeated rows
are turns of their own; a null conv_id is a conversation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import let, running, whole

OPEN, ROLE_END, JOIN, CLOSE = "<s>[ROLE] ", "\n", "<+>", "</s>"
#: The role whose texts are under the loss mask; code points of a chunk.
LEARNT, CHUNK = "assistant", 4096
#: Escaped text has no '<', so each of these is a mark.
_BLOCK, _TURN = r"</s>", r"<\+>"


def escape(x: F.Column) -> F.Column:
    return F.replace(F.replace(F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\l")), F.lit("["), F.lit("\\b")), F.lit("\n"), F.lit("\\n"))


def unescape(x: F.Column) -> F.Column:
    """Inverse of escape().

    \\x01 stands for the text's backslashes meanwhile; a \\x01 of the text is
    held as \\1, which no escaped text has.
    """
    held = F.replace(F.replace(x, F.lit("\x01"), F.lit("\\1")), F.lit("\\\\"), F.lit("\x01"))
    for a, b in (("\\l", "<"), ("\\b", "["), ("\\n", "\n")):
        held = F.replace(held, F.lit(a), F.lit(b))
    parts = F.transform(F.split(held, "\x01", -1), lambda p: F.replace(p, F.lit("\\1"), F.lit("\x01")))
    return F.array_join(parts, "\\")


def blocks(sorted_turns: DataFrame) -> DataFrame:
    """(conv_id, b) from (conv_id, t): array<struct<role, texts>> of adjacent turns of one role, from sorted turn structs.

    Blocks are cut out between the places where the role changes, so the work follows the number of turns.  The places
    are a column of their own: inside the second step they would be found anew for each block.
    """
    t, starts, n = F.col("t"), F.col("starts"), F.size("t")
    changes = F.transform(t, lambda x, i: F.when((i == 0) | (F.get(t, i - 1)["role"] != x["role"]), i))
    placed = sorted_turns.select("conv_id", "t", F.array_compact(changes).alias("starts"))

    def cut(start: F.Column, k: F.Column) -> F.Column:
        texts = F.transform(F.slice(t, start + 1, F.coalesce(F.get(starts, k + 1), n) - start), lambda x: x["text"])
        return F.struct(F.get(t, start)["role"].alias("role"), texts.alias("texts"))

    return placed.select("conv_id", F.transform(starts, cut).alias("b"))


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_mask: one string for each conversation of (conv_id, turn, role, text), and the spans to learn from."""
    row = F.struct(F.col("turn").alias("turn"), whole("role").alias("role"), whole("text").alias("text"))
    merged = blocks(turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("t")))
    held = merged.select("conv_id", F.transform("b", lambda b: F.struct((b["role"] == LEARNT).alias("learnt"), F.concat(F.lit(OPEN), escape(b["role"]), F.lit(ROLE_END)).alias("head"), F.transform(b["texts"], escape).alias("texts"))).alias("b"))
    block = lambda b: F.concat(b["head"], F.array_join(b["texts"], JOIN), F.lit(CLOSE))
    # For each turn what lies before it (a head or a joint), its length, and what closes its block.
    long_ = lambda x: F.char_length(x).cast("long")
    parts = F.flatten(F.transform("b", lambda b: F.transform(b["texts"], lambda t, i: F.struct(b["learnt"].alias("learnt"), F.when(i == 0, long_(b["head"])).otherwise(len(JOIN)).alias("lead"), long_(t).alias("size"), F.when(i == F.size(b["texts"]) - 1, len(CLOSE)).otherwise(0).alias("tail")))))

    def spans(p: F.Column) -> F.Column:
        before = running(F.transform(p, lambda x: x["lead"] + x["size"] + x["tail"]))
        every = F.zip_with(p, before, lambda x, a: F.struct(x["learnt"].alias("learnt"), (a + x["lead"]).alias("start"), (a + x["lead"] + x["size"]).alias("end")))
        return F.transform(F.filter(every, lambda x: x["learnt"]), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))

    return held.select("conv_id", F.array_join(F.transform("b", block), "").alias("formatted"), let(parts, spans).alias("loss_mask"))


def under(mask: F.Column, formatted: F.Column) -> F.Column:
    """array<string> of what the spans cut from the formatted string, unescaped.

    Spark finds a code point by counting from the string's start, so cuts are made in chunks.
    """
    chunks = F.regexp_extract_all(formatted, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))

    def cut(c: F.Column, s: F.Column) -> F.Column:
        first, last = F.floor(s["start"] / CHUNK), F.floor(s["end"] / CHUNK)
        near = F.array_join(F.slice(c, (first + 1).cast("int"), (last - first + 1).cast("int")), "")
        return unescape(F.substring(near, (s["start"] - first * CHUNK + 1).cast("int"), (s["end"] - s["start"]).cast("int")))

    return let(chunks, lambda c: F.transform(mask, lambda s: cut(c, s)))


def read_back(formatted: F.Column) -> F.Column:
    """array<struct<role, texts>> of a formatted string: the inverse of the template."""
    cut = F.filter(F.split(formatted, _BLOCK, -1), lambda b: b != "")

    def parse(b: F.Column) -> F.Column:
        inner = F.substring(b, len(OPEN) + 1, 2**31 - 1)
        role = F.substring_index(inner, ROLE_END, 1)
        body = F.substring(inner, F.char_length(role) + len(ROLE_END) + 1, F.lit(2**31 - 1))
        return F.struct(unescape(role).alias("role"), F.transform(F.split(body, _TURN, -1), unescape).alias("texts"))

    return F.transform(cut, parse)


def digests(chats: DataFrame) -> DataFrame:
    """What the formatted strings say, read back from them."""
    masked = F.array_join(under(F.col("loss_mask"), F.col("formatted")), "")
    read = chats.select("conv_id", "formatted", masked.alias("loss"), read_back(F.col("formatted")).alias("b"))
    turns = F.flatten(F.transform("b", lambda b: F.transform(b["texts"], lambda t: F.struct(b["role"].alias("role"), t.alias("text")))))
    read = read.select("conv_id", "formatted", "loss", F.size("b").cast("long").alias("n_blocks"), turns.alias("t"))
    every = F.array_join(F.transform("t", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("t").cast("long").alias("n_turns"),
        "n_blocks",
        F.sha2(every.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
