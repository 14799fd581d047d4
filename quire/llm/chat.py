"""Chat formatting with typed content parts.

A visitor flattens the parts of each turn, in order: text is escaped, an image, audio or document part becomes a
placeholder, and its reference and expanded token count are recorded. Turns are marked `<|im_start|>role`, a line end,
the content, `<|im_end|>` and a line end. In roles and texts a backslash is doubled, a `|` that follows `<` or starts a
part gets a backslash before it, and so does a line end in a role: no text can form a control string or placeholder,
also across parts, and one pass over `\\x` pairs undoes it.

A conversation's rows are ordered by (turn, role, parts), null turns first; repeated rows are turns of their own. Null
roles, texts and parts count as empty, parts of an unknown type as text. A part's size is in images, seconds or pages; a
null size counts as 1. Null conv_ids form one conversation. Turns are first joined in blocks of `BLOCK` turn numbers, so that
the rows of a hot conversation spread over tasks, and then blocks; a conversation itself is one string. Rows of a
conversation that all share a turn (or have none) are one block, and so one task's.
Columns besides conv_id, turn, role and text (or parts) are not read.

Only DataFrame operations are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
#: Tokens that a placeholder stands for: for each image, second or page.
RATES = {"image": 576.0, "audio": 25.0, "document": 800.0}
BLOCK = 64
PARTS = "array<struct<type: string, text: string, ref: string, size: double>>"
_ROLE = r"(?s)^([^\\\n]*+(?:\\.[^\\\n]*+)*+)\n"


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), r"(^|<)\|", r"$1\\|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def text_parts(text: str | Column = "text") -> Column:
    """A text alone, as parts."""
    c = F.col(text) if isinstance(text, str) else text
    return F.array(F.struct(F.lit("text").alias("type"), c.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("double").alias("size"))).cast(PARTS)


def _shown(part: Column) -> Column:
    out = escaped(F.coalesce(part["text"], F.lit("")))
    for kind, placeholder in PLACEHOLDERS.items():
        out = F.when(part["type"] == kind, F.lit(placeholder)).otherwise(out)
    return F.coalesce(out, F.lit(""))


def _attached(part: Column) -> Column:
    rate = F.lit(None).cast("double")
    for kind, r in RATES.items():
        rate = F.when(part["type"] == kind, F.lit(r)).otherwise(rate)
    return F.struct(part["type"].alias("type"), part["ref"].alias("ref"), F.ceil(rate * F.coalesce(part["size"], F.lit(1.0))).cast("long").alias("tokens"))


def format_conversations(turns: DataFrame, trained: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss, attachments, expanded_tokens of each conversation.

    turns: conv_id, turn, role and parts (or text). loss has for each turn the struct<start, length> under the loss mask,
    counted in code points behind its start mark, or null; attachments are in the order of their placeholders.
    """
    parts = F.col("parts").cast(PARTS) if "parts" in turns.columns else text_parts()
    parts = F.coalesce(parts, F.expr(f"cast(array() as {PARTS})"))
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), parts.alias("parts"))
    row = F.struct("turn", "role", "parts")
    block = F.floor(F.col("turn") / BLOCK)
    blocks = rows.groupBy("conv_id", block.alias("block")).agg(F.array_sort(F.collect_list(row)).alias("turns"))

    role = lambda t: F.regexp_replace(escaped(t["role"]), "\n", "\\\\\n")
    body = lambda t: F.array_join(F.transform(t["parts"], _shown), "")
    shown = F.transform("turns", lambda t: F.struct(role(t).alias("role"), body(t).alias("body"), (t["role"] == trained).alias("own")))
    blocks = blocks.select("conv_id", "block", "turns", shown.alias("shown"))
    text = F.array_join(F.transform("shown", lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"), t["body"], F.lit(END))), "")
    loss = F.transform("shown", lambda t: F.when(t["own"], F.struct((F.length(t["role"]) + 1).alias("start"), F.length(t["body"]).alias("length"))))
    attached = F.flatten(F.transform("turns", lambda t: F.transform(F.filter(t["parts"], lambda p: p["type"].isin(list(RATES))), _attached)))
    joined = blocks.select("conv_id", F.struct("block", text.alias("text"), loss.alias("loss"), attached.alias("attachments")).alias("b"))
    whole = joined.groupBy("conv_id").agg(F.array_sort(F.collect_list("b")).alias("b"))
    out = whole.select("conv_id", F.array_join(F.col("b.text"), "").alias("formatted"), F.flatten("b.loss").alias("loss"), F.flatten("b.attachments").alias("attachments"))
    return out.withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]))


def read_back(formatted: str | Column = "formatted") -> Column:
    """From a formatted conversation to its turns, array<struct<role, text, raw>>; raw is what stood behind the start mark."""
    c = F.col(formatted) if isinstance(formatted, str) else formatted
    raw = F.split(c, r"<\|im_start\|>")
    raw = F.slice(raw, 2, F.greatest(F.size(raw) - 1, F.lit(0)))
    head = lambda r: F.regexp_extract(r, _ROLE, 1)
    body = lambda r: F.substring(r, F.length(head(r)) + 2, F.length(r) - F.length(head(r)) - 1 - len(END))
    return F.transform(raw, lambda r: F.struct(unescaped(head(r)).alias("role"), unescaped(body(r)).alias("text"), r.alias("raw")))


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read back from the output."""
    rows = formatted.withColumn("turns", read_back())
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    under = F.zip_with("turns", "loss", lambda t, s: unescaped(F.coalesce(F.substring(t["raw"], s["start"] + 1, s["length"]), F.lit(""))))
    rows = rows.withColumn("under", F.array_join(under, ""))
    return rows.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(spoken, 256).alias("turns_sha256"), F.length("under").cast("long").alias("loss_chars"), F.sha2("under", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
