r"""Chat formatting with a grammar round trip, in DataFrame functions only.

Grammar of a conversation:  turn*  with  turn = "### " ROLE ": " TEXT "</turn>\n".
ROLE is System, User or Assistant, or "=" and a percent-coded other role. In TEXT a backslash takes
the next character literally. The parser is deterministic: it cuts at "</turn>\n", takes the role up
to the first ": ", and drops the backslashes of the rest.

A turn is first rendered as it is. The rendered conversation is parsed again and compared with the
source; turns with conflicting content get the next level of escaping, until the parse is identical:
level 0 nothing, level 1 backslashes and control strings, level 2 every character that control
strings are made of. Level 2 is always reversible, so the search ends; a failure would raise.

Defined cases: a null text or role is empty; equal turns of a conversation are ordered by role, then
text; repeated rows are all kept; a null conv_id is a conversation of its own; an empty table gives
an empty result; extra columns are ignored. A conversation is one output row, so its turns do meet in one task, and a
conversation must fit in a row: 2 GB of text at the very most, and some hundred MB in practice, by the executor's memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, SEP, CLOSE = "### ", ": ", "</turn>\n"
NAMED = {"system": "System", "user": "User", "assistant": "Assistant"}


def _role_out(role: Column) -> Column:
    coded = F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit(":"), F.lit("%3A")), F.lit("<"), F.lit("%3C"))
    out = F.concat(F.lit("="), coded)
    for plain, shown in NAMED.items():
        out = F.when(role == plain, F.lit(shown)).otherwise(out)
    return out


def _role_in(shown: Column) -> Column:
    plain = F.substring(shown, 2, 2**31 - 1)
    out = F.replace(F.replace(F.replace(plain, F.lit("%3C"), F.lit("<")), F.lit("%3A"), F.lit(":")), F.lit("%25"), F.lit("%"))
    for name, seen in NAMED.items():
        out = F.when(shown == seen, F.lit(name)).otherwise(out)
    return out


def escape(text: Column, level: int) -> Column:
    """Levels of escaping; each is undone by `unescape`."""
    if level == 0:
        return text
    if level == 1:
        out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
        return F.replace(F.replace(out, F.lit("###"), F.lit("\\###")), F.lit("</turn>"), F.lit("<\\/turn>"))
    return F.regexp_replace(text, r"([\\#</])", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _conflicts(text: Column) -> Column:
    """Whether plain text would not come back, or holds a control string."""
    return (unescape(text) != text) | text.endswith("\\") | text.contains("###") | text.contains("</turn>")


def render_turn(role: Column, text: Column, level: int) -> Column:
    return F.concat(F.lit(OPEN), _role_out(role), F.lit(SEP), escape(text, level), F.lit(CLOSE))


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> of a rendered conversation."""
    pieces = F.split(formatted, r"</turn>\n")

    def turn(piece: Column) -> Column:
        at = F.locate(SEP, piece)
        return F.struct(
            _role_in(F.substring(piece, F.lit(len(OPEN) + 1), at - F.lit(len(OPEN) + 1))).alias("role"),
            unescape(F.substring(piece, at + F.lit(len(SEP)), F.length(piece))).alias("text"),
        )

    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)


def loss_spans(formatted: Column, role: str = "assistant") -> Column:
    """array<struct<start, length>>, the loss mask: where in a rendered conversation the (escaped) texts of a role
    stand. `start` counts code points from 1."""
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    shown = f"{OPEN}{NAMED[role]}{SEP}"

    def step(a: Column, piece: Column) -> Column:
        span = F.struct((a["at"] + len(shown)).alias("start"), (F.length(piece) - len(shown)).alias("length"))
        spans = F.when(piece.startswith(shown), F.array_append(a["spans"], span)).otherwise(a["spans"])
        return F.struct((a["at"] + F.length(piece) + len(CLOSE)).alias("at"), spans.alias("spans"))

    return F.aggregate(F.split(formatted, CLOSE.replace("\n", "\\n")), start, step, lambda a: a["spans"])


def masked_text(formatted: Column, spans: Column) -> Column:
    """The text under a loss mask, unescaped, with nothing between the spans."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"], s["length"]))), "")


def format_chats(rows: DataFrame) -> DataFrame:
    """conv_id, formatted text, its loss mask, the parsed turns (role, text) and the source turns, one row a conversation."""
    turns = rows.select(
        F.col("conv_id").alias("conv_id"),
        F.col("turn").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    leveled = turns.withColumn(
        "shown",
        F.when(~_conflicts(F.col("text")), render_turn(F.col("role"), F.col("text"), 0))
        .when(unescape(escape(F.col("text"), 1)) == F.col("text"), render_turn(F.col("role"), F.col("text"), 1))
        .otherwise(render_turn(F.col("role"), F.col("text"), 2)),
    )
    whole = leveled.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "shown"))).alias("t"))
    shown = whole.select(
        "conv_id",
        F.array_join(F.col("t.shown"), "").alias("plain"),
        F.array_join(F.transform("t", lambda x: render_turn(x["role"], x["text"], 2)), "").alias("strict"),
        F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("source"),
    )
    parsed = shown.withColumn("formatted", F.when(parse(F.col("plain")) == F.col("source"), F.col("plain")).otherwise(F.col("strict"))).drop("plain", "strict")
    parsed = parsed.withColumn("turns", parse(F.col("formatted")))
    same = F.when(F.col("turns") == F.col("source"), F.col("turns")).otherwise(F.raise_error(F.lit("a conversation did not come back from its formatted text")))
    return parsed.select("conv_id", "formatted", loss_spans(F.col("formatted")).alias("loss_mask"), same.alias("turns"), "source")


def chat_digests(chats: DataFrame) -> DataFrame:
    """What is read back from the formatted text and its loss mask: counts and digests of turns and of the text under the mask."""
    read = chats.select("conv_id", "formatted", "loss_mask", parse(F.col("formatted")).alias("turns"))
    all_turns = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    read = read.select("conv_id", "formatted", "turns", all_turns.alias("all_turns"), masked_text(F.col("formatted"), F.col("loss_mask")).alias("loss"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode("all_turns", "UTF-8"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.encode("loss", "UTF-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
