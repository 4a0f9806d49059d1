r"""Chat formatting from event logs, in DataFrame functions only.

Events (conv_id, seq, message, kind, role, text) are folded by conversation and message in sequence
order: "message" opens a message with a text, "delta" adds to it, "edit" replaces it, "regenerate"
clears it for the deltas that follow. The final messages, in message order, are rendered as

    <s><|turn|>ROLE<|text|>TEXT<|end|>...</s>

Roles and texts are escaped: a backslash is doubled, and after the first character of a control
string (<|, <s>, </s>, [INST], [/INST], <<SYS>>, <</SYS>>) a backslash is put. That is undone from
the left. The loss mask covers the text of assistant turns.

A log's messages are folded each on its own; a conversation's messages meet when it is rendered, as a
rendered conversation is one value and must fit in a row.

Defined results: null texts and roles are empty; a null kind counts as "message"; events with the
same place are ordered by kind, role and text; a message whose events are all cleared stays, empty;
rows without conv_id are one conversation; texts of any length are kept whole; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The template's control strings.
START, TURN, TEXT, END, STOP = "<s>", "<|turn|>", "<|text|>", "<|end|>", "</s>"
RESETS = ("message", "edit", "regenerate")
ASSISTANT = "assistant"

_ESCAPE = r"(\\|<(?=\||/?s>|</?SYS>>)|\[(?=/?INST\]))"
_UNESCAPE = r"(\\|<|\[)\\"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPE, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, "$1")


def events_of_turns(turns: DataFrame) -> DataFrame:
    """The log of a table with a row a turn (conv_id, turn, role, text), as a client streams it.

    A turn opens as a draft. An assistant's streams one answer, is regenerated, and streams its text
    in two halves; any other streams a word too many and is then edited to the first half of its
    text, to which a delta adds the rest. Folding gives the turns back. Rows with the same turn stay
    apart, in order of role and text; so a conversation's turns are numbered in one sorted group.
    """
    place = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = rows.select("conv_id", F.row_number().over(place).cast("long").alias("message"), "role", F.coalesce("text", F.lit("")).alias("text"))
    half = F.floor(F.length("text") / 2).cast("int")
    first, rest = F.substring(F.col("text"), F.lit(1), half), F.substring(F.col("text"), half + 1, F.length("text"))
    nothing = F.lit(None).cast("string")

    def log(*events: tuple[str, Column, Column]) -> Column:
        return F.array(*[F.struct(F.lit(k).alias("step"), F.lit(kind).alias("kind"), role.alias("role"), text.alias("text")) for k, (kind, role, text) in enumerate(events)])

    answer = log(("message", F.col("role"), F.lit("")), ("delta", nothing, F.lit("draft ")), ("regenerate", nothing, nothing), ("delta", nothing, first), ("delta", nothing, rest))
    remark = log(("message", F.col("role"), F.lit("draft")), ("delta", nothing, F.lit(" word")), ("edit", nothing, first), ("delta", nothing, rest))
    each = rows.select("conv_id", "message", F.inline(F.when(F.col("role") == ASSISTANT, answer).otherwise(remark)))
    return each.select("conv_id", (F.col("message") * 8 + F.col("step")).alias("seq"), "message", "kind", "role", "text")


def messages(events: DataFrame) -> DataFrame:
    """(conv_id, message, role, text): each message as its events leave it."""
    kind = F.coalesce("kind", F.lit("message"))
    event = F.struct("seq", kind.alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    log = events.groupBy("conv_id", "message").agg(F.sort_array(F.collect_list(event)).alias("log"), F.max(F.when(kind.isin(*RESETS), F.col("seq"))).alias("reset"))
    live = F.filter("log", lambda e: F.col("reset").isNull() | (e["seq"] >= F.col("reset")))
    role = F.aggregate("log", F.lit(""), lambda a, e: F.when(e["role"] != "", e["role"]).otherwise(a))
    return log.select("conv_id", "message", role.alias("role"), F.array_join(F.transform(live, lambda e: e["text"]), "").alias("text"))


def render(final: DataFrame) -> DataFrame:
    """(conv_id, formatted): one string a conversation."""
    turns = final.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("message", "role", "text"))).alias("turns"))
    shown = F.transform("turns", lambda t: F.concat(F.lit(TURN), escape(t["role"]), F.lit(TEXT), escape(t["text"]), F.lit(END)))
    return turns.select("conv_id", F.concat(F.lit(START), F.array_join(shown, ""), F.lit(STOP)).alias("formatted"))


def format_conversations(events: DataFrame) -> DataFrame:
    return render(messages(events))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns array of (role, text)) parsed from the formatted strings alone."""
    body = F.expr(f"substring(formatted, {len(START) + 1}, length(formatted) - {len(START) + len(STOP)})")
    parts = F.filter(F.split(body, r"<\|end\|>"), lambda p: p.startswith(TURN))
    fields = F.transform(parts, lambda p: F.split(F.substring(p, len(TURN) + 1, 2147483647), r"<\|text\|>", 2))
    turns = F.transform(fields, lambda f: F.struct(unescape(f[0]).alias("role"), unescape(f[1]).alias("text")))
    return formatted.select("conv_id", "formatted", turns.alias("turns"))


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted strings hold, read back: turns, text under the loss mask, and lengths."""
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    back = read_back(formatted).select("conv_id", "formatted", F.size("turns").cast("long").alias("n_turns"), told.alias("told"), F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == ASSISTANT), lambda t: t["text"]), "").alias("loss"))
    return back.select(
        "conv_id",
        "n_turns",
        F.sha2(F.col("told").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
