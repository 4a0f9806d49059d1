"""Cleaning: front matter, comments, recurring lines, reflow, paratext. All row-local.

A null text cleans to null; the empty text to the empty text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.fixed import PARATEXT
from plumbline.functions.text import LINE_BREAK, WHITE, bind, let, listed, strip

# Patterns of marks, and limits.
FRONT = r"(?s)^---\s*\n(.*?)\n---\s*\n"
COMMENT = r"(?s)<!--.*?-->"
NOTE = r"^\d{1,3}$"
LEAST_FREQUENCY, HEADER_CHARS, HEAD = 3, 80, 160


def front_language(text: Column) -> Column:
    """Language named in the front matter, or null."""
    found = F.regexp_extract(F.regexp_extract(text, FRONT, 1), r"(?m)^lingua:\s*(\w+)", 1)
    return F.nullif(found, F.lit(""))


def lines(text: Column) -> Column:
    """Lines; what follows a break at the end is none."""
    return let(F.split(text, LINE_BREAK), lambda x: F.when(F.element_at(x, -1) == "", F.slice(x, 1, F.size(x) - 1)).otherwise(x))


def recurring_lines(text: Column, least: int = LEAST_FREQUENCY) -> Column:
    """Sorted short lines that occur at least so often and end no sentence."""
    trimmed = F.filter(F.transform(lines(text), strip), lambda x: (x != "") & (F.length(x) < HEADER_CHARS) & ~x.rlike("[.!?]$"))
    # Sorted, equal lines stand together: a line recurs if it equals the one least - 1 places on.
    def repeated(ordered: Column) -> Column:
        each = F.zip_with(ordered, F.slice(ordered, least, F.size(ordered)), lambda x, later: F.when(x == later, x))
        return F.array_distinct(F.array_compact(each))

    return let(F.sort_array(trimmed), repeated)


def reflow(text: Column) -> Column:
    blocks = F.transform(F.split(text, rf"\n{WHITE}*\n"), lambda b: F.array_join(F.filter(F.transform(F.split(b, LINE_BREAK), strip), lambda x: x != ""), " "))
    return F.array_join(F.transform(F.filter(blocks, lambda b: b != ""), lambda b: F.regexp_replace(b, f"{WHITE}{{2,}}", " ")), "\n\n")


def clean(docs: DataFrame, reflowed: bool = True) -> DataFrame:
    """(doc_id, text, chars_before, chars_after, reduction_pct, front_lang, comments, frame_lines, headers)."""
    step = docs.select("doc_id", F.col("text").alias("raw"), F.regexp_replace("text", FRONT, "").alias("body"))
    # Lines are counted before comments go.
    step = step.select("doc_id", "raw", F.regexp_count("body", F.lit(COMMENT)).alias("comments"), recurring_lines(F.col("body")).alias("recurring"), lines(F.regexp_replace("body", COMMENT, "")).alias("lines"))
    step = step.withColumn("kept", F.filter("lines", lambda x: ~F.array_contains(F.col("recurring"), strip(x)) & ~strip(x).rlike(NOTE)))
    text = F.array_join("kept", "\n")
    text = strip(F.regexp_replace(reflow(text) if reflowed else text, r"\n{3,}", "\n\n"))
    out = step.withColumn("clean", text)
    before, after = F.length("raw"), F.length("clean")
    return out.select(
        "doc_id",
        F.col("clean").alias("text"),
        before.cast("long").alias("chars_before"),
        after.cast("long").alias("chars_after"),
        F.round(F.when(before > 0, 100.0 * (1 - after / before)).otherwise(0.0), 1).alias("reduction_pct"),
        front_language(F.col("raw")).alias("front_lang"),
        F.col("comments").cast("long").alias("comments"),
        (F.size("lines") - F.size("kept")).cast("long").alias("frame_lines"),
        F.slice("recurring", 1, 10).alias("headers"),
    )


def clean_chunk(text: Column, recurring: Column, reflowed: bool = True) -> Column:
    """A chunk without the lines that recur in its whole document (recurring) and without note numbers.

    Only whole lines go: a recurring line that packing has joined to the sentence before it stays.
    """
    stays = lambda x: let(strip(x), lambda bare: ~F.array_contains(recurring, bare) & ~bare.rlike(NOTE))
    kept = F.array_join(F.filter(lines(F.regexp_replace(text, COMMENT, "")), stays), "\n")
    return strip(F.regexp_replace(reflow(kept) if reflowed else kept, r"\n{3,}", "\n\n"))


def paratext(title: Column, text: Column) -> Column:
    """The first marker that the title holds or the text begins with, or null."""
    head = F.substring(strip(F.regexp_replace(F.lower(text), f"{WHITE}+", " ")), 1, HEAD)
    named = F.lower(F.coalesce(title, F.lit("")))
    # Both are told once, not once a marker.
    return bind(lambda named, head: F.get(F.filter(listed(PARATEXT), lambda m: F.contains(named, m) | F.startswith(head, m)), F.lit(0)), named, head)
