"""Markdown reports as column expressions: rendered where the rows are, never on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.fixed import WEIGHTS
from plumbline.operators.document import mean_score
from plumbline.operators.score import band, message, scored


def bar(x: Column, width: int = 20) -> Column:
    """A bar of filled and empty blocks; empty for null."""
    full = F.greatest(F.lit(0), F.least(F.lit(width), F.round(x * width).cast("int")))
    return F.when(x.isNull(), "").otherwise(F.rpad(F.repeat(F.lit("█"), full), width, "░"))


def components_list() -> Column:
    """A line of each component: its bar, its value, its name; those without a value are named at the end."""
    lines = [F.when(F.col(k).isNotNull(), F.concat(F.lit("    "), bar(F.col(k)), F.format_string(" %.3f  ", F.col(k)), F.lit(k.replace("_", " ")))) for k in WEIGHTS]
    without = F.concat_ws(", ", *[F.when(F.col(k).isNull(), F.lit(k.replace("_", " "))) for k in WEIGHTS])
    return F.concat(F.concat_ws("\n", *lines), F.when(without != "", F.concat(F.lit("\n\nNot measured: "), without, F.lit("."))).otherwise(""))


def _body(lines: Column) -> Column:
    return F.concat(
        F.format_string("# Report %s\n\n**ε = %.4f** (%s, %s)\n\n## Components\n\n", F.col("doc_id").cast("string"), F.col("epsilon"), band(F.col("epsilon")), F.col("state")),
        components_list(),
        F.format_string("\n\n## Findings (%d)\n\n", F.size(lines)),
        F.when(F.size(lines) == 0, "None.").otherwise(F.array_join(lines, "\n")),
        F.lit("\n"),
    )


def _line(confirmed: Column, kind: Column, severity: Column, confidence: Column, detail: Column) -> Column:
    return F.concat(F.lit("- "), F.when(confirmed, "").otherwise("(suspect) "), message(kind, severity, confidence, F.transform_values(detail, lambda _, v: F.substring(v, 1, 120))))


def analysed_reports(analysed: DataFrame) -> DataFrame:
    """(doc_id, report) of analysed rows (score.analysis), without a shuffle; findings by confidence, the strongest first."""
    each = F.transform("found", lambda x: F.struct((-x["confidence"]).alias("c"), x["ord"].alias("ord"), x["kind"].alias("kind"), _line(x["confirmed"], x["kind"], x["severity"], x["confidence"], x["detail"]).alias("line")))
    lines = F.transform(F.sort_array(each), lambda x: x["line"])
    return scored(analysed, "found").select("doc_id", _body(lines).alias("report"))


def text_reports(scored: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, report) of scored documents (score.score) and stored findings; findings by confidence, the strongest first."""
    shown = _line(F.col("confirmed"), F.col("kind"), F.col("severity"), F.col("confidence"), F.col("detail"))
    lists = found.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("confidence")).alias("c"), "ord", "kind", shown.alias("line")))).alias("f"))
    rows = scored.join(lists, "doc_id", "left")
    lines = F.transform(F.coalesce("f", F.array().cast("array<struct<c: double, ord: int, kind: string, line: string>>")), lambda x: x["line"])
    return rows.select("doc_id", _body(lines).alias("report"))


def _chunk_line() -> Column:
    row = F.format_string("| %d | %s | %s | %.4f |", "chunk_id", F.replace("title", F.lit("|"), F.lit("/")), "loc", "epsilon")
    return F.struct("chunk_id", row.alias("line"))


def _left_line() -> Column:
    return F.struct("chunk_id", F.concat_ws(": ", "title", "reason").alias("line"))


def _of_document(rows: DataFrame) -> DataFrame:
    """(doc_id, report) of rows (doc_id, epsilon, n_chunks, c and d: sorted lines of chunks and of what was left out, null without any)."""
    left = F.array_join(F.transform("d", lambda x: F.concat(F.lit("- "), x["line"])), "\n")
    body = F.concat(
        F.format_string("# Document %s\n\n**ε = %s** over %d chunks\n\n| Chunk | Title | Place | ε |\n|---|---|---|---|\n", F.col("doc_id").cast("string"), F.coalesce(F.format_string("%.4f", "epsilon"), F.lit("-")), F.col("n_chunks")),
        F.coalesce(F.array_join(F.transform("c", lambda x: x["line"]), "\n"), F.lit("")),
        F.coalesce(F.concat(F.lit("\n\n## Left out\n\n"), left), F.lit("")),
        F.lit("\n"),
    )
    return rows.select("doc_id", body.alias("report"))


def document_reports(reduced: DataFrame, chunks: DataFrame, discarded: DataFrame) -> DataFrame:
    """(doc_id, report): the document's score, its chunks in order, and what was left out."""
    by = chunks.groupBy("doc_id").agg(F.sort_array(F.collect_list(_chunk_line())).alias("c"))
    out = discarded.groupBy("doc_id").agg(F.sort_array(F.collect_list(_left_line())).alias("d"))
    return _of_document(reduced.join(by, "doc_id", "left").join(out, "doc_id", "left"))


def chunk_reports(chunks: DataFrame) -> DataFrame:
    """document_reports of all chunks, scored or left out (document.every_score): they are cut and scored once, not for each list again."""
    live = F.col("reason").isNull()
    lists = [F.sort_array(F.collect_list(F.when(live, _chunk_line()))).alias("c"), F.sort_array(F.collect_list(F.when(~live, _left_line()))).alias("d")]
    rows = chunks.groupBy("doc_id").agg(*mean_score(), *lists).where(F.size("c") > 0)
    return _of_document(rows.withColumn("d", F.when(F.size("d") > 0, F.col("d"))))
