"""Documents as chunks: each chunk is cleaned and scored like a text, then scores are reduced by length.

All of it is row-local (a chunk's key travels with it) up to the one shuffle of the reduction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.fixed import WEIGHTS
from plumbline.functions.text import once
from plumbline.operators import chunk, clean, score


def cleaned_chunks(docs: DataFrame, target: int = chunk.TARGET, least: int = chunk.LEAST, most: int = chunk.MOST) -> DataFrame:
    """(doc_id, lang, chunk_id, title, loc, chars, text, reason): reason names the paratext that a chunk is, or is null."""
    base = docs.select("doc_id", "lang", F.coalesce(clean.recurring_lines(F.col("text")), F.array().cast("array<string>")).alias("recurring"), "text")
    cut = chunk.chunks(base, target, least, most, keep=("doc_id", "lang", "recurring"))
    # A condition on the reason, and what reads the text, must not tell them again.
    cleaned, reason = once(clean.clean_chunk(F.col("text"), F.col("recurring"))), once(clean.paratext(F.col("title"), F.col("text")))
    return cut.select("doc_id", "lang", "chunk_id", "title", "loc", F.length("text").cast("long").alias("chars"), cleaned.alias("text"), reason.alias("reason"))


def chunk_scores(chunks: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, title, loc, chars, components..., epsilon) of chunks that aren't paratext."""
    key = F.struct("doc_id", "chunk_id", "title", "loc", "chars")
    rows = score.components(chunks.where("reason is null").select(key.alias("doc_id"), "text", "lang"))
    eps = score.geometric_mean({k: F.col(k) for k in WEIGHTS})
    return rows.withColumn("epsilon", eps).select("doc_id.*", *WEIGHTS, "epsilon")


def every_score(chunks: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, title, loc, chars, reason, epsilon) of all chunks in one pass; paratext is not read and has no score."""
    key, live = F.struct("doc_id", "chunk_id", "title", "loc", "chars", "reason"), F.col("reason").isNull()
    rows = score.components(chunks.select(key.alias("doc_id"), F.when(live, F.col("text")).alias("text"), "lang"))
    return rows.withColumn("epsilon", score.geometric_mean({k: F.col(k) for k in WEIGHTS})).select("doc_id.*", F.when(F.col("doc_id.reason").isNull(), F.col("epsilon")).alias("epsilon"))


def mean_score() -> list[Column]:
    """Aggregates of scored chunks: epsilon, n_chunks."""
    live = F.col("epsilon") > 0
    weight = F.sum(F.when(live, F.col("chars")))
    return [F.exp(F.sum(F.when(live, F.col("chars") * F.log("epsilon"))) / weight).alias("epsilon"), F.count_if(live).alias("n_chunks")]


def reduced(chunks: DataFrame) -> DataFrame:
    """(doc_id, epsilon, n_chunks, lowest, highest, chars) of scored chunks."""
    return chunks.groupBy("doc_id").agg(*mean_score(), F.min("epsilon").alias("lowest"), F.max("epsilon").alias("highest"), F.sum("chars").alias("chars"))


def discards(chunks: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, title, reason): paratext, which is left out but always told."""
    return chunks.where("reason is not null").select("doc_id", "chunk_id", "title", "reason")


def note(title: Column, epsilon: Column, findings: Column) -> Column:
    """One line on a chunk for the document's synthesis; findings: array of strings."""
    return F.concat_ws(" | ", title, F.format_string("ε=%.4f", epsilon), F.array_join(findings, "; "))


def average_components(chunks: DataFrame) -> DataFrame:
    """(doc_id, each component averaged over the chunks where it was measured)."""
    return chunks.groupBy("doc_id").agg(*[F.avg(k).alias(k) for k in WEIGHTS])
