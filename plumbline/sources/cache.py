"""Annotations kept by content: a text is annotated once for each backend, wherever and however often it occurs.

A cache is an append-only table (backend, text_hash, made, annotation) beside a table of cutoffs. What
is older than the latest cutoff of its backend isn't seen any more; compact() writes what is seen to a
new table. Concurrent writers can only add the same text twice, of which the newest counts.
Annotations by a fallback are given but never kept, so that a backend that comes back is asked.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources import stores


def text_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def _table(spark: SparkSession, path: str) -> DataFrame | None:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException as none:
        if none.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def seen(spark: SparkSession, path: str, backend: str | None = None) -> DataFrame | None:
    """(backend, text_hash, made, annotation): the newest entry of each text that no cutoff hides; None for a cache without entries."""
    rows, cuts = _table(spark, f"{path}/entries"), _table(spark, f"{path}/cutoffs")
    if rows is None:
        return None
    rows = rows if backend is None else rows.where(F.col("backend") == backend)
    newest = rows.groupBy("backend", "text_hash").agg(F.max_by(F.struct("made", "annotation"), "made").alias("e")).select("backend", "text_hash", "e.*")
    if cuts is None:
        return newest
    last = cuts.groupBy("backend").agg(F.max("before").alias("before"))
    return newest.join(last, "backend", "left").where(F.col("before").isNull() | (F.col("made") >= F.col("before"))).drop("before")


def annotated(texts: DataFrame, path: str, backend: str, annotate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """texts (text, ...) with annotation: from the cache at path where it holds the text, else from annotate, which is kept.

    annotate: rows (text_hash, text), each text once, to rows (text_hash, annotation, fallback). Null texts have no annotation.
    """
    spark = texts.sparkSession
    keyed = texts.withColumn("text_hash", text_hash(F.col("text")))
    known = seen(spark, path, backend)
    open_ = stores.missing(keyed.where("text is not null").groupBy("text_hash").agg(F.first("text").alias("text")), known, ["text_hash"])
    made = stores.settle(annotate(open_).select("text_hash", "annotation", F.coalesce("fallback", F.lit(False)).alias("fallback")), "annotated")
    kept = made.where("not fallback")
    if not kept.isEmpty():
        stores.append(kept.select(F.lit(backend).alias("backend"), "text_hash", F.current_timestamp().alias("made"), "annotation"), f"{path}/entries")
    own = made.select("text_hash", "annotation")
    every = own if known is None else known.select("text_hash", "annotation").join(own.select("text_hash"), "text_hash", "left_anti").unionByName(own)
    return keyed.join(every, "text_hash", "left").drop("text_hash")


def prune(spark: SparkSession, path: str, backend: str, before: Column | None = None, most: int | None = None) -> None:
    """Hide a backend's entries made before a time, or all but the newest most (with those as old as the last of them)."""
    rows = seen(spark, path, backend)
    if rows is None:
        return
    if before is None:
        cut = rows.select("made").orderBy(F.desc("made")).limit(most or 0).agg(F.min("made").alias("before"))
        cut = cut.select(F.coalesce("before", F.timestamp_micros(F.lit((1 << 62) // 1000))).alias("before"))
    else:
        cut = spark.range(1).select(before.cast("timestamp").alias("before"))
    stores.append(cut.select(F.lit(backend).alias("backend"), "before"), f"{path}/cutoffs")


def compact(spark: SparkSession, path: str, to: str) -> None:
    """Write what is seen of a cache to a new one, without what is hidden or repeated."""
    rows = seen(spark, path)
    if rows is not None:
        stores.append(rows.select("backend", "text_hash", "made", "annotation"), f"{to}/entries")


def summary(spark: SparkSession, path: str) -> DataFrame:
    """(backend, entries, oldest, newest)."""
    rows = seen(spark, path)
    if rows is None:
        return spark.createDataFrame([], "backend string, entries long, oldest timestamp, newest timestamp")
    return rows.groupBy("backend").agg(F.count("*").alias("entries"), F.min("made").alias("oldest"), F.max("made").alias("newest"))
