"""Continuous scoring and monitoring with Structured Streaming.

Scoring is row-local, so the batch expressions run on streams as they are; state is kept only for
windows and repeated sightings, and watermarks bound it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.operators import score


def score_documents(docs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the scores of a stream of (doc_id, text, lang) to a table; a restart goes on where it stopped."""
    return score.score(docs).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def first_sightings(docs: DataFrame, late: str = "1 hour") -> DataFrame:
    """A stream of (doc_hash, ts, ...) without rows that repeat a hash within the watermark."""
    return docs.withWatermark("ts", late).dropDuplicatesWithinWatermark(["doc_hash"])


def call_health(calls: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(window, model, n, anomalies, share) of a stream of model calls (ts, model, flag)."""
    bad = F.count_if(F.col("flag") != "ok")
    return calls.withWatermark("ts", late).groupBy(F.window("ts", window).alias("window"), "model").agg(F.count("*").alias("n"), bad.alias("anomalies"), (bad / F.count("*")).alias("share"))
