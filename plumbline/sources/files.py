"""Readers: whole texts with their identity, word lists, pattern tables, logs and labels.

Paths are read by Spark alone, so any store that it reaches will do. Missing paths raise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.text import strip


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, sha256, bytes, basename, chars), one row a file; bytes that aren't UTF-8 are replaced."""
    raw = spark.read.format("binaryFile").load(path)
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return raw.select(
        "path", text.alias("text"), F.sha2("content", 256).alias("sha256"), F.length("content").cast("long").alias("bytes"), F.element_at(F.split("path", "/"), -1).alias("basename"), F.length(text).cast("long").alias("chars")
    )


def identity(text: Column) -> Column:
    """Identity of a text that has no file: hash, bytes and code points; null for a null text."""
    known = F.struct(F.sha2(text, 256).alias("sha256"), F.substring(F.sha2(text, 256), 1, 16).alias("hash16"), F.octet_length(text).cast("long").alias("bytes"), F.length(text).cast("long").alias("chars"))
    return F.when(text.isNotNull(), known)


def checked(files: DataFrame, expected: DataFrame) -> DataFrame:
    """files, failing when one of the expected (basename, sha256) differs or is missing."""
    want = expected.select("basename", F.col("sha256").alias("wanted"))
    met = want.join(files, "basename", "left")
    same = F.coalesce(F.col("sha256") == F.col("wanted"), F.lit(False))
    return met.withColumn("ok", F.assert_true(same, F.concat(F.lit("checksum differs: "), F.col("basename")))).where("ok is null").drop("ok", "wanted")


def lexicon(spark: SparkSession, path: str, comments: bool = False) -> DataFrame:
    """(term): trimmed, lower-cased, different lines; comments: lines that begin with # are none."""
    rows = spark.read.text(path).select(F.lower(strip(F.col("value"))).alias("term")).where("term <> ''")
    return (rows.where(~F.startswith("term", F.lit("#"))) if comments else rows).distinct()


def patterns(spark: SparkSession, path: str, field: str = "patterns") -> DataFrame:
    """Rows of the array field of a JSON file."""
    return spark.read.option("multiLine", True).json(path).select(F.inline(field))


def prompts(texts: DataFrame) -> DataFrame:
    """(path, pos, title, body) of texts (path, text): sections under second-level headings, up to their input mark."""
    parts = F.slice(F.split("text", r"(?m)^## "), 2, 2**31 - 1)
    each = texts.select("path", F.posexplode(parts).alias("pos", "part"))
    body = F.split(F.regexp_replace("part", r"^[^\n]*\n?", ""), r"\*\*Input\*\*").getItem(0)
    return each.select("path", "pos", F.trim(F.regexp_extract("part", r"^([^\n]*)", 1)).alias("title"), F.regexp_replace(body, r"^\s+|\s+$", "").alias("body"))


def log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines, with file and pos (their order within it); lines that don't parse are left out."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("pos"))
    kept = rows.withColumn("bad", F.try_parse_json("value").isNull()).where("not bad")
    return kept.select("file", "pos", F.from_json("value", schema).alias("r")).select("file", "pos", "r.*")


def last_calls(calls: DataFrame, n: int, anomalies: bool = False) -> DataFrame:
    """The last n records of a call log, the latest first; anomalies: only those whose flag isn't ok."""
    return (calls.where("flag <> 'ok'") if anomalies else calls).orderBy(F.desc("pos")).limit(n)


def all_runs(text_runs: DataFrame, document_runs: DataFrame) -> DataFrame:
    """Both run tables by name, with their kind; columns of one alone are null in the other."""
    return text_runs.withColumn("kind", F.lit("text")).unionByName(document_runs.withColumn("kind", F.lit("document")), allowMissingColumns=True)
