"""Command line: score texts or documents, list and compare runs, report, and curate.

python -m plumbline.cli analyse PATH [--lang en] [--out DIR] [--save RUNS]
python -m plumbline.cli document PATH [--lang en] [--target 6000] [--out DIR]
python -m plumbline.cli objective PATH
python -m plumbline.cli runs RUNS [--target T]
python -m plumbline.cli curate RUNS LABELS {pending,approved,stats}
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import arguments, clean, document, history, report, score
from plumbline.sources import files, stores

CHUNK = 6000


def documents(spark: SparkSession, path: str, lang: str | None) -> DataFrame:
    """Files as (doc_id, text, lang, ...): the hash is the key; a language in the front matter holds unless one is given."""
    found = files.texts(spark, path).dropDuplicates(["sha256"])
    own = F.lit(lang) if lang else F.coalesce(clean.front_language(F.col("text")), F.lit("it"))
    return found.select(F.col("sha256").alias("doc_id"), "path", F.regexp_replace("text", clean.FRONT, "").alias("text"), own.alias("lang"))


def analyse(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    docs = documents(spark, a.path, a.lang)
    scored = score.score(docs)
    if a.save:
        stores.append(docs.select("doc_id", "path").join(scored, "doc_id").withColumnRenamed("doc_id", "doc_hash").withColumn("ts", F.current_timestamp()).withColumn("run_id", F.expr("uuid()")), a.save)
    return scored.select("doc_id", "epsilon", "state") if a.quiet else report.text_reports(scored, score.findings(docs))


def documented(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    cut = document.cleaned_chunks(documents(spark, a.path, a.lang), target=a.target, most=max(a.target, 6000))
    rows = document.chunk_scores(cut)
    return report.document_reports(document.reduced(rows), rows, document.discards(cut))


def objective(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return documents(spark, a.path, a.lang).select("doc_id", arguments.objective(F.col("text")).alias("objective"))


def runs(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    table = history.numbered(spark.read.parquet(a.path))
    found = history.resolve(table, a.target) if a.target else history.recent(table)
    return found.select("run_uid", "ts", "doc_hash", "path", "epsilon", "state")


def curate(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    table = history.numbered(spark.read.parquet(a.path))
    labels = history.last_labels(files.log(spark, a.labels, "run_uid string, verdict string"))
    if a.what == "stats":
        return labels.groupBy("verdict").agg(F.count("*").alias("n"))
    return history.pending(table, labels, "run_uid") if a.what == "pending" else history.approved(table, labels, "run_uid", F.col("verdict") == "approved")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="plumbline")
    verbs = top.add_subparsers(dest="verb", required=True)
    for name, run in (("analyse", analyse), ("document", documented), ("objective", objective), ("runs", runs), ("curate", curate)):
        p = verbs.add_parser(name)
        p.set_defaults(run=run)
        p.add_argument("path")
        p.add_argument("--out", help="write here instead of printing")
        if name in ("analyse", "document", "objective"):
            p.add_argument("--lang", choices=["it", "en"])
        if name == "analyse":
            p.add_argument("--quiet", action="store_true", help="scores only")
            p.add_argument("--save", help="append the runs to this table")
        if name == "document":
            p.add_argument("--target", type=int, default=CHUNK, help="characters a chunk aims at")
        if name == "runs":
            p.add_argument("--target", help="run uid, hash prefix, path or base name")
        if name == "curate":
            p.add_argument("labels")
            p.add_argument("what", choices=["pending", "approved", "stats"])
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("plumbline").getOrCreate()
    rows = a.run(spark, a)
    if a.out and "report" in rows.columns:
        stores.report_files(rows, a.out)
    elif a.out:
        rows.write.mode("overwrite").json(a.out)
    else:
        for r in rows.toLocalIterator():
            sys.stdout.write((r["report"] if "report" in rows.columns else "\t".join(map(str, r))) + "\n")
    return 0


if __name__ == "__main__":
    sys.exit(main())
