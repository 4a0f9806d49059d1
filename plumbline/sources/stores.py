"""Sinks: append-only tables, resumable chunk results, JSON lines, CSV with a sidecar, front matter.

Nothing is updated in place: the current state is a view over what was appended (operators.history),
so concurrent writers and repeated tasks can't lose each other's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.fixed import ABSTRACT_TERMS

STATE = 0.3


def append(rows: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Append to a Parquet table, partitioned by few-valued columns."""
    out = rows.write.mode("append")
    (out.partitionBy(*by) if by else out).parquet(path)


#: Columns of the tables of runs; report is the whole run as JSON. The counters tell how much of a run failed.
TEXT_RUN = "doc_hash string, sig string, path string, lang string, chars long, epsilon double, state string, components map<string,double>, n_findings long, n_axes long, n_failed long, report string, ts timestamp"
DOCUMENT_RUN = "doc_hash string, sig string, path string, lang string, chars long, epsilon double, n_chunks long, n_skipped long, n_axes long, n_failed long, report string, ts timestamp"


def save_runs(rows: DataFrame, path: str, schema: str = TEXT_RUN) -> int:
    """Append runs under a schema, once for each document and signature; how many were new.

    Columns that rows lack are null, further ones don't enter the table, a column of another type is cast and a value that
    can't be is an error. A run without doc_hash or sig is an error too.
    """
    from pyspark.errors import AnalysisException
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(schema).fields
    typed = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])
    keys = ["doc_hash", "sig"]
    one = typed.select(*[F.when(F.col(k).isNull(), F.raise_error(F.lit(f"a run has no {k}"))).otherwise(F.col(k)).alias(k) if k in keys else F.col(k) for k in typed.columns])
    rest = [f.name for f in fields if f.name not in keys]
    one = one.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("ts", "report")).alias("r")).select(*keys, *[f"r.{c}" for c in rest])
    try:
        one = missing(one, rows.sparkSession.read.schema(schema).parquet(path), keys)
    except AnalysisException as none:
        if none.getCondition() != "PATH_NOT_FOUND":
            raise
    new = settle(one, "runs")
    append(new, path)
    return new.count()


_LOCAL: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); only a local session without one gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        import tempfile

        _LOCAL[app] = tempfile.mkdtemp(prefix="plumbline-")
    return _LOCAL[app]


def settle(rows: DataFrame, tag: str) -> DataFrame:
    """rows written once to the shared folder and read back, so that what is asked of them doesn't change under way."""
    import uuid

    path = f"{scratch(rows.sparkSession)}/plumbline/{tag}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def append_lines(rows: DataFrame, path: str) -> None:
    """Append as JSON lines (labels, training logs, call traces)."""
    rows.write.mode("append").json(path)


def export_csv(rows: DataFrame, path: str, keys: list[str]) -> None:
    """CSV with a header, and path.meta: one JSON row of time, number of rows, columns and keys."""
    rows.write.mode("overwrite").option("header", True).csv(path)
    written = rows.sparkSession.read.option("header", True).csv(path)
    meta = written.agg(F.count("*").alias("rows")).select(F.current_timestamp().alias("ts"), "rows", F.array(*[F.lit(c) for c in rows.columns]).alias("columns"), F.array(*[F.lit(k) for k in keys]).alias("keys"))
    meta.write.mode("overwrite").json(path + ".meta")


def report_files(reports: DataFrame, path: str, key: str = "doc_id", report: str = "report") -> None:
    """Markdown reports as text, one folder a key."""
    reports.select(F.col(report).alias("value"), key).write.mode("overwrite").partitionBy(key).text(path)


def signature(options: dict) -> str:
    """Eight hexadecimal digits that name a configuration."""
    import hashlib
    import json

    return hashlib.sha256(json.dumps(options, sort_keys=True, default=str).encode()).hexdigest()[:8]


def known(spark: SparkSession, path: str, sig: str) -> DataFrame | None:
    """Results written under a configuration, or None when there are none yet."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path).where(F.col("sig") == sig)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def missing(wanted: DataFrame, done: DataFrame | None, keys: list[str], failed: Column | None = None) -> DataFrame:
    """Rows of wanted with no result, or with a failed one only: what is left to compute."""
    if done is None:
        return wanted
    good = done if failed is None else done.where(~F.coalesce(failed, F.lit(False)))
    return wanted.join(good.select(*keys).distinct(), keys, "left_anti")


def stamp() -> str:
    """The time as part of a name, to the microsecond, so that names of one run after another differ and sort by time."""
    import datetime

    return datetime.datetime.now(datetime.timezone.utc).strftime("%Y%m%d_%H%M%S_%f")


def dump_evaluation(rows: DataFrame, path: str, name: str, facts: dict[str, object], shown: list[str], order: list[str]) -> tuple[str, str]:
    """An evaluation's rows under names of this moment: <name>_<time>.csv with all columns, .md with a heading, facts and a table of shown.

    Both are sorted by order and never overwritten. Null cells are empty; bars within cells are escaped, breaks become blanks.
    Gives both paths.
    """
    at = stamp()
    csv, md = f"{path}/{name}_{at}.csv", f"{path}/{name}_{at}.md"
    rows.orderBy(*order).write.option("header", True).option("quoteAll", True).csv(csv)
    cells = [F.regexp_replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), r"\R", " ") for c in shown]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    head = [f"# {name} {at}", "", *[f"{k}: {v}" for k, v in facts.items()], "", "| " + " | ".join(shown) + " |", "|" + "---|" * len(shown)]
    first = rows.sparkSession.createDataFrame([(k, t) for k, t in enumerate(head)], "part int, value string")
    body = rows.select(F.lit(len(head)).alias("part"), line.alias("value"), *[F.col(c).alias(f"by{k}") for k, c in enumerate(order)])
    first.unionByName(body, allowMissingColumns=True).orderBy("part", *[f"by{k}" for k in range(len(order))]).select("value").write.text(md)
    return csv, md


def keep_phase(result: DataFrame, path: str, phase: str) -> None:
    """The result of a phase as JSON: the current one at <phase>, and each run's own under history/<phase>_<time>, which no later run touches."""
    at = stamp()
    past = f"{path}/history/{phase}_{at}"
    result.withColumn("ts", F.lit(at)).write.json(past)
    result.sparkSession.read.schema(result.schema.add("ts", "string")).json(past).write.mode("overwrite").json(f"{path}/{phase}")


def log_promotions(promoted: DataFrame, lexicon_path: str, log_path: str) -> int:
    """Append the promoted rows of promote() to the lexicon table (term), and where each came from to a log of JSON lines; how many there were."""
    new = settle(promoted.where("state = 'promoted'"), "promoted")
    append(new.select("term"), lexicon_path)
    append_lines(new.select("term", "vetting", "channel", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("ts")), log_path)
    return new.count()


def promote(terms: DataFrame, lexicon: DataFrame, channel: str = "user") -> DataFrame:
    """(term, state, vetting, channel) of each proposed term, by its last word: empty, bad_format, present or promoted.

    A promoted term is vetted as "abstract" when the abstract-term detector finds it, else "to_check";
    vetting advises only. Append the promoted rows to the lexicon table.
    """
    from plumbline.operators.findings import abstract_terms

    t = terms.select(F.lower(F.trim(F.coalesce("term", F.lit("")))).alias("term")).distinct()
    have = lexicon.select(F.lower("term").alias("term")).distinct().withColumn("have", F.lit(True))
    found = abstract_terms(t.select(F.col("term").alias("doc_id"), F.col("term").alias("text")))
    hits = found.where(F.col("term") == F.col("doc_id")).select("term").distinct().withColumn("hit", F.lit(True))
    ok = (F.length("term") <= 64) & F.col("term").rlike(r"^[\p{L}\p{N}_\s'’\-]+$") & ~F.contains("term", F.lit("\n"))
    state = F.when(F.col("term") == "", "empty").when(~ok, "bad_format").when(F.col("have"), "present").otherwise("promoted")
    out = t.join(have, "term", "left").join(hits, "term", "left").withColumn("state", state)
    return out.select("term", "state", F.when(F.col("state") == "promoted", F.when(F.col("hit"), "abstract").otherwise("to_check")).alias("vetting"), F.lit(channel).alias("channel"))


def base_lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t,) for t in ABSTRACT_TERMS], "term string")


def state(epsilon: Column, cut: float = STATE) -> Column:
    """Above the cut, below it, or unmeasured."""
    return F.when(epsilon > cut, ">δ").when(epsilon > 0, "<δ").otherwise("∅")


def front_matter(fields: dict[str, Column]) -> Column:
    """YAML front matter of named values; strings are quoted and escaped, nulls are null."""

    def line(name: str, value: Column) -> Column:
        quoted = F.concat(F.lit('"'), F.replace(F.replace(value.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
        return F.concat(F.lit(name + ": "), F.coalesce(quoted, F.lit("null")))

    return F.concat(F.lit("---\n"), F.concat_ws("\n", *[line(k, v) for k, v in fields.items()]), F.lit("\n---\n"))
