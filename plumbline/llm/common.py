"""Helpers the operators share: the shared folder, cut lineage, tables, id remainders."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only a local-mode session may lack the setting; it gets a temporary folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="plumbline-")
    return _LOCAL[app]


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write df once as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/plumbline/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table that materialize() wrote and that no later plan reads."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    parents = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for parent in parents:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(conf).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Bound what one Arrow batch of whole texts holds in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo modulus; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def hash_share(key: Column, share: float, seed: int) -> Column:
    """True for about that share of the keys, always the same ones."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 24)) < F.lit(min(1 << 24, int(share * (1 << 24))))


def least_hashes(rows: DataFrame, key: str, most: int) -> DataFrame:
    """A bounded sample: rows of the least different values of the hash column key, one of each value, at most that many.

    Copies of a row share a hash, so no group of copies can fill the sample, nor rows of one id.
    """
    n = rows.agg(F.approx_count_distinct(key).alias("n")).first().n
    near = rows.where(F.col(key) <= F.lit(hash_bound(2 * most / max(1, n))))
    return near.groupBy(key).agg(*[F.first(c).alias(c) for c in rows.columns if c != key]).orderBy(key).limit(most)


def hash_bound(share: float) -> int:
    """The value up to which that share of all 64-bit hashes lies."""
    whole = (1 << 63) - 1
    return whole if share >= 1 else int(-whole + 2 * whole * share)
