"""The corpus pipeline: raw documents to packed sequences in five stages.

1. language: documents whose language is rejected (no letters, or far from every learned centroid) go.
2. near_duplicates: one document of each group of near copies stays: operator 5's links, and min-hash keys for
   larger edits, both checked by the exact similarity (five-word shingles, 0.8).
3. secrets: secrets in texts are replaced by a mark; the documents stay.
4. mixing: documents are repeated to draw token shares toward the targets. No document is dropped:
   the least rate is one, and the targets lower the shares of low-quality and toxic text.
5. packing: the pieces of all that is left, in sequences along the Hilbert curve.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of docs. SQL can express none of the stages, so they are tested against brute force.

Defined results, for each stage's own input: an empty table gives no rows; rows may hold nulls in any
column, and a null id or one that several rows share loses no text; further columns are kept as they
are, whatever their names. A null or letterless text goes in the first stage. Of equal rows one stays
in the second, and ties between the rows of a group go to the least id, then the least hash of the
text. Secrets and lengths follow the whole text, however long. Mixing takes repeated rows each on its
own and repeats rows whole; packing keeps each as pieces of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import langid, mixing, packing, secrets, similar
from plumbline.llm.common import discard, materialize, small_batches, table
from plumbline.llm.queries import domains, vocabulary

ORACLE_SQL = None

#: Shares of the mixture relative to a corpus of mostly clean text of high quality.
TARGETS = {"high_clean": 0.82, "high_toxic": 0.07, "low_clean": 0.09, "low_toxic": 0.02}
#: Tokens of the mixture, as a multiple of the fewest at which no domain has more than its share.
GROWTH = 1.1


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    model = langid.fit(docs.select("doc_id", "text", "lang"))
    whole = docs.select(F.struct(*docs.columns).alias("row"), langid.identify(model, F.col("text")).alias("found"))
    return whole.where(~F.col("found.rejected")).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return similar.one_of_each(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    clean = docs.withColumn("text", secrets.redaction(F.col("text")))
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs, domains(table(spark, sf_dir, "labels")), TARGETS, least=1.0, growth=GROWTH)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary())


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("secrets", secret_scan),
    ("mixing", mix),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written and read again; a stage's table goes when the next one's is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
