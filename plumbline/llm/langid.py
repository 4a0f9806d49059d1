"""Language identification by nearest centroid.

A text's letters give hashed byte n-grams; log counts times inverse document frequency, scaled to
unit length, are compared by cosine with a few k-means centroids for each language. A text that is
far from every centroid, for its number of n-grams, is rejected.

Document frequencies cover all learning rows. Centroids are fitted on a bounded sample of at most
SAMPLE different texts a language, drawn by a hash of the text.

Defined results: a null text or one without letters is "und" with score 0 and counts as rejected;
learning rows with a null language or text are left out; with nothing to learn from every row is
"und"; repeated rows and other columns change nothing; texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import hash_bound, small_batches
from plumbline.llm.packing import ngram_counts

BUCKETS = 4096
#: Most different texts a language on which centroids are fitted; centroids a language.
SAMPLE, CENTROIDS = 512, 3
#: A text is rejected below this share of its language's 1 % quantile of cosines; texts with fewer different n-grams need less, as the root of their number.
REJECT_SHARE, FULL_NGRAMS = 0.4, 400

#: Bytes that aren't part of ASCII letters or of longer sequences become spaces.
_KEEP = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def counts(text: str) -> np.ndarray:
    """Hashed 2- and 3-byte-gram counts of the lower-cased letters."""
    data = b" ".join((" " + text.lower() + " ").encode("utf-8", "replace").translate(_KEEP).split())
    data = b" " + data + b" "
    return ngram_counts(data, 2, BUCKETS) + ngram_counts(data, 3, BUCKETS)


@dataclass
class Model:
    """idf by bucket; unit centroids (rows), each with its language's index and least cosine."""

    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    least: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        names, scores, rejected = [], [], []
        for text in texts:
            if not self.languages or not has_letter(text):
                names.append("und")
                scores.append(0.0)
                rejected.append(True)
                continue
            n = counts(text)
            v = np.log1p(n) * self.idf
            cosines = self.centroids @ v / max(np.sqrt(v @ v), 1e-12)
            best = np.full(len(self.languages), -1.0)
            np.maximum.at(best, self.owner, cosines)
            k = int(best.argmax())
            odds = np.exp(20 * (best - best[k]))
            names.append(self.languages[k])
            scores.append(float(min(1.0, 1 / odds.sum())))
            rejected.append(bool(best[k] < self.least[k] * min(1.0, np.sqrt(np.count_nonzero(n) / FULL_NGRAMS))))
        return names, scores, rejected


def _cluster(x: np.ndarray, k: int, seed: int = 2, rounds: int = 12) -> np.ndarray:
    """Unit centroids of spherical k-means, seeded far apart."""
    rng = np.random.default_rng(seed)
    c = x[[int(rng.integers(len(x)))]]
    while len(c) < min(k, len(x)):
        c = np.vstack([c, x[(x @ c.T).max(axis=1).argmin()]])
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        sums = np.vstack([x[near == j].sum(axis=0) if (near == j).any() else c[j] for j in range(len(c))])
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return c


def fit(rows: DataFrame) -> Model:
    """Model from rows (doc_id, text, lang); what goes to the driver is BUCKETS counts and CENTROIDS vectors a language."""
    small_batches(rows.sparkSession)
    rows = rows.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(BUCKETS, np.int64), 0
        for b in batches:
            for text in b.column("text").to_pylist():
                total += counts(text) > 0
                n += 1
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(BUCKETS + 1), pa.int32()), pa.array([*total.tolist(), n], pa.int64())], ["bucket", "n"])

    df = {r.bucket: r.n for r in rows.select("text").mapInArrow(frequencies, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()}
    n = df.get(BUCKETS, 0)
    idf = np.array([np.log((1 + n) / (1 + df.get(k, 0))) + 0.05 for k in range(BUCKETS)])

    texts = rows.select("text", "lang", F.xxhash64("text", F.lit(2)).alias("h"))
    sizes = {r.lang: r.n for r in texts.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not sizes:
        return Model([], idf, np.zeros((0, BUCKETS)), np.zeros(0, int), np.zeros(0))
    # Copies of a text are one row of the sample, and a language's sample is cut at SAMPLE texts.
    bound = F.element_at(F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, hash_bound(2 * SAMPLE / max(1, n)))]), F.col("lang"))
    one = texts.where(F.col("h") <= bound).groupBy("lang", "h").agg(F.first("text").alias("text"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h"))

    def centroids(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["h", "text"])
        x = np.log1p(np.array([counts(t) for t in part["text"]], dtype=np.float64)) * idf
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        c = _cluster(x, CENTROIDS)
        least = float(np.quantile((x @ c.T).max(axis=1), 0.01)) * REJECT_SHARE
        return pd.DataFrame({"lang": part["lang"].iloc[0], "centroid": [v.astype("<f4").tobytes() for v in c], "least": least})

    found = one.withColumn("nth", nth).where(F.col("nth") <= SAMPLE).groupBy("lang").applyInPandas(centroids, "lang string, centroid binary, least double").collect()
    found = sorted(found, key=lambda r: (r.lang, bytes(r.centroid)))
    languages = sorted({r.lang for r in found})
    least = {r.lang: r.least for r in found}
    vectors = np.array([np.frombuffer(r.centroid, "<f4") for r in found], np.float64).reshape(-1, BUCKETS)
    return Model(languages, idf, vectors, np.array([languages.index(r.lang) for r in found], int), np.array([least[k] for k in languages]))


def identify(model: Model, text: Column) -> Column:
    """Column (lang_pred string, score double, rejected boolean) of a text column."""

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predicted(texts: pd.Series) -> pd.DataFrame:
        names, scores, rejected = model.predict(texts.tolist())
        return pd.DataFrame({"lang_pred": names, "score": scores, "rejected": rejected})

    return predicted(text.cast("string"))
