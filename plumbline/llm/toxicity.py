"""Toxicity by non-negative positive-unlabelled learning.

A text is the set of its words. How many texts hold each word is counted over all documents. Words
count whose share among confirmed toxic texts differs from their share among all texts beyond what
as many words differ by chance (a z-score over the root of twice the logarithm of their number). On
them a linear classifier is trained with numpy: the risk is the class prior's share of the loss on
positives, plus the unlabelled loss as negatives less that share of the positives' loss as
negatives, with that difference held from going below zero. The class prior is the share of toxic
rows among the learning labels, which must be labels of a fair sample of the documents.

Bounded: the positives (POSITIVES different texts) and the unlabelled texts over which the risk's
expectation is taken (UNLABELLED different texts, drawn by a hash of the text, so that copies of one
text or rows of one id can't fill the sample). Everything else covers all rows.

Defined results: a null or wordless text has the bias's score; labels that are null, repeated or of
ids without a document are harmless (an id is toxic if any of its rows says so); without positives
every score is 0; other columns are ignored; texts of any length are read whole.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import least_hashes, small_batches

#: Most texts of either training sample; least texts that hold a word which counts.
POSITIVES, UNLABELLED, LEAST = 4000, 12000, 5
BUCKETS, CACHE = 1 << 20, 300_000
#: Chosen by threefold cross-validation over learning rows alone (see the README).
EPOCHS, RATE, DECAY, BETA, GAMMA = 400, 0.05, 3e-5, 0.0, 1.0

_WORD = re.compile(rb"[a-z\x80-\xff]+")
_BUCKET: dict[bytes, int] = {}


def word_set(text: str | None) -> np.ndarray:
    """Sorted distinct buckets of a text's lower-cased words."""
    words = set(_WORD.findall((text or "").lower().encode("utf-8", "replace")))
    if len(_BUCKET) > CACHE:
        _BUCKET.clear()
    out = []
    for w in words:
        b = _BUCKET.get(w)
        if b is None:
            b = _BUCKET[w] = zlib.crc32(w) & (BUCKETS - 1)
        out.append(b)
    return np.unique(np.array(out, np.int32))


@dataclass
class Model:
    """Weights of word buckets and the bias; no weights: nothing was learned."""

    weights: dict[int, float]
    bias: float
    prior: float

    def table(self) -> np.ndarray:
        out = np.zeros(BUCKETS, np.float32)
        out[list(self.weights)] = list(self.weights.values())
        return out

    def scores(self, texts: list[str | None], table: np.ndarray | None = None) -> np.ndarray:
        if not self.weights:
            return np.zeros(len(texts))
        table = self.table() if table is None else table
        return _sigmoid(np.array([self.bias + float(table[word_set(t)].sum(dtype=np.float64)) for t in texts]))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def nn_pu(p: np.ndarray, u: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk over 0/1 rows p (positive) and u (unlabelled).

    Logistic loss; where the negative part falls below -BETA its gradient is reversed (by GAMMA).
    """
    w, b = np.zeros(p.shape[1]), 0.0
    p32, u32 = p.astype(np.float32), u.astype(np.float32)
    pt, ut = np.ascontiguousarray(p32.T), np.ascontiguousarray(u32.T)
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, EPOCHS + 1):
        w32 = w.astype(np.float32)
        zp, zu = (p32 @ w32).astype(np.float64) + b, (u32 @ w32).astype(np.float64) + b
        sp, su = _sigmoid(zp), _sigmoid(zu)
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        # Gradients of the mean losses by z: as positive sp - 1, as negative s.
        if negative >= -BETA:
            gp, gu = prior * (sp - 1) - prior * sp, su
        else:
            gp, gu = GAMMA * prior * sp, -GAMMA * su
        grad = np.append(pt @ (gp / len(p)).astype(np.float32) + ut @ (gu / len(u)).astype(np.float32) + DECAY * w, gp.mean() + gu.mean())
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad**2
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w -= move[:-1]
        b -= move[-1]
    return w, b


def _chosen(positives: list[np.ndarray], holds: np.ndarray, texts: int) -> np.ndarray:
    """Buckets that tell positives from all texts; holds: by bucket, how many of the texts have it."""
    n, both = len(positives), len(positives) + texts
    found = np.bincount(np.concatenate([*positives, np.zeros(0, np.int32)]).astype(np.int64), minlength=BUCKETS)
    share = (found + holds) / both
    z = np.abs(found / n - holds / texts) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n + 1 / texts))
    seen = found + holds >= LEAST
    return np.flatnonzero(seen & (z > np.sqrt(2 * np.log(max(2, seen.sum())))))


def _matrix(rows: list[np.ndarray], chosen: np.ndarray) -> np.ndarray:
    x = np.zeros((len(rows), len(chosen)), np.float32)
    for k, r in enumerate(rows):
        x[k, np.searchsorted(chosen, np.intersect1d(r, chosen, assume_unique=True))] = 1
    return x


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros(BUCKETS, np.int64), 0
    for b in batches:
        for text in b.column("text").to_pylist():
            total[word_set(text)] += 1
            n += 1
    hit = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array([-1, *hit.tolist()], pa.int32()), pa.array([n, *total[hit].tolist()], pa.int64())], ["bucket", "n"])


def _holds(docs: DataFrame) -> tuple[np.ndarray, int]:
    """How many texts have each bucket's words (those that at least LEAST have), and how many texts there are."""
    each = docs.select("text").mapInArrow(_counted, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = each.where((F.col("bucket") < 0) | (F.col("n") >= LEAST)).toPandas()
    out = np.zeros(BUCKETS, np.int64)
    words = found[found["bucket"] >= 0]
    out[words["bucket"]] = words["n"]
    return out, int(found.loc[found["bucket"] < 0, "n"].sum())


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Model from docs (doc_id, text) and labels (doc_id, toxic); neither may hold rows kept for testing."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    marks = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    known, toxic = marks.agg(F.count("*"), F.count_if(F.col("toxic") == 1)).first()
    if not toxic:
        return Model({}, 0.0, 0.0)
    prior = toxic / known

    @F.pandas_udf("binary")
    def words(texts: pd.Series) -> pd.Series:
        return pd.Series([word_set(t).tobytes() for t in texts])

    def sample(rows: DataFrame, most: int) -> list[np.ndarray]:
        drawn = least_hashes(rows.select("text", F.xxhash64("text", F.lit(7)).alias("h")), "h", most)
        found = drawn.select("h", words("text").alias("words")).collect()
        return [np.frombuffer(r.words, np.int32) for r in sorted(found, key=lambda r: r.h)]

    # At most twice POSITIVES ids are broadcast, so texts needn't move to meet their labels.
    ids = least_hashes(marks.where("toxic = 1").select("doc_id", F.xxhash64("doc_id", F.lit(6)).alias("h")), "h", 2 * POSITIVES)
    positives = sample(docs.join(F.broadcast(ids.select("doc_id")), "doc_id", "left_semi"), POSITIVES)
    holds, texts = _holds(docs)
    if not positives or not texts:
        return Model({}, 0.0, prior)
    chosen = _chosen(positives, holds, texts)
    if not len(chosen):
        return Model({}, 0.0, prior)
    w, b = nn_pu(_matrix(positives, chosen), _matrix(sample(docs, UNLABELLED), chosen), prior)
    return Model(dict(zip(chosen.tolist(), w.tolist(), strict=True)), float(b), prior)


def score(model: Model, text: Column) -> Column:
    """Score of a text column, 0 to 1."""
    state: dict[str, np.ndarray] = {}

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        if not state:
            state["table"] = model.table()
        return pd.Series(model.scores(texts.tolist(), state["table"]), dtype=np.float64)

    return scored(text.cast("string"))
