"""Hashed sentence embeddings and coherence.

A sentence is a count vector over DIM buckets: each blank-separated, lower-cased token, stripped of
all but letters and digits, falls into the bucket that its SHA-256 names. Vectors have unit length;
an empty sentence is the first unit vector. The mean over all pairs needs no pairs: it follows from
the length of the vectors' sum.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.text import let

DIM = 384
#: Rows of a block of cosines; rows of a block of a group; least sentences that have topics; context of a candidate premise.
BLOCK, GROUP_BLOCK, TOPIC_LEAST, CONTEXT, CONTEXT_CHARS = 512, 2048, 20, 5, 1500
#: Cosine at which a sentence joins a topic; sentences that make one.
TOPIC_ALIKE, TOPIC_SIZE = 0.3, 3
#: Rows of an Arrow batch: a row is a whole document with all that is known of it, and a batch waits, as a whole, for its answers.
BATCH = 256
_BUCKET: dict[str, int] = {}


class _Buckets(dict):
    """Buckets of blank-separated tokens as they stand, DIM for one without letters and digits; bounded."""

    def __missing__(self, token: str) -> int:
        if len(self) > 300_000:
            self.clear()
        bare = token if token.isalnum() else "".join(filter(str.isalnum, token))
        self[token] = found = bucket(bare) if bare else DIM
        return found


_BUCKETS = _Buckets()


def bucket(token: str) -> int:
    found = _BUCKET.get(token)
    if found is None:
        if len(_BUCKET) > 300_000:
            _BUCKET.clear()
        found = _BUCKET[token] = int(hashlib.sha256(token.encode()).hexdigest(), 16) % DIM
    return found


def encode_all(sents: list[str]) -> np.ndarray:
    """Unit vectors of sentences, one a row, counted together."""
    each = [[_BUCKETS[t] for t in s.lower().split()] for s in sents]
    row = np.repeat(np.arange(len(sents)), [len(own) for own in each])
    found = np.fromiter((b for own in each for b in own), np.int64, len(row))
    x = np.bincount(row * (DIM + 1) + found, minlength=len(sents) * (DIM + 1)).reshape(len(sents), DIM + 1)[:, :DIM].astype(float)
    x[~x.any(axis=1), 0] = 1.0
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def encode(sentence: str) -> np.ndarray:
    return encode_all([sentence])[0]


def bucket_column(token: Column) -> Column:
    """bucket() in built-in expressions: the token is hashed once, eight hexadecimal digits at a time are folded modulo DIM."""

    def folded(digest: Column) -> Column:
        out = F.lit(0).cast("long")
        for at in range(1, 65, 8):
            out = (out * (1 << 32) + F.conv(F.substring(digest, at, 8), 16, 10).cast("long")) % DIM
        return out.cast("int")

    return let(F.sha2(token, 256), folded)


def bounded(rows: DataFrame) -> DataFrame:
    """rows; what their session sends to Python from now on goes in batches of BATCH documents."""
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))
    return rows


def word_buckets(sents: DataFrame) -> DataFrame:
    """(doc_id, sent_idx, bucket) of each word of rows (doc_id, sent_idx, sentence), without a shuffle.

    Folding a digest's digits costs several times what hashing the word does, so workers keep the buckets of words they have met.
    """

    @F.pandas_udf("array<int>")
    def hashed(column: pd.Series) -> pd.Series:
        return pd.Series([[bucket(w) for w in words] if words is not None else None for words in column])

    words = F.filter(F.transform(F.split(F.lower(F.trim("sentence")), r"\s+"), lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}]", "")), lambda w: w != "")
    return sents.select("doc_id", "sent_idx", F.explode(hashed(words)).alias("bucket"))


def sentence_buckets(sents: DataFrame) -> DataFrame:
    """(doc_id, sent_idx, bucket, n) of rows (doc_id, sent_idx, sentence): sparse count vectors."""
    return word_buckets(sents).groupBy("doc_id", "sent_idx", "bucket").agg(F.count("*").alias("n"))


def vectors(sents: list[str], given: list | None = None) -> np.ndarray:
    """Unit vectors of sentences, one a row: those given, else hashed."""
    x = encode_all(sents) if given is None else np.array([np.asarray(v, float) for v in given])
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def coherence_values(sents: list[str], given: list | None = None, topics: int = 0) -> tuple[float, float, float, float]:
    """Local mean, global mean, drift, thematic score of a document's sentences (or their vectors, and how many topics they have)."""
    if not len(sents):
        return 1.0, 1.0, 0.0, 1.0
    x = vectors(sents, given)
    n = len(x)
    local = float((x[1:] * x[:-1]).sum(axis=1).mean()) if n > 1 else 1.0
    total = x.sum(axis=0)
    overall = float((total @ total - n) / (n * (n - 1))) if n > 1 else 1.0
    drift = 0.0
    if n >= 3:
        size = max(1, n // 3)
        part = np.minimum(np.arange(n) // size, 2)
        means = np.array([x[part == k].mean(axis=0) for k in range(3)])
        centre = total / n
        lengths = np.linalg.norm(means, axis=1) * np.linalg.norm(centre)
        drift = float(np.std(means @ centre / np.maximum(lengths, 1e-12)))
    spread = 1.0 if topics <= 2 else max(0.0, 1 - 0.15 * (topics - 2))
    return local, overall, drift, 0.6 * (1 - min(1.0, 3 * drift)) + 0.4 * spread


def given_vectors(sents: Column, encode_all) -> Column:
    """A model's vectors of sentences; null without a model."""
    return encode_all(sents) if encode_all else F.lit(None).cast("array<array<double>>")


def _columns(sents: Column, given: Column, topics=None) -> list[Column]:
    """Sentences with their vectors and number of topics, 0 without a model. Fewer than TOPIC_LEAST sentences have none."""
    count = F.when(F.size(sents) >= TOPIC_LEAST, topics(sents)).otherwise(0) if topics else F.lit(0)
    return [sents, given, F.coalesce(count, F.lit(0)).cast("int")]


def coherence(sents: Column, given: Column | None = None, topics=None) -> Column:
    """Column (local, overall, drift, thematic) of an array of sentences; given: a model's vectors of them; topics: a model's column function."""

    @F.pandas_udf("local double, overall double, drift double, thematic double")
    def measured(column: pd.Series, given: pd.Series, count: pd.Series) -> pd.DataFrame:
        rows = [coherence_values(list(s) if s is not None else [], v, int(n)) for s, v, n in zip(column, given, count, strict=True)]
        return pd.DataFrame(rows, columns=["local", "overall", "drift", "thematic"])

    return measured(*_columns(sents, given_vectors(sents, None) if given is None else given, topics))


def topic_number(sents: list[str], given: list | None = None, alike: float = TOPIC_ALIKE, least: int = TOPIC_SIZE) -> int:
    """How many topics sentences have: each joins the nearest topic whose mean is at least so alike (ties: the oldest), else it begins one.

    One pass in the sentences' order, so the same text always has the same topics; topics of fewer than least sentences aren't counted.
    """
    if not len(sents):
        return 0
    sums: list[np.ndarray] = []
    sizes: list[int] = []
    for v in vectors(sents, given):
        near = np.round([v @ s / max(float(np.linalg.norm(s)), 1e-12) for s in sums], 12)
        at = int(np.argmax(near)) if len(near) else -1
        if at >= 0 and near[at] >= alike:
            sums[at], sizes[at] = sums[at] + v, sizes[at] + 1
        else:
            sums.append(v)
            sizes.append(1)
    return sum(n >= least for n in sizes)


def topic_counter(encode_all=None):
    """A column function array of sentences -> number of topics, for Models(topics=...); encode_all: a model's vectors, else hashed ones."""

    @F.pandas_udf("int")
    def counted(column: pd.Series, given: pd.Series) -> pd.Series:
        return pd.Series([topic_number(list(s), v) if s is not None else 0 for s, v in zip(column, given, strict=True)], dtype="int32")

    return lambda sents: counted(sents, given_vectors(sents, encode_all))


def _greatest(sim: np.ndarray, top: int) -> np.ndarray:
    """Places of each row's top values, the greatest first, ties by place; whole rows are sorted only where many values tie."""
    n, width = sim.shape
    if 0 < top < width:
        kept = sim >= np.partition(sim, width - top, axis=1)[:, width - top, None]
        if kept.sum() <= 4 * n * top:
            row, place = np.nonzero(kept)
            order = np.lexsort((place, -sim[row, place], row))
            return place[order][np.searchsorted(row, np.arange(n))[:, None] + np.arange(top)]
    return np.argsort(-sim, axis=1, kind="stable")[:, :top]


def nearest(x: np.ndarray, y: np.ndarray, top: int, skip_own: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x the places and cosines of its top rows of y, the nearest first, ties by place; in blocks of rows."""
    top = min(top, len(y))
    places, cosines = np.zeros((len(x), top), int), np.zeros((len(x), top))
    for at in range(0, len(x), BLOCK):
        sim = x[at : at + BLOCK] @ y.T
        if skip_own:
            sim[np.arange(len(sim)), at + np.arange(len(sim))] = -1.0
        # Rounded, so that sums in another order tie alike.
        sim = np.round(sim, 12)
        order = _greatest(sim, top)
        places[at : at + BLOCK], cosines[at : at + BLOCK] = order, np.take_along_axis(sim, order, 1)
    return places, cosines


def premises_used(sents: list[str], least: float = 0.4, top: int = 3, given: list | None = None) -> list[list[int]]:
    """For each sentence, the positions of the most similar others above the least cosine."""
    if len(sents) < 2:
        return [[] for _ in sents]
    x = vectors(sents, given)
    places, cosines = nearest(x, x, top, True)
    return [[int(j) for j, c in zip(p, s, strict=True) if c > least] for p, s in zip(places, cosines, strict=True)]


def used_premises(sents: Column, given: Column | None = None) -> Column:
    """Column of arrays: for each sentence the positions of the premises it uses (premises_used)."""

    @F.pandas_udf("array<array<int>>")
    def near(column: pd.Series, given: pd.Series, _: pd.Series) -> pd.Series:
        return pd.Series([premises_used(list(s), given=v) if s is not None else [] for s, v in zip(column, given, strict=True)])

    return near(*_columns(sents, given_vectors(sents, None) if given is None else given))


def context_values(asked: list[str], sents: list[str], own: list | None = None, given: list | None = None) -> list[tuple]:
    """(best cosine with any sentence, the CONTEXT nearest sentences as one text of at most CONTEXT_CHARS) of each candidate."""
    if not len(sents):
        return [(None, "") for _ in asked]
    places, cosines = nearest(vectors(asked, own), vectors(sents, given), CONTEXT, False) if len(asked) else ([], [])
    return [(float(c[0]), " ".join(sents[j] for j in p)[:CONTEXT_CHARS]) for p, c in zip(places, cosines, strict=True)]


def contexts(asked: Column, sents: Column, own: Column | None = None, given: Column | None = None) -> Column:
    """Array of (best, context) for candidates against sentences; own and given: a model's vectors of either."""
    none = given_vectors(sents, None)

    @F.pandas_udf("array<struct<best double, context string>>")
    def found(a: pd.Series, s: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
        rows = zip(a, s, x, y, strict=True)
        return pd.Series([[{"best": b, "context": c} for b, c in context_values(list(p if p is not None else []), list(q if q is not None else []), u, v)] for p, q, u, v in rows])

    return found(asked, sents, none if own is None else own, none if given is None else given)


def cosine(a: Column, b: Column) -> Column:
    """Inner product of two arrays; the cosine of unit vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def top_neighbours(rows: DataFrame, key: str, vector: str, group: str, top: int = 3, least: float = 0.4) -> DataFrame:
    """(group, key, rank, neighbour, cosine): the nearest other rows of a row's group above the least cosine, for groups of any size.

    Groups are cut into blocks; each two blocks of a group are a unit of bounded size, whose best are merged.
    """
    sizes = rows.groupBy(group).agg(F.ceil(F.count("*") / GROUP_BLOCK).cast("int").alias("blocks"))
    base = rows.select(F.col(group).alias("g"), F.col(key).cast("long").alias("k"), F.col(vector).cast("array<double>").alias("v")).join(sizes.withColumnRenamed(group, "g"), "g")
    placed = base.withColumn("block", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    asks = placed.select("g", F.col("block").alias("i"), every.alias("j"), "k", "v")
    gives = placed.select(F.col("g").alias("g2"), every.alias("i2"), F.col("block").alias("j2"), F.col("k").alias("k2"), F.col("v").alias("v2"))
    kind = dict(rows.dtypes)[group]

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"g": [], "k": [], "neighbour": [], "cosine": []})
        b = b.rename(columns={"k2": "k", "v2": "v"}).sort_values("k")
        x, y = (np.stack(d["v"].to_numpy()) for d in (a, b))
        x, y = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12) for m in (x, y))
        out = []
        for k, row in zip(a["k"], x, strict=True):
            sim = np.round(y @ row, 12)
            near = [j for j in np.argsort(-sim, kind="stable")[: top + 1] if b["k"].iloc[j] != k and sim[j] > least][:top]
            out += [(a["g"].iloc[0], k, b["k"].iloc[j], float(sim[j])) for j in near]
        return pd.DataFrame(out, columns=["g", "k", "neighbour", "cosine"])

    best = asks.groupBy("g", "i", "j").cogroup(gives.groupBy("g2", "i2", "j2")).applyInPandas(meet, f"g {kind}, k long, neighbour long, cosine double")
    order = Window.partitionBy("g", "k").orderBy(F.desc(F.round("cosine", 12)), "neighbour")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select(F.col("g").alias(group), F.col("k").alias(key), "rank", "neighbour", "cosine")
