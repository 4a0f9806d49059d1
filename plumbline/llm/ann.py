"""Approximate nearest neighbours by inner product: inverted lists and an adaptive dimension scan.

Vectors get one more component that makes their lengths equal, so the largest inner product is the
least distance; then a random rotation spreads every vector's energy over all columns. Rows lie in
the lists of k-means centroids (fitted on a bounded sample). A query goes to its nearest lists; how
many hold the share REACH of the true neighbours is measured on trial queries, which are compared with
every row, so it follows the data at any size. There candidates' partial distances grow by blocks of
columns, and after each block a hypothesis test drops those whose distance, as the columns so far estimate it, lies beyond the query's bound with
significance; the rest get the exact inner product of the original vectors.

Small lists share a bin, and a bin is cut into blocks of candidates and of queries, so a list that
holds a third of all rows is many tasks of bounded size. Each block returns a query's best k, and those are merged.

Defined results: vectors that are null, zero, of another than the commonest length, or hold null or
non-finite components take no part, nor rows with a null id; equal scores go by the smaller id; a
query whose id occurs several times is answered once, by its least vector, and rows with its id are
its own; rows that agree in id and vector are one candidate, rows that share an id otherwise are
each one; with fewer candidates than k all are returned; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import discard, least_hashes, materialize

#: Most different vectors on which the centroids are fitted; rows a list aims at; most lists.
SAMPLE, LIST_ROWS, LISTS = 16_384, 256, 4096
#: Share of the trial queries' true neighbours that the probed lists must hold, most trial queries, least number of probes.
REACH, TRIALS, PROBES = 0.97, 256, 16
#: Candidates and queries in one unit of work; queries scanned together; columns in a block; significance of the test (a multiple of the estimate's standard error).
UNIT_ROWS, UNIT_QUERIES, TOGETHER, COLUMNS, SIGNIFICANCE = 4096, 4096, 16, 16, 2.1


def _kmeans(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    rng = np.random.default_rng(9)
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = ((c * c).sum(1) - 2 * (x @ c.T)).argmin(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)[:, None]
        c = np.where(n > 0, sums / np.maximum(n, 1), c)
    return c


class Index:
    """Rotation, radius and centroids; small enough for every task."""

    def __init__(self, sample: np.ndarray, radius: float, rows: int):
        d = sample.shape[1]
        self.radius = radius
        self.rotation = np.linalg.qr(np.random.default_rng(1).standard_normal((d + 1, d + 1)))[0]
        k = int(max(1, min(LISTS, len(sample), rows // LIST_ROWS)))
        self.centroids = _kmeans(self.place(sample), k)

    def place(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """Rotated vectors with the component that evens lengths (0 for queries)."""
        rest = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.radius**2 - (x * x).sum(axis=1), 0))
        return np.column_stack([x, rest]) @ self.rotation

    def lists(self, placed: np.ndarray, n: int) -> np.ndarray:
        far = (self.centroids**2).sum(1) - 2 * (placed @ self.centroids.T)
        if n >= far.shape[1]:
            return np.argsort(far, axis=1, kind="stable")
        near = np.argpartition(far, n - 1, axis=1)[:, :n]
        return np.take_along_axis(near, np.argsort(np.take_along_axis(far, near, 1), axis=1, kind="stable"), 1)


def bins(centroids: np.ndarray, sizes: dict[int, int]) -> dict[int, int]:
    """The bin of each list: neighbouring lists share one as long as it holds at most UNIT_ROWS rows."""
    along = (centroids - centroids.mean(axis=0)) @ np.linalg.svd(centroids - centroids.mean(axis=0), full_matrices=False)[2][0]
    out, now, held = {}, 0, 0
    for c in np.argsort(along, kind="stable").tolist():
        if c in sizes:
            if held and held + sizes[c] > UNIT_ROWS:
                now, held = now + 1, 0
            out[c], held = now, held + sizes[c]
    return out


def scan(queries: np.ndarray, originals: np.ndarray, ids: np.ndarray, placed_q: np.ndarray, placed: np.ndarray, own: np.ndarray, lists: np.ndarray, probed: list, k: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """For each query (position): ids and exact scores of its best k among the candidates of its lists, with early abandoning.

    A block of columns adds to the partial distances of several queries by one product of matrices.
    """
    out = []
    d = placed.shape[1]
    mine = np.zeros((len(queries), int(lists.max()) + 1), bool)
    for q, held in enumerate(probed):
        mine[q, [c for c in held if c < mine.shape[1]]] = True
    longest = np.sqrt((originals * originals).sum(axis=1).max())
    squares = placed * placed
    blocks = {at: np.column_stack([placed[:, at : at + COLUMNS], squares[:, at : at + COLUMNS].sum(axis=1), np.ones(len(ids))]) for at in range(0, d, COLUMNS)}
    for first in range(0, len(queries), TOGETHER):
        some = slice(first, first + TOGETHER)
        at_hand, place_q = np.arange(len(ids)), placed_q[some]
        live = mine[some][:, lists] & (own[some, None] != ids)
        partial = np.zeros(live.shape)
        for at in range(0, d, COLUMNS):
            end = min(d, at + COLUMNS)
            y = place_q[:, at:end]
            x = blocks[at] if len(at_hand) == len(ids) else blocks[at][at_hand]
            # The squares of both lengths stand in columns of their own, so the product alone is the distance.
            partial += np.column_stack([-2 * y, np.ones(len(y)), (y * y).sum(axis=1)]) @ x.T
            many = np.flatnonzero(live.sum(axis=1) > 2 * k)
            if end == d or not len(many):
                continue
            # The bound: the true distance of the k that look nearest so far.
            near = np.argpartition(np.where(live[many], partial[many], np.inf), k - 1, axis=1)[:, :k]
            gap = placed[at_hand[near]] - place_q[many, None]
            bound = (gap * gap).sum(axis=2).max(axis=1)
            # Copies of a query are at distance zero but for the rounding of the products.
            bound += 8 * d * np.finfo(float).eps * (placed[at_hand[near]] ** 2).sum(axis=2).max(axis=1)
            live[many] &= partial[many] * (d / end) <= bound[:, None] * (1 + SIGNIFICANCE / np.sqrt(end)) ** 2
            # Candidates that all of these queries dropped take no part in the other columns.
            stays = live.any(axis=0)
            if stays.mean() < 0.75:
                at_hand, live, partial = at_hand[stays], live[:, stays], partial[:, stays]
        about = np.where(live, queries[some] @ originals[at_hand].T, -np.inf)
        # Products of matrices round otherwise than the measure, so all that can be among the best by it are taken.
        least = np.partition(about, -k, axis=1)[:, -k] if about.shape[1] > k else np.full(len(about), -np.inf)
        for q, (held, scores, bar) in enumerate(zip(live, about, least, strict=True), first):
            error = 4 * d * np.finfo(float).eps * longest * np.sqrt((queries[q] * queries[q]).sum())
            rows = at_hand[np.flatnonzero(held & (scores >= bar - error))]
            score = (originals[rows] * queries[q]).sum(axis=1)
            best = np.lexsort((ids[rows], -score))[:k]
            out.append((q, ids[rows][best], score[best]))
    return out


def _sound(vec: Column, length: int) -> Column:
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vec.isNotNull() & (F.size(vec) == length) & finite & F.exists(vec, lambda x: x != 0)


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each row that is_query marks."""
    empty = "query_id long, rank int, vec_id long, score double"
    spark = vectors.sparkSession
    # The mark is taken before columns are named anew.
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).where("id is not null and v is not null and size(v) > 0")
    lengths = rows.groupBy(F.size("v").alias("length")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "length").first()
    if lengths is None:
        return spark.createDataFrame([], empty)
    sound = materialize(rows.where(_sound(F.col("v"), lengths.length)), "vectors")
    total, square = sound.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()
    if not total:
        return spark.createDataFrame([], empty)
    found = least_hashes(sound.select("v", F.xxhash64("v", F.lit(9)).alias("h")), "h", SAMPLE).collect()
    sample = np.array([r.v for r in sorted(found, key=lambda r: r.h)])
    own_index = Index(sample, float(np.sqrt(square)), total)
    index = spark.sparkContext.broadcast(pickle.dumps(own_index))
    state: dict = {}

    def load() -> Index:
        if "index" not in state:
            state["index"] = pickle.loads(index.value)
        return state["index"]

    @F.pandas_udf("int")
    def home(v: pd.Series) -> pd.Series:
        ix = load()
        return pd.Series(ix.lists(ix.place(np.stack(v.to_numpy())), 1)[:, 0], dtype=np.int32)

    listed = materialize(sound.select("id", "v", home("v").alias("list")), "lists")
    sizes = {r["list"]: r.n for r in listed.groupBy("list").agg(F.count("*").alias("n")).collect()}
    homes = bins(own_index.centroids, sizes)
    full: dict[int, int] = {}
    for c, b in homes.items():
        full[b] = full.get(b, 0) + sizes[c]
    blocks = {b: -(-n // UNIT_ROWS) for b, n in full.items()}
    asked = materialize(sound.where("q").groupBy("id").agg(F.min("v").alias("v")), "asked")
    discard(sound)
    usual = _probes(asked, listed, own_index, k)

    def probes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ix = load()
        for batch in batches:
            near = ix.lists(ix.place(np.stack(batch["v"].to_numpy()), query=True), len(ix.centroids)) if len(batch) else np.zeros((0, 0), int)
            out = []
            for i, v, row in zip(batch["id"].tolist(), batch["v"], near.tolist(), strict=True):
                # More lists than the usual number where those hold too few rows.
                seen, take = 0, 0
                while take < len(row) and (take < usual or seen <= k):
                    seen += sizes.get(row[take], 0)
                    take += 1
                at: dict[int, list[int]] = {}
                for c in row[:take]:
                    if c in homes:
                        at.setdefault(homes[c], []).append(c)
                out += [(i, v, b, c) for b, c in at.items()]
            yield pd.DataFrame(out, columns=["id", "v", "bin", "lists"])

    probed = materialize(asked.mapInPandas(probes, "id long, v array<double>, bin int, lists array<int>"), "probes")
    discard(asked)
    crowds = {r["bin"]: r.n for r in probed.groupBy("bin").agg(F.count("*").alias("n")).collect()}
    parts = {b: max(1, -(-n // UNIT_QUERIES)) for b, n in crowds.items()}

    @F.pandas_udf("array<long>")
    def units_of_rows(c: pd.Series, i: pd.Series) -> pd.Series:
        at = [homes[x] for x in c.tolist()]
        return pd.Series([[(b << 40) | (hash_of(x) % blocks[b] << 20) | p for p in range(parts.get(b, 0))] for b, x in zip(at, i.tolist(), strict=True)])

    @F.pandas_udf("array<long>")
    def units_of_queries(b: pd.Series, i: pd.Series) -> pd.Series:
        return pd.Series([[(a << 40) | (n << 20) | hash_of(x) % parts[a] for n in range(blocks[a])] for a, x in zip(b.tolist(), i.tolist(), strict=True)])

    left = listed.select("id", "v", "list", F.explode(units_of_rows("list", "id")).alias("unit"))
    right = probed.select("id", "v", "lists", F.explode(units_of_queries("bin", "id")).alias("unit"))

    def work(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(candidates) or not len(queries):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        ix = load()
        # Copies of a row share their list and their unit.
        candidates = candidates.sort_values("id", kind="stable")
        candidates = candidates[~candidates.assign(v=candidates["v"].map(lambda v: v.tobytes())).duplicated(["id", "v"])]
        x, y = np.stack(candidates["v"].to_numpy()), np.stack(queries["v"].to_numpy())
        ids, own = candidates["id"].to_numpy(), queries["id"].to_numpy()
        got = scan(y, x, ids, ix.place(y, query=True), ix.place(x), own, candidates["list"].to_numpy(), queries["lists"].tolist(), k)
        return pd.DataFrame({"query_id": np.repeat(own[[q for q, _, _ in got]], [len(i) for _, i, _ in got]), "vec_id": np.concatenate([i for _, i, _ in got]), "score": np.concatenate([s for _, _, s in got])})

    best = left.groupBy("unit").cogroup(right.groupBy("unit")).applyInPandas(work, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _probes(asked: DataFrame, listed: DataFrame, index: Index, k: int) -> int:
    """How many lists hold the share REACH of the true k nearest rows of trial queries."""
    trial = least_hashes(asked.select("id", "v", F.xxhash64("id", F.lit(11)).alias("h")), "h", TRIALS).collect()
    if not trial:
        return PROBES
    own, y = np.array([r.id for r in trial]), np.array([r.v for r in trial])

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = [pd.DataFrame({"score": np.zeros(0), "id": np.zeros(0, np.int64), "list": np.zeros(0, np.int32)})] * len(own)
        for b in batches:
            if not len(b):
                continue
            scores, ids = np.stack(b["v"].to_numpy()) @ y.T, b["id"].to_numpy()
            for q in range(len(own)):
                s = np.where(ids == own[q], -np.inf, scores[:, q])
                top = np.argpartition(-s, k)[:k] if len(s) > k else np.arange(len(s))
                top = top[s[top] > (best[q]["score"].iloc[-1] if len(best[q]) == k else -np.inf)]
                if len(top):
                    both = pd.concat([best[q], pd.DataFrame({"score": s[top], "id": ids[top], "list": b["list"].to_numpy()[top]})])
                    best[q] = both.sort_values(["score", "id"], ascending=[False, True])[:k]
        yield pd.concat([x.assign(q=q) for q, x in enumerate(best)])[["q", "id", "list", "score"]]

    order = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    found = listed.select("id", "v", "list").mapInPandas(nearest, "q int, id long, list int, score double").withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).collect()
    if not found:
        return PROBES
    near = index.lists(index.place(y, query=True), len(index.centroids))
    place = np.argsort(near, axis=1)
    ranks = np.sort([place[r.q, r["list"]] for r in found])
    return max(PROBES, int(ranks[int(np.ceil(REACH * len(ranks))) - 1]) + 1)


def hash_of(x: int) -> int:
    """A 31-bit mix of an id."""
    return (((x ^ (x >> 31)) * 0x9E3779B97F4A7C15) & ((1 << 64) - 1)) >> 33
