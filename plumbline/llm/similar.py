"""Near copies: the links of operator 5's fingerprints, then min-hash keys for larger edits, both with the exact Jaccard similarity.

Two texts are linked if the sets of their five-word shingles have a Jaccard similarity of 0.8 or more;
links make groups. Texts with equal sets are one node. First the nodes whose SimHash fingerprints
differ in at most four bits meet by Golay keys (simhash.py). Copies with larger edits differ in more
bits, so BANDS keys of ROWS least hash values each are taken of every node; a pair at 0.8 shares a key
with a chance of 1 - (1 - 0.8^ROWS)^BANDS (0.99993), more similar ones more surely. There only keys
whose nodes the fingerprints left in different groups go on. Every meeting is checked on the sets
themselves, so texts that a repeated line alone makes alike stay apart.

A large family would make pairs by the square of its size, so the nodes of a key are first checked
against the least of them; after that all that are still in different groups are compared, in
bounded blocks where there are many, from which only the links that join groups come back.

Defined results: words are those of the SimHash operator; a text of fewer than five words is one
shingle, and texts without words (null ones too) have the empty set and are copies of each other;
shingles are compared by 48 bits of their hash. Of each group the row with the least id stays (rows
without id last, then by a hash of the text), so a null or repeated id loses no text; repeated rows
count once; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import discard, materialize, small_batches
from plumbline.llm.graph import components
from plumbline.llm.simhash import fingerprint, joining

SEED, SHINGLE, LEAST = 43, 5, 0.8
#: Keys of a node, and min-hashes in each.
BANDS, ROWS = 24, 5
#: Nodes of a key that are compared by a join; nodes in a block otherwise; shingles counted at once.
SMALL, BLOCK, COLUMNS = 32, 256, 8192
#: Bytes kept of a shingle's hash.
BYTES = 6

_RANDOM = np.random.default_rng(5)
_TIMES = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingles(text: str, width: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct word shingles."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(width, len(words))
    digest, mask = xxhash.xxh64_intdigest, (1 << 8 * BYTES) - 1
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    return np.unique(np.array([digest(joined[s:e], SEED) & mask for s, e in spans], np.uint64))


def node(found: np.ndarray) -> int:
    """Signed 64-bit name of a set."""
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), SEED)).astype(np.int64))


def keys(found: np.ndarray) -> list[int]:
    """The keys of a set, signed; none of an empty set."""
    if not len(found):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 1024):
        least = np.minimum(least, (found[at : at + 1024, None] * _TIMES + _PLUS).min(axis=0))
    bands = least.reshape(BANDS, ROWS)
    return [int(np.uint64(xxhash.xxh64_intdigest(b.tobytes(), k)).astype(np.int64)) for k, b in enumerate(bands)]


def packed(found: np.ndarray) -> bytes:
    return found.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :BYTES].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // BYTES, 8), np.uint8)
    out[:, :BYTES] = np.frombuffer(data, np.uint8).reshape(-1, BYTES)
    return out.reshape(-1).view("<u8")


def alike(a: np.ndarray, b: np.ndarray, least: float = LEAST) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both) - 1e-9


def _named(docs: DataFrame) -> DataFrame:
    """docs with columns that tell rows of unlike id or text apart (__none, __id, __text)."""
    i = F.col("doc_id").cast("long")
    return docs.withColumns({"__none": i.isNull(), "__id": F.coalesce(i, F.lit(0)), "__text": F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))})


ROW = ["__none", "__id", "__text"]


def _described(texts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in texts:
        sets = [shingles(t or "") for t in b["text"]]
        prints = np.array([fingerprint(t or "") for t in b["text"]], np.uint64).astype(np.int64)
        yield b[ROW].assign(node=np.array([node(s) for s in sets], np.int64), size=np.array([len(s) for s in sets], np.int32), fp=prints, keys=[keys(s) for s in sets])


def _sets(texts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in texts:
        sets = [shingles(t or "") for t in b["text"]]
        yield pd.DataFrame({"node": np.array([node(s) for s in sets], np.int64), "set": [packed(s) for s in sets]})


def _fits(a: Column, b: Column) -> Column:
    """Sets of such sizes can be alike."""
    return F.least(a, b) >= F.greatest(a, b) * F.lit(LEAST) - F.lit(1e-9)


def _checked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    @F.pandas_udf("boolean")
    def near(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([alike(unpacked(x), unpacked(y)) for x, y in zip(a, b, strict=True)], dtype=bool)

    met = pairs.join(sets.select(F.col("node").alias("u"), F.col("set").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("set").alias("b")), "v")
    return materialize(met.where(near("a", "b")).select("u", "v"), "alike")


def _kept_keys(keyed: DataFrame, holds: Column, *more: Column) -> DataFrame:
    """Keys (key, ...) for which holds is true, one of those with the same nodes."""
    same = ["n_same", "x", "y"]
    by = keyed.groupBy("key").agg(holds.alias("holds"), F.count("*").alias(same[0]), F.bit_xor(F.xxhash64("node", F.lit(1))).alias(same[1]), F.bit_xor(F.xxhash64("node", F.lit(2))).alias(same[2]), *more)
    extra = [c for c in by.columns if c not in ("key", "holds", *same)]
    return by.where("holds").groupBy(*same).agg(F.min("key").alias("key"), *[F.first(c).alias(c) for c in extra]).drop(*same)


def _forest(unit: pd.DataFrame) -> pd.DataFrame:
    """Links that join the groups (in) of a unit's nodes, as few as do."""
    unit = unit.drop_duplicates("node").sort_values("node")
    names, n = unit["node"].to_numpy(), len(unit)
    sets = [unpacked(x) for x in unit["set"]]
    sizes = np.array([len(s) for s in sets])
    _, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rows, met = np.repeat(np.arange(n), sizes), times[place] > 1
    column = (np.cumsum(times > 1) - 1)[place][met]
    rows, both = rows[met], np.zeros((n, n), np.float32)
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [at, at + COLUMNS])
        has = np.zeros((n, COLUMNS), np.float32)
        has[rows[a:b], column[a:b] - at] = 1
        both += has @ has.T
    up = dict.fromkeys(unit["in"].tolist())
    inside, out = unit["in"].tolist(), []

    def top(x: int) -> int:
        while up[x] is not None:
            x = up[x]
        return x

    for i, j in zip(*np.nonzero(np.triu(both >= LEAST * (sizes[:, None] + sizes - both) - 1e-3, 1)), strict=True):
        x, y = top(inside[i]), top(inside[j])
        if x != y and alike(sets[i], sets[j]):
            up[y] = x
            out.append((names[i], names[j]))
    return pd.DataFrame(out, columns=["u", "v"]).astype("int64")


def _by_fingerprint(prints: DataFrame) -> DataFrame:
    """(u, v) of nodes (node, fp) by operator 5's links: nodes of one fingerprint by the least of them, and the least of linked fingerprints."""
    each = prints.select("node", "fp").distinct()
    least = materialize(each.groupBy("fp").agg(F.min("node").alias("least")), "fingerprints")
    links = joining(least.select(F.col("fp").alias("id"), "fp"))
    ends = [least.select(F.col("fp").alias(side), F.col("least").alias(f"to_{side}")) for side in "uv"]
    between = links.join(ends[0], "u").join(ends[1], "v").select(F.col("to_u").alias("u"), F.col("to_v").alias("v"))
    within = each.join(least, "fp").select(F.col("least").alias("u"), F.col("node").alias("v"))
    met = materialize(between.union(within).where("u <> v").distinct(), "near")
    for used in (least, links):
        discard(used)
    return met


def _by_hashes(nodes: DataFrame) -> DataFrame:
    """(key, node, size) of the min-hash keys that several nodes share."""
    # Most keys have one node: these go by their count alone, before anything else is known of a key.
    keyed = nodes.select("node", "size", F.explode("keys").alias("key"))
    repeated = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    met = materialize(keyed.join(repeated, "key", "left_semi").select("key", "node", "size"), "met")
    shared = materialize(met.join(_kept_keys(met, F.count("*") > 1), "key").select("key", "node", "size"), "shared")
    discard(met)
    return shared


def groups(docs: DataFrame) -> DataFrame:
    """(__none, __id, __text, node, group) of each row of docs (doc_id, text); rows that agree in the first three may come once."""
    small_batches(docs.sparkSession)
    texts = _named(docs.select("doc_id", F.col("text").cast("string").alias("text"))).select(*ROW, "text")
    prints = materialize(texts.mapInPandas(_described, "__none boolean, __id long, __text long, node long, size int, fp long, keys array<long>"), "sets")
    near = _by_fingerprint(prints)
    # Copies of a node are one; any of its rows serves to read its text again.
    nodes = materialize(prints.groupBy("node").agg(F.min("size").alias("size"), F.min(F.struct(*ROW)).alias("row"), F.min("keys").alias("keys")), "nodes")
    shared = _by_hashes(nodes)
    ends = shared.select("node").union(near.select("u")).union(near.select("v")).distinct()
    wanted = nodes.select("node", "row").join(ends, "node", "left_semi").select("row.*")
    sets = materialize(texts.join(wanted, ROW, "left_semi").mapInPandas(_sets, "node long, set binary").groupBy("node").agg(F.first("set").alias("set")), "shingles")
    linked = _checked(near, sets)

    def apart(some: DataFrame, *more: Column) -> DataFrame:
        """The rows of shared with their group so far (in), of keys with several groups."""
        now = shared.join(components(some).withColumnRenamed("component", "in"), "node", "left").select("key", "node", "size", F.coalesce("in", "node").alias("in"))
        return materialize(now.join(_kept_keys(now, F.min("in") < F.max("in"), *more), "key"), "open")

    first = apart(linked)
    centre = first.groupBy("key").agg(F.min(F.struct("node", "size", "in")).alias("c"))
    stars = first.join(centre, "key").where(F.col("in") != F.col("c.in")).where(_fits(F.col("size"), F.col("c.size")))
    some = _checked(stars.select(F.col("c.node").alias("u"), F.col("node").alias("v")).distinct(), sets)
    open_ = apart(linked.union(some), F.count("*").alias("n"))
    small = open_.where(F.col("n") <= SMALL)
    a, b = small.alias("a"), small.alias("b")
    cross = (F.col("a.key") == F.col("b.key")) & (F.col("a.node") < F.col("b.node")) & (F.col("a.in") != F.col("b.in")) & _fits(F.col("a.size"), F.col("b.size"))
    pairs = _checked(a.join(b, cross).select(F.col("a.node").alias("u"), F.col("b.node").alias("v")).distinct(), sets)
    # A large key is cut into blocks; each two of them are a unit of bounded size.
    cut = F.ceil(F.col("n") / BLOCK)
    large = open_.where(F.col("n") > SMALL).withColumn("block", F.pmod(F.xxhash64("node"), cut))
    other = F.explode(F.sequence(F.lit(0).cast("long"), cut - 1)).alias("other")
    units = large.select("key", "node", "in", "block", other).select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "in")
    crowds = materialize(units.join(sets, "node").groupBy("key", "i", "j").applyInPandas(_forest, "u long, v long"), "alike")
    links = [linked, some, pairs, crowds]
    found = components(reduce(DataFrame.union, links)).withColumnRenamed("component", "in")
    out = materialize(prints.join(found, "node", "left").select(*ROW, "node", F.coalesce("in", "node").alias("group")), "groups")
    for used in (prints, near, nodes, shared, sets, first, open_, *links):
        discard(used)
    return out


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of near copies."""
    kept = groups(docs).groupBy("group").agg(F.min(F.struct(*ROW)).alias("row")).select("row.*")
    whole = _named(docs.select("doc_id", "text", F.struct(*docs.columns).alias("row")))
    # Copies combine before the shuffle, so a group of any size is one row of each task.
    told = F.xxhash64(*[F.col("row")[c] for c, kind in docs.dtypes if "map<" not in kind])
    one = whole.groupBy(*ROW).agg(F.min_by("row", told).alias("row"))
    return one.join(kept, ROW, "left_semi").select("row.*")
