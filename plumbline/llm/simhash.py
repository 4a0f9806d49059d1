"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint's 64 bits are cut into segments of 23, 23 and 18 bits. Each segment is decoded in the
perfect [23, 12, 7] Golay code. Of two fingerprints that differ in at most four bits, two of the
three segments differ in at most two bits together (pigeonhole), in a pattern of (2, 0), (1, 1) or
less. Words within one bit of a segment decode to a few codewords, and two segments that differ in
two bits share one of them; so the keys (near codewords of one segment, codeword of another) for
both orders of each pair of segments are enough to meet every such pair. The join is on those keys;
each meeting is checked by the exact bit difference, and links make components.

Equal fingerprints are one node, so copies make no pairs. For components a family of near ones needn't
make all its pairs: the nodes of a key are first checked against the least of them, and after that
only nodes of a key that are still in different components meet. The joins' partitions are split by
Spark where many different fingerprints share a key.

Defined results: a null text is empty and, like any text without words, has fingerprint zero, which
links like any other; a null id takes part through its fingerprint, and a group without any id has a
null component_id; repeated rows get equal results; other columns are ignored; texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import discard, materialize, small_batches
from plumbline.llm.graph import components

SEED, SHINGLE, MAX_BITS = 42, 4, 4
#: Widths of the segments, from the lowest bit.
SEGMENTS = (23, 23, 18)
#: Generator polynomial of the Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011


def fingerprint(text: str, width: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash over word shingles, repeats included."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(width, len(words))
    digest = xxhash.xxh64_intdigest
    counts, n = np.zeros(64, np.int64), len(words) - width + 1
    for at in range(0, n, 1 << 16):
        stop = min(n, at + (1 << 16))
        spans = zip(starts[at:stop].tolist(), ends[at + width - 1 : stop + width - 1].tolist(), strict=True)
        h = np.array([digest(joined[s:e], SEED) for s, e in spans], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(text: Column, width: int = SHINGLE) -> Column:
    """Fingerprint of a text column as a signed long with the same bits."""

    @F.pandas_udf("long")
    def hashed(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t or "", width) for t in texts], np.uint64).astype(np.int64))

    return hashed(text.cast("string"))


def _remainders(words: np.ndarray) -> np.ndarray:
    rest = words.astype(np.int64).copy()
    for bit in range(22, 10, -1):
        rest ^= ((rest >> bit) & 1) * (GENERATOR << (bit - 11))
    return rest


def _leaders() -> np.ndarray:
    """By remainder, the only error pattern of at most three bits."""
    bits = [0, *(1 << k for k in range(23))]
    patterns = np.array(sorted({a | b | c for a in bits for b in bits for c in bits}), np.int64)
    out = np.zeros(2048, np.int64)
    out[_remainders(patterns)] = patterns
    return out


_LEADERS = _leaders()


def decode(words: np.ndarray) -> np.ndarray:
    """Index (0 to 4095) of the codeword within three bits of each 23-bit word."""
    return (words ^ _LEADERS[_remainders(words)]) >> 11


def near_keys(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (position in values, key) of all keys of unsigned 64-bit fingerprints."""
    exact, near, shift = [], [], 0
    for width in SEGMENTS:
        seg = ((values >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64)
        shift += width
        exact.append(decode(seg))
        near.append(np.stack([exact[-1], *(decode(seg ^ (1 << k)) for k in range(width))], axis=1))
    rows, keys = [], []
    for pair, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        k = np.concatenate([near[i] << 12 | exact[j][:, None], exact[i][:, None] << 12 | near[j]], axis=1)
        k.sort(axis=1)
        first = np.concatenate([np.ones((len(k), 1), bool), k[:, 1:] != k[:, :-1]], axis=1)
        rows.append(np.nonzero(first)[0])
        keys.append(k[first] | pair << 24)
    return np.concatenate(rows), np.concatenate(keys)


def _keyed(nodes: DataFrame) -> DataFrame:
    """(key, id, fp): every key of each node (id, fp)."""

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows, keys = near_keys(b["fp"].to_numpy(np.int64).view(np.uint64))
            yield pd.DataFrame({"key": keys.astype(np.int32), "id": b["id"].to_numpy()[rows], "fp": b["fp"].to_numpy()[rows]})

    # A small table of nodes grows many times over here, so it is dealt to all tasks.
    tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return nodes.select("id", "fp").repartition(tasks, "id").mapInPandas(keyed, "key int, id long, fp long")


def _near(a: str, b: str, max_bits: int) -> Column:
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError(f"the keys are proven for at most {MAX_BITS} bits")
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= max_bits


def links(nodes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(u, v) for all nodes (id, fp; fp distinct) whose fingerprints differ in at most max_bits bits."""
    k = _keyed(nodes)
    met = k.alias("a").hint("merge").join(k.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.id") < F.col("b.id")) & _near("a.fp", "b.fp", max_bits))
    return met.select(F.col("a.id").alias("u"), F.col("b.id").alias("v")).distinct()


def _joining(nodes: DataFrame, max_bits: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links of nodes (id, fp; fp distinct) to the least of their keys, the links between components of those, and the former's components."""
    k = materialize(_keyed(nodes), "keys")
    least = k.groupBy("key").agg(F.min(F.struct("id", "fp")).alias("c"), F.count("*").alias("n")).where("n > 1")
    stars = k.join(least, "key").select(F.col("c.id").alias("u"), F.col("id").alias("v"), "fp", F.col("c.fp").alias("to")).where((F.col("u") != F.col("v")) & _near("fp", "to", max_bits))
    some = materialize(stars.select("u", "v").distinct(), "links")
    first = components(some)
    told = first.select(F.col("node").alias("id"), F.col("component").alias("in"))
    now = materialize(k.join(told, "id", "left").withColumn("in", F.coalesce("in", "id")), "apart")
    # Only what links different components comes out of the join.
    met = now.alias("a").hint("merge").join(now.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.id") < F.col("b.id")) & (F.col("a.in") != F.col("b.in")) & _near("a.fp", "b.fp", max_bits))
    more = materialize(met.select(F.col("a.id").alias("u"), F.col("b.id").alias("v")).distinct(), "links")
    for used in (k, now):
        discard(used)
    return some, more, first


def linked(nodes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(node, component) of all linked nodes (id, fp; fp distinct), without making all links of a family."""
    some, more, first = _joining(nodes, max_bits)
    found = first if more.isEmpty() else components(some.union(more))
    for used in (some, more):
        discard(used)
    return found


def joining(nodes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(u, v): some of the links of nodes (id, fp; fp distinct), enough for the components of them all."""
    some, more, _ = _joining(nodes, max_bits)
    return some.union(more)


def groups(docs: DataFrame, width: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp long, component_id) of each row of docs (doc_id, text)."""
    small_batches(docs.sparkSession)
    prints = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprints(F.col("text"), width).alias("fp")), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = linked(nodes.select(F.col("fp").alias("id"), "fp"), max_bits).withColumnRenamed("node", "fp")
    named = nodes.join(found, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("group"))
    ids = named.groupBy("group").agg(F.min("least").alias("component_id"))
    return prints.join(named.join(ids, "group").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def hexadecimal(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def one_of_each(docs: DataFrame, width: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """docs with one row of each group: the one whose id is its component's; rows without id go."""
    kept = groups(docs, width, max_bits).where("doc_id = component_id").select("doc_id").distinct()
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("told"), F.struct(*docs.columns).alias("row")).where("doc_id is not null")
    return whole.groupBy("doc_id").agg(F.min_by("row", "told").alias("row")).join(kept, "doc_id", "left_semi").select("row.*")
