"""Packing along a space-filling curve.

Each document's hashed byte n-gram vector is projected to a few dimensions, the point's Hilbert
key is the sort key of a range partitioning, and each range is filled into sequences in key order,
so that a sequence holds neighbouring documents. The ranges hold equal bytes, as far as a sample of
keys tells, and their number follows from the bytes alone, so that padding doesn't depend on settings; a key that fills several ranges (many equal texts) is dealt to all of them in turn,
which keeps the order. One shuffle moves the texts; the tokens never move. Neighbouring copies of a
row, as mixing leaves them, travel as one row with a count. Only the last sequence of a range can be
short.

Defined results: a null text counts as empty (one piece with the end id); a null id is kept;
repeated rows are packed each on its own; equal keys go by id and text; texts of any length are
packed whole; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import small_batches

BUCKETS, DIMS, BITS, BLOCK = 2048, 3, 10, 1 << 20
#: Sampled rows, in expectation, from which the ranges' ends are told: one in SAMPLED, at least and at most so many; most copies that travel as one row.
SAMPLED, SAMPLED_LEAST, SAMPLED_MOST, RUN = 128, 1 << 14, 1 << 22, 64
#: Bytes of a range: at least some five hundred sequences, so that short last ones are few; more where there would be over so many ranges, up to so many bytes.
RANGE, RANGES, RANGE_MOST = 2 << 20, 4096, 512 << 20

#: Piece rows of a packing.
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def ngram_counts(data: bytes, width: int, buckets: int) -> np.ndarray:
    """Counts of all byte n-grams of that width (at most 4), hashed to buckets (a power of two)."""
    shift = np.uint32(32 - (buckets.bit_length() - 1))
    total = np.zeros(buckets, np.int64)
    for at in range(0, max(len(data) - width + 1, 0), BLOCK):
        b = np.frombuffer(data, np.uint8, min(BLOCK + width - 1, len(data) - at), at).astype(np.uint32)
        n = len(b) - width + 1
        gram = b[:n].copy()
        for k in range(1, width):
            gram |= b[k : k + n] << np.uint32(8 * k)
        gram *= np.uint32(2654435761)
        gram ^= gram >> np.uint32(15)
        gram *= np.uint32(2246822519)
        total += np.bincount(gram >> shift, minlength=buckets)
    return total


def hilbert_key(points: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of integer points (rows) with that many bits a dimension."""
    x = points.astype(np.uint64).T.copy()
    dims = len(x)
    one = np.uint64(1)
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations, from the highest bit
        low = np.uint64(q - 1)
        for i in range(dims):
            inverted = (x[i] & np.uint64(q)) != 0
            swap = np.where(inverted, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(inverted, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.uint64)
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[dims - 1] & np.uint64(q)) != 0, np.uint64(q - 1), np.uint64(0))
        q >>= 1
    x ^= flip
    key = np.zeros(x.shape[1], np.uint64)
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << one) | ((x[i] >> np.uint64(bit)) & one)
    return key.astype(np.int64)


def curve_keys(texts: list[str | None]) -> np.ndarray:
    """Hilbert keys of texts: damped, unit-length hashed 4-gram vectors, randomly projected."""
    directions = np.random.default_rng(20).standard_normal((BUCKETS, DIMS))
    directions -= directions.mean(axis=0)
    points = np.zeros((len(texts), DIMS))
    for k, text in enumerate(texts):
        v = np.sqrt(ngram_counts((text or "").encode("utf-8", "replace"), 4, BUCKETS))
        norm = np.sqrt(v @ v)
        points[k] = (v / norm) @ directions if norm else 0.0
    unit = 0.5 + 0.5 * np.tanh(points)
    return hilbert_key(np.minimum((unit * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)


class Encoder:
    """Token ids as the vocabulary file gives them.

    Plain Latin texts go through the same vocabulary's rank table, which is several times as fast;
    texts with special tokens or with letters beyond Latin go to the tokenizer itself.
    """

    _unusual = re.compile("[^\\n\x20-~\xa1-\u024f\u2010-\u2027\u20ac]")

    def __init__(self, vocabulary: str):
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(vocabulary)
        self._special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        with open(vocabulary.removesuffix(".json") + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._ranks = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self._unusual.search(text) or any(t in text for t in self._special):
            return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        return self._ranks.encode_to_numpy(text, disallowed_special=())


_ENCODERS: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = Encoder(vocabulary)
    return _ENCODERS[vocabulary]


def _fill(batches: Iterator[pa.RecordBatch], vocabulary: str, length: int, end_id: int) -> Iterator[pa.RecordBatch]:
    encode = encoder(vocabulary).ids
    sequence, used = TaskContext.get().partitionId() << 40, 0
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    for batch in batches:
        rows: list[tuple] = []
        for doc_id, text, copies in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "copies")), strict=True):
            ids = np.append(encode(text or ""), np.uint32(end_id)).astype("<u4")
            for _ in range(copies):
                start = 0
                while start < len(ids):
                    take = min(length - used, len(ids) - start)
                    crc = zlib.crc32(ids[start : start + take].tobytes())
                    rows.append((doc_id, start, take, crc, len(ids), sequence, used))
                    start, used = start + take, used + take
                    if used == length:
                        sequence, used = sequence + 1, 0
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * len(names), names)


def ranges_of(size: float) -> int:
    """How many ranges texts of that many bytes make, whatever the session's settings."""
    return max(1, math.ceil(size / min(RANGE_MOST, max(RANGE, size / RANGES))))


def _ends(texts: DataFrame) -> np.ndarray:
    """Keys at which ranges of equal bytes end, all but the last; from a bounded sample, which tells the bytes of all as well."""

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(curve_keys(own), pa.int64()), pa.array([len(t or "") + 16 for t in own], pa.int64())], ["curve", "size"])

    n = texts.count()
    share = min(SAMPLED_MOST, max(SAMPLED_LEAST, n / SAMPLED)) / max(1, n)
    some = texts.sample(share, 1) if share < 1 else texts
    found = some.select("text").mapInArrow(weighed, "curve long, size long").toPandas().sort_values("curve")
    if not len(found):
        return np.zeros(0, np.int64)
    upto = found["size"].cumsum().to_numpy()
    tasks = ranges_of(upto[-1] / min(1.0, share))
    return found["curve"].to_numpy()[np.searchsorted(upto, upto[-1] * np.arange(1, tasks) / tasks)]


def _ranges(keys: np.ndarray, ends: np.ndarray, seen: int) -> np.ndarray:
    """The range of each key; a key that ends ranges goes to all that may hold it in turn."""
    first, last = np.searchsorted(ends, keys, "left"), np.searchsorted(ends, keys, "right")
    return first + (seen + np.arange(len(keys))) % (last - first + 1)


def _runs(ids: list, texts: list) -> tuple[list[int], list[int]]:
    """Places of the first of equal neighbours, and how many there are, RUN at most."""
    firsts: list[int] = []
    counts: list[int] = []
    for k, row in enumerate(zip(ids, texts, strict=True)):
        if firsts and counts[-1] < RUN and row == (ids[firsts[-1]], texts[firsts[-1]]):
            counts[-1] += 1
        else:
            firsts.append(k)
            counts.append(1)
    return firsts, counts


def pack(docs: DataFrame, vocabulary: str, length: int = 1024, end_id: int = 0) -> DataFrame:
    """Pieces of all documents (doc_id, text) in sequences of at most length tokens."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ends = _ends(texts)
    tasks = len(ends) + 1

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for b in batches:
            own, texts_ = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
            firsts, counts = _runs(own, texts_)
            keys = curve_keys([texts_[k] for k in firsts])
            ranges = _ranges(keys, ends, seen)
            seen += len(keys)
            one = b.take(pa.array(firsts, pa.int32()))
            yield pa.RecordBatch.from_arrays([one.column("doc_id"), one.column("text"), pa.array(counts, pa.int32()), pa.array(keys, pa.int64()), pa.array(ranges, pa.int32())], ["doc_id", "text", "copies", "curve", "part"])

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _fill(batches, vocabulary, length, end_id)

    along = texts.mapInArrow(keyed, "doc_id long, text string, copies int, curve long, part int").repartitionById(tasks, "part")
    return along.sortWithinPartitions("curve", "doc_id", F.crc32(F.col("text").cast("binary"))).select("doc_id", "text", "copies").mapInArrow(filled, SCHEMA)
