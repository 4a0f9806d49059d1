"""Context-triggered piecewise hashing of whole texts.

A rolling hash over seven bytes ends a chunk wherever its low bits are all ones; each chunk gives
one of 64 letters. The block size is the power of two that gives 32 to 64 chunks, and a fingerprint
holds the signatures at that size and at its double ("size:signature:signature"). Fingerprints are
compared where their block sizes agree or differ by a factor of two, by edit distance; signatures
without a common run of letters are unlike (0).

The next document of each is the one with the next smaller id. Texts are sorted over the cluster in
descending order of ids, each task carries the one document whose next is to come from row to row,
and the ends of the tasks are joined afterwards on the tasks' numbers: of every task its first and
last document. Nothing else leaves a task, and nothing goes to the driver.

Defined results: a null text is empty; the empty text's fingerprint is "4::" and is like itself
only; a null id sorts after all others; rows with the same id follow each other by their text's
hash, copies of a row by their place in the input, so that no id or row need stay in one task; one
row is its own next; texts of any length are read whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import materialize, small_batches

WINDOW, LETTERS, LEAST_BLOCK, SHARED = 7, 64, 4, 5
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
SLICE = 1 << 20

def _triggers(data: bytes, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Chunk ends at that block size (a power of two), and the rolling hash there."""
    ends, hashes, mask = [], [], np.uint32(block - 1)
    padded = bytes(WINDOW - 1) + data
    for at in range(0, len(data), SLICE):
        b = np.frombuffer(padded, np.uint8, min(SLICE, len(data) - at) + WINDOW - 1, at).astype(np.uint32)
        n = len(b) - WINDOW + 1
        h = b[WINDOW - 1 :].copy()
        for k in range(1, WINDOW):
            h += b[WINDOW - 1 - k : WINDOW - 1 - k + n] * np.uint32(pow(0x01000193, k, 1 << 32))
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(13)
        hit = np.flatnonzero((h & mask) == mask)
        ends.append(hit + (at + 1))
        hashes.append(h[hit])
    if not ends:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    return np.concatenate(ends), np.concatenate(hashes)


def _signature(data: memoryview, ends: np.ndarray) -> str:
    """A letter for each chunk; the last letter of a full signature takes all that is left."""
    cuts = [0, *ends[: LETTERS - 1].tolist()]
    if not len(data):
        return ""
    if cuts[-1] < len(data):
        cuts.append(len(data))
    crcs = np.array([zlib.crc32(data[s:e]) for s, e in zip(cuts, cuts[1:], strict=False)], np.uint32)
    return ALPHABET[(crcs * np.uint32(0x9E3779B1)) >> np.uint32(26)].tobytes().decode()


def fingerprint(text: str) -> str:
    data = text.encode("utf-8", "replace")
    block = LEAST_BLOCK
    while block * LETTERS < len(data):
        block *= 2
    low = max(LEAST_BLOCK, block // 2)
    ends, hashes = _triggers(data, low)
    while True:
        here = ends[(hashes & np.uint32(block - 1)) == block - 1]
        if len(here) >= LETTERS // 2 or block == LEAST_BLOCK:
            break
        block //= 2
        if block < low:
            low = block
            ends, hashes = _triggers(data, low)
    double = ends[(hashes & np.uint32(2 * block - 1)) == 2 * block - 1]
    view = memoryview(data)
    return f"{block}:{_signature(view, here)}:{_signature(view, double)}"


def edit_distances(pairs: list[tuple[str, str]]) -> np.ndarray:
    """Levenshtein distances of pairs of strings of at most 64 ASCII letters, bit-parallel over all pairs."""
    n = len(pairs)
    one, zero = np.uint64(1), np.uint64(0)
    a_len = np.array([len(a) for a, _ in pairs], np.int64)
    b_len = np.array([len(b) for _, b in pairs], np.int64)
    a = np.zeros((n, LETTERS), np.uint8)
    b = np.zeros((n, LETTERS), np.uint8)
    for k, (x, y) in enumerate(pairs):
        a[k, : len(x)] = np.frombuffer(x.encode(), np.uint8)
        b[k, : len(y)] = np.frombuffer(y.encode(), np.uint8)
    match = np.zeros((n, 128), np.uint64)
    every = np.arange(n)
    for k in range(int(a_len.max(initial=0))):
        rows = every[a_len > k]
        match[rows, a[rows, k]] |= one << np.uint64(k)
    top = np.where(a_len > 0, one << np.maximum(a_len - 1, 0).astype(np.uint64), zero)
    up, down, score = np.full(n, ~zero), np.zeros(n, np.uint64), a_len.copy()
    for k in range(int(b_len.max(initial=0))):
        live = b_len > k
        eq = match[every, b[:, k]]
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph, mh = down | ~(xh | up), up & xh
        score += np.where(live, ((ph & top) != 0).astype(np.int64) - ((mh & top) != 0).astype(np.int64), 0)
        ph, mh = (ph << one) | one, mh << one
        up, down = np.where(live, mh | ~(xv | ph), up), np.where(live, ph & xv, down)
    return np.where(a_len == 0, b_len, score)


def _share(a: str, b: str) -> bool:
    width = min(SHARED, len(a), len(b))
    if not width:
        return False
    grams = {a[k : k + width] for k in range(len(a) - width + 1)}
    return any(b[k : k + width] in grams for k in range(len(b) - width + 1))


def likeness(pairs: list[tuple[str, str]]) -> list[float]:
    """0 to 1 for each pair of fingerprints."""
    out, todo, owner = [0.0] * len(pairs), [], []
    for k, (x, y) in enumerate(pairs):
        if x == y:
            out[k] = 1.0
            continue
        (p, x1, x2), (q, y1, y2) = x.split(":"), y.split(":")
        p, q = int(p), int(q)
        for u, v in ((x1, y1), (x2, y2)) if p == q else ((x1, y2),) if p == 2 * q else ((x2, y1),) if q == 2 * p else ():
            if _share(u, v):
                todo.append((u, v))
                owner.append(k)
    if todo:
        for k, (u, v), d in zip(owner, todo, edit_distances(todo).tolist(), strict=True):
            out[k] = max(out[k], 1 - d / max(len(u), len(v)))
    return out


def edited(text: str, following: str) -> str:
    """The text with its last third (whole code points) replaced by as many first ones of the following text, or all."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
#: What a task gives: results, and the texts of its first and last document.
_PARTS = SCHEMA + ", part int, place string, text string"


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of all documents and their edited texts, with likenesses (see SCHEMA)."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("tie"))
    order = [F.desc("doc_id"), F.xxhash64("text"), F.col("tie")]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = texts.repartitionByRange(tasks, *order).sortWithinPartitions(*order).select("doc_id", "text")
    done = materialize(dealt.mapInArrow(_compare, _PARTS), "compared")
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return done.where("place = 'within'").select(names).unionByName(_across(done).select(names))


def _across(done: DataFrame) -> DataFrame:
    """The last document of each task with the first of the next task that has any; the last of all with the first of all."""
    ends = done.where("place <> 'within'")
    # A row for each task that has documents.
    parts = ends.where("place = 'last'").select("part")
    following = parts.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy(F.lit(0)))).alias("to"))
    last = ends.where("place = 'last'").join(following, "part").select("to", "doc_id", "text", "fingerprint")
    first = ends.where("place = 'first'").select(F.col("part").alias("to"), F.col("text").alias("after"), F.col("fingerprint").alias("next"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [_row(*x) for x in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "fingerprint", "after", "next")), strict=True)]
            yield _table(rows, SCHEMA)

    return last.join(first, "to").select("doc_id", "text", "fingerprint", "after", "next").mapInArrow(joined, SCHEMA)


def _row(doc_id: int | None, text: str, own: str, after: str, following: str) -> tuple:
    """A result but for its likenesses, and the next fingerprint."""
    new = edited(text, after)
    return (doc_id, len(text), hashlib.sha256(new.encode("utf-8", "replace")).hexdigest(), own, fingerprint(new), following)


def _table(rows: list[tuple], schema: str, **more: list) -> pa.RecordBatch:
    near_edited = likeness([(r[3], r[4]) for r in rows])
    near_next = likeness([(r[3], r[5]) for r in rows])
    columns = [*([r[k] for r in rows] for k in range(5)), near_edited, near_next, *more.values()]
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}
    fields = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], [name for name, _ in fields])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    waiting: tuple | None = None  # the document whose next is to come: id, text, fingerprint

    def end(place: str, doc_id: int | None, text: str, own: str) -> pa.RecordBatch:
        fields = [c.split()[0] for c in _PARTS.split(", ")]
        values = {"doc_id": doc_id, "text": text, "fingerprint": own, "part": part, "place": place}
        return pa.RecordBatch.from_pylist([{f: values.get(f) for f in fields}], schema)

    schema = _table([], _PARTS, part=[], place=[], text=[]).schema
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            own = fingerprint(text)
            if waiting:
                rows.append(_row(*waiting, text, own))
            else:
                yield end("first", doc_id, text, own)
            waiting = (doc_id, text, own)
        yield _table(rows, _PARTS, part=[part] * len(rows), place=["within"] * len(rows), text=[None] * len(rows))
    if waiting:
        yield end("last", *waiting)
