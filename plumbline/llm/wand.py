"""Ranked lexical search by Block-Max WAND over an index of document segments.

Building: each task cuts its documents into segments of at most SEGMENT_TERMS terms or SEGMENT_DOCS
documents, numbers a segment's documents by rising length, and writes a row for each term of the
segment. A row holds the term's postings in blocks of BLOCK documents, each compressed to gaps and
counts in variable-length bytes, and for every block, outside the compressed bytes, its last document
and its greatest impact. No text and no posting is shuffled to build it.

Searching: rows of terms that queries hold meet their segment once for each block of QUERIES queries.
There a query's shallow pointers move over the ranges between block ends of its terms: the sum of
weighted block maxima bounds every document of a range. Ranges are taken by falling bound; a range
below the threshold (the score of the last of the best so far) is skipped, and a block is decompressed
only when a range that it covers is reached. As documents lie by length, blocks of long ones have low
maxima. The best of each segment then meet by query.

All terms of all documents are indexed; scores are exact. A task holds one segment's postings of one
block of queries, which SEGMENT_TERMS bounds, whatever the size of the table or how frequent a word is.

Defined results: a null or termless text counts for nothing; a null id ranks last among equal scores;
repeated documents rank each on its own; queries that repeat with the same id and text are one query,
with the same id and other text each their own; queries without any known term have no rows; an empty
table gives no rows; texts of any length are indexed whole (a document is never cut between segments);
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from plumbline.llm.common import discard, materialize

#: Postings of a block; terms (with repeats) and documents of a segment; queries that a task answers at once.
BLOCK, SEGMENT_TERMS, SEGMENT_DOCS, QUERIES = 128, 1 << 22, 1 << 16, 512
#: Fixed values of the ranking: damping of counts and of lengths, out of UNIT; scale of an impact and of a weight.
LENGTH_SHARE, UNIT, SCALE, DAMP, WEIGHT = 75, 100, 1_000_000_000, 8, 1000
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
INDEX = "segment long, term string, docs int, lasts array<int>, impacts array<int>, ends array<int>, postings binary, doc_ids array<long>, lengths array<int>"
#: Ranges reached before the threshold is first raised (then four times as many each time); the id under which a null one sorts.
STEP, LAST = 16, (1 << 63) - 1
#: The term of the row that holds a segment's documents; no term is empty.
DOCUMENTS = ""

_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """Terms of a UTF-8 text in order: all that isn't an ASCII letter, digit or beyond ASCII parts them."""
    return text.translate(_LETTERS).split() if text else []


def term_column(text: Column) -> Column:
    """terms() in built-in expressions."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(low, F.lit(f"({TERM})"))


def impact(tf, length, n: int, total: int):
    """What a term adds to a document for each unit of its weight."""
    m = UNIT - LENGTH_SHARE + (LENGTH_SHARE * length * n) // total
    return (SCALE * tf) // (1000 * tf + DAMP * m)


def weight(n: int, df: int) -> int:
    return math.floor(WEIGHT * math.log((2 * n + 2) / (2 * df + 1)))


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, end of each value) of non-negative values, seven bits a byte, the last byte marked."""
    size = np.ones(len(values), np.int64)
    for bits in (7, 14, 21, 28):
        size += values >= 1 << bits
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(5):
        has = size > k
        out[ends[has] - 1 - k] = (values[has] >> (7 * k)) & 127
    out[ends - 1] |= 128
    return out, ends


def unpacked(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    last = np.flatnonzero(b & 128)
    first = np.append(0, last[:-1] + 1)
    value = np.zeros(len(last), np.int64)
    for k in range(int((last - first).max(initial=0)) + 1):
        at = first + k
        has = at <= last
        value[has] = (value[has] << 7) | (b[at[has]] & 127)
    return value


class Segment:
    """Documents of one segment while it is built."""

    def __init__(self, n: int, total: int):
        self.n, self.total = n, total
        self.vocabulary: defaultdict[bytes, int] = defaultdict()
        self.vocabulary.default_factory = self.vocabulary.__len__
        self.ids: list[int | None] = []
        self.tokens: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id: int | None, text: bytes) -> None:
        if found := terms(text):
            self.ids.append(doc_id)
            self.tokens.append(np.fromiter(map(self.vocabulary.__getitem__, found), np.int32, len(found)))
            self.size += len(found)

    def full(self) -> bool:
        return self.size >= SEGMENT_TERMS or len(self.ids) >= SEGMENT_DOCS

    def rows(self, number: int) -> pa.RecordBatch:
        lengths = np.array([len(t) for t in self.tokens], np.int64)
        order = np.argsort(lengths, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        names = sorted(self.vocabulary)
        place = np.empty(len(names), np.int64)
        place[[self.vocabulary[t] for t in names]] = np.arange(len(names))
        docs = len(order)
        keys, tf = np.unique(place[np.concatenate(self.tokens)] * docs + np.repeat(rank, lengths), return_counts=True)
        term, doc = keys // docs, keys % docs
        starts = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
        count = np.diff(np.append(starts, len(term)))
        within = np.arange(len(term)) - np.repeat(starts, count)
        gap = np.where(within == 0, doc, np.append(0, doc[1:] - doc[:-1]))
        heads = np.flatnonzero(within % BLOCK == 0)
        tails = np.append(heads[1:], len(term)) - 1
        gap[heads] = doc[heads]  # a block can be read alone
        strength = impact(tf, lengths[order][doc], self.n, self.total)
        data, ends = packed(np.column_stack([gap, tf]).ravel())
        upto = ends[2 * tails + 1]
        blocks = -(-count // BLOCK)
        upper = np.cumsum(blocks)
        base = np.append(0, upto[upper - 1])
        listed = pa.array(np.append(0, upper), pa.int32())
        documents = pa.RecordBatch.from_pydict(
            {
                "segment": pa.array([number], pa.int64()),
                "term": pa.array([DOCUMENTS]),
                "docs": pa.array([docs], pa.int32()),
                **{k: pa.array([None], pa.list_(pa.int32())) for k in ("lasts", "impacts", "ends")},
                "postings": pa.array([None], pa.binary()),
                "doc_ids": pa.array([[self.ids[k] for k in order]], pa.list_(pa.int64())),
                "lengths": pa.array([lengths[order]], pa.list_(pa.int32())),
            }
        )
        each = pa.RecordBatch.from_pydict(
            {
                "segment": pa.array(np.full(len(names), number)),
                "term": pa.array([t.decode() for t in names], pa.string()),
                "docs": pa.array(count, pa.int32()),
                "lasts": pa.ListArray.from_arrays(listed, pa.array(doc[tails], pa.int32())),
                "impacts": pa.ListArray.from_arrays(listed, pa.array(np.maximum.reduceat(strength, heads), pa.int32())),
                "ends": pa.ListArray.from_arrays(listed, pa.array(upto - np.repeat(base[:-1], blocks), pa.int32())),
                "postings": pa.Array.from_buffers(pa.binary(), len(names), [None, pa.py_buffer(base.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())]),
                "doc_ids": pa.nulls(len(names), pa.list_(pa.int64())),
                "lengths": pa.nulls(len(names), pa.list_(pa.int32())),
            }
        )
        return pa.Table.from_batches([documents, each]).combine_chunks().to_batches()[0]


def statistics(texts: DataFrame) -> tuple[int, int]:
    """(documents with a term, their terms with repeats) of texts (text binary)."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0
        for b in batches:
            sizes = [len(terms(t)) for t in b.column(0).to_pylist()]
            n, total = n + sum(map(bool, sizes)), total + sum(sizes)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total])], ["n", "total"])

    found = texts.mapInArrow(counted, "n long, total long").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
    return found.n or 0, found.total or 0


def index(docs: DataFrame) -> tuple[DataFrame, int, int]:
    """(index, documents with a term, their terms) of docs (doc_id, text), written to the shared folder."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.withColumn("text", F.col("text").cast("binary"))
    n, total = statistics(texts.select("text"))

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId() << 24, 0
        now = Segment(n, total)
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                now.add(doc_id, text)
                if now.full():
                    yield now.rows(part + made)
                    made, now = made + 1, Segment(n, total)
        if now.ids:
            yield now.rows(part + made)

    return materialize(texts.mapInArrow(built, INDEX), "index"), n, total


class Postings:
    """A term's postings in one segment: block ends and maxima at hand, blocks decompressed when first reached."""

    def __init__(self, row: dict, lengths: np.ndarray, n: int, total: int):
        self.lasts, self.impacts = np.array(row["lasts"], np.int64), np.append(np.array(row["impacts"], np.int64), 0)
        self.ends, self.data = [0, *row["ends"]], row["postings"]
        self.lengths, self.n, self.total = lengths, n, total
        self.open = np.zeros(len(self.lasts), bool)
        # Postings of blocks that are still closed fall to a place behind the last document.
        self.docs, self.gains = np.full(row["docs"], len(lengths), np.int64), np.zeros(row["docs"], np.int64)

    def read(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents, impacts) of at least these blocks."""
        for k in blocks[~self.open[blocks]]:
            values = unpacked(self.data[self.ends[k] : self.ends[k + 1]])
            docs, at = np.cumsum(values[::2]), slice(k * BLOCK, (k + 1) * BLOCK)
            self.docs[at], self.gains[at], self.open[k] = docs, impact(values[1::2], self.lengths[docs], self.n, self.total), True
        upto = slice(blocks[0] * BLOCK, (blocks[-1] + 1) * BLOCK)
        return self.docs[upto], self.gains[upto]


def best(lists: list[tuple[int, Postings]], ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(local documents, scores) of the most best documents of a segment for one query of (weight, postings)."""
    cuts = np.unique(np.concatenate([p.lasts for _, p in lists]))  # a range runs from after the cut before it to its own
    walks = [(w, p, own, w * p.impacts[own]) for w, p, own in ((w, p, np.searchsorted(p.lasts, cuts)) for w, p in lists)]
    walks.sort(key=lambda x: -int(x[3].max()))
    bounds = np.sum([top for *_, top in walks], axis=0)
    range_of = np.searchsorted(cuts, np.arange(len(ids)))
    order = np.argsort(-bounds, kind="stable")
    docs, scores, held = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(ids) + 1, np.int64)
    threshold, at, step = 1, 0, STEP
    while at < len(order):
        reached = order[at : at + step]
        inside = np.zeros(len(cuts) + 1, bool)
        inside[reached[bounds[reached] >= threshold]] = True
        new = np.flatnonzero(inside[range_of])
        if not len(new):
            break
        sums, rest = np.zeros(len(new), np.int64), bounds
        for w, p, own, top in walks:
            # A document stays while what it has and the maxima of the terms still to come may reach the threshold.
            rest = rest - top
            blocks = np.unique(own[range_of[new]])
            if blocks[-1] == len(p.lasts):
                blocks = blocks[:-1]
            if len(blocks):
                here, gains = p.read(blocks)
                held[here] = w * gains
                sums = sums + held[new]
                held[here] = 0
            may = sums + rest[range_of[new]] >= threshold
            new, sums = new[may], sums[may]
            if not len(new):
                break
        docs, scores = np.append(docs, new), np.append(scores, sums)
        keep = np.lexsort((ids[docs], -scores))[:most]
        docs, scores = docs[keep], scores[keep]
        if len(keep) == most:
            threshold = int(scores[-1])
        at, step = at + step, step * 4
    return docs, scores


def search(docs: DataFrame, queries: DataFrame, most: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the most best of docs (doc_id, text) for each of queries (item_id, text)."""
    table, n, total = index(docs)
    asked = queries.select("item_id", "text").distinct().select("item_id", F.xxhash64("text").alias("query"), "text")
    blocks = -(-asked.count() // QUERIES) or 1
    uses = asked.select("item_id", "query", F.explode(term_column(F.col("text"))).alias("term")).groupBy("item_id", "query", "term").agg(F.count("*").alias("times"))
    # Written, so that its size is known when the join is planned: few terms are broadcast, many meet the index in a shuffle.
    uses = materialize(uses, "terms")
    frequency = table.join(uses.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("docs").alias("df"))
    gain = F.floor(F.lit(float(WEIGHT)) * F.ln(F.lit(2.0 * n + 2) / (2.0 * F.col("df") + 1)))
    block = F.pmod(F.xxhash64("item_id", "query"), F.lit(blocks)).cast("int")
    weighed = uses.join(frequency, "term").select("term", block.alias("block"), F.struct("item_id", "query", (gain * F.col("times")).alias("weight")).alias("use"))
    by_term = weighed.where("use.weight > 0").groupBy("term", "block").agg(F.collect_list("use").alias("uses"))
    nobody = F.array().cast(by_term.schema["uses"].dataType)
    everywhere = docs.sparkSession.range(blocks).select(F.lit(DOCUMENTS).alias("term"), F.col("id").cast("int").alias("block"), nobody.alias("uses"))
    met = table.join(by_term.unionByName(everywhere), "term")

    def answered(group: pa.Table) -> pa.Table:
        ids, lengths, wanted = np.zeros(0, np.int64), np.zeros(0, np.int64), defaultdict(list)
        rows = group.to_pylist()
        for r in rows:
            if r["term"] == DOCUMENTS:
                ids, lengths = np.array([LAST if k is None else k for k in r["doc_ids"]], np.int64), np.array(r["lengths"], np.int64)
        for r in rows:
            if r["term"] != DOCUMENTS:
                postings = Postings(r, lengths, n, total)
                for u in r["uses"]:
                    wanted[u["item_id"], u["query"]].append((u["weight"], postings))
        out: list[tuple] = []
        for (item, query), lists in wanted.items():
            found, scores = best(lists, ids, most)
            out += [(item, query, None if d == LAST else d, s) for d, s in zip(ids[found].tolist(), scores.tolist(), strict=True)]
        columns = list(zip(*out, strict=True)) or [()] * 4
        return pa.table([pa.array(c, t) for c, t in zip(columns, (item_type, pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["item_id", "query", "doc_id", "score"])

    item = queries.schema["item_id"].dataType
    item_type = to_arrow_type(item)
    found = met.groupBy("segment", "block").applyInArrow(answered, f"item_id {item.simpleString()}, query long, doc_id long, score long")
    order = Window.partitionBy("item_id", "query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    out = materialize(ranked.select("item_id", "rank", "doc_id", "score"), "ranked")
    discard(table)
    discard(uses)
    return out
