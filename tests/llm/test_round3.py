"""Archives, ranked search and whitening against brute force, round trips and edge cases."""

import base64
import collections
import hashlib
import io
import math
import os
import random
import re

import duckdb
import numpy as np
import pyarrow.fs
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import queries, wand, warc, whitening

SMALL = "/root/testdata/sf0.001"
EXTRA = "label string, row string, n long, segment string, digest string, response string, rank string, query string, score string, docs string"
CLASHING = ("x",) * 2 + (1,) + ("x",) * 7


def by_sql(name):
    con = duckdb.connect()
    for t in os.listdir(SMALL):
        con.execute(f"create view {t.split('.')[0]} as select * from '{SMALL}/{t}'")
    return con.execute(queries.oracle_sql()[name]).df()


def plain_rows(frame, columns):
    return sorted(map(str, frame[columns].astype(object).where(frame[columns].notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", ["op11_dictionary_warc", "op12_block_max_wand"])
def test_query_equals_its_sql(spark, name):
    got, want = queries.queries()[name](spark, SMALL).toPandas(), by_sql(name)
    assert sorted(got.columns) == sorted(want.columns)
    assert plain_rows(got, sorted(got.columns)) == plain_rows(want, sorted(got.columns))


# Archives


def expected_pages(rows):
    by = collections.defaultdict(list)
    for page, url, html in rows:
        by[(html or "").encode()].append(page)
    out = []
    for payload, ids in by.items():
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        ids = sorted(ids, key=lambda k: -(2**63) if k is None else k)
        out += [(ids[-1], len(payload), digest, "response", None)] + [(k, len(payload), digest, "revisit", ids[-1]) for k in ids[:-1]]
    return sorted(out, key=repr)


def page_rows():
    long = "".join(random.Random(3).choices("abc <p>", k=3_000_000))
    html = ["<p>a", "<p>a", "<p>a", None, "", "é\r\n\r\nWARC/1.1\r\n", long, long + "x", "<p>a"]
    rows = [(k, (None, "http://a/\r\nX: y é", "http://b")[k % 3], h) for k, h in enumerate(html)]
    return rows + [rows[0], rows[6], (None, None, None), (None, "u", "only"), (None, "u", "<p>a")]


def test_archives_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE", 1 << 20)
    monkeypatch.setattr(warc, "TRAINED", 1 << 16)
    schema = f"page_id long, url string, html string, {EXTRA}"
    pages = spark.createDataFrame([r + CLASHING for r in page_rows()], schema)
    archives = warc.write(pages, warc.archive_folder(spark))
    got = sorted((tuple(r) for r in warc.read(archives).collect()), key=repr)
    assert got == expected_pages(page_rows())
    assert sum(r.records for r in archives.collect()) == len(page_rows())
    assert not warc.read(warc.write(pages.limit(0), warc.archive_folder(spark))).collect()


def test_small_payloads_are_all_responses_and_hot_ones_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(warc, "HOT_SHARE", 3)
    monkeypatch.setattr(warc, "HOT_LEAST", 2)
    pages = spark.createDataFrame([(k, "u", "same" if k % 2 else f"page {k % 12}") for k in range(60)], "page_id long, url string, html string")
    got = warc.read(warc.write(pages, warc.archive_folder(spark), least=5)).collect()
    assert {r.record_type for r in got if r.payload_bytes < 5} == {"response"} and len(got) == 60
    assert sorted(r.page_id for r in got if r.record_type == "response" and r.payload_bytes >= 5) == [48, 50, 52, 54, 56, 58]
    every = warc.read(warc.write(pages, warc.archive_folder(spark))).collect()
    assert sorted((tuple(r) for r in every), key=repr) == expected_pages([tuple(r) for r in pages.collect()])


def test_archive_follows_its_format(spark):
    """A leading skippable frame holds the dictionary; each record is a frame that only the dictionary opens."""
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    archives = warc.write(pages.coalesce(1), warc.archive_folder(spark)).collect()
    for a in archives:
        fs, name = pyarrow.fs.FileSystem.from_uri(a.path)
        data = fs.open_input_file(name).read()
        assert int.from_bytes(data[:4], "little") == 0x184D2A5D and len(data) == a.bytes
        size = int.from_bytes(data[4:8], "little")
        held = zstandard.ZstdDecompressor().decompress(data[8 : 8 + size])
        plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data[8 + size :]))
        with pytest.raises(zstandard.ZstdError):
            plain.read()
        whole = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held)).stream_reader(io.BytesIO(data), read_across_frames=True).read()
        assert whole == b"".join(warc.frames(a.path)) and whole.count(b"WARC/1.1\r\n") == a.records
    alone = sum(len(zstandard.ZstdCompressor(level=warc.LEVEL).compress(r)) for a in archives for r in warc.frames(a.path))
    assert sum(a.bytes for a in archives) < alone


# Ranked search


def tokens(text):
    return re.findall(wand.TERM, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def ranking(docs, items, most):
    """The contract, document by document."""
    counted = [(d, collections.Counter(tokens(t))) for d, t in docs if tokens(t)]
    n, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = collections.Counter(t for _, c in counted for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        found = []
        for d, c in counted:
            m = 100 - 75 + (75 * sum(c.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in tokens(text) if t in c)
            if score > 0:
                found.append((-score, d is None, d))
        out += [(item, k + 1, d, -s) for k, (s, _, d) in enumerate(sorted(found, key=lambda f: (f[0], f[1], f[2] or 0))[:most])]
    return sorted(out, key=repr)


def test_ranking_equals_brute_force(spark, monkeypatch):
    """Small blocks and segments, frequent and rare words, ties, repeats, nulls, several blocks of queries."""
    for name, value in (("BLOCK", 4), ("SEGMENT_TERMS", 3_000), ("QUERIES", 3), ("STEP", 1)):
        monkeypatch.setattr(wand, name, value)
    r = random.Random(5)
    words = ["The", "the", "été", "x1", "of"] + [f"w{k}" for k in range(60)]
    docs = [(k, " ".join(r.choices(words, [9, 9, 5, 5, 9] + [1] * 60, k=r.choice((1, 5, 40, 90))))) for k in range(400)]
    docs += [(1000 + k, "the of w1 w2 w3") for k in range(50)] + [(None, "w5 w6 w7"), (7, "w5 w6 w7"), (7, "w8"), (8, None), (9, ""), (10, " .,-")]
    docs.append((11, "longest w9 " * 20_000))
    items = [(1, "the of w1"), (2, "W5, w6! w7 w5"), (3, "nowhere at all"), (4, None), (5, ""), (6, "été-x1 the"), (6, "w8"), (6, "w8"), (7, "longest"), (None, "w9 w10")]
    frame = spark.createDataFrame([d + CLASHING for d in docs], f"doc_id long, text string, {EXTRA}").repartition(3)
    asked = spark.createDataFrame([i + CLASHING for i in items], f"item_id long, text string, {EXTRA}")
    got = wand.search(frame, asked, 7).collect()
    assert sorted((tuple(g) for g in got), key=repr) == ranking(docs, items, 7)
    assert not wand.search(frame.limit(0), asked).collect() and not wand.search(frame, asked.limit(0)).collect()


@settings(deadline=None, max_examples=50)
@given(st.lists(st.integers(0, 2**31 - 1), min_size=1, max_size=300))
def test_packed_values_come_back(values):
    data, ends = wand.packed(np.array(values, np.int64))
    assert wand.unpacked(data.tobytes()).tolist() == values and ends[-1] == len(data)


@settings(deadline=None, max_examples=100)
@given(st.text())
def test_terms_equal_the_pattern(text):
    assert [t.decode() for t in wand.terms(text.encode("utf-8", "ignore"))] == tokens(text.encode("utf-8", "ignore").decode())


def test_blocks_below_the_threshold_stay_compressed():
    """One document outweighs all: once it is found, blocks without it are never opened."""
    segment = wand.Segment(8000, 20_000)
    for k in range(8000):
        segment.add(k, b"common rare rare rare rare" if k == 77 else b"common " * (30 + k // 10))
    rows = segment.rows(0).to_pylist()
    lengths = np.array(rows[0]["lengths"], np.int64)
    lists = [(w, wand.Postings(next(r for r in rows if r["term"] == t), lengths, 8000, 20_000)) for t, w in (("common", 1), ("rare", 5000))]
    docs, scores = wand.best(lists, np.array(rows[0]["doc_ids"], np.int64), 1)
    assert rows[0]["doc_ids"][docs[0]] == 77 and scores[0] > 0
    assert lists[0][1].open.sum() < len(lists[0][1].open) / 2


# Whitening


def plain_whitening(vectors, k):
    x = np.floor(1024.0 * vectors.astype(np.float64)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    c = x - s / n
    values, turn = np.linalg.eigh(c.T @ c / n)
    values, turn = values[::-1][:k], turn[:, ::-1][:, :k]
    return ((n * x - s) ** 2).sum(axis=1), c @ turn / np.sqrt(values), values / (c * c).sum() * n


def check_whitening(frame, vectors, k):
    far, w, explained = plain_whitening(vectors, k)
    got = whitening.whiten(frame, k).toPandas().sort_values(["vec_id", "component"])
    assert got.vec_id.tolist() == np.repeat(np.arange(len(vectors)), k).tolist() and (got.n == len(vectors)).all()
    assert got.deviation.tolist() == np.repeat(far, k).tolist()
    mine = got.whitened.to_numpy().reshape(-1, k)
    mine *= np.sign((mine * w).sum(axis=0))
    assert np.abs(mine - w).max() < 1e-8
    assert np.allclose(got.explained.to_numpy().reshape(-1, k)[0], explained, rtol=1e-10)
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9


def test_whitening_of_the_table_equals_eigenvectors(spark):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet").orderBy("vec_id")
    check_whitening(table, np.array([r.embedding for r in table.collect()]), 8)
    assert whitening.fit(table).expanded


def test_whitening_of_a_falling_spectrum_needs_no_expansion(spark):
    r = np.random.default_rng(1)
    vectors = (r.standard_normal((600, 40)) * 4.0 ** -np.arange(40) * 300) @ np.linalg.qr(r.standard_normal((40, 40)))[0]
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    model = whitening.fit(frame, 3)
    assert not model.expanded and model.passes <= whitening.POWER + 1
    check_whitening(frame, vectors, 3)


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [1.0], [1.0, None, 2.0], [nan, 1.0, 2.0], [1.0, inf, 2.0], [1e300, 0.0, 0.0]]
    good = [[0.1, 0.2, 0.3], [0.1, 0.2, 0.3], [0.3, -0.2, 0.1], [0.0, 0.5, 0.0], [7e5, 0.1, 0.2]]
    rows = [(100 + k, v) + CLASHING for k, v in enumerate(odd)] + [(k if k else None, v) + CLASHING for k, v in enumerate(good)]
    schema = f"vec_id long, embedding array<double>, {EXTRA}"
    got = whitening.whiten(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 15 and {r.vec_id for r in got} == {None, 1, 2, 3, 4} and {r.n for r in got} == {5}
    x = [[math.floor(1024 * c) + 100_000 for c in v] for v in good]
    assert {r.deviation for r in got if r.vec_id == 4} == {sum((5 * a - sum(b)) ** 2 for a, b in zip(x[4], zip(*x), strict=True))}
    one = whitening.whiten(spark.createDataFrame([(1, [0.5, 0.5])] * 3, "vec_id long, embedding array<double>")).collect()
    assert len(one) == 6 and {(r.deviation, r.whitened, r.explained, r.identity_error) for r in one} == {(0, None, 0.0, 0.0)}
    assert not whitening.whiten(spark.createDataFrame(rows[:7], schema)).where("vec_id < 0").collect()
    assert not whitening.whiten(spark.createDataFrame([], schema)).collect()


def test_deviations_are_exact_up_to_a_long():
    x, n = np.array([[3_000_000_000, 0], [10, 0]]), 3
    s = (3_000_000_010, 0)
    assert whitening.deviations(x, n, s) == [None, sum((n * int(a) - b) ** 2 for a, b in zip(x[1], s, strict=True)) if (30 - 3_000_000_010) ** 2 < 1 << 63 else None]
    assert whitening.deviations(np.array([[1 << 30]]), 2, (0,)) == [1 << 62]
    assert whitening.deviations(np.array([[1 << 49]]), 1 << 14, ((1 << 63) - 5,)) == [25]
