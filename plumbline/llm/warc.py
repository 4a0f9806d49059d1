"""WARC archives whose records are Zstandard frames with a dictionary of the archive's own.

An archive begins with a skippable frame that holds its dictionary; each record follows as a frame of
its own, compressed with that dictionary, so that a reader can seek to any record. The dictionary is
built from the first records of the archive (TRAINED bytes of them, a bounded buffer); an archive with
too little to train on takes those records themselves as its dictionary.

Of pages with equal payloads (of at least a given size) that with the largest id becomes a response
record, the others become revisit records that name it and carry no payload. Payloads are compared by
SHA-1. An aggregation by digest leaves one payload each, merged within tasks before the shuffle, so
copies don't travel; roles are given to rows without payload. Digests held by more than one in HOT_SHARE
rows are at most HOT_SHARE in number: they are broadcast, all others joined.

Each task writes its records to archives of about ARCHIVE bytes of payload, under names that no other
attempt uses, and returns their names: the table of names is the commit. Archives of lost or repeated
attempts are in no table. Files are opened by URI through pyarrow, on any store that it knows.

Defined results: a null html is an empty payload; a null id ranks below all others and is written as no
header; of rows with the same id and payload one is the response; a null url is written as urn:none;
characters that may not stand in a header are percent-encoded; payloads of any length are written and
read whole, a record at a time; an empty table gives no records; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import urllib.parse
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import materialize, shared_dir

#: Fixed values of the format: magic number of the dictionary's frame, of a dictionary, of a compressed frame.
SKIPPABLE, DICTIONARY, FRAME = 0x184D2A5D, 0xEC30A437, 0xFD2FB528
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payload bytes of an archive; bytes of records and of a record that train its dictionary; bytes of the dictionary; level.
ARCHIVE, TRAINED, TRAINED_OF_ONE, DICTIONARY_BYTES, LEVEL = 128 << 20, 4 << 20, 64 << 10, 64 << 10, 3
#: Bytes that a reader takes at once.
READ = 64 << 10
#: Digests held by more rows than one in so many, and by more than so many, are dealt with apart.
HOT_SHARE, HOT_LEAST = 10_000, 100_000
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def header_value(text: str | None) -> str:
    """Text as one header value: controls, spaces, quotes of an id and all beyond ASCII percent-encoded."""
    return urllib.parse.quote(text, safe="!#$%&'()*+,/:;=?@[]~") if text else "urn:none"


def record_id(page: dict) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '{page_id} {url} {row}'.format(**page))}>"


def record(page: dict, payload: bytes, date: str) -> bytes:
    """One WARC record of a page (page_id, url, hex digest, size, response: its own or the row that it revisits)."""
    first = page["response"]
    revisits = page["revisits"]
    digest = base64.b32encode(bytes.fromhex(page["digest"])).decode()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {page['size']}\r\n\r\n".encode() + (b"" if revisits else payload)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisits else 'response'}",
        f"WARC-Record-ID: {record_id(page)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {header_value(page['url'])}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
    ]
    if page["page_id"] is not None:
        lines.append(f"X-Page-ID: {page['page_id']}")
    if revisits:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(first)}", f"WARC-Refers-To-Target-URI: {header_value(first['url'])}"]
        if first["page_id"] is not None:
            lines.append(f"X-Refers-To-Page-ID: {first['page_id']}")
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def trained(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary of records; the records themselves where they are too few to train on."""
    some = [s[:TRAINED_OF_ONE] for s in samples]
    size = max(256, min(DICTIONARY_BYTES, sum(map(len, some)) // 16))
    try:
        return zstandard.train_dictionary(size, some)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(some)[-size:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class Archive:
    """One archive while it is written: records wait until enough are there to train the dictionary."""

    def __init__(self, path: str):
        fs, name = pa.fs.FileSystem.from_uri(path)
        fs.create_dir(name.rsplit("/", 1)[0], recursive=True)
        self.path, self.out = path, fs.open_output_stream(name, compression=None)
        self.waiting: list[bytes] = []
        self.waits, self.payload, self.records, self.bytes = 0, 0, 0, 0
        self.compressor: zstandard.ZstdCompressor | None = None

    def add(self, data: bytes) -> None:
        self.payload += len(data)
        self.records += 1
        if self.compressor:
            self._write(self.compressor.compress(data))
            return
        self.waiting.append(data)
        self.waits += len(data)
        if self.waits >= TRAINED:
            self._begin()

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes += len(data)

    def _begin(self) -> None:
        dictionary = trained(self.waiting)
        held = zstandard.ZstdCompressor(level=LEVEL).compress(dictionary.as_bytes())
        self._write(struct.pack("<II", SKIPPABLE, len(held)) + held)
        dictionary.precompute_compress(level=LEVEL)
        self.compressor = zstandard.ZstdCompressor(dict_data=dictionary, write_checksum=True)
        for data in self.waiting:
            self._write(self.compressor.compress(data))
        self.waiting = []

    def close(self) -> tuple[str, int, int]:
        if not self.compressor:
            self._begin()
        self.out.close()
        return self.path, self.records, self.bytes


def frames(path: str) -> Iterator[bytes]:
    """Records of an archive in order, each decompressed alone; at most one record and a read-ahead are held."""
    fs, name = pa.fs.FileSystem.from_uri(path)
    with fs.open_input_stream(name, compression=None) as f:
        magic, size = struct.unpack("<II", f.read(8))
        if magic != SKIPPABLE:
            raise ValueError(f"{path} has no leading dictionary")
        held = f.read(size)
        if held[:4] == struct.pack("<I", FRAME):
            held = zstandard.ZstdDecompressor().decompress(held)
        kind = zstandard.DICT_TYPE_FULLDICT if held[:4] == struct.pack("<I", DICTIONARY) else zstandard.DICT_TYPE_RAWCONTENT
        reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held, dict_type=kind))
        left = b""
        while True:
            one, parts = reader.decompressobj(), []
            while not one.eof:
                left = left or f.read(READ)
                if not left:
                    if parts:
                        raise ValueError(f"{path} ends within a record")
                    return
                parts.append(one.decompress(left))
                left = one.unused_data if one.eof else b""
            yield b"".join(parts)


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers in lower case, block) of one record, checked against its length and block digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    block = rest[: int(headers["content-length"])]
    if lines[0] != "WARC/1.1" or len(rest) != len(block) + 4 or headers["warc-block-digest"] != f"sha1:{base32_sha1(block)}":
        raise ValueError(f"damaged record {headers.get('warc-record-id')}")
    return headers, block


def row_of(data: bytes) -> tuple[int | None, int, str, str, int | None]:
    """RECORDS of one record: a response's from its payload, a revisit's from its headers."""
    headers, block = parsed(data)
    head, _, payload = block.partition(b"\r\n\r\n")
    kind, digest = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:")
    size = int(next(line for line in head.decode().split("\r\n") if line.startswith("Content-Length: "))[16:])
    if kind == "response" and (len(payload), base32_sha1(payload)) != (size, digest):
        raise ValueError(f"damaged payload {headers['warc-record-id']}")
    number = {k: int(headers[k]) if k in headers else None for k in ("x-page-id", "x-refers-to-page-id")}
    return number["x-page-id"], size, digest, kind, number["x-refers-to-page-id"]


def roles(pages: DataFrame, least: int = 0) -> DataFrame:
    """Records to write: (page_id, url, digest, size, row, revisits, response, html), html for responses alone."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    whole = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.sha1(payload.cast("binary")).alias("digest"), payload.alias("html"))
    light = materialize(whole.select("page_id", "url", "digest", F.octet_length("html").cast("long").alias("size"), F.monotonically_increasing_id().alias("row")), "pages")
    order = F.struct(F.coalesce(F.col("page_id"), F.lit(-(1 << 63))).alias("least"), "row", "page_id", "url")
    last = light.groupBy("digest").agg(F.max(order).alias("response"), F.count("*").alias("copies"), F.first("size").alias("size"))
    last = materialize(last.where("copies > 1").select("digest", "copies", "size", F.col("response").dropFields("least").alias("response")), "copies")
    hot = F.col("copies") > F.lit(max(HOT_LEAST, light.count() // HOT_SHARE))
    shared = last.where(F.col("size") >= least).select("digest", "response", hot.alias("hot"))
    named = light.join(F.broadcast(shared.where("hot").select("digest", F.col("response").alias("hot_response"))), "digest", "left")
    cold = named.where("hot_response is null").join(shared.where("not hot").select("digest", F.col("response").alias("cold_response")), "digest", "left")
    both = cold.unionByName(named.where("hot_response is not null"), allowMissingColumns=True)
    response = F.coalesce("hot_response", "cold_response")
    known = both.select("page_id", "url", "digest", "size", "row", response.alias("response"), F.coalesce(F.col("row") != response["row"], F.lit(False)).alias("revisits"))
    texts = whole.groupBy("digest").agg(F.first("html").alias("html"))
    with_payload = known.where("not revisits").join(texts, "digest")
    return with_payload.unionByName(known.where("revisits").withColumn("html", F.lit(None).cast("string")))


def write(pages: DataFrame, folder: str, least: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Archives (path, records, bytes) of pages (page_id, url, html), written under folder, a URI; equal payloads of at least that many bytes are revisits."""

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done, part = None, [], TaskContext.get().partitionId()
        for b in batches:
            for page in b.to_pylist():
                if now is None:
                    now = Archive(f"{folder}/{part:06d}-{uuid.uuid4().hex}.warc.zst")
                now.add(record(page, (page["html"] or "").encode(), date))
                if now.payload >= ARCHIVE:
                    done.append(now.close())
                    now = None
        if now is not None:
            done.append(now.close())
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "records", "bytes"])

    return materialize(roles(pages, least).mapInArrow(written, "path string, records long, bytes long"), "archives")


def read(archives: DataFrame) -> DataFrame:
    """RECORDS of all records of archives (path)."""
    names = [c.split()[0] for c in RECORDS.split(", ")]

    def loaded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                rows: list[tuple] = []
                for data in frames(path):
                    rows.append(row_of(data))
                    if len(rows) == 4096:
                        yield _batch(rows, names)
                        rows = []
                yield _batch(rows, names)

    paths = archives.select("path")
    many = max(1, min(archives.count(), 1 << 16))
    return paths.repartition(many, "path").mapInArrow(loaded, RECORDS)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)


def archive_folder(spark: SparkSession) -> str:
    """A new folder for archives in the shared folder, as a URI."""
    shared = shared_dir(spark)
    return f"{shared if '://' in shared or shared.startswith('file:') else 'file://' + shared}/plumbline/warc-{uuid.uuid4().hex}"
