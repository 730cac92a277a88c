"""WARC archives with a two-level capture index.

Records are written as gzip members of archive files, so each can be read by its range.
The capture index is sorted by key: the URL with its host's labels reversed, then the
page's id. It lies in blocks of ``LINES`` lines, each a gzip member of an index file; a
sparse directory holds each block's first and last key and its range. A lookup searches
the directory for the blocks that can hold its keys, reads those ranges, and then reads
the records found, file by file in the order of their offsets.

Files are written under names of their own by each attempt of a task and become part of
the archive by the table row that names them, which Spark commits once; files of lost or
repeated attempts are never read. Paths may be of any store that Spark and Arrow read.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_folder, shuffle_partitions, stored, text_or_empty

#: Lines of the capture index in a block.
LINES = 1000
#: Bytes of an archive file, after which a task begins another.
FILE_BYTES = 1 << 30
#: Records that lie closer than this many bytes are read in one range, of at most READ_BYTES.
GAP_BYTES, READ_BYTES = 1 << 16, 1 << 21
#: Effort of the compression.
LEVEL = 3
# Fixed values of the file format.
VERSION, WHEN = "WARC/1.1", "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


#: How an index line writes the signs that end its fields.
_SIGNS = {"\\\\": "\\", "\\t": "\t", "\\n": "\n"}
_ESCAPES = str.maketrans({sign: written for written, sign in _SIGNS.items()})
_ESCAPED = re.compile(r"\\[\\tn]")


def url_key(url: str | Column) -> Column:
    """The sort key of a URL: host labels reversed and joined by commas, then ")" and the rest without scheme, www and
    fragment. The host is in lower case. Null and empty URLs have the key ")/"."""
    c = text_or_empty(url)
    bare = F.regexp_replace(F.regexp_replace(c, "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, "^([^/?]*)", 1)), r"^www\d*\.|:\d*$", "")
    rest = F.regexp_extract(bare, "(?s)^[^/?]*(.*)$", 1)
    path = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), path)


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if ":" in uri.split("/")[0] else f"file://{uri}")


class _Files:
    """Writes parts one after another to files in a folder and tells where each went."""

    def __init__(self, folder: str, suffix: str):
        self.folder, self.suffix, self.sink, self.name, self.at = folder, suffix, None, "", 0

    def put(self, data: bytes) -> tuple[str, int, int]:
        if self.sink is None or self.at >= FILE_BYTES:
            self.close()
            system, path = _open(self.folder)
            system.create_dir(path, recursive=True)
            self.name, self.at = f"{uuid.uuid4().hex}{self.suffix}", 0
            self.sink = system.open_output_stream(f"{path}/{self.name}", compression=None)
        where = (self.name, self.at, len(data))
        self.sink.write(data)
        self.at += len(data)
        return where

    def close(self) -> None:
        if self.sink is not None:
            self.sink.close()
            self.sink = None


@dataclass(frozen=True)
class Archive:
    """records: folder of archive files; blocks: folder of index files; directory: table of the blocks' keys and ranges."""

    records: str
    blocks: str
    directory: DataFrame


def record_bytes(page_id: int, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record: the head of an HTTP response, and its payload but for revisits, which name the record they repeat."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [VERSION, f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {WHEN}", f"WARC-Target-URI: {''.join(url.splitlines())}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    else:
        block += payload
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """A record's headers by name, its payload under ``payload``, and the length that its HTTP head states under ``length``."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if lines[0] != VERSION:
        raise ValueError("not a record")
    found = dict(line.split(": ", 1) for line in lines[1:])
    http, _, found["payload"] = rest[: int(found["Content-Length"])].partition(b"\r\n\r\n")
    found["length"] = int(dict(line.split(b": ", 1) for line in http.split(b"\r\n")[1:])[b"Content-Length"])
    return found


def decide(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html, key, payload_sha256 and refers_to: null for responses, else the smallest page_id whose payload is equal.

    Payloads shorter than ``least_bytes`` are all responses. Rows that repeat a page_id and payload are records of the
    same kind; null page_ids come last and are never referred to unless all with that payload are null.
    """
    rows = pages.select("page_id", text_or_empty("url").alias("url"), text_or_empty("html").alias("html"))
    rows = rows.withColumn("payload_sha256", F.sha2(F.encode("html", "UTF-8"), 256))
    first = rows.groupBy("payload_sha256").agg(F.min("page_id").alias("_first"))
    repeats = F.coalesce(F.col("page_id") != F.col("_first"), F.col("_first").isNotNull()) & (F.octet_length("html") >= least_bytes)
    return rows.join(first, "payload_sha256").select("page_id", "url", "html", url_key("url").alias("key"), F.when(repeats, F.col("_first")).alias("refers_to"))


def write_archive(pages: DataFrame, folder: str, least_bytes: int = 0, lines: int = LINES) -> Archive:
    """Writes a record for each page and the two levels of the capture index."""
    records, blocks = f"{folder}/records", f"{folder}/blocks"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Files(records, ".warc.gz")
        for batch in batches:
            out = []
            for page, url, html, key, refers in zip(*(batch.column(i) for i in range(5)), strict=True):
                payload, at, to = html.as_py().encode("utf-8", "surrogatepass"), page.as_py(), refers.as_py()
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                out.append((at, key.as_py(), *files.put(gzip.compress(record_bytes(at, url.as_py(), payload, digest, to), LEVEL, mtime=0))))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()))], ["page_id", "key", "file", "offset", "length"])
        files.close()

    captures = stored(decide(pages, least_bytes).mapInArrow(write, "page_id long, key string, file string, offset long, length long"), "warc-captures")
    spark = pages.sparkSession

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, held = _Files(blocks, ".cdx.gz"), []

        def block(rows: list[tuple]) -> pa.RecordBatch:
            text = "".join("\t".join((key.translate(_ESCAPES), *map(str, rest))) + "\n" for key, *rest in rows)
            where = files.put(gzip.compress(text.encode("utf-8", "surrogatepass"), 5, mtime=0))
            return pa.RecordBatch.from_pylist([{"first_key": rows[0][0], "last_key": rows[-1][0], "file": where[0], "offset": where[1], "length": where[2], "lines": len(rows)}], schema=pa.schema([("first_key", pa.string()), ("last_key", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("lines", pa.int64())]))

        for batch in batches:
            held += zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True)
            while len(held) >= lines:
                yield block(held[:lines])
                held = held[lines:]
        if held:
            yield block(held)
        files.close()

    ordered = captures.repartitionByRange(shuffle_partitions(spark), "key", "page_id").sortWithinPartitions("key", "page_id").select("key", "page_id", "file", "offset", "length")
    directory = stored(ordered.mapInArrow(index, "first_key string, last_key string, file string, offset long, length long, lines long"), "warc-directory")
    return Archive(records, blocks, directory)


def search_directory(archive: Archive, keys: DataFrame) -> DataFrame:
    """(key, file, offset, length) of each index block that can hold each key, by two binary searches.

    The first is over the index files' first and last keys: one line for each task that wrote the index, which all
    tasks get. The second is over the directory of the file, in the task that a file's lines and keys are dealt to.
    """
    bounds = archive.directory.groupBy("file").agg(F.min("first_key").alias("a"), F.max("last_key").alias("b")).collect()
    bounds = sorted((r["a"].encode("utf-8", "surrogatepass"), r["b"].encode("utf-8", "surrogatepass"), r["file"]) for r in bounds)
    firsts, lasts = [a for a, _, _ in bounds], [b for _, b, _ in bounds]

    def files(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [(key, bounds[i][2]) for key in frame["key"] for i in _between(firsts, lasts, key)]
            yield pd.DataFrame(found, columns=["key", "file"])

    asked = keys.select("key").distinct().mapInPandas(files, "key string, file string")
    both = archive.directory.select("file", F.lit(0).alias("kind"), F.col("first_key").alias("key"), "last_key", "offset", "length")
    both = both.unionByName(asked.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    both = both.repartition("file").sortWithinPartitions("file", "kind", "key", "offset").select("file", "kind", "key", "last_key", "offset", "length")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
        at, heads, tails, places, out = None, [], [], [], []
        for file, kind, key, last_key, offset, length in _rows(batches):
            if file != at:
                at, heads, tails, places = file, [], [], []
            if kind == 0:
                heads.append(key.encode("utf-8", "surrogatepass"))
                tails.append(last_key.encode("utf-8", "surrogatepass"))
                places.append((offset, length))
                continue
            out += [(key, file, *places[i]) for i in _between(heads, tails, key)]
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema, strict=True)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema, strict=True)], schema=schema)

    return both.mapInArrow(search, "key string, file string, offset long, length long")


def _between(firsts: list[bytes], lasts: list[bytes], key: str) -> range:
    """Places of the sorted intervals, which share their ends at most, that hold the key."""
    k = key.encode("utf-8", "surrogatepass")
    return range(bisect.bisect_left(lasts, k), bisect.bisect_right(firsts, k))


def _ranges(folder: str, rows: Iterator[tuple]) -> Iterator[tuple[tuple, bytes]]:
    """(row, bytes) for rows that begin with file, offset and length, in that order; ranges that lie close are read at once."""
    system, path = _open(folder)
    name, source = "", None

    def read(group: list[tuple]) -> Iterator[tuple[tuple, bytes]]:
        start = group[0][1]
        source.seek(start)
        data = source.read(max(r[1] + r[2] for r in group) - start)
        for r in group:
            yield r, data[r[1] - start : r[1] - start + r[2]]

    group: list[tuple] = []
    for row in rows:
        if group and (row[0] != name or row[1] > group[-1][1] + group[-1][2] + GAP_BYTES or row[1] + row[2] - group[0][1] > READ_BYTES):
            yield from read(group)
            group = []
        if row[0] != name:
            if source is not None:
                source.close()
            name, source = row[0], system.open_input_file(f"{path}/{row[0]}")
        group.append(row)
    if group:
        yield from read(group)
    if source is not None:
        source.close()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def lookup(archive: Archive, keys: DataFrame) -> DataFrame:
    """(key, page_id, file, offset, length) of every capture of the keys; keys without one have no row."""
    spark = keys.sparkSession
    wanted = search_directory(archive, keys).repartitionByRange(shuffle_partitions(spark), "file", "offset", "key").sortWithinPartitions("file", "offset", "key")
    folder = archive.blocks

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
        last, by_key, out = None, {}, []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], f.type) for i, f in enumerate(schema)], schema=schema)

        for (file, offset, _, key), data in _ranges(folder, _rows(batches)):
            if (file, offset) != last:
                last, by_key = (file, offset), {}
                for line in gzip.decompress(data).decode("utf-8", "surrogatepass").split("\n")[:-1]:
                    parts = line.split("\t")
                    name = _ESCAPED.sub(lambda m: _SIGNS[m[0]], parts[0])
                    by_key.setdefault(name, []).append((None if parts[1] == "None" else int(parts[1]), parts[2], int(parts[3]), int(parts[4])))
            out += [(key, *capture) for capture in by_key.get(key, ())]
            if len(out) >= 5_000:
                yield batch()
                out = []
        if out:
            yield batch()

    return wanted.select("file", "offset", "length", "key").mapInArrow(resolve, "key string, page_id long, file string, offset long, length long")


def fetch(archive: Archive, captures: DataFrame) -> DataFrame:
    """page_id, key, url, payload, payload_bytes, payload_digest, record_type and refers_to, read from the records' ranges.

    A revisit has no payload of its own (null); its length and digest are those of the payload it repeats.
    """
    spark = captures.sparkSession
    ordered = captures.select("file", "offset", "length", "key").repartitionByRange(shuffle_partitions(spark), "file", "offset").sortWithinPartitions("file", "offset")
    folder = archive.records
    schema = pa.schema([("page_id", pa.int64()), ("key", pa.string()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def number(name: str | None) -> int | None:
        text = (name or "").removeprefix("<urn:page:").rstrip(">")
        return None if text in ("", "None") else int(text)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, weight = [], 0
        for (_, _, _, key), data in _ranges(folder, _rows(batches)):
            r = parse_record(zlib.decompress(data, wbits=31))
            revisit, payload = r["WARC-Type"] == "revisit", r["payload"]
            digest = r["WARC-Payload-Digest"].removeprefix("sha1:")
            if not revisit and (r["length"] != len(payload) or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                raise ValueError(f"record {r['WARC-Record-ID']} does not match its digest")
            out.append({"page_id": number(r["WARC-Record-ID"]), "key": key, "url": r["WARC-Target-URI"], "payload": None if revisit else payload, "payload_bytes": r["length"], "payload_digest": digest, "record_type": r["WARC-Type"], "refers_to": number(r.get("WARC-Refers-To"))})
            weight += len(payload)
            if weight > 1 << 22 or len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out, weight = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return ordered.mapInArrow(read, "page_id long, key string, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_and_read_back(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Archives all pages in the shared folder and reads every record back through the capture index.

    Null html and URLs are empty; pages with one URL are captures of one key; rows that repeat a page_id are records of
    their own; a very long page is one record, held whole by the task that writes or reads it; an empty table gives an
    empty result; other columns are ignored. A revisit whose length or digest isn't that of a record that it refers to is
    an error.
    """
    archive = write_archive(pages, shared_folder(pages.sparkSession, "warc"), least_bytes)
    keys = pages.select(url_key("url").alias("key")).distinct()
    found = stored(fetch(archive, lookup(archive, keys)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "key"), "warc-read")
    said = found.where("record_type = 'revisit'").select(F.col("refers_to").alias("page_id"), "payload_bytes", "payload_digest").distinct()
    held = found.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest").distinct()
    broken = said.alias("s").join(held.alias("h"), F.col("s.page_id").eqNullSafe(F.col("h.page_id")) & (F.col("s.payload_bytes") == F.col("h.payload_bytes")) & (F.col("s.payload_digest") == F.col("h.payload_digest")), "left_anti")
    if broken.limit(1).count():
        raise ValueError(f"a revisit does not match the record it refers to: {broken.first()}")
    return found
