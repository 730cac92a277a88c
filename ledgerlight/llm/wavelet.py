"""Token ids in binary files: a wavelet matrix for each shard, with rank and select support.

A shard is one file with the ids of some documents. Its distinct ids are numbered by falling
frequency, and the numbers' bits stand in planes: the first plane has the highest bit of each
number in the order of the ids; for each next plane all numbers with a 0 in the plane before
come first, then those with a 1, in the order that they had. Planes are cut into blocks, each
compressed, and a directory holds where a block begins and how many ones come before it. An
id at a place, how often an id comes before a place, and where its k-th occurrence stands
then need one block or a few of each plane.

File, little-endian: MAGIC; n_ids u64, n_docs u32, n_symbols u32, n_planes u16, log2 of a block's
bits u16; for the documents ids i64, nulls u8 and ends u64; symbols u32; for each plane zeros
u64, and for its blocks and the end ones u64 and offset u64; then the blocks (zstd frames).
"""

from __future__ import annotations

import gc
import re
import struct
import unicodedata
import zlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from operator import attrgetter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import shared_folder, shuffle_partitions, stored, text_or_empty, tidy
from .warc import _open

MAGIC, HEAD = b"WMSHARD1", struct.Struct("<QIIHH")
#: Ids after which a shard is closed (a document is never divided); log2 of the bits in a block; words and parts of words that a task remembers.
SHARD_IDS, BLOCK, WORDS = 1 << 20, 16, 300_000
#: Unicode's white space. A word with the white space before it is encoded by itself, as a pre-tokenizer that cuts where white space begins allows.
_SPACE = " \t\n\x0b\x0c\r\x85\xa0  -     　"
_WORD = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")


def _latin(kind: str) -> str:
    return "".join(c for c in map(chr, range(0x250)) if unicodedata.category(c)[0] == kind)


#: What the byte-level pre-tokenizer cuts, for texts of Latin letters (below U+0250), whose classes are the same in all versions of Unicode.
_BEYOND = re.compile("[\u0250-\U0010ffff]")
_PARTS = re.compile("'(?:[stmd]|re|ve|ll)| ?[{0}]+| ?[{1}]+| ?[^{2}{0}{1}]+|[{2}]+(?![^{2}])|[{2}]+".format(_latin("L"), _latin("N"), "\t-\r \x85\xa0"))
#: The sign that stands for each byte in a byte-level vocabulary: printable ones stand for themselves, the others for what follows U+00FF.
_SIGNS = {b: chr(b) for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD}
_SIGNS |= {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _SIGNS)}
#: The signs of a Latin letter's bytes.
_SIGNS_OF = {c: "".join([_SIGNS[b] for b in chr(c).encode()]) for c in range(0x250)}

_ID = attrgetter("id")


def _signs(part: str) -> str:
    """The signs of the bytes of a part below U+0250."""
    space, rest = (_SIGNS[0x20], part[1:]) if part[0] == " " else ("", part)
    return space + (rest if rest.isascii() and rest.isalnum() else rest.translate(_SIGNS_OF))


def _beyond(text: str) -> bool:
    """Whether a text has characters from U+0250 on."""
    try:
        text.encode("latin-1")  # much faster than the search, and true of most
    except UnicodeEncodeError:
        return _BEYOND.search(text) is not None
    return False


class _Known(dict):
    """Ids by word or part of a word; ``make`` gives those of one that isn't there, and may put them there."""

    def __init__(self, make: Callable[[str], bytes]):
        self.make = make

    def __missing__(self, part: str) -> bytes:
        return self.make(part)


class Encoder:
    """A tokenizer file's ids of whole texts, as the library gives them without adding special tokens.

    Where the file has a byte-level pre-tokenizer and no normalizer, what it cuts out is given to the library's model
    once each and remembered, up to a number of them; then those go that weren't asked for again, as most words of a
    corpus come once. Texts beyond Latin letters are cut at white space first and by the library's pre-tokenizer then.
    With any other file the library encodes the text.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        said = json.loads(self.tokenizer.to_str())
        before, model = said["pre_tokenizer"] or {}, said["model"]
        plain = all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in said["added_tokens"])
        self.by_word = said["normalizer"] is None and before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"] and model["type"] == "BPE" and not model["dropout"] and plain
        self.added = {t["content"]: np.array([t["id"]], dtype="<u4").tobytes() for t in said["added_tokens"]}
        self.cut = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.words, self.parts = _Known(self._word), _Known(self._part)
        #: Those of the parts that were asked for once so far; ``parts`` has the others.
        self.once: dict[str, bytes] = {}

    def _model(self, part: str) -> bytes:
        return array("I", map(_ID, self.tokenizer.model.tokenize(part))).tobytes()

    def _part(self, part: str) -> bytes:
        found = self.once.pop(part, None)
        if found is not None:
            self.parts[part] = found
            return found
        found = self._model(_signs(part))
        if len(part) <= 64:
            self.once[part] = found
        return found

    def _word(self, word: str) -> bytes:
        found = b"".join([self._model(p) for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(word)])
        if len(word) <= 64:
            self.words[word] = found
        return found

    def _plain(self, text: str) -> bytes:
        if _beyond(text):
            return b"".join(map(self.words.__getitem__, _WORD.findall(text)))
        return b"".join(map(self.parts.__getitem__, _PARTS.findall(text)))

    def encode(self, text: str) -> bytes:
        """The ids, as little-endian unsigned 32-bit integers."""
        if not self.by_word:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if len(self.words) > WORDS:
            self.words.clear()
        if len(self.parts) + len(self.once) > WORDS:
            self.once.clear()
            if len(self.parts) > 2 * WORDS // 3:
                self.parts.clear()
        if not self.cut or not self.cut.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [self._plain(text[at : m.start()]), self.added[m[0]]]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    made = Encoder(path)
    gc.freeze()  # what a worker keeps till its end isn't looked through for garbage again and again
    return made


def _sides(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the zeros and where the ones of a plane are. Going by places takes a fraction of the time of going by the bits, as no branch hangs on each."""
    return np.flatnonzero(~bits), np.flatnonzero(bits)


def packed_shard(ids: np.ndarray, docs: list[int | None], ends: list[int]) -> bytes:
    """A file's bytes for ids (of any non-negative 32-bit values), the documents' ids and where each ends."""
    if len(ids) and int(ids.max()) < 1 << 22:
        counts = np.bincount(ids)
        symbols = np.flatnonzero(counts)
        symbols = symbols[np.argsort(-counts[symbols], kind="stable")]
        number = np.zeros(len(counts), dtype=np.uint32)
        number[symbols] = np.arange(len(symbols))
        at = number[ids]
    else:
        symbols, at, counts = np.unique(ids, return_inverse=True, return_counts=True)
        order = np.argsort(-counts, kind="stable")
        back = np.empty(len(order), dtype=np.uint32)
        back[order] = np.arange(len(order))
        symbols, at = symbols[order], back[at]
    n_planes = max(1, int(len(symbols) - 1).bit_length()) if len(symbols) else 0
    at = at.astype(np.uint16 if n_planes <= 16 else np.uint32)
    n, size = len(ids), 1 << BLOCK
    compress = zstandard.ZstdCompressor(level=1).compress
    heads, blocks, offset = [], [], 0
    for plane in range(n_planes - 1, -1, -1):
        bits = (at & at.dtype.type(1 << plane)) != 0
        flat = np.packbits(bits)
        starts = np.arange(0, n, size)
        ones = np.r_[0, np.cumsum(np.add.reduceat(np.bitwise_count(flat), starts >> 3, dtype=np.int64))]
        places = []
        for a in starts.tolist():
            blocks.append(compress(flat[a >> 3 : (a + size) >> 3].tobytes()))
            places.append(offset)
            offset += len(blocks[-1])
        heads.append(np.array([n - int(ones[-1])], dtype="<u8").tobytes() + ones.astype("<u8").tobytes() + np.array([*places, offset], dtype="<u8").tobytes())
        if plane:  # after the last one nothing asks for the order
            at = np.concatenate([at.take(side) for side in _sides(bits)])
    table = np.array([x or 0 for x in docs], dtype="<i8").tobytes() + np.array([x is None for x in docs], dtype="u1").tobytes() + np.array(ends, dtype="<u8").tobytes()
    return b"".join([MAGIC, HEAD.pack(n, len(docs), len(symbols), n_planes, BLOCK), table, symbols.astype("<u4").tobytes(), *heads, *blocks])


class Shard:
    """A file that is open for reading; ``read(offset, size)`` gives its bytes. Only the heads are read at once."""

    def __init__(self, read):
        if read(0, len(MAGIC)) != MAGIC:
            raise ValueError("not a shard of token ids")
        self.read = read
        self.n, self.n_docs, n_symbols, self.n_planes, self.block = HEAD.unpack(read(len(MAGIC), HEAD.size))
        at = len(MAGIC) + HEAD.size
        table = read(at, 17 * self.n_docs + 4 * n_symbols)
        k = self.n_docs
        self.docs = [None if none else int(x) for x, none in zip(np.frombuffer(table, "<i8", k), np.frombuffer(table, "u1", k, 8 * k), strict=True)]
        self.ends = np.frombuffer(table, "<u8", k, 9 * k).astype(np.int64)
        self.symbols = np.frombuffer(table, "<u4", n_symbols, 17 * k)
        self.number = {int(s): i for i, s in enumerate(self.symbols)}
        n_blocks = -(-self.n // (1 << self.block))
        heads = np.frombuffer(read(at + len(table), self.n_planes * 8 * (2 * n_blocks + 3)), "<u8").astype(np.int64).reshape(self.n_planes, 2 * n_blocks + 3)
        self.zeros, self.ones, self.offsets = heads[:, 0], heads[:, 1 : n_blocks + 2], heads[:, n_blocks + 2 :]
        self.base = at + len(table) + heads.nbytes
        self._held: dict[tuple[int, int], np.ndarray] = {}

    def _bits(self, plane: int, block: int) -> np.ndarray:
        """A block's bits, unpacked; the last block of each plane that was asked for is kept."""
        found = self._held.get((plane, block))
        if found is None:
            a, b = self.offsets[plane, block], self.offsets[plane, block + 1]
            bits = min(1 << self.block, self.n - (block << self.block))
            found = np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(self.read(self.base + int(a), int(b - a))), np.uint8))[:bits]
            self._held = {k: v for k, v in self._held.items() if k[0] != plane} | {(plane, block): found}
        return found

    def _rank(self, plane: int, bit: int, i: int) -> int:
        """How many of a plane's first i bits are ``bit``."""
        block = i >> self.block
        ones = int(self.ones[plane, block])
        if i & ((1 << self.block) - 1):
            ones += int(self._bits(plane, block)[: i - (block << self.block)].sum())
        return ones if bit else i - ones

    def _select(self, plane: int, bit: int, k: int) -> int:
        """Where the plane's k-th such bit is, from 0."""
        starts = np.arange(len(self.ones[plane])) << self.block
        before = self.ones[plane] if bit else np.minimum(starts, self.n) - self.ones[plane]
        block = int(np.searchsorted(before, k, side="right")) - 1
        return (block << self.block) + int(np.flatnonzero(self._bits(plane, block) == bit)[k - int(before[block])])

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        number = 0
        for plane in range(self.n_planes):
            bit = int(self._bits(plane, i >> self.block)[i & ((1 << self.block) - 1)])
            number = number << 1 | bit
            i = self._rank(plane, bit, i) + (int(self.zeros[plane]) if bit else 0)
        return int(self.symbols[number])

    def _range(self, token: int, i: int) -> tuple[int, int]:
        """Where the token's occurrences among the first i places stand after the last plane."""
        number, a, b = self.number[token], 0, i
        for plane in range(self.n_planes):
            bit = number >> (self.n_planes - 1 - plane) & 1
            more = int(self.zeros[plane]) if bit else 0
            a, b = self._rank(plane, bit, a) + more, self._rank(plane, bit, b) + more
        return a, b

    def rank(self, token: int, i: int) -> int:
        """How often the token is among the first i places."""
        if token not in self.number:
            return 0
        a, b = self._range(token, min(max(i, 0), self.n))
        return b - a

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """The place of the token's k-th occurrence, from 0."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        number, i = self.number[token], self._range(token, 0)[0] + k
        for plane in range(self.n_planes - 1, -1, -1):
            bit = number >> (self.n_planes - 1 - plane) & 1
            i = self._select(plane, bit, i - (int(self.zeros[plane]) if bit else 0))
        return i

    def ids(self) -> np.ndarray:
        """All ids in their order: the planes undone from the last one."""
        at = np.zeros(self.n, dtype=np.uint16 if self.n_planes <= 16 else np.uint32)
        unpack = zstandard.ZstdDecompressor().decompress
        for plane in range(self.n_planes - 1, -1, -1):
            a, b = int(self.offsets[plane, 0]), int(self.offsets[plane, -1])
            data = memoryview(self.read(self.base + a, b - a))
            flat = b"".join(unpack(data[x - a : y - a]) for x, y in zip(self.offsets[plane, :-1].tolist(), self.offsets[plane, 1:].tolist(), strict=True))
            bits = np.unpackbits(np.frombuffer(flat, np.uint8), count=self.n).view(bool)
            before, (zeros, ones) = np.empty_like(at), _sides(bits)
            before[zeros], before[ones] = at[: self.zeros[plane]], at[self.zeros[plane] :] | at.dtype.type(1 << (self.n_planes - 1 - plane))
            at = before
        return self.symbols[at] if self.n else np.zeros(0, dtype="<u4")


def open_shard(folder: str, name: str) -> Shard:
    """A shard of a folder, read by ranges as it is asked."""
    system, path = _open(folder)
    source = system.open_input_file(f"{path}/{name}")

    def read(offset: int, size: int) -> bytes:
        source.seek(offset)
        return source.read(size)

    return Shard(read)


@dataclass(frozen=True)
class Shards:
    """folder: of the files; directory: (file, start, n_ids, n_docs), where start counts the ids of all files before."""

    folder: str
    directory: DataFrame


def write_shards(documents: DataFrame, folder: str, tokenizer: str, end: int, shard_ids: int = SHARD_IDS) -> Shards:
    """Encodes all rows and whole texts and writes them in the order of doc_id.

    Null texts are empty and have the end id alone. Null ids come last; rows of one id stand in the order of their
    texts' hashes, repeated rows in any. A very long text is encoded whole and makes one file with what came before it.
    An empty table makes no file; other columns are ignored.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").cast("string").alias("text"))
    keys = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), F.monotonically_increasing_id()]
    rows = rows.withColumns({"_hash": keys[1], "_row": keys[2]})
    order = [keys[0], F.col("_hash"), F.col("_row")]
    ordered = rows.repartitionByRange(shuffle_partitions(documents.sparkSession), *order).sortWithinPartitions(*order)
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), ("n_ids", pa.int64()), ("n_docs", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        encode, last = encoder(tokenizer).encode, np.array([end], dtype="<u4").tobytes()
        system, path = _open(folder)
        held, docs, ends, at, part, seq = [], [], [], 0, None, 0

        def shard() -> pa.RecordBatch:
            system.create_dir(path, recursive=True)
            name = f"{uuid.uuid4().hex}.wm"
            with system.open_output_stream(f"{path}/{name}", compression=None) as sink:
                sink.write(packed_shard(np.frombuffer(b"".join(held), dtype="<u4"), docs, ends))
            return pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "file": name, "n_ids": at, "n_docs": len(docs)}], schema=schema)

        for batch in batches:
            for doc_id, text, part in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                ids = encode(text.as_py()) + last
                held.append(ids)
                at += len(ids) // 4
                docs.append(doc_id)
                ends.append(at)
                if at >= shard_ids:
                    yield shard()
                    held, docs, ends, at, seq = [], [], [], 0, seq + 1
        if docs:
            yield shard()

    made = ordered.select("doc_id", "text", F.spark_partition_id().alias("part")).mapInArrow(tidy(write), "part int, seq int, file string, n_ids long, n_docs long")
    made = stored(made, "token-shards")
    parts = made.groupBy("part").agg(F.sum("n_ids").alias("_all"))  # a row for each task that wrote
    parts = parts.select("part", (F.sum("_all").over(W.orderBy("part")) - F.col("_all")).alias("_before"))
    inside = F.sum("n_ids").over(W.partitionBy("part").orderBy("seq")) - F.col("n_ids")
    return Shards(folder, made.withColumn("_inside", inside).join(parts, "part").select("file", (F.col("_before") + F.col("_inside")).alias("start"), "n_ids", "n_docs"))


def _each(shards: Shards, schema: pa.Schema, read) -> DataFrame:
    """What ``read(shard, start)`` gives of each shard; files are dealt to tasks by name."""
    folder = shards.folder

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays(read(open_shard(folder, file), start), schema=schema)

    kinds = ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'int'}" for f in schema)
    spark = shards.directory.sparkSession
    return shards.directory.select("file", "start").repartition(shuffle_partitions(spark), "file").mapInArrow(tidy(run), kinds)


def read_documents(shards: Shards) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""

    def read(shard: Shard, start: int) -> list[pa.Array]:
        data = memoryview(np.ascontiguousarray(shard.ids(), dtype="<u4")).cast("B")
        begins = np.r_[0, shard.ends[:-1]] if shard.n_docs else shard.ends
        sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(begins.tolist(), shard.ends.tolist(), strict=True)]
        return [pa.array(shard.docs, pa.int64()), pa.array(begins + start), pa.array(shard.ends - begins), pa.array(sums, pa.int64())]

    return _each(shards, pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "n_tokens", "ids_crc32")]), read)


def count_tokens(shards: Shards, tokens: list[int]) -> DataFrame:
    """(token, n): how often each of these ids is there, by rank alone; no shard is decoded."""

    def read(shard: Shard, start: int) -> list[pa.Array]:
        return [pa.array(tokens, pa.int64()), pa.array([shard.count(t) for t in tokens], pa.int64())]

    return _each(shards, pa.schema([("token", pa.int64()), ("n", pa.int64())]), read).groupBy("token").agg(F.sum("n").alias("n"))


def occurrences(shards: Shards, token: int) -> DataFrame:
    """(doc_id, place): each place of an id, counted over all files, by select."""

    def read(shard: Shard, start: int) -> list[pa.Array]:
        at = [shard.select(token, k) for k in range(shard.count(token))]
        docs = [shard.docs[i] for i in np.searchsorted(shard.ends, at, side="right")]
        return [pa.array(docs, pa.int64()), pa.array([start + i for i in at], pa.int64())]

    return _each(shards, pa.schema([("doc_id", pa.int64()), ("place", pa.int64())]), read)


def write_and_read_back(documents: DataFrame, tokenizer: str, end: int) -> DataFrame:
    """All documents through files in the shared folder; a row for each, as ``write_shards`` and ``read_documents`` say."""
    return read_documents(write_shards(documents, shared_folder(documents.sparkSession, "token-files"), tokenizer, end))
