"""BPE encoding and decoding as a bounded-lookahead streaming transducer.

For a merge list in which every merge uses symbols that exist before it (checked on
loading), a token sequence is the encoding of a text exactly when each adjacent pair
of tokens is, so the encoding of every prefix of a text follows from its last token
and the encoding of a shorter prefix. The transducer reads one symbol at a time and
keeps, for the prefixes that can still matter, their last token. Any later token starts
within the longest token's length of the point reached: that length is the merge list's
sufficient lookahead. A token is emitted once the chains from all prefixes within the
lookahead run through it, and what lies before it is forgotten. An automaton of all
tokens tells, symbol by symbol, which of them end there.

Decoding spells ids as bytes and turns these into text by a state machine that holds
the bytes of one character at most.

Spark deals out the documents. A task goes through them in pieces of bounded size, cut
before white space, encodes each distinct word of a piece once, and adds what comes out
to the digests of the documents; nothing else is kept of a document.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import release, tidy

NEVER = 1 << 60
#: Chunks of text, and pairs of tokens, whose results a task remembers at most.
REMEMBERED = 100_000
#: Symbols read between two looks for tokens that are stable.
EVERY = 256
#: Code points of text that are gone through at a time.
WINDOW = 1 << 21
#: Stands for the end of a word in the automaton; no sign of the byte alphabet.
END = "\uffff"

#: Only beyond these can a code point be one that versions of Unicode disagree on.
_LATE = re.compile("[\u0557-\U0010ffff]")
# Fixed value: white space of the pattern that the tokenizer file replaces by spaces, beyond ASCII.
_SPACES = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_CUT = re.compile("[\t-\r " + _SPACES.pattern[1:])


def byte_alphabet() -> list[str]:
    """The printable sign that stands for each byte in byte-level vocabularies: itself where it is printable, else the
    next code point from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class MergeList:
    """The vocabulary and merges of a tokenizer file, and what the transducer needs to know of them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("continuing_subword_prefix"):
            raise ValueError(f"{path} is not a BPE vocabulary of the supported kind")
        self.ids: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in (self.ids | self.special).items()}
        self.signs = byte_alphabet()
        self.values = {s: b for b, s in enumerate(self.signs)}
        self.ranks: dict[int, int] = {}  # by left part << 32 | right part
        self.parts: dict[int, tuple[int, int]] = {}
        self.born: dict[int, int] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = (self.ids[x] for x in (merge.split(" ") if isinstance(merge, str) else merge))
            made = self.ids[self.strings[a] + self.strings[b]]
            if max(self.born.get(a, -1), self.born.get(b, -1)) >= rank or made in self.parts:
                raise ValueError(f"merge {rank} uses what later merges make, or makes a token again")
            self.ranks[a << 32 | b], self.parts[made], self.born[made] = rank, (a, b), rank
        self.lookahead = max(len(s.removesuffix(self.end) + END if self.end and s.endswith(self.end) else s) for s in self.ids)
        self.fitting: dict[int, bool] = {}
        self._edges: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self._spelled: dict[bool, dict[int, bytes]] = {}
        sound: dict[int, bool] = {}
        for token in sorted(self.strings, key=lambda t: self.born.get(t, -1)):
            if token in self.parts:
                (x, y), rank = self.parts[token], self.born[token]
                sound[token] = sound[x] and sound[y] and not self._crossed(x, y, rank)
            else:
                sound[token] = len(self.strings[token].removesuffix(self.end) or self.end) == 1
        # Only tokens whose own text has them as its encoding can be in any encoding.
        self.sound = {name.removesuffix(self.end) + END if self.end and name.endswith(self.end) else name: token for name, token in self.ids.items() if sound[token]}
        # The longest token by its first three symbols at most.
        self.reach: dict[str, int] = {}
        for symbols in self.sound:
            for k in range(1, min(3, len(symbols)) + 1):
                self.reach[symbols[:k]] = max(self.reach.get(symbols[:k], 0), len(symbols))
        self.found = ahocorasick.Automaton()
        for symbols, token in self.sound.items():
            self.found.add_word(symbols, (len(symbols), token))
        self.found.make_automaton()

    def spelled(self, plain: bool) -> dict[int, bytes]:
        """Each token's bytes: what its signs stand for, with a space at a word's end, or its spelling after a space."""
        if plain not in self._spelled:
            if plain:
                ends = {i: bool(self.end) and s.endswith(self.end) for i, s in self.strings.items()}
                bodies = {i: s.removesuffix(self.end) if ends[i] else s for i, s in self.strings.items()}
                self._spelled[plain] = {i: s.encode() if s in self.special else bytes([self.values[c] for c in s]) + b" " * ends[i] for i, s in bodies.items()}
            else:
                self._spelled[plain] = {i: f" {s}".encode() for i, s in self.strings.items()}
        return self._spelled[plain]

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """(part, rank at which it is merged away) of the parts that lie at the token's left (0) or right (1) edge, itself first."""
        if (found := self._edges.get((token, side))) is None:
            found, gone, at = [], NEVER, token
            while True:
                found.append((at, gone))
                if at not in self.parts:
                    break
                gone, at = self.born[at], self.parts[at][side]
            self._edges[token, side] = found
        return found

    def _crossed(self, a: int, b: int, before: int) -> bool:
        """Whether some merge of a rank below ``before`` joins a's right edge to b's left edge while both are there.

        Of merges with one rank the leftmost comes first, so at its own left a merge loses a tie and at its right it wins.
        """
        rank, left = self.ranks.get, self._edge(b, 0)
        for x, gone_x in self._edge(a, 1):
            x <<= 32
            for y, gone_y in left:
                m = rank(x | y)
                if m is not None and m < before and m < gone_x and m <= gone_y:
                    return True
        return False

    def fits(self, a: int, b: int) -> bool:
        """Whether the encoding of both tokens' text is just these two."""
        if len(self.fitting) > REMEMBERED:
            self.fitting.clear()
        found = self.fitting[a << 32 | b] = not self._crossed(a, b, NEVER)
        return found


class Transducer:
    """Encodes one word, symbol by symbol."""

    def __init__(self, merges: MergeList):
        self.merges = merges

    def encode(self, signs: str) -> Iterable[int]:
        """The tokens of a word given in byte signs."""
        word = signs + END if self.merges.end else signs
        return self._whole(word) if len(word) <= self.merges.lookahead else self._streamed(word)

    def _whole(self, word: str) -> list[int]:
        """The tokens of a word that the lookahead covers: the one chain of fitting tokens, searched with longer tokens first.

        A prefix has one encoding, so a point from which the chain can't go on is on no other chain either.
        """
        m, n, at, end = self.merges, len(word), 0, 0
        get, fits, known, reach = m.sound.get, m.fits, m.fitting.get, m.reach.get
        chain, starts = [], []
        for last, (length, token) in m.found.iter_long(word):  # the chain of longest tokens, as far as they fit
            if last + 1 - length != at:
                break
            end = last
            if chain:
                before = chain[-1]
                if not (fits(before, token) if (fit := known(before << 32 | token)) is None else fit):
                    break
            chain.append(token)
            starts.append(at)
            at = end = last + 1
        if at == n:
            return chain
        dead: set[int] = set()
        if at == end:  # not at a token that doesn't fit: any length is open
            end = n
        while at < n:
            if (most := at + reach(word[at : at + 3], 2)) < end:  # where no token begins with these three, it has two at most
                end = most
            while end > at:
                token = get(word[at:end])
                if token is not None and end not in dead:
                    if not chain:
                        break
                    before = chain[-1]
                    if fits(before, token) if (fit := known(before << 32 | token)) is None else fit:
                        break
                end -= 1
            else:
                if not chain:
                    raise ValueError(f"the vocabulary has no tokens for {word!r}")
                dead.add(at)
                chain.pop()
                at, end = starts.pop(), at - 1
                continue
            chain.append(token)
            starts.append(at)
            at, end = end, n
        return chain

    def _streamed(self, word: str) -> Iterator[int]:
        """The tokens of a word of any length, each as soon as it is stable."""
        m, base, done = self.merges, 0, 0
        fits, known = m.fits, m.fitting.get
        last: list[int] = [-1]  # by prefix length less base: the last token, and where it starts
        start: list[int] = [0]
        for at, (length, token) in m.found.iter(word):  # the longest token first of those that end at one symbol
            if at < done:
                continue
            if at > done:
                break  # no token ends at the symbol before
            j = at + 1 - length
            if j < base:
                continue
            before = last[j - base]
            if j and not (fits(before, token) if (fit := known(before << 32 | token)) is None else fit):
                continue
            last.append(token)
            start.append(j)
            done += 1
            if done % EVERY == 0 and (stable := self._common(start, base, done)) > base:
                yield from self._chain(last, start, base, stable)
                keep = stable - base
                last, start, base = last[keep:], [stable, *start[keep + 1 :]], stable
        if done < len(word):
            raise ValueError(f"the vocabulary has no token for {word[done]!r}")
        yield from self._chain(last, start, base, done)

    def _common(self, start: list[int], base: int, at: int) -> int:
        """The last boundary that the chains from all prefixes within the lookahead share."""
        open_ends = set(range(max(base, at - self.merges.lookahead), at + 1))
        while len(open_ends) > 1:
            top = max(open_ends)
            open_ends.remove(top)
            open_ends.add(start[top - base])
        return open_ends.pop()

    @staticmethod
    def _chain(last: list[int], start: list[int], base: int, at: int) -> list[int]:
        out = []
        while at > base:
            out.append(last[at - base])
            at = start[at - base]
        return out[::-1]


class Decoder:
    """Token ids to text, piece by piece; what it keeps between pieces is a few bytes at most.

    Ids are spelled as bytes, and these become text through a state machine. With ``plain`` a token's byte signs are
    the bytes they stand for and a word's end is a space. Otherwise the text is that of a tokenizer file without a
    decoder: the tokens as the vocabulary spells them, a space between two.
    """

    def __init__(self, merges: MergeList, plain: bool = False, begun: bool = False):
        self.begun, self.utf8, self.spelled = plain or begun, Utf8(), merges.spelled(plain)

    def feed(self, ids: Iterable[int]) -> str:
        spelled = self.spelled
        data = b"".join([spelled[i] for i in ids])
        if data and not self.begun:
            self.begun, data = True, data[1:]
        return self.utf8.feed(data)

    def finish(self) -> str:
        return self.utf8.finish()


class Utf8:
    """A state machine from bytes to text: the bytes of a character so far, and how many it still needs."""

    def __init__(self):
        self.held, self.need, self.low, self.high = bytearray(), 0, 0x80, 0xBF

    def feed(self, data: bytes) -> str:
        if not self.need:
            try:
                return data.decode()  # whole characters only: the machine ends where it began
            except UnicodeDecodeError:
                pass
        out = []
        for b in data:
            if self.need:
                if self.low <= b <= self.high:
                    self.held.append(b)
                    self.need, self.low, self.high = self.need - 1, 0x80, 0xBF
                    if not self.need:
                        out.append(self.held.decode())
                        self.held.clear()
                    continue
                out.append(self.finish())
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xF4:
                self.held.append(b)
                self.need = 1 + (b >= 0xE0) + (b >= 0xF0)
                self.low, self.high = {0xE0: 0xA0, 0xF0: 0x90}.get(b, 0x80), {0xED: 0x9F, 0xF4: 0x8F}.get(b, 0xBF)
            else:
                out.append("�")
        return "".join(out)

    def finish(self) -> str:
        out = "�" if self.need else ""
        self.held.clear()
        self.need, self.low, self.high = 0, 0x80, 0xBF
        return out


class _Digest:
    """What is kept of a document: number of tokens, and the digests of ids and decoded text so far."""

    def __init__(self):
        self.n, self.ids, self.words, self.begun = 0, hashlib.sha256(), hashlib.sha256(), False

    def add(self, n: int, ids: memoryview, words: memoryview) -> None:
        """Both with a space before each token; that before the first one goes."""
        if n:
            skip = 0 if self.begun else 1
            self.n, self.begun = self.n + n, True
            self.ids.update(ids[skip:])
            self.words.update(words[skip:])


class WordBpe:
    """The whole way from a text to ids: special strings, normalising, words, merges."""

    # Fixed value: the pattern by which the tokenizer file cuts words.
    WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

    def __init__(self, path: str):
        self.merges = MergeList(path)
        self.transducer = Transducer(self.merges)
        self.at_special = re.compile("(" + "|".join(map(re.escape, self.merges.special)) + ")") if self.merges.special else None
        steps = Tokenizer.from_file(path)
        self.own_norm, self.own_cut = steps.normalizer, steps.pre_tokenizer
        self.decoder = Decoder(self.merges, begun=True)
        self._numbers = {i: f" {i}".encode() for i in self.merges.strings}
        self._signs = {b: sign for b, sign in enumerate(self.merges.signs)}
        # Chunks met again, and those met once so far: most words of a corpus come once, and don't displace those that come again.
        self._chunks: dict[str, tuple[int, bytes, bytes]] = {}
        self._once: dict[str, tuple[int, bytes, bytes]] = {}
        # Code points without a class here may have one in the tokenizer file's version of Unicode.
        self._new = lru_cache(maxsize=1 << 16)(lambda c: unicodedata.category(c) == "Cn")

    def _unsettled(self, text: str) -> bool:
        return _LATE.search(text) is not None and any(self._new(c) for c in set(_LATE.findall(text)))

    def _normalised(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        if self._unsettled(text):
            return self.own_norm.normalize_str(text)
        return _SPACES.sub(" ", unicodedata.normalize("NFC", text)).replace("Σ", "σ").lower()

    def _words(self, chunk: str) -> list[str]:
        """The chunk's words in byte signs."""
        if chunk.isalpha():
            words = [chunk]
        elif self._unsettled(chunk):
            return [w for w, _ in self.own_cut.pre_tokenize_str(chunk)]
        else:
            words = self.WORDS.findall(chunk)
        return [w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(self._signs) for w in words]

    def _chunk(self, chunk: str) -> tuple[int, bytes, bytes]:
        """Number of tokens, their ids and their spelling, each after a space, of text without white space, or of a special string."""
        if (done := self._once.pop(chunk, None)) is not None:
            self._chunks[chunk] = done
            return done
        if chunk[:1] == "S":
            ids = [int(chunk[1:])]
        else:
            ids = [i for word in self._words(chunk) for i in self.transducer.encode(word)]
        numbers = self._numbers
        done = (len(ids), b"".join([numbers[i] for i in ids]), self.decoder.feed(ids).encode())
        if len(chunk) < 50:
            if len(self._chunks) + len(self._once) >= REMEMBERED:
                self._once.clear()
                if len(self._chunks) > 2 * REMEMBERED // 3:
                    self._chunks.clear()
            self._once[chunk] = done
        return done

    def pieces(self, text: str) -> Iterator[str]:
        """The normalised text in pieces of about ``WINDOW`` code points at most, cut before white space.

        A special string is a piece of its own, written as an S and its id: no normalised text has capitals.
        """
        for i, part in enumerate(self.at_special.split(text) if self.at_special else [text]):
            if i % 2:
                yield f"S{self.merges.special[part]}"
                continue
            at = 0
            while len(part) - at > WINDOW:
                cut = _CUT.search(part, at + WINDOW)
                end = cut.start() if cut else len(part)
                yield self._normalised(part[at:end])
                at = end
            yield self._normalised(part[at:] if at else part)

    def _chunks_of(self, pieces: list[str]) -> tuple[np.ndarray, pa.Array, list[tuple[int, bytes, bytes]]]:
        """The pieces' chunks: where each piece's begin, each chunk's place in the list of distinct ones, and what these come to."""
        lists = pc.ascii_split_whitespace(pa.array(pieces, pa.large_string()))
        coded = lists.values.dictionary_encode()
        return lists.offsets.to_numpy(), coded.indices, [self._chunks.get(c) or self._chunk(c) for c in coded.dictionary.to_pylist()]

    def _absorb(self, held: list[tuple[_Digest, str]]) -> None:
        offsets, codes, found = self._chunks_of([piece for _, piece in held])
        numbers = np.concatenate([[0], np.cumsum(np.array([f[0] for f in found], np.int64)[codes.to_numpy()])]) if found else np.zeros(1, np.int64)
        spelled = [pa.array([f[k] for f in found], pa.large_binary()).take(codes) for k in (1, 2)]
        ends = [np.frombuffer(x.buffers()[1], np.int64)[: len(x) + 1] if len(x) else np.zeros(1, np.int64) for x in spelled]
        data = [memoryview(x.buffers()[2] or b"") for x in spelled]
        for k, (digest, _) in enumerate(held):
            a, b = offsets[k], offsets[k + 1]
            digest.add(int(numbers[b] - numbers[a]), *[d[e[a] : e[b]] for d, e in zip(data, ends, strict=True)])

    def digests(self, texts: Iterable[str]) -> list[tuple[int, str, str]]:
        """(number of ids, SHA-256 of the ids joined by a space, SHA-256 of the decoded text) of each text, in bounded memory."""
        made, held, size = [], [], 0
        for text in texts:
            made.append(_Digest())
            for piece in self.pieces(text):
                held.append((made[-1], piece))
                size += len(piece) + 1
                if size >= WINDOW:
                    self._absorb(held)
                    held, size = [], 0
        if held:
            self._absorb(held)
        return [(d.n, d.ids.hexdigest(), d.words.hexdigest()) for d in made]

    def encode(self, text: str) -> list[int]:
        return [int(i) for piece in self.pieces(text) for chunk in re.split("[ \t-\r]+", piece) for i in (self._chunks.get(chunk) or self._chunk(chunk))[1].split()]


@lru_cache(maxsize=2)
def loaded(path: str) -> WordBpe:
    made = WordBpe(path)
    gc.freeze()  # what a worker keeps till its end isn't looked through for garbage again and again
    return made


def encode_ids(documents: DataFrame, path: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """The rows with an array of token ids added; null texts have none (an empty array)."""

    @F.pandas_udf("array<int>")
    def ids(texts):
        return texts.map(lambda t: loaded(path).encode(t or ""))

    return documents.withColumn(out_col, ids(F.col(text_col)))


def decode_ids(rows: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded", plain: bool = True) -> DataFrame:
    """The rows with the text of their ids added; null ids give an empty text."""

    @F.pandas_udf("string")
    def text(ids):
        def one(row):
            d = Decoder(loaded(path).merges, plain)
            return d.feed(() if row is None else map(int, row)) + d.finish()

        return ids.map(one)

    return rows.withColumn(out_col, text(F.col(ids_col)))


def token_digests(documents: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256 and decoded_sha256 for each row; decoded as the tokenizer file's library decodes.

    Null texts count as empty: no tokens and an empty decoded text. Rows that repeat or tie are encoded each for itself;
    an empty table gives an empty result; other columns are ignored. Rows stay in the task that reads them.
    """
    kind = documents.schema[id_col].dataType

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()  # what earlier tasks of other kinds have left
        bpe = loaded(path)
        for batch in batches:
            found = bpe.digests(t.as_py() or "" for t in batch.column(1))
            n, ids, words = ([x[k] for x in found] for k in range(3))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(words, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents.select(id_col, text_col).mapInArrow(tidy(digest), f"`{id_col}` {kind.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
