"""Word shingles of whole texts as sets of 64-bit hashes, computed for many texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .common import SPACES

#: Words in a shingle.
WORDS = 5
#: Bytes of text that are hashed at a time; longer texts are cut before white space.
CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_U = np.uint64
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[ord(c) for c in SPACES]] = True
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base and of its inverse up to n; those that a chunk needs are kept."""
    if len(_powers.get("up", ())) >= n:
        return _powers["up"], _powers["down"]
    size = max(n, CHUNK + 1)
    up, down = np.full(size, _U(_BASE)), np.full(size, _U(pow(_BASE, -1, 1 << 64)))
    up[0] = down[0] = 1
    up, down = np.cumprod(up), np.cumprod(down)
    if size <= CHUNK + 1:
        _powers["up"], _powers["down"] = up, down
    return up, down


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word starts, and its hash; data begins and ends with white space."""
    space = _IS_SPACE[data]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edges[0::2], edges[1::2]
    hashes, at = np.empty(len(starts), _U), 0
    while at < len(starts):
        base = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, base + CHUNK, "right")))  # a word of more than a chunk is taken alone
        part = data[base : ends[to - 1]]
        up, down = _power_tables(len(part) + 1)
        sums = np.concatenate([np.zeros(1, _U), np.cumsum((part.astype(_U) + _U(1)) * up[: len(part)])])
        a, b = starts[at:to] - base, ends[at:to] - base
        hashes[at:to] = mixed((sums[b] - sums[a]) * down[a] + (b - a).astype(_U))
        at = to
    return starts, hashes


def _sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    starts, words = _words(np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8))
    bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    first = np.searchsorted(starts, bounds)
    rolled = words[: max(0, len(words) - WORDS + 1)].copy()
    for k in range(1, WORDS):
        rolled = mixed(rolled) + words[k : len(words) - WORDS + 1 + k]
    rolled = mixed(rolled)
    for i in range(len(texts)):
        a, b = first[i], first[i + 1]
        if b - a >= WORDS:
            found = np.sort(rolled[a : b - WORDS + 1])
            keep = np.empty(len(found), bool)
            keep[0] = True
            np.not_equal(found[1:], found[:-1], out=keep[1:])
            yield found[keep]
        elif b > a:
            whole = words[a : a + 1].copy()
            for k in range(a + 1, b):
                whole = mixed(whole) + words[k : k + 1]
            yield mixed(whole ^ _U(0xD6E8FEB86659FD93 * int(b - a) & _MASK))
        else:
            yield np.empty(0, _U)


def shingle_sets(texts: Iterator[str | None]) -> Iterator[np.ndarray]:
    """For each text, in order, its set: sorted distinct hashes of its shingles of five words.

    Words are runs of other characters than the contract's white space, A-Z in lower case. A text of one to four words
    has one shingle, the whole sequence; a null or blank text has none. Two different shingles share a hash with a
    chance of 2 to the power -64.
    """
    held, size = [], 0
    for text in texts:
        raw = (text or "").encode("utf-8", "surrogatepass").lower()
        if held and size + len(raw) > CHUNK:
            yield from _sets(held)
            held, size = [], 0
        held.append(raw)
        size += len(raw) + 1
    if held:
        yield from _sets(held)
