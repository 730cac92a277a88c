"""Ranked search, the prefix trie and token files against plain Python, on edge cases and empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from ledgerlight.llm import maxscore, prefix_trie, queries, wavelet


def plain_search(documents, items, k=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    docs = [(i, Counter(words(t))) for i, t in documents]
    docs = [(i, c) for i, c in docs if c]
    total = sum(sum(c.values()) for _, c in docs)
    df = Counter(w for _, c in docs for w in c)
    out = []
    for item, text in items:
        found = []
        for i, c in docs:
            m = 10 + (90 * sum(c.values()) * len(docs)) // total
            s = sum(math.floor(1000 * math.log((2 * len(docs) + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 8 * m)) for w in {*words(text)} if w in c)
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("postings", [60, 1 << 21])
def test_search(spark, documents, postings):
    items = [(1, "alpha BETA w3 w3"), (2, "word"), (3, None), (4, ""), (5, "nothing-there é😀"), (6, "t1x1 t2x2 alpha w7 extra"), (6, "t1x1"), (None, "iota 0123456789abcdef01234567")]
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()] + [(None, "t1x1 alpha"), (None, "t1x1 alpha")]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, score double")
    asked = spark.createDataFrame([(*x, 7) for x in items], "item_id long, text string, rank int")
    got = maxscore.search(maxscore.build_index(docs.repartition(3), postings=postings), asked, block=2)
    assert sorted(map(tuple, got.collect()), key=str) == plain_search(rows, items)
    assert maxscore.search(maxscore.build_index(docs.limit(0)), asked).count() == 0
    assert maxscore.search(maxscore.build_index(docs), asked.limit(0)).count() == 0


def test_max_score_probes_few_of_a_common_terms_postings():
    n, rng = 5000, np.random.default_rng(1)
    ms, ids = rng.integers(20, 400, n), rng.permutation(n).astype(np.int64)
    lists = []
    for weight, docs in ((9, np.arange(n)), (2000, np.sort(rng.choice(n, 40, replace=False))), (1500, np.sort(rng.choice(n, 60, replace=False)))):
        tfs = rng.integers(1, 5, len(docs))
        lists.append(maxscore._List(weight, docs, tfs, ms, weight * int(maxscore.impacts(tfs, ms[docs]).max())))
    asked, probe = [], maxscore._List.probe
    sums = np.zeros(n, dtype=np.int64)
    try:
        maxscore._List.probe = lambda self, docs: asked.append((self.weight, len(docs))) or probe(self, docs)
        docs, scores = maxscore.max_score(lists, 10, ids, sums)
    finally:
        maxscore._List.probe = probe
    whole = np.zeros(n, dtype=np.int64)
    for x in lists:
        whole[x.docs] += x.scores()
    best = np.lexsort((ids, -whole))[:10]
    assert docs.tolist() == best.tolist() and scores.tolist() == whole[best].tolist() and not sums.any()
    assert asked[-1][0] == 9 and all(k < 100 for _, k in asked)


def plain_trie(rows, family=100):
    own = defaultdict(list)
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own[c].append((role or "", text or ""))
    nodes, ends = defaultdict(list), defaultdict(list)
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built = tuple(own.get(c - int(math.fmod(c, family)), [])[:h] + mine[h:])
        for d in range(len(built) + 1):
            nodes[built[:d]].append(c)
        ends[built].append(c)
    kids = Counter(p[:-1] for p in nodes if p)
    out = []
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        saved = sum((len(nodes[q]) - 1) * len(q[-1][1]) for q in below if q)
        said = ",".join(map(str, sorted(ends.get(p, []))))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), kids[p], sum(q not in kids for q in below), saved, hashlib.sha256(said.encode()).hexdigest()))
    return sorted(out, key=str)


def test_prefix_trie(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "bb", "é😀", None, ""])) for c in [*range(-3, 12), *range(95, 106), 205, 310] for t in range(rng.randint(1, 7))]
    rows += [(100, None, "system", "first"), (5, 40, "user", "x" * 100_000), (None, 0, "user", "nobody"), (None, None, None, None)]
    frame = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, depth int, base string")
    assert sorted(map(tuple, prefix_trie.prefix_trie(frame.repartition(3)).collect()), key=str) == plain_trie(rows)
    assert prefix_trie.prefix_trie(frame.limit(0)).count() == 0


def test_repeated_turns_and_turnless_conversations(spark):
    same = [(0, 0, "user", "q"), (0, 1, "assistant", "a")]
    lone = next(c for c in range(201, 300) if zlib.crc32(str(c).encode()) % 6 >= 2)
    rows = [*same, *same, (lone, 0, "user", "only"), (7, 0, "user", "q"), (7, 0, "user", "q")]
    got = prefix_trie.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    root = next(r for r in got if r["depth"] == 0)
    assert sorted(map(tuple, got), key=str) == plain_trie(rows)
    assert root["n_convs"] == 3 and root["ends_sha256"] == hashlib.sha256(str(lone).encode()).hexdigest()


TEXTS = ["", " ", "\n\n a", "it's  fine,\t b 　c ", "a\x1c  b\x85 c", "12 345  é😀 x y", "<|endoftext|> a<|endoftext|>", "x" * 5000, "one  two   three \n", " \x1f \x1e b's 'LL 've", "᠎ b ​  c"]


def test_words_are_encoded_as_the_library_encodes_texts():
    rng, library = random.Random(5), Tokenizer.from_file(queries.BYTE_TOKENIZER)
    signs = "ab1é😀'.-s \n\t\r\x0b\x1c\x85\xa0 　᠎​"
    latin = [chr(c) for c in range(0x250)] + list(" '  \n\tab12.,") * 30
    ours = wavelet.Encoder(queries.BYTE_TOKENIZER)
    assert ours.by_word
    for text in [*TEXTS, *("".join(rng.choice(s) for _ in range(rng.randint(1, 60))) for s in (signs, latin) for _ in range(3000))]:
        assert np.frombuffer(ours.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
    words = wavelet.Encoder(queries.TOKENIZER)
    assert not words.by_word and np.frombuffer(words.encode("Ab c"), "<u4").tolist() == words.tokenizer.encode("Ab c", add_special_tokens=False).ids


def test_words_that_come_again_outlast_those_that_come_once(monkeypatch):
    monkeypatch.setattr(wavelet, "WORDS", 30)
    ours, library, made = wavelet.Encoder(queries.BYTE_TOKENIZER), Tokenizer.from_file(queries.BYTE_TOKENIZER), []
    monkeypatch.setattr(ours, "_model", lambda part, make=ours._model: made.append(part) or make(part))
    for k in range(200):
        text = f" often come these four and once{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}{'uv'[k // 100]}"
        assert np.frombuffer(ours.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(made) == len(set(made)) == 205


@pytest.mark.parametrize("n, high", [(0, 5), (1, 1), (7, 2), (3000, 40), (200_000, 1 << 31)])
def test_a_shard_answers_as_its_ids_do(n, high):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.02, n) * (high // 50 + 1), high).astype("<u4")
    data = wavelet.packed_shard(ids, [3, None][: bool(n) * 2], [n // 2, n][: bool(n) * 2])
    shard = wavelet.Shard(lambda a, k: data[a : a + k])
    assert shard.ids().tolist() == ids.tolist()
    for token in {*ids[:3].tolist(), 999_999_999}:
        at = np.flatnonzero(ids == token)
        assert shard.count(token) == len(at)
        assert [shard.select(token, k) for k in range(0, len(at), 97)] == at[::97].tolist()
        for i in (0, 1, n // 3, n):
            assert shard.rank(token, i) == int((ids[:i] == token).sum())
    assert [shard.access(i) for i in range(0, n, 4999)] == ids[::4999].tolist()
    with pytest.raises(IndexError):
        shard.access(n)


def test_token_files(spark, documents, tmp_path):
    library = Tokenizer.from_file(queries.BYTE_TOKENIZER)
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()] + [(None, "none"), (-4, "before all"), *((300 + i, t) for i, t in enumerate(TEXTS))]
    frame = spark.createDataFrame([(i, t, 1, "s") for i, t in rows], "doc_id long, text string, start int, part string")
    shards = wavelet.write_shards(frame.repartition(5), f"file://{tmp_path}/files", queries.BYTE_TOKENIZER, 2, shard_ids=4000)
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append(library.encode(t or "", add_special_tokens=False).ids + [2])
    got = sorted((tuple(r) for r in wavelet.read_documents(shards).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [*sorted(i for i, _ in rows if i is not None), None]
    at, everything = 0, []
    for i, start, n, crc in got:
        ids = next(x for x in want[i] if (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) == (n, crc))
        want[i].remove(ids)
        everything += ids
        assert start == at
        at += n
    assert not any(want.values()) and shards.directory.count() > 5
    token = Counter(everything).most_common(20)[-1][0]
    assert {r["token"]: r["n"] for r in wavelet.count_tokens(shards, [2, token, 50_000]).collect()} == {t: everything.count(t) for t in (2, token, 50_000)}
    assert sorted(r["place"] for r in wavelet.occurrences(shards, token).collect()) == [k for k, x in enumerate(everything) if x == token]
    assert wavelet.write_and_read_back(frame.limit(0), queries.BYTE_TOKENIZER, 2).count() == 0
