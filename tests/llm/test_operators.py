"""Each operator against a plain Python version, a library or an exact round trip, on edge cases and empty tables."""

import base64
import hashlib
import heapq
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlight.llm import bpe, chat_format, exact_dedup, grid_join, mixing, ngram_join, queries, secret_scan, sharding, toxicity, warc

from .conftest import SF, components, jaccard_components

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def pairs(documents):
    return [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]


def test_warc(spark):
    rows = [(1, "http://www.A.example.com/x?y#z", "same"), (2, "http://a.example.com/x?y", "same"), (3, None, None), (4, "", ""), (5, "http://b.org\tq/\n", "é" * 5000), (6, "http://a.com/\\\0x\\t", "nul"), (7, "http://a.com/\\\\t\t\n", "back")]
    rows += [(10 + i, "http://hot.example.com/", f"page {i}") for i in range(2500)]
    pages = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, length int")
    got = {r["page_id"]: r for r in warc.archive_and_read_back(pages).collect()}
    assert len(got) == len(rows)
    first = {}
    for i, _, h in rows:
        first.setdefault(h or "", i)
    for i, _, h in rows:
        data, r = (h or "").encode(), got[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first[h or ""] == i else ("revisit", first[h or ""]))
    assert got[1]["key"] == got[2]["key"] == "com,example,a)/x?y"
    assert warc.archive_and_read_back(pages.limit(0)).count() == 0


def test_warc_lookup_finds_only_its_keys(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h{i % 50}.com/{i}", str(i)) for i in range(3000)], "page_id long, url string, html string")
    archive = warc.write_archive(pages, f"file://{tmp_path}", lines=100)
    keys = spark.createDataFrame([("com,h7)/7",), ("com,none)/",)], "key string")
    assert [(r["key"], r["page_id"]) for r in warc.lookup(archive, keys).collect()] == [("com,h7)/7", 7)]


def spans(text):
    found = []
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
    for at, (kind, form, group, least) in enumerate((("assign", assign, 2, 6), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24))):
        found += [(m.start(), at, f"{kind}:{m.start()}:{m.end()}") for m in form.finditer(text) if len(m[group]) >= least]
    return ",".join(x[2] for x in sorted(found))


def test_secret_scan(spark, documents):
    found, ledger = secret_scan.scan_history(documents, ["doc_id"], "text")
    assert Counter((r["doc_id"], r["spans"]) for r in found.collect()) == Counter((i, spans(t or "")) for i, t in pairs(documents))
    again, fresh = secret_scan.scan_history(documents, ["doc_id"], "text", ledger)
    assert fresh.count() == 0 and again.exceptAll(found).count() == 0
    assert secret_scan.scan_history(documents, ["doc_id"], "text", ledger, rule_version="next")[1].count() == ledger.count()
    assert secret_scan.scan_history(documents.limit(0), ["doc_id"], "text")[0].count() == 0


def test_ngram_join(spark, documents):
    sets, roots = jaccard_components(pairs(documents))
    got = ngram_join.near_copies(documents).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == {(i, len(s), roots[i]) for i, s in sets.items()}
    assert len(got) == documents.count()
    assert ngram_join.near_copies(documents.limit(0)).count() == 0


def test_ngram_join_with_many_frequent_tokens(spark, documents, monkeypatch):
    monkeypatch.setattr(ngram_join, "FREQUENT", 4)
    monkeypatch.setattr(ngram_join, "SHORT", 3)
    random = np.random.default_rng(3)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for g in range(12):
        text = list(random.choice(words, 50))
        for k in range(9):
            copy = list(text)
            for at in random.choice(50, k // 2, replace=False):
                copy[at] = f"v{random.integers(40)}"
            rows.append((g * 100 + k, " ".join(copy)))
    sets, roots = jaccard_components(rows)
    got = ngram_join.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == set(roots.items())


def test_ngram_join_of_a_large_group_and_its_outliers(spark):
    """Copies of one text with few and many edits, some edits shared, lengths that differ, and short lists of rare words."""
    random = np.random.default_rng(8)
    base, rows = [f"w{i}" for i in range(150)], []
    for k in range(260):
        text = list(base[: int(random.integers(100, 151))])
        for at in random.choice(len(text), int(random.integers(0, 9)), replace=False):
            text[at] = f"v{random.integers(12)}" if random.random() < 0.5 else f"u{k}x{at}"
        rows.append((k, " ".join(text)))
    sets, roots = jaccard_components(rows)
    assert 1 < len(set(roots.values())) < 200
    got = ngram_join.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == set(roots.items())


def test_entries_of_similar_sets_meet():
    random = np.random.default_rng(5)
    for _ in range(300):
        n = int(random.integers(1, 200))
        x = np.unique(random.integers(0, 1 << 62, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[random.random(len(x)) > 0.12], random.integers(0, 1 << 62, n // 12).astype(np.uint64)]))
        shared = len(np.intersect1d(x, y))
        if not len(y) or 4 * shared < 3 * (len(x) + len(y) - shared):
            continue
        often = set(x[random.random(len(x)) < random.random()].tolist())
        a, b = (ngram_join.entries(s, np.array([int(t) in often for t in s]))[0] for s in (x, y))
        assert len(np.intersect1d(a, b)), (len(x), len(y), shared)


TOKENS = queries.TOKENIZER


def test_bpe(spark, documents):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(TOKENS)
    more = ["<|endoftext|> x<|startoftext|>", "ÀÉ İ ΣΑΣ ǅ ﬁ", "don't we'LL", "\x1c\x85\xa0 a\x00b", "日本語😀", "ab" * 2000, "é́"]
    rows = documents.select("doc_id", "text").unionByName(spark.createDataFrame([(900 + i, t) for i, t in enumerate(more)], "doc_id long, text string"))
    expected = Counter()
    for i, t in pairs(rows):
        ids = own.encode(t or "", add_special_tokens=False).ids
        expected[i, len(ids), sha(" ".join(map(str, ids))), sha(own.decode(ids, skip_special_tokens=False))] += 1
    assert Counter(tuple(r) for r in bpe.token_digests(rows, TOKENS).collect()) == expected
    assert bpe.token_digests(rows.limit(0), TOKENS).count() == 0


def test_bpe_keeps_constant_memory_and_decodes_bytes():
    found = bpe.loaded(TOKENS)
    word, held = "abcde" * 4000, []
    common = found.transducer._common
    found.transducer._common = lambda start, base, at: held.append(len(start)) or common(start, base, at)
    n = len(list(found.transducer.encode(word)))
    del found.transducer._common
    assert n and max(held) < 3 * bpe.EVERY
    for raw in (b"a\xc3\xa9\xff\xe2\x82", b"\xf0\x9f\x98\x80\xed\xa0\x80", b"\xc0\x80\xf4\x90"):
        machine = bpe.Utf8()
        assert "".join(machine.feed(bytes([b])) for b in raw) + machine.finish() == raw.decode("utf-8", "replace")
    assert bpe.Decoder(found.merges, plain=True).feed(found.encode("Hello, wörld")) == "hello , wörld "


def test_bpe_of_random_texts_in_small_pieces(monkeypatch):
    """White space of all kinds, control signs, marks, special strings and code points of late versions of Unicode, against the library."""
    import random

    from tokenizers import Tokenizer

    own, found = Tokenizer.from_file(TOKENS), bpe.loaded(TOKENS)
    monkeypatch.setattr(bpe, "WINDOW", 100)
    random.seed(1)
    signs = [chr(c) for c in (*range(0x250), 0x3A3, 0x130, 0x2019, 0x2028, 0x3000, 0x65E5, 0x1F600, 0x301, 0x558, 0x1C89, 0x345, 0x1100, 0x1161, 0x323B0, 0xFB01)]
    signs += [" "] * 300 + list("abcdefghijklmnop'") * 20 + ["<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "'s", "'LL"] * 5
    texts = ["".join(random.choices(signs, k=random.randint(0, 500))) for _ in range(300)] + ["abcde" * 4000, "é" * 3000, "ación" * 999]
    wanted = [own.encode(t, add_special_tokens=False).ids for t in texts]
    assert [found.encode(t) for t in texts] == wanted
    assert found.digests(texts) == [(len(i), sha(" ".join(map(str, i))), sha(own.decode(i, skip_special_tokens=False))) for i in wanted]
    assert max(len(p) for t in texts[:300] for p in found.pieces(t)) < 1000


def test_sharding(spark, documents):
    rows = sharding.shard_documents(documents).collect()
    text = dict(pairs(documents))
    where, slots, loads = defaultdict(set), defaultdict(list), Counter()
    for r in rows:
        raw = (text[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["grown_shard"]) == (len(raw) + 8, zlib.crc32(raw), None)
        where[raw].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
        loads[r["shard"]] += r["size"]
    assert len(rows) == documents.count() and all(len(s) == 1 for s in where.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert loads == one_by_one(rows, text)
    assert sharding.shard_documents(documents.limit(0)).count() == 0


def one_by_one(rows, text, shards=24):
    """The shards' loads where each group of equal texts, from the largest down, goes to the least loaded one."""
    groups = Counter()
    for r in rows:
        groups[text[r["doc_id"]] or ""] += r["size"]
    heap = [(0, s) for s in range(shards)]
    for size in sorted(groups.values(), reverse=True):
        load, shard = heapq.heappop(heap)
        heapq.heappush(heap, (load + size, shard))
    return Counter({s: load for load, s in heap if load})


def test_sharding_takes_sizes_as_one_by_one():
    random = np.random.default_rng(4)
    for _ in range(200):
        shards, sizes = int(random.integers(1, 9)), Counter(int(x) for x in random.integers(1, 30, random.integers(0, 200)))
        heap = [(0, s) for s in range(shards)]
        for size in sorted(sizes.elements(), reverse=True):
            load, shard = heapq.heappop(heap)
            heapq.heappush(heap, (load + size, shard))
        plan = list(sharding.longest_first(sorted(sizes.items(), reverse=True), shards))
        assert all(sum(taken) == sizes[size] for size, taken in plan)
        assert {s: sum(size * taken[s] for size, taken in plan) for s in range(shards)} == {s: load for load, s in heap}


def test_sharding_of_documents_and_many_equal_sizes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").unionByName(spark.range(10_000, 12_000).selectExpr("id as doc_id", "cast(id as string) as text"))
    rows, loads = sharding.shard_documents(docs).collect(), Counter()
    for r in rows:
        loads[r["shard"]] += r["size"]
    assert len(rows) == 3000 and loads == one_by_one(rows, dict(pairs(docs)))


def test_mixing_against_a_plain_sampler(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "source")
    got = {r["doc_id"]: r for r in mixing.mix(docs).collect()}
    rows = docs.select("doc_id", "source", F.xxhash64("doc_id", F.lit(mixing.SEED)).alias("h")).collect()
    by_source = defaultdict(list)
    for r in rows:
        by_source[r["source"]].append((r["doc_id"], got[r["doc_id"]]["size"], ((r["h"] % 2**64 >> 11) + 0.5) / 2**53))
    for source, docs_of in by_source.items():
        target = got[docs_of[0][0]]["target"]
        low, high = 0.0, 1e9
        for _ in range(200):  # the level at which expected words come to the target
            level = (low + high) / 2
            low, high = (level, high) if sum(n * min(2, level * n**0.5) for _, n, _ in docs_of if n) < target else (low, level)
        copies, ranked = {}, []
        for i, n, u in docs_of:
            expected = min(2, high * n**0.5) if n else 0
            expected = round(expected) if abs(expected - round(expected)) < 1e-6 else expected
            copies[i] = int(expected)
            if part := expected - int(expected):
                ranked.append((u / (1 - u) * (1 - part) / part, i, n))
        left = target - sum(copies[i] * n for i, n, _ in docs_of)
        before = 0
        for _, i, n in sorted(ranked):
            copies[i] += before + n / 2 <= left
            before += n
        wrong = sum(copies[i] != got[i]["copies"] for i, _, _ in docs_of)
        assert wrong <= 1, (source, wrong)  # but for a document at the very edge of the words left
        assert abs(sum(got[i]["taken"] for i, _, _ in docs_of) - target) <= max(n for _, n, _ in docs_of)


def test_mixing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("source", F.when(F.col("source") != "src3", F.col("source")))
    first, again = (mixing.mix(docs).collect() for _ in range(2))
    assert sorted(first) == sorted(again)
    sizes, targets, taken = Counter(), {}, Counter()
    source = {r["doc_id"]: r["source"] for r in docs.select("doc_id", "source").collect()}
    for r in first:
        s = source[r["doc_id"]]
        sizes[s] += r["size"]
        targets[s] = r["target"]
        taken[s] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    names = sorted(s for s in sizes if s is not None) + [None]
    weight, want, open_ = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}, {}, set(names)
    left = 1.5 * sum(sizes.values())
    while True:
        want |= {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = {s for s in open_ if want[s] > 2 * sizes[s]}
        if not over:
            break
        want |= {s: 2 * sizes[s] for s in over}
        open_ -= over
        left -= sum(want[s] for s in over)
    for s in names:
        assert targets[s] == pytest.approx(want[s]) and taken[s] == pytest.approx(want[s], rel=0.1)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixing_edge_cases(spark, documents):
    rows = mixing.mix(documents).collect()
    assert len(rows) == documents.count() and all(r["taken"] == 0 for r in rows if r["size"] == 0)


def test_toxicity(spark, documents):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    scored = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    marks = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    held = [(scored[i]["score"], t) for i, t in marks.items() if scored[i]["held_out"]]
    assert len(scored) == docs.count() and all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in scored.items())
    bad, good = [s for s, t in held if t], [s for s, t in held if not t]
    assert np.mean([[(b > g) + (b == g) / 2 for g in good] for b in bad]) > 0.75
    none = labels.limit(0)
    assert {r["predicted"] for r in toxicity.toxicity(documents, none).collect()} == {0}
    assert toxicity.toxicity(documents.limit(0), labels).count() == 0


def groups(documents):
    text = defaultdict(list)
    for i, t in pairs(documents):
        text[re.sub("[ \t-\r]", "", t or "")].append((-len(t or ""), i))
    return {(i, min(v)[1], len(v), i == min(v)[1], sha(k)) for k, v in text.items() for _, i in v}


def test_exact_dedup(spark, documents):
    assert {tuple(r) for r in exact_dedup.exact_groups(documents).collect()} == groups(documents)
    weak = exact_dedup.exact_groups(documents, block=7, hashed=lambda b: F.length(b).cast("long"))
    assert {tuple(r) for r in weak.collect()} == groups(documents)
    assert exact_dedup.exact_groups(documents.limit(0)).count() == 0
    kept = exact_dedup.drop_copies(documents)
    assert kept.columns == documents.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({k for _, k, *_ in groups(documents)})


def test_chat_format(spark):
    rows = [(1, 0, "user", "</s>[INST] \\ <s>"), (1, 1, "assistant", "a\n\\<\\/s>[/INST]"), (1, 2, None, None), (1, 3, "assistant", "b"), (2, 0, "system\nx", "<s>"), (None, 0, "user", "q"), (3, 1, "assistant", "t"), (3, 1, "assistant", "t")]
    turns = spark.createDataFrame([(*r, 5) for r in rows], "conv_id long, turn long, role string, text string, seq int")
    stream = chat_format.format_turns(turns)
    said = defaultdict(list)
    for c, _, r, t in rows:
        said[c].append((r or "", t or ""))
    got = {r["conv_id"]: r for r in chat_format.read_back(stream).collect()}
    assert got.keys() == said.keys()
    for c, turns_of in said.items():
        loss = "".join(t for r, t in turns_of if r == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"]) == (len(turns_of), sha("".join(f"{r}\n{t}\n" for r, t in turns_of)))
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), sha(loss))
    full = sorted((r["conv_id"], r["example"], r["prompt"], r["target"]) for r in chat_format.rendered(stream.where("conv_id = 1")).collect())
    assert len(full) == 2 and full[1][2].startswith("<s>user[INST]<\\/s>") and full[1][3] == "b"
    assert chat_format.format_and_read_back(turns.limit(0)).count() == 0


def test_embedding_dedup(spark):
    random = np.random.default_rng(1)
    rows = []
    for g in range(40):
        centre = random.normal(size=16)
        rows += [(len(rows) + k, (centre + random.normal(size=16) * (0.03 + 0.4 * (k % 3 == 0))).tolist()) for k in range(random.integers(1, 30))]
    rows += [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (5003, [None] + [1.0] * 15), (5004, [1.0, 2.0]), (5005, [2.0, 4.0]), (5006, [])]
    rows += [(6000 + i, rows[0][1]) for i in range(30)]
    table = spark.createDataFrame([(i, v, 0, 1) for i, v in rows], "vec_id long, embedding array<double>, label int, n int")
    sound = {i: np.array(v) for i, v in rows if v and None not in v and np.isfinite(v).all() and np.any(v)}
    links = [(a, b) for a in sound for b in sound if a < b and len(sound[a]) == len(sound[b]) and sound[a] @ sound[b] / np.sqrt((sound[a] @ sound[a]) * (sound[b] @ sound[b])) >= 0.9]
    degree, roots = Counter(x for p in links for x in p), components([i for i, _ in rows], links)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in grid_join.link_vectors(table, block=16, leaf=8).collect()}
    assert got == {i: (degree[i], roots[i], roots[i] == i) for i, _ in rows}
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in grid_join.link_vectors(table, leaf=4).collect()} == got
    assert grid_join.link_vectors(table.limit(0)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
    assert {r["doc_id"] for r in p.exact_dedup(spark, docs, SF).collect()} == {k for _, k, *_ in groups(docs)}
    _, roots = jaccard_components(pairs(docs))
    assert {r["doc_id"] for r in p.near_dedup(spark, docs, SF).collect()} == set(roots.values())
    copies = Counter(r["doc_id"] for r in p.mixing(spark, docs, SF).collect())
    assert copies == Counter({r["doc_id"]: r["copies"] for r in mixing.mix(docs).where("copies > 0").collect()})
    assert p.run(spark, SF).count() > 0
