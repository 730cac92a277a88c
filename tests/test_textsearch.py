"""Similar texts and canonical names against plain Python over all pairs, and how few pairs are compared."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerlight.operators import similarity
from ledgerlight.operators.textsearch import Batch, Best, _streamed, _tiled, best_texts

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def words(rng, n):
    return ["".join(rng.choice(LETTERS) for _ in range(rng.randint(3, 9))) for _ in range(n)]


def typo(rng, text):
    i = rng.randrange(len(text))
    return text[:i] + rng.choice(LETTERS) + text[i + 1 :]


def all_pairs(text, rows, k):
    return sorted(((1.0 if other == text else similarity.token_set_ratio(text, other) / 100, first, other) for other, first in rows), key=lambda x: (-x[0], x[1]))[:k]


ODD = ["", " ", "x" * 64, "x" * 65, "x" * 64 + " y", "a" * 300, "a" * 299 + " b", "b b a", "a b", "é 😀", "😀", " ".join(map(str, range(90))), " ".join(map(str, range(1, 91)))]


@pytest.mark.parametrize("kind", ["few words", "many words", "typos"])
def test_the_best_texts_are_those_of_all_pairs(kind):
    rng = random.Random(kind)
    if kind == "few words":
        texts = ODD + [" ".join(rng.choice("ab c d é 😀 ef".split()) for _ in range(rng.randint(1, 5))) for _ in range(150)]
    elif kind == "many words":
        v = words(rng, 300)
        texts = ODD + [" ".join(rng.sample(v, rng.randint(2, 12))) for _ in range(150)]
    else:
        v = words(rng, 40)
        base = [" ".join(rng.sample(v, 5)) for _ in range(40)]
        texts = base + [typo(rng, b) for b in base for _ in range(3)]
    rows = [(t, f"w{i:04d}") for i, t in enumerate(dict.fromkeys(texts))]
    rng.shuffle(rows)
    for text, _ in rows:
        one = Best(text, 4)
        for a in range(0, len(rows), 60):
            one.add(Batch(rows[a : a + 60]))
        assert one.found == all_pairs(text, rows, 4), text


def test_few_pairs_of_an_agencys_different_texts_are_compared(spark):
    """10,000 different texts of one agency, each with some that are like it: a tile's stream compares a small share of all pairs."""
    rng = random.Random(1)
    v = words(rng, 400)
    base = [" ".join(rng.sample(v, 8)) for _ in range(500)]
    rows = [("a", t, f"w{i:05d}") for i, t in enumerate(dict.fromkeys([*base, *(typo(rng, b) for b in base for _ in range(20))]))]
    frame = spark.createDataFrame(rows, "block string, key string, first string")
    tiles = _tiled(frame, "block", "key", "first", 1024)
    one = tiles.select("_tile").distinct().first()[0]
    compared, best = 0, []
    for _, left, some, _ in _streamed(iter(tiles.where(F.col("_tile") == one).sort("_side").toArrow().to_batches())):
        best = best or [Best(text, 9) for text, _ in left[::20]]
        batch = Batch(some)
        for x in best:
            x.add(batch)
    compared = sum(x.compared for x in best)
    assert len(rows) > 9_000 and len(best) > 20 and compared < 0.05 * len(rows) * len(best)


def test_tiles_of_a_large_block_give_what_one_gives(spark):
    rng = random.Random(4)
    v = words(rng, 60)
    rows = [(rng.choice([1, 1, 1, 2]), " ".join(rng.sample(v, 4))) for _ in range(260)] + [(None, "a b"), (3, None), (3, "alone")]
    rows = [(b, t, f"w{i:03d}") for i, (b, t) in enumerate(dict.fromkeys(rows))]
    frame = spark.createDataFrame(rows, "block int, key string, first string")
    got = defaultdict(list)
    for r in sorted(best_texts(frame, "block", "key", "first", 3, tile=16).collect(), key=lambda r: r["nth"]):
        got[r["block"], r["key"]].append((r["score"], r["other"]))
    for block, text, _ in rows:
        if block is not None and text is not None:
            of = [(t, f) for b, t, f in rows if b == block and t is not None]
            assert got.pop((block, text)) == [(s, o) for s, _, o in all_pairs(text, of, 3)]
    assert not got and best_texts(frame.limit(0), "block", "key", "first", 3).count() == 0


def sequential(rows, floor=90):
    first = {}
    for block, name, at in rows:
        if name is not None:
            first[block, name] = min(at, first.get((block, name), at))
    kept, out = defaultdict(list), {}
    for (block, name), _ in sorted(first.items(), key=lambda x: (x[1], x[0][1])):
        best = max(((similarity.token_sort_ratio(name, k), -i) for i, k in enumerate(kept[block])), default=(0.0, 0))
        if best[0] >= floor:
            out[block, name] = (kept[block][-best[1]], best[0])
        else:
            kept[block].append(name)
            out[block, name] = (name, None)
    return out


def test_canonical_names_are_those_of_the_sequence(spark):
    rng = random.Random(9)
    chain = ["n" * 10]
    for i in range(24):  # each near to the one before: rounds that wait for each other
        chain.append(chain[-1][: i % 10] + LETTERS[i % 26] + chain[-1][i % 10 + 1 :])
    base = ["DISTRICT PLANNING OFFICER " + w.upper() for w in words(rng, 12)]
    names = base + [typo(rng, b) for b in base for _ in range(6)] + ["OFFICER DISTRICT PLANNING X", "", " ", "B B A", "A B B", "y" * 70, "y" * 69 + "z"]
    rows = [(rng.choice(["d1", "d1", "d2", None]), n, rng.randint(-50, 50)) for n in names * 2] + [("chain", c, i) for i, c in enumerate(chain)] + [("d1", None, 1)]
    frame = spark.createDataFrame(rows, "block string, name string, at long")
    got = {(r["block"], r["name"]): (r["canonical"], r["score"]) for r in similarity.canonical_names(frame, "block", "name", "at").collect()}
    assert got == sequential(rows)
    assert similarity.canonical_names(frame.limit(0), "block", "name", "at").count() == 0
