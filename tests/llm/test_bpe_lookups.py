"""What the transducer looks up and remembers: no token longer than any with the same beginning, and words that come again."""

import random

from tokenizers import Tokenizer

from ledgerlight.llm import bpe, queries


def test_unknown_words_take_few_lookups(monkeypatch):
    asked = []

    class Counted(dict):
        def get(self, key, default=None):
            asked.append(key)
            return dict.get(self, key, default)

    found, own = bpe.WordBpe(queries.TOKENIZER), Tokenizer.from_file(queries.TOKENIZER)
    monkeypatch.setattr(found.merges, "sound", Counted(found.merges.sound))
    random.seed(5)
    ends = ["tion", "eau", "ment", "çon", "ère", "ing", "ow", "qu", "ñ", "zx"]
    words = ["".join(random.choices(ends, k=random.randint(2, 6))) for _ in range(2000)]
    text = " ".join(words)
    assert found.encode(text) == own.encode(text, add_special_tokens=False).ids
    assert len(asked) < 10 * len(words), len(asked)


def test_words_that_come_again_outlast_those_that_come_once(monkeypatch):
    found, made = bpe.WordBpe(queries.TOKENIZER), []
    encode = found.transducer.encode
    monkeypatch.setattr(bpe, "REMEMBERED", 200)
    monkeypatch.setattr(found.transducer, "encode", lambda w: made.append(w) or encode(w))
    again = [f"{chr(97 + k // 26)}{chr(97 + k % 26)}again" for k in range(50)]
    letters = str.maketrans("0123456789", "abcdefghij")
    texts = [" ".join(again + [f"{1000 * k + i}z".translate(letters) for i in range(140)]) for k in range(1, 20)]
    for text in texts:
        found.digests([text])
        assert len(found._chunks) + len(found._once) <= 200
    assert sum(w in set(again) for w in made) == len(again)
