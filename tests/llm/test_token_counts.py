"""The counting transducer against the tokenizers library."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tickframe.llm import token_counts
from tickframe.llm.common import read

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")
LIB = Tokenizer.from_file(PATH)


def expected(text):
    return len(LIB.encode(text or "", add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def model():
    with open(PATH, encoding="utf-8") as f:
        return token_counts.Transducer(f.read())


ALPHABETS = ["ab", "the inga", "aAbB 'stmdrevl", "''' srtvle", "0123456789.,", " \t\n\r\x0b\x0c\x1c\x85\xa0 x", "éñßüçœÀÉÎ", "éä̧ ",
             "日本語のひ", "각각", "🙂👍🏽‍", "#*$%&|<>!", "ΣσςΑ ά", "İIıi", "²½٣Ⅷ", "\u0000­​�"]


def test_random_texts(model):
    r = random.Random(5)
    for _ in range(3000):
        a = "".join(r.sample(ALPHABETS, r.randint(1, 3)))
        text = "".join(r.choice(a) for _ in range(r.randint(0, 60)))
        assert model.count(text) == expected(text), repr(text)


def test_contractions_and_special_tokens(model):
    for text in ["I've we'll they're it's I'd I'm can't", "'sun 'rex 'lla 'vex ''s \"'s !'re", "a'r a're 'R 'RE 'LL'LL", "x<|endoftext|>y", "<|startoftext|><|endoftext|>",
                 "<|endoftext|", "it'<|endoftext|>s", "<|ENDOFTEXT|>", "'", "'l", "'v e"]:
        assert model.count(text) == expected(text), text


def test_long_words_and_repeats(model):
    r = random.Random(6)
    for text in ["a" * 20_000, "ab" * 5000, "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20_000)), "=" * 3001, "日本" * 2000]:
        assert model.count(text) == expected(text)


def test_documents(model, spark):
    texts = [r.text or "" for r in read(spark, SF, "documents").select("text").collect()]
    assert [model.count(t) for t in texts] == [expected(t) for t in texts]


def test_states_can_be_dropped(model, monkeypatch):
    monkeypatch.setattr(token_counts, "STATES", 50)
    monkeypatch.setattr(token_counts, "STEP", 64)
    text = "The quick brown fox isn't jumping over thirteen lazy dogs; they're asleep. " * 20
    assert model.count(text) == expected(text)
    model.forget()


def test_chunk_maps_compose(model):
    r = random.Random(7)
    for _ in range(200):
        a = "".join(r.sample(ALPHABETS, 3))
        text = model.normal("".join(r.choice(a) for _ in range(r.randint(1, 200))))
        cuts = sorted(r.choices(range(len(text) + 1), k=r.randint(0, 9)))
        maps = [model.chunk_map(text[i:j]) for i, j in zip([0, *cuts], [*cuts, len(text)])]
        prefixes = model.scan(maps)
        assert [model.closed(m) for m in prefixes] == [model.run(text[:j]) for j in [*cuts, len(text)]]
        k = r.randrange(len(maps))
        left, right = model.scan(maps[:k + 1])[-1], model.scan(maps[k + 1:])
        assert model.closed(model.compose(left, right[-1]) if right else left) == model.run(text)


def test_edge_rows_and_long_texts(spark):
    given = [(None, "it's"), (1, None), (2, ""), (3, "x " * 400), (3, "x " * 400), (3, "other"), (4, "they're<|endoftext|>" * 90), (5, "é" * 900), (6, "don't stop 12 " * 70)]
    df = spark.createDataFrame([(d, t, 9, "k") for d, t in given], "doc_id long, text string, n_tokens int, key string")
    want = sorted(((d, len((t or "").encode()), expected(t)) for d, t in given), key=repr)
    assert sorted(map(tuple, token_counts.count_tokens(df, PATH).collect()), key=repr) == want
    assert sorted(map(tuple, token_counts.count_tokens(df, PATH, long_chars=300, chunk_chars=64).collect()), key=repr) == want
    empty = token_counts.token_digest(df.limit(0), PATH)
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
