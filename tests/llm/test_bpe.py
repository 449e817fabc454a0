"""The backtracking encoder against the tokenizers library, and exact round trips."""

import hashlib
import random
import struct

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tickframe.llm import bpe
from tickframe.llm.common import read

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def model():
    with open(PATH, encoding="utf-8") as f:
        return bpe.Bpe(f.read())


def ids(packed):
    return list(struct.unpack(f"<{len(packed) // 4}I", packed))


def same(model, text):
    got = model.encode(text)
    assert ids(got) == LIB.encode(text, add_special_tokens=False).ids, text[:80]
    assert model.decode(got) == LIB.decode(ids(got), skip_special_tokens=False)


def test_random_and_repeated_characters(model):
    r = random.Random(3)
    alphabets = ["ab", "the inga", "aAbB 'stmd", "0123456789.,", " \t\n\r\x0b\x0c\x1c\x85\xa0 x", "éñßüçœ", "日本語のひ", "🙂👍🏽‍", "#*$%&|<>!"]
    for _ in range(600):
        a = "".join(r.sample(alphabets, r.randint(1, 3)))
        same(model, "".join(r.choice(a) for _ in range(r.randint(0, 60))))
    for c in " aeéñ0=-\n🙂":
        for n in (1, 2, 7, 64, 65, 300):
            same(model, c * n)


def test_every_code_point(model):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(points), 20_000):
        same(model, "a".join(points[k:k + 20_000]))
        same(model, " ".join(points[k:k + 20_000]))


def test_special_strings_and_long_texts(model, monkeypatch):
    same(model, "x<|endoftext|><|endoftext|> y <|endoftext|>")
    text = "word " * 50 + "\n\n  and  spaces \t" * 40 + "x" * 500 + " it's we'll " * 30
    monkeypatch.setattr(bpe, "CHUNK", 16)
    monkeypatch.setattr(bpe, "CACHED", 5)
    same(model, text)


def test_tokens_encode_to_themselves(model):
    for t in random.Random(1).sample([t for t in model.text[:50256]], 2000):
        try:
            same(model, t.decode())
        except UnicodeDecodeError:
            pass


def test_query_equals_library(spark):
    docs = read(spark, SF, "documents")
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.bpe_digest(docs, PATH).collect()}
    for r in docs.collect():
        e = LIB.encode(r.text, add_special_tokens=False).ids
        sha = hashlib.sha256(struct.pack(f"<{len(e)}I", *e)).hexdigest()
        assert got[r.doc_id] == (len(e), sha, hashlib.sha256(LIB.decode(e, skip_special_tokens=False).encode()).hexdigest())


def test_edge_rows(spark):
    rows = [(1, None, "a"), (2, "", "b"), (2, "", "b"), (None, "text", None), (4, "long text " * 100_000, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    enc = bpe.encode(df, PATH)
    assert enc.columns == ["doc_id", "ids"] and enc.count() == 5
    back = bpe.decode(enc, PATH).collect()
    assert sorted(((r.doc_id, r.text) for r in back), key=str) == sorted(((d, t or "") for d, t, _ in rows), key=str)
    assert bpe.bpe_digest(df.limit(0), PATH).count() == 0
