"""K-d shards: sizes, slots and the split law on small tables."""

import math
import random
import struct
import zlib
from collections import defaultdict

import xxhash

from tickframe.llm import kd_shards
from tickframe.llm.common import read

SF = "/root/testdata/sf0.001"


def check(rows, shards):
    size, slots = defaultdict(int), defaultdict(list)
    for r in rows:
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
        assert 0 <= r.shard < shards
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return size


def test_whole_table_in_even_shards(spark):
    docs = read(spark, SF, "documents")
    rows = kd_shards.shard_documents(docs, 8).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    assert sorted(r.doc_id for r in rows) == sorted(text)
    for r in rows:
        raw = text[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
    size = check(rows, 8)
    largest = max(r.size for r in rows)
    assert max(size.values()) - min(size.values()) <= 2 * largest


def test_one_hot_value_is_divided(spark):
    df = spark.createDataFrame([(i, "x" * 84, "en", "hot") for i in range(640)], "doc_id long, text string, lang string, source string")
    size = check(kd_shards.shard_documents(df, 5).collect(), 5)
    assert len(size) == 5 and max(size.values()) - min(size.values()) <= 200


def test_splits_follow_the_widest_dimension(spark):
    df = spark.createDataFrame([(i, "x" * 84, "en", "aa" if i % 2 else "zz") for i in range(100)], "doc_id long, text string, lang string, source string")
    rows = kd_shards.shard_documents(df, 2).collect()
    assert {(r.doc_id % 2, r.shard) for r in rows} == {(1, 0), (0, 1)}


def test_edge_rows(spark):
    rows = [(1, None, None, None), (None, "", "en", None), (1, None, None, None), (3, "é" * 10, None, "s"), (4, "long " * 50_000, "en", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumnRenamed("x", "y")
    out = kd_shards.shard_digest(df.withColumn("shard", df.lang)).collect()
    check(out, 40)
    assert sorted((r.doc_id or 0, r.size) for r in out) == [(0, 16), (1, 16), (1, 16), (3, 36), (4, 250_016)]
    assert all(r.law == "bytes" and r.grown_shard is None for r in out)
    assert kd_shards.shard_digest(df.limit(0)).count() == 0


def plain_tree(rows, shards, overhead=16):
    """Shard of each (doc_id, text, lang, source): a recursive k-d tree over sorted lists."""
    meta = []
    ranks = [{v: float(i + 1) for i, v in enumerate(sorted({r[c] for r in rows if r[c] is not None}, key=lambda x: x.encode()))} for c in (3, 2)]
    for k, (doc_id, text, lang, source) in enumerate(rows):
        size = len((text or "").encode()) + overhead
        tie = 42 if doc_id is None else xxhash.xxh64(struct.pack("<q", doc_id), seed=42).intdigest()  # of null Spark hashes nothing
        meta.append((k, size, (ranks[0].get(source, -1.0), ranks[1].get(lang, -1.0), math.log2(size)), float(tie & ((1 << 52) - 1))))
    spread = [max(max(m[2][d] for m in meta) - min(m[2][d] for m in meta), 1e-300) for d in range(3)]
    out = {}

    def cut(items, want):
        """(value, what is below it) where the weights in the order of values pass ``want``."""
        below = 0
        values = sorted({v for v, _ in items})
        for v in values:
            at = sum(w for x, w in items if x == v)
            if below + at > want or v == values[-1]:
                return v, below, at
            below += at

    def split(part, first, n):
        if n == 1 or not part:
            out.update((m[0], first) for m in part)
            return
        wide = [(max(m[2][d] for m in part) - min(m[2][d] for m in part)) / spread[d] for d in range(3)]
        d, want = wide.index(max(wide)), sum(m[1] for m in part) * (n // 2) / n
        v, below, _ = cut([(m[2][d], m[1]) for m in part], want)
        t, tied, at = cut([(m[3], m[1]) for m in part if m[2][d] == v], want - below)
        inside = 2 * (want - below - tied) >= at
        left = [m for m in part if m[2][d] < v or m[2][d] == v and (m[3] < t or inside and m[3] == t)]
        ids = {m[0] for m in left}
        split(left, first, n // 2)
        split([m for m in part if m[0] not in ids], first + n // 2, n - n // 2)

    split(meta, 0, shards)
    return [out[k] for k in range(len(rows))]


def test_equals_a_plain_tree(spark):
    r = random.Random(3)
    sources = ["crawl-2023", "crawl-2024", "crawl-2024-extra", "books", "übersetzt", None]
    rows = [(i, "w" * r.randrange(400), r.choice(["en", "de", "fr", None]), r.choice(sources)) for i in range(300)]
    rows += [(None, "n", "en", "books"), (7, "again", "de", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for shards in (2, 7, 16):
        got = sorted(((x.doc_id, x.size, x.shard) for x in kd_shards.shard_documents(df, shards).collect()), key=str)
        assert got == sorted(((row[0], len(row[1]) + 16, s) for row, s in zip(rows, plain_tree(rows, shards))), key=str), shards


def test_values_that_begin_alike_are_told_apart(spark):
    df = spark.createDataFrame([(i, "x" * 84, "en", "crawl-2023" if i % 2 else "crawl-2024") for i in range(100)], "doc_id long, text string, lang string, source string")
    rows = kd_shards.shard_documents(df, 2).collect()
    assert {(r.doc_id % 2, r.shard) for r in rows} == {(1, 0), (0, 1)}
