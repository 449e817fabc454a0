"""Importance resampling against a plain version, and its selection on labelled rows."""

import math
import random
import re
from zlib import crc32

import numpy as np
from pyspark.sql import functions as F

from tickframe.llm import resample as R
from tickframe.llm.common import byte_pieces, read
from tickframe.llm.select import top_rows

SF = "/root/testdata/sf0.01"


def plain_ngrams(text, buckets):
    m, mask = [int(x) for x in R.MIX], (1 << 64) - 1
    t = [crc32(x) for x in re.findall(rb"[0-9A-Za-z_\x80-\xff]+|[^\s0-9A-Za-z_\x80-\xff]+", (text or "").encode())]
    return [((h & mask) >> 20) % buckets for h in [a * m[0] for a in t] + [a * m[1] + b * m[2] for a, b in zip(t, t[1:])]]


def test_pieces_do_not_matter(monkeypatch):
    text = "some words, and !! more words\n" * 40
    monkeypatch.setattr(R, "byte_pieces", lambda raw: byte_pieces(raw, 16))
    assert sorted(np.concatenate(list(R.ngrams(text, 997)))) == sorted(plain_ngrams(text, 997))


def test_log_weights_equal_plain(spark):
    docs, labels = read(spark, "/root/testdata/sf0.001", "documents"), read(spark, "/root/testdata/sf0.001", "labels")
    rows, good = docs.select("doc_id", "text").collect(), {r.doc_id for r in labels.filter("quality = 1").collect()}
    grams = {r.doc_id: plain_ngrams(r.text, 500) for r in rows}
    raw, target = np.zeros(500), np.zeros(500)
    for d, g in grams.items():
        np.add.at(raw, g, 1)
        if d in good:
            np.add.at(target, g, 1)
    ratio = np.log(target + 1) - math.log(target.sum() + 500) - np.log(raw + 1) + math.log(raw.sum() + 500)
    got = R.resample(docs, labels, buckets=500).collect()
    assert len(got) == len(rows)
    for r in got:
        assert abs(r.log_weight - sum(ratio[grams[r.doc_id]])) < 1e-6 and r.n_grams == len(grams[r.doc_id])
    k = math.ceil(len(rows) * R.good_share(labels, 2.0))
    assert {r.doc_id for r in got if r.selected} == {r.doc_id for r in sorted(got, key=lambda r: -r.gumbel_key)[:k]}


def test_clean_rows_stay_and_junk_goes(spark):
    docs, labels = read(spark, SF, "documents"), read(spark, SF, "labels")
    kept = R.select_documents(docs, labels)
    assert kept.columns == docs.columns
    share = {r.quality: r.n for r in kept.join(labels, "doc_id").groupBy("quality").agg(F.count("*").alias("n")).collect()}
    total = {r.quality: r.n for r in labels.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    assert share[1] >= 0.98 * total[1] and share.get(0, 0) <= 0.2 * total[0]


def test_selection_is_gumbel(spark):
    """Of two rows with weights 1 and 3 the second is drawn first three times in four."""
    df = spark.range(20_000).withColumnRenamed("id", "doc_id").withColumn("k", F.log((F.col("doc_id") % 2) * 2 + 1) + R.gumbel(3))
    won = df.groupBy(F.expr("doc_id div 2")).agg(F.max_by(F.col("doc_id") % 2, "k").alias("w")).agg(F.avg("w")).first()[0]
    assert abs(won - 0.75) < 0.02


def test_top_rows_with_ties(spark):
    r = random.Random(2)
    rows = [(i, r.choice([1.5, 2.0, -3.25, None, 0.0])) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, key double")
    order = sorted((-k, 0) for _, k in rows if k is not None)
    for k in (0, 1, 37, 200, 333, 500):
        got = top_rows(df, "key", "doc_id", k, bins=7).filter("selected").collect()
        assert len(got) == min(k, len(order))
        assert sorted(-x.key for x in got) == [v for v, _ in order[:k]]


def test_edge_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (None, 1, 0), (4, None, 1), (5, 0, None)], "doc_id long, quality int, toxic int")
    rows = [(1, "good words here", "x"), (2, None, "x"), (3, "", "x"), (None, "good", None), (5, "### bad $$$ " * 50_000, "x"), (3, "", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, selected string")
    got = R.resample(df, labels).collect()
    assert len(got) == 6 and [r.log_weight for r in got if r.doc_id in (2, 3)] == [0.0] * 3
    assert R.select_documents(df, labels, keep=1.0).count() == 6 and R.select_documents(df, labels, keep=1.0).columns == df.columns
    assert R.select_documents(df, labels, keep=0.0).count() == 0
    assert R.select_documents(df, labels.limit(0)).count() == 6
    assert R.resample(df.limit(0), labels).count() == 0


def test_one_id_with_two_texts_is_two_documents(spark):
    good, bad = "plain clean words of a useful text " * 6, "zzzz qqqq xxxx #### " * 8
    rows = [(i, good) for i in range(20)] + [(100 + i, bad) for i in range(20)] + [(3, bad), (None, good), (None, bad)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(10)] + [(100 + i, 0) for i in range(10)], "doc_id long, quality int")
    kept = [tuple(r) for r in R.select_documents(df, labels, keep=22 / 43).collect()]
    assert (3, good) in kept and (3, bad) not in kept and (None, good) in kept and (None, bad) not in kept
