"""Toxicity: the contract's columns, held-out accuracy, shared n-grams of misspellings."""

from zlib import crc32

import numpy as np
from pyspark.sql import functions as F

from tickframe.llm import toxicity as T
from tickframe.llm.common import read

SF = "/root/testdata/sf0.1"


def test_bag_adds_up():
    at, share = T.bag("The the idiot, IDIOT\nx", 1 << 20, 3, 6)
    want = [g for w, n in ((b"the", 2), (b"idiot", 2), (b"x", 1)) for g in T.subwords(w, 1 << 20, 3, 6) * n]
    assert sorted(set(want)) == at.tolist() and abs(share.sum() - 1) < 1e-9
    assert abs(share[at.tolist().index(T.subwords(b"idiot", 1 << 20, 3, 6)[0])] - 2 / len(want)) < 1e-9
    assert len(T.subwords(b"ab", 10**6, 3, 6)) == 3 and T.bag(None, 10, 3, 6)[0].size == 0


def test_scores_equal_plain_and_held_out_accuracy(spark):
    docs, labels = read(spark, SF, "documents"), read(spark, SF, "labels")
    model = T.train(docs, labels.filter(~T.held_out()))
    some = docs.filter("doc_id < 60")
    plain = {}
    for r in some.collect():
        at, share = T.bag(r.text, len(model[0]), 3, 6)
        plain[r.doc_id] = 1 / (1 + np.exp(-(model[1] + share @ model[0][at])))
    assert all(abs(r.score - plain[r.doc_id]) < 1e-3 for r in T.scores(some, model).collect())

    held = labels.filter(T.held_out())
    rows = T.scores(docs, model).join(held, "doc_id").collect()
    assert all(crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows)
    toxic = [r.score >= 0.3 for r in rows if r.toxic]
    clean = [r.score >= 0.3 for r in rows if not r.toxic]
    assert np.mean(toxic) >= 0.9 and np.mean(clean) <= 0.05, (np.mean(toxic), np.mean(clean))

    of = T._WordSums(model[0], 3, 6)
    mean = lambda w: of[w].real / of[w].imag
    for w in (b"idiots", b"disgustng", b"stuppid", b"patheticc", b"worthles"):  # not in any training text
        assert mean(w) > 10 * max(mean(b"the"), mean(b"with"), 0.1), w


def test_labels_of_the_held_out_fold_do_not_matter(spark):
    docs, labels = read(spark, "/root/testdata/sf0.01", "documents"), read(spark, "/root/testdata/sf0.01", "labels")
    turned = labels.withColumn("toxic", F.when(T.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a = {r.doc_id: r for r in T.toxicity(docs, labels).collect()}
    b = {r.doc_id: r for r in T.toxicity(docs, turned).collect()}
    assert a == b and len(a) == docs.count()
    assert all(r.held_out == (crc32(str(d).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for d, r in a.items())


def test_edge_rows(spark):
    rows = [(1, "bad words", "x"), (2, None, "x"), (3, "", "x"), (None, "bad", None), (4, "good words " * 100_000, "x"), (4, "good", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (3, 0), (4, 0), (None, 1), (7, None)], "doc_id long, toxic int")
    for used in (labels, labels.filter("toxic = 0"), labels.limit(0)):
        got = T.toxicity(df, used).collect()
        assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert T.toxicity(df.limit(0), labels).count() == 0
