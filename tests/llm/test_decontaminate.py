"""Decontamination against brute force: every stretch of every text, plain edit distance."""

import random
import re

import numpy as np

from tickframe.llm import decontaminate as D
from tickframe.llm.common import read

SF = "/root/testdata/sf0.001"


def words(text):
    return [w for w in re.split(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").lower()) if w]


def least_edits(item, text):
    cost = [0] * (len(text) + 1)
    for w in item:
        now = [cost[0] + 1]
        for j, x in enumerate(text):
            now.append(min(cost[j] + (w != x), cost[j + 1] + 1, now[j] + 1))
        cost = now
    return min(cost)


def plain(docs, items, similarity=0.8, least=5):
    out = set()
    for d, t in docs:
        tw = words(t)
        for i, x in items:
            iw = words(x)
            e = int((1 - similarity) * len(iw) + 1e-9)
            if len(iw) >= least and set(tw) & set(iw) and least_edits(iw, tw) <= e:
                out.add((d, i, least_edits(iw, tw)))
    return out


def edited(r, w, e, vocabulary):
    w = list(w)
    for _ in range(e):
        k, p = r.randrange(3), r.randrange(len(w))
        if k == 0:
            w[p] = r.choice(vocabulary)
        elif k == 1:
            w.insert(p, r.choice(vocabulary))
        else:
            del w[p]
    return w


def test_whole_table_equals_brute_force(spark):
    docs, items = read(spark, SF, "documents"), read(spark, SF, "benchmark")
    got = {(r.doc_id, r.item_id, r.edits) for r in D.find_leaks(docs, items).collect()}
    assert got == plain([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.collect()])
    assert got
    kept = {r.doc_id for r in D.drop_leaks(docs, items).collect()}
    assert kept == {r.doc_id for r in docs.collect()} - {d for d, _, _ in got}


def test_recall_and_precision_on_edited_items(spark):
    r = random.Random(5)
    items = [(x.item_id, x.text) for x in read(spark, SF, "benchmark").collect()]
    vocabulary = sorted({w for _, t in items for w in words(t)})
    docs, want, far = [], 0, []
    for k in range(600):
        i, t = r.choice(items)
        w = words(t)
        e = r.randint(0, int(0.2 * len(w) + 1e-9))
        body = [r.choice(vocabulary) for _ in range(r.randint(0, 60))]
        docs.append((k, " ".join(body + edited(r, w, e, vocabulary) + body[::-1])))
    want = plain(docs, items)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {(x.doc_id, x.item_id, x.edits) for x in D.find_leaks(df, read(spark, SF, "benchmark")).collect()}
    assert {x[:2] for x in got} <= {x[:2] for x in want}
    assert len({x[:2] for x in got}) >= 0.95 * len(want), (len(got), len(want))


def test_blocks_give_the_same(spark):
    docs, items = read(spark, SF, "documents"), read(spark, SF, "benchmark")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(D.find_leaks(docs, items)) == rows(D.find_leaks(docs, items, block_words=500))
    assert rows(D.drop_leaks(docs, items)) == rows(D.drop_leaks(docs, items, block_words=500))


def test_edge_rows(spark):
    item = "one two three four five six seven eight nine ten"
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "the"), (5, item), (None, item)], "item_id long, text string")
    rows = [(1, None, 1), (2, "", 1), (3, "x " * 300_000 + item.upper().replace(" ", ", ") + " y" * 300_000, 1), (3, item, 2), (None, item, 3),
            (5, "one two three four five six seven eight", 4), (6, "ten nine eight seven six five four three two one", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, edits int")
    got = sorted(((r.doc_id, r.item_id, r.edits) for r in D.find_leaks(df, items).collect()), key=str)
    assert got == sorted([(3, 1, 0), (3, 5, 0), (3, 1, 0), (3, 5, 0), (None, 1, 0), (None, 5, 0), (5, 1, 2), (5, 5, 2)], key=str)
    kept = D.drop_leaks(df, items)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 6]
    assert D.find_leaks(df.limit(0), items).count() == 0
    assert D.find_leaks(df, items.limit(0)).count() == 0 and D.drop_leaks(df, items.limit(0)).count() == 7


def test_unspaced_scripts_and_short_items(spark):
    han = "一家商店以每公斤八元的价格卖出苹果，上午卖了十二公斤，下午卖了九公斤；一共收入多少元？"
    thai = "ร้านค้าขายแอปเปิลกิโลกรัมละแปดบาทตอนเช้าขายได้สิบสองกิโลกรัม"
    items = spark.createDataFrame([(1, han), (2, thai), (3, "Quokka naps twice"), (4, "？！")], "item_id long, text string")
    near = han.replace("苹果", "香梨").replace("，", ",")
    docs = [(1, "前言。" + han + "结束。"), (2, "前言" + near + "结束"), (3, "ก" * 40 + thai + "ข"), (4, "a “quokka” naps\u2003twice—daily"),
            (5, "a quokka naps once"), (6, han[:20] + "？！")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.edits) for r in D.find_leaks(df, items).collect())
    assert got == [(1, 1, 0), (2, 1, 2), (3, 2, 0), (4, 3, 0)]
    assert sorted(r.doc_id for r in D.drop_leaks(df, items).collect()) == [5, 6]


def test_lsh_alone_selects(spark):
    """Recall of the bit sampling alone at the most edits allowed, and how few unrelated windows it lets through."""
    r = random.Random(9)
    vocabulary = [f"w{i}" for i in range(3000)]
    for n in (8, 20, 40, 60):
        items = [" ".join(r.choice(vocabulary) for _ in range(n)) for _ in range(40)]
        index = D.Index(list(enumerate(items)), *D.OPTIONS.values())
        near = [edited(r, t.split(), int(0.2 * n + 1e-9), vocabulary) for t in items]
        found, wrong, pairs = 0, 0, 0
        for i, w in enumerate(near):
            symbols = np.concatenate([index.symbols(" ".join(w)), np.zeros(2 * n, np.int64)])
            starts = np.arange(-2, 3)
            _, item = index.candidates(symbols, starts, np.full(len(starts), n))
            found += i in item
            other = index.symbols(" ".join(r.choice(vocabulary) for _ in range(n)))  # words of the items, in no order of theirs
            _, item = index.candidates(other, np.zeros(1, np.int64), np.array([n]))
            wrong, pairs = wrong + len(item), pairs + len(items)
        assert found >= 0.9 * len(items), (n, found)
        assert wrong <= 0.02 * pairs, (n, wrong, pairs)


def test_items_without_id_are_dropped_too(spark):
    item = "one two three four five six seven eight nine ten"
    items = spark.createDataFrame([(None, item), (None, None)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "so " + item), (2, "other"), (None, item), (1, "other")], "doc_id long, text string")
    assert sorted(map(tuple, D.drop_leaks(docs, items).collect())) == [(1, "other"), (2, "other")]
    assert D.find_leaks(docs, items).count() == 0
