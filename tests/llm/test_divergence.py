"""Quality rules against a plain version of every column, and the method's verdict on labelled rows."""

import math
import re
from collections import Counter

from tickframe.llm import divergence as D
from tickframe.llm.common import read

SF = "/root/testdata/sf0.01"


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), n < 50 or 100 * len(inside) > 50 * n)


def plain_references(rows, common=50):
    out = {}
    texts = [(k or "", t) for _, t, k in rows if len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) >= 50]
    total = sum(len(re.findall(r"[^\x20\x09-\x0D]+", t)) for _, t in texts)
    for lang in {k for k, _ in texts} | {""}:
        mine = [t for k, t in texts if lang in ("", k)]
        count = Counter(w for t in mine for w in re.findall(r"[^\x20\x09-\x0D]+", t))
        if lang and sum(count.values()) * 1000 < total:
            continue
        top = sorted(count.items(), key=lambda x: (-x[1], x[0].encode()))[:common]
        n = sum(count.values())
        classes = []
        for k in range(len(D.CLASSES)):
            steps = sorted(round(D.STEPS * sum(D._class_of(c) == k for c in t) / len(t)) for t in mine)
            classes.append(steps[(len(steps) - 1) // 2] / D.STEPS)
        out[lang] = ([w for w, _ in top], [c / n for _, c in top] + [1 - sum(c for _, c in top) / n], [c / sum(classes) for c in classes])
    return out


def js(p, q):
    kl = lambda a, b: sum(x * math.log2(x / ((x + y) / 2)) for x, y in zip(a, b) if x > 0)
    return math.sqrt(max(0, (kl(p, q) + kl(q, p)) / 2))


def check(rows, got):
    refs = plain_references(rows)
    for (d, t, k), r in zip(rows, got):
        assert tuple(r[1:7]) == base(t), (d, r)
        n, text = r.n_words, t or ""
        words, shares, classes = refs.get(k or "", refs[""])
        kept = not r.base_failed
        if len(text) >= 200:
            want = js([sum(D._class_of(c) == i for c in text) / len(text) for i in range(len(D.CLASSES))], classes)
            assert abs(want - r.js_chars) < 2e-3, (d, want, r)
            kept = kept and r.js_chars <= 0.30
        if n >= 50:
            count = Counter(re.findall(r"[^\x20\x09-\x0D]+", text))
            bins = [count[w] / n for w in words]
            want = js([*bins, 1 - sum(bins)], shares)
            assert abs(want - r.js_words) < 1e-6, (d, want, r)
            kept = kept and r.js_words <= 0.26 + 1.3 / math.sqrt(n)
        assert kept == r.kept


def test_query_equals_plain(spark):
    docs = read(spark, "/root/testdata/sf0.001", "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang").orderBy("doc_id").collect()]
    check(rows, D.quality_rules(docs).orderBy("doc_id").collect())


def test_flushing_early_changes_nothing(spark, monkeypatch):
    docs = read(spark, "/root/testdata/sf0.001", "documents").coalesce(1)
    whole = D.references(docs)
    monkeypatch.setattr(D, "HELD", 100)
    parts = D.references(docs)
    assert whole.keys() == parts.keys() and all((whole[k]["shares"] == parts[k]["shares"]).all() for k in whole)


def test_clean_rows_stay_and_junk_goes(spark):
    out = D.quality_rules(read(spark, SF, "documents")).join(read(spark, SF, "labels"), "doc_id").filter("n_words >= 50")
    share = {r.quality: r.kept for r in out.groupBy("quality").agg({"kept": "count"}).withColumnRenamed("count(kept)", "n")
             .join(out.filter("kept").groupBy("quality").count(), "quality").selectExpr("quality", "count / n AS kept").collect()}
    assert share[1] >= 0.99 and share.get(0, 0) <= 0.2, share


def test_edge_rows(spark):
    rows = [(1, None, "en"), (2, "", None), (None, "a b a b a b a\na b a b a b a\n\n \n", "xx"), (4, "\x1c\xa0word " * 60, "en"),
            (4, "\x1c\xa0word " * 60, "en"), (5, "x y z\n" * 200_000, None), (6, "Ünïcode 日本 words # * < > | " * 20, "ja")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumnRenamed("none", "kept")
    got = D.quality_rules(df.selectExpr("*", "doc_id AS kept", "lang AS n_words")).collect()
    by = sorted(((r.doc_id or 0, *r[1:7]) for r in got))
    assert by == sorted((d or 0, *base(t)) for d, t, _ in rows)
    assert D.quality_rules(df.limit(0)).count() == 0


def test_a_small_language_has_its_own_reference(spark, monkeypatch):
    big = [(i, "the cat and the dog of a house in " * 120, "en") for i in range(200)]
    small = [(1000 + i, " ".join(f"mot{(i + k) % 20}" for k in range(60)), "xx") for i in range(3)]
    df = spark.createDataFrame(big + small + [(2000, "mot1 " * 60, None)], "doc_id long, text string, lang string")
    refs = D.references(df)
    assert 180 * 1000 < sum(len(t.split()) for _, t, _ in big) and refs.keys() == {"", "en", "xx"}
    assert {w.decode() for w in refs["xx"]["words"]} == {f"mot{k}" for k in range(20)}
    want = sorted(tuple(r) for r in D.quality_rules(df).filter("doc_id >= 1000").collect())
    assert [r[8] < 0.05 for r in want] == [True] * 3 + [False]
    monkeypatch.setattr(D, "BLOCK", 1)
    assert sorted(tuple(r) for r in D.quality_rules(df).filter("doc_id >= 1000").collect()) == want
    assert D.quality_rules(df).count() == 204
