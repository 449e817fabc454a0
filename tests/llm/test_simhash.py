"""SimHash near-dedup against brute force: all pairs of fingerprints, plain union-find."""

import random
import re

import pytest
import xxhash

from tickframe.llm import components, simhash
from tickframe.llm.common import read

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    sh = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows, t=2):
    """rows: (doc_id, fp); doc_id -> least doc_id of its component."""
    fps = sorted({f for _, f in rows})
    up = {f: f for f in fps}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for i, a in enumerate(fps):
        for b in fps[i + 1:]:
            if bin(a ^ b).count("1") <= t:
                up[find(b)] = find(a)
    least = {}
    for d, f in rows:
        if d is not None:
            least[find(f)] = min(d, least.get(find(f), d))
    return sorted(((d, f, least.get(find(f))) for d, f in rows), key=str)


def unsigned(x):
    return x & (1 << 64) - 1


def test_fingerprint_equals_plain():
    texts = [None, "", " \t\n", "One", "one two", "A b C d e f G", "É ß\x0bx\x0cy é", "\xa0nb sp\x1c ok ok ok", "w " * 5000]
    assert [simhash.text_fingerprint(t) for t in texts] == [plain_fingerprint(t) for t in texts]


def test_pieces_do_not_matter():
    for text in (" ".join(f"w{i % 97}" for i in range(500)), "a b", "a  b\tc d", " x" * 40):
        assert {simhash.text_fingerprint(text, 3, k) for k in (1, 2, 7, 50, 1 << 20)} == {plain_fingerprint(text)}


def test_every_close_pair_shares_an_anchor(spark):
    r = random.Random(1)
    pairs = []
    for _ in range(300):
        x = r.getrandbits(64)
        y = x
        for b in r.sample(range(64), r.randint(0, 2)):
            y ^= 1 << b
        pairs.append((x - (1 << 64) if x >> 63 else x, y - (1 << 64) if y >> 63 else y))
    df = spark.createDataFrame(pairs, "x long, y long")
    got = df.select(simhash.anchors(df.x, 2).alias("p"), simhash.anchors(df.y, 2).alias("q")).collect()
    assert all(set(a.p) & set(a.q) for a in got)
    assert all(len(set(a.p)) in (1, 32) for a in got)


@pytest.mark.parametrize("t", [0, 1, 2, 3])
def test_components_of_planted_fingerprints(spark, t):
    r = random.Random(t)
    fps = []
    for _ in range(12):  # chains: each member a few bits from the one before
        x = r.getrandbits(64)
        for _ in range(r.randint(1, 25)):
            fps.append(x)
            for b in r.sample(range(64), r.randint(0, 3)):
                x ^= 1 << b
    rows = [(i, f) for i, f in enumerate(fps)]
    df = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in rows], "first long, fp long")
    cc = {n: root for n, root in components.components(simhash.links(df.select("fp").distinct(), t)).collect()}
    of = [cc.get(x, x) for x in [f - (1 << 64) if f >> 63 else f for f in fps]]
    want = {d: c for d, _, c in plain_components(rows, t)}
    assert len(set(of)) == len(set(want.values()))
    assert all((of[i] == of[j]) == (want[i] == want[j]) for i in range(len(of)) for j in range(i))


def test_query_equals_brute_force(spark):
    got = simhash.near_duplicates(read(spark, SF, "documents")).collect()
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in read(spark, SF, "documents").select("doc_id", "text").collect()]
    assert sorted(((r.doc_id, unsigned(r.fp), r.component_id) for r in got), key=str) == plain_components(rows)


def test_edge_rows(spark):
    rows = [(5, None, "x"), (3, "", "x"), (None, "", "x"), (9, "Same text here again", "x"), (2, "same TEXT here\tagain", "x"),
            (2, "same TEXT here\tagain", "x"), (None, "only without id", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")  # fp clashes with an inner name
    got = simhash.simhash_digest(df).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.component_id) for r in got}
    assert by == {(5, 3), (3, 3), (None, 3), (9, 2), (2, 2), (None, None)}
    assert {r.fingerprint for r in got if r.component_id == 3} == {"0" * 16}
    kept = simhash.keep_one_per_group(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [2, 3]
    assert simhash.simhash_digest(df.limit(0)).count() == 0


def test_one_id_with_two_texts_and_rows_without_id(spark):
    a, b = "alpha beta gamma delta epsilon zeta eta theta", "quite another text about something else entirely here"
    df = spark.createDataFrame([(1, a), (1, b), (2, a), (2, a), (None, b), (None, "a third one of no id at all but many words"), (None, None)], "doc_id long, text string")
    kept = sorted(map(tuple, simhash.keep_one_per_group(df).collect()), key=str)
    assert kept == sorted([(1, a), (1, b), (None, "a third one of no id at all but many words"), (None, None)], key=str)
