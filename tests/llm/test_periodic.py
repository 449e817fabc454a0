"""Periodic runs against a plain search over all periods."""

import hashlib
import random
from binascii import crc32

import numpy as np
import pytest

from tickframe.llm import periodic
from tickframe.llm.common import read

SF = "/root/testdata/sf0.001"


def plain_runs(words, min_length=12):
    """Every period by itself; of equal stretches only the smallest period counts."""
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    a = np.array([number[w] for w in words], np.int64)
    out = {}
    for q in range(1, len(a) // 2 + 1):
        edge = np.flatnonzero(np.diff(np.concatenate(([0], (a[:-q] == a[q:]).astype(int), [0]))))
        for s, e in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if e - s >= max(min_length - q, q):
                out.setdefault((s, e + q - s), q)
    return sorted(((s, m, q) for (s, m), q in out.items()), key=lambda r: (r[0], r[2]))


def tiled_runs(words, min_length=12):
    """Tiles and stitching without Spark."""
    _, tiles = periodic.tiles(" ".join(words).encode(), min_length)
    pieces = sorted({(q, at + s, at + e) for p, at, part, b in tiles for q, s, e in periodic.solve(p, part, b)})
    runs = []
    for q, s, e in pieces:
        if runs and runs[-1][0] == q and s <= runs[-1][2] - q:
            runs[-1][2] = max(e, runs[-1][2])
        else:
            runs.append([q, s, e])
    return sorted(((s, e - s, q) for q, s, e in runs if e - s >= max(min_length, 2 * q)), key=lambda r: (r[0], r[2]))


def made(r):
    """Words with runs within runs, broken runs and cut ends."""
    words = []
    for _ in range(r.randint(1, 5)):
        base = [r.choice("abcdefgh"[:r.randint(1, 8)]) for _ in range(r.randint(1, 40))]
        if r.random() < 0.4:
            base = base[:r.randint(1, 5)] * r.randint(1, 8) + base
        part = base * r.randint(1, 6)
        if r.random() < 0.5:
            part = part[:r.randint(1, len(part))]
        if r.random() < 0.3:
            part[r.randrange(len(part))] = "X"
        words += part
    return words


@pytest.mark.parametrize("min_length", [12, 2, 5, 30])
def test_tiles_find_all_runs(min_length):
    r = random.Random(min_length)
    for _ in range(250):
        words = made(r)
        assert tiled_runs(words, min_length) == plain_runs(words, min_length), words


def test_long_periods_and_random_text():
    r = random.Random(1)
    base = [str(r.randrange(10 ** 6)) for _ in range(700)]
    words = base[:30] + base * 3 + base[:333] + [str(r.randrange(50)) for _ in range(500)]
    assert tiled_runs(words) == plain_runs(words)
    words = [r.choice("ab") for _ in range(800)]
    assert tiled_runs(words) == plain_runs(words)


def test_tiles_are_spared():
    r = random.Random(2)
    few = " ".join(str(r.randrange(40)) for _ in range(20_000)).encode()
    assert sum(len(part) for _, _, part, _ in periodic.tiles(few)[1]) < 200_000
    one = b"a " * 50_000  # a single run: only the octaves' edges are looked at
    assert sum(len(b) for *_, b in periodic.tiles(one)[1]) < 60_000


def test_window_hashes():
    x = np.array([hash(str(i % 7)) & (2 ** 63 - 1) for i in range(60)], np.uint64)
    for k in range(1, 20):
        h = periodic.window_hashes(x, k)
        assert len(h) == 61 - k
        assert all((h[i] == h[j]) == ((x[i:i + k] == x[j:j + k]).all()) for i in range(len(h)) for j in range(0, len(h), 5))


def test_z_function():
    r = random.Random(3)
    for _ in range(200):
        s = [r.randrange(2) for _ in range(r.randint(0, 30))]
        z = periodic.z_function(s, len(s))
        for i in range(1, len(s)):
            k = 0
            while i + k < len(s) and s[k] == s[i + k]:
                k += 1
            assert z[i] == k


def expected(doc_id, text):
    words = (text or "").encode().split()
    if doc_id is not None:
        h = crc32(str(doc_id).encode())
        if h % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    return (doc_id, len(runs), *best, best[1] * 1000 // best[2] if runs else None,
            hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest())


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_query_against_plain_version(spark):
    docs = read(spark, SF, "documents")
    short = [r for r in docs.select("doc_id", "text").collect() if len(r.text or "") < 6000]
    want = sorted((expected(*r) for r in short), key=repr)
    assert any(w[1] for w in want) and len(want) > 100
    ids = [r.doc_id for r in short]
    assert rows(periodic.runs_digest(docs.filter(docs.doc_id.isin(ids)))) == want


def test_edge_rows(spark):
    line = "alpha beta\x1cgamma delta "  # 1C is no separator here
    given = [(None, line * 9), (3, None), (4, ""), (5, " \n\t"), (7, "x " * 12), (7, "x " * 11), (7, "x " * 12), (8, "é b " * 30),
             (9, "\n".join(f"w{i % 97}" for i in range(40_000)))]
    df = spark.createDataFrame([(d, t, 1, "k") for d, t in given], "doc_id long, text string, start long, key string")
    got = rows(periodic.runs_digest(df))
    assert [g for g in got if g[0] != 9] == sorted((expected(*g) for g in given[:-1]), key=repr)
    nine = next(g for g in got if g[0] == 9)
    assert nine[1:6] == (1, 0, 40_000, 97, 412371)
    empty = periodic.runs_digest(df.limit(0))
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_general_form(spark):
    df = spark.createDataFrame([(1, "a b a b a b c"), (2, "a b c")], "doc_id long, text string")
    got = {r.doc_id: r for r in periodic.periodic_runs(df, min_length=4).collect()}
    assert [tuple(x) for x in got[1].runs] == [(0, 6, 2)] and got[1].text == "a b c"
    assert got[2].runs == [] and got[2].text == "a b c"
