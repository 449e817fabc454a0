"""Language ID against a plain version, and its parts on small inputs."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from html.parser import HTMLParser

from tickframe.llm import langid as L
from tickframe.llm.common import read

SF = "/root/testdata/sf0.001"


class FirstTag(HTMLParser):
    """The language of the first <html> tag, by the standard library's parser."""

    lang = None

    def handle_starttag(self, tag, attrs):
        if tag == "html" and self.lang is None:
            m = re.match(r"\s*([A-Za-z]{2,3})(?![A-Za-z0-9])", next((v or "" for k, v in attrs if k == "lang"), ""))
            self.lang = m[1].lower() if m else None


def first_tag(page):
    p = FirstTag()
    p.feed(page or "")
    return p.lang or ""


def registered(host):
    labels = host.split(".")
    n = 3 if len(labels) > 1 and len(labels[-1]) == 2 and labels[-2] in L.SECOND_LABELS else 2
    return ".".join(labels[-n:]) if len(labels) > n else host


def plain(pages, docs, buckets=1 << 14, a=0.5, strength=5.0):
    count = defaultdict(Counter)
    for lang, text in docs:
        if lang and text:
            count[lang].update(int(x) for g in L.trigrams(text, buckets) for x in g)
    langs = sorted(count)
    n = len(langs)
    logp = [{b: math.log((count[k][b] + a) / (sum(count[k].values()) + a * buckets)) for b in range(buckets)} for k in langs]
    soft = lambda x: [math.exp(v - max(x)) / sum(math.exp(w - max(x)) for w in x) for v in x]
    rows = []
    for page_id, url, page in pages:
        grams = [int(x) for g in L.trigrams(L.visible_text(page), buckets) for x in g]
        ll = [sum(m[b] for b in grams) / 3 for m in logp]
        m = re.match(r"[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:\s]+)", (url or "").lower())
        host = m[1].rstrip(".") if m else ""
        labels = host.split(".")
        rows.append((page_id, host, registered(host), labels[-1], first_tag(page), ll, soft(ll)))
    said = lambda d: d if d in langs or not d else "?"
    sums = [defaultdict(lambda: [0.0] * n) for _ in range(4)]
    total = [0.0] * n
    for _, host, domain, suffix, d, _, p in rows:
        for t, k in zip(sums, (host, domain, suffix, said(d))):
            t[k] = [x + y for x, y in zip(t[k], p)]
        total = [x + y for x, y in zip(total, p)]
    top = [(t + 1) / (sum(total) + n) for t in total]
    out = {}
    for page_id, host, domain, suffix, d, ll, p in rows:
        f = []
        for i in range(n):
            at_domain = (max(0, sums[1][domain][i] - p[i]) + strength * top[i]) / (sum(sums[1][domain]) - 1 + strength)
            prior = (max(0, sums[0][host][i] - p[i]) + strength * at_domain) / (sum(sums[0][host]) - 1 + strength)
            f.append(ll[i] + math.log((sums[3][said(d)][i] + a) / (total[i] + a * (n + 2)))
                     + math.log((sums[2][suffix][i] + a) / (total[i] + a * len(sums[2]))) + math.log(prior))
        out[page_id] = (host, d, langs[int(np.argmax(ll))], langs[int(np.argmax(f))], max(soft(f)))
    return out


def test_query_equals_plain(spark):
    pages, docs = read(spark, SF, "pages"), read(spark, SF, "documents")
    want = plain([tuple(r) for r in pages.select("page_id", "url", "html").collect()], [tuple(r) for r in docs.select("lang", "text").collect()])
    got = L.page_languages(pages, docs).collect()
    assert len(got) == pages.count()
    for r in got:
        w = want[r.page_id]
        assert (r.host, r.declared, r.text_lang, r.lang) == w[:4], (r, w)
        assert abs(r.probability - w[4]) < 1e-6


def test_text_alone_finds_the_language(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    as_pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("http://a.b.c/").alias("url"), F.concat(F.lit("<p>"), "text").alias("html"))
    got = L.page_languages(as_pages, docs).join(docs.filter("n_chars > 300").withColumnRenamed("lang", "want"), F.expr("page_id = doc_id"))
    assert got.agg(F.avg((F.col("text_lang") == F.col("want")).cast("int"))).first()[0] > 0.97


def test_markup_and_host_decide_where_the_text_does_not(spark):
    docs = spark.createDataFrame([("en", "the cat and the dog " * 9), ("de", "der hund und die katze " * 9)], "lang string, text string")
    pages = [(i, "http://x.one.de/a", '<html lang="de"><p>der hund und die katze</p>') for i in range(20)]
    pages += [(100 + i, "http://y.two.com/a", '<html lang="en"><p>the dog and the cat</p>') for i in range(20)]
    pages += [(200, "http://x.one.de/b", "<html><p>42"), (201, "http://y.two.com/b", "<html><p>42"), (202, "http://z.com/", '<html lang="de">')]
    got = {r.page_id: r.lang for r in L.page_languages(spark.createDataFrame(pages, "page_id long, url string, html string"), docs).collect()}
    assert [got[k] for k in (0, 100, 200, 201, 202)] == ["de", "en", "de", "en", "de"]


def test_visible_text():
    page = '<html LANG=fr><title>x</title><script>var t="</p>";if(a<b){}</script><nav><a>menu</a></nav><!-- <p>no --><p>Caf&eacute; &amp; <b>co</b></p><style>p{}</style> end'
    assert L.visible_text(page).split() == ["Café", "&", "co", "end"] and L.declared(page) == "fr"
    assert L.visible_text(None) == "" and L.declared(None) == "" and L.declared('<html lang="x">') == ""
    assert len(L.visible_text("<" * 300_000)) == 300_000 and L.visible_text("<script " * 100_000) is not None


def test_edge_rows(spark):
    docs = spark.createDataFrame([("en", "some text"), (None, "x"), ("de", None), ("fr", "du texte")], "lang string, text string")
    rows = [(1, None, None, 1), (2, "not a url", "", 1), (2, "not a url", "", 1), (None, "HTTP://User@Host.Example.ORG.:80/x", "<p>some text", 1),
            (4, "http://h", "<p>" + "du texte " * 100_000, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, lang int")
    got = L.page_languages(pages, docs).collect()
    assert len(got) == 5 and {r.host for r in got} == {"", "host.example.org", "h"}
    assert {r.lang for r in got if r.page_id == 4} == {"fr"} and all(0 < r.probability <= 1 for r in got)
    assert L.page_languages(pages.limit(0), docs).count() == 0
    none = L.page_languages(pages, docs.limit(0))
    assert none.columns == L.page_languages(pages, docs).columns and none.filter("lang IS NULL").count() == 5


def test_a_small_language_stays(spark, monkeypatch):
    docs = [("en", "the cat and the dog of a house " * 2000), ("de", "der hund und die katze " * 2000), ("xx", "zyqo wuxi kezo")]
    pages = [(i, f"http://a{i % 3}.site.com/", '<html lang="en"><p>the dog and a cat of the house') for i in range(20)]
    pages += [(100, "http://q.zz/", '<html lang="xx"><p>zyqo wuxi kezo zyqo wuxi'), (101, "http://q.zz/1", "<p>kezo kezo wuxi"), (102, None, None)]
    size = {k: sum(len(g) for g in L.trigrams(t, 1 << 14)) for k, t in docs}
    assert size["xx"] * 1000 < sum(size.values())
    want = plain([(i, u, p) for i, u, p in pages], docs)
    args = spark.createDataFrame(pages, "page_id long, url string, html string"), spark.createDataFrame(docs, "lang string, text string")
    for block, held in ((256, 1 << 20), (1, 4)):
        monkeypatch.setattr(L, "BLOCK", block)
        monkeypatch.setattr(L, "HELD", held)
        got = {r.page_id: tuple(r)[1:] for r in L.page_languages(*args).collect()}
        assert got.keys() == want.keys() and got[100][3] == got[101][3] == "xx"
        for k, r in got.items():
            assert r[:4] == want[k][:4] and abs(r[4] - want[k][4]) < 1e-6, (k, r, want[k])


def test_a_late_tag_is_declared():
    for before in ("<!-- " + "x " * 600_000 + "-->", "<script>" + "if(a<b){}" * 200_000 + "</script>", " " * 1_200_000):
        assert L.declared(before + '<HTML class=a lang="de-AT">') == "de"
    for odd in ("<html " * 300_000, "<html lang" + " " * 1_200_000, "<html" + " lang" * 300_000, "<html lang=" + " " * 1_200_000 + "x"):
        assert L.declared(odd) == "" and L.declared(odd + '><html lang="fr">') == "fr"


def test_a_tags_own_attribute_counts():
    for page, want in [('<html lang="en" xml:lang="de">', "en"), ('<html lang="en" data-lang="fr">', "en"), ('<html xml:lang="de">', ""),
                       ('<!-- <html lang="de"> --><html class="a>b" lang=fr>', "fr"), ("<HTML\nLANG = 'es-MX'>", "es"), ('<!doctype html><html><html lang="en">', "en"),
                       ('<html lang="">', ""), ('<html lang=x>', ""), ('<html data-x=\'lang="de"\' lang="en">', "en"), ("<htmlx lang=de>", ""),
                       ("<!-- <html lang=de>", ""), ("", ""), ('<html lang="en" lang="de">', "en"), ('<html lang="deutsch">', "")]:
        assert L.declared(page) == want, page
    assert L.declared("<!-- " + "x" * 2_000_000 + ' --><html lang="de">') == "de" and L.declared("<html " + "a=b " * 300_000 + "lang=de>") == "de"


def test_registered_domains(spark):
    hosts = ["a.b.example.com", "www.shop.co.uk", "shop.co.uk", "co.uk", "x.y.com.br", "uk", "", "a.co.com"]
    df = spark.createDataFrame([(h,) for h in hosts], "h string").select("h", L._domain_of(F.col("h")).alias("d"))
    assert {r.h: r.d for r in df.collect()} == {"a.b.example.com": "example.com", "www.shop.co.uk": "shop.co.uk", "shop.co.uk": "shop.co.uk", "co.uk": "co.uk",
                                              "x.y.com.br": "y.com.br", "uk": "uk", "": "", "a.co.com": "co.com"}
