"""Language ID of web pages by Bayesian evidence fusion.

The posterior of a page's language multiplies, in logarithms:

* text: a naive Bayes likelihood of the visible text's byte trigrams, hashed in ``buckets``, fitted
  to the labelled documents (all of them). Overlapping trigrams repeat themselves, so their sum
  counts ``text_weight`` (1/3);
* markup: the probability that a page of the language declares what this one does in ``<html lang>``;
* address suffix: the probability that a page of the language has this last label of the host;
* prior: the host's share of languages, smoothed towards its registered domain's, that towards all
  pages'. Each level adds ``strength`` pages of the level above. A page's own text does not count in
  its own prior.

The tables of markup, suffix, host and domain come from the pages themselves: sums of the text-only
posteriors, by grouped aggregation over all pages. Nothing of them goes through the driver but the
table of markup (at most languages + 2 rows) and the totals by language. Hosts that hold very many pages are summed where the rows lie, and joined with a
join that Spark splits.

Languages are all of the labelled documents'. The model of the text is shipped in blocks of ``BLOCK``
languages, each held against all pages (with their html written once more for each further block);
the posterior is taken over all languages afterwards. Sums by key hold the languages that are not 0.
Null or empty html has no text and declares nothing; a null or odd address has host, domain and suffix
"". Repeated pages are judged each. Without any labelled document there is no language to choose: the
language is null and the probability 0. An empty table gives an empty result.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import byte_pieces, small_batches, staged

OPTIONS = {"buckets": 1 << 14, "smoothing": 0.5, "text_weight": 1 / 3, "strength": 5.0}
TAG = re.compile(r"<([^<>]*)>")
NAME = re.compile(r"\s*(/?)([a-zA-Z][a-zA-Z0-9]*)")
OPENING = re.compile(r"<!--|<html(?=[\s/>])", re.I)
ATTRIBUTE = re.compile(r"""[\s/]*+([^\s=>/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
LANGUAGE = re.compile(r"\s*([A-Za-z]{2,3})(?![A-Za-z0-9])")
# Fixed value: second labels under which countries register names.
SECOND_LABELS = ["ac", "co", "com", "edu", "go", "gob", "gov", "gouv", "ltd", "ne", "net", "nom", "or", "org", "plc", "sch"]
HIDDEN = frozenset(["script", "style", "noscript", "template", "nav", "title"])
#: Languages whose models are shipped together, 128 KB each.
BLOCK = 256
#: Sums a task holds before it hands them on.
HELD = 1 << 20


def visible_text(page: str | None) -> str:
    """Text outside tags, comments and hidden elements, character references resolved; linear in the page."""
    page = page or ""
    parts, at = [], 0
    while (start := page.find("<!--", at)) >= 0 and (end := page.find("-->", start + 4)) >= 0:
        parts.append(page[at:start])
        at = end + 3
    pieces = TAG.split(" ".join([*parts, page[at:]]))
    out, hidden = [], ""
    for k, piece in enumerate(pieces):
        if k % 2 == 0:
            if not hidden:
                out.append(piece)
        elif m := NAME.match(piece):
            close, name = m[1], m[2].lower()
            if hidden:
                hidden = "" if close and name == hidden else hidden
            elif not close and name in HIDDEN and not piece.endswith("/"):
                hidden = name
    return html.unescape(" ".join(out))


def declared(page: str | None) -> str:
    """The language that the first <html> tag outside comments with a language in its own ``lang`` attribute
    (the first one, if it is repeated) gives; "" where there is none. Linear in the page.

    Later <html> tags count where earlier ones tell none, as browsers take their attributes over.
    """
    page, at = page or "", 0
    while m := OPENING.search(page, at):
        if m[0] == "<!--":
            end = page.find("-->", m.end())
            if end < 0:
                return ""
            at = end + 3
            continue
        at = m.end()
        while (a := ATTRIBUTE.match(page, at)) and a.end() > at:
            if a[1].lower() == "lang":
                if value := LANGUAGE.match(a[2] or a[3] or a[4] or ""):
                    return value[1].lower()
                break
            at = a.end()
    return ""


def trigrams(text: str, buckets: int) -> Iterator[np.ndarray]:
    """Buckets of the byte trigrams of the lower-cased text, white space as one space."""
    for piece in byte_pieces(text.lower().encode("utf-8", "replace")):
        a = np.frombuffer(b" " + b" ".join(piece.split()) + b" ", np.uint8).astype(np.uint32)
        code = a[:-2] << np.uint32(16) | a[1:-1] << np.uint32(8) | a[2:]
        yield ((code * np.uint32(2654435761)) >> np.uint32(32 - int(math.log2(buckets)))).astype(np.int64)


def trigram_counts(docs: DataFrame, buckets: int) -> DataFrame:
    """(lang, bucket, n) over the labelled documents."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}

        def out():
            rows = [(k, int(i), int(c[i])) for k, c in counts.items() for i in np.flatnonzero(c)]
            counts.clear()
            k, i, n = zip(*rows) if rows else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(k, pa.string()), pa.array(i, pa.int32()), pa.array(n, pa.int64())], ["lang", "bucket", "n"])

        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                if lang and text:
                    c = counts.setdefault(lang, np.zeros(buckets, np.int64))
                    for g in trigrams(text, buckets):
                        c += np.bincount(g, minlength=buckets)
                    if len(counts) > 200:
                        yield out()
        yield out()

    return staged(docs.select(F.col("lang").cast("string").alias("lang"), "text").mapInArrow(run, "lang string, bucket int, n long")
                  .groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "trigrams")


def text_model(named: DataFrame, langs: list[str], buckets: int, smoothing: float) -> np.ndarray:
    """The log probability (language, bucket) of the trigrams of ``langs``."""
    row = {k: i for i, k in enumerate(langs)}
    table = np.full((len(langs), buckets), smoothing)
    for r in named.filter(F.col("lang").isin(langs)).toLocalIterator():
        table[row[r.lang], r.bucket] += r.n
    return np.log(table / table.sum(axis=1, keepdims=True))


def text_evidence(pages: DataFrame, named: DataFrame, langs: list[str], buckets: int, smoothing: float, text_weight: float) -> DataFrame:
    """(page_id, url, declared, ll): ll holds the weighted log likelihood of the text by language."""
    small_batches(pages.sparkSession)
    kind = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), "html", F.expr("cast(array() AS array<double>)").alias("ll"))
    for k in range(0, len(langs), BLOCK):
        spread = pages.sparkSession.sparkContext.broadcast(text_model(named, langs[k:k + BLOCK], buckets, smoothing))
        last = k + BLOCK >= len(langs)

        def run(batches: Iterator[pa.RecordBatch], spread=spread, last=last) -> Iterator[pa.RecordBatch]:
            table = spread.value
            for b in batches:
                source = b.column("html").to_pylist()
                ll = []
                for s, before in zip(source, b.column("ll").to_pylist()):
                    times = sum((np.bincount(g, minlength=buckets) for g in trigrams(visible_text(s), buckets)), np.zeros(buckets, np.int64))
                    seen = np.flatnonzero(times)
                    ll.append(before + (table[:, seen] @ times[seen] * text_weight).tolist())
                yield pa.RecordBatch.from_arrays(
                    [b.column("page_id"), b.column("url"), pa.array(map(declared, source), pa.string()) if last else b.column("html"),
                     pa.array(ll, pa.list_(pa.float64()))], ["page_id", "url", "declared" if last else "html", "ll"])

        rows = rows.mapInArrow(run, f"page_id {kind}, url string, {'declared' if last else 'html'} string, ll array<double>")
        rows = rows if last else staged(rows, "page-blocks")
    return rows


def host_of(url: Column) -> Column:
    """The host in lower case without port and closing dot; "" where there is none."""
    host = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:\s]+)", 1)
    return F.rtrim(host, F.lit("."))


def _domain_of(host: Column) -> Column:
    """The registered domain: the last two labels, or three under a country's second label (co.uk, com.br)."""
    labels = F.split(host, r"\.")
    second = (F.length(F.element_at(labels, -1)) == 2) & F.when(F.size(labels) > 1, F.element_at(labels, -2)).isin(SECOND_LABELS)
    n = F.when(F.coalesce(second, F.lit(False)), 3).otherwise(2)
    return F.when(F.size(labels) > n, F.concat_ws(".", F.slice(labels, -n, n))).otherwise(host)


def _suffix_of(host: Column) -> Column:
    return F.element_at(F.split(host, r"\."), -1)


def _softmax(logs: np.ndarray) -> np.ndarray:
    e = np.exp(logs - logs.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _dense(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, n)


def _sparse(column: pa.Array, n: int) -> np.ndarray:
    """(row, language) of a column of lists of (i, v)."""
    out = np.zeros((len(column), n))
    i, v = column.flatten().flatten()
    owner = np.repeat(np.arange(len(column)), column.value_lengths().to_numpy(zero_copy_only=False))
    out[owner, i.to_numpy(zero_copy_only=False)] = v.to_numpy(zero_copy_only=False)
    return out


def posterior_sums(rows: DataFrame, levels: dict[str, str], n: int) -> DataFrame:
    """(level, key, i, v): sums of the text-only posteriors by the columns of ``levels``; summed where the rows lie first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], np.ndarray] = {}

        def out():
            seen = [(k, np.flatnonzero(v), v) for k, v in held.items()]
            arrays = [pa.array([k[0] for k, i, _ in seen for _ in i], pa.string()), pa.array([k[1] for k, i, _ in seen for _ in i], pa.string()),
                      pa.array(np.concatenate([i for _, i, _ in seen] or [np.empty(0)]).astype(np.int32)),
                      pa.array(np.concatenate([v[i] for _, i, v in seen] or [np.empty(0)]).astype(float))]
            held.clear()
            return pa.RecordBatch.from_arrays(arrays, ["level", "key", "i", "v"])

        for b in batches:
            p = _softmax(_dense(b.column("ll"), n)) if b.num_rows else ()
            keys = {level: b.column(c).to_pylist() for level, c in levels.items()}
            for level, names in keys.items():
                for k, x in zip(names, p):
                    if (level, k) in held:
                        held[level, k] += x
                    else:
                        held[level, k] = x.copy()
                        if len(held) * n > HELD:
                            yield out()
        yield out()

    return staged(rows.select(*levels.values(), "ll").mapInArrow(run, "level string, key string, i int, v double")
                  .groupBy("level", "key", "i").agg(F.sum("v").alias("v")), "posterior-sums")


def page_languages(pages: DataFrame, docs: DataFrame, **options) -> DataFrame:
    """(page_id, host, declared, text_lang, lang, probability) of every page."""
    o = {**OPTIONS, **options}
    named = trigram_counts(docs, o["buckets"])
    langs = sorted(r.lang for r in named.select("lang").distinct().collect())
    n, a, s = len(langs), o["smoothing"], o["strength"]
    if not langs:
        return pages.select("page_id", host_of(F.col("url").cast("string")).alias("host"), F.lit("").alias("declared"),
                            F.lit(None).cast("string").alias("text_lang"), F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("probability"))
    rows = text_evidence(pages, named, langs, o["buckets"], a, o["text_weight"]).withColumn("host", host_of(F.col("url")))
    rows = staged(rows.select(
        "page_id", "host", _domain_of(F.col("host")).alias("domain"), _suffix_of(F.col("host")).alias("suffix"), "declared",
        F.when(F.col("declared").isin(langs), F.col("declared")).otherwise(F.when(F.col("declared") == "", "").otherwise("?")).alias("said"),
        "ll"), "page-text")

    sums = posterior_sums(rows, {"h": "host", "d": "domain", "s": "suffix", "c": "said"}, n)
    kinds = sums.filter("level = 's'").select("key").distinct().count()
    said: dict[str, np.ndarray] = {}
    for batch in sums.filter("level = 'c'").select("key", "i", "v").toArrow().to_batches():  # at most languages + 2 keys
        for k, i, v in zip(*(c.to_pylist() for c in batch.columns)):
            said.setdefault(k, np.zeros(n))[i] = v
    total = sum(said.values(), np.zeros(n))
    likely = {k: np.log((v + a) / (total + a * (n + 2))) for k, v in said.items()}
    top = (total + 1.0) / (total.sum() + n)

    def shares(level: str, key: str) -> DataFrame:
        return (sums.filter(F.col("level") == level).groupBy(F.col("key").alias(key))
                .agg(F.collect_list(F.struct("i", "v")).alias(f"of_{key}")))

    hosts = shares("h", "host").withColumn("domain", _domain_of(F.col("host"))).withColumn("suffix", _suffix_of(F.col("host")))
    # written, so that the join below has two plain shuffles, of which Spark splits a hot host's
    hosts = staged(hosts.join(shares("d", "domain"), "domain").join(shares("s", "suffix"), "suffix").drop("domain", "suffix"), "hosts")
    spread = pages.sparkSession.sparkContext.broadcast((langs, total, top, likely))

    def fuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, total, top, likely = spread.value
        names = pa.array(langs, pa.string())
        for b in batches:
            if not b.num_rows:
                continue
            ll = _dense(b.column("ll"), n)
            own, h, d, x = _softmax(ll), *(_sparse(b.column(f"of_{k}"), n) for k in ("host", "domain", "suffix"))
            # sums less the page itself; a sum of shares may fall short of 0 by rounding
            less = lambda t: np.maximum(t.sum(axis=1, keepdims=True) - 1, 0.0) + s
            at_domain = (np.maximum(d - own, 0.0) + s * top) / less(d)
            prior = (np.maximum(h - own, 0.0) + s * at_domain) / less(h)
            logs = ll + np.stack([likely[k] for k in b.column("said").to_pylist()]) + np.log((x + a) / (total + a * kinds)) + np.log(prior)
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("host"), b.column("declared"), names.take(pa.array(ll.argmax(axis=1))),
                 names.take(pa.array(logs.argmax(axis=1))), pa.array(_softmax(logs).max(axis=1))],
                ["page_id", "host", "declared", "text_lang", "lang", "probability"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return (rows.join(hosts, "host").select("page_id", "host", "declared", "said", "ll", "of_host", "of_domain", "of_suffix")
            .mapInArrow(fuse, f"page_id {kind}, host string, declared string, text_lang string, lang string, probability double"))
