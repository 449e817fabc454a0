"""Quality rules by distribution divergence.

Each text's histogram of character classes and of its language's most common words is compared
with a reference of that language by the Jensen-Shannon distance (base 2, 0 to 1). A text is kept
if it passes the base rules (at least ``min_words`` words, at most half of them in repeated 3-word
windows) and neither distance exceeds its limit:

* characters: ``char_limit``, for texts of at least ``min_chars`` code points;
* common words: ``word_limit + word_spread / sqrt(words)``, for texts of at least ``min_words``
  words. A short text differs from any reference by chance, about as 1 / sqrt(words).

References come from all texts of at least ``min_words`` words. The words' histogram is the
language's total counts of its ``common`` most frequent words, with one bin for all others. The
classes' histogram holds the median share of each class over the texts (in steps of 0.001), which
junk of less than half the texts does not move. Every language has a reference of its own, however
small its share; texts without a language use the reference of all texts together. A language of
very few texts is therefore compared mostly with itself. The references are a table with a row for
each language (``common`` words and the classes' medians). It is shipped to the tasks in blocks of
at most about ``BLOCK`` languages; each text is judged once, with the block of its language.

Null and empty texts have no words and are not kept. Repeated rows are judged each; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import BLANKS, byte_pieces, small_batches, staged

SYMBOLS = "#*$%&|<>"
CLASSES = ("lower", "upper", "letter", "digit", "space", "line", "stop", "cry", "symbol", "ascii", "mark", "other")
OPTIONS = {"min_words": 50, "min_chars": 200, "char_limit": 0.30, "word_limit": 0.26, "word_spread": 1.3}
#: Distinct words a task counts before it hands them on.
HELD = 200_000
#: Languages whose references are shipped together, about 10 KB each.
BLOCK = 2000
ALL = ""
STEPS = 1000


def _class_of(c: str) -> int:
    kind = unicodedata.category(c)
    name = ("lower" if kind == "Ll" else "upper" if kind in ("Lu", "Lt") else "letter" if kind[0] == "L" else "digit" if kind[0] == "N"
            else "line" if c in "\n\r" else "space" if kind == "Zs" or c == "\t" else "symbol" if c in SYMBOLS else "cry" if c in "!?"
            else "stop" if c in ".,;:'\"()-" else "ascii" if ord(c) < 128 else "mark" if kind[0] in "PSM" else "other")
    return CLASSES.index(name)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    return np.array([_class_of(chr(c)) for c in range(0x110000)], np.uint8)


def class_counts(text: str) -> np.ndarray:
    out = np.zeros(len(CLASSES), np.int64)
    for k in range(0, len(text), 1 << 20):
        points = np.frombuffer(text[k:k + (1 << 20)].encode("utf-32-le", "surrogatepass"), np.uint32)
        out += np.bincount(_classes()[points], minlength=len(CLASSES))
    return out


def word_ids(text: str) -> tuple[dict[bytes, int], np.ndarray]:
    """The text's distinct words, numbered, and its words as these numbers."""
    index: dict[bytes, int] = {}
    parts = [np.fromiter((index.setdefault(w, len(index)) for w in p.split()), np.int64) for p in byte_pieces(text.encode())]
    return index, np.concatenate(parts)


def repeated_words(ids: np.ndarray, distinct: int) -> int:
    """Words in 3-word windows that are found twice or more."""
    if len(ids) < 4:
        return 0
    pair = ids[:-1] * distinct + ids[1:]
    if distinct > 1 << 20:  # three such numbers would not fit 64 bits
        pair = np.unique(pair, return_inverse=True)[1]
    key = pair[:-1] * distinct + ids[2:]
    _, of, times = np.unique(key, return_inverse=True, return_counts=True)
    again = times[of] > 1
    inside = np.zeros(len(ids), bool)
    for k in range(3):
        inside[k:len(ids) - 2 + k] |= again
    return int(inside.sum())


def duplicate_lines(text: str) -> int:
    seen: set[str] = set()
    n = 0
    for line in text.split("\n"):
        if line.strip(BLANKS):
            n += line in seen
            seen.add(line)
    return n


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    m = (p + q) / 2
    part = lambda a: float((a[a > 0] * np.log2(a[a > 0] / m[a > 0])).sum())
    return math.sqrt(max(0.0, (part(p) + part(q)) / 2))


def corpus_counts(docs: DataFrame, min_words: int) -> DataFrame:
    """(lang, word, n) over all texts of at least ``min_words`` words, once by language and once
    under ``ALL``. Rows ``\\n<class>:<step>`` count the texts by a class's share."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}

        def flush():
            rows = [(k, w, n) for k, c in counts.items() for w, n in c.items()]
            counts.clear()
            k, w, n = zip(*rows) if rows else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(k, pa.string()), pa.array(w, pa.binary()), pa.array(n, pa.int64())], ["lang", "word", "n"])

        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                raw = (text or "").encode()
                if len(raw.split(None, min_words)) >= min_words:
                    c = counts.setdefault(lang or ALL, Counter())
                    for piece in byte_pieces(raw):
                        c.update(piece.split())
                    shares = class_counts(text)
                    c.update(b"\n%d:%d" % (k, s) for k, s in enumerate(np.rint(shares * (STEPS / shares.sum())).astype(int).tolist()))
                    if sum(map(len, counts.values())) > HELD:
                        yield flush()
        yield flush()

    one = (docs.select("text", F.col("lang").cast("string").alias("lang")).mapInArrow(run, "lang string, word binary, n long")
           .groupBy("lang", "word").agg(F.sum("n").alias("n")))
    return staged(one, "corpus-counts")


def reference_table(docs: DataFrame, common: int = 50, min_words: int = 50) -> DataFrame:
    """(lang, n, top, classes) of every language and ``ALL``: words, the common ones, the classes' median steps."""
    named = corpus_counts(docs, min_words)
    is_class = F.substring("word", 1, 1) == F.lit(b"\n")
    pooled = named.groupBy("word").agg(F.sum("n").alias("n")).select(F.lit(ALL).alias("lang"), "word", "n")
    counts = named.filter(F.col("lang") != ALL).unionByName(pooled)
    words = counts.filter(~is_class)
    top = (words.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word")))
           .filter(F.col("r") <= common).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("r", "word", "n"))).alias("top")))
    parts = F.split(F.col("word").cast("string"), ":")
    steps = counts.filter(is_class).select("lang", F.substring(parts[0], 2, 9).cast("int").alias("k"), parts[1].cast("int").alias("s"), "n")
    by = Window.partitionBy("lang", "k")
    middle = (steps.withColumn("seen", F.sum("n").over(by.orderBy("s"))).withColumn("all", F.sum("n").over(by))
              .filter("2 * seen >= all").groupBy("lang", "k").agg(F.min("s").alias("s"))
              .groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("k", "s"))).alias("classes")))
    return staged(words.groupBy("lang").agg(F.sum("n").alias("n")).join(top, "lang").join(middle, "lang"), "references")


def loaded(table: DataFrame) -> dict[str, dict]:
    """By language: the common words, their shares with the rest's, and the classes' shares."""
    out = {}
    for r in table.collect():
        n = [x.n for x in r.top]
        middle = np.array([x.s for x in r.classes], float) / STEPS
        out[r.lang] = {"words": {bytes(x.word): i for i, x in enumerate(r.top)}, "shares": np.array([*n, r.n - sum(n)], float) / r.n,
                       "classes": middle / max(middle.sum(), 1e-9)}
    return out


def references(docs: DataFrame, common: int = 50, min_words: int = 50) -> dict[str, dict]:
    """The references of every language and ``ALL``."""
    return loaded(reference_table(docs, common, min_words))


def judge(text: str | None, lang: str | None, refs: dict[str, dict], min_words: int, min_chars: int, char_limit: float,
          word_limit: float, word_spread: float) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, js_chars, js_words, kept."""
    text = text or ""
    index, ids = word_ids(text)
    n = len(ids)
    repeat = repeated_words(ids, len(index))
    failed = n < min_words or 100 * repeat > 50 * n
    ref = refs.get(lang or ALL, refs.get(ALL))
    js_chars = js_words = None
    if ref and len(text) >= min_chars:
        shares = class_counts(text)
        js_chars = js_distance(shares / shares.sum(), ref["classes"])
    if ref and n >= min_words:
        times = np.bincount(ids)
        bins = np.array([times[index[w]] if w in index else 0 for w in ref["words"]] + [0], float)
        bins[-1] = n - bins.sum()
        js_words = js_distance(bins / n, ref["shares"])
    kept = not failed and (js_chars is None or js_chars <= char_limit) and (
        js_words is None or js_words <= word_limit + word_spread / math.sqrt(n))
    return (n, len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), duplicate_lines(text), repeat, failed,
            js_chars, js_words, kept)


COLUMNS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
           "js_chars double, js_words double, kept boolean")


def quality_rules(docs: DataFrame, common: int = 50, **options) -> DataFrame:
    """doc_id with the counts, both distances and the verdict of every text."""
    given = {**OPTIONS, **options}
    table = reference_table(docs, common, given["min_words"])
    pooled = loaded(table.filter(F.col("lang") == ALL))
    blocks = -(-table.count() // BLOCK) or 1
    block_of = lambda lang: F.pmod(F.xxhash64(lang), F.lit(blocks))
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    docs = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    out = None
    for k in range(blocks):
        refs = docs.sparkSession.sparkContext.broadcast({**loaded(table.filter(block_of(F.col("lang")) == k)), **pooled})

        def run(batches: Iterator[pa.RecordBatch], refs=refs) -> Iterator[pa.RecordBatch]:
            types = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.float64(), pa.bool_()]
            for b in batches:
                rows = [judge(t, k, refs.value, **given) for t, k in zip(b.column("text").to_pylist(), b.column("lang").to_pylist())]
                made = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *made], ["doc_id", *names])

        mine = docs if blocks == 1 else docs.filter(block_of(F.coalesce("lang", F.lit(ALL))) == k)
        part = mine.mapInArrow(run, f"doc_id {kind}, {COLUMNS}")
        out = part if out is None else out.unionByName(part)
    return out
