"""Byte-level BPE encoding by backtracking, and decoding by an offset table.

Encoding. A pre-token is covered from the left with the longest token that starts at each place
(found by an Aho-Corasick automaton over the vocabulary). A token may follow another only if
merging their joined text would give just these two tokens; that is looked up in a
pair-compatibility table, filled on demand. Where no token fits, the place is marked dead, the
last token is taken back and its next shorter prefix is tried. Each place is marked dead at most
once, so the work is linear in the text, and a sequence whose neighbours are all compatible is
exactly what applying the merges in order gives.

Vocabulary, merges and special tokens come from a file of the tokenizers library with a
ByteLevel pre-tokenizer; the file is read on the driver and broadcast (its size is that of the
vocabulary). Strings of special tokens in a text become those tokens, as that library does.
Token ids are carried as packed little-endian unsigned 32-bit integers.

Null and empty texts give no tokens and decode to an empty text. Very long texts are cut where a
white-space character follows another character (no pre-token reaches across such a place).
Repeated rows are encoded each; an empty table gives an empty result; other columns are carried,
and an input column named like a result column is replaced.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, DataType, StringType, StructField, StructType

from .common import small_batches

# Fixed value: the published pre-token pattern of byte-level BPE, white space as Unicode has it.
PRETOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?![^\p{White_Space}])|\p{White_Space}+"""
#: Characters encoded at a time; words kept in a worker's cache; longest word that is kept.
CHUNK, CACHED, CACHED_CHARS = 1 << 20, 250_000, 48
COMPATIBLE = 500_000
#: Texts whose characters all lie below this one are split by ``re`` with the classes spelled out.
NARROW = "\u0250"


def byte_alphabet() -> dict[str, int]:
    """Byte-level BPE's printable stand-ins: printable Latin-1 bytes stand for themselves, the others follow 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def narrow_pattern() -> str:
    """``PRETOKEN`` for characters below ``NARROW``."""
    def span(has: Callable[[str], object]) -> str:
        return "".join(f"\\u{c:04x}" for c in range(ord(NARROW)) if has(chr(c)))

    letter, number = (span(regex.compile(rf"\p{{{k}}}").match) for k in "LN")
    white = span(regex.compile(r"\p{White_Space}").match)
    return (PRETOKEN.replace(r"[^\p{White_Space}\p{L}\p{N}]", f"[^{white}{letter}{number}]").replace(r"[^\p{White_Space}]", f"[^{white}]")
            .replace(r"\p{L}", f"[{letter}]").replace(r"\p{N}", f"[{number}]").replace(r"\p{White_Space}", f"[{white}]"))


class Bpe:
    """One vocabulary: ``encode`` texts to ids and ``decode`` ids to texts."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        model, byte = data["model"], byte_alphabet()
        if model["type"] != "BPE" or (data["pre_tokenizer"] or {}).get("type") != "ByteLevel" or data["normalizer"]:
            raise ValueError("a BPE model with a ByteLevel pre-tokenizer and no normalizer is expected")
        if data["pre_tokenizer"].get("add_prefix_space") or model.get("ignore_merges"):
            raise ValueError("add_prefix_space and ignore_merges are not supported")
        ids: dict[bytes, int] = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        size = max([*ids.values(), *self.special.values()]) + 1
        self.text = [b""] * size
        for t, i in ids.items():
            self.text[i] = t
        for t, i in self.special.items():
            self.text[i] = t.encode()
        # rank of the merge that makes a token (-1: none), its two parts, and the merge of two tokens
        self.rank, self.parts, self.merge = [-1] * size, [(0, 0)] * size, {}
        for r, m in enumerate(model["merges"]):
            a, b = (ids[bytes(byte[c] for c in t)] for t in (m.split(" ") if isinstance(m, str) else m))
            whole = ids[self.text[a] + self.text[b]]
            self.merge.setdefault((a, b), r)
            if self.rank[whole] < 0:
                self.rank[whole], self.parts[whole] = r, (a, b)
        self.shorter = [next((ids[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in ids), -1) for t in self.text]
        self.automaton = ahocorasick.Automaton()
        for t, i in ids.items():
            self.automaton.add_word(t.decode("latin-1"), (len(t) - 1, i))
        self.automaton.make_automaton()
        self.size = [len(t) for t in self.text]
        self.pretokens = regex.compile(PRETOKEN).findall
        self.narrow_pretokens = re.compile(narrow_pattern()).findall
        self.wide = re.compile(f"[^\u0000-{chr(ord(NARROW) - 1)}]").search
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.safe_cut = regex.compile(r"(?<=[^\p{White_Space}])\p{White_Space}").search
        self.pairs: dict[tuple[int, int], bool] = {}
        self.cache: dict[str, bytes] = {}
        self.blob = np.frombuffer(b"".join(self.text), np.uint8)
        self.offset = np.concatenate([[0], np.cumsum([len(t) for t in self.text])])

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the text of the two tokens gives just these two.

        Undo merges from the last to the first and look at the two pieces that touch: they
        existed until the merge that was undone, so a merge of both with a lower rank would
        have come before it. Of equal ranks the one further left comes first.
        """
        known = self.pairs.get((left, right))
        if known is None:
            known, until, a, b = True, 2 * len(self.rank) + 2, left, right
            while True:
                r = self.merge.get((a, b))
                if r is not None and 2 * r < until:
                    known = False
                    break
                if self.rank[a] < 0 and self.rank[b] < 0:
                    break
                if self.rank[a] > self.rank[b]:
                    until, a = 2 * self.rank[a], self.parts[a][1]
                else:
                    until, b = 2 * self.rank[b] + 1, self.parts[b][0]
            if len(self.pairs) >= COMPATIBLE:
                self.pairs.clear()
            self.pairs[left, right] = known
        return known

    def encode_word(self, word: str) -> bytes:
        raw = word.encode().decode("latin-1")
        n = len(raw)
        longest = [-1] * n
        for end, (back, token) in self.automaton.iter(raw):
            longest[end - back] = token  # ends ascend, so the longest stays
        size, shorter, known = self.size, self.shorter, self.pairs
        dead: set[int] = set()
        out: list[int] = []
        at, last, token = 0, -1, longest[0]
        while at < n:
            while token >= 0:
                end = at + size[token]
                if end not in dead:
                    if last < 0:
                        break
                    fits = known.get((last, token))
                    if self.compatible(last, token) if fits is None else fits:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                last, at = token, end
                token = longest[at] if at < n else -1
            else:
                dead.add(at)
                token = out.pop()  # the first byte alone always fits at 0, so there is a last token
                at -= size[token]
                last, token = out[-1] if out else -1, shorter[token]
        return self.pack(len(out), out)

    @staticmethod
    def pack(n: int, ids: list[int]) -> bytes:
        return struct.pack(f"<{n}I", *ids)

    def _plain(self, text: str) -> Iterator[bytes]:
        cache = self.cache
        split = self.pretokens if self.wide(text) else self.narrow_pretokens
        for start, stop in self._chunks(text):
            words = split(text, start, stop)
            new = set(words).difference(cache)
            if len(cache) + len(new) > CACHED:
                cache.clear()
                new = set(words)
            cache.update((w, self.encode_word(w)) for w in new)
            yield b"".join(map(cache.__getitem__, words))
            for w in new:
                if len(w) > CACHED_CHARS:
                    del cache[w]

    def _chunks(self, text: str) -> Iterator[tuple[int, int]]:
        start = 0
        while len(text) - start > CHUNK:
            cut = self.safe_cut(text, start + CHUNK)
            if not cut:
                break
            yield start, cut.start()
            start = cut.start()
        yield start, len(text)

    def encode(self, text: str | None) -> bytes:
        """Packed ids of a text."""
        if not text:
            return b""
        parts = self.specials.split(text) if self.specials else [text]
        out: list[bytes] = []
        for k, part in enumerate(parts):
            if k % 2:
                out.append(np.array([self.special[part]], "<u4").tobytes())
            elif part:
                out += self._plain(part)
        return b"".join(out)

    def decode(self, packed: bytes | None) -> str:
        ids = np.frombuffer(packed or b"", "<u4")
        out = []
        for k in range(0, len(ids), CHUNK):
            part = ids[k:k + CHUNK]
            first = self.offset[part]
            size = self.offset[part + 1] - first
            ends = np.cumsum(size)
            out.append(self.blob[np.repeat(first - ends + size, size) + np.arange(ends[-1])].tobytes())
        return b"".join(out).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def bpe(spec: str) -> Bpe:
    """One ``Bpe`` per worker process and vocabulary."""
    return Bpe(spec)


def _mapped(df: DataFrame, vocabulary: str, column: str, out: dict[str, DataType], each: Callable[[Bpe, object], tuple]) -> DataFrame:
    """``df`` with the columns ``out`` = each(Bpe, column) in place of ``column`` and any of their names."""
    small_batches(df.sparkSession)
    with open(vocabulary, encoding="utf-8") as f:
        spec = df.sparkSession.sparkContext.broadcast(f.read())
    carried = [c for c in df.columns if c != column and c not in out]
    kinds = [pa.binary() if isinstance(t, BinaryType) else pa.string() for t in out.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe(spec.value)
        for b in batches:
            made = [each(model, x.as_py()) for x in b.column(column)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in carried), *(pa.array([m[i] for m in made], k) for i, k in enumerate(kinds))],
                                             [*carried, *out])

    schema = StructType([*(df.schema[c] for c in carried), *(StructField(c, t) for c, t in out.items())])
    return df.select(*[F.col(f"`{c}`") for c in [*carried, column]]).mapInArrow(run, schema)


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``docs`` with the packed token ids ``ids`` in place of ``text``."""
    return _mapped(docs, vocabulary, "text", {"ids": BinaryType()}, lambda m, t: (m.encode(t),))


def decode(rows: DataFrame, vocabulary: str) -> DataFrame:
    """``rows`` with the decoded ``text`` in place of the packed ``ids``."""
    return _mapped(rows, vocabulary, "ids", {"text": StringType()}, lambda m, i: (m.decode(i),))


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``docs`` with ``ids`` and the ``text`` that they decode to, in one pass (one set of workers)."""
    return _mapped(docs, vocabulary, "text", {"ids": BinaryType(), "text": StringType()}, lambda m, t: ((i := m.encode(t)), m.decode(i)))


def bpe_digest(docs: DataFrame, vocabulary: str) -> DataFrame:
    """The registered form: token count and hashes of the ids and of the text they decode to."""
    return round_trip(docs.select("doc_id", "text"), vocabulary).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"))
