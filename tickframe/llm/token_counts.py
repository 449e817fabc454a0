"""Token counts by a compiled transducer: one table look-up per character, no tokens made.

The tokenizer (a file of the tokenizers library: NFC, white space, lower case; a split into
letters, single digits, other characters and English contractions; byte-level BPE with word ends)
becomes one deterministic transducer over characters. Its transitions carry how many more tokens
the text read so far has than before; that number may be negative, as a longer prefix of a word
can have fewer tokens.

States. The BPE encoding of a word's prefix is known by its last token: the only one, of the
tokens that end there, that may follow the last token of what stands before it (both would come
out of merging their joined text). So a state needs, for every place from which a token may still
be running, the place in the vocabulary's trie, the last token before it and the count there,
relative to now; together with the split's own state and what closing the word here would add
(word ends have tokens of their own). Equal such states are one state. They are compiled when they
are first met, kept per worker process, and dropped together beyond ``STATES``.

Chunks. White space, digits and special tokens bring every state back to the start, so the state
map of a chunk (entry state to exit state and count) depends on the entry state up to the first
such character only: it is kept as that head, the constant count between the first and the last
one, and the tail behind. These maps compose associatively; texts over ``LONG`` characters are cut
into chunks that Spark deals out to tasks, and a parallel prefix scan over a document's maps gives
the count before every chunk and of the whole.

Null and empty texts have no tokens. Strings of special tokens in a text count as one token each,
as with that library. Repeated rows and ids are counted row by row; an empty table gives an empty
result; other columns than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from .bpe import byte_alphabet
from .common import small_batches, staged

#: States kept by a worker, characters between two looks at their number, and checked token pairs kept.
STATES, STEP, COMPATIBLE = 250_000, 1 << 15, 500_000
#: Characters of a text that is cut into chunks, and of a chunk.
LONG, CHUNK = 1 << 20, 1 << 18
# Fixed value: the split pattern of the published vocabulary; ``Transducer.follow`` is its automaton.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

Items = tuple[tuple[int, int, int], ...]  # trie node, last token before it (-1: word start), count there
WORD: Items = ((0, -1, 0),)


class State(dict):
    """Transitions by character: (next state, tokens added). Missing ones are compiled."""

    __slots__ = ("machine", "key", "end")

    def __init__(self, machine: Transducer, key: tuple[str, Items, int]):
        self.machine, self.key, self.end = machine, key, key[2]

    def __missing__(self, ch: str) -> tuple[State, int]:
        out = self[ch] = self.machine.follow(self.key, ch)
        return out


class Transducer:
    """One vocabulary, compiled on demand."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        model, normal, split = data["model"], data["normalizer"] or {}, (data["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        steps = [n["type"] for n in normal.get("normalizers", [])]
        if (model["type"], steps, split[0].get("pattern"), split[-1].get("type")) != ("BPE", ["NFC", "Replace", "Lowercase"], {"Regex": SPLIT}, "ByteLevel"):
            raise ValueError("a lower-casing BPE model with this module's split and a ByteLevel step is expected")
        if model.get("continuing_subword_prefix") or model.get("ignore_merges") or not model.get("end_of_word_suffix"):
            raise ValueError("a model with word ends, without subword prefixes and ignore_merges is expected")
        byte, end = byte_alphabet(), model["end_of_word_suffix"]
        vocab, size = model["vocab"], max(model["vocab"].values()) + 1

        def symbols(token: str) -> list[int]:
            last = token.endswith(end)
            out = [byte[c] for c in (token[:-len(end)] if last else token)]
            return out[:-1] + [out[-1] | 256] if last else out

        self.rank, self.parts, self.merge = [-1] * size, [(0, 0)] * size, {}
        for r, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            whole, pair = vocab[a + b], (vocab[a], vocab[b])
            self.merge.setdefault(pair, r)
            if self.rank[whole] < 0:
                self.rank[whole], self.parts[whole] = r, pair
        self.pairs: dict[tuple[int, int], bool] = {}
        #: child by node * 512 + symbol, the token that ends at a node, and whether a node has children
        self.trie: dict[int, int] = {}
        self.token, self.inner = [-1], [True]
        for t, i in sorted(vocab.items(), key=lambda x: self.rank[x[1]]):
            node = 0
            for s in symbols(t):
                self.inner[node] = True
                child = self.trie.get(node << 9 | s)
                if child is None:
                    child = self.trie[node << 9 | s] = len(self.token)
                    self.token.append(-1)
                    self.inner.append(False)
                node = child
            a, b = self.parts[i]
            if self.rank[i] < 0 or self.untouched(a, b, 2 * self.rank[i]):  # else merging never comes to this token
                self.token[node] = i
        special = [t["content"] for t in data["added_tokens"]]
        self.specials = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.letter, self.number, self.white = (regex.compile(p).match for p in (r"\p{L}", r"\p{N}", r"\p{White_Space}"))
        self.forget()

    def forget(self) -> None:
        """Drop all states."""
        self.states: dict[tuple[str, Items, int], State] = {}
        self.start = self.state("", WORD, 0)

    def state(self, mode: str, items: Items, end: int) -> State:
        key = mode, items, end
        if key not in self.states:
            self.states[key] = State(self, key)
        return self.states[key]

    # ---- BPE
    def untouched(self, a: int, b: int, until: int) -> bool:
        """Whether the text of two tokens stays these two up to merge ``until`` (twice its rank, one more: of equal ones the left comes first).

        The two pieces that touch are followed backwards through the merges that made them; a merge of
        both with a lower rank would have come before.
        """
        while True:
            r = self.merge.get((a, b))
            if r is not None and 2 * r < until:
                return False
            if self.rank[a] < 0 and self.rank[b] < 0:
                return True
            if self.rank[a] > self.rank[b]:
                until, a = min(until, 2 * self.rank[a]), self.parts[a][1]
            else:
                until, b = min(until, 2 * self.rank[b] + 1), self.parts[b][0]

    def follows(self, last: int, token: int) -> bool:
        if last < 0:
            return True
        known = self.pairs.get((last, token))
        if known is None:
            if len(self.pairs) >= COMPATIBLE:
                self.pairs.clear()
            known = self.pairs[last, token] = self.untouched(last, token, 2 * len(self.rank) + 2)
        return known

    def advance(self, items: Items, ch: str) -> tuple[Items, int, int]:
        """A word's items after one more character, the tokens it adds, and those that closing the word would add to that."""
        added = end = 0
        for c in ch.encode():
            grown, last, more = [], -1, None
            for node, before, n in items:
                child = self.trie.get(node << 9 | c)
                if child is not None:
                    t = self.token[child]
                    if more is None and t >= 0 and self.follows(before, t):
                        last, more = t, n + 1
                    if self.inner[child]:
                        grown.append((child, before, n))
                stop = self.trie.get(node << 9 | 256 | c)
                if stop is not None and self.token[stop] >= 0 and self.follows(before, self.token[stop]):
                    end = n + 1
            items = ((0, last, 0), *((node, before, n - more) for node, before, n in grown))
            added, end = added + more, end - more
        return items, added, end

    def word(self, text: str) -> int:
        """The tokens of one whole word."""
        items, total, end = WORD, 0, 0
        for ch in text:
            items, n, end = self.advance(items, ch)
            total += n
        return total + end

    # ---- the split and the words together
    def follow(self, key: tuple[str, Items, int], ch: str) -> tuple[State, int]:
        """The transition of a state: ``mode`` is empty between words, L in letters, O in other
        characters, and an apostrophe (with r, v or l) where a contraction may still come."""
        mode, items, end = key
        if self.white(ch):
            return self.start, end
        if self.number(ch):
            return self.start, end + self.word(ch)
        if self.letter(ch):
            if mode == "'" and ch in "stmd":
                return self.start, self.word(mode + ch) - 1
            if mode + ch in ("'re", "'ve", "'ll"):
                return self.start, self.word(mode + ch) - self.word("'") - 1
            if mode == "L" or len(mode) == 2:
                items, n, end = self.advance(items, ch)
                return self.state("L", items, end), n
            new, n, stop = self.advance(WORD, ch)
            return self.state("'" + ch if mode == "'" and ch in "rvl" else "L", new, stop), end + n
        if mode in ("O", "'"):
            items, n, end = self.advance(items, ch)
            return self.state("O", items, end), n
        new, n, stop = self.advance(WORD, ch)
        return self.state("'" if ch == "'" else "O", new, stop), end + n

    # ---- texts
    def normal(self, text: str) -> str:
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower()  # str.lower looks at where a word ends for this letter alone

    def parts_of(self, text: str) -> Iterator[str | None]:
        """Normalised text between special tokens; None for each special token."""
        at = 0
        for m in self.specials.finditer(text) if self.specials else ():
            yield self.normal(text[at:m.start()])
            yield None
            at = m.end()
        yield self.normal(text[at:])

    def run(self, text: str) -> int:
        """The tokens of a normalised text from the start state to its end."""
        state, total = self.start, 0
        for i in range(0, len(text), STEP):
            if len(self.states) > STATES:
                self.forget()
                state = self.state(*state.key)
            for ch in text[i:i + STEP]:
                state, n = state[ch]
                total += n
        return total + state.end

    def count(self, text: str) -> int:
        return sum(1 if part is None else self.run(part) for part in self.parts_of(text))

    # ---- state maps of chunks
    def resets(self, text: str, back: bool = False) -> int:
        """Where the first (last) character is that leads every state to the start; -1: nowhere."""
        found = (i for i in (range(len(text) - 1, -1, -1) if back else range(len(text))) if self.white(text[i]) or self.number(text[i]))
        return next(found, -1)

    def chunk_map(self, text: str | None) -> ChunkMap:
        if text is None:
            return "", 1, ""
        first = self.resets(text) + 1
        if not first:
            return text, None, ""
        last = self.resets(text, back=True) + 1
        return text[:first], self.run(text[first:last]), text[last:]

    def compose(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        """The state map of a chunk and the one behind it."""
        if a[1] is None:
            return a[0] + b[0], b[1], b[2]
        if b[1] is None:
            return a[0], a[1], a[2] + b[0]
        return a[0], a[1] + self.run(a[2] + b[0]) + b[1], b[2]

    def scan(self, maps: list[ChunkMap]) -> list[ChunkMap]:
        """All prefixes' compositions by recursive pairing: as many levels as the logarithm of their number."""
        if len(maps) < 2:
            return list(maps)
        pairs = self.scan([self.compose(a, b) for a, b in zip(maps[::2], maps[1::2])])
        return [maps[0] if i == 0 else pairs[i // 2] if i % 2 else self.compose(pairs[i // 2 - 1], m) for i, m in enumerate(maps)]

    def closed(self, m: ChunkMap) -> int:
        """The tokens of the text of a map, entered at the start and closed behind it."""
        return self.run(m[0]) + (m[1] or 0) + self.run(m[2])


#: head, count behind it (None: no character of the chunk resets the state), tail
ChunkMap = tuple[str, int | None, str]


@lru_cache(maxsize=2)
def transducer(spec: str) -> Transducer:
    """One transducer per worker process and vocabulary."""
    return Transducer(spec)


PIECE = "key long, no int, part string"
MAP = "key long, no int, head string, n long, tail string"


def count_tokens(docs: DataFrame, vocabulary: str, long_chars: int = LONG, chunk_chars: int = CHUNK) -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens of every row of ``docs``."""
    spark = docs.sparkSession
    small_batches(spark)
    with open(vocabulary, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    rows = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
                       F.coalesce("text", F.lit("")).alias("text"))
    counted = StructType([rows.schema["doc_id"], StructField("n_bytes", rows.schema["n_bytes"].dataType), *_parse_datatype_string("n_tokens long").fields])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = transducer(spec.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([model.count(t.as_py()) for t in b.column(2)], pa.int64())],
                                             ["doc_id", "n_bytes", "n_tokens"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, key = transducer(spec.value), TaskContext.get().partitionId() << 36
        for b in batches:
            for i in range(b.num_rows):
                key += 1
                pieces = (x for p in model.parts_of(b.column(2)[i].as_py())
                          for x in ([None] if p is None else (p[k:k + chunk_chars] for k in range(0, len(p), chunk_chars))))
                for no, piece in enumerate(pieces):
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), b.column(1).slice(i, 1), pa.array([key], pa.int64()), pa.array([no], pa.int32()),
                                                      pa.array([piece], pa.string())], ["doc_id", "n_bytes", "key", "no", "part"])

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = transducer(spec.value)
        for b in batches:
            made = [model.chunk_map(p.as_py()) for p in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([m[i] for m in made], k) for i, k in enumerate((pa.string(), pa.int64(), pa.string())))],
                                             ["key", "no", "head", "n", "tail"])

    def scanned(key: tuple, table: pa.Table) -> pa.Table:
        model = transducer(spec.value)
        found = [(r["head"], r["n"], r["tail"]) for r in table.sort_by("no").to_pylist()]
        return pa.table({"key": [key[0].as_py()], "n_tokens": [model.closed(model.scan(found)[-1])]}, schema=pa.schema([("key", pa.int64()), ("n_tokens", pa.int64())]))

    short, big = F.char_length("text") <= long_chars, F.char_length("text") > long_chars
    done = rows.filter(short).mapInArrow(whole, counted)
    pieces = staged(rows.filter(big).mapInArrow(cut, StructType([*counted.fields[:2], *_parse_datatype_string(PIECE).fields])), "chunks")
    totals = (pieces.select("key", "no", "part").repartition("key", "no").mapInArrow(maps, MAP)
              .groupBy("key").applyInArrow(scanned, "key long, n_tokens long"))
    return done.unionByName(pieces.filter("no = 0").select("key", "doc_id", "n_bytes").join(totals, "key").select("doc_id", "n_bytes", "n_tokens"))


def token_digest(docs: DataFrame, vocabulary: str, limit: int = 2048) -> DataFrame:
    """The registered form: bytes, tokens and whether there are more than ``limit``."""
    return count_tokens(docs, vocabulary).withColumn("over_limit", F.col("n_tokens") > limit)
