"""Repair of conversation structure by weighted generalised LR parsing.

The roles of a conversation are read by the grammar ``GRAMMAR`` (an optional system turn, then
user and assistant by turns). Its LR(0) automaton is built here. The parser keeps all stacks at
once as a graph: one node for each stack top (LR state), reached by keeping, reroling or deleting
the row at hand and by inserting turns before it. Stacks of equal tops go on alike, so they are
merged and the one of least (cost, audit) stays; ``audit`` are the initials of the edits so far.

Order of audits. Edits of a row come after the insertions before it, so at a row's end no audit
continues another one and two equal audits lead to equal tops. The nodes' order by audit is thus
all that later comparisons need: a node is (top, cost beyond the least one), and the nodes stand in
the order of their audits. There are few such graphs, so each (graph, row class) is parsed once per
worker and looked up afterwards; a row then costs one look-up and a link back to its best edits.
A graph stays small because a stack without pairs is dropped as soon as it can't win any more: a
stack with pairs may do all that it does for at most one deletion more.

Distribution. Conversations of up to ``LONG_ROWS`` rows and ``LONG_BYTES`` bytes go whole to one
task, streamed in order. Longer ones are sorted by range over all tasks and cut into chunks. Each
chunk is parsed from every top that may stand at its start, which gives a small table (entry top,
exit top, cost, order); these compose along the conversation, which fixes each chunk's entry and
exit; then the chunks are parsed again, each on its own, and give out their rows. Earlier rows of
equal role and text are found by aggregation and join, equal rows by counting before the sort.

Rows: null roles and texts are one space; a null ``turn`` comes first; rows of one turn are
ordered by role and then by the SHA-256 of the text, equal rows stand side by side. A null conv_id
is a conversation of its own. A role's initial is its first character; an empty role has one
outside the grammar. Very long texts are carried once and hashed. Empty tables give empty results;
columns other than conv_id, turn, role and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from .common import BLANKS, small_batches, staged

#: Nonterminals and productions; terminals are the initials of system, user and assistant.
GRAMMAR = {"C": ["", "P", "sP"], "P": ["T", "PT"], "T": ["ua"]}
ROLES = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
LONG_ROWS, LONG_BYTES, CHUNK_ROWS = 20_000, 16 << 20, 10_000
LONGEST = (1 << 63) - 1

Graph = tuple[tuple[int, int], ...]  # (stack top, cost beyond the least) in the order of the audits
Link = tuple[int, str]  # node of the graph before, edits since


# --------------------------------------------------------------------------- the automaton
class Automaton:
    """LR(0) states of ``GRAMMAR`` and what a terminal does to a stack.

    A stack is a tuple of states. Reductions other than that of the whole conversation need no look-ahead here.
    """

    def __init__(self, grammar: dict[str, list[str]], start: str = "C"):
        self.grammar, self.start = grammar, start
        first = self.closure({(start, body, 0) for body in grammar[start]})
        self.items, self.goto, todo = [first], {}, [0]
        while todo:
            at = todo.pop()
            for x in sorted({body[dot] for _, body, dot in self.items[at] if dot < len(body)}):
                to = self.closure({(head, body, dot + 1) for head, body, dot in self.items[at] if body[dot:dot + 1] == x})
                if to not in self.items:
                    self.items.append(to)
                    todo.append(len(self.items) - 1)
                self.goto[at, x] = self.items.index(to)
        self.reduce = [next(((h, len(b)) for h, b, d in sorted(items) if d == len(b) and h != start), None) for items in self.items]
        self.accepts = [any(h == start and d == len(b) for h, b, d in items) for items in self.items]

    def closure(self, items: set) -> frozenset:
        items, grown = set(items), 0
        while len(items) != grown:
            grown = len(items)
            items |= {(body[dot], new, 0) for _, body, dot in list(items) if dot < len(body) and body[dot] in self.grammar for new in self.grammar[body[dot]]}
        return frozenset(items)

    def shift(self, stack: tuple[int, ...], terminal: str) -> tuple[int, ...] | None:
        """The stack after a terminal and all reductions; None if it can't be shifted."""
        to = self.goto.get((stack[-1], terminal))
        if to is None:
            return None
        stack = (*stack, to)
        while reduction := self.reduce[stack[-1]]:
            head, size = reduction
            stack = stack[:-size]
            stack = (*stack, self.goto[stack[-1], head])
        return stack


class Parser:
    """Graph-structured stacks over ``GRAMMAR``, with each step parsed once."""

    def __init__(self):
        self.lr = lr = Automaton(GRAMMAR)
        #: a stack for each top (what lies below a top never matters to what may follow)
        self.stacks, todo = {0: (0,)}, [(0,)]
        while todo:
            stack = todo.pop()
            for x in "sua":
                to = lr.shift(stack, x)
                if to and to[-1] not in self.stacks:
                    self.stacks[to[-1]] = to
                    todo.append(to)
        self.tops = sorted(self.stacks)
        self.to = {(top, x): to[-1] for top, stack in self.stacks.items() for x in "sua" if (to := lr.shift(stack, x))}
        self.with_pairs = self.to[self.to[0, "u"], "a"]
        self.system = self.to[0, "s"]
        self.known: dict[tuple[Graph, str], tuple[Graph, int, tuple[Link, ...]]] = {}

    def inserted(self, top: int) -> dict[int, str]:
        """The tops that insertions lead to, with the audits of the shortest ways."""
        found, todo = {top: ""}, [top]
        for t in todo:
            for x in ROLES:
                to = self.to.get((t, x))
                if to is not None and to not in found:
                    found[to] = found[t] + "I"
                    todo.append(to)
        return found

    def step(self, graph: Graph, kind: str) -> tuple[Graph, int, tuple[Link, ...]]:
        """The graph after a row of class ``kind``, the least cost's growth, and each node's way back.

        ``kind``: D for a row that must go, else the role's initial (? for others), in upper case (! for others) if the row is truncated.
        """
        got = self.known.get((graph, kind))
        if got is None:
            got = self.known[graph, kind] = self.parse(graph, kind)
        return got

    def parse(self, graph: Graph, kind: str) -> tuple[Graph, int, tuple[Link, ...]]:
        best: dict[int, tuple[int, int, str]] = {}

        def reach(top: int, cost: int, before: int, audit: str) -> None:
            if top not in best or (cost, before, audit) < best[top]:
                best[top] = cost, before, audit

        own, extra = kind.lower(), TRUNCATED if kind.isupper() or kind == "!" else 0
        for before, (top, cost) in enumerate(graph):
            for at, audit in self.inserted(top).items():
                now = cost + INSERT * len(audit)
                reach(at, now + DELETE, before, audit + "D")
                if kind == "D":
                    continue
                for x in "sua":
                    to = self.to.get((at, x))
                    if to is not None and x == own:
                        reach(to, now + KEEP + extra, before, audit + "K")
                    elif to is not None and x in ROLES:
                        reach(to, now + REROLE + extra, before, audit + "R")
        full = best.get(self.with_pairs, (None,))[0]
        if full is not None:
            best = {top: b for top, b in best.items() if top not in (0, self.system) or b[0] <= full + (DELETE if top == 0 else 0)}
        least = min(b[0] for b in best.values())
        order = sorted(best, key=lambda top: best[top][1:])
        return tuple((top, best[top][0] - least) for top in order), least, tuple(best[top][1:] for top in order)

    def finish(self, graph: Graph) -> tuple[int, int, str]:
        """(cost beyond the least, node, insertions) of the cheapest way to an end that the grammar accepts."""
        return min((cost + INSERT * len(audit), i, audit) for i, (top, cost) in enumerate(graph)
                   for at, audit in self.inserted(top).items() if self.lr.accepts[at])

    def read(self, kinds: list[str], entry: int = 0) -> tuple[Graph, int, list[tuple[Link, ...]]]:
        graph, total, back = ((entry, 0),), 0, []
        for kind in kinds:
            graph, cost, links = self.step(graph, kind)
            total += cost
            back.append(links)
        return graph, total, back

    def edits(self, back: list[tuple[Link, ...]], node: int) -> list[str]:
        """Each row's edits (insertions before it, then its own) on the way to a node of the last graph."""
        out = []
        for links in reversed(back):
            node, audit = links[node]
            out.append(audit)
        return out[::-1]


PARSER = Parser()


def initial(role: str) -> str:
    return role[0] if role[:1] and role[0] in "sua" else "?"


# --------------------------------------------------------------------------- faults
ENDS = ".!?"
#: fault: blank, duplicate, truncated or null
FAULT_KIND = {"blank": "D", "duplicate": "D"}


def own_fault(text: str) -> str | None:
    """The fault of a row that is no duplicate."""
    end = text.rstrip(BLANKS)
    return "blank" if not end else None if end[-1] in ENDS else "truncated"


def kind_of(role: str, fault: str | None) -> str:
    own = initial(role)
    return FAULT_KIND.get(fault) or (own.upper() if fault and own != "?" else "!" if fault else own)


# --------------------------------------------------------------------------- emitted rows
ROWS = "chunk long, pos long, turn long, role string, text string, fault string, edit string, new_role string"


def edited(rows: list[tuple], edits: list[str], top: int, tail: str = "") -> Iterator[tuple]:
    """(turn, role, text, fault, edit, new_role) of rows (turn, role, text, fault) and of inserted turns."""
    for (turn, role, text, fault), audit in zip(rows, edits):
        for e in audit:
            if e == "K":
                new, top = role, PARSER.to[top, initial(role)]
            elif e == "D":
                new = None
            else:
                x = next(x for x in ROLES if (top, x) in PARSER.to)
                new, top = ROLES[x], PARSER.to[top, x]
            yield (None, None, "", None, "I", new) if e == "I" else (turn, role, text, fault, e, new)
    for _ in tail:
        x = next(x for x in ROLES if (top, x) in PARSER.to)
        top = PARSER.to[top, x]
        yield None, None, "", None, "I", ROLES[x]


def _table(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += sum(len(x) for x in r if isinstance(x, str))
        if len(held) == 4096 or size > 1 << 22:
            yield pa.RecordBatch.from_arrays([pa.array([h[i] for h in held], f.type) for i, f in enumerate(schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([h[i] for h in held], f.type) for i, f in enumerate(schema)], schema=schema)


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


# --------------------------------------------------------------------------- Spark
def clean(rows: DataFrame) -> DataFrame:
    """conv_id, turn (long), role, text (null: a space), and ``h``, the text's SHA-256."""
    blank = F.lit(" ")
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), blank).alias("role"),
                       F.coalesce(F.col("text").cast("string"), blank).alias("text")).withColumn("h", F.sha2("text", 256))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def repair(rows: DataFrame, long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Every row of ``rows`` and every inserted turn in order (conv_id, chunk, pos): fault, edit (K, R, D, I) and new role (null: deleted)."""
    small, large = repair_parts(rows, long_rows, long_bytes, chunk_rows)
    return small.unionByName(large)


def repair_parts(rows: DataFrame, long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES, chunk_rows: int = CHUNK_ROWS) -> tuple[DataFrame, DataFrame]:
    """``repair`` of the short conversations (each in one task, in order) and of the long ones."""
    small_batches(rows.sparkSession)
    rows = clean(rows)
    out = StructType([rows.schema["conv_id"], *_parse_datatype_string(ROWS).fields])
    shape = to_arrow_schema(out)
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text") + F.octet_length("role")).alias("size"))
    big = sizes.filter((F.col("n") > long_rows) | (F.col("size") > long_bytes)).select(F.col("conv_id").alias("big_id"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            for conv, group in groupby(_stream(batches), key=lambda r: r[0]):
                seen, marked = set(), []
                for _, turn, role, text, h in group:
                    fault = own_fault(text)
                    if fault != "blank" and (role, h) in seen:
                        fault = "duplicate"
                    seen.add((role, h))
                    marked.append((turn, role, text, fault))
                graph, _, back = PARSER.read([kind_of(role, fault) for _, role, _, fault in marked])
                _, node, tail = PARSER.finish(graph)
                for pos, r in enumerate(edited(marked, PARSER.edits(back, node), 0, tail)):
                    yield conv, 0, pos, *r
        return _table(made(), shape)

    small = (rows.join(big, _same("conv_id", "big_id"), "left_anti").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "h")
             .mapInArrow(whole, out))
    return small, long_repair(rows.join(big, _same("conv_id", "big_id"), "left_semi"), out, chunk_rows)


CHUNKED = "chunk long, pos long, turn long, role string, text string, fault string"
PATH = "chunk long, entry int, node int, tail string"


def long_repair(rows: DataFrame, out: StructType, chunk_rows: int) -> DataFrame:
    """``repair`` of conversations that no single task should hold."""
    conv, shape = rows.schema["conv_id"], to_arrow_schema(out)
    chunked = StructType([conv, *_parse_datatype_string(CHUNKED).fields])
    table = StructType([conv, *_parse_datatype_string("chunk long, graph binary").fields])
    path = StructType([conv, *_parse_datatype_string(PATH).fields])
    shapes = {name: to_arrow_schema(s) for name, s in (("chunked", chunked), ("table", table))}

    # equal rows once with their number, the first turn of each role and text, then all rows again
    copies = rows.groupBy("conv_id", "turn", "role", "h", "text").agg(F.count("*").alias("n"))
    first = copies.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("h").alias("k")).agg(
        F.min("turn").alias("least"), F.max(F.col("turn").isNull()).alias("unset"))
    known = copies.join(first, _same("conv_id", "c") & (F.col("role") == F.col("r")) & (F.col("h") == F.col("k")))
    seen = F.when(F.col("unset"), F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("least"))
    block = 4096
    spread = (known.select("conv_id", "turn", "role", "h", "text", "n", seen.alias("seen"))
              .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / block))))
              .withColumn("copy", F.explode(F.sequence(F.col("block") * block, F.least(F.col("n"), (F.col("block") + 1) * block) - 1)))
              .select("conv_id", "turn", "role", "h", "copy", "text", (F.col("seen") | (F.col("copy") > 0)).alias("seen")))
    ordered = spread.repartitionByRange("conv_id", "turn", "role", "h", "copy").sortWithinPartitions("conv_id", "turn", "role", "h", "copy")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            chunk, last, left = -1, None, 0
            for pos, (part, conv_id, turn, role, text, dup) in enumerate(_stream(batches)):
                if chunk < 0 or conv_id != last or not left:
                    chunk, last, left = (part << 36) + pos, conv_id, chunk_rows
                left -= 1
                fault = own_fault(text)
                yield conv_id, chunk, pos, turn, role, text, "duplicate" if dup and fault != "blank" else fault
        return _table(made(), shapes["chunked"])

    pieces = staged(ordered.select(F.spark_partition_id().alias("part"), "conv_id", "turn", "role", "text", "seen").mapInArrow(cut, chunked), "turns")

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            for (conv_id, chunk), group in groupby(_stream(batches), key=lambda r: r[:2]):
                kinds = [kind_of(r[3], r[4]) for r in group]
                found = [(entry, i, top, cost + total) for entry in PARSER.tops for graph, total, _ in [PARSER.read(kinds, entry)]
                         for i, (top, cost) in enumerate(graph)]
                yield conv_id, chunk, pa.array([x for f in found for x in f], pa.int64()).to_numpy().tobytes()
        return _table(made(), shapes["table"])

    slim = pieces.select("conv_id", "chunk", "pos", F.substring("role", 1, 1).alias("role"), "fault")
    maps = slim.repartition("conv_id", "chunk").sortWithinPartitions("conv_id", "chunk", "pos").mapInArrow(tables, table)

    def route(pdf: pd.DataFrame) -> pd.DataFrame:
        """Each chunk's entry top and the node of its last graph on the cheapest way through the conversation."""
        pdf = pdf.sort_values("chunk")
        live, back = [(0, 0)], []  # (top, cost) in the order of the audits
        for raw in pdf["graph"]:
            best: dict[int, tuple] = {}
            for entry, i, top, cost in np.frombuffer(raw, np.int64).reshape(-1, 4).tolist():
                for before, (at, paid) in enumerate(live):
                    if at == entry and (top not in best or (paid + cost, before, i) < best[top][:3]):
                        best[top] = paid + cost, before, i, entry
            order = sorted(best, key=lambda top: best[top][1:3])
            live = [(top, best[top][0]) for top in order]
            back.append([best[top][1:] for top in order])
        _, at, tail = PARSER.finish(tuple(live))
        steps = []
        for links in reversed(back):
            at, node, entry = links[at]
            steps.append((entry, node))
        steps.reverse()
        return pd.DataFrame({"conv_id": pdf["conv_id"].to_numpy(), "chunk": pdf["chunk"].to_numpy(), "entry": [s[0] for s in steps],
                             "node": [s[1] for s in steps], "tail": [""] * (len(steps) - 1) + [tail]})

    routes = maps.groupBy("conv_id").applyInPandas(route, path)
    routes = staged(routes, "routes")
    # a chunk's route comes first among its rows
    lead = routes.select("conv_id", "chunk", F.lit(-1).cast("long").alias("pos"), F.col("entry").cast("long").alias("turn"), F.lit("").alias("role"),
                         F.col("tail").alias("text"), F.col("node").cast("string").alias("fault"))

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            for (conv_id, chunk), group in groupby(_stream(batches), key=lambda r: r[:2]):
                _, _, _, entry, _, tail, node = next(group)
                marked = [r[3:] for r in group]
                _, _, back = PARSER.read([kind_of(role, fault) for _, role, _, fault in marked], entry)
                for pos, r in enumerate(edited(marked, PARSER.edits(back, int(node)), entry, tail)):
                    yield conv_id, chunk, pos, *r
        return _table(made(), shape)

    return (pieces.unionByName(lead).repartition("conv_id", "chunk").sortWithinPartitions("conv_id", "chunk", "pos").mapInArrow(parsed, out))


# --------------------------------------------------------------------------- the registered form
DIGEST = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
COST = {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}


def summaries(rows: DataFrame) -> DataFrame:
    """One row per conversation from ``repair`` rows that stand in order, each conversation within one task.

    A conversation's rows are streamed: beside the audit nothing of them is held. (The hash of a whole
    conversation has to be taken in order, so its long texts pass one task in turn.)
    """
    out = StructType([rows.schema["conv_id"], *_parse_datatype_string(DIGEST).fields])
    shape = to_arrow_schema(out)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            for conv, group in groupby(_stream(batches), key=lambda r: r[0]):
                found, sha, audit = dict.fromkeys(("blank", "duplicate", "truncated"), 0), hashlib.sha256(), []
                low = high = before = last = None
                distinct = illegal = cost = 0
                between = b""
                for _, turn, role, text, fault, edit, new in group:
                    audit.append(edit)
                    cost += COST[edit] + (TRUNCATED if fault == "truncated" and edit != "D" else 0)
                    if fault:
                        found[fault] += 1
                    if edit != "I":
                        illegal += before is not None and before + role[:1] not in ("su", "ua", "au")
                        before = role[:1]
                        if turn is not None:
                            low = turn if low is None else low
                            distinct += turn != last
                            high = last = turn
                    if new is not None:
                        sha.update(between + f"{new}:{text}".encode())
                        between = b"\n"
                gaps = 0 if low is None else min(high - low + 1 - distinct, LONGEST)
                yield conv, gaps, *found.values(), illegal, cost, "".join(audit), sha.hexdigest()
        return _table(made(), shape)

    return rows.select("conv_id", "turn", "role", "text", "fault", "edit", "new_role").mapInArrow(read, out)


def repair_summary(rows: DataFrame, **sizes: int) -> DataFrame:
    """Faults, cost, audit and the hash of the repaired turns of every conversation."""
    small, large = repair_parts(rows, **sizes)
    in_order = large.repartition("conv_id").sortWithinPartitions("conv_id", "chunk", "pos")
    return summaries(small).unionByName(summaries(in_order))


def damaged(conversations: DataFrame) -> DataFrame:
    """The registered query's input: rows dropped, emptied, cut, repeated or reroled by a hash of conversation and turn."""
    blank = F.lit(" ")
    rows = conversations.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    rows = rows.withColumn("__d", F.crc32(key.cast("binary")) % 20).filter("__d <> 0")
    text = F.when(F.col("__d") == 1, F.lit("")).when(F.col("__d") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    role = F.when(F.col("__d") == 4, F.lit("user")).otherwise(F.col("role"))
    times = F.when(F.col("__d") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("__i")).drop("__i")


def conversation_digest(conversations: DataFrame, **sizes: int) -> DataFrame:
    """One row for every conversation of the undamaged table; without any row left: zeros, no audit, the empty string's hash."""
    found = repair_summary(damaged(conversations), **sizes)
    every = conversations.select("conv_id").distinct()
    names = [f.name for f in _parse_datatype_string(DIGEST).fields]
    blank = {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    return (every.join(found.withColumnRenamed("conv_id", "__c"), _same("conv_id", "__c"), "left")
            .select("conv_id", *[F.coalesce(n, F.lit(blank.get(n, 0))).alias(n) for n in names]))

