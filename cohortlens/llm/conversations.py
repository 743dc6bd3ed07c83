"""Repair of conversations: generalised LR parsing of their roles with weighted edits.

The legal sequences of roles are a grammar, from which the usual LR(0) states with one symbol of lookahead are
made.  A conversation is parsed with a graph-structured stack: stacks are chains of nodes that share what lies below,
and after every turn the parser holds one stack per top state.  A turn may be kept, given another role or deleted, and a
turn may be inserted anywhere; every edit has a weight.  Stacks that come to equal tops are merged: the least
``(cost, audit)`` stays, ``audit`` being the initials of the edits.  Audits of equal cost that have read the same turns
are never the beginning of one another (they would differ by insertions, which cost), so that the least one stays
the least whatever follows.

Turns are sorted by range and cut into segments of bounded length.  A segment is parsed once from every top its
predecessor may have ended in, which gives a small table from tops to tops; the tables of a conversation are then
folded in order.  So a conversation may hold any share of all rows: its turns are parsed by many tasks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.work import written

#: Turns that are parsed at once.
SEGMENT = 4096

END = "$"
_FINE, _BLANK, _DUPLICATE, _TRUNCATED = range(4)
_SPACE = r"\x20\x09-\x0D"


@dataclass(frozen=True)
class Grammar:
    """Rules ``(left, right)``; the first one's left side is the start symbol.  Symbols without a rule are
    terminals: initials of roles."""

    rules: tuple[tuple[str, tuple[str, ...]], ...]


#: An optional system turn, then pairs of a user's and an assistant's turn, or nothing at all: (s?(ua)+)?
ROLES = Grammar(
    (
        ("conversation", ()),
        ("conversation", ("head", "pairs")),
        ("head", ()),
        ("head", ("s",)),
        ("pairs", ("pair",)),
        ("pairs", ("pairs", "pair")),
        ("pair", ("u", "a")),
    )
)

#: Roles that a turn may be given, by their initials.
GIVEN = {"u": "user", "a": "assistant"}


@dataclass(frozen=True)
class Weights:
    """Cost of each edit; ``truncated`` is added for a truncated turn that is not deleted."""

    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


class Node:
    """Top of a stack: a parser state and the node below.  Equal stacks are one node."""

    __slots__ = ("below", "state")

    def __init__(self, state: int, below: Node | None):
        self.state, self.below = state, below


class Parser:
    """States and tables of a grammar, and stacks over them."""

    def __init__(self, grammar: Grammar):
        start = grammar.rules[0][0]
        self.rules = [("", (start,)), *grammar.rules]
        self.names = {left for left, _ in grammar.rules}
        follow = self._follow(start)
        self.shifts: list[dict[str, int]] = []
        self.reduces: list[dict[str, list[int]]] = []
        states = {self._closure({(0, 0)}): 0}
        todo = list(states)
        for items in todo:
            moves: dict[str, set] = {}
            reduce: dict[str, list[int]] = {}
            for rule, dot in sorted(items):
                left, right = self.rules[rule]
                if dot < len(right):
                    moves.setdefault(right[dot], set()).add((rule, dot + 1))
                else:
                    for x in follow[left]:
                        reduce.setdefault(x, []).append(rule)
            self.reduces.append(reduce)
            self.shifts.append({})
            for symbol, kernel in sorted(moves.items()):
                target = self._closure(kernel)
                if target not in states:
                    states[target] = len(states)
                    todo.append(target)
                self.shifts[states[items]][symbol] = states[target]
        self._nodes: dict[tuple, Node] = {}
        self._after: dict[tuple, list[Node]] = {}
        self.bottom = self._node(0, None)
        self.tops = self._tops()

    def _closure(self, items: Iterable[tuple[int, int]]) -> frozenset:
        found, todo = set(items), list(items)
        for rule, dot in todo:
            right = self.rules[rule][1]
            if dot < len(right):
                for k, (left, _) in enumerate(self.rules):
                    if left == right[dot] and (k, 0) not in found:
                        found.add((k, 0))
                        todo.append((k, 0))
        return frozenset(found)

    def _follow(self, start: str) -> dict[str, set[str]]:
        empty, first = set(), {n: set() for n in self.names}
        follow = {"": {END}, **{n: set() for n in self.names}}
        follow[start].add(END)

        def begins(symbols: tuple[str, ...]) -> tuple[set[str], bool]:
            found = set()
            for x in symbols:
                found |= first.get(x, {x})
                if x not in empty:
                    return found, False
            return found, True

        size = -1
        while size != (size := len(empty) + sum(map(len, [*first.values(), *follow.values()]))):
            for left, right in self.rules[1:]:
                found, whole = begins(right)
                first[left] |= found
                if whole:
                    empty.add(left)
                for k, x in enumerate(right):
                    if x in self.names:
                        found, whole = begins(right[k + 1 :])
                        follow[x] |= found | (follow[left] if whole else set())
        return follow

    def _node(self, state: int, below: Node | None) -> Node:
        key = state, below
        if key not in self._nodes:
            self._nodes[key] = Node(state, below)
        return self._nodes[key]

    def _reduced(self, node: Node, x: str) -> set[Node]:
        """All stacks that reductions before ``x`` lead to."""
        found, todo = {node}, [node]
        for top in todo:
            for rule in self.reduces[top.state].get(x, ()):
                left, right = self.rules[rule]
                base = top
                for _ in right:
                    base = base.below
                if left and (new := self._node(self.shifts[base.state][left], base)) not in found:
                    found.add(new)
                    todo.append(new)
        return found

    def after(self, node: Node, x: str) -> list[Node]:
        """The stacks after reading ``x``, one per top state."""
        key = node, x
        if key not in self._after:
            tops = {}
            for top in self._reduced(node, x):
                if x in self.shifts[top.state]:
                    tops.setdefault(self.shifts[top.state][x], self._node(self.shifts[top.state][x], top))
            self._after[key] = list(tops.values())
        return self._after[key]

    def accepts(self, node: Node) -> bool:
        return any(0 in self.reduces[top.state].get(END, ()) for top in self._reduced(node, END))

    def _tops(self) -> dict[int, Node]:
        """A stack for every top that reading can end in.  What may follow depends on the top alone."""
        terminals = sorted({x for _, right in self.rules for x in right} - self.names)
        found, todo = {0: self.bottom}, [self.bottom]
        for node in todo:
            for x in terminals:
                for new in self.after(node, x):
                    if new.state not in found:
                        found[new.state] = new
                        todo.append(new)
        return found


@cache
def parser(grammar: Grammar = ROLES) -> Parser:
    return Parser(grammar)


#: (cost, audit, steps): ``steps`` has one character per edit, the initial of the turn's role or "-" if deleted.
Edits = tuple[int, str, str]


class Repairer:
    """The cheapest edits of turns, by merging stacks with equal tops."""

    def __init__(self, grammar: Grammar = ROLES, weights: Weights | None = None):
        self.parser, self.weights = parser(grammar), weights or Weights()

    def _inserted(self, stacks: dict[int, tuple[Edits, Node]]) -> dict[int, tuple[Edits, Node]]:
        """The best stack per top, with turns inserted before the next one."""
        cost = self.weights.insert
        todo = [(edits, state, id(node), node) for state, (edits, node) in stacks.items()]
        heapq.heapify(todo)
        found: dict[int, tuple[Edits, Node]] = {}
        while todo:
            edits, state, _, node = heapq.heappop(todo)
            if state not in found:
                found[state] = edits, node
                for x in GIVEN:
                    for new in self.parser.after(node, x):
                        if new.state not in found:
                            more = edits[0] + cost, edits[1] + "I", edits[2] + x
                            heapq.heappush(todo, (more, new.state, id(new), new))
        return found

    def step(self, stacks: dict[int, tuple[Edits, Node]], initial: str, truncated: bool) -> dict[int, tuple[Edits, Node]]:
        """The stacks after one more turn that need not be deleted."""
        w = self.weights
        best: dict[int, tuple[Edits, Node]] = {}

        def offer(edits: Edits, node: Node) -> None:
            if node.state not in best or edits < best[node.state][0]:
                best[node.state] = edits, node

        extra = w.truncated if truncated else 0
        for (cost, audit, steps), node in self._inserted(stacks).values():
            offer((cost + w.delete, audit + "D", steps + "-"), node)
            for new in self.parser.after(node, initial):
                offer((cost + extra, audit + "K", steps + initial), new)
            for x in GIVEN:
                for new in self.parser.after(node, x):
                    offer((cost + w.rerole + extra, audit + "R", steps + x), new)
        return best

    def table(self, start: int, turns: list[tuple[str, int, int]]) -> dict[int, Edits]:
        """From top ``start``, the best edits per top after ``turns``: ``(initial, kind, copies)``.

        Copies beyond the first one of a turn are duplicates.
        """
        stacks = {start: ((0, "", ""), self.parser.tops[start])}
        for initial, kind, copies in turns:
            gone = copies if kind in (_BLANK, _DUPLICATE) else copies - 1
            if gone < copies:
                stacks = self.step(stacks, initial, kind == _TRUNCATED)
            if gone:
                # Deleting changes no stack: an insertion before it may as well come later, and "D" is less than "I".
                stacks = {
                    s: ((c + gone * self.weights.delete, a + "D" * gone, x + "-" * gone), n)
                    for s, ((c, a, x), n) in stacks.items()
                }
        return {state: edits for state, (edits, _) in stacks.items()}

    def finished(self, top: int) -> Edits:
        """What is still to insert before the end."""
        stacks = {top: ((0, "", ""), self.parser.tops[top])}
        return min(edits for edits, node in self._inserted(stacks).values() if self.parser.accepts(node))


class _Fold:
    """The tables of one conversation's segments, composed in order."""

    def __init__(self, repairer: Repairer):
        self.repairer = repairer
        # Per top: cost, and a chain (chain before, segment, its first top, its last top, audit) that shares what lies before.
        self.best: dict[int, tuple[int, tuple | None]] = {0: (0, None)}

    @staticmethod
    def _less(one: tuple | None, other: tuple | None) -> bool:
        """Whether one chain's audit is the smaller one, read from where the two part; they are equally long."""
        mine, others = [], []
        while one is not other:
            mine.append(one[4])
            others.append(other[4])
            one, other = one[0], other[0]
        return "".join(reversed(mine)) < "".join(reversed(others))

    def add(self, segment: int, table: list[dict]) -> None:
        found: dict[int, tuple[int, tuple | None]] = {}
        for entry in table:
            if entry["start"] in self.best:
                cost, chain = self.best[entry["start"]]
                new = cost + entry["cost"], (chain, segment, entry["start"], entry["end"], entry["audit"])
                old = found.get(entry["end"])
                if old is None or new[0] < old[0] or (new[0] == old[0] and self._less(new[1], old[1])):
                    found[entry["end"]] = new
        self.best = found

    def result(self) -> tuple[int, str, list[dict]]:
        """Cost, audit, and the tops chosen per segment; the turns to append come as segment None."""
        ends = []
        for top, (cost, chain) in self.best.items():
            more, audit, steps = self.repairer.finished(top)
            ends.append((cost + more, (chain, None, top, steps, audit)))
        cost, chain = ends[0]
        for other in ends[1:]:
            if other[0] < cost or (other[0] == cost and self._less(other[1], chain)):
                cost, chain = other
        audits, path, more = [chain[4]], [], chain[3]
        while (chain := chain[0]) is not None:
            audits.append(chain[4])
            path.append({"segment": chain[1], "start": chain[2], "end": chain[3], "more": more})
            more = None
        return cost, "".join(reversed(audits)), path[::-1]


def is_blank(text: Column) -> Column:
    return ~text.rlike(f"[^{_SPACE}]")


def is_truncated(text: Column) -> Column:
    """Whether the last character that is no white space ends no sentence."""
    return ~text.rlike(rf"[.!?][{_SPACE}]*\z")


def _marked(df: DataFrame) -> DataFrame:
    """Equal turns of one number as one row, with their faults; texts are left behind."""
    kind = F.when(is_blank(F.col("text")), _BLANK).when(is_truncated(F.col("text")), _TRUNCATED).otherwise(_FINE)
    rows = df.select("conv_id", "turn", "role", F.unhex(F.md5("text")).alias("digest"), kind.alias("kind"))
    rows = rows.groupBy("conv_id", "turn", "role", "digest", "kind").agg(F.count("*").alias("copies"))
    rows = written(rows, "turns")
    # The number of an equal turn's first occurrence; stored, so that the join may split a turn that is said very often.
    place = F.struct(F.col("turn").isNotNull().alias("has"), "turn")
    first = rows.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"))
    first = written(first.agg(F.min(place).alias("first")), "first-turns")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    again = ~F.col("first.turn").eqNullSafe(F.col("turn")) & (F.col("kind") != _BLANK)
    return rows.join(first, same).select(
        "conv_id", "turn", "role", "digest", "copies", F.when(again, _DUPLICATE).otherwise(F.col("kind")).alias("kind")
    )


_TABLE = "array<struct<start int, end int, cost long, audit string, steps string>>"
_COUNTS = ["blank", "duplicate", "truncated", "illegal", "distinct"]


def _counted(rows: list[dict]) -> dict:
    """Faults of a segment, and what is needed to count across its borders."""
    n = dict.fromkeys(_COUNTS, 0)
    last = None
    turns = [r["turn"] for r in rows if r["turn"] is not None]
    for r in rows:
        copies, kind, initial = r["copies"], r["kind"], r["role"][:1]
        if kind == _BLANK:
            n["blank"] += copies
        elif kind == _DUPLICATE:
            n["duplicate"] += copies
        else:
            n["duplicate"] += copies - 1
            n["truncated"] += kind == _TRUNCATED
        n["illegal"] += copies - 1  # a turn next to its copy
        n["illegal"] += last is not None and last + initial not in ("su", "ua", "au")
        last = initial
    n["distinct"] = len(set(turns))
    ends = {"first_turn": turns[0], "last_turn": turns[-1]} if turns else {"first_turn": None, "last_turn": None}
    return {**n, **ends, "first_initial": rows[0]["role"][:1], "last_initial": rows[-1]["role"][:1]}


def _segments(marked: DataFrame, repairer: Repairer, size: int) -> DataFrame:
    """One row per segment: its turns, counts and table, numbered by ``segment`` in order."""
    order = ["conv_id", "turn", "role", "digest"]
    conv = dict(marked.dtypes)["conv_id"]
    ends = "first_turn long, last_turn long, first_initial string, last_initial string"
    counts = ", ".join(f"{c} long" for c in _COUNTS)
    schema = (
        f"conv_id {conv}, turns array<long>, roles array<string>, digests array<binary>, copies array<long>, "
        f"{counts}, {ends}, table {_TABLE}"
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[dict] = []
        known_start = False  # the task's first conversation may have begun in another task
        kind = None
        made: list[dict] = []

        def segment(known: bool) -> dict:
            turns = [(r["role"][:1], r["kind"], r["copies"]) for r in waiting]
            starts = [0] if known else sorted(repairer.parser.tops)
            table = [
                {"start": s, "end": e, "cost": c, "audit": a, "steps": x}
                for s in starts
                for e, (c, a, x) in sorted(repairer.table(s, turns).items())
            ]
            lists = {name: [r[one] for r in waiting] for name, one in
                     [("turns", "turn"), ("roles", "role"), ("digests", "digest"), ("copies", "copies")]}
            return {"conv_id": waiting[0]["conv_id"], **lists, **_counted(waiting), "table": table}

        def batch() -> pa.RecordBatch:
            table = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()),
                                        ("audit", pa.string()), ("steps", pa.string())]))
            fields = [("conv_id", kind), ("turns", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())),
                      ("digests", pa.list_(pa.binary())), ("copies", pa.list_(pa.int64()))]
            fields += [(c, pa.int64()) for c in [*_COUNTS, "first_turn", "last_turn"]]
            fields += [("first_initial", pa.string()), ("last_initial", pa.string()), ("table", table)]
            found = pa.RecordBatch.from_pylist(made, pa.schema(fields))
            made.clear()
            return found

        held = 0
        for arrived in batches:
            kind = arrived.schema.field("conv_id").type
            for row in arrived.to_pylist():
                other = waiting and row["conv_id"] != waiting[0]["conv_id"]
                if waiting and (other or len(waiting) >= size):
                    made.append(segment(known_start))
                    held += len(waiting)
                    # A segment cut within its conversation is followed from any top.
                    known_start = bool(other)
                    waiting.clear()
                    if held >= size:
                        yield batch()
                        held = 0
                waiting.append(row)
        if waiting:
            made.append(segment(known_start))
        if made:
            yield batch()

    sorted_ = marked.select(*order, "kind", "copies").repartitionByRange(*order).sortWithinPartitions(*order)
    cut_up = sorted_.mapInArrow(cut, schema)
    return written(cut_up.withColumn("segment", F.monotonically_increasing_id()), "segments")


_PATH = "array<struct<segment long, start int, end int, more string>>"


def _folded(segments: DataFrame, repairer: Repairer) -> DataFrame:
    """One row per conversation: counts, ``cost``, ``audit`` and the ``path`` through its segments' tables."""
    conv = dict(segments.dtypes)["conv_id"]
    counts = [c for c in _COUNTS if c != "distinct"]
    schema = f"conv_id {conv}, gaps long, {', '.join(f'{c} long' for c in counts)}, cost long, audit string, path {_PATH}"

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, state, total, last, made = None, None, {}, None, []

        def done() -> dict:
            cost, audit, path = state.result()
            gaps = 0
            if total["last_turn"] is not None:
                gaps = total["last_turn"] - total["first_turn"] + 1 - total["distinct"]
            return {"conv_id": last["conv_id"], "gaps": gaps, **{c: total[c] for c in counts},
                    "cost": cost, "audit": audit, "path": path}

        def batch() -> pa.RecordBatch:
            path = pa.list_(pa.struct([("segment", pa.int64()), ("start", pa.int32()), ("end", pa.int32()),
                                       ("more", pa.string())]))
            fields = [("conv_id", kind), *((c, pa.int64()) for c in ["gaps", *counts, "cost"])]
            found = pa.RecordBatch.from_pylist(made, pa.schema([*fields, ("audit", pa.string()), ("path", path)]))
            made.clear()
            return found

        for arrived in batches:
            kind = arrived.schema.field("conv_id").type
            for row in arrived.to_pylist():
                if last is None or row["conv_id"] != last["conv_id"]:
                    if last is not None:
                        made.append(done())
                    state, total = _Fold(repairer), dict(row)
                else:
                    total.update({c: total[c] + row[c] for c in _COUNTS})
                    total["illegal"] += last["last_initial"] + row["first_initial"] not in ("su", "ua", "au")
                    if row["first_turn"] is not None:
                        total["distinct"] -= row["first_turn"] == total["last_turn"]
                        total["last_turn"] = row["last_turn"]
                        if total["first_turn"] is None:
                            total["first_turn"] = row["first_turn"]
                state.add(row["segment"], row["table"])
                last = row
            if made:
                yield batch()
        if last is not None:
            made.append(done())
            yield batch()

    names = ["conv_id", "segment", *_COUNTS, "first_turn", "last_turn", "first_initial", "last_initial"]
    # The steps are as long as the audit and only needed for the table entry that is chosen.
    table = F.transform("table", lambda t: t.dropFields("steps")).alias("table")
    rows = segments.select(*names, table).repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    return written(rows.mapInArrow(fold, schema), "repairs")


def _edited(segments: DataFrame, folded: DataFrame) -> DataFrame:
    """One row per edit: ``segment`` and ``place`` tell the order within a conversation."""
    conv = dict(segments.dtypes)["conv_id"]
    path = folded.select(F.explode("path").alias("p")).select("p.*")
    chosen = F.filter("table", lambda t: (t["start"] == F.col("start")) & (t["end"] == F.col("end")))[0]
    rows = path.join(segments, "segment").select(
        "conv_id", "segment", "turns", "roles", "digests", "copies", "more",
        chosen["audit"].alias("audit"), chosen["steps"].alias("steps"),
    )

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.schema.field("conv_id").type
            fields = [("conv_id", kind), ("segment", pa.int64()), ("place", pa.int64()), ("turn", pa.int64()),
                      ("was", pa.string()), ("digest", pa.binary()), ("action", pa.string()), ("role", pa.string())]
            for s in batch.to_pylist():
                turns = (
                    (t, r, d)
                    for t, r, d, n in zip(s["turns"], s["roles"], s["digests"], s["copies"], strict=True)
                    for _ in range(n)
                )
                more = s["more"] or ""
                found = []
                for place, (action, x) in enumerate(
                    zip(s["audit"] + "I" * len(more), s["steps"] + more, strict=True)
                ):
                    turn, was, digest = (None, None, None) if action == "I" else next(turns)
                    role = None if action == "D" else was if action == "K" else GIVEN[x]
                    found.append((s["conv_id"], s["segment"], place, turn, was, digest, action, role))
                    if len(found) >= 10_000:
                        yield _batch(found, fields)
                        found = []
                if found:
                    yield _batch(found, fields)

    return rows.mapInArrow(
        edit,
        f"conv_id {conv}, segment long, place long, turn long, was string, digest binary, action string, role string",
    )


def _batch(rows: list[tuple], fields: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kind) for c, (_, kind) in zip(columns, fields, strict=True)], schema=pa.schema(fields)
    )


@dataclass(frozen=True)
class Repaired:
    """``report``: one row per conversation with ``gaps``, the faults ``blank``, ``duplicate``, ``truncated`` and
    ``illegal``, ``cost`` and ``audit``.  ``turns``: the repaired conversations, one row per turn, in the order of
    ``segment`` and ``place``, with the ``turn`` it comes from (null if inserted), ``action`` (K, R or I), ``role``, ``text``.
    """

    report: DataFrame
    turns: DataFrame


def repaired(
    df: DataFrame,
    weights: Weights | None = None,
    grammar: Grammar = ROLES,
    segment: int = SEGMENT,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> Repaired:
    """The cheapest edits that make the roles of every conversation legal, and the result.

    Turns are taken by their number, nulls first; those with one number by role and MD5 of the text.  A turn's first
    fault counts: blank, duplicate (role and text were there before), truncated.  Blank and duplicate turns are
    deleted.  Of the cheapest edits, those whose initials come first are taken.  Null roles and texts count as one
    space, a role without any character is never legal, null conversation ids are one conversation.  Other columns of
    ``df`` are not read.  An empty table gives empty results.
    """
    repairer = Repairer(grammar, weights)
    rows = df.select(
        F.col(conv).alias("conv_id"),
        F.col(turn).cast("bigint").alias("turn"),
        F.coalesce(F.col(role), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text), F.lit(" ")).alias("text"),
    )
    segments = _segments(_marked(rows), repairer, segment)
    folded = _folded(segments, repairer)
    edits = written(_edited(segments, folded).where("action <> 'D'"), "edits")
    places = edits.where("action <> 'I'").withColumnRenamed("conv_id", "c").withColumnRenamed("turn", "t")
    texts = rows.withColumn("d", F.unhex(F.md5("text"))).dropDuplicates(["conv_id", "turn", "role", "d"])
    texts = texts.withColumnRenamed("role", "r")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t"))
    same &= (F.col("r") == F.col("was")) & (F.col("d") == F.col("digest"))
    names = ["conv_id", "segment", "place", "turn", "action", "role", "text"]
    kept = places.join(texts, same).select(names)
    added = edits.where("action = 'I'").withColumn("text", F.lit("")).select(names)
    return Repaired(folded.drop("path"), kept.unionByName(added))


def digests(turns: DataFrame) -> DataFrame:
    """``conv_id`` and ``repaired_sha256``, the digest of its turns as ``role:text`` lines.

    A digest is made in the order of its input, so one task reads a conversation, but never holds it.
    """
    conv = dict(turns.dtypes)["conv_id"]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        names = ["conv_id", "repaired_sha256"]
        open_, current, kind = None, None, None
        for batch in batches:
            kind = batch.schema.field("conv_id").type
            done: list[tuple] = []
            for key, line in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if open_ is not None and key == current:
                    open_.update(b"\n")
                else:
                    if open_ is not None:
                        done.append((current, open_.hexdigest()))
                    open_, current = hashlib.sha256(), key
                open_.update(line.as_buffer())
            if done:
                yield _batch(done, [(names[0], kind), (names[1], pa.string())])
        if open_ is not None:
            yield _batch([(current, open_.hexdigest())], [(names[0], kind), (names[1], pa.string())])

    lines = turns.select("conv_id", F.concat("role", F.lit(":"), "text").alias("line"), "segment", "place")
    lines = lines.repartition("conv_id").sortWithinPartitions("conv_id", "segment", "place")
    return lines.select("conv_id", "line").mapInArrow(digest, f"conv_id {conv}, repaired_sha256 string")


def damaged(df: DataFrame) -> DataFrame:
    """``conversations`` with faults put in, by the check sum of each row's key: a fifth of some kind in twenty.

    Of remainder 0 a row is dropped, of 1 it loses its text, of 2 its sentence ends, of 3 it comes twice, of 4 its
    role becomes ``user``.  Nulls in the key, role and text count as one space.
    """
    space = F.lit(" ")
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")))
    by = F.crc32(key.cast("binary")) % 20
    text = F.coalesce("text", space)
    return (
        df.select("conv_id", "turn", F.coalesce("role", space).alias("role"), text.alias("text"), by.alias("by"))
        .where("by <> 0")
        .withColumn("copy", F.explode(F.when(F.col("by") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
        .select(
            "conv_id",
            "turn",
            F.when(F.col("by") == 4, "user").otherwise(F.col("role")).alias("role"),
            F.when(F.col("by") == 1, "").when(F.col("by") == 2, F.regexp_replace("text", "[.!?]", ""))
            .otherwise(F.col("text")).alias("text"),
        )
    )
