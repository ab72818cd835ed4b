"""Least-cost repair of the turn structure of conversations by generalised LR parsing.

The grammar of role initials is given by productions; LR tables are built from it. A parse goes through a
conversation's rows in order and may keep, rerole or delete each row and insert turns anywhere. All parses
live at once in a graph-structured stack: stacks are chains of nodes (state, node below) that share their lower
parts, and two parses with an equal stack after the same rows merge into the one with the smaller
(cost, audit). Merging is exact: of two audits of one cost over the same rows none begins the other, since
what follows would be inserts, which cost something, so the smaller stays smaller whatever follows.

Any stack of this grammar can take over the future of any other for 5 more at most: two inserts, or one insert
and the deletion of a system row that the other keeps. Parses dearer than the cheapest by more are given up, so
none is lost, and edits that all parses share are settled at once: a conversation of any length streams through
a task, which holds the rows since the last settled one.
"""

from __future__ import annotations

import hashlib
import os
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: (left side, right side); u, a and s are initials of roles
GRAMMAR = (
    ("chat", ()),
    ("chat", ("pairs",)),
    ("pairs", ("head", "u", "a")),
    ("pairs", ("pairs", "u", "a")),
    ("head", ()),
    ("head", ("s",)),
)
NAMES = {"u": "user", "a": "assistant"}
LEGAL = frozenset(("su", "ua", "au"))
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: what taking over another parse's future can cost at most under GRAMMAR
SLACK = 5
#: rows between two looks at what is settled
SETTLE = 64
SPACE = " \t\n\v\f\r"
END = "$"


class Tables:
    """LR(0) states of a grammar with reductions on the symbols that may follow; a cell may hold several actions."""

    def __init__(self, grammar=GRAMMAR):
        self.rules = (("", (grammar[0][0],)), *grammar)
        self.heads = {left for left, _ in grammar}
        follow = self._follow()
        self.states = [self._closed({(0, 0)})]
        self.shifts: list[dict[str, int]] = []
        self.reductions: list[list[tuple[str, int, frozenset]]] = []
        for state in self.states:  # grows while it is read
            to: dict[str, set] = {}
            done = []
            for rule, dot in sorted(state):
                left, right = self.rules[rule]
                if dot < len(right):
                    to.setdefault(right[dot], set()).add((rule, dot + 1))
                else:
                    done.append((left, len(right), frozenset(follow[left])))
            steps = {}
            for symbol, kernel in to.items():
                target = self._closed(kernel)
                if target not in self.states:
                    self.states.append(target)
                steps[symbol] = self.states.index(target)
            self.shifts.append(steps)
            self.reductions.append(done)

    def _closed(self, items: set) -> frozenset:
        items = set(items)
        todo = list(items)
        while todo:
            rule, dot = todo.pop()
            right = self.rules[rule][1]
            new = {(k, 0) for k, (left, _) in enumerate(self.rules) if dot < len(right) and left == right[dot]} - items
            items |= new
            todo += new
        return frozenset(items)

    def _follow(self) -> dict[str, set]:
        empty: set = set()
        first = {h: set() for h in self.heads}
        follow = {h: set() for h in self.heads} | {"": {END}}

        def starts(symbols) -> tuple[set, bool]:
            out: set = set()
            for x in symbols:
                out |= first.get(x, {x})
                if x not in empty:
                    return out, False
            return out, True

        before = None
        while before != (now := (len(empty), sum(map(len, first.values())), sum(map(len, follow.values())))):
            before = now
            for left, right in self.rules:
                begin, all_empty = starts(right)
                if left:
                    first[left] |= begin
                    if all_empty:
                        empty.add(left)
                for k, x in enumerate(right):
                    if x in self.heads:
                        rest, vanishes = starts(right[k + 1 :])
                        follow[x] |= rest | (follow[left] if vanishes else set())
        return follow


class Stacks:
    """Nodes of the graph-structured stack. Equal stacks are one node; moves are remembered."""

    def __init__(self, tables: Tables):
        self.tables = tables
        self.nodes: list[tuple[int, int]] = [(0, -1)]
        self.known = {(0, -1): 0}
        self.moves: dict[tuple[int, str], tuple[int, ...]] = {}

    def _node(self, state: int, below: int) -> int:
        if (state, below) not in self.known:
            self.known[state, below] = len(self.nodes)
            self.nodes.append((state, below))
        return self.known[state, below]

    def _reduced(self, node: int, ahead: str) -> list[int]:
        """The node and all that reductions with this symbol ahead make of it."""
        seen = [node]
        for top in seen:
            for left, n, on in self.tables.reductions[self.nodes[top][0]]:
                if ahead not in on or not left:
                    continue
                below = top
                for _ in range(n):
                    below = self.nodes[below][1]
                new = self._node(self.tables.shifts[self.nodes[below][0]][left], below)
                if new not in seen:
                    seen.append(new)
        return seen

    def after(self, node: int, symbol: str) -> tuple[int, ...]:
        """The stacks after reading symbol."""
        got = self.moves.get((node, symbol))
        if got is None:
            tops = [(t, self.tables.shifts[self.nodes[t][0]].get(symbol)) for t in self._reduced(node, symbol)]
            got = self.moves[node, symbol] = tuple(self._node(s, t) for t, s in tops if s is not None)
        return got

    def accepts(self, node: int) -> bool:
        return any(not left for t in self._reduced(node, END) for left, _, _ in self.tables.reductions[self.nodes[t][0]])


class Repair:
    """One conversation, row by row. ``add`` and ``finish`` give the edits settled so far, as
    (edit, role, text, row): row is what ``add`` was given, None for an insert."""

    def __init__(self, stacks: Stacks, slack: int = SLACK):
        self.stacks, self.slack = stacks, slack
        self.live: dict[int, tuple[int, str, str]] = {0: (0, "", "")}  # cost, edits, symbols of the edits
        self.rows: deque = deque()
        self.since = 0

    def _offer(self, to: dict, node: int, cost: int, edits: str, symbols: str) -> bool:
        old = to.get(node)
        if old is None or (cost, edits) < old[:2]:
            to[node] = (cost, edits, symbols)
            return True
        return False

    def _with_inserts(self) -> dict:
        live, todo = dict(self.live), list(self.live)
        limit = min(x[0] for x in live.values()) + self.slack
        for node in todo:  # grows while it is read
            cost, edits, symbols = live[node]
            if cost + INSERT <= limit:
                for s in NAMES:
                    for top in self.stacks.after(node, s):
                        if self._offer(live, top, cost + INSERT, edits + "I", symbols + s):
                            todo.append(top)
        return live

    def add(self, role: str, text: str, fault: str | None, row=None) -> list[tuple]:
        out: dict = {}
        self.rows.append((role, text, row))
        for node, (cost, edits, symbols) in self._with_inserts().items():
            self._offer(out, node, cost + DELETE, edits + "D", symbols + ".")
            if fault in ("blank", "duplicate"):
                continue
            cost += TRUNCATED if fault == "truncated" else 0
            for top in self.stacks.after(node, role[:1]):
                self._offer(out, top, cost, edits + "K", symbols + ".")
            for s in NAMES:
                for top in self.stacks.after(node, s):
                    self._offer(out, top, cost + REROLE, edits + "R", symbols + s)
        limit = min(x[0] for x in out.values()) + self.slack
        self.live = {k: x for k, x in out.items() if x[0] <= limit}
        self.since += 1
        return self._settle() if self.since >= SETTLE else []

    def _settle(self) -> list[tuple]:
        self.since = 0
        edits = os.path.commonprefix([x[1] for x in self.live.values()])
        n = len(os.path.commonprefix([x[2][: len(edits)] for x in self.live.values()]))
        symbols = next(iter(self.live.values()))[2]
        out = self._done(edits[:n], symbols[:n])
        self.live = {k: (c, e[n:], s[n:]) for k, (c, e, s) in self.live.items()}
        return out

    def _done(self, edits: str, symbols: str) -> list[tuple]:
        out = []
        for edit, s in zip(edits, symbols, strict=True):
            if edit == "I":
                out.append((edit, NAMES[s], "", None))
            else:
                role, text, row = self.rows.popleft()
                out.append((edit, NAMES[s] if edit == "R" else role, text, row))
        return out

    def finish(self) -> tuple[list[tuple], int]:
        """The remaining edits, and the cost of all."""
        cost, edits, symbols = min(x for node, x in self._with_inserts().items() if self.stacks.accepts(node))
        return self._done(edits, symbols), cost


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, there): rows harmed by a rule on crc32 of ``conv_id:turn``, as a test of repair.

    Modulo 20: 0 drops the row (``there`` is false), 1 empties the text, 2 removes its ``[.!?]``, 3 repeats the row,
    4 sets the role user. A null counts as one space in the rule and as role or text; null ids and turns stay null.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat_ws(":", blank("conv_id"), blank("turn")).cast("binary")) % 20
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"), h.alias("_h"))
    text = F.when(F.col("_h").isin(0, 1), "").when(F.col("_h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_h") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.array_repeat(F.col("_h") != 0, F.when(F.col("_h") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("there"))


def with_faults(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text, there) with each row's first ``fault``, by conversation and in its order.

    blank: nothing but white space. duplicate: role and text of an earlier row. truncated: the last character that
    is no white space is none of ``.!?``. The order is by turn (nulls first), then role and text, so that equal rows
    are neighbours. One shuffle deals out conversations; all else is sorting inside the tasks.
    """
    end: Column = F.rtrim("text", F.lit(SPACE))
    repeat = F.row_number().over(Window.partitionBy("conv_id", "there", "role", "text").orderBy(F.asc_nulls_first("turn"))) > 1
    fault = F.when(end == "", "blank").when(repeat, "duplicate").when(~F.right(end, F.lit(1)).isin(".", "!", "?"), "truncated")
    marked = rows.repartition("conv_id").withColumn("fault", fault)
    return marked.sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text").select("conv_id", "turn", "role", "text", "there", "fault")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, row or None) for sorted batches; None ends a conversation."""
    current, started = None, False
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            for row in zip(*(c.to_pylist() for c in batch.slice(at, 500).columns), strict=True):
                if started and row[0] != current:
                    yield current, None
                current, started = row[0], True
                yield current, row
    if started:
        yield current, None


class _Totals:
    """Counts over a conversation's rows as they come."""

    def __init__(self):
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.low = self.high = self.last = self.before = None
        self.distinct = self.illegal = 0

    def add(self, turn, role, fault) -> None:
        if fault:
            self.faults[fault] += 1
        if turn is not None and turn != self.last:  # sorted, so equal turns are neighbours
            self.distinct += 1
            self.low = turn if self.low is None else self.low
            self.high = self.last = turn
        if self.before is not None:
            self.illegal += self.before + role[:1] not in LEGAL
        self.before = role[:1]

    @property
    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.distinct


REPAIRED = "conv_id long, turn long, fault string, edit string, role string, text string"
DIGESTS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _arrow(rows: list[tuple], schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def repair_turns(rows: DataFrame) -> DataFrame:
    """Every edit of the cheapest repair: (conv_id, turn, fault, edit, role, text), in order inside a conversation.

    ``rows`` is (conv_id, turn, role, text, there) with role and text not null; rows not ``there`` count as absent.
    Keep costs 0, Rerole (to user or assistant) 2, Delete 3, Insert (of an empty user or assistant turn) 2, a
    truncated row that stays 1; blank and duplicate rows must go. Among the cheapest repairs the one with the
    smallest string of edit initials is taken. An inserted row has neither turn nor fault. A conversation without
    rows gives none; rows with a null id form one conversation; other columns are ignored.
    """
    schema = _schema(REPAIRED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stacks, out = Stacks(Tables()), []
        repair = Repair(stacks)
        for conv, row in _conversations(batches):
            if row is None:
                edits, repair = repair.finish()[0], Repair(stacks)
            else:
                edits = repair.add(row[2], row[3], row[5], row) if row[4] else []
            out += [(conv, r[1] if r else None, r[5] if r else None, edit, role, text) for edit, role, text, r in edits]
            if len(out) >= 1000:
                yield _arrow(out, schema)
                out = []
        if out:
            yield _arrow(out, schema)

    return with_faults(rows).mapInArrow(run, REPAIRED)


def repair_digests(rows: DataFrame) -> DataFrame:
    """One row per conversation with its counts of faults, and digests of what ``repair_turns`` gives for it.

    ``gaps`` are the missing turn numbers between the least and the greatest, ``illegal`` the neighbours whose role
    initials are not su, ua or au. A conversation of which no row is there has zeros, an empty audit and the digest
    of the empty string.
    """
    schema = _schema(DIGESTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stacks, out = Stacks(Tables()), []

        def fresh():
            return Repair(stacks), _Totals(), [], hashlib.sha256(), []

        repair, totals, audit, sha, kept = fresh()

        def written(edits: list[tuple]) -> None:
            audit.append("".join(e[0] for e in edits))
            for edit, role, text, _ in edits:
                if edit != "D":
                    sha.update(f"{chr(10) if kept else ''}{role}:{text}".encode())
                    kept[:] = [True]

        for conv, row in _conversations(batches):
            if row is None:
                edits, cost = repair.finish()
                written(edits)
                out.append((conv, totals.gaps, *totals.faults.values(), totals.illegal, cost, "".join(audit), sha.hexdigest()))
                repair, totals, audit, sha, kept = fresh()
                if len(out) >= 1000:
                    yield _arrow(out, schema)
                    out = []
            elif row[4]:
                totals.add(row[1], row[2], row[5])
                written(repair.add(row[2], row[3], row[5], None))
        if out:
            yield _arrow(out, schema)

    return with_faults(rows).mapInArrow(run, DIGESTS)
