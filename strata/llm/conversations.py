"""Operator 12: repair of conversation structure with Four-Russians block tables.

A repaired conversation is empty or ``system? (user assistant)+``. Walking it needs four
states (nothing yet, and after a system, user or assistant row), so the cost of repairing the
rest of a conversation is a vector of four numbers. Less its least entry it is one of a few
dozen vectors, whatever the conversation. The tables hold, for each such vector and each block
of four row symbols, the vector before the block and what was taken off. A conversation's cost
is found from its last row to its first, a block a lookup; the edits are traced the other way:
each block is expanded from the vector behind it, and of the edits on a cheapest path the one
of the ASCII-least initial is taken, so ties have one answer.

Rows are sorted by a range partitioning, so a conversation may hold a third of all rows. One
that lies inside a task's range is repaired there. Of the others each run of up to ``CHUNK``
rows gives the four-by-four matrix of its costs; a sweep from a conversation's last run to
its first turns these into the vector behind each run, and a sweep forward traces run by run.
A task holds one run at a time, and of each conversation its audit, one letter an edit.

Cases: NULL roles and texts count as one blank, so such texts are blank rows; NULL ids are
one conversation; NULL turns come first; rows of one turn are ordered by role and then by a
hash of the text; repeated rows are duplicates of the first; a conversation without rows gives
zeros and empty results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from strata.llm._text import release
from strata.session import materialize

BLOCK = 4                                         # symbols of a table entry
CHUNK = 4096                                      # rows of a run
START, ENDS = 0, (0, 3)
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})     # a kept row's initial
NEED = (2, 2, 3, 2)                               # the state after a changed or new row
ROLE = {2: "user", 3: "assistant"}
SYMBOLS = 9                                       # to delete; initials s, u, a, other, each also truncated
FAR = 1 << 40                                     # more than any cost
SPACE = r"[^\x20\x09-\x0D]"
BLANK, REPEATED, CUT = 1, 2, 3                    # faults


def symbol(initial: str, fault: int) -> int:
    if fault in (BLANK, REPEATED):
        return 0
    at = "sua".find(initial) if initial else -1
    return 1 + 2 * (at if at >= 0 else 3) + (fault == CUT)


class Tables:
    """Transitions of normalised cost vectors, by symbol and by block of symbols."""

    def __init__(self, rerole: int = 1, delete: int = 2, insert: int = 5, truncated: int = 5, block: int = BLOCK):
        self.costs, self.block = (rerole, delete, insert, truncated), block
        self.vectors, self.ids = [], {}
        self.end = self._id(self._closed([0 if q in ENDS else FAR for q in range(4)]))[0]
        self.units = [self._id(self._closed([0 if q == j else FAR for q in range(4)])) for j in range(4)]
        step, off, at = [], [], 0
        while at < len(self.vectors):             # all vectors that any symbols can lead to
            moved = [self._id(self._before(self.vectors[at], s)) for s in range(SYMBOLS)]
            step.append([m[0] for m in moved])
            off.append([m[1] for m in moved])
            at += 1
        self.step, self.off = np.array(step), np.array(off, np.int64)
        table, cost = np.arange(at)[:, None], np.zeros((at, 1), np.int64)
        for _ in range(block):                    # one more symbol in front
            cost = (cost[:, None, :] + self.off[table].transpose(0, 2, 1)).reshape(at, -1)
            table = self.step[table].transpose(0, 2, 1).reshape(at, -1)
        self.table, self.cost = table, cost
        self.choices = [[[self._choice(v, s, q) for q in range(4)] for s in range(SYMBOLS)] for v in self.vectors]

    def _id(self, vector) -> tuple[int, int]:
        least = min(vector)
        key = tuple(FAR if c >= FAR else c - least for c in vector)
        if key not in self.ids:
            self.ids[key] = len(self.vectors)
            self.vectors.append(key)
        return self.ids[key], least

    def _closed(self, vector) -> list:
        """With rows put in wherever that is cheaper."""
        for _ in range(4):
            vector = [min(c, self.costs[2] + vector[NEED[q]]) for q, c in enumerate(vector)]
        return vector

    def _options(self, v, s: int, q: int):
        """(initial, cost, state) of the edits of a row of symbol s, other than one before it."""
        rerole, delete, _, truncated = self.costs
        yield "D", delete + v[q], q
        if s:
            initial, more = "sua-"[(s - 1) // 2], truncated * ((s - 1) % 2)
            if initial in NEXT[q]:
                yield "K", more + v[NEXT[q][initial]], NEXT[q][initial]
            yield "R", more + rerole + v[NEED[q]], NEED[q]

    def _before(self, v, s: int) -> list:
        return self._closed([min(cost for _, cost, _ in self._options(v, s, q)) for q in range(4)])

    def _choice(self, v, s: int, q: int) -> tuple[str, int]:
        """The ASCII-least initial on a cheapest path, and the state after it."""
        costs = self._before(v, s)
        edits = [*self._options(v, s, q), ("I", self.costs[2] + costs[NEED[q]], NEED[q])]
        return min((initial, state) for initial, cost, state in edits if cost == costs[q])

    def _codes(self, symbols: list) -> list:
        return [sum(s * SYMBOLS ** (self.block - 1 - k) for k, s in enumerate(symbols[i:i + self.block]))
                for i in range(0, len(symbols) - self.block + 1, self.block)]

    def behind(self, symbols: list, vector: int) -> tuple[list, int]:
        """The vector behind each block (the short one last), the first of all, and the cost."""
        whole = len(symbols) // self.block * self.block
        found, total = [vector], 0
        for s in reversed(symbols[whole:]):
            total += int(self.off[vector, s])
            vector = int(self.step[vector, s])
        found.append(vector)
        for code in reversed(self._codes(symbols)):
            total += int(self.cost[vector, code])
            vector = int(self.table[vector, code])
            found.append(vector)
        return found[::-1], total

    def matrix(self, symbols: list) -> list:
        """Costs from each state before the symbols to each state behind them."""
        columns = []
        for unit, least in self.units:
            found, total = self.behind(symbols, unit)
            columns.append([min(FAR, total + least + c) for c in self.vectors[found[0]]])
        return [columns[j][q] for q in range(4) for j in range(4)]

    def trace(self, symbols: list, vector: int, state: int) -> Iterator[tuple[str, int]]:
        """(initial, state after it) of the edits, given the vector behind the symbols."""
        behind, _ = self.behind(symbols, vector)
        whole = len(symbols) // self.block * self.block
        cuts = [*range(0, whole + 1, self.block), len(symbols)]
        for b, (i, j) in enumerate(zip(cuts, cuts[1:])):
            inner = [behind[b + 1]]
            for s in reversed(symbols[i + 1:j]):
                inner.append(int(self.step[inner[-1], s]))
            for s, v in zip(symbols[i:j], reversed(inner)):
                initial = "I"
                while initial == "I":
                    initial, state = self.choices[v][s][state]
                    yield initial, state

    def finish(self, state: int) -> Iterator[tuple[str, int]]:
        while state not in ENDS:
            state = NEED[state]
            yield "I", state


class Writer:
    """The edits of one conversation: its audit and the digest of its repaired rows."""

    def __init__(self):
        self.state, self.audit, self.hash, self.any = START, [], hashlib.sha256(), False

    def put(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.any else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
        self.any = True

    def run(self, t: Tables, rows: list, vector: int) -> None:
        """``rows`` are (symbol, role, text)."""
        at = iter(rows)
        for initial, self.state in t.trace([r[0] for r in rows], vector, self.state):
            self.audit.append(initial)
            if initial == "I":
                self.put(ROLE[self.state], "")
                continue
            _, role, text = next(at)
            if initial != "D":
                self.put(role if initial == "K" else ROLE[self.state], text)

    def close(self, t: Tables) -> tuple[str, str]:
        for initial, self.state in t.finish(self.state):
            self.audit.append(initial)
            self.put(ROLE[self.state], "")
        return "".join(self.audit), self.hash.hexdigest()


class Counts:
    """What is counted over consecutive rows; counts of neighbouring runs combine."""

    LEGAL = {"su", "ua", "au"}
    FIELDS = 9

    def __init__(self, values=None):
        self.n = self.blank = self.repeated = self.cut = self.illegal = self.turns = 0
        self.least = self.most = None
        self.first = self.last = ""
        if values:
            (self.n, self.blank, self.repeated, self.cut, self.illegal, self.turns, self.least, self.most,
             ends) = values
            self.first, self.last = "-sua"[ends // 4].strip("-") or "-", "-sua"[ends % 4].strip("-") or "-"

    def add(self, fault: int, initial: str, turn) -> None:
        self.blank += fault == BLANK
        self.repeated += fault == REPEATED
        self.cut += fault == CUT
        initial = initial if initial in ("s", "u", "a") else "-"
        if self.n:
            self.illegal += self.last + initial not in self.LEGAL
        else:
            self.first = initial
        self.last, self.n = initial, self.n + 1
        if turn is not None:
            self.turns += turn != self.most
            self.least = turn if self.least is None else self.least
            self.most = turn

    def follow(self, other: Counts) -> None:
        """Takes in the counts of the rows that come right after."""
        if not other.n or not self.n:
            for name, value in vars(other).items() if other.n else ():
                setattr(self, name, value)
            return
        self.illegal += other.illegal + (self.last + other.first not in self.LEGAL)
        for name in ("n", "blank", "repeated", "cut"):
            setattr(self, name, getattr(self, name) + getattr(other, name))
        self.turns += other.turns - (self.most is not None and self.most == other.least)
        self.least = other.least if self.least is None else self.least
        self.most = self.most if other.most is None else other.most
        self.last = other.last

    def values(self) -> list:
        ends = "-sua".index(self.first or "-") * 4 + "-sua".index(self.last or "-")
        return [self.n, self.blank, self.repeated, self.cut, self.illegal, self.turns, self.least, self.most, ends]

    def report(self) -> list:
        gaps = self.most - self.least + 1 - self.turns if self.least is not None else 0
        return [gaps, self.blank, self.repeated, self.cut, self.illegal]


#: What the sweeps write: finished conversations, runs, the rows of runs, and totals.
REPORT, RUN, ROW, VECTOR = range(4)
NAMES = ["kind", "c", "part", "k", "i", "numbers", "role", "text"]


def _batch(rows: list, c_type: pa.DataType) -> pa.RecordBatch:
    types = [pa.int32(), c_type, pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.string(), pa.string()]
    columns = zip(*rows) if rows else [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types)], names=NAMES)


class _Out:
    """Output rows, given out in batches of bounded size."""

    def __init__(self, c_type):
        self.c_type, self.rows, self.size = c_type, [], 0

    def put(self, *row) -> None:
        self.rows.append(row)
        self.size += 100 + len(row[-1] or "") + len(row[-2] or "")

    def full(self, most: int = 1 << 20):
        if self.size >= most or not most:
            rows, self.rows, self.size = self.rows, [], 0
            yield _batch(rows, self.c_type)


def _sweep(costs: tuple, chunk: int):
    """Sorted rows to finished conversations, and to runs where one may go on elsewhere."""
    def read(batches: Iterator[pa.RecordBatch]):
        t, part, out = Tables(*costs), TaskContext.get().partitionId(), None
        now, first, k, begun, rows, counts = None, True, 0, False, [], Counts()

        def flush():
            nonlocal k, begun, rows, counts
            if rows or not begun:
                out.put(RUN, now[0], part, k, None, counts.values() + t.matrix([r[0] for r in rows]), None, None)
                for i, (s, role, text) in enumerate(rows):
                    out.put(ROW, now[0], part, k, i, [s], role, text)
            k, begun, rows, counts = k + 1, True, [], Counts()

        def finish():
            found, total = t.behind([r[0] for r in rows], t.end)
            writer = Writer()
            writer.run(t, rows, t.end)
            cost = total + t.vectors[found[0]][START]
            out.put(REPORT, now[0], None, None, None, [*counts.report(), cost], *writer.close(t))

        for batch in batches:
            out = out or _Out(batch.schema.field("c").type)
            columns = [batch.column(x).to_pylist() for x in ("c", "copies", "fault", "turn", "role", "text")]
            for c, copies, fault, turn, role, text in zip(*columns):
                if now != (c,):
                    if now is not None:
                        flush() if first or begun else finish()
                        first = False
                        yield from out.full()
                    now, begun, rows, counts = (c,), False, [], Counts()
                for copy in range(copies):
                    what = fault if not copy or fault == BLANK else REPEATED
                    counts.add(what, role[:1], turn)
                    rows.append((symbol(role[:1], what), role, "" if what in (BLANK, REPEATED) else text))
                    if len(rows) == chunk:
                        flush()
                        yield from out.full()
        if now is not None:
            flush()
            yield from out.full(0)
        release()
    return read


def _back(costs: tuple):
    """Runs, from a conversation's last to its first: the vector behind each, and the totals."""
    def read(batches):
        t, out, now = Tables(*costs), None, None
        behind, base, counts = t.end, 0, Counts()

        def total():
            out.put(REPORT, now[0], None, None, None, [*counts.report(), base + t.vectors[behind][START]], None, None)

        for batch in batches:
            out = out or _Out(batch.schema.field("c").type)
            for c, part, k, numbers in zip(*(batch.column(x).to_pylist() for x in ("c", "part", "k", "numbers"))):
                if now != (c,):
                    if now is not None:
                        total()
                    now, behind, base, counts = (c,), t.end, 0, Counts()
                out.put(VECTOR, c, part, k, None, [behind], None, None)
                m, v = numbers[Counts.FIELDS:], t.vectors[behind]
                behind, less = t._id([min(FAR, min(m[4 * q + j] + v[j] for j in range(4))) for q in range(4)])
                base += less
                mine = Counts(numbers[:Counts.FIELDS])
                mine.follow(counts)
                counts = mine
                yield from out.full()
        if now is not None:
            total()
            yield from out.full(0)
    return read


def _forth(costs: tuple):
    """The rows of runs in order, with the vector behind their run: audits and digests."""
    def read(batches):
        t, out, now, run, rows, vector, writer = Tables(*costs), None, None, None, [], None, None

        def close():
            out.put(REPORT, now[0], None, None, None, None, *writer.close(t))

        for batch in batches:
            out = out or _Out(batch.schema.field("c").type)
            names = ("c", "part", "k", "behind", "numbers", "role", "text")
            for c, part, k, behind, numbers, role, text in zip(*(batch.column(x).to_pylist() for x in names)):
                if run != (c, part, k):
                    if run is not None:
                        writer.run(t, rows, vector)
                    if now != (c,):
                        if now is not None:
                            close()
                        now, writer = (c,), Writer()
                    run, rows, vector = (c, part, k), [], behind
                    yield from out.full()
                rows.append((numbers[0], role, text))
        if now is not None:
            writer.run(t, rows, vector)
            close()
            yield from out.full(0)
        release()
    return read


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           copies: Column | None = None, rerole: int = 1, delete: int = 2, insert: int = 5, truncated: int = 5,
           chunk: int = CHUNK) -> DataFrame:
    """One row a conversation: its id, ``gaps`` (turns missing between the least and the most),
    ``blank``, ``duplicate`` and ``truncated`` rows (a row counts for its first fault),
    ``illegal`` neighbours, the ``cost`` of the cheapest repair, its ``audit`` (initials of
    Keep, Rerole, Delete and Insert) and the SHA-256 of the repaired rows ``role:text``.

    ``copies`` says how often a row counts; with 0 it only names its conversation."""
    costs = (rerole, delete, insert, truncated)
    col = lambda name: F.col(f"`{name}`")                                           # noqa: E731
    blank = lambda x: F.coalesce(x.cast("string"), F.lit(" "))                      # noqa: E731
    n = F.lit(1) if copies is None else copies
    given = rows.select(col(conv).alias("c"), col(turn).cast("long").alias("turn"), blank(col(role)).alias("role"),
                        blank(col(text)).alias("text"), n.cast("long").alias("n"))
    # equal rows are one, with a count: no group of copies meets in one place later on
    plain = (given.withColumn("named", F.col("n") == 0)
             .withColumns({x: F.when(~F.col("named"), F.col(x)) for x in ("turn", "role", "text")})
             .groupBy("c", "turn", "role", "text").agg(F.sum("n").alias("copies")))
    told = F.md5(F.col("text").cast("binary"))
    seen = (plain.where("copies > 0").groupBy(F.col("c").alias("c2"), F.col("role").alias("r2"), told.alias("t2"))
            .agg(F.count("*").alias("times"), F.min(F.struct("turn")).alias("early")).where("times > 1"))
    flagged = plain.join(seen, F.col("c").eqNullSafe(F.col("c2")) & (F.col("role") == F.col("r2"))
                         & (told == F.col("t2")), "left")
    order = ["c", F.col("turn").asc_nulls_first(), "role", "h"]
    ordered = (flagged.select("c", "turn", "role", "text", "copies", F.xxhash64("text").alias("h"),
                              (F.col("times").isNotNull() & ~F.col("turn").eqNullSafe(F.col("early.turn"))).alias("again"))
               .repartitionByRange(*order).sortWithinPartitions(*order))
    fault = (F.when(~F.col("text").rlike(SPACE), BLANK).when(F.col("again"), REPEATED)
             .when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), CUT).otherwise(0))
    faulty = ordered.select("c", "turn", "role", "text", F.coalesce("copies", F.lit(0)).alias("copies"), fault.alias("fault"))
    schema = (f"kind int, c {rows.schema[conv].dataType.simpleString()}, part long, k long, i long, "
              "numbers array<long>, role string, text string")
    made = materialize(faulty.mapInArrow(_sweep(costs, chunk), schema))
    runs = (made.where(F.col("kind") == RUN).repartition("c")
            .sortWithinPartitions("c", F.desc("part"), F.desc("k")).mapInArrow(_back(costs), schema))
    runs = materialize(runs)
    behind = runs.where(F.col("kind") == VECTOR).select("part", "k", F.col("numbers")[0].alias("behind"))
    written = (made.where(F.col("kind") == ROW).join(behind, ["part", "k"]).repartition("c")
               .sortWithinPartitions("c", "part", "k", "i").mapInArrow(_forth(costs), schema))
    spread = (runs.where(F.col("kind") == REPORT).select("c", "numbers")
              .join(written.select(F.col("c").alias("c2"), "role", "text"), F.col("c").eqNullSafe(F.col("c2")), "left")
              .select("c", "numbers", F.coalesce("role", F.lit("")).alias("role"),
                      F.coalesce("text", F.lit(hashlib.sha256().hexdigest())).alias("text")))
    whole = made.where(F.col("kind") == REPORT).select("c", "numbers", "role", "text").unionByName(spread)
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return whole.select(F.col("c").alias(conv), *[F.col("numbers")[i].alias(x) for i, x in enumerate(names)],
                        F.col("role").alias("audit"), F.col("text").alias("repaired_sha256"))


def damage(rows: DataFrame) -> tuple[DataFrame, Column]:
    """Rows damaged by a checksum of their conversation and turn, and how often each is left:
    0 drops, 1 empties the text, 2 removes its ends of sentences, 3 repeats, 4 sets the role."""
    blank = lambda x: F.coalesce(F.col(x).cast("string"), F.lit(" "))               # noqa: E731
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(blank("text"), ".!?", "")).otherwise(blank("text"))
    out = rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(blank("role")).alias("role"),
                      text.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("left"))
    return out, F.col("left")
