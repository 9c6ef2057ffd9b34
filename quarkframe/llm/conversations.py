"""Repair of the structure of conversations.

A conversation's rows, in order of turn (nulls first; then role, the text's
first 64 characters, its hash), get an edit each: Keep, Rerole (to user or
assistant), Delete, and empty-text user or assistant rows may be Inserted
anywhere. Blank rows and rows whose role and text an earlier row has must go; a
truncated row that stays costs extra. The repair is the cheapest sequence of edits whose roles' initials
read ``(s?(ua)+)?``; of equally cheap ones, the one whose initials are least in
ASCII (the audit).

Method: depth-first branch and bound over nodes (rows read, state of the role
pattern) with an explicit stack (``search``). Suffix lower bounds give the
least cost that any completion adds; the incumbent is a pair (cost, audit), and
a prefix is cut when its bound exceeds it, or equals it with a greater audit;
each node keeps the least (cost, audit) that reached it, which rules out every
other prefix there. The search ends when the stack is empty: optimality is
proved.

Scale. The first of equal texts is found by a partial aggregate over hashes,
whose result is a mark that sorts before its row. Where a task's first row
comes without a mark, the mark may be the last thing of the task before: that row
makes a segment of its own, in two versions, of which the walk over the segments
takes the right one. Rows and marks are dealt out
by ranges of (conversation, turn, role, text, chance), not by conversation, so
a conversation, or a row, that makes a third of all rows spreads over as many
tasks as it needs, and texts cross one shuffle. A conversation that lies inside
one task, of ``SEGMENT`` rows or ``SEGMENT_CHARS`` characters at most, is
solved there. All others are cut into segments of that size; each segment is
searched once for each pair of states at its ends, and a walk over the
segments of a conversation (their costs and audits only) chooses the pairs.
Insertions at a segment's end count to the next one, so audits of equally many
rows are never prefixes of each other and the walk compares them segment by
segment. The result is the same for any segment length (tested).

The digest of a conversation of many segments is a SHA-256 of its lines in
order, which one task must read as a stream, a segment at a time.

Edge cases: null roles and texts count as one space; a null conv_id is a
conversation of its own; a null turn comes first and counts for no gap; rows of
equal turn follow each other by role and text (see above); a conversation without rows
(all copies 0) gives zeros, an empty audit and no turns; repeated rows are
duplicates; roles that start with none of s, u, a cannot be kept; very long
texts make a segment of their own; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import store

# The costs of the edits.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
# States of the role pattern: nothing yet, after system, after user, after assistant.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
MADE = (("user", 2), ("user", 2), ("assistant", 3), ("user", 2))   # what a new or changed role must be
CLOSING = {0: (0, ""), 1: (2 * INSERT, "II"), 2: (INSERT, "I"), 3: (0, "")}   # insertions after the last row
LEGAL = ("su", "ua", "au")

SEGMENT = 1024               # rows searched at a time
SEGMENT_CHARS = 4_000_000    # characters of text held at a time
ANY, LATER, FIRST = 0, 1, 2  # versions of a segment: the only one; its row repeats an earlier one, or is the first
PREFIX = 64                  # characters of a text that decide which task gets its row
WHITE = " \t\n\x0b\x0c\r"

#: One step of a search: (rows that must go, initial, truncated); a step with
#: rows that must go is nothing else.
Step = tuple[int, str, bool]


def suffix_bounds(steps: list[Step], goals: dict[int, tuple[int, str]]) -> list[list[float]]:
    """Least cost from each (row, state) to a goal state after the last row."""
    inf = float("inf")
    bounds = [[goals[s][0] if s in goals else inf for s in range(4)]]
    for forced, initial, truncated in reversed(steps):
        after, here = bounds[-1], []
        for s in range(4):
            if forced:
                here.append(DELETE * forced + after[s])
                continue
            stay = TRUNCATED * truncated
            least = min(DELETE + after[s], REROLE + stay + after[MADE[s][1]])
            if initial in NEXT[s]:
                least = min(least, KEEP + stay + after[NEXT[s][initial]])
            here.append(least)
        for _ in range(2):     # one or two insertions first
            here = [min(x, INSERT + here[MADE[s][1]]) for s, x in enumerate(here)]
        bounds.append(here)
    return bounds[::-1]


def search(steps: list[Step], start: int = 0,
           goals: dict[int, tuple[int, str]] = CLOSING) -> tuple[int, str, int] | None:
    """(cost, audit, state after the last row) of the best edits that lead from
    ``start`` to a goal state, whose closing cost and edits are counted; None if
    there are none."""
    bounds, n = suffix_bounds(steps, goals), len(steps)
    limit, best = bounds[0][start], None      # incumbent: cost, then (audit, state)
    if limit == float("inf"):
        return None
    reached: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(0, start, 0, "")]
    while stack:
        i, s, cost, audit = stack.pop()
        least = cost + bounds[i][s]
        if least > limit or (best is not None and least == limit and audit > best[0][:len(audit)]):
            continue
        known = reached.get((i, s))
        if known is not None and known <= (cost, audit):
            continue
        reached[i, s] = (cost, audit)
        if i == n:
            whole = audit + goals[s][1]
            if least < limit or best is None or whole < best[0]:
                limit, best = least, (whole, s)
            continue
        forced, initial, truncated = steps[i]
        stay, (_, made) = TRUNCATED * truncated, MADE[s]
        # greatest letter first, so that the least is searched first
        if not forced:
            stack.append((i + 1, made, cost + REROLE + stay, audit + "R"))
            if initial in NEXT[s]:
                stack.append((i + 1, NEXT[s][initial], cost + KEEP + stay, audit + "K"))
        stack.append((i, made, cost + INSERT, audit + "I"))
        stack.append((i + 1, s, cost + DELETE * max(forced, 1), audit + "D" * max(forced, 1)))
    return int(limit), best[0], best[1]


def apply_edits(rows: list[tuple[str | None, str | None, int]], start: int, audit: str) -> list[dict]:
    """The repaired turns of rows (role, text, rows that must go) edited by ``audit``."""
    out, s, at = [], start, 0

    def inserted() -> None:
        nonlocal s, at
        while at < len(audit) and audit[at] == "I":
            role, s = MADE[s]
            out.append({"role": role, "text": ""})
            at += 1

    for role, text, forced in rows:
        inserted()
        if forced:
            at += forced
            continue
        edit = audit[at]
        at += 1
        if edit == "K":
            out.append({"role": role, "text": text})
            s = NEXT[s][role[:1]]
        elif edit == "R":
            role, s = MADE[s]
            out.append({"role": role, "text": text})
    inserted()
    return out


@dataclass
class Piece:
    """Rows of one conversation that lie next to each other."""

    steps: list[Step] = field(default_factory=list)
    rows: list[tuple[str | None, str | None, int]] = field(default_factory=list)
    chars: int = 0
    n: int = 0
    first: str | None = None
    last: str | None = None
    low: int | None = None
    high: int | None = None
    distinct: int = 0
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0

    def add(self, turn: int | None, role: str, text: str, n: int, first: bool, blank: bool, truncated: bool) -> None:
        initial = role[:1]
        self.illegal += n - 1 + (self.n > 0 and self.last + initial not in LEGAL)
        self.first = initial if self.n == 0 else self.first
        self.last, self.n = initial, self.n + n
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high, self.distinct = turn, self.distinct + 1
        stays = first and not blank
        gone = n - stays
        if blank:
            self.blank += n
        else:
            self.duplicate += gone
        if stays:
            self.truncated += truncated
            self.steps.append((0, initial, truncated))
            self.rows.append((role, text, 0))
            self.chars += len(text)
        if gone and self.steps and self.steps[-1][0]:
            gone += self.steps.pop()[0]
            self.rows.pop()
        if gone:       # rows in succession that must go are one step: insertions between them are never least
            self.steps.append((gone, "", False))
            self.rows.append((None, None, gone))

    def follow(self, p: Piece) -> None:
        """Add the figures of the piece that comes next."""
        self.illegal += p.illegal + (self.n > 0 and p.n > 0 and self.last + p.first not in LEGAL)
        self.distinct += p.distinct - (p.low is not None and p.low == self.high)
        self.low = p.low if self.low is None else self.low
        self.high = self.high if p.high is None else p.high
        if p.n:
            self.first, self.last = self.first if self.n else p.first, p.last
        self.n += p.n
        self.blank, self.duplicate, self.truncated = (
            self.blank + p.blank, self.duplicate + p.duplicate, self.truncated + p.truncated)

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.distinct


FIGURES = ["n", "first", "last", "low", "high", "distinct", "blank", "duplicate", "truncated", "illegal"]
_FIGURES_DDL = ("n bigint, first string, last string, low bigint, high bigint, distinct bigint, blank bigint, "
                "duplicate bigint, truncated bigint, illegal bigint")
_TURNS = "turns array<struct<role:string,text:string>>"


def _pieces_schema(conv: str) -> str:
    return (f"conv_id {conv}, task int, k int, version int, ends_marked boolean, whole boolean, {_FIGURES_DDL}, gaps bigint, cost bigint, audit string, "
            f"{_TURNS}, rows array<struct<role:string,text:string,forced:bigint>>, "
            "ways array<struct<start:int,goal:int,cost:bigint,audit:string>>")


def _walk(segment: int, segment_chars: int, emit):  # noqa: ANN001, ANN202
    """Turns sorted rows of one task into pieces: solved conversations and
    segments of those that may go on in another task or are long."""

    def solved(conv, task: int, k: int, p: Piece) -> dict:  # noqa: ANN001
        cost, audit, _ = search(p.steps)
        return {"conv_id": conv, "task": task, "k": k, "whole": True, "gaps": p.gaps(), "cost": cost, "audit": audit,
                "turns": apply_edits(p.rows, 0, audit)} | {f: getattr(p, f) for f in FIGURES}

    def part(conv, task: int, k: int, p: Piece, version: int = ANY, ends_marked: bool = False) -> dict:  # noqa: ANN001
        ways = []
        for start in range(4) if p.steps else ():
            for goal in range(4):
                if found := search(p.steps, start, {goal: (0, "")}):
                    ways.append({"start": start, "goal": goal, "cost": found[0], "audit": found[1]})
        return {"conv_id": conv, "task": task, "k": k, "version": version, "ends_marked": ends_marked, "whole": False,
                "ways": ways,
                "rows": [{"role": r, "text": t, "forced": f} for r, t, f in p.rows]} | {f: getattr(p, f) for f in FIGURES}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now, k, edge, p, marked, size, begun = [], (), 0, True, Piece(), False, 0, False

        def ready(row: dict) -> Iterator[pa.RecordBatch]:
            nonlocal out, size
            out.append(row)
            size += sum(len(x["text"] or "") + 50 for x in row.get("rows") or row.get("turns") or ()) + 200
            if size > 4_000_000:
                yield emit(out)
                out, size = [], 0

        for batch in batches:
            for conv, task, turn, role, text, n, mark, blank, truncated in zip(*[c.to_pylist() for c in batch.columns]):
                if now != (conv,):
                    if now:
                        # the first conversation of a task may have begun in the one before
                        yield from ready((part if edge else solved)(now[0], of, k, p))
                        k, edge = k + 1, False
                    else:
                        edge = True
                    now, p, of, marked = (conv,), Piece(), task, False
                if mark:                       # of the row that comes next
                    marked = True
                    continue
                if role is None:               # names its conversation
                    continue
                if not begun and not marked:   # its mark, if it is a first one, is the last of the task before
                    for version in (LATER, FIRST):
                        one = Piece()
                        one.add(turn, role, text, n, version == FIRST, blank, truncated)
                        yield from ready(part(conv, task, k, one, version))
                    k, edge, begun = k + 1, True, True
                    continue
                begun = True
                if len(p.steps) >= segment or p.steps and p.chars + len(text) > segment_chars:
                    yield from ready(part(conv, task, k, p))
                    k, p, edge = k + 1, Piece(), True
                p.add(turn, role, text, n, marked, blank, truncated)
                marked = False
        if now:
            yield from ready(part(now[0], of, k, p, ends_marked=marked))
        if out:
            yield emit(out)

    return run


def _emitter(ddl: str):  # noqa: ANN202
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    return lambda rows: pa.RecordBatch.from_pylist(rows, schema=schema)


def _chain(emit):  # noqa: ANN001, ANN202
    """Chooses the ends of the segments of each conversation, from segments in order."""

    def conversation(conv, segments: list[dict]) -> Iterator[dict]:  # noqa: ANN001
        figures, best, back = Piece(), {0: (0, 0)}, []     # state -> (cost, rank of its audit)
        marked, every, segments = False, segments, []
        for g in every:
            if g["version"] == ANY or (g["version"] == FIRST) == marked:
                segments.append(g)
                marked = g["ends_marked"]
        for g in segments:
            figures.follow(Piece(**{f: g[f] for f in FIGURES}))
            if not g["ways"]:
                back.append(None)
                continue
            reach: dict[int, tuple] = {}
            for w in g["ways"]:
                if w["start"] in best:
                    cost, rank = best[w["start"]]
                    x = (cost + w["cost"], rank, w["audit"], w["start"])
                    if w["goal"] not in reach or x < reach[w["goal"]]:
                        reach[w["goal"]] = x
            order = sorted(reach, key=lambda s: reach[s][1:3])
            best = {s: (reach[s][0], order.index(s)) for s in reach}
            back.append(reach)
        cost, _, _, s = min((c + CLOSING[s][0], rank, CLOSING[s][1], s) for s, (c, rank) in best.items())
        rest, pieces = CLOSING[s][1], []
        for reach in reversed(back):
            if reach is None:
                pieces.append((s, ""))
                continue
            _, _, audit, before = reach[s]
            pieces.append((before, audit))
            s = before
        pieces.reverse()
        if pieces:
            pieces[-1] = (pieces[-1][0], pieces[-1][1] + rest)
        for i, (g, (start, audit)) in enumerate(zip(segments, pieces)):
            row = {"conv_id": conv, "task": g["task"], "k": g["k"], "version": g["version"], "start": start, "edits": audit}
            if i == len(pieces) - 1:
                row |= {f: getattr(figures, f) for f in FIGURES}
                row |= {"gaps": figures.gaps(), "cost": cost, "audit": "".join(a for _, a in pieces)}
            yield row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = (), []
        for batch in batches:
            for g in batch.to_pylist():
                if now != (g["conv_id"],):
                    if now:
                        yield emit(list(conversation(now[0], held)))
                    now, held = (g["conv_id"],), []
                held.append(g)
        if now:
            yield emit(list(conversation(now[0], held)))

    return run


@dataclass
class Repair:
    """``report``: one row for each conv_id: n (rows), gaps, blank, duplicate,
    truncated, illegal, cost, audit. ``turns``: conv_id, part (task, k), whole,
    turns; the repaired conversation is the turns of its parts in order."""

    report: DataFrame
    turns: DataFrame


def repair(rows: DataFrame, segment: int = SEGMENT, segment_chars: int = SEGMENT_CHARS) -> Repair:
    """Repairs the conversations of ``rows`` (conv_id, turn, role, text, and how
    many copies of the row there are; rows of 0 copies only name their conv_id)."""
    conv = dict(rows.dtypes)["conv_id"]
    space, there = F.lit(" "), F.col("copies") > 0
    text = F.when(there, F.coalesce("text", space))
    bare = F.rtrim(F.col("text"), F.lit(WHITE))
    each = (rows.select("conv_id", F.when(there, F.col("turn").cast("long")).alias("turn"),
                        F.when(there, F.coalesce("role", space)).alias("role"), text.alias("text"),
                        F.unhex(F.md5(text)).alias("h"), F.col("copies").cast("long").alias("n"))
            .withColumn("blank", bare == "")
            .withColumn("truncated", ~F.right(bare, F.lit(1)).isin(".", "!", "?")))
    start = F.substring("text", 1, PREFIX)
    # of equal role and text, the first row; nulls come first
    turn = F.min(F.struct(F.col("turn").isNotNull().alias("late"), "turn"))["turn"]
    firsts = (each.where("n > 0").groupBy("conv_id", "role", "h").agg(turn.alias("turn"), F.min(start).alias("text")))
    both = each.withColumn("mark", F.lit(False)).unionByName(
        firsts.withColumn("mark", F.lit(True)), allowMissingColumns=True)
    keys = ["conv_id", "turn", "role", start, "h"]
    # a random last key parts equal rows, however many there are
    dealt = (both.repartitionByRange(*keys, F.desc("mark"), F.when(~F.col("mark"), F.rand(1)))
             .sortWithinPartitions(*keys, F.desc("mark"))
             .select("conv_id", F.spark_partition_id().alias("task"), "turn", "role", "text", "n", "mark", "blank",
                     "truncated"))
    ddl = _pieces_schema(conv)
    pieces = store(dealt.mapInArrow(_walk(segment, segment_chars, _emitter(ddl)), ddl), "conversations")

    figures = ["n", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    parts = pieces.where("not whole")
    ddl = (f"conv_id {conv}, task int, k int, version int, start int, edits string, {_FIGURES_DDL}, gaps bigint, "
           "cost bigint, audit string")
    chosen = store(parts.select("conv_id", "task", "k", "version", "ends_marked", *FIGURES, "ways").repartition("conv_id")
                   .sortWithinPartitions("conv_id", "task", "k")
                   .mapInArrow(_chain(_emitter(ddl)), ddl), "conversation-edits")

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [{"conv_id": g["conv_id"], "task": g["task"], "k": g["k"], "whole": False,
                    "turns": apply_edits([(r["role"], r["text"], r["forced"]) for r in g["rows"]], g["start"], g["edits"])}
                   for g in batch.to_pylist()]
            yield to_turns(got)

    ddl = f"conv_id {conv}, task int, k int, whole boolean, {_TURNS}"
    to_turns = _emitter(ddl)
    piece = ["task", "k", "version"]
    edited = (parts.select("conv_id", *piece, "rows").join(chosen.select(*piece, "start", "edits"), piece)
              .select("conv_id", "task", "k", "rows", "start", "edits").mapInArrow(edit, ddl))
    whole = pieces.where("whole")
    return Repair(whole.select("conv_id", *figures).unionByName(
                      chosen.where("audit is not null").select("conv_id", *figures)),
                  whole.select("conv_id", "task", "k", "whole", "turns").unionByName(edited))


def lines(turns: Column) -> Column:
    """``role:text`` of each turn, joined by newlines."""
    return F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")


def digests(turns: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 of the lines of every repaired conversation."""
    conv = dict(turns.dtypes)["conv_id"]
    schema = f"conv_id {conv}, repaired_sha256 string"
    emit = _emitter(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, h, any_ = (), hashlib.sha256(), False
        for batch in batches:
            for g in batch.to_pylist():
                if now != (g["conv_id"],):
                    if now:
                        yield emit([{"conv_id": now[0], "repaired_sha256": h.hexdigest()}])
                    now, h, any_ = (g["conv_id"],), hashlib.sha256(), False
                for t in g["turns"]:
                    h.update((("\n" if any_ else "") + t["role"] + ":" + t["text"]).encode())
                    any_ = True
        if now:
            yield emit([{"conv_id": now[0], "repaired_sha256": h.hexdigest()}])

    whole = turns.where("whole").select("conv_id", F.sha2(lines(F.col("turns")), 256).alias("repaired_sha256"))
    parts = (turns.where("not whole").repartition("conv_id").sortWithinPartitions("conv_id", "task", "k")
             .select("conv_id", "turns").mapInArrow(run, schema))
    return whole.unionByName(parts)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, copies) of ``conversations`` damaged by
    crc32 of ``conv_id:turn`` modulo 20: 0 drops the row, 1 empties its text, 2
    removes its sentence ends, 3 repeats it, 4 makes it the user's."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    d = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    text = F.coalesce("text", F.lit(" "))
    return conversations.select(
        "conv_id", "turn", F.when(d == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(d == 1, "").when(d == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(d == 0, 0).when(d == 3, 2).otherwise(1).alias("copies"))
