"""Conversation structure repair: the cheapest edits that give a conversation its turn order.

Rows in turn order may be kept (cost 0), given another role (1), deleted (2; required for blank and
repeated rows) or have an empty message inserted around them (5); a truncated row that stays adds
5. The roles' initials must come out as ``(s?(ua)+)?``. Of equal costs the ASCII-least audit (the
edits' letters in order: D, I, K, R) wins.

Search: depth-first branch and bound over (row, state) with an explicit stack. A prefix is cut when
its cost and the suffix's lower bound exceed the incumbent's cost, or when the dominance table of
its (row, state) holds a prefix of less cost, or of equal cost and lesser audit; a complete one
replaces the incumbent (cost, audit) in the same order. An empty stack is the proof. The lower
bound is the least cost of the remaining rows from that state; it leaves out the order of audits,
which incumbent and tables settle (any weaker bound gives the same answer, only later). Costs follow from the letters and the rows, so two prefixes of
one node with equal cost never are the beginning of each other, and the lesser one stays the
lesser whatever follows.

Distribution: identical rows are counted before the shuffle; faults are found by joins and
aggregates. Each conversation's rows meet in one sorted stream: first its codes (a byte a row),
which the search answers with an audit, then its texts, which are hashed one by one and never held.
The audit (a letter a row) and the SHA-256 over the whole repaired conversation are the result's
own form, so a conversation is one stream; what a task holds is the codes and the search of the
longest conversation.

Defined results: null role and text count as one space, which is no role and blank; a null turn
comes first; a null conversation id is a conversation of its own. Rows of one turn are taken by
role, then by the MD5 of their text. An empty role has no initial and cannot be kept. An empty
table gives no rows. Only the four columns are read, so others never clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "\x20\x09-\x0d"
#: Automaton of ``(s?(ua)+)?``: state -> {initial: next state}. Ends are allowed in 0 and 3.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ENDS = (0, 3)
ROLE_OF = {"s": "system", "u": "user", "a": "assistant"}
DELETE, RELABEL, INSERT, TRUNCATED = 2, 1, 5, 5
FAR = 1 << 60

Row = tuple[str, str]  # initial, fault: "" or one of b(lank), d(uplicate), t(runcated)


def moves(row: Row, state: int) -> Iterator[tuple[str, int, int]]:
    """(letter, cost, next state) of the edits of ``row`` in ``state``, by letter."""
    initial, fault = row
    yield "D", DELETE, state
    if fault in ("b", "d"):
        return
    more = TRUNCATED if fault == "t" else 0
    if initial in NEXT[state]:
        yield "K", more, NEXT[state][initial]
    for other in "ua":
        if other in NEXT[state] and other != initial:
            yield "R", RELABEL + more, NEXT[state][other]


def inserts(state: int) -> Iterator[int]:
    for other in "ua":
        if other in NEXT[state]:
            yield NEXT[state][other]


def suffix_bounds(rows: list[Row]) -> list[tuple[int, ...]]:
    """Per row and state: a lower bound of the cost from there to the end."""
    bounds: list[tuple[int, ...]] = []
    after: list[int] = [FAR] * 4
    for n in range(len(rows), -1, -1):
        if n == len(rows):
            here = [0 if s in ENDS else FAR for s in range(4)]
        else:
            here = [min(cost + after[to] for _, cost, to in moves(rows[n], s)) for s in range(4)]
        for _ in range(3):  # a chain of insertions passes through no state twice
            here = [min([here[s], *(INSERT + here[to] for to in inserts(s))]) for s in range(4)]
        bounds.append(tuple(here))
        after = here
    return bounds[::-1]


class Prefix:
    """The audit so far, as a chain from its last letter back."""

    __slots__ = ("before", "letter", "length")

    def __init__(self, before: Prefix | None, letter: str):
        self.before, self.letter = before, letter
        self.length = before.length + 1 if before else 1

    @staticmethod
    def text(x: Prefix | None) -> str:
        letters = []
        while x:
            letters.append(x.letter)
            x = x.before
        return "".join(reversed(letters))

    @staticmethod
    def less(x: Prefix | None, y: Prefix | None) -> bool:
        """Is audit x less than audit y? Only their ends are read, back to where they part."""
        of_x, of_y = [], []
        while x is not y:
            if y is None or (x is not None and x.length >= y.length):
                of_x.append(x.letter)
                x = x.before
            else:
                of_y.append(y.letter)
                y = y.before
        return of_x[::-1] < of_y[::-1]


def repair(rows: list[Row], bounds: Callable[[list[Row]], list[tuple[int, ...]]] = suffix_bounds) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits of ``rows``."""
    low = bounds(rows)
    best: tuple[int, Prefix | None] | None = None  # incumbent
    seen: dict[tuple[int, int], tuple[int, Prefix | None]] = {}  # dominance tables
    stack: list[tuple[int, int, int, Prefix | None]] = [(0, 0, 0, None)]
    while stack:
        n, state, cost, audit = stack.pop()
        if best is not None and cost + low[n][state] > best[0]:
            continue
        known = seen.get((n, state))
        if known is not None and (known[0] < cost or (known[0] == cost and not Prefix.less(audit, known[1]))):
            continue
        seen[n, state] = (cost, audit)
        if n == len(rows) and state in ENDS and (best is None or cost < best[0] or (cost == best[0] and Prefix.less(audit, best[1]))):
            best = (cost, audit)
        steps = [("I", INSERT, n, to) for to in inserts(state)]
        if n < len(rows):
            steps += [(letter, more, n + 1, to) for letter, more, to in moves(rows[n], state)]
        # the most promising step is taken first, of equal ones the ASCII-least
        steps = [x for x in steps if low[x[2]][x[3]] < FAR]
        steps.sort(key=lambda x: (x[1] + low[x[2]][x[3]], x[0]), reverse=True)
        for letter, more, to_row, to in steps:
            if best is None or cost + more + low[to_row][to] <= best[0]:
                stack.append((to_row, to, cost + more, Prefix(audit, letter)))
    assert best is not None  # deleting every row is always allowed
    return best[0], Prefix.text(best[1])


# --- rows ----------------------------------------------------------------------------------------


def or_space(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(" "))


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) after the contract's damage; dropped rows are left out."""
    kind = F.pmod(F.crc32(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn")).cast("binary")), F.lit(20))
    rows = conversations.select("conv_id", "turn", or_space("role").alias("role"), or_space("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.where("kind != 0").select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def with_faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies, digest, fault) a distinct row: the fault of its first
    copy. All later copies are duplicates, or blank if it is blank."""
    alike = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies")).withColumn("digest", F.md5("text"))
    when = F.struct(F.col("turn").isNotNull().alias("dated"), "turn")  # null turns first
    first = alike.groupBy("conv_id", "role", "digest").agg(F.min(when).alias("first"))
    same = alike.withColumnsRenamed({"conv_id": "c", "role": "r", "digest": "d"})
    joined = same.join(first, F.col("c").eqNullSafe(F.col("conv_id")) & (F.col("r") == F.col("role")) & (F.col("d") == F.col("digest")))
    fault = (
        F.when(~F.col("text").rlike(f"[^{SPACE}]"), "b")
        .when(F.col("first.dated") & ~(F.col("turn").eqNullSafe(F.col("first.turn"))), "d")
        .when(~F.col("first.dated") & F.col("turn").isNotNull(), "d")
        .when(~F.col("text").rlike(f"[.!?][{SPACE}]*\\z"), "t")
        .otherwise("")
    )
    return joined.select("conv_id", "turn", "role", "text", "copies", "digest", fault.alias("fault"))


RESULT = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)
LEGAL = {"su", "ua", "au"}


class Conversation:
    """One conversation's stream: codes first, then texts."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.rows: list[Row] = []
        self.counts = {"b": 0, "d": 0, "t": 0, "": 0}
        self.illegal = 0
        self.low = self.high = self.last_turn = None
        self.turns = 0
        self.audit: str | None = None
        self.cost = 0

    def code(self, turn, initial: str, fault: str, copies: int) -> None:
        if turn is not None and turn != self.last_turn:
            self.low = turn if self.low is None else self.low
            self.high = self.last_turn = turn
            self.turns += 1
        later = fault if fault == "b" else "d"
        for n in range(copies):
            own = fault if n == 0 else later
            if self.rows and self.rows[-1][0] + initial not in LEGAL:
                self.illegal += 1
            self.rows.append((initial, own))
            self.counts[own] += 1

    def search(self) -> None:
        self.cost, self.audit = repair(self.rows)
        self.at, self.state, self.hash, self.lines = 0, 0, hashlib.sha256(), 0

    def line(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.lines else "") + role + ":" + text).encode())
        self.lines += 1

    def inserted(self) -> None:
        """Empty messages that the audit inserts here."""
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.emit("I", "", "")

    def emit(self, letter: str, role: str, text: str) -> None:
        self.at += 1
        if letter == "D":
            return
        if letter == "K":
            self.state = NEXT[self.state][role[:1]]
            self.line(role, text)
            return
        (to,) = (x for x in NEXT[self.state] if x in "ua")
        self.state = NEXT[self.state][to]
        self.line(ROLE_OF[to], text)

    def text(self, role: str, text: str, copies: int) -> None:
        if self.audit is None:
            self.search()
        for _ in range(copies):
            self.inserted()
            self.emit(self.audit[self.at], role, text)

    def result(self) -> tuple:
        if self.audit is None:
            self.search()
        self.inserted()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        c = self.counts
        return (self.conv_id, gaps, c["b"], c["d"], c["t"], self.illegal, self.cost, self.audit, self.hash.hexdigest())


def repair_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation; in each the codes (part 1) before the texts (part 2). Part 0
    only names the conversation."""
    kind = pa.schema([(x.split()[0], pa.string() if x.endswith("string") else pa.int64()) for x in RESULT.split(", ")])
    now: Conversation | None = None
    done: list[tuple] = []
    for rows in batches:
        for conv_id, part, turn, role, text, copies, fault in zip(*(c.to_pylist() for c in rows.columns), strict=True):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    done.append(now.result())
                now = Conversation(conv_id)
            if part == 1:
                now.code(turn, role, fault, copies)
            elif part == 2:
                now.text(role, text, copies)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done, strict=True), kind, strict=True)], schema=kind)
            done = []
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(now.result(), kind, strict=True)], schema=kind)


def repair_conversations(rows: DataFrame, conv_ids: DataFrame) -> DataFrame:
    """``RESULT`` for every conversation of ``conv_ids`` (distinct), from its ``rows`` (conv_id,
    turn, role, text, copies). The repaired text is the rows under the audit (``Conversation``)."""
    found = with_faults(rows)
    null = lambda kind: F.lit(None).cast(kind)
    names = conv_ids.select(
        "conv_id", F.lit(0).alias("part"), null("long").alias("turn"), null("string").alias("role"),
        null("string").alias("text"), F.lit(0).cast("long").alias("copies"), null("string").alias("fault"), null("string").alias("by"), null("string").alias("digest"),
    )
    codes = found.select("conv_id", F.lit(1), "turn", F.substring("role", 1, 1), null("string"), "copies", "fault", "role", "digest")
    texts = found.select("conv_id", F.lit(2), "turn", "role", "text", "copies", null("string"), "role", "digest")
    both = names.union(codes).union(texts)
    stream = both.repartition("conv_id").sortWithinPartitions("conv_id", "part", "turn", "by", "digest")
    return stream.select("conv_id", "part", "turn", "role", "text", "copies", "fault").mapInArrow(repair_stream, RESULT)


def damaged_and_repaired(conversations: DataFrame) -> DataFrame:
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return repair_conversations(damage(rows), rows.select("conv_id").distinct())
