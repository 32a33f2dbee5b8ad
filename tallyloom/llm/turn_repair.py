"""Repair of the turns of conversations by error-correcting Earley parsing.

The grammar of roles has productions for a well-formed conversation; rows are its input, and a weighted step may keep
a row, give it another role, delete it, or insert a turn without text. Each chart item holds the cheapest way to it,
ties by the least audit (the letters of its steps), so that the completed start symbol at the end of the chart yields
the repair. All productions recur on the left: items start at the first row only, and a set has a few of them.

Conversations are sorted by ranges, so a long one lies in several segments. A segment is parsed from every item that a
parse before it can leave open; segments are then joined in order. No step holds more than a segment's letters.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.chat_format import numbered
from tallyloom.llm.common import fold_sorted, staged, table

#: Productions of (s?(ua)+)?: lower-case terminals are initials of roles.
GRAMMAR = (("Start", ()), ("Start", ("Talk",)), ("Talk", ("Head", "u", "a")), ("Head", ()), ("Head", ("s",)), ("Head", ("Talk",)))
#: Roles that a row can be given, or inserted with, by initial.
ROLES = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
LEGAL = ("su", "ua", "au")
SPACE = r"\x20\x09-\x0D"
#: Rows after which the letters so far are put aside; no result depends on it.
ASIDE = 512

Item = tuple[int, int]
#: Items from which a parse goes on after a row: nothing yet, a talk's head, its user, and a whole talk.
FRESH, HEAD, USER, TALK = (4, 0), (2, 1), (2, 2), (2, 3)
OPEN = (FRESH, HEAD, USER, TALK)


def _next(item: Item) -> str | None:
    body = GRAMMAR[item[0]][1]
    return body[item[1]] if item[1] < len(body) else None


class Chart:
    """One parse. ``items`` holds the last set: item -> (cost, rank, letters). Letters put aside are nodes, ranked in
    their order; since each ends with a row's letter, none is the beginning of another, and (rank, letters) compares as
    the whole audit does."""

    def __init__(self, start: Item) -> None:
        self.items: dict[Item, tuple[int, int, str]] = {start: (0, 0, "")}
        self.nodes: list[tuple] = [()]
        self.rows = 0

    def close(self) -> dict[Item, tuple[int, int, str]]:
        """The set with predictions, completions and insertions. All items start at the first row, so what waits for
        a completed symbol is any production that begins with it."""
        out = dict(self.items)
        todo = list(out)
        if FRESH in out:
            for p, (_, body) in enumerate(GRAMMAR):
                if not body:
                    out[p, 0] = min(out[FRESH], out.get((p, 0), out[FRESH]))
                    todo.append((p, 0))
        while todo:
            item = todo.pop()
            cost, rank, letters = out[item]
            expected = _next(item)
            if expected is None:
                steps = [((p, 1), (cost, rank, letters)) for p, (_, body) in enumerate(GRAMMAR) if body and body[0] == GRAMMAR[item[0]][0]]
            elif expected in ROLES:
                steps = [((item[0], item[1] + 1), (cost + INSERT, rank, letters + "I"))]
            else:
                continue
            for to, value in steps:
                if to not in out or value < out[to]:
                    out[to] = value
                    todo.append(to)
        return out

    def step(self, initial: str, must_go: bool, extra: int) -> None:
        """Read one row: its role's initial, whether it has to be deleted, what it costs if it stays."""
        got: dict[Item, tuple[int, int, str]] = {}

        def offer(to: Item, value: tuple[int, int, str]) -> None:
            if to not in got or value < got[to]:
                got[to] = value

        for item, (cost, rank, letters) in self.close().items():
            expected = _next(item)
            if item in OPEN:
                offer(item, (cost + DELETE, rank, letters + "D"))
            if must_go or expected is None:
                continue
            to = (item[0], item[1] + 1)
            if expected == initial:
                offer(to, (cost + KEEP + extra, rank, letters + "K"))
            if expected in ROLES:
                offer(to, (cost + REROLE + extra, rank, letters + "R"))
        self.items = got
        self.rows += 1
        if self.rows % ASIDE == 0:
            ranked = sorted({(r, s) for _, r, s in got.values()})
            place = {x: k for k, x in enumerate(ranked)}
            self.items = {i: (c, place[r, s], "") for i, (c, r, s) in got.items()}
            self.nodes = [(self.nodes[r], s) for r, s in ranked]

    def audit(self, rank: int, letters: str) -> str:
        parts, node = [letters], self.nodes[rank]
        while node:
            node, s = node
            parts.append(s)
        return "".join(reversed(parts))

    def ends(self) -> list[tuple[int, int, str]]:
        """(item's number in OPEN, cost, audit) of each open item, as the last row leaves it."""
        # A head of "s" alone is completed: what goes on from it is the item after the head.
        if (4, 1) in self.items:
            value = self.items[4, 1]
            self.items[HEAD] = min(value, self.items.get(HEAD, value))
        return [(OPEN.index(i), c, self.audit(r, s)) for i, (c, r, s) in self.items.items() if i in OPEN]


def finish(state: int) -> tuple[int, str] | None:
    """Cost and letters that end a parse from an open item."""
    chart = Chart(OPEN[state])
    done = chart.close()
    best = min((done[i] for i in ((0, 0), (1, 1)) if i in done), default=None)
    return best and (best[0], best[2])


def judged(rows: DataFrame) -> DataFrame:
    """``numbered`` rows with each one's first fault: ``blank``, ``duplicate``, ``truncated`` or null."""
    key = F.md5(F.concat(F.length("role"), F.lit(":"), "role", "text").cast("binary"))
    keyed = rows.select("conv_id", "place", "turn", F.substring("role", 1, 1).alias("initial"), key.alias("key"), _fault(F.col("text")).alias("own"))
    firsts = keyed.groupBy("conv_id", "key").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("first"))
    fault = F.when(F.col("own") == "blank", F.col("own")).when(F.col("first").isNull(), F.lit("duplicate")).otherwise(F.col("own"))
    return keyed.join(firsts, "place", "left").select("conv_id", "place", "turn", "initial", fault.alias("fault"))


def _fault(text: Column) -> Column:
    # The last character that is no white space, without a pattern that goes back over long runs of it.
    last = F.substring(F.rtrim(F.translate(text, "\t\n\x0b\x0c\r", "     ")), -1, 1)
    return F.when(last == "", F.lit("blank")).when(~last.isin(".", "!", "?"), F.lit("truncated"))


class _Segment:
    """The rows of a conversation in one range."""

    def __init__(self) -> None:
        self.charts: list[tuple[int, Chart]] = []
        self.faults = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        self.initials: list[str] = []
        self.illegal = self.distinct = 0
        self.first = self.low = self.high = None

    def add(self, place: int, turn: int | None, initial: str, fault: str | None) -> None:
        if self.first is None:
            self.first = place
            # Only the first conversation of a range can go on from another range.
            self.charts = [(k, Chart(i)) for k, i in enumerate(OPEN) if k == 0 or place & (1 << 33) - 1 == 0]
        if fault:
            self.faults[fault] += 1
        if self.initials and self.initials[-1] + initial not in LEGAL:
            self.illegal += 1
        self.initials.append(initial)
        if turn is not None and turn != self.high:
            self.low, self.high, self.distinct = turn if self.low is None else self.low, turn, self.distinct + 1
        for _, chart in self.charts:
            chart.step(initial, fault in ("blank", "duplicate"), TRUNCATED if fault == "truncated" else 0)

    def rows(self) -> list[tuple]:
        f = self.faults
        table = [(k, *x) for k, chart in self.charts for x in chart.ends()]
        heads, ends, costs, audits = (list(x) for x in zip(*table))
        return [(self.first, self.initials, self.illegal, f["blank"], f["duplicate"], f["truncated"], self.low, self.high, self.distinct, heads, ends, costs, audits)]


_SEGMENT = "first long, initials string[], illegal long, blank long, duplicate long, truncated long, low long, high long, turns long, heads long[], ends long[], costs long[], audits string[]"


class _Joined:
    """The segments of a conversation, in order."""

    def __init__(self) -> None:
        self.best: dict[int, tuple[int, int]] = {0: (0, 0)}
        self.nodes: list[tuple] = [()]
        self.sums = [0] * 4
        self.turns = 0
        self.low = self.high = self.last = None
        self.segments: list[tuple[int, list[str]]] = []

    def add(self, segment, first, initials, illegal, blank, duplicate, truncated, low, high, turns, heads, ends, costs, audits) -> None:
        for k, v in enumerate((illegal, blank, duplicate, truncated)):
            self.sums[k] += v
        if self.last is not None and self.last + initials[0] not in LEGAL:
            self.sums[0] += 1
        self.last = initials[-1]
        if low is not None:
            self.turns += turns - (low == self.high)
            self.low, self.high = low if self.low is None else self.low, high
        found: dict[int, tuple[int, int, str, int]] = {}
        for head, end, cost, audit in zip(heads, ends, costs, audits):
            if head in self.best:
                value = (self.best[head][0] + cost, self.best[head][1], audit, head)
                if end not in found or value < found[end]:
                    found[end] = value
        ranked = sorted({(r, a, h) for _, r, a, h in found.values()})
        place = {x: k for k, x in enumerate(ranked)}
        self.nodes = [(self.nodes[r], a, h) for r, a, h in ranked]
        self.best = {e: (c, place[r, a, h]) for e, (c, r, a, h) in found.items()}
        self.segments.append((first, initials))

    def rows(self) -> list[tuple]:
        ways = []
        for end, (cost, rank) in self.best.items():
            if (rest := finish(end)) is not None:
                ways.append((cost + rest[0], rank, rest[1]))
        cost, rank, tail = min(ways)
        parts, node = [], self.nodes[rank]
        while node:
            node, audit, head = node
            parts.append((audit, head))
        parts.reverse()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        sums = (gaps, *(self.sums[k] for k in (1, 2, 3, 0)), cost)
        out = []
        for k, ((first, initials), (audit, head)) in enumerate(zip(self.segments, parts)):
            last = k + 1 == len(parts)
            out.append((k, first, initials, head, audit + tail * last, last, *sums))
        return out


_JOINED = "segment long, first long, initials string[], head long, audit string, ends boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def parsed(rows: DataFrame) -> DataFrame:
    """The least repair of ``numbered`` rows: one stored row a segment of a conversation, with the segment's audit, the
    open item it begins with, and the conversation's figures."""
    keyed = judged(rows).withColumn("range", F.shiftright("place", 33))
    segments = fold_sorted(keyed, ["conv_id", "range"], ["place"], _Segment, _SEGMENT)
    return staged(fold_sorted(segments, ["conv_id"], ["range"], _Joined, _JOINED), "parsed")


def _edits(first: int, initials: list[str], head: int, audit: str) -> list[tuple]:
    """What becomes of each row of a segment: (place, step in the segment, role if it is given one, None for its own);
    deleted rows are missing, inserted turns have no place."""
    out, expected, row = [], "a" if OPEN[head] == USER else "u", 0
    for k, letter in enumerate(audit):
        own = initials[row] if letter == "K" else expected
        if letter != "D":
            out.append((None if letter == "I" else first + row, k, None if letter == "K" else ROLES[own]))
            expected = "a" if own == "u" else "u"
        row += letter != "I"
    return out


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The repaired turns (conv_id, segment, step, role, text) of ``numbered`` rows, from what ``parsed`` found for them."""
    spec = F.udf(_edits, "array<struct<place:bigint,step:bigint,role:string>>", useArrow=False)
    edits = found.select("conv_id", "segment", F.explode(spec("first", "initials", "head", "audit")).alias("x")).select("conv_id", "segment", "x.*")
    # Inserted turns have no place: they stay out of the join, where null keys would meet in one task.
    kept = edits.join(rows.select("place", F.col("role").alias("own"), "text"), "place").withColumn("role", F.coalesce("role", "own"))
    return kept.unionByName(edits.filter(F.col("place").isNull()).withColumn("text", F.lit("")), allowMissingColumns=True).select("conv_id", "segment", "step", "role", "text")


def repair(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Repaired turns, and one row a conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.

    Rows are taken by turn, null first, then role and text. Nulls of role and text are one space. Repeated rows are
    duplicates from the second on. A conversation whose best repair deletes all its rows has no repaired turns. An
    empty table gives empty ones.
    """
    space = F.lit(" ")
    rows = numbered(conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text")))
    found = parsed(rows)
    figures = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("segment", "audit"))), lambda x: x["audit"]), "")
    return repaired(rows, found), found.groupBy("conv_id").agg(*[F.first(c).alias(c) for c in figures], whole.alias("audit"))


def damaged(conversations: DataFrame) -> DataFrame:
    """``conversations`` with faults by a checksum of conversation and turn: row gone, text empty, marks of its end gone,
    row twice, role user."""
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    fate = F.crc32(name.cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), fate.alias("fate"), F.explode(F.array_repeat(F.lit(0), F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1))))
    text = F.when(F.col("fate") == 1, F.lit("")).when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("fate") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"))


class _Digest:
    def __init__(self) -> None:
        self.hash, self.begun = hashlib.sha256(), False

    def add(self, segment: int, step: int, role: str, text: str) -> None:
        self.hash.update(("\n" * self.begun + f"{role}:{text}").encode())
        self.begun = True

    def rows(self) -> list[tuple]:
        return [(self.hash.hexdigest(),)]


def query(spark, sf_dir: str) -> DataFrame:
    """op13: faults, cheapest repair and digest of every damaged conversation. A digest needs a conversation's turns in
    order, so one task reads them as a stream."""
    own = table(spark, sf_dir, "conversations")
    turns, figures = repair(damaged(own))
    digests = fold_sorted(turns, ["conv_id"], ["segment", "step"], _Digest, "repaired_sha256 string")
    every = own.select(F.col("conv_id").alias("every")).distinct()
    out = every.join(figures, F.col("every").eqNullSafe(figures["conv_id"]), "left").drop("conv_id")
    out = out.join(digests, F.col("every").eqNullSafe(digests["conv_id"]), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("every").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
