"""Conversation structure repair: the cheapest edits that make a conversation's roles read (s?(ua)+)?.

A conversation's rows, by turn, are the layers of a graph whose nodes are what the kept roles end with so far: nothing,
system, user, assistant. Edges keep, rerole or delete the next row, or insert an empty row before it. An edge's weight
is one integer: its high digits are the edit's cost, its low digits hold the edit's letter at the place that it has in
the audit, most significant first, and zero where the audit has ended. Sums of weights are compared as integers, so the
least sum is the cheapest repair and, of equally cheap ones, that with the ASCII-least audit.

Of two ways to a node with the same cost neither audit begins with the other (what is more would be inserts, which
cost), so one least label for each node is enough. The low digits have room for WINDOW letters: when they are full, the
letters so far are put aside and a label keeps its rank among the four in their stead, which decides as they would.
Each label has the digest of its repaired rows with it, so a conversation is read once, row by row, and no more than
four labels and the audits are held of it, however long it is.

Rows are dealt by conversation, role and text to find what was said before, then by conversation and sorted; a
conversation's digest is over its rows in order, so one task reads it through, but doesn't hold it.

Defined cases: a null role or text is one space; null turns come first; ties in turn are ordered by role and text; a null
conversation id is a conversation; a role is judged by its first letter, an empty one is never legal; repeated rows are
rows, of which all but the first are duplicates; texts of any length; an empty table gives an empty result; extra columns
are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: White space, and how a whole sentence ends.
SPACE, ENDS = " \t\n\x0b\f\r", ".!?"
#: Costs of edits, and of leaving a truncated row.
RESTORE, REROLE, DELETE, TRUNCATED = 3, 3, 4, 3
#: Audit letters; a letter's digit is its place here, from 1.
LETTERS = "DIKR"
DIGIT = {c: i + 1 for i, c in enumerate(LETTERS)}
#: Bits of a digit, and letters that a weight has room for.
BITS, WINDOW = 3, 128
RANK = BITS * WINDOW
COST = RANK + 2
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where a kept role leads to.
LEGAL = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
TURN_OF = {USER: "user", ASSISTANT: "assistant"}
FINAL = (START, ASSISTANT)


class Label(NamedTuple):
    """The least way to a node: weight, letters in the weight, digest of the repaired rows, audit put aside (a chain)."""

    weight: int
    used: int
    digest: Any
    aside: tuple | None


def other(state: int) -> int:
    """The node that a user or assistant row put after this one leads to."""
    return ASSISTANT if state == USER else USER


def plus(label: Label, letter: str, cost: int) -> int:
    return label.weight + (cost << COST) + (DIGIT[letter] << BITS * (WINDOW - 1 - label.used))


def shown(label: Label) -> str:
    """The letters in a label's weight."""
    return "".join(LETTERS[(label.weight >> BITS * (WINDOW - 1 - i) & 7) - 1] for i in range(label.used))


class Repair:
    """The labels of one conversation, layer by layer."""

    def __init__(self) -> None:
        self.labels = {START: Label(0, 0, hashlib.sha256(), None)}

    def _settle(self, ways: list[tuple[int, int, int, bytes | None]]) -> None:
        """The least of some ways to each node: (node, weight, node before, row said)."""
        best: dict[int, tuple[int, int, bytes | None]] = {}
        for node, *way in ways:
            if node not in best or way[0] < best[node][0]:
                best[node] = tuple(way)
        found = {}
        for node, (weight, before, said) in best.items():
            old = self.labels[before]
            if weight == old.weight:  # stays
                found[node] = old
                continue
            digest = old.digest
            if said is not None:
                digest = digest.copy()
                if before != START:
                    digest.update(b"\n")
                digest.update(said)
            found[node] = Label(weight, old.used + 1, digest, old.aside)
        self.labels = found

    def insert(self) -> None:
        """At most one row is worth inserting at a place: two would be a pair that can be left out."""
        stay = [(s, x.weight, s, None) for s, x in self.labels.items()]
        put = [(other(s), plus(x, "I", RESTORE), s, f"{TURN_OF[other(s)]}:".encode()) for s, x in self.labels.items()]
        self._settle(stay + put)

    def row(self, role: str, text: str, gone: bool, truncated: bool) -> None:
        """The next row; gone: it has to be deleted."""
        self.insert()
        ways = [(s, plus(x, "D", DELETE), s, None) for s, x in self.labels.items()]
        if not gone:
            more = TRUNCATED if truncated else 0
            said = {r: f"{r}:{text}".encode("utf-8", "surrogatepass") for r in {role, *TURN_OF.values()}}
            for s, x in self.labels.items():
                if (s, role[:1]) in LEGAL:
                    ways.append((LEGAL[s, role[:1]], plus(x, "K", more), s, said[role]))
                ways.append((other(s), plus(x, "R", REROLE + more), s, said[TURN_OF[other(s)]]))
        self._settle(ways)
        if max(x.used for x in self.labels.values()) > WINDOW - 3:
            self._put_aside()

    def _put_aside(self) -> None:
        """After a row, when none of the audits begins with another: their order stands for them."""
        low = (1 << COST) - 1
        order = sorted(self.labels, key=lambda s: self.labels[s].weight & low)
        for rank, s in enumerate(order):
            x = self.labels[s]
            self.labels[s] = Label((x.weight >> COST << COST) + (rank << RANK), 0, x.digest, (x.aside, shown(x)))

    def end(self) -> tuple[int, str, str]:
        """Cost, audit, and digest of the repaired rows."""
        self.insert()
        x = min((self.labels[s] for s in FINAL if s in self.labels), key=lambda x: x.weight)
        parts, aside = [shown(x)], x.aside
        while aside:
            parts.append(aside[1])
            aside = aside[0]
        return x.weight >> COST, "".join(reversed(parts)), x.digest.hexdigest()


class Conversation:
    """What is told of one conversation, from its rows in order."""

    COUNTS = ("blank", "duplicate", "truncated", "illegal")

    def __init__(self) -> None:
        self.repair = Repair()
        self.n = dict.fromkeys(self.COUNTS, 0)
        self.before: str | None = None
        self.least = self.last = None
        self.turns = 0

    def row(self, turn: int | None, role: str, text: str, again: bool) -> None:
        bare = text.rstrip(SPACE)
        fault = "blank" if not bare else "duplicate" if again else "truncated" if bare[-1] not in ENDS else None
        if fault:
            self.n[fault] += 1
        if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
            self.n["illegal"] += 1
        self.before = role[:1]
        if turn is not None:
            self.least = turn if self.least is None else self.least
            self.turns += turn != self.last
            self.last = turn
        self.repair.row(role, text, fault in ("blank", "duplicate"), fault == "truncated")

    def end(self) -> tuple:
        gaps = self.last - self.least + 1 - self.turns if self.turns else 0
        return (gaps, *self.n.values(), *self.repair.end())


TOLD = ("gaps", *Conversation.COUNTS, "cost", "audit", "repaired_sha256")
TOLD_KIND = ", ".join(f"{n} {'string' if n in ('audit', 'repaired_sha256') else 'long'}" for n in TOLD)


def _rows(turns: DataFrame, conv: str, turn: str, role: str, text: str, absent: Column | None) -> DataFrame:
    """conv_id, turn, role, text, absent, again (the same was said before)."""
    gone = F.lit(False) if absent is None else F.coalesce(absent, F.lit(False))
    filled = lambda c: F.when(gone, F.lit("")).otherwise(F.coalesce(F.col(c).cast("string"), F.lit(" ")))
    own = turns.select(F.col(conv).alias("conv_id"), F.when(~gone, F.col(turn).cast("long")).alias("turn"), filled(role).alias("role"), filled(text).alias("text"), gone.alias("absent"))
    said = Window.partitionBy("conv_id", "role", "text", "absent").orderBy(F.asc_nulls_first("turn"))
    return own.withColumn("again", F.row_number().over(said) > 1)


def _by_conversation(rows: DataFrame) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text", "again")


def repairs(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", absent: Column | None = None) -> DataFrame:
    """One row for each conversation: conv_id, gaps in its turns, rows by first fault, illegal neighbours, the cheapest repair's cost, audit and digest.

    absent: rows that only name a conversation; one with no others has zeros and an empty repair.
    """
    rows = _by_conversation(_rows(turns, conv, turn, role, text, absent))
    kind = rows.schema["conv_id"].dataType.simpleString()

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = object()
        last, own = nothing, Conversation()
        for b in batches:
            out: list[tuple] = []
            for who, t, r, x, gone, again in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "absent", "again")), strict=True):
                if who != last:
                    if last is not nothing:
                        out.append((last, *own.end()))
                    last, own = who, Conversation()
                if not gone:
                    own.row(t, r, x, again)
            yield _batch(out, b.schema.field("conv_id").type)
            ids = b.schema.field("conv_id").type
        if last is not nothing:
            yield _batch([(last, *own.end())], ids)

    return rows.mapInArrow(told, f"conv_id {kind}, {TOLD_KIND}")


def _batch(rows: list[tuple], ids: pa.DataType) -> pa.RecordBatch:
    kinds = [ids, *(pa.string() if n in ("audit", "repaired_sha256") else pa.int64() for n in TOLD)]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["conv_id", *TOLD])


def repaired(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", absent: Column | None = None) -> DataFrame:
    """The rows as repaired: conv_id, place (from 0), edit (its letter), turn (null for inserted rows), role, text.

    An audit goes before its conversation's rows into the same task, which reads both through.
    """
    own = _rows(turns, conv, turn, role, text, absent)
    audits = repairs(turns, conv, turn, role, text, absent).select(
        "conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(True).alias("absent"), F.lit(False).alias("again"), F.lit(0).alias("part")
    )
    both = own.filter("NOT absent").withColumn("part", F.lit(1)).unionByName(audits)
    rows = both.repartition("conv_id").sortWithinPartitions("conv_id", "part", F.asc_nulls_first("turn"), "role", "text", "again")
    kind = rows.schema["conv_id"].dataType.simpleString()

    def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, at, state, place, last = "", 0, START, 0, None
        for b in batches:
            out: list[tuple] = []

            def put(letter: str, t: int | None, r: str, x: str) -> None:
                nonlocal state, place
                state = LEGAL[state, r[:1]]
                out.append((last, place, letter, t, r, x))  # noqa: B023
                place += 1

            def inserts() -> None:
                nonlocal at
                while audit[at : at + 1] == "I":
                    put("I", None, TURN_OF[other(state)], "")  # noqa: B023
                    at += 1

            for who, part, t, r, x in zip(*(b.column(c).to_pylist() for c in ("conv_id", "part", "turn", "role", "text")), strict=True):
                if part == 0:
                    audit, at, state, place, last = x, 0, START, 0, who
                else:
                    letter, at = audit[at], at + 1
                    if letter == "R":
                        r = TURN_OF[other(state)]
                    if letter != "D":
                        put(letter, t, r, x)
                inserts()
            kinds = [b.schema.field("conv_id").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names=["conv_id", "place", "edit", "turn", "role", "text"])

    return rows.mapInArrow(applied, f"conv_id {kind}, place long, edit string, turn long, role string, text string")


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with faults that a checksum of id and turn decides: rows dropped (absent), emptied, without sentence ends, repeated, or said by the user."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat_ws(":", space("conv_id"), space("turn"))) % 20
    role = F.when(h == 4, F.lit("user")).otherwise(space("role"))
    text = F.when(h == 1, F.lit("")).when(h == 2, F.translate(space("text"), ENDS, "")).otherwise(space("text"))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), (h == 0).alias("absent"), F.when(h == 3, 2).otherwise(1).alias("n"))
    return rows.select("conv_id", "turn", "role", "text", "absent", F.explode(F.sequence(F.lit(1), "n"))).drop("col")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repairs of all damaged conversations; odd rows as in the module's docstring."""
    rows = damaged(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return repairs(rows, absent=F.col("absent"))


def _sql() -> str:
    """DuckDB: the same by a recursion over rows, with labels of (cost, audit, repaired text) for each of the four nodes."""
    none = "CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, o VARCHAR))"

    def edge(x: str, letter: str, cost: str, said: str | None = None, when: str = "true") -> str:
        text = f"{x}.o" if said is None else f"{x}.o || CASE WHEN {x}.o = '' THEN '' ELSE chr(10) END || {said}"
        return f"CASE WHEN {x} IS NOT NULL AND {when} THEN {{'c': {x}.c + {cost}, 'a': {x}.a || '{letter}', 'o': {text}}} ELSE {none} END"

    def least(*ways: str) -> str:
        return f"list_sort(list_filter([{', '.join(ways)}], lambda x: x IS NOT NULL))[1]"

    put = lambda i: f"""n AS n, s AS s, {least(f"{i}u", *(edge(f"{i}{x}", "I", "3", "'user:'") for x in "nsa"))} AS u, {least(f"{i}a", edge(f"{i}u", "I", "3", "'assistant:'"))} AS a"""
    kept = "NOT gone"
    more = "CASE WHEN cut THEN 3 ELSE 0 END"
    line = "role || ':' || text"
    step = ", ".join([
        f"{edge('n', 'D', '4')} AS n",
        f"{least(edge('s', 'D', '4'), edge('n', 'K', more, line, kept + chr(32) + 'AND ini = ' + repr('s')))} AS s",
        least(edge("u", "D", "4"), *(edge(x, "K", more, line, f"{kept} AND ini = 'u'") for x in "nsa"), *(edge(x, "R", f"3 + {more}", "'user:' || text", kept) for x in "nsa")) + " AS u",
        least(edge("a", "D", "4"), edge("u", "K", more, line, f"{kept} AND ini = 'a'"), edge("u", "R", f"3 + {more}", "'assistant:' || text", kept)) + " AS a",
    ])
    return f"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: xor(c >> 1, CASE WHEN (c & 1) = 1 THEN 3988292384 ELSE 0 END), n)) AS t),
raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ord(x) AS BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 20 AS h FROM conversations, tab),
hurt AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(0, CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS copy FROM raw WHERE h <> 0),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again, substr(role, 1, 1) AS ini,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM hurt),
judged AS (SELECT *, bare = '' AS blank, bare <> '' AND again AS dup, bare <> '' AND NOT again AND right(bare, 1) NOT IN ('.', '!', '?') AS cut, bare = '' OR again AS gone,
    lag(ini) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM seen),
told AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, count(*) FILTER (cut) AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS last FROM judged GROUP BY conv_id),
dp AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, {{'c': CAST(0 AS BIGINT), 'a': '', 'o': ''}} AS n, {none} AS s, {none} AS u, {none} AS a FROM told
  UNION ALL SELECT conv_id, i, {step}
  FROM (SELECT j.conv_id, j.i, j.role, j.text, j.ini, j.cut, j.gone, {put('')} FROM dp JOIN judged j ON j.conv_id IS NOT DISTINCT FROM dp.conv_id AND j.i = dp.i + 1)),
done AS (SELECT conv_id, {least('n', 'a')} AS x FROM (SELECT conv_id, {put('')} FROM dp JOIN told t USING (conv_id) WHERE i = last))
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
  CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(x.c, 0) AS BIGINT) AS cost, coalesce(x.a, '') AS audit, sha256(coalesce(x.o, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN told USING (conv_id) LEFT JOIN done USING (conv_id)"""


SQL = {"op12_conversation_repair": _sql()}
