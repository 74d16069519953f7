"""Operator 13: repair of the structure of conversations by the cheapest edits.

Rows are brought together by conversation and sorted by turn within partitions, so conversations stream through tasks of
which none holds one whole. Dynamic programming runs backwards, from the last turn to the first: its state, what each state of
the role grammar still costs, is carried from batch to batch. A row gets a byte, the cheapest first edit
(of equals the ASCII-least) from each of the grammar's four states. Spark's sorter, which spills, then turns the rows of a
partition round, and a second pass follows these bytes from the first turn on. No further shuffle is needed, and of a giant
conversation nothing is held but its state and its audit string.
"""

from __future__ import annotations

import functools
import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\x0c\r"
LETTERS = "DIKR"
#: Costs of edits; TRUNCATED is added where a truncated row stays.
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: States of the grammar (s?(ua)+)?: nothing yet, after s, after u, after a; where a user or assistant turn leads; where it may end.
START, S, U, A = range(4)
TURN = (U, U, A, U)
KEPT = {(START, "s"): S, (START, "u"): U, (S, "u"): U, (A, "u"): U, (U, "a"): A}
ROLES = {U: "user", A: "assistant"}
AFTER_LAST = (0, 2 * INSERT, INSERT, 0)
EDIT = "conv_id long, place long, edit string, turn long, role string, text string"
AUDIT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone of rows damaged by the hash of `conv_id:turn` (nulls: one space, also in role and text).

    A dropped row stays as a marker (gone) without role and text, so that its conversation is known.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    row = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), part("role").alias("role"), part("text").alias("text"), kind.alias("_kind"))
    text = F.when(F.col("_kind") <= 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 0, "").when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("_kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return row.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("_kind") == 0).alias("gone"), F.explode(copies).alias("_copy")).drop("_copy")


def marked(rows: DataFrame) -> DataFrame:
    """Rows by conversation with their first fault (blank, duplicate, truncated or null) and `copy`, their number among equal ones.

    One shuffle, by conversation; equal rows of a conversation are told apart within its partition.
    """
    last = F.right(F.rtrim("text", F.lit(WHITE)), F.lit(1))
    order = Window.partitionBy("conv_id", "role", "_hash", "gone").orderBy(F.asc_nulls_first("turn"))
    got = rows.select("conv_id", "turn", "role", "text", "gone", F.sha2("text", 256).alias("_hash"), last.alias("_last")).repartition("conv_id").withColumn("copy", F.row_number().over(order))
    fault = F.when(F.col("gone"), None).when(F.col("_last") == "", "blank").when(F.col("copy") > 1, "duplicate").when(~F.col("_last").isin(".", "!", "?"), "truncated")
    return got.select("conv_id", "turn", "role", "text", "gone", "copy", fault.alias("fault"))


def planned(rows: DataFrame) -> DataFrame:
    """Marked rows (from marked) with `moves`, partition by partition in ascending order of conversation and turn.

    Nulls come first; rows of one turn are ordered by role and text, equal ones by their copy number.
    """
    down = rows.sortWithinPartitions(F.desc("conv_id"), F.desc_nulls_last("turn"), F.desc("role"), F.desc("text"), F.desc("copy"))
    # ids and turns travel as text: pandas would make floats of long columns with nulls
    texts = down.withColumns({c: F.col(c).cast("string") for c in ("conv_id", "turn")})
    got = texts.mapInPandas(_backwards, ", ".join([*(f"`{c}` {t}" for c, t in texts.dtypes), "moves int"]))
    back = got.selectExpr(*(f"cast(`{c}` as {t}) as `{c}`" for c, t in rows.dtypes), "moves")
    return back.sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text", "copy")


@functools.cache
def step(after: tuple, initial: str, required: bool, truncated: bool) -> tuple:
    """(what each state costs from before a row on, less the least of them, and the byte of moves), given that from after it.

    Costs relative to the least one take few values, so that a row is one look-up.
    """
    stays = TRUNCATED if truncated else 0
    options = []
    for state in range(4):
        own = {"D": DELETE + after[state]}
        if not required:
            own["R"] = REROLE + stays + after[TURN[state]]
            if (state, initial) in KEPT:
                own["K"] = stays + after[KEPT[state, initial]]
        options.append(own)
    costs = [min(own.values()) for own in options]
    for _ in range(3):  # inserted turns before the row: no state comes twice
        costs = [min(c, INSERT + costs[TURN[state]]) for state, c in enumerate(costs)]
    moves = 0
    for state, own in enumerate(options):
        own["I"] = INSERT + costs[TURN[state]]
        moves |= LETTERS.index(min(x for x, c in own.items() if c == costs[state])) << 2 * state
    return tuple(c - min(costs) for c in costs), moves


def _backwards(frames):
    import numpy as np

    at, costs = object(), AFTER_LAST
    for frame in frames:
        moves = np.zeros(len(frame), np.int32)
        for k, (conv, role, gone, fault) in enumerate(zip(*(frame[c].tolist() for c in ("conv_id", "role", "gone", "fault")))):
            if conv != at:
                at, costs = conv, AFTER_LAST
            if not gone:
                initial = role[:1] if role[:1] in ("s", "u", "a") else ""
                costs, moves[k] = step(costs, initial, fault in ("blank", "duplicate"), fault == "truncated")
        yield frame.assign(moves=moves)


class Follow:
    """Follows the moves of one conversation from its first row on."""

    def __init__(self):
        self.state, self.cost = START, 0

    def row(self, role: str, text: str, fault, moves: int):
        """(edit, role, text) of the row, after those of the turns inserted before it."""
        while (letter := LETTERS[moves >> 2 * self.state & 3]) == "I":
            yield self._insert()
        if letter == "D":
            self.cost += DELETE
        else:
            self.cost += (REROLE if letter == "R" else 0) + (TRUNCATED if fault == "truncated" else 0)
            self.state = TURN[self.state] if letter == "R" else KEPT[self.state, role[:1]]
            role = ROLES[self.state] if letter == "R" else role
        yield letter, role, text

    def end(self):
        while self.state in (S, U):
            yield self._insert()

    def _insert(self):
        self.state = TURN[self.state]
        self.cost += INSERT
        return "I", ROLES[self.state], ""


def _conversations(frames, begin, each, end):
    """Calls each for every row and end for every conversation, across batches; yields what they return, batch by batch."""
    at, held, open_ = None, None, False
    for frame in frames:
        out: list = []
        for conv, turn, role, text, gone, fault, moves in zip(*(frame[c].tolist() for c in ("conv_id", "turn", "role", "text", "gone", "fault", "moves"))):
            if not open_ or conv != at:
                if open_:
                    out += end(at, held)
                at, held, open_ = conv, begin(), True
            if not gone:
                out += each(at, held, None if turn is None else int(turn), role, text, fault, moves)
        yield out
    if open_:
        yield end(at, held)


def _frame(rows: list, schema: str):
    import pandas as pd

    names = [x.split()[0] for x in schema.split(", ")]
    return pd.DataFrame({c: pd.Series(list(v), dtype=object) for c, v in zip(names, zip(*rows) if rows else [()] * len(names))})


def _edits(frames):
    def begin():
        return [Follow(), 0]

    def told(conv, held, turn, edits):
        out = []
        for letter, role, text in edits:
            out.append((None if conv is None else int(conv), held[1], letter, turn if letter != "I" else None, role, text))
            held[1] += 1
        return out

    each = lambda conv, held, turn, role, text, fault, moves: told(conv, held, turn, held[0].row(role, text, fault, moves))
    for rows in _conversations(frames, begin, each, lambda conv, held: told(conv, held, None, held[0].end())):
        yield _frame(rows, EDIT)


class Audit:
    """What a conversation's row of the audit needs: counts, and a hash that takes in the repaired rows one by one."""

    def __init__(self):
        self.follow, self.hash, self.letters, self.lines = Follow(), hashlib.sha256(), [], 0
        self.first = self.last = self.before = None
        self.turns = self.illegal = 0
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}

    def take(self, edits):
        for letter, role, text in edits:
            self.letters.append(letter)
            if letter != "D":
                self.hash.update((b"\n" if self.lines else b"") + f"{role}:{text}".encode())
                self.lines += 1

    def row(self, turn, role, text, fault, moves):
        if turn is not None and turn != self.last:
            self.first, self.last, self.turns = turn if self.first is None else self.first, turn, self.turns + 1
        if fault is not None:
            self.faults[fault] += 1
        self.illegal += self.before is not None and self.before + role[:1] not in ("su", "ua", "au")
        self.before = role[:1]
        self.take(self.follow.row(role, text, fault, moves))
        if len(self.letters) > 4096:
            self.letters = ["".join(self.letters)]

    def end(self, conv):
        self.take(self.follow.end())
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return [(None if conv is None else int(conv), gaps, *self.faults.values(), self.illegal, self.follow.cost, "".join(self.letters), self.hash.hexdigest())]


def _audits(frames):
    def each(conv, held, *row):
        held.row(*row)
        return []

    for rows in _conversations(frames, Audit, each, lambda conv, held: held.end(conv)):
        yield _frame(rows, AUDIT)


def _followed(rows: DataFrame, by, schema: str) -> DataFrame:
    plan = planned(marked(rows))
    return plan.withColumns({c: F.col(c).cast("string") for c in ("conv_id", "turn")}).select("conv_id", "turn", "role", "text", "gone", "fault", "moves").mapInPandas(by, schema)


def repaired(rows: DataFrame) -> DataFrame:
    """conv_id, place, edit (K, R, D or I), turn, role, text: every row of conversations (conv_id, turn, role, text, gone) and every inserted one in their repaired order; those that stay form a conversation of the grammar (s?(ua)+)?."""
    return _followed(rows, _edits, EDIT)


def audit(rows: DataFrame) -> DataFrame:
    """Per conversation of rows (conv_id, turn, role, text, gone; conv_id and turn may be null): gaps, faults, illegal neighbours, the cheapest edits and the digest of what they leave.

    Null ids form one conversation; rows without a turn come first; turns may repeat: their rows are ordered by role and
    text. A conversation of gone rows only has zeros, an empty audit and the hash of an empty text. No rows: no result.
    """
    return _followed(rows, _audits, AUDIT)


_PART = "coalesce(CAST({} AS VARCHAR), ' ')"
_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_ADD = "CASE WHEN {x} IS NULL THEN NULL ELSE {{'c': {x}.c + {c}, 'a': {x}.a || '{a}', 't': {t}}} END"


def _oracle() -> str:
    """The forward form of the search: per row, the cheapest and then least (cost, audit) that reaches each state of the grammar."""
    line = lambda x, who: f"coalesce({x}.t || chr(10), '') || {who}"
    drop = lambda x: _ADD.format(x=x, c=DELETE, a="D", t=f"{x}.t")
    keep = lambda x, i: f"CASE WHEN NOT must AND ini = '{i}' THEN {_ADD.format(x=x, c='late', a='K', t=line(x, 'said'))} END"
    role = lambda x, r: f"CASE WHEN NOT must THEN {_ADD.format(x=x, c=f'{REROLE} + late', a='R', t=line(x, f"'{r}:' || text"))} END"
    put = lambda x, r: _ADD.format(x=x, c=INSERT, a="I", t=line(x, f"'{r}:'"))
    least = lambda *xs: f"list_min(list_filter([{', '.join(xs)}], lambda q: q IS NOT NULL))"
    closed = lambda src: f"SELECT * EXCLUDE (u, a), {least('u', *(put(x, 'user') for x in ('o', 's', 'a')))} AS u, {least('a', put('u', 'assistant'))} AS a FROM ({src})"
    nothing = "NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR)"
    first = closed(closed(closed(f"SELECT conv_id, 0 AS k, {{'c': 0::BIGINT, 'a': '', 't': NULL::VARCHAR}} AS o, {nothing} AS s, {nothing} AS u, {nothing} AS a FROM ids")))
    moved = f"""SELECT q.conv_id, q.k + 1 AS k, {drop('o')} AS o, {least(drop('s'), keep('o', 's'))} AS s, {least(drop('u'), *(f(x, y) for x in ('o', 's', 'a') for f, y in ((keep, 'u'), (role, 'user'))))} AS u,
{least(drop('a'), keep('u', 'a'), role('u', 'assistant'))} AS a FROM q JOIN f ON f.conv_id IS NOT DISTINCT FROM q.conv_id AND f.k = q.k + 1"""
    return f"""WITH RECURSIVE tb AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
h AS (SELECT *, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split({_PART.format('conv_id')} || ':' || {_PART.format('turn')}, ''), lambda x: CAST(ord(x) AS BIGINT))), lambda c, b: xor(t[CAST(xor(c, b) & 255 AS INT) + 1], c >> 8))) % 20 AS kind FROM conversations, tb),
d AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE coalesce(role, ' ') END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(coalesce(text, ' '), '.!?', '') ELSE coalesce(text, ' ') END AS text, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE kind > 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS k, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS same, right(rtrim(text, {_WHITE}), 1) AS fin FROM d),
g AS (SELECT *, CASE WHEN fin = '' THEN 'blank' WHEN same > 1 THEN 'duplicate' WHEN fin NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) || left(role, 1) AS two FROM n),
f AS (SELECT conv_id, k, left(role, 1) AS ini, fault IN ('blank', 'duplicate') AS must, CASE fault WHEN 'truncated' THEN {TRUNCATED} ELSE 0 END AS late, text, role || ':' || text AS said FROM g),
ids AS (SELECT DISTINCT conv_id FROM conversations),
q AS ({first} UNION ALL {closed(closed(closed(moved)))}),
z AS (SELECT conv_id, {least('o', 'a')} AS best FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY k DESC) AS top FROM q) WHERE top = 1),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY conv_id)
SELECT z.conv_id, {', '.join(f'CAST(coalesce(c.{x}, 0) AS BIGINT) AS {x}' for x in ('gaps', 'blank', 'duplicate', 'truncated', 'illegal'))}, best.c AS cost, best.a AS audit, sha256(coalesce(best.t, '')) AS repaired_sha256 FROM z LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM z.conv_id"""


ORACLE = _oracle()
