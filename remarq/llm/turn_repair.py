"""Operator 13: repairs the structure of conversations by a checkpointed dynamic program.

A repaired conversation is empty, or a system turn or none followed by pairs of user and assistant turns. Every turn is kept, given another role, or deleted, and
empty turns are inserted, at the least cost in all; of equally cheap edits those whose initials come first in ASCII are taken.

Costs to go are vectors of four states (nothing yet, after the system turn, after a user, after an assistant). Turns in order are cut into blocks of about the
square root of the table's rows; a block's effect on such a vector is a four-by-four table of least costs. From the last block to the first these give the vector at each
block's end, the checkpoints, and no other vector is stored. Going forward, a block's own vectors are recomputed from its checkpoint, the edits that keep to the least cost are
taken letter by letter, and the vectors go again.

Each step is a Spark job: turns are sorted by ranges of conversation and turn, so one long conversation is cut over many tasks; tables and checkpoints are narrow rows; only the walk forward follows
one conversation through one task, since its edits and its digest follow each other, and it holds one block at a time (and the letters of its result).

Defined cases: null roles and texts are one space; turns are ordered by turn (nulls first), role, text; equal rows follow each other, and all but the first are duplicates; a null conversation is
one too; roles count by their first character, and those that begin with none of s, u, a can only be given another role or deleted; very long texts are rows like others, and end a block;
a conversation without turns gives zeros, an empty audit and the digest of nothing; empty tables give no rows; other columns are ignored whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored
from .columns import column

SPACES = " \t\n\x0b\x0c\r"
RE_ROLE, DELETE, INSERT, STUMP = 2, 3, 2, 1
#: Faults of a turn, as digits: none, cut off, seen before, blank.
FINE, TRUNCATED, DUPLICATE, BLANK = range(4)
#: Rows of a block at least, and characters of texts at which one ends.
LEAST_BLOCK, BLOCK_CHARS = 64, 4 << 20
#: Characters of a text that take part in cutting ranges; texts that agree on them lie in one range.
RANGE_CHARS = 64
FAR = 1 << 40
#: The state after the turn that each state asks for, and that turn's role.
ASKED, ROLE = (2, 2, 3, 2), ("user", "user", "assistant", "user")
#: States after a kept turn, by its role's initial.
KEPT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
INITIALS = "sua"
#: Costs to go where no turn is left.
AT_END = np.array([0, 2 * INSERT, INSERT, 0])


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least sums over the states in between."""
    return (a[:, :, None] + b[None]).min(axis=1)


def _tables() -> dict[int, np.ndarray]:
    """By initial (0 to 2, 3 for others) + 4 * fault: the least cost of going from state to state over a turn, insertions before it included."""
    same = np.where(np.eye(4, dtype=bool), 0, FAR)
    once = same.copy()
    for q, r in enumerate(ASKED):
        once[q, r] = INSERT
    inserted = _times(_times(once, once), once)
    found = {}
    for fault in range(4):
        for i in range(4):
            own = np.where(np.eye(4, dtype=bool), DELETE, FAR)
            if fault in (FINE, TRUNCATED):
                more = STUMP * (fault == TRUNCATED)
                for q, r in enumerate(ASKED):
                    own[q, r] = min(own[q, r], RE_ROLE + more)
                for q, r in KEPT[INITIALS[i]].items() if i < 3 else ():
                    own[q, r] = min(own[q, r], more)
            found[i + 4 * fault] = np.minimum(_times(inserted, own), FAR)
    return found


TABLES = _tables()
IDENTITY = np.where(np.eye(4, dtype=bool), 0, FAR)


def _rest(code: int, n: int) -> np.ndarray | None:
    """The table of a row's copies after the first: each must go."""
    if n < 2:
        return None
    again = BLANK if code >= 4 * BLANK else DUPLICATE
    return TABLES[code % 4 + 4 * again] + DELETE * (n - 2)  # insertions between deletions are as well made before all


def block_table(codes: bytes, copies: list[int]) -> np.ndarray:
    out = IDENTITY
    for code, n in zip(codes, copies, strict=True):
        if n:
            out = _times(out, TABLES[code])
            if (rest := _rest(code, n)) is not None:
                out = _times(out, rest)
    return np.minimum(out, FAR)


def _edits_before_and_on(state: int, code: int, here: np.ndarray, after: np.ndarray) -> tuple[str, int]:
    """The letters of insertions before a turn and of the edit on it, each the first in ASCII that keeps to the least cost; and the state after. ``here`` and ``after`` are costs to go."""
    said = ""
    fault, initial = divmod(code, 4)
    more = STUMP * (fault == TRUNCATED)
    while True:
        left = here[state]
        if left == DELETE + after[state]:
            return said + "D", state
        if left == INSERT + here[ASKED[state]]:
            said, state = said + "I", ASKED[state]
            continue
        kept = KEPT[INITIALS[initial]].get(state) if initial < 3 else None
        if kept is not None and left == more + after[kept]:
            return said + "K", kept
        return said + "R", ASKED[state]


def walk(state: int, codes: bytes, copies: list[int], end: np.ndarray) -> tuple[list[str], int]:
    """For every row the letters of its edits with the insertions before it, and the state after the block; vectors are recomputed from the checkpoint ``end``."""
    after, vectors = end, []
    for code, n in zip(reversed(codes), reversed(copies), strict=True):
        if n:
            rest = _rest(code, n)
            after_first = after if rest is None else (rest + after).min(axis=1)
            here = (TABLES[code] + after_first).min(axis=1)
            vectors.append((here, after_first))
            after = here
        else:
            vectors.append((after, after))
    said = []
    for code, n in zip(codes, copies, strict=True):
        here, after_first = vectors.pop()
        if not n:
            said.append("")
            continue
        letters, state = _edits_before_and_on(state, code, here, after_first)
        said.append(letters + "D" * (n - 1))
    return said, state


def marked(turns: DataFrame) -> DataFrame:
    """From ``conv_id, turn, role, text, copies``: one row for equal ones with the sum of their copies (0: the conversation alone), and ``code``, its initial and first fault."""
    one = turns.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    stripped = F.rtrim(F.col("text"), F.lit(SPACES))
    digest = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"))
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    seen = one.withColumns({"stripped": stripped, "digest": digest, "place": place})
    first = seen.where("copies > 0").groupBy("conv_id", "digest").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("conv_id").alias("of"), F.col("digest").alias("d"), "first")
    met = seen.join(first, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("d")), "left")
    again = F.coalesce(F.col("first") < F.col("place"), F.lit(False))
    fault = F.when(F.col("stripped") == "", BLANK).when(again, DUPLICATE).when(F.substring("stripped", -1, 1).isin(".", "!", "?"), FINE).otherwise(TRUNCATED)
    initial = F.substring("role", 1, 1)
    number = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return met.select("conv_id", "turn", "role", "text", "copies", (number + 4 * fault).cast("int").alias("code"))


BLOCK_NAMES = ["conv_id", "part", "blk", "turns", "roles", "texts", "copies", "codes", "steps"]
_BLOCK = "part int, blk int, turns array<bigint>, roles array<string>, texts array<string>, copies array<bigint>, codes binary, steps array<bigint>"


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows of :func:`marked` in order, cut into blocks; (part, blk) orders them, ``steps`` is the block's table."""
    key = dict(rows.dtypes)["conv_id"]
    order = ["conv_id", "turn", "role"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part_id, n_blocks = TaskContext.get().partitionId(), 0
        numbers, words = pa.list_(pa.int64()), pa.list_(pa.string())
        names, kinds = BLOCK_NAMES, [pa.null(), pa.int32(), pa.int32(), numbers, words, words, numbers, pa.binary(), numbers]
        held: list[tuple] = []
        chars, of = 0, None

        def done() -> pa.RecordBatch:
            nonlocal held, chars, n_blocks
            turns, roles, texts, copies, codes = (list(c) for c in zip(*held, strict=True))
            steps = block_table(bytes(codes), copies).ravel().tolist()
            out = [[of], [part_id], [n_blocks], [turns], [roles], [texts], [copies], [bytes(codes)], [steps]]
            held, chars, n_blocks = [], 0, n_blocks + 1
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=names)

        for part in parts:
            kinds[0] = part.column(0).type
            for conv, turn, role, text, copies, code in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if held and (conv != of or len(held) >= size or chars >= BLOCK_CHARS):
                    yield done()
                of, chars = conv, chars + len(text)
                held.append((turn, role, text, copies, code))
        if held:
            yield done()

    ranged = rows.repartitionByRange(*order, F.substring("text", 1, RANGE_CHARS)).sortWithinPartitions(*order, "text")
    return ranged.mapInArrow(run, f"conv_id {key}, {_BLOCK}")


def checkpoints(cut: DataFrame) -> DataFrame:
    """part, blk, ``ahead``: the costs to go at every block's end, from the last block of each conversation to its first."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, vector = object(), AT_END
        for part in parts:
            out = []
            for conv, steps in zip(part.column(0).to_pylist(), part.column(3).to_pylist(), strict=True):
                if conv != of:
                    of, vector = conv, AT_END
                out.append(vector.tolist())
                vector = (np.array(steps).reshape(4, 4) + vector).min(axis=1)
            yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array(out, pa.list_(pa.int64()))], names=["p", "b", "ahead"])

    narrow = cut.select("conv_id", "part", "blk", "steps").repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("blk"))
    return narrow.mapInArrow(run, "p int, b int, ahead array<bigint>")


class _Walker:
    """One conversation on its way forward."""

    def __init__(self, conv: object):
        self.conv, self.state, self.steps, self.written_edits = conv, 0, 0, 0
        self.letters: list[str] = []
        self.faults = [0, 0, 0, 0]
        self.illegal, self.cost, self.initial = 0, 0, None
        self.least = self.most = self.turn = None
        self.turns = 0
        self.digest, self.written = hashlib.sha256(), False

    def _row(self, role: str, text: str) -> tuple[str, str]:
        self.digest.update((("\n" if self.written else "") + f"{role}:{text}").encode())
        self.written = True
        return role, text

    def _count(self, turn: int | None, role: str, code: int, copies: int) -> None:
        self.faults[code // 4] += 1
        if copies > 1:
            self.faults[BLANK if code >= 4 * BLANK else DUPLICATE] += copies - 1
        initial = role[:1]
        self.illegal += self.initial is not None and self.initial + initial not in ("su", "ua", "au")
        self.illegal += copies - 1  # like initials beside each other are never right
        self.initial = initial
        if turn is not None:
            self.turns += turn != self.turn
            self.turn, self.most = turn, turn
            self.least = turn if self.least is None else self.least

    def take(self, block: dict) -> Iterator[tuple]:
        """Edits of the block's turns: letter, turn, role, text (as they were if deleted)."""
        ahead = np.array(block["ahead"])
        if not self.steps:
            self.cost = int((np.array(block["steps"]).reshape(4, 4) + ahead).min(axis=1)[0])
        self.steps += 1
        said, after = walk(self.state, block["codes"], block["copies"], ahead)
        state = self.state
        for turn, role, text, copies, code, letters in zip(block["turns"], block["roles"], block["texts"], block["copies"], block["codes"], said, strict=True):
            if not copies:
                continue
            self._count(turn, role, code, copies)
            self.letters.append(letters)
            for letter in letters:
                if letter == "I":
                    yield "I", None, *self._row(ROLE[state], "")
                    state = ASKED[state]
                elif letter == "D":
                    yield "D", turn, role, text
                elif letter == "K":
                    yield "K", turn, *self._row(role, text)
                    state = KEPT[role[0]][state]
                else:
                    yield "R", turn, *self._row(ROLE[state], text)
                    state = ASKED[state]
        self.state = after

    def end(self) -> Iterator[tuple]:
        """Insertions after the last turn."""
        while AT_END[self.state]:
            self.letters.append("I")
            yield "I", None, *self._row(ROLE[self.state], "")
            self.state = ASKED[self.state]

    def figures(self) -> tuple:
        gaps = self.most - self.least + 1 - self.turns if self.turns else 0
        return self.conv, gaps, self.faults[BLANK], self.faults[DUPLICATE], self.faults[TRUNCATED], self.illegal, self.cost, "".join(self.letters), self.digest.hexdigest()


FIGURES = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
EDITS = "step long, edit string, turn long, role string, text string"


def _forward(cut: DataFrame, edits: bool) -> DataFrame:
    """Every conversation's edits, or its figures."""
    met = cut.join(checkpoints(cut), (F.col("part") == F.col("p")) & (F.col("blk") == F.col("b"))).drop("p", "b")
    names = [*BLOCK_NAMES, "ahead"]
    ordered = met.select(*names).repartition("conv_id").sortWithinPartitions("conv_id", "part", "blk")
    kind = f"conv_id {dict(cut.dtypes)['conv_id']}"

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [x.split() for x in (EDITS if edits else FIGURES).split(", ")]
        kinds = [pa.null(), *(pa.string() if kind == "string" else pa.int64() for _, kind in fields)]
        now, rows = None, []

        def taken(found: Iterator[tuple]) -> None:
            for x in found:
                now.written_edits += 1
                if edits:
                    rows.append((now.conv, now.written_edits, *x))

        def ended() -> None:
            if now is not None:
                taken(now.end())
                if not edits:
                    rows.append(now.figures())

        def batch() -> pa.RecordBatch:
            nonlocal rows
            out, rows = rows, []
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["conv_id", *(n for n, _ in fields)])

        for part in parts:
            kinds[0] = part.column(0).type
            for i in range(part.num_rows):
                block = {n: part.column(k)[i].as_py() for k, n in enumerate(names)}
                if now is None or block["conv_id"] != now.conv:
                    ended()
                    now = _Walker(block["conv_id"])
                taken(now.take(block))
                if rows and (edits or len(rows) >= 1000):
                    yield batch()
        ended()
        if rows:
            yield batch()

    return ordered.mapInArrow(run, f"{kind}, {EDITS if edits else FIGURES}")


def _cut(turns: DataFrame, n: int) -> DataFrame:
    return stored(blocks(marked(turns), max(LEAST_BLOCK, math.isqrt(n))), "conversation-blocks")


def plain(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Turns as they are, in the form that the other functions take."""
    spaced = {n: F.coalesce(column(c).cast("string"), F.lit(" ")) for n, c in (("role", role), ("text", text))}
    return conversations.select(column(key).alias("conv_id"), column(turn).cast("long").alias("turn"), *(c.alias(n) for n, c in spaced.items()), F.lit(1).alias("copies"))


def damaged(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Turns of which every twentieth each is dropped, emptied, robbed of its stops, repeated, or given to the user, by a checksum of conversation and turn."""
    own = plain(conversations, key, turn, role, text)
    spaced = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat_ws(":", *spaced).cast("binary")) % 20
    body = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    there = kind != 0
    return own.select(
        "conv_id",
        "turn",
        F.when(~there, "").when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(there, body).otherwise("").alias("text"),
        F.when(~there, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def edits(turns: DataFrame) -> DataFrame:
    """For ``conv_id, turn, role, text, copies`` every edit in order: conv_id, step, edit (K, R, D, I), and the turn, role and text that it leaves (of a deleted turn those it had)."""
    return _forward(_cut(turns, turns.count()), True)


def repaired(turns: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, step, turn (null for inserted ones), role, text."""
    return edits(turns).where("edit != 'D'").drop("edit")


def figures(turns: DataFrame) -> DataFrame:
    """A row per conversation: its faults, the cost, the edits' initials, and the digest of the repaired turns."""
    return _forward(_cut(turns, turns.count()), False)


def report(conversations: DataFrame, **names: str) -> DataFrame:
    """:func:`figures` of the damaged conversations."""
    return figures(damaged(conversations, **names))


def report_sql() -> str:
    """The same rows in DuckDB SQL: for every row and state in turn the cheapest edits so far, the first in ASCII among equals."""
    signs = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    spaced = [f"coalesce(CAST({c} AS VARCHAR), ' ')" for c in ("conv_id", "turn")]
    inserted = [(0, 0, 0, "", ""), (0, 2, 2, "I", "u"), (0, 4, 3, "II", "ua"), (1, 0, 1, "", ""), (1, 2, 2, "I", "u"), (1, 4, 3, "II", "ua"), (2, 0, 2, "", ""), (2, 2, 3, "I", "a"), (3, 0, 3, "", ""), (3, 2, 2, "I", "u")]
    texts = {"": "''", "u": "chr(10) || 'user:'", "a": "chr(10) || 'assistant:'", "ua": "chr(10) || 'user:' || chr(10) || 'assistant:'"}
    kept = [(i, a, b) for i, moves in KEPT.items() for a, b in moves.items()]
    return f"""
WITH RECURSIVE crcs AS (SELECT list(list_reduce([i] || range(8), lambda c, n: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab FROM range(256) t(i)),
raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  xor(list_reduce([4294967295::BIGINT] || list_transform(string_split({spaced[0]} || ':' || {spaced[1]}, ''), lambda x: CAST(ord(x) AS BIGINT)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind FROM conversations, crcs),
hurt AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) FROM raw WHERE kind <> 0),
places AS (SELECT *, rtrim(text, {signs}) AS bare, left(role, 1) AS ini, row_number() OVER w AS i FROM hurt WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
r AS MATERIALIZED (SELECT *, CASE WHEN bare = '' THEN 3 WHEN i > min(i) OVER (PARTITION BY conv_id, role, text) THEN 2 WHEN right(bare, 1) IN ('.', '!', '?') THEN 0 ELSE 1 END AS fault, lag(ini) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM places),
ins(q, cost, t, letters, lines) AS (VALUES {", ".join(f"({q}, {cost}, {t}, '{letters}', {texts[x]})" for q, cost, t, letters, x in inserted)}),
kept(ini, q, t) AS (VALUES {", ".join(f"('{i}', {a}, {b})" for i, a, b in kept)}),
asked(q, t, name) AS (VALUES {", ".join(f"({q}, {t}, '{ROLE[q]}')" for q, t in enumerate(ASKED))}),
convs AS (SELECT DISTINCT conv_id FROM conversations),
walk AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS q, {{'cost': 0, 'letters': '', 'lines': ''}} AS s FROM convs
  UNION ALL
  SELECT conv_id, i, t, min(s) AS s FROM (
    SELECT w.conv_id, r.i, e.t, {{'cost': w.s.cost + ins.cost + e.cost, 'letters': w.s.letters || ins.letters || e.letter, 'lines': w.s.lines || ins.lines || e.line}} AS s
    FROM walk w JOIN ins ON ins.q = w.q JOIN r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1,
      LATERAL (SELECT ins.t AS t, {DELETE} AS cost, 'D' AS letter, '' AS line
        UNION ALL SELECT k.t, CASE WHEN r.fault = 1 THEN {STUMP} ELSE 0 END, 'K', chr(10) || r.role || ':' || r.text FROM kept k WHERE r.fault < 2 AND k.ini = r.ini AND k.q = ins.t
        UNION ALL SELECT a.t, {RE_ROLE} + CASE WHEN r.fault = 1 THEN {STUMP} ELSE 0 END, 'R', chr(10) || a.name || ':' || r.text FROM asked a WHERE r.fault < 2 AND a.q = ins.t) e
  ) GROUP BY conv_id, i, t),
ends AS (SELECT w.conv_id, min({{'cost': s.cost + ins.cost, 'letters': s.letters || ins.letters, 'lines': s.lines || ins.lines}}) AS s
  FROM walk w JOIN ins ON ins.q = w.q AND ins.t IN (0, 3) JOIN (SELECT c.conv_id, count(r.i) AS n FROM convs c LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM c.conv_id GROUP BY c.conv_id) l ON l.conv_id IS NOT DISTINCT FROM w.conv_id AND l.n = w.i GROUP BY w.conv_id),
told AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 3) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 1) AS truncated,
  count(*) FILTER (before IS NOT NULL AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id)
SELECT ends.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(s.cost AS BIGINT) AS cost, s.letters AS audit, sha256(substr(s.lines, 2)) AS repaired_sha256
FROM ends LEFT JOIN told ON told.conv_id IS NOT DISTINCT FROM ends.conv_id"""
