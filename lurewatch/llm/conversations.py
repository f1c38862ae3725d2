"""Conversation repair by alignment with the alternating grammar ``(s?(ua)+)?``.

Turns of a conversation are aligned to each feasible length of the grammar's
string: a Wagner-Fischer table gives the cheapest edits (keep 0, change the role
1, delete 2, insert 5, a truncated turn that stays 5 more; blank and duplicate
turns must go).  Strings of the same end are suffixes of one another, so a table
filled from the end serves all their lengths.  Ukkonen's bands leave out cells
whose detour alone costs more than the bound; the bound doubles until a length
within it is found and then is the incumbent's cost for all others.  Lengths of
equal cost are told apart by their backtraced audits, the ASCII-least wins.

Spark sorts all turns once, by conversation and turn, into ranges: a range may
begin or end inside a conversation, and long conversations are cut into pieces
of ``PIECE`` turns besides, so no task holds one.  A piece is solved for
every state of the grammar it may be entered and left in (insertions belong to
the turn after them, so no audit of a piece begins another and least audits
compose), and a conversation's pieces are chained over these few results.
Conversations that lie whole inside a range, almost all, are done in the sort's own stage.

Duplicates are found by hash beforehand; their marks join the sort as rows of their own.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lurewatch.llm.scratch import Scratch
from lurewatch.llm.sql import crc32_ctes

#: Turns of a piece at most, and characters of their texts from which on it is closed.
PIECE, PIECE_CHARS = 256, 1 << 22
RETYPE, DELETE, INSERT, CUT = 1, 2, 5, 5
SPACE = " \t\n\x0b\x0c\r"
#: States: nothing yet, a system turn, a user turn or an assistant turn last.  Where a conversation may end, and what it takes to end elsewhere.
NONE, SYSTEM, USER, ASSISTANT = "-sua"
ENDS = {NONE: (0, ""), ASSISTANT: (0, ""), USER: (INSERT, "I"), SYSTEM: (2 * INSERT, "II")}
#: A turn: initial of its role, whether it must go, whether it is truncated.
Turn = tuple[str, bool, bool]


class Aligner:
    """Cheapest alignments of a list of turns."""

    def __init__(self, turns: list[Turn]):
        self.turns, self.tables = turns, {}
        self.least = DELETE * sum(must for _, must, _ in turns)

    @staticmethod
    def wanted(last: str, left: int) -> str:
        """Role of the target's turn with ``left`` turns to go, itself included."""
        return last if left % 2 else {USER: ASSISTANT, ASSISTANT: USER}[last]

    def table(self, last: str, bound: int) -> list[dict[int, int]]:
        """For each turn, cost of aligning it and all after it to the string's last 0, 1, ... turns, within the band."""
        if (last, bound) in self.tables:
            return self.tables[last, bound]
        n = len(self.turns)
        rows: list[dict[int, int]] = [{}] * n + [{0: 0}]
        for i in range(n - 1, -1, -1):
            initial, must, cut = self.turns[i]
            below, here, rest = rows[i + 1], {}, n - i
            for left in range(max(0, rest - bound // DELETE), rest + bound // INSERT + 1):
                options = []
                if left in below:
                    options.append(DELETE + below[left])
                if not must and left - 1 in below:
                    options.append(below[left - 1] + (RETYPE if initial != self.wanted(last, left) else 0) + (CUT if cut else 0))
                if left - 1 in here:
                    options.append(INSERT + here[left - 1])
                if options and min(options) <= bound:
                    here[left] = min(options)
            rows[i] = here
        self.tables[last, bound] = rows
        return rows

    def audit(self, rows: list[dict[int, int]], last: str, i: int, left: int) -> str:
        """ASCII-least edits of a cheapest alignment from turn ``i`` on."""
        out, far = [], 1 << 60
        while i < len(self.turns):
            cost = rows[i][left]
            if rows[i + 1].get(left, far) + DELETE == cost:
                out.append("D")
            elif rows[i].get(left - 1, far) + INSERT == cost:
                out.append("I")
                left -= 1
                continue
            else:
                out.append("K" if self.turns[i][0] == self.wanted(last, left) else "R")
                left -= 1
            i += 1
        return "".join(out)

    def within(self, entry: str, leave: str, bound: int) -> tuple[int, str] | None:
        n, found = len(self.turns), []
        if leave in (NONE, SYSTEM):
            if entry == leave:
                found.append((DELETE * n, None, n, 0, "D" * n))
            elif entry == NONE:
                found += [(DELETE * (n - 1) + CUT * cut, None, n, 0, "D" * k + "K" + "D" * (n - 1 - k)) for k, (initial, must, cut) in enumerate(self.turns) if initial == SYSTEM and not must]
        else:
            rows = self.table(leave, bound)
            first = ASSISTANT if entry == USER else USER
            fits = lambda left: left > 0 and self.wanted(leave, left) == first
            found += [(cost, rows, 0, left, "") for left, cost in rows[0].items() if fits(left) or left == 0 and entry == leave]
            if entry == NONE:
                for k, (initial, must, cut) in enumerate(self.turns):
                    if initial == SYSTEM and not must and DELETE * k <= bound:
                        found += [(DELETE * k + CUT * cut + cost, rows, k + 1, left, "D" * k + "K") for left, cost in rows[k + 1].items() if fits(left)]
        incumbent = min((x[0] for x in found), default=bound + 1)
        if incumbent > bound:
            return None
        return incumbent, min(before + (self.audit(rows, leave, i, left) if rows else "") for cost, rows, i, left, before in found if cost == incumbent)

    def cheapest(self, entry: str, leave: str, limit: int | None = None) -> tuple[int, str] | None:
        """(cost, audit) from one state to another, None if there is none or it costs more than ``limit``."""
        limit = DELETE * len(self.turns) + 2 * INSERT + CUT if limit is None else limit
        bound = min(limit, self.least + DELETE + INSERT)
        while bound >= 0:
            if found := self.within(entry, leave, bound):
                return found
            if bound >= limit:
                return None
            bound = min(limit, 2 * bound)
        return None

    def whole(self) -> tuple[int, str]:
        """(cost, audit) of a conversation."""
        best = DELETE * len(self.turns), "D" * len(self.turns)
        for leave in (ASSISTANT, USER, SYSTEM):
            extra, edits = ENDS[leave]
            if found := self.cheapest(NONE, leave, best[0] - extra):
                best = min(best, (found[0] + extra, found[1] + edits))
        return best


def chain(pieces: list[dict[str, tuple[int, str]]]) -> tuple[int, list[tuple[str, str]]]:
    """Cost of a conversation, and (state, audit) of each of its pieces; a piece maps entry + leave to (cost, audit).

    Audits so far are compared by rank: those of different states differ within their length.
    """
    best, back = {NONE: (0, 0)}, []
    for piece in pieces:
        options: dict[str, tuple] = {}
        for name, (cost, audit) in piece.items():
            entry, leave = name
            if entry in best:
                option = (best[entry][0] + cost, best[entry][1], audit, entry)
                options[leave] = min(options.get(leave, option), option)
        order = sorted(options, key=lambda s: options[s][1:3])
        best = {s: (options[s][0], order.index(s)) for s in order}
        back.append(options)
    cost, _, state = min((c + ENDS[s][0], rank, s) for s, (c, rank) in best.items())
    out, tail = [], ENDS[state][1]
    for options in reversed(back):
        _, _, audit, entry = options[state]
        out.append((entry, audit + tail))
        state, tail = entry, ""
    return cost, out[::-1]


def render(state: str, audit: str, roles: list[str], texts: list[str]) -> tuple[list[str], list[str]]:
    """Roles and texts after the edits."""
    out_roles, out_texts, at = [], [], 0
    for edit in audit:
        if edit != "I":
            role, text = roles[at], texts[at]
            at += 1
        if edit == "D":
            continue
        follows = "assistant" if state == USER else "user"
        out_roles.append(role if edit == "K" else follows)
        out_texts.append("" if edit == "I" else text)
        state = out_roles[-1][:1]
    return out_roles, out_texts


STATS = ["n", "lo", "hi", "n_turns", "first", "last", "blank", "duplicate", "truncated", "illegal"]
_TYPES = {"n": "long", "lo": "long", "hi": "long", "n_turns": "long", "first": "string", "last": "string", "blank": "long", "duplicate": "long", "truncated": "long", "illegal": "long"}
LEGAL = {"su", "ua", "au"}


def _solve(rows: list[tuple], whole: bool) -> dict:
    """Faults, edits and, if whole, the repair of a piece; rows: (turn, role, text, whether seen before)."""
    turns, counts, numbers, illegal = [], {"blank": 0, "duplicate": 0, "truncated": 0}, [], 0
    for turn, role, text, seen in rows:
        bare = text.rstrip(SPACE)
        fault = "blank" if not bare else "duplicate" if seen else "truncated" if bare[-1] not in ".!?" else None
        if fault:
            counts[fault] += 1
        if turns and turns[-1][0] + role[:1] not in LEGAL:
            illegal += 1
        turns.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        if turn is not None and numbers[-1:] != [turn]:
            numbers.append(turn)
    out = {"n": len(rows), "lo": numbers[0] if numbers else None, "hi": numbers[-1] if numbers else None, "n_turns": len(numbers),
           "first": turns[0][0] if turns else None, "last": turns[-1][0] if turns else None, **counts, "illegal": illegal, "whole": whole}
    roles, texts, aligner = [r[1] for r in rows], [r[2] for r in rows], Aligner(turns)
    if whole:
        out["cost"], out["audit"] = aligner.whole()
        out["roles"], out["texts"] = render(NONE, out["audit"], roles, texts)
        return out
    ways = {a + b: aligner.cheapest(a, b) for a, bs in ((NONE, "-sua"), (SYSTEM, "sua"), (USER, "ua"), (ASSISTANT, "ua")) for b in bs} if rows else {s + s: (0, "") for s in "-sua"}
    return out | {"cost": None, "audit": None, "ways": json.dumps({k: v for k, v in ways.items() if v}), "roles": roles, "texts": texts}


def _cut(names: list[str], arrow: pa.Schema):
    """Pieces of a sorted range of turns."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, number, out, size = TaskContext.get().partitionId(), 0, [], 0
        of, rows, chars, pieces, first, marked = None, [], 0, 0, True, None

        def piece(whole: bool) -> None:
            nonlocal number, rows, chars, pieces, size
            out.append(_solve(rows, whole) | {"conv_id": of[0], "part": part, "piece": number})
            number, pieces, size = number + 1, pieces + 1, size + chars
            rows, chars = [], 0

        def batch() -> pa.RecordBatch:
            nonlocal out, size
            made = pa.RecordBatch.from_arrays([pa.array([x.get(c) for x in out], arrow.field(c).type) for c in names], schema=arrow)
            out, size = [], 0
            return made

        for records in batches:
            for conv, turn, role, text, kind, row, copy in zip(*(records.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "kind", "row", "copy"))):
                if of is None or conv != of[0]:
                    if of is not None:
                        # the range's first conversation may have begun in the range before
                        if rows or not pieces:
                            piece(whole=not first and not pieces)
                        first = False
                    of, pieces = (conv,), 0
                if kind == 0:
                    marked = (row, copy)
                elif kind == 1:
                    rows.append((turn, role, text, marked == (row, copy)))
                    chars += len(text)
                    if len(rows) >= PIECE or chars >= PIECE_CHARS:
                        piece(whole=False)
                if len(out) >= 500 or size >= PIECE_CHARS:
                    yield batch()
        if of is not None and (rows or not pieces):
            piece(whole=False)
        if out:
            yield batch()

    return cut


def repair(turns: DataFrame, gone=None) -> DataFrame:
    """Repaired pieces: conv_id, part, piece (in order: part, then piece), whole, fault counts, cost, audit, roles and texts.

    ``turns`` has conv_id, turn, role and text; other columns are ignored.  Rows
    for which ``gone`` holds only name a conversation.  Turns go by number,
    nulls first, and within a number by role and hash of the text.  Null roles
    and texts count as one space; a null conv_id is a conversation.  ``cost`` of
    a conversation of several pieces stands on its first one.  A turn that says
    what an earlier one of the same role says is a duplicate, however far
    apart.  Texts may be of any length.  Conversations without turns have one
    empty piece; an empty table gives no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    scratch = Scratch(turns.sparkSession, "conversations")
    text, role = F.coalesce(F.col("text").cast("string"), F.lit(" ")), F.coalesce(F.col("role").cast("string"), F.lit(" "))
    named = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    copy = F.col("copy") if "copy" in turns.columns else F.lit(0)
    rows = scratch.write(turns.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.when(gone, 2).otherwise(1).alias("kind") if gone is not None else F.lit(1).alias("kind"),
                                      copy.cast("int").alias("copy"), F.monotonically_increasing_id().alias("row")).withColumn("hash", F.md5(F.concat_ws("\0", named, "role", "text"))))
    # duplicates: all but the first with the same hash
    place = F.struct("turn", "row", "copy")
    said = rows.filter("kind = 1").select("hash", place.alias("place"), "conv_id", "role")
    firsts = scratch.write(said.groupBy("hash").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("hash", "first"))
    marks = said.join(firsts.hint("merge"), "hash").filter("place > first").select(
        "conv_id", "place.turn", "role", F.lit("").alias("text"), F.lit(0).alias("kind"), "place.copy", "place.row", "hash")
    order = ["conv_id", "turn", "role", "hash", "row", "copy"]
    ranged = rows.unionByName(marks).repartitionByRange(*order).sortWithinPartitions(*order, "kind")
    shape = T.StructType([turns.schema["conv_id"], *T._parse_datatype_string(
        "part int, piece long, whole boolean, " + ", ".join(f"{k} {v}" for k, v in _TYPES.items()) + ", cost long, audit string, ways string, roles array<string>, texts array<string>").fields])
    pieces = scratch.write(ranged.mapInArrow(_cut(shape.names, to_arrow_schema(shape)), shape))
    columns = [c for c in shape.names if c != "ways"]
    rest = pieces.filter("not whole")

    def decide(some: pd.DataFrame) -> pd.DataFrame:
        some = some.sort_values(["part", "piece"])
        cost, chosen = chain([{k: tuple(v) for k, v in json.loads(w).items()} for w in some["ways"]])
        return pd.DataFrame({"part": some["part"], "piece": some["piece"], "cost": [cost] + [None] * (len(some) - 1), "state": [s for s, _ in chosen], "audit": [a for _, a in chosen]}).astype({"cost": "Int64"})

    chosen = scratch.write(rest.select("conv_id", "part", "piece", "ways").groupBy("conv_id").applyInPandas(decide, "part int, piece long, cost long, state string, audit string"))
    joined = rest.drop("cost", "audit", "ways").join(chosen.hint("merge"), ["part", "piece"])
    final = T.StructType([f for f in shape.fields if f.name != "ways"])
    final_arrow = to_arrow_schema(final)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [render(*x) for x in zip(*(batch.column(c).to_pylist() for c in ("state", "audit", "roles", "texts")))]
            made = {"roles": [r for r, _ in done], "texts": [t for _, t in done]}
            yield pa.RecordBatch.from_arrays([pa.array(made[c], final_arrow.field(c).type) if c in made else batch.column(c) for c in columns], schema=final_arrow)

    return pieces.filter("whole").select(*columns).unionByName(joined.mapInArrow(finish, final))


def summary(pieces: DataFrame) -> DataFrame:
    """One row for each conversation: gaps, blank, duplicate, truncated, illegal, cost, audit and the hash of the repaired turns.

    Pieces of a conversation are read in order and hashed as they come, so only its audit is ever held.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    shape = T.StructType([pieces.schema["conv_id"], *T._parse_datatype_string(
        "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string").fields])
    arrow = to_arrow_schema(shape)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, sums, out = None, {}, []

        def close() -> None:
            gaps = sums["hi"] - sums["lo"] + 1 - sums["n_turns"] if sums["lo"] is not None else 0
            out.append((of[0], gaps, *(sums[c] for c in ("blank", "duplicate", "truncated", "illegal", "cost")), "".join(sums["audit"]), sums["hash"].hexdigest()))

        for batch in batches:
            for piece in batch.to_pylist():
                if of is None or piece["conv_id"] != of[0]:
                    if of is not None:
                        close()
                    of = (piece["conv_id"],)
                    sums = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost", "n_turns"), 0) | {"lo": None, "hi": None, "last": None, "audit": [], "hash": hashlib.sha256(), "any": False}
                for c in ("blank", "duplicate", "truncated", "illegal", "cost", "n_turns"):
                    sums[c] += piece[c] or 0
                if piece["n"] and sums["last"] is not None and sums["last"] + piece["first"] not in LEGAL:
                    sums["illegal"] += 1
                sums["last"] = piece["last"] if piece["n"] else sums["last"]
                if piece["lo"] is not None:
                    sums["n_turns"] -= piece["lo"] == sums["hi"]
                    sums["lo"] = piece["lo"] if sums["lo"] is None else sums["lo"]
                    sums["hi"] = piece["hi"]
                sums["audit"].append(piece["audit"])
                for role, text in zip(piece["roles"], piece["texts"]):
                    sums["hash"].update((f"\n{role}:{text}" if sums["any"] else f"{role}:{text}").encode())
                    sums["any"] = True
            while len(out) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)
                out.clear()
        if of is not None:
            close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    whole, rest = pieces.filter("whole"), pieces.filter("not whole")
    return whole.mapInArrow(total, shape).unionByName(rest.repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece").mapInArrow(total, shape))


def damaged(conversations: DataFrame) -> DataFrame:
    """Turns after damage by hash of conversation and turn; those that it drops are marked ``gone`` and keep their conversation's name."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(blank("role"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return conversations.select("conv_id", "turn", "role", "text", kind.alias("kind")).select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), F.explode(copies).alias("copy"))


def op12_conversations(spark, sf_dir: str) -> DataFrame:
    """Faults, cheapest repair and its digest of every conversation of damaged ``conversations``."""
    rows = damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return summary(repair(rows, gone=F.col("gone")))


#: The grammar as a walk over its states, turn by turn, with the least (cost, audit) of each state; no tables and no lengths.
ORACLE_SQL = f"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name, row_number() OVER () AS rowno FROM conversations
), {crc32_ctes("raw", "name", doublings=10)}, hit AS (
  SELECT raw.*, crc32 % 20 AS kind FROM raw JOIN crc ON s = name
), rows_ AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, rowno, copy
  FROM hit, range(2) AS g(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(coalesce('=' || CAST(conv_id AS VARCHAR), '') || chr(0) || role || chr(0) || text), rowno, copy) AS i,
         regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') AS bare FROM rows_
), seen AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed
), t AS (
  SELECT conv_id, i, turn, role, text, left(role, 1) AS c, before, bare = '' AS blank, bare <> '' AND again AS duplicate, bare <> '' AND NOT again AND right(bare, 1) NOT IN ('.', '!', '?') AS truncated FROM seen
), move(state, c, edits, cost, next, made) AS (
  -- insertions before the turn, then the turn; '*' stands for any role
  VALUES ('-', 's', '', 0, 's', ''), ('-', 'u', '', 0, 'u', ''), ('s', 'u', '', 0, 'u', ''), ('a', 'u', '', 0, 'u', ''), ('u', 'a', '', 0, 'a', ''),
         ('-', 'a', 'I', 5, 'a', 'u'), ('s', 'a', 'I', 5, 'a', 'u'), ('a', 'a', 'I', 5, 'a', 'u'), ('u', 'u', 'I', 5, 'u', 'a'),
         ('s', 'u', 'II', 10, 'u', 'ua'), ('a', 'u', 'II', 10, 'u', 'ua'), ('-', 'u', 'II', 10, 'u', 'ua'), ('u', 'a', 'II', 10, 'a', 'au')
), gap(state, edits, cost, next, made) AS (
  -- insertions before a turn that goes
  VALUES ('-', '', 0, '-', ''), ('s', '', 0, 's', ''), ('u', '', 0, 'u', ''), ('a', '', 0, 'a', ''), ('-', 'I', 5, 'u', 'u'), ('s', 'I', 5, 'u', 'u'), ('a', 'I', 5, 'u', 'u'), ('u', 'I', 5, 'a', 'a')
), step AS (
  SELECT t.conv_id, t.i, m.state, m.next, m.cost + CASE WHEN t.c = m.c THEN 0 ELSE 1 END + CASE WHEN truncated THEN 5 ELSE 0 END AS cost, m.edits || CASE WHEN t.c = m.c THEN 'K' ELSE 'R' END AS edits,
         list_concat(list_transform(list_filter(string_split(m.made, ''), lambda x: x <> ''), lambda x: CASE x WHEN 'u' THEN 'user:' ELSE 'assistant:' END), [CASE WHEN t.c = m.c THEN t.role WHEN m.c = 'u' THEN 'user' ELSE 'assistant' END || ':' || t.text]) AS made
  FROM t JOIN move m ON t.c = m.c OR m.c <> 's' WHERE NOT blank AND NOT duplicate
  UNION ALL
  SELECT t.conv_id, t.i, g.state, g.next, g.cost + 2, g.edits || 'D', list_transform(list_filter(string_split(g.made, ''), lambda x: x <> ''), lambda x: CASE x WHEN 'u' THEN 'user:' ELSE 'assistant:' END) FROM t, gap g
), walk AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, '-' AS state, {{'cost': 0::BIGINT, 'audit': '', 'made': []::VARCHAR[]}} AS best FROM conversations
  UNION ALL
  SELECT w.conv_id, s.i, s.next, min({{'cost': w.best.cost + s.cost, 'audit': w.best.audit || s.edits, 'made': list_concat(w.best.made, s.made)}})
  FROM walk w JOIN step s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.i = w.i + 1 AND s.state = w.state GROUP BY w.conv_id, s.i, s.next
), ends(state, cost, edits, made) AS (
  VALUES ('-', 0, '', []::VARCHAR[]), ('a', 0, '', []), ('u', 5, 'I', ['assistant:']), ('s', 10, 'II', ['user:', 'assistant:'])
), facts AS (
  SELECT c.conv_id, count(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE duplicate) AS duplicate,
         count(*) FILTER (WHERE truncated) AS truncated, count(*) FILTER (WHERE before || c NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM c.conv_id GROUP BY c.conv_id
), done AS (
  SELECT w.conv_id, min({{'cost': w.best.cost + e.cost, 'audit': w.best.audit || e.edits, 'made': list_concat(w.best.made, e.made)}}) AS best
  FROM walk w JOIN facts f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.n = w.i JOIN ends e ON e.state = w.state GROUP BY w.conv_id
)
SELECT f.conv_id, gaps, blank, duplicate, truncated, illegal, CAST(best.cost AS BIGINT) AS cost, best.audit AS audit, sha256(array_to_string(best.made, chr(10))) AS repaired_sha256
FROM facts f JOIN done d ON d.conv_id IS NOT DISTINCT FROM f.conv_id
"""
