"""Conversation structure repair: a generalised LR parse over the role grammar with weighted edits.

The stack is a graph: its nodes are shared by all parses of a conversation, and of the parses whose stacks have the same top only the one
with the least (cost, audit) goes on. Two tops that are equal accept the same rest here, so nothing better is lost.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACES, Scratch, named

# A conversation C is empty, or pairs P of user and assistant, behind one system row or none; symbols are initials of roles
GRAMMAR = (("C", ""), ("C", "P"), ("C", "sP"), ("P", "ua"), ("P", "Pua"))
ROLES = {"u": "user", "a": "assistant"}  # what rows can be given or inserted as
LEGAL = ("su", "ua", "au")
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1

Stack = tuple  # (state, the stack below), () under the first


@lru_cache(1)
def automaton() -> tuple[dict, dict]:
    """LR(0) item sets: (state, symbol) -> state, and the production other than the start's that a state completes."""
    heads = {h for h, _ in GRAMMAR}

    def closed(items: frozenset) -> frozenset:
        while True:
            wanted = {GRAMMAR[p][1][d] for p, d in items if d < len(GRAMMAR[p][1])}
            more = items | {(p, 0) for p, (h, _) in enumerate(GRAMMAR) if h in wanted & heads}
            if more == items:
                return items
            items = more

    states = [closed(frozenset((p, 0) for p, (h, _) in enumerate(GRAMMAR) if h == "C"))]
    goto: dict = {}
    for at, state in enumerate(states):
        for symbol in sorted({GRAMMAR[p][1][d] for p, d in state if d < len(GRAMMAR[p][1])}):
            to = closed(frozenset((p, d + 1) for p, d in state if GRAMMAR[p][1][d:d + 1] == symbol))
            if to not in states:
                states.append(to)
            goto[at, symbol] = states.index(to)
    done = {at: GRAMMAR[p] for at, state in enumerate(states) for p, d in state if d == len(GRAMMAR[p][1]) and GRAMMAR[p][0] != "C"}
    accepting = {at for at, state in enumerate(states) if any(d == len(GRAMMAR[p][1]) and GRAMMAR[p][0] == "C" for p, d in state)}
    return goto, {"reduce": done, "accept": accepting}


START: Stack = (0, ())


@lru_cache(None)  # the grammar has eight stacks
def shift(stack: Stack, symbol: str | None) -> Stack | None:
    """The stack after a symbol and all reductions it completes; None where the symbol does not fit."""
    goto, ends = automaton()
    if (to := goto.get((stack[0], symbol))) is None:
        return None
    stack = (to, stack)
    while stack[0] in ends["reduce"]:
        head, body = ends["reduce"][stack[0]]
        for _ in body:
            stack = stack[1]
        stack = (goto[stack[0], head], stack)
    return stack


def accepts(stack: Stack) -> bool:
    return stack[0] in automaton()[1]["accept"]


@lru_cache(None)
def gaps(stack: Stack) -> tuple[tuple[str, str, int, Stack], ...]:
    """(audit, symbols, cost, stack) of every top that inserts alone reach, the fewest each."""
    found, open_ends = {stack[0]: ("", "", 0, stack)}, [("", "", 0, stack)]
    for audit, symbols, cost, at in open_ends:
        for s in ROLES:
            if (to := shift(at, s)) is not None and to[0] not in found:
                found[to[0]] = (audit + "I", symbols + s, cost + INSERT, to)
                open_ends.append(found[to[0]])
    return tuple(found.values())


@lru_cache(None)
def moves(stack: Stack, symbol: str | None, deleted: bool, truncated: bool) -> tuple[tuple[int, str, str, Stack], ...]:
    """(cost, audit, symbols, stack) of all ways past one row. An insert before a deletion costs what it costs after it and lists later."""
    out = [(DELETE, "D", "-", stack)]
    if not deleted:
        more = TRUNCATED if truncated else 0
        for audit, symbols, cost, at in gaps(stack):
            for s in ("s", *ROLES):
                if (to := shift(at, s)) is not None and (s == symbol or s in ROLES):
                    out.append((cost + more + (0 if s == symbol else REROLE), audit + ("K" if s == symbol else "R"), symbols + s, to))
    return tuple(out)


@lru_cache(1)
def entries() -> tuple[Stack, ...]:
    """A stack for each top that a row can meet."""
    stacks = [START]
    for at in stacks:
        stacks += [to for s in ("s", *ROLES) if (to := shift(at, s)) is not None and to not in stacks]
    return tuple({stack[0]: stack for stack in reversed(stacks)}.values())


class Parse:
    """The graph-structured stack's tops after some rows. Audits of two tops hold as many letters for rows and end in one, so neither
    begins with the other and an order among them, kept as ranks, stays right whatever follows."""

    def __init__(self, stack: Stack = START):
        self.tops: list[tuple[int, int, Stack, tuple]] = [(0, 0, stack, ())]  # cost, rank, stack, (path before, audit, symbols)

    def _merge(self, steps: Iterator[tuple[int, int, str, str, Stack, tuple]]) -> None:
        best: dict = {}
        for cost, rank, audit, symbols, stack, path in steps:
            old = best.get(stack[0])
            if old is None or (cost, rank, audit) < old[:3]:
                best[stack[0]] = (cost, rank, audit, symbols, stack, path)
        ranked = sorted(best.values(), key=lambda x: x[1:3])
        self.tops = [(cost, k, stack, (path, audit, symbols)) for k, (cost, _, audit, symbols, stack, path) in enumerate(ranked)]

    def row(self, symbol: str | None, deleted: bool, truncated: bool) -> None:
        self._merge((cost + spent, rank, audit, symbols, to, path) for cost, rank, stack, path in self.tops
                    for spent, audit, symbols, to in moves(stack, symbol, deleted, truncated))

    def rows(self, lanes: list) -> None:
        """Many rows at once, given what they do from each top: (entry top, exit top, cost, audit, symbols)."""
        self._merge((cost + spent, rank, audit, symbols, _of_top(leave), path) for cost, rank, stack, path in self.tops
                    for enter, leave, spent, audit, symbols in lanes if enter == stack[0])

    @staticmethod
    def spelled(path: tuple) -> tuple[str, str]:
        letters, symbols = [], []
        while path:
            path, audit, chosen = path
            letters.append(audit)
            symbols.append(chosen)
        return "".join(reversed(letters)), "".join(reversed(symbols))

    def end(self) -> tuple[int, str, str]:
        """Least cost, its first audit and its symbols, when nothing follows."""
        cost, _, audit, symbols, path = min(((cost + spent, rank, audit, symbols, path) for cost, rank, stack, path in self.tops
                                             for audit, symbols, spent, to in gaps(stack) if accepts(to)), key=lambda x: x[:3])
        before, chosen = self.spelled(path)
        return cost, before + audit, chosen + symbols

    def lanes(self) -> list:
        return [(stack[0], cost, *self.spelled(path)) for cost, _, stack, path in self.tops]


def _of_top(top: int) -> Stack:
    return next(s for s in entries() if s[0] == top)


def edited(audit: str, symbols: str, roles: list[str], texts: list[str]) -> str:
    """Repaired rows as ``role:text``, joined by line feeds."""
    rows, out = iter(zip(roles, texts)), []
    for edit, symbol in zip(audit, symbols):
        if edit == "I":
            out.append(f"{ROLES[symbol]}:")
            continue
        role, text = next(rows)
        if edit != "D":
            out.append(f"{role if edit == 'K' else ROLES[symbol]}:{text}")
    return "\n".join(out)


class Run:
    """Consecutive rows of one conversation."""

    def __init__(self):
        self.turns: list = []
        self.roles: list[str] = []
        self.texts: list[str] = []
        self.faults: list[str] = []

    def add(self, turn: int | None, role: str, text: str, fault: str) -> None:
        if fault in ("", "truncated") and self.turns and (self.turns[-1], self.roles[-1], self.texts[-1]) == (turn, role, text):
            fault = "duplicate"  # equal rows lie side by side
        self.turns.append(turn)
        self.roles.append(role)
        self.texts.append(text)
        self.faults.append(fault)

    def figures(self) -> dict:
        known = [t for t in self.turns if t is not None]
        initials = [r[:1] for r in self.roles]
        return {"low": known[0] if known else None, "high": known[-1] if known else None, "distinct": len(set(known)),
                "begins": initials[0] if initials else None, "ends": initials[-1] if initials else None,
                **{kind: self.faults.count(kind) for kind in ("blank", "duplicate", "truncated")},
                "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))}

    def parse(self, stack: Stack = START) -> Parse:
        parse = Parse(stack)
        for role, fault in zip(self.roles, self.faults):
            parse.row(role[:1], fault in ("blank", "duplicate"), fault == "truncated")
        return parse


_FIGURES = "low long, high long, distinct long, begins string, ends string, blank long, duplicate long, truncated long, illegal long"
_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired string"
_FIGURE_NAMES = [f.split()[0] for f in _FIGURES.split(", ")]
_RESULT_NAMES = [f.split()[0] for f in _RESULT.split(", ")]


def _result(figures: dict, cost: int, audit: str, repaired: str) -> dict:
    gaps_left = 0 if figures["low"] is None else figures["high"] - figures["low"] + 1 - figures["distinct"]
    return {"gaps": gaps_left, **{k: figures[k] for k in ("blank", "duplicate", "truncated", "illegal")}, "cost": cost, "audit": audit, "repaired": repaired}


def _joined(runs: list[dict]) -> dict:
    """Figures of a conversation from those of its runs, in order."""
    full = [r for r in runs if r["begins"] is not None]
    numbered = [r for r in full if r["low"] is not None]
    out = {k: sum(r[k] for r in full) for k in ("blank", "duplicate", "truncated", "illegal", "distinct")}
    out["illegal"] += sum(a["ends"] + b["begins"] not in LEGAL for a, b in zip(full, full[1:]))
    out["distinct"] -= sum(a["high"] == b["low"] for a, b in zip(numbered, numbered[1:]))
    return {**out, "low": numbered[0]["low"] if numbered else None, "high": numbered[-1]["high"] if numbered else None}


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", absent: str | None = None) -> DataFrame:
    """One row per conversation: ``conv``, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired (string).

    Rows are taken by turn (nulls first), within a turn by role and by a checksum of the text. A row's first fault counts: blank (no
    character beside ASCII white space), duplicate (its role and text seen earlier in the conversation), truncated (the last such
    character is none of ``.!?``). Edits that make the role initials ``(s?(ua)+)?``: K keeps a row, R makes it user or assistant (2), D
    deletes it (3; must be for blank and duplicate rows), I inserts a user or assistant row without text (2); truncated rows that stay
    add 1. audit holds the letters of the cheapest edits, the ASCII-least of several; repaired the rows ``role:text`` that they give.

    Null roles and texts are one space, so such a text is blank and such a role fits nowhere; null conversations are one conversation;
    rows with the column ``absent`` true only name their conversation, and one without other rows gets zeros and empty texts. Equal rows
    are duplicates of the first. Very long texts travel whole. Empty tables give no rows. Other columns are left out.

    Rows are dealt by range of (conversation, turn, role, checksum), so a conversation of any size is spread over as many tasks as it
    needs. One that lies within a task is parsed there. A run that reaches an end of its task is parsed from every top the stack can
    have, and a conversation's few runs are then joined; that task holds what its own row of the result holds, and the audits of its runs.
    """
    blank_ends = F.rtrim(F.col("text"), F.lit(SPACES))
    missing = named(absent) if absent else F.lit(False)
    plain = (rows.select(named(conv).alias("conv"), named(turn).cast("long").alias("turn"), F.coalesce(named(role).cast("string"), F.lit(" ")).alias("role"),
                         F.coalesce(named(text).cast("string"), F.lit(" ")).alias("text"), missing.alias("absent"))
             .withColumn("hash", F.unhex(F.md5(F.col("text").cast("binary")))))
    # (role, text) pairs that a conversation has more than once, and the first turn of each
    pairs = (plain.where("NOT absent").groupBy("conv", "role", "hash")
             .agg(F.count("*").alias("n"), F.min("turn").alias("first"), F.bool_or(F.col("turn").isNull()).alias("open")).where("n > 1"))
    p, q = plain.alias("p"), pairs.alias("q")
    seen = (p.join(q, F.col("p.conv").eqNullSafe(F.col("q.conv")) & (F.col("p.role") == F.col("q.role")) & (F.col("p.hash") == F.col("q.hash")), "left")
            .select("p.*", F.coalesce(F.when(F.col("q.open"), F.col("p.turn").isNotNull()).otherwise(F.col("p.turn") > F.col("q.first")), F.lit(False)).alias("later")))
    fault = (F.when(blank_ends == "", "blank").when(F.col("later"), "duplicate")
             .when(~F.substring(blank_ends, -1, 1).isin(*".!?"), "truncated").otherwise(""))
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ("conv", "turn", "role", "hash")
    dealt = (seen.select(*order, "text", "absent", fault.alias("fault")).repartitionByRange(partitions, *order).sortWithinPartitions(*order)
             .select("conv", "turn", "role", "text", "absent", "fault"))
    key = T.StructField("conv", plain.schema["conv"].dataType)
    schema = T.StructType([key, T.StructField("part", T.IntegerType()), *T.StructType.fromDDL(_FIGURES).fields,
                           *T.StructType.fromDDL("gaps long, cost long, audit string, repaired string, lanes binary, roles array<string>, texts array<string>").fields])
    arrow_key = {"conv": pa.string() if isinstance(key.dataType, T.StringType) else pa.int64()}
    if not isinstance(key.dataType, (T.StringType, T.LongType)):
        raise TypeError(f"{conv} must be a long or a string")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema
        part, typed = TaskContext.get().partitionId(), to_arrow_schema(schema)

        def whole(name, run: Run) -> dict:
            cost, audit, symbols = run.parse().end()
            return {"conv": name, "part": part, **run.figures(), **_result(run.figures(), cost, audit, edited(audit, symbols, run.roles, run.texts))}

        def cut(name, run: Run) -> dict:
            import zstandard
            lanes = [(stack[0], *lane) for stack in entries() for lane in run.parse(stack).lanes()]
            return {"conv": name, "part": part, **run.figures(), "lanes": zstandard.compress(json.dumps(lanes).encode()), "roles": run.roles, "texts": run.texts}

        def sent(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(rows, schema=typed)

        name, run, first, out, held = None, None, True, [], 0
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(6)]
            for conv_id, number, who, what, gone, wrong in zip(*columns):
                if run is None or conv_id != name:
                    if run is not None:
                        out.append(cut(name, run) if first else whole(name, run))
                        first, held = False, held + sum(map(len, run.texts))
                        if held > 1 << 20:
                            yield sent(out)
                            out, held = [], 0
                    name, run = conv_id, Run()
                if not gone:
                    run.add(number, who, what, wrong)
        if run is not None:
            out.append(cut(name, run))
            yield sent(out)

    def join(group: pd.DataFrame) -> pd.DataFrame:
        import zstandard
        runs = group.sort_values("part").astype(object).where(lambda d: d.notna(), None).to_dict("records")
        for run in runs:  # columns with nulls arrive as floats
            run.update({k: int(run[k]) for k in ("low", "high") if run[k] is not None})
        parse_all = Parse()
        for run in runs:
            parse_all.rows(json.loads(zstandard.decompress(run["lanes"])))
        cost, audit, symbols = parse_all.end()
        text_of = edited(audit, symbols, [r for run in runs for r in run["roles"]], [t for run in runs for t in run["texts"]])
        return pd.DataFrame([{"conv": runs[0]["conv"], **_result(_joined(runs), cost, audit, text_of)}])[["conv", *_RESULT_NAMES]]

    found = Scratch(rows.sparkSession).keep(dealt.mapInArrow(parse, schema))
    split = found.where("lanes IS NOT NULL").select("conv", "part", *_FIGURE_NAMES, "lanes", "roles", "texts")
    result = T.StructType([key, *T.StructType.fromDDL(_RESULT).fields])
    return (found.where("lanes IS NULL").select("conv", *_RESULT_NAMES).unionByName(split.groupBy("conv").applyInPandas(join, result))
            .select(F.col("conv").alias(conv), *_RESULT_NAMES))


def damage(rows: DataFrame) -> DataFrame:
    """``conversations`` with faults by crc32 of ``conv_id:turn`` (nulls one space) modulo 20: 0 makes the row absent, 1 empties its text,
    2 removes its ``.!?``, 3 repeats it, 4 makes it a user's. Returns conv_id, turn, role, text and absent."""
    space = F.lit(" ")

    def string(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), space)

    kind = F.crc32(F.concat(string("conv_id"), F.lit(":"), string("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(string("text"), ".!?", "")).when(kind == 0, "").otherwise(string("text"))
    return (rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(string("role")).alias("role"), text.alias("text"), (kind == 0).alias("absent"),
                        F.explode(F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1))).alias("copy")).drop("copy"))


def sql() -> str:
    """The repair in DuckDB SQL: four states (nothing, system, user, assistant seen last), each with its least cost and audit as one
    string, walked row by row; then the chosen edits are carried out, one by one."""
    step = "CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"  # the checksum, by the reflected polynomial 0xEDB88320
    table = f"list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: {step}))"
    octets = "list_transform(regexp_extract_all(hex(encode(name)), '..'), lambda h: ('0x' || h)::BIGINT)"
    crc = f"xor(list_reduce(list_concat([4294967295::BIGINT], {octets}), lambda c, b: xor(c >> 8, p[(xor(c, b) & 255) + 1])), 4294967295)"
    white = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

    def plus(state: str, cost: int | str, letters: str) -> str:
        return f"(lpad(CAST(CAST(substr({state}, 1, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || substr({state}, 10) || '{letters}')"

    def after(sources: list[tuple[str, str]], initial: str, own: str) -> str:
        """The state after a row that becomes ``initial``: from states behind so many inserts, or by deleting the row in that state."""
        ways = [plus(f"w.{own}", DELETE, "D")]
        for state, inserts in sources:
            more = f"{INSERT * len(inserts)} + r.cut"
            ways.append(f"CASE WHEN NOT r.gone AND r.initial = '{initial}' THEN {plus(f'w.{state}', more, inserts + 'K')} END")
            if initial in ROLES:
                ways.append(f"CASE WHEN NOT r.gone THEN {plus(f'w.{state}', f'{more} + {REROLE}', inserts + 'R')} END")
        return f"least({', '.join(ways)}, NULL)"

    to_user, to_assistant = [("z", ""), ("s", ""), ("a", ""), ("z", "II"), ("s", "II"), ("u", "I")], [("u", ""), ("z", "I"), ("s", "I"), ("a", "I")]
    end = f"least(w.z, w.a, {plus('w.u', INSERT, 'I')}, {plus('w.s', 2 * INSERT, 'II')})"
    role = "CASE WHEN t.at = 'u' THEN 'assistant' ELSE 'user' END"
    return f"""
WITH RECURSIVE polynomial AS (SELECT {table} AS p),
named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
kinds AS (SELECT *, CAST({crc} AS BIGINT) % 20 AS kind FROM named, polynomial),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
  CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM kinds, range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)),
placed AS (SELECT *, row_number() OVER w AS k, lag(left(role, 1)) OVER w AS before,
    rtrim(text, {white}) AS bare FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text))),
judged AS (SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'duplicate' WHEN NOT contains('.!?', right(bare, 1)) THEN 'truncated' ELSE '' END AS fault FROM placed),
r AS (SELECT *, left(role, 1) AS initial, fault IN ('blank', 'duplicate') AS gone, CASE WHEN fault = 'truncated' THEN {TRUNCATED} ELSE 0 END AS cut FROM judged),
walk AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS k, '000000000' AS z, CAST(NULL AS VARCHAR) AS s, CAST(NULL AS VARCHAR) AS u, CAST(NULL AS VARCHAR) AS a FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT w.conv_id, r.k, {plus('w.z', DELETE, 'D')}, {after([('z', '')], 's', 's')}, {after(to_user, 'u', 'u')}, {after(to_assistant, 'a', 'a')}
  FROM walk w JOIN r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.k = w.k + 1),
best AS (SELECT conv_id, CAST(substr(x, 1, 9) AS BIGINT) AS cost, substr(x, 10) AS audit FROM (SELECT w.conv_id, {end} AS x FROM walk w
  QUALIFY row_number() OVER (PARTITION BY w.conv_id ORDER BY w.k DESC) = 1)),
edits AS (SELECT conv_id, pos, substr(audit, CAST(pos AS INT), 1) AS edit, length(replace(substr(audit, 1, CAST(pos AS INT)), 'I', '')) AS k FROM best, unnest(range(1, length(audit) + 1)) AS q(pos)),
carried AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS pos, '' AS at, CAST(NULL AS VARCHAR) AS line FROM best
  UNION ALL
  SELECT t.conv_id, e.pos, CASE e.edit WHEN 'D' THEN t.at WHEN 'K' THEN r.initial ELSE left({role}, 1) END,
    CASE e.edit WHEN 'K' THEN r.role || ':' || r.text WHEN 'R' THEN {role} || ':' || r.text WHEN 'I' THEN {role} || ':' END
  FROM carried t JOIN edits e ON e.conv_id IS NOT DISTINCT FROM t.conv_id AND e.pos = t.pos + 1 LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM e.conv_id AND r.k = e.k),
texts AS (SELECT conv_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE line IS NOT NULL), '') AS repaired FROM carried GROUP BY conv_id),
figures AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
  count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ({', '.join(f"'{x}'" for x in LEGAL)})) AS illegal FROM r GROUP BY conv_id)
SELECT b.conv_id, CAST(coalesce(f.gaps, 0) AS BIGINT) AS gaps, coalesce(f.blank, 0) AS blank, coalesce(f.duplicate, 0) AS duplicate, coalesce(f.truncated, 0) AS truncated,
  coalesce(f.illegal, 0) AS illegal, b.cost, b.audit, sha256(t.repaired) AS repaired_sha256
FROM best b JOIN texts t ON t.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN figures f ON f.conv_id IS NOT DISTINCT FROM b.conv_id"""
