"""Conversation repair against all possible edits, and over runs that are cut anywhere."""

import hashlib
import itertools
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eventloom.llm import registry, turns

SPACE = " \t\n\x0b\x0c\r"
LEGAL = re.compile(r"(s?(ua)+)?")


def judged(rows):
    """(role, text, fault) of rows in order."""
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(SPACE)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def cheapest(rows):
    """Every edit of every row with every insert in every gap."""
    added = [("", "", 0), ("I", "u", 2), ("I", "a", 2), ("II", "ua", 4), ("II", "au", 4)]
    ways = [[("D", "", 3)] if fault in ("blank", "duplicate") else
            [("D", "", 3), ("K", role[:1] or "?", t := int(fault == "truncated")), ("R", "u", 2 + t), ("R", "a", 2 + t)] for role, _, fault in rows]
    best = None
    for gaps in itertools.product(added, repeat=len(rows) + 1):
        for chosen in itertools.product(*ways):
            parts = [gaps[0]]
            for one, gap in zip(chosen, gaps[1:]):
                parts += [one, gap]
            if LEGAL.fullmatch("".join(p[1] for p in parts)):
                found = (sum(p[2] for p in parts), "".join(p[0] for p in parts), [p for p in parts])
                if best is None or found[:2] < best[:2]:
                    best = found
    return best


def repaired(rows, parts):
    out, at = [], 0
    for audit, symbols, _ in parts:
        for letter, symbol in itertools.zip_longest(audit, symbols, fillvalue=""):
            role = {"u": "user", "a": "assistant"}.get(symbol)
            if letter == "I":
                out.append(f"{role}:")
            else:
                if letter != "D":
                    out.append(f"{rows[at][0] if letter == 'K' else role}:{rows[at][1]}")
                at += 1
    return "\n".join(out)


row = st.tuples(st.sampled_from(["user", "assistant", "system", "tool", " "]), st.sampled_from(["Hi.", "and", "", "So?", " \t"]))


@settings(max_examples=40, deadline=None)
@given(st.lists(row, max_size=3), st.integers(0, 3))
def test_parse_against_all_edits(rows, cut):
    rows = judged(rows)
    run, runs = turns.Run(), [turns.Run(), turns.Run()]
    for k, (role, text, fault) in enumerate(rows):
        run.add(k, role, text, fault)
        runs[k >= cut].add(k, role, text, fault)
    cost, audit, symbols = run.parse().end()
    want = cheapest(rows)
    assert (cost, audit) == want[:2]
    assert turns.edited(audit, symbols, run.roles, run.texts) == repaired(rows, want[2])
    joined = turns.Parse()
    for part in runs:
        joined.rows([(s[0], *lane) for s in turns.entries() for lane in part.parse(s).lanes()])
    assert joined.end() == (cost, audit, symbols)


@settings(max_examples=60, deadline=None)
@given(st.lists(row, max_size=40), st.lists(st.integers(0, 40), max_size=4))
def test_runs_cut_anywhere(rows, cuts):
    """Longer conversations: one parse, and any split into runs, agree."""
    rows, whole, joined = judged(rows), turns.Run(), turns.Parse()
    runs = [turns.Run() for _ in range(len(cuts) + 1)]
    for k, (role, text, fault) in enumerate(rows):
        whole.add(k, role, text, fault)
        runs[sum(k >= c for c in cuts)].add(k, role, text, fault)
    for part in runs:
        joined.rows([(s[0], *lane) for s in turns.entries() for lane in part.parse(s).lanes()])
    assert joined.end() == whole.parse().end()
    cost, audit, symbols = joined.end()
    kept = turns.edited(audit, symbols, whole.roles, whole.texts).split("\n") if "K" in audit or "R" in audit or "I" in audit else []
    assert LEGAL.fullmatch("".join(k[0] for k in kept if ":" in k)) or any("\n" in t for t in whole.texts)


def plain_repair(rows):
    """conv -> result, row by row: rows are (conv, turn, role, text)."""
    convs = {}
    for conv, turn, role, text in rows:
        own = convs.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub(r"[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
        known = [t for t, _, _ in own if t is not None]
        marked, names = judged([r[1:] for r in own]), [r[1][:1] for r in own]
        run = turns.Run()
        for k, (role, text, fault) in enumerate(marked):
            run.add(k, role, text, fault)
        cost, audit, symbols = run.parse().end()
        faults = [m[2] for m in marked]
        out[conv] = (max(known) - min(known) + 1 - len(set(known)) if known else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(names, names[1:])), cost, audit,
                     hashlib.sha256(turns.edited(audit, symbols, run.roles, run.texts).encode()).hexdigest())
    return out


def query_rows(spark, df, folder):
    df.write.mode("overwrite").parquet(f"{folder}/conversations.parquet")
    got = registry.op13_conversation_repair(spark, str(folder)).collect()
    names = [r["conv_id"] for r in got]
    assert len(names) == len(set(names))
    return {r["conv_id"]: tuple(r)[1:] for r in got}


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_query_edges(spark, tmp_path, partitions):
    """Nulls everywhere, ties, repeated rows, a long text, a conversation with a third of all rows, clashing names."""
    long = "long text. " * 40_000
    hot = [(9, k, ("user", "assistant", "assistant", "system")[k * k % 4], ("Hello.", "more and", f"unit {k}!", "", f"text {k % 5}?")[k % 5]) for k in range(400)]
    rows = [(None, 1, "user", "a."), (None, None, None, None), (1, None, "user", "x."), (1, 0, None, "y."), (1, 0, "assistant", "z"), (1, 0, "assistant", "z"),
            (2, 3, "system", long), (2, 4, "user", long), (2, 9, "assistant", "end?"), (3, 1, "", "?"), (4, 2, "Users", "  \t"),
            *[(c, t, ("user", "assistant")[t % 2], f"w{t}.") for c in range(20, 120) for t in range(1, 6)], *hot]
    for name in ("part", "audit", "hash", "fault", "a.b"):
        assert name
    df = spark.createDataFrame(rows, SCHEMA)
    df = df.select("*", *[F.lit("own").alias(c) for c in ("part", "audit", "hash", "fault", "absent", "conv", "later")])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert query_rows(spark, df, tmp_path) == plain_repair(rows)
        assert query_rows(spark, df.where("conv_id > 1000"), tmp_path) == {}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_conversation_without_rows(spark, tmp_path):
    gone = [c for c in range(3000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:3]
    got = query_rows(spark, spark.createDataFrame([(c, 0, "user", "hello.") for c in gone], SCHEMA), tmp_path)
    assert got == {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in gone}


def test_query_on_the_given_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: tuple(r)[1:] for r in registry.op13_conversation_repair(spark, sf).collect()}
    assert got == plain_repair(rows)
