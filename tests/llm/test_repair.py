import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from perilake.llm import repair
from perilake.llm.queries import QUERIES, SQL

from conftest import SMALL, values

WHITE = " \t\n\x0b\f\r"
SCHEMA = "conv_id long, turn long, role string, text string"


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if kind == 0:
            continue
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def brute(rows):
    """Figures of one conversation by a forward search over all edits."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    count, seen, gone, cut = {"blank": 0, "duplicate": 0, "truncated": 0}, set(), [], []
    for _, _, role, text in rows:
        bare = text.strip(WHITE)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        if bare:
            seen.add((role, text))
        if fault:
            count[fault] += 1
        gone.append(fault in ("blank", "duplicate"))
        cut.append(fault == "truncated")
    follows = {"": "u", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}

    def grow(best):
        """Add up to three inserted turns to every state."""
        for _ in range(3):
            for state, (cost, audit, done) in list(best.items()):
                to = follows[state]
                new = (cost + 5, audit + "I", done + [names[to] + ":"])
                if to not in best or new[:2] < best[to][:2]:
                    best[to] = new
        return best

    best = {"": (0, "", [])}
    for (_, _, role, text), must, short in zip(rows, gone, cut):
        after = {}

        def offer(state, new):
            if state not in after or new[:2] < after[state][:2]:
                after[state] = new

        for state, (cost, audit, done) in grow(best).items():
            offer(state, (cost + 2, audit + "D", done))
            if must:
                continue
            pen, first = 5 * short, role[:1]
            if first == follows[state] or (first == "s" and state == ""):
                offer(first, (cost + pen, audit + "K", done + [role + ":" + text]))
            offer(follows[state], (cost + pen + 1, audit + "R", done + [names[follows[state]] + ":" + text]))
        best = after
    cost, audit, done = min(v for s, v in grow(best).items() if s in ("", "a"))
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    first = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:]))
    return (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit,
            hashlib.sha256("\n".join(done).encode()).hexdigest())


NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def expected(rows, damaged):
    return {c: brute([r for r in damaged if r[0] == c]) for c in {r[0] for r in rows}}


def result(df):
    return {r[0]: tuple(r[1:]) for r in values(df, *NAMES)}


def invented(n, convs, seed):
    pick = random.Random(seed)
    texts = ["", " \t", "yes.", "no!", "open end", "why?\n", "Ünder. ", "a b c", None]
    return [(pick.choice(convs), pick.choice([None, *range(12)]), pick.choice(["user", "assistant", "system", "tool", "", None]),
             pick.choice(texts) if pick.random() < 0.5 else f"t{pick.randrange(99)}" + pick.choice([".", "!", "", " "]))
            for _ in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_edits_equal_a_search_over_all_of_them(spark, seed):
    rows = invented(400, [None, *range(40)], seed)
    turns = spark.createDataFrame(rows, SCHEMA)
    plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    assert result(repair.report(turns, turns)) == expected(rows, plain)


def test_one_conversation_over_many_tasks(spark):
    """The runs of a conversation in 61 tasks give what one walk over it gives."""
    rows = invented(500, [1, 1, 1, 1, 2, 3], 5)
    rows = [(c, None if t is None else t * 40 + i % 40, r, x) for i, (c, t, r, x) in enumerate(rows)]
    turns = spark.createDataFrame(rows, SCHEMA)
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "61")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
        assert repair._ordered(turns.select(F.col("conv_id").alias("conv"), "turn", F.coalesce("role", F.lit(" ")).alias("role"),
                                            F.coalesce("text", F.lit(" ")).alias("text"))) \
            .groupBy("conv").agg(F.count_distinct(F.shiftright("mid", 33)).alias("n")).agg(F.max("n")).first()[0] > 20
        assert result(repair.report(turns, turns)) == expected(rows, plain)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_repeated_rows_are_one_row_until_the_end(spark):
    rows = [(1, 0, "user", "hello there.")] * 3000 + [(1, 1, "assistant", "x.")] * 2 + [(2, 5, "user", "q?")]
    turns = spark.createDataFrame(rows, SCHEMA)
    got = result(repair.report(turns, turns))
    assert got == expected(rows, rows)
    assert got[1][6] == "K" + "D" * 2999 + "KD"


def test_registered_query_over_its_table(spark):
    table = spark.read.parquet(f"{SMALL}/conversations.parquet")
    rows = values(table, "conv_id", "turn", "role", "text")
    got = result(QUERIES["op11_conversation_repair"](spark, SMALL))
    assert got == expected(rows, brute_damage(rows))
    assert "op11_conversation_repair" in SQL


def test_dropped_conversations_empty_tables_and_clashing_names(spark):
    lost = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(lost, 0, "user", "gone."), (None, None, None, None)]
    turns = spark.createDataFrame(rows, SCHEMA)
    for name in ("conv", "mid", "code", "n", "part", "run", "audit"):
        turns = turns.withColumn(name, F.lit("x"))
    got = result(repair.report(repair.damaged(turns), turns))
    assert got == expected(rows, brute_damage(rows))
    assert got[lost][-2:] == ("", hashlib.sha256(b"").hexdigest())
    nothing = spark.createDataFrame([], SCHEMA)
    assert result(repair.report(nothing, nothing)) == {}


def test_texts_of_edits(spark):
    rows = [(1, 0, "user", "hi."), (1, 1, "user", "more."), (1, 2, "assistant", "long " * 300_000 + "!")]
    edits, faults = repair.repair(spark.createDataFrame(rows, SCHEMA))
    got = values(edits.orderBy("mid", "sub"), "edit", "role", F.length("text"))
    assert got == [("D", "user", None), ("K", "user", 5), ("K", "assistant", 1_500_001)]


def test_ranks_order_nodes_like_their_audits():
    draw = np.random.default_rng(3)
    codes = draw.integers(0, 9, 40)
    sizes = np.array([25, 15])
    cost = np.concatenate([repair.costs(codes[:25].tolist(), repair.FINAL), repair.costs(codes[25:].tolist(), repair.FINAL)])
    letter, goal = repair.least_arcs(codes, sizes, cost, np.array([True, True]))
    rank, length, pointers = repair.double(letter, goal)
    audits = []
    for node in range(len(letter)):
        at, text = node, ""
        while letter[at]:
            text, at = text + repair.LETTERS[letter[at]], goal[at]
        audits.append(text)
    assert [len(a) for a in audits] == length.tolist()
    order = sorted(set(audits))
    assert rank.tolist() == [order.index(a) for a in audits]
    node, place = repair.paths(np.arange(len(letter)), length, pointers)
    assert "".join(repair.LETTERS[letter[node]]) == "".join(audits)
