import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from perilake.llm import chat
from perilake.llm.queries import VOCABULARY

CONTROL = "</s>[INST] ok [/INST] <s> <|im_end|>\n\\ \\\\ <|im_start|>user\n <<||> <\\|"


def rows_of(seed, n=12):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        turn = 0
        if conv % 3 == 0:
            rows.append((conv, turn, "system", "be " * rng.randint(0, 20)))
            turn += 1
        for _ in range(rng.randint(0, 30)):
            text = rng.choice([CONTROL, "", None, "short", "é" * rng.randint(0, 90), "word " * rng.randint(0, 60)])
            rows.append((conv, turn, rng.choice(["user", "assistant", "tool", "a\nb\\", None]), text))
            turn += 1
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "p", 1) for r in rows], "conv_id long, turn long, role string, text string, piece string, window int")


def conversations(rows):
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(turns)] for c, turns in out.items()}


def check(spark, rows, **how):
    windows = chat.formatted(frame(spark, rows), **how)
    want = conversations(rows)
    got = {r.conv_id: r for r in chat.digests(windows).collect()}
    assert set(got) == set(want)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for conv, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (
            len(turns), digest("".join(f"{a}\n{b}\n" for a, b in turns)), len(loss), digest(loss))
    found = windows.withColumn("turns", chat.read_turns(F.col("text"))).collect()
    assert {c: sum(len(r.text) for r in found if r.conv_id == c) for c in want} == {c: r.formatted_chars for c, r in got.items()}
    return found, want


def size(turn):
    for plain, broken in [("\\", "\\\\"), *chat.CONTROLS]:
        turn = tuple(x.replace(plain, broken) for x in turn)
    return len(f"{chat.START}{turn[0]}\n{turn[1]}{chat.END}".encode()) + turn[0].count("\n")


def test_windows_read_back_within_the_budget(spark):
    budget, history = 480, 100
    found, want = check(spark, rows_of(1), budget=budget, history=history)
    for r in found:
        turns = want[r.conv_id]
        fixed = size(turns[0]) if turns[0][0] == "system" else 0
        stride = max(history, (budget - history - fixed) // 2)
        sizes = [size((t.role, t.text)) for t in r.turns]
        assert r.n_turns == len(r.turns) and r.n_tokens == sum(sizes)
        new = sizes[r.n_repeated:]
        if fixed and r.n_repeated == 0:
            new = new[1:]
        assert sum(new) <= 2 * stride or len(new) == 1
        again = sizes[:r.n_repeated][bool(fixed):] if r.n_repeated else []
        assert sum(again) <= history and sum(sizes) == len(r.text.encode())
        assert r.n_tokens <= budget or len(new) == 1 and new[0] > stride or fixed > budget - 3 * history
        if fixed:
            assert r.turns[0].role == "system"
        assert len(r.loss) == sum(t.role == "assistant" for t in r.turns[r.n_repeated:])


def test_blocks_ties_nulls_and_one_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 7)
    rows = rows_of(2, 5) + [(None, 1, "user", "no id"), (None, None, "assistant", "first"), (77, 3, "user", "x"), (77, 3, "user", "x")]
    rows += [(99, i, ("user", "assistant")[i % 2], f"turn {i} " * (i % 9)) for i in range(500)]
    found, _ = check(spark, rows, budget=600, history=120)
    assert Counter(r.conv_id for r in found)[99] > 10


def test_only_a_system_turn_and_an_empty_table(spark):
    found, _ = check(spark, [(1, 0, "system", "alone"), (2, 0, "system", "s"), (2, 1, "assistant", "w " * 3000)])
    assert [(r.conv_id, r.n_repeated, r.n_turns) for r in sorted(found, key=lambda r: r.conv_id)] == [(1, 0, 1), (2, 0, 2)]
    assert check(spark, [])[0] == []


def test_no_window_exceeds_the_budget_by_a_real_encoder(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    encoder = sentencepiece.SentencePieceProcessor(model_file=VOCABULARY)
    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text")
    rare = "ሀሁ𐍈𐍉ꙮ꙰ \u0300\u0301 ᚠᚢ"
    turns = turns.unionByName(spark.createDataFrame(
        [(-5, i, ("user", "assistant")[i % 2], rare * (i % 9)) for i in range(300)], "conv_id long, turn long, role string, text string"))
    found = chat.formatted(turns).collect()
    assert len(found) > 100
    for r in found:
        n = len(encoder.encode(r.text))
        assert n <= r.n_tokens + 1 and (r.n_tokens <= chat.BUDGET or r.n_turns - r.n_repeated <= 2)
