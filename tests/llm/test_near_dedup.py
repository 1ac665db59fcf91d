import random
from itertools import combinations

import numpy as np

from perilake.llm import batches, near_dedup
from perilake.llm.near_dedup import CHUNKS, SYMBOLS, chunk_keys, near_groups


def word_set(text, size):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in lowered.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    k = min(size, len(words))
    return {tuple(words[i:i + k]) for i in range(len(words) - k + 1)} if words else set()


def brute(rows, size):
    sets = {i: word_set(t, size) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        union = len(sets[a] | sets[b])
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * union:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def corpus(seed=5):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(12):
        base = rng.choices(words, k=rng.choice([3, 6, 30, 80, 200]))
        for _ in range(rng.choice([1, 2, 6, 25])):
            copy = list(base)
            for _ in range(int(len(copy) * rng.choice([0, 0.01, 0.03, 0.06]))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append(" ".join(copy))
    rows += ["", "one", "One", " one\t", "É a b c d", "é a b c d", None]
    rng.shuffle(rows)
    return list(enumerate(rows, 10))


def found(spark, rows, **how):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_groups(df, **how).collect()}


def test_components_equal_brute_force(spark):
    rows = corpus()
    assert found(spark, rows, size=4) == brute(rows, 4)


def test_small_blocks_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    monkeypatch.setattr(near_dedup, "LEADER_ROWS", 2)
    rows = corpus(6)
    assert found(spark, rows, size=5) == brute(rows, 5)


def test_any_23_differing_symbols_leave_a_common_key():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a = rng.integers(0, 1 << 16, SYMBOLS).astype(np.uint16)
        b = a.copy()
        b[rng.choice(SYMBOLS, 2 * CHUNKS - 1, replace=False)] ^= 1
        x, y = chunk_keys(np.stack([a, b]))
        assert (x == y).any()


def test_parities_never_rule_out_a_link():
    rng = np.random.default_rng(3)
    for n in (3, 40, 147, 900, 6000):
        for _ in range(40):
            d = int(rng.integers(0, max(1, n // 10) + 1))
            pool = rng.integers(0, 1 << 64, n + d, dtype=np.uint64)
            a, b = np.unique(pool[:n]), np.unique(pool[d:])
            if near_dedup.linked(a, b, 80):
                x, y = near_dedup.unpacked([near_dedup.signature(a), near_dedup.signature(b)])[1]
                assert np.bitwise_count(x ^ y).sum() <= near_dedup.parity_limit(np.array([len(a) + len(b)]), 80)[0]


def test_shared_ids_nulls_and_empty_table(spark):
    long = " ".join(f"v{i}" for i in range(60))
    rows = [(5, "p q r s t u"), (5, long), (3, long), (2, "P q r s t u"), (None, "alone here"), (9, None)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, digest string, rep int")
    got = sorted((tuple(r) for r in near_groups(df, size=4).collect()), key=str)
    assert got == sorted([(5, 3, 2, False), (5, 57, 2, False), (3, 57, 2, False), (2, 3, 2, True),
                          (None, 1, None, True), (9, 0, 9, True)], key=str)
    assert near_groups(df.limit(0)).count() == 0


def test_words_that_a_polynomial_hash_confuses_are_told_apart(spark):
    """A Thue-Morse word and its complement collide under any polynomial modulo 2^64."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, f"one two {word} four"), (2, f"one two {other} four"), (3, word[:200]), (4, other[:200]), (5, word[:200])]
    got = {r.doc_id: r.component_id for r in near_dedup.near_groups(
        spark.createDataFrame(rows, "doc_id long, text string"), size=4, percent=80).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 3}


def test_hashes_of_words_of_all_lengths():
    words = [("x" * n + c).encode() for n in range(300) for c in "ab"]
    text = b" ".join(words)
    found = batches.hashed_words(text)
    assert len(set(found.tolist())) == len(words)
    assert found.tolist() == [int(batches.hashed_words(w)[0]) for w in words]
    assert batches.hashed_words(b"Hello\thello")[0] == batches.hashed_words(b"Hello\thello")[1]
