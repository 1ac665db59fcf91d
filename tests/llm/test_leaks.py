import random

import numpy as np
import pytest

from perilake.llm import leaks
from perilake.llm.leaks import Items, edit_ends, find_leaks, without_leaks


def table_ends(pattern, text):
    """Distances by the plain dynamic programme."""
    row, out = list(range(len(pattern) + 1)), []
    for w in text:
        new = [0]
        for i, p in enumerate(pattern):
            new.append(min(row[i] + (p != w), row[i + 1] + 1, new[i] + 1))
        row = new
        out.append(row[-1])
    return out


@pytest.mark.parametrize("seed", range(30))
def test_bit_parallel_distance_is_the_plain_one(seed):
    rng = random.Random(seed)
    pattern = rng.choices(range(5), k=rng.randint(1, 90))
    text = rng.choices(range(5), k=rng.randint(0, 120))
    assert edit_ends(pattern, text) == table_ends(pattern, text)


def edited(rng, words, n, vocabulary):
    words = list(words)
    for _ in range(n):
        at = rng.randrange(len(words))
        kind = rng.randrange(3)
        if kind == 0:
            words[at] = rng.choice(vocabulary)
        elif kind == 1:
            words.insert(at, rng.choice(vocabulary))
        else:
            del words[at]
    return words


def test_documents_with_leaks_equal_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(5, 40)))) for i in range(15)]
    docs = []
    for d in range(80):
        words = rng.choices(vocabulary, k=rng.randint(0, 80))
        if d % 2:
            source = rng.choice(items)[1].split()
            at = rng.randint(0, len(words))
            words[at:at] = edited(rng, source, rng.randint(0, len(source) // 4), vocabulary)
        docs.append((d, ", ".join(words).upper() if d % 3 else " ".join(words)))
    want = set()
    for d, text in docs:
        words = text.lower().replace(",", "").split()
        want |= {(d, i) for i, t in items if min(table_ends(t.split(), words), default=99) <= len(t.split()) // 5}
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = find_leaks(df, it).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want and len(want) > 15
    kept = {r.doc_id for r in without_leaks(df, it).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in want}


def test_blocks_spans_nulls_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(leaks, "BLOCK_BYTES", 64)
    item = "Élan vital is a term coined by a philosopher"
    docs = [(1, f"ß: {item.upper()}! {item}", 0, "x"), (2, None, 1, "y"), (None, item, 2, "z"), (3, "", 3, None),
            (1, "nothing of the kind here", 0, "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id int, body string")
    it = spark.createDataFrame([(7, item), (7, item), (8, None), (9, "too short"), (10, "five words that occur nowhere")],
                               "item_id long, text string")
    n = len(item)
    assert sorted((tuple(r) for r in find_leaks(df, it).collect()), key=str) == sorted(
        [(1, 7, 0, 3, 3 + n), (1, 7, 0, 5 + n, 5 + 2 * n), (None, 7, 0, 0, n)], key=str)
    left = without_leaks(df, it)
    assert left.schema == df.schema and sorted(r.doc_id for r in left.collect()) == [1, 2, 3]
    assert find_leaks(df, it.limit(0)).count() == 0 and without_leaks(df.limit(0), it).count() == 0


def test_a_word_of_many_bytes_and_no_words():
    assert Items([(1, "")]).matches(np.zeros(0, np.uint64)) == []
    hashed, starts, ends = leaks.words_of(b"x" * (5 << 20) + b" y")
    assert len(hashed) == 2 and ends[0] == 5 << 20


def test_short_items_unspaced_scripts_case_and_signs(spark):
    items = [(1, "one two three four"), (2, "机器学习是人工智能的一个重要分支研究如何让计算机"), (3, "the cat — sat — on the old mat"),
             (4, "ПРИВЕТ мир Добрый ДЕНЬ вам"), (5, "«où est» la ÉCOLE × du village"), (6, "—…!"), (7, "")]
    docs = [(1, "he said one, two THREE four!"), (2, "机器学习是人工智能的一个重要分支研究如何让计算机"),
            (3, "And the cat sat on the old mat."), (4, "привет, мир: добрый день вам"), (5, "Où est la école — du village?"),
            (6, "one two four"), (7, "— … !"), (8, None), (9, "前面有字机器学习是人工智能的一个重要分枝研究如何让计算机后面")]
    found = find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = sorted((r.doc_id, r.item_id, r.distance) for r in found.collect())
    assert got == [(1, 1, 0), (2, 2, 0), (3, 3, 0), (4, 4, 0), (5, 5, 0), (9, 2, 1)]
    place = {(r.doc_id, r.item_id): (r.start, r.end) for r in found.collect()}
    assert place[9, 2] == (4, 28) and docs[4][1][slice(*place[5, 5])] == "Où est la école — du village"


def test_words_split_alike_in_both_ways():
    for text in ("École où l'été, naïve 3x4 a×b ÷ ¿qué? ÀÉÎÕÜ ÿß _x_ «a»", "plain ASCII text, 12 words_here", ""):
        fast, slow = leaks.words_of(text.encode()), leaks._other_words(text.encode())
        for a, b in zip(fast, slow):
            assert a.tolist() == b.tolist()
