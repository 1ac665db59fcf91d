from collections import Counter

import pytest

from perilake.llm.exact_dedup import CHUNK, Polynomial, exact_groups

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(rows):
    groups = {}
    for i, text in rows:
        groups.setdefault((text or "").translate(LOWER), []).append(i)
    out = Counter()
    for ids in groups.values():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            out[(i, keep, len(ids), i == keep)] += 1
    return out


ROWS = [(20, "Ünï"), (21, "Ünï"), (1, "Alpha beta"), (2, "alpha BETA"), (3, "alpha beta "), (4, None), (5, ""), (6, "É"), (7, "é"),
        (8, "x" * 9000), (9, "x" * 8999 + "y"), (10, "X" * 9000), (2, "alpha beta"), (None, "alpha beta"),
        (None, "alone"), (11, "twin"), (11, "other twin"), (12, "twin"), *[(100 + i, "hot") for i in range(60)]]


def found(df):
    return Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in df.collect())


@pytest.mark.parametrize("primes", [(2147483647, 2147483629), (3, 2)])
def test_groups_are_exact_even_when_fingerprints_collide(spark, primes):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    assert found(exact_groups(df, primes=primes, group_rows=7)) == expected(ROWS)


def test_empty_table_and_clashing_columns(spark):
    schema = "doc_id long, text string, print string, body string, keep_id int, part int"
    assert exact_groups(spark.createDataFrame([], schema)).count() == 0
    df = spark.createDataFrame([(1, "a", "p", "b", 3, 4), (2, "A", "p", "b", 3, 4)], schema)
    assert found(exact_groups(df)) == expected([(1, "a"), (2, "A")])


def test_fingerprints_join_by_length():
    poly = Polynomial()
    left, right = b"q" * (CHUNK + 5), b"rs" * CHUNK
    assert poly.join(poly.of(left), poly.of(right), len(right)) == poly.of(left + right)
    assert poly.of(b"") == (0, 0)
