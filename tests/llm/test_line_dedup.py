from perilake.llm.line_dedup import remove_repeated_lines


def cleaned(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, body int, n_removed string")
    out = remove_repeated_lines(df)
    assert out.columns == ["doc_id", "text", "body", "n_removed", "n_removed_"]
    return sorted(((r.doc_id, r.text, r.n_removed_) for r in out.collect()), key=str)


def brute(rows):
    """Windows in order of id and place; the first one stays."""
    seen, out = {}, {}
    for i, text in sorted(rows):
        lines = text.split("\n")
        filled = [k for k, x in enumerate(lines) if x.strip(" \t\r")]
        gone = set()
        for a in range(len(filled) - 2):
            key = tuple(lines[k].strip(" \t\r") for k in filled[a:a + 3])
            if seen.setdefault(key, (i, a)) != (i, a):
                gone |= set(filled[a:a + 3])
        out[i] = ("\n".join(x for k, x in enumerate(lines) if k not in gone), len(gone))
    return out


TEXTS = {1: "a\nb\nc\nd", 2: "x\nb\nc\nd\ny", 3: "a\n\n b\nc\t\nz", 4: "q\nq\nq\nq\nq", 5: "a\nb", 6: "a\nb",
         7: "", 8: "\n\n\n\n", 9: "é\nb\nc\nd\né\nb\nc\nd"}


def test_against_brute_force(spark):
    want = sorted(((i, *x) for i, x in brute(TEXTS.items()).items()), key=str)
    assert cleaned(spark, [(i, t, 0, "s") for i, t in TEXTS.items()]) == want


def test_a_passage_in_very_many_documents_stays_once(spark):
    rows = [(i, f"own {i}\np1\np2\np3", 0, None) for i in range(300)]
    got = cleaned(spark, rows)
    assert [x[2] for x in got].count(0) == 1 and (0, "own 0\np1\np2\np3", 0) in got


def test_nulls_repeated_rows_and_empty_table(spark):
    text = "a\nb\nc"
    rows = [(None, text, 1, "x"), (1, text, 1, "x"), (2, None, 1, "x"), (3, "k\nl\nm", 1, "x"), (3, "k\nl\nm", 1, "x")]
    assert cleaned(spark, rows) == sorted(
        [(None, text, 0), (1, "", 3), (2, None, 0), (3, "k\nl\nm", 0), (3, "k\nl\nm", 0)], key=str)
    assert cleaned(spark, []) == []
