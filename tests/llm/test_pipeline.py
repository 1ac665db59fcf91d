"""Each stage against a brute-force version on its own input, and the whole run."""

import pytest
from test_leaks import table_ends
from test_line_dedup import brute as lines_brute
from test_near_dedup import brute as groups_brute

import corpus_pipeline as pipeline
from perilake.llm.shared import fresh_path, table

spm = pytest.importorskip("sentencepiece")
SMALL = "/root/testdata/sf0.001"


def plain_words(text):
    return "".join(c if c.isalnum() or ord(c) > 127 else " " for c in text.lower()).split()


def test_stages_equal_brute_force(spark):
    docs, path = table(spark, SMALL, "documents"), fresh_path(spark, "stages")
    outputs = {}
    for name, stage in pipeline.STAGES:
        stage(spark, docs, SMALL).write.parquet(f"{path}/{name}")
        before, docs = docs, spark.read.parquet(f"{path}/{name}")
        outputs[name] = [{r.doc_id: r for r in x.collect()} for x in (before, docs)]
        if name != "tokens":
            assert docs.columns == pipeline.COLUMNS

    before, after = outputs["quality"]
    assert 0.6 * len(before) < len(after) < len(before)
    assert all(r == before[i] for i, r in after.items())

    before, after = outputs["lines"]
    want = {i: x for i, x in lines_brute([(i, r.text) for i, r in before.items()]).items() if not x[1] or x[0].strip()}
    assert {i: r.text for i, r in after.items()} == {i: x[0] for i, x in want.items()}
    assert all(r.n_chars == (len(r.text) if want[i][1] else before[i].n_chars) for i, r in after.items())

    before, after = outputs["near_duplicates"]
    groups = groups_brute([(i, r.text) for i, r in before.items()], 5)
    assert set(after) == {i for i, g in groups.items() if g[2]}

    before, after = outputs["benchmark"]
    items = [plain_words(r.text) for r in table(spark, SMALL, "benchmark").collect()]
    leaky = {i for i, r in before.items()
             if any(min(table_ends(w, plain_words(r.text)), default=len(w)) <= len(w) // 5 for w in items)}
    assert set(after) == set(before) - leaky and leaky

    before, after = outputs["tokens"]
    library = spm.SentencePieceProcessor(model_file=pipeline.VOCABULARY)
    assert {i: r.token_ids for i, r in after.items()} == {i: library.encode(r.text) for i, r in before.items()}

    whole = pipeline.run(spark, SMALL)
    assert {r.doc_id: r.token_ids for r in whole.collect()} == {i: r.token_ids for i, r in after.items()}


def test_nulls_and_an_empty_table(spark):
    rows = [(1, None, "en", "s", 0), (None, "some words here", None, None, None), (2, "", "en", "s", 0),
            (2, "", "en", "s", 0), (3, "a b c d e f " * 900, "en", "s", 10800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), SMALL).count() == 0
        if name not in ("quality", "lines"):
            assert stage(spark, docs, SMALL).count() == len(rows)
        else:
            assert stage(spark, docs, SMALL).count() <= len(rows)
