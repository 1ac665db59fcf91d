import numpy as np
import pytest
from conftest import values
from pyspark.sql import functions as F

from perilake.operators import retrieval, vectors


def frame(spark, name, kind, rows):
    return spark.createDataFrame(rows, f"{name} {kind}, embedding array<float>")


def brute_force(questions, corpus, k):
    out = []
    for qid, q in questions:
        dist = [(round(sum((np.float64(np.float32(a)) - np.float64(np.float32(b))) ** 2 for a, b in zip(q, c)), 9), cid) for cid, c in corpus]
        out += [(qid, cid, i + 1, pytest.approx(d, abs=1e-9)) for i, (d, cid) in enumerate(sorted(dist)[:k])]
    return out


def data(n_questions, n_corpus, copies=0, dim=5):
    rng = np.random.default_rng(11)
    corpus = [(f"c{i:04d}", [float(v) for v in rng.normal(size=dim)]) for i in range(n_corpus)]
    corpus += [(f"z{i:04d}", corpus[0][1]) for i in range(copies)]
    return [(i, [float(v) for v in rng.normal(size=dim)]) for i in range(n_questions)], corpus


@pytest.mark.parametrize("n_questions, n_corpus, copies, k", [(7, 200, 0, 6), (3, 4, 0, 6), (5, 40, 90, 6), (4, 60, 0, 1)])
def test_both_searches_equal_brute_force(spark, n_questions, n_corpus, copies, k, monkeypatch):
    questions, corpus = data(n_questions, n_corpus, copies)
    monkeypatch.setattr(vectors, "PAIRS_AT_ONCE", 50)
    q = frame(spark, "question_id", "long", questions)
    c = frame(spark, "chunk_id", "string", corpus).repartition(3)
    want = brute_force(questions, corpus, k)
    pick = ("question_id", "chunk_id", "rank", "distance")
    for found in (vectors.knn(q, c, k), vectors.knn_grid(q, c, k, question_block=2, corpus_block=30)):
        assert sorted(values(found, *pick), key=lambda r: (r[0], r[2])) == want


def test_large_question_sets_take_the_grid(spark, monkeypatch):
    questions, corpus = data(6, 50)
    q, c = frame(spark, "question_id", "long", questions), frame(spark, "chunk_id", "string", corpus)
    want = sorted(values(vectors.knn(q, c, 3)))
    monkeypatch.setattr(vectors, "BROADCAST_BYTES", 10)
    assert sorted(values(vectors.knn(q, c, 3))) == want


def test_no_questions_or_no_corpus(spark):
    questions, corpus = data(2, 3)
    q, c = frame(spark, "question_id", "long", questions), frame(spark, "chunk_id", "string", corpus)
    none = frame(spark, "question_id", "long", [])
    assert vectors.knn(none, c).count() == 0 and vectors.knn_grid(none, c).count() == 0
    assert vectors.knn(q, c.limit(0)).count() == 0 and vectors.knn_grid(q, c.limit(0)).count() == 0


def test_embedding(spark):
    rows = [(1, "alpha beta"), (2, "Alpha, BETA!"), (3, "gamma delta"), (4, ""), (5, None)]
    df = spark.createDataFrame(rows, "id int, text string")
    model = vectors.fit_embedder(df)
    got = {r["id"]: np.array(r["embedding"]) for r in vectors.embed_text(df, model).collect()}
    assert all(len(v) == vectors.DIM for v in got.values())
    assert np.array_equal(got[1], got[2]) and not np.array_equal(got[1], got[3])
    assert np.linalg.norm(got[1]) == pytest.approx(1, abs=1e-6)
    assert not got[4].any() and not got[5].any()
    assert vectors.embed_text(df, model).columns == ["id", "text", "embedding"]


def test_context_and_prompt(spark):
    chunks = spark.createDataFrame([("m/1", "motor", "one"), ("m/2", "motor", "two")], "chunk_id string, source string, text string")
    hits = spark.createDataFrame([(9, "m/1", 2, 0.5), (9, "m/2", 1, 0.1)], "question_id int, chunk_id string, rank int, distance double")
    context = retrieval.build_context(hits, chunks)
    assert values(context) == [(9, "[Source: motor]\ntwo\n\n[Source: motor]\none")]
    asked = spark.createDataFrame([(9, "why?")], "question_id int, question string")
    prompt = retrieval.build_prompt(context, asked).first()["prompt"]
    assert prompt.endswith("[Source: motor]\none\n\nQuestion: why?\n\nAnswer:")


def test_rows_without_an_id_take_no_part(spark):
    q = spark.createDataFrame([(1, [0.0, 0.0]), (None, [1.0, 1.0])], "question_id long, embedding array<double>")
    c = spark.createDataFrame([("a", [0.0, 1.0]), (None, [0.0, 0.0])], "chunk_id string, embedding array<double>")
    for search in (vectors.knn, vectors.knn_grid):
        assert values(search(q, c, 2), "question_id", "chunk_id", "rank") == [(1, "a", 1)]


def test_slots_are_those_of_the_statement_and_each_word_is_hashed_once(spark, monkeypatch):
    texts = ["Émile's 2 cats, CATS; cats", "  --  ", "", None, "naïve ǅ word" * 3, "x " * 50, "cats\tx"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").coalesce(1)
    model = vectors.fit_embedder(df)
    terms = model.stages[0].transform(df).orderBy("id").collect()
    split = df.orderBy("id").select(F.expr(f"coalesce({vectors._split('text')}, array())").alias("w")).toArrow()["w"].combine_chunks()
    hashed, plain = [], vectors.md5
    monkeypatch.setattr(vectors, "md5", lambda w: hashed.append(w) or plain(w))
    monkeypatch.setattr(vectors, "WORDS_AT_ONCE", 3)
    at, slots = vectors.slots_of(split)
    want = [(r["id"], int(h, 16)) for r in terms for h in r["_terms"]]
    assert [*zip(at.tolist(), slots.tolist())] == want and len(want) > 50
    assert len(hashed) == len(set(hashed)) < 12
    distinct = [sorted({int(h, 16) for h in r["_terms"]}) for r in terms]
    assert [r["_counts"].indices.tolist() for r in vectors.present_slots(df, "text").collect()] == distinct
    assert model.stages[-1].docFreq[int(plain(b"cats").hexdigest()[:3], 16)] == 2
    assert vectors.embed_text(df, model, keep=["id"]).columns == ["id", "embedding"]
