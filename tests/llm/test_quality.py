import random
import zlib

import numpy as np
import pytest

from perilake.llm import features, quality
from perilake.llm.features import WIDTH, shape_features
from perilake.llm.labelled import calibrate, probability
from perilake.llm.shared import table


def area(scores, labels):
    order = np.argsort(scores, kind="stable")
    ranks = np.empty(len(scores))
    ranks[order] = np.arange(1, len(scores) + 1)
    n1 = sum(labels)
    return (ranks[np.array(labels) == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(labels) - n1))


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    model = quality.train(docs, labels)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    rows = quality.score(docs, model).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
        assert r.predicted == (r.score >= 0.3)
    held = [(r.score, truth[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in truth]
    assert area([h[0] for h in held], [h[1] for h in held]) > 0.95
    assert np.mean([h[1] == h[2] for h in held]) > 0.9
    kept = quality.accepted(docs, model)
    assert kept.schema == docs.schema and kept.count() == sum(r.predicted for r in rows)


def test_training_labels_outside_the_fold_only(spark):
    docs = spark.createDataFrame([(i, "word " * (i % 7 + 1) if i % 2 else "#" * 40) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    wrong = spark.createDataFrame([(i, 1 - i % 2 if zlib.crc32(str(i).encode()) % 5 == 0 else i % 2) for i in range(60)],
                                  "doc_id long, quality int")
    assert np.array_equal(quality.train(docs, labels).weights, quality.train(docs, wrong).weights)


def test_risk_is_the_smallest():
    rng = np.random.default_rng(2)
    x = np.hstack([rng.normal(size=(400, WIDTH - 1)) * 0.1, np.ones((400, 1))])
    good = x[:100] + np.r_[0.2, np.zeros(WIDTH - 2), 0]
    x = np.vstack([x, good])
    w = quality.minimise(x.T @ x, good.T @ good, 0.4, ridge=0.05)
    spread = x[:, :-1].std(0)

    def risk(w):
        pos, neg = (good @ w - 1) ** 2, ((x @ w + 1) ** 2).mean() - 0.4 * ((good @ w + 1) ** 2).mean()
        scaled = w[:-1] * spread
        offset = w[-1] + w[:-1] @ x[:, :-1].mean(0)
        return 0.4 * pos.mean() + max(0, neg) + 0.05 * (scaled @ scaled + offset ** 2)

    assert all(risk(w) <= risk(w + rng.normal(size=WIDTH) * s) + 1e-9 for s in (1e-3, 1e-2, 0.1) for _ in range(50))


def test_very_long_texts_count_like_short_ones(monkeypatch):
    texts = [b"Hello World \n" * 3000, b"", b"x y"]
    want = shape_features(texts)
    monkeypatch.setattr(features, "BLOCK", 1000)
    assert np.allclose(shape_features(texts), want)


@pytest.mark.parametrize("labels", [[0, 0, 0, 1, 1, 1], [0, 1, 0, 1, 1, 1], [1] * 6])
def test_calibration(labels):
    p = probability(np.arange(6.0), *calibrate(np.arange(6.0), np.array(labels)))
    assert all(0 <= x <= 1 for x in p) and list(p) == sorted(p)


def test_nulls_empty_tables_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, None, "p", 1), (None, "a b", "p", 1), (2, "", "q", 0), (2, "", "q", 0)],
                                 "doc_id long, text string, body string, label int")
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0), (2, 1), (2, 0)], "doc_id long, quality int")
    for known in (labels, labels.limit(0)):
        rows = quality.score(docs, quality.train(docs, known)).collect()
        assert len(rows) == 4 and all(0 <= r.score <= 1 for r in rows)
    assert quality.score(docs.limit(0), quality.train(docs.limit(0), labels)).count() == 0


def test_one_row_of_each_labelled_id_reaches_the_driver(spark, monkeypatch):
    """Thousands of rows with one id calibrate as one."""
    sizes = []
    real = quality.calibrate
    monkeypatch.setattr(quality, "calibrate", lambda s, y: (sizes.append(len(s)), real(s, y))[1])
    docs = spark.createDataFrame([(1, f"good words here number {i}") for i in range(3000)] + [(2, "bad"), (3, "nice text")],
                                 "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 40)], "doc_id long, quality int")
    quality.train(docs, labels)
    assert len(sizes) == 1 and sizes[0] <= 3


def test_sums_by_cell_equal_plain_products(spark):
    texts = [None, "", "word " * 50, "#" * 300, *(f"some text {i} here.\n" * (i % 9) for i in range(120))]
    rows = spark.createDataFrame([(t, i % 3 == 0) for i, t in enumerate(texts)], "body string, positive boolean")
    x = shape_features([(t or "").encode() for t in texts])
    good = x[::3]
    for parts in (1, 7, 150):
        every, found = quality.product_sums(rows.repartition(parts))
        assert np.allclose(every, x.T @ x, rtol=1e-12) and np.allclose(found, good.T @ good, rtol=1e-12)
    assert not quality.product_sums(rows.limit(0))[0].any()
