import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import zstandard
from test_quality import area

from perilake.llm import quality, toxicity
from perilake.llm.shared import table


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    docs = docs.join(labels.select("doc_id"), "doc_id").repartition(8)
    model = toxicity.train(docs, labels)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = quality.score(docs, model, folds=4, held=2).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [(r.score, truth[r.doc_id], r.predicted) for r in rows if r.held_out]
    assert area([h[0] for h in held], [h[1] for h in held]) > 0.88
    assert np.mean([h[1] == h[2] for h in held]) > 0.91


def test_windows_hold_the_whole_text():
    for text in (b"", b"x" * 1000, "é ü ".encode() * 300, b" ".join(b"w%d" % i for i in range(500))):
        parts = toxicity.windows_of(text)
        assert b"".join(parts) == text.lower() and max(map(len, parts)) <= toxicity.WINDOW


def test_weights_separate_and_stay_finite():
    x = np.array([[0.0], [1.0], [2.0], [3.0]])
    w = toxicity.fit_weights(x, np.array([0, 0, 1, 1]))
    assert np.isfinite(w).all() and w[0] > 0
    assert toxicity.fit_weights(x, np.zeros(4, int))[0] == 0


def test_nulls_empty_tables_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, None, "p", 1), (None, "a b", "p", 1), (2, "", "q", 0), (2, "", "q", 0), (3, "z" * 9000, None, 0)],
                                 "doc_id long, text string, body string, label int")
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0), (2, 1), (2, 0), (3, 1)], "doc_id long, toxic int")
    for known in (labels, labels.limit(0)):
        rows = quality.score(docs, toxicity.train(docs, known)).collect()
        assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert quality.score(docs.limit(0), toxicity.train(docs.limit(0), labels)).count() == 0


def test_copies_of_a_toxic_document_keep_its_words(spark):
    name = lambda i: "".join(chr(97 + int(c)) for c in f"{i:03d}")
    own = [(f"you {name(i)} blockhead {name(i + 500)} left", 1) for i in range(20)] + [(f"fine {name(i)} day", 0) for i in range(40)]
    edited = [(f"you {name(0)} blockhead {name(500)} left {name(i)}", 1) for i in range(1, 5)]
    lone = [(f"{name(i)} before a solitary after", 1) for i in range(6)]
    for rows in (own, own + own[:1] * 30, own + own[:1] * 5 + edited + lone):
        toxic = toxicity.dictionaries(spark.createDataFrame(rows, "body string, label int").repartition(3)).toxic
        assert b" blockhead " in toxic and b"solitary" not in toxic


def brute_shrunk(rows):
    """Telling terms by plain counting over all pairs of a text and a word."""
    rows = sorted(set(rows))
    counts, company = Counter(), defaultdict(set)
    each = []
    for body, label in rows:
        words = re.findall(r"[a-zé]+", body.lower())
        first = {}
        for i, word in enumerate(words):
            for term in {word} | {word[:n] for n in (4, 5, 6, 7) if len(word.encode()) > n}:
                first.setdefault(term, (i, (words[i - 1] if i else "", words[i + 1] if i + 1 < len(words) else "")))
        each.append((label, first))
        for term, (_, beside) in first.items():
            if label == 1:
                company[term].add(beside)
            else:
                counts[term] += 1
    n1, n0 = sum(label == 1 for _, label in rows), sum(label != 1 for _, label in rows)
    telling = {t for t, c in company.items() if len(c) >= 4 and len(c) * n0 >= 8 * n1 * (counts[t] + 0.5)}
    out = []
    for label, first in each:
        if label == 1 and telling & set(first):
            at = {}
            for term in telling & set(first):
                at[first[term][0]] = max(at.get(first[term][0], ""), term)
            out.append(" ".join(at[i] for i in sorted(at)))
    return sorted(out), n1, n0


def test_shrunk_texts_equal_brute_force(spark):
    draw = random.Random(5)
    names = ["".join(draw.choice("abcde") for _ in range(draw.randint(1, 9))) for _ in range(60)]
    rows = [(" ".join(draw.choice(names) for _ in range(draw.randint(0, 25))), 0) for _ in range(150)]
    for _ in range(60):
        words = [draw.choice(names) for _ in range(draw.randint(3, 25))]
        for _ in range(draw.randint(0, 3)):
            words.insert(draw.randint(0, len(words)), draw.choice(["Blockhead", "blockheads", "zz", "zounds"]))
        rows.append((" ".join(words), 1))
    rows += rows[-5:]
    expected, n1, n0 = brute_shrunk(rows)
    made = toxicity.shrunk(spark.createDataFrame(rows, "body string, label int").distinct().repartition(5), n1, n0)
    assert sorted(bytes(r.body).decode() for r in made.collect()) == expected and len(expected) > 20


def test_terms_of_scripts_without_blanks_and_long_words():
    terms = toxicity.terms_of("你好世界 ok".encode())
    assert terms["好世".encode()] == (3, "你 界".encode()) and terms[b"ok"][0] == 13
    assert "你好世界".encode() not in terms and toxicity.terms_of(b"") == {}
    assert toxicity.terms_of(b"x" * 100_000)[b"x" * 100_000] == (0, b" ")


def test_scores_equal_plain_compression(spark):
    d = "/root/testdata/sf0.01"
    docs = table(spark, d, "documents")
    model = toxicity.train(docs, table(spark, d, "labels"))
    texts = {r.doc_id: (r.text or "").encode().lower() for r in docs.collect()}

    def length(content, window):
        made = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        how = zstandard.ZstdCompressionParameters.from_level(
            toxicity.LEVEL, source_size=toxicity.WINDOW, dict_size=len(content), write_content_size=False,
            write_checksum=False, write_dict_id=False)
        return len(zstandard.ZstdCompressor(dict_data=made, compression_params=how).compress(window))

    rows = quality.score(docs, model, folds=4, held=2).orderBy("doc_id").collect()
    assert len(rows) == len(texts)
    for r in rows[::40]:
        gains = sorted(length(model.ordinary, w) - length(model.toxic, w) for w in toxicity.windows_of(texts[r.doc_id]))
        top = ([gains[0]] * 3 + gains)[-3:] if len(gains) > 2 else [gains[0], gains[-2:][0], gains[-1]]
        n = len(gains)
        x = [top[2], top[1], top[0], sum(gains) / n, math.log1p(n), *(math.log1p(sum(g >= k for g in gains)) for k in (2, 3, 4, 5, 6)),
             sum(g >= 3 for g in gains) / n, sum(g >= 5 for g in gains) / n]
        z = sum(a * b for a, b in zip(x, model.weights)) + model.weights[-1]
        assert abs(r.score - 1 / (1 + math.exp(-max(-35, min(35, z))))) < 1e-9
