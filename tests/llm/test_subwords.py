import random

import pytest

from perilake.llm.subwords import Subwords, decode, encode, encode_checked

spm = pytest.importorskip("sentencepiece")
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
TEXTS = ["", " ", "  a", "a   b  ", "\n\n x", "日本語 🙂 é́ ß", "▁x", "aaaaaaa" * 40, " " * 37 + "q", "\t\tx\x00y",
         "don't!!!!??? http://a.b/c_d-e", "<s> </s> <unk> <0x41>", "the thermal theatre then theme", None]


@pytest.fixture(scope="module")
def model():
    return Subwords(open(MODEL, "rb").read())


def ids_of(model, text):
    words = model.marked(text)
    known = dict(zip(sorted(set(words)), map(model.numbers, model.paths(sorted(set(words))))))
    return [i for w in words for i in known[w]]


def test_ids_are_those_of_the_library(model):
    library = spm.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz   \n.,ÉéßABC019▁"
    for text in [t or "" for t in TEXTS] + ["".join(rng.choices(letters, k=rng.randint(1, 300))) for _ in range(400)]:
        assert ids_of(model, text) == library.encode(text), text
        assert model.text(ids_of(model, text)) == library.decode(library.encode(text))


def test_unigram_scores_equal_the_best_of_all_paths(model):
    single = Subwords(open(MODEL, "rb").read())
    single.merges = False
    single.pieces = set(single.ids)
    single.tails = {p[i:] for p in single.pieces for i in range(len(p))}
    value = lambda path: sum(single.scores.get(p, single.unknown_score) for p in path)

    def best(word):
        scores = [0.0]
        for end in range(1, len(word) + 1):
            scores.append(max(scores[i] + single.scores.get(word[i:end], single.unknown_score) for i in range(end)
                              if word[i:end] in single.ids or i == end - 1))
        return scores[-1]

    words = sorted({"▁there", "▁therefore", "▁thermal", "▁q日q", "▁unbelievable"})
    for word, path in zip(words, single.paths(words)):
        assert "".join(path) == word and value(path) == best(word)


def test_rows_nulls_and_empty_table(spark):
    df = spark.createDataFrame([(i, t, "o", 3) for i, t in enumerate(TEXTS)], "doc_id long, text string, others string, body int")
    rows = encode(df, MODEL)
    library = spm.SentencePieceProcessor(model_file=MODEL)
    assert rows.columns == ["doc_id", "text", "others", "body", "ids"]
    for r in rows.collect():
        assert r.ids == library.encode(r.text or "") and (r.others, r.body) == ("o", 3)
    back = decode(rows.withColumnRenamed("text", "was"), MODEL).collect()
    assert all(r.text == (r.was or "").replace("▁", " ") for r in back)
    checked = encode_checked(df, MODEL)
    assert checked.columns == ["doc_id", "others", "body", "ids", "round_trip"]
    assert {r.doc_id: (r.ids, r.round_trip) for r in checked.collect()} == {
        i: (library.encode(t or ""), "▁" not in (t or "")) for i, t in enumerate(TEXTS)}
    assert encode(df.limit(0), MODEL).count() == 0
    only_text = encode(df.select("text"), MODEL)
    assert only_text.columns == ["text", "ids"] and only_text.count() == len(TEXTS)
