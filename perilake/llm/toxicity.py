"""Toxicity by compression distance with two zstandard dictionaries.

The ordinary dictionary is trained by zstandard on windows of ordinary texts, the toxic
one on what toxic training texts have and ordinary ones lack: each text shrinks to its
terms in at least ``MIN_DOCS`` different companies (what stands beside them) and
``TELLING`` times as frequent in toxic texts. Trained on whole toxic windows, it holds
mostly ordinary text, and the insults are lost. A term is a word or a beginning of one,
and two or three neighbouring characters in scripts without blanks. Equal texts count
once; an edited copy adds to a term only where it stands in other company, and takes
nothing from it. The ordinary dictionary follows the trained one in the toxic one: as
both share that part, a window compresses equally well with either unless it holds toxic
material; two dictionaries without a common part differ by chance more than by a few
words in a long text.

Each text is cut into windows whole. The differences of the compressed lengths give
a few features, and a logistic fit on other labelled documents turns them into the
probability of label 1. Of the ``SIZES`` of the toxic dictionary, the one with the least
loss on those documents stays.

Two thirds (by hash) of a bounded sample of labelled rows train the dictionaries, the
rest calibrates. Terms are counted and texts shrunk by Spark; the driver gets at most
``WINDOWS`` windows for each dictionary and one row of features per calibration document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perilake.llm.batches import byte_rows, pieces
from perilake.llm.labelled import training_labels
from perilake.llm.shared import cut

SAMPLE, WINDOWS = 20_000, 30_000
WINDOW, LEVEL, DICTIONARY = 64, 9, 8192
#: Bytes of the toxic dictionary, and of the segments and matches it is trained by.
SIZES, SEGMENT, MATCH = (384, 768, 1536, 3072, 6144), 32, 8
MIN_DOCS, TELLING = 4, 8
#: Bytes gained in a window from which on windows are counted.
GAINS = (2, 3, 4, 5, 6)
#: Bytes of the beginnings of words that count beside whole words.
BEGINNINGS = (4, 5, 6, 7)
#: A run of characters of a script without blanks, or a word without general punctuation.
WORD = re.compile(rb"((?:[\xe3-\xe9][\x80-\xbf]{2})+)|(?:[A-Za-z]|[\xc2-\xdf][\x80-\xbf]|\xe2[\x81-\xbf][\x80-\xbf]"
                  rb"|[\xe0\xe1\xea-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3})+")
FEATURES = 12


def windows_of(text: bytes) -> list[bytes]:
    """A whole text in windows of at most ``WINDOW`` bytes, cut before blanks where there are any."""
    out, at, text = [], 0, text.lower()
    while len(text) - at > WINDOW:
        stop = text.rfind(b" ", at + 1, at + WINDOW)
        stop = stop if stop > at else at + WINDOW
        out.append(text[at:stop])
        at = stop
    out.append(text[at:])
    return out


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    made = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    how = zstandard.ZstdCompressionParameters.from_level(
        LEVEL, source_size=WINDOW, dict_size=len(content), write_content_size=False, write_checksum=False,
        write_dict_id=False)
    made.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=made, compression_params=how)


@dataclass
class Distance:
    """Both dictionaries, and the weights that turn features into a probability."""

    toxic: bytes
    ordinary: bytes
    weights: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES + 1))
    #: Toxic dictionaries of other sizes.
    others: tuple[bytes, ...] = ()

    def features(self, texts: list[bytes]) -> np.ndarray:
        ordinary, toxic = _compressor(self.ordinary).compress, _compressor(self.toxic).compress
        out = np.zeros((len(texts), FEATURES))
        for row, text in zip(out, texts):
            d = np.array([len(ordinary(w)) - len(toxic(w)) for w in windows_of(text)], float)
            top = np.sort(d)[-3:]
            row[:] = (top[-1], top[-2:][0], top[0], d.mean(), np.log1p(len(d)), *(np.log1p((d >= k).sum()) for k in GAINS),
                      (d >= 3).mean(), (d >= 5).mean())
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        z = self.features(texts) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit_weights(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Logistic weights and offset by Newton's method; one class only gives its smoothed share."""
    n1, n0 = y.sum(), (1 - y).sum()
    share = (n1 + 1) / (n1 + n0 + 2)
    if not n1 or not n0:
        return np.r_[np.zeros(x.shape[1]), np.log(share / (1 - share))]
    middle, spread = x.mean(0), np.where(x.std(0) > 1e-9, x.std(0), 1)
    z = np.hstack([(x - middle) / spread, np.ones((len(x), 1))])
    penalty = ridge * np.r_[np.ones(x.shape[1]), 0]
    w = np.r_[np.zeros(x.shape[1]), np.log(share / (1 - share))]
    loss = lambda w: (np.logaddexp(0, z @ w) - y * (z @ w)).sum() + (penalty * w * w).sum() / 2
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-9), z.T @ (p - y) + penalty * w)
        size = 1.0
        while loss(w - size * step) > loss(w) and size > 1e-6:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return np.r_[w[:-1] / spread, w[-1] - (w[:-1] * middle / spread).sum()]


def loss_of(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> float:
    z = x @ weights[:-1] + weights[-1]
    return float((np.logaddexp(0, z) - y * z).mean()) if len(y) else 0.0


def terms_of(text: bytes) -> dict[bytes, tuple[int, bytes]]:
    """The terms of a text, with the first place of each and what stands beside it there."""
    found = [(m.group().lower(), m.start(), m.group(1) is not None) for m in WORD.finditer(text)]
    out: dict[bytes, tuple[int, bytes]] = {}
    for i, (word, at, unspaced) in enumerate(found):
        if unspaced:
            for k in range(0, len(word), 3):
                for n in (6, 9):
                    if k + n <= len(word):
                        out.setdefault(word[k:k + n], (at + k, word[max(k - 3, 0):k] + b" " + word[k + n:k + n + 3]))
        else:
            beside = b"%b %b" % (found[i - 1][0] if i else b"", found[i + 1][0] if i + 1 < len(found) else b"")
            for term in (word, *(word[:n] for n in BEGINNINGS if n < len(word))):
                out.setdefault(term, (at, beside))
    return out


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in pieces(whole, "body"):
            rows = [(i, term, at, xxhash.xxh3_64_intdigest(beside) >> 1)
                    for i, text in enumerate(byte_rows(batch.column("body")))
                    for term, (at, beside) in terms_of(text).items()]
            at_row = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_pydict({
                "text_key": batch.column("text_key").take(at_row), "label": batch.column("label").take(at_row),
                "term": pa.array([r[1] for r in rows], pa.binary()), "at": pa.array([r[2] for r in rows], pa.int64()),
                "beside": pa.array([r[3] for r in rows], pa.int64())})


def shrunk(labelled: DataFrame, n1: int, n0: int) -> DataFrame:
    """Toxic texts as their telling terms, in the order of first places: body.

    ``labelled`` holds distinct pairs of body and label, ``n1`` of them toxic. Of terms that
    start at one place the longest stays; texts without a telling term are left out.
    """
    one = F.col("label") == 1
    terms = labelled.withColumn("text_key", F.xxhash64("body")) \
        .mapInArrow(_terms, "text_key long, label int, term binary, at long, beside long")
    counts = terms.groupBy("term").agg(F.count_if(~one).alias("n0"),
                                       F.count_distinct(F.when(one, F.col("beside"))).alias("company"))
    telling = counts.filter((F.col("company") >= MIN_DOCS)
                            & (F.col("company") * max(n0, 1) >= TELLING * max(n1, 1) * (F.col("n0") + 0.5)))
    # Terms that start together are beginnings of one another, so the greatest is the longest.
    longest = terms.filter(one).join(telling.select("term"), "term", "left_semi") \
        .groupBy("text_key", "at").agg(F.max("term").alias("term"))
    return longest.groupBy("text_key").agg(F.array_sort(F.collect_list(F.struct("at", "term"))).alias("found")) \
        .select(F.expr("CAST(array_join(transform(found, f -> CAST(f.term AS STRING)), ' ') AS BINARY)").alias("body"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in pieces(whole, "body"):
            yield pa.RecordBatch.from_pydict({"part": pa.array(
                [w for text in byte_rows(batch.column("body")) for w in windows_of(text)], pa.binary())})


def _windows(texts: DataFrame) -> list[bytes]:
    """At most ``WINDOWS`` windows of the texts, by hash."""
    # Windows are thinned by hash first, so that no more than about twice the number reaches the driver.
    n = texts.agg(F.coalesce(F.sum(1 + F.octet_length("body") / WINDOW), F.lit(0.0)).alias("n")).first().n
    return [bytes(r.part) for r in texts.mapInArrow(_cut, "part binary")
            .filter(F.pmod(F.xxhash64("part", F.lit("thin")), F.lit(max(1, int(n) // WINDOWS))) == 0)
            .orderBy(F.xxhash64("part"), "part").limit(WINDOWS).collect()]


def _trained(parts: list[bytes], size: int, **how: int) -> bytes:
    try:
        return zstandard.train_dictionary(size, parts, **how).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too little text to train on
        return b" ".join(dict.fromkeys(parts))[:size]


def dictionaries(labelled: DataFrame) -> Distance:
    """Both dictionaries from labelled texts: body, label. Equal texts of one label count once."""
    labelled = cut(labelled.select("body", "label").distinct())
    sizes = {r.label: r.n for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sum(n for k, n in sizes.items() if k != 1)
    ordinary = _trained(_windows(labelled.filter(F.col("label") != 1).select("body")), DICTIONARY)
    ordinary = ordinary if len(ordinary) >= 8 else b" " * 8  # zstandard needs some content
    parts = _windows(cut(shrunk(labelled, n1, n0)))
    toxic = [b" %b %b" % (_trained(parts, size, k=SEGMENT, d=MATCH), ordinary) for size in SIZES]
    toxic = list(dict.fromkeys(toxic))
    return Distance(toxic[0], ordinary, others=tuple(toxic[1:]))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id",
          text_col: str = "text", folds: int = 4, held: int = 2, sample: int = SAMPLE) -> Distance:
    """Fit on at most ``sample`` labelled ids outside the held-out fold.

    Null texts count as empty. Where rows share an id, its least features count in the
    calibration. Repeated rows train once. Without toxic labels, without labels and in an
    empty table both dictionaries compress alike, and every text gets the smoothed share of label 1.
    """
    known = F.broadcast(training_labels(labels, id_col, label_col, folds, held, sample))
    rows = docs.select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col).alias("body")).join(known, "row_id")
    third = F.pmod(F.xxhash64("row_id", F.lit("third")), F.lit(3))
    model = dictionaries(rows.filter(third > 0).select("body", "label"))
    tried = [Distance(toxic, model.ordinary) for toxic in (model.toxic, *model.others)]

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "body"):
                texts = byte_rows(batch.column("body"))
                found = np.hstack([one.features(texts) for one in tried])
                yield pa.RecordBatch.from_pydict({"row_id": batch.column("row_id"), "label": batch.column("label"),
                                                  "x": pa.array(list(found), pa.list_(pa.float64()))})

    # One row for each labelled id, however many rows share it.
    seen = rows.filter(third == 0).select("row_id", "body", "label") \
        .mapInArrow(measured, "row_id long, label int, x array<double>") \
        .groupBy("row_id").agg(F.min("label").alias("label"), F.min("x").alias("x")).collect()
    x = np.array([r.x for r in seen]).reshape(-1, len(tried), FEATURES)
    y = np.array([r.label == 1 for r in seen], int)
    for k, one in enumerate(tried):
        one.weights = fit_weights(x[:, k], y)
    return min(enumerate(tried), key=lambda at: (loss_of(x[:, at[0]], y, at[1].weights), at[0]))[1]
