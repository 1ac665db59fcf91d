"""SentencePiece encoding and decoding by a Viterbi search shared between words.

The words of a batch, with their blanks marked, are made distinct and sorted, which is
a depth-first walk over their trie: each word goes on from the forward states of the
prefix it shares with the word before it. Ids of the distinct words are then put in
place of all words with Arrow's dictionary operations. There is no shuffle.

In a unigram model, the forward state of a prefix is its best score and last piece. In
a BPE model, scores don't add up: the encoding of a text is the one path on which every
two neighbouring pieces would stay apart if they were merged by themselves (a merge
over a seam needs only the two pieces beside it, and up to the first such merge each
piece evolves alone). The search therefore admits a step from one piece to the next
only if merging the two gives the same two. Exactly one last piece is left for each
prefix, and the result is what SentencePiece returns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perilake.llm.batches import pieces

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
#: Seams and words that a task remembers; forgetting them changes no result.
SEAMS, WORDS = 1 << 18, 200_000


class Subwords:
    """Pieces of a model file, read once on the driver; a few MB, whatever the data."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto.FromString(model)
        trained, normal = proto.trainer_spec, proto.normalizer_spec
        if trained.model_type not in (1, 2) or normal.precompiled_charsmap or normal.remove_extra_whitespaces \
                or not normal.escape_whitespaces or trained.treat_whitespace_as_suffix:
            raise ValueError("expected a unigram or BPE model without text normalisation")
        kinds = {p.type for p in proto.pieces}
        if USER in kinds:
            raise ValueError("models with user-defined pieces aren't supported")
        self.merges, self.prefix = trained.model_type == 2, MARK * normal.add_dummy_prefix
        self.scores = {p.piece: p.score for p in proto.pieces if p.type == NORMAL}
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("expected marks at the start of pieces only")
        by_byte = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.bytes = [by_byte[f"<0x{b:02X}>"] for b in range(256)] if trained.byte_fallback else None
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == UNKNOWN)
        self.unknown_score = min(self.scores.values()) - 10
        self.surface = [
            bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else b"" if p.type == CONTROL
            else " ⁇ ".encode() if p.type == UNKNOWN else p.piece.replace(MARK, " ").encode()
            for p in proto.pieces]
        joined = {c for p in self.ids if len(p) > 1 for c in p}
        # A line feed that is part of no longer piece parts the text like a blank.
        stop = "" if "\n" in joined else "\n"
        self.word = re.compile(f"{MARK}+[^{MARK}{stop}]*|[^{MARK}{stop}]+" + (f"|{stop}" if stop else ""))
        self.pieces = {p for p in self.ids if not self.merges or self.merged(p) == [p]}
        self.tails = {p[i:] for p in self.pieces for i in range(len(p))}
        self.seams: dict[tuple[str, str], bool] = {}

    def merged(self, text: str) -> list[str]:
        """Merge the best neighbouring pair until none is left; for short texts."""
        parts = list(text)
        while True:
            pairs = [(self.scores[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.scores]
            if not pairs:
                return parts
            at = -max(pairs)[1]
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def apart(self, left: str, right: str) -> bool:
        """Whether two neighbouring pieces stay as they are."""
        known = self.seams.get((left, right))
        if known is None:
            if len(self.seams) >= SEAMS:
                self.seams.clear()
            known = self.seams[left, right] = self.merged(left + right) == [left, right]
        return known

    def paths(self, words: list[str]) -> Iterator[list[str]]:
        """Pieces of each of the sorted words; forward states of a common prefix are kept."""
        walk = self._merge_on if self.merges else self._score_on
        before, last, scores = "", [""], [0.0]
        for word in words:
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del last[shared + 1:], scores[shared + 1:]
            walk(word, shared, last, scores)
            before, out, end = word, [], len(word)
            while end:
                out.append(last[end])
                end -= len(last[end])
            yield out[::-1]

    def _merge_on(self, word: str, end: int, last: list[str], scores: list[float]) -> None:
        """Extend the last piece of each prefix of ``word`` beyond ``end``; one fits."""
        known, seams, apart = self.pieces, self.seams, self.apart
        for end in range(end + 1, len(word) + 1):
            start = end - 1
            while True:
                tail = word[start:end]
                if tail in known or start == end - 1:
                    if not start:
                        break
                    seam = last[start], tail
                    if seams[seam] if seam in seams else apart(*seam):
                        break
                start -= 1
            last.append(tail)

    def _score_on(self, word: str, end: int, last: list[str], scores: list[float]) -> None:
        """Extend the best score and last piece of each prefix of ``word`` beyond ``end``."""
        for end in range(end + 1, len(word) + 1):
            best, piece = -np.inf, ""
            for start in range(end - 1, -1, -1):
                tail = word[start:end]
                if tail in self.pieces or start == end - 1:
                    score = scores[start] + self.scores.get(tail, self.unknown_score)
                    if score > best:
                        best, piece = score, tail
                if tail not in self.tails:
                    break
            last.append(piece)
            scores.append(best)

    def numbers(self, path: list[str]) -> list[int]:
        """Ids of a path; an unknown character becomes its bytes, or the unknown id."""
        out = []
        for piece in path:
            known = self.ids.get(piece)
            if known is not None:
                out.append(known)
            elif self.bytes:
                out += [self.bytes[b] for b in piece.encode()]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def marked(self, text: str) -> list[str]:
        return self.word.findall(self.prefix + text.replace(" ", MARK)) if text else []

    def text(self, ids: list[int]) -> str:
        out = b"".join([self.surface[i] for i in ids]).decode(errors="replace")
        return out[1:] if self.prefix and out.startswith(" ") else out


def _encode(shared, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, kept = shared.value, {}
        for whole in batches:
            for batch in pieces(whole, "body"):
                words, counts = [], []
                for text in batch.column("body").to_pylist():
                    found = model.marked(text or "")
                    words += found
                    counts.append(len(found))
                coded = pa.array(words, pa.string()).dictionary_encode()
                distinct = coded.dictionary.to_pylist()
                if len(kept) > WORDS:
                    kept.clear()
                new = sorted(w for w in distinct if w not in kept)
                kept.update(zip(new, map(model.numbers, model.paths(new))))
                ids = pa.array([kept[w] for w in distinct], pa.list_(pa.int32())).take(coded.indices)
                ends = np.concatenate(([0], np.asarray(ids.offsets)))[np.cumsum([1, *counts])]
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids.flatten())
                same = [None] * len(batch)
                if not keep_text:
                    flat = np.asarray(ids.flatten())
                    same = [model.text(flat[a:b].tolist()) == (t or "")
                            for a, b, t in zip(ends, ends[1:], batch.column("body").to_pylist())]
                yield pa.RecordBatch.from_pydict({
                    "others": batch.column("others"), "ids": ids, "same": pa.array(same, pa.bool_()),
                    "body": batch.column("body") if keep_text else pa.nulls(len(batch), pa.string())})
    return run


def _decode(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.slice(at, 64)
                texts = [None if x is None else shared.value.text(x) for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_pydict({
                    "others": part.column("others"), "text": pa.array(texts, pa.string())})
    return run


def _load(spark, model_path: str):
    """The model, from a file on the driver's machine, for all tasks."""
    with open(model_path, "rb") as f:
        return spark.sparkContext.broadcast(Subwords(f.read()))


def _encoded(docs: DataFrame, model_path: str, text_col: str, ids_col: str, keep_text: bool) -> DataFrame:
    others = [c for c in docs.columns if c not in (text_col, ids_col)]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in others], F.lit(0).alias("_")).alias("others"),
                       F.col(f"`{text_col}`").alias("body"))
    kind = rows.schema["others"].dataType.simpleString()
    return rows.mapInArrow(_encode(_load(docs.sparkSession, model_path), keep_text),
                           f"others {kind}, ids array<int>, same boolean, body string")


def encode(docs: DataFrame, model_path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """All rows and columns of ``docs`` and the token ids of the text as the last column.

    A column that is named like ``ids_col`` is replaced. A null or empty text has no
    ids. A text's own mark characters are taken for blanks, as in SentencePiece. An
    empty table gives an empty result.
    """
    out = _encoded(docs, model_path, text_col, ids_col, True)
    return out.select(*[F.col("body").alias(c) if c == text_col else F.col(f"others.`{c}`").alias(c)
                        for c in docs.columns if c != ids_col], F.col("ids").alias(ids_col))


def encode_checked(docs: DataFrame, model_path: str, text_col: str = "text", ids_col: str = "ids",
                   check_col: str = "round_trip") -> DataFrame:
    """Like ``encode``, without the text; says instead whether the ids decode to it (null: empty)."""
    out = _encoded(docs, model_path, text_col, ids_col, False)
    return out.select(*[F.col(f"others.`{c}`").alias(c) for c in docs.columns if c not in (text_col, ids_col, check_col)],
                      F.col("ids").alias(ids_col), F.col("same").alias(check_col))


def decode(rows: DataFrame, model_path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``rows`` and the text of the ids as the last column.

    A column that is named like ``text_col`` is replaced. Null ids give a null text,
    no ids an empty one; bytes that aren't UTF-8 become replacement characters.
    """
    others = [c for c in rows.columns if c != text_col]
    packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("others"), F.col(f"`{ids_col}`").alias("ids"))
    kind = packed.schema["others"].dataType.simpleString()
    out = packed.mapInArrow(_decode(_load(rows.sparkSession, model_path)), f"others {kind}, text string")
    return out.select(*[F.col(f"others.`{c}`").alias(c) for c in others], F.col("text").alias(text_col))
