"""Shape features of whole texts for linear classifiers, a batch at a time."""

from __future__ import annotations

import numpy as np

from perilake.llm.batches import LOWER, mix, word_bounds, word_hashes

TRIGRAMS = 128
#: Shares of the ASCII bytes and of all others, hashed trigrams; length, lines, capitals,
#: blanks, word length, share of distinct words, constant.
WIDTH = 129 + TRIGRAMS + 7
#: Bytes of text that are counted at a time.
BLOCK = 1 << 20


def _counts(group: np.ndarray, bucket: np.ndarray, n: int, width: int) -> np.ndarray:
    return np.bincount(group * width + bucket, minlength=n * width).reshape(n, width)


def shape_features(texts: list[bytes]) -> np.ndarray:
    """One row of ``WIDTH`` numbers per text; an empty text has the constant only."""
    out = np.zeros((len(texts), WIDTH))
    start = 0
    while start < len(texts):
        stop, size = start, 0
        while stop < len(texts) and (stop == start or size + len(texts[stop]) <= BLOCK):
            size += len(texts[stop])
            stop += 1
        part = texts[start:stop]
        if len(part) == 1 and size > BLOCK:
            # A very long text is counted in pieces that overlap by two bytes.
            counts = sum(_block([part[0][max(0, at - 2):at + BLOCK]], min(at, 2)) for at in range(0, size, BLOCK))
        else:
            counts = _block(part, 0)
        out[start:stop] = _scaled(counts, np.array([len(x) for x in part]), _words(part))
        start = stop
    return out


def _block(texts: list[bytes], known: int) -> np.ndarray:
    """Raw counts of each text; the first ``known`` bytes count for trigrams only."""
    n, sizes = len(texts), np.array([len(x) for x in texts])
    data = np.frombuffer(b"".join(texts), np.uint8)
    group = np.repeat(np.arange(n), sizes)
    single, owner = data[known:], group[known:]
    histogram = _counts(owner, np.minimum(single, 128).astype(np.int64), n, 129)
    lower = LOWER[data].astype(np.int64)
    hashed = ((lower[:-2] * 961 + lower[1:-1] * 31 + lower[2:]) * 2654435761 >> 12) % TRIGRAMS
    whole = group[:-2] == group[2:]
    trigrams = _counts(group[:-2][whole], hashed[whole], n, TRIGRAMS)
    return np.hstack([histogram, trigrams])


def _words(texts: list[bytes]) -> np.ndarray:
    """Mean bytes of a word and share of distinct words of each text."""
    data = LOWER[np.frombuffer(b"\n".join(texts), np.uint8)]
    starts, ends = word_bounds(data)
    owner = np.searchsorted(np.cumsum([len(x) + 1 for x in texts]), starts, "right")
    total = np.maximum(np.bincount(owner, minlength=len(texts)), 1)
    length = np.bincount(owner, ends - starts, minlength=len(texts)) / total
    marked = mix(word_hashes(data, starts, ends) + mix(owner.astype(np.uint64)))
    _, first = np.unique(marked, return_index=True)
    return np.stack([length / 10, np.bincount(owner[first], minlength=len(texts)) / total], 1)


def _scaled(counts: np.ndarray, sizes: np.ndarray, by_word: np.ndarray) -> np.ndarray:
    total = np.maximum(sizes, 1)[:, None]
    blanks = counts[:, [32, 9, 10, 13]].sum(1)
    rest = np.stack([np.log1p(sizes) / 10, counts[:, 10] / (1 + blanks), counts[:, 65:91].sum(1) / total[:, 0],
                      blanks / total[:, 0], by_word[:, 0], by_word[:, 1], np.ones(len(sizes))], 1)
    return np.hstack([np.sqrt(counts / total), rest])
