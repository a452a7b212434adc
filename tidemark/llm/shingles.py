"""Sets of word shingles as 64-bit fingerprints, many texts at a time."""

from __future__ import annotations

import numpy as np

from tidemark.llm.common import LOWER, mix64, word_hashes

#: Words of a shingle.
SHINGLE = 5
#: Shingles that are hashed at once.
AT_ONCE = 1 << 17
STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: list[bytes], seed: int = 0, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, sorted within it, and the bounds of the
    texts in them.

    Words are runs of bytes other than 0x20 and 0x09-0x0D, A-Z in lower case.
    A text of fewer words than a shingle has its whole sequence as one, none
    without words."""
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    starts = np.cumsum(lengths) - lengths
    words, at = word_hashes(b" ".join(texts).translate(LOWER))
    counts = np.bincount(np.searchsorted(starts, at, side="right") - 1, minlength=len(texts)) if len(texts) else np.zeros(0, np.int64)
    first = np.cumsum(counts) - counts
    whole = counts >= size
    n = np.where(whole, counts - size + 1, (counts > 0).astype(np.int64))
    bounds = np.concatenate([[0], np.cumsum(n)])
    h = np.empty(int(bounds[-1]), np.uint64)
    for low in range(0, len(h), AT_ONCE):
        # only these many shingles have their places in memory
        nth = np.arange(low, min(len(h), low + AT_ONCE))
        doc = np.searchsorted(bounds, nth, side="right") - 1
        place = first[doc] + nth - bounds[doc]
        long = whole[doc]
        x = mix64(words[place] + np.uint64(seed + 1) * STEP)
        for i in range(1, size):
            use = long | (i < counts[doc])
            nxt = words[np.minimum(place + i, max(len(words) - 1, 0))]
            x = np.where(use, mix64(x * STEP + nxt), x)
        h[low : low + len(nth)] = np.where(long, x, mix64(x + np.uint64(17)))
    if len(texts) == 1:
        h = np.unique(h)
        return h, np.array([0, len(h)])
    doc = np.repeat(np.arange(len(texts)), n)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])) if len(h) else np.zeros(0, bool)
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(texts) + 1))
