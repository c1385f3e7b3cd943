"""Word shingles of whole texts as 64-bit hashes: A-Z lower-cased, words split at space and 09-0D."""

from __future__ import annotations

import numpy as np

from . import rolling as R
from .common import column, row_groups, text_buffer

CHUNK = 1 << 19


def sequences(batch, name, n=5):
    """For chunks of rows: first row, hashes of the shingles in text order, offsets by row.

    A text of fewer than n words is one shingle, of its own kind; one without words has none.
    """
    buf, offs = text_buffer(column(batch, name))
    for lo, hi in row_groups(offs, CHUNK):
        one = R.lower(buf[offs[lo] : offs[hi]])
        starts, ends, wo = R.words(one, offs[lo : hi + 1] - offs[lo])
        p = R.prefix(R.word_hashes(one, starts, ends))
        nw = np.diff(wo)
        count = np.where(nw >= n, nw - n + 1, np.minimum(nw, 1))
        so = np.append(0, np.cumsum(count))
        at = R.ragged(wo[:-1], count)
        width = np.repeat(np.minimum(nw, n), count)
        h = R.mix(R.span(p, at, at + width) + width.astype(np.uint64))
        yield lo, h, so


def distinct(h: np.ndarray, so: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each row in ascending order, and their offsets."""
    h = h.copy()
    ends = so.tolist()
    for lo, hi in zip(ends, ends[1:], strict=False):  # sorting row by row takes less time than one sort by row and hash
        if hi - lo > 1:
            h[lo:hi].sort()
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    new[so[:-1][np.diff(so) > 0]] = True
    return h[new], np.append(0, np.cumsum(new))[so]
