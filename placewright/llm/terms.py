"""Terms of texts for the operators that count or look words up: runs of digits, letters and characters beyond ASCII."""

from __future__ import annotations

import numpy as np

from placewright.llm.common import Texts

#: Per byte: A-Z as a-z, others as they are; and whether a lower-cased byte belongs to a term. Bytes from 0x80 on make up all characters beyond ASCII.
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32
_IN_TERM = np.zeros(256, dtype=bool)
_IN_TERM[48:58] = _IN_TERM[97:123] = _IN_TERM[128:] = True


def terms_of(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, start and end of each term, and the number of the first term of each text (and of all, last)."""
    data = LOWERED[texts.data]
    inside = np.concatenate([[False], _IN_TERM[data], [False]])
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[texts.bounds] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    return data, starts, ends, np.searchsorted(starts, texts.bounds)
