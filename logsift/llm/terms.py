"""Words of texts as byte ranges, with their hashes, for operators that split at other bytes than white space."""

from __future__ import annotations

import numpy as np

from .common import BASE, BASE2, BYTE_CODE, prefix_sums, span_hashes

#: Bytes with A-Z in lower case.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_set(chars: bytes | range) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


def token_spans(data: np.ndarray, offsets: np.ndarray, splits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each maximal run of bytes that don't split, and the text (by index) that holds it."""
    split = np.concatenate(([True], splits[data], [True]))
    inner = np.zeros(len(split), bool)  # a text's first byte starts a word whatever stands before it
    inner[offsets[1:-1] + 1] = True
    starts = np.flatnonzero(~split[1:-1] & (split[:-2] | inner[1:-1]))
    stops = np.flatnonzero(~split[1:-1] & (split[2:] | inner[2:])) + 1
    return starts, stops, np.searchsorted(offsets, starts, side="right") - 1


class Spans:
    """Two hashes of any byte ranges of data, which agree wherever the same bytes stand."""

    def __init__(self, data: np.ndarray):
        codes = BYTE_CODE[data]
        self.first, self.second = prefix_sums(codes, BASE), prefix_sums(codes, BASE2)

    def one(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        return span_hashes(self.first, starts, stops, BASE)

    def two(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        return span_hashes(self.second, starts, stops, BASE2)
