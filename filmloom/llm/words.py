"""Words of whole text columns as arrays of 64-bit hashes, computed batch by batch inside tasks.

The functions work on the UTF-8 bytes of an Arrow column, so no Python object is made per word.
A null text counts as an empty one. Memory is bounded by the slice of rows given (see ``slices``)
plus a fixed scratch size; a text longer than a slice is taken whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 4 << 20  # text bytes handled at once
PIECE = 1 << 20  # bytes hashed at once

_ALL = np.arange(256)
LOWER = np.where((_ALL >= 65) & (_ALL <= 90), _ALL + 32, _ALL).astype(np.uint8)
#: ``[^\x20\x09-\x0D]+``: everything that is not white space.
SPACED = ~((_ALL == 0x20) | ((_ALL >= 0x09) & (_ALL <= 0x0D)))
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` before lower-casing: ASCII letters and digits, and all of non-ASCII.
LETTERED = ((_ALL >= 48) & (_ALL <= 57)) | ((_ALL >= 65) & (_ALL <= 90)) | ((_ALL >= 97) & (_ALL <= 122)) | (_ALL >= 128)

_BYTE = np.random.default_rng(20240601).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_LOWER = _BYTE[LOWER]
_P = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def _powers() -> list[np.ndarray]:
    if not _POWERS:
        for base in (_P, pow(_P, -1, 1 << 64)):
            steps = np.full(PIECE + 1, base, np.uint64)
            steps[0] = 1
            _POWERS.append(np.cumprod(steps, dtype=np.uint64))
    return _POWERS


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


class Texts:
    """Bytes of a slice of a text column and where each row begins."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
        column = column.fill_null("") if column.null_count else column
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        self.data = raw[at[0]:at[-1]]
        self.offsets = at - at[0]

    def __len__(self) -> int:
        return len(self.offsets) - 1


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, Texts]]:
    """The rows of a column in slices of about ``limit`` bytes: first row and its texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    column = column.cast(pa.large_string())
    whole = Texts(column)
    start = 0
    while start < len(column):
        stop = int(np.searchsorted(whole.offsets, whole.offsets[start] + limit, "right")) - 1
        stop = min(max(stop, start + 1), len(column))
        part = Texts.__new__(Texts)
        part.data = whole.data[whole.offsets[start]:whole.offsets[stop]]
        part.offsets = whole.offsets[start:stop + 1] - whole.offsets[start]
        yield start, part
        start = stop


def cut_between(texts: Texts, table: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[Texts]:
    """Texts as they are, or one text of more than twice ``limit`` bytes in pieces that end between words."""
    if len(texts) > 1 or len(texts.data) <= 2 * limit:
        yield texts
        return
    at = 0
    while at < len(texts.data):
        to = min(at + limit, len(texts.data))
        while to < len(texts.data) and table[texts.data[to]]:
            gaps = np.flatnonzero(~table[texts.data[to:to + limit]])
            to += int(gaps[0]) if len(gaps) else min(limit, len(texts.data) - to)
        piece = Texts.__new__(Texts)
        piece.data, piece.offsets = texts.data[at:to], np.array([0, to - at])
        yield piece
        at = to


def spans(texts: Texts, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each row the number of its first word (one more at the end)."""
    inside = table[texts.data]
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    edges = texts.offsets[(texts.offsets > 0) & (texts.offsets < len(inside))]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[edges - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, texts.offsets).astype(np.int64)


def word_hashes(texts: Texts, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word with A-Z lower-cased."""
    out = np.empty(len(starts), np.uint64)
    up, down = _powers()
    at = 0
    while at < len(starts):
        begin = starts[at]
        to = int(np.searchsorted(ends, begin + PIECE, "right"))
        if to <= at:  # one word longer than a piece
            digest = hashlib.blake2b(LOWER[texts.data[begin:ends[at]]].tobytes(), digest_size=8).digest()
            out[at] = int.from_bytes(digest, "little")
            at += 1
            continue
        sums = np.zeros(ends[to - 1] - begin + 1, np.uint64)
        np.cumsum(_BYTE_LOWER[texts.data[begin:ends[to - 1]]] * up[:len(sums) - 1], out=sums[1:])
        left, right = starts[at:to] - begin, ends[at:to] - begin
        out[at:to] = (sums[right] - sums[left]) * down[left]
        at = to
    return mix(out)


def grams(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` hashes, in order; runs may cross rows (see ``gram_rows``)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = words[:n].copy()
    factor = 1
    for j in range(1, size):
        factor = factor * 0xD6E8FEB86659FD93 % (1 << 64)
        total += words[j:j + n] * np.uint64(factor)
    return mix(total)


def sequence_hash(words: np.ndarray) -> int:
    """Hash of a whole sequence of hashes, with its length."""
    return int.from_bytes(hashlib.blake2b(words.tobytes(), digest_size=8).digest(), "little")


def row_of_each(first: np.ndarray) -> np.ndarray:
    """Row number of every word, from the numbers of the rows' first words."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
