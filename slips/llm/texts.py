"""Byte-level helpers for Arrow batches of texts, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once (one longer text is taken alone).
SLICE_BYTES = 1 << 20

#: Bytes of a word map to themselves, A-Z to a-z, all else to a blank.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


#: As FOLD, but only blanks and the controls 9 to 13 part words.
FOLD_BLANKS = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))


def fold_words(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a column as one byte array, with the offsets of each; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body, at


def slices(at: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``limit`` bytes."""
    low, n = 0, len(at) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(at, at[low] + limit, "right")) - 1)
        yield low, high
        low = high


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads the bits of 64-bit values."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


_ZSTD = pa.Codec("zstd", 6)


def squeeze(x: np.ndarray) -> bytes:
    """Whole numbers from 0 in few bytes: as many byte planes as the largest needs, compressed."""
    x = np.ascontiguousarray(x, np.int64)
    width = max(1, -(-int(x.max()).bit_length() // 8)) if len(x) else 1
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return width.to_bytes(1, "little") + len(x).to_bytes(7, "little") + _ZSTD.compress(planes, asbytes=True)


def unsqueeze(data: bytes) -> np.ndarray:
    width, n = data[0], int.from_bytes(data[1:8], "little")
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, :width] = np.frombuffer(_ZSTD.decompress(data[8:], n * width), np.uint8).reshape(width, n).T
    return out.view(np.int64).reshape(-1)


_POWERS = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        base = np.full(max(n, 1024), 0x9E3779B97F4A7C15, np.uint64)
        base[0] = 1
        _POWERS = np.multiply.accumulate(base)
    return _POWERS[:n]


def word_hashes(body: np.ndarray, at: np.ndarray, fold: bytes = FOLD) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all folded words of consecutive texts, and the number of words of each text.

    ``at`` holds the texts' offsets in ``body``; words end at the border of a text.
    """
    folded = np.frombuffer(fold, np.uint8)[body[at[0] : at[-1]]]
    at = at - at[0]
    inside = folded != 32
    before = np.empty_like(inside)
    if len(inside):
        before[0] = False
        before[1:] = inside[:-1]
        before[at[:-1][at[:-1] < len(inside)]] = False
    starts = np.flatnonzero(inside & ~before)
    counts = np.diff(np.searchsorted(starts, at))
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    where = np.flatnonzero(inside)
    which = np.searchsorted(starts, where, "right") - 1
    place = where - starts[which]
    value = (folded[where].astype(np.uint64) + np.uint64(1)) * powers(int(place.max()) + 1)[place]
    sums = np.add.reduceat(value, np.searchsorted(where, starts))
    return mix(sums), counts
