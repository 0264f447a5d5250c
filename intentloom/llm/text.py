"""Vectorised words, hashes and windows over Arrow string columns.

A *word* is a maximal run of characters other than the ASCII ones that are neither letters nor
digits, in lower case (ASCII and Latin-1 letters). ``WORDS_SQL`` is the same in DuckDB SQL. Hashes are
64-bit polynomials over bytes (words) or words (n-grams), so they can be taken over whole arrays
at once instead of word by word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + "".join(chr(c) for c in range(0xC0, 0xDF) if c != 0xD7)
_LOWER = "".join(chr(ord(c) + 32) for c in _UPPER)
WORDS_SQL = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"

_P = U64(0x9E3779B97F4A7C15)
_Q = 0xD6E8FEB86659FD93
_MASK = (1 << 64) - 1
#: value of each byte in a hash; 0: separates words
_VALUE = np.zeros(256, np.uint8)
for _b in range(256):
    _c = chr(_b)
    _VALUE[_b] = ord(_c.lower()) if _b < 128 and _c.isalnum() else _b if _b >= 128 else 0
_POW_BITS = 12
PIECE_BYTES = 1 << 20


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_POW = _powers(_P, 1 << _POW_BITS)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads all bits."""
    h = h ^ (h >> U64(32))
    h = h * U64(0xE9846AF9B1A615D)
    h ^= h >> U64(32)
    h *= U64(0xE9846AF9B1A615D)
    h ^= h >> U64(28)
    return h


def string_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and row offsets (len + 1); null counts as the empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if not pa.types.is_binary(col.type) and not pa.types.is_large_binary(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = col.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _word_hashes(raw: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words in ``raw``; no word crosses one of ``cuts``."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64)
    value = _VALUE[raw]
    after_c3 = np.flatnonzero((raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)) + 1
    value[after_c3] += 32
    inside = value != 0
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    at = cuts[(cuts > 0) & (cuts < len(raw))]
    begin[at] = inside[at]
    starts = np.flatnonzero(begin)
    if not len(starts):
        return starts, starts, np.zeros(0, U64)
    final = inside.copy()
    final[:-1] &= ~inside[1:] | begin[1:]
    ends = np.flatnonzero(final) + 1
    begin_of = np.repeat(starts, np.diff(np.append(starts, len(raw))))
    position = np.arange(starts[0], len(raw), dtype=np.int64) - begin_of
    power = _POW[position & ((1 << _POW_BITS) - 1)]
    if (ends - starts).max() > 1 << _POW_BITS:
        power = power * (_powers(U64(0xA0761D6478BD642F), int(position.max() >> _POW_BITS) + 1)[position >> _POW_BITS])
    power *= value[starts[0] :].astype(U64)
    return starts, ends, mix(np.add.reduceat(power, starts - starts[0]))


@dataclass
class Words:
    """Words of a batch of texts, flat; text i has those from ``ptr[i]`` to ``ptr[i + 1]``."""

    raw: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    ptr: np.ndarray

    @property
    def n_texts(self) -> int:
        return len(self.ptr) - 1

    def limit(self) -> np.ndarray:
        """For each word, where its text's words end."""
        return np.repeat(self.ptr[1:], np.diff(self.ptr))

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_texts), np.diff(self.ptr))


def words(col: pa.Array) -> Words:
    """Words of whole texts of any length; worked off in pieces of bounded size, cut between words."""
    raw, offsets = string_bytes(col)
    parts, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + PIECE_BYTES)
        if end < len(raw):
            stop = np.flatnonzero(_VALUE[raw[at:end]] == 0)
            cut = offsets[np.searchsorted(offsets, end, "right") - 1]
            end = int(max(at + stop[-1] + 1 if len(stop) else 0, cut))
            while end <= at:  # one word longer than a piece
                at_end = np.flatnonzero(_VALUE[raw[at + PIECE_BYTES : at + 64 * PIECE_BYTES]] == 0)
                following = offsets[np.searchsorted(offsets, at, "right")]
                end = int(min(at + PIECE_BYTES + at_end[0] + 1 if len(at_end) else len(raw), following))
        s, e, h = _word_hashes(raw[at:end], offsets[(offsets > at) & (offsets < end)] - at)
        parts.append((s + at, e + at, h))
        at = end
    starts, ends, hashes = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, U64 if i == 2 else np.int64) for i in range(3))
    return Words(raw, offsets, starts, ends, hashes, np.searchsorted(starts, offsets))


def ngrams(h: np.ndarray, n: int, q: int = _Q) -> np.ndarray:
    """Hash of the ``n`` words from each position; by doubling, so in O(log n) passes. Shorter by n - 1 than ``h``."""
    if len(h) < n:
        return np.zeros(0, U64)
    out, have, power = None, 0, 1
    block, size, step = h, 1, q
    while True:
        if n & size:
            out = block if out is None else out[: len(h) - n + 1] + block[have : have + len(h) - n + 1] * U64(power)
            have += size
            power = power * step & _MASK
        if have == n:
            return mix(out[: len(h) - n + 1])
        block = block[: len(block) - size] + block[size:] * U64(step)
        size, step = size * 2, step * step & _MASK


def sliding_min(key: np.ndarray, w: int) -> np.ndarray:
    """Least of the ``w`` values from each position; shorter by w - 1 than ``key``."""
    if len(key) < w:
        return key[:0]
    block, size = key, 1
    while size * 2 <= w:
        block = np.minimum(block[: len(block) - size], block[size:])
        size *= 2
    return np.minimum(block[: len(key) - w + 1], block[w - size : w - size + len(key) - w + 1])


def batches(rows: Iterator[pa.RecordBatch], text: str = "text", size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``size`` bytes of text, at least one row each."""
    for batch in rows:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(text)
        _, offsets = string_bytes(batch.column(at))
        begin = 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + size, "right")) - 1)
            yield batch.slice(begin, end - begin)
            begin = end
