"""Words and hashes of whole batches of texts at once, over their UTF-8 bytes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that end a word: white space in ASCII.
SPACES = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: Bytes of letters, digits and all characters beyond ASCII, with A-Z.
ALNUM = np.isin(np.arange(256), [*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
#: Bytes of a word from which on it is hashed by itself.
LONG = 64
#: Words that are looked at together.
_BLOCK = 1 << 16


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another, and where each begins and the last ends. NULL is empty."""
    column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(batches: Iterator[pa.RecordBatch], text: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in batches of about ``limit`` bytes of text; a longer text stands alone."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = text_bytes(batch.column(batch.schema.get_field_index(text)))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit - size, "right")) - 1)
            part = int(at[hi] - at[lo])
            if held and size + part > limit:
                yield _joined(held)
                held, size = [], 0
                continue
            held.append(batch.slice(lo, hi - lo))
            size += part
            lo = hi
    if held:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def word_bounds(data: np.ndarray, at: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``inside`` bytes in each text, and each text's first word (and the end)."""
    mask = inside[data]
    before = np.empty_like(mask)
    before[:1] = False
    before[1:] = mask[:-1]
    before[at[:-1][at[:-1] < len(data)]] = False
    starts = np.flatnonzero(mask & ~before)
    after = np.empty_like(mask)
    after[-1:] = False
    after[:-1] = mask[1:]
    after[at[1:][at[1:] > 0] - 1] = False
    ends = np.flatnonzero(mask & ~after) + 1
    return starts, ends, np.searchsorted(starts, at)


def mix(h: np.ndarray) -> np.ndarray:
    """Finish 64-bit hashes, so that all their bits depend on all of the input."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(32))


def lowered(data: np.ndarray) -> np.ndarray:
    """``data`` with A-Z lower-cased and 8 zero bytes after it, so that 8 bytes can be read at every place."""
    out = np.zeros(len(data) + 8, dtype=np.uint8)
    np.take(_LOWER, data, out=out[: len(data)])
    return out


def _eights(low: np.ndarray) -> np.ndarray:
    """The 8 bytes at every place of ``low`` as one number."""
    return np.ndarray((len(low) - 7,), dtype="<u8", buffer=low, strides=(1,))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A keyed 64-bit hash of each word with A-Z lower-cased.

    Words are folded 8 bytes at a time, all of them in step, by one-to-one mixing: words below 8 bytes never collide with each other.
    Words beyond ``LONG`` bytes are hashed by keyed BLAKE2b.
    """
    low = lowered(data)
    keys = np.random.default_rng([seed, 64]).integers(0, 1 << 64, 3, dtype=np.uint64)
    out = np.empty(len(starts), dtype=np.uint64)
    for lo in range(0, len(starts), _BLOCK):
        out[lo : lo + _BLOCK] = _folded(low, starts[lo : lo + _BLOCK], ends[lo : lo + _BLOCK], keys)
    return out


def _folded(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray) -> np.ndarray:
    eights = _eights(low)
    n = (ends - starts).astype(np.int64)
    size = n.astype(np.uint64)
    start = np.where(n < 8, keys[0] ^ (size << np.uint64(56)), keys[1] + size * _ODD)
    out = mix(start ^ (eights[starts] & _MASK[np.minimum(n, 8)]))
    live = np.flatnonzero((n > 8) & (n <= LONG))
    at = 8
    while len(live):
        more = eights[starts[live] + at] & _MASK[np.minimum(n[live] - at, 8)]
        out[live] = mix(out[live] * _ODD ^ more ^ keys[2])
        at += 8
        live = live[n[live] > at]
    key = keys.tobytes()
    for i in np.flatnonzero(n > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(low[starts[i] : ends[i]].tobytes(), digest_size=8, key=key).digest(), "little")
    return out


def same_words(
    data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray, other_starts: np.ndarray, other_ends: np.ndarray
) -> np.ndarray:
    """Which words of ``data`` are, byte for byte with A-Z lower-cased, those of ``other`` in the same order."""
    a, b = lowered(data), lowered(other)
    out = np.empty(len(starts), dtype=bool)
    for lo in range(0, len(starts), _BLOCK):
        part = slice(lo, lo + _BLOCK)
        out[part] = _same(a, starts[part], ends[part], b, other_starts[part], other_ends[part])
    return out


def _same(a: np.ndarray, starts: np.ndarray, ends: np.ndarray, b: np.ndarray, other_starts: np.ndarray, other_ends: np.ndarray) -> np.ndarray:
    a8, b8 = _eights(a), _eights(b)
    n = ends - starts
    same = n == other_ends - other_starts
    live = np.flatnonzero(same)
    at = 0
    while len(live):
        left = np.minimum(n[live] - at, 8)
        ok = ((a8[starts[live] + at] ^ b8[other_starts[live] + at]) & _MASK[left]) == 0
        same[live[~ok]] = False
        at += 8
        live = live[ok & (n[live] > at)]
        if at >= LONG:
            for i in live.tolist():
                same[i] = np.array_equal(a[starts[i] : ends[i]], b[other_starts[i] : other_ends[i]])
            break
    return same
