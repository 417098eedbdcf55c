"""Words of whole batches of texts as numpy arrays.

A batch becomes (vocabulary, index of each word, start of each document). Each
distinct word is handled once a batch, whatever its frequency.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Odd multiplier of the rolling hash of a word sequence.
BASE = 0x9E3779B97F4A7C15
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
#: A-Z to a-z, all else as it is.
LOWER_AZ = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def as_strings(column) -> pa.Array:
    """One string array; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    return column.fill_null("") if column.null_count else column


#: What operators keep in a worker from task to task.
KEPT: list[dict] = []


def tidy(own: dict | None = None) -> None:
    """Give memory that is free back to the machine: workers live on, and so would their largest hour. What other operators than the caller (own) keep in this worker goes too."""
    for held in KEPT:
        if held is not own:
            held.clear()
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def slices(texts: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about limit bytes of text; a longer text is a range of its own."""
    if not len(texts):
        return
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at, done = 0, 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield at, to
        at, done = to, int(ends[to - 1])


def lowered(texts: pa.Array) -> pa.Array:
    """A-Z lower-cased, on the bytes of the whole batch at once."""
    data, offsets = spans(texts)
    return pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(offsets), pa.py_buffer(data.tobytes().translate(LOWER_AZ))])


def split_words(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Words between spaces and \\t-\\r as a dictionary array, and where each text's words start (one more entry than texts)."""
    if not len(texts):
        return pa.array([], pa.string()).dictionary_encode(), np.zeros(1, dtype=np.int64)
    lists = pc.ascii_split_whitespace(texts)
    starts = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    values = lists.values
    full = pc.greater(pc.binary_length(values), 0)
    if pc.all(full).as_py() is False:
        seen = np.concatenate(([0], np.cumsum(full.to_numpy(zero_copy_only=False))))
        starts, values = seen[starts], values.filter(full)
    return values.dictionary_encode(), starts


def spans(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after the other, and where each starts (one more entry than texts)."""
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return data, offsets - offsets[0]


#: A 64-bit value for each byte, and powers of BASE and of its inverse: a word's hash is the sum of its bytes' values, each times a power by its place.
VALUES = np.random.default_rng(64).integers(0, 1 << 64, 256, dtype=np.uint64)
BLANK = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
HASHED = 1 << 20
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, HASHED)
        _POWERS[:] = [np.multiply.accumulate(np.concatenate((np.ones(1, dtype=np.uint64), np.full(size - 1, b, dtype=np.uint64)))) for b in (BASE, pow(BASE, -1, 1 << 64))]
    return _POWERS[0][:n], _POWERS[1]


def _hashed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """word_hashes() of bytes that are hashed at once."""
    n = len(data)
    inside = np.zeros(n + 2, dtype=bool)
    inside[1:-1] = ~BLANK[data]
    edge = inside[1:] != inside[:-1]
    cut = offsets[1:-1]
    cut = cut[inside[cut + 1] & inside[cut]]  # words of neighbouring texts that touch
    places = np.flatnonzero(edge)
    if len(cut):
        places = np.sort(np.concatenate((places, np.repeat(np.unique(cut), 2))))
    first, last = places[::2], places[1::2]
    up, down = _powers(n)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(VALUES[data] * up, out=sums[1:])
    h = (sums[last] - sums[first]) * down[first]
    return mix(h + (last - first).astype(np.uint64) * np.uint64(BASE)), np.searchsorted(first, offsets)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of the texts, and where each text's words start. Texts are hashed some at a time, long ones in parts: what is held beside the hashes stays small."""
    hashes, starts, done = [np.zeros(0, dtype=np.uint64)], [np.zeros(1, dtype=np.int64)], 0
    for s, e in slices(texts, HASHED):
        data, offsets = spans(texts.slice(s, e - s))
        at = 0
        while e - s == 1 and len(data) - at > HASHED:  # up to a blank
            blank = np.flatnonzero(BLANK[data[at : at + HASHED]])
            if len(blank):
                to = at + int(blank[-1]) + 1
            else:
                later = next((i + int(x[0]) + 1 for i in range(at + HASHED, len(data), HASHED) if len(x := np.flatnonzero(BLANK[data[i : i + HASHED]]))), len(data))
                to = later
            h, own = _hashed(data[at:to], np.array([0, to - at]))
            hashes.append(h)
            done += len(h)
            at = to
        h, own = _hashed(data[at:], np.maximum(offsets - at, 0))
        hashes.append(h)
        starts.append(own[1:] + done)
        done += len(h)
    return np.concatenate(hashes), np.concatenate(starts)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of h (a bijection)."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys in order, the number of each key's one, and how often each occurs; in less memory than np.unique."""
    if not len(keys):
        return keys, np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)
    order = np.argsort(keys)
    keys = keys[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    number = np.empty(len(keys), dtype=np.int32)
    number[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return keys[new], number, np.diff(np.flatnonzero(new), append=len(keys))


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """The hash of k words from each place of h on, built by doubling; the last k-1 places are left out. Windows may cross texts: callers leave those out."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    done, have, out = 0, h, None
    size, power = 1, BASE
    while True:
        if k & size:
            part = have[done : done + n]
            out = part.copy() if out is None else out * np.uint64(power) + part
            done += size
        if size * 2 > k:
            return mix(out)
        have = have[:-size] * np.uint64(power) + have[size:]
        size, power = size * 2, power * power % (1 << 64)


def window_starts(starts: np.ndarray, k: int) -> np.ndarray:
    """A mask over windows(h, k): true where the window lies in one text."""
    total = int(starts[-1])
    n = max(0, total - k + 1)
    ends = np.repeat(starts[1:], np.diff(starts))[:n]
    return np.arange(n) + k <= ends


def docs_of(starts: np.ndarray) -> np.ndarray:
    """The number of the text that each word belongs to."""
    return np.repeat(np.arange(len(starts) - 1), np.diff(starts))
