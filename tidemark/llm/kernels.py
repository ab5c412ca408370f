"""Array kernels over the UTF-8 buffers of Arrow batches: hashing of byte segments, word shingles, class runs.

A batch is taken in chunks of about CHUNK bytes of text, so that temporaries stay small whatever the batch holds;
one text longer than that is a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK = 1 << 19


def splitmix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """n reproducible 64-bit numbers."""
    return splitmix((np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) + splitmix(np.array([seed], U64)))


LANE = 8
_KEYS = stream(13, 64)
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(LANE + 1)], U64)


def _keys(n: int) -> np.ndarray:
    global _KEYS
    if len(_KEYS) < n:
        _KEYS = stream(13, 2 * n)
    return _KEYS


def _pieces(starts: np.ndarray, lens: np.ndarray, budget: int) -> Iterator[tuple[int, int]]:
    """Ranges of segments of about budget bytes together."""
    upto, i = np.cumsum(lens), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(upto, upto[i] - lens[i] + budget, side="right")))
        yield i, j
        i = j


def _lanes(view: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The segments as 64-bit numbers of eight bytes, the last filled with zeros; the place of each in its segment; each segment's first."""
    count = (lens + LANE - 1) // LANE
    first = np.cumsum(count) - count
    within = np.arange(int(count.sum()), dtype=np.int64) - np.repeat(first, count)
    value = view[np.repeat(starts, count) + LANE * within]
    value[first + count - 1] &= _MASKS[lens - LANE * (count - 1)]
    return value, within, first


def _view(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on, as a number."""
    return np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(LANE, np.uint8)]), strides=(1,))


def segment_hash(data: np.ndarray, starts: np.ndarray, lens: np.ndarray, budget: int = 1 << 18) -> np.ndarray:
    """A 64-bit hash of each non-empty segment data[start : start + len]: the sum of its mixed lanes, each under the key of its place.

    Segments of one length up to eight bytes have different hashes if they differ. Longer ones may collide by chance, so
    a hash groups, and bytes decide.
    """
    out, view = np.empty(len(starts), U64), _view(data)
    for i, j in _pieces(starts, lens, budget):
        value, within, first = _lanes(view, starts[i:j], lens[i:j])
        out[i:j] = np.add.reduceat(splitmix(value ^ _keys(int(within.max()) + 1)[within]), first)
    return splitmix(out + lens.astype(U64) * U64(0xD6E8FEB86659FD93))


def distinct(data: np.ndarray, starts: np.ndarray, lens: np.ndarray, hashed: np.ndarray | None = None, budget: int = 1 << 18) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A segment of each distinct byte string, its hash, and the number of its byte string for each segment.

    Segments of one hash are compared byte by byte with the first of them; those that differ are told apart by their bytes.
    """
    hashed = segment_hash(data, starts, lens) if hashed is None else hashed
    keys, first, inverse = np.unique(hashed, return_index=True, return_inverse=True)
    view, model = _view(data), first[inverse]
    other = lens[model] != lens
    for i, j in _pieces(starts, lens, budget):
        value, _, at = _lanes(view, starts[i:j], lens[i:j])
        same, _, _ = _lanes(view, np.where(other[i:j], starts[i:j], starts[model[i:j]]), lens[i:j])
        other[i:j] |= np.logical_or.reduceat(value != same, at)
    if other.any():
        known: dict[bytes, int] = {}
        more = []
        for k in np.flatnonzero(other).tolist():
            word = data[starts[k] : starts[k] + lens[k]].tobytes()
            if word not in known:
                known[word] = len(first) + len(more)
                more.append(k)
            inverse[k] = known[word]
        first, keys = np.concatenate([first, more]), np.concatenate([keys, hashed[more]])
    return first, keys, inverse


WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the maximal runs of true values that don't cross an offset."""
    n = len(inside)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends - starts


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and text numbers of the words, runs of bytes other than \\x20 and \\x09-\\x0d."""
    starts, lens = runs(~WHITE[data], offsets)
    return starts, lens, np.searchsorted(offsets, starts, side="right") - 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct width-word shingles of each text as hashes, ascending within the text, and the size of each set.

    Words compare without the case of A-Z. A text with fewer words has its whole sequence as one; one without words, none.
    """
    n = len(offsets) - 1
    starts, lens, owner = words(data, offsets)
    hashed = segment_hash(LOWER[data], starts, lens)
    factor = stream(21, width) | U64(1)
    count = np.bincount(owner, minlength=n)
    m = len(hashed) - width + 1
    if m > 0:
        value = np.zeros(m, U64)
        for k in range(width):
            value += hashed[k : k + m] * factor[k]
        full = owner[:m] == owner[width - 1 :]
        value, who = value[full], owner[:m][full]
    else:
        value, who = np.empty(0, U64), np.empty(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        at = (np.cumsum(count) - count)[short]
        whole = np.zeros(len(short), U64)
        for k in range(width - 1):
            has = count[short] > k
            whole[has] += hashed[at[has] + k] * factor[k]
        whole += count[short].astype(U64) * U64(0xA24BAED4963EE407)
        value, who = np.concatenate([value, whole]), np.concatenate([who, short])
    value = splitmix(value)
    order = np.lexsort((value, who))
    value, who = value[order], who[order]
    if len(value):
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (who[1:] != who[:-1])
        value, who = value[new], who[new]
    return value, np.bincount(who, minlength=n)


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null texts are empty."""
    column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, what = column.buffers()
    n = len(column)
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(what, np.uint8)[offsets[0] : offsets[-1]] if what is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of parts with about size bytes of text."""
    data, offsets = buffer_of(column)
    i, n = 0, len(column)
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1))
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j
    pa.default_memory_pool().release_unused()  # workers stay for later stages, what they don't use shouldn't


def int64(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64) if values.dtype == U64 else values.astype(np.int64), pa.int64())


def per_text(fold: np.ufunc, values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """fold over the values of each text that has some."""
    first = np.cumsum(counts) - counts
    return fold.reduceat(values, first[counts > 0]) if len(values) else values[:0]
