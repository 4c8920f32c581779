"""Helpers for Arrow text columns inside tasks: byte views, pieces of bounded size, word hashes, list building."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
import types

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 19
_STEP = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def worker_cache(owner: str = "") -> dict:
    """A dict as old as the Python worker. Functions arrive by value with each task, so module globals start anew there.

    Each owner has its own; a worker that goes over to another operator drops what it kept for the one before.
    """
    name = "_chartspark_worker_cache"
    kept = sys.modules.setdefault(name, types.ModuleType(name)).__dict__
    if owner:
        for other in [k for k in kept if k.startswith("of ") and k != f"of {owner}"]:
            del kept[other]
        return kept.setdefault(f"of {owner}", {})
    return kept


def fresh_name(df, wish: str) -> str:
    """A column name that the table does not have, whatever its case."""
    taken, name = {c.lower() for c in df.columns}, f"_{wish}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def give_back() -> None:
    """Return freed memory to the system, so that a worker between tasks holds little."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def text_view(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty. Offsets start at 0."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def pieces(texts: pa.Array, limit: int = PIECE_BYTES):
    """Slices of whole texts holding about limit bytes each; a longer text is a slice of its own."""
    if not len(texts):
        return
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        stop = max(int(np.searchsorted(ends, before + limit, side="right")), start + 1)
        yield texts.slice(start, stop - start)
        start = stop


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective scrambling of unsigned 64-bit numbers."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number for each byte, and powers of an odd base and of its inverse modulo 2**64."""
    cache = worker_cache()
    if "powers" not in cache or len(cache["powers"][1]) < n:
        base = 0xD1342543DE82EF95
        inverse = pow(base, -1, 1 << 64)
        size = max(n, PIECE_BYTES + 1)
        tables = []
        for factor in (base, inverse):
            steps = np.full(size, factor, np.uint64)
            steps[0] = 1
            tables.append(np.multiply.accumulate(steps))
        letters = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_STEP))
        cache["powers"] = (letters, *tables)
    return cache["powers"]


LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of word bytes: (start, end, 64-bit hash of the run with A-Z lower-cased, first word of each text and total).

    A run never crosses from one text into the next.
    """
    n = len(data)
    counts = np.zeros(len(offsets), np.int64)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64), counts
    low = LOWER[data]
    inside = is_word[low]
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    firsts = offsets[:-1][offsets[:-1] < n]
    before[firsts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    lasts = offsets[1:] - 1
    after[lasts[lasts >= 0]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    letters, up, down = _powers(n + 1)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(letters[low] * up[:n], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * down[starts])
    counts[:] = np.searchsorted(starts, offsets)
    return starts, ends, hashes, counts


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of size neighbouring words of the whole array; the caller skips runs that cross texts."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, size, np.uint64)
    for i in range(size):
        h = h * np.uint64(0xA0761D6478BD642F) + hashes[i : i + n]
    return mix(h)


def lists(parts: list[np.ndarray | None], kind: pa.DataType) -> pa.Array:
    """A list column from one numpy array (or None) per row."""
    sizes = np.array([0 if p is None else len(p) for p in parts], np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    full = [p for p in parts if p is not None and len(p)]
    values = np.concatenate(full) if full else np.zeros(0)
    mask = pa.array([p is None for p in parts], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values).cast(kind), mask=mask)
