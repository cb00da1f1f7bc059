"""Vectorised word and shingle hashing over whole Arrow string columns.

The functions here run inside tasks on one Arrow batch at a time. They look at the
UTF-8 bytes of the column as one array, so the cost is a fixed number of passes over
the bytes and there is no Python work per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.empty(max(n, 1), np.uint64)
    out[0] = 1
    done, step = 1, base & _MASK
    while done < n:
        take = min(done, n - done)
        out[done : done + take] = out[:take] * np.uint64(step)
        done += take
        step = step * step & _MASK if done <= n else step
    return out


_POW = _powers(_BASE, 1 << 16)
_INV = _powers(_BASE_INV, 1 << 16)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the row offsets into them; null rows are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string()).fill_null("")
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    data = data[off[0] : off[-1]]
    return data, off - off[0]


def slices(col: pa.Array, rows: int, most: int = 1 << 19):
    """(start, rows) of slices of up to `rows` rows whose texts have at most `most` bytes, or one row.

    What is made of a slice takes many times its bytes, so the rows alone do not bound a task's memory.
    """
    size = np.asarray(pc.fill_null(pc.binary_length(col), 0), np.int64)
    lo, held = 0, 0
    for k, s in enumerate(size):
        if k > lo and (held + s > most or k - lo >= rows):
            yield lo, k - lo
            lo, held = k, 0
        held += s
    if lo < len(size):
        yield lo, len(size) - lo


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span [start, end); equal bytes give equal hashes.

    Polynomial prefix sums give every span in constant time. Blocks keep the exponents
    inside the power table, and spans that cross a block edge are hashed on their own.
    """
    out = np.zeros(len(start), np.uint64)
    if not len(start):
        return out
    block = len(_POW) - 1
    for lo in range(0, len(data), block):
        hi = min(lo + block, len(data))
        a, b = np.searchsorted(start, [lo, hi])
        if a == b:
            continue
        s, e = start[a:b], end[a:b]
        top = max(hi, 0)
        acc = np.zeros(top - lo + 1, np.uint64)
        np.cumsum((data[lo:top].astype(np.uint64) + np.uint64(1)) * _POW[: top - lo], out=acc[1:])
        inside = e <= top
        si, ei = s[inside] - lo, e[inside] - lo
        got = np.zeros(b - a, np.uint64)
        got[inside] = (acc[ei] - acc[si]) * _INV[si]
        for k in np.flatnonzero(~inside):
            got[k] = _one_span(data[s[k] : e[k]])
        out[a:b] = got
    return mix64(out + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _one_span(span: np.ndarray) -> np.uint64:
    total, shift = 0, 1
    size = len(_POW)
    for lo in range(0, len(span), size):
        part = span[lo : lo + size].astype(np.uint64) + np.uint64(1)
        total = (total + shift * int((part * _POW[: len(part)]).sum(dtype=np.uint64))) & _MASK
        shift = shift * pow(_BASE, len(part), 1 << 64) & _MASK
    return np.uint64(total)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


#: Everything in ASCII that is neither a letter nor a digit.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def words(data: np.ndarray, off: np.ndarray, lower: bool = True, space: np.ndarray = _SPACE):
    """Word spans: bytes lower-cased on A-Z, start, end, and each row's first word index."""
    if lower:
        data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data).astype(np.uint8)
    inside = ~space[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = off[1:-1][off[1:-1] < len(data)]
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    before = off[1:-1][off[1:-1] > 0] - 1
    last[before] = inside[before]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return data, start, end, np.searchsorted(start, off)


def shingle_sets(col: pa.Array, width: int = 5):
    """The distinct word shingles of each row: hashes sorted within the row, and row offsets.

    A row with fewer words than `width` has its whole word sequence as one shingle; a row
    without words has none.
    """
    data, off = column_bytes(col)
    rows = len(off) - 1
    data, start, end, first = words(data, off)
    h = span_hashes(data, start, end)
    count = np.diff(first)
    n_sh = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    total = int(n_sh.sum())
    row = np.repeat(np.arange(rows), n_sh)
    sh_off = np.concatenate([[0], np.cumsum(n_sh)])
    at = np.arange(total) - sh_off[row] + first[row]
    acc = np.zeros(total, np.uint64)
    left = count[row]
    for k in range(width):
        have = left > k
        acc = np.where(have, acc * np.uint64(0x9FB21C651E98DF25) + h[np.minimum(at + k, max(len(h) - 1, 0))] if len(h) else acc, acc)
    acc = mix64(acc + np.minimum(left, width).astype(np.uint64))
    order = np.lexsort((acc, row))
    acc, row = acc[order], row[order]
    keep = np.ones(total, bool)
    if total:
        keep[1:] = (acc[1:] != acc[:-1]) | (row[1:] != row[:-1])
    acc, row = acc[keep], row[keep]
    return acc, np.searchsorted(row, np.arange(rows + 1))
