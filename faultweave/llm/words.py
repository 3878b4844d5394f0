"""Vectorised words, hashes and compact payloads for Arrow batches (numpy, no loop over words).

A word is a run of bytes other than space and \\t-\\r; A-Z count as a-z. Words of one text never join
with the next text's. All hashes are 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once (a longer text is handled alone).
SLICE = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15)
_SPACES = np.zeros(256, bool)
_SPACES[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _powers or len(_powers["p"]) < n:
        size = max(n, SLICE + 1)
        inverse = np.uint64(pow(int(_P), -1, 1 << 64))
        for name, base in (("p", _P), ("q", inverse)):
            out = np.empty(size, np.uint64)
            out[0] = 1
            out[1:] = base
            _powers[name] = np.multiply.accumulate(out)
    return _powers["p"], _powers["q"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offs, data = column.buffers()
    o = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None and len(o) else np.zeros(0, np.uint8)
    return raw, o - o[0]


def _words(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start byte, end byte, hash) of all words of texts that lie end to end."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    inner = ~_SPACES[raw]
    edge = np.ones(len(raw) + 1, bool)  # edge[i]: no word goes on from byte i - 1 to byte i
    edge[1:-1] = ~inner[:-1]
    edge[offs] = True
    starts = np.flatnonzero(inner & edge[:-1])
    after = np.ones(len(raw) + 1, bool)
    after[:-1] = ~inner
    after[offs] = True
    ends = np.flatnonzero(inner & after[1:]) + 1
    p, q = _power(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((_LOWER[raw].astype(np.uint64) + np.uint64(1)) * p[: len(raw)], out=sums[1:])
    return starts, ends, mix((sums[ends] - sums[starts]) * q[starts] + (ends - starts).astype(np.uint64))


def tokens(column: pa.Array, places: bool = False):
    """Word hashes of all texts and how many each text has; with places also start and end bytes within each text."""
    raw, offs = text_buffers(column)
    n = len(offs) - 1
    hashes, begins, ends, counts = [], [], [], np.zeros(n, np.int64)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + SLICE, "right")) - 1)
        s, e, h = _words(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        counts[i:j] = np.diff(np.searchsorted(s, offs[i : j + 1] - offs[i]))
        hashes.append(h)
        if places:
            at = np.repeat(offs[i:j] - offs[i], counts[i:j])
            begins.append(s - at)
            ends.append(e - at)
        i = j
    cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    if places:
        return cat(hashes, np.uint64), counts, cat(begins, np.int64), cat(ends, np.int64)
    return cat(hashes, np.uint64), counts


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each place on (the last n - 1 places wrap into nothing useful: mask them)."""
    out = h.copy()
    for k in range(1, n):
        out[: len(h) - k] = out[: len(h) - k] * np.uint64(0x9FB21C651E98DF25) + h[k:]
    return mix(out + np.uint64(n))


def left_in_text(counts: np.ndarray) -> np.ndarray:
    """For each word, how many words its text has from it on."""
    ends = np.repeat(np.cumsum(counts), counts)
    return ends - np.arange(len(ends))


_zstd = pa.Codec("zstd", compression_level=1)


def pack(values: np.ndarray) -> bytes:
    """Bytes of an integer array: byte planes under zstd, which stores the idle high bytes in nothing."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()
    return len(values).to_bytes(8, "little") + _zstd.compress(planes, asbytes=True) if len(values) else b""


def unpack(data: bytes, dtype) -> np.ndarray:
    if not data:
        return np.zeros(0, dtype)
    n, size = int.from_bytes(data[:8], "little"), np.dtype(dtype).itemsize
    planes = np.frombuffer(_zstd.decompress(data[8:], n * size), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(dtype).ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending unsigned integers as packed differences."""
    out = values.copy()
    out[1:] -= values[:-1]
    return pack(out)


def unpack_sorted(data: bytes, dtype) -> np.ndarray:
    return np.cumsum(unpack(data, dtype), dtype=dtype)
