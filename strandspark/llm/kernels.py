"""NumPy kernels over batches of texts: bytes, words, hashes, shingles.

Everything works on one flat byte buffer for a whole batch, so the cost is a
handful of vectorised passes and not a Python loop over words or bytes.  All
hashes are fixed functions of the bytes: the same on every worker and in every
run, which is what lets a lost executor's tasks be run again.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
#: The bytes that part words, as in ``[^\\x20\\x09-\\x0D]+``.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: Odd base of the polynomial hashes (mod 2**64).
BASE = U64(0x9E3779B97F4A7C15 | 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (xor-shift-multiply)."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(29))
    x = x * U64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> U64(32))


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0xA0761D6478BD642F))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[list(SPACES)] = True


def _inverse(a: int) -> int:
    return pow(a, -1, 1 << 64)


_POW = np.ones(1, dtype=U64)
_INV = np.ones(1, dtype=U64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``BASE**i`` and ``BASE**-i`` mod 2**64 for i < n, kept for the next call."""
    global _POW, _INV
    if len(_POW) < n:
        m = 1 << (n - 1).bit_length()
        with np.errstate(over="ignore"):
            _POW = np.concatenate([np.ones(1, U64), np.cumprod(np.full(m - 1, BASE, U64), dtype=U64)])
            _INV = np.concatenate([np.ones(1, U64), np.cumprod(np.full(m - 1, U64(_inverse(int(BASE))), U64), dtype=U64)])
    return _POW, _INV


def flat(texts) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts (str, bytes or None) in one buffer, and each text's bounds."""
    raw = [b"" if t is None else t if isinstance(t, bytes) else t.encode("utf-8", "surrogatepass") for t in texts]
    ends = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum([len(x) for x in raw], out=ends[1:]) if raw else None
    return np.frombuffer(b"".join(raw), dtype=np.uint8), ends


def arrow_flat(column) -> tuple[np.ndarray, np.ndarray]:
    """The same from an Arrow string or binary array, without a copy of each text; nulls are empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks)
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = column.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, ends - ends[0]


def prefix_hashes(buf: np.ndarray) -> np.ndarray:
    """``H[i]``: the polynomial hash of the first i bytes; ``len(buf) + 1`` values."""
    pw, _ = powers(len(buf) + 1)
    out = np.zeros(len(buf) + 1, dtype=U64)
    np.cumsum(_BYTE[buf] * pw[: len(buf)], dtype=U64, out=out[1:])
    return out


def substring_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of ``buf[start:end]`` that do not depend on where the bytes stand."""
    _, inv = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * inv[start] + (end - start).astype(U64))


def words(buf: np.ndarray, ends: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, word ends, 64-bit word hashes, and ``bounds``: text t's words are ``bounds[t]:bounds[t+1]``.

    Words are the runs of bytes other than white space; a word never crosses texts.
    """
    n = len(buf)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, U64), np.zeros(len(ends), np.int64)
    inside = ~_SPACE[buf]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    cuts = ends[1:-1]
    cuts = cuts[cuts < n]
    begin[cuts] = inside[cuts]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | begin[1:]
    start = np.flatnonzero(begin)
    end = np.flatnonzero(stop) + 1
    pw, inv = powers(n + 1)
    prefix = np.zeros(n + 1, dtype=U64)
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[buf] * pw[:n], dtype=U64, out=prefix[1:])
    return start, end, mix((prefix[end] - prefix[start]) * inv[start] + (end - start).astype(U64)), np.searchsorted(start, ends)


def shingles(hashes: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct k-word shingles, sorted, and their bounds.

    A text of 1 to k-1 words has one shingle, of all its words; one without words has none.
    """
    n_words = np.diff(bounds)
    if len(hashes) == 0:
        return np.zeros(0, U64), np.zeros(len(bounds), np.int64)
    doc = np.repeat(np.arange(len(n_words)), n_words)
    acc = np.zeros(len(hashes), dtype=U64)
    left = np.repeat(bounds[1:], n_words) - np.arange(len(hashes))
    whole = np.minimum(left, k)
    for j in range(k):
        part = np.zeros_like(acc)
        m = len(hashes) - j
        part[:m] = hashes[j:] * U64((int(BASE) ** (j + 1)) % (1 << 64))
        acc += np.where(whole > j, part, U64(0))
    full = (left >= k) | ((np.arange(len(hashes)) == np.repeat(bounds[:-1], n_words)) & (np.repeat(n_words, n_words) < k))
    h, d = mix(acc[full] + whole[full].astype(U64)), doc[full]
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    h, d = h[new], d[new]
    return h, np.searchsorted(d, np.arange(len(n_words) + 1))
