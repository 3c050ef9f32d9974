"""Vectorised text kernels: words, shingles and their 64-bit hashes straight from Arrow buffers.

Words are runs of bytes other than space and \\x09-\\x0D, with A-Z lower-cased;
a word's hash is a polynomial over random 64-bit byte values, mixed with its
length; a shingle's hash mixes the hashes of its words with their places.
Distinct words or shingles share a 64-bit hash with probability about 2**-64
per pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .workers import process_cache

U64 = np.uint64
_RNG = np.random.default_rng(20260101)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_PLACE = _RNG.integers(1, 2**63, 64, dtype=np.int64).astype(U64) * U64(2) + U64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, U64)
    out[0] = 1
    have = 1
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * U64(pow(base, have, 2**64))
        have += more
    return out


def utf8_parts(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends) of an Arrow string column; nulls are empty."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    large = pa.types.is_large_string(array.type)
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64 if large else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    starts, ends = at[:-1], at[1:].copy()
    if array.null_count:
        ends = np.where(np.asarray(array.is_null()), starts, ends)
    return raw, starts, ends


def words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes in order, number of words of each text).  Texts are handled in blocks of about ``block`` bytes."""
    hashes, counts = [], np.zeros(len(starts), np.int64)
    i = 0
    while i < len(starts):
        j = i + 1
        while j < len(starts) and ends[j] - starts[i] <= block:
            j += 1
        low, high = int(starts[i]), int(ends[j - 1])
        piece = raw[low:high]
        inner = ~_SPACE[piece]
        flags = np.zeros(len(piece) + 1, bool)
        flags[:-1] = inner
        edge = flags[:-1].copy()
        edge[1:] &= ~inner[:-1]
        cuts = starts[i:j] - low
        cuts = cuts[(cuts < len(piece))]
        edge[cuts] = inner[cuts]  # a text's first byte starts a word even after another text's
        begin = np.flatnonzero(edge)
        stop = np.flatnonzero(inner & np.concatenate([~inner[1:] | edge[1:], [True]])) + 1 if len(piece) else begin
        if len(begin):
            power = base_powers(len(piece))
            total = np.empty(len(piece) + 1, U64)
            total[0] = 0
            np.cumsum(_BYTE[piece] * power, out=total[1:])
            value = (total[stop] - total[begin]) * base_powers(len(piece), inverse=True)[begin]
            hashes.append(mix(value ^ ((stop - begin).astype(U64) * U64(0xA0761D6478BD642F))))
        counts[i:j] = np.searchsorted(begin, ends[i:j] - low) - np.searchsorted(begin, starts[i:j] - low)
        i = j
    return (np.concatenate(hashes) if hashes else np.zeros(0, U64)), counts


def base_powers(n: int, inverse: bool = False, owner: str = "hash powers") -> np.ndarray:
    """Powers of the hash base (or of its inverse), kept by the process.

    An operator that keeps more between tasks names itself as the ``owner``: its other things would go else.
    """
    kept = process_cache(owner, "hash powers")
    if len(kept.get(inverse, ())) < n:
        kept[inverse] = powers(_INVERSE if inverse else _BASE, max(n, 1 << 16))
    return kept[inverse][:n]


def shingle_sets(hashes: np.ndarray, counts: np.ndarray, width: int = 5, weights: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(sorted distinct shingle hashes text by text, set sizes), and with word ``weights`` each shingle's sum of them.

    A text with fewer words than ``width`` has its whole word sequence as its
    one shingle; a text without words has the empty set.
    """
    n = len(hashes)
    ends = np.cumsum(counts)
    starts = ends - counts
    if not n:
        return (np.zeros(0, U64), np.zeros(len(counts), np.int64), *([] if weights is None else [np.zeros(0, np.int64)]))
    rolled = np.zeros(n, U64)
    for k in range(width):
        rolled[: n - k] += hashes[k:] * _PLACE[k]
    text = np.repeat(np.arange(len(counts)), counts)
    whole = np.arange(n) + width <= ends[text]
    short = np.flatnonzero((counts > 0) & (counts < width))
    for t in short:
        a, b = starts[t], ends[t]
        with np.errstate(over="ignore"):
            rolled[a] = (hashes[a:b] * _PLACE[: b - a]).sum(dtype=U64) + U64(b - a)
        whole[a] = True
    keys, owner = mix(rolled[whole]), text[whole]
    order = np.argsort(keys, kind="stable")
    order = order[np.argsort(owner[order], kind="stable")]
    keys, owner = keys[order], owner[order]
    first = np.ones(len(keys), bool)
    first[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    sizes = np.bincount(owner[first], minlength=len(counts)).astype(np.int64)
    if weights is None:
        return keys[first], sizes
    total = np.concatenate([[0], np.cumsum(weights)])
    at = np.flatnonzero(whole)
    sums = total[np.minimum(at + width, ends[text[at]])] - total[at]
    return keys[first], sizes, sums[order][first]
