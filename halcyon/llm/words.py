"""Vectorised word and shingle fingerprints over Arrow text batches (numpy, inside tasks).

Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased; fingerprints
are 64 bits of the word's bytes.  Texts are worked through in pieces of about
``PIECE`` bytes cut between words, so memory follows the piece and the number
of words of one document, never the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: bytes hashed at once
PIECE = 1 << 20
SHINGLE = 5

_U = np.uint64
_SEP = np.zeros(256, dtype=bool)
_SEP[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.random.default_rng(20240601).integers(1, 2 ** 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_LETTER[65:91] = _LETTER[97:123]
_POW = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (multiply and xor-shift)."""
    x = (x ^ (x >> _U(31))) * _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(29))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW.get("p", ())) < n:
        p, inv = 0x2545F4914F6CDD1D, pow(0x2545F4914F6CDD1D, -1, 2 ** 64)
        for name, base in (("p", p), ("i", inv)):
            a = np.full(n, base, dtype=np.uint64)
            a[0] = 1
            _POW[name] = np.multiply.accumulate(a)
    return _POW["p"], _POW["i"]


def _spans(buf: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in ``buf``; ``apart`` marks the bytes between words."""
    inside = np.zeros(len(buf) + 2, dtype=np.int8)
    inside[1:-1] = ~apart[buf]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(buf: np.ndarray, spans: bool = False, apart: np.ndarray = _SEP, prefixes: tuple = ()):
    """One fingerprint per word of the UTF-8 bytes ``buf``; with ``spans`` also their starts and ends,
    with ``prefixes`` a column for each word's first so many bytes before that of the word."""
    starts, ends = _spans(buf, apart)
    out = np.empty((len(starts), len(prefixes) + 1), dtype=np.uint64)
    a = 0
    while a < len(starts):
        # whole words of about PIECE bytes; a longer word is a piece of its own
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + PIECE, side="right")))
        lo, hi = starts[a], ends[b - 1]
        power, inverse = _powers(max(PIECE, int(hi - lo) + 1))
        total = np.zeros(hi - lo + 1, dtype=np.uint64)
        np.cumsum(_LETTER[buf[lo:hi]] * power[:hi - lo], out=total[1:])
        s, e = starts[a:b] - lo, ends[a:b] - lo
        for k, most in enumerate((*prefixes, None)):
            end = e if most is None else np.minimum(e, s + most)
            out[a:b, k] = mix((total[end] - total[s]) * inverse[s] + (end - s).astype(np.uint64))
        a = b
    out = out if prefixes else out[:, 0]
    return (out, starts, ends) if spans else out


def documents(column: pa.Array) -> Iterator[np.ndarray]:
    """The UTF-8 bytes of each text (null: none), without copying."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    for i in range(len(column)):
        yield data[offsets[i]:offsets[i + 1]] if valid[i] else data[:0]


def groups(column: pa.Array, size: int = PIECE) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Consecutive documents of about ``size`` bytes together: (index of the first, their bytes)."""
    first, held, total = 0, [], 0
    for i, d in enumerate(documents(column)):
        if held and total + len(d) > size:
            yield first, held
            first, held, total = i, [], 0
        held.append(d)
        total += len(d)
    if held:
        yield first, held


def hashed(docs: list[np.ndarray], **options) -> tuple[np.ndarray, np.ndarray]:
    """Word fingerprints of all ``docs`` in one array, and where each document's words start."""
    space = np.array([32], dtype=np.uint8)
    h, starts, _ = word_hashes(np.concatenate([x for d in docs for x in (d, space)]), spans=True, **options)
    begin = np.concatenate([[0], np.cumsum([len(d) + 1 for d in docs])])
    return h, np.searchsorted(starts, begin)


_ROLES = mix(np.arange(1, SHINGLE + 1, dtype=np.uint64)) | _U(1)


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    """Fingerprints of the 5-word shingles starting at each word (empty for fewer words)."""
    n = max(0, len(words) - SHINGLE + 1)
    total = np.zeros(n, dtype=np.uint64)
    for k in range(SHINGLE):
        total += words[k:k + n] * _ROLES[k]
    return mix(total)


def shingle_set(words: np.ndarray) -> np.ndarray:
    """Sorted distinct shingles of one document; fewer than five words are one shingle, none is none."""
    if len(words) == 0:
        return words
    if len(words) < SHINGLE:
        whole = (words * _ROLES[:len(words)]).sum(dtype=np.uint64) + _U(len(words))
        return mix(mix(np.array([whole], dtype=np.uint64)))
    return np.unique(shingle_hashes(words))
