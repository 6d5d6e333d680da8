"""Words, shingles and their 64-bit hashes over whole Arrow text columns, in numpy.

A hash of a word is a polynomial in its bytes, then mixed; a shingle mixes the hashes of its words.
All arithmetic is modulo 2**64. Work goes piece by piece (PIECE bytes of text, or one longer text),
so memory follows the longest text and not the batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
ODD = np.uint64(0xD6E8FEB86659FD93)
U = np.uint64

_codes = np.arange(256, dtype=np.uint8)
LOWER = np.where((_codes >= 65) & (_codes <= 90), _codes + 32, _codes).astype(np.uint8)
NOT_SPACE = ~((_codes == 32) | ((_codes >= 9) & (_codes <= 13)))
ALNUM_OR_HIGH = ((_codes >= 48) & (_codes <= 57)) | ((_codes >= 65) & (_codes <= 90)) | ((_codes >= 97) & (_codes <= 122)) | (_codes >= 128)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which each input bit moves about half of the output bits."""
    x = np.asarray(x, U)
    x = x ^ (moved := x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= np.right_shift(x, U(27), out=moved) if x.ndim else x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= np.right_shift(x, U(31), out=moved) if x.ndim else x >> U(31)
    return x


_powers = np.ones(1, U)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        grown = np.full(max(n, 64, 2 * len(_powers)), BASE, U)
        grown[0] = 1
        _powers = np.multiply.accumulate(grown)
    return _powers


def text_pieces(column: pa.Array, piece: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows in them) of a string column; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type != pa.large_string():
        column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset: column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if column.null_count:  # a null may keep bytes of its own; such columns are packed anew
        yield from text_pieces(column.fill_null(""), piece)
        return
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + piece, side="right")) - 1)
        yield lo, hi, data[offsets[lo]: offsets[hi]], offsets[lo: hi + 1] - offsets[lo]
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, end byte) of every word, A-Z read as a-z, and the words' offsets by row."""
    n, rows = len(data), len(offsets) - 1
    if not n:
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(rows + 1, np.int64)
    inside = word_bytes[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.empty(n, bool)
    before[0], before[1:] = True, ~inside[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, ~inside[1:]
    starts = np.flatnonzero(inside & (before | cut[:-1]))
    ends = np.flatnonzero(inside & (after | cut[1:])) + 1
    per_row = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, U), starts, ends, per_row
    lens = ends - starts
    own = LOWER[data[inside]].astype(U) + U(1)
    first = np.cumsum(lens) - lens
    place = np.arange(len(own)) - np.repeat(first, lens)
    own *= powers(int(lens.max()))[place]
    return mix(np.add.reduceat(own, first) + lens.astype(U) * ODD), starts, ends, per_row


def shingles(word_hash: np.ndarray, per_row: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's set of width-word shingles as sorted distinct hashes, and the sets' offsets. A row
    with fewer words, but not none, has its whole sequence as the one shingle."""
    counts = np.diff(per_row)
    keep = np.maximum(counts - width + 1, 0)
    total = np.zeros(max(len(word_hash) - width + 1, 0), U)
    for k, factor in enumerate(mix(np.arange(1, width + 1))):
        total += word_hash[k: k + len(total)] * factor
    at = np.concatenate([[0], np.cumsum(np.where(keep > 0, keep, counts > 0))])
    out = np.empty(at[-1], U)
    for r in np.flatnonzero(counts):
        if keep[r]:
            part = out[at[r]: at[r + 1]]
            part[:] = mix(total[per_row[r]: per_row[r] + keep[r]])
            part.sort()
        else:
            own = word_hash[per_row[r]: per_row[r + 1]]
            short = own * mix(np.arange(1, len(own) + 1))
            short[:1] += U(int(ODD) * len(own) % 2**64)
            out[at[r]] = mix(np.add.reduce(short, keepdims=True))[0]
    return distinct(out, at)


def distinct(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Drops repeats of values that are sorted within each row."""
    if not len(values):
        return values, at
    new = np.empty(len(values), bool)
    new[0], new[1:] = True, values[1:] != values[:-1]
    new[at[:-1][np.diff(at) > 0]] = True
    return values[new], np.concatenate([[0], np.cumsum(new)])[at]


def row_sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums by row modulo 2**64; an empty row gives 0."""
    out = np.zeros(len(at) - 1, U)
    full = np.diff(at) > 0
    if full.any():
        out[full] = np.add.reduceat(values, at[:-1][full])
    return out


def digests(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit digests of each row's set."""
    n = np.diff(at).astype(U) * ODD
    return mix(row_sums(mix(values ^ U(0x5851F42D4C957F2D)), at) + n), mix(row_sums(mix(values + U(0x14057B7EF767814F)), at) ^ n)
