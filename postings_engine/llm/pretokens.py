"""Byte-level tokenization of whole text columns: every distinct piece goes through the tokenizers
library once per worker, and numpy maps the texts' pieces to the known ids.

Pieces are those of the library's byte-level rule: an optional space with letters, numbers or other
signs; a contraction; white space. They are found for texts of characters below U+0250, whose classes
are fixed; texts with any other character, with white space that is not plain ASCII, or with a special
token, and texts for a tokenizer of another rule, are encoded whole."""

from __future__ import annotations

import json
import re

import numpy as np

from .hashing import ODD, U, mix

LETTER, NUMBER, SIGN, SPACE = 1, 2, 3, 4
NUMBERS = "²³¹¼½¾"
_ascii = np.full(256, SIGN, np.uint8)
_ascii[[*range(65, 91), *range(97, 123)]] = LETTER
_ascii[48:58] = NUMBER
_ascii[[*range(9, 14), 32]] = SPACE
_latin = np.array([LETTER if chr(c).isalpha() else NUMBER if chr(c) in NUMBERS else SIGN for c in range(0x250)], np.uint8)
#: First bytes of what makes a text go through the library as a whole, with C2 and C9 only before some.
_odd = np.zeros(256, bool)
_odd[[*range(0x1C, 0x20), 0xC2, 0xC9, *range(0xCA, 0x100)]] = True
#: Longer pieces are not remembered; more pieces than these, which fill 0.7 of a table of 2^20 slots, are
#: forgotten together.
LONGEST, MOST_PIECES = 64, 700_000
EMPTY = U(0)


def odd_places(data: np.ndarray) -> np.ndarray:
    at = np.flatnonzero(_odd[data])
    lead, after = data[at], data[np.minimum(at + 1, len(data) - 1)]
    return at[~((lead == 0xC2) & (after != 0x85) & (after != 0xA0)) & ~((lead == 0xC9) & (after < 0x90))]


def boundaries(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """First bytes of the pieces of rows of plain texts."""
    n = len(data)
    kind = _ascii[data]
    lead = np.flatnonzero(data >= 0xC0)
    kind[lead] = _latin[((data[lead] & 0x1F).astype(np.int64) << 6) | (data[lead + 1] & 0x3F)]
    kind[lead + 1] = kind[lead]
    row_edge = np.zeros(n + 1, bool)
    row_edge[offsets] = True
    new = row_edge[:-1].copy()
    new[1:] |= kind[1:] != kind[:-1]
    # of white space before a text, the last sign stands apart; a blank joins what follows
    before = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~row_edge[1:-1])
    new[before] = True
    new[before[data[before] == 32] + 1] = False
    # contractions
    quote = np.flatnonzero((data == 39) & new)
    for size, ends in ((2, (b"s", b"t", b"m", b"d")), (3, (b"re", b"ve", b"ll"))):
        at = quote[quote + size <= n]
        for own in ends:
            ok = np.ones(len(at), bool)
            for k, c in enumerate(own, 1):
                ok &= (data[at + k] == c) & ~row_edge[at + k]
            new[at[ok] + 1] = False
            after = at[ok] + size
            new[after[after < n]] = True
    return np.flatnonzero(new)


class PieceTokenizer:
    """Ids of texts from a tokenizer file of the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.own = Tokenizer.from_file(path)
        # asked by parts: the whole rule would be a copy of the vocabulary in each worker
        split = json.loads(self.own.pre_tokenizer.__getstate__()) if self.own.pre_tokenizer else {}
        self.plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and self.own.normalizer is None
        added = self.own.get_added_tokens_decoder().values()
        self.special = re.compile(b"|".join(re.escape(t.content.encode()) for t in added) or b"(?!)")
        self.forget()

    def forget(self) -> None:
        self.count, self.used = 0, 0
        self.keys, self.first = np.zeros(1 << 16, U), np.zeros(1 << 16, U)
        self.at, self.size = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.uint8)
        self.ids = np.zeros(1 << 18, np.int32)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.own.encode(text, add_special_tokens=False).ids, np.int32)

    def encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of rows of UTF-8, each with end_id at its end."""
        rows = len(offsets) - 1
        raw = data.tobytes()
        odd = np.zeros(rows, bool)
        if self.plain:
            found = np.concatenate([odd_places(data), np.array([m.start() for m in self.special.finditer(raw)], np.int64)])
            odd[np.searchsorted(offsets, found, side="right") - 1] = True
        else:
            odd[:] = True
        if not odd.any():
            ids, counts = self._plain(data, offsets)
            return self._ended(ids, counts, end_id)
        parts, counts = [], np.zeros(rows, np.int64)
        for r in range(rows):
            text = raw[offsets[r]: offsets[r + 1]]
            if odd[r]:
                own = self.whole(text.decode())
            else:
                own = self._plain(data[offsets[r]: offsets[r + 1]], np.array([0, len(text)]))[0]
            parts.append(own)
            counts[r] = len(own)
        return self._ended(np.concatenate(parts), counts, end_id)

    @staticmethod
    def _ended(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.concatenate([[0], np.cumsum(counts + 1)])
        out = np.full(at[-1], end_id, np.int32)
        out[np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)] = ids
        return out, at

    def _plain(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
        start = boundaries(data, offsets)
        size = np.diff(np.append(start, len(data)))
        key, first = self._keys(data, start, size)
        slot = self._find(key, first)
        miss = np.flatnonzero((slot < 0) & (size <= LONGEST))
        if len(miss):
            _, one = np.unique(key[miss], return_index=True)
            self._learn(data, start[miss[one]], size[miss[one]], key[miss[one]], first[miss[one]])
            slot = self._find(key, first)  # the table may have been built anew
        at, n = self.at[slot].astype(np.int64), self.size[slot].astype(np.int64)
        ids = self.ids
        long = np.flatnonzero(slot < 0)  # unknown ones: longer pieces, or two with one key
        if len(long):
            extra = [self.whole(data[start[i]: start[i] + size[i]].tobytes().decode()) for i in long]
            n[long] = [len(e) for e in extra]
            at[long] = len(ids) + np.cumsum(n[long]) - n[long]
            ids = np.concatenate([ids, *extra])
        begin = np.cumsum(n) - n
        total = int(n.sum())
        out = ids[np.repeat(at - begin, n) + np.arange(total)]
        edge = np.append(begin, total)[np.searchsorted(start, offsets)]
        return out, np.diff(edge)

    @staticmethod
    def _keys(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A hash of each piece (never EMPTY), and its first eight bytes."""
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
        mask = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], U)
        first = eight[start] & mask[np.minimum(size, 8)]
        key = mix(first + size.astype(U) * ODD)
        for k in range(8, LONGEST, 8):
            more = np.flatnonzero((size > k) & (size <= LONGEST))
            if not len(more):
                break
            key[more] = mix(key[more] ^ (eight[start[more] + k] & mask[np.minimum(size[more] - k, 8)]) * ODD)
        key[size > LONGEST] = mix(start[size > LONGEST] + 1)
        return np.where(key == EMPTY, ODD, key), first

    def _find(self, key: np.ndarray, first: np.ndarray) -> np.ndarray:
        mask = U(len(self.keys) - 1)
        slot = (key & mask).astype(np.int64)
        there = self.keys[slot]
        out = np.where((there == key) & (self.first[slot] == first), slot, -1)
        todo = np.flatnonzero((there != key) & (there != EMPTY))
        at = slot[todo]
        while len(todo):
            at = (at + 1) & int(mask)
            there = self.keys[at]
            hit = there == key[todo]
            ok = hit & (self.first[at] == first[todo])
            out[todo[ok]] = at[ok]
            more = ~hit & (there != EMPTY)
            todo, at = todo[more], at[more]
        return out

    def _learn(self, data, start, size, key, first) -> None:
        if self.count + len(key) > MOST_PIECES:
            self.forget()
        while (self.count + len(key)) * 10 > len(self.keys) * 7:
            self._grow()
        found = [self.own.encode(data[a: a + n].tobytes().decode(), add_special_tokens=False).ids for a, n in zip(start.tolist(), size.tolist())]
        lens = np.array([len(f) for f in found], np.int32)
        flat = np.array([i for f in found for i in f], np.int32)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.int32)])
        self.ids[self.used: self.used + len(flat)] = flat
        self._put(key, first, self.used + np.cumsum(lens) - lens, lens)
        self.used += len(flat)

    def _grow(self) -> None:
        full = np.flatnonzero(self.keys != EMPTY)
        old = self.keys[full], self.first[full], self.at[full], self.size[full]
        n = 2 * len(self.keys)
        self.keys, self.first, self.at, self.size, self.count = np.zeros(n, U), np.zeros(n, U), np.zeros(n, np.int32), np.zeros(n, np.uint8), 0
        self._put(*old)

    def _put(self, key, first, at, size) -> None:
        mask = len(self.keys) - 1
        todo, slot = np.arange(len(key)), (key & U(mask)).astype(np.int64)
        while len(todo):
            free = self.keys[slot] == EMPTY
            self.keys[slot[free]] = key[todo[free]]  # of several keys for a slot the last one stays
            placed = free & (self.keys[slot] == key[todo])
            own, where = todo[placed], slot[placed]
            self.first[where], self.at[where], self.size[where] = first[own], at[own], size[own]
            todo, slot = todo[~placed], (slot[~placed] + 1) & mask
        self.count += len(key)


_own: dict[str, PieceTokenizer] = {}


def shared_tokenizer(path: str) -> PieceTokenizer:
    """One tokenizer for each worker process, which keeps its pieces from task to task."""
    if path not in _own:
        _own[path] = PieceTokenizer(path)
    return _own[path]
