"""Words of a batch of texts as byte ranges, and tables that know them.

A table looks up all words of a batch at once, by array operations. Words of up to 16 bytes
are found by their packed bytes (equal bytes, not just equal hashes); longer ones in a
dictionary. Tables are emptied over a limit; that bounds memory and changes no result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Masks of the first n bytes of eight.
_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


class Words:
    """Words of a text that begin at the given characters, as byte ranges of one buffer.

    docs: how many words there are up to the end of each document; keep: which words count;
    special: for words that stand for something else, its number, or -1.
    """

    def __init__(self, whole: str, points: np.ndarray, begin: np.ndarray, docs: np.ndarray, keep: np.ndarray | None = None):
        width = (points > 0x7F).view(np.uint8) + (points > 0x7FF).view(np.uint8) + (points > 0xFFFF).view(np.uint8)
        first = begin + (np.cumsum(width, dtype=np.int64) - width)[begin] if width.any() else begin
        self.raw = whole.encode() + bytes(16)
        self.buffer = np.frombuffer(self.raw, np.uint8)
        size = np.diff(np.append(first, len(self.buffer) - 16))
        self.first, self.size = (first, size) if keep is None else (first[keep], size[keep])
        self.docs = docs
        self.special = np.full(len(self.first), -1, np.int64)

    def words(self, at: np.ndarray) -> list[str]:
        """Words by their places in the list."""
        first = self.first[at]
        return [self.raw[a:z].decode() for a, z in zip(first.tolist(), (first + self.size[at]).tolist())]


class WordTable:
    """Numbers of words, given in the order in which they are first seen."""

    def __init__(self, slots: int = 1 << 20, most: int = 400_000):
        self.bits, self.most = slots.bit_length() - 1, most
        self.reset()

    def reset(self) -> None:
        self._empty()
        self.long: dict[bytes, int] = {}
        self.n = 0

    def _empty(self) -> None:
        # sixteen bytes in two columns, then number and size; size 0 is an empty slot
        self.low, self.high, self.tag = (np.zeros(1 << self.bits, np.uint64) for _ in range(3))

    def _slots(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        h = (a * np.uint64(0x9E3779B97F4A7C15) ^ b * np.uint64(0xC2B2AE3D27D4EB4F)) + size
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, a, b, size, slot) -> np.ndarray:
        """Numbers of words, -1 for those not there."""
        out, left, top = None, None, len(self.tag) - 1
        while True:
            tag = self.tag.take(slot)
            held = tag & np.uint64(31)
            same = (self.low.take(slot) == a) & (self.high.take(slot) == b) & (held == size)
            number = np.where(same, (tag >> np.uint64(5)).view(np.int64), -1)
            if out is None:
                out = number
            else:
                out[left] = number
            go = np.flatnonzero(~same & (held != 0))  # another word sits there
            if not len(go):
                return out
            left = go if left is None else left[go]
            a, b, size, slot = a[go], b[go], size[go], (slot[go] + 1) & top

    def _add(self, a, b, size, slot, number) -> None:
        """Distinct words that are not there yet."""
        top = len(self.tag) - 1
        while len(a):
            _, first = np.unique(slot, return_index=True)
            won = np.zeros(len(a), bool)
            won[first] = True
            won &= self.tag[slot] == 0
            at = slot[won]
            self.low[at], self.high[at], self.tag[at] = a[won], b[won], number[won] << np.uint64(5) | size[won]
            # the others move on
            a, b, size, slot, number = a[~won], b[~won], size[~won], (slot[~won] + 1) & top, number[~won]

    def number(self, spans: Words) -> tuple[np.ndarray, list[str]]:
        """The number of every word (special ones: -1), and the new words in the order of their numbers."""
        if self.n > self.most:
            self.reset()
        before, new = self.n, []
        first, size = spans.first, spans.size
        out = np.full(len(first), -1, np.int64)
        plain = spans.special < 0
        short = np.flatnonzero(plain & (size <= 16))
        view = np.ndarray(len(spans.buffer) - 7, "<u8", spans.buffer, 0, (1,))
        at, n = first[short], size[short]
        a = view[at] & _BYTES[np.minimum(n, 8)]
        b = view[at + 8] & _BYTES[np.maximum(n, 8) - 8]
        wide = n.astype(np.uint64)
        slot = self._slots(a, b, wide)
        found = self._find(a, b, wide, slot)
        miss = np.flatnonzero(found < 0)
        if len(miss):
            x, y, z = a[miss], b[miss], wide[miss]
            order = np.lexsort((z, y, x))
            x, y, z = x[order], y[order], z[order]
            head = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (z[1:] != z[:-1])])
            number = before + np.cumsum(head) - 1
            found[miss[order]] = number
            heads = np.flatnonzero(head)
            while self.n + len(heads) > len(self.tag) * 3 // 4:  # a batch of many new words
                self._grow()
            pick = miss[order[heads]]
            self._add(x[heads], y[heads], z[heads], self._slots(x[heads], y[heads], z[heads]), number[heads].astype(np.uint64))
            new = spans.words(short[pick])
            self.n += len(heads)
        out[short] = found
        for k in np.flatnonzero(plain & (size > 16)).tolist():
            raw = spans.raw[first[k] : first[k] + size[k]]
            if (i := self.long.get(raw)) is None:
                i = self.long[raw] = self.n
                self.n += 1
                new.append(raw.decode())
            out[k] = i
        return out, new

    def _grow(self) -> None:
        used = np.flatnonzero(self.tag)
        a, b, tag = self.low[used], self.high[used], self.tag[used]
        self.bits += 1
        self._empty()
        size = tag & np.uint64(31)
        self._add(a, b, size, self._slots(a, b, size), tag >> np.uint64(5))


class Growing:
    """An array that is appended to; room doubles, so that little is copied."""

    def __init__(self, start: np.ndarray):
        self.n, self.room = len(start), np.zeros(max(1 << 12, 2 * len(start)), start.dtype)
        self.room[: self.n] = start

    def append(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.room):
            self.room = np.concatenate([self.room[: self.n], np.zeros(self.n + 2 * len(more), self.room.dtype)])
        self.room[self.n : self.n + len(more)] = more
        self.n += len(more)


class IdTable:
    """Ids of words, asked of `learn` (ids of all words side by side, and how many each has) once for each new word."""

    def __init__(self, learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], specials: list[int], most: int):
        self.learn, self.specials, self.table = learn, specials, WordTable(most=most)
        self.forget()

    def forget(self) -> None:
        self.flat = Growing(np.array(self.specials, np.uint16))
        self.at, self.length = Growing(np.zeros(0, np.int32)), Growing(np.zeros(0, np.int32))

    def ids(self, spans: Words, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all documents, each followed by end where there is one, and the number of ids of each."""
        number, new = self.table.number(spans)
        if self.table.n == len(new):  # emptied
            self.forget()
        if new:
            flat, length = self.learn(new)
            self.at.append(self.flat.n + np.cumsum(length) - length)
            self.length.append(length)
            self.flat.append(flat)
        special = np.flatnonzero(number < 0)
        number[special] = 0
        size, source = self.length.room.take(number), self.at.room.take(number)
        size[special], source[special] = 1, spans.special[special]
        stop = np.cumsum(size, dtype=np.int64)
        every = self.flat.room[np.repeat(source - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)]
        ends = np.concatenate([[0], stop])[spans.docs]
        counts = np.diff(np.concatenate([[0], ends]))
        return (every, counts) if end is None else (np.insert(every, ends, np.uint16(end)), counts + 1)
