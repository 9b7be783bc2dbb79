"""An adaptive context-mixing range coder for token ids below 2**16.

A frame of ids is cut into blocks of a fixed length. Blocks are independent: each starts
from the tables of its frame and ends with its own CRC-32, so any block can be read or lost
alone. All blocks of a frame are coded in lockstep, one id of every block at a time, which
makes each step a few dozen array operations.

An id is coded with one distribution that mixes three predictions:

    P(x) = u0 * P0(x) + u1 * [x = p1] + u2 * [x = p2]

P0 is the order-0 distribution of the frame; p1 (order 1) is what follows the last id most
often in the frame; p2 (order 2) is what followed the last two ids when they were last seen
in this block, or, as long as they were not, what follows them most often in the frame. The
shares u, kept by block for each confidence of order 2, for each kind of order-1 context
(sure or not) and for agreement of the two, move towards the predictions that were right.
P is a distribution over ids in numeric order, so its cumulative sums are those of P0 plus
a share for each prediction below x: no escape symbols, and one coding step an id.

The range is 63 bits wide; 32 bits leave it at a time. Carries are added to the words that
went before when a frame is finished.
"""

from __future__ import annotations

import zlib

import numpy as np

U, I = np.uint64, np.uint32
SIZE = 1 << 16
CELLS = 9
RATE = 5
#: What a share gains when its prediction is right; the sum of two shares stays below 255 of 256.
GAIN = 2032
FULL, LEAST, LOW31 = U((1 << 63) - 1), U(1 << 31), U((1 << 31) - 1)
#: Shares of order 2 by its confidence, before a block has seen anything, in 1/256 (order 1: half of the rest).
FIRST = (77, 77, 128, 180)


def _hashed(ids: np.ndarray) -> np.ndarray:
    return ids.astype(I) * I(0x9E3779B1)


def _pair(prev: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of two ids from their own hashes."""
    return last ^ (prev >> I(9))


def _most(keys: np.ndarray, otherwise: int) -> tuple[np.ndarray, np.ndarray]:
    """keys: context << 16 | id. The most frequent id of every context (the largest among equals), and whether it has over a quarter."""
    out, sure = np.full(SIZE, otherwise, I), np.zeros(SIZE, I)
    if not len(keys):
        return out, sure
    keys = np.sort(keys)
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    count = np.diff(np.append(begin, len(keys)))
    keys = keys[begin]
    context = keys >> I(16)
    first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
    best = np.maximum.reduceat(count << 16 | (keys & I(0xFFFF)), first)
    out[context[first]] = best & 0xFFFF
    sure[context[first]] = 4 * (best >> 16) > np.add.reduceat(count, first)
    return out, sure


class Tables:
    """What the blocks of a frame start from: order-0 frequencies, and the usual successor of one id and of two."""

    def __init__(self, frequency: np.ndarray, one: np.ndarray, sure: np.ndarray, two: np.ndarray):
        self.parts = frequency, one, sure, two
        start = np.cumsum(frequency) - frequency
        # start and length - 1 of every id in the order-0 distribution; ids that do not occur are never asked for
        self.place = (start << 16 | np.maximum(frequency - 1, 0)).astype(I)
        self.one, self.two = one | sure << I(16), two

    @classmethod
    def of(cls, ids: np.ndarray) -> Tables:
        n = len(ids)
        count = np.bincount(ids, minlength=SIZE)
        have = np.flatnonzero(count)
        frequency = np.zeros(SIZE, np.int64)
        frequency[have] = 1 + count[have] * (SIZE - len(have)) // n
        common = int(count.argmax())  # a prediction is an id of the frame, whatever the context
        frequency[common] += SIZE - frequency.sum()
        wide, h = ids.astype(I), _hashed(ids)
        one, sure = _most(wide[:-1] << I(16) | wide[1:], common)
        two, _ = _most((_pair(h[:-2], h[1:-1]) >> I(16)) << I(16) | wide[2:], common)
        return cls(frequency, one, sure, two)

    def dump(self) -> bytes:
        frequency, one, sure, two = self.parts
        # a frequency of 2**16 stands alone and is written as 0
        return zlib.compress(b"".join([(frequency & 0xFFFF).astype("<u2").tobytes(), one.astype("<u2").tobytes(), np.packbits(sure.astype(bool)).tobytes(), two.astype("<u2").tobytes(), bytes([bool((frequency == SIZE).any())])]), 6)

    @classmethod
    def load(cls, data: bytes) -> Tables:
        raw = zlib.decompress(data)
        wide = lambda k, n: np.frombuffer(raw, "<u2", n, k).astype(I)
        frequency = wide(0, SIZE).astype(np.int64)
        sure = np.unpackbits(np.frombuffer(raw, np.uint8, SIZE // 8, 4 * SIZE)).astype(I)
        if raw[-1]:
            frequency[wide(2 * SIZE, 1)] = SIZE
        return cls(frequency, wide(2 * SIZE, SIZE), sure, wide(4 * SIZE + SIZE // 8, SIZE))


class Model:
    """Predictions and shares of m blocks."""

    def __init__(self, m: int, tables: Tables):
        self.place, self.usual_one, self.usual_two = tables.place, tables.one, tables.two
        lane = np.arange(m, dtype=np.int64)
        self.cell, self.row0 = lane << CELLS, lane << 4
        self.seen = np.zeros(m << CELLS, I)
        shares = [(s << 8) << 16 | (0 if same else (255 - s) // 2 << 8) for s in FIRST for _ in range(2) for same in range(2)]
        self.shares = np.tile(np.array(shares, I), m)
        self.prev, self.last, self.id = np.zeros(m, I), np.zeros(m, I), np.zeros(m, I)

    def predict(self) -> None:
        """Sets p1, p2 and the shares of every block."""
        h = _pair(self.prev, self.last)
        self.at = self.cell + (h >> I(32 - CELLS))
        found = self.seen.take(self.at)
        self.sure2 = found >> I(16)
        self.p2 = np.where(self.sure2 == 0, self.usual_two.take(h >> I(16)), found & I(0xFFFF))
        one = self.usual_one.take(self.id)
        self.p1 = one & I(0xFFFF)
        self.row = self.row0 + ((self.sure2 << I(2)) + ((one >> I(16)) << I(1)) + (self.p1 == self.p2))
        self.both = self.shares.take(self.row)
        self.u2 = self.both >> I(24)
        self.u1 = (self.both >> I(8)) & I(0xFF)
        self.u0 = I(256) - self.u2 - self.u1

    def span(self, x: np.ndarray, hit2: np.ndarray, hit1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and length of ids in the mixed distribution, of 2**24."""
        place = self.place.take(x)
        start = self.u0 * (place >> I(16)) + ((self.u2 * (self.p2 < x) + self.u1 * (self.p1 < x)) << I(16))
        length = self.u0 * ((place & I(0xFFFF)) + I(1)) + ((self.u2 * hit2 + self.u1 * hit1) << I(16))
        return start, length

    def update(self, x: np.ndarray, hit2: np.ndarray, hit1: np.ndarray) -> None:
        gain = hit2 * I(GAIN << 16) + (hit1 > hit2) * I(GAIN)
        self.shares[self.row] = self.both - ((self.both >> I(RATE)) & I(0x07FF07FF)) + gain
        self.seen[self.at] = x + ((np.minimum(self.sure2, I(2)) * hit2 + I(1)) << I(16))
        self.prev, self.last, self.id = self.last, _hashed(x), x


def _grid(ids: np.ndarray, size: int) -> np.ndarray:
    """ids in columns of one block each; the last block is filled up with its own first id."""
    m, size = -(-len(ids) // size), min(size, len(ids))
    grid = np.full(m * size, ids[(m - 1) * size], I)
    grid[: len(ids)] = ids
    return np.ascontiguousarray(grid.reshape(m, size).T)


def encode(ids: np.ndarray, size: int) -> tuple[bytes, list[bytes], list[int]]:
    """The tables of the frame, its coded blocks of `size` ids, and their CRC-32 (of the ids as little-endian 16-bit integers)."""
    n = len(ids)
    if not n:
        return b"", [], []
    tables, grid = Tables.of(ids), _grid(ids, size)
    m = grid.shape[1]
    model = Model(m, tables)
    low, wide = np.zeros(m, U), np.full(m, FULL, U)
    # an id takes 24 bits at most
    out, used = np.zeros((len(grid) * 3 // 4 + 4) * m, U), np.zeros(m, np.int64)
    last, lane = n - (m - 1) * size, np.arange(m)
    for t, x in enumerate(grid):
        if t == last:  # the last block has ended: the rest of its column leaves no words
            kept = used[-1], low[-1], wide[-1]
        model.predict()
        hit2, hit1 = x == model.p2, x == model.p1
        start, length = model.span(x, hit2, hit1)
        wide >>= U(24)
        low += wide * start
        wide *= length
        k = np.flatnonzero(wide < LEAST)
        now = low[k]
        out[used[k] * m + k] = now >> U(31)
        used[k] += 1
        low[k] = (now & LOW31) << U(32)
        wide[k] <<= U(32)
        model.update(x, hit2, hit1)
    if last < len(grid):
        used[-1], low[-1], wide[-1] = kept
    # any number in [low, low + wide) will do: the one whose last 31 bits are zero; decoders read zeros beyond it
    out[used * m + lane] = (low + LOW31) >> U(31)
    used += 1
    words = out.reshape(-1, m)[: used.max()]
    words[used[-1] :, -1] = 0
    while (carry := words >> U(32)).any():
        words &= U(0xFFFFFFFF)
        words[:-1] += carry[1:]
    flat = np.ascontiguousarray(words.T).astype(">u4")
    wire = ids.astype("<u2")
    return tables.dump(), [flat[i, : used[i]].tobytes() for i in range(m)], [zlib.crc32(wire[i * size : (i + 1) * size]) for i in range(m)]


def decode(n: int, size: int, tables: bytes, blocks: list[bytes], crcs: list[int]) -> np.ndarray:
    """The n ids of a frame; a block whose checksum does not hold raises ValueError."""
    if not n:
        return np.zeros(0, np.uint16)
    m = len(blocks)
    known = Tables.load(tables)
    by_share = np.repeat(np.arange(SIZE, dtype=I), known.parts[0])
    model = Model(m, known)
    room = max(map(len, blocks)) // 4 + 4
    words = np.zeros((m, room), U)
    for row, b in zip(words, blocks):
        row[: len(b) // 4] = np.frombuffer(b, ">u4")
    # the range begins one bit below a word, so what follows the first 63 bits is cut there
    value = (words[:, 0] << U(31)) | (words[:, 1] >> U(1))
    more = np.ascontiguousarray((((words[:, 1:-1] & U(1)) << U(31)) | (words[:, 2:] >> U(1))).T).ravel()
    wide, used, most = np.full(m, FULL, U), np.zeros(m, np.int64), len(more) // m - 1
    grid = np.zeros((min(size, n), m), np.uint16)
    for row in grid:
        model.predict()
        u0, u1, u2, p1, p2 = model.u0, model.u1 << I(16), model.u2 << I(16), model.p1, model.p2
        wide >>= U(24)
        v = np.minimum(value // wide, U((1 << 24) - 1)).astype(I)
        place2, place1 = known.place.take(p2), known.place.take(p1)
        start2 = u0 * (place2 >> I(16)) + u1 * (p1 < p2)
        start1 = u0 * (place1 >> I(16)) + u2 * (p2 < p1)
        same = p1 == p2
        hit2 = v - start2 < u0 * ((place2 & I(0xFFFF)) + I(1)) + u2 + u1 * same
        hit1 = v - start1 < u0 * ((place1 & I(0xFFFF)) + I(1)) + u1 + u2 * same
        rest = v - u2 * (v >= start2) - u1 * (v >= start1)
        x = by_share.take(rest // u0, mode="clip")
        x = np.where(hit2, p2, np.where(hit1, p1, x))
        hit2, hit1 = x == p2, x == p1
        start, length = model.span(x, hit2, hit1)
        value -= wide * start
        wide *= length
        k = np.flatnonzero(wide < LEAST)
        value[k] = (value[k] << U(32)) | more[np.minimum(used[k], most) * m + k]
        used[k] += 1
        wide[k] <<= U(32)
        row[:] = x
        model.update(x, hit2, hit1)
    ids = grid.T.ravel()[:n].astype("<u2")
    for i, crc in enumerate(crcs):
        if zlib.crc32(ids[i * size : (i + 1) * size]) != crc:
            raise ValueError(f"block {i} fails its checksum")
    return ids
