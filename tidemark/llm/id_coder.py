"""A context-mixing range coder for token ids, run on many blocks at once.

A segment is cut into blocks of ``BLOCK`` ids. Every block starts from the same fresh state and is
coded on its own, with a CRC-32 of its ids, so that any block can be read without the others
(``decode_blocks``). All blocks of a segment advance together: one NumPy operation serves them all. The
models learn at a few places of a block (``_stops``), the same in all, from all ids before; between them
they stand still, so that the writer works out whole stretches at once and only the coder goes id by id.

Four predictions are mixed for each id:

* order 2 and order 1: the id that last followed the previous two ids or one in this block, with a
  confidence level. How often a level is right is counted as the block goes;
* order 0, adaptive: counts of the ids of this block, in a hashed cache whose rare entries give way;
* a fallback that knows every id: how common ids are in the segment, from a table in its header.

The longest context has the share that its level earned, the next one its share of the rest; the weights
of cache and fallback follow Bayes' rule. An id is coded in two parts: which prediction, then, by the
cache's counts or the fallback, which id. Weights are whole numbers, or come from IEEE basic operations
without long sums, so that encoder and decoder agree on every machine. A segment also carries bytes of
its writer's own, with a CRC-32 of theirs.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK = 2048
MAGIC = b"TMIDS3\0\0"
_SLOTS0, _SLOTS1, _SLOTS2, _LEVEL_BITS = 256, 1024, 2048, 3
_LEVELS = 1 << _LEVEL_BITS
_STEP_BITS, _BASE_BITS = 16, 24
_FULL, _LOW = (1 << 48) - 1, 1 << 32
_U = np.uint64


class BrokenBlock(ValueError):
    """A block's ids do not have its checksum."""


#: The confidence after a miss and a hit, by the one before.
_NEXT = np.array([*[1 if s <= 1 else s >> 1 for s in range(_LEVELS)], *[min(s + 1, _LEVELS - 1) for s in range(_LEVELS)]], np.int32)


def _stops(steps: int) -> list[int]:
    """Where the models learn, and the end."""
    return [*(t for t in (0, 16, 32, 64, 128, *range(256, BLOCK, 256)) if t < steps), steps]


class _Model:
    """The state of all blocks of a segment; arrays of ids have a row for each step and a column for each block."""

    def __init__(self, lanes: int, share0: np.ndarray, width0: np.ndarray) -> None:
        self.share0, self.width0, self.n = share0, width0, np.arange(lanes)
        # by order: the follower and, in the last bits, its level
        self.follower = [np.zeros(lanes * slots, np.int32) for slots in (_SLOTS1, _SLOTS2)]
        # of a level's predictions: right ones and all; a new level is right one time in three, a sure one more often
        self.right = [np.tile(np.arange(1, _LEVELS + 1), lanes) for _ in range(2)]
        self.tried = [np.tile(np.arange(1, _LEVELS + 1) // 2 + 3, lanes) + np.tile(np.arange(_LEVELS), lanes) // 2 for _ in range(2)]
        self.id0, self.count0 = np.full(lanes * _SLOTS0, -1, np.int32), np.zeros(lanes * _SLOTS0, np.int64)
        self.own, self.all = np.full(lanes, 1 << 16), np.full(lanes, 2 << 16)  # what the cache earned, of how much
        self.prev = np.zeros((2, lanes), np.int64)
        self.settle()

    def settle(self) -> None:
        """The widths that hold until the next stop."""
        self.rate = [np.where(np.arange(len(r)) % _LEVELS > 0, np.minimum(r * 65000 // t, 65000), 0) for r, t in zip(self.right, self.tried)]
        ends = np.cumsum(self.count0.reshape(len(self.n), _SLOTS0), 1)
        total = ends[:, -1:].copy()
        self.weight0 = np.where(total[:, 0] > 0, self.own * 64000 // self.all, 0)
        ends *= 1 << _BASE_BITS
        ends //= np.maximum(total, 1)
        # of all lanes one after the other, so that one search finds the slots of all
        self.ends0 = (ends + (self.n << _BASE_BITS)[:, None]).ravel()

    def slots(self, prev1: np.ndarray, prev2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.n * _SLOTS1 + ((prev1 * 40503) >> 4) % _SLOTS1, self.n * _SLOTS2 + ((prev1 * 40503 + prev2 * 30011 + 7) >> 3) % _SLOTS2

    def predict(self, at1: np.ndarray, at2: np.ndarray) -> tuple[np.ndarray, ...]:
        """The followers by order 1 and 2, and the widths, out of 2**16, of order 2, order 1 and the cache."""
        c1, c2, level = self.follower[0].take(at1), self.follower[1].take(at2), self.n * _LEVELS
        a2 = self.rate[1].take(level + (c2 & _LEVELS - 1))
        a1 = (65536 - a2) * self.rate[0].take(level + (c1 & _LEVELS - 1)) >> 16
        c1 >>= _LEVEL_BITS
        c2 >>= _LEVEL_BITS
        a1 *= (c1 != c2) | (a2 == 0)
        return c1, c2, a2, a1, (65536 - a2 - a1) * self.weight0 >> 16

    def slots0(self, ids: np.ndarray) -> np.ndarray:
        return self.n * _SLOTS0 + ((ids * 40503) >> 4) % _SLOTS0

    def cached(self, at0: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids' parts of the cache begin, and their widths, none for ids that it has not."""
        begin = self.ends0.take(np.maximum(at0 - 1, 0)) - (self.n << _BASE_BITS)
        begin *= at0 > self.n * _SLOTS0
        width = self.ends0.take(at0) - (self.n << _BASE_BITS) - begin
        width *= self.id0.take(at0) == ids
        return begin, width

    def learn(self, ids: np.ndarray) -> None:
        """Take in the ids since the last stop."""
        before = np.concatenate([self.prev, ids])
        ats = self.slots(before[1:-1], before[:-2])
        missed = None
        for k in (1, 0):
            at, follower = ats[k], self.follower[k]
            now = follower.take(at)
            s, hit = now & _LEVELS - 1, now >> _LEVEL_BITS == ids
            hit &= s > 0
            level = (self.n * _LEVELS + s) * 2 + hit
            # wrong and right ones of each level, side by side
            found = np.bincount(level.ravel() if missed is None else level[missed], minlength=2 * len(self.tried[k])).reshape(-1, 2)
            self.tried[k] = self.tried[k] + found.sum(1)
            self.right[k] = self.right[k] + found[:, 1]
            missed = ~hit if missed is None else missed & ~hit
            # of several, the last
            follower[at] = np.where(hit | (s > 1), now - s, ids << _LEVEL_BITS) + _NEXT.take(s + _LEVELS * hit)
        at0 = self.slots0(ids)
        cache, fall = self.weight0 * self.cached(at0, ids)[1], (65536 - self.weight0) * self.width0.take(ids)
        earned = (cache << 8) // np.maximum(cache + fall >> 8, 1) * missed
        self.own, self.all = self.own + earned.sum(0), self.all + (missed.sum(0) << 16)
        other = self.id0.take(at0) != ids
        less, new = at0[other], ids[other]
        self.count0[less] >>= 1  # once, however often the slot is asked for
        give = self.count0.take(less) < 2
        less, new = less[give], new[give]
        self.count0[less] = 0
        self.id0[less] = new
        self.count0 += 2 * np.bincount(at0[self.id0.take(at0) == ids], minlength=len(self.count0))
        self.prev = before[-2:]
        self.settle()


class _Writer:
    def __init__(self, lanes: int) -> None:
        self.low, self.range = np.zeros(lanes, np.uint64), np.full(lanes, _FULL, np.uint64)
        self.out, self.size = np.zeros((lanes, 3 * BLOCK + 16), np.uint16), np.zeros(lanes, np.int64)

    def put(self, lanes: np.ndarray | slice, low: np.ndarray, width: np.ndarray, bits: int) -> None:
        """Code an interval in each lane; a slice stands for the first lanes, all of them."""
        r = self.range[lanes] >> _U(bits)
        now = self.low[lanes] + r * low.view(np.uint64)
        r *= width.view(np.uint64)
        self.low[lanes], self.range[lanes] = now, r
        over = np.flatnonzero(now > _U(_FULL))
        if len(over):
            over = over if isinstance(lanes, slice) else lanes[over]
            self.low[over] &= _U(_FULL)
            at = self.size[over] - 1
            while len(over):
                self.out[over, at] += 1
                go = self.out[over, at] == 0
                over, at = over[go], at[go] - 1
        short = np.flatnonzero(r < _U(_LOW))
        if not isinstance(lanes, slice):
            short = lanes[short]
        while len(short):
            self.emit(short)
            short = short[self.range[short] < _U(_LOW)]

    def emit(self, lanes: np.ndarray) -> None:
        self.out[lanes, self.size[lanes]] = self.low[lanes] >> _U(32)
        self.size[lanes] += 1
        self.low[lanes] = (self.low[lanes] & _U(_LOW - 1)) << _U(16)
        self.range[lanes] <<= _U(16)

    def end(self) -> list[bytes]:
        every = np.arange(len(self.low))
        for _ in range(3):
            self.emit(every)
        return [self.out[i, :n].tobytes() for i, n in enumerate(self.size)]


class _Reader:
    def __init__(self, words: np.ndarray, begins: np.ndarray) -> None:
        self.words, self.at = words, begins[:-1].copy()
        self.code = np.zeros(len(self.at), np.uint64)
        self.range = np.full(len(self.at), _FULL, np.uint64)
        every = np.arange(len(self.at))
        for _ in range(3):
            self.take(every)
        self.range[:] = _FULL

    def take(self, lanes: np.ndarray) -> None:
        self.code[lanes] = (self.code[lanes] << _U(16)) | self.words[np.minimum(self.at[lanes], len(self.words) - 1)].astype(np.uint64)
        self.at[lanes] += 1
        self.range[lanes] <<= _U(16)

    def spot(self, lanes: np.ndarray | slice, bits: int) -> np.ndarray:
        self.r = self.range[lanes] >> _U(bits)
        return np.minimum(self.code[lanes] // self.r, _U((1 << bits) - 1)).view(np.int64)

    def drop(self, lanes: np.ndarray | slice, low: np.ndarray, width: np.ndarray) -> None:
        self.code[lanes] -= self.r * low.view(np.uint64)
        r = self.r * width.view(np.uint64)
        self.range[lanes] = r
        short = np.flatnonzero(r < _U(_LOW))
        if not isinstance(lanes, slice):
            short = lanes[short]
        while len(short):
            self.take(short)
            short = short[self.range[short] < _U(_LOW)]


def _base_table(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Widths out of 2**24 of the ids that occur, where they begin, and their shares."""
    room = (1 << _BASE_BITS) - int((counts > 0).sum())
    width = np.where(counts > 0, 1 + counts * room // max(1, int(counts.sum())), 0).astype(np.int64)
    begin = np.r_[0, np.cumsum(width)]
    return width, begin, width / float(1 << _BASE_BITS)


class _Fallback:
    """Finds the ids of places in the base table; most by the first of 16 places alone, which have one id."""

    _BITS = 4

    def __init__(self, begin: np.ndarray, ids: int) -> None:
        self.begin, self.most = begin, ids - 1
        self.first = self.search(np.arange(0, (1 << _BASE_BITS) + 1, 1 << self._BITS)).astype(np.int32)

    def search(self, spot: np.ndarray) -> np.ndarray:
        return np.minimum(np.searchsorted(self.begin, spot, "right") - 1, self.most)

    def find(self, spot: np.ndarray) -> np.ndarray:
        at = spot >> self._BITS
        x = self.first.take(at)
        at += 1
        several = np.flatnonzero(self.first.take(at) != x)
        x[several] = self.search(spot[several])
        return x


def encode_segment(ids: np.ndarray, block: int = BLOCK, own: bytes = b"") -> bytes:
    """A segment's bytes: header, the writer's ``own`` bytes, fallback table, block sizes and checksums, blocks. ``block`` <= BLOCK."""
    ids = np.ascontiguousarray(ids, np.int64)
    n = len(ids)
    lanes = -(-n // block)
    counts = np.bincount(ids, minlength=1) if n else np.zeros(1, np.int64)
    table = zlib.compress(counts.astype("<u4").tobytes(), 6)
    crcs = np.zeros(lanes, "<u4")
    blocks: list[bytes] = []
    if n:
        width0, begin0, share0 = _base_table(counts)
        grid = np.full(lanes * block, ids[-1])  # the last block is filled up with its last id
        grid[:n] = ids
        grid = np.ascontiguousarray(grid.reshape(lanes, block).T)
        model, writer, every = _Model(lanes, share0, width0), _Writer(lanes), slice(lanes)
        stops = _stops(min(block, n))
        crcs[:] = [zlib.crc32(x.astype("<u4").tobytes()) for x in grid[: stops[-1]].T]
        for a, b in zip(stops, stops[1:]):
            x = grid[a:b]
            before = np.concatenate([model.prev, x])
            c1, c2, a2, a1, a0 = model.predict(*model.slots(before[1:-1], before[:-2]))
            is2 = (x == c2) & (a2 > 0)
            is1 = (x == c1) & (a1 > 0) & ~is2
            begin, part = model.cached(model.slots0(x), x)
            base = width0.take(x)
            rest = 65536 - a2 - a1 - a0
            is0 = (a0 * part > rest * base) & ~is2 & ~is1  # an id that is in the cache may still be cheaper by the fallback
            lows = np.where(is2, 0, np.where(is1, a2, np.where(is0, a2 + a1, a2 + a1 + a0)))
            widths = np.where(is2, a2, np.where(is1, a1, np.where(is0, a0, rest)))
            known = is2 | is1  # nothing more to tell: all of the second part
            lows2 = np.where(known, 0, np.where(is0, begin, begin0.take(x)))
            widths2 = np.where(known, 1 << _BASE_BITS, np.where(is0, part, base))
            for t in range(b - a):
                writer.put(every, lows[t], widths[t], _STEP_BITS)
                writer.put(every, lows2[t], widths2[t], _BASE_BITS)
            model.learn(x)
        blocks = writer.end()
    sizes = np.array([len(b) for b in blocks], "<u4")
    return b"".join([MAGIC, struct.pack("<QIIIII", n, block, lanes, len(table), len(own), zlib.crc32(own)), own, table, sizes.tobytes(), crcs.tobytes(), *blocks])


_HEAD = 8 + struct.calcsize("<QIIIII")


def _header(data: bytes) -> tuple[int, int, int, int, int, int]:
    if data[:8] != MAGIC:
        raise BrokenBlock("not a segment")
    return struct.unpack_from("<QIIIII", data, 8)


def own_bytes(data: bytes) -> bytes:
    """What the segment's writer put beside the ids; BrokenBlock if it does not have its checksum."""
    *_, size, crc = _header(data)
    own = data[_HEAD : _HEAD + size]
    if zlib.crc32(own) != crc:
        raise BrokenBlock("the segment's own bytes do not have their checksum")
    return own


def decode_blocks(data: bytes, which: list[int] | None = None) -> list[np.ndarray]:
    """The ids of the chosen blocks, or of all, without decoding others; BrokenBlock if one does not have its checksum."""
    n, block, lanes, m, size, _ = _header(data)
    at = _HEAD + size
    counts = np.frombuffer(zlib.decompress(data[at : at + m]), "<u4").astype(np.int64)
    at += m
    sizes, crcs = np.frombuffer(data, "<u4", lanes, at).astype(np.int64), np.frombuffer(data, "<u4", lanes, at + 4 * lanes)
    begins = at + 8 * lanes + np.r_[0, np.cumsum(sizes)]
    chosen = list(range(lanes)) if which is None else sorted(which)
    if not chosen:
        return []
    words = np.frombuffer(b"".join(data[begins[i] : begins[i + 1]] for i in chosen), "<u2")
    width0, begin0, share0 = _base_table(counts)
    fallback = _Fallback(begin0, len(counts))
    reader = _Reader(words, np.r_[0, np.cumsum(sizes[chosen] // 2)].astype(np.int64))
    length = np.array([min(block, n - i * block) for i in chosen])
    grid = np.zeros((block, len(chosen)), np.int64)
    model, every = _Model(len(chosen), share0, width0), slice(len(chosen))
    stops = _stops(min(block, n))
    for a, b in zip(stops, stops[1:]):
        prev2, prev1 = model.prev
        for t in range(a, b):
            c1, c2, a2, a1, a0 = model.predict(*model.slots(prev1, prev2))
            spot = reader.spot(every, _STEP_BITS)
            a1, a0 = a2 + a1, a2 + a1 + a0
            is2, is1, is0 = spot < a2, spot < a1, spot < a0
            low = np.where(is2, 0, np.where(is1, a2, np.where(is0, a1, a0)))
            reader.drop(every, low, np.where(is2, a2, np.where(is1, a1, np.where(is0, a0, 65536))) - low)
            spot = reader.spot(every, _BASE_BITS)
            low, width = np.zeros(len(chosen), np.int64), np.full(len(chosen), 1 << _BASE_BITS)
            s = np.where(is2, c2, c1).astype(np.int64)
            held = np.flatnonzero(is0 & ~is1 & ~is2)
            if len(held):
                at0 = np.searchsorted(model.ends0, spot[held] + (held << _BASE_BITS), "right")
                at0 = np.minimum(at0, (held + 1) * _SLOTS0 - 1)
                s[held] = model.id0.take(at0)
                begin = np.where(at0 > held * _SLOTS0, model.ends0.take(np.maximum(at0 - 1, 0)) - (held << _BASE_BITS), 0)
                low[held], width[held] = begin, model.ends0.take(at0) - (held << _BASE_BITS) - begin
            escaped = np.flatnonzero(~(is2 | is1 | is0))
            if len(escaped):
                x = fallback.find(spot[escaped])
                low[escaped], width[escaped] = begin0[x], width0[x]
                s[escaped] = x
            s = np.maximum(s, 0)  # a broken block may point to nothing
            reader.drop(every, low, width)
            grid[t] = s
            prev2, prev1 = prev1, s
        model.learn(grid[a:b])
    out = []
    for i, k, ids in zip(chosen, length, grid[: stops[-1]].T):
        if zlib.crc32(ids.astype("<u4").tobytes()) != crcs[i]:
            raise BrokenBlock(f"block {i} does not have its checksum")
        out.append(ids[:k].astype(np.uint32))
    return out


def decode_segment(data: bytes) -> np.ndarray:
    """All ids of a segment."""
    return np.concatenate([np.empty(0, np.uint32), *decode_blocks(data)])
