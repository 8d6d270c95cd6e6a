"""An adaptive context-mixing range coder for runs of token ids.

Every block of ids is coded on its own, from fresh tables, so that blocks can be read and checked alone. For each
id, the last id seen after the previous two ids (order 2) and after the previous one (order 1) are predictions,
with counts of how often they held. A table of outcomes, adaptive as well, is chosen by both counts and mixes the
two: it gives the probabilities that the order-2 prediction, the order-1 prediction or neither is right. In the
last case the id itself is coded from order 0, by the adaptive frequencies of such ids.

A block is cut into lanes, stretches of ids that are coded side by side: a step codes one id of every lane in numpy.
The lanes of a block share its tables, which learn from the ids of a step before the next one. A block takes some
512 steps whatever its size, so that long blocks cost least per id.
"""

from __future__ import annotations

import zlib

import numpy as np

_STEPS = 512  # ids of a lane, about
_SHORT = np.uint64(1 << 32)  # a range below this shifts out 32 bits
_UP = np.uint64(32)
_FAR, _NEAR = 1 << 18, 1 << 16  # slots for the predictions of order 2 and of order 1
_HELD = 3  # highest count of how often a prediction held, in the two low bits of a slot
_MIX_BITS = np.uint64(12)
_MIX = 1 << 12
_WINDOW = 1 << 20  # outcomes of a mixing row are halved beyond this sum
_TOTAL = 1 << 20  # highest sum of the frequencies of order 0
_DIGIT_BITS = 16
_MIXED = 4  # steps between new probabilities of the outcomes, after the first ones
_RENEWED = 32  # steps between renewals of the frequencies of order 0, after the first ones
_MASK = np.uint64(0xFFFFFFFF)


class _Digit:
    """Adaptive frequencies of order 0 for up to 16 bits of an id."""

    def __init__(self, shift: int, bits: int, inverse: bool):
        self.shift, self.size = shift, 1 << bits
        self.symbols = np.arange(self.size, dtype=np.uint16) if inverse else None
        self.counts = np.zeros(self.size, dtype=np.int64)
        self.seen = 0
        self.pending: list[np.ndarray] = []
        self.edges = np.zeros(self.size + 1, dtype=np.uint64)
        self.renew()

    def renew(self) -> None:
        """Frequencies from all symbols so far; each has at least 1, their sum is at most ``_TOTAL``."""
        if self.pending:
            symbols = np.concatenate(self.pending)
            self.pending = []
            self.counts += np.bincount(symbols, minlength=self.size)
            self.seen += len(symbols)
        gain = min(32 << 16, ((_TOTAL - self.size) << 16) // max(self.seen, 1))
        self.frequency = (1 + (self.counts * gain >> 16)).astype(np.uint64)
        np.cumsum(self.frequency, out=self.edges[1:])
        self.total = self.edges[-1]
        if self.symbols is not None:
            self.symbol_at = np.repeat(self.symbols, self.frequency.view(np.int64))


class _Coder:
    """What encoding and decoding share: the lanes of a block, its tables and how they learn."""

    def __init__(self, count: int, groups: int, inverse: bool):
        self.steps = -(-count // -(-count // _STEPS))
        self.lanes = -(-count // self.steps)
        self.last = count - (self.lanes - 1) * self.steps  # ids of the last lane, the only one that may be shorter
        self.range = np.full(self.lanes, np.iinfo(np.uint64).max, dtype=np.uint64)
        self.one = np.zeros(self.lanes, dtype=np.int64)
        self.two = np.zeros(self.lanes, dtype=np.int64)
        self.table = np.zeros(_FAR + _NEAR, dtype=np.int64)  # both orders: predicted id and how often it held
        self.outcomes = np.tile(np.array([1, 1, 4], dtype=np.int64), (32, 1))
        bits = 4 * groups
        self.digits = [
            _Digit(shift, min(_DIGIT_BITS, bits - shift), inverse) for shift in reversed(range(0, bits, _DIGIT_BITS))
        ]
        self.mix()

    def active(self, step: int) -> int:
        return self.lanes if step < self.last else self.lanes - 1

    def mix(self) -> None:
        """Frequencies of the three outcomes in each mixing row, in 1 / 4096."""
        sums = self.outcomes.sum(axis=1)
        if (full := sums > _WINDOW).any():
            self.outcomes[full] = (self.outcomes[full] >> 1) | 1
            sums = self.outcomes.sum(axis=1)
        own = 1 + self.outcomes * (_MIX - 3) // sums[:, None]
        own[:, 2] = _MIX - own[:, 0] - own[:, 1]
        below = np.cumsum(own, axis=1) - own
        self.mix_own, self.mix_below = own.astype(np.uint64).ravel(), below.astype(np.uint64).ravel()

    def predict(self, n: int):
        """Slots, entries and predictions of both orders for the first ``n`` lanes, and where their mixing rows begin."""
        one, two = self.one[:n], self.two[:n]
        slots = np.empty((2, n), dtype=np.int64)
        np.bitwise_and(one * 0x9E3779B1 + two * 0x85EBCA77 >> 13, _FAR - 1, out=slots[0])
        np.bitwise_and(one ^ one >> 16, _NEAR - 1, out=slots[1])
        slots[1] += _FAR
        entries = self.table[slots]
        predicted, held = entries >> 2, entries & 3
        row = (held[0] * 8 + held[1] * 2 + (predicted[0] == predicted[1])) * 3
        return slots, entries, predicted, held, row

    def learn(self, n: int, step: int, slots, entries, predicted, held, cell: np.ndarray, ids: np.ndarray) -> None:
        """From the ids of a step; where lanes meet in a slot, the last one has it."""
        wrong = np.where(held > 0, entries - (held + 1 >> 1), ids << 2)
        self.table[slots] = np.where(predicted == ids, entries + (held < _HELD), wrong)
        self.two[:n] = self.one[:n]
        self.one[:n] = ids
        self.outcomes += 24 * np.bincount(cell, minlength=96).reshape(32, 3)
        if step < _MIXED or step % _MIXED == 0:
            self.mix()
        if step % _RENEWED == 0 or step < _RENEWED and not step & (step - 1):
            for digit in self.digits:
                digit.renew()


def _encode(block: np.ndarray, groups: int) -> bytes:
    c = _Coder(len(block), groups, inverse=False)
    ids = np.zeros(c.lanes * c.steps, dtype=np.int64)
    ids[: len(block)] = block
    ids = np.ascontiguousarray(ids.reshape(c.lanes, c.steps).T)
    low = np.zeros(c.lanes, dtype=np.uint64)
    out = np.zeros((c.steps // 2 + 8, c.lanes), dtype=np.uint64)  # 32 bits each, and a carry
    used = np.zeros(c.lanes, dtype=np.int64)
    shifts: list[tuple[np.ndarray, np.ndarray]] = []

    def carry(lanes: np.ndarray) -> None:
        if len(lanes):
            out[used[lanes] - 1, lanes] += np.uint64(1)

    def settle(n: int) -> None:
        lanes = np.flatnonzero(c.range[:n] < _SHORT)
        if len(lanes):
            at = used[lanes]
            out[at, lanes] = low[lanes] >> _UP
            used[lanes] = at + 1
            low[lanes] <<= _UP
            c.range[lanes] <<= _UP
            shifts.append((at, lanes))

    for step in range(c.steps):
        if step % 64 == 0 and used.max() + 64 * len(c.digits) + 4 > len(out):  # so that two words fit in at the end
            out = np.concatenate([out, np.zeros((max(len(out), 64 * len(c.digits)), c.lanes), dtype=np.uint64)])
        n = c.active(step)
        now = ids[step, :n]
        *known, row = c.predict(n)
        miss = now != known[2]
        outcome = miss[0] * (1 + miss[1].view(np.int8))
        cell = row + outcome
        unit = c.range[:n] >> _MIX_BITS
        below = c.mix_below[cell] * unit
        low[:n] += below
        carry(np.flatnonzero(low[:n] < below))
        np.multiply(c.mix_own[cell], unit, out=c.range[:n])
        lanes = np.flatnonzero(outcome == 2)
        if len(lanes):
            value = now[lanes]
            for k, digit in enumerate(c.digits):
                if k:
                    settle(n)
                symbol = value >> digit.shift & (digit.size - 1)
                unit = c.range[lanes] // digit.total
                below = digit.edges[symbol] * unit
                start = low[lanes] + below
                low[lanes] = start
                carry(lanes[start < below])
                c.range[lanes] = digit.frequency[symbol] * unit
                digit.pending.append(symbol)
        settle(n)
        c.learn(n, step, *known, cell, now)
    every = np.arange(c.lanes)
    out[used, every] = low >> _UP
    out[used + 1, every] = low & _MASK
    for at in range(int(used.max()), 0, -1):
        out[at - 1] += out[at] >> _UP
    # The reader begins with two words of each lane and takes the others when it shifts, two words ahead.
    words = [out[0], out[1], *(out[at + 2, lanes] for at, lanes in shifts)]
    return np.concatenate(words).astype("<u4").tobytes()


def _decode(coded: bytes, count: int, groups: int) -> np.ndarray:
    c = _Coder(count, groups, inverse=True)
    words = np.frombuffer(coded[: len(coded) // 4 * 4], dtype="<u4").astype(np.uint64)
    if len(words) < 2 * c.lanes:
        words = np.concatenate([words, np.zeros(2 * c.lanes - len(words), dtype=np.uint64)])
    code = words[: c.lanes] << _UP | words[c.lanes : 2 * c.lanes]  # above the lower end of the range
    taken = 2 * c.lanes
    ids = np.zeros((c.steps, c.lanes), dtype=np.uint32)

    def settle(n: int) -> None:
        nonlocal taken
        lanes = np.flatnonzero(c.range[:n] < _SHORT)
        if len(lanes):
            new = words[taken : taken + len(lanes)]
            taken += len(lanes)
            if len(new) < len(lanes):  # only in damaged blocks
                new = np.concatenate([new, np.zeros(len(lanes) - len(new), dtype=np.uint64)])
            code[lanes] = code[lanes] << _UP | new
            c.range[lanes] <<= _UP

    for step in range(c.steps):
        n = c.active(step)
        *known, row = c.predict(n)
        unit = c.range[:n] >> _MIX_BITS
        place = code[:n] // unit
        cell = row + (place >= c.mix_below[row + 1])
        cell += place >= c.mix_below[row + 2]
        code[:n] -= c.mix_below[cell] * unit
        np.multiply(c.mix_own[cell], unit, out=c.range[:n])
        outcome = cell - row
        now = np.where(outcome == 0, known[2][0], known[2][1])
        lanes = np.flatnonzero(outcome == 2)
        if len(lanes):
            value = np.zeros(len(lanes), dtype=np.int64)
            for k, digit in enumerate(c.digits):
                if k:
                    settle(n)
                unit = c.range[lanes] // digit.total
                above = code[lanes]
                place = np.minimum(above // unit, digit.total - np.uint64(1)).view(np.int64)
                symbol = digit.symbol_at[place].astype(np.int64)
                code[lanes] = above - digit.edges[symbol] * unit
                c.range[lanes] = digit.frequency[symbol] * unit
                digit.pending.append(symbol)
                value |= symbol << digit.shift
            now[lanes] = value
        settle(n)
        c.learn(n, step, *known, cell, now)
        ids[step, :n] = now
    return np.ascontiguousarray(ids.T).ravel()[:count]


def encode(blocks: list[np.ndarray], groups: int) -> list[bytes]:
    """Each block's ids as bytes. ``groups``: how many groups of four bits an id has."""
    return [_encode(block, groups) if len(block) else b"" for block in blocks]


def decode(coded: list[bytes], counts: np.ndarray, groups: int) -> list[np.ndarray]:
    """The blocks again, given how many ids each has."""
    pairs = zip(coded, np.asarray(counts, dtype=np.int64).tolist())
    return [_decode(data, count, groups) if count else np.zeros(0, np.uint32) for data, count in pairs]


def checksum(ids: np.ndarray) -> int:
    """The unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").data)
