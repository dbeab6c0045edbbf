"""Adaptive context-mixing range coder for token ids.

A block of ids is coded id by id. Three contexts predict the next id: order 0
(how often each id has come in the block), order 1 (what followed the last id)
and order 2 (what followed the last two). Orders 1 and 2 each remember one id
and a confidence. The weights that mix the three are learned in the block, for
each pair of confidences: how often order 2's id came true, and where it did
not, how often order 1's did. Of the coder's total, order 2's id gets the first
weight, order 1's id the second, and the rest, which is never empty, is spread
over all ids by order 0. An id is coded by one step of a range coder: 48 bits,
16 put out at a time, carries added when a block ends.

Blocks start anew and know nothing of each other, so many are coded side by
side: every state variable is an array with one lane a block, and one numpy
operation moves all lanes by one id. The order-0 sums are made anew at fixed
positions (REBUILT), at the same ones on both sides.

Ids are numbers below ``size``; the caller maps its ids to a dense alphabet.
"""

from __future__ import annotations

import numpy as np

TOTAL_BITS = 24
TOTAL = 1 << TOTAL_BITS
#: Of TOTAL, orders 1 and 2 get at most 65536 of these; the rest exceeds order 0's sum of counts.
PART = 240
#: An id that came adds as much to its count; every id of the alphabet starts at 1.
GAIN = 32
#: Ids of a block at most. With GAIN and LARGEST_ALPHABET: the counts stay below TOTAL - 65536 * PART.
BLOCK = 8192
LARGEST_ALPHABET = 1 << 19
REBUILT = frozenset([*(1 << k for k in range(5, 11)), *range(2048, BLOCK, 1024)])
HASH_BITS = 12
#: A weight moves by this power of two towards what came true.
PACE = 5
#: What a hit (16 to 31) or a miss (0 to 15) adds to a confidence.
_STEP = np.array([(c >> 1) - c for c in range(16)] + [int(c < 15) for c in range(16)], np.int64)
_WHOLE, _NARROW, _LOW = np.uint64(1 << 48), np.uint64(1 << 32), np.uint64((1 << 32) - 1)
_16, _32, _TOTAL_BITS = np.uint64(16), np.uint64(32), np.uint64(TOTAL_BITS)


class _Lanes:
    """The models of ``lanes`` blocks, and their intervals' widths."""

    def __init__(self, lanes: int, size: int):
        if size > LARGEST_ALPHABET:
            raise ValueError(f"an alphabet of {size} ids is larger than {LARGEST_ALPHABET}")
        self.size, self.step = size, 0
        lane = np.arange(lanes)
        self.base = lane * (size + GAIN * BLOCK + 1)  # makes the sums of all lanes one ascending array
        self.counts = np.ones((lanes, size), np.int32)
        self.sums = np.empty((lanes, size + 1), np.int64)
        self.flat_counts, self.flat_sums = self.counts.reshape(-1), self.sums.reshape(-1)
        self.of_one = np.zeros(lanes * size, np.int64)  # id << 4 | confidence
        self.of_two = np.zeros(lanes << HASH_BITS, np.int64)
        sure = np.arange(16)
        start = np.where(sure > 0, (sure << 16) // (sure + 3), 0)
        self.weights = np.tile((start[:, None] << 16 | start[None, :]).reshape(-1), lanes)  # order 2's << 16 | order 1's
        self.at_count, self.at_sum = lane * size, lane * (size + 1)
        self.at_hash, self.at_weight = lane << HASH_BITS, lane << 8
        self.last, self.before = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.width = np.full(lanes, _WHOLE)
        self.rebuild()

    def rebuild(self) -> None:
        n = len(self.base)
        self.sums[:n, 0] = self.base
        np.cumsum(self.counts[:n], axis=1, out=self.sums[:n, 1:])
        self.sums[:n, 1:] += self.base[:, None]
        self.total = self.size + GAIN * self.step

    def keep(self, n: int) -> None:
        """Go on with the first ``n`` lanes."""
        self.flat_sums = self.flat_sums[:n * (self.size + 1)]
        for name in ("base", "at_count", "at_sum", "at_hash", "at_weight", "last", "before", "width"):
            setattr(self, name, getattr(self, name)[:n])

    def predict(self) -> None:
        """What orders 1 and 2 predict, and what each order gets of TOTAL."""
        self.one = self.at_count + self.last
        self.two = self.at_hash + ((self.last * 40503 + self.before * 30011 >> 3) & ((1 << HASH_BITS) - 1))
        self.said_one, self.said_two = self.of_one.take(self.one), self.of_two.take(self.two)
        self.sure_one, self.sure_two = self.said_one & 15, self.said_two & 15
        self.weight = self.at_weight + (self.sure_two << 4) + self.sure_one
        both = self.weights.take(self.weight)
        self.p_two, self.p_one = both >> 16, both & 65535
        self.share_two = self.p_two * PART
        self.share_one = ((65536 - self.p_two) * self.p_one >> 16) * PART
        self.mixed = self.share_two + self.share_one
        self.share_zero = TOTAL - self.mixed
        self.unit = self.width >> _TOTAL_BITS

    def narrow(self, ids: np.ndarray) -> np.ndarray:
        """Learn ``ids`` and take their part of each interval: what lies before it."""
        mark = ids << 4
        hit_one, hit_two = (self.said_one ^ mark) < 16, (self.said_two ^ mark) < 16
        at = self.at_sum + ids
        begin = (self.flat_sums.take(at) - self.base) * self.share_zero // self.total
        at += 1
        length = (self.flat_sums.take(at) - self.base) * self.share_zero // self.total
        length -= begin
        begin += self.mixed
        as_one, as_two = hit_one & (self.share_one > 0), hit_two & (self.share_two > 0)
        np.copyto(begin, self.share_two, where=as_one)
        np.copyto(length, self.share_one, where=as_one)
        np.copyto(length, self.share_two, where=as_two)
        begin[as_two] = 0
        before = self.unit * begin.view(np.uint64)
        np.multiply(self.unit, length.view(np.uint64), out=self.width)

        mark |= 1
        for table, at, said, sure, hit in ((self.of_one, self.one, self.said_one, self.sure_one, hit_one),
                                           (self.of_two, self.two, self.said_two, self.sure_two, hit_two)):
            said += _STEP.take((hit << 4) + sure)
            np.copyto(said, mark, where=(sure < 2) > hit)
            table[at] = said
        two = self.p_two + (hit_two * 65535 - self.p_two >> PACE)
        one = self.p_one + (hit_one * 65535 - self.p_one >> PACE)
        np.copyto(one, self.p_one, where=hit_two)
        self.weights[self.weight] = (two << 16) + one
        self.flat_counts[self.at_count + ids] += GAIN
        self.last, self.before = ids, self.last
        self.step += 1
        if self.step in REBUILT:
            self.rebuild()
        return before

    def find(self, value: np.ndarray) -> np.ndarray:
        """The ids in whose part of TOTAL ``value`` lies."""
        ids = self.said_one >> 4
        np.copyto(ids, self.said_two >> 4, where=value < self.share_two)
        # Order 0: the last id x with floor(sum(x) * share / total) <= rest.
        at = np.flatnonzero(value >= self.mixed)
        rest = value.take(at) - self.mixed.take(at) + 1
        most = (rest * self.total - 1) // self.share_zero.take(at) + self.base.take(at)
        ids[at] = self.flat_sums.searchsorted(most, side="right") - 1 - self.at_sum.take(at)
        return ids

    def narrowed(self):
        """Lanes whose interval has become too narrow, until there are none; the widths grow by 16 bits."""
        at = np.flatnonzero(self.width < _NARROW)
        while at.size:
            yield at
            grown = self.width[at] << _16
            self.width[at] = grown
            at = at[grown < _NARROW]


def _carried(words: np.ndarray) -> np.ndarray:
    """Words of 16 bits from words with a carry above them, a row for each block."""
    out, carry = np.zeros(words.shape, "<u2"), np.zeros(len(words), np.uint32)
    for k in range(words.shape[1] - 1, -1, -1):
        carry = words[:, k] + carry
        out[:, k] = carry & 0xFFFF
        carry >>= 16
    return out


def encode(blocks: list[np.ndarray], size: int) -> list[bytes]:
    """The coded bytes of each block; every block but the last has as many ids as the first."""
    n = every = len(blocks)
    if not n:
        return []
    long, short = len(blocks[0]), len(blocks[-1])
    ids = np.zeros((long, n), np.int64)
    for k, block in enumerate(blocks):
        ids[:len(block), k] = block
    lanes, low_all = _Lanes(n, size), np.zeros(n, np.uint64)
    out, ends_all = np.zeros((n, 2 * long + 8), np.uint32), np.zeros(n, np.int64)
    low, ends = low_all, ends_all

    def put(at: np.ndarray) -> None:
        out[at, ends_all[at]] = low_all[at] >> _32
        ends_all[at] += 1
        low_all[at] = (low_all[at] & _LOW) << _16

    def finish(at: np.ndarray) -> None:
        for _ in range(3):
            put(at)

    for step in range(long):
        if step == short and n == every:
            n -= 1
            finish(np.array([n]))
            lanes.keep(n)
            low, ends = low_all[:n], ends_all[:n]
            if not n:
                break
        lanes.predict()
        low += lanes.narrow(ids[step, :n])
        for at in lanes.narrowed():
            put(at)
    finish(np.arange(n))
    words = _carried(out[:, :ends_all.max()])
    return [words[k, :ends_all[k]].tobytes() for k in range(every)]


def decode(coded: list[bytes], lengths: list[int], size: int) -> list[np.ndarray]:
    """The ids of each block; ``lengths`` as given to ``encode``."""
    n = every = len(coded)
    if not n:
        return []
    words = [np.frombuffer(c, "<u2") for c in coded]
    if min(map(len, words)) < 3:
        raise ValueError("a block of ids is cut off")
    source = np.zeros((n, max(map(len, words)) + 1), np.uint64)
    for k, w in enumerate(words):
        source[k, :len(w)] = w
    long, short, last = lengths[0], lengths[-1], source.shape[1] - 1
    ids, lanes = np.zeros((long, n), np.int64), _Lanes(n, size)
    code, ends = source[:, 0] << _32 | source[:, 1] << _16 | source[:, 2], np.full(n, 3, np.int64)
    for step in range(long):
        if step == short and n == every:
            n -= 1
            lanes.keep(n)
            code, ends = code[:n], ends[:n]
            if not n:
                break
        lanes.predict()
        x = lanes.find(np.minimum(code // lanes.unit, np.uint64(TOTAL - 1)).view(np.int64))
        code -= lanes.narrow(x)
        for at in lanes.narrowed():
            code[at] = code[at] << _16 | source[at, np.minimum(ends[at], last)]
            ends[at] += 1
        ids[step, :n] = x
    return [ids[:m, k] for k, m in enumerate(lengths)]
