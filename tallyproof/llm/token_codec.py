"""An adaptive context-mixing coder for token ids, many independent blocks side by side.

An id is coded whole, in one step. Its distribution is a mix of three predictions:

- order 0: how often each group of ids has come in the block of late, times the share of the id in its group by the
  frequencies of all ids of the blocks coded together, which are kept beside them as a table;
- order 1: the id that followed the last id when it was seen last;
- order 2: the same after the last two ids.

The weights of the mix depend on how often the foreseen ids have held; every coded id moves the weights towards the
predictions that foresaw it. A foreseen id only adds its weight at its own place in the running sums of order 0, so an
interval is found by comparing with two places, a binary search of the groups and one look into the inverse of a group's
sums. Groups are of about equal weight, frequent ids alone in theirs. (Earlier ids went nibble by nibble, each with a row
of 16 counts learnt in its block.) The intervals
drive a range coder in the form of asymmetric numerals (rANS): 64-bit states, 32 bits out at a time, coded from the last id
to the first and read from the first. Every block starts from the same model, so with the table blocks can be decoded alone.

A block is a lane: position ``t`` of all blocks is coded in one NumPy step. Floating-point arithmetic is element by element,
or on integers below 2**53, hence equal in both directions.
"""

from __future__ import annotations

import zlib

import numpy as np

#: Blocks coded side by side; about 20 KB of model and up to 32 KB of ids and intervals each.
LANES = 3072
_GROUPS = 256  # of equal weight; ids too many for one make further ones
_GROUP_BITS = 12  # of the shares of groups
_IN_GROUP_BITS = 10  # of the shares in a group, at least
_PRIOR = np.float32(100)  # what the frequencies of the table count, against what has come in the block
_EVERY = 32  # positions between two sums of the groups
_FORGET = np.float32(0.92)  # what is left of the counts of groups at each
_RATE = np.float32(0.04)  # of the weights
_RETURN = np.float32(0.002)  # what each update gives back to order 0, which alone foresees every id
_STAY = 1 - _RATE - _RETURN
_LEAST = np.float32(1e-6)  # no weight falls below it, so that it can rise again
_SLOTS_BITS = 11  # foreseen ids of an order in a lane
_LEVELS = 5
_FIRST_STATE = np.uint64(1 << 31)  # states lie in 2**31 .. 2**63 - 1
_WORD = np.uint64(32)


def _first_weights() -> np.ndarray:
    """[level of order 1 * levels + level of order 2, (order 0, 1, 2, unused)]: weights rise with what has held; level 0 is
    an order that foresees nothing."""
    w = np.zeros((_LEVELS, _LEVELS, 4), dtype=np.float32)
    for i, one in enumerate((0, 0.05, 0.3, 1, 2)):
        for j, two in enumerate((0, 0.2, 2, 6, 12)):
            raw = np.array([1, one, two, 0])
            w[i, j] = np.maximum(raw / raw.sum(), _LEAST)
    return w.reshape(-1, 4)


class _Table:
    """The ids and their counts in the blocks coded together. Symbols number the ids, frequent ones first, so that a group is
    a run of symbols; symbol 0 stands for no id. starts and sizes: place in the group, of the sum 2**in_bits."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray):
        self.by_id = ids, counts
        order = np.argsort(-counts, kind="stable")
        counts = counts[order]
        self.ids = np.concatenate(([0], ids[order])).astype(np.uint32)
        n, whole = len(ids), int(counts.sum())
        self.in_bits = max(_IN_GROUP_BITS, (n // 64).bit_length())
        self.weight_bits = 31 - _GROUP_BITS - self.in_bits
        if self.weight_bits < 3:
            raise ValueError("blocks coded together have more than 2**22 different ids")
        piece = (np.cumsum(counts) - counts) * _GROUPS // whole
        place = np.arange(n) - np.searchsorted(piece, piece)
        first = np.flatnonzero(place % (1 << (self.in_bits - 1)) == 0)
        group = np.searchsorted(first, np.arange(n), side="right") - 1
        weight = np.add.reduceat(counts, first)
        many = np.diff(np.append(first, n))
        sizes = 1 + counts * ((1 << self.in_bits) - many)[group] // weight[group]
        sizes[first] += (1 << self.in_bits) - np.add.reduceat(sizes, first)
        self.prior = (weight / whole).astype(np.float32) * _PRIOR
        self.inverse = np.repeat(np.arange(1, n + 1, dtype=np.int32), sizes)
        starts = np.cumsum(sizes) - sizes - (group << self.in_bits)
        self.group = np.concatenate(([0], group))
        self.spans = np.concatenate(([0], starts + 1j * sizes))  # start and size as one value of 16 bytes
        self.ends = np.concatenate(([0.0], starts + sizes))

    @classmethod
    def of(cls, blocks: list[np.ndarray]) -> _Table:
        values = np.concatenate(blocks)
        if values.max() >= 1 << 22:
            ids, counts = (x.astype(np.int64) for x in np.unique(values, return_counts=True))
        else:
            counts = np.bincount(values)
            ids = np.flatnonzero(counts)
            counts = counts[ids]
        return cls(ids, _count(_code(counts)))

    def symbols(self, blocks: list[np.ndarray]) -> list[np.ndarray]:
        most = int(self.ids.max())
        if most >= 1 << 22:
            order = np.argsort(self.ids[1:], kind="stable")
            return [order[np.searchsorted(self.ids[1:][order], b)] + 1 for b in blocks]
        numbers = np.zeros(most + 1, dtype=np.int32)
        numbers[self.ids[1:]] = np.arange(1, len(self.ids), dtype=np.int32)
        return [numbers[b] for b in blocks]

    def payload(self) -> bytes:
        """Steps between ids, byte by byte of like weight, and the counts' codes, deflated."""
        ids, counts = self.by_id
        steps = np.diff(ids, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
        steps = zlib.compress(steps, 9, -15)
        codes = zlib.compressobj(9, zlib.DEFLATED, -15, 9, zlib.Z_HUFFMAN_ONLY)
        return len(steps).to_bytes(4, "little") + steps + codes.compress(_code(counts).tobytes()) + codes.flush()

    @classmethod
    def read(cls, payload: bytes) -> _Table:
        to = 4 + int.from_bytes(payload[:4], "little")
        steps, codes = (np.frombuffer(zlib.decompress(x, -15), dtype=np.uint8) for x in (payload[4:to], payload[to:]))
        return cls(np.cumsum(np.ascontiguousarray(steps.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)), _count(codes))


def _code(counts: np.ndarray) -> np.ndarray:
    """Counts (from 1) by their two highest bits, in a byte."""
    shift = np.maximum(np.frexp(counts.astype(np.float64))[1] - 2, 0)
    return (2 * shift + (counts >> shift)).astype(np.uint8)


def _count(codes: np.ndarray) -> np.ndarray:
    """The middle of the counts that a code stands for."""
    shift = np.maximum((codes.astype(np.int64) - 2) >> 1, 0)
    return ((codes - 2 * shift) << shift) + ((1 << shift) >> 1)


class _Model:
    """Predictions and weights of all lanes."""

    def __init__(self, lanes: int, table: _Table):
        self.table = table
        first = _first_weights()
        self.weights = np.broadcast_to(first, (lanes, *first.shape)).copy().view(np.complex128).ravel()  # four floats each
        lane = np.arange(lanes, dtype=np.int64)
        self.lane_sets, self.lane_slots = lane * len(first), lane << _SLOTS_BITS
        # What each context foresees: symbol * 8 + level; 0 for nothing.
        self.guess = [np.zeros(lanes << _SLOTS_BITS, dtype=np.int32) for _ in (1, 2)]
        self.groups = len(table.prior)
        self.steps = [1 << b for b in range((self.groups - 1).bit_length() - 1, -1, -1)]
        self.width = (1 << len(self.steps)) + 1
        self.lane_counts, self.lane_sums = lane * self.groups, lane * self.width
        self.counts = np.zeros((lanes, self.groups), dtype=np.float32)
        self.sums = np.full((lanes, self.width), 1 << _GROUP_BITS, dtype=np.float64)
        self.one, self.part = float(1 << table.weight_bits), float(1 << (_GROUP_BITS + table.in_bits))
        self.all, self.in_group = self.one * self.part, float(1 << table.in_bits)

    def sum_groups(self, n: int) -> None:
        """Running sums of the groups' shares in the first n lanes; every group keeps one part at least."""
        self.counts[:n] *= _FORGET
        sums = np.cumsum(self.counts[:n] + self.table.prior, axis=1)
        sums *= (((1 << _GROUP_BITS) - self.groups) / sums[:, -1])[:, None]
        np.floor(sums, out=sums)
        self.sums[:n, 0] = 0
        self.sums[:n, 1 : self.groups] = sums[:, :-1] + np.arange(1, self.groups, dtype=np.float32)

    def order0(self, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and size of the interval of a symbol in the first lanes, as floats holding integers of the sum ``part``."""
        at = self.lane_sums[: len(symbol)] + self.table.group.take(symbol)
        below = self.sums.take(at)
        share = self.sums.take(at + 1) - below
        span = self.table.spans.take(symbol)
        return below * self.in_group + share * span.real, share * span.imag

    def end0(self, symbol: np.ndarray) -> np.ndarray:
        """End of the interval of a symbol in the first lanes."""
        at = self.lane_sums[: len(symbol)] + self.table.group.take(symbol)
        below = self.sums.take(at)
        return below * self.in_group + (self.sums.take(at + 1) - below) * self.table.ends.take(symbol)

    def find(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The symbols at places of order 0, with start and size of their intervals."""
        lanes = self.lane_sums[: len(place)]
        base, top = lanes.copy(), np.floor(place / self.in_group)
        for step in self.steps:
            base += step * (self.sums.take(base + step) <= top)
        below = self.sums.take(base)
        share = self.sums.take(base + 1) - below
        start = below * self.in_group
        within = ((place - start) / share).astype(np.int64)
        symbol = self.table.inverse.take(((base - lanes) << self.table.in_bits) + within, mode="clip").astype(np.int64)
        span = self.table.spans.take(symbol)
        return symbol, start + share * span.real, share * span.imag

    def mix(self, before: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
        """For the first lanes, by their last symbol and the one before: what order 1 and 2 foresee, how often order 0 counts
        in the sums, and the weights added at the foreseen symbols, the last three as floats holding integers."""
        n, mask = len(last), (1 << _SLOTS_BITS) - 1
        lanes = self.lane_slots[:n]
        self.slot1 = lanes + (((last * 0x27D4EB2F) >> 9) & mask)
        self.slot2 = lanes + (((before * 0x2F0B4C47 + last * 0x1B56C4E9) >> 7) & mask)
        self.held1, self.held2 = self.guess[0].take(self.slot1), self.guess[1].take(self.slot2)
        self.level1, self.level2 = self.held1 & 7, self.held2 & 7
        self.g1, self.g2 = self.held1 >> 3, self.held2 >> 3
        self.sets = self.lane_sets[:n] + (self.level1 * _LEVELS + self.level2)
        self.w = w = self.weights.take(self.sets).view(np.float32).reshape(n, 4)
        times = np.floor(w[:, 0] * np.float32(self.one) + np.float32(0.5)).astype(np.float64)
        np.clip(times, 1, self.one, out=times)
        rest = self.all - times * self.part
        add1 = np.floor(rest * (w[:, 1] / (w[:, 1] + w[:, 2])))
        return self.g1, self.g2, times, add1, rest - add1

    def learn(self, symbol: np.ndarray, size0: np.ndarray) -> None:
        """Move the weights, count the group, and remember the symbol that followed each context. size0: of order 0."""
        self.counts.ravel()[self.lane_counts[: len(symbol)] + self.table.group.take(symbol)] += 1
        w = self.w
        w0, w1, w2 = w[:, 0], w[:, 1], w[:, 2]
        hit1, hit2 = self.g1 == symbol, self.g2 == symbol
        p0, p1, p2 = (size0 / self.part).astype(np.float32), hit1.view(np.uint8), hit2.view(np.uint8)
        rate = _RATE / (w0 * p0 + w1 * p1 + w2 * p2)
        w[:, 0] = w0 * (_STAY + rate * p0) + _RETURN
        w[:, 1] = np.maximum(w1 * (_STAY + rate * p1), _LEAST)
        w[:, 2] = np.maximum(w2 * (_STAY + rate * p2), _LEAST)
        self.weights[self.sets] = w.view(np.complex128).ravel()
        new = symbol.astype(np.int32) * 8 + 1
        # A miss takes a level away first from what has held.
        for guess, slot, held, level, hit in ((self.guess[0], self.slot1, self.held1, self.level1, hit1), (self.guess[1], self.slot2, self.held2, self.level2, hit2)):
            guess[slot] = np.where(hit, held + (level < _LEVELS - 1), np.where(level > 1, held - 1, new))


def _encode(lengths: np.ndarray, grid: np.ndarray, table: _Table) -> list[bytes]:
    """lengths do not rise; grid: symbols by [position, lane]."""
    lanes, most = len(lengths), len(grid)
    model = _Model(lanes, table)
    before, last = np.zeros(lanes, dtype=np.int64), np.zeros(lanes, dtype=np.int64)
    starts, sizes = np.empty((most, lanes), dtype=np.uint32), np.empty((most, lanes), dtype=np.uint32)
    longer = np.searchsorted(-lengths, -np.arange(most), side="left")  # lanes longer than each position
    for t, n in enumerate(longer.tolist()):
        if t % _EVERY == 0:
            model.sum_groups(n)
        symbol = grid[t, :n].astype(np.int64)
        g1, g2, times, add1, add2 = model.mix(before[:n], last[:n])
        start0, size0 = model.order0(symbol)
        starts[t, :n] = times * start0 + add1 * (g1 < symbol) + add2 * (g2 < symbol)
        sizes[t, :n] = times * size0 + add1 * (g1 == symbol) + add2 * (g2 == symbol)
        model.learn(symbol, size0)
        before[:n], last[:n] = last[:n], symbol
    del model
    total_bits = 31
    shift, room = np.uint64(total_bits), np.uint64(63 - total_bits)
    state = np.full(lanes, _FIRST_STATE, dtype=np.uint64)
    # A step gives out one word at most, and a word holds 32 bits of what is coded: its place is counted from the end.
    capacity = most * total_bits // 32 + 2
    words, at = np.empty((lanes, capacity), dtype="<u4"), np.full(lanes, capacity, dtype=np.int64)
    for t in range(most - 1, -1, -1):
        n = int(longer[t])
        x, size = state[:n], sizes[t, :n].astype(np.uint64)
        full = np.flatnonzero(x >= size << room)
        if len(full):
            at[full] -= 1
            words[full, at[full]] = x[full]  # the lower half
            x[full] >>= _WORD
        whole = x // size
        x += (whole << shift) - whole * size
        x += starts[t, :n]
    return [s.tobytes() + words[k, a:].tobytes() if m else b"" for k, (s, a, m) in enumerate(zip(state.astype("<u8"), at.tolist(), lengths.tolist()))]


def _decode(lengths: np.ndarray, payloads: list[bytes], table: _Table) -> np.ndarray:
    """ids: [position, lane]; lengths do not rise."""
    lanes, most = len(lengths), int(lengths.max(initial=0))
    model = _Model(lanes, table)
    total_bits = 31
    shift, mask = np.uint64(total_bits), np.uint64((1 << total_bits) - 1)
    data = np.frombuffer(b"".join(p or bytes(8) for p in payloads), dtype="<u4")
    at = np.cumsum([0, *(max(len(p), 8) // 4 for p in payloads)])[:-1]
    state = data[at].astype(np.uint64) | data[at + 1].astype(np.uint64) << _WORD
    at += 2
    out = np.zeros((most, lanes), dtype=np.uint32)
    before, last = np.zeros(lanes, dtype=np.int64), np.zeros(lanes, dtype=np.int64)
    for t, n in enumerate(np.searchsorted(-lengths, -np.arange(most), side="left").tolist()):
        if t % _EVERY == 0:
            model.sum_groups(n)
        g1, g2, times, add1, add2 = model.mix(before[:n], last[:n])
        x = state[:n]
        target = (x & mask).astype(np.float64)
        # What a foreseen symbol is given on top stands behind its interval of order 0.
        end1, end2 = model.end0(g1), model.end0(g2)
        from1, from2 = end1 * times + add2 * (g2 < g1), end2 * times + add1 * (g1 <= g2)
        past1, past2 = target >= from1 + add1, target >= from2 + add2
        # Quotients are below 2**31 and divisors below 2**13, so that rounding cannot reach the next integer.
        place = np.floor((target - add1 * past1 - add2 * past2) / times)
        place = np.where((target >= from1) & ~past1, end1 - 1, np.where((target >= from2) & ~past2, end2 - 1, place))
        symbol, start0, size0 = model.find(np.clip(place, 0, model.part - 1))
        start = times * start0 + add1 * (g1 < symbol) + add2 * (g2 < symbol)
        size = times * size0 + add1 * (g1 == symbol) + add2 * (g2 == symbol)
        x >>= shift
        x *= size.astype(np.uint64)
        x += (target - start).astype(np.uint64)
        empty = np.flatnonzero(x < _FIRST_STATE)
        if len(empty):
            x[empty] = x[empty] << _WORD | data.take(at[empty], mode="clip")
            at[empty] += 1
        model.learn(symbol, size0)
        out[t, :n] = table.ids.take(symbol)
        before[:n], last[:n] = last[:n], symbol
    return out


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """One payload for each block of ids (non-negative, below 2**31), in the order given, and after them the table of order 0
    that all of them were coded with. At most LANES blocks are in memory as models at a time."""
    lengths = np.array([len(b) for b in blocks], dtype=np.int64)
    if not lengths.any():
        return [b""] * (len(blocks) + 1)
    table = _Table.of([np.asarray(b) for b in blocks if len(b)])
    order = np.argsort(-lengths, kind="stable")
    out: list[bytes] = [b""] * len(blocks)
    for some in (order[a : a + LANES] for a in range(0, len(order), LANES)):
        grid = np.zeros((int(lengths[some[0]]), len(some)), dtype=np.int32)
        held = [i for i in some if lengths[i]]
        for k, symbols in enumerate(table.symbols([blocks[i] for i in held])):
            grid[: len(symbols), k] = symbols
        for i, payload in zip(some, _encode(lengths[some], grid, table)):
            out[i] = payload
    return [*out, table.payload()]


def decode_blocks(payloads: list[bytes], lengths: np.ndarray) -> list[np.ndarray]:
    """The ids of each block, in the order given; the last payload is the table. Any of the blocks may be left out."""
    lengths = np.asarray(lengths, dtype=np.int64)
    out: list[np.ndarray] = [np.zeros(0, dtype=np.uint32)] * len(lengths)
    if not lengths.any():
        return out
    table = _Table.read(payloads[-1])
    order = np.argsort(-lengths, kind="stable")
    for some in (order[a : a + LANES] for a in range(0, len(order), LANES)):
        grid = _decode(lengths[some], [payloads[i] for i in some], table)
        for k, i in enumerate(some):
            out[i] = np.ascontiguousarray(grid[: lengths[i], k])
    return out
