"""An adaptive context-mixing range coder for token ids, in independently reset, checksummed blocks.

A block's ids are dealt over lanes, which are coded abreast: one row of all lanes is one numpy step. Pairs of ids that
followed each other are numbered as they appear, so a number is the context of order 2. Three orders predict an id:

* order 2: after each pair, a candidate for the next one and how often it held (with two or four candidates blocks of
  documents came out as large);
* order 1: after each id, the frequencies of all ids that followed it;
* order 0: the frequencies of all ids as ends of different pairs.

How much of the coding interval the candidate, order 1 and order 0 get is mixed from what happened so far under the same
confidence and the same richness of the contexts. What the candidate takes is excluded from order 1. Candidates and the
mix learn after every few rows, the tables of frequencies whenever the history has grown by half. All models start
empty in each block and learn from rows already coded, so the decoder follows the encoder.

A block: magic, number of ids, lanes, CRC-32 of the ids, CRC-32 of the payload, payload. The payload: how many words of
16 bits each lane has, then the words of one lane after another.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC, HEAD = b"PRC3", struct.Struct("<4sIIII")
LANES, ROWS = 4096, 1024  # most lanes; fewest rows aimed at
IDS = 1 << 16
BITS0, BITS = 19, 16  # of the totals for order 0 and for the mix
STEP, GROWTH = 16, 1.5  # rows learnt at once; growth of the history between two tables of frequencies
KINDS, RICH = 3, 32  # candidate, order 1, order 0
U = np.uint64
MOST, RENORM = U((1 << 64) - 1), U(1 << 48)
LOW = 23  # bits of a size or total of order 1, below a start in one number
_SIZE = (1 << LOW) - 1
_ABREAST = 64  # lanes that are turned at once
_POWERS = 1 << np.arange(32)
_SPREAD = U(0x9E3779B97F4A7C15)


class _Models:
    """Numbered pairs with counts and candidates, tables of frequencies, and the mix. Pair 0 is none."""

    def __init__(self, n: int) -> None:
        self.bits = 12
        self.slots = np.zeros(1 << self.bits, np.int32)
        self.key, self.id = np.zeros(n + 1, np.uint32), np.zeros(n + 1, np.int32)
        self.count, self.span = np.zeros(n + 1, np.int32), np.zeros(n + 1, np.int64)  # span: start << LOW | size
        self.after = np.zeros(n + 1, np.int32)  # candidate << 3 | confidence
        self.pairs, self.seen, self.next_table = 1, 0, 0
        self.count0, self.fresh = np.zeros(IDS, np.int64), []
        self.mix = np.tile(np.array([2, 2, 1], np.int64), (8 * RICH, 1))
        self.rich, self.total, self.bases = (np.zeros(IDS, np.int64) for _ in range(3))  # bases: base << LOW | total
        self._tables()
        self._mixed()

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(U) * _SPREAD) >> U(64 - self.bits)).astype(np.int64)

    def find(self, key: np.ndarray) -> np.ndarray:
        """The numbers of pairs, 0 for unknown ones."""
        slot = self._slot(key)
        out = self.slots.take(slot).astype(np.int64)
        left = np.flatnonzero((self.key.take(out) != key) & (out > 0))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            at = self.slots.take(slot[left])
            out[left] = at
            left = left[(self.key.take(at) != key[left]) & (at > 0)]
        return out

    def insert(self, key: np.ndarray) -> None:
        """Numbers distinct unknown pairs in their order."""
        number = np.arange(self.pairs, self.pairs + len(key), dtype=np.int32)
        self.key[number], self.id[number] = key, (key & np.uint32(IDS - 1)).astype(np.int32)
        self.pairs += len(key)
        if 4 * self.pairs > len(self.slots):  # a table twice as large, or more, with all pairs anew
            self.bits = (8 * self.pairs).bit_length()
            self.slots = np.zeros(1 << self.bits, np.int32)
            number, key = np.arange(1, self.pairs, dtype=np.int32), self.key[1 : self.pairs]
        slot, left = self._slot(key), np.arange(len(key))
        while len(left):
            at = slot[left]
            empty = self.slots.take(at) == 0
            self.slots[at[empty]] = number[left[empty]]
            left = left[self.slots.take(at) != number[left]]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _tables(self) -> None:
        """Frequencies of both orders from all that was learnt."""
        n = self.pairs
        if self.fresh:
            self.count[:n] += np.bincount(np.concatenate(self.fresh), minlength=n)
            self.fresh = []
            self.order = np.argsort(self.key[1:n]) + 1
            key = self.key[self.order]
            context, self.sizes = (key >> np.uint32(16)).astype(np.int64), self.count[self.order].astype(np.int64)
            kinds = np.bincount(context, minlength=IDS)
            ends = np.cumsum(kinds)

            def summed() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                upto = np.concatenate([[0], np.cumsum(self.sizes)])
                return upto[:-1], upto[ends - kinds], upto[ends] - upto[ends - kinds]

            upto, base, total = summed()
            if total.max() >= 1 << 22:  # totals stay small against the coding interval
                self.sizes = np.maximum(self.sizes >> np.searchsorted(_POWERS, total >> 21, side="right")[context], 1)
                upto, base, total = summed()
            self.total, self.bases = total, base << LOW | total
            self.span[self.order] = (upto - base[context]) << LOW | self.sizes
            self.count0 = np.bincount(key & np.uint32(IDS - 1), minlength=IDS)
            often = (np.searchsorted(_POWERS[:16], self.total + 1, side="right") - 1) // 2
            self.rich = often * 4 + sum(self.total + 1 >= x * (kinds + 1) for x in (2, 4, 8))
        size = self.count0 * ((1 << BITS0) - IDS) // max(1, int(self.count0.sum())) + 1
        self.start0, self.size0 = np.cumsum(size) - size, size
        self.inverse0: np.ndarray | None = None  # made by inverses(), as a decoder alone needs them
        self.next_table = int(self.seen * GROWTH)

    def inverses(self) -> None:
        """The id of order 0, and the pair of order 1, at each number of the cumulated frequencies."""
        if self.inverse0 is None:
            self.inverse0 = np.full(1 << BITS0, IDS - 1, np.int32)
            self.inverse0[: int(self.size0.sum())] = np.repeat(np.arange(IDS, dtype=np.int32), self.size0)
            if self.pairs > 1:
                self.inverse1 = np.repeat(self.order.astype(np.int32), self.sizes)
                self.last = len(self.inverse1) - 1

    def _mixed(self) -> None:
        part = self.mix * ((1 << BITS) - KINDS) // self.mix.sum(axis=1, keepdims=True) + 1
        part[:, -1] = (1 << BITS) - part[:, :-1].sum(axis=1)
        start = np.cumsum(part, axis=1) - part
        self.part, self.bound = part.ravel().astype(U), start.ravel().astype(U)

    def look(self, last: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The candidate, and KINDS times the cell of the mix, after the ids `last`, each the end of a pair."""
        a = self.after.take(pair).astype(np.int64)
        return a >> 3, ((a & 7) * RICH + self.rich.take(last)) * KINDS

    def learn(self, last: np.ndarray, before: np.ndarray, ids: np.ndarray, pair: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        """Rows of ids with the ids before them; `before`: pairs of the row above; pair: of those not coded by order 0.

        Returns the pairs of the last row. Where a context stands more than once, its last update stands.
        """
        self.mix += np.bincount(chosen.ravel(), minlength=self.mix.size).reshape(self.mix.shape)
        shape, pair = pair.shape, pair.flatten()
        left = np.flatnonzero(pair == 0)
        if len(left):
            key = (last.ravel()[left].astype(np.uint32) << np.uint32(16)) | ids.ravel()[left].astype(np.uint32)
            found = self.find(key)
            new = np.sort(key[found == 0])
            if len(new):
                self.insert(new[np.concatenate([[True], new[1:] != new[:-1]])])
                found[found == 0] = self.find(key[found == 0])
            pair[left] = found
        j, pair, short = pair, pair.reshape(shape), pair.astype(np.int32)
        above = np.concatenate([before[None, : shape[1]], pair[:-1]]).ravel()
        a = self.after.take(above)
        sure = a & 7
        missed = np.where(sure < 2, short << 3 | 1, a - (sure >> 1))
        self.after[above] = np.where(a >> 3 == short, a + (sure < 7), missed)
        self.after[0] = 0
        self.fresh.append(j)
        self.seen += len(j)
        if self.seen >= self.next_table:
            self._tables()
        self._mixed()
        return pair[-1]


def _shape(n: int) -> tuple[int, int, int]:
    """Lanes, rows, and how many lanes have an id in the last row."""
    lanes = max(1, min(LANES, n // ROWS))
    rows = -(-n // lanes)
    return lanes, rows, n - (rows - 1) * lanes


def _steps(rows: int, lanes: int, long: int) -> list[tuple[int, int, int]]:
    """First row, rows and lanes of what is learnt at once: few rows at first; a shorter last row by itself."""
    out, t, whole = [], 0, rows if long == lanes else rows - 1
    while t < whole:
        n = min(STEP, max(1, t // 2), whole - t)
        out.append((t, n, lanes))
        t += n
    return out if whole == rows else [*out, (rows - 1, 1, long)]


def _abreast(ids: np.ndarray, lanes: int, rows: int, long: int) -> np.ndarray:
    """ids as rows of lanes: the first `long` lanes hold `rows` ids in a row, the others one less."""
    out = np.zeros((rows, lanes), ids.dtype)
    whole, less = ids[: long * rows].reshape(long, rows), ids[long * rows :].reshape(lanes - long, rows - 1)
    for a in range(0, lanes, _ABREAST):
        b = min(a + _ABREAST, long)
        out[:, a:b] = whole[a:b].T
        a, b = max(a, long), a + _ABREAST
        out[:-1, a:b] = less[a - long : max(b - long, 0)].T
    return out


def _in_line(table: np.ndarray, long: int) -> np.ndarray:
    """The inverse of _abreast()."""
    rows, lanes = table.shape
    out = np.empty(long * rows + (lanes - long) * (rows - 1), table.dtype)
    whole, less = out[: long * rows].reshape(long, rows), out[long * rows :].reshape(lanes - long, rows - 1)
    for a in range(0, lanes, _ABREAST):
        b = min(a + _ABREAST, long)
        whole[a:b] = table[:, a:b].T
        a, b = max(a, long), a + _ABREAST
        less[a - long : max(b - long, 0)] = table[:-1, a:b].T
    return out


def encode(ids: np.ndarray) -> bytes:
    """A block of ids below 65536; raises ValueError for others."""
    n = len(ids)
    if not n:
        return HEAD.pack(MAGIC, 0, 0, 0, 0)
    if int(ids.max()) >= IDS or int(ids.min()) < 0:
        raise ValueError(f"ids must lie in 0 to {IDS - 1}")
    lanes, rows, long = _shape(n)
    ids = ids.astype(np.int32)
    table, m = _abreast(ids, lanes, rows, long), _Models(n)
    out, at, every = np.zeros((3 * rows + 2, lanes), np.uint32), np.zeros(lanes, np.int64), np.arange(lanes)
    low, width = np.zeros(lanes, U), np.full(lanes, MOST)
    last, before = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    for t, height, k in _steps(rows, lanes, long):
        x = table[t : t + height, :k].astype(np.int64)
        prev = np.concatenate([last[None, :k], x[:-1]])
        pair = m.find((prev.astype(np.uint32) << np.uint32(16) | x.astype(np.uint32)).ravel()).reshape(x.shape)
        span = m.span.take(pair)
        own = span & _SIZE
        known = own > 0  # a pair that order 0 codes has no number until it is learnt
        above = np.concatenate([before[None, :k], np.where(known, pair, 0)[:-1]])
        state = m.after.take(above)
        row, lane = np.nonzero(~known[:-1] & (pair[:-1] > 0))  # the candidate alone may code these
        ends = np.searchsorted(row, np.arange(height))
        for i in range(height - 1):
            some = lane[ends[i] : ends[i + 1]]
            some = some[pair[i, some] == state[i, some] >> 3]
            state[i + 1, some] = m.after.take(pair[i, some])
        a = state >> 3
        held = (pair == a) & (pair > 0)
        kind = np.where(held, 0, 2 - known)
        chosen = ((state & 7) * RICH + m.rich.take(prev)) * KINDS + kind
        zero, left = kind == 2, m.span.take(a)
        taken, mine = left & _SIZE, span >> LOW
        begin, size, total = mine - taken * (left >> LOW < mine), own, m.total.take(prev) - taken
        for where, values in ((np.flatnonzero(held), (0, 1, 1)), (at0 := np.flatnonzero(zero), (m.start0.take(x.ravel()[at0]), m.size0.take(x.ravel()[at0]), 1 << BITS0))):
            for of, value in zip((begin, size, total), values):
                of.ravel()[where] = value
        begin, size, total = begin.view(U), size.view(U), total.view(U)
        bound, part = m.bound.take(chosen), m.part.take(chosen)
        for i in range(height):
            r = width[:k] >> U(BITS)
            share = r * part[i] // total[i]
            lo, wi = low[:k] + r * bound[i] + share * begin[i], share * size[i]
            over = np.flatnonzero(lo < low[:k])
            if len(over):  # carries are left in the upper halves
                out[at[over] - 1, over] += np.uint32(1)
            small = np.flatnonzero(wi < RENORM)
            while len(small):
                few, p = lo[small], at[small]
                out[p, small] = few >> U(48)
                at[small] = p + 1
                lo[small] = few << U(16)
                few = wi[small] << U(16)
                wi[small] = few
                small = small[few < RENORM]
            low[:k], width[:k] = lo, wi
        before[:k] = m.learn(prev, before, x, np.where(zero, 0, pair), chosen)
        last[:k] = x[-1]
    # any value of the last interval will do: the one whose bits after the next word are zero
    over = np.flatnonzero(low > MOST - (RENORM - U(1)))
    out[at[over] - 1, over] += np.uint32(1)
    out[at, every] = (low + (RENORM - U(1))) >> U(48)
    at += 1
    out = out[: at.max()]
    for i in range(len(out) - 1, 0, -1):
        out[i - 1] += out[i] >> np.uint32(16)
    words = np.ascontiguousarray((out & np.uint32(0xFFFF)).astype("<u2").T)
    payload = at.astype("<u4").tobytes() + words[np.arange(len(out)) < at[:, None]].tobytes()
    return HEAD.pack(MAGIC, n, lanes, zlib.crc32(ids.astype("<u2").tobytes()), zlib.crc32(payload)) + payload


def decode(block: bytes) -> np.ndarray:
    """The ids of a block; raises ValueError if a checksum does not hold."""
    magic, n, lanes, crc, payload_crc = HEAD.unpack_from(block)
    if magic != MAGIC:
        raise ValueError("not a block")
    if not n:
        return np.zeros(0, np.int32)
    if zlib.crc32(memoryview(block)[HEAD.size :]) != payload_crc:
        raise ValueError("damaged payload")
    if lanes != _shape(n)[0]:
        raise ValueError("unknown layout")
    _, rows, long = _shape(n)
    length = np.frombuffer(block, "<u4", lanes, HEAD.size).astype(np.int64)
    at = np.cumsum(length + 4) - length - 4
    flat = np.zeros(int((length + 4).sum()) + 4, np.uint16)  # zeros after each lane
    flat[np.arange(int(length.sum())) + np.repeat(4 * np.arange(lanes), length)] = np.frombuffer(block, "<u2", -1, HEAD.size + 4 * lanes)
    m, table = _Models(n), np.zeros((rows, lanes + 16), np.int32)[:, :lanes]  # rows a power of two apart would share cache sets
    code, width = np.zeros(lanes, U), np.full(lanes, MOST)
    for i in range(4):
        code = code << U(16) | flat.take(at + i).astype(U)
    at += 4
    last, before = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    top = len(flat) - 1
    for t, height, k in _steps(rows, lanes, long):
        m.inverses()
        prev, pair, chosen = (np.empty((height, k), np.int64) for _ in range(3))
        above, ids = before[:k], last[:k]
        for i in range(height):
            prev[i] = ids
            a, cell = m.look(ids, above)
            co, r = code[:k], width[:k] >> U(BITS)
            first, zero = co >= r * m.bound[1:].take(cell), co >= r * m.bound[2:].take(cell)
            cell += np.add(first, zero, dtype=np.int64)
            chosen[i] = cell
            co = co - r * m.bound.take(cell)
            wi = r * m.part.take(cell)
            x = m.id.take(a).astype(np.int64)
            above = a * ~first
            rest = np.flatnonzero(first & ~zero)
            if len(rest):
                left, table1, some = m.span.take(a[rest]), m.bases.take(ids[rest]), co[rest]
                at_a, size_a = left >> LOW, left & _SIZE
                share = wi[rest] // np.maximum((table1 & _SIZE) - size_a, 1).view(U)
                v = np.minimum(some // share, U(1 << 40)).view(np.int64)
                found = m.inverse1.take(np.minimum(v + size_a * (v >= at_a) + (table1 >> LOW), m.last)).astype(np.int64)
                span = m.span.take(found)
                mine = span >> LOW
                co[rest] = some - share * (mine - size_a * (at_a < mine)).view(U)
                wi[rest] = share * (span & _SIZE).view(U)
                above[rest] = found
                x[rest] = m.id.take(found)
            rest = np.flatnonzero(zero)
            if len(rest):
                share = wi[rest] >> U(BITS0)
                y = m.inverse0.take(np.minimum(co[rest] // share, U((1 << BITS0) - 1)).astype(np.int64))
                co[rest] -= share * m.start0.take(y).astype(U)
                wi[rest] = share * m.size0.take(y).astype(U)
                x[rest] = y
            small = np.flatnonzero(wi < RENORM)
            while len(small):
                p = at[small]
                co[small] = co[small] << U(16) | flat.take(p).astype(U)
                at[small] = np.minimum(p + 1, top)
                few = wi[small] << U(16)
                wi[small] = few
                small = small[few < RENORM]
            code[:k], width[:k] = co, wi
            pair[i], table[t + i, :k], ids = above, x, x
        before[:k] = m.learn(prev, before, table[t : t + height, :k], pair, chosen)
        last[:k] = ids
    out = _in_line(table, long)
    if zlib.crc32(out.astype("<u2").tobytes()) != crc:
        raise ValueError("damaged ids")
    return out
