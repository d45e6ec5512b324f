"""Texts to token ids with public tokenizers, a batch of texts at once, remembering the ids of frequent pieces.

A batch is one run of UTF-8 bytes, cut where no token can cross: at blanks, at a single line feed before a word, and
between an ASCII letter and a full stop or comma. Pieces repeat, so most are looked up: a piece of at most LONGEST bytes
is its bytes as three machine words, found in an open-addressing table by numpy, words compared in full. New pieces go
through the tokenizer: runs of Latin letters straight to its merges (its normaliser and splitter leave them whole), others
through all of it in one call a batch. Texts with any white space besides space and line feed, or control characters, are
one piece each.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa

_L = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
_PLAIN = re.compile(rf" ?[{_L}]+").fullmatch
#: Everything that any of the engines involved may hold for white space, but space and line feed, by its UTF-8 bytes.
_ODD = re.compile(rb"[\x00-\x09\x0b-\x1f\x7f]|\xc2[\x80-\x9f\xa0]|\xe1\x9a\x80|\xe1\xa0\x8e|\xe2\x80[\x80-\x8f\xa8-\xaf]|\xe2\x81[\x9f-\xa4]|\xe3\x80\x80|\xef\xbb\xbf").search
REMEMBERED, LONGEST = 1 << 21, 24  # pieces; bytes of one
_SLOTS = 1 << 22
_STEP = 1 << 22  # bytes that are cut at once, and pieces that are looked up at once
_TEXTS = 1 << 21  # bytes of texts that are encoded at once, but for what the last of them has beyond
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0xBF58476D1CE4E5B9)]
_BLANK, _LETTER, _POINT, _SUSPECT = 1, 2, 4, 8


def _kinds() -> np.ndarray:
    kind = np.zeros(256, np.uint8)
    kind[[0x20, 0x0A]] = _BLANK
    kind[0x41:0x5B] = kind[0x61:0x7B] = _LETTER
    kind[[0x2C, 0x2E]] = _POINT
    kind[[x for x in range(0x20) if x != 0x0A] + [0x7F, 0xC2, 0xE1, 0xE2, 0xE3, 0xEF]] = _SUSPECT
    return kind


_KIND = _kinds()
_MASK = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write each byte as a printable character."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ..., for length[0] numbers, then from start[1] on, and so forth."""
    ends = np.cumsum(length)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - length), length)


class _Pool:
    """Ids of pieces, one after another; grows by doubling."""

    def __init__(self) -> None:
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def lay(self, ids: np.ndarray) -> None:
        """Puts ids behind those in use, until the next lay() or add()."""
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(ids)] = ids

    def add(self, ids: np.ndarray) -> None:
        self.lay(ids)
        self.used += len(ids)


class Encoder:
    """name: a file of public_tokenizers. keeps_blanks: white space is part of the tokens."""

    def __init__(self, name: str, keeps_blanks: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.keeps = keeps_blanks
        self.batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        self.merge = self.tokenizer.model.tokenize
        letters = _byte_letters()
        self.shown = {c: "".join(letters[b] for b in chr(c).encode()) for c in (32, *range(0xC0, 0x100))}
        self.slots = np.full(_SLOTS, -1, np.int32)
        self.words = [np.zeros(REMEMBERED, np.uint64) for _ in range(3)]
        self.first, self.count = np.zeros(REMEMBERED, np.int64), np.zeros(REMEMBERED, np.int32)
        self.known, self.pool = 0, _Pool()

    def _ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of new pieces one after another, and how many each has, from the tokenizer."""
        merge, blank, whole = self.merge, self.shown[32], []
        made: list[list[int]] = []
        for i, text in enumerate(pieces):
            if _PLAIN(text):
                if not self.keeps:
                    text = text.lower()
                if not text.isascii():
                    text = text.translate(self.shown)
                elif text[0] == " ":
                    text = blank + text[1:]
                made.append([t.id for t in merge(text)])
            else:
                whole.append(i)
                made.append([])
        if whole:
            for i, e in zip(whole, self.batch([pieces[i] for i in whole], add_special_tokens=False)):
                made[i] = e.ids
        count = np.fromiter(map(len, made), np.int64, len(made))
        return np.fromiter(chain.from_iterable(made), np.uint32, int(count.sum())), count

    def _cut(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and length of each piece, and whether it is an odd text; data has some bytes beyond the last text."""
        n, cuts, odd, full = int(ends[-1]) if len(ends) else 0, [], set(), starts[ends > starts]
        for a in range(0, n, _STEP):
            b, lead = min(n, a + _STEP), min(a, 2)
            kind = _KIND[data[a - lead : b]]
            blank = kind & _BLANK > 0
            inside = slice(lead, None)
            before = np.concatenate([[True], blank[:-1]])
            cut = blank != before if not self.keeps else blank & ~before
            cut[1:] |= (kind[1:] & _POINT > 0) & (kind[:-1] & _LETTER > 0)
            if self.keeps and len(kind) > 2:  # a line feed alone, then a word
                cut[2:] |= (data[a - lead + 1 : b - 1] == 10) & ~blank[2:] & ~blank[:-2]
            first, last = np.searchsorted(full, (a, b))
            cut[full[first:last] - a + lead] = True
            cuts.append(np.flatnonzero(cut[inside]) + a)
            suspects = np.flatnonzero(kind[inside] & _SUSPECT > 0) + a
            if len(suspects):
                for i in np.unique(np.searchsorted(ends, suspects, side="right")).tolist():
                    if i not in odd and _ODD(data[starts[i] : ends[i]].tobytes()):
                        odd.add(i)
        at = np.concatenate(cuts) if cuts else np.zeros(0, np.int64)
        if odd:
            strange = np.array(sorted(odd))
            i = np.searchsorted(ends[strange], at, side="right")  # the odd text that a cut may lie in
            i = np.minimum(i, len(strange) - 1)
            at = at[(at <= starts[strange[i]]) | (at >= ends[strange[i]])]
            is_odd = np.isin(at, starts[strange])
        else:
            is_odd = np.zeros(len(at), bool)
        length = np.diff(at, append=n)
        if not self.keeps:
            use = (_KIND[data[at]] & _BLANK == 0) | is_odd
            at, length, is_odd = at[use], length[use], is_odd[use]
        return at, length, is_odd

    def _key(self, view: np.ndarray, at: np.ndarray, length: np.ndarray) -> list[np.ndarray]:
        """The bytes of each piece as machine words, zeros after its end: pieces hold no zero bytes."""
        out = [view.take(at) & _MASK.take(np.minimum(length, 8))]
        for k in (8, 16):
            w, longer = np.zeros(len(at), np.uint64), np.flatnonzero(length > k)
            w[longer] = view.take(at[longer] + k) & _MASK.take(np.minimum(length[longer] - k, 8))
            out.append(w)
        return out

    def _find(self, key: list[np.ndarray], new: bool = False) -> np.ndarray:
        """Where each key is in the table, -1 if nowhere; new: keys that are put there, one after another."""
        h = key[0] * _MIX[0] ^ key[1] * _MIX[1] ^ key[2] * _MIX[2]
        h = (h ^ h >> np.uint64(29)) * _MIX[2] >> np.uint64(42)
        slot = h.astype(np.int64)
        out, left = np.full(len(slot), -1, np.int64), np.arange(len(slot))
        while len(left):
            at = slot[left]
            found = self.slots.take(at).astype(np.int64)
            if new:
                empty = found < 0
                self.slots[at[empty]] = self.known + left[empty]  # of several, the last stays
                placed = self.slots.take(at) == self.known + left
                left = left[~placed]
            else:
                there = np.flatnonzero(found >= 0)
                left, found = left[there], found[there]
                same = (self.words[0].take(found) == key[0].take(left)) & (self.words[1].take(found) == key[1].take(left)) & (self.words[2].take(found) == key[2].take(left))
                out[left[same]] = found[same]
                left = left[~same]
            slot[left] = (slot[left] + 1) & (_SLOTS - 1)
        return out

    def _pieces(self, data: np.ndarray, at: np.ndarray, length: np.ndarray, is_odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces, and how many each has."""
        view = np.ndarray((len(data) - 8,), "<u8", data, strides=(1,))
        short = np.flatnonzero((length <= LONGEST) & ~is_odd)
        key = self._key(view, at[short], length[short])
        found = np.full(len(at), -1, np.int64)
        found[short] = self._find(key)
        missing = np.flatnonzero(found < 0)
        if not len(missing):
            count = self.count.take(found).astype(np.int64)
            return self.pool.ids.take(ragged(self.first.take(found), count)), count
        number: dict[bytes, int] = {}
        raw, put = data.tobytes(), number.setdefault
        which = np.array([put(raw[a:b], len(number)) for a, b in zip(at[missing].tolist(), (at + length)[missing].tolist())])
        own, own_count = self._ids([piece.decode() for piece in number])
        own_first = np.cumsum(own_count) - own_count
        sample = np.zeros(len(number), np.int64)
        sample[which[::-1]] = missing[::-1]  # a place where each new piece stands
        keep = np.flatnonzero((length[sample] <= LONGEST) & ~is_odd[sample])[: max(0, REMEMBERED - self.known)]
        first, count = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
        old = np.flatnonzero(found >= 0)
        first[old], count[old] = self.first.take(found[old]), self.count.take(found[old])
        first[missing], count[missing] = self.pool.used + own_first[which], own_count[which]
        self.pool.lay(own)
        out = self.pool.ids.take(ragged(first, count))
        if len(keep):
            key = self._key(view, at[sample[keep]], length[sample[keep]])
            self._find(key, new=True)
            end = self.known + len(keep)
            for table, k in zip(self.words, key):
                table[self.known : end] = k
            self.count[self.known : end] = own_count[keep]
            self.first[self.known : end] = self.pool.used + np.cumsum(own_count[keep]) - own_count[keep]
            self.pool.add(own.take(ragged(own_first[keep], own_count[keep])))
            self.known = end
        return out, count

    def arrow(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each text has; null texts have none."""
        column = texts.cast(pa.large_binary()).fill_null(b"")
        if not len(column):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        bounds = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset)
        # each cut and piece takes many times its bytes, so only some texts are cut and looked up together
        first = np.flatnonzero(np.diff((bounds[:-1] - bounds[0]) // _TEXTS, prepend=-1)).tolist()
        made = [self._texts(column, bounds[a : b + 1]) for a, b in zip(first, [*first[1:], len(column)])]
        return np.concatenate([ids for ids, _ in made]), np.concatenate([n for _, n in made])

    def _texts(self, column: pa.Array, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts between bounds in the column's bytes one after another, and how many each has."""
        n = int(bounds[-1] - bounds[0])
        data = np.zeros(n + 40, np.uint8)
        if n:
            data[:n] = np.frombuffer(column.buffers()[2], np.uint8, n, int(bounds[0]))
        bounds = bounds - bounds[0]
        at, length, is_odd = self._cut(data, bounds[:-1], bounds[1:])
        out, counts = [], []
        for a in range(0, len(at), _STEP):
            part = slice(a, a + _STEP)
            ids, count = self._pieces(data, at[part], length[part], is_odd[part])
            out.append(ids)
            counts.append(count)
        ids = np.concatenate(out) if out else np.zeros(0, np.uint32)
        upto = np.concatenate([[0], np.cumsum(np.concatenate(counts))]) if counts else np.zeros(1, np.int64)
        return ids, np.diff(upto[np.searchsorted(at, bounds)])

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        ids, counts = self.arrow(pa.array(texts, pa.string()))
        raw, ends = ids.astype("<u4").tobytes(), 4 * np.cumsum(counts)
        return [raw[e - 4 * n : e] for e, n in zip(ends.tolist(), counts.tolist())]


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(name: str, keeps_blanks: bool) -> Encoder:
    """One for each Python worker, as loading takes a second."""
    if (name, keeps_blanks) not in _encoders:
        _encoders[name, keeps_blanks] = Encoder(name, keeps_blanks)
    return _encoders[name, keeps_blanks]
