"""Whole texts to token ids, each distinct unit of text encoded once per worker.

A text is cut where no token, merge or pattern of the tokenizer can cross, so
that the ids of the units, joined, are the ids of the text:

* ``"word"``: at ASCII white space, which the tokenizer drops.
* ``"byte"``: in front of a run of white space that begins with an ASCII space
  or control and follows a character that is none; and between an ASCII letter
  and ASCII punctuation after it.

Units are looked up by a 64-bit hash in a cache of bounded size, which lives on
in its worker from task to task (:func:`encoder`) until another operator's task
gives its memory back.  Unseen units of plain letters, one word for the
tokenizer's pattern, go straight to the tokenizer's own model; all others take
the tokenizer's whole way.
"""

from __future__ import annotations

import os
import re
from itertools import chain
from operator import attrgetter

import numpy as np

from .words import KEPT, WS, Words, span_hash


_ID = attrgetter("id")
_LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)])
_POINT = np.isin(np.arange(256), [c for c in range(33, 127) if not chr(c).isalnum()])
#: Units that are one word to the tokenizer's pattern and that its normalizer leaves alone but for the case.
_PLAIN = {"byte": re.compile("[ ]?[A-Za-zÀ-ÖØ-öø-ɏ]+"), "word": re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")}


def byte_letters() -> dict[int, str]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the rest from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class UnitTable:
    """Places and sizes by 64-bit hash: open addressing, at most half full."""

    def __init__(self, log: int = 16):
        self.log, self.n = log, 0
        self.key, self.place, self.size = np.zeros(1 << log, np.uint64), np.zeros(1 << log, np.int32), np.zeros(1 << log, np.int32)

    def _slots(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.log)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The slot of each hash, or -1."""
        at = self._slots(h)
        key = self.key.take(at)
        look = np.flatnonzero(key != h)
        while len(look):
            k, own = key.take(look), h.take(look)
            at[look[(k == 0) & (own != 0)]] = -1
            look = look[(k != 0) & (k != own)]
            at[look] = (at.take(look) + 1) & (len(self.key) - 1)
            key[look] = self.key.take(at.take(look))
        return at

    def add(self, h: np.ndarray, place: np.ndarray, size: np.ndarray) -> None:
        """New and distinct hashes."""
        if 2 * (self.n + len(h)) > len(self.key):
            old = np.flatnonzero(self.key)
            more = UnitTable(max(self.log + 1, int(2 * (self.n + len(h))).bit_length()))
            more.add(self.key[old], self.place[old], self.size[old])
            self.__dict__ = more.__dict__
        self.n += len(h)
        at, left = self._slots(h), np.arange(len(h))
        while len(left):
            a = at[left]
            free = self.key[a] == 0
            self.key[a[free]] = h[left[free]]  # of several, the last stays
            won = self.key[a] == h[left]
            a, i = a[won], left[won]
            self.place[a], self.size[a] = place[i], size[i]
            left = left[~won]
            at[left] = (at[left] + 1) & (len(self.key) - 1)


def encoder(path: str, cut: str) -> "Encoder":
    """The worker's encoder, with what it has learned so far."""
    key = ("encoder", path, cut)
    if key not in KEPT:
        KEPT.clear()
        KEPT[key] = Encoder(path, cut)
    return KEPT[key]


class Encoder:
    def __init__(self, path: str, cut: str, most_units: int = 1_500_000, most_ids: int = 8_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one core for each task
        from tokenizers import Tokenizer

        if cut not in ("word", "byte"):
            raise ValueError(f"cut: {cut}")
        self.tokenizer, self.cut, self.most_units, self.most_ids = Tokenizer.from_file(path), cut, most_units, most_ids
        self.model, self.plain = self.tokenizer.model, _PLAIN[cut]
        self.letters = byte_letters()
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._reset()

    def _reset(self) -> None:
        self.table = UnitTable()
        self.pool, self.used = np.zeros(0, np.int32), 0

    def _special_spans(self, buf: np.ndarray) -> list[tuple[int, int]]:
        raw = buf.tobytes()
        return [(m.start(), m.end()) for s in self.special if s in raw for m in re.finditer(re.escape(s), raw)]

    def units(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of the units, which are in order and within one text each."""
        if self.cut == "word":
            w = Words(buf, offs, hashed=False)
            return w.start, w.end
        n = len(buf)
        space = WS[buf]
        before = np.zeros(n, np.uint8)
        before[1:] = buf[:-1]
        at = np.flatnonzero(space & ~(WS[before] | ((before >= 0x1C) & (before <= 0x1F))))
        wide = before[at] >= 0x80  # white space outside ASCII ends in such a byte
        if wide.any():
            w = at[wide]
            b1, b2, b3 = buf[w - 1], buf[np.maximum(w - 2, 0)], buf[np.maximum(w - 3, 0)]
            odd = (b2 == 0xC2) & ((b1 == 0x85) | (b1 == 0xA0))
            odd |= (b3 == 0xE1) & (b2 == 0x9A) & (b1 == 0x80)
            odd |= (b3 == 0xE2) & ((b2 == 0x80) | (b2 == 0x81))
            odd |= (b3 == 0xE3) & (b2 == 0x80) & (b1 == 0x80)
            keep = np.ones(len(at), bool)
            keep[np.flatnonzero(wide)[odd]] = False
            at = at[keep]
        # Also in front of ASCII punctuation after an ASCII letter, where a run of letters always ends.
        at = np.concatenate([at, 1 + np.flatnonzero(_LETTER[buf[:-1]] & _POINT[buf[1:]]), offs[:-1][offs[1:] > offs[:-1]]])
        at.sort(kind="stable")  # three sorted runs
        start = at[np.append(True, at[1:] != at[:-1])] if n else at
        for a, b in self._special_spans(buf):  # a special token's string stays whole
            start = start[(start <= a) | (start >= b)]
        return start, np.append(start[1:], n)

    def ids_of(self, texts: list[str]) -> list[list[int]]:
        """Ids of whole units."""
        out: list[list[int]] = [[]] * len(texts)
        odd, plain = [], self.plain.fullmatch
        words = [t if plain(t) else None for t in texts]
        if self.cut == "word":
            words = [None if t is None else t.lower() for t in words]
        known = [k for k, t in enumerate(words) if t is not None]
        letters = "\n".join(words[k] for k in known).encode().decode("latin-1").translate(self.letters | {10: "\n"}).split("\n")
        tokenize = self.model.tokenize
        for k, t in zip(known, letters):
            out[k] = list(map(_ID, tokenize(t)))
        odd = [k for k, t in enumerate(words) if t is None]
        for i in range(0, len(odd), 4096):
            part = odd[i : i + 4096]
            for k, e in zip(part, self.tokenizer.encode_batch_fast([texts[k] for k in part], add_special_tokens=False)):
                out[k] = e.ids
        return out

    def _learn(self, h: np.ndarray, texts: list[str]) -> None:
        if self.table.n > self.most_units or self.used > self.most_ids:
            self._reset()
        got = self.ids_of(texts)
        size = np.fromiter(map(len, got), np.int32, len(got))
        total = int(size.sum())
        if self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(max(total, self.used, 1 << 16), np.int32)])
        self.pool[self.used : self.used + total] = np.fromiter(chain.from_iterable(got), np.int32, total)
        self.table.add(h, (self.used + np.cumsum(size) - size).astype(np.int32), size)
        self.used += total

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a chunk, joined, and the count for each text."""
        n = len(offs) - 1
        start, end = self.units(buf, offs)
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(n, np.int64)
        h = span_hash(buf, start, end)
        h |= np.uint64(1)  # never 0, which marks a free slot
        slot = self.table.find(h)
        new = np.flatnonzero(slot < 0)
        if len(new):
            key, first = np.unique(h[new], return_index=True)
            first = new[first]
            raw = buf.tobytes()
            self._learn(key, [raw[a:b].decode("utf-8", "replace") for a, b in zip(start[first].tolist(), end[first].tolist())])
            slot = self.table.find(h)
            if (slot < 0).any():  # the cache was emptied on the way
                return self.encode(buf, offs)
        at, size = self.table.place.take(slot), self.table.size.take(slot)
        total = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=total[1:])
        shift = at - total[:-1]
        ids = self.pool.take(np.repeat(shift, size) + np.arange(total[-1]))
        cuts = np.searchsorted(start, offs)
        return ids, total[cuts[1:]] - total[cuts[:-1]]


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with ``end_id`` after each text."""
    return np.insert(ids, np.cumsum(counts), end_id), counts + 1
