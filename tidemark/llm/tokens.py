"""Token ids of whole texts by a public tokenizer, with a bounded cache of pieces.

A text's bytes are cut, all at once, into the pieces that the tokenizer's own pattern finds (words, numbers,
marks). The tokenizer's model never joins characters of two pieces, so the ids of a text are those of its
pieces, one after the other: each distinct piece of a call is looked up once, and only new ones go to the
model. Units (what stands between two spaces) with characters of which the pattern is not known here are
encoded whole; texts in which a space touches other white space, or which begin or end with some, are too.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces kept in a worker: some 15 MB.
MAX_UNITS = 400_000
#: Kinds of bytes. Two-byte letters (À to ÿ) are letters by both bytes; a unit with another character is not cut.
_OTHER, _LETTER, _DIGIT, _MARK, _WHITE, _SPACE = range(6)
_KIND = np.zeros(256, np.uint8)
_KIND[33:127], _KIND[48:58], _KIND[128:192], _KIND[0xC3] = _MARK, _DIGIT, _LETTER, _LETTER
_KIND[65:91] = _KIND[97:123] = _LETTER
_KIND[[9, 10, 13]], _KIND[32] = _WHITE, _SPACE
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: What follows an apostrophe in a piece of its own.
_SHORT = np.zeros((256, 256), bool), np.zeros(256, bool)
_SHORT[0][[*b"rvl"], [*b"eel"]] = True
_SHORT[1][[*b"stmd"]] = True
#: How the tokenizers' models write white space and, by their bytes, letters beyond ASCII; "Ã" first, as others are written with it.
_WRITTEN = {"Ã": "Ãĥ", " ": "Ġ", "\n": "Ċ", "\r": "č", "\t": "ĉ"}
_WRITTEN |= {chr(c): "Ã" + (chr(0x122 + c - 0xC0) if c <= 0xE0 else "Ń" if c == 0xED else chr(c - 0x40)) for c in range(0xC0, 0x100) if c not in (0xC3, 0xD7, 0xF7)}
#: Entries: the first has no ids, the next the end's, all others a piece's.
_END, _FIRST = 1, 2
#: Bytes of text in one call; the more, the more often a piece is looked up once for many.
TEXT_BYTES = 1 << 22
_LOADED: dict[tuple[str, bool], "Encoder"] = {}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str, spaced: bool) -> "Encoder":
    """The encoder of a tokenizer file, one for each Python worker."""
    if (path, spaced) not in _LOADED:
        _LOADED[path, spaced] = Encoder(path, spaced)
    return _LOADED[path, spaced]


def _joined(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([np.empty(0, np.uint32), *ids]), np.fromiter(map(len, ids), np.int64, len(ids))


def _gathered(pool: np.ndarray, begin: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the entries ``at``, one after the other, and how many each has."""
    size = begin[at + 1] - begin[at]
    end = np.cumsum(size)
    wide = np.int32 if len(pool) + len(at) < 1 << 30 and (not len(end) or end[-1] < 1 << 30) else np.int64
    where = np.repeat((begin[at] - end + size).astype(wide), size)
    where += np.arange(len(where), dtype=wide)
    return pool.take(where), size


class Encoder:
    """``spaced``: whether the space before a word belongs to the word's ids (byte-level BPE)."""

    def __init__(self, path: str, spaced: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.spaced = spaced
        self.mark, self.mark_id = self._separator()
        self._reset()

    def _separator(self) -> tuple[str, int]:
        """A text of one id that stands apart between units, and that id."""
        if self.spaced:
            return "\n", self.whole(["\n"])[0][0]
        return next((f" {c} ", x[0]) for c in "♥★§€£" if len(x := self.whole([f" {c} "])[0]) == 1)

    def _reset(self) -> None:
        self.piece = pa.array([], pa.large_binary())
        self.uneven: set[int] = set()  # pieces that white space beyond ASCII begins or ends
        self.pool = np.zeros(1 << 16, np.uint32)
        self.begin = np.zeros(1 << 14, np.int64)
        self.hits = np.zeros(1 << 14, np.int32)
        self.begin[_FIRST] = self.begin[_END + 1] = 1  # no ids, and the end

    def _forget(self) -> None:
        """Keep the pieces met twice or more since the last time; most others never come again."""
        pool, begin, piece, uneven, hits = self.pool, self.begin, self.piece, self.uneven, self.hits[_FIRST : _FIRST + len(self.piece)]
        self._reset()
        often = np.flatnonzero(hits > 1)
        if len(often) > MAX_UNITS // 2:
            often = np.sort(np.argpartition(hits, -(MAX_UNITS // 2))[-(MAX_UNITS // 2) :])
        self._keep(piece.take(pa.array(often)), *_gathered(pool, begin, often + _FIRST))
        self.uneven = set((np.flatnonzero(np.isin(often + _FIRST, list(uneven))) + _FIRST).tolist())

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _apart(self, units: list[str]) -> list[np.ndarray]:
        """The ids of each unit: many go into one call, with a separator between them."""
        out: list = [None] * len(units)
        bare = self.mark.strip() or self.mark
        alone = [i for i, u in enumerate(units) if bare in u]
        for i, ids in zip(alone, self.whole([units[i] for i in alone])):
            out[i] = np.asarray(ids, np.uint32)
        rest = [i for i, u in enumerate(units) if bare not in u]
        for a in range(0, len(rest), 4096):
            part = rest[a : a + 4096]
            ids = np.asarray(self.whole([self.mark.join(units[i] for i in part)])[0], np.uint32)
            cuts = np.flatnonzero(ids == self.mark_id)
            for i, x, y in zip(part, np.r_[0, cuts + 1].tolist(), np.r_[cuts, len(ids)].tolist(), strict=True):
                out[i] = ids[x:y]
        return out

    def _of_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of new pieces, by the tokenizer's model, and how many each has."""
        tokenize = self.model.tokenize
        text = b"\0".join(pieces).decode()
        for c, written in _WRITTEN.items():
            text = text.replace(c, written)
        found = [[t.id for t in tokenize(p)] for p in text.split("\0")] if pieces else []
        size = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, size.sum()), size

    def _keep(self, new: pa.Array, ids: np.ndarray, size: np.ndarray) -> None:
        at = _FIRST + len(self.piece)
        used = int(self.begin[at])
        while len(self.pool) < used + len(ids):
            self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
        while len(self.begin) < at + len(size) + 1:
            self.begin = np.concatenate([self.begin, np.zeros_like(self.begin)])
            self.hits = np.concatenate([self.hits, np.zeros_like(self.hits)])
        self.pool[used : used + len(ids)] = ids
        self.begin[at + 1 : at + 1 + len(size)] = used + np.cumsum(size)
        self.piece = pa.concat_arrays([self.piece, new])

    def _cut(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """The pieces of texts that lie one after the other; the number of pieces before each text, and before
        the end; which pieces are whole units; which texts can't be cut."""
        n, full = len(raw), np.flatnonzero(np.diff(offsets))
        begin, kind = offsets[full], _KIND[raw]
        head = np.zeros(n + 2, bool)
        head[begin] = head[n:] = True
        signs = np.flatnonzero((raw == 0x97) | (raw == 0xB7))  # of × and ÷, if the byte before says so
        signs = signs[raw[signs - 1] == 0xC3]
        kind[signs] = kind[signs - 1] = _OTHER
        cut = head[:n].copy()
        cut[1:] |= kind[1:] != kind[:-1]
        spaces = np.flatnonzero(kind == _SPACE)
        white = np.flatnonzero(kind >= _WHITE)
        beside = white[1:][np.diff(white) == 1]
        apart = beside[(kind[beside] == _SPACE) | (kind[beside - 1] == _SPACE)]
        odd = np.zeros(len(offsets) - 1, bool)
        odd[np.searchsorted(offsets, np.r_[apart, apart - 1], "right") - 1] = True
        odd[full[(kind[begin] >= _WHITE) | (kind[offsets[full + 1] - 1] >= _WHITE)]] = True
        source = raw
        if self.spaced:
            # a space goes with what follows; of other white space, the last character stands alone
            after = spaces[~head[spaces + 1]] + 1
            cut[after] = False
            inner = beside[~head[beside]]
            cut[inner[kind[np.minimum(inner + 1, n - 1)] != _WHITE]] = True
        else:
            raw = _LOWER[raw]
            wide = np.flatnonzero(source == 0xC3)
            wide = wide[wide + 1 < n] + 1
            raw[wide[(source[wide] <= 0x9E) & (source[wide] != 0x97)]] += 32
            cut[kind == _DIGIT] = True
        mark = np.flatnonzero(raw == 39)
        mark = mark[cut[mark] & ~head[mark + 1]]
        one, two = raw[mark + 1], raw[np.minimum(mark + 2, n - 1)]
        short = _SHORT[0][one, two] & ~head[mark + 2]
        single = _SHORT[1][one]
        cut[mark[short | single] + 1] = False
        stop = np.r_[mark[single] + 2, mark[short] + 3]
        cut[stop[stop < n]] = True
        kept = None if self.spaced else kind < _WHITE
        other, units = np.flatnonzero(kind == _OTHER), np.empty(0, np.int64)
        if len(other):
            bounds = np.append(np.flatnonzero(head[:n] | (kind == _SPACE)), n)
            at = np.unique(np.searchsorted(bounds, other, "right") - 1)
            units, ends = bounds[at], bounds[at + 1]
            change = np.zeros(n + 1, np.int8)
            change[units] += 1
            change[ends] -= 1
            inside = np.cumsum(change[:n], dtype=np.int8) > 0
            cut[inside] = False
            if not self.spaced:
                raw[inside] = source[inside]
                kept |= inside
                spaced = units[kind[units] == _SPACE]
                kept[spaced] = False
                units = units + (kind[units] == _SPACE)
            cut[units] = cut[ends[ends < n]] = True
        if kept is not None:
            starts = np.flatnonzero(cut & kept)
            raw, cut = raw[kept], cut[kept]
            begins = np.append(np.flatnonzero(cut), len(raw))
        else:
            starts = np.flatnonzero(cut)
            begins = np.append(starts, n)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(begins.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw))])
        return pieces, np.searchsorted(starts, offsets), np.searchsorted(starts, units), odd

    def _entries(self, pieces: pa.Array, units: np.ndarray) -> np.ndarray:
        """The entries of pieces, of which ``units`` are whole units; new ones are made."""
        coded = pieces.dictionary_encode()
        code, distinct = coded.indices.to_numpy(), coded.dictionary
        own = pc.fill_null(pc.index_in(distinct, value_set=self.piece), -1).to_numpy().astype(np.int64)
        unit = np.zeros(len(distinct), bool)
        unit[code[units]] = True
        for whole in (False, True):
            new = np.flatnonzero((own < 0) & (unit == whole))
            if not len(new):
                continue
            own[new] = len(self.piece) + np.arange(len(new))
            values = distinct.take(pa.array(new))
            if whole:
                texts = [v.decode() for v in values.to_pylist()]
                bare = [t[1:] if t[0] == " " else t for t in texts]
                self.uneven.update(_FIRST + int(own[i]) for i, t in zip(new, bare) if t[0].isspace() or t[-1].isspace())
                self._keep(values, *_joined(self._apart(texts)))
            else:
                self._keep(values, *self._of_pieces(values.to_pylist()))
        own += _FIRST
        self.hits[own] += np.bincount(code, minlength=len(own)).astype(np.int32)
        return own[code]

    def encode(self, texts: list[str | None] | pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, each text's followed by ``end`` if given, and where each text's begin."""
        if len(self.piece) > MAX_UNITS:
            self._forget()
        texts = pc.fill_null(pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string()), "")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        raw = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.empty(0, np.uint8)
        first, odd, at = np.zeros(len(offsets), np.int64), np.zeros(len(texts), bool), np.empty(0, np.int64)
        if len(raw):
            pieces, first, units, odd = self._cut(raw, offsets - offsets[0])
            at = self._entries(pieces, units)
            if self.uneven and len(units):
                odd[np.searchsorted(first, units[np.isin(at[units], list(self.uneven))], "right") - 1] = True
        odd_texts = np.flatnonzero(odd)
        for i in odd_texts:
            at[first[i] : first[i + 1]] = 0
        if end is not None:
            self.pool[0] = end
            at = np.insert(at, first[1:], _END)
            first = first + np.arange(len(first))
        ids, size = _gathered(self.pool, self.begin, at)
        begins = np.r_[0, np.cumsum(size)][first]
        if not len(odd_texts):
            return ids, begins
        whole = dict(zip(odd_texts.tolist(), self.whole([texts[int(i)].as_py() for i in odd_texts])))
        pieces = []
        for i in range(len(texts)):
            if i in whole:
                pieces.append(np.array(whole[i], np.uint32))
            pieces.append(ids[begins[i] : begins[i + 1]])  # of a text encoded whole, the end
        n = np.diff(begins)
        n[odd_texts] += np.fromiter(map(len, whole.values()), np.int64, len(whole))
        return np.concatenate(pieces), np.r_[0, np.cumsum(n)]
