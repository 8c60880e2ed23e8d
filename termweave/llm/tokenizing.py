"""Whole texts to token ids through the tokenizers library, with each distinct word encoded once a worker.

A byte-level or word-level BPE never merges across the pre-tokenizer's cuts, and both kinds cut where a word
ends and white space begins. The texts of a batch are therefore cut there, in place, and its distinct words numbered;
words seen before are looked up, new ones encoded together in one call, and a text's ids are taken by the numbers of its
words. Texts where that is not certain (other white space than single blanks and line feeds, special tokens' strings,
control marks) are encoded whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct words in one generation of a worker's memory. When it is full it becomes the old one, from which words that
#: come up again move on, and the old one before it is dropped.
REMEMBERED = 300_000
_ODD = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0                　\x00\x01"
#: What a byte may be: 1 white space, 2 odd, 3 the first of some that are odd together, 4 a mark that ends a sentence or a part of it.
_KINDS = bytearray(256)
for _c, _kind in [*((x.encode(), 2) for x in _ODD), (b"<|", 2), *((x, 1) for x in (b" ", b"\n")), *((x, 4) for x in (b".", b","))]:
    _KINDS[_c[0]] = _kind if len(_c) == 1 else 3
_TOGETHER = {n: np.array([int.from_bytes(c) for x in (*_ODD, "<|") if len(c := x.encode()) == n]) for n in (2, 3)}
_LOWER = bytes(range(256)).lower()
#: Words that are one run of letters for any version of Unicode, and stay one when they are lower-cased (İ becomes a letter and a mark).
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-įı-ɏΑ-ΡΣ-Ωα-ωА-я一-龥]+")
_PLAIN = np.array([bool(_LETTERS.fullmatch(chr(c))) for c in range(0x800)]) & (np.arange(0x800) < 0x450)
_open: dict[tuple, WordEncoder] = {}


def _binary(bounds: np.ndarray, data) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(np.ascontiguousarray(bounds, np.int64)), pa.py_buffer(data)])


def parts(values: pa.Array) -> tuple[np.ndarray, bytes]:
    """Bounds, from 0, and bytes of a large_binary array."""
    _, places, data = values.buffers()
    bounds = np.frombuffer(places, np.int64)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int64)
    return bounds - bounds[0], bytes(memoryview(data or b"")[bounds[0] : bounds[-1]])


def _as_list(values: pa.Array) -> list[bytes]:
    return values.to_numpy(zero_copy_only=False).tolist()


class WordEncoder:
    """Ids of texts as little-endian bytes of ``dtype``."""

    def __init__(self, path: str, dtype: str):
        import json

        from tokenizers import Tokenizer

        self.tokenizer, self.dtype = Tokenizer.from_file(path), np.dtype(dtype)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = spec.get("pre_tokenizer") or {}
        self.spaced = steps.get("type") == "ByteLevel" and not spec.get("normalizer") and not steps.get("add_prefix_space")
        size = self.tokenizer.get_vocab_size()
        if size - 1 > np.iinfo(self.dtype).max:
            raise ValueError(f"{size} ids do not fit {dtype}")
        self.lengths, self.ends = np.zeros(size, np.int64), np.zeros(size, bool)
        suffix = spec["model"].get("end_of_word_suffix") or "\0"
        for token, i in self.tokenizer.get_vocab().items():
            self.lengths[i], self.ends[i] = len(token), token.endswith(suffix)
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _ids(self, text: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text.decode()], add_special_tokens=False)[0].ids, self.dtype)

    def whole(self, text: bytes) -> bytes:
        return self._ids(text).tobytes()

    def _learn(self, words: list[bytes]) -> None:
        if self.spaced:
            self._together(words, self._by_bytes)
        else:
            # a word of letters is one run for the pre-tokenizer, and one end of word
            plain = [w for w in words if w.isalpha() or not w.isascii() and _LETTERS.fullmatch(w.decode())]
            self._together(plain, self._by_ends)
            self._together(list(set(words).difference(plain)), self._by_marks)

    def _together(self, words: list[bytes], cut) -> None:
        for at in range(0, len(words), 2048):
            part = words[at : at + 2048]
            ids, ends, dropped = cut(part)
            if len(ends) != len(part):
                raise RuntimeError("words and ids do not line up")
            kept = np.ones(len(ids), bool)
            kept[dropped] = False
            self.known.update(zip(part, _as_list(_binary(np.append(0, np.cumsum(kept)[ends - 1]) * self.dtype.itemsize, ids[kept]))))

    def _by_bytes(self, part: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        # a mark or a text's first word has no white space before it; a line feed there is one id
        bare = np.array([w[0] not in b" \n" for w in part])
        part = [b"\n" + w if b else w for w, b in zip(part, bare.tolist())]
        ids = self._ids(b"".join(part))
        ends = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum([len(w) for w in part]), side="left") + 1
        return ids, ends, np.append(0, ends[:-1])[bare]

    def _by_ends(self, part: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids = self._ids(b" ".join(part))
        return ids, np.flatnonzero(self.ends[ids]) + 1, np.zeros(0, np.int64)

    def _by_marks(self, part: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids = self._ids(b" \x01 ".join([*part, b""]))
        marks = np.flatnonzero(ids == self._ids(b"\x01")[0])
        return ids, marks + 1, marks

    def _look_up(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct words."""
        if len(self.known) > REMEMBERED:
            self.known, self.old = {}, self.known
        known, old = self.known, self.old
        out = list(map(known.get, words))
        new = [w for w, ids in zip(words, out) if ids is None]
        if not new:
            return out
        before = list(map(old.get, new))
        known.update((w, ids) for w, ids in zip(new, before) if ids is not None)
        self._learn([w for w, ids in zip(new, before) if ids is None])
        return list(map(known.__getitem__, words))

    def encode_array(self, texts: pa.Array) -> pa.Array:
        """Ids of an array of texts (null: none) as large_binary."""
        texts = pc.fill_null(texts.cast(pa.large_string()).cast(pa.large_binary()), b"")
        bounds, raw = parts(texts)
        data, kinds = np.frombuffer(raw, np.uint8), np.frombuffer(raw.translate(_KINDS), np.uint8)
        spaces = kinds == 1
        odd = self._odd(data, kinds, spaces, bounds)
        if odd.any():
            plain = self.encode_array(texts.filter(pa.array(~odd)))
            rest = pa.array(map(self.whole, texts.filter(pa.array(odd)).to_pylist()), pa.large_binary())
            return pa.concat_arrays([plain, rest]).take(pa.array(np.argsort(np.argsort(odd, kind="stable"))))
        begins = spaces.copy()
        begins[bounds[:-1][np.diff(bounds) > 0]] = True
        begins[self._marks(data, kinds, begins)] = True
        starts = np.flatnonzero(begins)
        firsts = np.searchsorted(starts, bounds)
        if not self.spaced:
            led = spaces[starts]
            starts -= np.cumsum(led) - led
            # a capital that nothing can be composed with is folded as it stands
            data = np.where(np.append(data[1:], 0) < 128, np.frombuffer(raw.translate(_LOWER), np.uint8), data)[~spaces]
        words = _binary(np.append(starts, len(data)), data).dictionary_encode()
        ids = pa.array(self._look_up(_as_list(words.dictionary)), pa.large_binary()).take(words.indices)
        places, flat = parts(ids)
        return _binary(places[firsts], flat)

    @staticmethod
    def _odd(data: np.ndarray, kinds: np.ndarray, spaces: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Which texts are encoded whole: those with odd strings, white space in a row or at the end (and some behind such)."""
        at = np.flatnonzero((kinds == 2) | (kinds == 3))
        two = data[at].astype(np.int64) << 8 | data[np.minimum(at + 1, len(data) - 1)]
        three = two << 8 | data[np.minimum(at + 2, len(data) - 1)]
        at = at[(kinds[at] == 2) | np.isin(two, _TOGETHER[2]) | np.isin(three, _TOGETHER[3])]
        odd = np.zeros(len(bounds) - 1, bool)
        odd[np.searchsorted(bounds, np.append(at, np.flatnonzero(spaces[1:] & spaces[:-1])), side="right") - 1] = True
        filled = np.flatnonzero(np.diff(bounds))
        odd[filled[spaces[bounds[filled + 1] - 1]]] = True
        return odd

    @staticmethod
    def _marks(data: np.ndarray, kinds: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Places of marks that end a word and stand behind a letter: such a mark is a token of its own, so ``word,`` is looked up as two;
        not behind letters that may turn into marks when they are folded."""
        at = np.flatnonzero(kinds == 4)
        at = at[np.append(begins, True)[at + 1] & ~begins[at] & (at > 0)]
        last, lead = data[at - 1].astype(np.int64), data[np.maximum(at - 2, 0)].astype(np.int64)
        return at[_PLAIN[np.where(last < 128, last, np.where((lead >> 5) == 6, (lead & 31) << 6 | last & 63, 0))]]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        return self.encode_array(pa.array(texts, pa.large_string())).to_pylist()


def encoder(path: str, dtype: str = "<u4") -> WordEncoder:
    # a task is one of several on its machine
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if (path, dtype) not in _open:
        _open[path, dtype] = WordEncoder(path, dtype)
    return _open[path, dtype]


def by_bytes(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of ``most`` bytes in a text or binary column, about; a longer value is a slice of its own."""
    lengths = pc.binary_length(batch.column(column)).fill_null(0)
    ends = np.cumsum(lengths.to_numpy(zero_copy_only=False).astype(np.int64))
    at, before = 0, 0
    while at < len(ends):
        end = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(at, end - at)
        at, before = end, int(ends[end - 1])
