"""Token ids of whole texts by the ``tokenizers`` library, with a memory of words.

Both kinds of vocabulary below cut a text at white space before any merge, so a text's ids are those of its
pieces, one after the other, and a piece met before is looked up. Pieces are cut and looked up for a block of texts
at once, as Arrow arrays; only new ones reach Python. The cuts are chosen so that this is exact; other kinds of
tokenizer encode a text whole, and where a cut would not be safe a piece is longer.
"""

from __future__ import annotations

import json
import os
import re
import string
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_LETTERS = "[A-Za-zÀ-ÖØ-öø-ÿ]+"
#: A word that is one piece to the model, after at most one white space that is a piece of its own.
_PLAIN = {"word": re.compile(f"({_LETTERS})"), "byte": re.compile(f"[\n\t\r]?( ?{_LETTERS})"), "whole": re.compile("(?!)")}
#: Last and last but one bytes of white space other than `[ \n\t\r]`, and of some other characters.
_ODD_LAST = np.isin(np.arange(256), [0x0B, 0x0C, *range(0x1C, 0x20), *range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF])
_ODD_BEFORE = np.isin(np.arange(256), [0xC2, 0x80, 0x81, 0x9A])


def _byte_letters() -> dict[int, str]:
    """How byte-level vocabularies spell bytes: printable ones as themselves, the others from U+0100 on, in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(0x100 + i) for i, b in enumerate(hidden)}


def _large(kind: pa.DataType, offsets: np.ndarray, data) -> pa.Array:
    return pa.Array.from_buffers(kind, len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(b"") if data is None else pa.py_buffer(data)])


def _offsets(array: pa.Array) -> np.ndarray:
    if not len(array):
        return np.zeros(1, np.int64)
    return np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]


class Encoder:
    """Encodes texts of one tokenizer file to packed little-endian ids, each text's own followed by ``end``.

    ``width`` is 2 bytes where every id fits, else 4. ``remember`` bounds the memory of pieces, and 32 times it
    their bytes; when it is full it starts anew, which costs time and changes nothing.
    """

    def __init__(self, path: str, end: int | None = None, remember: int = 700_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives each task one core
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        size = max(self.tokenizer.get_vocab_size(with_added_tokens=True), (end or 0) + 1)
        self.width = 2 if size <= 1 << 16 else 4
        self.dtype, self.pack = f"<u{self.width}", "H" if self.width == 2 else "I"
        self.end = None if end is None else pa.array([np.array([end], self.dtype).tobytes()], pa.large_binary())
        self.kind = self._kind(spec)
        self.remember = 0 if self.kind == "whole" else remember
        self.model = self.tokenizer.model
        self.letters, self.by_bytes = _byte_letters(), "ByteLevel" in json.dumps(spec.get("pre_tokenizer"))
        #: Punctuation that ends a word for certain: no apostrophe (contractions), nothing an added token is made of.
        whole = "'" + "".join(t["content"] for t in spec.get("added_tokens") or [])
        self.marks = np.isin(np.arange(256), [ord(c) for c in string.punctuation if c not in whole])
        self._forget()

    def _forget(self) -> None:
        self.known, self.ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())

    @staticmethod
    def _kind(spec: dict) -> str:
        pre = spec.get("pre_tokenizer") or {}
        if spec["model"].get("end_of_word_suffix") and "\\s+" in json.dumps(spec.get("normalizer")) and spec["model"]["type"] == "BPE":
            return "word"
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec.get("normalizer"):
            return "byte"
        return "whole"

    def _word(self, word: str) -> bytes:
        """Ids of a plain word, which is one piece to the vocabulary's model; byte-level ones spell bytes as letters."""
        if self.by_bytes:
            word = word.replace(" ", "Ġ") if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        ids = array(self.pack, [t.id for t in self.model.tokenize(word)])
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def _learn(self, pieces: pa.Array) -> pa.Array:
        """Ids of new pieces: those of plain words by the model alone, the rest by the tokenizer."""
        pieces = pieces.to_numpy(zero_copy_only=False)
        found: list[bytes | None] = [None] * len(pieces)
        words: dict[str, bytes] = {}
        rest, plain = [], _PLAIN[self.kind].fullmatch
        breaks = dict(zip("\n\t\r", self._encoded(["\n", "\t", "\r"])))
        for i, piece in enumerate(pieces):
            m = plain(piece)
            if not m:
                rest.append(i)
                continue
            word = m[1].lower() if self.kind == "word" else m[1]
            ids = words.get(word)
            if ids is None:
                ids = words[word] = self._word(word)
            found[i] = ids if len(m[1]) == len(piece) else breaks[piece[0]] + ids
        for i, ids in zip(rest, self._encoded([pieces[i] for i in rest])):
            found[i] = ids
        return pa.array(found, pa.large_binary())

    def _encoded(self, texts: list[str], at_once: int = 1_000_000) -> Iterator[bytes]:
        """Ids by the tokenizer, about ``at_once`` characters at a time, as its results take far more memory than ids."""
        batch, size = [], 0
        for i, text in enumerate(texts, 1):
            batch.append(text)
            size += len(text)
            if size >= at_once or i == len(texts):
                for e in self.tokenizer.encode_batch_fast(batch, add_special_tokens=False):
                    yield np.array(e.ids, self.dtype).tobytes()
                batch, size = [], 0

    def _cut(self, data: np.ndarray, bounds: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """The pieces of texts lying between ``bounds`` of ``data``, and where each text's begin among them.

        Pieces begin at a text's start, at white space after other characters (which a word vocabulary drops), and at
        a mark right after an ASCII letter. In a byte vocabulary a run of white space is one with its next character
        in view, so it is not cut after other white space.
        """
        starts = bounds[:-1][bounds[:-1] < bounds[1:]]
        if self.kind == "whole" or not len(data):
            return _large(pa.large_string(), np.append(starts, len(data)), data), np.searchsorted(starts, bounds)
        blank = (data == 32) | (data == 10) | (data == 9) | (data == 13)
        first = np.zeros(len(data), bool)
        if self.kind == "word":
            first[1:] = blank[:-1]
            first[starts] = True
            first &= ~blank
        else:
            first[1:] = blank[1:] & ~blank[:-1]
            at = np.flatnonzero(first)
            at = at[_ODD_LAST[data[at - 1]]]
            first[at[(data[at - 1] < 0x20) | _ODD_BEFORE[data[at - 2]]]] = False
            first[starts] = True
        first[1:] |= self.marks[data[1:]] & ((data[:-1] | 32) - np.uint8(97) < 26)
        places = np.flatnonzero(first)
        index = np.searchsorted(places, bounds)
        if self.kind == "word":
            data, places = data[~blank], np.flatnonzero(first[~blank])
        return _large(pa.large_string(), np.append(places, len(data)), data), index

    def _block(self, texts: pa.Array) -> pa.Array:
        offsets = _offsets(texts)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        pieces, index = self._cut(data, offsets - offsets[0])
        if len(self.known) > self.remember or self.known.nbytes > 32 * self.remember:
            self._forget()
        found = pa.concat_arrays([self.known, pieces]).dictionary_encode()
        self.ids = pa.concat_arrays([self.ids, self._learn(found.dictionary[len(self.known) :])])
        rows = found.indices.to_numpy()[len(self.known) :]
        self.known, table = found.dictionary, self.ids
        if self.end is not None:
            rows = np.insert(rows, index[1:], len(table))
            table, index = pa.concat_arrays([table, self.end]), index + np.arange(len(index))
        joined = table.take(pa.array(rows))
        return _large(pa.large_binary(), _offsets(joined)[index], joined.buffers()[2])

    def arrays(self, texts: pa.Array, at_once: int = 8_000_000) -> Iterator[pa.Array]:
        """Packed ids of each text with the end id, in arrays of whole texts of about ``at_once`` bytes; null is an empty text."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        offsets, at = _offsets(texts), 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + at_once, "right")) - 1)
            yield self._block(texts.slice(at, to - at))
            at = to

    def encode_all(self, texts: list[str | None] | pa.Array, at_once: int = 8_000_000) -> Iterator[bytes]:
        """As ``arrays``, text by text."""
        for block in self.arrays(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()), at_once):
            yield from block.to_pylist()


_OPEN: dict[tuple[str, int | None], Encoder] = {}


def encoder(path: str, end: int | None) -> Encoder:
    """One encoder a Python worker: its memory serves all tasks that the worker runs."""
    if (path, end) not in _OPEN:
        _OPEN[path, end] = Encoder(path, end)
    return _OPEN[path, end]
