"""Token ids of whole texts, as bytes of little-endian unsigned 32-bit numbers."""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import text as T
from .common import SLICE_BYTES, slices

# Classes of bytes. Other: control signs and all letters beyond U+00FF, next to which no text is cut but at a blank.
_BLANK, _LETTER, _DIGIT, _SIGN, _QUOTE, _OTHER = range(6)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[33:127] = _SIGN
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _CLASS[97:123] = _LETTER
_CLASS[39] = _QUOTE
_CLASS[[32, 9, 10, 11, 12, 13]] = _BLANK

#: The signs that byte-level vocabularies show bytes by: printable ones by themselves, the others from U+0100 on.
_SHOWN = {b: 256 + n for n, b in enumerate(b for b in range(256) if not (33 <= b < 127 or 161 <= b < 173 or b > 173))}


def _table(words: bool) -> np.ndarray:
    """Whether a text may be cut between two bytes of given classes, without a change of its ids.

    Both kinds of vocabulary end a run of letters before a digit or a sign, a run of signs before a digit, and before a
    letter unless a quotation mark (of 's or 'll) leads to it. One that drops blanks has each digit alone, and a piece
    keeps the blanks behind it; one that keeps them has digits in runs, and a piece begins with the blanks before it.
    """
    cut = np.zeros((8, 8), bool)
    cut[_LETTER, [_DIGIT, _SIGN, _QUOTE]] = True
    cut[_DIGIT, [_LETTER, _SIGN, _QUOTE]] = True
    cut[_SIGN, [_LETTER, _DIGIT]] = True
    cut[_QUOTE, _DIGIT] = True
    if words:
        cut[_DIGIT, _DIGIT] = True
        cut[_BLANK, _LETTER:] = True
    else:
        cut[[_LETTER, _DIGIT, _SIGN, _QUOTE], _BLANK] = True
    return cut.reshape(-1)


class Encoder:
    """A tokenizers file of byte pairs, with add_special_tokens=False; special tokens' strings in a text become their ids.

    Texts are cut where no token reaches over, and the library encodes each distinct piece once. Two generations of at
    most `most` pieces are kept, so memory is bounded; a piece that the younger one lacks is taken from the older one.
    Texts that may hold a special token's string go to the library whole.
    """

    def __init__(self, path: str, most: int = 200_000, longest: int = 64):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        normal = json.loads(self.tokenizer.to_str())["normalizer"]
        self.words = normal is not None  # lower case, blanks dropped
        if self.words and [x["type"] for x in normal["normalizers"]] != ["NFC", "Replace", "Lowercase"]:
            raise ValueError(f"{path} has a normalizer of another kind")
        self.cut = _table(self.words)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.most, self.longest = most, longest
        self.met = self.learnt = 0

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> None:
        """A piece that is one run of Latin letters is one word to the library's model, which is quicker to ask directly."""
        ask, odd = self.tokenizer.model.tokenize, []
        for x in pieces:
            bare = x if self.words or x[0] != " " else x[1:]
            if bare.isalpha() and (bare.isascii() or max(bare) < "\u0100"):
                as_asked = x.lower() if self.words else x
                if not x.isascii() or x is not bare:
                    as_asked = as_asked.encode().decode("latin-1").translate(_SHOWN)
                self.known[x] = b"".join([y.id.to_bytes(4, "little") for y in ask(as_asked)])
            else:
                odd.append(x)
        self.known.update(zip(odd, self._plain(odd), strict=True))

    def _meet(self, pieces: list[str]) -> list[bytes]:
        """The ids of distinct pieces; those that are new are learnt."""
        if len(self.known) > self.most:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        keys = [x.rstrip(" \t\n\v\f\r") for x in pieces] if self.words else pieces
        new = set(keys).difference(known)
        if older:
            back = {x: older[x] for x in new if x in older}
            known.update(back)
            new.difference_update(back)
        asked = list(new)
        self._learn(asked)
        found = [known[x] for x in keys]
        for x in asked:
            if len(x) > self.longest:
                del known[x]
        self.met, self.learnt = self.met + len(keys), self.learnt + len(asked)
        return found

    def _pieces(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where pieces begin."""
        kinds = _CLASS[data]
        lead = np.flatnonzero(data == 0xC3)  # of U+00C0 to U+00FF two are signs, the others letters
        lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
        kinds[lead] = kinds[lead + 1] = _LETTER
        begin = np.empty(len(data) + 1, bool)
        begin[1:-1] = self.cut[kinds[:-1] * np.uint8(8) + kinds[1:]]
        begin[offsets] = True
        return np.flatnonzero(begin[:-1])

    def encode(self, texts) -> list[bytes]:
        """Of a list or an Arrow array of strings without nulls."""
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        special = pc.match_substring(texts, "<|")
        whole = {}
        if pc.any(special).as_py():
            at = np.flatnonzero(special.to_numpy(zero_copy_only=False))
            whole = dict(zip(at.tolist(), self._plain(texts.take(pa.array(at)).to_pylist()), strict=True))
            texts = pc.if_else(special, "", texts)
        out: list[bytes] = []
        for _, data, offsets in slices(pa.RecordBatch.from_arrays([texts], ["text"]), limit=8 * SLICE_BYTES):
            if not len(data):
                out += [b""] * (len(offsets) - 1)
                continue
            data = T.LOWER[data] if self.words else data
            begins = self._pieces(data, offsets)
            stops = np.append(begins, len(data)).astype(np.int32)
            parts = pa.Array.from_buffers(pa.string(), len(begins), [None, pa.py_buffer(stops), pa.py_buffer(data)]).dictionary_encode()
            found = self._meet(parts.dictionary.to_pylist())
            ids = np.frombuffer(b"".join(found), "<u4")
            sizes = np.fromiter(map(len, found), np.int64, len(found)) >> 2
            at = parts.indices.to_numpy()
            own = sizes[at]
            ends = np.concatenate([[0], np.cumsum(own)])
            raw = ids[np.repeat((np.cumsum(sizes) - sizes)[at] - ends[:-1], own) + np.arange(ends[-1])].tobytes()
            cuts = (4 * ends[np.searchsorted(begins, offsets)]).tolist()
            out += [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        for i, value in whole.items():
            out[i] = value
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per Python worker: what it has learnt serves the worker's next tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))
