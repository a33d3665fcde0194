"""Token ids of whole texts with the ``tokenizers`` library, piece by piece.

Encoding a text as a whole costs about a microsecond a byte, and most pieces of
a text have been met before. A text is therefore cut into its pieces first, and
each piece's ids are remembered (a bounded number of them, per Python worker);
the ids are those of the whole text.

* Byte level, a text of ASCII and Latin letters: the vocabulary's own pattern,
  written with the letters of that range, finds the pieces, which go to its model.
* Byte level, any other text: it is cut only where the pattern always cuts, at a
  space or newline before a character that is surely no white space. Each unit is
  encoded by the library.
* Word ends: texts are cut at ASCII white space, which is dropped, and where ASCII
  letters, digits and signs meet. Apostrophes, control characters and bytes from
  128 stay with their neighbours. The distinct units of a run of texts are looked
  up once each; a new unit of Latin letters is cut by the pattern, any other that
  isn't ASCII is encoded by the library.
* With ``added``, the library's default: a text that holds the string of an
  added token (``<|endoftext|>``) gets that token's id there. Such a text goes to
  the library whole. Without it, those strings are ordinary text.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import Remembered, once, vocabulary

# The pieces of the two vocabularies' pre-tokenisers.
_SPACED = r"'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[0-9]+| ?[^\s{L}0-9]+|\s+(?!\S)|\s+"
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[{L}]+|[0-9]|[^\s{L}0-9]+"

_ASCII = "A-Za-z"
# Letters in every version of Unicode, composed, and one letter in lower case.
_LATIN = "A-Za-zÀ-ÖØ-öø-įı-ɏ"
_OTHER = re.compile(f"[^\t\n\r -~{_LATIN[6:]}]")
_CUT = re.compile("(?=[ \n][!-~À-ɏ])")


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write a byte as the character of its number where that is printable, else as the next one from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(256 + k) for k, b in enumerate(hidden)}


_BYTES = _byte_letters()

# Kinds of bytes: 0 white space, 1 letters, 2 digits, 3 signs, 4 what only the pattern can judge. Digits are pieces of their own.
_KIND = np.array([0 if chr(b) in " \t\n\r" else 4 if b < 32 or b > 126 or chr(b) == "'" else 1 if chr(b).isalpha() else 2 if chr(b).isdigit() else 3 for b in range(256)], np.uint8)
_MEET = np.array([a in (1, 2, 3) and b in (1, 2, 3) and (a != b or a == 2) for a in range(5) for b in range(5)])
_BLANK = np.array([32 if chr(b) in "\t\n\r" else b for b in range(256)], np.uint8)


def _letters(piece: str) -> str:
    return piece if piece.isascii() and piece.isalpha() else piece.encode().decode("latin-1").translate(_BYTES)


def _cut(lines: pa.LargeStringArray) -> pa.LargeStringArray:
    """White space that always cuts words as spaces, and a space wherever else the pattern of word ends always cuts."""
    ends = np.frombuffer(lines.buffers()[1], np.int64, len(lines) + 1, 8 * lines.offset)
    data = np.frombuffer(lines.buffers()[2] or b"", np.uint8)[:ends[-1]]
    kind = _KIND[data]
    cuts = np.flatnonzero(_MEET[kind[:-1] * 5 + kind[1:]]) + 1  # a space goes before these bytes; a text may begin with one
    out = np.full(len(data) + len(cuts), 32, np.uint8)
    kept = np.ones(len(out), bool)
    kept[cuts + np.arange(len(cuts))] = False
    out[kept] = _BLANK[data]
    moved = (ends + np.searchsorted(cuts, ends)).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(lines), pa.py_buffer(moved), pa.py_buffer(out))


class Encoder:
    """``encode(text)``, ``encode_all(texts)``: the ids as native bytes of ``dtype``."""

    def __init__(self, name: str, dtype: str, spaces: bool, added: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary(name))
        self.tokenizer.encode_special_tokens = not added  # if true, their strings in a text are ordinary text
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if added else []
        self.spaces, self.model, self.dtype = spaces, self.tokenizer.model, np.dtype(dtype)
        self.code = {2: "H", 4: "I"}[self.dtype.itemsize]
        if self.tokenizer.get_vocab_size() - 1 > np.iinfo(self.dtype).max:
            raise ValueError(f"ids of {name} don't fit {dtype}")
        pattern = _SPACED if spaces else _WORDS
        self.ascii = re.compile(pattern.replace("{L}", _ASCII), re.ASCII).findall
        self.latin = re.compile(pattern.replace("{L}", _LATIN), re.ASCII).findall
        if spaces:
            self.pieces = Remembered(self._piece, 96 << 20)
            self.units = Remembered(self._unit, 32 << 20)
        else:
            self.units = Remembered(self._word, 128 << 20)

    def encode(self, text: str) -> bytes:
        if not self.spaces:
            return self.encode_all([text])[0]
        if any(string in text for string in self.added):
            return self._unit(text)
        if text.isascii():
            find = self.ascii
        elif not _OTHER.search(text):
            find = self.latin
        else:
            return b"".join([self.units[u] for u in _CUT.split(text) if u])
        return b"".join(map(self.pieces.__getitem__, find(text)))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        if self.spaces or not texts:
            return [self.encode(text) for text in texts]
        whole = {k: self._unit(text) for k, text in enumerate(texts) if any(string in text for string in self.added)}
        # lower case first, unless it could change what the library makes of a character
        lines = ["" if k in whole else text.lower() if text.isascii() or not _OTHER.search(text) else text for k, text in enumerate(texts)]
        lists = pc.split_pattern(_cut(pa.array(lines, pa.large_string())), " ")
        units = lists.flatten().dictionary_encode()
        ids = pa.array([self.units[u] for u in units.dictionary.to_numpy(zero_copy_only=False)], pa.large_binary())
        coded = ids.take(units.indices)  # side by side, so a text's ids are one stretch of bytes
        at = np.frombuffer(coded.buffers()[1], np.int64, len(coded) + 1, 8 * coded.offset)[lists.offsets.to_numpy()].tolist()
        data = memoryview(coded.buffers()[2] or b"")
        return [whole[k] if k in whole else bytes(data[a:b]) for k, (a, b) in enumerate(zip(at, at[1:]))]

    def _unit(self, unit: str) -> bytes:
        return array(self.code, self.tokenizer.encode(unit, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        return array(self.code, [t.id for t in self.model.tokenize(_letters(piece))]).tobytes()

    def _word(self, unit: str) -> bytes:
        low = unit.lower()
        if low.isascii():
            found = (low,) if low.isalpha() else self.ascii(low)
        elif not _OTHER.search(low):
            found = self.latin(low)
        else:  # also where a letter's lower case is outside of the range
            return self._unit(unit)
        return array(self.code, [t.id for piece in found for t in self.model.tokenize(_letters(piece))]).tobytes()


def encoder(name: str, dtype: str, added: bool = False) -> Encoder:
    """The worker's encoder of a vocabulary; ``byte_``: byte level, which keeps white space."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return once(("encoder", name, dtype, added), lambda: Encoder(name, dtype, os.path.basename(name).startswith("byte_"), added))
