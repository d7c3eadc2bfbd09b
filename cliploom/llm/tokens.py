"""Token ids by a tokenizer of the ``tokenizers`` library, with a memo of repeated pieces.

The pre-tokenizers served here never join across a space or a line end that stands between two
characters that are not white space. So a text may be cut before it, pieces be encoded on their
own, and the ids be joined: they are the same ids as of the whole text. NumPy finds the cuts in the bytes of an Arrow
column, Arrow numbers the distinct pieces, and Python sees only these. Words repeat, so each Python
worker remembers pieces, and words without the marks behind them, in two halves: when the newer is full it becomes the older, and what
is met again moves back.
"""

from __future__ import annotations

import codecs
import os
import string
from array import array
from collections.abc import Callable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from cliploom.llm.textbytes import byte_class, flat

# Pieces in either half of what a worker remembers: about 100 MB in all, which it keeps while it is idle. Vocabularies of words, whose
# workers serve no pipeline, have twice as many.
MEMO = 200_000
_LONG = 200  # longer pieces are not remembered
_MARKS = string.punctuation.replace("'", "")  # an apostrophe may start a contraction
_LETTER = byte_class((0x41, 0x5A), (0x61, 0x7A))
_BLANK = byte_class((0x09, 0x0D), (0x1C, 0x20))
_WIDE_BLANKS = [chr(c).encode() for c in range(0x80, 0x10000) if chr(c).isspace()]
_WIDE_LEADS = byte_class(*((b[0], b[0]) for b in _WIDE_BLANKS))


def _wide_blank(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Whether the ``length`` bytes from each place are a white-space character beyond ASCII."""
    code = np.zeros(len(at), np.int32)
    for i in range(length):
        code = code << 8 | data[np.minimum(at + i, len(data) - 1)]
    return np.isin(code, [int.from_bytes(b) for b in _WIDE_BLANKS if len(b) == length])


def cuts(data: np.ndarray, at: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Places of the spaces and line ends between two characters, of one text, that are not white space, and
    of the ``marks`` behind an ASCII letter.

    ``data`` is the UTF-8 bytes of texts, ``at`` their offsets, ``marks`` a table of 256 flags.
    """
    table = marks.copy()
    table[[0x20, 0x0A]] = True
    found = table[data]
    some = np.diff(at) > 0
    found[at[:-1][some]] = found[at[1:][some] - 1] = False
    places = np.flatnonzero(found)
    before, after, mark = data[places - 1], data[places + 1], marks[data[places]]
    cut = np.where(mark, _LETTER[before], ~(_BLANK[before] | _BLANK[after]))
    right = np.flatnonzero(~mark & _WIDE_LEADS[after])
    left = np.flatnonzero(~mark & (before >= 0x80) & (_WIDE_LEADS[data[places - 2]] | _WIDE_LEADS[data[places - 3]]))
    for length in (2, 3):
        cut[right] &= ~_wide_blank(data, places[right] + 1, length)
        cut[left] &= ~_wide_blank(data, places[left] - length, length)
    return places[cut]


def _byte_alphabet() -> list[str]:
    """Byte-level vocabularies write a printable Latin-1 byte as itself and the others, in order, from U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return [chr(b if b in printable else 0x100 + others.index(b)) for b in range(256)]


class Encoder:
    """Encodes texts to little-endian 32-bit ids as bytes.

    ``spaced``: whether the space before a piece belongs to it (byte-level vocabularies) or is
    dropped. Strings of special tokens inside a text are these tokens, as the library has it, or with
    ``plain_specials`` ordinary text.
    """

    def __init__(self, path: str, spaced: bool, plain_specials: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        self._library.encode_special_tokens = plain_specials
        specials = [t.content for t in self._library.get_added_tokens_decoder().values()]
        self._uncut = [t for t in specials if " " in t and not plain_specials]
        spelled = set() if plain_specials else set("".join(specials))  # no cut is inside a special token
        self._cut_at = byte_class(*((ord(mark), ord(mark)) for mark in _MARKS if mark not in spelled))
        self._normalizer, self._model = self._library.normalizer, self._library.model
        self._spaced = spaced
        alphabet = _byte_alphabet()
        self._space, self._alphabet = alphabet[0x20], "".join(alphabet)
        self._line_end = self._whole("\n")
        self._memo: dict[str, bytes] = {}  # of pieces with the space or line end before them
        self._older: dict[str, bytes] = {}
        self._marks: dict[str, bytes] = {"": b""}

    def _whole(self, text: str) -> bytes:
        return array("I", self._library.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of letters, perhaps with a space before them that belongs to the word."""
        if word.isascii():
            spelled = word.replace(" ", self._space)
        else:
            spelled = codecs.charmap_decode(word.encode(), "strict", self._alphabet)[0]
        return array("I", [t.id for t in self._model.tokenize(spelled)]).tobytes()

    def _known(self, word: str) -> bytes:
        """The same for a word by its piece; it is remembered."""
        known = self._memo.get(word)
        if known is None:
            known = self._older.get(word)
            if known is None:
                known = self._word(word if self._spaced else word[1:])
            if len(word) <= _LONG:
                self._memo[word] = known
        return known

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece. Letters only, perhaps with marks after them, are one word for any
        pre-tokenizer and go straight to the library's model; that takes a quarter of the time."""
        letters = piece.rstrip(_MARKS)
        lead = letters[:1] if letters[:1] in (" ", "\n") else ""
        word = letters[len(lead) :]
        if not word.isalpha():
            return self._whole(piece)
        if self._normalizer:
            word = word.lower() if word.isascii() else self._normalizer.normalize_str(word)
            if not word.isalpha():
                return self._whole(piece)
        marks = piece[len(letters) :]
        if marks not in self._marks:
            if len(self._marks) > 10_000:
                self._marks = {"": b""}
            self._marks[marks] = self._whole(marks)
        own = " " + word if lead == " " or not self._spaced else word
        if own == piece:  # which is not remembered
            return self._word(own if self._spaced else word)
        ids = self._known(own) + self._marks[marks]
        return self._line_end + ids if lead == "\n" else ids

    def _pieces(self, pieces: list[str], end: bytes) -> list[bytes]:
        """Ids of distinct pieces; of the empty one, ``end``. What only the older half has moves to the newer."""
        if len(self._memo) > (MEMO if self._spaced else 2 * MEMO):
            self._memo, self._older = {}, self._memo
        memo, older = self._memo, self._older
        found = list(map(memo.get, pieces))
        for i in [i for i, ids in enumerate(found) if ids is None]:
            piece = pieces[i]
            ids = older.get(piece)
            if ids is None:
                ids = self._piece(piece) if piece else end
            found[i] = ids
            if 0 < len(piece) <= _LONG:
                memo[piece] = ids
        return found

    def encode_column(self, texts: pa.Array, end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """Ids of a string column, each text's followed by those of ``end``, and their offsets (one more than
        texts). A null text is an empty one."""
        data, at = flat(texts)
        inner = cuts(data, at, self._cut_at)
        closing = 1 + (np.diff(at) > 0)  # an empty piece closes each text; empty texts have no other
        places = np.sort(np.concatenate([at[:1], inner, np.repeat(at[1:], closing)]), kind="stable").astype(np.int32)
        bounds = np.r_[0, np.cumsum(np.diff(np.searchsorted(inner, at)) + closing)]
        pieces = pa.StringArray.from_buffers(len(places) - 1, pa.py_buffer(places), pa.py_buffer(data))
        numbered = pieces.dictionary_encode()
        found = self._pieces(numbered.dictionary.to_numpy(zero_copy_only=False).tolist(), end)
        lengths = np.fromiter(map(len, found), np.int32, len(found)) // 4
        starts = np.cumsum(lengths, dtype=np.int32) - lengths
        codes = numbered.indices.to_numpy()
        own = lengths[codes]
        after = np.cumsum(own)
        place = np.repeat(starts[codes] - (after - own).astype(np.int32), own)
        place += np.arange(len(place), dtype=np.int32)
        ids = np.frombuffer(b"".join(found), "<u4")[place]
        offsets = np.r_[0, after][bounds]
        uncut = [i for special in self._uncut for i in pc.indices_nonzero(pc.match_substring(texts, special)).to_pylist()]
        if uncut:
            parts = np.split(ids, offsets[1:-1])
            for i in uncut:
                parts[i] = np.frombuffer(self._whole(texts[i].as_py()) + end, "<u4")
            ids, offsets = np.concatenate(parts), np.r_[0, np.cumsum([len(part) for part in parts])]
        return ids, offsets

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as bytes; of a null one, none."""
        ids, at = self.encode_column(pa.array(texts, pa.string()))
        return [ids[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]


_encoders: dict[tuple[str, bool, bool], Encoder] = {}


def encoder(path: str, spaced: bool, plain_specials: bool = False) -> Encoder:
    """The worker's encoder for a vocabulary file; it lives as long as the worker."""
    key = (path, spaced, plain_specials)
    if key not in _encoders:
        _encoders[key] = Encoder(path, spaced, plain_specials)
    return _encoders[key]


def word_encoder(path: str, plain_specials: bool = False) -> Encoder:
    """For vocabularies that lower-case and drop white space."""
    return encoder(path, False, plain_specials)


def byte_encoder(path: str, plain_specials: bool = False) -> Encoder:
    """For byte-level vocabularies whose pieces carry the space before them."""
    return encoder(path, True, plain_specials)


Ids = TypeVar("Ids")


def encoded(
    batches: Iterator[pa.RecordBatch], text: str, encode: Callable[[pa.Array], Ids], size: int = 2 << 20
) -> Iterator[tuple[pa.RecordBatch, Ids]]:
    """Slices of the batches of about ``size`` bytes of text, with the ids of their texts."""
    for batch in batches:
        column = batch.column(text)
        lengths = np.cumsum([0, *(n or 0 for n in pc.binary_length(column).to_pylist())])
        first = 0
        while first < batch.num_rows:
            end = max(first + 1, int(np.searchsorted(lengths, lengths[first] + size, "right")) - 1)
            part = batch.slice(first, end - first)
            yield part, encode(part.column(text))
            first = end
