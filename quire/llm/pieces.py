"""Byte-level BPE with the tokenizers library, a piece of text at a time.

A byte-level model never merges across pre-tokens, so a text's ids are the ids of its pieces in a
row, where a piece is one or more whole pre-tokens.  Texts are cut on the bytes of a whole Arrow
column, at places that surely begin a pre-token:

* where letters, digits and signs of the table below change (but not behind an apostrophe, as
  ``'s`` and the like are one pre-token), or a blank follows one of them;
* before a space that one of them follows: the blanks before it are a pre-token of their own;
* behind a single blank other than a space.

Characters that the table doesn't know are never cut off.  Pieces repeat much: each slice of a column is
dictionary-encoded, each worker keeps a bounded table of pieces that it has seen and asks the
library for new ones in batches.  Texts with the string of an added token go to the library whole.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Letters and signs for which the short pattern and the library's agree.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿŒœŠšŽžŸ"
_SIGNS = "‘’“”–—…«»¡¿£€§°"
PLAIN_ONLY = re.compile(rf"[^\t\n\x0b\x0c\r\x20-\x7e{_LETTERS}{_SIGNS}]")

#: Kinds of characters, and of each code point below 65536; all others are unknown.
UNKNOWN, LETTER, DIGIT, SIGN, APOSTROPHE, SPACE, BLANK = range(7)


def _kinds() -> np.ndarray:
    out = np.full(1 << 16, UNKNOWN, np.uint8)
    for kind, pattern in ((SIGN, rf"[!-~{_SIGNS}]"), (LETTER, f"[{_LETTERS}]"), (DIGIT, "[0-9]"), (APOSTROPHE, "'"), (SPACE, " "), (BLANK, r"[\t\n\x0b\x0c\r]")):
        out[[ord(c) for c in re.findall(pattern, "".join(map(chr, range(0xD800))))]] = kind
    return out


def _pairs(*rules: tuple[tuple[int, ...], tuple[int, ...]]) -> np.ndarray:
    """Whether 8 * kind + next kind is among the rules."""
    out = np.zeros(64, bool)
    for first, then in rules:
        out[[8 * a + b for a in first for b in then]] = True
    return out


KINDS = _kinds()
_BYTE_KINDS = np.where(np.arange(256) < 128, KINDS[:256], UNKNOWN).astype(np.uint8)
_INK = (LETTER, DIGIT, SIGN, APOSTROPHE)
_CHANGE = _pairs(((LETTER,), (DIGIT, SIGN, APOSTROPHE)), ((DIGIT,), (LETTER, SIGN, APOSTROPHE)), ((SIGN,), (LETTER, DIGIT)), ((APOSTROPHE,), (DIGIT,)), (_INK, (SPACE, BLANK)))
_SPACE_INK, _INK_BLANK, _BLANK_INK = _pairs(((SPACE,), _INK)), _pairs((_INK, (BLANK,))), _pairs(((BLANK,), _INK))


def cuts(data: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Where pieces begin in the UTF-8 bytes of texts, row i of them from rows[i] to rows[i + 1]."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    kinds = _BYTE_KINDS[data]
    wide = np.flatnonzero(data >= 0xC2)
    two, three = wide[data[wide] < 0xE0], wide[(data[wide] >= 0xE0) & (data[wide] < 0xF0)]
    if len(two):
        kinds[two] = kinds[two + 1] = KINDS[(data[two] & 31).astype(np.int32) << 6 | data[two + 1] & 63]
    if len(three):
        kinds[three] = kinds[three + 1] = kinds[three + 2] = KINDS[(data[three] & 15).astype(np.int32) << 12 | (data[three + 1] & 63).astype(np.int32) << 6 | data[three + 2] & 63]
    pairs = kinds[:-1] << 3 | kinds[1:]
    begins = np.zeros(n + 1, bool)
    # What follows the last space of a text is another text.
    begins[: n - 1] = _SPACE_INK[pairs]
    begins[np.maximum(rows[1:] - 1, 0)] = False
    begins[1:n] |= _CHANGE[pairs]
    begins[2:n] |= _INK_BLANK[pairs[:-1]] & _BLANK_INK[pairs[1:]]
    begins[rows] = True
    return np.flatnonzero(begins[:n])


def _bytes_of(texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """(where texts begin, and the last ends; their bytes)."""
    rows = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return rows - rows[0], np.frombuffer(texts.buffers()[2] or b"", np.uint8)[rows[0] : rows[-1]]


def _runs(pieces: list[str], size: int) -> Iterator[list[str]]:
    """Runs of pieces of size characters, but for the last piece of each."""
    run, n = [], 0
    for p in pieces:
        run.append(p)
        n += len(p)
        if n >= size:
            yield run
            run, n = [], 0
    if run:
        yield run


class PieceEncoder:
    """Ids of whole texts as little-endian unsigned integers of the given type."""

    def __init__(self, vocabulary: str, dtype: str = "<u4", remembered: int = 800_000, longest: int = 64):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(vocabulary)
        self.model.no_truncation()
        self.model.no_padding()
        self.added = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.parted = not any(" " in a for a in self.added)
        self.code, self.width, self.remembered, self.longest = {"<u2": "H", "<u4": "I"}[dtype], int(dtype[2:]), remembered, longest
        vocab = self.model.get_vocab()
        self.spaced = np.zeros(max(vocab.values()) + 1, bool)
        self.spaced[[i for t, i in vocab.items() if t[0] == "Ġ"]] = True
        self.known: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _piece_ids(self, pieces: list[str], together: int = 1 << 13) -> dict[str, bytes]:
        """Ids of single pieces.  A space and a sure word or sign begin a pre-token wherever they stand, and
        of a piece without further spaces the first token alone begins with one: many such go to the
        library as one text and are parted again at these tokens.  No call is for many more characters
        than together, as the library's own results take some hundred bytes a token."""
        spaced, rest = [], []
        for p in pieces:
            (spaced if p[0] == " " and len(p) > 1 and (p[1].isalnum() or "!" <= p[1] <= "~") and p.find(" ", 1) < 0 and self.parted else rest).append(p)
        out = {}
        for group in _runs(rest, together):
            out.update(zip(group, self._ids(group), strict=True))
        for group in _runs(spaced, together):
            (e,) = self.model.encode_batch_fast(["".join(group)], add_special_tokens=False)
            ids = np.array(e.ids, f"<u{self.width}")
            at = np.append(np.flatnonzero(self.spaced[ids]), len(ids)) * self.width
            data, ends = ids.tobytes(), at.tolist()
            out.update(zip(group, [data[i:j] for i, j in pairwise(ends)], strict=True))
        return out

    def _known_ids(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces."""
        if len(self.known) >= self.remembered:
            # Pieces met first are mostly the frequent ones; they stay.
            self.known = dict(islice(self.known.items(), self.remembered // 2))
        out = list(map(self.known.get, pieces))
        gaps = [i for i, ids in enumerate(out) if ids is None]
        if gaps:
            met = self._piece_ids([pieces[i] for i in gaps])
            for i in gaps:
                out[i] = met[pieces[i]]
            short = ((p, x) for p, x in met.items() if len(p) <= self.longest)
            self.known.update(islice(short, self.remembered - len(self.known)))
        return out

    def _pieced(self, texts: pa.LargeStringArray, end: bytes) -> pa.LargeBinaryArray:
        rows, data = _bytes_of(texts)
        at = cuts(data, rows)
        column = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(np.append(at, len(data))), pa.py_buffer(data)]).dictionary_encode()
        found = pa.array([*self._known_ids(column.dictionary.to_numpy(zero_copy_only=False).tolist()), end], pa.large_binary())
        # The end is a last piece of each text.
        closed = np.searchsorted(at, rows[1:])
        ids = found.take(pa.array(np.insert(column.indices.to_numpy(), closed, len(found) - 1)))
        ends = np.frombuffer(ids.buffers()[1], np.int64)[closed + np.arange(1, len(texts) + 1)]
        return pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(np.append(0, ends)), ids.buffers()[2]])

    def encode_column(self, texts: pa.Array, end: bytes = b"") -> pa.LargeBinaryArray:
        """Ids of each text (null: none), end behind them."""
        texts = texts.fill_null("").cast(pa.large_string())
        if not len(texts):
            return pa.array([], pa.large_binary())
        out, data = self._pieced(texts, end), _bytes_of(texts)[1].tobytes()
        if not any(a.encode() in data for a in self.added):
            return out
        return pa.array([self._ids([t])[0] + end if any(a in t for a in self.added) else x for t, x in zip(texts.to_pylist(), out.to_pylist(), strict=True)], pa.large_binary())

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.encode_column(pa.array(texts, pa.large_string())).to_pylist()


@lru_cache(maxsize=2)
def piece_encoder(vocabulary: str, dtype: str) -> PieceEncoder:
    """One encoder for all tasks of a worker process."""
    return PieceEncoder(vocabulary, dtype)


def text_slices(texts: pa.Array, size: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Runs of rows of about so many bytes; a longer text is a run of its own."""
    ends, i = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while i < len(ends):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + size, "right")))
        yield i, j
        i = j


def slices(n: int, size: int = 256):
    return ((i, min(n, i + size)) for i in range(0, n, size))
