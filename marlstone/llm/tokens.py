"""Exact token ids of a public word BPE, cached by piece.

The vocabulary's normaliser and splitter never let a token reach across an ASCII space or line feed
(white space is dropped, NFC and case folding act within a chunk), so a text's ids are the
concatenation of its chunks' ids.  A chunk of plain Latin letters and trailing ASCII marks is two
pieces for the splitter: its word in small letters, which goes straight to the BPE model, and its
marks.  All other chunks go through the whole tokenizer.

``runs`` takes some MB of texts at a time: numpy cuts them into pieces (an ASCII word, or any other
chunk, and what follows it up to the next chunk), Arrow finds the distinct pieces (by their characters,
not by hashes), and Python looks at each of those once.  The cache has two generations, of which the
older is dropped when the younger is full.  Sizes of caches and runs change speed, never results.
"""

from __future__ import annotations

import re
import struct

import numpy as np
import pyarrow as pa

from . import textvec as tv
from .common import slices, utf8_view
from .repeats import ragged

_PLAIN = re.compile("([a-zß-öø-ɏ]+)([!-/:-@\\[-`{-~]*)")
_LOADED: dict[str, "ChunkTokenizer"] = {}
#: Entries of a generation; characters of the longest entry; bytes of text whose distinct pieces are sought at once.
CACHE_PIECES, LONGEST, RUN_BYTES = 500_000, 64, 4 << 20
#: Chunks are runs of anything but spaces and line feeds.
CHUNK = tv.byte_class(lambda b: b not in (32, 10))
_LETTER, _ = tv.byte_class(lambda b: 97 <= b <= 122, lower=True)
_MARK, _ = tv.byte_class(lambda b: 33 <= b <= 126 and not chr(b).isalnum())


class Kept(dict):
    """A cache of two generations: when the younger is full it takes the older one's place."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key: str) -> bytes:
        out = self.old.get(key)
        if out is None:
            out = self.make(key)
        if len(key) <= LONGEST:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = out
        return out


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(spare)) for b in range(256)]


class ChunkTokenizer:
    """Text -> its ids as little-endian uint32 bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.letters = {b: c for b, c in enumerate(_byte_letters())}
        self.pieces = Kept(self._made, CACHE_PIECES)

    def _word(self, spelled: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(spelled)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _made(self, piece: str) -> bytes:
        if piece.isascii() and piece.isalpha() and piece.islower() and len(piece) <= LONGEST:
            return self._word(piece)
        piece = piece.strip(" \n")
        plain = _PLAIN.fullmatch(piece.lower()) if len(piece) <= LONGEST else None
        if plain and plain[1] != piece:  # capitals or trailing marks: made from simpler pieces
            return self.pieces[plain[1]] + (self.pieces[plain[2]] if plain[2] else b"")
        if plain:
            return self._word(piece.encode().decode("latin-1").translate(self.letters))
        ids = self.whole.encode(piece, add_special_tokens=False).ids if piece else []
        return struct.pack(f"<{len(ids)}I", *ids)

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        return b"".join(map(self.pieces.__getitem__, text.replace("\n", " ").split(" ")))

    def runs(self, column: pa.Array, end_id: int):
        """(first text, ids, offsets) of some MB of texts at a time, ``end_id`` behind each text; nulls are empty."""
        raw, offsets = utf8_view(column)
        for i, j in slices(offsets, RUN_BYTES):
            data, off = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            starts, ends, first = tv.words(data, off, CHUNK)
            cuts = piece_cuts(data, starts, ends)
            text = tv.SPACED_LOWER[1][data]
            whole = np.flatnonzero(cuts[1::2] == ends)  # chunks that are one piece keep their capitals
            own = ragged(starts[whole], ends[whole] - starts[whole])
            text[own] = data[own]
            pieces = pa.LargeStringArray.from_buffers(2 * len(starts), pa.py_buffer(cuts), pa.py_buffer(text))
            coded = pieces.dictionary_encode()
            made = [*map(self.pieces.__getitem__, coded.dictionary.to_pylist()), struct.pack("<I", end_id)]
            which = np.insert(np.asarray(coded.indices), 2 * first[1:], len(made) - 1)
            size = np.fromiter(map(len, made), np.int64, len(made)) // 4
            at, count = np.cumsum(size) - size, size[which]
            ids = np.frombuffer(b"".join(made), "<u4")[ragged(at[which], count)]
            yield i, ids, np.concatenate(([0], np.cumsum(count)[2 * first[1:] + np.arange(j - i)]))


def piece_cuts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Offsets of two pieces for each chunk: its ASCII word if marks follow (else all of it), and the rest up to the next chunk."""
    cuts = np.full(2 * len(starts) + 1, len(data), np.int64)
    cuts[:-1:2] = starts
    if len(starts):
        letter, mark = _LETTER[data], _MARK[data]
        begins = letter.copy()
        begins[1:] &= ~letter[:-1]
        begins[starts] = letter[starts]
        letters, marks, words = (np.add.reduceat(x.view(np.uint8), starts, dtype=np.int32) for x in (letter, mark, begins))
        two = (letters + marks == ends - starts) & (words == 1) & letter[starts] & (letters <= LONGEST)
        cuts[1::2] = np.where(two, starts + letters, ends)
    return cuts


def load(path: str) -> ChunkTokenizer:
    """One tokenizer for each worker process and file."""
    if path not in _LOADED:
        _LOADED[path] = ChunkTokenizer(path)
    return _LOADED[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
