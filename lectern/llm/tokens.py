"""Token ids of whole texts by a public vocabulary of the ``tokenizers`` library, block by block.

In this vocabulary's own rule no piece spans a blank, runs of letters, single digits and runs of signs are pieces, and
letters are lower-cased. Texts are cut so by byte classes; every distinct piece of a block is encoded once by the
tokenizer's model and its ids are dealt out by number. A part between blanks with anything else (a character that is
neither ASCII nor a Latin-1 letter, a control character, an apostrophe, or ``<|`` as in the names of special tokens) goes
whole through the tokenizer itself. So the ids are those of ``encode(text, add_special_tokens=False)``. From one block to
the next a task keeps the ids of short pieces, a bounded number of them; the others are encoded again.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
import public_tokenizers

VOCABULARY = "word_bpe_49k.json"
END = 2
# A block takes about thirty times its bytes while it is cut, so this bounds a worker.
BLOCK_BYTES = 1 << 19
# Pieces whose ids are kept: at most twice this number, of at most these bytes each (about 150 bytes in all for a usual one).
KNOWN, KNOWN_BYTES = 1 << 16, 32

_BLANK, _LETTER, _DIGIT, _SIGN, _OTHER = range(5)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[33:127] = _SIGN
_CLASS[[*range(65, 91), *range(97, 123)]] = _LETTER
_CLASS[48:58] = _DIGIT
_CLASS[[9, 10, 11, 12, 13, 32]] = _BLANK
_CLASS[ord("'")] = _OTHER
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# Lead byte of the letters from U+00C0 to U+00FF, and the two signs among them.
_LATIN, _TIMES, _DIVIDED = 0xC3, 0x97, 0xB7


def _byte_characters() -> dict[int, str]:
    """The vocabulary writes bytes as characters: printable ones as themselves, the others in order from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}


_CHARACTERS = _byte_characters()


def _classes(raw: np.ndarray) -> np.ndarray:
    """Class of every byte."""
    kind = _CLASS[raw]
    lead = np.flatnonzero(raw == _LATIN)
    second = raw[lead + 1]
    letter = lead[(second != _TIMES) & (second != _DIVIDED)]
    kind[letter] = kind[letter + 1] = _LETTER
    bar = np.flatnonzero(raw[1:] == ord("|"))
    kind[bar[raw[bar] == ord("<")]] = _OTHER
    return kind


def _lowered(raw: np.ndarray, kind: np.ndarray) -> np.ndarray:
    out = _LOWER[raw]
    lead = np.flatnonzero((raw == _LATIN) & (kind == _LETTER)) + 1
    out[lead[raw[lead] < 0x9F]] += 32
    return out


def path(vocabulary: str | None = None) -> str:
    return vocabulary or public_tokenizers.path(VOCABULARY)


class Ids:
    """Encoder of one task."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.model = self.tokenizer.model
        # Packed ids of the latest pieces, and of those that were the latest before.
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _whole(self, part: bytes) -> list[int]:
        return self.tokenizer.encode(part.decode("utf-8"), add_special_tokens=False).ids

    def _plain(self, piece: bytes) -> list[int]:
        text = piece.decode("ascii") if piece.isascii() else piece.decode("latin-1").translate(_CHARACTERS)
        return [t.id for t in self.model.tokenize(text)]

    def _packed(self, pieces: list[bytes], through: np.ndarray) -> list[bytes]:
        """Ids of every piece as unsigned 32-bit integers; those that are ``through`` go whole through the tokenizer."""
        out = list(map(self.known.get, pieces))
        for i in np.flatnonzero(through).tolist():
            out[i] = array("I", self._whole(pieces[i])).tobytes()
        for i, ids in enumerate(out):
            if ids is None:
                piece = pieces[i]
                out[i] = ids = self.older.get(piece) or array("I", self._plain(piece)).tobytes()
                if len(piece) <= KNOWN_BYTES:
                    self.known[piece] = ids
                    if len(self.known) >= KNOWN:
                        self.older, self.known = self.known, {}
        return out

    def block(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, bounds)`` of a block of texts without nulls: text ``i`` has ``ids[bounds[i]:bounds[i + 1]]``, with its end."""
        texts = texts.cast(pa.large_string())
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
        bounds = bounds - bounds[0]
        kind = _classes(raw)
        starts, ends, odd = _pieces(kind, bounds)
        size = ends - starts
        at = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(size, out=at[1:])
        chars = _lowered(raw, kind)
        if odd.any():
            whole = np.repeat(odd, size)
            take = np.repeat(starts - at[:-1], size) + np.arange(at[-1])
            chars = np.where(whole, raw[take], chars[take])
        else:
            chars = chars[np.repeat(starts - at[:-1], size) + np.arange(at[-1])]
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(chars)]).dictionary_encode()
        number = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        through = np.zeros(len(words.dictionary), bool)
        through[number[odd]] = True
        got = self._packed(words.dictionary.to_numpy(zero_copy_only=False).tolist(), through)
        n_of = np.fromiter(map(len, got), np.int64, len(got)) // 4
        flat = np.frombuffer(b"".join(got), np.uint32)
        first = np.cumsum(n_of) - n_of
        # Ids before every piece, then before every text.
        n = n_of[number]
        before = np.zeros(len(n) + 1, np.int64)
        np.cumsum(n, out=before[1:])
        ids = flat[np.repeat(first[number] - before[:-1], n) + np.arange(before[-1])]
        own = before[np.searchsorted(starts, bounds)]
        out = np.empty(len(ids) + len(texts), dtype="<u4")
        ends_at = own + np.arange(len(own))
        place = np.ones(len(out), bool)
        place[ends_at[1:] - 1] = False
        out[place] = ids
        out[ends_at[1:] - 1] = END
        return out, ends_at

    def blocks(self, texts: pa.Array, block_bytes: int = BLOCK_BYTES):
        """``(first row, ids, bounds)`` of consecutive blocks of about ``block_bytes``; a longer text is a block of its own."""
        import pyarrow.compute as pc

        size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < len(texts):
            hi = int(np.searchsorted(size, (size[lo - 1] if lo else 0) + block_bytes, "right"))
            hi = min(max(hi, lo + 1), len(texts))
            yield lo, *self.block(texts[lo:hi])
            lo = hi


def _words(kind: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the parts between blanks; a text's bound parts, too."""
    solid = kind != _BLANK
    edge = np.ones(len(kind) + 1, bool)
    edge[1:-1] = solid[1:] != solid[:-1]
    edge[bounds] = True
    cuts = np.flatnonzero(edge)
    keep = solid[cuts[:-1]] if len(kind) else np.zeros(0, bool)
    return cuts[:-1][keep], cuts[1:][keep]


def _pieces(kind: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the pieces of a block, and which of them are whole parts for the tokenizer."""
    if not len(kind):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    edge = np.ones(len(kind) + 1, bool)
    edge[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    edge[bounds] = True
    others = np.flatnonzero(kind == _OTHER)
    hit = np.zeros(0, np.int64)
    if len(others):
        first, last = _words(kind, bounds)
        near = np.unique(np.searchsorted(first, others, "right") - 1)
        hit = first[near]
        inner = np.zeros(len(kind) + 1, np.int64)
        # No edges inside a part with another byte.
        np.add.at(inner, hit + 1, 1)
        np.add.at(inner, last[near], -1)
        edge &= np.cumsum(inner) == 0
    cuts = np.flatnonzero(edge)
    keep = kind[cuts[:-1]] != _BLANK
    return cuts[:-1][keep], cuts[1:][keep], np.isin(cuts[:-1][keep], hit)
