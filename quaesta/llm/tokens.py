"""Token ids of whole texts by the lower-case word BPE, as little-endian u16.

ASCII white space always separates this tokenizer's words, so a text's ids are those of
its space-separated pieces one after the other. Workers keep the ids of pieces they have seen,
in a cache of bounded size; those met first in a batch are encoded together.
"""

from __future__ import annotations

import os
import re
import sys
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from .bpe import Merger
from .common import CACHES, enter, settle

END_ID = 1
#: Pieces a worker remembers; the cache is emptied when full.
MAX_PIECES = 1_200_000
#: Bytes of text that are encoded at once.
BATCH_BYTES = 6 << 20
#: How the tokenizer cuts a piece: runs of letters, single digits, runs of anything else but white space (of ASCII's, none is left in a piece).
_ASCII_RUNS = re.compile(rb"[a-z]+|[0-9]|[^a-z0-9]+")
_RUNS = regex.compile(r"\p{L}+|\p{N}|[^\p{L}\p{N}\x85\xA0]+")


def default_vocabulary() -> str:
    """Path of the vocabulary file; a parameter everywhere it is used."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, int]:
    """Byte to letter, as byte-level BPE writes them: printable bytes are themselves, the others follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: b for b in own} | {b: 256 + i for i, b in enumerate(rest)}


class _Pieces(dict):
    """Piece -> ids. A piece that is met first gets an empty value, which ``resolve`` fills for all of them at once."""

    def __init__(self, tok):
        super().__init__()
        self.tok, self.new = tok, []
        self.words = Merger(tok, _byte_letters())

    def __missing__(self, piece: bytes) -> bytearray:
        slot = self[piece] = bytearray()
        self.new.append((piece, slot))
        return slot

    def resolve(self) -> None:
        todo, words, self.new, counts = self.new, [], [], []
        for piece, _ in todo:
            if piece.isalpha():
                words.append(piece), counts.append(1)
            elif piece[:-1].isalpha() and piece[-1] in b".,;:":
                words += (piece[:-1], piece[-1:])
                counts.append(2)
            elif piece.isascii():
                if b"'" in piece:
                    counts.append(-1)
                else:
                    runs = _ASCII_RUNS.findall(piece)
                    words += runs
                    counts.append(len(runs))
            else:
                text = piece.decode("utf-8", "replace")
                if max(text) < "\u0250" and "'" not in text and "\u0130" not in text:
                    text = text.lower()
                    runs = (text.encode(),) if text.isalpha() else [x.encode() for x in _RUNS.findall(text)]
                    words += runs
                    counts.append(len(runs))
                else:
                    counts.append(-1)
        raw = self.words.encode(words)
        at = 0
        for (piece, slot), n in zip(todo, counts, strict=True):
            if n == 1:
                ids = raw[at]
            elif n >= 0:
                ids = b"".join(raw[at : at + n])
            else:
                ids = array("H", self.tok.encode(piece.decode("utf-8", "replace"), add_special_tokens=False).ids).tobytes()
            at += max(n, 0)
            slot[:] = ids  # where texts of this batch hold it
            self[piece] = ids


class WordTokenizer:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.size = self.tok.get_vocab_size()
        if self.size > 1 << 16 or array("H").itemsize != 2 or sys.byteorder != "little":
            raise ValueError("ids are kept in two bytes, the lower first")
        self.seen = _Pieces(self.tok)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; a null text has none."""
        get, found = self.seen.__getitem__, []
        for t in texts:
            raw = (t or "").encode("utf-8", "replace")
            # a control string may stand in a text: the tokenizer itself has to see it whole
            if b"<|" in raw:
                found.append([array("H", self.tok.encode(t, add_special_tokens=False).ids).tobytes()])
            else:
                found.append(list(map(get, raw.lower().split())))
        self.seen.resolve()
        out = [b"".join(x) for x in found]
        if len(self.seen) >= MAX_PIECES:
            self.seen.clear()
        return out


_LOADED: dict[str, WordTokenizer] = {}
CACHES["tokens"] = _LOADED.clear


def load(path: str) -> WordTokenizer:
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]


def slices(batch: pa.RecordBatch, column: int, most: int = BATCH_BYTES):
    """Parts of a batch whose texts have some ``most`` bytes together; a longer text is a part of its own."""
    held = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(held, (held[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def token_batches(path: str, end_id: int | None):
    """For mapInArrow over ``(doc_id, text)``: the same ids with ``ids`` binary (u16) and, where asked for, the end id."""
    end = b"" if end_id is None else np.array([end_id], "<u2").tobytes()

    def run(batches):
        enter("tokens")
        tok = load(path)
        for batch in batches:
            for part in slices(batch, 1):
                ids = [x + end for x in tok.encode(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.large_binary()).cast(pa.binary())], ["doc_id", "ids"])
        settle()

    return run
