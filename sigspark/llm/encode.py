"""Exact, cached encoding with the public word_bpe_49k vocabulary."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterable

#: Pieces of these characters only are composed, map byte by byte and split as _PARTS says; others go to the library.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
#: Entries of a worker's two caches, each of at most LONGEST bytes in and as many ids out: some 80 MB together. A full
#: cache starts anew. A piece is cached when it is seen for the second time, so words that occur once take no room.
PIECES, PARTS, LONGEST = 300_000, 400_000, 48
#: Bits that remember which pieces have been seen, one byte each.
SEEN = 1 << 22


def _byte_letters() -> dict[int, str]:
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PieceEncoder:
    """Ids of texts as packed little-endian uint32, the same as the library's encode(text, add_special_tokens=False).

    No token crosses white space, so a piece between ASCII white space that comes again is looked up in a bounded cache.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.pieces: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.seen = bytearray(SEEN)
        self.letters = _byte_letters()

    def _part(self, part: str) -> bytes:
        got = self.parts.get(part)
        if got is None:
            mapped = part if part.isascii() else "".join(self.letters[b] for b in part.encode())
            got = b"".join([t.id.to_bytes(4, "little") for t in self.tokenizer.model.tokenize(mapped)])
            if len(mapped) <= LONGEST:
                if len(self.parts) >= PARTS:
                    self.parts.clear()
                self.parts[part] = got
        return got

    def piece(self, raw: bytes) -> bytes:
        text = raw.decode("utf-8", "replace")
        if _PLAIN.fullmatch(text):
            got = b"".join(map(self._part, _PARTS.findall(text.lower())))
        else:
            got = b"".join(i.to_bytes(4, "little") for i in self.tokenizer.encode(text, add_special_tokens=False).ids)
        if len(raw) <= LONGEST:
            at = hash(raw) % SEEN
            if self.seen[at]:
                if len(self.pieces) >= PIECES:
                    self.pieces.clear()
                self.pieces[raw] = got
            else:
                self.seen[at] = 1
        return got

    def encode(self, texts: Iterable[bytes]) -> Iterable[bytes]:
        get, piece = self.pieces.get, self.piece
        for text in texts:
            yield b"".join([x if (x := get(p)) is not None else piece(p) for p in text.split()])


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encoder(path: str | None = None) -> PieceEncoder:
    """One encoder per worker process and vocabulary file; path None: the public file of the worker's own machine."""
    path = path or default_vocabulary()
    held = sys.__dict__.setdefault("_sigspark_encoders", {})
    if path not in held:
        held[path] = PieceEncoder(path)
    return held[path]
