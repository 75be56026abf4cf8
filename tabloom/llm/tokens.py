"""Token ids of whole texts with a byte-level BPE vocabulary, with a bounded memo of recurring pre-tokens."""

from __future__ import annotations

import json

import numpy as np
import tiktoken
from tokenizers import Tokenizer

#: The pre-tokens of byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MEMO_SIZE = 300_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_symbols() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Pieces(dict):
    """piece -> bytes of its little-endian unsigned 32-bit ids. A piece is what stands between single spaces.

    Where a space has no white space beside it, pre-tokens never reach across it, so a text's ids are those of its
    pieces, each with the space before it; other texts are encoded whole.
    """

    def __init__(self, path: str | None = None):
        super().__init__()
        path = path or default_path()
        spec = json.load(open(path, encoding="utf-8"))
        symbols = _byte_symbols()
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(symbols[c] for c in piece): rank for piece, rank in spec["model"]["vocab"].items() if piece not in added}
        self.fast = tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.full, self.added = Tokenizer.from_file(path), list(added)
        self._piece, self._text = self.fast._core_bpe.encode_single_piece, self.fast.encode_ordinary

    def __missing__(self, piece: str) -> bytes:
        ids = self._piece(b" " + piece.encode()) if piece.isalpha() else self._text(" " + piece)
        if len(self) >= MEMO_SIZE:
            self.clear()
        self[piece] = out = np.array(ids, "<u4").tobytes()
        return out

    def whole(self, text: str) -> bytes:
        if any(a in text for a in self.added):  # as the full tokenizer reads them
            return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return np.array(self._text(text), "<u4").tobytes()

    def pieces(self, text: str) -> list[str] | None:
        """The pieces of a text that can be encoded so; all but the first had a space before them."""
        out = text.split(" ")
        if any(not p or p[0].isspace() or p[-1].isspace() for p in out) or any(a in text for a in self.added):
            return None
        return out

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        pieces = self.pieces(text)
        if pieces is None:
            return self.whole(text)
        return self.whole(pieces[0]) + b"".join(map(self.__getitem__, pieces[1:]))


_shared: dict[str | None, Pieces] = {}


def shared(path: str | None = None) -> Pieces:
    """One memo per worker process and vocabulary."""
    if path not in _shared:
        _shared[path] = Pieces(path)
    return _shared[path]
