"""Public tokenizers inside tasks: a byte-level BPE and a piece model, kept once for each Python worker."""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np

#: Runs of white space from this length on go to the slower library: the faster one's pattern search gives up on a million.
LONG_BLANK = re.compile(r"\s{100000}")
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for.

    Printable Latin-1 letters are their own byte; the others follow from 256 on.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteBpe:
    """A byte-level BPE of a ``tokenizers`` file.

    Its ids are in the order of its merges, so they are ranks too, and
    ``tiktoken`` gives the same ids several times faster; the few texts that it
    cannot cut go through ``tokenizers``.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        self.path, letters = path, byte_letters()
        special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.pieces = {i: bytes(letters[c] for c in t) for t, i in model["model"]["vocab"].items() if t not in special}
        ranks = {piece: i for i, piece in self.pieces.items()}
        self.fast = tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    @lru_cache(maxsize=2)  # noqa: B019, kept as long as the worker
    def slow(self, special: bool):
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(self.path)
        own.encode_special_tokens = not special
        return own

    def encode(self, text: str, special: bool = False) -> list[int]:
        """The ids; with ``special``, special tokens' strings in the text are these tokens."""
        if len(text) >= 100_000 and LONG_BLANK.search(text):
            return self.slow(special).encode(text, add_special_tokens=False).ids
        return self.fast.encode(text, allowed_special="all") if special else self.fast.encode_ordinary(text)


class Pieces:
    """A sentence-piece model with byte fallback; U+2581 stands for a blank."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = {}
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            one_byte = re.fullmatch(r"<0x([0-9A-F]{2})>", piece)
            self.pieces[i] = bytes([int(one_byte[1], 16)]) if one_byte else piece.replace("▁", " ").encode()

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1)


@lru_cache(maxsize=4)
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


@lru_cache(maxsize=4)
def piece_model(path: str) -> Pieces:
    return Pieces(path)


def sizes_of(pieces: dict[int, bytes]) -> np.ndarray:
    """The number of bytes of each id."""
    out = np.zeros(max(pieces) + 1, np.int64)
    out[list(pieces)] = [len(p) for p in pieces.values()]
    return out
