"""Token counts of a unigram vocabulary: forward scores over a trie of the distinct pre-tokens."""

from __future__ import annotations

import gc
import math
import re
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

#: Trie nodes that a task holds at most; it then starts anew.
MAX_NODES = 200_000
#: Longer pre-tokens are scored by themselves and leave no nodes.
MAX_SHARED = 200
#: How much less likely than the last piece a byte of an unknown character is, as a logarithm.
UNKNOWN = 10.0

#: A run of non-white characters with the blank before it, or any other white space character.
_PRE_TOKEN = re.compile(r" ?\S+|\s")


def unigram_scores(path: str) -> dict[str, float]:
    """The log-probability of each ordinary piece of a vocabulary file.

    The file has ranks and no frequencies, so they follow Zipf's law: the
    piece of rank r has a share of 1 / (r + 1).
    """
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    special = lambda k: model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k)
    pieces = [model.id_to_piece(k) for k in range(model.get_piece_size()) if not special(k)]
    total = math.log(sum(1 / r for r in range(1, len(pieces) + 1)))
    return {p: -math.log(r) - total for r, p in enumerate(pieces, 1)}


def pre_tokens(text: str | None) -> list[str]:
    """The text with a blank before it, cut into pre-tokens; none of a null or empty text."""
    return _PRE_TOKEN.findall(" " + text) if text else []


def piece_tree(scores: dict[str, float]) -> dict:
    """The pieces as nested dicts by letter; a piece's score is under None where it ends."""
    tree: dict = {}
    for piece, score in scores.items():
        at = tree
        for letter in piece:
            at = at.setdefault(letter, {})
        at[None] = score
    return tree


class Node:
    """What the best segmentation of one prefix scores, of how many tokens it is, and the pieces under way.

    A piece under way is where it stands in the piece tree, with the score and
    count of the prefix that it began behind.
    """

    __slots__ = ("children", "count", "score", "under_way")

    def __init__(self, score: float, count: int, under_way: list):
        self.children: dict[str, Node] = {}
        self.score, self.count, self.under_way = score, count, under_way


class TokenTrie(dict):
    """Counts of distinct pre-tokens.

    A pre-token that is asked for the first time is inserted: nodes that
    another one has made are walked, and each new node's forward score comes
    from the pieces under way in the one above it, so a shared prefix is scored
    once.  Its end's count is kept under the pre-token.  Of equal scores the one
    with fewer tokens is taken.
    """

    def __init__(self, scores: dict[str, float], max_nodes: int = MAX_NODES):
        super().__init__()
        self.tree, self.max_nodes = piece_tree(scores), max_nodes
        self.byte = min(scores.values(), default=0.0) - UNKNOWN
        self.root, self.nodes = Node(0.0, 0, []), 0

    def __missing__(self, token: str) -> int:
        word, shared = token.replace(" ", "▁"), len(token) <= MAX_SHARED
        if self.nodes > self.max_nodes:
            self.clear()
            self.root, self.nodes = Node(0.0, 0, []), 0
        at = self.root
        for letter in word:
            node = at.children.get(letter) if shared else None
            if node is None:
                node = self._after(at, letter)
                if shared:
                    at.children[letter] = node
                    self.nodes += 1
            at = node
        if shared:
            self[token] = at.count
        return at.count

    def _after(self, at: Node, letter: str) -> Node:
        """The prefix of ``at`` and one more letter."""
        best, count, under_way = -math.inf, 0, []
        for stand, score, n in (*at.under_way, (self.tree, at.score, at.count)):
            stand = stand.get(letter)
            if stand is not None:
                under_way.append((stand, score, n))
                piece = stand.get(None)
                if piece is not None and (score + piece > best or (score + piece == best and n + 1 < count)):
                    best, count = score + piece, n + 1
        if None not in self.tree.get(letter, ()):
            size = len(letter.encode("utf-8", "surrogatepass"))
            total = at.score + size * self.byte
            if total > best or (total == best and at.count + size < count):
                best, count = total, at.count + size
        return Node(best, count, under_way)


def count_tokens(docs: DataFrame, scores: dict[str, float], max_nodes: int = MAX_NODES) -> DataFrame:
    """doc_id, n_pretokens and n_tokens of each row's whole text.

    Tasks count by themselves, each with a trie of bounded size, so nothing is
    shuffled.  Characters that are no piece count a token for each UTF-8 byte.
    """
    held = docs.sparkSession.sparkContext.broadcast(scores)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = TokenTrie(held.value, max_nodes)
        gc.disable()  # a trie has no cycles, and searching it for some takes as long as building it
        try:
            for batch in batches:
                parts, tokens = [], []
                for text in batch.column(1):
                    found = pre_tokens(text.as_py())
                    parts.append(len(found))
                    tokens.append(sum(map(trie.__getitem__, found)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(parts, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_pretokens", "n_tokens"]
                )
        finally:
            gc.enable()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(count, "doc_id long, n_pretokens long, n_tokens long")
