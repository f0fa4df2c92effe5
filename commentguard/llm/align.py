"""Alignment of two tokenizers: common ends by galloping search, and how well a corpus supports each link."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from commentguard.llm.tokens import byte_bpe, piece_model, sizes_of
from commentguard.operators.ranks import salted_join
from commentguard.plans.shared import written

#: Ends of the shorter list that are searched together.
STRIDE = 128
#: Links from which on a block of documents is closed.
BLOCK_LINKS = 500_000
#: Blocks that ask for the same pair in one task at most.
BLOCKS_PER_SALT = 100_000

_LISTS = ("a_ids", "b_ids", "a_cuts", "b_cuts", "b_from", "b_to")
_SCHEMA = (
    "a_ids array<int>, b_ids array<int>, a_cuts array<int>, b_cuts array<int>, b_from array<int>, b_to array<int>, "
    "`groups` string, block long, links binary, pairs array<long>, pair_counts array<long>"
)


def galloping_ranks(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """For each value of ``short`` how many values of ``long`` are smaller; both ascend.

    The shorter list drives: for every stretch of it the step from the last
    place doubles until it passes the stretch's last value, and the stretch is
    found by binary search in between.
    """
    ranks, at, n = np.empty(len(short), np.int64), 0, len(long)
    for start in range(0, len(short), STRIDE):
        stretch, step = short[start : start + STRIDE], 1
        while at + step < n and long[at + step] < stretch[-1]:
            step *= 2
        ranks[start : start + STRIDE] = at + np.searchsorted(long[at : at + step + 1], stretch)
        at = int(ranks[start + len(stretch) - 1])
    return ranks


def common_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of two ascending lists of ends: the places in ``a`` and in ``b`` of the common ones, and the overlaps.

    The overlaps are, for each span of ``a``, from which to before which span of
    ``b`` it shares bytes with: differences of ranks.
    """
    if len(a) <= len(b):
        below = galloping_ranks(a, b)  # ends of b before each end of a
        shared = (below < len(b)) & (b[np.minimum(below, len(b) - 1)] == a) if len(b) else np.zeros(len(a), bool)
        in_a, in_b = np.flatnonzero(shared), below[shared]
        up_to = below + shared
    else:
        ranks = galloping_ranks(b, a)
        shared = (ranks < len(a)) & (a[np.minimum(ranks, len(a) - 1)] == b) if len(a) else np.zeros(len(b), bool)
        in_a, in_b = ranks[shared], np.flatnonzero(shared)
        up_to = np.cumsum(np.bincount(ranks, minlength=len(a)))[: len(a)]
        below = up_to.copy()
        below[in_a] -= 1
    return in_a, in_b, np.r_[0, up_to[:-1]].astype(np.int64)[: len(a)], np.minimum(below + 1, len(b))


class Aligner:
    """Both tokenizers, and the strings by which groups are written."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = byte_bpe(a_path), piece_model(b_path)
        self.a_size, self.b_size = sizes_of(self.a.pieces), sizes_of(self.b.pieces)
        self.shift = len(self.a_size)
        names = [f"{i}{mark}" for mark, n in ((",", self.shift), ("|", self.shift), (",", len(self.b_size)), (";", len(self.b_size))) for i in range(n)]
        self.names = np.array(names, object)

    def ids(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Both tokenizers' ids of a blank and the text; none where their bytes are not just that."""
        none = np.empty(0, np.int64)
        if not text:
            return none, none
        data, a, b = f" {text}".encode(), self.a.encode(f" {text}"), self.b.encode(text)
        if b"".join(map(self.a.pieces.get, a)) != data or b"".join(map(self.b.pieces.get, b)) != data:
            return none, none
        return np.array(a, np.int64), np.array(b, np.int64)

    def line(self, a: np.ndarray, b: np.ndarray, a_cuts: np.ndarray, b_cuts: np.ndarray) -> str:
        """``a1,a2|b1;a3|b2,b3``: the ids of each group of either side."""
        places = np.empty(len(a) + len(b), np.int64)
        groups = np.arange(len(a_cuts))
        a_code, b_code = a.copy(), b + 2 * self.shift
        a_code[a_cuts - 1] += self.shift
        b_code[b_cuts - 1] += len(self.b_size)
        places[np.arange(len(a)) + np.r_[0, b_cuts][np.repeat(groups, np.diff(a_cuts, prepend=0))]] = a_code
        places[np.arange(len(b)) + a_cuts[np.repeat(groups, np.diff(b_cuts, prepend=0))]] = b_code
        return "".join(self.names[places].tolist())[:-1]


def _listed(arrays: list[np.ndarray], kind) -> pa.Array:
    values = np.concatenate(arrays) if arrays else np.empty(0, np.int64)
    offsets = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def align_tokens(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """The two tokenizations of each text of ``docs`` (doc_id, text), and how they fit together.

    ``a_path`` is a byte-level BPE, ``b_path`` a piece model; both cut a blank
    and the text, special tokens' strings being plain text.  Returns doc_id and

    * a_ids, b_ids: the tokens;
    * a_cuts, b_cuts: after how many tokens of either side each group ends; a
      group ends where tokens of both end at the same byte, and these two are
      linked;
    * b_from, b_to: for each token of A the tokens of B it shares bytes with;
    * groups: the groups' ids as ``a1,a2|b1;a3|b2,b3``;
    * block, links, pairs, pair_counts: see ``link_support``.

    Texts that are null or empty, or that a tokenizer does not give back byte by
    byte, have no tokens: empty lists and an empty line.  Rows keep their number
    and may repeat; other columns of ``docs`` are not read.
    """

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, block = Aligner(a_path, b_path), TaskContext.get().partitionId(), 0
        ids, rows, links, total = [], [], [], 0

        def closed() -> Iterator[pa.RecordBatch]:
            nonlocal ids, rows, links, total, block
            pairs, codes, counts = np.unique(np.concatenate(links), return_inverse=True, return_counts=True)
            codes = codes.astype(np.uint16 if len(pairs) <= 1 << 16 else np.uint32)
            bounds = np.cumsum([0, *map(len, links)]).tolist()
            number = (part << 32) + block
            for start in range(0, len(rows), 512):
                some = slice(start, start + 512)
                n = len(rows[some])
                lists = [_listed([r[k] for r in rows[some]], pa.int32()) for k in range(len(_LISTS))]
                packed = [codes[x:y].tobytes() for x, y in zip(bounds[start : start + n], bounds[start + 1 : start + n + 1], strict=True)]
                first = [pairs if start == 0 else None, *[None] * (n - 1)]
                first_counts = [counts if start == 0 else None, *[None] * (n - 1)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[some], id_type), *lists, pa.array([r[-1] for r in rows[some]], pa.string()), pa.array(np.full(n, number)),
                     pa.array(packed, pa.binary()), pa.array(first, pa.list_(pa.int64())), pa.array(first_counts, pa.list_(pa.int64()))],
                    ["doc_id", *_LISTS, "groups", "block", "links", "pairs", "pair_counts"],
                )
            ids, rows, links, total, block = [], [], [], 0, block + 1

        for batch in batches:
            id_type = batch.column(0).type
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                a, b = own.ids(text.as_py())
                in_a, in_b, b_from, b_to = common_ends(np.cumsum(own.a_size[a]), np.cumsum(own.b_size[b]))
                line = own.line(a, b, in_a + 1, in_b + 1) if len(a) else ""
                ids.append(name)
                rows.append((a, b, in_a + 1, in_b + 1, b_from, b_to, line))
                links.append(a[in_a] << 32 | b[in_b])
                total += len(in_a)
                if total >= BLOCK_LINKS or len(ids) >= BLOCK_LINKS // 10:
                    yield from closed()
        if ids:
            yield from closed()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(align, f"doc_id {kind}, {_SCHEMA}")


def link_support(aligned: DataFrame, keep: dict[str, Column]) -> DataFrame:
    """``keep`` of each row of ``align_tokens``, and how often the whole corpus has each of its links.

    Adds link_counts (for each link how many links of the corpus join its two
    ids) and link_best (whether no other A id has more links with its B id), and
    their sums n_links, n_best and count_sum.

    Documents come in blocks, each with its distinct pairs of ids and their
    numbers on its first row.  These are added up; then each block asks once for
    the counts of its own pairs.  What moves are distinct pairs of blocks, never
    single links, and no task or broadcast holds all pairs.
    """
    spread = [c for c in ("block", "links", "pairs", "pair_counts") if c not in keep]
    table = written(aligned.select(*[c.alias(n) for n, c in keep.items()], *spread), "aligned")
    asked = table.where("pairs is not null").select(F.col("block").alias("asker"), F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("pair_counts").alias("n"))))
    counts = written(asked.groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    most = counts.groupBy(F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b")).agg(F.max("n").alias("most"))
    best = counts.withColumn("b", F.col("pair").bitwiseAND(0xFFFFFFFF)).join(most, "b")
    best = best.select("pair", F.col("n").alias("count"), (F.col("n") == F.col("most")).alias("best"))
    blocks = table.where("pairs is not null").count()
    answers = salted_join(asked.select("asker", "pair"), best, "pair", ["asker"], salts=1 + blocks // BLOCKS_PER_SALT)
    names = list(keep)

    def look_up(rows: pa.Table, known: pa.Table) -> pa.Table:
        order = np.argsort(known.column("pair").to_numpy())
        count, best = known.column("count").to_numpy()[order], known.column("best").to_numpy()[order]
        kind = np.uint16 if len(order) <= 1 << 16 else np.uint32
        codes = [np.frombuffer(p.as_py(), kind) for p in rows.column("links")]
        counts, bests = [count[c] for c in codes], [best[c] for c in codes]
        added = {
            "link_counts": _listed(counts, pa.int64()), "link_best": _listed(bests, pa.bool_()),
            "n_links": pa.array([len(c) for c in codes], pa.int64()), "n_best": pa.array([int(x.sum()) for x in bests], pa.int64()),
            "count_sum": pa.array([int(x.sum()) for x in counts], pa.int64()),
        }
        return pa.table({**{n: rows.column(n) for n in names}, **added})

    types = ", ".join(f"`{n}` {table.schema[n].dataType.simpleString()}" for n in names)
    both = table.drop("pairs", "pair_counts").groupBy("block").cogroup(answers.groupBy("asker"))
    return both.applyInArrow(look_up, f"{types}, link_counts array<long>, link_best array<boolean>, n_links long, n_best long, count_sum long")
