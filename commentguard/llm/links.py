"""Candidate links from sorted buckets, and the groups that links form."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from commentguard.plans.shared import discard, written

PAIRS = "a long, b long"


def bucket_links(rows: DataFrame, close: Callable[[bytes, bytes], bool], partitions: int) -> DataFrame:
    """Star-shaped candidate pairs of the rows that share a bucket.

    ``rows`` has ``bucket`` long, ``node`` long and ``sketch`` binary.  Rows are
    range-partitioned and sorted by (bucket, sketch), so a bucket of any size
    spreads over tasks and is read as a stream: each row is paired with the
    stretch's centre (its first row) and with the row before it, which is the
    most alike by the sketch.  That is at most two pairs for each row.  Pairs
    that ``close`` rejects are left out.  Returns distinct (a, b), a < b.
    """

    def stretch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = centre = before = None
        for batch in batches:
            found: set[tuple[int, int]] = set()
            keys, nodes, sketches = batch.columns
            same = np.empty(len(keys), bool)
            values = keys.to_numpy()
            same[1:] = values[1:] == values[:-1]
            same[:1] = values[:1] == bucket if bucket is not None else False
            # Only rows that share their bucket with the row before or after are looked at.
            for k in np.flatnonzero(same | np.r_[same[1:], True]).tolist():
                row = nodes[k].as_py(), sketches[k].as_py()
                if same[k]:
                    for other, theirs in {centre, before}:
                        if other != row[0] and close(theirs, row[1]):
                            found.add((min(other, row[0]), max(other, row[0])))
                else:
                    centre = row
                bucket, before = int(values[k]), row
            ends = np.array(sorted(found), dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])

    dealt = rows.select("bucket", "node", "sketch").repartitionByRange(partitions, "bucket", "sketch", "node")
    return dealt.sortWithinPartitions("bucket", "sketch", "node").mapInArrow(stretch, PAIRS).distinct()


#: Rows of a crowded bucket that are compared with each other, or with those of another block, in one group.
BLOCK = 8_192
#: Rows of a block that are compared with others at once, and pairs that these make at most: their bits stay in a core's cache.
STRIPE, CELLS = 256, 1 << 18
#: Rows of a bucket up to which it is compared side by side with others, a distance of rows at a time.
SMALL = 64

#: Distinct node pairs with what is known of their nodes: (nodes in their order, sizes, heads) and the pairs.
Found = tuple[tuple[np.ndarray, np.ndarray, pa.Array], np.ndarray]


def near_links(rows: DataFrame, most: int, percent: int, partitions: int, window: int = 4) -> tuple[DataFrame, DataFrame]:
    """As ``bucket_links``, for rows (bucket, node, high, low, size) with a sketch of 128 bits in two longs.

    Each row is paired with its stretch's centre and with ``window`` rows before
    it, where at most ``most`` bits differ and the smaller size is ``percent`` of
    the larger at least.  Returns the distinct pairs (a, b), a < b, and (bucket,
    n) of the buckets in which other pairs remain: those of more rows, and those
    that lie in several tasks.  ``crowd_links`` compares these.
    """

    def stretch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(ends: np.ndarray, crowd: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(ends[:, 0].copy()), pa.array(ends[:, 1].copy()), pa.array(np.full(len(ends), crowd))], ["a", "b", "crowd"]
            )

        kept = np.empty((0, 5), np.int64)  # the centre of the last stretch, then the rows before
        opened, first = None, True  # the bucket that may go on, with its rows so far
        for batch in batches:
            if not batch.num_rows:
                continue
            own = np.stack([c.to_numpy().astype(np.int64) for c in batch.columns], axis=1)
            rows = np.concatenate([kept, own])
            old, bucket = len(kept), rows[:, 0]
            # The centre that was kept heads its bucket's rows, as buckets are sorted.
            start = np.ones(len(rows), bool)
            start[1:] = bucket[1:] != bucket[:-1]
            centre = np.maximum.accumulate(np.where(start, np.arange(len(rows)), 0))
            at = np.arange(old, len(rows))
            ends = []
            for other in (centre[at], *(at - lag for lag in range(1, window + 1))):
                fits = other >= 0
                here, there = rows[at[fits]], rows[other[fits]]
                same = (here[:, 0] == there[:, 0]) & (here[:, 1] != there[:, 1])
                same &= 100 * np.minimum(here[:, 4], there[:, 4]) >= percent * np.maximum(here[:, 4], there[:, 4])
                here, there = here[same], there[same]
                bits = np.bitwise_count((here[:, 2:4] ^ there[:, 2:4]).astype(np.uint64)).sum(axis=1)
                pair = np.sort(np.stack([here[:, 1], there[:, 1]], axis=1)[bits <= most], axis=1)
                ends.append(pair)
            found = np.unique(np.concatenate(ends), axis=0)
            last = np.flatnonzero(bucket == bucket[-1])
            kept = rows[np.unique(np.r_[centre[-1], last[-window:]])]
            yield out(found, False)

            heads = np.flatnonzero(np.r_[True, own[1:, 0] != own[:-1, 0]])
            runs = np.stack([own[heads, 0], np.diff(np.r_[heads, len(own)])], axis=1)
            if opened is not None and opened[0] == runs[0, 0]:
                runs[0, 1] += opened[1]
            elif opened is not None:
                runs = np.concatenate([[opened], runs])
            over = runs[:-1, 1] > window + 1
            if first and len(over):  # the bucket of the task's first rows may have begun in another
                over[0], first = True, False
            opened = runs[-1]
            yield out(runs[:-1][over], True)
        if opened is not None:
            yield out(opened[None], True)

    dealt = rows.select("bucket", "node", "high", "low", "size").repartitionByRange(partitions, "bucket", "high", "low", "node")
    found = dealt.sortWithinPartitions("bucket", "high", "low", "node").mapInArrow(stretch, f"{PAIRS}, crowd boolean")
    found = written(found, "near-found")
    crowded = found.where("crowd").groupBy(F.col("a").alias("bucket")).agg(F.sum("b").alias("n"), F.count("*").alias("parts"))
    return found.where("not crowd").select("a", "b").distinct(), crowded.where(f"n > 1 and (n > {window + 1} or parts > 1)").select("bucket", "n")


def crowd_links(
    rows: DataFrame, most: int, percent: int, partitions: int, check: Callable[[Iterator[Found]], Iterator[np.ndarray]] | None = None
) -> DataFrame:
    """All pairs of the rows that share a bucket and are not of one component, by the bounds of ``near_links``.

    ``rows`` has in addition ``n``, the rows of its bucket, and ``component``, a
    group of nodes that links connect already: within one, no pair can add
    anything.  A bucket is cut into blocks of about ``BLOCK`` rows, and each two
    of its blocks meet in a group of their own, so a task holds two blocks
    whatever the bucket's size.  Returns (a, b), a < b, once for each bucket that
    the two share.

    With ``check``, rows have a string ``head`` too, and the pairs that a task
    finds go through it before they leave the task.  So what is written and
    shuffled grows with the rows, however many pairs they make.
    """

    def fitting(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The ends of those of the pairs of rows that sizes and components allow."""
        fits = (x[:, 5] != y[:, 5]) & (100 * np.minimum(x[:, 8], y[:, 8]) >= percent * np.maximum(x[:, 8], y[:, 8]))
        return np.sort(np.stack([x[fits, 4], y[fits, 4]], axis=1), axis=1)

    def compared(group: np.ndarray) -> np.ndarray:
        """The pairs of one group: of its only block, or across its two."""
        low, high = int(group[0, 1]), int(group[0, 2])
        group = group[np.argsort(group[:, 8], kind="stable")]
        left = group[group[:, 3] == low]
        right = left if low == high else group[group[:, 3] == high]
        sizes, ends, step = right[:, 8], [], max(1, min(STRIPE, CELLS // max(1, len(right))))
        for at in range(0, len(left), step):
            here = left[at : at + step]
            # Rows are in the order of their sizes, so those of a fitting size are neighbours.
            start = at if low == high else int(np.searchsorted(100 * sizes, percent * here[0, 8]))
            there = right[start : int(np.searchsorted(percent * sizes, 100 * here[-1, 8], "right"))]
            bits = np.bitwise_count((here[:, 6, None] ^ there[None, :, 6]).view(np.uint64))
            bits += np.bitwise_count((here[:, 7, None] ^ there[None, :, 7]).view(np.uint64))
            x, y = np.nonzero(bits <= most)
            ends.append(fitting(here[x], there[y]))
        return np.concatenate(ends) if ends else np.empty((0, 2), np.int64)

    def side_by_side(held: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """The pairs of many small groups; ``stops`` says where the group of each row ends."""
        ends, at = [np.empty((0, 2), np.int64)], np.arange(len(held))
        for lag in range(1, SMALL):
            at = at[at + lag < stops[at]]
            if not len(at):
                break
            bits = np.bitwise_count((held[at, 6:8] ^ held[at + lag, 6:8]).view(np.uint64)).sum(axis=1)
            x = at[bits <= most]
            ends.append(fitting(held[x], held[x + lag]))
        return np.concatenate(ends)

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[Found]:
        def out(part: np.ndarray, heads: pa.Array, ends: np.ndarray) -> Iterator[Found]:
            if len(ends):
                nodes, at = np.unique(part[:, 4], return_index=True)
                yield (nodes, part[at, 8], heads.take(pa.array(at))), np.unique(ends, axis=0)

        def closed(held: np.ndarray, heads: pa.Array, starts: np.ndarray) -> Iterator[Found]:
            counts = np.diff(np.r_[starts, len(held)])
            large = np.repeat(counts > SMALL, counts)
            stops = np.repeat(np.cumsum(np.where(counts > SMALL, 0, counts)), counts)[~large]
            few = np.flatnonzero(~large)
            yield from out(held[few], heads.take(pa.array(few)), side_by_side(held[few], stops))
            for start, count in zip(starts[counts > SMALL].tolist(), counts[counts > SMALL].tolist(), strict=True):
                part = held[start : start + count]
                yield from out(part, heads.slice(start, count), compared(part))

        kept, heads = np.empty((0, 9), np.int64), pa.array([], pa.string())
        for batch in batches:
            if not batch.num_rows:
                continue
            held = np.concatenate([kept, np.stack([c.to_numpy().astype(np.int64) for c in batch.columns[:9]], axis=1)])
            heads = pa.concat_arrays([heads, batch.column(9)])
            starts = np.flatnonzero(np.r_[True, (held[1:, :3] != held[:-1, :3]).any(axis=1)])
            if len(starts) > 1:
                yield from closed(held[: starts[-1]], heads.slice(0, starts[-1]), starts[:-1])
            kept, heads = held[starts[-1] :], heads.slice(starts[-1])
        if len(kept) > 1:
            yield from closed(kept, heads, np.zeros(1, int))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ends in check(groups(batches)) if check else (ends for _, ends in groups(batches)):
            yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0].copy()), pa.array(ends[:, 1].copy())], ["a", "b"])

    head = F.col("head") if check else F.lit("").alias("head")
    return _in_blocks(rows, partitions, "component", "high", "low", "size", head).mapInArrow(found, PAIRS)


def _in_blocks(rows: DataFrame, partitions: int, *columns: str | F.Column) -> DataFrame:
    """(bucket, i, j, own, node) and these columns, a row for each two blocks i <= j of a bucket of which it is in one.

    Rows of one (bucket, i, j) follow each other in one partition.
    """
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = rows.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", *columns)
    return met.repartition(partitions, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")


def mixed_links(rows: DataFrame, close: Callable[[np.ndarray, np.ndarray], np.ndarray], partitions: int) -> DataFrame:
    """All pairs of the rows that share a bucket, are not of one component and are ``close``.

    ``rows`` is as for ``bucket_links``, with ``n``, the rows of its bucket, and
    ``component`` as for ``crowd_links``; all sketches have one length.
    ``close`` is given the sketches of m and of n rows as arrays of bytes and
    returns an array of m times n truths.  Blocks bound what a task holds.
    Returns distinct (a, b), a < b.
    """

    def compared(group: np.ndarray, sketches: np.ndarray) -> np.ndarray:
        low, high = int(group[0, 1]), int(group[0, 2])
        left = np.flatnonzero(group[:, 3] == low)
        right = left if low == high else np.flatnonzero(group[:, 3] == high)
        step, ends = max(1, CELLS * 32 // (max(1, len(right)) * sketches.shape[1])), []
        for at in range(0, len(left), step):
            here, there = left[at : at + step], right[at:] if low == high else right
            x, y = np.nonzero((group[here, 5, None] != group[None, there, 5]) & close(sketches[here], sketches[there]))
            ends.append(np.sort(np.stack([group[here[x], 4], group[there[y], 4]], axis=1), axis=1))
        return np.unique(np.concatenate(ends), axis=0) if ends else np.empty((0, 2), np.int64)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: np.ndarray, sketches: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(held) > 1 and (held[:, 5] != held[0, 5]).any():
                ends = compared(held, sketches)
                yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0].copy()), pa.array(ends[:, 1].copy())], ["a", "b"])

        kept, parts = [], []  # of the group that may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            own = np.stack([c.to_numpy().astype(np.int64) for c in batch.columns[:6]], axis=1)
            sketches = np.frombuffer(b"".join(batch.column(6).to_pylist()), np.uint8).reshape(len(own), -1)
            new = np.r_[not kept or (own[0, :3] != kept[0][0, :3]).any(), (own[1:, :3] != own[:-1, :3]).any(axis=1)]
            bounds = np.r_[0, np.flatnonzero(new), len(own)]
            for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if start < end and new[start] and kept:
                    yield from out(np.concatenate(kept), np.concatenate(parts))
                    kept, parts = [], []
                kept.append(own[start:end])
                parts.append(sketches[start:end])
        if kept:
            yield from out(np.concatenate(kept), np.concatenate(parts))

    return _in_blocks(rows, partitions, "component", "sketch").mapInArrow(found, PAIRS).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node that a link (a, b) names.

    The component is the smallest node that can be reached.  Alternating large
    and small stars: each step hands every node's neighbours to the smallest of
    them, until only stars are left; the number of steps grows with the
    logarithm of a component's size.  Null ends and self-links are ignored.
    """
    ends = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    stars = written(ends.distinct(), "links")
    while not _only_stars(stars):
        both = stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")), "links-least")
        larger = both.join(least, "a").where("b > a and b <> m").select(F.col("m").alias("a"), "b")
        larger = written(larger.distinct(), "links-large")
        discard(least)
        least = written(larger.groupBy("b").agg(F.min("a").alias("m")), "links-least")
        smaller = larger.join(least, "b").where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
        moved = written(smaller.union(least.select(F.col("m").alias("a"), "b")).distinct(), "links")
        discard(stars, larger, least)
        stars = moved
    return stars.select(F.col("b").alias("node"), F.col("a").alias("component")).union(stars.select("a", "a").distinct())


def _only_stars(links: DataFrame) -> bool:
    """Whether every larger end has one link and is no smaller end."""
    sides = links.select(F.col("a").alias("node"), F.lit(1).alias("smaller"), F.lit(0).alias("larger")).union(
        links.select("b", F.lit(0), F.lit(1))
    )
    nodes = sides.groupBy("node").agg(F.max("smaller").alias("smaller"), F.sum("larger").alias("larger"))
    return nodes.where("larger + smaller > 1 and larger > 0").isEmpty()
