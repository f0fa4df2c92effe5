"""Best-fit packing of documents into sequences by a grouping genetic algorithm on islands."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from commentguard.llm.tokens import byte_bpe
from commentguard.plans.shared import discard, written

#: Tokens of a sequence, and the token that ends a document.
LENGTH, END = 1024, 2
#: Pieces of one packing problem, about.
BLOCK_PIECES = 1024
#: Islands of a problem, solutions on an island, epochs between which the elite migrates, and children in an epoch.
ISLANDS, POPULATION, EPOCHS, CHILDREN = 3, 6, 2, 15
#: Sequences filled below this share are opened again for the next round, together with those of other problems.
OPEN, ROUNDS = 0.8, 3


def cut_documents(docs: DataFrame, vocabulary: str, length: int = LENGTH) -> DataFrame:
    """Each document of ``docs`` (doc_id, text) as pieces of at most ``length`` tokens.

    A document is its ids and the end token.  Longer ones are cut into full
    pieces, the first of which may be shorter.  Returns doc_id, piece (from 0),
    start, length, ids_crc32 and uid, a number of its own for each piece.  A
    null text is empty; rows that repeat are documents of their own.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, uid = byte_bpe(vocabulary), TaskContext.get().partitionId() << 36
        for batch in batches:
            rows, spans = [], []
            for k, text in enumerate(batch.column(1)):
                ids = np.array([*own.encode(text.as_py() or "", special=True), END], "<u4")
                first = len(ids) % length or length
                edges = [0, *range(first, len(ids) + 1, length)]
                for piece, (start, end) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                    rows.append(k)
                    spans.append((piece, start, end - start, zlib.crc32(ids[start:end].tobytes())))
            columns = np.array(spans, np.int64).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(columns[0], pa.int32()), *[pa.array(c.copy()) for c in columns[1:]],
                 pa.array(np.arange(uid, uid + len(rows)))],
                ["doc_id", "piece", "start", "length", "ids_crc32", "uid"],
            )
            uid += len(rows)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, uid long")


class FreeSpace:
    """Bins by their free space; the fullest that still takes a size is found from a bit mask."""

    def __init__(self, free: np.ndarray, length: int):
        self.bins, self.mask = [[] for _ in range(length + 1)], 0
        for number, space in enumerate(free.tolist()):
            self.put(number, space)

    def put(self, number: int, space: int) -> None:
        self.bins[space].append(number)
        self.mask |= 1 << space

    def take(self, size: int) -> tuple[int, int] | None:
        above = self.mask >> size
        if not above:
            return None
        space = size + (above & -above).bit_length() - 1
        number = self.bins[space].pop()
        if not self.bins[space]:
            self.mask ^= 1 << space
        return number, space


def best_fit(sizes: np.ndarray, owner: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """``owner`` (the bin of each piece, -1 for none) with the pieces of ``order`` put where the least space is left."""
    owner, n = owner.copy(), int(owner.max(initial=-1)) + 1
    placed = owner >= 0
    space = FreeSpace(length - np.bincount(owner[placed], sizes[placed], n).astype(np.int64), length)
    bins = []
    for size in sizes[order].tolist():
        number, free = space.take(size) or (n, length)
        n += number == n
        bins.append(number)
        space.put(number, free - size)
    owner[order] = bins
    return owner


def fills(sizes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    return np.bincount(owner, sizes).astype(np.int64)


def cost(sizes: np.ndarray, owner: np.ndarray, length: int) -> tuple[int, float]:
    """The number of bins; among equal ones, the less the more its bins differ in fill."""
    full = fills(sizes, owner)
    return len(full), -float(np.mean((full / length) ** 2))


def least_bins(sizes: np.ndarray, length: int) -> int:
    """A number of bins that no packing is below: big pieces share none, and the rest only fills what these leave."""
    most = -(-int(sizes.sum()) // length)
    counts = np.bincount(sizes, minlength=length + 1)
    number, weight = np.cumsum(counts), np.cumsum(counts * np.arange(length + 1))
    for small in np.flatnonzero(counts[: length // 2 + 1]).tolist():
        alone = number[length] - number[length - small]
        shared = number[length - small] - number[length // 2]
        room = shared * length - (weight[length - small] - weight[length // 2])
        rest = weight[length // 2] - (weight[small - 1] if small else 0)
        most = max(most, int(alone + shared + max(0, -(-(rest - room) // length))))
    return max(most, int(number[length] - number[length // 2]))


def _numbered(owner: np.ndarray) -> np.ndarray:
    """The same bins, numbered from 0; -1 stays."""
    used = np.unique(owner[owner >= 0])
    return np.where(owner >= 0, np.searchsorted(used, owner), -1)


def crossed(sizes: np.ndarray, one: np.ndarray, other: np.ndarray, rng: np.random.Generator, length: int) -> np.ndarray:
    """A child: whole well-filled bins of ``other`` go into ``one``.

    Bins of ``one`` that hold one of their pieces again are removed; what these
    held besides is put by best fit, large pieces first.
    """
    full = fills(sizes, other)
    ranked = np.argsort(-full, kind="stable")[: max(1, len(full) // 2)]
    chosen = rng.choice(ranked, rng.integers(1, max(2, len(ranked) // 2 + 1)), replace=False)
    injected = np.isin(other, chosen)
    owner = np.where(np.isin(one, one[injected]), -1, one)
    owner[injected] = one.max() + 1 + other[injected]
    return best_fit(sizes, _numbered(owner), np.flatnonzero(owner < 0), length)


def mutated(sizes: np.ndarray, one: np.ndarray, rng: np.random.Generator, length: int) -> np.ndarray:
    """The emptiest bin and a few others are taken apart, and their pieces are put by best fit."""
    full = fills(sizes, one)
    gone = {int(full.argmin()), *rng.integers(0, len(full), 1 + len(full) // 20).tolist()}
    owner = np.where(np.isin(one, list(gone)), -1, one)
    return best_fit(sizes, _numbered(owner), np.flatnonzero(owner < 0), length)


def epoch(sizes: np.ndarray, population: list[np.ndarray], rng: np.random.Generator, length: int) -> list[np.ndarray]:
    """The island's solutions after its children, best first.  ``sizes`` descend.

    It starts with best fit of falling sizes and of sizes out of order.  It ends
    as soon as a solution has as few bins as any can have.
    """
    nothing, everything = np.full(len(sizes), -1, np.int64), np.arange(len(sizes))
    goal = least_bins(sizes, length)
    if not population:
        population = [best_fit(sizes, nothing, everything, length)]
        while len(population) < POPULATION and len(fills(sizes, population[0])) > goal:
            loose = everything[np.argsort(-sizes * rng.uniform(0.7, 1.0, len(sizes)), kind="stable")]
            population.append(best_fit(sizes, nothing, loose, length))
    ranked = sorted(((cost(sizes, p, length), k, p) for k, p in enumerate(population)), key=lambda x: x[:2])[:POPULATION]
    for k in range(CHILDREN):
        if ranked[0][0][0] <= goal:
            break
        one, other = (ranked[min(rng.integers(0, len(ranked), 2))][2] for _ in range(2))
        child = mutated(sizes, one, rng, length) if k % 5 == 4 or one is other else crossed(sizes, one, other, rng, length)
        score = cost(sizes, child, length)
        if all(score != x[0] for x in ranked):
            ranked = sorted([*ranked, (score, len(population) + k, child)], key=lambda x: x[:2])[:POPULATION]
    return [p for _, _, p in ranked]


_ROW = "block long, island int, sizes binary, bins int, spread double, solution binary"


def _evolve(blocks: DataFrame, problems: int, length: int, seed: int) -> DataFrame:
    """block, sizes and the best solution of each block (block, sizes) after the epochs of its islands."""

    def run(number: int):
        def on_island(rows: pa.Table) -> pa.Table:
            first = {c: rows.column(c)[0].as_py() for c in ("block", "island", "sizes")}
            sizes = np.frombuffer(first["sizes"], np.uint16).astype(np.int64)
            known = sorted({s for s in rows.column("solution").to_pylist() if s is not None})
            population = [np.frombuffer(s, np.uint16).astype(np.int64) for s in known]
            rng = np.random.default_rng([seed, number, first["island"], first["block"]])
            found = epoch(sizes, population, rng, length)
            # The elite goes on to the next island too.
            homes = [(first["island"], p) for p in found] + [((first["island"] + 1) % ISLANDS, found[0])]
            scores = [cost(sizes, p, length) for _, p in homes]
            return pa.table({
                "block": pa.array([first["block"]] * len(homes), pa.int64()), "island": pa.array([i for i, _ in homes], pa.int32()),
                "sizes": pa.array([first["sizes"]] * len(homes), pa.binary()), "bins": pa.array([s[0] for s in scores], pa.int32()),
                "spread": pa.array([s[1] for s in scores], pa.float64()),
                "solution": pa.array([p.astype(np.uint16).tobytes() for _, p in homes], pa.binary()),
            })

        return on_island

    islands = F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island")
    rows = blocks.select("block", islands, "sizes").selectExpr("*", "0 AS bins", "0D AS spread", "cast(null as binary) AS solution")
    # Rows are few and work on them is long: tasks are counted by islands, not by bytes.
    tasks = min(ISLANDS * problems, 4 * max(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), blocks.sparkSession.sparkContext.defaultParallelism))
    for number in range(EPOCHS):
        rows = rows.repartition(tasks, "block", "island").groupBy("block", "island").applyInArrow(run(number), _ROW)
    best = F.min_by("solution", F.struct("bins", "spread", "solution"))
    return rows.groupBy("block").agg(F.first("sizes").alias("sizes"), best.alias("solution"))


def pack(pieces: DataFrame, length: int = LENGTH, seed: int = 1) -> DataFrame:
    """uid, sequence_id and offset of each of ``pieces`` (uid, length), in as few sequences of ``length`` tokens as it finds.

    A sequence's number is the smallest uid in it.  Full pieces are sequences of
    their own.  The others are dealt by hash into problems of about
    ``BLOCK_PIECES``, solved on islands; sequences filled below ``OPEN`` are
    taken apart and dealt anew in the next of at most ``ROUNDS`` rounds, so that
    what problems leave over is packed together.
    """
    full = pieces.where(F.col("length") >= length).select("uid", F.col("uid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    out, left = [full], pieces.where(F.col("length") < length).select("uid", F.col("length").cast("int").alias("length"))

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uids, lengths, solution in zip(batch.column("uids"), batch.column("lengths"), batch.column("solution"), strict=True):
                uid, size = uids.values.to_numpy(), lengths.values.to_numpy().astype(np.int64)
                owner = np.frombuffer(solution.as_py(), np.uint16).astype(np.int64)
                order = np.argsort(owner, kind="stable")
                ends = np.cumsum(size[order])
                starts = np.r_[0, np.flatnonzero(np.diff(owner[order])) + 1]
                names = np.minimum.reduceat(uid[order], starts)
                heads = (ends - size[order])[starts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(uid[order]), pa.array(size[order], pa.int32()), pa.array(names[owner[order]]),
                     pa.array(ends - size[order] - heads[owner[order]]), pa.array(fills(size, owner)[owner[order]])],
                    ["uid", "length", "sequence_id", "offset", "filled"],
                )

    for number in range(ROUNDS):
        n = left.count()
        if n == 0:
            break
        problems = -(-n // BLOCK_PIECES)
        dealt = left.withColumn("block", F.pmod(F.xxhash64("uid", F.lit(seed + number)), F.lit(problems)))
        blocks = dealt.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("length", "uid")), asc=False).alias("p"))
        blocks = written(blocks.select("block", F.col("p.uid").alias("uids"), F.col("p.length").alias("lengths")), "pack-blocks")
        sizes = blocks.select("block", _packed("lengths").alias("sizes"))
        solved = blocks.join(_evolve(sizes, problems, length, seed + number).select("block", "solution"), "block")
        rows = written(
            solved.mapInArrow(filled, "uid long, length int, sequence_id long, offset long, filled long"), "packed"
        )
        discard(blocks)
        last = number == ROUNDS - 1 or problems == 1
        stays = rows if last else rows.where(F.col("filled") >= OPEN * length)
        out.append(stays.select("uid", "sequence_id", "offset"))
        if last:
            break
        left = rows.where(F.col("filled") < OPEN * length).select("uid", "length")
    packed = out[0]
    for more in out[1:]:
        packed = packed.unionByName(more)
    return packed


def _packed(lengths: str):
    """An array of numbers below 65,536 as bytes, the smaller byte first."""
    digits = F.transform(lengths, lambda x: F.concat(F.substring(F.hex(x + 65536), 4, 2), F.substring(F.hex(x + 65536), 2, 2)))
    return F.unhex(F.array_join(digits, ""))


def pack_documents(docs: DataFrame, vocabulary: str, length: int = LENGTH) -> DataFrame:
    """The pieces of ``cut_documents`` with their sequence_id and offset.

    Every row of ``docs`` (doc_id, text) is packed, whatever its doc_id; other
    columns are not read.
    """
    pieces = written(cut_documents(docs, vocabulary, length), "pieces")
    return pieces.join(pack(pieces, length), "uid").drop("uid")
