"""MinHash near-duplicate documents: one-permutation hashing, banded buckets, star-shaped links."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from commentguard.llm.links import bucket_links, components, mixed_links
from commentguard.plans.shared import discard, written

BINS, ROWS = 128, 4
#: Candidates whose sketches agree in a share of bins that is further below the threshold are left out:
#: that many standard deviations of the estimate, which for a short text has few bins of its own.
DEVIATIONS = 4
#: Pairs that are confirmed in one round, where there are fewer texts.
ROUND = 100_000
#: Rows of a table that is sent to all executors; a larger one is joined by a shuffle.
BROADCAST_ROWS = 500_000
SPACE = b" \t\n\x0b\x0c\r"
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_STEPS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)


class WordHashes(dict):
    """64-bit hashes of words; forgets them all at 200,000, so its size is bounded: some 30 MB in each worker."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_WORDS = WordHashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct ``width``-word shingles of a text.

    Words are split at ASCII white space after A-Z are lower-cased.  A shorter
    text is one shingle of all its words, a text without words has none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    codes = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    n = min(width, len(codes))
    total = np.full(len(codes) - n + 1, n, np.uint64)
    for k in range(n):
        total = _mixed(total * np.uint64(_STEPS[k % 5]) + codes[k : len(codes) - n + 1 + k])
    return np.unique(total)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """One-permutation signature: 32 bits of the smallest value in each of ``BINS`` bins.

    Optimal densification: an empty bin copies the bin that a hash sequence of
    its own number reaches first among the filled ones, the same for all sets.
    """
    bins = (hashes >> np.uint64(57)).astype(np.int64)  # the high 7 bits: 128 bins, in sorted order
    first = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])
    out = np.zeros(BINS, np.uint32)
    out[bins[first]] = (hashes[first] >> np.uint64(25)).astype(np.uint32)  # those below the bin's number
    if len(first) == BINS:
        return out
    filled = np.zeros(BINS, bool)
    filled[bins[first]] = True
    return out[_donors(filled)]


_TRIES = np.random.default_rng(7).integers(0, BINS, (BINS, 4096))


def _donors(filled: np.ndarray) -> np.ndarray:
    donors = np.arange(BINS)
    for k in np.flatnonzero(~filled):
        hit = np.flatnonzero(filled[_TRIES[k]])
        donors[k] = _TRIES[k][hit[0]] if len(hit) else np.flatnonzero(filled)[0]
    return donors


def _band_keys(signatures: np.ndarray) -> np.ndarray:
    """The bucket of every band, for each row of signatures."""
    parts = signatures.astype(np.uint64).reshape(len(signatures), -1, ROWS)
    keys = np.broadcast_to(np.arange(parts.shape[1], dtype=np.uint64) + np.uint64(1), parts.shape[:2]).copy()
    for k in range(ROWS):
        keys = _mixed(keys * np.uint64(_STEPS[k]) + parts[:, :, k])
    return keys.view(np.int64)


def _turned(signature: np.ndarray) -> list[bytes]:
    """The signature's low bytes, turned to start after the band, for each band."""
    low = (signature & np.uint32(255)).astype(np.uint8)
    twice = np.r_[low, low].tobytes()
    return [twice[s : s + BINS] for s in range(ROWS, BINS + 1, ROWS)]


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, BINS)


def _small(df: DataFrame) -> DataFrame:
    """A hint to broadcast, if the rows are counted to be few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Groups of documents whose shingle sets have a similarity of ``percent`` or more.

    Returns ``doc_id``, ``n_shingles``, ``component_id`` (smallest doc_id that
    can be reached over links) and ``kept`` (it is that document), a row for
    each row of ``docs``.  Rows that share a doc_id are one document in the
    links.  Null and empty texts have no shingles and no links; a null doc_id
    takes no part: its component is null and it is kept.

    Texts with the same words are one class, which its smallest doc_id stands
    for.  Classes are banded by one-permutation signatures; candidates are
    star-shaped, at most two for each row of a bucket, and each is confirmed on
    the full sets.  Then all pairs of a bucket that are not connected yet are
    candidates, so no link between classes that share a bucket is lost.  At a
    similarity of 0.8 a pair shares no bucket in less than one of 10**7 cases.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, signatures = [], [], []
            for text in batch.column(1):
                text = text.as_py()
                hashes = shingle_hashes(text, width)
                sizes.append(len(hashes))
                if len(hashes):
                    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
                    keys.append(xxhash.xxh128_digest(b" ".join(words)))
                    signatures.append(sketch(hashes).tobytes())
                else:
                    keys.append(None)
                    signatures.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(signatures, pa.binary())],
                ["doc_id", "n_shingles", "text_key", "signature"],
            )

    def buckets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = _band_keys(_matrix(batch.column(1)))
            nodes = np.repeat(batch.column(0).to_numpy(), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(nodes)], ["bucket", "node"])

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                matrix = _matrix(part.column(1))
                keys = _band_keys(matrix)
                nodes = np.repeat(part.column(0).to_numpy(), keys.shape[1])
                sketches = [x for row in matrix for x in _turned(row)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.ravel()), pa.array(nodes), pa.array(sketches, pa.binary())], ["bucket", "node", "sketch"]
                )

    share = percent / 100

    def close(x: bytes, y: bytes) -> bool:
        alike = np.count_nonzero(np.frombuffer(x, np.uint8) == np.frombuffer(y, np.uint8))
        own = min(len(set(x)), len(set(y)))  # bins that densification has not copied, or fewer
        return alike >= BINS * (share - DEVIATIONS * (share * (1 - share) / own) ** 0.5)

    def all_close(xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
        alike = np.count_nonzero(xs[:, None] == ys[None], axis=2)
        own = [1 + np.count_nonzero(np.diff(np.sort(s, axis=1), axis=1), axis=1) for s in (xs, ys)]
        own = np.minimum(own[0][:, None], own[1])
        return alike >= BINS * (share - DEVIATIONS * (share * (1 - share) / own) ** 0.5)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    described = written(
        rows.mapInArrow(describe, "doc_id long, n_shingles long, text_key binary, signature binary"), "near-described"
    )
    worded = described.where("doc_id is not null and text_key is not null")
    classes = written(worded.groupBy("text_key").agg(F.min("doc_id").alias("node")), "near-classes")
    own = _small(classes).select(F.col("text_key").alias("_key"), "node")
    signatures = worded.join(own, (F.col("text_key") == F.col("_key")) & (F.col("doc_id") == F.col("node")))
    signatures = written(signatures.select("node", "signature"), "near-signatures")
    # Most buckets hold one class: only those with more are given sketches and sorted.
    keys = signatures.mapInArrow(buckets_of, "bucket long, node long")
    shared = keys.groupBy("bucket").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least <> most")
    shared = written(shared.select("bucket"), "near-shared")
    nodes = written(keys.join(_small(shared), "bucket", "left_semi").select("node").distinct(), "near-nodes")
    with_sketches = signatures.join(_small(nodes), "node", "left_semi").mapInArrow(sketched, "bucket long, node long, sketch binary")
    buckets = with_sketches.join(_small(shared), "bucket", "left_semi")
    links = _confirmed(rows, written(bucket_links(buckets, close, partitions), "near-pairs"), width, percent)
    # Copies of a class are linked with the document that stands for it.
    copies = worded.join(classes.select("text_key", "node"), "text_key").where("doc_id <> node").select("node", "doc_id")
    copies = written(copies, "near-copies")
    groups = written(components(links.union(copies)), "near-groups")
    # What neighbours missed: all pairs of the buckets that hold several groups.
    component = F.coalesce("component", "node").alias("component")
    met = keys.join(_small(shared), "bucket", "left_semi").join(_small(groups), "node", "left").select("bucket", "node", component)
    mixed = met.groupBy("bucket").agg(F.count("*").alias("n"), F.min("component").alias("least"), F.max("component").alias("most"))
    mixed = written(mixed.where("least <> most").select("bucket", "n"), "near-mixed")
    rest = with_sketches.join(_small(mixed), "bucket").join(_small(groups), "node", "left").select("bucket", "node", "sketch", "n", component)
    more = _confirmed(rows, written(mixed_links(rest, all_close, partitions), "near-pairs"), width, percent)
    discard(signatures, shared, nodes, mixed, groups, classes)
    groups = written(components(links.union(more).union(copies)), "near-groups")
    discard(copies)
    narrow = described.select("doc_id", "n_shingles")
    found = narrow.join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return found.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        (component.isNull() | (component == F.col("doc_id"))).alias("kept"),
    )


def _confirmed(rows: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs whose full shingle sets reach the similarity; ``pairs`` is a written table, which goes.

    Only texts that a pair names are moved, to where the first of the pair is,
    in rounds of as many pairs as there are texts.  Two rows may share a doc_id;
    every text of it is compared.
    """

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            keep = []
            for a, x, y in zip(batch.column(0), batch.column(2), batch.column(3), strict=True):
                if a.as_py() != last:
                    last, held = a.as_py(), shingle_hashes(x.as_py(), width)
                theirs = shingle_hashes(y.as_py(), width)
                shared = len(np.intersect1d(held, theirs, assume_unique=True))
                keep.append(100 * shared >= percent * (len(held) + len(theirs) - shared))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], ["a", "b"]
            )

    n = pairs.count()
    texts = pairs.select("a").union(pairs.select("b")).distinct().count() if n > ROUND else 0
    rounds = max(1, -(-n // max(ROUND, texts)))
    links = []
    for number in range(rounds):
        some = pairs.where(F.pmod(F.xxhash64("a", "b"), F.lit(rounds)) == number) if rounds > 1 else pairs
        firsts = some.select(F.col("a").alias("doc_id")).distinct()
        left = rows.join(_small(firsts), "doc_id", "left_semi")
        right = rows.select(F.col("doc_id").alias("b"), F.col("text").alias("y")).join(_small(some), "b")
        joined = right.join(left.select(F.col("doc_id").alias("a"), F.col("text").alias("x")), "a").select("a", "b", "x", "y")
        links.append(written(joined.mapInArrow(confirm, "a long, b long").distinct(), "near-links"))
    discard(pairs)
    return reduce(DataFrame.union, links)
