"""Packing: every token once, no gaps, and as few sequences as exhaustive search or a global best fit find."""

import random
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pytest
from tokenizers import Tokenizer

from commentguard.llm import packing
from commentguard.llm.packing import best_fit, crossed, epoch, fills, least_bins, mutated, pack
from commentguard.llm.queries import BYTE_BPE, QUERIES

SF = "/root/testdata/sf0.001"


def check_pieces(rows, texts, length=1024):
    """Rows against the plain tokenizer; returns the number of sequences and the sizes of partly filled pieces."""
    model, want = Tokenizer.from_file(BYTE_BPE), defaultdict(int)
    for name, text in texts:
        ids = [*model.encode(text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % length or length
        edges = [0, *range(first, len(ids) + 1, length)]
        for piece, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            want[name, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    got, sequences = defaultdict(int), defaultdict(list)
    for r in rows:
        got[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
        sequences[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for parts in sequences.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= length
    return len(sequences), np.array([k[3] for k, n in want.items() for _ in range(n)])


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    n, sizes = check_pieces(QUERIES["op13_best_fit_packing"](spark, SF).collect(), [(d.doc_id, d.text) for d in docs])
    everything = np.sort(sizes)[::-1].astype(np.int64)
    plain = best_fit(everything, np.full(len(everything), -1), np.arange(len(everything)), 1024)
    assert n <= len(fills(everything, plain)) and n <= least_bins(everything, 1024) + 1


def test_odd_rows(spark, tmp_path):
    texts = [(1, None), (2, ""), (2, ""), (None, "x y"), (3, "<|endoftext|> a"), (4, "word " * 30_000), (5, " " * 200_000), (6, "é" * 3000)]
    docs = spark.createDataFrame([(*t, 1, 2) for t in texts], "doc_id long, text string, uid int, length int").repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    check_pieces(QUERIES["op13_best_fit_packing"](spark, str(tmp_path)).collect(), texts)


def test_several_problems_and_rounds(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_PIECES", 40)
    rng = random.Random(2)
    sizes = [rng.choice([rng.randrange(1, 1024), 512, 1024, 300]) for _ in range(1500)]
    pieces = spark.createDataFrame(list(enumerate(sizes)), "uid long, length long")
    rows = pack(pieces.repartition(4)).join(pieces, "uid").collect()
    assert sorted(r.uid for r in rows) == list(range(1500))
    filled = defaultdict(int)
    for r in rows:
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 1024 and all(min(r.uid for r in rows if r.sequence_id == s) == s for s in list(filled)[:20])
    assert len(filled) <= 1.03 * least_bins(np.array(sizes), 1024)  # problems this small leave more over
    again = pack(pieces.coalesce(1)).collect()
    assert sorted(map(tuple, again)) == sorted((r.uid, r.sequence_id, r.offset) for r in rows)


def fewest(sizes, length):
    """By exhaustive search."""

    @lru_cache(maxsize=None)
    def search(left, spaces):
        if not left:
            return len(spaces)
        best = search(left[1:], tuple(sorted((*spaces, length - left[0]))))
        for k, space in enumerate(spaces):
            if space >= left[0] and space not in spaces[:k]:
                best = min(best, search(left[1:], tuple(sorted((*spaces[:k], space - left[0], *spaces[k + 1 :])))))
        return best

    return search(tuple(sizes), ())


def test_few_pieces_are_packed_best():
    rng, worse = random.Random(7), 0
    for seed in range(40):
        sizes = np.array(sorted((rng.randrange(2, 21) for _ in range(9)), reverse=True))
        best = fewest(sizes.tolist(), 24)
        assert least_bins(sizes, 24) <= best
        found = epoch(sizes, epoch(sizes, [], np.random.default_rng(seed), 24), np.random.default_rng(seed + 1), 24)[0]
        assert fills(sizes, found).max() <= 24
        worse += len(fills(sizes, found)) > best
    assert worse == 0


def test_crossover_finds_what_best_fit_misses():
    # Best fit of falling sizes needs more bins here than there are.
    sizes = np.array([44] * 6 + [24] * 6 + [33] * 9)
    sizes = np.sort(sizes)[::-1]
    plain = best_fit(sizes, np.full(len(sizes), -1), np.arange(len(sizes)), 100)
    population = []
    for k in range(6):
        population = epoch(sizes, population, np.random.default_rng(k), 100)
    assert len(fills(sizes, population[0])) <= len(fills(sizes, plain))


@pytest.mark.parametrize("operator", ["cross", "mutate"])
def test_children_hold_each_piece_once(operator):
    rng = np.random.default_rng(3)
    sizes = np.sort(rng.integers(1, 1024, 200))[::-1]
    parents = [best_fit(sizes, np.full(200, -1), rng.permutation(200), 1024) for _ in range(2)]
    for _ in range(30):
        child = crossed(sizes, *parents, rng, 1024) if operator == "cross" else mutated(sizes, parents[0], rng, 1024)
        assert child.min() == 0 and fills(sizes, child).max() <= 1024 and fills(sizes, child).min() > 0
        parents = [parents[1], child]


def test_lengths_as_bytes(spark):
    frame = spark.createDataFrame([([1, 255, 256, 1023],), ([],)], "x array<int>")
    got = [list(np.frombuffer(r[0], "<u2")) for r in frame.select(packing._packed("x")).collect()]
    assert got == [[1, 255, 256, 1023], []]
