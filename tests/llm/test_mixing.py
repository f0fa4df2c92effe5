"""Mixing: targets and quotas against plain loops, totals, bounds and repeatability."""

import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from commentguard.llm.mixing import mix_sources, sainte_lague

WEIGHT = "1 + (place - 1) % 3"


def targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    left, rest, out = set(order), sum(sizes.values()), {}
    while True:
        total = sum(weight[s] for s in left)
        over = [s for s in left if rest * weight[s] / total > 3 * sizes[s]]
        if not over:
            return out | {s: rest * weight[s] / total for s in left}
        for s in over:
            out[s] = 3 * sizes[s]
        rest -= sum(out[s] for s in over)
        left -= set(over)


def test_quotas_equal_the_highest_quotients(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for group in range(12):
        weights = [rng.choice([0, 1, rng.random() * 100, 10**6]) for _ in range(rng.randrange(1, 9))]
        seats = rng.randrange(40)
        won = Counter()
        for _ in range(seats if sum(weights) else 0):
            won[max(range(len(weights)), key=lambda k: (weights[k] / (2 * won[k] + 1), -k))] += 1
        for k, w in enumerate(weights):
            rows.append((group, k, float(w), seats))
            want[group, k] = won[k]
    frame = spark.createDataFrame(rows, "g int, k int, w double, seats long")
    got = {(r.g, r.k): r.quota for r in sainte_lague(frame, ["g"], "k", "w", "seats").collect()}
    assert got == want


def test_targets_bounds_and_repeatability(spark):
    rng = random.Random(6)
    names = ["b", "a", "é", None, "tiny", "Z", "hot"]
    docs = []
    for k in range(900):
        source = "hot" if k % 3 == 0 else "tiny" if k == 1 else rng.choice([n for n in names if n != "tiny"])
        docs.append((k if k % 50 else None, " ".join(["w"] * rng.choice([0, 1, 7, 40, 300])), source))
    docs += [(7, None, "a"), (7, None, "a"), (8, "x y z", "only"), (9, "", "empty")]
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, source string, taken string")
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for _, text, source in docs:
        sizes[source] += size(text)
    want = targets(sizes)
    rows = mix_sources(frame, F.expr(WEIGHT)).collect()
    assert sorted((str(r.doc_id), r["size"], str(r.source)) for r in rows) == sorted((str(d), size(t), str(s)) for d, t, s in docs)
    taken = Counter()
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, r.target)
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    for source, target in want.items():
        assert abs(taken[source] - target) <= max(0.02 * target, 5 * sum(sizes.values()) / 7000)
    again = mix_sources(frame.repartition(5), F.expr(WEIGHT)).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_nothing_to_mix(spark):
    frame = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [(r.taken, r.target) for r in mix_sources(frame, F.expr(WEIGHT)).collect()] == [(0, 0.0)] * 2
