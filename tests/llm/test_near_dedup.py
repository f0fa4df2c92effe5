"""Near-duplicate groups against all pairs, and components against union-find."""

import random
import re

import numpy as np
import pytest

from commentguard.llm import links as crowds, near_dedup
from commentguard.llm.links import components
from commentguard.llm.near_dedup import BINS, near_duplicates, shingle_hashes, sketch


def root(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def brute(docs, width, percent):
    sets, parent = {}, {}
    for name, text in docs:
        words = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        n = min(width, len(words))
        sets.setdefault(name, []).append({tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if n else set())
        parent[name] = name
    names = sorted(k for k in sets if k is not None)
    for i, a in enumerate(names):
        for b in names[:i]:
            for x in sets[a]:
                for y in sets[b]:
                    if x and y and 100 * len(x & y) >= percent * len(x | y):
                        p, q = root(parent, a), root(parent, b)
                        parent[max(p, q)] = min(p, q)
    out = []
    seen = {}
    for name, _ in docs:
        k = seen[name] = seen.get(name, -1) + 1
        group = None if name is None else root(parent, name)
        out.append((name, len(sets[name][k]), group, name is None or group == name))
    return sorted(out, key=str)


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_equals_all_pairs(spark, width, percent):
    rng = random.Random(width)
    vocabulary = [f"w{k}" for k in range(300)]
    docs = []
    for base in range(25):
        words = rng.choices(vocabulary, k=rng.choice([1, 2, 4, 15, 60, 400]))
        for _ in range(8):
            copy = [rng.choice(vocabulary) if rng.random() < 0.02 else w for w in words]
            docs.append((len(docs) * 7 % 1009, "  ".join(copy).upper() if rng.random() < 0.3 else "\n".join(copy)))
    docs += [(2000, None), (2001, ""), (2002, " \t\n"), (None, docs[0][1]), (2003, docs[5][1]), (2003, docs[5][1]), (2004, "a\xa0b c")]
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, component_id int")
    got = near_duplicates(frame, width, percent).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(docs, width, percent)


def test_components_equal_union_find(spark):
    rng = random.Random(1)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1120)] + [(5, 5), (None, 3)]
    parent = {x: x for pair in links for x in pair if x is not None}
    for a, b in links:
        if a is not None:
            p, q = root(parent, a), root(parent, b)
            parent[max(p, q)] = min(p, q)
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    linked = {x for a, b in links if a is not None and a != b for x in (a, b)}
    assert {r.node: r.component for r in got} == {x: root(parent, x) for x in linked}
    assert len(got) == len(linked)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sketch_agreement_estimates_similarity():
    rng = random.Random(2)
    words = [f"x{rng.random()}" for _ in range(3000)]
    for share in (0.5, 0.8, 0.95):
        n = int(2000 * 2 * share / (1 + share) / 2)
        one, two = words[: 1000], words[1000 - n : 2000 - n]
        x, y = (shingle_hashes(" ".join(w), 1) for w in (one, two))
        true = len(set(one) & set(two)) / len(set(one) | set(two))
        assert abs(np.mean(sketch(x) == sketch(y)) - true) < 0.15
    assert len(set(sketch(shingle_hashes("one", 1)))) == 1 and len(sketch(shingle_hashes("one two", 1))) == BINS


def test_large_groups_of_near_copies_lose_no_link(spark, monkeypatch):
    """Texts with a long common passage share buckets, so the ends of a link are seldom neighbours there."""
    monkeypatch.setattr(crowds, "BLOCK", 32)
    monkeypatch.setattr(near_dedup, "ROUND", 200, raising=False)
    rng = random.Random(6)
    vocabulary = [f"w{k}" for k in range(2000)]
    passage, docs = rng.choices(vocabulary, k=110), []
    for _ in range(60):
        words = passage + rng.choices(vocabulary, k=8)
        copy = list(words)
        for place in rng.sample(range(10, 115, 5), 3):
            copy[place] = rng.choice(vocabulary)
        docs += [(len(docs), " ".join(words)), (len(docs) + 1, " ".join(copy))]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = near_duplicates(frame, 3, 85).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(docs, 3, 85)
