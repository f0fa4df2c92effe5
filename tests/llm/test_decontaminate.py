"""Decontamination against brute force over windows."""

import hashlib
import random
import re

import pytest

from commentguard.llm.decontaminate import benchmark_overlap
from commentguard.llm.queries import contamination

SPLIT = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return SPLIT.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=10):
    out = []
    for name, text in docs:
        own, hit, found = words(text), set(), set()
        for item, body in items:
            w = words(body)
            for k in range(max(1, len(w) - window + 1) if w else 0):
                part = w[k : k + window]
                for at in range(len(own) - len(part) + 1):
                    if own[at : at + len(part)] == part:
                        hit.update(range(at, at + len(part)))
                        found.add(str(item))
        listed = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((name, len(own), len(hit), len(found), listed, bool(hit)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def case():
    rng = random.Random(3)
    vocabulary = ["Alpha", "beta", "straße", "l'eau", "42", "x_y", "日本", "the", "of", "End."]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 12, 25])))) for k in range(12)]
    items += [(12, None), (13, "..."), (14, ""), (3, items[3][1]), (15, "the")]
    docs = [(k, ", ".join(rng.choices(vocabulary, k=rng.randrange(80)))) for k in range(60)]
    docs += [(100 + k, f"é {items[k][1].upper()}! tail") for k in range(12)]
    docs += [(200, None), (201, ""), (202, "\x00 -- "), (200, "the"), (None, "the of"), (203, "word " * 50_000 + (items[2][1] or ""))]
    return docs, items


@pytest.mark.parametrize("part_bytes", [10**6, 200])
def test_equals_brute_force(spark, case, part_bytes):
    docs, items = case
    d = spark.createDataFrame([(*r, "clash") for r in docs], "doc_id long, text string, items string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = contamination(benchmark_overlap(d, b, part_bytes=part_bytes)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(docs, items)


def test_runs_point_into_the_original(spark):
    d = spark.createDataFrame([(1, "né… ONE, two.\nthree Été four")], "doc_id long, text string")
    b = spark.createDataFrame([("q", "two three Été")], "item_id string, text string")
    row = benchmark_overlap(d, b).first()
    assert [("né… ONE, two.\nthree Été four"[r.start : r.end], r.word_start, r.word_end) for r in row.runs] == [("two.\nthree Été", 2, 5)]


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    b = spark.createDataFrame([("q", "two")], "item_id string, text string")
    assert contamination(benchmark_overlap(d, b.limit(0))).first()["n_hit"] == 0
    assert benchmark_overlap(d.limit(0), b).count() == 0
