import random

from pyspark.sql import functions as F

from commentguard.operators.threads import order_threads

SCHEMA = "t string, c string, up string, at int, position string"


def walked(rows):
    """{(thread, comment): (position, depth)} by a plain walk."""
    nodes = {}
    for t, c, up, at, _ in rows:
        if c is not None:
            key = (at is not None, at or 0, up is not None, up or "")
            if (t, c) not in nodes or key < nodes[t, c][0]:
                nodes[t, c] = (key, up, at)
    below = {}
    for (t, c), (_, up, at) in nodes.items():
        below.setdefault((t, up if (t, up) in nodes else None), []).append((at is not None, at or 0, c))
    out = {}
    for t in {t for t, _ in nodes}:
        waiting, place = [(c, 0) for *_, c in sorted(below.get((t, None), []), reverse=True)], 0
        while waiting:
            c, depth = waiting.pop()
            out[t, c], place = (place, depth), place + 1
            waiting += [(b, depth + 1) for *_, b in sorted(below.get((t, c), []), reverse=True)]
    return out


def check(spark, rows):
    got = order_threads(spark.createDataFrame(rows, SCHEMA), "t", "c", "up", "at")
    assert got.columns == ["t", "c", "up", "at", "position", "depth"]
    want = walked(rows)
    found = got.collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r.position, r.depth) == want.get((r.t, r.c), (None, None)), r


def test_trees_orphans_rings_repeats_and_nulls(spark):
    rng = random.Random(5)
    rows = []
    for t in ("a", "b", None, ""):
        for c in range(60):
            up = rng.choice([None, "gone", *[str(k) for k in range(max(1, c - 5), c)]])
            rows.append((t, str(c), up, rng.choice([None, 1, 2, 3]), "x"))
    rows += [("a", "7", "3", 0, "x"), ("a", "7", "3", 0, "x"), ("a", None, "1", 1, "x"), ("z", "1", "1", 1, "x")]
    rows += [("ring", "1", "2", 1, "x"), ("ring", "2", "1", 1, "x"), ("ring", "3", "2", 1, "x"), ("ring", "4", None, 1, "x"), ("ring", "5", "4", 1, "x")]
    check(spark, rows)
    check(spark, [])


def test_one_deep_and_one_wide_thread(spark):
    # 20,000 turns in a line and 20,000 replies to one comment.
    n = 20_000
    deep = spark.range(n).selectExpr("'deep' t", "id c", "if(id > 0, id - 1, null) up", "id at")
    wide = spark.range(n).selectExpr("'wide' t", "id c", "if(id > 0, 0L, null) up", "-id at")
    got = order_threads(deep.union(wide), "t", "c", "up", "at")
    wrong = got.where(F.expr(
        "position is null or if(t = 'deep', position <> c or depth <> c, depth <> if(c = 0, 0, 1) or position <> if(c = 0, 0, %d - c))" % n
    ))
    assert got.count() == 2 * n and wrong.isEmpty()
