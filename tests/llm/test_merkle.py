"""The manifest against a plain tree that hashes everything anew."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from commentguard.llm import merkle
from commentguard.llm.merkle import Path, Tree, levels_of, merkle_manifest
from commentguard.llm.queries import QUERIES


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row) -> str:
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tops(nodes: list[str], fanout: int) -> list[list[str]]:
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][k : k + fanout])) for k in range(0, len(out[-1]), fanout)])
    return out


def proof(nodes, place, fanout):
    out = []
    for level in tops(nodes, fanout)[:-1]:
        start = place - place % fanout
        out += [x for k, x in enumerate(level[start : start + fanout], start) if k != place]
        place //= fanout
    return out


def brute(rows, fanout, change):
    """Rows (doc_id, source, lang, n_chars, text); for each the leaf, subroot, root, proof and folded root."""
    first = lambda v: (v is not None, v)
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    groups = {k: sorted(v, key=lambda r: (first(r[0]), leaf(r))) for k, v in sorted(groups.items(), key=lambda kv: first(kv[0] and kv[0].encode()))}
    lists = {k: [leaf(r) for r in v] for k, v in groups.items()}
    subroots = [tops(v, fanout)[-1][0] for v in lists.values()]
    root, out = tops(subroots, fanout)[-1][0], []
    for k, (name, own) in enumerate(groups.items()):
        for place, row in enumerate(own):
            new = [leaf(change(row)) if p == place else x for p, x in enumerate(lists[name])]
            tampered = [tops(new, fanout)[-1][0] if q == k else x for q, x in enumerate(subroots)]
            out.append((
                row[0], lists[name][place], subroots[k], root, proof(lists[name], place, fanout) + proof(subroots, k, fanout),
                tops(tampered, fanout)[-1][0],
            ))
    return sorted(out, key=str)


ROWS = [(k * 37 % 101, f"s{k % 4}", ["en", "de", None, "é", "z"][min(k % 7, 4)], k, "text é " * (k % 5)) for k in range(90)]
ROWS += [(5, None, "en", None, None), (None, "s", "en", 3, ""), (None, "s", None, 3, "x"), (7, "s", "en", 1, "same"), (7, "s", "en", 1, "same"), (1, "s", "one", 1, "l" * 100_000)]


@pytest.mark.parametrize(("fanout", "chunk"), [(2, 4), (2, 1024), (3, 9), (5, 2)])
def test_equals_plain_trees(spark, monkeypatch, fanout, chunk):
    monkeypatch.setattr(merkle, "CHUNK", chunk)
    docs = spark.createDataFrame([(*r, 1, "x") for r in ROWS], "doc_id long, source string, lang string, n_chars long, text string, place int, `group` string")
    later = F.when(F.col("doc_id") % 3 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    got = merkle_manifest(docs.repartition(5), {"n_chars": later}, fanout=fanout).collect()
    change = lambda r: (*r[:3], r[3] + 1 if r[0] is not None and r[0] % 3 == 0 and r[3] is not None else r[3], r[4])
    assert sorted((tuple(r) for r in got), key=str) == brute(ROWS, fanout, change)


def test_one_row_is_the_root(spark):
    docs = spark.createDataFrame([ROWS[0]], "doc_id long, source string, lang string, n_chars long, text string")
    row = merkle_manifest(docs).first()
    assert row.leaf == row.subroot == row.root == row.folded_root == leaf(ROWS[0]) and row.proof == []


def test_partitions_do_not_matter(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, source string, lang string, n_chars long, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "31")
        many = sorted(map(tuple, merkle_manifest(docs).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert many == sorted(map(tuple, merkle_manifest(docs.coalesce(1)).collect()), key=str)


def test_folding_resumes_states():
    rng = random.Random(3)
    for fanout in (2, 3, 7):
        for n in (1, 2, 9, 50):
            nodes = [sha(str(rng.random())).encode() for _ in range(n)]
            tree = Tree(nodes, fanout, levels_of(n, fanout, 99))
            place = rng.randrange(n)
            assert tree.fold(place, nodes[place]) == tree.nodes[-1][0]
            new = [b"x" * 64 if k == place else x for k, x in enumerate(nodes)]
            assert tree.fold(place, b"x" * 64).decode() == tops([x.decode() for x in new], fanout)[-1][0]
    path = Path([{"left": ["a"], "right": []}, {"left": [], "right": ["b", "c"]}])
    assert path.fold(b"x").decode() == sha(sha("ax") + "bc") and path.siblings == ["a", "b", "c"]


def test_tampered_rows_are_found(spark):
    rows = QUERIES["op11_merkle_manifest"](spark, "/root/testdata/sf0.001").collect()
    import zlib

    assert {r.doc_id for r in rows if not r.verified} == {r.doc_id for r in rows if zlib.crc32(str(r.doc_id).encode()) % 7 == 0}
