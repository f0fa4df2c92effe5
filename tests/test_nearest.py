"""The search of a rule table against the literal form and against plain matrices."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from commentguard.operators import nearest as nn, retrieval as rt
from commentguard.operators.moderation import moderate
from commentguard.operators.ranks import salted_join as salted

RULE = "id string, action string, category string, severity string, embedding array<double>"


def clustered(rng, n, dims=6):
    centres = [[rng.gauss(0, 3) for _ in range(dims)] for _ in range(5)]
    return [[x + rng.gauss(0, 0.3) for x in centres[0 if rng.random() < 0.4 else rng.randrange(5)]] for _ in range(n)]


@pytest.mark.parametrize(("k", "reach"), [(1, 1.2), (3, 0.5), (5, 1e9), (90, 40.0), (2, float("inf"))])
def test_table_equals_literals(spark, monkeypatch, k, reach):
    rng = random.Random(k)
    vectors = clustered(rng, 150)
    vectors += [vectors[0]] * 30  # a crowd of equal rules
    rules = spark.createDataFrame([(f"r{i}", "allow" if i % 2 else "flag_for_review", f"c{i % 3}", "low", v) for i, v in enumerate(vectors)], RULE).repartition(3)
    asked = [(i, v) for i, v in enumerate([*clustered(rng, 40), vectors[0], vectors[7], [0.0] * 6])] + [(99, None), (100, vectors[0])]
    queries = spark.createDataFrame(asked, "comment_id long, embedding array<double>").repartition(2)
    literal = sorted(rt.retrieve_rules(queries, rules, k, reach).collect())
    arrays = rt.with_nearest_rules(queries, rules, k, reach, only_if=F.col("comment_id") != 7).collect()
    monkeypatch.setattr(rt, "LITERAL_RULES", 10)
    monkeypatch.setattr(nn, "RULE_BLOCK", 16)
    monkeypatch.setattr(nn, "QUERY_BLOCK", 8)
    monkeypatch.setattr(nn, "PIVOTS", 12)
    assert rt.is_table(rules)
    assert sorted(rt.retrieve_rules(queries, rules, k, reach).collect()) == literal
    by_table = rt.with_nearest_rules(queries, rules, k, reach, only_if=F.col("comment_id") != 7).collect()
    assert sorted((r.comment_id, r.rules) for r in by_table) == sorted((r.comment_id, r.rules) for r in arrays)


def test_no_rules_and_odd_lengths(spark):
    queries = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "comment_id long, embedding array<double>")
    assert nn.nearest_rules(queries, spark.createDataFrame([], RULE), 3, 1.0, "comment_id").count() == 0
    rules = spark.createDataFrame([("a", "allow", "c", "low", [1.0, 2.0]), ("b", None, None, None, None)], RULE)
    assert [(r.comment_id, r.id, r.distance) for r in nn.nearest_rules(queries, rules, 3, 1.0, "comment_id").collect()] == [(1, "a", 0.0)]
    assert nn.nearest_rules(queries.limit(0), rules, 3, 1.0, "comment_id").count() == 0


def test_100_000_rules_equal_plain_matrices(spark):
    dims = 8
    vector = F.array(*[F.round(F.randn(7 + d) + (F.col("i") % 9) * (d % 3), 4) for d in range(dims)])
    rules = spark.range(100_000).withColumnRenamed("id", "i").select(
        F.concat(F.lit("r"), "i").alias("id"), *[F.lit("x").alias(c) for c in ("action", "category", "severity")], vector.alias("embedding")
    )
    rng = np.random.default_rng(1)
    asked = [(k, (rng.normal(size=dims) + k % 9 * (np.arange(dims) % 3)).tolist()) for k in range(60)]
    queries = spark.createDataFrame(asked, "comment_id long, embedding array<double>")
    table = rules.select("id", "embedding").toPandas()
    matrix, names = np.array(table.embedding.tolist()), table.id.to_numpy()
    got = {}
    for r in rt.retrieve_rules(queries, rules, 5, 2.0).collect():
        got.setdefault(r.comment_id, []).append((r["rank"], r.rule_id))
    for k, v in asked:
        distances = ((matrix - v) ** 2).sum(1)
        near = sorted((d, n) for d, n in zip(distances, names) if d <= 2.0)[:5]
        assert [n for _, n in sorted(got.get(k, []))] == [n for _, n in near]


def test_moderation_takes_rules_from_a_table(spark, monkeypatch):
    rules = spark.createDataFrame([(f"r{i}", "flag_for_review", f"c{i}", "low", [float(i), 0.0]) for i in range(30)], RULE)
    df = spark.createDataFrame([(k, "the plot is terrible", [k + 0.1, 0.0]) for k in range(0, 30, 5)] + [(99, "fine", None)], "comment_id long, text string, embedding array<double>")
    want = sorted(moderate(df, rules=rules).select("comment_id", "triggered_rules", "predicted_category").collect())
    monkeypatch.setattr(rt, "LITERAL_RULES", 5)
    assert sorted(moderate(df, rules=rules).select("comment_id", "triggered_rules", "predicted_category").collect()) == want
    assert any(r.triggered_rules for r in want)


def test_a_query_meets_a_region_once_and_travels_as_given(spark, monkeypatch, tmp_path):
    """A region of 5,000 rules is one block; single precision stays so, whatever a stripe of the product holds."""
    monkeypatch.setattr(nn, "PIVOTS", 2)
    monkeypatch.setattr(nn, "CELLS", 20_000)
    blocks = []
    monkeypatch.setattr(nn, "salted_join", lambda left, right, *a, **b: (blocks.append(left.collect()), salted(left, right, *a, **b))[1])
    vector = F.array(*[F.randn(d).cast("float") for d in range(4)])
    rules = spark.range(10_000).select(F.concat(F.lit("r"), "id").alias("id"), *[F.lit("x").alias(c) for c in ("action", "category", "severity")], vector.alias("embedding"))
    rules.write.parquet(f"{tmp_path}/rules")
    rules = spark.read.parquet(f"{tmp_path}/rules")
    queries = rules.where("id in ('r1', 'r50', 'r9999')").select(F.col("id").alias("comment_id"), "embedding")
    got = {(r.comment_id, r["rank"]): r.id for r in nn.nearest_rules(queries, rules, 3, 50.0, "comment_id").collect()}
    assert len({r.block for r in blocks[0]}) <= 2 and all(len(r.vectors) == 4 * 4 * len(r["keys"]) for r in blocks[0])
    table = rules.toPandas()
    matrix = np.array(table.embedding.tolist(), np.float64)
    for name in ("r1", "r50", "r9999"):
        own = matrix[table.index[table.id == name][0]]
        order = np.lexsort((table.id.to_numpy(str), ((matrix - own) ** 2).sum(1)))[:3]
        assert [got[name, k] for k in (1, 2, 3)] == table.id.to_numpy()[order].tolist()
