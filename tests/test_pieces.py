"""Python functions turn a few texts of a batch at a time into Python strings."""

from pyspark.sql import functions as F

from commentguard.operators import lexicon as lx, scoring as sc


def test_scorer_takes_a_batch_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(sc, "PIECE", 3)
    texts = [None if k % 4 == 1 else "x" * k for k in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string").coalesce(1)

    def scorer(given):
        assert None not in given and len(given) <= 2
        return [float("nan") if len(t) == 6 else len(t) for t in given]

    got = {r.i: r.s for r in df.select("i", sc.register_scorer(scorer, batch_size=2)("t").alias("s")).collect()}
    assert got == {k: None if t is None or k == 6 else float(k) for k, t in enumerate(texts)}
    largest = df.select(sc.register_scorer(lambda given: [float(len(given))] * len(given), batch_size=1000)("t").alias("s"))
    assert {r.s for r in largest.collect()} == {15.0, None}
    pieces = df.select(sc.register_scorer(lambda given: [float(len(given))] * len(given), batch_size=3)("t").alias("s"))
    assert max(r.s for r in pieces.collect() if r.s) <= 3.0 and df.limit(0).select(sc.register_scorer(scorer)("t")).count() == 0


def test_scan_takes_a_batch_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(lx, "PIECE", 3)
    rows = [(k, None if k == 5 else ["a", "b"][: k % 3] + ["c"] * (k % 2)) for k in range(11)]
    df = spark.createDataFrame(rows, "comment_id long, tokens array<string>").coalesce(1).withColumn("normalized_text", F.array_join("tokens", " "))
    lexicon = spark.createDataFrame([("l", "a"), ("l", "a b"), ("m", "c")], "list string, phrase string")
    want = sorted((k, name, p) for k, t in rows if t is not None for name, p in (("l", "a"), ("l", "a b"), ("m", "c")) if (p in t if " " not in p else p in " ".join(t)))
    assert sorted(map(tuple, lx.match_lexicon(df, lexicon).collect())) == want
    assert lx.match_lexicon(df.limit(0), lexicon).count() == 0
