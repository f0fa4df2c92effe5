"""Lexicon joins against the automaton and against plain substring tests."""

import random

from pyspark.sql import functions as F

from commentguard.operators import lexicon as lx, lexicon_join as lj


def plain(rows, entries):
    out = []
    for key, tokens in rows:
        if tokens is None:
            continue
        text = " ".join(tokens)
        for name, phrase in set(entries):
            if phrase in tokens if " " not in phrase else phrase.split(" ", 1)[0] in tokens and phrase in text:
                out.append((key, name, phrase))
    return sorted(out, key=str)


def test_equals_automaton_and_plain_tests(spark, monkeypatch):
    monkeypatch.setattr(lj, "CHUNK", 3)
    rng = random.Random(3)
    letters = ["a", "b", "ab", "ba", "aab", "abb", "c", "xa", "é"]
    rows = [(k % 90 if k else None, rng.choices(letters, k=rng.randrange(12))) for k in range(100)] + [(200, None), (201, []), (202, ["a"] * 400)]
    entries = [(f"l{rng.randrange(3)}", " ".join(rng.choices(letters, k=rng.randrange(1, 4)))) for _ in range(120)]
    entries += [("l0", ""), ("l1", "a "), ("l1", " a"), ("l2", "a  b"), ("l2", "c"), ("l2", "c"), ("never", "zz yy")]
    df = spark.createDataFrame(rows, "comment_id long, tokens array<string>").withColumn("normalized_text", F.array_join("tokens", " "))
    lexicon = spark.createDataFrame([*entries, (None, "a"), ("l0", None)], "list string, phrase string")
    got = sorted(map(tuple, lj.join_lexicon(df, lexicon).collect()), key=str)
    assert got == plain(rows, entries)
    assert got == sorted(map(tuple, lx.match_lexicon(df, lexicon).collect()), key=str)
    assert lj.join_lexicon(df, lexicon.limit(0)).count() == 0 and lj.join_lexicon(df.limit(0), lexicon).count() == 0


def test_rows_stay_where_they_are_and_nulls_match_nothing(spark):
    """The rows are neither shuffled nor filtered by a second normalisation."""
    rows = [(1, ["go", "die"], "go die"), (2, ["go", "die"], None), (3, None, "go die"), (4, ["ago", "dies", "go"], "ago dies go")]
    df = spark.createDataFrame(rows, "comment_id long, tokens array<string>, normalized_text string")
    df = df.withColumn("tokens", F.filter("tokens", lambda t: t != "never"))
    lexicon = spark.createDataFrame([("threat", "go die"), ("threat", "go")], "list string, phrase string")
    found = lj.join_lexicon(df, lexicon)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and plan.count("filter(tokens") == 1
    assert sorted(map(tuple, found.collect())) == [(1, "threat", "go"), (1, "threat", "go die"), (4, "threat", "go"), (4, "threat", "go die")]


def test_a_million_phrases(spark):
    """One word begins a third of the phrases and stands in every text."""
    i = F.col("id")
    first = F.when(i % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("w"), i % 5000))
    lexicon = spark.range(1_000_000).select(F.lit("severe").alias("list"), F.concat_ws(" ", first, F.concat(F.lit("x"), i)).alias("phrase"))
    df = spark.range(600).select(
        F.col("id").alias("comment_id"),
        F.array(F.lit("hot"), F.concat(F.lit("x"), i * 1500), F.concat(F.lit("w"), i % 5000), F.concat(F.lit("x"), i), F.lit("end")).alias("tokens"),
    ).withColumn("normalized_text", F.array_join("tokens", " "))
    want = []
    for k in range(600):
        for word, after in (("hot", f"x{k * 1500}"), (f"w{k % 5000}", f"x{k}")):
            numbers = {int(after[1:n]) for n in range(2, len(after) + 1) if after[1:n] == str(int(after[1:n]))}
            want += [(k, "severe", f"{word} x{j}") for j in numbers if j < 1_000_000 and word == ("hot" if j % 3 == 0 else f"w{j % 5000}")]
    assert sorted(map(tuple, lj.join_lexicon(df, lexicon).collect())) == sorted(want) and len(want) > 1000
