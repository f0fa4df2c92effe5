import json
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from commentguard import fixed_values as fv
from commentguard.operators import (
    dataset as ds, evaluation as ev, feedback as fb, feeds, metrics as mt, quality as ql,
    retrieval as rt, scoring as sc, training as tr,
)
from commentguard.operators.moderation import moderate
from commentguard.operators.ranks import ordered_ranks, shuffled_ranks
from commentguard.sources import tables as tb
from commentguard.streaming import live
from tests.golden import COMMENT_DDL, sample_frame

# The published confusion of a 500-row evaluation set.
CONFUSION = {"allow": (284, 3, 0), "flag_for_review": (16, 94, 4), "flag_for_removal": (0, 42, 57)}


@pytest.fixture(scope="module")
def cube(spark):
    cells = [("en" if i % 2 else "hi", a, p, n) for a, ns in CONFUSION.items() for i, (p, n) in enumerate(zip(fv.ACTIONS, ns))]
    rows = spark.createDataFrame(cells, "lang string, moderation_action string, predicted_action string, k int").filter("k > 0")
    return ev.confusion_counts(rows.select("*", F.explode(F.sequence(F.lit(1), "k"))), by=["lang"])


def test_published_metrics(cube):
    total = cube.groupBy("actual", "predicted").agg(F.sum("n").alias("n"))
    summary = ev.summary_metrics(ev.class_metrics(total)).first()
    assert (round(summary.accuracy, 3), round(summary.macro_f1, 3), round(summary.weighted_f1, 3)) == (0.870, 0.808, 0.866)
    assert (summary.majority_label, round(summary.baseline_accuracy, 3)) == ("allow", 0.574)
    per_class = {r.label: (round(r.precision, 3), round(r.recall, 3), round(r.f1, 3), r.support) for r in ev.class_metrics(total).collect()}
    assert per_class["flag_for_removal"] == (0.934, 0.576, 0.713, 99)
    assert per_class["flag_for_review"] == (0.676, 0.825, 0.743, 114)
    assert {(r.actual, r.predicted): r.n for r in ev.confusion_matrix(total).collect()}[("allow", "flag_for_removal")] == 0


def test_report_reads_the_cube_once_and_agrees(cube):
    report = ev.eval_report(cube, "lang").first()
    f1 = [2 * 284 / (2 * 284 + 16 + 3), 2 * 94 / (2 * 94 + 45 + 20), 2 * 57 / (2 * 57 + 4 + 42)]
    assert (report.total, report.accuracy, report.macro_f1) == (500, 0.87, round(sum(f1) / 3, 4))
    by_lang = {r.lang: (r["count"], r.accuracy, r.macro_f1) for r in ev.metrics_by(cube, "lang").collect()}
    assert {r.lang: (r["count"], r.accuracy, r.macro_f1) for r in report.per_language} == by_lang
    assert json.loads(ev.eval_report_json(ev.eval_report(cube, "lang")).first().report)["total"] == 500


def test_ranks_in_one_hot_group(spark):
    rows = [(i, "hot" if i % 3 else f"g{i % 7}") for i in range(5000)]
    df = spark.createDataFrame(rows, "id long, g string")
    ordered = ordered_ranks(df, ["g"], "id").collect()
    place, seen = {}, Counter()
    for i, g in rows:
        seen[g] += 1
        place[i] = seen[g]
    assert {r.id: r._rank for r in ordered} == place and all(r._group_size == seen[r.g] for r in ordered)
    shuffled = shuffled_ranks(df, ["g"], "id").collect()
    assert sorted(r._rank for r in shuffled if r.g == "hot") == list(range(1, seen["hot"] + 1))


def test_split_ids_and_unique_texts(spark):
    rows = [(i, f"safe_{i}", "same" if i % 2 else f"text {i}") for i in range(101)]
    df = spark.createDataFrame(rows, "id long, scenario_id string, text string")
    splits = Counter(r.split for r in ds.stratified_split(df, "id").collect())
    assert splits == {"train": 71, "test": 20, "eval": 10}
    ids = ds.assign_ids(df, "id").orderBy("id").collect()
    assert [r.example_id for r in ids][:2] == ["example_0001", "example_0002"] and len({r.example_id for r in ids}) == 101
    unique = ds.uniquify_text(df, "id").orderBy("id").collect()
    assert len({r.text for r in unique}) == 101
    assert unique[3].text == f"same {fv.UNIQUE_SUFFIXES[1]} Case 2." and unique[1].text == "same"


def test_rule_retrieval_forms_agree(spark, monkeypatch):
    rng = random.Random(1)
    vector = lambda: [rng.random() for _ in range(8)]
    rules = spark.createDataFrame([(f"r{i}", "allow", "c", "none", vector()) for i in range(40)], "id string, action string, category string, severity string, embedding array<double>")
    queries = spark.createDataFrame([(i, vector()) for i in range(30)] + [(99, None)], "comment_id long, embedding array<double>")
    by_literal = sorted(rt.retrieve_rules(queries, rules, 3, 0.5).collect())
    truth = []
    table = rules.collect()
    for q in queries.collect():
        ranked = sorted((sum((a - b) ** 2 for a, b in zip(q.embedding, r.embedding)), r.id) for r in table)[:3] if q.embedding else []
        truth += [(q.comment_id, i + 1, r) for i, (d, r) in enumerate(ranked) if d <= 0.5]
    assert [(r.comment_id, r["rank"], r.rule_id) for r in by_literal] == sorted(truth)
    monkeypatch.setattr(rt, "RULES_PER_BLOCK", 7)
    assert sorted(rt.retrieve_rules(queries, rules, 3, 0.5).collect()) == by_literal


def test_override_sets_severity_of_an_allow(spark):
    rules = spark.createDataFrame([("r", "flag_for_review", "spam", "low", [1.0])], "id string, action string, category string, severity string, embedding array<double>")
    df = spark.createDataFrame([(1, "The script was weak.", [1.0], 0.3), (2, "The script was weak.", [1.0], 0.79), (3, "You suck", [1.0], None), (4, "The script was weak.", [9.0], None)],
                               "comment_id long, text string, embedding array<double>, model_toxicity_score double")
    got = {r.comment_id: (r.predicted_action, r.predicted_category, r.predicted_severity, r.triggered_rules) for r in moderate(df, rules=rules).collect()}
    assert got == {1: ("allow", "non_abusive", "low", ["r"]), 2: ("flag_for_review", "spam", "low", ["r"]),
                   3: ("flag_for_review", "spam", "low", ["r"]), 4: ("allow", "non_abusive", "none", [])}


def test_weights_equal_row_by_row_descent(spark):
    df = sample_frame(spark).withColumn("moderation_action", F.when(F.col("comment_id") % 3 == 0, F.lit("allow")).otherwise(F.lit("flag_for_review")))
    features = tr.risk_features(df)
    rows = [[r[f] for f in tr.FEATURES] + [r.flagged] for r in features.collect()]
    w, b = [0.0] * 4, 0.0
    for _ in range(200):
        errors = [1 / (1 + math.exp(-(sum(x * y for x, y in zip(w, r)) + b))) - r[4] for r in rows]
        w = [wi - 0.1 * sum(e * r[i] for e, r in zip(errors, rows)) / len(rows) for i, wi in enumerate(w)]
        b -= 0.1 * sum(errors) / len(rows)
    assert list(tr.fit_risk_weights(features).values()) == pytest.approx(w, abs=1e-9)


def test_cache_hits_count_from_the_write(spark):
    rows = [(s, "a") for s in (0, 3599, 3600, 3600, 7000, 7200, 20000)] + [(5, "b")]
    df = spark.createDataFrame(rows, "s long, text string").select(F.timestamp_seconds("s").alias("ts"), "text", F.lit("main_review").alias("context_type"))
    assert sorted((r.requests, r.misses, r.hits) for r in mt.cache_hit_rate(df).collect()) == [(1, 1, 0), (7, 4, 3)]


def test_threads_feed_and_rules(spark):
    node = lambda body, replies="": {"kind": "t1", "data": {"body": body, "score": 2, "replies": replies}}
    under = {"kind": "Listing", "data": {"children": [node("first reply"), {"kind": "more", "data": {}}, node("[deleted]")]}}
    docs = [(1, json.dumps(node("top comment", under))), (2, json.dumps({"data": {"children": [node("a comment &amp; more")]}})), (3, "oops")]
    flat = feeds.flatten_threads(spark.createDataFrame(docs, "thread_id long, thread string")).orderBy("thread_id", "position")
    assert [(r.thread_id, r.body) for r in flat.collect()] == [(1, "top comment"), (1, "first reply"), (1, "[deleted]"), (2, "a comment & more".replace("&", "&amp;"))]
    feed = spark.createDataFrame([(1, "a comment &amp; more"), (2, "short"), (3, "a comment & more"), (4, "[removed]")], "position long, body string")
    assert [(r.position, r.text) for r in feeds.clean_feed(feed).collect()] == [(1, "a comment & more")]
    rules = spark.createDataFrame([("a", "x", "allow")], "id string, description string, action string")
    changes = spark.createDataFrame([("a", "y"), ("b", "z")], "id string, description string")
    assert sorted(feeds.upsert_rules(rules, changes).collect()) == [("a", "y", "allow"), ("b", "z", None)]


def test_validation_report(spark):
    sources = spark.createDataFrame([(1, "mail a@b.co", "s_1"), (2, "fine", "s_2"), (3, "fine", "s_3")], "id long, text string, scenario_id string")
    rows = ds.as_example_rows(sources.withColumns({"example_id": F.lit("x"), "labels_multi": F.lit("{}")})).select(F.substring_index("scenario_id", "_", -1).cast("long").alias("k"), "*")
    found = Counter(r.check for r in ql.validate_examples(rows, "k", 500).collect())
    assert found["duplicate example_id"] == 2 and found["possible email in text"] == 1
    assert found["labels_multi must be a JSON list"] == 3 and found["duplicate text values"] == 1 and found["unexpected row count"] == 1
    assert found["invalid severity"] == 3 and found["missing split"] == 3


def test_sources(spark, tmp_path):
    rules = tb.read_policy_rules(spark, str(tmp_path / "none"))
    assert rules.count() == 0 and tb.policy_rules(spark).count() == 7
    (tmp_path / "rules.json").write_text('{"id": "a"}\n{}\n')
    assert {(r.id, r.action, r.severity) for r in tb.read_policy_rules(spark, str(tmp_path / "rules.json")).collect()} == {("a", "allow", "none"), ("unknown_rule", "allow", "none")}
    assert tb.read_lexicon(spark, str(tmp_path / "none")).filter("list = 'community'").count() == 10
    (tmp_path / "w.json").write_text('{"has_mention": 0.5}\n')
    assert tb.read_weights(spark, str(tmp_path / "w.json")).first().asDict() == {**fv.WEIGHT_FALLBACKS, "has_mention": 0.5}
    text = ' quoted "text", with\nlines '
    rows = ds.as_example_rows(spark.createDataFrame([("1", text)], "example_id string, text string"))
    for _ in range(2):
        tb.write_examples_csv(rows, str(tmp_path / "csv"))
    assert [r.text for r in tb.read_examples(spark, str(tmp_path / "csv")).collect()] == [text]
    tb.append_feedback(spark.createDataFrame([("h", "allow"), ("h", "what")], "text_hash string, human_action string"), str(tmp_path / "fb"))
    assert [(r.human_action, r.moderator_id) for r in tb.read_feedback(spark, str(tmp_path / "fb")).collect()] == [("allow", "anonymous")]


def test_model_callables(spark):
    df = spark.createDataFrame([("good film",), ("bad",)], "normalized_text string")
    broken = sc.score_sentiment(df, model=lambda texts: 1 / 0).collect()
    assert [(r.sentiment_label, r.sentiment_source) for r in broken] == [("positive", "heuristic"), ("negative", "heuristic")]
    named = sc.score_sentiment(df, model=lambda texts: [{"label": "LABEL_0", "score": 0.123456}] * len(texts)).collect()
    assert {(r.sentiment_label, r.sentiment_score) for r in named} == {("negative", 0.1235)}
    score = sc.register_scorer(lambda texts: [float(len(t)) for t in texts], batch_size=1)
    assert [r.s for r in spark.createDataFrame([("ab",), (None,)], "t string").select(score("t").alias("s")).collect()] == [2.0, None]


def test_stream_equals_batch_and_routes_once(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    sample_frame(spark).withColumn("ts", F.timestamp_seconds(F.col("comment_id"))).repartition(3).write.parquet(source)
    stream = spark.readStream.schema(COMMENT_DDL + ", ts timestamp").option("maxFilesPerTrigger", 1).parquet(source)
    for _ in range(2):  # the second start has nothing left to do
        live.start_routing(stream, root, str(tmp_path / "cp"), availableNow=True).awaitTermination()
    names = ["comment_id", "predicted_action", "risk_score", "reason"]
    batch = moderate(spark.read.parquet(source))
    routed = spark.read.parquet(f"{root}/decisions")
    assert sorted(routed.select(names).collect()) == sorted(batch.select(names).collect())
    live.route_batch(batch.limit(5), 0, str(tmp_path / "again"))
    live.route_batch(batch.limit(5), 0, str(tmp_path / "again"))
    assert spark.read.parquet(str(tmp_path / "again/decisions")).count() == 5
    assert spark.read.parquet(f"{root}/audit").count() == batch.filter("predicted_action <> 'allow'").count()


def test_feedback_takes_the_latest(spark):
    audit = spark.createDataFrame([("1", "h", "flag_for_review"), ("2", "h", "flag_for_removal")], "request_id string, text_hash string, action string")
    feedback = spark.createDataFrame([(1, "h", "allow", "a"), (2, "h", "flag_for_removal", "b")], "t long, text_hash string, human_action string, moderator_id string").withColumn("timestamp", F.timestamp_seconds("t"))
    out = fb.feedback_disagreement(audit, feedback)
    assert sorted(out.collect()) == [("flag_for_removal", "flag_for_removal", 1), ("flag_for_review", "flag_for_removal", 1)]
    assert fb.override_rate(out).first().override_rate == 0.5


def test_ranks_keep_null_groups(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), (None, 3)], "g string, v long")
    out = shuffled_ranks(df, ["g"], "v").collect()
    assert sorted((str(r.g), r["_rank"], r["_group_size"]) for r in out) == [("None", 1, 2), ("None", 2, 2), ("a", 1, 1)]


def test_labels_are_stripped_of_all_white_space(spark):
    df = sample_frame(spark).limit(2).withColumn("moderation_action", F.lit("\tallow\n"))
    assert tr.risk_features(df).count() == 2


def test_a_thread_too_deep_is_reported(spark):
    deep = '{"kind": "t1", "data": {"body": "x", "replies": ' * 100_000 + '""' + '}}' * 100_000
    df = spark.createDataFrame([(1, deep), (2, '{"kind": "t1", "data": {"body": "fine"}}')], "thread_id long, thread string")
    got = {r.thread_id: r.body for r in feeds.flatten_threads(df).collect()}
    assert got == {1: None, 2: "fine"}


def test_a_thread_of_any_depth_keeps_its_comments(spark):
    turns, below = 5_000, '""'
    for k in reversed(range(turns)):
        below = '{"kind": "Listing", "data": {"children": [{"kind": "t1", "data": {"body": "b%d", "score": %d, "replies": %s}}]}}' % (k, k, below)
    df = spark.createDataFrame([(1, below), (2, below[:-1])], "thread_id long, thread string")
    got = feeds.flatten_threads(df, any_depth=True).orderBy("position").collect()
    assert [(r.thread_id, r.position, r.body, r.score) for r in got] == [(1, k, f"b{k}", k) for k in range(turns)]


@pytest.mark.parametrize("text", ["1", ' [ ] ', "{}", '{"a": [1, -2.5e3, true, null, "x\\n\\u00e9"], "b": {"c": {}}, "a": 2}', "", "[1,]", "{,}", '{"a" 1}', "[1 2]", "[1}", "01", "[", '"x', "[]]", "nul", '{"a":1,}'])
def test_own_parser_equals_json(text):
    try:
        want = json.loads(text)
    except ValueError:
        with pytest.raises(ValueError):
            feeds.parsed(text)
    else:
        assert feeds.parsed(text) == want


def test_percentiles_and_cache_follow_their_definitions(spark):
    rng = random.Random(9)
    values = [rng.choice([0.1, 0.2, 3.5, rng.random()]) for _ in range(999)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    got = mt.exact_percentiles(df, "v", [0.5, 0.95, 0.99, 0.0, 1.0]).first()
    want = df.select(F.percentile("v", F.array(*[F.lit(p) for p in (0.5, 0.95, 0.99, 0.0, 1.0)]))).first()[0]
    assert all(abs(a - b) < 1e-12 for a, b in zip(got, want))
    times = sorted(rng.randrange(5000) for _ in range(400))
    log = spark.createDataFrame([(t, "x", "c") for t in times], "s long, text string, context_type string").withColumn("ts", F.timestamp_seconds("s"))
    for ttl in (1, 7, 60, 900):
        written, misses = None, 0
        for t in times:
            if written is None or t >= written + ttl:
                written, misses = t, misses + 1
        row = mt.cache_hit_rate(log, ttl_seconds=ttl).first()
        assert (row.requests, row.misses, row.hits) == (400, misses, 400 - misses)


def test_duplicate_texts(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), (None,), ("",), ("b",)], "text string")
    from commentguard.operators.quality import duplicate_texts

    assert sorted((str(r.duplicate_text), r["count"]) for r in duplicate_texts(df).collect()) == [("None", 2), ("a", 2)]


def test_unique_texts_stay_unique_beside_taken_ones(spark):
    suffix = fv.UNIQUE_SUFFIXES
    long = "y" * fv.TEXT_CAP
    given = ["a", "a", "a", None, None, long + "1", long + "1", long + "2", long + "2"]
    first = ds.uniquify_text(spark.createDataFrame(list(enumerate(given[:3])), "i long, text string"), "i")
    taken = [r.text for r in first.collect() if r.text != "a"]
    rows = list(enumerate([*given, *taken, *suffix]))
    out = ds.uniquify_text(spark.createDataFrame(rows, "i long, text string"), "i").collect()
    texts = [r.text for r in out if r.text is not None]
    assert len(out) == len(rows) and len(set(texts)) == len(texts) == len(rows) - 2
    assert sorted(r.i for r in out) == list(range(len(rows)))


def test_many_texts_that_are_cut_to_the_same_one(spark):
    # 60 long texts that differ behind the cut only, three times each: their copies clash with each other.
    given = ["z" * fv.TEXT_CAP + f"{k:03d}" for k in range(60)] * 3
    df = spark.createDataFrame(list(enumerate(given)), "i long, text string")
    out = {r.i: r.text for r in ds.uniquify_text(df, "i").collect()}
    assert len(out) == len(set(out.values())) == 180
    assert all(out[i] == given[i] for i in range(60)) and all(len(out[i]) == fv.TEXT_CAP for i in range(60, 180))
    # The first of a clash keeps its number; one that is taken as given moves on.
    assert out[60].endswith(" Case 2.") and out[120].endswith(" Case 4.") and not out[61].endswith(" Case 2.")
    more = spark.createDataFrame([*enumerate(given), (180, out[60])], "i long, text string")
    again = {r.i: r.text for r in ds.uniquify_text(more, "i").collect()}
    assert len(set(again.values())) == 181 and again[180] == out[60] != again[60]
