"""Streams with state: several micro-batches and restarts give what one look at the whole log gives."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from commentguard.operators import feedback as fb, metrics as mt
from commentguard.streaming import live, stateful

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
DECISIONS = "text_hash string, comment_id long, predicted_action string, s long"
FEEDBACK = "text_hash string, feedback_id long, human_action string, s long"


def at(df, name):
    """Seconds since the start as a time; null stays."""
    return df.withColumn(name, F.timestamp_seconds(F.col("s") + int(START.timestamp()))).drop("s")


def run(spark, stream, path):
    stream.writeStream.format("parquet").option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start(path).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def arrive(df, path):
    df.repartition(2).write.mode("append").parquet(path)


def as_of(decisions, feedback, within):
    """Plain search: (feedback_id, decision) pairs."""
    out = []
    for key, fid, _, s in feedback:
        known = [(t, i) for k, i, _, t in decisions if k == key and t is not None and s is not None and t <= s]
        best = max(known, default=None)
        out.append((fid, best[1] if best and s - best[0] <= within else None))
    return sorted(out, key=str)


def logs(seed, n=400):
    rng = random.Random(seed)
    key = lambda: rng.choice(["hot"] * 3 + ["a", "b", None])
    decisions = [(key(), k, rng.choice(["allow", "flag_for_review"]), rng.randrange(5000)) for k in range(n)]
    feedback = [(key(), k, "allow", rng.randrange(-50, 6000)) for k in range(n)]
    return decisions, feedback


@pytest.mark.parametrize("slices", [1, 7, 3000])
def test_attached_feedback_equals_plain_search(spark, slices):
    decisions, feedback = logs(1)
    decisions += [("hot", 900, "allow", None), ("once", 901, "allow", 10)]
    feedback += [("once", 900, "allow", 10), ("once", 901, "allow", 9), ("never", 902, "allow", 50), ("hot", 903, "allow", None)]
    known = [d for d in decisions if d[0] is not None]
    got = fb.attach_feedback(
        at(spark.createDataFrame(decisions, DECISIONS), "ts"), at(spark.createDataFrame(feedback, FEEDBACK), "timestamp"), within_days=600 / 86_400, slices=slices
    ).where("text_hash is not null").collect()
    assert sorted(((r.feedback_id, r.comment_id) for r in got), key=str) == as_of(known, [f for f in feedback if f[0] is not None], 600)
    by_id = {d[1]: d for d in decisions}
    assert all(r.predicted_action == (by_id[r.comment_id][2] if r.comment_id is not None else None) for r in got)


def test_attach_feedback_to_nothing(spark):
    none = at(spark.createDataFrame([], DECISIONS), "ts")
    one = at(spark.createDataFrame([("a", 1, "allow", 5)], FEEDBACK), "timestamp")
    assert [r.comment_id for r in fb.attach_feedback(none, one).collect()] == [None]
    assert fb.attach_feedback(none, one.limit(0)).count() == 0


def test_feedback_stream_equals_batch_over_restarts(spark, tmp_path):
    decisions, feedback = logs(2, 150)
    known, asked = ([r for r in rows if r[0] is not None] for rows in (decisions, feedback))
    paths = [str(tmp_path / n) for n in ("decisions", "feedback")]
    for low, high in ((-100, 2000), (2000, 4000), (4000, 9000)):
        for rows, path, schema, name in ((known, paths[0], DECISIONS, "ts"), (asked, paths[1], FEEDBACK, "timestamp")):
            arrive(at(spark.createDataFrame([r for r in rows if low <= r[3] < high], schema), name), path)
        read = [spark.readStream.schema(spark.read.parquet(p).schema).parquet(p) for p in paths]
        out = run(spark, stateful.stream_feedback_join(*read, within_days=600 / 86_400), str(tmp_path / "out"))
    assert sorted(((r.feedback_id, r.comment_id) for r in out.collect()), key=str) == as_of(known, asked, 600)


def test_late_feedback_finds_the_decision_of_its_time(spark, tmp_path):
    paths = [str(tmp_path / n) for n in ("decisions", "feedback")]
    arrivals = [
        ([("a", 1, "allow", 100), ("a", 2, "flag_for_review", 200)], [("b", 0, "allow", 0)]),
        ([("a", 3, "flag_for_removal", 900)], [("a", 1, "allow", 150), ("a", 2, "allow", 950)]),
        ([("c", 9, "allow", 50_000)], [("c", 4, "allow", 50_000)]),
        ([("c", 10, "allow", 50_001)], [("a", 3, "allow", 300)]),  # behind the watermark by now
    ]
    for decisions, feedback in arrivals:
        arrive(at(spark.createDataFrame(decisions, DECISIONS), "ts"), paths[0])
        arrive(at(spark.createDataFrame(feedback, FEEDBACK), "timestamp"), paths[1])
        read = [spark.readStream.schema(spark.read.parquet(p).schema).parquet(p) for p in paths]
        out = run(spark, stateful.stream_feedback_join(*read, watermark="1 hour"), str(tmp_path / "out"))
    assert {r.feedback_id: r.comment_id for r in out.collect()} == {0: None, 1: 1, 2: 3, 4: 9}


def test_repeats_over_micro_batches(spark, tmp_path):
    rng = random.Random(4)
    rows = [(k, "hot" if k % 3 else f"t{k % 7}", s) for k, s in enumerate(sorted(rng.choices(range(6000), k=600)))]
    rows += [(700, "hot", None), (701, "hot", None)]
    frame = at(spark.createDataFrame([(*r, "main_review", 1) for r in rows], "comment_id long, text string, s long, context_type string, _odd int"), "ts")
    kept, last = [700, 701], {}
    for k, text, s in sorted(rows[:600], key=lambda r: (r[2], r[0])):
        if text not in last or s >= last[text] + 500:
            last[text] = s
            kept.append(k)
    for name, cuts in (("one", [(None, 7000)]), ("three", [(None, 1000), (1000, 3500), (3500, 7000)])):
        path = str(tmp_path / name)
        for low, high in cuts:
            seconds = F.unix_timestamp("ts") - int(START.timestamp())
            part = frame.where((seconds < high) & (F.lit(True) if low is None else seconds >= low) | (F.col("ts").isNull() & F.lit(low is None)))
            arrive(part, path)
            stream = spark.readStream.schema(frame.schema).parquet(path)
            out = run(spark, stateful.dedupe_stream(stream, ttl_seconds=500), f"{path}-out")
        assert sorted(r.comment_id for r in out.collect()) == sorted(kept)


EVENT = "comment_id long, client_id long, predicted_action string, latency_s double, s long"


def test_closed_windows_drop_late_rows_and_resume(spark, tmp_path):
    path = str(tmp_path / "in")
    arrivals = [[(1, 1, "allow", 0.1, 10), (2, 1, "allow", 0.3, 3000)], [(3, 1, "allow", 0.2, 3590), (4, 2, "allow", 0.5, 9000)], [(5, 1, "allow", 9.0, 20), (6, 2, "allow", 0.1, 20_000)]]
    for rows in arrivals:  # the last brings row 5, behind the watermark
        arrive(at(spark.createDataFrame(rows, EVENT), "ts"), path)
        stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
        windows = run(spark, mt.windowed_decisions(stream, width="1 hour", watermark="10 minutes"), str(tmp_path / "windows"))
        sessions = run(spark, mt.session_decisions(stream, watermark="10 minutes"), str(tmp_path / "sessions"))
    seconds = lambda t: int(t.replace(tzinfo=timezone.utc).timestamp() - START.timestamp())
    assert sorted((seconds(r.start), r.n, r.max_latency_s) for r in windows.collect()) == [(0, 3, 0.3), (7200, 1, 0.5)]
    assert sorted((seconds(r.start), seconds(r.end), r.client_id, r.n) for r in sessions.collect()) == [(10, 1810, 1, 1), (3000, 5390, 1, 2), (9000, 10_800, 2, 1)]


@pytest.mark.parametrize("slices", [1, 5, 64])
def test_sliding_rates_equal_plain_counts(spark, slices):
    rng = random.Random(slices)
    rows = [(k, rng.choice([1, 1, 1, 2, 3]), "allow", 0.1, rng.randrange(900)) for k in range(500)] + [(600, 1, "allow", 0.1, None)]
    got = mt.sliding_rate_report(at(spark.createDataFrame(rows, EVENT), "ts"), limit=6, seconds=30, slices=slices).collect()
    want = [(c, k, n) for k, c, _, _, s in rows if s is not None and (n := sum(o[1] == c and o[4] is not None and s - 30 < o[4] <= s for o in rows)) > 6]
    assert sorted((r.client_id, r.comment_id, r.n) for r in got) == sorted(want)
    assert mt.sliding_rate_report(at(spark.createDataFrame([], EVENT), "ts")).count() == 0


def test_queue_survives_replays(spark, tmp_path):
    rng, root = random.Random(1), str(tmp_path / "q")
    rows = [(k, 1, rng.choice(["allow", "flag_for_review"]), 0.1, rng.randrange(100)) for k in range(300)]
    for batch_id, start in enumerate((0, 100, 200)):
        batch = at(spark.createDataFrame(rows[start : start + 100], EVENT), "ts")
        for _ in range(2):
            live.advance_queue(batch, batch_id, root, n=20)
    want = sorted(((r[4], r[0]) for r in rows if r[2] == "flag_for_review"), reverse=True)[:20]
    assert sorted(r.comment_id for r in live.current_queue(spark, root).collect()) == sorted(k for _, k in want)
    assert live.queue_versions(spark, root) == [1, 2]
    live.advance_queue(batch.limit(0), 3, root, n=20)
    assert live.current_queue(spark, root).count() == 20


def test_sketches_roll_up_within_their_error(spark):
    frame = spark.range(60_000).select(F.timestamp_seconds(F.lit(int(START.timestamp())) + F.col("id") * 3).alias("ts"), (F.rand(3) * F.rand(4)).alias("latency_s"))
    sketches = mt.latency_sketches(frame)
    assert sketches.count() == 50
    exact = frame.select(F.window("ts", "1 day")["start"].alias("start"), "latency_s").toPandas().groupby("start").latency_s
    for row in mt.merged_latencies(sketches).collect():
        values = exact.get_group(row.start)
        assert row.n == len(values)
        for p, q in ((0.5, row.p50), (0.95, row.p95), (0.99, row.p99)):
            assert abs((values <= q).mean() - p) <= 2 * mt.SKETCH_ERROR
    assert mt.merged_latencies(mt.latency_sketches(frame.limit(0))).count() == 0
