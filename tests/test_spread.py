"""How rows are dealt out to tasks, and what a task holds."""

import pytest
from pyspark.sql import functions as F

from commentguard.operators.moderation import moderate
from commentguard.plans import inputs as inp
from commentguard.plans.queries import QUERIES
from commentguard.streaming import live
from tests.golden import sample_frame

SF = "/root/testdata/sf0.001"


def most_in_a_task(df):
    return max(r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect())


@pytest.mark.parametrize("files", [1, 20])
def test_no_split_keeps_more_rows_than_a_task_should(spark, tmp_path, monkeypatch, files):
    """Splits are cut by bytes and by row groups: a large table of narrow rows may be one."""
    monkeypatch.setattr(inp, "SPREAD_ROWS", 1_000)
    monkeypatch.setattr(inp, "TASK_ROWS", 500)
    cut = F.when(F.col("id") < 9_000, 0).otherwise(F.col("id") % files)  # nearly all rows in one file
    spark.range(10_000).repartition(files, cut).write.parquet(str(tmp_path / "t.parquet"))
    table = inp.table(spark, str(tmp_path), "t")
    assert table.count() == 10_000 and most_in_a_task(table) <= 510
    monkeypatch.setattr(inp, "TASK_ROWS", 100_000)
    assert inp.tasks_for(spark.read.parquet(str(tmp_path / "t.parquet"))) is None
    spark.range(0).write.parquet(str(tmp_path / "empty.parquet"))
    assert inp.table(spark, str(tmp_path), "empty").count() == 0


def test_stream_is_dealt_out_as_its_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(inp, "SPREAD_ROWS", 10)
    monkeypatch.setattr(inp, "TASK_ROWS", 20)
    seen = []
    running = inp.event_stream(spark, SF).writeStream.foreachBatch(lambda batch, _: seen.append((batch.count(), most_in_a_task(batch))))
    running.option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{SF}/events.parquet").count()
    assert sum(n for n, _ in seen) == rows and all(most <= 22 for _, most in seen)


def test_newest_for_review_are_those_of_the_whole_table(spark):
    rows = sample_frame(spark).withColumns({
        "ts": F.timestamp_seconds(F.col("comment_id") % 7), "model_toxicity_score": F.when(F.col("comment_id") % 3 == 0, F.lit(0.7)),
    })
    decided = moderate(rows).where("predicted_action = 'flag_for_review'").orderBy(F.desc("ts"), F.desc("comment_id"))
    for n in (3, 1000):
        newest = live.newest_for_review(rows, n)
        assert sorted(newest.collect(), key=str) == sorted(decided.limit(n).collect(), key=str) and newest.schema == decided.schema


def test_ids_are_counted_before_they_are_replicated(spark):
    plan = QUERIES["d11_replicate"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Generate explode", 1)
    assert "Aggregate" in above and "Aggregate" in below and "Expand" not in plan
