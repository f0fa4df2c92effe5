"""The same decisions on streams."""

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from commentguard import fixed_values as fv
from commentguard.operators.moderation import moderate
from commentguard.sources.tables import audit_rows


def moderate_stream(stream: DataFrame, **options) -> DataFrame:
    """Moderate a stream: the batch plan is free of shuffles and state already."""
    return moderate(stream, **options)


def route_batch(decided: DataFrame, batch_id: int, root: str) -> None:
    """Write a micro-batch to its sinks: every decision, the audit of those not
    allowed, and the comments waiting for review.

    Each sink has one folder per batch that is overwritten, so a batch that is
    repeated after a failure leaves the same rows.
    """
    decided = decided.persist()
    parts = {
        "decisions": decided,
        "audit": audit_rows(decided),
        "review": decided.filter(F.col("predicted_action") == "flag_for_review"),
    }
    try:
        for name, rows in parts.items():
            rows.write.mode("overwrite").parquet(f"{root}/{name}/batch_id={batch_id}")
    finally:
        decided.unpersist()


def start_routing(stream: DataFrame, root: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Moderate a stream and route its micro-batches below ``root``."""
    writer = moderate_stream(stream).writeStream.foreachBatch(
        lambda batch, batch_id: route_batch(batch, batch_id, root)
    )
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()


def latest_view(spark: SparkSession, root: str, n: int = fv.REVIEW_QUEUE_SIZE) -> DataFrame:
    """The newest comments of the review sink."""
    return spark.read.parquet(f"{root}/review").orderBy(F.desc("ts"), F.desc("comment_id")).limit(n)


def queue_versions(spark: SparkSession, root: str) -> list[int]:
    """The numbers of the queue's versions, oldest first."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/queue")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in files.listStatus(path)] if files.exists(path) else []
    return sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version=") and files.exists(
        spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/queue/{n}/_SUCCESS")))


def advance_queue(batch: DataFrame, batch_id: int, root: str, n: int = fv.REVIEW_QUEUE_SIZE) -> None:
    """The queue of the newest ``n`` comments for review, after a micro-batch.

    The state is one table of at most ``n`` rows for each micro-batch, made of
    the one before and the newest of the batch, of which each task keeps ``n``.
    A micro-batch that is repeated starts from the version before it again and
    leaves the same; only the last two versions stay.
    """
    spark, newest = batch.sparkSession, [F.desc("ts"), F.desc("comment_id")]
    waiting = batch.where(F.col("predicted_action") == "flag_for_review").orderBy(*newest).limit(n)
    before = [v for v in queue_versions(spark, root) if v < batch_id]
    if before:
        waiting = waiting.unionByName(spark.read.schema(batch.schema).parquet(f"{root}/queue/version={before[-1]}"))
    waiting.orderBy(*newest).limit(n).write.mode("overwrite").parquet(f"{root}/queue/version={batch_id}")
    for old in before[:-1]:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/queue/version={old}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def newest_for_review(batch: DataFrame, n: int = fv.REVIEW_QUEUE_SIZE) -> DataFrame:
    """The newest ``n`` comments of a table that go to review, moderated.

    Only their action is decided for all comments; the other fields are made
    for the ``n`` that stay.
    """
    acted = moderate(batch.withColumn("_row", F.struct(*batch.columns)), fields=["predicted_action"])
    waiting = acted.where(F.col("predicted_action") == "flag_for_review").orderBy(F.desc("ts"), F.desc("comment_id")).limit(n)
    return moderate(waiting.select("_row.*"))


def start_queue(stream: DataFrame, root: str, checkpoint: str, n: int = fv.REVIEW_QUEUE_SIZE, **trigger) -> StreamingQuery:
    """Moderate a stream and keep the queue of its newest comments for review below ``root``."""
    writer = stream.writeStream.foreachBatch(lambda batch, batch_id: advance_queue(newest_for_review(batch, n), batch_id, root, n))
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()


def current_queue(spark: SparkSession, root: str) -> DataFrame:
    """The queue as the last complete micro-batch left it."""
    return spark.read.parquet(f"{root}/queue/version={queue_versions(spark, root)[-1]}")
