"""Moderator feedback against the audited decisions."""

from pyspark.sql import DataFrame, Window, functions as F

from commentguard.operators.ranks import salted_join
from commentguard.plans.shared import written


def latest_feedback(feedback: DataFrame) -> DataFrame:
    """The last human action per text; combines before the shuffle."""
    newest = F.max_by(F.struct("human_action", "moderator_id", "timestamp"), F.struct("timestamp", "moderator_id"))
    return feedback.groupBy("text_hash").agg(newest.alias("_f")).select(
        "text_hash", "_f.human_action", "_f.moderator_id", F.col("_f.timestamp").alias("feedback_ts")
    )


def join_feedback(audit: DataFrame, feedback: DataFrame, key: str = "request_id") -> DataFrame:
    """Audited decisions with the latest human action on the same text.

    One text may be audited very often, so the join is salted.
    """
    return salted_join(audit, latest_feedback(feedback), "text_hash", [key])


def feedback_disagreement(audit: DataFrame, feedback: DataFrame, key: str = "request_id") -> DataFrame:
    """Counts by (decided, human) action."""
    return join_feedback(audit, feedback, key).groupBy(
        F.col("action").alias("decided"), F.col("human_action").alias("human")
    ).agg(F.count("*").alias("n"))


def override_rate(disagreement: DataFrame) -> DataFrame:
    changed = F.sum(F.when(F.col("decided") != F.col("human"), F.col("n")).otherwise(F.lit(0)))
    return disagreement.agg(
        F.sum("n").alias("n_reviewed"), changed.alias("n_overridden"),
        (changed / F.sum("n")).alias("override_rate"),
    )


def attach_feedback(
    decisions: DataFrame, feedback: DataFrame, ts: str = "ts", key: str = "comment_id", within_days: float = 7, slices: int | None = None,
) -> DataFrame:
    """Each feedback with the latest decision on its text that was made before it.

    ``decisions`` has text_hash, predicted_action, ``ts`` and ``key``; ``feedback``
    has feedback_id, text_hash, human_action and timestamp.  Returns one row for
    each feedback: text_hash, feedback_id, feedback_at, human_action, ``key``,
    decided_at and predicted_action; the last three are null where the text had
    no decision in the days before.  A decision of the same instant counts as
    before, of several at one instant the largest ``key`` is the latest.

    Both sides become one table in time order.  A text's time is cut into
    ``slices``, so a text with a third of all rows spreads over tasks; inside a
    slice the last decision so far is carried along, and each slice hands on its
    last one.  Nothing is paired.
    """
    spark = decisions.sparkSession
    slices = slices or max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    made = F.struct(F.unix_micros(F.col(ts).cast("timestamp_ltz")).alias("at"), F.col(key).alias("id"), F.col("predicted_action").alias("action"))
    sides = decisions.where(F.col(ts).isNotNull()).select("text_hash", made["at"].alias("at"), made.alias("made"), F.lit(None).alias("human_action"), F.lit(None).alias("feedback_id"))
    asked = feedback.select(
        "text_hash", F.unix_micros(F.col("timestamp").cast("timestamp_ltz")).alias("at"), F.lit(None).alias("made"), "human_action", "feedback_id"
    )
    both = written(sides.withColumn("is_feedback", F.lit(False)).unionByName(asked.withColumn("is_feedback", F.lit(True))), "feedback-times")
    lo, hi = both.agg(F.min("at"), F.max("at")).first()
    width = max(1, -(-((hi or 0) - (lo or 0) + 1) // slices))
    both = both.withColumn("_slice", F.floor((F.col("at") - F.lit(lo or 0)) / width))

    inside = Window.partitionBy("text_hash", "_slice").orderBy("at", "is_feedback", "made.id", "feedback_id")
    so_far = F.last("made", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    answered = both.withColumn("_made", so_far).where("is_feedback")
    ends = both.groupBy("text_hash", "_slice").agg(F.max("made").alias("made"))
    earlier = Window.partitionBy("text_hash").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("text_hash", "_slice", F.last("made", ignorenulls=True).over(earlier).alias("_before")).where("_before is not null")
    answered = answered.join(ends, ["text_hash", "_slice"], "left").withColumn("_made", F.coalesce("_made", "_before"))
    near = F.col("at") - F.col("_made.at") <= round(within_days * 86_400_000_000)
    found = answered.withColumn("_made", F.when(near, F.col("_made")))
    return found.select(
        "text_hash", "feedback_id", F.timestamp_micros("at").alias("feedback_at"), "human_action", F.col("_made.id").alias(key),
        F.timestamp_micros("_made.at").alias("decided_at"), F.col("_made.action").alias("predicted_action"),
    )
