"""Top lists.  Each is a sort with a limit, which Spark runs as a per-partition
top-n and a merge; none sorts the whole input."""

from pyspark.sql import DataFrame, functions as F

from commentguard import fixed_values as fv


def review_queue(decided: DataFrame, n: int = 20, key: str = "comment_id") -> DataFrame:
    """Flagged comments, action then risk descending (review sorts before removal)."""
    return (
        decided.filter(F.col("predicted_action") != "allow")
        .orderBy(F.desc("predicted_action"), F.desc("risk_score"), key)
        .limit(n)
    )


def top_risk(decided: DataFrame, n: int = 20, key: str = "comment_id") -> DataFrame:
    return decided.orderBy(F.desc(F.col("predicted_action") != "allow"), F.desc("risk_score"), key).limit(n)


def latest_review_items(
    decided: DataFrame, n: int = fv.REVIEW_QUEUE_SIZE, ts: str = "ts", key: str = "comment_id"
) -> DataFrame:
    """The newest comments waiting for review."""
    return (
        decided.filter(F.col("predicted_action") == "flag_for_review").orderBy(F.desc(ts), F.desc(key)).limit(n)
    )


def limit_rows(df: DataFrame, order: list[str], n: int = 500) -> DataFrame:
    return df.orderBy(*order).limit(n)


def head_sample(df: DataFrame, order: list[str], n: int = 20) -> DataFrame:
    return limit_rows(df, order, n)
