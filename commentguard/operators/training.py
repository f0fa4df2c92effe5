"""Risk weights from labelled examples by logistic regression.

The four features take few values between them (three flags and a toxicity of
at most 64 levels), so the examples collapse to at most 1,024 counted rows.
One pass over the data builds that table; the descent then runs on it, and is
the same full-batch descent as over the single rows.
"""

import numpy as np
from pyspark.sql import DataFrame, functions as F

from commentguard import fixed_values as fv
from commentguard.functions import decision as dc
from commentguard.operators.evaluation import strip
from commentguard.operators.moderation import with_heuristics

FEATURES = ["is_reply", "has_mention", "is_negative", "htox"]
WEIGHT_NAMES = ["reply_context_base", "has_mention", "negative_sentiment", "toxicity_scale"]
_MAX_FEATURE_ROWS = 2 * 2**3 * 2 ** len(fv.TOXICITY_POINTS)


def risk_features(df: DataFrame, label: str = "moderation_action") -> DataFrame:
    """The features and the 0/1 label (not allowed) of every usable row."""
    cleaned = df.withColumn("_label", F.lower(strip(F.col(label)))).filter(
        (F.coalesce(F.col("text"), F.lit("")) != "") & F.col("_label").isin(fv.ACTIONS)
    )
    out = with_heuristics(cleaned)
    return out.select(
        *[c for c in df.columns if c not in FEATURES],
        dc.is_reply(F.col("context_type")).cast("double").alias("is_reply"),
        F.col("sig_has_mention").cast("double").alias("has_mention"),
        (F.col("_balance") > 0).cast("double").alias("is_negative"),
        F.col("_htox").alias("htox"),
        (F.col("_label") != "allow").cast("double").alias("flagged"),
    )


def feature_counts(features: DataFrame) -> DataFrame:
    return features.groupBy(*FEATURES, "flagged").agg(F.count("*").alias("n"))


def fit_risk_weights(
    features: DataFrame, rate: float = 0.1, rounds: int = 200
) -> dict[str, float]:
    """Fitted, unclamped weights by name."""
    rows = feature_counts(features).limit(_MAX_FEATURE_ROWS + 1).collect()
    if len(rows) > _MAX_FEATURE_ROWS:
        raise ValueError("features are not the ones of risk_features")
    if not rows:
        raise ValueError("no labelled rows")
    rows.sort()
    x = np.array([[r[f] for f in FEATURES] for r in rows])
    y = np.array([r["flagged"] for r in rows])
    n = np.array([r["n"] for r in rows], dtype=float)
    weights, bias = np.zeros(len(FEATURES)), 0.0
    for _ in range(rounds):
        margin = np.clip(x @ weights + bias, -500, 500)
        error = (1 / (1 + np.exp(-margin)) - y) * n / n.sum()
        weights, bias = weights - rate * (error @ x), bias - rate * error.sum()
    return dict(zip(WEIGHT_NAMES, weights.tolist()))


def clamp_weights(weights: dict[str, float]) -> dict[str, float]:
    """A weight table to moderate with: fitted values inside their bounds."""
    out = dict(fv.WEIGHT_FALLBACKS)
    for name, (low, high) in fv.WEIGHT_CLAMPS.items():
        out[name] = round(max(low, min(high, weights[name])), 4)
    return out


def weights_table(features: DataFrame, **options) -> DataFrame:
    """(weight, fitted, clamped) rows."""
    fitted = fit_risk_weights(features, **options)
    clamped = clamp_weights(fitted)
    rows = [(name, fitted[name], clamped[name]) for name in WEIGHT_NAMES]
    return features.sparkSession.createDataFrame(rows, "weight string, fitted double, clamped double")
