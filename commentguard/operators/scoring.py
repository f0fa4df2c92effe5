"""Models as pluggable callables: ``texts -> scores`` or ``texts -> labels``."""

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from commentguard.functions import decision as dc
from commentguard.operators.moderation import sentiment_balance

MODEL_BATCH = 32
# Texts that lie in a worker as Python strings at once, or one batch of the model.
PIECE = 512


def _in_batches(texts: list[str], call: Callable, size: int) -> list:
    out: list = []
    for start in range(0, len(texts), size):
        out.extend(call(texts[start : start + size]))
    return out


def register_scorer(scorer: Callable[[list[str]], list[float]], batch_size: int = MODEL_BATCH):
    """A column function from a callable that scores a list of texts.

    Loading belongs into the callable (a cached loader), so that every Python
    worker loads its model once.  NULL texts score NULL.
    """

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out, size = [], max(PIECE, batch_size)
            # Texts become Python's a piece at a time: a batch of them may be long.
            for start in range(0, len(batch), size):
                piece = batch.slice(start, size)
                scores = iter(_in_batches(piece.drop_null().to_pylist(), scorer, batch_size))
                out += [next(scores) if valid else None for valid in piece.is_valid().to_pylist()]
            yield pa.array(out, pa.float64(), from_pandas=True)  # no number is null

    return score


def _label_udf(model: Callable, batch_size: int):
    @F.pandas_udf("label string, score double")
    def classify(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                found = _in_batches(batch.tolist(), model, batch_size)
                yield pd.DataFrame(
                    {"label": [f["label"] for f in found], "score": [round(f["score"], 4) for f in found]}
                )
            except Exception:  # any model failure falls back to the word balance
                yield pd.DataFrame({"label": [None] * len(batch), "score": [None] * len(batch)})

    return classify


def score_sentiment(
    df: DataFrame, normalized: str = "normalized_text", model: Callable | None = None,
    batch_size: int = MODEL_BATCH,
) -> DataFrame:
    """Add sentiment_label, sentiment_score and sentiment_source.

    ``model`` maps a list of texts to dicts of label and score; a batch it
    fails on, like every row without a model, takes the word balance.
    """
    df = df.withColumn("_balance", sentiment_balance(normalized))
    label, score = dc.sentiment_label(F.col("_balance")), dc.sentiment_score(F.col("_balance"))
    source: Column = F.lit("heuristic")
    if model is not None:
        df = df.withColumn("_model", _label_udf(model, batch_size)(F.col(normalized)))
        given = F.col("_model.label").isNotNull()
        label = F.when(given, dc.model_label(F.col("_model.label"))).otherwise(label)
        score = F.when(given, F.col("_model.score")).otherwise(score)
        source = F.when(given, F.lit("model")).otherwise(source)
    return df.withColumns(
        {"sentiment_label": label, "sentiment_score": score, "sentiment_source": source}
    ).drop("_balance", "_model")
