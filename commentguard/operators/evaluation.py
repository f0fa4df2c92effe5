"""Labels against predictions.

All metrics derive from one small cube: the row counts by (slice, actual,
predicted).  Counting it is the only pass over the data and the only shuffle.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from commentguard import fixed_values as fv
from commentguard.functions.numeric import ratio, round_nearest

_EDGE_SPACE = f"^[{fv.SPACE}]+|[{fv.SPACE}]+$"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, _EDGE_SPACE, "")


def prepare_eval(
    df: DataFrame, label: str = "moderation_action", text: str = "text",
    language: str = "language_mix",
) -> tuple[DataFrame, DataFrame]:
    """Clean labelled rows and split them into (usable, skipped).

    A row without text or with an unknown label is skipped.  Blank percentages
    become 90 and 5, a blank language "unknown".
    """

    def pct(name: str, default: float) -> Column:
        value = F.col(name).cast("string")
        blank = value.isNull() | (value == "")
        return F.when(blank, F.lit(default)).otherwise(value.try_cast("double"))

    clean = {
        text: strip(F.coalesce(F.col(text), F.lit(""))),
        label: F.lower(strip(F.coalesce(F.col(label), F.lit("")))),
        "movie_rating_perfection_pct": pct("movie_rating_perfection_pct", 90.0),
        "movie_rating_skip_pct": pct("movie_rating_skip_pct", 5.0),
        language: F.coalesce(F.nullif(strip(F.col(language)), F.lit("")), F.lit("unknown")),
    }
    cleaned = df.withColumns({n: c for n, c in clean.items() if n in df.columns})
    usable = (F.col(text) != "") & F.col(label).isin(fv.ACTIONS)
    return cleaned.filter(usable), cleaned.filter(~usable)


def confusion_counts(
    df: DataFrame, actual: str = "moderation_action", predicted: str = "predicted_action",
    by: list[str] | None = None,
) -> DataFrame:
    """The cube: (by..., actual, predicted, n), observed cells only."""
    return df.groupBy(
        *(by or []), F.col(actual).alias("actual"), F.col(predicted).alias("predicted")
    ).agg(F.count("*").alias("n"))


def confusion_matrix(counts: DataFrame, labels: list[str] = fv.ACTIONS) -> DataFrame:
    """Every (actual, predicted) cell with its count, zeros included."""
    empty = counts.sparkSession.createDataFrame(
        [(a, p, 0) for a in labels for p in labels], "actual string, predicted string, n long"
    )
    cells = counts.select("actual", "predicted", "n").unionByName(empty)
    return cells.groupBy("actual", "predicted").agg(F.sum("n").alias("n"))


def class_metrics(
    counts: DataFrame, by: list[str] | None = None, labels: list[str] = fv.ACTIONS
) -> DataFrame:
    """tp, fp, fn, support, precision, recall and F1 per label (and slice)."""
    by = by or []
    per_label = counts.withColumn("label", F.explode(F.array(*[F.lit(v) for v in labels])))
    is_actual, is_predicted = F.col("actual") == F.col("label"), F.col("predicted") == F.col("label")

    def total(test: Column, name: str) -> Column:
        return F.sum(F.when(test, F.col("n")).otherwise(F.lit(0))).alias(name)

    sums = per_label.groupBy(*by, "label").agg(
        total(is_actual & is_predicted, "tp"),
        total(~is_actual & is_predicted, "fp"),
        total(is_actual & ~is_predicted, "fn"),
    )
    rates = sums.withColumns({
        "support": F.col("tp") + F.col("fn"),
        "precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")),
        "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn")),
    })
    both = F.col("precision") + F.col("recall")
    return rates.withColumn("f1", ratio(F.lit(2.0) * F.col("precision") * F.col("recall"), both))


def summary_metrics(metrics: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Total, accuracy, macro F1 (labels with support), weighted F1 and the
    majority baseline, one row per slice."""
    by = by or []
    has_support = F.col("support") > 0
    order = F.array_position(F.array(*[F.lit(a) for a in fv.ACTIONS]), F.col("label"))
    out = metrics.groupBy(*by).agg(
        F.sum("support").alias("total"),
        F.sum("tp").alias("correct"),
        F.sum(F.when(has_support, F.col("f1"))).alias("_f1_sum"),
        F.count_if(has_support).alias("_f1_n"),
        F.sum(F.col("f1") * F.col("support")).alias("_f1_weighted"),
        F.max_by("label", F.struct("support", -order)).alias("majority_label"),
        F.max("support").alias("_majority"),
    )
    return out.select(
        *by, "total",
        ratio(F.col("correct"), F.col("total")).alias("accuracy"),
        ratio(F.col("_f1_sum"), F.col("_f1_n")).alias("macro_f1"),
        ratio(F.col("_f1_weighted"), F.col("total")).alias("weighted_f1"),
        "majority_label",
        ratio(F.col("_majority"), F.col("total")).alias("baseline_accuracy"),
    )


def accuracy(counts: DataFrame) -> DataFrame:
    return summary_metrics(class_metrics(counts)).select("total", "accuracy")


def naive_baseline(counts: DataFrame) -> DataFrame:
    return summary_metrics(class_metrics(counts)).select("majority_label", "baseline_accuracy")


def metrics_by(counts: DataFrame, by: str = "language_mix") -> DataFrame:
    """Count, accuracy and macro F1 per slice, to four decimals."""
    per_slice = summary_metrics(class_metrics(counts, [by]), [by])
    return per_slice.select(
        by, F.col("total").alias("count"),
        round_nearest(F.col("accuracy"), 4).alias("accuracy"),
        round_nearest(F.col("macro_f1"), 4).alias("macro_f1"),
    )


def binary_counts(counts: DataFrame) -> DataFrame:
    """The cube folded to safe (allow) and unsafe (anything else)."""

    def side(name: str) -> Column:
        return F.when(F.col(name) == "allow", F.lit("safe")).otherwise(F.lit("unsafe"))

    return counts.groupBy(side("actual").alias("actual"), side("predicted").alias("predicted")).agg(
        F.sum("n").alias("n")
    )


def binary_report(counts: DataFrame) -> DataFrame:
    return class_metrics(binary_counts(counts), labels=["safe", "unsafe"])


def slice_flag_rate(df: DataFrame, condition: Column, predicted: str = "predicted_action") -> DataFrame:
    """Share of flagged rows in a slice: the false-positive rate on criticism,
    or the catch rate on rows aimed at people."""
    return df.filter(condition).agg(
        F.count("*").alias("n_rows"),
        F.avg((F.col(predicted) != "allow").cast("double")).alias("flag_rate"),
    )


def is_harsh_criticism(labels_multi: str = "labels_multi") -> Column:
    return F.rlike(F.col(labels_multi), F.lit("harsh_criticism|actor_work_criticism"))


def aims_at_people(target: str = "target_detected") -> Column:
    return F.col(target).isin(fv.PERSON_OR_GROUP_TARGETS)


def attach_predictions(labels: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """Labels and predictions side by side, matched by key."""
    return labels.join(predictions, key)


def eval_report(
    counts: DataFrame, by: str = "language_mix", dataset: str = "", version: str = "",
    revision: str = "", skipped: int = 0,
) -> DataFrame:
    """The whole report as one row; ``counts`` is the cube by (by, actual, predicted).

    Each cell counts for its slice and for the total.  A slice becomes one row of
    nine counts, and every figure is arithmetic on those, so the cube, and the
    data below it, is read once.
    """
    slices = F.array(
        F.struct(F.lit(True).alias("total"), F.lit(None).cast("string").alias("name")),
        F.struct(F.lit(False).alias("total"), F.col(by).cast("string").alias("name")),
    )
    pairs = [(a, p) for a in fv.ACTIONS for p in fv.ACTIONS]

    def cell(a: str, p: str) -> Column:
        return F.col(f"{a}/{p}")

    def added(columns: list[Column]) -> Column:
        return reduce(lambda x, y: x + y, columns)

    rows = counts.withColumn("slice", F.explode(slices)).groupBy("slice").agg(*[
        F.sum(F.when((F.col("actual") == a) & (F.col("predicted") == p), F.col("n")).otherwise(0)).alias(f"{a}/{p}")
        for a, p in pairs
    ])
    figures = {}
    for a in fv.ACTIONS:
        figures[f"{a} support"] = added([cell(a, p) for p in fv.ACTIONS])
        figures[f"{a} precision"] = ratio(cell(a, a), added([cell(x, a) for x in fv.ACTIONS]))
        figures[f"{a} recall"] = ratio(cell(a, a), figures[f"{a} support"])
    rows = rows.withColumns(figures)
    rows = rows.withColumns({
        f"{a} f1": ratio(
            F.lit(2.0) * F.col(f"{a} precision") * F.col(f"{a} recall"),
            F.col(f"{a} precision") + F.col(f"{a} recall"),
        )
        for a in fv.ACTIONS
    })
    supports = {a: F.col(f"{a} support") for a in fv.ACTIONS}
    f1 = {a: F.col(f"{a} f1") for a in fv.ACTIONS}
    total = added(list(supports.values()))
    rows = rows.withColumns({
        "count": total,
        "accuracy": ratio(added([cell(a, a) for a in fv.ACTIONS]), total),
        "macro_f1": ratio(
            added([F.when(supports[a] > 0, f1[a]).otherwise(0.0) for a in fv.ACTIONS]),
            added([(supports[a] > 0).cast("int") for a in fv.ACTIONS]),
        ),
        "weighted_f1": ratio(added([f1[a] * supports[a] for a in fv.ACTIONS]), total),
    })
    measured = [c for c in rows.columns if c.split(" ")[-1] in {"precision", "recall", "f1", "accuracy", "macro_f1", "weighted_f1"}]
    rows = rows.withColumns({c: round_nearest(F.col(c), 4) for c in measured})
    rows = rows.withColumns({
        "per_class": F.array(*[
            F.struct(F.lit(a).alias("label"), *[F.col(f"{a} {m}").alias(m) for m in ("precision", "recall", "f1", "support")])
            for a in fv.ACTIONS
        ]),
        "confusion": F.array(*[
            F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), cell(a, p).alias("n")) for a, p in pairs
        ]),
    })
    whole = F.col("slice.total")

    def of_total(name: str) -> Column:
        return F.max_by(name, whole).alias(name)

    per_slice = F.struct(F.col("slice.name").alias(by), "count", "accuracy", "macro_f1")
    return rows.agg(
        F.max_by("count", whole).alias("total"),
        *[of_total(c) for c in ("accuracy", "macro_f1", "weighted_f1", "per_class", "confusion")],
        F.sort_array(F.collect_list(F.when(~whole, per_slice))).alias("per_language"),
    ).withColumns({
        "dataset_path": F.lit(dataset),
        "generated_at": F.current_timestamp(),
        "engine_version": F.lit(version),
        "revision": F.lit(revision),
        "skipped": F.lit(skipped),
    })


def eval_report_json(report: DataFrame) -> DataFrame:
    return report.select(F.to_json(F.struct("*")).alias("report"))
