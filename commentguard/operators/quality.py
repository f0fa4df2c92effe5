"""Distribution, duplicate and validity reports on labelled examples."""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from commentguard import fixed_values as fv
from commentguard.functions import text as tx
from commentguard.operators.ranks import salted_join
from commentguard.plans.shared import written

DISTRIBUTION_DIMENSIONS = [
    "moderation_action", "label_primary", "abuse_category", "source_type", "split", "language_mix",
]


def class_distribution(df: DataFrame, dimensions: list[str] = DISTRIBUTION_DIMENSIONS) -> DataFrame:
    """(dimension, value, count) of several columns in one pass."""
    pairs = F.array(*[
        F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions
    ])
    return (
        df.select(F.explode(pairs).alias("_p"))
        .groupBy("_p.dimension", "_p.value")
        .agg(F.count("*").alias("count"))
    )


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    return class_distribution(df, columns)


def duplicate_texts(df: DataFrame, text: str = "text") -> DataFrame:
    """Texts that occur more than once, NULL among them.

    Only hashes are shuffled; the texts are fetched for those that repeat, one
    of each.
    """
    digest = F.sha2(F.coalesce(F.concat(F.lit("t"), F.col(text)), F.lit("")), 256)
    repeated = df.groupBy(digest.alias("_h")).agg(F.count("*").alias("count")).filter("count > 1")
    texts = df.select(digest.alias("_h"), F.col(text).alias("duplicate_text")).join(repeated, "_h")
    return texts.groupBy("_h", "count").agg(F.max("duplicate_text").alias("duplicate_text")).select("duplicate_text", "count")


def duplicate_count(df: DataFrame, text: str = "text") -> DataFrame:
    """How many texts occur more than once; only hashes are shuffled."""
    hashed = df.groupBy(F.sha2(F.col(text), 256).alias("h")).agg(F.count("*").alias("n"))
    return hashed.agg(F.count_if(F.col("n") > 1).alias("n_duplicate_texts"))


def _blank(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) == ""


def _row_violations() -> Column:
    """Array of (check, detail) for what a row alone shows."""
    found: list[tuple[Column, str, Column]] = []
    for field in fv.REQUIRED_FIELDS:
        found.append((_blank(field), f"missing {field}", F.lit("")))
    for field, domain in fv.ENUM_DOMAINS.items():
        value = F.coalesce(F.col(field), F.lit(""))
        found.append((~value.isin(domain), f"invalid {field}", value))
    labels = F.coalesce(F.col("labels_multi"), F.lit(""))
    found.append((~tx.is_json(labels), "labels_multi is not valid JSON", F.lit("")))
    found.append((tx.is_json(labels) & ~tx.is_json_list(labels), "labels_multi must be a JSON list", F.lit("")))
    text = F.coalesce(F.col("text"), F.lit(""))
    found.append((tx.has_email(text), "possible email in text", F.lit("")))
    found.append((tx.has_phone(text), "possible phone number in text", F.lit("")))
    for field in fv.PROVENANCE_FIELDS:
        open_source = F.coalesce(F.col("source_type") == "open_source", F.lit(False))
        found.append((open_source & _blank(field), f"open_source row missing {field}", F.lit("")))
    return F.array_compact(F.array(*[
        F.when(test, F.struct(F.lit(check).alias("check"), detail.alias("detail")))
        for test, check, detail in found
    ]))


def validate_examples(df: DataFrame, row_key: str, expected_rows: int | None = None) -> DataFrame:
    """(row_key, check, detail) for every violation; no rows when all is well.

    Checks on the whole table carry a NULL row key.  Of rows with the same id,
    the one with the lowest ``row_key`` stands and the others are violations.
    The examples are read once; what the checks need of them (key, id, hash of
    the text, own violations) is kept as a narrow table.
    """
    checked = written(
        df.select(
            row_key, F.coalesce("example_id", F.lit("")).alias("example_id"),
            F.sha2(F.coalesce("text", F.lit("")), 256).alias("_h"), _row_violations().alias("_found"),
        ),
        "examples-checked",
    )
    by_row = checked.select(row_key, F.explode("_found").alias("_v")).select(row_key, "_v.check", "_v.detail")
    ids = checked.select(row_key, "example_id")
    repeated = (
        ids.groupBy("example_id")
        .agg(F.min(row_key).alias("_first"), F.count("*").alias("_n"))
        .filter("_n > 1")
        .drop("_n")
    )
    duplicate_ids = (
        salted_join(ids, repeated, "example_id", [row_key])
        .filter(F.col(row_key) > F.col("_first"))
        .select(row_key, F.lit("duplicate example_id").alias("check"), F.col("example_id").alias("detail"))
    )
    no_key = F.lit(None).cast(df.schema[row_key].dataType).alias(row_key)
    whole = [
        checked.groupBy("_h").agg(F.count("*").alias("n"))
        .agg(F.count_if(F.col("n") > 1).alias("n_duplicate_texts"))
        .filter("n_duplicate_texts > 0")
        .select(no_key, F.lit("duplicate text values").alias("check"), F.col("n_duplicate_texts").cast("string").alias("detail"))
    ]
    if expected_rows is not None:
        whole.append(
            checked.agg(F.count("*").alias("n"))
            .filter(F.col("n") != expected_rows)
            .select(no_key, F.lit("unexpected row count").alias("check"), F.col("n").cast("string").alias("detail"))
        )
    return reduce(DataFrame.unionByName, [by_row, duplicate_ids, *whole])


def quality_tables(df: DataFrame) -> dict[str, DataFrame]:
    """The report tables of a dataset: distribution, duplicates, PII scan."""
    pii = df.agg(
        F.count_if(F.col("contains_pii") == "true").alias("contains_pii_column"),
        F.count_if(tx.has_email("text")).alias("email_regex"),
        F.count_if(tx.has_phone("text")).alias("phone_regex"),
    ).unpivot([], ["contains_pii_column", "email_regex", "phone_regex"], "check", "n_rows")
    return {
        "class_distribution": class_distribution(df),
        "duplicates": duplicate_texts(df),
        "pii_scan": pii.withColumn("status", F.when(F.col("n_rows") == 0, F.lit("pass")).otherwise(F.lit("fail"))),
    }
