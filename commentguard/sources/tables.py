"""Reading and writing the library's tables."""

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from commentguard import fixed_values as fv
from commentguard.functions import text as tx
from commentguard.operators.lexicon import build_lexicon, with_index
from commentguard.operators.moderation import resolve_weights
from commentguard.schemas import (
    AUDIT_SCHEMA, EXAMPLE_FIELDS, EXAMPLE_SCHEMA, FEEDBACK_SCHEMA, LEXICON_SCHEMA, RULE_SCHEMA,
)

# Quotes double inside fields, and blanks at the ends of a text stay.
CSV_OPTIONS = {
    "header": True, "multiLine": True, "escape": '"', "quote": '"',
    "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}


def _missing(error: AnalysisException) -> bool:
    return error.getCondition() == "PATH_NOT_FOUND"


# --- Labelled examples -------------------------------------------------------


def read_examples(spark: SparkSession, path: str, format: str = "csv") -> DataFrame:
    """Labelled examples, every field a string, blanks kept as empty text."""
    if format == "parquet":
        return spark.read.schema(EXAMPLE_SCHEMA).parquet(path)
    read = spark.read.schema(EXAMPLE_SCHEMA).options(**CSV_OPTIONS).csv(path)
    return read.fillna("", EXAMPLE_FIELDS)


def write_examples(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_examples_csv(df: DataFrame, path: str) -> None:
    """Write CSV so that readers see the old files or the new ones, not a mix.

    The new files are complete before they take the place of the old, which are
    put back if that fails; in between a reader may find no path for a moment.
    """
    session = df.sparkSession
    mark = uuid.uuid4().hex
    fresh, old = f"{path}.tmp-{mark}", f"{path}.old-{mark}"
    df.write.options(**CSV_OPTIONS).csv(fresh)
    jvm = session.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(session.sparkContext._jsc.hadoopConfiguration())
    replaced = fs.exists(target) and fs.rename(target, jvm.org.apache.hadoop.fs.Path(old))
    if not fs.rename(jvm.org.apache.hadoop.fs.Path(fresh), target):
        if replaced:
            fs.rename(jvm.org.apache.hadoop.fs.Path(old), target)
        raise OSError(f"could not move {fresh} to {path}")
    if replaced:
        fs.delete(jvm.org.apache.hadoop.fs.Path(old), True)


# --- Reference tables --------------------------------------------------------


def policy_rules(spark: SparkSession) -> DataFrame:
    """The built-in policy rules."""
    return spark.createDataFrame(fv.POLICY_RULES, RULE_SCHEMA)


def read_policy_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules from JSON lines; absent fields take defaults, an absent file no rows."""
    defaults = {
        "id": F.lit("unknown_rule"), "description": F.lit(""), "action": F.lit("allow"),
        "category": F.lit("unknown"), "severity": F.lit("none"),
        "examples": F.array().cast("array<string>"),
    }
    try:
        rules = spark.read.schema(RULE_SCHEMA).json(path)
    except AnalysisException as error:
        if not _missing(error):
            raise
        return spark.createDataFrame([], RULE_SCHEMA)
    return rules.select(*[F.coalesce(n, d).alias(n) for n, d in defaults.items()])


def write_policy_rules(rules: DataFrame, path: str) -> None:
    rules.write.mode("overwrite").json(path)


def write_rule_index(index: DataFrame, path: str) -> None:
    """Replace the index table as a whole."""
    index.write.mode("overwrite").parquet(path)


def read_lexicon(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Lexicon rows from CSV (list, phrase), lower-cased and indexed.

    Lists the file does not have keep their built-in words; without a file the
    community list falls back to its short form.
    """
    if path is None:
        return build_lexicon(spark)
    try:
        given = spark.read.schema(LEXICON_SCHEMA).option("header", True).csv(path)
    except AnalysisException as error:
        if not _missing(error):
            raise
        return build_lexicon(spark, {**fv.LEXICON, "community": fv.COMMUNITY_TERMS_FALLBACK})
    given = with_index(given.select("list", F.lower("phrase").alias("phrase")))
    return given.unionByName(build_lexicon(spark).join(given.select("list").distinct(), "list", "left_anti"))


def read_weights(spark: SparkSession, path: str | None = None, profile: str = "current") -> DataFrame:
    """A one-row table of weights and thresholds; absent keys take fallbacks."""
    values = fv.WEIGHT_PROFILES[profile]
    if path is not None:
        schema = ", ".join(f"{name} double" for name in fv.WEIGHT_FALLBACKS)
        try:
            values = resolve_weights(spark.read.schema(schema).json(path), profile)
        except AnalysisException as error:
            if not _missing(error):
                raise
            values = fv.WEIGHT_FALLBACKS
    return spark.createDataFrame([tuple(float(v) for v in values.values())], ", ".join(f"{n} double" for n in values))


# --- Logs --------------------------------------------------------------------


def audit_rows(decided: DataFrame, text: str = "text") -> DataFrame:
    """Audit entries of the decisions that are not an allow; texts only as hashes.

    Optional columns: ts, request_id, latency_ms.
    """

    def optional(name: str, kind: str):
        return F.col(name).cast(kind) if name in decided.columns else F.lit(None).cast(kind)

    when = F.col("ts") if "ts" in decided.columns else F.current_timestamp()
    return decided.filter(F.col("predicted_action") != "allow").select(
        when.alias("timestamp"),
        optional("request_id", "string").alias("request_id"),
        tx.text_hash(text).alias("text_hash"),
        "context_type",
        F.col("predicted_action").alias("action"),
        F.col("predicted_category").alias("category"),
        F.col("predicted_severity").alias("severity"),
        "reason_codes",
        "triggered_rules",
        F.round(optional("latency_ms", "double"), 2).alias("latency_ms"),
    )


def write_audit(audit: DataFrame, path: str) -> None:
    """Append JSON lines, one folder per day."""
    dated = audit.withColumn("date", F.to_date("timestamp"))
    dated.write.mode("append").partitionBy("date").json(path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(AUDIT_SCHEMA).json(path)


def feedback_rows(df: DataFrame) -> DataFrame:
    """Feedback entries with a known action; the moderator defaults to anonymous."""
    if "timestamp" not in df.columns:
        df = df.withColumn("timestamp", F.current_timestamp())
    if "moderator_id" not in df.columns:
        df = df.withColumn("moderator_id", F.lit(None).cast("string"))
    return df.filter(F.col("human_action").isin(fv.ACTIONS)).select(
        "timestamp", "text_hash", "human_action",
        F.coalesce("moderator_id", F.lit("anonymous")).alias("moderator_id"),
    )


def append_feedback(df: DataFrame, path: str) -> None:
    feedback_rows(df).write.mode("append").json(path)


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FEEDBACK_SCHEMA).json(path)


EXPORT_FIELDS = [
    "source", "score", "source_url", "post_title", "text", "predicted_action",
    "target_detected_pred", "predicted_category", "predicted_severity", "risk_score",
    "reason_codes", "reason",
]


def export_rows(decided: DataFrame) -> DataFrame:
    """The flat export of a feed run; reason codes joined by a bar."""
    flat = decided.withColumn("reason_codes", F.concat_ws("|", "reason_codes"))
    return flat.select(*[c for c in EXPORT_FIELDS if c in flat.columns])


def export_moderation_csv(decided: DataFrame, path: str) -> None:
    export_rows(decided).write.mode("overwrite").options(**CSV_OPTIONS).csv(path)


def to_json_rows(decided: DataFrame, fields: list[str]) -> DataFrame:
    """Each decision as a JSON document."""
    return decided.select(F.to_json(F.struct(*fields)).alias("json"))
