"""Column contracts of the tables the library reads and writes."""

from pyspark.sql import types as T

COMMENT_SCHEMA = T.StructType([
    T.StructField("comment_id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("context_type", T.StringType()),
    T.StructField("parent_review_rating", T.StringType()),
    T.StructField("movie_rating_perfection_pct", T.DoubleType()),
    T.StructField("movie_rating_skip_pct", T.DoubleType()),
    T.StructField("model_toxicity_score", T.DoubleType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("client_id", T.LongType()),
])

REQUEST_FIELDS = [
    "text", "context_type", "parent_review_rating", "movie_rating_perfection_pct",
    "movie_rating_skip_pct", "model_toxicity_score",
]

DECISION_FIELDS = [
    "predicted_action", "predicted_category", "predicted_intent", "predicted_severity",
    "target_detected_pred", "sentiment_label", "sentiment_score", "risk_score",
    "heuristic_toxicity_score", "model_toxicity_score", "reason_codes",
    "triggered_rules", "reason",
]

EXAMPLE_FIELDS = [
    "example_id", "scenario_id", "text", "context_type", "parent_review_rating",
    "movie_rating_perfection_pct", "movie_rating_skip_pct", "has_mention",
    "language_mix", "target_detected", "moderation_action", "label_primary",
    "labels_multi", "abuse_category", "intent_label", "severity", "contains_profanity",
    "is_directed_at_person", "source_type", "source_dataset", "source_url",
    "source_license", "provenance_notes", "is_transformed", "transformation_type",
    "contains_pii", "pii_redaction_notes", "split", "created_by", "created_at",
    "review_status", "rationale_short", "recommended_action", "policy_version",
]
EXAMPLE_SCHEMA = T.StructType([T.StructField(f, T.StringType()) for f in EXAMPLE_FIELDS])

LEXICON_SCHEMA = T.StructType([
    T.StructField("list", T.StringType()),
    T.StructField("phrase", T.StringType()),
])

RULE_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("action", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("examples", T.ArrayType(T.StringType())),
])

AUDIT_SCHEMA = T.StructType([
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("request_id", T.StringType()),
    T.StructField("text_hash", T.StringType()),
    T.StructField("context_type", T.StringType()),
    T.StructField("action", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("reason_codes", T.ArrayType(T.StringType())),
    T.StructField("triggered_rules", T.ArrayType(T.StringType())),
    T.StructField("latency_ms", T.DoubleType()),
])

FEEDBACK_SCHEMA = T.StructType([
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("text_hash", T.StringType()),
    T.StructField("human_action", T.StringType()),
    T.StructField("moderator_id", T.StringType()),
])
