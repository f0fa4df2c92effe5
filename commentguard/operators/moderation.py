"""Comments to decisions: validation, the moderation plan, distinct-once scoring."""

from pyspark.sql import Column, DataFrame, functions as F

from commentguard import fixed_values as fv
from commentguard.functions import decision as dc
from commentguard.functions import text as tx
from commentguard.functions.numeric import round_nearest
from commentguard.operators import lexicon as lx
from commentguard.operators.normalize import with_normalized
from commentguard.operators.ranks import SALTS, salted_join
from commentguard.operators.retrieval import apply_rule_override, with_nearest_rules
from commentguard.plans.shared import written
from commentguard.schemas import DECISION_FIELDS, REQUEST_FIELDS

# Distinct requests whose decisions are sent to all executors; more are joined by a shuffle.
MAX_BROADCAST_REQUESTS = 200_000

_FAILURE = {
    "predicted_action": "flag_for_review",
    "predicted_category": "pipeline_error",
    "predicted_intent": "error",
    "predicted_severity": "none",
    "target_detected_pred": "unknown",
    "sentiment_label": "neutral",
    "sentiment_score": 0.0,
    "risk_score": 0.0,
    "heuristic_toxicity_score": 0.0,
    "model_toxicity_score": 0.0,
}


def with_default_fields(df: DataFrame, defaults: dict | None = None) -> DataFrame:
    """Add the request fields a frame does not have, with their defaults."""
    defaults = fv.REQUEST_DEFAULTS if defaults is None else defaults
    missing = {n: F.lit(v) for n, v in defaults.items() if n not in df.columns}
    if "model_toxicity_score" in missing:
        missing["model_toxicity_score"] = F.lit(None).cast("double")
    return df.withColumns(missing) if missing else df


def with_default_context(df: DataFrame) -> DataFrame:
    """Give a feed without thread context the neutral one."""
    return df.withColumns({n: F.lit(v) for n, v in fv.FEED_CONTEXT.items()})


# --- Validation --------------------------------------------------------------


def reject_reasons(batch_size: Column | None = None) -> Column:
    """Array of the reasons a request is turned away; empty when it is fine."""

    def outside(field: str, low: float, high: float) -> Column:
        value = F.col(field).try_cast("double")
        # NaN compares above every number, so it fails the upper bound.
        return ~F.coalesce(value.between(low, high), F.lit(False))

    score = F.col("model_toxicity_score")
    tests = [
        (F.coalesce(F.length("text"), F.lit(0)) < 1, "text_empty"),
        (F.length("text") > fv.MAX_TEXT_CHARS, "text_too_long"),
        (outside("movie_rating_perfection_pct", 0, 100), "perfection_pct_out_of_range"),
        (outside("movie_rating_skip_pct", 0, 100), "skip_pct_out_of_range"),
        (score.isNotNull() & outside("model_toxicity_score", 0, 1), "model_score_out_of_range"),
    ]
    if batch_size is not None:
        tests.append((~batch_size.between(1, fv.MAX_BATCH_ROWS), "batch_size_out_of_range"))
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for test, name in tests]))


def validate_requests(
    df: DataFrame, batch_sizes: DataFrame | None = None, batch_key: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Split requests into (accepted, rejected with ``reject_reasons``).

    With ``batch_sizes`` (batch key, n_rows), a batch outside 1..256 rows is
    rejected as a whole.
    """
    size = None
    if batch_sizes is not None:
        df = df.join(batch_sizes, batch_key, "left")
        size = F.col("n_rows")
    marked = df.withColumn("reject_reasons", reject_reasons(size))
    accepted = marked.filter(F.size("reject_reasons") == 0).drop("reject_reasons")
    return accepted, marked.filter(F.size("reject_reasons") > 0)


# --- The plan ----------------------------------------------------------------


def resolve_weights(weights: dict | DataFrame | None, profile: str) -> dict[str, float]:
    if weights is None:
        return fv.WEIGHT_PROFILES[profile]
    if isinstance(weights, DataFrame):
        weights = weights.first().asDict()  # a one-row table
    return {
        name: fallback if weights.get(name) is None else weights[name]
        for name, fallback in fv.WEIGHT_FALLBACKS.items()
    }


def with_heuristics(
    df: DataFrame, lexicon: DataFrame | dict | None = None, profile: str = "current",
) -> DataFrame:
    """Normalise, match the lexicon, and add ``sig_*``, ``_target``, ``_htox``,
    ``_balance`` and the normalised text.  Needs ``text`` and ``context_type``."""
    if lexicon is None and profile == "v1":
        lexicon = fv.LEXICON_V1
    lists = lx.literal_lists(lexicon)
    df = df.withColumn("normalized_text", tx.normalize_text_v1("text")) if profile == "v1" else with_normalized(df)
    if lists is None:
        df = lx.scanned_signals(df, lexicon, v1=profile == "v1")
        balance = F.size(lx.of_list(F.col("_matches"), "negative")) - F.size(lx.of_list(F.col("_matches"), "positive"))
    else:
        if profile == "v1":
            df = df.withColumns({f"sig_{n}": c for n, c in lx.v1_signal_columns("normalized_text", lists).items()})
        else:
            df = lx.with_signals(df, lists)
        balance = sentiment_balance("normalized_text", lists)
    sig = signal_map()
    target = dc.detect_target_v1 if profile == "v1" else dc.detect_target
    return df.withColumns({
        "_target": target(sig, F.col("context_type")),
        "_htox_raw": dc.toxicity_points(sig),
        "_balance": balance,
    }).withColumn("_htox", round_nearest(F.col("_htox_raw"), 3))


def sentiment_balance(normalized: str, lists: dict[str, list[str]] = fv.LEXICON) -> Column:
    """Negative minus positive terms in the text."""
    return lx.occurring(normalized, lists.get("negative", [])) - lx.occurring(normalized, lists.get("positive", []))


def signal_map() -> dict[str, Column]:
    return {n: F.col(f"sig_{n}") for n in ["has_mention", *lx.SIGNAL_LISTS]}


def moderate(
    df: DataFrame,
    lexicon: DataFrame | dict | None = None,
    weights: dict | DataFrame | None = None,
    rules: DataFrame | None = None,
    profile: str = "current",
    sentiment: tuple[str, str] | None = None,
    max_distance: float = 1.1,
    embedding: str = "embedding",
    keep_signals: bool = False,
    fields: list[str] | None = None,
) -> DataFrame:
    """Add the thirteen decision columns, or the given ``fields`` of them, to a frame of comments.

    Missing request fields take their defaults; ``model_toxicity_score`` is
    replaced by the effective score.  ``sentiment`` names a (label, score) pair
    of columns from a model to use instead of the word balance.  With ``rules``
    (id, action, category, severity, embedding) and an embedding column, the
    nearest rule refines the decision of every comment that is not clean.

    The plan is a chain of projections over the input: no shuffle, so it runs
    at scan speed and serves a stream as it is.  Rows keep their columns;
    order them by an own key where order matters.  Filter before moderating:
    Unicode composition counts as non-deterministic to the optimiser, which
    therefore does not push filters below it.
    """
    w = {n: F.lit(float(v)) for n, v in resolve_weights(weights, profile).items()}
    inputs = [c for c in df.columns if c != "model_toxicity_score"]
    strict = profile != "v1"
    df = with_default_fields(df)
    df = df.withColumns({
        "_perf": F.col("movie_rating_perfection_pct").try_cast("double"),
        "_skip": F.col("movie_rating_skip_pct").try_cast("double"),
        "_given": F.col("model_toxicity_score").try_cast("double"),
    })
    failed = F.lit(None).cast("string")
    if strict:
        failed = (
            F.when(F.col("text").isNull(), F.lit("language"))
            .when(
                F.col("model_toxicity_score").isNotNull() & F.col("_given").isNull(),
                F.lit("ml_toxicity"),
            )
            .when(F.col("_perf").isNull() | F.col("_skip").isNull(), F.lit("context"))
        )
    df = df.withColumn("_failed", failed)
    df = with_heuristics(df, lexicon, profile)

    sig = signal_map()
    label, score = (
        (dc.sentiment_label(F.col("_balance")), dc.sentiment_score(F.col("_balance")))
        if sentiment is None
        else (F.col(sentiment[0]), F.col(sentiment[1]))
    )
    df = df.withColumns({
        "_label": label,
        "_score": score,
        "_model": F.coalesce(dc.given_model_score(F.col("_given")), F.col("_htox")),
        "_disagreement": dc.rating_disagreement(
            F.col("parent_review_rating"), F.col("_perf"), F.col("_skip")
        ),
    })
    negative = F.col("_label") == "negative"
    df = df.withColumn(
        "_risk_raw",
        dc.risk_points(
            F.col("context_type"), sig["has_mention"], negative, F.col("_disagreement"),
            F.col("_htox"), F.col("_model"), w,
        ),
    )
    df = df.withColumn("_risk", round_nearest(F.col("_risk_raw"), 3))
    df = df.withColumn(
        "_decision",
        dc.decide_action(sig, F.col("_target"), F.col("_model"), F.col("_risk"), negative, w, profile),
    )
    triggered = F.array().cast("array<string>")
    if rules is not None:
        clean = dc.is_clean(sig, F.col("_decision.action"), F.col("_risk"), F.col("_model"))
        df = with_nearest_rules(
            df, rules, 1, max_distance, embedding, "_rules", F.col("_failed").isNull() & ~clean
        )
        top = F.get(F.col("_rules"), F.lit(0))
        df = df.withColumn("_decision", apply_rule_override(F.col("_decision"), top, F.col("_model")))
        triggered = F.transform("_rules", lambda r: r["id"])

    action = F.col("_decision.action")
    results = {
        "predicted_action": action,
        "predicted_category": F.col("_decision.category"),
        "predicted_intent": F.col("_decision.intent"),
        "predicted_severity": F.col("_decision.severity"),
        "target_detected_pred": F.col("_target"),
        "sentiment_label": F.col("_label"),
        "sentiment_score": F.col("_score"),
        "risk_score": F.col("_risk"),
        "heuristic_toxicity_score": F.col("_htox"),
        "model_toxicity_score": round_nearest(F.col("_model"), 3),
        "reason_codes": dc.reason_codes(
            sig, sig["has_mention"], F.col("_disagreement"), negative, F.col("_target")
        ),
        "triggered_rules": triggered,
        "reason": dc.explain(action, F.col("_target")),
    }
    if strict:
        results = with_failure_values(results, F.col("_failed"))
    kept = [F.col(c) for c in inputs if c not in results]
    if keep_signals:
        kept += [F.col("normalized_text"), *[F.col(f"sig_{n}") for n in sig]]
    # The results leave through a generator of one row.  It is a boundary for the
    # optimiser: a filter or join on a result would otherwise make it unfold the
    # expressions of all projections below into one, which takes longer than
    # the data takes, and evaluate them twice.
    df = df.withColumn("_results", F.struct(*[results[n].alias(n) for n in fields or DECISION_FIELDS]))
    return df.select(*kept, F.inline(F.array("_results")))


def with_failure_values(results: dict[str, Column], failed: Column) -> dict[str, Column]:
    """Send rows with a failed stage to review instead of losing or allowing them."""
    constants = {n: F.lit(v) for n, v in _FAILURE.items()}
    constants["reason_codes"] = F.array(F.lit("PIPELINE_ERROR"))
    constants["triggered_rules"] = F.array().cast("array<string>")
    constants["reason"] = F.concat(
        F.lit("Pipeline failed at "), failed, F.lit(" — defaulting to review")
    )
    return {n: F.when(failed.isNotNull(), constants[n]).otherwise(c) for n, c in results.items()}


def moderate_distinct(df: DataFrame, salts: int = SALTS, **options) -> DataFrame:
    """Moderate every distinct request once and join the decisions back.

    Worth it when requests repeat often and moderation costs more than a hash
    of the request, as with a model.  The key is a hash of all six request
    fields; equal requests combine before the shuffle.  Decisions are counted:
    few ones are sent to where the requests are, which then stay in place; many
    meet them in a salted join, so a request that makes up much of the input
    does not land in one task.
    """
    df = with_default_fields(df)
    request = F.sha2(F.to_json(F.struct(*REQUEST_FIELDS), {"ignoreNullFields": "false"}), 256)
    keyed = df.withColumn("_request", request)
    requests = keyed.groupBy("_request").agg(*[F.first(c).alias(c) for c in REQUEST_FIELDS])
    decided = written(moderate(requests, **options).select("_request", *DECISION_FIELDS), "decided")
    own = keyed.drop("model_toxicity_score")
    if decided.count() <= MAX_BROADCAST_REQUESTS:
        return own.join(F.broadcast(decided), "_request").drop("_request")
    spread_by = [c for c in df.columns if c not in REQUEST_FIELDS] or ["_request"]
    return salted_join(own, decided, "_request", spread_by, salts=salts).drop("_request")


def risk_band_counts(decided: DataFrame) -> DataFrame:
    return decided.groupBy(dc.risk_band(F.col("risk_score")).alias("risk_band")).agg(
        F.count("*").alias("n_comments")
    )
