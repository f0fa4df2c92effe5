"""Signals to target, scores, action and explanation: column expressions only."""

from functools import reduce
from operator import add

from pyspark.sql import Column, functions as F

from commentguard import fixed_values as fv


def _is(c: Column, values) -> Column:
    return F.coalesce(c.isin(list(values)), F.lit(False))


def is_reply(context_type: Column) -> Column:
    return _is(context_type, fv.REPLY_CONTEXTS)


def detect_target(s: dict[str, Column], context_type: Column) -> Column:
    """What the negativity is aimed at; the first rule that holds decides.

    ``s`` maps signal names to boolean columns.
    """
    reply = is_reply(context_type)
    person = F.lit("reviewer_or_user")
    return (
        F.when(s["protected_abuse"], F.lit("protected_class"))
        .when(s["community"] & s["hate_word"], F.lit("protected_class"))
        .when(s["community"], F.lit("review_content"))
        .when(s["group_target"], F.lit("community_identity"))
        .when(s["directed_attack"], person)
        .when(reply & s["severe"], person)
        .when(s["user"] & (s["soft"] | s["severe"] | s["threat"]), person)
        .when(s["user"] & reply & ~s["movie"], person)
        .when(reply & s["soft"], person)
        .when(s["movie"], F.lit("movie_show"))
        .when(s["fan_word"], F.lit("community_identity"))
        .otherwise(F.lit("unknown"))
    )


def detect_target_v1(s: dict[str, Column], context_type: Column) -> Column:
    reply = is_reply(context_type)
    person = F.lit("reviewer_or_user")
    return (
        F.when(s["protected_abuse"], F.lit("protected_class"))
        .when(s["community"] & s["hate_word"], F.lit("protected_class"))
        .when(s["community"], F.lit("review_content"))
        .when(s["group_target"], F.lit("community_identity"))
        .when(s["directed_attack"], person)
        .when(s["user"] & (s["soft"] | s["severe"] | s["threat"]), person)
        .when(s["user"] & reply & ~s["movie"], person)
        .when(s["movie"], F.lit("movie_show"))
        .when(s["fan_word"], F.lit("community_identity"))
        .otherwise(F.lit("unknown"))
    )


def toxicity_points(s: dict[str, Column]) -> Column:
    """Sum of the points of the signals present, at most 1; not yet rounded."""
    points = [
        F.when(s[name], F.lit(value)).otherwise(F.lit(0.0))
        for name, value in fv.TOXICITY_POINTS.items()
    ]
    return F.least(reduce(add, points), F.lit(1.0))


def sentiment_label(balance: Column) -> Column:
    return (
        F.when(balance > 0, F.lit("negative"))
        .when(balance < 0, F.lit("positive"))
        .otherwise(F.lit("neutral"))
    )


def sentiment_score(balance: Column) -> Column:
    return F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-balance.cast("double"))), 3)


def model_label(raw: Column) -> Column:
    """A classifier's own label names to positive, negative, neutral."""
    raw = F.lower(raw)
    return (
        F.when(raw.isin("positive", "pos", "label_2", "2"), F.lit("positive"))
        .when(raw.isin("negative", "neg", "label_0", "0"), F.lit("negative"))
        .otherwise(F.lit("neutral"))
    )


def toxicity_from_label(label: Column, score: Column) -> Column:
    """The score of a toxic label, or its complement; "non-toxic" counts as toxic."""
    return F.when(F.contains(F.lower(label), F.lit("toxic")), score).otherwise(
        F.lit(1.0) - score
    )


def given_model_score(score: Column) -> Column:
    """NaN means absent."""
    return F.when(~F.isnan(score), score)


def rating_disagreement(rating: Column, perfection: Column, skip: Column) -> Column:
    rating = F.lower(rating)

    def at_least(pct: Column, bound: float) -> Column:
        return ~F.isnan(pct) & (pct >= bound)

    return (
        F.when((rating == "skip") & at_least(perfection, 80.0), F.lit(0.25))
        .when((rating == "perfection") & at_least(skip, 35.0), F.lit(0.15))
        .otherwise(F.lit(0.0))
    )


def risk_points(
    context_type: Column, mention: Column, negative: Column, disagreement: Column,
    htox: Column, model: Column, w: dict[str, Column],
) -> Column:
    """Weighted risk, at most 1; not yet rounded.  The order of the sum matters
    for the last bit."""
    none = F.lit(0.0)
    total = F.when(is_reply(context_type), w["reply_context_base"]).otherwise(
        w["main_review_base"]
    )
    total = total + F.when(mention, w["has_mention"]).otherwise(none)
    total = total + F.when(negative, w["negative_sentiment"]).otherwise(none)
    total = total + disagreement
    total = total + F.greatest(htox, model) * w["toxicity_scale"]
    return F.least(total, F.lit(1.0))


def _verdict(action: str, category: str, intent: str, severity: str) -> Column:
    return F.struct(
        F.lit(action).alias("action"), F.lit(category).alias("category"),
        F.lit(intent).alias("intent"), F.lit(severity).alias("severity"),
    )


def decide_action(
    s: dict[str, Column], target: Column, model: Column, risk: Column,
    negative: Column, w: dict[str, Column], profile: str = "current",
) -> Column:
    """Struct of action, category, intent and severity; first rung that holds."""
    person_or_group = _is(target, fv.PERSON_OR_GROUP_TARGETS)
    not_content = _is(target, [*fv.PERSON_OR_GROUP_TARGETS, "unknown"])
    protected = s["protected_abuse"]
    if profile == "v1":
        protected = protected & (target == "protected_class")
    removal, review = "flag_for_removal", "flag_for_review"

    ladder = F.when(s["threat"], _verdict(removal, "threat_or_violence", "threat", "critical"))
    ladder = ladder.when(
        protected | (s["severe"] & (target == "protected_class")),
        _verdict(removal, "hate_or_identity_attack", "insult", "high"),
    )
    ladder = ladder.when(
        s["severe"] & not_content, _verdict(removal, "personal_attack", "insult", "high")
    )
    if profile != "v1":
        ladder = ladder.when(
            s["directed_attack"] & s["severe"],
            _verdict(removal, "personal_attack", "insult", "high"),
        )
    ladder = ladder.when(
        (s["directed_attack"] & not_content) | (s["soft"] & person_or_group),
        _verdict(review, "harassment", "trolling", "medium"),
    )
    ladder = ladder.when(
        (model >= w["flag_for_review_model"]) & ~_is(target, fv.CONTENT_TARGETS),
        _verdict(review, "harassment", "insult", "medium"),
    )
    ladder = ladder.when(
        (risk >= w["flag_for_review_risk"]) & not_content,
        _verdict(review, "harassment", "trolling", "low"),
    )
    ladder = ladder.when(negative, _verdict("allow", "non_abusive", "criticism", "none"))
    return ladder.otherwise(_verdict("allow", "non_abusive", "normal_discussion", "none"))


def reason_codes(
    s: dict[str, Column], mention: Column, disagreement: Column, negative: Column, target: Column
) -> Column:
    codes = [
        (mention, "MENTION_OR_DIRECT_REPLY"),
        (disagreement > 0, "RATING_DISAGREEMENT_RISK"),
        (negative, "NEGATIVE_SENTIMENT"),
        (_is(target, fv.CONTENT_TARGETS), "TARGETS_MOVIE_OR_REVIEW_CONTENT"),
        (_is(target, fv.PERSON_OR_GROUP_TARGETS), "TARGETS_PERSON_OR_GROUP"),
        (s["profanity"], "PROFANITY_SIGNAL"),
        (s["soft"], "SOFT_ABUSE_SIGNAL"),
        (s["directed_attack"], "DIRECTED_ATTACK_PATTERN"),
        (s["severe"], "SEVERE_ABUSE_SIGNAL"),
        (s["threat"], "THREAT_SIGNAL"),
        (s["protected_abuse"], "PROTECTED_CLASS_ABUSE_PATTERN"),
    ]
    return F.array_compact(F.array(*[F.when(test, F.lit(code)) for test, code in codes]))


def explain(action: Column, target: Column) -> Column:
    texts = fv.EXPLANATIONS
    return (
        F.when(
            (action == "allow") & _is(target, fv.CONTENT_TARGETS), F.lit(texts["allow_content"])
        )
        .when(action == "allow", F.lit(texts["allow"]))
        .when(action == "flag_for_review", F.lit(texts["flag_for_review"]))
        .otherwise(F.lit(texts["flag_for_removal"]))
    )


def is_clean(
    s: dict[str, Column], action: Column, risk: Column, model: Column
) -> Column:
    """Nothing suspicious at all, so the search for a policy rule is skipped."""
    suspicious = reduce(
        lambda a, b: a | b,
        [s[n] for n in ("threat", "severe", "soft", "protected_abuse", "directed_attack")],
    )
    return (risk < 0.1) & (model < 0.1) & (action == "allow") & ~suspicious


def risk_band(risk: Column) -> Column:
    return (
        F.when(risk > 0.65, F.lit("high")).when(risk > 0.35, F.lit("medium")).otherwise(F.lit("low"))
    )
