import math

import pytest
from pyspark.sql import functions as F

from commentguard import fixed_values as fv
from commentguard.functions.numeric import round_nearest
from commentguard.operators import lexicon as lx
from commentguard.operators.moderation import (
    moderate, moderate_distinct, risk_band_counts, validate_requests,
)
from commentguard.operators.normalize import with_normalized
from commentguard.schemas import DECISION_FIELDS
from tests.golden import EXPECTED, sample_frame


@pytest.fixture(scope="module")
def decided(spark):
    return moderate(sample_frame(spark)).orderBy("comment_id").collect()


def test_golden_decisions(decided):
    got = [
        (r.predicted_action, r.predicted_category, r.target_detected_pred, r.sentiment_label,
         r.heuristic_toxicity_score, r.risk_score)
        for r in decided[: len(EXPECTED)]
    ]
    assert got == EXPECTED


def test_reason_codes(decided):
    assert "PROFANITY_SIGNAL" in decided[4].reason_codes
    for i in (1, 9, 10, 11, 12, 13):
        assert "SEVERE_ABUSE_SIGNAL" in decided[i].reason_codes
    assert decided[14].reason_codes[0] == "MENTION_OR_DIRECT_REPLY"
    assert decided[0].reason_codes == [
        "RATING_DISAGREEMENT_RISK", "NEGATIVE_SENTIMENT", "TARGETS_MOVIE_OR_REVIEW_CONTENT",
        "PROFANITY_SIGNAL",
    ]


def test_disguised_abuse_is_found(decided):
    assert decided[33].predicted_action == "flag_for_removal"  # zero-width characters
    assert "SEVERE_ABUSE_SIGNAL" in decided[34].reason_codes  # Cyrillic letters
    assert "PROFANITY_SIGNAL" in decided[36].reason_codes  # separators
    assert "MENTION_OR_DIRECT_REPLY" not in decided[35].reason_codes  # e-mail address


def test_bare_text_takes_defaults(spark):
    row = moderate(spark.createDataFrame([("You are shit",)], "text string")).first()
    assert (row.predicted_action, row.risk_score) == ("flag_for_review", 0.817)
    assert row.asDict().keys() >= set(DECISION_FIELDS)


def test_failure_rows(spark):
    rows = [
        (0, None, "50", None), (1, "fine film", "many", None), (2, "fine film", None, None),
        (3, "fine film", "50", "high"), (4, "fine film", "50", "0.3"), (5, "fine film", "50", "NaN"),
    ]
    df = spark.createDataFrame(
        rows, "comment_id long, text string, movie_rating_perfection_pct string, model_toxicity_score string"
    )
    got = {r.comment_id: r for r in moderate(df).collect()}
    stages = {0: "language", 1: "context", 2: "context", 3: "ml_toxicity"}
    for i, stage in stages.items():
        assert got[i].reason == f"Pipeline failed at {stage} — defaulting to review"
        assert (got[i].predicted_action, got[i].predicted_category) == ("flag_for_review", "pipeline_error")
        assert got[i].reason_codes == ["PIPELINE_ERROR"] and got[i].risk_score == 0.0
    assert got[4].model_toxicity_score == 0.3
    assert got[5].model_toxicity_score == 0.0


def custom_lexicon(spark):
    """Lists of one's own, the loose and tone lists among them, and several that are missing."""
    lists = {"severe": ["zzbad", "you suck"], "hate_word": ["kplu", "all of them out"], "fan_word": ["starfan"], "positive": ["lov"], "user": ["fool"]}
    return lx.build_lexicon(spark, lists)


@pytest.mark.parametrize("profile", ["current", "v1"])
@pytest.mark.parametrize("custom", [False, True])
def test_both_forms_decide_alike(spark, monkeypatch, profile, custom):
    extra = [(900, "All of them out, kplu!"), (901, "starfan fool zzbad"), (902, "lovely movie, you sucker"), (902, None), (None, "call of them out")]
    extra = spark.createDataFrame(extra, "comment_id long, text string")
    df = sample_frame(spark).unionByName(extra, allowMissingColumns=True)
    df = df.withColumn("context_type", F.coalesce("context_type", F.lit("main_review")))
    if custom:
        lexicon = custom_lexicon(spark)
    else:
        lexicon = lx.build_lexicon(spark, fv.LEXICON_V1 if profile == "v1" else None)
    expected = sorted(moderate(df, lexicon=lexicon, profile=profile).collect(), key=str)
    monkeypatch.setattr(lx, "MAX_LITERAL_PHRASES", 0)
    for phrases in (200_000, 3 if custom else 150):
        monkeypatch.setattr(lx, "PART_PHRASES", phrases)
        assert sorted(moderate(df, lexicon=lexicon, profile=profile).collect(), key=str) == expected


def test_only_asked_fields_are_built(spark):
    df = sample_frame(spark)
    one = moderate(df, fields=["predicted_action"])
    assert "reason_codes" not in one.columns and "PROTECTED_CLASS_ABUSE_PATTERN" not in one._jdf.queryExecution().optimizedPlan().toString()
    whole = {(r.comment_id, r.predicted_action) for r in moderate(df).collect()}
    assert {(r.comment_id, r.predicted_action) for r in one.collect()} == whole


def test_matched_phrases(spark):
    df = with_normalized(spark.createDataFrame([("your kindness, bc", 1), ("fine", 2)], "text string, comment_id long"))
    got = {r.comment_id: {(m["list"], m["phrase"]) for m in r.matched} for r in lx.matched_phrases(df).collect()}
    assert got == {1: {("protected_abuse", "your kind"), ("soft", "bc"), ("profanity", "bc")}, 2: set()}
    joined = lx.match_lexicon(df, lx.build_lexicon(spark).filter(F.col("list").isin(lx.MATCHER_LISTS)))
    assert {tuple(r) for r in joined.collect()} == {(1, *m) for m in got[1]}


def test_distinct_once_gives_the_same(spark):
    df = sample_frame(spark).crossJoin(spark.range(5).withColumnRenamed("id", "copy"))
    df = df.withColumn("model_toxicity_score", F.when(F.col("copy") == 3, F.lit(0.9)))
    assert sorted(map(str, moderate_distinct(df).select(*sorted(moderate(df).columns)).collect())) == sorted(
        map(str, moderate(df).select(*sorted(moderate(df).columns)).collect())
    )


def test_validation(spark):
    rows = [(1, "ok", 50.0, 0.5), (2, "", 50.0, None), (3, "x" * 2001, 50.0, None), (4, "ok", 101.0, 1.5),
            (5, None, float("nan"), None)]
    df = spark.createDataFrame(rows, "comment_id long, text string, movie_rating_perfection_pct double, model_toxicity_score double").withColumn("movie_rating_skip_pct", F.lit(5.0))
    ok, bad = validate_requests(df)
    assert [r.comment_id for r in ok.collect()] == [1]
    assert {r.comment_id: r.reject_reasons for r in bad.collect()} == {
        2: ["text_empty"], 3: ["text_too_long"],
        4: ["perfection_pct_out_of_range", "model_score_out_of_range"],
        5: ["text_empty", "perfection_pct_out_of_range"],
    }


def test_rounding_follows_the_stored_number(spark):
    values = [i / 2000 for i in range(0, 2001)] + [0.4 + 0.35 * 0.65, 0.0625, 0.1875, 1 / 3]
    df = spark.createDataFrame([(v,) for v in values], "x double").select("x", round_nearest(F.col("x"), 3).alias("r"))
    assert all(r.r == round(r.x, 3) for r in df.collect())


def test_sentiment(spark):
    df = spark.createDataFrame([("worst movie ever trash bakwas",), ("great amazing loved it best movie",), ("the movie exists",)], "text string")
    rows = moderate(df).collect()
    assert [r.sentiment_label for r in rows] == ["negative", "positive", "neutral"]
    assert rows[0].sentiment_score == round(1 / (1 + math.exp(-3)), 3)


def test_v1_profile(spark):
    df = spark.createDataFrame(
        [("This movie is shit but the issue is pacing, not the actors personally.", "main_review"),
         ("@reviewer tu chutiya hai, review dena band kar.", "reply_to_review"),
         ("message about perfection", "main_review")], "text string, context_type string")
    rows = moderate(df, profile="v1").collect()
    assert [r.predicted_action for r in rows] == ["allow", "flag_for_removal", "allow"]
    assert rows[1].risk_score == 1.0 and rows[1].heuristic_toxicity_score == 0.95


def test_risk_bands(spark):
    bands = {r.risk_band: r.n_comments for r in risk_band_counts(moderate(sample_frame(spark))).collect()}
    assert sum(bands.values()) == 40


def test_empty_batch(spark):
    assert moderate(sample_frame(spark).limit(0)).count() == 0


def test_lists_have_the_expected_sizes():
    sizes = {n: len(v) for n, v in fv.LEXICON.items()}
    assert sizes == {
        "movie": 35, "user": 24, "group_target": 8, "directed_attack": 39, "protected_abuse": 81,
        "soft": 43, "severe": 45, "threat": 16, "profanity": 13, "positive": 10, "negative": 13,
        "community": 17, "hate_word": 6, "fan_word": 5,
    }
