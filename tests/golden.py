"""Expected decisions for the first 32 sample comments, in order:
action, category, target, sentiment, heuristic toxicity, risk."""

from commentguard.plans.sample_texts import SAMPLE_COMMENTS

ALLOW, REVIEW, REMOVAL = "allow", "flag_for_review", "flag_for_removal"
PERSON, PROTECTED, MOVIE = "reviewer_or_user", "protected_class", "movie_show"
ATTACK, HATE, HARASS, OK = "personal_attack", "hate_or_identity_attack", "harassment", "non_abusive"

EXPECTED = [
    (ALLOW, OK, MOVIE, "negative", 0.18, 0.467),
    (REMOVAL, ATTACK, PERSON, "neutral", 0.95, 1.0),
    (ALLOW, OK, MOVIE, "negative", 0.0, 0.7),
    (REMOVAL, "threat_or_violence", PERSON, "neutral", 0.75, 1.0),
    (ALLOW, OK, MOVIE, "negative", 0.18, 0.217),
    (REVIEW, HARASS, PERSON, "neutral", 0.53, 0.745),
    (REMOVAL, ATTACK, PERSON, "neutral", 0.65, 0.823),
    (REMOVAL, ATTACK, PERSON, "neutral", 1.0, 1.0),
    (REVIEW, HARASS, PERSON, "neutral", 0.53, 0.745),
    (REMOVAL, ATTACK, PERSON, "neutral", 0.65, 0.823),
    (REMOVAL, ATTACK, PERSON, "neutral", 0.65, 0.823),
    (REMOVAL, ATTACK, PERSON, "neutral", 0.65, 0.823),
    (REMOVAL, ATTACK, PERSON, "neutral", 0.65, 0.823),
    (REMOVAL, ATTACK, PERSON, "neutral", 0.65, 0.823),
    (REVIEW, HARASS, PERSON, "neutral", 0.35, 0.927),
    (REMOVAL, HATE, PROTECTED, "neutral", 0.6, 1.0),
    (REMOVAL, HATE, PROTECTED, "neutral", 0.6, 1.0),
    (REMOVAL, HATE, PROTECTED, "neutral", 0.6, 1.0),
    (REMOVAL, HATE, PROTECTED, "neutral", 0.6, 1.0),
    (REMOVAL, HATE, PROTECTED, "neutral", 0.6, 1.0),
    (ALLOW, OK, MOVIE, "neutral", 0.0, 0.3),
    (REMOVAL, HATE, PROTECTED, "neutral", 0.6, 1.0),
    (REVIEW, HARASS, PERSON, "negative", 0.18, 0.817),
    (REVIEW, HARASS, PERSON, "neutral", 0.35, 0.627),
    (REMOVAL, HATE, PROTECTED, "neutral", 0.6, 0.44),
    (REMOVAL, "threat_or_violence", MOVIE, "positive", 0.75, 0.538),
    (REVIEW, HARASS, "unknown", "neutral", 0.0, 0.65),
    (ALLOW, OK, MOVIE, "neutral", 0.65, 0.473),
    (REVIEW, HARASS, "community_identity", "positive", 0.35, 0.627),
    (REVIEW, HARASS, PERSON, "neutral", 0.3, 0.595),
    (REMOVAL, ATTACK, "unknown", "neutral", 0.65, 0.723),
    (ALLOW, OK, MOVIE, "neutral", 0.0, 0.3),
]

COMMENT_DDL = (
    "comment_id long, text string, context_type string, parent_review_rating string, "
    "movie_rating_perfection_pct double, movie_rating_skip_pct double"
)


def sample_frame(spark):
    return spark.createDataFrame(
        [(i, *row) for i, row in enumerate(SAMPLE_COMMENTS)], COMMENT_DDL
    )
