"""Labelled examples: derived fields, label mapping, sampling, splits and ids."""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from commentguard import fixed_values as fv
from commentguard.functions import text as tx
from commentguard.operators.ranks import ordered_ranks, salted_join, shuffled_ranks
from commentguard.plans.shared import written
from commentguard.schemas import EXAMPLE_FIELDS


def rationale(action: Column, target: Column, category: Column) -> Column:
    texts = fv.RATIONALES
    return (
        F.when((action == "allow") & target.isin(fv.CRAFT_TARGETS), F.lit(texts["allow_craft"]))
        .when(action == "allow", F.lit(texts["allow"]))
        .when(action == "flag_for_review", F.lit(texts["flag_for_review"]))
        .when(
            (action == "flag_for_removal") & category.isin("threat_or_violence", "self_harm_related"),
            F.lit(texts["removal_harm"]),
        )
        .when(action == "flag_for_removal", F.lit(texts["flag_for_removal"]))
        .otherwise(F.lit(texts["other"]))
    )


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("string")


def derive_example_fields(df: DataFrame) -> DataFrame:
    """Redact the text and derive the fields that follow from it and the labels.

    Needs text, target_detected, moderation_action, abuse_category and labels
    (an array); ``is_transformed`` (boolean) defaults to true.
    """
    if "is_transformed" not in df.columns:
        df = df.withColumn("is_transformed", F.lit(True))
    df = df.withColumn("text", tx.redact_text("text"))
    profane = F.exists(tx.lower_tokens("text"), lambda t: t.isin(fv.EXAMPLE_PROFANITY))
    return df.withColumns({
        "has_mention": _flag(F.contains("text", F.lit("@"))),
        "language_mix": tx.language_mix("text"),
        "labels_multi": tx.encode_labels("labels"),
        "contains_profanity": _flag(profane),
        "is_directed_at_person": _flag(F.col("target_detected").isin(fv.PERSON_OR_GROUP_TARGETS)),
        "transformation_type": F.when(F.col("is_transformed"), F.lit("context_rewritten")).otherwise(F.lit("")),
        "contains_pii": F.lit("false"),
        "pii_redaction_notes": F.lit(""),
        "review_status": F.lit("approved"),
        "rationale_short": rationale(
            F.col("moderation_action"), F.col("target_detected"), F.col("abuse_category")
        ),
        "recommended_action": F.col("moderation_action"),
        "policy_version": F.lit(fv.POLICY_VERSION),
    }).withColumn("is_transformed", _flag(F.col("is_transformed"))).drop("labels")


def as_example_rows(df: DataFrame) -> DataFrame:
    """All fields of the labelled-example format as text, absent ones empty."""
    return df.select(*[
        (F.coalesce(F.col(f).cast("string"), F.lit("")) if f in df.columns else F.lit("")).alias(f)
        for f in EXAMPLE_FIELDS
    ])


def map_toxicity_labels(df: DataFrame) -> DataFrame:
    """Six 0/1 toxicity columns to action, labels, category, intent and severity."""

    def is_set(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0)) != 0

    toxic = (
        is_set("toxic") | is_set("severe_toxic") | is_set("obscene") | is_set("threat")
        | is_set("insult") | is_set("identity_hate")
    )
    category = (
        F.when(is_set("threat"), F.lit("threat_or_violence"))
        .when(is_set("identity_hate"), F.lit("hate_or_identity_attack"))
        .when(is_set("insult"), F.lit("personal_attack"))
        .when(is_set("obscene"), F.lit("profanity"))
        .otherwise(F.lit("harassment"))
    )
    severe = is_set("severe_toxic") | is_set("threat")

    def either(yes: Column, no: Column) -> Column:
        return F.when(toxic, yes).otherwise(no)

    def text_array(*values: str) -> Column:
        return F.array(*[F.lit(v) for v in values])

    return df.withColumns({
        "moderation_action": either(F.lit("flag_for_review"), F.lit("allow")),
        "label_primary": either(F.lit("unsafe"), F.lit("safe")),
        "labels": either(
            text_array("unsafe", "open_source_toxicity"), text_array("safe", "open_source_non_toxic")
        ),
        "abuse_category": either(category, F.lit("non_abusive")),
        "intent_label": either(F.lit("insult"), F.lit("normal_discussion")),
        "severity": either(
            F.when(severe, F.lit("high")).otherwise(F.lit("medium")), F.lit("none")
        ),
        "target_detected": F.lit("unknown"),
        "source_type": F.lit("open_source"),
    })


def is_sample_candidate(redacted: Column) -> Column:
    """Redacted text of a fit length, without markers of removed or wiki content."""
    lowered = F.lower(redacted)
    marked = F.lit(False)
    for marker in fv.OPEN_SOURCE_MARKERS:
        marked = marked | F.contains(lowered, F.lit(marker))
    return F.length(redacted).between(25, 220) & ~marked


def balanced_sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """Up to n // 2 allowed and n // 2 flagged rows in a repeatable random order.

    Two top-n selections; neither class is sorted or gathered as a whole.
    """
    candidates = df.withColumn("text", tx.redact_text("text")).filter(is_sample_candidate(F.col("text")))
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    allowed = F.col("moderation_action") == "allow"
    halves = [candidates.filter(c).orderBy(order, key).limit(n // 2) for c in (allowed, ~allowed)]
    return halves[0].unionByName(halves[1])


def stratified_split(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Assign train, test and eval 70/20/10 inside each scenario prefix."""
    prefixed = df.withColumn("_prefix", F.substring_index("scenario_id", "_", 1))
    out = shuffled_ranks(prefixed, ["_prefix"], key, seed)
    size = F.col("_group_size").cast("double")
    train_end = F.rint(size * 0.7)
    test_end = train_end + F.rint(size * 0.2)
    split = (
        F.when(F.col("_rank") <= train_end, F.lit("train"))
        .when(F.col("_rank") <= test_end, F.lit("test"))
        .otherwise(F.lit("eval"))
    )
    return out.withColumn("split", split).drop("_prefix", "_rank", "_group_size")


def assign_ids(df: DataFrame, order: str, prefix: str = "example_") -> DataFrame:
    """Numbered ids along a numeric column, four digits or more."""
    number = F.col("_rank").cast("string")
    padded = F.when(F.length(number) < 4, F.lpad(number, 4, "0")).otherwise(number)
    return (
        ordered_ranks(df, [], order)
        .withColumn("example_id", F.concat(F.lit(prefix), padded))
        .drop("_rank", "_group_size")
    )


# Texts whose hashes are sent to all executors; more are joined by a shuffle.
MAX_BROADCAST_TEXTS = 500_000
# What a number moves on by when its text is taken.
NEXT_NUMBER = 1_000_003


def uniquify_text(df: DataFrame, order: str) -> DataFrame:
    """Make repeated texts distinct: the k-th copy gets a sentence and a number.

    Where the longer text would pass the cap, the original gives way, so that
    the number always stays.  A text that another row has already, as given or
    by such a cut, moves on to another number until none is left.  Null texts
    stay null.

    Only texts that repeat are ranked and written.  The hashes of all texts are
    counted once; each round compares those of the rows that moved with what is
    settled, and a settled row never moves again.
    """
    # The one-row generator keeps what the joins ask of the hash from being
    # pushed below the text's own derivation, which would then run again there.
    once_made = df.select(*[c for c in df.columns if c != "text"], F.inline(F.array(F.struct("text"))))
    hashed = once_made.withColumn("_h", _digest())
    hashes = written(hashed.groupBy("_h").agg(F.count("*").alias("_n")), "text-hashes")
    repeated = hashes.where("_n > 1 and _h is not null").select("_h")
    if repeated.count() <= MAX_BROADCAST_TEXTS:
        repeated = F.broadcast(repeated)
    several = written(hashed.join(repeated, "_h", "left_semi"), "copies")
    ranks = ordered_ranks(several, ["_h"], order).withColumn("_copy", (F.col("_rank") - 1).cast("long"))
    ranks = ranks.drop("_rank", "_group_size", "_h").withColumns({"_original": F.col("text"), "_moved": F.lit(0).cast("long")})
    ranks = written(ranks.withColumn("text", _numbered()).withColumn("_d", _digest()), "numbered-texts")

    settled = [hashed.join(repeated, "_h", "left_anti"), ranks.where("_copy = 0")]
    used, moving = [hashes.select(F.col("_h").alias("_d"))], ranks.where("_copy > 0")
    while True:
        wanted = moving.groupBy("_d").agg(F.count("*").alias("_n"))
        held = reduce(DataFrame.union, used).withColumn("_held", F.lit(1))
        clashes = wanted.join(held, "_d", "left").where("_n > 1 or _held = 1")
        clashes = written(clashes.select("_d", F.coalesce("_held", F.lit(0)).alias("_held")), "text-clashes")
        free = moving.join(clashes, "_d", "left_anti")
        if clashes.isEmpty():
            return reduce(DataFrame.union, [rows.select(*df.columns) for rows in [*settled, moving]])
        turns = ordered_ranks(salted_join(moving, clashes, "_d", [order]), ["_d"], order)
        turns = turns.withColumn("_turn", F.col("_rank") - 1 + F.col("_held")).drop("_rank", "_group_size", "_held")
        turns = written(turns, "text-turns")
        stay = [free.select(moving.columns), turns.where("_turn = 0").select(moving.columns)]
        settled += stay
        used += [rows.select("_d") for rows in stay]
        moved = turns.where("_turn > 0").withColumn("_moved", F.col("_moved") + F.col("_turn") * NEXT_NUMBER).drop("_turn")
        moving = written(moved.withColumn("text", _numbered()).withColumn("_d", _digest()), "moved-texts")


def _digest() -> Column:
    return F.unhex(F.sha2("text", 256))


def _numbered() -> Column:
    copy, number = F.col("_copy"), 2 * F.col("_copy") + F.col("_moved")
    suffixes = F.array(*[F.lit(s) for s in fv.UNIQUE_SUFFIXES])
    suffix = F.concat(
        F.lit(" "), F.get(suffixes, F.pmod(2 * copy - 1, F.lit(len(fv.UNIQUE_SUFFIXES))).cast("int")),
        F.lit(" Case "), number.cast("string"), F.lit("."),
    )
    kept = F.substring(F.col("_original"), F.lit(1), (F.lit(fv.TEXT_CAP) - F.length(suffix)).cast("int"))
    return F.when(copy == 0, F.col("_original")).otherwise(F.concat(kept, suffix))


def keyword_label(text: Column, keywords: list[str], flagged: str, allowed: str = "allow") -> Column:
    """The flagged action when the lower-cased text holds one of the keywords."""
    lowered = F.lower(text)
    found = F.lit(False)
    for keyword in keywords:
        found = found | F.contains(lowered, F.lit(keyword))
    return F.when(found, F.lit(flagged)).otherwise(F.lit(allowed))


def replicate(df: DataFrame, n: int) -> DataFrame:
    """Every row n times, numbered by ``copy``; no join and no shuffle."""
    return df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
