"""The registered queries: one or more per operator, each over whole tables."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from commentguard import fixed_values as fv
from commentguard.functions import decision as dc
from commentguard.functions import text as tx
from commentguard.functions.numeric import round_nearest
from commentguard.operators import (
    dataset as ds, evaluation as ev, feedback as fb, feeds, lexicon as lx, lexicon_join as lj, metrics as mt,
    moderation as mod, nearest as nn, quality as ql, ranking as rk, retrieval as rt, scoring as sc, threads as th,
    training as tr,
)
from commentguard.operators.normalize import with_normalized
from commentguard.plans import inputs as inp
from commentguard.plans.shared import shared_path, written
from commentguard.sources import tables as tb
from commentguard.streaming import live, stateful

QUERIES: dict = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def _joined(c: str) -> Column:
    return F.array_join(c, "|").alias(c)


def _flat_decisions(decided: DataFrame, *keys: str) -> DataFrame:
    arrays = ("reason_codes", "triggered_rules")
    return decided.select(*keys, *[_joined(c) if c in arrays else c for c in mod.DECISION_FIELDS])


def _decided_events(spark: SparkSession, sf: str) -> DataFrame:
    """Event comments repeat a text often, so each distinct request is scored once."""
    return mod.moderate(inp.event_comments(spark, sf))


def _decided_documents(spark: SparkSession, sf: str) -> DataFrame:
    return mod.moderate(inp.document_comments(spark, sf))


# --- Flagship ----------------------------------------------------------------


@query
def decisions_by_language(spark, sf):
    return _decided_documents(spark, sf).groupBy("lang", "predicted_action").agg(
        F.count("*").alias("n"), F.round(F.sum("risk_score"), 3).alias("total_risk")
    )


# --- Text scalars ------------------------------------------------------------


def _scalar(name: str, make, prepare=None):
    def run(spark, sf):
        texts = inp.all_texts(spark, sf)
        if prepare is not None:
            texts = texts.withColumn("text", prepare(F.col("text")))
        return texts.select("src", "id", "part", make(F.col("text")).alias("value"))

    QUERIES[name] = run


_scalar("t01_nfkc", tx.nfkc)
_scalar("t02_strip_zero_width", tx.strip_zero_width)
_scalar("t03_map_confusables", tx.map_confusables)
_scalar("t04_has_devanagari", tx.has_devanagari)
_scalar("t05_transliterate", tx.transliterate)
# The tables hold no Devanagari: every Latin letter and digit stands for a character of the script.
_scalar("t05_transliterate_iast", tx.iast, lambda c: F.translate(c, inp.LATIN, inp.AS_DEVANAGARI))
_scalar("t06_lower", F.lower)
_scalar("t07_mask_mentions", tx.mask_mentions, F.lower)
_scalar("t08_squeeze_repeats", tx.squeeze_repeats, F.lower)
_scalar("t09_deleet", tx.deleet, F.lower)
_scalar("t10_join_split_words", lambda c: tx.strip_symbols(tx.join_split_words(c)), F.lower)
_scalar("t11_undisguise_shit", tx.undisguise_shit, F.lower)
_scalar("t12_undisguise_fuck", tx.undisguise_fuck, F.lower)
_scalar("t13_strip_symbols", tx.strip_symbols, F.lower)
_scalar("t16_detect_script", tx.detect_script)
_scalar("t17_language_mix", tx.language_mix)
_scalar("t18_redact_text", tx.redact_text)
_scalar("t20_text_hash", tx.text_hash)
_scalar("t24_preview", tx.preview)


@query
def t14_normalize_text(spark, sf):
    return with_normalized(inp.all_texts(spark, sf)).select(
        "src", "id", "part", F.col("normalized_text").alias("value")
    )


@query
def t15_token_set(spark, sf):
    tokens = F.array_sort(F.array_distinct("tokens"))
    return with_normalized(inp.all_texts(spark, sf)).select(
        "src", "id", "part", F.size(tokens).cast("long").alias("n_tokens"),
        F.md5(F.array_join(tokens, " ")).alias("tokens_md5"),
    )


@query
def t19_plain_text(spark, sf):
    return inp.table(spark, sf, "pages").select("page_id", tx.plain_text("html").alias("value"))


@query
def t21_cache_key(spark, sf):
    return inp.document_comments(spark, sf).select("comment_id", tx.cache_key("text", "context_type").alias("value"))


@query
def t22_find_pii(spark, sf):
    return inp.all_texts(spark, sf).select(
        "src", "id", "part", tx.has_email("text").alias("email"), tx.has_phone("text").alias("phone")
    )


@query
def t23_labels_multi(spark, sf):
    rows = inp.example_sources(spark, sf).withColumn(
        "labels_multi",
        F.when(F.col("comment_id") % 5 == 0, F.lit("{not json"))
        .when(F.col("comment_id") % 5 == 1, F.lit('{"a": 1}'))
        .otherwise(tx.encode_labels("labels")),
    )
    return rows.select(
        "comment_id", "labels_multi", tx.is_json("labels_multi").alias("is_json"),
        tx.is_json_list("labels_multi").alias("is_list"),
        F.when(tx.is_json_list("labels_multi"), F.get(tx.parse_labels("labels_multi"), F.lit(1))).alias("second_label"),
    )


# --- Matching and decisions --------------------------------------------------


def _text_frame(spark, sf):
    texts = inp.all_texts(spark, sf)
    return with_normalized(texts.withColumn("comment_id", F.concat_ws("-", "src", "id", "part")))


@query
def m01_lexicon_buckets(spark, sf):
    """How many comments hold each first word of the lexicon, and its phrases."""
    buckets = lx.build_lexicon(spark).groupBy("list", "first").agg(F.count_if("is_phrase").alias("n_phrases"))
    tokens = _text_frame(spark, sf).select(F.explode(F.array_distinct("tokens")).alias("first"))
    hits = tokens.join(F.broadcast(buckets), "first")
    return hits.groupBy("list", "first", "n_phrases").agg(F.count("*").alias("n_comments"))


@query
def m02_match_lexicon_join(spark, sf):
    matches = lj.join_lexicon(_text_frame(spark, sf), lx.build_lexicon(spark))
    return matches.groupBy("list", "phrase").agg(F.count("*").alias("n_comments"))


@query
def m02_match_lexicon_scan(spark, sf):
    matches = lx.match_lexicon(_text_frame(spark, sf), lx.build_lexicon(spark))
    return matches.groupBy("list", "phrase").agg(F.count("*").alias("n_comments"))


@query
def m02_match_lexicon_expressions(spark, sf):
    signals = lx.with_signals(_text_frame(spark, sf))
    return signals.groupBy("src").agg(
        *[F.count_if(F.col(f"sig_{n}")).alias(n) for n in lx.SIGNAL_LISTS]
    )


@query
def m03_matched_phrases(spark, sf):
    found = lx.matched_phrases(_text_frame(spark, sf))
    labels = F.transform("matched", lambda m: F.concat_ws(":", m["list"], m["phrase"]))
    return found.select("comment_id", F.array_join(F.array_sort(labels), "|").alias("matched"))


@query
def m04_contains_any(spark, sf):
    return _text_frame(spark, sf).select(
        "comment_id",
        lx.contains_any("tokens", "normalized_text", fv.HATE_WORDS).alias("hate_word"),
        lx.contains_any("tokens", "normalized_text", fv.FAN_WORDS).alias("fan_word"),
    )


@query
def m05_has_mention(spark, sf):
    return _text_frame(spark, sf).select("comment_id", F.array_contains("tokens", fv.MENTION_TOKEN).alias("has_mention"))


@query
def m06_lexicon_signals(spark, sf):
    return lx.with_signals(_text_frame(spark, sf)).select(
        "comment_id", *[F.col(f"sig_{n}").alias(n) for n in lx.MATCHER_LISTS]
    )


@query
def m07_detect_target(spark, sf):
    return mod.with_heuristics(inp.event_comments(spark, sf)).groupBy("_target", "context_type").agg(
        F.count("*").alias("n")
    ).withColumnRenamed("_target", "target")


@query
def m08_heuristic_toxicity(spark, sf):
    return mod.with_heuristics(inp.event_comments(spark, sf)).select("comment_id", F.col("_htox").alias("toxicity"))


@query
def m09_sentiment(spark, sf):
    scored = _text_frame(spark, sf).withColumn("balance", mod.sentiment_balance("normalized_text"))
    return scored.select(
        "comment_id", dc.sentiment_label(F.col("balance")).alias("label"),
        dc.sentiment_score(F.col("balance")).alias("score"),
    )


def _length_model(texts):
    """A stand-in classifier: long texts negative, short ones positive."""
    return [
        {"label": "LABEL_0" if len(t) > 60 else "POS" if len(t) < 20 else "LABEL_1", "score": len(t) / (len(t) + 100)}
        for t in texts
    ]


@query
def m10_score_sentiment_model(spark, sf):
    scored = sc.score_sentiment(_text_frame(spark, sf).select("comment_id", "normalized_text"), model=_length_model)
    return scored.select("comment_id", "sentiment_label", "sentiment_score", "sentiment_source")


@query
def m10_model_label_map(spark, sf):
    labels = ["positive", "POS", "LABEL_2", "2", "negative", "Neg", "label_0", "0", "LABEL_1", "other"]
    raw = inp._pick(labels, F.col("event_id") % len(labels))
    return inp.table(spark, sf, "events").groupBy(dc.model_label(raw).alias("label")).agg(F.count("*").alias("n"))


@query
def m11_toxicity_from_label(spark, sf):
    raw = inp._pick(["toxic", "non-toxic", "Severe_Toxic", "clean"], F.col("event_id") % 4)
    score = F.col("value") / (F.col("value") + 100)
    return inp.table(spark, sf, "events").select(
        "event_id", F.round(dc.toxicity_from_label(raw, score), 6).alias("toxicity")
    )


@query
def m12_model_score(spark, sf):
    given = F.when(F.col("comment_id") % 2 == 0, F.lit(float("nan"))).otherwise(F.col("model_toxicity_score"))
    df = inp.document_comments(spark, sf).withColumn("model_toxicity_score", given)
    return mod.moderate(df).select("comment_id", "model_toxicity_score", "heuristic_toxicity_score")


@query
def m13_rating_disagreement(spark, sf):
    df = inp.document_comments(spark, sf)
    risk = dc.rating_disagreement(
        F.col("parent_review_rating"), F.col("movie_rating_perfection_pct"), F.col("movie_rating_skip_pct")
    )
    return df.select("comment_id", risk.alias("disagreement"))


@query
def m14_risk_score(spark, sf):
    return _decided_documents(spark, sf).select("comment_id", "risk_score")


@query
def m15_decide_action(spark, sf):
    return _decided_events(spark, sf).groupBy(
        "predicted_action", "predicted_category", "predicted_intent", "predicted_severity", "target_detected_pred"
    ).agg(F.count("*").alias("n"))


@query
def m16_reason_codes(spark, sf):
    return _decided_events(spark, sf).select("comment_id", _joined("reason_codes"))


@query
def m17_explain(spark, sf):
    return _decided_events(spark, sf).groupBy("predicted_action", "reason").agg(F.count("*").alias("n"))


@query
def m18_is_clean(spark, sf):
    decided = mod.moderate(inp.document_comments(spark, sf), keep_signals=True)
    clean = dc.is_clean(
        mod.signal_map(), F.col("predicted_action"), F.col("risk_score"), F.col("model_toxicity_score")
    )
    return decided.select("comment_id", clean.alias("is_clean"))


@query
def m19_rule_embedding_text(spark, sf):
    return inp.rule_sources(spark, sf).select("id", rt.rule_embedding_text("description", "examples").alias("document"))


@query
def m20_retrieve_rules(spark, sf):
    vectors = inp.table(spark, sf, "embeddings").withColumnRenamed("vec_id", "comment_id")
    found = rt.retrieve_rules(vectors, inp.class_rules(spark, sf), k=3, max_distance=1.2)
    return found.select("comment_id", "rank", "rule_id", F.round("distance", 5).alias("distance"))


@query
def m20_nearest_in_table(spark, sf):
    """The nearest rules of every vector in a rule table that has a rule for each vector."""
    vectors = inp.table(spark, sf, "embeddings")
    rules = vectors.select(
        F.concat(F.lit("rule_"), "vec_id").alias("id"), *[F.lit("allow").alias(c) for c in ("action", "category", "severity")], "embedding"
    )
    found = nn.nearest_rules(vectors.withColumnRenamed("vec_id", "comment_id"), rules, 3, 1.9, "comment_id")
    return found.select("comment_id", "rank", F.col("id").alias("rule_id"), F.round("distance", 5).alias("distance"))


@query
def m21_rule_override(spark, sf):
    decided = mod.moderate(inp.embedded_comments(spark, sf), rules=inp.class_rules(spark, sf))
    return decided.select(
        "comment_id", "predicted_action", "predicted_category", "predicted_severity", _joined("triggered_rules")
    )


@query
def m22_failure_rows(spark, sf):
    broken = F.when(F.col("event_type") == "error", F.lit("n/a")).otherwise(F.col("movie_rating_skip_pct").cast("string"))
    score = F.when(F.col("event_type") == "view", F.lit("high"))
    text = F.when(F.col("event_type") != "signup", F.col("text"))
    df = inp.event_comments(spark, sf).withColumns(
        {"movie_rating_skip_pct": broken, "model_toxicity_score": score, "text": text}
    )
    return mod.moderate(df).groupBy(
        "predicted_action", "predicted_category", F.array_join("reason_codes", "|").alias("codes"), "reason"
    ).agg(F.count("*").alias("n"), F.round(F.sum("risk_score"), 3).alias("risk"))


def _odd_requests(spark, sf):
    i = F.col("comment_id")
    return inp.document_comments(spark, sf).withColumns({
        "movie_rating_perfection_pct": F.when(i % 13 == 0, F.lit(120.0)).otherwise(F.col("movie_rating_perfection_pct")),
        "movie_rating_skip_pct": F.when(i % 17 == 0, F.lit(-1.0)).otherwise(F.col("movie_rating_skip_pct")),
        "model_toxicity_score": F.when(i % 19 == 0, F.lit(1.5)).otherwise(F.col("model_toxicity_score")),
    })


@query
def m23_validate_requests(spark, sf):
    ok, rejected = mod.validate_requests(_odd_requests(spark, sf))
    return ok.select("comment_id", F.lit("").alias("reasons")).unionByName(
        rejected.select("comment_id", F.array_join("reject_reasons", "|").alias("reasons"))
    )


@query
def m23_validate_batches(spark, sf):
    """Batches are the documents of a source; too large ones are turned away whole."""
    sizes = inp.table(spark, sf, "documents").groupBy("source").agg((F.count("*") * 5).alias("n_rows"))
    _, rejected = mod.validate_requests(_odd_requests(spark, sf), sizes, "source")
    return rejected.groupBy("source", F.array_contains("reject_reasons", "batch_size_out_of_range").alias("batch_too_large")).agg(
        F.count("*").alias("n")
    )


@query
def m24_moderate_documents(spark, sf):
    return _flat_decisions(_decided_documents(spark, sf), "comment_id")


@query
def m24_moderate_conversations(spark, sf):
    return _flat_decisions(mod.moderate(inp.conversation_comments(spark, sf)), "conv_id", "turn")


@query
def m24_moderate_events(spark, sf):
    return _flat_decisions(mod.moderate(inp.event_comments(spark, sf)), "comment_id")


@query
def m25_moderate_v1_documents(spark, sf):
    return _flat_decisions(mod.moderate(inp.document_comments(spark, sf), profile="v1"), "comment_id")


@query
def m25_moderate_v1_events(spark, sf):
    return _flat_decisions(mod.moderate(inp.event_comments(spark, sf), profile="v1"), "comment_id")


@query
def m26_risk_band_counts(spark, sf):
    return mod.risk_band_counts(_decided_documents(spark, sf))


# --- Evaluation --------------------------------------------------------------


def _evaluated(spark, sf):
    return mod.moderate(inp.labelled_documents(spark, sf))


def _cube(spark, sf, *by):
    return ev.confusion_counts(_evaluated(spark, sf), by=list(by))


@query
def a01_prepare_eval(spark, sf):
    usable, skipped = ev.prepare_eval(inp.raw_labelled_documents(spark, sf))
    kept = usable.select(
        "comment_id", "moderation_action", "movie_rating_perfection_pct", "movie_rating_skip_pct", "language_mix",
        F.lit(False).alias("skipped"), F.md5("text").alias("text_md5"),
    )
    gone = skipped.select(
        "comment_id", "moderation_action", "movie_rating_perfection_pct", "movie_rating_skip_pct", "language_mix",
        F.lit(True).alias("skipped"), F.md5("text").alias("text_md5"),
    )
    return kept.unionByName(gone)


@query
def a02_confusion_matrix(spark, sf):
    return ev.confusion_matrix(_cube(spark, sf))


@query
def a03_class_metrics(spark, sf):
    return ev.class_metrics(_cube(spark, sf)).select(
        "label", "tp", "fp", "fn", "support", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")]
    )


@query
def a04_accuracy(spark, sf):
    return ev.accuracy(_cube(spark, sf)).select("total", F.round("accuracy", 9).alias("accuracy"))


@query
def a05_macro_weighted_f1(spark, sf):
    return ev.summary_metrics(ev.class_metrics(_cube(spark, sf))).select(
        F.round("macro_f1", 9).alias("macro_f1"), F.round("weighted_f1", 9).alias("weighted_f1")
    )


@query
def a06_naive_baseline(spark, sf):
    return ev.naive_baseline(_cube(spark, sf)).select("majority_label", F.round("baseline_accuracy", 9).alias("baseline_accuracy"))


@query
def a07_metrics_by_language(spark, sf):
    return ev.metrics_by(_cube(spark, sf, "lang"), "lang")


@query
def a08_binary_report(spark, sf):
    return ev.binary_report(_cube(spark, sf)).select(
        "label", "tp", "fp", "fn", "support", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")]
    )


def _labelled_examples(spark, sf):
    fields = inp.example_sources(spark, sf).select("comment_id", tx.encode_labels("labels").alias("labels_multi"), "target_detected")
    return _decided_documents(spark, sf).join(fields, "comment_id")


@query
def a09_false_positives_on_criticism(spark, sf):
    rate = ev.slice_flag_rate(_labelled_examples(spark, sf), ev.is_harsh_criticism())
    return rate.select("n_rows", F.round("flag_rate", 9).alias("flag_rate"))


@query
def a10_catch_rate_on_people(spark, sf):
    rate = ev.slice_flag_rate(_labelled_examples(spark, sf), ev.aims_at_people())
    return rate.select("n_rows", F.round("flag_rate", 9).alias("flag_rate"))


@query
def j03_attach_predictions(spark, sf):
    labels = inp.labelled_documents(spark, sf).select("comment_id", "moderation_action")
    predictions = _decided_documents(spark, sf).select("comment_id", "predicted_action", "risk_score")
    return ev.attach_predictions(labels, predictions, "comment_id")


@query
def s13_eval_report(spark, sf):
    report = ev.eval_report_json(ev.eval_report(_cube(spark, sf, "lang"), "lang", dataset="documents"))
    parsed = F.from_json(
        "report",
        "total long, accuracy double, macro_f1 double, weighted_f1 double, dataset_path string, "
        "per_class array<struct<label string, precision double, recall double, f1 double, support long>>, "
        "per_language array<struct<lang string, count long, accuracy double, macro_f1 double>>",
    )
    return report.select(parsed.alias("r")).select(
        "r.total", "r.accuracy", "r.macro_f1", "r.weighted_f1", "r.dataset_path",
        F.size("r.per_class").cast("long").alias("n_classes"), F.size("r.per_language").cast("long").alias("n_languages"),
    )


# --- Quality and dataset -----------------------------------------------------


def _examples(spark, sf):
    derived = ds.derive_example_fields(inp.example_sources(spark, sf))
    return derived.withColumns({
        "split": F.lit("train"), "provenance_notes": F.lit(""), "created_by": F.lit("table"), "created_at": F.lit("2024-01-01"),
    })


def _example_rows(spark, sf):
    """Every document as a complete example row; some ids repeat on purpose."""
    numbered = _examples(spark, sf).withColumn("example_id", F.concat(F.lit("ex_"), F.floor(F.col("comment_id") / 3) * 3))
    return ds.as_example_rows(numbered).select(
        F.substring_index("scenario_id", "_", -1).cast("long").alias("row_key"), "*"
    )


@query
def a11_value_counts(spark, sf):
    return ql.value_counts(inp.table(spark, sf, "documents"), ["lang", "source"])


@query
def a12_class_distribution(spark, sf):
    return ql.class_distribution(_examples(spark, sf))


@query
def a13_duplicate_texts(spark, sf):
    return ql.duplicate_texts(inp.table(spark, sf, "documents")).select(
        F.md5("duplicate_text").alias("text_md5"), "count"
    )


@query
def a13_duplicate_count(spark, sf):
    return ql.duplicate_count(inp.table(spark, sf, "documents"))


@query
def a14_validate_examples(spark, sf):
    """The rows are validated with their raw texts, which hold e-mails and numbers."""
    raw = inp.table(spark, sf, "documents").select(F.col("doc_id").alias("row_key"), F.col("text").alias("_raw"))
    rows = _example_rows(spark, sf).join(raw, "row_key").withColumn("text", F.col("_raw")).drop("_raw")
    i = F.col("row_key")
    rows = rows.withColumns({
        "split": F.when(i % 10 == 0, F.lit("")).otherwise(F.col("split")),
        "severity": F.when(i % 8 == 0, F.lit("severe")).otherwise(F.col("severity")),
        "labels_multi": F.when(i % 9 == 0, F.lit('{"a": 1}')).when(i % 9 == 1, F.lit("[oops")).otherwise(F.col("labels_multi")),
    })
    return ql.validate_examples(rows, "row_key", 500)


@query
def d01_derive_example_fields(spark, sf):
    return _examples(spark, sf).select(
        "comment_id", "text", "has_mention", "language_mix", "labels_multi", "contains_profanity",
        "is_directed_at_person", "is_transformed", "transformation_type",
    )


@query
def d02_rationale(spark, sf):
    return _examples(spark, sf).groupBy("moderation_action", "target_detected", "rationale_short").agg(F.count("*").alias("n"))


@query
def d03_map_toxicity_labels(spark, sf):
    return ds.map_toxicity_labels(inp.toxicity_sources(spark, sf)).select(
        "comment_id", "moderation_action", "label_primary", tx.encode_labels("labels").alias("labels_multi"),
        "abuse_category", "intent_label", "severity",
    )


@query
def d04_balanced_sample(spark, sf):
    rows = ds.map_toxicity_labels(inp.toxicity_sources(spark, sf))
    return ds.balanced_sample(rows, 30, "comment_id").select("comment_id", "text", "moderation_action")


@query
def d05_stratified_split(spark, sf):
    return ds.stratified_split(_examples(spark, sf), "comment_id").select("comment_id", "scenario_id", "split")


@query
def d06_assign_ids(spark, sf):
    return ds.assign_ids(_examples(spark, sf), "comment_id").select("comment_id", "example_id")


@query
def d07_uniquify_text(spark, sf):
    return ds.uniquify_text(_examples(spark, sf), "comment_id").select("comment_id", "text")


@query
def d08_keyword_label(spark, sf):
    texts = inp.all_texts(spark, sf)
    return texts.select(
        "src", "id", "part",
        ds.keyword_label(F.col("text"), fv.GROUP_FLAG_KEYWORDS, "flag_for_review").alias("group_action"),
        ds.keyword_label(F.col("text"), fv.PROTECTED_FLAG_KEYWORDS, "flag_for_removal").alias("protected_action"),
    )


@query
def d09_limit_rows(spark, sf):
    return rk.limit_rows(_examples(spark, sf), ["comment_id"], 500).select("comment_id", "scenario_id")


@query
def d10_default_context(spark, sf):
    feed = inp.table(spark, sf, "conversations")
    return _flat_decisions(mod.moderate(mod.with_default_context(feed)), "conv_id", "turn")


@query
def d11_replicate(spark, sf):
    # Equal rows are counted before they are replicated: a task holds an id once, not five times.
    ids = inp.event_comments(spark, sf).groupBy("comment_id", "context_type").agg(F.count("*").alias("n"))
    copies = ds.replicate(ids, 5)
    return copies.groupBy("copy", "context_type").agg(F.sum("n").alias("n"), F.count("comment_id").alias("n_ids"))


# --- Operations --------------------------------------------------------------


@query
def a15_decision_counts(spark, sf):
    return mt.decision_counts(_decided_events(spark, sf))


@query
def a16_latency_histogram(spark, sf):
    return mt.latency_histogram(inp.event_comments(spark, sf))


@query
def a17_ops_summary(spark, sf):
    decided = _decided_events(spark, sf).withColumn("model_called", F.col("event_type") == "view")
    out = mt.ops_summary(decided, exact=True)
    return out.select("n_requests", *[F.round(c, 6).alias(c) for c in out.columns if c != "n_requests"])


@query
def a17_latency_rollup(spark, sf):
    """Days from the sketches of their hours: the requests, and whether each quantile's true rank is within the sketch's error."""
    events = _timed_events(spark, sf)
    days = written(mt.merged_latencies(mt.latency_sketches(events)), "latency-days")
    rows = events.select(F.window("ts", "1 day")["start"].alias("start"), "latency_s").join(days, "start")

    def right(name, p):
        # The share of values below and up to the quantile: its rank lies between.
        below, up_to = F.avg((F.col("latency_s") < F.col(name)).cast("double")), F.avg((F.col("latency_s") <= F.col(name)).cast("double"))
        return ((below - 2 * mt.SKETCH_ERROR <= p) & (up_to + 2 * mt.SKETCH_ERROR >= p)).alias(f"{name}_right")

    judged = rows.groupBy("start", F.col("n").alias("n_requests")).agg(*[right(n, p) for n, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))])
    return judged.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "n_requests", "p50_right", "p95_right", "p99_right")


@query
def a18_error_counts(spark, sf):
    broken = F.when(F.col("event_type") == "error", F.lit("n/a")).otherwise(F.lit("50"))
    df = inp.event_comments(spark, sf).withColumn("movie_rating_perfection_pct", broken)
    return mt.error_counts(mod.moderate(df))


@query
def a19_cache_hits(spark, sf):
    return mt.cache_hit_rate(inp.event_comments(spark, sf))


@query
def a19_cache_hits_week(spark, sf):
    """As a19_cache_hits, with a time to live that the sparse tables have hits for."""
    return mt.cache_hit_rate(inp.event_comments(spark, sf), ttl_seconds=7 * 86_400)


@query
def a19_cache_summary(spark, sf):
    out = mt.cache_summary(mt.cache_hit_rate(inp.event_comments(spark, sf)))
    return out.withColumn("hit_rate", F.round("hit_rate", 9))


@query
def a20_action_summary(spark, sf):
    return mt.action_summary(_decided_events(spark, sf))


def _training_rows(spark, sf):
    """Labelled documents, and the events with the action their v1 decision gave."""
    fields = ["src", "comment_id", "text", "context_type", "moderation_action"]
    docs = inp.labelled_documents(spark, sf).withColumn("src", F.lit("doc")).select(*fields)
    events = mod.moderate(inp.event_comments(spark, sf), profile="v1")
    events = events.withColumns({"src": F.lit("event"), "moderation_action": F.col("predicted_action")}).select(*fields)
    return docs.unionByName(events)


@query
def a21_fit_risk_weights(spark, sf):
    weights = tr.weights_table(tr.risk_features(_training_rows(spark, sf)))
    return weights.select("weight", F.round("fitted", 6).alias("fitted"), "clamped")


@query
def a22_risk_features(spark, sf):
    return tr.risk_features(_training_rows(spark, sf)).select("src", "comment_id", *tr.FEATURES, "flagged")


def _audit_and_feedback(spark, sf):
    """Audited decisions on documents; feedback is the label of a document, given
    at a time that follows its id."""
    docs = _decided_documents(spark, sf).withColumn("request_id", F.col("comment_id").cast("string"))
    labels = inp.labelled_documents(spark, sf)
    feedback = labels.select(
        F.timestamp_seconds("comment_id").alias("timestamp"), tx.text_hash("text").alias("text_hash"),
        F.col("moderation_action").alias("human_action"), F.concat(F.lit("m"), F.col("quality")).alias("moderator_id"),
    )
    return tb.audit_rows(docs), tb.feedback_rows(feedback)


@query
def a23_feedback_disagreement(spark, sf):
    return fb.feedback_disagreement(*_audit_and_feedback(spark, sf))


@query
def a23_override_rate(spark, sf):
    out = fb.override_rate(fb.feedback_disagreement(*_audit_and_feedback(spark, sf)))
    return out.withColumn("override_rate", F.round("override_rate", 9))


@query
def j04_feedback_join(spark, sf):
    return fb.join_feedback(*_audit_and_feedback(spark, sf)).select("request_id", "action", "human_action", "moderator_id")


@query
def j05_moderate_distinct(spark, sf):
    return _flat_decisions(_decided_events(spark, sf), "comment_id")


@query
def r01_review_queue(spark, sf):
    return rk.review_queue(_decided_documents(spark, sf)).select("comment_id", "predicted_action", "risk_score")


@query
def r02_top_risk(spark, sf):
    return rk.top_risk(_decided_documents(spark, sf), 50).select("comment_id", "predicted_action", "risk_score")


@query
def r03_clean_feed(spark, sf):
    feed = inp.table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("position"),
        F.when(F.col("conv_id") % 10 == 0, F.lit("[deleted]")).otherwise(F.col("text")).alias("body"),
    )
    return feeds.clean_feed(feed).select("position", "text")


@query
def r04_latest_review_items(spark, sf):
    return rk.latest_review_items(_decided_events(spark, sf)).select("comment_id", "predicted_action")


@query
def r05_head_sample(spark, sf):
    return rk.head_sample(inp.table(spark, sf, "documents"), ["doc_id"]).select(
        "doc_id", tx.preview("text").alias("preview"), "lang"
    )


# --- Sources and sinks -------------------------------------------------------


@query
def s01_read_examples_csv(spark, sf):
    path = shared_path(spark, "examples-csv")
    rows = inp.document_comments(spark, sf).select(
        F.col("comment_id").cast("string").alias("example_id"), "text", "context_type", F.lit("").alias("source_url")
    )
    ds.as_example_rows(rows).write.options(**tb.CSV_OPTIONS).csv(path)
    return tb.read_examples(spark, path).select("example_id", "text", "context_type", "source_url")


@query
def s02_examples_parquet(spark, sf):
    path = shared_path(spark, "examples-parquet")
    tb.write_examples(ds.as_example_rows(_examples(spark, sf)), path)
    return tb.read_examples(spark, path, "parquet").select("scenario_id", "text", "labels_multi", "moderation_action")


@query
def s03_write_examples_csv(spark, sf):
    path = shared_path(spark, "examples-swap")
    rows = ds.as_example_rows(_examples(spark, sf))
    tb.write_examples_csv(rows.filter(F.col("moderation_action") != "allow"), path)
    tb.write_examples_csv(rows, path)
    return tb.read_examples(spark, path).select("scenario_id", "text", "labels_multi", "moderation_action")


@query
def s04_policy_rules(spark, sf):
    """The rules by the decisions that fall into their category."""
    path = shared_path(spark, "rules")
    tb.write_policy_rules(tb.policy_rules(spark), path)
    rules = tb.read_policy_rules(spark, path)
    decided = _decided_events(spark, sf).groupBy("predicted_category").agg(F.count("*").alias("n"))
    return rules.join(decided, rules.category == decided.predicted_category, "left").select(
        "id", "action", "category", "severity", F.size("examples").cast("long").alias("n_examples"),
        F.coalesce("n", F.lit(0)).alias("n_decisions"),
    )


@query
def s05_lexicon_usage(spark, sf):
    path = shared_path(spark, "lexicon")
    lx.build_lexicon(spark).select("list", F.upper("phrase").alias("phrase")).write.option("header", True).csv(path)
    lexicon = tb.read_lexicon(spark, path)
    matches = lx.match_lexicon(_text_frame(spark, sf), lexicon)
    return lexicon.select("list", "phrase").join(
        matches.groupBy("list", "phrase").agg(F.count("*").alias("n")), ["list", "phrase"], "left"
    ).select("list", "phrase", F.coalesce("n", F.lit(0)).alias("n"))


@query
def s06_weights(spark, sf):
    """Decisions under weights read from a table that leaves some keys out."""
    path = shared_path(spark, "weights")
    spark.range(1).select(F.lit(0.4).alias("reply_context_base"), F.lit(0.58).alias("flag_for_review_risk")).write.json(path)
    decided = mod.moderate(inp.event_comments(spark, sf), weights=tb.read_weights(spark, path))
    return decided.select("comment_id", "predicted_action", "risk_score")


@query
def s07_audit(spark, sf):
    path = shared_path(spark, "audit")
    decided = _decided_documents(spark, sf).withColumns({
        "ts": F.timestamp_seconds(F.col("comment_id") * 3600), "request_id": F.col("comment_id").cast("string"),
        "latency_ms": F.col("comment_id") / 7,
    })
    tb.write_audit(tb.audit_rows(decided), path)
    return tb.read_audit(spark, path).select(
        F.unix_timestamp("timestamp").alias("epoch"), "request_id", "text_hash", "context_type", "action",
        "category", "severity", _joined("reason_codes"), "latency_ms",
    )


@query
def s08_feedback(spark, sf):
    path = shared_path(spark, "feedback")
    labels = inp.raw_labelled_documents(spark, sf)
    feedback = labels.select(
        F.timestamp_seconds("comment_id").alias("timestamp"), tx.text_hash("text").alias("text_hash"),
        F.lower(F.regexp_replace("moderation_action", r"^ |\n$", "")).alias("human_action"),
    )
    tb.append_feedback(feedback, path)
    tb.append_feedback(feedback.filter(F.col("human_action") == "flag_for_removal"), path)
    return tb.read_feedback(spark, path).select(
        F.unix_timestamp("timestamp").alias("epoch"), "text_hash", "human_action", "moderator_id"
    )


@query
def s09_export_csv(spark, sf):
    path = shared_path(spark, "export")
    feed = mod.moderate(mod.with_default_context(inp.table(spark, sf, "conversations")))
    named = feed.withColumns({"source": F.concat_ws("-", "conv_id", "turn"), "score": F.length("text")})
    tb.export_moderation_csv(named, path)
    back = spark.read.options(**tb.CSV_OPTIONS).csv(path)
    return back.select(
        "source", F.col("score").cast("long").alias("score"), "text", "predicted_action", "target_detected_pred",
        "predicted_category", "predicted_severity", F.col("risk_score").cast("double").alias("risk_score"),
        F.coalesce("reason_codes", F.lit("")).alias("reason_codes"), "reason",
    )


@query
def s10_flatten_threads(spark, sf):
    flat = feeds.flatten_threads(inp.thread_documents(spark, sf), any_depth=True)
    return flat.select(
        F.col("thread_id").alias("conv_id"), F.col("position").alias("turn"), F.col("body").alias("text"),
        F.col("score"), F.col("depth"),
    )


@query
def s10_order_threads(spark, sf):
    """Branching threads: three turns answer the last turn of the three before."""
    turns = inp.table(spark, sf, "conversations").withColumn("parent", F.when(F.col("turn") > 0, F.col("turn") - 1 - (F.col("turn") - 1) % 3))
    return th.order_threads(turns, "conv_id", "turn", "parent", "turn").select("conv_id", "turn", "parent", "position", "depth", "text")


@query
def s11_upsert_rules(spark, sf):
    """One rule per source; sources with toxic documents change theirs, languages are new."""
    docs = inp.table(spark, sf, "documents")
    rules = docs.groupBy(F.col("source").alias("id")).agg(
        F.concat(F.lit("documents: "), F.count("*")).alias("description"), F.lit("allow").alias("action"), F.lit("none").alias("severity")
    )
    toxic = docs.join(inp.table(spark, sf, "labels").filter("toxic = 1"), "doc_id")
    changes = toxic.groupBy(F.col("source").alias("id")).agg(
        F.lit("flag_for_review").alias("action"), F.concat(F.lit("toxic: "), F.count("*")).alias("description")
    )
    new = docs.groupBy(F.col("lang").alias("id")).agg(
        F.lit("allow").alias("action"), F.concat(F.lit("language: "), F.count("*")).alias("description")
    )
    return feeds.upsert_rules(rules, changes.unionByName(new))


@query
def s12_pii_scan(spark, sf):
    return ql.quality_tables(_examples(spark, sf))["pii_scan"]


@query
def s14_build_rule_index(spark, sf):
    vectors = inp.table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "embedding")
    rules = inp.rule_sources(spark, sf).drop("embedding").join(vectors, "id")
    path = shared_path(spark, "rule-index")
    tb.write_rule_index(rt.build_rule_index(rules), path)
    return spark.read.parquet(path).select(
        "id", "document", "action", "category", "severity", F.size("embedding").cast("long").alias("n_dims"),
        F.size(tx.parse_labels("examples")).cast("long").alias("n_examples"),
    )


# --- Streams -----------------------------------------------------------------


def _run_to_parquet(spark, stream: DataFrame, path: str) -> DataFrame:
    running = (
        stream.writeStream.format("parquet").option("checkpointLocation", f"{path}-checkpoint")
        .trigger(availableNow=True).start(path)
    )
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def _replayed(spark, logs: dict[str, tuple[DataFrame, str]], build, name: str, slices: int = 3) -> DataFrame:
    """What a stream makes of logs (table, time column) that arrive in slices of time.

    After each slice the stream is started anew from its checkpoint and takes
    what has come, as a job does that runs by the hour.
    """
    root = shared_path(spark, name)
    for streams in _arriving(spark, logs, root, slices):
        out = _run_to_parquet(spark, build(**streams), f"{root}/out")
    return out


def _arriving(spark, logs: dict[str, tuple[DataFrame, str]], root: str, slices: int = 3):
    """The logs as streams, once after each slice of time has been added to them."""
    # Derived once; the edges and each slice are read from that.
    logs = {log: (written(table, f"{log}-log"), ts) for log, (table, ts) in logs.items()}
    edges = [table.agg(F.min(ts).cast("timestamp_ltz"), F.max(ts).cast("timestamp_ltz")).first() for table, ts in logs.values()]
    edges = [x for x in edges if x[0] is not None]
    for k in range(slices):
        for log, (table, ts) in logs.items():
            number = F.lit(0)
            if edges:
                lo, hi = min(x[0] for x in edges), max(x[1] for x in edges)
                span = max(1.0, (hi - lo).total_seconds() + 1)
                seconds = (F.unix_micros(F.col(ts).cast("timestamp_ltz")) - F.unix_micros(F.lit(lo))) / 1e6
                number = F.coalesce(F.floor(seconds * slices / span), F.lit(0))
            table.where(number == k).write.mode("append").parquet(f"{root}/{log}")
        yield {log: spark.readStream.schema(table.schema).parquet(f"{root}/{log}") for log, (table, _) in logs.items()}


@query
def x01_moderate_stream(spark, sf):
    decided = live.moderate_stream(inp.event_stream(spark, sf))
    return _flat_decisions(_run_to_parquet(spark, decided, shared_path(spark, "stream")), "comment_id")


@query
def x02_route_batches(spark, sf):
    root = shared_path(spark, "routed")
    live.start_routing(inp.event_stream(spark, sf), root, f"{root}-checkpoint", availableNow=True).awaitTermination()
    counts = [
        spark.read.parquet(f"{root}/{name}").groupBy(F.col(column).alias("action")).agg(F.count("*").alias("n"))
        .select(F.lit(name).alias("sink"), "action", "n")
        for name, column in (("decisions", "predicted_action"), ("audit", "action"), ("review", "predicted_action"))
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query
def x02_review_queue_state(spark, sf):
    """The newest comments for review, kept as state over three runs of a stream."""
    root = shared_path(spark, "queue")
    for streams in _arriving(spark, {"events": (_timed_events(spark, sf), "ts")}, root):
        live.start_queue(streams["events"], root, f"{root}/checkpoint", availableNow=True).awaitTermination()
    return live.current_queue(spark, root).select("comment_id", "predicted_action")


@query
def x03_dedupe_stream(spark, sf):
    return _deduped(spark, sf, fv.CACHE_TTL_SECONDS)


@query
def x03_dedupe_stream_week(spark, sf):
    return _deduped(spark, sf, 7 * 86_400)


def _timed_events(spark, sf):
    return inp.event_comments(spark, sf).withColumn("ts", F.col("ts").cast("timestamp_ltz"))


def _deduped(spark, sf, ttl_seconds):
    logs = {"events": (_timed_events(spark, sf), "ts")}
    out = _replayed(spark, logs, lambda events: stateful.dedupe_stream(events, ttl_seconds=ttl_seconds), "deduped")
    return out.select("cache_key", "comment_id")


@query
def x04_windowed_decisions(spark, sf):
    out = mt.windowed_decisions(_decided_events(spark, sf), width="1 hour")
    return out.select(
        F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "predicted_action", "n",
        F.round(F.col("avg_latency_s") * F.col("n"), 4).alias("sum_latency_s"), "max_latency_s",
    )


@query
def x04_sliding_decisions(spark, sf):
    out = mt.windowed_decisions(_decided_events(spark, sf), width="1 hour", slide="30 minutes")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "predicted_action", "n")


def _stamp(column):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(column)


@query
def x04_stream_windows(spark, sf):
    """The windows that a stream has closed, after three runs with a watermark of ten minutes."""
    def build(events):
        return mt.windowed_decisions(mod.moderate(events, fields=["predicted_action"]), width="1 hour", watermark="10 minutes")

    out = _replayed(spark, {"events": (_timed_events(spark, sf), "ts")}, build, "windows")
    return out.select(_stamp("start"), "predicted_action", "n", F.round(F.col("avg_latency_s") * F.col("n"), 4).alias("sum_latency_s"), "max_latency_s")


@query
def x04_stream_sessions(spark, sf):
    """The clients' sessions that a stream has closed."""
    def build(events):
        return mt.session_decisions(mod.moderate(events, fields=["predicted_action"]), watermark="10 minutes")

    out = _replayed(spark, {"events": (_timed_events(spark, sf), "ts")}, build, "sessions")
    return out.select(_stamp("start"), _stamp("end"), "client_id", "n", "n_flagged", "max_latency_s")


@query
def x04_session_decisions(spark, sf):
    out = mt.session_decisions(mod.moderate(_timed_events(spark, sf), fields=["predicted_action"]))
    return out.select(_stamp("start"), _stamp("end"), "client_id", "n", "n_flagged", "max_latency_s")


@query
def x05_sliding_rates_batch(spark, sf):
    """Requests beyond ten of their client in a minute, the limit of batch calls."""
    out = mt.sliding_rate_report(_timed_events(spark, sf), limit=fv.RATE_LIMIT_BATCH, seconds=60)
    return out.select("client_id", "comment_id", "n")


@query
def x05_rate_limit_single(spark, sf):
    out = mt.rate_limit_report(_timed_events(spark, sf), limit=fv.RATE_LIMIT_SINGLE, width="1 minute")
    return out.select(_stamp("start"), "client_id", "n")


@query
def x05_sliding_rates_day(spark, sf):
    """Requests beyond four of their client in the day before."""
    return mt.sliding_rate_report(_timed_events(spark, sf), limit=4, seconds=86_400).select("client_id", "comment_id", "n")


@query
def x05_rate_limit_report(spark, sf):
    out = mt.rate_limit_report(inp.event_comments(spark, sf), limit=4, width="1 day")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "client_id", "n")


def _hashed_decisions(events):
    return mod.moderate(events, fields=["predicted_action"]).select("comment_id", "ts", tx.text_hash("text").alias("text_hash"), "predicted_action")


def _attached(joined):
    return joined.select("feedback_id", "comment_id", "human_action", "predicted_action", (
        F.unix_micros("feedback_at") - F.unix_micros("decided_at")).alias("lag_us"))


@query
def x06_stream_feedback_join(spark, sf):
    """Every event's feedback with the decision it is about, from two streams that arrive in slices."""
    logs = {"events": (_timed_events(spark, sf), "ts"), "feedback": (inp.feedback_log(spark, sf), "timestamp")}
    return _attached(_replayed(spark, logs, lambda events, feedback: stateful.stream_feedback_join(
        _hashed_decisions(events), feedback), "feedback"))


@query
def x06_attach_feedback(spark, sf):
    """The same from the whole logs."""
    return _attached(fb.attach_feedback(_hashed_decisions(_timed_events(spark, sf)), inp.feedback_log(spark, sf)))


@query
def x07_micro_batches(spark, sf):
    """The model call in micro-batches of 16 gives what batches of 64 give."""
    texts = _text_frame(spark, sf).select("comment_id", "normalized_text")
    small = sc.score_sentiment(texts, model=_length_model, batch_size=16)
    return small.groupBy("sentiment_label", "sentiment_source").agg(
        F.count("*").alias("n"), F.round(F.sum("sentiment_score"), 3).alias("score_sum")
    )


def _length_scorer(texts):
    return [len(t) / (len(t) + 100) for t in texts]


@query
def u01_register_scorer(spark, sf):
    score = sc.register_scorer(_length_scorer)
    scored = inp.document_comments(spark, sf).withColumn("model_toxicity_score", score(F.col("text")))
    return mod.moderate(scored).select("comment_id", "model_toxicity_score", "predicted_action", "risk_score")
