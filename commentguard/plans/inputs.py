"""Comments, labels and logs derived from the given tables.

The tables carry no thread context, so it is assigned from the row's id; every
row of a table becomes a comment.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from commentguard import fixed_values as fv
from commentguard.functions import text as tx
from commentguard.plans.sample_texts import SAMPLE_COMMENTS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


# Rows of a table that are dealt out over the cores whatever their splits hold.
SPREAD_ROWS = 1_000_000
# Rows of one split at most; narrow rows lie by the million in one.
TASK_ROWS = 250_000


def tasks_for(df: DataFrame) -> int | None:
    """How many tasks to deal a scan's rows out to; None where the splits do as they are.

    Text work is bound by the processor, and a small file is one task.  So is a
    large one of narrow rows, whose splits are cut by bytes and by row groups:
    the rows of each split are counted, which reads no column.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    sizes = df.groupBy(F.spark_partition_id().alias("split")).agg(F.count("*").alias("n"))
    rows, most = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    few = df.rdd.getNumPartitions() < cores and rows <= SPREAD_ROWS
    return max(cores, -(-rows // TASK_ROWS)) if few or most > TASK_ROWS else None


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt out where the scan's splits are fewer than the cores or hold too many rows.

    Other tables are left as they are: their scan is parallel without a shuffle.
    """
    tasks = tasks_for(df)
    return df.repartition(tasks) if tasks else df


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def document_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a comment, with its language and source."""
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        i.alias("comment_id"), "text", "lang", "source",
        _pick(fv.CONTEXT_TYPES, i % 4).alias("context_type"),
        _pick(fv.RATINGS, i % 4).alias("parent_review_rating"),
        (i % 101).cast("double").alias("movie_rating_perfection_pct"),
        ((i * 7) % 101).cast("double").alias("movie_rating_skip_pct"),
        F.when(i % 5 == 0, (i % 100).cast("double") / F.lit(100.0)).alias("model_toxicity_score"),
    )


def conversation_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns: the first opens the thread, the others reply."""
    opening = F.col("turn") == 0
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "role", "text",
        F.when(opening, F.lit("main_review")).otherwise(F.lit("reply_to_comment")).alias("context_type"),
        _pick(fv.RATINGS, F.col("conv_id") % 4).alias("parent_review_rating"),
        (F.col("conv_id") % 101).cast("double").alias("movie_rating_perfection_pct"),
        ((F.col("conv_id") * 7) % 101).cast("double").alias("movie_rating_skip_pct"),
    )


def with_sample_text(events: DataFrame) -> DataFrame:
    """Give every event the sample comment its id points at.

    The sample table has a fixed size; it is broadcast.
    """
    samples = events.sparkSession.createDataFrame(
        [(i, *row) for i, row in enumerate(SAMPLE_COMMENTS)],
        "_sample long, text string, context_type string, parent_review_rating string, "
        "movie_rating_perfection_pct double, movie_rating_skip_pct double",
    )
    pointed = events.withColumn("_sample", F.col("event_id") % len(SAMPLE_COMMENTS))
    return pointed.join(F.broadcast(samples), "_sample").select(
        F.col("event_id").alias("comment_id"), "ts", F.col("user_id").alias("client_id"),
        "event_type", (F.col("value") / 100).alias("latency_s"), "text", "context_type",
        "parent_review_rating", "movie_rating_perfection_pct", "movie_rating_skip_pct",
    )


def event_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a comment of its user at its time."""
    return with_sample_text(table(spark, sf_dir, "events"))


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, read as a stream; its micro-batches are dealt out as the table is."""
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    events = spark.readStream.schema(table.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    tasks = tasks_for(table)
    return with_sample_text(events.repartition(tasks) if tasks else events)


def feedback_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A moderator's action on the text of every event, up to 96 minutes after it."""
    delay = F.make_dt_interval(mins=(F.col("comment_id") % 97).cast("int"))
    return event_comments(spark, sf_dir).select(
        F.col("comment_id").alias("feedback_id"), tx.text_hash("text").alias("text_hash"),
        _pick(fv.ACTIONS, F.col("client_id") % 3).alias("human_action"), (F.col("ts").cast("timestamp_ltz") + delay).alias("timestamp"),
    )


#: What stands for a Devanagari character where a query needs some: letters and signs of each kind in turn.
LATIN = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
AS_DEVANAGARI = "ाकखगिघङचेछजझञटोठडढण्तुथदधनपफबभमयरलवशषसहअआइईउऊऋएऐओऔंःँ़क़ॐ।०९ैौ"


def all_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, id, part, text) of every document, conversation turn and event."""
    part = F.lit(0).cast("long")
    docs = document_comments(spark, sf_dir).select(F.lit("doc").alias("src"), F.col("comment_id").alias("id"), part.alias("part"), "text")
    conv = table(spark, sf_dir, "conversations").select(F.lit("conv").alias("src"), F.col("conv_id").alias("id"), F.col("turn").alias("part"), "text")
    events = event_comments(spark, sf_dir).select(F.lit("event").alias("src"), F.col("comment_id").alias("id"), part.alias("part"), "text")
    return docs.unionByName(conv).unionByName(events)


def true_action() -> Column:
    """Expected action of a labelled document: toxic ones go, or to review when
    they are of good quality."""
    return (
        F.when((F.col("toxic") == 1) & (F.col("quality") == 1), F.lit("flag_for_review"))
        .when(F.col("toxic") == 1, F.lit("flag_for_removal"))
        .otherwise(F.lit("allow"))
    )


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that have labels, as labelled comments."""
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("comment_id"), "quality", "toxic", true_action().alias("moderation_action")
    )
    return (
        document_comments(spark, sf_dir)
        .join(labels, "comment_id")
        .withColumn("language_mix", tx.language_mix("text"))
    )


def raw_labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with a label as people type it: padded, mixed case, or absent."""
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("comment_id"),
        F.concat(F.lit(" "), F.initcap(true_action()), F.lit("\n")).alias("moderation_action"),
    )
    docs = document_comments(spark, sf_dir).join(labels, "comment_id", "left")
    i = F.col("comment_id")
    return docs.withColumns({
        "moderation_action": F.when(i % 11 == 0, F.lit("unsure")).otherwise(F.coalesce("moderation_action", F.lit(""))),
        "movie_rating_perfection_pct": F.when(i % 3 == 0, F.lit("")).otherwise((i % 101).cast("string")),
        "movie_rating_skip_pct": F.when(i % 4 == 0, F.lit("")).otherwise(((i * 7) % 101).cast("string")),
        "language_mix": F.when(i % 7 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), F.col("lang"))),
    })


def example_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a row to build a labelled example from."""
    i = F.col("comment_id")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("comment_id"), "quality", "toxic")
    docs = document_comments(spark, sf_dir).join(labels, "comment_id", "left")
    toxic = F.coalesce("toxic", F.lit(0)) == 1
    return docs.select(
        "comment_id", "text", "context_type", "parent_review_rating",
        "movie_rating_perfection_pct", "movie_rating_skip_pct",
        F.concat_ws("_", "source", i.cast("string")).alias("scenario_id"),
        F.when(toxic, F.lit("reviewer_or_user")).otherwise(F.lit("movie_show")).alias("target_detected"),
        F.when(toxic & (F.col("quality") == 1), F.lit("flag_for_review"))
        .when(toxic, F.lit("flag_for_removal")).otherwise(F.lit("allow")).alias("moderation_action"),
        F.when(toxic, F.lit("unsafe")).otherwise(F.lit("safe")).alias("label_primary"),
        F.when(toxic, F.array(F.lit("unsafe"), F.lit("personal_attack")))
        .otherwise(F.array(F.lit("safe"), F.lit("harsh_criticism"))).alias("labels"),
        F.when(toxic, F.lit("personal_attack")).otherwise(F.lit("non_abusive")).alias("abuse_category"),
        F.when(toxic, F.lit("insult")).otherwise(F.lit("criticism")).alias("intent_label"),
        F.when(toxic, F.lit("medium")).otherwise(F.lit("none")).alias("severity"),
        F.when(i % 3 == 0, F.lit("open_source")).otherwise(F.lit("synthetic")).alias("source_type"),
        F.when(i % 6 == 0, F.lit("documents")).otherwise(F.lit("")).alias("source_dataset"),
        F.when(i % 3 == 0, F.concat(F.lit("table:"), F.col("source"))).otherwise(F.lit("")).alias("source_url"),
        F.when(i % 9 == 0, F.lit("")).otherwise(F.lit("CC0")).alias("source_license"),
        (i % 3 != 0).alias("is_transformed"),
    )


def toxicity_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with six toxicity columns, set from its text and label."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("comment_id"), "toxic")
    docs = document_comments(spark, sf_dir).select("comment_id", "text", "source").join(labels, "comment_id", "left")

    def has(word: str) -> Column:
        return F.contains(F.lower("text"), F.lit(word)).cast("int")

    return docs.withColumns({
        "toxic": F.coalesce("toxic", F.lit(0)),
        "severe_toxic": has("moron"), "obscene": has("trash"), "threat": has("loser"),
        "insult": has("idiot"), "identity_hate": has("clown"),
    })


def thread_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as a nested thread: each turn replies to the one before."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "text")), asc=False).alias("turns")
    )

    def nest(below: Column, turn: Column) -> Column:
        own = F.to_json(F.struct(turn["text"].alias("body"), turn["turn"].alias("score")))
        return F.concat(
            F.lit('{"kind":"t1","data":'), F.substring(own, F.lit(1), F.length(own) - 1),
            F.lit(',"replies":'), below, F.lit("}}"),
        )

    def listing(node: Column, start: Column) -> Column:
        wrapped = F.concat(F.lit('{"kind":"Listing","data":{"children":['), node, F.lit("]}}"))
        return F.when(node == start, start).otherwise(wrapped)

    empty = F.lit('""')
    thread = F.aggregate("turns", empty, lambda below, turn: nest(listing(below, empty), turn), lambda n: listing(n, empty))
    return turns.select(F.col("conv_id").alias("thread_id"), thread.alias("thread"))


def rule_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rule per conversation: its first turn describes it, the user's other
    turns are the examples."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t")
    )
    examples = F.transform(
        F.filter("t", lambda x: (x["turn"] > 0) & (x["role"] == "user")), lambda x: x["text"]
    )
    return turns.select(
        F.col("conv_id").cast("string").alias("id"),
        F.get("t", F.lit(0))["text"].alias("description"),
        F.lit("flag_for_review").alias("action"), F.lit("harassment").alias("category"),
        F.lit("medium").alias("severity"), examples.alias("examples"),
        F.lit(None).cast("array<float>").alias("embedding"),
    )


def class_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rule per label of the embeddings: the mean vector of its members."""
    parts = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    means = parts.groupBy("label", "pos").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("x"))
    vectors = means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("v"))
    i = F.col("label")
    return vectors.select(
        F.concat(F.lit("rule_"), i.cast("string")).alias("id"),
        _pick(fv.ACTIONS, i % 3).alias("action"),
        F.concat(F.lit("category_"), i.cast("string")).alias("category"),
        _pick(fv.SEVERITIES, i % 5).alias("severity"),
        F.transform("v", lambda p: p["x"]).alias("embedding"),
    )


def embedded_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, with its embedding where the table has one."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("comment_id"), "embedding")
    return document_comments(spark, sf_dir).join(vectors, "comment_id", "left")
