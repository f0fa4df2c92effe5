"""Nearest policy rules by embedding distance, and what they change."""

import json

from pyspark.sql import Column, DataFrame, functions as F, types as T

from commentguard.operators.nearest import nearest_rules
from commentguard.operators.ranks import salted_join

# Rules that become literals of the plan, so many in each.  A larger table stays
# a table and is searched by ``nearest_rules``, with the same result; only a
# stream takes all rules as literals.
RULES_PER_BLOCK, LITERAL_RULES = 500, 500

_RULE_LITERAL = T.ArrayType(T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("action", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.DoubleType())),
]))


def rule_embedding_text(description: Column | str, examples: Column | str) -> Column:
    """The text of a rule that is embedded: description, then bulleted examples."""
    description = F.col(description) if isinstance(description, str) else description
    examples = F.col(examples) if isinstance(examples, str) else examples
    bullets = F.transform(examples, lambda e: F.concat(F.lit("- "), e))
    listed = F.concat_ws("\n", description, F.lit("Examples:"), F.array_join(bullets, "\n"))
    return F.when(F.size(examples) > 0, listed).otherwise(description)


def squared_l2(a: Column, b: Column) -> Column:
    squares = F.zip_with(
        a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))
    )
    return F.aggregate(squares, F.lit(0.0), lambda total, x: total + x)


def literal_rules(rules: DataFrame) -> list[Column]:
    """The rule table as array literals of at most ``RULES_PER_BLOCK`` rules each."""
    wanted = rules.select(
        "id", "action", "category", "severity", F.col("embedding").cast("array<double>").alias("embedding")
    )
    rows = sorted((row.asDict() for row in wanted.toLocalIterator()), key=lambda r: r["id"])
    starts = range(0, len(rows), RULES_PER_BLOCK)
    return [F.from_json(F.lit(json.dumps(rows[k : k + RULES_PER_BLOCK])), _RULE_LITERAL) for k in starts]


def _nearest(embedding: Column, rules: Column, k: int) -> Column:
    """The k nearest rules as (distance, id, action, category, severity) structs."""
    measured = F.transform(
        rules,
        lambda r: F.struct(
            squared_l2(embedding, r["embedding"]).alias("distance"),
            r["id"].alias("id"), r["action"].alias("action"),
            r["category"].alias("category"), r["severity"].alias("severity"),
        ),
    )
    if k == 1:
        return F.array(F.array_min(measured))
    return F.slice(F.array_sort(measured), 1, k)


def with_nearest_rules(
    df: DataFrame, rules: DataFrame, k: int = 5, max_distance: float = 1.2,
    embedding: str = "embedding", out: str = "rules",
    only_if: Column | None = None,
) -> DataFrame:
    """Add the array of the nearest rules within ``max_distance``, nearest first.

    The distance bound applies after the cut to k, and k is capped at the number
    of rules.  Rows without an embedding, or where ``only_if`` does not hold,
    get an empty array.
    """
    test = F.col(embedding).isNotNull()
    if only_if is not None:
        test = test & only_if
    if not df.isStreaming and is_table(rules):
        return _with_table_rules(df, rules, k, max_distance, embedding, out, test)
    blocks = [_nearest(F.col(embedding), block, k) for block in literal_rules(rules)]
    best = F.lit(None)
    if blocks:
        best = blocks[0] if len(blocks) == 1 else F.slice(F.array_sort(F.concat(*blocks)), 1, k)
    out_df = df.withColumn("_nearest", F.when(test, best))
    within = F.filter("_nearest", lambda r: r["distance"] <= max_distance)
    none = F.from_json(
        F.lit("[]"), "array<struct<distance double, id string, action string, category string, severity string>>"
    )
    return out_df.withColumn(out, F.coalesce(within, none)).drop("_nearest")


def is_table(rules: DataFrame) -> bool:
    """Whether there are more rules than become literals."""
    return len(rules.select("id").take(LITERAL_RULES + 1)) > LITERAL_RULES


def _with_table_rules(
    df: DataFrame, rules: DataFrame, k: int, max_distance: float, embedding: str, out: str, test: Column
) -> DataFrame:
    """Each distinct vector is searched once, whatever ``test`` says of its rows, and its rules are joined back.

    So the search needs nothing but the vectors of ``df``, however much work its other columns are.
    """
    own = F.sha2(F.array_join(F.col(embedding).cast("array<double>").cast("array<string>"), ","), 256)
    keyed = df.withColumn("_vector", own)
    distinct = df.select(own.alias("_vector"), embedding).where(F.col(embedding).isNotNull()).groupBy("_vector").agg(F.first(embedding).alias("embedding"))
    found = nearest_rules(distinct, rules, k, max_distance, "_vector")
    listed = F.sort_array(F.collect_list(F.struct("distance", "id", "action", "category", "severity")))
    lists = found.groupBy("_vector").agg(listed.alias("_found"))
    joined = salted_join(keyed, lists, "_vector", df.columns[:1], "left")
    none = F.expr("cast(array() as array<struct<distance:double,id:string,action:string,category:string,severity:string>>)")
    return joined.withColumn(out, F.coalesce(F.when(test, F.col("_found")), none)).drop("_vector", "_found")


def retrieve_rules(
    queries: DataFrame, rules: DataFrame, k: int = 5, max_distance: float = 1.2,
    embedding: str = "embedding", key: str = "comment_id",
) -> DataFrame:
    """(key, rank, rule_id, distance) rows of the nearest rules."""
    if not queries.isStreaming and is_table(rules):
        best = nearest_rules(queries.select(key, F.col(embedding).alias("embedding")), rules, k, max_distance, key)
        return best.select(key, "rank", F.col("id").alias("rule_id"), "distance")
    found = with_nearest_rules(queries, rules, k, max_distance, embedding, "_found")
    return found.select(key, F.posexplode("_found").alias("_pos", "_rule")).select(
        key, (F.col("_pos") + 1).alias("rank"), F.col("_rule.id").alias("rule_id"),
        F.col("_rule.distance").alias("distance"),
    )


def apply_rule_override(decision: Column, top: Column, model: Column) -> Column:
    """Let the top rule refine a decision struct.

    A rule that asks for action raises an allow only when the model score is
    high, refines the category of a flag, and always sets the severity.
    """
    acts = top["action"].isNotNull() & (top["action"] != "allow")
    raised = acts & (decision["action"] == "allow") & (model > 0.75)
    refined = raised | (acts & (decision["action"] != "allow"))
    return F.struct(
        F.when(raised, top["action"]).otherwise(decision["action"]).alias("action"),
        F.when(refined, top["category"]).otherwise(decision["category"]).alias("category"),
        decision["intent"].alias("intent"),
        F.when(acts, top["severity"]).otherwise(decision["severity"]).alias("severity"),
    )


def build_rule_index(rules: DataFrame, embedder=None) -> DataFrame:
    """The index table of the rules: id, document, metadata and embedding.

    ``embedder`` maps a column of texts to an ``array<float>`` column (a pandas
    UDF over a model, say); without one, the rules' own embedding is kept.
    """
    document = rule_embedding_text("description", "examples")
    vector = embedder(document) if embedder is not None else F.col("embedding")
    return rules.select(
        "id", document.alias("document"), "description", "action", "category", "severity",
        F.to_json("examples").alias("examples"), vector.alias("embedding"),
    )
