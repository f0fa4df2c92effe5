"""Operational metrics of a moderation service, over its decision log."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from commentguard import fixed_values as fv
from commentguard.functions import text as tx
from commentguard.plans.shared import written


def decision_counts(decided: DataFrame) -> DataFrame:
    return decided.groupBy(
        F.col("predicted_action").alias("action"), F.col("predicted_category").alias("category")
    ).agg(F.count("*").alias("n"))


def action_summary(decided: DataFrame) -> DataFrame:
    return decided.groupBy("predicted_action").agg(F.count("*").alias("n"))


def error_counts(decided: DataFrame) -> DataFrame:
    """Requests and failures, by the stage that failed."""
    stage = F.regexp_extract("reason", r"^Pipeline failed at (\w+)", 1)
    failed = F.when(F.col("predicted_category") == "pipeline_error", stage).otherwise(F.lit("none"))
    return decided.groupBy(failed.alias("error_type")).agg(F.count("*").alias("n"))


def latency_histogram(df: DataFrame, seconds: str = "latency_s") -> DataFrame:
    """Cumulative (le, n) buckets, +Inf last; all bounds in one pass."""
    bounds = [*fv.LATENCY_BUCKETS, float("inf")]
    names = [str(b) if b != float("inf") else "+Inf" for b in bounds]
    counted = df.agg(*[
        F.count_if(F.col(seconds) <= F.lit(b)).alias(f"b{i}") for i, b in enumerate(bounds)
    ])
    rows = F.array(*[F.struct(F.lit(n).alias("le"), F.col(f"b{i}").alias("n")) for i, n in enumerate(names)])
    return counted.select(F.inline(rows))


def exact_percentiles(df: DataFrame, column: str, points: list[float]) -> DataFrame:
    """One row of the interpolated percentiles q0, q1, ... of a numeric column.

    Values are counted, the counts of value ranges give each range's first rank,
    and only the two values around each wanted rank are brought together, so no
    task holds all values.
    """
    counts = written(df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("n")), "counts")
    cuts = sorted(set(counts.approxQuantile("v", [i / 64 for i in range(1, 64)], 0.01)))
    stretch = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("v"))) if cuts else F.lit(0)
    counts = counts.withColumn("stretch", stretch)
    sums = counts.groupBy("stretch").agg(F.sum("n").alias("m"))  # at most 64 rows
    in_order = Window.partitionBy(F.lit(1)).orderBy("stretch")
    firsts = sums.select(
        "stretch", (F.sum("m").over(in_order) - F.col("m")).alias("before"), F.sum("m").over(Window.partitionBy(F.lit(1))).alias("total")
    )
    inside = Window.partitionBy("stretch").orderBy("v")
    ranks = counts.join(F.broadcast(firsts), "stretch").withColumn("last", F.col("before") + F.sum("n").over(inside) - 1)
    ranks = ranks.withColumn("first", F.col("last") - F.col("n") + 1)

    def value_at(rank: Column) -> Column:
        return F.max(F.when((F.col("first") <= rank) & (rank <= F.col("last")), F.col("v")))

    wanted, shares = [], []
    for i, p in enumerate(points):
        place = (F.col("total") - 1) * F.lit(p)
        wanted += [value_at(F.floor(place)).alias(f"lo{i}"), value_at(F.ceil(place)).alias(f"hi{i}"), F.max(place - F.floor(place)).alias(f"w{i}")]
        shares.append((F.col(f"lo{i}") * (1 - F.col(f"w{i}")) + F.col(f"hi{i}") * F.col(f"w{i}")).alias(f"q{i}"))
    return ranks.agg(*wanted).select(*shares)


#: Size of a quantile sketch, and by how much of all values the rank of its quantiles may be off (99 % of the time).
SKETCH_K, SKETCH_ERROR = 400, 0.01


def latency_sketches(df: DataFrame, ts: str = "ts", seconds: str = "latency_s", width: str = "1 hour") -> DataFrame:
    """start, n and a quantile sketch of the latencies of each span: a row of bounded size, whatever the requests."""
    timed = df.where(F.col(seconds).isNotNull()).groupBy(F.window(ts, width).alias("w"))
    sketch = F.kll_sketch_agg_double(F.col(seconds).cast("double"), SKETCH_K)
    return timed.agg(F.count("*").alias("n"), sketch.alias("sketch")).select("w.start", "n", "sketch")


def merged_latencies(sketches: DataFrame, width: str = "1 day", points: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """start, n and the quantiles of longer spans, from the sketches alone: p50, p95, p99 for the usual points."""
    merged = sketches.groupBy(F.window("start", width).alias("w")).agg(
        F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", SKETCH_K).alias("sketch")
    )
    found = [F.kll_sketch_get_quantile_double("sketch", F.lit(p)).alias(f"p{round(100 * p)}") for p in points]
    return merged.select("w.start", "n", *found)


def _beside(one: DataFrame, other: DataFrame) -> DataFrame:
    """Two tables of one row each as one row."""
    return one.withColumn("_row", F.lit(1)).join(other.withColumn("_row", F.lit(1)), "_row").drop("_row")


def ops_summary(df: DataFrame, seconds: str = "latency_s", exact: bool = False, cache: DataFrame | None = None) -> DataFrame:
    """Latency percentiles, action shares and the rate of given model scores.

    The percentiles come from a mergeable sketch of fixed size unless ``exact``
    is asked for.  ``cache`` is the table of ``cache_hit_rate``; with it, the
    summary has ``cache_hit_rate`` too.
    """
    points = [0.5, 0.95, 0.99]

    def share(test: Column, name: str) -> Column:
        return F.avg(test.cast("double")).alias(name)

    counted = df.agg(
        F.count("*").alias("n_requests"),
        *([] if exact else [F.percentile_approx(seconds, points, 10_000).alias("_q")]),
        *[share(F.col("predicted_action") == a, f"{a}_rate") for a in fv.ACTIONS],
        share(F.col("model_called"), "model_call_rate"),
    )
    quantiles = [F.get("_q", F.lit(i)) for i in range(3)]
    if exact:
        counted = _beside(counted, exact_percentiles(df, seconds, points))
        quantiles = [F.col(f"q{i}") for i in range(3)]
    extra = []
    if cache is not None:
        counted = _beside(counted, cache_summary(cache).select(F.col("hit_rate").alias("cache_hit_rate")))
        extra = ["cache_hit_rate"]
    return counted.select(
        "n_requests", *[q.alias(n) for q, n in zip(quantiles, ["p50", "p95", "p99"], strict=True)],
        *[f"{a}_rate" for a in fv.ACTIONS], "model_call_rate", *extra,
    )


def cache_hit_rate(
    df: DataFrame, ts: str = "ts", ttl_seconds: int = fv.CACHE_TTL_SECONDS
) -> DataFrame:
    """Hits and misses per cache key (text and context) with a time to live that
    counts from the write.

    Whether a request hits depends on the last miss of its key, so a key is
    followed over time.  Times count in whole seconds and equal ones combine
    before the shuffle.  A gap as long as the time to live forgets all before
    it, so each key is cut there; inside a stretch there is at most one write in
    each span of the time to live, so its seconds are first gathered by span and
    the fold goes over spans, each of which holds at most ``ttl_seconds`` values.
    """
    per_second = df.groupBy(
        tx.cache_key("text", "context_type").alias("cache_key"),
        F.unix_timestamp(F.col(ts)).alias("second"),
    ).agg(F.count("*").alias("n"))
    by_time = Window.partitionBy("cache_key").orderBy("second")
    gap = F.col("second") - F.lag("second").over(by_time)
    fresh = (gap.isNull() | (gap >= ttl_seconds)).cast("int")
    cut = per_second.withColumn("_fresh", fresh).withColumn("stretch", F.sum("_fresh").over(by_time))
    span = F.floor(F.col("second") / max(ttl_seconds, 1))
    spans = cut.groupBy("cache_key", "stretch", span.alias("span")).agg(
        F.sum("n").alias("n"), F.sort_array(F.collect_list("second")).alias("seconds")
    )
    # In a span at most one write happens: at the first second from the time when the last one has run out.
    start = F.struct(F.lit(None).cast("long").alias("written"), F.lit(0).cast("long").alias("misses"))

    def visit(state: Column, s: Column) -> Column:
        due = F.filter(s["seconds"], lambda at: state["written"].isNull() | (at >= state["written"] + ttl_seconds))
        at = F.get(due, F.lit(0))
        return F.struct(F.coalesce(at, state["written"]).alias("written"), (state["misses"] + at.isNotNull().cast("long")).alias("misses"))

    folded = spans.groupBy("cache_key", "stretch").agg(
        F.sum("n").alias("requests"),
        F.aggregate(F.sort_array(F.collect_list(F.struct("span", "seconds"))), start, visit)["misses"].alias("misses"),
    )
    per_key = folded.groupBy("cache_key").agg(F.sum("requests").alias("requests"), F.sum("misses").alias("misses"))
    return per_key.select("cache_key", "requests", "misses", (F.col("requests") - F.col("misses")).alias("hits"))


def cache_summary(per_key: DataFrame) -> DataFrame:
    return per_key.agg(
        F.sum("requests").alias("requests"), F.sum("misses").alias("misses"), F.sum("hits").alias("hits"),
        (F.sum("hits") / F.sum("requests")).alias("hit_rate"),
    )


def windowed_decisions(
    decided: DataFrame, ts: str = "ts", width: str = "1 minute", slide: str | None = None,
    watermark: str | None = None,
) -> DataFrame:
    """Decisions and latency per time window; on a stream, give a watermark."""
    if watermark is not None:
        decided = decided.withWatermark(ts, watermark)
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    return (
        decided.groupBy(window.alias("w"), "predicted_action")
        .agg(
            F.count("*").alias("n"),
            F.avg("latency_s").alias("avg_latency_s"),
            F.max("latency_s").alias("max_latency_s"),
        )
        .select("w.start", "w.end", "predicted_action", "n", "avg_latency_s", "max_latency_s")
    )


def session_decisions(
    decided: DataFrame, client: str = "client_id", ts: str = "ts", gap: str = "30 minutes", watermark: str | None = None,
) -> DataFrame:
    """Decisions of each client's sessions, which end when nothing comes for ``gap``; on a stream, give a watermark.

    ``end`` is the last request's time and the gap.
    """
    if watermark is not None:
        decided = decided.withWatermark(ts, watermark)
    return (
        decided.groupBy(F.session_window(ts, gap).alias("w"), client)
        .agg(
            F.count("*").alias("n"),
            F.count_if(F.col("predicted_action") != "allow").alias("n_flagged"),
            F.max("latency_s").alias("max_latency_s"),
        )
        .select("w.start", "w.end", client, "n", "n_flagged", "max_latency_s")
    )


def rate_limit_report(
    df: DataFrame, client: str = "client_id", ts: str = "ts", limit: int = fv.RATE_LIMIT_SINGLE,
    width: str = "1 minute", watermark: str | None = None,
) -> DataFrame:
    """Clients over the limit in a window, with their request count."""
    if watermark is not None:
        df = df.withWatermark(ts, watermark)
    return (
        df.groupBy(F.window(ts, width).alias("w"), client)
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") > limit)
        .select("w.start", client, "n")
    )


def sliding_rate_report(
    df: DataFrame, client: str = "client_id", ts: str = "ts", key: str = "comment_id", limit: int = fv.RATE_LIMIT_SINGLE,
    seconds: int = 60, slices: int | None = None,
) -> DataFrame:
    """The requests over the limit: those that find ``limit`` or more of their client's in the ``seconds`` before.

    Returns (client, key, ts, n) with n the client's requests in the span that
    ends with this one; requests of one instant count together.  A client's time
    is cut into slices, and each slice also reads the span before it, so that a
    client with a third of all rows spreads over tasks: it is not shorter than
    the span, so a request is read twice at most.
    """
    slices = slices or max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    at = F.unix_micros(F.col(ts).cast("timestamp_ltz"))
    rows = df.where(F.col(ts).isNotNull()).select(client, key, ts, at.alias("_at"))
    lo, hi = rows.agg(F.min("_at"), F.max("_at")).first()
    span = seconds * 1_000_000
    width = max(span, -(-((hi or 0) - (lo or 0) + 1) // slices))
    own = F.floor((F.col("_at") - F.lit(lo or 0)) / width)
    following = F.floor((F.col("_at") + span - 1 - F.lit(lo or 0)) / width)  # the slice that the span behind a request reaches
    cut = rows.withColumn("_own", own).withColumn("_slice", F.explode(F.array_distinct(F.array(own, following))))
    window = Window.partitionBy(client, "_slice").orderBy("_at").rangeBetween(1 - span, 0)
    counted = cut.withColumn("n", F.count("*").over(window)).where((F.col("_own") == F.col("_slice")) & (F.col("n") > limit))
    return counted.select(client, key, ts, "n")
