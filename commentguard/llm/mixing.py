"""Mixing sources to target weights: Sainte-Laguë quotas of equal-token blocks, picked by a seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from commentguard.plans.shared import written

WORD = r"[^\x20\x09-\x0D]+"
#: Words of a block at most; small inputs get smaller ones, so that quotas stay fine.
BLOCK_WORDS = 1024
#: Words of a shard, and shards of a source at most.
SHARD_WORDS, MAX_SHARDS = 200_000, 4096
#: How often a word may be taken.
MAX_REPEATS = 3
#: Rows of a table that is sent to all executors; a larger one is joined by a shuffle.
BROADCAST_ROWS = 500_000


def sainte_lague(df: DataFrame, group: list[str], order: str, weight: str, seats: str) -> DataFrame:
    """Add ``quota``: the group's ``seats`` shared out by the highest quotients weight / (2k + 1).

    ``order`` breaks ties.  A row is certain of the seats that it has at a
    divisor under which the group cannot reach its total, and cannot pass those
    at one under which it must; only the few quotients between are ranked.
    Weights of 0 get no seats; a group without weight gives out none.
    """
    whole = Window.partitionBy(*group)
    n, total = F.count("*").over(whole), F.sum(weight).over(whole)
    share = F.when(F.col(weight) > 0, F.col(weight) / total).otherwise(0.0)
    sure = F.floor(share * F.greatest(F.col(seats) - n / 2, F.lit(0)) + 0.5)
    most = F.when(share > 0, F.ceil(share * (F.col(seats) + n / 2) + 0.5)).otherwise(0)
    bounds = df.withColumns({"_sure": sure, "_most": most})
    bounds = bounds.withColumn("_left", F.col(seats) - F.sum("_sure").over(whole))
    open_seats = bounds.where("_most > _sure").select(
        *group, order, weight, "_left", F.explode(F.sequence("_sure", F.col("_most") - 1)).alias("_k")
    )
    ranks = Window.partitionBy(*group).orderBy((F.col(weight) / (2 * F.col("_k") + 1)).desc(), order)
    won = open_seats.withColumn("_rank", F.row_number().over(ranks)).where("_rank <= _left")
    won = won.groupBy(*group, order).agg(F.count("*").alias("_won"))
    return bounds.join(won, [*group, order], "left").select(
        *df.columns, (F.col("_sure") + F.coalesce("_won", F.lit(0))).cast("long").alias("quota")
    )


def source_targets(sources: DataFrame) -> DataFrame:
    """Add ``target`` to (source_no, source_size, weight): all sizes shared by weight.

    A target stops at three times its source's size, and the excess goes to
    the others by weight, until none is above.  In the order of size by weight
    the capped sources come first, so running sums find the level of the rest.
    """
    cap, everything = MAX_REPEATS * F.col("source_size"), Window.partitionBy("_all")
    ratio = F.when(F.col("weight") > 0, cap / F.col("weight")).otherwise(F.lit(float("inf")))
    by_ratio = everything.orderBy("_ratio", "source_no")
    before = F.coalesce(F.sum(cap).over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    level = F.try_divide(F.sum("source_size").over(everything) - before, rest)
    levels = sources.withColumn("_all", F.lit(1)).withColumn("_ratio", ratio).withColumn("_level", level)
    reached = F.min(F.when(F.col("_ratio") > F.col("_level"), F.struct("_ratio", "source_no", "_level"))).over(everything)
    target = F.least(cap.cast("double"), F.coalesce(reached["_level"] * F.col("weight"), cap))
    return levels.withColumn("target", target).select(*sources.columns, "target")


def mix_sources(docs: DataFrame, weight: Column, seed: int = 42) -> DataFrame:
    """How many words of each document a mixture of the sources takes.

    ``weight`` is an expression over ``place``, the number of a source from 1
    by code point, null last.  A source's target is its weight's share of all
    words, at most three times its own.  Blocks of equal numbers of words are
    shared out to sources by the targets and then to each source's shards, both
    by Sainte-Laguë; a shard holds its documents in a seeded order, and its
    quota goes once or more to every block and once more to those that a seeded
    order puts first.

    Returns doc_id, source, size, source_size, target and taken (words taken,
    repeats counted, at most three times the size) for each row.  A null or
    empty text has size 0 and is not taken; a null source is one of its own.
    The same rows and seed give the same result.
    """
    sized = written(
        docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")),
        "mix-sizes",
    )
    by_name = Window.partitionBy(F.lit(1)).orderBy(F.col("source").asc_nulls_last())
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("place", F.row_number().over(by_name))
    sources = sources.select("source", "source_size", F.col("place").alias("source_no"), weight.alias("weight"))
    sources = source_targets(written(sources, "mix-sources"))
    whole = Window.partitionBy(F.lit(1))
    words, n = F.sum("source_size").over(whole), F.count("*").over(whole)
    block = F.least(F.greatest(F.floor(words / (1000 * n)), F.lit(1)), F.lit(BLOCK_WORDS)).cast("long")
    sources = sources.withColumn("block", block).withColumn("seats", F.round(words / block).cast("long"))
    shards = F.least(F.greatest(F.ceil(F.col("source_size") / SHARD_WORDS), F.lit(1)), F.lit(MAX_SHARDS))
    sources = sources.withColumn("_all", F.lit(1)).withColumn("shards", shards.cast("long"))
    sources = written(sainte_lague(sources, ["_all"], "source_no", "target", "seats").withColumnRenamed("quota", "source_quota"), "mix-targets")
    named = F.broadcast(sources) if sources.count() <= BROADCAST_ROWS else sources
    named = named.select(F.col("source").alias("_source"), "source_size", "source_no", "target", "block", "shards", "source_quota")

    seeded = F.xxhash64(F.lit(seed), "doc_id", "size")
    rows = sized.join(named, F.col("source").eqNullSafe(F.col("_source"))).withColumn("shard", F.pmod(seeded, "shards"))
    stream = Window.partitionBy("source_no", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id", "size"), "doc_id", "size")
    rows = rows.withColumn("end", F.sum("size").over(stream.rowsBetween(Window.unboundedPreceding, 0)))
    rows = written(rows.withColumn("start", F.col("end") - F.col("size")).drop("_source", "shards"), "mix-rows")

    totals = rows.groupBy("source_no", "shard", "block", "source_quota").agg(F.sum("size").alias("words"))
    quotas = sainte_lague(totals, ["source_no"], "shard", "words", "source_quota").where("words > 0")
    quotas = quotas.withColumn("n", F.ceil(F.col("words") / F.col("block")))
    blocks = quotas.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("number"))
    shard = Window.partitionBy("source_no", "shard")
    picked = F.row_number().over(shard.orderBy(F.xxhash64(F.lit(seed + 2), "source_no", "shard", "number"), "number"))
    times = F.floor(F.col("quota") / F.col("n")) + (picked <= F.col("quota") % F.col("n")).cast("long")
    blocks = blocks.withColumn("times", F.least(times, F.lit(MAX_REPEATS)))
    length = F.least(F.col("words") - F.col("number") * F.col("block"), F.col("block"))
    earlier = shard.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum(F.col("times") * length).over(earlier), F.lit(0)))
    blocks = written(blocks.select("source_no", "shard", "number", "times", "before"), "mix-blocks")

    # Words taken up to a place in the shard: those of earlier blocks, and of its own up to there.
    for side, place in (("start", F.col("start")), ("end", F.col("end") - 1)):
        mine = blocks.select(
            F.col("source_no"), F.col("shard"), F.col("number").alias(f"_{side}"),
            F.col("times").alias(f"{side}_times"), F.col("before").alias(f"{side}_before"),
        )
        number = F.when(F.col("size") > 0, F.floor(place / F.col("block")))
        rows = rows.withColumn(f"_{side}", number).join(mine, ["source_no", "shard", f"_{side}"], "left")
    upto = {s: F.col(f"{s}_before") + F.col(f"{s}_times") * (F.col(s) - F.col(f"_{s}") * F.col("block")) for s in ("start", "end")}
    taken = F.coalesce(upto["end"] - upto["start"], F.lit(0)).cast("long")
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))
