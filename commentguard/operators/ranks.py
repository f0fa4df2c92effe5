"""Ranks and joins that hold up when one group has a large share of all rows."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

SALTS = 16


def salted_join(
    left: DataFrame, right: DataFrame, on: str, spread_by: list[str], how: str = "inner",
    salts: int = SALTS,
) -> DataFrame:
    """Equi-join where a key may be hot on the left and is unique on the right.

    The right rows are repeated once per salt, so the copies of a hot key on
    the left spread over ``salts`` tasks.
    """
    copies = right.withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<long>"))
    )
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)))
    return salted.join(copies, [on, "_salt"], how).drop("_salt")


def ranked(df: DataFrame, group: list[str], order: list, bucket: Column) -> DataFrame:
    """Add ``_rank`` (from 1) within the group and ``_group_size``.

    ``bucket`` cuts the order into consecutive stretches: it never decreases
    along it.  Ranks are counted inside (group, bucket) and shifted by the size
    of the group's earlier buckets, so no task has to hold a whole group.
    """
    cut = df.withColumn("_bucket", bucket)
    keys = [*group, "_bucket"]
    counts = cut.groupBy(*keys).agg(F.count("*").alias("_n"))
    by_group = Window.partitionBy(*group)
    earlier = by_group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(
        *keys,
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_n").over(by_group).alias("_group_size"),
    )
    inside = Window.partitionBy(*keys).orderBy(*order)
    named = shifts.select(*[F.col(k).alias(f"_of{i}") for i, k in enumerate(keys)], "_before", "_group_size")
    same = [F.col(k).eqNullSafe(F.col(f"_of{i}")) for i, k in enumerate(keys)]  # a NULL group is one too
    return (
        cut.withColumn("_inside", F.row_number().over(inside))
        .join(named, reduce(Column.__and__, same))
        .drop(*[f"_of{i}" for i in range(len(keys))])
        .withColumn("_rank", F.col("_before") + F.col("_inside"))
        .drop("_bucket", "_inside", "_before")
    )


def shuffled_ranks(
    df: DataFrame, group: list[str], key: str, seed: int = 42, prefix: int = 3
) -> DataFrame:
    """Ranks in a random but repeatable order: that of a keyed hash of ``key``.

    The leading hex digits of the hash are the buckets, so their sizes are even.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    df = df.withColumn("_digest", digest)
    return ranked(df, group, ["_digest", key], F.substring("_digest", 1, prefix)).drop("_digest")


def ordered_ranks(
    df: DataFrame, group: list[str], order: str, buckets: int | None = None, ties: list[str] = []
) -> DataFrame:
    """Ranks along a numeric column, cut at its approximate quantiles; ``ties`` order what is equal there.

    One pass over that single column gives the cuts; only those reach the driver.
    There are as many as shuffle partitions, 64 at least.
    """
    buckets = buckets or max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = df.approxQuantile(order, [i / buckets for i in range(1, buckets)], 0.1 / buckets)
    cuts = sorted(set(cuts))
    listed = ", ".join(f"{c!r}D" for c in cuts) or "double('NaN')"
    bucket = F.expr(f"size(filter(array({listed}), c -> c <= double({order})))")
    return ranked(df, group, [order, *ties], bucket)
