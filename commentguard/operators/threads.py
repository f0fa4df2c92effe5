"""Comment threads given as rows with a parent: order and depth without walking a thread in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from commentguard.operators.ranks import ordered_ranks, salted_join
from commentguard.plans.shared import discard, written


def order_threads(df: DataFrame, thread: str, comment: str, parent: str, order: str) -> DataFrame:
    """Add ``position`` (from 0, parents first) and ``depth`` (from 0) within the thread.

    Siblings follow each other by the numeric column ``order`` (null first),
    then by ``comment``.  A comment without a parent, or with one that the
    thread does not hold, opens a tree of its own; trees follow each other like
    siblings.  Comments that only hang on a ring of each other get null, as none
    of them is the first, and so do rows without a comment id.  Rows that repeat
    a comment of a thread share its place, that of the smallest (order, parent).
    Null threads form one thread.  The two columns replace columns of their names.

    Every comment is entered and left once on a walk around its tree.  The event
    before each is known from the parent, the sibling before or the last child,
    so the walk is a linked list of rows.  Pointer jumping sums it up: each
    round, an event adds what the one it points to has summed, and points where
    that one points.  A thread of n comments takes about log2(2 n) rounds,
    whether it is deep or wide, and spreads over all tasks, as no two events
    point to the same one.
    """
    own = F.struct(F.col(thread).alias("t"), F.col(comment).alias("c"))
    first = df.where(F.col(comment).isNotNull()).groupBy(own.alias("id")).agg(
        F.min(F.struct(F.col(order).alias("at"), F.col(parent).alias("up"))).alias("_first")
    )
    above = F.struct(F.col("id.t").alias("t"), F.col("_first.up").alias("c"))
    named = written(first.select("id", above.alias("above"), F.col("_first.at").alias("at")), "thread-comments")

    # One row for each parent that is named but not there, however many replies it has.
    gone = named.where("above.c is not null").select("above").distinct()
    gone = gone.join(named.select(F.col("id").alias("above")), "above", "left_anti").withColumn("_gone", F.lit(True))
    placed = salted_join(named, gone, "above", ["id"], "left")
    nobody = F.struct(F.col("id.t").alias("t"), F.lit(None).cast(df.schema[parent].dataType).alias("c"))
    placed = placed.withColumn("above", F.when(F.col("_gone"), nobody).otherwise(F.col("above"))).drop("_gone")
    ranks = written(ordered_ranks(written(placed, "thread-parents"), ["above"], "at", ties=["id"]), "thread-ranks")

    before = ranks.select("above", (F.col("_rank") + 1).alias("_rank"), F.col("id").alias("sibling"))
    last = ranks.where("_rank = _group_size and above.c is not null").select(F.col("above").alias("id"), F.col("id").alias("child"))
    around = ranks.join(before, ["above", "_rank"], "left").join(last, "id", "left")

    def event(of: str, out: bool):
        return F.struct(F.col(of).alias("id"), F.lit(out).alias("out"))

    to_enter = F.when(F.col("sibling").isNotNull(), event("sibling", True)).when(F.col("above.c").isNotNull(), event("above", False))
    to_leave = F.when(F.col("child").isNotNull(), event("child", True)).otherwise(event("id", False))
    one = F.lit(1).cast("long")
    events = around.select(F.inline(F.array(
        F.struct(event("id", False).alias("e"), to_enter.alias("to"), one.alias("entered"), one.alias("open")),
        F.struct(event("id", True).alias("e"), to_leave.alias("to"), (one - 1).alias("entered"), (-one).alias("open")),
    )))
    walking = written(events, "thread-events")
    largest = named.groupBy("id.t").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    done: list[DataFrame] = []
    # A ring never ends: what still walks after the rounds of the largest thread is on one.
    for _ in range((2 * largest).bit_length() + 1):
        done.append(walking.where("to is null"))
        rest = walking.where("to is not null")
        if rest.isEmpty():
            break
        known = reduce(DataFrame.union, [*done, rest]).select(
            F.col("e").alias("to"), F.col("to").alias("_to"), F.col("entered").alias("_entered"), F.col("open").alias("_open")
        )
        walking = written(rest.join(known, "to").select(
            "e", F.col("_to").alias("to"), (F.col("entered") + F.col("_entered")).alias("entered"), (F.col("open") + F.col("_open")).alias("open")
        ), "thread-events")
    places = reduce(DataFrame.union, done).where("not e.out").select(
        F.col("e.id").alias("_id"), (F.col("entered") - 1).alias("position"), (F.col("open") - 1).alias("depth")
    )
    discard(named, ranks)
    kept = df.drop("position", "depth").withColumn("_id", own)
    return kept.join(written(places, "thread-places"), "_id", "left").drop("_id")
