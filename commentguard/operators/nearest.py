"""Exact nearest neighbours in a rule table of any size: pivots prune, blocks are compared as matrices."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, FloatType

from commentguard.operators.ranks import salted_join
from commentguard.plans.shared import written

#: Rules that stand for the regions of the table; these alone reach the driver.
PIVOTS = 64
#: Rules and queries that meet as one row each.  A region of fewer rules is one block, so up to
#: ``PIVOTS`` times as many rules a query is sent at most once for each pivot, and the volume grows with the table.
RULE_BLOCK, QUERY_BLOCK = 16_384, 1_024
#: Distances of one matrix product.
CELLS = 4_194_304
#: Tasks over which the queries that need one block of rules spread at most.
SALTS = 8
PAYLOAD = ("id", "action", "category", "severity")


def _lengths(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The distance of each vector from each pivot."""
    squares = (vectors**2).sum(1)[:, None] + (pivots**2).sum(1) - 2 * vectors @ pivots.T
    return np.sqrt(np.maximum(squares, 0))


def _slack(vectors: np.ndarray, others: np.ndarray) -> float:
    """More than what rounding can change a distance by."""
    most = max((np.abs(x).max(initial=0) for x in (vectors, others)))
    return 1e-6 * (1 + most * np.sqrt(max(1, vectors.shape[1])))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def exact_distances(query: np.ndarray, rules: np.ndarray) -> np.ndarray:
    """Squared distances, added up in the order of the dimensions as the expression form does."""
    return np.add.accumulate((query - rules) ** 2, axis=1)[:, -1] if rules.shape[1] else np.zeros(len(rules))


def nearest_rules(queries: DataFrame, rules: DataFrame, k: int, max_distance: float, key: str) -> DataFrame:
    """(key, rank, distance, id, action, category, severity) of each query's k nearest rules within ``max_distance``.

    ``queries`` has ``key`` and ``embedding``; ``rules`` id, action, category,
    severity and embedding.  Distances are squared L2; equal ones are ranked by
    id and so on.  Rows whose embedding is null or of another length than the
    rules' have no neighbours.

    A few rules are pivots, and each rule belongs to the nearest one's region,
    of which the least and the greatest distance from the pivot are known.  A
    query's k nearest lie no farther than its k-th nearest pivot, so by the
    triangle inequality it only meets the regions that reach into that radius.
    Queries and rules meet in blocks, one matrix product each; its candidates
    are measured again exactly, and the best k of all blocks remain, cut before
    and after the shuffle.
    """
    vectors = rules.select(*PAYLOAD, F.col("embedding").cast("array<double>").alias("embedding")).where("embedding is not null")
    chosen = vectors.orderBy(F.xxhash64("id"), "id").select("embedding").limit(PIVOTS).collect()
    schema = f"key {queries.schema[key].dataType.simpleString()}, distance double, id string, action string, category string, severity string"
    if not chosen or k < 1:
        empty = queries.sparkSession.createDataFrame([], schema).withColumn("rank", F.lit(1))
        return empty.select(F.col("key").alias(key), "rank", "distance", *PAYLOAD)
    width = len(chosen[0][0])
    pivots = np.array([r[0] for r in chosen if len(r[0]) == width])
    vectors = vectors.where(F.size("embedding") == width)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = _lengths(_matrix(batch.column("embedding")), pivots) if batch.num_rows else np.empty((0, len(pivots)))
            regions = lengths.argmin(1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(regions, pa.int32()), pa.array(lengths[np.arange(len(regions)), regions])], [*batch.schema.names, "region", "away"]
            )

    types = "id string, action string, category string, severity string, embedding array<double>"
    placed = written(vectors.mapInArrow(place, f"{types}, region int, away double"), "rules-placed")
    # One row for each pivot at most.
    rows = {r.region: r for r in placed.groupBy("region").agg(F.count("*").alias("n"), F.min("away").alias("lo"), F.max("away").alias("hi")).collect()}
    regions = sorted(rows)
    blocks = {c: -(-rows[c].n // RULE_BLOCK) for c in regions}
    lo, hi = (np.array([getattr(rows[c], name) for c in regions]) for name in ("lo", "hi"))
    first = dict(zip(regions, np.cumsum([0, *[blocks[c] for c in regions]]).tolist(), strict=False))
    table = F.array(*[F.struct(F.lit(first.get(c, 0)).alias("first"), F.lit(blocks.get(c, 1)).alias("n")) for c in range(len(pivots))])
    own = F.get(table, F.col("region"))
    number = own["first"] + F.pmod(F.xxhash64("id"), own["n"])
    grouped = placed.withColumn("block", number.cast("long")).groupBy("block", "region").agg(F.collect_list(F.struct(*PAYLOAD, "embedding")).alias("r"))
    grouped = grouped.select("block", "region", *[F.col(f"r.{c}").alias(f"r_{c}") for c in PAYLOAD], F.flatten("r.embedding").alias("r_values"))

    # Numbers given in single precision travel so.
    given = queries.schema["embedding"].dataType
    number_kind = np.float32 if isinstance(given, ArrayType) and isinstance(given.elementType, FloatType) else np.float64
    limit = np.sqrt(max_distance) if max_distance >= 0 else -1.0

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            vectors = _matrix(batch.column("embedding"))
            lengths = _lengths(vectors, pivots) if len(vectors) else np.empty((0, len(pivots)))
            radius = np.full(len(vectors), limit)
            if k <= len(pivots) and len(vectors):
                radius = np.minimum(radius, np.partition(lengths, k - 1, axis=1)[:, k - 1])
            radius = radius + _slack(vectors, pivots)
            to_region = lengths[:, regions]
            meets = np.maximum(to_region - hi, lo - to_region) <= radius[:, None]
            order = np.argsort(lengths.argmin(1), kind="stable") if len(vectors) else np.empty(0, int)
            for start in range(0, len(order), QUERY_BLOCK):
                some = order[start : start + QUERY_BLOCK]
                needed = [b for c in np.flatnonzero(meets[some].any(0)).tolist() for b in range(first[regions[c]], first[regions[c]] + blocks[regions[c]])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part + count], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), batch.column("key").take(pa.array(some))),
                     pa.array([vectors[some].astype(number_kind).tobytes()], pa.binary()), pa.array([radius[some].tobytes()], pa.binary()), pa.array([needed], pa.list_(pa.int64()))],
                    ["query_block", "keys", "vectors", "radius", "needed"],
                )
                count += 1

    kind = queries.schema[key].dataType.simpleString()
    asked = queries.select(F.col(key).alias("key"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.size("embedding") == width)
    asked = asked.mapInArrow(gather, f"query_block long, keys array<{kind}>, vectors binary, radius binary, needed array<long>")
    asked = written(asked, "query-blocks").select("query_block", "keys", "vectors", "radius", F.explode("needed").alias("block"))
    met = salted_join(asked, grouped, "block", ["query_block"], salts=SALTS)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                one = {c: batch.column(c)[n] for c in batch.schema.names}
                vectors = np.frombuffer(one["vectors"].as_py(), number_kind).astype(np.float64).reshape(-1, width)
                values = one["r_values"].values.to_numpy(zero_copy_only=False).reshape(-1, width)
                radius, c = np.frombuffer(one["radius"].as_py(), np.float64), one["region"].as_py()
                away, edge = _lengths(vectors, pivots[c : c + 1])[:, 0], rows[c]
                meets = np.flatnonzero(np.maximum(away - edge.hi, edge.lo - away) <= radius)
                queries, places, distances = [], [], []
                stripe = max(1, CELLS // max(1, len(values)))
                for active in (meets[at : at + stripe] for at in range(0, len(meets), stripe)):
                    squares = (vectors[active] ** 2).sum(1)[:, None] + (values**2).sum(1) - 2 * vectors[active] @ values.T
                    slack = _slack(vectors, values) * (1 + np.abs(squares).max(initial=0)) ** 0.5
                    bound = (radius[active] ** 2 + slack)[:, None]
                    if k < len(values):
                        bound = np.minimum(bound, np.partition(squares, k - 1, axis=1)[:, k - 1 : k] + slack)
                    near, which = np.nonzero(squares <= bound)
                    for q in np.unique(near).tolist():
                        spots = which[near == q]
                        exact = exact_distances(vectors[active[q]], values[spots])
                        inside = exact <= max_distance
                        queries += [active[q]] * int(inside.sum())
                        places += spots[inside].tolist()
                        distances += exact[inside].tolist()
                taken = pa.array(places, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [one["keys"].values.take(pa.array(queries, pa.int64())), pa.array(distances, pa.float64()), *[one[f"r_{p}"].values.take(taken) for p in PAYLOAD]],
                    ["key", "distance", *PAYLOAD],
                )

    found = met.mapInArrow(measure, schema)
    order = Window.partitionBy("key").orderBy("distance", *PAYLOAD)
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select(F.col("key").alias(key), "rank", "distance", *PAYLOAD)
