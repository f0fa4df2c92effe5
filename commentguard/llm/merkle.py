"""Merkle manifest of a data set: hash trees whose parents keep hash states to resume."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from commentguard.plans.shared import discard, written

#: Nodes of a tree that one task holds at once, at most, unless a single run has more.
CHUNK = 1024
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<left:array<string>,right:array<string>>>"
_STEPS = pa.list_(pa.struct([("left", pa.list_(pa.string())), ("right", pa.list_(pa.string()))]))


def framed(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(row: dict[str, Column]) -> Column:
    """The leaf of a row, as hex: its framed fields hashed one after the other."""
    return F.sha2(F.concat(*[framed(row[name]) for name in FIELDS]).cast("binary"), 256)


class Tree:
    """A hash tree over hex digests; each parent keeps its hash state before each child slot.

    Every ``fanout`` consecutive nodes (the last run may be shorter) have one
    parent; the tree is ``levels`` parents deep.
    """

    def __init__(self, leaves: list[bytes], fanout: int, levels: int):
        self.fanout, self.nodes, self.states = fanout, [leaves], []
        for _ in range(levels):
            below, above, states = self.nodes[-1], [], []
            for start in range(0, len(below), fanout):
                state, before = hashlib.sha256(), []
                for child in below[start : start + fanout]:
                    before.append(state.copy())
                    state.update(child)
                states.append(before)
                above.append(state.hexdigest().encode())
            self.nodes.append(above)
            self.states.append(states)

    def siblings(self, place: int) -> list[tuple[list[bytes], list[bytes]]]:
        """For each level upwards the other nodes of the run: those to the left, and those to the right."""
        out = []
        for nodes in self.nodes[:-1]:
            start = place - place % self.fanout
            out.append((nodes[start:place], nodes[place + 1 : start + self.fanout]))
            place //= self.fanout
        return out

    def fold(self, place: int, digest: bytes) -> bytes:
        """The top if ``digest`` stood at ``place``: the state before its slot goes on with it and its right siblings."""
        for nodes, states in zip(self.nodes, self.states, strict=False):
            parent, slot = divmod(place, self.fanout)
            state = states[parent][slot].copy()
            state.update(digest)
            for right in nodes[place + 1 : (parent + 1) * self.fanout]:
                state.update(right)
            digest, place = state.hexdigest().encode(), parent
        return digest


class Path:
    """The way from a chunk's top to the root: at each level the state before the slot, and what stands right of it."""

    def __init__(self, steps: list[dict]):
        self.siblings = [digest for s in steps for digest in (*s["left"], *s["right"])]
        self.steps = [(hashlib.sha256("".join(s["left"]).encode()), "".join(s["right"]).encode()) for s in steps]

    def fold(self, digest: bytes) -> bytes:
        for before, right in self.steps:
            state = before.copy()
            state.update(digest)
            state.update(right)
            digest = state.hexdigest().encode()
        return digest


def levels_of(size: int, fanout: int, most: int) -> int:
    """Levels from ``size`` nodes up to one, ``most`` at most."""
    levels = 0
    while size > 1 and levels < most:
        size, levels = -(-size // fanout), levels + 1
    return levels


def placed(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``place`` (from 0) in its group by ``order``, and ``size``, the number of the group's rows.

    ``rows`` is a table of ``written``: the places of its rows in the files
    decide between equal ones.  Rows are range-partitioned by (group, order) and
    numbered where they lie, so a group of any size spreads over tasks; counts
    by group and partition give what lies before.
    """
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [group, *order, "_file", "_row"]
    known = rows.withColumns({"_file": F.col("_metadata.file_name"), "_row": F.col("_metadata.row_index")})
    dealt = known.repartitionByRange(partitions, *keys).sortWithinPartitions(*keys).drop("_file", "_row")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            inside = np.empty(batch.num_rows, np.int64)
            for k, value in enumerate(batch.column(group).to_pylist()):
                seen = seen + 1 if last == (value,) else 0
                last, inside[k] = (value,), seen
            parts = np.full(batch.num_rows, part, np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parts), pa.array(inside)], [*batch.schema.names, "_part", "_inside"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    numbered = written(dealt.mapInArrow(number, f"{types}, _part int, _inside long"), "merkle-numbered")
    counts = numbered.groupBy(F.col(group).alias("_group"), F.col("_part").alias("_of")).agg(F.count("*").alias("_n"))
    whole = Window.partitionBy("_group")
    before = F.sum("_n").over(whole.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.withColumns({"_before": F.coalesce(before, F.lit(0)), "size": F.sum("_n").over(whole)})
    same = F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_of"))
    out = numbered.join(counts, same).withColumn("place", F.col("_before") + F.col("_inside"))
    return out.select(*rows.columns, "place", "size")


def chunked(nodes: DataFrame, fanout: int, levels: int, payload: list[str]) -> DataFrame:
    """Chunks of the nodes (group, place, size, digest): group, chunk, size, their nodes' arrays, and the ``top`` above them.

    ``fanout ** levels`` consecutive nodes are a chunk; a tree over several
    chunks is ``levels`` deep in each, whatever the chunk's own number of nodes.
    """
    columns = ["digest", *payload]
    rows = nodes.groupBy("group", F.floor(F.col("place") / fanout**levels).alias("chunk")).agg(
        F.max("size").alias("size"), F.sort_array(F.collect_list(F.struct("place", *columns))).alias("nodes")
    )
    rows = rows.select("group", "chunk", "size", *[F.col(f"nodes.{c}").alias(c) for c in columns])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tops = []
            for size, digests in zip(batch.column("size").to_pylist(), batch.column("digest"), strict=True):
                leaves = [d.encode() for d in digests.as_py()]
                tops.append(Tree(leaves, fanout, levels_of(size, fanout, levels)).nodes[-1][0].decode())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tops, pa.string())], [*batch.schema.names, "top"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return written(rows.mapInArrow(build, f"{types}, top string"), "merkle-chunks")


def grown(nodes: DataFrame, fanout: int, levels: int, payload: list[str]) -> list[DataFrame]:
    """The chunks of each storey of the groups' trees; in the last storey each group has one."""
    width = fanout**levels
    storeys = [chunked(nodes, fanout, levels, payload)]
    while not storeys[-1].where(F.col("size") > width).isEmpty():
        size = F.ceil(F.col("size") / width)
        above = storeys[-1].select("group", F.col("chunk").alias("place"), size.alias("size"), F.col("top").alias("digest"))
        storeys.append(chunked(above, fanout, levels, []))
    return storeys


def each_node(chunks: DataFrame, payload: list[str], carried: list[str], fanout: int, levels: int) -> DataFrame:
    """A row for each node of chunks that have their ``path``: group, place, digest, payload, and its own path to the root."""

    def take_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, places, steps = [], [], []
            columns = [batch.column(c).to_pylist() for c in ("chunk", "size", "digest", "path")]
            for k, (chunk, size, digests, path) in enumerate(zip(*columns, strict=True)):
                tree = Tree([d.encode() for d in digests], fanout, levels_of(size, fanout, levels))
                for place in range(len(digests)):
                    own = [{"left": [x.decode() for x in a], "right": [x.decode() for x in b]} for a, b in tree.siblings(place)]
                    rows.append(k)
                    places.append(chunk * fanout**levels + place)
                    steps.append(own + path)
            own = [batch.column(c).flatten() for c in ("digest", *payload)]
            kept = [batch.column(c).take(pa.array(rows, pa.int64())) for c in ("group", *carried)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(places, pa.int64()), pa.array(steps, _STEPS), *own, *kept], ["place", "path", "digest", *payload, "group", *carried]
            )

    types = [f"`{c}` {chunks.schema[c].dataType.elementType.simpleString()}" for c in ("digest", *payload)]
    types += [f"`{c}` {chunks.schema[c].dataType.simpleString()}" for c in ("group", *carried)]
    return chunks.mapInArrow(take_apart, f"place long, path {_PATH}, {', '.join(types)}")


def with_paths(storeys: list[DataFrame], tops: DataFrame, fanout: int, levels: int) -> DataFrame:
    """The first storey's chunks with ``path``, their steps up to the root, and the further columns of ``tops``.

    ``tops`` has the path of each group from its tree's top on.
    """
    carried = [c for c in tops.columns if c not in ("group", "path")]
    paths = tops.withColumn("place", F.lit(0).cast("long"))
    for depth in range(len(storeys) - 1, -1, -1):
        named = paths.select(F.col("group").alias("_group"), F.col("place").alias("_place"), "path", *carried)
        same = F.col("group").eqNullSafe(F.col("_group")) & (F.col("chunk") == F.col("_place"))
        chunks = storeys[depth].join(named, same).drop("_group", "_place", "top")
        if depth:
            paths = each_node(chunks, [], carried, fanout, levels)
    return chunks


def merkle_manifest(docs: DataFrame, changes: dict[str, Column] | None = None, group: str = "lang", fanout: int = 2) -> DataFrame:
    """A leaf for each row of ``docs``, a tree for each ``group`` over its leaves by doc_id, and one tree over their tops.

    ``changes`` gives values of fields as they are found later.  Returns doc_id,
    leaf, subroot (the top of the group's tree), root, proof (the other nodes of
    each run on the way to the root, level by level, left to right), and
    folded_root: what the root would be if only this row had changed.

    A null value is framed as ``-``; rows with a null ``group`` are a group,
    the first one.  A null doc_id comes first in its group; rows of one doc_id
    stand by their leaf, equal rows take a place each.  A row alone in its
    group is that tree's top; alone in the table, the root, and its proof is
    empty.  Of ``docs`` only the five fields are read.
    """
    levels = 1
    while fanout ** (levels + 1) <= CHUNK:
        levels += 1
    row = {name: F.col(name) for name in FIELDS}
    found = row | (changes or {})
    differs = F.lit(False)
    for name in FIELDS:
        differs = differs | ~found[name].eqNullSafe(row[name])
    leaves = written(
        docs.select(F.col(group).alias("group"), "doc_id", leaf_hash(row).alias("digest"), F.when(differs, leaf_hash(found)).alias("changed")),
        "merkle-leaves",
    )
    low = grown(placed(leaves, "group", ["doc_id", "digest"]), fanout, levels, ["doc_id", "changed"])
    tops = written(low[-1].select(F.lit(0).alias("all"), F.col("group").alias("name"), F.col("top").alias("digest")), "merkle-tops")
    subroots = placed(tops, "all", ["name"]).withColumnRenamed("all", "group")
    high = grown(subroots, fanout, levels, ["name"])
    root = high[-1].select("group", F.col("top").alias("root"), F.expr(f"cast(array() as {_PATH})").alias("path"))
    ends = each_node(with_paths(high, root, fanout, levels), ["name"], ["root"], fanout, levels)
    ends = ends.select(F.col("name").alias("group"), "path", F.col("digest").alias("subroot"), "root")
    chunks = with_paths(low, ends, fanout, levels)

    def leaves_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = {c: batch.column(c)[k].as_py() for c in ("size", "digest", "changed", "path", "subroot", "root")}
                digests, path = [d.encode() for d in one["digest"]], Path(one["path"])
                tree = Tree(digests, fanout, levels_of(one["size"], fanout, levels))
                proofs, folded = [], []
                for place, changed in enumerate(one["changed"]):
                    own = [x.decode() for a, b in tree.siblings(place) for x in (*a, *b)]
                    proofs.append(own + path.siblings)
                    folded.append(path.fold(tree.fold(place, changed.encode() if changed else digests[place])).decode())
                n = len(digests)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[k].values, pa.array(one["digest"], pa.string()), pa.array([one["subroot"]] * n, pa.string()),
                     pa.array([one["root"]] * n, pa.string()), pa.array(proofs, pa.list_(pa.string())), pa.array(folded, pa.string())],
                    ["doc_id", "leaf", "subroot", "root", "proof", "folded_root"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    discard(leaves)
    return chunks.mapInArrow(leaves_of, f"doc_id {kind}, leaf string, subroot string, root string, proof array<string>, folded_root string")
