"""Connected components of an edge table by contraction in tasks and pointer jumping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame, Observation, functions as F

from ..sources.scratch import discard, materialize

#: Edges that a task contracts at once, and edges of a round's table that a task gets.
HELD = 1 << 20
ROWS_A_TASK = 100_000
LEAST_TASKS = 8


def least_of_parts(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least place of the component of each of n places, for edges between places a and b."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return label
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not (label == (up := label[label])).all():
            label = up


Nodes = np.ndarray | pa.Array


def _joined(parts: list[Nodes]) -> Nodes:
    return np.concatenate(parts) if isinstance(parts[0], np.ndarray) else pa.concat_arrays(parts)


def _coded(nodes: Nodes) -> tuple[Nodes, np.ndarray]:
    """The different nodes in order, and the place of each node among them."""
    if isinstance(nodes, np.ndarray):
        return np.unique(nodes, return_inverse=True)
    coded = nodes.dictionary_encode()
    order = pa.compute.sort_indices(coded.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    return coded.dictionary.take(order), rank[coded.indices.to_numpy()]


def stars(u: Nodes, v: Nodes) -> tuple[Nodes, Nodes]:
    """Each node that isn't the least of its component, with that least node; a node that has
    self edges only with itself."""
    nodes, place = _coded(_joined([u, v]))
    label = least_of_parts(place[: len(u)], place[len(u) :], len(nodes))
    told = np.flatnonzero((label != np.arange(len(nodes))) | (np.bincount(label, minlength=len(nodes)) == 1))
    if isinstance(nodes, np.ndarray):
        return nodes[told], nodes[label[told]]
    return nodes.take(pa.array(told)), nodes.take(pa.array(label[told]))


def star_batches(found: Iterator[tuple[Nodes, Nodes]]) -> Iterator[pa.RecordBatch]:
    """Edges, array by array, as stars of up to ``HELD`` edges at once."""
    held: list[tuple[Nodes, Nodes]] = []
    size = 0

    def shrunk() -> tuple[Nodes, Nodes]:
        return stars(_joined([u for u, _ in held]), _joined([v for _, v in held]))

    def batch(u: Nodes, v: Nodes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in (u, v)], ["u", "v"])

    for u, v in found:
        held.append((u, v))
        size += len(u)
        if size >= HELD:
            u, v = shrunk()
            if len(u) > HELD // 2:
                yield batch(u, v)
                u, v = u[:0], v[:0]
            held, size = [(u, v)], len(u)
    if size:
        yield batch(*shrunk())


def contracted(edges: DataFrame) -> DataFrame:
    """The edges ``u, v`` of each task as stars below the least node of each component there."""
    kind = edges.schema["u"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = lambda x: x.to_numpy() if pa.types.is_integer(x.type) else x
        return star_batches((plain(b.column(0)), plain(b.column(1))) for b in batches)

    return edges.mapInArrow(run, f"u {kind}, v {kind}")


def connected_components(edges: DataFrame, left: str = "u", right: str = "v") -> DataFrame:
    """``node, component`` for every node with an edge; component is its least node.

    Every task first reduces its edges to stars, so a node, a hub too, has one edge per task at
    most when edges are dealt by their larger end. In a round the parents of a node meet
    and are joined below the least of them, then every parent is replaced with its own parent
    by a sort-merge join that adaptive execution can split where many nodes share one. Rounds
    end when every parent is a root. Each is written to the shared folder, so lineage stays
    one round long. Edges that are null on a side are left out; a self edge is a component of
    its own. An empty table gives no row.
    """
    pairs = materialize(edges.select(F.col(left).alias("u"), F.col(right).alias("v")).dropna(), "pairs")
    now, rows, spent = contracted(pairs.where("u <> v")), pairs.count(), []
    while True:
        told, tasks = Observation(), max(LEAST_TASKS, -(-rows // ROWS_A_TASK))
        met = materialize(contracted(now.repartition("u").coalesce(tasks)), "met")
        parents = met.groupBy("u").agg(F.min("v").alias("up")).select(F.col("u").alias("node"), "up")
        jumped = met.join(parents.hint("merge"), F.col("v") == F.col("node"), "left").select("u", "v", F.coalesce("up", "v").alias("up"))
        jumped = jumped.observe(told, F.count("*").alias("n"), F.count_if(F.col("up") != F.col("v")).alias("moved"))
        now = materialize(contracted(jumped.select("u", F.col("up").alias("v")).coalesce(tasks)), "jumped")
        discard(met, *spent)
        spent = [now]
        rows = told.get["n"]
        if not told.get["moved"] and now.groupBy("u").agg(F.min("v").alias("a"), F.max("v").alias("b")).where("a < b").isEmpty():
            break
    below = now.distinct()
    nodes = below.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = below.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    loops = pairs.where("u = v").select(F.col("u").alias("node")).distinct()
    alone = loops.join(nodes.unionByName(roots), "node", "left_anti").select("node", F.col("node").alias("component"))
    return nodes.unionByName(roots).unionByName(alone)
