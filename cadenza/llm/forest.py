"""Near-duplicate embeddings by a forest of random-projection trees.

Only vectors with the same label are compared, by the cosine in double precision; pairs at
``THRESHOLD`` or above link. Equal vectors are one row with a count from the start.

Each of ``TREES`` trees halves its nodes at the median of a random projection; vectors within
``SPILL`` of the cut go to both sides, so a close pair is parted only by a cut that lies
between the two with more than the overlap to spare; by many trees the chance that it is
parted in all of them vanishes. Trees grow in rounds: a node with more than ``LEAF`` vectors
gets a small subtree fitted to at most ``SAMPLE`` of its vectors (a hash of the id chooses
them) and all its vectors are dealt down that subtree; rounds go on until no node is too
large or its vectors are too alike to part. Such a node is compared in pairs of blocks.

A leaf counts the links of each vector and keeps a forest of edges, not the pairs. A pair
that several leaves hold is counted in the first of them only, which each leaf knows from
the list of leaves that goes with every vector. Components run over the edges.

Nulls: vectors that are null, of norm zero, or hold null, NaN or infinite numbers link with
nothing, nor do vectors of another length or with a null label. A null id is left out of
links. Repeated rows link with each other. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.graph import connected_components
from ..sources.scratch import discard, materialize
from .words import mixed

THRESHOLD = 0.98
TREES = 6
SPILL = 0.02
LEAF = 512
SAMPLE = 2000
DEALT = 20_000
GAIN = 0.9


#: One vector: its values as packed numbers of the table's own precision.
ROWS = "vec_id long, same binary, root long, vec binary"


def _packed(kind: str):
    """Vectors to rows: ``same`` tells label and values (null: links with nothing), ``root``
    label and length."""
    schema = pa.schema([("vec_id", pa.int64()), ("same", pa.binary()), ("root", pa.int64()), ("vec", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, column = batch.columns
            known = np.asarray(ids.is_valid()) & np.asarray(labels.is_valid()) & np.asarray(column.is_valid())
            sizes = np.where(known, column.value_lengths().fill_null(0).to_numpy(), 0)
            column = column.take(pa.array(np.flatnonzero(known)))
            values = column.flatten().to_numpy(zero_copy_only=False) + 0.0  # nulls are NaN, a negative zero is none
            ends = np.cumsum(sizes)
            row = np.repeat(np.arange(len(sizes)), sizes)
            bad = np.bincount(row, weights=~np.isfinite(values), minlength=len(sizes))
            some = np.bincount(row, weights=values != 0, minlength=len(sizes))
            data = values.astype(kind)
            same, roots, vecs = [], [], []
            for k, name in enumerate(labels.to_pylist()):
                if not known[k] or bad[k] or not some[k]:
                    same.append(None)
                    roots.append(None)
                    vecs.append(None)
                    continue
                vec = data[ends[k] - sizes[k] : ends[k]].tobytes()
                head = f"{name}\0{sizes[k]}\0".encode()
                same.append(hashlib.sha256(head + vec).digest())
                roots.append(int.from_bytes(hashlib.sha256(head).digest()[:8], "little", signed=True))
                vecs.append(vec)
            yield pa.RecordBatch.from_arrays([ids, pa.array(same, pa.binary()), pa.array(roots, pa.int64()), pa.array(vecs, pa.binary())], schema=schema)

    return run


def packed_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, str]:
    """A row per vector (see ``ROWS``), and the number format of its values."""
    element = vectors.schema[vec_col].dataType.elementType.simpleString()
    kind = "<f4" if element == "float" else "<f8"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast("array<double>").alias("vec"))
    return rows.mapInArrow(_packed(kind), ROWS), kind


def representatives(rows: DataFrame) -> DataFrame:
    """``same, rep, root, vec, n``: different vectors that can link, by the least id."""
    least = F.min(F.struct("vec_id", "root", "vec")).alias("least")
    rows = rows.where("same is not null").groupBy("same").agg(least, F.count("*").alias("n"))
    return rows.select("same", F.col("least.vec_id").alias("rep"), F.col("least.root").alias("root"), F.col("least.vec").alias("vec"), "n")


def _matrix(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    """Packed vectors of one length as rows of norm 1."""
    if not len(column):
        return np.zeros((0, 1))
    x = np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1).astype(float)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def grow(sample: np.ndarray, share: float, leaf: int, spill: float, rng: np.random.Generator) -> list[tuple[int, np.ndarray, float]]:
    """A subtree fitted to a sample: (place, direction, cut) of its inner nodes.

    Place 1 is the root, 2p and 2p + 1 are the sides of p. share: how many vectors each one of
    the sample stands for. A node whose sides would not shrink by GAIN is left whole.
    """
    out, todo = [], [(1, np.arange(len(sample)))]
    while todo:
        place, rows = todo.pop()
        if len(rows) * share <= leaf or len(rows) < 8 or place >= 1 << 40:
            continue
        best = None
        for _ in range(4):
            way = rng.normal(size=sample.shape[1])
            way /= np.linalg.norm(way)
            x = sample[rows] @ way
            cut = float(np.median(x))
            left, right = rows[x <= cut + spill], rows[x > cut - spill]
            if best is None or max(len(left), len(right)) < best[0]:
                best = (max(len(left), len(right)), way, cut, left, right)
        if best[0] > GAIN * len(rows):
            continue
        out.append((place, best[1], best[2]))
        todo += [(2 * place, best[3]), (2 * place + 1, best[4])]
    return out


def _fit(leaf: int, spill: float, kind: str):
    schema = pa.schema([("tree", pa.int32()), ("node", pa.int64()), ("places", pa.list_(pa.int64())), ("ways", pa.list_(pa.float64())), ("cuts", pa.list_(pa.float64()))])

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        tree, node = key[0].as_py(), key[1].as_py()
        order = np.argsort(table["rep"].to_numpy())
        sample = _matrix(table["vec"], kind)[order]
        share = table["total"][0].as_py() / max(1, len(sample))
        found = grow(sample, share, leaf, spill, np.random.default_rng([tree, node & ((1 << 63) - 1)]))
        return pa.table(
            [[tree], [node], [[f[0] for f in found]], [np.concatenate([f[1] for f in found]).tolist() if found else []], [[f[2] for f in found]]], schema=schema
        )

    return run


def _deal(spill: float, kind: str):
    """Cogroup: vectors of a node and its subtree to vectors of the nodes below."""

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        schema = left.schema.remove(left.schema.get_field_index("salt")).append(pa.field("whole", pa.bool_()))
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        x = _matrix(left["vec"], kind)
        places = right["places"][0].as_py()
        ways = np.array(right["ways"][0].as_py()).reshape(len(places), x.shape[1])
        cuts = right["cuts"][0].as_py()
        at = {p: k for k, p in enumerate(places)}
        todo, rows, ends = [(1, np.arange(len(x)))], [], []
        while todo:
            place, own = todo.pop()
            if place in at and len(own):
                y = x[own] @ ways[at[place]]
                todo += [(2 * place, own[y <= cuts[at[place]] + spill]), (2 * place + 1, own[y > cuts[at[place]] - spill])]
            else:
                rows.append(own)
                ends.append(np.full(len(own), place))
        take, place = np.concatenate(rows), np.concatenate(ends).astype(np.uint64)
        node = (mixed(left["node"].to_numpy()[take].view(np.uint64)) ^ mixed(place)).view(np.int64)
        if not places:
            node = left["node"].to_numpy()[take]
        out = left.drop_columns(["salt"]).take(pa.array(take))
        out = out.set_column(out.schema.get_field_index("node"), "node", pa.array(mixed(node.view(np.uint64)).view(np.int64) if places else node))
        return out.append_column("whole", pa.array(np.full(len(take), not places))).cast(schema)

    return run


def leaves(reps: DataFrame, kind: str, trees: int = TREES, leaf: int = LEAF, spill: float = SPILL, sample: int = SAMPLE) -> tuple[DataFrame, list[DataFrame]]:
    """``tree, node, rep`` for each leaf that a vector lies in, and the written tables it reads.

    Vectors whose label has few of them are one leaf of one tree: all are compared there.
    """
    roots = materialize(reps.groupBy(F.col("root").alias("node")).agg(F.count("*").alias("total")), "roots")
    first = F.lit(0).alias("tree")
    done = reps.join(roots.where(F.col("total") <= leaf), F.col("root") == F.col("node"), "left_semi").select(first, F.col("root").alias("node"), "rep")
    grown = F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")
    now = reps.select(grown, F.col("root").alias("node"), "rep", "vec")
    sizes, written = roots.select(grown, "node", "total"), [roots]
    while True:
        large = sizes.where(F.col("total") > leaf)
        if large.isEmpty():
            return done, written
        salts = F.ceil(F.col("total") / DEALT).cast("int")
        todo = now.join(large, ["tree", "node"]).withColumn("salt", F.pmod(F.xxhash64("rep"), salts.cast("long")).cast("int"))
        chosen = todo.where(F.pmod(F.xxhash64("rep", "tree", "node"), F.lit(1 << 30)) < F.lit(float(sample << 30)) / F.col("total"))
        fitted = materialize(
            chosen.select("tree", "node", "rep", "vec", "total").groupBy("tree", "node").applyInArrow(_fit(leaf, spill, kind), "tree int, node long, places array<long>, ways array<double>, cuts array<double>"), "subtrees"
        )
        spread = fitted.join(large, ["tree", "node"]).select("tree", "node", "places", "ways", "cuts", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
        keys = ["tree", "node", "salt"]
        dealt = todo.select(*keys, "rep", "vec").groupBy(*keys).cogroup(spread.groupBy(*keys)).applyInArrow(_deal(spill, kind), "tree int, node long, rep long, vec binary, whole boolean")
        dealt = materialize(dealt, "dealt")
        now = dealt.where("not whole").drop("whole")
        sizes = materialize(now.groupBy("tree", "node").agg(F.count("*").alias("total")), "sizes")
        written += [fitted, dealt, sizes]
        small = now.join(sizes.where(F.col("total") <= leaf), ["tree", "node"], "left_semi")
        done = done.unionByName(dealt.where("whole").select("tree", "node", "rep")).unionByName(small.select("tree", "node", "rep"))


def _compare(threshold: float, kind: str):
    """A leaf, or a pair of its blocks: links counted, and a forest of edges."""
    schema = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("other", pa.int64())])

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        node, a, b = (k.as_py() for k in key)
        ids, n, side = (table[c].to_numpy() for c in ("rep", "n", "side"))
        order = np.argsort(ids, kind="stable")
        ids, n, side = ids[order], n[order], side[order]
        x = _matrix(table["vec"], kind)[order]
        lists = table["leaves"].to_pylist()
        near = x @ x.T >= threshold
        np.fill_diagonal(near, False)
        if a != b:
            near &= side[:, None] != side[None, :]
        if not near.any():
            return schema.empty_table()
        flat = np.frombuffer(b"".join(lists), "<i8")
        row = np.empty(len(ids), np.int64)
        row[order] = np.arange(len(ids))
        owner = np.repeat(row, [len(x) // 8 for x in lists])
        earlier = flat < node
        names, column = np.unique(flat[earlier], return_inverse=True)
        seen = np.zeros((len(ids), len(names)), np.float32)
        seen[owner[earlier], column] = 1
        count = near & ~((seen @ seen.T) > 0)
        links = count.astype(np.int64) @ n
        label = np.arange(len(ids))
        while True:
            new = np.where(near, label[None, :], len(ids)).min(axis=1)
            new = np.minimum(label, new)
            new = new[new]
            if (new == label).all():
                break
            label = new
        keep = (links > 0) | (label != np.arange(len(ids)))
        other = np.where(label != np.arange(len(ids)), ids[label], ids)
        return pa.table([ids[keep], links[keep], other[keep]], schema=schema)

    return run


def near_duplicate_vectors(
    vectors: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, leaf: int = LEAF, spill: float = SPILL, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    rows, kind = packed_vectors(vectors, id_col, vec_col, label_col)
    rows = materialize(rows, "rows")
    reps = materialize(representatives(rows), "vectors")
    grown, written = leaves(reps, kind, trees, leaf, spill)
    placed = materialize(grown.select(F.xxhash64("tree", "node").alias("leaf"), "rep").distinct(), "leaves")
    discard(*written)
    sizes = placed.groupBy("leaf").agg(F.count("*").alias("m")).where("m > 1").withColumn("blocks", F.ceil(F.col("m") / (2 * leaf)).cast("int"))
    sizes = materialize(sizes, "leaf-sizes")
    shared = placed.join(sizes.select("leaf"), "leaf", "left_semi")
    # the leaves of a vector as packed numbers, so that a pair counts in the first one it shares
    lists = shared.groupBy("rep").agg(F.collect_list("leaf").alias("leaves")).mapInArrow(_listed, "rep long, leaves binary")
    full = materialize(reps.join(lists, "rep").select("rep", "vec", "n", "leaves"), "listed")
    rows_of = placed.join(sizes, "leaf").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks").cast("long")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("a"), F.greatest(k, F.col("block")).alias("b")))
    rows_of = rows_of.select("leaf", "rep", F.col("block").alias("side"), F.explode(pairs).alias("p")).join(full, "rep")
    rows_of = rows_of.select("leaf", "p.a", "p.b", "side", "rep", "vec", "n", "leaves")
    found = materialize(rows_of.groupBy("leaf", "a", "b").applyInArrow(_compare(threshold, kind), "rep long, links long, other long"), "links")
    parts = connected_components(found.where("rep <> other"), "rep", "other")
    totals = found.groupBy("rep").agg(F.sum("links").alias("links"))
    per_rep = reps.select("same", "rep", "n").join(totals, "rep", "left").join(parts, F.col("rep") == F.col("node"), "left")
    per_rep = per_rep.select(F.col("same").alias("its"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    # every row finds its representative by label and values
    out = rows.select("vec_id", "same").join(materialize(per_rep, "per-vector").hint("merge"), F.col("same") == F.col("its"), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of numbers as packed binary."""
    for batch in batches:
        lists = batch.column(1)
        flat, ends = lists.flatten().to_numpy().astype("<i8"), np.cumsum(lists.value_lengths().to_numpy())
        packed = [flat[a:b].tobytes() for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=False)] if len(lists) else []
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["rep", "leaves"])
