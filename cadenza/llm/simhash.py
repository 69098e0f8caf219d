"""SimHash fingerprints and their near duplicates by covering locality-sensitive hashing.

A fingerprint bit is 1 if it is set in more than half of the document's shingle hashes.
Two fingerprints link if at most ``RADIUS`` bits differ. For radius r every bit position is
given a vector of r + 1 bits; the mask of a nonzero vector v keeps the positions whose vector
has an odd product with v. The differing positions of a pair span at most r dimensions, so
some v is orthogonal to all of them: its mask drops every differing bit and the pair shares
that bucket. With r = 3 these 15 tables miss no pair.

Equal fingerprints are one row from the start. A bucket of more than ``BUCKET`` different
fingerprints is dealt again by masks that also keep one of r + 1 parts of the dropped bits;
a pair agrees on one of the parts, so nothing is lost, and a bucket of k open bits holds
2**k fingerprints at most. Inside a bucket the links are reduced to a forest, so no list of
pairs is made; connected components run over the forests.

Nulls: a null text has no words and the fingerprint 0; a null id takes part, and the
component id is the least id that isn't null. Texts of less than ``SHINGLE`` words are one
shingle. Repeated rows give a row each. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.graph import connected_components, star_batches
from ..sources.scratch import materialize
from .frames import positional, restored
from .words import Texts, joined, ragged, slices, xxh64

SHINGLE = 3
SEED = 42
RADIUS = 3
BUCKET = 2048

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Byte lanes: bit k of the index as the low bit of byte k.
_LANES = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")).view(np.uint64).ravel()


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per document (``counts`` hashes each) the bits set in more than half of its hashes."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    n = counts[full]
    parts = -(-n // 255)
    first = np.cumsum(n) - n
    cuts = np.repeat(first, parts) + 255 * ragged(np.zeros(len(n), np.int64), parts)
    byte = hashes.view(np.uint8).reshape(-1, 8)
    sums = np.stack([np.add.reduceat(_LANES[byte[:, k]], cuts) for k in range(8)], axis=1)
    bits = np.add.reduceat(sums.view(np.uint8).reshape(len(cuts), 64).astype(np.int64), np.cumsum(parts) - parts, axis=0)
    out[full] = np.packbits(2 * bits > n[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints_of(texts: Texts, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The fingerprint of each document of a slice."""
    data = _LOWER[texts.data]
    starts, ends, upto = Texts(data, texts.offsets).words()
    counts = np.diff(upto)
    if not len(starts):
        return np.zeros(len(counts), np.uint64)
    size = ends - starts
    text, new, _ = joined(Texts(data, texts.offsets), starts, ends, upto)
    per = np.where(counts >= shingle, counts - shingle + 1, (counts > 0).astype(np.int64))
    first = ragged(upto[:-1], per)
    last = first + np.repeat(np.minimum(counts, shingle), per) - 1
    return majority(xxh64(text, new[first], new[last] + size[last], seed), per)


def _fingerprint_batches(shingle: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprints_of(t, shingle, seed) for _, _, t in slices(batch.column(1))]
            bits = np.concatenate(found) if found else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits.view(np.int64))], ["doc_id", "bits"])

    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, bits`` (the fingerprint as a signed long) of each row."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        _fingerprint_batches(shingle, seed), f"doc_id {kind}, bits long"
    )


def covering_masks(radius: int = RADIUS, width: int = 64) -> list[int]:
    """One mask per nonzero vector of radius + 1 bits."""
    top = 1 << (radius + 1)
    vector = [i % (top - 1) + 1 for i in range(width)]
    return [sum(1 << i for i in range(width) if bin(vector[i] & v).count("1") % 2) for v in range(1, top)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(bits: np.ndarray, radius: int) -> np.ndarray:
    """The least index of each one's connected part, by links within the radius."""
    m = len(bits)
    near = np.empty((m, m), bool)
    for lo in range(0, m, 256):
        near[lo : lo + 256] = np.bitwise_count(bits[lo : lo + 256, None] ^ bits[None, :]) <= radius
    label = np.arange(m)
    while True:
        new = label.copy()
        for lo in range(0, m, 256):
            new[lo : lo + 256] = np.where(near[lo : lo + 256], label[None, :], m).min(axis=1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _links(radius: int):
    """Edges between representatives within each run of equal ``mask, key`` of sorted rows, as
    stars of all edges of a task."""

    def edges(run: np.ndarray, bits: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = np.flatnonzero(np.diff(run)) + 1
        first = np.concatenate([[0], cut])
        size = np.diff(np.append(first, len(run)))
        left, right = [], []
        small = np.repeat(size <= 16, size)
        for step in range(1, 16):
            at = np.flatnonzero(small[:-step] & (run[:-step] == run[step:])) if len(run) > step else np.zeros(0, np.int64)
            if not len(at):
                break
            at = at[np.bitwise_count(bits[at] ^ bits[at + step]) <= radius]
            left.append(ids[at])
            right.append(ids[at + step])
        for k in np.flatnonzero(size > 16):
            lo, hi = first[k], first[k] + size[k]
            label = _forest(bits[lo:hi], radius)
            at = np.flatnonzero(label != np.arange(len(label)))
            left.append(ids[lo + at])
            right.append(ids[lo + label[at]])
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *left]), np.concatenate([none, *right])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        held: list[np.ndarray] = []

        def put(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            group = np.cumsum(np.concatenate([[False], (np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0)]))
            return edges(group, rows[2].view(np.uint64), rows[3])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4)])
            rows = np.concatenate([*held, rows], axis=1)
            same = (rows[0] == rows[0, -1]) & (rows[1] == rows[1, -1])
            tail = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            if tail:
                yield put(rows[:, :tail])
            held = [rows[:, tail:]]
        if held and held[0].shape[1]:
            yield put(held[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return star_batches(found(batches))

    return run


def finer_masks(masks: np.ndarray, parts: int) -> np.ndarray:
    """Of each mask, in a row, the mask with each of so many parts of its open bits added."""
    open_bits = np.unpackbits(~masks.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)
    part = (np.cumsum(open_bits, axis=1) - 1) % parts
    added = [np.packbits(open_bits & (part == k), axis=1, bitorder="little").view(np.uint64).ravel() for k in range(parts)]
    return masks[:, None] | np.stack(added, axis=1)


def _dealt_again(parts: int):
    """Rows ``mask, key, bits, rep`` under each of the finer masks of theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks, bits, rep = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2, 3))
            finer = finer_masks(masks.view(np.uint64), parts).ravel().view(np.int64)
            bits = np.repeat(bits, parts)
            yield pa.RecordBatch.from_arrays([pa.array(finer), pa.array(finer & bits), pa.array(bits), pa.array(np.repeat(rep, parts))], batch.schema.names)

    return run


def linked(distinct: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Edges ``u, v`` between ids that join exactly the linked fingerprints of ``bits, rep``.

    Not every pair is an edge, but the edges' components are those of all linked pairs. The
    masks stand in the rows: those of heavy buckets are made finer in tasks, from these rows
    alone, until no bucket is heavy or a mask leaves no more open bits than parts.
    """
    masks = F.array(*[F.lit(_signed(m)) for m in covering_masks(radius)])
    keyed = distinct.where("rep is not null").select("bits", F.col("rep").cast("long").alias("rep"), F.explode(masks).alias("mask"))
    keyed = keyed.select("mask", F.col("bits").bitwiseAND(F.col("mask")).alias("key"), "bits", "rep")
    parts, ready = radius + 1, None
    while True:
        open_bits = F.lit(64) - F.bit_count("mask")
        heavy = keyed.where(open_bits > parts).groupBy("mask", "key").agg(F.count("*").alias("n")).where(F.col("n") > bucket)
        heavy = materialize(heavy.select("mask", "key"), "heavy")
        done = heavy.isEmpty()
        light = keyed if done else keyed.join(heavy, ["mask", "key"], "left_anti")
        ready = light if ready is None else ready.unionByName(light)
        if done:
            break
        again = keyed.join(heavy, ["mask", "key"]).select("mask", "key", "bits", "rep")
        keyed = materialize(again.mapInArrow(_dealt_again(parts), "mask long, key long, bits long, rep long"), "finer")
    return ready.repartition("mask", "key").sortWithinPartitions("mask", "key").mapInArrow(_links(radius), "u long, v long")


def _components(docs: DataFrame, radius: int, shingle: int, seed: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """``doc_id, bits`` of each row, and ``bits, component_id, keep_bits`` of each fingerprint:
    the least id of its component and, of the fingerprints of that id in it, the least."""
    rows = materialize(fingerprints(docs, shingle, seed, id_col, text_col), "bits")
    distinct = materialize(rows.groupBy("bits").agg(F.min("doc_id").alias("rep")), "distinct")
    # fingerprints are the nodes: ids can be null or stand for unlike texts
    parts = connected_components(linked(distinct.select("bits", F.col("bits").alias("rep")), radius))
    named = distinct.join(parts, distinct["bits"] == parts["node"], "left").select("bits", "rep", F.coalesce("component", "bits").alias("part"))
    named = materialize(named, "parts")
    keep = named.groupBy("part").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "bits")).alias("keep"))
    named = named.join(keep, "part").select("bits", F.col("keep.rep").alias("component_id"), F.col("keep.bits").alias("keep_bits"))
    return rows, materialize(named, "components")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, bits, component_id (the least id it is linked with, itself included)."""
    rows, named = _components(docs, radius, shingle, seed, id_col, text_col)
    return rows.join(named, "bits").select("doc_id", "bits", "component_id")


def _bits(column: pa.Array) -> pa.Array:
    found = [fingerprints_of(t, SHINGLE, SEED) for _, _, t in slices(column)]
    return pa.array((np.concatenate(found) if found else np.zeros(0, np.uint64)).view(np.int64))


def drop_near_duplicates(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, one with its least id; all columns of ``docs``.

    A component without ids keeps one row too. Unlike texts under one id, or without one, are
    rows of several components and stay. If an id has several fingerprints, they are computed
    once more beside the columns; otherwise the id tells the fingerprint.
    """
    found, named = _components(docs, radius, SHINGLE, SEED, id_col, text_col)
    stay = named.where(F.col("bits") == F.col("keep_bits")).select(F.col("component_id").alias("stay_id"), F.col("bits").alias("stay_bits"))
    kept = found.join(stay, (F.col("bits") == F.col("stay_bits")) & F.col("doc_id").eqNullSafe(F.col("stay_id")))
    stay = materialize(kept.groupBy("stay_id", "stay_bits").agg(F.count("*").alias("n")), "stay")
    rows, names = positional(docs)
    key = [names[id_col]]
    match = F.col(names[id_col]).eqNullSafe(F.col("stay_id"))
    if not found.groupBy("doc_id").agg(F.min("bits").alias("a"), F.max("bits").alias("b")).where("a < b").isEmpty():
        rows = rows.withColumn("bits", F.arrow_udf(_bits, "long")(F.col(names[text_col]).cast("string")))
        key, match = [*key, "bits"], match & (F.col("bits") == F.col("stay_bits"))
    out = rows.join(stay.hint("merge"), match, "left_semi")
    if not stay.where("n > 1").isEmpty():
        out = out.dropDuplicates(key)
    return restored(out, names)
