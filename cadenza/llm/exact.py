"""Exact duplicates of normalised texts, batch against immutable snapshots.

A snapshot holds one row per distinct digest and a binary-fuse filter per shard of the
digest space. Digests of a new batch are screened by the filter of their shard; the few
that pass join the snapshot's exact bucket, where the normalised bytes are compared.
Duplicates inside the batch are grouped on their own before that.

Shards hold a bounded number of digests (their number follows the number of digests), all
groupings are pre-aggregated, and the one join on a key that may be hot has plain exchanges
on both sides, so adaptive execution splits it.

Nulls: a null text is an empty text; a null doc_id is a row like any other (it sorts last,
so it is the keeper only of a group of null ids). Repeated rows count once each. An empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..sources.scratch import materialize
from . import fuse
from .frames import positional, restored

SHARD_KEYS = 100_000
LEAST_SHARDS = 96


def normalized(text: Column) -> Column:
    """Every run of blanks as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def fingerprinted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, digest`` of each row: SHA-256 of the normalised text in UTF-8."""
    return docs.select(
        F.col(id_col).alias("doc_id"), F.unhex(F.sha2(normalized(F.col(text_col)).cast("binary"), 256)).alias("digest")
    )


def grouped(rows: DataFrame) -> DataFrame:
    """``digest, keep_id, group_size`` of a table of ``doc_id, digest``."""
    return rows.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))


@dataclass(frozen=True)
class Snapshot:
    """Written tables: buckets ``digest, keep_id, group_size``; filters ``shard, filter``."""

    buckets: DataFrame
    filters: DataFrame
    shards: int


def _shard(digest: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(shards)).cast("int")


def _keys(digests: pa.Array) -> np.ndarray:
    """The first eight bytes of each digest."""
    return np.frombuffer(b"".join(d[:8] for d in digests.to_pylist()), "<u8")


def _filter_of(table: pa.Table) -> pa.Table:
    blob = fuse.build(_keys(table["digest"].combine_chunks()))
    return pa.table({"shard": table["shard"][:1].cast(pa.int32()), "filter": pa.array([blob], pa.binary())})


def snapshot(rows: DataFrame, incoming: int = 0) -> Snapshot:
    """Freeze the distinct digests of ``doc_id, digest`` rows.

    incoming: about how many digests will be screened at once; shards are sized for the
    larger of the two.
    """
    buckets = materialize(grouped(rows), "buckets")
    shards = max(LEAST_SHARDS, -(-max(buckets.count(), incoming) // SHARD_KEYS))
    filters = buckets.select(_shard(F.col("digest"), shards).alias("shard"), "digest").groupBy("shard").applyInArrow(
        _filter_of, "shard int, filter binary"
    )
    return Snapshot(buckets, materialize(filters, "filters"), shards)


def _screened(left: pa.Table, right: pa.Table) -> pa.Table:
    left = left.drop_columns(["shard"])
    if not right.num_rows or not left.num_rows:
        return left.slice(0, 0)
    passed = fuse.contains(right["filter"][0].as_py(), _keys(left["digest"].combine_chunks()))
    return left.filter(pa.array(passed))


def screen(groups: DataFrame, against: Snapshot) -> DataFrame:
    """Of the batch's groups, those that a filter of the snapshot lets pass."""
    sharded = groups.withColumn("shard", _shard(F.col("digest"), against.shards)).groupBy("shard")
    return sharded.cogroup(against.filters.groupBy("shard")).applyInArrow(_screened, groups.schema)


def confirmed(docs: DataFrame, candidates: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests whose texts in the batch and in the snapshot are the same bytes.

    candidates: ``digest, new_id, old_id``. One text of each side is kept per digest, in tasks
    first, so a group of any size, with ids of any kind, is compared as two texts.
    """
    norm = normalized(F.col(text_col))
    texts = docs.select(F.col(id_col).alias("doc_id"), norm.alias("norm")).withColumn("own", F.unhex(F.sha2(F.col("norm").cast("binary"), 256)))
    wanted = candidates.select("digest", F.explode(F.array(F.struct(F.lit(True).alias("new"), F.col("new_id").alias("doc_id")), F.struct(F.lit(False).alias("new"), F.col("old_id").alias("doc_id")))).alias("x")).select("digest", "x.new", "x.doc_id")
    # texts are dealt by digest and id at every size: a broadcast below some size would only hide
    # their cost. Ids may be null or repeat, and (digest, id) names only rows of one text.
    read = texts.join(wanted.hint("merge"), (texts["own"] == wanted["digest"]) & texts["doc_id"].eqNullSafe(wanted["doc_id"])).select("digest", "new", "norm")
    one = read.groupBy("digest", "new").agg(F.min("norm").alias("norm"))
    new, old = (one.where(F.col("new") == side).select("digest", "norm") for side in (True, False))
    return new.join(old.hint("merge"), ["digest", "norm"]).select("digest")


def against_snapshot(docs: DataFrame, batch: DataFrame, frozen: Snapshot, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``digest, new_keep, new_size, old_keep, old_size`` for each distinct digest of the batch.

    The old columns are null where the snapshot doesn't hold the text. ``docs`` gives the
    texts of both sides for the byte check.
    """
    groups = materialize(grouped(batch), "batch-groups")
    passed = materialize(
        screen(groups, frozen).join(frozen.buckets.select("digest", F.col("keep_id").alias("old_keep"), F.col("group_size").alias("old_size")), "digest"),
        "passed",
    )
    same = confirmed(docs, passed.select("digest", F.col("keep_id").alias("new_id"), F.col("old_keep").alias("old_id")), id_col, text_col)
    known = passed.join(same, "digest").select("digest", "old_keep", "old_size")
    return groups.select("digest", F.col("keep_id").alias("new_keep"), F.col("group_size").alias("new_size")).join(known, "digest", "left")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, digest.

    About half of the documents (by a hash of the id) are frozen as a snapshot, the others
    arrive as a batch; the keeper of a text is the smallest id on either side.
    """
    rows = materialize(
        fingerprinted(docs, id_col, text_col).withColumn("new", F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1), "digests"
    )
    batch = rows.where("new")
    frozen = snapshot(rows.where("not new").select("doc_id", "digest"), batch.count())
    found = materialize(against_snapshot(docs, batch.select("doc_id", "digest"), frozen, id_col, text_col), "found")
    old = F.col("old_keep").isNotNull() | F.col("old_size").isNotNull()
    new_side = found.select(
        "digest", F.lit(True).alias("new"), F.least("new_keep", "old_keep").alias("keep_id"), (F.col("new_size") + F.coalesce("old_size", F.lit(0))).alias("group_size")
    )
    old_side = frozen.buckets.join(found.where(old).select("digest", "new_keep", "new_size"), "digest", "left").select(
        "digest", F.lit(False).alias("new"), F.least("keep_id", "new_keep").alias("keep_id"), (F.col("group_size") + F.coalesce("new_size", F.lit(0))).alias("group_size")
    )
    groups = materialize(new_side.unionByName(old_side), "groups")
    return rows.join(groups, ["digest", "new"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest"
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of the documents that stay, with all their columns.

    Of rows that repeat both the id and the text one stays.
    """
    kept = exact_duplicates(docs, id_col, text_col).where("kept")
    stay = materialize(kept.groupBy("doc_id", "digest").agg(F.count("*").alias("n")), "stay")
    rows, names = positional(docs)
    marked = rows.withColumn("digest", F.unhex(F.sha2(normalized(F.col(names[text_col])).cast("binary"), 256)))
    named = stay.select(F.col("doc_id").alias("stay_id"), F.col("digest").alias("stay_digest")).hint("merge")
    match = F.col(names[id_col]).eqNullSafe(F.col("stay_id")) & (F.col("digest") == F.col("stay_digest"))
    out = marked.join(named, match, "left_semi")
    if not stay.where("n > 1").isEmpty():
        out = out.dropDuplicates([names[id_col], "digest"])
    return restored(out, names)
