"""Quality by importance resampling.

Words and pairs of words, lower-cased, are hashed into ``FEATURES`` bins. Two bag models count
the bins: the raw model over all documents, the target model over labelled documents of high
quality. A document's weight is the log ratio of the two models, summed over its features;
adding Gumbel noise (drawn from a hash of the id and the seed) and taking the k largest
samples k documents without replacement in proportion to their weights.

The target model learns from at most about ``TARGET_DOCS`` labelled documents, chosen by a
hash of the id; this bound is a parameter. The raw model counts every document. The k-th
largest key is found by narrowing histograms of the keys, so no task sorts all documents.

Nulls: a null text has no features and the weight 0; a null id draws the noise of the number
0; rows without quality aren't targets. Without any target all weights are 0. Equal keys at
the cut are taken by the smaller id, nulls last. Repeated rows are documents of their own, as
many of them are kept as the cut leaves room for. An empty table gives no rows. Other columns
are ignored. Ids are integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..sources.scratch import materialize
from .words import Texts, mixed, slices

FEATURES = 1 << 14
TARGET_DOCS = 20_000
BINS = 1 << 14
SMOOTH = 1.0

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def features(texts: Texts, bins: int = FEATURES) -> tuple[np.ndarray, np.ndarray]:
    """Bins of all words and pairs of words of a slice, and the document of each."""
    low = Texts(_LOWER[texts.data], texts.offsets)
    starts, ends, upto = low.words()
    words = low.hashes(starts, ends)
    counts = np.diff(upto)
    doc = np.repeat(np.arange(len(counts)), counts)
    inner = np.flatnonzero(doc[1:] == doc[:-1]) if len(doc) else np.zeros(0, np.int64)
    pairs = mixed(words[inner] * np.uint64(0x9E3779B97F4A7C15) + words[inner + 1]) if len(inner) else np.zeros(0, np.uint64)
    mask = np.uint64(bins - 1)
    return (np.concatenate([words & mask, pairs & mask])).astype(np.int64), np.concatenate([doc, doc[inner]])


def _counts(targets, bins: int):
    """Per task one row: the raw and the target counts of all its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, goal = np.zeros(bins, np.int64), np.zeros(bins, np.int64)
        wanted = targets.value
        for batch in batches:
            ids = batch.column(0)
            known = np.asarray(ids.is_valid())
            chosen = np.isin(ids.fill_null(0).to_numpy(), wanted) & known
            for lo, hi, texts in slices(batch.column(1)):
                found, doc = features(texts, bins)
                raw += np.bincount(found, minlength=bins)
                own = chosen[lo:hi][doc]
                if own.any():
                    goal += np.bincount(found[own], minlength=bins)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(raw[at]), pa.array(goal[at])], ["bin", "raw", "goal"])

    return run


def ratios(docs: DataFrame, labels: DataFrame, bins: int = FEATURES, target_docs: int = TARGET_DOCS, id_col: str = "doc_id", text_col: str = "text", good: str = "quality = 1") -> np.ndarray:
    """Log ratio of target to raw probability of each bin."""
    spark = docs.sparkSession
    ids = labels.where(good).select(F.col(id_col).cast("long").alias("id")).where("id is not null").distinct()
    n = ids.count()
    bound = int(min(1.0, target_docs / max(1, n)) * (1 << 30))
    chosen = ids.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < bound).toPandas()["id"].to_numpy(np.int64)
    shared = spark.sparkContext.broadcast(np.sort(chosen))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sums = rows.mapInArrow(_counts(shared, bins), "bin int, raw long, goal long").groupBy("bin").agg(F.sum("raw").alias("raw"), F.sum("goal").alias("goal")).toPandas()
    raw, goal = np.full(bins, SMOOTH), np.full(bins, SMOOTH)
    raw[sums["bin"]] += sums["raw"]
    goal[sums["bin"]] += sums["goal"]
    if goal.sum() == SMOOTH * bins:
        return np.zeros(bins)
    return np.log(goal / goal.sum()) - np.log(raw / raw.sum())


def weights(docs: DataFrame, log_ratio: np.ndarray, seed: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_features, weight, key``: key is the weight with its Gumbel noise."""
    shared = docs.sparkSession.sparkContext.broadcast(log_ratio)
    bins = len(log_ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).fill_null(0).to_numpy()
            for lo, hi, texts in slices(batch.column(1)):
                found, doc = features(texts, bins)
                size = np.bincount(doc, minlength=hi - lo)
                weight = np.bincount(doc, weights=shared.value[found], minlength=hi - lo)
                noise = mixed(ids[lo:hi].astype(np.int64).view(np.uint64) ^ mixed(np.array([seed], np.uint64))[0])
                uniform = ((noise >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(size), pa.array(weight), pa.array(weight - np.log(-np.log(uniform)))], ["doc_id", "n_features", "weight", "key"]
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_features long, weight double, key double"
    )


def _kth(rows: DataFrame, column: str, k: int, falling: bool, bins: int = BINS) -> tuple[object, int]:
    """The k-th value of a number column without nulls, and how many of the rows that have it
    are among the first k.

    The range of values that holds the k-th is cut into bins, and the bin that holds it
    becomes the range, until that holds few rows or one value only.
    """
    low, high, inside = rows.agg(F.min(column), F.max(column), F.count("*")).first()
    while low < high:
        within = rows.where(F.col(column).between(low, high))
        width = (float(high) - float(low)) / bins
        if inside <= bins or float(low) + width == float(low):
            counts = within.groupBy(F.col(column).alias("low")).agg(F.count("*").alias("n"), F.max(column).alias("high")).collect()
        else:
            at = F.least(F.floor((F.col(column).cast("double") - float(low)) / width), F.lit(bins - 1))
            counts = within.groupBy(at.alias("at")).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect()
        for r in sorted(counts, key=lambda r: r["low"], reverse=falling):
            if r["n"] >= k:
                break
            k -= r["n"]
        low, high, inside = r["low"], r["high"], r["n"]
    return low, k


def top(scored: DataFrame, k: int, bins: int = BINS) -> DataFrame:
    """Adds ``kept``: whether a row of ``key, doc_id`` is among the k with the largest ``key``;
    of equal keys those with the smaller id are, nulls last. Exactly k rows are kept: the
    rows are numbered and written, so that repeated ones can be told apart."""
    scored = materialize(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    n = scored.count()
    if k <= 0 or k >= n:
        return scored.withColumn("kept", F.lit(0 < n <= k)).drop("row")
    cut, left = _kth(scored, "key", k, True, bins)
    tied = scored.where(F.col("key") == cut)
    known = tied.where("doc_id is not null")
    n_known = known.count()
    if left <= n_known:
        ident, left = _kth(known, "doc_id", left, False, bins)
        same, before = F.col("doc_id").eqNullSafe(F.lit(ident)), F.col("doc_id") < ident
    else:
        left -= n_known
        same, before = F.col("doc_id").isNull(), F.col("doc_id").isNotNull()
    row, _ = _kth(tied.where(same), "row", left, False, bins)
    kept = (F.col("key") > cut) | ((F.col("key") == cut) & (F.coalesce(before, F.lit(False)) | (same & (F.col("row") <= row))))
    return scored.withColumn("kept", kept).drop("row")


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, seed: int = 7, bins: int = FEATURES, target_docs: int = TARGET_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_features, weight, key, kept.

    share: part of all documents to sample; where it is None, the part of good documents
    among those with a label.
    """
    if share is None:
        share = labels.agg(F.avg(F.when(F.col("quality").isNotNull(), (F.col("quality") == 1).cast("double")))).first()[0] or 0.0
    log_ratio = ratios(docs, labels, bins, target_docs, id_col, text_col)
    return top(weights(docs, log_ratio, seed, id_col, text_col), int(round(share * docs.count())))
