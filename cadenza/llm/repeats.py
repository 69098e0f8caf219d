"""Which hashed passages occur in more than one document: the exchange that substring
operators share.

Tasks hash passages in numpy and send packed arrays, one row per bucket of the hash space
and flush, so Spark shuffles few large rows. A passage that several documents of one flush
hold is settled there and only announced to its bucket once; so a passage that a third of
all documents hold reaches its bucket once per flush. What a bucket finds goes back by the
bucket of the document. Buckets of both kinds hold about ``BUCKET_BYTES`` of text each,
however large the table is.

Document ids must be integers; a null id takes part in no comparison.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .words import Texts, mixed, slices, xxh64

BUCKET_BYTES = 8 << 20
LEAST_BUCKETS = 64
FLUSH = 1 << 20

#: One row: hashes and documents as packed 64-bit arrays; settled rows only pass through.
PACKED = "bucket int, settled boolean, hashes binary, docs binary"


def buckets_for(docs: DataFrame, text_col: str) -> int:
    """How many buckets the table's texts need."""
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(LEAST_BUCKETS, -(-size // BUCKET_BYTES))


def doc_bucket(doc_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(doc_id.cast("long")), F.lit(buckets)).cast("int")


def doc_buckets(ids: np.ndarray, buckets: int) -> np.ndarray:
    """The same number as ``doc_bucket`` for an array of ids (42 is the seed of Spark's xxhash64)."""
    at = np.arange(len(ids)) * 8
    return (xxh64(np.ascontiguousarray(ids).view(np.uint8), at, at + 8, 42).view(np.int64) % buckets).astype(np.int64)


def packed_rows(bucket: np.ndarray, arrays: list[np.ndarray], settled: bool) -> pa.RecordBatch:
    """One row per bucket with its part of each array."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cut = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1]) if len(bucket) else np.zeros(0, np.int64)
    ends = np.append(cut[1:], len(bucket))[: len(cut)]
    columns = []
    for values in arrays:
        view = memoryview(np.ascontiguousarray(values[order]).tobytes())
        width = values.dtype.itemsize * int(np.prod(values.shape[1:]))
        columns.append(pa.array([bytes(view[a * width : b * width]) for a, b in zip(cut.tolist(), ends.tolist(), strict=True)], pa.binary()))
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket[cut].astype(np.int32)), pa.array(np.full(len(cut), settled)), *columns], ["bucket", "settled", "hashes", "docs"]
    )


def unpacked(table: pa.Table, name: str, kind: str, width: int = 1) -> np.ndarray:
    """The packed arrays of a column, one after the other."""
    flat = np.frombuffer(b"".join(table[name].to_pylist()), kind)
    return flat.reshape(-1, width) if width > 1 else flat


def distinct_pairs(hashes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different pairs of hash and document, sorted by both."""
    order = np.lexsort((docs, hashes))
    hashes, docs = hashes[order], docs[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (np.diff(hashes.view(np.int64)) != 0) | (np.diff(docs) != 0)
    return hashes[new], docs[new]


def in_many(hashes: np.ndarray) -> np.ndarray:
    """Which of sorted hashes stand more than once."""
    same = hashes[1:] == hashes[:-1]
    out = np.zeros(len(hashes), bool)
    out[1:] |= same
    out[:-1] |= same
    return out


def _send(hashes: np.ndarray, docs: np.ndarray, buckets: int, turn: int) -> Iterator[pa.RecordBatch]:
    hashes, docs = distinct_pairs(hashes, docs)
    many = in_many(hashes)
    first = np.ones(len(hashes), bool)
    first[1:] = hashes[1:] != hashes[:-1]
    ask = ~many | first
    yield packed_rows((hashes[ask] % np.uint64(buckets)).astype(np.int64), [hashes[ask], docs[ask]], False)
    if many.any():
        spread = (np.arange(int(many.sum())) >> 12) + turn
        yield packed_rows(spread % buckets, [hashes[many], docs[many]], True)


def anchor_rows(anchors: Callable[[Texts], tuple[np.ndarray, np.ndarray]], buckets: int) -> Callable:
    """For mapInArrow over id and text: packed anchors of all documents.

    anchors: gives hashes and the document index of each anchor of a slice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size, turn = 0, 0
        for batch in batches:
            ids = batch.column(0).cast(pa.int64())
            known = np.asarray(ids.is_valid())
            ids = ids.fill_null(0).to_numpy()
            for lo, _, texts in slices(batch.column(1)):
                hashes, doc = anchors(texts)
                keep = known[lo + doc]
                held.append((hashes[keep], ids[lo + doc[keep]]))
                size += int(keep.sum())
                if size >= FLUSH:
                    yield from _send(np.concatenate([h for h, _ in held]), np.concatenate([d for _, d in held]), buckets, turn)
                    held, size, turn = [], 0, turn + 1
        if held:
            yield from _send(np.concatenate([h for h, _ in held]), np.concatenate([d for _, d in held]), buckets, turn)

    return run


def _shared_of(doc_parts: int):
    def run(table: pa.Table) -> pa.Table:
        settled = table.filter(table["settled"])
        asked = table.filter(pa.compute.invert(table["settled"]))
        hashes, docs = distinct_pairs(unpacked(asked, "hashes", "<u8").copy(), unpacked(asked, "docs", "<i8").copy())
        many = in_many(hashes)
        hashes = np.concatenate([hashes[many], unpacked(settled, "hashes", "<u8")])
        docs = np.concatenate([docs[many], unpacked(settled, "docs", "<i8")])
        return pa.Table.from_batches([packed_rows(doc_buckets(docs, doc_parts), [hashes, docs], True)])

    return run


def shared_anchors(docs: DataFrame, anchors: Callable[[Texts], tuple[np.ndarray, np.ndarray]], buckets: int, id_col: str, text_col: str) -> DataFrame:
    """Packed rows by document bucket: the anchors that more than one document holds."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sent = rows.mapInArrow(anchor_rows(anchors, buckets), PACKED)
    return sent.groupBy("bucket").applyInArrow(_shared_of(buckets), PACKED)


def by_document(docs: DataFrame, buckets: int, id_col: str, text_col: str) -> DataFrame:
    """``bucket, doc_id, text``: whole texts dealt by the bucket of their id."""
    return docs.select(doc_bucket(F.col(id_col), buckets).alias("bucket"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def tagged(hashes: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """One 64-bit key of a hash in a document."""
    return mixed(hashes ^ mixed(docs.astype(np.int64).view(np.uint64)))
