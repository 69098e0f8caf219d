"""Substring duplicates by difference-cover anchors.

A window of ``WINDOW`` words that a document with a smaller id holds too is a repeat, and all
words it covers go. To find them, runs of WINDOW - PERIOD + 1 words are hashed only where
their position modulo PERIOD lies in a difference cover. For any two positions some shift
below PERIOD brings both into the cover, so two equal windows share an anchor at the same
place inside them. Anchors that several documents hold are the seeds; around them every
window is hashed by two independent 61-bit polynomials, the smallest document of each window is found, and runs of
repeated windows make up the extended match.

Windows are judged on the input, not on what is left. Words are maximal runs of bytes other
than 0x20 and 0x09-0x0D. Nulls: a null text has no words; a row with a null id loses no word
and takes no other's. Rows with the same id don't repeat each other. An empty table gives no
rows. Other columns are ignored. Ids are integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..sources.scratch import materialize
from . import repeats
from .words import Texts, joined, located, slices, windows

WINDOW = 13
PERIOD = 7
#: A perfect difference cover modulo 7: every difference occurs between two of its members.
COVER = (0, 1, 3)

RESULT = "doc_id long, n_words long, n_removed long, removed array<struct<start:int,end:int>>, kept_sha256 string, kept_text string"


def check_cover(cover: tuple[int, ...], period: int) -> None:
    """Refuse a cover that misses a difference."""
    if {(a - b) % period for a in cover for b in cover} != set(range(period)):
        raise ValueError(f"{cover} is no difference cover modulo {period}")


def _runs(hashes: np.ndarray, upto: np.ndarray, length: int, family: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of words inside a document, and where each starts."""
    counts = np.diff(upto)
    place = np.arange(len(hashes)) - np.repeat(upto[:-1], counts)
    fits = (place + length <= np.repeat(counts, counts))[: max(0, len(hashes) - length + 1)]
    return windows(hashes, length, family)[fits], np.flatnonzero(fits)


def anchors(window: int, period: int, cover: tuple[int, ...]):
    """Hashes at cover positions and the document of each, of a slice of texts."""
    inside = np.zeros(period, bool)
    inside[list(cover)] = True

    def run(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        hashes, at, doc, _ = anchored(texts)
        return hashes, doc[at]

    def anchored(texts: Texts):
        starts, ends, upto = texts.words()
        words = texts.hashes(starts, ends)
        counts = np.diff(upto)
        doc = np.repeat(np.arange(len(counts)), counts)
        place = np.arange(len(words)) - np.repeat(upto[:-1], counts)
        hashes, at = _runs(words, upto, window - period + 1)
        keep = inside[place[at] % period]
        return hashes[keep], at[keep], doc, (starts, ends, upto, words)

    run.anchored = anchored
    return run


def _windows_of(window: int, period: int, cover: tuple[int, ...], buckets: int):
    """Cogroup: texts and shared anchors of a document bucket to windows around the anchors."""
    find = anchors(window, period, cover).anchored

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray]] = []
        shared = np.sort(repeats.tagged(repeats.unpacked(right, "hashes", "<u8"), repeats.unpacked(right, "docs", "<i8")))
        for ids, texts in _texts(left):
            hashes, at, doc, (starts, ends, upto, words) = find(texts)
            hit = at[_member(shared, repeats.tagged(hashes, ids[doc[at]]))]
            if not len(hit):
                continue
            near = np.zeros(len(words) + 1, np.int64)
            np.add.at(near, np.maximum(hit - period + 1, 0), 1)
            np.add.at(near, hit + 1, -1)
            near = np.cumsum(near)[:-1] > 0
            one, begin = _runs(words, upto, window)
            two, _ = _runs(texts.hashes(starts, ends, 1), upto, window, 1)
            pick = near[begin]
            found.append((np.stack([one[pick], two[pick]], axis=1), ids[doc[begin[pick]]]))
        if not found:
            return pa.Table.from_batches([repeats.packed_rows(np.zeros(0, np.int64), [np.zeros((0, 2), np.uint64), np.zeros(0, np.int64)], True)])
        pairs, docs = np.concatenate([p for p, _ in found]), np.concatenate([d for _, d in found])
        pairs, docs, first, least = _least(pairs, docs)
        ask = packed = repeats.packed_rows((pairs[first, 0] % np.uint64(buckets)).astype(np.int64), [pairs[first], docs[first]], False)
        rest = docs > least
        spread = (np.arange(int(rest.sum())) >> 12) + key[0].as_py()
        packed = repeats.packed_rows(spread % buckets, [pairs[rest], docs[rest]], True)
        return pa.Table.from_batches([ask, packed])

    return run


def _texts(table: pa.Table):
    """Ids (nulls as the largest number) and texts of a group by slices."""
    for batch in table.to_batches():
        ids = batch.column("doc_id").fill_null(np.iinfo(np.int64).max).to_numpy()
        for lo, hi, texts in slices(batch.column("text")):
            yield ids[lo:hi], texts


def _member(ordered: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(ordered, keys), len(ordered) - 1)
    return ordered[at] == keys


def _least(pairs: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Different (window, document) in order, the first of each window, and its least document."""
    order = np.lexsort((docs, pairs[:, 1], pairs[:, 0]))
    pairs, docs = pairs[order], docs[order]
    first = np.ones(len(docs), bool)
    first[1:] = (pairs[1:] != pairs[:-1]).any(axis=1)
    new = first.copy()
    new[1:] |= docs[1:] != docs[:-1]
    pairs, docs, first = pairs[new], docs[new], first[new]
    start = np.flatnonzero(first)
    least = np.repeat(docs[start], np.diff(np.append(start, len(docs))))
    return pairs, docs, first, least


def _repeated_of(doc_parts: int):
    def run(table: pa.Table) -> pa.Table:
        settled = table.filter(table["settled"])
        asked = table.filter(pa.compute.invert(table["settled"]))
        pairs, docs = repeats.unpacked(asked, "hashes", "<u8", 2), repeats.unpacked(asked, "docs", "<i8")
        pairs, docs, _, least = _least(pairs, docs) if len(docs) else (pairs.reshape(-1, 2), docs, None, docs)
        again = docs > least
        pairs = np.concatenate([pairs[again], repeats.unpacked(settled, "hashes", "<u8", 2).reshape(-1, 2)])
        docs = np.concatenate([docs[again], repeats.unpacked(settled, "docs", "<i8")])
        return pa.Table.from_batches([repeats.packed_rows(repeats.doc_buckets(docs, doc_parts), [pairs, docs], True)])

    return run


def _kept_of(window: int, with_text: bool):
    """Cogroup: texts and repeated windows of a document bucket to what is kept."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    names = ["doc_id", "n_words", "n_removed", "removed", "kept_sha256", "kept_text"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        pairs, docs = repeats.unpacked(right, "hashes", "<u8", 2).reshape(-1, 2), repeats.unpacked(right, "docs", "<i8")
        gone, also = repeats.tagged(pairs[:, 0], docs), repeats.tagged(pairs[:, 1], docs)
        order = np.argsort(gone)
        gone, also = gone[order], also[order]
        out = []
        at = 0
        nulls = left["doc_id"].combine_chunks()
        for ids, texts in _texts(left):
            starts, ends, upto = texts.words()
            counts = np.diff(upto)
            doc = np.repeat(np.arange(len(counts)), counts)
            cover = np.zeros(len(starts) + 1, np.int64)
            if len(gone):
                one, begin = _runs(texts.hashes(starts, ends), upto, window)
                two, _ = _runs(texts.hashes(starts, ends, 1), upto, window, 1)
                own = ids[doc[begin]]
                hit = begin[located(gone, also, repeats.tagged(one, own), repeats.tagged(two, own)) >= 0]
                np.add.at(cover, hit, 1)
                np.add.at(cover, hit + window, -1)
            lost = np.cumsum(cover)[:-1] > 0
            keep = ~lost
            left_of = np.concatenate([[0], np.cumsum(keep)])[upto]
            text, _, (lo, hi) = joined(texts, starts[keep], ends[keep], left_of)
            view = memoryview(text)
            kept = [bytes(view[a:b]) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
            edge = np.diff(np.concatenate([[0], lost.astype(np.int8), [0]])) if len(lost) else np.zeros(1, np.int8)
            cut = np.flatnonzero(lost & (np.concatenate([[True], doc[1:] != doc[:-1]]) | (edge[:-1] == 1))) if len(lost) else np.zeros(0, np.int64)
            stop = np.flatnonzero(lost & (np.concatenate([doc[1:] != doc[:-1], [True]]) | (edge[1:] == -1))) + 1 if len(lost) else cut
            spans: list[list[dict]] = [[] for _ in counts]
            for d, a, b in zip(doc[cut].tolist(), (cut - upto[doc[cut]]).tolist(), (stop - upto[doc[cut]]).tolist(), strict=True):
                spans[d].append({"start": a, "end": b})
            out.append(
                pa.RecordBatch.from_arrays(
                    [
                        nulls.slice(at, len(counts)),
                        pa.array(counts.astype(np.int64)),
                        pa.array(counts - np.diff(left_of)),
                        pa.array(spans, kind),
                        pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
                        pa.array([k.decode() for k in kept] if with_text else [None] * len(kept), pa.string()),
                    ],
                    names,
                )
            )
            at += len(counts)
        schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("removed", kind), ("kept_sha256", pa.string()), ("kept_text", pa.string())])
        return pa.Table.from_batches(out, schema)

    return run


def without_repeats(docs: DataFrame, window: int = WINDOW, period: int = PERIOD, cover: tuple[int, ...] = COVER, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, removed (spans of words), kept_sha256
    and, if asked for, kept_text."""
    check_cover(cover, period)
    if window < period:
        raise ValueError("a window must be as long as the period at least")
    buckets = repeats.buckets_for(docs, text_col)
    shared = materialize(repeats.shared_anchors(docs, anchors(window, period, cover), buckets, id_col, text_col), "anchors")
    # rows without an id are compared with nothing and meet no bucket
    named = F.col(id_col).isNotNull()
    texts = repeats.by_document(docs.where(named), buckets, id_col, text_col)
    alone = repeats.by_document(docs.where(~named), buckets, id_col, text_col)
    sent = texts.groupBy("bucket").cogroup(shared.groupBy("bucket")).applyInArrow(_windows_of(window, period, cover, buckets), repeats.PACKED)
    repeated = materialize(sent.groupBy("bucket").applyInArrow(_repeated_of(buckets), repeats.PACKED), "windows")
    kept = _kept_of(window, with_text)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = pa.table({"hashes": pa.array([], pa.binary()), "docs": pa.array([], pa.binary())})
        for batch in batches:
            yield from kept(pa.Table.from_batches([batch]), none).to_batches()

    found = texts.groupBy("bucket").cogroup(repeated.groupBy("bucket")).applyInArrow(kept, RESULT)
    return found.unionByName(alone.mapInArrow(whole, RESULT))
