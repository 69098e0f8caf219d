"""Repeated passages by sparse suffix arrays at minimisers.

Of every ``WINDOW`` runs of ``GRAM`` consecutive words the one with the least hash (a
minimiser) is selected by content. A window of ``LEAST_WORDS`` words holds the same minimiser
wherever it stands, so a window that two documents hold has a minimiser that both hold. Kept
are the suffixes whose first LEAST_WORDS words hold a minimiser of several documents; all
others drop out before any sort. Only the first LEAST_WORDS words of a suffix decide, so
suffixes are sorted by a hash of these (two 61-bit polynomials), bucket by bucket, and
neighbours with the same one are matches. Consecutive matches of a document are joined, which
extends a match to the left and to the right as far as it goes.

One suffix per minimiser, sorted and compared with its neighbours, would not be enough: of
documents that share 25 words on each side of a minimiser, those that share 30 on one side
and few on the other come first in either order. So a minimiser stands for a suffix at each
window that holds it. Each bucket of documents asks once for each different window, with the
two least documents that hold it there, and the bucket of the window answers those that
several documents hold with the two least of all. How often a document or the table holds a
passage, and what stands around it, makes no difference.

Nulls: a null text has no words; a row with a null id takes no part. Passages that repeat
only inside one document, or under one id, aren't reported. An empty table, or one without
repeats, gives no rows. Other columns are ignored. Ids are integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..sources.scratch import materialize
from . import repeats
from .covers import _least, _member, _runs, _texts
from .words import Texts, located, windows

LEAST_WORDS = 50
GRAM = 10
WINDOW = LEAST_WORDS - GRAM + 1

#: One row: different windows of a bucket of documents (home) and the two least that hold each.
ASKED = "bucket int, home int, hashes binary, docs binary"
RESULT = "doc_id long, start_word int, end_word int, n_words int, other_doc_id long, repeats_earlier boolean"


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over each run of ``width`` values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = pick(out[: len(out) - step], out[step:])
        have += step
    return out


def minimisers(hashes: np.ndarray, doc: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of the least hash of each ``window`` consecutive ones of a document."""
    if len(hashes) < window:
        return np.zeros(0, np.int64)
    least = _sliding(hashes, window, np.minimum)
    least = np.where(doc[: len(least)] == doc[window - 1 :], least, 0)
    pad = np.zeros(window - 1, np.uint64)
    most = _sliding(np.concatenate([pad, least, pad]), window, np.maximum)
    return np.flatnonzero((most == hashes) & (hashes > 0))


def anchors(gram: int, window: int):
    """Hashes at minimisers and the document of each, of a slice of texts."""

    def run(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        starts, ends, upto = texts.words()
        counts = np.diff(upto)
        doc = np.repeat(np.arange(len(counts)), counts)
        hashes, at = _runs(texts.hashes(starts, ends), upto, gram)
        pick = minimisers(hashes, doc[at], window)
        return hashes[pick], doc[at[pick]]

    return run


def _candidates(left: pa.Table, shared: np.ndarray, gram: int, least_words: int):
    """By slices: hashes of the windows whose minimiser is shared, the id and the first word of each."""
    window = least_words - gram + 1
    for ids, texts in _texts(left) if len(shared) else ():
        starts, ends, upto = texts.words()
        words = texts.hashes(starts, ends)
        counts = np.diff(upto)
        doc = np.repeat(np.arange(len(counts)), counts)
        hashes, at = _runs(words, upto, gram)
        if len(hashes) < window:
            continue
        least = _sliding(hashes, window, np.minimum)
        own = doc[at[: len(least)]]
        change = np.ones(len(least), bool)
        change[1:] = (least[1:] != least[:-1]) | (own[1:] != own[:-1])
        first = np.flatnonzero(change)
        hit = np.repeat(_member(shared, repeats.tagged(least[first], ids[own[first]])), np.diff(np.append(first, len(least))))
        pick = np.flatnonzero(hit & (own == doc[at[window - 1 :]]))
        if not len(pick):
            continue
        begin, own = at[pick], own[pick]
        pairs = np.stack([windows(words, least_words)[begin], windows(texts.hashes(starts, ends, 1), least_words, 1)[begin]], axis=1)
        yield pairs, ids[own], begin - upto[own]


def _anchors_in(table: pa.Table) -> np.ndarray:
    """Sorted keys of the shared minimisers in the settled rows."""
    table = table.filter(table["settled"])
    return np.sort(repeats.tagged(repeats.unpacked(table, "hashes", "<u8"), repeats.unpacked(table, "docs", "<i8")))


def _two_least(pairs: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different windows in order, and the two least documents of each (one twice if there is no other)."""
    pairs, docs, first, _ = _least(pairs, docs)
    start = np.flatnonzero(first)
    ends = np.append(start[1:], len(docs))[: len(start)]
    return pairs[start], np.stack([docs[start], docs[np.minimum(start + 1, ends - 1)]], axis=1)


def _asked(gram: int, least_words: int, buckets: int):
    """Cogroup: texts and shared minimisers of a document bucket to its different windows."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        found = list(_candidates(left, _anchors_in(right), gram, least_words))
        pairs = np.concatenate([np.zeros((0, 2), np.uint64), *(p for p, _, _ in found)])
        pairs, docs = _two_least(pairs, np.concatenate([np.zeros(0, np.int64), *(d for _, d, _ in found)]))
        rows = repeats.packed_rows((pairs[:, 0] % np.uint64(buckets)).astype(np.int64), [pairs, docs], False)
        home = pa.array(np.full(rows.num_rows, key[0].as_py(), np.int32))
        return pa.table([rows["bucket"], home, rows["hashes"], rows["docs"]], ["bucket", "home", "hashes", "docs"])

    return run


def _answered(table: pa.Table) -> pa.Table:
    """Windows of a bucket to those of several documents, for each that asked."""
    pairs, docs = repeats.unpacked(table, "hashes", "<u8", 2), repeats.unpacked(table, "docs", "<i8", 2)
    sizes = np.array([len(x) // 16 for x in table["hashes"].to_pylist()], np.int64)
    home = np.repeat(table["home"].to_numpy().astype(np.int64), sizes)
    _, two = _two_least(np.concatenate([pairs, pairs]), docs.T.ravel())
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    pairs, home = pairs[order], home[order]
    two = two[np.cumsum(np.concatenate([[False], (pairs[1:] != pairs[:-1]).any(axis=1)]))]
    many = two[:, 0] != two[:, 1]
    return pa.Table.from_batches([repeats.packed_rows(home[many], [pairs[many], two[many]], False)])


def _passages(gram: int, least_words: int):
    """Cogroup: texts, shared minimisers (settled) and answers of a document bucket to passages."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        answers = right.filter(pa.compute.invert(right["settled"]))
        keys, two = repeats.unpacked(answers, "hashes", "<u8", 2), repeats.unpacked(answers, "docs", "<i8", 2)
        order = np.argsort(keys[:, 0])
        first, second, two = keys[order, 0], keys[order, 1], two[order]
        docs, begins, others = ([np.zeros(0, np.int64)] for _ in range(3))
        for pairs, ids, begin in _candidates(left, _anchors_in(right), gram, least_words) if len(keys) else ():
            at = located(first, second, pairs[:, 0], pairs[:, 1])
            hit = at >= 0
            ids, of = ids[hit], two[at[hit]]
            docs.append(ids)
            begins.append(begin[hit])
            others.append(np.where(of[:, 0] == ids, of[:, 1], of[:, 0]))
        doc, begin, other = np.concatenate(docs), np.concatenate(begins), np.concatenate(others)
        order = np.lexsort((begin, doc))
        doc, begin, other = doc[order], begin[order], other[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (begin[1:] > begin[:-1] + least_words)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(doc))[: len(first)] - 1
        doc, start, end = doc[first], begin[first], begin[last] + least_words
        other = np.minimum.reduceat(other, first) if len(first) else other
        return pa.table(
            [pa.array(doc), *(pa.array(x.astype(np.int32)) for x in (start, end, end - start)), pa.array(other), pa.array(other < doc)],
            ["doc_id", "start_word", "end_word", "n_words", "other_doc_id", "repeats_earlier"],
        )

    return run


def repeated_passages(docs: DataFrame, least_words: int = LEAST_WORDS, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per maximal run of matched words: doc_id, start_word, end_word (exclusive),
    n_words, other_doc_id (the least other document that holds a window of it), repeats_earlier
    (that one has a smaller id)."""
    window = least_words - gram + 1
    if window < 1:
        raise ValueError("a passage must hold a whole run")
    buckets = repeats.buckets_for(docs, text_col)
    shared = materialize(repeats.shared_anchors(docs, anchors(gram, window), buckets, id_col, text_col), "anchors")
    texts = repeats.by_document(docs, buckets, id_col, text_col).where("doc_id is not null")
    asked = texts.groupBy("bucket").cogroup(shared.groupBy("bucket")).applyInArrow(_asked(gram, least_words, buckets), ASKED)
    answers = materialize(asked.groupBy("bucket").applyInArrow(_answered, repeats.PACKED), "answers")
    told = shared.unionByName(answers)
    return texts.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(_passages(gram, least_words), RESULT)
