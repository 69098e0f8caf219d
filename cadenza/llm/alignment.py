"""Alignment of the tokens of two tokenizers over the bytes of whole texts.

Ends of tokens are running sums of their byte lengths. Places where tokens of both sides end
(an intersection of the two sorted arrays) cut a text into groups, a binary search among the
cuts labels each token with its group, and links are expanded by repeating each token of the
first side once per token of the second that its bytes overlap.

A text is first cut at single spaces between two other solid characters. Tokens of neither
side reach over such a place (see ``Aligner``), so groups and links are those of the pieces,
one after the other; each piece that a worker meets is encoded and aligned once and remembered.

Counts of linked pairs take two rounds. Tasks go by batches of about ``BATCH`` bytes of text
and write, per document, which pieces it holds and, per batch, the pairs of the pieces and in
how many of the batch's documents each is linked. Counts of batches are summed by pair and
salt, then by pair, so a pair that most documents link is spread over ``SALTS`` tasks. The
totals then return to the batches: a batch asks once for each of its pairs, never once per
document, and sums over the links of a document are sums over its pieces.

A batch and its pieces are held by one task, and bounded; a longer text is a batch of its own,
and a run of characters without a space is encoded in one call, so memory follows the longest
text. Batches are named by the task that wrote them and are read from that written table, so a
lost executor can't mix two divisions into batches.

Nulls: null and empty texts, and texts whose tokens don't give back their bytes, have no
tokens: zeros and empty groups. Ids aren't used, so null and repeated ids are rows like any
other. Repeated rows and equal texts count as a document each. Ties for the highest count of a
first id are all best. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ..sources.scratch import materialize
from .frames import text_batches
from .words import buffers, ragged, release

#: Bytes of text in a batch.
BATCH = 4 << 20
#: Pieces remembered between two batches.
KNOWN_PIECES = 250_000
#: Documents whose pairs are told apart at once.
_DOCS = 200
SALTS = 16
#: Pieces of one string, and strings of one call of a tokenizer.
_JOINED = 200
_STRINGS = 50


@dataclass(frozen=True)
class Alignment:
    """Groups of the tokens of both sides, byte places of the cuts, and links as index pairs."""

    cuts: np.ndarray
    first_group: np.ndarray
    second_group: np.ndarray
    first: np.ndarray
    second: np.ndarray


def align(first_sizes: np.ndarray, second_sizes: np.ndarray) -> Alignment:
    """Align two tokenisations of the same bytes, given the byte lengths of their tokens."""
    one, two = np.cumsum(first_sizes), np.cumsum(second_sizes)
    cuts = np.intersect1d(one, two, assume_unique=True)
    low = np.searchsorted(two, one - first_sizes, "right")
    high = np.searchsorted(two - second_sizes, one, "left")
    return Alignment(
        cuts, np.searchsorted(cuts, one), np.searchsorted(cuts, two), np.repeat(np.arange(len(one)), high - low), ragged(low, high - low)
    )


def _byte_of() -> dict[str, int]:
    """The byte of each character of byte-level vocabularies: printable characters of Latin-1
    stand for themselves, the other bytes in order for the characters from 256 on."""
    plain = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b}
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteTokens:
    """A byte-level tokenizer; special tokens inside texts are plain text."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        vocabulary, byte = self.model.get_vocab(), _byte_of()
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            self.bytes[k] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]


class PieceTokens:
    """A piece tokenizer that puts a space before each text."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        self.bytes = [
            bytes([int(p[3:5], 16)]) if self.model.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(map(self.model.id_to_piece, range(n)))
        ]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


_SOLID = np.zeros(256, bool)
_SOLID[0x21:0x7F] = True
#: First bytes of the characters that hold all blanks beyond ASCII.
_LEADS = np.zeros(256, bool)
_LEADS[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_AFTER = _SOLID.copy()
_AFTER[0x80:] = True
_AFTER[_LEADS] = False


def pieces(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Starts of the pieces of texts that stand one after the other, each with a space before it."""
    if not len(data):
        return np.zeros(0, np.int64)
    at = np.flatnonzero(data[3:-1] == 0x20) + 3
    before = data[at - 1]
    solid = _SOLID[before]
    wide = (before >= 0x80) & ~(data[at - 2] == 0xC2) & ~(_LEADS[data[at - 3]] & (data[at - 2] >= 0x80))
    begins = np.zeros(len(data), bool)
    begins[at[(solid | wide) & _AFTER[data[at + 1]]]] = True
    begins[starts] = True
    return np.flatnonzero(begins)


class Aligner:
    """Pieces of texts with their tokens on both sides, remembered per worker.

    A piece starts with a space and ends before the next space that stands between two
    characters that aren't blank. The byte-level tokenizer splits texts by a pattern whose
    matches hold a space only at their start or among blanks, so it always splits there; no
    entry of the piece vocabulary holds a space mark after another character, so no merge
    reaches over one. Encoding can't lengthen a piece, hence a text gives back its bytes
    exactly if all its pieces do.
    """

    def __init__(self, first: str, second: str) -> None:
        self.first, self.second = ByteTokens(first), PieceTokens(second)
        if any("▁" in p.lstrip("▁") for p in map(self.second.model.id_to_piece, range(len(self.second.bytes)))):
            raise ValueError("pieces that hold a space after another character can't be aligned word by word")
        self.marked = [f"{k}{m}" for k in range(max(len(self.first.bytes), len(self.second.bytes))) for m in ",|;"]
        self.sizes = [np.array([len(b) for b in side.bytes], np.int64) for side in (self.first, self.second)]
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.groups: list[str] = []
        #: By piece: tokens of both sides, groups, links, whether the bytes come back.
        self.stats = np.zeros((4, 0), np.int32)
        self.exact = np.zeros(0, bool)
        #: Different pairs of each piece, one piece after the other, and how often each is linked.
        self.pair_start, self.pair_size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pairs, self.times = np.zeros(0, np.int64), np.zeros(0, np.int32)

    def index(self, found: list[bytes]) -> np.ndarray:
        """Numbers of different pieces; unknown ones are encoded and aligned."""
        new = [p for p in found if p not in self.known]
        if new:
            self._add(new)
        return np.fromiter((self.known[p] for p in found), np.int64, len(found))

    def _add(self, new: list[bytes]) -> None:
        ids, counts, exact = self._encoded(new)
        found = align(self.sizes[0][ids[0]], self.sizes[1][ids[1]])
        owner = [np.repeat(np.arange(len(new)), n) for n in counts]
        cut_owner = np.zeros(len(found.cuts), np.int64)
        cut_owner[found.first_group] = owner[0]
        link_owner = owner[0][found.first]
        stats = np.stack([*counts, np.bincount(cut_owner, minlength=len(new)), np.bincount(link_owner, minlength=len(new))])
        pair, code = np.unique(ids[0][found.first] << 32 | ids[1][found.second], return_inverse=True)
        own, times = np.unique(link_owner * max(1, len(pair)) + code, return_counts=True)
        size = np.bincount(own // max(1, len(pair)), minlength=len(new))
        self.pair_start = np.concatenate([self.pair_start, len(self.pairs) + np.cumsum(size) - size])
        self.pair_size = np.concatenate([self.pair_size, size])
        self.pairs = np.concatenate([self.pairs, pair[own % max(1, len(pair))]])
        self.times = np.concatenate([self.times, times.astype(np.int32)])
        self.stats = np.concatenate([self.stats, stats.astype(np.int32)], axis=1)
        self.exact = np.concatenate([self.exact, exact])
        self.groups += self._written(found, ids, owner, len(new))
        for p in new:
            self.known[p] = len(self.known)

    def _encoded(self, new: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """Token ids of both sides, their numbers by piece, and which pieces give back their bytes.

        Pieces that may follow one another in a text are encoded together, and told apart by
        the places where tokens end. A run that doesn't give back its bytes is encoded piece
        by piece, and those pieces that don't have no tokens.
        """
        data = b"".join(new)
        sizes = np.fromiter(map(len, new), np.int64, len(new))
        edges = np.concatenate([[0], np.cumsum(sizes)])
        soft = np.isin(edges[:-1], pieces(np.frombuffer(data, np.uint8), edges[:1]), assume_unique=True)
        starts = np.flatnonzero(~soft | (np.arange(len(new)) % _JOINED == 0))
        runs = list(zip(starts.tolist(), [*starts[1:].tolist(), len(new)], strict=True))
        exact, kept, at = np.ones(len(new), bool), [], edges.tolist()
        for single in (False, True):
            again = []
            for k in range(0, len(runs), _STRINGS):
                part = runs[k : k + _STRINGS]
                texts = [data[at[lo] : at[hi]].decode() for lo, hi in part]
                for run, text, one, two in zip(part, texts, self.first.encode(texts), self.second.encode([t[1:] for t in texts]), strict=True):
                    if all(b"".join(map(side.bytes.__getitem__, ids)) == text.encode() for side, ids in ((self.first, one), (self.second, two))):
                        kept.append((run[0], np.array(one, np.int64), np.array(two, np.int64)))
                    elif single:
                        exact[run[0]] = False
                    else:
                        again.append(run)
            runs = [(k, k + 1) for lo, hi in again for k in range(lo, hi)]
        kept.sort(key=lambda r: r[0])
        ids = [np.concatenate([np.zeros(0, np.int64), *(r[side] for r in kept)]) for side in (1, 2)]
        ends = np.cumsum(np.where(exact, sizes, 0))
        counts = [np.diff(np.searchsorted(np.cumsum(n[i]), ends, "right"), prepend=0) for n, i in zip(self.sizes, ids, strict=True)]
        return ids, counts, exact

    def _written(self, found: Alignment, ids: list[np.ndarray], owner: list[np.ndarray], n: int) -> list[str]:
        """Each piece's groups as ``a1,a2|b1;a3|b2,b3``."""
        place = np.concatenate([2 * found.first_group, 2 * found.second_group + 1])
        order = np.argsort(place, kind="stable")
        place, of = place[order], np.concatenate(owner)[order]
        step = np.diff(place, append=place[-1:] + 3)
        mark = np.where(step == 0, 0, np.where(place % 2 == 0, 1, 2))
        parts = list(map(self.marked.__getitem__, (3 * np.concatenate(ids)[order] + mark).tolist()))
        edges = np.searchsorted(of, np.arange(n + 1)).tolist()
        return ["".join(parts[lo:hi])[:-1] for lo, hi in zip(edges[:-1], edges[1:], strict=True)]


@lru_cache(maxsize=1)
def _aligner(first: str, second: str) -> Aligner:
    """This worker's aligner."""
    return Aligner(first, second)


_FIELDS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string"
_BATCH_FIELDS = "pieces array<int>, times array<int>, first array<int>, second array<int>, docs array<int>, sizes array<int>, pairs array<int>, links array<int>"
_INTS = pa.list_(pa.int32())


def _ints(parts: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A list array of consecutive runs."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(parts, pa.int32()))


class _Batch:
    """One batch: its documents' rows, and the row of its pieces and pairs."""

    def __init__(self, aligner: Aligner, column: pa.Array, with_groups: bool) -> None:
        data, offsets = buffers(column)
        size = np.diff(offsets)
        full = np.flatnonzero(size > 0)
        joined = np.insert(data, offsets[:-1][full], 0x20)
        starts = np.cumsum(size[full] + 1) - size[full] - 1
        at = pieces(joined, starts)
        edges = np.append(at, len(joined))
        values = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(joined)]).dictionary_encode()
        if len(aligner.known) > KNOWN_PIECES:
            aligner.forget()
        index = aligner.index(values.dictionary.to_pylist())
        held = values.indices.to_numpy()
        owner = np.searchsorted(starts, at, "right") - 1
        wrong = np.unique(owner[~aligner.exact[index[held]]])
        good = ~np.isin(owner, wrong)
        held, owner = held[good], owner[good]
        n = len(size)
        place = full[owner] if len(full) else owner
        self.stats = [np.bincount(place, aligner.stats[k][index[held]], n).astype(np.int64) for k in range(4)]
        edges = np.searchsorted(place, np.arange(n + 1)).tolist()
        number = index[held].tolist()
        texts = (";".join([aligner.groups[i] for i in number[lo:hi]]) for lo, hi in zip(edges[:-1], edges[1:], strict=True))
        self.digests, self.groups = [], []
        for text in texts:
            self.digests.append(sha256(text.encode()).hexdigest() if text else "")
            if with_groups:
                self.groups.append(text)
        # pieces of the documents that have tokens, numbered anew
        used, held = np.unique(held, return_inverse=True)
        index = index[used]
        both = np.sort(place * max(1, len(used)) + held)
        first = np.flatnonzero(np.diff(both, prepend=-1))
        both, times = both[first], np.diff(first, append=len(both))
        doc, piece = both // max(1, len(used)), both % max(1, len(used))
        self.pieces, self.times = _ints(piece, np.bincount(doc, minlength=n)), _ints(times, np.bincount(doc, minlength=n))
        sizes = aligner.pair_size[index]
        at = ragged(aligner.pair_start[index], sizes)
        pair, code = np.unique(aligner.pairs[at], return_inverse=True)
        begin = np.cumsum(sizes) - sizes
        docs = np.zeros(len(pair), np.int64)
        edges = np.searchsorted(doc, np.arange(0, n + _DOCS, _DOCS)).tolist()
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            many = sizes[piece[lo:hi]]
            linked = np.sort(np.repeat(doc[lo:hi], many) * max(1, len(pair)) + code[ragged(begin[piece[lo:hi]], many)])
            linked = linked[np.diff(linked, prepend=-1) != 0]
            docs += np.bincount(linked % max(1, len(pair)), minlength=len(pair))
        self.head = [pair >> 32, pair & 0xFFFFFFFF, docs, sizes, code, aligner.times[at]]


def _batches(parts: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Rows of texts in runs of about ``size`` bytes."""
    held: list[pa.RecordBatch] = []
    total = 0
    for part in parts:
        sizes = np.diff(buffers(part.column(1))[1])
        lo = 0
        for hi in range(part.num_rows):
            total += int(sizes[hi])
            if total >= size:
                yield pa.Table.from_batches([*held, part.slice(lo, hi + 1 - lo)])
                held, total, lo = [], 0, hi + 1
        if lo < part.num_rows:
            held.append(part.slice(lo))
    if held:
        yield pa.Table.from_batches(held)


def _encoded(docs: DataFrame, first: str, second: str, with_groups: bool, id_col: str, text_col: str) -> DataFrame:
    """Rows of documents, and for each batch one row (``head``) of its pieces and pairs."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(first, second)
        task = TaskContext.get().partitionId() << 32
        for k, table in enumerate(_batches(parts, BATCH)):
            table = table.combine_chunks()
            batch = _Batch(aligner, table.column(1).chunk(0), with_groups)
            n, ids = table.num_rows, table.column(0).chunk(0)
            empty = pa.array([None], _INTS)
            heads = [pa.array([x], _INTS) for x in batch.head]
            groups = pa.array(batch.groups or [None] * n, pa.string())
            columns = [pa.array([task + k] * n, pa.int64()), pa.array([False] * n), ids, *map(pa.array, batch.stats), pa.array(batch.digests, pa.string()), groups, batch.pieces, batch.times]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array([None] * n, _INTS)] * 6], names)
            blank = [pa.array([None], c.type) for c in columns[2:9]]
            yield pa.RecordBatch.from_arrays([columns[0][:1], pa.array([True]), *blank, empty, empty, *heads], names)
            del batch, table
            release()

    schema = f"batch long, head boolean, doc_id {rows.schema['doc_id'].dataType.simpleString()}, {_FIELDS}, {_BATCH_FIELDS}"
    names = [part.split()[0] for part in schema.split(", ")]
    return rows.mapInArrow(run, schema)


def _asked(encoded: DataFrame) -> DataFrame:
    """``batch, pair, first, second, docs``: the pairs of each batch, numbered from 0."""
    heads = encoded.where(F.col("head")).select("batch", F.arrays_zip("first", "second", "docs").alias("x"))
    return heads.select("batch", F.posexplode("x").alias("pair", "x")).select("batch", "pair", "x.first", "x.second", F.col("x.docs").alias("docs"))


def _summed(asked: DataFrame) -> DataFrame:
    """``first, second, docs, best`` over all batches."""
    salted = asked.withColumn("salt", F.pmod(F.xxhash64("batch"), F.lit(SALTS)))
    counts = salted.groupBy("first", "second", "salt").agg(F.sum("docs").alias("docs")).groupBy("first", "second").agg(F.sum("docs").alias("docs"))
    # one first id has at most as many pairs as the second vocabulary has entries
    return counts.withColumn("best", F.col("docs") == F.max("docs").over(Window.partitionBy("first")))


@dataclass(frozen=True)
class Aligned:
    """``documents``: the rows described at ``aligned``; ``pairs``: ``first, second, docs, best``."""

    documents: DataFrame
    pairs: DataFrame


def aligned(docs: DataFrame, first: str, second: str, with_groups: bool = False, id_col: str = "doc_id", text_col: str = "text") -> Aligned:
    """Align the tokens of a byte-level vocabulary file and of a piece model over each text.

    Documents have doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and,
    if asked for, groups as text. A pair's count is the number of documents that link it.
    """
    spark = docs.sparkSession
    with text_batches(spark):
        encoded = materialize(_encoded(docs, first, second, with_groups, id_col, text_col), "aligned")
    asked = _asked(encoded)
    pairs = materialize(_summed(asked), "pairs")
    found = asked.select("batch", "pair", "first", "second").join(pairs, ["first", "second"]).select(F.col("batch").alias("of"), "pair", "docs", "best")
    held = ["batch", "head", "doc_id", *[f.split()[0] for f in _FIELDS.split(", ")], "pieces", "times", "sizes", "pairs", "links"]
    out = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"]

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        head = left.filter(left["head"])
        rows = left.filter(pc.invert(left["head"])).combine_chunks()
        sizes, code, links = (head[c].combine_chunks().flatten().to_numpy() for c in ("sizes", "pairs", "links"))
        where = right["pair"].to_numpy()
        docs_of, best_of = np.zeros(len(where), np.int64), np.zeros(len(where), np.int64)
        docs_of[where], best_of[where] = right["docs"].to_numpy(), right["best"].to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        counts = np.diff(rows["pieces"].combine_chunks().offsets.to_numpy())
        piece, times = (rows[c].combine_chunks().flatten().to_numpy() for c in ("pieces", "times"))
        doc = np.repeat(np.arange(rows.num_rows), counts)
        sums = []
        for of in (best_of, docs_of):
            by_piece, by_doc = np.zeros(len(sizes), np.int64), np.zeros(rows.num_rows, np.int64)
            np.add.at(by_piece, owner, of[code] * links)
            np.add.at(by_doc, doc, by_piece[piece] * times)
            sums.append(pa.array(by_doc))
        values = {c: rows[c] for c in out if c in held} | {"n_best": sums[0], "count_sum": sums[1]}
        return pa.table({c: values[c] for c in out})

    kind = encoded.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string"
    rows = encoded.select(*held).groupBy("batch").cogroup(found.groupBy("of")).applyInArrow(finish, schema)
    return Aligned(rows if with_groups else rows.drop("groups"), pairs)
