"""Best-fit packing of tokenised documents by minimum bin slack.

Each bin starts with the longest piece left; a bitset subset-sum over the lengths left finds
the fullest combination for the rest of the bin, and that combination is removed. Only the
count of each length matters for this, at most ``capacity`` numbers, so the plan is made from
a histogram; a combination is removed as often as the counts allow at once, and each removal
uses up a length, so there are at most ``capacity`` combinations however many pieces there are.

Pieces meet their places by rank within their length. Equal rows (repeated rows, texts
without an id) are one row with a count. Ranks come from two levels: running counts within
(length, part), and the counts of the parts before. A part, by a hash of id, piece and token
ids, holds about ``PART_PIECES`` rows, also where ids are null or repeat; the windows over
parts have a row per part of a length.

Nulls: a null text is an empty document (the end id only); a null id is an id like any other.
Repeated rows are packed each. Only documents longer than ``capacity`` are cut. An empty
table gives no rows.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..sources.scratch import materialize
from .frames import copies, text_batches
from .words import SLICE, Texts, mixed, ragged, slices

CAPACITY = 4096
END_ID = 1
PART_PIECES = 2000
KNOWN_WORDS = 1 << 18


#: Kinds of bytes: 0 blank, 1 ASCII letter, 2 ASCII digit or mark, 3 all others, which join
#: their neighbours: bytes of longer characters, apostrophes (they start contractions) and
#: the characters of special tokens.
_KIND = np.full(256, 3, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[[c for c in range(33, 127) if not chr(c).isalpha() and chr(c) not in "'<|>"]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: The low n bytes of a 64-bit word, for n from 0 to 8.
_LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Words of one string, and strings of one call, for the tokenizer.
_JOINED = 500
_STRINGS = 8
#: Longer pieces are encoded anew in each slice.
_LONGEST = 64


class WordTokens:
    """Token ids of pieces of text, remembered per worker.

    Texts are cut at blanks and between an ASCII letter and an ASCII digit or mark: the
    tokenizer's own splits always fall there, so a text's ids are those of its pieces in
    order. It lower-cases, so pieces are known by their lower case. A piece of up to 16 bytes
    is known by two 64-bit words that hold its bytes, and its length; a longer one by its
    bytes in a dictionary. So pieces are told apart exactly. Pieces of letters only are one
    word of the tokenizer each and are encoded many at a time, told apart by the ids that end
    a word; other pieces are encoded one by one. At most ``KNOWN_WORDS`` pieces are
    remembered, then all are dropped.
    """

    def __init__(self, path: str) -> None:
        # Spark runs a task per core: threads of the tokenizer's own would only add their heaps
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.slots = np.full(KNOWN_WORDS * 4, -1, np.int32)
        self.known = np.zeros((3, KNOWN_WORDS), np.uint64)
        self.first = np.zeros(KNOWN_WORDS + 1, np.int64)
        self.count = 0
        self.ids = np.zeros(1 << 16, np.uint32)
        self.long: dict[bytes, int] = {}

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mixed(keys[0] ^ mixed(keys[1] + keys[2])) & np.uint64(len(self.slots) - 1)).astype(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each known short piece, else -1 (open addressing)."""
        out = np.full(keys.shape[1], -1, np.int64)
        left = np.arange(keys.shape[1])
        at = self._slot(keys)
        while len(left):
            held = self.slots[at]
            hit = held >= 0
            for own, asked in zip(self.known, keys, strict=True):
                hit &= own[held] == asked[left]
            out[left[hit]] = held[hit]
            go = (held >= 0) & ~hit
            left, at = left[go], (at[go] + 1) & (len(self.slots) - 1)
        return out

    def _encoded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each piece, one after the other, and how many each has."""
        plain = np.array([p.isalpha() and unicodedata.is_normalized("NFC", p) for p in pieces], bool)
        sizes = np.zeros(len(pieces), np.int64)
        found: dict[bool, np.ndarray] = {}
        at = np.flatnonzero(plain)
        ids = []
        for k in range(0, len(at), _JOINED * _STRINGS):
            part = at[k : k + _JOINED * _STRINGS].tolist()
            joined = [" ".join([pieces[i] for i in part[j : j + _JOINED]]) for j in range(0, len(part), _JOINED)]
            ids += [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)]
        found[True] = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        ends = np.flatnonzero(self.ends_word[found[True]])
        if len(ends) == len(at):
            sizes[at] = np.diff(np.concatenate([[-1], ends]))
        else:  # some letter isn't one to the tokenizer
            plain[:] = False
            found[True] = found[True][:0]
        at = np.flatnonzero(~plain)
        each = []
        for k in range(0, len(at), _JOINED):
            each += [e.ids for e in self.tokenizer.encode_batch_fast([pieces[i] for i in at[k : k + _JOINED].tolist()], add_special_tokens=False)]
        sizes[at] = [len(i) for i in each]
        found[False] = np.fromiter((x for i in each for x in i), np.uint32, int(sizes[at].sum()))
        begin = np.cumsum(sizes) - sizes
        out = np.zeros(int(sizes.sum()), np.uint32)
        for kind in (True, False):
            own = plain if kind else ~plain
            out[ragged(begin[own], sizes[own])] = found[kind]
        return out, sizes

    def _add(self, keys: np.ndarray, pieces: list[str]) -> None:
        """Remember short pieces (one column of ``keys`` each), then long ones."""
        flat, sizes = self._encoded(pieces)
        lo, n = self.first[self.count], len(pieces)
        while lo + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint32)])
        self.ids[lo : lo + len(flat)] = flat
        self.first[self.count + 1 : self.count + n + 1] = lo + np.cumsum(sizes)
        short = keys.shape[1]
        self.known[:, self.count : self.count + short] = keys
        new, at = np.arange(self.count, self.count + short), self._slot(keys)
        while len(new):
            free = self.slots[at] < 0
            self.slots[at[free]] = new[free]
            lost = self.slots[at] != new
            new, at = new[lost], (at[lost] + 1) & (len(self.slots) - 1)
        for k in range(short, n):
            self.long[pieces[k].encode()] = self.count + k
        self.count += n

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents of a slice and the number of ids up to each document."""
        if len(texts.offsets) == 2 and len(texts.data) > 2 * SLICE:
            # a document of many slices goes part by part, cut at blanks
            found, lo = [], 0
            while lo < len(texts.data):
                hi = min(lo + SLICE, len(texts.data))
                while hi < len(texts.data) and not len(blank := np.flatnonzero(_KIND[texts.data[hi : hi + SLICE]] == 0)):
                    hi = min(hi + SLICE, len(texts.data))
                if hi < len(texts.data):
                    hi += int(blank[0])
                found.append(self._encode(Texts(texts.data[lo:hi], np.array([0, hi - lo])))[0])
                lo = hi
            ids = np.concatenate(found)
            return ids, np.array([0, len(ids)])
        return self._encode(texts)

    def _encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        if not len(texts.data):
            return np.zeros(0, np.uint32), np.zeros(len(texts.offsets), np.int64)
        if not (texts.data == 60).any():  # "<" may begin a special token, whose case counts
            texts = Texts(_LOWER[texts.data], texts.offsets)
        starts, ends, upto = pieces(texts)
        padded = np.concatenate([texts.data, np.zeros(16, np.uint8)])
        found = [self._ids(padded, starts[k : k + KNOWN_WORDS], ends[k : k + KNOWN_WORDS]) for k in range(0, len(starts), KNOWN_WORDS)]
        ids = np.concatenate([np.zeros(0, np.uint32), *(i for i, _ in found)])
        return ids, np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *(n for _, n in found)]))])[upto]

    def _ids(self, padded: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of up to ``KNOWN_WORDS`` pieces, and how many each has."""
        size = ends - starts
        is_long = size > 16
        at, n = starts[~is_long], size[~is_long]
        eight = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
        keys = np.stack([eight[at] & _LOW[np.minimum(n, 8)], eight[at + 8] & _LOW[np.maximum(n - 8, 0)], n.astype(np.uint64)])
        text = padded.data
        long = [bytes(text[a:b]) for a, b in zip(starts[is_long].tolist(), ends[is_long].tolist(), strict=True)]
        short_at = self._find(keys)
        missing = short_at < 0
        fresh = keys[:, missing]
        order = np.lexsort(fresh)
        new = np.ones(len(order), bool)
        new[1:] = (fresh[:, order[1:]] != fresh[:, order[:-1]]).any(axis=0)
        unknown = [w for w in dict.fromkeys(long) if w not in self.long]
        kept = [w for w in unknown if len(w) <= _LONGEST]
        if self.count and self.count + int(new.sum()) + len(kept) > KNOWN_WORDS:
            self.forget()
            return self._ids(padded, starts, ends)
        first = np.flatnonzero(~is_long)[np.flatnonzero(missing)[order[new]]]
        if len(first) or kept:
            words = [bytes(text[a:b]) for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
            self._add(fresh[:, order[new]], [w.decode() for w in words + kept])
            short_at[missing] = self._find(fresh)
        once = [w for w in unknown if len(w) > _LONGEST]
        extra, extra_sizes = self._encoded([w.decode() for w in once])
        # pieces that aren't remembered stand behind those that are
        place = {w: len(self.first) - 1 + k for k, w in enumerate(once)}
        where = np.empty(len(starts), np.int64)
        where[~is_long] = short_at
        where[is_long] = [place[w] if w in place else self.long[w] for w in long]
        begin = np.concatenate([self.first[:-1], len(self.ids) + np.cumsum(extra_sizes) - extra_sizes])
        sizes = np.concatenate([np.diff(self.first), extra_sizes])[where]
        ids = np.concatenate([self.ids, extra]) if len(extra) else self.ids
        return ids[ragged(begin[where], sizes)], sizes


def pieces(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the pieces that are encoded apart, and their number up to each document."""
    kind = _KIND[texts.data]
    inner = texts.offsets[(texts.offsets > 0) & (texts.offsets < len(kind))]
    edge = np.empty(len(kind), bool)
    edge[0] = True
    edge[1:] = (kind[1:] + kind[:-1] == 3) & (kind[1:] != 3) & (kind[:-1] != 3) | (kind[:-1] == 0)
    edge[inner] = True
    starts = np.flatnonzero(edge & (kind > 0))
    stop = np.empty(len(kind), bool)
    stop[-1] = True
    stop[:-1] = edge[1:] | (kind[1:] == 0)
    return starts, np.flatnonzero(stop & (kind > 0)) + 1, np.searchsorted(starts, texts.offsets)


_TOKENS: dict[str, WordTokens] = {}


def _pieces(path: str, capacity: int, end_id: int):
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _TOKENS:
            _TOKENS[path] = WordTokens(path)
        tokens = _TOKENS[path]
        for batch in batches:
            for lo, hi, texts in slices(batch.column(1)):
                ids, upto = tokens.encode(texts)
                ids = np.insert(ids, upto[1:], end_id).astype("<u4")
                size = np.diff(upto) + 1
                begin = np.cumsum(size) - size
                n = -(-size // capacity)
                row = np.repeat(np.arange(hi - lo), n)
                piece = ragged(np.zeros(len(n), np.int64), n)
                start = piece * capacity
                length = np.minimum(capacity, size[row] - start)
                at = begin[row] + start
                view = memoryview(ids).cast("B")
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(lo + row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], names
                )

    return run


def tokenized_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of each document's ids with the end id."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        _pieces(tokenizer, capacity, end_id), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    )


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of available lengths with the largest sum within ``room``.

    A bitset of reachable sums grows length by length, the longest first; how often a length
    is used is split into powers of two.
    """
    reach, goal, steps = 1, 1 << room, []
    full = (1 << (room + 1)) - 1
    for length in sorted((n for n in counts if n <= room and counts[n]), reverse=True):
        left, chunk = min(counts[length], room // length), 1
        while left:
            chunk = min(chunk, left)
            steps.append((length, chunk, reach))
            reach |= (reach << (length * chunk)) & full
            left, chunk = left - chunk, chunk * 2
        if reach & goal:
            break
    total, used = reach.bit_length() - 1, {}
    for length, chunk, before in reversed(steps):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + chunk
            total -= length * chunk
    return used


def minimum_bin_slack(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Combinations and how often each is used, for so many pieces of each length."""
    counts = {n: k for n, k in counts.items() if k}
    plan = []
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        used = fullest(counts, capacity - longest)
        counts[longest] += 1
        used[longest] = used.get(longest, 0) + 1
        times = min(counts[n] // k for n, k in used.items())
        plan.append((used, times))
        for n, k in used.items():
            counts[n] -= k * times
            if not counts[n]:
                del counts[n]
    return plan


@dataclass(frozen=True)
class Places:
    """Where the pieces of each length go, by rank: at most capacity combinations, each with
    fewer than 1.5 * sqrt(capacity) + 1 different lengths."""

    lengths: np.ndarray
    upto: np.ndarray
    each: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.searchsorted(self.upto, (length << 40) + rank, "right") - 1
        inner = (length << 40) + rank - self.upto[order]
        return self.sequence[order] + inner // self.each[order], self.offset[order] + inner % self.each[order] * length


def places(plan: list[tuple[dict[int, int], int]]) -> Places:
    """The plan as ranges of ranks of each length."""
    rows, base = [], 0
    seen: dict[int, int] = {}
    for used, times in plan:
        offset = 0
        for length in sorted(used, reverse=True):
            rank = seen.get(length, 0)
            rows.append((length, (length << 40) + rank, used[length], base, offset))
            seen[length] = rank + used[length] * times
            offset += used[length] * length
        base += times
    table = np.array(sorted(rows, key=lambda r: r[1]), np.int64).reshape(-1, 5)
    return Places(*(np.ascontiguousarray(table[:, k]) for k in range(5)))


def packed(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    with text_batches(spark):
        pieces = materialize(tokenized_pieces(docs, tokenizer, capacity, end_id, id_col, text_col), "pieces")
    counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    where = spark.sparkContext.broadcast(places(minimum_bin_slack(counts, capacity)))
    parts = max(64, sum(counts.values()) // PART_PIECES)
    part = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts))
    # rows that are equal take any of their places, so they are ranked as one with a count
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    rows = pieces.groupBy(*names).agg(F.count("*").alias("n")).withColumn("part", part)
    sums = rows.groupBy("length", "part").agg(F.sum("n").alias("n"))
    ahead = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    sums = sums.select("length", "part", ahead.alias("ahead"))
    inner = F.sum("n").over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32", "start").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    ranked = rows.withColumn("inner", inner).join(sums, ["length", "part"])
    ranked = copies(ranked.withColumn("first", F.col("ahead") + F.col("inner")), "n", "copy", ["length", "first"])
    ranked = ranked.select(*names, (F.col("first") + F.col("copy")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 5))
            sequence, offset = where.value.of(length, rank)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"]
            )

    kind = pieces.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
