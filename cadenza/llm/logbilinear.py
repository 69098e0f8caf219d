"""A log-bilinear language model over word classes, and the numbers it gives to whole texts.

A token's class is the token itself for the ``words`` most frequent ones and the end of a
text, else one of ``tails`` classes by the last letters of the word. The model predicts the
class from the two tokens before it: position weights times their vectors give a context
vector, and its products with the class vectors, plus biases, are the scores of all classes.
It is trained by noise-contrastive estimation, with the noise of a minibatch shared by its
tokens, so that a step is a few matrix products. Scoring normalises over all classes, again
by matrix products, once per different context of a batch.

A tail word's probability is that of its class times its share of the class's counts, each
count raised by one half, and one half is left for all unknown words of the class. So the
probabilities of all known words, the end and the unknown words of each class sum to one.

Counts cover all words of all training texts. Training goes over every training text once, in
a few rounds of growing size: each task trains on what it holds of a round's texts, starting
from the same parameters, and the changes are averaged row by row, weighted by how often a
task met the row. They are summed in tasks first, in a fixed order; the driver gets a handful
of rows. The parameters' size is fixed by ``words``, ``tails`` and ``size``.

Memory: a batch of about ``BATCH`` bytes of text, or one longer text. A batch asks for the
counts of its different tail words by a join, and the answers return to the batch by cogroup;
the vocabulary stays distributed.

Nulls: a null text is empty and has its end only; a document with a null id isn't held out. Ties among the most frequent words are settled by their bytes.
Repeated rows are learned and scored each. Without training texts every word is unknown. An
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from math import ceil, isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from ..sources.scratch import materialize
from .frames import text_batches
from .words import buffers, mixed, release

BATCH = 8 << 20
WORDS, TAILS, SIZE = 960, 64, 16
#: Shares of the training texts, of 16, that each round learns from, and its step size.
ROUNDS = ((1, 0.1), (4, 0.1), (11, 0.05))
_SHARES = 16
MINIBATCH, NOISE = 2048, 64
END = 0
_BLOCK = 4096


def held_out(doc_id: Column) -> Column:
    """Documents that the model doesn't learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


@dataclass
class Parameters:
    """Vectors of context classes, weights of the two places, vectors and biases of classes."""

    context: np.ndarray
    places: np.ndarray
    target: np.ndarray
    bias: np.ndarray

    @classmethod
    def first(cls, noise: np.ndarray, size: int) -> Parameters:
        """Small random vectors, and biases at which the model gives the noise distribution."""
        rng, n = np.random.default_rng(1), len(noise)
        return cls(rng.normal(0, 0.3, (n, size)), np.full((2, size), 0.7), rng.normal(0, 0.1, (n, size)), np.log(noise))

    def parts(self) -> list[np.ndarray]:
        return [self.context, self.places, self.target, self.bias[:, None]]

    def floats(self) -> Parameters:
        return Parameters(*(x.astype(np.float32) for x in (self.context, self.places, self.target, self.bias)))


def contexts(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The two tokens before each one; texts begin after ends."""
    out = np.full((2, len(ids)), END, np.int64)
    out[0, 1:], out[1, 2:] = ids[:-1], ids[:-2]
    out[:, starts] = END
    return out


class Trainer:
    """Minibatches of noise-contrastive estimation with steps divided by past gradients."""

    def __init__(self, start: Parameters, noise: np.ndarray, step: float, seed: int) -> None:
        self.p = start.floats()
        self.log_noise = (np.log(noise) + np.log(NOISE)).astype(np.float32)
        self.sums = np.cumsum(noise)
        self.step, self.rng = step, np.random.default_rng(seed)
        self.past = [np.full(x.shape, 1.0, np.float32) for x in self.p.parts()]
        self.met = [np.zeros(len(x), np.float64) for x in self.p.parts()]

    def _move(self, k: int, rows: np.ndarray, gradient: np.ndarray) -> None:
        """One step of part k: the gradients of equal rows are summed."""
        order = np.argsort(rows, kind="stable")
        rows = rows[order]
        edge = np.flatnonzero(np.diff(rows, prepend=-1))
        which = rows[edge]
        g = np.add.reduceat(gradient[order], edge, axis=0)
        self.past[k][which] += g * g
        self.p.parts()[k][which] -= self.step * g / np.sqrt(self.past[k][which])
        self.met[k][which] += np.diff(edge, append=len(rows))

    def learn(self, ids: np.ndarray, before: np.ndarray) -> None:
        for lo in range(0, len(ids), MINIBATCH):
            self._minibatch(ids[lo : lo + MINIBATCH], before[:, lo : lo + MINIBATCH])

    def _minibatch(self, ids: np.ndarray, before: np.ndarray) -> None:
        p = self.p
        noise = np.minimum(np.searchsorted(self.sums, self.rng.random(NOISE), "right"), len(self.sums) - 1)
        near, far = p.context[before[0]], p.context[before[1]]
        x = near * p.places[0] + far * p.places[1]
        own, other = p.target[ids], p.target[noise]
        true = np.einsum("ij,ij->i", x, own) + p.bias[ids] - self.log_noise[ids]
        g = -1 / (1 + np.exp(np.clip(true, -30, 30)))
        drawn = x @ other.T + (p.bias[noise] - self.log_noise[noise])
        h = 1 / (1 + np.exp(-np.clip(drawn, -30, 30)))
        back = g[:, None] * own + h @ other
        rows, move = np.concatenate([ids, noise]), np.concatenate([g[:, None] * x, h.T @ x])
        bias = np.concatenate([g, h.sum(0)])[:, None]
        places = np.stack([np.einsum("ij,ij->j", back, near), np.einsum("ij,ij->j", back, far)])
        self._move(0, before.ravel(), np.concatenate([back * p.places[0], back * p.places[1]]))
        self._move(1, np.arange(2), places)
        self._move(2, rows, move)
        self._move(3, rows, bias)
        self.met[1] += len(ids) - 1

    def change(self, start: Parameters) -> np.ndarray:
        """Changes times weights of all rows, then the weights, in one array."""
        changes = [(a.astype(np.float64) - b) * w[:, None] for a, b, w in zip(self.p.parts(), start.parts(), self.met, strict=True)]
        return np.concatenate([x.ravel() for x in (*changes, *self.met)])


def moved(start: Parameters, total: np.ndarray) -> Parameters:
    """The start plus the weighted mean of the changes, row by row."""
    parts = start.parts()
    at, out = 0, []
    weights = total[sum(x.size for x in parts) :]
    for x in parts:
        change, w = total[at : at + x.size].reshape(x.shape), weights[: len(x), None]
        out.append(x + change / np.maximum(w, 1))
        at, weights = at + x.size, weights[len(x) :]
    return Parameters(out[0], out[1], out[2], out[3][:, 0])


def log_probabilities(p: Parameters, ids: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Natural logarithms of the normalised probabilities of tokens after their contexts."""
    n = len(p.bias)
    key, which = np.unique(before[0] * n + before[1], return_inverse=True)
    f = p.floats()
    x = f.context[key // n] * f.places[0] + f.context[key % n] * f.places[1]
    total = np.zeros(len(key))
    for lo in range(0, len(key), _BLOCK):
        scores = x[lo : lo + _BLOCK] @ f.target.T
        scores += f.bias
        top = scores.max(1)
        scores -= top[:, None]
        np.exp(scores, out=scores)
        total[lo : lo + _BLOCK] = np.log(scores.sum(1, dtype=np.float64)) + top
    out = np.zeros(len(ids))
    for lo in range(0, len(ids), 16 * _BLOCK):
        k = slice(lo, lo + 16 * _BLOCK)
        out[k] = np.einsum("ij,ij->i", x[which[k]], f.target[ids[k]]) + f.bias[ids[k]]
    return np.minimum(out - total[which], 0)


def _tail_class(words: pa.Array) -> np.ndarray:
    """Class of each word by its last three bytes."""
    data, offsets = buffers(words)
    out, end = np.zeros(len(words), np.uint64), offsets[1:]
    for k in (1, 2, 3):
        here = end - k >= offsets[:-1]
        out[here] = out[here] * np.uint64(257) + data[end[here] - k] + np.uint64(1)
    return (mixed(out) % np.uint64(TAILS)).astype(np.int64)


def _split(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Different lower-cased words of texts, the number of each occurrence, and its document."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(column.fill_null("")))
    owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    values = lists.flatten()
    there = pc.greater(pc.binary_length(values), 0)
    found = values.filter(there).dictionary_encode()
    return found.dictionary, found.indices.to_numpy(), owner[there.to_numpy(zero_copy_only=False)]


def _batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose last column is a text, in runs of about ``BATCH`` bytes."""
    held: list[pa.RecordBatch] = []
    total = 0
    for part in parts:
        sizes, lo = np.diff(buffers(part.columns[-1])[1]), 0
        for hi, size in enumerate(sizes.tolist(), 1):
            total += size
            if total >= BATCH:
                yield pa.Table.from_batches([*held, part.slice(lo, hi - lo)]).combine_chunks().to_batches()[0]
                held, total, lo = [], 0, hi
        if lo < part.num_rows:
            held.append(part.slice(lo))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def word_counts(texts: DataFrame) -> DataFrame:
    """``word, tail, n`` over all rows of one column of texts."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(parts):
            words, code, _ = _split(batch.column(0))
            yield pa.RecordBatch.from_arrays([words, pa.array(_tail_class(words)), pa.array(np.bincount(code, minlength=len(words)))], ["word", "tail", "n"])
            del batch, words, code
            release()

    return texts.mapInArrow(count, "word string, tail long, n long").groupBy("word", "tail").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Counts of classes, the frequent words, and trained parameters.

    ``tokens`` and ``distinct`` describe all training tokens; ``class_counts`` has the count of
    each class and ``class_words`` of how many different words it is.
    """

    counts: DataFrame
    words: list[str]
    tokens: int
    distinct: int
    class_counts: np.ndarray
    class_words: np.ndarray
    parameters: Parameters = field(init=False)

    @property
    def noise(self) -> np.ndarray:
        raised = self.class_counts + 0.5
        return raised / raised.sum()

    def base_log(self) -> float:
        return float(np.log10(self.tokens + 0.5 * (self.distinct + 1)))

    def inside(self) -> np.ndarray:
        """By class: the logarithm taken off a tail word's raised count; zero for single words."""
        out = np.log10(self.class_counts + 0.5 * self.class_words + 0.5)
        out[: len(out) - TAILS] = 0
        return out


def counted(docs: DataFrame, words: int = WORDS) -> Model:
    """Counts over ``held_out, text`` rows that aren't held out."""
    own = docs.where(~F.col("held_out"))
    with text_batches(docs.sparkSession):
        counts = materialize(word_counts(own.select("text")), "word-counts")
    ends = own.count()
    top = counts.orderBy(F.desc("n"), "word").limit(words - 1).collect()
    class_counts, class_words = np.zeros(len(top) + 1 + TAILS), np.zeros(len(top) + 1 + TAILS)
    for r in counts.groupBy("tail").agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect():
        class_counts[len(top) + 1 + r["tail"]], class_words[len(top) + 1 + r["tail"]] = r["n"], r["words"]
    tokens, distinct = int(class_counts.sum()) + ends, int(class_words.sum()) + (ends > 0)
    for k, r in enumerate(top, 1):
        class_counts[k], class_words[k] = r["n"], 1
        class_counts[len(top) + 1 + r["tail"]] -= r["n"]
        class_words[len(top) + 1 + r["tail"]] -= 1
    class_counts[END], class_words[END] = ends, ends > 0
    return Model(counts, [r["word"] for r in top], tokens, distinct, class_counts, class_words)


_ENCODED = "held_out boolean, share int, ids binary, tail array<int>, words array<string>"


def encoded(docs: DataFrame, model: Model) -> DataFrame:
    """A row per document with the classes of its tokens and its tail words by number, and a
    row per batch (``share`` -1) with the batch's different tail words."""
    frequent = docs.sparkSession.sparkContext.broadcast(model.words)

    def encode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(frequent.value, pa.string())
        task = TaskContext.get().partitionId()
        for k, batch in enumerate(_batches(parts)):
            n = batch.num_rows
            words, code, owner = _split(batch.column(2))
            at = pc.index_in(words, value_set=known).fill_null(-1).to_numpy().astype(np.int64)
            tail = at < 0
            number = np.cumsum(tail) - 1
            ids = np.where(tail, len(known) + 1 + _tail_class(words), at + 1)
            # the end of each document follows its words
            size = np.bincount(owner, minlength=n)
            stops = np.cumsum(size + 1)
            line = np.full(len(code) + n, END, np.uint16)
            inner = np.ones(len(line), bool)
            inner[stops - 1] = False
            line[inner] = ids[code]
            edges = np.concatenate([[0], 2 * stops]).astype(np.int32)
            binary = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(edges), pa.py_buffer(line)])
            far = tail[code]
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner[far], minlength=n))]), pa.int32()), pa.array(number[code[far]], pa.int32())
            )
            share = np.random.default_rng(task << 20 | k).integers(0, _SHARES, n)
            name = pa.array([task << 32 | k] * n, pa.int64())
            yield pa.RecordBatch.from_arrays([name, batch.column(0), batch.column(1), pa.array(share, pa.int32()), binary, lists, pa.array([None] * n, pa.list_(pa.string()))], names)
            own = pa.ListArray.from_arrays(pa.array([0, int(tail.sum())], pa.int32()), words.filter(pa.array(tail)))
            blank = [pa.array([None], c.type) for c in (batch.column(0), batch.column(1))]
            yield pa.RecordBatch.from_arrays([name[:1], *blank, pa.array([-1], pa.int32()), pa.array([None], pa.binary()), pa.array([None], lists.type), own], names)
            del batch, words, code, owner, line, binary, lists
            release()

    schema = f"batch long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, {_ENCODED}"
    names = [part.split()[0] for part in schema.split(", ")]
    return docs.select("doc_id", "held_out", "text").mapInArrow(encode, schema)


def _lines(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows, one after the other, and where each row starts."""
    data, offsets = buffers(column)
    return np.frombuffer(data.tobytes(), np.uint16).astype(np.int64), offsets[:-1] // 2


def _sums(values: np.ndarray, starts: np.ndarray, rows: int) -> np.ndarray:
    """Sum of each row's values, in two levels so that rounding doesn't add up in long rows."""
    if not len(values):
        return np.zeros(rows)
    full = starts[np.diff(starts, append=len(values)) > 0]
    edges = np.unique(np.concatenate([full, np.arange(0, len(values), 512)]))
    owner = np.searchsorted(starts, edges, "right") - 1
    return np.bincount(owner, np.add.reduceat(values, edges), rows)


def _summed(rows: DataFrame) -> np.ndarray | None:
    """Sum of the arrays of rows ``task, change``, in tasks first and in the order of tasks."""

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first = None, None
        for part in parts:
            for task, change in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                first = task if first is None else first
                found = np.frombuffer(change.as_buffer(), np.float64)
                total = found.copy() if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([first]), pa.array([total.tobytes()], pa.binary())], ["task", "change"])

    parts = rows.rdd.getNumPartitions()
    while parts > 1:
        parts = min(isqrt(parts) + 1, ceil(parts / 2)) if parts > 4 else 1
        rows = rows.repartition(parts, "task").sortWithinPartitions("task").mapInArrow(add, "task long, change binary")
    found = rows.collect()
    return np.frombuffer(found[0]["change"], np.float64) if found else None


def train(rows: DataFrame, model: Model, rounds: tuple[tuple[int, float], ...] = ROUNDS, size: int = SIZE) -> Parameters:
    """Parameters after all rounds over the documents of ``encoded`` that aren't held out."""
    p, noise = Parameters.first(model.noise, size), model.noise
    context = rows.sparkSession.sparkContext
    low = 0
    for number, (shares, step) in enumerate(rounds):
        own = rows.where(~F.col("held_out") & (F.col("share") >= low) & (F.col("share") < low + shares)).select("ids")
        low += shares
        sent = context.broadcast(p)

        def learn(parts: Iterator[pa.RecordBatch], sent=sent, step=step, number=number) -> Iterator[pa.RecordBatch]:
            task = TaskContext.get().partitionId()
            trainer, any_rows = Trainer(sent.value, noise, step, task << 8 | number), False
            for part in parts:
                ids, starts = _lines(part.column(0))
                trainer.learn(ids, contexts(ids, starts))
                any_rows |= len(ids) > 0
            if any_rows:
                yield pa.RecordBatch.from_arrays([pa.array([task], pa.int64()), pa.array([trainer.change(sent.value).tobytes()], pa.binary())], ["task", "change"])

        total = _summed(own.mapInArrow(learn, "task long, change binary"))
        if total is not None:
            p = moved(p, total)
    return p


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """Learn from the documents that aren't held out, and score all.

    Gives doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    model = counted(rows, words)
    with text_batches(spark):
        lines = materialize(encoded(rows, model), "classes")
        model.parameters = train(lines, model)
    sent = spark.sparkContext.broadcast(model.parameters)
    raised, inside, single = np.log10(model.class_counts + 0.5), model.inside(), len(model.words) + 1
    known = model.class_counts > 0

    def score(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids, starts = _lines(part.column(3))
            owner = np.repeat(np.arange(part.num_rows), np.diff(starts, append=len(ids)))
            logs = log_probabilities(sent.value, ids, contexts(ids, starts)) / np.log(10) - inside[ids]
            n, alone = np.bincount(owner, minlength=part.num_rows), ids < single
            sums = [_sums(x, starts, part.num_rows) for x in (np.where(alone, raised[ids], 0), logs)]
            values = [pa.array(n), pa.array(np.bincount(owner, alone & known[ids], part.num_rows).astype(np.int64)), *map(pa.array, sums)]
            yield pa.RecordBatch.from_arrays([*part.columns[:3], *values, part.column(4)], names)
            release()

    kind = lines.schema["doc_id"].dataType.simpleString()
    schema = f"batch long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, own double, tail array<int>"
    names = [part.split()[0] for part in schema.split(", ")]
    own = lines.where(F.col("share") >= 0).select("batch", "doc_id", "held_out", "ids", "tail").mapInArrow(score, schema)
    asked = lines.where(F.col("share") < 0).select("batch", F.posexplode("words").alias("number", "word"))
    found = asked.join(model.counts.select("word", "n"), "word", "left").select(F.col("batch").alias("of"), "number", F.coalesce("n", F.lit(0)).alias("n"))
    tokens, base_log = model.tokens, model.base_log()

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.combine_chunks()
        counts = np.zeros(right.num_rows, np.int64)
        counts[right["number"].to_numpy()] = right["n"].to_numpy()
        lists = left["tail"].combine_chunks()
        size = pc.list_value_length(lists).to_numpy()
        owner = np.repeat(np.arange(left.num_rows), size)
        met = counts[lists.flatten().to_numpy()]
        logs = _sums(np.log10(met + 0.5), np.cumsum(size) - size, left.num_rows)
        more = np.bincount(owner, met > 0, left.num_rows).astype(np.int64)
        n = left["n_tokens"].to_numpy()
        values = [left["doc_id"], left["held_out"], left["n_tokens"], pa.array(left["n_known"].to_numpy() + more), pa.array(np.full(len(n), tokens, np.int64))]
        return pa.table([*values, pa.array(left["base"].to_numpy() + logs - n * base_log), pa.array(left["own"].to_numpy() + logs)], names=out)

    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    out = [part.split()[0] for part in schema.split(", ")]
    return own.groupBy("batch").cogroup(found.groupBy("of")).applyInArrow(finish, schema)
