"""Synchronous mini-batch training of a perceptron (or, without hidden layers, of a logistic
regression) inside one Spark stage.

Barrier tasks hold their share of the rows, dealt by a hash of the key, and step together: each
sums the gradients of its rows of a batch, the tasks gather the sums of all, and all make the
same step. A batch is the rows whose hash of key and epoch falls to it, so batches are the same
however rows lie on tasks. After each epoch the tasks sum the validation losses; the parameters
with the least validation loss are kept. If a task fails the whole stage starts again.

The rows are written first. Each task keeps its rows as one array, so the number of tasks,
which all run at once, must suit the table. A gathering of all tasks takes about a second
whatever it sends, so batches are counted (``batches`` an epoch), not sized: a larger table has
larger batches and as many steps. A label must be 0 or 1; null features count as 0.
"""

from __future__ import annotations

from base64 import b64decode, b64encode
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame, functions as F

from ..sources.scratch import materialize

#: Of the keys' hashes, one in so many is for validation.
VALIDATION = 5
TINY = 1e-7


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that leaves no bit in place."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def batch_of(keys: np.ndarray, epoch: int, batches: int) -> np.ndarray:
    """The batch of each row (by its hash) in an epoch."""
    return (mixed(keys + np.uint64(epoch + 1)) % np.uint64(batches)).astype(np.int64)


def kept_units(keys: np.ndarray, epoch: int, layer: int, units: int, rate: float) -> np.ndarray:
    """Dropout: which units of a layer stay for each row, scaled by how many do."""
    if not rate:
        return np.ones((len(keys), units))
    salt = mixed(np.uint64(epoch) * np.uint64(1_000_003) + np.arange(units, dtype=np.uint64) * np.uint64(64) + np.uint64(layer))
    u = (mixed(keys[:, None] ^ salt[None, :]) >> np.uint64(11)) / float(1 << 53)
    return (u >= rate) / (1 - rate)


def initial(widths: tuple[int, ...], seed: int) -> list[np.ndarray]:
    """Weights and biases, layer by layer."""
    rng = np.random.default_rng(seed)
    out = []
    for k, (a, b) in enumerate(zip(widths, widths[1:], strict=False)):
        scale = np.sqrt(2 / a) if len(widths) > 2 else 0.05
        out += [rng.normal(size=(b, a)) * scale, np.zeros(b)]
    return out


def forward(x: np.ndarray, parameters: list[np.ndarray], masks: list[np.ndarray] | None = None) -> list[np.ndarray]:
    """Activations of all layers; the last are probabilities."""
    acts, layers = [x], len(parameters) // 2
    for k in range(layers):
        z = acts[-1] @ parameters[2 * k].T + parameters[2 * k + 1]
        if k < layers - 1:
            z = np.maximum(z, 0) * (masks[k] if masks else 1.0)
        else:
            z = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        acts.append(z)
    return acts


def losses(p: np.ndarray, y: np.ndarray) -> float:
    """Sum of the cross entropies."""
    return float(-(y * np.log(p + TINY) + (1 - y) * np.log(1 - p + TINY)).sum())


def gradients(x: np.ndarray, y: np.ndarray, parameters: list[np.ndarray], masks: list[np.ndarray]) -> tuple[list[np.ndarray], float]:
    """Sums of the gradients over rows, and of their losses."""
    acts = forward(x, parameters, masks)
    back, out = acts[-1] - y[:, None], [np.zeros(0)] * len(parameters)
    for k in reversed(range(len(parameters) // 2)):
        out[2 * k], out[2 * k + 1] = back.T @ acts[k], back.sum(axis=0)
        if k:
            back = (back @ parameters[2 * k]) * (acts[k] > 0) * masks[k - 1]
    return out, losses(acts[-1][:, 0], y)


def step_size(rate: float, epoch: int, epochs: int) -> float:
    return rate * 0.5 * (1 + np.cos(np.pi * epoch / max(1, epochs)))


@dataclass(frozen=True)
class Fit:
    """The best parameters (weights and biases, layer by layer), their epoch, and the losses:
    ``epoch, train_loss, val_loss, val_accuracy``."""

    parameters: list[np.ndarray]
    best_epoch: int
    curve: DataFrame

    def score_layers(self) -> list[tuple[list[list[float]], list[float]]]:
        p = self.parameters
        return [(p[k].tolist(), p[k + 1].tolist()) for k in range(0, len(p), 2)]


def _unpacked(flat: np.ndarray, like: list[np.ndarray]) -> list[np.ndarray]:
    at, out = 0, []
    for x in like:
        out.append(flat[at : at + x.size].reshape(x.shape))
        at += x.size
    return out


def fit(df: DataFrame, key: str, features: str, label: str, size: int, hidden: tuple[int, ...] = (64, 32, 16), epochs: int = 40, batches: int = 4, rate: float = 0.05, momentum: float = 0.9, decay: float = 1e-4, drop: tuple[float, ...] = (0.12, 0.08), seed: int = 42, tasks: int | None = None) -> Fit:
    """Train on all rows but those held for validation; see the module."""
    spark = df.sparkSession
    tasks = tasks or min(4, spark.sparkContext.defaultParallelism)
    rows = materialize(df.select(F.xxhash64(key).alias("k"), F.transform(features, lambda x: F.coalesce(x.cast("double"), F.lit(0.0))).alias("x"), F.col(label).cast("double").alias("y")), "training-rows")
    start = initial((size, *hidden, 1), seed)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = BarrierTaskContext.get()
        held = [p for p in parts if p.num_rows]
        keys = np.concatenate([np.zeros(0, np.int64), *(p.column(0).to_numpy() for p in held)]).view(np.uint64)
        x = np.concatenate([np.zeros((0, size)), *(p.column(1).flatten().to_numpy().reshape(-1, size) for p in held)])
        y = np.concatenate([np.zeros(0), *(p.column(2).to_numpy() for p in held)])
        aside = keys % np.uint64(VALIDATION) == 0

        def together(values: np.ndarray) -> np.ndarray:
            """The sum over all tasks, in the order of tasks."""
            found = context.allGather(b64encode(values.astype("<f8").tobytes()).decode())
            return np.sum([np.frombuffer(b64decode(f), "<f8") for f in found], axis=0)

        p = [a.copy() for a in start]
        speed, best, best_loss = [np.zeros_like(a) for a in p], [a.copy() for a in p], np.inf
        curve, best_epoch = [], 0
        for epoch in range(epochs):
            batch, now, loss_sum, loss_rows = batch_of(keys, epoch, batches), step_size(rate, epoch, epochs), 0.0, 0.0
            for b in range(batches):
                own = np.flatnonzero((batch == b) & ~aside)
                masks = [kept_units(keys[own], epoch, k, units, drop[k] if k < len(drop) else 0.0) for k, units in enumerate(hidden)]
                grads, loss = gradients(x[own], y[own], p, masks)
                total = together(np.concatenate([*(g.ravel() for g in grads), [loss, len(own)]]))
                n = max(1.0, total[-1])
                for k, g in enumerate(_unpacked(total, p)):
                    g = g / n + (decay * p[k] if p[k].ndim == 2 else 0.0)
                    speed[k] = momentum * speed[k] - now * g
                    p[k] = p[k] + speed[k]
                loss_sum, loss_rows = loss_sum + total[-2], loss_rows + total[-1]
            found = forward(x[aside], p)[-1][:, 0]
            val = together(np.array([losses(found, y[aside]), ((found >= 0.5) == (y[aside] == 1)).sum(), aside.sum()]))
            val_loss = val[0] / max(1.0, val[2])
            curve.append((epoch, loss_sum / max(1.0, loss_rows), val_loss, val[1] / max(1.0, val[2])))
            if val_loss < best_loss:
                best, best_loss, best_epoch = [a.copy() for a in p], val_loss, epoch
        if context.partitionId() == 0:
            flat = np.concatenate([a.ravel() for a in best]).tobytes()
            columns = [pa.array(c, t) for c, t in zip(zip(*curve, strict=True), (pa.int64(), *[pa.float64()] * 3), strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([flat if e == best_epoch else None for e, *_ in curve], pa.binary())], ["epoch", "train_loss", "val_loss", "val_accuracy", "best"])

    dealt = rows.repartition(tasks, "k").sortWithinPartitions("k", "y")
    found = dealt.mapInArrow(run, "epoch long, train_loss double, val_loss double, val_accuracy double, best binary", barrier=True).collect()
    best = next(r for r in found if r["best"] is not None)
    curve = spark.createDataFrame([tuple(r)[:4] for r in sorted(found)], "epoch long, train_loss double, val_loss double, val_accuracy double")
    return Fit([a.copy() for a in _unpacked(np.frombuffer(best["best"], "<f8"), start)], best["epoch"], curve)

