"""Barrier training against a NumPy loop over the same batches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import models, training


def rows_of(spark, n=600, size=5):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(n, size))
    y = (x[:, 0] * x[:, 1] + 0.3 * x[:, 2] > 0).astype(int)
    return spark.createDataFrame([(k, x[k].tolist(), int(y[k])) for k in range(n)], "k long, x array<double>, y int").repartition(5)


def loop(df, size, hidden, epochs, batches, rate=0.05, momentum=0.9, decay=1e-4, drop=(0.12, 0.08), seed=42):
    """The same on one machine: all rows of a batch at once."""
    found = df.select(F.xxhash64("k").alias("h"), "x", "y").collect()
    keys = np.array([r["h"] for r in found], np.int64).view(np.uint64)
    x, y = np.array([r["x"] for r in found]), np.array([float(r["y"]) for r in found])
    aside = keys % np.uint64(5) == 0
    p = training.initial((size, *hidden, 1), seed)
    speed, curve, best = [np.zeros_like(a) for a in p], [], (np.inf, None, None)
    for epoch in range(epochs):
        batch, sums = training.batch_of(keys, epoch, batches), [0.0, 0]
        for b in range(batches):
            own = (batch == b) & ~aside
            masks = [training.kept_units(keys[own], epoch, k, u, drop[k] if k < len(drop) else 0.0) for k, u in enumerate(hidden)]
            grads, loss = training.gradients(x[own], y[own], p, masks)
            sums[0] += loss
            sums[1] += int(own.sum())
            for k, g in enumerate(grads):
                g = g / max(1, own.sum()) + (decay * p[k] if p[k].ndim == 2 else 0)
                speed[k] = momentum * speed[k] - training.step_size(rate, epoch, epochs) * g
                p[k] = p[k] + speed[k]
        out = training.forward(x[aside], p)[-1][:, 0]
        val = training.losses(out, y[aside]) / aside.sum()
        curve.append((epoch, sums[0] / sums[1], val, ((out >= 0.5) == (y[aside] == 1)).mean()))
        if val < best[0]:
            best = (val, epoch, [a.copy() for a in p])
    return curve, best


@pytest.mark.parametrize("hidden", [(), (8, 4)])
@pytest.mark.parametrize("tasks", [1, 3])
def test_equal_to_a_loop(spark, hidden, tasks):
    df = rows_of(spark)
    got = training.fit(df, "k", "x", "y", 5, hidden, epochs=2, batches=3, tasks=tasks)
    curve, best = loop(df, 5, hidden, 2, 3)
    assert np.allclose([tuple(r) for r in got.curve.orderBy("epoch").collect()], curve, atol=1e-10)
    assert got.best_epoch == best[1] and all(np.allclose(a, b, atol=1e-10) for a, b in zip(got.parameters, best[2], strict=True))


def test_gradients_against_differences():
    rng = np.random.default_rng(7)
    x, y = rng.normal(size=(9, 4)), rng.integers(0, 2, 9).astype(float)
    p = [a + 0.3 * rng.normal(size=a.shape) for a in training.initial((4, 3, 2, 1), 1)]
    masks = [training.kept_units(np.arange(9, dtype=np.uint64), 0, k, u, 0.2) for k, u in enumerate((3, 2))]
    grads, _ = training.gradients(x, y, p, masks)
    for k, a in enumerate(p):
        for at in np.ndindex(a.shape):
            step = 1e-6
            a[at] += step
            up = training.losses(training.forward(x, p, masks)[-1][:, 0], y)
            a[at] -= 2 * step
            down = training.losses(training.forward(x, p, masks)[-1][:, 0], y)
            a[at] += step
            assert grads[k][at] == pytest.approx((up - down) / (2 * step), abs=1e-4)


def test_learns_and_scores_in_the_query(spark):
    df = rows_of(spark, 1500)
    got = training.fit(df, "k", "x", "y", 5, (16,), epochs=12, batches=1, rate=0.5, drop=())
    scored = df.withColumn("p", models.mlp_score(F.col("x"), got.score_layers()))
    r = scored.agg(F.avg(((F.col("p") >= 0.5) == (F.col("y") == 1)).cast("int"))).first()[0]
    x = np.array([r["x"] for r in df.orderBy("k").collect()])
    same = [r["p"] for r in scored.orderBy("k").collect()]
    assert r > 0.6 and np.allclose(same, training.forward(x, got.parameters)[-1][:, 0], atol=1e-9)
    curve = got.curve.orderBy("val_loss").first()
    assert curve["epoch"] == got.best_epoch


def test_empty_batches_and_few_rows(spark):
    got = training.fit(rows_of(spark, 7), "k", "x", "y", 5, (), epochs=1, batches=5, tasks=4)
    assert got.curve.count() == 1
