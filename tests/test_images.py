"""Hysteresis edges, cosine spectra and moved boxes against plain loops."""

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from cadenza.operators import images


def flood(m, low, high):
    """Edges by a stack, from thinned strengths of one image."""
    out, todo = np.zeros(m.shape, bool), list(zip(*np.nonzero(m > high), strict=True))
    while todo:
        r, c = todo.pop()
        if out[r, c]:
            continue
        out[r, c] = True
        todo += [(a, b) for a in range(max(0, r - 1), min(m.shape[0], r + 2)) for b in range(max(0, c - 1), min(m.shape[1], c + 2)) if m[a, b] > low]
    return out


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 4), st.integers(3, 24), st.integers(3, 24))
def test_hysteresis_is_that_of_a_flood(seed, count, rows, columns):
    x = np.random.default_rng(seed).integers(0, 256, (count, rows, columns)).astype(float)
    got = images.edges(x, 300, 700)
    for one, found in zip(images.thinned(*images.gradients(x)), got, strict=True):
        assert np.array_equal(found, flood(one, 300, 700))


def test_a_long_winding_edge_is_one_component():
    weak = np.zeros((1, 65, 65), bool)
    for r in range(0, 65, 4):
        weak[0, r] = True
        weak[0, r : r + 5, 64 if r % 8 == 0 else 0] = True
    label = images._linked(weak)
    assert len(set(label[weak].tolist())) == 1


def test_gradients_of_a_step():
    x = np.zeros((1, 5, 6))
    x[:, :, 3:] = 100
    gx, gy = images.gradients(x)
    assert gx[0, 2].tolist() == [0, 0, 400, 400, 0, 0] and not gy.any()
    assert images.edges(x)[0].sum(axis=1).tolist() == [1] * 5  # thin: one pixel a row


def test_cosine_basis_is_orthonormal():
    for side in (8, 64):
        assert np.allclose(images.cosine_basis(side) @ images.cosine_basis(side).T, np.eye(side))


def test_tables_with_nulls_and_wrong_sizes(spark):
    rng = np.random.default_rng(1)
    rows = [(k, rng.integers(0, 256, 30).tolist() if k % 3 else None) for k in range(20)]
    df = spark.createDataFrame(rows, "k int, g array<int>").repartition(3)
    got = {r["k"]: r["all"] for r in images.edge_density(df, "g", (5, 6), {"all": (0, 0, 6, 5)}).collect()}
    for k, g in rows:
        want = None if g is None else images.edges(np.array([g], float).reshape(1, 5, 6)).mean()
        assert got[k] == (want if want is None else pytest.approx(want))
    with pytest.raises(Exception, match="pixels"):
        images.edge_density(df, "g", (6, 6), {"all": (0, 0, 6, 6)}).collect()
    big = spark.createDataFrame([(rng.random(64 * 64).tolist(),)], "x array<double>")
    share = images.high_frequency_share(big, "x", 64, "s").first()
    d = np.abs(images.cosine_basis(64) @ np.array(share["x"]).reshape(64, 64) @ images.cosine_basis(64).T)
    assert share["s"] == pytest.approx(d[32:, 32:].sum() / (d.sum() + 1e-6))


def test_moved_box(spark):
    rows = [("a", x, y, 5.0 if x >= 4 else 0.0, 2.0 if x >= 4 else 0.0, (0, 0, 10, 10)) for x in range(10) for y in range(10)]
    rows += [("few", x, y, 1.0, 1.0, (0, 0, 3, 3)) for x in range(4) for y in range(4)] + [("none", 9, 9, 1.0, 1.0, (0, 0, 2, 2))]
    df = spark.createDataFrame(rows, "e string, x int, y int, fx double, fy double, b struct<x1:int,y1:int,x2:int,y2:int>")
    got = {r["e"]: tuple(r)[1:] for r in images.propagated_boxes(df, "e", "x", "y", "fx", "fy", "b", 20, 20).collect()}
    assert got["few"] == (0, 0, 3, 3, 0.18) and got["none"] == (0, 0, 2, 2, 0.0)
    assert got["a"][:4] == (0, 0, 10, 10) and F is not None
