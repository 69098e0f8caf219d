"""Vector-valued running counts against one AUC a round."""

import numpy as np
import pytest

from cadenza.operators import ablation


def plain(keys, y, s, rounds=200):
    times = ablation._multiplicities(keys, rounds, 0)
    out = []
    for t in times.T:
        if not t.sum():
            continue
        p, n = t * (y == 1), t * (y == 0)
        values = np.unique(s)
        below = np.array([n[s < v].sum() + 0.5 * n[s == v].sum() for v in values])
        own = np.array([p[s == v].sum() for v in values])
        pairs = p.sum() * n.sum()
        out.append((own * below).sum() / pairs if pairs else 0.5)
    out.sort()
    return out[int(0.025 * rounds)], float(np.median(out)), out[int(0.975 * rounds)]


@pytest.mark.parametrize("kind", ["spread", "hot ties", "two scores"])
@pytest.mark.parametrize("limit", [20_000, 60])
def test_against_rounds(spark, kind, limit):
    rng = np.random.default_rng(3)
    n = 1200
    s = {"spread": rng.random(n), "hot ties": np.where(rng.random(n) < 0.4, 0.5, rng.random(n) * 1e-7), "two scores": (rng.random(n) < 0.3).astype(float)}[kind]
    y = (rng.random(n) < 0.3 + 0.4 * (s > np.median(s))).astype(int)
    rows = [(k, int(a), float(b)) for k, (a, b) in enumerate(zip(y, s, strict=True))]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)  # many vectors of one score
    try:
        r = ablation.bootstrap_auc(spark.createDataFrame(rows, "k long, y int, s double").repartition(6), "k", "y", "s", limit=limit).first()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert (r["low"], r["median"], r["high"]) == pytest.approx(plain([str(k) for k in range(n)], y, s), abs=1e-12)


def test_groups(spark):
    rng = np.random.default_rng(4)
    rows = [(k, int(rng.random() < 0.5), float(rng.random()), g) for k in range(150) for g in ("a", "b", None)]
    got = {r["g"]: r["median"] for r in ablation.bootstrap_auc(spark.createDataFrame(rows, "k long, y int, s double, g string"), "k", "y", "s", groups=["g"]).collect()}
    for g in ("a", "b", None):
        own = [r for r in rows if r[3] == g]
        want = plain([str(r[0]) for r in own], np.array([r[1] for r in own]), np.array([r[2] for r in own]))
        assert got[g] == pytest.approx(want[1], abs=1e-12)
