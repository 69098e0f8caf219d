"""The composed detector: findings and verdicts belong together."""

import random

from cadenza.operators import detector, scoring
from cadenza.plans.check_queries import SIGNALS
from cadenza.plans.registry import rounded

COLUMNS = ["rel", "a", "side", "c", "b", "light", "color", "detail", "asymmetry", "distance", "warp", "x0", "x1", "x2", "sharp", "back", "kurt", "wave", "block", "high", "back_high"]


def frames(spark):
    rng = random.Random(9)
    rows = []
    for v in range(8):
        for k in range(4 if v == 7 else 40):
            wild = v % 2
            values = {c: rng.random() * (3 if wild else 0.1) for c in COLUMNS} | {"rel": 0.1 if v == 6 else 0.95, "c": rng.choice([-1, 1]) * (1.0 if wild else 0.01)}
            rows.append((v, k, *[float(values[c]) for c in COLUMNS]))
    return spark.createDataFrame(rows, "v int, seq long, " + ", ".join(f"{c} double" for c in COLUMNS)).repartition(4)


def test_findings_and_verdicts(spark):
    motion = spark.createDataFrame([(v, 0.6 if v == 1 else 0.05, v == 1) for v in range(7)], "v int, l1 double, has_motion boolean")
    found = detector.detect(frames(spark), motion, "v", ["seq"], SIGNALS)
    verdicts = {r["v"]: r for r in found.verdicts.collect()}
    rows = found.findings.collect()
    assert set(verdicts) == set(range(8))
    for v, r in verdicts.items():
        own = [f for f in rows if f["v"] == v]
        assert r["types"] == sorted({f["violation_type"] for f in own}) and r["n_findings"] == len(own) == r["n_major"] + r["n_minor"]
        assert 0 <= r["score"] <= 1 and all(0 <= r[k] <= 1 for k in ("l1", "l2", "l3", "l4", "l5"))
        want = "INCONCLUSIVE" if r["reason"] else "AI_GENERATED" if r["score"] >= scoring.THRESHOLD else "AUTHENTIC"
        assert r["verdict"] == want and r["note"].startswith("Levels: L1=")
    assert verdicts[6]["reason"] == "weak_face_support"  # no frame is reliable
    assert "FACE_MOTION" in verdicts[1]["types"] and verdicts[7]["l1"] == 0.0  # no motion is known of it
    calm, wild = [[verdicts[v]["n_findings"] for v in own] for own in ((0, 2, 4), (1, 3, 5))]
    assert sum(wild) > sum(calm)
    dynamic = {v for v, r in verdicts.items() if {"FACE_MOTION", "RIGID_BODY"} & set(r["types"])}
    for f in rows:
        if f["violation_type"] in ("COLOR_DRIFT", "EDGE_INSTABILITY"):
            assert f["v"] in dynamic  # static findings need dynamic ones


def test_no_frames(spark):
    none = frames(spark).where("v < 0")
    motion = spark.createDataFrame([], "v int, l1 double, has_motion boolean")
    found = detector.detect(none, motion, "v", ["seq"], SIGNALS)
    assert found.verdicts.count() == 0 and found.findings.count() == 0


def test_a_task_sorts_the_frames_of_one_check(spark, monkeypatch):
    plans, write = {}, detector.materialize

    def written(df, label):
        plans.setdefault(label, []).append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, label)

    monkeypatch.setattr(detector, "materialize", written)
    motion = spark.createDataFrame([(1, 0.6, True), (99, 0.5, False)], "v int, l1 double, has_motion boolean")
    usual = detector.detect(frames(spark), motion, "v", ["seq"], SIGNALS)
    assert max(plan.count("Sort [") for own in plans.values() for plan in own) <= 8
    # a number of tasks that follows the number of frames gives the same rows
    monkeypatch.setattr(detector, "TASK_FRAMES", 20)
    assert detector.dealt(frames(spark), "v").rdd.getNumPartitions() == 15
    many = detector.detect(frames(spark), motion, "v", ["seq"], SIGNALS)
    order = lambda df: sorted(map(repr, rounded(df).collect()))
    assert order(usual.findings) == order(many.findings)
    got = usual.verdicts.collect()
    assert {r["v"] for r in got} == set(range(8)) and {r["v"]: r["l1"] for r in got}[1] == 0.6
    assert order(usual.verdicts) == order(many.verdicts)
