import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import ablation, graph, metrics, models, ranges, splits, thresholds


def scored(spark, pairs):
    return spark.createDataFrame([(int(y), float(s)) for y, s in pairs], "y int, s double")


def test_rates_of_known_counts(spark):
    df = spark.createDataFrame([(16, 12, 8, 4)], "tp int, tn int, fp int, fn int")
    r = metrics.rates(df).first()
    assert [round(r[c], 4) for c in ("accuracy", "precision", "recall", "specificity", "f1", "youden_j")] == [0.7, 0.6667, 0.8, 0.6, 0.7273, 0.4]


def test_auc_against_all_pairs(spark):
    rng = random.Random(1)
    for n in (1, 5, 60):
        pairs = [(rng.random() < 0.4, rng.randint(0, 9) / 10) for _ in range(n)]
        pos, neg = [s for y, s in pairs if y], [s for y, s in pairs if not y]
        want = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg]) if pos and neg else 0.5
        assert metrics.auc(scored(spark, pairs), "y", "s").first()[0] == pytest.approx(want)
        if pos and neg:
            assert metrics.auc_trapezoid(scored(spark, pairs), "y", "s").first()[0] == pytest.approx(want)


def test_abstentions_are_errors_for_both_classes(spark):
    df = scored(spark, [(1, 0.9), (1, 0.9), (0, 0.1), (0, 0.1)]).withColumn("a", F.col("s") > 0)
    r = metrics.at_threshold(df, "y", "s", 0.5, F.col("a")).first()
    assert (r["tp"], r["tn"], r["fp"], r["fn"], r["abstentions"]) == (0, 0, 2, 2, 4)


def test_curve_against_rescans(spark):
    rng = random.Random(2)
    pairs = [(rng.random() < 0.5, round(rng.random(), 2)) for _ in range(80)]
    df = scored(spark, pairs)
    for r in thresholds.confusion_curve(df, "y", "s", thresholds.candidates(df, "s")).collect():
        t = r["threshold"]
        assert r["tp"] == sum(y and s >= t for y, s in pairs) and r["fp"] == sum((not y) and s >= t for y, s in pairs)


def test_grids(spark):
    one = scored(spark, [(1, 0.4)])
    assert sorted(r[0] for r in thresholds.midpoint_grid(one, "s").collect()) == pytest.approx([0.4 - 1e-6, 0.4, 0.4 + 1e-6])
    assert [r[0] for r in thresholds.midpoint_grid(one.where("s > 1"), "s").collect()] == [0.5]
    assert thresholds.f1_grid(spark).collect()[10][0] == 0.15000000000000002


def test_simplex_sizes():
    assert (len(ablation.simplex(6)), len(ablation.simplex(5))) == (84, 56)


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (4, 5), (6, 6), (None, 7)], "u long, v long")
    got = {r["node"]: r["component"] for r in graph.connected_components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6}
    assert graph.connected_components(edges.where("u > 99")).count() == 0


def test_components_of_random_and_long_graphs(spark):
    rng = random.Random(4)
    pairs = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(1000 + k, 1001 + k) for k in range(60)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {x: find(x) for x in parent}


def test_source_groups_and_leaks(spark):
    m = spark.createDataFrame([("a_1.mp4", "001_002.mp4"), ("b_2.mp4", "002_003.mp4"), ("c_3.mp4", "010.mp4")], "filename string, original string")
    got = {r["filename"]: r["source_group"] for r in splits.source_groups(m).collect()}
    assert got == {"a_1.mp4": "001|002|003", "b_2.mp4": "001|002|003", "c_3.mp4": "010"}
    s = spark.createDataFrame([("g", "train"), ("g", "test"), ("h", "train")], "g string, split string")
    assert [tuple(r) for r in splits.leaking_groups(s, "g", "split").collect()] == [("g", ["test", "train"])]


def test_group_split_is_greedy_and_keeps_groups(spark):
    rng = random.Random(6)
    data = [(f"g{g}", int(rng.random() < 0.5)) for g in range(40) for _ in range(rng.choice([1, 1, 2, 4]))]
    df = spark.createDataFrame(data, "g string, y int")
    got = {r["g"]: r["split"] for r in splits.group_split(df, "g", "y").collect()}
    assert set(got) == {g for g, _ in data}
    sizes = {s: sum(got[g] == s for g, _ in data) for s in splits.ORDER}
    assert abs(sizes["validation"] - 0.2 * len(data)) <= 4 and abs(sizes["test"] - 0.2 * len(data)) <= 4
    shapes = {}
    for g in {g for g, _ in data}:
        p = sum(y for h, y in data if h == g)
        shapes.setdefault((p, sum(h == g for h, _ in data) - p), []).append(g)
    total = [sum(y for _, y in data), sum(1 - y for _, y in data)]
    goal = {"validation": [max(1, round(t * 0.2)) for t in total], "test": [max(1, round(t * 0.2)) for t in total]}
    goal["train"] = [t - a - b for t, a, b in zip(total, goal["validation"], goal["test"])]
    have = {s: [0, 0] for s in splits.ORDER}
    want = {}
    for shape in sorted(shapes, key=lambda s: (-sum(s), s)):
        for _ in shapes[shape]:
            cost = {s: sum(abs(goal[n][c] - have[n][c] - (shape[c] if n == s else 0)) for n in goal for c in (0, 1)) for s in splits.ORDER}
            pick = min(splits.ORDER, key=lambda s: (cost[s], splits.ORDER.index(s)))
            have[pick] = [h + a for h, a in zip(have[pick], shape)]
            want[shape, pick] = want.get((shape, pick), 0) + 1
    found = {}
    for shape, groups in shapes.items():
        for g in groups:
            found[shape, got[g]] = found.get((shape, got[g]), 0) + 1
    assert found == want


def test_small_classes_split(spark):
    df = spark.createDataFrame([(k, y) for y, n in enumerate((1, 2, 3, 10)) for k in range(100 * y, 100 * y + n)], "k int, y int")
    got = splits.stratified_split(df, "k", "y").groupBy("y", "split").count().collect()
    assert sorted(map(tuple, got)) == [(0, "train", 1), (1, "train", 1), (1, "validation", 1), (2, "test", 1), (2, "train", 1), (2, "validation", 1), (3, "test", 2), (3, "train", 6), (3, "validation", 2)]


def test_bundle_round_trip_and_scores(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3))
    y = (x[:, 0] - x[:, 1] + 0.3 * rng.normal(size=200) > 0).astype(int)
    df = spark.createDataFrame([(*map(float, a), int(b)) for a, b in zip(x, y)], "a double, b double, c double, y int")
    names = ["a", "b", "c"]
    st = models.column_statistics(df.withColumn("x", models.feature_array(names)), "x", 3)
    assert st["mean"] == pytest.approx(x.mean(axis=0).tolist())
    scaled = models.zscored(models.feature_array(names), st["mean"], st["std"])
    linear, mlp = models.fit_linear(df, scaled, "y"), models.fit_mlp(df, scaled, "y", 3, hidden=(8, 4), epochs=25, rate=0.2, drop=(0.0, 0.0))
    bundle = models.Bundle(names, st["mean"], st["std"], {"linear": linear, "mlp": mlp})
    bundle.save(spark, f"file://{tmp_path}/bundle")
    again = models.Bundle.load(spark, f"file://{tmp_path}/bundle")
    for name in ("linear", "mlp"):
        assert metrics.auc(again.score(df, name), "y", "probability").first()[0] > 0.85
    z = (x - x.mean(axis=0)) / (x.std(axis=0) + 1e-8)
    acts = z
    for k, (w, b) in enumerate(mlp["layers"]):
        acts = acts @ np.array(w).T + np.array(b)
        acts = np.maximum(acts, 0) if k < 2 else 1 / (1 + np.exp(-acts))
    got = [r[0] for r in again.score(df, "mlp").select("probability").collect()]
    assert got == pytest.approx(acts[:, 0].tolist(), abs=1e-9)


def test_registered_fits_keep_the_defaults(monkeypatch):
    from cadenza.plans import evaluation_queries as q

    class Called(Exception):
        pass

    for name in ("fit_gbt", "fit_mlp"):
        said = {}

        def fit(*args, said=said, **more):
            said.update(more)
            raise Called

        for other in ("feature_array", "leveled"):
            monkeypatch.setattr(q.models if other == "feature_array" else q, other, lambda *a: None)
        monkeypatch.setattr(q.models, name, fit)
        with pytest.raises(Called):
            getattr(q, name)(None, "")
        assert not {"rounds", "epochs"} & set(said)


def test_ranges_against_plain_sums(spark, monkeypatch):
    """Running sums, neighbours and ranks over many ranges, ties, nulls and NaN."""
    monkeypatch.setattr(ranges, "RANGES", 7)
    monkeypatch.setattr(ranges, "RANGE_ROWS", 5)
    rng = random.Random(2)
    values = sorted({rng.choice([rng.random(), rng.uniform(-3, 3)]) for _ in range(60)})
    rows = [(g, v, rng.randint(0, 5)) for g in ("a", "b", None) for v in [None, *values[::2], float("nan")]]
    df = spark.createDataFrame(rows, "g string, v double, n long")
    place = lambda v: (0, 0.0) if v is None else (2, 0.0) if v != v else (1, v)
    for falling in (False, True):
        for r in ranges.sums_before(df, "v", ["n"], ["g"], falling=falling).collect():
            own = [n for g, v, n in rows if g == r["g"] and ((place(v) > place(r["v"])) if falling else (place(v) < place(r["v"])))]
            assert r["before_n"] == sum(own)
    one = spark.createDataFrame([(v,) for v in values], "v double")
    got = sorted((r["v"], r["before"], r["after"]) for r in ranges.neighbours(one, "v").collect())
    assert got == list(zip(values, [None, *values], [*values[1:], None]))
    many = spark.createDataFrame([(k, k % 3 if k % 5 else None) for k in range(200)], "k long, y long")
    found = ranges.ranked(many, "y", splits.shuffled(many["k"]), "k").collect()
    for y in (0, 1, 2, None):
        own = sorted((hashlib.md5(f"{r['k']}:42".encode()).hexdigest(), r["__r"], r["__n"]) for r in found if r["y"] == y)
        assert [r for _, r, _ in own] == list(range(1, len(own) + 1)) and all(n == len(own) for _, _, n in own)


def test_repeated_keys_are_rows_of_their_own(spark):
    df = spark.createDataFrame([(1, 0), (1, 0), (1, 0), (2, 1), (3, 1)], "k long, y long")
    assert splits.stratified_split(df, "k", "y").count() == 5 and splits.floor_split(df, "k", "y").count() == 5


@pytest.mark.parametrize("tasks", [2, 12])
def test_components_over_many_rounds(spark, monkeypatch, tasks):
    """Paths and hubs that one task doesn't see as a whole."""
    monkeypatch.setattr(graph, "LEAST_TASKS", tasks)
    monkeypatch.setattr(graph, "ROWS_A_TASK", 20)
    rng = random.Random(4)
    path = rng.sample(range(120), 120)
    pairs = [*zip(path, path[1:]), *((900, k) for k in range(200, 280)), (300, 300), (301, 300), (310, 310)]
    parent = {x: x for e in pairs for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    df = spark.createDataFrame([*pairs, (None, 5), (5, None)], "u long, v long").repartition(12)
    got = {r["node"]: r["component"] for r in graph.connected_components(df).collect()}
    assert got == {x: find(x) for x in parent}


def test_official_split_and_its_fallback(spark):
    rows = spark.createDataFrame([(k, k // 2, k % 2) for k in range(40)], "k long, pair long, y long")
    good = spark.createDataFrame([(k, "train" if k < 20 else "test") for k in range(40)], "k long, split string")
    got = splits.official_split(rows, good, "k", "pair", "y").collect()
    assert {(r["k"], r["split"]) for r in got} == {(k, "train" if k < 20 else "test") for k in range(40)}
    for bad in (good.where("k > 0"), good.where("k <> 0").unionByName(spark.createDataFrame([(0, "test")], "k long, split string"))):
        made = splits.official_split(rows, bad, "k", "pair", "y").collect()
        assert len(made) == 40 and {r["strategy"] for r in made} == {"source_connected_group_split"}
        assert all(len({r["split"] for r in made if r["pair"] == p}) == 1 for p in range(20))


def test_index_split_checks_numbers_and_names(spark):
    rows = spark.createDataFrame([(k,) for k in range(5)], "i long")
    given = spark.createDataFrame([("0", "train"), ("1.0", " VAL "), ("2", "other"), ("-1", "test"), ("5", "test"), ("x", "test"), (None, "test")], "index string, split string")
    assert sorted(tuple(r) for r in splits.index_split(rows, given, "i").collect()) == [(0, "train"), (1, "validation")]
