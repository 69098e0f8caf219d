"""Queries over scored rows: metrics, thresholds, ablations, splits, models."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import scalars
from ..operators import ablation, evidence, graph, metrics, models, scoring, splits, thresholds, training
from ..sources import ingest, reports, sinks
from .registry import query, rounded
from .views import EV, LEVEL_FEATURES, LV, SC, TL, leveled, scored, table, timeline, vectors

CUT = 0.1


def _auc(rows: str, groups: str = "") -> str:
    """SQL for the tie-aware area of rows y, s with optional group columns."""
    g = groups + ", " if groups else ""
    part = f"PARTITION BY {groups} " if groups else ""
    tail = f" GROUP BY {groups}" if groups else ""
    return (
        f"SELECT {g}CASE WHEN sum(p) * sum(n) > 0 THEN sum(p * (b + 0.5::DOUBLE * n)) / (sum(p) * sum(n)::DOUBLE) ELSE 0.5::DOUBLE END AS auc FROM ("
        f"SELECT {g}p, n, coalesce(sum(n) OVER ({part}ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM (SELECT {g}s, sum((y = 1)::INT) AS p, sum((y = 0)::INT) AS n FROM {rows} GROUP BY {g}s)){tail}"
    )


#: Rates of a confusion table in SQL.
RATES = (
    "(tp + tn) / greatest(tp + tn + fp + fn, 1)::DOUBLE AS accuracy, tp / (tp + fp + 1e-9) AS precision, tp / (tp + fn + 1e-9) AS recall, tn / (tn + fp + 1e-9) AS specificity, "
    "2 * (tp / (tp + fp + 1e-9)) * (tp / (tp + fn + 1e-9)) / (tp / (tp + fp + 1e-9) + tp / (tp + fn + 1e-9) + 1e-9) AS f1, "
    "0.5 * (tp / (tp + fn + 1e-9) + tn / (tn + fp + 1e-9)) AS balanced_accuracy, tp / (tp + fn + 1e-9) + tn / (tn + fp + 1e-9) - 1.0 AS youden_j"
)
_R = "round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(specificity, 6) AS specificity, round(f1, 6) AS f1, round(balanced_accuracy, 6) AS balanced_accuracy, round(youden_j, 6) AS youden_j"


def _confusion(test: str, away: str = "false") -> str:
    n = "count(*) FILTER (WHERE {})".format
    return (
        n(f"y = 1 AND {test} AND NOT ({away})") + " AS tp, " + n(f"y = 0 AND NOT ({test}) AND NOT ({away})") + " AS tn, "
        + n(f"y = 0 AND ({test} OR {away})") + " AS fp, " + n(f"y = 1 AND (NOT ({test}) OR {away})") + " AS fn"
    )


@query(f"WITH {SC} SELECT round(auc, 6) AS auc FROM ({_auc('sc')})")
def auc_overall(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.auc(scored(spark, d), "y", "s"))


@query(f"WITH {SC} SELECT lang, round(auc, 6) AS auc FROM ({_auc('sc', 'lang')})")
def auc_by_group(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.auc(scored(spark, d), "y", "s", ["lang"]))


@query(f"WITH {SC} SELECT source, round(CASE WHEN min(y) = max(y) THEN 0 ELSE a.auc END, 6) AS auc FROM ({_auc('sc', 'source')}) a JOIN sc USING (source) GROUP BY source, a.auc")
def auc_trapezoid(spark: SparkSession, d: str) -> DataFrame:
    """Trapezoid area by source; 0 where one class is missing."""
    return rounded(metrics.auc_trapezoid(scored(spark, d), "y", "s", ["source"]))


@query(f"WITH {SC}, c AS (SELECT {_confusion('s >= 0.1')} FROM sc) SELECT tp, tn, fp, fn, {_R} FROM (SELECT *, {RATES} FROM c)")
def confusion_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.at_threshold(scored(spark, d), "y", "s", CUT))


@query(f"WITH {SC}, c AS (SELECT toxic, {_confusion('s > 0.1')} FROM sc GROUP BY toxic) SELECT toxic, tp, tn, fp, fn, {_R} FROM (SELECT *, {RATES} FROM c)")
def model_metrics_strict(spark: SparkSession, d: str) -> DataFrame:
    """Metrics with a strict threshold, by group."""
    return rounded(metrics.at_threshold(scored(spark, d), "y", "s", CUT, groups=["toxic"], strict=True))


@query(
    f"WITH {SC}, c AS (SELECT {_confusion('s >= 0.1', 'n_chars < 300')}, count(*) FILTER (WHERE n_chars < 300) AS abstentions, count(*) FILTER (WHERE n_chars < 300 AND y = 1) AS abstentions_positive, count(*) FILTER (WHERE n_chars < 300 AND y = 0) AS abstentions_negative, "
    f"round(avg((n_chars < 300)::INT), 6) AS abstention_rate FROM sc) SELECT tp, tn, fp, fn, abstentions, abstentions_positive, abstentions_negative, abstention_rate, {_R} FROM (SELECT *, {RATES} FROM c)"
)
def abstention_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Metrics where short texts abstain."""
    return rounded(metrics.at_threshold(scored(spark, d), "y", "s", CUT, F.col("n_chars") < 300))


@query(
    f"WITH {SC}, c AS (SELECT source, count(*) AS count, count(*) FILTER (WHERE y = 1) AS positives, count(*) FILTER (WHERE y = 0) AS negatives, avg(s) AS mean_score, min(s) AS min_score, max(s) AS max_score, avg((s >= 0.1)::INT) AS predicted_rate, {_confusion('s >= 0.1')} FROM sc GROUP BY source), "
    f"r AS (SELECT *, {RATES} FROM c), a AS ({_auc('sc', 'source')}) "
    "SELECT r.source, count, positives, negatives, round(mean_score, 6) AS mean_score, round(min_score, 6) AS min_score, round(max_score, 6) AS max_score, round(predicted_rate, 6) AS predicted_rate, round(accuracy, 6) AS accuracy, "
    "CASE WHEN positives > 0 AND negatives > 0 THEN round(auc, 6) END AS auc, CASE WHEN positives > 0 AND negatives > 0 THEN round(f1, 6) END AS f1, CASE WHEN positives > 0 AND negatives > 0 THEN round(balanced_accuracy, 6) END AS balanced_accuracy, "
    "CASE WHEN positives > 0 AND negatives > 0 THEN 'mixed' WHEN positives > 0 THEN 'all_ai' ELSE 'all_auth' END AS label_mode FROM r JOIN a ON r.source = a.source"
)
def metrics_by_category(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.by_category(scored(spark, d), "source", "y", "s", CUT))


@query(
    f"WITH {SC}, c AS (SELECT {_confusion('s >= 0.1')}, coalesce(avg(CASE WHEN y = 1 THEN s END), 0) AS mean_positive, coalesce(avg(CASE WHEN y = 0 THEN s END), 0) AS mean_negative FROM sc), r AS (SELECT *, mean_positive - mean_negative AS score_gap, {RATES} FROM c) "
    "SELECT round(specificity, 6) AS specificity, round(recall, 6) AS recall, round(balanced_accuracy, 6) AS balanced_accuracy, round(score_gap, 6) AS score_gap, round(mean_positive, 6) AS mean_positive, round(mean_negative, 6) AS mean_negative, "
    "specificity + 1e-9 >= 0.60 AS specificity_passes, recall + 1e-9 >= 0.65 AS recall_passes, balanced_accuracy + 1e-9 >= 0.65 AS balanced_accuracy_passes, score_gap + 1e-9 >= 0.08 AS score_gap_passes, "
    "specificity + 1e-9 >= 0.60 AND recall + 1e-9 >= 0.65 AND balanced_accuracy + 1e-9 >= 0.65 AND score_gap + 1e-9 >= 0.08 AS all_passed FROM r"
)
def acceptance_gate(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.acceptance(scored(spark, d), "y", "s", CUT))


@query(f"WITH {SC}, v AS (SELECT CASE WHEN n_chars < 300 THEN 'INCONCLUSIVE' WHEN s >= 0.1 THEN 'AI_GENERATED' ELSE 'AUTHENTIC' END AS v, s FROM sc) SELECT count(*) AS total, count(*) FILTER (WHERE v = 'AI_GENERATED') AS ai_generated, count(*) FILTER (WHERE v = 'AUTHENTIC') AS authentic, count(*) FILTER (WHERE v = 'INCONCLUSIVE') AS inconclusive, round(avg(s), 6) AS mean_score FROM v")
def batch_summary(spark: SparkSession, d: str) -> DataFrame:
    v = F.when(F.col("n_chars") < 300, "INCONCLUSIVE").when(F.col("s") >= CUT, "AI_GENERATED").otherwise("AUTHENTIC")
    return rounded(metrics.batch_summary(scored(spark, d).withColumn("v", v), "v", "s"))


_CAND = f"""{SC}, u AS (SELECT DISTINCT {'least(greatest(s, 0.0::DOUBLE), 1.0::DOUBLE)'} AS s FROM sc), l AS (SELECT s, lead(s) OVER (ORDER BY s) AS n FROM u),
 cand AS (SELECT DISTINCT t FROM (SELECT greatest(0.0::DOUBLE, s - 1e-6) AS t FROM l UNION ALL SELECT least(1.0::DOUBLE, s + 1e-6) FROM l UNION ALL SELECT (s + n) * 0.5::DOUBLE FROM l WHERE n IS NOT NULL UNION ALL SELECT unnest([0.0::DOUBLE, 0.5::DOUBLE, 1.0::DOUBLE])))"""
_GRID = f"""{SC}, u AS (SELECT DISTINCT s FROM sc), l AS (SELECT s, lag(s) OVER (ORDER BY s) AS p, lead(s) OVER (ORDER BY s) AS n FROM u),
 cand AS (SELECT DISTINCT t FROM (SELECT greatest(0.0::DOUBLE, s - 1e-6) AS t FROM l WHERE p IS NULL UNION ALL SELECT least(1.0::DOUBLE, s + 1e-6) FROM l WHERE n IS NULL UNION ALL SELECT (s + n) / 2.0::DOUBLE FROM l WHERE n IS NOT NULL UNION ALL SELECT s FROM l WHERE p IS NULL AND n IS NULL))"""


@query(f"WITH {_CAND} SELECT round(t, 9) AS threshold FROM cand")
def threshold_candidates(spark: SparkSession, d: str) -> DataFrame:
    return rounded(thresholds.candidates(scored(spark, d), "s"), 9)


@query(f"WITH {_GRID} SELECT round(t, 9) AS threshold FROM cand")
def midpoint_grid(spark: SparkSession, d: str) -> DataFrame:
    return rounded(thresholds.midpoint_grid(scored(spark, d), "s"), 9)


def _curve(away: str = "false") -> str:
    return f"cu AS (SELECT t AS threshold, {_confusion('s >= t', away)} FROM cand CROSS JOIN sc GROUP BY t), ra AS (SELECT *, {RATES} FROM cu)"


def _tiers(spec: float, rec: float) -> str:
    return f"ti AS (SELECT *, CASE WHEN specificity + 1e-9 >= {spec} AND recall + 1e-9 >= {rec} THEN 2 WHEN specificity + 1e-9 >= {spec} THEN 1 ELSE 0 END AS tier FROM ra)"


def _pick(orders: dict[int, list[str]], width: int) -> str:
    keys = []
    for k in range(width):
        cases = []
        for tier, names in orders.items():
            value = f"round({names[k]}, 12)" if k < len(names) else "-abs(threshold - 0.5)" if k == len(names) else "0"
            cases.append(f"WHEN tier = {tier} THEN {value}")
        keys.append("CASE " + " ".join(cases) + " END DESC")
    return "tier DESC, " + ", ".join(keys) + ", threshold"


_OUT = f"round(threshold, 9) AS threshold, tp, tn, fp, fn, {_R}"


@query(f"WITH {_CAND}, {_curve()}, {_tiers(0.4, 0.3)} SELECT {_OUT}, tier FROM ti ORDER BY {_pick({2: ['balanced_accuracy', 'f1', 'recall', 'specificity'], 1: ['balanced_accuracy', 'specificity', 'f1', 'recall'], 0: ['specificity', 'recall', 'balanced_accuracy']}, 5)} LIMIT 1")
def specificity_first_threshold(spark: SparkSession, d: str) -> DataFrame:
    return _threshold(thresholds.specificity_first(scored(spark, d), "y", "s", 0.4, 0.3))


@query(f"WITH {_GRID}, {_curve('n_chars < 300')}, {_tiers(0.5, 0.9)} SELECT {_OUT}, tier FROM ti ORDER BY {_pick({2: ['balanced_accuracy', 'f1', 'youden_j', 'recall'], 1: ['balanced_accuracy', 'specificity', 'f1', 'youden_j', 'recall'], 0: ['specificity', 'balanced_accuracy', 'recall']}, 6)} LIMIT 1")
def tuned_threshold(spark: SparkSession, d: str) -> DataFrame:
    """Detector threshold with abstentions."""
    return _threshold(thresholds.tuned_detector(scored(spark, d), "y", "s", 0.5, 0.9, F.col("n_chars") < 300))


@query(f"WITH {_GRID}, {_curve()} SELECT {_OUT} FROM ra ORDER BY round(balanced_accuracy, 12) DESC, round(youden_j, 12) DESC, round(f1, 12) DESC, round(accuracy, 12) DESC, -abs(threshold - 0.5) DESC, threshold LIMIT 1")
def best_balanced_threshold(spark: SparkSession, d: str) -> DataFrame:
    return _threshold(thresholds.balanced_first(scored(spark, d), "y", "s"))


@query(f"WITH {_CAND}, {_curve()} SELECT {_OUT} FROM ra ORDER BY round(youden_j, 12) DESC, threshold LIMIT 1")
def youden_threshold(spark: SparkSession, d: str) -> DataFrame:
    return _threshold(thresholds.youden(scored(spark, d), "y", "s"))


@query(f"WITH {SC}, cand AS (SELECT 0.05::DOUBLE + k * ((0.05::DOUBLE + 0.01::DOUBLE) - 0.05::DOUBLE) AS t FROM range(91) r(k)), {_curve()} SELECT {_OUT} FROM ra ORDER BY f1 DESC, threshold LIMIT 1")
def best_f1_grid(spark: SparkSession, d: str) -> DataFrame:
    return _threshold(thresholds.best_f1(scored(spark, d), "y", "s"))


def _threshold(df: DataFrame) -> DataFrame:
    """Thresholds to nine digits, metrics to six."""
    return df.select(*[F.round(c, 9 if c == "threshold" else 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _weighted(ws) -> str:
    return " + ".join(f"{float(w)}::DOUBLE * l{k}" for k, w in enumerate(ws))


def _configs(scores: dict[str, str]) -> str:
    return "cf AS (" + " UNION ALL ".join(f"SELECT '{n}' AS config, y, {s} AS s FROM lv" for n, s in scores.items()) + ")"


_EVAL = (
    "th AS (SELECT k, 0.05::DOUBLE + k * ((0.05::DOUBLE + 0.01::DOUBLE) - 0.05::DOUBLE) AS t FROM range(91) r(k)), "
    "cc AS (SELECT config, k, t, sum((y = 1 AND s >= t)::INT) AS tp, sum((y = 0 AND s < t)::INT) AS tn, sum((y = 0 AND s >= t)::INT) AS fp, sum((y = 1 AND s < t)::INT) AS fn FROM cf CROSS JOIN th GROUP BY ALL), "
    f"rr AS (SELECT *, {RATES} FROM cc), bf AS (SELECT config, t, f1, accuracy, row_number() OVER (PARTITION BY config ORDER BY f1 DESC, k) AS r FROM rr), "
    f"au AS ({_auc('cf', 'config')}) "
)


@query(f"WITH {LV}, {_configs({n: _weighted(w) for n, w in ablation.LEVELS.items()})}, {_EVAL} SELECT au.config, round(auc, 6) AS auc, round(t, 6) AS threshold, round(f1, 6) AS f1, round(accuracy, 6) AS accuracy, round((SELECT auc FROM au WHERE config = 'all') - auc, 6) AS auc_drop FROM au JOIN bf ON au.config = bf.config WHERE r = 1")
def level_ablation(spark: SparkSession, d: str) -> DataFrame:
    """Each weighting of the levels."""
    lv = leveled(spark, d)
    return rounded(ablation.level_ablation(lv, "y", [F.col(f"l{k}") for k in range(4)]))


_KEYED = ", ".join([LV, "cf AS (" + " UNION ALL ".join(f"SELECT '{n}' AS config, vec_id, y, {_weighted(w)} AS s FROM lv" for n, w in ablation.LEVELS.items()) + ")"])


def level_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Interval of the AUC of each weighting of the levels."""
    return rounded(ablation.level_intervals(leveled(spark, d), "vec_id", "y", [F.col(f"l{k}") for k in range(4)]))


_GROUPS = LEVEL_FEATURES


def _masked(without: str | None) -> str:
    return " + ".join(f"{w}::DOUBLE * ((0.0::DOUBLE + " + " + ".join(c for c in g if c != without) + ") / 16.0::DOUBLE)" for w, g in zip(ablation.DEFAULT, _GROUPS, strict=True))


@query(f"WITH {LV}, {_configs({'none': _masked(None)} | {c: _masked(c) for g in _GROUPS for c in g})}, au AS ({_auc('cf', 'config')}) SELECT config, round(auc, 6) AS auc, round((SELECT auc FROM au WHERE config = 'none') - auc, 6) AS \"drop\" FROM au")
def leave_one_out(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ablation.leave_one_out(leveled(spark, d), "y", _GROUPS, ablation.DEFAULT))


@query(f"WITH {LV}, {_configs({f'f{k}': f'f{k}' for k in range(64)})} SELECT config, round(auc, 6) AS auc FROM ({_auc('cf', 'config')})")
def submodule_auc(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ablation.single_features(leveled(spark, d), "y", [f"f{k}" for k in range(64)]))


@query(
    f"WITH {LV}, {_configs({'/'.join(f'{round(w * 5)}' for w in ws): _weighted(ws) for ws in ablation.simplex(5)})}, {_EVAL} SELECT config, round(auc, 6) AS auc, round(t, 6) AS threshold, round(f1, 6) AS f1, round(accuracy, 6) AS accuracy FROM "
    "(SELECT au.config, auc, t, f1, accuracy FROM au JOIN bf ON au.config = bf.config WHERE r = 1) ORDER BY round(auc, 9) DESC, round(f1, 9) DESC, config LIMIT 20"
)
def weight_grid(spark: SparkSession, d: str) -> DataFrame:
    """The best weights of the simplex."""
    lv = leveled(spark, d)
    return rounded(ablation.weight_search(lv, "y", [F.col(f"l{k}") for k in range(4)], 5))


def _resampled(rows: str, key: str, config: str = "") -> str:
    """SQL of the low, middle and high AUC of 200 resamples of rows y, s, by config if there is one."""
    g = config + ", " if config else ""
    cuts = ", ".join(f"{c!r}::DOUBLE" for c in ablation.poisson_cuts())
    return (
        f"dr AS (SELECT {g}y, s, round, len(list_filter([{cuts}], lambda c: c <= CAST('0x' || substr(md5({key} || ':' || round || ':0'), 1, 13) AS BIGINT) / {float(1 << 52)!r}::DOUBLE)) AS times FROM {rows}, range(1, 201) r(round)), "
        f"ti AS (SELECT {g}round, s, sum(CASE WHEN y = 1 THEN times ELSE 0 END) AS p, sum(CASE WHEN y = 0 THEN times ELSE 0 END) AS n FROM dr WHERE times > 0 GROUP BY ALL), "
        f"be AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY {g}round ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM ti), "
        f"ra AS (SELECT {g}round, CASE WHEN sum(p) * sum(n) > 0 THEN sum(p * (b + 0.5::DOUBLE * n)) / (sum(p) * sum(n)::DOUBLE) ELSE 0.5::DOUBLE END AS auc FROM be GROUP BY ALL) "
        f"SELECT {g}round(list_sort(list(auc))[6], 6) AS low, round(median(auc), 6) AS median, round(list_sort(list(auc))[196], 6) AS high FROM ra" + (f" GROUP BY {config}" if config else "")
    )


@query(f"WITH {SC}, {_resampled('sc', 'doc_id')}")
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    """Interval of the AUC over hash-drawn resamples."""
    return rounded(ablation.bootstrap_auc(scored(spark, d), "doc_id", "y", "s"))


query(f"WITH {_KEYED}, {_resampled('cf', 'vec_id', 'config')}")(level_intervals)


# splits and joins ---------------------------------------------------------------------------

_SHUF = "md5(concat_ws(':', CAST({} AS VARCHAR), '42'))"


@query(
    f"WITH n AS (SELECT doc_id, quality AS y, count(*) OVER (PARTITION BY quality) AS n, row_number() OVER (PARTITION BY quality ORDER BY {_SHUF.format('doc_id')}, doc_id) AS r FROM labels), "
    "p AS (SELECT *, CASE WHEN n <= 1 THEN 0 WHEN n <= 3 THEN 1 ELSE greatest(1, round_even(n * 0.2::DOUBLE, 0)) END AS v, CASE WHEN n <= 2 THEN 0 WHEN n = 3 THEN 1 ELSE greatest(1, round_even(n * 0.2::DOUBLE, 0)) END AS t FROM n) "
    "SELECT doc_id, y, CASE WHEN r <= greatest(1, n - v - t) THEN 'train' WHEN r <= n - t THEN 'validation' ELSE 'test' END AS split FROM p"
)
def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").select("doc_id", F.col("quality").alias("y"))
    return splits.stratified_split(rows, "doc_id", "y").select("doc_id", "y", "split")


@query(
    f"WITH n AS (SELECT c_custkey, c_nationkey, count(*) OVER (PARTITION BY c_nationkey) AS n, row_number() OVER (PARTITION BY c_nationkey ORDER BY {_SHUF.format('c_custkey')}, c_custkey) AS r FROM customer) "
    "SELECT c_custkey, c_nationkey, CASE WHEN r <= greatest(1, floor(n * 0.2::DOUBLE)) THEN 'test' WHEN r <= greatest(1, floor(n * 0.2::DOUBLE)) * 2 THEN 'validation' ELSE 'train' END AS split FROM n"
)
def floor_split(spark: SparkSession, d: str) -> DataFrame:
    return splits.floor_split(table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_custkey", "c_nationkey")


@query(f"SELECT c_custkey, c_nationkey FROM (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY {_SHUF.format('c_custkey')}, c_custkey) AS r FROM customer) WHERE r <= 20")
def stratified_cap(spark: SparkSession, d: str) -> DataFrame:
    """At most 20 customers of each nation."""
    return splits.capped_sample(table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_custkey", "c_nationkey", 20)


def _gain(split: str) -> str:
    """How much nearer its targets, or farther, the next group leaves a split."""
    return " + ".join(f"abs(goal_{split}_{c} - r.{split}_{c} - o.{c}) - abs(goal_{split}_{c} - r.{split}_{c})" for c in ("pos", "neg"))


def _dealt(groups: str) -> str:
    """SQL, recursive, of ``r``: the groups of a table ``g, pos, neg`` with their splits, from n = 1."""
    return (
        f"g AS ({groups}), o AS (SELECT *, row_number() OVER (ORDER BY pos + neg DESC, pos, neg, md5(CAST(g AS VARCHAR) || ':42'), g) AS n FROM g), "
        "t AS (SELECT *, greatest(0, tp - goal_validation_pos - goal_test_pos) AS goal_train_pos, greatest(0, tn - goal_validation_neg - goal_test_neg) AS goal_train_neg FROM ("
        "SELECT sum(pos)::BIGINT AS tp, sum(neg)::BIGINT AS tn, " + ", ".join(f"greatest(1, round_even(sum({c}) * 0.2::DOUBLE, 0))::BIGINT AS goal_{s}_{c}" for s in ("validation", "test") for c in ("pos", "neg")) + " FROM g)), "
        "r AS (SELECT 0::BIGINT AS n, (SELECT min(g) FROM g) AS g, ''::VARCHAR AS split, " + ", ".join(f"0::BIGINT AS {s}_{c}" for s in ("validation", "test", "train") for c in ("pos", "neg")) + " UNION ALL "
        "SELECT n, g, split, " + ", ".join(f"{s}_{c} + CASE WHEN split = '{s}' THEN {c} ELSE 0 END" for s in ("validation", "test", "train") for c in ("pos", "neg")) + " FROM ("
        "SELECT o.n, o.g, o.pos, o.neg, r.validation_pos, r.validation_neg, r.test_pos, r.test_neg, r.train_pos, r.train_neg, "
        f"CASE WHEN {_gain('validation')} <= least({_gain('test')}, {_gain('train')}) THEN 'validation' WHEN {_gain('test')} <= {_gain('train')} THEN 'test' ELSE 'train' END AS split "
        "FROM r JOIN o ON o.n = r.n + 1 CROSS JOIN t))"
    )


_CLASSES = "count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg"


@query(f"WITH RECURSIVE {SC}, {_dealt(f"SELECT source || '/' || lang AS g, {_CLASSES} FROM sc GROUP BY ALL")} SELECT g, split FROM r WHERE n > 0")
def group_split(spark: SparkSession, d: str) -> DataFrame:
    """Source and language groups dealt to splits by class balance."""
    rows = scored(spark, d).withColumn("g", F.concat_ws("/", "source", "lang"))
    return splits.group_split(rows, "g", "y")


@query(
    "WITH o AS (SELECT o_orderkey, o_custkey % 50 AS pair, (o_orderkey % 2)::INT AS y, CASE WHEN o_custkey % 50 < 30 THEN 'train' WHEN o_custkey % 50 < 40 THEN 'validation' ELSE 'test' END AS split FROM orders) "
    "SELECT o_orderkey, split, 'official_dataset_split_pair_safe' AS strategy FROM o"
)
def official_split(spark: SparkSession, d: str) -> DataFrame:
    """A given split of orders that keeps each pair together, and so holds."""
    rows = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 50).alias("pair"), (F.col("o_orderkey") % 2).cast("int").alias("y"))
    given = rows.select("o_orderkey", F.when(F.col("pair") < 30, "train").when(F.col("pair") < 40, "validation").otherwise("test").alias("split"))
    return splits.official_split(rows, given, "o_orderkey", "pair", "y").select("o_orderkey", "split", "strategy")


@query(
    f"WITH RECURSIVE w AS (SELECT o_orderkey, o_custkey % 50 AS pair, (o_orderkey % 2)::INT AS y FROM orders), {_dealt(f'SELECT pair AS g, {_CLASSES} FROM w GROUP BY pair')} "
    "SELECT o_orderkey, split, 'source_connected_group_split' AS strategy FROM w JOIN r ON r.g = w.pair AND r.n > 0"
)
def leaking_official_split(spark: SparkSession, d: str) -> DataFrame:
    """A given split of orders that parts pairs, and so gives way to one made of whole pairs."""
    rows = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 50).alias("pair"), (F.col("o_orderkey") % 2).cast("int").alias("y"))
    k = F.col("o_orderkey") % 3
    given = rows.select("o_orderkey", F.when(k == 0, "train").when(k == 1, "validation").otherwise("test").alias("split"))
    return splits.official_split(rows, given, "o_orderkey", "pair", "y").select("o_orderkey", "split", "strategy")


@query(
    "WITH m AS (SELECT l_orderkey AS k, CASE l_returnflag WHEN 'A' THEN ' Train' WHEN 'N' THEN 'VAL' ELSE 'test' END AS split, CAST(l_orderkey AS VARCHAR) AS i FROM lineitem WHERE l_linenumber = 1) "
    "SELECT doc_id, CASE lower(trim(split)) WHEN 'val' THEN 'validation' ELSE lower(trim(split)) END AS split FROM documents JOIN m ON CAST(i AS BIGINT) = doc_id AND CAST(i AS BIGINT) < (SELECT count(*) FROM documents)"
)
def index_split(spark: SparkSession, d: str) -> DataFrame:
    """Documents by number with the split that a manifest gives the number."""
    flag = F.col("l_returnflag")
    given = table(spark, d, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").cast("string").alias("index"), F.when(flag == "A", " Train").when(flag == "N", "VAL").otherwise("test").alias("split"))
    return splits.index_split(table(spark, d, "documents").select("doc_id"), given, "doc_id").select("doc_id", "split")


@query(f"WITH {TL}, a AS (SELECT v, seq, x FROM tl WHERE seq < 40), b AS (SELECT v, seq, x AS y FROM tl WHERE seq % 3 > 0), c AS (SELECT v, seq, kind FROM tl WHERE ok) SELECT a.v, a.seq, round(x, 6) AS x, round(y, 6) AS y, kind FROM a JOIN b ON a.v = b.v AND a.seq = b.seq JOIN c ON a.v = c.v AND a.seq = c.seq")
def zipped_series(spark: SparkSession, d: str) -> DataFrame:
    """Three series of an entity by place, where all have it."""
    tl = timeline(spark, d)
    parts = [tl.where("seq < 40").select("v", "seq", "x"), tl.where("seq % 3 > 0").select("v", "seq", F.col("x").alias("y")), tl.where("ok").select("v", "seq", "kind")]
    return rounded(evidence.zipped(parts, ["v", "seq"]))


@query(f"WITH {TL}, w AS (SELECT v, seq // 5 AS frame, row_number() OVER (PARTITION BY v, seq // 5 ORDER BY seq) AS r, x, kind FROM tl), q AS (SELECT DISTINCT v, frame FROM w WHERE frame % 2 = 0) SELECT q.v, q.frame, round(x, 6) AS x, kind FROM q LEFT JOIN w ON q.v = w.v AND q.frame = w.frame AND r = 1 AND w.x >= 0")
def first_evidence(spark: SparkSession, d: str) -> DataFrame:
    """The first observation of each wanted frame."""
    tl = timeline(spark, d).withColumn("frame", F.floor(F.col("seq") / 5))
    wanted = tl.where("frame % 2 = 0").select("v", "frame").distinct()
    return rounded(evidence.first_evidence(wanted, tl, ["v", "frame"], "seq").select("v", "frame", "x", "kind"))


_EDGES = "eg AS (SELECT DISTINCT 'p' || l_partkey AS u, 's' || l_suppkey AS v FROM lineitem)"


def edges(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem")
    return l.select(F.concat(F.lit("p"), "l_partkey").alias("u"), F.concat(F.lit("s"), "l_suppkey").alias("v")).distinct()


@query(
    f"WITH RECURSIVE {_EDGES}, bi AS (SELECT u, v FROM eg UNION SELECT v, u FROM eg), rc(node, component) USING KEY (node) AS (SELECT u, min(least(u, v)) FROM bi GROUP BY u UNION "
    "SELECT bi.u, min(rc.component) FROM rc JOIN bi ON rc.node = bi.v JOIN recurring.rc AS me ON me.node = bi.u WHERE rc.component < me.component GROUP BY bi.u) SELECT node, component FROM rc"
)
def connected_groups(spark: SparkSession, d: str) -> DataFrame:
    """Parts and suppliers joined through shared line items."""
    return graph.connected_components(edges(spark, d))


@query(
    "SELECT o_orderpriority, array_to_string(list_sort(list(DISTINCT o_orderstatus)), ',') AS splits FROM orders GROUP BY o_orderpriority HAVING count(DISTINCT o_orderstatus) > 1"
)
def leakage_check(spark: SparkSession, d: str) -> DataFrame:
    """Groups that stand in more than one split."""
    out = splits.leaking_groups(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus")
    return out.select("o_orderpriority", F.concat_ws(",", "splits").alias("splits"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def missing_split(spark: SparkSession, d: str) -> DataFrame:
    """Customers without an order."""
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return splits.without_split(table(spark, d, "customer").select("c_custkey", "c_name"), orders, "c_custkey")


@query("SELECT d.doc_id, coalesce(CAST(l.quality AS VARCHAR), 'unused') AS split FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def manifest_join(spark: SparkSession, d: str) -> DataFrame:
    """Every document with its label, ``unused`` where it has none."""
    labels = table(spark, d, "labels").select("doc_id", F.col("quality").cast("string").alias("split"))
    return splits.with_split(table(spark, d, "documents").select("doc_id"), labels, "doc_id")


@query("SELECT d.doc_id, lang, quality, toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def flat_join(spark: SparkSession, d: str) -> DataFrame:
    """Only documents that the manifest names."""
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id").select("doc_id", "lang", "quality", "toxic")


@query(
    "SELECT c_custkey, CASE WHEN regexp_extract(c_name, '#(\\d+)$', 1) <> '' THEN regexp_extract(c_name, '#(\\d+)$', 1) ELSE c_name END AS pair_id FROM customer"
)
def pair_id(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", scalars.pair_id(F.col("c_name"), r"#(\d+)$").alias("pair_id"))


@query(
    "WITH p AS (SELECT page_id, split(split_part(split_part(url, '?', 1), '#', 1), '/') AS a FROM pages), q AS (SELECT page_id, lower(regexp_replace(a[-1], '\\.[^.]*$', '')) AS stem, lower(a[-2]) AS f FROM p) "
    "SELECT page_id, CASE WHEN contains(stem, '_') AND split_part(stem, '_', 1) NOT IN ('ai', 'authentic', '') THEN split_part(stem, '_', 1) WHEN f <> '' AND f NOT IN ('ai', 'authentic') THEN f WHEN page_id % 2 = 1 THEN 'ai' ELSE 'authentic' END AS category FROM q"
)
def category_parse(spark: SparkSession, d: str) -> DataFrame:
    """Category of an address by its file name, then its folder."""
    path = F.regexp_replace("url", r"[?#].*$", "")
    return table(spark, d, "pages").select("page_id", scalars.category(path, (F.col("page_id") % 2).cast("int")).alias("category"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k, CAST(json_extract(props, '$.k') AS INT) % 2 AS label FROM events")
def metadata_json(spark: SparkSession, d: str) -> DataFrame:
    """Number in a JSON text and the label made of it."""
    k = F.from_json("props", "map<string,int>")["k"]
    return table(spark, d, "events").select("event_id", k.alias("k"), (k % 2).alias("label"))


@query(
    "SELECT doc_id, CASE WHEN regexp_full_match(substr(source, 4), '[0-9]+') THEN CAST(substr(source, 4) AS DOUBLE) ELSE 0 END AS number, coalesce(CAST(TRY_CAST(substr(source, 4) AS DOUBLE) AS BIGINT), 0) AS whole, 0.0::DOUBLE AS missing FROM documents"
)
def alias_coalesce_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Typed columns of text under older names."""
    rows = table(spark, d, "documents").select("doc_id", F.expr("substr(source, 4)").alias("L1_flow"), F.col("lang").alias("physics_score"))
    flow = ingest.aliased(rows, "flow_score", ingest.ALIASES["flow_score"])
    return rows.select("doc_id", flow.alias("number"), flow.cast("long").alias("whole"), ingest.aliased(rows, "physics_score").alias("missing"))


@query(
    "SELECT doc_id, CASE WHEN regexp_full_match(trim(text), '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN CAST(trim(text) AS DOUBLE) ELSE 0.0 END AS number FROM documents"
)
def safe_cast(spark: SparkSession, d: str) -> DataFrame:
    """Each text as a number, 0 where it is none."""
    return table(spark, d, "documents").select("doc_id", scalars.safe_double(F.col("text")).alias("number"))


@query(f"WITH {SC} SELECT source, '[' || repeat('#', CAST(floor(avg(s) * 20) AS INT)) || repeat('.', 20 - CAST(floor(avg(s) * 20) AS INT)) || '] ' || CASE WHEN avg(s) > 0.65 THEN 'HIGH' WHEN avg(s) > 0.35 THEN 'MED' ELSE 'LOW' END AS bar FROM sc GROUP BY source")
def score_bars(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).groupBy("source").agg(F.avg("s").alias("m")).select("source", scalars.score_bar(F.col("m")).alias("bar"))


@query()
def report_json(spark: SparkSession, d: str) -> DataFrame:
    """Metrics per source as JSON texts."""
    m = rounded(metrics.by_category(scored(spark, d), "source", "y", "s", CUT), 4)
    return m.select("source", sinks.as_json(*[F.col(c) for c in m.columns]).alias("report"))


# models -------------------------------------------------------------------------------------

_STAT = EV + ", st AS (SELECT k, avg(e[k]) AS m, stddev_pop(e[k]) AS s, min(e[k]) AS lo, max(e[k]) AS hi FROM ev, range(1, 65) r(k) GROUP BY k)"


def _coordinates(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).withColumn("x", F.col("e"))


@query(f"WITH {_STAT} SELECT vec_id, CAST(k - 1 AS INT) AS k, round((e[k] - m) / (s + 1e-8), 6) AS z, round(CASE WHEN hi - lo > 1e-12 THEN (e[k] - lo) / (hi - lo) ELSE e[k] - lo END, 6) AS mm FROM ev CROSS JOIN st")
def zscore_minmax(spark: SparkSession, d: str) -> DataFrame:
    """Both scalings of every coordinate."""
    rows = _coordinates(spark, d)
    st = models.column_statistics(rows, "x", 64)
    both = F.arrays_zip(models.zscored(F.col("x"), st["mean"], st["std"]).alias("z"), models.minmax_scaled(F.col("x"), st["min"], st["max"]).alias("mm"))
    return rounded(rows.select("vec_id", F.posexplode(both).alias("k", "b")).select("vec_id", "k", "b.z", "b.mm"))


@query("SELECT event_id, CASE WHEN value > 60 THEN 0.0::DOUBLE ELSE least(greatest(value / 50.0::DOUBLE, 0.0::DOUBLE), 1.0::DOUBLE) END AS x FROM events")
def clip_impute(spark: SparkSession, d: str) -> DataFrame:
    """NaN as 0, then held in [0, 1]."""
    raw = F.when(F.col("value") > 60, F.lit(float("nan"))).otherwise(F.col("value") / 50.0)
    return table(spark, d, "events").select("event_id", scalars.clip01(scalars.finite_or(raw)).alias("x"))


_W = [((7 * k + 3) % 17 - 8) / 4.0 for k in range(64)]
_DOT = " + ".join(f"{w}::DOUBLE * e[{k + 1}]" for k, w in enumerate(_W))
_SIGM = "1.0::DOUBLE / (1.0::DOUBLE + exp(-least(greatest({}, -50.0::DOUBLE), 50.0::DOUBLE)))"


@query(f"WITH {EV} SELECT vec_id, round({_SIGM.format(_DOT + ' + 0.1::DOUBLE')}, 6) AS probability FROM ev")
def linear_score(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_coordinates(spark, d).select("vec_id", models.linear_score(F.col("x"), _W, 0.1).alias("probability")))


_U = [[((3 * i + 5 * j) % 7 - 3) / 2.0 for j in range(64)] for i in range(4)]
_V = [0.8, -1.1, 0.6, 0.9]


@query(
    f"WITH {EV}, h AS (SELECT vec_id, "
    + ", ".join("greatest(" + " + ".join(f"{u}::DOUBLE * e[{j + 1}]" for j, u in enumerate(row)) + f" + {0.05 * i}::DOUBLE, 0.0::DOUBLE) AS h{i}" for i, row in enumerate(_U))
    + f" FROM ev) SELECT vec_id, round({_SIGM.format(' + '.join(f'{v}::DOUBLE * h{i}' for i, v in enumerate(_V)) + ' - 0.2::DOUBLE')}, 6) AS probability FROM h"
)
def mlp_score(spark: SparkSession, d: str) -> DataFrame:
    layers = [(_U, [0.05 * i for i in range(4)]), ([_V], [-0.2])]
    return rounded(_coordinates(spark, d).select("vec_id", models.mlp_score(F.col("x"), layers).alias("probability")))


_UNIT = "((CAST('0x' || substr(md5(concat_ws(':', CAST(vec_id AS VARCHAR), CAST(t AS VARCHAR), CAST(k AS VARCHAR))), {}, 12) AS BIGINT)::DOUBLE + 0.5::DOUBLE) / 281474976710656.0::DOUBLE)"


@query(
    f"WITH {EV}, ns AS (SELECT vec_id, t, k, e[k + 1] + CASE WHEN t = 0 THEN 0.0::DOUBLE ELSE 0.006::DOUBLE * sqrt(-2.0::DOUBLE * ln({_UNIT.format(1)})) * cos(2.0::DOUBLE * pi() * {_UNIT.format(13)}) END AS x FROM ev, range(0, 5) a(t), range(0, 64) b(k)), "
    f"sc AS (SELECT vec_id, t, sum(({_W}::DOUBLE[])[k + 1] * x) + 0.1::DOUBLE AS z FROM ns GROUP BY vec_id, t) SELECT vec_id, round(sum({_SIGM.format('z')}) / 5.0::DOUBLE, 6) AS probability FROM sc GROUP BY vec_id"
)
def tta_score(spark: SparkSession, d: str) -> DataFrame:
    """Scores averaged over noisy copies."""
    score = lambda x: models.linear_score(x, _W, 0.1)
    return rounded(_coordinates(spark, d).select("vec_id", models.averaged_over_noise(F.col("x"), F.col("vec_id"), score).alias("probability")))


@query(f"WITH {_STAT}, z AS (SELECT vec_id, y, sum(w * (e[k] - m) / (s + 1e-8)) + 0.1::DOUBLE AS t FROM ev CROSS JOIN st JOIN (SELECT unnest({_W}::DOUBLE[]) AS w, unnest(range(1, 65)) AS j) q ON q.j = st.k GROUP BY vec_id, y) SELECT vec_id, y, round({_SIGM.format('t')}, 6) AS probability, ({_SIGM.format('t')} >= 0.5)::INT AS prediction FROM z")
def bundle_predict(spark: SparkSession, d: str) -> DataFrame:
    """Scaling, score and decision of a model bundle."""
    rows = _coordinates(spark, d)
    st = models.column_statistics(rows, "x", 64)
    names = [f"c{k}" for k in range(64)]
    bundle = models.Bundle(names, st["mean"], st["std"], {"linear": {"weights": _W, "bias": 0.1}})
    flat = rows.select("vec_id", "y", *[F.col("x")[k].alias(n) for k, n in enumerate(names)])
    return rounded(bundle.predict(flat).select("vec_id", "y", "probability", "prediction"))


def _report(df: DataFrame, name: str) -> DataFrame:
    return rounded(metrics.auc(df, "y", "probability").withColumn("model", F.lit(name)).withColumn("rows", F.lit(df.count())))


_FEATURES = [f"f{k}" for k in range(64)]


#: Rows that are fitted, three of four by a hash of the id, and the others, on which fits are judged.
_FITTED, _JUDGED = "crc32(cast(vec_id AS string)) % 4 <> 0", "crc32(cast(vec_id AS string)) % 4 = 0"


@query()
def fit_logistic(spark: SparkSession, d: str) -> DataFrame:
    """Fit over all coordinates, and AUC on rows that weren't fitted."""
    rows = leveled(spark, d)
    x = models.feature_array(_FEATURES)
    model = models.fit_linear(rows, x, "y", of=_FITTED)
    return _report(rows.where(_JUDGED).withColumn("probability", models.linear_score(x, **model)), "linear")


@query()
def fit_gbt(spark: SparkSession, d: str) -> DataFrame:
    rows = leveled(spark, d)
    x = models.feature_array(_FEATURES)
    model = models.fit_gbt(rows, x, "y", of=_FITTED)
    return _report(models.gbt_scored(model, rows.where(_JUDGED), x, "probability"), "gbm")


@query()
def fit_mlp(spark: SparkSession, d: str) -> DataFrame:
    rows = leveled(spark, d)
    x = models.feature_array(_FEATURES)
    model = models.fit_mlp(rows, x, "y", 64, of=_FITTED)
    return _report(rows.where(_JUDGED).withColumn("probability", models.mlp_score(x, [tuple(p) for p in model["layers"]])), "mlp")


@query()
def fit_minibatch(spark: SparkSession, d: str) -> DataFrame:
    """Mini-batch training of a perceptron; the snapshot with the least validation loss is judged."""
    rows = leveled(spark, d)
    x = models.feature_array(_FEATURES)
    fitted = training.fit(rows.where(_FITTED).select("vec_id", x.alias("x"), F.col("y").cast("double").alias("y")), "vec_id", "x", "y", 64, (64, 32, 16), epochs=10)
    return _report(rows.where(_JUDGED).withColumn("probability", models.mlp_score(x, fitted.score_layers())), "mlp")


def _chosen(score: str) -> str:
    """SQL of the threshold of a score, limits first, and its AUC, over rows y, s."""
    order = _pick({2: ["balanced_accuracy", "f1", "recall", "specificity"], 1: ["balanced_accuracy", "specificity", "f1", "recall"], 0: ["specificity", "recall", "balanced_accuracy"]}, 5)
    rows = f"{SC.replace('sc AS', 'so AS')}, sc AS (SELECT * REPLACE ({score} AS s) FROM so)"
    return f"WITH {_CAND.replace(SC, rows)}, {_curve()}, {_tiers(0.70, 0.0)} SELECT *, (SELECT auc FROM ({_auc('sc')})) AS auc FROM ti ORDER BY {order} LIMIT 1"


@query(
    f"WITH a AS ({_chosen('s')}), b AS ({_chosen('1.0::DOUBLE - s')}), u AS (SELECT 'length' AS model, * FROM a UNION ALL SELECT 'short', * FROM b) "
    "SELECT model, round(threshold, 6) AS threshold, round(balanced_accuracy, 6) AS balanced_accuracy, round(specificity, 6) AS specificity, round(recall, 6) AS recall, round(f1, 6) AS f1, round(auc, 6) AS auc FROM u ORDER BY round(balanced_accuracy, 12) DESC, round(auc, 12) DESC, model LIMIT 1"
)
def model_selection(spark: SparkSession, d: str) -> DataFrame:
    """The better of two scores by balanced accuracy, then AUC."""
    rows = scored(spark, d).withColumn("t", F.lit(1.0) - F.col("s"))
    return rounded(models.selected(models.compare(rows, "y", {"length": "s", "short": "t"}), ["balanced_accuracy", "auc"]))


def _drawn(name: str, key: str = "doc_id", seed: int = 42) -> str:
    """SQL of a normal number made of an MD5."""
    digest = f"md5(concat_ws(':', CAST({key} AS VARCHAR), '{name}', '{seed}'))"
    u = lambda at: f"((CAST('0x' || substr({digest}, {at}, 12) AS BIGINT)::DOUBLE + 0.5::DOUBLE) / {float(1 << 48)!r}::DOUBLE)"
    return f"sqrt(-2.0::DOUBLE * ln({u(1)})) * cos({2.0 * math.pi!r}::DOUBLE * {u(13)})"


def _synthetic(means: dict[str, tuple[float, float]]) -> str:
    return ", ".join(f"least(greatest((CASE WHEN quality = 1 THEN {high!r}::DOUBLE ELSE {low!r}::DOUBLE END) + {_drawn(n)} * 0.15::DOUBLE, 0.0::DOUBLE), 1.0::DOUBLE) AS {n}" for n, (low, high) in means.items())


_MEANS = {f"f{k}": (0.4, 0.5 + 0.01 * k) for k in range(16)}


@query(f"WITH s AS (SELECT doc_id, quality, {_synthetic(_MEANS)} FROM labels) SELECT doc_id, quality, " + ", ".join(f"round({n}, 6) AS {n}" for n in _MEANS) + " FROM s")
def synthetic_features(spark: SparkSession, d: str) -> DataFrame:
    """Synthetic features for each labelled document, drawn by its id."""
    return rounded(ingest.synthetic_for(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "quality", _MEANS))


_TCS = " + ".join(["0.0::DOUBLE", *(f"{w}::DOUBLE * {n}" for n, w in ingest.LEVEL_WEIGHTS.items())])


@query(
    f"WITH s AS (SELECT doc_id, quality, {_synthetic(ingest.SYNTHETIC)} FROM labels), t AS (SELECT *, {_TCS} AS tcs, 'synthetic_' || lpad(CAST(doc_id AS VARCHAR), greatest(4, length(CAST(doc_id AS VARCHAR)))::INT, '0') AS name FROM s) "
    "SELECT doc_id, name || '.mp4' AS filename, '' AS path, quality AS label, CASE WHEN quality = 1 THEN 'synthetic_ai' ELSE 'synthetic_auth' END AS category, name AS source_group, 'synthetic-smoke' AS track, "
    "CASE WHEN tcs >= 0.39 THEN 'AI_GENERATED' ELSE 'AUTHENTIC' END AS verdict, round(tcs, 5) AS tcs_score, CASE WHEN abs(tcs - 0.39) > 0.20 THEN 'HIGH' WHEN abs(tcs - 0.39) > 0.10 THEN 'MEDIUM' ELSE 'LOW' END AS confidence, "
    + ", ".join(f"round({n}, 5) AS {n}" for n in ingest.SYNTHETIC) + " FROM t"
)
def synthetic_results(spark: SparkSession, d: str) -> DataFrame:
    """Synthetic result rows with score and verdict for each labelled document."""
    rows = ingest.synthetic_for(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "quality", ingest.SYNTHETIC)
    return ingest.synthetic_results(rows, "doc_id", "quality", scoring.SMOKE_THRESHOLD)


@query(
    f"WITH {SC}, c AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE y = 1) AS positives, count(*) FILTER (WHERE y = 0) AS negatives, {_confusion('s >= 0.1')} FROM sc GROUP BY source), r AS (SELECT *, {RATES} FROM c), "
    f"a AS (SELECT source, CASE WHEN min(y) = max(y) THEN 0 ELSE a.auc END AS auc FROM ({_auc('sc', 'source')}) a JOIN sc USING (source) GROUP BY source, a.auc) SELECT r.source, n, positives, negatives, round(auc, 6) AS auc, tp, tn, fp, fn, {_R} FROM r JOIN a ON r.source = a.source"
)
def generalization_report(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of each source as if it were a data set of its own."""
    return rounded(reports.generalization(scored(spark, d), "source", "y", "s", CUT))


def _results(spark: SparkSession, d: str) -> DataFrame:
    """Result rows of labelled documents: some have a learned prediction, some an open one."""
    c, s = F.col, F.col("s")
    verdict = lambda t: F.when(s >= t, "AI_GENERATED").otherwise("AUTHENTIC")
    learned, open_ = c("doc_id") % 2 == 0, c("doc_id") % 3 == 0
    return scored(spark, d).select(
        "doc_id", F.concat("source", F.lit(".mp4")).alias("file"), F.concat(F.lit("/"), "source").alias("path"), c("lang").alias("track"), F.lit("v1").alias("analysis_version"), verdict(0.1).alias("verdict"), F.lit("LOW").alias("confidence"),
        F.when(learned, "bundle").otherwise("core").alias("decision_mode"), (s / 1.7).alias("decision_score"), F.lit(0.1).alias("decision_threshold"), verdict(0.2).alias("core_detector_verdict"), F.lit("HIGH").alias("core_detector_confidence"), (s / 3.1).alias("core_tcs_score"), F.lit(0.2).alias("core_threshold"),
        F.when(learned, c("lang")).alias("bundle_track"), F.when(learned, "mlp").alias("bundle_model"), F.when(learned, s / 7.1).alias("bundle_probability"), F.when(learned, 0.5).alias("bundle_threshold"),
        F.when(open_, "gbm").alias("open_model"), F.when(open_, s / 9.1).alias("open_probability"), F.when(open_, 0.25).alias("open_threshold"), F.lit("").alias("abstained_reason"), (s / 11.1).alias("l1_flow_score"), c("n_chars").alias("violations_count"),
        (c("n_chars") / 7.1).alias("duration"), F.lit(25.0).alias("fps"), F.array(c("doc_id"), c("n_chars")).alias("suspicious_frames"),
    )


def _digits(x: str, n: int) -> str:
    return f"coalesce(CAST(round({x}, {n}) AS VARCHAR), '')"


_BATCH = {
    "file": "source || '.mp4'", "path": "'/' || source", "track": "lang", "analysis_version": "'v1'", "verdict": "CASE WHEN s >= 0.1 THEN 'AI_GENERATED' ELSE 'AUTHENTIC' END", "confidence": "'LOW'", "decision_mode": "CASE WHEN doc_id % 2 = 0 THEN 'bundle' ELSE 'core' END",
    "core_detector_verdict": "CASE WHEN s >= 0.2 THEN 'AI_GENERATED' ELSE 'AUTHENTIC' END", "core_detector_confidence": "'HIGH'", "decision_threshold": "'0.1'", "core_threshold": "'0.2'", "bundle_track": "CASE WHEN doc_id % 2 = 0 THEN lang ELSE '' END", "bundle_model": "CASE WHEN doc_id % 2 = 0 THEN 'mlp' ELSE '' END",
    "bundle_threshold": "CASE WHEN doc_id % 2 = 0 THEN '0.5' ELSE '' END", "open_model": "CASE WHEN doc_id % 3 = 0 THEN 'gbm' ELSE '' END", "open_threshold": "CASE WHEN doc_id % 3 = 0 THEN '0.25' ELSE '' END", "violations_count": "CAST(n_chars AS VARCHAR)", "fps": "'25.0'", "suspicious_frames": "doc_id || ',' || n_chars",
}


@query(f"WITH {SC} SELECT " + ", ".join(f"{_BATCH.get(n, chr(39) * 2)} AS {n}" for n in reports.BATCH if n not in ("decision_score", "core_tcs_score", "bundle_probability", "open_probability", "l1_flow_score", "duration")) + f", doc_id, round(s / 1.7::DOUBLE, 4) AS decision_score, round(s / 3.1::DOUBLE, 4) AS core_tcs_score, round(CASE WHEN doc_id % 2 = 0 THEN s / 7.1::DOUBLE END, 4) AS bundle_probability, round(CASE WHEN doc_id % 3 = 0 THEN s / 9.1::DOUBLE END, 4) AS open_probability, round(s / 11.1::DOUBLE, 4) AS l1_flow_score, round(n_chars / 7.1::DOUBLE, 2) AS duration FROM sc")
def batch_table(spark: SparkSession, d: str) -> DataFrame:
    """The 45 columns of a batch table; numbers as numbers again, for comparison."""
    rows = _results(spark, d)
    out = reports.batch_rows(rows.withColumn("comparison_note", F.col("doc_id").cast("string")))
    numbers = ("decision_score", "core_tcs_score", "bundle_probability", "open_probability", "l1_flow_score", "duration")
    out = out.withColumn("doc_id", F.col("comparison_note").cast("long")).withColumn("comparison_note", F.lit(""))
    return out.withColumns({n: F.col(n).try_cast("double") for n in numbers})


@query(
    f"WITH {SC} SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'bundle' ELSE 'core' END AS mode, round(s / 1.7::DOUBLE, 4) AS score, round(s / 3.1::DOUBLE, 4) AS tcs_score, round(CASE WHEN doc_id % 2 = 0 THEN s / 7.1::DOUBLE END, 4) AS learned, round(CASE WHEN doc_id % 3 = 0 THEN s / 9.1::DOUBLE END, 4) AS open, doc_id % 2 = 0 AS has_learned, doc_id % 3 = 0 AS has_open FROM sc"
)
def decision_json(spark: SparkSession, d: str) -> DataFrame:
    """Decision texts of results, read back."""
    rows = _results(spark, d).select("doc_id", reports.decision_text(["file", "verdict", "track", "abstained_reason"]).alias("t"))
    kind = "file string, verdict string, decision struct<mode:string,score:double,threshold:double,confidence:string>, core_detector struct<verdict:string,confidence:string,tcs_score:double,threshold:double>, learned_prediction struct<track:string,model:string,probability:double,threshold:double>, open_prediction struct<model:string,probability:double,threshold:double>"
    t = F.from_json("t", kind)
    rows = rows.withColumn("j", t)
    return rows.select(
        "doc_id", "j.decision.mode", "j.decision.score", "j.core_detector.tcs_score", F.col("j.learned_prediction.probability").alias("learned"), F.col("j.open_prediction.probability").alias("open"),
        F.col("t").contains('"learned_prediction"').alias("has_learned"), F.col("t").contains('"open_prediction"').alias("has_open"),
    )
