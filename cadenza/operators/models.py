"""Feature scaling, three classifiers, and scoring by model bundles.

Fitting is distributed: logistic regression and boosted trees by the ML library, the
multilayer perceptron by full-batch gradient steps whose sums Spark adds up. Scoring of the
linear and perceptron models is array arithmetic in the query itself.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.scalars import finite_or, relu, sigmoid
from ..sources.scratch import materialize
from . import metrics, thresholds

SIGMA_TINY = 1e-8


def feature_array(names: list[str]) -> Column:
    """The named columns in model order; null, NaN and infinities as 0."""
    return F.array(*[finite_or(F.col(n).cast("double")) for n in names])


def column_statistics(df: DataFrame, features: str, size: int) -> dict[str, list[float]]:
    """Mean, population deviation, minimum and maximum of each place of an array column."""
    get = [F.get(F.col(features), F.lit(k)) for k in range(size)]
    row = df.agg(*[f(x).alias(f"{n}{k}") for k, x in enumerate(get) for n, f in (("m", F.avg), ("s", F.stddev_pop), ("a", F.min), ("b", F.max))]).first()
    return {n: [float(row[f"{c}{k}"] or 0.0) for k in range(size)] for n, c in (("mean", "m"), ("std", "s"), ("min", "a"), ("max", "b"))}


def _literal(xs: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in xs])


def zscored(features: Column, mean: list[float], std: list[float]) -> Column:
    """(x - mean) / (std + tiny) by place."""
    return F.zip_with(F.zip_with(features, _literal(mean), lambda x, m: x - m), _literal(std), lambda x, s: x / (s + F.lit(SIGMA_TINY)))


def minmax_scaled(features: Column, low: list[float], high: list[float]) -> Column:
    """(x - low) / range by place; a constant place gives 0."""
    span = [h - a if h - a > 1e-12 else 1.0 for a, h in zip(low, high, strict=True)]
    return F.zip_with(F.zip_with(features, _literal(low), lambda x, m: x - m), _literal(span), lambda x, s: x / s)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def linear_score(features: Column, weights: list[float], bias: float) -> Column:
    return sigmoid(dot(features, _literal(weights)) + F.lit(float(bias)))


def mlp_score(features: Column, layers: list[tuple[list[list[float]], list[float]]]) -> Column:
    """Layers of (rows of weights per unit, biases); ReLU between, sigmoid at the end."""


    def layer(x: Column, weights: list[list[float]], bias: list[float], last: bool) -> Column:
        units = F.array(*[F.struct(_literal(w).alias("w"), F.lit(float(b)).alias("b")) for w, b in zip(weights, bias, strict=True)])
        # x is bound by a lambda of its own, else every unit would compute all layers below it
        unit = lambda u, v: dot(u["w"], v) + u["b"] if last else relu(dot(u["w"], v) + u["b"])
        return F.get(F.transform(F.array(x), lambda v: F.transform(units, lambda u: unit(u, v))), F.lit(0))

    x = features
    for k, (weights, bias) in enumerate(layers):
        x = layer(x, weights, bias, k == len(layers) - 1)
    return sigmoid(F.get(x, F.lit(0)))


def noisy(features: Column, key: Column, turn: int, spread: float) -> Column:
    """The features with Gaussian noise drawn from the MD5 of key, turn and place (Box-Muller)."""
    digest = lambda k: F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(turn)), k.cast("string")))
    unit = lambda k, at: (F.conv(F.substring(digest(k), at, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    return F.transform(features, lambda x, k: x + F.lit(spread) * F.sqrt(F.lit(-2.0) * F.log(unit(k, 1))) * F.cos(F.lit(2 * np.pi) * unit(k, 13)))


def averaged_over_noise(features: Column, key: Column, score, times: int = 5, spread: float = 0.006) -> Column:
    """Mean of the clean score and times - 1 scores of noisy features."""
    total = score(features)
    for turn in range(1, times):
        total = total + score(noisy(features, key, turn, spread))
    return total / F.lit(float(times))


@dataclass
class Bundle:
    """Feature names, scaling, models and the chosen threshold, as one JSON document.

    models: linear (weights, bias) and mlp (layers); trees: where the boosted model was saved.
    """

    feature_names: list[str]
    mean: list[float]
    std: list[float]
    models: dict = field(default_factory=dict)
    selected_model: str = "linear"
    selected_threshold: float = 0.5
    track: str = "core"
    trees: str | None = None

    def to_json(self) -> str:
        doc = {k: v for k, v in self.__dict__.items() if k not in ("mean", "std")}
        return json.dumps(doc | {"normalization": {"mean": self.mean, "std": self.std}}, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Bundle:
        doc = json.loads(text)
        norm = doc.pop("normalization")
        return cls(mean=norm["mean"], std=norm["std"], **doc)

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(self.to_json(),)], "value string").coalesce(1).write.text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Bundle:
        return cls.from_json(spark.read.text(path, wholetext=True).first()["value"])

    def score(self, df: DataFrame, name: str | None = None, out: str = "probability") -> DataFrame:
        """Adds the probability of the named (else the selected) model."""
        name = name or self.selected_model
        x = zscored(feature_array(self.feature_names), self.mean, self.std)
        if name == "linear":
            return df.withColumn(out, linear_score(x, **self.models["linear"]))
        if name == "mlp":
            return df.withColumn(out, mlp_score(x, [(w, b) for w, b in self.models["mlp"]["layers"]]))
        if name == "gbm":
            from pyspark.ml.classification import GBTClassificationModel

            return gbt_scored(GBTClassificationModel.load(self.trees), df, x, out)
        raise ValueError(f"no model {name}")

    def predict(self, df: DataFrame, name: str | None = None) -> DataFrame:
        """Adds probability and prediction at the selected threshold."""
        return self.score(df, name).withColumn("prediction", (F.col("probability") >= self.selected_threshold).cast("int"))


def _vectors(df: DataFrame, features: Column, label: str, of: str | None) -> DataFrame:
    """The rows to fit: all, or those that meet a condition (SQL text)."""
    return (df if of is None else df.where(of)).select(array_to_vector(features).alias("features"), F.col(label).cast("double").alias("label"))


def fit_linear(df: DataFrame, features: Column, label: str, decay: float = 1e-4, epochs: int = 100, of: str | None = None) -> dict:
    """Weights and bias of a logistic regression with an L2 penalty."""
    model = LogisticRegression(regParam=decay, maxIter=epochs, standardization=False).fit(_vectors(df, features, label, of))
    return {"weights": [float(w) for w in model.coefficients], "bias": float(model.intercept)}


def fit_gbt(df: DataFrame, features: Column, label: str, rounds: int = 300, depth: int = 3, rate: float = 0.03, seed: int = 42, of: str | None = None):
    """Boosted trees."""
    return GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=rate, seed=seed).fit(_vectors(df, features, label, of))


def gbt_scored(model, df: DataFrame, features: Column, out: str) -> DataFrame:
    """Adds the positive probability of a tree model."""
    name = model.getFeaturesCol()
    scored = model.transform(df.withColumn(name, array_to_vector(features)))
    return scored.withColumn(out, F.get(vector_to_array("probability"), F.lit(1))).select(*df.columns, out)


def _forward(x: np.ndarray, layers: list[list[np.ndarray]]) -> list[np.ndarray]:
    acts = [x]
    for k, (w, b) in enumerate(layers):
        z = acts[-1] @ w.T + b
        acts.append(np.maximum(z, 0) if k < len(layers) - 1 else 1 / (1 + np.exp(-np.clip(z, -50, 50))))
    return acts


def _gradients(state, drop: tuple[float, ...], turn: int):
    """Per task: sums of the loss gradients over its rows, one row per parameter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layers = state.value
        total = [[np.zeros_like(w), np.zeros_like(b)] for w, b in layers]
        rng, rows, loss = np.random.default_rng(turn), 0, 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            y = batch.column(1).to_numpy(zero_copy_only=False).astype(float)[:, None]
            x = batch.column(0).flatten().to_numpy().reshape(len(y), -1)
            acts, masks = [x], []
            for k, (w, b) in enumerate(layers):
                z = acts[-1] @ w.T + b
                if k < len(layers) - 1:
                    rate = drop[k] if k < len(drop) else 0.0
                    mask = (rng.random(z.shape) >= rate) / (1 - rate)
                    masks.append(mask * (z > 0))
                    acts.append(np.maximum(z, 0) * mask)
                else:
                    acts.append(1 / (1 + np.exp(-np.clip(z, -50, 50))))
            p = np.clip(acts[-1], 1e-9, 1 - 1e-9)
            loss -= float((y * np.log(p) + (1 - y) * np.log(1 - p)).sum())
            back = acts[-1] - y
            for k in range(len(layers) - 1, -1, -1):
                total[k][0] += back.T @ acts[k]
                total[k][1] += back.sum(axis=0)
                if k:
                    back = (back @ layers[k][0]) * masks[k - 1]
            rows += len(y)
        flat = np.concatenate([np.concatenate([g.ravel(), h]) for g, h in total] + [[loss, rows]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], ["i", "g"])

    return run


def fit_mlp(df: DataFrame, features: Column, label: str, size: int, hidden: tuple[int, ...] = (64, 32, 16), epochs: int = 200, rate: float = 0.008, momentum: float = 0.92, decay: float = 1e-4, drop: tuple[float, ...] = (0.12, 0.08), seed: int = 42, of: str | None = None) -> dict:
    """A ReLU perceptron by full-batch gradient steps with momentum, dropout, L2 and a cosine rate.

    Each step is one job: tasks sum gradients over their rows, Spark adds the tasks' sums.
    """
    rng = np.random.default_rng(seed)
    widths = (size, *hidden, 1)
    layers = [[rng.normal(size=(b, a)) * np.sqrt(2 / a), np.zeros(b)] for a, b in zip(widths, widths[1:], strict=False)]
    speed = [[np.zeros_like(w), np.zeros_like(b)] for w, b in layers]
    spark = df.sparkSession
    rows = materialize((df if of is None else df.where(of)).select(features.alias("x"), F.col(label).cast("double").alias("y")), "mlp-rows")
    sc = spark.sparkContext
    for turn in range(epochs):
        state = sc.broadcast(layers)
        sums = rows.mapInArrow(_gradients(state, drop, seed + turn), "i int, g double").groupBy("i").agg(F.sum("g").alias("g")).toPandas().sort_values("i")["g"].to_numpy()
        state.unpersist()
        n = max(1.0, sums[-1])
        now, at = rate * 0.5 * (1 + np.cos(np.pi * turn / max(1, epochs))), 0
        for k, (w, b) in enumerate(layers):
            gw = sums[at : at + w.size].reshape(w.shape) / n + decay * w
            gb = sums[at + w.size : at + w.size + b.size] / n
            at += w.size + b.size
            speed[k] = [momentum * speed[k][0] - now * gw, momentum * speed[k][1] - now * gb]
            layers[k] = [w + speed[k][0], b + speed[k][1]]
    return {"layers": [[w.tolist(), b.tolist()] for w, b in layers]}


def compare(df: DataFrame, label: str, scores: dict[str, str], least_specificity: float = 0.70, least_recall: float = 0.0) -> DataFrame:
    """One row per model: AUC and its chosen threshold with the metrics there."""
    out = None
    for name, column in scores.items():
        row = thresholds.specificity_first(df, label, column, least_specificity, least_recall)
        row = row.select(F.lit(name).alias("model"), "threshold", "balanced_accuracy", "specificity", "recall", "f1")
        row = row.crossJoin(metrics.auc(df, label, column))  # one row each
        out = row if out is None else out.unionByName(row)
    return out


def selected(report: DataFrame, keys: list[str]) -> DataFrame:
    """The model whose keys are largest, in order; ties by name."""
    return report.orderBy(*[F.desc(k) for k in keys], "model").limit(1)
