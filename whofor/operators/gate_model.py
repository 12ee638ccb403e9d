"""Fitting and calibrating the logistic gate on feature tables."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from whofor import fixed as V
from whofor.functions.scalars import count_if
from whofor.functions.scalars import total as add_up
from whofor.operators.gate import GateModel


def _logistic(df: DataFrame, features: Column, y: Column, l2: float):
    """Coefficients and intercept of an L2 fit; a few numbers come back, never rows."""
    d = df.select(array_to_vector(features).alias("features"),
                  F.when(y, 1.0).otherwise(0.0).alias("label"))
    n = d.count()
    fit = LogisticRegression(regParam=l2 / n, elasticNetParam=0.0, standardization=False,
                             maxIter=200, tol=1e-10).fit(d)
    return [float(v) for v in fit.coefficients], float(fit.intercept)


def _balance(df: DataFrame) -> tuple[int, int]:
    r = df.agg(F.count(F.lit(1)), count_if(F.col("label") == V.ASSISTANT)).first()
    return r[0], r[1] or 0


def fit_logistic(train: DataFrame, l2: float = 1.0) -> GateModel:
    """z-scored features (population deviation), uncertain rows left out."""
    rows = train.where(F.col("label") != V.UNCERTAIN)
    n, pos = _balance(rows)
    if pos in (0, n):
        raise ValueError("training split needs both assistant-directed and other rows")
    stats = rows.agg(*[f(F.col(x)).alias(f"{k}_{x}") for x in V.FEATURE_NAMES
                       for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    mean = tuple(float(stats[f"m_{x}"]) for x in V.FEATURE_NAMES)
    raw = [float(stats[f"s_{x}"]) for x in V.FEATURE_NAMES]
    scale = tuple(1.0 if s < 1e-8 else s for s in raw)
    z = F.array(*[(F.col(x) - m) / s for x, m, s in zip(V.FEATURE_NAMES, mean, scale)])
    w, b = _logistic(rows, z, F.col("label") == V.ASSISTANT, l2)
    return GateModel(tuple(w), b, mean, scale)


def gate_logit(model: GateModel) -> Column:
    return add_up([(F.col(n) - m) / s * w for n, m, s, w in zip(
        V.FEATURE_NAMES, model.mean, model.scale, model.weights)]) + F.lit(model.bias)


def platt_calibrate(calibration: DataFrame, model: GateModel) -> GateModel:
    """Fold a one-feature calibration into the model, unless it would flip the ranking."""
    rows = calibration.where(F.col("label") != V.UNCERTAIN)
    n, pos = _balance(rows)
    if pos in (0, n):
        return model
    (a,), c = _logistic(rows, F.array(gate_logit(model)), F.col("label") == V.ASSISTANT, 1e-3)
    if a <= 0:
        return model
    return GateModel(tuple(w * a for w in model.weights), a * model.bias + c, model.mean,
                     model.scale, model.threshold)


def rounded(model: GateModel, threshold: float | None) -> GateModel:
    def r(values):
        return tuple(round(v, 8) for v in values)
    return GateModel(r(model.weights), round(model.bias, 8), r(model.mean), r(model.scale),
                     threshold)


def model_row(spark, model: GateModel, **facts) -> DataFrame:
    """The model as a one-row table."""
    row = {"feature_names": list(model.feature_names), "weights": list(model.weights),
           "bias": model.bias, "scaler_mean": list(model.mean),
           "scaler_scale": list(model.scale), "threshold": model.threshold}
    schema = ("feature_names array<string>, weights array<double>, bias double, "
              "scaler_mean array<double>, scaler_scale array<double>, threshold double")
    d = spark.createDataFrame([tuple(row.values())], schema)
    for k, v in facts.items():
        d = d.withColumn(k, F.lit(v))
    return d


def load_model(df: DataFrame) -> GateModel:
    r = df.first()
    return GateModel(tuple(r["weights"]), r["bias"], tuple(r["scaler_mean"]),
                     tuple(r["scaler_scale"]), r["threshold"], tuple(r["feature_names"]))
