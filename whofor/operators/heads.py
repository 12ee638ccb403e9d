"""Softmax heads over pooled vectors: targets, fitting, scoring, calibration."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from whofor import fixed as V
from whofor.operators.catalogue import CORE, Catalogue

WEIGHT_FLOOR = 1e-6
TEMPERATURES = tuple(float(t) for t in np.exp(np.linspace(np.log(0.25), np.log(8.0), 61)))


# -- rows and vectors ------------------------------------------------------------------------

def join_vectors(rows: DataFrame, vectors: DataFrame) -> DataFrame:
    """Rows with their vector; of repeated vectors for an id the last (by ``seq``) counts."""
    last = vectors.groupBy("id").agg(
        F.max_by(F.struct("vector", "encode_ms"), "seq").alias("v"))
    return rows.join(last, "id").select("*", "v.vector", "v.encode_ms").drop("v")


# -- targets -----------------------------------------------------------------------------------

def head_names(catalogue: Catalogue = CORE) -> dict[str, list[str]]:
    return {"addressed": list(V.ADDRESSEES), "intent": catalogue.names,
            **catalogue.slot_heads()}


def target_column(head: str) -> str:
    return "y_" + head.replace(":", "__").replace(".", "_")


def _blend(teacher: Column, gold: Column, mode: str, w: float) -> Column:
    if mode == "teacher":
        return teacher
    if mode == "gold":
        return gold
    both = F.zip_with(gold, teacher, lambda g, t: w * g + (1.0 - w) * t)
    return F.coalesce(both, gold, teacher)


def _one_hot(classes: list[str], value: Column, p: Column | float = 1.0) -> Column:
    """p on the class, the rest spread evenly; null when the value is no class."""
    p = F.lit(p) if isinstance(p, float) else p
    rest = (1.0 - p) / max(len(classes) - 1, 1)
    return F.when(value.isin(*classes), F.array(*[
        F.when(value == c, p).otherwise(rest) for c in classes]))


def _scaled(v: Column) -> Column:
    s = F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    return F.when(s > 0, F.transform(v, lambda x: x / s))


def build_targets(df: DataFrame, catalogue: Catalogue = CORE, mode: str = "teacher",
                  gold_weight: float = 0.5) -> DataFrame:
    """Adds one target array per head; null where a row does not teach that head."""
    if mode not in ("teacher", "gold", "mix"):
        raise ValueError("mode must be teacher, gold or mix")
    names, who = catalogue.names, list(V.ADDRESSEES)
    t_who = F.when(F.size("t_addressed") > 0, F.array(*[
        F.coalesce(F.try_element_at(F.col("t_addressed"), F.lit(a)), F.lit(0.0)) for a in who]))
    g_who = F.when(F.col("g_addressed") != "", F.array(*[
        F.when(F.col("g_addressed") == a, 1.0).otherwise(0.0) for a in who]))
    even = F.array(*[F.lit(1.0 / len(who)) for _ in who])
    d = df.withColumn("y_addressed", F.coalesce(
        _scaled(_blend(t_who, g_who, mode, gold_weight)), even))

    soft = _scaled(F.when(F.size("t_intent_probs") > 0, F.array(*[
        F.coalesce(F.try_element_at(F.col("t_intent_probs"), F.lit(n)), F.lit(0.0))
        for n in names])))
    t_int = F.coalesce(soft, _one_hot(names, F.col("t_intent"),
                                      F.coalesce(F.col("t_intent_p"), F.lit(1.0))))
    g_int = _one_hot(names, F.col("g_intent"))
    taught = F.get("y_addressed", F.lit(0)) >= 0.5
    d = d.withColumn("y_intent", F.when(taught, _blend(t_int, g_int, mode, gold_weight)))

    chosen = F.get(F.array(*[F.lit(n) for n in names]),
                   (F.array_position("y_intent", F.array_max("y_intent")) - 1).cast("int"))
    d = d.withColumn("__chosen", F.when(F.col("y_intent").isNotNull(), chosen))
    for key, classes in catalogue.slot_heads().items():
        intent, slot = key.split(":")

        def class_of(values, slot=slot, classes=classes):
            v = F.try_element_at(F.col(values), F.lit(slot))
            return _one_hot(classes, F.when(v.isin(*classes), v)
                            .when(v.isNotNull(), F.lit(V.OTHER)))
        y = _scaled(_blend(class_of("t_slots"), class_of("g_slots"), mode, gold_weight))
        d = d.withColumn(target_column(key), F.when(F.col("__chosen") == intent, y))
    return d.drop("__chosen")


# -- the model -----------------------------------------------------------------------------------

@dataclass
class HeadsModel:
    """A few small matrices and the card that says what they mean."""

    mean: np.ndarray
    scale: np.ndarray
    heads: dict                                  # head -> (weights d x k, bias k)
    classes: dict                                # head -> class names
    temperatures: dict = field(default_factory=dict)
    hidden: tuple | None = None                  # (W1, b1), when there is a hidden layer
    encoder: str = ""
    thresholds: object = None
    card: dict = field(default_factory=dict)

    def logits(self, X: np.ndarray) -> dict:
        H = (X - self.mean) / self.scale
        if self.hidden is not None:
            H = np.maximum(0.0, H @ self.hidden[0] + self.hidden[1])
        return {h: H @ W + b for h, (W, b) in self.heads.items()}


def _softmax(z: np.ndarray, t: float = 1.0) -> np.ndarray:
    z = z / max(t, 1e-6)
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _gradient_sums(data: DataFrame, targets: list[str], sizes: list[int], dim: int, lanes: int):
    """A function of the weights: losses, row weights and gradients of all heads over all rows.

    One pass over the rows: a task adds up its batches in matrices and passes on one row, and
    ``lanes`` tasks add those up again, so the driver gets ``lanes`` rows however many there are.
    """
    spark = data.sparkSession
    bounds = np.cumsum([0, *[(dim + 1) * k for k in sizes]])
    width = int(bounds[-1]) + 2 * len(sizes)
    empty = pa.schema([("sums", pa.binary())])

    def evaluate(theta: np.ndarray):
        shared = spark.sparkContext.broadcast(theta)

        def partial(batches):
            total, theta = np.zeros(width), shared.value
            for batch in batches:
                n = batch.num_rows
                X = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(n, dim)
                X = np.concatenate((X, np.ones((n, 1))), axis=1)
                w = batch.column("w").to_numpy(zero_copy_only=False)
                for h, (y, k) in enumerate(zip(targets, sizes)):
                    taught = batch.column(y).is_valid().to_numpy(zero_copy_only=False)
                    if not taught.any():
                        continue
                    Y = batch.column(y).drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
                    Xh, wh = X[taught], w[taught][:, None] * Y.sum(axis=1, keepdims=True)
                    P = _softmax(Xh @ theta[bounds[h]:bounds[h + 1]].reshape(dim + 1, k))
                    total[bounds[h]:bounds[h + 1]] += (Xh.T @ (wh * P - w[taught][:, None] * Y)).ravel()
                    total[bounds[-1] + 2 * h] -= float((w[taught][:, None] * Y * np.log(P + 1e-300)).sum())
                    total[bounds[-1] + 2 * h + 1] += float(wh.sum())
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], schema=empty)

        def added(batches):
            total = np.zeros(width)
            for batch in batches:
                for row in batch.column("sums").to_pylist():
                    total += np.frombuffer(row)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], schema=empty)
        rows = data.mapInArrow(partial, "sums binary").repartition(lanes).mapInArrow(added, "sums binary").collect()
        shared.destroy()
        total = np.sum([np.frombuffer(r["sums"]) for r in rows], axis=0)
        return total[bounds[-1]::2], total[bounds[-1] + 1::2], [
            total[lo:hi].reshape(dim + 1, k) for lo, hi, k in zip(bounds, bounds[1:], sizes)]
    return evaluate


def quasi_newton(f, x: np.ndarray, max_iter: int, tol: float = 1e-6, memory: int = 10) -> np.ndarray:
    """The minimum of a smooth convex ``f`` (value and gradient), by limited-memory updates."""
    value, grad = f(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(max_iter):
        if np.abs(grad).max() < tol:
            break
        q, a = grad.copy(), []
        for s, y in reversed(past):
            a.append((s @ q) / (y @ s))
            q -= a[-1] * y
        q *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1.0 / max(np.linalg.norm(grad), 1.0)
        for (s, y), c in zip(past, reversed(a)):
            q += (c - (y @ q) / (y @ s)) * s
        step, slope = 1.0, float(grad @ q)
        while True:
            new, new_grad = f(x - step * q)
            if new <= value - 1e-4 * step * slope or step < 1e-8:
                break
            step /= 2
        s, y = -step * q, new_grad - grad
        if new > value:
            break
        x, value, grad = x + s, new, new_grad
        if y @ s > 1e-14:
            past = [*past, (s, y)][-memory:]
    return x


def fit_heads(df: DataFrame, catalogue: Catalogue = CORE, vector: str = "vector",
              encoder: str = "", l2: float = 1e-4, weight: str | None = None,
              max_iter: int = 100, lanes: int = 8) -> HeadsModel:
    """Softmax heads on soft targets: cross-entropy with a ridge, all heads in one gradient.

    Every step is one pass over the rows as they are: a soft label stays one row, a vector one
    array, whatever their sizes. A floor of weight per class keeps classes nobody has from
    vanishing. Rows without a vector of the common length teach nothing.
    """
    s = df.where(F.col(vector).isNotNull()).select(array_to_vector(F.col(vector)).alias("x")).agg(
        Summarizer.mean(F.col("x")).alias("m"), Summarizer.variance(F.col("x")).alias("v"),
        F.count(F.lit(1)).alias("n")).first()
    n = s["n"]
    mean = np.asarray(s["m"].toArray())
    scale = np.sqrt(np.asarray(s["v"].toArray()) * max(n - 1, 1) / max(n, 1))
    scale[scale < 1e-6] = 1.0
    dim, names = len(mean), head_names(catalogue)
    targets, sizes = [target_column(h) for h in names], [len(c) for c in names.values()]
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    data = df.where((F.size(vector) == dim) & F.coalesce(*targets).isNotNull()).select(
        F.col(vector).cast("array<double>").alias("x"), w.alias("w"),
        *[F.col(y).cast("array<double>").alias(y) for y in targets]).persist()
    sums = _gradient_sums(data, targets, sizes, dim, lanes)
    bounds = np.cumsum([0, *[(dim + 1) * k for k in sizes]])

    def raw(theta):
        """Weights on the vectors as they are, from weights on the scaled ones."""
        out = []
        for lo, hi, k in zip(bounds, bounds[1:], sizes):
            t = theta[lo:hi].reshape(dim + 1, k)
            W = t[:-1] / scale[:, None]
            out.append(np.concatenate((W, t[-1:] - mean @ W)).ravel())
        return np.concatenate(out)

    def objective(theta):
        losses, weights, grads = sums(raw(theta))
        value, out = 0.0, []
        for h, (lo, hi, k) in enumerate(zip(bounds, bounds[1:], sizes)):
            t = theta[lo:hi].reshape(dim + 1, k)
            floor = _softmax(t[-1])
            total = weights[h] + WEIGHT_FLOOR * k
            value += (losses[h] - WEIGHT_FLOOR * np.log(floor).sum()) / total + 0.5 * l2 * (t[:-1] ** 2).sum()
            # The chain rule of the scaling: only sums of x and of the residual are needed.
            residual = grads[h][-1]
            g = np.concatenate(((grads[h][:-1] - np.outer(mean, residual)) / scale[:, None],
                                (residual + WEIGHT_FLOOR * (k * floor - 1.0))[None])) / total
            g[:-1] += l2 * t[:-1]
            out.append(g.ravel())
        return value, np.concatenate(out)
    try:
        theta = quasi_newton(objective, np.zeros(int(bounds[-1])), max_iter)
    finally:
        data.unpersist()
    fitted = {h: theta[lo:hi].reshape(dim + 1, k) for h, lo, hi, k in zip(names, bounds, bounds[1:], sizes)}
    return HeadsModel(mean, scale, {h: (t[:-1], t[-1]) for h, t in fitted.items()}, names, encoder=encoder)


def score_heads(df: DataFrame, model: HeadsModel, vector: str = "vector") -> DataFrame:
    """Adds ``addressed``, ``intents`` and ``slot_probs`` maps: a matrix product per batch.

    A vector of the wrong length or with a non-finite value gives null maps.
    """
    order = list(model.heads)
    sizes = [len(model.classes[h]) for h in order]
    dim = len(model.mean)

    @F.pandas_udf(ArrayType(DoubleType()))
    def probs(v: pd.Series) -> pd.Series:
        good = np.array([x is not None and len(x) == dim and bool(np.isfinite(x).all())
                         for x in v], dtype=bool)
        out = pd.Series([None] * len(v), dtype=object)
        if good.any():
            X = np.stack(v[good].to_list()).astype(np.float64)
            z = model.logits(X)
            P = np.concatenate([_softmax(z[h], model.temperatures.get(h, 1.0)) for h in order], 1)
            out[good] = pd.Series(list(P), index=out.index[good])
        return out

    d = df.withColumn("__p", probs(F.col(vector)))
    start, maps = 1, {}
    for h, k in zip(order, sizes):
        maps[h] = F.map_from_arrays(F.array(*[F.lit(c) for c in model.classes[h]]),
                                    F.slice("__p", start, k))
        start += k
    slots = [h for h in order if ":" in h]
    slot_map = F.create_map(*[x for h in slots for x in (F.lit(h), maps[h])]) if slots \
        else F.create_map().cast("map<string,map<string,double>>")
    ok = F.col("__p").isNotNull()
    return d.withColumns({"addressed": F.when(ok, maps["addressed"]),
                          "intents": F.when(ok, maps["intent"]),
                          "slot_probs": F.when(ok, slot_map)}).drop("__p")


def calibrate_temperature(df: DataFrame, logits: str, target: str) -> DataFrame:
    """One row ``temperature``: the grid value with the least mean loss on taught rows.

    Each batch reduces to 61 partial sums before anything is shuffled; fewer
    than five rows leave it at 1.
    """
    grid = np.asarray(TEMPERATURES)

    def partial(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            z, y = np.stack(pdf["z"].to_list()), np.stack(pdf["y"].to_list())
            loss = [float(-(y * np.log(_softmax(z, t) + 1e-9)).sum()) for t in grid]
            yield pd.DataFrame({"i": np.arange(len(grid)), "loss": loss, "n": len(pdf)})
    sums = df.where(F.col(target).isNotNull()) \
        .select(F.col(logits).cast("array<double>").alias("z"),
                F.col(target).cast("array<double>").alias("y")) \
        .mapInPandas(partial, "i int, loss double, n long") \
        .groupBy("i").agg(F.sum("loss").alias("loss"), F.sum("n").alias("n"))
    table = F.array(*[F.lit(t) for t in TEMPERATURES])
    best = sums.groupBy().agg(
        F.min_by("i", F.struct(F.col("loss") / F.col("n"), "i")).alias("i"),
        F.max("n").alias("n"))
    return best.select(F.when(F.coalesce("n", F.lit(0)) < 5, 1.0)
                       .otherwise(F.round(F.get(table, F.col("i")), 4)).alias("temperature"))


def calibrated(df: DataFrame, model: HeadsModel, vector: str = "vector") -> HeadsModel:
    """The model with a temperature per head, fitted on ``df`` (targets already built).

    One pass for all heads: a batch adds up every head's loss at every temperature of the grid.
    """
    order, grid = list(model.heads), np.asarray(TEMPERATURES)
    targets, dim = [target_column(h) for h in order], len(model.mean)

    def partial(batches):
        loss, seen = np.zeros((len(order), len(grid))), np.zeros(len(order), dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            z = model.logits(batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
            for h, y in enumerate(targets):
                taught = batch.column(y).is_valid().to_numpy(zero_copy_only=False)
                if taught.any():
                    Y = batch.column(y).drop_null().flatten().to_numpy(zero_copy_only=False).reshape(int(taught.sum()), -1)
                    loss[h] -= [(Y * np.log(_softmax(z[order[h]][taught], t) + 1e-9)).sum() for t in grid]
                    seen[h] += len(Y)
        head, k = np.divmod(np.arange(loss.size), len(grid))
        yield pa.RecordBatch.from_arrays([pa.array(head), pa.array(k), pa.array(loss.ravel()), pa.array(seen[head])],
                                         ["head", "k", "loss", "n"])
    rows = df.where(F.size(vector) == dim).select(
        F.col(vector).cast("array<double>").alias("x"), *[F.col(y).cast("array<double>").alias(y) for y in targets])
    best = rows.mapInArrow(partial, "head long, k long, loss double, n long").groupBy("head", "k").agg(
        F.sum("loss").alias("loss"), F.sum("n").alias("n")).groupBy("head").agg(
        F.min_by("k", F.struct("loss", "k")).alias("k"), F.max("n").alias("n")).collect()
    temps = {h: 1.0 for h in order} | {order[r["head"]]: round(float(grid[r["k"]]), 4) for r in best if r["n"] >= 5}
    return HeadsModel(model.mean, model.scale, model.heads, model.classes, temps, model.hidden,
                      model.encoder, model.thresholds, model.card)


# -- the model as a table ---------------------------------------------------------------------------

MODEL_TYPE = "part string, position int, name string, weights array<double>, bias double"


def model_table(spark, model: HeadsModel) -> DataFrame:
    """One row per class of each head, plus the scaler (and hidden layer) rows."""
    rows = [("x_mean", 0, "", [float(v) for v in model.mean], None),
            ("x_scale", 0, "", [float(v) for v in model.scale], None)]
    if model.hidden is not None:
        W1, b1 = model.hidden
        rows += [("hidden", i, "", [float(v) for v in W1[:, i]], float(b1[i]))
                 for i in range(W1.shape[1])]
    for h, (W, b) in model.heads.items():
        rows += [(h, i, c, [float(v) for v in W[:, i]], float(b[i]))
                 for i, c in enumerate(model.classes[h])]
    return spark.createDataFrame(rows, MODEL_TYPE)


def model_problems(table: DataFrame) -> DataFrame:
    """One row per thing wrong with a model table; none when it can be used."""
    bad = F.exists("weights", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    broken = table.where(bad | F.isnan("bias") | (F.abs("bias") == float("inf"))) \
        .select("part", F.lit("non-finite values").alias("problem")).distinct()
    needed = table.sparkSession.createDataFrame(
        [(p,) for p in ("x_mean", "x_scale", "addressed", "intent")], "part string")
    missing = needed.join(table, "part", "left_anti").select("part",
                                                             F.lit("missing").alias("problem"))
    return broken.unionByName(missing)


def load_heads(table: DataFrame, temperatures: dict | None = None) -> HeadsModel:
    """A model from its table (a few rows per class)."""
    problems = model_problems(table).limit(5).collect()
    if problems:
        raise ValueError(f"{problems[0]['part']}: {problems[0]['problem']}")
    parts: dict = {}
    for r in table.orderBy("part", "position").collect():
        parts.setdefault(r["part"], []).append(r)
    mean, scale = (np.asarray(parts.pop(k)[0]["weights"]) for k in ("x_mean", "x_scale"))

    def matrix(rows):
        return np.asarray([r["weights"] for r in rows]).T, np.asarray([r["bias"] for r in rows])
    hidden = matrix(parts.pop("hidden")) if "hidden" in parts else None
    return HeadsModel(mean, scale, {h: matrix(r) for h, r in parts.items()},
                      {h: [x["name"] for x in r] for h, r in parts.items()},
                      temperatures or {}, hidden)
