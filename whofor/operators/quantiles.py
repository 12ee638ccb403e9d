"""Exact order statistics without sorting a group in one task.

Values are first counted, then dealt to ranges whose bounds Spark samples from the counted values
themselves, so a range holds about its share of the distinct values however they are massed. The
ranges are kept once (a reliable checkpoint); only the range a rank falls in is ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from whofor.session import cut_lineage


def ranged(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with ``__b``: the number of its range; larger values never have a smaller one."""
    return cut_lineage(df.repartitionByRange(*columns).withColumn("__b", F.spark_partition_id()))


def _counted(df: DataFrame, keys: list[str], value: Column) -> DataFrame:
    d = df.select(*keys, value.cast("double").alias("__v")).where(F.col("__v").isNotNull())
    return ranged(d.groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__n")), [*keys, "__v"])


def order_statistics(df: DataFrame, keys: list[str], value: Column, ranks: dict,
                     extra: DataFrame | None = None) -> DataFrame:
    """One row per key and name: the value at a 0-based rank.

    ``ranks`` maps a name to a rank column, in terms of ``n`` (rows of the key)
    and of the columns of the one-row frame ``extra``. Ranks outside [0, n)
    give no row.
    """
    keys = list(keys)
    counted = _counted(df, keys, value)
    hist = counted.groupBy(*keys, "__b").agg(F.sum("__n").alias("__n"))
    part = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    ordered = part.orderBy("__b")
    hist = (hist
            .withColumn("__before", F.sum("__n").over(ordered) - F.col("__n"))
            .withColumn("n", F.sum("__n").over(
                part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    if extra is not None:
        for name in extra.columns:
            hist = hist.withColumn(name, extra.select(name).scalar())
    wanted = F.explode(F.array(*[
        F.struct(F.lit(name).alias("stat"), rank.cast("long").alias("rank"))
        for name, rank in ranks.items()]))
    hit = (hist.withColumn("__w", wanted)
           .select(*keys, "__b", "__n", "__before", "n", "__w.stat", "__w.rank")
           .where((F.col("rank") >= F.col("__before"))
                  & (F.col("rank") < F.col("__before") + F.col("__n")))
           .drop("__n"))
    inside = counted.join(hit, [*keys, "__b"])
    w = (Window.partitionBy(*keys, "__b", "stat").orderBy("__v")
         .rowsBetween(Window.unboundedPreceding, 0))
    upto = F.col("__before") + F.sum("__n").over(w)
    return (inside.withColumn("__upto", upto)
            .where((F.col("rank") < F.col("__upto"))
                   & (F.col("rank") >= F.col("__upto") - F.col("__n")))
            .select(*keys, "stat", "rank", "n", F.col("__v").alias("value")))


def quantiles(df: DataFrame, keys: list[str], value: Column, probs: dict,
              digits: int | None = None) -> DataFrame:
    """Linear-interpolated quantiles, one column per name, plus ``n``."""
    n = F.col("n")
    ranks = {}
    for name, p in probs.items():
        ranks[f"{name}|lo"] = F.floor((n - 1) * F.lit(float(p)))
        ranks[f"{name}|hi"] = F.ceil((n - 1) * F.lit(float(p)))
    stats = order_statistics(df, keys, value, ranks)
    wide = stats.groupBy(*keys).agg(
        F.max("n").alias("n"),
        *[F.max(F.when(F.col("stat") == s, F.col("value"))).alias(s) for s in ranks])
    out = []
    for name, p in probs.items():
        lo, hi = F.col(f"`{name}|lo`"), F.col(f"`{name}|hi`")
        at = (n - 1) * F.lit(float(p))
        q = lo + (hi - lo) * (at - F.floor(at))
        out.append((F.round(q, digits) if digits is not None else q).alias(name))
    return wide.select(*keys, "n", *out)


def running_sums(df: DataFrame, value: str, sums: list[str]) -> DataFrame:
    """``df`` (one row per distinct value) with ``<name>_before`` running sums.

    No task orders more than a range, and one row per range is ordered over all.
    """
    d = ranged(df, [value])
    hist = d.groupBy("__b").agg(*[F.sum(s).alias(s) for s in sums])
    w = (Window.partitionBy(F.lit(0)).orderBy("__b")
         .rowsBetween(Window.unboundedPreceding, -1))
    starts = hist.select("__b", *[F.coalesce(F.sum(s).over(w), F.lit(0)).alias(f"__s_{s}")
                                  for s in sums])
    inside = (Window.partitionBy("__b").orderBy(value)
              .rowsBetween(Window.unboundedPreceding, -1))
    d = d.join(starts, "__b")
    for s in sums:
        d = d.withColumn(f"{s}_before",
                         F.col(f"__s_{s}") + F.coalesce(F.sum(s).over(inside), F.lit(0)))
    return d.drop("__b", *[f"__s_{s}" for s in sums])
