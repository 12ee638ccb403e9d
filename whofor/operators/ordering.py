"""Ordered work on keys that may be huge.

A plain window partitioned by conversation or device puts the largest one in
a single task. These helpers split a key into pieces first, so every window
below runs on a bounded piece and only one summary row per piece is ordered
over the whole key. Keys must not be null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_ROWS = 4096


def number_rows(df: DataFrame, keys: list[str], order: list, piece: Column,
                out: str = "pos") -> DataFrame:
    """A dense 0-based position of every row inside its key.

    ``piece`` must not decrease along ``order`` (a time bucket, an index
    divided by a constant): positions are counted per piece and shifted by
    the sizes of the pieces before it.
    """
    d = df.withColumn("__piece", piece)
    sizes = d.groupBy(*keys, "__piece").agg(F.count(F.lit(1)).alias("__n"))
    before = (Window.partitionBy(*keys).orderBy("__piece")
              .rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(*keys, "__piece",
                          F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(*keys, "__piece").orderBy(*order)
    return (d.join(starts, [*keys, "__piece"])
            .withColumn(out, F.col("__start") + F.row_number().over(inside) - 1)
            .drop("__piece", "__start"))


def overlap(df: DataFrame, keys: list[str], pos: str = "pos", back: int = 0,
            ahead: int = 0, size: int = CHUNK_ROWS) -> DataFrame:
    """Cut each key into runs of ``size`` rows that share their edges.

    A run also gets the last ``back`` rows of the run before it and the first
    ``ahead`` rows of the one after, marked ``own = false``, so any window
    reaching no further than that is exact inside ``(keys, run)``.
    """
    own = F.floor(F.col(pos) / F.lit(size)).cast("long")
    offset = F.col(pos) - own * F.lit(size)
    runs = F.array_compact(F.array(
        own,
        F.when(offset >= size - back, own + 1),
        F.when((offset < ahead) & (own > 0), own - 1)))
    return (df.withColumn("__own", own).withColumn("run", F.explode(runs))
            .withColumn("own", F.col("run") == F.col("__own")).drop("__own"))


def own_rows(df: DataFrame) -> DataFrame:
    return df.where(F.col("own")).drop("own", "run")


def run_window(keys: list[str], pos: str = "pos"):
    return Window.partitionBy(*keys, "run").orderBy(pos)


def carry_last(df: DataFrame, keys: list[str], value: Column, out: str, pos: str = "pos",
               inclusive: bool = False, size: int = CHUNK_ROWS) -> DataFrame:
    """The last non-null ``value`` before each row (or up to it), however far back."""
    return carry_all(df, keys, {out: value}, pos, inclusive, size)


def carry_all(df: DataFrame, keys: list[str], values: dict[str, Column], pos: str = "pos",
              inclusive: bool = False, size: int = CHUNK_ROWS) -> DataFrame:
    """``carry_last`` of several values in one pass."""
    held = {f"__v{i}": v for i, v in enumerate(values.values())}
    d = df.withColumns({**held, "__run": F.floor(F.col(pos) / F.lit(size)).cast("long")})
    ends = d.groupBy(*keys, "__run").agg(*[
        F.max_by(v, F.when(F.col(v).isNotNull(), F.col(pos))).alias(f"{v}_end") for v in held])
    earlier = (Window.partitionBy(*keys).orderBy("__run")
               .rowsBetween(Window.unboundedPreceding, -1))
    carried = ends.select(*keys, "__run", *[
        F.last(f"{v}_end", ignorenulls=True).over(earlier).alias(f"{v}_carried") for v in held])
    inside = (Window.partitionBy(*keys, "__run").orderBy(pos)
              .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
    found = {out: F.coalesce(F.last(v, ignorenulls=True).over(inside), F.col(f"{v}_carried"))
             for out, v in zip(values, held)}
    return d.join(carried, [*keys, "__run"]).withColumns(found).drop(
        "__run", *held, *[f"{v}_carried" for v in held])


def first_ranked(df: DataFrame, keys: list[str], order: list, n: int,
                 spread: Column, lanes: int = 32) -> DataFrame:
    """The first ``n`` rows of every key in ``order``.

    Each key is cut into ``lanes`` by ``spread`` and trimmed to ``n`` per lane
    first, so the last ranking sees at most ``lanes * n`` rows of a key.
    """
    lane = F.pmod(F.xxhash64(spread), F.lit(lanes))
    local = Window.partitionBy(*keys, "__lane").orderBy(*order)
    final = Window.partitionBy(*keys).orderBy(*order)
    return (df.withColumn("__lane", lane)
            .withColumn("__r", F.row_number().over(local)).where(F.col("__r") <= n)
            .withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= n)
            .drop("__lane", "__r"))


def settle(df: DataFrame, names: list[str]) -> DataFrame:
    """Evaluate these columns once, here.

    A filter on a computed column is normally pushed below the projection that
    computes it, which means a second copy of the expression; for a score made
    of sixty patterns that copy is slow to plan and slow to run. Passing the
    columns through a one-element generator keeps filters above it.
    """
    rest = [c for c in df.columns if c not in names]
    return df.select(*rest, F.inline(F.array(F.struct(*names))))
