"""Small numeric column helpers."""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(x: Column, clamp: float | None = None) -> Column:
    if clamp is not None:
        x = F.when(x > clamp, clamp).when(x < -clamp, -clamp).otherwise(x)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def total(cols: list[Column]) -> Column:
    """Left-to-right sum, so both engines add in the same order."""
    return reduce(add, cols)


def any_of(cols: list[Column]) -> Column:
    return reduce(or_, cols, F.lit(False))


def is_true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def count_if(c: Column) -> Column:
    return F.sum(F.when(c, 1).otherwise(0)).cast("long")


def safe_div(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def rate(k: Column, n: Column, digits: int = 4) -> Column:
    """k/n, or null when n is 0."""
    return F.round(safe_div(k, n), digits)


def wilson_upper(k: Column, n: Column, z: float = 1.96) -> Column:
    """Upper confidence bound on a rate seen as k of n; 0 of 0 is 1, not 0."""
    nd = F.nullif(n.cast("double"), F.lit(0.0))
    p = k / nd
    z2 = F.lit(z * z)
    centre = p + z2 / (F.lit(2.0) * nd)
    margin = F.lit(z) * F.sqrt(p * (F.lit(1.0) - p) / nd + z2 / (F.lit(4.0) * nd * nd))
    bound = (centre + margin) / (F.lit(1.0) + z2 / nd)
    return F.coalesce(F.least(F.lit(1.0), bound), F.lit(1.0))


def bound(k: Column, n: Column, z: float) -> Column:
    """The plain rate at z = 0, otherwise the Wilson bound; 0 when n is 0."""
    value = safe_div(k, n) if z <= 0 else wilson_upper(k, n, z)
    return F.when(n == 0, F.lit(0.0)).otherwise(value)


def rate_columns(name: str, k: Column, n: Column) -> list[Column]:
    return [k.alias(f"{name}_k"), n.alias(f"{name}_n"), rate(k, n).alias(f"{name}_rate"),
            F.when(n > 0, F.round(wilson_upper(k, n), 4)).alias(f"{name}_upper95")]


def argmax(values: list[tuple[str, Column]]) -> tuple[Column, Column]:
    """(name, value) of the largest entry; the first listed wins a tie."""
    best = F.array_max(F.array(*[
        F.struct(F.coalesce(v, F.lit(float("-inf"))).alias("v"), F.lit(-i).alias("i"),
                 F.lit(n).alias("n"))
        for i, (n, v) in enumerate(values)]))
    return best["n"], best["v"]


def literal_map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def hash_pick(salt: str, n: int | Column, *keys) -> Column:
    """A seeded index in [0, n): the same for the same keys, in any partitioning."""
    size = F.lit(n) if isinstance(n, int) else n
    return F.pmod(F.xxhash64(F.lit(salt), *keys), size.cast("long")).cast("int")


def hash_unit(salt: str, *keys) -> Column:
    """A seeded draw in [0, 1)."""
    return F.pmod(F.xxhash64(F.lit(salt), *keys), F.lit(1 << 40)) / F.lit(float(1 << 40))
