"""Numeric column functions with IEEE semantics, where Spark's own differ from those of a matrix program."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def ieee_div(a: Column, b: Column) -> Column:
    """``a / b`` with 0/0 = NaN and x/0 = +-inf; null if either is null. The sign of a zero divisor isn't seen."""
    zero = b == 0
    return (
        F.when(a.isNull() | b.isNull(), None)
        .when(F.isnan(a) | F.isnan(b), F.lit(NAN))
        .when(~zero, F.try_divide(a, b))
        .when(zero & (a == 0), F.lit(NAN))
        .when(zero & (a > 0), F.lit(INF))
        .otherwise(F.lit(-INF))
    )


def _whole(x: Column, rounded: Column) -> Column:
    # from 2**53 on every double is whole, and a cast to bigint would saturate
    return F.when(F.isnan(x) | (F.abs(x) >= float(2**53)), x).otherwise(rounded.cast("double"))


def ceil(x: Column) -> Column:
    return _whole(x, F.ceil(x))


def floor(x: Column) -> Column:
    return _whole(x, F.floor(x))


def indicator(condition: Column) -> Column:
    """1.0 where the condition holds, else 0.0 (also where it is null)."""
    return F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0))


def less(a: Column, b: Column) -> Column:
    """IEEE ``a < b`` as 0/1: NaN compares to nothing, while Spark sorts it last."""
    return indicator(~F.isnan(a) & ~F.isnan(b) & (a < b))


def greater(a: Column, b: Column) -> Column:
    return less(b, a)


def less_equal(a: Column, b: Column) -> Column:
    return indicator(~F.isnan(a) & ~F.isnan(b) & (a <= b))


def clamp(x: Column, low: Column, high: Column) -> Column:
    """The pair ``ifelse(x < low, low, x)``, ``ifelse(x > high, high, x)``; NaN and null stay."""
    return F.when(F.isnan(x) | x.isNull(), x).otherwise(F.least(F.greatest(x, low), high))


def repeated(start: Column, times: int, step: Callable[[Column], Column]) -> Column:
    """``step`` applied ``times`` times. One expression whatever the number, so plans stay small."""
    if times <= 0:
        return start
    return F.aggregate(F.sequence(F.lit(1), F.lit(times)), start, lambda x, _: step(x))


def repeated_abs(x: Column, times: int) -> Column:
    """``abs`` is idempotent: any positive number of applications is one."""
    return F.abs(x) if times > 0 else x


def repeated_sqrt(x: Column, times: int) -> Column:
    return repeated(x.cast("double"), times, F.sqrt)


def hash_uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) that depends on seed and keys alone, not on partitions."""
    return (F.xxhash64(F.lit(seed).cast("long"), *keys).bitwiseAND(F.lit(2**53 - 1))).cast("double") / F.lit(float(2**53))


def hash_normal(seed: int, *keys: Column) -> Column:
    """A standard normal number from two hashed uniforms (Box-Muller)."""
    u = hash_uniform(seed, F.lit(1), *keys)
    v = hash_uniform(seed, F.lit(2), *keys)
    return F.sqrt(-2.0 * F.log(1.0 - u)) * F.cos(2.0 * F.pi() * v)
