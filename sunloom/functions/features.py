"""Calendar encodings, reference-time embeddings, normalisation and null handling, as Column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def calendar(ts: Column) -> dict[str, Column]:
    """date_sin, date_cos (2 pi dayofyear / 365) and time_sin, time_cos (2 pi minute of day / 1440)."""
    date = F.dayofyear(ts) * F.lit(2 * math.pi / 365)
    time = (F.hour(ts) * 60 + F.minute(ts)) * F.lit(2 * math.pi / 1440)
    return {"date_sin": F.sin(date), "date_cos": F.cos(date), "time_sin": F.sin(time), "time_cos": F.cos(time)}


def t0_fraction(ts: Column, period: str) -> Column:
    """Place of a time in a period such as 24h (hours, not wrapped) or 1y (leap years known; time of day ignored)."""
    n, unit = int(period[:-1]), period[-1]
    if unit == "h" and 1 <= n <= 24:
        return (F.hour(ts) + F.minute(ts) / 60.0) / n
    if unit == "y" and n >= 1:
        days = F.dayofyear(F.make_date(F.year(ts), F.lit(12), F.lit(31)))
        return ((F.dayofyear(ts) - 1) / days + F.year(ts) % n) / n
    raise ValueError(f"unknown period {period!r}")


def t0_embedding(ts: Column, embeddings: Sequence[tuple[str, str]]) -> Column:
    """array<float> of [sin, cos] for cyclic and [fraction] for linear (period, kind) pairs, in their order."""
    parts: list[Column] = []
    for period, kind in embeddings:
        f = t0_fraction(ts, period)
        if kind == "cyclic":
            parts += [F.sin(f * (2 * math.pi)), F.cos(f * (2 * math.pi))]
        elif kind == "linear":
            parts.append(f)
        else:
            raise ValueError(f"unknown embedding {kind!r}")
    return F.array(*(p.cast("float") for p in parts))


def missing(v: Column) -> Column:
    return v.isNull() | F.isnan(v.cast("double"))


def clip(v: Column, low: Column, high: Column) -> Column:
    """v within [low, high]; a missing value stays as it is, a null bound is none."""
    return F.when(missing(v), v).otherwise(F.least(F.greatest(v, F.coalesce(low, v)), F.coalesce(high, v)))


def normalise(df: DataFrame, constants: DataFrame, keys: Sequence[str] = ("channel",), value: str = "value") -> DataFrame:
    """value clipped and z-scored by constants (keys, mean, std, lo, hi): one row per channel, a list from a configuration."""
    joined = df.join(F.broadcast(constants.select(*keys, "mean", "std", "lo", "hi")), list(keys))
    return joined.withColumn(value, (clip(F.col(value), F.col("lo"), F.col("hi")) - F.col("mean")) / F.col("std")).drop("mean", "std", "lo", "hi")


def capacity_ratio(v: Column, capacity: Column) -> Column:
    """v / capacity; by a capacity of 0: infinite with v's sign, NaN for 0 / 0."""
    zero = F.when(missing(v) | (v == 0), F.lit(float("nan"))).when(v > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(capacity == 0, zero).otherwise(v / F.when(capacity != 0, capacity))


def fill_missing(v: Column, by: float = 0.0) -> Column:
    """NaN and null as `by`; infinities stay."""
    return F.when(missing(v), F.lit(by)).otherwise(v)
