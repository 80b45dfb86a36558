"""Time axes and closed periods: islands, trimming, intersection, filling, masks.

Periods are rows (keys..., start_dt, end_dt), TIMESTAMP_NTZ, both ends included.
All functions take the key columns that separate independent axes (sources,
locations); windows are partitioned by them.  The session time zone is UTC.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 1440


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp without time zone."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(ts.cast("timestamp"))


def minutes(n: int | Column) -> Column:
    return F.make_dt_interval(mins=n if isinstance(n, Column) else F.lit(n))


def ceil_time(ts: Column, freq: int) -> Column:
    """ts, or the next multiple of freq minutes since the epoch."""
    unit = freq * 60_000_000
    up = F.ceil(micros(ts) / F.lit(unit).cast("decimal(20,0)")).cast("long") * F.lit(unit)
    return F.timestamp_micros(up).cast("timestamp_ntz")


def _axis(keys: Sequence[str], order: str) -> Window:
    """One partition per key; a single axis of distinct times is small."""
    return Window.partitionBy(*keys).orderBy(order) if keys else Window.partitionBy(F.lit(0)).orderBy(order)


def contiguous_periods(times: DataFrame, max_gap: int, min_length: int, keys: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """Islands of times with no gap over max_gap minutes and strictly more than min_length times: (keys, start_dt, end_dt).

    A min_length of 1 or less is refused: one time is no period.
    """
    if min_length <= 1:
        raise ValueError("min_length must be greater than 1")
    axis = _axis(keys, ts)
    distinct = times.select(*keys, ts).where(F.col(ts).isNotNull()).distinct()
    gap = F.coalesce((micros(ts) - micros(F.lag(ts).over(axis)) > max_gap * 60_000_000).cast("int"), F.lit(0))
    marked = distinct.withColumn("_gap", gap).withColumn("_island", F.sum("_gap").over(axis))
    found = marked.groupBy(*keys, "_island").agg(F.min(ts).alias("start_dt"), F.max(ts).alias("end_dt"), F.count("*").alias("_n"))
    return found.where(F.col("_n") > min_length).select(*keys, "start_dt", "end_dt")


def trim_periods(periods: DataFrame, interval_start: int, interval_end: int) -> DataFrame:
    """Reference times whose window [t0 + interval_start, t0 + interval_end] lies in the period; empty ones go."""
    out = periods.withColumn("start_dt", F.col("start_dt") - minutes(interval_start)).withColumn("end_dt", F.col("end_dt") - minutes(interval_end))
    return out.where("start_dt <= end_dt")


def contiguous_t0_periods(times: DataFrame, interval_start: int, interval_end: int, resolution: int, keys: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """Periods of reference times whose whole window is there at the given resolution."""
    length = (interval_end - interval_start) // resolution + 1
    return trim_periods(contiguous_periods(times, resolution, length, keys, ts), interval_start, interval_end)


def forecast_t0_periods(inits: DataFrame, interval_start: int, max_staleness: int, max_dropout: int = 0, first_step: int = 0, keys: Sequence[str] = (), init: str = "init_time") -> DataFrame:
    """Periods of reference times for which some run is young enough.

    A run serves from `buffer` minutes after it starts until it is max_staleness old; periods end where the last run's
    staleness ends before the next run is available.  Periods that end before they start are kept, as fill_periods drops them.
    """
    axis = _axis(keys, init)
    buffer = max(first_step - interval_start, max_dropout)
    distinct = inits.select(*keys, init).where(F.col(init).isNotNull()).distinct()
    late = F.lag(init).over(axis) + minutes(max_staleness) < F.col(init) + minutes(max(max_dropout, first_step))
    marked = distinct.withColumn("_late", F.coalesce(late.cast("int"), F.lit(0))).withColumn("_island", F.sum("_late").over(axis))
    found = marked.groupBy(*keys, "_island").agg(F.min(init).alias("_first"), F.max(init).alias("_last"))
    return found.select(*keys, (F.col("_first") + minutes(buffer)).alias("start_dt"), (F.col("_last") + minutes(max_staleness)).alias("end_dt"))


def _day(ts: str) -> Column:
    return F.floor(micros(ts) / F.lit(DAY * 60_000_000).cast("decimal(20,0)")).cast("long")


def intersect_periods(a: DataFrame, b: DataFrame, keys: Sequence[str] = (), carry: Sequence[str] = ()) -> DataFrame:
    """The overlaps of the periods of a with those of b, per key; touching periods overlap in one time.

    carry: columns of a that its overlaps keep.

    Both sides go to the days that they cover, so the overlap join is an equi-join and neither side is broadcast.
    """
    days = F.explode(F.sequence(_day("start_dt"), _day("end_dt"))).alias("_day")
    left = a.where("start_dt <= end_dt").select(*keys, *carry, F.col("start_dt").alias("_as"), F.col("end_dt").alias("_ae"), days)
    right = b.where("start_dt <= end_dt").select(*keys, F.col("start_dt").alias("_bs"), F.col("end_dt").alias("_be"), days)
    both = left.join(right, [*keys, "_day"]).where((F.col("_as") <= F.col("_be")) & (F.col("_ae") >= F.col("_bs")))
    # A pair meets on every day that both cover; it counts on the first.
    both = both.where(F.col("_day") == F.greatest(_day("_as"), _day("_bs")))
    return both.select(*keys, *carry, F.greatest("_as", "_bs").alias("start_dt"), F.least("_ae", "_be").alias("end_dt"))


def intersect_many(periods: Sequence[DataFrame], keys: Sequence[str] = ()) -> DataFrame:
    """The overlaps of all period tables, folded from the left."""
    if not periods:
        raise ValueError("no period tables to intersect")
    return reduce(lambda a, b: intersect_periods(a, b, keys), periods)


def fill_periods(periods: DataFrame, freq: int, keys: Sequence[str] = (), name: str = "t0") -> DataFrame:
    """Every multiple of freq minutes in every period; times in overlapping periods come once for each."""
    start = ceil_time(F.col("start_dt"), freq)
    rows = periods.select(*keys, start.alias("_start"), "end_dt").where("_start <= end_dt")
    return rows.select(*keys, F.explode(F.sequence("_start", "end_dt", minutes(freq))).alias(name))


def time_mask(column: Column, ranges: Sequence[tuple[object, object]]) -> Column:
    """Whether a time is in one of the closed ranges; None leaves an end open."""
    if not ranges:
        raise ValueError("no time ranges")

    def one(low: object, high: object) -> Column:
        bounds = [column >= F.lit(low)] * (low is not None) + [column <= F.lit(high)] * (high is not None)
        return reduce(lambda x, y: x & y, bounds, column.isNotNull())

    return reduce(lambda x, y: x | y, (one(*r) for r in ranges))
