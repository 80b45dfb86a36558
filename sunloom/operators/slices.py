"""Windows around reference times: slices, as-of selection of forecasts, dropout, differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .periods import DAY, ceil_time, micros, minutes


def targets(t0s: DataFrame, interval_start: int, interval_end: int, resolution: int, t0: str = "t0") -> DataFrame:
    """t0s with the column target: ceil(t0 + start), ... ceil(t0 + end) by resolution."""
    first = ceil_time(F.col(t0) + minutes(interval_start), resolution)
    steps = (interval_end - interval_start) // resolution
    return t0s.withColumn("_first", first).withColumn("target", F.explode(F.array(*(F.col("_first") + minutes(k * resolution) for k in range(steps + 1))))).drop("_first")


def time_slice(data: DataFrame, t0s: DataFrame, interval_start: int, interval_end: int, resolution: int, keys: Sequence[str] = (), ts: str = "ts", t0: str = "t0") -> DataFrame:
    """The rows of data in each reference time's window; times that aren't there give no row.

    The fixed offsets are exploded, so the window join is an equi-join on (keys, time).
    """
    return targets(t0s, interval_start, interval_end, resolution, t0).withColumnRenamed("target", ts).join(data, [*keys, ts])


def draw(seed: int, *columns: Column | str) -> Column:
    """A uniform number in [0, 1) that depends on the columns' values only, so it is the same however rows are dealt.

    52 bits of the md5 of `seed|value|value...`, which any SQL engine can repeat.
    """
    text = F.concat_ws("|", F.lit(str(seed)), *((F.col(c) if isinstance(c, str) else c).cast("string") for c in columns))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def cutoff(u: Column, deltas: Sequence[int], fraction: float | Sequence[float]) -> Column:
    """The dropout minutes (0 or less) that the draw u chooses; null for none.

    A single fraction is split evenly over the deltas, a list gives each its own; what is left is no dropout.
    """
    shares = list(fraction) if isinstance(fraction, (list, tuple)) else [fraction / len(deltas)] * len(deltas) if deltas else []
    if len(shares) != len(deltas) or any(d > 0 for d in deltas) or sum(shares) > 1 + 1e-9:
        raise ValueError("dropout needs deltas <= 0 and fractions for each that sum to 1 at most")
    out, total = F.lit(None).cast("int"), 0.0
    for delta, share in reversed(list(zip(deltas, _sums(shares), strict=True))):
        total = share
        out = F.when(u < F.lit(total), F.lit(delta)).otherwise(out)
    return out


def _sums(x: Sequence[float]) -> list[float]:
    out = []
    for v in x:
        out.append((out[-1] if out else 0.0) + v)
    return [1.0 if abs(v - 1) < 1e-9 else v for v in out]


def history_dropout(sliced: DataFrame, deltas: Sequence[int], fraction: float | Sequence[float], value: str = "value", ts: str = "ts", t0: str = "t0", by: Sequence[str] = (), seed: int = 0, blank: float | None = None) -> DataFrame:
    """value blanked for times in (t0 + cutoff, t0]; earlier history and the future stay.  One draw per (by, t0)."""
    if not deltas or fraction == 0:
        return sliced
    cut = cutoff(draw(seed, *by, F.col(t0)), deltas, fraction)
    gone = cut.isNotNull() & (F.col(ts) > F.col(t0) + minutes(F.coalesce(cut, F.lit(0)))) & (F.col(ts) <= F.col(t0))
    return sliced.withColumn(value, F.when(~F.coalesce(gone, F.lit(False)), F.col(value)).otherwise(F.lit(blank)))


def asof_runs(inits: DataFrame, wanted: DataFrame, max_step: int, keys: Sequence[str] = (), init: str = "init_time", bound: str = "bound") -> DataFrame:
    """wanted with the latest init <= bound, at most max_step minutes before it; rows without one go.

    A run is the latest from its init until the next one.  These spans go to the days that they cover, so the range
    join is an equi-join on (keys, day).
    """
    axis = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(init)
    runs = inits.select(*keys, init).distinct().withColumn("_next", F.lead(init).over(axis))
    end = F.least(F.coalesce("_next", F.col(init) + minutes(max_step)), F.col(init) + minutes(max_step))
    day = lambda c: F.floor(micros(c) / F.lit(DAY * 60_000_000).cast("decimal(20,0)")).cast("long")
    runs = runs.withColumn("_end", end).withColumn("_day", F.explode(F.sequence(day(F.col(init)), day(F.col("_end")))))
    met = wanted.withColumn("_day", day(F.col(bound))).join(runs, [*keys, "_day"])
    met = met.where((F.col(init) <= F.col(bound)) & (F.col(bound) <= F.col("_end")) & (F.col("_next").isNull() | (F.col(bound) < F.col("_next"))))
    return met.drop("_day", "_next", "_end")


def forecast_runs(inits: DataFrame, t0s: DataFrame, interval_start: int, interval_end: int, resolution: int, max_step: int, keys: Sequence[str] = (), deltas: Sequence[int] = (), fraction: float = 0.0, seed: int = 0, by: Sequence[Column | str] = (), init: str = "init_time", step: str = "step", t0: str = "t0") -> DataFrame:
    """(t0s' columns, target, init, step in minutes): the run that serves each target, as forecast_slice chooses it; inits has (keys, init)."""
    if any(d >= 0 for d in deltas):
        raise ValueError("forecast dropout needs deltas below 0")
    wanted = targets(t0s, interval_start, interval_end, resolution, t0)
    cut = F.coalesce(cutoff(draw(seed, *by, F.col(t0)), deltas, fraction), F.lit(0)) if deltas and fraction else F.lit(0)
    first = ceil_time(F.col(t0) + minutes(interval_start), resolution)
    wanted = wanted.withColumn("bound", F.least(F.col("target"), F.col(t0) + minutes(cut)))
    found = asof_runs(inits.select(*keys, init), wanted, max_step, keys, init).where(F.col(init) >= first - minutes(max_step)).drop("bound")
    return found.withColumn(step, ((micros("target") - micros(init)) / F.lit(60_000_000)).cast("long"))


def forecast_slice(forecast: DataFrame, t0s: DataFrame, interval_start: int, interval_end: int, resolution: int, max_step: int, keys: Sequence[str] = (), deltas: Sequence[int] = (), fraction: float = 0.0, seed: int = 0, by: Sequence[str] = (), init: str = "init_time", step: str = "step", t0: str = "t0") -> DataFrame:
    """The forecast rows for each reference time and target: the latest run that was available at t0 less the dropout.

    forecast: (keys, init, step in minutes, ...).  Adds target.  With probability `fraction` one of the deltas (< 0) is
    chosen evenly and moves the time of availability back.  Runs start no earlier than the first target less max_step.
    """
    found = forecast_runs(forecast, t0s, interval_start, interval_end, resolution, max_step, keys, deltas, fraction, seed, by, init, step, t0)
    return found.withColumn(step, F.col(step).cast(forecast.schema[step].dataType)).join(forecast, [*keys, init, step])


def lead_difference(sliced: DataFrame, channels: Sequence[str], keys: Sequence[str], order: str, channel: str = "channel", value: str = "value") -> DataFrame:
    """Accumulated channels as differences to the next step; the last step of every series goes, for all channels."""
    axis = Window.partitionBy(*keys, channel).orderBy(order)
    marked = sliced.withColumn("_more", F.lead(F.lit(1)).over(axis)).withColumn("_next", F.lead(value).over(axis))
    diff = F.when(F.col(channel).isin(*channels), F.col("_next") - F.col(value)).otherwise(F.col(value)) if channels else F.col(value)
    return marked.where("_more = 1").withColumn(value, diff).drop("_more", "_next")
