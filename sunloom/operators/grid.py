"""Grid axes, nearest pixels, crops, extents, and collation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def axis_index(axis: DataFrame, keys: Sequence[str] = (), coord: str = "coord") -> DataFrame:
    """axis with idx: places from 0 in increasing order of the coordinate (a decreasing axis is flipped by this)."""
    order = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(coord)
    return axis.select(*keys, coord).distinct().withColumn("idx", F.row_number().over(order) - 1)


def nearest_index(points: DataFrame, axis: DataFrame, at: str, name: str, keys: Sequence[str] = (), strict: bool = True) -> DataFrame:
    """points with the index of the nearest axis coordinate, ties to the lower one; strict: only points within the axis.

    An axis has as many coordinates as its grid has pixels along one side, whatever the number of points, so each axis
    is one array that every point looks its nearest coordinate up in.
    """
    cells = axis.select(*keys, F.col("coord").cast("double").alias("_at"), F.col("idx").alias("_idx"))
    packed = cells.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_at", "_idx"))).alias("_axis"))
    joined = points.join(F.broadcast(packed), list(keys)) if keys else points.crossJoin(F.broadcast(packed))
    best = F.array_min(F.transform("_axis", lambda c: F.struct(F.abs(c["_at"] - F.col(at)).alias("d"), c["_idx"].alias("i"))))
    inside = (F.col(at) > F.element_at("_axis", 1)["_at"]) & (F.col(at) < F.element_at("_axis", -1)["_at"])
    return (joined.where(inside) if strict else joined).withColumn(name, best["i"]).drop("_axis")


def crop(points: DataFrame, cells: DataFrame, width: int, height: int, n_x: int, n_y: int, x: str = "x_idx", y: str = "y_idx", centre_x: str = "cx", centre_y: str = "cy") -> DataFrame:
    """The width * height cells around each point's pixel: [c - w/2, c + w/2).  Even sizes; a window over the edge is an error."""
    if width % 2 or height % 2 or width <= 0 or height <= 0:
        raise ValueError("window sizes must be even and positive")
    left, low = F.col(centre_x) - width // 2, F.col(centre_y) - height // 2
    ok = (left >= 0) & (low >= 0) & (left + width <= n_x) & (low + height <= n_y)
    checked = points.withColumn(x, F.when(ok, left).otherwise(F.raise_error(F.lit("window not available in the grid")).cast("int")))
    spread = checked.withColumn(x, F.explode(F.sequence(F.col(x), F.col(x) + width - 1))).withColumn(y, F.explode(F.sequence(low, low + height - 1)))
    return spread.join(cells, [x, y])


def extent(points: DataFrame, width: int, height: int, centre_x: str = "cx", centre_y: str = "cy") -> tuple[int, int, int, int]:
    """(x from, x to, y from, y to), both included, of the windows around all points; one pixel more when a size is 2."""
    r = points.agg(F.min(centre_x), F.max(centre_x), F.min(centre_y), F.max(centre_y)).first()
    more_x, more_y = int(width == 2), int(height == 2)
    return max(r[0] - width // 2, 0), r[1] + width // 2 - 1 + more_x, max(r[2] - height // 2, 0), r[3] + height // 2 - 1 + more_y


def cross_index(locations: DataFrame, t0s: DataFrame, location: str = "location_id", t0: str = "t0") -> DataFrame:
    """Every (location, t0) with its sample number, locations first: loc_idx * n_t0 + t_idx.

    The cross product is the result itself.  Numbers come from an order over each side alone.
    """
    n = t0s.select(t0).distinct().count()
    one = locations.select(location).distinct().withColumn("_l", F.row_number().over(Window.orderBy(location)) - 1)
    two = t0s.select(t0).distinct().withColumn("_t", F.row_number().over(Window.orderBy(t0)) - 1)
    return one.crossJoin(two).select(location, t0, (F.col("_l").cast("long") * n + F.col("_t")).alias("sample_idx"))


def number_samples(index: DataFrame, location: str = "location_id", t0: str = "t0") -> DataFrame:
    """index with sample_idx: places from 0 in the order of location, then time.

    Counts per location are summed up over one row per location; the order inside a location is its own partition's.
    """
    before = F.sum("_n").over(Window.orderBy(location).rowsBetween(Window.unboundedPreceding, -1))
    starts = index.groupBy(location).agg(F.count("*").alias("_n")).select(location, F.coalesce(before, F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy(location).orderBy(t0))
    return index.withColumn("_own", own).join(starts, location).withColumn("sample_idx", F.col("_start") + F.col("_own") - 1).drop("_own", "_start")


def collate(samples: DataFrame, by: str, position: str, stacked: Sequence[str], constant: Sequence[str] = ()) -> DataFrame:
    """One row per `by`: the stacked columns as arrays in the order of position, the constant ones as they are."""
    rows = F.array_sort(F.collect_list(F.struct(position, *stacked)))
    out = samples.groupBy(by).agg(rows.alias("_rows"), *(F.first(c).alias(c) for c in constant))
    return out.select(by, *(F.col("_rows")[c].alias(c) for c in (position, *stacked)), *constant)


def _beside(df: DataFrame, one: DataFrame) -> DataFrame:
    """df with the columns of a one-row table (a global aggregate), so that nothing has to run while the plan is made."""
    return df.crossJoin(F.broadcast(one))


def drop_zero_location(df: DataFrame, location: str = "location_id") -> DataFrame:
    """Without location 0, if there are others."""
    others = df.agg((F.min(location) != F.max(location)).alias("_others"))
    return _beside(df, others).where((F.col(location) >= 1) | ~F.coalesce(F.col("_others"), F.lit(False))).drop("_others")


def check_increasing(df: DataFrame, order: str, coord: str, keys: Sequence[str] = ()) -> DataFrame:
    """df, if the coordinate strictly increases or strictly decreases along the order, per key; else an error when it is read."""
    axis = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(order)
    step = F.signum((F.col(coord) - F.lag(coord).over(axis)).cast("double"))
    turns = df.select(*keys, order, coord).distinct().select(*keys, step.alias("_step")).where(F.col("_step").isNotNull())
    checked = turns.groupBy(*keys).agg(F.min("_step").alias("_low"), F.max("_step").alias("_high")).where(~((F.col("_low") == F.col("_high")) & (F.col("_low") != 0)))
    fine = checked.agg(F.count("*").alias("_n")).select(F.when(F.col("_n") > 0, F.raise_error(F.lit(f"{coord} is not monotonic"))).otherwise(F.lit(True)).cast("boolean").alias("_fine"))
    return _beside(df, fine).where("_fine").drop("_fine")


def first_steps(df: DataFrame, n: int, keys: Sequence[str], step: str = "step") -> DataFrame:
    """The rows of the first n distinct steps of each key."""
    rank = F.dense_rank().over(Window.partitionBy(*keys).orderBy(step))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def select_channels(df: DataFrame, channels: Sequence[str], channel: str = "channel") -> DataFrame:
    """The rows of the channels, with their place in the list; a channel that isn't there is an error when they are read."""
    wanted = F.array(*(F.lit(c) for c in channels))
    rows = df.where(F.col(channel).isin(*channels))
    lacking = F.array_except(wanted, F.collect_set(channel))
    found = rows.agg(lacking.alias("_lacking")).select(F.when(F.size("_lacking") > 0, F.raise_error(F.concat(F.lit("channels not found: "), F.concat_ws(", ", "_lacking")))).otherwise(F.lit(True)).cast("boolean").alias("_found"))
    place = F.array_position(wanted, F.col(channel)) - 1
    return _beside(rows.withColumn("channel_pos", place.cast("int")), found).where("_found").drop("_found")


def unpivot_channels(df: DataFrame, ids: Sequence[str], channels: Sequence[str], channel: str = "channel", value: str = "value") -> DataFrame:
    """Wide variables as rows (ids, channel, value)."""
    return df.unpivot(list(ids), list(channels), channel, value)
