"""Readers: Parquet in a provider's column names -> canonical long tables, validated.

generation(location_id, time_utc, generation_mw, capacity_mwp), satellite(time_utc,
channel, x, y, value), nwp(init_time_utc, step, channel, x, y, value); step in minutes.
Paths may be one, several or globs on any file system that Spark reads.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBER = (T.FloatType, T.DoubleType, T.IntegerType, T.LongType, T.ShortType, T.DecimalType)
GENERATION = {"location_id": (T.IntegerType, T.LongType, T.ShortType), "time_utc": (T.TimestampNTZType, T.TimestampType), "generation_mw": (T.FloatType, T.DoubleType), "capacity_mwp": NUMBER}
SATELLITE = {"time_utc": (T.TimestampNTZType, T.TimestampType), "channel": (T.StringType,), "x": NUMBER, "y": NUMBER, "value": NUMBER}
NWP_TABLE = {"init_time_utc": (T.TimestampNTZType, T.TimestampType), "step": (T.IntegerType, T.LongType, T.DayTimeIntervalType), "channel": (T.StringType,), "x": NUMBER, "y": NUMBER, "value": NUMBER}


def validate(df: DataFrame, expected: dict[str, tuple[type, ...]], name: str) -> DataFrame:
    """df, if it has the expected columns and types."""
    for column, kinds in expected.items():
        if column not in df.columns:
            raise KeyError(f"{name}: column {column} is missing")
        if not isinstance(df.schema[column].dataType, kinds):
            raise TypeError(f"{name}: {column} is {df.schema[column].dataType.simpleString()}")
    return df


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Old names as new ones, where they are there."""
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns and v not in df.columns})


def read_parts(spark: SparkSession, paths: str | Sequence[str], public: bool = False, same: Sequence[str] = ()) -> DataFrame:
    """One table of all paths: Parquet (concatenated by column name), or Zarr stores where all paths end in `.zarr` (same: see zarr.open_stores)."""
    if all(p.rstrip("/").endswith(".zarr") for p in ([paths] if isinstance(paths, str) else paths)):
        from . import zarr

        if public:
            raise ValueError("public stores are read as Parquet only")
        return zarr.open_stores(spark, paths, same=same)
    # For this read alone: other sources of the session keep their own credentials.
    options = {"fs.s3a.aws.credentials.provider": "org.apache.hadoop.fs.s3a.AnonymousAWSCredentialsProvider"} if public else {}
    return spark.read.options(**options).parquet(*([paths] if isinstance(paths, str) else paths))


def _placed(df: DataFrame, axis: str) -> DataFrame:
    """(place from 0, coordinate) of an axis: as many rows as the grid has pixels along one side."""
    return df.select(axis).distinct().withColumn("_place", F.row_number().over(Window.orderBy(axis)) - 1)


def concat(parts: Sequence[DataFrame], axes: Sequence[str] = ()) -> DataFrame:
    """All rows of the parts.  A part whose axis differs from the first one's is reported and gets the first one's coordinates.

    Coordinates are matched by their place on the axis; another number of them is an error.
    """
    if not parts:
        raise ValueError("nothing to concatenate")
    out = parts[0]
    first = {a: _placed(parts[0], a) for a in axes}
    for k, p in enumerate(parts[1:], 1):
        for a in axes:
            own = _placed(p, a)
            met = first[a].withColumnRenamed(a, "_first").join(own, "_place", "full_outer")
            n, differ = met.agg(F.count(F.when(F.col("_first").isNull() | F.col(a).isNull(), 1)), F.count(F.when(F.col("_first") != F.col(a), 1))).first()
            if n:
                raise ValueError(f"part {k} has another number of coordinates on {a} than the first")
            if differ:
                warnings.warn(f"part {k} has other coordinates on {a} than the first, which are used for it", stacklevel=2)
                p = p.join(F.broadcast(met.select(a, "_first")), a).withColumn(a, F.col("_first")).drop("_first")
        out = out.unionByName(p)
    return out


def check_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df, if no combination of the keys occurs twice (one grouped pass over the keys)."""
    if not df.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError(f"{list(keys)} are not unique")
    return df


def single_value(df: DataFrame, dimensions: Sequence[str], wanted: str | None = None) -> DataFrame:
    """The dimensions and the one other column, as value."""
    rest = [c for c in df.columns if c not in dimensions]
    if wanted:
        if wanted not in rest:
            raise KeyError(f"variable {wanted} is missing")
        rest = [wanted]
    if len(rest) != 1:
        raise ValueError(f"expected one variable, found {rest}")
    return df.select(*dimensions, F.col(rest[0]).alias("value"))


def open_generation(spark: SparkSession, path: str | Sequence[str], public: bool = False) -> DataFrame:
    return validate(read_parts(spark, path, public), GENERATION, "generation")


def open_satellite(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    names = {"time": "time_utc", "variable": "channel", "x_geostationary": "x", "y_geostationary": "y"}
    df = renamed(read_parts(spark, path, same=["x_geostationary", "y_geostationary"]), names)
    if missing := [c for c in ("time_utc", "channel", "x", "y") if c not in df.columns]:
        raise KeyError(f"satellite: columns {missing} are missing")
    return validate(single_value(df, ["time_utc", "channel", "x", "y"]), SATELLITE, "satellite")


def satellite_area(spark: SparkSession, path: str | Sequence[str], variable: str = "data") -> str | None:
    """The description of the geostationary view that Zarr satellite stores carry, of the first store; None without one."""
    from . import zarr

    area = zarr.Array(spark, f"{zarr.expand(spark, path)[0].rstrip('/')}/{variable}").attrs.get("area")
    return area if area is None or isinstance(area, str) else str(area)


_DIMS = ["init_time_utc", "step", "channel", "x", "y"]


def _grid(names: dict[str, str]) -> Callable[[DataFrame], DataFrame]:
    return lambda df: single_value(renamed(df, {"init_time": "init_time_utc", "variable": "channel"} | names), _DIMS)


def _gfs(df: DataFrame) -> DataFrame:
    """Every variable is a channel."""
    df = renamed(df, {"init_time": "init_time_utc", "longitude": "x", "latitude": "y"})
    ids = [c for c in _DIMS if c != "channel"]
    return df.unpivot(ids, [c for c in df.columns if c not in ids], "channel", "value")


def _icon(df: DataFrame) -> DataFrame:
    """The first 78 steps of the one variable that is wanted."""
    from sunloom.operators.grid import first_steps

    df = renamed(df, {"init_time": "init_time_utc", "variable": "channel", "longitude": "x", "latitude": "y"})
    return first_steps(single_value(df, _DIMS, "icon_eu_data"), 78, ["init_time_utc"])


_LON_LAT = {"longitude": "x", "latitude": "y"}
PROVIDERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "ukv": _grid({"x_osgb": "x", "y_osgb": "y"}), "ecmwf": _grid(_LON_LAT), "mo_global": _grid(_LON_LAT), "gencast": _grid(_LON_LAT), "fgn": _grid(_LON_LAT),
    "gfs": _gfs, "icon_eu": _icon, "icon-eu": _icon, "cloudcasting": _grid({"x_geostationary": "x", "y_geostationary": "y"}),
}


def open_nwp(spark: SparkSession, path: str | Sequence[str], provider: str, public: bool = False) -> DataFrame:
    """A forecast table in canonical columns, by the provider's name (case is ignored)."""
    adapt = PROVIDERS.get(provider.lower())
    if adapt is None:
        raise ValueError(f"unknown provider {provider}")
    if public and provider.lower() != "gfs":
        raise ValueError("only gfs has a public store")
    return validate(adapt(read_parts(spark, path, public)), NWP_TABLE, provider)


def open_all(spark: SparkSession, config) -> dict[str, DataFrame]:
    """The configured sources by name (generation, sat, nwp:<name>), their channels selected, registered as views."""
    from sunloom.operators.grid import drop_zero_location, select_channels

    out: dict[str, DataFrame] = {}
    if config.generation:
        out["generation"] = drop_zero_location(open_generation(spark, config.generation.path, config.generation.public))
    if config.satellite:
        out["sat"] = select_channels(open_satellite(spark, config.satellite.path), config.satellite.channels)
    for name, nwp in config.nwp.items():
        out[f"nwp:{name}"] = select_channels(open_nwp(spark, nwp.path, nwp.provider, nwp.public), nwp.channels)
    for name, df in out.items():
        df.createOrReplaceTempView(name.replace(":", "_"))
    return out
