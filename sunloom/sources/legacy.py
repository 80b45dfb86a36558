"""Reformatting of older generation tables: metadata, units, incomplete times, CSV."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sunloom.functions import features


def with_metadata(df: DataFrame, metadata: DataFrame, key: str = "location_id") -> DataFrame:
    """df with the metadata of its key, nulls where there are none; a key described twice counts once (smallest row)."""
    others = [c for c in metadata.columns if c != key]
    once = metadata.groupBy(key).agg(F.min(F.struct(*others)).alias("_m")).select(key, "_m.*")
    return df.join(once, key, "left")


def kilo_to_mega(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Columns in kilowatts as others in megawatts: old name -> new name."""
    return df.select("*", *(((F.col(k).cast("double")) / 1000).alias(v) for k, v in columns.items())).drop(*columns)


def drop_incomplete_times(df: DataFrame, value: str = "generation_mw", ts: str = "time_utc") -> DataFrame:
    """df without the times at which any row lacks its value."""
    bad = df.where(features.missing(F.col(value))).select(ts).distinct()
    return df.join(bad, ts, "left_anti")


def write_csv(df: DataFrame, path: str, columns: Sequence[str], key: str = "location_id") -> None:
    """The columns in their order, sorted by the key, with a header; an existing path is an error."""
    df.select(*columns).orderBy(key).write.csv(path, header=True, mode="error")


def reformat_generation(values: DataFrame, metadata: DataFrame, key: str = "location_id") -> DataFrame:
    """(key, time_utc, generation_kw, capacity_kwp) and metadata as the canonical table, without incomplete times."""
    out = kilo_to_mega(values, {"generation_kw": "generation_mw", "capacity_kwp": "capacity_mwp"})
    return drop_incomplete_times(with_metadata(out, metadata, key))
