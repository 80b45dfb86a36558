"""The sample engine: valid reference times, samples and batches of a configuration."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sunloom.config import NWP, Configuration, Gridded
from sunloom.functions import features, geo
from sunloom.operators import grid, periods, slices


def staleness(max_step: int, interval_end: int, end_buffer: int, wanted: int | None) -> int:
    """The oldest a run may be, in minutes; a wanted one may not be over what its steps allow."""
    most = max_step - interval_end - end_buffer
    if wanted is not None and wanted > most:
        raise ValueError(f"max_staleness_minutes {wanted} is over the possible {most}")
    return most if wanted is None else wanted


class SampleEngine:
    """Samples of the configured sources.

    tables: generation (location_id, time_utc, generation_mw, capacity_mwp, longitude, latitude), sat (time_utc,
    channel, channel_pos, x, y, value), nwp:<name> (init_time_utc, step, channel, channel_pos, x, y, value).  systems
    and areas give the coordinate system of each gridded table (lon_lat unless told) and a geostationary one's area.
    """

    def __init__(self, config: Configuration, tables: Mapping[str, DataFrame], time_periods: Sequence[tuple] | None = None, systems: Mapping[str, str] | None = None, areas: Mapping[str, str] | None = None, seed: int = 0, index: DataFrame | None = None):
        if config.generation is None:
            raise ValueError("a configuration without generation has no samples")
        self.config, self.tables, self.time_periods, self.seed = config, dict(tables), time_periods, seed
        self.systems, self.areas, self._saved = dict(systems or {}), dict(areas or {}), index

    # -- index ---------------------------------------------------------------------------------------------------

    @property
    def locations(self) -> DataFrame:
        return self.tables["generation"].groupBy("location_id").agg(F.first("longitude").alias("longitude"), F.first("latitude").alias("latitude"))

    def complete(self) -> bool:
        """Whether every location has a value at every time that any of them has."""
        own = self.tables["generation"].groupBy("location_id", "time_utc").agg(F.max(features.missing(F.col("generation_mw")).cast("int")).alias("gap"))
        r = own.agg(F.count("*").alias("n"), F.countDistinct("location_id").alias("l"), F.countDistinct("time_utc").alias("t"), F.max("gap").alias("gap")).first()
        return not r["gap"] and r["n"] == r["l"] * r["t"]

    def weather_periods(self) -> list[DataFrame]:
        """Periods of reference times that satellite and forecasts allow."""
        out, c = [], self.config
        if c.satellite:
            w = c.satellite.window
            out.append(periods.contiguous_t0_periods(self.tables["sat"], w.interval_start_minutes, w.interval_end_minutes, w.time_resolution_minutes, ts="time_utc"))
        for name, nwp in c.nwp.items():
            table, w = self.tables[f"nwp:{name}"], nwp.window
            low, high = table.agg(F.min("step"), F.max("step")).first()
            buffer = w.time_resolution_minutes if nwp.accum_channels else 0
            old = staleness(high, w.interval_end_minutes, buffer, nwp.max_staleness_minutes)
            drop = max((-d for d in nwp.dropout.dropout_timedeltas_minutes), default=0)
            out.append(periods.forecast_t0_periods(table, w.interval_start_minutes, old, drop, low, init="init_time_utc").where("start_dt <= end_dt"))
        return out

    def index(self) -> DataFrame:
        """(location_id, t0) of every sample.  A location without a valid time has none."""
        if self._saved is not None:
            return self._saved.select("location_id", "t0")
        w, gen = self.config.generation.window, self.tables["generation"]
        span = (w.interval_start_minutes, w.interval_end_minutes, w.time_resolution_minutes)
        weather = self.weather_periods()
        there = gen.where(~features.missing(F.col("generation_mw")))
        own = periods.contiguous_t0_periods(there, *span, keys=["location_id"], ts="time_utc")
        valid = reduce(lambda a, b: periods.intersect_periods(a, b, carry=["location_id"]), weather, own)
        t0s = periods.fill_periods(valid, w.time_resolution_minutes, ["location_id"])
        return t0s.where(periods.time_mask(F.col("t0"), self.time_periods)) if self.time_periods else t0s

    def numbered(self) -> DataFrame:
        """(location_id, t0, sample_idx): the index with places from 0, by location, then time."""
        return self._saved if self._saved is not None and "sample_idx" in self._saved.columns else grid.number_samples(self.index())

    def save_index(self, path: str) -> SampleEngine:
        """The same engine with its numbered index written to path, so that nothing of it is computed again."""
        self.numbered().write.parquet(path)
        return self.with_index(path)

    def with_index(self, path: str) -> SampleEngine:
        """The same engine with the index that save_index wrote."""
        spark = self.tables["generation"].sparkSession
        return type(self)(self.config, self.tables, self.time_periods, self.systems, self.areas, self.seed, spark.read.parquet(path))

    def __len__(self) -> int:
        return self.index().count()

    def __getitem__(self, idx: int) -> DataFrame:
        """The sample at a place of the index; a place outside it is an error."""
        at = self.numbered().where(F.col("sample_idx") == idx).select("location_id", "t0")
        if at.isEmpty():
            raise ValueError(f"no sample {idx}")
        return self.samples(at)

    # -- one modality at a time ----------------------------------------------------------------------------------

    def _points(self, name: str) -> DataFrame:
        system = self.systems.get(name, "lon_lat")
        x, y = geo.convert(F.col("longitude"), F.col("latitude"), "lon_lat", system, self.areas.get(name))
        return self.locations.select("location_id", x.alias("px"), y.alias("py"))

    def projected_locations(self) -> DataFrame:
        """locations with the coordinates (x_<system>, y_<system>) of every system that a source has."""
        out = self.locations
        for name, system in sorted(self.systems.items()):
            if system != "lon_lat" and f"x_{system}" not in out.columns:
                x, y = geo.convert(F.col("longitude"), F.col("latitude"), "lon_lat", system, self.areas.get(name))
                out = out.withColumn(f"x_{system}", x).withColumn(f"y_{system}", y)
        return out

    def _cells(self, name: str, spec: Gridded, wanted: DataFrame) -> DataFrame:
        """The cells in each location's window at the times (rows) of wanted: adds location_id and the place in the window (wx, wy)."""
        table, width, height = self.tables[name], spec.crop.image_size_pixels_width, spec.crop.image_size_pixels_height
        # An axis has as many rows as the grid has pixels along a side; it is read once and used four times.
        x_axis = grid.axis_index(table.select(F.col("x").alias("coord"))).persist()
        y_axis = grid.axis_index(table.select(F.col("y").alias("coord"))).persist()
        n_x, n_y = x_axis.count(), y_axis.count()
        at = grid.nearest_index(grid.nearest_index(self._points(name), x_axis, "px", "cx"), y_axis, "py", "cy").persist()  # a row per location
        axes = x_axis.select(F.col("coord").alias("x"), F.col("idx").alias("x_idx")), y_axis.select(F.col("coord").alias("y"), F.col("idx").alias("y_idx"))
        cells = table.join(wanted.distinct(), wanted.columns, "left_semi").join(F.broadcast(axes[0]), "x").join(F.broadcast(axes[1]), "y")
        low_x, high_x, low_y, high_y = grid.extent(at, width, height)
        cells = cells.where(F.col("x_idx").between(low_x, high_x) & F.col("y_idx").between(low_y, high_y))
        near = grid.crop(at.select("location_id", "cx", "cy"), cells, width, height, n_x, n_y)
        return near.withColumn("wx", F.col("x_idx") - F.col("cx") + width // 2).withColumn("wy", F.col("y_idx") - F.col("cy") + height // 2)

    def _constants(self, spec: Gridded) -> DataFrame:
        spark = self.tables["generation"].sparkSession
        rows = [(c, *((k := spec.constants[spec.constant_key(c)]).mean, k.std, k.clip_min, k.clip_max)) for c in spec.channels]
        return spark.createDataFrame(rows, "channel string, mean double, std double, lo double, hi double")

    @staticmethod
    def _nested(flat: Column, shape: Sequence[int]) -> Column:
        """A flat array as nested arrays of the shape."""
        inner = shape[-1]

        def level(dims: Sequence[int], base: Column) -> Column:
            if len(dims) == 1:
                return F.slice(flat, base * inner + 1, inner)
            rest = dims[1:]
            return F.transform(F.sequence(F.lit(0), F.lit(dims[0] - 1)), lambda k: level(rest, base * dims[0] + k) if len(rest) > 1 else F.slice(flat, (base * dims[0] + k) * inner + 1, inner))

        return level(shape, F.lit(0))

    @staticmethod
    def shape(spec: Gridded) -> tuple[int, int, int, int]:
        """(steps, channels, width, height) of a gridded source's array."""
        return spec.window.steps, len(spec.channels), spec.crop.image_size_pixels_width, spec.crop.image_size_pixels_height

    def _image(self, sliced: DataFrame, spec: Gridded, time: str, prefix: str, more: Sequence[str] = ()) -> DataFrame:
        """Each sample's values as a dense array: every value has its own place, a missing pixel is filled, a repeated one an error."""
        steps, channels, width, height = shape = self.shape(spec)
        w = spec.window
        first = periods.ceil_time(F.col("t0") + periods.minutes(w.interval_start_minutes), w.time_resolution_minutes)
        step = ((periods.micros(time) - periods.micros(first)) / F.lit(w.time_resolution_minutes * 60_000_000)).cast("int")
        place = (((step * channels + F.col("channel_pos")) * width + F.col("wx")) * height + F.col("wy")).cast("int")
        value = features.fill_missing(F.col("value"), spec.dropout.dropout_value).cast("float")
        frames = F.array_sort(F.collect_set(F.struct(time, *more)))
        out = sliced.groupBy("location_id", "t0").agg(F.array_sort(F.collect_list(F.struct(place.alias("place"), value.alias("value")))).alias("_r"), frames.alias("_f"))
        every, fill = F.sequence(F.lit(0), F.lit(steps * channels * width * height - 1)), F.lit(spec.dropout.dropout_value).cast("float")
        # (Each value that a lambda uses many times is bound once, as the only element of an array.)
        once = lambda value, f: F.get(F.transform(F.array(value), f), 0)
        filled = once(F.map_from_entries("_r"), lambda known: F.transform(every, lambda k: F.coalesce(F.try_element_at(known, k), fill)))
        flat = F.when(F.col("_r.place") == every, F.col("_r.value")).otherwise(filled)
        return out.select("location_id", "t0", once(flat, lambda x: self._nested(x, shape)).alias(prefix), "_f")

    def generation_windows(self, index: DataFrame, concurrent: bool = False) -> DataFrame:
        g = self.config.generation
        w = g.window
        by = [] if concurrent else ["location_id"]
        out = slices.time_slice(self.tables["generation"], index, w.interval_start_minutes, w.interval_end_minutes, w.time_resolution_minutes, ["location_id"], "time_utc")
        out = slices.history_dropout(out, g.dropout.dropout_timedeltas_minutes, g.dropout.dropout_fraction, "generation_mw", "time_utc", by=[F.lit("generation"), *by], seed=self.seed)
        ratio = features.fill_missing(features.capacity_ratio(F.col("generation_mw").cast("double"), F.col("capacity_mwp").cast("double")), g.dropout.dropout_value).cast("float")
        row = F.struct("time_utc", ratio.alias("v"), F.col("capacity_mwp").cast("double").alias("c"), *(e.alias(k) for k, e in features.calendar(F.col("time_utc")).items()))
        packed = out.groupBy("location_id", "t0").agg(F.array_sort(F.collect_list(row)).alias("_r"), F.first("longitude").alias("longitude"), F.first("latitude").alias("latitude"))
        epoch = F.transform("_r", lambda r: periods.micros(r["time_utc"]) * F.lit(1000.0))
        return packed.select("location_id", "t0", F.col("_r.v").alias("generation"), epoch.alias("time_utc"), F.element_at("_r", 1)["c"].alias("capacity_mwp"), F.lit(-w.interval_start_minutes // w.time_resolution_minutes).alias("t0_idx"), "longitude", "latitude", *(F.col(f"_r.{k}").alias(k) for k in ("date_sin", "date_cos", "time_sin", "time_cos")))

    def satellite_windows(self, index: DataFrame, concurrent: bool = False) -> DataFrame:
        s = self.config.satellite
        w = s.window
        by = [] if concurrent else ["location_id"]
        times = slices.targets(index.select("t0").distinct(), w.interval_start_minutes, w.interval_end_minutes, w.time_resolution_minutes).select(F.col("target").alias("time_utc"))
        out = slices.time_slice(self._cells("sat", s, times), index, w.interval_start_minutes, w.interval_end_minutes, w.time_resolution_minutes, ["location_id"], "time_utc")
        out = slices.history_dropout(out, s.dropout.dropout_timedeltas_minutes, s.dropout.dropout_fraction, "value", "time_utc", by=[F.lit("sat"), *by], seed=self.seed)
        out = features.normalise(out, self._constants(s))
        packed = self._image(out, s, "time_utc", "satellite_actual")
        return packed.withColumn("satellite_time_utc", F.transform("_f", lambda r: periods.micros(r["time_utc"]) * F.lit(1000.0))).drop("_f")

    def forecast_windows(self, name: str, nwp: NWP, index: DataFrame, concurrent: bool = False) -> DataFrame:
        w, table, d = nwp.window, self.tables[f"nwp:{name}"], nwp.dropout
        more = w.time_resolution_minutes if nwp.accum_channels else 0
        max_step = table.agg(F.max("step")).first()[0]
        by = [F.lit(name)] + ([] if concurrent else ["location_id"])
        # One row per run, then per location and reference time, and only then the cells.
        runs = slices.forecast_runs(table.select("init_time_utc").distinct(), index, w.interval_start_minutes, w.interval_end_minutes + more, w.time_resolution_minutes, max_step, (), d.dropout_timedeltas_minutes, d.dropout_fraction, self.seed, by, "init_time_utc")
        runs = runs.withColumn("step", F.col("step").cast(table.schema["step"].dataType))
        out = runs.join(self._cells(f"nwp:{name}", nwp, runs.select("init_time_utc", "step")), ["location_id", "init_time_utc", "step"])
        if nwp.accum_channels:
            out = slices.lead_difference(out, nwp.accum_channels, ["location_id", "t0", "wx", "wy"], "target")
        out = features.normalise(out, self._constants(nwp))
        packed = self._image(out, nwp, "target", "nwp", ["init_time_utc", "step"])
        struct = F.struct(
            "nwp", F.array(*(F.lit(c) for c in nwp.channels)).alias("nwp_channel_names"), F.transform("_f", lambda r: periods.micros(r["init_time_utc"]) * F.lit(1000.0)).alias("nwp_init_time_utc"),
            F.transform("_f", lambda r: F.floor(r["step"] / 60).cast("int")).alias("nwp_step"), F.col("_f.step").alias("nwp_step_minutes"), F.transform("_f", lambda r: periods.micros(r["target"]) * F.lit(1000.0)).alias("nwp_target_time_utc"),
        )
        return packed.select("location_id", "t0", struct.alias(f"nwp_{name}"))

    # -- samples -------------------------------------------------------------------------------------------------

    def samples(self, index: DataFrame | None = None, concurrent: bool = False) -> DataFrame:
        """One row per (location_id, t0) of the index with all features as arrays; concurrent: one dropout draw per t0."""
        # Every modality joins the index: two columns a sample, kept so that it is made once.
        index = (self.index() if index is None else index.select("location_id", "t0")).persist()
        parts = [self.generation_windows(index, concurrent)]
        if self.config.satellite:
            parts.append(self.satellite_windows(index, concurrent))
        parts += [self.forecast_windows(name, nwp, index, concurrent) for name, nwp in self.config.nwp.items()]
        out = reduce(lambda a, b: a.join(b, ["location_id", "t0"]), parts)
        if self.config.t0_embedding:
            out = out.withColumn("t0_embedding", features.t0_embedding(F.col("t0"), self.config.t0_embedding.embeddings))
        if w := self.config.solar_position:
            times = [F.col("t0") + periods.minutes(w.interval_start_minutes + k * w.time_resolution_minutes) for k in range(w.steps)]
            sun = [geo.solar_normalised(t, F.col("longitude"), F.col("latitude")) for t in times]
            out = out.withColumn("solar_azimuth", F.array(*(a for a, _ in sun))).withColumn("solar_elevation", F.array(*(e for _, e in sun)))
        return out.withColumn("t0_seconds", periods.micros("t0") / F.lit(1e6))

    def sample(self, t0, location_id: int) -> DataFrame:
        """The one sample of a valid (t0, location_id); another pair is an error."""
        index = self.index().where((F.col("t0") == F.lit(t0).cast("timestamp_ntz")) & (F.col("location_id") == location_id))
        if index.isEmpty():
            raise ValueError(f"no valid sample at {t0} for location {location_id}")
        return self.samples(index)

    get_sample = sample

    def batches(self, index: DataFrame | None = None) -> DataFrame:
        """One row per t0: the samples of all its locations as an array ordered by location_id.  Needs complete generation."""
        if not self.complete():
            raise ValueError("batches over all locations need complete generation")
        made = self.samples(index, concurrent=True)
        return made.groupBy("t0").agg(F.array_sort(F.collect_list(F.struct("location_id", *(c for c in made.columns if c not in ("location_id", "t0"))))).alias("samples"))

    def checked(self, samples: DataFrame) -> DataFrame:
        """samples, whose arrays must have the configured lengths; another length is an error when they are read."""
        c, expected = self.config, {"generation": F.size("generation")}
        steps = {"generation": c.generation.window.steps}
        if c.satellite:
            expected["satellite_actual"], steps["satellite_actual"] = F.array(F.size("satellite_actual"), *self._sizes("satellite_actual")), list(self.shape(c.satellite))
        for name, nwp in c.nwp.items():
            expected[f"nwp_{name}"], steps[f"nwp_{name}"] = F.array(F.size(f"nwp_{name}.nwp"), *self._sizes(f"nwp_{name}.nwp")), list(self.shape(nwp))
        if c.solar_position:
            expected["solar_azimuth"], steps["solar_azimuth"] = F.size("solar_azimuth"), c.solar_position.steps
        for name, found in expected.items():
            want = F.array(*(F.lit(x) for x in steps[name])) if isinstance(steps[name], list) else F.lit(steps[name])
            samples = samples.where(F.when(found == want, True).otherwise(F.raise_error(F.concat(F.lit(f"{name} has the shape "), found.cast("string"), F.lit(f", not {steps[name]}"))).cast("boolean")))
        return samples

    @staticmethod
    def _sizes(name: str) -> list[Column]:
        """The sizes of an array's inner levels, of its first elements."""
        one = F.col(name)
        out = []
        for _ in range(3):
            one = F.get(one, 0)
            out.append(F.size(one))
        return out


class ConcurrentEngine(SampleEngine):
    """The batches of all locations at a time: one item per reference time at which generation is complete."""

    def times(self) -> DataFrame:
        """(t0, sample_idx): the valid reference times in order, from 0."""
        one = self.index().select("t0").distinct()
        return grid.number_samples(one.withColumn("location_id", F.lit(0))).select("t0", "sample_idx")

    def __len__(self) -> int:
        return self.index().select("t0").distinct().count()

    def __getitem__(self, idx: int) -> DataFrame:
        return self._batch(self.times().where(F.col("sample_idx") == idx), f"no batch {idx}")

    def get_sample(self, t0) -> DataFrame:
        """The batch of a valid reference time; another time is an error."""
        return self._batch(self.times().where(F.col("t0") == F.lit(t0).cast("timestamp_ntz")), f"no valid batch at {t0}")

    def _batch(self, times: DataFrame, message: str) -> DataFrame:
        if times.isEmpty():
            raise ValueError(message)
        return self.batches(self.index().join(times.select("t0"), "t0", "left_semi"))


def to_tensors(batch: dict, device: str | None = None):
    """A nested dictionary of arrays as torch tensors (on a device), where torch is installed; other values stay."""
    import numpy as np
    import torch

    def one(x):
        if isinstance(x, dict):
            return {k: one(v) for k, v in x.items()}
        x = np.asarray(x)
        return torch.as_tensor(x, device=device) if x.dtype.kind in "bifu" else x

    return one(batch)
