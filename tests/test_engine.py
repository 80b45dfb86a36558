"""Features, projections, configuration, sources, grids and whole samples."""

import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sunloom import config as C
from sunloom.functions import features, geo
from sunloom.operators import grid
from sunloom.plans.sampler import SampleEngine, staleness
from sunloom.sources import readers

DAY = datetime(2023, 1, 1)


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_year_embedding(spark):
    days = [datetime(2020, 1, 1), datetime(2020, 1, 2, 5), datetime(2020, 6, 10), datetime(2021, 1, 1), datetime(2021, 1, 2)]
    f = [one(spark, features.t0_fraction(F.lit(d).cast("timestamp_ntz"), "2y"))[0] * 2 for d in days]
    assert f == pytest.approx([0, 1 / 366, 161 / 366, 1, 1 + 1 / 365])


def test_embedding_shapes(spark):
    v = one(spark, features.t0_embedding(F.lit(datetime(2023, 1, 1, 6)).cast("timestamp_ntz"), [("24h", "cyclic"), ("24h", "linear")]))[0]
    assert v == pytest.approx([1, 0, 0.25], abs=1e-6)


def test_clip_and_fill(spark):
    nan = float("nan")
    row = one(spark, features.clip(F.lit(5.0), F.lit(0.0), F.lit(1.0)), features.clip(F.lit(nan), F.lit(0.0), F.lit(1.0)), features.fill_missing(F.lit(nan), -1.0), features.capacity_ratio(F.lit(1.0), F.lit(0.0)))
    assert row[0] == 1.0 and math.isnan(row[1]) and row[2] == -1.0 and math.isinf(row[3])


def test_national_grid_worked_example(spark):
    lat, lon = 52 + 39 / 60 + 27.2531 / 3600, 1 + 43 / 60 + 4.5177 / 3600
    x, y = geo.lon_lat_to_osgb(F.lit(lon), F.lit(lat), datum_shift=False)
    row = one(spark, x, y)
    assert row[0] == pytest.approx(651409.903, abs=0.01) and row[1] == pytest.approx(313177.270, abs=0.01)
    back = one(spark, *geo.osgb_to_lon_lat(*geo.lon_lat_to_osgb(F.lit(-2.5), F.lit(54.0))))
    assert tuple(back) == pytest.approx((-2.5, 54.0), abs=1e-6)


def test_geostationary(spark):
    assert tuple(one(spark, *geo.lon_lat_to_geostationary(F.lit(9.5), F.lit(0.0), geo.Area()))) == pytest.approx((0, 0), abs=1e-6)
    assert geo.Area.parse("projection: {proj: geos, h: 35785831.0, a: 6378169, rf: 295.48, lon_0: 9.5}").lon_0 == 9.5
    with pytest.raises(ValueError):
        geo.convert(F.lit(0.0), F.lit(0.0), "lon_lat", "geostationary", None)
    with pytest.raises(NotImplementedError):
        geo.convert(F.lit(0.0), F.lit(0.0), "geostationary", "osgb")
    assert geo.find_coord_system(["x_osgb", "y_osgb", "step"]) == "osgb"


@pytest.mark.parametrize("lat", [0, 5, 10, 23.5])
def test_solstice(spark, lat):
    noon = F.lit(datetime(2024, 6, 20, 12)).cast("timestamp_ntz")
    assert abs(one(spark, geo.solar_position(noon, F.lit(0.0), F.lit(float(lat)))[1])[0] - (66.5 + lat)) < 1


def test_crop_and_nearest(spark):
    axis = grid.axis_index(spark.range(200).select((99 - F.col("id")).cast("double").alias("coord")))
    p = spark.createDataFrame([(1, 10.0, 10.0), (2, -90.0, -80.0)], "location_id int, x double, y double")
    at = grid.nearest_index(grid.nearest_index(p, axis, "x", "cx"), axis, "y", "cy")
    assert {r["location_id"]: (r["cx"], r["cy"]) for r in at.collect()} == {1: (110, 110), 2: (10, 20)}
    cells = spark.range(200 * 200).select((F.col("id") / 200).cast("int").alias("x_idx"), (F.col("id") % 200).cast("int").alias("y_idx"))
    r = grid.crop(at.where("location_id = 2"), cells, 10, 10, 200, 200).agg(F.min("x_idx"), F.max("x_idx"), F.min("y_idx"), F.max("y_idx"), F.count("*")).first()
    assert tuple(r) == (5, 14, 15, 24, 100)
    with pytest.raises(Exception, match="not available"):
        grid.crop(at.where("location_id = 2"), cells, 30, 30, 200, 200).collect()
    assert grid.nearest_index(p.withColumn("x", F.lit(99.0)), axis, "x", "cx").count() == 0


@pytest.mark.parametrize(
    "make",
    [
        lambda: C.TimeWindow(-30, 30, 7), lambda: C.TimeWindow(30, -30, 30), lambda: C.TimeWindow(0, 30, 0), lambda: C.Dropout((5,), 0.5), lambda: C.Dropout((-5,), 0.0),
        lambda: C.Dropout((), 0.5), lambda: C.Dropout((-5, -10), (0.7, 0.7)), lambda: C.Normalisation(0, 0), lambda: C.Normalisation(0, 1, 2, 1), lambda: C.SpatialWindow(-1, 2),
        lambda: C.T0Embedding((("25h", "cyclic"),)), lambda: C.T0Embedding((("1y", "round"),)), lambda: C.from_dict({"unknown": 1}),
        lambda: C.NWP("p", ("t",), C.TimeWindow(0, 60, 60), C.SpatialWindow(2, 2), {}, provider="ukv"),
        lambda: C.NWP("p", ("t",), C.TimeWindow(0, 60, 60), C.SpatialWindow(2, 2), {"t": C.Normalisation(0, 1)}, provider="nobody"),
        lambda: C.NWP("p", ("t",), C.TimeWindow(0, 60, 60), C.SpatialWindow(2, 2), {"t": C.Normalisation(0, 1)}, accum_channels=("t",)),
    ],
)
def test_bad_configurations(make):
    with pytest.raises(ValueError):
        make()


def configuration():
    w = C.TimeWindow
    return C.Configuration(
        generation=C.Generation("g", w(-60, 120, 30)),
        satellite=C.Satellite("s", ("IR",), w(-30, 0, 5), C.SpatialWindow(2, 2), {"IR": C.Normalisation(0.5, 2.0)}),
        nwp={"ukv": C.NWP("n", ("t",), w(-60, 120, 60), C.SpatialWindow(2, 2), {"t": C.Normalisation(100.0, 10.0, 0.0, 1000.0)}, C.Dropout((-180,), 1.0))},
        solar_position=w(-15, 15, 5), t0_embedding=C.T0Embedding((("1h", "cyclic"), ("24h", "cyclic"), ("1y", "cyclic"))),
    )


def test_yaml_round_trip(tmp_path):
    path = str(tmp_path / "c.yaml")
    C.save(configuration(), path)
    assert C.load(path) == configuration()
    with pytest.raises(FileExistsError):
        C.save(configuration(), path)


@pytest.fixture(scope="module")
def tables(spark):
    gen = [(loc, DAY + timedelta(minutes=30 * k), float(k + loc), 10.0, -3.0 + loc, 52.0) for loc in (1, 2) for k in range(49)]
    sat = [(DAY + timedelta(minutes=5 * k), "IR", 0, float(x), float(y), float(k)) for k in range(288) for x in range(-6, 4) for y in range(50, 56)]
    nwp = [(DAY + timedelta(hours=3 * r), 60 * s, "t", 0, float(x), float(y), 100.0 * r + s) for r in range(12) for s in range(11) for x in range(-6, 4) for y in range(50, 56)]
    return {
        "generation": spark.createDataFrame(gen, "location_id int, time_utc timestamp_ntz, generation_mw double, capacity_mwp double, longitude double, latitude double").cache(),
        "sat": spark.createDataFrame(sat, "time_utc timestamp_ntz, channel string, channel_pos int, x double, y double, value double").cache(),
        "nwp:ukv": spark.createDataFrame(nwp, "init_time_utc timestamp_ntz, step int, channel string, channel_pos int, x double, y double, value double").cache(),
    }


def test_index_and_samples(spark, tables):
    engine = SampleEngine(configuration(), tables)
    index = engine.index().cache()
    assert index.count() == 2 * 39  # 03:00 to 22:00 by 30 minutes
    t0 = datetime(2023, 1, 1, 12)
    s = engine.sample(t0, 2).first()
    assert s["generation"] == pytest.approx([(k + 2) / 10 for k in range(22, 29)])
    assert s["t0_idx"] == 2 and len(s["date_sin"]) == 7 and len(s["t0_embedding"]) == 6 and len(s["solar_azimuth"]) == 7
    image = s["satellite_actual"]
    assert (len(image), len(image[0]), len(image[0][0]), len(image[0][0][0])) == (7, 1, 2, 2)
    assert [f[0][0][0] for f in image] == pytest.approx([(k - 0.5) / 2 for k in range(138, 145)])
    # Runs of 3 hours ago at the latest: 09:00 (number 3) for 11:00 is out of reach, so 09:00 serves from 09:00 on.
    assert s["nwp_ukv"]["nwp_step"] == [2, 3, 4, 5]
    assert [f[0][1][1] for f in s["nwp_ukv"]["nwp"]] == pytest.approx([(300 + k - 100) / 10 for k in (2, 3, 4, 5)])
    with pytest.raises(ValueError):
        engine.sample(datetime(2023, 1, 1, 0), 1)
    batch = engine.batches(index.where(F.col("t0") == F.lit(t0).cast("timestamp_ntz"))).collect()
    assert len(batch) == 1 and [x["location_id"] for x in batch[0]["samples"]] == [1, 2]


def test_incomplete_generation(spark, tables):
    gen = tables["generation"].withColumn("generation_mw", F.when((F.col("location_id") == 1) & (F.hour("time_utc") < 12), F.lit(float("nan"))).otherwise(F.col("generation_mw")))
    engine = SampleEngine(configuration(), {**tables, "generation": gen}, time_periods=[(datetime(2023, 1, 1, 12), None)])
    assert not engine.complete()
    found = {r["location_id"]: (r["lo"], r["n"]) for r in engine.index().groupBy("location_id").agg(F.min("t0").alias("lo"), F.count("*").alias("n")).collect()}
    assert found == {1: (datetime(2023, 1, 1, 13), 18), 2: (datetime(2023, 1, 1, 12), 21)}
    with pytest.raises(ValueError):
        engine.batches()


def test_staleness():
    assert staleness(600, 120, 0, None) == 480
    with pytest.raises(ValueError):
        staleness(600, 120, 0, 500)


def test_sources(spark, tmp_path):
    wide = spark.createDataFrame([(DAY, 60, 1.0, 50.0, 3.0, 4.0)], "init_time timestamp_ntz, step int, longitude double, latitude double, t double, u double")
    wide.write.parquet(str(tmp_path / "gfs"))
    out = readers.open_nwp(spark, str(tmp_path / "gfs"), "GFS")
    assert {(r["channel"], r["value"]) for r in out.collect()} == {("t", 3.0), ("u", 4.0)}
    with pytest.raises(ValueError):
        readers.open_nwp(spark, str(tmp_path / "gfs"), "nobody")
    icon = spark.createDataFrame([(DAY, 60 * s, "t", 1.0, 50.0, 1.0) for s in range(90)], "init_time timestamp_ntz, step int, variable string, longitude double, latitude double, icon_eu_data double")
    icon.write.parquet(str(tmp_path / "icon"))
    assert readers.open_nwp(spark, str(tmp_path / "icon"), "icon-eu").count() == 78
    with pytest.raises(KeyError):
        readers.open_satellite(spark, str(tmp_path / "gfs"))
    with pytest.raises(Exception, match="channels not found: missing"):
        grid.select_channels(out, ["t", "missing"]).collect()
    with pytest.raises(ValueError):
        readers.check_unique(out.union(out), ["channel"])


def test_location_store():
    place = geo.Location(3, {"lon_lat": (-1.0, 52.0)})
    place.add_coord_system(4.0, 5.0, "osgb")
    place.add_coord_system(4.0, 5.0, "osgb")
    assert place.in_coord_system("osgb") == (4.0, 5.0)
    for bad in (lambda: place.add_coord_system(4.0, 6.0, "osgb"), lambda: place.in_coord_system("geostationary"), lambda: place.in_coord_system("mars"), lambda: geo.Location(1, {"mars": (0, 0)})):
        with pytest.raises(ValueError):
            bad()


def test_missing_pixels_are_filled_in_place(spark, tables):
    sat = tables["sat"].where(~((F.col("x") == -1.0) & (F.col("y") == 52.0) & (F.col("value") == 140.0)))
    whole = SampleEngine(configuration(), tables).sample(datetime(2023, 1, 1, 12), 2).first()["satellite_actual"]
    lacking = SampleEngine(configuration(), {**tables, "sat": sat}).sample(datetime(2023, 1, 1, 12), 2).first()["satellite_actual"]
    differ = [(t, c, x, y) for t in range(7) for c in range(1) for x in range(2) for y in range(2) if whole[t][c][x][y] != lacking[t][c][x][y]]
    assert len(differ) == 1 and lacking[differ[0][0]][0][differ[0][2]][differ[0][3]] == 0.0
    twice = sat.union(sat.where((F.col("value") == 141.0)))
    with pytest.raises(Exception, match="(?i)duplicate"):
        SampleEngine(configuration(), {**tables, "sat": twice}).sample(datetime(2023, 1, 1, 12), 2).collect()


def test_complete_looks_at_times(spark, tables):
    gen = tables["generation"]
    other = gen.where("NOT (location_id = 1 AND time_utc = '2023-01-01 00:00:00') AND NOT (location_id = 2 AND time_utc = '2023-01-01 00:30:00')")
    assert SampleEngine(configuration(), tables).complete()
    assert not SampleEngine(configuration(), {**tables, "generation": other}).complete()


def test_items_by_number(spark, tables, tmp_path):
    from sunloom.plans.sampler import ConcurrentEngine

    engine = SampleEngine(configuration(), tables).save_index(str(tmp_path / "index"))
    assert len(engine) == 78
    first, last = engine[0].first(), engine[77].first()
    assert (first["location_id"], first["t0"]) == (1, datetime(2023, 1, 1, 3)) and (last["location_id"], last["t0"]) == (2, datetime(2023, 1, 1, 22))
    assert engine.checked(engine[40]).first()["location_id"] == 2
    with pytest.raises(ValueError):
        engine[78]
    batches = ConcurrentEngine(configuration(), tables).with_index(str(tmp_path / "index"))
    assert len(batches) == 39
    assert batches[1].first()["t0"] == datetime(2023, 1, 1, 3, 30) and len(batches.get_sample(datetime(2023, 1, 1, 12)).first()["samples"]) == 2
    for bad in (lambda: batches[39], lambda: batches.get_sample(datetime(2023, 1, 1, 0))):
        with pytest.raises(ValueError):
            bad()
    short = engine.samples(engine.index().limit(1)).withColumn("generation", F.slice("generation", 1, 3))
    with pytest.raises(Exception, match="generation has the shape"):
        engine.checked(short).collect()


def test_monotonic_and_remote_configuration(spark, tmp_path):
    rows = spark.createDataFrame([(k, float(x)) for k, x in enumerate((5, 4, 2, 1))], "idx int, coord double")
    assert grid.check_increasing(rows, "idx", "coord").count() == 4
    with pytest.raises(Exception, match="not monotonic"):
        grid.check_increasing(rows.union(spark.createDataFrame([(9, 3.0)], rows.schema)), "idx", "coord").collect()
    path = str(tmp_path / "c.yaml")
    C.save(configuration(), path)
    assert C.load(f"file://{path}", spark) == configuration()


def test_legacy_tables(spark, tmp_path):
    from sunloom.sources import legacy

    values = spark.createDataFrame([(1, DAY, 1000.0, 2000.0), (2, DAY, 500.0, 1000.0), (1, DAY + timedelta(hours=1), 7.0, 2000.0), (2, DAY + timedelta(hours=1), None, 1000.0)], "location_id int, time_utc timestamp_ntz, generation_kw double, capacity_kwp double")
    names = spark.createDataFrame([(1, "a", -1.0), (1, "b", -2.0)], "location_id int, name string, longitude double")
    out = legacy.reformat_generation(values, names)
    assert sorted((r["location_id"], r["generation_mw"], r["capacity_mwp"], r["name"]) for r in out.collect()) == [(1, 1.0, 2.0, "a"), (2, 0.5, 1.0, None)]
    legacy.write_csv(out, str(tmp_path / "csv"), ["location_id", "capacity_mwp"])
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "csv"), header=True).collect()] == [("1", "2.0"), ("2", "1.0")]
