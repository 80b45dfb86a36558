"""Golden tables of the period operators."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sunloom.operators import periods, slices

DAY = datetime(2023, 1, 1)


def at(hours, day=1):
    return datetime(2023, 1, day) + timedelta(hours=hours)


def times(spark, values, name="ts"):
    return spark.createDataFrame([(v,) for v in values], f"{name} timestamp_ntz")


def table(spark, rows):
    return spark.createDataFrame(rows, "start_dt timestamp_ntz, end_dt timestamp_ntz")


def got(df):
    return sorted((r["start_dt"], r["end_dt"]) for r in df.collect())


def test_contiguous_t0_periods(spark):
    axis = [DAY + timedelta(hours=12, minutes=5 * k) for k in range(61) if k not in (5, 6, 30)]
    out = periods.contiguous_t0_periods(times(spark, axis), -60, 15, 5)
    assert got(out) == [(at(13 + 35 / 60), at(14 + 10 / 60)), (at(15 + 35 / 60), at(16.75))]


def test_single_step_windows_are_refused(spark):
    with pytest.raises(ValueError, match="min_length"):
        periods.contiguous_t0_periods(times(spark, [DAY]), 0, 0, 5)


@pytest.mark.parametrize(
    ("history", "staleness", "dropout", "expected"),
    [
        (0, 9, 0, [(1, 3, 1, 21), (2, 3, 3, 6)]),
        (2, 9, 0, [(1, 5, 1, 21), (2, 5, 3, 6)]),
        (2, 6, 0, [(1, 5, 1, 18), (2, 5, 2, 9), (2, 14, 3, 3)]),
        (2, 3, 0, [(1, 5, 1, 6), (1, 11, 1, 15), (2, 5, 2, 6), (2, 14, 3, 0)]),
        (2, 6, 3, [(1, 6, 1, 9), (1, 12, 1, 18), (2, 6, 2, 9), (2, 15, 3, 3)]),
    ],
)
def test_forecast_periods(spark, history, staleness, dropout, expected):
    runs = [at(3 + 3 * k) for k in range(15) if k not in (1, 4, 5, 6, 7, 9, 10)]
    out = periods.forecast_t0_periods(times(spark, runs, "init_time"), -60 * history, 60 * staleness, 60 * dropout)
    assert got(out) == [(at(b, a), at(d, c)) for a, b, c, d in expected]


@pytest.mark.parametrize(("a", "b", "both"), [((0, 12), (3, 6), (3, 6)), ((12, 18), (3, 15), (12, 15)), ((12, 18), (0, 12), (12, 12)), ((12, 12), (0, 18), (12, 12)), ((0, 0), (0, 0), (0, 0)), ((0, 0), (6, 6), None)])
def test_pairs(spark, a, b, both):
    x, y = (table(spark, [(at(p[0]), at(p[1]))]) for p in (a, b))
    expected = [] if both is None else [(at(both[0]), at(both[1]))]
    assert got(periods.intersect_periods(x, y)) == got(periods.intersect_periods(y, x)) == expected


def test_three_way(spark):
    a = table(spark, [(at(5), at(13 + 35 / 60)), (at(14 + 10 / 60), at(18))])
    b = table(spark, [(at(12), at(0, 2))])
    c = table(spark, [(at(0), at(12.5)), (at(13), at(23))])
    assert got(periods.intersect_many([a, b, c])) == [(at(12), at(12.5)), (at(13), at(13 + 35 / 60)), (at(14 + 10 / 60), at(18))]
    with pytest.raises(ValueError):
        periods.intersect_many([])


def test_intersection_counts_long_pairs_once(spark):
    a, b = table(spark, [(at(0), at(0, 9))]), table(spark, [(at(3), at(5, 8))])
    assert got(periods.intersect_periods(a, b)) == [(at(3), at(5, 8))]


def test_fill(spark):
    p = table(spark, [(at(4 + 1 / 6), at(6)), (at(9), at(9)), (at(9.25), at(9 + 1 / 3)), (at(12), at(14.75))])
    out = sorted(r[0] for r in periods.fill_periods(p, 30).collect())
    assert out == [at(h) for h in (4.5, 5, 5.5, 6, 9, 12, 12.5, 13, 13.5, 14, 14.5)]


def test_mask(spark):
    df = times(spark, [at(h) for h in (5, 6, 6.5, 7, 11, 12, 12.5, 13)])
    pick = lambda ranges: sorted(r[0] for r in df.where(periods.time_mask(F.col("ts"), ranges)).collect())
    assert pick([(at(6), at(7)), (at(12), at(13))]) == [at(h) for h in (6, 6.5, 7, 12, 12.5, 13)]
    assert pick([(None, at(7))]) == [at(h) for h in (5, 6, 6.5, 7)]


def test_time_slice_and_dropout(spark):
    data = spark.createDataFrame([(DAY + timedelta(minutes=30 * k), float(k)) for k in range(48)], "ts timestamp_ntz, value double")
    cut = slices.time_slice(data, times(spark, [at(0.5)], "t0"), -60, 60, 30)
    assert sorted(r["ts"] for r in cut.collect()) == [at(h) for h in (0, 0.5, 1, 1.5)]  # what isn't there gives no row
    gone = slices.history_dropout(cut, [-30], 1.0)
    assert {r["ts"]: r["value"] for r in gone.collect()} == {at(0): 0.0, at(0.5): None, at(1): 2.0, at(1.5): 3.0}
    assert slices.history_dropout(cut, [], 0.0).where("value IS NULL").count() == 0


@pytest.mark.parametrize("drop", [0, 1, 2, 5])
def test_forecast_slice(spark, drop):
    runs = [DAY + timedelta(hours=3 * k) for k in range(9)]
    forecast = spark.createDataFrame([(r, 60 * s, "t") for r in runs for s in range(17)], "init_time timestamp_ntz, step int, channel string")
    t0 = at(12)
    out = slices.forecast_slice(forecast, times(spark, [t0], "t0"), -360, 180, 60, 960, deltas=[-60 * drop] if drop else [], fraction=1.0 if drop else 0.0)
    rows = {r["target"]: r["init_time"] for r in out.collect()}
    floor3 = lambda t: t.replace(hour=t.hour // 3 * 3)
    assert rows == {t0 + timedelta(hours=h): floor3(min(t0 + timedelta(hours=h), t0 - timedelta(hours=drop))) for h in range(-6, 4)}


def test_lead_difference(spark):
    df = spark.createDataFrame([(s, c, float(s * s)) for s in range(4) for c in "ab"], "step int, channel string, value double")
    out = {(r["channel"], r["step"]): r["value"] for r in slices.lead_difference(df, ["a"], [], "step").collect()}
    assert out == {("a", 0): 1.0, ("a", 1): 3.0, ("a", 2): 5.0, ("b", 0): 0.0, ("b", 1): 1.0, ("b", 2): 4.0}


def test_stream_equals_batch(spark, tmp_path):
    from sunloom.streaming import islands

    data = spark.createDataFrame([(k, DAY + timedelta(hours=h)) for k in "xy" for h in (0, 1, 2, 5, 6, 7, 8, 20)], "k string, ts timestamp_ntz")
    batch = periods.contiguous_periods(data, 60, 2, ["k"])
    assert sorted(batch.collect()) == sorted(islands.contiguous_periods(data, 60, 2, ["k"]).collect())
    data.union(spark.createDataFrame([("z", datetime(2023, 2, 1))], data.schema)).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(data.schema).parquet(str(tmp_path / "in"))
    job = islands.contiguous_periods(stream, 60, 2, ["k"]).writeStream.format("memory").queryName("found").outputMode("append").trigger(availableNow=True).start()
    job.awaitTermination(120)
    assert sorted(batch.collect()) == sorted(spark.table("found").collect())
