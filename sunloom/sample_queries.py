"""Registered queries of whole samples: index, every modality, batches and features, with their SQL twins.

Four locations whose generation are the hourly sums of `events`, a satellite that has a frame for most of these hours
and lacks some pixels, and a forecast model with a run for most three-hour spans.  Arrays leave as digests: comma-joined
whole numbers.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sunloom import config as C
from sunloom.catalogue import DATE, POINTS, TIME, hourly, islands_sql, points, query, seconds, table
from sunloom.functions import features, geo
from sunloom.operators import grid, periods, slices
from sunloom.plans.sampler import ConcurrentEngine, SampleEngine
from sunloom.sources import legacy, readers
from sunloom.streaming import islands

#: Hours from 1970 to the first event.
FIRST_HOUR = 473352


def digits(values: Column, scale: int = 1000) -> Column:
    """A flat array of numbers as text: each times scale, rounded."""
    return F.concat_ws(",", F.transform(values, lambda x: F.round(x.cast("double") * scale).cast("long").cast("string")))


def _flat(values: Column, levels: int = 3) -> Column:
    for _ in range(levels):
        values = F.flatten(values)
    return values


# -- tables ------------------------------------------------------------------------------------------------------------


def hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ts, v, hn): every hour that has events, their sum, and the hour's number."""
    found = table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("ts")).agg(F.sum("value").alias("v"))
    return found.withColumn("hn", F.floor(periods.micros("ts") / F.lit(3_600_000_000)).cast("long") - FIRST_HOUR)


def _each(n: int, start: int = 0) -> Column:
    return F.explode(F.sequence(F.lit(start), F.lit(start + n - 1)))


def tables(spark: SparkSession, sf_dir: str, complete: bool = False) -> dict[str, DataFrame]:
    h = hours(spark, sf_dir)
    loc = F.col("location_id")
    gen = h.withColumn("location_id", _each(4, 1))
    gone = (F.col("hn") * 7 + loc * 5) % 41 == 0
    mw = F.col("v") + loc
    gen = gen.select("location_id", F.col("ts").alias("time_utc"), (mw if complete else F.when(gone, F.lit(float("nan"))).otherwise(mw)).alias("generation_mw"), (F.lit(100.0) + loc * 10).alias("capacity_mwp"), (F.lit(-3.0) + loc * 0.7).alias("longitude"), (F.lit(51.0) + loc * 0.6).alias("latitude"))
    c, i, j = F.col("c"), F.col("i"), F.col("j")
    sat = h.where("hn % 29 <> 0").withColumn("c", _each(2)).withColumn("i", _each(12)).withColumn("j", _each(10)).where((F.col("hn") + i * 5 + j * 3 + c) % 31 != 0)
    sat = sat.select(F.col("ts").alias("time_utc"), F.when(c == 0, "IR").otherwise("VIS").alias("channel"), (F.lit(-4.0) + i * 0.5).alias("x"), (F.lit(50.0) + j * 0.5).alias("y"), ((F.col("hn") * 7 + i * 3 + j * 5 + c * 11) % 97 / 10.0).alias("value"))
    run = F.floor((F.col("hn") + FIRST_HOUR) / 3).cast("long")
    runs = h.select(run.alias("n")).distinct().where("n % 13 <> 0")
    n, s = F.col("n"), F.col("s")
    nwp = runs.withColumn("s", _each(9)).withColumn("c", _each(2)).withColumn("i", _each(7)).withColumn("j", _each(7))
    value = F.when(c == 0, (n * 5 + s * 3 + i + j * 2) % 89 / 10.0).otherwise(s * (3 + (n + i + j) % 5) * 1.0)
    nwp = nwp.select(F.timestamp_micros(n * 10_800_000_000).cast("timestamp_ntz").alias("init_time_utc"), (s * 60).cast("int").alias("step"), F.when(c == 0, "t").otherwise("dswrf").alias("channel"), (F.lit(-4.5) + i * 1.0).alias("x"), (F.lit(49.5) + j * 1.0).alias("y"), value.alias("value"))
    return {"generation": gen, "sat": grid.select_channels(sat, ["VIS", "IR"]), "nwp:ukv": grid.select_channels(nwp, ["t", "dswrf"])}


def configuration(accumulated: bool = False, weather: bool = True, **more) -> C.Configuration:
    w = C.TimeWindow(-120, 180, 60)
    if not weather:
        return C.Configuration(generation=C.Generation("generation", w, C.Dropout((-60,), 0.5)), **more)
    constants = {"t": C.Normalisation(4.3, 2.9, 0.5, 8.0), "dswrf": C.Normalisation(20.3, 7.1), "diff_dswrf": C.Normalisation(4.7, 1.9)}
    return C.Configuration(
        generation=C.Generation("generation", w, C.Dropout((-60,), 0.5)),
        satellite=C.Satellite("sat", ("VIS", "IR"), C.TimeWindow(-120, 0, 60), C.SpatialWindow(2, 2), {"IR": C.Normalisation(4.7, 3.1), "VIS": C.Normalisation(5.3, 2.3, 1.0, 9.0)}),
        nwp={"ukv": C.NWP("nwp", ("t", "dswrf"), w, C.SpatialWindow(2, 2), constants, C.Dropout((-180,), 0.4), accum_channels=("dswrf",) if accumulated else ())}, **more,
    )


def engine(spark: SparkSession, sf_dir: str, accumulated: bool = False, **more) -> SampleEngine:
    return SampleEngine(configuration(accumulated, **more), tables(spark, sf_dir))


# -- their SQL ---------------------------------------------------------------------------------------------------------

HOUR = f"h AS (SELECT date_trunc('hour', ts) AS ts, sum(value) AS v, (epoch(date_trunc('hour', ts))::BIGINT // 3600 - {FIRST_HOUR}) AS hn FROM events GROUP BY 1, 3)"
GEN = "gen AS (SELECT l AS k, ts, v + l AS mw, 100.0::DOUBLE + 10 * l AS cap FROM h, range(1, 5) r(l) WHERE (hn * 7 + l * 5) % 41 <> 0)"
_GEN_PERIODS = f"{islands_sql('gi', 'gen', '1 hour', 6)}, gp AS (SELECT k, s + INTERVAL 2 hour AS s, e - INTERVAL 3 hour AS e FROM gi WHERE s + INTERVAL 2 hour <= e - INTERVAL 3 hour)"
_SAT_PERIODS = f"st AS (SELECT 0 AS k, ts FROM h WHERE hn % 29 <> 0), {islands_sql('si', 'st', '1 hour', 3)}, sp AS (SELECT s + INTERVAL 2 hour AS s, e FROM si WHERE s + INTERVAL 2 hour <= e)"
RUNS = f"n AS (SELECT make_timestamp(n * 10800000000) AS ts, n FROM (SELECT DISTINCT (hn + {FIRST_HOUR}) // 3 AS n FROM h) WHERE n % 13 <> 0)"


def index_sql(stale: int = 300) -> str:
    """CTEs up to t(k, t0): the valid samples, for runs that serve until they are so many minutes old."""
    return f"""{HOUR}, {GEN}, {_GEN_PERIODS}, {_SAT_PERIODS}, {RUNS},
    nf AS (SELECT ts, CASE WHEN lag(ts) OVER (ORDER BY ts) + INTERVAL {stale} minute < ts + INTERVAL 180 minute THEN 1 ELSE 0 END AS f FROM n), ng AS (SELECT ts, sum(f) OVER (ORDER BY ts) AS g FROM nf),
    np AS (SELECT min(ts) + INTERVAL 180 minute AS s, max(ts) + INTERVAL {stale} minute AS e FROM ng GROUP BY g),
    gs AS (SELECT k, greatest(gp.s, sp.s) AS s, least(gp.e, sp.e) AS e FROM gp JOIN sp ON gp.s <= sp.e AND gp.e >= sp.s),
    gv AS (SELECT k, greatest(gs.s, np.s) AS s, least(gs.e, np.e) AS e FROM gs JOIN np ON gs.s <= np.e AND gs.e >= np.s WHERE np.s <= np.e),
    t AS (SELECT k, unnest(generate_series(s, e, INTERVAL 1 hour)) AS t0 FROM gv)"""


def draw_sql(name: str, place: str = "|| k || '|' ") -> str:
    """The dropout draw of (seed 0, source, location, t0)."""
    return f"(('0x' || substr(md5('0|{name}|' {place} || strftime(t0, '%Y-%m-%d %H:%M:%S')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


def nearest_sql(name: str, n: int, low: float, step: float, base: float, by: float) -> str:
    return f"{name} AS (SELECT l AS k, min(struct_pack(d := abs({low}::DOUBLE + {step} * i - ({base}::DOUBLE + l * {by})), i := i)).i AS p FROM range(1, 5) a(l), range({n}) b(i) GROUP BY 1)"


SAT_GRID = ", ".join((nearest_sql("sx", 12, -4.0, 0.5, -3.0, 0.7), nearest_sql("sy", 10, 50.0, 0.5, 51.0, 0.6)))
NWP_GRID = ", ".join((nearest_sql("ux", 7, -4.5, 1.0, -3.0, 0.7), nearest_sql("uy", 7, 49.5, 1.0, 51.0, 0.6)))
#: Channel 0 of the samples is VIS, number 1 of the table.
SAT = f"""{SAT_GRID}, sat AS (SELECT ts, 1 - c AS c, i, j, (hn * 7 + i * 3 + j * 5 + c * 11) % 97 / 10.0::DOUBLE AS value FROM h, range(2) a(c), range(12) b(i), range(10) d(j) WHERE hn % 29 <> 0 AND (hn + i * 5 + j * 3 + c) % 31 <> 0),
    sv AS (SELECT t.k, t.t0, o.o, q.c, x.x, y.y, coalesce((CASE WHEN value IS NULL THEN NULL WHEN q.c = 0 THEN (least(greatest(value, 1.0), 9.0) - 5.3) / 2.3 ELSE (value - 4.7) / 3.1 END)::FLOAT, 0.0::FLOAT)::DOUBLE AS value
        FROM t CROSS JOIN range(3) o(o) CROSS JOIN range(2) q(c) CROSS JOIN range(2) x(x) CROSS JOIN range(2) y(y) JOIN sx ON sx.k = t.k JOIN sy ON sy.k = t.k
        LEFT JOIN sat ON sat.ts = t.t0 + (o.o - 2) * INTERVAL 1 hour AND sat.c = q.c AND sat.i = sx.p - 1 + x.x AND sat.j = sy.p - 1 + y.y)"""


def nwp_sql(steps: int = 6, accumulated: bool = False) -> str:
    """CTEs up to uv(k, t0, o, c, x, y, value) and ur(k, t0, o, init, step): the forecast values and the runs that they come from."""
    value = "CASE WHEN c = 0 THEN (n * 5 + s * 3 + i + j * 2) % 89 / 10.0::DOUBLE ELSE s * (3 + (n + i + j) % 5) * 1.0::DOUBLE END"
    last = "CASE WHEN c = 0 THEN (least(greatest(value, 0.5), 8.0) - 4.3) / 2.9 ELSE " + ("(next - value - 4.7) / 1.9" if accumulated else "(value - 20.3) / 7.1") + " END"
    return f"""{NWP_GRID}, ub AS (SELECT k, t0, o, t0 + (o - 2) * INTERVAL 1 hour AS target, CASE WHEN {draw_sql('ukv')} < 0.4 THEN t0 - INTERVAL 3 hour ELSE t0 END AS b FROM t CROSS JOIN range({steps + accumulated}) r(o)),
    ur AS (SELECT k, t0, o, max(n.ts) AS init, (epoch(any_value(target) - max(n.ts)) / 60)::INTEGER AS step, any_value(target) AS target FROM ub JOIN n ON n.ts <= least(target, b) AND n.ts >= least(target, b) - INTERVAL 8 hour AND n.ts >= t0 - INTERVAL 10 hour GROUP BY k, t0, o),
    uw AS (SELECT ur.k, ur.t0, ur.o, q.c, x.x, y.y, epoch(init)::BIGINT // 10800 AS n, step // 60 AS s, ux.p - 1 + x.x AS i, uy.p - 1 + y.y AS j FROM ur CROSS JOIN range(2) q(c) CROSS JOIN range(2) x(x) CROSS JOIN range(2) y(y) JOIN ux ON ux.k = ur.k JOIN uy ON uy.k = ur.k WHERE step <= 480),
    ul AS (SELECT k, t0, o, c, x, y, {value} AS value FROM uw), un AS (SELECT *, lead(value) OVER (PARTITION BY k, t0, c, x, y ORDER BY o) AS next FROM ul),
    uv AS (SELECT k, t0, o, c, x, y, ({last})::FLOAT::DOUBLE AS value FROM un WHERE o < {steps})"""


def packed_sql(source: str, columns: str = "") -> str:
    return f"SELECT k AS location_id, epoch(t0)::BIGINT AS t0_s, string_agg(round(value * 1000)::BIGINT::VARCHAR, ',' ORDER BY o, c, x, y) AS value{columns} FROM {source} GROUP BY k, t0"


# -- queries -----------------------------------------------------------------------------------------------------------


@query(f"WITH {index_sql()} SELECT k AS location_id, epoch(t0)::BIGINT AS t0_s, row_number() OVER (ORDER BY k, t0) - 1 AS sample_idx FROM t")
def samples_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The engine's numbered index of a configuration with generation, satellite and forecasts."""
    return engine(spark, sf_dir).numbered().select("location_id", seconds("t0").alias("t0_s"), "sample_idx")


GENERATION = f"""SELECT t.k, t.t0, g.ts, g.cap, coalesce(CASE WHEN {draw_sql('generation', "|| t.k || '|' ").replace('strftime(t0', 'strftime(t.t0')} < 0.5 AND g.ts > t.t0 - INTERVAL 1 hour AND g.ts <= t.t0 THEN NULL ELSE mw END / cap, 0.0)::FLOAT::DOUBLE AS value FROM t JOIN gen g ON g.k = t.k AND g.ts BETWEEN t.t0 - INTERVAL 2 hour AND t.t0 + INTERVAL 3 hour"""


@query(f"""WITH {index_sql()}, w AS ({GENERATION}) SELECT k AS location_id, epoch(t0)::BIGINT AS t0_s, string_agg(round(value * 10000)::BIGINT::VARCHAR, ',' ORDER BY ts) AS generation, string_agg(epoch(ts)::BIGINT::VARCHAR, ',' ORDER BY ts) AS times, any_value(cap) AS capacity_mwp, 2 AS t0_idx,
    string_agg(round(sin({DATE}) * 10000)::BIGINT::VARCHAR, ',' ORDER BY ts) AS date_sin, string_agg(round(cos({TIME}) * 10000)::BIGINT::VARCHAR, ',' ORDER BY ts) AS time_cos FROM w GROUP BY k, t0""")
def generation_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of generation over its capacity, half of them with the last hour of history out, and their calendar features."""
    e = engine(spark, sf_dir)
    out = e.generation_windows(e.index())
    return out.select("location_id", seconds("t0").alias("t0_s"), digits(F.col("generation"), 10000).alias("generation"), F.concat_ws(",", F.transform("time_utc", lambda x: (x / 1e9).cast("long").cast("string"))).alias("times"), "capacity_mwp", F.col("t0_idx").cast("int").alias("t0_idx"), digits(F.col("date_sin"), 10000).alias("date_sin"), digits(F.col("time_cos"), 10000).alias("time_cos"))


@query(f"WITH {index_sql()}, {SAT} {packed_sql('sv')}")
def satellite_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense windows of satellite frames around every location, normalised; missing pixels are filled."""
    e = engine(spark, sf_dir)
    return e.satellite_windows(e.index()).select("location_id", seconds("t0").alias("t0_s"), digits(_flat(F.col("satellite_actual"))).alias("value"))


def _forecast(spark: SparkSession, sf_dir: str, accumulated: bool) -> DataFrame:
    e = engine(spark, sf_dir, accumulated)
    out = e.forecast_windows("ukv", e.config.nwp["ukv"], e.index())
    steps = F.concat_ws(",", F.col("nwp_ukv.nwp_step_minutes").cast("array<string>"))
    return out.select("location_id", seconds("t0").alias("t0_s"), digits(_flat(F.col("nwp_ukv.nwp"))).alias("value"), steps.alias("steps"))


_STEPS = "SELECT k, t0, string_agg(step::VARCHAR, ',' ORDER BY o) AS steps FROM ur WHERE o < 6 GROUP BY k, t0"


@query(f"WITH {index_sql()}, {nwp_sql()}, v AS ({packed_sql('uv')}), s AS ({_STEPS}) SELECT v.*, steps FROM v JOIN s ON s.k = v.location_id AND epoch(s.t0)::BIGINT = v.t0_s")
def forecast_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of the latest available runs around every location; four in ten samples only see runs of three hours ago."""
    return _forecast(spark, sf_dir, False)


@query(f"WITH {index_sql(240)}, {nwp_sql(6, True)}, v AS ({packed_sql('uv')}), s AS ({_STEPS}) SELECT v.*, steps FROM v JOIN s ON s.k = v.location_id AND epoch(s.t0)::BIGINT = v.t0_s")
def forecast_samples_differenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with an accumulated channel as differences, for which one more step is looked up."""
    return _forecast(spark, sf_dir, True)


COMPLETE = f"""{HOUR}, gen AS (SELECT l AS k, ts, v + l AS mw, 100.0::DOUBLE + 10 * l AS cap FROM h, range(1, 5) r(l)), {_GEN_PERIODS}, t AS (SELECT k, unnest(generate_series(s, e, INTERVAL 1 hour)) AS t0 FROM gp)"""
_TOGETHER = GENERATION.replace("'0|generation|' || t.k || '|'  ||", "'0|generation|' ||")


@query(f"""WITH {COMPLETE}, w AS ({_TOGETHER}), s AS (SELECT k, t0, string_agg(round(value * 10000)::BIGINT::VARCHAR, ',' ORDER BY ts) AS g FROM w GROUP BY k, t0), z AS (SELECT t0, row_number() OVER (ORDER BY t0) - 1 AS sample_idx FROM (SELECT DISTINCT t0 FROM t))
    SELECT epoch(s.t0)::BIGINT AS t0_s, any_value(sample_idx) AS sample_idx, count(*)::BIGINT AS locations, string_agg(k::VARCHAR, ',' ORDER BY k) AS location_ids, string_agg(g, ';' ORDER BY k) AS generation FROM s JOIN z ON z.t0 = s.t0 GROUP BY s.t0""")
def concurrent_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All locations of every reference time as one numbered batch, with one outage for them together."""
    e = ConcurrentEngine(configuration(weather=False), {"generation": tables(spark, sf_dir, complete=True)["generation"]})
    out = e.batches().join(e.times(), "t0")
    each = F.transform("samples", lambda s: digits(s["generation"], 10000))
    return out.select(seconds("t0").alias("t0_s"), "sample_idx", F.size("samples").cast("long").alias("locations"), F.concat_ws(",", F.col("samples.location_id").cast("array<string>")).alias("location_ids"), F.concat_ws(";", each).alias("generation"))


def solar_sql(source: str, columns: str) -> str:
    """A query of source(ts, lon, lat, columns) for columns, ts, azimuth / 360 and elevation / 180 + 0.5."""
    turn = lambda x, n: f"(({x}) - {n} * floor(({x}) / {n}))"
    return f"""SELECT {columns}, ts, {turn('degrees(atan2(east, north))', '360.0')} / 360 AS azimuth, degrees(asin(least(greatest(up, -1.0), 1.0))) / 180 + 0.5 AS elevation FROM (
    SELECT *, sin(phi) * sin(decl) + cos(phi) * cos(decl) * cos(hr) AS up, -cos(decl) * sin(hr) AS east, sin(decl) * cos(phi) - cos(decl) * sin(phi) * cos(hr) AS north FROM (
    SELECT *, radians({turn('(day - floor(day)) * 1440.0 + eqn + 4 * lon', '1440.0')} / 4 - 180.0) AS hr, radians(lat) AS phi FROM (
    SELECT *, asin(sin(tilt) * sin(app)) AS decl, 4 * degrees(pow(tan(tilt / 2), 2) * sin(2 * l0) - 2 * ecc * sin(an) + 4 * ecc * pow(tan(tilt / 2), 2) * sin(an) * cos(2 * l0) - 0.5 * pow(tan(tilt / 2), 4) * sin(4 * l0) - 1.25 * ecc * ecc * sin(2 * an)) AS eqn FROM (
    SELECT *, radians(23.0 + (26.0 + (21.448 - t * (46.815 + t * (0.00059 - t * 0.001813))) / 60.0) / 60.0 + 0.00256 * cos(node)) AS tilt, radians(ml) AS l0,
        radians(ml + sin(an) * (1.914602 - t * (0.004817 + 0.000014 * t)) + sin(2 * an) * (0.019993 - 0.000101 * t) + sin(3 * an) * 0.000289 - 0.00569 - 0.00478 * sin(node)) AS app FROM (
    SELECT *, {turn('280.46646 + t * (36000.76983 + t * 0.0003032)', '360.0')} AS ml, radians(357.52911 + t * (35999.05029 - 0.0001537 * t)) AS an, 0.016708634 - t * (0.000042037 + 0.0000001267 * t) AS ecc, radians(125.04 - 1934.136 * t) AS node FROM (
    SELECT *, (day + 2440587.5::DOUBLE - 2451545.0::DOUBLE) / 36525.0::DOUBLE AS t FROM (SELECT *, epoch_us(ts) / 86400000000.0::DOUBLE AS day FROM ({source})))))))) """


@query(f"""WITH {POINTS}, e AS (SELECT s_suppkey, lon, lat, TIMESTAMP '2024-06-20 00:00:00' + i * INTERVAL 1 hour AS ts FROM l, range(24) r(i)), z AS ({solar_sql('SELECT * FROM e', 's_suppkey')})
    SELECT s_suppkey, epoch(ts)::BIGINT AS t_s, round(azimuth, 6) AS solar_azimuth, round(elevation, 6) AS solar_elevation FROM z""")
def solar_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    azimuth, elevation = geo.solar_normalised(F.col("ts"), F.col("lon"), F.col("lat"))
    every = points(spark, sf_dir).withColumn("ts", F.explode(F.array(*(F.lit(datetime(2024, 6, 20, h)).cast("timestamp_ntz") for h in range(24)))))
    return every.select("s_suppkey", seconds("ts").alias("t_s"), F.round(azimuth, 6).alias("solar_azimuth"), F.round(elevation, 6).alias("solar_elevation"))


_FRACTION = "((hour(t0) + minute(t0) / 60.0::DOUBLE) / 24)"


@query(f"""WITH {index_sql()}, {SAT}, {nwp_sql()}, w AS ({GENERATION}), g AS (SELECT k, t0, sum(value) AS g FROM w GROUP BY k, t0), s AS (SELECT k, t0, sum(value) AS s FROM sv GROUP BY k, t0), u AS (SELECT k, t0, sum(value) AS u FROM uv GROUP BY k, t0),
    z AS ({solar_sql("SELECT k, t0, t0 + (i - 1) * INTERVAL 1 hour AS ts, -3.0::DOUBLE + k * 0.7 AS lon, 51.0::DOUBLE + k * 0.6 AS lat FROM t, range(3) r(i)", 'k, t0')}), y AS (SELECT k, t0, sum(azimuth) AS a, sum(elevation) AS e FROM z GROUP BY k, t0)
    SELECT g.k AS location_id, epoch(g.t0)::BIGINT AS t0_s, round(g, 3) + 0.0 AS generation, round(s, 3) + 0.0 AS satellite, round(u, 3) + 0.0 AS nwp, round(a, 4) AS azimuth, round(e, 4) AS elevation, round(sin(2 * pi() * hour(g.t0) / 24.0), 5) + 0.0 AS embed_sin, round(hour(g.t0) / 24.0::DOUBLE, 5) AS embed_linear
    FROM g JOIN s ON s.k = g.k AND s.t0 = g.t0 JOIN u ON u.k = g.k AND u.t0 = g.t0 JOIN y ON y.k = g.k AND y.t0 = g.t0""")
def whole_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete samples of all modalities, with their shapes checked: sums of every array."""
    e = engine(spark, sf_dir, solar_position=C.TimeWindow(-60, 60, 60), t0_embedding=C.T0Embedding((("24h", "cyclic"), ("24h", "linear"))))
    out = e.checked(e.samples())
    add = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double"))
    return out.select(
        "location_id", seconds("t0").alias("t0_s"), F.round(add(F.col("generation")), 3).alias("generation"), F.round(add(_flat(F.col("satellite_actual"))), 3).alias("satellite"), F.round(add(_flat(F.col("nwp_ukv.nwp"))), 3).alias("nwp"),
        F.round(add(F.col("solar_azimuth")), 4).alias("azimuth"), F.round(add(F.col("solar_elevation")), 4).alias("elevation"), F.round(F.get("t0_embedding", 0).cast("double"), 5).alias("embed_sin"), F.round(F.get("t0_embedding", 2).cast("double"), 5).alias("embed_linear"),
    )


# -- projections, draws, sources ---------------------------------------------------------------------------------------


def osgb_sql(source: str, columns: str) -> str:
    """A query of source(lon, lat, columns) for columns, x and y on the National Grid: datum shift, then the published series."""
    (a, b), (c, d) = geo._WGS84, geo._AIRY
    e, f = 1 - (b / a) ** 2, 1 - (d / c) ** 2
    (tx, ty, tz), s, (rx, ry, rz) = geo._SHIFT, geo._SCALE, geo._TURN
    k, n, lat0, lon0 = geo._F0, (c - d) / (c + d), geo._LAT0, geo._LON0
    num = lambda v: f"({v!r}::DOUBLE)"
    step = f"atan2(z + {num(f * c)} / sqrt(1 - {num(f)} * pow(sin(q), 2)) * sin(q), hyp)"
    turns = f"SELECT *, atan2(z, hyp * {num(1 - f)}) AS q FROM airy"
    for _ in range(4):
        turns = f"SELECT * EXCLUDE (q), {step} AS q FROM ({turns})"
    arc = f"{num(d * k)} * ({num(1 + n + 1.25 * n**2 + 1.25 * n**3)} * (q - {num(lat0)}) - {num(3 * n + 3 * n**2 + 2.625 * n**3)} * sin(q - {num(lat0)}) * cos(q + {num(lat0)}) + {num(1.875 * n**2 + 1.875 * n**3)} * sin(2 * (q - {num(lat0)})) * cos(2 * (q + {num(lat0)})) - {num(35 / 24 * n**3)} * sin(3 * (q - {num(lat0)})) * cos(3 * (q + {num(lat0)})))"
    return f"""WITH src AS ({source}), cart AS (SELECT *, {num(a)} / sqrt(1 - {num(e)} * pow(sin(radians(lat)), 2)) AS nu0 FROM src),
    xyz AS (SELECT *, nu0 * cos(radians(lat)) * cos(radians(lon)) AS x0, nu0 * cos(radians(lat)) * sin(radians(lon)) AS y0, nu0 * {num(1 - e)} * sin(radians(lat)) AS z0 FROM cart),
    moved AS (SELECT *, {num(tx)} + {num(1 + s)} * x0 - {num(rz)} * y0 + {num(ry)} * z0 AS x1, {num(ty)} + {num(rz)} * x0 + {num(1 + s)} * y0 - {num(rx)} * z0 AS y1, {num(tz)} - {num(ry)} * x0 + {num(rx)} * y0 + {num(1 + s)} * z0 AS z FROM xyz),
    airy AS (SELECT *, sqrt(x1 * x1 + y1 * y1) AS hyp FROM moved), lat AS ({turns}),
    rad AS (SELECT *, {num(c * k)} / sqrt(1 - {num(f)} * pow(sin(q), 2)) AS nu, {num(c * k * (1 - f))} / pow(1 - {num(f)} * pow(sin(q), 2), 1.5) AS rho, atan2(y1, x1) - {num(lon0)} AS w, pow(tan(q), 2) AS t2 FROM lat),
    eta AS (SELECT *, nu / rho - 1 AS eta FROM rad)
    SELECT {columns}, 400000.0 + nu * cos(q) * w + nu / 6 * pow(cos(q), 3) * (nu / rho - t2) * pow(w, 3) + nu / 120 * pow(cos(q), 5) * (5 - 18 * t2 + t2 * t2 + 14 * eta - 58 * t2 * eta) * pow(w, 5) AS x,
        {arc} - 100000.0 + nu / 2 * sin(q) * cos(q) * pow(w, 2) + nu / 24 * sin(q) * pow(cos(q), 3) * (5 - t2 + 9 * eta) * pow(w, 4) + nu / 720 * sin(q) * pow(cos(q), 5) * (61 - 58 * t2 + t2 * t2) * pow(w, 6) AS y FROM eta"""


_SUPPLIERS = f"WITH {POINTS} SELECT s_suppkey, lon, lat FROM l"


@query(f"SELECT s_suppkey, round(x, 2) AS x_osgb, round(y, 2) AS y_osgb, round(lon, 5) AS lon, round(lat, 5) AS lat FROM ({osgb_sql(_SUPPLIERS, 's_suppkey, lon, lat')})")
def project_osgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points on the National Grid, and from there back to where they came from (some hundredths of a metre off)."""
    x, y = geo.lon_lat_to_osgb(F.col("lon"), F.col("lat"))
    back = geo.osgb_to_lon_lat(F.col("x"), F.col("y"))
    return points(spark, sf_dir).withColumn("x", x).withColumn("y", y).select("s_suppkey", F.round("x", 2).alias("x_osgb"), F.round("y", 2).alias("y_osgb"), F.round(back[0], 5).alias("lon"), F.round(back[1], 5).alias("lat"))


_FOUR = "SELECT l AS k, -3.0::DOUBLE + l * 0.7 AS lon, 51.0::DOUBLE + l * 0.6 AS lat FROM range(1, 5) r(l)"


@query(f"SELECT k AS location_id, round(x, 2) AS x_osgb, round(y, 2) AS y_osgb, round(lon, 6) AS longitude FROM ({osgb_sql(_FOUR, 'k, lon')})")
def location_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The locations with the coordinates of every system that a source has."""
    e = SampleEngine(configuration(), tables(spark, sf_dir), systems={"nwp:ukv": "osgb"})
    return e.projected_locations().select("location_id", F.round("x_osgb", 2).alias("x_osgb"), F.round("y_osgb", 2).alias("y_osgb"), F.round("longitude", 6).alias("longitude"))


_BY_TYPE = "x AS (SELECT event_type AS k, date_trunc('hour', ts) AS ts, sum(value) AS value FROM events GROUP BY 1, 2)"
_U = "(('0x' || substr(md5('7|' || k || '|' || strftime(t0, '%Y-%m-%d %H:%M:%S')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


@query(f"""WITH {_BY_TYPE}, t AS (SELECT k, ts AS t0, CASE WHEN {_U} < 0.3 THEN 1 WHEN {_U} < 0.5 THEN 2 ELSE 0 END AS cut FROM (SELECT *, ts AS t0 FROM x)),
    s AS (SELECT t.k, t.t0, cut, x.ts, x.value FROM t JOIN x ON x.k = t.k AND x.ts BETWEEN t.t0 - INTERVAL 2 hour AND t.t0 + INTERVAL 1 hour)
    SELECT k AS event_type, epoch(t0)::BIGINT AS t0_s, epoch(ts)::BIGINT AS t_s, CASE WHEN cut > 0 AND ts > t0 - cut * INTERVAL 1 hour AND ts <= t0 THEN NULL ELSE round(value, 4) END AS value FROM s""")
def history_dropout_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outages of one hour for three in ten windows and of two hours for two in ten, by draws that any engine can repeat."""
    data = hourly(spark, sf_dir)
    sliced = slices.time_slice(data, data.select("event_type", F.col("ts").alias("t0")), -120, 60, 60, ["event_type"])
    out = slices.history_dropout(sliced, [-60, -120], [0.3, 0.2], by=["event_type"], seed=7)
    return out.select("event_type", seconds("t0").alias("t0_s"), seconds("ts").alias("t_s"), F.round("value", 4).alias("value"))


@query(f"""WITH {HOUR}, {RUNS}, t AS (SELECT 'a' AS k, ts AS t0 FROM n), w AS (SELECT t0, CASE WHEN {_U} < 0.25 THEN 3 WHEN {_U} < 0.5 THEN 6 ELSE 0 END AS cut, unnest(generate_series(t0 - INTERVAL 2 hour, t0 + INTERVAL 3 hour, INTERVAL 1 hour)) AS target FROM t),
    c AS (SELECT t0, target, max(n.ts) AS init FROM w JOIN n ON n.ts <= least(target, t0 - cut * INTERVAL 1 hour) AND n.ts >= least(target, t0 - cut * INTERVAL 1 hour) - INTERVAL 12 hour AND n.ts >= t0 - INTERVAL 14 hour GROUP BY ALL)
    SELECT epoch(t0)::BIGINT AS t0_s, epoch(target)::BIGINT AS target_s, epoch(init)::BIGINT AS init_s, (epoch(target - init) / 60)::BIGINT AS step FROM c""")
def forecast_run_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run of every target, where a half of the reference times only see runs of three or six hours ago."""
    runs = tables(spark, sf_dir)["nwp:ukv"].select("init_time_utc").distinct()
    out = slices.forecast_runs(runs, runs.select(F.col("init_time_utc").alias("t0")), -120, 180, 60, 720, (), [-180, -360], 0.5, 7, [F.lit("a")], "init_time_utc")
    return out.select(seconds("t0").alias("t0_s"), seconds("target").alias("target_s"), seconds("init_time_utc").alias("init_s"), "step")


_LINES = "b AS (SELECT date_trunc('month', l_shipdate) AS init, l_orderkey % 100 AS step, l_returnflag AS v, l_partkey % 5 AS x, l_suppkey % 7 AS y, l_quantity AS a, l_tax AS t FROM lineitem)"
_KEPT = "SELECT '{0}' AS provider, {1} AS channel, init, step, x, y, {2} AS value FROM b"


@query(f"""WITH {_LINES}, r AS ({_KEPT.format('ukv', 'v', 'a')} UNION ALL {_KEPT.format('ecmwf', 'v', 'a')} UNION ALL {_KEPT.format('mo_global', 'v', 'a')} UNION ALL {_KEPT.format('cloudcasting', 'v', 'a')} UNION ALL {_KEPT.format('gfs', "'a'", 'a')} UNION ALL {_KEPT.format('gfs', "'t'", 't')}
    UNION ALL SELECT * EXCLUDE (k) FROM (SELECT 'icon_eu' AS provider, v AS channel, init, step, x, y, a AS value, dense_rank() OVER (PARTITION BY init ORDER BY step) AS k FROM b) WHERE k <= 78)
    SELECT provider, channel, epoch(init)::BIGINT AS init_s, count(*)::BIGINT AS n, sum(step)::BIGINT AS steps, sum(x)::BIGINT AS xs, sum(y)::BIGINT AS ys, round(sum(value), 2) + 0.0 AS value FROM r GROUP BY ALL""")
def nwp_providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every provider's own column names as canonical rows, validated."""
    lines = table(spark, sf_dir, "lineitem")
    base = lines.select(F.date_trunc("month", F.col("l_shipdate").cast("timestamp")).cast("timestamp_ntz").alias("init_time"), (F.col("l_orderkey") % 100).alias("step"), F.col("l_returnflag").alias("variable"), (F.col("l_partkey") % 5).alias("x"), (F.col("l_suppkey") % 7).alias("y"), F.col("l_quantity").alias("a"), F.col("l_tax").alias("t"))
    lon_lat, osgb, geos = {"x": "longitude", "y": "latitude"}, {"x": "x_osgb", "y": "y_osgb"}, {"x": "x_geostationary", "y": "y_geostationary"}
    one = base.drop("t")
    made = {"ukv": one.withColumnsRenamed(osgb), "ecmwf": one.withColumnsRenamed(lon_lat), "mo_global": one.withColumnsRenamed(lon_lat), "cloudcasting": one.withColumnsRenamed(geos), "gfs": base.drop("variable").withColumnsRenamed(lon_lat), "icon_eu": base.withColumnRenamed("a", "icon_eu_data").withColumnsRenamed(lon_lat)}
    out = None
    for name, df in made.items():
        rows = readers.validate(readers.PROVIDERS[name](df), readers.NWP_TABLE, name).select(F.lit(name).alias("provider"), "channel", seconds("init_time_utc").alias("init_s"), "step", "x", "y", "value")
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("provider", "channel", "init_s").agg(F.count("*").alias("n"), F.sum("step").alias("steps"), F.sum("x").alias("xs"), F.sum("y").alias("ys"), F.round(F.sum("value"), 2).alias("value"))


@query("""WITH g AS (SELECT user_id % 40 AS location_id, date_trunc('hour', ts) AS ts, sum(value) AS v FROM events WHERE user_id IS NOT NULL GROUP BY 1, 2), b AS (SELECT DISTINCT ts FROM g WHERE (epoch(ts)::BIGINT // 3600 + location_id) % 17 = 0)
    SELECT location_id, epoch(ts)::BIGINT AS t_s, round(v / 1000, 6) + 0.0 AS generation_mw, 1.5 AS capacity_mwp, s_name AS name FROM g LEFT JOIN supplier ON s_suppkey = location_id AND s_suppkey % 2 = 0 WHERE ts NOT IN (SELECT ts FROM b)""")
def legacy_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kilowatts and separate metadata as the canonical table, without the times at which any location has no value."""
    events = table(spark, sf_dir, "events").where("user_id IS NOT NULL").withColumn("location_id", F.col("user_id") % 40)
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz")
    sums = events.groupBy("location_id", hour.alias("time_utc")).agg(F.sum("value").alias("v"))
    number = F.floor(periods.micros("time_utc") / F.lit(3_600_000_000))
    values = sums.select("location_id", "time_utc", F.when((number + F.col("location_id")) % 17 != 0, F.col("v")).alias("generation_kw"), F.lit(1500.0).alias("capacity_kwp"))
    names = table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("location_id"), F.col("s_name").alias("name"))
    out = legacy.reformat_generation(values, names)
    return out.select("location_id", seconds("time_utc").alias("t_s"), F.round("generation_mw", 6).alias("generation_mw"), "capacity_mwp", "name")


@query(f"WITH {_BY_TYPE}, {islands_sql('i', 'x', '1 hour', 3)} SELECT k AS event_type, epoch(s)::BIGINT AS start_s, epoch(e)::BIGINT AS end_s FROM i")
def session_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming operator's contiguous periods, over the table."""
    found = islands.contiguous_periods(hourly(spark, sf_dir), 60, 3, ["event_type"])
    return found.select("event_type", seconds("start_dt").alias("start_s"), seconds("end_dt").alias("end_s"))


@query("SELECT n_nationkey::DOUBLE AS x, n_regionkey AS value FROM nation UNION ALL SELECT n_nationkey::DOUBLE, n_regionkey + 10 FROM nation")
def concat_other_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stores whose axes differ by rounding as one table on the first one's axis."""
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("double").alias("x"), F.col("n_regionkey").alias("value"))
    return readers.concat([rows, rows.select((F.col("x") + 1e-6).alias("x"), (F.col("value") + 10).alias("value"))], ["x"])
