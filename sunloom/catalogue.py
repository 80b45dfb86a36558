"""The registered queries of the forecasting-sample engine and their SQL twins.

`events` stands in for measurements (hourly, keyed by event_type or user_id),
`supplier` for locations.  Times leave as seconds since 1970.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sunloom.functions import features, geo
from sunloom.operators import grid, periods, slices
from sunloom.sources import readers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    """Registers a query under its name, with its SQL."""

    def add(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = " ".join(sql.split())
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(c: str | Column) -> Column:
    return F.floor(periods.micros(c) / F.lit(1_000_000)).cast("long")


def hourly(spark: SparkSession, sf_dir: str, key: str = "event_type") -> DataFrame:
    """(key, ts, value): distinct hours with the sum of their values."""
    return table(spark, sf_dir, "events").groupBy(key, F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("ts")).agg(F.sum("value").alias("value"))


def _periods(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, seconds("start_dt").alias("start_s"), seconds("end_dt").alias("end_s"))


HOURS = "h AS (SELECT {key} AS k, date_trunc('hour', ts) AS ts, sum(value) AS value FROM events GROUP BY 1, 2)"


def islands_sql(name: str, source: str, gap: str, least: int, keys: str = "k") -> str:
    """CTEs of the islands of source(keys, ts) with more than `least` times."""
    return f"""{name}_f AS (SELECT {keys}, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY {keys} ORDER BY ts) > INTERVAL {gap} THEN 1 ELSE 0 END AS f FROM (SELECT DISTINCT {keys}, ts FROM {source})),
    {name}_g AS (SELECT {keys}, ts, sum(f) OVER (PARTITION BY {keys} ORDER BY ts) AS g FROM {name}_f),
    {name} AS (SELECT {keys}, min(ts) AS s, max(ts) AS e FROM {name}_g GROUP BY {keys}, g HAVING count(*) > {least})"""


T0 = f"{islands_sql('i', 'h', '1 hour', 6)}, p AS (SELECT k, s + INTERVAL 2 hour AS s, e - INTERVAL 3 hour AS e FROM i WHERE s + INTERVAL 2 hour <= e - INTERVAL 3 hour)"
BY_TYPE, BY_USER = HOURS.format(key="event_type"), HOURS.format(key="user_id")
#: History of two hours, horizon of three.
WINDOW = (-120, 180, 60)


@query(f"WITH {BY_TYPE}, {islands_sql('i', 'h', '1 hour', 3)} SELECT k AS event_type, epoch(s)::BIGINT AS start_s, epoch(e)::BIGINT AS end_s FROM i")
def contiguous_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _periods(periods.contiguous_periods(hourly(spark, sf_dir), 60, 3, ["event_type"]), "event_type")


@query(f"WITH {BY_TYPE}, {T0} SELECT k AS event_type, epoch(s)::BIGINT AS start_s, epoch(e)::BIGINT AS end_s FROM p")
def contiguous_t0_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _periods(periods.contiguous_t0_periods(hourly(spark, sf_dir), *WINDOW, keys=["event_type"]), "event_type")


INITS = "n AS (SELECT DISTINCT user_id % 50 AS k, time_bucket(INTERVAL 3 hour, ts) AS ts FROM events WHERE user_id IS NOT NULL)"
FORECAST = """nf AS (SELECT k, ts, CASE WHEN lag(ts) OVER (PARTITION BY k ORDER BY ts) + INTERVAL 6 hour < ts + INTERVAL 3 hour THEN 1 ELSE 0 END AS f FROM n),
    ng AS (SELECT k, ts, sum(f) OVER (PARTITION BY k ORDER BY ts) AS g FROM nf),
    np AS (SELECT k, min(ts) + INTERVAL 3 hour AS s, max(ts) + INTERVAL 6 hour AS e FROM ng GROUP BY k, g)"""


def inits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, init_time): three-hourly runs of 50 sources."""
    at = F.timestamp_micros(F.floor(periods.micros("ts") / F.lit(10_800_000_000).cast("decimal(20,0)")).cast("long") * F.lit(10_800_000_000)).cast("timestamp_ntz")
    return table(spark, sf_dir, "events").where("user_id IS NOT NULL").select((F.col("user_id") % 50).alias("k"), at.alias("init_time")).distinct()


@query(f"WITH {INITS}, {FORECAST} SELECT k, epoch(s)::BIGINT AS start_s, epoch(e)::BIGINT AS end_s FROM np")
def forecast_validity_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _periods(periods.forecast_t0_periods(inits(spark, sf_dir), -120, 360, 180, keys=["k"]), "k")


def _of(spark: SparkSession, sf_dir: str, *kinds: str) -> list[DataFrame]:
    found = periods.contiguous_periods(hourly(spark, sf_dir), 60, 2, ["event_type"])
    return [found.where(F.col("event_type") == k).drop("event_type") for k in kinds]


def _kinds(spark: SparkSession, sf_dir: str, n: int) -> list[str]:
    return [r[0] for r in table(spark, sf_dir, "events").select("event_type").distinct().orderBy("event_type").limit(n).collect()]


ISLANDS = f"{BY_TYPE}, {islands_sql('i', 'h', '1 hour', 2)}, r AS (SELECT *, dense_rank() OVER (ORDER BY k) AS r FROM i), x AS (SELECT s, e FROM r WHERE r = 1), y AS (SELECT s, e FROM r WHERE r = 2), z AS (SELECT s, e FROM r WHERE r = 3)"
PAIR = "xy AS (SELECT greatest(x.s, y.s) AS s, least(x.e, y.e) AS e FROM x JOIN y ON x.s <= y.e AND x.e >= y.s)"


@query(f"WITH {ISLANDS}, {PAIR} SELECT epoch(s)::BIGINT AS start_s, epoch(e)::BIGINT AS end_s FROM xy")
def interval_intersection_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _periods(periods.intersect_many(_of(spark, sf_dir, *_kinds(spark, sf_dir, 2))))


@query(f"WITH {ISLANDS}, {PAIR} SELECT epoch(greatest(a.s, z.s))::BIGINT AS start_s, epoch(least(a.e, z.e))::BIGINT AS end_s FROM xy a JOIN z ON a.s <= z.e AND a.e >= z.s")
def interval_intersection_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _periods(periods.intersect_many(_of(spark, sf_dir, *_kinds(spark, sf_dir, 3))))


FILLED = "t AS (SELECT k, unnest(generate_series(time_bucket(INTERVAL 2 hour, s + INTERVAL 2 hour - INTERVAL 1 second), e, INTERVAL 2 hour)) AS t0 FROM p)"


@query(f"WITH {BY_TYPE}, {T0}, {FILLED} SELECT k AS event_type, epoch(t0)::BIGINT AS t0_s FROM t")
def fill_t0(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = periods.contiguous_t0_periods(hourly(spark, sf_dir), *WINDOW, keys=["event_type"])
    return periods.fill_periods(valid, 120, ["event_type"]).select("event_type", seconds("t0").alias("t0_s"))


SMALL = "WITH h AS (SELECT user_id % 40 AS k, date_trunc('hour', ts) AS ts, sum(value) AS value FROM events WHERE user_id IS NOT NULL GROUP BY 1, 2)"


def by_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").where("user_id IS NOT NULL").withColumn("k", F.col("user_id") % 40)
    return events.groupBy("k", F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("ts")).agg(F.sum("value").alias("value"))


SHORT = f"{islands_sql('i', 'h', '1 hour', 4)}, p AS (SELECT k, s + INTERVAL 1 hour AS s, e - INTERVAL 2 hour AS e FROM i WHERE s + INTERVAL 1 hour <= e - INTERVAL 2 hour), w AS (SELECT DISTINCT 0 AS k, ts FROM h), {islands_sql('j', 'w', '1 hour', 3)}, q AS (SELECT s + INTERVAL 1 hour AS s, e - INTERVAL 1 hour AS e FROM j), v AS (SELECT p.k, greatest(p.s, q.s) AS s, least(p.e, q.e) AS e FROM p JOIN q ON p.s <= q.e AND p.e >= q.s WHERE q.s <= q.e)"


def _valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = by_location(spark, sf_dir)
    own = periods.contiguous_t0_periods(data, -60, 120, 60, ["k"])
    weather = periods.contiguous_t0_periods(data.select("ts"), -60, 60, 60)
    return periods.fill_periods(periods.intersect_periods(own, weather, carry=["k"]), 60, ["k"])


@query(f"{SMALL}, {SHORT} SELECT k AS location_id, epoch(unnest(generate_series(s, e, INTERVAL 1 hour)))::BIGINT AS t0_s FROM v")
def valid_t0_by_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _valid(spark, sf_dir).select(F.col("k").alias("location_id"), seconds("t0").alias("t0_s"))


@query(f"{SMALL}, {SHORT}, u AS (SELECT k, unnest(generate_series(s, e, INTERVAL 1 hour)) AS t0 FROM v) SELECT epoch(t0)::BIGINT AS t0_s, count(*)::BIGINT AS locations FROM u GROUP BY t0")
def valid_t0_joint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _valid(spark, sf_dir).groupBy("t0").agg(F.count("*").alias("locations")).select(seconds("t0").alias("t0_s"), "locations")


@query(f"WITH {BY_TYPE} SELECT k AS event_type, epoch(ts)::BIGINT AS t_s FROM h WHERE ts BETWEEN TIMESTAMP '2024-01-03 06:00:00' AND TIMESTAMP '2024-01-05 07:00:00' OR ts >= TIMESTAMP '2024-01-20 12:00:00'")
def time_period_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask = periods.time_mask(F.col("ts"), [(datetime(2024, 1, 3, 6), datetime(2024, 1, 5, 7)), (datetime(2024, 1, 20, 12), None)])
    return hourly(spark, sf_dir).where(mask).select("event_type", seconds("ts").alias("t_s"))


ALL_T0 = "t AS (SELECT k, unnest(generate_series(s, e, INTERVAL 1 hour)) AS t0 FROM p)"
SLICED = f"WITH {BY_TYPE}, {T0}, {ALL_T0}, s AS (SELECT t.k, t.t0, h.ts, h.value FROM t JOIN h ON h.k = t.k AND h.ts BETWEEN t.t0 - INTERVAL 2 hour AND t.t0 + INTERVAL 3 hour)"


def _t0s(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.fill_periods(periods.contiguous_t0_periods(hourly(spark, sf_dir), *WINDOW, keys=["event_type"]), 60, ["event_type"])


def _sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slices.time_slice(hourly(spark, sf_dir), _t0s(spark, sf_dir), *WINDOW, ["event_type"])


@query(f"{SLICED} SELECT k AS event_type, epoch(t0)::BIGINT AS t0_s, epoch(ts)::BIGINT AS t_s, round(value, 4) AS value FROM s")
def time_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sliced(spark, sf_dir).select("event_type", seconds("t0").alias("t0_s"), seconds("ts").alias("t_s"), F.round("value", 4).alias("value"))


@query(f"{SLICED} SELECT k AS event_type, epoch(t0)::BIGINT AS t0_s, epoch(ts)::BIGINT AS t_s, CASE WHEN ts > t0 - INTERVAL 1 hour AND ts <= t0 THEN NULL ELSE round(value, 4) END AS value FROM s")
def history_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = slices.history_dropout(_sliced(spark, sf_dir), [-60], 1.0, by=["event_type"])
    return out.select("event_type", seconds("t0").alias("t0_s"), seconds("ts").alias("t_s"), F.round("value", 4).alias("value"))


def asof_sql(drop: int) -> str:
    return f"""WITH {INITS}, g AS (SELECT DISTINCT k, ts + INTERVAL 1 hour AS t0 FROM n), w AS (SELECT k, t0, unnest(generate_series(t0 - INTERVAL 2 hour, t0 + INTERVAL 3 hour, INTERVAL 1 hour)) AS target FROM g),
    c AS (SELECT w.k, w.t0, w.target, max(n.ts) AS init FROM w JOIN n ON n.k = w.k AND n.ts <= least(w.target, w.t0 - INTERVAL {drop} hour) AND n.ts >= w.t0 - INTERVAL 2 hour - INTERVAL 8 hour GROUP BY ALL)
    SELECT k, epoch(t0)::BIGINT AS t0_s, epoch(target)::BIGINT AS target_s, epoch(init)::BIGINT AS init_s, (epoch(target - init) / 60)::INTEGER AS step FROM c WHERE target - init <= INTERVAL 8 hour"""


def _asof(spark: SparkSession, sf_dir: str, deltas: list[int]) -> DataFrame:
    runs = inits(spark, sf_dir)
    t0s = runs.select("k", (F.col("init_time") + periods.minutes(60)).alias("t0"))
    forecast = runs.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(480), F.lit(60))))
    out = slices.forecast_slice(forecast, t0s, -120, 180, 60, 480, ["k"], deltas, 1.0 if deltas else 0.0)
    return out.select("k", seconds("t0").alias("t0_s"), seconds("target").alias("target_s"), seconds("init_time").alias("init_s"), "step")


@query(asof_sql(0))
def asof_forecast_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asof(spark, sf_dir, [])


@query(asof_sql(4))
def asof_forecast_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asof(spark, sf_dir, [-240])


MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
UNPIVOTED = " UNION ALL ".join(f"SELECT l_orderkey, l_linenumber, '{c}' AS channel, {c} AS value FROM lineitem" for c in MEASURES)


@query(UNPIVOTED)
def unpivot_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.unpivot_channels(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], MEASURES)


@query(f"""WITH u AS ({UNPIVOTED}), c(channel, pos, m, s, lo, hi) AS (VALUES ('l_extendedprice', 0, 30000.0::DOUBLE, 20000.0::DOUBLE, 1000.0::DOUBLE, 60000.0::DOUBLE), ('l_quantity', 1, 25.0, 14.0, 2.0, 45.0))
    SELECT l_orderkey, l_linenumber, u.channel, pos AS channel_pos, round((least(greatest(value, lo), hi) - m) / s, 8) + 0.0 AS value FROM u JOIN c ON u.channel = c.channel""")
def channel_select_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["l_extendedprice", "l_quantity"]  # only these columns are read and made rows of
    chosen = grid.select_channels(grid.unpivot_channels(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], names), names)
    constants = spark.createDataFrame([("l_extendedprice", 30000.0, 20000.0, 1000.0, 60000.0), ("l_quantity", 25.0, 14.0, 2.0, 45.0)], "channel string, mean double, std double, lo double, hi double")
    return features.normalise(chosen, constants).withColumn("value", F.round("value", 8))


@query("WITH c AS (SELECT user_id, max(value) AS cap FROM events GROUP BY 1) SELECT e.event_id, round(CASE WHEN cap = 0 THEN NULL ELSE value / cap END, 6) + 0.0 AS ratio FROM events e JOIN c ON e.user_id = c.user_id WHERE cap <> 0")
def capacity_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    cap = events.groupBy("user_id").agg(F.max("value").alias("cap")).where("cap <> 0")
    return events.join(cap, "user_id").select("event_id", F.round(features.capacity_ratio(F.col("value"), F.col("cap")), 6).alias("ratio"))


ACCUMULATED = "o AS (SELECT l_orderkey, l_linenumber, sum(l_quantity) AS l_quantity, max(l_discount) AS l_discount FROM lineitem GROUP BY 1, 2), a AS (SELECT l_orderkey, l_linenumber AS step, sum(l_quantity) OVER w AS q, l_discount AS d FROM o WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)), l AS (SELECT l_orderkey, step, q, d, lead(q) OVER v AS nq, lead(1) OVER v AS more FROM a WINDOW v AS (PARTITION BY l_orderkey ORDER BY step))"


@query(f"WITH {ACCUMULATED} SELECT l_orderkey, step, 'q' AS channel, round(nq - q, 6) + 0.0 AS value FROM l WHERE more = 1 UNION ALL SELECT l_orderkey, step, 'd', round(d, 6) + 0.0 FROM l WHERE more = 1")
def accumulated_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    total = F.sum("l_quantity").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber"))
    once = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias("l_quantity"), F.max("l_discount").alias("l_discount"))
    wide = once.select("l_orderkey", F.col("l_linenumber").alias("step"), total.alias("q"), F.col("l_discount").alias("d"))
    out = slices.lead_difference(wide.unpivot(["l_orderkey", "step"], ["q", "d"], "channel", "value"), ["q"], ["l_orderkey"], "step")
    return out.withColumn("value", F.round("value", 6))


@query(f"""WITH {BY_TYPE}, b AS (SELECT k, unnest(generate_series(min(ts), max(ts), INTERVAL 1 hour)) AS ts FROM h GROUP BY k)
    SELECT b.k AS event_type, epoch(b.ts)::BIGINT AS t_s, round(coalesce(h.value, -1.0), 4) AS value FROM b LEFT JOIN h ON h.k = b.k AND h.ts = b.ts""")
def fill_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = hourly(spark, sf_dir)
    spans = data.groupBy("event_type").agg(F.min("ts").alias("start_dt"), F.max("ts").alias("end_dt"))
    full = periods.fill_periods(spans, 60, ["event_type"], "ts").join(data, ["event_type", "ts"], "left")
    return full.select("event_type", seconds("ts").alias("t_s"), F.round(features.fill_missing(F.col("value"), -1.0), 4).alias("value"))


DATE, TIME = "2 * pi() * dayofyear(ts) / 365", "2 * pi() * (60 * hour(ts) + minute(ts)) / 1440"


@query(f"SELECT event_id, round(sin({DATE}), 6) + 0.0 AS date_sin, round(cos({DATE}), 6) + 0.0 AS date_cos, round(sin({TIME}), 6) + 0.0 AS time_sin, round(cos({TIME}), 6) + 0.0 AS time_cos FROM events")
def calendar_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", *(F.round(c, 6).alias(k) for k, c in features.calendar(F.col("ts")).items()))


@query("SELECT event_id, round((hour(ts) + minute(ts) / 60.0::DOUBLE) / 6, 6) AS frac, round(sin(2 * pi() * (hour(ts) + minute(ts) / 60.0::DOUBLE) / 6), 6) + 0.0 AS s, round(cos(2 * pi() * (hour(ts) + minute(ts) / 60.0::DOUBLE) / 6), 6) + 0.0 AS c FROM events")
def t0_embedding_h(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features.t0_fraction(F.col("ts"), "6h")
    return table(spark, sf_dir, "events").select("event_id", F.round(f, 6).alias("frac"), F.round(F.sin(f * 2 * F.pi()), 6).alias("s"), F.round(F.cos(f * 2 * F.pi()), 6).alias("c"))


YEAR = "((dayofyear(o_orderdate) - 1) / dayofyear(make_date(year(o_orderdate), 12, 31))::DOUBLE + year(o_orderdate) % 2) / 2"


@query(f"SELECT o_orderkey, round({YEAR}, 6) AS frac, round(sin(2 * pi() * {YEAR}), 6) + 0.0 AS s, round(cos(2 * pi() * {YEAR}), 6) + 0.0 AS c FROM orders")
def t0_embedding_y(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features.t0_fraction(F.col("o_orderdate"), "2y")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(f, 6).alias("frac"), F.round(F.sin(f * 2 * F.pi()), 6).alias("s"), F.round(F.cos(f * 2 * F.pi()), 6).alias("c"))


POINTS = "l AS (SELECT s_suppkey, -8.0::DOUBLE + (s_suppkey * 37 % 997) / 100.0::DOUBLE AS lon, 50.0::DOUBLE + (s_suppkey * 53 % 811) / 100.0::DOUBLE AS lat FROM supplier)"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s_suppkey, lon, lat): locations made of the supplier's key."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select("s_suppkey", (F.lit(-8.0) + (k * 37 % 997) / 100.0).alias("lon"), (F.lit(50.0) + (k * 53 % 811) / 100.0).alias("lat"))


def axes(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Longitudes -12 to 4 and latitudes 48 to 62 by 0.25, the latter decreasing in the source."""
    return (grid.axis_index(spark.range(65).select((F.lit(-12.0) + F.col("id") * 0.25).alias("coord"))), grid.axis_index(spark.range(57).select((F.lit(62.0) - F.col("id") * 0.25).alias("coord"))))


NEAREST = f"""WITH {POINTS}, ax AS (SELECT i, -12.0::DOUBLE + i * 0.25::DOUBLE AS c FROM range(65) t(i)), ay AS (SELECT i, 48.0::DOUBLE + i * 0.25::DOUBLE AS c FROM range(57) t(i)),
    nx AS (SELECT s_suppkey, min(struct_pack(d := abs(c - lon), i := i)).i AS cx FROM l CROSS JOIN ax GROUP BY 1), ny AS (SELECT s_suppkey, min(struct_pack(d := abs(c - lat), i := i)).i AS cy FROM l CROSS JOIN ay GROUP BY 1)"""


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = axes(spark)
    return grid.nearest_index(grid.nearest_index(points(spark, sf_dir), x, "lon", "cx"), y, "lat", "cy")


@query(f"{NEAREST} SELECT s_suppkey, cx::INTEGER AS cx, cy::INTEGER AS cy FROM nx JOIN ny USING (s_suppkey)")
def nearest_pixel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pixels(spark, sf_dir).select("s_suppkey", F.col("cx").cast("int").alias("cx"), F.col("cy").cast("int").alias("cy"))


def _cells(spark: SparkSession) -> DataFrame:
    x = F.floor(F.col("id") / 57).cast("int")
    return spark.range(65 * 57).select(x.alias("x_idx"), (F.col("id") % 57).cast("int").alias("y_idx"), (F.col("id") * 7 % 1000).alias("value"))


@query(f"{NEAREST}, g AS (SELECT (id // 57)::INTEGER AS x, (id % 57)::INTEGER AS y, id * 7 % 1000 AS value FROM range(65 * 57) t(id)) SELECT s_suppkey, x AS x_idx, y AS y_idx, value FROM nx JOIN ny USING (s_suppkey) JOIN g ON x BETWEEN cx - 2 AND cx + 1 AND y BETWEEN cy - 3 AND cy + 2")
def spatial_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.crop(_pixels(spark, sf_dir), _cells(spark), 4, 6, 65, 57).select("s_suppkey", "x_idx", "y_idx", "value")


@query(f"{NEAREST}, b AS (SELECT min(cx) - 1 AS x0, max(cx) + 1 AS x1, min(cy) - 2 AS y0, max(cy) + 1 AS y1 FROM nx JOIN ny USING (s_suppkey)) SELECT (id // 57)::INTEGER AS x_idx, (id % 57)::INTEGER AS y_idx, id * 7 % 1000 AS value FROM range(65 * 57) t(id), b WHERE id // 57 BETWEEN x0 AND x1 AND id % 57 BETWEEN y0 AND y1")
def multi_location_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    x0, x1, y0, y1 = grid.extent(_pixels(spark, sf_dir), 2, 4)
    return _cells(spark).where(F.col("x_idx").between(x0, x1) & F.col("y_idx").between(y0, y1))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 2 <> 0")
def concat_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return readers.concat([orders.where("o_orderkey % 2 = 0"), orders.where("o_orderkey % 2 <> 0")])


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM (SELECT *, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS r FROM lineitem) WHERE r <= 3")
def first_n_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.first_steps(table(spark, sf_dir, "lineitem"), 3, ["l_orderkey"], "l_linenumber").select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey >= 1")
def location_zero_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.drop_zero_location(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey")


@query("WITH t AS (SELECT DISTINCT date_trunc('day', ts) AS t0 FROM events), n AS (SELECT count(*) AS n FROM t), l AS (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) - 1 AS i FROM nation), u AS (SELECT t0, row_number() OVER (ORDER BY t0) - 1 AS j FROM t) SELECT n_nationkey AS location_id, epoch(t0)::BIGINT AS t0_s, i * n + j AS sample_idx FROM l CROSS JOIN u CROSS JOIN n")
def cross_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    t0s = table(spark, sf_dir, "events").select(F.date_trunc("day", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("t0")).distinct()
    out = grid.cross_index(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("location_id")), t0s)
    return out.select("location_id", seconds("t0").alias("t0_s"), "sample_idx")


@query("SELECT l_orderkey, string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber) AS steps, string_agg(l_quantity::INTEGER::VARCHAR, ',' ORDER BY l_linenumber, l_quantity::INTEGER) AS quantities, count(*)::BIGINT AS n FROM lineitem GROUP BY 1")
def collate_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("q"))
    out = grid.collate(items, "l_orderkey", "l_linenumber", ["q"])
    return out.select("l_orderkey", F.concat_ws(",", F.col("l_linenumber").cast("array<string>")).alias("steps"), F.concat_ws(",", F.col("q").cast("array<string>")).alias("quantities"), F.size("q").cast("long").alias("n"))


GEOS = """WITH {0}, a AS (SELECT s_suppkey, radians(lon - 9.5) AS dl, atan({1} * tan(radians(lat))) AS p FROM l), b AS (SELECT s_suppkey, dl, p, sqrt({1}) / sqrt({1} * cos(p) * cos(p) + sin(p) * sin(p)) AS r FROM a),
    c AS (SELECT s_suppkey, r * cos(dl) * cos(p) AS vx, r * sin(dl) * cos(p) AS vy, r * sin(p) AS vz FROM b) SELECT s_suppkey, round(35785831.0::DOUBLE * atan(vy / (1 + 35785831.0::DOUBLE / 6378169.0 - vx)), 1) + 0.0 AS x_geo, round(35785831.0::DOUBLE * atan(vz / sqrt(vy * vy + (1 + 35785831.0::DOUBLE / 6378169.0 - vx) ** 2)), 1) + 0.0 AS y_geo FROM c"""
_RP2 = 1 - (1 / 295.488065897014) * (2 - 1 / 295.488065897014)


@query(GEOS.format(POINTS, f"{_RP2!r}::DOUBLE"))
def project_geos(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = geo.lon_lat_to_geostationary(F.col("lon"), F.col("lat"), geo.Area())
    return points(spark, sf_dir).select("s_suppkey", F.round(x, 1).alias("x_geo"), F.round(y, 1).alias("y_geo"))


@query(f"""{SLICED}, c AS (SELECT k, max(value) AS cap FROM h GROUP BY k) SELECT s.k AS event_type, epoch(t0)::BIGINT AS t0_s, (epoch(ts - t0) / 3600)::INTEGER AS step, round(CASE WHEN ts > t0 - INTERVAL 1 hour AND ts <= t0 THEN 0.0 ELSE value / cap END, 6) + 0.0 AS generation,
    round(sin({DATE}), 6) + 0.0 AS date_sin, round(cos({TIME}), 6) + 0.0 AS time_cos, round((hour(t0) + minute(t0) / 60.0::DOUBLE) / 24, 6) AS t0_frac FROM s JOIN c ON s.k = c.k""")
def flagship_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid reference times, their windows with simulated outages, capacity ratios and calendar features."""
    data = hourly(spark, sf_dir)
    cap = data.groupBy("event_type").agg(F.max("value").alias("cap"))
    out = slices.history_dropout(_sliced(spark, sf_dir), [-60], 1.0, by=["event_type"]).join(cap, "event_type")
    ratio = features.fill_missing(features.capacity_ratio(F.col("value"), F.col("cap")))
    c = features.calendar(F.col("ts"))
    step = ((periods.micros("ts") - periods.micros("t0")) / F.lit(3_600_000_000)).cast("int")
    return out.select("event_type", seconds("t0").alias("t0_s"), step.alias("step"), F.round(ratio, 6).alias("generation"), F.round(c["date_sin"], 6).alias("date_sin"), F.round(c["time_cos"], 6).alias("time_cos"), F.round(features.t0_fraction(F.col("t0"), "24h"), 6).alias("t0_frac"))


# (At the end: these queries are registered here too.)
from sunloom import sample_queries  # noqa: E402, F401
