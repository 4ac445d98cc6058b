"""Timetable queries on the driver's tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import timetable as tt
from . import adapters as ad
from .registry import query

EXCLUDED = ("BUILDING",)
TODAY = date(1997, 6, 1)


@query(ad.sql("SELECT trip, agency, category, train_number FROM trips WHERE (route_type::INT = 2 OR route_type::INT BETWEEN 100 AND 117) AND agency NOT IN ('BUILDING')"))
def prj1_rail_trips(spark: SparkSession, sf: str) -> DataFrame:
    return tt.rail_trips(ad.trips(spark, sf), EXCLUDED).select("trip", "agency", "category", "train_number")


@query(ad.sql("SELECT station, count(*) AS n_calls, count(*) FILTER (coalesce(pickup_type, '0') <> '1') AS n_board FROM calls WHERE coalesce(pickup_type, '0') <> '1' OR drop_off_type <> '1' GROUP BY station"))
def prj2_boardable_calls(spark: SparkSession, sf: str) -> DataFrame:
    return tt.boardable(ad.calls(spark, sf)).groupBy("station").agg(F.count("*").alias("n_calls"), F.count_if("can_board").alias("n_board"))


@query("SELECT s_suppkey AS stop_id, upper(substr(zone, 5)) AS code FROM (SELECT s_suppkey, s_nationkey, CASE WHEN s_suppkey % 5 = 0 THEN 'X:' ELSE 'IFF:' END || lower(printf('N%02d', s_nationkey)) AS zone FROM supplier) JOIN nation ON n_nationkey = s_nationkey AND n_regionkey <> 2 WHERE zone LIKE 'IFF:%'")
def prj3_station_codes(spark: SparkSession, sf: str) -> DataFrame:
    zone = F.concat(F.when(F.col("s_suppkey") % 5 == 0, "X:").otherwise("IFF:"), F.lower(F.format_string("N%02d", "s_nationkey")))
    stops = ad.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("stop_id"), zone.alias("zone_id"))
    return tt.station_of_zone(stops, ad.stations(spark, sf).filter("region <> 2")).select("stop_id", "code")


@query("SELECT o_custkey AS service, o_orderdate::DATE::VARCHAR AS date FROM orders WHERE o_orderstatus = 'O'")
def prj4_service_dates(spark: SparkSession, sf: str) -> DataFrame:
    calendar = ad.table(spark, sf, "orders").select(F.col("o_custkey").alias("service"), F.date_format("o_orderdate", "yyyyMMdd").alias("date"), F.when(F.col("o_orderstatus") == "O", "1").otherwise("2").alias("exception_type"))
    return tt.service_dates(calendar)


TRAIN_SETS = ("FURNITURE",), ("5-LOW",), ("MACHINERY", "HOUSEHOLD"), ("1-URGENT",)

_TRAIN_SETS = """
x AS (
    SELECT agency, category, s AS train_set, coalesce(agency IN ('FURNITURE'), false) OR coalesce(category IN ('5-LOW'), false) AS out,
        s = 'all' OR coalesce(agency NOT IN ('MACHINERY', 'HOUSEHOLD'), true) OR category IN ('1-URGENT') AS by_category,
        CASE trip % 9 WHEN 0 THEN true WHEN 1 THEN false END AS verdict
    FROM trips, (VALUES ('all'), ('sprinter')) v(s)
)
SELECT agency, category, train_set, count(*) AS n,
    count(*) FILTER (NOT out AND CASE WHEN train_set = 'all' THEN true ELSE coalesce(verdict, by_category) END) AS n_in,
    count(*) FILTER (NOT out AND NOT by_category AND verdict) AS n_by_verdict
FROM x GROUP BY ALL
"""


def verdict_of(trip):
    return F.when(trip % 9 == 0, True).when(trip % 9 == 1, False)


@query(ad.sql(_TRAIN_SETS))
def prj5_train_set(spark: SparkSession, sf: str) -> DataFrame:
    """PRJ-5: members of a set, and those that only their verdict brings in."""
    x = ad.trips(spark, sf).withColumn("train_set", F.explode(F.array(F.lit("all"), F.lit("sprinter"))))
    given = F.col("agency"), F.col("category"), F.col("train_set"), verdict_of(F.col("trip")), *TRAIN_SETS
    return x.groupBy("agency", "category", "train_set").agg(F.count("*").alias("n"), F.count_if(tt.in_train_set(*given)).alias("n_in"), F.count_if(tt.in_only_by_verdict(*given)).alias("n_by_verdict"))


@query(ad.sql("SELECT station, count(DISTINCT trip) AS trips FROM calls GROUP BY station"))
def agg1_agg4_calls_per_station(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-1, AGG-4."""
    return tt.calls_per_station(ad.calls(spark, sf)).groupBy("station").agg(F.count("*").alias("trips"))


_SERVED = "served AS (SELECT date, station, count(*) AS calls FROM (SELECT DISTINCT trip, station FROM calls) JOIN trips t USING (trip) JOIN (SELECT DISTINCT service, date FROM trips) d USING (service) GROUP BY ALL), regular AS (SELECT station, count(DISTINCT date) AS days FROM served GROUP BY station HAVING count(DISTINCT date) * 2 >= (SELECT count(DISTINCT date) FROM served))"
_SERVED = _SERVED.replace("SELECT date, station", "SELECT d.date, station")


def _served(spark: SparkSession, sf: str) -> DataFrame:
    trips = ad.trips(spark, sf)
    return tt.served_stations(ad.calls(spark, sf), trips, trips.select("service", "date"))


@query(ad.sql(f"{_SERVED} SELECT * FROM regular"))
def agg2_regular_stations(spark: SparkSession, sf: str) -> DataFrame:
    served = _served(spark, sf)
    return tt.regular_stations(served, served)


@query(ad.sql(f"{_SERVED} SELECT date::VARCHAR AS date, count(DISTINCT station) AS stations, sum(calls)::BIGINT AS calls FROM served JOIN regular USING (station) GROUP BY 1"))
def agg3_date_scores(spark: SparkSession, sf: str) -> DataFrame:
    served = _served(spark, sf)
    return tt.date_scores(served, tt.regular_stations(served, served))


_CHOSEN = _SERVED.replace("JOIN (SELECT DISTINCT service, date FROM trips)", "JOIN (SELECT DISTINCT service, date FROM trips WHERE date BETWEEN DATE '1997-06-02' AND DATE '1997-07-27')") + ", scores AS (SELECT date, CASE WHEN isodow(date) BETWEEN 2 AND 4 THEN 'weekday' WHEN isodow(date) = 6 THEN 'saturday' END AS day_type, count(DISTINCT station) AS stations, sum(calls)::BIGINT AS calls FROM served JOIN regular USING (station) GROUP BY date), chosen AS (SELECT day_type, date, stations, calls FROM scores WHERE day_type IS NOT NULL QUALIFY row_number() OVER (PARTITION BY day_type ORDER BY stations DESC, calls DESC, date) = 1)"


@query(ad.sql(f"{_CHOSEN} SELECT * REPLACE (date::VARCHAR AS date) FROM chosen"))
def top1_choose_days(spark: SparkSession, sf: str) -> DataFrame:
    trips = ad.trips(spark, sf)
    return tt.choose_days(ad.calls(spark, sf), trips, trips.select("service", "date"), TODAY)


def _day_calls(spark: SparkSession, sf: str) -> DataFrame:
    trips = ad.trips(spark, sf)
    active = trips.withColumn("day_type", F.when(F.weekday("date") == 5, "saturday").otherwise("weekday"))
    return tt.day_timetable(ad.calls(spark, sf), active)


_DAY = "daily AS (SELECT CASE WHEN isodow(date) = 6 THEN 'saturday' ELSE 'weekday' END AS day_type, c.trip, seq, station, platform, arr, dep, coalesce(pickup_type, '0') <> '1' AND seq < max(seq) OVER w AS can_board, drop_off_type <> '1' AND seq > min(seq) OVER w AS can_alight FROM calls c JOIN trips USING (trip) WINDOW w AS (PARTITION BY c.trip))"


@query(ad.sql(f"{_DAY} SELECT day_type, trip, seq, station, platform, arr, dep, can_board, can_alight FROM daily"))
def join2_day_timetable(spark: SparkSession, sf: str) -> DataFrame:
    """JOIN-2, JOIN-3: every trip on its kind of day."""
    return _day_calls(spark, sf)


@query(ad.sql(f"{_CHOSEN} SELECT day_type, count(*) AS trips, count(DISTINCT agency) AS agencies FROM trips JOIN chosen USING (date) GROUP BY day_type"))
def join1_active_trips(spark: SparkSession, sf: str) -> DataFrame:
    trips = ad.trips(spark, sf)
    days = tt.choose_days(ad.calls(spark, sf), trips, trips.select("service", "date"), TODAY)
    return tt.active_trips(trips, days).groupBy("day_type").agg(F.count("*").alias("trips"), F.countDistinct("agency").alias("agencies"))


@query("SELECT printf('N%02d', s_nationkey) AS code, n_name AS name, (p % 50)::DOUBLE AS lat, (p % 7)::DOUBLE AS lon FROM (SELECT s_nationkey, min(s_suppkey) AS p FROM supplier GROUP BY 1) LEFT JOIN nation ON n_nationkey = s_nationkey")
def join4_station_dimension(spark: SparkSession, sf: str) -> DataFrame:
    s = ad.table(spark, sf, "supplier")
    stops = s.select(F.format_string("N%02d", "s_nationkey").alias("code"), F.col("s_suppkey").alias("parent"))
    parents = s.join(ad.stations(spark, sf), F.col("s_nationkey") == F.col("station"), "left").select(F.col("s_suppkey").alias("parent"), "name", (F.col("s_suppkey") % 50).cast("double").alias("lat"), (F.col("s_suppkey") % 7).cast("double").alias("lon"))
    return tt.station_dimension(stops, parents)


@query(ad.sql("SELECT a.trip AS from_trip, b.trip AS to_trip, a.station, a.platform AS from_platform, b.platform AS to_platform, CASE a.trip % 5 WHEN 0 THEN 'possible' WHEN 1 THEN 'guaranteed' WHEN 3 THEN 'impossible' ELSE 'other' END AS kind FROM calls a JOIN trips ta ON ta.trip = a.trip JOIN calls b ON b.station = a.station AND b.trip = a.trip + 7 JOIN trips tb ON tb.trip = b.trip"))
def join5_transfer_rules(spark: SparkSession, sf: str) -> DataFrame:
    calls, trips = ad.calls(spark, sf), ad.trips(spark, sf)
    a = calls.select(F.col("trip").alias("from_trip"), "station", F.col("platform").alias("from_stop"))
    b = calls.select((F.col("trip") - 7).alias("from_trip"), "station", F.col("trip").alias("to_trip"), F.col("platform").alias("to_stop"))
    rules = a.join(b, ["from_trip", "station"]).select("from_trip", "to_trip", "from_stop", "to_stop", (F.col("from_trip") % 5).cast("string").alias("type"))
    platforms = ad.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("stop"), F.col("s_nationkey").alias("station"), F.col("s_suppkey").alias("platform"))
    return tt.transfer_rules(rules, platforms, trips)


@query(ad.sql("n AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY trip) AS n_calls, lead(station) OVER w AS nx, lag(station) OVER w AS pv FROM calls WINDOW w AS (PARTITION BY trip ORDER BY seq)) SELECT a.trip, a.n_calls, a.station AS first_station, a.platform AS first_platform, a.dep AS first_dep, a.nx AS second_station, b.station AS last_station, b.platform AS last_platform, b.arr AS last_arr, b.pv AS before_last_station FROM n a JOIN n b ON a.trip = b.trip AND a.k = 1 AND b.k = b.n_calls"))
def win1_neighbour_calls(spark: SparkSession, sf: str) -> DataFrame:
    return tt.neighbour_calls(ad.calls(spark, sf))


@query(ad.sql("SELECT pattern, count(*) AS trips, max(stops) AS stops FROM (SELECT trip, string_agg(platform::VARCHAR, '-' ORDER BY seq) AS pattern, count(*) AS stops FROM calls GROUP BY trip) GROUP BY pattern"))
def route6_patterns(spark: SparkSession, sf: str) -> DataFrame:
    return tt.patterns(ad.calls(spark, sf))


@query(ad.sql(f"{_DAY} SELECT DISTINCT station, dep FROM daily WHERE can_board AND dep BETWEEN 540 AND 720"))
def route7_departures(spark: SparkSession, sf: str) -> DataFrame:
    return tt.departures(_day_calls(spark, sf), 540, 720)


@query(ad.sql("SELECT trip, seq, arr, arr + 1440 AS late FROM calls"))
def fn1_minutes(spark: SparkSession, sf: str) -> DataFrame:
    x = ad.calls(spark, sf).select("trip", "seq", ad.clock(F.col("arr")).alias("a"), ad.clock(F.col("arr") + 1440).alias("b"))
    return x.select("trip", "seq", scalars.minutes(F.col("a")).alias("arr"), scalars.minutes(F.col("b")).alias("late"))


@query("""WITH d AS (SELECT DISTINCT o_orderdate::DATE AS date FROM orders), c AS (SELECT y, make_date(y, 12, 1) + ((6 - isodow(make_date(y, 12, 1)) + 7) % 7)::INT + 8 AS ch FROM range(1990, 2010) r(y))
SELECT d.date::VARCHAR AS date, min(ch)::DATE::VARCHAR AS change, year(min(ch))::INT AS timetable, CASE WHEN isodow(d.date) < 6 THEN 'weekday' WHEN isodow(d.date) = 6 THEN 'saturday' END AS kind FROM d JOIN c ON ch > d.date GROUP BY d.date""")
def fn2_fn3_timetable_years(spark: SparkSession, sf: str) -> DataFrame:
    d = ad.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    day = F.col("date")
    return d.select("date", scalars.timetable_change(day).alias("change"), scalars.timetable_year(day).alias("timetable"), scalars.day_kind(day).alias("kind"))
