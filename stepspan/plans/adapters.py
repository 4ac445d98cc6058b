"""The driver's tables as the library's model: calls, trips, dates, stations, conditions, marks.

Each adapter has its SQL twin in CTES, which the oracles build on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clock(minutes: Column) -> Column:
    """Minutes after midnight as HH:MM:SS; hours may pass 23."""
    return F.format_string("%02d:%02d:00", F.floor(minutes / 60), minutes % 60)


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trip, seq, platform, station, arr, dep, pickup_type, drop_off_type. A key of lineitem repeats; its least row counts."""
    first = F.min(F.struct("l_partkey", "l_suppkey"))
    one = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("trip"), F.col("l_linenumber").alias("seq")).agg(first.alias("x"))
    one = one.select("trip", "seq", F.col("x.l_partkey").alias("p"), F.col("x.l_suppkey").alias("platform"))
    order = W.partitionBy("trip").orderBy("seq")
    waits = F.coalesce(F.sum(F.col("p") % 3).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # at the stops before
    one = one.withColumn("arr", (480 + F.col("trip") % 240 + F.sum(1 + F.col("p") % 20).over(order) + waits).cast("int"))
    places = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("platform"), F.col("s_nationkey").alias("station"))
    return one.join(places, "platform").select(
        "trip", "seq", "platform", "station", "arr",
        (F.col("arr") + F.col("p") % 3).cast("int").alias("dep"),
        F.when(F.col("p") % 11 == 0, "1").when(F.col("p") % 7 == 0, F.lit(None)).otherwise("0").alias("pickup_type"),
        F.when(F.col("p") % 13 == 0, "1").otherwise("0").alias("drop_off_type"),
    )


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trip, service, agency, category, route_type, train_number, date."""
    agency = F.when(F.col("c_acctbal") < 0, F.lit(None)).otherwise(F.col("c_mktsegment"))
    who = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("service"), agency.alias("agency"))
    kinds = F.array(*[F.lit(k) for k in ("2", "100", "117", "3", "700", "109")])
    return (
        table(spark, sf_dir, "orders")
        .select(F.col("o_orderkey").alias("trip"), F.col("o_custkey").alias("service"), F.col("o_orderpriority").alias("category"), F.to_date("o_orderdate").alias("date"))
        .join(who, "service", "left")
        .select("trip", "service", "agency", "category", F.element_at(kinds, (F.col("trip") % 6 + 1).cast("int")).alias("route_type"), (F.col("trip") % 1000).cast("string").alias("train_number"), "date")
    )


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """station, code, name, region, x, y: positions are made from the keys."""
    n = table(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").alias("station"), F.format_string("N%02d", "n_nationkey").alias("code"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))


def conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, lift, status, start, end, received: one row per message about a lift."""
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "error", "notAvailable").when(F.col("event_type") == "signup", "unknown").otherwise("available")
    start = F.col("ts").cast("timestamp")
    end = F.when(F.col("event_id") % 3 == 0, F.timestamp_seconds(F.unix_seconds(start) + 60 * F.floor("value")))
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("lift"), status.alias("status"), start.alias("start"), end.alias("end"))


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, train, mark: N for a train seen without, J with accessible stock."""
    e = table(spark, sf_dir, "events")
    return e.select(F.to_date("ts").alias("date"), F.col("user_id").alias("train"), F.when(F.col("event_type") == "error", "N").otherwise("J").alias("mark"))


CTES = """
one AS (
  SELECT l_orderkey AS trip, l_linenumber AS seq, l_partkey AS p, l_suppkey AS platform FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) = 1
), timed AS (
  SELECT *, (480 + trip % 240 + sum(1 + p % 20 + p % 3) OVER (PARTITION BY trip ORDER BY seq) - p % 3)::INT AS arr FROM one
), calls AS (
  SELECT trip, seq, platform, s_nationkey AS station, arr, (arr + p % 3)::INT AS dep,
         CASE WHEN p % 11 = 0 THEN '1' WHEN p % 7 = 0 THEN NULL ELSE '0' END AS pickup_type,
         CASE WHEN p % 13 = 0 THEN '1' ELSE '0' END AS drop_off_type
  FROM timed JOIN supplier ON s_suppkey = platform
), trips AS (
  SELECT o_orderkey AS trip, o_custkey AS service, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_mktsegment END AS agency, o_orderpriority AS category,
         ['2', '100', '117', '3', '700', '109'][o_orderkey % 6 + 1] AS route_type, (o_orderkey % 1000)::VARCHAR AS train_number, o_orderdate::DATE AS date
  FROM orders LEFT JOIN customer ON c_custkey = o_custkey
), stations AS (
  SELECT n_nationkey AS station, printf('N%02d', n_nationkey) AS code, n_name AS name, n_regionkey AS region FROM nation
), conditions AS (
  SELECT event_id AS id, user_id AS lift, CASE event_type WHEN 'error' THEN 'notAvailable' WHEN 'signup' THEN 'unknown' ELSE 'available' END AS status, ts AS start,
         CASE WHEN event_id % 3 = 0 THEN make_timestamp((epoch_us(ts) // 1000000 + 60 * floor(value)::BIGINT) * 1000000) END AS "end"
  FROM events
), marks AS (
  SELECT ts::DATE AS date, user_id AS train, CASE WHEN event_type = 'error' THEN 'N' ELSE 'J' END AS mark FROM events
)
"""


def sql(text: str) -> str:
    """An oracle on top of the model's CTES: text goes on with further CTES or SELECT."""
    text = text.strip()
    return f"WITH {CTES}{', ' if not text.upper().startswith('SELECT') else ''}{text}"
