"""Accessibility queries on the driver's tables: suppliers stand for platforms, nations for stations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import access
from . import adapters as ad
from .registry import query

# Statuses made from the keys, in both languages alike.
_TRACKS = "tracks AS (SELECT s_nationkey AS station, s_suppkey AS track, CASE s_suppkey % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'yes' WHEN 2 THEN 'no' ELSE 'unknown' END AS status, floor(s_acctbal) AS bal FROM supplier)"


def _tracks(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("s_suppkey") % 4
    return ad.table(spark, sf, "supplier").select(F.col("s_nationkey").alias("station"), F.col("s_suppkey").alias("track"), F.when(s <= 1, "yes").when(s == 2, "no").otherwise("unknown").alias("status"), F.floor("s_acctbal").alias("bal"))


_COUNTS = "counts AS (SELECT station, count(*) FILTER (status = 'yes') AS y, count(*) FILTER (status = 'no') AS n, count(*) AS total FROM tracks GROUP BY station)"


@query(f"WITH {_TRACKS}, {_COUNTS} SELECT station, y, n, total, CASE WHEN total = 0 THEN 'unknown' WHEN y = total THEN 'yes' WHEN n = total THEN 'no' WHEN y = 0 THEN 'unknown' ELSE 'partial' END AS status, CASE WHEN y = total THEN 'yes' WHEN y = 0 THEN 'no' ELSE 'partial' END AS height FROM counts")
def prj6_agg7_status_of_counts(spark: SparkSession, sf: str) -> DataFrame:
    """PRJ-6, AGG-7."""
    x = _tracks(spark, sf).groupBy("station").agg(F.count_if(F.col("status") == "yes").alias("y"), F.count_if(F.col("status") == "no").alias("n"), F.count("*").alias("total"))
    return x.select("*", scalars.status_of_counts(F.col("y"), F.col("n"), F.col("total")).alias("status"), scalars.status_of_height(F.col("y"), F.col("total")).alias("height"))


@query(f"WITH {_TRACKS} SELECT station, CASE WHEN bool_and(status = 'yes') THEN 'yes' WHEN bool_or(status = 'yes') THEN 'partial' WHEN bool_and(status = 'no') THEN 'no' ELSE 'unknown' END AS status FROM tracks GROUP BY station")
def prj7_station_status(spark: SparkSession, sf: str) -> DataFrame:
    return access.station_status(_tracks(spark, sf))


_ASSETS = "lifts AS (SELECT s_nationkey AS code, count(*) AS n_lifts FROM supplier WHERE s_suppkey % 3 = 0 AND s_nationkey % 4 <> 0 GROUP BY 1), ramps AS (SELECT s_nationkey AS code, count(*) AS n_ramps FROM supplier WHERE s_suppkey % 3 = 1 AND s_nationkey % 5 <> 0 GROUP BY 1), assets AS (SELECT coalesce(lifts.code, ramps.code) AS code, coalesce(n_lifts, 0) AS n_lifts, coalesce(n_ramps, 0) AS n_ramps FROM lifts FULL JOIN ramps ON lifts.code = ramps.code)"


def _assets(spark: SparkSession, sf: str) -> DataFrame:
    s = ad.table(spark, sf, "supplier").select(F.col("s_nationkey").alias("code"), "s_suppkey")
    return access.assets(s.filter("s_suppkey % 3 = 0 AND code % 4 <> 0").groupBy("code").agg(F.count("*").alias("n_lifts")), s.filter("s_suppkey % 3 = 1 AND code % 5 <> 0").groupBy("code").agg(F.count("*").alias("n_ramps")))


@query(f"WITH {_ASSETS} SELECT * FROM assets")
def join7_assets(spark: SparkSession, sf: str) -> DataFrame:
    return _assets(spark, sf)


@query(f"WITH {_TRACKS}, {_ASSETS}, st AS (SELECT station AS code, CASE WHEN bool_or(status = 'yes') THEN 'yes' ELSE 'no' END AS first_status FROM tracks GROUP BY 1), cu AS (SELECT c_nationkey AS code, CASE WHEN avg(c_acctbal) < 4400 THEN 'no' ELSE 'yes' END AS second_status FROM customer WHERE c_nationkey % 6 <> 0 GROUP BY 1), m AS (SELECT n_nationkey AS code, n_name AS name, coalesce(first_status, 'unknown') AS first_status, coalesce(second_status, 'unknown') AS second_status, n_lifts, n_ramps FROM nation LEFT JOIN st ON st.code = n_nationkey LEFT JOIN cu ON cu.code = n_nationkey LEFT JOIN assets ON assets.code = n_nationkey) SELECT code, name, first_status, second_status, CASE WHEN first_status = 'yes' AND second_status = 'no' AND (coalesce(n_lifts, 0) + coalesce(n_ramps, 0) = 0 OR code % 3 = 0) THEN 'unknown' ELSE first_status END AS status, CASE WHEN first_status = 'yes' AND second_status = 'no' AND code % 3 = 0 THEN 'lift is a project' WHEN first_status = 'yes' AND second_status = 'no' AND coalesce(n_lifts, 0) + coalesce(n_ramps, 0) = 0 THEN 'no lift or ramp known' ELSE 'primary source' END AS reason FROM m")
def join6_prj8_master_table(spark: SparkSession, sf: str) -> DataFrame:
    """JOIN-6, PRJ-8."""
    base = ad.table(spark, sf, "nation").select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("name"))
    first = _tracks(spark, sf).groupBy(F.col("station").alias("code")).agg(F.when(F.bool_or(F.col("status") == "yes"), "yes").otherwise("no").alias("first_status"))
    second = ad.table(spark, sf, "customer").filter("c_nationkey % 6 <> 0").groupBy(F.col("c_nationkey").alias("code")).agg(F.when(F.avg("c_acctbal") < 4400, "no").otherwise("yes").alias("second_status"))
    m = access.master_table(base, {"first": first, "second": second, "assets": _assets(spark, sf)}, ("first_status", "second_status"))
    status, reason = access.recommended(F.col("first_status"), [F.col("second_status")], F.col("n_lifts"), F.col("n_ramps"), F.col("code") % 3 == 0)
    return m.select("code", "name", "first_status", "second_status", status.alias("status"), reason.alias("reason"))


@query("WITH c AS (SELECT p_partkey AS code, lower(p_brand) AS k1, lower(p_type) AS k2, lower(p_name) AS k3 FROM part), n AS (SELECT key, min(row) AS row FROM (SELECT lower(p_brand) AS key, p_partkey AS row FROM part WHERE p_size = 7 UNION ALL SELECT lower(p_type), p_partkey FROM part WHERE p_size < 9 UNION ALL SELECT lower(p_name), p_partkey FROM part) GROUP BY key), t AS (SELECT code, 0 AS level, row FROM c JOIN n ON n.key = k1 UNION ALL SELECT code, 1, row FROM c JOIN n ON n.key = k2 UNION ALL SELECT code, 2, row FROM c JOIN n ON n.key = k3) SELECT code, level, row FROM t QUALIFY row_number() OVER (PARTITION BY code ORDER BY level, row) = 1")
def join8_match_names(spark: SparkSession, sf: str) -> DataFrame:
    p = ad.table(spark, sf, "part")
    codes = p.select(F.col("p_partkey").alias("code"), F.lower("p_brand").alias("k1"), F.lower("p_type").alias("k2"), F.lower("p_name").alias("k3"))
    row = F.col("p_partkey").alias("row")
    named = p.filter("p_size = 7").select(F.lower("p_brand").alias("key"), row).unionByName(p.filter("p_size < 9").select(F.lower("p_type").alias("key"), row)).unionByName(p.select(F.lower("p_name").alias("key"), row))
    return access.match_names(codes, named.groupBy("key").agg(F.min("row").alias("row")), ["k1", "k2", "k3"])


@query("WITH a AS (SELECT c_custkey AS id, 50 + (c_custkey % 997) * 0.0005 AS lat, 5 + (c_custkey % 499) * 0.001 AS lon FROM customer), b AS (SELECT s_suppkey AS other, 50 + (s_suppkey % 89) * 0.005 AS lat, 5 + (s_suppkey % 83) * 0.006 AS lon FROM supplier) SELECT id, count(*) AS n FROM a JOIN b ON ((a.lat - b.lat) * 111320.0) * ((a.lat - b.lat) * 111320.0) + ((a.lon - b.lon) * 68000.0) * ((a.lon - b.lon) * 68000.0) < 250.0 * 250.0 GROUP BY id")
def join9_near_points(spark: SparkSession, sf: str) -> DataFrame:
    a = ad.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), (50 + F.col("c_custkey") % 997 * 0.0005).alias("lat"), (5 + F.col("c_custkey") % 499 * 0.001).alias("lon"))
    b = ad.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("other"), (50 + F.col("s_suppkey") % 89 * 0.005).alias("lat"), (5 + F.col("s_suppkey") % 83 * 0.006).alias("lon"))
    return access.near_points(a, b, 250.0).groupBy("id").agg(F.count("*").alias("n"))


_STOPS = "stops AS (SELECT station, platform, coalesce(string_agg(DISTINCT agency, '|' ORDER BY agency), '') AS operators, count(DISTINCT trip) AS trips FROM calls JOIN trips USING (trip) GROUP BY ALL)"


@query(ad.sql(f"{_STOPS} SELECT * FROM stops"))
def agg5_operators_per_stop(spark: SparkSession, sf: str) -> DataFrame:
    return access.operators_per_stop(ad.calls(spark, sf), ad.trips(spark, sf))


@query(ad.sql("SELECT station, coalesce(string_agg(DISTINCT agency, '|' ORDER BY agency), '') AS operators, (SELECT sum(t) FROM (SELECT platform, count(DISTINCT c2.trip) AS t FROM calls c2 JOIN trips t2 USING (trip) WHERE c2.station = c.station GROUP BY platform))::BIGINT AS trips, count(DISTINCT platform) AS platforms FROM calls c JOIN trips USING (trip) GROUP BY station"))
def agg6_roll_up(spark: SparkSession, sf: str) -> DataFrame:
    return access.roll_up(access.operators_per_stop(ad.calls(spark, sf), ad.trips(spark, sf)))


@query(f"WITH {_TRACKS} SELECT station, count(DISTINCT coalesce(CASE WHEN status <> 'unknown' THEN status END, '?')) AS n_values FROM tracks GROUP BY station HAVING count(DISTINCT coalesce(CASE WHEN status <> 'unknown' THEN status END, '?')) > 1")
def agg8_disagreeing(spark: SparkSession, sf: str) -> DataFrame:
    return access.disagreeing(_tracks(spark, sf).withColumn("status", F.nullif("status", F.lit("unknown"))), "station", "status")


@query("SELECT c_nationkey AS code, min(c_acctbal) FILTER (c_acctbal >= 0) AS lowest, max(c_acctbal) AS highest, arg_min(c_mktsegment, c_custkey) FILTER (c_mktsegment <> 'BUILDING') AS segment, count(*) AS n FROM customer GROUP BY 1")
def agg9_collapse(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-9: one row a key: best value, first non-null by order, count."""
    c = ad.table(spark, sf, "customer")
    segment = F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment"))
    return c.groupBy(F.col("c_nationkey").alias("code")).agg(F.min(F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal"))).alias("lowest"), F.max("c_acctbal").alias("highest"), F.min_by(segment, F.when(segment.isNotNull(), F.col("c_custkey"))).alias("segment"), F.count("*").alias("n"))


_QUAYS = "quays AS (SELECT s_suppkey AS id, s_nationkey AS station, CASE s_suppkey % 3 WHEN 0 THEN 'island' WHEN 1 THEN 'track' ELSE 'sector' END AS type, CASE WHEN s_suppkey % 3 > 0 AND s_suppkey % 7 > 0 THEN s_suppkey - 1 END AS parent FROM supplier)"


def _quays(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    return ad.table(spark, sf, "supplier").select(k.alias("id"), F.col("s_nationkey").alias("station"), F.when(k % 3 == 0, "island").when(k % 3 == 1, "track").otherwise("sector").alias("type"), F.when((k % 3 > 0) & (k % 7 > 0), k - 1).alias("parent"))


@query(f"WITH {_QUAYS} SELECT q.id, CASE WHEN q.type = 'island' THEN q.id WHEN p.type = 'island' THEN p.id WHEN g.type = 'island' THEN g.id WHEN q.type = 'sector' AND q.parent IS NOT NULL THEN q.parent ELSE q.id END AS surface FROM quays q LEFT JOIN quays p ON p.id = q.parent LEFT JOIN quays g ON g.id = p.parent")
def graph4_surfaces(spark: SparkSession, sf: str) -> DataFrame:
    return access.surfaces(_quays(spark, sf).select("id", "type", "parent"))


_QUAY_COUNTS = f"""
WITH {_QUAYS},
free AS (SELECT s_suppkey AS id, ['true', 'false', 'partial', NULL][s_suppkey // 3 % 4 + 1] AS step_free FROM supplier),
main AS (SELECT * FROM quays JOIN free USING (id) WHERE type = 'track' OR type = 'sector' AND parent IS NULL),
tracks AS (
    SELECT station, count(*) AS main_tracks, count(*) FILTER (step_free = 'true') AS yes, count(*) FILTER (step_free = 'false') AS no
    FROM main GROUP BY station
),
whole AS (
    SELECT station, count(*) FILTER (type = 'island') AS islands, count(*) FILTER (parent IS NULL) AS roots, count(*) AS quays
    FROM quays GROUP BY station
),
kinds AS (
    SELECT p_partkey % 27 AS station, count(*) FILTER (p_size % 4 = 0) AS lifts, count(*) FILTER (p_size % 4 = 1) AS ramps,
        count(*) FILTER (p_size % 4 = 2) AS escalators
    FROM part GROUP BY ALL
),
paths AS (
    SELECT s_nationkey AS station, count(*) AS links FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_linenumber = 1 AND s_nationkey % 8 <> 3
    GROUP BY ALL
)
SELECT station, coalesce(main_tracks, 0) AS main_tracks, coalesce(yes, 0) AS step_free_true, coalesce(no, 0) AS step_free_false,
    coalesce(main_tracks - yes - no, 0) AS step_free_unknown, islands, roots, quays, coalesce(lifts, 0) AS lifts,
    coalesce(ramps, 0) AS ramps, coalesce(escalators, 0) AS escalators, coalesce(links, 0) AS links
FROM whole LEFT JOIN tracks USING (station) LEFT JOIN kinds USING (station) LEFT JOIN paths USING (station)
"""


@query(_QUAY_COUNTS)
def agg10_quay_counts(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-10."""
    k, size = F.col("s_suppkey"), F.col("p_size") % 4
    words = F.array(F.lit("true"), F.lit("false"), F.lit("partial"), F.lit(None))
    free = ad.table(spark, sf, "supplier").select(k.alias("id"), F.element_at(words, (F.floor(k / 3) % 4 + 1).cast("int")).alias("step_free"))
    kind = F.when(size == 0, "lift").when(size == 1, "ramp").when(size == 2, "escalator")
    equipment = ad.table(spark, sf, "part").select((F.col("p_partkey") % 27).alias("station"), kind.alias("kind"))
    links = ad.table(spark, sf, "lineitem").filter("l_linenumber = 1").join(ad.table(spark, sf, "supplier"), k == F.col("l_suppkey"))
    links = links.filter("s_nationkey % 8 <> 3").select(F.col("s_nationkey").alias("station"))
    return access.quay_counts(_quays(spark, sf).join(free, "id"), equipment, links)


@query("WITH refs AS (SELECT DISTINCT l_partkey AS lift, l_suppkey AS quay FROM lineitem), islands AS (SELECT s_suppkey - 1 AS quay, s_suppkey AS track FROM supplier WHERE s_suppkey % 3 = 1 UNION ALL SELECT s_suppkey - 2, s_suppkey FROM supplier WHERE s_suppkey % 3 = 2) SELECT lift, string_agg(t::VARCHAR, ',' ORDER BY t) AS tracks FROM (SELECT DISTINCT lift, coalesce(track, r.quay) AS t FROM refs r LEFT JOIN islands i ON i.quay = r.quay) GROUP BY lift")
def agg11_served_tracks(spark: SparkSession, sf: str) -> DataFrame:
    refs = ad.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("lift"), F.col("l_suppkey").alias("quay")).distinct()
    s, k = ad.table(spark, sf, "supplier"), F.col("s_suppkey")
    islands = s.filter("s_suppkey % 3 > 0").select((k - k % 3).alias("quay"), k.alias("track"))
    return access.served_tracks(refs, islands)


@query("WITH used AS (SELECT DISTINCT s_nationkey AS station, s_suppkey::VARCHAR || CASE s_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'A' ELSE 'b' END AS platform FROM supplier), known AS (SELECT s_nationkey AS station, CASE WHEN s_suppkey % 6 = 1 THEN s_suppkey::VARCHAR || 'a' ELSE s_suppkey::VARCHAR END AS code, CASE s_suppkey % 2 WHEN 0 THEN 'yes' ELSE 'no' END AS status FROM supplier WHERE s_suppkey % 5 <> 4 UNION ALL SELECT s_nationkey, s_suppkey::VARCHAR, CASE WHEN s_suppkey % 20 = 4 THEN 'unknown' ELSE 'yes' END FROM supplier WHERE s_suppkey % 10 = 4) SELECT u.station, u.platform, coalesce(a.code, b.code) AS matched, CASE WHEN a.code IS NOT NULL THEN a.status ELSE b.status END AS status FROM used u LEFT JOIN known a ON a.station = u.station AND a.code = lower(u.platform) LEFT JOIN known b ON b.station = u.station AND b.code = regexp_replace(lower(u.platform), '[a-z]$', '')")
def join15_platform_record(spark: SparkSession, sf: str) -> DataFrame:
    used, known, islands = _used(spark, sf)
    return access.platform_record(used, known, islands)


def _used(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Platforms used, tracks known, and islands: an island has its tracks' status if they agree, else unknown."""
    s, k = ad.table(spark, sf, "supplier"), F.col("s_suppkey")
    used = s.select(F.col("s_nationkey").alias("station"), F.concat(k.cast("string"), F.when(k % 3 == 0, "").when(k % 3 == 1, "A").otherwise("b")).alias("platform")).distinct()
    known = s.filter("s_suppkey % 5 <> 4").select(F.col("s_nationkey").alias("station"), F.when(k % 6 == 1, F.concat(k.cast("string"), F.lit("a"))).otherwise(k.cast("string")).alias("code"), F.when(k % 2 == 0, "yes").otherwise("no").alias("status"))
    pair = s.filter("s_suppkey % 10 = 4").select(F.col("s_nationkey").alias("station"), k.cast("string").alias("code"), F.explode(F.array(F.lit("yes"), F.when(k % 20 == 4, "no").otherwise("yes"))).alias("status"))
    islands = pair.groupBy("station", "code").agg(F.when(F.countDistinct("status") == 1, F.min("status")).otherwise("unknown").alias("status"))
    return used, known, islands


@query("WITH used AS (SELECT DISTINCT s_suppkey % 2 AS variant, s_nationkey AS station, s_suppkey::VARCHAR || CASE s_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'A' ELSE 'b' END AS platform FROM supplier), known AS (SELECT s_nationkey AS station, CASE WHEN s_suppkey % 6 = 1 THEN s_suppkey::VARCHAR || 'a' ELSE s_suppkey::VARCHAR END AS code, CASE s_suppkey % 2 WHEN 0 THEN 'yes' ELSE 'no' END AS status FROM supplier WHERE s_suppkey % 5 <> 4 UNION ALL SELECT s_nationkey, s_suppkey::VARCHAR, CASE WHEN s_suppkey % 20 = 4 THEN 'unknown' ELSE 'yes' END FROM supplier WHERE s_suppkey % 10 = 4), n AS (SELECT variant, station, count(*) AS k FROM used GROUP BY ALL) SELECT u.variant, u.station, u.platform, CASE WHEN a.code IS NOT NULL THEN a.status WHEN b.code IS NOT NULL THEN b.status WHEN u.station % 2 = 0 AND n.k <= 3 + u.station % 7 THEN 'yes' ELSE 'unknown' END AS status FROM used u JOIN n USING (variant, station) LEFT JOIN known a ON a.station = u.station AND a.code = lower(u.platform) LEFT JOIN known b ON b.station = u.station AND b.code = regexp_replace(lower(u.platform), '[a-z]$', '')")
def join16_platform_status(spark: SparkSession, sf: str) -> DataFrame:
    used, known, islands = _used(spark, sf)
    variants = used.withColumn("variant", F.regexp_extract("platform", r"\d+", 0).cast("long") % 2)
    n = ad.table(spark, sf, "nation").select(F.col("n_nationkey").alias("station"), F.when(F.col("n_nationkey") % 2 == 0, "yes").otherwise("partial").alias("status"), (3 + F.col("n_nationkey") % 7).alias("main_tracks"))
    return access.platform_status(variants, access.platform_record(used, known, islands), n)


_FIXES = "fixes AS (SELECT c_nationkey AS station, CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 1000 END AS track, CASE c_custkey % 5 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN 'maybe' ELSE 'unknown' END AS status, c_custkey AS line FROM customer)"


def _fixes(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    status = F.when(k % 5 == 0, "yes").when(k % 5 == 1, "no").when(k % 5 == 2, "maybe").otherwise("unknown")
    return ad.table(spark, sf, "customer").select(F.col("c_nationkey").alias("station"), F.when(k % 3 > 0, k % 1000).alias("track"), status.alias("status"), k.alias("line"))


@query(f"WITH {_TRACKS}, {_FIXES}, hits AS (SELECT t.station, t.track, f.status AS new, f.line FROM tracks t JOIN fixes f ON f.station = t.station AND (f.track IS NULL OR f.track = t.track)), best AS (SELECT station, track, arg_max(new, line) AS new, count(*) AS notes FROM hits GROUP BY ALL) SELECT t.station, t.track, coalesce(new, status) AS status, CASE WHEN new IS NULL THEN 'source' ELSE 'correction' END AS origin, coalesce(notes, 0) AS notes FROM tracks t LEFT JOIN best b ON b.station = t.station AND b.track = t.track")
def join19_corrections(spark: SparkSession, sf: str) -> DataFrame:
    return access.corrected(_tracks(spark, sf).select("station", "track", "status"), _fixes(spark, sf))


@query(f"WITH {_TRACKS}, {_FIXES} SELECT * FROM fixes f WHERE status NOT IN ('yes', 'partial', 'no', 'unknown') OR track IS NOT NULL AND NOT EXISTS (FROM tracks t WHERE t.station = f.station AND t.track = f.track) OR track IS NULL AND NOT EXISTS (FROM tracks t WHERE t.station = f.station)")
def dq5_bad_corrections(spark: SparkSession, sf: str) -> DataFrame:
    return access.bad_corrections(_tracks(spark, sf), _fixes(spark, sf))


@query(f"WITH {_TRACKS}, a AS (SELECT station AS code, CASE WHEN bool_and(status = 'yes') THEN 'yes' WHEN bool_or(status = 'yes') THEN 'partial' WHEN bool_and(status = 'no') THEN 'no' ELSE 'unknown' END AS status FROM tracks GROUP BY 1), b AS (SELECT c_nationkey AS code, CASE WHEN avg(c_acctbal) < 4400 THEN 'no' ELSE 'partial' END AS status FROM customer GROUP BY 1) SELECT a.status AS a, b.status AS b, count(*) AS n, a.status = b.status AS same FROM a JOIN b USING (code) GROUP BY ALL")
def agg20_agreement(spark: SparkSession, sf: str) -> DataFrame:
    a = access.station_status(_tracks(spark, sf)).withColumnRenamed("station", "code")
    b = ad.table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("code")).agg(F.when(F.avg("c_acctbal") < 4400, "no").otherwise("partial").alias("status"))
    return access.agreement(a, b)


@query("WITH lines AS (SELECT md5(concat_ws('|', c_custkey::VARCHAR, c_mktsegment, c_name, c_nationkey::VARCHAR)) AS h FROM customer) SELECT count(*) AS n, md5(concat_ws(',', sum(('0x' || substr(h, 1, 8))::BIGINT)::VARCHAR, sum(('0x' || substr(h, 9, 8))::BIGINT)::VARCHAR, sum(('0x' || substr(h, 17, 8))::BIGINT)::VARCHAR, sum(('0x' || substr(h, 25, 8))::BIGINT)::VARCHAR)) AS digest FROM lines")
def agg21_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return access.fingerprint(ad.table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_name", "c_nationkey"))


@query("SELECT coalesce(a.k, b.k) AS name, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'changed' END AS change FROM (SELECT o_custkey AS k, md5(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey)) AS d FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1) a FULL JOIN (SELECT o_custkey AS k, md5(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey)) AS d FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1) b ON a.k = b.k WHERE a.d IS DISTINCT FROM b.d")
def agg21_manifest_diff(spark: SparkSession, sf: str) -> DataFrame:
    o = ad.table(spark, sf, "orders")

    def manifest(status: str) -> DataFrame:
        keys = F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda k: k.cast("string")), ",")
        return o.filter(F.col("o_orderstatus") != status).groupBy(F.col("o_custkey").alias("name")).agg(F.md5(keys).alias("digest"))

    return access.manifest_diff(manifest("F"), manifest("P"))


_EDGES = f"""{_QUAYS}, e1 AS (
  SELECT station, id::VARCHAR AS a, parent::VARCHAR AS b FROM quays WHERE parent IS NOT NULL
  UNION SELECT s_nationkey, s_suppkey::VARCHAR, 'item:' || (s_suppkey % 10)::VARCHAR FROM supplier WHERE s_suppkey % 4 < 3 AND s_suppkey % 6 <> 5
  UNION SELECT s_nationkey, s_suppkey::VARCHAR, (s_suppkey + 25)::VARCHAR FROM supplier WHERE s_suppkey % 2 = 0
), edges AS (SELECT station, a, b FROM e1 UNION SELECT station, b, a FROM e1)"""


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    s, k = ad.table(spark, sf, "supplier"), F.col("s_suppkey")
    quays = _quays(spark, sf).select("station", F.col("id").cast("string").alias("node"), F.col("parent").cast("string").alias("parent"))
    kind = F.element_at(F.array(*map(F.lit, ("entrance", "quay", "space", "other"))), (k % 4 + 1).cast("int"))
    gear = s.select(F.col("s_nationkey").alias("station"), k.cast("string").alias("node"), kind.alias("kind"), (k % 10).alias("item"), F.when(k % 6 == 5, "escalator").otherwise("lift").alias("item_kind"))
    links = s.filter("s_suppkey % 2 = 0").select(F.col("s_nationkey").alias("station"), k.cast("string").alias("a"), (k + 25).cast("string").alias("b"))
    return access.station_edges(quays, gear, links)


@query(f"WITH {_EDGES} SELECT * FROM edges")
def graph1_station_edges(spark: SparkSession, sf: str) -> DataFrame:
    return _edges(spark, sf)


def _roots(spark: SparkSession, sf: str) -> DataFrame:
    return ad.table(spark, sf, "supplier").filter("s_suppkey % 8 = 0").select(F.col("s_nationkey").alias("station"), F.col("s_suppkey").cast("string").alias("node"))


_REACHED = f"RECURSIVE {_EDGES}, reached AS (SELECT s_nationkey AS station, s_suppkey::VARCHAR AS node FROM supplier WHERE s_suppkey % 8 = 0 UNION SELECT e.station, e.b FROM edges e JOIN reached r ON r.station = e.station AND r.node = e.a)"


@query(f"WITH {_REACHED} SELECT * FROM reached")
def graph2_reachable_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return access.reachable_nodes(_edges(spark, sf), _roots(spark, sf))


_SETS = f"""
WITH RECURSIVE {_EDGES}, roots AS (
  SELECT s_nationkey AS station, s_suppkey::VARCHAR AS node, CASE s_suppkey % 8 WHEN 0 THEN 'entrance' ELSE 'hall' END AS kind FROM supplier WHERE s_suppkey % 8 IN (0, 3)
), reached AS (
  SELECT station, node, kind FROM roots UNION SELECT e.station, e.b, r.kind FROM edges e JOIN reached r ON r.station = e.station AND r.node = e.a
), t AS (
  SELECT s_nationkey AS station, s_suppkey::VARCHAR AS node,
         EXISTS (SELECT 1 FROM reached r WHERE r.station = s_nationkey AND r.node = s_suppkey::VARCHAR AND r.kind = 'entrance') AS strict,
         EXISTS (SELECT 1 FROM reached r WHERE r.station = s_nationkey AND r.node = s_suppkey::VARCHAR) AS loose
  FROM supplier WHERE s_suppkey % 3 = 1
)
SELECT station, count(*) AS tracks, count(*) FILTER (strict) AS connected, count(*) FILTER (loose) AS connected_via_hall,
       coalesce(string_agg(node, '|' ORDER BY node) FILTER (NOT loose), '') AS unconnected
FROM t GROUP BY station
"""


@query(_SETS)
def graph2_root_sets(spark: SparkSession, sf: str) -> DataFrame:
    """GRAPH-2: tracks reached from entrances, and from entrances or halls, in one run; and those that neither reaches."""
    k = F.col("s_suppkey")
    s = ad.table(spark, sf, "supplier").select(F.col("s_nationkey").alias("station"), k.cast("string").alias("node"), k.alias("k"))
    roots = s.filter("k % 8 IN (0, 3)").select("station", "node", F.when(F.col("k") % 8 == 0, "entrance").otherwise("hall").alias("kind"))
    x = s.filter("k % 3 = 1").join(access.reachable_sets(_edges(spark, sf), roots), ["station", "node"], "left")
    out = F.array_sort(F.collect_list(F.when(F.col("kinds").isNull(), F.col("node"))))
    strict = F.coalesce(F.array_contains("kinds", "entrance"), F.lit(False))
    return x.groupBy("station").agg(F.count("*").alias("tracks"), F.count_if(strict).alias("connected"), F.count("kinds").alias("connected_via_hall"), F.array_join(out, "|").alias("unconnected"))


@query(f"WITH {_REACHED}, t AS (SELECT s_nationkey AS station, count(*) AS n, count(r.node) AS k FROM supplier s LEFT JOIN reached r ON r.station = s_nationkey AND r.node = s_suppkey::VARCHAR WHERE s_suppkey % 3 = 1 GROUP BY 1) SELECT CASE WHEN t.station NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 8 = 0) THEN 'not modelled' WHEN k = n THEN 'all' WHEN k = 0 THEN 'none' ELSE 'some' END AS class, count(*) AS stations, sum(n)::BIGINT AS tracks FROM t GROUP BY 1")
def graph3_connection_class(spark: SparkSession, sf: str) -> DataFrame:
    tracks = ad.table(spark, sf, "supplier").filter("s_suppkey % 3 = 1").select(F.col("s_nationkey").alias("station"), F.col("s_suppkey").cast("string").alias("node"))
    roots = _roots(spark, sf)
    x = access.connection_class(tracks, access.reachable_nodes(_edges(spark, sf), roots), roots)
    return x.groupBy("class").agg(F.count("*").alias("stations"), F.sum("n").alias("tracks"))


@query("SELECT p_partkey AS code, trim(regexp_replace(lower(strip_accents(p_name)), '[^a-z0-9]+', ' ', 'g')) AS key FROM part")
def fn5_name_keys(spark: SparkSession, sf: str) -> DataFrame:
    return ad.table(spark, sf, "part").select(F.col("p_partkey").alias("code"), scalars.name_key(F.col("p_name")).alias("key"))


@query("WITH s AS (SELECT p_partkey AS code, trim(regexp_replace(lower(strip_accents(p_brand || ' ' || p_type)), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part) SELECT code, CASE WHEN count(*) OVER (PARTITION BY slug) > 1 THEN slug || '-' || code ELSE slug END AS slug FROM s")
def fn6_unique_slugs(spark: SparkSession, sf: str) -> DataFrame:
    return access.unique_slugs(ad.table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("code"), scalars.slug(F.concat_ws(" ", "p_brand", "p_type")).alias("slug"))).select(F.col("code").cast("long").alias("code"), "slug")


@query("SELECT n_nationkey AS code, CASE WHEN n_regionkey % 2 = 0 THEN n_name ELSE lower(n_name) END AS name, 'weekday' AS day_type FROM nation WHERE n_nationkey % 4 <> 1 UNION ALL SELECT n_nationkey, 'S ' || n_name, 'saturday' FROM nation WHERE n_nationkey % 4 = 1")
def set1_union_of_days(spark: SparkSession, sf: str) -> DataFrame:
    """SET-1: stations of both days, one row a code, the weekday's first."""
    n = ad.table(spark, sf, "nation")
    a = n.filter("n_nationkey % 4 <> 1").select(F.col("n_nationkey").alias("code"), F.when(F.col("n_regionkey") % 2 == 0, F.col("n_name")).otherwise(F.lower("n_name")).alias("name"), F.lit(0).alias("day"))
    b = n.select(F.col("n_nationkey").alias("code"), F.concat(F.lit("S "), "n_name").alias("name"), F.lit(1).alias("day"))
    x = a.unionByName(b).groupBy("code").agg(F.min(F.struct("day", "name")).alias("x"))
    return x.select("code", "x.name", F.when(F.col("x.day") == 0, "weekday").otherwise("saturday").alias("day_type"))


@query("SELECT user_id AS id FROM events INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def set3_known_ids(spark: SparkSession, sf: str) -> DataFrame:
    return ad.table(spark, sf, "events").select(F.col("user_id").alias("id")).intersect(ad.table(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("id")))


@query("SELECT n_nationkey AS code, string_agg(a, '|' ORDER BY a) AS aliases FROM (SELECT DISTINCT n_nationkey, n_name, unnest([n_name, lower(n_name), CASE WHEN n_nationkey % 3 = 0 THEN n_name ELSE reverse(n_name) END]) AS a FROM nation) WHERE a <> n_name GROUP BY 1")
def set5_aliases(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n_name")
    names = F.array_distinct(F.array(n, F.lower(n), F.when(F.col("n_nationkey") % 3 == 0, n).otherwise(F.reverse(n))))
    return ad.table(spark, sf, "nation").select(F.col("n_nationkey").alias("code"), F.array_join(F.array_sort(F.array_except(names, F.array(n))), "|").alias("aliases"))
