"""Sources and sinks on files that are first written from the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.lineage import shared_folder
from ..sources import files
from . import adapters as ad
from .registry import query


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/stepspan-{name}-{uuid.uuid4().hex}"


@query(ad.sql("SELECT platform, count(*) AS n, min(arr) AS first, max(dep) AS last, count(pickup_type) AS typed FROM calls GROUP BY platform"))
def src1_snk1_timetable_files(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-1, SNK-1: calls as a timetable text table and back."""
    at = _folder(spark, "gtfs")
    c = ad.calls(spark, sf)
    c.select(F.col("trip").alias("trip_id"), F.col("seq").alias("stop_sequence"), F.col("platform").alias("stop_id"), ad.clock(F.col("arr")).alias("arrival_time"), ad.clock(F.col("dep")).alias("departure_time"), "pickup_type", "drop_off_type").write.option("header", True).csv(f"{at}/stop_times.txt")
    x = files.gtfs(spark, at, "stop_times")
    return x.groupBy(F.col("stop_id").cast("long").alias("platform")).agg(F.count("*").alias("n"), F.min(scalars.minutes(F.col("arrival_time"))).alias("first"), F.max(scalars.minutes(F.col("departure_time"))).alias("last"), F.count("pickup_type").alias("typed"))


@query(ad.sql("SELECT lift AS facility, status, count(*) AS n, epoch_us(max(start)) // 1000 AS last_ms FROM conditions GROUP BY ALL"))
def src7_fn10_log_lines(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-7, FN-10: conditions as JSON lines and back."""
    at = _folder(spark, "log")
    c = ad.conditions(spark, sf)
    t = F.date_format("start", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    c.select(F.to_json(F.struct(t.alias("received"), F.col("lift").cast("string").alias("facility"), "status", t.alias("start"))).alias("value")).write.text(at)
    x = files.log_lines(spark, at)
    return x.groupBy(F.col("facility").cast("long").alias("facility"), "status").agg(F.count("*").alias("n"), F.max(F.unix_millis("start")).alias("last_ms"))


def siri_messages(c: DataFrame, size: int) -> DataFrame:
    """(id, body): conditions as XML messages of `size`."""
    one = F.concat(F.lit("<s:FacilityCondition><s:FacilityRef>L:"), F.col("lift").cast("string"), F.lit("</s:FacilityRef><s:FacilityStatus><s:Status>"), "status", F.lit("</s:Status></s:FacilityStatus><s:ValidityPeriod><s:StartTime>"), scalars.iso_utc(F.col("start")), F.lit("</s:StartTime>"), F.coalesce(F.concat(F.lit("<s:EndTime>"), scalars.iso_utc(F.col("end")), F.lit("</s:EndTime>")), F.lit("")), F.lit("</s:ValidityPeriod></s:FacilityCondition>"))
    m = c.groupBy(F.floor(F.col("id") / size).alias("id")).agg(F.array_join(F.collect_list(one), "").alias("x"))
    return m.select("id", F.encode(F.concat(F.lit('<s:Siri xmlns:s="http://www.siri.org.uk/siri">'), "x", F.lit("</s:Siri>")), "UTF-8").alias("body"))


@query(ad.sql("SELECT id // 10 AS message, count(*) AS size, count(*) FILTER (status = 'notAvailable') AS out, count(\"end\") AS planned FROM conditions GROUP BY 1"))
def src9_lift_messages(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-9: conditions as XML messages of ten, decoded again."""
    c = ad.conditions(spark, sf)
    m = siri_messages(c, 10)
    x = files.lift_messages(m, "L:")
    return x.groupBy(F.col("id").alias("message")).agg(F.max("size").cast("long").alias("size"), F.count_if(F.col("status") == "notAvailable").alias("out"), F.count("end").alias("planned"))


@query(ad.sql("SELECT date::VARCHAR AS date, train::VARCHAR AS train, CASE max(mark) WHEN 'N' THEN 'no' ELSE 'yes' END AS kind FROM marks GROUP BY ALL"))
def src11_train_record(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-11: the record as JSON and back."""
    from .feed_queries import str3_train_record

    days = str3_train_record(spark, sf)
    records = days.select(F.to_json(F.struct(F.lit("1").alias("v"), F.lit("2024-01-30T00:00:00Z").alias("updated"), F.create_map(F.col("date").cast("string"), F.struct("yes", "no")).alias("days"))).alias("json"))
    return files.train_record(records).select("date", "train", "kind")


@query("SELECT l_suppkey AS origin, count(DISTINCT (l_linenumber % 3, l_partkey % 25)) AS n_levels FROM lineitem GROUP BY 1")
def snk3_origin_documents(spark: SparkSession, sf: str) -> DataFrame:
    """SNK-3: one nested JSON document per origin; the levels are counted in the text."""
    p = F.col("l_partkey")
    x = ad.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("origin"), (p % 25).alias("dest"), (F.col("l_linenumber") % 3).alias("k")).agg(F.min(p % 60).alias("median"))
    entries = x.select("origin", F.lit("weekday").alias("day_type"), F.lit("any").alias("profile"), F.lit("all").alias("train_set"), "dest", "k", "median", F.col("median").alias("fastest"), F.lit(1.0).alias("per_hour"), F.col("k").alias("changes"), F.lit("").alias("via"), F.lit("1|2").alias("tracks"))
    docs = files.origin_documents(entries)
    return docs.select("origin", F.regexp_count("json", F.lit(r"1\|2")).cast("long").alias("n_levels"))


@query("SELECT n_nationkey AS code, '{\"code\":' || n_nationkey || ',\"name\":\"' || n_name || '\",\"status\":\"unknown\"' || coalesce(',\"tracks\":{' || t || '}', '') || '}' AS json FROM nation LEFT JOIN (SELECT s_nationkey, string_agg('\"' || lpad(s_suppkey::VARCHAR, 6, '0') || '\":\"yes\"', ',' ORDER BY s_suppkey) AS t FROM supplier WHERE s_suppkey % 3 > 0 GROUP BY 1) ON s_nationkey = n_nationkey")
def snk4_fn9_station_documents(spark: SparkSession, sf: str) -> DataFrame:
    """SNK-4, FN-9."""
    n = ad.table(spark, sf, "nation").select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("name"), F.lit("unknown").alias("status"))
    t = ad.table(spark, sf, "supplier").select(F.col("s_nationkey").alias("code"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("track"), F.lit("yes").alias("status"), (F.col("s_suppkey") % 3 > 0).alias("main"))
    return files.station_documents(n, t)


@query("SELECT c_custkey AS code, c_mktsegment AS status FROM customer WHERE c_acctbal > 0 UNION ALL SELECT c_custkey, 'old' FROM customer WHERE NOT c_acctbal > 0")
def src6_newer_wins(spark: SparkSession, sf: str) -> DataFrame:
    c = ad.table(spark, sf, "customer")
    return files.newer_wins(c.filter("c_acctbal > 0").select(F.col("c_custkey").alias("code"), F.col("c_mktsegment").alias("status")), c.select(F.col("c_custkey").alias("code"), F.lit("old").alias("status")), "code")


@query("SELECT upper(printf('N%02d', n_nationkey)) AS code, n_regionkey::VARCHAR AS country, CASE WHEN n_nationkey % 4 > 0 THEN (n_nationkey % 4 + 2)::INT END AS minutes, n_name AS name FROM nation")
def src2_fixed_order(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-2: stations as a fixed-order file with blanks around the fields, and back; a bad number gives null."""
    at = _folder(spark, "fixed")
    n = F.col("n_nationkey")
    pad = [F.concat(F.lit(" "), c, F.lit(" ")) for c in (F.format_string("n%02d", n), F.col("n_regionkey").cast("string"), F.when(n % 4 > 0, (n % 4 + 2).cast("string")).otherwise("x"), F.col("n_name"))]
    lines = F.concat_ws(",", *pad).alias("value")
    ad.table(spark, sf, "nation").select(lines).coalesce(1).write.option("ignoreLeadingWhiteSpace", False).mode("overwrite").text(f"{at}/body")
    body = spark.read.text(f"{at}/body")
    spark.createDataFrame([("@header",)], "value string").unionByName(body).coalesce(1).write.text(f"{at}/file")
    return files.fixed_order(spark, f"{at}/file")


@query("SELECT 'N' || s_nationkey AS station, string_agg(DISTINCT 'a' || (s_suppkey % 5)::VARCHAR, '|' ORDER BY 'a' || (s_suppkey % 5)::VARCHAR) AS attributes, bool_or(s_suppkey % 5 = 2) AS a2 FROM supplier GROUP BY 1")
def src3_sections(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-3: suppliers as a sectioned text by nation, and back."""
    at = _folder(spark, "sections")
    s = ad.table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.collect_list(F.concat(F.lit("-a"), (F.col("s_suppkey") % 5).cast("string"))).alias("x"))
    s.select(F.concat_ws("\n", F.concat(F.lit("#n"), F.col("s_nationkey").cast("string")), "x").alias("value")).write.text(at)
    x = files.sections(spark, at)
    return files.flags(x, ["a2"]).join(x, "station").select("station", F.array_join("attributes", "|").alias("attributes"), "a2")


@query("SELECT printf('N%02d', n_nationkey) AS code, CASE WHEN n_nationkey % 3 > 0 THEN 'status ' || n_regionkey END AS status FROM nation")
def src5_register(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-5: a register with a second header row and lines of uneven length, and back."""
    at = _folder(spark, "register")
    n = F.col("n_nationkey")
    line = F.concat(F.format_string(" n%02d ", n), F.lit(";"), "n_name", F.when(n % 3 > 0, F.concat(F.lit("; status "), F.col("n_regionkey").cast("string"), F.lit(" "))).otherwise(""))
    ad.table(spark, sf, "nation").select(line.alias("value")).write.text(f"{at}/body")
    head = spark.createDataFrame([("CODE;NAME;STATUS\n(code);(name);(status)",)], "value string")
    head.unionByName(spark.read.text(f"{at}/body")).coalesce(1).write.text(f"{at}/file")
    return files.register(spark, f"{at}/file")


@query("SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'elevator' ELSE 'station' END AS kind, s_suppkey::VARCHAR AS id, s_suppkey / 8.0 AS lat, CASE WHEN s_suppkey % 3 > 0 AND s_suppkey % 5 > 0 THEN 'S' || s_suppkey END AS name FROM supplier")
def src8_map_elements(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-8: suppliers as one nested JSON of map elements, and back."""
    at = _folder(spark, "map")
    k = F.col("s_suppkey")
    tags = F.when(k % 3 == 0, F.create_map(F.lit("highway"), F.lit("elevator"))).otherwise(F.create_map(F.lit("railway"), F.lit("station"), F.lit("name"), F.when(k % 5 > 0, F.concat(F.lit("S"), k.cast("string"))).otherwise("")))
    where = F.when(k % 2 == 0, F.struct((k / 8.0).alias("lat"), (k / 4.0).alias("lon")))
    element = F.struct(k.cast("string").alias("id"), F.when(k % 2 > 0, k / 8.0).alias("lat"), F.when(k % 2 > 0, k / 4.0).alias("lon"), where.alias("center"), tags.alias("tags"))
    per_nation = ad.table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.to_json(F.struct(F.collect_list(element).alias("elements"))).alias("value"))
    per_nation.select("value").repartition(8).write.option("maxRecordsPerFile", 1).text(at)
    stations, lifts = files.osm_elements(spark, at)
    return stations.select(F.lit("station").alias("kind"), "id", "lat", "name").unionByName(lifts.select(F.lit("elevator").alias("kind"), "id", "lat", F.lit(None).cast("string").alias("name")))


@query(ad.sql("SELECT date::VARCHAR AS date, train::VARCHAR AS train, max(mark) AS mark FROM marks GROUP BY ALL"))
def src10_journey_messages(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-10: a journey message per train and day, with a unit per mark, decoded again: N if any unit is N."""
    unit = F.concat(F.lit("<n:MaterieelDeel><n:MaterieelDeelToegankelijk>"), "mark", F.lit("</n:MaterieelDeelToegankelijk></n:MaterieelDeel>"))
    m = ad.marks(spark, sf).groupBy("date", "train").agg(F.array_join(F.collect_list(unit), "").alias("x"))
    body = F.concat(F.lit('<n:M xmlns:n="urn:x"><n:RitInfo><n:TreinDatum>'), F.col("date").cast("string"), F.lit("</n:TreinDatum><n:LogischeRit><n:LogischeRitDeel><n:LogischeRitDeelNummer>"), F.col("train").cast("string"), F.lit("</n:LogischeRitDeelNummer>"), "x", F.lit("</n:LogischeRitDeel></n:LogischeRit></n:RitInfo></n:M>"))
    return files.journey_marks(m.select(F.col("train").alias("id"), F.encode(body, "UTF-8").alias("body"))).select("date", "train", "mark")


@query("SELECT CASE WHEN c_custkey % 3 > 0 THEN (c_custkey % 1000)::VARCHAR END AS track, count(*) AS n FROM customer GROUP BY 1")
def src12_corrections(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-12: corrections as CSV, and back; blank tracks are null."""
    at = _folder(spark, "corrections")
    k = F.col("c_custkey")
    c = ad.table(spark, sf, "customer").select(F.col("c_nationkey").cast("string").alias("ns_code"), F.when(k % 3 > 0, (k % 1000).cast("string")).otherwise("").alias("track"), F.lit("yes").alias("status"), F.lit("r").alias("reason"), F.lit("s").alias("source"), F.lit("2026-10-01").alias("date"))
    c.write.option("header", True).option("emptyValue", "").csv(at)
    return files.corrections(spark, at).groupBy("track").agg(F.count("*").alias("n"))


@query("SELECT c_custkey AS code, c_name AS name, c_custkey AS published FROM customer")
def snk2_snk5_published(spark: SparkSession, sf: str) -> DataFrame:
    """SNK-2, SNK-5: a sorted CSV, and a table published after its checks; both read back, the second from the pointer."""
    from ..operators import quality

    at = _folder(spark, "publish")
    n = ad.table(spark, sf, "customer").select(F.col("c_custkey").alias("code"), F.col("c_name").alias("name"))
    files.write_sorted_csv(n, f"{at}/csv", "name")
    files.publish({"stations": n}, at, "run-1", {"enough": quality.too_few(n, 1)})
    csv = spark.read.schema("code bigint, name string").option("header", True).csv(f"{at}/csv")
    return csv.join(files.current(spark, at, "stations").select(F.col("code").alias("published"), F.col("name").alias("n")), F.col("name") == F.col("n")).drop("n")


_QUAYS = """
SELECT 'S' || s_suppkey // 4 AS code, 'q' || s_suppkey AS id, s_suppkey || 'a' AS track,
       ['track', 'island', 'sector'][s_suppkey % 3 + 1] AS type,
       CASE s_suppkey % 5 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE 'unknown' END AS status, (s_suppkey % 2)::INT AS lifts
FROM supplier
WHERE s_suppkey // 4 % 5 > 0
"""


@query(_QUAYS)
def src4_accessibility_file(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-4: suppliers as quays, four a stop place, as an XML file and back; every fifth place is no station."""
    at = _folder(spark, "quays")
    k = F.col("s_suppkey")
    number = k.cast("string")
    kind = F.element_at(F.array(*map(F.lit, ("railPlatform", "railIslandPlatform", "railPlatformSector"))), (k % 3 + 1).cast("int"))
    access = F.when(k % 5 == 0, "true").when(k % 5 == 1, "false")
    limits = F.struct(F.struct(F.struct(access.alias("StepFreeAccess")).alias("AccessibilityLimitation")).alias("limitations"))
    lift = F.struct(F.struct(F.array(F.struct(F.lit("L:1").alias("_ref"))).alias("LiftEquipmentRef")).alias("placeEquipments"))
    quay = F.struct(
        F.concat(F.lit("q"), number).alias("_id"),
        F.concat(number, F.lit("A")).alias("PublicCode"),
        kind.alias("QuayType"),
        F.when(k % 2 == 1, F.struct(F.array(lift).alias("EquipmentPlace"))).alias("equipmentPlaces"),
        F.when(access.isNotNull(), limits).alias("AccessibilityAssessment"),
    )
    place = ad.table(spark, sf, "supplier").groupBy(F.floor(k / 4).alias("p")).agg(F.collect_list(quay).alias("Quay"))
    code, mode = F.col("p").cast("string"), F.when(F.col("p") % 5 > 0, "rail").otherwise("bus")
    private = F.struct(F.concat(F.lit("NL:S:s"), code).alias("PrivateCode"))
    place = place.select(F.concat(F.lit("NL:SP:"), code).alias("_id"), private.alias("privateCodes"), mode.alias("TransportMode"), F.struct("Quay").alias("quays"))
    place.write.format("xml").option("rootTag", "stopPlaces").option("rowTag", "StopPlace").save(at)
    return files.quays(files.stop_places(spark, at)).select("code", "id", "track", "type", "status", F.size("lift_refs").alias("lifts"))
