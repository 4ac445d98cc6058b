"""Feed queries on the driver's events: users stand for lifts and trains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import feed
from . import adapters as ad
from .registry import query


def _us(c: str):
    return F.unix_micros(c)


_LATEST = "dedup AS (SELECT * FROM conditions QUALIFY row_number() OVER (PARTITION BY lift, start ORDER BY id DESC) = 1), latest AS (SELECT *, row_number() OVER (PARTITION BY lift ORDER BY start DESC) AS r FROM dedup QUALIFY r <= 3)"


@query(ad.sql(f"{_LATEST} SELECT id, lift, status, epoch_us(start) AS start_us, epoch_us(\"end\") AS end_us, r FROM latest"))
def win7_str6_latest_conditions(spark: SparkSession, sf: str) -> DataFrame:
    """WIN-7, STR-6."""
    return feed.latest_conditions(ad.conditions(spark, sf)).select("id", "lift", "status", _us("start").alias("start_us"), _us("end").alias("end_us"), "r")


_TICKS = "ticks AS (SELECT lift, make_timestamp(1704067200000000 + t * 21600000000) AS now FROM (SELECT DISTINCT lift FROM conditions), range(1, 121) x(t))"
_AT = f"{_TICKS}, at_tick AS (SELECT t.lift, t.now, coalesce(c.status, 'unknown') AS status FROM ticks t LEFT JOIN conditions c ON c.lift = t.lift AND c.start <= t.now AND (c.\"end\" IS NULL OR c.\"end\" > t.now) QUALIFY row_number() OVER (PARTITION BY t.lift, t.now ORDER BY c.start DESC NULLS LAST, c.id DESC) = 1)"


def _ticks(spark: SparkSession, sf: str) -> DataFrame:
    ticks = F.explode(F.transform(F.sequence(F.lit(1), F.lit(120)), lambda t: F.timestamp_seconds(1704067200 + t * 21600)))
    return ad.conditions(spark, sf).select("lift").distinct().select("lift", ticks.alias("now"))


def _at_ticks(spark: SparkSession, sf: str) -> DataFrame:
    return feed.status_at(ad.conditions(spark, sf), _ticks(spark, sf))


@query(ad.sql(f"{_AT} SELECT lift, epoch_us(now) AS now_us, status FROM at_tick"))
def join14_status_at(spark: SparkSession, sf: str) -> DataFrame:
    return _at_ticks(spark, sf).select("lift", _us("now").alias("now_us"), "status")


_SHOWN = f"{_AT}, shown AS (SELECT lift, now, status, CASE WHEN status <> 'available' THEN status WHEN now - max(now) FILTER (status <> 'available') OVER (PARTITION BY lift ORDER BY now) < INTERVAL 7 HOUR THEN 'back' END AS shown FROM at_tick)"


@query(ad.sql(f"{_SHOWN} SELECT lift, epoch_us(now) AS now_us, status, shown FROM shown"))
def str2_held_back(spark: SparkSession, sf: str) -> DataFrame:
    """STR-2 in batch, with ticks of 6 hours and a hold of 7."""
    return feed.held_back(_at_ticks(spark, sf), 420).select("lift", _us("now").alias("now_us"), "status", "shown")


@query(ad.sql(f"{_SHOWN} SELECT epoch_us(now) AS now_us, count(*) AS lifts, count(*) FILTER (shown IS NOT NULL AND shown <> 'back') AS out, CASE WHEN count(*) < 100 THEN 'too few lifts' WHEN count(*) FILTER (shown IS NOT NULL AND shown <> 'back') * 2 > count(*) THEN 'too many out' END AS problem FROM shown GROUP BY now"))
def prj12_plausible(spark: SparkSession, sf: str) -> DataFrame:
    x = feed.plausible(feed.held_back(_at_ticks(spark, sf), 420), 100)
    return x.select(_us("now").alias("now_us"), "lifts", "out", "problem")


@query(ad.sql("SELECT status, epoch_us(start) AS start_us, CASE WHEN now - start > INTERVAL 26 HOUR THEN 'unknown' WHEN now - coalesce(\"end\", start) > INTERVAL 30 MINUTE OR now - start > INTERVAL 30 MINUTE THEN 'nightly' ELSE 'live' END AS freshness FROM (SELECT *, make_timestamp(1706400000000000) AS now FROM conditions)"))
def prj11_freshness(spark: SparkSession, sf: str) -> DataFrame:
    now = F.timestamp_seconds(F.lit(1706400000))
    return ad.conditions(spark, sf).select("status", _us("start").alias("start_us"), scalars.freshness(F.col("start"), F.coalesce("end", "start"), F.col("start"), now).alias("freshness"))


@query(ad.sql("x AS (SELECT lift, lift % 3 AS version, max(start) AS updated FROM conditions GROUP BY ALL) SELECT lift, version, epoch_us(updated) AS updated_us FROM x WHERE version IN (1, 2) AND make_timestamp(1706659200000000) - updated < INTERVAL 14 DAY"))
def prj13_usable_records(spark: SparkSession, sf: str) -> DataFrame:
    """PRJ-13: known version, younger than 14 days."""
    x = ad.conditions(spark, sf).groupBy("lift", (F.col("lift") % 3).alias("version")).agg(F.max("start").alias("updated"))
    young = 1706659200 * 1_000_000 - F.unix_micros("updated") < 14 * 86_400_000_000
    return x.filter(F.col("version").isin(1, 2) & young).select("lift", "version", _us("updated").alias("updated_us"))


@query("SELECT epoch_us(ts) AS received_us, epoch_us(b) AS since_us, epoch_us(ts) // 1000000 - epoch_us(b) // 1000000 AS seconds FROM (SELECT ts, lag(ts) OVER (ORDER BY ts) AS b FROM events) WHERE ts - b > INTERVAL 25 MINUTE")
def win2_gaps(spark: SparkSession, sf: str) -> DataFrame:
    log = ad.table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("received"))
    return feed.gaps(log).select(_us("received").alias("received_us"), _us("since").alias("since_us"), "seconds")


@query("SELECT feed, quantile_cont(us, 0.5)::DOUBLE AS median_us, count(*) AS n FROM (SELECT event_type AS feed, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts) AS us FROM events) WHERE us < 1500000000 GROUP BY feed")
def win3_beat_interval(spark: SparkSession, sf: str) -> DataFrame:
    return feed.beat_interval(ad.table(spark, sf, "events").select(F.col("event_type").alias("feed"), F.col("ts").cast("timestamp").alias("received")))


_CHANGED = "changed AS (SELECT * FROM (SELECT *, lag(status) OVER (PARTITION BY lift ORDER BY id) AS before FROM conditions) WHERE id % 10 > 0 AND before <> status)"


def _changed(spark: SparkSession, sf: str) -> DataFrame:
    return feed.real_changes(ad.conditions(spark, sf).withColumn("full", F.col("id") % 10 == 0))


@query(ad.sql(f"{_CHANGED} SELECT lift, id, before, status FROM changed"))
def win6_real_changes(spark: SparkSession, sf: str) -> DataFrame:
    return _changed(spark, sf).select("lift", "id", "before", "status")


@query(ad.sql(f"{_CHANGED}, m AS (SELECT (start + INTERVAL 2 HOUR)::DATE AS day, count(*) AS messages FROM conditions GROUP BY 1), c AS (SELECT (start + INTERVAL 2 HOUR)::DATE AS day, count(*) AS changes, count(DISTINCT lift) AS lifts FROM changed GROUP BY 1) SELECT day::VARCHAR AS day, messages, coalesce(changes, 0) AS changes, coalesce(lifts, 0) AS lifts FROM m LEFT JOIN c USING (day)"))
def agg18_changes_per_day(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-18, FN-12."""
    day = scalars.local_day(F.col("start")).alias("day")
    m = ad.conditions(spark, sf).groupBy(day).agg(F.count("*").alias("messages"))
    c = _changed(spark, sf).groupBy(day).agg(F.count("*").alias("changes"), F.countDistinct("lift").alias("lifts"))
    return m.join(c, "day", "left").select("day", "messages", F.coalesce("changes", F.lit(0)).alias("changes"), F.coalesce("lifts", F.lit(0)).alias("lifts"))


_LISTED = "listed AS (SELECT id // 100 AS snapshot, lift, status, \"end\" FROM conditions)"


def _listed(spark: SparkSession, sf: str) -> DataFrame:
    return ad.conditions(spark, sf).select(F.floor(F.col("id") / 100).alias("snapshot"), "lift", "status", "end")


_COMBINATIONS = f"""
{_LISTED}, s AS (
    SELECT snapshot, lift, string_agg(status || CASE WHEN "end" IS NULL THEN '' ELSE '+end' END, '/' ORDER BY status || CASE WHEN "end" IS NULL THEN '' ELSE '+end' END) AS statuses, count(*) AS n
    FROM listed GROUP BY ALL
)
SELECT snapshot, statuses, count(*) AS lifts FROM s WHERE n > 1 GROUP BY ALL
"""


@query(ad.sql(_COMBINATIONS))
def agg15_status_combinations(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-15: combinations of statuses, and whether an end is planned, of lifts listed more than once in a snapshot."""
    return feed.status_combinations(_listed(spark, sf))


_STATUS_COUNTS = f"""
{_LISTED}, d AS (
    SELECT snapshot, sum(k)::BIGINT AS messages, count(*) AS lifts, count(*) FILTER (k > 1) AS doubled
    FROM (SELECT snapshot, lift, count(*) AS k FROM listed GROUP BY ALL) GROUP BY snapshot
)
SELECT snapshot, status, count(*) AS n, any_value(messages) AS messages, any_value(lifts) AS lifts, any_value(doubled) AS doubled
FROM listed JOIN d USING (snapshot) GROUP BY snapshot, status
"""


@query(ad.sql(_STATUS_COUNTS))
def agg15_status_counts(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-15: entries of each status per snapshot."""
    return feed.snapshot_statuses(_listed(spark, sf))


_AGES = """
SELECT CASE WHEN start IS NULL THEN 'no start'
            WHEN 1706659200000000 - epoch_us(start) > 30 * 86400000000 THEN 'over 30 days'
            WHEN 1706659200000000 - epoch_us(start) > 86400000000 THEN 'up to 30 days' ELSE 'up to 1 day' END AS bucket,
       count(*) AS n, count("end") AS planned_end, count(*) FILTER (lift IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 6 <> 0)) AS serving
FROM (SELECT lift, status, "end", CASE WHEN id % 11 = 0 THEN NULL WHEN id % 13 = 0 THEN make_timestamp(1706659200000000 - 86400000000) ELSE start END AS start FROM conditions)
WHERE status <> 'available' GROUP BY 1
"""


@query(ad.sql(_AGES))
def agg16_outage_ages(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-16; some outages have no start, some began exactly a day before."""
    day_before = F.timestamp_seconds(F.lit(1706659200 - 86400))
    start = F.when(F.col("id") % 11 == 0, None).when(F.col("id") % 13 == 0, day_before).otherwise(F.col("start"))
    s = F.col("s_suppkey")
    lifts = ad.table(spark, sf, "supplier").select(s.alias("lift"), F.when(s % 6 == 0, F.expr("array()").cast("array<string>")).otherwise(F.array((s % 4).cast("string"))).alias("tracks"))
    return feed.outage_ages(ad.conditions(spark, sf).withColumn("start", start), F.timestamp_seconds(F.lit(1706659200)), lifts)


@query("WITH l AS (SELECT event_type AS feed, (event_id % 23000 - 500)::BIGINT AS lag FROM events), k AS (SELECT *, row_number() OVER (PARTITION BY feed ORDER BY lag) - 1 AS r, count(*) OVER (PARTITION BY feed) AS n FROM l WHERE lag BETWEEN 0 AND 21600) SELECT feed, median(lag)::DOUBLE AS median, max(lag) FILTER (r = floor(n * 0.9)) AS p90, count(*) AS n FROM k GROUP BY feed")
def agg17_lag_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return feed.lag_statistics(ad.table(spark, sf, "events").select(F.col("event_type").alias("feed"), (F.col("event_id") % 23000 - 500).alias("lag")))


_DRIFT = """
periods AS (
  SELECT t AS period, make_timestamp(1704067200000000 + t * 86400000000) AS beg, make_timestamp(1704067200000000 + (t + 1) * 86400000000) AS until
  FROM range(1, 29) x(t)
), listed AS (
  SELECT period, id, lift, status, beg, until FROM periods JOIN conditions ON start <= beg
  QUALIFY row_number() OVER (PARTITION BY period, lift ORDER BY id DESC) <= CASE WHEN lift % 3 = 0 THEN 2 ELSE 1 END
), published AS (
  SELECT * FROM listed QUALIFY row_number() OVER (PARTITION BY period, lift ORDER BY id DESC) = 1
), steps AS (
  SELECT period, lift, -1 AS id, status, epoch_us(beg) AS us, until, status AS said FROM published
  UNION ALL
  SELECT p.period, c.lift, c.id, c.status, epoch_us(c.start), p.until, coalesce(q.status, 'unknown')
  FROM periods p JOIN conditions c ON c.start > p.beg AND c.start < p.until LEFT JOIN published q ON q.period = p.period AND q.lift = c.lift
), x AS (
  SELECT *, (coalesce(lead(us) OVER w, epoch_us(until)) - us) / 1000000 AS s, lead(us) OVER w IS NULL AS final FROM steps WINDOW w AS (PARTITION BY period, lift ORDER BY us, id)
), told AS (
  SELECT period, count(*) FILTER (id >= 0) AS changes, count(DISTINCT lift) FILTER (id >= 0 AND status <> 'available') AS went_out,
         coalesce(sum(s) FILTER (status <> 'available' AND said = 'available'), 0) AS working, coalesce(sum(s) FILTER (status = 'available' AND said <> 'available'), 0) AS broken
  FROM x GROUP BY period
), against AS (
  SELECT l.period - 1 AS period, count(*) FILTER (r.status IS DISTINCT FROM l.status) AS differing
  FROM listed l LEFT JOIN (SELECT period, lift, status FROM x WHERE final) r ON r.period = l.period - 1 AND r.lift = l.lift GROUP BY 1
), quiet AS (
  SELECT DISTINCT period FROM (SELECT lag(start) OVER (ORDER BY start) AS since, start FROM conditions) g JOIN periods ON since > beg AND since < until
  WHERE start - since > INTERVAL 25 MINUTE
)
SELECT period, changes, went_out, round(working, 3) AS shown_working, round(broken, 3) AS shown_out, round(working / 86400, 3) AS mean_shown_working,
       round(broken / 86400, 3) AS mean_shown_out, coalesce(differing, -1) AS differing, period IN (SELECT period FROM quiet) AS silent
FROM told LEFT JOIN against USING (period)
"""


@query(ad.sql(_DRIFT))
def agg19_drift(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-19: a full state each midnight; every third lift is listed in it with its last two messages."""
    t = F.explode(F.sequence(F.lit(1), F.lit(28)))
    c = ad.conditions(spark, sf)
    periods = spark.range(1).select(t.alias("period")).select(F.col("period").cast("long").alias("period"), F.timestamp_seconds(1704067200 + F.col("period") * 86400).alias("begin"), F.timestamp_seconds(1704067200 + (F.col("period") + 1) * 86400).alias("until"))
    # the last two messages up to each period: the last two of those between two begins, carried on
    into = F.greatest(F.ceil((F.unix_micros("start") - 1704067200 * 1_000_000) / 86_400_000_000), F.lit(1))
    two = lambda x: F.slice(F.reverse(F.array_sort(x)), 1, 2)
    newest = F.row_number().over(W.partitionBy("lift", "period").orderBy(F.desc("id")))
    last = c.withColumn("period", into).withColumn("r", newest).filter("r <= 2 AND period <= 28").groupBy("lift", "period").agg(two(F.collect_list(F.struct("id", "status"))).alias("x"))
    grid = c.select("lift").distinct().select("lift", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(28).cast("long"))).alias("period")).join(last, ["lift", "period"], "left")
    upto = F.flatten(F.collect_list("x").over(W.partitionBy("lift").orderBy("period")))  # two a period, 28 periods
    listed = grid.select("period", "lift", two(upto).alias("two")).select("period", "lift", F.explode(F.slice(F.col("two"), 1, F.when(F.col("lift") % 3 == 0, 2).otherwise(1))).alias("x")).select("period", "x.id", "lift", "x.status")
    silences = feed.gaps(c.select(F.col("start").alias("received")))
    x = feed.drift(listed, c.select("id", "lift", F.col("start").alias("at"), "status"), periods, silences)
    return x.withColumn("differing", F.coalesce("differing", F.lit(-1).cast("long")))  # -1: no full state follows


_WARNINGS = f"""
{_LATEST}, cur AS (
  SELECT lift, status AS shown FROM latest WHERE r = 1 AND lift % 10 <> 7
), stops AS (
  SELECT l_orderkey AS journey, l_linenumber AS place, l_suppkey AS station,
         CASE WHEN l_partkey % 5 = 0 THEN NULL WHEN l_partkey % 17 = 0 THEN '?' ELSE (l_partkey % 4)::VARCHAR || ['a', 'B', ''][l_partkey % 3 + 1] END AS track,
         CASE l_linenumber WHEN 1 THEN 'start' WHEN 7 THEN 'end' ELSE 'change' END AS role
  FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) = 1
), lifts AS (
  SELECT s_suppkey AS station, s_suppkey % 150 AS lift, [(s_suppkey % 4)::VARCHAR || ['', 'a', 'bc'][s_suppkey % 3 + 1]] AS tracks, s_suppkey % 6 = 0 AS hall FROM supplier
), hits AS (
  SELECT journey, place, CASE shown WHEN 'notAvailable' THEN 3 WHEN 'unknown' THEN 2 END AS rank
  FROM stops JOIN lifts USING (station) JOIN cur USING (lift)
  WHERE shown <> 'available'
    AND CASE WHEN hall THEN role <> 'change' ELSE track IS NULL OR track = '?' OR rtrim(lower(track), 'abcdefghijklmnopqrstuvwxyz') = rtrim(lower(tracks[1]), 'abcdefghijklmnopqrstuvwxyz') END
)
SELECT journey, place, ['back', 'unknown', 'out'][max(rank)] AS warning, count(*) AS lifts FROM hits GROUP BY ALL
"""


@query(ad.sql(_WARNINGS))
def join17_lift_warnings(spark: SparkSession, sf: str) -> DataFrame:
    """JOIN-17: tracks with letters at stops and lifts, unknown tracks, and a tenth of the lifts with a status that is not fresh."""
    one = ad.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("journey"), F.col("l_linenumber").alias("place")).agg(F.min(F.struct("l_partkey", "l_suppkey")).alias("x"))
    p = F.col("x.l_partkey")
    letter = lambda n, *of: F.element_at(F.array(*map(F.lit, of)), (n % 3 + 1).cast("int"))
    track = F.when(p % 5 == 0, None).when(p % 17 == 0, "?").otherwise(F.concat((p % 4).cast("string"), letter(p, "a", "B", "")))
    stops = one.select("journey", "place", F.col("x.l_suppkey").alias("station"), track.alias("track"), F.when(F.col("place") == 1, "start").when(F.col("place") == 7, "end").otherwise("change").alias("role"))
    s = F.col("s_suppkey")
    lifts = ad.table(spark, sf, "supplier").select(s.alias("station"), (s % 150).alias("lift"), F.array(F.concat((s % 4).cast("string"), letter(s, "", "a", "bc"))).alias("tracks"), (s % 6 == 0).alias("hall"))
    current = feed.latest_conditions(ad.conditions(spark, sf), 1).select("lift", F.col("status").alias("shown"), (F.col("lift") % 10 != 7).alias("fresh"))
    return feed.lift_warnings(stops, lifts, current)


@query(ad.sql("f AS (SELECT DISTINCT lift FROM conditions) SELECT CASE WHEN f.lift IS NULL THEN 'untied' ELSE 'tied' END AS tie, count(*) AS lifts, count(DISTINCT s_nationkey) AS stations FROM supplier LEFT JOIN f ON f.lift = s_suppkey GROUP BY 1"))
def join18_tied_lifts(spark: SparkSession, sf: str) -> DataFrame:
    known = ad.conditions(spark, sf).select("lift").distinct().withColumn("tie", F.lit("tied"))
    x = ad.table(spark, sf, "supplier").join(known, F.col("lift") == F.col("s_suppkey"), "left")
    return x.groupBy(F.coalesce("tie", F.lit("untied")).alias("tie")).agg(F.count("*").alias("lifts"), F.countDistinct("s_nationkey").alias("stations"))


@query(ad.sql("d AS (SELECT train, date, max(mark) AS mark FROM marks WHERE date < DATE '2024-01-30' AND date >= DATE '2024-01-02' AND isodow(date) < 6 GROUP BY ALL), v AS (SELECT train, count(*) FILTER (mark = 'N') AS n, count(*) FILTER (mark = 'J') AS j FROM d GROUP BY train) SELECT train, n = 0 AS verdict FROM v WHERE n > 0 OR j >= 3"))
def agg12_train_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return feed.train_verdicts(ad.marks(spark, sf), F.lit("2024-01-30").cast("date"))


@query(ad.sql("SELECT date::VARCHAR AS date, coalesce(string_agg(train::VARCHAR, ' ' ORDER BY train) FILTER (mark = 'J'), '') AS yes, coalesce(string_agg(train::VARCHAR, ' ' ORDER BY train) FILTER (mark = 'N'), '') AS no FROM (SELECT date, train, max(mark) AS mark FROM marks GROUP BY ALL) GROUP BY date"))
def str3_train_record(spark: SparkSession, sf: str) -> DataFrame:
    """STR-3 in batch, SRC-11, FN-9: sticky marks by day, numbers in order."""
    sticky = ad.marks(spark, sf).groupBy("date", "train").agg(F.max("mark").alias("mark"))

    def numbers(mark: str):
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("mark") == mark, F.col("train")))), lambda t: t.cast("string")), " ")

    return sticky.groupBy("date").agg(numbers("J").alias("yes"), numbers("N").alias("no"))


PUBLISHED = """
WITH RECURSIVE ticks AS (
  SELECT event_type AS feed, ts::DATE::VARCHAR AS day, ((hour(ts) * 60 + minute(ts)) // 2 * 2)::INT AS tick, (max(user_id) % 3)::VARCHAR AS digest FROM events
  GROUP BY ALL HAVING max(user_id) % 7 > 0
), kept AS (
  SELECT * FROM (SELECT * FROM ticks QUALIFY row_number() OVER (PARTITION BY feed, day ORDER BY tick) = 1)
  UNION ALL
  SELECT * FROM (
    SELECT t.* FROM kept k JOIN ticks t ON t.feed = k.feed AND t.day = k.day AND t.tick > k.tick AND (t.digest <> k.digest OR t.tick - k.tick >= 10)
    QUALIFY row_number() OVER (PARTITION BY t.feed, t.day ORDER BY t.tick) = 1
  )
)
SELECT feed, day, tick, digest FROM kept
"""


def publish_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """feed, day, tick, digest, problem: of the ticks that have a message."""
    tick = (F.floor((F.hour("ts") * 60 + F.minute("ts")) / 2) * 2).cast("int")
    x = ad.table(spark, sf, "events").groupBy(F.col("event_type").alias("feed"), F.to_date("ts").alias("day"), tick.alias("tick")).agg(F.max("user_id").alias("u"))
    return x.select("feed", "day", "tick", (F.col("u") % 3).cast("string").alias("digest"), F.when(F.col("u") % 7 == 0, "too few lifts").alias("problem"))


@query(PUBLISHED)
def str5_publish_ticks(spark: SparkSession, sf: str) -> DataFrame:
    """STR-5 in batch."""
    return feed.publish_ticks(publish_candidates(spark, sf))
