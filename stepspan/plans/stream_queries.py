"""The driver's events as a stream, run over all that is there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import shared_folder
from ..streaming import feeds
from . import adapters as ad
from .feed_queries import _SHOWN, PUBLISHED, _at_ticks, publish_candidates
from .registry import query


def _events(spark: SparkSession, sf: str, files: int = 4) -> DataFrame:
    schema = ad.table(spark, sf, "events").schema
    e = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{sf}/event[s].parquet")  # a pattern, so that a single file will do
    return e.withColumn("ts", F.col("ts").cast("timestamp"))  # a watermark needs a zone


def _conditions(spark: SparkSession, sf: str, files: int = 4) -> DataFrame:
    e = _events(spark, sf, files)
    status = F.when(F.col("event_type") == "error", "notAvailable").when(F.col("event_type") == "signup", "unknown").otherwise("available")
    end = F.when(F.col("event_id") % 3 == 0, F.timestamp_seconds(F.unix_seconds("ts") + 60 * F.floor("value")))
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("lift"), status.alias("status"), F.col("ts").alias("start"), end.alias("end"))


_RESET = """
msgs AS (
  SELECT *, "full" AS f, CASE WHEN "full" THEN date_trunc('hour', start) ELSE start END AS received
  FROM (SELECT *, hour(start) = 4 AS "full" FROM conditions)
), of_lift AS (
  SELECT *, max(received) FILTER (f) OVER (PARTITION BY lift) AS full_at, max(received) OVER (PARTITION BY lift) AS seen, max(received) FILTER (f) OVER () AS all_at
  FROM msgs
), held AS (
  SELECT * FROM of_lift WHERE (full_at IS NULL OR received >= full_at) AND (all_at IS NULL OR seen >= all_at)
  QUALIFY row_number() OVER (PARTITION BY lift, start ORDER BY received DESC, id DESC) = 1
)
SELECT lift, id, status, epoch_us(start) AS start_us, epoch_us("end") AS end_us, epoch_us(seen) AS seen_us FROM held
QUALIFY row_number() OVER (PARTITION BY lift ORDER BY start DESC) <= 3
"""


def _received(conditions: DataFrame) -> DataFrame:
    """What starts between four and five comes in that day's full state, at four."""
    hour = F.floor(F.unix_seconds("start") / 3600)
    full = hour % 24 == 4
    return conditions.withColumn("full", full).withColumn("received", F.when(full, F.timestamp_seconds(hour * 3600)).otherwise(F.col("start")))


@query(ad.sql(_RESET))
def str1_str8_lift_states(spark: SparkSession, sf: str) -> DataFrame:
    """STR-1, STR-8: the streamed state with its resets by full states must equal the batch form."""
    states = feeds.current_states(feeds.run_available(feeds.lift_states(_received(_conditions(spark, sf))), "update").drop("batch"))
    full = _received(ad.conditions(spark, sf)).filter("full").select(F.unix_micros("received").alias("at"))
    return feeds.listed_since_full_state(states.withColumn("seen", F.col("seen_us")), full).drop("seen")


def _as_stream(df: DataFrame, name: str, files: int = 1000) -> DataFrame:
    """df written to the shared folder, as a stream."""
    spark = df.sparkSession
    at = f"{shared_folder(spark)}/stepspan-{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(at)


@query(ad.sql(f"{_SHOWN} SELECT lift, epoch_us(now) AS now_us, status, shown FROM shown"))
def str2_held_back_stream(spark: SparkSession, sf: str) -> DataFrame:
    """STR-2 as a stream, with ticks of 6 hours and a hold of 7."""
    return feeds.run_available(feeds.held_back(_as_stream(_at_ticks(spark, sf), "ticks"), 420), "append").drop("batch")


@query(PUBLISHED)
def str5_publish_stream(spark: SparkSession, sf: str) -> DataFrame:
    """STR-5 as a stream."""
    return feeds.run_available(feeds.published_ticks(_as_stream(publish_candidates(spark, sf), "ticks")), "append").drop("batch")


_SILENCES = """
WITH cuts AS (
  SELECT event_type AS feed, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts) >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS cut FROM events
), sessions AS (
  SELECT feed, ts, sum(cut) OVER (PARTITION BY feed ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM cuts
)
SELECT feed, epoch_us(min(ts)) AS since_us, epoch_us(max(ts)) + 1800000000 AS until_us, count(*) AS n FROM sessions GROUP BY feed, k
HAVING max(ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events)
"""


@query(_SILENCES)
def str4_silences(spark: SparkSession, sf: str) -> DataFrame:
    """STR-4: closed sessions; those that the watermark has not passed yet are still open."""
    log = _events(spark, sf).select(F.col("event_type").alias("feed"), F.col("ts").alias("received"))
    x = feeds.run_available(feeds.silences(log), "append")
    return x.select("feed", F.unix_micros("since").alias("since_us"), F.unix_micros("until").alias("until_us"), "n")


@query(ad.sql("SELECT date::VARCHAR AS date, train, max(mark) AS mark FROM marks GROUP BY ALL"))
def str3_train_marks(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf)
    marks = e.select(F.date_trunc("day", "ts").alias("day"), F.col("user_id").alias("train"), F.when(F.col("event_type") == "error", "N").otherwise("J").alias("mark"))
    x = feeds.last_batch(feeds.run_available(feeds.train_marks(marks), "update"), ["day", "train"])
    return x.select(F.to_date("day").alias("date"), "train", "mark")


@query("SELECT event_type AS feed, epoch_us(max(ts)) AS last_us, count(*) AS n FROM events GROUP BY 1")
def str4_last_messages(spark: SparkSession, sf: str) -> DataFrame:
    log = _events(spark, sf).select(F.col("event_type").alias("feed"), F.col("ts").alias("received"))
    x = feeds.last_batch(feeds.run_available(feeds.last_messages(log), "update"), ["feed"])
    return x.select("feed", F.unix_micros("last").alias("last_us"), "n")


@query(ad.sql("SELECT status, count(*) AS n FROM (SELECT DISTINCT lift, start, status FROM conditions) GROUP BY status"))
def str6_without_resends(spark: SparkSession, sf: str) -> DataFrame:
    x = feeds.run_available(feeds.without_resends(_conditions(spark, sf)), "append")
    return x.groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT ts::DATE::VARCHAR AS day, count(*) AS messages FROM events GROUP BY 1")
def str7_daily_counts(spark: SparkSession, sf: str) -> DataFrame:
    log = _events(spark, sf).select(F.col("ts").alias("received"), F.col("user_id").alias("lift"))
    return feeds.last_batch(feeds.run_available(feeds.daily_counts(log), "update"), ["day"])


_LIVE = """
c AS (
  SELECT lift, start, max_by(status, id) AS status, max_by("end", id) AS "end" FROM conditions GROUP BY ALL
), r AS (
  SELECT *, row_number() OVER (PARTITION BY lift ORDER BY start) AS r FROM c
), t AS (
  SELECT lift, start AS t FROM c UNION SELECT lift, "end" FROM c WHERE "end" > start
), n AS (
  SELECT t.lift, t.t, max(r.r) AS n FROM t JOIN r ON r.lift = t.lift AND r.start <= t.t GROUP BY ALL
), st AS (
  SELECT n.lift, n.t, coalesce(max_by(r.status, r.r), 'unknown') AS status
  FROM n LEFT JOIN r ON r.lift = n.lift AND r.r <= n.n AND (r."end" IS NULL OR r."end" > n.t) GROUP BY ALL
), steps AS (
  SELECT *, lag(status) OVER w AS before FROM st WINDOW w AS (PARTITION BY lift ORDER BY t)
), backs AS (
  SELECT *, max(CASE WHEN status = 'available' AND before <> 'available' THEN t END) OVER (PARTITION BY lift ORDER BY t) AS back FROM steps
), told AS (
  SELECT lift, t, status, CASE WHEN status <> 'available' THEN status WHEN t - back < INTERVAL 420 MINUTE THEN 'back' END AS shown FROM backs
), over AS (
  SELECT b.lift, b.back + INTERVAL 420 MINUTE AS t FROM (SELECT DISTINCT lift, back FROM backs WHERE back IS NOT NULL) b
  WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.lift = b.lift AND st.t > b.back AND st.t <= b.back + INTERVAL 420 MINUTE AND st.status <> 'available')
), events_ AS (
  SELECT lift, t, status, shown FROM told UNION SELECT o.lift, o.t, 'available', NULL FROM over o
), changed AS (
  SELECT *, lag(coalesce(shown, '-')) OVER (PARTITION BY lift ORDER BY t) AS shown_before FROM events_
)
SELECT lift, epoch_us(t) AS at_us, status, shown FROM changed
WHERE shown_before IS DISTINCT FROM coalesce(shown, '-') AND t < (SELECT max(start) - INTERVAL 1 DAY FROM conditions)
"""


@query(ad.sql(_LIVE))
def str2_live_status(spark: SparkSession, sf: str) -> DataFrame:
    """STR-1, STR-2 on timers: every change of what is shown, up to the watermark, a day before the end of the stream; a hold of 7
    hours."""
    from ..streaming import live

    # timers fire in the batch after the one that brings the watermark, so two batches of one row follow all messages
    last = ad.conditions(spark, sf).agg(F.max("start").alias("end")).select(F.lit(-1).cast("bigint").alias("id"), F.lit(-1).cast("bigint").alias("lift"), F.lit("available").alias("status"), F.col("end").alias("start"), F.lit(None).cast("timestamp").alias("end"))
    after = _as_stream(last.select("*", F.explode(F.array(F.lit(2), F.lit(3))).alias("days")).repartition(2, "days"), "after", 1)
    after = after.withColumn("received", F.col("start") + F.make_dt_interval("days")).drop("days")
    c = _conditions(spark, sf, 1_000_000).withColumn("received", F.col("start")).unionByName(after)
    x = feeds.run_available(live.live_status(c, hold_minutes=420, forget_minutes=365 * 1440, delay="1 day"), "append", live.ROCKSDB)
    end = ad.conditions(spark, sf).agg(F.max(F.unix_micros("start")).alias("end"))
    return x.join(F.broadcast(end), (F.col("at_us") < F.col("end") - 86_400_000_000) & (F.col("lift") >= 0)).select("lift", "at_us", "status", "shown")  # end is one row


@query("SELECT ts::DATE::VARCHAR AS day, count(*) AS messages, count(DISTINCT user_id) AS lifts FROM events GROUP BY 1")
def snk5_published_batches(spark: SparkSession, sf: str) -> DataFrame:
    """SNK-5 as a streaming sink: each batch publishes all days so far; what is read back is the last one. Every batch is sent twice,
    as after a crash."""
    from ..operators import quality
    from ..sources import files

    at = f"{shared_folder(spark)}/stepspan-published-{uuid.uuid4().hex}"
    seen = f"{at}/seen"

    def tables(batch: DataFrame) -> dict[str, DataFrame]:
        all_days = spark.read.parquet(seen)
        return {"days": all_days.groupBy("day").agg(F.count("*").alias("messages"), F.countDistinct("user_id").alias("lifts"))}

    sink = files.publish_batches(f"{at}/out", tables, lambda t: {"enough": quality.too_few(t["days"], 1)})

    def write(batch: DataFrame, number: int) -> None:
        batch.select(F.to_date("ts").alias("day"), "user_id").write.mode("overwrite").parquet(f"{seen}/n={number}")
        sink(batch, number)
        sink(batch, number)

    run = _events(spark, sf).writeStream.option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    run.awaitTermination()
    return files.current(spark, f"{at}/out", "days")


@query(ad.sql("SELECT lift, count(*) AS n, count(*) FILTER (status = 'notAvailable') AS out, max(epoch_us(start) // 1000000 * 1000) AS last_ms FROM conditions GROUP BY lift"))
def src9_message_stream(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-9 as a stream: conditions as message files of a thousand, some gzipped, read as they land; two files that hold no message
    go to the quarantine and change nothing."""
    from ..sources import files, schemas
    from .source_queries import siri_messages

    at = f"{shared_folder(spark)}/stepspan-messages-{uuid.uuid4().hex}"
    m = siri_messages(ad.conditions(spark, sf), 1000)
    for zipped in (False, True):
        part = m.filter(f"id % 3 {'=' if zipped else '<>'} 0").select(F.col("body").cast("string").alias("value"))
        part.repartition(spark.sparkContext.defaultParallelism).write.option("maxRecordsPerFile", 1).option("compression", "gzip" if zipped else "none").mode("append").text(f"{at}/in")
    bad = ad.table(spark, sf, "nation").filter("n_nationkey < 2").select(F.concat(F.lit("no message "), "n_name").alias("value"))
    bad.coalesce(2).write.option("maxRecordsPerFile", 1).mode("append").text(f"{at}/in")
    checked = files.checked_messages(files.message_files(spark, f"{at}/in", 64), schemas.FACILITY_MESSAGE)
    good, wrong = files.split_messages(feeds.run_available(checked, "append"))
    x = files.lift_conditions(good, "L:", "id", "received")
    counted = x.groupBy(F.col("lift").cast("bigint").alias("lift")).agg(F.count("*").alias("n"), F.count_if(F.col("status") == "notAvailable").alias("out"), F.max(F.unix_millis("start")).alias("last_ms"))
    return counted.filter("lift IS NOT NULL").join(F.broadcast(wrong.filter("bytes > 0 AND id NOT LIKE '%.gz'").agg(F.count("*").alias("bad"))), F.col("bad") == 2).drop("bad")  # one row; writers leave empty files too
