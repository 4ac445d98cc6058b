"""The facility feed as a stream: state per lift, train marks, heartbeats, resends, counts per day.

Each function takes a streaming DataFrame and gives one; the same rows as a batch give the same result (see the tests).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.lineage import shared_folder
from ..operators.feed import due

#: A late message: full states come once a night, so 26 hours cover one that was missed.
LATE = "26 hours"

STATE = "lift bigint, version bigint, seen_us bigint, id bigint, status string, start_us bigint, end_us bigint"


def lift_states(conditions: DataFrame, keep: int = 3) -> DataFrame:
    """STR-1, STR-8. conditions: (id, lift, status, start, end) and maybe received and full. Per lift the newest `keep`
    conditions by start; a resend with the same start replaces, whatever the order of arrival. What was received before a
    lift's part of a full state goes. Each update gives the lift's whole list under a new version, and when it was last seen;
    lifts that a full state left out go on read (listed_since_full_state)."""
    received = F.unix_micros("received") if "received" in conditions.columns else F.lit(0).cast("long")
    full = F.col("full") if "full" in conditions.columns else F.lit(False)
    x = conditions.select("id", "lift", "status", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), received.alias("received"), full.alias("full"))

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        version, seen, full_at, held = json.loads(state.get[0]) if state.exists else (0, None, None, [])
        by_start = {h[2]: h for h in held}
        for pdf in frames:
            for i, status, start, end, at, full in zip(pdf.id, pdf.status, pdf.start_us, pdf.end_us, pdf.received, pdf.full):
                start, end = (None if pd.isna(t) else int(t) for t in (start, end))
                i, at = int(i), int(at)
                seen = at if seen is None else max(seen, at)
                if full:
                    full_at = at if full_at is None else max(full_at, at)
                if start not in by_start or (by_start[start][4], by_start[start][0]) < (at, i):
                    by_start[start] = [i, status, start, end, at]
        valid = [h for h in by_start.values() if full_at is None or h[4] >= full_at]
        held = sorted(valid, key=lambda h: (h[2] is not None, h[2] or 0))[-keep:]
        state.update((json.dumps([version + 1, seen, full_at, held]),))
        rows = [(key[0], version + 1, seen, *h[:4]) for h in held]
        yield pd.DataFrame(rows, columns=["lift", "version", "seen_us", "id", "status", "start_us", "end_us"]).astype({"start_us": "Int64", "end_us": "Int64"})

    return x.groupBy("lift").applyInPandasWithState(update, STATE, "held string", "update", GroupStateTimeout.NoTimeout)


def current_states(updates: DataFrame) -> DataFrame:
    """The last version of each lift from the updates of lift_states."""
    last = F.max("version").over(W.partitionBy("lift"))
    return updates.withColumn("last", last).filter("version = last").drop("last", "version")


def listed_since_full_state(states: DataFrame, full_states: DataFrame) -> DataFrame:
    """STR-1's reset, on read: states: (lift, seen, ...); full_states: (at). Lifts not seen since the last full state go."""
    at = full_states.agg(F.max("at").alias("full_at"))
    return states.join(F.broadcast(at), F.col("full_at").isNull() | (F.col("seen") >= F.col("full_at"))).drop("full_at")  # at is one row


def held_back(statuses: DataFrame, minutes: int = 30) -> DataFrame:
    """STR-2. statuses: (lift, now, status) at ticks, which come in order from batch to batch. Out if not available; available
    but seen out less than `minutes` before: back. The state is when a lift was last seen out."""
    x = statuses.select("lift", F.unix_micros("now").alias("now_us"), "status")

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = state.get[0] if state.exists else None
        # plain lists: a lift has few ticks in a batch, and joining, sorting and taking frames apart costs more than they do
        ticks = sorted(((t, x) for pdf in frames for t, x in zip(pdf["now_us"].tolist(), pdf["status"].tolist())), key=lambda tick: tick[0])
        shown = []
        for now, status in ticks:
            if status != "available":
                out = int(now)
            back = out is not None and now - out < minutes * 60_000_000
            shown.append(status if status != "available" else "back" if back else None)
        if out is not None:
            state.update((out,))
        yield pd.DataFrame({"lift": key[0], "now_us": [t for t, _ in ticks], "status": [x for _, x in ticks], "shown": pd.Series(shown, dtype=object)})

    kind = statuses.schema["lift"].dataType.simpleString()
    return x.groupBy("lift").applyInPandasWithState(update, f"lift {kind}, now_us bigint, status string, shown string", "out bigint", "append", GroupStateTimeout.NoTimeout)


def published_ticks(ticks: DataFrame, quiet_minutes: int = 10) -> DataFrame:
    """STR-5. As feed.publish_ticks, on ticks that come in order from batch to batch; the state is, per feed, the day and what
    was published last on it, so a feed has one state for good."""
    if "problem" in ticks.columns:
        ticks = ticks.filter("problem IS NULL")
    x = ticks.select("feed", "day", "tick", "digest")
    kinds = {c: x.schema[c].dataType.simpleString() for c in x.columns}

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(frames)).sort_values(["day", "tick"])
        today, *last = state.get if state.exists else (None, None, None)
        out = []
        for day, part in pdf.groupby("day", sort=True):
            if str(day) != today:
                today, last = str(day), [None, None]
            kept = list(due(zip(part.tick.tolist(), part.digest), *last, quiet_minutes))
            last = list(kept[-1]) if kept else last
            out += [(*key, day, *k) for k in kept]
        state.update((today, *last))
        yield pd.DataFrame(out, columns=["feed", "day", "tick", "digest"])

    return x.groupBy("feed").applyInPandasWithState(
        update, ", ".join(map(" ".join, kinds.items())), f"day string, tick {kinds['tick']}, digest {kinds['digest']}", "append", GroupStateTimeout.NoTimeout
    )


def train_marks(marks: DataFrame, keep: str = "35 days") -> DataFrame:
    """STR-3. marks: (day as timestamp, train, mark): N sticks, since N is the larger; days older than `keep` leave the state."""
    return marks.withWatermark("day", keep).groupBy("day", "train").agg(F.max("mark").alias("mark"))


def last_messages(log: DataFrame) -> DataFrame:
    """STR-4. log: (feed, received): the last message of each feed."""
    return log.groupBy("feed").agg(F.max("received").alias("last"), F.count("*").alias("n"))


def silences(log: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """STR-4. Sessions of messages: a feed is silent between two of them."""
    return log.withWatermark("received", gap).groupBy("feed", F.session_window("received", gap).alias("w")).agg(F.count("*").alias("n")).select("feed", F.col("w.start").alias("since"), F.col("w.end").alias("until"), "n")


def without_resends(conditions: DataFrame) -> DataFrame:
    """STR-6. One message of those with equal lift, start and status."""
    return conditions.withWatermark("start", LATE).dropDuplicatesWithinWatermark(["lift", "start", "status"])


def daily_counts(log: DataFrame) -> DataFrame:
    """STR-7. log: (received, lift): messages per day, as a tumbling window."""
    w = F.window("received", "1 day")
    return log.withWatermark("received", LATE).groupBy(w.alias("w")).agg(F.count("*").alias("messages")).select(F.to_date("w.start").alias("day"), "messages")


def run_available(stream: DataFrame, mode: str, state_store: str | None = None) -> DataFrame:
    """Runs a stream over what is there and gives back what it wrote, with the batch's number as `batch`. Output and
    checkpoint go to the shared folder (spark.checkpoint.dir). state_store: a state store for this stream only."""
    spark = stream.sparkSession
    path = f"{shared_folder(spark)}/stepspan-stream-{uuid.uuid4().hex}"

    def write(df: DataFrame, number: int) -> None:
        df.withColumn("batch", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(f"{path}/out/n={number}")

    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    if state_store:
        spark.conf.set(provider, state_store)
    try:
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    finally:
        spark.conf.set(provider, before)
    query.awaitTermination()
    schema = StructType([*stream.schema.fields, StructField("batch", LongType())])
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{path}/out")


def last_batch(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows written in update or complete mode, each key's last."""
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("x")).select(*keys, "x.*")
