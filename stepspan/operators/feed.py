"""Feed operators in batch: state at an instant, real changes, gaps, lags, drift, warnings."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest_conditions(conditions: DataFrame, keep: int = 3) -> DataFrame:
    """WIN-7, STR-6. conditions: (id, lift, status, start, end). A resend with the same start replaces the earlier message;
    of what is left the newest `keep` by start per lift."""
    last = conditions.groupBy("lift", "start").agg(F.max(F.struct("id", "status", "end")).alias("x")).select("lift", "start", "x.*")
    w = W.partitionBy("lift").orderBy(F.desc_nulls_last("start"))
    return last.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= keep).select("id", "lift", "status", "start", "end", "r")


def _cover(low: Column, high: Column) -> Column:
    """The places low to high - 1 as aligned blocks of 2 ** level places, two a level at most: (level, node)."""

    def of_level(j: Column) -> Column:
        a = F.call_function("shiftright", low + F.call_function("shiftleft", F.lit(1).cast("bigint"), j) - 1, j)
        b = F.call_function("shiftright", high, j)
        node = lambda keep, n: F.when((a < b) & (keep % 2 == 1), F.struct(j.alias("level"), n.alias("node")))
        return F.array(node(a, a), node(b, b - 1))

    levels = F.sequence(F.lit(0), F.call_function("ceil", F.log2(high + 2)).cast("int"))
    return F.filter(F.flatten(F.transform(levels, of_level)), lambda x: x.isNotNull())


def _places(conditions: DataFrame, instants: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lift, now, place, n): instants numbered from 0 within their lift, which has n; (lift, x, low, high): conditions with the places
    of the instants at which they are valid. Numbered within days, then the days of a lift are added up, so a window never holds more
    than a day of a lift."""
    us = F.unix_micros
    a = instants.select("lift", us("now").alias("t"), F.lit(2).alias("kind"), F.lit(None).cast("struct<s:bigint,id:bigint,status:string>").alias("x"), F.lit(None).cast("bigint").alias("other"))
    c = conditions.select("lift", us("start").alias("s"), us("end").alias("e"), F.struct(F.coalesce(us("start"), F.lit(0)).alias("s"), F.col("id").cast("bigint").alias("id"), "status").alias("x"))
    never = F.lit(2**62)
    ends = c.select("lift", "x", F.explode(F.array(F.struct(F.coalesce("s", -never).alias("t"), F.lit(0).alias("kind"), F.coalesce("e", never).alias("other")), F.struct(F.coalesce("e", never).alias("t"), F.lit(1).alias("kind"), F.coalesce("s", -never).alias("other")))).alias("b"))
    b = ends.select("lift", "b.t", "b.kind", "x", "b.other")
    both = a.unionByName(b).withColumn("day", F.floor(F.col("t") / 86_400_000_000))
    is_instant = (F.col("kind") == 2).cast("bigint")
    days = both.groupBy("lift", "day").agg(F.sum(is_instant).alias("k"))
    by_day = W.partitionBy("lift").orderBy("day")
    days = days.select("lift", "day", (F.sum("k").over(by_day) - F.col("k")).alias("before"), F.sum("k").over(W.partitionBy("lift")).alias("n"))
    upto = F.sum(is_instant).over(W.partitionBy("lift", "day").orderBy("t", "kind").rowsBetween(W.unboundedPreceding, 0))
    both = both.withColumn("upto", upto).join(days, ["lift", "day"]).withColumn("place", F.col("before") + F.col("upto"))
    numbered = both.filter("kind = 2").select("lift", F.timestamp_micros("t").alias("now"), (F.col("place") - 1).alias("place"), "n")
    low, high = F.min(F.when(F.col("kind") == 0, F.col("place"))), F.min(F.when(F.col("kind") == 1, F.col("place")))
    from_, to = F.when(F.col("kind") == 0, F.col("t")).otherwise(F.col("other")), F.when(F.col("kind") == 0, F.col("other")).otherwise(F.col("t"))
    ranges = both.filter("kind < 2").groupBy("lift", "x", from_.alias("a"), to.alias("b")).agg(low.alias("low"), high.alias("high"))
    return numbered, ranges.filter("low < high").select("lift", "x", "low", "high")


def status_at(conditions: DataFrame, instants: DataFrame) -> DataFrame:
    """JOIN-14. instants: (lift, now). The condition valid then, of several the one that starts last, then the largest id; none: unknown. An
    older condition comes back when a newer one ends. Interval stabbing without the product: a condition is cut into aligned blocks of
    instants, two a level at most; of a block only its best condition counts; an instant looks at the block it lies in on each
    level. Rows are instants and conditions times the logarithm of a lift's instants."""
    numbered, ranges = _places(conditions, instants.select("lift", "now").distinct())
    best = ranges.select("lift", "x", F.explode(_cover(F.col("low"), F.col("high"))).alias("b")).groupBy("lift", "b.level", "b.node").agg(F.max("x").alias("x"))
    levels = F.sequence(F.lit(0), F.call_function("ceil", F.log2(F.col("n") + 2)).cast("int"))
    blocks = numbered.select("lift", "now", "place", F.explode(levels).alias("level")).withColumn("node", F.call_function("shiftright", F.col("place"), F.col("level")))
    found = blocks.join(best, ["lift", "level", "node"]).groupBy("lift", "now").agg(F.max("x").alias("x"))
    return instants.join(found, ["lift", "now"], "left").select("lift", "now", F.coalesce("x.status", F.lit("unknown")).alias("status"))


def held_back(statuses: DataFrame, minutes: int = 30) -> DataFrame:
    """STR-2 in batch. statuses: (lift, now, status) at ticks. Out if not available; available but seen out less than `minutes`
    before: back."""
    w = W.partitionBy("lift").orderBy("now").rowsBetween(W.unboundedPreceding, 0)
    out = F.max(F.when(F.col("status") != "available", F.col("now"))).over(w)
    x = statuses.withColumn("last_out", out)
    back = F.unix_micros("now") - F.unix_micros("last_out") < minutes * 60_000_000
    return x.select("lift", "now", "status", F.when(F.col("status") != "available", F.col("status")).when(back, "back").alias("shown"))


def plausible(shown: DataFrame, least: int = 300) -> DataFrame:
    """PRJ-12. shown: (now, shown) with one row a lift: at least `least` lifts, at most half out; back is not out."""
    x = shown.groupBy("now").agg(F.count("*").alias("lifts"), F.count_if(F.col("shown").isNotNull() & (F.col("shown") != "back")).alias("out"))
    return x.withColumn("problem", F.when(F.col("lifts") < least, "too few lifts").when(F.col("out") * 2 > F.col("lifts"), "too many out"))


def gaps(log: DataFrame, minutes: int = 25) -> DataFrame:
    """WIN-2. log: (received). Silences longer than `minutes`. Gaps inside a day come from a window per day; those over days
    from the days' first and last rows, a short table."""
    x = log.withColumn("day", F.to_date("received"))
    inside = x.select("received", F.lag("received").over(W.partitionBy("day").orderBy("received")).alias("since"))
    days = x.groupBy("day").agg(F.min("received").alias("first"), F.max("received").alias("last"))
    over = days.select(F.col("first").alias("received"), F.lag("last").over(W.orderBy("day")).alias("since"))
    both = inside.unionByName(over).filter("since IS NOT NULL")
    return both.withColumn("seconds", F.unix_seconds("received") - F.unix_seconds("since")).filter(F.unix_micros("received") - F.unix_micros("since") > minutes * 60_000_000)


def beat_interval(log: DataFrame, minutes: int = 25) -> DataFrame:
    """WIN-3. The median of intervals shorter than `minutes`, per feed. log: (feed, received). Windows are of a feed's day; what
    lies between days comes from the days' first and last rows."""
    x = log.select("feed", "received", F.to_date("received").alias("day"))
    inside = x.select("feed", "received", F.lag("received").over(W.partitionBy("feed", "day").orderBy("received")).alias("since"))
    days = x.groupBy("feed", "day").agg(F.min("received").alias("first"), F.max("received").alias("last"))
    over = days.select("feed", F.col("first").alias("received"), F.lag("last").over(W.partitionBy("feed").orderBy("day")).alias("since"))
    both = inside.unionByName(over).select("feed", (F.unix_micros("received") - F.unix_micros("since")).alias("us")).filter(F.col("us") < minutes * 60_000_000)
    return both.groupBy("feed").agg(F.percentile("us", 0.5).alias("median_us"), F.count("*").alias("n"))


def real_changes(messages: DataFrame) -> DataFrame:
    """WIN-6. messages: (lift, id, status, full): a change message that differs from the last known status. Full states set
    the known status but do not count; what is first seen is no change."""
    w = W.partitionBy("lift").orderBy("id")
    return messages.withColumn("before", F.lag("status").over(w)).filter("NOT full AND before IS NOT NULL AND before <> status")


def lag_statistics(lags: DataFrame, seconds: int = 6 * 3600) -> DataFrame:
    """AGG-17. lags: (feed, lag in seconds), kept from 0 to `seconds`: the median, and the value at place floor(0.9 n)."""
    counted = lags.filter(F.col("lag").between(0, seconds)).groupBy("feed", "lag").agg(F.count("*").alias("n"))  # seconds + 1 rows a feed at most
    upto = F.sum("n").over(W.partitionBy("feed").orderBy("lag"))
    x = counted.select("feed", "lag", (upto - F.col("n")).alias("first"), (upto - 1).alias("last"), F.sum("n").over(W.partitionBy("feed")).alias("n"))

    def at(place: Column) -> Column:
        return F.max(F.when(place.between(F.col("first"), F.col("last")), F.col("lag")))

    half = [at(F.floor((F.col("n") - 1) / 2)), at(F.floor(F.col("n") / 2))]
    return x.groupBy("feed").agg(((half[0] + half[1]) / 2).alias("median"), at(F.floor(F.col("n") * 0.9)).alias("p90"), F.max("n").alias("n"))


def outage_ages(current: DataFrame, now: Column, lifts: DataFrame) -> DataFrame:
    """AGG-16. current: (lift, status, start, end), all that is not available counts; lifts: (lift, tracks). Outages by age: up to a day,
    up to 30 days, over 30 days, no start; of them with a planned end, and of lifts that serve a platform."""
    us = F.unix_micros(now) - F.unix_micros("start")
    day = 86_400_000_000
    bucket = F.when(F.col("start").isNull(), "no start").when(us <= day, "up to 1 day").when(us <= 30 * day, "up to 30 days").otherwise("over 30 days")
    serving = lifts.filter(F.size("tracks") > 0).select("lift", F.lit(True).alias("serves")).distinct()
    x = current.filter("status <> 'available'").join(serving, "lift", "left")
    return x.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.count("end").alias("planned_end"), F.count("serves").alias("serving"))


def _within(rows: DataFrame, periods: DataFrame, at: str) -> DataFrame:
    """rows with the period that they lie strictly inside of: an equi-join on days, of which a period touches few."""
    day = lambda c: F.floor(F.unix_micros(c) / 86_400_000_000)
    touched = periods.select("period", "begin", "until", F.explode(F.sequence(day("begin"), day("until"))).alias("__day"))
    return rows.withColumn("__day", day(at)).join(touched, "__day").filter((F.col(at) > F.col("begin")) & (F.col(at) < F.col("until"))).drop("__day")


def drift(full_states: DataFrame, changes: DataFrame, periods: DataFrame, silences: DataFrame) -> DataFrame:
    """AGG-19. What a full state that is published once a period misses until the next one. full_states: (period, id, lift, status), a
    lift may be listed several times, the message with the largest id is what is published; changes: (id, lift, at, status);
    periods: (period, begin, until), one after the other, numbered; silences: (since) of the log.

    Per period: changes, lifts that went out, lift-seconds and lifts on average that are out but shown working and the other way
    round (a lift that no full state listed is shown as unknown), messages of the next full state that differ from the replayed
    state, each listing of a lift for itself (null if no full state follows), and whether the log was silent in between."""
    published = full_states.groupBy("period", "lift").agg(F.max_by("status", "id").alias("status")).join(periods, "period")
    first = published.select("period", "lift", F.col("begin").alias("at"), F.lit(None).cast("bigint").alias("id"), "status", "begin", "until")
    inside = _within(changes.select("lift", "at", F.col("id").cast("bigint").alias("id"), "status"), periods, "at")
    steps = first.unionByName(inside.select(*first.columns))
    w = W.partitionBy("period", "lift").orderBy("at", F.asc_nulls_first("id"))
    x = steps.withColumn("next", F.coalesce(F.lead("at").over(w), F.col("until"))).withColumn("said", F.first(F.when(F.col("id").isNull(), F.col("status")).otherwise("unknown")).over(w))
    x = x.withColumn("last", F.lead("at").over(w).isNull())
    seconds = (F.unix_micros("next") - F.unix_micros("at")) / 1_000_000
    out, said_out, changed = F.col("status") != "available", F.col("said") != "available", F.col("id").isNotNull()
    told = x.groupBy("period").agg(
        F.count_if(changed).alias("changes"),
        F.countDistinct(F.when(changed & out, F.col("lift"))).alias("went_out"),
        F.sum(F.when(out & ~said_out, seconds).otherwise(0.0)).alias("working"),
        F.sum(F.when(~out & said_out, seconds).otherwise(0.0)).alias("broken"),
    )
    replayed = x.filter("last").select((F.col("period") + 1).alias("period"), "lift", F.col("status").alias("replayed"))
    against = full_states.join(replayed, ["period", "lift"], "left").groupBy((F.col("period") - 1).alias("period"))
    against = against.agg(F.count_if(~F.col("status").eqNullSafe(F.col("replayed"))).alias("differing"))
    quiet = _within(silences.select("since"), periods, "since").select("period").distinct().withColumn("silent", F.lit(True))
    span = (F.unix_micros("until") - F.unix_micros("begin")) / 1_000_000
    both = periods.join(told, "period").join(against, "period", "left").join(quiet, "period", "left")
    return both.select(
        "period", "changes", "went_out", F.round("working", 3).alias("shown_working"), F.round("broken", 3).alias("shown_out"),
        F.round(F.col("working") / span, 3).alias("mean_shown_working"), F.round(F.col("broken") / span, 3).alias("mean_shown_out"),
        "differing", F.coalesce("silent", F.lit(False)).alias("silent"),
    )


def track_number(track: Column) -> Column:
    """A track without the letters of its sector: 18a is on 18."""
    return F.regexp_replace(F.lower(track), "[a-z]+$", "")


def lift_warnings(stops: DataFrame, lifts: DataFrame, current: DataFrame) -> DataFrame:
    """JOIN-17. stops: (journey, place, station, track or null, role: start, change or end); lifts: (station, lift, tracks
    array, hall); current: (lift, shown) and maybe fresh, without which a status isn't trusted. A lift counts if it serves a used track
    (letters of both stripped), any track when that is unknown, a hall lift only at start or end; a stop takes its worst class:
    out, unknown, back."""
    rank = F.when(F.col("shown") == "notAvailable", 3).when(F.col("shown") == "unknown", 2).when(F.col("shown") == "back", 1)
    trusted = current.filter("fresh") if "fresh" in current.columns else current
    known = lifts.withColumn("tracks", F.transform("tracks", track_number)).join(trusted, "lift").withColumn("rank", rank).filter("rank IS NOT NULL")
    serves = F.when(F.col("hall"), F.col("role") != "change").otherwise(F.col("track").isNull() | (F.col("track") == "?") | F.coalesce(F.array_contains("tracks", track_number(F.col("track"))), F.lit(False)))
    x = stops.join(known, "station").filter(serves)
    worst = x.groupBy("journey", "place").agg(F.max("rank").alias("rank"), F.count("*").alias("lifts"))
    return worst.select("journey", "place", F.element_at(F.array(*map(F.lit, ("back", "unknown", "out"))), F.col("rank")).alias("warning"), "lifts")


def train_verdicts(marks: DataFrame, day: Column, days: int = 28) -> DataFrame:
    """AGG-12. marks: (date, train, mark). For a service day: marks of the same kind of day, the same yearly timetable, the
    last `days` days. Any N: false; three J and no N: true; else none."""
    from ..functions import scalars

    near = (F.col("date") < day) & (F.col("date") >= F.date_sub(day, days))
    alike = scalars.day_kind(F.col("date")).eqNullSafe(scalars.day_kind(day)) & (scalars.timetable_year(F.col("date")) == scalars.timetable_year(day))
    daily = marks.filter(near & alike).groupBy("train", "date").agg(F.max("mark").alias("mark"))
    x = daily.groupBy("train").agg(F.count_if(F.col("mark") == "N").alias("no"), F.count_if(F.col("mark") == "J").alias("yes"))
    return x.withColumn("verdict", F.when(F.col("no") > 0, False).when(F.col("yes") >= 3, True)).filter("verdict IS NOT NULL").select("train", "verdict")


def due(rows: Iterable[tuple], last: int | None, said: str | None, quiet_minutes: int) -> Iterator[tuple]:
    """STR-5's rule. rows: (tick, digest) in order; last, said: what was published before. Gives those to publish."""
    for tick, digest in rows:
        if last is None or digest != said or tick - last >= quiet_minutes:
            last, said = tick, digest
            yield tick, digest


def publish_ticks(ticks: DataFrame, quiet_minutes: int = 10) -> DataFrame:
    """STR-5. ticks: (feed, day, tick in minutes, digest) and maybe problem: keep a tick if its out-list differs from the last
    kept one, or quiet_minutes after that; a tick with a problem (see plausible) is never kept. Sequential inside a feed's
    day, so grouped in pandas; a day has 720 ticks of 2 minutes."""
    import pandas as pd

    if "problem" in ticks.columns:
        ticks = ticks.filter("problem IS NULL")

    def keep(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("tick")
        return pd.DataFrame([(*key, *x) for x in due(zip(pdf.tick, pdf.digest), None, None, quiet_minutes)], columns=["feed", "day", "tick", "digest"])

    kinds = ", ".join(f"{c} {ticks.schema[c].dataType.simpleString()}" for c in ("feed", "day", "tick", "digest"))
    return ticks.groupBy("feed", "day").applyInPandas(keep, kinds)


def snapshot_statuses(listed: DataFrame) -> DataFrame:
    """AGG-15. listed: (snapshot, lift, status, ...). snapshot, status, n: entries of each status in a full state; messages,
    lifts, doubled: all entries, different lifts, and lifts listed more than once."""
    lifts = listed.groupBy("snapshot", "lift").agg(F.count("*").alias("k"))
    whole = lifts.groupBy("snapshot").agg(F.sum("k").alias("messages"), F.count("*").alias("lifts"), F.count_if(F.col("k") > 1).alias("doubled"))
    return listed.groupBy("snapshot", "status").agg(F.count("*").alias("n")).join(whole, "snapshot").select("snapshot", "status", "n", "messages", "lifts", "doubled")


def status_combinations(listed: DataFrame) -> DataFrame:
    """AGG-15. listed: (snapshot, lift, status, end). snapshot, statuses, lifts: how often lifts listed more than once have this
    combination; a status with a planned end is another than one without."""
    mark = F.concat("status", F.when(F.col("end").isNotNull(), "+end").otherwise(""))
    x = listed.groupBy("snapshot", "lift").agg(F.array_sort(F.collect_list(mark)).alias("x")).filter("size(x) > 1")
    return x.groupBy("snapshot", F.array_join("x", "/").alias("statuses")).agg(F.count("*").alias("lifts"))
