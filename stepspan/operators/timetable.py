"""Timetable operators: rail trips, boardable calls, service days, day choice, day timetables, train sets."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars


def rail_trips(trips: DataFrame, excluded: tuple[str, ...] = ()) -> DataFrame:
    """PRJ-1. Route type 2 or 100..117, agency not excluded; a null agency drops out, as NOT IN has it."""
    kind = F.expr("try_cast(route_type AS int)")
    rail = (kind == 2) | kind.between(100, 117)
    return trips.filter(rail & (~F.col("agency").isin(*excluded) if excluded else F.col("agency").isNotNull()))


def boardable(calls: DataFrame) -> DataFrame:
    """PRJ-2. Calls where one can get on or off; a missing type means yes."""
    on, off = (F.coalesce(F.col(c), F.lit("0")) != "1" for c in ("pickup_type", "drop_off_type"))
    return calls.withColumn("can_board", on).withColumn("can_alight", off).filter("can_board OR can_alight")


def station_of_zone(stops: DataFrame, codes: DataFrame, prefix: str = "IFF:") -> DataFrame:
    """PRJ-3. stops: (stop_id, zone_id, ...). Adds the upper-case station code; keeps stops of the given codes."""
    code = F.upper(F.substring("zone_id", len(prefix) + 1, 100))
    return stops.filter(F.col("zone_id").startswith(prefix)).withColumn("code", code).join(codes.select("code"), "code", "left_semi")


def service_dates(calendar: DataFrame) -> DataFrame:
    """PRJ-4. calendar: (service, date text, exception_type) -> (service, date) of added days."""
    return calendar.filter(F.col("exception_type") == "1").select("service", F.to_date("date", "yyyyMMdd").alias("date"))


def in_train_set(agency: Column, category: Column, train_set: Column, verdict: Column, excluded_agencies: tuple, excluded_categories: tuple, own: tuple, local: tuple) -> Column:
    """PRJ-5. Excluded: no; set "all": yes; else a verdict if there is one; own agencies by local category; others: yes."""
    out = agency.isin(*excluded_agencies) | category.isin(*excluded_categories)
    return F.when(out, False).when(train_set == "all", True).when(verdict.isNotNull(), verdict).when(agency.isin(*own), category.isin(*local)).otherwise(True)


def in_only_by_verdict(agency: Column, category: Column, train_set: Column, verdict: Column, excluded_agencies: tuple, excluded_categories: tuple, own: tuple, local: tuple) -> Column:
    """PRJ-5. Whether a train is in a set that its agency and category alone would keep it out of."""
    rules = excluded_agencies, excluded_categories, own, local
    with_it, without = (F.coalesce(in_train_set(agency, category, train_set, v, *rules), F.lit(False)) for v in (verdict, F.lit(None).cast("boolean")))
    return with_it & ~without


def calls_per_station(calls: DataFrame) -> DataFrame:
    """AGG-1: distinct (trip, station)."""
    return calls.select("trip", "station").distinct()


def regular_stations(served: DataFrame, dates: DataFrame) -> DataFrame:
    """AGG-2. served: (date, station, calls). Stations served on at least half of all dates."""
    n = dates.select("date").distinct().agg(F.count("*").alias("all_dates"))
    days = served.groupBy("station").agg(F.countDistinct("date").alias("days"))
    return days.join(F.broadcast(n), F.col("days") * 2 >= F.col("all_dates")).select("station", "days")  # n is one row


def served_stations(calls: DataFrame, trips: DataFrame, dates: DataFrame) -> DataFrame:
    """(date, station, calls): calls are counted per service first, so calendar times calls is never spelled out."""
    per_service = calls_per_station(calls).join(trips.select("trip", "service"), "trip").groupBy("service", "station").agg(F.count("*").alias("calls"))
    return per_service.join(dates.distinct(), "service").groupBy("date", "station").agg(F.sum("calls").alias("calls"))


def date_scores(served: DataFrame, regular: DataFrame) -> DataFrame:
    """AGG-3. Per date: regular stations served, and calls there."""
    return served.join(regular.select("station"), "station").groupBy("date").agg(F.countDistinct("station").alias("stations"), F.sum("calls").cast("long").alias("calls"))


def choose_days(calls: DataFrame, trips: DataFrame, dates: DataFrame, today: date, horizon: int = 56) -> DataFrame:
    """TOP-1. day_type, date, stations, calls: the fullest Tuesday to Thursday and the fullest Saturday after today,
    before the next yearly timetable if there are any. Raises ValueError if a day type has no date."""
    window = dates.filter(F.col("date").between(F.lit(today + timedelta(1)), F.lit(today + timedelta(horizon))))
    served = served_stations(calls, trips, window)
    scores = date_scores(served, regular_stations(served, served))
    day = F.weekday("date")
    kind = F.when(day.between(1, 3), "weekday").when(day == 5, "saturday")
    late = F.col("date") >= scalars.timetable_change(F.lit(today))
    order = W.partitionBy("day_type").orderBy(late, F.desc("stations"), F.desc("calls"), "date")
    return scores.withColumn("day_type", kind).filter("day_type IS NOT NULL").withColumn("k", F.row_number().over(order)).filter("k = 1").select("day_type", "date", "stations", "calls")


def require_days(chosen: DataFrame) -> DataFrame:
    """TOP-1's check: both day types are there."""
    have = {r[0] for r in chosen.select("day_type").collect()}  # two rows at most
    if missing := {"weekday", "saturday"} - have:
        raise ValueError(f"no date for: {', '.join(sorted(missing))}")
    return chosen


def active_trips(trips: DataFrame, days: DataFrame) -> DataFrame:
    """JOIN-1. Trips of the chosen days. days: (day_type, date), a handful of rows, small enough for a broadcast."""
    return trips.join(F.broadcast(days.select("day_type", "date")), "date")


def day_timetable(calls: DataFrame, active: DataFrame) -> DataFrame:
    """JOIN-2/3. Calls of the active trips with board and alight flags, first calls not for getting off, last not for on."""
    x = calls.join(active.select("trip", "day_type"), "trip")
    trip = W.partitionBy("day_type", "trip")
    on, off = (F.coalesce(F.col(c), F.lit("0")) != "1" for c in ("pickup_type", "drop_off_type"))
    return x.select(
        "day_type", "trip", "seq", "station", "platform", "arr", "dep",
        (on & (F.col("seq") < F.max("seq").over(trip))).alias("can_board"),
        (off & (F.col("seq") > F.min("seq").over(trip))).alias("can_alight"),
    )


def station_dimension(stops: DataFrame, parents: DataFrame) -> DataFrame:
    """JOIN-4. stops: (code, parent); parents: (parent, name, lat, lon). One row a code, by its least parent."""
    one = stops.groupBy("code").agg(F.min("parent").alias("parent"))
    return one.join(parents, "parent", "left").select("code", "name", "lat", "lon")


def transfer_rules(transfers: DataFrame, platforms: DataFrame, active: DataFrame) -> DataFrame:
    """JOIN-5. transfers: (from_trip, to_trip, from_stop, to_stop, type); platforms: (stop, station, platform)."""
    a = platforms.select(F.col("stop").alias("from_stop"), "station", F.col("platform").alias("from_platform"))
    b = platforms.select(F.col("stop").alias("to_stop"), F.col("station").alias("to_station"), F.col("platform").alias("to_platform"))
    kind = F.when(F.col("type") == "0", "possible").when(F.col("type") == "1", "guaranteed").when(F.col("type") == "3", "impossible").otherwise("other")
    x = transfers.join(a, "from_stop").join(b, "to_stop").filter("station = to_station")
    for end in ("from_trip", "to_trip"):
        x = x.join(active.select(F.col("trip").alias(end)).distinct(), end, "left_semi")
    return x.select("from_trip", "to_trip", "station", "from_platform", "to_platform", kind.alias("kind"))


def neighbour_calls(calls: DataFrame) -> DataFrame:
    """WIN-1. Per trip: first and last call and their neighbours."""
    trip = W.partitionBy("trip").orderBy("seq")
    x = calls.select("trip", "seq", "station", "platform", "arr", "dep", F.lead("station").over(trip).alias("next"), F.lag("station").over(trip).alias("previous"), F.count("*").over(W.partitionBy("trip")).alias("n_calls"), F.row_number().over(trip).alias("k"))
    first, last = x.filter("k = 1"), x.filter("k = n_calls")
    a = first.select("trip", "n_calls", F.col("station").alias("first_station"), F.col("platform").alias("first_platform"), F.col("dep").alias("first_dep"), F.col("next").alias("second_station"))
    b = last.select("trip", F.col("station").alias("last_station"), F.col("platform").alias("last_platform"), F.col("arr").alias("last_arr"), F.col("previous").alias("before_last_station"))
    return a.join(b, "trip")


def patterns(calls: DataFrame) -> DataFrame:
    """ROUTE-6. Trips by their ordered list of platforms: pattern text, trips, stops."""
    per_trip = calls.groupBy("trip").agg(F.array_sort(F.collect_list(F.struct("seq", "platform"))).alias("x"))
    text = F.array_join(F.transform("x", lambda s: s.platform.cast("string")), "-")
    return per_trip.select("trip", text.alias("pattern"), F.size("x").alias("stops")).groupBy("pattern").agg(F.count("*").alias("trips"), F.first("stops").cast("long").alias("stops"))


def departures(calls: DataFrame, start: int, end: int) -> DataFrame:
    """ROUTE-7. Distinct boardable times at a station within a window, not at a trip's last call. calls: with can_board."""
    return calls.filter(F.col("can_board") & F.col("dep").between(start, end)).select("station", "dep").distinct()
