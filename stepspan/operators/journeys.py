"""Journeys: change minutes, through trains, earliest arrivals with at most k trains, journey sets, summaries.

The search keeps, for every origin and platform, the Pareto front of (departure, arrival). A round boards trains at once
for all labels: along a platform's times, a departure takes the best label that is ready (an as-of join by union and
window), so each call meets one label per origin, not all earlier ones. Riding is a join on the trip and a maximum. Rows per
round are at most origins times calls, whatever the number of departures, and a label has a fixed size: it points to the label
it goes on from. Legs are put together at the end, for the journeys that are left.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.lineage import checkpointed, staged

PLATFORM = ["variant", "origin", "platform"]
#: Slices of the stations that a traveller's choices are dealt out to.
SLICES = 16
#: Slices of a hub's labels, by their last trains.
HUB_SLICES = 32
#: Most rows of a broadcast; beyond it joins shuffle.
BROADCAST_ROWS = 1_000_000


def shortest_allowed(calls: DataFrame, rules: DataFrame) -> DataFrame:
    """JOIN-11. rules: (from_trip, to_trip, station, kind). Least minutes between two trips that may connect, per platform
    pair; a trip that calls twice at the station counts with its last call."""
    last = calls.groupBy("trip", "station").agg(F.max(F.struct("seq", "platform", "arr", "dep")).alias("x")).select("trip", "station", "x.*")
    a = last.select(F.col("trip").alias("from_trip"), "station", F.col("platform").alias("from_platform"), "arr")
    b = last.select(F.col("trip").alias("to_trip"), "station", F.col("platform").alias("to_platform"), "dep")
    x = rules.filter("kind <> 'impossible' AND from_trip <> to_trip").select("from_trip", "to_trip", "station").join(a, ["from_trip", "station"]).join(b, ["to_trip", "station"])
    return x.filter("dep >= arr").groupBy("station", "from_platform", "to_platform").agg(F.min(F.col("dep") - F.col("arr")).alias("allowed"))


def change_minutes(platforms: DataFrame, defaults: DataFrame, allowed: DataFrame, same_surface: int = 2, pram_extra: int = 3) -> DataFrame:
    """JOIN-10. platforms: (station, platform, surface, step_free); defaults: (station, minutes). Pairs inside a station for
    both profiles: 2 minutes on one surface, else the station's default (0 or none: 2), at most the shortest allowed
    connection; the pram takes pram_extra more and leaves out pairs between surfaces with a platform that is not step-free."""
    a = platforms.select("station", F.col("platform").alias("from_platform"), F.col("surface").alias("fs"), F.col("step_free").alias("ff"))
    b = platforms.select("station", F.col("platform").alias("to_platform"), F.col("surface").alias("ts"), F.col("step_free").alias("tf"))
    # a platform takes its shortest connections along, so that the pairs, which are the result, are not shuffled
    least = allowed.groupBy("station", "from_platform", "to_platform").agg(F.min("allowed").alias("allowed"))
    least = least.groupBy("station", "from_platform").agg(F.map_from_entries(F.collect_list(F.struct("to_platform", "allowed"))).alias("least"))
    a = a.join(least, ["station", "from_platform"], "left").join(defaults, "station", "left")
    x = a.join(b, "station").withColumn("allowed", F.try_element_at("least", F.col("to_platform")))
    plain = F.when(F.col("minutes") > 0, F.col("minutes")).otherwise(same_surface)
    base = F.least(F.when(F.col("fs") == F.col("ts"), same_surface).otherwise(plain), F.col("allowed"))
    x = x.withColumn("profile", F.explode(F.array(F.lit("any"), F.lit("stroller"))))
    x = x.filter((F.col("profile") == "any") | (F.col("fs") == F.col("ts")) | (F.col("ff") & F.col("tf")))
    return x.select("profile", "station", "from_platform", "to_platform", (base + F.when(F.col("profile") == "any", 0).otherwise(pram_extra)).cast("int").alias("minutes"))


def change_hubs(platforms: DataFrame, defaults: DataFrame, allowed: DataFrame, same_surface: int = 2, pram_extra: int = 3) -> tuple[DataFrame, DataFrame]:
    """JOIN-10 without its pairs, for search: hubs (profile, platform, hub, minutes): from any platform of a hub to any in the
    station's default; changes (profile, from_platform, to_platform, minutes): pairs on one surface and shortest allowed
    connections, and all pairs of stations whose default is below same_surface, which have no hub. The least of both is
    change_minutes."""
    profile = F.explode(F.array(F.lit("any"), F.lit("stroller"))).alias("profile")
    extra = F.when(F.col("profile") == "any", 0).otherwise(pram_extra)
    x = platforms.join(defaults, "station", "left").withColumn("plain", F.when(F.col("minutes") > 0, F.col("minutes")).otherwise(same_surface))
    slow, quick = x.filter(F.col("plain") >= same_surface), x.filter(F.col("plain") < same_surface).select(*platforms.columns)
    hubs = slow.select("*", profile).filter("profile = 'any' OR step_free").select("profile", "platform", F.col("station").alias("hub"), (F.col("plain") + extra).cast("int").alias("minutes"))
    a = slow.select("station", F.col("platform").alias("from_platform"), F.col("surface").alias("fs"), F.col("step_free").alias("ff"))
    b = slow.select("station", F.col("platform").alias("to_platform"), F.col("surface").alias("ts"), F.col("step_free").alias("tf"))
    near = a.join(b.withColumn("fs", F.col("ts")), ["station", "fs"]).select("station", "from_platform", "to_platform", F.lit(True).alias("same"), F.lit(True).alias("free"), F.lit(same_surface).alias("base"))
    known = allowed.join(a, ["station", "from_platform"]).join(b, ["station", "to_platform"])
    known = known.select("station", "from_platform", "to_platform", (F.col("fs") == F.col("ts")).alias("same"), (F.col("ff") & F.col("tf")).alias("free"), F.col("allowed").alias("base"))
    pairs = near.unionByName(known).select("*", profile).filter("profile = 'any' OR same OR free")
    pairs = pairs.groupBy("profile", "from_platform", "to_platform").agg((F.min("base") + F.max(extra)).cast("int").alias("minutes"))
    return hubs, pairs.unionByName(change_minutes(quick, defaults, allowed, same_surface, pram_extra).drop("station"))


def continuations(calls: DataFrame, rules: DataFrame | None = None, longest: int = 5) -> DataFrame:
    """ROUTE-1. (from_trip, to_trip): A ends where B starts, same platform, 0 to longest minutes later, the rule allows it, B
    does not go back to A's station before; an A with several such rows has none. Without rules every pair is allowed; then
    ends meet starts by platform and slice of time, so pairs further apart are never made."""
    from .timetable import neighbour_calls

    n = neighbour_calls(calls).filter("n_calls >= 2")
    a = n.select(F.col("trip").alias("from_trip"), "last_station", "last_platform", "last_arr", "before_last_station")
    b = n.select(F.col("trip").alias("to_trip"), "first_station", "first_platform", "first_dep", "second_station")
    if rules is None:
        slice_of = lambda c: F.floor(F.col(c) / (longest + 1))
        a = a.withColumn("slice", F.explode(F.array(slice_of("last_arr"), slice_of("last_arr") + 1)))
        b = b.withColumn("slice", slice_of("first_dep"))
        x = a.join(b, (a["last_platform"] == b["first_platform"]) & (a["slice"] == b["slice"])).filter("from_trip <> to_trip")
    else:
        x = rules.filter(F.col("kind").isin("possible", "guaranteed")).select("from_trip", "to_trip").join(a, "from_trip").join(b, "to_trip")
    x = x.filter((F.col("last_station") == F.col("first_station")) & (F.col("last_platform") == F.col("first_platform")) & (F.col("first_dep") - F.col("last_arr")).between(0, longest) & (F.col("second_station") != F.col("before_last_station")))
    one = F.count("*").over(W.partitionBy("from_trip"))
    return x.select("from_trip", "to_trip", one.alias("n")).filter("n = 1").select("from_trip", "to_trip")


def chains(trips: DataFrame, links: DataFrame, most_rounds: int = 20) -> DataFrame:
    """ROUTE-2. (trip, chain, place): each merged chain, named by its trips with "+" between, by doubling: a path of up to
    2**n trips after n rounds. Two chains may share their tail. Raises on cycles and on longer chains."""
    heads = trips.select("trip").join(links.select(F.col("to_trip").alias("trip")), "trip", "left_anti")
    step = checkpointed(links.select(F.col("from_trip").alias("a"), F.array("to_trip").alias("path")))
    for _ in range(most_rounds):
        after = step.select(F.col("a").alias("end"), F.col("path").alias("more"))
        step = checkpointed(step.join(after, F.element_at("path", -1) == F.col("end"), "left").select("a", F.when(F.col("more").isNull(), F.col("path")).otherwise(F.concat("path", "more")).alias("path"), F.col("more").isNotNull().alias("grew")))
        if not step.filter("grew").limit(1).count():
            break
        step = step.drop("grew")
    else:
        raise ValueError("through trains form a cycle")
    whole = heads.join(step, heads["trip"] == step["a"], "left").select(F.concat(F.array("trip"), F.coalesce("path", F.expr("array()").cast("array<bigint>"))).alias("path"))
    name = F.array_join(F.transform("path", lambda t: t.cast("string")), "+")
    return whole.select(name.alias("chain"), F.posexplode("path").alias("place", "trip"))


def merged_calls(calls: DataFrame, chained: DataFrame) -> DataFrame:
    """ROUTE-2. Calls of the chains, renumbered; a joint stop takes the first train's arrival and the second's departure."""
    x = calls.join(chained, "trip")
    order = W.partitionBy("chain").orderBy("place", "seq")
    flags = [c for c in ("can_board", "can_alight") if c in calls.columns]
    x = x.select("chain", "place", "seq", "station", "platform", "arr", "dep", *flags, *[F.lag(c).over(order).alias("alight_before") for c in flags[1:]], F.lag("place").over(order).alias("before"), F.lag("arr").over(order).alias("arr_before"), F.lead("place").over(order).alias("after"))
    joint_first = F.col("after").isNotNull() & (F.col("after") > F.col("place"))
    joint_second = F.col("before").isNotNull() & (F.col("before") < F.col("place"))
    x = x.filter(~joint_first).withColumn("arr", F.when(joint_second, F.col("arr_before")).otherwise(F.col("arr")))
    if flags:
        x = x.withColumn("can_alight", F.when(joint_second, F.col("alight_before")).otherwise(F.col("can_alight")))
    n = F.count("*").over(W.partitionBy("chain"))
    return x.select("chain", F.row_number().over(order).alias("seq"), "station", "platform", "arr", "dep", *flags, n.alias("n")).filter("n >= 2").drop("n")


def next_departure(ready: DataFrame, departures: DataFrame, keys: list[str]) -> DataFrame:
    """JOIN-13. ready: (id, keys, at); departures: (keys, dep, trip). The first departure at or after each time, as-of
    forward: both in falling order, and the last departure up to each row (of several at one minute the least trip). A frame
    that ends at the row runs along; one that begins there would be read anew for each row."""
    least = departures.groupBy(*keys, "dep").agg(F.min("trip").alias("trip"))
    a = ready.select("id", *keys, F.col("at").alias("t"), F.lit(0).alias("kind"), F.lit(None).cast("struct<dep:int,trip:bigint>").alias("x"))
    b = least.select(F.lit(None).cast(ready.schema["id"].dataType).alias("id"), *keys, F.col("dep").alias("t"), F.lit(1).alias("kind"), F.struct(F.col("dep").cast("int").alias("dep"), F.col("trip").cast("bigint").alias("trip")).alias("x"))
    w = W.partitionBy(*keys).orderBy(F.desc("t"), F.desc("kind")).rowsBetween(W.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("n", F.last("x", ignorenulls=True).over(w)).filter("kind = 0")
    return both.select("id", *keys, F.col("t").alias("at"), "n.dep", "n.trip")


def pareto(labels: DataFrame, keys: list[str], late: str, early: str) -> DataFrame:
    """WIN-4. Rows whose `early` is strictly smaller than that of every row with a larger `late` (and the least of equals).
    labels have one row per key and late at most."""
    w = W.partitionBy(*keys).orderBy(F.desc(late)).rowsBetween(W.unboundedPreceding, -1)
    best = F.min(early).over(w)
    return labels.withColumn("__best", best).filter(F.col("__best").isNull() | (F.col(early) < F.col("__best"))).drop("__best")


#: What names a label of a variant and origin: how many trains it takes, its last train and where that is left.
KEY = ["trains", "trip", "a_seq"]
LABEL = ["variant", "origin", "platform", "station", *KEY, "tau", "arr", "b_platform", "b_station", "b_dep", "prev"]
_PREV = "struct<trains:int,trip:bigint,a_seq:int>"


def skyband(labels: DataFrame, early: str, depth: int, keys: list[str] = PLATFORM) -> DataFrame:
    """WIN-4 by layers: labels that fewer than `depth` labels of other last trains beat (a departure at least as late, `early`
    at least as small). The first layer is the Pareto front, each further one the front of the rest. A departure that may not
    take up to depth - 1 trains always finds its best label here: a label outside has a beating one in each layer, all of
    different last trains, as a label that its own train beats goes first. All layers come from one sort."""
    rows = labels
    if depth > 1:
        rows = pareto(rows.groupBy(*keys, "trip", "tau").agg(F.min_by(F.struct(*[c for c in labels.columns if c not in (*keys, "trip", "tau")]), F.struct(early, "trains", "a_seq")).alias("x")).select(*keys, "trip", "tau", "x.*"), [*keys, "trip"], "tau", early)
    w = W.partitionBy(*keys).orderBy(F.desc("tau"), early, *KEY).rowsBetween(W.unboundedPreceding, -1)
    rest = F.lit(True)
    for i in range(depth):
        best = F.min(F.when(rest, F.col(early))).over(w)
        rows = rows.withColumn(f"__in{i}", rest & (best.isNull() | (F.col(early) < best)))
        rest = rest & ~F.col(f"__in{i}")
    flags = [f"__in{i}" for i in range(depth)]
    return rows.filter(" OR ".join(flags)).select(*labels.columns)


def _bars(forbidden: DataFrame, variants: DataFrame) -> DataFrame:
    """(variant, trip, barred): the last trains that a train may not be reached from. forbidden without variant holds for all."""
    pairs = forbidden if "variant" in forbidden.columns else forbidden.crossJoin(F.broadcast(variants))  # variants are the traveller's few
    return pairs.groupBy("variant", F.col("to_trip").alias("trip")).agg(F.collect_set("from_trip").alias("barred"))


def search(calls: DataFrame, changes: DataFrame, starts: DataFrame, window: tuple[int, int], latest: int, trains: int = 3, forbidden: DataFrame | None = None, hubs: DataFrame | None = None, ends: DataFrame | None = None) -> DataFrame:
    """ROUTE-3, JOIN-12. LABEL and k: labels with at most k trains, per origin and platform; of fixed size whatever k: a label names the
    one it goes on from (prev), journeys() rebuilds the legs.

    calls: (variant, trip, seq, station, platform, arr, dep, can_board, can_alight); changes: (variant, from_platform,
    to_platform, minutes), a platform to itself included; starts: (variant, platform) where one may set out; forbidden:
    (from_trip, to_trip) and maybe variant: one may not change from the one to the other, at any station. Labels are kept as far as a
    departure could need them (skyband). Ties are broken by the number of trains and then by the keys, in a fixed order.

    hubs: (variant, platform, hub, minutes), one hub a platform at most: a change between any two platforms of a hub, so that
    changes need only hold what is quicker or outside. ends: (variant, platform, station), as in journeys(): of the last round
    only the labels that journeys() to these would take are kept. With both, the last round goes by hubs (_last_hub_round). calls without variant
    hold for all variants of starts; times never fall along a train.
    """
    by_hubs = hubs is not None and ends is not None and trains > 1
    if "variant" not in calls.columns and not (by_hubs and trains == 2 and (forbidden is None or "variant" not in forbidden.columns)):
        calls = calls.crossJoin(F.broadcast(starts.select("variant").distinct()))  # variants are the traveller's few
    if by_hubs and trains == 2:
        return _two_trains(calls, changes, starts, window, latest, forbidden, hubs, ends)
    ride = calls.filter(F.col("can_alight") & (F.col("arr") <= latest)).select("variant", "trip", F.col("seq").alias("a_seq"), "station", "platform", "arr")
    board = calls.filter("can_board").select("variant", "trip", "seq", F.col("station").alias("b_station"), F.col("platform").alias("b_platform"), F.col("dep").alias("b_dep"))
    bars, depth = None, 1
    if forbidden is not None:
        bars = checkpointed(_bars(forbidden, calls.select("variant").distinct()))
        depth = 1 + (bars.agg(F.max(F.size("barred"))).first()[0] or 0)
    first = board.filter(F.col("b_dep").between(*window)).join(starts.select("variant", F.col("platform").alias("b_platform")), ["variant", "b_platform"], "left_semi")
    boarded = first.select("*", F.col("b_station").alias("origin"), F.col("b_dep").alias("tau"), F.lit(None).cast(_PREV).alias("prev"))
    best, out = None, None
    for k in range(1, trains + 1):
        if k == trains and ends is not None and best is not None:
            return out.unionByName(_last_round(boarded, best, ends, k).withColumn("k", F.lit(k)))
        x = boarded.join(ride, ["variant", "trip"]).filter("a_seq > seq")
        # of one train, the boarding with the latest departure from the origin is best
        x = x.groupBy("variant", "origin", "trip", "a_seq", "station", "platform", "arr").agg(F.max(F.struct("tau", "b_dep", "b_platform", "b_station", "prev")).alias("x"))
        x = x.withColumn("trains", F.lit(k)).select("*", "x.*").select(*LABEL)
        best = checkpointed(skyband(x if best is None else best.unionByName(x), "arr", depth))
        labels = best.withColumn("k", F.lit(k))
        out = labels if out is None else out.unionByName(labels)
        if k < trains:
            if k + 1 == trains and by_hubs:
                rides = staged(_rides(calls, latest, bars))
                last = _last_hub_round(best.filter(F.col("trains") == k), best, rides, changes, hubs, ends, depth, trains)
                return out.unionByName(last.withColumn("k", F.lit(trains)))
            if k + 1 == trains and ends is not None:  # the last round takes the rides along
                stops = ride.join(ends.select("variant", "platform", F.col("station").alias("dest")), ["variant", "platform"])
                stops = stops.groupBy("variant", "trip").agg(F.collect_list(F.struct("a_seq", "station", "platform", "arr", "dest")).alias("later"))
                board = board.join(stops, ["variant", "trip"]).withColumn("later", F.filter("later", lambda r: r["a_seq"] > F.col("seq"))).filter("size(later) > 0")
            if hubs is not None:
                boarded = _hub_boarding(best.filter(F.col("trains") == k), changes, hubs, board, bars, depth)
                continue
            moved = best.filter(F.col("trains") == k).join(changes.select("variant", F.col("from_platform").alias("platform"), "to_platform", "minutes"), ["variant", "platform"])
            ready = moved.select("variant", "origin", F.col("to_platform").alias("platform"), "tau", (F.col("arr") + F.col("minutes")).alias("ready"), *KEY)
            ready = skyband(ready.groupBy(*PLATFORM, "tau", *KEY).agg(F.min("ready").alias("ready")), "ready", depth)
            boarded = _as_of_boarding(checkpointed(ready), board.drop("later"), bars)
            if "later" in board.columns:
                boarded = boarded.join(board.select("variant", "trip", "seq", "later"), ["variant", "trip", "seq"])
    return out


def _small(df: DataFrame) -> DataFrame:
    """df, broadcast if it has few rows. df is a checkpoint."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _last_round(boarded: DataFrame, best: DataFrame, ends: DataFrame, k: int) -> DataFrame:
    """The labels of the last round that journeys() takes: per origin, station and departure one with the least arrival, where it
    is on the front. boarded: with later, the stops after each boarding. The least arrivals come first, by a hash aggregate; they
    say which of all rides are looked at again with what they went on from."""
    to = ends.select("variant", "platform", F.col("station").alias("dest"))
    rides = boarded.select("*", F.explode("later").alias("r")).select("variant", "origin", "trip", "tau", "b_dep", "b_platform", "b_station", "prev", "r.*").filter("origin <> dest")
    rides = rides.withColumn("trains", F.lit(k)).select(*LABEL, "dest")
    earlier = best.join(to, ["variant", "platform"]).filter("origin <> dest").select(*LABEL, "dest")
    all_ = rides.unionByName(earlier)
    keys = ["variant", "origin", "dest"]
    front = _small(checkpointed(pareto(all_.groupBy(*keys, "tau").agg(F.min("arr").alias("arr")), keys, "tau", "arr")))
    x = all_.join(front, [*keys, "tau", "arr"]).groupBy(*keys, "tau").agg(F.min(F.struct("arr", *KEY, "platform", "station", "b_platform", "b_station", "b_dep", "prev")).alias("x"))
    return checkpointed(x.select("variant", "origin", "tau", "x.*").select(*LABEL).distinct())


def _hub_boarding(new: DataFrame, changes: DataFrame, hubs: DataFrame, board: DataFrame, bars: DataFrame | None, depth: int) -> DataFrame:
    """As _as_of_boarding, of new labels by hubs and changes. All platforms of a hub have the same labels ready, so the best one and
    the best of another last train are found once for each minute of a hub. A change inside a hub gives a label no more
    than the minutes by which it is quicker than the hub; changes outside go by platform."""
    hub_of = hubs.select("variant", "platform", "hub", F.col("minutes").alias("hub_minutes"))
    x = new.join(hub_of, ["variant", "platform"]).select("variant", "origin", F.col("hub").alias("platform"), "tau", (F.col("arr") + F.col("hub_minutes")).alias("ready"), *KEY)
    x = skyband(x.withColumn("slice", F.pmod(F.hash("trip"), F.lit(HUB_SLICES))), "ready", depth, [*PLATFORM, "slice"]).drop("slice")
    ready = checkpointed(skyband(x, "ready", depth))
    at = board.join(hub_of.withColumnRenamed("platform", "b_platform"), ["variant", "b_platform"], "left")
    at = at.join(bars, ["variant", "trip"], "left") if bars is not None else at.withColumn("barred", F.lit(None).cast("array<bigint>"))
    # the best labels of a hub's minutes
    times = at.filter("hub IS NOT NULL").select("variant", F.col("hub").alias("platform"), F.col("b_dep").alias("t")).distinct()
    met = ready.select(*PLATFORM).distinct().join(times, ["variant", "platform"]).withColumn("label", F.lit(None).cast("struct<tau:int,trains:int,trip:bigint,a_seq:int>"))
    a = ready.select(*PLATFORM, F.col("ready").alias("t"), F.struct(F.col("tau").cast("int").alias("tau"), F.col("trains").cast("int").alias("trains"), F.col("trip").cast("bigint").alias("trip"), F.col("a_seq").cast("int").alias("a_seq")).alias("label"))
    both = a.withColumn("kind", F.lit(0)).unionByName(met.withColumn("kind", F.lit(1)))
    order = W.partitionBy(*PLATFORM).orderBy("t", "kind", "label")
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    both = both.withColumn("best", F.max("label").over(upto)).withColumn("before", F.lag("best").over(order))
    passed = F.when(F.col("label").isNotNull() & F.col("before").isNotNull() & (F.col("label.trip") != F.col("before.trip")), F.least("before", "label"))
    both = both.withColumn("second", F.max(passed).over(upto)).filter("kind = 1 AND best IS NOT NULL")
    bests = _small(checkpointed(both.select("variant", "origin", F.col("platform").alias("hub"), "t", "best", "second")))

    own = ["variant", "b_platform", "trip", "seq", "b_station", "b_dep"]

    def taken(rows: DataFrame, label: Column) -> DataFrame:
        prev = F.struct(label["trains"].alias("trains"), label["trip"].alias("trip"), label["a_seq"].alias("a_seq"))
        return rows.select(*own, "origin", label["tau"].alias("tau"), prev.alias("prev"))

    single = at.filter("barred IS NULL OR size(barred) <= 1").join(bests.withColumnRenamed("t", "b_dep"), ["variant", "hub", "b_dep"])
    free = F.col("barred").isNull() | (F.col("best.trip") != F.col("barred")[0])
    out = taken(single.withColumn("label", F.when(free, F.col("best")).otherwise(F.col("second"))).filter("label IS NOT NULL"), F.col("label"))
    if depth > 2:
        several = at.filter("size(barred) > 1").join(ready.select("variant", "origin", F.col("platform").alias("hub"), "ready", F.struct("tau", *KEY).alias("label")), ["variant", "hub"])
        several = several.filter("ready <= b_dep AND NOT array_contains(barred, label.trip)").groupBy(*own, "origin").agg(F.max("label").alias("label"))
        out = out.unionByName(taken(several, F.col("label")))
    ends = [hub_of.select("variant", F.col("platform").alias(f"{e}_platform"), F.col("hub").alias(f"{e}_hub"), F.col("hub_minutes").alias(f"{e}_minutes")) for e in ("from", "to")]
    c = changes.select("variant", "from_platform", "to_platform", "minutes").join(ends[0], ["variant", "from_platform"], "left").join(ends[1].drop("to_minutes"), ["variant", "to_platform"], "left")
    inside = F.coalesce(F.col("from_hub") == F.col("to_hub"), F.lit(False))
    c = checkpointed(c.withColumn("inside", inside).filter("NOT inside OR minutes < from_minutes"))
    moved = new.withColumnRenamed("platform", "from_platform").join(c, ["variant", "from_platform"])
    # inside a hub: from when the label is ready until the hub has it ready too
    minute = F.explode(F.sequence(F.col("arr") + F.col("minutes"), F.col("arr") + F.col("from_minutes") - 1))
    near = moved.filter("inside").select("variant", "origin", F.col("from_hub").alias("hub"), F.col("to_platform").alias("b_platform"), F.struct("tau", *KEY).alias("label"), minute.alias("b_dep"))
    if depth <= 2:  # a label no better than the best two of the hub helps no departure that is barred from one train
        near = near.join(bests.withColumnRenamed("t", "b_dep"), ["variant", "hub", "b_dep", "origin"], "left").filter("second IS NULL OR label.tau > second.tau").drop("best", "second")
    near = near.join(at.drop("hub", "hub_minutes"), ["variant", "b_platform", "b_dep"]).filter("barred IS NULL OR NOT array_contains(barred, label.trip)")
    out = out.unionByName(taken(near, F.col("label")))
    far = moved.filter("NOT inside").select("variant", "origin", F.col("to_platform").alias("platform"), "tau", (F.col("arr") + F.col("minutes")).alias("ready"), *KEY)
    far = skyband(far.groupBy(*PLATFORM, "tau", *KEY).agg(F.min("ready").alias("ready")), "ready", depth)
    far = _as_of_boarding(checkpointed(far), board, bars)
    return out.unionByName(far.select(*out.columns))


def _rides(calls: DataFrame, latest: int, bars: DataFrame | None) -> DataFrame:
    """All rides of all trains: (variant if calls have one, trip, barred, seq, b_station, b_platform, b_dep, a_seq, station, platform, arr)."""
    by = [c for c in ("variant", "trip") if c in calls.columns]
    on = calls.filter("can_board").select(*by, "seq", F.col("station").alias("b_station"), F.col("platform").alias("b_platform"), F.col("dep").cast("int").alias("b_dep"))
    off = calls.filter(F.col("can_alight") & (F.col("arr") <= latest)).select(*by, F.col("seq").alias("a_seq"), "station", "platform", F.col("arr").cast("int").alias("arr"))
    x = on.join(off, by).filter("a_seq > seq")
    return x.join(bars, by, "left") if bars is not None else x.withColumn("barred", F.lit(None).cast("array<bigint>"))


def _two_trains(calls: DataFrame, changes: DataFrame, starts: DataFrame, window: tuple[int, int], latest: int, forbidden: DataFrame | None, hubs: DataFrame, ends: DataFrame) -> DataFrame:
    """search() with two trains by hubs. The labels of the first round are the rides themselves, which are written once and read
    again; of them only those are given that journeys() takes, or that a label of two trains goes on from."""
    bars, depth = None, 1
    if forbidden is not None:
        bars = _bars(forbidden, calls.select("variant").distinct()) if "variant" in calls.columns else forbidden.groupBy(F.col("to_trip").alias("trip")).agg(F.collect_set("from_trip").alias("barred"))
    rides = staged(_rides(calls, latest, bars))
    if bars is not None:
        depth = 1 + max(0, rides.agg(F.max(F.size("barred"))).first()[0] or 0)
    at = ["variant", "b_platform"] if "variant" in calls.columns else ["b_platform"]
    starts = _small(checkpointed(starts.select("variant", F.col("platform").alias("b_platform")).distinct()))
    first = rides.filter(F.col("b_dep").between(*window)).join(starts, at)
    first = first.withColumns({"origin": F.col("b_station"), "tau": F.col("b_dep"), "trains": F.lit(1), "prev": F.lit(None).cast(_PREV)}).select(*LABEL)
    last = _last_hub_round(first, first, rides, changes, hubs, ends, depth, 2)
    to = _small(checkpointed(ends.select("variant", "platform", F.col("station").alias("dest"))))
    keys = ["variant", "origin", "dest"]
    direct = first.join(to, ["variant", "platform"]).filter("origin <> dest")
    front = _small(checkpointed(pareto(direct.groupBy(*keys, "tau").agg(F.min("arr").alias("arr")), keys, "tau", "arr")))
    front = direct.join(front, [*keys, "tau", "arr"]).groupBy(*keys, "tau").agg(F.min(F.struct("trip", "a_seq")).alias("x"))
    wanted = front.select("variant", "origin", "x.*").unionByName(last.filter("prev IS NOT NULL").select("variant", "origin", "prev.trip", "prev.a_seq"))
    label = ["variant", "origin", "trip", "a_seq"]
    # of one train, the boarding with the latest departure from the origin is best
    rest = [c for c in LABEL if c not in label and c != "tau"]
    got = first.join(_small(checkpointed(wanted.distinct())), label).groupBy(*label).agg(F.max(F.struct("tau", *rest)).alias("x")).select(*label, "x.*")
    return checkpointed(got.select(*LABEL)).withColumn("k", F.lit(1)).unionByName(last.withColumn("k", F.lit(2)))


def _hub_labels(new: DataFrame, hub_of: DataFrame, depth: int) -> DataFrame:
    """For each departure from an origin, the labels that a hub has ready first, of depth different last trains: no departure there
    can need another. Least minutes come first, by a hash aggregate; they say which labels are looked at again."""
    keys = ["variant", "origin", "hub", "tau"]
    there = new.join(hub_of, ["variant", "platform"]).select(*keys, (F.col("arr") + F.col("hub_minutes")).alias("ready"), *KEY)
    out = None
    for _ in range(depth):
        left = there
        if out is not None:
            left = there.join(_small(checkpointed(out.groupBy(*keys).agg(F.collect_set("trip").alias("taken")))), keys).filter("NOT array_contains(taken, trip)").drop("taken")
        least = _small(checkpointed(left.groupBy(*keys).agg(F.min("ready").alias("ready"))))
        layer = left.join(least, [*keys, "ready"]).groupBy(*keys).agg(F.min(F.struct("ready", *KEY)).alias("x")).select(*keys, "x.*")
        out = checkpointed(layer if out is None else out.unionByName(layer))
    return out


def _hub_minutes(ready: DataFrame, last: int) -> DataFrame:
    """(variant, origin, hub, t, best, second): for each minute the label that set out last of those ready, and that of another last train."""
    by = ["variant", "origin", "hub"]
    label = F.struct(F.col("tau").cast("int").alias("tau"), F.col("trains").cast("int").alias("trains"), F.col("trip").cast("bigint").alias("trip"), F.col("a_seq").cast("int").alias("a_seq"))
    a = ready.select(*by, F.col("ready").cast("int").alias("t"), F.lit(0).alias("kind"), label.alias("label"))
    minutes = ready.groupBy(*by).agg(F.min("ready").cast("int").alias("soonest")).filter(F.col("soonest") <= last)
    minutes = minutes.select(*by, F.explode(F.sequence("soonest", F.lit(last))).alias("t"), F.lit(1).alias("kind"), F.lit(None).cast(a.schema["label"].dataType).alias("label"))
    order = W.partitionBy(*by).orderBy("t", "kind", "label")
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    both = a.unionByName(minutes).withColumn("best", F.max("label").over(upto)).withColumn("before", F.lag("best").over(order))
    passed = F.when(F.col("label").isNotNull() & F.col("before").isNotNull() & (F.col("label.trip") != F.col("before.trip")), F.least("before", "label"))
    both = both.withColumn("passed", passed).withColumn("second", F.max("passed").over(upto))
    return checkpointed(both.filter("kind = 1").select(*by, "t", "best", "second"))


def _last_hub_round(new: DataFrame, earlier: DataFrame, rides: DataFrame, changes: DataFrame, hubs: DataFrame, ends: DataFrame, depth: int, k: int) -> DataFrame:
    """The labels of the last round, k, that journeys() takes: per origin, station and departure one with the least arrival, where it is
    on the front. new: labels of one train less; earlier: all labels so far; rides: as _rides.

    All platforms of a hub have the same labels ready, so rides go by hub, minute and station to the quickest one before they meet a
    label, whatever the number of trains; rides that are barred from some train go alone where they are quicker than all others. What a quicker change inside a hub gives is
    looked at only if it could still beat the journeys known by then, and sets out later than what the hub has ready."""
    keys = ["variant", "origin", "dest"]
    own = ["variant"] if "variant" in rides.columns else []
    all_hubs = checkpointed(hubs.select("variant", "platform", "hub", F.col("minutes").alias("hub_minutes")))
    hub_of = _small(all_hubs)
    to = _small(checkpointed(ends.select("variant", "platform", F.col("station").alias("dest"))))
    last = rides.agg(F.max("b_dep")).first()[0]
    if last is None:
        return checkpointed(earlier.limit(0).select(*LABEL))
    ready = _hub_labels(new, hub_of, depth)
    minutes = _hub_minutes(ready, last)
    bests = _small(minutes)

    # rides by hub, the quickest of those that are barred from no train
    from_hub = rides.join(hub_of.select("variant", F.col("platform").alias("b_platform"), "hub"), [*own, "b_platform"]).join(to, ["variant", "platform"])
    group = ["variant", "hub", "b_dep", "dest"]
    free = checkpointed(from_hub.filter("barred IS NULL").groupBy(*group).agg(F.min("arr").alias("arr")))
    quick = pareto(free, ["variant", "hub", "dest"], "b_dep", "arr")
    by_hub = quick.join(bests.withColumnRenamed("t", "b_dep"), ["variant", "hub", "b_dep"]).filter("origin <> dest AND best IS NOT NULL").select(*keys, F.col("best.tau").alias("tau"), "arr", "hub", "b_dep", F.col("best").alias("label"))
    ride = ["trip", "a_seq", "platform", "station", "b_platform", "b_station", "b_dep"]

    def taken(rows: DataFrame) -> DataFrame:
        prev = F.struct(F.col("label.trains").cast("int").alias("trains"), F.col("label.trip").cast("bigint").alias("trip"), F.col("label.a_seq").cast("int").alias("a_seq"))
        return rows.select(*keys, F.col("label.tau").cast("int").alias("tau"), "arr", *ride, prev.alias("prev"))

    parts = []
    if depth > 1:
        held = from_hub.filter("barred IS NOT NULL").join(_small(free).withColumnRenamed("arr", "least"), group, "left").filter("least IS NULL OR arr < least")
        held = checkpointed(held.select("variant", "hub", "dest", "arr", "barred", "seq", *ride))
        single = held.filter("size(barred) = 1").join(bests.withColumnRenamed("t", "b_dep"), ["variant", "hub", "b_dep"])
        single = single.withColumn("label", F.when(F.col("best.trip") != F.col("barred")[0], F.col("best")).otherwise(F.col("second"))).filter("label IS NOT NULL AND origin <> dest")
        parts.append(taken(single))
        if depth > 2:
            several = held.filter("size(barred) > 1").join(ready.select("variant", "origin", "hub", "ready", F.struct("tau", *KEY).alias("label")), ["variant", "hub"])
            several = several.filter("ready <= b_dep AND NOT array_contains(barred, label.trip) AND origin <> dest")
            parts.append(taken(several.groupBy(*keys, "arr", "seq", *ride).agg(F.max("label").alias("label"))))

    # what is known so far, and of each departure the latest arrival at any station that could still be beaten
    before = earlier.join(to, ["variant", "platform"]).filter("origin <> dest")
    known = before.groupBy(*keys, "tau").agg(F.min("arr").alias("arr"))
    for x in (by_hub, *parts):
        known = known.unionByName(x.groupBy(*keys, "tau").agg(F.min("arr").alias("arr")))
    known = checkpointed(known.groupBy(*keys, "tau").agg(F.min("arr").alias("arr")))
    bound = _small(checkpointed(_latest_of_known(known, new, to)))

    # changes that are quicker than the hub
    sides = [all_hubs.select("variant", F.col("platform").alias(f"{e}_platform"), F.col("hub").alias(f"{e}_hub"), F.col("hub_minutes").alias(f"{e}_minutes")) for e in ("from", "to")]
    c = changes.select("variant", "from_platform", "to_platform", "minutes").join(sides[0], ["variant", "from_platform"], "left").join(sides[1].drop("to_minutes"), ["variant", "to_platform"], "left")
    c = c.withColumn("inside", F.coalesce(F.col("from_hub") == F.col("to_hub"), F.lit(False)))
    c = checkpointed(c.filter("NOT inside OR minutes < from_minutes").withColumnRenamed("from_platform", "platform"))
    soonest = _small(checkpointed(c.filter("inside").groupBy("variant", "platform", F.col("from_hub").alias("hub")).agg(F.min("minutes").alias("least"))))
    beaten = F.col("best.tau") if depth == 1 else F.col("second.tau")
    ahead = minutes.groupBy("variant", "origin", "hub").agg(F.min("t").alias("t0"), F.transform(F.array_sort(F.collect_list(F.struct("t", F.coalesce(beaten, F.lit(-(2**30))).alias("tau")))), lambda x: x["tau"]).alias("taus"))
    ahead = _small(checkpointed(ahead))

    def beatable(rows: DataFrame, at: Column) -> DataFrame:
        i = F.greatest(F.col("tau") - F.col("tau0") + 1, F.lit(1)).cast("int")  # what sets out before all known journeys may take them too
        return rows.join(bound, ["variant", "origin"], "left").filter(at < F.coalesce(F.try_element_at("most", i), F.lit(2**30))).drop("tau0", "most")

    def helps(rows: DataFrame, at: Column) -> DataFrame:
        """Rows of labels that can go on at that minute: earlier than some arrival known by now, and later off than the hub's own."""
        i = at - F.col("t0") + 1
        later = F.when((i >= 1) & (i <= F.size("taus")), F.col("tau") > F.try_element_at("taus", i.cast("int"))).otherwise(True) if depth <= 2 else F.lit(True)
        return beatable(rows, at).join(ahead, ["variant", "origin", "hub"], "left").filter(F.coalesce(later, F.lit(True))).drop("t0", "taus")

    near = helps(new.join(soonest, ["variant", "platform"]), F.col("arr") + F.col("least")).select("variant", "origin", "platform", "hub", "arr", "tau", *KEY)
    near = near.join(c.filter("inside").select("variant", "platform", "to_platform", "minutes", "from_minutes"), ["variant", "platform"])
    near = near.withColumn("b_dep", F.explode(F.sequence((F.col("arr") + F.col("minutes")).cast("int"), (F.col("arr") + F.col("from_minutes") - 1).cast("int"))))
    near = helps(near, F.col("b_dep")).select("variant", "origin", F.col("to_platform").alias("b_platform"), "b_dep", F.struct("tau", *KEY).alias("label"))
    near = _small(checkpointed(near.distinct()))
    far = c.filter("NOT inside")
    onward = rides.join(near, [*own, "b_platform", "b_dep"])
    if far.limit(1).count():
        moved = new.join(far.select("variant", "platform", "to_platform", "minutes"), ["variant", "platform"]).select("variant", "origin", F.col("to_platform").alias("platform"), "tau", (F.col("arr") + F.col("minutes")).alias("ready"), *KEY)
        moved = skyband(moved.groupBy(*PLATFORM, "tau", *KEY).agg(F.min("ready").alias("ready")), "ready", depth)
        board = rides if own else rides.crossJoin(F.broadcast(ends.select("variant").distinct()))  # variants are the traveller's few
        bars = board.filter("barred IS NOT NULL").select("variant", "trip", "barred").distinct() if depth > 1 else None
        board = board.select("variant", "trip", "seq", "b_station", "b_platform", "b_dep").distinct()
        boarded = _as_of_boarding(checkpointed(moved), board, bars).select("variant", "origin", "trip", "seq", F.struct("tau", "prev.trains", "prev.trip", "prev.a_seq").alias("label"))
        onward = onward.unionByName(rides.join(boarded, [*own, "trip", "seq"]).select(*onward.columns))
    onward = onward.filter("barred IS NULL OR NOT array_contains(barred, label.trip)").join(to, ["variant", "platform"]).filter("origin <> dest")
    onward = checkpointed(beatable(taken(onward), F.col("arr")))
    parts.append(onward)

    # the front, and then what it went by
    found = known.unionByName(onward.groupBy(*keys, "tau").agg(F.min("arr").alias("arr"))).groupBy(*keys, "tau").agg(F.min("arr").alias("arr"))
    front = _small(checkpointed(pareto(found, keys, "tau", "arr")))
    one = F.min(F.struct("label", "hub", "b_dep")).alias("x")
    by_hub = checkpointed(by_hub.join(front, [*keys, "tau", "arr"]).groupBy(*keys, "tau", "arr").agg(one).select(*keys, "arr", "x.*"))
    again = from_hub.filter("barred IS NULL").join(_small(checkpointed(by_hub.select(*group, "arr").distinct())), [*group, "arr"])
    again = again.groupBy(*group, "arr").agg(F.min(F.struct(*[r for r in ride if r != "b_dep"])).alias("x")).select(*group, "arr", "x.*")
    parts.append(taken(by_hub.join(again, [*group, "arr"])))
    whole = before.select(*LABEL, "dest")
    for x in parts:
        whole = whole.unionByName(x.withColumn("trains", F.lit(k)).select(*LABEL, "dest"))
    x = whole.join(front, [*keys, "tau", "arr"]).groupBy(*keys, "tau").agg(F.min(F.struct("arr", *KEY, "platform", "station", "b_platform", "b_station", "b_dep", "prev")).alias("x"))
    return checkpointed(x.select("variant", "origin", "tau", "x.*").select(*LABEL).distinct())


def _latest_of_known(known: DataFrame, new: DataFrame, to: DataFrame) -> DataFrame:
    """(variant, origin, tau0, most): for the departures tau0, tau0 + 1, ... the latest arrival of the quickest known journeys to the stations;
    null where a station has none yet."""
    span = known.agg(F.min("tau").alias("lo"), F.max("tau").alias("hi"))
    cells = known.select("variant", "origin").distinct().join(to.select("variant", "dest").distinct(), "variant").filter("origin <> dest")
    cells = cells.join(F.broadcast(span)).select("variant", "origin", "dest", F.explode(F.sequence("lo", "hi")).alias("tau"))  # span is one row
    later = W.partitionBy("variant", "origin", "dest").orderBy(F.desc("tau"))
    x = cells.join(known, ["variant", "origin", "dest", "tau"], "left").withColumn("arr", F.min("arr").over(later.rowsBetween(W.unboundedPreceding, 0)))
    x = x.groupBy("variant", "origin", "tau").agg(F.when(F.count("arr") == F.count("*"), F.max("arr")).alias("arr"))
    return x.groupBy("variant", "origin").agg(F.min("tau").alias("tau0"), F.transform(F.array_sort(F.collect_list(F.struct("tau", "arr"))), lambda c: c["arr"]).alias("most"))


def _as_of_boarding(ready: DataFrame, board: DataFrame, bars: DataFrame | None) -> DataFrame:
    """JOIN-13 for all origins at once, with JOIN-12: each departure takes, of the labels that are ready, the one that set out last. A
    running maximum along a platform's times gives the best label, a second one over what the first passed by the best of
    another last train, for departures barred from one train. Those barred from more look at all labels."""
    at = board.withColumnRenamed("b_platform", "platform")
    several = None
    if bars is not None:
        at = at.join(bars, ["variant", "trip"], "left")
        several = at.filter(F.size("barred") > 1)
        at = at.filter("barred IS NULL OR size(barred) = 1").withColumn("barred", F.col("barred")[0])
    else:
        at = at.withColumn("barred", F.lit(None).cast("bigint"))
    wanted = ready.groupBy(*PLATFORM).agg(F.min("ready").alias("soonest"))
    label = F.struct("tau", *KEY)
    dep = F.struct(F.col("trip").cast("bigint").alias("trip"), F.col("seq").cast("int").alias("seq"), F.col("b_station").cast("bigint").alias("b_station"), F.col("barred").cast("bigint").alias("barred"))
    b = at.join(wanted, ["variant", "platform"]).filter("b_dep >= soonest").select(*PLATFORM, F.col("b_dep").alias("t"), F.lit(1).alias("kind"), dep.alias("dep"))
    a = ready.select(*PLATFORM, F.col("ready").alias("t"), F.lit(0).alias("kind"), label.alias("label"))
    b = b.withColumn("label", F.lit(None).cast(a.schema["label"].dataType))
    both = a.withColumn("dep", F.lit(None).cast(b.schema["dep"].dataType)).unionByName(b)
    order = W.partitionBy(*PLATFORM).orderBy("t", "kind", "label")
    both = both.withColumn("best", F.max("label").over(order.rowsBetween(W.unboundedPreceding, 0)))
    if bars is not None:
        before = F.lag("best").over(order)
        both = both.withColumn("before", before)
        passed = F.when(F.col("label").isNotNull() & F.col("before").isNotNull() & (F.col("label.trip") != F.col("before.trip")), F.least("before", "label"))
        both = both.withColumn("passed", passed).withColumn("second", F.max("passed").over(order.rowsBetween(W.unboundedPreceding, 0)))
        free = F.col("dep.barred").isNull() | (F.col("best.trip") != F.col("dep.barred"))
        both = both.withColumn("best", F.when(free, F.col("best")).otherwise(F.col("second")))
    met = both.filter("kind = 1 AND best IS NOT NULL")
    cols = ["variant", "b_platform", "trip", "seq", "b_station", "b_dep", "origin", "tau", "prev"]
    got = F.col("best.trains").alias("trains"), F.col("best.trip").alias("trip"), F.col("best.a_seq").alias("a_seq")
    out = met.select("variant", F.col("platform").alias("b_platform"), "dep.trip", "dep.seq", "dep.b_station", F.col("t").alias("b_dep"), "origin", "best.tau", F.struct(*got).alias("prev"))
    if several is not None:
        x = several.join(ready.withColumnRenamed("trip", "last"), ["variant", "platform"]).filter("b_dep >= ready AND NOT array_contains(barred, last)")
        x = x.groupBy("variant", "origin", "platform", "trip", "seq", "b_station", "b_dep").agg(F.max(F.struct("tau", "trains", F.col("last").alias("trip"), "a_seq")).alias("x"))
        prev = F.struct(F.col("x.trains").alias("trains"), F.col("x.trip").alias("trip"), F.col("x.a_seq").alias("a_seq"))
        out = out.unionByName(x.select("variant", F.col("platform").alias("b_platform"), "trip", "seq", "b_station", "b_dep", "origin", "x.tau", prev.alias("prev")))
    return out.select(cols)


def journeys(labels: DataFrame, ends: DataFrame, with_legs: bool = True) -> DataFrame:
    """ROUTE-4. ends: (variant, platform, station) where one may leave. variant, origin, dest, k, tau, arr, legs: the Pareto
    front per pair, the least arrival over the destination's platforms. Legs are rebuilt for these journeys only, by one join a
    train with the labels' own rows."""
    x = labels.join(ends.select("variant", "platform", F.col("station").alias("dest")), ["variant", "platform"]).filter("origin <> dest")
    keys = ["variant", "origin", "dest", "k"]
    x = x.groupBy(*keys, "tau").agg(F.min(F.struct("arr", *KEY)).alias("x")).select(*keys, "tau", "x.*")
    x = pareto(x, keys, "tau", "arr")
    if not with_legs:
        return x.select(*keys, "tau", "arr")
    leg = F.struct("trip", F.col("b_platform").alias("board"), F.col("b_station").alias("board_station"), F.col("platform").alias("alight"), F.col("station").alias("alight_station"), F.col("b_dep").alias("dep"), "arr")
    own = labels.filter("k = trains").select("variant", "origin", F.struct(*KEY).alias("at"), leg.alias("leg"), "prev")
    x = x.select(*keys, "tau", "arr", F.struct(*KEY).alias("at"), F.array().cast(f"array<{own.schema['leg'].dataType.simpleString()}>").alias("legs"))
    for _ in range(labels.agg(F.max("trains")).first()[0] or 0):
        x = x.join(own, ["variant", "origin", "at"], "left")
        x = x.select(*keys, "tau", "arr", F.col("prev").alias("at"), F.when(F.col("leg").isNull(), F.col("legs")).otherwise(F.concat(F.array("leg"), "legs")).alias("legs"))
    return x.drop("at")


def summarise(found: DataFrame, hours: float, marked: DataFrame | None = None) -> DataFrame:
    """AGG-13, WIN-5. Per variant, pair and k: fastest, the lower-median journey with its changes, via and tracks, and the
    departures per hour. marked: (variant, trip), trains in a set by their verdict only; then mark is 1 where the median journey
    takes one of them, else null."""
    keys = ["variant", "origin", "dest", "k"]
    duration, changes = F.col("arr") - F.col("tau"), F.size("legs") - 1
    w, every = W.partitionBy(*keys).orderBy("duration", "changes", F.desc("tau")), W.partitionBy(*keys)
    x = found.withColumn("duration", duration).withColumn("changes", changes)
    x = x.select("*", F.row_number().over(w).alias("r"), F.count("*").over(every).alias("n"), F.min("duration").over(every).alias("fastest"))
    x = x.filter("r = floor((n - 1) / 2) + 1")
    via = F.array_join(F.transform(F.slice("legs", F.lit(1), F.greatest(F.size("legs") - 1, F.lit(0))), lambda s: s.alight_station.cast("string")), "|")
    tracks = F.array_join(F.flatten(F.transform("legs", lambda s: F.array(s.board.cast("string"), s.alight.cast("string")))), "|")
    columns = [*keys, F.col("duration").alias("median"), "fastest", F.round(F.col("n") / hours, 1).alias("per_hour"), "changes", via.alias("via"), tracks.alias("tracks")]
    if marked is None:
        return x.select(*columns)
    ridden = x.select(*keys, F.explode("legs.trip").alias("trip")).join(marked.select("variant", "trip").distinct(), ["variant", "trip"])
    return x.join(ridden.select(*keys, F.lit(1).alias("mark")).distinct(), keys, "left").select(*columns, "mark")


def never_worse(entries: DataFrame) -> DataFrame:
    """AGG-14. entries: (origin, dest, day_type, p, t, k, median, changes, per_hour, fastest, payload), p, t and k counting
    options from 0. Each cell gets the best entry of all cells with no more options; cells that no entry reaches stay out.
    A pair's entries, twelve at most, are gathered by one shuffle."""
    pair = ["origin", "dest", "day_type"]
    rank = F.struct("median", "changes", (-F.col("per_hour")).alias("less"), "fastest", F.col("k").alias("from_k"), F.col("p").alias("from_p"), F.col("t").alias("from_t"), "payload")
    x = entries.select(*pair, rank.alias("best")).groupBy(*pair).agg(F.collect_list("best").alias("own"))
    cells = [(p, t, k) for p in (0, 1) for t in (0, 1) for k in (0, 1, 2)]

    def best(p: int, t: int, k: int) -> Column:
        return F.array_min(F.filter("own", lambda e: (e["from_p"] <= p) & (e["from_t"] <= t) & (e["from_k"] <= k)))

    x = x.select(*pair, F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.lit(t).alias("t"), F.lit(k).alias("k"), best(p, t, k).alias("best")) for p, t, k in cells])).alias("c"))
    x = x.select(*pair, "c.p", "c.t", "c.k", "c.best").filter("best IS NOT NULL")
    return x.select(*pair, "p", "t", "k", "best.median", "best.fastest", (-F.col("best.less")).alias("per_hour"), "best.changes", "best.payload")


def trimmed_levels(entries: DataFrame, keys: list[str]) -> DataFrame:
    """WIN-8. entries: (keys, k, value): per key the levels 0 to 2 filled forward and without trailing repeats."""
    x = entries.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("k", "value"))).alias("m"))
    full = F.aggregate(F.sequence(F.lit(0), F.lit(2)), F.expr("array()").cast("array<string>"), lambda acc, k: F.concat(acc, F.array(F.coalesce(F.try_element_at("m", k), F.try_element_at(acc, F.lit(-1))))))
    kept = F.filter(F.sequence(F.lit(1), F.lit(3)), lambda i: (i == 1) | ~F.try_element_at("f", i).eqNullSafe(F.try_element_at("f", i - 1)))
    return x.withColumn("f", full).select(*keys, F.slice("f", F.lit(1), F.element_at(kept, -1)).alias("levels"))


def overtaking(calls: DataFrame, pattern: DataFrame) -> DataFrame:
    """WIN-9. pattern: (trip, pattern). Trips of a pattern that are earlier at some stop than a trip set out before them; in
    the order of (first departure, last arrival, trip)."""
    ends = calls.groupBy("trip").agg(F.min_by("dep", "seq").alias("d"), F.max_by("arr", "seq").alias("a"))
    x = calls.join(pattern, "trip").join(ends, "trip")
    w = W.partitionBy("pattern", "seq").orderBy("d", "a", "trip").rowsBetween(W.unboundedPreceding, -1)
    x = x.withColumn("late", F.greatest(F.max("dep").over(w) - F.col("dep"), F.max("arr").over(w) - F.col("arr")))
    return x.groupBy("pattern", "trip").agg(F.coalesce(F.bool_or(F.col("late") > 0), F.lit(False)).alias("overtakes"))


def tangles(calls: DataFrame, pattern: DataFrame | Callable[[Column], Column]) -> DataFrame:
    """pattern: (trip, pattern), or of a trip's calls in order; trips of one pattern call at the same seqs. pattern, trip, d, a,
    times, piece, alone: the trips of a pattern by (first departure d, last arrival a, trip), cut into pieces wherever all that
    follow are nowhere earlier than any before. Trips of one piece alone depend on each other, so a busy pattern falls apart at
    its gaps; alone: a piece of one trip. times: departure and arrival of each stop, null where a trip is alone."""
    if callable(pattern):
        x = calls.groupBy("trip").agg(F.sort_array(F.collect_list(F.struct(*[c for c in ("seq", "dep", "arr", "platform") if c in calls.columns]))).alias("s"))
        x = x.select(pattern(F.col("s")).alias("pattern"), "trip", "s")
    else:
        x = calls.join(pattern, "trip").groupBy("pattern", "trip").agg(F.sort_array(F.collect_list(F.struct("seq", "dep", "arr"))).alias("s"))
    stops = F.transform("s", lambda c: F.struct(c["dep"].alias("dep"), c["arr"].alias("arr")))
    x = x.select("pattern", "trip", F.col("s")[0]["dep"].alias("d"), F.element_at("s", -1)["arr"].alias("a"), F.posexplode(stops).alias("i", "stop"))
    x = x.select("pattern", "trip", "d", "a", "i", "stop.dep", "stop.arr")
    before = W.partitionBy("pattern", "i").orderBy("d", "a", "trip").rowsBetween(W.unboundedPreceding, -1)
    after = W.partitionBy("pattern", "i").orderBy(F.desc("d"), F.desc("a"), F.desc("trip")).rowsBetween(W.unboundedPreceding, 0)
    clear = [F.coalesce(F.col(f"{c}_before") <= F.col(f"{c}_after"), F.lit(True)) for c in ("dep", "arr")]
    x = x.select("*", F.max("dep").over(before).alias("dep_before"), F.max("arr").over(before).alias("arr_before"))
    x = x.select("*", F.min("dep").over(after).alias("dep_after"), F.min("arr").over(after).alias("arr_after"))
    x = x.groupBy("pattern", "trip", "d", "a").agg(F.bool_and(clear[0] & clear[1]).alias("cut"), F.collect_list(F.struct("i", "dep", "arr")).alias("s"))
    order = W.partitionBy("pattern").orderBy("d", "a", "trip")
    alone = F.col("cut") & F.coalesce(F.lead("cut").over(order), F.lit(True))
    x = x.select("pattern", "trip", "d", "a", "s", F.sum(F.col("cut").cast("bigint")).over(order).alias("piece"), alone.alias("alone"))
    times = F.flatten(F.transform(F.sort_array("s"), lambda c: F.array(c["dep"], c["arr"])))
    return x.select("pattern", "trip", "d", "a", F.when(~F.col("alone"), times).alias("times"), "piece", "alone")


def lanes(calls: DataFrame, pattern: DataFrame | Callable[[Column], Column]) -> DataFrame:
    """WIN-9. pattern: as in tangles. First-fit lane numbers: (pattern, trip, lane), in each lane no trip overtakes another. First fit is sequential, but
    only inside the pieces of tangles: each begins as if all lanes were empty. The trips of pieces with several stream through
    sorted tasks, which hold the last times of each lane and no more."""
    x = checkpointed(tangles(calls, pattern))  # read twice, with other columns
    kinds = f"pattern {x.schema['pattern'].dataType.simpleString()}, trip {x.schema['trip'].dataType.simpleString()}, lane int"

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last = None, np.empty((0, 0), np.int64)
        for batch in batches:
            out = []
            for p, piece, times in zip(*(batch.column(c).to_pylist() for c in ("pattern", "piece", "times")), strict=True):
                if (p, piece) != key:
                    key, last = (p, piece), np.empty((0, len(times)), np.int64)
                fits = (last <= times).all(axis=1)
                lane = int(fits.argmax()) if fits.any() else len(last)
                if lane < len(last):
                    last[lane] = times
                else:
                    last = np.vstack([last, [times]])
                out.append(lane)
            yield pa.record_batch([batch.column("pattern"), batch.column("trip"), pa.array(out, pa.int32())], names=["pattern", "trip", "lane"])

    mixed = x.filter("NOT alone").select("pattern", "piece", "d", "a", "trip", "times").repartition("pattern", "piece")
    fitted = mixed.sortWithinPartitions("pattern", "piece", "d", "a", "trip").mapInArrow(fit, kinds)
    return x.filter("alone").select("pattern", "trip", F.lit(0).alias("lane")).unionByName(fitted)


def matrix(calls: DataFrame, sets: DataFrame, rules: DataFrame, changes: DataFrame, usable: DataFrame, window: tuple[int, int], latest: int, hours: float, hubs: DataFrame | None = None) -> DataFrame:
    """ROUTE-5. The origin-destination matrix of all variants in one job: each kind of day, both profiles, both train sets, up to
    three trains, through trains merged inside each set, summarised, and never worse with more options (AGG-14).

    calls: (day_type, trip, seq, station, platform, arr, dep, can_board, can_alight), a trip on one kind of day; sets: (trip, t), t
    1 for all trains and 0 for the smaller set, and if given marked, true for a train in the set by its verdict only: then "1"
    ends the payload of an entry whose median journey takes such a train, or a merged one with such a part; rules: (from_trip, to_trip, kind), impossible ones
    barring all changes between the merged trains of the two; changes: (profile, from_platform, to_platform,
    minutes); usable: (profile, platform, station) where one may set out and leave; hubs: (profile, platform, hub, minutes), as in search(), for changes that
    leave out what a hub gives. A merged train has its first trip's name."""
    both, barred, special = [], [], []
    for t in (0, 1):
        own = calls.join(sets.filter(F.col("t") == t).select("trip"), "trip", "left_semi")
        chained = checkpointed(chains(own.select("trip").distinct(), continuations(own, rules)))
        heads = chained.filter("place = 0").select("chain", F.col("trip").alias("head")).join(own.groupBy(F.col("trip").alias("head")).agg(F.min("day_type").alias("day_type")), "head")
        both.append(merged_calls(own.drop("day_type"), chained).join(heads, "chain").withColumn("t", F.lit(t)))
        of = chained.join(heads, "chain").select("trip", "head", "day_type")
        if "marked" in sets.columns:
            special.append(of.join(sets.filter((F.col("t") == t) & F.col("marked")).select("trip"), "trip", "left_semi").select("day_type", F.lit(t).alias("t"), F.col("head").alias("trip")).distinct())
        no = rules.filter("kind = 'impossible'").select("from_trip", "to_trip")
        no = no.join(of.select(F.col("trip").alias("from_trip"), F.col("head").alias("a"), "day_type"), "from_trip").join(of.select(F.col("trip").alias("to_trip"), F.col("head").alias("b"), "day_type"), ["to_trip", "day_type"])
        barred.append(no.filter("a <> b").select("day_type", F.lit(t).alias("t"), F.col("a").alias("from_trip"), F.col("b").alias("to_trip")).distinct())
    merged = both[0].unionByName(both[1])
    profiles = F.explode(F.array(F.lit("any"), F.lit("stroller"))).alias("profile")
    name = F.concat_ws("|", "day_type", "profile", "t")
    rides = checkpointed(merged.select("*", profiles).select(name.alias("variant"), F.col("head").alias("trip"), "seq", "station", "platform", "arr", "dep", "can_board", "can_alight"))
    kinds = rides.select("variant").distinct().withColumn("profile", F.split("variant", "[|]")[1])
    places = checkpointed(usable.join(F.broadcast(kinds), "profile").select("variant", "platform", "station"))
    moves = checkpointed(changes.join(F.broadcast(kinds), "profile").select("variant", "from_platform", "to_platform", "minutes"))
    barred = barred[0].unionByName(barred[1]).select("*", profiles).select(name.alias("variant"), "from_trip", "to_trip")
    by_hubs = {} if hubs is None else {"hubs": checkpointed(hubs.join(F.broadcast(kinds), "profile").select("variant", "platform", "hub", "minutes")), "ends": places}
    found = journeys(search(rides, moves, places.select("variant", "platform"), window, latest, 3, barred, **by_hubs), places)
    parts = F.split("variant", "[|]")
    marked = checkpointed(special[0].unionByName(special[1]).select("*", profiles).select(name.alias("variant"), "trip")) if special else None
    x = summarise(found, hours, marked).select("*", parts[0].alias("day_type"), (parts[1] == "any").cast("int").alias("p"), parts[2].cast("int").alias("t"))
    x = x.select("origin", "dest", "day_type", "p", "t", (F.col("k") - 1).alias("k"), "median", "changes", "per_hour", "fastest", F.concat_ws(";", "via", "tracks", *["mark"] * bool(special)).alias("payload"))
    return never_worse(checkpointed(x))


def verdicts(stations: DataFrame, choices: DataFrame, results: DataFrame) -> DataFrame:
    """PRJ-9. stations: (day_type, dest, status, idle); choices: (choice, day_type, origin, profile, k, most), a traveller's few;
    results: (origin, profile, dest, k, median). One of origin, not-step-free, unknown-access, idle, reachable, out-of-reach; a limit of 240 is none."""
    # every choice meets every station of its kind of day, which is the result; dealt out by slices of the stations, so an equi-join whatever the sizes
    sliced = stations.withColumn("slice", F.pmod(F.hash("dest"), F.lit(SLICES)))
    x = choices.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1)))).join(sliced, ["day_type", "slice"]).drop("slice")
    x = x.join(results, ["origin", "profile", "dest", "k"], "left")
    fits = F.col("median").isNotNull() & ((F.col("most") >= 240) | (F.col("median") <= F.col("most")))
    pram = F.col("profile") == "stroller"
    verdict = F.when(F.col("dest") == F.col("origin"), "origin").when(pram & (F.col("status") == "no"), "not-step-free").when(pram & (F.col("status") == "unknown"), "unknown-access").when(F.col("idle"), "idle").when(fits, "reachable").otherwise("out-of-reach")
    return x.select("choice", "origin", "dest", verdict.alias("verdict"))


def reach_report(entries: DataFrame, busy: DataFrame) -> DataFrame:
    """TOP-2, TOP-3. entries: (origin, dest, name, median); busy: (dest, trips). Per origin: pairs within 30 and 60 minutes,
    the 6 quickest, and of those in 31..60 the 5 busiest, by time."""
    x = entries.join(busy, "dest")
    by_time = W.partitionBy("origin").orderBy("median", "name")
    by_trips = W.partitionBy("origin", F.col("median").between(31, 60)).orderBy(F.desc("trips"), "median", "name")
    x = x.select("*", F.row_number().over(by_time).alias("quick"), F.when(F.col("median").between(31, 60), F.row_number().over(by_trips)).alias("busiest"))

    def names(keep: Column) -> Column:
        chosen = F.array_sort(F.collect_list(F.when(keep, F.struct("median", "name"))))
        return F.array_join(F.transform(chosen, lambda s: s.getField("name")), "|")

    return x.groupBy("origin").agg(F.count_if(F.col("median") <= 30).alias("within_30"), F.count_if(F.col("median") <= 60).alias("within_60"), names(F.col("quick") <= 6).alias("quickest"), names(F.col("busiest") <= 5).alias("busiest"))


def compared(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """JOIN-20. (origin, dest, minutes) of both: ok within 5 minutes or 10 percent of theirs; missing on a side is not."""
    x = ours.withColumnRenamed("minutes", "a").join(theirs.withColumnRenamed("minutes", "b"), ["origin", "dest"], "full")
    return x.select("origin", "dest", "a", "b", F.coalesce(F.abs(F.col("a") - F.col("b")) <= F.greatest(F.lit(5.0), F.col("b") * 0.1), F.lit(False)).alias("ok"))


def with_one_more(entries: DataFrame, value: str) -> DataFrame:
    """entries: (origin, dest, day_type, p, t, k, value). origin, dest, day_type, p, t, k, along, less, more: each cell with one
    option more along k, p and t, the value there (null if missing) and with the option fewer. A pair's entries, twelve at
    most, are gathered by one shuffle."""
    pair = ["origin", "dest", "day_type"]
    x = entries.groupBy(*pair).agg(F.collect_list(F.struct("p", "t", "k", F.col(value).alias("value"))).alias("own"))
    known = F.lit(True)
    for c in pair:
        known = known & F.col(c).isNotNull()
    x = x.withColumn("known", known).select(*pair, "own", "known", F.explode("own").alias("e"))
    cells = [F.struct(*[(F.col(f"e.{c}") + int(c == along)).alias(c) for c in ("p", "t", "k")], F.lit(along).alias("along"), (F.col(f"e.{along}") < (2 if along == "k" else 1)).alias("fits")) for along in ("k", "p", "t")]
    x = x.select(*pair, "own", "known", F.col("e.value").alias("less"), F.explode(F.array(*cells)).alias("c")).filter("c.fits")
    there = F.filter("own", lambda o: F.col("known") & (o["p"] == F.col("c.p")) & (o["t"] == F.col("c.t")) & (o["k"] == F.col("c.k")))
    return x.select(*pair, "c.p", "c.t", "c.k", "c.along", "less", F.explode_outer(there).alias("m")).select(*pair, "p", "t", "k", "along", "less", F.col("m.value").alias("more"))


def worse_with_more(entries: DataFrame, value: str) -> DataFrame:
    """DQ-1, DQ-2, SET-4. entries: (origin, dest, day_type, p, t, k, value). Cells that are worse than, or missing against, the
    cell with one option fewer along k, p or t."""
    return with_one_more(entries, value).filter(F.col("more").isNull() | (F.col("more") > F.col("less")))


def malformed(entries: DataFrame) -> DataFrame:
    """DQ-3. entries: (k, median, fastest, per_hour, changes, via, tracks as text with bars, and perhaps mark, 1 or null): rows that
    break a rule."""
    def n(c: str) -> Column:
        return F.when(F.col(c) == "", 0).otherwise(F.size(F.split(c, "[|]")))

    good = (F.col("fastest") > 0) & (F.col("fastest") <= F.col("median")) & (F.col("per_hour") > 0) & (F.col("changes") <= F.col("k")) & (n("via") == F.col("changes")) & (n("tracks") == 2 + 2 * F.col("changes"))
    if "mark" in entries.columns:
        good = good & (F.col("mark").isNull() | (F.col("mark") == 1))
    return entries.filter(~F.coalesce(good, F.lit(False)))
