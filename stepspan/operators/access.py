"""Accessibility operators: station and platform statuses, sources side by side, lifts, station topology."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.lineage import checkpointed


def station_status(tracks: DataFrame) -> DataFrame:
    """PRJ-7. tracks: (station, status) -> (station, status): yes if all are, partial if some, no if all no, else unknown."""
    x = tracks.groupBy("station").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "yes").alias("y"), F.count_if(F.col("status") == "no").alias("no"))
    return x.select("station", F.when(F.col("y") == F.col("n"), "yes").when(F.col("y") > 0, "partial").when(F.col("no") == F.col("n"), "no").otherwise("unknown").alias("status"))


def recommended(primary: Column, others: list[Column], lifts: Column, ramps: Column, project_only: Column) -> tuple[Column, Column]:
    """PRJ-8. The primary status, but unknown where another source says no and no register has a lift or ramp in service;
    with the reason."""
    other_no = F.coalesce(F.greatest(*[(c == "no").cast("int") for c in others], F.lit(0)) > 0, F.lit(False))
    bare = (F.coalesce(lifts, F.lit(0)) + F.coalesce(ramps, F.lit(0)) == 0) | F.coalesce(project_only, F.lit(False))
    doubt = (primary == "yes") & other_no & bare
    return F.when(doubt, "unknown").otherwise(primary), F.when(doubt & F.coalesce(project_only, F.lit(False)), "lift is a project").when(doubt, "no lift or ramp known").otherwise("primary source")


def master_table(base: DataFrame, sources: dict[str, DataFrame], statuses: tuple[str, ...]) -> DataFrame:
    """JOIN-6. base and one row per code from each source, left-joined; missing statuses become unknown."""
    for source in sources.values():
        base = base.join(source, "code", "left")
    return base.withColumns({c: F.coalesce(c, F.lit("unknown")) for c in statuses})


def assets(lifts: DataFrame, ramps: DataFrame) -> DataFrame:
    """JOIN-7. (code, n_lifts) and (code, n_ramps), full outer, 0 where one has none."""
    return lifts.join(ramps, "code", "full").select("code", F.coalesce("n_lifts", F.lit(0)).alias("n_lifts"), F.coalesce("n_ramps", F.lit(0)).alias("n_ramps"))


def match_names(codes: DataFrame, named: DataFrame, keys: list[str]) -> DataFrame:
    """JOIN-8. codes: (code, key columns); named: (key, row columns). A code takes the first of its keys that matches, and
    of several matches the least row."""
    rows = [c for c in named.columns if c != "key"]
    tries = None
    for i, key in enumerate(keys):
        one = codes.select("code", F.col(key).alias("key"), F.lit(i).alias("level")).join(named, "key").select("code", "level", *rows)
        tries = one if tries is None else tries.unionByName(one)
    best = tries.groupBy("code").agg(F.min(F.struct("level", *rows)).alias("x"))
    return best.select("code", "x.*")


def near_points(points: DataFrame, others: DataFrame, radius: float, lat_m: float = 111320.0, lon_m: float = 68000.0) -> DataFrame:
    """JOIN-9. points: (id, lat, lon), others: (other, lat, lon): pairs strictly closer than radius metres.

    Both are dealt into square cells of the radius; others go to their cell and its eight neighbours, so a pair meets in
    exactly one cell and the join is on the cell.
    """
    def cell(c: str, m: float) -> Column:
        return F.floor(F.col(c) * m / radius)

    a = points.select("id", F.col("lat").alias("alat"), F.col("lon").alias("alon"), cell("lat", lat_m).alias("cy"), cell("lon", lon_m).alias("cx"))
    step = F.array(F.lit(-1), F.lit(0), F.lit(1))
    b = others.select("other", F.col("lat").alias("blat"), F.col("lon").alias("blon"), F.explode(step).alias("dy"), cell("lat", lat_m).alias("y"), cell("lon", lon_m).alias("x"))
    b = b.select("*", F.explode(step).alias("dx")).select("other", "blat", "blon", (F.col("y") + F.col("dy")).alias("cy"), (F.col("x") + F.col("dx")).alias("cx"))
    dy, dx = (F.col("alat") - F.col("blat")) * lat_m, (F.col("alon") - F.col("blon")) * lon_m
    return a.join(b, ["cy", "cx"]).filter(dy * dy + dx * dx < radius * radius).select("id", "other")


def operators_per_stop(calls: DataFrame, trips: DataFrame) -> DataFrame:
    """AGG-5. Per platform: sorted distinct operators with a bar between, distinct trips."""
    x = calls.select("platform", "station", "trip").join(trips.select("trip", "agency"), "trip")
    return x.groupBy("station", "platform").agg(F.array_join(F.array_sort(F.collect_set("agency")), "|").alias("operators"), F.countDistinct("trip").alias("trips"))


def roll_up(stops: DataFrame) -> DataFrame:
    """AGG-6. Platforms with operator lists to stations: union of the lists, trips, platforms."""
    names = stops.select("station", F.explode(F.split("operators", "[|]")).alias("o")).filter("o <> ''").groupBy("station").agg(F.array_join(F.array_sort(F.collect_set("o")), "|").alias("operators"))
    sums = stops.groupBy("station").agg(F.sum("trips").alias("trips"), F.count("*").alias("platforms"))
    return sums.join(names, "station", "left").select("station", F.coalesce("operators", F.lit("")).alias("operators"), "trips", "platforms")


def disagreeing(rows: DataFrame, key: str, value: str) -> DataFrame:
    """AGG-8. Keys with more than one distinct value, null counting as a value."""
    x = rows.groupBy(key).agg((F.countDistinct(value) + F.max(F.col(value).isNull().cast("int"))).alias("n_values"))
    return x.filter("n_values > 1")


def served_tracks(refs: DataFrame, islands: DataFrame) -> DataFrame:
    """AGG-11. refs: (lift, quay); islands: (quay, track). Tracks per lift, an island standing for its tracks."""
    x = refs.join(islands, "quay", "left").select("lift", F.coalesce("track", "quay").alias("track"))
    return x.groupBy("lift").agg(F.array_join(F.array_sort(F.collect_set("track")), ",").alias("tracks"))


def surfaces(quays: DataFrame) -> DataFrame:
    """GRAPH-4. quays: (id, type, parent) -> (id, surface): sector to track to island; else the sector's track or itself."""
    up = quays.select(F.col("id").alias("parent"), F.col("type").alias("ptype"), F.col("parent").alias("grand"))
    top = quays.select(F.col("id").alias("grand"), F.col("type").alias("gtype"))
    x = quays.join(up, "parent", "left").join(top, "grand", "left")
    island = F.when(F.col("type") == "island", F.col("id")).when(F.col("ptype") == "island", F.col("parent")).when(F.col("gtype") == "island", F.col("grand"))
    track = F.when((F.col("type") == "sector") & F.col("parent").isNotNull(), F.col("parent")).otherwise(F.col("id"))
    return x.select("id", F.coalesce(island, track).alias("surface"))


def platform_record(used: DataFrame, tracks: DataFrame, islands: DataFrame) -> DataFrame:
    """JOIN-15. used: (station, platform); tracks and islands: (station, code, status). Exact track or island, else the code
    without its trailing letter, else none."""
    known = tracks.select("station", "code", "status").unionByName(islands.select("station", "code", "status")).groupBy("station", "code").agg(F.min("status").alias("status"))
    exact = known.select("station", F.col("code").alias("c1"), F.col("status").alias("s1"), F.lit(True).alias("f1"))
    short = known.select("station", F.col("code").alias("c2"), F.col("status").alias("s2"), F.lit(True).alias("f2"))
    folded = F.lower("platform")
    x = used.withColumn("c1", folded).withColumn("c2", F.regexp_replace(folded, "[a-z]$", ""))
    x = x.join(exact, ["station", "c1"], "left").join(short, ["station", "c2"], "left")
    return x.select("station", "platform", F.when(F.col("f1"), F.col("c1")).when(F.col("f2"), F.col("c2")).alias("matched"), F.when(F.col("f1"), F.col("s1")).when(F.col("f2"), F.col("s2")).alias("status"))


def platform_status(used: DataFrame, matched: DataFrame, stations: DataFrame) -> DataFrame:
    """JOIN-16. used: (variant, station, platform); matched: JOIN-15; stations: (station, status, main_tracks). An unmatched
    platform is yes only if the station is yes and the variant uses no more platforms there than it has main tracks."""
    n = used.filter("platform <> '?'").groupBy("variant", "station").agg(F.countDistinct("platform").alias("n_used"))
    x = used.join(matched, ["station", "platform"], "left").join(n, ["variant", "station"], "left").join(stations.withColumnRenamed("status", "station_status"), "station", "left")
    trusted = (F.col("station_status") == "yes") & (F.coalesce("n_used", F.lit(0)) <= F.coalesce("main_tracks", F.lit(0)))
    return x.select("variant", "station", "platform", F.when(F.col("matched").isNotNull(), F.col("status")).when(trusted, "yes").otherwise("unknown").alias("status"))


def corrected(tracks: DataFrame, corrections: DataFrame) -> DataFrame:
    """JOIN-19. tracks: (station, track, status); corrections: (station, track or null, status, line). A later line wins; a
    null track stands for all of the station. Corrections are summed up by track and by station first, so a station's
    corrections never meet all of its tracks."""
    last = F.max(F.struct("line", F.col("status").alias("new"))).alias("x"), F.count("*").alias("n")
    one = corrections.filter("track IS NOT NULL").groupBy("station", "track").agg(*last).select("station", "track", F.col("x").alias("one"), F.col("n").alias("n_one"))
    every = corrections.filter("track IS NULL").groupBy("station").agg(*last).select("station", F.col("x").alias("every"), F.col("n").alias("n_every"))
    x = tracks.join(one, ["station", "track"], "left").join(every, "station", "left").withColumn("new", F.greatest("one", "every")["new"])
    origin = F.when(F.col("new").isNotNull(), "correction").otherwise("source")
    notes = F.coalesce("n_one", F.lit(0)) + F.coalesce("n_every", F.lit(0))
    return x.select("station", "track", F.coalesce("new", "status").alias("status"), origin.alias("origin"), notes.cast("bigint").alias("notes"))


def bad_corrections(tracks: DataFrame, corrections: DataFrame) -> DataFrame:
    """DQ-5. Corrections of stations or tracks that do not exist, or with a status outside the vocabulary."""
    known = tracks.select("station", "track").distinct()
    by_track = corrections.filter("track IS NOT NULL").join(known, ["station", "track"], "left_anti")
    by_station = corrections.filter("track IS NULL").join(known.select("station").distinct(), "station", "left_anti")
    status = corrections.filter(~F.col("status").isin("yes", "partial", "no", "unknown"))
    cols = ["station", "track", "status", "line"]
    return by_track.select(cols).unionByName(by_station.select(cols)).unionByName(status.select(cols)).distinct()


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """AGG-20. (code, status) of two sources: pairs of statuses, how often, and whether they agree."""
    x = a.select("code", F.col("status").alias("a")).join(b.select("code", F.col("status").alias("b")), "code")
    return x.groupBy("a", "b").agg(F.count("*").alias("n")).withColumn("same", F.col("a") == F.col("b"))


def fingerprint(rows: DataFrame) -> DataFrame:
    """AGG-21. An order-independent digest of a table: row hashes summed up in parts, with the count; one row, no collect."""
    line = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("∅")) for c in sorted(rows.columns)]))
    parts = [F.sum(F.conv(F.substring(line, 1 + 8 * i, 8), 16, 10).cast("long")) for i in range(4)]
    return rows.agg(F.count("*").alias("n"), F.md5(F.concat_ws(",", *[F.coalesce(p, F.lit(0)).cast("string") for p in parts])).alias("digest"))


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """AGG-21. (name, digest) before and after: what was added, removed or changed."""
    x = old.withColumnRenamed("digest", "before").join(new.withColumnRenamed("digest", "after"), "name", "full")
    return x.filter("NOT (before <=> after)").select("name", F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("changed").alias("change"))


def station_edges(quays: DataFrame, equipment: DataFrame, links: DataFrame) -> DataFrame:
    """GRAPH-1. quays: (station, node, parent); equipment: (station, node, kind, item, item_kind) places that hold a lift or
    ramp; links: (station, a, b). Undirected edges as both directions. Places sharing an item form a star around it."""
    up = quays.filter("parent IS NOT NULL").select("station", F.col("node").alias("a"), F.col("parent").alias("b"))
    used = equipment.filter(F.col("kind").isin("entrance", "quay", "space") & (F.col("item_kind") != "escalator"))
    star = used.select("station", F.col("node").alias("a"), F.concat(F.lit("item:"), F.col("item").cast("string")).alias("b"))
    one = up.unionByName(star).unionByName(links.select("station", "a", "b"))
    return one.unionByName(one.select("station", F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def connected_parts(edges: DataFrame) -> DataFrame:
    """(station, node, part): the least node of each node's connected part. edges: (station, a, b) both ways. Stars are rewired in turn
    to the least neighbour and to the least smaller one until nothing changes, so rounds grow with the logarithm of the longest
    path, not with its length. Each round is one shuffle by node and is cut off by a checkpoint."""
    e = checkpointed(edges.select("station", F.col("a").alias("u"), F.col("b").alias("v")).filter("u > v").distinct())
    while True:
        before = e.agg(F.count("*"), F.sum(F.hash("station", "u", "v").cast("bigint"))).first()
        both = e.unionByName(e.select("station", F.col("v").alias("u"), F.col("u").alias("v")))
        least = F.min("v").over(W.partitionBy("station", "u"))
        large = both.withColumn("m", F.least(least, "u")).filter("v > u").select("station", F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u > v").distinct()
        x = large.withColumn("m", F.min("v").over(W.partitionBy("station", "u")))
        small = x.select("station", F.col("v").alias("u"), F.col("m").alias("v")).unionByName(x.select("station", "u", F.col("m").alias("v")))
        e = checkpointed(small.filter("u > v").distinct())
        if e.agg(F.count("*"), F.sum(F.hash("station", "u", "v").cast("bigint"))).first() == before:
            break
    own = e.groupBy("station", F.col("u").alias("node")).agg(F.min("v").alias("part"))
    tops = e.select("station", F.col("v").alias("node")).distinct().join(own, ["station", "node"], "left_anti")
    return own.unionByName(tops.select("station", "node", F.col("node").alias("part")))


def reachable_sets(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """GRAPH-2. edges: (station, a, b) both ways; roots: (station, node, kind), kinds being few. (station, node, kinds): the kinds of roots that
    each node can be reached from, all root sets in one run. A root reaches itself."""
    parts = checkpointed(connected_parts(edges))
    alone = roots.select("station", "node").distinct().join(parts, ["station", "node"], "left_anti").withColumn("part", F.col("node"))
    parts = parts.unionByName(alone.select("station", "node", "part"))
    kinds = parts.join(roots, ["station", "node"]).groupBy("station", "part").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))
    return parts.join(kinds, ["station", "part"]).select("station", "node", "kinds")


def reachable_nodes(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """GRAPH-2 with one root set: roots: (station, node)."""
    return reachable_sets(edges, roots.select("station", "node", F.lit("root").alias("kind"))).select("station", "node")


def connection_class(tracks: DataFrame, reached: DataFrame, modelled: DataFrame) -> DataFrame:
    """GRAPH-3. tracks: (station, node); per station: not modelled, all, none or some connected."""
    x = tracks.join(reached.withColumn("hit", F.lit(1)), ["station", "node"], "left").groupBy("station").agg(F.count("*").alias("n"), F.count("hit").alias("k"))
    x = x.join(modelled.select("station").distinct().withColumn("m", F.lit(1)), "station", "left")
    return x.select("station", F.when(F.col("m").isNull(), "not modelled").when(F.col("k") == F.col("n"), "all").when(F.col("k") == 0, "none").otherwise("some").alias("class"), "n", "k")


def unique_slugs(named: DataFrame) -> DataFrame:
    """FN-6. (code, slug): the lower-case code is added where slugs collide."""
    n = F.count("*").over(W.partitionBy("slug"))
    return named.select("code", F.when(n > 1, F.concat_ws("-", "slug", F.lower("code"))).otherwise(F.col("slug")).alias("slug"))


def quay_counts(quays: DataFrame, equipment: DataFrame, links: DataFrame) -> DataFrame:
    """AGG-10. quays: (station, type, parent, step_free); equipment: (station, kind); links: (station), a row each. Per station with
    quays: main tracks (a sector without a parent stands for a track) in all and by step_free, where what is neither "true" nor
    "false" is unknown; islands, roots, all quays; lifts, ramps, escalators and path links."""
    main = (F.col("type") == "track") | (F.col("type") == "sector") & F.col("parent").isNull()
    free = F.coalesce("step_free", F.lit("unknown"))
    own = quays.groupBy("station").agg(
        F.count_if(main).alias("main_tracks"),
        F.count_if(main & (free == "true")).alias("step_free_true"),
        F.count_if(main & (free == "false")).alias("step_free_false"),
        F.count_if(main & ~free.isin("true", "false")).alias("step_free_unknown"),
        F.count_if(F.col("type") == "island").alias("islands"),
        F.count_if(F.col("parent").isNull()).alias("roots"),
        F.count("*").alias("quays"),
    )
    kinds = equipment.groupBy("station").agg(*[F.count_if(F.col("kind") == k).alias(f"{k}s") for k in ("lift", "ramp", "escalator")])
    paths = links.groupBy("station").agg(F.count("*").alias("links"))
    return own.join(kinds, "station", "left").join(paths, "station", "left").fillna(0, ["lifts", "ramps", "escalators", "links"])
