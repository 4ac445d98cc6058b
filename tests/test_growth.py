"""Steps whose work must grow no faster than their input: same results as the plain form, without its rows."""

import random

import pytest
from pyspark.sql import functions as F

from stepspan.operators import access, feed
from stepspan.operators import journeys as jo
from stepspan.sources import files, schemas
from stepspan.streaming import feeds, live


def logical(df) -> list[str]:
    return df._jdf.queryExecution().optimizedPlan().toString().splitlines()


def test_continuations_without_rules_are_those_of_all_pairs(spark):
    r = random.Random(3)
    rows = []
    for t in range(400):
        a, first, last = r.randrange(600, 700), r.randrange(3), r.randrange(3)
        mid = r.randrange(3, 6)
        rows += [(t, 1, first, first, a, a), (t, 2, mid, mid, a + 7, a + 8), (t, 3, last, last, a + 15, a + 15)][: r.choice([1, 3, 3, 3])]
    calls = spark.createDataFrame(rows, "trip bigint, seq int, station bigint, platform bigint, arr int, dep int")
    every = calls.select(F.col("trip").alias("from_trip")).distinct().crossJoin(calls.select(F.col("trip").alias("to_trip")).distinct())
    every = every.filter("from_trip <> to_trip").withColumn("kind", F.lit("possible"))
    want = {tuple(x) for x in jo.continuations(calls, every).collect()}
    assert {tuple(x) for x in jo.continuations(calls).collect()} == want and len(want) > 10


def test_corrections_meet_no_tracks_before_they_are_summed_up(spark):
    r = random.Random(4)
    tracks = [(s, t, r.choice(["yes", "no"])) for s in range(4) for t in range(6)]
    fixes = [(r.randrange(5), r.choice([None, *range(7)]), r.choice(["yes", "no", "maybe", None]), line) for line in range(30)]
    got = access.corrected(spark.createDataFrame(tracks, "station int, track int, status string"), spark.createDataFrame(fixes, "station int, track int, status string, line int"))
    want = set()
    for s, t, status in tracks:
        hits = [(line, new) for a, b, new, line in fixes if a == s and b in (None, t)]
        new = max((h for h in hits), default=(0, None))[1]
        want.add((s, t, new or status, "correction" if new else "source", len(hits)))
    plan = logical(got)
    first = next(i for i, line in enumerate(plan) if "Aggregate" in line)
    assert not any("Join" in line for line in plan[first:])
    assert {tuple(x) for x in got.collect()} == want


def test_journeys_by_hubs_are_those_of_all_pairs_of_platforms(spark):
    """Random trains between stations with several surfaces, a default of one minute, quick connections and barred trains."""
    r = random.Random(11)
    places = [(s, s * 10 + i, s * 10 + i // 2, i != 1) for s in range(4) for i in range(4)]
    platforms = spark.createDataFrame(places, "station bigint, platform bigint, surface bigint, step_free boolean")
    defaults = spark.createDataFrame([(0, 5), (1, 4), (2, 1)], "station bigint, minutes int")
    allowed = [(s, s * 10 + r.randrange(4), s * 10 + r.randrange(4), r.randrange(3)) for s in range(4) for _ in range(3)]
    allowed = spark.createDataFrame(sorted({x[:3]: x for x in allowed}.values()), "station bigint, from_platform bigint, to_platform bigint, allowed int")
    rows = []
    for t in range(60):
        at, last = r.randrange(540, 640), None
        for k in range(3):
            s = r.choice([x for x in range(4) if x != last])
            last, at = s, at + r.randrange(2, 9)
            rows += [(v, t, k, s, s * 10 + r.randrange(4), at, at + 1, k < 2, k > 0) for v in ("any",)]
    calls = spark.createDataFrame(rows, "variant string, trip bigint, seq int, station bigint, platform bigint, arr int, dep int, can_board boolean, can_alight boolean")
    calls = calls.unionByName(calls.withColumn("variant", F.lit("stroller")))
    usable = platforms.select("station", "platform", "step_free", F.explode(F.array(F.lit("any"), F.lit("stroller"))).alias("variant")).filter("variant = 'any' OR step_free").select("variant", "platform", "station")
    hubs, few = (x.withColumnRenamed("profile", "variant") for x in jo.change_hubs(platforms, defaults, allowed))
    pairs = jo.change_minutes(platforms, defaults, allowed).withColumnRenamed("profile", "variant").drop("station")
    spelt = hubs.alias("a").join(hubs.alias("b"), ["variant", "hub"]).select("variant", F.col("a.platform").alias("from_platform"), F.col("b.platform").alias("to_platform"), F.col("a.minutes").alias("minutes"))
    least = spelt.unionByName(few).groupBy("variant", "from_platform", "to_platform").agg(F.min("minutes").cast("int").alias("minutes"))
    assert sorted(map(tuple, least.collect())) == sorted(map(tuple, pairs.select(*least.columns).collect()))
    bars = spark.createDataFrame([(t, t + 7) for t in range(50)], "from_trip bigint, to_trip bigint")
    found = []
    for changes, more in ((pairs, {}), (few, {"hubs": hubs, "ends": usable})):
        labels = jo.search(calls, changes, usable.select("variant", "platform"), (540, 660), 700, 2, bars, **more)
        found.append(sorted(tuple(x) for x in jo.journeys(labels, usable, with_legs=False).collect()))
    assert found[0] == found[1] and len(found[0]) > 50


def network_of(spark, seed, trains):
    """Random trains between stations with slow and quick changes."""
    r = random.Random(seed)
    places = [(s, s * 10 + i, s * 10 + i // 2, i != 1) for s in range(4) for i in range(3)]
    platforms = spark.createDataFrame(places, "station bigint, platform bigint, surface bigint, step_free boolean")
    defaults = spark.createDataFrame([(0, 6), (1, 4), (2, 1)], "station bigint, minutes int")
    allowed = sorted({(s, s * 10 + r.randrange(3), s * 10 + r.randrange(3)): r.randrange(3) for s in range(4) for _ in range(3)}.items())
    allowed = spark.createDataFrame([(*k, v) for k, v in allowed], "station bigint, from_platform bigint, to_platform bigint, allowed int")
    rows, barred = [], {(t, r.randrange(trains)) for t in range(trains) for _ in range(r.choice([0, 0, 1, 2, 3]))}
    for t in range(trains):
        at, last = r.randrange(540, 600), None
        for k in range(3):
            last = r.choice([x for x in range(4) if x != last])
            at += r.randrange(2, 9)
            rows.append((t, k, last, last * 10 + (t + k) % 3, at, at + 1, k < 2, k > 0))
    calls = spark.createDataFrame(rows, "trip bigint, seq int, station bigint, platform bigint, arr int, dep int, can_board boolean, can_alight boolean")
    usable = platforms.select("station", "platform", "step_free", F.explode(F.array(F.lit("any"), F.lit("stroller"))).alias("variant")).filter("variant = 'any' OR step_free").select("variant", "platform", "station")
    bars = spark.createDataFrame(sorted((a, b) for a, b in barred if a != b), "from_trip bigint, to_trip bigint")
    hubs, few = (x.withColumnRenamed("profile", "variant") for x in jo.change_hubs(platforms, defaults, allowed))
    pairs = jo.change_minutes(platforms, defaults, allowed).withColumnRenamed("profile", "variant").drop("station")
    return calls, usable, bars, hubs, few, pairs


@pytest.mark.parametrize(("trains", "barred"), [(2, True), (2, False), (3, True)])
def test_last_round_by_hubs_has_the_journeys_and_their_legs(spark, trains, barred):
    """Calls without variant, trains barred from several others, and legs that can be ridden one after the other."""
    calls, usable, bars, hubs, few, pairs = network_of(spark, 3, 60)
    bars = bars if barred else None
    starts = usable.select("variant", "platform")
    spelt = jo.journeys(jo.search(calls, pairs, starts, (540, 600), 700, trains, bars), usable, with_legs=False)
    got = jo.journeys(jo.search(calls, few, starts, (540, 600), 700, trains, bars, hubs, usable), usable).collect()
    key = lambda x: (x.variant, x.origin, x.dest, x.k, x.tau, x.arr)
    assert sorted(map(key, got)) == sorted(map(key, spelt.collect())) and len(got) > 100
    minutes = {(x.variant, x.from_platform, x.to_platform): x.minutes for x in pairs.collect()}
    ruled_out = {tuple(x) for x in bars.collect()} if barred else set()
    assert max(len(x.legs) for x in got) == trains
    for x in got:
        assert 1 <= len(x.legs) <= x.k and x.legs[0].board_station == x.origin and x.legs[-1].alight_station == x.dest and (x.legs[0].dep, x.legs[-1].arr) == (x.tau, x.arr)
        for a, b in zip(x.legs, x.legs[1:], strict=False):
            assert b.dep - a.arr >= minutes[x.variant, a.alight, b.board] and (a.trip, b.trip) not in ruled_out


def test_matrix_by_hubs_is_that_of_all_pairs_of_platforms(spark):
    """All but the payload, where equally good journeys may differ."""
    calls, usable, bars, hubs, few, pairs = network_of(spark, 3, 40)
    calls = calls.withColumn("day_type", F.lit("weekday"))
    sets = calls.select("trip", F.explode(F.array(F.lit(0), F.lit(1))).alias("t")).distinct().filter("t = 1 OR trip % 3 > 0")
    rules = bars.withColumn("kind", F.lit("impossible"))
    usable, hubs, few, pairs = (x.withColumnRenamed("variant", "profile") for x in (usable, hubs, few, pairs))
    spelt = jo.matrix(calls, sets, rules, pairs, usable, (540, 600), 700, 1.0)
    got = jo.matrix(calls, sets, rules, few, usable, (540, 600), 700, 1.0, hubs)
    rows = [sorted(map(tuple, x.drop("payload").collect())) for x in (spelt, got)]
    assert rows[0] == rows[1] and len(rows[0]) > 30


def test_next_departure_reads_no_frame_anew(spark):
    ready = spark.createDataFrame([(1, 7, 600), (2, 7, 601), (3, 7, 700), (4, 8, 600)], "id bigint, platform bigint, at int")
    departures = spark.createDataFrame([(7, 600, 5), (7, 600, 4), (7, 650, 6)], "platform bigint, dep int, trip bigint")
    got = jo.next_departure(ready, departures, ["platform"])
    assert {x.id: (x.dep, x.trip) for x in got.collect()} == {1: (600, 4), 2: (650, 6), 3: (None, None), 4: (None, None)}
    assert not any("unboundedfollowing" in line for line in logical(got))


def test_cells_are_compared_in_one_shuffle(spark):
    r = random.Random(5)
    rows = [(o, 1, "all", p, t, k, r.randrange(20)) for o in (1, 2, None) for p in (0, 1) for t in (0, 1) for k in (0, 1, 2) if r.random() < 0.7]
    entries = spark.createDataFrame(rows, "origin int, dest int, day_type string, p int, t int, k int, median int")
    have = {x[:6]: x[6] for x in rows}
    want = set()
    for (o, d, day, p, t, k), less in have.items():
        for along, cell in (("k", (p, t, k + 1)), ("p", (p + 1, t, k)), ("t", (p, t + 1, k))):
            more = have.get((o, d, day, *cell)) if o is not None else None
            if cell[0] < 2 and cell[1] < 2 and cell[2] < 3 and (more is None or more > less):
                want.add((o, d, day, *cell, along, less, more))
    got = jo.worse_with_more(entries, "median")
    assert {tuple(x) for x in got.collect()} == want
    assert not any("Join" in line for line in logical(got))


def test_messages_are_parsed_once(spark):
    """Of good messages, of the quarantine and of both together; what is asked of the parsed body parses nothing again."""
    one = "<FacilityCondition><FacilityRef>L:{}</FacilityRef><FacilityStatus><Status>unknown</Status></FacilityStatus></FacilityCondition>"
    bodies = [("a", one.format(1) + one.format(2)), ("b", one.format(3)), ("c", None)]
    rows = [(i, None if x is None else bytearray(f"<Siri>{x}</Siri>".encode())) for i, x in bodies] + [("d", bytearray(b"no message"))]
    messages = spark.createDataFrame(rows, "id string, body binary").withColumn("received", F.lit(0).cast("timestamp"))
    good, bad = files.parsed_messages(messages, schemas.FACILITY_MESSAGE)
    found = files.lift_conditions(good, "L:", "id")
    assert sorted((x.id, x.size, x.lift, x.status) for x in found.collect()) == [("a", 2, "1", "unknown"), ("a", 2, "2", "unknown"), ("b", 1, "3", "unknown")]
    assert sorted((x.id, x.bytes, x.reason) for x in bad.collect()) == [("c", None, "not readable"), ("d", 10, "no known element")]
    for df in (found, bad, files.checked_messages(messages, schemas.FACILITY_MESSAGE), files.lift_messages(messages, "L:")):
        assert sum(line.lower().count("from_xml(") + line.lower().count("xmltostructs(") for line in logical(df)) == 1


def test_live_status_takes_two_cells_a_message_and_late_ones(spark, tmp_path):
    for k, (lift, status, at) in enumerate(((1, "available", 10), (2, "available", 50_000), (2, "available", 50_001), (1, "notAvailable", 20), (2, "available", 50_002))):
        spark.createDataFrame([(k, lift, status, at)], "id bigint, lift bigint, status string, t bigint").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id bigint, lift bigint, status string, t bigint").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    at = F.timestamp_seconds("t")
    stream = stream.select("id", "lift", "status", at.alias("start"), F.lit(None).cast("timestamp").alias("end"), at.alias("received"))
    told = live.live_status(stream)
    plan = told._jdf.queryExecution().analyzed().toString()
    assert "message#" in plan and "received_us#" not in plan
    got = {(x.lift, x.at_us // 1_000_000, x.shown) for x in feeds.run_available(told, "append", live.ROCKSDB).collect()}
    assert got == {(1, 10, None), (2, 50_000, None), (1, 20, "notAvailable")}


def test_lanes_read_the_calls_once(spark):
    """The pattern comes from the stops of the same group; the same lanes as with a table of patterns."""
    r = random.Random(9)
    rows = []
    for t in range(200):
        at, first = r.randrange(600, 900), r.randrange(3)
        for seq in range(r.choice([1, 3, 3])):
            at += r.choice([1, 2, 9])
            rows.append((t, seq, first if seq == 0 else 7, at, at + r.choice([0, 3])))
            at = rows[-1][4]
    calls = spark.createDataFrame(rows, "trip bigint, seq int, platform bigint, arr int, dep int")

    def of_stops(s):
        return F.concat(s[0]["platform"].cast("string"), F.lit(":"), F.array_join(F.transform(s, lambda c: c["seq"].cast("string")), ","))

    stops = F.sort_array(F.collect_list(F.struct("seq", "platform")))
    table = calls.groupBy("trip").agg(of_stops(stops).alias("pattern"))
    plan = logical(jo.tangles(calls, of_stops))
    assert not any("Join" in line for line in plan) and sum("RDD" in line or "LocalRelation" in line for line in plan) == 1
    got = {tuple(x) for x in jo.lanes(calls, of_stops).collect()}
    assert got == {tuple(x) for x in jo.lanes(calls, table).collect()} and len(got) == 200 and max(x[2] for x in got) > 0
