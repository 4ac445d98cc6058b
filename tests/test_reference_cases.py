"""Golden cases of the timetable, access, name, feed and source operators, and a random check of the journey search."""

import collections
import gzip
import random
from datetime import date, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from stepspan.functions import names, scalars
from stepspan.operators import access, feed, quality
from stepspan.operators import journeys as jo
from stepspan.operators import timetable as tt
from stepspan.sources import files
from stepspan.streaming import feeds

CALLS = "variant string, trip bigint, seq int, station bigint, platform bigint, arr int, dep int, can_board boolean, can_alight boolean"


def calls_of(trips, variant="any"):
    return [(variant, t, k, s, p, a, d, k < len(c), k > 1) for t, c in trips.items() for k, (s, p, a, d) in enumerate(c, 1)]


# stations O=1, X=2, Y=3, D=4; platforms station * 10 + track
FAST = {1: [(1, 11, 600, 600), (4 - 2, 21, 610, 610)], 2: [(2, 22, 615, 615), (4, 41, 630, 630)]}
SLOW = {3: [(1, 12, 600, 600), (3, 31, 620, 620)], 4: [(3, 32, 630, 630), (4, 41, 650, 650)]}
EVERY = [11, 12, 21, 22, 31, 32, 41]


def found(spark, trips, minutes=lambda a, b: 2, platforms=EVERY, window=(540, 720), forbidden=None, trains=3):
    calls = spark.createDataFrame(calls_of(trips), CALLS)
    changes = [("any", a, b, minutes(a, b)) for a in platforms for b in platforms if a // 10 == b // 10 and minutes(a, b) is not None]
    changes = spark.createDataFrame(changes, "variant string, from_platform bigint, to_platform bigint, minutes int")
    usable = spark.createDataFrame([("any", p, p // 10) for p in platforms], "variant string, platform bigint, station bigint")
    bars = spark.createDataFrame(forbidden, "from_trip bigint, to_trip bigint") if forbidden else None
    labels = jo.search(calls, changes, usable.select("variant", "platform"), window, 1200, trains, bars)
    got = jo.journeys(labels, usable)
    return {(r.origin, r.dest, r.k): r for r in jo.summarise(got, 3.5).collect()}, got


def test_toy_network(spark):
    got, _ = found(spark, FAST | SLOW)
    assert got[1, 4, 3].median == 30 and got[1, 4, 3].via == "2" and got[1, 4, 3].tracks == "11|21|22|41" and (1, 4, 1) not in got
    no_x = [p for p in EVERY if p // 10 != 2]
    slow, _ = found(spark, FAST | SLOW, platforms=no_x)
    assert slow[1, 4, 2].median == 50 and slow[1, 4, 2].via == "3"
    assert (1, 4, 3) not in found(spark, FAST, platforms=no_x)[0]
    assert found(spark, FAST | SLOW, window=(480, 539))[0] == {}


def test_minutes_and_ruled_out_connections(spark):
    assert found(spark, FAST | SLOW, forbidden=[(1, 2)])[0][1, 4, 3].median == 50
    assert (1, 4, 3) not in found(spark, FAST, minutes=lambda a, b: 6)[0]
    assert found(spark, FAST, minutes=lambda a, b: 5)[0][1, 4, 2].median == 30


def test_pareto_and_lower_median(spark):
    trips = {i: [(1, 11, 600 + 30 * i, 600 + 30 * i), (4, 41, 620 + 30 * i, 620 + 30 * i)] for i in range(4)}
    trips[9] = [(1, 11, 605, 605), (4, 41, 655, 655)]
    r = found(spark, trips, trains=1)[0][1, 4, 1]
    assert (r.median, r.fastest, r.per_hour, r.changes) == (20, 20, 1.1, 0)


@pytest.mark.parametrize(("seed", "bars"), [(1, 0), (2, 1), (3, 1), (4, 3)])
def test_search_against_all_paths(spark, seed, bars):
    """Without ruled-out connections, with one a train, and with up to three, of trains that set out alike too."""
    r = random.Random(seed)
    platforms = [s * 10 + t for s in range(1, 6) for t in (1, 2)]
    trips = {}
    for t in range(25):
        at, stops = r.randint(480, 640), []
        for p in r.sample(platforms, r.randint(2, 4)):
            dep = at + r.randint(0, 3)
            stops.append((p // 10, p, at, dep))
            at = dep + r.randint(3, 40)
        trips[t] = stops
    change = lambda a, b: 2 if a == b else 5
    best = collections.defaultdict(dict)
    for t in range(0, 25, 5):  # twins: the same times under another number, so that a barred train leaves an equal one
        trips[t + 100] = trips[t]
    barred = {(r.choice([*trips]), t) for t in trips for _ in range(bars)}

    def ride(origin, tau, platform, ready, legs, last=None):
        for number, calls in trips.items():
            if (last, number) in barred:
                continue
            for k, (_, p, _, dep) in enumerate(calls[:-1]):
                if p == platform and dep >= ready and (legs or 480 <= dep <= 640):
                    start = dep if tau is None else tau
                    for s, q, arr, _ in calls[k + 1 :]:
                        for n in range(legs + 1, 4):
                            if s != origin:
                                key = (origin, s, n)
                                best[key][start] = min(arr, best[key].get(start, 9999))
                        if legs < 2:
                            for b in platforms:
                                if b // 10 == s:
                                    ride(origin, start, b, arr + change(q, b), legs + 1, number)

    for p in platforms:
        ride(p // 10, None, p, 480, 0)
    want = set()
    for key, by in best.items():
        early = 9999
        for tau in sorted(by, reverse=True):
            if by[tau] < early:
                early = by[tau]
                want.add((*key, tau, early))
    got = found(spark, trips, minutes=change, platforms=platforms, window=(480, 640), forbidden=sorted(barred))[1].collect()
    assert {(x.origin, x.dest, x.k, x.tau, x.arr) for x in got} == want
    for x in got:  # the legs are a journey that may be made
        assert x.legs[0].dep == x.tau and x.legs[-1].arr == x.arr and len(x.legs) <= x.k
        for a, b in zip(x.legs, x.legs[1:]):
            assert a.arr + change(a.alight, b.board) <= b.dep and a.alight // 10 == b.board // 10 and (a.trip, b.trip) not in barred


def test_day_choice(spark):
    days = [date(2026, 10, 8) + timedelta(i) for i in range(56)]
    line = [("a", s) for s in "ABWC"] + [("b", s) for s in "CWBA"]
    works = [("c", s) for s in "ABC"] + [("d", s) for s in "ABC"] + [("e", s) for s in "ABC"]
    calls = spark.createDataFrame(line + works, "trip string, station string")
    trips = spark.createDataFrame([("a", "n"), ("b", "n"), ("c", "w"), ("d", "w"), ("e", "w")], "trip string, service string")
    closed = [d for d in days if date(2026, 10, 20) <= d <= date(2026, 10, 31)]
    dates = spark.createDataFrame([("w" if d in closed else "n", d) for d in days], "service string, date date")
    got = {r.day_type: r.date for r in tt.require_days(tt.choose_days(calls, trips, dates, date(2026, 10, 7))).collect()}
    assert got == {"weekday": date(2026, 10, 8), "saturday": date(2026, 10, 10)}
    with pytest.raises(ValueError):
        tt.require_days(tt.choose_days(calls, trips, dates, date(2027, 10, 7)))


def test_timetable_change(spark):
    asked = [date(y, 6, 1) for y in range(2023, 2027)] + [date(2026, 12, 13)]
    x = spark.createDataFrame([(d,) for d in asked], "d date").select("d", scalars.timetable_change(F.col("d")).alias("c"))
    assert [r.c for r in x.orderBy("d").collect()] == [date(2023, 12, 10), date(2024, 12, 15), date(2025, 12, 14), date(2026, 12, 13), date(2027, 12, 12)]


def test_rail_trips_and_train_sets(spark):
    rows = [(1, "NS", "2"), (2, None, "2"), (3, "X", "100"), (4, "NS", "118"), (5, "NS", "117"), (6, "NS", "bus")]
    df = spark.createDataFrame(rows, "trip bigint, agency string, route_type string")
    assert sorted(r.trip for r in tt.rail_trips(df, ("X",)).collect()) == [1, 5]


ENTRY = "origin string, dest string, day_type string, p int, t int, k int, median int, changes int, per_hour double, fastest int, payload string"


def best_of(spark, cells):
    rows = [("O", "D", "w", *c) for c in cells]
    return {(r.p, r.t, r.k): (r.median, r.payload) for r in jo.never_worse(spark.createDataFrame(rows, ENTRY)).collect()}


def test_dominance_lattice(spark):
    got = best_of(spark, [(1, 1, 0, 20, 0, 0.9, 20, "a"), (1, 1, 1, 31, 1, 3.1, 20, "b")])
    assert got == {(1, 1, k): (20, "a") for k in range(3)}
    got = best_of(spark, [(0, 0, 0, 45, 1, 1.0, 45, "s"), (1, 0, 0, 49, 1, 1.0, 49, "x"), (1, 1, 0, 49, 1, 1.0, 49, "y")])
    assert set(got.values()) == {(45, "s")} and len(got) == 12
    got = best_of(spark, [(1, 1, 0, 40, 0, 1.0, 40, "a"), (1, 1, 1, 30, 1, 4.0, 25, "b")])
    assert got[1, 1, 0] == (40, "a") and got[1, 1, 1] == (30, "b")
    got = best_of(spark, [(1, 1, 0, 30, 0, 2.0, 30, "a"), (1, 1, 1, 30, 1, 4.0, 25, "b")])
    assert got[1, 1, 1] == (30, "a")


def test_through_trains(spark):
    trips = {1: [(1, 11, 600, 600), (2, 21, 610, 610)], 2: [(2, 21, 612, 612), (4, 41, 630, 630)], 3: [(4, 41, 633, 633), (5, 51, 640, 640)], 7: [(2, 21, 700, 700), (1, 11, 710, 710)]}
    calls = spark.createDataFrame(calls_of(trips), CALLS)
    rules = spark.createDataFrame([(1, 2, "possible"), (2, 3, "guaranteed"), (1, 7, "possible"), (3, 1, "impossible")], "from_trip bigint, to_trip bigint, kind string")
    links = jo.continuations(calls, rules)
    assert {tuple(r) for r in links.collect()} == {(1, 2), (2, 3)}
    chained = jo.chains(calls.select("trip").distinct(), links)
    merged = jo.merged_calls(calls, chained)
    assert {r.chain for r in chained.collect()} == {"1+2+3", "7"}
    got = [(r.station, r.arr, r.dep) for r in merged.filter("chain = '1+2+3'").orderBy("seq").collect()]
    assert got == [(1, 600, 600), (2, 610, 612), (4, 630, 633), (5, 640, 640)]


def test_lanes(spark):
    trips = {1: [(1, 11, 600, 600), (2, 21, 660, 660)], 2: [(1, 11, 610, 610), (2, 21, 640, 640)], 3: [(1, 11, 620, 620), (2, 21, 680, 680)]}
    calls = spark.createDataFrame(calls_of(trips), CALLS)
    pattern = calls.select("trip", F.lit("p").alias("pattern")).distinct()
    assert {r.trip: r.lane for r in jo.lanes(calls, pattern).collect()} == {1: 0, 2: 1, 3: 0}


def test_lanes_of_random_patterns(spark):
    """Equal to first fit in order, with ties and equal trips; a trip that is clear of all others needs no Python."""
    r = random.Random(8)
    trips, where = {}, {}
    for t in range(300):
        p = r.choice(["busy", "busy", "few", None])
        start, times = r.randrange(0, 600, 5 if p == "busy" else 1), []
        for stop in range(4 if p == "few" else 3):
            start += r.choice([1, 2, 2, 9])
            times.append((stop, stop, start, start + r.choice([0, 0, 3])))
        trips[t], where[t] = times, p
    calls = spark.createDataFrame(calls_of(trips), CALLS)
    pattern = spark.createDataFrame(list(where.items()), "trip bigint, pattern string").filter("pattern IS NOT NULL")
    want = {}
    for p in ("busy", "few"):
        last: list[list[int]] = []
        for t in sorted((t for t in trips if where[t] == p), key=lambda t: (trips[t][0][3], trips[t][-1][2], t)):
            own = [x for c in trips[t] for x in c[2:]]
            lane = next((k for k, l in enumerate(last) if all(x <= y for x, y in zip(l, own))), len(last))
            last[lane : lane + 1] = [own]
            want[t] = lane
    assert max(want.values()) > 1
    assert {x.trip: x.lane for x in jo.lanes(calls, pattern).collect()} == want
    cut = jo.tangles(calls, pattern).collect()
    assert 0 < sum(x.alone for x in cut) < len(cut) and all(want[x.trip] == 0 for x in cut if x.alone)
    assert len({x.piece for x in cut if x.pattern == "busy"}) > 10
    assert jo.lanes(calls.limit(0), pattern).count() == 0


def test_known_answers_by_cell(spark):
    entries = spark.createDataFrame([("A", "B", 1, 0, 0, 13, 4.0), ("A", "B", 1, 0, 1, 13, 1.5), ("A", "C", 0, 1, 0, 40, 4.0)], "origin string, dest string, p int, t int, k int, median int, per_hour double")
    known = spark.createDataFrame([("A", "B", 1, 0, 0, 13, 4.0), ("A", "B", 1, 0, 1, 20, 2.0), ("A", "C", 0, 1, 0, 35, 2.0), ("A", "C", 0, 0, 0, 99, 0.0)], "origin string, dest string, p int, t int, k int, most int, least double")
    got = {tuple(r)[:5]: (r.median, r.per_hour) for r in quality.wrong_answers(entries, known).collect()}
    assert got == {("A", "B", 1, 0, 1): (13, 1.5), ("A", "C", 0, 1, 0): (40, 4.0), ("A", "C", 0, 0, 0): (None, None)}


def test_quay_counts_of_a_station_without_equipment(spark):
    quays = [(1, "track", None, "true"), (1, "track", 9, None), (1, "sector", 5, "true"), (1, "sector", None, "false"), (1, "island", None, "true"), (2, "island", None, None)]
    quays = spark.createDataFrame(quays, "station int, type string, parent int, step_free string")
    equipment = spark.createDataFrame([(1, "lift"), (1, "lift"), (1, "ramp"), (3, "lift"), (1, None)], "station int, kind string")
    got = {r.station: tuple(r)[1:] for r in access.quay_counts(quays, equipment, equipment.filter("kind = 'ramp'").select("station")).collect()}
    assert got == {1: (3, 1, 1, 1, 1, 3, 5, 2, 1, 0, 1), 2: (0, 0, 0, 0, 1, 1, 1, 0, 0, 0, 0)}


def test_statuses_of_a_snapshot(spark):
    listed = spark.createDataFrame([(1, "a", "out", "x"), (1, "a", "available", None), (1, "b", "out", None), (2, "a", "out", None), (2, "a", "out", "x"), (2, None, None, None)], "snapshot int, lift string, status string, end string")
    assert {tuple(r) for r in feed.snapshot_statuses(listed).collect()} == {(1, "out", 2, 3, 2, 1), (1, "available", 1, 3, 2, 1), (2, "out", 2, 3, 2, 1), (2, None, 1, 3, 2, 1)}
    assert {tuple(r) for r in feed.status_combinations(listed).collect()} == {(1, "available/out+end", 1), (2, "out/out+end", 1)}


def test_name_scores(spark):
    assert names.osa("houtne", "houten") == 1 and names.osa("utrect", "utrecht") == 1 and names.osa("abc", "cab") == 2
    words = [(["utrecht", "centraal"], ["utrecht", "centraal"], 1150), (["zzz"], ["utrecht"], None), (["utr"], ["utrecht", "centraal"], 240), (["utr", "x"], ["utrecht", "centraal"], None), (["centraal"], ["utrecht", "centraal"], 290), (["utrect"], ["utrecht"], 150), (["hout", "hout"], ["houten", "hout"], 550 - 0), (["abc"], ["abd"], None)]
    rows = [(f"q{i}", q, "c", n) for i, (q, n, _) in enumerate(words)]
    got = {r.query: r.score for r in names.name_scores(spark.createDataFrame(rows, "query string, qw array<string>, code string, nw array<string>")).collect()}
    assert got == {f"q{i}": want for i, (_, _, want) in enumerate(words) if want is not None}


def test_name_linkage_against_all_pairs(spark):
    stations = [("UT", "Utrecht Centraal", 900, []), ("HTN", "Houten", 200, []), ("HT", "'s-Hertogenbosch", 500, []), ("ASD", "Amsterdam Centraal", 800, ["Amsterdam CS"]), ("LUIK", "Liège-Guillemins", 10, None), ("ZL", "Zwolle", 1, [])]
    queries = ["utrect cs", "houtne", "den bosch", "a'dam cs", "liege", "ut", "zwol", "qqqq", "amsterdam central station", "houten", "utr"]
    q = spark.createDataFrame([(x,) for x in queries], "query string")
    s = spark.createDataFrame(stations, "code string, name string, trains int, aliases array<string>")
    got = {r.query: r.code for r in names.link(q, s).filter("place = 1").collect()}
    assert got == {"utrect cs": "UT", "houtne": "HTN", "den bosch": "HT", "a'dam cs": "ASD", "liege": "LUIK", "ut": "UT", "zwol": "ZL", "amsterdam central station": "ASD", "houten": "HTN", "utr": "UT"}


def test_slugs_and_keys(spark):
    rows = [("ah", "'s-Hertogenbosch Oost"), ("lg", "Liège-Guillemins"), ("HGL", "Hengelo"), ("XHG", "Hengelo")]
    x = spark.createDataFrame(rows, "code string, name string")
    got = {r.code: r.slug for r in access.unique_slugs(x.withColumn("slug", scalars.slug(F.col("name")))).collect()}
    assert got == {"ah": "s-hertogenbosch-oost", "lg": "liege-guillemins", "HGL": "hengelo-hgl", "XHG": "hengelo-xhg"}


def test_train_verdicts(spark):
    marks = [(date(2026, 10, d), 1100, "J") for d in (5, 6, 7)] + [(date(2026, 10, d), 700, m) for d, m in ((5, "J"), (6, "J"), (7, "N"))] + [(date(2026, 10, 5), 702, "N"), (date(2026, 10, 5), 4000, "J"), (date(2026, 10, 10), 702, "J"), (date(2026, 9, 1), 9, "N")]
    df = spark.createDataFrame(marks, "date date, train int, mark string")
    got = {r.train: r.verdict for r in feed.train_verdicts(df, F.lit("2026-10-30").cast("date")).collect()}
    assert got == {1100: True, 700: False, 702: False}


def test_publish_ticks(spark):
    rows = [("f", 1, t, d) for t, d in ((0, "a"), (2, "a"), (4, "b"), (6, "b"), (12, "b"), (14, "b"), (16, "c"))]
    got = feed.publish_ticks(spark.createDataFrame(rows, "feed string, day int, tick int, digest string"))
    assert sorted(r.tick for r in got.collect()) == [0, 4, 14, 16]


XML = """<d xmlns="http://netex"><StopPlace id="NL:SP:1"><privateCodes><PrivateCode>NL:S:tst</PrivateCode></privateCodes><Name>Test</Name><TransportMode>rail</TransportMode>
<placeEquipments><LiftEquipment id="L:77"><PublicCode>7</PublicCode></LiftEquipment></placeEquipments><quays>
<Quay id="i"><PublicCode>1-2</PublicCode><QuayType>railIslandPlatform</QuayType><equipmentPlaces><EquipmentPlace><placeEquipments><LiftEquipmentRef ref="L:77"/></placeEquipments></EquipmentPlace></equipmentPlaces></Quay>
<Quay id="t1"><PublicCode>1</PublicCode><QuayType>railPlatform</QuayType><ParentQuayRef ref="i"/><AccessibilityAssessment><limitations><AccessibilityLimitation><StepFreeAccess>true</StepFreeAccess></AccessibilityLimitation></limitations></AccessibilityAssessment></Quay>
<Quay id="t3"><PublicCode>3</PublicCode><QuayType>railPlatform</QuayType><AccessibilityAssessment><limitations><AccessibilityLimitation><StepFreeAccess>false</StepFreeAccess></AccessibilityLimitation></limitations></AccessibilityAssessment></Quay>
<Quay id="s3b"><PublicCode>3b</PublicCode><QuayType>railPlatformSector</QuayType><ParentQuayRef ref="t3"/></Quay></quays></StopPlace>
<StopPlace id="NL:SP:2"><TransportMode>bus</TransportMode></StopPlace></d>"""


def test_accessibility_file(spark, tmp_path):
    path = str(tmp_path / "a.xml.gz")
    with gzip.open(path, "wt") as f:
        f.write(XML)
    places = files.stop_places(spark, path)
    assert [(r.code, r.uic, r.name) for r in places.collect()] == [("TST", "1", "Test")]
    q = files.quays(places)
    got = {r.id: (r.track, r.type, r.parent, r.status, r.lift_refs) for r in q.collect()}
    assert got == {"i": ("1-2", "island", None, "unknown", ["L:77"]), "t1": ("1", "track", "i", "yes", []), "t3": ("3", "track", None, "no", []), "s3b": ("3b", "sector", "t3", "unknown", [])}
    up = {r.id: r.surface for r in access.surfaces(q).collect()}
    assert up == {"i": "i", "t1": "i", "t3": "t3", "s3b": "t3"}


def test_text_files(spark, tmp_path):
    (tmp_path / "f.dat").write_bytes("@x\n ut , NL , 5 , Utrécht \nasd,NL,x,Amsterdam\n".encode("latin-1"))
    assert [tuple(r) for r in files.fixed_order(spark, str(tmp_path / "f.dat")).orderBy("code").collect()] == [("ASD", "NL", None, "Amsterdam"), ("UT", "NL", 5, "Utrécht")]
    (tmp_path / "s.txt").write_text("x\n#ut\n-lift\n-shop\n#asd\n-lift\n#hn\n")
    sections = files.sections(spark, str(tmp_path / "s.txt"))
    assert {r.station: r.attributes for r in sections.collect()} == {"UT": ["lift", "shop"], "ASD": ["lift"], "HN": []}
    assert {r.station: r.shop for r in files.flags(sections, ["shop"]).collect()} == {"UT": True, "ASD": False, "HN": False}
    (tmp_path / "o.json").write_text('{"elements":[{"type":"node","id":"1","lat":1.0,"lon":2.0,"tags":{"railway":"station","name":"A","railway:ref":""}},{"type":"way","id":"2","center":{"lat":3.0,"lon":4.0},"tags":{"highway":"elevator"}}]}')
    stations, lifts = files.osm_elements(spark, str(tmp_path / "o.json"))
    assert [(r.id, r.lat, r.code, r.name) for r in stations.collect()] == [("1", 1.0, None, "A")] and [(r.id, r.lon) for r in lifts.collect()] == [("2", 4.0)]
    (tmp_path / "c.csv").write_text("ns_code,track,status,reason,source,date\nTST,3,yes,r,s,2026-10-01\nTST,,yes,r,s,2026-10-02\n")
    assert [r.track for r in files.corrections(spark, str(tmp_path / "c.csv")).orderBy("date").collect()] == ["3", None]
    (tmp_path / "stops.txt").write_bytes(b"stop_name,stop_id,extra\nUtr\xff,1,x\n")
    got = files.gtfs(spark, str(tmp_path), "stops").collect()[0]
    assert got.stop_id == "1" and got.zone_id is None and got.stop_name.startswith("Utr")


def test_journey_messages(spark):
    def message(*units):
        parts = "".join(f"<n:MaterieelDeel><n:MaterieelDeelToegankelijk>{u}</n:MaterieelDeelToegankelijk></n:MaterieelDeel>" if u else "<n:MaterieelDeel/>" for u in units)
        return f'<n:M xmlns:n="urn:x"><n:RitInfo><n:TreinDatum>2026-10-05</n:TreinDatum><n:LogischeRit><n:LogischeRitDeel><n:LogischeRitDeelNummer>7</n:LogischeRitDeelNummer>{parts}</n:LogischeRitDeel></n:LogischeRit></n:RitInfo></n:M>'.encode()

    rows = [(1, bytearray(message("J", "J"))), (2, bytearray(gzip.compress(message("J", "N")))), (3, bytearray(message())), (4, bytearray(message("J", "")))]
    got = {r.id: (r.date, r.train, r.mark) for r in files.journey_marks(spark.createDataFrame(rows, "id int, body binary")).collect()}
    assert got == {1: (date(2026, 10, 5), "7", "J"), 2: (date(2026, 10, 5), "7", "N")}


def test_publish_keeps_the_last_good_run(spark, tmp_path):
    base = str(tmp_path / "out")
    good = spark.createDataFrame([("a-b", "yes")], "slug string, status string")
    files.publish({"stations": good}, base, "r1", {"slugs": quality.station_faults(good)})
    bad = spark.createDataFrame([("A b", "yes")], "slug string, status string")
    with pytest.raises(ValueError, match="slugs"):
        files.publish({"stations": bad}, base, "r2", {"slugs": quality.station_faults(bad)})
    assert [r.slug for r in files.current(spark, base, "stations").collect()] == ["a-b"]


def test_stream_equals_batch_in_any_order(spark, tmp_path):
    r = random.Random(4)
    t0 = 1_700_000_000
    rows = [(i, i % 7, r.choice(["available", "notAvailable"]), t0 + 60 * r.randint(0, 40), None if i % 3 else t0 + 60 * (50 + i)) for i in range(200)]
    schema = "id bigint, lift bigint, status string, s bigint, e bigint"
    cols = ["id", "lift", "status", F.timestamp_seconds("s").alias("start"), F.timestamp_seconds("e").alias("end")]
    order = rows[:]
    r.shuffle(order)
    for k in range(5):
        spark.createDataFrame(order[k::5], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).select(*cols)
    got = feeds.current_states(feeds.run_available(feeds.lift_states(stream), "update").drop("batch"))
    want = feed.latest_conditions(spark.createDataFrame(rows, schema).select(*cols)).select("lift", "id", "status", F.unix_micros("start"), F.unix_micros("end"))
    assert sorted(map(tuple, got.select("lift", "id", "status", "start_us", "end_us").collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_full_state_reset(spark):
    states = spark.createDataFrame([(1, 10), (2, 30)], "lift int, seen int")
    assert [r.lift for r in feeds.listed_since_full_state(states, spark.createDataFrame([(20,), (5,)], "at int")).collect()] == [2]
    assert feeds.listed_since_full_state(states, spark.createDataFrame([], "at int")).count() == 2


def test_full_state_replaces_what_a_lift_had(spark, tmp_path):
    """In whatever order the messages come; a resend received later wins."""
    rows = [(1, 1, "a", 5, 10, False), (2, 1, "b", 7, 20, True), (3, 1, "c", 9, 30, False), (4, 1, "d", 9, 31, False), (5, 2, "e", 5, 10, False)]
    schema = "id bigint, lift bigint, status string, s bigint, r bigint, full boolean"
    cols = ["id", "lift", "status", F.timestamp_seconds("s").alias("start"), F.lit(None).cast("timestamp").alias("end"), F.timestamp_seconds("r").alias("received"), "full"]
    for n, order in enumerate((rows, rows[::-1])):
        at = str(tmp_path / f"in{n}")
        for row in order:
            spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(at)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(at).select(*cols)
        states = feeds.current_states(feeds.run_available(feeds.lift_states(stream), "update").drop("batch"))
        assert sorted((r.lift, r.status, r.seen_us) for r in states.collect()) == [(1, "b", 31_000_000), (1, "d", 31_000_000), (2, "e", 10_000_000)]
        listed = feeds.listed_since_full_state(states.withColumn("seen", F.col("seen_us")), spark.createDataFrame([(20_000_000,)], "at bigint"))
        assert {r.lift for r in listed.collect()} == {1}


def test_hold_and_publish_over_batches(spark, tmp_path):
    """STR-2, STR-5: states go on from batch to batch; a tick with a problem is never published."""
    r = random.Random(9)
    seen = [(i % 3, 60 * (i // 3), r.choice(["available", "available", "available", "notAvailable", "unknown"])) for i in range(180)]
    ticks = [(i % 2, 1, i // 2 * 2, r.choice("ab"), r.choice([None, None, "too many out"])) for i in range(120)]
    for name, rows, schema in (("seen", seen, "lift bigint, s bigint, status string"), ("ticks", ticks, "feed int, day int, tick int, digest string, problem string")):
        for k in range(4):
            n = len(rows) // 4
            spark.createDataFrame(rows[k * n : (k + 1) * n], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    now = F.timestamp_seconds("s").alias("now")
    stream = spark.readStream.schema("lift bigint, s bigint, status string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "seen"))
    got = feeds.run_available(feeds.held_back(stream.select("lift", now, "status"), 5), "append").select("lift", "now_us", "status", "shown")
    want = feed.held_back(spark.read.parquet(str(tmp_path / "seen")).select("lift", now, "status"), 5).select("lift", F.unix_micros("now"), "status", "shown")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, want.collect())))
    stream = spark.readStream.schema("feed int, day int, tick int, digest string, problem string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "ticks"))
    got = feeds.run_available(feeds.published_ticks(stream), "append").drop("batch").collect()
    want = feed.publish_ticks(spark.read.parquet(str(tmp_path / "ticks"))).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and not {tuple(x) for x in got} & {t[:4] for t in ticks if t[4]}


def test_reachable_over_a_long_path(spark):
    """GRAPH-2: a path of 1,000 nodes, two root sets at once, a root without edges, a part without a root."""
    path = [("S", f"n{i * 7 % 1000:03d}", f"n{(i + 1) * 7 % 1000:03d}") for i in range(999)] + [("T", "x", "y"), ("T", "p", "q")]
    edges = spark.createDataFrame(path + [(s, b, a) for s, a, b in path], "station string, a string, b string")
    roots = spark.createDataFrame([("S", "n500", "hall"), ("S", "n000", "entrance"), ("T", "y", "hall"), ("U", "z", "entrance")], "station string, node string, kind string")
    got = {(r.station, r.node): r.kinds for r in access.reachable_sets(edges, roots).collect()}
    assert got == {**{("S", f"n{i:03d}"): ["entrance", "hall"] for i in range(1000)}, ("T", "x"): ["hall"], ("T", "y"): ["hall"], ("U", "z"): ["entrance"]}
    assert access.reachable_nodes(edges.limit(0), roots.select("station", "node")).count() == 4


CONDITION = "id bigint, lift bigint, status string, s bigint, e bigint"


def conditions_of(spark, rows):
    return spark.createDataFrame(rows, CONDITION).select("id", "lift", "status", F.timestamp_seconds("s").alias("start"), F.timestamp_seconds("e").alias("end"))


@pytest.mark.parametrize("seed", [1, 2])
def test_status_at_against_all_pairs(spark, seed):
    """JOIN-14: conditions without start or end, nested ones, equal starts, instants on the boundaries and over several days."""
    r = random.Random(seed)
    span = 86400 * seed
    t = lambda: r.choice([None, *range(0, span, span // 40)])
    rows = [(i, r.randint(0, 3), r.choice(["available", "notAvailable"]), t(), t()) for i in range(120)]
    asked = [(r.randint(0, 4), r.randint(0, 40) * (span // 40) + r.choice([0, 1])) for _ in range(150)]
    instants = spark.createDataFrame(asked, "lift bigint, t bigint").select("lift", F.timestamp_seconds("t").alias("now"))
    got = {(x.lift, x.t): x.status for x in feed.status_at(conditions_of(spark, rows), instants).select("lift", F.unix_seconds("now").alias("t"), "status").collect()}
    for lift, now in asked:
        valid = [(s or 0, i, status) for i, own, status, s, e in rows if own == lift and (s is None or s <= now) and (e is None or e > now)]
        assert got[lift, now] == (max(valid)[2] if valid else "unknown")


def test_the_newest_valid_condition_wins(spark):
    rows = [(1, 1, "notAvailable", 10, None), (2, 1, "available", 20, None), (3, 2, "unknown", 10, None), (4, 2, "notAvailable", 20, 30), (5, 3, "available", 1, None), (6, 3, "notAvailable", 50, 60)]
    instants = spark.createDataFrame([(i, t) for i in (1, 2, 3) for t in (40, 55)], "lift bigint, t bigint").select("lift", F.timestamp_seconds("t").alias("now"))
    got = {(x.lift, x.now.minute * 60 + x.now.second): x.status for x in feed.status_at(conditions_of(spark, rows), instants).collect()}
    assert got == {(1, 40): "available", (1, 55): "available", (2, 40): "unknown", (2, 55): "unknown", (3, 40): "available", (3, 55): "notAvailable"}
    assert feed.status_at(conditions_of(spark, []), instants).filter("status <> 'unknown'").count() == 0


def shown_by_hand(rows, keep, hold, forget, end):
    """What live_status should tell of one lift, second by second. rows: (id, status, start, end, received, full) as they come."""
    held, told, shown, before, back, seen, full_at = {}, [], "new", None, None, None, -1
    for now in range(end + 1):
        if seen is not None and now >= seen + forget:
            told.append((now, "gone"))
            held, shown, before, back, seen, full_at = {}, "new", None, None, None, -1
        for i, status, s, e, received, full in rows:
            if received != now:
                continue
            seen, full_at = now, now if full else full_at
            if s not in held or (held[s][3], held[s][0]) < (received, i):
                held[s] = (i, status, e, received)
            held = dict(sorted((k, h) for k, h in held.items() if h[3] >= full_at)[-keep:])
        if seen is None:
            continue
        valid = [(s, h[0], h[1]) for s, h in held.items() if s <= now and (h[2] is None or h[2] > now)]
        status = max(valid)[2] if valid else "unknown"
        back = now if status == "available" and before not in (None, "available") else back
        before = status
        new = status if status != "available" else "back" if back is not None and now - back < hold else None
        if new != shown:
            shown = new
            told.append((now, new))
    return told


@pytest.mark.parametrize("seed", [1, 2])
def test_live_status_without_ticks(spark, tmp_path, seed):
    """STR-1, STR-2: future starts, ends, holds and silences take effect by timers; states of silent lifts go."""
    from stepspan.streaming import live

    r = random.Random(seed)
    rows, n = [], 0
    for lift in range(6):
        for received in sorted(r.sample(range(0, 3000), 12)):
            n += 1
            start = max(0, received + r.randint(-300, 300))
            rows.append((n, lift, r.choice(["available", "available", "notAvailable", "unknown"]), start, None if r.random() < 0.5 else start + r.randint(1, 500), received, r.random() < 0.15))
    rows.append((999, 99, "available", 0, None, 9000, False))  # time goes on
    rows.sort(key=lambda x: x[5])
    schema = "id bigint, lift bigint, status string, s bigint, e bigint, r bigint, full boolean"
    parts = [rows[i : i + 20] for i in range(0, len(rows), 20)]
    for part in [*parts, [(1000, 99, "available", 0, None, 9001, False)]]:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    at = F.timestamp_seconds
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream = stream.select("id", "lift", "status", at("s").alias("start"), at("e").alias("end"), at("r").alias("received"), "full")
    got = feeds.run_available(live.live_status(stream, 3, 10, 50), "append", live.ROCKSDB).collect()
    for lift in range(6):
        own = [(i, st, s, e, rec, full) for i, x, st, s, e, rec, full in rows if x == lift]
        told = {(x.at_us // 1_000_000, x.shown) for x in got if x.lift == lift}
        want = shown_by_hand(own, 3, 600, 3000, 8999)
        assert (told - {*want}, {*want} - told, len(told)) == (set(), set(), len(want)), (lift, own)
    assert {x.lift for x in got if x.shown == "gone"} == set(range(6))


def test_live_status_keeps_every_open_condition(spark, tmp_path):
    """Long conditions under many short ones come back when these have ended; resends and full states count as before."""
    from stepspan.streaming import live

    r = random.Random(5)
    rows, n = [(0, 0, "notAvailable", 1, None, 1, False)], 1
    for received in range(10, 130, 10):
        rows.append((n, 0, "available", received, received + 150 - received // 2, received, False))
        n += 1
    for lift in (1, 2):
        for received in sorted(r.sample(range(0, 3000), 60)):
            start = received if r.random() < 0.7 else r.choice([0, 100, 200, max(0, received - 400), received + 90])
            rows.append((n, lift, r.choice(["available", "notAvailable", "unknown"]), start, None if r.random() < 0.3 else start + r.randint(1, 900), received, r.random() < 0.02))
            n += 1
    rows.append((9998, 99, "available", 0, None, 9000, False))  # time goes on
    rows.sort(key=lambda x: x[5])
    schema = "id bigint, lift bigint, status string, s bigint, e bigint, r bigint, full boolean"
    for part in [*(rows[i : i + 30] for i in range(0, len(rows), 30)), [(9999, 99, "available", 0, None, 9001, False)]]:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    at = F.timestamp_seconds
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream = stream.select("id", "lift", "status", at("s").alias("start"), at("e").alias("end"), at("r").alias("received"), "full")
    got = feeds.run_available(live.live_status(stream, hold_minutes=1, forget_minutes=60), "append", live.ROCKSDB).collect()
    for lift in range(3):
        own = [(i, st, s, e, rec, full) for i, x, st, s, e, rec, full in rows if x == lift]
        want = shown_by_hand(own, 1000, 60, 3600, 8999)
        assert sorted((x.at_us // 1_000_000, x.shown or "") for x in got if x.lift == lift) == sorted((t, x or "") for t, x in want), lift
        if lift == 0:
            assert (210, "notAvailable") in want and want != shown_by_hand(own, 3, 60, 3600, 8999)


def test_live_state_is_forgotten(spark, tmp_path):
    from stepspan.streaming import live

    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    for k, received in enumerate((10, 20, 100_000, 100_001)):
        spark.createDataFrame([(k * 10 + i, k * 10 + i, "notAvailable", 0, received) for i in range(10)], "id bigint, lift bigint, status string, s bigint, r bigint").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id bigint, lift bigint, status string, s bigint, r bigint").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream = stream.select("id", "lift", "status", F.timestamp_seconds("s").alias("start"), F.lit(None).cast("timestamp").alias("end"), F.timestamp_seconds("r").alias("received"))
    spark.conf.set(provider, live.ROCKSDB)
    try:
        run = live.live_status(stream, forget_minutes=60).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).format("noop").start()
    finally:
        spark.conf.set(provider, before)
    run.awaitTermination()
    live_lifts = run.lastProgress["stateOperators"][0]["customMetrics"]
    told = {k: v for k, v in live_lifts.items() if "Timer" in k or "Deleted" in k or "ValueStateVars" in k}
    assert run.lastProgress["stateOperators"][0]["numRowsTotal"] <= 10 * 5 + 10, (told, run.lastProgress["stateOperators"][0]["numRowsTotal"])


def test_publish_survives_a_crash_at_any_step(spark, tmp_path, monkeypatch):
    """SNK-5: before the one step that publishes, the last run stays readable; broken pointers are passed over."""
    base = str(tmp_path / "out")
    one, two = (spark.createDataFrame([(n,)], "n int") for n in (1, 2))
    with pytest.raises(ValueError, match="nothing"):
        files.current(spark, base, "t")
    files.publish({"t": one}, base, "r1", {})

    def crash(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(files, "_point", crash)
        with pytest.raises(RuntimeError):
            files.publish({"t": two}, base, "r2", {})
    assert files.current(spark, base, "t").first().n == 1
    (tmp_path / "out" / "pointers" / "000000000009.json").write_text('{"run": "r')
    (tmp_path / "out" / "pointers" / ".000000000010-x").write_text("")
    assert files.current(spark, base, "t").first().n == 1
    files.publish({"t": two}, base, "r2", {})  # the same run, once more
    assert files.current(spark, base, "t").first().n == 2
    files.publish({"t": one}, base, "r2", {})  # published already: nothing is written
    assert files.current(spark, base, "t").first().n == 2


def test_batches_are_published_once(spark, tmp_path):
    base = str(tmp_path / "out")
    sink = files.publish_batches(base, lambda b: {"t": b}, lambda t: {"enough": quality.too_few(t["t"], 2)})
    df = lambda *ns: spark.createDataFrame([(n,) for n in ns], "n int")
    sink(df(1, 2), 0)
    sink(df(3, 4), 0)  # a replay of batch 0: what was published stays
    assert sorted(r.n for r in files.current(spark, base, "t").collect()) == [1, 2]
    sink(df(5), 1)  # fails its check: the last good one stays
    assert sorted(r.n for r in files.current(spark, base, "t").collect()) == [1, 2]
    sink(df(6, 7), 2)
    assert sorted(r.n for r in files.current(spark, base, "t").collect()) == [6, 7]
    assert len(files._pointers(spark, base)) == 2


def test_message_files_and_quarantine(spark, tmp_path):
    from stepspan.sources import schemas

    xml = '<s:Siri xmlns:s="u"><s:FacilityCondition><s:FacilityRef>L:7</s:FacilityRef><s:FacilityStatus><s:Status>notAvailable</s:Status></s:FacilityStatus></s:FacilityCondition></s:Siri>'
    beat = '<s:Siri xmlns:s="u"><s:HeartbeatNotification><s:Status>true</s:Status></s:HeartbeatNotification></s:Siri>'
    bodies = {"a.xml": xml.encode(), "b.xml.gz": gzip.compress(xml.replace("L:7", "L:8").encode()), "c.gz": gzip.compress(xml.encode())[:20], "d.xml": b"no message", "e.xml": b"", "f.xml": beat.encode()}
    (tmp_path / "in").mkdir()
    for name, body in bodies.items():
        (tmp_path / "in" / name).write_bytes(body)
    good, bad = files.parsed_messages(files.message_files(spark, str(tmp_path / "in"), 2), schemas.FACILITY_MESSAGE)
    got = feeds.run_available(files.lift_conditions(good, "L:", "id"), "append").collect()
    assert sorted((r.id.rsplit("/", 1)[1], r.lift, r.status, r.heartbeat) for r in got) == [("a.xml", "7", "notAvailable", False), ("b.xml.gz", "8", "notAvailable", False), ("f.xml", None, None, True)]
    wrong = feeds.run_available(bad, "append").collect()
    assert sorted((r.id.rsplit("/", 1)[1], r.reason) for r in wrong) == [("c.gz", "not readable"), ("d.xml", "no known element")]  # an empty file is no message: Spark gives no row for it


def test_ages_of_outages(spark):
    day = 86400
    rows = [(1, 1, "notAvailable", 40 * day, 50 * day), (2, 2, "unknown", 40 * day - 1, None), (3, 3, "notAvailable", 11 * day, None), (4, 4, "notAvailable", 11 * day - 1, None), (5, 5, "notAvailable", None, None), (6, 6, "available", 1, None)]
    lifts = spark.createDataFrame([(1, ["1"]), (2, []), (3, ["2a"]), (3, ["4"])], "lift bigint, tracks array<string>")
    got = {x.bucket: (x.n, x.planned_end, x.serving) for x in feed.outage_ages(conditions_of(spark, rows), F.timestamp_seconds(F.lit(41 * day)), lifts).collect()}
    assert got == {"up to 1 day": (1, 1, 1), "up to 30 days": (2, 0, 1), "over 30 days": (1, 0, 0), "no start": (1, 0, 0)}


def test_tracks_with_letters_and_stale_statuses(spark):
    stops = spark.createDataFrame([(1, 1, 9, "18b", "start"), (2, 1, 9, "18", "change"), (3, 1, 9, "19", "end"), (4, 1, 9, "?", "change"), (5, 1, 8, None, "change")], "journey int, place int, station int, track string, role string")
    lifts = spark.createDataFrame([(9, 1, ["18A"], False), (9, 2, ["18a"], False), (8, 3, [], True)], "station int, lift int, tracks array<string>, hall boolean")
    current = spark.createDataFrame([(1, "notAvailable", True), (2, "unknown", False), (3, "notAvailable", True)], "lift int, shown string, fresh boolean")
    got = {x.journey: (x.warning, x.lifts) for x in feed.lift_warnings(stops, lifts, current).collect()}
    assert got == {1: ("out", 1), 2: ("out", 1), 4: ("out", 1)}


def test_drift_of_a_daily_state(spark):
    """AGG-19 by hand: lift 1 goes out unseen for 40 of 100 seconds, lift 2 is listed twice, lift 3 was never listed."""
    full = spark.createDataFrame([(1, 1, 1, "available"), (1, 2, 2, "available"), (1, 3, 2, "notAvailable"), (2, 9, 1, "available"), (2, 10, 2, "notAvailable"), (2, 11, 2, "available"), (2, 12, 4, "available")], "period long, id long, lift long, status string")
    changes = spark.createDataFrame([(5, 1, 110, "notAvailable"), (6, 1, 150, "available"), (7, 3, 180, "available"), (8, 1, 100, "notAvailable")], "id long, lift long, t long, status string").select("id", "lift", F.timestamp_seconds("t").alias("at"), "status")
    periods = spark.createDataFrame([(1, 100, 200), (2, 200, 300)], "period long, b long, u long").select("period", F.timestamp_seconds("b").alias("begin"), F.timestamp_seconds("u").alias("until"))
    silences = spark.createDataFrame([(150,), (200,)], "t long").select(F.timestamp_seconds("t").alias("since"))
    one, two = feed.drift(full, changes, periods, silences).orderBy("period").collect()
    assert (one.changes, one.went_out, one.shown_working, one.shown_out, one.mean_shown_working, one.mean_shown_out, one.differing, one.silent) == (3, 1, 40.0, 20.0, 0.4, 0.2, 2, True)
    assert (two.changes, two.went_out, two.differing, two.silent) == (0, 0, None, False)


def test_near_points_against_all_pairs(spark):
    r = random.Random(7)
    a = [(i, 52 + r.random() / 50, 5 + r.random() / 50) for i in range(80)]
    b = [(i, 52 + r.random() / 50, 5 + r.random() / 50) for i in range(80)]
    got = access.near_points(spark.createDataFrame(a, "id int, lat double, lon double"), spark.createDataFrame(b, "other int, lat double, lon double"), 250.0)
    want = {(i, j) for i, y, x in a for j, v, u in b if ((y - v) * 111320) ** 2 + ((x - u) * 68000) ** 2 < 250**2}
    assert {tuple(x) for x in got.collect()} == want and want


def test_matrix_of_all_variants(spark):
    """ROUTE-5: a through train is one train in both sets; a train outside the smaller set helps only the larger one."""
    trips = {1: [(1, 11, 600, 600), (2, 21, 610, 610)], 2: [(2, 21, 612, 612), (4, 41, 630, 630)], 3: [(1, 11, 605, 605), (4, 41, 620, 620)]}
    calls = spark.createDataFrame(calls_of(trips, "weekday"), CALLS).withColumnRenamed("variant", "day_type")
    sets = spark.createDataFrame([(1, 0), (2, 0), (1, 1), (2, 1), (3, 1)], "trip bigint, t int")
    rules = spark.createDataFrame([(1, 2, "possible")], "from_trip bigint, to_trip bigint, kind string")
    both = [(p, x) for p in ("any", "stroller") for x in (11, 21, 41) if (p, x) != ("stroller", 21)]
    changes = spark.createDataFrame([(p, x, x, 5) for p, x in both], "profile string, from_platform bigint, to_platform bigint, minutes int")
    usable = spark.createDataFrame([(p, x, x // 10) for p, x in both], "profile string, platform bigint, station bigint")
    got = {(r.p, r.t, r.k, r.origin, r.dest): (r.fastest, r.changes) for r in jo.matrix(calls, sets, rules, changes, usable, (540, 720), 1200, 3.5).collect()}
    for p in (0, 1):
        for k in (0, 1, 2):
            assert got[p, 0, k, 1, 4] == (30, 0) and got[p, 1, k, 1, 4] == (15, 0)
            assert ((p, 0, k, 1, 2) in got) == (p == 1)


def test_marks_of_trains_in_by_their_verdict(spark):
    """PRJ-5 to DQ-3: a part marks the whole through train; an entry is marked if its median journey takes one."""
    rows = [("NS", "IC", True), ("NS", "IC", None), ("NS", "SPR", True), ("NS", "SPR", False), ("X", "IC", True), ("NS", "bus", True), (None, None, True)]
    x = spark.createDataFrame(rows, "agency string, category string, verdict boolean")
    for kind, want in (("small", [True] + [False] * 6), ("all", [False] * 7)):
        mark = tt.in_only_by_verdict(F.col("agency"), F.col("category"), F.lit(kind), F.col("verdict"), ("bad",), ("bus",), ("NS",), ("SPR",))
        assert [r.m for r in x.select(mark.alias("m")).collect()] == want
    trips = {1: [(1, 11, 600, 600), (2, 21, 610, 610)], 2: [(2, 21, 612, 612), (4, 41, 630, 630)], 3: [(4, 41, 640, 640), (5, 51, 650, 650)]}
    calls = spark.createDataFrame(calls_of(trips, "weekday"), CALLS).withColumnRenamed("variant", "day_type")
    sets = spark.createDataFrame([(t, s, (t, s) == (2, 0)) for t in trips for s in (0, 1)], "trip bigint, t int, marked boolean")
    rules = spark.createDataFrame([(1, 2, "possible")], "from_trip bigint, to_trip bigint, kind string")
    changes = spark.createDataFrame([("any", x, x, 5) for x in (11, 21, 41, 51)], "profile string, from_platform bigint, to_platform bigint, minutes int")
    usable = spark.createDataFrame([("any", x, x // 10) for x in (11, 21, 41, 51)], "profile string, platform bigint, station bigint")
    got = {(r.t, r.k, r.origin, r.dest): r.payload for r in jo.matrix(calls, sets, rules, changes, usable, (540, 720), 1200, 3.5).filter("p = 1").collect()}
    assert got[0, 0, 1, 4] == ";11|41;1" and got[0, 1, 1, 5] == "4;11|41|41|51;1" and got[0, 0, 4, 5] == ";41|51"
    assert got[1, 1, 4, 5] == ";41|51"
    entry = "k int, median int, fastest int, per_hour double, changes int, via string, tracks string, mark int"
    entries = spark.createDataFrame([(0, 9, 9, 1.0, 0, "", "1|2", 1), (0, 9, 9, 1.0, 0, "", "1|2", None), (0, 9, 9, 1.0, 0, "", "1|2", 0)], entry)
    assert [r.mark for r in jo.malformed(entries).collect()] == [0]


def test_ruled_out_connections_of_merged_trains(spark):
    """JOIN-12 in ROUTE-5: a rule about a part of a through train holds for the whole of it, in each set for itself."""
    trips = {1: [(1, 11, 600, 600), (2, 21, 610, 610)], 2: [(2, 22, 620, 620), (4, 41, 630, 630)], 3: [(4, 41, 632, 632), (5, 51, 640, 640)], 4: [(2, 22, 640, 640), (4, 41, 650, 650)]}
    calls = spark.createDataFrame(calls_of(trips, "weekday"), CALLS).withColumnRenamed("variant", "day_type")
    sets = spark.createDataFrame([(t, s) for t in trips for s in (0, 1) if (t, s) != (3, 0)], "trip bigint, t int")
    rules = spark.createDataFrame([(2, 3, "possible"), (1, 3, "impossible")], "from_trip bigint, to_trip bigint, kind string")
    changes = spark.createDataFrame([("any", a, b, 5) for a, b in ((11, 11), (21, 22), (41, 41), (51, 51))], "profile string, from_platform bigint, to_platform bigint, minutes int")
    usable = spark.createDataFrame([("any", x, x // 10) for x in (11, 21, 22, 41, 51)], "profile string, platform bigint, station bigint")
    labels = {}
    got = jo.matrix(calls, sets, rules, changes, usable, (540, 720), 1200, 3.5).collect()
    labels = {(r.t, r.k, r.origin, r.dest): r.fastest for r in got if r.p == 1}
    assert labels[0, 1, 1, 4] == 30  # 3 is not in the smaller set, so the rule about it bars nothing there
    assert labels[1, 1, 1, 4] == 30 and (1, 1, 1, 5) not in labels  # the better cell of the smaller set; 5 only by the barred train
    assert labels[1, 0, 2, 5] == 20
