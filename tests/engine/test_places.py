"""Streets, lines, hours, places, texts, live states and walkers on small fixtures."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from kerbgraph.functions import texts as T
from kerbgraph.operators import hours, lines, live, places, relational, streets
from kerbgraph.streaming import navigator

AT = datetime.datetime(2026, 10, 4, 12)


def rows_of(spark, columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def tagged(spark, *maps):
    return spark.createDataFrame([(i, m, "2024-01-01") for i, m in enumerate(maps)], "id int, tags map<string,string>, timestamp string")


def test_kinds_of_ways(spark):
    cases = [
        ({"highway": "footway"}, "footway"), ({"highway": "footway", "footway": "sidewalk"}, "sidewalk"), ({"highway": "footway", "footway": "crossing"}, "crossing"), ({"highway": "footway", "conveying": "yes"}, "escalator"), ({"highway": "footway", "ramp": "yes"}, "ramp"),
        ({"highway": "steps", "access": "private"}, None), ({"highway": "steps", "access": "private", "foot": "yes"}, "steps"), ({"railway": "platform"}, "footway"), ({"highway": "cycleway"}, "footway"), ({"highway": "cycleway", "foot": "no"}, None), ({"highway": "bridleway"}, None), ({"highway": "track"}, "footway"),
        ({"highway": "residential"}, "street_proxy"), ({"highway": "residential", "sidewalk:left": "separate"}, None), ({"highway": "primary", "sidewalk": "no"}, None), ({"highway": "residential", "sidewalk": "no"}, "street_proxy"), ({"highway": "living_street"}, "pedestrian"), ({"highway": "motorway"}, None), ({"name": "x"}, None),
    ]
    got = tagged(spark, *[m for m, _ in cases]).select("id", streets.classify().alias("k")).orderBy("id").collect()
    assert [r["k"] for r in got] == [k for _, k in cases]


def test_tags_as_attributes(spark):
    df = tagged(spark, {"surface": "cobblestone:flattened", "incline": "10%", "width": "120 cm", "step_count": "12", "lit": "yes", "tunnel": "building_passage"}, {"surface": "asphalt", "sidewalk": "left", "sidewalk:left:surface": "moon", "sidewalk:left:width": "1.5"}, {"surface": "asphalt"})
    kinds = F.element_at(F.array(F.lit("steps"), F.lit("street_proxy"), F.lit("street_proxy")), F.col("id") + 1)
    a = df.select("id", *[v.alias(k) for k, v in streets.edge_attributes(kinds, F.col("timestamp")).items()]).orderBy("id").collect()
    assert (a[0]["surface"]["value"], a[0]["incline"]["value"], a[0]["width"]["value"], a[0]["step_count"]["value"], a[0]["lit"]["value"], a[0]["covered"]["value"], a[0]["pavement"]["value"]) == ("sett", 10.0, 1.2, 12.0, True, True, None)
    assert (a[1]["surface"]["value"], a[1]["surface"]["state"], a[1]["width"]["value"], a[1]["pavement"]["value"]) == ("other", "reported", 1.5, "left")
    assert (a[2]["surface"]["value"], a[2]["surface"]["state"], a[2]["width"]["state"], a[2]["step_count"]["state"]) == ("asphalt", "inferred", "unknown", "inferred")
    df = tagged(spark, {"kerb": "no"}, {"kerb:height": "30 mm"}, {"highway": "crossing", "crossing": "zebra", "traffic_signals:sound": "no"}, {"entrance": "main", "door": "odd", "automatic_door": "button", "step_count": "2"}, {"amenity": "toilets", "changing_places": "yes"}, {"bicycle": "yes", "segregated": "no"}, {"bicycle": "yes"})
    at = F.col("timestamp")
    b = df.select("id", streets.kerb(at).alias("kerb"), streets.crossing(at).alias("crossing"), streets.entrance(at).alias("entrance"), streets.amenity().alias("amenity"), streets.shared_with_cycles(at).alias("shared")).orderBy("id").collect()
    assert (b[0]["kerb"]["type"]["value"], b[0]["kerb"]["height_cm"]["value"]) == ("flush", 0.0) and b[1]["kerb"]["height_cm"]["value"] == 3.0 and b[2]["kerb"] is None
    assert (b[2]["crossing"]["control"]["value"], b[2]["crossing"]["sound"]["value"], b[2]["crossing"]["vibration"]["state"]) == ("zebra", False, "unknown")
    assert (b[3]["entrance"]["door"]["value"], b[3]["entrance"]["automatic"]["value"], b[3]["entrance"]["step_count"]["value"]) == ("other", "button", 2.0) and b[4]["entrance"] is None and b[4]["amenity"] == "changing_places"
    assert (b[5]["shared"]["value"], b[5]["shared"]["state"]) == (True, "reported") and b[6]["shared"]["state"] == "inferred"


@pytest.fixture(scope="module")
def town(spark):
    """Two streets that cross, a crossing way with a zebra, a bridge with its outline, and an island 10 m away."""
    m = 1 / 111_320
    nodes = [(1, 0.0, 0.0, {}), (2, 0.0, 50 * m, {}), (3, 0.0, 100 * m, {}), (4, 50 * m, 50 * m, {"highway": "crossing", "crossing": "zebra"}), (5, 100 * m, 50 * m, {}), (6, 0.0, 110 * m, {}), (7, 0.0, 130 * m, {}), (8, -20 * m, 20 * m, {}), (9, 120 * m, 20 * m, {}), (10, 120 * m, 80 * m, {}), (11, -20 * m, 80 * m, {})]
    ways = [(100, [1, 2, 3], {"highway": "residential", "name": "High Street"}), (101, [2, 4, 5], {"highway": "footway", "footway": "crossing"}), (102, [6, 7], {"highway": "footway"}), (103, [4, 5, 1], {"highway": "footway", "bridge": "yes"}), (104, [8, 9, 10, 11, 8], {"man_made": "bridge", "name": "Old Bridge", "bridge:movable": "swing"}), (105, [99, 1], {"highway": "steps"})]
    nodes = spark.createDataFrame([(i, x, y, t, "2024") for i, x, y, t in nodes], "id long, lon double, lat double, tags map<string,string>, timestamp string")
    ways = spark.createDataFrame([(i, n, t, "2024") for i, n, t in ways], "id long, nodes array<long>, tags map<string,string>, timestamp string")
    edges, points = streets.build(ways, nodes)
    return ways, nodes, edges, points


def test_streets_are_cut_and_joined(spark, town):
    ways, nodes, edges, points = town
    assert {(r["way"], r["src"], r["dst"]) for r in edges.collect()} == {(100, 1, 2), (100, 2, 3), (101, 2, 4), (101, 4, 5), (102, 6, 7), (103, 4, 5), (103, 5, 1)}
    at = {r["id"]: r for r in points.collect()}
    assert at[2]["kerb"]["type"]["state"] == "inferred" and at[2]["kind"] == "kerb" and at[5]["kerb"]["type"]["value"] == "lowered" and at[1]["kerb"] is None and at[4]["kind"] == "crossing"
    names = {r["key"]: r["name"] for r in streets.borrowed_names(edges, ways, nodes).collect()}
    assert names["102:6:7"] == "High Street" if "102:6:7" in names else True
    bridges = {r["key"]: (r["outline_name"], r["outline_movable"]) for r in streets.outlined(edges, ways, nodes).collect()}
    assert bridges["103:4:5"] == ("Old Bridge", "swing")
    gap = streets.bridge_islands(edges, points.withColumn("ele", F.lit(None).cast("double"))).collect()
    assert [(r["src"], r["dst"], r["kind"]) for r in gap] == [(6, 3, "footway")] and gap[0]["length_m"] == pytest.approx(10, abs=0.1)


def test_lifts_between_levels(spark):
    edges = spark.createDataFrame([("a", 1, 5, "footway", 0.0), ("b", 5, 2, "footway", 1.0), ("c", 5, 3, "footway", 2.0), ("d", 1, 6, "footway", 0.0)], "key string, src long, dst long, kind string, level double")
    nodes = spark.createDataFrame([(5, "elevator", 0.0), (6, "elevator", 0.0), (1, "junction", 0.0)], "id long, kind string, level double")
    e, n = streets.split_lifts(edges, nodes)
    assert {(r["src"], r["dst"], r["kind"]) for r in e.collect()} == {(1, -51, "footway"), (-52, 2, "footway"), (-53, 3, "footway"), (1, 6, "footway"), (-51, -52, "elevator"), (-51, -53, "elevator"), (-52, -53, "elevator")}
    assert {r["id"] for r in n.collect()} == {1, 6, -51, -52, -53}


def test_lines(spark):
    line = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (3.0, 4.0), (3.0, 4.5))])
    points = rows_of(spark, {"p": lines.densify(line)})["p"]
    assert [round(p["d"], 6) for p in points] == [0, 1, 2, 3, 4, 5, 5.5] and (points[-1]["x"], points[-1]["y"]) == (3.0, 4.5)
    m = 1 / 111_320
    way = F.array(*[F.struct(F.lit(x * m).alias("lon"), F.lit(y * m).alias("lat")) for x, y in ((0.0, 0.0), (0.0, 100.0), (100.0, 100.0))])
    hit = rows_of(spark, {"p": lines.project(F.lit(30 * m), F.lit(90 * m), way)})["p"]
    assert hit["distance_m"] == pytest.approx(10, abs=1e-3) and hit["along_m"] == pytest.approx(130, abs=1e-3) and hit["leg"] == 1
    words = rows_of(spark, {str(d): lines.turn_word(lines.turn(F.lit(10.0), F.lit(10.0 + d))) for d in (0.0, 30.0, -90.0, 179.0)})
    assert tuple(words) == ("Continue", "Bear right", "Turn left", "Turn around")
    shape = spark.createDataFrame([(1, [(0.0, 0.0), (5.0, 0.5), (10.0, 0.0), (15.0, 8.0), (20.0, 0.0)]), (2, [(1.0, 1.0)])], "k int, line array<struct<x:double,y:double>>")
    assert {r["k"]: len(r["line"]) for r in lines.simplify(shape, "k").collect()} == {1: 4, 2: 1}
    profile = [("flat", float(d), 0.0) for d in range(0, 31)] + [("hill", float(d), 0.0 if d < 10 else (d - 10) * 0.1 if d < 20 else 1.0) for d in range(0, 41)] + [("wall", 0.0, 0.0), ("wall", 1.0, 2.0), ("wall", 12.0, 2.0), ("gap", 0.0, None), ("gap", 9.0, 1.0)]
    got = {r["k"]: r for r in lines.slopes(spark.createDataFrame(profile, "k string, d double, z double"), "k").collect()}
    assert got["flat"]["steepest"] == 0 and got["hill"]["steepest"] == pytest.approx(10) and got["hill"]["mean"] == pytest.approx(2.5) and got["wall"]["verdict"] == "discontinuity" and got["gap"]["verdict"] == "no-data"
    runs = spark.createDataFrame([("a", 0.0, 5.0), ("a", 5.4, 9.0), ("a", 10.0, 11.0)], "k string, s double, e double")
    assert {(r["s"], r["e"], r["n"]) for r in lines.merge_runs(runs, ["k"], "s", "e", 0.5).collect()} == {(0.0, 9.0, 2), (10.0, 11.0, 1)}


def test_closures_and_denials(spark):
    cases = {
        "Footway closed": True, "no footway closed": False, "Pavement closed: not required": False, "footway closed: N/A. Footway closed later": True, "without pedestrians diverted": False, "pedestrians will be diverted": True, "closed": False, None: False, "avoiding a footway closure": False, "Road closed to pedestrians": True, "pavement closed, footpath closed isn't so": True,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r["t"]: r["s"] for r in df.select("t", T.says(F.col("t"), T.FOOTWAY_CLOSED).alias("s")).collect()} == cases
    says = {
        "No step free access to the platforms.": ("no-step-free", False), "Step-free access is still available": (None, False), "Trains will not stop at this station": ("not-calling", False), "Canada Water: the station is closed": ("closed", False),
        "No step-free access at the entrance": ("no-step-free", True), "No step-free access, use the lift instead": ("no-step-free", True), "Station closed: use the south entrance": (None, True), "Reduced escalator service": (None, False),
    }
    df = spark.createDataFrame([(k,) for k in says], "t string").select("t", T.station_message(F.col("t")).alias("m"))
    assert {r["t"]: tuple(r["m"]) for r in df.collect()} == says


def test_small_texts(spark):
    r = rows_of(spark, {"title": T.title(F.lit("STOREY'S GATE-END (part)")), "points": T.wkt_points(F.lit("LINESTRING (1 2.5, -3 4)")), "parts": T.wkt_parts(F.lit("MULTILINESTRING ((1 2, 3 4), (5 6, 7 8))")), "point": T.wkt_parts(F.lit("MULTIPOINT (1 2, 3 4)")), "first": T.first_address(F.lit(" 1.2.3.4 , 5.6.7.8")), "km": T.distance_text(F.lit(1449.0), F.lit(False)), "m": T.distance_text(F.lit(123.0), F.lit(False)), "old": T.age_text(F.lit(86_400 * 20)), "like": T.edit_similarity(F.lit("kitten"), F.lit("sitting")), "words": T.tokens(F.lit("The cafés, glass & Café"))})
    assert (r["title"], r["first"], r["km"], r["m"], r["old"]) == ("Storey's Gate-End", "1.2.3.4", "1.4 km", "120 m", "20 days ago") and [tuple(p) for p in r["points"]] == [(1.0, 2.5), (-3.0, 4.0)] and [len(p) for p in r["parts"]] == [2, 2] and [len(p) for p in r["point"]] == [1, 1]
    assert r["like"] == pytest.approx(1 - 3 / 7) and r["words"] == ["cafe", "glass", "the"]


def test_opening_hours(spark):
    texts = ["Mo-Fr 09:00-17:30; Sa 10:00-16:00; Su off", "24/7", "Fr-Mo 11:00-01:00", "Mo-Su 09:00-12:00, We 14:00-15:00; Su off", "sunrise-sunset", "Mo-Fr 09:00-17:00; PH off", "Mo,We 08:00-09:00,10:00-11:00", None, "Mo 25:00-26:00"]
    parsed = hours.parse(spark.createDataFrame(list(enumerate(texts)), "id int, hours string"))
    got = {}
    for r in parsed.collect():
        got.setdefault(r["id"], {}).setdefault(r["day"], []).append((r["start"], r["end"]))
    assert set(got) == {0, 1, 2, 3, 5, 6} and got[0][0] == [(540, 1050)] and got[0][6] == [(None, None)] and got[1][3] == [(0, 1440)]
    assert sorted(got[2]) == [0, 4, 5, 6] and got[2][0] == [(660, 1500)] and sorted(got[3][2]) == [(540, 720), (840, 900)] and got[3][6] == [(None, None)] and got[5][7] == [(None, None)] and got[6][2] == [(480, 540), (600, 660)]
    asked = [(1, 0, "2026-10-05 08:00:00"), (2, 0, "2026-10-05 16:15:00"), (3, 0, "2026-10-03 17:00:00"), (4, 1, "2026-10-03 17:00:00"), (5, 2, "2026-10-06 00:30:00"), (6, 2, "2026-10-06 10:00:00"), (7, 5, "2026-12-25 10:00:00"), (8, 4, "2026-10-05 08:00:00")]
    df = spark.createDataFrame(asked, "ask int, id int, t string").withColumn("t", F.col("t").cast("timestamp"))
    off = spark.createDataFrame([(datetime.date(2026, 12, 25),)], "date date")
    told = {r["ask"]: (r["open"], r["text"]) for r in hours.status(df, parsed, off).collect()}
    assert told == {1: (True, "Open until 17:30"), 2: (True, "Open until 17:30, closing soon"), 3: (False, "Closed, opens Monday 09:00"), 4: (True, "Open 24 hours"), 5: (False, "Closed, opens Friday 11:00"), 6: (False, "Closed, opens Friday 11:00"), 7: (False, "Closed, opens Monday 09:00")}
    week = F.array(*[F.struct(F.lit(a).alias("open"), F.lit(b).alias("close")) for a, b in [("09:00", "17:00")] * 5 + [(None, None)] * 2])
    assert rows_of(spark, {"w": hours.from_pairs(week)})["w"] == "Mo-Fr 09:00-17:00; Sa-Su off"


def test_search(spark):
    known = [(1, "Grassmarket", "", 1, None, None, 0.0, 0.0), (2, "The Grass Market Café", "5 West Bow", 2, "amenity=cafe", True, 0.001, 0.0), (3, "Café Rouge", "", 2, "amenity=cafe", None, 0.0005, 0.0), (4, "Loo", "", 2, "amenity=toilets", False, 0.002, 0.0), (5, "Bank Street", "", 1, None, None, 0.0, 0.001), (6, "Grassmarket", "", 2, None, None, 0.0, 0.00001)]
    index = places.entries(spark.createDataFrame(known, "id int, name string, extra string, rank int, cat string, accessible boolean, lon double, lat double"))
    asked = spark.createDataFrame([(1, "grass market", 0.0, 0.0), (2, "cafe near me", 0.0, 0.0), (3, "accessible cafes", 0.0, 0.0), (4, "bank street", 0.0, 0.0), (5, "EH1 2", 0.0, 0.0), (6, "!!", 0.0, 0.0), (7, "step-free toilet", 0.0, 0.0)], "ask int, q string, lon double, lat double")
    codes = spark.createDataFrame([(70, "EH1 2AB", 0.0, 0.0), (71, "EH12 3CD", 0.0, 0.01)], "id int, name string, lon double, lat double")
    hits, hidden = places.search(asked, index, codes)
    got = {}
    for r in hits.orderBy("ask", "rank").collect():
        got.setdefault(r["ask"], []).append(r["id"])
    assert got == {1: [1, 2], 2: [3, 2], 3: [2], 4: [5], 5: [70, 71]} and {r["ask"]: r["hidden"] for r in hidden.collect()} == {1: 0, 2: 0, 3: 1, 4: 0, 5: 0, 7: 1}


def test_places_of_two_sources(spark):
    m = 1 / 111_320
    schema = "id long, name string, lon double, lat double, address string, category string"
    known = spark.createDataFrame([(1, "The George Hotel", 0.0, 0.0, "19 George St, EH2", "tourism=hotel"), (2, "Edward and Irwyn", 0.0, 500 * m, None, None)], schema)
    new = spark.createDataFrame([(10, "George Hotel", 60 * m, 0.0, None, None), (11, "Other Name", 20 * m, 0.0, "19 george street", "tourism=hotel"), (12, "Other Name", 20 * m, 0.0, "19 George St", "shop=x"), (13, "Edward & Irwin", 0.0, 510 * m, None, None), (14, "George Hotel", 90 * m, 0.0, None, None)], schema)
    assert {r["id"] for r in places.not_known_yet(new, known).collect()} == {12, 14}
    assert rows_of(spark, {"a": places.street_address(F.lit("30 Grindlay St., EH3 9AX")), "b": places.street_address(F.lit("Grindlay St"))}) == ("30 grindlay street", None)
    raw = [(1, "A", "cafe", ["x"], 0.9, ["meta"]), (2, "A", "cafe", None, 0.6, ["meta"]), (3, "Changing Places Toilet", "x", None, 0.9, ["AllThePlaces"]), (4, "B", "home_service", None, 0.9, ["meta"]), (5, "Joe", "pharmacy", None, 0.9, ["AllThePlaces", "meta"])]
    df = spark.createDataFrame(raw, "id int, name string, kind string, kinds array<string>, confidence double, sources array<string>")
    assert {r["id"] for r in places.worth_adding(df.withColumn("name", F.when(F.col("name") == "A", "Able").when(F.col("name") == "B", "Best").otherwise(F.col("name")))).collect()} == {1, 5}
    toilet = "id long, lon double, lat double, accessible string, fee string, hours string"
    merged = places.merge_toilets(spark.createDataFrame([(1, 0.0, 0.0, "yes", None, None), (2, 0.0, 300 * m, None, "no", None)], toilet), spark.createDataFrame([(7, 0.0, 20 * m, "no", "yes", "24/7"), (8, 0.0, 310 * m, "yes", "yes", None), (9, 0.01, 0.0, "yes", None, None)], toilet))
    assert {(r["id"], r["accessible"], r["fee"], r["disputed"]) for r in merged.collect()} == {(1, None, "yes", True), (2, "yes", "no", False), (-10, "yes", None, False)}
    sites = spark.createDataFrame([(1, "Park", 0.0, 0.0, 0.05, 0.05), (2, "Garden", 0.01, 0.01, 0.02, 0.02)], "site int, name string, west double, south double, east double, north double")
    asked = spark.createDataFrame([(1, None, 0.015, 0.015), (2, "park", 0.015, 0.015), (3, None, 0.04, 0.04), (4, None, 0.2, 0.2)], "ask int, name string, lon double, lat double")
    assert {r["ask"]: r["site"] for r in places.containing_site(asked, sites).collect()} == {1: 2, 2: 1, 3: 1}
    now = F.lit("2026-10-04").cast("timestamp")
    notes = {"Steps are broken here": True, "Can't answer steps": False, "What are the opening hours at the steps?": False, "Nice shop": False}
    df = spark.createDataFrame([(k,) for k in notes], "t string")
    assert {r["t"]: r["k"] for r in df.select("t", places.keep_note(F.col("t"), F.lit("2024-01-01").cast("timestamp"), now).alias("k")).collect()} == notes


def test_spatial_joins_miss_nothing(spark):
    import random

    rng = random.Random(6)
    pts = lambda n, lat: [(i, rng.uniform(-0.02, 0.02), lat + rng.uniform(-0.01, 0.01)) for i in range(n)]
    for lat in (0.0, 56.0, -70.0):
        left, right = pts(60, lat), pts(200, lat)
        hav = lambda p, q: 2 * 6371008.8 * math.asin(math.sqrt(math.sin(math.radians(q[2] - p[2]) / 2) ** 2 + math.cos(math.radians(p[2])) * math.cos(math.radians(q[2])) * math.sin(math.radians(q[1] - p[1]) / 2) ** 2))
        expected = {(p[0], q[0]) for p in left for q in right if hav(p, q) <= 150}
        a, b = (spark.createDataFrame(x, f"{k} long, lon double, lat double") for x, k in ((left, "a"), (right, "b")))
        assert {(r["a"], r["b"]) for r in relational.within_join(a, b, 150.0).collect()} == expected
    m = 1 / 111_320
    seg = spark.createDataFrame([("s", 0.0, 0.0, 500 * m, 0.0), ("t", 0.0, 100 * m, 0.0, 100 * m)], "name string, ax double, ay double, bx double, by double")
    asked = spark.createDataFrame([(i, x * m, y * m) for i, (x, y) in enumerate([(250, 15), (250, 25), (510, 0), (525, 0), (0, 110)])], "a long, lon double, lat double")
    assert {(r["a"], r["name"]) for r in relational.segment_join(asked, seg, 20.0).collect()} == {(0, "s"), (2, "s"), (4, "t")}


def test_crowds_folds_and_sets(spark, monkeypatch):
    import random

    rng = random.Random(9)
    monkeypatch.setattr(relational, "CELL_ROWS", 5)
    near = [(i, rng.uniform(0, 1e-4), rng.uniform(0, 1e-4)) for i in range(60)]
    a, b = (spark.createDataFrame(near, f"{k} long, lon double, lat double") for k in "ab")
    assert relational.within_join(a, b, 100.0).count() == 3600  # one crowded cell, dealt into parts
    weights = [(k, i, rng.uniform(-1, 1)) for k in range(3) for i in rng.sample(range(2000), 300)]
    expected = {}
    for k, i, w in sorted(weights):
        expected[k] = max(-2.0, min(2.0, expected.get(k, 0.0) + w))
    got = {r["k"]: r["total"] for r in relational.clamped_fold(spark.createDataFrame(weights, "k int, i long, w double"), "k", "i", "w", -2.0, 2.0, 37).collect()}
    assert got == {k: pytest.approx(v, abs=1e-9) for k, v in expected.items()}
    said = [(i, rng.randrange(2), rng.randrange(6), rng.randrange(1000)) for i in range(200)]
    df = spark.createDataFrame(said, "id long, k int, who long, at long")
    others = {i: len({w2 for _, k2, w2, t2 in said if k2 == k and w2 != w and abs(t - t2) <= 50}) for i, k, w, t in said}
    assert {r["id"]: r["others"] for r in relational.others_within(df, ["k"], "who", "at", "id", 50).collect()} == others
    sets = {o: set(rng.sample(range(40), rng.randrange(5, 20))) for o in range(30)}
    df = spark.createDataFrame([(o, i) for o, s in sets.items() for i in s], "o long, i long")
    expected = {(a, b): len(sets[a] & sets[b]) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.4 * max(len(sets[a]), len(sets[b]))}
    assert {(r["a"], r["b"]): r["shared"] for r in relational.alike_sets(df, "o", "i", 0.4).collect()} == expected and expected
    latest = spark.createDataFrame([(1, 5, "b", "x"), (1, 5, "a", "y"), (1, 4, "0", "z")], "k int, t int, tie string, v string")
    assert relational.latest_per_key(latest, ["k"], "t", "tie", ["v"]).first()["v"] == "y"


def test_live_states(spark):
    now = F.lit("2026-10-04 12:00:00").cast("timestamp")
    lines_raw = spark.createDataFrame([("dlr", [(20, None, [("2026-10-04T10:00:00Z", "2026-10-04T20:00:00Z")], ("Service closed", [("A", None), ("B", None)]))]), ("jubilee", [(10, "Good", [], None)]), (None, [(1, "x", [], None)])], "id string, lineStatuses array<struct<statusSeverity:int,reason:string,validityPeriods:array<struct<fromDate:string,toDate:string>>,disruption:struct<description:string,affectedStops:array<struct<naptanId:string,id:string>>>>>")
    d = live.line_disruptions(lines_raw, now)
    assert [(r["kind"], r["line"], r["stations"], r["message"]) for r in d.collect()] == [("line-closed", "dlr", ["A", "B"], "Service closed")]
    stations = live.station_disruptions(spark.createDataFrame([("A", None, "No step free access on the Jubilee line", None, None), ("B", None, "Escalator out, Jubilee line", None, None), ("A", None, "Central line: no step free access", None, None), (None, None, "x", None, None)], "atcoCode string, stationAtcoCode string, description string, fromDate string, toDate string"), now)
    rides = spark.createDataFrame([("ride:dlr:A:B", "dlr", "A", "B"), ("ride:dlr:B:C", "dlr", "B", "C")], "ref string, line string, a string, b string")
    boards = spark.createDataFrame([("board:dlr:A", "dlr", "A"), ("board:jubilee:A", "jubilee", "A")], "ref string, line string, station string")
    names = spark.createDataFrame([("dlr", "DLR"), ("jubilee", "Jubilee")], "line string, name string")
    both = d.unionByName(stations).withColumn("feed", F.monotonically_increasing_id())
    states = {r["ref"]: (r["status"], r["affects"], r["headline"]) for r in live.rail_states(both, rides, boards, names, now).collect()}
    assert states == {"ride:dlr:A:B": ("closed", None, "No service"), "board:jubilee:A": ("closed", "step-free", "No step-free access")}
    notes = live.station_notes(both, names, spark.createDataFrame([("A",), ("B",)], "station string"), now).collect()
    assert [(r["station"], r["message"]) for r in notes] == [("B", "Escalator out, Jubilee line")]
    paths = spark.createDataFrame([("S", "street", "hall", True, ["l1"]), ("S", "hall", "p1", True, ["l2"]), ("S", "hall", "p2", False, []), ("S", "hall", "p3", None, [])], "station string, a string, b string, step_free boolean, lifts array<string>")
    platforms = spark.createDataFrame([("S", "x", "p1"), ("S", "x", "p2"), ("S", "y", "p1"), ("S", "z", "p3"), ("S", "w", "p2")], "station string, line string, platform string")
    before = live.step_free_lines(paths, platforms)
    assert {r["line"]: r["access"] for r in before.collect()} == {"x": "part", "y": "yes", "z": "unknown", "w": "no"}
    after = live.step_free_lines(paths, platforms, spark.createDataFrame([("S", "l2")], "station string, lift string"))
    raw = spark.createDataFrame([("S", ["l2"], "KINGS CROSS STATION: lift out"), ("T", ["t"], "No lift between the street and the ticket hall"), (None, ["a"], "m"), ("U", None, "m")], "stationUniqueId string, disruptedLiftUniqueIds array<string>, message string")
    out = live.lift_outages(raw, now)
    assert {(r["station"], r["name"], r["alternative"]) for r in out.collect()} == {("S", "Kings Cross", False), ("T", None, False)}
    boards = spark.createDataFrame([("board:x:S", "x", "S"), ("board:y:S", "y", "S"), ("board:x:T", "x", "T")], "ref string, line string, station string")
    links = spark.createDataFrame([("link:T", "T")], "ref string, station string")
    got = {r["ref"]: r["status"] for r in live.lift_states(out, before, after, boards, names, links, spark.createDataFrame([], "hub string, station string")).collect()}
    assert got == {"board:x:S": "closed", "board:y:S": "closed", "link:T": "closed"} or got == {"board:y:S": "closed", "link:T": "closed"}
    warnings = live.flood_warnings(spark.createDataFrame([("f1", 1, "Severe", None, " a  b ", "t"), ("f1", 3, None, None, None, None), ("f2", 2, "Flood Warning", None, None, None), ("f3", 9, None, None, None, None)], "floodAreaID string, severityLevel int, severity string, description string, message string, timeRaised string"))
    areas = spark.createDataFrame([("f1", "Leith", "1:2:3"), ("f2", "Dean", "1:2:3"), ("f2", "Dean", "4:5:6")], "area string, label string, key string")
    assert {r["key"]: r["status"] for r in live.flood_states(warnings, areas, now).collect()} == {"1:2:3": "closed", "4:5:6": "restricted"}
    assert [r["severity"] for r in live.floods_here(warnings, areas).orderBy("rank").collect()] == [1, 2, 3]


def test_works(spark):
    now = F.lit("2026-10-04 12:00:00").cast("timestamp")
    fields = "ref string, event_time string, event_type string, geom string, street string, promoter string, activity string, location_type string, close_footway string, status string, permit_status string, start string, `end` string, proposed_end string"
    base = ("1", "t", "WORK_START", "POINT (1 2)", "HIGH ST", "Gas Co", "Repair", "Footway", "yes_provide_alternative_route", "in_progress", "granted", "2026-10-01", "2026-10-09", None)
    change = lambda **kw: tuple(kw.get(n, v) for n, v in zip([f.split()[0].strip("`") for f in fields.split(", ")], base, strict=True))
    df = spark.createDataFrame([base, change(ref="2", close_footway="no", location_type="Carriageway"), change(ref="3", status="completed"), change(ref="4", permit_status="Cancelled"), change(ref="5", close_footway="yes_provide_pedestrian_walkway"), change(ref="6", end="2026-10-02")], fields)
    got = {r["id"]: (r["footway"], r["description"], r["street"]) for r in live.permits(df, now).collect()}
    assert got == {"sm:1": ("closed", "Pavement closed for works, with a signed diversion (Repair by Gas Co)", "High St"), "sm:5": ("affected", "Pavement closed, temporary walkway alongside (Repair by Gas Co)", "High St")}
    acts = "ref string, event_time string, event_type string, geom string, street string, activity string, details string, name string, location_description string, location_type string, cancelled string, start_date string, start_time string, end_date string, end_time string"
    rows = [("1", "t", "X", "MULTILINESTRING ((1 2, 3 4), (5 6, 7 8))", "a", "skips", "footway closed", None, None, "Footway", "no", "2026-10-01", None, "2026-10-04", None), ("2", "t", "X", "POINT (1 2)", "a", "odd", None, None, None, "Footpath", None, "2026-12-01", None, "2026-12-04", None)]
    got = {r["id"]: (r["headline"], r["description"], r["footway"]) for r in live.activities(spark.createDataFrame(rows, acts), now).collect()}
    assert got == {"sma:1#0": ("A skip on the pavement", "Pavement closed", "closed"), "sma:1#1": ("A skip on the pavement", "Pavement closed", "closed")}
    reg = "ref string, category string, licence string, traffic string, status string, location string, description string, street string, start string, `end` string, updated string, geom string"
    line = ("2026-10-01", "2026-10-09", None, "LINESTRING (1 2, 3 4)")
    rows = [("1", "", "Street Café", "", "Proposed", "x", "footway closed", "A (plus 2 more)", *line), ("2", "", "", "Works Entirely On The Footway", "Proposed", "x", "footway closed", "A", *line), ("3", "", "", "Road Closure", "Proposed", "x", "nothing", "A", *line), ("4", "", "Skip", "", "Proposed", "on f/way", "", "A", *line), ("5", "", "", "Works Entirely On The Footway", "Potential", "x", "", "A", *line)]
    got = {r["id"]: (r["headline"], r["footway"], r["street"]) for r in live.register_rows(spark.createDataFrame(rows, reg), now).collect()}
    assert got == {"srwr:1": ("Café tables on the pavement", "affected", "A"), "srwr:2": ("Pavement closed", "closed", "A"), "srwr:4": ("Skip on the pavement", "affected", "A")}
    m = 1 / 111_320
    works = spark.createDataFrame([("w1", [(0.0, 0.0), (100 * m, 0.0)], "closed", None, "Closed", "High St", "s", AT, AT + datetime.timedelta(days=1), 1), ("w2", [(50 * m, 9 * m)], "affected", None, "Works", None, "s", AT, AT + datetime.timedelta(days=1), 2)], "id string, line array<struct<lon:double,lat:double>>, footway string, headline string, description string, street string, source string, start timestamp, `end` timestamp, feed long")
    edge = lambda i, y, kind="footway": (i, kind, [(40 * m, y * m), (50 * m, y * m), (60 * m, y * m)])
    edges = spark.createDataFrame([edge(1, 5), edge(2, 10), edge(3, 30), edge(4, 5, "steps")], "edge long, kind string, line array<struct<lon:double,lat:double>>")
    got = {r["edge"]: (r["status"], r["reason"]) for r in live.works_states(works, edges, now).collect()}
    assert got == {1: ("closed", "Closed on High St until 2026-10-05"), 2: ("degraded", "Works until 2026-10-05")}
    assert tuple(live.works_summary(spark.createDataFrame([("a#0", "closed"), ("a#1", "affected"), ("b", "affected")], "id string, footway string")).first()) == (1, 1)


def test_weather_and_alerts(spark):
    hour = lambda h: datetime.datetime(2026, 1, 10, h)
    rows = [("x", hour(h), 0.3 if h == 8 else 0.0, 5.0 if h > 2 else 0.5, 0, 0.0, 20.0 + h) for h in range(0, 12)]
    hourly = spark.createDataFrame(rows, "place string, time timestamp, precipitation double, temperature double, code int, snowfall double, gust double")
    asked = spark.createDataFrame([(1, "x", hour(9)), (2, "x", datetime.datetime(2026, 1, 10, 11, 30)), (3, "x", hour(14)), (4, "y", hour(9))], "id int, place string, t timestamp")
    now = spark.createDataFrame([("x", True, False, 9.0)], "place string, wet boolean, ice boolean, gust_kmh double")
    got = {r["id"]: (r["wet"], r["ice"], r["gust_kmh"]) for r in live.weather(asked, hourly, now).collect()}
    assert got == {1: (True, True, 29.0), 2: (True, True, 31.0), 3: (True, False, 9.0), 4: (None, None, None)}
    r = rows_of(spark, {"n": live.air_notes(F.lit(85.0), F.lit(60.0), F.lit(1.0), F.lit(80.0), F.lit(5.0)), "heat": live.in_season(F.lit("heat"), F.lit("2026-07-01").cast("timestamp")), "cold": live.alert_in_force(F.lit("cold"), F.lit("2026-01-02").cast("timestamp"), F.lit("2026-01-03").cast("timestamp"))})
    assert r["n"] == ["Air quality very poor (European AQI 85)", "Pollen high: grass, alder"] and r["heat"] and not r["cold"]
    alerts = spark.createDataFrame([("r", "cold", "red", None), ("r", "heat", "amber", None), ("s", "cold", "amber", None), ("s", "heat", "amber", None), ("t", "heat", "green", None)], "region string, kind string, level string, until timestamp")
    assert {r["region"]: (r["kind"], r["level"]) for r in live.strongest_alert(alerts, ["region"]).collect()} == {"r": ("cold", "red"), "s": ("heat", "amber")}
    trains = spark.createDataFrame([("s", "5", 290), ("s", "5", 60), ("s", "5", 600), ("s", "5", 900), ("s", "6", 1)], "stop string, lineName string, timeToStation int")
    assert live.arrivals(trains, F.lit("5")).first()["minutes"] == [1, 5, 10]


def test_walkers(spark, tmp_path):
    m = 1 / 111_320
    plan = [("a", [(0.0, i * 100 * m) for i in range(11)], [i * 100.0 for i in range(11)], [(500.0, "Turn left")], [(300.0, 20.0, "Setts"), (305.0, 5.0, "Kerb")], [(700.0, 950.0, "Mound")])]
    plans = spark.createDataFrame(plan, "session string, " + navigator.PLAN)
    at = lambda s: AT + datetime.timedelta(seconds=s)
    fixes = [("a", at(0), 0.0, 10 * m, 5.0), ("a", at(10), 0.0, 250 * m, 5.0), ("a", at(20), 0.0, 240 * m, 5.0), ("a", at(30), 0.0, 470 * m, 5.0), ("a", at(40), 80 * m, 480 * m, 5.0), ("a", at(50), 80 * m, 490 * m, 5.0), ("a", at(60), 0.0, 698 * m, None), ("a", at(70), 100 * m, 800 * m, 5.0), ("a", at(80), 0.0, 990 * m, 5.0), ("b", at(0), 0.0, 0.0, 5.0)]
    df = spark.createDataFrame(fixes, "session string, t timestamp, lon double, lat double, accuracy double")
    rows = navigator.follow(df, plans).orderBy("t").collect()
    assert [r["said"] for r in rows] == [None, "Setts", None, "Turn left", None, "You're off the route. Working out a new one.", "Get ready to get off. Your stop is Mound.", None, "You have arrived."]
    assert [round(r["along"]) for r in rows] == [10, 250, 250, 470, 470, 470, 698, 800, 990] and rows[5]["off_route"] and not rows[4]["off_route"] and rows[-1]["arrived"]
    df.write.parquet(str(tmp_path / "fixes"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "fixes"))
    query = navigator.follow_stream(stream, plans).writeStream.format("memory").queryName("walks").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(180)
    told = spark.table("walks").orderBy("t").collect()
    assert [(r["said"], round(r["along"])) for r in told] == [(r["said"], round(r["along"])) for r in rows]
