import datetime
import math
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from kerbgraph.functions import columns as C
from kerbgraph.operators import graph, relational
from kerbgraph.plans import graph_queries
from kerbgraph.plans import queries as plans
from kerbgraph.sources import feeds
from kerbgraph.streaming import overlay


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_scalars(spark):
    assert one(spark, C.js_round(F.lit(-2.5))) == -2
    assert one(spark, C.haversine_m(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))) == pytest.approx(111195.08, abs=0.1)
    assert one(spark, C.incline_percent(F.lit("45°"))) == pytest.approx(100)
    assert one(spark, C.incline_percent(F.lit("steep"))) is None
    assert one(spark, C.metres(F.lit("120 cm"))) == pytest.approx(1.2)
    assert one(spark, C.normal_text(F.lit("L'Été  à Paris!"))) == "lete a paris"
    square = F.array(*[F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat")) for x, y in ((0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0))])
    assert one(spark, C.in_ring(F.lit(1.0), F.lit(1.0), square)) is True
    assert one(spark, C.in_ring(F.lit(3.0), F.lit(1.0), square)) is False
    noon = 1_718_971_200  # 2024-06-21 12:00 UTC, near the Tropic of Cancer on the meridian
    assert one(spark, C.sun_altitude(F.lit(noon), 0.0, 23.44)) > 88


def test_confidence_rules(spark):
    args = lambda s, age, n, m: C.confidence(F.lit(s), F.lit(age).cast("double"), F.lit(n), F.lit(m))
    assert one(spark, args("unknown", 1, 0, False)) == 0
    assert one(spark, args("reported", 0, 9, False)) == pytest.approx(0.9)
    assert one(spark, args("verified", None, 0, False)) == pytest.approx(0.76)
    assert one(spark, args("verified", 1095.75, 0, False)) == pytest.approx(0.475)
    assert one(spark, args("verified", 4383.0, 0, True)) == pytest.approx(0.475)


def test_graph(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (10, 11), (11, 12), (12, 13), (13, 10), (5, 5)], "a long, b long")
    assert {(r[0], r[1]) for r in graph.components(links).collect()} == {(1, 1), (2, 1), (3, 1), (10, 10), (11, 10), (12, 10), (13, 10), (5, 5)}
    arcs = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 5.0), ("c", "a", 1.0)], "src string, dst string, cost double")
    start = spark.createDataFrame([("a",)], "root string")
    assert {(r["node"], r["cost"]) for r in graph.cheapest(arcs, start, 5).collect()} == {("a", 0.0), ("b", 1.0), ("c", 2.0)}
    assert {(r["node"], r["hops"]) for r in graph.reach(arcs, start).collect()} == {("a", 0), ("b", 1), ("c", 1)}


def test_relational(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 5, 7), (1, 9, 10), (2, 0, 1)], "k int, s int, e int")
    assert {tuple(r) for r in relational.merge_intervals(df, "k", "s", "e").collect()} == {(1, 0, 7, 2), (1, 9, 10, 1), (2, 0, 1, 1)}
    votes = spark.createDataFrame([(1, 1, 2.0), (1, 2, 2.0), (1, 3, -1.0)], "k int, o int, w double")
    assert relational.clamped_fold(votes, "k", "o", "w", -2.0, 2.0).first()["total"] == 1.0
    empty = df.limit(0)
    assert relational.merge_intervals(empty, "k", "s", "e").count() == 0


def test_feeds(spark, tmp_path):
    (tmp_path / "m.xml").write_text('<osm><node id="1" lat="1.5" lon="2.5"><tag k="kerb" v="flush"/></node><way id="7" timestamp="2024"><nd ref="1"/><nd ref="2"/><tag k="highway" v="steps"/></way></osm>')
    way = feeds.osm_ways(spark, str(tmp_path / "m.xml")).first()
    assert way["nodes"] == [1, 2] and way["tags"] == {"highway": "steps"}
    assert feeds.osm_nodes(spark, str(tmp_path / "m.xml")).first()["tags"] == {"kerb": "flush"}
    (tmp_path / "n.xml").write_text('<osm><node id="1" lat="9" lon="2.5" timestamp="2020"/><way id="7" timestamp="2020"><nd ref="5"/></way></osm>')
    assert feeds.osm_nodes(spark, str(tmp_path / "m.xml"), str(tmp_path / "n.xml")).first()["lat"] == 9 and feeds.osm_ways(spark, str(tmp_path / "m.xml"), str(tmp_path / "n.xml")).first()["nodes"] == [5]
    (tmp_path / "a.json").write_text('[{"status":"Amber","geography_name":"London","geography_code":"E1","refresh_date":"x"},{"status":"Purple","geography_code":"E2"}]')
    assert [r["status"] for r in feeds.region_alerts(spark, str(tmp_path / "a.json")).collect()] == ["amber"]
    (tmp_path / "l.json").write_text('[{"ts_id":"a","data":[["2026-01-01T00:00:00Z",1.0],["2026-01-01T01:00:00Z",2.5],["2026-01-01T02:00:00Z",null],["soon",9.0]]}]')
    assert tuple(feeds.latest_level(spark, str(tmp_path / "l.json")).first()) == ("a", "2026-01-01T01:00:00Z", 2.5)
    (tmp_path / "lift.json").write_text('[{"stationUniqueId":"s","disruptedLiftUniqueIds":["x","y"],"message":"m"},{"message":"no station"}]')
    assert feeds.lift_outages(spark, str(tmp_path / "lift.json")).count() == 2


def test_states_expire_and_streams_run(spark, tmp_path):
    states = spark.createDataFrame([("r", "closed", "2024-01-01 10:00:00"), ("r", "open", "2024-01-01 10:05:00"), ("q", "closed", "2024-01-01 09:00:00")], "ref string, status string, observed_at string").withColumn("observed_at", F.col("observed_at").cast("timestamp"))
    now = overlay.in_force(overlay.with_expiry(states), "2024-01-01 10:10:00").collect()
    assert [(r["ref"], r["status"]) for r in now] == [("r", "open")]
    states.union(states).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(states.schema).parquet(str(tmp_path / "in"))
    query = overlay.first_seen(stream).writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("seen").count() == 3


def saved(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))


def test_normalise_text_takes_every_document(spark, tmp_path):
    def norm(text):  # the reference's rule
        text = "".join(c for c in unicodedata.normalize("NFD", text) if not "\u0300" <= c <= "\u036f").lower()
        return re.sub("[^a-z0-9]+", " ", re.sub("['’]", "", text)).strip()

    texts = ["Straße nach Gießen", "Œuvre, cœur d'Été", "Ærø æon", "plain", None, ""]
    saved(spark, tmp_path, "documents", [("x" if i % 2 else "y", text) for i, text in enumerate(texts)], "lang string, text string")
    got = {r["lang"]: (r["n"], r["chars"]) for r in plans.normalise_text(spark, str(tmp_path)).collect()}
    assert got == {k: (3, sum(len(norm(x or "")) for x in texts[at::2])) for k, at in (("y", 0), ("x", 1))}


EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
START = datetime.datetime(2024, 1, 1)


def some_events(n=400):
    rng = random.Random(3)
    return [(i, START + datetime.timedelta(minutes=rng.randrange(4000)), rng.randrange(40), rng.choice(["view", "click", "purchase", "signup", "error"]), rng.random(), '{"k": %d}' % rng.randrange(12)) for i in range(n)]


def test_asof_and_hold_take_all_keys(spark, tmp_path):
    rows = some_events()
    saved(spark, tmp_path, "events", rows, EVENTS)
    keys = [*range(0, 12000, 37)]
    saved(spark, tmp_path, "orders", [(k,) for k in keys], "o_orderkey long")
    expected = {}
    for k in keys:
        before = [(r[1], r[0]) for r in rows if r[2] == k % 150 and r[1] <= START + datetime.timedelta(days=k % 30)]
        expected[k] = max(before)[1] if before else None
    assert {r[0]: r[1] for r in plans.asof_last_reading(spark, str(tmp_path)).collect()} == expected
    held, last = {}, {}
    for i, ts, _, kind, value, props in sorted(rows, key=lambda r: (r[1], r[0])):
        if kind != "error":
            last[props] = (ts, value)
        ts0, good = last.get(props, (START - datetime.timedelta(days=1), None))
        held[i] = good if ts - ts0 <= datetime.timedelta(minutes=15) else None
    assert {r[0]: r[1] for r in plans.hold_last_good(spark, str(tmp_path)).collect()} == held


def test_replace_by_source_takes_all_current_rows(spark, tmp_path):
    kinds = [(1, 1, "error", 100), (2, 1, "click", 100), (3, 3, "click", 200), (5, 3, "click", 200), (4, 7, "view", 200)]
    saved(spark, tmp_path, "events", [(i, START, user, kind, 0.0, '{"k": %d}' % k) for i, user, kind, k in kinds], EVENTS)
    out = plans.replace_by_source(spark, str(tmp_path)).select("k", "user_id", "source", "event_id").collect()
    assert {tuple(r) for r in out} == {(100, 1, "error", 1), (200, 3, "click", 5)}


def test_supply_graph_takes_all_parts_and_hops(spark, tmp_path):
    rng = random.Random(11)
    items = [(s, s + j, 1.0) for s in range(1, 11) for j in (0, 1)]  # a chain of 10 suppliers: 19 hops and more
    items += [(1, 11, 500.0), (30, 90, 2.0), (31, 90, 3.0), (0, 91, 1.0), (32, 0, 1.0)]  # supplier 0 and part 0 are two nodes
    items += [(rng.randrange(40, 50), rng.randrange(100, 125), float(rng.randrange(1, 51))) for _ in range(150)]
    saved(spark, tmp_path, "lineitem", items, "l_suppkey long, l_partkey long, l_quantity double")
    arcs, parts = {}, {}
    for s, p, q in items:
        for a, b in ((s, -p - 1), (-p - 1, s)):
            arcs.setdefault(a, {})[b] = min(q, arcs.get(a, {}).get(b, q))
        parts.setdefault(s, set()).add(p)
    cost = {1: 0.0}
    for _ in arcs:
        for a in list(cost):
            for b, q in arcs[a].items():
                cost[b] = min(cost.get(b, math.inf), cost[a] + q)
    label = {a: a for a in arcs}
    for _ in arcs:
        label = {a: min(label[a], *(label[b] for b in arcs[a])) for a in arcs}
    assert {r["node"]: r["cost"] for r in graph_queries.shortest_path_relax(spark, str(tmp_path)).collect()} == cost and len(cost) == 21
    assert {r["node"]: r["component"] for r in graph_queries.components_bipartite(spark, str(tmp_path)).collect()} == label
    shared = {(a, b): len(parts[a] & parts[b]) for a in parts for b in parts if a < b and len(parts[a] & parts[b]) >= 0.3 * max(len(parts[a]), len(parts[b]))}
    assert shared and {(r["a"], r["b"]): r["shared"] for r in plans.overlap_share(spark, str(tmp_path)).collect()} == shared
