"""Batch searches against a heap search in Python."""

import heapq
import random

import pytest
from pyspark.sql import functions as F

from kerbgraph.operators import graph, routing
from kerbgraph.sources.scratch import Tables


def dijkstra(arcs, start, factor=None):
    best, heap = {start: (0.0, 0)}, [(0.0, 0, start)]
    while heap:
        cost, hops, u = heapq.heappop(heap)
        if (cost, hops) > best[u]:
            continue
        for v, edge, c in arcs.get(u, ()):
            new = (cost + c * (factor or {}).get(edge, 1.0), hops + 1)
            if v not in best or new < best[v]:
                best[v] = new
                heapq.heappush(heap, (*new, v))
    return best


@pytest.fixture(scope="module")
def town(spark):
    """A grid of streets with odd costs, an island, and two profiles, one of which may not use every seventh edge."""
    rng = random.Random(2)
    rows, edge = [], 0
    for x in range(7):
        for y in range(7):
            for dx, dy in ((1, 0), (0, 1)):
                if x + dx < 7 and y + dy < 7:
                    edge += 1
                    c = float(rng.randrange(1, 40))
                    for a, b in (((x, y), (x + dx, y + dy)), ((x + dx, y + dy), (x, y))):
                        for who in ("a", "b"):
                            if who == "a" or edge % 7:
                                rows.append((who, a[0] * 10 + a[1], b[0] * 10 + b[1], edge, c, 10.0))
    rows += [("a", 900, 901, 999, 1.0, 10.0)]
    arcs = spark.createDataFrame(rows, "profile string, src long, dst long, edge long, cost double, length double")
    known = {}
    for who, s, d, e, c, _ in rows:
        known.setdefault(who, {}).setdefault(s, []).append((d, e, c))
    asked = [(1, "a", 0, 66), (2, "b", 0, 66), (3, "a", 33, 5), (4, "b", 60, 6), (5, "a", 0, 900), (6, "a", 12, 12)]
    return arcs, known, spark.createDataFrame(asked, "request long, profile string, origin long, destination long"), asked


def test_routes_are_cheapest_and_whole(town):
    arcs, known, requests, asked = town
    steps = {}
    for r in routing.routes(arcs, requests).collect():
        steps.setdefault(r["request"], []).append(r)
    for request, who, origin, destination in asked:
        best = dijkstra(known[who], origin)
        route = sorted(steps.get(request, []), key=lambda r: r["seq"])
        if destination not in best or origin == destination:
            assert route == []
            continue
        assert route[-1]["cost"] == pytest.approx(best[destination][0]) and len(route) == best[destination][1]
        assert [r["src"] for r in route] == [origin, *[r["dst"] for r in route[:-1]]] and route[-1]["dst"] == destination
        assert all(any((v, e) == (r["dst"], r["edge"]) for v, e, _ in known[who][r["src"]]) for r in route)


def test_alternatives(town):
    arcs, known, requests, asked = town
    steps, sums = routing.alternatives(arcs, requests.where("request <= 4"))
    routes = {}
    for r in steps.collect():
        routes.setdefault((r["request"], r["route"]), {})[r["edge"]] = 10.0
    found = {}
    for r in sums.collect():
        found.setdefault(r["request"], []).append((r["rank"], r["cost"], r["length"], r["route"]))
    for request, who, origin, destination in asked[:4]:
        best = dijkstra(known[who], origin)[destination][0]
        mine = sorted(found[request])
        assert mine[0][1] == pytest.approx(best) and len(mine) <= 3 and all(c <= max(1.6 * best, best + 300) for _, c, _, _ in mine)
        sets = [set(routes[request, r[3]]) for r in mine]
        assert all(len(a & b) / max(len(a), len(b)) < 0.7 for i, a in enumerate(sets) for b in sets[:i])


def test_gaps(town, spark):
    arcs, known, requests, asked = town
    stops = {e for e in range(1, 200) if e % 5 == 0}
    df = arcs.withColumn("stop", F.col("edge") % 5 == 0).withColumn("ride", F.lit(False))
    got = {r["request"]: r["cost"] for r in routing.search_with_gaps(df, requests.where("request <= 4"), 40.0).collect()}
    for request, who, origin, destination in asked[:4]:
        best, heap = {}, [(0.0, origin, 0.0)]
        answer = None
        while heap:
            cost, u, gap = heapq.heappop(heap)
            if best.get((u, gap), 1e9) <= cost:
                continue
            best[u, gap] = cost
            if u == destination:
                answer = cost
                break
            for v, e, c in known[who].get(u, ()):
                g = 0.0 if e in stops else gap + 10.0
                if g <= 40.0:
                    heapq.heappush(heap, (cost + c, v, g))
        assert got[request] == (pytest.approx(answer) if answer is not None else None)


def test_snap_reach_and_blockers(spark, town):
    arcs, _, requests, _ = town
    comps = graph.components(arcs.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    usable = routing.usable_nodes(arcs, comps).where("profile = 'a'").collect()
    assert len(usable) == 49 and 900 not in {r["node"] for r in usable}
    assert routing.passable_reach(arcs, requests.where("request = 1")).count() == 49
    direct = spark.createDataFrame([(1, 1, 10, "High Street", 0, None), (1, 2, 11, "High Street", 1, "steps"), (1, 3, 12, "High Street", 2, "steps"), (1, 4, 13, "Close", 3, "surface")], "request long, seq int, edge long, name string, src long, excluded_by string")
    reached = spark.createDataFrame([(1, 0), (1, 1)], "request long, node long")
    assert [(r["seq"], r["attr"]) for r in routing.blockers(direct, reached).orderBy("seq").collect()] == [(2, "steps"), (4, "surface")]


def test_avoided_and_summary(spark):
    kind = "request long, edge long, name string, length_m double, reasons array<struct<kind:string,attr:string,detail:string,seconds:double>>"
    direct = spark.createDataFrame([(1, 1, "A", 10.0, [("penalty", "incline", "", 3.0)]), (1, 2, "B", 30.0, [("penalty", "surface", "", 9.0)]), (1, 3, "B", 20.0, [("penalty", "incline", "", 12.0)]), (1, 4, "C", 5.0, [("excluded", "steps", "", float("inf"))]), (1, 5, "D", 99.0, [("excluded", "steps", "", float("inf"))])], kind)
    out = routing.avoided(spark.createDataFrame([(1, 5)], "request long, edge long"), direct).orderBy("rank").collect()
    assert [(r["name"], r["attr"], r["length_m"]) for r in out] == [("C", "steps", 5.0), ("B", "incline", 50.0)]
    attr = "struct<value:{},state:string>"
    rows = [(1, 1, "footway", True, 100.0, 90.0, "yes", "yes", (5.0, "reported"), (7.0, "reported"), ("sett", "reported"), (2.0, "verified"), None, "junction", "lowered"), (1, 2, "crossing", True, 10.0, 9.0, "unknown", "yes", (-2.0, "reported"), (None, "unknown"), (None, "unknown"), (None, "unknown"), None, "junction", None), (1, 3, "transit", True, 1000.0, 100.0, "yes", "yes", (None, "unknown"), (None, "unknown"), (None, "unknown"), (None, "unknown"), None, "station", None)]
    walked = spark.createDataFrame(rows, f"request long, seq int, kind string, forward boolean, length_m double, seconds double, passable string, node_passable string, incline {attr.format('double')}, incline_max {attr.format('double')}, surface {attr.format('string')}, width {attr.format('double')}, step_count {attr.format('double')}, node_kind string, kerb string")
    s = routing.summary(walked, ["request"]).first()
    assert (s["minutes"], s["distance_m"], s["ascent_m"], s["descent_m"], s["worst_incline"], s["kerbs_lowered"], s["kerbs_unknown"], s["unknown_m"], s["walk_m"], s["verdict"]) == (3.3, 1110, 5.0, 0.2, 7.0, 1, 1, 10, 110, "passable-with-unknowns")
    assert s["confidence"] == pytest.approx(round((100 * (0.48 + 0.48 + 0.76) / 3 + 10 * 0.48 / 3) / 110, 2))
    use = spark.range(1).select(routing.range_use(F.lit(9000.0), F.lit(100.0), F.lit(20.0)).alias("u")).first()["u"]
    assert (use["km"], use["level"]) == (12.0, "over-half")


def test_long_chain_in_few_rounds(spark, monkeypatch):
    rounds = []
    write = graph.Tables.write
    monkeypatch.setattr(graph.Tables, "write", lambda self, df, name: (rounds.append(name), write(self, df, name))[1])
    links = spark.range(999).select(F.xxhash64("id").alias("a"), F.xxhash64(F.col("id") + 1).alias("b"))
    assert graph.components(links).select("component").distinct().count() == 1
    assert rounds.count("large") <= 15


def test_cheapest_takes_few_hops_and_any_length(spark):
    arcs = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 2.0), (3, 4, 1.0), (1, 2, 5.0)], "src long, dst long, cost double")
    got = {r["node"]: (r["cost"], r["hops"], r["via"]) for r in graph.cheapest(arcs, spark.createDataFrame([(1,)], "root long")).collect()}
    assert got == {1: (0.0, 0, 1), 2: (1.0, 1, 1), 3: (2.0, 1, 1), 4: (3.0, 2, 3)}
    assert {r["node"] for r in graph.cheapest(arcs, spark.createDataFrame([(1,)], "root long"), 1).collect()} == {1, 2, 3}


def test_bounds_grow_until_nothing_is_left(spark):
    """Ways far dearer than the first bound, a node with many dear arcs, one no arc leads on from, and none at all."""
    rows = [("a", 0, 1, 1, 1.0), ("a", 1, 2, 2, 900.0), ("a", 2, 3, 3, 1.0), ("a", 0, 3, 4, 903.0), ("a", 3, 4, 5, 50_000.0), ("a", 0, 9, 6, 0.0)]
    rows += [("a", 0, 100 + i, 10 + i, 2.0 + i) for i in range(40)] + [("a", 100 + i, 0, 60 + i, 2.0) for i in range(40)]
    arcs = spark.createDataFrame(rows, "profile string, src long, dst long, edge long, cost double").withColumn("length", F.col("cost"))
    asked = [(1, "a", 0, 3), (2, "a", 0, 4), (3, "a", 0, 9), (4, "a", 9, 0), (5, "a", 3, 2), (6, "a", 120, 3)]
    requests = spark.createDataFrame(asked, "request long, profile string, origin long, destination long")
    found = {r["request"]: (r["cost"], r["hops"]) for r in routing.search(arcs, requests).where("node = destination").collect()}
    assert found == {1: (902.0, 3), 2: (50_902.0, 4), 3: (0.0, 1), 6: (904.0, 4)}
    # what costs more than the route of the first request isn't made for it
    most = spark.createDataFrame([(1, 902.0)], "request long, most double")
    with Tables(spark) as tables:
        ready, stride = routing._arcs(arcs, tables)
        held = routing._search(ready, stride, requests.where("request = 1"), known_routes=most)
        assert held.agg(F.max("cost")).first()[0] == 902.0
    stops = arcs.withColumn("stop", F.col("dst") == 1).withColumn("ride", F.lit(False))
    gaps = {r["request"]: r["cost"] for r in routing.search_with_gaps(stops, requests.where("request <= 2"), 901.0).collect()}
    assert gaps == {1: 902.0, 2: None}


def test_balls_tell_the_arcs_of_least_routes(spark, town):
    arcs, known, requests, asked = town
    back = {who: {} for who in known}
    for who, out in known.items():
        for u, ways in out.items():
            for v, e, c in ways:
                back[who].setdefault(v, []).append((u, e, c))
    with Tables(spark) as tables:
        balls = routing._Balls(*routing._arcs(arcs, tables), requests, tables)
        balls.grow()
        got = {(r["profile"], r["node"], r["dst"], r["edge"]) for r in balls.between()[0].collect()}
    want = set()
    for r, who, a, b in asked:
        f, t = dijkstra(known[who], a), dijkstra(back[who], b)
        want |= {(r, u, v, e) for u in f for v, e, c in known[who].get(u, ()) if b in f and v in t and f[u][0] + c + t[v][0] <= f[b][0]}
    assert want <= got and len(got) < arcs.count() * len(asked) / 4
