"""Trade-offs, routes with stops and diagnosis against searches in Python on a town of 200 nodes."""

import heapq
import math
import random

import pytest
from pyspark.sql import functions as F

from kerbgraph.operators import profiles, routing, tradeoffs

WIDE, HIGH = 20, 10
PEOPLE = ("rollator", "fatigue", "walking-stick")


def dijkstra(out, start, goal, longest=math.inf, most=math.inf):
    """Cheapest way with labels (cost, gap): (cost, path of arcs), exact."""
    heap, tie = [(0.0, 0.0, 0, start, ())], 0
    seen = {}
    while heap:
        cost, gap, _, u, path = heapq.heappop(heap)
        if any(c <= cost and g <= gap for c, g in seen.get(u, ())):
            continue
        seen.setdefault(u, []).append((cost, gap))
        if u == goal:
            return cost, path
        for a in out.get(u, ()):
            g = 0.0 if a.get("rest") else gap + a["length"]
            if g <= longest and cost + a["cost"] <= most:
                tie += 1
                heapq.heappush(heap, (cost + a["cost"], g, tie, a["dst"], (*path, a)))
    return None


@pytest.fixture(scope="module")
def town(spark):
    rng = random.Random(31)
    edges = []
    for x in range(WIDE):
        for y in range(HIGH):
            for dx, dy in ((1, 0), (0, 1)):
                if x + dx < WIDE and y + dy < HIGH:
                    a, b = x * HIGH + y, (x + dx) * HIGH + y + dy
                    edges.append((len(edges), a, b, rng.uniform(20, 60), rng.choice(["asphalt"] * 4 + ["sett", "cobblestone", "gravel"]), rng.choice([0.0, 1.0, 2.0, 3.0, 5.5, 7.25, -9.0, 11.0, None]), rng.random() < 0.08, rng.random() < 0.05))
    df = spark.createDataFrame(edges, "edge long, a long, b long, length double, surface string, slope double, bench boolean, toilet boolean")
    both = df.select(F.col("a").alias("src"), F.col("b").alias("dst"), "edge", "length", "surface", "slope", "bench", "toilet").unionByName(df.select(F.col("b").alias("src"), F.col("a").alias("dst"), "edge", "length", "surface", (-F.col("slope")).alias("slope"), "bench", "toilet"))

    def arcs_for(people):
        p = F.col("p")
        df = both.join(people.select("profile", "p"))
        seconds = F.col("length") / p["speed"]
        rough = p["surfaces"][F.col("surface")]
        limit = F.when(F.col("slope") >= 0, p["max_up"]).otherwise(p["max_down"])
        cost = seconds * (1 + rough) + F.when(F.col("slope").isNull(), 60 * F.col("length") / 100 * (1 - p["tolerance"])).otherwise(0.0)
        return df.where(rough.isNotNull() & F.coalesce(F.abs("slope") <= limit, F.lit(True))).select("profile", "src", "dst", "edge", cost.alias("cost"), "length", seconds.alias("seconds"), "surface", "slope", F.col("slope").isNull().alias("unknown"), "bench", "toilet", F.lit(False).alias("ride"))

    people = profiles.presets(spark).where(F.col("preset").isin(*PEOPLE)).withColumnRenamed("preset", "profile")
    rng = random.Random(8)
    asked = [(i, PEOPLE[i % 3], rng.randrange(WIDE * HIGH), rng.randrange(WIDE * HIGH)) for i in range(9)]
    requests = spark.createDataFrame(asked, "request long, profile string, origin long, destination long")
    stops = {}
    for flag in ("bench", "toilet"):
        ends = both.where(flag).select("edge", "src", (F.col("length") / 2).alias("offset"))
        stops[flag] = ends
    return edges, arcs_for, people, requests, asked, stops


def graph_of(edges, p, flag=None):
    out = {}
    for edge, a, b, length, surface, slope, bench, toilet in edges:
        for src, dst, sign in ((a, b, 1), (b, a, -1)):
            grade = None if slope is None else sign * slope
            rough = p["surfaces"].get(surface)
            if rough is None or grade is not None and abs(grade) > (p["max_up"] if grade >= 0 else p["max_down"]):
                continue
            seconds = length / p["speed"]
            cost = seconds * (1 + rough) + (60 * length / 100 * (1 - p["tolerance"]) if grade is None else 0)
            out.setdefault(src, []).append({"dst": dst, "src": src, "edge": edge, "cost": cost, "length": length, "seconds": seconds, "surface": surface, "slope": grade, "bench": bench, "toilet": toilet, "rest": {"bench": bench, "toilet": toilet}.get(flag, False)})
    return out


def gap_of(path, flag):
    at, last, worst = 0.0, 0.0, 0.0
    for a in path:
        if a[flag]:
            worst, last = max(worst, at + a["length"] / 2 - last), at + a["length"] / 2
        at += a["length"]
    return math.floor(max(worst, at - last) + 0.5)


def half_up(x):
    return math.floor(x + 0.5)


def plain_tradeoffs(edges, p, origin, goal):
    best = dijkstra(graph_of(edges, p), origin, goal)
    if best is None or not best[1]:
        return {}
    cost, path = best
    seconds = sum(a["seconds"] for a in path)
    added = lambda way: max(0, half_up((sum(a["seconds"] for a in way) - seconds) / 60))
    out = {}

    def told(name, found):
        out[name] = (found is not None, None if found is None else added(found[1]))

    if sum(a["length"] for a in path if a["surface"] in ("sett", "cobblestone")) > 20:
        told("smoother", dijkstra(graph_of(edges, p | {"surfaces": p["surfaces"] | {"sett": None, "cobblestone": None}}), origin, goal))
    worst = max((abs(a["slope"]) for a in path if a["slope"] is not None), default=0)
    if worst > p["comfort"]:
        cap = max(p["comfort"], math.floor(worst) - 1)
        told("gentler", dijkstra(graph_of(edges, p | {"max_up": min(p["max_up"], cap), "max_down": min(p["max_down"], cap)}), origin, goal))
    blank = lambda way: sum(a["length"] for a in way if a["slope"] is None)
    if blank(path) > 0:
        sure = dijkstra(graph_of(edges, p | {"tolerance": 0.0}), origin, goal)
        if sure and blank(sure[1]) < blank(path) - 20:
            told("more-certain", sure)
    if p["rest_m"] and gap_of(path, "bench") > p["rest_m"]:
        gap, kept = gap_of(path, "bench"), None
        rungs = sorted({g for g in [half_up(p["rest_m"] * f) for f in (8, 6, 4, 3, 2, 1.5, 1)] + [half_up(gap * 0.7), half_up(gap * 0.5)] if g < gap * 0.85}, reverse=True)
        for g in rungs[:2]:
            way = dijkstra(graph_of(edges, p, "bench"), origin, goal, g, max(cost * 2, cost + 900))
            if way is None:
                break
            if gap_of(way[1], "bench") < (kept[0] if kept else gap * 0.85):
                kept = gap_of(way[1], "bench"), way
        told("more-benches", kept[1] if kept else None)
    if p["toilet_m"] and gap_of(path, "toilet") > p["toilet_m"]:
        gap, kept = gap_of(path, "toilet"), None
        for f in (1, 1.5, 2, 3):
            way = dijkstra(graph_of(edges, p, "toilet"), origin, goal, p["toilet_m"] * f)
            if way:
                kept = way if gap_of(way[1], "toilet") < gap * 0.85 else None
                break
        told("more-toilets", kept)
    return out


def person(spark, name):
    row = profiles.presets(spark).where(F.col("preset") == name).first()["p"].asDict()
    return row | {"surfaces": dict(row["surfaces"])}


def test_tradeoffs(spark, town):
    edges, arcs_for, people, requests, asked, stops = town
    rows = tradeoffs.tradeoffs(arcs_for, people, requests, stops["bench"], stops["toilet"]).collect()
    got = {(r["request"], r["id"]): (r["found"], r["added_min"]) for r in rows}
    want = {(i, name): v for i, who, a, b in asked for name, v in plain_tradeoffs(edges, person(spark, who), a, b).items()}
    assert got == want
    assert {name for _, name in want} >= {"smoother", "gentler", "more-benches"} and len(got) == len(rows)
    assert all(r["message"].endswith(".") for r in rows)


def test_routes_with_gaps_are_exact_and_whole(spark, town):
    edges, arcs_for, people, requests, asked, _ = town
    arcs = arcs_for(people).withColumn("stop", F.col("bench")).cache()
    with_limits = requests.withColumn("longest", F.when(F.col("request") % 2 == 0, 300.0).otherwise(220.0)).withColumn("most", F.when(F.col("request") == 3, 100.0))
    goals, steps = routing.gap_routes(arcs, with_limits)
    costs, walked = {r["request"]: r["cost"] for r in goals.collect()}, {}
    for r in steps.orderBy("request", "seq").collect():
        walked.setdefault(r["request"], []).append(r)
    for i, who, a, b in asked:
        longest, most = (300.0 if i % 2 == 0 else 220.0), (100.0 if i == 3 else math.inf)
        out = graph_of(edges, person(spark, who), "bench")
        want = dijkstra(out, a, b, longest, most)
        assert (want is None) == (i not in costs)
        if want is None:
            continue
        assert costs[i] == pytest.approx(want[0])
        route = walked.get(i, [])
        assert [r["src"] for r in route] == [a, *[r["dst"] for r in route[:-1]]][: len(route)] and (not route or route[-1]["dst"] == b)
        gap = total = 0.0
        for r in route:
            arc = next(x for x in out[r["src"]] if x["dst"] == r["dst"] and x["edge"] == r["edge"])
            gap, total = 0.0 if arc["rest"] else gap + arc["length"], total + arc["cost"]
            assert gap <= longest
        assert total == pytest.approx(want[0])


def test_diagnosis(spark):
    """A wall of obstacles between two halves; what stops one person may be stretched, what stops another may not."""
    line = [(1, 0, 1, "asphalt", 0.0), (2, 1, 2, "asphalt", 9.5), (3, 2, 3, "gravel", 0.0), (4, 3, 4, "asphalt", 0.0), (5, 0, 5, "asphalt", 0.0)]
    df = spark.createDataFrame(line, "edge long, a long, b long, surface string, slope double")
    both = df.select(F.col("a").alias("src"), F.col("b").alias("dst"), "edge", "surface", "slope").union(df.select("b", "a", "edge", "surface", -F.col("slope")))

    def arcs_for(people):
        p = F.col("p")
        ok = p["surfaces"][F.col("surface")].isNotNull() & (F.abs("slope") <= F.when(F.col("slope") >= 0, p["max_up"]).otherwise(p["max_down"]))
        return both.join(people.select("profile", "p")).where(ok).select("profile", "src", "dst", "edge", F.lit(10.0).alias("cost"), F.lit(10.0).alias("length"))

    people = profiles.presets(spark).where("preset = 'manual-wheelchair'").withColumnRenamed("preset", "profile")
    requests = spark.createDataFrame([(1, "manual-wheelchair", 0, 4), (2, "manual-wheelchair", 0, 2), (3, "manual-wheelchair", 0, 3)], "request long, profile string, origin long, destination long")
    free = spark.createDataFrame([(r, i + 1, e, s, d) for r, n in ((1, 4), (2, 2), (3, 3)) for i, (e, s, d) in enumerate([(1, 0, 1), (2, 1, 2), (3, 2, 3), (4, 3, 4)][:n])], "request long, seq int, edge long, src long, dst long")
    nothing = (None, None, None, None, None)
    judged = [(1, 2, "incline", None, 9.5, None, None, None), (1, 3, "surface", None, None, None, "gravel", None), (2, 2, "incline", None, 9.5, None, None, None), (3, 2, "incline", None, 9.5, None, None, None), (3, 3, "live", *nothing)]
    judged = spark.createDataFrame(judged, "request long, seq int, attr string, steps double, slope double, kerb_cm double, surface string, width double")
    nodes = spark.createDataFrame([(i, -3.0 + i * 0.001, 55.9) for i in range(6)], "node long, lon double, lat double")
    closest, relax = tradeoffs.diagnose(arcs_for, people, requests, free, judged, nodes)
    assert {(r["request"], r["closest"]) for r in closest.collect()} == {(1, 1), (2, 1), (3, 1)}
    assert {(r["request"], r["what"]): r["cost"] for r in relax.collect()} == {(1, "incline, gravel"): 40.0, (2, "incline"): 20.0}


def test_snap(spark):
    rng = random.Random(5)
    nodes = [(i, -3.2 + rng.random() * 0.02, 55.9 + rng.random() * 0.01) for i in range(300)]
    usable = [("a", i) for i in range(300) if i % 3] + [("b", i) for i in range(0, 300, 7)]
    points = [(k, who, -3.2 + rng.random() * 0.02, 55.9 + rng.random() * 0.01) for k in range(30) for who in "ab"] + [(99, "a", 10.0, 10.0)]
    out = routing.snap(spark.createDataFrame(points, "point long, profile string, lon double, lat double"), spark.createDataFrame(nodes, "node long, lon double, lat double"), spark.createDataFrame(usable, "profile string, node long"), 150.0)
    place = {i: (x, y) for i, x, y in nodes}

    def far(a, b):
        (x1, y1), (x2, y2) = (tuple(map(math.radians, p)) for p in (a, b))
        h = math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2
        return 2 * 6371008.8 * math.asin(math.sqrt(h))

    want = {}
    for k, who, x, y in points:
        found = min((far((x, y), place[i]), i) for w, i in usable if w == who)
        if found[0] <= 150:
            want[k, who] = found[1]
    assert {(r["point"], r["profile"]): r["node"] for r in out.collect()} == want
