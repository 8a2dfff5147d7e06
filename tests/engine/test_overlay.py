"""Lines over polygons, lines and squares, and stations and notes in the street graph, against loops over all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from kerbgraph.operators import linking, overlay, routing

POINTS = "array<struct<x:double,y:double>>"


def plain_samples(line):
    segs, total = [], 0.0
    for (ax, ay), (bx, by) in zip(line, line[1:], strict=False):
        n = math.hypot(bx - ax, by - ay)
        if n > 0:
            segs.append((ax, ay, (bx - ax) / n, (by - ay) / n, n, total))
            total += n
    if not segs:
        return []

    def at(d):
        s = next((s for s in segs if d <= s[5] + s[4]), segs[-1])
        t = min(1, max(0, (d - s[5]) / s[4])) * s[4]
        return s[0] + t * s[2], s[1] + t * s[3], s[2], s[3]

    if total < 15:
        return [at(total / 2)]
    return [at(5 + 5 * i) for i in range(int((total - 10 + 1e-9) // 5) + 1)]


def to_polygon(x, y, rings):
    inside, best = False, math.inf
    for r in rings:
        for (xi, yi), (xj, yj) in zip(r, r[-1:] + r[:-1], strict=True):
            if (yi > y) != (yj > y) and x < (xj - xi) * (y - yi) / (yj - yi) + xi:
                inside = not inside
            dx, dy = xj - xi, yj - yi
            t = max(0, min(1, ((x - xi) * dx + (y - yi) * dy) / (dx * dx + dy * dy))) if dx or dy else 0
            best = min(best, math.hypot(xi + t * dx - x, yi + t * dy - y))
    return 0.0 if inside else best


def walk(rng, legs):
    x, y = rng.uniform(0, 400), rng.uniform(0, 400)
    line = [(x, y)]
    for _ in range(legs):
        a, n = rng.uniform(0, 6.28), rng.uniform(2, 40)
        line.append((line[-1][0] + n * math.cos(a), line[-1][1] + n * math.sin(a)))
    return line


def structs(line):
    return [{"x": float(x), "y": float(y)} for x, y in line]


@pytest.fixture(scope="module")
def lines():
    rng = random.Random(17)
    return [(i, rng.choice(["footway", "street_proxy", "sidewalk", "steps", "pedestrian"]), walk(rng, rng.choice([1, 1, 2, 4]))) for i in range(300)] + [(900, "footway", [(5.0, 5.0), (5.0, 5.0)]), (901, "footway", [(1.0, 1.0)])]


def test_footways(spark, lines):
    rng = random.Random(18)
    polys = []
    for i in range(150):
        x, y, w, d = rng.uniform(0, 400), rng.uniform(0, 400), rng.uniform(3, 60), rng.uniform(2, 25)
        ring = [(x, y), (x + w, y + rng.uniform(-2, 2)), (x + w, y + d), (x, y + d)]
        hole = [[(x + w * 0.3, y + d * 0.3), (x + w * 0.6, y + d * 0.3), (x + w * 0.6, y + d * 0.6)]] if i % 5 == 0 else []
        polys.append((i, rng.choice(["sett", "asphalt", "asphalt", "paving_stones", "cobblestone", None]), rng.choice([None, 0.3, 1.25, 1.8, 2.4, 30.0]), [ring, *hole]))

    def plain(kind, line):
        pts, hits, found = plain_samples(line), [], 0
        for x, y, dx, dy in pts:
            best = {}
            for i, surface, width, rings in polys:
                d, side = to_polygon(x, y, rings), 1
                if d > (15 if kind == "street_proxy" else 3):
                    continue
                if kind == "street_proxy":
                    px, py = min((p for r in rings for p in r), key=lambda p: math.hypot(p[0] - x, p[1] - y))
                    side = 1 if dx * (py - y) - dy * (px - x) >= 0 else -1
                best[side] = min(best.get(side, (math.inf, 0)), (d, i))
            found += bool(best)
            hits += [polys[best[s][1]] for s in (1, -1) if s in best]
        if not pts or found < len(pts) / 2:
            return None
        known = [h[1] for h in hits if h[1]]
        surface = None
        if known and len(known) >= len(hits) / 2:
            top = max(dict.fromkeys(known), key=known.count)
            surface = next((s for s in ("cobblestone", "sett") if known.count(s) >= len(known) / 4), top if known.count(top) >= len(known) / 2 else None)
        widths = sorted(h[2] for h in hits if h[2] is not None and 0.6 <= h[2] <= 10)
        width = math.floor(widths[int((len(widths) - 1) * 0.2)] * 10 + 0.5) / 10 if widths and len(widths) >= len(hits) / 2 else None
        return (surface, width) if surface or width is not None else None

    edges = spark.createDataFrame([(i, k, structs(line)) for i, k, line in lines], f"edge long, kind string, line {POINTS}")
    table = spark.createDataFrame([(i, s, w, [structs(r) for r in rings]) for i, s, w, rings in polys], f"polygon long, surface string, width double, rings array<{POINTS}>")
    got = {r["edge"]: (r["surface"], r["width"]) for r in overlay.footways(edges, table).collect()}
    want = {i: v for i, k, line in lines if (v := plain(k, line))}
    assert got == want and len(want) > 60


def test_gritting(spark, lines):
    rng = random.Random(19)
    routes = [walk(rng, 6) for _ in range(60)] + [line for _, _, line in lines[:40]]

    def near(x, y, dx, dy, r):
        for line in routes:
            for (ax, ay), (bx, by) in zip(line, line[1:], strict=False):
                n = math.hypot(bx - ax, by - ay)
                if n and abs((bx - ax) / n * dx + (by - ay) / n * dy) >= math.cos(math.pi / 6):
                    t = max(0, min(1, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / n / n))
                    if math.hypot(ax + t * (bx - ax) - x, ay + t * (by - ay) - y) <= r:
                        return True
        return False

    want = set()
    for i, kind, line in lines:
        pts = plain_samples(line)
        if kind in overlay.GRITTED and pts and sum(near(*p, 6 if kind in overlay.MIDDLE else 12) for p in pts) >= 0.6 * len(pts):
            want.add(i)
    edges = spark.createDataFrame([(i, k, structs(line)) for i, k, line in lines], f"edge long, kind string, line {POINTS}")
    got = {r["edge"] for r in overlay.gritted(edges, spark.createDataFrame([(structs(r),) for r in routes], f"line {POINTS}")).collect()}
    assert got == want and len(want) > 30


def test_squares(spark, lines):
    points = [(325_512.0, 673_478.0, "NT2573", "NT27SE"), (530_034.0, 180_381.0, "TQ3080", "TQ38SW"), (400_000.0, 100_000.0, "SU0000", "SU00SW"), (216_650.0, 771_250.0, "NN1671", "NN17SE")]
    df = spark.createDataFrame(points, "e double, n double, s string, q string")
    assert all(r[0] == r["s"] and r[1] == r["q"] for r in df.select(overlay.square(F.col("e"), F.col("n")), overlay.quadrant(F.col("e"), F.col("n")), "s", "q").collect())
    rows = [(i, structs([(x * 9 - 700, y * 9) for x, y in line])) for i, _, line in lines]
    found = overlay.pieces(spark.createDataFrame(rows, f"edge long, line {POINTS}")).collect()
    sums, cells = {}, {}
    for r in found:
        sums[r["edge"]] = sums.get(r["edge"], 0) + r["metres"]
        cells.setdefault(r["edge"], {}).setdefault((r["col"], r["row"]), 0.0)
        cells[r["edge"]][r["col"], r["row"]] += r["metres"]
    for i, line in rows:
        total = sum(math.hypot(b["x"] - a["x"], b["y"] - a["y"]) for a, b in zip(line, line[1:], strict=False))
        assert sums.get(i, 0) == pytest.approx(total)
        # a thousand points of each leg lie in the squares in proportion
        for a, b in zip(line, line[1:], strict=False):
            for k in range(1, 40):
                x, y = a["x"] + (b["x"] - a["x"]) * k / 40, a["y"] + (b["y"] - a["y"]) * k / 40
                assert total == 0 or (math.floor(x / 1000), math.floor(y / 1000)) in cells[i]
    whole = overlay.coverage(spark.createDataFrame([(structs([(325_900.0, 673_500.0), (326_300.0, 673_500.0)]), True), (structs([(325_950.0, 673_100.0), (325_950.0, 673_200.0)]), False)], f"line {POINTS}, known boolean"))
    assert {(r["square"], round(r["metres"], 6), round(r["share"], 6)) for r in whole.collect()} == {("NT2573", 200.0, 0.5), ("NT2673", 300.0, 1.0)}


def test_transit_routes_over_streets(spark):
    """Two lines with a change; a search over streets, links, boards and rides goes by train."""
    at = lambda i: (-3.2 + i * 0.002, 55.95)
    nodes = [(i, *at(i)) for i in range(20)]
    stations = [("a", "Alpha", *at(0), None), ("b", "Beta", *at(10), "hub"), ("c", "Gamma", at(10)[0] + 0.0005, 55.9503, "hub"), ("d", "Delta", *at(19), None), ("e", "Unserved", *at(5), None), ("f", "Far", 0.0, 50.0, None)]
    routes = [("r1", "red", "Red", ["a", "b"]), ("r2", "red", "Red", ["b", "a"]), ("r3", "blue", "Blue", ["c", "x", "d"]), ("r4", "blue", "Blue", ["c", "d", "f"])]
    made, edges = linking.transit(spark.createDataFrame(stations, "station string, name string, lon double, lat double, hub string"), spark.createDataFrame(routes, "route string, line string, line_name string, stops array<string>"), spark.createDataFrame(nodes, "node long, lon double, lat double"))
    rows = edges.collect()
    kinds = {k: [r for r in rows if r["kind"] == k] for k in ("station_link", "board", "transit", "interchange")}
    assert sorted(r["ref"] for r in kinds["transit"]) == ["ride:blue:c:d", "ride:blue:d:f", "ride:red:a:b"]
    assert sorted(r["ref"] for r in kinds["board"]) == ["board:blue:c", "board:blue:d", "board:blue:f", "board:red:a", "board:red:b"]
    assert [r["name"] for r in kinds["interchange"]] == ["Change from Beta to Gamma"] and kinds["interchange"][0]["length_m"] == 50
    assert {r["ref"]: sum(x["ref"] == r["ref"] for x in kinds["station_link"]) for r in kinds["station_link"]} == {"link:a": 2, "link:b": 3, "link:c": 3, "link:d": 2}
    ids = {r["node"] for r in made.collect()}
    assert len(ids) == 10 and max(ids) < 0
    cost = {"station_link": 30.0, "board": 60.0, "transit": 100.0, "interchange": 40.0}
    arcs = [("p", r["from_node"], r["to_node"], r["ref"], cost[r["kind"]], r["length_m"]) for r in rows]
    arcs += [("p", i, i + 1, f"s{i}", 110.0, 125.0) for i in range(19)]
    arcs += [(p, b, a, e, c, n) for p, a, b, e, c, n in arcs]
    found = routing.routes(spark.createDataFrame(arcs, "profile string, src long, dst long, edge string, cost double, length double"), spark.createDataFrame([(1, "p", 0, 19)], "request long, profile string, origin long, destination long"))
    route = [r["edge"] for r in found.orderBy("seq").collect()]
    assert route == ["link:a", "board:red:a", "ride:red:a:b", "board:red:b", "interchange:b:c", "board:blue:c", "ride:blue:c:d", "board:blue:d", "link:d"]


def test_nearest_under_a_reach(spark):
    rng = random.Random(3)
    nodes = [(i, -3.2 + rng.random() * 0.02, 55.9 + rng.random() * 0.01) for i in range(400)]
    points = [(i, -3.2 + rng.random() * 0.02, 55.9 + rng.random() * 0.01, rng.choice([35.0, 90.0, 200.0])) for i in range(60)]
    got = {}
    for r in linking.nearest(spark.createDataFrame(points, "point long, lon double, lat double, reach double"), spark.createDataFrame(nodes, "node long, lon double, lat double"), 3).orderBy("point", "rank").collect():
        got.setdefault(r["point"], []).append(r["node"])

    def far(a, b):
        (x1, y1), (x2, y2) = (tuple(map(math.radians, p)) for p in (a, b))
        return 2 * 6371008.8 * math.asin(math.sqrt(math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2))

    want = {i: [n for d, n in sorted((far((x, y), (a, b)), n) for n, a, b in nodes) if d <= reach][:3] for i, x, y, reach in points}
    assert got == {k: v for k, v in want.items() if v}


def test_notes_by_tier(spark):
    line = lambda *xs: [{"lon": x, "lat": 55.9} for x in xs]
    edges = spark.createDataFrame([(1, 10, line(-3.2, -3.199)), (2, 10, line(-3.1, -3.099)), (3, 11, line(-3.2)), (4, None, line(-3.2))], "edge long, way long, line array<struct<lon:double,lat:double>>")
    notes = spark.createDataFrame([("new", -3.2, 55.9, "b2", [2, 99], [10]), ("old", -3.2, 55.9, "b1", [2], [10, 11]), ("none", -3.2, 55.9, None, [2], [11]), ("far", -2.0, 55.9, "b1", [1], [10])], "note string, lon double, lat double, built string, edges array<long>, ways array<long>")
    assert {tuple(r) for r in linking.note_edges(notes, edges, "b2").collect()} == {("new", 2), ("new", 99), ("old", 1), ("old", 3), ("none", 3)}
    stretches = spark.createDataFrame([("s", [2, 5], [12], line(-3.1)), ("t", [7], [10, 11], line(-3.2))], "name string, edges array<long>, ways array<long>, points array<struct<lon:double,lat:double>>")
    assert {tuple(r) for r in linking.notes_of_stretches(notes, stretches, "b2", ["name"]).collect()} == {("s", "new"), ("t", "old"), ("t", "none")}
    doors = spark.createDataFrame([(5,), (6,)], "entrance long")
    said = spark.createDataFrame([("x", "entrance:5"), ("y", "place:5"), ("z", None)], "note string, ref string")
    assert [tuple(r) for r in linking.notes_of_entrances(said, doors).collect()] == [(5, "x")]
