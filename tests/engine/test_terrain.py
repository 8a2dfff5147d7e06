"""Heights from tiles, slopes and camber of edges, against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from kerbgraph.operators import lines, terrain

TILES = "rank int, x0 double, y0 double, res double, width int, height int, z array<double>"


def raster(rng, rank, x0, y0, res, width, height, holes):
    def z(i, j):
        x, y = x0 + (i + 0.5) * res, y0 - (j + 0.5) * res
        return 50 + 0.04 * x - 0.02 * y + 2 * math.sin(x / 9) + rank * 0.01

    cells = [None if rng.random() < holes else z(i, j) for j in range(height) for i in range(width)]
    if len(cells) > 9 and holes:
        cells[3], cells[7] = float("nan"), -9999.0
    return (rank, x0, y0, res, width, height, cells)


def plain(tiles, x, y):
    for _, x0, y0, res, width, height, z in sorted(tiles):
        fx, fy = (x - x0) / res - 0.5, (y0 - y) / res - 0.5
        u, v = math.floor(fx), math.floor(fy)

        def cell(i, j):
            if not (0 <= i < width and 0 <= j < height):
                return None
            value = z[j * width + i]
            return None if value is None or not math.isfinite(value) or value < -100 else value

        four = [cell(u, v), cell(u + 1, v), cell(u, v + 1), cell(u + 1, v + 1)]
        tx, ty = fx - u, fy - v
        if None not in four:
            return four[0] * (1 - tx) * (1 - ty) + four[1] * tx * (1 - ty) + four[2] * (1 - tx) * ty + four[3] * tx * ty
        some = [c for c in four if c is not None]
        if some:
            return some[0]
    return None


def plain_slopes(tiles, line):
    points, done = [], 0.0
    for (ax, ay), (bx, by) in zip(line, line[1:], strict=False):
        n = math.hypot(bx - ax, by - ay)
        parts = max(1, math.ceil(n))
        points += [(done + n * s / parts, ax + (bx - ax) * s / parts, ay + (by - ay) * s / parts) for s in range(parts)]
        done += n
    points.append((done, *line[-1]))
    z = [plain(tiles, x, y) for _, x, y in points]
    if None in z:
        return ("no-data", None, None, None)
    for a, b, p, q in zip(z, z[1:], points, points[1:], strict=False):
        if q[0] > p[0] and abs(b - a) > max(0.6, (q[0] - p[0]) * 0.6):
            return ("discontinuity", None, None, None)
    if done < 5:
        (ax, ay), (bx, by) = line[0], line[-1]
        n = math.hypot(bx - ax, by - ay)
        if n < 0.2:
            return ("no-data", None, None, None)
        ends = [plain(tiles, (ax + bx) / 2 + (bx - ax) / n * s, (ay + by) / 2 + (by - ay) / n * s) for s in (-2.5, 2.5)]
        if None in ends:
            return ("no-data", None, None, None)
        mean = most = (ends[1] - ends[0]) / 5 * 100
    else:
        mean = most = (z[-1] - z[0]) / done * 100
        for i in range(len(z)):
            j = next((j for j in range(i, len(z)) if points[j][0] - points[i][0] >= min(10, done) - 1e-9), len(z) - 1)
            run = points[j][0] - points[i][0]
            if run < min(10, done) * 0.95:
                break
            if abs((z[j] - z[i]) / run * 100) > abs(most):
                most = (z[j] - z[i]) / run * 100
    if abs(most) > 35 or abs(mean) > 35:
        return ("discontinuity", None, None, None)
    across = []
    for i in range(1, len(z) - 1, 2):
        dx, dy = points[i + 1][1] - points[i - 1][1], points[i + 1][2] - points[i - 1][2]
        n = math.hypot(dx, dy)
        if n:
            left, right = (plain(tiles, points[i][1] - s * dy / n, points[i][2] + s * dx / n) for s in (1, -1))
            if left is not None and right is not None:
                across.append(abs(left - right))
    kept = sorted(a for a in across if a <= 0.5)
    camber = kept[math.floor(len(kept) * 0.75)] / 2 * 100 if kept and len(across) - len(kept) <= len(kept) else None
    return ("sampled", mean, most, camber)


@pytest.fixture(scope="module")
def tiles():
    rng = random.Random(3)
    near = [raster(rng, 0, 0.0, 200.0, 1.0, 150, 90, 0.0), raster(rng, 1, 130.25, 180.5, 0.5, 70, 131, 0.01), raster(rng, 2, -40.0, 260.0, 5.0, 70, 60, 0.0)]
    wall = [z + (4 if i % 150 > 100 else 0) for i, z in enumerate(near[0][6])]
    near[0] = (*near[0][:6], wall)
    return [*near, raster(rng, 3, 900.0, 10.0, 2.0, 1, 1, 0.0)]


@pytest.mark.parametrize("side", [1, 7, 64])
def test_heights_against_single_tiles(spark, tiles, side):
    rng = random.Random(side)
    places = [(i, rng.uniform(-60, 330), rng.uniform(-60, 280)) for i in range(600)] + [(600, 901.0, 9.0), (601, 899.5, 10.5), (602, 0.0, 200.0), (603, 0.5, 199.5), (604, 5000.0, 5000.0), (605, None, 3.0)]
    dtm = terrain.blocks(spark.createDataFrame(tiles, TILES), side)
    got = {r["p"]: r["z"] for r in terrain.heights(spark.createDataFrame(places, "p int, x double, y double"), dtm, ["p"]).collect()}
    assert len(got) == len(places) and got[605] is None and got[604] is None
    for p, x, y in places[:-1]:
        want = plain(tiles, x, y)
        assert got[p] == want or abs(got[p] - want) < 1e-9, (p, x, y)
    empty = terrain.heights(spark.createDataFrame([], "p int, x double, y double"), terrain.blocks(spark.createDataFrame([], TILES)), ["p"])
    assert empty.collect() == []


def ways(rng):
    out = []
    for e in range(160):
        x, y = rng.uniform(-30, 280), rng.uniform(0, 240)
        line = [(x, y)]
        for _ in range(rng.randint(1, 4)):
            a, n = rng.uniform(0, 6.28), rng.uniform(0.1, 2 if e % 4 == 0 else 25)
            line.append((line[-1][0] + n * math.cos(a), line[-1][1] + n * math.sin(a)))
        out.append((e, line))
    return [*out, (160, [(5.0, 150.0), (5.0, 150.0)]), (161, [(5.0, 150.0), (9.0, 150.0), (5.0, 150.0), (5.0, 158.0)])]


def test_slopes_against_loops(spark, tiles):
    made = ways(random.Random(11))
    edges = spark.createDataFrame([(e, [{"x": x, "y": y} for x, y in line]) for e, line in made], "edge int, line array<struct<x:double,y:double>>")
    got = {r["edge"]: r for r in terrain.edge_slopes(edges, terrain.blocks(spark.createDataFrame(tiles, TILES))).collect()}
    seen = set()
    for e, line in made:
        want = plain_slopes(tiles, line)
        seen.add(want[0])
        r = got[e]
        assert r["verdict"] == want[0], (e, line)
        for c, w in zip(("mean", "steepest", "camber"), want[1:], strict=True):
            assert (r[c] is None) == (w is None) and (w is None or abs(r[c] - w) < 1e-6), (e, c, r, want)
    assert seen == {"sampled", "discontinuity", "no-data"}


def test_profile_and_enrichment(spark, tiles):
    attr = "struct<value:double,state:string,source:string,observed_at:string,method:string>"
    unknown, mapped = (None, "unknown", "none", None, None), (4.0, "reported", "osm", "2020", "tag")
    line = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    rows = [
        (1, 1, 2, "footway", line((10, 150), (40, 150)), 30.0, False, mapped, unknown, unknown),
        (2, 2, 3, "footway", line((40, 150), (80, 120)), 50.0, True, unknown, unknown, unknown),
        (3, 1, 3, "steps", line((10, 150), (80, 120)), 76.0, False, unknown, unknown, unknown),
        (4, 3, 4, "footway", line((80, 120), (120, 120)), 40.0, False, mapped, mapped, mapped),
        (5, 3, 5, "elevator", line((80, 120), (80, 122)), 3.0, True, unknown, unknown, unknown),
        (6, 6, 7, "footway", line((4000, 120), (4100, 120)), 100.0, False, mapped, unknown, unknown),
    ]
    edges = spark.createDataFrame(rows, f"edge int, src int, dst int, kind string, line array<struct<x:double,y:double>>, length_m double, off boolean, incline {attr}, incline_max {attr}, cross_slope {attr}")
    nodes = spark.createDataFrame([(i, float(x), float(y), (7.0, "reported", "osm", "2020", "tag")) for i, x, y in ((1, 10, 150), (2, 40, 150), (3, 80, 120), (4, 120, 120), (5, 80, 122), (6, 4000, 120), (7, 4100, 120))], f"node int, x double, y double, ele {attr}")
    dtm = terrain.blocks(spark.createDataFrame(tiles, TILES))
    out, high, checks = terrain.enrich(edges, nodes, dtm, "hill", "survey", "2024")
    got, ele = {r["edge"]: r for r in out.collect()}, {r["node"]: r["ele"] for r in high.collect()}
    assert out.columns == edges.columns and high.columns == nodes.columns
    assert [ele[i]["source"] for i in range(1, 8)] == ["survey", "survey", "survey", "survey", "osm", "osm", "osm"]
    assert ele[1]["value"] == math.floor(plain(tiles, 10, 150) * 100 + 0.5) / 100
    want = plain_slopes(tiles, [(10, 150), (40, 150)])
    assert got[1]["incline"]["value"] == math.floor(want[1] * 10 + 0.5) / 10 and got[1]["incline"]["state"] == "inferred" and got[1]["incline_max"]["value"] == math.floor(want[2] * 10 + 0.5) / 10
    assert got[2]["incline"]["value"] == math.floor((ele[3]["value"] - ele[2]["value"]) / 50 * 1000 + 0.5) / 10 and got[2]["incline"]["source"] == "derived"
    assert got[3]["incline"]["state"] == "unknown" and got[5]["incline"]["state"] == "unknown" and got[6]["incline"]["value"] == 4.0
    assert got[4]["incline"]["state"] == got[4]["cross_slope"]["state"] == "unknown" and "jump" in got[4]["incline"]["method"]
    assert [(r["edge"], r["mapped"]) for r in checks.collect()] == [(1, 4.0)]
    profile = terrain.profiles(edges.where("edge in (1, 2)"), dtm).orderBy("d").collect()
    assert {r["edge"] for r in profile} == {1} and [round(r["d"], 6) for r in profile] == list(range(31)) and all(abs(r["z"] - plain(tiles, 10 + r["d"], 150)) < 1e-9 for r in profile)
    flat = spark.range(30).select(F.lit(1).alias("e"), F.col("id").cast("double").alias("d"), (F.col("id") * 0.05).alias("z"))
    assert lines.slopes(flat, "e").first()["verdict"] == "sampled"


def test_a_point_makes_a_row_for_each_block_that_answers_for_it(spark):
    """Eight tiles meet in a cell of the plane, but only one holds the point; a point half a cell before a tile is its own, too."""
    tiles = [(i, i * 8.0, 8.0, 1.0, 8, 8, [float(i)] * 64) for i in range(8)]
    dtm = terrain.blocks(spark.createDataFrame(tiles, TILES))
    assert dtm.select("rank", "own_u", "own_v").distinct().count() == 8
    points = spark.createDataFrame([(1, 12.0, 4.0), (2, -0.25, 4.0), (3, -0.75, 4.0), (4, 3.0, 8.25)], "p int, x double, y double")
    found = terrain.heights(points, dtm, ["p"])
    assert {r["p"]: r["z"] for r in found.collect()} == {1: 1.0, 2: 0.0, 3: None, 4: 0.0}


def near(a, b):
    return a == b or (a is not None and b is not None and abs(a - b) < 1e-9)


def test_edges_not_their_samples_are_shuffled(spark, tiles, monkeypatch):
    """Crowded cells are dealt into parts, an edge crosses many cells, one has a place missing, one lies where no tile is."""
    monkeypatch.setattr(terrain, "EDGES_A_CELL", 3)
    made = [*ways(random.Random(5)), (200, [(-500.0, -500.0), (700.0, 650.0)]), (201, [(5.0, 150.0), (None, 150.0), (30.0, 170.0), (31.0, 170.0)]), (202, [(9000.0, 0.0), (9003.0, 0.0)])]
    edges = spark.createDataFrame([(e, [{"x": x, "y": y} for x, y in line]) for e, line in made], "edge int, line array<struct<x:double,y:double>>")
    dtm = terrain.blocks(spark.createDataFrame(tiles, TILES))
    got = {r["edge"]: r for r in terrain.edge_slopes(edges, dtm).collect()}
    assert got.keys() == {e for e, _ in made} and got[201]["verdict"] == got[202]["verdict"] == got[200]["verdict"] == "no-data"
    for e, line in made[:160]:
        want = plain_slopes(tiles, line)
        assert got[e]["verdict"] == want[0] and all(near(got[e][c], w) or abs(got[e][c] - w) < 1e-6 for c, w in zip(("mean", "steepest", "camber"), want[1:], strict=True)), (e, want)
    plan = terrain.edge_slopes(edges, dtm)._jdf.queryExecution().executedPlan().toString()
    # lines go to the cells, lists of samples back to the edges: no shuffle carries single points
    assert "FlatMapCoGroupsInArrow" in plan and not [x for x in plan.splitlines() if "Join" in x and "own_u" in x]


def test_profiles_shuffle_lines_alone(spark, tiles, monkeypatch):
    monkeypatch.setattr(terrain, "EDGES_A_CELL", 2)
    made = [*ways(random.Random(6)), (200, [(-500.0, -500.0), (700.0, 650.0)]), (201, [(5.0, 150.0), (None, 150.0), (30.0, 170.0)])]
    edges = spark.createDataFrame([(e, [{"x": x, "y": y} for x, y in line], e == 7) for e, line in made], "edge int, line array<struct<x:double,y:double>>, off boolean")
    dtm = terrain.blocks(spark.createDataFrame(tiles, TILES))
    points = edges.where("not off").select("edge", F.posexplode(lines.densify(F.col("line"))).alias("k", "p")).select("edge", "k", "p.d", "p.x", "p.y")
    want = {(r["edge"], r["k"]): r for r in terrain.heights(points, dtm, ["edge", "k", "d"]).collect()}
    profile = terrain.profiles(edges, dtm)
    found = profile.collect()
    assert len(found) == len(want) and all(near(r["d"], want[r["edge"], r["k"]]["d"]) and near(r["z"], want[r["edge"], r["k"]]["z"]) for r in found)
    assert "hashpartitioning(edge" not in profile._jdf.queryExecution().executedPlan().toString()
