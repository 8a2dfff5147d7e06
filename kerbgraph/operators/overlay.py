"""Lines against polygons, lines and grid squares, on a plane in metres: sampled matches and exact shares of length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C

#: Metres: between samples and clear of a line's ends, how near a polygon counts, and beside a road, the cells of the index.
STEP_M, CLEAR_M, NEAR_M, SIDE_M, CELL_M = 5.0, 5.0, 3.0, 15.0, 50.0
#: Gritting: metres to a route from a road's middle and from beside it, the cosine of 30 degrees, what share of samples must be near.
CENTRE_M, BESIDE_M, PARALLEL, SHARE = 6.0, 12.0, 0.8660254037844387, 0.6
#: Widths outside these metres are not a pavement's.
LEAST_WIDTH_M, MOST_WIDTH_M = 0.6, 10.0
# Kinds that are gritted, and kinds whose line is the road's middle.
GRITTED = ("footway", "sidewalk", "pedestrian", "ramp", "street_proxy")
MIDDLE = ("street_proxy", "pedestrian")


def legs(line: Column) -> Column:
    """Legs (x, y, u, v, len, at) of a line of (x, y): where each begins, its direction, its length and the metres before it; none of length 0."""
    n = F.greatest(F.size(line) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(line, F.lit(1), n), F.slice(line, F.lit(2), n), lambda a, b: F.struct(a["x"].alias("x"), a["y"].alias("y"), (b["x"] - a["x"]).alias("u"), (b["y"] - a["y"]).alias("v"), F.hypot(b["x"] - a["x"], b["y"] - a["y"]).alias("len")))
    real = F.filter(pairs, lambda g: g["len"] > 0)
    before = lambda i: F.aggregate(F.slice(real, F.lit(1), i), F.lit(0.0), lambda s, g: s + g["len"])
    return F.transform(real, lambda g, i: F.struct(g["x"].alias("x"), g["y"].alias("y"), (g["u"] / g["len"]).alias("u"), (g["v"] / g["len"]).alias("v"), g["len"].alias("len"), before(i).alias("at")))


def samples(legs_: Column) -> Column:
    """Points (x, y, u, v) every 5 m along a line's legs, 5 m clear of its ends; the middle alone of a line too short for that."""
    total = F.aggregate(legs_, F.lit(0.0), lambda s, g: s + g["len"])
    last = F.get(legs_, F.size(legs_) - 1)

    def point(d: Column) -> Column:
        leg = F.coalesce(F.get(F.filter(legs_, lambda g: d <= g["at"] + g["len"]), F.lit(0)), last)
        t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (d - leg["at"]) / leg["len"])) * leg["len"]
        return F.struct((leg["x"] + t * leg["u"]).alias("x"), (leg["y"] + t * leg["v"]).alias("y"), leg["u"].alias("u"), leg["v"].alias("v"))

    n = F.floor((total - 2 * CLEAR_M + 1e-9) / STEP_M).cast("int")
    places = F.when(total < 2 * CLEAR_M + STEP_M, F.array(total / 2)).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda i: i * STEP_M + CLEAR_M))
    return F.when(F.size(legs_) > 0, F.transform(places, point))


def _sampled(edges: DataFrame, reach: Column) -> DataFrame:
    """(edge, kind, n, i, x, y, u, v, reach, cx, cy): an edge's samples in every cell that lies within reach of one."""
    # legs and samples are made once: an expression inside a lambda would be made anew for every point
    rows = edges.select("edge", "kind", legs(F.col("line")).alias("legs")).select("edge", "kind", samples(F.col("legs")).alias("s")).where("s is not null")
    rows = rows.select("edge", "kind", F.size("s").alias("n"), F.posexplode("s").alias("i", "p")).select("edge", "kind", "n", "i", "p.*").withColumn("reach", reach)
    cell = lambda c: F.explode(F.sequence(F.floor((F.col(c) - F.col("reach")) / CELL_M), F.floor((F.col(c) + F.col("reach")) / CELL_M)))
    return rows.withColumn("cx", cell("x")).withColumn("cy", cell("y"))


def _cells(df: DataFrame, x0: Column, x1: Column, y0: Column, y1: Column) -> DataFrame:
    span = lambda a, b: F.explode(F.sequence(F.floor(a / CELL_M), F.floor(b / CELL_M)))
    return df.withColumn("cx", span(x0, x1)).withColumn("cy", span(y0, y1))


def _ring_pairs(ring: Column) -> Column:
    """Each point of a ring with the one before it, the last before the first."""
    before = F.concat(F.slice(ring, F.size(ring), 1), F.slice(ring, F.lit(1), F.greatest(F.size(ring) - 1, F.lit(0))))
    return F.zip_with(ring, before, lambda a, b: F.struct(a["x"].alias("x"), a["y"].alias("y"), (b["x"] - a["x"]).alias("u"), (b["y"] - a["y"]).alias("v")))


def polygon_distance(x: Column, y: Column, sides: Column) -> Column:
    """Metres to a polygon, 0 inside (even-odd over all rings); sides: its rings' sides (x, y, u, v) as one array."""
    crossed = F.size(F.filter(sides, lambda s: ((s["y"] > y) != (s["y"] + s["v"] > y)) & (x < s["u"] * (y - s["y"]) / F.nullif(s["v"], F.lit(0.0)) + s["x"])))
    square = lambda s: s["u"] * s["u"] + s["v"] * s["v"]
    share = lambda s: F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - s["x"]) * s["u"] + (y - s["y"]) * s["v"]) / F.nullif(square(s), F.lit(0.0)))), F.lit(0.0))
    near = F.array_min(F.transform(sides, lambda s: F.hypot(s["x"] + share(s) * s["u"] - x, s["y"] + share(s) * s["v"] - y)))
    return F.when(crossed % 2 == 1, 0.0).otherwise(near)


def footways(edges: DataFrame, polygons: DataFrame) -> DataFrame:
    """(edge, surface, width): what the pavement polygons along an edge say of it. edges: (edge, kind, line of (x, y)); polygons: (polygon, surface, width, rings
    of (x, y)), surfaces in our words.

    Every sample takes the nearest polygon within 3 m, a road's the nearest on each side within 15 m, of equally near ones the least. Nothing is said unless half of the samples
    found one. Surface: cobbles or setts on a quarter, else the commonest if it is half of those known, null unless half are known. Width: the lowest fifth of
    usable ones, if half of the polygons have one. Edges without either have no row.
    """
    polygons = polygons.withColumn("sides", F.flatten(F.transform("rings", _ring_pairs)))
    xs, ys = F.transform("sides", lambda s: s["x"]), F.transform("sides", lambda s: s["y"])
    stored = _cells(polygons, F.array_min(xs), F.array_max(xs), F.array_min(ys), F.array_max(ys))
    road = F.col("kind") == "street_proxy"
    asked = _sampled(edges, F.when(road, SIDE_M).otherwise(NEAR_M))
    near = asked.join(stored, ["cx", "cy"]).withColumn("d", polygon_distance(F.col("x"), F.col("y"), F.col("sides"))).where("d <= reach")
    closest = F.array_min(F.transform("sides", lambda s: F.struct(F.hypot(s["x"] - F.col("x"), s["y"] - F.col("y")).alias("d"), (F.col("u") * (s["y"] - F.col("y")) - F.col("v") * (s["x"] - F.col("x"))).alias("turn"))))
    near = near.withColumn("side", F.when(road & (closest["turn"] < 0), -1).otherwise(1))
    hit = near.groupBy("edge", "n", "i", "side").agg(F.min_by(F.struct("surface", "width"), F.struct("d", "polygon")).alias("h")).select("edge", "n", "i", "side", "h.*")
    usable = F.when((F.col("width") >= LEAST_WIDTH_M) & (F.col("width") <= MOST_WIDTH_M), F.col("width"))
    order = F.struct("i", -F.col("side"))
    per = hit.groupBy("edge", "n").agg(F.countDistinct("i").alias("found"), F.count("*").alias("hits"), F.count("surface").alias("known"), F.array_sort(F.collect_list(usable)).alias("widths"))
    counts = hit.where("surface is not null").groupBy("edge", "surface").agg(F.count("*").alias("m"), F.min(order).alias("first"))
    votes = counts.groupBy("edge").agg(F.sum(F.when(F.col("surface") == "cobblestone", F.col("m"))).alias("cobbles"), F.sum(F.when(F.col("surface") == "sett", F.col("m"))).alias("setts"), F.min_by(F.struct("surface", "m"), F.struct(-F.col("m"), "first")).alias("top"))
    both = per.join(votes, "edge", "left").where("found >= n / 2")
    known = F.col("known")
    picked = F.when((known == 0) | (known < F.col("hits") / 2), None).when(F.col("cobbles") >= known / 4, "cobblestone").when(F.col("setts") >= known / 4, "sett").when(F.col("top.m") >= known / 2, F.col("top.surface"))
    n = F.size("widths")
    width = F.when((n > 0) & (n >= F.col("hits") / 2), C.js_round(F.get("widths", F.floor((n - 1) * 0.2).cast("int")) * 10) / 10)
    return both.select("edge", picked.alias("surface"), width.alias("width")).where("surface is not null or width is not null")


def gritted(edges: DataFrame, routes: DataFrame) -> DataFrame:
    """(edge): edges on a gritting route: of the kinds that are gritted, with 60 % of their samples near a route's leg that runs within 30 degrees of theirs, either way; within 6 m
    for lines in a road's middle, 12 m for others. routes: (line of (x, y))."""
    leg = routes.select(F.explode(legs(F.col("line"))).alias("g")).select(F.col("g.x").alias("ax"), F.col("g.y").alias("ay"), F.col("g.u").alias("au"), F.col("g.v").alias("av"), F.col("g.len").alias("long"))
    ends = [F.col(a) + F.col(b) * F.col("long") for a, b in (("ax", "au"), ("ay", "av"))]
    stored = _cells(leg, F.least("ax", ends[0]), F.greatest("ax", ends[0]), F.least("ay", ends[1]), F.greatest("ay", ends[1]))
    asked = _sampled(edges.where(F.col("kind").isin(*GRITTED)), F.when(F.col("kind").isin(*MIDDLE), CENTRE_M).otherwise(BESIDE_M))
    t = F.least(F.greatest(F.lit(0.0), (F.col("x") - F.col("ax")) * F.col("au") + (F.col("y") - F.col("ay")) * F.col("av")), F.col("long"))
    near = F.hypot(F.col("ax") + t * F.col("au") - F.col("x"), F.col("ay") + t * F.col("av") - F.col("y")) <= F.col("reach")
    along = F.abs(F.col("u") * F.col("au") + F.col("v") * F.col("av")) >= PARALLEL
    return asked.join(stored, ["cx", "cy"]).where(along & near).groupBy("edge", "n").agg(F.countDistinct("i").alias("m")).where(F.col("m") >= F.col("n") * SHARE).select("edge")


def square_letters(e: Column, n: Column) -> Column:
    """The two letters of the 100 km square of an easting and northing; I is not a letter."""
    e100, n100 = F.floor(e / 100_000), F.floor(n / 100_000)
    down = 19 - n100
    letter = lambda i: F.chr((i + F.when(i > 7, 66).otherwise(65)).cast("int"))
    return F.concat(letter(down - F.pmod(down, F.lit(5)) + F.floor((e100 + 10) / 5)), letter(F.pmod(down * 5, F.lit(25)) + F.pmod(e100, F.lit(5))))


def square(e: Column, n: Column, digits: int = 2) -> Column:
    """A grid reference of so many digits each way: two make a 1 km square, NT2573."""
    unit = 10 ** (5 - digits)
    part = lambda v: F.lpad(F.floor(F.pmod(v, F.lit(100_000)) / unit).cast("string"), digits, "0")
    return F.concat(square_letters(e, n), part(e), part(n))


def quadrant(e: Column, n: Column) -> Column:
    """A 5 km quadrant, NT27SE."""
    return F.concat(square(e, n, 1), F.when(F.pmod(n, F.lit(10_000)) >= 5000, "N").otherwise("S"), F.when(F.pmod(e, F.lit(10_000)) >= 5000, "E").otherwise("W"))


def pieces(lines: DataFrame, side: float = 1000.0) -> DataFrame:
    """lines (with `line` of (x, y)) as pieces (col, row, metres): each leg cut where it crosses a border of the squares, so that the pieces of a line add up to its
    length. A piece on a border belongs to the square above or to the right."""
    keep = [c for c in lines.columns if c != "line"]
    rows = lines.select(*keep, F.explode(legs(F.col("line"))).alias("g")).select(*keep, "g.*")

    def cuts(start: str, step: str) -> Column:
        a, b = F.col(start), F.col(start) + F.col(step) * F.col("len")
        borders = F.sequence(F.floor(F.least(a, b) / side) + 1, F.greatest(F.floor(F.least(a, b) / side) + 1, F.ceil(F.greatest(a, b) / side) - 1))
        inner = F.filter(borders, lambda k: (k * side > F.least(a, b)) & (k * side < F.greatest(a, b)))
        return F.transform(inner, lambda k: (k * side - a) / F.nullif(F.col(step), F.lit(0.0)))

    at = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.col("len")), cuts("x", "u"), cuts("y", "v"))))
    rows = rows.withColumn("cut", at)
    parts = F.explode(F.zip_with(F.slice("cut", F.lit(1), F.size("cut") - 1), F.slice("cut", F.lit(2), F.size("cut") - 1), lambda a, b: F.struct(((a + b) / 2).alias("mid"), (b - a).alias("metres"))))
    rows = rows.select(*keep, "x", "y", "u", "v", parts.alias("p"))
    cell = lambda s, d: F.floor((F.col(s) + F.col(d) * F.col("p.mid")) / side)
    return rows.select(*keep, cell("x", "u").alias("col"), cell("y", "v").alias("row"), F.col("p.metres").alias("metres"))


def coverage(lines: DataFrame, side: float = 1000.0) -> DataFrame:
    """(square, metres, known_m, share) by square of the national grid, from lines (line, known): how many metres there are and of how many something is known."""
    found = pieces(lines.select("line", "known"), side)
    sums = found.groupBy("col", "row").agg(F.sum("metres").alias("metres"), F.coalesce(F.sum(F.when(F.col("known"), F.col("metres"))), F.lit(0.0)).alias("known_m"))
    return sums.select(square(F.col("col") * side, F.col("row") * side).alias("square"), "metres", "known_m", (F.col("known_m") / F.col("metres")).alias("share"))
