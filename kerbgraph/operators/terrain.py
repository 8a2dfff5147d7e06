"""Heights from rows of raster tiles: blocks of them, heights of points, profiles, slopes and camber of edges, heights of nodes.

Tiles are rows (rank, x0, y0, res, width, height, z): the north-west corner and the size of a cell in metres, and the cells row by row from the north. Of tiles
that overlap the one with the least rank that has data wins, so ranks differ. Tiles need share neither origin nor resolution.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import columns as C
from ..sources.scratch import written
from . import lines
from .streets import told

#: Cells along a block's side, and metres along the cells that points and blocks meet in.
SIDE, CELL_M = 64, 64.0
#: Edges of a task, about: each makes many samples, so their few bytes would be dealt to too few tasks.
EDGES_A_TASK = 20_000
#: Edges of a cell that are sampled together; those of a cell with more are dealt into parts.
EDGES_A_CELL = 4096
#: Samples by the place they are for; metres that they lie off the legs of an edge at most.
PARTS, OFF_M = ("line", "beside", "ends"), 6.0
#: Heights below are no data.
LOWEST = -100.0
#: Metres: edges shorter than the baseline they are measured on, how far beside the line camber is taken, what no camber rises there, edges too short to change.
SHORT_M, BESIDE_M, WALL_M, LEAST_M = 5.0, 1.0, 0.5, 0.5
#: An edge between two known heights off the ground is interpolated if longer.
SPAN_M = 2.0


def blocks(tiles: DataFrame, side: int = SIDE, nodata: float | None = None) -> DataFrame:
    """Tiles cut into blocks of `side` cells that also hold the next row and column, so that every point finds what it lies between in one block, by
    cell (cx, cy) of the plane; a tile's first blocks also answer for the half cell before it. Cells without data (not finite, `nodata` or below -100 m) are null."""
    good = lambda v: F.when(~F.isnan(v) & (F.abs(v) < float("inf")) & (v >= LOWEST) & (F.lit(True) if nodata is None else v != nodata), v)
    last = lambda n: F.floor((F.col(n) - 1) / side).cast("int")
    lo = lambda i: F.greatest(F.lit(0), i * side)
    hi = lambda i, n: F.least(F.col(n) - 1, i * side + side)

    def block(i: Column, j: Column) -> Column:
        row = lambda v: F.transform(F.slice("z", v * F.col("width") + lo(i) + 1, hi(i, "width") - lo(i) + 1), good)
        rows = F.flatten(F.transform(F.sequence(lo(j), hi(j, "height")), row))
        first = lambda i: F.when(i == 0, -1).otherwise(i * side)
        return F.struct(first(i).alias("own_u"), first(j).alias("own_v"), (i * side + side).alias("to_u"), (j * side + side).alias("to_v"), lo(i).alias("left"), lo(j).alias("top"), (hi(i, "width") - lo(i) + 1).alias("wide"), (hi(j, "height") - lo(j) + 1).alias("high"), rows.alias("z"))

    each = F.transform(F.sequence(F.lit(0), last("width")), lambda i: F.transform(F.sequence(F.lit(0), last("height")), lambda j: block(i, j)))
    cut = tiles.where("width > 0 and height > 0").select("rank", "x0", "y0", "res", F.col("width").alias("across"), F.col("height").alias("down"), F.inline(F.flatten(each)))
    # what a block answers for reaches half a cell beyond its tile
    west, east = F.col("own_u") + 0.5, F.least("to_u", "across") + 0.5
    north, south = F.col("own_v") + 0.5, F.least("to_v", "down") + 0.5
    cells = lambda a, b: F.explode(F.sequence(F.floor(a / CELL_M), F.floor(b / CELL_M)))
    cut = cut.withColumn("cx", cells(F.col("x0") + west * F.col("res"), F.col("x0") + east * F.col("res")))
    return cut.withColumn("cy", cells(F.col("y0") - south * F.col("res"), F.col("y0") - north * F.col("res"))).drop("across", "down")


def heights(points: DataFrame, dtm: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, z) of points (keys, x, y) by `blocks`: bilinear between the four nearest cells; where one of them has no data, the first that has any (north-west,
    north-east, south-west, south-east); null if none has. Rows alike in `keys` come once. Points without a place have no height."""
    at = points.withColumn("cx", F.floor(F.col("x") / CELL_M)).withColumn("cy", F.floor(F.col("y") / CELL_M))
    fx, fy = (F.col("x") - F.col("x0")) / F.col("res") - 0.5, (F.col("y0") - F.col("y")) / F.col("res") - 0.5
    # a cell meets more blocks than answer for a point: the join itself leaves those out, so that a point makes a row for each that does
    u, v = F.floor(fx), F.floor(fy)
    own = (u >= F.col("own_u")) & (u < F.col("to_u")) & (v >= F.col("own_v")) & (v < F.col("to_v"))
    here = dtm.withColumnsRenamed({"cx": "__cx", "cy": "__cy"})
    found = at.join(here, (F.col("cx") == F.col("__cx")) & (F.col("cy") == F.col("__cy")) & own, "left")
    found = found.withColumn("fx", fx).withColumn("fy", fy).withColumn("u", F.floor("fx").cast("int")).withColumn("v", F.floor("fy").cast("int"))
    column, line = F.col("u") - F.col("left"), F.col("v") - F.col("top")
    inside = lambda p, q: p.between(0, F.col("wide") - 1) & q.between(0, F.col("high") - 1)
    cell = lambda p, q: F.when(inside(p, q), F.get("z", q * F.col("wide") + p))
    found = found.select(*keys, "rank", (F.col("fx") - F.col("u")).alias("tx"), (F.col("fy") - F.col("v")).alias("ty"), cell(column, line).alias("a"), cell(column + 1, line).alias("b"), cell(column, line + 1).alias("c"), cell(column + 1, line + 1).alias("d4"))
    tx, ty, one = F.col("tx"), F.col("ty"), F.lit(1.0)
    between = F.col("a") * (one - tx) * (one - ty) + F.col("b") * tx * (one - ty) + F.col("c") * (one - tx) * ty + F.col("d4") * tx * ty
    found = found.select(*keys, "rank", F.coalesce(between, "a", "b", "c", "d4").alias("z"))
    return found.groupBy(*keys).agg(F.min_by("z", F.when(F.col("z").isNotNull(), F.col("rank"))).alias("z"))


def _parts(edges: DataFrame) -> int:
    """The number of parts that edges are dealt into: it grows with them."""
    return max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), edges.count() // EDGES_A_TASK)


def _line_points(line: pa.Array) -> tuple[np.ndarray, ...]:
    """(row, k, d, x, y) of the points every metre or less along lines of (x, y), two points or more each, as lines.densify makes them."""
    size = pc.list_value_length(line).to_numpy(zero_copy_only=False)
    values = line.flatten()
    x, y = (pc.struct_field(values, c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in "xy")
    end = np.cumsum(size) - 1
    a = np.delete(np.arange(len(x)), end)
    row = np.repeat(np.arange(len(size)), size - 1)
    dx, dy = x[a + 1] - x[a], y[a + 1] - y[a]
    far = np.hypot(dx, dy)
    # the distance before a leg is summed in the order of the legs
    nth = np.arange(len(a)) - np.repeat(np.cumsum(size - 1) - (size - 1), size - 1)
    before, order = np.zeros(len(a)), np.argsort(nth, kind="stable")
    cuts = np.searchsorted(nth[order], np.arange(1, nth.max(initial=0) + 2))
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        at = order[lo:hi]
        before[at] = before[at - 1] + far[at - 1]
    parts = np.where(np.isnan(far), 1, np.maximum(1, np.ceil(np.nan_to_num(far) / lines.STEP_M))).astype(np.int64)
    leg = np.repeat(np.arange(len(a)), parts)
    s, n = np.arange(len(leg)) - np.repeat(np.cumsum(parts) - parts, parts), parts[leg]
    # a line's end comes after the points of its legs
    many = np.bincount(row[leg], minlength=len(size)) + 1
    place = np.delete(np.arange(many.sum()), np.cumsum(many) - 1)
    out = []
    last = np.cumsum(size - 1) - 1
    for inner, ends in ((before[leg] + far[leg] * s / n, before[last] + far[last]), (x[a][leg] + dx[leg] * s / n, x[end]), (y[a][leg] + dy[leg] * s / n, y[end])):
        all_ = np.empty(many.sum())
        all_[place], all_[np.cumsum(many) - 1] = inner, ends
        out.append(all_)
    k = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    return np.repeat(np.arange(len(size)), many), k, *out


def _slope_points(line: pa.Array) -> tuple[np.ndarray, ...]:
    """(row, part, k, d, x, y): the line every metre, points to both sides of every other one, and the ends of the baseline of short edges. part is a number in PARTS."""
    row, k, d, x, y = _line_points(line)
    n = np.bincount(row, minlength=len(line))
    first, last = np.cumsum(n) - n, np.cumsum(n) - 1
    mid = np.flatnonzero((k % 2 == 1) & (k <= n[row] - 2))
    dx, dy = x[mid + 1] - x[mid - 1], y[mid + 1] - y[mid - 1]
    far = np.hypot(dx, dy)
    mid, dx, dy, far = (v[far > 0] for v in (mid, dx, dy, far))
    nx, ny = -dy / far * BESIDE_M, dx / far * BESIDE_M
    sides = [(row[mid], np.full(len(mid), 1), k[mid] * 2 + i, d[mid], x[mid] + s * nx, y[mid] + s * ny) for i, s in enumerate((1, -1))]
    dx, dy = x[last] - x[first], y[last] - y[first]
    far = np.hypot(dx, dy)
    short = np.flatnonzero((d[last] < SHORT_M) & (far >= 0.2))
    f, e, dx, dy, far = first[short], last[short], dx[short], dy[short], far[short]
    ends = [(short, np.full(len(f), 2), np.full(len(f), i), np.full(len(f), float(i)), (x[f] + x[e]) / 2 + dx / far * s * SHORT_M / 2, (y[f] + y[e]) / 2 + dy / far * s * SHORT_M / 2) for i, s in enumerate((-1, 1))]
    return tuple(np.concatenate(v) for v in zip((row, np.zeros(len(row), int), k, d, x, y), *sides, *ends, strict=True))


def _bilinear(blocks: pa.Table, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Heights of points by the blocks of their cell, as `heights` finds them: the first block by rank that has one; nan if none has."""
    z = np.full(len(x), np.nan)
    order = np.argsort(blocks["rank"].to_numpy(), kind="stable")
    grids = blocks["z"].combine_chunks()
    told = {c: blocks[c].to_numpy() for c in ("x0", "y0", "res", "own_u", "own_v", "to_u", "to_v", "left", "top", "wide", "high")}
    open_ = np.flatnonzero(~np.isnan(x) & ~np.isnan(y))
    for nth in order:
        b = {c: v[nth] for c, v in told.items()}
        fx, fy = (x[open_] - b["x0"]) / b["res"] - 0.5, (b["y0"] - y[open_]) / b["res"] - 0.5
        u, v = np.floor(fx), np.floor(fy)
        own = (u >= b["own_u"]) & (u < b["to_u"]) & (v >= b["own_v"]) & (v < b["to_v"])
        if not own.any():
            continue
        at, u, v, fx, fy = open_[own], u[own].astype(np.int64), v[own].astype(np.int64), fx[own], fy[own]
        grid = grids[int(nth)].values.to_numpy(zero_copy_only=False).reshape(b["high"], b["wide"])
        # a frame of cells without data, so that what lies beyond the block has none
        framed = np.pad(grid, 1, constant_values=np.nan)
        west, east = (np.clip(u - b["left"] + i, 0, b["wide"] + 1) for i in (1, 2))
        north, south = (np.clip(v - b["top"] + i, 0, b["high"] + 1) for i in (1, 2))
        tx, ty = fx - u, fy - v
        a, e, c, d = framed[north, west], framed[north, east], framed[south, west], framed[south, east]
        found = a * (1 - tx) * (1 - ty) + e * tx * (1 - ty) + c * (1 - tx) * ty + d * tx * ty
        for other in (a, e, c, d):
            found = np.where(np.isnan(found), other, found)
        z[at] = found
        open_ = open_[np.isnan(z[open_])]
        if not len(open_):
            break
    return z


def _sampled(edges: DataFrame, dtm: DataFrame, points: Callable[[pa.Array], tuple[np.ndarray, ...]], off: float, parts: int) -> DataFrame:
    """(edge, part, samples of (k, d, z)) of edges (edge, line) at `points` of their lines, which lie no further than `off` from the legs: a row for each cell that an edge comes
    to and each part of its points.

    Edges, not their points, meet the blocks: an edge goes to the cells that its legs come near, and makes its points there; each cell keeps its own. Only blocks of cells
    with edges are sent; edges of a crowded cell are dealt into parts.
    """
    n = F.size("line")
    told = lambda p, c: F.when(~F.isnan(p[c]), p[c])
    box = lambda a, b, c, end, s: F.floor((end(told(a, c), told(b, c)) + s * off) / CELL_M)
    span = lambda a, b, c: F.sequence(box(a, b, c, F.least, -1), box(a, b, c, F.greatest, 1))
    of_leg = lambda a, b: F.flatten(F.transform(span(a, b, "x"), lambda cx: F.transform(span(a, b, "y"), lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))))
    lost = F.exists("line", lambda p: told(p, "x").isNull() | told(p, "y").isNull())
    nowhere = F.array(F.struct(F.lit(None).cast("long").alias("cx"), F.lit(None).cast("long").alias("cy")))
    legs = F.filter(F.zip_with(F.slice("line", F.lit(1), n - 1), F.slice("line", F.lit(2), n - 1), of_leg), lambda cells: cells.isNotNull())
    cells = F.concat(F.array_distinct(F.flatten(legs)), F.when(lost, nowhere).otherwise(F.slice(nowhere, 1, 0)))
    pieces = edges.select("edge", "line", F.inline(cells))
    crowd = written(pieces.groupBy("cx", "cy").agg(F.ceil(F.count("*") / EDGES_A_CELL).cast("int").alias("parts")), "cells")
    keys = ["cx", "cy", "part"]
    pieces = pieces.join(crowd, (pieces["cx"] == crowd["cx"]) & (pieces["cy"] == crowd["cy"]), "left").select("edge", "line", pieces["cx"], pieces["cy"], F.pmod(F.xxhash64("edge"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"))
    here = dtm.join(crowd, ["cx", "cy"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    def run(some: pa.Table, blocks: pa.Table) -> pa.Table:
        if not len(some):
            return schema.empty_table()
        row, part, k, d, x, y = points(some["line"].combine_chunks())
        cx, cy = some["cx"][0].as_py(), some["cy"][0].as_py()
        mine = np.isnan(x) | np.isnan(y) if cx is None else (np.floor(x / CELL_M) == cx) & (np.floor(y / CELL_M) == cy)
        row, part, k, d, x, y = (v[mine] for v in (row, part, k, d, x, y))
        z = _bilinear(blocks, x, y) if len(blocks) else np.full(len(x), np.nan)
        order = np.lexsort((k, part, row))
        row, part, k, d, z = (v[order] for v in (row, part, k, d, z))
        new = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(part, prepend=-1) != 0))
        samples = pa.StructArray.from_arrays([pa.array(k.astype(np.int32)), pa.array(d, from_pandas=True), pa.array(z, from_pandas=True)], ["k", "d", "z"])
        lists = pa.ListArray.from_arrays(pa.array(np.append(new, len(row)).astype(np.int32)), samples)
        edge = some["edge"].combine_chunks().take(pa.array(row[new]))
        return pa.table([edge, pa.array(np.array(PARTS)[part[new]]) if len(new) else pa.array([], pa.string()), lists.cast(schema.field("samples").type)], schema=schema)

    kind = edges.select("edge").schema[0].dataType
    out = f"edge {kind.simpleString()}, part string, samples array<struct<k:int,d:double,z:double>>"
    schema = pa.schema([("edge", to_arrow_type(kind)), ("part", pa.string()), ("samples", pa.list_(pa.struct([("k", pa.int32()), ("d", pa.float64()), ("z", pa.float64())])))])
    dealt = lambda df: df.repartition(parts, *keys).groupBy(*keys)
    return dealt(pieces).cogroup(dealt(here)).applyInArrow(run, out)


def profiles(edges: DataFrame, dtm: DataFrame) -> DataFrame:
    """(edge, k, d, z) every metre along edges (edge, line of (x, y), off) that lie on the ground."""
    edges = edges.where(~F.col("off") & (F.size("line") > 1)).select("edge", "line")

    def points(line: pa.Array) -> tuple[np.ndarray, ...]:
        row, *rest = _line_points(line)
        return row, np.zeros(len(row), int), *rest

    return _sampled(edges, dtm, points, 0.001, _parts(edges)).select("edge", F.inline("samples"))


def edge_slopes(edges: DataFrame, dtm: DataFrame) -> DataFrame:
    """(edge, verdict, mean, steepest, camber, short) in per cent of edges (edge, line of (x, y)).

    verdict: no-data if a height is missing, discontinuity where the heights are a wall's or a cutting's, else sampled; without sampled nothing else is told. An
    edge of less than 5 m is measured over 5 m about its middle. camber: of the differences across every other metre, those of more than half a metre left out,
    the one that three quarters don't reach; null if more were left out than kept. A single-point line has no row.
    """
    edges = edges.where(F.size("line") > 1).select("edge", "line")
    parts = _parts(edges)
    found = _sampled(edges, dtm, _slope_points, OFF_M, parts).repartition(parts, "edge").select("edge", "part", F.inline("samples"))
    listed = F.sort_array(F.collect_list(F.when(F.col("part") != "line", F.struct("k", "z")))).alias("listed")
    told_parts = lines.slope_parts(found, ["edge", "part"], listed)
    of = lambda part, c: F.max(F.when(F.col("part") == part, F.col(c))).alias(c)
    zs = lambda part: F.max(F.when(F.col("part") == part, F.transform("listed", lambda s: s["z"])))
    rows = told_parts.groupBy("edge").agg(*[of("line", c) for c in ("length", "gap", "jump", "mean", "steepest")], zs("ends").alias("ends"), zs("beside").alias("beside"))
    short = F.col("length") < SHORT_M
    base = (F.get("ends", F.lit(1)) - F.get("ends", F.lit(0))) / SHORT_M * 100
    rows = rows.withColumn("mean", F.when(short, base).otherwise(F.col("mean"))).withColumn("steepest", F.when(short, base).otherwise(F.col("steepest")))
    wild = (F.abs("steepest") > lines.IMPLAUSIBLE) | (F.abs("mean") > lines.IMPLAUSIBLE)
    verdict = F.when(F.col("gap"), "no-data").when(F.col("jump"), "discontinuity").when(F.col("mean").isNull(), "no-data").when(wild, "discontinuity").otherwise("sampled")
    pairs = F.filter(F.transform(F.sequence(F.lit(0), F.floor(F.size("beside") / 2).cast("int") - 1), lambda i: F.abs(F.get("beside", i * 2) - F.get("beside", i * 2 + 1))), lambda x: x.isNotNull())
    rows = rows.withColumn("verdict", verdict).withColumn("across", F.when(F.size("beside") >= 2, pairs))
    kept = F.sort_array(F.filter("across", lambda x: x <= WALL_M))
    rows = rows.withColumn("kept", kept)
    camber = F.when((F.size("kept") > 0) & (F.size("across") <= 2 * F.size("kept")), F.get("kept", F.floor(F.size("kept") * 0.75).cast("int")) / (2 * BESIDE_M) * 100)
    told_if = lambda c: F.when(F.col("verdict") == "sampled", c)
    return rows.select("edge", "verdict", *[told_if(c).alias(n) for n, c in (("mean", F.col("mean")), ("steepest", F.col("steepest")), ("camber", camber), ("short", short))])


def _round(x: Column, digits: int) -> Column:
    return C.js_round(x * 10**digits) / 10**digits


def node_heights(nodes: DataFrame, edges: DataFrame, dtm: DataFrame, method: str, source: str, at: str) -> DataFrame:
    """nodes (node, x, y, ele, ...) with the terrain's height where an edge on the ground that isn't steps ends (the top of a stair from a bridge isn't ground);
    others keep theirs. edges: (src, dst, kind, off)."""
    ground = edges.where(~F.col("off") & (F.col("kind") != "steps")).select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    z = heights(nodes.join(ground, "node", "left_semi").select("node", "x", "y"), dtm, ["node"]).where("z is not null")
    new = told(_round(F.col("z"), 2), method, F.lit(at), "inferred", source)
    return nodes.join(z, "node", "left").withColumn("ele", F.when(F.col("z").isNotNull(), new).otherwise(F.col("ele"))).drop("z")


def enrich(edges: DataFrame, nodes: DataFrame, dtm: DataFrame, label: str, source: str, at: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """edges with incline, incline_max and cross_slope by the terrain, nodes with their heights, and (edge, mapped, mean, steepest, length_m) of sampled edges
    whose slope was mapped.

    edges: (edge, src, dst, kind, line of (x, y), length_m, off, incline, incline_max, cross_slope), attributes as operators.streets makes them; nodes: (node, x,
    y, ele). Edges on the ground take what was sampled, or unknown at a discontinuity; steps and edges without data or of less than half a metre keep theirs. Edges
    off the ground that aren't lifts or stairs are interpolated between known ends if nothing is known of them.
    """
    edges_ = edges.withColumn("__steps", F.col("kind").isin("elevator", "steps", "escalator"))
    high = node_heights(nodes, edges, dtm, label, source, at)
    ground = edges.where(~F.col("off") & (F.col("kind") != "steps") & (F.col("length_m") >= LEAST_M))
    slopes = edge_slopes(ground, dtm)
    end = lambda n: high.select(F.col("node").alias(n), F.col("ele.value").alias(f"__{n}"))
    rows = edges_.join(slopes, "edge", "left").join(end("src"), "src", "left").join(end("dst"), "dst", "left")
    when = F.lit(at)
    grade = (F.col("__dst") - F.col("__src")) / F.nullif("length_m", F.lit(0.0)) * 100
    spans = F.coalesce(F.col("off") & ~F.col("__steps") & (F.col("length_m") > SPAN_M) & (F.col("incline.state") == "unknown") & (F.abs(grade) <= lines.IMPLAUSIBLE), F.lit(False))
    said = F.when(F.col("short"), f"{label}, short edge: {SHORT_M:g} m centred baseline").otherwise(label)
    broken = F.lit(None).cast("double")
    none = F.struct(broken.alias("value"), F.lit("unknown").alias("state"), F.lit("none").alias("source"), F.lit(None).cast("string").alias("observed_at"), F.lit(f"{label}: heights jump (wall, structure or unmapped bridge); needs survey").alias("method"))
    unsure = none.withField("method", F.lit(f"{label}: camber samples hit walls or kerbs"))
    sampled, jump = F.col("verdict") == "sampled", F.col("verdict") == "discontinuity"
    by = lambda value, how: told(_round(value, 1), how, when, "inferred", source)
    between = lambda how: told(_round(grade, 1), how, when, "inferred", "derived")
    out = rows.withColumns({
        "incline": F.when(sampled, by(F.col("mean"), said)).when(jump, none).when(spans, between("between the heights of both ends")).otherwise(F.col("incline")),
        "incline_max": F.when(sampled, by(F.col("steepest"), f"{label}, {lines.WINDOW_M:g} m window")).when(jump, none).when(spans, between("between the heights of both ends; steepest unknown")).otherwise(F.col("incline_max")),
        "cross_slope": F.when(sampled & F.col("camber").isNotNull(), by(F.col("camber"), f"{label}, {BESIDE_M:g} m to both sides")).when(sampled, unsure).when(jump, none).otherwise(F.col("cross_slope")),
    }).select(*edges.columns)
    mapped = edges.where("incline.source = 'osm' and incline.value is not null").select("edge", F.col("incline.value").alias("mapped"), "length_m")
    checks = mapped.join(slopes.where("verdict = 'sampled' and not short"), "edge").select("edge", "mapped", _round(F.col("mean"), 1).alias("mean"), _round(F.col("steepest"), 1).alias("steepest"), _round(F.col("length_m"), 1).alias("length_m"))
    return out, high, checks
