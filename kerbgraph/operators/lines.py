"""Lines as arrays of points and as rows of (key, d, z): densifying, slopes, projections, simplifying, hazards, stretches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Metres: between samples, of the steepest window, of edges too short for one; what no walkable surface rises in a step, in per cent.
STEP_M, WINDOW_M, JUMP_M, IMPLAUSIBLE = 1.0, 10.0, 0.6, 35.0


def densify(line: Column, step: float = STEP_M) -> Column:
    """Points (d, x, y) every `step` or less along a line of (x, y) on a plane, with the distance from its start; the last point is its
    end."""
    n = F.size(line)
    legs = F.zip_with(F.slice(line, F.lit(1), n - 1), F.slice(line, F.lit(2), n - 1), lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by"), F.hypot(b["x"] - a["x"], b["y"] - a["y"]).alias("len")))
    # a column used twice is computed twice: what many points share is bound to a name by an array of one
    bound = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    before = lambda legs, i: F.aggregate(F.slice(legs, F.lit(1), i), F.lit(0.0), lambda s, g: s + g["len"])
    parts = lambda g: F.greatest(F.lit(1), F.ceil(g["len"] / step).cast("int"))
    leg = lambda g, q: F.transform(F.sequence(F.lit(0), q["n"] - 1), lambda s: F.struct((q["d"] + g["len"] * s / q["n"]).alias("d"), (g["ax"] + (g["bx"] - g["ax"]) * s / q["n"]).alias("x"), (g["ay"] + (g["by"] - g["ay"]) * s / q["n"]).alias("y")))
    end = F.element_at(line, -1)

    def points(legs: Column) -> Column:
        inner = F.transform(legs, lambda g, i: bound(F.struct(before(legs, i).alias("d"), parts(g).alias("n")), lambda q: leg(g, q)))
        return F.concat(F.flatten(inner), F.array(F.struct(before(legs, n - 1).alias("d"), end["x"].alias("x"), end["y"].alias("y"))))

    return bound(legs, points)


def slope_parts(profile: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """(keys, length, gap, jump, mean, steepest) in per cent from samples (keys, d, z), d rising; `more` aggregates besides.

    steepest: of all windows from a sample to the first one 10 m on (the whole line if shorter) the steepest, or the mean if that is
    steeper. gap: a height is missing; jump: a step rises more than walkers can.
    """
    w = Window.partitionBy(*keys)
    # a range of doubles has no such bounds, one of micrometres does
    at = w.orderBy(F.round(F.col("d") * 1e6).cast("long"))
    total = F.max("d").over(w)
    rows = profile.withColumn("total", total).withColumn("win", F.least(F.lit(WINDOW_M), total))
    rows = rows.withColumn("rise", F.col("z") - F.lag("z").over(at)).withColumn("run", F.col("d") - F.lag("d").over(at))
    # the first sample at least a window on, or the last one of the line; seen from the end, so that frames only grow
    back = w.orderBy(-F.round(F.col("d") * 1e6).cast("long"))
    full = F.last(F.struct("d", "z")).over(back.rangeBetween(Window.unboundedPreceding, -int(WINDOW_M * 1e6)))
    rows = rows.withColumn("far", F.coalesce(full, F.first(F.struct("d", "z")).over(back.rowsBetween(Window.unboundedPreceding, Window.currentRow))))
    span = F.col("far.d") - F.col("d")
    grade = F.when((span > 0) & (span >= F.col("win") * 0.95), (F.col("far.z") - F.col("z")) / span * 100)
    jump = (F.col("run") > 0) & (F.abs("rise") > F.greatest(F.lit(JUMP_M), F.col("run") * JUMP_M / STEP_M))
    out = rows.withColumn("grade", grade).groupBy(*keys).agg(
        F.max("d").alias("length"), F.max(F.col("z").isNull()).alias("gap"), F.max(F.coalesce(jump, F.lit(False))).alias("jump"), F.min_by("z", "d").alias("z0"), F.max_by("z", "d").alias("z1"), F.max_by("grade", F.struct(F.abs("grade"), -F.col("d"))).alias("steep"), *more,
    )
    out = out.withColumn("mean", (F.col("z1") - F.col("z0")) / F.nullif("length", F.lit(0.0)) * 100)
    return out.withColumn("steepest", F.when(F.abs("steep") > F.abs("mean"), F.col("steep")).otherwise(F.col("mean"))).drop("z0", "z1", "steep")


def slopes(profile: DataFrame, key: str) -> DataFrame:
    """(key, length, mean, steepest, verdict) in per cent from samples (key, d, z), d rising, by `slope_parts`.

    verdict: no-data if a height is missing, discontinuity if a step rises more than walkers can or a slope is implausible.
    """
    verdict = F.when(F.col("gap") | F.col("mean").isNull(), "no-data").when(F.col("jump") | (F.abs("steepest") > IMPLAUSIBLE) | (F.abs("mean") > IMPLAUSIBLE), "discontinuity").otherwise("sampled")
    return slope_parts(profile, [key]).select(key, "length", "mean", "steepest", verdict.alias("verdict"))


def project(px: Column, py: Column, line: Column) -> Column:
    """(distance_m, along_m, leg) of the point of a line of (lon, lat) nearest to (px, py), on a local flat map; of equal ones the first."""
    n = F.size(line)
    k = F.cos(F.radians(py)) * 111_320.0
    flat = F.transform(line, lambda p: F.struct(((p["lon"] - px) * k).alias("x"), ((p["lat"] - py) * 111_320.0).alias("y")))
    legs = F.zip_with(F.slice(flat, F.lit(1), n - 1), F.slice(flat, F.lit(2), n - 1), lambda a, b: F.struct(a["x"].alias("x"), a["y"].alias("y"), (b["x"] - a["x"]).alias("u"), (b["y"] - a["y"]).alias("v")))
    share = lambda g: F.when(g["u"] * g["u"] + g["v"] * g["v"] == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(g["x"] * g["u"] + g["y"] * g["v"]) / F.nullif(g["u"] * g["u"] + g["v"] * g["v"], F.lit(0.0)))))
    before = lambda i: F.aggregate(F.slice(legs, F.lit(1), i), F.lit(0.0), lambda s, g: s + F.hypot(g["u"], g["v"]))
    each = F.transform(legs, lambda g, i: F.struct(F.hypot(g["x"] + share(g) * g["u"], g["y"] + share(g) * g["v"]).alias("distance_m"), i.alias("leg"), (before(i) + share(g) * F.hypot(g["u"], g["v"])).alias("along_m")))
    return F.array_min(each)


def simplify(lines: DataFrame, key: str, tolerance: float = 1.0) -> DataFrame:
    """(key, line) with the points of a line of (x, y) that lie further than `tolerance` from the chord of those kept (Douglas and Peucker).
    The split points depend on each other, so a line is done in one piece, in Arrow batches of lines."""

    def kept(points: np.ndarray) -> np.ndarray:
        keep, stack = np.zeros(len(points), bool), [(0, len(points) - 1)]
        keep[[0, -1]] = True
        while stack:
            a, b = stack.pop()
            if b - a < 2:
                continue
            chord, inner = points[b] - points[a], points[a + 1 : b] - points[a]
            share = np.clip(inner @ chord / max(float(chord @ chord), 1e-300), 0, 1)
            far = np.hypot(*(inner - share[:, None] * chord).T)
            at = int(far.argmax())
            if far[at] > tolerance:
                keep[a + 1 + at] = True
                stack += [(a, a + 1 + at), (a + 1 + at, b)]
        return keep

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for line in f["line"]:
                points = np.array([(p["x"], p["y"]) for p in line], float).reshape(-1, 2)
                out.append(list(line) if len(points) < 3 else [p for p, k in zip(line, kept(points), strict=True) if k])
            yield pd.DataFrame({key: f[key], "line": out})

    kind = lines.schema[key].dataType.simpleString()
    return lines.select(key, "line").mapInPandas(run, f"`{key}` {kind}, line array<struct<x:double,y:double>>")


def merge_runs(rows: DataFrame, keys: list[str], start: str, end: str, gap: float) -> DataFrame:
    """Stretches (keys, start, end) of a key that lie no further apart than `gap` as one, with how many they were."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("__new", F.when(F.col(start) - reach <= gap, 0).otherwise(1)).withColumn("__run", F.sum("__new").over(w))
    return marked.groupBy(*keys, "__run").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("__run")


def turn_word(turn: Column) -> Column:
    """What to do at a turn of so many degrees (-180 to 180, right above 0)."""
    size, side = F.abs(turn), F.when(turn > 0, "right").otherwise("left")
    return F.when(size < 25, "Continue").when(size < 60, F.concat(F.lit("Bear "), side)).when(size < 150, F.concat(F.lit("Turn "), side)).otherwise("Turn around")


def turn(before: Column, after: Column) -> Column:
    """Degrees from one bearing to the next, from -180 to below 180."""
    return F.pmod(after - before + 540.0, F.lit(360.0)) - 180.0
