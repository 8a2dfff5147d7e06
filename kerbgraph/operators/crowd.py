"""What people report, on the edges it is about."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from . import relational

# What a category is about, and the kinds of edges that are that; edges nobody reports on.
TARGETS = {"no-dropped-kerb": "crossing", "dropped-kerb": "crossing", "steps": "steps", "ramp": "steps", "broken-lift": "lift", "big-lift": "lift", "accessible-toilet": "place", "seat": "place"}
KINDS = {"crossing": ("crossing",), "steps": ("steps", "ramp"), "lift": ("elevator", "escalator")}
NEVER = ("transit", "board", "interchange", "station_link")
#: Metres: how near an edge must be, and how much further others of its kind may be.
SNAP_M, SAME_M, NEARBY_M = 15.0, 5.0, 20.0


def report_edges(reports: DataFrame, edges: DataFrame) -> DataFrame:
    """(report, edge) for reports (report, category, lon, lat) and edges (edge, kind, line): those of the category's kind within 15 m, all as near as the nearest,
    give or take 5 m; where there are none, the nearest edge. Reports about places have none."""
    n = F.size("line")
    legs = F.zip_with(F.slice("line", F.lit(1), n - 1), F.slice("line", F.lit(2), n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    segments = edges.where(~F.col("kind").isin(*NEVER) & (n > 1)).select("edge", "kind", F.explode(legs).alias("g")).select("edge", "kind", F.col("g.a.lon").alias("ax"), F.col("g.a.lat").alias("ay"), F.col("g.b.lon").alias("bx"), F.col("g.b.lat").alias("by"))
    target = C._lookup(TARGETS, F.col("category"))
    asked = reports.withColumn("target", F.coalesce(target, F.lit("pavement"))).where("target <> 'place'")
    near = relational.segment_join(asked.select(F.col("report").alias("a"), "lon", "lat"), segments, SNAP_M).groupBy(F.col("a").alias("report"), "edge", "kind").agg(F.min("distance_m").alias("m"))
    near = near.join(asked.select("report", "target"), "report")
    typed = F.coalesce(*[F.when(F.col("target") == k, F.col("kind").isin(*kinds)) for k, kinds in KINDS.items()], F.lit(False))
    near = near.withColumn("typed", typed)
    w = Window.partitionBy("report")
    best = F.min(F.when(F.col("typed"), F.col("m"))).over(w)
    first = F.min(F.struct("m", "edge")).over(w)
    ranked = near.withColumn("best", best).withColumn("first", first)
    return ranked.where(F.when(F.col("best").isNotNull(), F.col("typed") & (F.col("m") <= F.col("best") + SAME_M)).otherwise(F.col("edge") == F.col("first.edge"))).select("report", "edge")


def signals(reports: DataFrame, edges: DataFrame) -> DataFrame:
    """(edge, community): what is reported on an edge as the cost rules read it, from reports with level and confidence (by evidence_level), detail; faded and
    disputed ones say nothing."""
    good = reports.where(~F.col("level").isin("faded", "disputed"))
    rows = report_edges(good, edges).join(good.select("report", "category", "level", "confidence", "detail"), "report")
    return rows.groupBy("edge").agg(F.sort_array(F.collect_list(F.struct("report", "category", "level", "confidence", "detail"))).alias("r")).select("edge", F.transform("r", lambda x: F.struct(x["category"].alias("category"), x["level"].alias("level"), x["confidence"].alias("confidence"), x["detail"].alias("detail"))).alias("community"))


def nearby(asked: DataFrame, reports: DataFrame, radius_m: float = NEARBY_M) -> DataFrame:
    """(ask, report, distance_m, rank): reports of the asked category (any if null) near a point (ask, category, lon, lat), nearest first."""
    near = relational.within_join(asked.select(F.col("ask").alias("a"), "lon", "lat"), reports.select(F.col("report").alias("b"), "lon", "lat"), radius_m)
    rows = near.join(asked.select(F.col("ask").alias("a"), F.col("category").alias("want")), "a").join(reports.select(F.col("report").alias("b"), "category"), "b").where("want is null or want = category")
    return rows.select(F.col("a").alias("ask"), F.col("b").alias("report"), "distance_m", F.row_number().over(Window.partitionBy("a").orderBy("distance_m", "b")).alias("rank"))
