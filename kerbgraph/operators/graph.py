"""Graph operators over edge tables: reachability, components, cheapest paths. Loops write every round to shared storage."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Tables, written
from .relational import spread


#: Rows of a frontier up to which it is broadcast, so that the arcs stay where they are; a larger one is shuffled with them.
SMALL_FRONTIER = 200_000


def small(frontier: DataFrame, rows: int) -> DataFrame:
    """The frontier of a round, broadcast if its rows, counted before, are few."""
    return F.broadcast(frontier) if rows <= SMALL_FRONTIER else frontier


def reach(arcs: DataFrame, starts: DataFrame, max_hops: int | None = None) -> DataFrame:
    """(root, node, hops) for every node that a start (root) reaches over arcs (src, dst), itself included.

    One table holds what was seen; a round joins the newest nodes with the arcs and adds those that are new. The newest nodes are
    the rows of the last hop, so a round reads one table and writes one.
    """
    with Tables(arcs.sparkSession) as tables:
        arcs = tables.write(arcs.select("src", "dst").distinct(), "arcs")
        seen = tables.write(starts.select("root", F.col("root").alias("node"), F.lit(0).alias("hops")).distinct(), "seen")
        opened = SMALL_FRONTIER + 1
        for hop in count(1) if max_hops is None else range(1, max_hops + 1):
            step = small(seen.where(F.col("hops") == hop - 1), opened).join(arcs, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node"), F.lit(hop).alias("hops"))
            seen = tables.write(seen.union(step).groupBy("root", "node").agg(F.min("hops").alias("hops")), "seen")
            tables.keep_last("seen")
            opened = seen.where(F.col("hops") == hop).count()
            if not opened:
                break
        return written(seen, "reach")


def components(links: DataFrame) -> DataFrame:
    """(node, component): the least node that can be reached over links (a, b), whichever way. A link of a node with itself makes the
    node known; null ends are dropped.

    Stars: in a round every node hands its larger neighbours to its least neighbour, then its smaller ones, so that trees halve
    in depth; it ends when the links no longer change, each then leading from a node to its component. A chain of n nodes takes about
    log n rounds. Links of a node with many neighbours are only ever aggregated or joined with one row.
    """
    spark = links.sparkSession
    with Tables(spark) as tables:
        links = tables.write(links.select("a", "b").where("a is not null and b is not null").distinct(), "given")
        edges = tables.write(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        mark = None
        while True:
            both = edges.union(edges.select("b", "a"))
            least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
            large = both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
            large = tables.write(large, "large")
            least = large.groupBy("a").agg(F.min("b").alias("m"))
            small = large.join(least, "a").select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e"))
            edges = tables.write(small.select(F.col("e.a").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct(), "edges")
            tables.keep_last("large", "edges")
            seen = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
            if tuple(seen) == mark:
                break
            mark = tuple(seen)
        ends = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        own = links.select(F.col("a").alias("node")).union(links.select("b")).distinct().join(ends.select("node"), "node", "left_anti")
        return written(ends.union(own.select("node", F.col("node").alias("component"))), "components")


def cheapest(arcs: DataFrame, starts: DataFrame, max_hops: int | None = None) -> DataFrame:
    """(root, node, cost, via, hops): least cost over at most max_hops arcs (src, dst, cost), or over any number (costs must not be
    negative), with the node before and the number of arcs. Of equal costs the fewer hops, then the lesser node before.

    One round relaxes the nodes that the round before made cheaper, for all starts at once; rows of `best` carry the round that
    set them, so there is no second table of them.
    """
    with Tables(arcs.sparkSession) as tables:
        given = tables.write(arcs.select("src", "dst", F.col("cost").cast("double").alias("cost")), "given")
        size = given.count()
        arcs = tables.write(spread(given, size, "src", "dst").groupBy("src", "dst").agg(F.min("cost").alias("arc")), "arcs")
        tables.drop("given")
        node = F.col("root").alias("node")
        best = tables.write(starts.select("root", node, F.lit(0.0).alias("cost"), F.lit(0).alias("hops"), F.col("root").alias("via"), F.lit(0).alias("round")).distinct(), "best")
        opened = best.count()
        for step in count(1) if max_hops is None else range(1, max_hops + 1):
            front = best.where(F.col("round") == step - 1)
            if opened <= SMALL_FRONTIER:
                fresh = F.broadcast(front).join(arcs, F.col("node") == F.col("src"))
            else:
                fresh = spread(front, size, "node").join(spread(arcs, size, "src"), F.col("node") == F.col("src"))
            fresh = fresh.select("root", F.col("dst").alias("node"), (F.col("cost") + F.col("arc")).alias("cost"), (F.col("hops") + 1).alias("hops"), F.col("src").alias("via"), F.lit(step).alias("round"))
            # a row that is no better keeps the old round: the least round wins a tie
            order = F.min(F.struct("cost", "hops", "via", "round")).alias("v")
            best = tables.write(best.unionByName(fresh).groupBy("root", "node").agg(order).select("root", "node", "v.*"), "best")
            tables.keep_last("best")
            opened = best.where(F.col("round") == step).count()
            if not opened:
                break
        return written(best.drop("round"), "cheapest")
