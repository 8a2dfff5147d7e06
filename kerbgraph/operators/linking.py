"""Stations, lines and notes linked to the street graph: nearest nodes under a reach, rides, boards, interchanges, tiers of notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from . import relational

#: Metres: from a station to the street, between stations of one building, and the least lengths of links and interchanges.
LINK_M, SAME_BUILDING_M, LEAST_LINK_M, LEAST_CHANGE_M = 180.0, 150.0, 10.0, 50.0
#: Nodes of the street that a station is linked to, and metres from a note within which its ways count.
LINKS, NOTE_M = 3, 200.0


def synthetic(key: Column) -> Column:
    """A negative node number from a key: the same in every build, and never a map's, whose numbers are positive."""
    return -(F.shiftrightunsigned(F.xxhash64(key), 2)) - 1


def nearest(points: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """points (point, lon, lat, reach) with their k nearest nodes (node, lon, lat) within each one's reach: (point, node, distance_m, rank); of
    equally near nodes the lesser first.

    Places are searched with the longest reach by `relational.nearest_join`, from a small radius on, so that a crowd around a point, or many points and nodes at one place,
    are never paired as a whole; a point then keeps what its own reach holds.
    """
    most = points.agg(F.max("reach")).first()[0] or 1.0
    near = relational.nearest_join(points.select(F.struct("point", "reach").alias("a"), "lon", "lat"), nodes.select(F.col("node").alias("b"), "lon", "lat"), most, k)
    found = near.where("distance_m <= a.reach").select("a.point", F.col("b").alias("node"), "distance_m")
    rank = F.row_number().over(Window.partitionBy("point").orderBy("distance_m", "node"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def transit(stations: DataFrame, routes: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, key, lon, lat, level, kind) and edges (kind, ref, from_node, to_node, length_m, name) that put lines into the street graph.

    stations: (station, name, lon, lat, hub); routes: (route, line, line_name, stops: array of stations in order); nodes: (node, lon, lat) of the street outdoors at level 0.
    Only stations that a route stops at count; stops without a station are passed over. Each station has a node at street level, linked to the 3 nearest street nodes within 180 m,
    and a platform for each of its lines, reached by a board edge. Rides join consecutive stops of a line, once for each pair either way; stations of one hub within 150 m
    are joined by an interchange.
    """
    stop = routes.select("route", "line", "line_name", F.posexplode("stops").alias("i", "station"))
    served = stop.join(stations.select("station", "name", "lon", "lat", "hub"), "station")
    used = served.select("station", "name", "lon", "lat", "hub").distinct()
    platform = served.groupBy("line", "station").agg(F.min_by(F.struct("name", "lon", "lat", "line_name"), F.struct("route", "i")).alias("s")).select("line", "station", "s.*")
    station_key, platform_key = F.concat(F.lit("station:"), "station"), F.concat(F.lit("platform:"), "line", F.lit(":"), "station")
    made = used.select(synthetic(station_key).alias("node"), station_key.alias("key"), "lon", "lat", F.lit(0).alias("level"), F.lit("entrance").alias("kind"))
    made = made.unionByName(platform.select(synthetic(platform_key).alias("node"), platform_key.alias("key"), "lon", "lat", F.lit(-1).alias("level"), F.lit("junction").alias("kind")))

    near = nearest(used.select(F.col("station").alias("point"), "lon", "lat", F.lit(LINK_M).alias("reach")), nodes, LINKS).withColumnRenamed("point", "station").join(used.select("station", "name"), "station")
    length = lambda d, least: F.greatest(F.lit(least), d).alias("length_m")
    links = near.select(F.lit("station_link").alias("kind"), F.concat(F.lit("link:"), "station").alias("ref"), synthetic(station_key).alias("from_node"), F.col("node").alias("to_node"), length(F.col("distance_m"), LEAST_LINK_M), "name")
    boards = platform.select(F.lit("board").alias("kind"), F.concat_ws(":", F.lit("board"), "line", "station").alias("ref"), synthetic(station_key).alias("from_node"), synthetic(platform_key).alias("to_node"), F.lit(0.0).alias("length_m"), F.concat_ws(", ", "name", "line_name").alias("name"))
    # the next stop of the route as it is listed: a stop that has no station parts the ride
    following = stop.select("route", "line", (F.col("i") - 1).alias("i"), F.col("station").alias("next"))
    pair = served.select("route", "line", "line_name", "i", "station", "lon", "lat").join(following, ["route", "line", "i"])
    pair = pair.join(used.select(F.col("station").alias("next"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2")), "next").where("next <> station")
    once = pair.groupBy("line", F.least("station", "next").alias("x"), F.greatest("station", "next").alias("y")).agg(F.min_by(F.struct("station", "next", "line_name", C.haversine_m(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2")).alias("d")), F.struct("route", "i")).alias("r")).select("line", "r.*")
    at = lambda c: synthetic(F.concat(F.lit("platform:"), "line", F.lit(":"), c))
    rides = once.select(F.lit("transit").alias("kind"), F.concat_ws(":", F.lit("ride"), "line", "station", "next").alias("ref"), at("station").alias("from_node"), at("next").alias("to_node"), F.col("d").alias("length_m"), F.col("line_name").alias("name"))
    # a hub is a place: its stations are few
    hub = used.where("hub is not null")
    other = hub.select("hub", F.col("station").alias("b"), F.col("name").alias("name2"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    d = C.haversine_m(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2"))
    change = hub.join(other, "hub").where("station < b").withColumn("d", d).where(F.col("d") <= SAME_BUILDING_M)
    said = F.when(F.col("name") == F.col("name2"), F.concat(F.lit("Change at "), "name")).otherwise(F.concat(F.lit("Change from "), "name", F.lit(" to "), "name2"))
    changes = change.select(F.lit("interchange").alias("kind"), F.concat_ws(":", F.lit("interchange"), "station", "b").alias("ref"), synthetic(station_key).alias("from_node"), synthetic(F.concat(F.lit("station:"), "b")).alias("to_node"), length(F.col("d"), LEAST_CHANGE_M), said.alias("name"))
    return made, links.unionByName(boards).unionByName(rides).unionByName(changes)


def note_edges(notes: DataFrame, edges: DataFrame, built: str) -> DataFrame:
    """(note, edge): the edges that notes about a stretch mean. notes: (note, lon, lat, built, edges, ways); edges: (edge, way, line of (lon, lat)).

    A note taken on this build of the graph names its edges, whether they exist or not; only for the others, the edges of its ways that come within 200 m of the note.
    """
    exact = notes.where(F.col("built") == built).select("note", F.explode("edges").alias("edge"))
    older = notes.where(~F.col("built").eqNullSafe(built)).select("note", "lon", "lat", F.explode("ways").alias("way"))
    # a way may have any number of edges and notes: they meet by way and cell; of the line's points that are near the first makes the row
    points = edges.where("way is not null").select("edge", "way", "line", F.posexplode("line").alias("i", "p"))
    stored = relational.cell(points.withColumn("plon", F.col("p.lon")).withColumn("plat", F.col("p.lat")), NOTE_M, "plon", "plat")
    asked = relational.around(older, NOTE_M, "lon", "lat")
    close = lambda p: C.haversine_m(p["lon"], p["lat"], F.col("lon"), F.col("lat")) <= NOTE_M
    first = ~F.exists(F.slice("line", F.lit(1), F.col("i")), close)
    found = asked.join(stored, ["way", "cx", "cy"]).where(close(F.col("p")) & first).select("note", "edge")
    return exact.unionByName(found)


def notes_of_stretches(notes: DataFrame, stretches: DataFrame, built: str, keys: list[str]) -> DataFrame:
    """(keys, note): notes about stretches (keys, edges, ways, points): of this build if they share an edge, older ones if they share a way and the stretch comes within
    200 m."""
    exact = notes.where(F.col("built") == built).select("note", F.explode("edges").alias("edge")).join(stretches.select(*keys, F.explode("edges").alias("edge")), "edge").select(*keys, "note")
    older = notes.where(~F.col("built").eqNullSafe(built)).select("note", "lon", "lat", F.explode("ways").alias("way"))
    close = F.exists("points", lambda p: C.haversine_m(p["lon"], p["lat"], F.col("lon"), F.col("lat")) <= NOTE_M)
    near = older.join(stretches.select(*keys, "points", F.explode("ways").alias("way")), "way").where(close).select(*keys, "note")
    return exact.unionByName(near).distinct()


def notes_of_entrances(notes: DataFrame, entrances: DataFrame) -> DataFrame:
    """(entrance, note): notes (note, ref) about one door, by its reference alone, so that a note about the side door never lands on the front door."""
    return entrances.select("entrance", F.concat(F.lit("entrance:"), F.col("entrance").cast("string")).alias("ref")).join(notes.where("ref is not null").select("note", "ref"), "ref").select("entrance", "note")
