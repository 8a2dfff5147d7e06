"""Grid squares, lengths in words, nodes under a reach and notes by tier, applied to the driver's tables."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import texts
from ..operators import linking, overlay
from .path_queries import _long
from .registry import query, t

BUILT = "b2"
_FAR = "2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2))))"


@query("""WITH l AS (SELECT (l_partkey * 137 % 90000 + 310000)::DOUBLE AS x, (l_suppkey * 911 % 90000 + 650000)::DOUBLE AS y, (l_quantity * 90 - 2000)::DOUBLE AS dx, (round(l_discount * 100) * 400 - 1500)::DOUBLE AS dy, l_returnflag = 'N' AS known FROM lineitem),
n AS (SELECT *, sqrt(dx * dx + dy * dy) AS long, row_number() OVER () AS id FROM l WHERE dx <> 0 OR dy <> 0),
c AS (SELECT id, 0.0::DOUBLE AS s FROM n UNION SELECT id, 1.0 FROM n
  UNION SELECT id, (k * 1000 - x) / dx FROM n, LATERAL (SELECT unnest(generate_series(floor(least(x, x + dx) / 1000)::BIGINT + 1, ceil(greatest(x, x + dx) / 1000)::BIGINT - 1)) AS k) WHERE dx <> 0
  UNION SELECT id, (k * 1000 - y) / dy FROM n, LATERAL (SELECT unnest(generate_series(floor(least(y, y + dy) / 1000)::BIGINT + 1, ceil(greatest(y, y + dy) / 1000)::BIGINT - 1)) AS k) WHERE dy <> 0),
p AS (SELECT id, s, lead(s) OVER (PARTITION BY id ORDER BY s) AS e FROM c),
q AS (SELECT floor((x + dx * (s + e) / 2) / 1000)::BIGINT AS gx, floor((y + dy * (s + e) / 2) / 1000)::BIGINT AS gy, (e - s) * long AS metres, known FROM p JOIN n USING (id) WHERE e IS NOT NULL),
g AS (SELECT gx, gy, sum(metres) AS metres, coalesce(sum(metres) FILTER (known), 0) AS known_m FROM q GROUP BY 1, 2),
z AS (SELECT *, 19 - gy // 100 AS down, gx // 100 AS e FROM g),
i AS (SELECT *, down - down % 5 + (e + 10) // 5 AS a, down * 5 % 25 + e % 5 AS b FROM z)
SELECT concat(chr((a + CASE WHEN a > 7 THEN 66 ELSE 65 END)::INT), chr((b + CASE WHEN b > 7 THEN 66 ELSE 65 END)::INT), lpad((gx % 100)::VARCHAR, 2, '0'), lpad((gy % 100)::VARCHAR, 2, '0')) AS square, round(metres, 3) AS metres, round(known_m, 3) AS known_m, round(known_m / metres, 6) AS share FROM i""")
def lengths_by_square(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the table as straight streets: metres in every square of a kilometre, and of how many something is known."""
    x, y = (F.col("l_partkey") * 137 % 90_000 + 310_000).cast("double"), (F.col("l_suppkey") * 911 % 90_000 + 650_000).cast("double")
    dx, dy = (F.col("l_quantity") * 90 - 2000).cast("double"), F.round(F.col("l_discount") * 100) * 400 - 1500
    line = F.array(F.struct(x.alias("x"), y.alias("y")), F.struct((x + dx).alias("x"), (y + dy).alias("y")))
    found = overlay.coverage(t(spark, sf_dir, "lineitem").select(line.alias("line"), (F.col("l_returnflag") == "N").alias("known")))
    return found.select("square", F.round("metres", 3).alias("metres"), F.round("known_m", 3).alias("known_m"), F.round("share", 6).alias("share"))


@query(f"""SELECT p_partkey, CASE WHEN m > 0 THEN {_long("m")} ELSE CASE WHEN miles THEN '0 yd' ELSE '0 m' END END AS rough, CASE WHEN m > 0 THEN {_long("m", 1)} ELSE CASE WHEN miles THEN '0 yd' ELSE '0 m' END END AS precise,
  CASE WHEN cm <= 0 THEN 'Flush only' WHEN cm < 1 THEN concat(floor(cm * 10 + 0.5)::BIGINT, ' mm') WHEN floor(cm * 10 + 0.5) % 10 = 0 THEN concat((floor(cm * 10 + 0.5) / 10)::BIGINT, ' cm') ELSE concat(floor(cm * 10 + 0.5) / 10, ' cm') END AS kerb
  FROM (SELECT p_partkey, p_partkey % 2 = 0 AS miles, ((p_partkey * p_size) % 40000 - 3)::DOUBLE AS m, ((p_size - 4) * 0.25)::DOUBLE AS cm FROM part)""")
def lengths_in_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    metres, miles = ((F.col("p_partkey") * F.col("p_size")) % 40_000 - 3).cast("double"), F.col("p_partkey") % 2 == 0
    return t(spark, sf_dir, "part").select("p_partkey", texts.length_text(metres, miles).alias("rough"), texts.length_text(metres, miles, precise=True).alias("precise"), texts.kerb_limit_text((F.col("p_size") - 4) * 0.25).alias("kerb"))


def _place(i: Column, j: Column) -> tuple[Column, Column]:
    """(lon, lat) as decimals, as SQL reads these numbers: equal differences stay equal, so that places at mirrored distances are equally far."""
    at = lambda start, n, step: F.lit(Decimal(start)) + n * F.lit(Decimal(step))
    return at("-3.3", i, "0.0002").alias("lon"), at("55.9", j, "0.0001").alias("lat")


_STOPS = "(SELECT s_suppkey AS point, -3.3 + s_suppkey * 37 % 1000 * 0.0002 AS lon, 55.9 + s_suppkey * 61 % 1000 * 0.0001 AS lat, CASE WHEN s_nationkey % 3 = 0 THEN 35.0 WHEN s_nationkey % 3 = 1 THEN 180.0 ELSE 400.0 END AS reach FROM supplier)"
_JUNCTIONS = "(SELECT p_partkey AS node, -3.3 + p_partkey * 89 % 1009 * 0.0002 AS lon, 55.9 + p_partkey * 53 % 1013 * 0.0001 AS lat FROM part)"


@query(f"SELECT point, node, round(d, 3) AS distance_m, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY point ORDER BY d, node) AS rank FROM (SELECT a.point, b.node, a.reach, {_FAR.format(a='a', b='b')} AS d FROM {_STOPS} a, {_JUNCTIONS} b) WHERE d <= reach) WHERE rank <= 3")
def nearest_under_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as stops of three kinds, each with a reach of its own, and parts as junctions."""
    nation = F.col("s_nationkey") % 3
    stops = t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("point"), *_place(F.col("s_suppkey") * 37 % 1000, F.col("s_suppkey") * 61 % 1000), F.when(nation == 0, 35.0).when(nation == 1, 180.0).otherwise(400.0).alias("reach"))
    junctions = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), *_place(F.col("p_partkey") * 89 % 1009, F.col("p_partkey") * 53 % 1013))
    return linking.nearest(stops, junctions, 3).withColumn("distance_m", F.round("distance_m", 3))


@query(f"""WITH n AS (SELECT event_id AS note, -3.3 + event_id * 37 % 1000 * 0.0002 AS lon, 55.9 + user_id * 61 % 1000 * 0.0001 AS lat, CASE event_type WHEN 'click' THEN 'b2' WHEN 'view' THEN 'b1' END AS built, event_id % 500 AS e, user_id % 40 AS w FROM events),
e AS (SELECT node AS edge, node % 50 AS way, lon, lat FROM {_JUNCTIONS})
SELECT note, unnest([e, e + 1]) AS edge FROM n WHERE built = 'b2' UNION ALL SELECT n.note, e.edge FROM n JOIN e ON e.way = n.w WHERE built IS DISTINCT FROM 'b2' AND {_FAR.format(a='e', b='n')} <= 200""")
def notes_to_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as notes, some of this build of the graph, and parts as edges."""
    event, kind = F.col("event_id"), F.col("event_type")
    notes = t(spark, sf_dir, "events").select(event.alias("note"), *_place(event * 37 % 1000, F.col("user_id") * 61 % 1000), F.when(kind == "click", "b2").when(kind == "view", "b1").alias("built"), F.array(event % 500, event % 500 + 1).alias("edges"), F.array(F.col("user_id") % 40).alias("ways"))
    key = F.col("p_partkey")
    edges = t(spark, sf_dir, "part").select(key.alias("edge"), (key % 50).alias("way"), F.array(F.struct(*_place(key * 89 % 1009, key * 53 % 1013))).alias("line"))
    return linking.note_edges(notes, edges, BUILT)
