"""Heights and slopes over tiles that customers (small ones with holes) and nations (wide ones under them) stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import terrain
from .registry import query, t

#: Ranks of nations' tiles come after those of all customers'.
BELOW = 1_000_000_000


def six(c: str):
    """Six places as SQL rounds them: of the product, which Spark's round of a double's shortest text differs from at halves."""
    return (F.round(F.col(c) * 1e6) / 1e6).alias(c)


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer a tile of 8 x 8 cells of 5 m, 40 in a row, one cell in 17 without data; every nation one of 10 x 10 cells of 40 m."""
    key, nation = F.col("c_custkey"), F.col("n_nationkey")
    i, j = lambda n: n % 8, lambda n: F.floor(n / 8)
    small = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda n: F.when((i(n) * 3 + j(n) * 5 + key) % 17 != 0, F.lit(100.0) + F.col("c_acctbal") / 3777 + i(n) * 0.25 - j(n) * 0.125))
    wide = F.transform(F.sequence(F.lit(0), F.lit(99)), lambda n: F.lit(90.0) + (nation + 1) / 7.0 + (n % 10) * 0.5 + F.floor(n / 10) * 0.75)
    size = lambda n: [F.lit(n).alias("width"), F.lit(n).alias("height")]
    near = t(spark, sf_dir, "customer").select(key.cast("long").alias("rank"), (key % 40 * 40.0).alias("x0"), (F.floor(key / 40) * 40.0).alias("y0"), F.lit(5.0).alias("res"), *size(8), small.alias("z"))
    under = t(spark, sf_dir, "nation").select((nation + BELOW).cast("long").alias("rank"), (nation % 5 * 400.0 - 100).alias("x0"), (F.floor(nation / 5) * 400.0 + 300).alias("y0"), F.lit(40.0).alias("res"), *size(10), wide.alias("z"))
    return near.unionByName(under)


_TILES = f"""tiles AS MATERIALIZED (SELECT c_custkey AS rank, c_custkey % 40 AS gx, (c_custkey // 40) AS gy, (c_custkey % 40 * 40)::DOUBLE AS x0, ((c_custkey // 40) * 40)::DOUBLE AS y0, 5.0::DOUBLE AS res, 8 AS side,
  list_transform(range(64), lambda n: CASE WHEN ((n % 8) * 3 + (n // 8) * 5 + c_custkey) % 17 <> 0 THEN 100.0::DOUBLE + c_acctbal / 3777 + (n % 8) * 0.25::DOUBLE - (n // 8) * 0.125::DOUBLE END) AS z FROM customer
  UNION ALL SELECT n_nationkey + {BELOW}, NULL, NULL, (n_nationkey % 5) * 400.0::DOUBLE - 100, (n_nationkey // 5) * 400.0::DOUBLE + 300, 40.0::DOUBLE, 10, list_transform(range(100), lambda n: 90.0::DOUBLE + (n_nationkey + 1) / 7.0::DOUBLE + (n % 10) * 0.5::DOUBLE + (n // 10) * 0.75::DOUBLE) FROM nation)"""


def _heights(points: str) -> str:
    """CTEs up to `high` (p, z): the height of every row (p, x, y) of `points`."""
    cell = lambda di, dj: f"CASE WHEN u + {di} BETWEEN 0 AND side - 1 AND v + {dj} BETWEEN 0 AND side - 1 THEN z[((v + {dj}) * side + u + {di} + 1)::BIGINT] END"
    return f"""{_TILES}, pts AS MATERIALIZED ({points}),
near AS (SELECT p, x, y, unnest([floor((x - 2.5) / 40), floor((x - 2.5) / 40) + 1])::BIGINT AS gx, floor((y - 2.5) / 40)::BIGINT AS g FROM pts),
cand AS (SELECT p, x, y, tiles.* EXCLUDE (gx, gy) FROM (SELECT p, x, y, gx, unnest([g, g + 1, g + 2]) AS gy FROM near) n JOIN tiles USING (gx, gy) UNION ALL SELECT p, x, y, tiles.* EXCLUDE (gx, gy) FROM pts, tiles WHERE gx IS NULL AND x BETWEEN x0 - 20 AND x0 + 420 AND y BETWEEN y0 - 420 AND y0 + 20),
pos AS (SELECT p, rank, side, z, (x - x0) / res - 0.5 AS fx, (y0 - y) / res - 0.5 AS fy FROM cand), cut AS (SELECT *, floor(fx)::BIGINT AS u, floor(fy)::BIGINT AS v FROM pos),
four AS (SELECT p, rank, fx - u AS tx, fy - v AS ty, {cell(0, 0)} AS a, {cell(1, 0)} AS b, {cell(0, 1)} AS c, {cell(1, 1)} AS d FROM cut),
each AS (SELECT p, rank, coalesce(a * (1 - tx) * (1 - ty) + b * tx * (1 - ty) + c * (1 - tx) * ty + d * tx * ty, a, b, c, d) AS z FROM four),
high AS (SELECT p, arg_min(z, rank) AS z FROM each WHERE z IS NOT NULL GROUP BY p)"""


@query(f"""WITH {_heights("SELECT DISTINCT {'o': l_orderkey, 'n': l_linenumber, 'k': l_partkey} AS p, (l_partkey * 37 % 17000) / 10.0::DOUBLE AS x, (l_orderkey * 13 % 19000) / 10.0::DOUBLE AS y FROM lineitem")}
SELECT pts.p.o AS l_orderkey, pts.p.n AS l_linenumber, pts.p.k AS l_partkey, round(z, 6) AS z FROM pts LEFT JOIN high USING (p)""")
def terrain_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The height of every line's place, lines alike once."""
    points = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_partkey") * 37 % 17_000 / 10.0).alias("x"), (F.col("l_orderkey") * 13 % 19_000 / 10.0).alias("y"))
    return terrain.heights(points, terrain.blocks(tiles(spark, sf_dir)), ["l_orderkey", "l_linenumber", "l_partkey"]).withColumn("z", six("z"))


def streets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order a straight street of 5 to 40 m in one of four directions; of one in 11 the surface isn't the ground."""
    key, turn = F.col("o_orderkey"), F.col("o_custkey") % 4
    x, y, n = key * 37 % 6_400 / 4.0, F.col("o_custkey") * 911 % 6_000 / 4.0, key % 8 + 1
    dx, dy = F.when(turn == 0, 3).when(turn == 1, 4).when(turn == 2, -3).otherwise(-4), F.when(turn == 0, 4).when(turn == 1, -3).when(turn == 2, -4).otherwise(3)
    line = F.array(F.struct(x.alias("x"), y.alias("y")), F.struct((x + dx * n).alias("x"), (y + dy * n).alias("y")))
    return t(spark, sf_dir, "orders").select(key.alias("edge"), line.alias("line"), (key % 11 == 0).alias("off"))


_STREETS = """(SELECT *, 5 * n AS parts, x + dx * n AS ex, y + dy * n AS ey FROM (SELECT o_orderkey AS edge, o_orderkey % 11 = 0 AS off, (o_orderkey * 37 % 6400) / 4.0::DOUBLE AS x, (o_custkey * 911 % 6000) / 4.0::DOUBLE AS y, o_orderkey % 8 + 1 AS n,
  CASE o_custkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 4 WHEN 2 THEN -3 ELSE -4 END AS dx, CASE o_custkey % 4 WHEN 0 THEN 4 WHEN 1 THEN -3 WHEN 2 THEN -4 ELSE 3 END AS dy FROM orders))"""
_ALONG = f"SELECT edge, off, parts, x AS sx, y AS sy, ex, ey, k, x + (ex - x) * k / parts AS x, y + (ey - y) * k / parts AS y FROM {_STREETS}, LATERAL (SELECT unnest(generate_series(0, parts)) AS k)"


@query(f"""WITH {_heights(f"SELECT {{'e': edge, 'k': k}} AS p, x, y FROM ({_ALONG}) WHERE NOT off")}
SELECT pts.p.e AS edge, pts.p.k::INT AS k, round(pts.p.k, 6)::DOUBLE AS d, round(z, 6) AS z FROM pts LEFT JOIN high USING (p)""")
def terrain_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The height at every metre of the streets on the ground."""
    found = terrain.profiles(streets(spark, sf_dir), terrain.blocks(tiles(spark, sf_dir)))
    return found.select("edge", "k", six("d"), six("z"))


_BESIDE = f"SELECT edge, 2 * k + s AS k, x - (1 - 2 * s) * (ny - py) / far AS x, y + (1 - 2 * s) * (nx - px) / far AS y FROM (SELECT *, sqrt((nx - px) * (nx - px) + (ny - py) * (ny - py)) AS far FROM (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM ({_ALONG}) WINDOW w AS (PARTITION BY edge ORDER BY k)) WHERE k % 2 = 1 AND k < parts), (SELECT unnest([0, 1]) AS s)"


@query(f"""WITH {_heights(f"SELECT {{'e': edge, 'b': false, 'k': k}} AS p, x, y FROM ({_ALONG}) UNION ALL SELECT {{'e': edge, 'b': true, 'k': k}}, x, y FROM ({_BESIDE})")},
h AS (SELECT pts.p.e AS edge, pts.p.b AS b, pts.p.k AS k, z FROM pts LEFT JOIN high USING (p)),
l AS (SELECT *, lag(z) OVER w AS before, coalesce(lead(z, 10) OVER w, CASE WHEN k + 10 > last THEN end_z END) AS far, least(10, last - k) AS run FROM (SELECT *, max(k) OVER (PARTITION BY edge) AS last, arg_max_null(z, k) OVER (PARTITION BY edge) AS end_z FROM h WHERE NOT b) WINDOW w AS (PARTITION BY edge ORDER BY k)),
g AS (SELECT edge, bool_or(z IS NULL) AS gap, coalesce(bool_or(abs(z - before) > 0.6), false) AS jump, (arg_max_null(z, k) - arg_min_null(z, k)) / max(k) * 100 AS mean, arg_max((far - z) / run * 100, (abs((far - z) / run * 100), -k)) FILTER (run > 0 AND run >= least(10, last) * 0.95 AND far - z IS NOT NULL) AS steep FROM l GROUP BY edge),
s AS (SELECT *, CASE WHEN abs(steep) > abs(mean) THEN steep ELSE mean END AS steepest FROM g),
v AS (SELECT *, CASE WHEN gap THEN 'no-data' WHEN jump OR abs(steepest) > 35 OR abs(mean) > 35 THEN 'discontinuity' ELSE 'sampled' END AS verdict FROM s),
c AS (SELECT edge, count(*) AS n, list_sort(list(a) FILTER (a <= 0.5)) AS kept FROM (SELECT edge, abs(max(z) - min(z)) AS a FROM h WHERE b GROUP BY edge, (k // 2) HAVING count(z) = 2) GROUP BY edge)
SELECT edge, verdict, CASE WHEN verdict = 'sampled' THEN round(mean, 6) END AS mean, CASE WHEN verdict = 'sampled' THEN round(steepest, 6) END AS steepest,
  CASE WHEN verdict = 'sampled' AND len(kept) > 0 AND n <= 2 * len(kept) THEN round(kept[((len(kept) * 3) // 4 + 1)::BIGINT] / 2 * 100, 6) END AS camber, CASE WHEN verdict = 'sampled' THEN false END AS short FROM v LEFT JOIN c USING (edge)""")
def terrain_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slope and camber of all streets."""
    found = terrain.edge_slopes(streets(spark, sf_dir), terrain.blocks(tiles(spark, sf_dir)))
    return found.select("edge", "verdict", *[six(c) for c in ("mean", "steepest", "camber")], "short")
