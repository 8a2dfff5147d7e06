"""Patterns over paths, applied to each supplier's lines in the order of orders: a line is a step, its quantity its metres."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import paths, relational
from .registry import SQL, query, t

KEYS = ["route"]
_KIND = "CASE l_linenumber WHEN 1 THEN 'footway' WHEN 2 THEN 'sidewalk' WHEN 3 THEN 'crossing' WHEN 4 THEN 'board' WHEN 5 THEN 'transit' WHEN 6 THEN 'steps' ELSE 'elevator' END"
_SIGNED = "round(l_discount * 100) * CASE WHEN l_partkey % 3 = 0 THEN -1 ELSE 1 END"
#: A step's columns as Spark and DuckDB both read them.
_COLUMNS = f"""l_suppkey AS route, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS seq, {_KIND} AS kind,
  CASE WHEN l_linenumber = 4 THEN concat(l_returnflag, l_linestatus, ', line ', l_partkey % 4, ', towards ', l_linestatus) WHEN l_quantity > 5 THEN concat('Street ', l_partkey % 3) END AS name,
  l_partkey % 2 = 0 AS forward, CAST(l_quantity AS DOUBLE) AS length_m, CASE WHEN l_quantity <= 45 THEN {_SIGNED} END AS incline, CASE WHEN l_quantity <= 45 AND l_returnflag = 'R' THEN {_SIGNED} * 1.25 END AS incline_max,
  CASE WHEN l_returnflag = 'A' THEN 'sett' WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'cobblestone' WHEN l_returnflag = 'N' AND l_partkey % 2 = 1 THEN 'asphalt' END AS surface, round(l_tax * 100) AS cross_slope,
  CASE WHEN l_partkey % 97 = 0 THEN 'swing' END AS movable, CASE WHEN l_linenumber = 3 AND l_partkey % 3 = 0 THEN 'unmapped' WHEN l_linenumber = 3 AND l_partkey % 3 = 1 THEN 'inferred' END AS kerb,
  CASE WHEN l_quantity > 40 THEN 'unknown' ELSE 'yes' END AS passable, l_partkey AS edge, CASE WHEN l_partkey % 5 > 0 THEN l_partkey % 50 END AS way, CASE WHEN l_partkey % 7 > 0 THEN l_extendedprice / 100 END AS z,
  CAST((l_partkey * 37) % 360 AS DOUBLE) AS bearing_in, CAST((l_partkey * 53) % 360 AS DOUBLE) AS bearing_out, CAST(6 AS DOUBLE) AS comfort_pct, CAST(4 AS DOUBLE) AS camber_pct, CAST(NULL AS VARCHAR(9)) AS ref, l_suppkey % 2 = 1 AS miles, l_linenumber = 2 AS on_road"""
_STEPS = f"(SELECT {_COLUMNS} FROM lineitem)"
_MEASURED = f"(SELECT *, coalesce(sum(length_m) OVER (PARTITION BY route ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at_m FROM {_STEPS})"
_RIDING = "kind IN ('transit', 'board', 'interchange')"
_PLACE = "CASE WHEN name IS NULL THEN CASE WHEN kind = 'steps' THEN 'unnamed steps' ELSE 'a path' END ELSE name END"


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = t(spark, sf_dir, "lineitem")
    return relational.spread(items, items.count(), "l_suppkey").selectExpr(*_split(_COLUMNS.replace("VARCHAR(9)", "STRING")))


def _split(columns: str) -> list[str]:
    """The expressions of a select list, parted at the commas outside brackets."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(columns):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            out.append(columns[at:i])
            at = i + 1
    return [x.strip() for x in [*out, columns[at:]]]


@query(f"""WITH m AS {_MEASURED}, s AS (SELECT *, sum(CASE WHEN kind = 'board' AND forward THEN 1 ELSE 0 END) OVER (PARTITION BY route ORDER BY seq) AS leg FROM m),
o AS (SELECT *, sum(CASE WHEN kind = 'board' AND NOT forward THEN 1 ELSE 0 END) OVER (PARTITION BY route, leg ORDER BY seq) AS offs FROM s WHERE leg > 0),
r AS (SELECT route, leg, min_by(name, seq) AS boarded, min(at_m) AS start, count(*) FILTER (kind = 'transit' AND offs = 0) AS stops, max(name) FILTER (kind = 'board' AND NOT forward AND offs = 1) AS alighted, max(at_m) FILTER (kind = 'board' AND NOT forward AND offs = 1) AS stop FROM o GROUP BY 1, 2)
SELECT route, row_number() OVER (PARTITION BY route ORDER BY leg) AS ride, array_to_string(list_slice(string_split(boarded, ', '), 2, 9), ', ') AS line, split_part(boarded, ', ', 1) AS origin, split_part(alighted, ', ', 1) AS target, stops, start AS start_m, stop AS end_m FROM r WHERE stop IS NOT NULL""")
def path_rides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.rides(steps(spark, sf_dir), KEYS)


@query(f"""WITH m AS {_MEASURED}, b AS (SELECT *, CASE WHEN {_RIDING} THEN 6 WHEN kind = 'steps' THEN 5 WHEN kind = 'elevator' THEN 0 WHEN v IS NULL THEN -1 WHEN v < 3 THEN 0 WHEN v < 5 THEN 1 WHEN v < 8 THEN 2 WHEN v < 12 THEN 3 ELSE 4 END AS band FROM (SELECT *, abs(coalesce(incline_max, incline)) AS v FROM m)),
c AS (SELECT *, CASE WHEN band IS NOT DISTINCT FROM lag(band) OVER (PARTITION BY route ORDER BY seq) THEN 0 ELSE 1 END AS fresh, sum(CASE WHEN {_RIDING} THEN 0 ELSE length_m END) OVER (PARTITION BY route) AS walk FROM b),
p AS (SELECT route, part, min(band) AS band, min(at_m) AS t0, max(at_m + length_m) AS t1, min(walk) AS walk FROM (SELECT *, sum(fresh) OVER (PARTITION BY route ORDER BY seq) - 1 AS part FROM c) GROUP BY 1, 2),
d AS (SELECT *, CASE WHEN band = 6 THEN greatest(walk * 0.06::DOUBLE, least(t1 - t0, walk * 0.15::DOUBLE)) ELSE t1 - t0 END AS drawn FROM p)
SELECT route, part::BIGINT AS part, band, t0, t1, round(sum(drawn) OVER w - drawn, 6) AS d0, round(sum(drawn) OVER w, 6) AS d1 FROM d WINDOW w AS (PARTITION BY route ORDER BY part)""")
def slope_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.strip(steps(spark, sf_dir), KEYS).withColumns({c: F.round(c, 6) for c in ("d0", "d1")})


@query(f"SELECT route, seq::INT AS point, floor(at_m + length_m + 0.5)::BIGINT AS d, floor(z * 10 + 0.5) / 10 AS z FROM {_MEASURED} UNION ALL SELECT s_suppkey, 0, 0, CASE WHEN s_suppkey % 3 > 0 THEN s_acctbal END FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem)")
def elevation_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    walked = steps(spark, sf_dir)
    starts = t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("route"), F.when(F.col("s_suppkey") % 3 > 0, F.col("s_acctbal")).alias("z"))
    return paths.elevation(walked, starts.join(walked.select("route").distinct(), "route", "left_semi"), KEYS)


@query(f"""WITH s AS (SELECT *, {_PLACE} AS place FROM {_STEPS} WHERE NOT {_RIDING} AND kind <> 'elevator'),
w AS (SELECT route, place, way, min(seq) AS first FROM s WHERE way IS NOT NULL GROUP BY ALL)
SELECT route, row_number() OVER (PARTITION BY route ORDER BY first)::INT AS stretch, name, edges, ways, m FROM
  (SELECT s.route, place AS name, min(seq) AS first, string_agg(edge::VARCHAR, ',' ORDER BY seq) AS edges, floor(sum(length_m) + 0.5)::BIGINT AS m,
    (SELECT string_agg(way::VARCHAR, ',' ORDER BY first) FROM w WHERE w.route = s.route AND w.place = s.place) AS ways FROM s GROUP BY s.route, place)""")
def path_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a stretch without any way has no text of ways
    text = lambda c: F.when(F.size(c) > 0, F.array_join(F.transform(c, lambda x: x.cast("string")), ",")).alias(c)
    return paths.stretches(steps(spark, sf_dir), KEYS).select("route", "stretch", "name", text("edges"), text("ways"), "m")


@query(f"""WITH g AS (SELECT route, seq, coalesce(name, 'an unnamed path') AS name, length_m, CASE WHEN incline IS NULL THEN ['incline: slope not mapped'] ELSE [] END || CASE WHEN surface IS NULL THEN ['surface: surface not mapped'] ELSE [] END || CASE WHEN way IS NULL THEN [concat('surface: way ', edge % 4)] ELSE [] END AS gaps FROM {_STEPS}),
u AS (SELECT route, name, seq, unnest(gaps) AS gap, generate_subscripts(gaps, 1) AS i FROM g),
d AS (SELECT route, name, split_part(gap, ': ', 2) AS detail, min((seq, i)) AS first FROM u GROUP BY ALL)
SELECT route, row_number() OVER (PARTITION BY route ORDER BY m DESC, first)::INT AS rank, name, m, (SELECT string_agg(detail, ', ' ORDER BY d.first) FROM d WHERE d.route = x.route AND d.name = x.name) AS what FROM
  (SELECT route, name, floor(sum(length_m) + 0.5)::BIGINT AS m, min(seq) AS first FROM g WHERE len(gaps) > 0 GROUP BY 1, 2) x""")
def unknowns_by_street(spark: SparkSession, sf_dir: str) -> DataFrame:
    gap = lambda when, attr, detail: F.when(when, F.struct(F.lit("unknown").alias("kind"), F.lit(attr).alias("attr"), detail.alias("detail")))
    reasons = F.array(gap(F.col("incline").isNull(), "incline", F.lit("slope not mapped")), gap(F.col("surface").isNull(), "surface", F.lit("surface not mapped")), gap(F.col("way").isNull(), "surface", F.concat(F.lit("way "), (F.col("edge") % 4).cast("string"))))
    walked = steps(spark, sf_dir).withColumn("reasons", F.filter(reasons, lambda r: r.isNotNull()))
    return paths.unknowns(walked, KEYS).select("route", "rank", "name", "m", "what")


def _long(metres: str, step: int = 10) -> str:
    """The words for a length in metric or, on odd routes, in yards and miles."""
    short = lambda x, unit: f"concat(greatest({step}, floor({x} / {step}.0::DOUBLE + 0.5) * {step})::BIGINT, ' {unit}')"
    tenth = lambda x: f"CASE WHEN {x} >= 10 THEN floor({x} + 0.5)::BIGINT::VARCHAR WHEN floor({x} * 10 + 0.5) % 10 = 0 THEN (floor({x} * 10 + 0.5) / 10)::BIGINT::VARCHAR ELSE (floor({x} * 10 + 0.5) / 10)::VARCHAR END"
    miles = f"({metres} / 1609.344::DOUBLE)"
    return f"""CASE WHEN miles THEN CASE WHEN {metres} / 0.9144::DOUBLE < 440 THEN {short(f"({metres} / 0.9144::DOUBLE)", "yd")} ELSE concat({tenth(miles)}, CASE WHEN {tenth(miles)} = '1' THEN ' mile' ELSE ' miles' END) END
      WHEN floor({metres} / {step}.0::DOUBLE + 0.5) * {step} < 1000 THEN {short(metres, "m")} ELSE concat({tenth(f"({metres} / 1000)")}, ' km') END"""


@query(f"""WITH RECURSIVE m AS MATERIALIZED (SELECT *, incline_max * CASE WHEN forward THEN 1 ELSE -1 END AS w FROM {_MEASURED} WHERE NOT {_RIDING}),
h AS MATERIALIZED (
  SELECT route, seq, miles, 0 AS rank, 'steep' AS kind, at_m, length_m AS length, 'Steep section' AS title, concat(floor(abs(w) + 0.5)::BIGINT, '% ', CASE WHEN w > 0 THEN 'uphill' ELSE 'downhill' END) AS head, true AS told FROM m WHERE abs(w) >= 6 AND length_m >= 5
  UNION ALL SELECT route, seq, miles, 1, 'setts', at_m, length_m, CASE surface WHEN 'sett' THEN 'Setts' ELSE 'Cobbles' END, '', true FROM m WHERE surface IN ('sett', 'cobblestone') AND length_m >= 10
  UNION ALL SELECT route, seq, miles, 2, 'camber', at_m, length_m, 'Pavement slopes sideways', concat(floor(cross_slope + 0.5)::BIGINT, '%'), true FROM m WHERE cross_slope > 4 AND length_m >= 10
  UNION ALL SELECT route, seq, miles, 3, 'bridge', at_m, length_m, coalesce(name, 'Moving bridge'), 'closes when it swings for boats', false FROM m WHERE movable IS NOT NULL
  UNION ALL SELECT route, seq, miles, 5, 'unknown', at_m, length_m, 'Missing data', '', true FROM m WHERE passable = 'unknown' AND length_m >= 20),
runs AS (SELECT *, sum(CASE WHEN at_m - before < 5 AND head = was THEN 0 ELSE 1 END) OVER (PARTITION BY route, kind ORDER BY seq) AS run FROM
  (SELECT *, lag(at_m + length) OVER w AS before, lag(head) OVER w AS was FROM h WINDOW w AS (PARTITION BY route, kind ORDER BY seq))),
merged AS (SELECT route, min(seq) AS seq, min(miles) AS miles, min(rank) AS rank, kind, min(at_m) AS at_m, max(at_m + length) - min(at_m) AS length, min_by(title, seq) AS title, min_by(head, seq) AS head, min(told) AS told FROM runs GROUP BY route, kind, run),
k AS MATERIALIZED (SELECT route, seq, miles, at_m + length_m AS at_m, CASE kerb WHEN 'unmapped' THEN 'Kerb not mapped' ELSE 'Dropped kerb expected' END AS title, row_number() OVER (PARTITION BY route ORDER BY seq) AS n FROM m WHERE kerb IS NOT NULL),
f AS (SELECT route, n, at_m AS last_at, title AS last_title, true AS keep FROM k WHERE n = 1 UNION ALL
  SELECT k.route, k.n, CASE WHEN k.at_m - f.last_at < 15 AND k.title = f.last_title THEN f.last_at ELSE k.at_m END, CASE WHEN k.at_m - f.last_at < 15 AND k.title = f.last_title THEN f.last_title ELSE k.title END, NOT (k.at_m - f.last_at < 15 AND k.title = f.last_title) FROM f JOIN k ON k.route = f.route AND k.n = f.n + 1),
every AS (SELECT route, seq, miles, rank, kind, at_m, length, title, head, told FROM merged UNION ALL SELECT k.route, k.seq, k.miles, 4, 'kerb', k.at_m, 0, k.title, CASE k.title WHEN 'Kerb not mapped' THEN 'at the next crossing' ELSE 'not confirmed' END, false FROM k JOIN f ON f.route = k.route AND f.n = k.n WHERE f.keep)
SELECT route, row_number() OVER (PARTITION BY route ORDER BY at_m, seq, rank)::INT AS hazard, kind, at_m, length, title, CASE WHEN NOT told THEN head WHEN head = '' THEN concat('for ', {_long("length")}) ELSE concat(head, ' for ', {_long("length")}) END AS detail FROM every""")
def path_hazards(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a route's unit is one, so all are walked once
    return paths.hazards(steps(spark, sf_dir), [*KEYS, "miles"], F.col("miles")).drop("miles")


@query(f"""WITH RECURSIVE m AS MATERIALIZED (SELECT *, name AS label, lag(kind) OVER w AS was, lag(name) OVER w AS was_label, lag(bearing_out) OVER w AS came, row_number() OVER w AS n, min(CASE WHEN kind <> 'transit' THEN (seq, kind, name) END) OVER (PARTITION BY route ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS far FROM {_MEASURED} WINDOW w AS (PARTITION BY route ORDER BY seq)),
d AS (SELECT *, ((bearing_in - came + 540) % 360) - 180 AS turned, label IS NOT NULL AND label IS DISTINCT FROM was_label AS renamed, split_part(coalesce(name, ''), ', ', 1) AS station, array_to_string(list_slice(string_split(coalesce(name, ''), ', '), 2, 9), ', ') AS line FROM m),
w AS (SELECT *, CASE WHEN abs(turned) < 25 THEN 'Continue' WHEN abs(turned) < 60 THEN 'Bear ' || side WHEN abs(turned) < 150 THEN 'Turn ' || side ELSE 'Turn around' END AS word FROM (SELECT *, CASE WHEN turned > 0 THEN 'right' ELSE 'left' END AS side FROM d)),
told AS (SELECT route, seq, at_m, CASE WHEN n = 1 THEN ('start', concat('Head off', ' along ' || label, '.')) WHEN kind = 'elevator' THEN ('lift', 'Take the lift.')
    WHEN kind = 'board' AND forward THEN ('board', concat('Take the ', line, CASE WHEN far[2] = 'board' THEN ' to ' || split_part(coalesce(far[3], ''), ', ', 1) END, ' from ', station, '.')) WHEN kind = 'board' THEN ('alight', concat('Get off at ', station, '.')) WHEN kind = 'transit' THEN NULL
    WHEN kind = 'crossing' AND was <> 'crossing' THEN ('cross', concat('Cross ', coalesce(label, 'the road'), '.')) WHEN was IN ('transit', 'board', 'interchange') THEN NULL
    WHEN word <> 'Continue' OR renamed THEN (CASE WHEN word = 'Continue' THEN 'continue' ELSE 'turn' END, CASE WHEN word = 'Continue' THEN concat('Continue onto ', label, '.') WHEN renamed THEN concat(word, ' onto ', label, '.') ELSE concat(word, '.') END) END AS said FROM w),
l AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY route ORDER BY seq) AS n FROM (SELECT route, seq, at_m, said[1] AS type, said[2] AS text FROM told WHERE said IS NOT NULL UNION ALL SELECT route, max(seq) + 1, max(at_m + length_m), 'arrive', 'You have arrived.' FROM m GROUP BY route)),
f AS (SELECT route, n, 1 AS number, type, at_m, text FROM l WHERE n = 1 UNION ALL
  SELECT l.route, l.n, f.number + CASE WHEN j THEN 0 ELSE 1 END, CASE WHEN j THEN f.type ELSE l.type END, CASE WHEN j THEN f.at_m ELSE l.at_m END, l.text FROM f JOIN l ON l.route = f.route AND l.n = f.n + 1, LATERAL (SELECT l.type IN ('turn', 'continue') AND f.type = 'turn' AND l.at_m - f.at_m < 8 AS j))
SELECT route, number, min(type) AS type, min(at_m) AS at_m, max_by(text, n) AS text FROM f GROUP BY route, number""")
def path_maneuvers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.maneuvers(steps(spark, sf_dir), KEYS)


@query(f"""WITH s AS (SELECT *, coalesce(name, 'path') AS called, NOT ({_RIDING}) AS walk FROM {_STEPS} WHERE NOT {_RIDING} OR kind = 'board' AND forward),
c AS (SELECT *, CASE WHEN walk AND kind = lag(kind) OVER w AND called = lag(called) OVER w THEN 0 ELSE 1 END AS fresh FROM s WINDOW w AS (PARTITION BY route ORDER BY seq)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY route ORDER BY seq) AS segment FROM c),
p AS (SELECT route, segment, min(kind) AS kind, min(called) AS called, min(miles) AS miles, sum(length_m) AS m, sum(coalesce(incline * CASE WHEN forward THEN 1 ELSE -1 END * length_m / 100, 0)) AS rise, min_by(surface, seq) FILTER (surface IS NOT NULL) AS surface, bool_or(passable = 'unknown') AS unsure FROM g GROUP BY 1, 2),
b AS (SELECT *, CASE WHEN kind = 'board' THEN sum(CASE WHEN kind = 'board' THEN 1 ELSE 0 END) OVER (PARTITION BY route ORDER BY segment) END AS ride, CASE WHEN m > 0 THEN rise / m * 100 ELSE 0 END AS slope FROM p),
t AS (SELECT b.route, segment, CASE WHEN kind = 'elevator' THEN 'Take the lift.' WHEN kind = 'crossing' THEN concat('Cross ', CASE WHEN called = 'path' THEN 'the road' ELSE called END, '.')
    WHEN kind = 'board' THEN 'Take the ' || r.line || ' from ' || r.origin || ' to ' || r.target || ', ' || r.stops || CASE WHEN r.stops = 1 THEN ' stop.' ELSE ' stops.' END
    WHEN m >= 3 THEN concat(concat_ws(', ', CASE WHEN called = 'path' THEN 'Path' ELSE called END, {_long("m", 1)}, CASE WHEN abs(slope) < 2 THEN 'level' ELSE concat(CASE WHEN slope > 0 THEN 'uphill' ELSE 'downhill' END, ' about ', floor(abs(slope) + 0.5)::BIGINT, '%') END, CASE surface WHEN 'sett' THEN 'setts' WHEN 'cobblestone' THEN 'cobbles' ELSE surface END, CASE WHEN unsure THEN 'some details unknown' END), '.') END AS text
  FROM b LEFT JOIN rides r ON r.route = b.route AND r.ride = b.ride)
SELECT route, row_number() OVER (PARTITION BY route ORDER BY segment)::INT AS line, text FROM t WHERE text IS NOT NULL""".replace("LEFT JOIN rides r", f"LEFT JOIN ({SQL['path_rides']}) r"))
def path_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a route's unit is one, so all are walked once
    return paths.directions(steps(spark, sf_dir), [*KEYS, "miles"], F.col("miles")).drop("miles")


@query(f"""WITH v AS (SELECT route, seq, edge, at_m, edge % 3 > 0 AS hours, edge % 11 = 0 AS disputed FROM {_MEASURED} WHERE edge % 9 = 0),
p AS (SELECT route, sum(length_m) AS length FROM {_STEPS} GROUP BY 1),
o AS (SELECT *, CASE WHEN hours THEN (at_day + 86400 - opens) % 86400 < lasts END AS open FROM (SELECT v.*, (28800 + floor(at_m * 1000000)::BIGINT // 1000000) % 86400 AS at_day, edge % 24 * 3600 AS opens, 14400 + edge % 7 * 3600 AS lasts FROM v)),
s AS (SELECT route, floor(at_m + 0.5) AS at_m FROM o WHERE coalesce(open, true) AND NOT disputed UNION ALL SELECT route, unnest([0, length]) FROM p)
SELECT route, longest_gap_m, shut, passed FROM (SELECT route, floor(max(gap) + 0.5)::BIGINT AS longest_gap_m FROM (SELECT route, at_m - lag(at_m) OVER (PARTITION BY route ORDER BY at_m) AS gap FROM s) GROUP BY 1) JOIN (SELECT p.route, count(*) FILTER (open = false) AS shut, count(o.seq) AS passed FROM p LEFT JOIN o ON o.route = p.route GROUP BY 1) USING (route)""")
def toilets_along(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as places that open for some hours every day, some over midnight; suppliers walk past them from eight on at a metre a second."""
    walked = paths.measured(steps(spark, sf_dir), KEYS)
    day = 86_400_000_000
    visits = walked.where("edge % 9 = 0").select("route", F.col("edge").alias("place"), "at_m", (F.col("edge") % 3 > 0).alias("hours"), (F.col("edge") % 11 == 0).alias("disputed"))
    roads = walked.groupBy("route").agg(F.sum("length_m").alias("length")).withColumn("depart", F.lit(28_800_000_000)).withColumn("speed", F.lit(1.0))
    part = t(spark, sf_dir, "part").where("p_partkey % 9 = 0").select(F.col("p_partkey").alias("place"))
    days = (roads.agg(F.max("length")).first()[0] or 0) // 86_400 + 2
    spans = part.withColumn("d", F.explode(F.sequence(F.lit(-1), F.lit(int(days)))))
    spans = spans.select("place", (F.col("d") * day + F.col("place") % 24 * 3_600_000_000).alias("start")).withColumn("stop", F.col("start") + 14_400_000_000 + F.col("place") % 7 * 3_600_000_000)
    told, gaps = paths.stops_along(visits, roads, spans, KEYS)
    passed = told.groupBy("route").agg(F.count(F.when(~F.col("open"), 1)).alias("shut"), F.count("*").alias("passed"))
    return gaps.join(passed, "route", "left").na.fill(0, ["shut", "passed"])


@query(f"""WITH i AS (SELECT route, seq, CASE WHEN edge % 4 = 0 THEN 'blocked' WHEN edge % 4 = 1 THEN 'slower' ELSE 'info' END AS grp, concat('Works ', edge % 6) AS text, CASE WHEN seq % 2 = 0 THEN 'live' ELSE 'static' END AS label, concat('source ', edge % 2) AS source, seq AS date, CASE WHEN edge % 5 > 0 THEN edge % 30 END AS until, name AS place FROM {_STEPS} WHERE edge % 13 = 0),
g AS (SELECT route, grp, text, source, min(seq) AS first, min_by(label, seq) AS label, min(date) AS date, max(until) AS until FROM i GROUP BY 1, 2, 3, 4),
w AS (SELECT route, grp, text, source, string_agg(place, ';' ORDER BY f) AS places FROM (SELECT route, grp, text, source, place, min(seq) AS f FROM i WHERE place IS NOT NULL GROUP BY ALL) GROUP BY 1, 2, 3, 4)
SELECT g.route, row_number() OVER (PARTITION BY g.route ORDER BY CASE g.grp WHEN 'blocked' THEN 0 WHEN 'slower' THEN 1 ELSE 2 END, first)::INT AS place, g.grp AS section, g.text, label, g.source, date, until, coalesce(places, '') AS places FROM g LEFT JOIN w ON w.route = g.route AND w.grp = g.grp AND w.text = g.text AND w.source = g.source""")
def on_route_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    edge = F.col("edge")
    numbered = lambda word, n: F.concat(F.lit(word), (edge % n).cast("string"))
    items = steps(spark, sf_dir).where("edge % 13 = 0").select(
        "route", "seq", F.when(edge % 4 == 0, "blocked").when(edge % 4 == 1, "slower").otherwise("info").alias("section"), numbered("Works ", 6).alias("text"), F.when(F.col("seq") % 2 == 0, "live").otherwise("static").alias("label"),
        numbered("source ", 2).alias("source"), F.col("seq").alias("date"), F.when(edge % 5 > 0, edge % 30).alias("until"), F.col("name").alias("where"),
    )
    return paths.on_route(items, KEYS).withColumn("places", F.array_join("places", ";"))


@query("""WITH RECURSIVE r AS MATERIALIZED (SELECT l_orderkey AS request, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS rank, l_quantity / 4 AS minutes, l_quantity * 20 AS distance_m, CASE WHEN l_quantity <= 45 THEN round(l_discount * 100) END AS worst_incline FROM lineitem),
f AS (SELECT request, rank, [{'m': minutes, 'd': distance_m, 'w': coalesce(worst_incline, 0)}] AS kept, true AS stays FROM r WHERE rank = 1 UNION ALL
  SELECT r.request, r.rank, CASE WHEN s THEN list_append(kept, {'m': r.minutes, 'd': r.distance_m, 'w': coalesce(r.worst_incline, 0)}) ELSE kept END, s FROM f JOIN r ON r.request = f.request AND r.rank = f.rank + 1,
    LATERAL (SELECT len(list_filter(kept, lambda k: abs(k.m - r.minutes) < 1.5 AND abs(k.d - r.distance_m) < 150 AND abs(abs(k.w) - abs(coalesce(r.worst_incline, 0))) < 0.5)) = 0 AS s))
SELECT f.request, f.rank, r.minutes, r.distance_m FROM f JOIN r ON r.request = f.request AND r.rank = f.rank WHERE stays""")
def distinct_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as routes found: those not like an earlier one that stays."""
    number = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice"))
    found = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("request"), number.alias("rank"), (F.col("l_quantity") / 4).alias("minutes"), (F.col("l_quantity") * 20).alias("distance_m"), F.when(F.col("l_quantity") <= 45, C.js_round(F.col("l_discount") * 100).cast("double")).alias("worst_incline"))
    return paths.distinct_routes(found, ["request"]).select("request", "rank", "minutes", "distance_m")


@query(f"""WITH m AS {_MEASURED}, s AS (SELECT *, sum(CASE WHEN abs(at_m - was) < 0.5 THEN 0 ELSE 1 END) OVER (PARTITION BY route ORDER BY seq) AS run FROM (SELECT route, seq, at_m, at_m + length_m AS stop, lag(at_m + length_m) OVER (PARTITION BY route ORDER BY seq) AS was FROM m WHERE on_road)),
r AS (SELECT route, min(at_m) AS a, max(stop) AS b FROM s GROUP BY route, run), p AS (SELECT route, at_m AS along, sum(length_m) OVER (PARTITION BY route) AS length, seq % 2 = 0 AS drives FROM m)
SELECT p.route, p.along, round(CASE WHEN any_value(drives) THEN (any_value(length) - along - coalesce(sum(greatest(0, b - greatest(a, along))), 0)) / 1.25::DOUBLE + coalesce(sum(greatest(0, b - greatest(a, along))), 0) / 3.576::DOUBLE ELSE (any_value(length) - along) / 1.25::DOUBLE END, 6) AS left_s FROM p LEFT JOIN r ON r.route = p.route WHERE along % 50 = 0 GROUP BY 1, 2""")
def time_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    walked = paths.measured(steps(spark, sf_dir), KEYS)
    asked = walked.withColumn("length", F.sum("length_m").over(Window.partitionBy("route"))).where("at_m % 50 = 0").select("route", F.col("at_m").alias("along"), "length", F.lit(1.25).alias("speed"), F.when(F.col("seq") % 2 == 0, 3.576).alias("road_speed"))
    left = paths.seconds_left(asked, paths.roads(steps(spark, sf_dir), KEYS), KEYS)
    return left.select("route", "along", F.round("left_s", 6).alias("left_s"))
