"""The cost model applied to lineitem as edges and part as nodes, with twins written from the rules' text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import cost, profiles
from .registry import query, t

PEOPLE = ("manual-wheelchair", "rollator", "walking")
NOW = "2024-02-01 12:00:00"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as arcs: what a line says stands for an attribute, and some attributes are unknown."""
    li = t(spark, sf_dir, "lineitem")
    n, q, flag = F.col("l_linenumber"), F.col("l_quantity"), F.col("l_returnflag")
    kind = F.when(n == 2, "sidewalk").when(n == 3, "crossing").when(n == 4, "street_proxy").when(n == 5, "steps").when(n == 6, "pedestrian").otherwise("footway")
    slope = F.round(F.col("l_discount") * 100) * F.when(F.col("l_partkey") % 2 == 0, 1.0).otherwise(-1.0)
    known = lambda when, value, state="reported": cost.attr(F.when(when, value), F.when(when, state if isinstance(state, Column) else F.lit(state)).otherwise("unknown"))
    surface = F.when(flag == "A", "sett").when((flag == "R") & (F.col("l_linestatus") == "O"), "gravel").when(flag == "N", "asphalt")
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", kind.alias("kind"), (F.col("l_suppkey") % 2 == 0).alias("forward"), (n != 7).alias("bidirectional"), q.alias("length_m"), F.lit(False).alias("bridge"),
        known(q <= 45, slope).alias("incline"), known((q <= 45) & (flag == "R"), slope * 1.25).alias("incline_max"), known(F.lit(True), F.round(F.col("l_tax") * 100)).alias("cross_slope"), known(surface.isNotNull(), surface).alias("surface"),
        known(q <= 45, q / 10, F.when(F.col("l_partkey") % 3 == 0, "inferred").otherwise("reported")).alias("width"), known(F.col("l_partkey") % 5 != 4, (F.col("l_partkey") % 5).cast("double")).alias("step_count"),
        known(F.lit(True), F.col("l_partkey") % 2 == 0).alias("gritted"), known(F.col("l_suppkey") % 3 < 2, F.when(F.col("l_suppkey") % 3 == 0, "no").otherwise("both")).alias("pavement"), (q * 2).alias("bench_m"),
        cost.conditions(now=NOW, wet=F.col("l_linestatus") == "F", ice=F.col("l_orderkey") % 10 == 0).alias("c"),
    )


def _for(df: DataFrame, spark: SparkSession, people: tuple[str, ...]) -> DataFrame:
    """df for each of some presets: a table of a row a preset is broadcast."""
    return df.join(F.broadcast(profiles.presets(spark).where(F.col("preset").isin(*people))))


_PEOPLE = """(SELECT * FROM (VALUES ('manual-wheelchair', 1.0, 8.0, 8.0, 4.0, 4.0, 0.9, 0.0, 1.8, NULL, 0.3, 0.6, NULL), ('rollator', 0.8, 10.0, 10.0, 5.0, 5.0, 0.7, 2.0, 1.6, 300.0, 0.4, 0.7, NULL),
  ('walking', 1.3, 100.0, 100.0, 10.0, 100.0, 0.4, 'inf'::DOUBLE, 1.0, NULL, 1.0, 0.05, 0.1)) v(preset, speed, up, down, comfort, camber, min_width, max_steps, wetf, rest_m, tol, sett, gravel))"""
_EDGES = """(SELECT l_orderkey, l_linenumber, l_partkey, l_quantity::DOUBLE AS len, CASE l_linenumber WHEN 2 THEN 'sidewalk' WHEN 3 THEN 'crossing' WHEN 4 THEN 'street_proxy' WHEN 5 THEN 'steps' WHEN 6 THEN 'pedestrian' ELSE 'footway' END AS kind,
  l_suppkey % 2 = 0 AS forward, l_linenumber <> 7 AS two_way, l_linestatus = 'F' AS wet, l_orderkey % 10 = 0 AS ice, l_partkey % 2 = 0 AS gritted, CASE l_suppkey % 3 WHEN 0 THEN 'no' WHEN 1 THEN 'both' END AS pavement, l_quantity * 2 AS bench_m,
  CASE WHEN l_quantity <= 45 THEN round(l_discount * 100) * CASE WHEN l_partkey % 2 = 0 THEN 1.0 ELSE -1.0 END END AS incline, l_quantity <= 45 AND l_returnflag = 'R' AS sharp, round(l_tax * 100) AS cross_slope,
  CASE WHEN l_returnflag = 'A' THEN 'sett' WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'gravel' WHEN l_returnflag = 'N' THEN 'asphalt' END AS surface,
  CASE WHEN l_quantity <= 45 THEN l_quantity / 10 END AS width, l_partkey % 3 = 0 AS guessed, CASE WHEN l_partkey % 5 <> 4 THEN l_partkey % 5 END AS step_count FROM lineitem)"""
_JUDGED = f"""(WITH a AS (SELECT *, max_steps = 0 AS wheeled, coalesce(incline * CASE WHEN forward THEN 1 ELSE -1 END, 0)::DOUBLE AS grade FROM {_EDGES} CROSS JOIN {_PEOPLE}),
 b AS (SELECT *, CASE WHEN sharp THEN grade * 1.25 ELSE grade END AS worst, CASE WHEN kind = 'steps' THEN 0.4 WHEN wheeled AND grade > 0 THEN greatest(0.3, 1 - 0.07 * grade) WHEN wheeled THEN greatest(0.5, 1 - 0.03 * greatest(0, -grade - 2))
   ELSE greatest(0.3, least(1.0, exp(-3.5 * abs(grade / 100 + 0.05)) / exp(-3.5 * 0.05))) END AS factor FROM a),
 d AS (SELECT *, len / (speed * factor) AS s, CASE WHEN worst >= 0 THEN up ELSE down END AS lim, CASE surface WHEN 'sett' THEN sett WHEN 'gravel' THEN gravel WHEN 'asphalt' THEN 0 END AS bad FROM b)
 SELECT l_orderkey, l_linenumber, l_partkey, preset, len, CASE WHEN NOT forward AND NOT two_way THEN 'oneway' WHEN kind = 'steps' AND wheeled THEN 'steps' WHEN kind = 'steps' AND step_count > max_steps THEN 'steps'
   WHEN incline IS NOT NULL AND abs(worst) > lim + CASE WHEN len < 10 THEN 0.5 ELSE 0 END THEN 'incline' WHEN incline IS NOT NULL AND ice AND wheeled AND abs(worst) > comfort THEN 'incline' WHEN surface IS NOT NULL AND bad IS NULL THEN 'surface'
   WHEN ice AND wheeled AND surface = 'sett' THEN 'surface' WHEN width < min_width AND NOT guessed THEN 'width' END AS excluded_by,
  s + CASE WHEN incline IS NOT NULL AND abs(worst) > comfort THEN s * 2 * pow((abs(worst) - comfort) / greatest(0.5, lim - comfort), 2) ELSE 0 END + CASE WHEN incline IS NULL AND kind <> 'steps' AND up < 50 THEN 60 * len / 100 * (1 - tol) ELSE 0 END
  + CASE WHEN cross_slope > camber THEN s * least(2.0, (cross_slope - camber) / 4) * 0.48 ELSE 0 END + CASE WHEN ice AND kind <> 'steps' AND NOT gritted THEN s * CASE WHEN wheeled THEN 1 ELSE 0.5 END ELSE 0 END
  + coalesce(s * bad * CASE WHEN wet AND surface = 'sett' THEN wetf ELSE 1 END, 0) + CASE WHEN surface IS NULL AND wheeled THEN 25 * len / 100 * (1 - tol) ELSE 0 END + CASE WHEN width < min_width AND guessed THEN s ELSE 0 END
  + CASE WHEN width IS NULL AND wheeled AND kind IN ('footway', 'street_proxy') THEN 20 * len / 100 * (1 - tol) ELSE 0 END
  + CASE WHEN kind = 'street_proxy' AND pavement = 'no' THEN s * CASE WHEN wheeled THEN 0.6 ELSE 0.2 END WHEN kind = 'street_proxy' AND wheeled THEN CASE WHEN pavement IS NULL THEN 30 ELSE 12 END * (1 - tol) ELSE 0 END
  + CASE WHEN rest_m > 0 AND bench_m > 30 AND kind <> 'crossing' THEN s * least(1, 300 / rest_m) * 0.6 ELSE 0 END AS cost,
  (kind = 'steps' AND step_count IS NULL AND max_steps < 'inf'::DOUBLE) OR (incline IS NULL AND kind <> 'steps' AND up < 50) OR (kind = 'street_proxy' AND coalesce(pavement, '') <> 'no' AND wheeled) AS doubt FROM d)"""


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, preset, excluded_by, round(CASE WHEN excluded_by IS NULL THEN cost END, 5) AS cost, CASE WHEN excluded_by IS NOT NULL THEN 'no' WHEN doubt THEN 'unknown' ELSE 'yes' END AS passable FROM {_JUDGED}")
def cost_model_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = cost.evaluate(_for(_edges(spark, sf_dir), spark, PEOPLE))
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "preset", "excluded_by", F.when(F.col("excluded_by").isNull(), F.round("cost", 5)).alias("cost"), "passable")


@query(f"SELECT preset, coalesce(excluded_by, 'passable') AS outcome, count(*) AS edges, sum(len) AS metres FROM {_JUDGED} GROUP BY 1, 2")
def cost_first_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = cost.evaluate(_for(_edges(spark, sf_dir), spark, PEOPLE))
    return df.groupBy("preset", F.coalesce("excluded_by", F.lit("passable")).alias("outcome")).agg(F.count("*").alias("edges"), F.sum("length_m").alias("metres"))


@query()
def cost_by_preset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All presets and every rule: what share of the length is passable to whom, and at what mean cost."""
    df = cost.evaluate(cost.arcs_of(_edges(spark, sf_dir)).join(F.broadcast(profiles.presets(spark))))
    metres = F.sum(F.when(F.col("passable") != "no", F.col("length_m")))
    return df.groupBy("preset").agg(F.round(metres / F.sum("length_m"), 6).alias("share"), F.round(F.sum(F.when(F.col("passable") != "no", F.col("cost"))) / metres, 6).alias("seconds_a_metre"))


_NODES = """(SELECT p_partkey, p_size % 2 = 1 AS via, CASE p_partkey % 4 WHEN 1 THEN 'raised' WHEN 2 THEN 'lowered' END AS kerb, p_partkey % 4 = 0 AS none, CASE WHEN p_size > 40 THEN p_size / 10.0 END AS height, p_partkey % 8 = 2 AS guessed,
  CASE p_size % 5 WHEN 0 THEN 'signals' WHEN 1 THEN 'zebra' WHEN 2 THEN 'uncontrolled' END AS control, p_size % 5 < 4 AS crosses, CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS sound, CASE p_partkey % 7 WHEN 0 THEN false END AS cone, CASE p_partkey % 5 WHEN 0 THEN true WHEN 1 THEN false END AS tactile FROM part)"""


@query(f"""WITH n AS (SELECT *, coalesce(height, CASE kerb WHEN 'raised' THEN 12 WHEN 'lowered' THEN 0.6 END)::DOUBLE AS h FROM {_NODES}, (VALUES ('manual-wheelchair', 0.6, 0.3, false), ('visual-impairment', 30.0, 0.5, true), ('rollator', 6.0, 0.4, false)) v(preset, lim, tol, cues)),
  r AS (SELECT *, CASE WHEN NOT none AND h > lim + CASE WHEN height IS NULL THEN 0.5 ELSE 0 END THEN 'kerb' END AS excluded_by,
    CASE WHEN none THEN CASE WHEN via AND lim < 10 THEN 120 * (1 - tol) ELSE 0 END WHEN h IS NULL AND lim < 10 THEN 120 * (1 - tol) WHEN guessed AND lim < 10 THEN 30 * (1 - tol) ELSE 0 END AS base,
    CASE WHEN NOT cues OR NOT crosses THEN 0 ELSE CASE WHEN control IS NULL THEN floor(240 * 0.5 * (1 - tol) + 0.5) WHEN control = 'uncontrolled' THEN 240 WHEN control = 'zebra' THEN 60 WHEN coalesce(sound, false) OR coalesce(cone, false) THEN 0
      WHEN sound = false AND cone = false THEN 120 ELSE floor(120 * 0.5 * (1 - tol) + 0.5) END + CASE WHEN tactile = false THEN 45 WHEN tactile IS NULL THEN floor(45 * 0.5 * (1 - tol) + 0.5) ELSE 0 END END AS cue,
    lim < 10 AND ((none AND via) OR (NOT none AND h IS NULL)) OR cues AND crosses AND (control IS NULL OR tactile IS NULL OR control = 'signals' AND NOT coalesce(sound, false) AND NOT coalesce(cone, false) AND NOT coalesce(sound = false AND cone = false, false)) AS doubt FROM n)
  SELECT p_partkey, preset, excluded_by, round(CASE WHEN excluded_by IS NULL THEN base + cue END, 5) AS cost, CASE WHEN excluded_by IS NOT NULL THEN 'no' WHEN doubt THEN 'unknown' ELSE 'yes' END AS passable FROM r""")
def cost_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = t(spark, sf_dir, "part")
    key, size = F.col("p_partkey"), F.col("p_size")
    told = lambda value, state="reported": cost.attr(value, F.when(value.isNotNull(), state if isinstance(state, Column) else F.lit(state)).otherwise("unknown"))
    flag = lambda c, yes, no: F.when(c == yes, True).when(c == no, False) if yes is not None else F.when(c == no, False)
    guess = F.when(key % 8 == 2, "inferred").otherwise("reported")
    nodes = part.select(
        "p_partkey", F.lit("street").alias("kind"), (size % 2 == 1).alias("via_crossing"),
        F.when(key % 4 != 0, F.struct(told(F.when(key % 4 == 1, "raised").when(key % 4 == 2, "lowered"), guess).alias("type"), told(F.when(size > 40, size / 10.0)).alias("height_cm"))).alias("kerb"),
        F.when(size % 5 < 4, F.struct(told(F.when(size % 5 == 0, "signals").when(size % 5 == 1, "zebra").when(size % 5 == 2, "uncontrolled")).alias("control"), told(flag(key % 3, 0, 1)).alias("sound"), told(flag(key % 7, None, 0)).alias("vibration"), told(flag(key % 5, 0, 1)).alias("tactile"))).alias("crossing"),
    )
    df = cost.evaluate_nodes(_for(nodes, spark, ("manual-wheelchair", "visual-impairment", "rollator")))
    return df.select("p_partkey", "preset", "excluded_by", F.when(F.col("excluded_by").isNull(), F.round("cost", 5)).alias("cost"), "passable")


_CATEGORIES = ("narrow-pavement", "blocked-pavement", "rough-surface", "steps", "no-dropped-kerb", "smooth-pavement", "steep")
_EVENTS_K = "(SELECT *, epoch_us(ts) AS tm, json_extract_string(props, '$.k')::INT AS k FROM events)"
_LEVELS = f"""(SELECT k, CASE k % 7 {' '.join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_CATEGORIES))} END AS category, support / (support + against + 1) AS sure,
  CASE WHEN support / (support + against + 1) >= 0.5 THEN 'confirmed' ELSE 'reported' END AS level FROM (SELECT k, count(*) FILTER (event_type IN ('click', 'purchase', 'signup')) AS support, count(*) FILTER (event_type NOT IN ('click', 'purchase', 'signup')) AS against FROM {_EVENTS_K} GROUP BY 1))"""


@query(f"""WITH e AS (SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_quantity::DOUBLE AS s, CASE WHEN l_returnflag = 'R' THEN 25 * l_quantity / 100 * 0.7 ELSE 0 END AS risk, (l.l_partkey % 5 - 2) / 2.0 AS score, l.l_partkey % 3 AS notes, v.category, v.level, v.sure
    FROM lineitem l LEFT JOIN {_LEVELS} v ON l.l_partkey % 100 = v.k),
  f AS (SELECT *, CASE category WHEN 'narrow-pavement' THEN s + 30 WHEN 'blocked-pavement' THEN s * 0.5 + 60 WHEN 'rough-surface' THEN s * 0.6 WHEN 'steps' THEN 60 WHEN 'no-dropped-kerb' THEN 45 WHEN 'steep' THEN s * 0.6 END AS full_s,
    CASE WHEN level = 'confirmed' AND category IN ('blocked-pavement', 'steps', 'no-dropped-kerb') THEN 'community' END AS excluded_by FROM e)
  SELECT l_orderkey, l_linenumber, l_partkey, excluded_by, round(CASE WHEN excluded_by IS NULL THEN s + risk + CASE WHEN notes > 0 AND score < 0 THEN s * least(0.5, -score * 0.5) WHEN notes > 0 AND score > 0 THEN -risk * least(0.5, score * 0.5) ELSE 0 END
    + coalesce(floor(full_s * CASE WHEN level = 'confirmed' THEN 1 ELSE 0.25 END + 0.5), 0) - CASE WHEN category = 'smooth-pavement' AND level = 'confirmed' THEN floor(risk * least(0.5, sure * 0.5) + 0.5) ELSE 0 END END, 5) AS cost FROM f""")
def note_and_community_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat tarmac of known width for a manual wheelchair, so that what people say is all that differs."""
    events = t(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    yes = F.col("event_type").isin("click", "purchase", "signup")
    votes = events.groupBy("k").agg(F.count(F.when(yes, 1)).alias("support"), F.count(F.when(~yes, 1)).alias("against"))
    sure = F.col("support") / (F.col("support") + F.col("against") + 1)
    category = F.element_at(F.array(*[F.lit(c) for c in _CATEGORIES]), F.col("k") % 7 + 1)
    said = votes.select("k", F.array(F.struct(category.alias("category"), F.when(sure >= 0.5, "confirmed").otherwise("reported").alias("level"), sure.alias("confidence"), F.lit("people").alias("detail"))).alias("community"))
    li = t(spark, sf_dir, "lineitem").withColumn("k", (F.col("l_partkey") % 100).cast("int"))
    arcs = li.join(said, "k", "left").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.lit("pedestrian").alias("kind"), F.col("l_quantity").alias("length_m"), cost.attr(F.lit(0.0)).alias("incline"), cost.attr(F.lit(2.0)).alias("width"),
        cost.attr(F.when(F.col("l_returnflag") != "R", "asphalt"), F.when(F.col("l_returnflag") != "R", "reported").otherwise("unknown")).alias("surface"),
        F.struct((F.col("l_partkey") % 3).cast("int").alias("count"), ((F.col("l_partkey") % 5 - 2) / 2.0).alias("score")).alias("note"), "community", profiles.preset("manual-wheelchair").alias("p"), cost.conditions(now=NOW).alias("c"),
    )
    return cost.evaluate(arcs).select("l_orderkey", "l_linenumber", "l_partkey", "excluded_by", F.when(F.col("excluded_by").isNull(), F.round("cost", 5)).alias("cost"))


@query("""WITH o AS (SELECT o_orderkey, o_orderkey % 2 = 0 AS forward, CASE o_orderkey % 3 WHEN 0 THEN 'board' WHEN 1 THEN 'transit' ELSE 'interchange' END AS kind, o_totalprice / 73 AS len, CASE o_custkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 12 END AS steps,
    (o_custkey % 30) * 10.0 AS step_mm, (o_orderkey % 13) * 10.0 AS gap_mm, o_custkey % 5 = 0 AS ramp, o_orderstatus AS st FROM orders),
  f AS (SELECT *, CASE WHEN step_mm <= 50 AND gap_mm <= 85 THEN 'level' WHEN step_mm <= 60 AND gap_mm <= 85 THEN 'fits' WHEN ramp THEN 'ramp' WHEN step_mm / 2 <= 60 AND gap_mm / 2 <= 85 THEN 'part' ELSE 'no' END AS fit,
    CASE WHEN kind = 'transit' THEN len / 8.5 WHEN kind = 'interchange' THEN len / 0.8 + 60 WHEN forward THEN 240 ELSE 90 END AS s, kind = 'transit' AS rides FROM o),
  g AS (SELECT *, CASE WHEN st = 'F' AND forward THEN 'live' WHEN NOT rides AND steps > 0 THEN 'steps' WHEN kind = 'board' AND steps = 0 AND fit = 'no' THEN 'boarding' END AS excluded_by FROM f)
  SELECT o_orderkey, excluded_by, round(CASE WHEN excluded_by IS NULL THEN s + CASE WHEN rides THEN 0 WHEN steps IS NULL THEN 540 WHEN kind = 'board' AND fit = 'part' THEN 540 ELSE CASE WHEN kind = 'board' AND fit = 'ramp' THEN 180 ELSE 0 END
    + CASE WHEN kind = 'board' AND st = 'P' THEN 540 ELSE 0 END END END, 5) AS cost FROM g""")
def cost_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rides, boarding and interchanges for a rollator: lifts out, steps, and the step and gap to the train."""
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    steps = F.when(F.col("o_custkey") % 4 == 0, 0.0).when(F.col("o_custkey") % 4 == 1, 12.0)
    step, gap = (F.col("o_custkey") % 30) * 10.0, (key % 13) * 10.0
    always = [F.lit(x).cast("timestamp") for x in ("2000-01-01", "2100-01-01")]
    live = F.struct(F.when(status == "F", "closed").otherwise("restricted").alias("status"), F.when(status == "F", "all").otherwise("step-free").alias("affects"), F.lit("Lift out of service").alias("headline"), F.lit("a lift").alias("reason"), always[0].alias("valid_from"), always[1].alias("valid_until"))
    arcs = t(spark, sf_dir, "orders").select(
        "o_orderkey", (key % 2 == 0).alias("forward"), F.when(key % 3 == 0, "board").when(key % 3 == 1, "transit").otherwise("interchange").alias("kind"), (F.col("o_totalprice") / 73).alias("length_m"),
        cost.attr(steps, F.when(steps.isNotNull(), "reported").otherwise("unknown")).alias("step_count"), F.when(((status == "F") & (key % 2 == 0)) | (status == "P"), live).alias("live"),
        F.array(F.struct(F.lit("1").alias("platform"), (step / 2).alias("step_min"), step.alias("step_max"), (gap / 2).alias("gap_min"), gap.alias("gap_max"), (F.col("o_custkey") % 5 == 0).alias("ramp"), F.lit(None).cast("string").alias("level_at"))).alias("boarding"),
        profiles.preset("rollator").alias("p"), cost.conditions(now=NOW).alias("c"),
    )
    return cost.evaluate(arcs).select("o_orderkey", "excluded_by", F.when(F.col("excluded_by").isNull(), F.round("cost", 5)).alias("cost"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN l_linestatus = 'O' THEN CASE WHEN g > 0 THEN greatest(0.3, 1 - 0.07 * g) ELSE greatest(0.5, 1 - 0.03 * greatest(0, -g - 2)) END
  ELSE greatest(0.3, least(1.0, exp(abs(g / 100.0 + 0.05) * -3.5) / exp(-3.5 * 0.05))) END, 6) AS factor FROM (SELECT *, l_discount * CASE WHEN l_partkey % 2 = 0 THEN 100.0 ELSE -100.0 END AS g FROM lineitem)""")
def speed_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    grade = F.col("l_discount") * F.when(F.col("l_partkey") % 2 == 0, 100.0).otherwise(-100.0)
    return t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(C.speed_factor(grade, F.col("l_linestatus") == "O"), 6).alias("factor"))


@query("""SELECT p_partkey, CASE WHEN p_size * 5 <= 50 AND p_retailprice / 20 <= 85 THEN 'level' WHEN p_size * 5 <= 60 AND p_retailprice / 20 <= 85 THEN 'fits' WHEN p_size * 2.5 <= 60 AND p_retailprice / 40 <= 85 AND p_partkey % 3 = 0 THEN 'doors' WHEN p_partkey % 4 = 0 THEN 'ramp'
  WHEN p_size * 2.5 <= 60 AND p_retailprice / 40 <= 85 THEN 'part' ELSE 'no' END AS fit FROM part""")
def platform_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    step, gap = F.col("p_size") * 5.0, F.col("p_retailprice") / 20
    b = F.struct((step / 2).alias("step_min"), step.alias("step_max"), (gap / 2).alias("gap_min"), gap.alias("gap_max"), (F.col("p_partkey") % 4 == 0).alias("ramp"), F.when(F.col("p_partkey") % 3 == 0, "front").alias("level_at"))
    return t(spark, sf_dir, "part").select("p_partkey", cost.platform_fit(b, profiles.preset("rollator")).alias("fit"))
