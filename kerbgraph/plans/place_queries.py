"""Streets, lines, places, texts, live states and walkers over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import texts as T
from ..operators import hours, lines, live, places, relational, routing, streets
from ..streaming import navigator
from .registry import query, t

_HIGHWAYS = ("footway", "steps", "residential", "path", "cycleway", "primary", "pedestrian", "track", "living_street", "corridor", "bridleway")


@query(f"""SELECT p_partkey, CASE WHEN foot IN ('no', 'private') OR access IN ('no', 'private') AND coalesce(foot, '') NOT IN ('yes', 'designated') THEN NULL WHEN h IN ('steps', 'pedestrian', 'corridor') THEN h
  WHEN h = 'footway' THEN CASE WHEN fw IN ('sidewalk', 'crossing') THEN fw ELSE 'footway' END WHEN h = 'path' OR h = 'track' OR h = 'cycleway' AND (foot IS NULL OR foot IN ('yes', 'designated')) OR h = 'bridleway' AND foot IN ('yes', 'designated') THEN 'footway'
  WHEN h = 'living_street' THEN 'pedestrian' WHEN h IN ('residential', 'primary') AND coalesce(sw, '') <> 'separate' AND NOT (h = 'primary' AND coalesce(sw, '') = 'no') THEN 'street_proxy' END AS kind
  FROM (SELECT p_partkey, ({list(_HIGHWAYS)})[(p_size % 11 + 1)::INT] AS h, CASE p_partkey % 6 WHEN 0 THEN 'no' WHEN 1 THEN 'yes' WHEN 2 THEN 'designated' END AS foot, CASE p_partkey % 5 WHEN 0 THEN 'private' END AS access,
    CASE p_partkey % 7 WHEN 0 THEN 'sidewalk' WHEN 1 THEN 'crossing' END AS fw, CASE p_partkey % 4 WHEN 0 THEN 'separate' WHEN 1 THEN 'no' WHEN 2 THEN 'both' END AS sw FROM part)""")
def classify_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, key = t(spark, sf_dir, "part"), F.col("p_partkey")
    when = lambda n, *values: F.coalesce(*[F.when(key % n == i, v) for i, v in enumerate(values)])
    tags = F.map_from_arrays(F.array(*[F.lit(x) for x in ("highway", "foot", "access", "footway", "sidewalk")]), F.array(F.element_at(F.array(*[F.lit(h) for h in _HIGHWAYS]), F.col("p_size") % 11 + 1), when(6, "no", "yes", "designated"), when(5, "private"), when(7, "sidewalk", "crossing"), when(4, "separate", "no", "both")))
    return part.withColumn("tags", tags).select("p_partkey", streets.classify().alias("kind"))


@query("""WITH v AS (SELECT l_orderkey AS way, l_partkey AS node, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)::INT AS pos, p_size > 40 AS meaningful FROM lineitem JOIN part ON l_partkey = p_partkey),
  u AS (SELECT node, count(DISTINCT way) AS uses FROM v GROUP BY 1), r AS (SELECT v.*, uses, pos = max(pos) OVER (PARTITION BY way) AS last FROM v JOIN u USING (node)),
  c AS (SELECT *, pos > 1 AND NOT last AND (uses >= 2 OR meaningful) AS cut FROM r), s AS (SELECT *, coalesce(sum(cut::INT) OVER (PARTITION BY way ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM c),
  e AS (SELECT way, seg, pos, node FROM s UNION ALL SELECT way, seg + 1, pos, node FROM s WHERE cut)
  SELECT way, seg::INT AS seg, arg_min(node, pos) AS src, arg_max(node, pos) AS dst, count(*)::INT AS n FROM e GROUP BY 1, 2 HAVING count(*) > 1 AND (arg_min(node, pos) <> arg_max(node, pos) OR count(*) > 2)""")
def split_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as ways through parts: cut where two meet and at large parts."""
    li = t(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    visits = li.select(F.col("l_orderkey").alias("way"), F.row_number().over(w).alias("pos"), F.col("l_partkey").alias("node")).join(t(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), (F.col("p_size") > 40).alias("meaningful")), "node")
    out = streets.cut(visits)
    return out.select("way", "seg", F.element_at("nodes", 1)["node"].alias("src"), F.element_at("nodes", -1)["node"].alias("dst"), F.size("nodes").alias("n"))


_PROFILE = """(SELECT l_orderkey AS k, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING)::DOUBLE AS d, l_discount * 10 AS z FROM lineitem)"""


@query(f"""WITH p AS (SELECT *, max(d) OVER (PARTITION BY k) AS total FROM {_PROFILE}),
  f AS (SELECT a.*, coalesce(b.d, l.d) AS fd, coalesce(b.z, l.z) AS fz FROM p a ASOF LEFT JOIN p b ON a.k = b.k AND b.d >= a.d + 10 LEFT JOIN (SELECT k, max(d) AS d, arg_max(z, d) AS z FROM p GROUP BY 1) l ON l.k = a.k),
  g AS (SELECT *, CASE WHEN fd > d AND fd - d >= least(10, total) * 0.95 THEN (fz - z) / (fd - d) * 100 END AS grade FROM f),
  m AS (SELECT k, max(d) AS length, (arg_max(z, d) - arg_min(z, d)) / nullif(max(d), 0) * 100 AS mean, arg_max(grade, struct_pack(a := abs(grade), b := -d)) AS steep FROM g GROUP BY 1)
  SELECT k, length, round(mean, 6) AS mean, round(CASE WHEN abs(steep) > abs(mean) THEN steep ELSE mean END, 6) AS steepest FROM m""")
def steepest_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as height profiles."""
    li = t(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey").rowsBetween(Window.unboundedPreceding, 0)
    profile = relational.spread(li, li.count(), "l_orderkey").select(F.col("l_orderkey").alias("k"), F.sum("l_quantity").over(w).alias("d"), (F.col("l_discount") * 10).alias("z"))
    return lines.slopes(profile, "k").select("k", "length", F.round("mean", 6).alias("mean"), F.round("steepest", 6).alias("steepest"))


def _says_sql(pattern: str, before: str, after: str) -> str:
    return f"""len(list_filter(range(1, len(m) + 1), lambda i: NOT regexp_matches(substring(text, (greatest(list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) - 24, 0) + 1)::INT,
      least(24, list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::INT), '{before}')
    AND NOT regexp_matches(substring(text, (list_sum(list_transform(b[1:i], lambda x: length(x))) + list_sum(list_transform(m[1:i], lambda x: length(x))) + 1)::INT, 24), '{after}'))) > 0"""


_BAR, _NOT_AHEAD, _NOT_BEHIND = r"(?i)\b(the|les|der|los)\s+\w+", r"(?i)\b(of|que|und|con)\b[\s\w/-]{0,12}$", r"(?i)^[\s:.,-]*(is|was|est|ist)\b"


@query(f"""SELECT lang, count(*) AS n, count(*) FILTER (says) AS closed FROM (SELECT lang, coalesce({_says_sql(_BAR, _NOT_AHEAD, _NOT_BEHIND)}, false) AS says
  FROM (SELECT lang, text, regexp_extract_all(text, '{_BAR}') AS m, string_split_regex(text, '{_BAR}') AS b FROM documents)) GROUP BY 1""")
def text_closed_negated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with a phrase that the words around it don't deny, by language."""
    said = T.says(F.col("text"), _BAR, _NOT_AHEAD, _NOT_BEHIND)
    return t(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count(F.when(said, 1)).alias("closed"))


@query(r"""SELECT source, count(*) FILTER (regexp_matches(text, '(?i)\b(the|is|est|der|los)\b') AND NOT regexp_matches(text, '(?i)^(click|subscribe)|cookie|@') AND n_chars <= 5000) AS kept, count(*) AS n FROM documents GROUP BY 1""")
def keep_topic_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = F.col("text").rlike(T.ascii_edges(r"(?i)\b(the|is|est|der|los)\b")) & ~F.col("text").rlike("(?i)^(click|subscribe)|cookie|@") & (F.col("n_chars") <= 5000)
    return t(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.when(keep, 1)).alias("kept"), F.count("*").alias("n"))


@query("""SELECT a.s_suppkey AS a, b.s_suppkey AS b, round(len(list_intersect(a.w, b.w)) / len(list_distinct(a.w || b.w))::DOUBLE, 6) AS jaccard FROM (SELECT l_suppkey AS s_suppkey, list(DISTINCT p_brand) AS w FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity >= 49 GROUP BY 1) a
  JOIN (SELECT l_suppkey AS s_suppkey, list(DISTINCT p_brand) AS w FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity >= 49 GROUP BY 1) b ON b.s_suppkey = a.s_suppkey + 1""")
def token_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How alike neighbours among suppliers are by the brands of their large lines."""
    sold = t(spark, sf_dir, "lineitem").where("l_quantity >= 49").join(t(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    sets = sold.groupBy("l_suppkey").agg(F.collect_set("p_brand").alias("w"))
    other = sets.select((F.col("l_suppkey") - 1).alias("l_suppkey"), F.col("l_suppkey").alias("b"), F.col("w").alias("v"))
    return sets.join(other, "l_suppkey").select(F.col("l_suppkey").alias("a"), "b", F.round(T.jaccard(F.col("w"), F.col("v")), 6).alias("jaccard"))


@query("SELECT a.p_partkey AS a, b.p_partkey AS b, round(1 - levenshtein(a.p_name, b.p_name) / greatest(length(a.p_name), length(b.p_name))::DOUBLE, 6) AS alike FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def edit_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = t(spark, sf_dir, "part")
    other = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_partkey").alias("b"), F.col("p_name").alias("other"))
    return part.join(other, "p_partkey").select(F.col("p_partkey").alias("a"), "b", F.round(T.edit_similarity(F.col("p_name"), F.col("other")), 6).alias("alike"))


@query("""SELECT p_partkey FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_partkey <> a.p_partkey AND b.p_brand = a.p_brand AND b.p_size = a.p_size AND 1 - levenshtein(a.p_name, b.p_name) / greatest(length(a.p_name), length(b.p_name))::DOUBLE >= 0.5)""")
def left_anti_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts like no other of their brand and size. Names are few, so they are compared once a name, not once a part."""
    part = t(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", "p_name")
    names = part.groupBy("p_brand", "p_size", "p_name").agg(F.count("*").alias("n"))
    other = names.select("p_brand", "p_size", F.col("p_name").alias("other"), F.col("n").alias("m"))
    like = names.join(other, ["p_brand", "p_size"]).where(((F.col("p_name") != F.col("other")) & (T.edit_similarity(F.col("p_name"), F.col("other")) >= 0.5)) | ((F.col("p_name") == F.col("other")) & (F.col("n") > 1)))
    return part.join(like.select("p_brand", "p_size", "p_name").distinct(), ["p_brand", "p_size", "p_name"], "left_anti").select("p_partkey")


@query("""SELECT s_suppkey FROM supplier a WHERE NOT EXISTS (SELECT 1 FROM supplier b WHERE b.s_suppkey < a.s_suppkey AND b.s_nationkey = a.s_nationkey AND abs(a.s_acctbal - b.s_acctbal) < 900)""")
def near_duplicate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers that none before them in their nation comes near: balances are cut into ranges as wide as the tolerance."""
    s = t(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal", F.floor(F.col("s_acctbal") / 900).alias("range"))
    other = s.select("s_nationkey", "range", F.col("s_suppkey").alias("b"), F.col("s_acctbal").alias("bal"))
    asked = s.withColumn("range", F.explode(F.array(*[F.col("range") + i for i in (-1, 0, 1)])))
    near = asked.join(other, ["s_nationkey", "range"]).where((F.col("b") < F.col("s_suppkey")) & (F.abs(F.col("s_acctbal") - F.col("bal")) < 900))
    return s.select("s_suppkey").join(near.select("s_suppkey"), "s_suppkey", "left_anti")


@query("""WITH s AS (SELECT o_custkey, o_orderkey, o_orderstatus, o_orderdate AS f, o_orderdate + INTERVAL 40 DAY AS u FROM orders WHERE o_orderdate + INTERVAL 40 DAY > TIMESTAMP '1997-06-01')
  SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY f > TIMESTAMP '1997-06-01', CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'P' THEN 1 ELSE 2 END, f, o_orderkey) AS n FROM s) WHERE n = 1""")
def current_or_next_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as states of 40 days: one in force before one to come, then the stronger, then the sooner."""
    status = F.col("o_orderstatus")
    states = t(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderkey", F.col("o_orderkey").alias("feed"), F.when(status == "O", "restricted").otherwise("closed").alias("status"), F.when(status == "P", "step-free").alias("affects"),
        F.col("o_orderdate").alias("valid_from"), (F.col("o_orderdate") + F.expr("interval 40 days")).alias("valid_until"),
    )
    return live.current_or_next(states, "o_custkey", F.lit("1997-06-01").cast("timestamp_ntz")).select("o_custkey", "o_orderkey")


@query("""WITH d AS (SELECT l_suppkey AS request, l_partkey AS edge, l_returnflag AS name, max(l_quantity) AS length_m, max(CASE WHEN l_linestatus = 'O' THEN 'incline' ELSE 'surface' END) AS attr, max(l_extendedprice) AS s FROM lineitem WHERE l_quantity > 25 GROUP BY 1, 2, 3),
  x AS (SELECT d.*, length_m > 49 AS bad FROM d WHERE NOT EXISTS (SELECT 1 FROM lineitem c WHERE c.l_suppkey = request AND c.l_partkey = edge AND c.l_quantity <= 25) AND (length_m > 49 OR s > 30000)),
  g AS (SELECT request, name, bool_or(bad) AS bad, sum(length_m) AS length_m, max(struct_pack(s := CASE WHEN bad THEN 'inf'::DOUBLE ELSE s END, k := CASE WHEN bad THEN 'excluded' ELSE 'penalty' END, a := attr)) AS w FROM x GROUP BY 1, 2)
  SELECT request, name, w.a AS attr, w.k AS kind, length_m, row_number() OVER (PARTITION BY request ORDER BY w.k <> 'excluded', length_m DESC, name)::INT AS rank FROM g""")
def explain_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier's large lines as the direct route, its small ones as the chosen one: what is gone round, and why."""
    li = t(spark, sf_dir, "lineitem")
    direct = li.where("l_quantity > 25").groupBy(F.col("l_suppkey").alias("request"), F.col("l_partkey").alias("edge"), F.col("l_returnflag").alias("name")).agg(F.max("l_quantity").alias("length_m"), F.max(F.when(F.col("l_linestatus") == "O", "incline").otherwise("surface")).alias("attr"), F.max("l_extendedprice").alias("s"))
    bad = F.col("length_m") > 49
    reason = F.struct(F.when(bad, "excluded").otherwise("penalty").alias("kind"), F.col("attr"), F.when(bad, F.lit(float("inf"))).when(F.col("s") > 30000, F.col("s")).otherwise(0.0).alias("seconds"))
    chosen = li.where("l_quantity <= 25").select(F.col("l_suppkey").alias("request"), F.col("l_partkey").alias("edge"))
    return routing.avoided(chosen, direct.withColumn("reasons", F.array(reason))).select("request", "name", "attr", "kind", "length_m", "rank")


_POINTS = "(SELECT vec_id, label, -3.19 + embedding[1]::DOUBLE * 0.02::DOUBLE AS lon, 55.95 + embedding[2]::DOUBLE * 0.01::DOUBLE AS lat FROM embeddings)"
_DIST = "2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"


@query(f"SELECT a, b, round(d, 3) AS distance_m FROM (SELECT a.vec_id AS a, b.vec_id AS b, {_DIST} AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_DIST}, b.vec_id) AS n FROM {_POINTS} a JOIN {_POINTS} b ON a.label <> b.label WHERE {_DIST} <= 300) WHERE n = 1")
def nearest_neighbour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest point of another label within 300 m."""
    e = t(spark, sf_dir, "embeddings").select("vec_id", "label", (F.lit(-3.19) + F.col("embedding")[0].cast("double") * 0.02).alias("lon"), (F.lit(55.95) + F.col("embedding")[1].cast("double") * 0.01).alias("lat"))
    side = lambda k: e.select(F.col("vec_id").alias(k), "lon", "lat", "label")
    return relational.nearest_join(side("a"), side("b"), 300.0, unlike="label").select("a", "b", F.round("distance_m", 3).alias("distance_m"))


@query("""SELECT p_partkey, p_name FROM part WHERE list_bool_and(list_transform(['s', 'b'], lambda q: len(list_filter(string_split(lower(p_name), ' '), lambda w: starts_with(w, q))) > 0)) OR starts_with(replace(lower(p_name), ' ', ''), 'sb')""")
def prefix_token_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts whose name answers the words 's b', in whatever order, through the index of beginnings."""
    part = t(spark, sf_dir, "part")
    index = places.entries(part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.lit("").alias("extra"), F.lit(2).alias("rank"), F.lit(None).cast("string").alias("cat"), F.lit(True).alias("accessible"), (F.lit(-3.2) + F.col("p_partkey") * 0.01).alias("lon"), F.lit(55.9).alias("lat")))
    asked = spark.createDataFrame([(1, "s b", -3.2, 55.9)], "ask int, q string, lon double, lat double")
    hits, _ = places.search(asked, index, limit=None)
    return hits.select(F.col("id").alias("p_partkey"), F.col("name").alias("p_name"))


@query()
def place_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word that parts' names hold, typed by itself and with an access word: the best 25 hits of each."""
    part = t(spark, sf_dir, "part")
    kinds = F.when(F.col("p_type") == "SMALL", "amenity=cafe").when(F.col("p_type") == "ECONOMY", "amenity=toilets")
    index = places.entries(part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("extra"), (F.col("p_size") % 4).alias("rank"), kinds.alias("cat"), (F.col("p_size") % 2 == 0).alias("accessible"), (F.lit(-3.2) + F.col("p_size") * 0.001).alias("lon"), (F.lit(55.9) + F.col("p_partkey") % 10 * 0.001).alias("lat")))
    words = part.select(F.explode(F.split(F.lower("p_name"), " ")).alias("q")).distinct()
    more = words.union(words.select(F.concat(F.lit("accessible cafe "), F.substring("q", 1, 2)))).withColumn("ask", F.xxhash64("q")).withColumn("lon", F.lit(-3.19)).withColumn("lat", F.lit(55.9))
    hits, _ = places.search(more, index)
    return hits.join(more.select("ask", "q"), "ask").select("q", "rank", "id", "name", F.round("score", 4).alias("score"))


@query()
def opening_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders ask of a part's opening hours: what it says at their time."""
    part, size = t(spark, sf_dir, "part"), F.col("p_size")
    hour = lambda c: F.lpad(c.cast("string"), 2, "0")
    text = F.when(size % 5 == 0, "24/7").when(size % 5 == 1, F.concat(F.lit("Mo-Fr "), hour(size % 12), F.lit(":00-"), hour(size % 10 + 12), F.lit(":30; Sa 10:00-16:00; Su off"))).when(size % 5 == 2, "Mo-Su 11:00-01:00, We 08:00-09:00").when(size % 5 == 3, "Fr-Mo 09:00-12:00,13:00-17:00; PH off").otherwise("sunrise-sunset")
    said = hours.parse(part.select(F.col("p_partkey").alias("id"), text.alias("hours")))
    n = F.lit(1) + part.agg(F.max("p_partkey")).first()[0]
    asked = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ask"), (F.col("o_orderkey") % n).alias("id"), (F.col("o_orderdate").cast("timestamp") + F.make_interval(hours=(F.col("o_orderkey") % 24).cast("int"))).alias("t"))
    return hours.status(asked, said)


@query()
def navigator_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as walkers on a straight line north, their events as fixes."""
    events = t(spark, sf_dir, "events")
    at = C.micros("ts")
    fixes = events.select(F.col("user_id").cast("string").alias("session"), F.col("ts").cast("timestamp").alias("t"), (F.lit(-3.19) + (F.col("event_id") % 7) * 0.0001).alias("lon"), (F.lit(55.95) + (at - 1_704_067_200_000_000) / (30 * 86_400_000_000) * 0.02).alias("lat"), F.lit(10.0).alias("accuracy"))
    line = F.expr("transform(sequence(0, 20), i -> named_struct('lon', -3.19D, 'lat', 55.95D + i * 0.001D))")
    cum = F.expr("transform(sequence(0, 20), i -> i * 111.32D)")
    told = F.expr("array(named_struct('at', 500D, 'text', 'Turn left'))"), F.expr("array(named_struct('at', 900D, 'length', 50D, 'text', 'Setts'))"), F.expr("array(named_struct('start', 1200D, 'end', 1700D, 'alight', 'Mound'))")
    plans = fixes.select("session").distinct().select("session", line.alias("line"), cum.alias("cum"), told[0].alias("turns"), told[1].alias("hazards"), told[2].alias("rides"))
    return navigator.follow(fixes, plans).select("session", "t", F.round("along", 3).alias("along"), "off_route", "arrived", "said")
