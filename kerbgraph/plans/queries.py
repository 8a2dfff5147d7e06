"""The engine's operators applied to the driver's tables, each with a SQL twin. Names follow the blueprint's binding table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import graph, relational
from . import cost_queries, graph_queries, overlay_queries, path_queries, place_queries, terrain_queries, upload_queries  # noqa: F401
from .registry import QUERIES, SQL, query, t  # noqa: F401


#: 2024-02-01 in microseconds: "now" of the queries over events.
NOW = 1_706_745_600_000_000
DAY = 86_400_000_000
HALF_LIVES = (365.0, 730.0, 5.0, 7.0, 180.0)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "events").withColumn("at", C.micros("ts")).withColumn("k", F.get_json_object("props", "$.k").cast("int"))


_EVENTS = "(SELECT *, epoch_us(ts) AS tm, json_extract_string(props, '$.k')::INT AS k FROM events)"
_STATE = "CASE event_type WHEN 'purchase' THEN 'verified' WHEN 'signup' THEN 'inferred' WHEN 'error' THEN 'unknown' ELSE 'reported' END"


def state_of(kind: Column) -> Column:
    return F.when(kind == "purchase", "verified").when(kind == "signup", "inferred").when(kind == "error", "unknown").otherwise("reported")


@query(f"""SELECT event_id, s AS state, round(CASE s WHEN 'unknown' THEN 0 WHEN 'verified' THEN 0.95 * pow(0.5, age / (1095.75 * m))
  WHEN 'inferred' THEN 0.7 * pow(0.5, age / (1826.25 * m)) ELSE least(0.9, 0.6 + 0.1 * (k % 5)) * pow(0.5, age / (730.5 * m)) END, 6) AS confidence
  FROM (SELECT event_id, k, {_STATE} AS s, greatest(({NOW} - tm) / {DAY}.0::DOUBLE, 0) AS age, CASE WHEN k % 10 = 0 THEN 4.0 ELSE 1.0 END::DOUBLE AS m FROM {_EVENTS})""")
def confidence_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = events(spark, sf_dir).withColumn("state", state_of(F.col("event_type")))
    age = (F.lit(NOW) - F.col("at")) / float(DAY)
    return df.select("event_id", "state", F.round(C.confidence(F.col("state"), age, F.col("k") % 5, F.col("k") % 10 == 0), 6).alias("confidence"))


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    life = F.element_at(F.array(*[F.lit(x) for x in HALF_LIVES]), F.col("k") % 5 + 1)
    weight = C.decayed(F.lit(1.0), (F.lit(NOW) - F.col("at")) / float(DAY), life)
    votes = events(spark, sf_dir).withColumn("w", weight).withColumn("yes", F.col("event_type").isin("click", "purchase", "signup"))
    found = votes.groupBy("k").agg(F.sum(F.when(F.col("yes"), F.col("w")).otherwise(0.0)).alias("support"), F.sum(F.when(~F.col("yes"), F.col("w")).otherwise(0.0)).alias("against"), F.countDistinct("user_id").alias("voters"), F.max(F.when(F.col("yes"), F.col("at"))).alias("last_seen"))
    return found.withColumn("level", C.evidence_level(F.col("support"), F.col("against")))


_EVIDENCE = f"""(SELECT *, CASE WHEN support / (support + against + 1) < 0.3 THEN 'faded' WHEN against >= 0.75 * support THEN 'disputed' WHEN support / (support + against + 1) >= 0.7 THEN 'confirmed' ELSE 'reported' END AS level FROM
  (SELECT k, sum(CASE WHEN event_type IN ('click','purchase','signup') THEN w ELSE 0 END) AS support, sum(CASE WHEN event_type IN ('click','purchase','signup') THEN 0 ELSE w END) AS against,
    count(DISTINCT user_id) AS voters, max(CASE WHEN event_type IN ('click','purchase','signup') THEN tm END) AS last_seen
   FROM (SELECT *, pow(0.5, greatest(({NOW} - tm) / {DAY}.0::DOUBLE, 0) / ([365.0, 730.0, 5.0, 7.0, 180.0]::DOUBLE[])[k % 5 + 1]) AS w FROM {_EVENTS}) GROUP BY k))"""


@query(f"SELECT k, round(support, 5) AS support, round(against, 5) AS against, voters, last_seen, level FROM {_EVIDENCE}")
def evidence_by_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evidence(spark, sf_dir).select("k", F.round("support", 5).alias("support"), F.round("against", 5).alias("against"), "voters", "last_seen", "level")


@query(f"SELECT level, count(*) AS reports FROM {_EVIDENCE} GROUP BY 1")
def evidence_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evidence(spark, sf_dir).groupBy("level").agg(F.count("*").alias("reports"))


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return relational.best_per_key(t(spark, sf_dir, "orders"), ["o_custkey", "o_orderpriority"], rank, F.coalesce(-C.micros("o_orderdate"), F.lit((1 << 63) - 1)), "o_orderkey")


_RESOLVED = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderdate DESC NULLS LAST, o_orderkey) AS n FROM orders) WHERE n = 1)"


@query(f"SELECT o_custkey, o_orderpriority, o_orderkey, o_orderstatus FROM {_RESOLVED}")
def resolver_best_observation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir).select("o_custkey", "o_orderpriority", "o_orderkey", "o_orderstatus")


_PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@query(f"SELECT o_custkey, {', '.join(f'max(CASE WHEN o_orderpriority = {p!r} THEN o_orderkey END) AS p{p[0]}' for p in _PRIORITIES)} FROM {_RESOLVED} GROUP BY 1")
def resolver_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = _resolved(spark, sf_dir).groupBy("o_custkey").pivot("o_orderpriority", list(_PRIORITIES)).agg(F.max("o_orderkey"))
    return wide.select("o_custkey", *[F.col(f"`{p}`").alias(f"p{p[0]}") for p in _PRIORITIES])


@query(f"SELECT user_id, event_id, event_type, tm FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY tm DESC, event_id) AS n FROM {_EVENTS}) WHERE n = 1")
def latest_event_per_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.latest_per_key(events(spark, sf_dir), ["user_id"], "at", "event_id", ["event_id", "event_type", "at"]).withColumnRenamed("at", "tm")


@query(f"SELECT k, user_id, event_type AS vote FROM (SELECT *, row_number() OVER (PARTITION BY k, user_id ORDER BY tm DESC, event_id) AS n FROM {_EVENTS}) WHERE n = 1")
def vote_latest_per_voter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.latest_per_key(events(spark, sf_dir), ["k", "user_id"], "at", "event_id", ["event_type"]).withColumnRenamed("event_type", "vote")


@query(f"""SELECT a.event_id, count(DISTINCT b.user_id) AS others FROM {_EVENTS} a LEFT JOIN {_EVENTS} b
  ON a.k = b.k AND a.event_type = b.event_type AND a.user_id <> b.user_id AND abs(a.tm - b.tm) <= {2 * DAY} GROUP BY 1""")
def corroboration_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Other people who say the same of the same thing within two days."""
    e = events(spark, sf_dir).select("event_id", "k", "event_type", "user_id", "at")
    return relational.others_within(e, ["k", "event_type"], "user_id", "at", "event_id", 2 * DAY)


@query(f"""SELECT k, round(list_reduce(list_prepend(0.0::DOUBLE, list(w ORDER BY event_id)), lambda s, x: greatest(-2.0, least(2.0, s + x))), 6) AS total, count(*) AS n
  FROM (SELECT *, CASE event_type WHEN 'purchase' THEN 1.0 WHEN 'click' THEN 0.25 WHEN 'error' THEN -1.0 ELSE -0.4 END::DOUBLE AS w FROM {_EVENTS}) GROUP BY k""")
def note_signal_clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    weight = F.when(F.col("event_type") == "purchase", 1.0).when(F.col("event_type") == "click", 0.25).when(F.col("event_type") == "error", -1.0).otherwise(-0.4)
    return relational.clamped_fold(events(spark, sf_dir).withColumn("w", weight), "k", "event_id", "w", -2.0, 2.0).withColumn("total", F.round("total", 6))


@query(f"""SELECT e.k, count(DISTINCT e.user_id) AS flaggers FROM {_EVENTS} e LEFT JOIN (SELECT k, max(tm) AS seen FROM {_EVENTS} WHERE event_type = 'purchase' GROUP BY 1) r ON e.k = r.k
  WHERE e.event_type = 'error' AND e.tm > coalesce(r.seen, 0) GROUP BY 1 HAVING count(DISTINCT e.user_id) >= 2""")
def flag_threshold_hide(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    seen = e.where("event_type = 'purchase'").groupBy("k").agg(F.max("at").alias("seen"))
    flags = e.where("event_type = 'error'").join(seen, "k", "left").where(F.col("at") > F.coalesce("seen", F.lit(0)))
    return flags.groupBy("k").agg(F.countDistinct("user_id").alias("flaggers")).where("flaggers >= 2")


@query(f"SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY tm RANGE BETWEEN {DAY} PRECEDING AND CURRENT ROW) AS in_day FROM {_EVENTS}")
def rolling_day_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("at").rangeBetween(-DAY, 0)
    return events(spark, sf_dir).select("event_id", F.count("*").over(w).alias("in_day"))


@query(f"SELECT k, string_agg(event_type || '@' || (tm // 3600000000), ',' ORDER BY tm, event_id) AS votes FROM {_EVENTS} GROUP BY 1")
def public_vote_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat("event_type", F.lit("@"), F.floor(F.col("at") / 3_600_000_000).cast("string"))
    lists = events(spark, sf_dir).groupBy("k").agg(F.array_sort(F.collect_list(F.struct("at", "event_id", said.alias("said")))).alias("v"))
    return lists.select("k", F.array_join("v.said", ",").alias("votes"))


@query("SELECT sha256(user_id::VARCHAR || 'pepper') AS author, count(*) AS n FROM events GROUP BY 1")
def pseudonym_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n")).select(F.sha2(F.concat(F.col("user_id").cast("string"), F.lit("pepper")), 256).alias("author"), "n")


@query(f"""WITH a AS (SELECT k, user_id, min(event_id) AS event_id FROM {_EVENTS} WHERE event_type = 'purchase' GROUP BY 1, 2), b AS (SELECT k, user_id, min(event_id) AS event_id FROM {_EVENTS} WHERE event_type = 'click' GROUP BY 1, 2)
  SELECT * FROM a UNION ALL SELECT b.* FROM b ANTI JOIN a USING (k, user_id)""")
def merge_local_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    pick = lambda kind: e.where(F.col("event_type") == kind).groupBy("k", "user_id").agg(F.min("event_id").alias("event_id"))
    return relational.merge_first_wins(pick("purchase"), pick("click"), ["k", "user_id"])


_STRENGTH = "CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END"


@query(f"SELECT l_partkey, l_returnflag, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY {_STRENGTH}, l_orderkey, l_linenumber, l_suppkey) AS n FROM lineitem) WHERE n = 1")
def overlay_stronger_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    return relational.best_per_key(t(spark, sf_dir, "lineitem"), ["l_partkey"], rank, "l_orderkey", "l_linenumber", "l_suppkey").select("l_partkey", "l_returnflag", "l_orderkey", "l_linenumber")


@query(f"""WITH c AS (SELECT k, user_id, event_type AS source, min(event_id) AS event_id FROM {_EVENTS} GROUP BY 1, 2, 3), i AS (SELECT k, user_id, 'click' AS source, max(event_id) AS event_id FROM {_EVENTS} WHERE event_type = 'click' GROUP BY 1, 2),
  r AS (SELECT * FROM c WHERE source NOT IN ('click', 'view')) SELECT * FROM r UNION ALL SELECT i.* FROM i ANTI JOIN r USING (k, user_id)""")
def replace_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    current = e.groupBy("k", "user_id", F.col("event_type").alias("source")).agg(F.min("event_id").alias("event_id"))
    incoming = e.where("event_type = 'click'").groupBy("k", "user_id").agg(F.max("event_id").alias("event_id")).select("k", "user_id", F.lit("click").alias("source"), "event_id")
    return relational.replace_by_source(current, incoming, ["click", "view"], ["k", "user_id"])


@query(f"""SELECT d.day::INT AS day, count(*) AS active FROM (SELECT unnest(range(0, 30)) AS day) d JOIN {_EVENTS} e
  ON e.tm <= 1704067200000000 + d.day * {DAY} AND 1704067200000000 + d.day * {DAY} < e.tm + (e.k % 7 + 1) * {DAY} GROUP BY 1""")
def live_active_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States in force per day. Each state is expanded to the days it covers, so nothing is compared with every day."""
    first = 1_704_067_200_000_000
    e = events(spark, sf_dir).select("at", (F.col("at") + (F.col("k") % 7 + 1) * DAY).alias("until"))
    lo = F.ceil((F.col("at") - first) / float(DAY)).cast("int")
    hi = (F.ceil((F.col("until") - first) / float(DAY)) - 1).cast("int")
    days = e.select(F.explode(F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))).alias("day"))
    return days.where("day between 0 and 29").groupBy("day").agg(F.count("*").alias("active"))


@query(f"""SELECT o.o_orderkey, e.event_id FROM (SELECT o_orderkey, o_orderkey % 150 AS user_id, 1704067200000000 + (o_orderkey % 30) * {DAY} AS t FROM orders) o
  ASOF LEFT JOIN (SELECT user_id, tm, max(event_id) AS event_id FROM {_EVENTS} GROUP BY 1, 2) e ON o.user_id = e.user_id AND e.tm <= o.t""")
def asof_last_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event at or before an instant: both sides in one ordered window, no join of every pair."""
    asked = t(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 150).alias("user_id"), (F.lit(1_704_067_200_000_000) + (F.col("o_orderkey") % 30) * DAY).alias("at"))
    both = events(spark, sf_dir).select(F.lit(None).cast("long").alias("o_orderkey"), "user_id", "at", "event_id").unionByName(asked.withColumn("event_id", F.lit(None).cast("long")))
    w = Window.partitionBy("user_id").orderBy("at", F.col("o_orderkey").isNotNull(), "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("event_id", F.last("event_id", ignorenulls=True).over(w)).where("o_orderkey is not null").select("o_orderkey", "event_id")


@query(f"""SELECT event_id, CASE WHEN event_type <> 'error' THEN value WHEN tm - held.tm <= 900000000 THEN held.value END AS shown FROM
  (SELECT event_id, event_type, value, tm, last_value(CASE WHEN event_type <> 'error' THEN struct_pack(value := value, tm := tm) END IGNORE NULLS) OVER (PARTITION BY k ORDER BY tm, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS held FROM {_EVENTS})""")
def hold_last_good(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of a key; for an error the last good one of its key, if at most 15 minutes old.

    An error asks the slots of 15 minutes of its own time and the one before, so the window runs over a key and slot, never a whole key.
    """
    slot = F.floor(F.col("at") / 900_000_000).cast("long")
    e = events(spark, sf_dir).select("event_id", "event_type", "value", "at", "k")
    rows = e.withColumn("own", F.lit(True)).withColumn("slot", slot)
    rows = rows.unionByName(rows.where("event_type <> 'error'").withColumn("own", F.lit(False)).withColumn("slot", F.col("slot") + 1))
    good = F.when(F.col("event_type") != "error", F.struct("value", "at"))
    w = Window.partitionBy("k", "slot").orderBy("at", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    df = rows.withColumn("held", F.last(good, ignorenulls=True).over(w)).where("own")
    return df.select("event_id", F.when(F.col("event_type") != "error", F.col("value")).when(F.col("at") - F.col("held.at") <= 900_000_000, F.col("held.value")).alias("shown"))


@query(f"""SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY tm RANGE BETWEEN 10800000000 PRECEDING AND CURRENT ROW), 4) AS past3,
  round(min(value) OVER (PARTITION BY user_id ORDER BY tm RANGE BETWEEN 43200000000 PRECEDING AND CURRENT ROW), 4) AS low12 FROM {_EVENTS}""")
def trailing_3h_12h(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("at")
    hour = 3_600_000_000
    return events(spark, sf_dir).select("event_id", F.round(F.sum("value").over(w.rangeBetween(-3 * hour, 0)), 4).alias("past3"), F.round(F.min("value").over(w.rangeBetween(-12 * hour, 0)), 4).alias("low12"))


_DAYTYPE = "CASE dayofweek(ts) WHEN 0 THEN 'su' WHEN 6 THEN 'sa' ELSE 'wd' END"


def _hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.when(F.dayofweek("ts") == 1, "su").when(F.dayofweek("ts") == 7, "sa").otherwise("wd")
    return t(spark, sf_dir, "events").groupBy("event_type", day.alias("day_type"), F.hour("ts").alias("hour")).agg(F.count("*").alias("n"))


_HOURS = f"(SELECT event_type, {_DAYTYPE} AS day_type, hour(ts)::INT AS hour, count(*) AS n FROM events GROUP BY 1, 2, 3)"


@query(f"SELECT * FROM {_HOURS}")
def hour_of_day_departures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hours(spark, sf_dir)


@query(f"""SELECT a.event_type, a.day_type, a.hour, round(CASE WHEN a.n > 0 THEN greatest(60, 3600 / (2.0 * a.n)) END, 4) AS wait_s, b.n AS next_n
  FROM {_HOURS} a LEFT JOIN {_HOURS} b ON a.event_type = b.event_type AND a.day_type = b.day_type AND b.hour = (a.hour + 1) % 24""")
def expected_wait(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _hours(spark, sf_dir)
    after = h.select("event_type", "day_type", F.pmod(F.col("hour") + 23, F.lit(24)).alias("hour"), F.col("n").alias("next_n"))
    wait = F.greatest(F.lit(60.0), F.lit(3600.0) / (F.lit(2.0) * F.col("n")))
    return h.join(after, ["event_type", "day_type", "hour"], "left").select("event_type", "day_type", "hour", F.round(wait, 4).alias("wait_s"), "next_n")


@query(f"""SELECT event_type, nxt, round(median(gap), 4) AS gap_s, count(*) AS n FROM (SELECT event_type, lead(event_type) OVER w AS nxt, (lead(tm) OVER w - tm) / 1e6 AS gap FROM {_EVENTS} WINDOW w AS (PARTITION BY user_id ORDER BY tm, event_id))
  WHERE nxt IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2""")
def consecutive_run_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("at", "event_id")
    df = events(spark, sf_dir).select("event_type", F.lead("event_type").over(w).alias("nxt"), ((F.lead("at").over(w) - F.col("at")) / 1e6).alias("gap")).where("nxt is not null")
    return df.groupBy("event_type", "nxt").agg(F.round(F.median("gap"), 4).alias("gap_s"), F.count("*").alias("n")).where("n >= 2")


@query(f"""SELECT user_id, run::BIGINT AS run, min(event_type) AS event_type, count(*) AS n FROM (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY tm, event_id) - 1 AS run FROM
  (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY tm, event_id) THEN 0 ELSE 1 END AS c FROM {_EVENTS})) GROUP BY 1, 2""")
def gaps_and_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.runs(events(spark, sf_dir), "user_id", ["at", "event_id"], "event_type").groupBy("user_id", "run").agg(F.min("event_type").alias("event_type"), F.count("*").alias("n"))


@query(f"""SELECT user_id, min(tm) AS start, max(stop) AS stop, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY tm, stop) AS island FROM
  (SELECT *, CASE WHEN tm <= max(stop) OVER (PARTITION BY user_id ORDER BY tm, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM
  (SELECT user_id, tm, tm + (k + 1)::BIGINT * 600000000 AS stop FROM {_EVENTS}))) GROUP BY user_id, island""")
def interval_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = events(spark, sf_dir).select("user_id", F.col("at").alias("start"), (F.col("at") + (F.col("k") + 1).cast("long") * 600_000_000).alias("stop"))
    return relational.merge_intervals(spans, "user_id", "start", "stop")


@query(f"""SELECT user_id, max(gap) AS longest FROM (SELECT user_id, tm - lag(tm) OVER (PARTITION BY user_id ORDER BY tm) AS gap FROM
  (SELECT user_id, tm FROM {_EVENTS} WHERE event_type = 'purchase' UNION ALL SELECT DISTINCT user_id, unnest([1704067200000000, {NOW}]) FROM events)) GROUP BY 1""")
def longest_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    ends = e.select("user_id").distinct().withColumn("at", F.explode(F.array(F.lit(1_704_067_200_000_000), F.lit(NOW))))
    stops = e.where("event_type = 'purchase'").select("user_id", "at").union(ends)
    gap = F.col("at") - F.lag("at").over(Window.partitionBy("user_id").orderBy("at"))
    return stops.withColumn("gap", gap).groupBy("user_id").agg(F.max("gap").alias("longest"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING) AS along FROM lineitem")
def cumulative_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey").rowsBetween(Window.unboundedPreceding, 0)
    return t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.sum("l_quantity").over(w).alias("along"))


@query("""SELECT l_suppkey, sum(l_quantity) FILTER (l_returnflag = 'A') AS a_m, sum(l_quantity) FILTER (l_returnflag = 'N') AS n_m, sum(l_quantity) FILTER (l_returnflag = 'R') AS r_m,
  round(sum(l_quantity * (1 - l_discount)) / sum(l_quantity), 6) AS confidence, max(abs(l_discount - 0.05)) AS worst FROM lineitem GROUP BY 1""")
def route_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    metres = lambda flag: F.sum(F.when(F.col("l_returnflag") == flag, F.col("l_quantity"))).alias(f"{flag.lower()}_m")
    return t(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(metres("A"), metres("N"), metres("R"), F.round(F.sum(F.col("l_quantity") * (1 - F.col("l_discount"))) / F.sum("l_quantity"), 6).alias("confidence"), F.max(F.abs(F.col("l_discount") - 0.05)).alias("worst"))


@query("SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS metres, round(sum(l_quantity) FILTER (l_linestatus = 'F') / sum(l_quantity), 6) AS mapped FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), ())")
def coverage_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = t(spark, sf_dir, "lineitem").groupingSets([["l_returnflag"], []], "l_returnflag")
    return df.agg(F.count("*").alias("n"), F.sum("l_quantity").alias("metres"), F.round(F.sum(F.when(F.col("l_linestatus") == "F", F.col("l_quantity"))) / F.sum("l_quantity"), 6).alias("mapped"))


@query("SELECT l_suppkey, list_sort(list(l_extendedprice))[least(floor(count(*) * 0.75)::INT + 1, count(*))] AS at_share FROM lineitem GROUP BY 1")
def index_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.index_percentile(t(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_extendedprice", 0.75)


@query("""SELECT l_suppkey, CASE WHEN r >= 0.25 * n THEN 'R' WHEN a >= 0.5 * n THEN 'A' WHEN o >= 0.5 * n THEN 'N' END AS surface FROM
  (SELECT l_suppkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R' AND l_quantity > 25) AS r, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'N') AS o FROM lineitem GROUP BY 1)""")
def mode_with_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    many = lambda c: F.count(F.when(c, 1))
    flag = F.col("l_returnflag")
    df = t(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), many((flag == "R") & (F.col("l_quantity") > 25)).alias("r"), many(flag == "A").alias("a"), many(flag == "N").alias("o"))
    return df.select("l_suppkey", F.when(F.col("r") >= 0.25 * F.col("n"), "R").when(F.col("a") >= 0.5 * F.col("n"), "A").when(F.col("o") >= 0.5 * F.col("n"), "N").alias("surface"))


@query("""SELECT p, m, n, before FROM (SELECT *, lag(n) OVER (PARTITION BY p ORDER BY m) AS before FROM (SELECT o_orderpriority AS p, (year(o_orderdate) * 12 + month(o_orderdate))::INT AS m, count(*) AS n FROM orders GROUP BY 1, 2)) WHERE n < 0.9 * before""")
def drop_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = t(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("p"), (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("m")).agg(F.count("*").alias("n"))
    return months.withColumn("before", F.lag("n").over(Window.partitionBy("p").orderBy("m"))).where("n < 0.9 * before")


_RANK = "CASE WHEN s_acctbal > 5000 THEN 0 WHEN s_acctbal > 0 THEN 1 ELSE 2 END"


@query(f"SELECT s_nationkey, s_suppkey, n AS rank FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY {_RANK}, s_suppkey) AS n FROM supplier) WHERE n <= 3")
def rank_topk_stable(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.when(F.col("s_acctbal") > 5000, 0).when(F.col("s_acctbal") > 0, 1).otherwise(2)
    top, _ = relational.top_with_rest(t(spark, sf_dir, "supplier"), "s_nationkey", 3, rank, F.col("s_suppkey"))
    return top.select("s_nationkey", "s_suppkey", "rank")


@query("""SELECT c_nationkey, c_custkey::VARCHAR AS shown FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS n FROM customer) WHERE n <= 3
  UNION ALL SELECT c_nationkey, (count(*) - 3) || ' more' FROM customer GROUP BY 1 HAVING count(*) > 3""")
def overflow_remainder(spark: SparkSession, sf_dir: str) -> DataFrame:
    top, rest = relational.top_with_rest(t(spark, sf_dir, "customer"), "c_nationkey", 3, F.desc("c_acctbal"), F.col("c_custkey"))
    return top.select("c_nationkey", F.col("c_custkey").cast("string").alias("shown")).union(rest.select("c_nationkey", F.concat(F.col("more").cast("string"), F.lit(" more"))))


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", (F.lit(-3.19) + F.col("embedding")[0].cast("double") * 0.02).alias("lon"), (F.lit(55.95) + F.col("embedding")[1].cast("double") * 0.01).alias("lat"))


_POINTS = "(SELECT vec_id, label, -3.19 + embedding[1]::DOUBLE * 0.02::DOUBLE AS lon, 55.95 + embedding[2]::DOUBLE * 0.01::DOUBLE AS lat FROM embeddings)"
_DIST = "2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"
_NEAR = f"(SELECT a.vec_id AS a, b.vec_id AS b, {_DIST} AS d FROM {_POINTS} a JOIN {_POINTS} b ON a.label < 5 AND b.label >= 5 WHERE {_DIST} <= 400)"


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = _points(spark, sf_dir)
    return p.where("label < 5").select(F.col("vec_id").alias("a"), "lon", "lat"), p.where("label >= 5").select(F.col("vec_id").alias("b"), "lon", "lat")


@query(f"SELECT a, b, round(d, 3) AS distance_m FROM {_NEAR}")
def within_radius_haversine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.within_join(*_sides(spark, sf_dir), 400.0).select("a", "b", F.round("distance_m", 3).alias("distance_m"))


@query(f"SELECT a, b, n AS rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b)::INT AS n FROM {_NEAR}) WHERE n <= 3")
def nearest_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.nearest_join(*_sides(spark, sf_dir), 400.0, 3).select("a", "b", "rank")


_ARCS = """SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier"""


@query(f"""WITH RECURSIVE arcs AS ({_ARCS}), w(root, node, hops) AS (SELECT 'r' || r_regionkey, 'r' || r_regionkey, 0 FROM region UNION ALL SELECT w.root, arcs.dst, w.hops + 1 FROM w JOIN arcs ON w.node = arcs.src)
  SELECT root, hops, count(*) AS nodes FROM w GROUP BY 1, 2""")
def graph_hierarchy_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    pairs = (("nation", "r", "n_regionkey", "n", "n_nationkey"), ("customer", "n", "c_nationkey", "c", "c_custkey"), ("supplier", "n", "s_nationkey", "s", "s_suppkey"))
    arcs = None
    for table, a, x, b, y in pairs:
        part = t(spark, sf_dir, table).select(tag(a, x).alias("src"), tag(b, y).alias("dst"))
        arcs = part if arcs is None else arcs.union(part)
    roots = t(spark, sf_dir, "region").select(tag("r", "r_regionkey").alias("root"))
    return graph.reach(arcs, roots).groupBy("root", "hops").agg(F.count("*").alias("nodes"))


@query("""WITH d AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem), n AS (SELECT l_suppkey, count(*) AS n FROM d GROUP BY 1)
  SELECT p.a, p.b, p.shared FROM (SELECT x.l_suppkey AS a, y.l_suppkey AS b, count(*) AS shared FROM d x JOIN d y ON x.l_partkey = y.l_partkey AND x.l_suppkey < y.l_suppkey GROUP BY 1, 2) p
  JOIN n na ON na.l_suppkey = a JOIN n nb ON nb.l_suppkey = b WHERE shared >= 0.3 * greatest(na.n, nb.n)""")
def overlap_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers that share 30 % of the parts of whichever has more."""
    return relational.alike_sets(t(spark, sf_dir, "lineitem"), "l_suppkey", "l_partkey", 0.3)


@query(r"SELECT lang, count(*) AS n, sum(coalesce(length(trim(regexp_replace(regexp_replace(strip_accents(lower(text)), '[''’]', '', 'g'), '[^a-z0-9]+', ' ', 'g'))), 0))::BIGINT AS chars FROM documents GROUP BY 1")
def normalise_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(lang, n, chars) of all rows; a null text counts in n and has no characters."""
    chars = F.coalesce(F.length(C.normal_text(F.col("text"))), F.lit(0))
    return t(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.sum(chars).alias("chars"))


@query(f"SELECT k, count(*) AS n FROM {_EVENTS} GROUP BY 1")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("k").agg(F.count("*").alias("n"))


@query(r"""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang="([a-z]*)"', 1) AS lang, regexp_replace(url, '[?#].*$', '') AS plain_url FROM pages""")
def html_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", '<html lang="([a-z]*)"', 1).alias("lang"), F.regexp_replace("url", "[?#].*$", "").alias("plain_url"))


@query("""SELECT p_partkey, round(CASE WHEN p_partkey % 3 = 0 THEN p_size::DOUBLE WHEN p_partkey % 3 = 1 THEN tan(radians(p_size::DOUBLE)) * 100 END, 6) AS incline, CASE WHEN p_partkey % 2 = 0 THEN p_size / 100.0::DOUBLE ELSE p_size::DOUBLE END AS width,
  CASE p_partkey % 4 WHEN 0 THEN p_size / 10.0::DOUBLE WHEN 1 THEN p_size::DOUBLE WHEN 2 THEN CASE WHEN p_size < 1 THEN p_size * 100.0::DOUBLE ELSE p_size::DOUBLE END END AS kerb_cm FROM part""")
def parse_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t(spark, sf_dir, "part")
    size = F.col("p_size").cast("string")
    slope = F.concat(size, F.when(F.col("p_partkey") % 3 == 0, "%").when(F.col("p_partkey") % 3 == 1, "°").otherwise(" up"))
    wide = F.concat(size, F.when(F.col("p_partkey") % 2 == 0, " cm").otherwise(" m"))
    high = F.concat(size, F.when(F.col("p_partkey") % 4 == 0, " mm").when(F.col("p_partkey") % 4 == 1, "cm").when(F.col("p_partkey") % 4 == 2, "").otherwise(" ft"))
    return p.select("p_partkey", F.round(C.incline_percent(slope), 6).alias("incline"), C.metres(wide).alias("width"), C.kerb_height_cm(high).alias("kerb_cm"))


@query("""SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END, n_name) AS label FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""")
def fill_only_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = t(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("key"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("label"))
    right = t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("label"))
    return relational.fill_only(left, right, "key", ["label"]).select("c_custkey", "label")


@query("SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey AND abs(a.s_acctbal - b.s_acctbal) <= 1500")
def pairwise_hub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of a nation whose balances differ by 1,500 at most: balances are cut into ranges of that width, and who asks asks its own
    and the two beside it, so a nation is no group."""
    s = t(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", "s_acctbal", F.floor(F.col("s_acctbal") / 1500).alias("range"))
    other = s.select("s_nationkey", "range", F.col("s_suppkey").alias("b"), F.col("s_acctbal").alias("bal"))
    asked = s.withColumn("range", F.explode(F.array(*[F.col("range") + i for i in (-1, 0, 1)]))).withColumnRenamed("s_suppkey", "a")
    return asked.join(other, ["s_nationkey", "range"]).where((F.col("a") < F.col("b")) & (F.abs(F.col("s_acctbal") - F.col("bal")) <= 1500)).select("a", "b")


@query(f"""SELECT user_id, round(list_reduce(list_prepend([1.0::DOUBLE, 0.0], list([least(3.0, greatest(0.2, value / 100)), 0.0::DOUBLE] ORDER BY event_id)), lambda s, x: [s[1] + (x[1] - s[1]) * greatest(0.2, 1 / (s[2] + 2)), s[2] + 1])[1], 6) AS pace FROM {_EVENTS} GROUP BY 1""")
def pace_learning_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = events(spark, sf_dir).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "value"))).alias("v"))
    zero = F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("n"))
    step = lambda s, x: F.struct((s["p"] + (F.least(F.lit(3.0), F.greatest(F.lit(0.2), x["value"] / 100)) - s["p"]) * F.greatest(F.lit(0.2), F.lit(1.0) / (s["n"] + 2))).alias("p"), (s["n"] + 1).alias("n"))
    return lists.select("user_id", F.round(F.aggregate("v", zero, step, lambda s: s["p"]), 6).alias("pace"))


@query("""SELECT event_id, hour((timezone('Europe/London', timezone('UTC', ts)))::TIMESTAMP)::INT AS uk_hour, CASE dayofweek((timezone('Europe/London', timezone('UTC', ts)))::TIMESTAMP) WHEN 0 THEN 'su' WHEN 6 THEN 'sa' ELSE 'wd' END AS day_type FROM events""")
def uk_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    uk = F.convert_timezone(F.lit("UTC"), F.lit("Europe/London"), F.col("ts"))
    return t(spark, sf_dir, "events").select("event_id", F.hour(uk).alias("uk_hour"), F.when(F.dayofweek(uk) == 1, "su").when(F.dayofweek(uk) == 7, "sa").otherwise("wd").alias("day_type"))


_SUN = """(SELECT event_id, radians((357.529 + d * 0.98560028) - 360 * floor((357.529 + d * 0.98560028) / 360)) AS g, 280.459 + d * 0.98564736 AS q, radians(23.439 - d * 0.00000036) AS tilt, d FROM (SELECT event_id, epoch_us(ts) / 1e6 / 86400.0 - 10957.5::DOUBLE AS d FROM events))"""


@query(f"""WITH a AS (SELECT *, q + sin(g) * 1.915 + sin(g * 2) * 0.02 AS l FROM {_SUN}), b AS (SELECT *, radians(l - 360 * floor(l / 360)) AS along, 280.46061837 + d * 360.98564736629 - 3.19 AS s FROM a),
  c AS (SELECT *, radians(s - 360 * floor(s / 360)) - atan2(cos(tilt) * sin(along), cos(along)) AS turn, asin(sin(tilt) * sin(along)) AS lift FROM b)
  SELECT event_id, round(degrees(asin(sin(radians(55.95)) * sin(lift) + cos(radians(55.95)) * cos(lift) * cos(turn))), 3) AS altitude FROM c""")
def sun_altitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", F.round(C.sun_altitude(F.col("at") / 1e6, -3.19, 55.95), 3).alias("altitude"))


@query("SELECT split_part(p_type, ' ', 1) AS category, count(*) FILTER (p_size <= 25) AS shown, count(*) FILTER (p_size > 25) AS hidden FROM part GROUP BY 1")
def category_intent_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    many = lambda c: F.count(F.when(c, 1))
    return t(spark, sf_dir, "part").groupBy(F.split_part("p_type", F.lit(" "), F.lit(1)).alias("category")).agg(many(F.col("p_size") <= 25).alias("shown"), many(F.col("p_size") > 25).alias("hidden"))
