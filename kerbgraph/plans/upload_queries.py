"""Events as uploads of phones, judged in the order of their arrival."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import uploads
from .registry import query, t

#: Lower than the real limits, so that the table's few events a day meet them.
LIMITS: dict[str, tuple[int, int | None]] = {"note": (1, None), "report": (1, 2)}
DAY = uploads.DAY_US


@query(f"""WITH RECURSIVE u AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY network ORDER BY tm, event_id) AS n FROM (SELECT event_id, user_id AS person, user_id // 3 AS network, epoch_us(ts) AS tm, CASE WHEN event_type IN ('view', 'click') THEN 'note' WHEN event_type = 'purchase' THEN 'vote' ELSE 'report' END AS kind,
  user_id * 1000 + event_id % 40 AS id FROM events)),
r AS (SELECT network, 0::BIGINT AS n, 0::BIGINT AS event_id, ''::VARCHAR AS verdict, []::STRUCT(kind VARCHAR, person BIGINT, id BIGINT, tm BIGINT)[] AS kept FROM u WHERE n = 1
  UNION ALL SELECT network, n, event_id, verdict, CASE WHEN verdict = 'stored' THEN list_append(kept, {{'kind': kind, 'person': person::BIGINT, 'id': id::BIGINT, 'tm': tm}}) ELSE kept END FROM (SELECT u.*, r.kept,
    CASE WHEN len(list_filter(r.kept, lambda k: k.kind = u.kind AND k.id = u.id)) > 0 THEN 'repeat'
      WHEN u.kind <> 'vote' AND len(list_filter(r.kept, lambda k: k.kind = u.kind AND k.person = u.person AND k.tm > u.tm - {DAY})) >= 1 THEN 'person'
      WHEN u.kind = 'report' AND len(list_filter(r.kept, lambda k: k.kind = u.kind AND k.tm > u.tm - {DAY})) >= 2 THEN 'network' ELSE 'stored' END AS verdict
    FROM r JOIN u ON u.network = r.network AND u.n = r.n + 1))
SELECT event_id, verdict FROM r WHERE n > 0""")
def upload_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event an upload of its user, three users to a network; an id comes again after 40 events of a user."""
    kind = F.when(F.col("event_type").isin("view", "click"), "note").when(F.col("event_type") == "purchase", "vote").otherwise("report")
    sent = t(spark, sf_dir, "events").select(F.col("event_id").alias("attempt"), (F.col("user_id") * 1000 + F.col("event_id") % 40).alias("id"), kind.alias("kind"), F.col("user_id").alias("person"), F.floor(F.col("user_id") / 3).alias("network"), F.col("ts").alias("arrived"))
    return uploads.decide(sent, limits=LIMITS).select(F.col("attempt").alias("event_id"), "verdict")
