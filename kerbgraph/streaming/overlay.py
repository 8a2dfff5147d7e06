"""Live states as a stream: every state expires, and a later observation of a key replaces the earlier one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_expiry(states: DataFrame, ttl: str = "15 minutes") -> DataFrame:
    """states (ref, status, observed_at) with valid_until."""
    return states.withColumn("valid_until", F.col("observed_at") + F.expr(f"interval {ttl}"))


def first_seen(states: DataFrame, late: str = "30 minutes") -> DataFrame:
    """Each (ref, status, observed_at) once, however often a feed repeats it; rows later than `late` behind are dropped."""
    return states.withWatermark("observed_at", late).dropDuplicatesWithinWatermark(["ref", "status", "observed_at"])


def counts_by_hour(states: DataFrame, late: str = "30 minutes") -> DataFrame:
    """How many states of each status were observed per hour."""
    return states.withWatermark("observed_at", late).groupBy(F.window("observed_at", "1 hour").alias("hour"), "status").agg(F.count("*").alias("n")).select("hour.start", "status", "n")


def in_force(states: DataFrame, now: str) -> DataFrame:
    """States with observed_at <= now < valid_until; of one ref the latest."""
    at = F.lit(now).cast("timestamp")
    live = states.where((F.col("observed_at") <= at) & (F.col("valid_until") > at))
    return live.groupBy("ref").agg(F.max_by(F.struct("status", "observed_at", "valid_until"), "observed_at").alias("v")).select("ref", "v.*")
