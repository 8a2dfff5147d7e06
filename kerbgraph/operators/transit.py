"""Timetables as lines: which services run, how many leave a stop in each hour, how long a ride takes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
#: Seconds that a ride takes at least, and trips that make one known.
SHORTEST_RIDE, LEAST_TRIPS = 30, 2


def active_services(calendar: DataFrame, exceptions: DataFrame, days: DataFrame) -> DataFrame:
    """(day_type, service_id) of the services that run on sample days (day_type, date: yyyymmdd): by weekday between two dates, and as the
    exceptions (service_id, date, exception_type: 1 added, else removed) say."""
    on = days.withColumn("weekday", F.weekday(F.to_date("date", "yyyyMMdd")))
    runs = F.element_at(F.array(*[F.col(d) == "1" for d in WEEKDAYS]), F.col("weekday") + 1)
    usual = calendar.join(F.broadcast(on), (F.col("start_date") <= F.col("date")) & (F.col("date") <= F.col("end_date"))).where(runs).select("day_type", "service_id")
    said = exceptions.join(F.broadcast(days), "date")
    added = said.where("exception_type = '1'").select("day_type", "service_id")
    removed = said.where("exception_type <> '1'").select("day_type", "service_id")
    return usual.union(added).distinct().join(removed, ["day_type", "service_id"], "left_anti")


def seconds(clock: Column) -> Column:
    """Seconds of a time of the service day, which may lie past 24:00:00; null if it is none."""
    part = lambda i: F.split_part(clock, F.lit(":"), F.lit(i)).try_cast("int")
    return part(1) * 3600 + part(2) * 60 + part(3)


def calls(trips: DataFrame, stop_times: DataFrame, services: DataFrame, stops: DataFrame) -> DataFrame:
    """(line, trip_id, seq, stop_id, at, last, days): the calls of running trips at known stops (stop_id), line being route:direction."""
    running = trips.join(services.groupBy("service_id").agg(F.collect_set("day_type").alias("days")), "service_id")
    line = F.concat("route_id", F.lit(":"), F.coalesce(F.nullif("direction_id", F.lit("")), F.lit("0")))
    at = seconds(F.coalesce(F.nullif("departure_time", F.lit("")), F.col("arrival_time")))
    rows = stop_times.join(stops.select("stop_id"), "stop_id", "left_semi").select("trip_id", F.col("stop_sequence").cast("int").alias("seq"), "stop_id", at.alias("at")).where("at is not null")
    rows = rows.join(running.select("trip_id", line.alias("line"), "days"), "trip_id")
    return rows.withColumn("last", F.lead("seq").over(Window.partitionBy("trip_id").orderBy("seq")).isNull())


def departures(called: DataFrame) -> DataFrame:
    """(line, stop_id, day_type, per_hour): departures in each of 24 hours; nobody boards at a trip's last call."""
    rows = called.where("not last").withColumn("day_type", F.explode("days"))
    hour = F.pmod(F.floor(F.col("at") / 3600), F.lit(24)).cast("int")
    counts = [F.count(F.when(F.col("hour") == h, 1)).cast("int") for h in range(24)]
    return rows.withColumn("hour", hour).groupBy("line", "stop_id", "day_type").agg(F.array(*counts).alias("per_hour"))


def rides(called: DataFrame) -> DataFrame:
    """(line, a, b, seconds, trips): the median time from a stop to the next, 30 seconds at least, where two trips or more tell it."""
    w = Window.partitionBy("trip_id").orderBy("seq")
    rows = called.select("line", "trip_id", F.col("stop_id").alias("a"), F.lead("stop_id").over(w).alias("b"), (F.lead("at").over(w) - F.col("at")).alias("s")).where("b is not null and a <> b and s >= 0")
    out = rows.groupBy("line", "a", "b").agg(F.floor(F.median("s")).cast("int").alias("s"), F.count("*").alias("trips")).where(F.col("trips") >= LEAST_TRIPS)
    return out.select("line", "a", "b", F.greatest(F.lit(SHORTEST_RIDE), "s").alias("seconds"), "trips")
