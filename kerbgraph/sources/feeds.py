"""Readers of public feeds and files: map XML, timetable CSV, disruption, flood, alert and weather JSON. Schemas are explicit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_TAG = "array<struct<_k:string,_v:string,_VALUE:string>>"


def _elements(spark: SparkSession, paths: tuple[str, ...], kind: str, schema: str) -> DataFrame:
    """Elements of map XML files with tags and the number of their file."""
    out = None
    for i, path in enumerate(paths):
        rows = spark.read.format("xml").option("rowTag", kind).schema(f"_id long, _timestamp string, {schema}, tag {_TAG}").load(path).withColumn("file", F.lit(i))
        out = rows if out is None else out.unionByName(rows)
    tags = F.map_from_entries(F.transform(F.coalesce("tag", F.array().cast(_TAG)), lambda t: F.struct(t["_k"], t["_v"])))
    return out.withColumn("tags", tags).withColumnRenamed("_id", "id").withColumnRenamed("_timestamp", "timestamp")


def _last(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row an id: that of the last file, in a file the last by time."""
    return rows.groupBy("id").agg(F.max_by(F.struct(*columns), F.struct("file", F.coalesce("timestamp", F.lit("")))).alias("v")).select("id", "v.*")


def osm_ways(spark: SparkSession, *paths: str) -> DataFrame:
    """(id, nodes, tags, timestamp) of the ways of map XML; a way in several files is taken from the last."""
    ways = _elements(spark, paths, "way", "nd array<struct<_ref:long,_VALUE:string>>")
    return _last(ways.withColumn("nodes", F.transform("nd", lambda n: n["_ref"])), ["nodes", "tags", "timestamp"])


def osm_nodes(spark: SparkSession, *paths: str) -> DataFrame:
    """(id, lon, lat, tags, timestamp) of the nodes of map XML; a node in several files is taken from the last."""
    nodes = _elements(spark, paths, "node", "_lat double, _lon double")
    return _last(nodes.withColumnRenamed("_lon", "lon").withColumnRenamed("_lat", "lat"), ["lon", "lat", "tags", "timestamp"])


def gtfs(spark: SparkSession, folder: str, table: str, schema: str) -> DataFrame:
    return spark.read.csv(f"{folder}/{table}.txt", schema=schema, header=True, multiLine=True, escape='"')


def lift_outages(spark: SparkSession, path: str) -> DataFrame:
    """(station, lift, message): one row per lift that is out; rows without a station or lifts are dropped."""
    raw = spark.read.schema("stationUniqueId string, disruptedLiftUniqueIds array<string>, message string").option("multiLine", True).json(path)
    return raw.where("stationUniqueId is not null").select(F.col("stationUniqueId").alias("station"), F.explode("disruptedLiftUniqueIds").alias("lift"), "message")


def region_alerts(spark: SparkSession, path: str) -> DataFrame:
    """(status, geography_name, geography_code, refresh_date) of regions whose status is one of the four."""
    raw = spark.read.schema("status string, geography_name string, geography_code string, refresh_date string").option("multiLine", True).json(path)
    return raw.where(F.lower("status").isin("green", "yellow", "amber", "red")).withColumn("status", F.lower("status"))


def latest_level(spark: SparkSession, path: str) -> DataFrame:
    """(ts_id, at, level): the last reading with a number and a date by place in the list, not by time."""
    raw = spark.read.schema("ts_id string, data array<array<string>>").option("multiLine", True).json(path)
    rows = raw.select("ts_id", F.posexplode("data").alias("i", "x")).select("ts_id", "i", F.col("x")[0].alias("at"), F.col("x")[1].try_cast("double").alias("level")).where(F.col("level").isNotNull() & F.try_to_timestamp("at").isNotNull())
    return rows.groupBy("ts_id").agg(F.max_by(F.struct("at", "level"), "i").alias("v")).select("ts_id", "v.*")


def hourly(spark: SparkSession, path: str) -> DataFrame:
    """(time, precipitation, temperature, code, snowfall, gust) per hour from parallel arrays."""
    inner = "time array<string>, precipitation array<double>, temperature_2m array<double>, weather_code array<int>, snowfall array<double>, wind_gusts_10m array<double>"
    raw = spark.read.schema(f"hourly struct<{inner.replace(' array', ':array')}>").option("multiLine", True).json(path)
    zipped = F.arrays_zip(*[F.col(f"hourly.{c}").alias(a) for c, a in (("time", "time"), ("precipitation", "precipitation"), ("temperature_2m", "temperature"), ("weather_code", "code"), ("snowfall", "snowfall"), ("wind_gusts_10m", "gust"))])
    return raw.select(F.inline(zipped)).where("time is not null")


def works(spark: SparkSession, path: str) -> DataFrame:
    """Street works as rows, with the outline as an array of (lon, lat)."""
    row = "id:string,source:string,headline:string,geometry:array<array<double>>,footway:string,description:string,street:string,start:string,end:string,observedAt:string"
    raw = spark.read.schema(f"area string, works array<struct<{row}>>").option("multiLine", True).json(path)
    out = raw.select("area", F.inline("works"))
    return out.withColumn("geometry", F.transform("geometry", lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat"))))
