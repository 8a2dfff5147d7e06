"""Uploads of phones that were offline: each kept once however often it is sent, under rolling limits of persons and networks."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions import columns as C
from ..sources.scratch import Tables, written

# How many of a kind a person, and a network, may send within a day; no limit where null.
LIMITS: dict[str, tuple[int, int | None]] = {"note": (30, None), "report": (20, 60), "vote": (200, 600)}
DAY_US = 86_400_000_000
COLUMNS = ["id", "kind", "person", "network", "arrived"]
#: Rows of a network up to which its uploads are judged one after the other in a task; larger ones are settled in rounds.
FOLD_ROWS = 200_000
#: Rows of a task that judges networks, about.
TASK_ROWS = 500_000


def clamped(observed_at: Column, arrived: Column) -> Column:
    """When something was seen: earlier than it arrived, as phones wait offline, but never later. Null stays null."""
    return F.when(observed_at.isNotNull(), F.least(observed_at, arrived))


def decide(uploads: DataFrame, stored: DataFrame | None = None, limits: dict[str, tuple[int, int | None]] = LIMITS) -> DataFrame:
    """uploads (id, kind, person, network, arrived, attempt, ...) with `verdict`: stored, repeat (its id of that kind is stored already, which is as good), person
    or network (as many as allowed were stored in the day before). Refused ones count for nothing, so each depends on those before it, in the
    order of arrival, then attempt (unique in uploads). stored: (id, kind, person, network, arrived) of earlier calls.

    A network whose persons and ids of a kind are no other network's depends on its own rows alone: such networks are judged row by row where they lie, after one shuffle.
    Networks of more than FOLD_ROWS rows, those that share persons or ids, and rows without a network, a kind or an arrival are settled in rounds. Null persons, networks,
    kinds without a limit: no limit. Null ids are never repeats.
    """
    columns, typed = uploads.columns, uploads.schema["attempt"].dataType
    known = None if stored is None else stored.select(F.lit(None).cast(typed).alias("attempt"), *COLUMNS)
    every = uploads.select("attempt", *COLUMNS) if known is None else uploads.select("attempt", *COLUMNS).unionByName(known)
    with Tables(uploads.sparkSession) as tables:
        apart = tables.write(_apart(every), "apart")
        # few networks as a rule: what is left out of the fold
        left = apart.count()
        net = ["kind", "network"]
        alone = lambda df: df.where("kind is not null and network is not null").join(apart, net, "left_anti")
        rest = lambda df: df.where("kind is null or network is null").unionByName(df.join(apart, net, "left_semi"))
        out = _folded(alone(uploads), None if stored is None else alone(stored.select(*COLUMNS)), limits, every.count())
        if left or not every.where("kind is null or network is null").isEmpty():
            out = out.unionByName(_rounds(rest(uploads), None if stored is None else rest(stored.select(*COLUMNS)), limits))
        return written(out.select(*columns, "verdict"), "uploads")


def _apart(rows: DataFrame) -> DataFrame:
    """(kind, network): networks that have a person or an id in common with another or with rows of none, rows without an arrival, or more than FOLD_ROWS rows."""
    net = ["kind", "network"]
    here = F.col("network").isNotNull()
    out = rows.groupBy(*net).agg(F.count("*").alias("n"), F.count("arrived").alias("timed")).where(f"kind is not null and network is not null and (n > {FOLD_ROWS} or timed < n)").select(*net)
    for key in ("person", "id"):
        met = rows.where(F.col(key).isNotNull() & F.col("kind").isNotNull())
        shared = met.groupBy("kind", key).agg(F.min("network").alias("low"), F.max("network").alias("high"), F.max(~here).alias("none")).where("low < high or none").select("kind", key)
        out = out.unionByName(met.where(here).join(shared, ["kind", key], "left_semi").select(*net))
    return out.distinct()


def _folded(uploads: DataFrame, stored: DataFrame | None, limits: dict[str, tuple[int, int | None]], rows: int) -> DataFrame:
    """uploads with `verdict`, each network judged in the order of arrival. A task holds the ids and the last day's times of one network at a time."""
    marked = uploads.withColumn("__new", F.lit(True))
    if stored is not None:
        marked = marked.unionByName(stored.withColumn("__new", F.lit(False)), allowMissingColumns=True)
    marked = marked.withColumn("__at", C.micros(F.col("arrived").cast("timestamp_ntz")))
    parts = max(int(uploads.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // TASK_ROWS)
    order = ["kind", "network", "__at", "attempt"]
    names = list(uploads.columns)
    kept = [f"`{c}` {uploads.schema[c].dataType.simpleString()}" for c in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ids, of_person, of_network = None, set(), {}, deque()

        def full(times: deque, at: int, limit: int) -> bool:
            while times and times[0] <= at - DAY_US:
                times.popleft()
            return len(times) >= limit

        for batch in batches:
            said = []
            for kind, net, at, new, id_, person in zip(*(batch.column(c).to_pylist() for c in ("kind", "network", "__at", "__new", "id", "person")), strict=True):
                if (kind, net) != last:
                    last, ids, of_person, of_network = (kind, net), set(), {}, deque()
                most, shared = limits.get(kind, (None, None))
                verdict = "stored"
                if new:
                    if id_ is not None and id_ in ids:
                        verdict = "repeat"
                    elif most is not None and full(of_person.get(person, deque()) if person is not None else deque(), at, most):
                        verdict = "person"
                    elif shared is not None and full(of_network, at, shared):
                        verdict = "network"
                if verdict == "stored":
                    ids.add(id_)
                    if most is not None and person is not None:
                        of_person.setdefault(person, deque()).append(at)
                    if shared is not None:
                        of_network.append(at)
                said.append(verdict)
            told = batch.select(names).append_column("verdict", pa.array(said, pa.string()))
            yield told.filter(batch.column("__new"))

    dealt = marked.repartition(parts, "kind", "network").sortWithinPartitions(*order)
    return dealt.mapInArrow(run, ", ".join([*kept, "verdict string"]))


def _rounds(uploads: DataFrame, stored: DataFrame | None, limits: dict[str, tuple[int, int | None]]) -> DataFrame:
    """uploads with `verdict`, settled in rounds over all keys at once: an upload is refused if those surely stored before it fill a limit, and stored if they and all
    still open ones don't. The earliest open one of a key is always settled, and a burst of any size takes two rounds for each day it lasts. Windows only count and
    grow, so a key's rows pass through a task in order without being gathered."""
    of_person = C._lookup({k: v[0] for k, v in limits.items()}, F.col("kind"))
    of_network = C._lookup({k: v[1] for k, v in limits.items() if v[1] is not None}, F.col("kind")) if any(v[1] is not None for v in limits.values()) else F.lit(None)
    huge = F.lit(1 << 60)
    rows = uploads.select("attempt", *COLUMNS, F.lit(None).cast("string").alias("verdict"))
    if stored is not None:
        rows = rows.unionByName(stored.select(F.lit(None).cast(uploads.schema["attempt"].dataType).alias("attempt"), *COLUMNS, F.lit("stored").alias("verdict")))
    rows = rows.withColumn("at", C.micros(F.col("arrived").cast("timestamp_ntz")))
    keys = (("id", None, F.lit(1), "repeat"), ("person", DAY_US, F.coalesce(of_person.cast("long"), huge), "person"), ("network", DAY_US, F.coalesce(of_network.cast("long"), huge), "network"))

    def before(flag: Column, key: str, since: int | None) -> Column:
        w = Window.partitionBy("kind", key)
        n = F.coalesce(F.sum(flag).over(w.orderBy("at", "attempt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        if since is not None:
            n = n - F.coalesce(F.sum(flag).over(w.orderBy("at").rangeBetween(Window.unboundedPreceding, -since)), F.lit(0))
        return F.when(F.col(key).isNull(), 0).otherwise(n)

    with Tables(uploads.sparkSession) as tables:
        left = 1
        while left:
            counted = rows.withColumns({"sure": F.coalesce(F.col("verdict") == "stored", F.lit(False)).cast("int"), "may": F.coalesce(F.col("verdict") == "stored", F.lit(True)).cast("int")})
            counted = counted.withColumns({f"s_{key}": before(F.col("sure"), key, since) for key, since, *_ in keys} | {f"o_{key}": before(F.col("may"), key, since) for key, since, *_ in keys})
            free, full = F.lit(True), F.lit(False)
            for key, _, limit, _ in keys:
                free, full = free & (F.col(f"o_{key}") < limit), full | (F.col(f"s_{key}") >= limit)
            new = F.coalesce("verdict", F.when(full, "refused").when(free, "stored"))
            rows = tables.write(counted.withColumn("verdict", new).select("attempt", *COLUMNS, "verdict", "at"), "rows")
            tables.keep_last("rows")
            left = rows.where("verdict is null").count()
        # all is settled: what each refused one met first
        counted = rows.withColumn("sure", (F.col("verdict") == "stored").cast("int"))
        counted = counted.withColumns({f"s_{key}": before(F.col("sure"), key, since) for key, since, *_ in keys})
        word = F.when(F.col("verdict") == "stored", "stored")
        for key, _, limit, name in keys:
            word = word.when(F.col(f"s_{key}") >= limit, name)
        out = uploads.join(counted.where("attempt is not null").select("attempt", word.alias("verdict")), "attempt")
        return written(out, "uploads")


def store(uploads: DataFrame, path: str, checkpoint: str, limits: dict[str, tuple[int, int | None]] = LIMITS, available_now: bool = False) -> StreamingQuery:
    """Store a stream of uploads (attempt, id, kind, person, network, arrived, observed_at, ...) with their verdicts as Parquet under `path`, a folder for each batch.

    A batch is judged by the batches before it and replaces its own folder, so that one that runs again after a failure gives what it gave. Of what is
    stored a batch reads the ids that it holds and the day before it.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        with Tables(spark) as tables:
            new = tables.write(df.withColumn("observed_at", clamped(F.col("observed_at"), F.col("arrived"))), "new")
            first = new.agg(F.min("arrived")).first()[0]
            if first is None:
                return
            earlier = None
            if number:
                kept = spark.read.schema(StructType([*new.schema.fields, StructField("verdict", StringType()), StructField("batch", LongType())])).option("pathGlobFilter", "*.parquet").option("basePath", path).parquet(path).where((F.col("batch") < number) & (F.col("verdict") == "stored")).select(*COLUMNS)
                recent = kept.where(F.col("arrived") > F.lit(first) - F.expr("interval 1 day"))
                known = kept.where(F.col("arrived") <= F.lit(first) - F.expr("interval 1 day")).join(new.select("kind", "id").distinct(), ["kind", "id"], "left_semi").select(*COLUMNS)
                earlier = tables.write(recent.unionByName(known), "earlier")
            decide(new, earlier, limits).select(*new.columns, "verdict").write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = uploads.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
