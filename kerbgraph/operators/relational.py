"""Relational operators: best and latest per key, merges, intervals, runs, percentiles, top-k, nearest and within joins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import haversine_m, in_ring, segment_distance_m
from ..sources.scratch import Tables, written


#: Rows of a task that sorts or groups them, about.
TASK_ROWS = 250_000


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df, of so many rows, dealt by keys into parts whose number grows with them, so that what a task sorts and groups doesn't."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // TASK_ROWS), *keys)


def best_per_key(df: DataFrame, keys: list[str], *order: Column | str, columns: list[str] | None = None) -> DataFrame:
    """The first row of every key in the given order (make it total for a defined result), as an aggregate: tasks hand on one row a
    key each, and nothing is sorted. Nulls come first; for another order hand in columns that sort that way."""
    rest = [c for c in (columns or df.columns) if c not in keys]
    value = F.min_by(F.struct(*rest), F.struct(*[o if isinstance(o, Column) else F.col(o) for o in order])).alias("__v")
    return df.groupBy(*keys).agg(value).select(*keys, "__v.*")


def latest_per_key(df: DataFrame, keys: list[str], time: str, tie: str, columns: list[str]) -> DataFrame:
    """The row of the latest time, of equal ones that of the least tie (of any type that sorts), as an aggregate."""
    last = df.groupBy(*keys).agg(F.max(time).alias("__last"))
    named = [F.col(c).alias(f"__c{i}") for i, c in enumerate(columns)]
    rows = df.select(*keys, F.col(time).alias("__time"), F.col(tie).alias("__tie"), *named)
    value = F.max_by(F.struct(*[f"__c{i}" for i in range(len(columns))]), "__time")
    if dict(df.dtypes)[tie] in ("tinyint", "smallint", "int", "bigint", "float", "double"):
        value = F.max_by(F.struct(*[f"__c{i}" for i in range(len(columns))]), F.struct("__time", -F.col("__tie")))
        out = rows.groupBy(*keys).agg(value.alias("__v"))
    else:
        out = rows.join(last, keys).where(F.col("__time").eqNullSafe(F.col("__last"))).groupBy(*keys).agg(F.min_by(F.struct(*[f"__c{i}" for i in range(len(columns))]), "__tie").alias("__v"))
    return out.select(*keys, *[F.col(f"__v.__c{i}").alias(c) for i, c in enumerate(columns)])


def merge_first_wins(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    return first.unionByName(second.join(first.select(*keys).distinct(), keys, "left_anti"))


def replace_by_source(current: DataFrame, incoming: DataFrame, sources: list[str], keys: list[str]) -> DataFrame:
    """Rows of the named sources go; incoming ones come in where no other source holds the key."""
    rest = current.where(~F.col("source").isin(sources))
    return rest.unionByName(incoming.join(rest.select(*keys).distinct(), keys, "left_anti"))


def fill_only(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Null columns of left from right; what left knows stays."""
    other = right.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    out = left.join(other, key, "left")
    return out.select(*[F.coalesce(F.col(c), F.col(f"__{c}")).alias(c) if c in columns else F.col(c) for c in left.columns])


def runs(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """df with `run`, from 0: it goes up where value differs from the row before in its key."""
    w = Window.partitionBy(key).orderBy(*order)
    changed = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return df.withColumn("__c", changed).withColumn("run", F.sum("__c").over(w) - 1).drop("__c")


def merge_intervals(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Touching and overlapping intervals of a key as one: (key, start, end, n)."""
    w = Window.partitionBy(key).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("__new", F.when(F.col(start) <= reach, 0).otherwise(1)).withColumn("__island", F.sum("__new").over(w))
    return marked.groupBy(key, "__island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("__island")


def index_percentile(df: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    """The element at floor(n * share) of the sorted values, no interpolation."""
    w = Window.partitionBy(*keys)
    ranked = df.where(F.col(value).isNotNull()).select(*keys, value, F.row_number().over(w.orderBy(value)).alias("__r"), F.count("*").over(w).alias("__n"))
    return ranked.where(F.col("__r") == F.least(F.floor(F.col("__n") * share) + 1, F.col("__n"))).select(*keys, F.col(value).alias("at_share"))


#: Metres of a degree of latitude; rows of a grid cell beyond which it is dealt into parts.
DEGREE_M, CELL_ROWS = 111_320.0, 4096
#: Degrees of latitude from which a band is one cell.
POLAR_DEG = 88.0


def _width(band: Column, height: float) -> Column:
    """Degrees of longitude that are as long as `height` degrees of latitude at the end of a band that is nearer to a pole."""
    far = F.greatest(F.abs(band), F.abs(band + 1)) * height
    return height / F.greatest(F.cos(F.radians(F.least(far, F.lit(89.0)))), F.lit(0.01))


def _dealt(stored: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join on (cx, cy) with `part`: stored rows of a crowded cell are dealt into parts, and who asks there asks every
    part. Only crowded cells are looked up."""
    crowded = stored.groupBy("cx", "cy").agg(F.ceil(F.count("*") / CELL_ROWS).cast("int").alias("parts")).where("parts > 1")
    parts = F.coalesce("parts", F.lit(1))
    left = stored.join(crowded, ["cx", "cy"], "left").withColumn("part", F.pmod(F.xxhash64(*[c for c in stored.columns if c not in ("cx", "cy")]), parts).cast("int")).drop("parts")
    right = asked.join(crowded, ["cx", "cy"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    return left, right


def _column(lon: Column, band: Column, height: float) -> Column:
    """The cell's number along its band; a band near a pole is one cell."""
    return F.when(F.abs(band * height) >= POLAR_DEG, 0).otherwise(F.floor(lon / _width(band, height))).cast("long")


def around(df: DataFrame, radius_m: float, lon: str, lat: str) -> DataFrame:
    """df with (cx, cy) of the cells around its point, nine of them away from the 180th meridian, beyond which it asks too. Cells are as high as the radius and, in
    every band, as wide at least."""
    height = radius_m / DEGREE_M * 1.001
    near = lambda c: F.array(c - 1, c, c + 1)
    out = df.withColumn("cy", F.explode(near(F.floor(F.col(lat) / height).cast("long"))))
    here, wide = F.col(lon), _width(F.col("cy"), height)
    cells = near(_column(here, F.col("cy"), height))
    over = F.when(here + wide >= 180, here - 360).when(here - wide <= -180, here + 360)
    both = F.array_distinct(F.concat(cells, near(_column(over, F.col("cy"), height))))
    return out.withColumn("cx", F.explode(F.when(over.isNull(), cells).otherwise(both)))


def cell(df: DataFrame, radius_m: float, lon: str, lat: str) -> DataFrame:
    height = radius_m / DEGREE_M * 1.001
    out = df.withColumn("cy", F.floor(F.col(lat) / height).cast("long"))
    return out.withColumn("cx", _column(F.col(lon), F.col("cy"), height))


def within_join(left: DataFrame, right: DataFrame, radius_m: float) -> DataFrame:
    """Pairs of left (a, lon, lat) and right (b, lon, lat) within radius_m, with distance_m.

    right is stored once by its grid cell, left asks the nine cells around; cells come from the radius, crowded ones are dealt into
    parts. An equi-join, then the exact distance.
    """
    asked = around(left.select("a", F.col("lon").alias("alon"), F.col("lat").alias("alat")), radius_m, "alon", "alat")
    stored = cell(right.select("b", F.col("lon").alias("blon"), F.col("lat").alias("blat")), radius_m, "blon", "blat")
    stored, asked = _dealt(stored, asked)
    near = asked.join(stored, ["cx", "cy", "part"]).withColumn("distance_m", haversine_m(F.col("alon"), F.col("alat"), F.col("blon"), F.col("blat")))
    return near.where(F.col("distance_m") <= radius_m).select("a", "b", "distance_m")


#: Rows of a place's cell that a search for the nearest starts from, about, and how often its radius may be halved for that.
NEAR_ROWS, HALVINGS = 8, 12


def nearest_join(left: DataFrame, right: DataFrame, radius_m: float, k: int = 1, unlike: str | None = None) -> DataFrame:
    """The k nearest right rows within the radius for every left row (a, b, distance_m, rank); of equal distances the lesser b. unlike: a column of both sides in
    which the two must differ (null differs from nothing).

    Rows at one place are one: k of them stand for it. Searches go on from a radius at which cells hold few places to the whole one, doubling it; who has k
    within a radius is done, so a crowd around a point is never paired with it as a whole.
    """
    kind = F.col(unlike) if unlike else F.lit(0)
    place = ["lon", "lat", "kind"]
    with Tables(left.sparkSession) as tables:
        asked = tables.write(left.where("lon is not null and lat is not null").select("a", "lon", "lat", kind.alias("kind")).where("kind is not null"), "asked")
        first = F.row_number().over(Window.partitionBy(*place).orderBy("b"))
        stored = right.where("lon is not null and lat is not null").select("b", "lon", "lat", kind.alias("kind")).where("kind is not null").withColumn("n", first).where(F.col("n") <= k)
        stored = tables.write(stored.groupBy(*place).agg(F.sort_array(F.collect_list("b")).alias("bs")), "stored")
        open_ = tables.write(asked.select(*place).distinct(), "open")
        crowd = cell(stored, radius_m, "lon", "lat").groupBy("cx", "cy").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        halvings = min(HALVINGS, max(0, math.ceil(math.log(max(1.0, crowd / NEAR_ROWS), 4))))
        done = None
        for turn in range(halvings, -1, -1):
            reach = radius_m / 2**turn
            here = stored.select("bs", F.col("lon").alias("blon"), F.col("lat").alias("blat"), F.col("kind").alias("bkind"))
            meet, spots = around(open_, reach, "lon", "lat"), cell(here, reach, "blon", "blat")
            spots, meet = _dealt(spots, meet)
            near = meet.join(spots, ["cx", "cy", "part"]).withColumn("distance_m", haversine_m(F.col("lon"), F.col("lat"), F.col("blon"), F.col("blat"))).where(F.col("distance_m") <= reach)
            if unlike:
                near = near.where("kind <> bkind")
            near = near.select(*place, "distance_m", F.explode("bs").alias("b"))
            near = near.withColumn("rank", F.row_number().over(Window.partitionBy(*place).orderBy("distance_m", "b"))).where(F.col("rank") <= k)
            near = tables.write(near, "near")
            full = near.where(F.col("rank") == k).select(*place)
            part = near if turn == 0 else near.join(full, place, "left_semi")
            done = part if done is None else done.unionByName(part)
            if turn:
                open_ = tables.write(open_.join(full, place, "left_anti"), "open")
        return written(asked.join(done, place).select("a", "b", "distance_m", "rank"), "nearest")


def segment_join(left: DataFrame, segments: DataFrame, radius_m: float, step_m: float = 50.0) -> DataFrame:
    """Pairs of left (a, lon, lat) and segments (ax, ay, bx, by and others) within radius_m, with distance_m. A segment is stored in the
    cells of points every step_m along it, and the radius of the cells is longer by half a step, so none is missed."""
    reach = radius_m + step_m / 2 + 1.0
    rest = [c for c in segments.columns if c not in ("ax", "ay", "bx", "by")]
    long = haversine_m(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    n = F.greatest(F.lit(1), F.ceil(long / step_m).cast("int"))
    spots = segments.withColumn("share", F.explode(F.transform(F.sequence(F.lit(0), n), lambda i: i / n)))
    stored = cell(spots.withColumn("slon", F.col("ax") + (F.col("bx") - F.col("ax")) * F.col("share")).withColumn("slat", F.col("ay") + (F.col("by") - F.col("ay")) * F.col("share")), reach, "slon", "slat")
    stored = stored.drop("share", "slon", "slat").distinct()
    asked = around(left.select("a", F.col("lon").alias("plon"), F.col("lat").alias("plat")), reach, "plon", "plat")
    stored, asked = _dealt(stored, asked)
    near = asked.join(stored, ["cx", "cy", "part"]).withColumn("distance_m", segment_distance_m(F.col("plon"), F.col("plat"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")))
    return near.where(F.col("distance_m") <= radius_m).select("a", *rest, "ax", "ay", "bx", "by", "distance_m").distinct()


def polygon_join(left: DataFrame, rings: DataFrame, ring: str, cell: float) -> DataFrame:
    """Rows of left (lon, lat and others) with those of rings whose ring, an array of (lon, lat), holds the point. A ring is stored in all
    cells of `cell` degrees that its box touches; then the even-odd rule."""
    low = lambda c: F.floor(F.array_min(F.transform(ring, lambda p: p[c])) / cell).cast("long")
    high = lambda c: F.floor(F.array_max(F.transform(ring, lambda p: p[c])) / cell).cast("long")
    stored = rings.withColumn("cx", F.explode(F.sequence(low("lon"), high("lon")))).withColumn("cy", F.explode(F.sequence(low("lat"), high("lat"))))
    asked = left.withColumn("cx", F.floor(F.col("lon") / cell).cast("long")).withColumn("cy", F.floor(F.col("lat") / cell).cast("long"))
    return asked.join(stored, ["cx", "cy"]).where(in_ring(F.col("lon"), F.col("lat"), F.col(ring))).drop("cx", "cy")


def top_with_rest(df: DataFrame, key: str, k: int, *order: Column) -> tuple[DataFrame, DataFrame]:
    """The first k rows of every key, and for keys with more how many there are beyond."""
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    counts = df.groupBy(key).agg(F.greatest(F.count("*") - k, F.lit(0)).alias("more"))
    return ranked.where(F.col("rank") <= k), counts.where("more > 0")


#: Values of the order that a part of a fold spans.
FOLD_SPAN = 10_000


def clamped_fold(df: DataFrame, key: str, order: str, weight: str, low: float, high: float, span: int = FOLD_SPAN) -> DataFrame:
    """(key, total, n): weights added in the order of an integer column, from 0, cut to [low, high] after every addition.

    A run of such steps is again a step: x -> min(top, max(bottom, x + shift)), and steps compose. So each part of `span` values of
    the order becomes one step by itself, parts of parts again, and a key's whole history is never in one place.
    """
    step = lambda b, t, s: F.struct(b.alias("bottom"), t.alias("top"), s.alias("shift"))
    cut = lambda x, b, t: F.least(t, F.greatest(b, x))
    then = lambda f, g: step(cut(f["bottom"] + g["shift"], g["bottom"], g["top"]), cut(f["top"] + g["shift"], g["bottom"], g["top"]), f["shift"] + g["shift"])
    none = step(F.lit(float("-inf")), F.lit(float("inf")), F.lit(0.0))
    parts = df.select(key, F.col(order).cast("long").alias("__at"), step(F.lit(low), F.lit(high), F.col(weight).cast("double")).alias("f"), F.lit(1).cast("long").alias("n"))
    for _ in range(2):
        here = parts.withColumn("__part", F.floor(F.col("__at") / span).cast("long"))
        lists = here.groupBy(key, "__part").agg(F.array_sort(F.collect_list(F.struct("__at", "f"))).alias("w"), F.sum("n").alias("n"))
        parts = lists.select(key, F.col("__part").alias("__at"), F.aggregate("w", none, lambda f, x: then(f, x["f"])).alias("f"), "n")
    last = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("__at", "f"))).alias("w"), F.sum("n").alias("n"))
    total = F.aggregate("w", none, lambda f, x: then(f, x["f"]))
    return last.select(key, cut(total["shift"], total["bottom"], total["top"]).alias("total"), "n")


def others_within(df: DataFrame, keys: list[str], who: str, at: str, row: str, reach: int) -> DataFrame:
    """(row, others): how many different others (`who`) have a row of the same keys within `reach` of a row's time (an integer).

    Nobody is paired with anybody: each one's rows cover stretches of time, merged where they touch, and the covers open at a row's time
    are counted by running sums, first over slots of time, then inside a slot.
    """
    mine = Window.partitionBy(*keys, who).orderBy("__from")
    cover = df.select(*keys, who, (F.col(at) - reach).alias("__from"), (F.col(at) + reach).alias("__to"))
    cover = cover.withColumn("__new", F.when(F.col("__from") <= F.lag("__to").over(mine), 0).otherwise(1)).withColumn("__run", F.sum("__new").over(mine))
    cover = cover.groupBy(*keys, who, "__run").agg(F.min("__from").alias("__from"), F.max("__to").alias("__to"))
    # at one time covers open before rows are counted, and close after
    marks = cover.select(*keys, F.explode(F.array(F.struct(F.col("__from").alias("t"), F.lit(0).alias("turn"), F.lit(1).alias("d")), F.struct(F.col("__to").alias("t"), F.lit(2).alias("turn"), F.lit(-1).alias("d")))).alias("m")).select(*keys, "m.*", F.lit(None).cast(df.schema[row].dataType).alias(row))
    asked = df.select(*keys, F.col(at).alias("t"), F.lit(1).alias("turn"), F.lit(0).alias("d"), row)
    both = marks.unionByName(asked).withColumn("slot", F.floor(F.col("t") / (2 * reach)).cast("long"))
    slots = both.groupBy(*keys, "slot").agg(F.sum("d").alias("net"))
    before = F.coalesce(F.sum("net").over(Window.partitionBy(*keys).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = slots.select(*keys, "slot", before.alias("base"))
    inside = F.sum("d").over(Window.partitionBy(*keys, "slot").orderBy("t", "turn"))
    counted = both.withColumn("inside", inside).where(F.col(row).isNotNull()).join(base, [*keys, "slot"])
    return counted.select(row, (F.col("base") + F.col("inside") - 1).cast("long").alias("others"))


#: Owners of an item up to which all its pairs of owners are counted.
COMMON = 128


def alike_sets(df: DataFrame, owner: str, item: str, share: float, common: int = COMMON) -> DataFrame:
    """(a, b, shared): pairs of owners, a below b, whose sets of items have at least `share` of the larger one in common.

    What two owners share of items that no more than `common` have is counted pair by pair: an item hands its owners' lists to each of them, so pairs are
    made where they are counted. Items are ranked by how rare they are. Sets that share only common items must share one of the rarest of either, the first
    n - ceil(share n) + 1 of n. Common items are counted in full, for pairs alone that they can still bring to the share.
    """
    rows = df.select(F.col(owner).alias("o"), F.col(item).alias("i")).where("o is not null and i is not null").distinct()
    owners = rows.groupBy("i").agg(F.count("*").alias("often"))
    marked = rows.join(owners, "i").withColumn("wide", F.col("often") > common)
    sizes = marked.groupBy("o").agg(F.count("*").alias("n"), F.count(F.when(F.col("wide"), 1)).alias("c"))
    size_of = lambda x: sizes.select(F.col("o").alias(x), F.col("n").alias(f"n{x}"), F.col("c").alias(f"c{x}"))

    lists = rows.join(owners.where(F.col("often").between(2, common)), "i").groupBy("i").agg(F.sort_array(F.collect_list("o")).alias("os"))
    later = F.slice("os", F.col("k") + 2, F.greatest(F.size("os") - F.col("k") - 1, F.lit(0)))
    heads = lists.select("os", F.posexplode("os").alias("k", "a")).select("a", later.alias("bs")).where("size(bs) > 0").repartition("a")
    counted = heads.select("a", F.explode("bs").alias("b")).groupBy("a", "b").agg(F.count("*").alias("rare"))
    counted = counted.join(size_of("a"), "a").where(F.col("rare") + F.col("ca") >= F.col("na") * share).select("a", "b", "rare")

    spread = marked.where("wide").join(sizes, "o")
    rank = F.col("n") - F.col("c") + F.row_number().over(Window.partitionBy("o").orderBy("often", "i"))
    first = spread.withColumn("rank", rank).where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * share) + 1).select("o", "i", "n")
    left, right = (first.select("i", F.col("o").alias(x), F.col("n").alias(f"n{x}")) for x in "ab")
    fit = F.least("na", "nb") >= F.greatest("na", "nb") * share
    met = left.join(right, "i").where((F.col("a") < F.col("b")) & fit).select("a", "b").distinct()

    pairs = counted.unionByName(met.withColumn("rare", F.lit(0).cast("long"))).groupBy("a", "b").agg(F.sum("rare").alias("rare"))
    pairs = pairs.join(size_of("a"), "a").join(size_of("b"), "b").withColumn("n", F.greatest("na", "nb"))
    pairs = pairs.where(F.col("rare") + F.least("ca", "cb") >= F.col("n") * share)
    wide = lambda x: marked.where("wide").select(F.col("o").alias(x), "i")
    open_ = pairs.where("ca > 0 and cb > 0").select("a", "b").join(wide("a"), "a").join(wide("b"), ["b", "i"]).groupBy("a", "b").agg(F.count("*").alias("rest"))
    whole = pairs.join(open_, ["a", "b"], "left").withColumn("shared", F.col("rare") + F.coalesce("rest", F.lit(0)))
    return whole.where(F.col("shared") >= F.col("n") * share).select("a", "b", "shared")
