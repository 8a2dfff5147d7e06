"""Patterns over the steps of paths: segments, rides, slope bands, hazards, manoeuvres, directions, stretches, unknowns.

Steps are rows (keys, seq, kind, name, forward, length_m, ...), one for each edge walked, in the order of seq; keys name the path.
Attributes are null where nothing is known. A path's steps meet in one window or array; paths are as long as a journey is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.texts import length_text
from .lines import turn, turn_word

# Kinds of edges on which one is carried, and indoors; upper ends of slope bands in per cent.
RIDES = ("transit", "board", "interchange")
INDOORS = (*RIDES, "station_link", "elevator")
BANDS = (3.0, 5.0, 8.0, 12.0)
#: Bands beside those of slopes: unknown, steps, carried.
UNKNOWN, STEPS, CARRIED = -1, 5, 6
#: A ride takes at least and at most these shares of the metres on foot on the strip.
LEAST_RIDE, MOST_RIDE = 0.06, 0.15
#: Metres: between two parts of one hazard, from one kerb warning to its like, from a turn to one that belongs to it, the least stretch told.
GAP_M, KERB_M, TURN_M, TOLD_M = 5.0, 15.0, 8.0, 3.0


def _ordered(keys: list[str], order: str = "seq"):
    return Window.partitionBy(*keys).orderBy(order)


def measured(steps: DataFrame, keys: list[str]) -> DataFrame:
    """steps with `at_m`, the metres before each."""
    before = _ordered(keys).rowsBetween(Window.unboundedPreceding, -1)
    return steps.withColumn("at_m", F.coalesce(F.sum("length_m").over(before), F.lit(0.0)))


def segments(rows: DataFrame, keys: list[str], opens: Column, out: str = "segment", order: str = "seq") -> DataFrame:
    """rows with the number of their segment, from 0: `opens`, which may look back over the path, tells where one begins. Rows before the first
    beginning are in segment -1; a null opens nothing."""
    marked = rows.withColumn("__open", F.coalesce(opens, F.lit(False)).cast("int"))
    return marked.withColumn(out, F.sum("__open").over(_ordered(keys, order)) - 1).drop("__open")


def changes(column: Column, keys: list[str], order: str = "seq") -> Column:
    """True where a value is not that of the row before, and in the first row."""
    w = _ordered(keys, order)
    return (F.row_number().over(w) == 1) | ~F.lag(column).over(w).eqNullSafe(column)


def folded(rows: DataFrame, keys: list[str], order: str, step: Callable[[Column, Column], Column]) -> DataFrame:
    """The rows of each path after a fold in order: step(kept, row) gives the rows kept so far after one more row. For rules that look at
    what was kept, not at what came before. A path's rows are folded as one array."""
    fields = [order, *[c for c in rows.columns if c not in (*keys, order)]]
    gathered = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("__rows"))
    none = F.filter("__rows", lambda _: F.lit(False))
    return gathered.select(*keys, F.inline(F.aggregate("__rows", none, step)))


def appended(kept: Column, row: Column) -> Column:
    return F.concat(kept, F.array(row))


def last(kept: Column, field: str) -> Column:
    """A field of the last row kept; null if there is none."""
    return F.get(F.transform(kept, lambda k: k[field]), F.size(kept) - 1)


def unlike_kept(rows: DataFrame, keys: list[str], order: str, like: Callable[[Column, Column], Column]) -> DataFrame:
    """Rows in order, without those that are like one kept before. A row like a dropped one alone stays."""
    return folded(rows, keys, order, lambda kept, row: F.when(F.exists(kept, lambda k: like(k, row)), kept).otherwise(appended(kept, row)))


def distinct_routes(routes: DataFrame, keys: list[str], order: str = "rank") -> DataFrame:
    """Routes (keys, rank, minutes, distance_m, worst_incline) without those that are the same choice as an earlier one that stays: less than 1.5 minutes,
    150 m and half a per cent of slope apart."""
    steep = lambda r: F.abs(F.coalesce(r["worst_incline"], F.lit(0.0)))
    return unlike_kept(routes, keys, order, lambda a, b: (F.abs(a["minutes"] - b["minutes"]) < 1.5) & (F.abs(a["distance_m"] - b["distance_m"]) < 150) & (F.abs(steep(a) - steep(b)) < 0.5))


def rides(steps: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ride, line, origin, target, stops, start_m, end_m): each boarding with the first alighting after it and before the next boarding; transits
    between count as stops. Boards are named `station, line`; a boarding without an alighting is no ride."""
    board = F.col("kind") == "board"
    cut = segments(measured(steps, keys), keys, board & F.col("forward")).where("segment >= 0")
    within = _ordered([*keys, "segment"])
    off = board & ~F.col("forward")
    cut = cut.withColumn("offs", F.sum(off.cast("int")).over(within))
    first, final = F.col("seq") == F.min("seq").over(Window.partitionBy(*keys, "segment")), off & (F.col("offs") == 1)
    parts = F.split("name", ", ")
    named = cut.withColumn("station", F.coalesce(F.get(parts, F.lit(0)), F.lit(""))).withColumn("line", F.coalesce(F.array_join(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), ", "), F.lit("")))
    at = lambda when, c: F.max(F.when(when, F.col(c)))
    named = named.withColumn("first", first).withColumn("final", final)
    out = named.groupBy(*keys, "segment").agg(
        at(F.col("first"), "line").alias("line"), at(F.col("first"), "station").alias("origin"), at(F.col("final"), "station").alias("target"), F.count(F.when((F.col("kind") == "transit") & (F.col("offs") == 0), 1)).alias("stops"), at(F.col("first"), "at_m").alias("start_m"), at(F.col("final"), "at_m").alias("end_m")
    )
    number = F.row_number().over(_ordered(keys, "segment"))
    return out.where("end_m is not null").withColumn("ride", number).drop("segment")


def band() -> Column:
    """A step's slope band: 0 to 4 by per cent, UNKNOWN, STEPS, CARRIED; lifts and station ways are level."""
    slope = F.abs(F.coalesce("incline_max", "incline"))
    by_slope = F.lit(len(BANDS))
    for i, end in reversed(list(enumerate(BANDS))):
        by_slope = F.when(slope < end, i).otherwise(by_slope)
    return F.when(F.col("kind").isin(*RIDES), CARRIED).when(F.col("kind") == "steps", STEPS).when(F.col("kind").isin("elevator", "station_link"), 0).when(slope.isNull(), UNKNOWN).otherwise(by_slope)


def strip(steps: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, part, band, t0, t1, d0, d1): runs of one band with their metres along the path (t) and on the strip (d), where a ride is drawn
    between LEAST_RIDE and MOST_RIDE of the metres on foot."""
    rows = measured(steps, keys).withColumn("band", band())
    rows = segments(rows, keys, changes(F.col("band"), keys), "part")
    rows = rows.withColumn("walk", F.coalesce(F.sum(F.when(~F.col("kind").isin(*RIDES), F.col("length_m"))).over(Window.partitionBy(*keys)), F.lit(0.0)))
    parts = rows.groupBy(*keys, "part").agg(F.first("band").alias("band"), F.min("at_m").alias("t0"), F.max(F.col("at_m") + F.col("length_m")).alias("t1"), F.first("walk").alias("walk"))
    long = F.col("t1") - F.col("t0")
    drawn = F.when(F.col("band") == CARRIED, F.greatest(F.col("walk") * LEAST_RIDE, F.least(long, F.col("walk") * MOST_RIDE))).otherwise(long)
    end = F.sum("drawn").over(_ordered(keys, "part"))
    return parts.withColumn("drawn", drawn).withColumn("d1", end).withColumn("d0", F.col("d1") - F.col("drawn")).select(*keys, "part", "band", "t0", "t1", "d0", "d1")


def elevation(steps: DataFrame, starts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, point, d, z): heights along the path from its start (keys, z); z of a step is its far node's. Unknown heights are null, not 0."""
    points = measured(steps, keys).select(*keys, F.row_number().over(_ordered(keys)).alias("point"), C.js_round(F.col("at_m") + F.col("length_m")).alias("d"), (C.js_round(F.col("z") * 10) / 10).alias("z"))
    first = starts.select(*keys, F.lit(0).alias("point"), F.lit(0).cast("long").alias("d"), F.col("z"))
    return first.unionByName(points)


def place_name(borrowed: Column | None = None) -> Column:
    """What an edge is called: unnamed ones by their kind, borrowed names with what they were borrowed for."""
    name, kind = F.col("name"), F.col("kind")
    borrowed = F.lit(False) if borrowed is None else borrowed
    return (
        F.when(name.isNull() | (name == ""), F.when(kind == "steps", "unnamed steps").otherwise("a path"))
        .when(borrowed & (kind == "steps"), F.concat(F.lit("steps off "), name)).when(borrowed & (kind == "footway"), F.concat(F.lit("a path by "), name)).otherwise(name)
    )


def stretches(steps: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, stretch, name, edges, ways, m): the path's names outdoors in the order they are first reached; a street that one comes back to joins
    its first visit. edges in order; ways, the different ones, in the order they are first met."""
    rows = steps.where(~F.col("kind").isin(*INDOORS)).withColumn("place", place_name())
    found = rows.groupBy(*keys, "place").agg(F.min("seq").alias("from"), F.array_sort(F.collect_list(F.struct("seq", "edge", "way"))).alias("s"), F.sum("length_m").alias("m"))
    number = F.row_number().over(_ordered(keys, "from"))
    return found.select(*keys, number.alias("stretch"), F.col("place").alias("name"), F.transform("s", lambda x: x["edge"]).alias("edges"), F.array_distinct(F.filter(F.transform("s", lambda x: x["way"]), lambda w: w.isNotNull())).alias("ways"), C.js_round(F.col("m")).alias("m"))


def unknowns(steps: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rank, name, m, what, attrs): by street, the metres of steps about which something isn't known, what it is, and each attribute's first
    detail; the longest first, of equal ones the first reached. steps have reasons (kind, attr, detail)."""
    rows = steps.withColumn("gaps", F.filter("reasons", lambda r: r["kind"] == "unknown")).where("size(gaps) > 0").withColumn("street", F.coalesce("name", F.lit("an unnamed path")))
    found = rows.groupBy(*keys, "street").agg(C.js_round(F.sum("length_m")).alias("m"), F.min("seq").alias("from"), F.array_sort(F.collect_list(F.struct("seq", F.transform("gaps", lambda r: F.struct(r["attr"].alias("attr"), r["detail"].alias("detail"))).alias("g")))).alias("s"))
    gaps = F.flatten(F.transform("s", lambda x: x["g"]))
    first_of = F.transform(F.array_distinct(F.transform(gaps, lambda g: g["attr"])), lambda a: F.struct(a.alias("attr"), F.get(F.filter(gaps, lambda g: g["attr"] == a), F.lit(0))["detail"].alias("detail")))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("m"), "from"))
    return found.select(*keys, number.alias("rank"), F.col("street").alias("name"), "m", F.array_join(F.array_distinct(F.transform(gaps, lambda g: g["detail"])), ", ").alias("what"), first_of.alias("attrs"))


# How surfaces are called.
STONES = {"sett": "setts", "cobblestone": "cobbles"}


def hazards(steps: DataFrame, keys: list[str], miles: Column | None = None) -> DataFrame:
    """(keys, hazard, kind, at_m, length, title, detail): what to be warned of before one reaches it, in order of place.

    steps also have incline_max, surface, cross_slope, movable, kerb (`unmapped`, `inferred` or null), passable, and the person's comfort_pct and
    camber_pct. The same kind goes on if less than 5 m lie between and it is as steep; kerb warnings of one title less than 15 m after one that was
    told are told no more.
    """
    miles = F.lit(False) if miles is None else miles
    w = F.col("incline_max") * F.when(F.col("forward"), 1.0).otherwise(-1.0)
    long = F.col("length_m")
    none = F.lit(None).cast("string")
    item = lambda when, kind, rank, title, head, tail=None, at=F.col("at_m"), length=long: F.when(when, F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), at.cast("double").alias("at_m"), length.cast("double").alias("length"), title.alias("title"), head.alias("head"), (none if tail is None else F.lit(tail)).alias("tail")))
    steep = F.concat(C.js_round(F.abs(w)).cast("long").cast("string"), F.lit("% "), F.when(w > 0, "uphill").otherwise("downhill"))
    stone = C._lookup(STONES, F.col("surface"))
    end, zero = F.col("at_m") + long, F.lit(0.0)
    told = F.array(
        item((F.abs(w) >= F.greatest(F.lit(5.0), F.col("comfort_pct"))) & (long >= 5), "steep", 0, F.lit("Steep section"), steep),
        item(stone.isNotNull() & (long >= 10), "setts", 1, F.initcap(stone), F.lit("")),
        item((F.col("cross_slope") > F.col("camber_pct")) & (long >= 10), "camber", 2, F.lit("Pavement slopes sideways"), F.concat(C.js_round(F.col("cross_slope")).cast("long").cast("string"), F.lit("%"))),
        item(F.col("movable").isNotNull(), "bridge", 3, F.coalesce(F.col("name"), F.lit("Moving bridge")), F.concat(F.lit("closes when it "), F.when(F.col("movable") == "swing", "swings").otherwise("tilts"), F.lit(" for boats")), ""),
        item(F.col("kerb") == "unmapped", "kerb", 4, F.lit("Kerb not mapped"), F.lit("at the next crossing"), "", end, zero),
        item(F.col("kerb") == "inferred", "kerb", 4, F.lit("Dropped kerb expected"), F.lit("not confirmed"), "", end, zero),
        item((F.col("passable") == "unknown") & (long >= 20), "unknown", 5, F.lit("Missing data"), F.lit("")),
    )
    rows = measured(steps, keys).where(~F.col("kind").isin(*RIDES)).select(*keys, "seq", F.explode(F.filter(told, lambda x: x.isNotNull())).alias("h")).select(*keys, "seq", "h.*")
    # kinds go on by their own rules; a kerb is told unless one of its title was told just before, which only those less than KERB_M apart can tell
    kind_of = [*keys, "kind"]
    before = _ordered(kind_of)
    gap = F.col("at_m") - (F.lag("at_m").over(before) + F.lag("length").over(before))
    far = F.col("at_m") - F.max("at_m").over(before.rowsBetween(Window.unboundedPreceding, -1)) >= KERB_M
    is_kerb = F.col("kind") == "kerb"
    rows = segments(rows, kind_of, F.coalesce(F.when(is_kerb, far).otherwise((gap >= GAP_M) | (F.lag("head").over(before) != F.col("head"))), F.lit(True)), "run")
    fields = ["seq", "at_m", "length", "title", "head"]
    runs = rows.groupBy(*kind_of, "run").agg(
        F.first("rank").alias("rank"), F.first("tail").alias("tail"), F.struct(F.min("seq").alias("seq"), F.min("at_m").alias("at_m"), (F.max(F.col("at_m") + F.col("length")) - F.min("at_m")).alias("length"), F.min_by("title", "seq").alias("title"), F.min_by("head", "seq").alias("head")).alias("whole"),
        F.array_sort(F.collect_list(F.when(is_kerb, F.struct(*fields)))).alias("kerbs"),
    )
    told_on = lambda kept, r: F.when((r["at_m"] - last(kept, "at_m") < KERB_M) & (last(kept, "title") == r["title"]), kept).otherwise(appended(kept, r))
    kerbs = F.aggregate("kerbs", F.filter("kerbs", lambda _: F.lit(False)), told_on)
    both = runs.select(*kind_of, "rank", "tail", F.inline(F.when(is_kerb, kerbs).otherwise(F.array("whole"))))
    suffix = F.concat(F.lit("for "), length_text(F.col("length"), miles))
    detail = F.when(F.col("tail").isNotNull(), F.col("head")).when(F.col("head") == "", suffix).otherwise(F.concat_ws(" ", "head", suffix))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("at_m", "seq", "rank"))
    return both.select(*keys, number.alias("hazard"), "kind", "at_m", "length", "title", detail.alias("detail"))


def maneuvers(steps: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, number, type, at_m, text): what to do where. steps also have bearing_in and bearing_out (of the edge as walked, at its beginning and its
    end) and ref. Turns within 8 m of the last turn told belong to it and say what comes after both."""
    w = _ordered(keys)
    rows = measured(steps, keys)
    named = F.col("name").isNotNull() & (F.col("name") != "")
    rows = rows.withColumn("label", F.when(named, place_name())).withColumn("step", F.row_number().over(w))
    rows = rows.withColumn("was", F.lag("kind").over(w)).withColumn("was_label", F.lag("label").over(w)).withColumn("turned", turn(F.lag("bearing_out").over(w), F.col("bearing_in")))
    # a frame of all that follows would be read anew for every step
    far = F.when(F.col("kind") != "transit", F.struct("seq", "kind", "name"))
    rows = rows.withColumn("__far", far).withColumn("far", F.expr("lead(__far, 1) IGNORE NULLS").over(w)).withColumn("final", F.lead("step").over(w).isNull())
    rows = rows.withColumn("end_m", F.max(F.col("at_m") + F.col("length_m")).over(Window.partitionBy(*keys)).cast("double"))
    kind, at = F.col("kind"), F.col("at_m")
    parts = F.split(F.coalesce("name", F.lit("")), ", ")
    station, line = F.get(parts, F.lit(0)), F.array_join(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), ", ")
    to = F.when(F.col("far.kind") == "board", F.get(F.split(F.coalesce("far.name", F.lit("")), ", "), F.lit(0)))
    word = turn_word(F.col("turned"))
    renamed = F.col("label").isNotNull() & ~F.col("label").eqNullSafe(F.col("was_label"))
    onto = F.when(word == "Continue", F.concat(F.lit("Continue onto "), F.col("label"), F.lit("."))).when(renamed, F.concat(word, F.lit(" onto "), F.col("label"), F.lit("."))).otherwise(F.concat(word, F.lit(".")))
    say = lambda kind_, text: F.struct(F.lit(kind_).alias("type"), text.alias("text"))
    nothing = F.lit(None).cast("struct<type:string,text:string>")
    link = F.col("name")
    told = (
        F.when(F.col("step") == 1, say("start", F.concat(F.lit("Head off"), F.coalesce(F.concat(F.lit(" along "), F.col("label")), F.lit("")), F.lit("."))))
        .when(kind == "elevator", say("lift", F.lit("Take the lift.")))
        .when((kind == "station_link") & F.coalesce(F.col("ref").startswith("link:bus:"), F.lit(False)), nothing)
        .when(kind == "station_link", F.when(F.col("forward"), say("leave-station", F.concat(F.lit("Leave "), link, F.lit(" station.")))).otherwise(say("enter-station", F.concat(F.lit("Go into "), link, F.lit(" station.")))))
        .when((kind == "board") & F.col("forward"), say("board", F.concat(F.lit("Take the "), line, F.coalesce(F.concat(F.lit(" to "), to), F.lit("")), F.lit(" from "), station, F.lit("."))))
        .when(kind == "board", say("alight", F.concat(F.lit("Get off at "), station, F.lit("."))))
        .when(kind == "interchange", say("change", F.concat(link, F.lit("."))))
        .when(kind == "transit", nothing)
        .when((kind == "crossing") & (F.col("was") != "crossing"), say("cross", F.concat(F.lit("Cross "), F.coalesce("label", F.lit("the road")), F.lit("."))))
        .when(F.col("was").isin(*RIDES, "station_link"), nothing)
        .when((word != "Continue") | renamed, F.when(word == "Continue", say("continue", onto)).otherwise(say("turn", onto)))
    )
    # the end follows the last step in its row, so that paths stay where they are
    line_ = lambda seq, at_m, m: F.struct(seq.cast("long").alias("seq"), at_m.cast("double").alias("at_m"), m["type"].alias("type"), m["text"].alias("text"))
    rows = rows.withColumn("m", told)
    here, end = F.when(F.col("m").isNotNull(), line_(F.col("seq"), at, F.col("m"))), F.when(F.col("final"), line_(F.col("seq") + 1, F.col("end_m"), say("arrive", F.lit("You have arrived."))))
    steps_told = rows.select(*keys, F.inline(F.filter(F.array(here, end), lambda x: x.isNotNull())))
    # no turn reaches further than TURN_M, so what is folded are the runs of lines less apart
    apart = F.col("at_m") - F.max("at_m").over(w.rowsBetween(Window.unboundedPreceding, -1)) >= TURN_M
    steps_told = segments(steps_told, keys, ~F.col("type").isin("turn", "continue") | F.coalesce(apart, F.lit(True)), "near")
    joins = lambda kept, r: r["type"].isin("turn", "continue") & (last(kept, "type") == "turn") & (r["at_m"] - last(kept, "at_m") < TURN_M)

    def step(kept: Column, row: Column) -> Column:
        one = F.struct(last(kept, "seq").alias("seq"), last(kept, "at_m").alias("at_m"), last(kept, "type").alias("type"), row["text"].alias("text"))
        return F.when(joins(kept, row), F.concat(F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))), F.array(one))).otherwise(appended(kept, row))

    out = folded(steps_told, [*keys, "near"], "seq", step)
    return out.select(*keys, F.row_number().over(_ordered(keys)).alias("number"), "type", "at_m", "text")


def directions(steps: DataFrame, keys: list[str], miles: Column | None = None) -> DataFrame:
    """(keys, line, text): the path as a list to be read out. Steps of one name and kind in a row are one stretch with its length, slope, surface (the
    first known) and whether anything isn't known; stretches under 3 m are left out. A ride is one line; going to a bus stop's pole is none."""
    miles = F.lit(False) if miles is None else miles
    kind = F.col("kind")
    link = kind == "station_link"
    rows = steps.where(~(link & F.coalesce(F.col("ref").startswith("link:bus:"), F.lit(False))))
    name = F.when(F.col("name").isNotNull() & (F.col("name") != ""), place_name()).otherwise("path")
    walk = ~(link | kind.isin(*RIDES))
    said = F.when(walk, F.concat_ws("|", kind, name)).otherwise(F.concat(F.lit("#"), F.col("seq").cast("string")))
    # what a ride is made of is no line of its own, and doesn't part the stretches around it unless someone boards
    rows = rows.withColumn("walk", walk).withColumn("called", name).withColumn("said", said).where(walk | link | (kind == "interchange") | ((kind == "board") & F.col("forward")))
    rows = segments(rows, keys, changes(F.col("said"), keys))
    rise = F.coalesce(F.col("incline") * F.when(F.col("forward"), 1.0).otherwise(-1.0) * F.col("length_m") / 100, F.lit(0.0))
    first = lambda c: F.min_by(c, "seq")
    parts = rows.groupBy(*keys, "segment").agg(
        F.min("seq").alias("seq"), first("kind").alias("kind"), first("called").alias("called"), first("name").alias("name"), first("forward").alias("forward"), F.sum("length_m").alias("m"), F.sum(rise).alias("rise"),
        F.min_by("surface", F.when(F.col("surface").isNotNull(), F.col("seq"))).alias("surface"), F.max((F.col("passable") == "unknown").cast("int")).alias("unknown"),
    )
    boarded = rides(steps, keys).select(*keys, "ride", "line", "origin", "target", "stops")
    is_board = F.col("kind") == "board"
    parts = parts.withColumn("ride", F.when(is_board, F.sum(is_board.cast("int")).over(_ordered(keys)))).join(boarded, [*keys, "ride"], "left")
    slope = F.when(F.col("m") > 0, F.col("rise") / F.col("m") * 100).otherwise(0.0)
    told_slope = F.when(F.abs(slope) < 2, "level").otherwise(F.concat(F.when(slope > 0, "uphill").otherwise("downhill"), F.lit(" about "), C.js_round(F.abs(slope)).cast("long").cast("string"), F.lit("%")))
    stretch = F.concat(F.concat_ws(", ", F.when(F.col("called") == "path", "Path").otherwise(F.col("called")), length_text(F.col("m"), miles, precise=True), told_slope, F.coalesce(C._lookup(STONES, F.col("surface")), F.translate("surface", "_", " ")), F.when(F.col("unknown") == 1, "some details unknown")), F.lit("."))
    count = F.concat(F.col("stops").cast("string"), F.when(F.col("stops") == 1, " stop.").otherwise(" stops."))
    text = (
        F.when(F.col("kind") == "elevator", "Take the lift.")
        .when(F.col("kind") == "crossing", F.concat(F.lit("Cross "), F.when(F.col("called") == "path", "the road").otherwise(F.col("called")), F.lit(".")))
        .when(F.col("kind") == "station_link", F.when(F.col("forward"), F.concat(F.lit("Leave "), F.col("name"), F.lit(" station."))).otherwise(F.concat(F.lit("Go into "), F.col("name"), F.lit(" station."))))
        .when(F.col("kind") == "interchange", F.concat("name", F.lit(".")))
        .when(is_board, F.concat(F.lit("Take the "), F.col("line"), F.lit(" from "), F.col("origin"), F.lit(" to "), F.col("target"), F.lit(", "), count))
        .when(F.col("m") >= TOLD_M, stretch)
    )
    out = parts.withColumn("text", text).where("text is not null")
    return out.select(*keys, F.row_number().over(_ordered(keys)).alias("line"), "text")


def roads(steps: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, from, to): stretches driven on the road (`on_road`), those less than half a metre apart as one."""
    rows = measured(steps, keys).where("on_road").select(*keys, "seq", F.col("at_m").alias("from"), (F.col("at_m") + F.col("length_m")).alias("to"))
    w = _ordered(keys)
    rows = segments(rows, keys, F.coalesce(F.abs(F.col("from") - F.lag("to").over(w)) >= 0.5, F.lit(True)))
    return rows.groupBy(*keys, "segment").agg(F.min("from").alias("from"), F.max("to").alias("to")).drop("segment")


def seconds_left(along: DataFrame, road: DataFrame, keys: list[str]) -> DataFrame:
    """along (keys, along, length, speed, road_speed) with `left_s`: what is left at the pavement pace, its road stretches at road speed if there is one."""
    ahead = F.greatest(F.lit(0.0), F.col("to") - F.greatest("from", "along"))
    sums = along.select(*keys, "along").join(road, keys).groupBy(*keys, "along").agg(F.sum(ahead).alias("road"))
    left = F.greatest(F.lit(0.0), F.col("length") - F.col("along"))
    by_road = F.coalesce("road", F.lit(0.0))
    seconds = F.when(F.col("road_speed") > 0, (left - by_road) / F.col("speed") + by_road / F.col("road_speed")).otherwise(left / F.col("speed"))
    return along.join(sums, [*keys, "along"], "left").withColumn("left_s", seconds).drop("road")


def stops_along(visits: DataFrame, paths: DataFrame, spans: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Places passed, and the longest way between those of use: (keys, place, at_m, open) and (keys, longest_gap_m).

    visits: (keys, place, at_m, hours, disputed), `at_m` in metres along the path, hours true if the place's hours are known; paths: (keys, length, depart, speed), depart in
    microseconds; spans: (place, start, stop) in microseconds, when it is open, over midnight as well. Each place is asked at the time one passes:
    departure and the metres before it at the speed. Shut ones and disputed ones don't part a gap; unknown hours do.
    """
    passing = (F.col("depart") + F.col("at_m") / F.col("speed") * 1_000_000).cast("long")
    asked = visits.join(paths, keys).withColumn("when", passing)
    hit = asked.where("hours").join(spans, "place").where((F.col("when") >= F.col("start")) & (F.col("when") < F.col("stop"))).select(*keys, "place", "at_m").distinct().withColumn("found", F.lit(True))
    told = asked.join(hit, [*keys, "place", "at_m"], "left").withColumn("open", F.when(F.col("hours"), F.coalesce("found", F.lit(False))))
    usable = told.where("coalesce(open, true) and not disputed").select(*keys, C.js_round(F.col("at_m")).cast("double").alias("at_m"))
    ends = paths.select(*keys, F.explode(F.array(F.lit(0.0), F.col("length").cast("double"))).alias("at_m"))
    gap = F.col("at_m") - F.lag("at_m").over(_ordered(keys, "at_m"))
    gaps = usable.unionByName(ends).withColumn("gap", gap).groupBy(*keys).agg(C.js_round(F.coalesce(F.max("gap"), F.lit(0.0))).alias("longest_gap_m"))
    return told.select(*keys, "place", "at_m", "open", "disputed"), gaps


def on_route(items: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, place, section, text, label, source, date, until, places): what there is to know about a path, blocked before slower before info, else in the order found.
    items: (keys, seq, section, text, label, source, date, until, where); those of one section, text and source are told once, with the first label and
    date, the latest end and the different places in the order found."""
    one = items.groupBy(*keys, "section", "text", "source").agg(
        F.min("seq").alias("seq"), F.min_by("label", "seq").alias("label"), F.min_by("date", "seq").alias("date"), F.max("until").alias("until"), F.array_sort(F.collect_list(F.when(F.col("where").isNotNull(), F.struct("seq", "where")))).alias("w")
    )
    rank = F.when(F.col("section") == "blocked", 0).when(F.col("section") == "slower", 1).otherwise(2)
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(rank, "seq"))
    return one.select(*keys, number.alias("place"), "section", "text", "label", "source", "date", "until", F.array_distinct(F.transform("w", lambda x: x["where"])).alias("places"))
