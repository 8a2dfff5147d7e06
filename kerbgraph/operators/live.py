"""Live states: what feeds say about lifts, lines, works, floods, weather, and what of it lies on which edge and when.

A state is (ref or edge, status, affects, headline, reason, source, valid_from, valid_until); times are timestamps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import texts as T
from . import graph, relational

# Severities of a line's status, words for activities and licences, thresholds of weather and air.
CLOSED_SEVERITIES, NO_STEP_FREE_SEVERITY = (1, 2, 16, 20), 11
OTHER_LINES = r"(?i)\b(bakerloo|central|circle|district|hammersmith|metropolitan|northern|piccadilly|victoria|waterloo|elizabeth|overground)\b"
ACTIVITIES = {"skips": "A skip", "scaffolding": "Scaffolding", "hoarding": "A hoarding", "crane_mobile_platform": "A crane or mobile platform", "compound": "A works compound", "event": "An event", "section50": "Private works under licence", "section58": "Works"}
SITE_LICENCES = {"Scaffolding": "Scaffolding on the pavement", "Hoarding": "Hoarding on the pavement", "Containers/Cabins/Storage": "Site cabins or containers on the pavement", "Skip": "Skip on the pavement", "Materials": "Building materials on the pavement", "General Road Occupation": "Building site on the pavement"}
NOT_YET = ("Potential", "Advance Planning")
PAVEMENT = ("sidewalk", "footway", "pedestrian", "street_proxy", "ramp")
LIFT_TTL, FLOOD_TTL, RAIL_TTL, HORIZON_DAYS, WORKS_M, RIVER_HIGH_M = "15 minutes", "30 minutes", "30 minutes", 35, 8.0, 1.05
WALKWAY = r"^Water of Leith (Walkway|Path)$"


def strength(status: Column, affects: Column) -> Column:
    """closed for everyone, closed to those who need step-free ways, anything less."""
    return F.when(status == "closed", F.when(affects == "step-free", 2).otherwise(3)).otherwise(1)


def merge_states(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """One state a key: the stronger, of equal ones that of the first table, then the earlier and lesser."""
    both = first.withColumn("__from", F.lit(0)).unionByName(second.withColumn("__from", F.lit(1)))
    return relational.best_per_key(both.withColumn("__weak", -strength(F.col("status"), F.col("affects"))), [key], "__weak", "__from", "valid_from", "reason").drop("__weak", "__from")


def current_or_next(states: DataFrame, key: str, now: Column) -> DataFrame:
    """One state a key of those not yet over: one in force before one to come; of those the stronger, then the sooner, then the earlier in
    the feed (column `feed`). Feeds' own order decides what their pairwise rule leaves open."""
    live = states.where(F.col("valid_until") > now)
    ranked = live.withColumn("__later", (F.col("valid_from") > now).cast("int")).withColumn("__weak", -strength(F.col("status"), F.col("affects")))
    return relational.best_per_key(ranked, [key], "__later", "__weak", "valid_from", "feed").drop("__later", "__weak")


def line_disruptions(lines: DataFrame, fetched: Column) -> DataFrame:
    """(kind, line, stations, message, valid_from, valid_until) from line statuses (id, lineStatuses): closures and losses of step-free access, a
    row for each valid period, half an hour from the fetch if there is none."""
    rows = lines.where("id is not null").select(F.col("id").alias("line"), F.explode("lineStatuses").alias("s"))
    severity = F.coalesce(F.col("s.statusSeverity"), F.lit(10))
    kind = F.when(severity.isin(*CLOSED_SEVERITIES), "line-closed").when(severity == NO_STEP_FREE_SEVERITY, "line-no-step-free")
    stops = F.filter(F.transform(F.coalesce(F.col("s.disruption.affectedStops"), F.array()), lambda a: F.coalesce(a["naptanId"], a["id"], F.lit(""))), lambda x: x != "")
    text = F.trim(F.regexp_replace(F.coalesce(F.col("s.reason"), F.col("s.disruption.description"), F.lit("")), r"\s+", " "))
    return _periods(rows.select(kind.alias("kind"), "line", stops.alias("stations"), text.alias("message"), F.col("s.validityPeriods").alias("periods")).where("kind is not null"), fetched)


def station_disruptions(stations: DataFrame, fetched: Column) -> DataFrame:
    """As line_disruptions, of kind station, from (atcoCode, stationAtcoCode, description, fromDate, toDate)."""
    code = F.coalesce("stationAtcoCode", "atcoCode")
    text = F.trim(F.regexp_replace("description", r"\s+", " "))
    rows = stations.where(code.isNotNull() & (F.col("description") != "")).select(F.lit("station").alias("kind"), F.lit(None).cast("string").alias("line"), F.array(code).alias("stations"), text.alias("message"), F.array(F.struct("fromDate", "toDate")).alias("periods"))
    return _periods(rows, fetched)


def _periods(rows: DataFrame, fetched: Column) -> DataFrame:
    at = lambda x: F.try_to_timestamp(x)
    timed = F.transform(F.coalesce("periods", F.array()), lambda p: F.struct(at(p["fromDate"]).alias("valid_from"), at(p["toDate"]).alias("valid_until")))
    good = F.filter(timed, lambda p: F.coalesce(p["valid_until"] > p["valid_from"], F.lit(False)))
    default = F.array(F.struct(fetched.alias("valid_from"), (fetched + F.expr(f"interval {RAIL_TTL}")).alias("valid_until")))
    return rows.withColumn("p", F.explode(F.when(F.size(good) > 0, good).otherwise(default))).select("kind", "line", "stations", "message", "p.valid_from", "p.valid_until")


def rail_states(disruptions: DataFrame, rides: DataFrame, boards: DataFrame, lines: DataFrame, now: Column) -> DataFrame:
    """States of rides and boarding by ref. rides (ref, line, a, b), boards (ref, line, station), lines (line, name); disruptions carry `feed`, their
    place in the feed. A closure covers rides between named stations, or all of the line's; a station's message covers the lines it names,
    all if it names none, and nothing if it only names lines of others."""
    d = disruptions.withColumn("d", F.monotonically_increasing_id())
    closed = d.where("kind = 'line-closed'").join(rides, "line").where((F.size("stations") == 0) | (F.array_contains("stations", F.col("a")) & F.array_contains("stations", F.col("b"))))
    state = lambda status, affects, headline, source: [F.lit(status).alias("status") if isinstance(status, str) else status.alias("status"), (F.lit(affects) if affects is None or isinstance(affects, str) else affects).cast("string").alias("affects"), (F.lit(headline) if isinstance(headline, str) else headline).alias("headline"), F.col("message").alias("reason"), F.lit(source).alias("source"), "valid_from", "valid_until", "feed"]
    out = closed.select("ref", *state("closed", None, "No service", "TfL line status"))
    stops = d.withColumn("station", F.explode("stations"))
    lost = stops.where("kind = 'line-no-step-free'").join(boards, ["line", "station"])
    out = out.unionByName(lost.select("ref", *state("closed", "step-free", "No step-free access", "TfL line status")))
    read = stops.where("kind = 'station'").drop("line").withColumn("m", T.station_message(F.col("message"))).where("m.effect is not null")
    said = F.lower("message")
    named = read.join(F.broadcast(lines), said.contains(F.lower("name")) | ((F.col("line") == "dlr") & said.rlike(T.ascii_edges(r"\bdlr\b")))).groupBy("d").agg(F.collect_set("line").alias("named"))
    read = read.join(named, "d", "left").where(F.col("named").isNotNull() | ~F.col("message").rlike(T.ascii_edges(OTHER_LINES)))
    here = read.join(boards, "station").where(F.col("named").isNull() | F.array_contains("named", F.col("line")))
    part, effect = F.col("m.partial"), F.col("m.effect")
    headline = (
        F.when(effect == "no-step-free", F.when(part, "No step-free access to part of the station").otherwise("No step-free access"))
        .when(effect == "not-calling", F.when(part, "Trains don't stop at some platforms").otherwise("Trains don't stop here")).otherwise(F.when(part, "Part of the station closed").otherwise("Station closed"))
    )
    out = out.unionByName(here.select("ref", *state(F.when(part, "restricted").otherwise("closed"), F.when(effect == "no-step-free", "step-free"), headline, "TfL station disruptions")))
    return current_or_next(out, "ref", now)


def station_notes(disruptions: DataFrame, lines: DataFrame, stations: DataFrame, now: Column) -> DataFrame:
    """(station, message, valid_from, valid_until): messages of stations (station) that change nothing for routes, not over, about lines of ours
    or of nobody in particular; each message once, in its first period."""
    said = F.lower("message")
    rows = disruptions.where("kind = 'station'").where(F.col("valid_until") > now).where(T.station_message(F.col("message"))["effect"].isNull()).withColumn("station", F.explode("stations")).join(stations, "station", "left_semi")
    ours = rows.join(F.broadcast(lines), said.contains(F.lower("name")) | said.rlike(T.ascii_edges(r"\bdlr\b")), "left_semi")
    other = rows.where(~F.col("message").rlike(T.ascii_edges(OTHER_LINES)))
    return relational.best_per_key(ours.unionByName(other).select("station", "message", "valid_from", "valid_until"), ["station", "message"], "valid_from", "valid_until")


def step_free_lines(paths: DataFrame, platforms: DataFrame, out: DataFrame | None = None) -> DataFrame:
    """(station, line, access): yes if all of a line's platforms are reached from the street without steps, part if some, no if none, unknown if
    none and a way of unknown steps would do. paths (station, a, b, step_free: true, false or null, lifts); lifts in `out` (station, lift) are shut."""
    ways = paths
    if out is not None:
        shut = out.groupBy("station").agg(F.collect_set("lift").alias("out"))
        ways = paths.join(shut, "station", "left").where(F.col("out").isNull() | ~F.arrays_overlap("lifts", "out")).drop("out")
    node = lambda c: F.concat_ws("|", "station", c)
    both = lambda w: w.select(node("a").alias("src"), node("b").alias("dst")).union(w.select(node("b"), node("a")))
    starts = paths.select(F.concat_ws("|", "station", F.lit("street")).alias("root")).distinct()
    sure = graph.reach(both(ways.where("step_free")), starts).select(F.col("node").alias("n"), F.lit(True).alias("sure"))
    maybe = graph.reach(both(ways.where("step_free or step_free is null")), starts).select(F.col("node").alias("n"), F.lit(True).alias("maybe"))
    at = platforms.withColumn("n", node("platform")).join(sure, "n", "left").join(maybe, "n", "left")
    n, yes, perhaps = F.count("*"), F.count("sure"), F.count("maybe")
    return at.groupBy("station", "line").agg(F.when(yes == n, "yes").when(yes > 0, "part").when(perhaps > 0, "unknown").otherwise("no").alias("access"))


def lift_states(outages: DataFrame, before: DataFrame, after: DataFrame, boards: DataFrame, lines: DataFrame, links: DataFrame, hubs: DataFrame) -> DataFrame:
    """States of board and link edges by ref from lift outages (station, lifts, message, fetched).

    Where a layout tells what a line keeps (before, after: step_free_lines), all lifts out at the station count together: closed where every
    platform is cut off, restricted where some are. Elsewhere the message decides: the lines it names, the way to the street, or all
    platforms; never wider. links (ref, station), hubs (hub, station): an outage may name a hub."""
    outages = outages.select("station", "message", "fetched")
    until = (F.col("fetched") + F.expr(f"interval {LIFT_TTL}")).alias("valid_until")
    base = ["ref", "status", F.lit("step-free").alias("affects"), "headline", F.col("message").alias("reason"), F.lit("TfL Unified API lift disruptions").alias("source"), F.col("fetched").alias("valid_from"), until]
    joint = outages.groupBy("station").agg(F.array_join(F.array_sort(F.collect_set("message")), " ").alias("message"), F.min("fetched").alias("fetched"))
    change = before.withColumnRenamed("access", "was").join(after.withColumnRenamed("access", "now"), ["station", "line"]).where("was <> now")
    status = F.when((F.col("now") == "no") & (F.col("was") != "no"), "closed").when((F.col("now") == "part") & (F.col("was") == "yes"), "restricted")
    laid = change.withColumn("status", status).where("status is not null").join(joint, "station").join(boards, ["station", "line"]).withColumn("headline", F.when(F.col("status") == "restricted", "Lift out of service: step-free to some platforms only"))
    told = outages.withColumn("o", F.monotonically_increasing_id()).join(hubs.withColumnRenamed("station", "at"), F.col("station") == F.col("hub"), "left").withColumn("station", F.coalesce("at", "station")).drop("at", "hub")
    told = told.join(before.select("station").distinct(), "station", "left_anti")
    said = F.lower("message")
    named = told.join(F.broadcast(lines), said.contains(F.lower("name")) | said.contains(F.concat("line", F.lit(" line"))) | ((F.col("line") == "dlr") & said.rlike(T.ascii_edges(r"\bdlr\b")))).groupBy("o").agg(F.collect_set("line").alias("named"))
    told = told.join(named, "o", "left").withColumn("street", said.contains("street") & said.contains("ticket hall") & F.col("named").isNull())
    told = told.withColumn("status", F.lit("closed")).withColumn("headline", F.lit(None).cast("string"))
    wide = told.where("not street").join(boards, "station").where(F.col("named").isNull() | F.array_contains("named", F.col("line")))
    low = told.where("street").join(links, "station")
    rows = laid.select(*base).unionByName(wide.select(*base)).unionByName(low.select(*base))
    return relational.best_per_key(rows, ["ref"], F.col("status") != "closed", "valid_from", "reason")


def lift_outages(raw: DataFrame, fetched: Column) -> DataFrame:
    """(station, name, lifts, message, alternative, fetched) from (stationUniqueId, disruptedLiftUniqueIds, message); rows without a station or a list
    of lifts go. name: from the message's head; alternative: the message says that step-free access is still there."""
    message = F.trim(F.coalesce("message", F.lit("")))
    head = F.nullif(F.regexp_extract("message", r"^([A-Z0-9'&.\- ]+?) STATION:", 1), F.lit(""))
    name = F.regexp_replace(F.initcap(head), r"'S\b", "'s")
    rows = raw.where("stationUniqueId is not null and disruptedLiftUniqueIds is not null")
    return rows.select(F.col("stationUniqueId").alias("station"), name.alias("name"), F.col("disruptedLiftUniqueIds").alias("lifts"), message.alias("message"), F.coalesce(F.col("message").rlike("(?i)step-free access is (still )?available"), F.lit(False)).alias("alternative"), fetched.alias("fetched"))


def flood_warnings(raw: DataFrame) -> DataFrame:
    """(area, severity, name, description, message, raised) of warnings of severity 1 to 4 (floodAreaID, severityLevel, severity, ...)."""
    text = F.nullif(F.trim(F.regexp_replace("message", r"\s+", " ")), F.lit(""))
    return raw.where("floodAreaID is not null and severityLevel between 1 and 4").select(F.col("floodAreaID").alias("area"), F.col("severityLevel").cast("int").alias("severity"), F.coalesce("severity", F.lit("Flood warning")).alias("name"), F.trim(F.coalesce("description", F.lit(""))).alias("description"), text.alias("message"), F.col("timeRaised").alias("raised"))


def flood_states(warnings: DataFrame, areas: DataFrame, fetched: Column) -> DataFrame:
    """States by edge key: severe warnings close, warnings restrict, alerts do nothing; the worst of an edge. areas (area, label, key)."""
    rows = warnings.where("severity <= 2").join(areas, "area").select("key", "severity", F.when(F.col("severity") == 1, "closed").otherwise("restricted").alias("status"), F.concat("name", F.lit(" for "), "label").alias("reason"), F.lit("Environment Agency flood warnings").alias("source"), fetched.alias("valid_from"), (fetched + F.expr(f"interval {FLOOD_TTL}")).alias("valid_until"))
    return relational.best_per_key(rows, ["key"], "severity", "reason").drop("severity")


def floods_here(warnings: DataFrame, areas: DataFrame) -> DataFrame:
    """(rank, severity, name, label) of the warnings in force for known areas, worst first."""
    rows = warnings.where("severity < 4").join(areas.select("area", "label").distinct(), "area")
    return rows.select("severity", "name", "label", F.row_number().over(Window.orderBy("severity", "label", "name")).alias("rank"))


def upsert_stronger(current: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """current with incoming states put in where they are stronger: closed before anything else before nothing."""
    rank = F.when(F.col("status") == "closed", 2).otherwise(1)
    both = current.withColumn("__new", F.lit(0)).unionByName(incoming.withColumn("__new", F.lit(1)))
    return relational.best_per_key(both.withColumn("__weak", -rank), [key], "__weak", "__new", "valid_from", "reason").drop("__weak", "__new")


def permits(rows: DataFrame, now: Column) -> DataFrame:
    """Works from permits that close or lie on the footway, not finished, cancelled or over: (id, source, headline, geom, footway, description, street,
    start, end, observed_at). geom stays in the feed's own coordinates."""
    close = F.lower(F.coalesce("close_footway", F.lit("")))
    walkway = close.contains("walkway")
    closes = close.startswith("yes") & ~walkway
    on = walkway | F.coalesce(F.col("location_type").rlike("(?i)foot"), F.lit(False))
    end = F.coalesce("end", "proposed_end")
    gone = F.coalesce(F.col("status") == "completed", F.lit(False)) | F.coalesce(F.col("event_type") == "WORK_STOP", F.lit(False)) | F.coalesce(F.col("permit_status").rlike("(?i)cancel|refus|revok"), F.lit(False))
    what = F.concat_ws(" ", F.nullif("activity", F.lit("")), F.concat(F.lit("by "), F.nullif("promoter", F.lit(""))))
    words = F.when(closes, "Pavement closed for works, with a signed diversion").when(walkway, "Pavement closed, temporary walkway alongside").otherwise("Works on the pavement")
    kept = rows.where(~gone & (closes | on) & F.col("start").isNotNull() & (F.try_to_timestamp(end) > now) & F.col("geom").rlike("[0-9]"))
    return kept.select(F.concat(F.lit("sm:"), "ref").alias("id"), F.lit("Street Manager").alias("source"), F.lit(None).cast("string").alias("headline"), "geom", F.when(closes, "closed").otherwise("affected").alias("footway"), F.concat(words, F.when(what != "", F.concat(F.lit(" ("), what, F.lit(")"))).otherwise("")).alias("description"), T.title(F.col("street")).alias("street"), "start", end.alias("end"), F.col("event_time").alias("observed_at"))


def day_time(date: Column, time: Column, end: bool) -> Column:
    """A date with its time if there is one; without, its start or its last second."""
    day = F.substring(date, 1, 10)
    clock = F.coalesce(F.nullif(F.regexp_extract(time, r"T(\d\d:\d\d)", 1), F.lit("")), F.nullif(F.regexp_extract(time, r"^(\d\d:\d\d)", 1), F.lit("")))
    return F.try_to_timestamp(F.concat(day, F.lit(" "), F.coalesce(F.concat(clock, F.lit(":00")), F.lit("23:59:59" if end else "00:00:00"))))


def activities(rows: DataFrame, now: Column) -> DataFrame:
    """Works from skips, scaffolding and the like on a footway or path, a row for each part of their shape; ended, cancelled and those that start in
    more than 35 days go. Free text is read for closures only and never shown."""
    start, end = day_time(F.col("start_date"), F.col("start_time"), False), day_time(F.col("end_date"), F.col("end_time"), True)
    dead = F.coalesce(F.col("event_type") == "ACTIVITY_CANCELLED", F.lit(False)) | F.coalesce(F.lower("cancelled") == "yes", F.lit(False))
    kept = rows.where(~dead & F.col("location_type").rlike("(?i)foot")).withColumn("start", start).withColumn("end", end)
    kept = kept.where((F.col("end") > now) & (F.col("start") <= now + F.expr(f"interval {HORIZON_DAYS} days")))
    where = F.when(F.col("location_type").rlike("(?i)footway"), "pavement").otherwise("path")
    shut = T.says(F.concat_ws(" ", F.coalesce("name", F.lit("")), F.coalesce("details", F.lit("")), F.coalesce("location_description", F.lit(""))), T.FOOTWAY_CLOSED)
    headline = F.concat(F.coalesce(C._lookup(ACTIVITIES, F.col("activity")), F.lit("An obstruction")), F.lit(" on the "), where)
    text = F.when(shut, F.concat(F.initcap(where), F.lit(" closed"))).otherwise(headline)
    made = kept.select("ref", F.lit("Street Manager").alias("source"), headline.alias("headline"), T.wkt_parts(F.col("geom")).alias("parts"), F.when(shut, "closed").otherwise("affected").alias("footway"), text.alias("description"), T.title(F.col("street")).alias("street"), "start", "end", F.col("event_time").alias("observed_at"))
    return _each_part(made, "sma:")


def _each_part(rows: DataFrame, prefix: str) -> DataFrame:
    each = rows.select("*", F.posexplode("parts").alias("i", "line"))
    return each.withColumn("id", F.concat(F.lit(prefix), "ref", F.when(F.size("parts") > 1, F.concat(F.lit("#"), F.col("i").cast("string"))).otherwise(""))).drop("ref", "parts", "i")


def street_segments(rows: DataFrame, now: Column) -> DataFrame:
    """Works from street disruptions whose comments speak of the pavement (distruptedStreetId, streetName, lineString, comments, endDateTime, ...)."""
    text = F.lower(F.coalesce("comments", F.lit("")))
    line = F.from_json("lineString", "array<array<double>>")
    kept = rows.where(text.rlike("footway|pavement|footpath|pedestrian") & (F.try_to_timestamp("endDateTime") > now)).withColumn("l", line).where("l is not null")
    shut = T.says(text, T.STREET_CLOSED)
    return kept.select(F.concat(F.lit("tfl:"), "distruptedStreetId").alias("id"), F.lit("TfL road disruptions").alias("source"), F.lit(None).cast("string").alias("headline"), F.transform("l", lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))).alias("line"), F.when(shut, "closed").otherwise("affected").alias("footway"), F.when(shut, "Pavement closed").otherwise("Works affecting the pavement").alias("description"), T.title(F.col("streetName")).alias("street"), F.col("startDateTime").alias("start"), F.col("endDateTime").alias("end"))


def register_rows(rows: DataFrame, now: Column) -> DataFrame:
    """Works from a road-works register that matter on foot: on the footway, closures that speak of it, café tables, site licences, events."""
    text, licence, traffic = F.concat_ws(" ", "location", "description"), F.col("licence"), F.col("traffic")
    on = (traffic == "Works Entirely On The Footway") | F.col("location").rlike(T.ascii_edges(r"(?i)\b(on|o/s)?\s*f/ ?w(ay)?\b"))
    shut, words = T.says(text, T.FOOTWAY_CLOSED), text.rlike(T.ascii_edges(T.FOOTWAY_WORDS))
    event = (licence == "Public Event") | (F.col("category") == "Event")
    headline = (
        F.when(licence == "Street Café", "Café tables on the pavement").when(licence.isin(*SITE_LICENCES), F.when(on, C._lookup(SITE_LICENCES, licence)))
        .when(event, F.when((on | words) & (licence != "Seasonal Embargo"), "Event on the pavement")).when(traffic == "Works Entirely On The Footway", F.when(shut, "Pavement closed").otherwise("Works on the pavement"))
        .when((traffic == "Road Closure") & words, F.when(shut, "Road and pavement closed").otherwise("Road closed, works on the pavement"))
    )
    start, end = F.try_to_timestamp("start"), F.try_to_timestamp("end")
    kept = rows.where(~F.col("status").isin(*NOT_YET) & (end > now) & (start <= now + F.expr(f"interval {HORIZON_DAYS} days"))).withColumn("headline", headline).where("headline is not null")
    footway = F.when(shut & (licence != "Street Café"), "closed").otherwise("affected")
    made = kept.select("ref", F.lit("Scottish Road Works Register").alias("source"), "headline", T.wkt_parts(F.col("geom")).alias("parts"), footway.alias("footway"), F.when((footway == "closed") & ~F.col("headline").contains("closed"), "Pavement closed").otherwise(F.col("headline")).alias("description"), F.regexp_replace("street", r"\s*\(plus \d+ more\)$", "").alias("street"), "start", "end", F.coalesce("updated", "start").alias("observed_at"))
    return _each_part(made, "srwr:")


def works_states(works: DataFrame, edges: DataFrame, now: Column) -> DataFrame:
    """(edge, status, headline, reason, source, valid_from, valid_until): works (id, line of (lon, lat), footway, headline, description, street, source, start, end,
    feed) put on the pavement edges (edge, kind, line) whose middle lies within 8 m, 12 of a single point. Of several a closure stays, else the
    last in the feed."""
    w = works.where(F.col("end") > now).where(F.size("line") > 0)
    n = F.size("line")
    legs = F.when(n == 1, F.array(F.struct(F.col("line")[0].alias("a"), F.col("line")[0].alias("b")))).otherwise(F.zip_with(F.slice("line", F.lit(1), n - 1), F.slice("line", F.lit(2), n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))
    segments = w.select("id", F.when(n == 1, WORKS_M * 1.5).otherwise(WORKS_M).alias("reach"), F.explode(legs).alias("g")).select("id", "reach", F.col("g.a.lon").alias("ax"), F.col("g.a.lat").alias("ay"), F.col("g.b.lon").alias("bx"), F.col("g.b.lat").alias("by"))
    middle = F.element_at("line", (F.floor(F.size("line") / 2) + 1).cast("int"))
    points = edges.where(F.col("kind").isin(*PAVEMENT)).select(F.col("edge").alias("a"), middle["lon"].alias("lon"), middle["lat"].alias("lat"))
    near = relational.segment_join(points, segments, WORKS_M * 1.5).where("distance_m <= reach").select(F.col("a").alias("edge"), "id").distinct()
    status = F.when(F.col("footway") == "closed", "closed").otherwise("degraded")
    reason = F.concat("description", F.when(F.col("street") != "", F.concat(F.lit(" on "), "street")).otherwise(""), F.lit(" until "), F.date_format("end", "yyyy-MM-dd"))
    said = w.select("id", status.alias("status"), "headline", reason.alias("reason"), "source", F.col("start").alias("valid_from"), F.col("end").alias("valid_until"), (-F.col("feed")).alias("late"))
    return relational.best_per_key(near.join(said, "id"), ["edge"], F.col("status") != "closed", "late").drop("late", "id")


def works_summary(states: DataFrame) -> DataFrame:
    """(closed, affected): how many works close or affect a pavement; parts of one (after #) count once, and one that does both is closed."""
    ids = states.groupBy(F.split_part("id", F.lit("#"), F.lit(1)).alias("id")).agg(F.max((F.col("footway") == "closed").cast("int")).alias("closed"))
    return ids.agg(F.coalesce(F.sum("closed"), F.lit(0)).alias("closed"), F.coalesce(F.sum(1 - F.col("closed")), F.lit(0)).alias("affected"))


def rain(code: Column) -> Column:
    return code.between(51, 67) | code.between(80, 82) | (code >= 95)


def snow(code: Column) -> Column:
    return code.between(71, 77) | code.isin(85, 86)


def freezing(code: Column) -> Column:
    return code.isin(56, 57, 66, 67)


def weather(asked: DataFrame, hourly: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """(id, wet, ice, gust_kmh, at) for instants asked (id, place, t) from hourly rows (place, time, precipitation, temperature, code, snowfall, gust).

    The hour is the last that has begun, if not more than an hour ago. Ice: snow or freezing rain, snow in the last 3 hours, or 1 degree at most in
    12 hours with more than 0.2 mm; wet: ice, rain, or more than 0.2 mm in 3 hours. Without such an hour the current row (place, wet, ice,
    gust_kmh) stands in, if there is one.
    """
    hours = asked.withColumn("ago", F.explode(F.sequence(F.lit(0), F.lit(12)))).withColumn("hour", F.date_trunc("hour", "t") - F.make_interval(hours=F.col("ago")))
    rows = hours.join(hourly.select("place", F.date_trunc("hour", "time").alias("hour"), "time", "precipitation", "temperature", "code", "snowfall", "gust"), ["place", "hour"]).where("time <= t")
    age = F.timestamp_diff("SECOND", F.col("time"), F.col("t"))
    within = lambda h: age < h * 3600
    latest = F.max_by(F.struct("time", "code", "temperature", "gust"), "time").alias("now")
    found = rows.groupBy("id").agg(
        latest, F.sum(F.when(within(3), F.coalesce("precipitation", F.lit(0.0))).otherwise(0.0)).alias("rain3"), F.sum(F.when(within(12), F.coalesce("precipitation", F.lit(0.0))).otherwise(0.0)).alias("rain12"),
        F.min(F.when(within(12), F.coalesce("temperature", F.lit(10.0)))).alias("low"), F.max(F.when(within(3), F.coalesce("snowfall", F.lit(0.0)))).alias("fell"),
    )
    code = F.coalesce("now.code", F.lit(0))
    ice = snow(code) | freezing(code) | (F.coalesce("fell", F.lit(0.0)) > 0) | ((F.col("low") <= 1) & (F.col("rain12") > 0.2))
    found = found.withColumn("ice", F.coalesce(ice, F.lit(False)))
    out = asked.join(found, "id", "left").withColumn("fresh", F.coalesce(F.timestamp_diff("SECOND", F.col("now.time"), F.col("t")) <= 3600, F.lit(False)))
    wet = F.col("ice") | rain(F.coalesce("now.code", F.lit(0))) | (F.col("rain3") > 0.2)
    told = out.select("id", "place", F.when(F.col("fresh"), wet).alias("wet"), F.when(F.col("fresh"), F.col("ice")).alias("ice"), F.when(F.col("fresh"), F.col("now.gust")).alias("gust_kmh"), F.when(F.col("fresh"), F.col("now.time")).alias("at"))
    if current is None:
        return told.drop("place")
    spare = current.select("place", F.col("wet").alias("w"), F.col("ice").alias("i"), F.col("gust_kmh").alias("g"))
    return told.join(spare, "place", "left").select("id", F.coalesce("wet", "w").alias("wet"), F.coalesce("ice", "i").alias("ice"), F.coalesce("gust_kmh", "g").alias("gust_kmh"), "at")


def air_notes(aqi: Column, grass: Column, birch: Column, alder: Column, uv: Column) -> Column:
    """Notes on the air, none where it is fine: quality from 60, pollen from 50 (grass) or 80, sun from 6."""
    quality = F.when(aqi >= 100, "extremely poor").when(aqi >= 80, "very poor").when(aqi >= 60, "poor")
    pollen = F.array_join(F.filter(F.array(F.when(grass >= 50, "grass"), F.when(birch >= 80, "birch"), F.when(alder >= 80, "alder")), lambda x: x.isNotNull()), ", ")
    sun = F.when(uv >= 11, "extreme").when(uv >= 8, "very high").when(uv >= 6, "high")
    whole = lambda x: C.js_round(x).cast("string")
    notes = F.array(F.concat(F.lit("Air quality "), quality, F.lit(" (European AQI "), whole(aqi), F.lit(")")), F.when(pollen != "", F.concat(F.lit("Pollen high: "), pollen)), F.concat(F.lit("UV "), sun, F.lit(" (index "), whole(uv), F.lit(")")))
    return F.filter(notes, lambda x: x.isNotNull())


def in_season(kind: Column, at: Column) -> Column:
    """Heat alerts count from June to September, cold ones from November to March, by the UK's months."""
    month = F.month(F.from_utc_timestamp(F.to_utc_timestamp(at, F.current_timezone()), "Europe/London"))
    return F.when(kind == "heat", month.between(6, 9)).otherwise((month >= 11) | (month <= 3))


def alert_in_force(kind: Column, until: Column, at: Column) -> Column:
    return in_season(kind, at) & F.coalesce(at < until, F.lit(True))


def strongest_alert(alerts: DataFrame, keys: list[str]) -> DataFrame:
    """Of alerts (keys, kind, level, until) one a key: red before amber, heat before cold."""
    return relational.best_per_key(alerts.where(F.col("level").isin("amber", "red")), keys, F.col("level") != "red", F.col("kind") != "heat", "until")


def arrivals(rows: DataFrame, line: Column) -> DataFrame:
    """(stop, line, minutes): minutes until the next three of a line at each stop, from (stop, lineName, timeToStation)."""
    kept = rows.where(F.lower("lineName") == F.lower(line)).select("stop", F.col("lineName").alias("line"), C.js_round(F.col("timeToStation") / 60).alias("m"))
    first = kept.withColumn("r", F.row_number().over(Window.partitionBy("stop", "line").orderBy("m"))).where("r <= 3")
    return first.groupBy("stop", "line").agg(F.array_sort(F.collect_list("m")).alias("minutes"))


def river_high(metres: Column) -> Column:
    return F.coalesce(metres >= RIVER_HIGH_M, F.lit(False))


def uses_walkway(names: Column) -> Column:
    return F.exists(names, lambda n: F.coalesce(n.rlike(WALKWAY), F.lit(False)))
