"""What an edge or a node costs a person: ordered rules, the first exclusion ending them. Costs are seconds.

A rule is a set of columns (when it speaks, what it adds, its words). Cost, verdict and first exclusion are computed straight from
the rules, so the list of reasons costs nothing unless it is asked for. Persons (`p`) and conditions (`c`) are structs, literal
or joined: arcs x persons x conditions is one projection over a join with two small tables.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C

# Constants of the cost model, in seconds, metres, kilometres an hour and shares.
GUST_KMH, GUST_BRIDGE_M, ALERT_REST, ALERT_SUN = 50.0, 15.0, 0.25, 0.05
ICE_WHEELED, ICE_OTHERS = 1.0, 0.5
BUS_ALIGHT, BUS_LONGEST_WAIT, SPACE_TAKEN = 30.0, 1800.0, {"bus": 0.15, "tram": 0.05, "metro": 0.05}
METRO_LIFT_STATIONS = ("Monument", "Central Station", "Gateshead", "Haymarket", "St James", "Manors")
RISK_100M = {"incline": 60.0, "surface": 25.0, "width": 20.0}
UNKNOWN_KERB, LOWERED_KERB_CM, LIFT_WAIT, RIDE_MPS, BOARD_WAIT, ALIGHT, UNKNOWN_STATION = 120.0, 0.6, 45.0, 8.5, 240.0, 90.0, 900.0
LEVEL_STEP_MM, LEVEL_GAP_MM, STAFF_RAMP = 50.0, 85.0, 180.0
OUTDOOR = ("sidewalk", "footway", "pedestrian", "steps", "ramp", "street_proxy")
INDOORS = ("transit", "board", "corridor", "elevator", "escalator")
RAIL_KINDS = ("transit", "board", "interchange", "station_link")
SLIPPERY = ("sett", "cobblestone", "metal", "wood", "paving_stones")
UNCONFIRMED, GOOD_MOST, NOTE_MOST = 0.25, 0.5, 0.5

ATTR = "struct<value:{},state:string,at:timestamp>"
NUMBERS = ("incline", "incline_max", "cross_slope", "step_count", "width")
WORDS = ("surface", "wheelchair", "pavement")
FLAGS = ("covered", "lit", "gritted", "shared")
ARC = {
    "kind": "string", "forward": "boolean", "bidirectional": "boolean", "length_m": "double", "name": "string", "bridge": "boolean",
    **{k: ATTR.format("double") for k in NUMBERS}, **{k: ATTR.format("string") for k in WORDS}, **{k: ATTR.format("boolean") for k in FLAGS},
    "live": "struct<status:string,affects:string,headline:string,reason:string,valid_from:timestamp,valid_until:timestamp>",
    "service": "struct<mode:string,route:string,run_s:double,wd:array<int>,sa:array<int>,su:array<int>,bench:boolean,shelter:boolean,kerb:string>",
    "boarding": "array<struct<platform:string,step_min:double,step_max:double,gap_min:double,gap_max:double,ramp:boolean,level_at:string>>",
    "bench_m": "double", "note": "struct<count:int,score:double>", "community": "array<struct<category:string,level:string,confidence:double,detail:string>>",
}
CONDITIONS = {"now": "timestamp", "wet": "boolean", "ice": "boolean", "dark": "boolean", "ignore_closures": "boolean", "gust_kmh": "double", "alert": "struct<kind:string,level:string>"}


def arcs_of(df: DataFrame) -> DataFrame:
    """df with every column that the rules read: those it lacks are unknown (forward and bidirectional: true)."""
    for name, kind in ARC.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(True) if name in ("forward", "bidirectional") else F.lit(None).cast(kind))
    return df


def both_ways(edges: DataFrame) -> DataFrame:
    """Edges as arcs: each forward and backward."""
    return edges.withColumn("forward", F.explode(F.array(F.lit(True), F.lit(False))))


def conditions(**values: object) -> Column:
    """Conditions as a literal struct: now (a timestamp as text), wet, ice, dark, ignore_closures, gust_kmh, alert (kind, level)."""
    out = []
    for name, kind in CONDITIONS.items():
        value = values.get(name)
        if name == "alert" and value is not None:
            value = F.struct(F.lit(value[0]).alias("kind"), F.lit(value[1]).alias("level"))
        elif name in ("wet", "ice", "dark", "ignore_closures"):
            value = bool(value) if not isinstance(value, Column) else value
        out.append((value if isinstance(value, Column) else F.lit(value)).cast(kind).alias(name))
    return F.struct(*out)


def attr(value: Column, state: Column | str = "reported", at: Column | None = None) -> Column:
    return F.struct(value.alias("value"), (F.lit(state) if isinstance(state, str) else state).alias("state"), (F.lit(None).cast("timestamp") if at is None else at).alias("at"))


def is_known(a: Column) -> Column:
    return C.known(a["state"], a["value"])


def step_free(p: Column) -> Column:
    return (p["max_steps"] < 10) | ~p["escalators"]


def wheeled(p: Column) -> Column:
    return p["max_steps"] == 0


def scooter(p: Column) -> Column:
    return p["preset"].isin("mobility-scooter", "mobility-scooter-road")


def powerchair(p: Column) -> Column:
    return p["preset"].isin("powerchair", "powerchair-light")


def wind_sensitive(p: Column) -> Column:
    return scooter(p) | p["preset"].isin("manual-wheelchair", "manual-wheelchair-companion", "powerchair-light")


def has_battery(p: Column) -> Column:
    return scooter(p) | powerchair(p)


def needs_space(p: Column) -> Column:
    return p["preset"].isin("manual-wheelchair", "manual-wheelchair-companion") | powerchair(p)


def base_speed(kind: Column, p: Column) -> Column:
    return F.when(p["road_legal"] & (p["road_speed"] > 0) & (kind == "street_proxy"), p["road_speed"]).otherwise(p["speed"])


def bus_wait(hour: Column, minute: Column, day: Column, wd: Column, sa: Column, su: Column) -> Column:
    """(seconds, per_hour) until a vehicle comes: half the gap now, or until the first of the next hour, read from the same kind of
    day; null if none."""
    counts = F.when(day == "sa", sa).when(day == "su", su).otherwise(wd)
    at = lambda h: F.coalesce(F.get(counts, h), F.lit(0))
    now, later = at(hour), at(F.pmod(hour + 1, F.lit(24)))
    made = lambda s, n: F.struct(s.cast("double").alias("seconds"), n.cast("int").alias("per_hour"))
    return F.when(now > 0, made(F.greatest(F.lit(60.0), 3600.0 / (2 * F.nullif(now, F.lit(0)))), now)).when(later > 0, made((60 - minute) * 60 + 3600.0 / (2 * F.nullif(later, F.lit(0))), later))


def platform_fit(b: Column, p: Column) -> Column:
    """level, fits, doors, ramp, part, no or unknown for one platform against a person's limits."""
    step, gap = F.greatest(F.lit(LEVEL_STEP_MM), p["kerb_cm"] * 10), F.coalesce(p["max_gap_mm"], F.lit(LEVEL_GAP_MM))
    ramp = F.coalesce(b["ramp"], F.lit(False))
    some = (b["step_min"] <= step) & (b["gap_min"] <= gap)
    return (
        F.when(b["step_max"].isNull() | b["gap_max"].isNull(), F.when(ramp, "ramp").otherwise("unknown"))
        .when((b["step_max"] <= LEVEL_STEP_MM) & (b["gap_max"] <= LEVEL_GAP_MM), "level").when((b["step_max"] <= step) & (b["gap_max"] <= gap), "fits")
        .when(some & b["level_at"].isNotNull(), "doors").when(ramp, "ramp").otherwise(F.when(some, "part").otherwise("no"))
    )


@dataclass(frozen=True)
class Rule:
    """kind: excluded, penalty or unknown. critical: the edge isn't known to be passable."""

    kind: str
    attr: str
    when: Column
    seconds: Column
    detail: Column
    critical: bool = False


def _rule(kind: str, name: str, when: Column, seconds: Column | float = 0.0, detail: Column | str = "", critical: bool = False) -> Rule:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return Rule(kind, name, F.coalesce(when, F.lit(False)), lit(float("inf") if kind == "excluded" else seconds).cast("double"), lit(detail), critical)


def _percent(x: Column, word: Column | str) -> Column:
    return F.concat(F.format_number(x, 1), F.lit("% "), word if isinstance(word, Column) else F.lit(word))


def prepare(arcs: DataFrame) -> DataFrame:
    """arcs with p and c, and what several rules share: group, grade, worst, seconds, wait."""
    df, p, c = arcs_of(arcs), F.col("p"), F.col("c")
    kind, service = F.col("kind"), F.col("service")
    group = F.when(service.isNotNull(), "service").when(kind == "transit", "rail").when(kind.isin("board", "interchange"), "board").when(kind == "elevator", "lift").otherwise("ground")
    sign = F.when(F.col("forward"), 1.0).otherwise(-1.0)
    grade = F.when(is_known(F.col("incline")), F.col("incline.value") * sign).otherwise(0.0)
    steepest = F.when(is_known(F.col("incline_max")), F.col("incline_max.value") * sign).otherwise(grade)
    uk = F.from_utc_timestamp(F.to_utc_timestamp(c["now"], F.current_timezone()), "Europe/London")
    wait = bus_wait(F.hour(uk), F.minute(uk), F.when(F.dayofweek(uk) == 1, "su").when(F.dayofweek(uk) == 7, "sa").otherwise("wd"), service["wd"], service["sa"], service["su"])
    df = df.withColumn("group", group).withColumn("grade", grade).withColumn("worst", F.when(F.abs(grade) > F.abs(steepest), grade).otherwise(steepest))
    df = df.withColumn("wait", F.when(service.isNotNull() & (kind == "board") & F.col("forward"), wait))
    pace = base_speed(kind, p) * F.when(kind == "steps", 0.4).otherwise(C.speed_factor(F.col("grade"), wheeled(p)))
    ride = F.when(kind == "transit", F.coalesce(service["run_s"], F.col("length_m") / 5)).when(kind != "board", 0.0).when(~F.col("forward"), BUS_ALIGHT).otherwise(F.col("wait.seconds"))
    board = F.when(kind == "board", F.when(F.col("forward"), BOARD_WAIT).otherwise(ALIGHT)).otherwise(F.col("length_m") / F.least(p["speed"], F.lit(1.2)) + 60)
    seconds = F.when(F.col("group") == "service", ride).when(F.col("group") == "rail", F.col("length_m") / RIDE_MPS).when(F.col("group") == "board", board).when(F.col("group") == "lift", LIFT_WAIT).otherwise(F.col("length_m") / pace)
    return df.withColumn("seconds", seconds.cast("double"))


def edge_rules() -> list[Rule]:
    """All rules of edges, in order, over the columns of `prepare`."""
    p, c, kind, length, s, group = F.col("p"), F.col("c"), F.col("kind"), F.col("length_m"), F.col("seconds"), F.col("group")
    a = {k: F.col(k) for k in (*NUMBERS, *WORDS, *FLAGS)}
    cautious, wheels, needs = 1 - p["tolerance"], wheeled(p), step_free(p)
    live, service = F.col("live"), F.col("service")
    active = live.isNotNull() & (live["valid_until"] > c["now"]) & (live["valid_from"] <= c["now"]) & (~F.coalesce(live["affects"] == "step-free", F.lit(False)) | needs)
    doubtful = active & live["status"].isin("restricted", "degraded")
    ground, board, ride = group == "ground", group == "board", group == "service"
    entry = ride & (kind == "board") & F.col("forward")
    steps_known, surface, width = is_known(a["step_count"]), a["surface"]["value"], a["width"]["value"]

    fits = F.transform(F.coalesce(F.col("boarding"), F.array().cast(ARC["boarding"])), lambda b: platform_fit(b, p))
    ask = board & (kind == "board") & needs & (F.size(fits) > 0) & steps_known
    has = lambda *words: F.exists(fits, lambda f: f.isin(*words))
    unsure = ask & has("no", "part", "unknown") & F.exists(fits, lambda f: f != "no")
    no_station = board & needs & ~steps_known
    held_up = F.when(doubtful & (live["affects"] == "step-free") & (live["status"] == "restricted") & kind.isin("board", "station_link") & ~ride & ~no_station & ~unsure, UNKNOWN_STATION * cautious).otherwise(0.0)

    worst, mag = F.col("worst"), F.abs(F.col("worst"))
    sloped = ground & (is_known(a["incline_max"]) | is_known(a["incline"]))
    limit = F.when(worst >= 0, p["max_up"]).otherwise(p["max_down"])
    slope = _percent(mag, F.when(worst >= 0, "uphill").otherwise("downhill"))
    over = (mag - p["comfort"]) / F.greatest(F.lit(0.5), limit - p["comfort"])
    camber = a["cross_slope"]["value"] - p["camber"]
    age = F.timestamp_diff("SECOND", a["cross_slope"]["at"], c["now"]) / 86400.0
    trust = C.confidence(a["cross_slope"]["state"], age, F.lit(0), F.lit(False))
    risk = lambda name: length * RISK_100M[name] / 100 * cautious
    tolerance = F.try_element_at(p["surfaces"], surface)
    named = is_known(a["surface"]) & ground
    slippery = surface.isin(*SLIPPERY)
    wet = F.when(c["wet"] & slippery, p["wet_factor"]).otherwise(1.0)
    proxy = ground & (kind == "street_proxy")
    icy = ground & c["ice"] & is_known(a["gritted"]) & (kind != "steps")
    wait, w = F.col("wait.seconds"), needs_space(p)
    out = [
        _rule("excluded", "oneway", ~F.col("forward") & ~F.coalesce(F.col("bidirectional"), F.lit(False)), detail="one way only"),
        _rule("excluded", "live", active & (live["status"] == "closed") & ~c["ignore_closures"], detail=F.concat(F.when(live["affects"] == "step-free", F.when(live["headline"] == "No step-free access", "no step-free access: ").otherwise("lift out of service: ")).otherwise("closed: "), F.coalesce(live["reason"], F.lit("")))),
        _rule("unknown", "live", doubtful & (group != "lift"), held_up, F.concat(F.when((live["affects"] == "step-free") & live["headline"].isNotNull(), F.concat(live["headline"], F.lit(": "))).when(live["headline"].isNotNull(), "").otherwise(F.concat(live["status"], F.lit(": "))), F.coalesce(live["reason"], F.lit(""))), True),
        # buses, trams and the Metro
        _rule("excluded", "bus", ride & (service["mode"] == "bus") & ~p["buses"], detail="buses are turned off in your settings"),
        _rule("excluded", "bus", entry & (service["mode"] == "bus") & (p["preset"] == "mobility-scooter-road"), detail="road scooters are too big for buses"),
        _rule("excluded", "bus", entry & (service["mode"] == "bus") & (p["preset"] == "mobility-scooter") & ~p["scooter_permit"], detail="most buses only take small scooters, with a permit from the operator"),
        _rule("excluded", "bus", entry & (wait.isNull() | (wait > BUS_LONGEST_WAIT)), detail=F.concat(F.lit("no "), F.coalesce(service["route"], service["mode"]), F.lit(" from here at this time"))),
        _rule("penalty", "bus-wait", entry, 0.0, F.concat(F.lit("about "), F.col("wait.per_hour").cast("string"), F.lit(" an hour"))),
        _rule("unknown", "scooter", entry & (service["mode"] != "bus") & scooter(p), C.js_round(UNKNOWN_STATION * 0.5 * cautious), "check the operator's size rules for scooters", True),
        _rule("unknown", "station", entry & (service["mode"] == "metro") & needs & F.split_part("name", F.lit(", "), F.lit(1)).isin(*METRO_LIFT_STATIONS), C.js_round(UNKNOWN_STATION * 0.5 * cautious), "step-free only by lift, and there's no live lift status", True),
        _rule("penalty", "bus-seat", entry & (service["mode"] == "bus") & p["rest_m"].isNotNull() & (wait > 180) & (service["bench"] == F.lit(False)), C.js_round(wait * 0.5), "no seat at the stop"),
        _rule("unknown", "bus-seat", entry & (service["mode"] == "bus") & p["rest_m"].isNotNull() & (wait > 180) & service["bench"].isNull(), C.js_round(wait * 0.2 * cautious), "not known if the stop has a seat"),
        _rule("penalty", "bus-shelter", entry & (service["mode"] == "bus") & c["wet"] & (service["shelter"] == F.lit(False)) & (wait > 180), C.js_round(wait * 0.3), "no shelter at the stop"),
        _rule("penalty", "bus-kerb", entry & w & service["kerb"].isin("lowered", "flush", "no"), 60.0, F.concat(service["kerb"], F.lit(" kerb at the stop, so the ramp is steeper"))),
        _rule("penalty", "bus-space", entry & w, C.js_round(C._lookup(SPACE_TAKEN, service["mode"]) * 3600 / F.col("wait.per_hour")), "the wheelchair space may be in use"),
        _rule("penalty", "transit", (ride & (kind == "transit")) | (group == "rail"), 0.0, F.coalesce("name", F.lit("train"))),
        # stations
        _rule("excluded", "steps", board & needs & steps_known & (a["step_count"]["value"] > 0), detail="no step-free route to the platform"),
        _rule("unknown", "station", no_station, UNKNOWN_STATION * cautious, "step-free access not confirmed", True),
        _rule("excluded", "boarding", ask & F.forall(fits, lambda f: f == "no"), detail="step and gap between platform and train"),
        _rule("unknown", "boarding", unsure, UNKNOWN_STATION * cautious, "step and gap to the train on parts of a platform, or not published", True),
        _rule("penalty", "ramp", ask & ~has("no", "part", "unknown") & has("ramp"), STAFF_RAMP, "staff ramp onto the train: ask staff"),
        # lifts, escalators, steps
        _rule("penalty", "lift", group == "lift", 0.0, "lift"),
        _rule("excluded", "escalator", ground & (kind == "escalator") & ~p["escalators"], detail="escalator"),
        _rule("excluded", "steps", ground & (kind == "steps") & wheels, detail=F.when(steps_known, F.concat(a["step_count"]["value"].cast("int").cast("string"), F.lit(" steps"))).otherwise("steps")),
        _rule("excluded", "steps", ground & (kind == "steps") & steps_known & (a["step_count"]["value"] > p["max_steps"]), detail=F.concat(a["step_count"]["value"].cast("int").cast("string"), F.lit(" steps"))),
        _rule("unknown", "steps", ground & (kind == "steps") & ~steps_known & (p["max_steps"] < float("inf")), 0.0, "number of steps not known", True),
        _rule("excluded", "wheelchair", ground & (a["wheelchair"]["value"] == "no") & wheels, detail="marked not wheelchair accessible"),
        # slope, camber, ice
        _rule("excluded", "incline", sloped & (mag > limit + F.when(length < 10, 0.5).otherwise(0.0)), detail=slope),
        _rule("excluded", "incline", sloped & c["ice"] & wheels & (mag > p["comfort"]), detail=F.concat(slope, F.lit(" in ice"))),
        _rule("penalty", "incline", sloped & (mag > p["comfort"]), s * 2 * over * over, slope),
        _rule("unknown", "incline", ground & ~sloped & (kind != "steps") & (p["max_up"] < 50), risk("incline"), "gradient not known", True),
        _rule("penalty", "crossSlope", ground & is_known(a["cross_slope"]) & (camber > 0), s * F.least(F.lit(2.0), camber / 4) * trust, _percent(a["cross_slope"]["value"], "camber")),
        _rule("penalty", "gritted", icy, F.when(a["gritted"]["value"], 0.0).otherwise(s * F.when(wheels, ICE_WHEELED).otherwise(ICE_OTHERS)), F.when(a["gritted"]["value"], "on a gritting route").otherwise("not on a gritting route, so it may be icy")),
        # surface, width, pavement
        _rule("excluded", "surface", named & tolerance.isNull() & F.map_contains_key(p["surfaces"], surface), detail=surface),
        _rule("excluded", "surface", named & c["ice"] & wheels & slippery, detail=F.concat(surface, F.lit(" in ice"))),
        _rule("penalty", "surface", named & (tolerance * wet > 0), s * tolerance * wet, F.concat(surface, F.when(wet > 1, ", wet").otherwise(""))),
        _rule("unknown", "surface", ground & ~is_known(a["surface"]) & wheels, risk("surface"), "surface not known"),
        _rule("penalty", "width", ground & is_known(a["width"]) & (width < p["min_width"]) & (a["width"]["state"] == "inferred"), s, F.concat(F.lit("about "), F.format_number(width, 1), F.lit(" m wide"))),
        _rule("excluded", "width", ground & is_known(a["width"]) & (width < p["min_width"]) & (a["width"]["state"] != "inferred"), detail=F.concat(F.format_number(width, 1), F.lit(" m wide"))),
        _rule("unknown", "width", ground & ~is_known(a["width"]) & wheels & kind.isin("footway", "street_proxy"), risk("width"), "width not known"),
        _rule("penalty", "pavement", proxy & (a["pavement"]["value"] == "no"), s * F.when(p["road_legal"], 0.1).when(wheels, 0.6).otherwise(0.2), "no pavement: shared with traffic"),
        _rule("unknown", "pavement", proxy & ~F.coalesce(a["pavement"]["value"] == "no", F.lit(False)) & wheels & ~p["road_legal"], F.when(a["pavement"]["value"].isNotNull(), 12.0).otherwise(30.0) * cautious, F.when(a["pavement"]["value"].isNotNull(), "kerbs at side roads not mapped").otherwise("pavement not mapped"), True),
        _rule("penalty", "crossing", ground & (kind == "crossing") & wheels, 0.0, "crossing"),
        _rule("penalty", "rest", ground & (p["rest_m"] > 0) & (F.col("bench_m") > 30) & (kind != "crossing") & ~kind.isin(*RAIL_KINDS), s * F.least(F.lit(1.0), F.lit(300.0) / p["rest_m"]) * 0.6, "no bench nearby"),
    ]
    out += _crowd_rules(out, ground & ~kind.isin(*RAIL_KINDS))
    return out + _later_rules(next(r for r in out if r.attr == "rest"))


def _crowd_rules(before: list[Rule], where: Column) -> list[Rule]:
    """What people's notes and reports add or take off. They make nothing known and never lower the time itself."""
    p, c, s = F.col("p"), F.col("c"), F.col("seconds")
    risk = reduce(lambda x, r: x + F.when(r.when, r.seconds).otherwise(0.0), (r for r in before if r.kind == "unknown"), F.lit(0.0))
    score = F.col("note.score")
    noted = where & (F.col("note.count") > 0)
    good_note = risk * F.least(F.lit(NOTE_MOST), score * NOTE_MOST)
    wheels, needs = wheeled(p), step_free(p)
    reports = F.coalesce(F.col("community"), F.array().cast(ARC["community"]))
    blocks = lambda x: F.coalesce(F.when(x["category"] == "no-dropped-kerb", p["kerb_cm"] < 6).when(x["category"] == "steps", wheels).when(x["category"] == "broken-lift", needs).when(x["category"] == "blocked-pavement", wheels), F.lit(False)) & (x["level"] == "confirmed")
    full = lambda x: (
        F.when(x["category"] == "no-dropped-kerb", F.when(p["kerb_cm"] < 10, 45.0).otherwise(10.0)).when(x["category"] == "steps", F.when(needs, 60.0).otherwise(s * 0.2))
        .when(x["category"] == "broken-lift", F.when(needs, 120.0).otherwise(20.0)).when(x["category"] == "narrow-pavement", F.when(wheels, s + 30).otherwise(s * 0.2))
        .when(x["category"] == "blocked-pavement", s * 0.5 + F.when(wheels, 60.0).otherwise(20.0)).when(x["category"].isin("rough-surface", "steep"), s * F.when(wheels, 0.6).otherwise(0.2))
    )
    share = lambda x: F.when(blocks(x), 0.0).otherwise(C.js_round(full(x) * F.when(x["level"] == "confirmed", 1.0).otherwise(UNCONFIRMED)).cast("double"))
    bad = F.filter(reports, lambda x: full(x).isNotNull())
    total = F.aggregate(bad, F.lit(0.0), lambda t, x: t + F.greatest(share(x), F.lit(0.0)))
    good = F.array_max(F.transform(F.filter(reports, lambda x: full(x).isNull() & (x["level"] == "confirmed")), lambda x: x["confidence"]))
    off = C.js_round(risk * F.least(F.lit(GOOD_MOST), good * GOOD_MOST)).cast("double")
    return [
        _rule("penalty", "note", noted & (score < 0), s * F.least(F.lit(NOTE_MOST), -score * NOTE_MOST), "people's notes say it's hard going"),
        _rule("penalty", "note", noted & (score > 0) & (good_note > 0), -good_note, "people's notes say it went well"),
        _rule("excluded", "community", where & ~c["ignore_closures"] & F.exists(reports, blocks), detail="confirmed by people"),
        _rule("penalty", "community", where & (total > 0), total, "reported by people"),
        _rule("penalty", "community", where & (good > 0) & (risk > 0) & (off > 0), -off, "people confirm it's fine"),
    ]


def _later_rules(rest: Rule) -> list[Rule]:
    """Preferences and weather, added to what is passable."""
    p, c, kind, length, s = F.col("p"), F.col("c"), F.col("kind"), F.col("length_m"), F.col("seconds")
    shared, lit, covered = F.col("shared"), F.col("lit"), F.coalesce(F.col("covered.value"), F.lit(False))
    guess = F.when(shared["state"] == "inferred", 0.5).otherwise(1.0)
    dark = c["dark"] & (p["lit_per_100m"] > 0) & ~kind.isin(*INDOORS) & ~covered
    open_air = F.col("service").isNull() & kind.isin(*OUTDOOR) & ~covered
    sun = F.when(c["alert"]["kind"] == "heat", s * ALERT_SUN).otherwise(0.0)
    alert = C.js_round(F.when(rest.when, rest.seconds).otherwise(0.0) * ALERT_REST + sun)
    return [
        _rule("penalty", "cycles", (p["shared_per_100m"] > 0) & shared["value"], C.js_round(p["shared_per_100m"] * length / 100 * guess), "shared with cycles"),
        _rule("penalty", "lit", dark & (lit["value"] == F.lit(False)), C.js_round(p["lit_per_100m"] * length / 100), "not lit"),
        _rule("penalty", "lit", dark & ~is_known(lit), C.js_round(p["lit_per_100m"] * length / 100 * 0.5 * (1 - p["tolerance"])), "lighting not mapped"),
        _rule("penalty", "gust", open_air & (c["gust_kmh"] >= GUST_KMH) & F.col("bridge") & (length >= GUST_BRIDGE_M) & wind_sensitive(p), C.js_round(s), "exposed bridge in gusts"),
        _rule("penalty", "alert", open_air & c["alert"].isNotNull() & (p["rest_m"] > 0) & (alert > 0), alert, "health alert"),
    ]


def _judged(df: DataFrame, rules: list[Rule], reasons: bool) -> DataFrame:
    """df with excluded_by (the first exclusion's attr), passable, cost, and reasons if asked for."""
    bars = [r for r in rules if r.kind == "excluded"]
    out = df.withColumn("excluded_by", F.coalesce(*[F.when(r.when, r.attr) for r in bars]))
    total = reduce(lambda x, r: x + F.when(r.when, r.seconds).otherwise(0.0), (r for r in rules if r.kind != "excluded"), F.col("seconds"))
    critical = reduce(lambda x, r: x | r.when, (r for r in rules if r.critical), F.lit(False))
    out = out.withColumn("passable", F.when(F.col("excluded_by").isNotNull(), "no").when(critical, "unknown").otherwise("yes"))
    out = out.withColumn("cost", F.when(F.col("excluded_by").isNotNull(), F.lit(float("inf"))).otherwise(total))
    if reasons:
        each = F.filter(F.array(*[F.when(r.when, F.struct(F.lit(r.kind).alias("kind"), F.lit(r.attr).alias("attr"), r.detail.alias("detail"), r.seconds.alias("seconds"))) for r in rules]), lambda x: x.isNotNull())
        out = out.withColumn("reasons", each)
        first = F.array_position(F.transform("reasons", lambda x: x["kind"]), F.lit("excluded")).cast("int")
        out = out.withColumn("reasons", F.when(first > 0, F.slice("reasons", F.lit(1), first)).otherwise(F.col("reasons")))
    return out


def evaluate(arcs: DataFrame, reasons: bool = False) -> DataFrame:
    """arcs (columns of ARC, with the structs p and c) with seconds, excluded_by, passable, cost (infinite if excluded) and, if asked
    for, reasons up to the first exclusion. Columns that are missing count as unknown."""
    return _judged(prepare(arcs), edge_rules(), reasons).drop("group", "grade", "worst", "wait")


NODE = {
    "kind": "string", "via_crossing": "boolean",
    "entrance": "struct<door:string,automatic:string,step_count:double,width_m:double,wheelchair:string,ramp:boolean>",
    "kerb": f"struct<type:{ATTR.format('string')},height_cm:{ATTR.format('double')}>",
    "crossing": f"struct<control:{ATTR.format('string')},sound:{ATTR.format('boolean')},vibration:{ATTR.format('boolean')},tactile:{ATTR.format('boolean')}>",
}


def entrance_verdict(e: Column, p: Column) -> Column:
    """yes, no or unknown: nothing is called accessible because nothing says otherwise."""
    wheels = wheeled(p)
    powered = e["automatic"].isNotNull() & (e["automatic"] != "no")
    free = F.coalesce(e["wheelchair"] == "yes", F.lit(False)) | F.coalesce(e["step_count"] == 0, F.lit(False)) | F.coalesce(e["ramp"], F.lit(False))
    no = ((e["wheelchair"] == "no") & wheels) | ((e["door"] == "revolving") & ~powered & (wheels | (p["max_steps"] < 3)))
    small = (e["step_count"] > p["max_steps"]) | (e["width_m"] < p["min_width"])
    return F.when(F.coalesce(no, F.lit(False)) | F.coalesce(small, F.lit(False)), "no").when(wheels & ~free, "unknown").when(wheels & e["door"].isNull() & ~powered, "unknown").otherwise("yes")


def node_rules() -> list[Rule]:
    p = F.col("p")
    cautious, limit = 1 - p["tolerance"], p["kerb_cm"]
    lift = F.col("kind") == "elevator"
    here, kerb, cross = ~F.coalesce(lift, F.lit(False)), F.col("kerb"), F.col("crossing")
    kind, measured = kerb["type"]["value"], is_known(kerb["height_cm"])
    height = F.when(measured, kerb["height_cm"]["value"]).when(kind == "raised", 12.0).when(kind == "flush", 0.0).when(kind == "lowered", LOWERED_KERB_CM)
    there = here & kerb.isNotNull()
    cue, doubt = p["cues"], 0.5 * cautious
    asked = cross.isNotNull() & cue.isNotNull()
    control = cross["control"]["value"]
    lights = asked & is_known(cross["control"]) & ~control.isin("uncontrolled", "marked", "zebra")
    yes = lambda x: F.coalesce(x["value"], F.lit(False))
    mute = lights & ~yes(cross["sound"]) & ~yes(cross["vibration"])
    both = (cross["sound"]["value"] == F.lit(False)) & (cross["vibration"]["value"] == F.lit(False))
    return [
        _rule("penalty", "lift", lift, 0.0, "lift"),
        _rule("excluded", "entrance", here & F.col("entrance").isNotNull() & (entrance_verdict(F.col("entrance"), p) == "no"), detail="entrance"),
        _rule("unknown", "kerb", there & height.isNull() & (limit < 10), UNKNOWN_KERB * cautious, "kerb type not known", True),
        _rule("excluded", "kerb", there & (height > limit + F.when(measured, 0.0).otherwise(0.5)), detail=F.concat(F.coalesce(kind, F.lit("unknown")), F.lit(" kerb"))),
        _rule("penalty", "kerb", there & ~(height.isNull() & (limit < 10)), F.when((kerb["type"]["state"] == "inferred") & (limit < 10), UNKNOWN_KERB * 0.25 * cautious).otherwise(0.0), F.concat(F.coalesce(kind, F.lit("unknown")), F.lit(" kerb"))),
        _rule("unknown", "kerb", here & kerb.isNull() & F.col("via_crossing") & (limit < 10), UNKNOWN_KERB * cautious, "kerb at crossing not mapped", True),
        _rule("unknown", "crossing", asked & ~is_known(cross["control"]), C.js_round(cue["uncontrolled"] * doubt), "crossing type not mapped", True),
        _rule("penalty", "crossing", asked & is_known(cross["control"]) & control.isin("uncontrolled", "marked"), C.js_round(cue["uncontrolled"]), "no lights or zebra"),
        _rule("penalty", "crossing", asked & is_known(cross["control"]) & (control == "zebra"), C.js_round(cue["zebra"]), "zebra: nothing tells you traffic has stopped"),
        _rule("penalty", "crossing", mute & both, C.js_round(cue["silent"]), "lights with no beep or rotating cone"),
        _rule("unknown", "crossing", mute & ~F.coalesce(both, F.lit(False)), C.js_round(cue["silent"] * doubt), "not known if the lights beep or have a rotating cone", True),
        _rule("penalty", "crossing", asked & (cross["tactile"]["value"] == F.lit(False)), C.js_round(cue["no_tactile"]), "no tactile paving"),
        _rule("unknown", "crossing", asked & ~is_known(cross["tactile"]), C.js_round(cue["no_tactile"] * doubt), "tactile paving not mapped", True),
    ]


def evaluate_nodes(nodes: DataFrame, reasons: bool = False) -> DataFrame:
    """nodes (columns of NODE, with p) with seconds, excluded_by, passable, cost and, if asked for, reasons: kerbs, doors, single lifts, and
    what a crossing lacks for someone who crosses by sound and touch. via_crossing: the step before or after is a crossing."""
    for name, kind in NODE.items():
        if name not in nodes.columns:
            nodes = nodes.withColumn(name, F.lit(None).cast(kind))
    return _judged(nodes.withColumn("seconds", F.when(F.col("kind") == "elevator", LIFT_WAIT).otherwise(0.0)), node_rules(), reasons)
