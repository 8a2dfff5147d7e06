"""What a person could have instead of the chosen route, and what to do where there is none: many changed copies of a request searched together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.texts import length_text
from ..sources.scratch import written
from . import routing

Arcs = Callable[[DataFrame], DataFrame]
#: Metres of setts that count, metres of unknowns that must go, and what share of the old gap a new one may be at most.
SETTS_M, FEWER_M, CLEARLY = 20.0, 20.0, 0.85
#: Rungs of the ladders of gaps, as multiples of the person's own interval, and for benches as shares of the route's longest gap; how many are tried.
BENCH_RUNGS, GAP_SHARES, TRIES, TOILET_RUNGS = (8.0, 6.0, 4.0, 3.0, 2.0, 1.5, 1.0), (0.7, 0.5), 2, (1.0, 1.5, 2.0, 3.0)
#: A route with more benches may cost this many times the chosen one, or this many seconds more.
DEARER, ALLOWANCE = 2.0, 900.0
STONES = ("sett", "cobblestone")


def walked(steps: DataFrame, requests: DataFrame, arcs: DataFrame) -> DataFrame:
    """steps with what the profile's arcs say of them. arcs: (profile, src, dst, edge, cost, length, seconds, surface, slope, unknown); slope as walked."""
    told = arcs.groupBy("profile", "src", "dst", "edge").agg(F.min_by(F.struct("cost", "length", "seconds", "surface", "slope", "unknown"), "cost").alias("a"))
    return steps.select("request", "seq", "edge", "src", "dst").join(requests.select("request", "profile"), "request").join(told, ["profile", "src", "dst", "edge"]).select("request", "profile", "seq", "edge", "src", "dst", "a.*")


def sums(walk: DataFrame) -> DataFrame:
    """(request, cost, seconds, length, setts_m, worst, unknown_m): a route's totals; worst is its steepest known slope, up or down."""
    metres = lambda when: F.coalesce(F.sum(F.when(when, F.col("length"))), F.lit(0.0))
    return walk.groupBy("request").agg(F.sum("cost").alias("cost"), F.sum("seconds").alias("seconds"), F.sum("length").alias("length"), metres(F.col("surface").isin(*STONES)).alias("setts_m"), F.max(F.abs("slope")).alias("worst"), metres(F.col("unknown")).alias("unknown_m"))


def longest_gap(walk: DataFrame, stops: DataFrame) -> DataFrame:
    """(request, gap): the longest way between stops, or between a stop and an end. stops: (edge, src, offset), metres from src along the edge."""
    w = Window.partitionBy("request").orderBy("seq")
    at = F.coalesce(F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rows = walk.withColumn("at_m", at)
    places = rows.join(stops, ["edge", "src"]).select("request", (F.col("at_m") + F.col("offset")).alias("at_m"))
    ends = rows.groupBy("request").agg(F.sum("length").alias("long")).select("request", F.explode(F.array(F.lit(0.0), F.col("long"))).alias("at_m"))
    gap = F.col("at_m") - F.lag("at_m").over(Window.partitionBy("request").orderBy("at_m"))
    return places.unionByName(ends).withColumn("gap", gap).groupBy("request").agg(C.js_round(F.coalesce(F.max("gap"), F.lit(0.0))).cast("double").alias("gap"))


def ladder(interval: Column, gap: Column) -> Column:
    """The gaps to ask for: the loosest one worth offering and the next, all clearly shorter than the route's."""
    rungs = [C.js_round(interval * f) for f in BENCH_RUNGS] + [C.js_round(gap * f) for f in GAP_SHARES]
    fair = F.filter(F.array_distinct(F.array(*[r.cast("double") for r in rungs])), lambda g: g < gap * CLEARLY)
    return F.slice(F.sort_array(fair, asc=False), 1, TRIES)


def hardened(people: DataFrame) -> DataFrame:
    """(profile, p): people (profile, base, p, id, cap) with the soft cost of `id` made a limit."""
    p, cap = F.col("p"), F.col("cap")
    bare = p.withField("surfaces", F.transform_values(p["surfaces"], lambda k, v: F.when(~k.isin(*STONES), v)))
    flat = p.withField("max_up", F.least(p["max_up"], cap)).withField("max_down", F.least(p["max_down"], cap))
    sure = p.withField("tolerance", F.lit(0.0))
    return people.select("profile", F.when(F.col("id") == "smoother", bare).when(F.col("id") == "gentler", flat).when(F.col("id") == "more-certain", sure).otherwise(p).alias("p"))


def tradeoffs(arcs_for: Arcs, people: DataFrame, requests: DataFrame, benches: DataFrame, toilets: DataFrame, miles: bool = False) -> DataFrame:
    """(request, id, found, added_min, gap_m, unknown_m, message): for each soft cost on a request's least-cost route, what it takes to do without.

    smoother: no setts, if there are more than 20 m of them. gentler: nothing steeper than the comfortable slope, or than one per cent less than the
    steepest now. more-benches, more-toilets: a stop at least every so often, by a ladder of gaps, with benches given up at twice the cost or
    15 minutes more. more-certain: unknown stretches cost in full; told only if it saves 20 m of them.

    arcs_for(people) gives the arcs (profile, src, dst, edge, cost, length, seconds, surface, slope, unknown, bench, toilet, ride) of people (profile, p); requests: (request,
    profile, origin, destination). Every kind and rung is a copy of the request with a profile or limit of its own, and all copies of a kind are searched at
    once; copies that differ only in the request share a profile. A request without a route has no rows.
    """
    arcs = written(arcs_for(people), "arcs")
    chosen = written(walked(routing.routes(arcs, requests), requests, arcs), "chosen")
    gap_now = longest_gap(chosen, benches).withColumnRenamed("gap", "bench_gap").join(longest_gap(chosen, toilets).withColumnRenamed("gap", "toilet_gap"), "request")
    now = requests.join(sums(chosen), "request").join(gap_now, "request").join(people, "profile")
    now = written(now, "now")
    p, worst = F.col("p"), F.col("worst")
    cap = F.greatest(p["comfort"], F.floor(worst) - 1)
    none = F.lit(None).cast("double")
    ask = lambda when, name, cap: F.when(when, F.struct(F.lit(name).alias("id"), cap.cast("double").alias("cap")))
    wishes = F.array(ask(F.col("setts_m") > SETTS_M, "smoother", none), ask(worst > p["comfort"], "gentler", cap), ask(F.col("unknown_m") > 0, "more-certain", none))
    changed = now.select("request", "origin", "destination", F.col("profile").alias("base"), "p", F.explode(F.filter(wishes, lambda x: x.isNotNull())).alias("w")).select("*", "w.*")
    changed = written(changed.withColumn("profile", F.concat_ws("|", "base", "id", F.col("cap").cast("string"))).withColumn("copy", F.concat_ws("|", F.col("request").cast("string"), "id")), "changed")
    variants = hardened(changed.select("profile", "base", "p", "id", "cap").dropDuplicates(["profile"]))
    copies = changed.select(F.col("copy").alias("request"), "profile", "origin", "destination")
    variant_arcs = written(arcs_for(variants), "variant-arcs")
    plain = sums(walked(routing.routes(variant_arcs, copies), copies, variant_arcs)).select(F.col("request").alias("copy"), "seconds", "unknown_m")
    old = now.select("request", F.col("seconds").alias("old_s"), F.col("unknown_m").alias("old_unknown_m"))
    added = F.greatest(F.lit(0), C.js_round((F.col("seconds") - F.col("old_s")) / 60).cast("long"))
    plain = changed.join(plain, "copy", "left").join(old, "request").withColumn("added_min", added).withColumn("found", F.col("seconds").isNotNull())
    less = F.col("found") & (F.col("unknown_m") < F.col("old_unknown_m") - FEWER_M)
    plain = plain.where((F.col("id") != "more-certain") | less)
    text = lambda x: length_text(x, F.lit(miles))
    plus = F.concat(F.lit(" Adds "), F.col("added_min").cast("string"), F.lit(" min."))
    percent = F.concat(F.regexp_replace(F.col("cap").cast("string"), r"\\.0$", ""), F.lit("%."))
    message = (
        F.when(F.col("id") == "smoother", F.when(F.col("found"), F.concat(F.lit("Avoids setts."), plus)).otherwise("Every way there that fits your settings has setts."))
        .when(F.col("id") == "gentler", F.when(F.col("found"), F.concat(F.lit("Nothing steeper than "), percent, plus)).otherwise(F.concat(F.lit("No way there stays under "), percent)))
        .otherwise(F.concat(text(F.col("unknown_m")), F.lit(" unknown instead of "), text(F.col("old_unknown_m")), F.lit("."), plus))
    )
    plain = plain.select("request", "id", "found", F.when(F.col("found"), F.col("added_min")).alias("added_min"), none.alias("gap_m"), F.when(F.col("id") == "more-certain", F.col("unknown_m")).alias("unknown_m"), message.alias("message"))
    rested = [
        _rested(arcs, now, benches, "more-benches", "bench", p["rest_m"], F.col("bench_gap"), ladder(p["rest_m"], F.col("bench_gap")), F.greatest(F.col("cost") * DEARER, F.col("cost") + ALLOWANCE), text),
        _rested(arcs, now, toilets, "more-toilets", "toilet", p["toilet_m"], F.col("toilet_gap"), F.array(*[p["toilet_m"] * f for f in TOILET_RUNGS]), none, text),
    ]
    out = plain
    for r in rested:
        out = out.unionByName(r)
    return written(out, "tradeoffs")


def _rested(arcs: DataFrame, now: DataFrame, stops: DataFrame, name: str, flag: str, interval: Column, gap: Column, rungs: Column, most: Column, text: Callable[[Column], Column]) -> DataFrame:
    """Rows of tradeoffs for one kind of stop. Of benches the rung with the shortest gap counts if the looser ones were found too; of toilets the first rung found."""
    wish = now.where((interval > 0) & (gap > interval)).select("request", "profile", "origin", "destination", "seconds", interval.alias("interval"), gap.alias("old_gap"), F.posexplode(rungs).alias("rung", "longest"), most.alias("most"))
    wish = written(wish.withColumn("copy", F.concat_ws("|", F.col("request").cast("string"), "rung")), name)
    copies = wish.select(F.col("copy").alias("request"), "profile", "origin", "destination", "longest", "most")
    _, steps = routing.gap_routes(arcs.withColumn("stop", F.col(flag)), copies)
    walk = written(walked(steps, copies, arcs), f"{name}-walk")
    got = sums(walk).select(F.col("request").alias("copy"), F.col("seconds").alias("new_s")).join(longest_gap(walk, stops).select(F.col("request").alias("copy"), "gap"), "copy")
    tried = wish.join(got, "copy", "left").withColumn("ok", F.col("gap") < F.col("old_gap") * CLEARLY)
    if flag == "bench":
        # a rung after one that was not found is not tried
        before = F.min(F.col("gap").isNotNull().cast("int")).over(Window.partitionBy("request").orderBy("rung").rowsBetween(Window.unboundedPreceding, 0))
        tried = tried.withColumn("ok", F.col("ok") & (before == 1))
        order = F.struct("gap", "rung")
    else:
        first = F.min(F.when(F.col("gap").isNotNull(), F.col("rung"))).over(Window.partitionBy("request"))
        tried = tried.withColumn("ok", F.col("ok") & (F.col("rung") == first))
        order = F.struct("rung")
    best = tried.groupBy("request").agg(F.first("interval").alias("interval"), F.first("old_gap").alias("old_gap"), F.first("seconds").alias("old_s"), F.min_by(F.struct("new_s", "gap"), F.when(F.col("ok"), order)).alias("b"))
    added = F.greatest(F.lit(0), C.js_round((F.col("b.new_s") - F.col("old_s")) / 60).cast("long"))
    plus = F.concat(F.lit(" Adds "), added.cast("string"), F.lit(" min."))
    bench = flag == "bench"
    nothing = "No way there has mapped benches closer together than this. Not every bench is mapped." if bench else "No way there passes mapped accessible toilets closer together than this. Not every toilet is mapped."
    every = F.concat(F.lit("A mapped bench at least every " if bench else "An accessible toilet at least every "), text(F.col("interval")), F.lit("."), plus)
    shorter = F.concat(F.lit("Longest stretch without a bench " if bench else "Longest stretch without one "), text(F.col("b.gap")), F.lit(" instead of "), text(F.col("old_gap")), F.lit("."), plus)
    message = F.when(F.col("b").isNull(), nothing).when(F.col("b.gap") <= F.col("interval"), every).otherwise(shorter)
    return best.select("request", F.lit(name).alias("id"), F.col("b").isNotNull().alias("found"), F.when(F.col("b").isNotNull(), added).alias("added_min"), F.col("b.gap").alias("gap_m"), F.lit(None).cast("double").alias("unknown_m"), message.alias("message"))


#: What a person may stretch for one journey, in the order of attributes of a changed profile.
STRETCHABLE = ("steps", "escalator", "incline", "kerb", "surface", "width")


def loosened(p: Column, limit: Column) -> Column:
    """A profile with one or all of the limits of `limit` (steps, escalator, up, down, kerb_cm, surfaces, width) stretched; null ones stay."""
    any_surface = F.transform_values(p["surfaces"], lambda k, v: F.when(F.coalesce(F.array_contains(limit["surfaces"], k), F.lit(False)), F.lit(1.0)).otherwise(v))
    wider = lambda field, new: F.greatest(p[field], F.coalesce(new, p[field]))
    return (
        p.withField("max_steps", F.coalesce(limit["steps"], p["max_steps"])).withField("escalators", p["escalators"] | F.coalesce(limit["escalator"], F.lit(False))).withField("max_up", wider("max_up", limit["up"]))
        .withField("max_down", wider("max_down", limit["down"])).withField("kerb_cm", wider("kerb_cm", limit["kerb_cm"])).withField("surfaces", any_surface).withField("min_width", F.least(p["min_width"], F.coalesce(limit["width"], p["min_width"])))
    )


def diagnose(arcs_for: Arcs, people: DataFrame, requests: DataFrame, free: DataFrame, judged: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For requests without a route: (request, closest, left_m) and (request, what, cost).

    free: the steps (request, seq, edge, src, dst) of a person without limits. judged: what stops the request's own person on those steps: (request, seq, attr, steps, slope, kerb_cm,
    surface, width); slope as walked. closest: the last node of the free route that the person reaches, if it is at least 10 m from the destination. what: the smallest change of limits for this journey that
    finds a way: each limit by itself in the order met, then all together; none if something stops them that is not theirs to stretch. nodes: (node, lon, lat).
    """
    arcs = written(arcs_for(people), "arcs")
    reached = routing.passable_reach(arcs, requests)
    last = free.join(reached.select("request", F.col("node").alias("dst")), ["request", "dst"], "left_semi").groupBy("request").agg(F.max("seq").alias("last"), F.max_by("dst", "seq").alias("node"))
    place = lambda side: nodes.select(F.col("node").alias(side), F.col("lon").alias(f"{side}_lon"), F.col("lat").alias(f"{side}_lat"))
    left = C.haversine_m(F.col("node_lon"), F.col("node_lat"), F.col("destination_lon"), F.col("destination_lat"))
    closest = last.join(requests.select("request", "origin", "destination"), "request").where("node <> origin").join(place("node"), "node").join(place("destination"), "destination").withColumn("left_m", C.js_round(left))
    closest = closest.where(left >= 10).select("request", F.col("node").alias("closest"), "left_m")

    past = judged.join(last.select("request", "last"), "request", "left").where(F.col("seq") > F.coalesce("last", F.lit(0)))
    attr = F.col("attr")
    up = lambda when: F.max(F.when((attr == "incline") & when, F.ceil(F.abs("slope")).cast("double")))
    limits = past.groupBy("request").agg(
        F.min(attr.isin(*STRETCHABLE).cast("int")).alias("theirs"), F.max(F.when(attr == "steps", F.coalesce("steps", F.lit(float("inf"))))).alias("steps"), F.max(F.when(attr == "escalator", F.lit(True))).alias("escalator"), up(F.col("slope") >= 0).alias("up"), up(F.col("slope") < 0).alias("down"),
        F.max(F.when(attr == "kerb", F.coalesce(F.ceil("kerb_cm").cast("double"), F.lit(13.0)))).alias("kerb_cm"), F.array_sort(F.collect_set(F.when(attr == "surface", F.col("surface")))).alias("surfaces"), F.min(F.when(attr == "width", F.floor(F.col("width") * 10) / 10)).alias("width"),
    ).where("theirs = 1")
    limits = limits.select("request", F.struct("steps", "escalator", "up", "down", "kerb_cm", "surfaces", "width").alias("limit"))
    none = F.lit(None)
    single = F.when(attr == "incline", F.struct(none.cast("double").alias("steps"), none.cast("boolean").alias("escalator"), F.col("limit.up").alias("up"), F.col("limit.down").alias("down"), none.cast("double").alias("kerb_cm"), none.cast("array<string>").alias("surfaces"), none.cast("double").alias("width"))).otherwise(
        F.struct(
            F.when(attr == "steps", F.col("limit.steps")).alias("steps"), F.when(attr == "escalator", F.col("limit.escalator")).alias("escalator"), none.cast("double").alias("up"), none.cast("double").alias("down"),
            F.when(attr == "kerb", F.col("limit.kerb_cm")).alias("kerb_cm"), F.when(attr == "surface", F.col("limit.surfaces")).alias("surfaces"), F.when(attr == "width", F.col("limit.width")).alias("width"),
        )
    )
    said = F.when(attr == "surface", F.col("surface")).otherwise(attr)
    met = past.withColumn("said", said).groupBy("request", "attr", "said").agg(F.min("seq").alias("seq")).join(limits, "request")
    one = met.groupBy("request", "attr").agg(F.min("seq").alias("seq"), F.array_sort(F.collect_list(F.struct("seq", "said"))).alias("words"), F.first("limit").alias("limit")).select("request", "seq", single.alias("limit"), F.transform("words", lambda x: x["said"]).alias("what"))
    every = met.groupBy("request").agg(F.countDistinct("attr").alias("kinds"), F.array_sort(F.collect_list(F.struct("seq", "said"))).alias("words"), F.first("limit").alias("limit")).where("kinds > 1").select("request", F.lit((1 << 31) - 1).alias("seq"), "limit", F.transform("words", lambda x: x["said"]).alias("what"))
    tries = one.unionByName(every).join(requests, "request").join(people, "profile").withColumn("base", F.col("profile"))
    tries = written(tries.withColumn("profile", F.concat_ws("|", "base", F.to_json("limit"))).withColumn("copy", F.concat_ws("|", F.col("request").cast("string"), F.col("seq").cast("string"))), "tries")
    variants = tries.dropDuplicates(["profile"]).select("profile", loosened(F.col("p"), F.col("limit")).alias("p"))
    copies = tries.select(F.col("copy").alias("request"), "profile", "origin", "destination")
    found = routing.search(arcs_for(variants), copies).where("node = destination").select(F.col("request").alias("copy"), "cost")
    best = tries.join(found, "copy").groupBy("request").agg(F.min_by(F.struct("what", "cost"), "seq").alias("b")).select("request", F.array_join("b.what", ", ").alias("what"), "b.cost")
    return written(closest, "closest"), written(best, "relax")
