"""Map data into a walking graph: what tags say, where ways are cut, names and bridges borrowed, islands joined.

Ways are (id, nodes, tags, timestamp), nodes (id, lon, lat, tags). Every rule is a column over the tag map.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from . import graph, relational

# Words of map tags and what they mean.
ROADS = ("trunk", "primary", "secondary", "tertiary", "unclassified", "residential", "service", "living_street")
NO_ACCESS, ALLOWED = ("no", "private"), ("yes", "designated", "permissive")
SURFACES = {
    "asphalt": "asphalt", "concrete": "concrete", "concrete:plates": "concrete", "concrete:lanes": "concrete", "paved": "paving_stones", "paving_stones": "paving_stones", "paving_stones:30": "paving_stones",
    "sett": "sett", "unhewn_cobblestone": "cobblestone", "cobblestone": "cobblestone", "cobblestone:flattened": "sett", "compacted": "compacted", "fine_gravel": "fine_gravel", "gravel": "gravel", "pebblestone": "gravel", "unpaved": "gravel",
    "dirt": "grass", "ground": "grass", "earth": "grass", "grass": "grass", "wood": "wood", "metal": "metal", "rubber": "asphalt", "tartan": "asphalt", "bricks": "paving_stones", "brick": "paving_stones", "stone": "paving_stones",
}
DOORS = ("hinged", "sliding", "revolving", "swinging", "folding", "overhead", "no")
POWERED = ("yes", "no", "button", "motion", "floor", "continuous", "slowdown_button")
CONTROLLED = ("zebra", "pelican", "puffin", "toucan", "pegasus", "equestrian", "tiger")
SIGNALS = ("pelican", "puffin", "toucan", "pegasus")
#: An island of at most so many nodes is joined over a gap of at most so many metres, unless heights differ by more than 2.
MOST_NODES, LONGEST_GAP_M, MOST_RISE_M = 500, 15.0, 2.0
#: A name is borrowed from a street nearer than this.
NAME_M = 20.0


def tag(name: str, tags: str = "tags") -> Column:
    return F.col(tags)[name]


def _is(name: str, *values: str, tags: str = "tags") -> Column:
    return F.coalesce(tag(name, tags).isin(*values), F.lit(False))


def classify(tags: str = "tags") -> Column:
    """The kind of edge a way makes for someone on foot or wheels, null if none."""
    foot, highway = _is("foot", *ALLOWED, tags=tags), tag("highway", tags)
    shut = _is("foot", *NO_ACCESS, tags=tags) | (_is("access", *NO_ACCESS, tags=tags) & ~foot)
    platform = _is("railway", "platform", tags=tags) | _is("public_transport", "platform", tags=tags)
    footway = F.when(_is("footway", "sidewalk", tags=tags), "sidewalk").when(_is("footway", "crossing", tags=tags), "crossing").when((tag("conveying", tags) != "") & (tag("conveying", tags) != "no"), "escalator").when(_is("ramp", "yes", tags=tags), "ramp").otherwise("footway")
    separate = _is("sidewalk", "separate", tags=tags)
    for side in ("both", "left", "right"):
        separate = separate | _is(f"sidewalk:{side}", "separate", tags=tags)
    fast = _is("sidewalk", "no", "none", tags=tags) & highway.isin("trunk", "primary", "secondary")
    cycle = (highway == "path") | foot | ((highway == "cycleway") & tag("foot", tags).isNull()) | (highway == "track")
    return (
        F.when(shut, None).when(platform, F.when(highway == "steps", "steps").otherwise("footway")).when(highway.isin("steps", "elevator", "corridor", "pedestrian"), highway).when(highway == "footway", footway)
        .when(highway.isin("path", "cycleway", "bridleway", "track"), F.when(cycle, "footway")).when(highway == "living_street", "pedestrian").when(highway.isin(*ROADS) & ~separate & ~fast, "street_proxy")
    )


def yes_no(value: Column) -> Column:
    return F.when(value.isin("yes", "true", "1"), True).when(value.isin("no", "false", "0"), False)


def surface(value: Column) -> Column:
    """One of the eleven surfaces for a word of the map; other for any word that is none of them."""
    return F.when(value != "", F.coalesce(C._lookup(SURFACES, value), F.lit("other")))


def told(value: Column, method: str | Column, at: Column, state: str = "reported", source: str = "osm") -> Column:
    """An attribute with where it is from; unknown if there is no value."""
    have = value.isNotNull()
    said = method if isinstance(method, Column) else F.lit(method)
    return F.struct(value.alias("value"), F.when(have, state).otherwise("unknown").alias("state"), F.when(have, source).otherwise("none").alias("source"), F.when(have, at).alias("observed_at"), F.when(have, said).alias("method"))


def edge_attributes(kind: Column, at: Column) -> dict[str, Column]:
    """The attributes of an edge by name. A road that stands for its pavements gives no surface or width of its own as reported: what its
    sidewalk tags say is, and its carriageway's surface is only inferred."""
    slope, proxy = told(C.incline_percent(tag("incline")), "OSM incline tag", at), kind == "street_proxy"
    side_given = lambda side: (tag(f"sidewalk:{side}") != "") & (tag(f"sidewalk:{side}") != "no")
    walk = F.coalesce(tag("sidewalk"), tag("sidewalk:both"), F.when(side_given("left"), "left").when(side_given("right"), "right"))
    pavement = F.when(walk.isin("both", "yes"), "both").when(walk.isin("left", "right"), walk).when(walk.isin("no", "none"), "no")
    side = F.when(pavement.isin("left", "right"), pavement).otherwise("both")

    def pick(key: str) -> Column:
        own = F.when(side == "left", tag(f"sidewalk:left:{key}")).when(side == "right", tag(f"sidewalk:right:{key}")).otherwise(tag(f"sidewalk:both:{key}"))
        return F.coalesce(own, tag(f"sidewalk:{key}"), F.when(side == "both", F.coalesce(tag(f"sidewalk:left:{key}"), tag(f"sidewalk:right:{key}"))))

    steps = tag("step_count").try_cast("double")
    wheelchair = F.when(tag("wheelchair").isin("yes", "limited", "no"), tag("wheelchair"))
    beside = told(surface(pick("surface")), F.concat(F.lit("OSM sidewalk:"), side, F.lit(":surface")), at)
    road = told(surface(tag("surface")), "carriageway surface (OSM surface); the pavement may differ", at, "inferred")
    rail = F.coalesce(yes_no(tag("handrail")), F.when(_is("handrail:left", "yes") | _is("handrail:right", "yes") | _is("handrail:center", "yes"), True))
    covered = F.coalesce(yes_no(tag("covered")), F.when(~proxy & (_is("indoor", "yes") | _is("tunnel", "building_passage")), True))
    never = told(F.lit(0.0), "not steps", F.lit(None).cast("string"), "inferred", "derived")
    return {
        "incline": slope, "incline_max": slope, "cross_slope": told(F.lit(None).cast("double"), "", at),
        "surface": F.when(proxy, F.when(pick("surface") != "", beside).otherwise(road)).otherwise(told(surface(tag("surface")), "OSM surface tag", at)),
        "smoothness": told(F.when(tag("smoothness").isin("excellent", "good", "intermediate", "bad", "very_bad", "horrible"), tag("smoothness")), "OSM smoothness tag", at),
        "width": F.when(proxy, told(C.metres(pick("width")), F.concat(F.lit("OSM sidewalk:"), side, F.lit(":width")), at)).otherwise(told(C.metres(F.coalesce(tag("width"), tag("est_width"))), "OSM width tag", at)),
        "step_count": F.when(kind == "steps", told(steps, "OSM step_count", at)).otherwise(never), "handrail": told(rail, "OSM handrail tag", at), "lit": told(yes_no(tag("lit")), "OSM lit tag", at),
        "covered": told(covered, "OSM covered/indoor", at), "wheelchair": told(wheelchair, "OSM wheelchair tag", at), "pavement": told(F.when(proxy, pavement), "OSM sidewalk tag", at),
    }


def kerb(at: Column, tags: str = "tags") -> Column:
    """A node's kerb (type, height_cm, tactile), null if its tags speak of none. kerb=no is flush, and flush is 0 high."""
    k = tag("kerb", tags)
    there = _is("barrier", "kerb", tags=tags) | k.isNotNull() | tag("kerb:height", tags).isNotNull()
    kind = F.when(k.isin("raised", "lowered", "flush", "rolled"), k).when(k == "no", "flush")
    height = F.coalesce(C.kerb_height_cm(tag("kerb:height", tags)), F.when(kind == "flush", 0.0))
    return F.when(there, F.struct(told(kind, "OSM kerb tag", at).alias("type"), told(height, "OSM kerb:height tag", at).alias("height_cm"), told(yes_no(tag("tactile_paving", tags)), "OSM tactile_paving tag", at).alias("tactile")))


def entrance(at: Column, tags: str = "tags") -> Column:
    """A node's entrance (entrance, door, automatic, width_m, step_count, wheelchair, ramp), null if there is none."""
    subway = _is("railway", "subway_entrance", tags=tags)
    there = (tag("entrance", tags) != "") | (tag("door", tags) != "") | (tag("automatic_door", tags) != "") | subway
    door, powered, wc = tag("door", tags), tag("automatic_door", tags), tag("wheelchair", tags)
    return F.when(F.coalesce(there, F.lit(False)) | subway, F.struct(
        told(F.coalesce(tag("entrance", tags), F.when(subway, "subway")), "OSM entrance tag", at).alias("entrance"), told(F.when(door.isin(*DOORS), door).when(door != "", "other"), "OSM door tag", at).alias("door"),
        told(F.when(powered.isin(*POWERED), powered), "OSM automatic_door tag", at).alias("automatic"), told(C.metres(F.coalesce(tag("door:width", tags), tag("width", tags))), "OSM door:width tag", at).alias("width_m"),
        told(tag("step_count", tags).try_cast("double"), "OSM step_count tag", at).alias("step_count"), told(F.when(wc.isin("yes", "limited", "no"), wc), "OSM wheelchair tag", at).alias("wheelchair"),
        told(F.coalesce(yes_no(tag("ramp", tags)), yes_no(tag("ramp:wheelchair", tags))), "OSM ramp tag", at).alias("ramp"),
    ))


def amenity(tags: str = "tags") -> Column:
    """bench, toilets, changing_places or null."""
    bench = _is("amenity", "bench", tags=tags) | _is("leisure", "picnic_table", tags=tags)
    return F.when(bench, "bench").when(_is("amenity", "toilets", tags=tags), F.when(_is("changing_places", "yes", tags=tags), "changing_places").otherwise("toilets"))


def crossing(at: Column, tags: str = "tags") -> Column:
    """A crossing's control and cues, null for nodes that are none. Lights with no sound tag aren't taken for silent or audible."""
    c, ref = tag("crossing", tags), "crossing_ref"
    control = F.when(_is("crossing", "traffic_signals", tags=tags) | _is(ref, *SIGNALS, tags=tags), "signals").when(_is("crossing", "zebra", tags=tags) | _is(ref, "zebra", tags=tags) | _is("crossing:markings", "zebra", tags=tags), "zebra").when(c.isin("uncontrolled", "marked"), "marked").when(c.isin("unmarked", "no"), "uncontrolled")
    cue = lambda name: told(F.when(tag(name, tags) == "yes", True).when(tag(name, tags) == "no", False), f"OSM {name} tag", at)
    parts = (("sound", "traffic_signals:sound"), ("vibration", "traffic_signals:vibration"), ("tactile", "tactile_paving"), ("island", "crossing:island"))
    return F.when(_is("highway", "crossing", tags=tags) | _is("railway", "crossing", tags=tags), F.struct(told(control, "OSM crossing tag", at).alias("control"), *[cue(name).alias(field) for field, name in parts]))


def shared_with_cycles(at: Column, tags: str = "tags") -> Column:
    """Whether a path is shared with cycles; null where cycles don't go; inferred where nothing says how."""
    bikes = _is("bicycle", "designated", "yes", tags=tags) | _is("highway", "cycleway", tags=tags)
    apart = tag("segregated", tags)
    return F.when(bikes, F.when(apart == "yes", told(F.lit(False), "OSM segregated=yes", at)).when(apart == "no", told(F.lit(True), "OSM segregated=no", at)).otherwise(told(F.lit(True), "cycles allowed, segregation not mapped", at, "inferred", "derived")))


def level(tags: str = "tags") -> Column:
    return F.coalesce(F.split(tag("level", tags), ";")[0].try_cast("double"), F.lit(0.0))


def meaningful(tags: str = "tags") -> Column:
    """Nodes at which a way is cut even if no other way meets it."""
    set_ = lambda name: F.coalesce(tag(name, tags) != "", F.lit(False))
    return set_("barrier") | set_("kerb") | _is("highway", "crossing", "elevator", tags=tags) | set_("entrance") | _is("railway", "subway_entrance", tags=tags)


def cut(visits: DataFrame) -> DataFrame:
    """Ways cut into segments: (way, seg, nodes) from visits (way, pos, node, meaningful), nodes being (pos, node) in order.

    A way is cut at its last node, where two ways or more meet and at meaningful nodes; a node of a cut belongs to both segments.
    A way that comes back to a node visits it once. Segments of one node twice and nothing between are dropped, and ways of one node.
    """
    uses = visits.select("way", "node").distinct().groupBy("node").agg(F.count("*").alias("uses"))
    w = Window.partitionBy("way").orderBy("pos")
    rows = visits.join(uses, "node").withColumn("n", F.row_number().over(w)).withColumn("last", F.lead("pos").over(w).isNull())
    inner = (F.col("n") > 1) & ~F.col("last") & ((F.col("uses") >= 2) | F.col("meaningful"))
    rows = rows.withColumn("cut", inner).withColumn("seg", F.coalesce(F.sum(F.when(inner, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int"))
    each = rows.select("way", F.explode(F.when(F.col("cut"), F.array("seg", F.col("seg") + 1)).otherwise(F.array("seg"))).alias("seg"), "pos", "node")
    out = each.groupBy("way", "seg").agg(F.sort_array(F.collect_list(F.struct("pos", "node"))).alias("nodes")).where(F.size("nodes") > 1)
    ends = lambda i: F.element_at("nodes", i)["node"]
    return out.where((ends(1) != ends(-1)) | (F.size("nodes") > 2))


def build(ways: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes) of the walking graph.

    Edges: way, seg, key (way:from:to), src, dst, kind, line, length_m, name, level, layer, bridge, movable, bidirectional, the attributes,
    shared. Nodes, those that edges end at: id, lon, lat, level, kind, kerb, entrance, crossing. A crossing way's kerb is handed to its
    ends that have none; where it has none either, controlled or tactile crossings get an inferred lowered one.
    """
    at = F.col("timestamp")
    walk = ways.withColumn("kind", classify()).where("kind is not null")
    points = nodes.select(F.col("id").alias("node"), "lon", "lat", meaningful().alias("meaningful"))
    visits = walk.select(F.col("id").alias("way"), F.posexplode("nodes").alias("pos", "node")).join(points, "node")
    segments = cut(visits.select("way", "pos", "node", "meaningful"))
    placed = segments.select("way", "seg", F.inline("nodes")).join(points, "node")
    lines = placed.groupBy("way", "seg").agg(F.sort_array(F.collect_list(F.struct("pos", "lon", "lat", "node"))).alias("l"))
    one_way = (F.col("kind") == "escalator") | _is("oneway:foot", "yes") | (~F.col("kind").isin("street_proxy", "steps") & _is("oneway", "yes"))
    bridge = F.coalesce((tag("bridge") != "") & (tag("bridge") != "no"), F.lit(False))
    edges = lines.join(walk.withColumnRenamed("id", "way"), "way").select(
        "way", "seg", F.element_at("l", 1)["node"].alias("src"), F.element_at("l", -1)["node"].alias("dst"), "kind", F.transform("l", lambda p: F.struct(p["lon"], p["lat"])).alias("line"), tag("name").alias("name"), level().alias("level"),
        F.coalesce(tag("layer").try_cast("double"), F.lit(0.0)).alias("layer"), bridge.alias("bridge"), F.coalesce(tag("bridge:movable"), F.when(_is("bridge", "movable"), "movable")).alias("movable"), (~one_way).alias("bidirectional"),
        *[v.alias(k) for k, v in edge_attributes(F.col("kind"), at).items()], F.when(F.col("kind").isin("footway", "pedestrian", "sidewalk", "ramp"), shared_with_cycles(at)).alias("shared"),
    )
    edges = edges.withColumn("length_m", C.line_length_m(F.col("line"))).withColumn("key", F.concat_ws(":", "way", "src", "dst"))
    used = edges.select(F.explode(F.array("src", "dst")).alias("id"), "level").groupBy("id").agg(F.min("level").alias("level"))
    own = nodes.join(used, "id").select("id", "lon", "lat", "level", kerb(at).alias("own_kerb"), entrance(at).alias("entrance"), crossing(at).alias("crossing"), (F.coalesce(tag("highway"), F.lit(""))).alias("hw"), (_is("railway", "subway_entrance") | (F.coalesce(tag("entrance"), F.lit("")) != "")).alias("door"))
    handed = _handed_kerbs(walk.where("kind = 'crossing'"), nodes)
    known = F.col("own_kerb").isNotNull() & (F.col("own_kerb.type.state") != "unknown")
    out = own.join(handed, "id", "left").withColumn("kerb", F.when(known, F.col("own_kerb")).when(F.col("own_kerb").isNotNull() & F.col("given"), F.col("own_kerb")).otherwise(F.coalesce("handed", "own_kerb")))
    kind = F.when(F.col("hw") == "elevator", "elevator").when(F.col("own_kerb").isNotNull(), "kerb").when(F.col("hw") == "crossing", "crossing").when(F.col("door"), "entrance").when(F.col("handed").isNotNull() & ~F.col("given"), "kerb").otherwise("junction")
    return edges, out.select("id", "lon", "lat", "level", kind.alias("kind"), "kerb", "entrance", "crossing")


def _handed_kerbs(crossings: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, handed, given): the kerb that crossing ways hand to their end nodes; given ones before inferred ones, then the least way."""
    at = F.col("timestamp")
    tagged = nodes.select(F.col("id").alias("node"), F.col("tags").alias("node_tags"))
    visits = crossings.select(F.col("id").alias("way"), F.explode("nodes").alias("node")).join(tagged, "node")
    sure = lambda t: _is("crossing", "traffic_signals", "zebra", tags=t) | (_is("crossing", "marked", tags=t) & _is("crossing:markings", "zebra", tags=t)) | _is("crossing:signals", "yes", tags=t) | _is("crossing_ref", *CONTROLLED, tags=t)
    seen = visits.groupBy("way").agg(F.max(sure("node_tags")).alias("controlled"), F.max(_is("tactile_paving", "yes", tags="node_tags")).alias("tactile"))
    rows = crossings.join(seen, F.col("id") == F.col("way"), "left")
    controlled, tactile = F.coalesce("controlled", F.lit(False)) | sure("tags"), F.coalesce("tactile", F.lit(False)) | _is("tactile_paving", "yes")
    why = F.when(controlled, "UK controlled crossing: dropped kerb required").otherwise("tactile paving tagged at crossing: implies dropped kerb")
    guess = F.struct(told(F.lit("lowered"), why, at, "inferred", "derived").alias("type"), told(F.lit(None).cast("double"), "", at).alias("height_cm"), F.when(tactile, told(F.lit(True), "OSM tactile_paving tag", at)).otherwise(told(F.lit(True), why, at, "inferred", "derived")).alias("tactile"))
    given = kerb(at)
    said = given.isNotNull() & (given["type"]["state"] != "unknown")
    rows = rows.withColumn("handed", F.when(said, given).when(controlled | tactile, guess)).withColumn("given", said).where("handed is not null")
    ends = rows.select(F.explode(F.array(F.element_at("nodes", 1), F.element_at("nodes", -1))).alias("id"), "handed", "given", F.col("way").alias("of"))
    return ends.groupBy("id").agg(F.min_by(F.struct("handed", "given"), F.struct(~F.col("given"), "of")).alias("v")).select("id", "v.*")


def split_lifts(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes) with every lift node whose edges lie on several levels made one node a level, number -(id * 10 + place of the level),
    with a lift edge between each two of them. Edges need key, src, dst, kind, level; other columns of new edges are null."""
    lifts = nodes.where("kind = 'elevator'").select("id")
    at = edges.select(F.explode(F.array("src", "dst")).alias("id"), "level").distinct().join(lifts, "id")
    many = at.groupBy("id").agg(F.sort_array(F.collect_list("level")).alias("levels")).where(F.size("levels") > 1)
    new_id = lambda node, lvl, levels: -(node * 10 + F.array_position(levels, lvl))
    out = edges
    for side in ("src", "dst"):
        found = many.select(F.col("id").alias(side), F.col("levels").alias(f"__{side}"))
        out = out.join(found, side, "left").withColumn(side, F.when(F.col(f"__{side}").isNotNull(), new_id(F.col(side), F.col("level"), F.col(f"__{side}"))).otherwise(F.col(side))).drop(f"__{side}")
    two = many.select("id", "levels", F.explode("levels").alias("low")).select("id", "levels", "low", F.explode("levels").alias("high")).where("low < high")
    lift = two.select(new_id(F.col("id"), F.col("low"), F.col("levels")).alias("src"), new_id(F.col("id"), F.col("high"), F.col("levels")).alias("dst"), F.lit("elevator").alias("kind"), F.col("low").alias("level"), F.concat_ws(":", F.lit("lift"), "id", "low", "high").alias("key"))
    copies = nodes.join(many, "id").withColumn("level", F.explode("levels")).withColumn("id", new_id(F.col("id"), F.col("level"), F.col("levels"))).select(*nodes.columns)
    return out.select(*edges.columns).unionByName(lift, allowMissingColumns=True), nodes.join(many, "id", "left_anti").unionByName(copies)


def off_ground(kind: Column, bridge: Column, layer: Column, level_: Column, covered: Column) -> Column:
    """Edges whose surface isn't the bare earth."""
    return bridge | (layer != 0) | (level_ != 0) | kind.isin("elevator", "escalator", "corridor") | F.coalesce(covered, F.lit(False))


def bridge_islands(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """New edges (src, dst, kind, length_m, ref) that join small parts of the network to the main one: the closest pair of street-level
    nodes within 15 m, 5 m closer if the island's is a crossing. Platforms stay islands, and so do nodes at bridges or of other heights.
    nodes: id, lon, lat, level, kind, ele (null if unknown); edges: src, dst, name, bridge, layer."""
    comps = graph.components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))).withColumnRenamed("node", "id")
    sizes = comps.groupBy("component").agg(F.count("*").alias("n"))
    main = sizes.agg(F.min_by("component", F.struct(-F.col("n"), "component")).alias("main"))
    high = edges.where("bridge or layer <> 0").select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    platforms = edges.where(F.col("name").rlike(r"(?i)^Platform\b")).select(F.col("src").alias("id")).join(comps, "id").select("component").distinct()
    ground = nodes.where("level = 0").join(high, "id", "left_anti").join(comps, "id").join(F.broadcast(main))
    mainland = ground.where("component = main").select(F.col("id").alias("b"), "lon", "lat", F.col("ele").alias("ele_b"))
    small = sizes.where(F.col("n") <= MOST_NODES).select("component")
    islands = ground.where("component <> main").join(small, "component", "left_semi").join(platforms, "component", "left_anti")
    pairs = relational.within_join(islands.select(F.col("id").alias("a"), "lon", "lat"), mainland.select("b", "lon", "lat"), LONGEST_GAP_M)
    pairs = pairs.join(islands.select(F.col("id").alias("a"), "component", F.col("ele").alias("ele_a"), F.col("kind").alias("kind_a")), "a").join(mainland.select("b", "ele_b"), "b")
    pairs = pairs.where("ele_a is null or ele_b is null or abs(ele_a - ele_b) <= 2").join(nodes.select(F.col("id").alias("b"), F.col("kind").alias("kind_b")), "b")
    near = pairs.groupBy("component", "a", "kind_a").agg(F.min_by(F.struct("b", "distance_m", "kind_b"), F.struct("distance_m", "b")).alias("v")).select("component", "a", "kind_a", "v.*")
    score = F.col("distance_m") - F.when(F.col("kind_a") == "crossing", 5.0).otherwise(0.0)
    best = near.groupBy("component").agg(F.min_by(F.struct("a", "b", "distance_m", "kind_a", "kind_b"), F.struct(score, "a")).alias("v")).select("v.*")
    kind = F.when((F.col("kind_a") == "crossing") | (F.col("kind_b") == "crossing"), "crossing").otherwise("footway")
    return best.select(F.col("a").alias("src"), F.col("b").alias("dst"), kind.alias("kind"), F.greatest(F.lit(1.0), "distance_m").alias("length_m"), F.concat_ws(":", F.lit("gap"), "a", "b").alias("ref"))


def borrowed_names(edges: DataFrame, ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key, name): for edges (key, line, kind, name) without a name that of the nearest named street within 20 m of their middle point."""
    streets = ways.where(tag("name").isNotNull() & (tag("highway").isin(*ROADS, "pedestrian"))).select(F.col("id").alias("way"), tag("name").alias("street"), F.posexplode("nodes").alias("pos", "id"))
    w = Window.partitionBy("way").orderBy("pos")
    here = streets.join(nodes.select("id", "lon", "lat"), "id").withColumn("a", F.lag(F.struct("lon", "lat")).over(w)).where("a is not null")
    segments = here.select("street", F.col("a.lon").alias("ax"), F.col("a.lat").alias("ay"), F.col("lon").alias("bx"), F.col("lat").alias("by"))
    middle = F.element_at("line", (F.floor(F.size("line") / 2) + 1).cast("int"))
    asked = edges.where("name is null and kind <> 'elevator'").select(F.col("key").alias("a"), middle["lon"].alias("lon"), middle["lat"].alias("lat"))
    near = relational.segment_join(asked, segments, NAME_M).where(F.col("distance_m") < NAME_M)
    return near.groupBy(F.col("a").alias("key")).agg(F.min_by("street", F.struct("distance_m", "street")).alias("name"))


def outlined(edges: DataFrame, ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key, outline_name, outline_movable): for bridge edges (key, line, bridge) the outline of a bridge (a closed way) that holds their middle
    point. Outlines are found by grid cells of their boxes, then tested exactly."""
    rings = ways.where((tag("man_made") == "bridge") & (F.element_at("nodes", 1) == F.element_at("nodes", -1))).select(F.col("id").alias("way"), tag("name").alias("outline_name"), tag("bridge:movable").alias("outline_movable"), F.posexplode("nodes").alias("pos", "id"))
    rings = rings.join(nodes.select("id", "lon", "lat"), "id").groupBy("way", "outline_name", "outline_movable").agg(F.sort_array(F.collect_list(F.struct("pos", "lon", "lat"))).alias("ring")).where(F.size("ring") >= 4)
    middle = F.element_at("line", (F.floor(F.size("line") / 2) + 1).cast("int"))
    asked = edges.where("bridge").select("key", middle["lon"].alias("lon"), middle["lat"].alias("lat"))
    found = relational.polygon_join(asked, rings, "ring", 0.01)
    return found.groupBy("key").agg(F.min_by(F.struct("outline_name", "outline_movable"), "way").alias("v")).select("key", "v.*")


def council_surface(value: Column) -> Column:
    """A council's word for a surface as one of ours; null for words that say nothing useful."""
    v = F.lower(F.coalesce(value, F.lit("")))
    return F.when(v == "setts", "sett").when(v.rlike("flags|block paving"), "paving_stones").when(v == "concrete", "concrete").when(v.rlike("^hra|^dbm|^sma"), "asphalt")


def carriageway_only(kind: Column, surface_: Column) -> Column:
    """A street proxy's surface that is only its carriageway's."""
    return (kind == "street_proxy") & (surface_["state"] == "inferred") & (surface_["source"] == "osm") & surface_["method"].startswith("carriageway surface")
