"""Places: which to keep, the same place in two sources, a search index and its queries, toilets, green spaces, nearest amenities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import texts as T
from . import relational

# Words that a search takes as a kind of place, as a wish for access, or not at all; words that tell no name apart.
INTENTS = (
    (("toilet", "toilets", "loo", "loos", "wc", "lavatory"), ("amenity=toilets",)), (("cafe", "cafes", "coffee"), ("amenity=cafe",)), (("pub", "pubs"), ("amenity=pub", "amenity=bar")), (("bar", "bars"), ("amenity=bar", "amenity=pub")),
    (("restaurant", "restaurants", "food", "eat", "lunch", "dinner"), ("amenity=restaurant", "amenity=cafe", "amenity=fast_food")), (("takeaway", "takeaways"), ("amenity=fast_food",)),
    (("pharmacy", "pharmacies", "chemist", "chemists"), ("amenity=pharmacy", "shop=chemist")), (("cash", "atm", "cashpoint"), ("amenity=atm", "amenity=bank")), (("bank", "banks"), ("amenity=bank",)), (("hotel", "hotels"), ("tourism=hotel", "tourism=guest_house")),
    (("museum", "museums"), ("tourism=museum",)), (("gallery", "galleries"), ("tourism=gallery", "amenity=arts_centre")), (("library", "libraries"), ("amenity=library",)), (("hospital",), ("amenity=hospital",)), (("gp", "doctor", "doctors", "surgery"), ("amenity=doctors",)), (("dentist",), ("amenity=dentist",)),
    (("supermarket", "groceries", "shop", "shops"), ("shop=supermarket", "shop=convenience")), (("station", "stations", "train", "trains"), ("railway=station", "railway=halt", "railway=subway_entrance")), (("bus",), ("highway=bus_stop",)), (("park", "parks", "garden", "gardens"), ("leisure=park", "leisure=garden")),
    (("cinema",), ("amenity=cinema",)), (("theatre", "theatres"), ("amenity=theatre",)), (("church", "mosque", "synagogue", "temple", "gurdwara"), ("amenity=place_of_worship",)), (("post",), ("amenity=post_office",)),
)
ACCESS_WORDS = ("accessible", "wheelchair", "stepfree", "step", "free", "disabled", "disability", "access", "radar", "level")
FILLER = ("a", "an", "the", "near", "nearby", "me", "with", "in", "for", "and", "nearest", "closest", "find", "no", "steps", "entrance")
STOP = ("the", "and", "ltd", "limited", "of", "edinburgh", "newcastle", "london", "co", "uk", "plc", "cafe", "bar", "restaurant", "shop", "store")
NOT_VISITABLE = ("home_service", "b2b_office_and_professional_service", "corporate_or_business_office", "media_service", "technical_service", "design_service", "event_or_party_service")
POSTCODE_START = r"(?i)^[a-z]{1,2}\d[a-z\d]?(\s*\d[a-z]{0,2})?$"
ABOUT_GROUND = r"(?i)\b(path|paths|footpath|footway|pavement|sidewalk|steps?|stairs?|kerbs?|curbs?|ramps?|gate|barrier|bollards?|crossing|lift|elevator|surface|cobbles?|setts|wheelchair|step-free|bridge|underpass|subway)\b"
QUESTION = r"(?i)^(Can't answer|Unable to answer|In overlay)"
ABOUT_PLACE = r"(?i)opening hours|house number|still here\?|name of this|what('|’)?s the name|is this place|cuisine|which brand|submitted note from a business"
#: Metres: the same name, the same spelling or address, a toilet of two sources; least confidence; letters of a prefix that is looked up.
SAME_M, NEXT_DOOR_M, TOILET_M, SURE, PREFIX = 75.0, 40.0, 30.0, 0.7, 12
LIMIT = 25


def name_tokens(name: Column) -> Column:
    """Words of a name for matching: & reads as and, accents and punctuation go, filler words go, a plural s goes from words of over four
    letters."""
    plain = F.regexp_replace(C.accents_off(F.regexp_replace(F.lower(name), "&", " and ")), "[^a-z0-9]+", " ")
    words = F.filter(F.split(plain, " "), lambda w: (F.length(w) > 1) & ~w.isin(*STOP))
    return F.array_distinct(F.transform(words, lambda w: F.when(w == "saint", "st").when(F.length(w) > 4, F.regexp_replace(w, "s$", "")).otherwise(w)))


def same_name(a: Column, b: Column, metres: Column) -> Column:
    """Whether two lists of name words are one place's: next door a spelling of each other, or within 75 m most words shared."""
    ca, cb = F.array_join(a, ""), F.array_join(b, "")
    shared = F.size(F.array_intersect(a, b))
    spelt = (metres < NEXT_DOOR_M) & (ca.contains(cb) | cb.contains(ca) | (T.edit_similarity(ca, cb) >= 0.8))
    words = (shared > 0) & (metres < SAME_M) & ((shared == F.least(F.size(a), F.size(b))) | (shared / (F.size(a) + F.size(b) - shared) >= 0.5))
    return (F.size(a) > 0) & (F.size(b) > 0) & (spelt | words)


def street_address(text: Column) -> Column:
    """'30 grindlay street' of an address line, null without a house number."""
    first = F.trim(F.regexp_replace(F.lower(F.split_part(text, F.lit(","), F.lit(1))), r"\.", ""))
    number = F.regexp_extract(first, r"^(\d+[a-z]?(?:-\d+[a-z]?)?)\s+(.+)$", 1)
    street = F.regexp_extract(first, r"^(\d+[a-z]?(?:-\d+[a-z]?)?)\s+(.+)$", 2)
    for short, long in (("st", "street"), ("rd", "road"), ("ave?", "avenue"), ("pl", "place"), ("sq", "square"), ("ter", "terrace")):
        street = F.regexp_replace(street, rf"(?<![a-z0-9_]){short}$", long)
    return F.when(number != "", F.concat(number, F.lit(" "), F.regexp_replace(street, r"\s+", " ")))


def worth_adding(places: DataFrame) -> DataFrame:
    """Places (id, name, kind, kinds, lon, lat, address, confidence, sources) that are sure enough, somewhere people go, and not only scraped
    from sites that don't allow it."""
    kinds = F.concat(F.array("kind"), F.coalesce("kinds", F.array().cast("array<string>")))
    scraped = F.array_contains("sources", "AllThePlaces") & F.forall("sources", lambda s: s.isin("AllThePlaces", "Overture"))
    barred = scraped & (F.col("name").rlike("(?i)changing places") | F.col("kind").isin("public_restroom", "pharmacy") | F.array_contains(kinds, "health_care"))
    visited = ~F.exists(kinds, lambda k: F.coalesce(k.isin(*NOT_VISITABLE), F.lit(False)))
    return places.where((F.col("confidence") >= SURE) & (F.col("name") != "") & F.col("kind").isNotNull() & visited & ~F.coalesce(barred, F.lit(False))).where(F.size(name_tokens(F.col("name"))) > 0)


def not_known_yet(new: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of new (id, name, lon, lat, address, category) that are no place of known (id, name, lon, lat, address, category): a like name within
    75 m, or the same address within 40 m with a shared name word or the same category."""
    side = lambda df, k: df.where("name is not null").select(F.col("id").alias(k), "lon", "lat")
    near = relational.within_join(side(new, "a"), side(known, "b"), SAME_M)
    facts = lambda df, k: df.select(F.col("id").alias(k), name_tokens(F.col("name")).alias(f"t{k}"), street_address(F.col("address")).alias(f"s{k}"), F.col("category").alias(f"c{k}"))
    pairs = near.join(facts(new, "a"), "a").join(facts(known, "b"), "b")
    door = (F.col("sa") == F.col("sb")) & (F.col("distance_m") < NEXT_DOOR_M) & (F.arrays_overlap("ta", "tb") | F.coalesce(F.col("ca") == F.col("cb"), F.lit(False)))
    same = pairs.where(same_name(F.col("ta"), F.col("tb"), F.col("distance_m")) | F.coalesce(door, F.lit(False)))
    return new.join(same.select(F.col("a").alias("id")).distinct(), "id", "left_anti")


def merge_toilets(toilets: DataFrame, listed: DataFrame) -> DataFrame:
    """toilets (id, lon, lat, accessible, fee, hours) filled in from the nearest listed one within 30 m, with `disputed` where both know of access and
    disagree, in which case it counts as unknown; listed ones near none are added (id negative). What a toilet says of itself stays."""
    side = lambda df, k: df.select(F.col("id").alias(k), "lon", "lat")
    near = relational.nearest_join(side(listed, "a"), side(toilets, "b"), TOILET_M)
    best = near.groupBy("b").agg(F.min_by("a", F.struct("distance_m", "a")).alias("a"))
    other = listed.select(F.col("id").alias("a"), F.col("accessible").alias("__accessible"), F.col("fee").alias("__fee"), F.col("hours").alias("__hours"))
    rows = toilets.join(best.withColumnRenamed("b", "id"), "id", "left").join(other, "a", "left")
    disputed = F.coalesce(F.col("accessible") != F.col("__accessible"), F.lit(False))
    filled = rows.select("id", "lon", "lat", F.when(~disputed, F.coalesce("accessible", "__accessible")).alias("accessible"), F.coalesce("fee", "__fee").alias("fee"), F.coalesce("hours", "__hours").alias("hours"), disputed.alias("disputed"))
    added = listed.join(near.select(F.col("a").alias("id")), "id", "left_anti").select((-F.col("id") - 1).alias("id"), "lon", "lat", "accessible", "fee", "hours", F.lit(False).alias("disputed"))
    return filled.unionByName(added)


def nearest_amenity(edges: DataFrame, amenities: DataFrame, radius_m: float = 400.0) -> DataFrame:
    """(edge, distance_m): metres from an edge's middle (edge, lon, lat) to the nearest amenity (lon, lat), null beyond the radius."""
    points = amenities.select(F.monotonically_increasing_id().alias("b"), "lon", "lat")
    near = relational.within_join(edges.select(F.col("edge").alias("a"), "lon", "lat"), points, radius_m).groupBy(F.col("a").alias("edge")).agg(F.min("distance_m").alias("distance_m"))
    return edges.select("edge").join(near, "edge", "left")


def containing_site(asked: DataFrame, sites: DataFrame, cell: float = 0.01) -> DataFrame:
    """(ask, site): for asked (ask, name, lon, lat) the site (site, name, west, south, east, north) whose box holds the point: one of that name first, then
    the smallest. Boxes are found by grid cells."""
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell)))
    stored = sites.withColumn("cx", cells("west", "east")).withColumn("cy", cells("south", "north")).withColumnRenamed("name", "site_name")
    found = asked.withColumn("cx", F.floor(F.col("lon") / cell)).withColumn("cy", F.floor(F.col("lat") / cell)).join(stored, ["cx", "cy"]).where("lon between west and east and lat between south and north")
    area = (F.col("east") - F.col("west")) * (F.col("north") - F.col("south"))
    return found.groupBy("ask").agg(F.min_by("site", F.struct(~F.coalesce(F.lower("name") == F.lower("site_name"), F.lit(False)), area, "site")).alias("site"))


def keep_note(text: Column, last: Column, now: Column) -> Column:
    """Whether a map note is about the ground people walk on, no question about a business, and not three years old."""
    says = lambda p: text.rlike(T.ascii_edges(p))
    return F.coalesce(~says(QUESTION) & ~says(ABOUT_PLACE) & says(ABOUT_GROUND) & (F.timestamp_diff("SECOND", last, now) <= int(3 * 365.25 * 86_400)), F.lit(False))


def parse_query(q: Column) -> Column:
    """(terms, cats, wish, postcode, names): what is typed, as name words, kinds of place (null if none), a wish for access, a postcode's
    beginning, and the words a name may hold."""
    words = F.filter(F.split(C.normal_text(F.regexp_replace(q, r"(?i)step[\s-]*free", "stepfree")), " "), lambda w: w != "")
    intent = lambda w: F.coalesce(*[F.when(w.isin(*ws), i) for i, (ws, _) in enumerate(INTENTS)])
    first = F.try_element_at(F.filter(F.transform(words, lambda w, i: F.struct(i.alias("at"), intent(w).alias("of"))), lambda x: x["of"].isNotNull()), F.lit(1))
    cats = F.element_at(F.array(*[F.array(*[F.lit(c) for c in cs]) for _, cs in INTENTS]), first["of"] + 1)
    numbered = F.transform(words, lambda w, i: F.struct(i.alias("at"), w.alias("w")))
    left = F.filter(numbered, lambda x: ~F.coalesce(x["at"] == first["at"], F.lit(False)) & ~x["w"].isin(*ACCESS_WORDS) & ~x["w"].isin(*FILLER))
    wish = F.exists(numbered, lambda x: x["w"].isin(*ACCESS_WORDS) & ~F.coalesce(x["at"] == first["at"], F.lit(False)))
    code = F.when(F.trim(q).rlike(POSTCODE_START), F.regexp_replace(F.upper(F.trim(q)), r"\s+", " "))
    names = F.filter(words, lambda w: ~w.isin(*FILLER) & ~w.isin(*ACCESS_WORDS))
    return F.struct(F.transform(left, lambda x: x["w"]).alias("terms"), F.when(first.isNotNull(), cats).alias("cats"), wish.alias("wish"), code.alias("postcode"), names.alias("names"))


def entries(places: DataFrame) -> DataFrame:
    """A search index of places (id, name, extra, rank, cat, accessible, lon, lat): with words of name and extra, and the name run together."""
    words = F.split(C.normal_text(F.concat_ws(" ", "name", "extra")), " ")
    return places.withColumn("words", words).withColumn("joined", F.regexp_replace(C.normal_text(F.col("name")), " ", ""))


def _starts(term: Column, words: Column) -> Column:
    return F.exists(words, lambda w: w.startswith(term))


#: Queries asked at once up to which they are sent to the index, so that it stays where it is.
FEW_ASKED = 10_000


def search(asked: DataFrame, index: DataFrame, postcodes: DataFrame | None = None, limit: int | None = LIMIT) -> tuple[DataFrame, DataFrame]:
    """Hits (ask, rank, id, name, metres, score) of queries asked (ask, q, lon, lat), best first, and (ask, hidden): how many were left out because their
    access isn't mapped.

    A name matches if every word typed begins one of its words, or all run together begin the name run together. Names are found by
    an equi-join on beginnings of words (the longest word typed), kinds by an equi-join on the kind. Of hits of one name at one spot the first stays.
    Without a limit all hits come back, not numbered (rank is null), so that no query's hits are sorted in one place.
    """
    q = asked.withColumn("p", parse_query(F.col("q"))).withColumn("raw", F.regexp_replace(C.normal_text(F.col("q")), " ", "")).where("raw <> ''").select("ask", "raw", "p.*", F.col("lon").alias("qlon"), F.col("lat").alias("qlat"))
    entry = ["id", "name", "rank", "cat", "accessible", "words", "joined", "lon", "lat"]
    few = asked.count() <= FEW_ASKED
    # an index that many ask is shuffled: Spark takes the exploded one for no larger than its file, and it must not be gathered to be sent to all
    meet = lambda ask, stored, key: F.broadcast(ask).join(stored, key) if few else ask.join(stored.hint("merge"), key)
    kinds = meet(q.where("cats is not null").withColumn("cat", F.explode("cats")), index.select(*entry), "cat").where((F.size("terms") == 0) | F.forall("terms", lambda t: _starts(t, F.col("words"))))
    kinds = kinds.withColumn("by_kind", F.lit(True))
    cut = lambda c: F.substring(c, 1, PREFIX)
    beginnings = lambda c: F.transform(F.sequence(F.lit(1), F.least(F.length(c), F.lit(PREFIX))), lambda n: F.substring(c, F.lit(1), n))
    keys = F.array_distinct(F.flatten(F.transform(F.filter(F.array_union("words", F.array("joined")), lambda w: w != ""), beginnings)))
    named = q.where((F.size("names") > 0) & (F.col("cats").isNull() | (F.size("terms") > 0)))
    longest = F.array_max(F.transform("names", lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    named = named.withColumn("key", F.explode(F.array_distinct(F.array(cut(longest), cut(F.array_join("names", ""))))))
    beginning = index.select(*entry, F.explode(keys).alias("key"))
    names = meet(named, beginning, "key").where(F.forall("names", lambda t: _starts(t, F.col("words"))) | F.col("joined").startswith(F.array_join("names", "")))
    names = names.where(F.col("cats").isNull() | ~F.coalesce(F.array_contains("cats", F.col("cat")), F.lit(False))).drop("key").dropDuplicates(["ask", "id"]).withColumn("by_kind", F.lit(False))
    return _ranked(q, kinds.unionByName(names), postcodes, limit)


def _ranked(q: DataFrame, both: DataFrame, postcodes: DataFrame | None, limit: int | None) -> tuple[DataFrame, DataFrame]:
    k = F.cos(F.radians("lat"))
    metres = F.hypot((F.col("lon") - F.col("qlon")) * k, F.col("lat") - F.col("qlat")) * 111_320.0
    rows = both.withColumn("metres", metres)
    match = F.when(F.col("joined") == F.col("raw"), 0).when(F.col("joined").startswith(F.col("raw")), 1).otherwise(2)
    score = F.when(F.col("by_kind"), F.when(F.size("terms") > 0, 5 + F.col("metres") / 1000).otherwise(F.col("metres") / 100)).otherwise(match * 10 + F.col("rank") * 2 + F.least(F.col("metres") / 1000, F.lit(5.0)))
    keep = ~F.col("wish") | F.coalesce("accessible", F.lit(False)) | (~F.col("by_kind") & F.col("cat").isNull())
    hidden = rows.where(~keep).groupBy("ask").agg(F.count("*").alias("hidden"))
    hits = rows.where(keep).select("ask", "id", "name", "lon", "lat", "metres", score.alias("score"))
    if postcodes is not None:
        code = F.regexp_replace("postcode", " ", "")
        beginnings = F.explode(F.transform(F.sequence(F.lit(2), F.length("joined")), lambda n: F.substring("joined", F.lit(1), n)))
        stored = postcodes.withColumn("joined", F.regexp_replace("name", r"\s", "")).withColumn("key", beginnings)
        found = q.where("postcode is not null").withColumn("key", code).join(stored, "key").withColumn("metres", metres)
        hits = hits.unionByName(found.select("ask", "id", "name", "lon", "lat", "metres", F.when(F.col("joined") == F.col("key"), -2.0).otherwise(-1.0).alias("score")))
    spot = F.struct("name", C.js_round(F.col("lon") * 2000), C.js_round(F.col("lat") * 2000))
    once = hits.withColumn("spot", spot).groupBy("ask", "spot").agg(F.min_by(F.struct("id", "name", "metres", "score"), F.struct("score", "id")).alias("v")).select("ask", "v.*")
    if limit is None:
        ranked = once.withColumn("rank", F.lit(None).cast("int"))
    else:
        ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("ask").orderBy("score", "id"))).where(F.col("rank") <= limit)
    return ranked.select("ask", "rank", "id", "name", "metres", "score"), q.select("ask").join(hidden, "ask", "left").select("ask", F.coalesce("hidden", F.lit(0)).alias("hidden"))
