"""Text rules as columns: closures and their denials, station messages, titles, shapes, distances, ages, tokens and how alike they are."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import js_round, normal_text

_WORD = "[0-9A-Za-z_]"
#: A word's edge by ASCII letters, digits and underscore alone, which \b isn't in every engine.
EDGE = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"

# Phrases that say a pavement is shut, and words that deny it.
FOOTWAY_CLOSED = (
    r"(?i)\b(foot ?ways?|foot ?paths?|f\/ ?w(ay)?|pavements?)\s+(will\s+(remain|be)\s+|is\s+|are\s+)?clos(ed|ure)\b|including foot ?(ways?|paths?)|\b(foot ?path|foot ?way) diversion|closed to pedestrians|pedestrians?\s+(will be\s+)?diverted"
)
STREET_CLOSED = r"(?i)(footway|pavement|footpath)s?\s+(will be\s+|is\s+|are\s+)?closed|pedestrians?\s+(will be\s+)?(diverted|closed)|closed to pedestrians"
DENIED_BEFORE = r"(?i)\b(no|not|without|nor|never|avoid(s|ing)?|excluding|except)\b[\s\w/-]{0,12}$"
DENIED_AFTER = r"(?i)^[\s:.,-]*((is|are|will|shall|be)\s+)*(not|(is|are|was|wo|shan)n't|n\/a|none|nil)\b"
FOOTWAY_WORDS = r"(?i)\b(foot ?ways?|foot ?paths?|f\/ ?w(ay)?|pavements?|pedestrians?)\b"


def ascii_edges(pattern: str) -> str:
    return pattern.replace(r"\b", EDGE)


def says(text: Column, pattern: str, before: str = DENIED_BEFORE, after: str = DENIED_AFTER, context: int = 24) -> Column:
    """Whether a text holds a match of the pattern that the words around it don't deny, `context` characters to either side being read. What
    lies between matches is split off, so that each one's place is known."""
    pattern, before, after = (ascii_edges(p) for p in (pattern, before, after))
    text = F.coalesce(text, F.lit(""))
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    at = lambda xs, i: F.get(xs, i)
    run = lambda xs, start, n: F.array_join(F.slice(xs, start, n), "")
    # a match and what lies beside it are a character at least, so `context` of them hold the context
    n = F.lit(context)
    ahead = lambda s, i: F.substring(F.concat(run(s["left"], F.greatest(i - n, F.lit(0)) + 1, F.least(i, n)), at(s["b"], i)), -context, context)
    behind = lambda s, i: F.substring(F.concat(at(s["b"], i + 1), run(s["right"], i + 2, n)), 1, context)
    stands = lambda s: lambda i: ~(ahead(s, i).rlike(before) | behind(s, i).rlike(after))
    # inside a lambda an expression is worked out for every element, a lambda's variable once: so each array is bound to one
    once = lambda value, then: F.element_at(F.transform(F.array(value), then), 1)
    sides = lambda s: F.struct(s["b"].alias("b"), F.zip_with(F.slice(s["b"], F.lit(1), F.size(s["f"])), s["f"], lambda x, m: F.concat(x, m)).alias("left"), F.zip_with(s["f"], F.slice(s["b"], F.lit(2), F.size(s["f"])), lambda m, x: F.concat(m, x)).alias("right"))
    places = lambda s: F.when(F.size(s["left"]) > 0, F.sequence(F.lit(0), F.size(s["left"]) - 1)).otherwise(F.array().cast("array<int>"))
    return once(F.struct(found.alias("f"), between.alias("b")), lambda s: once(sides(s), lambda t: F.exists(places(t), stands(t))))


def station_message(message: Column) -> Column:
    """(effect, partial): closed, no-step-free, not-calling or null for what a station's message means; partial if only a part of it."""
    m = F.lower(message)
    has = lambda p: m.rlike(ascii_edges(p))
    partial = has(r"\b(entrance|exit|footbridge|subway|car park|ticket hall|(east|west|north|south)bound|platform \d|towards)\b")
    other = has(r"\buse the [a-z' ]*(entrance|exit|lift)\b|\bentrance\/exit on\b|\binstead\b")
    said = lambda effect, part: F.struct(F.lit(effect).cast("string").alias("effect"), part.alias("partial"))
    return (
        F.when(has(r"step[- ]free access is (still )?available"), said(None, partial)).when(has(r"\bno step[- ]free access\b|\bstep[- ]free access is not available\b"), said("no-step-free", partial | other))
        .when(has(r"\b(will not|won't|do not|does not) (call|stop)\b|\bnot (calling|stopping)\b"), said("not-calling", partial)).when(has(r"\bstation (is |will be )?closed\b|\bthe station is closed\b") & ~partial, said("closed", partial)).otherwise(said(None, partial))
    )


def title(text: Column) -> Column:
    """Capitals after a space or hyphen only; what stands in brackets at the end goes. Null and empty are null."""
    words = F.transform(F.split(F.lower(text), r"(?<=[\s-])"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20)))
    return F.when(text != "", F.regexp_replace(F.array_join(words, ""), r"\s+\(.*\)$", ""))


def wkt_points(wkt: Column) -> Column:
    """The numbers of a shape in pairs (x, y); one left over is dropped."""
    n = F.transform(F.regexp_extract_all(wkt, F.lit(r"-?[0-9]+(?:\.[0-9]+)?"), F.lit(0)), lambda x: x.cast("double"))
    pairs = F.filter(F.sequence(F.lit(0), F.greatest(F.size(n) - 1, F.lit(0))), lambda i: (i % 2 == 0) & (i + 1 < F.size(n)))
    return F.transform(pairs, lambda i: F.struct(F.get(n, i).alias("x"), F.get(n, i + 1).alias("y")))


def wkt_parts(wkt: Column) -> Column:
    """The rings, lines or points of a shape, each by itself, so that parts are never joined up."""
    rings = F.filter(F.transform(F.regexp_extract_all(wkt, F.lit(r"\(([^()]+)\)"), F.lit(0)), wkt_points), lambda p: F.size(p) > 0)
    return F.when(F.upper(wkt).contains("POINT"), F.transform(wkt_points(wkt), lambda p: F.array(p))).otherwise(rings)


def distance_text(metres: Column, miles: Column, precise: bool = False) -> Column:
    """'120 m', '1.4 km', '400 yards' or '0.9 miles'; short distances to 10, or to 1 if precise."""
    step = 1 if precise else 10
    short = lambda x, word: F.concat((js_round(x / step) * step).cast("string"), F.lit(word))
    yards = metres * 1.0936133
    return F.when(miles, F.when(metres < 160.9344 * 2.5, short(yards, " yards")).otherwise(F.concat(F.format_number(metres / 1609.344, 1), F.lit(" miles")))).otherwise(F.when(metres < 1000, short(metres, " m")).otherwise(F.concat(F.format_number(metres / 1000, 1), F.lit(" km"))))


def age_text(seconds: Column) -> Column:
    """How long ago something was: today, yesterday, days up to 60, months up to 24, years."""
    days = F.floor(F.greatest(seconds, F.lit(0)) / 86_400)
    said = lambda n, word: F.concat(n.cast("string"), F.lit(f" {word} ago"))
    months = js_round(days / 30)
    return F.when(days < 1, "today").when(days == 1, "yesterday").when(days < 60, said(days, "days")).when(months < 24, said(months, "months")).otherwise(said(js_round(days / 365), "years"))


def first_address(forwarded: Column) -> Column:
    """The first address of a list of forwarders."""
    return F.trim(F.split_part(F.coalesce(forwarded, F.lit("")), F.lit(","), F.lit(1)))


def tokens(text: Column, stop: tuple[str, ...] = ()) -> Column:
    """The different words of a normalised text but for stop words; a plural s goes from words of more than three letters."""
    words = F.transform(F.split(normal_text(text), " "), lambda w: F.when((F.length(w) > 3) & w.endswith("s") & ~w.endswith("ss"), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w))
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: (w != "") & ~w.isin(*stop) if stop else w != "")))


def jaccard(a: Column, b: Column) -> Column:
    """What two sets share of all they hold; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def edit_similarity(a: Column, b: Column) -> Column:
    """1 less the share of letters to be changed, of the longer text; 1 if both are empty."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 0, 1.0 - F.levenshtein(a, b) / longest).otherwise(1.0)


#: Metres of a mile and of a yard, and from how many yards on a distance is said in miles.
MILE_M, YARD_M, MILES_FROM_YARDS = 1609.344, 0.9144, 440


def _tenth(x: Column) -> Column:
    """A number to one decimal, without .0."""
    v = js_round(x * 10) / 10
    return F.when(v == F.floor(v), F.floor(v).cast("long").cast("string")).otherwise(v.cast("string"))


def length_text(metres: Column, miles: Column, *, long: bool = False, precise: bool = False) -> Column:
    """'50 m', '1.2 km', '120 yd', '0.4 miles', or in full words: short lengths to 10, or to 1 if precise, but never to 0; long ones to a tenth below
    10 and to 1 from there. Nothing and null are 0."""
    step = 1 if precise else 10
    metres = F.coalesce(metres, F.lit(0.0))

    def short(x: Column, unit: str, one: str) -> Column:
        v = F.when(x > 0, F.greatest(F.lit(step), js_round(x / step) * step)).otherwise(0).cast("long")
        return F.concat(v.cast("string"), F.lit(" "), F.when(v == 1, one).otherwise(f"{one}s") if long else F.lit(unit))

    def far(x: Column, unit: str, one: str, many: str) -> Column:
        v = F.when(x < 10, _tenth(x)).otherwise(js_round(x).cast("long").cast("string"))
        return F.concat(v, F.lit(" "), F.when(v == "1", one).otherwise(many) if long or unit == "miles" else F.lit(unit))

    yards = metres / YARD_M
    imperial = F.when(yards < MILES_FROM_YARDS, short(yards, "yd", "yard")).otherwise(far(metres / MILE_M, "miles", "mile", "miles"))
    metric = F.when(js_round(metres / step) * step < 1000, short(metres, "m", "metre")).otherwise(far(metres / 1000, "km", "kilometre", "kilometres"))
    return F.when(miles, imperial).otherwise(metric)


def speed_text(mps: Column, miles: Column, *, long: bool = False) -> Column:
    """'8 mph' or '12.9 km/h', or in full words."""
    return F.when(miles, F.concat(_tenth(mps / 0.44704), F.lit(" miles per hour" if long else " mph"))).otherwise(F.concat(_tenth(mps * 3.6), F.lit(" kilometres per hour" if long else " km/h")))


def kerb_limit_text(cm: Column) -> Column:
    """A kerb limit in words: flush only, millimetres below a centimetre, centimetres."""
    return F.when(cm <= 0, "Flush only").when(cm < 1, F.concat(js_round(cm * 10).cast("long").cast("string"), F.lit(" mm"))).otherwise(F.concat(_tenth(cm), F.lit(" cm")))


def next_kerb_cm(cm: Column, up: Column, most: float = 20.0) -> Column:
    """A kerb limit one click up or down: the next whole centimetre, between flush and `most`."""
    v = F.least(cm, F.lit(most))
    return F.least(F.lit(most), F.greatest(F.lit(0.0), F.when(up, F.floor(v) + 1).otherwise(F.ceil(v) - 1).cast("double")))
