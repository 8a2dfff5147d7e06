"""Column functions: provenance, decay, geometry, clocks and text rules. All are built-in expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_008.8
# Trust of a state, its half-life in days, and what a corroboration adds.
TRUST = {"verified": 0.95, "inferred": 0.7, "reported": 0.6, "unknown": 0.0}
HALF_LIFE_DAYS = {"verified": 3 * 365.25, "inferred": 5 * 365.25, "reported": 2 * 365.25}


def js_round(x: Column) -> Column:
    """Half up toward +infinity, unlike Spark's round, which goes away from zero."""
    return F.floor(x + 0.5)


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(ts) if isinstance(ts, str) else ts)


def known(state: Column, value: Column) -> Column:
    return F.coalesce(state != "unknown", F.lit(False)) & value.isNotNull()


def _lookup(values: dict, key: Column) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v))])[key]


def confidence(state: Column, age_days: Column, corroborations: Column, measured: Column) -> Column:
    """How far a fact can be trusted: by state, +0.1 per corroboration of a report (0.9 at most), halved every half-life (four
    times as long for measured sources); an undated fact counts 0.8. Ages below 0 count as 0."""
    base = _lookup(TRUST, state)
    base = F.when(state == "reported", F.least(F.lit(0.9), base + corroborations * 0.1)).otherwise(base)
    life = _lookup(HALF_LIFE_DAYS, state) * F.when(measured, 4.0).otherwise(1.0)
    faded = F.pow(F.lit(0.5), F.greatest(age_days, F.lit(0.0)) / life)
    return F.when(state == "unknown", 0.0).when(age_days.isNull(), base * 0.8).otherwise(base * faded)


def decayed(weight: Column, age_days: Column, half_life: Column) -> Column:
    return weight * F.pow(F.lit(0.5), F.greatest(age_days, F.lit(0.0)) / half_life)


def evidence_level(support: Column, against: Column) -> Column:
    sure = support / (support + against + 1)
    return F.when(sure < 0.3, "faded").when(against >= 0.75 * support, "disputed").when(sure >= 0.7, "confirmed").otherwise("reported")


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def line_length_m(line: Column) -> Column:
    """Length of an array of (lon, lat)."""
    pairs = F.zip_with(F.slice(line, 1, F.greatest(F.size(line) - 1, F.lit(0))), F.slice(line, 2, F.greatest(F.size(line) - 1, F.lit(0))), lambda a, b: haversine_m(a["lon"], a["lat"], b["lon"], b["lat"]))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def segment_distance_m(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point to a segment on a local flat map (111,320 m a degree)."""
    k = F.cos(F.radians(py))
    x, y, u, v = (bx - ax) * k * 111_320, (by - ay) * 111_320, (px - ax) * k * 111_320, (py - ay) * 111_320
    t = F.when(x * x + y * y == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (u * x + v * y) / (x * x + y * y))))
    return F.sqrt(F.pow(u - t * x, 2) + F.pow(v - t * y, 2))


def bearing(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return F.pmod(F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d))), F.lit(360.0))


def in_ring(lon: Column, lat: Column, ring: Column) -> Column:
    """Even-odd rule for an array of (lon, lat), closed or not."""
    n = F.size(ring)
    last = F.concat(F.slice(ring, n, 1), F.slice(ring, 1, n - 1))
    crosses = F.zip_with(ring, last, lambda a, b: ((a["lat"] > lat) != (b["lat"] > lat)) & (lon < (b["lon"] - a["lon"]) * (lat - a["lat"]) / F.when(b["lat"] == a["lat"], None).otherwise(b["lat"] - a["lat"]) + a["lon"]))
    return F.size(F.filter(crosses, lambda c: F.coalesce(c, F.lit(False)))) % 2 == 1


def sun_altitude(seconds: Column, lon: float, lat: float) -> Column:
    """Degrees of the sun over the horizon, from mean anomaly and the equation of the centre."""
    days = seconds / 86400.0 - 10957.5
    g = F.radians(F.pmod(F.lit(357.529) + days * 0.98560028, F.lit(360.0)))
    q = F.lit(280.459) + days * 0.98564736
    along = F.radians(F.pmod(q + F.sin(g) * 1.915 + F.sin(g * 2) * 0.02, F.lit(360.0)))
    tilt = F.radians(F.lit(23.439) - days * 0.00000036)
    rise = F.atan2(F.cos(tilt) * F.sin(along), F.cos(along))
    lift = F.asin(F.sin(tilt) * F.sin(along))
    turn = F.radians(F.pmod(F.lit(280.46061837) + days * 360.98564736629 + lon, F.lit(360.0))) - rise
    here = F.radians(F.lit(lat))
    return F.degrees(F.asin(F.sin(here) * F.sin(lift) + F.cos(here) * F.cos(lift) * F.cos(turn)))


def speed_factor(grade_percent: Column, wheeled: Column) -> Column:
    """Share of the flat speed on a signed slope: the walker's exponential law within 0.3 to 1; wheels lose 7 % a percent uphill (0.3 at
    least) and 3 % a percent beyond 2 downhill (0.5 at least)."""
    walk = F.exp(F.abs(grade_percent / 100.0 + 0.05) * -3.5) / F.exp(F.lit(-3.5 * 0.05))
    up = F.greatest(F.lit(0.3), F.lit(1.0) - grade_percent * 0.07)
    down = F.greatest(F.lit(0.5), F.lit(1.0) - F.greatest(F.lit(0.0), -grade_percent - 2) * 0.03)
    return F.when(wheeled, F.when(grade_percent > 0, up).otherwise(down)).otherwise(F.greatest(F.lit(0.3), F.least(F.lit(1.0), walk)))


def _bases() -> tuple[str, str]:
    """Letters of the Latin blocks that decompose into a letter and combining marks, and those letters."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))) for block in (range(0xC0, 0x250), range(0x1E00, 0x1F00)) for c in block]
    known = [(c, d[0]) for c, d in pairs if len(d) > 1 and all("\u0300" <= m <= "\u036f" for m in d[1:])]
    return "".join(c for c, _ in known), "".join(d for _, d in known)


def accents_off(text: Column) -> Column:
    """Letters without their accents, composed or not. Letters that don't decompose, such as ß and œ, stay."""
    return F.regexp_replace(F.translate(text, *_bases()), "[\u0300-\u036f]", "")


def normal_text(text: Column) -> Column:
    """Lower case, no accents or apostrophes, one space for anything that is no letter a-z or digit. ß, œ and æ have no accent to lose
    and count as such."""
    plain = F.regexp_replace(accents_off(F.lower(text)), "['’]", "")
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))


def incline_percent(text: Column) -> Column:
    """'8%', '-3.5 %', '8' and '5°' as percent; other texts are null."""
    number = F.regexp_extract(text, r"^\s*(-?[0-9]+(?:\.[0-9]+)?)\s*[%°]?\s*$", 1).try_cast("double")
    return F.when(text.rlike(r"°\s*$"), F.tan(F.radians(number)) * 100).otherwise(number)


def _measure(text: Column, units: str) -> Column:
    return F.regexp_extract(text, rf"^\s*([0-9]+(?:\.[0-9]+)?)\s*(?:{units})?\s*$", 1).try_cast("double")


def metres(text: Column) -> Column:
    """'1.2', '1.2 m' and '120 cm' as metres; other texts are null."""
    return F.when(text.rlike(r"cm\s*$"), _measure(text, "m|cm") / 100).otherwise(_measure(text, "m|cm"))


def kerb_height_cm(text: Column) -> Column:
    """A kerb's height in centimetres: mm and cm as told, metres and bare numbers below 1 as metres, other bare numbers as centimetres."""
    n = _measure(text, "mm|cm|m")
    return F.when(text.rlike(r"mm\s*$"), n / 10).when(text.rlike(r"cm\s*$"), n).when(n < 1, n * 100).otherwise(n)
