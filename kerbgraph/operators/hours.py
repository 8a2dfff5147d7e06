"""Opening hours: texts of the map's form into spans of minutes per weekday, and whether a place is open at an instant."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import relational

DAYS = ("Mo", "Tu", "We", "Th", "Fr", "Sa", "Su")
NAMES = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
_DAY = "(?:Mo|Tu|We|Th|Fr|Sa|Su)"
_ITEM = f"(?:{_DAY}(?:-{_DAY})?|PH)"
_PART = rf"^({_ITEM}(?:,{_ITEM})*)?\s*(.*)$"
_TIME = r"^\s*([0-9]{1,2}):([0-9]{2})-([0-9]{1,2}):([0-9]{2})\s*$"
DAY = 1440


def _day_number(name: Column) -> Column:
    return F.array_position(F.array(*[F.lit(d) for d in DAYS]), name).cast("int") - 1


def _days(selector: Column) -> Column:
    """Numbers of the days that a selector names, 7 for public holidays; all weekdays if it is empty. Ranges run over the week's end."""

    def span(item: Column) -> Column:
        a, b = _day_number(F.split_part(item, F.lit("-"), F.lit(1))), _day_number(F.element_at(F.split(item, "-"), -1))
        return F.transform(F.sequence(F.lit(0), F.pmod(b - a, F.lit(7))), lambda k: F.pmod(a + k, F.lit(7)))

    each = F.transform(F.split(selector, ","), lambda i: F.when(i == "PH", F.array(F.lit(7))).otherwise(span(i)))
    return F.when(selector == "", F.array(*[F.lit(i) for i in range(7)])).otherwise(F.array_distinct(F.flatten(each)))


def _spans(text: Column) -> Column:
    """Spans (start, end) in minutes of a list of times, an end before its start lying in the next day; null if one can't be read."""

    def one(item: Column) -> Column:
        n = [F.regexp_extract(item, _TIME, i).try_cast("int") for i in range(1, 5)]
        start, end = n[0] * 60 + n[1], n[2] * 60 + n[3]
        late = F.when(end <= start, end + DAY).otherwise(end)
        return F.when((start <= DAY) & (end <= 2 * DAY), F.struct(start.alias("start"), late.alias("end")))

    each = F.transform(F.split(text, ","), one)
    return F.when(F.forall(each, lambda s: s.isNotNull()), each)


def parse(places: DataFrame, text: str = "hours") -> DataFrame:
    """(id, day, start, end) of places (id, and a text of hours) that can be read in full; day 7 is a public holiday, start and end are null
    on a day when the place is shut. Texts with anything else (months, sunrise, comments) give no rows.

    ; starts a rule that replaces what was said of its days, a comma after a time or off adds to it.
    """
    rules = places.where(F.col(text) != "").select("id", F.trim(text).alias("s"))
    always = F.array(F.struct(F.lit(0).alias("rule"), F.lit(0).alias("n"), F.lit("00:00-24:00").alias("part")))
    split = F.flatten(F.transform(F.split("s", r"\s*;\s*"), lambda r, i: F.transform(F.split(r, r"(?<=\d|off|closed)\s*,\s*(?=[A-Z])"), lambda p, n: F.struct(i.alias("rule"), n.alias("n"), F.trim(p).alias("part")))))
    parts = rules.select("id", F.explode(F.when(F.col("s") == "24/7", always).otherwise(split)).alias("x")).select("id", "x.*").where("part <> ''")
    picked, rest = F.regexp_extract("part", _PART, 1), F.trim(F.regexp_extract("part", _PART, 2))
    shut = rest.isin("off", "closed")
    times = F.when(shut, F.array().cast("array<struct<start:int,end:int>>")).when((rest == "") & (picked != ""), F.array(F.struct(F.lit(0).alias("start"), F.lit(DAY).alias("end")))).otherwise(_spans(rest))
    parts = parts.withColumn("days", _days(picked)).withColumn("times", times).withColumn("at", F.col("rule") * 1000 + F.col("n"))
    bad = parts.where("times is null").select("id").distinct()
    said = parts.join(bad, "id", "left_anti").select("id", "at", "n", "times", F.explode("days").alias("day"))
    last = F.coalesce(F.max(F.when(F.col("n") == 0, F.col("at"))).over(Window.partitionBy("id", "day")), F.lit(-1))
    kept = said.withColumn("last", last).where(F.col("at") >= F.col("last"))
    return kept.select("id", "day", F.explode_outer("times").alias("t")).select("id", "day", "t.start", "t.end")


def _clock(minutes: Column) -> Column:
    m = F.pmod(minutes, F.lit(DAY))
    return F.concat(F.lpad(F.floor(m / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((m % 60).cast("string"), 2, "0"))


def status(asked: DataFrame, hours: DataFrame, holidays: DataFrame | None = None) -> DataFrame:
    """(id, ask, open, text) for instants asked (ask, id, t: UTC) of places with hours: open until when, or when it opens next.

    Spans from the day before to a week ahead are put on one line of minutes and merged where they touch. holidays (date): on them a
    place's holiday hours apply, if it has any. Times are the UK's.
    """
    uk = F.from_utc_timestamp("t", "Europe/London")
    today = F.pmod(F.dayofweek(uk) + 5, F.lit(7))
    weeks = hours.groupBy("id").agg(F.array_sort(F.collect_list(F.when(F.col("start").isNotNull(), F.struct("start", "end", "day")))).alias("week"), F.max(F.col("day") == 7).alias("ph"))
    rows = asked.select("ask", "id", today.alias("today"), (F.hour(uk) * 60 + F.minute(uk)).alias("now"), F.to_date(uk).alias("date")).join(weeks, "id")
    # few bytes, much work: dealt by number, not by size
    rows = relational.spread(rows, asked.count(), "ask")
    off = F.array().cast("array<date>")
    if holidays is not None:
        rows = rows.join(F.broadcast(holidays.agg(F.collect_set("date").alias("off"))))
        off = F.when(F.col("ph"), F.col("off")).otherwise(off)

    def of(k: Column) -> Column:
        day = F.pmod(F.col("today") + k, F.lit(7))
        if holidays is not None:
            day = F.when(F.array_contains(off, F.date_add("date", k)), 7).otherwise(day)
        return F.transform(F.filter("week", lambda s: s["day"] == day), lambda s: F.struct((k * DAY + s["start"]).alias("start"), (k * DAY + s["end"]).alias("end")))

    # the place's week as it lies around today, in its row; spans that touch are one
    line = F.array_sort(F.flatten(F.transform(F.sequence(F.lit(-1), F.lit(7)), of)))
    none = F.array().cast("array<struct<start:int,end:int>>")

    def joined(kept: Column, s: Column) -> Column:
        last = F.get(kept, F.size(kept) - 1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when(s["start"] <= last["end"], F.concat(F.slice(kept, F.lit(1), F.size(kept) - 1), F.array(longer))).otherwise(F.concat(kept, F.array(s)))

    rows = rows.withColumn("line", F.aggregate(line, none, joined))
    now = F.col("now")
    until = F.array_max(F.transform(F.filter("line", lambda s: (s["start"] <= now) & (now < s["end"])), lambda s: s["end"]))
    following = F.array_min(F.transform(F.filter("line", lambda s: s["start"] > now), lambda s: s["start"]))
    found = rows.select("ask", "id", "today", "now", until.alias("until"), following.alias("next"))
    name = lambda k: F.element_at(F.array(*[F.lit(n) for n in NAMES]), (F.pmod(F.col("today") + k, F.lit(7)) + 1).cast("int"))
    k, left = F.floor(F.col("until") / DAY), F.col("until") - F.col("now")
    far = (k >= 2) | ((k == 1) & (F.pmod("until", F.lit(DAY)) > 360))
    until = F.concat(F.when(far, F.when(k == 1, "tomorrow ").otherwise(F.concat(name(k), F.lit(" ")))).otherwise(""), _clock(F.col("until")))
    n = F.floor(F.col("next") / DAY)
    opens = F.concat(F.when(n == 0, "").when(n == 1, "tomorrow ").otherwise(F.concat(name(n), F.lit(" "))), _clock(F.col("next")))
    text = F.when(left >= 6 * DAY, "Open 24 hours").when(F.col("until").isNotNull(), F.concat(F.lit("Open until "), until, F.when(left <= 30, ", closing soon").otherwise(""))).when(F.col("next").isNotNull(), F.concat(F.lit("Closed, opens "), opens)).otherwise("Closed")
    return found.select("ask", "id", F.col("until").isNotNull().alias("open"), text.alias("text"))


def from_pairs(pairs: Column) -> Column:
    """A week of seven (open, close) pairs, null when shut, as a text: runs of equal days as one, 'off' where shut; null if all are."""
    texts = F.transform(pairs, lambda p: F.when(p["open"].isNull() | p["close"].isNull(), "off").otherwise(F.concat(p["open"], F.lit("-"), p["close"])))
    day = lambda i: F.element_at(texts, i + 1)
    starts = [F.lit(True), *[day(i) != day(i - 1) for i in range(1, 7)]]
    ends = [reduce(lambda e, j: F.when(starts[j], j - 1).otherwise(e), range(6, i, -1), F.lit(6)) for i in range(7)]
    names = F.array(*[F.lit(d) for d in DAYS])
    run = lambda i: F.when(starts[i], F.concat(F.lit(DAYS[i]), F.when(ends[i] > i, F.concat(F.lit("-"), F.element_at(names, (ends[i] + 1).cast("int")))).otherwise(""), F.lit(" "), day(i)))
    whole = F.array_join(F.filter(F.array(*[run(i) for i in range(7)]), lambda x: x.isNotNull()), "; ")
    return F.when(F.exists(texts, lambda x: x != "off"), whole)
