"""License detection by ordered signature rules, with DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lower_ascii
from .license_rules import Rule, rules

WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
GAP = r"[^0-9a-z\x{80}-\x{10FFFF}]+"
# Stems that most keywords hold. A keyword without one is looked for by its longest word.
STEMS = ("licen", "copyright", "warrant", "permission", "redistribution", "gnu", "gpl", "apache", "mozilla", "software", "bsd", "creativecommons", "publicdomain", "opensource", "opendatacommons", "research", "commercial", "fuck", "evil")
#: cc as a word before by or zero: stands for the names that begin so, as no word of theirs is rare.
CC = r"cc[^0-9a-z\x{80}-\x{10FFFF}]+(by|zero)"
#: Marks put around a match; words never hold them.
START, END = "\u0001", "\u0002"


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def normal(text: Column) -> Column:
    """The words of a text in lower case (A-Z only), one space before, between and after them."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(lower_ascii(text), GAP, " ")), F.lit(" "))


def roots(keyword: str) -> tuple[str, ...]:
    """Texts in lower case one of which is in every text that holds the keyword as words: a part of one of its words."""
    if keyword == "c" or keyword == "cc by" or keyword.startswith(" by "):
        return ("cc", "cc0", "commons")
    return (next((s for s in STEMS if s in keyword), None) or max(keyword.split(), key=lambda w: (len(w), w)),)


def keywords_by_root(chosen: list[Rule]) -> dict[str, list[str]]:
    out: dict[str, set[str]] = {}
    for rule in chosen:
        for root in roots(rule.keyword):
            out.setdefault(root, set()).add(rule.keyword)
    return {root: sorted(out[root]) for root in sorted(out)}


def detect(df: DataFrame, text: str, row: str, chosen: list[Rule] | None = None) -> DataFrame:
    """(row, rule, label, priority, base, first, last, kept) for every match of every rule, word numbers from 0.

    A text is looked at only if it holds a root; a rule is tried only if the text holds its root and its keyword. Matches of one
    rule don't overlap. Rows of one `row` hold one text; its matches come once. kept is false if another match of the same or a stronger priority covers the interval: of equal intervals
    of one priority the earlier rule stays. Null and empty texts have no match. Intervals are settled within one text.
    """
    chosen = rules() if chosen is None else chosen
    table = df.sparkSession.createDataFrame(chosen, "rule int, keyword string, regex string, label string, priority int, base boolean")
    known = keywords_by_root(chosen)
    has = lambda t, root: t.contains(root) & t.rlike(CC) if root == "cc" else t.contains(root)
    # an array of one element, so that its text is lowered once for all roots
    raw = F.array(F.lower(text))
    gate = F.exists(raw, lambda t: reduce(lambda x, root: x | has(t, root), known, F.lit(False)))
    none = F.array().cast("array<string>")
    asked = F.transform(raw, lambda t: F.flatten(F.array(*[F.when(has(t, root), F.array(*[F.lit(k) for k in ks])).otherwise(none) for root, ks in known.items()])))
    found = df.where(F.col(text).isNotNull()).where(gate).select(row, normal(F.col(text)).alias("words"), F.flatten(asked).alias("asked"))
    held = F.filter(F.array_distinct("asked"), lambda k: F.contains(F.col("words"), k))
    found = found.select(row, "words", F.explode(held).alias("keyword")).join(F.broadcast(table), "keyword")
    marked = F.expr(f"regexp_replace(words, concat('(?<= )(', regex, ')(?= )'), '{START}$1{END}')")
    found = found.select(row, "rule", "label", "priority", "base", marked.alias("marked")).where(F.contains("marked", F.lit(START)))
    each = F.split(F.trim("marked"), " ")
    at = lambda test: F.filter(F.transform(each, lambda w, i: F.when(test(w), i)), lambda i: i.isNotNull())
    both = F.arrays_zip(at(lambda w: w.startswith(START)).alias("first"), at(lambda w: w.endswith(END)).alias("last"))
    found = found.select(row, "rule", "label", "priority", "base", F.inline(both).alias("first", "last")).distinct()
    order = Window.partitionBy(row).orderBy("first", F.desc("last"), "priority", "rule").rowsBetween(Window.unboundedPreceding, -1)
    covered = F.lit(False)
    for p in sorted({r.priority for r in chosen}):
        reach = F.max(F.when(F.col("priority") <= p, F.col("last"))).over(order)
        covered = covered | ((F.col("priority") == p) & F.coalesce(reach >= F.col("last"), F.lit(False)))
    return found.withColumn("kept", ~covered)


def scan(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row.

    labels: those of the base phrases and of the matches that suppression left, distinct, sorted, comma-joined. score: 0
    without a match, else 1 - 1/2 for each priority step of the strongest kept match below notices (a notice 1.0, a name 0.75,
    a base phrase alone 0.5, a hint 0.25). Null and empty texts: 0 words, empty labels. Repeated rows and ids stay apart.

    Matches go back to rows by the SHA-256 of id and text, which a task that runs again gives again; numbers of rows wouldn't be the
    same over a shuffled input. Only rows alike in both share a key, so copies of a text stay spread.
    """
    ident = F.unhex(F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), "text"), 256))
    df = documents.select("doc_id", "text", ident.alias("row"))
    hits = detect(df, "text", "row")
    base, kept = F.col("base"), F.col("kept") | F.col("base")
    joined = lambda label: F.array_join(F.sort_array(F.collect_set(label)), ",")
    found = hits.groupBy("row").agg(
        F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"), F.max(F.when(base, F.col("first"))).cast("long").alias("last_word"),
        joined(F.when(base, F.col("label"))).alias("base_labels"), joined(F.when(kept, F.col("label"))).alias("labels"), (F.lit(1.25) - F.min(F.when(kept, F.col("priority"))) * 0.25).alias("score"),
    )
    words = df.select("row", "doc_id", n_words(F.col("text")).alias("n_words"))
    out = words.join(found, "row", "left")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
