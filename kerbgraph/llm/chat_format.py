"""Preference formatting: one prompt per pair of conversations and two completions with their training masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts of a rendered turn: what stands before the role, after it, and after the text.
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"


def render(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), F.coalesce(turn["role"], F.lit("")), F.lit(MIDDLE), F.coalesce(turn["text"], F.lit("")), F.lit(CLOSE))


def _spans(turns: Column, trained: str) -> Column:
    """(start, end, train) of each turn in the joined rendering of `turns`; a trained turn counts from its text to the end of CLOSE."""
    step = F.transform(turns, lambda t: F.struct(F.length(render(t)).alias("n"), (F.length(F.coalesce(t["role"], F.lit(""))) + len(OPEN) + len(MIDDLE)).alias("head"), F.coalesce(t["role"] == trained, F.lit(False)).alias("train")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,train:boolean>>").alias("out"))

    def add(acc: Column, t: Column) -> Column:
        whole = F.struct((acc["at"] + F.when(t["train"], t["head"]).otherwise(0)).cast("int").alias("start"), (acc["at"] + t["n"]).cast("int").alias("end"), t["train"].alias("train"))
        return F.struct((acc["at"] + t["n"]).cast("int").alias("at"), F.concat(acc["out"], F.array(whole)).alias("out"))

    return F.aggregate(step, zero, add, lambda acc: acc["out"])


def format_pairs(turns: DataFrame, pairs: DataFrame, *, trained: str = "assistant") -> DataFrame:
    """One row per row of `pairs` (pair_id, chosen_id, rejected_id), made from turns (conv_id, turn, role, text).

    The prompt is the longest common prefix of turns (same role and text, null equal to null), rendered once. chosen and
    rejected are the rest of each conversation; their spans mark which characters are trained on: those of turns of the
    `trained` role. A conversation's turns are ordered by turn, then role and text, nulls first; repeated turns stay. An
    unknown id or a null one has no turns. Rows without a conv_id belong to no conversation. One pair is one group, no larger
    than its two conversations; conversations are found by one join on conv_id, whichever pairs ask for them.
    """
    sides = pairs.select("pair_id", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("chosen_id").alias("conv_id")), F.struct(F.lit(1).alias("side"), F.col("rejected_id").alias("conv_id")))).alias("s")).select("pair_id", "s.side", "s.conv_id")
    asked = sides.join(turns.select("conv_id", "turn", "role", "text"), "conv_id")
    mine = lambda side: F.sort_array(F.collect_list(F.when(F.col("side") == side, F.struct("turn", "role", "text"))))
    both = pairs.join(asked.groupBy("pair_id").agg(mine(0).alias("c"), mine(1).alias("r")), "pair_id", "left")
    return _rendered(both, trained)


def _rendered(both: DataFrame, trained: str) -> DataFrame:
    empty = F.array().cast("array<struct<turn:bigint,role:string,text:string>>")
    df = both.withColumn("c", F.coalesce("c", empty)).withColumn("r", F.coalesce("r", empty))
    unequal = F.array_position(F.zip_with("c", "r", lambda a, b: F.coalesce(a["role"].eqNullSafe(b["role"]) & a["text"].eqNullSafe(b["text"]) & a.isNotNull() & b.isNotNull(), F.lit(False))), F.lit(False))
    longest = F.greatest(F.size("c"), F.size("r"))
    df = df.withColumn("common", F.when(unequal > 0, unequal - 1).otherwise(longest).cast("int"))
    rest = lambda x: F.slice(x, F.col("common") + 1, F.greatest(F.size(x) - F.col("common"), F.lit(0)))
    df = df.withColumn("p", F.slice("c", F.lit(1), F.col("common"))).withColumn("c", rest("c")).withColumn("r", rest("r"))
    text = lambda x: F.array_join(F.transform(x, render), "")
    return df.select(
        "pair_id", "chosen_id", "rejected_id", F.col("common").cast("long").alias("prompt_turns"), text("p").alias("prompt"),
        text("c").alias("chosen"), text("r").alias("rejected"), _spans(F.col("c"), trained).alias("chosen_spans"), _spans(F.col("r"), trained).alias("rejected_spans"),
    )


def neighbours(turns: DataFrame) -> DataFrame:
    """Pairs of the query: conversations 2k and 2k + 1, the even one chosen. Where one is missing its side is empty."""
    known = turns.where("conv_id is not null").select("conv_id").distinct()
    pair = F.floor(F.col("conv_id") / 2).alias("pair_id")
    return known.groupBy(pair).agg(F.max(F.when(F.pmod("conv_id", F.lit(2)) == 0, F.col("conv_id"))).alias("chosen_id"), F.max(F.when(F.pmod("conv_id", F.lit(2)) == 1, F.col("conv_id"))).alias("rejected_id"))


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["start"], s["end"], F.when(s["train"], 1).otherwise(0))), ",")


def query(turns: DataFrame) -> DataFrame:
    out = format_pairs(turns, neighbours(turns))
    return out.withColumn("chosen_spans", spans_text(F.col("chosen_spans"))).withColumn("rejected_spans", spans_text(F.col("rejected_spans")))


ORACLE = f"""
WITH t AS (SELECT conv_id, conv_id // 2 AS pair_id, conv_id % 2 AS side, role, text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT pair_id, max(conv_id) FILTER (side = 0) AS chosen_id, max(conv_id) FILTER (side = 1) AS rejected_id, max(i) AS longest FROM t GROUP BY 1),
bad AS (SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, min(coalesce(a.i, b.i)) AS i
  FROM (FROM t WHERE side = 0) a FULL JOIN (FROM t WHERE side = 1) b ON a.pair_id = b.pair_id AND a.i = b.i
  WHERE a.i IS NULL OR b.i IS NULL OR a.role IS DISTINCT FROM b.role OR a.text IS DISTINCT FROM b.text GROUP BY 1),
k AS (SELECT ids.*, coalesce(bad.i - 1, longest) AS common FROM ids LEFT JOIN bad USING (pair_id)),
x AS (SELECT k.*, t.side, t.i, coalesce(t.role = 'assistant', false) AS train, length(coalesce(t.role, '')) + {len(OPEN) + len(MIDDLE)} AS head,
    '{OPEN}' || coalesce(t.role, '') || '|>' || chr(10) || coalesce(t.text, '') || '<|end|>' || chr(10) AS said FROM k JOIN t USING (pair_id)),
y AS (SELECT *, coalesce(sum(length(said)) FILTER (i > common) OVER (PARTITION BY pair_id, side ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sofar FROM x),
z AS (SELECT *, (sofar + CASE WHEN train THEN head ELSE 0 END)::BIGINT || ':' || (sofar + length(said))::BIGINT || ':' || train::INT AS span FROM y)
SELECT pair_id, chosen_id, rejected_id, common::BIGINT AS prompt_turns,
  coalesce(string_agg(said, '' ORDER BY i) FILTER (side = 0 AND i <= common), '') AS prompt,
  coalesce(string_agg(said, '' ORDER BY i) FILTER (side = 0 AND i > common), '') AS chosen,
  coalesce(string_agg(said, '' ORDER BY i) FILTER (side = 1 AND i > common), '') AS rejected,
  coalesce(string_agg(span, ',' ORDER BY i) FILTER (side = 0 AND i > common), '') AS chosen_spans,
  coalesce(string_agg(span, ',' ORDER BY i) FILTER (side = 1 AND i > common), '') AS rejected_spans
FROM z GROUP BY ALL
"""
