"""Benchmark decontamination by a prefix-filtered join of word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ALNUM, BitFilter, Tables, Words, bit_filter, blocks, lower_ascii, written

#: Words of a window, words of a shingle, and into how many keys a shingle's places in documents are dealt.
WINDOW, SHINGLE, SALTS = 10, 3, 32
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(texts: pa.Array, row: int, words: Words, lo: int, hi: int) -> str:
    """Words lo to hi of the whole block, with one space between."""
    return b" ".join(words.bytes[words.start[i] : words.end[i]].tobytes() for i in range(lo, hi)).decode()


def windows(benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """(item_id, words) for every window of every item: `width` consecutive words, or all words of an item of fewer."""
    items = benchmark.where("text is not null and item_id is not null").select("item_id", F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(WORD), F.lit(0)).alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1)))
    return items.select("item_id", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, F.lit(width)), " "))).alias("words")).distinct()


def _shingles_of(texts: pa.Array, widths: list[int]) -> tuple[Words, list[tuple[np.ndarray, np.ndarray]]]:
    """Words, and for each width the hashes of all shingles and the number of each one's first word. Hashes tell widths apart."""
    words = Words(texts, ALNUM)
    out = []
    for k in widths:
        hashes, first = words.shingles(k)
        n = np.diff(first)
        whole = (words.count >= k) & (n > 0)
        at = np.repeat(words.first[:-1], n) + np.arange(len(hashes)) - np.repeat(first[:-1], n)
        keep = np.repeat(whole, n)
        out.append(((hashes ^ np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64)))[keep].view(np.int64), at[keep]))
    return words, out


def window_shingles(table: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(words, n, shingle, place) for every shingle of every different window; windows of fewer words than `size` are one shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("words")
            words, found = _shingles_of(column, list(range(1, size + 1)))
            row = np.repeat(np.arange(words.n), words.count)
            for k, (hashes, at) in enumerate(found, 1):
                r = row[at]
                fits = np.minimum(words.count[r], size) == k
                r, at, hashes = r[fits], at[fits], hashes[fits]
                yield pa.RecordBatch.from_arrays([column.take(pa.array(r)), pa.array(words.count[r].astype(np.int32)), pa.array(hashes), pa.array((at - words.first[r]).astype(np.int32)), pa.array(np.full(len(r), k, np.int32))], ["words", "n", "shingle", "place", "width"])

    return table.select("words").distinct().mapInArrow(run, "words string, n int, shingle long, place int, width int")


def frequencies(documents: DataFrame, text: str, known: BitFilter, widths: list[int]) -> DataFrame:
    """(shingle, times): how often documents hold the shingles that pass `known`, summed in every batch before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, seen = batch.column("__text"), []
            for lo, hi in blocks(column):
                for hashes, _ in _shingles_of(column.slice(lo, hi - lo), widths)[1]:
                    seen.append(np.unique(hashes[known.hits(hashes)], return_counts=True))
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([s for s, _ in seen])), pa.array(np.concatenate([n for _, n in seen]).astype(np.int64))], ["shingle", "times"])

    return documents.select(F.col(text).alias("__text")).mapInArrow(run, "shingle long, times long").groupBy("shingle").agg(F.sum("times").alias("times"))


def places(documents: DataFrame, text: str, keep: list[str], known: BitFilter, widths: list[int], reach: int = WINDOW) -> DataFrame:
    """The columns in `keep`, n_words, and an array of (shingle, at, from, around): the places whose shingle passes `known`, with
    the words around, beginning with word `from`, that a window over the place may cover."""
    schema = ", ".join([*(f"`{k}` {documents.schema[k].dataType.simpleString()}" for k in keep), "n_words long, found array<struct<shingle:bigint,at:int,from:int,around:string>>"])
    kind = pa.struct([("shingle", pa.int64()), ("at", pa.int32()), ("from", pa.int32()), ("around", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("__text")
            for lo, hi in blocks(column):
                words, found = _shingles_of(column.slice(lo, hi - lo), widths)
                hits = [known.hits(h) for h, _ in found]
                shingle = np.concatenate([h[ok] for (h, _), ok in zip(found, hits, strict=True)])
                at = np.concatenate([a[ok] for (_, a), ok in zip(found, hits, strict=True)])
                order = np.argsort(at, kind="stable")
                shingle, at = shingle[order], at[order]
                row = np.searchsorted(words.first, at, side="right") - 1
                begin = np.maximum(at - reach + 1, words.first[row])
                end = np.minimum(at + reach, words.first[row + 1])
                around = [_words(column, 0, words, a, b) for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
                base = words.first[row]
                structs = pa.StructArray.from_arrays([pa.array(shingle), pa.array((at - base).astype(np.int32)), pa.array((begin - base).astype(np.int32)), pa.array(around, pa.string())], fields=list(kind))
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(words.n + 1)).astype(np.int32)), structs)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(lo, hi - lo) for k in keep), pa.array(words.count.astype(np.int64)), lists], [*keep, "n_words", "found"])

    return documents.select(*[f"`{k}`" for k in keep], F.col(text).alias("__text")).mapInArrow(run, schema)


def find(documents: DataFrame, benchmark: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns in `keep`, n_words, n_hit and items (sorted item ids as strings) of every row of documents.

    1. Shingles of the benchmark's windows are counted over all documents. 2. A window can only occur where its rarest shingle
    does, so that one shingle is its whole necessary prefix (all of its shingles are asked for). 3. Documents' places of prefix
    shingles are joined with the windows. 4. A window that would begin before the text or end after it is dropped. 5. The words
    there must equal the window's. What a document's places need travels with them: texts are never shuffled, but for those in `keep`,
    so keep ids. Columns in `keep` named as the new ones give way.
    Repeated rows and ids, null texts and texts without words stay rows of their own; items without words occur nowhere.
    """
    keep = [k for k in keep or [] if k not in ("n_words", "n_hit", "items")]
    inner = [f"__k{i}" for i in range(len(keep))]
    documents = documents.select(*[F.col(f"`{k}`").alias(i) for k, i in zip(keep, inner, strict=True)], F.col(f"`{text}`").alias("__text"))
    with Tables(documents.sparkSession) as tables:
        windowed = tables.write(windows(benchmark), "windows")
        shingles = tables.write(window_shingles(windowed), "shingles")
        widths = sorted(r["width"] for r in shingles.select("width").distinct().collect()) or [1]
        times = frequencies(documents, "__text", bit_filter(shingles, "shingle"), widths)
        rarest = Window.partitionBy("words").orderBy(F.coalesce("times", F.lit(0)), "shingle", "place")
        prefix = shingles.join(times, "shingle", "left").withColumn("rank", F.row_number().over(rarest)).where("rank = 1 and times is not null")
        prefix = tables.write(prefix.select("words", "n", "shingle", "place"), "prefix")
        rows = places(documents, "__text", inner, bit_filter(prefix, "shingle"), widths)
        rows = tables.write(rows.withColumn("row", F.monotonically_increasing_id()), "places")

        salted = F.col("row") % SALTS
        sites = rows.where("size(found) > 0").select("row", "n_words", F.inline("found"), salted.alias("salt"))
        asked = prefix.withColumn("salt", F.explode(F.array(*[F.lit(i).cast("long") for i in range(SALTS)])))
        start = (F.col("at") - F.col("place")).alias("start")
        near = sites.join(asked, ["shingle", "salt"]).withColumn("start", start).where("start >= 0 and start + n <= n_words")
        same = F.array_join(F.slice(F.split("around", " "), F.col("start") - F.col("from") + 1, F.col("n")), " ") == F.col("words")
        hits = tables.write(near.where(same).select("row", "start", "n", "words", "salt"), "hits")

        before = F.max(F.col("start") + F.col("n")).over(Window.partitionBy("row").orderBy("start", "n").rowsBetween(Window.unboundedPreceding, -1))
        spans = hits.groupBy("row", "start").agg(F.max("n").alias("n")).withColumn("before", F.coalesce(before, F.lit(0)))
        covered = spans.groupBy("row").agg(F.sum(F.greatest(F.lit(0), F.col("start") + F.col("n") - F.greatest("start", "before"))).cast("long").alias("n_hit"))
        owners = windowed.withColumn("salt", F.explode(F.array(*[F.lit(i).cast("long") for i in range(SALTS)])))
        items = hits.select("row", "words", "salt").distinct().join(owners, ["words", "salt"]).groupBy("row").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
        out = rows.select(*inner, "row", "n_words").join(covered, "row", "left").join(items, "row", "left")
        out = out.select(*[F.col(i).alias(k) for k, i in zip(keep, inner, strict=True)], "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
        return written(out, "decontaminated")


def report(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row of documents."""
    out = find(documents.select("doc_id", "text"), benchmark, keep=["doc_id"])
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_CLASS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_CLASS}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_CLASS}') AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS words, least(len(w), {WINDOW}) AS n FROM b, range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1) t(i) WHERE len(w) > 0),
word AS (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
chain AS (SELECT r, i, list(x) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS xs FROM word),
hit AS (SELECT r, i, n, array_to_string(xs[:n], ' ') AS words FROM chain, (SELECT DISTINCT n FROM win) WHERE len(xs) >= n),
hits AS (SELECT DISTINCT r, i, n, words FROM hit JOIN win USING (words, n)),
cover AS (SELECT r, count(DISTINCT p) AS n_hit FROM hits, range(i, i + n) u(p) GROUP BY 1),
found AS (SELECT r, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM hits JOIN win USING (words, n) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (r) LEFT JOIN found USING (r)
"""
