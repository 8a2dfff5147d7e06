"""Divergence of sources: which sources of a language use its words how differently, and by which words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, blocks, written

#: Documents of a language that a term needs, ranks of terms told, and the sum of a group's shares.
LEAST_DOCUMENTS, TERMS, WHOLE = 3, 200, 1_000_000_000
#: Cells (source, term) of a bucket of terms, sources of a tile, and bytes of text tokenized in one go.
CELLS, TILE, BLOCK = 200_000, 128, 4 << 20

#: For each byte what it becomes, and 0 for bytes that end a term.
_TABLE = np.zeros(256, np.uint8)
_TABLE[0x41:0x5B] = np.arange(0x61, 0x7B)
_TABLE[0x61:0x7B] = np.arange(0x61, 0x7B)
_TABLE[0x80:] = np.arange(0x80, 0x100)


def slices(texts: pa.Array) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' bytes with A-Z lowered, and for each term its first byte, the byte after its last one, and its text's number."""
    texts = pa.concat_arrays([texts.cast(pa.string()).fill_null("")])
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets -= offsets[0]
    lowered = _TABLE[raw]
    # a term ends at each text's end: texts are parted by a byte that is no term's
    gaps = np.insert(lowered, offsets[1:-1], 0) if len(texts) > 1 else lowered
    inside = np.concatenate([[False], gaps != 0, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    row = np.searchsorted(offsets[1:-1] + np.arange(1, len(texts)), start, side="right")
    return gaps.tobytes(), start, end, row


def grouped(data: bytes, start: np.ndarray, end: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The different slices, and for each slice its number among them. Slices of one xxHash are compared byte by byte with the first of
    them; where one differs, the groups of that hash are told by their bytes."""
    n = len(start)
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)), np.uint64, n)
    return verified(data, start, end, hashes)


def verified(data: bytes, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> tuple[list[str], np.ndarray]:
    _, first, code = np.unique(hashes, return_index=True, return_inverse=True)
    raw, length = np.frombuffer(data, np.uint8), end - start
    wrong = length != length[first][code]
    at = np.flatnonzero(~wrong)
    n = length[at]
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    differ = raw[np.repeat(start[at], n) + within] != raw[np.repeat(start[first][code[at]], n) + within]
    wrong[np.repeat(at, n)[differ]] = True
    terms = [data[a:b].decode() for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
    if wrong.any():
        new: dict[tuple[int, bytes], int] = {}
        for i in np.flatnonzero(wrong).tolist():
            slice_ = data[start[i] : end[i]]
            if (int(code[i]), slice_) not in new:
                new[int(code[i]), slice_] = len(terms)
                terms.append(slice_.decode())
            code[i] = new[int(code[i]), slice_]
    return terms, code


def cells(documents: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): how often and in how many rows each term occurs; a row with a null term for every (lang, source)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in blocks(batch.column("text"), BLOCK):
                part = batch.slice(lo, hi - lo)
                lang, source = (part.column(c).dictionary_encode() for c in ("lang", "source"))
                group, row_group = np.unique(lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy(), return_inverse=True)
                data, start, end, row = slices(part.column("text"))
                terms, code = grouped(data, start, end)
                pairs, n = np.unique(row * max(1, len(terms)) + code, return_counts=True)
                row, code = np.divmod(pairs, max(1, len(terms)))
                found, spot, docs = np.unique(row_group[row] * max(1, len(terms)) + code, return_inverse=True, return_counts=True)
                times = np.bincount(spot, n, len(found)).astype(np.int64)
                g, code = np.divmod(found, max(1, len(terms)))
                g = np.concatenate([g, np.arange(len(group))])
                names = pa.array(terms, pa.string()).take(pa.array(code))
                of_lang, of_source = (d.dictionary.take(pa.array(i)) for d, i in ((lang, group[g] // len(source.dictionary)), (source, group[g] % len(source.dictionary))))
                zeros = np.zeros(len(group), np.int64)
                yield pa.RecordBatch.from_arrays([of_lang, of_source, pa.concat_arrays([names, pa.nulls(len(group), pa.string())]), pa.array(np.concatenate([times, zeros])), pa.array(np.concatenate([docs.astype(np.int64), zeros]))], ["lang", "source", "term", "n", "docs"])

    rows = documents.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return rows.mapInArrow(run, "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(WHOLE * (count + 1) / whole), exact for whole up to 9e15: a long division three digits at a time."""
    out, rest = np.divmod(count + 1, whole)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + digit
    return out + 1


def surprise(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


class Rows:
    """Counts of some sources in a bucket of terms as a CSR matrix: the cells of source i lie from first[i] to first[i + 1]; p are their shares,
    zero[i] the share of a term that the source lacks."""

    def __init__(self, sources: int, source: np.ndarray, term: np.ndarray, n: np.ndarray, whole: np.ndarray):
        order = np.lexsort((term, source))
        self.source, self.term = source[order], term[order]
        self.first = np.searchsorted(self.source, np.arange(sources + 1))
        self.p, self.zero = share(n[order], whole[self.source]), share(np.zeros(sources, np.int64), whole)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """The sum of a value of each cell by source."""
        out, some = np.zeros(len(self.zero), np.int64), self.first[1:] > self.first[:-1]
        if some.any():
            out[some] = np.add.reduceat(values, self.first[:-1][some])
        return out


def divergences(rows: Rows, i: int, others: Rows, terms: int) -> np.ndarray:
    """For source i against each of others, the sum of `surprise` over the bucket's terms, less that of two sources without any of
    them; so terms that neither has count nothing here."""
    lo, hi = rows.first[i], rows.first[i + 1]
    own, p, zero = rows.term[lo:hi], rows.p[lo:hi], rows.zero[i]
    dense, has = np.full(terms, zero), np.zeros(terms, bool)
    dense[own], has[own] = p, True
    theirs = others.sums(surprise(dense[others.term], others.p))
    both = has[others.term]
    shared = others.sums(np.where(both, surprise(dense[others.term], others.zero[others.source]), 0))
    alone = np.zeros(len(others.zero), np.int64)
    if hi > lo:
        for a in range(0, len(alone), 64):
            alone[a : a + 64] = surprise(p[None, :], others.zero[a : a + 64, None]).sum(axis=1)
    union = (hi - lo) + np.diff(others.first) - others.sums(both.astype(np.int64))
    return theirs + alone - shared - union * surprise(zero, others.zero)


def _tile(key: tuple, cell: pa.Table, group: pa.Table) -> pa.Table:
    """Partial values of the pairs of two tiles of sources over a bucket of terms, and the terms of the first tile's sources if the tiles are one."""
    lang, _, a, b = (k.as_py() for k in key)
    kind = group.column("tile").to_numpy()
    names = group.column("source").combine_chunks()
    whole = group.column("whole").to_numpy() + group.column("kept").to_numpy()
    mine, theirs = np.flatnonzero(kind == a), np.flatnonzero(kind == b)
    out = []
    kept = int(group.column("kept")[0].as_py())
    term = cell.column("term").combine_chunks().dictionary_encode()
    code, terms = term.indices.to_numpy(), term.dictionary
    spot = pc.index_in(cell.column("source").combine_chunks(), names).to_numpy(zero_copy_only=False).astype(np.int64)
    n = cell.column("n").to_numpy()

    def rows(members: np.ndarray) -> Rows:
        local = np.full(len(names), -1)
        local[members] = np.arange(len(members))
        held = local[spot] >= 0 if len(spot) else np.zeros(0, bool)
        return Rows(len(members), local[spot[held]], code[held], n[held], whole[members])

    def told(source: pa.Array, part: str, item: pa.Array, value: np.ndarray) -> None:
        size = len(value)
        out.append(pa.table({"lang": pa.array([lang] * size, pa.string()), "source": source, "part": pa.array([part] * size, pa.string()), "item": item, "value": pa.array(value.astype(np.int64)), "kept": pa.array([kept] * size, pa.int64())}))

    if kept:
        left, right = rows(mine), rows(theirs)
        for i in range(len(mine)):
            told(pa.repeat(names[int(mine[i])], len(theirs)), "pair", names.take(pa.array(theirs)), divergences(left, i, right, len(terms)))
    else:
        for i in mine:
            told(pa.repeat(names[int(i)], len(theirs)), "pair", names.take(pa.array(theirs)), np.zeros(len(theirs)))
    if a == b and len(n):
        every = share(cell.column("total").to_numpy(), cell.column("lang_whole").to_numpy() + kept)
        p = share(n, whole[spot])
        value, over = surprise(p, every), p > every
        best = np.zeros(len(n), bool)
        for i in mine:  # a bucket's first ranks, with all of equal value
            own = np.flatnonzero(over & (spot == i))
            if len(own) > TERMS:
                own = own[value[own] >= np.partition(value[own], -TERMS)[-TERMS]]
            best[own] = True
        told(names.take(pa.array(spot[best])), "term", terms.take(pa.array(code[best])), value[best])
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64()), ("kept", pa.int64())])
    return pa.concat_tables(out).cast(schema) if out else schema.empty_table()


def audit(documents: DataFrame, cells_of_bucket: int = CELLS, sources_of_tile: int = TILE) -> DataFrame:
    """lang, source, part, item, value, rank: part `pair` for each ordered pair of sources of a language, part `term` for the terms that a source
    has more often than its language, the first TERMS ranks.

    Null text, lang and source are empty strings; repeated rows count each time; a source without terms has only pairs, a language's only
    source only terms; an empty table gives no rows. Other columns are left out. Counts are exact up to 9e15 tokens a language.

    Terms are counted in batches and then by Spark. A language's terms are dealt into buckets of about `cells_of_bucket` cells and its sources into tiles;
    a task has one bucket and two tiles as CSR matrices, and partial sums are added up. Only pairs of sources, which are the
    result, grow with the square of anything.
    """
    with Tables(documents.sparkSession) as tables:
        found = tables.write(cells(documents), "cells")
        of_term, one = Window.partitionBy("lang", "term"), F.row_number().over(Window.partitionBy("lang", "term").orderBy("source"))
        kept = found.where("term is not null").withColumn("lang_docs", F.sum("docs").over(of_term)).withColumn("total", F.sum("n").over(of_term)).withColumn("one", one)
        kept = tables.write(kept.where(F.col("lang_docs") >= LEAST_DOCUMENTS).select("lang", "source", "term", "n", "total", (F.col("one") == 1).cast("long").alias("one")), "kept")
        langs = kept.groupBy("lang").agg(F.sum("one").alias("kept"), F.sum("n").alias("lang_whole"), F.count("*").alias("size"))
        whole = kept.groupBy("lang", "source").agg(F.sum("n").alias("whole"))
        groups = found.where("term is null").select("lang", "source").join(whole, ["lang", "source"], "left")
        sizes = groups.groupBy("lang").agg(F.count("*").alias("sources")).join(langs, "lang", "left")
        zero = F.lit(0).cast("long")
        sizes = tables.write(sizes.select("lang", *[F.coalesce(c, zero).alias(c) for c in ("kept", "lang_whole")], F.greatest(F.lit(1), F.ceil(F.coalesce("size", zero) / cells_of_bucket)).cast("int").alias("buckets"), F.ceil(F.col("sources") / sources_of_tile).cast("int").alias("tiles")), "sizes")
        tile = F.pmod(F.xxhash64("source"), "tiles").cast("int").alias("tile")
        every = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
        groups = groups.join(sizes, "lang").select("lang", "source", F.coalesce("whole", zero).alias("whole"), "kept", "buckets", "tiles", tile)
        # a source's cells go to the pairs of tiles that hold its own first or second
        sides = F.expr("array_distinct(flatten(transform(sequence(0, tiles - 1), x -> array(named_struct('a', tile, 'b', x), named_struct('a', x, 'b', tile)))))")
        groups = groups.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1))).withColumn("side", F.explode(sides)).select("lang", "bucket", "side.*", "source", "whole", "kept", "tile")
        cell = kept.join(sizes, "lang").withColumn("tile", F.pmod(F.xxhash64("source"), "tiles").cast("int")).withColumn("side", F.explode(sides))
        cell = cell.select("lang", F.pmod(F.xxhash64("term"), "buckets").cast("int").alias("bucket"), "side.*", "source", "term", "n", "total", "lang_whole")
        keys = ["lang", "bucket", "a", "b"]
        parts = cell.groupBy(*keys).cogroup(groups.groupBy(*keys)).applyInArrow(_tile, "lang string, source string, part string, item string, value long, kept long")
        parts = tables.write(parts, "parts")

        ends = groups.select("lang", "source", (F.col("whole") + F.col("kept")).alias("size")).distinct()
        pairs = parts.where("part = 'pair' and source <> item").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), F.first("kept").alias("kept"))
        pairs = pairs.join(ends.withColumnRenamed("size", "x"), ["lang", "source"]).join(ends.select("lang", F.col("source").alias("item"), F.col("size").alias("y")), ["lang", "item"])
        p, q = (F.expr(f"1 + {WHOLE} div greatest({c}, 1)") for c in "xy")
        pairs = pairs.withColumn("p", p).withColumn("q", q).selectExpr("lang", "source", "'pair' as part", "item", "value + kept * ((p - q) * (p - q) div q) as value")
        best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        pairs = pairs.withColumn("rank", F.row_number().over(best))
        terms = parts.where("part = 'term'").select("lang", "source", "part", "item", "value").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= TERMS)
        return written(pairs.unionByName(terms), "audit")


ORACLE = f"""WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
t AS (SELECT rid, lang, source, unnest(w) AS term FROM d),
vocabulary AS (SELECT lang, term, count(*)::HUGEINT AS n FROM t GROUP BY lang, term HAVING count(DISTINCT rid) >= {LEAST_DOCUMENTS}),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS whole FROM vocabulary GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
counts AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t GROUP BY ALL),
grid AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS whole FROM groups g JOIN vocabulary k ON k.lang = g.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
shares AS (SELECT s.lang, s.source, s.term, s.n, 1 + ({WHOLE}::HUGEINT * (s.n + 1)) // (s.whole::HUGEINT + l.v) AS p FROM grid s JOIN langs l ON l.lang = s.lang),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value FROM shares a JOIN shares b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY a.lang, a.source, b.source
  UNION ALL SELECT a.lang, a.source, 'pair', b.source, 0 FROM groups a JOIN groups b ON b.lang = a.lang AND b.source <> a.source WHERE a.lang NOT IN (SELECT lang FROM langs)),
terms AS (SELECT s.lang, s.source, 'term' AS part, s.term AS item, s.p, 1 + ({WHOLE}::HUGEINT * (k.n + 1)) // (l.whole + l.v) AS q FROM shares s JOIN vocabulary k ON k.lang = s.lang AND k.term = s.term JOIN langs l ON l.lang = s.lang WHERE s.n > 0),
every AS (SELECT * FROM pairs UNION ALL SELECT lang, source, part, item, ((p - q) * (p - q) // q)::BIGINT FROM terms WHERE p > q)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM every) WHERE part = 'pair' OR rank <= {TERMS}"""
