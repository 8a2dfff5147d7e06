"""Exact top-k search over binary codes by incremental multi-index hashing, in blocks of codes.

Codes are dealt into blocks by a hash, and the query set is asked of every block. A block holds an index per segment; a task looks up, for growing
radii, the values that differ from a query's in so many bits. Blocks bound a task's memory, and only k + 1 rows a query and block
leave it, whereas the looked-up values, which outnumber the codes, never become rows.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, U, written

#: Bits of a code, and how many neighbours are asked for.
BITS, K = 64, 10
#: A block has at most MOST codes; as long as it has LEAST or more, there are as many blocks as shuffle partitions.
LEAST, MOST = 1 << 12, 1 << 16
#: Most queries that go to a block at once, and those that a task handles together.
QUERY_BLOCK, TOGETHER = 1 << 14, 64


def code(vector: Column, bits: int = BITS) -> Column:
    """Bit i is set if number i of the vector is above 0. Missing numbers and those beyond `bits` count as 0."""
    powers = F.array(*[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(bits)])
    return F.aggregate(F.zip_with(vector, powers, lambda x, p: F.when((x > 0) & p.isNotNull() & ~F.isnan(x), p).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def segments(rows: int, bits: int = BITS) -> list[tuple[int, int]]:
    """(first bit, width) of the segments: about log2 of the rows wide, so that a bucket holds about one code."""
    n = max(1, min(bits, round(bits / max(math.log2(max(rows, 2)), 1))))
    edges = [bits * i // n for i in range(n + 1)]
    return list(zip(edges[:-1], [b - a for a, b in zip(edges[:-1], edges[1:], strict=True)], strict=True))


def _flips(width: int, radius: int) -> np.ndarray:
    return np.array([sum(1 << b for b in chosen) for chosen in combinations(range(width), radius)], np.int64)


def nearest(codes: np.ndarray, counts: np.ndarray, least: np.ndarray, queries: np.ndarray, k: int, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query's place, code's place, distance) and how many distances were computed: for every query the k + 1 nearest of distinct
    codes, by distance and `least`.

    counts: how many ids a code stands for. A code that was found in no segment j within radius r_j differs in r_j + 1 bits of
    each, so in the sum of r_j + 1 at least: all nearer ones are known. A query ends as soon as more than k ids lie within the
    distance covered this way, or every code has been found. Segments are looked up one by one, all of them at radius 0 first.
    A code is new in the first look-up that its segments' distances allow, so nothing is stored to tell; what is kept of a query
    are codes within the least distance known to hold more than k ids.
    """
    cuts = segments(len(codes), bits)
    masks = [U(((1 << width) - 1) << first) for first, width in cuts]
    order, starts = [], []
    for first, width in cuts:
        value = ((codes >> U(first)) & U((1 << width) - 1)).astype(np.int64)
        order.append(np.argsort(value, kind="stable"))
        starts.append(np.concatenate([[0], np.cumsum(np.bincount(value, minlength=1 << width))]))
    flips: dict[tuple[int, int], np.ndarray] = {}
    steps = [(radius, j) for radius in range(max(w for _, w in cuts) + 1) for j in range(len(cuts)) if cuts[j][1] >= radius]
    out, verified = [], 0
    for lo in range(0, len(queries), TOGETHER):
        q = queries[lo : lo + TOGETHER]
        ids_at = np.zeros((len(q), bits + 1), np.int64)
        seen, bound = np.zeros(len(q), np.int64), np.full(len(q), bits)
        looked, active, kept = [-1] * len(cuts), np.arange(len(q)), []
        for radius, j in steps:
            first, width = cuts[j]
            if (width, radius) not in flips:
                flips[width, radius] = _flips(width, radius)
            value = ((q[active] >> U(first)) & U((1 << width) - 1)).astype(np.int64)
            wanted = value[:, None] ^ flips[width, radius][None, :]
            start = starts[j][wanted].ravel()
            many = starts[j][wanted + 1].ravel() - start
            row = np.repeat(np.repeat(active, wanted.shape[1]), many)
            code = order[j][np.repeat(start - (np.cumsum(many) - many), many) + np.arange(len(row))]
            differ = q[row] ^ codes[code]
            fresh = np.ones(len(row), bool)
            for i, mask in enumerate(masks):
                if i != j:
                    fresh &= np.bitwise_count(differ & mask) > (radius if i < j else radius - 1)
            row, code = row[fresh], code[fresh]
            apart = np.bitwise_count(differ[fresh]).astype(np.int64)
            verified += len(row)
            np.add.at(ids_at, (row, apart), counts[code])
            seen += np.bincount(row, minlength=len(q))
            within = np.cumsum(ids_at, 1)
            bound = np.where(within[:, -1] > k, np.argmax(within > k, 1), bits)
            near = apart <= bound[row]
            kept.append((row[near], code[near], apart[near]))
            looked[j] = radius
            covered = sum(looked) + len(cuts) - 1
            active = active[(within[active, min(covered, bits)] <= k) & (seen[active] < len(codes))]
            if not len(active):
                break
        row, code, apart = (np.concatenate(x) for x in zip(*kept, strict=True))
        near = apart <= bound[row]
        row, code, apart = row[near], code[near], apart[near]
        sort = np.lexsort((least[code], apart, row))
        row, code, apart = row[sort], code[sort], apart[sort]
        top = np.arange(len(row)) - np.searchsorted(row, row) <= k
        out.append((row[top] + lo, code[top], apart[top]))
    places, near, apart = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
    return places, near, apart, verified


def search(codes: DataFrame, queries: DataFrame, k: int = K, bits: int = BITS) -> DataFrame:
    """(query_id, neighbour_id, distance, rank): for every row of queries (id, code) its k nearest rows of codes (id, code).

    Nearest: by Hamming distance, then id. A row isn't its own neighbour: rows with the query's id are left out. Fewer than k
    rows give fewer neighbours; null codes and ids have and are none; rows equal in id and code count once.

    Equal codes are one entry with its k + 1 least ids, which are all that can be asked for. Of a query's k + 1 nearest ids each
    belongs to one of its k + 1 nearest entries by distance and least id, so a block gives no more than these.
    """
    with Tables(codes.sparkSession) as tables:
        return written(_search(codes, queries, k, bits, tables), "neighbours")


def _search(codes: DataFrame, queries: DataFrame, k: int, bits: int, tables: Tables) -> DataFrame:
    spark = codes.sparkSession
    known = codes.where("id is not null and code is not null").select("id", "code").distinct()
    entries = tables.write(_lists(known, k), "entries")
    asked = tables.write(queries.where("id is not null and code is not null").select(F.col("id").alias("query_id"), F.col("code").alias("query")).distinct(), "asked")
    total, many = entries.count(), asked.count()
    blocks = max(1, math.ceil(total / MOST), min(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / LEAST)))
    query_blocks = max(1, math.ceil(many / QUERY_BLOCK))
    place = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = entries.select(place("code", blocks).alias("block"), every(query_blocks).alias("part"), "code", F.size("ids").cast("long").alias("n"), F.col("ids")[0].alias("least"))
    right = asked.select("query").distinct().select(every(blocks).alias("block"), place("query", query_blocks).alias("part"), "query")

    def run(block: pa.Table, wanted: pa.Table) -> pa.Table:
        code, least, query = (t[c].to_numpy() for t, c in ((block, "code"), (block, "least"), (wanted, "query")))
        if not len(code) or not len(query):
            at = near = distance = np.zeros(0, np.int64)
        else:
            at, near, distance, _ = nearest(code.view(np.uint64), block["n"].to_numpy(), least, query.view(np.uint64), k, bits)
        return pa.table([query[at], code[near], least[near], pa.array(distance.astype(np.int32))], ["query", "code", "least", "distance"])

    keys = ["block", "part"]
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "query long, code long, least long, distance int")
    close = near.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy("distance", "least"))).where(F.col("r") <= k + 1)
    each = close.join(entries, "code").select("query", "distance", F.explode("ids").alias("neighbour_id"))
    listed = asked.join(each, "query").where("query_id <> neighbour_id")
    ranked = listed.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "query").orderBy("distance", "neighbour_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "neighbour_id", "distance", "rank")


def _lists(known: DataFrame, k: int) -> DataFrame:
    """(code, ids): the k + 1 least ids of every code. They are cut down in parts first, so that a frequent code is no hot group."""
    part = F.pmod(F.xxhash64("id"), F.lit(64)).alias("part")
    for keys in (["code", "part"], ["code"]):
        known = known.select("code", "id", part) if "part" in keys else known
        known = known.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("id"))).where(F.col("r") <= k + 1).drop("r")
    return known.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def neighbours(embeddings: DataFrame, every: int = 100, k: int = K) -> DataFrame:
    """query_id, neighbour_id, distance, rank: the k nearest of all rows for every row whose vec_id is divisible by `every`."""
    with Tables(embeddings.sparkSession) as tables:
        codes = tables.write(embeddings.where("embedding is not null").select(F.col("vec_id").alias("id"), code(F.col("embedding")).alias("code")), "codes")
        return search(codes, codes.where(F.col("id") % every == 0), k)


_CODE = "list_sum(list_transform(range(0, 64), lambda i: CASE WHEN embedding[i + 1] > 0 AND NOT isnan(embedding[i + 1]) THEN 1::UBIGINT << i::UBIGINT ELSE 0::UBIGINT END))::UBIGINT"
ORACLE = f"""
WITH c AS (SELECT DISTINCT vec_id, {_CODE} AS code FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
p AS (SELECT q.vec_id AS query_id, c.vec_id AS neighbour_id, bit_count(xor(q.code, c.code))::INTEGER AS distance FROM c q, c WHERE q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id)::INTEGER AS rank FROM p)
FROM r WHERE rank <= {K}
"""
