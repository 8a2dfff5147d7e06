"""Helpers shared by the training-data operators: byte-level word tables, gapless numbers, bit filters, content keys."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import components
from ..sources.scratch import Tables, release, written

__all__ = ["Tables", "components", "release", "written"]
U = np.uint64
_BASE = U(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = U(pow(int(_BASE), -1, 1 << 64))
_BYTE_CODE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
_SHINGLE = np.random.default_rng(77).integers(1, 1 << 63, 64, dtype=np.uint64) | U(1)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes that belong to a word, after A-Z are lowered. UTF-8 bytes from 0x80 on are always part of one.
ALNUM = np.array([b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A for b in range(256)])
NONSPACE = np.array([b != 0x20 and not 0x09 <= b <= 0x0D for b in range(256)])

_ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(column):
    """Lower-case A-Z only; other letters stay as they are."""
    return F.translate(column, _ASCII_UPPER, _ASCII_UPPER.lower())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U(33))
    h = h * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grown(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(max(n, 1 << 20), base, np.uint64)
            steps[0] = U(1)
            _powers[i] = np.multiply.accumulate(steps)
    return _powers


def blocks(column: pa.Array, limit: int = 1 << 20):
    """Row ranges of a string column whose texts together hold at most `limit` bytes, or one row."""
    n = len(column)
    if not n:
        return
    ends = np.cumsum(np.asarray(pc.binary_length(column).fill_null(0), dtype=np.int64))
    lo = 0
    while lo < n:
        done = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield lo, hi
        lo = hi


class Words:
    """The words of a block of texts: for word i its row, its bytes [start, end) and a 64-bit hash; first[r] is the first word of row r."""

    def __init__(self, texts: pa.Array, member: np.ndarray):
        texts = pa.concat_arrays([texts.cast(pa.string()).fill_null("")])
        n = len(texts)
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
        raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        offsets -= offsets[0]
        self.n, self.offsets, self.bytes = n, offsets, _LOWER[raw]
        inside = member[self.bytes]
        size = len(raw)
        opens, closes = np.zeros(size, bool), np.zeros(size, bool)
        if size:
            opens[0], closes[-1] = True, True
            opens[1:], closes[:-1] = ~inside[:-1], ~inside[1:]
            inner = offsets[(offsets > 0) & (offsets < size)]
            opens[inner] = True
            closes[inner - 1] = True
        self.start, self.end = np.flatnonzero(inside & opens), np.flatnonzero(inside & closes) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        up, down = _grown(size + 1)
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(_BYTE_CODE[self.bytes] * up[:size], out=sums[1:])
        self.hash = mix((sums[self.end] - sums[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the windows of `width` words, and first[r] for them. A row of fewer words has its whole sequence as one window."""
        w, count = self.hash, self.count
        starts = np.where(count >= width, count - width + 1, np.minimum(count, 1))
        first = np.concatenate([[0], np.cumsum(starts)])
        padded = np.concatenate([w, np.zeros(width, np.uint64)])
        acc = np.zeros(len(w), np.uint64)
        for j in range(width):
            acc += padded[j : j + len(w)] * _SHINGLE[j]
        for r in np.flatnonzero((count > 0) & (count < width)):
            a = self.first[r]
            acc[a] = _short(w[a : a + count[r]])
        pick = np.arange(first[-1]) - np.repeat(first[:-1], starts) + np.repeat(self.first[:-1], starts)
        return mix(acc[pick]), first


def _short(w: np.ndarray) -> np.ndarray:
    return (np.sum(w * _SHINGLE[: len(w)], dtype=np.uint64, keepdims=True) + _SHINGLE[63:] * U(len(w)))[0]


def dense_position(df: DataFrame, group: list[str], order: str, out: str, buckets: int, tie: list[str] = ()) -> DataFrame:
    """Number the rows of each group from 0 without gaps, in the order (bucket of order, order, tie). A bucket is the first 32 bits of the
    value's MD5, as text, mod buckets; nulls come before all.

    A hot group is numbered in `buckets` parts: parts are counted first, and each starts at the sum of those before it.
    """
    spot = "__bucket"
    hashed = F.conv(F.substring(F.md5(F.col(order).cast("string").cast("binary")), 1, 8), 16, 10).cast("long")
    df = df.withColumn(spot, F.coalesce(hashed % buckets, F.lit(-1)).cast("int"))
    keys = [*group, spot]
    counts = df.groupBy(*keys).agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*group).orderBy(spot).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__from"))
    local = F.row_number().over(Window.partitionBy(*keys).orderBy(order, *tie)) - 1
    return df.withColumn("__local", local).join(starts, keys).withColumn(out, F.col("__from") + F.col("__local")).drop(spot, "__from", "__local", "__n")


class BitFilter:
    """A bit table of fixed size over 64-bit hashes: no false negatives, and its size never depends on the data.

    A full table lets everything pass, so whoever uses it must still join exactly; it only saves rows from a shuffle.
    """

    def __init__(self, words: np.ndarray, log_bits: int):
        self.words, self.log_bits = words, log_bits

    def hits(self, hashes: np.ndarray) -> np.ndarray:
        spot = hashes.view(np.uint64) >> U(64 - self.log_bits)
        return (self.words[spot >> U(6)] >> (spot & U(63))) & U(1) != 0


def bit_filter(hashes: DataFrame, column: str, log_bits: int = 23) -> BitFilter:
    """The BitFilter of a bigint column; at most 2 ** (log_bits - 6) rows reach the driver."""
    spot = F.shiftrightunsigned(F.col(column), 64 - log_bits)
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned({column}, {64 - log_bits}) & 63 as int))")
    rows = hashes.where(F.col(column).isNotNull()).groupBy(F.shiftrightunsigned(spot, 6).alias("w")).agg(F.bit_or(bit).alias("b")).toArrow()
    words = np.zeros(1 << (log_bits - 6), np.uint64)
    words[rows["w"].to_numpy()] = rows["b"].to_numpy().astype(np.int64).view(np.uint64)
    return BitFilter(words, log_bits)


def content_key(*columns: str) -> list[Column]:
    """(ka, kb): 128 bits that stand for a row's values in `columns`, nulls told from values."""
    marked = [x for c in columns for x in (F.col(c).isNull(), F.col(c))]
    return [F.xxhash64(*marked).alias("ka"), F.xxhash64(F.lit(7), *marked).alias("kb")]
