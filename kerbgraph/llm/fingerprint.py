"""Document fingerprints from prefix polynomial hashes: any span's hash from two prefix values, common extensions by binary search."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

from .common import Tables, mix

U = np.uint64
#: Modulus 2**61 - 1, and the base: any number below it without a pattern.
P, BASE = (1 << 61) - 1, 0x0DA3_1C75_96EF_204B
#: Cuts of a fingerprint at most, code points that decide whether a place is a cut, and the least length of a common span that does not
#: reach from the beginning or to the end of both texts.
CUTS, CONTEXT, LEAST = 64, 8, 16
#: Code points hashed in one go; a longer text is hashed stretch by stretch.
STRETCH = 1 << 20
#: UTF-8 bytes of the texts of one range of the order by doc_id.
RANGE_BYTES = 16 << 20
_ENTRY = np.dtype([("pos", "<u4"), ("level", "u1"), ("value", "<u8")])
_M31, _M30, _P = U((1 << 31) - 1), U((1 << 30) - 1), U(P)


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> U(61))
    return np.where(x >= _P, x - _P, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo P, for numbers below P, in 64-bit arithmetic."""
    ah, al, bh, bl = a >> U(31), a & _M31, b >> U(31), b & _M31
    mid = ah * bl + al * bh
    return _reduced(((ah * bh) << U(1)) + (mid >> U(30)) + ((mid & _M30) << U(31)) + al * bl)


def minus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where(a >= b, a - b, a + (_P - b))


class Powers:
    """Powers of a number modulo P for exponents below 2**32, from two tables."""

    def __init__(self, base: int):
        self.low = self._table(base, STRETCH)
        self.high = self._table(pow(base, STRETCH, P), (1 << 32) // STRETCH)

    @staticmethod
    def _table(base: int, n: int) -> np.ndarray:
        out = np.ones(1, U)
        while len(out) < n:
            out = np.concatenate([out, times(out, np.full(1, pow(base, len(out), P), U))])
        return out[:n]

    def __call__(self, e: np.ndarray) -> np.ndarray:
        e = np.asarray(e, np.int64)
        return times(self.low[e % STRETCH], self.high[e // STRETCH])


_tables: list[Powers] = []


def powers() -> tuple[Powers, Powers]:
    """Of the base and of its inverse; made once a process."""
    if not _tables:
        _tables.extend([Powers(BASE), Powers(pow(BASE, -1, P))])
    return _tables[0], _tables[1]


class Prefixes:
    """Prefix array of at most STRETCH code points: value(i) is the sum of (c[j] + 1) * BASE**j over j < i, modulo P.

    So equal spans have equal hashes wherever they stand, and two different spans of n code points have equal ones with a chance
    of about n / 2**61.
    """

    def __init__(self, codes: np.ndarray):
        up = powers()[0].low[: len(codes)]
        c = codes.astype(U) + U(1)
        x = c * (up >> U(31))
        term = (x >> U(30)) + ((x & _M30) << U(31)) + c * (up & _M31)
        self.n = len(codes)
        self.lo, self.hi = np.zeros(self.n + 1, U), np.zeros(self.n + 1, U)
        np.cumsum(term & _M31, out=self.lo[1:])
        np.cumsum(term >> U(31), out=self.hi[1:])

    def value(self, i: np.ndarray) -> np.ndarray:
        hi = self.hi[i]
        return _reduced((hi >> U(30)) + ((hi & _M30) << U(31)) + self.lo[i])

    def span(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Hashes of the spans [i, j)."""
        return times(minus(self.value(j), self.value(i)), powers()[1](i))

    def extension(self, i: np.ndarray, other: Prefixes, j: np.ndarray) -> np.ndarray:
        """Length of the longest common span that begins at i here and at j there, by binary search."""
        i, j = np.asarray(i, np.int64), np.asarray(j, np.int64)
        lo, hi = np.zeros(len(i), np.int64), np.minimum(self.n - i, other.n - j)
        while (lo < hi).any():
            mid = (lo + hi + 1) // 2
            same = self.span(i, i + mid) == other.span(j, j + mid)
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


@pandas_udf(LongType())
def common_prefix(a: pd.Series, b: pd.Series) -> pd.Series:
    """Code points that two texts have in common from the beginning (null: empty); long texts stretch by stretch."""
    out = []
    for x, y in zip(a.fillna(""), b.fillna(""), strict=True):
        n = 0
        while n < min(len(x), len(y)):
            left, right = Prefixes(codes_of(x[n : n + STRETCH])), Prefixes(codes_of(y[n : n + STRETCH]))
            got = int(left.extension(np.zeros(1, np.int64), right, np.zeros(1, np.int64))[0])
            n += got
            if got < STRETCH:
                break
        out.append(n)
    return pd.Series(out, dtype="int64")


_context: list[np.ndarray] = []


def _levels(codes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """For each place after a code point, the trailing zero bits of a hash of the CONTEXT code points before it, fewer at a text's
    beginning. begins: for each code point, where its text (or what is known of it) begins. Here a prefix sum modulo 2**64 will do."""
    if not _context:
        _context.extend(np.multiply.accumulate(np.concatenate([np.ones(1, U), np.full(STRETCH, base % (1 << 64), U)])) for base in (BASE | 1, pow(BASE | 1, -1, 1 << 64)))
    up, inverse = _context
    sums = np.zeros(len(codes) + 1, U)
    np.cumsum((codes.astype(U) + U(1)) * up[: len(codes)], out=sums[1:])
    after = np.arange(1, len(codes) + 1)
    start = np.maximum(after - CONTEXT, begins)
    h = mix((sums[1:] - sums[start]) * inverse[start] + (after - start).astype(U))
    # the lowest set bit's number is the exponent of that bit as a double
    return np.clip(((h & (~h + U(1))).astype(np.float64).view(np.int64) >> 52) - 1023, 0, 40)


class Cuts:
    """Fingerprints of some texts, as arrays: for row r its length n[r], the hash total[r] of the whole, its level k[r], and between first[r] and
    first[r + 1] its cuts' places, levels and prefix values.

    A place is a cut of level l if the hash of the code points before it ends in l zero bits, so the same passage has the same cuts
    in every text. A text's level is the least that leaves at most CUTS cuts.
    """

    def __init__(self, texts: list[str]):
        rows = len(texts)
        self.n = np.array([len(t) for t in texts], np.int64)
        self.total, self.k = np.zeros(rows, U), np.zeros(rows, np.int64)
        parts: list[tuple[np.ndarray, ...]] = []
        lo = 0
        while lo < rows:
            if self.n[lo] > STRETCH:
                parts.append(self._long(lo, texts[lo]))
                lo += 1
                continue
            hi = lo + max(1, int(np.searchsorted(np.cumsum(self.n[lo:]), STRETCH, side="right")))
            parts.append(self._block(lo, hi, codes_of("".join(texts[lo:hi]))))
            lo = hi
        row, pos, level, value = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(4))
        self.pos, self.level, self.value = pos, level, value.astype(U)
        self.first = np.searchsorted(row, np.arange(rows + 1))

    def _block(self, lo: int, hi: int, codes: np.ndarray) -> tuple[np.ndarray, ...]:
        ends = np.cumsum(self.n[lo:hi])
        begins = ends - self.n[lo:hi]
        row = np.repeat(np.arange(hi - lo), self.n[lo:hi])
        level = _levels(codes, begins[row])
        counts = np.bincount(row * 41 + level, minlength=(hi - lo) * 41).reshape(-1, 41)
        above = counts[:, ::-1].cumsum(axis=1)[:, ::-1]
        k = np.where((above <= CUTS).any(axis=1), (above <= CUTS).argmax(axis=1), 41)
        at = np.flatnonzero(level >= k[row])
        sums = Prefixes(codes)
        r = row[at]
        self.k[lo:hi] = k
        self.total[lo:hi] = sums.span(begins, ends)
        return r + lo, at + 1 - begins[r], level[at], sums.span(begins[r], at + 1)

    def _long(self, r: int, text: str) -> tuple[np.ndarray, ...]:
        pos, level, value = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U)
        up, k, carry = powers()[0], 0, np.zeros(1, U)
        for lo in range(0, len(text), STRETCH - CONTEXT):
            back = min(lo, CONTEXT)
            codes = codes_of(text[lo - back : lo + STRETCH - CONTEXT])
            found = _levels(codes, np.zeros(len(codes), np.int64))[back:]
            at = np.flatnonzero(found >= k)
            sums, shift = Prefixes(codes), up(np.array([lo]))
            inner = sums.span(np.full(len(at), back), at + 1 + back)
            pos, level = np.concatenate([pos, at + 1 + lo]), np.concatenate([level, found[at]])
            value = np.concatenate([value, _reduced(times(inner, shift) + carry)])
            carry = _reduced(times(sums.span(np.array([back]), np.array([len(codes)])), shift) + carry)
            while (level >= k).sum() > CUTS:
                k += 1
            pos, level, value = (x[level >= k] for x in (pos, level, value))
        self.k[r], self.total[r] = k, carry[0]
        return np.full(len(pos), r), pos, level, value

    def strings(self) -> list[str]:
        """`n.k.total.cuts`: numbers in hexadecimal, cuts (place, level, value in 13 bytes) in Base64. At most about 1,200 characters."""
        entries = np.zeros(len(self.pos), _ENTRY)
        entries["pos"], entries["level"], entries["value"] = self.pos, self.level, self.value
        raw, f = entries.tobytes(), (self.first * _ENTRY.itemsize).tolist()
        return [f"{n:x}.{k:x}.{t:016x}.{base64.b64encode(raw[a:b]).decode()}" for n, k, t, a, b in zip(self.n.tolist(), self.k.tolist(), self.total.tolist(), f, f[1:], strict=False)]

    @classmethod
    def parse(cls, strings: list[str]) -> Cuts:
        out, fields = cls([]), [s.split(".") for s in strings]
        out.n, out.k = (np.array([int(x[i], 16) for x in fields], np.int64) for i in (0, 1))
        out.total = np.array([int(x[2], 16) for x in fields], U)
        raw = [base64.b64decode(x[3]) for x in fields]
        entries = np.frombuffer(b"".join(raw), _ENTRY)
        out.pos, out.level, out.value = entries["pos"].astype(np.int64), entries["level"].astype(np.int64), entries["value"].astype(U)
        out.first = np.concatenate([[0], np.cumsum([len(x) // _ENTRY.itemsize for x in raw])]).astype(np.int64)
        return out

    def take(self, rows: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the given rows, only cuts of at least the given levels, with 0 and the text's end: first, place, value."""
        n = self.first[rows + 1] - self.first[rows]
        at = np.repeat(self.first[rows] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        r = np.repeat(np.arange(len(rows)), n)
        keep = (self.level[at] >= level[r]) & (self.pos[at] < self.n[rows][r])
        at, r = at[keep], r[keep]
        every = np.arange(len(rows))
        row = np.concatenate([every, r, every])
        pos = np.concatenate([np.zeros(len(rows), np.int64), self.pos[at], self.n[rows]])
        value = np.concatenate([np.zeros(len(rows), U), self.value[at], self.total[rows]])
        order = np.lexsort((np.concatenate([np.zeros(len(rows)), np.ones(len(r)), np.full(len(rows), 2)]), pos, row))
        return np.searchsorted(row[order], np.arange(len(rows) + 1)), pos[order], value[order]


def _covered(a: tuple, b: tuple) -> np.ndarray:
    """For each pair, the code points of a within spans that b has too."""
    (first, pos, value), (other, opos, ovalue) = a, b
    pairs, inverse = len(first) - 1, powers()[1]

    def spans(f: np.ndarray, p: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i = np.setdiff1d(np.arange(len(p)), f[1:] - 1, assume_unique=True)
        pair = np.searchsorted(f, i, side="right") - 1
        length = p[i + 1] - p[i]
        return i, pair, mix(times(minus(v[i + 1], v[i]), inverse(p[i])) ^ mix(pair.astype(U) * U(0x9E3779B97F4A7C15) + length.astype(U)))

    i, pair, key = spans(first, pos, value)
    j, _, okey = spans(other, opos, ovalue)
    if not len(i) or not len(j):
        return np.zeros(pairs, np.int64)
    order = np.argsort(okey, kind="stable")
    spot = np.minimum(np.searchsorted(okey[order], key), len(order) - 1)
    ok = okey[order][spot] == key
    i, pair, j = i[ok], pair[ok], j[order][spot[ok]]
    # the longest common extension from each pair of cuts, over the cuts that follow both
    lo, hi = np.zeros(len(i), np.int64), np.minimum(first[pair + 1] - 1 - i, other[pair + 1] - 1 - j)
    from_i, from_j = inverse(pos[i]), inverse(opos[j])
    while (lo < hi).any():
        mid = (lo + hi + 1) // 2
        same = (pos[i + mid] - pos[i] == opos[j + mid] - opos[j]) & (times(minus(value[i + mid], value[i]), from_i) == times(minus(ovalue[j + mid], ovalue[j]), from_j))
        lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
    begins, ends = (pos[i] == 0) & (opos[j] == 0), (i + lo == first[pair + 1] - 1) & (j + lo == other[pair + 1] - 1)
    good = (lo > 0) & ((pos[i + lo] - pos[i] >= LEAST) | begins | ends)
    open_ = np.zeros(len(pos) + 1, np.int64)
    np.add.at(open_, i[good], 1)
    np.add.at(open_, (i + lo)[good], -1)
    inside = np.cumsum(open_)[: len(pos)] > 0
    length = np.diff(pos, append=0)
    length[first[1:] - 1] = 0
    return np.add.reduceat(np.where(inside, length, 0), first[:-1])


def likeness(a: Cuts, left: np.ndarray, b: Cuts, right: np.ndarray) -> np.ndarray:
    """For each pair of rows, the share of both texts' code points that lie in common spans: 1 for equal texts, 0 for texts without any.
    Two empty texts are equal; an empty one is unlike any other."""
    if not len(left):
        return np.zeros(0)
    level = np.maximum(a.k[left], b.k[right])
    x, y = a.take(left, level), b.take(right, level)
    both = a.n[left] + b.n[right]
    share = (_covered(x, y) + _covered(y, x)) / np.maximum(both, 1)
    return np.where((a.n[left] == b.n[right]) & (a.total[left] == b.total[right]), 1.0, share)


def edited(text: str, following: str) -> str:
    """The last half of the text replaced by as much of the beginning of the following one, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _range_of(key: np.ndarray, tie: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The range of a row: how many bounds lie below its key; rows of a key that is several bounds are dealt by their tie."""
    below, upto = np.searchsorted(bounds, key, side="left"), np.searchsorted(bounds, key, side="right")
    share = (tie.astype(np.float64) / 2.0**64 + 0.5) * (upto - below + 1)
    return below + np.clip(share.astype(np.int64), 0, upto - below)


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of a range, with the row that follows the range at its end, to rows of the result."""
    ids: list = []
    texts: list[str] = []
    tails: list[bool] = []

    def done() -> pa.RecordBatch:
        own = Cuts(texts)
        changed = [edited(a, b) for a, b in zip(texts, texts[1:], strict=False)]
        other = Cuts(changed)
        rows = np.array([i for i in range(len(changed)) if not tails[i]], np.int64)
        near, following = likeness(own, rows, other, rows), likeness(own, rows, own, rows + 1)
        names, changed_names = own.strings(), other.strings()
        columns = [pa.array([ids[i] for i in rows], pa.int64()), pa.array(own.n[rows]), pa.array([hashlib.sha256(changed[i].encode()).hexdigest() for i in rows], pa.string()), pa.array([names[i] for i in rows], pa.string()), pa.array([changed_names[i] for i in rows], pa.string()), pa.array(near), pa.array(following)]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    size = 0
    for batch in batches:
        for i, text, tail in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("tail").to_pylist(), strict=True):
            text = text.as_py()
            ids.append(i)
            texts.append(text)
            tails.append(tail)
            size += len(text)
            if size > STRETCH and len(texts) > 1:
                yield done()
                ids, texts, tails, size = ids[-1:], texts[-1:], tails[-1:], len(texts[-1])
    if len(texts) > 1:
        yield done()


def fingerprint_documents(documents: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The following document is the next in descending doc_id, after the last the first; rows of one doc_id stand by the descending
    xxhash64 of their texts, rows without a doc_id last. A lone row follows itself. Null texts are empty. Other columns are left out.

    The order is cut into ranges of about `range_bytes` (a doc_id of many rows into several), each of which also gets the first row of the
    next; so texts are shuffled once and no task sees more than its ranges. The bounds and first rows, one each for a range, are all
    that the driver holds.
    """
    spark, least = documents.sparkSession, -(1 << 63)
    text = F.coalesce("text", F.lit(""))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(least)).alias("key"), F.xxhash64(text).alias("tie"))
    with Tables(spark) as tables:
        keys = tables.write(rows.select("key", "tie", F.octet_length("text").alias("bytes")), "keys")
        ranges = max(1, (keys.agg(F.sum("bytes")).first()[0] or 0) // range_bytes)
        shares = [i / ranges for i in range(1, ranges)]
        bounds = np.array(sorted((keys.agg(F.percentile_approx("key", shares, max(10_000, 20 * ranges)).alias("b")).first()["b"] or []) if shares else []), np.int64)

        @pandas_udf("long")
        def of_range(key: pd.Series, tie: pd.Series) -> pd.Series:
            return pd.Series(_range_of(key.to_numpy(np.int64), tie.to_numpy(np.int64), bounds))

        heads = keys.groupBy(of_range("key", "tie").alias("range")).agg(F.max(F.struct("key", "tie")).alias("head")).collect()
    order = sorted((r["range"] for r in heads), reverse=True)
    before = dict(zip(order, order[-1:] + order[:-1], strict=True))
    head_of = {(r["head"]["key"], r["head"]["tie"]): before[r["range"]] for r in heads}
    head_keys = np.array(sorted({k for k, _ in head_of}), np.int64)

    @pandas_udf("array<struct<range:long,tail:boolean>>")
    def places(key: pd.Series, tie: pd.Series) -> pd.Series:
        k, t = key.to_numpy(np.int64), tie.to_numpy(np.int64)
        out = [[{"range": r, "tail": False}] for r in _range_of(k, t, bounds).tolist()]
        for i in np.flatnonzero(np.isin(k, head_keys)).tolist():
            if (to := head_of.get((int(k[i]), int(t[i])))) is not None:
                out[i].append({"range": to, "tail": True})
        return pd.Series(out)

    dealt = rows.withColumn("place", F.explode(places("key", "tie"))).select("doc_id", "text", "key", "tie", F.col("place.range").alias("range"), F.col("place.tail").alias("tail"))
    # between two ranges in one task, the row before is the tail of the first: it is never reported, so ranges don't mix
    sorted_rows = dealt.repartition("range").sortWithinPartitions(F.desc("range"), "tail", F.desc("key"), F.desc("tie"))
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return sorted_rows.select("doc_id", "text", "tail").mapInArrow(_report, schema)
