"""Near-duplicates by MinHash signatures and a multi-index Hamming join.

A signature has LANES lanes of 16 bits. It is cut into chunks of CHUNK lanes. If two signatures differ in at most
(LANES / CHUNK) * (ERRORS + 1) - 1 lanes, then by the pigeonhole principle they differ in at most ERRORS lanes of some chunk. So each
chunk is stored under every choice of ERRORS lanes that may be wrong, and all such pairs of signatures share a key.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NONSPACE, Tables, U, Words, bit_filter, blocks, components, mix, written

SHINGLE, LANES, CHUNK, ERRORS = 5, 48, 4, 1
#: Signatures that differ in no more lanes than this always share a key.
GUARANTEED = LANES // CHUNK * (ERRORS + 1) - 1
#: Similar: 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Candidates with fewer equal lanes aren't looked at further: at similarity 0.75 a pair has fewer with a chance of 4.4e-8.
LEAST_LANES = 19
#: Sets of a large group that are compared in one go, about; parts in which rows of equal sets are counted, and rows for one more.
BLOCK, SALTS, ROWS_A_SALT = 512, 64, 1 << 20
#: Signatures of a key that one task compares with each other, about. Those of a key's blocks are sent once for each pair of blocks.
SIGNATURES = 4096
#: Sets of a block of a key's, and their shingles: a pair of blocks is compared in one go.
SETS, SHINGLES = 2048, 1 << 19
#: A key's lowest bits hold the number of its choice of lanes.
CHOICE_BITS = 6

_RNG = np.random.default_rng(4242)
_FACTOR = _RNG.integers(1, 1 << 63, LANES, dtype=np.uint64) | U(1)
_SHIFT = _RNG.integers(1, 1 << 63, LANES, dtype=np.uint64)
_CHOICES = [(c, [c * CHUNK + i for i in range(CHUNK) if i not in out], i) for c in range(LANES // CHUNK) for i, out in enumerate(combinations(range(CHUNK), ERRORS))]


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted set of shingle hashes of each text."""
    hashes, first = Words(texts, NONSPACE).shingles(SHINGLE)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        yield np.unique(hashes[a:b])


def set_hash(shingles: np.ndarray) -> tuple[np.uint64, np.uint64]:
    return np.sum(mix(shingles ^ U(0x1234567)), dtype=np.uint64), np.sum(mix(shingles ^ U(0x89ABCDE123)), dtype=np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The lowest of each lane's hashes, cut to 16 bits."""
    low = np.full(LANES, ~U(0))
    for lo in range(0, len(shingles), 4096):
        low = np.minimum(low, ((shingles[lo : lo + 4096, None] ^ _SHIFT) * _FACTOR).min(0))
    return (mix(low) >> U(48)).astype(np.uint16)


def signatures(df: DataFrame, keep: list[str]) -> DataFrame:
    """The columns in `keep` with n_shingles, set_a and set_b (together 128 bits of the set's hash) and sig (binary)."""
    schema = ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep), "n_shingles long, set_a long, set_b long, sig binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("__text")
            for lo, hi in blocks(column):
                n, a, b, sig = [], [], [], []
                for s in shingle_sets(column.slice(lo, hi - lo)):
                    n.append(len(s))
                    x, y = set_hash(s)
                    a.append(x)
                    b.append(y)
                    sig.append(signature(s).tobytes() if len(s) else b"")
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(lo, hi - lo) for k in keep), pa.array(n, pa.int64()), pa.array(np.array(a, np.uint64).view(np.int64)), pa.array(np.array(b, np.uint64).view(np.int64)), pa.array(sig, pa.binary())], [*keep, "n_shingles", "set_a", "set_b", "sig"])

    return df.select(*[f"`{k}`" for k in keep], F.col("text").alias("__text")).mapInArrow(run, schema)


def lanes(column: pa.Array) -> np.ndarray:
    """A column of signatures as a matrix, one row for each."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), LANES)


def chunk_keys(classes: DataFrame) -> DataFrame:
    """(key, id) for every chunk and every choice of lanes that may be wrong."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy()
            if not len(ids):
                continue
            sig = lanes(batch.column("sig")).astype(np.uint64)
            for lo in range(0, len(_CHOICES), 12):
                part = _CHOICES[lo : lo + 12]
                keys = np.empty((len(part), len(ids)), np.uint64)
                for j, (chunk, kept, drop) in enumerate(part):
                    key = np.full(len(ids), mix(np.array([chunk * 64 + drop + 1], np.uint64))[0])
                    for lane in kept:
                        key = mix(key ^ (sig[:, lane] + U(1)) * U(0x9E3779B97F4A7C15))
                    keys[j] = key >> U(CHOICE_BITS) << U(CHOICE_BITS) | U(lo + j)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.tile(ids, len(part)))], ["key", "id"])

    return classes.select("id", "sig").mapInArrow(run, "key long, id long")


def choice_of(key: Column) -> Column:
    """The number of the choice of lanes that a key is made of."""
    return key.bitwiseAND((1 << CHOICE_BITS) - 1)


def met_before(equal: np.ndarray, choice: int) -> np.ndarray:
    """Whether pairs of signatures, given as rows that tell which lanes are equal, share a key of an earlier choice of lanes."""
    chunk = _CHOICES[choice][0]
    right = equal[:, : chunk * CHUNK].reshape(len(equal), chunk, CHUNK).sum(2, dtype=np.uint8)
    out = (right >= CHUNK - ERRORS).any(1)
    for c, kept, _ in _CHOICES[:choice]:
        if c == chunk:
            out |= equal[:, kept].all(1)
    return out


def may_be_alike(n_a: np.ndarray, n_b: np.ndarray, equal: np.ndarray) -> np.ndarray:
    """False where two sets can't be similar by their sizes, or hardly by their equal lanes. Sizes broadcast."""
    sizes = 100 * np.minimum(n_a, n_b) >= PERCENT * np.maximum(n_a, n_b)
    return sizes & (equal.sum(-1, dtype=np.uint8) >= LEAST_LANES)


def likely(spokes: DataFrame, classes: DataFrame) -> DataFrame:
    """The spokes (g, id) whose classes may be alike."""
    side = lambda name, x: classes.select(F.col("id").alias(name), F.col("n").alias(f"n{x}"), F.col("sig").alias(f"sig{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 4096):
                part = batch.slice(lo, 4096)
                ok = may_be_alike(part["na"].to_numpy(), part["nb"].to_numpy(), lanes(part["siga"]) == lanes(part["sigb"]))
                yield part.select(["g", "id"]).filter(pa.array(ok))

    return spokes.join(side("g", "a"), "g").join(side("id", "b"), "id").select("g", "id", "na", "siga", "nb", "sigb").mapInArrow(run, "g long, id long")


def _groups(batches: Iterator[pa.RecordBatch], one: str = "g1", two: str = "g2") -> Iterator[pa.Table]:
    """Rows sorted by two columns, cut into one table a group."""
    pending: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        g1, g2 = batch[one].to_numpy(), batch[two].to_numpy()
        edges = [0, *(np.flatnonzero((g1[1:] != g1[:-1]) | (g2[1:] != g2[:-1])) + 1).tolist(), len(batch)]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            key = (g1[lo], g2[lo])
            if pending and key != last:
                yield pa.Table.from_batches(pending)
                pending = []
            last = key
            pending.append(batch.slice(lo, hi - lo))
    if pending:
        yield pa.Table.from_batches(pending)


def _sides(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of the rows of side 0 and of side 1 in a group, and their components. A row of side 2 is on both."""
    side, comp = group["side"].to_numpy(), group["comp"].to_numpy()
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    return left, right, comp[left], comp[right]


def promising(rows: DataFrame) -> DataFrame:
    """Rows (g1, g2, side, id, comp) to be compared of the groups of rows (key, block, left, right, outside, id, comp, n, sig): those on the
    left that may be alike with one on the right of another component, and these.

    A pair counts once: in the first key it shares by the order of choices of lanes, and of two rows outside the key's main component on the left is the one with the
    lesser id. What is left of a group is cut into blocks of SETS or SHINGLES; a row is in those pairs of blocks where it has a pair, once if on both sides.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, "key", "block"):
            group = group.sort_by("id").combine_chunks()
            key, block, comp, ids, outside = group["key"][0].as_py(), group["block"][0].as_py(), *(group[c].to_numpy() for c in ("comp", "id", "outside"))
            left, right = np.flatnonzero(group["left"].to_numpy()), np.flatnonzero(group["right"].to_numpy())
            n, sig = group["n"].to_numpy(), lanes(group["sig"].combine_chunks())
            found = [(left[:0], left[:0])]
            for lo in range(0, len(left), 16):
                part = left[lo : lo + 16]
                equal = sig[part][:, None] == sig[right][None]
                ok = may_be_alike(n[part][:, None], n[right][None], equal)
                ok &= (comp[part][:, None] != comp[right][None]) & (~outside[right][None] | (ids[part][:, None] < ids[right][None]))
                i, j = np.nonzero(ok)
                fresh = ~met_before(equal[i, j], key & (1 << CHOICE_BITS) - 1)
                found.append((part[i[fresh]], right[j[fresh]]))
            i, j = (np.concatenate(x) for x in zip(*found, strict=True))
            used, spots = np.unique(np.concatenate([i, j]), return_inverse=True)
            cut = np.maximum(np.arange(len(used)) // SETS, np.cumsum(n[used]) // SHINGLES)[spots]
            spot = cut[: len(i)] * (1 << 20) + cut[len(i) :]
            for place, at in enumerate(np.unique(spot).tolist()):
                here = spot == at
                sides = np.isin(used, i[here]) + 2 * np.isin(used, j[here])
                rows, side = used[sides > 0], np.array([0, 0, 1, 2], np.int32)[sides[sides > 0]]
                columns = [np.full(len(rows), key, np.int64), np.full(len(rows), block * (1 << 20) + place, np.int64), side, ids[rows], comp[rows]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["g1", "g2", "side", "id", "comp"])

    return rows.repartition("key", "block").sortWithinPartitions("key", "block").mapInArrow(run, "g1 long, g2 long, side int, id long, comp long")


def _pairs(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set in a with every set in b: columns of a membership matrix, some at a time."""
    out = np.zeros((len(a), len(b)), np.int32)
    size_a, size_b = [len(x) for x in a], [len(x) for x in b]
    va, vb = np.concatenate(a), np.concatenate(b)
    common = np.intersect1d(va, vb)
    if not len(common):
        return out
    sides = []
    for values, sizes in ((va, size_a), (vb, size_b)):
        at = np.minimum(np.searchsorted(common, values), len(common) - 1)
        ok = common[at] == values
        sides.append((at[ok], np.repeat(np.arange(len(sizes)), sizes)[ok]))
    step = min(8192, (1 << 22) // max(len(a), len(b)) + 1)
    for lo in range(0, len(common), step):
        dense = []
        for (at, row), n in zip(sides, (len(a), len(b)), strict=True):
            m = np.zeros((n, min(step, len(common) - lo)), np.float32)
            ok = (at >= lo) & (at < lo + step)
            m[row[ok], at[ok] - lo] = 1
            dense.append(m)
        out += (dense[0] @ dense[1].T).astype(np.int32)
    return out


def compare(rows: DataFrame) -> DataFrame:
    """Links (a, b) within the groups of rows (g1, g2, side, id, comp, shingles): similar sets of side 0 and side 1 (2: both) in different
    components. Of the links between one set and one component only the first is given, which connects them as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            left, right, a, b = _sides(group)
            if not len(left) or not len(right):
                continue
            ids, lists = group["id"].to_numpy(), group["shingles"].combine_chunks()
            flat, offsets = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
            sets = lambda places: [flat[offsets[i] : offsets[i + 1]] for i in places]
            both, size, found = _pairs(sets(left), sets(right)), np.diff(offsets), []
            for lo in range(0, len(left), 256):
                shared, n = both[lo : lo + 256].astype(np.int64), size[left[lo : lo + 256]]
                x, y = np.nonzero((100 * shared >= PERCENT * (n[:, None] + size[right][None] - shared)) & (a[lo : lo + 256, None] != b[None]))
                found.append((x + lo, y))
            i, j = (np.concatenate(x) for x in zip(*found, strict=True))
            _, first = np.unique(np.stack([i, b[j]]), axis=1, return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids[left[i[first]]]), pa.array(ids[right[j[first]]])], ["a", "b"])

    return rows.repartition("g1", "g2").sortWithinPartitions("g1", "g2").mapInArrow(run, "a long, b long")


def full_sets(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, shingles) of the classes in `wanted` (id, set_a, set_b, least). Texts of documents (__order, text) are read again: those
    of rows whose __order is some class's least pass a filter, and their sets are joined with the classes."""
    label = lambda c: F.xxhash64(c)
    needed = bit_filter(wanted.select(label("least").alias("h")), "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(needed.hits(batch.column("h").to_numpy())))
            for lo, hi in blocks(batch.column("text")):
                sets = list(shingle_sets(batch.column("text").slice(lo, hi - lo)))
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                a, b = (np.array(x, np.uint64).view(np.int64) for x in zip(*map(set_hash, sets), strict=True))
                yield pa.RecordBatch.from_arrays([batch.column("h").slice(lo, hi - lo), pa.array(a), pa.array(b), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets).view(np.int64)))], ["h", "set_a", "set_b", "shingles"])

    found = documents.select(label("__order").alias("h"), "text").mapInArrow(run, "h long, set_a long, set_b long, shingles array<long>")
    return found.join(wanted.select(label("least").alias("h"), "set_a", "set_b", "id"), ["h", "set_a", "set_b"]).select("id", "shingles").dropDuplicates(["id"])


def confirmed(pairs: DataFrame, classes: DataFrame, documents: DataFrame, tables: Tables) -> DataFrame:
    """Links among the groups of pairs (g1, g2, side, id, comp), by full sets."""
    wanted = tables.write(classes.join(pairs.select("id").distinct(), "id", "left_semi").select("id", "set_a", "set_b", "least"), "wanted")
    sets = tables.write(full_sets(documents, wanted), "sets")
    links = tables.write(compare(pairs.join(sets, "id")), "links")
    tables.drop("wanted", "sets")
    return links


def group(documents: DataFrame, keep: list[str], order: str) -> DataFrame:
    """The columns in `keep` (`order` among them) with n_shingles, component (the smallest `order` reachable) and first (this row is
    the one of its component that stays) for every row. Other columns are left out; of `keep`, those named as the new ones give way.

    1. Rows with equal sets form a class. 2. Classes that share a key are candidates: each key's classes are compared with one
    of them (the least by a hash), three with each other. Keys with the same members are one. 3. In keys whose classes still lie in several
    components, every class outside the largest component is compared with all of other components, in blocks: first in the keys of a quarter of the choices of lanes,
    then, with what that linked, in the others; a pair counts in the first key it shares. Candidates are
    first told by size and signature, and what is left by full sets. 4. Links make components. Sets that differ in more than
    GUARANTEED lanes may share no key: at similarity 0.75 the chance that a pair shares none is about 1e-7. Null texts and texts
    without words have an empty set and are linked with nothing. Of rows equal in `order` the earlier one stays; a row without
    `order` stays only if its whole component has none and it is the first of it.
    """
    keep = [k for k in keep if k not in ("n_shingles", "component", "first")]
    inner = [f"__k{i}" for i in range(len(keep))]
    documents = documents.select(*[F.col(f"`{k}`").alias(i) for k, i in zip(keep, inner, strict=True)], F.col(f"`{order}`").alias("__order"), "text")
    with Tables(documents.sparkSession) as tables:
        kept = tables.write(signatures(documents, [*inner, "__order"]).withColumn("row", F.monotonically_increasing_id()), "signatures")
        salts = max(SALTS, kept.count() // ROWS_A_SALT)
        real = kept.where("n_shingles > 0").withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)))
        parts = real.groupBy("set_a", "set_b", "salt").agg(F.min("row").alias("row"), F.min("__order").alias("least"), F.min("n_shingles").alias("n"), F.first("sig").alias("sig"))
        parts = tables.write(parts, "parts")
        classes = parts.groupBy("set_a", "set_b").agg(F.min("row").alias("id"), F.min("least").alias("least"), F.min("n").alias("n"), F.first("sig").alias("sig"))
        classes = tables.write(classes, "classes")
        held, spokes = _candidates(classes, tables)
        outer = hub_parts(tables.write(likely(spokes, classes), "likely"))
        hubs = outer.select("g1", "g2").distinct().select("g1", "g2", F.lit(0).alias("side"), F.col("g1").alias("id"))
        links = confirmed(outer.union(hubs).withColumn("comp", F.col("id")), classes, documents, tables)
        tables.drop("spokes", "likely")
        comps = components(links)
        early = choice_of(F.col("key")) < len(_CHOICES) // 4
        for turn in (early, ~early):
            more = _apart(held.where(turn), comps, classes, documents, tables)
            if more is not None:
                links = links.union(more)
                comps = components(links)

        of_class = classes.join(comps.select(F.col("node").alias("id"), "component"), "id", "left").select("set_a", "set_b", F.coalesce("component", "id").alias("comp"), "least")
        best = of_class.groupBy("comp").agg(F.min("least").alias("component"))
        firsts = parts.select("set_a", "set_b", "salt").join(of_class.join(best, "comp").drop("least"), ["set_a", "set_b"])
        placed = real.join(firsts, ["set_a", "set_b", "salt"]).select(*inner, "__order", "n_shingles", "row", "comp", "component")
        # one row stays: the first of those that hold the smallest order
        least = F.col("__order").eqNullSafe(F.col("component"))
        stays = placed.where(least).groupBy("comp").agg(F.min("row").alias("row")).select("row", F.lit(True).alias("first"))
        out = placed.join(stays, "row", "left").select(*inner, "n_shingles", "component", F.coalesce("first", F.lit(False)).alias("first"))
        alone = kept.where("n_shingles = 0").select(*inner, "n_shingles", F.col("__order").alias("component"), F.lit(True).alias("first"))
        out = out.union(alone).select(*[F.col(i).alias(k) for k, i in zip(keep, inner, strict=True)], "n_shingles", "component", "first")
        return written(out, "near-dup")


def _candidates(classes: DataFrame, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """held (key, id): the classes of every key that more than three share; spokes (g, id): classes to be compared with their key's
    least, of three also the other two with each other, so that what isn't held is compared whole. Keys with the same members, told by their number and 128 bits, count once,
    as the one of the earliest choice of lanes."""
    keys = tables.write(chunk_keys(classes), "keys")
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    both = tables.write(keys.join(shared, "key", "left_semi"), "shared")
    tables.drop("keys")
    mixed = F.struct(F.xxhash64("id").alias("h"), "id")
    facts = both.groupBy("key").agg(F.count("*").alias("n"), F.min(mixed)["id"].alias("low"), F.max(mixed)["id"].alias("high"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(2))).alias("y"))
    facts = tables.write(facts.groupBy("n", "x", "y").agg(F.min(F.struct(choice_of(F.col("key")).alias("choice"), "key", "low", "high")).alias("v")).select("n", "v.key", "v.low", "v.high"), "facts")
    held = tables.write(both.join(facts.where("n > 2"), "key"), "held")
    tables.drop("shared")
    stars = held.where("low <> id").select(F.col("low").alias("g"), "id")
    third = held.where("n = 3 and low <> id and high <> id").select(F.col("high").alias("g"), "id")
    pairs = facts.where("n = 2").select(F.col("low").alias("g"), F.col("high").alias("id"))
    spokes = tables.write(pairs.union(stars).union(third).distinct(), "spokes")
    return held.where("n > 3").select("key", "id"), spokes


def hub_parts(spokes: DataFrame) -> DataFrame:
    """Rows (g1, g2, side, id) of spokes (g, id): each hub's classes dealt into as many parts as it has blocks of BLOCK, so that what a
    task compares at once doesn't grow with the group. One row for BLOCK spokes at most tells of hubs of several parts."""
    large = spokes.groupBy("g").agg(F.ceil(F.count("*") / BLOCK).alias("parts")).where("parts > 1")
    part = F.pmod(F.xxhash64("id", F.lit(5)), F.coalesce("parts", F.lit(1)))
    return spokes.join(large, "g", "left").select(F.col("g").alias("g1"), part.alias("g2"), F.lit(1).alias("side"), "id")


def _apart(held: DataFrame, comps: DataFrame, classes: DataFrame, documents: DataFrame, tables: Tables) -> DataFrame | None:
    """Links between components that share a key of `held` (key, id), or None if there are none.

    A key's classes outside its largest component are compared with all of its classes, by signatures at first. Where these are more than
    SIGNATURES both are dealt into blocks, and every pair of blocks is a group. Rows made: a key's classes, in a larger key times its blocks of
    outsiders, so few once most outsiders are linked.
    """
    left = held.join(comps.select(F.col("node").alias("id"), "component"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("comp"))
    tallies = left.groupBy("key", "comp").agg(F.count("*").alias("m")).groupBy("key").agg(F.count("*").alias("comps"), F.sum("m").alias("n"), F.max(F.struct("m", "comp")).alias("top"))
    tallies = tables.write(tallies.where("comps > 1").select("key", "n", F.col("top.comp").alias("main"), (F.col("n") - F.col("top.m")).alias("apart")), "tallies")
    if tallies.isEmpty():
        return None
    dealt = left.join(tallies, "key")
    blocks_of = lambda c: F.ceil(F.col(c) / SIGNATURES).cast("int")
    place = F.xxhash64("id", F.lit(5))
    row = F.pmod(place, blocks_of("apart")).cast("int")
    column = F.pmod(place, blocks_of("n")).cast("int")
    outside, yes, no = F.col("comp") != F.col("main"), F.lit(True), F.lit(False)
    whole = dealt.where(F.col("n") <= SIGNATURES).select("key", F.lit(0).alias("i"), F.lit(0).alias("j"), outside.alias("left"), yes.alias("right"), outside.alias("outside"), "id", "comp")
    large = dealt.where(F.col("n") > SIGNATURES)
    outsiders = large.where(outside).select("key", row.alias("i"), F.explode(F.sequence(F.lit(0), blocks_of("n") - 1)).alias("j"), yes.alias("left"), no.alias("right"), yes.alias("outside"), "id", "comp")
    everyone = large.select("key", F.explode(F.sequence(F.lit(0), blocks_of("apart") - 1)).alias("i"), column.alias("j"), no.alias("left"), yes.alias("right"), outside.alias("outside"), "id", "comp")
    rows = whole.unionByName(outsiders).unionByName(everyone).withColumn("block", F.col("i").cast("long") * (1 << 20) + F.col("j"))
    pairs = tables.write(promising(rows.join(classes.select("id", "n", "sig"), "id").select("key", "block", "left", "right", "outside", "id", "comp", "n", "sig")), "promising")
    tables.drop("tallies")
    if pairs.isEmpty():
        return None
    more = confirmed(pairs, classes, documents, tables)
    tables.drop("promising")
    return None if more.isEmpty() else more


def content_choice(documents: DataFrame, order: str, keys: list[str]) -> DataFrame:
    """(*keys, n): for the rows of documents (order, text and keys, which stand for a row's content) how many of each content stay: 0,
    or 1 though it is there more than once. Contents that are there once and stay are left out."""
    marked = group(documents, [order, *keys], order)
    tally = marked.groupBy(*keys).agg(F.count("*").alias("rows"), F.max(F.col("first").cast("int")).alias("n"))
    return tally.where("n = 0 or rows > 1").select(*keys, "n")


def components_of(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of documents; rows that share a doc_id share its kept. A row without
    a doc_id isn't kept beside others, and is if linked with nothing that has one."""
    out = group(documents.select("doc_id", "text"), ["doc_id"], "doc_id")
    return out.select("doc_id", "n_shingles", F.col("component").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("component")).alias("kept"))
