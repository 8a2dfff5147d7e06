"""Language identification by n-gram filters that return, for an n-gram, a bit for each language that has it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, U, blocks

#: Bytes of an n-gram, hash functions of a filter, log2 of its slots.
N, HASHES, LOG_SLOTS = 4, 2, 18
#: Rows of a language that the filters learn from, at most.
SAMPLE_ROWS = 1500
#: An n-gram belongs to a language that has it this often, and this share as often as the language that has it most.
LEAST_COUNT, LEAST_SHARE = 3, 0.4

_FACTORS = (U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def letters(text: Column) -> Column:
    """The letters of a text (with their marks), a space for what lies between: digits, signs and punctuation of any script say
    nothing about the language."""
    return F.regexp_replace(text, r"[^\p{L}\p{M}]+", " ")


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The N-byte windows of every text of `letters` as integers, and first[r] for row r.

    A-Z are lowered; a text is set between spaces. Windows with more than one space aren't taken.
    """
    n = len(texts)
    _, offsets, data = pa.concat_arrays([texts.cast(pa.string())]).buffers()
    offsets = np.frombuffer(offsets, np.int32)[: n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets -= offsets[0]
    row = np.repeat(np.arange(n), np.diff(offsets))
    flat = np.full(len(raw) + 2 * n, 0x20, np.uint8)
    flat[np.arange(len(raw)) + 2 * row + 1] = _LOWER[raw]
    start = offsets + 2 * np.arange(n + 1)
    m = max(len(flat) - N + 1, 0)
    value, spaces = np.zeros(m, np.uint32), np.zeros(m, np.uint8)
    for k in range(N):
        part = flat[k : k + m]
        value |= part.astype(np.uint32) << np.uint32(8 * k)
        spaces += part == 0x20
    ok = spaces <= 1
    # windows over the end of a text hold the spaces of two texts
    first = np.searchsorted(np.flatnonzero(ok), start)
    return value[ok].astype(np.uint64), first


def slots(gram: np.ndarray) -> list[np.ndarray]:
    return [((gram + U(1)) * f) >> U(64 - LOG_SLOTS) for f in _FACTORS[:HASHES]]


@dataclass
class Filters:
    """masks[j][slot] has bit i set if language 64 j + i has an n-gram there; languages are ordered by rows, most first."""

    languages: list[str]
    masks: list[np.ndarray]

    def false_rates(self) -> np.ndarray:
        fill = [np.mean(self.masks[i // 64] >> U(i % 64) & U(1)) for i in range(len(self.languages))]
        return np.array(fill) ** HASHES

    def counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """For every text its number of n-grams, and for every language how many of them it is likely to have."""
        gram, first = grams(texts)
        at, n = slots(gram), np.diff(first)
        out = np.zeros((len(n), len(self.languages)))
        for j, mask in enumerate(self.masks):
            has = mask[at[0]]
            for a in at[1:]:
                has &= mask[a]
            for i in range(min(64, len(self.languages) - 64 * j)):
                total = np.concatenate([[0], np.cumsum((has >> U(i)).astype(np.uint8) & 1, dtype=np.int64)])
                out[:, 64 * j + i] = total[first[1:]] - total[first[:-1]]
        false = self.false_rates()
        return n, np.maximum((out - n[:, None] * false) / (1 - np.minimum(false, 0.999)), 0)


def fit(documents: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Filters:
    """Filters from rows (text, lang) with both given.

    A language with more rows than sample_rows is learnt from about that many, those with the least hash of their text; n-grams
    of whole texts are counted by Spark, and what comes to the driver is the filter, of fixed size.
    """
    known = documents.where("lang is not null and text is not null").select("text", "lang")
    rows = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not rows:
        return Filters([], [])
    languages = sorted(rows, key=lambda k: (-rows[k], k))
    spark = documents.sparkSession
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    about = spark.createDataFrame([(k, i, min(1.0, sample_rows / rows[k])) for i, k in enumerate(languages)], "lang string, i int, share double")
    sample = known.join(F.broadcast(about), "lang").where(place < F.col("share")).select("i", letters(F.col("text")).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, column = batch.column("i").to_numpy(), batch.column("text")
            for lo, hi in blocks(column):
                gram, first = grams(column.slice(lo, hi - lo))
                lang = np.repeat(which[lo:hi], np.diff(first)).astype(np.uint64)
                key, n = np.unique(lang << U(32) | gram, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array((key >> U(32)).astype(np.int32)), pa.array((key & U(0xFFFFFFFF)).astype(np.int64)), pa.array(n.astype(np.int64))], ["i", "gram", "n"])

    counts = sample.mapInArrow(count, "i int, gram long, n long").groupBy("i", "gram").agg(F.sum("n").alias("n"))

    def place_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which = batch.column("i").to_numpy()
            for at in slots(batch.column("gram").to_numpy().astype(np.uint64)):
                yield pa.RecordBatch.from_arrays([pa.array((which // 64).astype(np.int32)), pa.array(at.astype(np.int64)), pa.array((U(1) << (which % 64).astype(np.uint64)).view(np.int64))], ["part", "slot", "bits"])

    with Tables(spark) as tables:
        counts = tables.write(counts, "counts")
        # one row a language
        totals = counts.groupBy("i").agg(F.sum("n").alias("all"))
        often = counts.where(F.col("n") >= LEAST_COUNT).join(F.broadcast(totals), "i").withColumn("often", F.col("n") / F.col("all"))
        chosen = often.withColumn("most", F.max("often").over(Window.partitionBy("gram"))).where(F.col("often") >= LEAST_SHARE * F.col("most"))
        table = chosen.select("i", "gram").mapInArrow(place_bits, "part int, slot long, bits long").groupBy("part", "slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    masks = [np.zeros(1 << LOG_SLOTS, np.uint64) for _ in range(-(-len(languages) // 64))]
    part, slot, bits = (table[c].to_numpy() for c in ("part", "slot", "bits"))
    for j, mask in enumerate(masks):
        mask[slot[part == j]] = bits[part == j].astype(np.int64).view(np.uint64)
    return Filters(languages, masks)


def predict(documents: DataFrame, filters: Filters, keep: list[str]) -> DataFrame:
    """The columns in `keep` with lang_pred and score for every row; columns of these names are replaced.

    lang_pred: the language of the largest corrected count; of equal ones the one with more rows. `und` with score 0 if the
    text is null or has no letter, or nothing was learnt; a text with letters but no known n-gram gets the commonest language with
    score 0. score: the share of the text's n-grams that the language is likely to have. Texts are read whole.
    """
    keep = [k for k in keep if k not in ("lang_pred", "score")]
    shared = documents.sparkSession.sparkContext.broadcast(filters)
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    fields = [documents.schema[k] for k in keep]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "lang_pred string", "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.languages, "und"], object)
        for batch in batches:
            column = batch.column("__text")
            for lo, hi in blocks(column):
                texts = column.slice(lo, hi - lo)
                best, score = np.full(hi - lo, -1), np.zeros(hi - lo)
                if model.languages:
                    n, counts = model.counts(texts.fill_null(""))
                    best = counts.argmax(1)
                    score = np.minimum(counts[np.arange(hi - lo), best] / np.maximum(n, 1), 1.0)
                    best[~batch.column("__letter").slice(lo, hi - lo).to_numpy(zero_copy_only=False)] = -1
                rest = [batch.column(k).slice(lo, hi - lo) for k in keep]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(names[best].tolist(), pa.string()), pa.array(np.where(best < 0, 0.0, score))], [*keep, "lang_pred", "score"])

    return documents.select(*[f"`{k}`" for k in keep], letters(F.col("text")).alias("__text"), letter.alias("__letter")).mapInArrow(run, schema)


def held_out() -> F.Column:
    """Rows that nothing is learnt from: crc32 of the id's text mod 3 is 1. A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def identify(documents: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; repeated rows get equal results."""
    filters = fit(documents.where(~held_out()), sample_rows)
    return predict(documents.select("doc_id", "text", held_out().alias("held_out")), filters, ["doc_id", "held_out"])
