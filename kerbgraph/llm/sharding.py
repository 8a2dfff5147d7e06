"""Sharding by rendezvous hashing of record keys over weighted shards, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dense_position

#: Hexadecimal digits of MD5 taken for a draw: 52 bits, so that a draw is exact as a double.
DIGITS = 13


def draw(key: Column, shard: int) -> Column:
    """A number in (0, 1) that only the key and the shard's own number decide."""
    digest = F.md5(F.concat_ws("/", key, F.lit(str(shard))).cast("binary"))
    return (F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(16**DIGITS))


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard with the highest score weight / -ln(draw); of equal scores the lower number.

    Each shard's score depends on the key and that shard alone. So a new shard takes records only into itself, a removed
    one gives up only its own, and a shard's share of the keys is its share of the weights. A weight of 0 closes a shard.
    """
    if not weights or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("weights must not be negative, and one must be above 0")
    scores = [F.struct((F.lit(float(w)) / -F.log(draw(key, i))).alias("score"), F.lit(-i).alias("i")) for i, w in enumerate(weights)]
    return -(F.greatest(*scores) if len(scores) > 1 else scores[0])["i"]


def assign(df: DataFrame, key: str, weights: Sequence[float], *, shard: str = "shard") -> DataFrame:
    """df with its shard. Rows of one key share a shard; a null key is a key of its own."""
    return df.withColumn(shard, shard_of(F.coalesce(F.col(key).cast("string"), F.lit("null")), weights).cast("int"))


def number(df: DataFrame, key: str, *, shard: str = "shard", slot: str = "slot", tie: Sequence[str] = (), buckets: int = 64) -> DataFrame:
    """df with each row's place in its shard, from 0 without gaps.

    Order: a hash of the key in `buckets` buckets, key, tie; null keys come first. A shard is numbered in `buckets` parts, whose starts are sums
    of counts, so no task sees a whole shard. Rows equal in key and tie may swap places.
    """
    return dense_position(df, [shard], key, slot, buckets, list(tie))


def write(df: DataFrame, path: str, *, shard: str = "shard") -> None:
    """One folder of Parquet files per shard."""
    df.write.partitionBy(shard).parquet(path)


def shard_documents(documents: DataFrame, shards: int = 8, weights: Sequence[float] | None = None, buckets: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row; the law is `key`.

    size: UTF-8 bytes of the text (null: none) plus 1. text_crc32: of the text's UTF-8, null as the empty text.
    grown_shard: the shard if there were one more, of mean weight. Equal texts have equal text_crc32 and are not kept
    together: doc_id alone decides. Repeated rows share the shard and have different slots; a null doc_id is one key. A shard is
    numbered in at least 64 parts, and in one more for each million rows.
    """
    buckets = max(64, documents.count() >> 20) if buckets is None else buckets
    weights = list(weights) if weights is not None else [1.0] * shards
    text = F.coalesce("text", F.lit("")).cast("binary")
    df = documents.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"), F.lit("key").alias("law"))
    df = assign(df, "doc_id", weights)
    df = assign(df, "doc_id", [*weights, sum(weights) / len(weights)], shard="grown_shard")
    df = number(df, "doc_id", tie=("text_crc32", "size"), buckets=buckets)
    return df.select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


def _crc_entry(byte: int) -> int:
    """What a byte does to CRC-32 (reflected polynomial 0xEDB88320)."""
    for _ in range(8):
        byte = byte >> 1 ^ (0xEDB88320 if byte & 1 else 0)
    return byte


def crc_table() -> str:
    """A DuckDB list of what each byte does."""
    return "[" + ", ".join(str(_crc_entry(i)) for i in range(256)) + "]"


def _sized() -> str:
    return f"""sized AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT)),
      lambda c, b: xor(c >> 8, ({crc_table()})[xor(c & 255, b) + 1])), 4294967295) AS text_crc32 FROM documents)"""


def oracle(shards: int = 8, buckets: int = 64) -> str:
    def best(n: int) -> str:
        scores = ", ".join(f"{{'s': 1.0::DOUBLE / -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || '/{i}'), 1, {DIGITS}))::BIGINT::DOUBLE + 0.5) / {16**DIGITS}.0::DOUBLE), 'i': {-i}}}" for i in range(n))
        return f"(-greatest({scores}).i)::INTEGER"

    return f"""WITH {_sized()},
dealt AS (SELECT *, {best(shards)} AS shard, {best(shards + 1)} AS grown_shard FROM sized)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY coalesce(('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % {buckets}, -1), doc_id, text_crc32, size) - 1 AS slot, grown_shard FROM dealt"""
