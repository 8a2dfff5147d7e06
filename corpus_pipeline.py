"""The corpus pipeline: five stages over documents, each one's kept rows being the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbgraph.llm import decontaminate, language_id, near_dup, sentencepiece_codec, toxicity
from kerbgraph.llm.common import content_key, table, written
from kerbgraph.llm.queries import piece_model

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A text goes if less than this share of its n-grams belongs to the language found.
LEAST_LANGUAGE_SCORE = 0.2


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold; the classifier learns from the labels of documents here."""
    net = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~toxicity.held_out()))
    return toxicity.score(docs, net, list(COLUMNS)).where(F.col("score") < toxicity.THRESHOLD).select(*COLUMNS)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters whose language is told; a text without letters, or like none of the languages, goes."""
    filters = language_id.fit(docs.where(~language_id.held_out()))
    out = language_id.predict(docs, filters, list(COLUMNS))
    return out.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id, of repeated rows one.

    What the operator says of rows comes back as a table of the contents that don't stay as they are, so texts aren't shuffled
    unless that table is too large to be broadcast.
    """
    keyed = docs.select(*COLUMNS, *content_key("doc_id", "text"))
    choice = written(near_dup.content_choice(keyed.select("doc_id", "text", "ka", "kb"), "doc_id", ["ka", "kb"]), "choice")
    alone = keyed.join(choice, ["ka", "kb"], "left_anti")
    repeated = keyed.join(choice.where("n = 1"), ["ka", "kb"], "left_semi").dropDuplicates(["ka", "kb"])
    return alone.union(repeated).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs. Texts are shuffled only if contaminated ones are too many to be
    broadcast."""
    keyed = docs.select(*COLUMNS, *content_key("text"))
    found = decontaminate.find(keyed.select("text", "ka", "kb"), table(spark, sf_dir, "benchmark"), keep=["ka", "kb"])
    dirty = written(found.where("n_hit > 0").select("ka", "kb").distinct(), "dirty")
    return keyed.join(dirty, ["ka", "kb"], "left_anti").select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id with the number and digest of its tokens, and whether decoding gives the text back."""
    return sentencepiece_codec.round_trip(docs, piece_model())


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", keep_languages),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("sentencepiece", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage keeps is written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Trained networks and filters cannot be told in SQL; the tests run the whole pipeline and compare each stage that has an exact answer
#: with brute force, and the others with labels and a one-row-at-a-time version.
ORACLE_SQL = None
