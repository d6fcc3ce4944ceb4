"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eonmap.llm import decontam, langid, linededup, mixing, omh
from eonmap.llm.common import materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Share of a text that no learned language explains, from which it is rejected.
BACKGROUND = 0.9


# All stages but the last return ``COLUMNS``; other columns of their input go. Rows with null or
# repeated ids are rows like others; an empty table gives an empty one.
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in a learned language stay, with the language found; null texts, texts without letters, and
    those that the background explains better than any language, go."""
    model = langid.fit(docs.where(~langid.held_out()))
    found = langid.predict(docs.select(*COLUMNS), model)
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("background") < BACKGROUND)).withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go from all documents but the first; what else a document holds stays, however
    little. Documents of which nothing is left but white space go. Null and empty texts stay as they are."""
    out = linededup.dedup_lines(docs.select(*COLUMNS))
    out = out.where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays: the one with the least id, null first; of
    repeated rows one. Null texts and texts without a word are classes of their own."""
    return omh.one_of_each(docs.select(*COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item of ``benchmark``, as it is or edited, go; null texts stay."""
    leaks = decontam.find_leaks(docs.withColumn("key", F.xxhash64(F.col("doc_id").cast("string"), "text")), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="key")
    keyed = docs.select(*COLUMNS).withColumn("key", F.xxhash64(F.col("doc_id").cast("string"), "text"))
    return keyed.join(leaks.select(F.col("doc_id").alias("key")).distinct(), "key", "left_anti").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes: doc_id, source, size in words, copies, taken words, target.
    Sources may be null; repeated rows are taken alike."""
    return mixing.mix(docs).where("copies > 0").select("doc_id", "source", "size", "copies", "taken", "target")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs


#: The first stage fits a model by expectation-maximisation, which SQL can't express.
ORACLE_SQL = None
