"""Corpus pipeline: stages over ``documents``, each written as Parquet and read again for the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelab.llm.boilerplate import drop_site_lines
from tablelab.llm.decontamination import decontaminate
from tablelab.llm.minmax import near_duplicates
from tablelab.llm.mixing import mix
from tablelab.llm.toxicity import fit_toxicity, score_toxicity
from tablelab.session import checkpointed

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


#: Score from which a document counts as toxic.
TOXIC = 0.7
#: Share of the texts of a source above which a line is dropped, and the number of texts that must hold it at least. Sources
#: are far larger than hosts, so the share is far below the operator's own.
LINE_RATIO, LINE_LEAST = 0.001, 5


def _numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with numbers for column names, so that none clashes with a name an operator adds, and the number of each column."""
    numbers = {c: f"__{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*numbers.values()), numbers


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored toxic go; the model is learned from all labelled documents, up to the operator's bound."""
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    plain, numbers = _numbered(docs)
    scored = score_toxicity(plain, model, plain.columns, numbers["text"])
    return scored.filter(F.col("score") < TOXIC).select(*plain.columns).toDF(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that over ``LINE_RATIO`` of the texts of their source and ``LINE_LEAST`` hold are taken out, and n_chars follows; every document stays.

    Copies of one text count once, or the lines of a text that is copied often would go from all its copies.
    """
    plain, numbers = _numbered(docs)
    text, size = numbers["text"], numbers["n_chars"]
    clean = drop_site_lines(plain, F.col(numbers["source"]), text, LINE_RATIO, LINE_LEAST, copies=False)
    changed = clean.withColumn(size, F.when(F.col("n_dropped") > 0, F.char_length(text).cast(plain.schema[size].dataType)).otherwise(F.col(size)))
    return changed.select(*plain.columns).toDF(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity of 0.8 or more) stays, the one with the smallest doc_id.

    Rows of one doc_id stay or go together; rows without a doc_id stay where no row with one is near.
    """
    stays = near_duplicates(docs).filter("kept").select("doc_id").distinct()
    return docs.join(stays, docs["doc_id"].eqNullSafe(stays["doc_id"]), "left_semi")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    marked = decontaminate(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    leaks = marked.filter("contaminated").select("doc_id").distinct()
    return docs.join(leaks, docs["doc_id"].eqNullSafe(leaks["doc_id"]), "left_anti")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn at rates that bring languages and qualities to tempered target weights.

    The columns rate, copies and domain are added; documents drawn no time are left out, the others stand once, with
    the number of their copies. Rows that share a doc_id share the largest rate.
    """
    quality = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality IN (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    labelled = docs.select("doc_id", "lang").join(quality, "doc_id").select("doc_id", F.concat_ws("_", "lang", "quality").alias("domain"))
    rated = mix(docs, labelled).groupBy("id").agg(F.max(F.struct("rate", "copies", "domain")).alias("best"))
    plain, numbers = _numbered(docs)
    drawn = plain.join(rated.filter("best.copies > 0"), F.col(numbers["doc_id"]).eqNullSafe(F.col("id")))
    return drawn.select(*plain.columns, "best.rate", "best.copies", "best.domain").toDF(*docs.columns, "rate", "copies", "domain")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]
#: The models of the toxicity and mixing stages have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return docs
