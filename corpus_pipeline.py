"""Corpus pipeline: classify, remove near copies, mix, pack. Each stage works on all rows the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabloom.llm import ngram_join, packing, quality_model
from tabloom.llm.queries import mixed, tokenizer_path
from tabloom.session import scratch_path

#: Share of the kept documents' words that the mix may take; a document is drawn once at most.
MIX_SHARE = 0.9
ORACLE_SQL = None


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model expects to be of the highest grade: neither of low quality nor toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_model.fit_on(docs, quality_model.grades_of(labels), 3)
    return quality_model.score(docs, model).filter("keep").select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar ones, the one with the smallest id; documents without id stay."""
    found = ngram_join.jaccard_components(docs)
    copies = found.filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn to the weights of domains, languages and sources."""
    return mixed(docs, MIX_SHARE, 1).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in token sequences."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("quality classifier", classify), ("n-gram Jaccard join", drop_near_copies), ("source mix", mix), ("best-fit packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`; each one's rows are written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        place = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(place)
        docs = spark.read.parquet(place)
    return STAGES[-1][1](spark, docs, sf_dir)
