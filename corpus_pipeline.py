"""Corpus pipeline: language ID, line dedup, n-gram Jaccard join, decontamination, source mixing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; ``run`` writes each result as Parquet in the shared folder and reads it
again for the next one, then drops the one before.  All but the last return the
columns of ``documents``.

Defined cases, for all stages: an empty table gives no rows; repeated rows stay
as they are, but for the n-gram join, which keeps those with the least id of
their group; other columns pass through.  A null or blank text: language ID
rejects it.  A null ``doc_id``: stays until source mixing, which leaves it out.
A null ``lang``: language ID fills it; a null ``source`` is a host and a source
of its own.  Very long texts are worked on whole, ties as the operators say.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm import decontam, langid, line_dedup, mixing, ngram_join
from folioforge.plans.lineage import cut, drop
from folioforge.plans.tables import table


def any_names(stage: Callable) -> Callable:
    """A stage that also takes columns whose names hold dots or backticks: they go through it under other names."""

    @wraps(stage)
    def run_renamed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        odd = {c: f"_odd_{i}" for i, c in enumerate(docs.columns) if "." in c or "`" in c}
        if not odd:
            return stage(spark, docs, sf_dir)
        out = stage(spark, docs.toDF(*(odd.get(c, c) for c in docs.columns)), sf_dir)
        back = {v: k for k, v in odd.items()}
        return out.toDF(*(back.get(c, c) for c in out.columns))

    return run_renamed


@any_names
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; ``und`` and hopeless scores go; the prediction fills a null ``lang`` and mends a wrong one."""
    return langid.keep_known(docs, langid.fit(docs))


@any_names
def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the boilerplate lines of their source; ``n_chars`` follows."""
    out = line_dedup.drop_boilerplate(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_n_dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


@any_names
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of near copies; rows of one id with different texts are told apart."""
    of_text = F.xxhash64("text")
    groups = ngram_join.jaccard_components(docs, mark=of_text)
    gone = groups.filter("component_id <> doc_id").select(F.col("doc_id").alias("_gone"), F.col("mark").alias("_text")).distinct()
    return docs.join(gone, (docs["doc_id"] == gone["_gone"]) & (of_text == gone["_text"]), "left_anti")


@any_names
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


@any_names
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is taken of each domain, language and source, with its epoch."""
    return mixing.mix(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", drop_lines),
    ("ngram_jaccard_join", near_duplicates),
    ("decontamination", decontaminate),
    ("source_mixing", mix_sources),
]

#: Language models and alignments can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
        if before is not None:
            drop(before)
        before = docs
    return docs
