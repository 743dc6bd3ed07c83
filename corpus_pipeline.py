"""From raw documents to packed token sequences: five stages, each stored before the next reads it.

A stage is a function of the session, the documents its predecessor kept, and the folder of tables.  All but
the last return the columns of the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import near_dup, pii, quality_rules, work
from cohortlens.llm.langid import UNDETERMINED
from cohortlens.llm.queries import SURROGATE_KEY, identified_documents, packed_documents

#: Texts of fewer characters are too short to call them a mixture of languages.
SHORT = 200


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without letters, or between two languages, go.

    Where no document names its language nothing can be learnt, and all with letters stay.
    """
    work.small_batches(spark)
    into = work.unused(docs, "_language")
    found = identified_documents(docs, into, work.unused(docs, "_held_out"))
    is_short = F.length("text") < SHORT
    told = ~F.col(f"{into}.ambiguous") | (is_short & (F.col(f"{into}.lang_pred") != UNDETERMINED))
    return found.where(told).select(docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every quality rule."""
    return quality_rules.kept(docs, lang="lang" if "lang" in docs.columns else None)


def duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: shingles of five words, similarity 0.8 or more."""
    work.small_batches(spark)
    return near_dup.deduplicated(docs, near_dup.Settings())


def privacy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced and ``n_chars`` counted anew where texts changed."""
    n = work.unused(docs, "_n")
    done = pii.replaced(docs, SURROGATE_KEY, count=n)
    if "n_chars" not in docs.columns:
        return done.select(docs.columns)
    kind = docs.schema["n_chars"].dataType
    chars = F.when(F.col(n) > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars"))
    return done.withColumn("n_chars", chars).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their places in sequences of at most 2048 tokens."""
    work.small_batches(spark)
    return packed_documents(docs)


STAGES = [
    ("language", language),
    ("quality", quality),
    ("duplicates", duplicates),
    ("privacy", privacy),
    ("packing", packing),
]

# SQL expresses neither the classifier's features nor the tokenizer's merges: tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = work.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
