"""The corpus pipeline: quality, language, near copies, repeated passages, packing.

Every stage is a function of (spark, docs, sf_dir). Its result is written as Parquet under the
shared folder and read again as the next stage's ``docs``. Quality labels come from the table
``labels``; everything else comes from the documents that the stages before have kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tillspark.llm import language, nearcopies, packing, quality, repeats, simhash
from tillspark.llm.common import table
from tillspark.session import cut_lineage


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained views take for good and not toxic."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def in_a_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters that read as one of the languages learned from the others."""
    return language.keep_identified(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies.

    Documents are near copies by their SimHash fingerprints (the trie join of ``op8_simhash``)
    or by verified likeness (five-word shingles, 0.8); links of both kinds make the groups.
    """
    marks = simhash.marks(docs.where("doc_id is not null"))
    return nearcopies.keep_first(docs, marks=marks)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines and passages that an earlier document has."""
    return repeats.keep_first_passages(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids, packed into sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality", good),
    ("language", in_a_language),
    ("near_copies", one_of_each),
    ("repeats", without_repeats),
    ("packing", packed),
]

# Trained models and tokens are not expressible in SQL; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut_lineage(docs, f"pipeline-{name}")
    return docs
