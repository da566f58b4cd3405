"""A pipeline from raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. Between stages the rows are
written as Parquet and read again. Rejected documents go, equal ones and near-duplicates leave one row, secrets are
masked, and what remains is packed.

Defined results: a null text counts as empty; such documents aren't toxic, equal each other as exact copies (the largest
doc_id stays, one with a null doc_id only if there is no other), have no near-duplicates and are packed as their closing
id; rows repeated with one doc_id are copies of each other if their texts are equal, and documents of their own if not;
of near-duplicates the least doc_id stays; texts are read whole, however long; columns that documents have besides are
kept by all stages but the last, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from attestry.llm import common, exact_dedup, near_dedup, packing, secrets, toxicity

STAGES = [
    ("toxicity", toxicity.stage),
    ("exact_dedup", exact_dedup.stage),
    ("near_dedup", near_dedup.stage),
    ("secrets", secrets.stage),
    ("packing", packing.stage),
]
#: Learned scores, near-duplicates and tokens are beyond SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what the last one returns."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return docs
