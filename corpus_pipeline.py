"""A training corpus from raw documents: quality rules, language, near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandlake.llm.common import stored, table
from strandlake.llm.language_id import language_stage
from strandlake.llm.mixing import mixing_stage
from strandlake.llm.packing import packing_stage
from strandlake.llm.quality_rules import quality_stage
from strandlake.llm.simhash import near_copies_stage

STAGES = [
    ("quality rules", quality_stage),
    ("language", language_stage),
    ("simhash near-duplicates", near_copies_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: The language models, the fingerprints and the token ids have no form in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{name.replace(' ', '-')}")
    return docs
