"""The corpus pipeline: documents in, token ids out; each stage applies one operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparsemill.llm import stages
from sparsemill.llm.common import drop_tables, load, materialise, scope

STAGES = [
    ("language ID", stages.language),
    ("SimHash near-dedup", stages.near_copies),
    ("substring dedup", stages.repeats),
    ("mixing to target weights", stages.mixture),
    ("byte-level BPE", stages.tokens),
]

#: SimHash components and classifiers have no SQL form: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what lies between two stages is a table in the shared folder, which goes when the next one is written."""
    docs, before = load(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with scope() as made:
            docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        drop_tables(spark, before + [t for t in made if t != docs._folder])  # what other runs have made stays
        before = [docs._folder]
    return STAGES[-1][1](spark, docs, sf_dir)
