"""The corpus pipeline: quality rules, near-dedup, decontamination, mixing and
sharding, each over all its predecessor kept, through a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import base, decontam, mixing, quality, sharding, simhash

STAGES = [
    ("quality rules", quality.stage),
    ("simhash near-dedup", simhash.stage),
    ("benchmark decontamination", decontam.stage),
    ("mixing", mixing.stage),
    ("sharding", sharding.stage),
]

#: SimHash bits and anchors have no SQL form; the tests hold the rows against
#: a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = base.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with base.scratch() as made:  # what the stage alone needed goes once its rows are stored
            docs = base.stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
            made.remove(docs)
        if last is not None:
            base.discard(last)
        last = docs
    # the last table stays: shards that need no rewriting are its files
    return STAGES[-1][1](spark, docs, sf_dir)
