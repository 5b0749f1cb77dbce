"""The training-data pipeline: documents through five operators in turn.

toxicity      documents scored 0.5 or more go
near copies   n-gram Jaccard join (five words, 0.8): the smallest doc_id of each group stays
decontaminate documents that hold benchmark passages (the contract's rule) go
mix           every document as often as the mix takes it
shard         16 shards of near equal bytes

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run``
writes each stage's result to the shared folder and rereads it for the next.
All but the last return the columns of ``documents``.  SQL can't express the
trained and sampled stages, so ORACLE_SQL is None and the tests check every
stage by brute force.  Empty tables pass through; nulls are handled as the
operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import decontaminate as dc
from quarry.llm import jaccard_join as jj
from quarry.llm import mixing, sharding
from quarry.llm import toxicity as tx
from quarry.llm.io import read, ship_package, staged

ORACLE_SQL = None


def toxicity(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5."""
    ship_package(spark)
    model = tx.train(docs, read(spark, sf_dir, "labels"))
    return tx.with_toxicity(docs, model, into="_toxicity").filter(F.col("_toxicity")["score"] < 0.5).select(*docs.columns)


def near_copies(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest doc_id (documents without words all stay)."""
    ship_package(spark)
    return jj.keep_one_per_component(docs, k=5, num=4, den=5)


def decontaminate(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    found = dc.find_contamination(docs, read(spark, sf_dir, "benchmark"), into="_contamination")
    return found.filter(~dc.is_contaminated(F.col("_contamination"))).select(*docs.columns)


def mix(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources by target weights, documents repeated as taken."""
    ship_package(spark)
    return mixing.mix(docs)


def shard(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every document of the mix."""
    ship_package(spark)
    return sharding.shard(docs)


STAGES = [("toxicity", toxicity), ("near_copies", near_copies), ("decontaminate", decontaminate),
          ("mix", mix), ("shard", shard)]


def run(spark, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
