"""A corpus pipeline over ``documents``: toxicity, exact dedup, near dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that the next one reads as its documents. Every
stage works on all rows it gets. All but the last return the columns of ``documents``; the last returns pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlens.llm import exact_dedup, mixing, packing, sketch_join, toxicity
from arborlens.llm.common import cut, read_table
from arborlens.llm.queries import MIX_BUDGET, MIX_TARGETS, tokenizer_files, topic


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose toxicity score is below one half; all labels are learnt from."""
    model = toxicity.learn(docs, read_table(spark, sf_dir, "labels"), held_out_fold=None)
    return toxicity.score_texts(docs.withColumn("_text", F.col("text")), model, text_col="_text", keep=docs.columns).where("score < 0.5").drop("score")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays."""
    return exact_dedup.drop_duplicates(docs, keep="min")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard index 0.8 or more) the smallest doc_id stays."""
    groups = sketch_join.near_duplicates(docs, width=5, num=80, den=100)
    gone = groups.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sample MIX_BUDGET of the tokens so that sources and languages come closer to even shares; no document is repeated."""
    mixed = mixing.sample_mix(docs.withColumn("_topic", topic(F.col("text"))), {("_topic" if d == "topic" else d): t for d, t in MIX_TARGETS.items()}, budget=MIX_BUDGET, whole=True)
    return mixed.where("copies > 0").select(docs.columns)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 ids; a row per piece."""
    return packing.pack(docs, **tokenizer_files(), capacity=2048, end_id=1).drop("ids")


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_exact_copies), ("ngram_jaccard_join", drop_near_copies), ("mixing", mix_sources), ("packing", pack_windows)]

#: Learnt scores and tokenisers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
