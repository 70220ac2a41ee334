"""Documents to token digests: toxic documents go, one document of each group of
near-duplicates stays, sources are mixed to their targets, texts are encoded.

Every stage takes nulls in any column, empty and very long texts, repeated rows, empty
tables and further columns of any name, and all but the last return the columns they
got. What each makes of such rows is said at the stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import mixing, pieces, shingles, toxicity
from tessera.llm.queries import tokenizer
from tessera.llm.store import keep


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects go. Texts without words have no toxic
    passage; a null text counts as empty. Repeated rows, and ties, stay or go alike.
    Without labels of both kinds all score alike, and an empty table stays empty."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the smallest doc_id:
    SimHash over five-word shingles finds candidates, whole shingle sets of a similarity
    of 0.8 or more link them. Null texts count as empty, and all texts without words are
    one group. Of the rows of one doc_id one stays; rows without a doc_id all stay."""
    return shingles.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are taken as often as their targets say: a row for each copy. A null source
    is a source; null and empty texts have no words, and come as often as whole passes
    over their source; repeated rows are taken one by one; an empty table stays empty."""
    return mixing.emit(docs).drop("mix_shard", "mix_place")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every text as token ids and back, as digests, a row for each row it gets. A null text
    counts as empty: begin and end only."""
    return pieces.encode_digests(docs, tokenizer())


STAGES = [("toxicity", drop_toxic), ("simhash near-dedup", drop_near_duplicates), ("mixing", mix_sources), ("sentencepiece", encode)]

#: SQL can express none of the stages; tests compare each with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = keep(docs, name.replace(" ", "-"))
    return docs
