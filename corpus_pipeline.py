"""The corpus pipeline: toxicity, near duplicates, benchmark passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame; run() writes it as Parquet in the shared folder and reads
it again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalode.llm import decontamination, near_dedup, packing, pii, tokens, toxicity
from stratalode.llm.common import read, stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt on this stage's own input, holds for toxic go. Null and empty texts are
    scored as empty; a repeated row is judged as often as it is there, always alike."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by 5-word shingles at 0.8 or more, the document of the least doc_id stays. Null and empty
    texts stay. Rows of one doc_id are one document, whatever their texts: they stay or go together."""
    found = near_dedup.near_dedup(docs).where("not kept").select("doc_id").distinct()
    return docs.join(found, docs["doc_id"] == found["doc_id"], "left_anti")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; null and empty texts stay, repeated rows fare alike."""
    return decontamination.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets become their kinds in angle brackets, in texts of any length; null stays null, and no
    row goes."""
    return pii.redact(docs, pii.fit(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 1024 tokens: ids, their checksum, and the place of each piece. A null or empty
    text is its end token alone; a repeated row is packed as often as it is there."""
    return packing.pack(docs, packing.Packing(tokens.vocabulary("byte_bpe_50k.json"))).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", redact),
    ("packing", pack),
]
#: The classifiers, components and token ids can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
