"""From documents to packed training sequences, in stages that are each written and read again.

In every stage a table without rows gives none; columns beside doc_id, text, lang, source and n_chars go along as they are,
whatever their names are; rows that share a doc_id are rows of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.llm import jaccard, linededup, mixing, packing, quality
from candela.llm.common import fresh_path, read


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null and empty texts go; a null language is judged with the rare ones; repeated rows are judged alike."""
    return quality.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat earlier ones; those of which no word is left go.

    Of equal windows the first by doc_id (null last), the row's key and place stays. Null texts and texts without words of their own stay; rows
    alike in doc_id and text are one document.
    """
    out = linededup.dedup(docs).filter((F.col("n_removed") == 0) | F.col("text").rlike(linededup.SOME))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest doc_id (null last), of these the one with the least row key.

    Documents without words all stay.
    """
    return jaccard.keep_first(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them, in the schedule's order. A null source is a source; documents without words go."""
    return mixing.mixed_texts(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, with their token ids, and their places in sequences. A null text is the end id alone; repeated rows have places of their own."""
    return packing.best_fit(docs, with_ids=True)


STAGES = [("quality rules", good), ("line dedup", lines), ("n-gram Jaccard join", distinct), ("mixing", mixed), ("best-fit packing", packed)]
#: The join's components and the tokenizer's ids have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents. Each stage's rows are written as Parquet where spark.checkpoint.dir says."""
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = fresh_path(spark, f"stage-{k}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
