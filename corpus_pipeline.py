"""Corpus cleaning in stages; each stage is written as Parquet and read again as the next one's documents.

Every stage but the last returns the columns of its input, whatever they are, and works on all rows it is given. Rows with a
null id are kept or dropped by their texts alone; null texts are empty; an empty table passes through.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from geolattice.llm.decontaminate import find_leaks
from geolattice.llm.line_dedup import line_dedup
from geolattice.llm.near_dups import near_duplicates
from geolattice.llm.packing import pack
from geolattice.llm.quality import learn, score_quality
from geolattice.session import scratch, written


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ranker, learnt from the labelled ones, predicts as good."""
    ranker = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs, ranker, carry=True).where("predicted = 1").select("row.*")


def shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that three or more documents share; n_chars follows the text."""
    made = line_dedup(docs).select("row.*", F.col("text").alias("_kept"))
    changed = {"text": F.col("_kept"), "n_chars": F.char_length("_kept").cast("long")}
    return made.select(*[changed.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near-duplicates, and of rows that repeat an id one; rows without an id stay."""
    first = near_duplicates(docs).where("doc_id = class_id").select(F.col("doc_id").alias("_first"))
    named = docs.where("doc_id is not null").join(first, F.col("doc_id") == F.col("_first")).select(*[docs[c] for c in docs.columns])
    return named.dropDuplicates(["doc_id"]).unionByName(docs.where("doc_id is null"))


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found. Rows are written with their number first, so both uses of it agree."""
    rows = written(docs.select(F.monotonically_increasing_id().alias("_row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")), "rows")
    leaks = find_leaks(rows.select("_row", "_doc.text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="_row")
    return rows.join(leaks.select(F.col("doc_id").alias("_leak")).distinct(), F.col("_row") == F.col("_leak"), "left_anti").select("_doc.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens, as pieces of the documents that are left, in the order of their ids."""
    return pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality classifier", good_documents), ("line dedup", shared_lines), ("MinHash near-dedup", one_of_each_group),
          ("benchmark decontamination", without_leaks), ("packing", packed)]
ORACLE_SQL = None   # learnt scores, signatures and token ids are beyond SQL; tests/llm checks each stage against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return made
        path = scratch(spark, "stage")
        made.write.parquet(path)
        docs = spark.read.parquet(path)
