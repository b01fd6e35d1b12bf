"""Corpus pipeline over ``documents``: each stage works on all that the one before kept.

Every stage keeps the columns of its input whatever they are (``text`` and ``n_chars`` follow when lines go), passes rows
with null or repeated ids, null and empty texts on unless its decision is about them, and gives an empty table for one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import decontaminate, line_dedup, ngram_join, pieces, toxicity
from weftline.session import cut_lineage, release

MODEL = "piece_bpe_32k.model"


def _carried(docs: DataFrame) -> DataFrame:
    """The rows as structs beside what the stages read, so that no name of theirs can clash with a column's."""
    return docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays under the threshold; trained on the labels of the rows at hand.

    Without labels of both kinds there is nothing to judge by, and all documents stay.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    if not model.learned:
        return docs
    return toxicity.with_score(_carried(docs), model).where(F.col("score") < toxicity.THRESHOLD).select("row.*")


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the runs of lines that occur earlier; a document of which no word is left goes."""
    cleaned = line_dedup.dedup_lines(docs).where("removed = 0 OR text RLIKE '[^ \\t\\r\\n]'")
    columns = [F.col("text") if c == "text" else F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col("row").getField(c).alias(c) for c in docs.columns]
    return cleaned.select(*columns)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id; of repeated rows one."""
    leads = ngram_join.jaccard_components(docs).where("leads").select(F.col("doc_id").alias("d"), F.col("text_key").alias("t"), "n_shingles").distinct()
    rows = _carried(docs).withColumn("key", F.xxhash64(F.concat("text", F.lit("\n"))))
    kept = rows.join(leads, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("t")))
    # Rows without words are no copies of each other.
    alone = F.when(F.col("n_shingles") == 0, F.monotonically_increasing_id())
    return kept.withColumn("alone", alone).dropDuplicates(["d", "t", "alone"]).select("row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    found = decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(F.col("doc_id").alias("d"), F.col("text_key").alias("t")).distinct()
    rows = _carried(docs).withColumn("key", F.xxhash64(F.concat(F.lower("text"), F.lit("\n"))))
    return rows.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("t")), "left_anti").select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of pieces, and digests of the ids and of the text decoded from them."""
    return pieces.digests(docs, public_tokenizers.path(MODEL))


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", remove_repeated_lines),
    ("ngram_jaccard", one_of_near_duplicates),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode),
]

#: A trained classifier and a tokenizer cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
        if before is not None:
            release(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
