"""Documents to packed training sequences, stage by stage.

Each stage takes what its predecessor kept, as written and read again: toxic documents go, one of
each group of near duplicates stays, long repeated strings go from the texts, and the tokens of
what is left are packed into sequences.  All but the last keep the columns of documents.

Null and empty texts pass the first three stages (they score low, are near copies of nothing and hold no
repeats) and pack as the closing token alone.  Repeated rows are near copies of each other: the near-duplicate stage keeps one
row of each smallest doc_id.  Rows with a null doc_id are judged like others and stay.  Empty tables pass as empty ones, if
the labels leave a model to be fitted.  Columns beyond those of documents stay until packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phasewise.functions.lineage import cut
from phasewise.llm import op4_suffix_dedup, op6_packing, op8_minhash, op9_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic by a model fitted on the labelled ones among them."""
    model = op9_toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return op9_toxicity.without_toxic(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group linked at 0.8 on five-word shingles."""
    return op8_minhash.one_of_each(docs, words_each=5, percent=80)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without strings of 200 bytes that occur elsewhere; n_chars follows the text."""
    return op4_suffix_dedup.without_repeats(docs).withColumn(
        "n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 2048 tokens."""
    import public_tokenizers

    return op6_packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("minhash_near_dedup", near_dedup),
    ("suffix_array_dedup", suffix_dedup),
    ("best_fit_packing", packing),
]
#: The stages use models, hashes of shingles, suffixes and a tokenizer, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
