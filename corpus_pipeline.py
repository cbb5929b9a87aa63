"""The corpus pipeline: five stages, each over all that the one before it kept, each written as Parquet and read again.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents, and
any others that docs has, whatever their names. A null or empty text is a document without words: the classifier judges it,
it is nobody's copy, holds no benchmark, and is sampled as its cell is. Rows without an id stay in near_duplicates and are
written first by tokens. Repeated rows are judged alike: all stay or all go, but for mixture, where rows of one id share
their chance. Of ties, near_duplicates keeps the smallest id. Texts of any length are read whole. An empty table gives an
empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from framelake.llm import cotraining, decontaminate, jaccard_join, mixing, token_records
from framelake.llm.common import table, workspace


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts."""
    return cotraining.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, similarity 0.8 or more), the document of the smallest id."""
    return jaccard_join.dedup(docs, words=5, num=8, den=10)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of any benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to the raked source, language and topic weights."""
    return mixing.sample(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token records of all that is left, read back: doc_id, start, n_tokens, ids_crc32."""
    return token_records.token_output(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("tokens", tokens),
]

#: No stage is expressible in SQL as a whole: classifier, components, fitting and tokenizer are tested against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = workspace(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
