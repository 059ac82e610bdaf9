"""A pipeline of training-data stages: language, quality, near-duplicates, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's documents. All but the
last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from terrazzo.llm import langid, mixing, near_copies, packing, quality_knn
from terrazzo.llm.queries import tokenizer_path
from terrazzo.llm.shared import remove, remove_at_end, shared_folder, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    return df.select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; without letters or like none of them: rejected."""
    return _documents(langid.identified(_documents(docs), langid.fitted(docs)).where("not lang_rejected"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose neighbours' labels say good quality."""
    docs = _documents(docs)
    found = quality_knn.scored(docs, quality_knn.fitted(docs, table(spark, sf_dir, "labels")))
    return _documents(found.where(f"quality_score >= {quality_knn.THRESHOLD}"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (SimHash links, and resemblance of 0.8 or more): the one with the least id."""
    return _documents(near_copies.deduplicated(_documents(docs), size=SHINGLE))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as its source's rate gives, in a global random order."""
    return _documents(mixing.mix_sources(_documents(docs)))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of full windows with their token ids."""
    return packing.pack(_documents(docs), tokenizer_path())


#: Words in a shingle where near-duplicates are a stage.
SHINGLE = 5

STAGES = [
    ("language", language),
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("mixture", mixture),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the table documents; what each returns is written to the shared folder and read again.

    A stage's files are deleted when the next one's are complete, the last one's when the Python process ends.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    base = f"{shared_folder(spark)}/terrazzo-pipeline/{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{base}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    remove_at_end(spark, base)
    return docs


#: Tokenizing, trained models and XXH64 have no form in SQL.
ORACLE_SQL = None
