"""From documents to packed training sequences.

Each stage is one operator of quirelake.llm over all that the stage before it kept, written as
Parquet and read again. All stages but the last return the columns of documents, and others that a table
has, under their own names.

Defined results, in the order of the stages: rows without text, or without a letter, go in the first one, so later ones see
neither; a row without an id is kept or dropped by its text like others, is no member of a class of near copies, and is
packed with a null id. Of equal texts the longest original stays, then the smallest id, then, of one id, the smallest text.
Of near copies the smallest id stays. Very long texts are read whole in every stage. Repeated rows are equal
texts: one stays. An empty table gives an empty result in every stage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.llm import decontaminate, exact_dedup, graph, language_id, ngram_join, packing, queries

#: SQL cannot express all stages; tests hold the rows of run() against a brute-force version.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no recognisable language go: without letters, or unlike all that was learned."""
    return language_id.known_language(docs, F.coalesce(queries.bucket("doc_id", 3) != 1, F.lit(True)))


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one stays."""
    return exact_dedup.drop_copies(docs).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest id stays."""
    return ngram_join.one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.drop_contaminated(docs, queries.table(spark, sf_dir, "benchmark"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed."""
    return packing.pack(docs, queries.tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("copies", copies),
    ("near_copies", near_copies),
    ("benchmark", benchmark),
    ("sequences", sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other; each is written to the shared folder and read again. The result's files stay there."""
    base = f"{graph.shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs, before = queries.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        if before:  # what this stage has read is not needed any more
            _remove(spark, before)
        before = f"{base}/{name}"
    return docs


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
