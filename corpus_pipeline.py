"""The corpus pipeline: five stages over ``documents``, each by one operator of ``weft.llm``.

Every stage but the last takes documents and returns documents; the last returns packed
pieces. Between stages the rows are written as Parquet below the checkpoint folder.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import jaccard, mixing, packing, quality, secret_scan
from weft.llm.common import table
from weft.llm.queries import tokenizer_path
from weft.session import freeze


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without their failing lines."""
    return quality.filter_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word shingles (0.8 or more), the one of the smallest id.

    Rows repeated with that id are all kept, and so are rows without id or words.
    """
    groups = jaccard.similar(docs, n=5, num=4, den=5)
    gone = groups.filter("doc_id != component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked."""
    return secret_scan.mask_documents(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; of one cut off, the words it takes.

    In a table that the stage before wrote, a row is its file and its place there, and the table is not
    written again. Rows that come otherwise are numbered.
    """
    place = F.struct("_metadata.file_path", "_metadata.row_index")
    try:
        named = docs.groupBy(place.alias("place")).count().filter("count > 1").isEmpty()
    except AnalysisException:
        named = False
    return mixing.mixed_documents(docs, row=place if named else None)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("mixture", mixture),
    ("packed", packed),
]

# Shingle groups, masked spans and tokens are beyond SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to the ``documents`` of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = freeze(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
