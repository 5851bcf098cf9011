"""From raw documents to packed training sequences: five stages, each over all that the one before kept.

1. quality: documents that the classifier, fitted on the table ``labels``, scores below 0.5 go.
2. lines: lines of 10 characters or more that two documents share stay in the smallest id only.
3. near copies: of documents linked by a Jaccard likeness of 0.8 or more over five-word shingles, one stays.
4. mixing: documents are repeated or left out so that sources come near their target weights.
5. packing: documents are tokenised, cut and packed into sequences of 1024 tokens; a row a piece with its ids.

All but the last return the columns of documents, and pass extra columns of any names through. Every stage takes null
texts, sources and ids, empty and very long texts, rows that repeat, and empty tables. No SQL expresses the classifier, so there is no oracle; the stages
are tested one by one against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyloom.llm.columns import unused
from tallyloom.llm.line_dedup import drop_shared_lines
from tallyloom.llm.mixing import mixed_documents
from tallyloom.llm.ngram_join import drop_near_copies
from tallyloom.llm.packing import pack_documents
from tallyloom.llm.quality import fit_quality, scored
from tallyloom.llm.scratch import written

ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows scored 0.5 or more. Null and empty texts are scored as texts of no words; rows without an id are scored too."""
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = unused(docs, "score")
    return scored(docs, model, score_col=score).where(F.col(score) >= 0.5).drop(score)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null texts become empty. Rows without an id keep all lines; rows that share an id count as one document. ``n_chars`` follows."""
    return drop_shared_lines(docs, min_chars=10, min_docs=2, counts=False)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least id of each group stays. Rows without an id or words stay; rows that share an id stay or go together."""
    return drop_near_copies(docs, n=5, threshold=(4, 5))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeat up to twice, or go. A null source is a source; rows are told apart even if they share an id or have none."""
    return mixed_documents(docs, weights=(5, 2, 1), share=1.5, cap=2)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset); ``ids`` are little-endian unsigned 32-bit ids. Null text: empty."""
    return pack_documents(docs, capacity=1024, end_id=2, keep_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("n-gram jaccard join", near_copies),
    ("source mixing", mixing),
    ("best-fit packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
