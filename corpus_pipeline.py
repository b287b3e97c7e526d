"""Corpus pipeline: five stages over ``documents``, each an operator of ``vulnlake.llm``.

A stage takes (spark, docs, sf_dir), works on everything that its predecessor kept and returns a
DataFrame; it is written as Parquet into the shared checkpoint folder and read again as the next
one's docs.  All stages but the last return the columns of ``documents``; ``n_chars`` follows the
text.  Models learn from the table ``labels`` and the stage's own input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnlake.llm import decontaminate, jaccard_join, line_dedup, packing, toxicity
from vulnlake.llm.common import stage_table, table

#: Of a source's documents, which are far more than a host's pages: the share beyond which a line is boilerplate.
SOURCE_RATIO = 0.01


def counted(docs: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like``, with ``n_chars`` (if there) counted anew."""
    if "n_chars" in like.columns:
        docs = docs.withColumn("n_chars", F.length("text").cast(like.schema["n_chars"].dataType))
    return docs.select(*[f"`{c}`" for c in like.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network rejects go; all others stay as they are.  Null and empty
    texts are scored as texts without words; repeated rows share their score; a score of exactly
    0.5 is a rejection."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    return toxicity.keep_clean(docs, toxicity.fit(docs, labels))


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand on too many documents of a source are cut; every document stays, also one
    that becomes empty.  A null source is the source ''; null texts stay null; repeated rows count
    as documents of their own; a line at exactly the ratio stays."""
    return counted(line_dedup.line_dedup(docs, "source", "text", max_ratio=SOURCE_RATIO), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a similarity of 0.8 of 5-word shingles the document with the smallest
    id stays.  Rows of one id are one document; rows without an id, and documents without
    words, stay."""
    found = jaccard_join.jaccard_join(docs)
    gone = found.where(F.col("component_id") < F.col("doc_id")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[f"`{c}`" for c in docs.columns])


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of benchmark items are cut out of the texts; every document stays.  Null, empty and
    repeated rows stay rows; overlapping passages are cut as one."""
    return counted(decontaminate.remove(docs, table(spark, sf_dir, "benchmark")), docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as pieces of packed sequences of 1024 tokens, sources mixed in their shares.  A null
    or empty text is one end token; repeated rows are packed again."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate_lines),
    ("jaccard_join", drop_near_duplicates),
    ("decontaminate", cut_benchmark),
    ("packing", pack_sequences),
]

#: The network's verdicts can't be expressed in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last one."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
