"""A corpus pipeline over the documents table: quality, lines, near copies, benchmark leaks, source mix.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all return the columns of docs, the
last one row for each copy that the mix takes of a document, with the copy's number in "copy". Texts are taken whole,
whatever their length; columns other than doc_id, text, source and n_chars pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stepspan.llm import decontamination, line_dedup, mixing, near_dedup, quality
from stepspan.llm.common import staged, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go, null and empty texts among them. Repeated rows are judged alike."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of alike lines the first by (doc_id, position) stays. Documents left without a word go; null texts stay. Equal rows are
    one document and are cut alike."""
    return line_dedup.drop_repeated_lines(docs)


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group stays, once; rows without a doc_id or a word are in no group and stay."""
    return near_dedup.keep_first(docs)


def leaks_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and empty texts and items match nothing."""
    return decontamination.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, perhaps never; a null source is one of its own."""
    mix = staged(mixing.mix_sources(docs), "mix-decisions")
    return mixing.draw(docs, mix).withColumnRenamed("__ss_copy", "copy")


STAGES = [("quality rules", quality_stage), ("line dedup", lines_stage), ("near copies", near_copies_stage), ("benchmark leaks", leaks_stage), ("source mix", mix_stage)]
#: Quality rules (a trained model) and benchmark leaks (edit distances) have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs, name.replace(" ", "-"))
    return docs
