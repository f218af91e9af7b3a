"""A corpus pipeline over `documents`: each stage works on all that its predecessor kept.

STAGES are (name, function) pairs; a function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs. All but the last return the columns of `documents`, whatever they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terravane.llm.common import Scratch, mark, prepare, release
from terravane.llm.decontaminate import without_contamination
from terravane.llm.language_id import known_languages, train_languages
from terravane.llm.line_dedup import without_repeated_lines
from terravane.llm.ngram_join import one_of_each
from terravane.llm.packing import pack
from terravane.llm.token_count import token_counts

#: Languages that the language stage keeps (None: all that it learns from the labelled rows), and the score it asks for.
LANGUAGES: list[str] | None = None
LEAST = 0.35


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn the languages from the rows outside the held-out fold; documents that are in none of LANGUAGES by a score of LEAST go.

    Null, empty and letterless texts are in none. Where no row has a language to learn from, nothing else goes.
    """
    prepare(spark)
    return known_languages(docs, train_languages(docs), LANGUAGES, LEAST)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line matches go; a document goes if that leaves it without any word."""
    return without_repeated_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that similar sets of five-word shingles link, the one with the smallest id stays."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of ten consecutive benchmark words, or a whole shorter item, go."""
    return without_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length buckets and token-budget batches of what is left, by token counts."""
    return pack(token_counts(docs))


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("packing", packing)]

#: The language model and the optimal boundaries are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; the rows of the last one. What a stage read goes when its own output is written."""
    out = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    with Scratch(spark, "pipeline") as scratch:
        for name, stage in STAGES[:-1]:
            at = mark()
            out = scratch.written(stage(spark, out, sf_dir), f"stage-{name}")
            release(at)
            if before is not None:
                scratch.drop(before)
            before = out
        return STAGES[-1][1](spark, out, sf_dir)
