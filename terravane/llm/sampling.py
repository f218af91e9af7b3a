"""Bounded, repeatable samples of labelled rows; a sample depends on the ids alone, not on partitions or order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTS = 1 << 30


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null for a null id."""
    return F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % folds


def place(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id, F.lit(11)), F.lit(PARTS))


def class_counts(rows: DataFrame, label: str) -> dict:
    """Rows of each label; classes are few."""
    return {r[0]: r[1] for r in rows.groupBy(label).count().collect()}


def chosen(counts: dict, label: str, per_class: int) -> Column:
    """Condition for about `per_class` rows of each class, or all of them where there are fewer."""
    condition = F.lit(False)
    for value, n in counts.items():
        share = min(PARTS, -(-PARTS * per_class // max(n, 1)))
        condition = condition | ((F.col(label) == F.lit(value)) & (place(F.col("doc_id")) < share))
    return condition
