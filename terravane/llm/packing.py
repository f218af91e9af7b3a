"""Packing into length buckets whose boundaries minimise padding, and token-budget batches inside each bucket."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terravane.llm.common import Scratch


def _first_best(cost: np.ndarray, docs: np.ndarray, total: np.ndarray, lengths: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each j the least cost of a last bucket (i, j] after cost[i], least <= i < j, and the first such i.

    The first best i never falls as j grows, so the middle j of a run bounds both halves; all runs of a depth are looked at together.
    """
    n = len(lengths)
    new, come = np.full(n + 1, -1, np.int64), np.zeros(n + 1, np.int64)
    low, high, first, last = (np.array([x], np.int64) for x in (least + 1, n, least, n - 1))
    while len(low):
        mid = (low + high) // 2
        each = np.minimum(last, mid - 1) - first + 1
        start = np.cumsum(each) - each
        i = np.repeat(first - start, each) + np.arange(each.sum())
        j = np.repeat(mid, each)
        c = cost[i] + (docs[j] - docs[i]) * lengths[j - 1] - (total[j] - total[i])
        new[mid] = np.minimum.reduceat(c, start)
        hit = np.flatnonzero(c == np.repeat(new[mid], each))
        come[mid] = i[hit[np.searchsorted(hit, start)]]
        low, high, first, last = np.r_[low, mid + 1], np.r_[mid - 1, high], np.r_[first, come[mid]], np.r_[come[mid], last]
        some = low <= high
        low, high, first, last = low[some], high[some], first[some], last[some]
    return new, come


def best_boundaries(lengths: np.ndarray, counts: np.ndarray, sums: np.ndarray, buckets: int) -> list[int]:
    """Boundaries (bucket maxima) of at most `buckets` buckets with the least padding, by dynamic programming.

    lengths: the sorted distinct lengths; counts: documents of each; sums: their total length. Padding of a bucket is
    its documents times its boundary, less their lengths. Of equally good ones the fewest, lowest boundaries win.
    """
    n = len(lengths)
    if not n:
        return []
    docs, total = np.r_[0, np.cumsum(counts, dtype=np.int64)], np.r_[0, np.cumsum(sums, dtype=np.int64)]
    cost, back = np.zeros(n + 1, np.int64), []
    best = None
    for k in range(min(buckets, n)):
        if k:
            cost, come = _first_best(cost, docs, total, lengths, k)
        else:
            cost, come = np.r_[0, docs[1:] * lengths - total[1:]], np.zeros(n + 1, np.int64)
        back.append(come)
        if best is None or cost[n] < best[0]:
            best = (cost[n], k)
    out, j = [], n
    for k in range(best[1], -1, -1):
        out.append(int(lengths[j - 1]))
        j = int(back[k][j])
    return out[::-1]


#: Rows of one id and length that a task writes one after another.
RUN = 1 << 16


def _bases(rows: DataFrame) -> DataFrame:
    """For each bucket and range of ids the documents of the bucket in earlier ranges; a row for each range and bucket."""
    totals = rows.groupBy("bucket", "part").agg(F.sum("copies").alias("n"))
    earlier = Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("bucket", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))


def pack(lengths: DataFrame, buckets: int = 16, budget: int = 65536) -> DataFrame:
    """lengths: doc_id (long) and n_tokens (long). One row per input row:
    doc_id, n_tokens, bucket (0 for the shortest), boundary, batch, slot, padding.

    Boundaries come from the exact histogram of all lengths by dynamic programming, so each is a length that occurs. Inside a bucket documents
    are numbered by doc_id (rows of one id by length; null ids last), and each run of max(1, budget // boundary) of
    them is a batch, whose tokens with padding stay within the budget unless one document alone exceeds it.
    batch counts from 0 in each bucket, slot from 0 in each batch. Lengths of 0 or null get the bucket of the
    shortest boundary with 0 tokens; repeated rows are counted each; an empty table gives no rows.

    The histogram has a row for each distinct length, at most the root of twice the tokens. Rows of one id and length are one row with a
    count, dealt by ranges of bucket, id and length, however sparse the ids are; numbers are a range's base, the sum of the ranges
    before it, and a running sum in the range. So no task sees a whole bucket, and rows without an id are at most as many as lengths.
    """
    n_tokens = F.greatest(F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)), F.lit(0)).cast("long")
    with Scratch(lengths.sparkSession, "packing") as scratch:
        rows = scratch.written(lengths.select("doc_id", n_tokens.alias("n_tokens")).groupBy("doc_id", "n_tokens").agg(F.count("*").alias("copies")), "lengths")
        bins = sorted(tuple(r) for r in rows.groupBy("n_tokens").agg(F.sum("copies")).collect())
        length, n = np.array(bins, np.int64).reshape(-1, 2).T
        bounds = best_boundaries(length, n, length * n, buckets)
        bucket = F.lit(None).cast("int")
        for k in range(len(bounds) - 1, -1, -1):
            bucket = F.when(F.col("n_tokens") <= bounds[k], F.lit(k)).otherwise(bucket)
        order = ["bucket", F.asc_nulls_last("doc_id"), "n_tokens"]
        ranged = rows.withColumn("bucket", bucket).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
        ranged = scratch.written(ranged, "ranged", keep=True)  # a range's number is part of what is written
        bases = scratch.written(_bases(ranged), "bases", keep=True)

    within = Window.partitionBy("bucket", "part").orderBy(F.asc_nulls_last("doc_id"), "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    numbered = ranged.withColumn("first", F.coalesce(F.sum("copies").over(within), F.lit(0))).join(bases, ["bucket", "part"])
    numbered = numbered.select("doc_id", "n_tokens", "bucket", "copies", (F.col("base") + F.col("first")).alias("at"))
    # copies are dealt in runs before they are written out
    many = numbered.where("copies > 1").withColumn("run", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / RUN)))).repartition("doc_id", "n_tokens", "run")
    each = F.explode(F.sequence(F.col("run") * RUN, F.least(F.col("copies"), (F.col("run") + 1) * RUN) - 1))
    many = many.withColumn("i", each).select("doc_id", "n_tokens", "bucket", (F.col("at") + F.col("i")).alias("at"))
    numbered = numbered.where("copies = 1").drop("copies").union(many)
    boundary = F.element_at(F.array(*[F.lit(b).cast("long") for b in bounds or [0]]), F.col("bucket") + 1)
    size = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("boundary"), F.lit(1)))).cast("long")
    return numbered.withColumn("boundary", boundary).select(
        "doc_id", "n_tokens", "bucket", "boundary", F.floor(F.col("at") / size).cast("long").alias("batch"), (F.col("at") % size).cast("int").alias("slot"),
        (F.col("boundary") - F.col("n_tokens")).alias("padding"),
    )
