"""Prefilter, top-k, floors, ratio scores and ranks; `by` names the keys of a query, so many queries run in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _all(by: list[str]):
    return Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))


def prefilter(hits: DataFrame, by: list[str], ratio: float = 0.3, id_col: str = "id", most: int | None = None) -> DataFrame:
    """Keep the first 2n hits by similarity, n being those of at least `ratio` times the best, and of these the first `most`.

    It isn't a filter on the similarity: hits under the bound survive among the first 2n, and a negative
    best hit may leave none. The counts are one small row for each query; only the rank needs an order, and with `most`
    tasks send on their first rows only.
    """
    stats = hits.groupBy(*by).agg(F.max("similarity").alias("__best"))
    with_best = hits.join(F.broadcast(stats), by) if by else hits.crossJoin(F.broadcast(stats))
    n = with_best.groupBy(*by).agg(F.count_if(F.col("similarity") >= ratio * F.col("__best")).alias("__n"))
    first = hits if most is None else top_candidates(hits, most, by, id_col)
    joined = first.join(F.broadcast(n), by) if by else first.crossJoin(F.broadcast(n))
    order = _all(by).orderBy(F.desc("similarity"), F.asc(id_col))
    return joined.withColumn("__rn", F.row_number().over(order)).where("__rn <= 2 * __n").drop("__rn", "__n")


def top_candidates(hits: DataFrame, k: int, by: list[str], id_col: str = "id") -> DataFrame:
    """The best max(k, 1) hits of each query, by similarity, then id."""
    k = max(k, 1)
    if not by:
        return hits.orderBy(F.desc("similarity"), F.asc(id_col)).limit(k)
    order = _all(by).orderBy(F.desc("similarity"), F.asc(id_col))
    return hits.withColumn("__rn", F.row_number().over(order)).where(F.col("__rn") <= k).drop("__rn")


def ratio_score(clusters: DataFrame, by: list[str]) -> DataFrame:
    """match_score = similarity / best, within [0, 1]; 1 where the best is at most 1e-6."""
    best = F.max("similarity").over(_all(by))
    return clusters.withColumn("match_score", F.when(best > 1e-6, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("similarity") / best))).otherwise(F.lit(1.0)))


def rank_clusters(clusters: DataFrame, by: list[str], min_similarity: float, limit: int, id_col: str = "cluster_id") -> DataFrame:
    """The similarity floor (inclusive) first, then the ratio, then the rank; ties end in the cluster's id."""
    scored = ratio_score(clusters.where(F.col("similarity") >= min_similarity), by)
    order = _all(by).orderBy(F.desc("match_score"), F.desc("similarity"), F.asc(id_col))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
