"""Joining hits with their rows, poses and review prototypes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terravane.functions import vectors as V


def enrich(hits: DataFrame, candidates: DataFrame, poses: DataFrame) -> DataFrame:
    """Hits (geo_ref, id, similarity) with their candidate and its keyframe's pose; candidates without a position drop out."""
    rows = candidates.where("position IS NOT NULL").join(hits, ["geo_ref", "id"])
    return rows.join(poses, ["geo_ref", "keyframe"])


def kept_only(rows: DataFrame, kept: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are kept."""
    return rows.join(kept.select(*keys), keys, "left_semi")


def missing(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are not known."""
    return rows.join(known.select(*keys), keys, "left_anti")


def coverage(candidates: DataFrame, poses: DataFrame) -> DataFrame:
    """Every keyframe with how many candidates it has and how many of them lack a position; 0 for none."""
    n = candidates.groupBy("geo_ref", "keyframe").agg(F.count("*").alias("n_rows"), F.count_if(F.col("position").isNull()).alias("n_unplaced"))
    return poses.select("geo_ref", "keyframe").join(n, ["geo_ref", "keyframe"], "left").select("geo_ref", "keyframe", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("n_unplaced", F.lit(0)).alias("n_unplaced"))


def prototype_similarity(candidates: DataFrame, prototypes: DataFrame, name: str) -> DataFrame:
    """The largest cosine of each candidate with a prototype of its map, from the distance of unit vectors; null without any.

    A map's prototypes are reviews of one query, few, and travel to the candidates as one array for each map.
    """
    some = prototypes.groupBy("geo_ref").agg(F.collect_list("embedding").alias("__p"))
    joined = candidates.join(F.broadcast(some), "geo_ref", "left")
    best = F.array_max(F.transform("__p", lambda p: V.similarity_of_distance(V.l2(F.col("embedding"), p))))
    return joined.withColumn(name, best).drop("__p")


def normalised_scores(rows: DataFrame, by: list[str], columns: list[str], mode: str = "standardize") -> DataFrame:
    """Each column over the rows of its query: as it is (none), less its median (center), or that in units of 1.4826 MAD (standardize).

    Where that unit is at most 1e-9 the score is 0; null stays null. All columns share two aggregates, whatever their number.
    """
    if mode == "none":
        return rows
    joined = rows
    medians = rows.groupBy(*by).agg(*[F.median(c).alias(f"__m_{c}") for c in columns])
    joined = joined.join(F.broadcast(medians), by) if by else joined.crossJoin(F.broadcast(medians))
    off = {c: F.col(c) - F.col(f"__m_{c}") for c in columns}
    if mode == "standardize":
        spreads = joined.groupBy(*by).agg(*[(F.median(F.abs(off[c])) * 1.4826).alias(f"__d_{c}") for c in columns])
        joined = joined.join(F.broadcast(spreads), by) if by else joined.crossJoin(F.broadcast(spreads))
        off = {c: F.when(F.col(f"__d_{c}") > 1e-9, off[c] / F.col(f"__d_{c}")).otherwise(F.lit(0.0)) for c in columns}
    return joined.select(*[F.when(F.col(c).isNotNull(), off[c]).alias(c) if c in off else F.col(c) for c in rows.columns])


def robust_scores(rows: DataFrame, by: list[str], column: str) -> DataFrame:
    """The column's distance from its median over the query in units of 1.4826 MAD; 0 where that is at most 1e-9; null stays null."""
    return normalised_scores(rows, by, [column])


def latest_reviews(log: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """The last entry of each key of an append log; an entry that deletes (status null) leaves none."""
    w = Window.partitionBy(*keys).orderBy(F.desc(at), F.desc(tie))
    return log.withColumn("__n", F.row_number().over(w)).where("__n = 1 AND status IS NOT NULL").drop("__n")
