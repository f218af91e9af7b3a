"""Detections on their way into the index, and records on their way out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terravane.functions import boxes as B
from terravane.functions import geodesy as G
from terravane.operators import annotations as A
from terravane.operators import suppression as U


def postprocessed(rows: DataFrame, width: int, height: int, confidence: float, low: float, high: float, overlap: float) -> DataFrame:
    """Detections clipped to the image, confident enough, of a share strictly within bounds, without those that overlap a better one (keyframe by keyframe)."""
    clipped = rows.withColumn("__b", B.clipped(B.box(*[F.col(c) for c in ("x0", "y0", "x1", "y1")]), F.lit(width), F.lit(height))).where("__b IS NOT NULL")
    share = B.area(F.col("__b")) / float(width * height)
    kept = clipped.where((F.col("score") >= confidence) & (share > low) & (share < high)).select(*[F.col(f"__b.{c}").alias(c) if c in ("x0", "y0", "x1", "y1") else F.col(c) for c in rows.columns])
    return U.suppress(kept, ["keyframe"], ["x0", "y0", "x1", "y1"], "score", overlap, "at_most")


def reading_candidates(rows: DataFrame, textness: float, sources: list[str] | None = None, but: list[str] | None = None, after: int | None = None) -> DataFrame:
    """Rows that are text-like enough and not read yet, of some sources, or of all but some (a null source is blank), beyond an id."""
    out = rows.where((F.col("textness") > textness) & F.col("key").isNull())
    source = F.coalesce("source", F.lit(""))
    if sources is not None:
        out = out.where(source.isin(sources))
    if but is not None:
        out = out.where(~source.isin(but))
    return out if after is None else out.where(F.col("id") > after)


def selected_for_reading(rows: DataFrame, textness: float, least_rows: int, least_keyframes: int, per_cluster: int, most: int) -> DataFrame:
    """Placed rows of supported clusters, at most per_cluster of each (one of each keyframe first), at most `most` in all by textness."""
    ok = rows.where((F.col("cluster") >= 0) & F.col("position").isNotNull() & (F.col("textness") >= textness))
    kept = U.diverse(A.supported_groups(ok, ["cluster"], least_rows, least_keyframes), ["cluster"], "keyframe", per_cluster, "textness")
    return kept.orderBy(F.desc("textness"), "id").limit(most)


def ranked_rows(rows: DataFrame, by: list[str], order: list, numbers: list[str]) -> DataFrame:
    """Rows with their rank from 1 in the order; numbers that are not finite become null."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c))
    return rows.withColumn("rank", F.row_number().over(w.orderBy(*order))).withColumns({c: finite(c) for c in numbers})


def object_record(box: list[str], textness: str, source: str, names: dict[int, str]) -> list[Column]:
    """A stored object's columns for a client: the box to one decimal, textness to four, the reading's source by name."""
    known = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return [*[F.bround(c, 1).alias(c) for c in box], F.bround(textness, 4).alias(textness), F.coalesce(F.element_at(known, F.col(source)), F.lit("unknown")).alias("source_name")]


def first_usable_level(observations: DataFrame, by: list[str], levels: DataFrame) -> DataFrame:
    """The level of the first observation (by place) whose keyframe has one."""
    j = observations.join(levels.where("level IS NOT NULL").select("keyframe", "level"), "keyframe")
    return j.groupBy(*by).agg(F.min_by("level", "place").alias("level"))


def observation_headings(observations: DataFrame, keyframes: DataFrame) -> DataFrame:
    """Observations with the bearing from their keyframe, null where either place is unknown."""
    j = observations.join(keyframes.select("keyframe", F.col("lat").alias("__lat"), F.col("lng").alias("__lng")), "keyframe", "left")
    return j.withColumn("heading", G.bearing_deg(F.col("__lat"), F.col("__lng"), F.col("lat"), F.col("lng"))).drop("__lat", "__lng")


def stored_coordinates(rows: DataFrame) -> DataFrame:
    """Rows with an array of coordinates where they are valid and finite, else null."""
    fine = F.col("valid") & F.forall(F.array("lat", "lng", "alt"), lambda v: v.isNotNull() & ~F.isnan(v))
    return rows.withColumn("coordinates", F.when(fine, F.array("lat", "lng", "alt")))


def encoded(rows: DataFrame, column: str, load: Callable[[], Callable[[list], np.ndarray]], name: str = "embedding") -> DataFrame:
    """rows with a vector of a column: `load` makes the encoder once in each task, which then sees batches."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = load()
        for df in it:
            yield df.assign(**{name: [np.asarray(v, np.float32) for v in encode(df[column].tolist())]})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(run, f"{schema}, {name} array<float>")
