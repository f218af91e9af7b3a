"""The explorer's filters, pages, histograms and runs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def source_family(source: Column) -> Column:
    """yolo, gdino or other, by what the detector's name holds."""
    s = F.lower(F.coalesce(source, F.lit("")))
    grounding = F.contains(s, F.lit("gdino")) | F.contains(s, F.lit("g-dino")) | F.contains(s, F.lit("grounding"))
    return F.when(F.contains(s, F.lit("yolo")), "yolo").when(grounding, "gdino").otherwise("other")


def by_family_and_area(rows: DataFrame, yolo: bool, gdino: bool, low: float, high: float) -> DataFrame:
    """Rows of the families that are on (others need both), with an area within bounds that count; a high bound of 0 or less is none."""
    family = source_family(F.col("source"))
    on = F.when(family == "yolo", F.lit(yolo)).when(family == "gdino", F.lit(gdino)).otherwise(F.lit(yolo and gdino))
    return rows.where(on & F.col("area").between(low, high if high > 0 else math.inf))


def matching_rows(rows: DataFrame, source: str | None = None, with_depth: bool = False, label: str | None = None) -> DataFrame:
    """Rows of exactly a source, with a finite depth, with a label that holds a text in any case."""
    out = rows
    if source is not None:
        out = out.where(F.col("source") == source)
    if with_depth:
        out = out.where(F.col("depth").isNotNull() & ~F.isnan("depth") & (F.abs("depth") < math.inf))
    if label:
        out = out.where(F.contains(F.lower(F.coalesce("label", F.lit(""))), F.lit(label.lower())))
    return out


def page(rows: DataFrame, offset: int, limit: int, order: list) -> DataFrame:
    """A page in the order (which ends in a unique key); the limit is held within 1 and 20,000, the offset at 0."""
    return rows.orderBy(*order).offset(max(offset, 0)).limit(min(max(limit, 1), 20000))


def runs(rows: DataFrame, by: list[str], index: str, key: str) -> DataFrame:
    """Runs of neighbouring rows of one key within a capture (by): key, start, end (exclusive), n_with_depth, and whether the key has a single run."""
    w = Window.partitionBy(*by).orderBy(index)
    before = F.lag(key).over(w)
    marked = rows.withColumn("__new", F.when(before.isNull() | (before != F.col(key)), 1).otherwise(0)).withColumn("__run", F.sum("__new").over(w))
    out = marked.groupBy(*by, key, "__run").agg(F.min(index).alias("start"), (F.max(index) + 1).alias("end"), F.count_if(F.col("depth").isNotNull() & ~F.isnan("depth")).alias("n_with_depth"))
    return out.withColumn("contiguous", F.count("*").over(Window.partitionBy(*by, key)) == 1).drop("__run")


def source_histogram(rows: DataFrame) -> DataFrame:
    """Rows and rows with depth of each detector; a blank one is unknown."""
    return rows.groupBy(F.coalesce(F.nullif(F.col("source"), F.lit("")), F.lit("unknown")).alias("source")).agg(F.count("*").alias("n"), F.count_if(F.col("depth").isNotNull() & ~F.isnan("depth")).alias("n_with_depth"))


def keyframe_state(n_rows: Column, n_indexed: Column, prepared: Column) -> Column:
    """not-prepared, unknown (no coverage known), indexed or pruned."""
    return F.when(~prepared | (F.coalesce(n_rows, F.lit(0)) == 0), "not-prepared").when(n_indexed.isNull(), "unknown").when(n_indexed > 0, "indexed").otherwise("pruned")


def neighbours(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """Each row with the one before and after it in numeric order."""
    w = Window.partitionBy(*by).orderBy(order)
    return rows.withColumn("previous", F.lag(order).over(w)).withColumn("next", F.lead(order).over(w))


def wire_columns(rows: DataFrame, order: str, level: str) -> DataFrame:
    """Columns as arrays for the wire: ids (null if they are 0..n-1), level codes by first occurrence, and the levels they stand for."""
    one = rows.agg(F.transform(F.array_sort(F.collect_list(F.struct(order, F.coalesce(F.col(level).cast("string"), F.lit("")).alias("l")))), lambda s: s).alias("r"))
    ids, levels = F.transform("r", lambda s: s[order]), F.transform("r", lambda s: s["l"])
    one = one.select(ids.alias("ids"), levels.alias("levels"), F.array_distinct(levels).alias("names"))
    dense = F.col("ids") == F.transform(F.col("ids"), lambda _, i: i.cast("long"))
    return one.select(F.when(~dense, F.col("ids")).alias("ids"), F.transform("levels", lambda v: F.array_position("names", v).cast("int") - 1).alias("level_codes"), F.col("names").alias("level_names"))


def review_status(observations: DataFrame, reviews: DataFrame, by: list[str]) -> DataFrame:
    """The status that all distinct observations of a cluster share, else null, and how many are true and false."""
    own = observations.select(*by, "id").distinct().join(reviews.select("id", "status"), "id", "left")
    agg = own.groupBy(*by).agg(F.count("*").alias("n"), F.count("status").alias("reviewed"), F.count_distinct("status").alias("kinds"), F.max("status").alias("s"), F.count_if(F.col("status") == "true_positive").alias("n_true"), F.count_if(F.col("status") == "false_positive").alias("n_false"))
    return agg.select(*by, F.when((F.col("n") == F.col("reviewed")) & (F.col("kinds") == 1), F.col("s")).alias("status"), "n_true", "n_false")


def first_known(rows: DataFrame, by: list[str], order: str, columns: list[str], score: str) -> DataFrame:
    """Best score of each group and, of each column, the first value in order that is not null."""
    return rows.groupBy(*by).agg(F.max(score).alias(score), F.count("*").alias("n"), *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns])


def fallback_scores(rows: DataFrame, by: list[str]) -> DataFrame:
    """match_score where there is one, else half the similarity's share of the best, 0.3 confidence and 0.2 support of up to three keyframes."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    best = F.max("similarity").over(w)
    made = 0.5 * F.when(best > 0, F.col("similarity") / F.when(best > 0, best)).otherwise(F.lit(0.0)) + 0.3 * F.coalesce("confidence", F.lit(0.0)) + 0.2 * F.least(F.lit(1.0), F.col("n_keyframes") / 3)
    return rows.withColumn("match_score", F.coalesce("match_score", made))


def legacy_scores(rows: DataFrame, by: list[str], floor: float, weights: dict[str, float]) -> DataFrame:
    """Similarity stretched from the floor to the best as 0 to 1, mixed with other columns by their weights."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    best = F.max("similarity").over(w)
    relative = F.when(best - floor > 1e-6, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("similarity") - floor) / (best - floor)))).otherwise(F.lit(1.0))
    return rows.withColumn("relative", relative).withColumn("score", sum((F.lit(v) * F.coalesce(k, F.lit(0.0)) for k, v in weights.items()), F.lit(0.0)))


def merged_best(parts: list[DataFrame], key: str, score: str) -> DataFrame:
    """Best score of each key over the union of several result lists."""
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy(key).agg(F.max(score).alias(score))


def displayed(rows: DataFrame, sensitivity: float) -> DataFrame:
    """Results that a sensitivity from 0 to 100 shows: a match score of at least what is left to 100, the bound included."""
    return rows.where(F.col("match_score") >= 1 - sensitivity / 100)


def without_labels(rows: DataFrame, excluded: list[str]) -> DataFrame:
    """Rows whose label, trimmed and in lower case, is none of the excluded ones; a null label stays."""
    names = [x.strip().lower() for x in excluded]
    return rows.where(~F.coalesce(F.lower(F.trim("label")).isin(names), F.lit(False))) if names else rows


def on_levels(rows: DataFrame, levels: list[int], bands: Column, height: str, ring: Column | None = None) -> DataFrame:
    """Rows whose height lies in the band of an allowed level and, with a ring, whose lng and lat lie inside it."""
    from terravane.functions import geodesy as G

    ok = G.level_of_height(F.col(height), bands).isin(levels)
    return rows.where(ok & G.point_in_ring(F.col("lng"), F.col("lat"), ring) if ring is not None else ok)


def detection_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """Detections of each group: how many in a keyframe at the median and at most, and scores at the quartiles."""
    each = rows.groupBy(*by, "keyframe").agg(F.count("*").alias("k"))
    size = each.groupBy(*by).agg(F.count("*").alias("n_keyframes"), F.sum("k").alias("n"), F.median("k").alias("median"), F.max("k").alias("most"))
    score = rows.groupBy(*by).agg(*[F.percentile("score", F.lit(q)).alias(f"q{round(q * 100)}") for q in (0.25, 0.5, 0.75)])
    return size.join(score, by) if by else size.crossJoin(score)
