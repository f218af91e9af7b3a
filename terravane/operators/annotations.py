"""Annotations, reviews and their import, export and ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terravane.functions import text as T


def annotation_rows(features: DataFrame, default_accuracy: float = 5.0) -> DataFrame:
    """features: index, geometry_type, coordinates (array of [lng, lat], one for a point), properties (map of strings).

    One row each: id, class_name, prompt, lat, lng, accuracy. A polygon counts by the mean of its ring's vertices,
    the closing one included; class, else name; the prompt falls back to the class, a blank id to the index, a bad accuracy to the default. Others are left out.
    """
    p = lambda k: T.blank_to_null(F.col("properties")[k])
    name = F.coalesce(p("class"), p("name"))
    mean = lambda k: F.aggregate("coordinates", F.lit(0.0), lambda s, c: s + c[k].cast("double")) / F.size("coordinates")
    accuracy = F.col("properties")["accuracy"].try_cast("double")
    ok = accuracy.isNotNull() & ~F.isnan(accuracy) & (accuracy > 0)
    rows = features.where(F.col("geometry_type").isin("Point", "Polygon") & (F.size("coordinates") > 0))
    return rows.select(
        F.coalesce(F.when(p("id") != "0", p("id")), F.col("index").cast("string")).alias("id"), name.alias("class_name"), F.coalesce(p("prompt"), name).alias("prompt"),
        mean(1).alias("lat"), mean(0).alias("lng"), F.when(ok, accuracy).otherwise(F.lit(default_accuracy)).alias("accuracy"),
    )


def review_sets(reviews: DataFrame, queries: DataFrame) -> DataFrame:
    """For each query (slug, query) the reviewed ids by status, each once and ordered; queries meet after normalisation."""
    r = reviews.select("slug", T.normalised_query(F.col("query")).alias("q"), "target", "status")
    q = queries.select("slug", "query", T.normalised_query(F.col("query")).alias("q"))
    ids = lambda s: F.array_sort(F.collect_set(F.when(F.col("status") == s, F.col("target"))))
    return q.join(r, ["slug", "q"], "left").groupBy("slug", "query").agg(ids("true_positive").alias("positive"), ids("false_positive").alias("negative"))


def status_counts(annotations: DataFrame) -> DataFrame:
    return annotations.agg(F.count("*").alias("n"), F.count_distinct("prompt").alias("n_prompts"))


def commonest_class(annotations: DataFrame) -> DataFrame:
    """The most frequent class of each prompt, the first by name of equal ones."""
    n = annotations.groupBy("prompt", "class_name").agg(F.count("*").alias("k"))
    return n.groupBy("prompt").agg(F.min_by("class_name", F.struct(-F.col("k"), "class_name")).alias("class_name"))


def group_centres(members: DataFrame, by: list[str], radius: float) -> DataFrame:
    """Mean place of each group and its radius: the largest accuracy, at least the grouping radius."""
    return members.groupBy(*by, "group_id").agg(F.avg("lat").alias("lat"), F.avg("lng").alias("lng"), F.greatest(F.max("accuracy"), F.lit(radius)).alias("radius"), F.count("*").alias("n"))


def ground_truth(detections: DataFrame, points: DataFrame) -> DataFrame:
    """Manual detections (class, query, u, v) and points as one table of classed places; a blank class is the query."""
    named = lambda: F.coalesce(T.blank_to_null(F.col("class_name")), F.col("query")).alias("class_name")
    a = detections.select("id", named(), F.lit("detection").alias("kind"), "x", "y")
    return a.unionByName(points.select("id", named(), F.lit("point").alias("kind"), "x", "y"))


def unique_names(classes: DataFrame) -> DataFrame:
    """Class names by type: one name of several types becomes name_type for all but the first by id."""
    w = Window.partitionBy("name").orderBy("id")
    first = F.first("type").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return classes.withColumn("unique_name", F.when(F.col("type") == first, F.col("name")).otherwise(F.concat_ws("_", "name", "type")))


def as_feature(kind: Column, lng: Column, lat: Column, properties: Column) -> Column:
    """A point feature as GeoJSON text; null properties are left out."""
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array(lng, lat).alias("coordinates")).alias("geometry"), F.struct(kind.alias("kind"), properties.alias("properties")).alias("properties")))


def outcome_features(predictions: DataFrame, annotations: DataFrame, matches: DataFrame) -> DataFrame:
    """tp, fp, fn and reference features of predictions and annotations, given the matched pairs."""
    p = predictions.join(matches.select(F.col("prediction").alias("id"), "target"), "id", "left")
    made = p.select(F.when(F.col("target").isNotNull(), "tp").otherwise("fp").alias("kind"), "id", "lat", "lng", "score")
    a = annotations.join(matches.select(F.col("target").alias("id"), "prediction"), "id", "left")
    missed = a.where("prediction IS NULL").select(F.lit("fn").alias("kind"), "id", "lat", "lng", F.lit(None).cast("double").alias("score"))
    known = a.select(F.lit("reference").alias("kind"), "id", "lat", "lng", F.lit(None).cast("double").alias("score"))
    return made.unionByName(missed).unionByName(known)


def flat_for_csv(rows: DataFrame) -> DataFrame:
    """Nested columns as JSON text."""
    nested = ("array", "map", "struct")
    return rows.select(*[F.to_json(c).alias(c) if t.startswith(nested) else F.col(c) for c, t in rows.dtypes])


def membership(rows: DataFrame) -> DataFrame:
    """(cluster, cutout) with its keyframe, its commonest known level (the smallest of equal ones) and its rows.

    A cutout of several keyframes, or a cluster's cutout without a known level, is an error.
    """
    n = rows.groupBy("cluster", "cutout", "level").agg(F.count("*").alias("k"), F.min("keyframe").alias("a"), F.max("keyframe").alias("b"))
    out = n.groupBy("cluster", "cutout").agg(F.min("a").alias("keyframe"), F.max("b").alias("__b"), F.min_by("level", F.when(F.col("level").isNotNull(), F.struct(-F.col("k"), "level"))).alias("level"), F.sum("k").alias("n"))
    checked = F.when(F.col("keyframe") != F.col("__b"), F.raise_error(F.lit("a cutout has several keyframes"))).when(F.col("level").isNull(), F.raise_error(F.lit("a cutout has no known level"))).otherwise(F.col("level"))
    return out.withColumn("level", checked.cast("int")).drop("__b")


def reading_consensus(rows: DataFrame, min_support: float, min_margin: int, min_keyframes: int) -> DataFrame:
    """For each cluster its commonest reading key, its lead over the second, its share, its keyframes, and whether that is enough."""
    keyed = rows.where("key IS NOT NULL AND key <> ''")
    n = keyed.groupBy("cluster", "key").agg(F.count("*").alias("k"), F.count_distinct("keyframe").alias("keyframes"))
    w = Window.partitionBy("cluster").orderBy(F.desc("k"), "key")
    ranked = n.withColumn("__n", F.row_number().over(w)).withColumn("second", F.coalesce(F.lead("k").over(w), F.lit(0))).withColumn("total", F.sum("k").over(Window.partitionBy("cluster"))).where("__n = 1")
    share = F.col("k") / F.col("total")
    ok = (share >= min_support) & (F.col("k") - F.col("second") >= min_margin) & (F.col("keyframes") >= min_keyframes)
    return ranked.select("cluster", "key", (F.col("k") - F.col("second")).alias("margin"), share.alias("support"), "keyframes", ok.alias("accepted"))


def lower_median_level(rows: DataFrame, by: list[str]) -> DataFrame:
    """Lower median of the resolved levels by their height."""
    v = rows.where("level IS NOT NULL").groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("height", "level"))).alias("v"))
    return v.select(*by, F.element_at("v", F.floor((F.size("v") - 1) / 2).cast("int") + 1)["level"].alias("level"))


def supported_groups(rows: DataFrame, by: list[str], rows_least: int, keyframes_least: int) -> DataFrame:
    """Rows of the groups with enough rows and keyframes."""
    ok = rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_distinct("keyframe").alias("k")).where((F.col("n") >= rows_least) & (F.col("k") >= keyframes_least))
    return rows.join(ok.select(*by), by, "left_semi")
