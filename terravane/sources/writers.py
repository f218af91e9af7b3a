"""Sinks: partitioned fact tables, idempotent reloads, rewrites, CSV, and batch jobs that remember what they have done."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terravane.functions import text as T
from terravane.operators.annotations import flat_for_csv

CANDIDATE = ("id", "geo_ref_id", "geokeyframe_id", "theta", "phi", "width", "height", "embedding", "thumbnail", "depth", "object_position", "detector_source", "label", "detection_score")


def storable(rows: DataFrame) -> DataFrame:
    """Candidates as they are stored: NaN and blank text are null, a place with a NaN in it is null."""
    out = rows
    for name, kind in rows.dtypes:
        if kind in ("double", "float"):
            out = out.withColumn(name, T.nan_to_null(F.col(name)))
        elif kind == "string":
            out = out.withColumn(name, F.when(F.col(name) != "", F.col(name)))
    if "object_position" in rows.columns:
        p = F.col("object_position")
        out = out.withColumn("object_position", F.when(~(F.isnan(p["x"]) | F.isnan(p["y"]) | F.isnan(p["z"])), p))
    return out


def replace_maps(rows: DataFrame, path: str, key: str = "geo_ref_id") -> None:
    """Write rows so that the maps they hold are replaced as a whole and all others stay: running it again changes nothing."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows, and the old ones whose key they don't hold."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def write_new(rows: DataFrame, path: str) -> None:
    """Write to a folder that must not exist."""
    rows.write.mode("errorifexists").parquet(path)


def with_schema_checked(df: DataFrame, schema: str) -> DataFrame:
    """df with the columns of a schema, cast; a missing column is an error before anything is read."""
    wanted = [part.strip().split(None, 1) for part in schema.split(",")]
    if missing := [n for n, _ in wanted if n not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*[F.col(n).cast(t) for n, t in wanted])


def write_csv(rows: DataFrame, path: str) -> None:
    flat_for_csv(rows).write.mode("overwrite").option("header", True).csv(path)


def not_done(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work whose keys the done table doesn't have."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def backfilled(rows: DataFrame, column: str, value) -> DataFrame:
    """Rows whose null column gets a value, all others as they are."""
    return rows.withColumn(column, F.coalesce(column, value))


def recovered(rows: DataFrame, position) -> DataFrame:
    """Rows without a place tried again: localization_valid is true or false after a try, null where there was none to make."""
    tried = F.col("object_position").isNull() & F.col("depth").isNotNull()
    return rows.withColumn("__p", F.when(tried, position)).withColumn("localization_valid", F.when(tried, F.col("__p").isNotNull()).when(F.col("object_position").isNotNull(), F.lit(True))).withColumn("object_position", F.coalesce("object_position", "__p")).drop("__p")


def detection_records(detections: DataFrame, stride: int) -> DataFrame:
    """Detections with their cutout's number (keyframe * stride + place within the keyframe, by id)."""
    place = F.row_number().over(Window.partitionBy("keyframe").orderBy("id")) - 1
    return detections.withColumn("cutout_id", T.cutout_id(F.col("keyframe"), place, stride))


def cached_by_key(spark: SparkSession, request: DataFrame, path: str, compute) -> DataFrame:
    """Rows for requests, computed once: the key is a hash of the request as JSON, results are Parquet by key."""
    keyed = request.withColumn("cache_key", F.sha2(F.to_json(F.struct(*sorted(request.columns))), 256))
    try:
        known = spark.read.parquet(path)
        todo = keyed.join(known.select("cache_key").distinct(), "cache_key", "left_anti")
    except Exception as e:  # nothing cached yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        known, todo = None, keyed
    if known is None or not todo.isEmpty():
        compute(todo).write.mode("append").partitionBy("cache_key").parquet(path)
    return spark.read.parquet(path).join(keyed.select("cache_key").distinct(), "cache_key", "left_semi")
