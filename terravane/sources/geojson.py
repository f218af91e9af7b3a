"""GeoJSON feature collections as rows, and what an import makes of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SOURCE = ("theta", "phi", "width", "height", "depth")


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """index, geometry_type, coordinates (a point's, or an outer ring's [lng, lat] pairs; empty for other types), properties (as text)."""
    schema = "features ARRAY<STRUCT<geometry: STRUCT<type: STRING, coordinates: STRING>, properties: MAP<STRING, STRING>>>"
    f = spark.read.schema(schema).option("multiLine", True).json(path).select(F.posexplode("features").alias("index", "f"))
    kind, raw = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    point, ring = F.from_json(raw, "array<double>"), F.get(F.from_json(raw, "array<array<array<double>>>"), 0)
    coordinates = F.when(kind == "Point", F.array(point)).when(kind == "Polygon", ring)
    empty = F.array().cast("array<array<double>>")
    return f.select("index", kind.alias("geometry_type"), F.filter(F.coalesce(coordinates, empty), lambda c: c.isNotNull()).alias("coordinates"), F.coalesce("f.properties", F.create_map().cast("map<string,string>")).alias("properties"))


def source_block(properties: Column) -> Column:
    """struct of the five numbers of a source view, null unless all are finite numbers."""
    value = {n: properties[n].try_cast("double") for n in SOURCE}
    fine = None
    for v in value.values():
        ok = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
        fine = ok if fine is None else fine & ok
    return F.when(fine, F.struct(*[v.alias(n) for n, v in value.items()]))


def read_objects(spark: SparkSession, url: str, table: str, column: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A database's table in ranges of an integer column, one task each."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=parts, **options).load()
