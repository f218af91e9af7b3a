"""Map manifests: finding the newest, reading it with a fixed schema, checking it, and taking its keyframes and levels apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terravane.functions import geodesy as G
from terravane.functions import text as T

#: Fixed value: file names are {map}_{version}_{yyyymmdd}_{hhmmss}.json.
NAME = r"([^/]+)_(\d+)_(\d{8}_\d{6})\.json$"
SCHEMA = """
    local_origin ARRAY<DOUBLE>,
    map STRUCT<name: STRING, uuid: STRING, venue_type: STRING>,
    geo_levels ARRAY<STRUCT<value: DOUBLE, min_altitude: DOUBLE, max_altitude: DOUBLE, geo_ref: BIGINT, geometry: STRING>>,
    geo_keyframes ARRAY<STRUCT<image_url: STRING, depth_url: STRING, x: DOUBLE, y: DOUBLE, z: DOUBLE, orientation: ARRAY<DOUBLE>>>
"""


def newest_files(files: DataFrame) -> DataFrame:
    """files: path, modificationTime. The newest manifest of each map by its name's stamp, then by its time; other files are left out."""
    part = lambda k: F.regexp_extract("path", NAME, k)
    named = files.where(part(3) != "").select("path", "modificationTime", part(1).alias("map_id"), part(2).cast("int").alias("version"), part(3).alias("stamp"))
    return named.groupBy("map_id").agg(F.max_by(F.struct("path", "version", "stamp"), F.struct("stamp", "modificationTime", "path")).alias("f")).select("map_id", "f.*")


def find_manifests(spark: SparkSession, folder: str) -> DataFrame:
    return newest_files(spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder).select("path", "modificationTime"))


def read_manifests(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per manifest with path; what is missing or contradictory is an error when the row is read."""
    raw = spark.read.schema(SCHEMA).option("multiLine", True).json(path).withColumn("path", F.col("_metadata.file_path"))
    refs = F.array_distinct(F.filter(F.transform(F.coalesce("geo_levels", F.array()), lambda v: v["geo_ref"]), lambda g: g.isNotNull()))
    names = F.transform("geo_keyframes", lambda k: T.basename(k["image_url"]))
    return checked(
        raw,
        "local_origin",
        [
            (F.coalesce(F.size("local_origin"), F.lit(0)) == 3, "local_origin must be [lng, lat, alt]"),
            (F.size(refs) <= 1, "levels of several geo_refs"),
            (F.coalesce(F.size("geo_keyframes"), F.lit(0)) > 0, "no keyframes"),
            (F.forall(names, lambda n: n.isNotNull() & (n != "")), "a keyframe without an image"),
            (F.forall("geo_keyframes", lambda k: F.coalesce(F.size(k["orientation"]), F.lit(0)) == 4), "an orientation that is not [w, x, y, z]"),
            (F.size(F.array_distinct(names)) == F.size(names), "keyframes that share an image"),
        ],
    ).withColumn("geo_ref_id", F.get(refs, 0))


def checked(df: DataFrame, column: str, rules: list[tuple[Column, str]]) -> DataFrame:
    """df whose column raises the message of the first rule that doesn't hold."""
    out = F.col(column)
    for ok, message in reversed(rules):
        out = F.when(F.coalesce(ok, F.lit(False)), out).otherwise(F.raise_error(F.lit(message)).cast(df.schema[column].dataType))
    return df.withColumn(column, out)


def keyframes(manifests: DataFrame) -> DataFrame:
    """One row per keyframe: path, geo_ref_id, keyframe (its place in the list), image, depth_map, position, orientation, heading."""
    k = manifests.select("path", "geo_ref_id", "local_origin", F.posexplode("geo_keyframes").alias("keyframe", "k"))
    q = G.quaternion(*[F.get("k.orientation", i) for i in range(4)])
    # the origin is named so that its check is made
    return k.where("local_origin IS NOT NULL").select(
        "path", "geo_ref_id", F.col("keyframe").cast("long").alias("keyframe"), T.basename(F.col("k.image_url")).alias("image"), T.basename(F.col("k.depth_url")).alias("depth_map"),
        G.xyz(F.col("k.x"), F.col("k.y"), F.col("k.z")).alias("position"), q.alias("orientation"), G.heading_of_orientation(q).alias("heading"),
    )


def levels(manifests: DataFrame) -> DataFrame:
    """Each manifest's levels as an array of bands (value, low, high), by value."""
    return manifests.where("local_origin IS NOT NULL").select("path", "geo_ref_id", F.array_sort(F.transform(F.coalesce("geo_levels", F.array()), lambda v: F.struct(v["value"].alias("value"), v["min_altitude"].alias("low"), v["max_altitude"].alias("high")))).alias("bands"))


def registry(maps: DataFrame, default: str) -> DataFrame:
    """Configured maps with their folder (the default one by their id where none is given); an id that occurs twice is an error."""
    n = F.count("*").over(Window.partitionBy("map_id"))
    path = F.coalesce(T.blank_to_null(F.col("path")), F.concat(F.lit(default.rstrip("/") + "/"), F.col("map_id")))
    return maps.withColumn("path", path).withColumn("map_id", F.when(n == 1, F.col("map_id")).otherwise(F.raise_error(F.concat(F.lit("map configured twice: "), F.col("map_id"))).cast("string")))


def graph_edges(spark: SparkSession, path: str) -> DataFrame:
    """Keyframe graph GeoJSON as edges: first and last coordinate and distinct levels of each line; malformed lines have malformed true."""
    raw = spark.read.schema("features ARRAY<STRUCT<geometry: STRUCT<type: STRING, coordinates: STRING>, properties: STRUCT<levels: ARRAY<INT>>>>").option("multiLine", True).json(path)
    f = raw.select(F.posexplode("features").alias("index", "f")).where("f.geometry.type = 'LineString'")
    c = F.from_json("f.geometry.coordinates", "array<array<double>>")
    ok = (F.coalesce(F.size(c), F.lit(0)) >= 2) & F.forall(c, lambda p: F.size(p) >= 2)
    return f.select("index", F.when(ok, F.get(c, 0)).alias("start"), F.when(ok, F.element_at(c, -1)).alias("end"), F.array_distinct(F.coalesce("f.properties.levels", F.array())).alias("levels"), (~F.coalesce(ok, F.lit(False))).alias("malformed"))


def read_config(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON configuration that may have comments and trailing commas, by a schema."""
    whole = spark.read.text(path, wholetext=True)
    # strings are kept as they are; comments and commas before a closing bracket go
    plain = F.regexp_replace("value", r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*[\s\S]*?\*/', "$1")
    plain = F.regexp_replace(plain, r'("(?:[^"\\]|\\.)*")|,(?=\s*[}\]])', "$1")
    return whole.select(F.from_json(plain, schema, {"mode": "FAILFAST"}).alias("c")).select("c.*")
