"""The driver's tables in the roles of the engine's: each builder has the SQL of the same rows beside it.

embeddings: candidates (vec_id the id, label the keyframe, first components the place); customer: annotated points;
supplier: predictions; lineitem: detections with boxes; events: reviews and history. All of it stands in for real captures.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.functions import geodesy as G

E = lambda k: F.get("embedding", k).cast("double")

CANDIDATES = """candidates AS (
    SELECT vec_id AS id, vec_id % 3 AS geo_ref, label AS keyframe, embedding,
           embedding[1]::DOUBLE * 20 AS x, embedding[2]::DOUBLE * 4 AS y, embedding[3]::DOUBLE * 20 AS z, vec_id % 17 <> 5 AS placed,
           embedding[4]::DOUBLE * 3 AS theta, embedding[5]::DOUBLE AS phi, 0.05 + abs(embedding[6]::DOUBLE) AS width, 0.05 + abs(embedding[7]::DOUBLE) AS height,
           CASE WHEN vec_id % 11 = 3 THEN NULL ELSE abs(embedding[8]::DOUBLE) * 30 END AS depth,
           CASE WHEN vec_id % 7 = 2 THEN NULL ELSE label % 3 - 1 END AS level,
           CASE vec_id % 5 WHEN 0 THEN 'yolo-world' WHEN 1 THEN 'grounding-dino' WHEN 2 THEN 'YOLOv8' WHEN 3 THEN '' ELSE 'sam' END AS source
    FROM embeddings
)"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    i = F.col("vec_id")
    return e.select(
        i.alias("id"), (i % 3).alias("geo_ref"), F.col("label").alias("keyframe"), "embedding",
        (E(0) * 20).alias("x"), (E(1) * 4).alias("y"), (E(2) * 20).alias("z"), (i % 17 != 5).alias("placed"),
        (E(3) * 3).alias("theta"), E(4).alias("phi"), (0.05 + F.abs(E(5))).alias("width"), (0.05 + F.abs(E(6))).alias("height"),
        F.when(i % 11 != 3, F.abs(E(7)) * 30).alias("depth"), F.when(i % 7 != 2, F.col("label") % 3 - 1).alias("level"),
        F.when(i % 5 == 0, "yolo-world").when(i % 5 == 1, "grounding-dino").when(i % 5 == 2, "YOLOv8").when(i % 5 == 3, "").otherwise("sam").alias("source"),
    )


POSES = """poses AS (
    SELECT g.geo_ref, k.keyframe, k.keyframe * 1.5 AS px, 1.6 AS py, k.keyframe * -0.5 AS pz,
           cos(k.keyframe * 0.15) AS qw, 0.0 AS qx, sin(k.keyframe * 0.15) AS qy, 0.0 AS qz
    FROM (SELECT DISTINCT label AS keyframe FROM embeddings) k, (SELECT unnest([0, 1, 2, 3])::BIGINT AS geo_ref) g
)"""


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("label").alias("keyframe")).distinct()
    k = k.withColumn("geo_ref", F.explode(F.array(*[F.lit(g).cast("long") for g in range(4)])))
    a = F.col("keyframe") * 0.15
    return k.select(
        "geo_ref", "keyframe", (F.col("keyframe") * 1.5).alias("px"), F.lit(1.6).alias("py"), (F.col("keyframe") * -0.5).alias("pz"),
        F.cos(a).alias("qw"), F.lit(0.0).alias("qx"), F.sin(a).alias("qy"), F.lit(0.0).alias("qz"),
    )


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of a map with their similarity to vec_id 0, their place and their camera's."""
    c, p = candidates(spark, sf_dir), poses(spark, sf_dir)
    q = c.where("id = 0").limit(1).select(F.col("embedding").alias("q"))
    from terravane.functions import vectors as V

    rows = c.join(F.broadcast(q)).join(F.broadcast(p), ["geo_ref", "keyframe"])
    return rows.select(
        "geo_ref", "id", "keyframe", "level", "embedding", (V.dot(F.col("embedding"), F.col("q")) + 0.5).alias("similarity"),
        F.when(F.col("placed"), G.xyz(F.col("x"), F.col("y"), F.col("z"))).alias("position"), G.xyz(F.col("px"), F.col("py"), F.col("pz")).alias("origin"),
        F.lit(0.0).alias("positive"), F.lit(0.0).alias("negative"),
    )


POINTS = """points AS (
    SELECT c_custkey AS id, 48.85 + (c_custkey * 37 % 1009) * 0.00002 AS lat, 2.35 + (c_custkey * 53 % 997) * 0.00003 AS lng,
           c_mktsegment AS class_name, 'p' || (c_custkey % 4)::VARCHAR AS prompt, 3.0 + c_custkey % 5 AS accuracy, c_custkey % 3 AS level
    FROM customer
)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    k = F.col("c_custkey")
    return c.select(
        k.alias("id"), (48.85 + (k * 37 % 1009) * 0.00002).alias("lat"), (2.35 + (k * 53 % 997) * 0.00003).alias("lng"), F.col("c_mktsegment").alias("class_name"),
        F.concat(F.lit("p"), (k % 4).cast("string")).alias("prompt"), (3.0 + k % 5).alias("accuracy"), (k % 3).alias("level"),
    )


PREDICTIONS = """predictions AS (
    SELECT p_partkey AS id, 48.85 + (p_partkey * 41 % 1013) * 0.00002 AS lat, 2.35 + (p_partkey * 59 % 991) * 0.00003 AS lng,
           'p' || (p_partkey % 4)::VARCHAR AS prompt, (p_partkey * 7 % 101) / 100.0 AS score, p_partkey % 4 AS level
    FROM part
)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    k = F.col("p_partkey")
    return p.select(
        k.alias("id"), (48.85 + (k * 41 % 1013) * 0.00002).alias("lat"), (2.35 + (k * 59 % 991) * 0.00003).alias("lng"),
        F.concat(F.lit("p"), (k % 4).cast("string")).alias("prompt"), ((k * 7 % 101) / 100.0).cast("double").alias("score"), (k % 4).alias("level"),
    )


BOXES = """boxes AS (
    SELECT l_orderkey * 8 + l_linenumber AS id, l_suppkey % 50 AS keyframe, (l_partkey * 13 % 90)::DOUBLE AS x0, (l_partkey * 7 % 80)::DOUBLE AS y0,
           (l_partkey * 13 % 90 + 4 + l_quantity)::DOUBLE AS x1, (l_partkey * 7 % 80 + 3 + l_linenumber * 5)::DOUBLE AS y1,
           l_discount + l_tax AS score, l_returnflag AS label, l_shipmode_or AS source
    FROM (SELECT *, CASE l_linenumber % 4 WHEN 0 THEN 'yolo' WHEN 1 THEN 'G-DINO' WHEN 2 THEN 'sam' ELSE NULL END AS l_shipmode_or FROM lineitem)
)"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    p, n = F.col("l_partkey"), F.col("l_linenumber")
    return li.select(
        (F.col("l_orderkey") * 8 + n).alias("id"), (F.col("l_suppkey") % 50).alias("keyframe"), (p * 13 % 90).cast("double").alias("x0"), (p * 7 % 80).cast("double").alias("y0"),
        (p * 13 % 90 + 4 + F.col("l_quantity")).cast("double").alias("x1"), (p * 7 % 80 + 3 + n * 5).cast("double").alias("y1"),
        (F.col("l_discount") + F.col("l_tax")).alias("score"), F.col("l_returnflag").alias("label"),
        F.when(n % 4 == 0, "yolo").when(n % 4 == 1, "G-DINO").when(n % 4 == 2, "sam").alias("source"),
    )


HAVERSINE = "2 * 6371008.8 * atan2(sqrt({h}), sqrt(greatest(0.0, 1 - ({h}))))"


def haversine_sql(a: str, b: str, c: str, d: str) -> str:
    h = f"pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2)"
    return HAVERSINE.format(h=h)


def greedy_sql(rows: str, keys: str, order: str, clash: str, columns: str) -> str:
    """What stays of `rows` (a table, in scope) when each row, in order, goes if it clashes with one that stays: keys and columns.

    clash: a condition on the row (its columns) and a row k that stays (k['column']); columns: what a row that stays is remembered by.
    """
    names = [c.strip() for c in keys.split(",")]
    same = " AND ".join(f"n.{c} = g.{c}" for c in names)
    own = ", ".join(f"'{c.strip()}': {c.strip()}" for c in columns.split(","))
    return f"""placed AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS rn FROM {rows}),
        greedy AS (
            SELECT {keys}, rn, [{{{own}}}] AS kept FROM placed WHERE rn = 1
            UNION ALL
            SELECT {', '.join(f'n.{c}' for c in names)}, n.rn,
                   CASE WHEN len(list_filter(g.kept, lambda k: {clash})) = 0 THEN list_append(g.kept, {{{own}}}) ELSE g.kept END
            FROM greedy g JOIN placed n ON {same} AND n.rn = g.rn + 1
        ), stay AS (SELECT {keys}, unnest(kept) AS k FROM (SELECT {keys}, arg_max(kept, rn) AS kept FROM greedy GROUP BY {keys}))"""


def iou_sql(limit: str) -> str:
    """Whether the overlap of a row's box and of k's breaks a limit, such as '>= 0.3'."""
    inter = "(greatest(0, least(x1, k['x1']) - greatest(x0, k['x0'])) * greatest(0, least(y1, k['y1']) - greatest(y0, k['y0'])))"
    return f"{inter} / ((x1 - x0) * (y1 - y0) + (k['x1'] - k['x0']) * (k['y1'] - k['y0']) - {inter}) {limit}"
