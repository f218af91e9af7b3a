"""Retrieval, enrichment and ranking over `embeddings`; vec_id 0 stands for the query's vector."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.functions import metrics as M
from terravane.functions import vectors as V
from terravane.operators import enrichment as E
from terravane.operators import explorer as X
from terravane.operators import ranking as R
from terravane.plans import inputs as I

DOT = "list_dot_product(e.embedding::DOUBLE[], q.v::DOUBLE[])"
HITS = f"""hits AS (
    SELECT e.vec_id AS id, e.label AS keyframe, {DOT} AS similarity
    FROM embeddings e, (SELECT embedding AS v FROM embeddings WHERE vec_id = 0) q
)"""
RATIO = "greatest(0.0, least(1.0, CASE WHEN max(similarity) OVER () > 1e-6 THEN similarity / max(similarity) OVER () ELSE 1.0 END))"


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate with its similarity to the query vector, one row that is broadcast."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    q = e.where("vec_id = 0").limit(1).select(F.col("embedding").alias("v"))
    return e.join(F.broadcast(q)).select(F.col("vec_id").alias("id"), F.col("label").alias("keyframe"), V.dot(F.col("embedding"), F.col("v")).alias("similarity"))


def flagship_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top candidates of the query, prefiltered, grouped by keyframe, scored by ratio and ranked."""
    top = R.prefilter(hits(spark, sf_dir), [], most=200)
    groups = top.groupBy("keyframe").agg(F.max("similarity").alias("similarity"), F.count("*").alias("n_observations"))
    ranked = R.rank_clusters(groups, [], min_similarity=0.0, limit=20, id_col="keyframe")
    return ranked.select("keyframe", F.round("similarity", 6).alias("similarity"), F.round("match_score", 6).alias("match_score"), "n_observations", "rank")


def exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 nearest by L2, as cosines."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    q = e.where("vec_id = 0").limit(1).select(F.col("embedding").alias("v"))
    d = e.join(F.broadcast(q)).select(F.col("vec_id").alias("id"), V.similarity_of_distance(V.l2(F.col("embedding"), F.col("v"))).alias("similarity"))
    return R.top_candidates(d, 50, []).select("id", F.round("similarity", 6).alias("similarity"))


def prefilter_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.prefilter(hits(spark, sf_dir), []).select("id", F.round("similarity", 6).alias("similarity"))


def per_map_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hits(spark, sf_dir).withColumn("geo_ref", F.col("id") % 3)
    return R.top_candidates(h, 7, ["geo_ref"]).select("geo_ref", "id", F.round("similarity", 6).alias("similarity"))


def keyframe_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best score of each keyframe over the union of two lists of hits, the 10 best keyframes."""
    h = hits(spark, sf_dir)
    both = X.merged_best([h.where("id % 2 = 0").select("keyframe", "similarity"), h.where("id % 3 = 0").select("keyframe", "similarity")], "keyframe", "similarity")
    return both.orderBy(F.desc("similarity"), "keyframe").limit(10).select("keyframe", F.round("similarity", 6).alias("similarity"))


def enriched_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = I.candidates(spark, sf_dir).withColumn("position", F.when(F.col("placed"), F.struct("x", "y", "z")))
    h = R.top_candidates(hits(spark, sf_dir), 300, []).select("id", (F.col("id") % 3).alias("geo_ref"), "similarity")
    r = E.enrich(h, c.select("geo_ref", "id", "keyframe", "position", "source"), I.poses(spark, sf_dir))
    b = lambda c, n: F.round(c, n)
    return r.select("geo_ref", "id", "keyframe", b("similarity", 4).alias("similarity"), *[b(f"position.{k}", 3).alias(k) for k in "xyz"], b("px", 3).alias("px"), b("pz", 3).alias("pz"), "source")


def index_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = I.candidates(spark, sf_dir).withColumn("position", F.when(F.col("placed"), F.col("x")))
    return E.coverage(c, I.poses(spark, sf_dir))


def keyframe_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = I.candidates(spark, sf_dir).withColumn("position", F.when(F.col("placed"), F.col("x")))
    v = E.coverage(c.where("keyframe % 4 <> 1"), I.poses(spark, sf_dir))
    return v.select("geo_ref", "keyframe", X.keyframe_state(F.lit(5), F.when(F.col("keyframe") % 5 != 0, F.col("n_rows")), F.col("keyframe") % 3 != 2).alias("state"))


def feedback_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prototype similarities by map, as distances from their median, boosting the similarity."""
    c = I.candidates(spark, sf_dir).select("geo_ref", "id", "embedding")
    pos, neg = c.where("id IN (3, 10, 17, 24)"), c.where("id IN (4, 7)")
    both = E.prototype_similarity(E.prototype_similarity(c, pos.select("geo_ref", "embedding"), "positive"), neg.select("geo_ref", "embedding"), "negative")
    top = both.join(hits(spark, sf_dir).select("id", "similarity"), "id")
    scored = E.normalised_scores(top, ["geo_ref"], ["positive", "negative"])
    r = lambda n: F.round(n, 5).alias(n)
    return scored.select("geo_ref", "id", r("positive"), r("negative"), F.round(M.boosted(F.col("similarity"), F.col("positive"), F.col("negative"), 0.2, 0.1), 5).alias("boosted"))


def kept_keyframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, p = I.candidates(spark, sf_dir).select("geo_ref", "id", "keyframe"), I.poses(spark, sf_dir).where("keyframe % 2 = 0")
    return E.kept_only(c, p, ["geo_ref", "keyframe"])


def missing_keyframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, p = I.candidates(spark, sf_dir).select("geo_ref", "keyframe").distinct(), I.poses(spark, sf_dir)
    return E.missing(p.select("geo_ref", "keyframe"), c, ["geo_ref", "keyframe"])


def rank_with_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = hits(spark, sf_dir).groupBy(F.col("keyframe").alias("cluster_id")).agg(F.max("similarity").alias("similarity"))
    r = R.rank_clusters(g, [], 0.05, 8)
    return r.select("cluster_id", F.round("similarity", 6).alias("similarity"), F.round("match_score", 6).alias("match_score"), "rank")


def observation_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terravane.operators import association as A

    c = hits(spark, sf_dir).withColumn("cluster_id", F.col("keyframe").cast("long") - 1)
    seen = A.observations(c, [], 5)
    return seen.select("cluster_id", "place", "id", F.round("similarity", 6).alias("similarity"))


def cluster_keyframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terravane.operators import association as A

    c = hits(spark, sf_dir).select((F.col("id") % 6 - 1).alias("cluster_id"), "keyframe")
    return A.keyframe_sets(c, []).select("cluster_id", F.array_join("keyframe_ids", ",").alias("keyframe_ids"))


def supported_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters that enough keyframes saw, numbered anew."""
    from terravane.operators import association as A

    c = hits(spark, sf_dir).select("id", "keyframe", (F.floor(F.col("id") / 9) % 40 - 1).cast("long").alias("cluster_id"))
    return A.supported(c, [], 7).select("id", "cluster_id")


def fallback_match_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = hits(spark, sf_dir).groupBy("keyframe").agg(F.max("similarity").alias("similarity"), (F.count("*") % 5).alias("n_keyframes"))
    g = g.withColumn("match_score", F.when(F.col("keyframe") % 3 == 0, F.lit(0.5))).withColumn("confidence", F.col("keyframe") / 10.0)
    return X.fallback_scores(g, []).select("keyframe", F.round("match_score", 6).alias("match_score"))


def legacy_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = hits(spark, sf_dir).groupBy("keyframe").agg(F.max("similarity").alias("similarity"), (F.count("*") / 100.0).alias("support"))
    s = X.legacy_scores(g, [], 0.1, {})
    s = s.withColumn("score", 0.65 * F.col("relative") + 0.35 * F.least(F.lit(1.0), F.col("support")))
    return s.select("keyframe", F.round("relative", 6).alias("relative"), F.round("score", 6).alias("score"))


def latent_explorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarities with several prompts: whether they are active, their rank, and a point's size."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    prompts = e.where("vec_id < 3").select(F.col("vec_id").alias("prompt"), F.col("embedding").alias("v"))
    s = e.join(F.broadcast(prompts)).select("prompt", F.col("vec_id").alias("id"), V.cosine(F.col("embedding"), F.col("v")).alias("similarity"))
    from pyspark.sql.window import Window

    w = Window.partitionBy("prompt")
    low, high = F.min("similarity").over(w), F.max("similarity").over(w)
    size = F.when(high > low, (F.col("similarity") - low) / F.when(high > low, high - low)).otherwise(F.lit(0.0))
    s = s.withColumn("size", size).withColumn("rank", F.row_number().over(w.orderBy(F.desc("similarity"), "id"))).where("rank <= 25")
    return s.select("prompt", "id", F.round("similarity", 5).alias("similarity"), (F.col("similarity") >= 0.1).alias("active"), "rank", F.round("size", 5).alias("size"))


def textness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best cosine with text prompts less the best with other ones."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    p = e.where("vec_id IN (1, 2)").agg(F.collect_list("embedding").alias("yes")).crossJoin(e.where("vec_id IN (5, 6)").agg(F.collect_list("embedding").alias("no")))
    best = lambda c: F.array_max(F.transform(c, lambda v: V.dot(F.col("embedding"), v)))
    return e.crossJoin(F.broadcast(p)).select(F.col("vec_id").alias("id"), F.round(best("yes") - best("no"), 5).alias("textness"))


QUERIES = {f.__name__: f for f in (flagship_search, exact_top_k, prefilter_hits, per_map_top_k, keyframe_best, enriched_candidates, index_coverage, keyframe_states, feedback_boost, kept_keyframes, missing_keyframes, rank_with_floor, observation_lists, cluster_keyframes, supported_clusters, fallback_match_scores, legacy_mixture, latent_explorer, textness)}
_BOTH = f"{I.CANDIDATES}, {I.POSES}"
_COVER = "SELECT p.geo_ref, p.keyframe, count(c.id) AS n_rows, count(c.id) FILTER (NOT c.placed) AS n_unplaced FROM poses p LEFT JOIN candidates c ON p.geo_ref = c.geo_ref AND p.keyframe = c.keyframe {w} GROUP BY ALL"
_PROTO = "(SELECT max(1 - pow(list_distance(c.embedding::DOUBLE[], p.embedding::DOUBLE[]), 2) / 2) FROM candidates p WHERE p.geo_ref = c.geo_ref AND p.id IN ({ids}))"
ORACLE_SQL = {
    "flagship_search": f"""WITH {HITS}, ordered AS (
            SELECT *, row_number() OVER (ORDER BY similarity DESC, id) AS rn,
                   sum(CASE WHEN similarity >= 0.3 * best THEN 1 ELSE 0 END) OVER () AS n
            FROM (SELECT *, max(similarity) OVER () AS best FROM hits)
        ), groups AS (
            SELECT keyframe, max(similarity) AS similarity, count(*) AS n_observations
            FROM ordered WHERE rn <= 2 * n AND rn <= 200 GROUP BY keyframe
        ), scored AS (SELECT *, {RATIO} AS match_score FROM groups WHERE similarity >= 0.0)
        SELECT keyframe, round(similarity, 6) AS similarity, round(match_score, 6) AS match_score, n_observations,
               (row_number() OVER (ORDER BY match_score DESC, similarity DESC, keyframe))::INTEGER AS rank
        FROM scored QUALIFY rank <= 20""",
    "exact_top_k": """SELECT e.vec_id AS id, round(1 - pow(list_distance(e.embedding::DOUBLE[], q.v::DOUBLE[]), 2) / 2, 6) AS similarity
        FROM embeddings e, (SELECT embedding AS v FROM embeddings WHERE vec_id = 0) q
        ORDER BY 1 - pow(list_distance(e.embedding::DOUBLE[], q.v::DOUBLE[]), 2) / 2 DESC, id LIMIT 50""",
    "prefilter_hits": f"""WITH {HITS}, o AS (SELECT *, row_number() OVER (ORDER BY similarity DESC, id) AS rn, max(similarity) OVER () AS best FROM hits)
        SELECT id, round(similarity, 6) AS similarity FROM o WHERE rn <= 2 * (SELECT count(*) FROM o WHERE similarity >= 0.3 * best)""",
    "per_map_top_k": f"WITH {HITS} SELECT id % 3 AS geo_ref, id, round(similarity, 6) AS similarity FROM hits QUALIFY row_number() OVER (PARTITION BY id % 3 ORDER BY similarity DESC, id) <= 7",
    "keyframe_best": f"WITH {HITS} SELECT keyframe, round(max(similarity), 6) AS similarity FROM hits WHERE id % 2 = 0 OR id % 3 = 0 GROUP BY keyframe ORDER BY max(hits.similarity) DESC, keyframe LIMIT 10",
    "enriched_candidates": f"""WITH {_BOTH}, {HITS}
        SELECT c.geo_ref, c.id, c.keyframe, round(h.similarity, 4) AS similarity, round(x, 3) AS x, round(y, 3) AS y, round(z, 3) AS z, round(px, 3)::DOUBLE AS px, round(pz, 3)::DOUBLE AS pz, source
        FROM (SELECT * FROM hits ORDER BY similarity DESC, id LIMIT 300) h JOIN candidates c ON c.id = h.id JOIN poses p ON p.geo_ref = c.geo_ref AND p.keyframe = c.keyframe WHERE placed""",
    "index_coverage": f"WITH {_BOTH} {_COVER.format(w='')}",
    "keyframe_states": f"""WITH {_BOTH}, v AS ({_COVER.format(w='AND c.keyframe % 4 <> 1')})
        SELECT geo_ref, keyframe, CASE WHEN keyframe % 3 = 2 THEN 'not-prepared' WHEN keyframe % 5 = 0 THEN 'unknown' WHEN n_rows > 0 THEN 'indexed' ELSE 'pruned' END AS state FROM v""",
    "feedback_boost": f"""WITH {I.CANDIDATES}, {HITS}, p AS (
            SELECT c.geo_ref, c.id, h.similarity, {_PROTO.format(ids='3, 10, 17, 24')} AS a, {_PROTO.format(ids='4, 7')} AS b FROM candidates c JOIN hits h USING (id)
        ), m AS (SELECT *, median(a) OVER w AS ma, median(b) OVER w AS mb FROM p WINDOW w AS (PARTITION BY geo_ref)
        ), d AS (SELECT *, 1.4826 * median(abs(a - ma)) OVER w AS da, 1.4826 * median(abs(b - mb)) OVER w AS db FROM m WINDOW w AS (PARTITION BY geo_ref)
        ), s AS (SELECT *, CASE WHEN a IS NULL THEN NULL WHEN da > 1e-9 THEN (a - ma) / da ELSE 0.0 END AS positive, CASE WHEN b IS NULL THEN NULL WHEN db > 1e-9 THEN (b - mb) / db ELSE 0.0 END AS negative FROM d)
        SELECT geo_ref, id, round(positive, 5) AS positive, round(negative, 5) AS negative,
               round(greatest(-1.0, least(1.0, similarity + 0.2 * coalesce(positive, 0) - 0.1 * coalesce(negative, 0))), 5) AS boosted FROM s""",
    "kept_keyframes": f"WITH {I.CANDIDATES} SELECT geo_ref, id, keyframe FROM candidates WHERE keyframe % 2 = 0",
    "missing_keyframes": f"WITH {_BOTH} SELECT geo_ref, keyframe FROM poses EXCEPT SELECT geo_ref, keyframe FROM candidates",
    "rank_with_floor": f"""WITH {HITS}, g AS (SELECT keyframe AS cluster_id, max(similarity) AS similarity FROM hits GROUP BY keyframe), s AS (SELECT *, {RATIO} AS match_score FROM g WHERE similarity >= 0.05)
        SELECT cluster_id, round(similarity, 6) AS similarity, round(match_score, 6) AS match_score, (row_number() OVER (ORDER BY match_score DESC, similarity DESC, cluster_id))::INTEGER AS rank FROM s QUALIFY rank <= 8""",
    "observation_lists": f"""WITH {HITS} SELECT (keyframe - 1)::BIGINT AS cluster_id, (row_number() OVER (PARTITION BY keyframe ORDER BY similarity DESC, id))::INTEGER AS place, id, round(similarity, 6) AS similarity
        FROM hits WHERE keyframe >= 1 QUALIFY place <= 5""",
    "cluster_keyframes": f"WITH {HITS} SELECT id % 6 - 1 AS cluster_id, string_agg(DISTINCT keyframe::VARCHAR, ',' ORDER BY keyframe::VARCHAR) AS keyframe_ids FROM hits WHERE id % 6 >= 1 GROUP BY 1",
    "supported_clusters": f"""WITH {HITS}, c AS (SELECT id, keyframe, (id // 9) % 40 - 1 AS k FROM hits), s AS (SELECT k, dense_rank() OVER (ORDER BY k) - 1 AS n FROM c WHERE k >= 0 GROUP BY k HAVING count(DISTINCT keyframe) >= 7)
        SELECT id, coalesce(n, -1) AS cluster_id FROM c LEFT JOIN s USING (k)""",
    "fallback_match_scores": f"""WITH {HITS}, g AS (SELECT keyframe, max(similarity) AS s, count(*) % 5 AS k FROM hits GROUP BY keyframe)
        SELECT keyframe, round(coalesce(CASE WHEN keyframe % 3 = 0 THEN 0.5 END, 0.5 * CASE WHEN max(s) OVER () > 0 THEN s / max(s) OVER () ELSE 0 END + 0.3 * keyframe / 10.0 + 0.2 * least(1.0, k / 3.0)), 6)::DOUBLE AS match_score FROM g""",
    "legacy_mixture": f"""WITH {HITS}, g AS (SELECT keyframe, max(similarity) AS s, count(*) / 100.0 AS n FROM hits GROUP BY keyframe),
        r AS (SELECT *, CASE WHEN max(s) OVER () - 0.1 > 1e-6 THEN greatest(0.0, least(1.0, (s - 0.1) / (max(s) OVER () - 0.1))) ELSE 1.0 END AS relative FROM g)
        SELECT keyframe, round(relative, 6) AS relative, round(0.65 * relative + 0.35 * least(1.0, n), 6) AS score FROM r""",
    "latent_explorer": """WITH s AS (SELECT p.vec_id AS prompt, e.vec_id AS id, list_cosine_similarity(e.embedding::DOUBLE[], p.embedding::DOUBLE[]) AS similarity FROM embeddings e, embeddings p WHERE p.vec_id < 3)
        SELECT prompt, id, round(similarity, 5) AS similarity, similarity >= 0.1 AS active, (row_number() OVER (PARTITION BY prompt ORDER BY similarity DESC, id))::INTEGER AS rank,
               round((similarity - min(similarity) OVER w) / (max(similarity) OVER w - min(similarity) OVER w), 5) AS size FROM s WINDOW w AS (PARTITION BY prompt) QUALIFY rank <= 25""",
    "textness": """SELECT e.vec_id AS id, round(max(list_dot_product(e.embedding::DOUBLE[], p.embedding::DOUBLE[])) FILTER (p.vec_id < 3) - max(list_dot_product(e.embedding::DOUBLE[], p.embedding::DOUBLE[])) FILTER (p.vec_id > 3), 5) AS textness
        FROM embeddings e, embeddings p WHERE p.vec_id IN (1, 2, 5, 6) GROUP BY e.vec_id""",
}
