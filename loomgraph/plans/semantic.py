"""Queries of neighborhoods and clusters: brands of a parity of size as neighborhoods, part names as their files."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import ladders
from loomgraph.functions import paths as P
from loomgraph.operators import cochange as C
from loomgraph.operators import neighborhoods as N
from loomgraph.plans.cochange import CONFIDENCE, MINED, RELATED, STEPS, SUPPORT
from loomgraph.plans.relations import brand_commits, table

OVERLAP, LEAST, CLUSTERS, MOST = 0.4, 0.3, 6, 15
METRICS = ("nearest", "farthest", "density", "cohesion", "strength", "silhouette", "davies_bouldin", "calinski_harabasz")


def members(spark, d, column):
    p = table(spark, d, "part")
    ident = F.concat(F.col("p_brand"), F.lit("/"), (F.col("p_size") % 2).cast("string"))
    return p.select(ident.alias("id"), column.alias("m")).groupBy("id").agg(F.sort_array(F.collect_set("m")).alias("members"))


def neighborhoods_in(spark, d):
    p = table(spark, d, "part")
    ident = F.concat(F.col("p_brand"), F.lit("/"), (F.col("p_size") % 2).cast("string"))
    return p.groupBy(ident.alias("id")).agg(F.round(F.avg("p_size") / 50, 6).alias("strength"), F.sort_array(F.collect_set("p_name")).alias("members"))


def deps(spark, d):
    return members(spark, d, F.concat_ws(">", "p_type", (F.col("p_size") % 10).cast("string")))


def patterns(spark, d):
    return members(spark, d, P.naming_patterns(F.col("p_name"))[0])


def structural_similarity(spark, d):
    return N.shared_members(neighborhoods_in(spark, d)).select("a", "b", "both", F.round("jaccard", 6).alias("jaccard"))


def merge_similar(spark, d):
    return N.merge_similar(neighborhoods_in(spark, d), OVERLAP).select("id", "strength", F.size("members").alias("files"))


def neighborhoods(spark, d):
    kept = N.merge_similar(neighborhoods_in(spark, d), OVERLAP)
    return kept.orderBy(F.desc("strength"), "id").limit(15).select("id", "strength", F.size("members").alias("files"))


def analysis_summary(spark, d):
    """Files, neighborhoods, patterns and relationships of the whole history in one row."""
    brands = brand_commits(spark, d)
    return N.summary(neighborhoods_in(spark, d), C.mine_pairs(brands, SUPPORT, CONFIDENCE), C.file_relationships(brands, steps=STEPS))


def similar_sets(spark, d):
    """Part types as sets of their brands and sizes, compared by prefixes."""
    p = table(spark, d, "part")
    sets = p.select(F.concat("p_type", F.lit("/"), (F.col("p_size") % 5).cast("string")).alias("id"), F.col("p_brand").alias("m")).groupBy("id").agg(F.collect_set("m").alias("members"))
    return N.similar_sets(sets, 0.5).select("a", "b", "both", F.round("jaccard", 6).alias("jaccard"))


def recommendations(spark, d):
    return N.strongest(neighborhoods_in(spark, d)).select("file", "id", F.size("others").alias("others"), "strength", "priority")


def enhanced_score(spark, d):
    edges = N.cluster_edges(neighborhoods_in(spark, d), deps(spark, d), patterns(spark, d), LEAST)
    ends = edges.select(F.explode(F.array("a", "b")).alias("id"), "weight").groupBy("id").agg(F.avg("weight").alias("dep"))
    near = N.shared_members(neighborhoods_in(spark, d)).select(F.explode(F.array("a", "b")).alias("id"), "jaccard").groupBy("id").agg(F.avg("jaccard").alias("struct"))
    found = neighborhoods_in(spark, d).join(ends, "id", "left").join(near, "id", "left")
    score = N.combined_score(F.col("strength"), F.col("dep"), F.col("struct"))
    return found.select("id", F.round(score, 6).alias("score"), ladders.recommendation_strength(score).alias("recommendation"), ladders.quality_rating(score).alias("quality")).where("score >= 0.4")


def weights(spark, d):
    return N.cluster_edges(neighborhoods_in(spark, d), deps(spark, d), patterns(spark, d), LEAST)


def cluster_edges(spark, d):
    return weights(spark, d).select("a", "b", F.round("weight", 6).alias("weight"), "type")


def distances(spark, d):
    return weights(spark, d).select("a", "b", (1 - F.round("weight", 9)).alias("distance"))


def clusters(spark, d):
    return N.single_linkage(neighborhoods_in(spark, d).select("id"), distances(spark, d), CLUSTERS)


def cluster_metrics(spark, d):
    scores = neighborhoods_in(spark, d).select("id", F.col("strength").alias("score"))
    found = N.cluster_metrics(clusters(spark, d), scores, distances(spark, d))
    return found.select("cluster", "size", *(F.round(c, 6).alias(c) for c in METRICS))


def clusters_of_size(spark, d):
    """The best neighborhoods in as many clusters as their number asks for; pairs without an edge have a distance too."""
    nodes = neighborhoods_in(spark, d).select("id", F.col("strength").alias("score"), "strength")
    top = nodes.orderBy(F.desc("score"), "id").limit(MOST)
    k = top.agg(ladders.optimal_clusters(F.count("*")).alias("k")).first()["k"]
    return N.single_linkage(top, N.with_unlinked(nodes, distances(spark, d), MOST).withColumn("distance", F.round("distance", 9)), k)


def optimal_k(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("n"), ladders.optimal_clusters(F.col("c_custkey")).alias("k"))


QUERIES = {f.__name__: f for f in (structural_similarity, similar_sets, analysis_summary, merge_similar, neighborhoods, recommendations, enhanced_score, cluster_edges, clusters, cluster_metrics, clusters_of_size, optimal_k)}

SETS = """i AS (SELECT p_brand || '/' || (p_size % 2) AS id, * FROM part), hood AS (SELECT id, round(avg(p_size) / 50, 6) AS strength, count(DISTINCT p_name) AS files FROM i GROUP BY 1),
    m_git AS (SELECT DISTINCT id, p_name AS m FROM i), m_dep AS (SELECT DISTINCT id, p_type || '>' || (p_size % 10) AS m FROM i), m_struct AS (SELECT DISTINCT id, 'prefix_' || left(p_name, 3) AS m FROM i)"""


def _jaccard_sql(name: str) -> str:
    return f"""j_{name} AS (SELECT a, b, both_n, both_n::DOUBLE / (x.n + y.n - both_n) AS j FROM (SELECT p.id AS a, q.id AS b, count(*) AS both_n FROM m_{name} p JOIN m_{name} q ON p.m = q.m AND p.id < q.id GROUP BY 1, 2)
        JOIN (SELECT id, count(*) AS n FROM m_{name} GROUP BY 1) x ON x.id = a JOIN (SELECT id, count(*) AS n FROM m_{name} GROUP BY 1) y ON y.id = b)"""


WEIGHTS = f"""{SETS}, {_jaccard_sql("git")}, {_jaccard_sql("dep")}, {_jaccard_sql("struct")},
    w AS (SELECT a, b, coalesce(g.j, 0) AS g, coalesce(dd.j, 0) AS dp, coalesce(s.j, 0) AS st, 0.0::DOUBLE + coalesce(g.j, 0) * 0.6::DOUBLE + coalesce(dd.j, 0) * 0.3::DOUBLE + coalesce(s.j, 0) * 0.1::DOUBLE AS weight
        FROM j_git g FULL JOIN j_dep dd USING (a, b) FULL JOIN j_struct s USING (a, b)),
    edges AS (SELECT a, b, weight, CASE WHEN dp >= st AND dp >= g THEN 'dependency' WHEN st >= g THEN 'structural' ELSE 'git_pattern' END AS type FROM w WHERE weight > {LEAST})"""
GREEDY = f"""WITH RECURSIVE {SETS}, {_jaccard_sql("git")}, r AS (SELECT *, row_number() OVER (ORDER BY strength DESC, id) AS rank FROM hood),
    conf AS (SELECT least(x.rank, y.rank) AS lo, greatest(x.rank, y.rank) AS hi FROM j_git JOIN r x ON x.id = a JOIN r y ON y.id = b WHERE j > {OVERLAP}),
    blocks AS (SELECT hi, list(lo) AS los FROM conf GROUP BY 1),
    g AS (SELECT 0::BIGINT AS pos, []::BIGINT[] AS kept UNION ALL
        SELECT g.pos + 1, CASE WHEN list_has_any(coalesce(los, []::BIGINT[]), kept) THEN kept ELSE list_append(kept, g.pos + 1) END FROM g LEFT JOIN blocks ON hi = g.pos + 1 WHERE g.pos < (SELECT count(*) FROM r)),
    kept AS (SELECT unnest(kept) AS rank FROM g WHERE pos = (SELECT count(*) FROM r))"""
LINKED = f"""WITH RECURSIVE {WEIGHTS}, dist AS (SELECT a, b, 1 - round(weight, 9) AS distance FROM edges), n AS (SELECT list(id ORDER BY id) AS ids FROM hood),
    ranked AS (SELECT *, row_number() OVER (ORDER BY distance, a, b) AS k FROM dist),
    link AS (SELECT 0::BIGINT AS k, ids AS labels FROM n UNION ALL
        SELECT r.k, list_transform(labels, lambda x: CASE WHEN x = greatest(labels[list_position(ids, r.a)], labels[list_position(ids, r.b)]) THEN least(labels[list_position(ids, r.a)], labels[list_position(ids, r.b)]) ELSE x END)
        FROM link l JOIN ranked r ON r.k = l.k + 1, n WHERE list_unique(labels) > {CLUSTERS}),
    final AS (SELECT unnest(ids) AS id, unnest(labels) AS cluster FROM (SELECT * FROM link ORDER BY k DESC LIMIT 1), n)"""
ORACLES = {
    "structural_similarity": f"WITH {SETS}, {_jaccard_sql('git')} SELECT a, b, both_n AS both, round(j, 6) AS jaccard FROM j_git",
    "analysis_summary": f"""WITH a AS ({MINED} SELECT count(*) AS patterns FROM mined), b AS ({RELATED} SELECT count(*) FILTER (strength = 'strong') AS strong, count(*) FILTER (strength = 'moderate') AS moderate, count(*) FILTER (strength = 'weak') AS weak FROM laddered)
        SELECT (SELECT count(DISTINCT p_name) FROM part) AS files, (SELECT count(*) FROM (SELECT DISTINCT p_brand, p_size % 2 FROM part)) AS neighborhoods, patterns, strong, moderate, weak FROM a, b""",
    "similar_sets": """WITH s AS (SELECT DISTINCT p_type || '/' || (p_size % 5) AS id, p_brand AS m FROM part), n AS (SELECT id, count(*) AS n FROM s GROUP BY 1),
        j AS (SELECT x.id AS a, y.id AS b, count(*) AS both_n FROM s x JOIN s y ON x.m = y.m AND x.id < y.id GROUP BY 1, 2)
        SELECT a, b, both_n AS "both", round(both_n::DOUBLE / (na.n + nb.n - both_n), 6) AS jaccard FROM j JOIN n na ON na.id = a JOIN n nb ON nb.id = b WHERE both_n::DOUBLE / (na.n + nb.n - both_n) >= 0.5""",
    "merge_similar": f"{GREEDY} SELECT id, strength, files::INTEGER AS files FROM r JOIN kept USING (rank)",
    "neighborhoods": f"{GREEDY} SELECT id, strength, files::INTEGER AS files FROM r JOIN kept USING (rank) ORDER BY strength DESC, id LIMIT 15",
    "recommendations": f"""WITH {SETS}, b AS (SELECT m AS file, id, strength, files, row_number() OVER (PARTITION BY m ORDER BY strength DESC, id DESC) AS k FROM m_git JOIN hood USING (id))
        SELECT file, id, (files - 1)::INTEGER AS others, strength, CASE WHEN strength >= 0.8 THEN 'high' WHEN strength >= 0.6 THEN 'medium' ELSE 'low' END AS priority FROM b WHERE k = 1""",
    "enhanced_score": f"""WITH {WEIGHTS}, dep AS (SELECT id, avg(weight) AS dep FROM (SELECT a AS id, weight FROM edges UNION ALL SELECT b, weight FROM edges) GROUP BY 1),
        st AS (SELECT id, avg(j) AS st FROM (SELECT a AS id, j FROM j_git UNION ALL SELECT b, j FROM j_git) GROUP BY 1),
        s AS (SELECT id, (strength * 0.6 + coalesce(dep, 0) * 0.3 + coalesce(st, 0) * 0.1) / (0.6 + CASE WHEN dep IS NULL THEN 0 ELSE 0.3 END + CASE WHEN st IS NULL THEN 0 ELSE 0.1 END) AS score FROM hood LEFT JOIN dep USING (id) LEFT JOIN st USING (id))
        SELECT id, round(score, 6)::DOUBLE AS score, CASE WHEN score >= 0.8 THEN 'very_strong' WHEN score >= 0.6 THEN 'strong' WHEN score >= 0.4 THEN 'moderate' ELSE 'weak' END AS recommendation,
        CASE WHEN score > 0.7 THEN 'excellent' WHEN score > 0.5 THEN 'good' WHEN score > 0.25 THEN 'fair' ELSE 'poor' END AS quality FROM s WHERE round(score, 6) >= 0.4""",
    "cluster_edges": f"WITH {WEIGHTS} SELECT a, b, round(weight, 6) AS weight, type FROM edges",
    "clusters": f"{LINKED} SELECT id, cluster FROM final",
    "cluster_metrics": f"""{LINKED}, e AS (SELECT x.cluster, count(*) AS n, avg(distance) AS mean, min(distance) AS nearest, max(distance) AS farthest FROM dist JOIN final x ON x.id = a JOIN final y ON y.id = b WHERE x.cluster = y.cluster GROUP BY 1),
        o AS (SELECT cluster, count(*) AS size, avg(strength) AS score FROM final JOIN hood USING (id) GROUP BY 1),
        q AS (SELECT cluster, size, coalesce(nearest, 0) AS nearest, coalesce(farthest, 0) AS farthest, CASE WHEN size > 1 THEN 2.0::DOUBLE * coalesce(n, 0) / (size * (size - 1)) ELSE 0 END AS density, 1 / (1 + coalesce(mean, 0)) AS cohesion, (score + 1 / (1 + coalesce(mean, 0))) / 2 AS strength FROM o LEFT JOIN e USING (cluster))
        SELECT cluster, size, round(nearest, 6) AS nearest, round(farthest, 6) AS farthest, round(density, 6) AS density, round(cohesion, 6) AS cohesion, round(strength, 6) AS strength,
            round(cohesion, 6) AS silhouette, round(1 - density, 6) AS davies_bouldin, round(strength * size, 6) AS calinski_harabasz FROM q""",
    "clusters_of_size": f"""WITH RECURSIVE {WEIGHTS}, top AS (SELECT id, strength FROM hood ORDER BY strength DESC, id LIMIT {MOST}), n AS (SELECT list(id ORDER BY id) AS ids, CASE WHEN count(*) <= 2 THEN count(*) WHEN count(*) <= 8 THEN 2 ELSE 3 END AS k FROM top),
        dist AS (SELECT x.id AS a, y.id AS b, round(coalesce(1 - round(weight, 9), abs(x.strength - y.strength)), 9) AS distance FROM top x JOIN top y ON x.id < y.id LEFT JOIN edges ON edges.a = x.id AND edges.b = y.id),
        ranked AS (SELECT *, row_number() OVER (ORDER BY distance, a, b) AS r FROM dist),
        link AS (SELECT 0::BIGINT AS r, ids AS labels FROM n UNION ALL
            SELECT ranked.r, list_transform(labels, lambda x: CASE WHEN x = greatest(labels[list_position(ids, ranked.a)], labels[list_position(ids, ranked.b)]) THEN least(labels[list_position(ids, ranked.a)], labels[list_position(ids, ranked.b)]) ELSE x END)
            FROM link l JOIN ranked ON ranked.r = l.r + 1, n WHERE list_unique(labels) > n.k)
        SELECT unnest(ids) AS id, unnest(labels) AS cluster FROM (SELECT * FROM link ORDER BY r DESC LIMIT 1), n""",
    "optimal_k": """SELECT c_custkey AS n, CASE WHEN c_custkey <= 2 THEN c_custkey WHEN c_custkey <= 8 THEN 2 WHEN c_custkey <= 16 THEN 3 WHEN c_custkey <= 32 THEN 4 WHEN c_custkey <= 64 THEN 5 WHEN c_custkey <= 100 THEN 6
        WHEN c_custkey <= 128 THEN 7 WHEN c_custkey <= 256 THEN 8 WHEN c_custkey <= 512 THEN 9 ELSE 10 END::BIGINT AS k FROM customer""",
}
