"""Queries of co-change mining."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import ladders
from loomgraph.operators import cochange as C
from loomgraph.operators.order import before_within
from loomgraph.plans.relations import BRAND_SQL, PAIRS_SQL, PART_SQL, brand_commits, part_commits, table, tasks_of
from loomgraph.shared import stored

SUPPORT, CONFIDENCE = 0.025, 0.15
#: Tasks that count pairs of parts, for each that puts lines together: an order's lines make twice as many pairs.
PAIRS = 2
STEPS = [(0.094, "strong"), (0.081, "moderate")]


def change_frequency(spark, d):
    return C.change_frequency(brand_commits(spark, d))


def last_modified(spark, d):
    return C.last_modified(brand_commits(spark, d))


def window_since(spark, d):
    """Changes in the year before the last commit; the cut-off is a scalar of the data, never the clock."""
    cf = brand_commits(spark, d)
    last = table(spark, d, "orders").agg((F.max("o_orderdate") - F.expr("interval 365 days")).alias("since"))
    return cf.crossJoin(F.broadcast(last)).where("ts >= since").groupBy("path").agg(F.count("*").alias("changes"))


def pair_mining(spark, d):
    return C.mine_pairs(brand_commits(spark, d), SUPPORT, CONFIDENCE).select("file1", "file2", "frequency", F.round("confidence", 6).alias("confidence"), F.col("last_ts").alias("last_seen"))


def change_patterns(spark, d):
    return C.change_patterns(brand_commits(spark, d), SUPPORT, CONFIDENCE)


def pattern_confidence_all(spark, d):
    return C.together_share(brand_commits(spark, d)).withColumn("share", F.round("share", 6))


def cooccurrence_ranked(spark, d):
    return C.cooccurrences(part_commits(spark, d), tasks=PAIRS * tasks_of(spark, d))


def file_relationships(spark, d):
    return C.file_relationships(brand_commits(spark, d), steps=STEPS).withColumn("correlation", F.round("correlation", 6))


def file_relationships_compat(spark, d):
    return C.file_relationships_flat(brand_commits(spark, d)).withColumn("correlation", F.round("correlation", 9))


def relationship_summary(spark, d):
    r = C.file_relationships(brand_commits(spark, d), steps=STEPS)
    return r.groupBy("strength").agg(F.count("*").alias("pairs"), F.round(F.avg("correlation"), 6).alias("mean_correlation"))


STRONG = 0.1


def strong_part_pairs(spark, d):
    """Pairs of parts ordered together at least twice, and in at least a tenth of the orders of the rarer one."""
    commits = part_commits(spark, d)
    pairs = C.pair_counts(C.commit_sets(commits), PAIRS * tasks_of(spark, d)).where("frequency >= 2")
    counts = commits.groupBy("path").agg(F.count("*").alias("c"))
    sized = pairs.join(counts.select(F.col("path").alias("file1"), F.col("c").alias("c1")), "file1").join(counts.select(F.col("path").alias("file2"), F.col("c").alias("c2")), "file2")
    return sized.where(F.col("frequency") / F.least("c1", "c2") >= STRONG).drop("c1", "c2")


def module_groups(spark, d):
    return C.module_groups(strong_part_pairs(spark, d)).select(F.col("node").alias("path"), F.col("component").alias("module"))


def module_metrics(spark, d):
    pairs = C.pair_counts(C.commit_sets(part_commits(spark, d)), PAIRS * tasks_of(spark, d)).where("frequency >= 2")
    found = C.module_metrics(C.module_groups(strong_part_pairs(spark, d)), pairs)
    return found.select(F.col("component").alias("module"), "files", "internal", "external", "changes", "last_changed", F.round("cohesion", 6).alias("cohesion"))


def module_name(spark, d):
    """A name for each part type's members: the common prefix of their names."""
    parts = table(spark, d, "part")
    ends = parts.groupBy("p_type").agg(F.min("p_name").alias("a"), F.max("p_name").alias("b"), F.count("*").alias("n"))
    same = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length("a"), F.length("b")))), F.lit(0), lambda k, i: F.when((k == i - 1) & (F.substring(F.col("a"), i, F.lit(1)) == F.substring(F.col("b"), i, F.lit(1))), i).otherwise(k))
    prefix = F.substring(F.col("a"), F.lit(1), same)
    return ends.select("p_type", F.when(F.length(prefix) > 0, F.concat(prefix, F.lit("-module"))).otherwise(F.concat(F.lit("module-"), F.col("n").cast("string"), F.lit("-files"))).alias("module_name"))


def usage_patterns(spark, d):
    found = C.mine_pairs(brand_commits(spark, d), SUPPORT, CONFIDENCE)
    return found.select("file1", "file2", ladders.usage_pattern(F.col("confidence") * 5, F.col("frequency")).alias("usage"), ladders.common_operation(F.col("frequency"), F.col("confidence") * 5).alias("operation"), ladders.reason(F.col("frequency") % 30, F.col("confidence") * 5).alias("reason"))


def cochange_lag(spark, d):
    """Days since a brand's change before, by the window that the closed form of intervals replaces."""
    gaps = before_within(stored(brand_commits(spark, d).select("path", "hash", "ts"), "changes"), "path", "ts", "ts", "hash", tasks=tasks_of(spark, d)).where("before is not null")
    days = F.date_diff(F.to_date("ts"), F.to_date("before"))
    return gaps.groupBy("path").agg(F.count("*").alias("gaps"), F.sum(days).cast("long").alias("days"), F.max(days).cast("long").alias("longest"))


QUERIES = {f.__name__: f for f in (change_frequency, last_modified, window_since, pair_mining, change_patterns, pattern_confidence_all, cooccurrence_ranked, file_relationships, file_relationships_compat, relationship_summary, module_groups, module_metrics, module_name, usage_patterns, cochange_lag)}

MINED = f"""WITH {BRAND_SQL}, big AS (SELECT hash FROM cf GROUP BY 1 HAVING count(*) >= 2),
    c2 AS (SELECT path, count(*) AS c FROM cf JOIN big USING (hash) GROUP BY 1), {PAIRS_SQL},
    total AS (SELECT greatest(1, floor(count(*) * {SUPPORT})) AS least FROM big),
    mined AS (SELECT file1, file2, n AS frequency, n::DOUBLE / greatest(x.c, y.c) AS confidence, first_ts, last_ts
        FROM pairs JOIN c2 x ON x.path = file1 JOIN c2 y ON y.path = file2, total WHERE n >= least AND n::DOUBLE / greatest(x.c, y.c) >= {CONFIDENCE})"""
RELATED = f"""WITH {BRAND_SQL}, {PAIRS_SQL}, rel AS (SELECT file1, file2, n AS frequency, x.c AS n1, y.c AS n2, n::DOUBLE / (x.c + y.c - n) AS correlation
    FROM pairs JOIN counts x ON x.path = file1 JOIN counts y ON y.path = file2 WHERE n >= 2),
    laddered AS (SELECT *, CASE WHEN correlation >= 0.094 THEN 'strong' WHEN correlation >= 0.081 THEN 'moderate' ELSE 'weak' END AS strength FROM rel)"""
MODULES = f"""WITH RECURSIVE {PART_SQL}, {PAIRS_SQL}, strong AS (SELECT pairs.* FROM pairs JOIN counts x ON x.path = file1 JOIN counts y ON y.path = file2 WHERE n >= 2 AND n::DOUBLE / least(x.c, y.c) >= {STRONG}),
    sym AS (SELECT file1 AS a, file2 AS b FROM strong UNION SELECT file2, file1 FROM strong),
    reach AS (SELECT a AS node, a AS other FROM sym UNION SELECT r.node, s.b FROM reach r JOIN sym s ON r.other = s.a),
    grp AS (SELECT node, min(other) AS component FROM reach GROUP BY 1)"""
ORACLES = {
    "change_frequency": f"WITH {BRAND_SQL} SELECT path, count(*) AS changes FROM cf GROUP BY 1",
    "last_modified": f"WITH {BRAND_SQL} SELECT path, max(ts) AS last_modified FROM cf GROUP BY 1",
    "window_since": f"WITH {BRAND_SQL} SELECT path, count(*) AS changes FROM cf WHERE ts >= (SELECT max(o_orderdate) - INTERVAL 365 DAY FROM orders) GROUP BY 1",
    "pair_mining": f"{MINED} SELECT file1, file2, frequency, round(confidence, 6) AS confidence, last_ts AS last_seen FROM mined",
    "change_patterns": f"""{MINED} SELECT file1, file2, concat(least(file1, file2), ' + ', greatest(file1, file2)) AS name, frequency, round(confidence, 6) AS confidence,
        last_ts AS last_occurrence, CASE WHEN frequency > 1 THEN floor((epoch(last_ts) - epoch(first_ts)) / (frequency - 1)) ELSE 0 END::BIGINT AS avg_interval_s,
        round(frequency::DOUBLE / (SELECT count(DISTINCT hash) FROM cf), 6) AS support FROM mined""",
    "pattern_confidence_all": f"""WITH {BRAND_SQL}, {PAIRS_SQL} SELECT file1, file2, n AS together, x.c + y.c - 2 * n AS separate, round(n::DOUBLE / (x.c + y.c - n), 6) AS share
        FROM pairs JOIN counts x ON x.path = file1 JOIN counts y ON y.path = file2""",
    "cooccurrence_ranked": f"""WITH {PART_SQL}, {PAIRS_SQL}, both_ways AS (SELECT file1 AS path, file2 AS partner, n FROM pairs WHERE n >= 2 UNION ALL SELECT file2, file1, n FROM pairs WHERE n >= 2)
        SELECT path, partner, n, row_number() OVER (PARTITION BY path ORDER BY n DESC, partner)::INTEGER AS rank FROM both_ways""",
    "file_relationships": f"{RELATED} SELECT file1, file2, frequency, round(correlation, 6) AS correlation, strength FROM laddered",
    "file_relationships_compat": f"""{RELATED} SELECT file1, file2, round(1.0::DOUBLE / (n1 + n2 - 1), 9) AS correlation,
        CASE WHEN 1.0::DOUBLE / (n1 + n2 - 1) >= 0.7 THEN 'strong' WHEN 1.0::DOUBLE / (n1 + n2 - 1) >= 0.4 THEN 'moderate' ELSE 'weak' END AS strength FROM rel""",
    "relationship_summary": f"{RELATED} SELECT strength, count(*) AS pairs, round(avg(correlation), 6) AS mean_correlation FROM laddered GROUP BY 1",
    "module_groups": f"{MODULES} SELECT node AS path, component AS module FROM grp",
    "module_metrics": f"""{MODULES}, touched AS (SELECT p.n, p.last_ts, g.component AS c1, h.component AS c2 FROM pairs p LEFT JOIN grp g ON g.node = file1 LEFT JOIN grp h ON h.node = file2
        WHERE p.n >= 2 AND (g.component IS NOT NULL OR h.component IS NOT NULL)),
        sides AS (SELECT c1 AS component, coalesce(c1 = c2, false) AS inside, n, last_ts FROM touched WHERE c1 IS NOT NULL
            UNION ALL SELECT c2, false, n, last_ts FROM touched WHERE c2 IS NOT NULL AND (c1 IS NULL OR c1 <> c2))
        SELECT component AS module, any_value(k) AS files, count(*) FILTER (inside) AS internal, count(*) FILTER (NOT inside) AS external,
            coalesce(sum(n) FILTER (inside), 0)::BIGINT AS changes, max(last_ts) AS last_changed, round(count(*) FILTER (inside) / count(*)::DOUBLE, 6) AS cohesion
        FROM sides JOIN (SELECT component, count(*) AS k FROM grp GROUP BY 1) USING (component) GROUP BY 1""",
    "module_name": """WITH e AS (SELECT p_type, min(p_name) AS a, max(p_name) AS b, count(*) AS n FROM part GROUP BY 1),
        k AS (SELECT *, list_max(list_filter(range(0, length(a)::BIGINT + 1), lambda i: left(a, i) = left(b, i) AND i <= length(b))) AS same FROM e)
        SELECT p_type, CASE WHEN same > 0 THEN left(a, same) || '-module' ELSE 'module-' || n || '-files' END AS module_name FROM k""",
    "usage_patterns": f"""{MINED} SELECT file1, file2, CASE WHEN confidence * 5 > 0.8 THEN 'tightly_coupled' WHEN frequency > 10 THEN 'frequently_changed' ELSE 'occasional' END AS usage,
        CASE WHEN frequency > 10 AND confidence * 5 > 0.8 THEN 'frequent_and_certain' WHEN frequency > 10 THEN 'frequent' WHEN confidence * 5 > 0.8 THEN 'certain' ELSE 'none' END AS operation,
        CASE WHEN frequency % 30 > 20 THEN 'frequently change together (' || (frequency % 30) || ' times)' WHEN confidence * 5 > 0.8 THEN 'strong correlation (' || printf('%.1f', confidence * 500) || '% confidence)' ELSE 'related through change patterns' END AS reason FROM mined""",
    "cochange_lag": f"""WITH {BRAND_SQL}, g AS (SELECT path, ts, lag(ts) OVER (PARTITION BY path ORDER BY ts, hash) AS before FROM cf)
        SELECT path, count(*) AS gaps, sum(date_diff('day', before::DATE, ts::DATE))::BIGINT AS days, max(date_diff('day', before::DATE, ts::DATE)) AS longest FROM g WHERE before IS NOT NULL GROUP BY 1""",
}
