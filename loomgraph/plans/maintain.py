"""Queries of incremental maintenance and compaction: customers and parts in two versions, events as changes, flows as edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import compact as K
from loomgraph.operators import incremental as I
from loomgraph.operators.diff import snapshot_diff
from loomgraph.plans.relations import RETURN_SQL, return_edges, table

COMPARED = ["c_acctbal", "c_mktsegment"]


def actual(spark, d):
    return table(spark, d, "customer").where("c_custkey % 10 <> 0").select("c_custkey", *COMPARED)


def shadow(spark, d):
    changed = F.col("c_custkey") % 5 == 0
    c = table(spark, d, "customer").where("c_custkey % 7 <> 0")
    return c.select("c_custkey", F.when(changed, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")).alias("c_acctbal"), "c_mktsegment")


def patch_plan(spark, d):
    return I.patch_plan(actual(spark, d), shadow(spark, d), "c_custkey", COMPARED)


def plan_summary(spark, d):
    return I.plan_summary(patch_plan(spark, d))


def two_plans(spark, d):
    """The patches of two plans put together: the second one leads back for every third customer."""
    back = I.patch_plan(shadow(spark, d).where("c_custkey % 3 = 0"), actual(spark, d).where("c_custkey % 3 = 0"), "c_custkey", COMPARED)
    return patch_plan(spark, d).unionByName(back)


def plan_conflicts(spark, d):
    return I.plan_conflicts(two_plans(spark, d), "c_custkey").select("c_custkey", "patches", "severity")


def plan_validity(spark, d):
    return I.plan_validity(two_plans(spark, d), "c_custkey")


def the_diff(spark, d):
    return snapshot_diff(actual(spark, d), shadow(spark, d), "c_custkey", COMPARED)


def token_delta(spark, d):
    return I.token_delta(the_diff(spark, d), I.TOKENS_PER_FILE)


def impact_summary(spark, d):
    return I.impact_summary(the_diff(spark, d), F.col("old_c_acctbal") < 0)


def ast_risk(spark, d):
    found = the_diff(spark, d).withColumn("segment", F.coalesce("new_c_mktsegment", "old_c_mktsegment"))
    return I.ast_risk(found, "segment").withColumn("risk", F.round("risk", 6))


def events(spark, d):
    return table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")


def apply_changes(spark, d):
    """Users' state after all events: the last one wins, and a purchase deletes. The state before is that of the mean time of users' last events."""
    found = events(spark, d).withColumn("change_id", F.col("event_id"))
    last = found.groupBy("user_id").agg(F.unix_micros(F.max("ts").cast("timestamp")).alias("last"))
    cut = last.agg(F.timestamp_micros(F.avg("last").cast("long")).alias("cut"))
    found = found.crossJoin(F.broadcast(cut)).withColumn("early", F.coalesce(F.col("ts").cast("timestamp") < F.col("cut"), F.lit(True))).drop("cut")
    early, late = found.where("early").drop("early"), found.where("not early").drop("early")
    bought = F.col("event_type") == "purchase"
    state = I.last_changes(early, "user_id", "ts", "change_id").where(~bought).select("user_id", "value")
    return I.apply_changes(state, late, "user_id", bought)


def debounce_sessions(spark, d):
    return I.sessions(events(spark, d), "6 hours", ["user_id"]).select("user_id", "start", "n")


def session_last_op(spark, d):
    return I.session_last(events(spark, d), "6 hours", "user_id", "event_type", "ts", "event_id")


def count_batches(spark, d):
    found = I.count_batches(events(spark, d), "user_id", 5, "ts", "event_id")
    return found.groupBy("user_id", "batch").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


def change_priority(spark, d):
    kind = F.concat(F.when(F.col("user_id") % 2 == 0, "file_").otherwise("symbol_"), F.when(F.col("event_type") == "purchase", "delete").when(F.col("event_type") == "click", "add").otherwise("modify"))
    return events(spark, d).groupBy(kind.alias("kind")).agg(F.count("*").alias("n")).withColumn("priority", I.by_map(F.col("kind"), I.CHANGE_PRIORITY, 10))


def ema(spark, d):
    return I.moving_average(events(spark, d), "user_id", "value", "ts", "event_id").select("user_id", "n", F.round("ema", 4).alias("ema"))


def graph(spark, d):
    """Customers as files, urgent orders as edges: their customer points to the customer of the next order key."""
    files = table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("path"), F.round(F.abs("c_acctbal")).cast("long").alias("size"), (F.col("c_custkey") % 100).alias("lines"), (F.col("c_custkey") % 7).alias("symbol_count"))
    o = table(spark, d, "orders")
    nxt = o.select((F.col("o_orderkey") - 1).alias("o_orderkey"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("dst"))
    edges = o.where("o_orderpriority = '1-URGENT'").select("o_orderkey", F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src")).join(nxt, "o_orderkey").select("src", "dst").distinct()
    symbols = table(spark, d, "part").select(F.col("p_partkey").alias("symbol_id"), F.concat(F.lit("c"), F.col("p_partkey").cast("string")).alias("path"))
    return K.Graph(files, symbols, edges)


def keep():
    return K.preserved(F.col("path"), ["c1", "c2"], ["99"])


def compact_relevance(spark, d):
    return K.by_relevance(graph(spark, d), keep()).select("path", F.round("relevance", 6).alias("relevance"))


def compact_frequency(spark, d):
    return K.by_frequency(graph(spark, d), keep())


def compact_dependency(spark, d):
    return K.by_dependency(graph(spark, d), keep())


def compact_size(spark, d):
    return K.by_size(graph(spark, d), keep(), 200_000)


def compact_hybrid(spark, d):
    return K.by_hybrid(graph(spark, d), keep())


def compact_adaptive(spark, d):
    name, paths = K.by_adaptive(graph(spark, d), keep())
    return paths.groupBy().agg(F.count("*").alias("kept")).withColumn("strategy", F.lit(name))


def compact_analysis(spark, d):
    """Elements of the graph, and what each level would leave of its tokens."""
    g = graph(spark, d)
    counts = g.files.agg(F.count("*").alias("files")).crossJoin(g.symbols.agg(F.count("*").alias("symbols"))).crossJoin(g.edges.agg(F.count("*").alias("edges")))
    tokens = F.col("files") * I.TOKENS_PER_FILE + F.col("symbols") * I.TOKENS_PER_SYMBOL
    levels = F.array(*(F.struct(F.lit(k).alias("level"), F.lit(K.LEVELS[k]).alias("strategy"), F.floor(tokens * F.lit(v)).alias("tokens")) for k, v in K.REDUCTION.items()))
    return counts.select("files", "symbols", "edges", F.explode(levels).alias("l")).select("files", "symbols", "edges", "l.*")


def compact_orphans(spark, d):
    """Edges left after compaction by dependency of the files in the larger half."""
    g = graph(spark, d)
    return g.kept(g.files.where("size > 5000").select("path")).edges


def supplied(spark, d):
    """Parts as symbols, and the suppliers that sold them as the files that list them."""
    symbols = table(spark, d, "lineitem").select(F.col("l_partkey").alias("symbol_id"), F.col("l_suppkey").alias("path"))
    return K.Graph(symbols.select("path").distinct(), symbols, return_edges(spark, d))


def compact_symbol_frequency(spark, d):
    return K.symbols_by_frequency(supplied(spark, d), F.col("symbol_id") % 100 == 1)


def compact_symbol_dependency(spark, d):
    g = supplied(spark, d)
    return K.symbols_by_dependency(g, g.edges)


def compact_controller(spark, d):
    """The strategy that the controller picks for the graph, and how many elements it leaves."""
    strategy, left = K.compact(graph(spark, d), names=["c1", "c2"], parts=["99"], most=200_000)
    counts = left.files.agg(F.count("*").alias("files")).crossJoin(left.symbols.agg(F.count("*").alias("symbols"))).crossJoin(left.edges.agg(F.count("*").alias("edges")))
    return counts.withColumn("strategy", F.lit(strategy))


QUERIES = {f.__name__: f for f in (patch_plan, plan_summary, plan_conflicts, plan_validity, token_delta, impact_summary, ast_risk, apply_changes, debounce_sessions, session_last_op, count_batches, change_priority, ema, compact_relevance, compact_frequency, compact_dependency, compact_size, compact_hybrid, compact_adaptive, compact_analysis, compact_orphans, compact_symbol_frequency, compact_symbol_dependency, compact_controller)}

DIFF = """a AS (SELECT * FROM customer WHERE c_custkey % 10 <> 0), s AS (SELECT c_custkey, c_acctbal + CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END AS c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 7 <> 0),
    diff AS (SELECT coalesce(a.c_custkey, s.c_custkey) AS c_custkey, a.c_acctbal AS old_bal, coalesce(s.c_mktsegment, a.c_mktsegment) AS segment, CASE WHEN a.c_custkey IS NULL THEN 'added' WHEN s.c_custkey IS NULL THEN 'removed' WHEN a.c_acctbal <> s.c_acctbal THEN 'modified' END AS change FROM a FULL JOIN s ON a.c_custkey = s.c_custkey),
    d AS (SELECT * FROM diff WHERE change IS NOT NULL)"""
SESSIONS = """l AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
    g AS (SELECT *, sum(CASE WHEN before IS NULL OR ts - before >= INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM l)"""
GRAPH = """files AS (SELECT 'c' || c_custkey AS path, round(abs(c_acctbal))::BIGINT AS size, c_custkey % 100 AS lines, c_custkey % 7 AS symbol_count, 'c' || c_custkey IN ('c1', 'c2') OR contains('c' || c_custkey, '99') AS keep FROM customer),
    edges AS (SELECT DISTINCT 'c' || o.o_custkey AS src, 'c' || x.o_custkey AS dst FROM orders o JOIN orders x ON x.o_orderkey = o.o_orderkey + 1 WHERE o.o_orderpriority = '1-URGENT')"""
RELEVANT = """r0 AS (SELECT path, keep, CASE WHEN keep THEN 1.0::DOUBLE ELSE 0.1::DOUBLE END AS r FROM files), gain AS (SELECT dst AS path, sum(r) AS gain FROM edges JOIN r0 ON src = path GROUP BY 1),
    rel AS (SELECT path, keep, least(1, r + 0.5::DOUBLE * coalesce(gain, 0)) AS relevance FROM r0 LEFT JOIN gain USING (path)), k1 AS (SELECT path, keep, relevance FROM rel WHERE relevance >= 0.3 OR keep)"""


def _frequency_sql(files: str, edges: str, out: str) -> str:
    return f"""{out}_f AS (SELECT f.path, f.keep, count(e.path) AS n FROM {files} f LEFT JOIN (SELECT src AS path FROM {edges} UNION ALL SELECT dst FROM {edges}) e ON e.path = f.path GROUP BY 1, 2),
    {out}_r AS (SELECT *, row_number() OVER (ORDER BY n, path) AS k, floor((count(*) OVER ()) * 0.3) AS due FROM {out}_f), {out} AS (SELECT path, keep FROM {out}_r WHERE k > due OR keep)"""


ORACLES = {
    "patch_plan": f"WITH {DIFF}, p AS (SELECT c_custkey, change, CASE change WHEN 'added' THEN 1 WHEN 'modified' THEN 2 ELSE 3 END AS priority FROM d) SELECT *, row_number() OVER (ORDER BY priority, c_custkey) AS update_order FROM p",
    "plan_summary": f"WITH {DIFF} SELECT count(*) AS patches, count(*) * 10 AS estimated_ms, CASE WHEN count(*) > 1000 THEN 'split the plan' WHEN count(*) > 10 THEN 'apply in batches' ELSE '' END AS note FROM d",
    "plan_conflicts": f"WITH {DIFF} SELECT c_custkey, 2::BIGINT AS patches, 'high' AS severity FROM d WHERE c_custkey % 3 = 0",
    "plan_validity": f"WITH {DIFF} SELECT count(*) + count(*) FILTER (c_custkey % 3 = 0) AS patches, count(*) FILTER (c_custkey % 3 = 0) AS conflicts, count(*) FILTER (c_custkey % 3 = 0) = 0 AS valid, count(*) + count(*) FILTER (c_custkey % 3 = 0) > 1000 AS large FROM d",
    "token_delta": f"WITH {DIFF} SELECT count(*) FILTER (change = 'added') * 100 AS tokens_added, count(*) FILTER (change = 'removed') * 100 AS tokens_removed, (count(*) FILTER (change = 'added') - count(*) FILTER (change = 'removed')) * 100 AS tokens_net FROM d",
    "impact_summary": f"""WITH {DIFF}, x AS (SELECT count(*) AS changes, count(*) FILTER (change = 'removed' OR (change = 'modified' AND old_bal < 0)) AS high_impact, sum(CASE WHEN change = 'removed' THEN 8 WHEN change = 'modified' AND old_bal < 0 THEN 5 WHEN change = 'added' THEN 1 ELSE 0 END) / 10.0::DOUBLE AS risk FROM d)
        SELECT *, CASE WHEN risk > 2 THEN 'review before merging' WHEN high_impact > 0 THEN 'review high-impact changes' ELSE 'none' END AS advice FROM x""",
    "ast_risk": f"""WITH {DIFF}, x AS (SELECT segment, count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'removed') AS removed, count(*) FILTER (change = 'modified') AS modified FROM d GROUP BY 1)
        SELECT *, round(0.5::DOUBLE * removed + 0.3::DOUBLE * modified + 0.1::DOUBLE * added, 6) AS risk FROM x""",
    "apply_changes": """WITH l AS (SELECT user_id, arg_max(event_type, struct_pack(ts := ts, i := event_id)) AS op, arg_max(value, struct_pack(ts := ts, i := event_id)) AS value FROM events GROUP BY 1)
        SELECT user_id, value FROM l WHERE op <> 'purchase'""",
    "debounce_sessions": f"WITH {SESSIONS} SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, session",
    "session_last_op": f"WITH {SESSIONS} SELECT user_id, min(ts) AS start, arg_max(event_type, struct_pack(ts := ts, i := event_id)) AS op FROM g GROUP BY user_id, session",
    "count_batches": """WITH b AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 5 AS batch FROM events)
        SELECT user_id, batch, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM b GROUP BY 1, 2""",
    "change_priority": """WITH k AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'file_' ELSE 'symbol_' END || CASE event_type WHEN 'purchase' THEN 'delete' WHEN 'click' THEN 'add' ELSE 'modify' END AS kind FROM events)
        SELECT kind, count(*) AS n, CASE kind WHEN 'file_delete' THEN 1 WHEN 'symbol_delete' THEN 2 WHEN 'file_add' THEN 3 WHEN 'symbol_add' THEN 4 WHEN 'file_modify' THEN 5 ELSE 6 END::INTEGER AS priority FROM k GROUP BY 1""",
    "ema": """WITH RECURSIVE o AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events),
        e AS (SELECT user_id, n, k, value AS ema FROM o WHERE k = 1 UNION ALL SELECT o.user_id, o.n, o.k, e.ema * 0.9::DOUBLE + o.value * 0.1::DOUBLE FROM e JOIN o ON o.user_id = e.user_id AND o.k = e.k + 1)
        SELECT user_id, n::INTEGER AS n, round(ema, 4) AS ema FROM e WHERE k = n""",
    "compact_relevance": f"WITH {GRAPH}, {RELEVANT} SELECT path, round(relevance, 6) AS relevance FROM k1",
    "compact_frequency": f"WITH {GRAPH}, {_frequency_sql('files', 'edges', 'kf')} SELECT path FROM kf",
    "compact_dependency": f"WITH {GRAPH} SELECT path FROM files WHERE keep OR path IN (SELECT src FROM edges UNION SELECT dst FROM edges)",
    "compact_size": f"""WITH {GRAPH}, w AS (SELECT path, keep, size + 10 * symbol_count + lines AS w FROM files), t AS (SELECT sum(w) AS total FROM w),
        r AS (SELECT path, coalesce(sum(w) OVER (ORDER BY w DESC, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone FROM w WHERE NOT keep)
        SELECT path FROM files WHERE path NOT IN (SELECT path FROM r, t WHERE total - gone > 200000)""",
    "compact_hybrid": f"""WITH {GRAPH}, {RELEVANT}, e1 AS (SELECT * FROM edges WHERE src IN (SELECT path FROM k1) AND dst IN (SELECT path FROM k1)), {_frequency_sql('k1', 'e1', 'k2')},
        e2 AS (SELECT * FROM e1 WHERE src IN (SELECT path FROM k2) AND dst IN (SELECT path FROM k2)) SELECT path FROM k2 WHERE keep OR path IN (SELECT src FROM e2 UNION SELECT dst FROM e2)""",
    "compact_adaptive": f"WITH {GRAPH}, {_frequency_sql('files', 'edges', 'kf')} SELECT count(*) AS kept, 'frequency' AS strategy FROM kf",
    "compact_analysis": f"""WITH {GRAPH}, c AS (SELECT (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM part) AS symbols, (SELECT count(*) FROM edges) AS edges)
        SELECT files, symbols, edges, level, strategy, floor((files * 100 + symbols * 50) * share)::BIGINT AS tokens FROM c, (VALUES ('minimal', 'relevance', 0.3::DOUBLE), ('balanced', 'hybrid', 0.6::DOUBLE), ('aggressive', 'size', 0.15::DOUBLE)) v(level, strategy, share)""",
    "compact_symbol_frequency": """WITH f AS (SELECT l_partkey AS symbol_id, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n, symbol_id) AS k, floor((count(*) OVER ()) * 0.3) AS due FROM f)
        SELECT symbol_id FROM r WHERE k > due OR symbol_id % 100 = 1""",
    "compact_symbol_dependency": f"WITH {RETURN_SQL} SELECT DISTINCT l_partkey AS symbol_id FROM lineitem WHERE l_partkey IN (SELECT src FROM edges UNION SELECT dst FROM edges)",
    "compact_controller": f"""WITH {GRAPH}, {RELEVANT}, sy AS (SELECT 'c' || p_partkey AS path FROM part), total AS (SELECT (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM files) + (SELECT count(*) FROM part) + (SELECT count(*) FROM edges) AS size),
        w AS (SELECT path, keep, size + 10 * symbol_count + lines AS w FROM files), gone AS (SELECT path, coalesce(sum(w) OVER (ORDER BY w DESC, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone FROM w WHERE NOT keep),
        chosen AS (SELECT CASE WHEN size > 50000 THEN 'size' WHEN files > 1000 THEN 'dependency' ELSE 'relevance' END AS strategy FROM total),
        k AS (SELECT path FROM k1, chosen WHERE strategy = 'relevance' UNION ALL SELECT path FROM files, chosen WHERE strategy = 'dependency' AND (keep OR path IN (SELECT src FROM edges UNION SELECT dst FROM edges))
            UNION ALL SELECT path FROM files, chosen WHERE strategy = 'size' AND path NOT IN (SELECT path FROM gone WHERE (SELECT sum(w) FROM w) - gone > 200000))
        SELECT strategy, (SELECT count(*) FROM k) AS files, (SELECT count(*) FROM sy WHERE path IN (SELECT path FROM k)) AS symbols, (SELECT count(*) FROM edges WHERE src IN (SELECT path FROM k) AND dst IN (SELECT path FROM k)) AS edges FROM chosen""",
    "compact_orphans": f"WITH {GRAPH}, k AS (SELECT path FROM files WHERE size > 5000) SELECT * FROM edges WHERE src IN (SELECT path FROM k) AND dst IN (SELECT path FROM k)",
}
