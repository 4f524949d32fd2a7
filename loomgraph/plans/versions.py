"""Queries of histories: versions valid at events, sequence diffs, sketches by week, pair counts kept up to date, references by scope."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import cochange as C
from loomgraph.operators import graph as G
from loomgraph.operators import sequence, sketches
from loomgraph.operators.asof import as_of
from loomgraph.plans.relations import PAIRS_SQL, part_commits, table, tasks_of
from loomgraph.shared import stored


def purchase_before(spark, d):
    """Each event with its user's last purchase up to it."""
    events = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type", "value")
    found = as_of(events, events.where("event_type = 'purchase'"), "user_id", "ts", "ts", "event_id", "event_id")
    return found.select("event_id", F.col("version.event_id").alias("purchase_id"), F.col("version.value").alias("purchase_value"))


def purchase_earlier(spark, d):
    """The same before each event, itself and others of its moment left out, by type of event."""
    events = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    found = as_of(events, events.where("event_type = 'purchase'"), "user_id", "ts", "ts", "event_id", "event_id", strict=True)
    return found.groupBy("event_type").agg(F.count("*").alias("events"), F.count("version").alias("after_purchase"), F.sum("version.event_id").alias("ids"))


def order_sequences(spark, d):
    """Customers as files, their orders as nodes: by date before, and by price after."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice", "o_orderpriority", "o_orderstatus")
    place = lambda *c: F.row_number().over(G.Window.partitionBy("o_custkey").orderBy(*c)).cast("long")
    old = o.where("o_orderkey % 7 <> 0").select("o_custkey", F.col("o_orderkey").alias("node"), place("o_orderdate", "o_orderkey").alias("place"), F.col("o_orderpriority").alias("content"))
    content = F.when(F.col("o_orderstatus") == "P", "changed").otherwise(F.col("o_orderpriority"))
    new = o.where("o_orderkey % 5 <> 0").select("o_custkey", F.col("o_orderkey").alias("node"), place("o_totalprice", "o_orderkey").alias("place"), content.alias("content"))
    return old, new


def sequence_diff(spark, d):
    diff = sequence.node_diff(*order_sequences(spark, d), "o_custkey", "node", "place", "content")
    return sequence.diff_summary(diff, "o_custkey").withColumn("similarity", F.round("similarity", 6))


def sketches_by_range(spark, d):
    """Users and gaps of events by type up to each week, merged from the weeks' rows: whether sketches are within their bounds of the exact numbers."""
    changes = table(spark, d, "events").select(F.col("event_type").alias("path"), F.col("user_id").alias("author"), "ts")
    weeks = stored(sketches.weekly_sketches(changes), "weeks")
    until = F.broadcast(weeks.select(F.col("week").alias("until")))  # a row a week
    merged = sketches.over_ranges(weeks.join(until, F.col("week") <= F.col("until")), F.col("until")).select(F.col("range").alias("until"), "changes", sketches.author_count().alias("guess"), "gaps")
    first = changes.groupBy("author").agg(F.date_trunc("week", F.min("ts")).cast("date").alias("week")).groupBy("week").agg(F.count("*").alias("n"))
    exact = first.join(until, F.col("week") <= F.col("until")).groupBy("until").agg(F.sum("n").alias("authors"))
    near = F.abs(F.col("guess") - F.col("authors")) <= F.ceil(F.col("authors") * sketches.ERROR)
    ordered = (sketches.gap_quantile(0.25) <= sketches.gap_quantile(0.5)) & (sketches.gap_quantile(0.5) <= sketches.gap_quantile(0.75))
    return merged.join(exact, "until").select("until", "changes", "authors", near.alias("within"), ordered.alias("ordered"))


def incremental_pairs(spark, d):
    """Pairs of parts ordered together, kept through three batches: earlier orders, then later ones with their first lines still missing, then those lines, while failed orders are withdrawn."""
    tasks = 2 * tasks_of(spark, d)  # an order's lines make twice as many pairs
    commits = stored(part_commits(spark, d).join(table(spark, d, "orders").select(F.col("o_orderkey").alias("hash"), "o_orderstatus"), "hash"), "commits")
    cut = commits.agg(F.timestamp_micros(F.avg(F.unix_micros(F.col("ts").cast("timestamp"))).cast("long")).alias("cut"))
    rows = commits.crossJoin(F.broadcast(cut)).withColumn("early", F.col("ts").cast("timestamp") < F.col("cut")).select("hash", "path", "ts", "o_orderstatus", "early")
    late_line = F.col("path") % 3 == 0
    signed = lambda df, sign: df.select("hash", "path", "ts", F.lit(sign).alias("sign"))
    first = signed(rows.where("early"), 1)
    second = signed(rows.where(~F.col("early") & ~late_line), 1)
    third = signed(rows.where(~F.col("early") & late_line), 1).unionByName(signed(rows.where("o_orderstatus = 'F' and hash % 10 = 3"), -1))
    history, counts = rows.select("hash", "path", "ts").where("false"), C.pair_counts(C.commit_sets(rows.where("false"))).select("file1", "file2", "frequency")
    for k, batch in enumerate((first, second, third)):
        history, counts = C.maintain_pairs(history, counts, batch, tasks)
        history, counts = stored(history, f"history-{k}"), stored(counts, f"pairs-{k}")
    return counts


def reference_scopes(spark, d):
    """Parts as symbols named by their first word, in files by brand and size; each refers to a symbol named as its second word, and files import those of the next part."""
    p = table(spark, d, "part").select("p_partkey", F.split("p_name", " ").alias("w"), F.concat(F.col("p_brand"), F.lit("/"), (F.col("p_size") % 3).cast("string")).alias("path"))
    symbols = p.select(F.col("p_partkey").alias("symbol_id"), F.col("w")[0].alias("name"), "path")
    refs = p.select(F.col("p_partkey").alias("src"), "path", F.get("w", 1).alias("name"))
    imports = p.where("p_partkey % 50 = 0").select("p_partkey", "path").join(p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("path").alias("target")), "p_partkey").select("path", "target")
    return G.resolve_references(refs, symbols, imports).select("src", "dst", "scope")


QUERIES = {f.__name__: f for f in (purchase_before, purchase_earlier, sequence_diff, sketches_by_range, incremental_pairs, reference_scopes)}
ORACLES = {
    "purchase_before": """SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER w AS purchase_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER w AS purchase_value
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, CASE WHEN event_type = 'purchase' THEN 0 ELSE 1 END, event_id RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "purchase_earlier": """WITH f AS (SELECT e.event_type, (SELECT arg_max(p.event_id, struct_pack(ts := p.ts, i := p.event_id)) FROM events p WHERE p.event_type = 'purchase' AND p.user_id = e.user_id AND p.ts < e.ts) AS before FROM events e)
        SELECT event_type, count(*) AS events, count(before) AS after_purchase, sum(before)::BIGINT AS ids FROM f GROUP BY 1""",
    "sequence_diff": """WITH RECURSIVE a AS (SELECT o_custkey, o_orderkey AS node, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p, o_orderpriority AS content FROM orders WHERE o_orderkey % 7 <> 0),
        b AS (SELECT o_custkey, o_orderkey AS node, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS q, CASE WHEN o_orderstatus = 'P' THEN 'changed' ELSE o_orderpriority END AS content FROM orders WHERE o_orderkey % 5 <> 0),
        m AS (SELECT o_custkey, p, q, a.content <> b.content AS edited FROM a JOIN b USING (o_custkey, node)),
        lis AS (SELECT o_custkey, p, q, 1 AS k FROM m UNION SELECT m.o_custkey, m.p, m.q, lis.k + 1 FROM lis JOIN m ON m.o_custkey = lis.o_custkey AND m.p > lis.p AND m.q > lis.q),
        x AS (SELECT o_custkey, (SELECT count(*) FROM a WHERE a.o_custkey = c.o_custkey) AS old_nodes, (SELECT count(*) FROM b WHERE b.o_custkey = c.o_custkey) AS new_nodes, (SELECT count(*) FROM m WHERE m.o_custkey = c.o_custkey) AS n,
            (SELECT coalesce(max(k), 0) FROM lis WHERE lis.o_custkey = c.o_custkey)::BIGINT AS in_order, (SELECT count(*) FROM m WHERE m.o_custkey = c.o_custkey AND edited) AS edited FROM (SELECT o_custkey FROM a UNION SELECT o_custkey FROM b) c)
        SELECT o_custkey, old_nodes, new_nodes, in_order, n - in_order AS moved, edited, new_nodes - n AS inserted, old_nodes - n AS removed, round(n::DOUBLE / (old_nodes + new_nodes - n), 6) AS similarity FROM x""",
    "sketches_by_range": """WITH e AS (SELECT date_trunc('week', ts)::DATE AS week, user_id FROM events), w AS (SELECT DISTINCT week AS until FROM e)
        SELECT until, count(*) AS changes, count(DISTINCT user_id) AS authors, true AS within, true AS ordered FROM w JOIN e ON week <= until GROUP BY 1""",
    "incremental_pairs": f"""WITH cf AS (SELECT DISTINCT l_orderkey AS hash, l_partkey AS path, o_orderdate AS ts FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE NOT (o_orderstatus = 'F' AND o_orderkey % 10 = 3)), {PAIRS_SQL}
        SELECT file1, file2, n AS frequency FROM pairs""",
    "reference_scopes": """WITH p AS (SELECT p_partkey AS id, string_split(p_name, ' ') AS w, p_brand || '/' || (p_size % 3) AS path, p_brand AS folder FROM part),
        i AS (SELECT DISTINCT x.path, y.path AS target FROM p x JOIN p y ON y.id = x.id + 1 WHERE x.id % 50 = 0),
        f AS (SELECT r.id AS src, s.id AS dst, CASE WHEN s.path = r.path THEN 0 WHEN EXISTS (SELECT 1 FROM i WHERE i.path = r.path AND i.target = s.path) THEN 1 WHEN s.folder = r.folder THEN 2 ELSE 3 END AS k
            FROM p r JOIN p s ON s.w[1] = r.w[2] AND s.id <> r.id),
        b AS (SELECT src, dst, k FROM f QUALIFY row_number() OVER (PARTITION BY src ORDER BY k, dst) = 1)
        SELECT p.id AS src, dst, (['file', 'import', 'folder', 'anywhere'])[k + 1] AS scope FROM p LEFT JOIN b ON src = p.id""",
}
