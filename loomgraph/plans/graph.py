"""Queries of the code graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import graph as G
from loomgraph.plans.relations import RETURN_SQL, return_edges, table
from loomgraph.shared import stored

HREF = 'href="([^"]*)"'


def parts(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("node"))


def hrefs(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("href"))


def import_edges(spark, d):
    """Pages as files, links as imports: links to a page's path are internal, the rest external."""
    found = hrefs(spark, d).select(F.col("page_id").cast("string").alias("path"), F.col("href").alias("import_path")).distinct()
    known = table(spark, d, "pages").select(F.regexp_extract("url", r"^[a-z]+://[^/]*(/[^#?]*)", 1).alias("import_path")).where("import_path <> ''").distinct().withColumn("target", F.col("import_path"))
    edges = G.import_edges(found.join(known, "import_path", "left"))
    return edges.groupBy("dst", "type").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


def resolve_imports(spark, d):
    """Brands' parts as files with two extensions; each imports the next size's by a relative path, by order of candidates."""
    p = table(spark, d, "part").select("p_partkey", "p_size", F.replace("p_name", F.lit(" "), F.lit("_")).alias("name"))
    ext = F.element_at(F.array(*map(F.lit, (".tsx", ".js", "/index.ts", ".py"))), (F.col("p_size") % 4 + 1).cast("int"))
    files = p.select(F.concat(F.lit("src/"), F.col("name"), ext).alias("path")).distinct()
    imports = p.select(F.concat(F.lit("src/app/"), F.col("p_partkey").cast("string"), F.lit(".ts")).alias("path"), F.concat(F.lit("../"), F.col("name")).alias("import_path"))
    return G.resolve_imports(imports, files).groupBy("target").agg(F.count("*").alias("n"))


def hotspots(spark, d):
    return G.hotspots(return_edges(spark, d))


def isolated(spark, d):
    return G.isolated(parts(spark, d), return_edges(spark, d))


def cycles_scc(spark, d):
    return G.strongly_connected(return_edges(spark, d))


def cycle_sizes(spark, d):
    return cycles_scc(spark, d).groupBy("component").agg(F.count("*").alias("nodes"), F.min("node").alias("first"), F.max("node").alias("last"), F.sum("node").alias("ids"))


def cycle_paths(spark, d):
    """One shortest cycle through each component's smallest part: its length, whether each step is an edge, and whether it closes."""
    edges = stored(return_edges(spark, d).select("src", "dst"), "edges")
    path = stored(G.cycle_paths(edges, stored(G.strongly_connected(edges), "components")), "cycle-paths")
    sizes = path.groupBy("component").agg(F.count("*").alias("length"), F.count_distinct("node").alias("nodes"))
    steps = path.join(sizes.select("component", "length"), "component").select("component", F.col("node").alias("src"), F.pmod(F.col("place") + 1, "length").alias("place"))
    taken = steps.join(path.select("component", "place", F.col("node").alias("dst")), ["component", "place"]).join(edges, ["src", "dst"])
    return sizes.join(taken.groupBy("component").agg(F.count("*").alias("edges")), "component").select("component", "length", "nodes", "edges")


def part_symbols(spark, d):
    """Parts as functions whose signature names two types: the class of its own name, and that of the brand's."""
    cls = F.replace(F.initcap("p_name"), F.lit(" "), F.lit(""))
    signature = F.concat(F.lit("make(item: "), cls, F.lit(", size: number): "), F.replace("p_brand", F.lit("#"), F.lit("")))
    return table(spark, d, "part").select(F.col("p_partkey").alias("symbol_id"), cls.alias("name"), signature.alias("signature"), F.lit("function").alias("type"))


def reference_edges(spark, d):
    return G.reference_edges(part_symbols(spark, d)).groupBy("dst", "ref").agg(F.count("*").alias("n"))


def relationship_metrics(spark, d):
    """Edges by type, with the total: internal, external, references."""
    found = hrefs(spark, d).select(F.when(F.col("href").startswith("/"), "imports").otherwise("external").alias("type"))
    refs = G.reference_edges(part_symbols(spark, d)).select(F.lit("references").alias("type"))
    return found.unionByName(refs).rollup("type").agg(F.count("*").alias("n")).select(F.coalesce("type", F.lit("total")).alias("type"), "n")


def most_imported(spark, d):
    return hrefs(spark, d).groupBy("href").agg(F.count("*").alias("n"), F.count_distinct("page_id").alias("pages")).orderBy(F.desc("n"), "href").limit(10)


def import_totals(spark, d):
    inner = F.col("href").startswith("/")
    return hrefs(spark, d).agg(F.count("*").alias("n"), F.count_if(inner).alias("internal"), F.count_if(~inner).alias("external"), F.count_distinct("href").alias("modules"))


def search_symbols(spark, d):
    return G.search(part_symbols(spark, d), "Widget").select("symbol_id", "name")


def symbol_info(spark, d):
    found = G.symbol_info(part_symbols(spark, d), "ColdWidget")
    return found.select("symbol_id", "name", "type", "signature")


def dependencies_of(spark, d):
    return G.dependencies(return_edges(spark, d), 7)


def orphan_cleanup(spark, d):
    """Edges between parts of the larger sizes."""
    return G.orphan_edges_removed(return_edges(spark, d), table(spark, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("node")))


def containing_symbol(spark, d):
    """Order lines as points, quantity ranges of each line status as symbols: the innermost range that holds a point."""
    points = table(spark, d, "lineitem").groupBy(F.col("l_linestatus").alias("path"), F.col("l_quantity").alias("point")).agg(F.count("*").alias("n"))
    spans = table(spark, d, "part").select(F.explode(F.array(F.lit("O"), F.lit("F"))).alias("path"), F.col("p_brand").alias("name"), (F.col("p_size") % 20).cast("double").alias("start"), (F.col("p_size") % 20 + 5 + F.col("p_size") % 7).cast("double").alias("end")).distinct()
    return G.containing(points.select("path", "point"), spans)


QUERIES = {f.__name__: f for f in (import_edges, resolve_imports, hotspots, isolated, cycles_scc, cycle_sizes, cycle_paths, reference_edges, relationship_metrics, most_imported, import_totals, search_symbols, symbol_info, dependencies_of, orphan_cleanup, containing_symbol)}

HREFS = """h AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages)"""
SYMBOLS = """s AS (SELECT p_partkey AS symbol_id, list_aggregate(list_transform(string_split(p_name, ' '), lambda x: upper(left(x, 1)) || x[2:]), 'string_agg', '') AS name, replace(p_brand, '#', '') AS brand FROM part),
    refs AS (SELECT symbol_id, name AS ref FROM s UNION SELECT symbol_id, regexp_extract(brand, '^([A-Za-z_][A-Za-z0-9_]*)', 1) FROM s),
    named AS (SELECT name AS ref, min(symbol_id) AS dst FROM s GROUP BY 1), re AS (SELECT DISTINCT symbol_id AS src, dst, ref FROM refs JOIN named USING (ref) WHERE symbol_id <> dst)"""
SCC = f"""WITH RECURSIVE {RETURN_SQL}, reach AS (SELECT src, dst FROM edges UNION SELECT r.src, e.dst FROM reach r JOIN edges e ON r.dst = e.src),
    scc AS (SELECT a.src AS node, min(a.dst) AS component FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src GROUP BY 1)"""
ORACLES = {
    "import_edges": f"""WITH {HREFS}, f AS (SELECT DISTINCT page_id, href FROM h), k AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://[^/]*(/[^#?]*)', 1) AS href FROM pages)
        SELECT href AS dst, CASE WHEN k.href IS NOT NULL AND k.href <> '' THEN 'imports' ELSE 'external' END AS type, count(*) AS n, sum(CASE WHEN k.href IS NOT NULL AND k.href <> '' THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END) AS weight
        FROM f LEFT JOIN k USING (href) GROUP BY ALL""",
    "resolve_imports": """WITH p AS (SELECT p_partkey, replace(p_name, ' ', '_') AS name, ([2, 4, 5, 9])[p_size % 4 + 1] AS prio FROM part),
        best AS (SELECT name, min(prio) AS prio FROM p WHERE prio < 9 GROUP BY 1), i AS (SELECT DISTINCT p_partkey, name FROM p)
        SELECT 'src/' || name || CASE prio WHEN 2 THEN '.tsx' WHEN 4 THEN '.js' WHEN 5 THEN '/index.ts' END AS target, count(*) AS n FROM i LEFT JOIN best USING (name) GROUP BY 1""",
    "hotspots": f"""WITH {RETURN_SQL}, e AS (SELECT src AS node, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst, 0, 1 FROM edges)
        SELECT node, sum(o)::BIGINT AS imports, sum(i)::BIGINT AS "references", (sum(o) + 2 * sum(i))::DOUBLE AS score FROM e GROUP BY 1 HAVING sum(o) + 2 * sum(i) >= 2""",
    "isolated": f"WITH {RETURN_SQL} SELECT p_partkey AS node FROM part WHERE p_partkey NOT IN (SELECT src FROM edges UNION SELECT dst FROM edges)",
    "cycles_scc": f"{SCC} SELECT node, component FROM scc",
    "cycle_sizes": f"{SCC} SELECT component, count(*) AS nodes, min(node) AS first, max(node) AS last, sum(node)::BIGINT AS ids FROM scc GROUP BY 1",
    "cycle_paths": f"""{SCC}, far AS (SELECT component, dst AS node, 1 AS length FROM scc JOIN edges ON src = node WHERE node = component
            UNION SELECT far.component, dst, length + 1 FROM far JOIN edges ON src = node JOIN scc ON scc.node = dst AND scc.component = far.component
            WHERE far.node <> far.component AND length < 60)
        SELECT component, min(length)::BIGINT AS length, min(length)::BIGINT AS nodes, min(length)::BIGINT AS edges FROM far WHERE node = component GROUP BY 1""",
    "reference_edges": f"WITH {SYMBOLS} SELECT dst, ref, count(*) AS n FROM re GROUP BY 1, 2",
    "relationship_metrics": f"""WITH {HREFS}, {SYMBOLS}, t AS (SELECT CASE WHEN starts_with(href, '/') THEN 'imports' ELSE 'external' END AS type FROM h UNION ALL SELECT 'references' FROM re)
        SELECT coalesce(type, 'total') AS type, count(*) AS n FROM t GROUP BY ROLLUP (type)""",
    "most_imported": f"WITH {HREFS} SELECT href, count(*) AS n, count(DISTINCT page_id) AS pages FROM h GROUP BY 1 ORDER BY n DESC, href LIMIT 10",
    "import_totals": f"WITH {HREFS} SELECT count(*) AS n, count(*) FILTER (starts_with(href, '/')) AS internal, count(*) FILTER (NOT starts_with(href, '/')) AS external, count(DISTINCT href) AS modules FROM h",
    "search_symbols": f"WITH {SYMBOLS} SELECT symbol_id, name FROM s WHERE lower(name) LIKE '%widget%' ORDER BY name, symbol_id LIMIT 20",
    "symbol_info": f"WITH {SYMBOLS} SELECT symbol_id, name, 'function' AS type, 'make(item: ' || name || ', size: number): ' || brand AS signature FROM s WHERE name = 'ColdWidget'",
    "dependencies_of": f"WITH {RETURN_SQL} SELECT 'imports' AS direction, dst AS other FROM edges WHERE src = 7 UNION ALL SELECT 'dependents', src FROM edges WHERE dst = 7",
    "orphan_cleanup": f"WITH {RETURN_SQL}, large AS (SELECT p_partkey AS k FROM part WHERE p_size > 25) SELECT * FROM edges WHERE src IN (SELECT k FROM large) AND dst IN (SELECT k FROM large)",
    "containing_symbol": """WITH p AS (SELECT DISTINCT l_linestatus AS path, l_quantity AS point FROM lineitem),
        r AS (SELECT DISTINCT unnest(['O', 'F']) AS path, p_brand AS name, (p_size % 20)::DOUBLE AS s, (p_size % 20 + 5 + p_size % 7)::DOUBLE AS e FROM part),
        j AS (SELECT path, point, name, row_number() OVER (PARTITION BY path, point ORDER BY e - s, name) AS k FROM p JOIN r USING (path) WHERE point BETWEEN s AND e)
        SELECT path, point, name FROM j WHERE k = 1""",
}
