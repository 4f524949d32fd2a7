"""Queries of files, languages, frameworks, logs and symbols."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import ladders
from loomgraph.functions import paths as P
from loomgraph.operators import compare
from loomgraph.operators import graph as G
from loomgraph.operators.graph import by_share
from loomgraph.operators.neighborhoods import COMMON_WORDS
from loomgraph.operators.neighborhoods import cluster_names as cluster_names_of
from loomgraph.plans.relations import table
from loomgraph.sources import files as S
from loomgraph.sources import gitlog, symbols

EXTS = (".ts", ".js", ".py", ".go", ".json", ".test.ts", ".gen.ts")


def part_paths(spark, d):
    """Parts as files: type and name make a path, size an extension."""
    name = F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))
    ext = F.element_at(F.array(*map(F.lit, EXTS)), (F.col("p_size") % len(EXTS) + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", F.concat(F.replace("p_type", F.lit(" "), F.lit("-")), F.lit("/"), name, ext).alias("path"))


PART_PATHS = """pp AS (SELECT p_partkey, replace(p_type, ' ', '-') || '/' || replace(p_name, ' ', '_') || (['.ts', '.js', '.py', '.go', '.json', '.test.ts', '.gen.ts'])[p_size % 7 + 1] AS path FROM part)"""


def file_facts(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    facts = S.facts(docs)
    copies = facts.groupBy("hash").agg(F.count("*").alias("copies"))
    return facts.join(copies, "hash").select(F.col("path").cast("long").alias("doc_id"), "size", "lines", F.substring("hash", 1, 16).alias("hash16"), (F.col("copies") > 1).alias("is_dup"))


def language_stats(spark, d):
    return by_share(table(spark, d, "documents"), "lang").withColumn("percent", F.round("percent", 6))


def classify_files(spark, d):
    p = F.col("path")
    return part_paths(spark, d).select("p_partkey", P.language(p).alias("language"), P.file_type(p).alias("file_type"), P.generated(p).alias("is_generated"), P.scanned(p).alias("scanned"))


def ignore_filter(spark, d):
    p = F.col("path")
    return part_paths(spark, d).groupBy(P.mined(p, (*P.IGNORED, "*_widget*")).alias("mined"), P.watched(p).alias("watched"), P.neighborhood_file(p, tests=False).alias("neighborhood")).agg(F.count("*").alias("files"))


MARKERS = [("table", ("<table",)), ("list", ("<ul", "<ol")), ("script", ("<script",)), ("paragraph", ("<p>",))]


def framework_detect(spark, d):
    """The first marker of each page, with its tags one to a line: the rule engine of framework detection."""
    html = F.replace(F.col("html"), F.lit("><"), F.lit(">\n<"))
    return table(spark, d, "pages").select("page_id", S.first_marker(html, MARKERS).alias("framework"))


def nearest_manifest(spark, d):
    """The nearest directory above each page's path that has a page of an id divisible by seven."""
    path = F.regexp_replace(F.regexp_extract("url", r"^[a-z]+://([^#?]*)", 1), "/$", "")
    pages = table(spark, d, "pages").select("page_id", path.alias("path"))
    manifests = pages.where("page_id % 7 = 0").select(P.directory(F.col("path")).alias("dir"))
    return S.nearest(pages.select("path").distinct(), manifests)


def log_records(spark, d):
    """Orders as records of a log: a header, and a line for each brand."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    brands = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    files = lines.join(brands, "l_partkey").groupBy("l_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_set("p_brand")), lambda b: F.concat(F.lit("M\t"), b, F.lit(".ts"))), "\n").alias("files"))
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("at"), "o_orderpriority")
    head = F.concat_ws("|", F.col("l_orderkey").cast("string"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")), F.lit("c@example.com"), F.col("at").cast("string"), F.concat(F.lit("a|b "), F.col("o_orderpriority")))
    return files.join(orders, "l_orderkey").select(F.concat_ws("\n", head, "files").alias("record"))


def gitlog_parse(spark, d):
    changes = gitlog.file_changes(gitlog.parse_log(log_records(spark, d)))
    return changes.groupBy("path", "change").agg(F.count("*").alias("n"), F.count_distinct("author").alias("authors"), F.max(F.unix_seconds("ts")).alias("last_at"))


def code_files(spark, d):
    """Part types as source files: each distinct name is a class, and imports the class of the name's second word."""
    words = F.split("p_name", " ")
    cls = F.replace(F.initcap("p_name"), F.lit(" "), F.lit(""))
    names = table(spark, d, "part").select("p_type", cls.alias("cls"), words[1].alias("base")).distinct()
    line = F.concat(F.lit("import { "), F.initcap("base"), F.lit(" } from './"), F.col("base"), F.lit("';\nexport class "), F.col("cls"), F.lit(" extends "), F.initcap("base"), F.lit(" {\n}"))
    return names.groupBy(F.concat(F.lit("src/"), F.replace(F.col("p_type"), F.lit(" "), F.lit("_")), F.lit(".ts")).alias("path")).agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("content"))


def extract_symbols(spark, d):
    return symbols.extract_symbols(code_files(spark, d)).select("path", "name", "type", "signature")


def extract_imports(spark, d):
    return symbols.extract_imports(code_files(spark, d)).groupBy("path", "import_path").agg(F.count("*").alias("n"), F.min(F.array_join("specifiers", ",")).alias("specifiers"))


def framework_symbols(spark, d):
    """The same classes as React components: what each declaration means in its file's framework."""
    content = F.concat(F.lit("import React from 'react'\n"), F.regexp_replace("content", "extends [A-Za-z]+", "extends React.Component"))
    files = code_files(spark, d).select(F.replace("path", F.lit(".ts"), F.lit(".tsx")).alias("path"), content.alias("content"))
    return symbols.framework_symbols(files, S.frameworks(files)).select("path", "name", "framework", "type")


def cluster_names(spark, d):
    """A name for each part type: the most frequent word of its members' names."""
    return cluster_names_of(table(spark, d, "part"), "p_type", "p_name")


#: Source texts by part size, with a comment and strings that only look like code, and declarations over several lines; and what they declare (type, name, lines, signature).
SOURCES = {
    ".ts": (
        '// class Ghost {}\nexport class @C {\n  make(\n    item: Item,\n    size: number = "class Fake {"\n  ): @B {\n    return "}"\n  }\n}\ninterface @CProps { id: number }\ntype @CId = string\nexport const build@C = (a: number) => {\n  return a\n}\nfunction use@C() { return 1 }\nlet v@N = 1\nexport namespace N@C {\n}',
        [("class", "@C", 2, 9, "export class @C"), ("method", "make", 3, 8, 'make( item: Item, size: number = "class Fake {" ): @B'), ("interface", "@CProps", 10, 10, "interface @CProps"), ("type", "@CId", 11, 11, "type @CId = string"), ("function", "build@C", 12, 14, "export const build@C = (a: number) =>"), ("function", "use@C", 15, 15, "function use@C()"), ("variable", "v@N", 16, 16, "let v@N = 1"), ("namespace", "N@C", 17, 18, "export namespace N@C")],
    ),
    ".py": (
        '# def ghost(): pass\nclass @C(Base):\n    def make(self, item,\n             size):\n        """class Fake:\n        text"""\n        return size\n\nasync def run_@N(a):\n    return a\nLIMIT_@N = 10',
        [("class", "@C", 2, 7, "class @C(Base)"), ("function", "make", 3, 7, "def make(self, item, size)"), ("function", "run_@N", 9, 10, "async def run_@N(a)"), ("variable", "LIMIT_@N", 11, 11, "LIMIT_@N = 10")],
    ),
    ".java": (
        "/* class Ghost { */\npublic class @C {\n    private int size = 1;\n    public @B make(int a,\n            int b) {\n        return null;\n    }\n}\ninterface @CApi {\n}",
        [("class", "@C", 2, 8, "public class @C"), ("variable", "size", 3, 3, "private int size = 1"), ("method", "make", 4, 7, "public @B make(int a, int b)"), ("interface", "@CApi", 9, 10, "interface @CApi")],
    ),
    ".go": (
        "// func Ghost() {}\ntype @C struct {\n\tn int\n}\nfunc (s *@C) Run(a int,\n\tb int) error {\n\treturn nil\n}\nfunc Main@N() {}\nvar limit@N = 1",
        [("type", "@C", 2, 4, "type @C struct"), ("method", "Run", 5, 8, "func (s *@C) Run(a int, b int) error"), ("function", "Main@N", 9, 9, "func Main@N()"), ("variable", "limit@N", 10, 10, "var limit@N = 1")],
    ),
    ".rs": (
        "/* fn ghost() {} */\npub struct @C;\nimpl @C {\n    pub fn make(&self,\n        a: i32) -> i32 {\n        a\n    }\n}\nenum @CKind { A }\npub trait @CApi {\n}",
        [("class", "@C", 2, 2, "pub struct @C"), ("class", "@C", 3, 8, "impl @C"), ("function", "make", 4, 7, "pub fn make(&self, a: i32) -> i32"), ("type", "@CKind", 9, 9, "enum @CKind"), ("interface", "@CApi", 10, 11, "pub trait @CApi")],
    ),
}


def part_sources(spark, d):
    """Each part as a source file in one of five languages."""
    p = table(spark, d, "part").select("p_partkey", "p_size", F.replace(F.initcap("p_name"), F.lit(" "), F.lit("")).alias("c"), F.replace("p_brand", F.lit("#"), F.lit("")).alias("b"))
    pick = lambda some: F.element_at(F.array(*map(F.lit, some)), (F.col("p_size") % len(SOURCES) + 1).cast("int"))
    text = F.replace(F.replace(F.replace(pick([t for t, _ in SOURCES.values()]), F.lit("@C"), F.col("c")), F.lit("@B"), F.col("b")), F.lit("@N"), F.col("p_partkey").cast("string"))
    return p.select(F.concat(F.lit("src/p"), F.col("p_partkey").cast("string"), pick(list(SOURCES))).alias("path"), text.alias("content"))


def symbol_rules(spark, d):
    """Every kind of declaration of five languages, with its lines and signature."""
    return symbols.extract_symbols(part_sources(spark, d)).select("path", "type", "name", "start_line", "end_line", "signature")


def compare_files(spark, d):
    """The same files in a later version: a script's interface goes, and a variable and an import come; a Python method gets a parameter."""
    old = part_sources(spark, d)
    script = F.regexp_replace(F.regexp_replace("content", r"interface \w+ \{ id: number \}\n", ""), r"let v(\d+) = 1", "let v$1 = 1\nlet w$1 = 2\nimport far from 'far'")
    new = old.withColumn("content", F.when(F.col("path").endswith(".ts"), script).otherwise(F.replace("content", F.lit("(self, item,"), F.lit("(self, item, extra,"))))
    return compare.compare_files(old, new).select("path", "category", "kind", "name", "impact", "breaking")


def source_nodes(spark, d):
    """Nodes of source files by kind, and how many stand in a declaration."""
    return symbols.nodes(part_sources(spark, d)).groupBy("kind").agg(F.count("*").alias("nodes"), F.count("parent").alias("inner"), F.sum("start_line").alias("lines"))


def call_counts(spark, d):
    """Functions and methods that call others, as far as their signature tells."""
    return G.call_count(symbols.extract_symbols(part_sources(spark, d)))


def framework_cascade(spark, d):
    """Frameworks of files by extension, import, nearest manifest and language, one rule overriding the next."""
    n, folder = F.col("p_size") % 6, F.concat(F.lit("app"), (F.col("p_partkey") % 9).cast("string"))
    ext = F.element_at(F.array(*map(F.lit, (".vue", ".ts", ".ts", ".js", ".py", ".component.ts"))), (n + 1).cast("int"))
    content = F.when(n == 1, "import React from 'react'").when(n == 4, "from flask import Flask").otherwise("const a = 1")
    files = table(spark, d, "part").select(F.concat(folder, F.lit("/src/p"), F.col("p_partkey").cast("string"), ext).alias("path"), content.alias("content"))
    package = F.when(F.col("n") % 3 == 0, "svelte").otherwise("next")
    manifests = table(spark, d, "part").select((F.col("p_partkey") % 9).alias("n")).distinct().where("n % 3 <> 1").select(F.concat(F.lit("app"), F.col("n").cast("string")).alias("dir"), F.create_map(package, F.lit("1")).alias("dependencies"))
    return S.frameworks(files, manifests)


def symbol_counts(spark, d):
    return symbols.extract_symbols(code_files(spark, d)).groupBy("type").agg(F.count("*").alias("symbols"), F.count_distinct("name").alias("names"))


def dir_tree(spark, d):
    p = F.col("path")
    return part_paths(spark, d).groupBy(P.directory(p).alias("dir")).agg(F.count("*").alias("files"), F.array_join(F.sort_array(F.collect_set(P.basename(p))), ",").alias("names"))


def optimal_tasks(spark, d):
    return part_paths(spark, d).select("p_partkey", ladders.optimal_tasks(F.col("path")).alias("tasks"))


def naming_patterns(spark, d):
    names = table(spark, d, "part").select("p_brand", F.explode(P.naming_patterns(F.col("p_name"))).alias("pattern"))
    return names.groupBy("p_brand", "pattern").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (file_facts, language_stats, classify_files, ignore_filter, framework_detect, nearest_manifest, gitlog_parse, extract_symbols, extract_imports, framework_symbols, cluster_names, symbol_counts, symbol_rules, compare_files, source_nodes, call_counts, framework_cascade, dir_tree, optimal_tasks, naming_patterns)}

CODE = """names AS (SELECT DISTINCT p_type, string_split(p_name, ' ') AS w FROM part),
    code AS (SELECT 'src/' || replace(p_type, ' ', '_') || '.ts' AS path, list_aggregate(list_transform(w, lambda x: upper(left(x, 1)) || x[2:]), 'string_agg', '') AS cls, w[2] AS base, upper(left(w[2], 1)) || w[2][2:] AS basecls FROM names)"""
def _declared_sql() -> str:
    """The declarations of ``SOURCES``, and its comments and strings, as rows (k, kind, name, a, b, signature); written down, not found by scanning."""
    rows = []
    for k, (_, declared) in enumerate(SOURCES.values()):
        rows += [(k, t, n, a, b, sig) for t, n, a, b, sig in declared]
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({k}, {quoted(t)}, {quoted(n)}, {a}::BIGINT, {b}::BIGINT, {quoted(sig)})" for k, t, n, a, b, sig in rows)
    fill = "replace(replace(replace({0}, '@C', list_aggregate(list_transform(string_split(p_name, ' '), lambda x: upper(left(x, 1)) || x[2:]), 'string_agg', '')), '@B', replace(p_brand, '#', '')), '@N', p_partkey::VARCHAR)"
    ext = "[" + ", ".join(quoted(e) for e in SOURCES) + "]"
    return f"""v AS (SELECT * FROM (VALUES {values}) t(k, kind, name, a, b, signature)),
        decl AS (SELECT p_partkey, k, 'src/p' || p_partkey || ({ext})[k + 1] AS path, kind AS type, {fill.format('v.name')} AS name, a AS start_line, b AS end_line, {fill.format('v.signature')} AS signature FROM part JOIN v ON k = p_size % {len(SOURCES)})"""


DECLARED = _declared_sql()
#: For each of ``SOURCES``: lines of its comments and of its strings (k, kind, line, within a declaration).
MARKED = "(VALUES (0, 'comment', 1, 0), (1, 'comment', 1, 0), (2, 'comment', 1, 0), (3, 'comment', 1, 0), (4, 'comment', 1, 0), (0, 'string', 5, 1), (0, 'string', 7, 1), (1, 'string', 5, 1)) t(k, kind, line, inner_node)"
ORACLES = {
    "symbol_rules": f"WITH {DECLARED} SELECT path, type, name, start_line, end_line, signature FROM decl",
    "compare_files": f"""WITH {DECLARED}, c AS (SELECT DISTINCT path, k, p_partkey FROM decl)
        SELECT path, 'deletion' AS category, type AS kind, name, 'low' AS impact, false AS breaking FROM decl WHERE k = 0 AND type = 'interface'
        UNION ALL SELECT path, 'addition', 'variable', 'w' || p_partkey, 'low', false FROM c WHERE k = 0
        UNION ALL SELECT path, 'dependency', 'added', 'far', 'medium', false FROM c WHERE k = 0
        UNION ALL SELECT path, 'modification', 'signature', 'make', 'high', true FROM c WHERE k = 1""",
    "source_nodes": f"""WITH {DECLARED}, m AS (SELECT kind, inner_node, line FROM part JOIN {MARKED} ON k = p_size % {len(SOURCES)}),
        d AS (SELECT type AS kind, (EXISTS (SELECT 1 FROM decl o WHERE o.p_partkey = decl.p_partkey AND o.start_line <= decl.start_line AND o.end_line >= decl.end_line AND (o.start_line, o.end_line) <> (decl.start_line, decl.end_line)))::INT AS inner_node, start_line AS line FROM decl)
        SELECT kind, count(*) AS nodes, sum(inner_node)::BIGINT AS "inner", sum(line)::BIGINT AS lines FROM (SELECT * FROM m UNION ALL SELECT * FROM d) GROUP BY 1""",
    "call_counts": f"WITH {DECLARED} SELECT count(*) AS calls FROM decl WHERE type IN ('function', 'method') AND (contains(signature, '=>') OR contains(signature, 'return'))",
    "framework_cascade": """WITH f AS (SELECT p_partkey, p_size % 6 AS n, p_partkey % 9 AS m FROM part)
        SELECT 'app' || m || '/src/p' || p_partkey || (['.vue', '.ts', '.ts', '.js', '.py', '.component.ts'])[n + 1] AS path,
            CASE WHEN n = 0 THEN 'Vue' WHEN n = 5 THEN 'Angular' WHEN n = 1 THEN 'React' WHEN n IN (2, 3) AND m % 3 = 0 THEN 'Svelte' WHEN n IN (2, 3) AND m % 3 = 2 THEN 'Next.js' WHEN n = 4 THEN 'Flask' END AS framework FROM f""",
    "file_facts": """WITH h AS (SELECT doc_id, strlen(text) AS size, length(text) - length(replace(text, chr(10), '')) + 1 AS lines, sha256(text) AS h FROM documents)
        SELECT doc_id, size, lines, left(h, 16) AS hash16, count(*) OVER (PARTITION BY h) > 1 AS is_dup FROM h""",
    "language_stats": "SELECT lang, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM documents), 6) AS percent FROM documents GROUP BY 1",
    "classify_files": f"""WITH {PART_PATHS}, b AS (SELECT *, regexp_replace(path, '^.*/', '') AS base, regexp_extract(path, '([.][^./]*)$', 1) AS ext FROM pp)
        SELECT p_partkey, CASE ext WHEN '.ts' THEN 'typescript' WHEN '.js' THEN 'javascript' WHEN '.py' THEN 'python' WHEN '.go' THEN 'go' WHEN '.json' THEN 'json' END AS language,
        CASE WHEN base LIKE '%test%' OR base LIKE '%spec%' THEN 'test' WHEN base LIKE '%config%' OR ext = '.json' THEN 'config' ELSE 'source' END AS file_type,
        base LIKE '%generated%' OR base LIKE '%auto%' OR base LIKE '%.gen.ts' AS is_generated, ext IN ('.ts', '.js', '.json') AS scanned FROM b""",
    "ignore_filter": f"""WITH {PART_PATHS}, b AS (SELECT *, regexp_replace(path, '^.*/', '') AS base, regexp_extract(path, '([.][^./]*)$', 1) AS ext FROM pp)
        SELECT NOT base LIKE '%\\_widget%' ESCAPE '\\' AND ext IN ('.ts', '.js', '.py', '.go') AS mined, ext IN ('.ts', '.js', '.json') AS watched, ext <> '.json' AS neighborhood, count(*) AS files FROM b GROUP BY ALL""",
    "framework_detect": """WITH l AS (SELECT page_id, unnest(string_split(replace(html, '><', '>' || chr(10) || '<'), chr(10))) AS line, generate_subscripts(string_split(replace(html, '><', '>' || chr(10) || '<'), chr(10)), 1) AS i FROM pages),
        m AS (SELECT *, CASE WHEN contains(line, '<table') THEN 'table' WHEN contains(line, '<ul') OR contains(line, '<ol') THEN 'list' WHEN contains(line, '<script') THEN 'script' WHEN contains(line, '<p>') THEN 'paragraph' END AS f FROM l)
        SELECT page_id, arg_min(f, i) FILTER (f IS NOT NULL) AS framework FROM m GROUP BY 1""",
    "nearest_manifest": r"""WITH p AS (SELECT page_id, regexp_replace(regexp_extract(url, '^[a-z]+://([^#?]*)', 1), '/$', '') AS path FROM pages),
        m AS (SELECT DISTINCT CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS dir FROM p WHERE page_id % 7 = 0),
        j AS (SELECT DISTINCT path, dir FROM p JOIN m ON dir = '' OR starts_with(path, dir || '/'))
        SELECT path, arg_max(dir, length(dir)) AS dir FROM j GROUP BY 1""",
    "gitlog_parse": """WITH cf AS (SELECT DISTINCT l_orderkey, p_brand, o_custkey, o_orderdate FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey)
        SELECT p_brand || '.ts' AS path, 'M' AS change, count(*) AS n, count(DISTINCT o_custkey) AS authors, max(epoch(o_orderdate))::BIGINT AS last_at FROM cf GROUP BY 1""",
    "extract_symbols": f"WITH {CODE} SELECT path, cls AS name, 'class' AS type, 'export class ' || cls || ' extends ' || basecls AS signature FROM code",
    "extract_imports": f"WITH {CODE} SELECT path, './' || base AS import_path, count(*) AS n, min(basecls) AS specifiers FROM code GROUP BY 1, 2",
    "framework_symbols": f"WITH {CODE} SELECT replace(path, '.ts', '.tsx') AS path, cls AS name, 'React' AS framework, 'component' AS type FROM code",
    "cluster_names": """WITH w AS (SELECT p_type, unnest(string_split(p_name, ' ')) AS word FROM part), c AS (SELECT p_type, word, count(*) AS n FROM w WHERE length(word) > 2 AND NOT list_contains(string_split('""" + " ".join(COMMON_WORDS) + """', ' '), word) GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY n DESC, word) AS k FROM c) SELECT p_type, word || '-cluster' AS name FROM r WHERE k = 1""",
    "symbol_counts": f"WITH {CODE} SELECT 'class' AS type, count(*) AS symbols, count(DISTINCT cls) AS names FROM code",
    "dir_tree": f"""WITH {PART_PATHS} SELECT regexp_replace(path, '/[^/]*$', '') AS dir, count(*) AS files, string_agg(DISTINCT regexp_replace(path, '^.*/', ''), ',' ORDER BY regexp_replace(path, '^.*/', '')) AS names FROM pp GROUP BY 1""",
    "optimal_tasks": f"""WITH {PART_PATHS} SELECT p_partkey, CASE WHEN lower(path) LIKE '%test%' THEN 'testing,debugging,quality_assurance' WHEN lower(path) LIKE '%config%' OR lower(path) LIKE '%.json%' THEN 'configuration,setup,deployment'
        WHEN lower(path) LIKE '%readme%' OR lower(path) LIKE '%doc%' THEN 'documentation,maintenance,onboarding' ELSE 'development,refactoring,feature_implementation' END AS tasks FROM pp""",
    "naming_patterns": """WITH n AS (SELECT p_brand, unnest(['prefix_' || left(p_name, 3), 'suffix_' || right(p_name, 3), CASE WHEN regexp_matches(left(p_name, 1), '[A-Z]') THEN 'title_case' ELSE 'lower_case' END]) AS pattern FROM part)
        SELECT p_brand, pattern, count(*) AS n FROM n GROUP BY 1, 2""",
}
