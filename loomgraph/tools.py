"""The query tools over an analysed tree, each a DataFrame or a small dictionary of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import paths as P
from loomgraph.operators import cochange, graph, neighborhoods
from loomgraph.sources import files as source_files
from loomgraph.shared import stored
from loomgraph.sources import gitlog, symbols


@dataclass
class Analysis:
    """Tables of an analysed source tree; ``commits`` is absent without a history."""

    files: DataFrame
    symbols: DataFrame
    imports: DataFrame
    edges: DataFrame
    commits: DataFrame | None = None


def analyse(spark: SparkSession, root: str, log: str | None = None) -> Analysis:
    """Scan a folder, extract symbols and imports, resolve imports to edges, and read a saved log."""
    content = stored(source_files.scan(spark, root), "content")
    facts = source_files.facts(content)
    found, imported = symbols.extract_symbols(content), symbols.extract_imports(content)
    edges = graph.import_edges(graph.resolve_imports(imported, facts))
    commits = gitlog.parse_log(gitlog.read_log(spark, log)) if log else None
    return Analysis(facts, found, imported, edges, commits)


def overview(a: Analysis) -> dict[str, DataFrame]:
    return {
        "languages": graph.by_share(a.files, "language"),
        "symbols": a.symbols.groupBy("type").agg(F.count("*").alias("n")),
        "edges": a.edges.groupBy("type").agg(F.count("*").alias("n")),
        "totals": a.files.agg(F.count("*").alias("files"), F.sum("lines").alias("lines"), F.sum("size").alias("bytes")),
    }


def file_analysis(a: Analysis, path: str) -> dict[str, DataFrame]:
    return {"file": a.files.where(F.col("path") == path), "symbols": a.symbols.where(F.col("path") == path).orderBy("start_line"), "dependencies": graph.dependencies(a.edges, path)}


def symbol_info(a: Analysis, name: str, path: str | None = None) -> DataFrame:
    found = graph.symbol_info(a.symbols, name)
    return found if path is None else found.where(F.col("path") == path)


def search_symbols(a: Analysis, query: str, language: str | None = None, limit: int = 20) -> DataFrame:
    some = a.symbols if language is None else a.symbols.where(P.language(F.col("path")) == language)
    return graph.search(some, query, limit)


def dependencies(a: Analysis, path: str | None = None, direction: str = "both") -> DataFrame:
    if path is not None:
        return graph.dependencies(a.edges, path, direction)
    return a.edges.groupBy("dst").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dst").limit(5)


def semantic_neighborhoods(a: Analysis, path: str | None = None, max_results: int = 10, min_support: float = 0.05, min_confidence: float = 0.3) -> DataFrame:
    """Pairs that change together, as neighborhoods merged and ranked; of one file if asked for."""
    if a.commits is None:
        raise ValueError("the analysis has no history")
    patterns = cochange.change_patterns(gitlog.file_changes(a.commits).select("hash", "path", "ts"), min_support, min_confidence)
    hoods = patterns.select(F.col("name").alias("id"), F.col("confidence").alias("strength"), F.array("file1", "file2").alias("members"))
    kept = neighborhoods.merge_similar(hoods)
    some = kept if path is None else kept.where(F.array_contains("members", path))
    return some.orderBy(F.desc("strength"), "id").limit(max_results)


def file_context(hoods: DataFrame, path: str, clusters: DataFrame | None = None) -> DataFrame:
    """(kind, name): neighborhoods (id, members) with a file whose path holds ``path`` or is held by it, and the clusters (id, cluster) of those."""
    held = F.exists("members", lambda m: F.contains(m, F.lit(path)) | F.contains(F.lit(path), m))
    near = hoods.where(held).select(F.lit("neighborhood").alias("kind"), F.col("id").alias("name"))
    if clusters is None:
        return near
    return near.unionByName(clusters.join(near.select(F.col("name").alias("id")), "id", "left_semi").select(F.lit("cluster").alias("kind"), F.col("cluster").alias("name")).distinct())


def table_of(title: str, heads: list[str], rows: list[list]) -> list[str]:
    lines = ["", f"## {title}", "", "| " + " | ".join(heads) + " |", "|---" * len(heads) + "|"]
    return lines + ["| " + " | ".join(str(x) for x in r) + " |" for r in rows]


def report(a: Analysis, title: str = "Context map", shown: int = 50) -> str:
    """The analysis as Markdown: overview, files, symbols, languages, imports, relationships, neighborhoods and structure. Only counts and the first ``shown`` rows of sorted tables are gathered."""
    o = overview(a)
    total = o["totals"].first()
    out = [f"# {title}", "", f"- Files: {total['files']}", f"- Lines: {total['lines'] or 0}", f"- Bytes: {total['bytes'] or 0}"]
    per_file = a.symbols.groupBy("path").agg(F.count("*").alias("symbols"))
    files = a.files.join(per_file, "path", "left").orderBy(F.desc("lines"), "path").limit(shown).collect()
    out += table_of("Files", ["File", "Language", "Kind", "Lines", "Symbols"], [[r["path"], r["language"], r["file_type"], r["lines"], r["symbols"] or 0] for r in files])
    out += table_of("Symbols", ["Type", "Count"], [[r["type"], r["n"]] for r in o["symbols"].orderBy(F.desc("n"), "type").limit(shown).collect()])
    out += table_of("Declarations", ["Name", "Type", "File", "Lines"], [[r["name"], r["type"], r["path"], f"{r['start_line']}-{r['end_line']}"] for r in a.symbols.orderBy("path", "start_line").limit(shown).collect()])
    out += table_of("Languages", ["Language", "Files", "Share"], [[r["language"], r["n"], f"{r['percent']:.1f} %"] for r in o["languages"].orderBy(F.desc("n"), "language").limit(shown).collect()])
    out += table_of("Imports", ["Target", "Files"], [[r["dst"], r["n"]] for r in dependencies(a).collect()])
    hot = graph.hotspots(a.edges.where("type = 'imports'")).orderBy(F.desc("score"), "node").limit(10).collect()
    kinds = [[r["type"], r["n"]] for r in o["edges"].orderBy(F.desc("n"), "type").collect()]
    cycles = graph.strongly_connected(a.edges.where("type = 'imports'")).groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(shown).collect()
    out += table_of("Relationships", ["Type", "Count"], kinds + [["calls", graph.call_count(a.symbols).first()["calls"]]])
    out += table_of("Hotspots", ["File", "Score"], [[r["node"], f"{r['score']:.0f}"] for r in hot])
    out += table_of("Cycles", ["First file", "Files"], [[r["component"], r["n"]] for r in cycles])
    if a.commits is not None:
        out += table_of("Neighborhoods", ["Name", "Strength"], [[r["id"], f"{r['strength']:.2f}"] for r in semantic_neighborhoods(a).collect()])
    folders = a.files.groupBy(P.directory(F.col("path")).alias("dir")).agg(F.count("*").alias("n")).orderBy("dir").limit(shown).collect()
    out += table_of("Structure", ["Folder", "Files"], [[r["dir"] or ".", r["n"]] for r in folders])
    return "\n".join(out) + "\n"
