"""Compaction: which files, symbols and edges of a graph to keep.

A graph is four tables: files (path, size, lines, symbol_count), symbols (symbol_id, path), nodes (node,
path) and edges (src, dst). Strategies return the kept files; ``compact`` applies them.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.order import in_order
from loomgraph.shared import stored


@dataclass(frozen=True)
class Graph:
    files: DataFrame
    symbols: DataFrame
    edges: DataFrame

    def kept(self, paths: DataFrame) -> Graph:
        """The graph of some files: their symbols, and edges between them."""
        p = paths.select("path").distinct()
        files, symbols = self.files.join(p, "path", "left_semi"), self.symbols.join(p, "path", "left_semi")
        edges = self.edges.join(p.withColumnRenamed("path", "src"), "src", "left_semi").join(p.withColumnRenamed("path", "dst"), "dst", "left_semi")
        return replace(self, files=files, symbols=symbols, edges=edges)

    def size(self) -> int:
        return self.files.count() + self.symbols.count() + self.edges.count()


def preserved(path: Column, names: list[str], parts: list[str]) -> Column:
    """Files to keep in any case: by name, or by a part of their path."""
    out = path.isin(*names) if names else F.lit(False)
    for p in parts:
        out = out | path.contains(p)
    return out


def relevance(g: Graph, keep: Column, base: float = 0.1, share: float = 0.5) -> DataFrame:
    """(path, relevance): 1 for preserved files, else the base; then one step along the edges all at once: each target gains half its sources' relevance, 1 at most."""
    start = g.files.select("path", F.when(keep, 1.0).otherwise(base).alias("r"))
    gain = g.edges.join(start.select(F.col("path").alias("src"), "r"), "src").groupBy(F.col("dst").alias("path")).agg(F.sum("r").alias("gain"))
    return start.join(gain, "path", "left").select("path", F.least(F.lit(1.0), F.col("r") + share * F.coalesce("gain", F.lit(0.0))).alias("relevance"))


def by_relevance(g: Graph, keep: Column, least: float = 0.3) -> DataFrame:
    return relevance(g, keep).where((F.col("relevance") >= least) | keep)


def frequencies(g: Graph) -> DataFrame:
    """(path, frequency): edges that touch each file."""
    ends = g.edges.select(F.explode(F.array("src", "dst")).alias("path")).groupBy("path").agg(F.count("*").alias("n"))
    return g.files.select("path").join(ends, "path", "left").select("path", F.coalesce("n", F.lit(0)).alias("frequency"))


def by_frequency(g: Graph, keep: Column, share: float = 0.3) -> DataFrame:
    """Without the ``share`` (rounded down) of files that the fewest edges touch; ties go by path."""
    due = g.files.agg(F.floor(F.count("*") * share).alias("due"))
    gone = in_order(frequencies(g), "frequency", "path").crossJoin(F.broadcast(due)).where("number <= due").select("path")
    return g.files.join(gone, "path", "left_anti").select("path").unionByName(g.files.where(keep).join(gone, "path", "left_semi").select("path"))


def symbols_by_frequency(g: Graph, keep: Column | None = None, share: float = 0.3) -> DataFrame:
    """(symbol_id) without the ``share`` (rounded down) of symbols that the fewest files list, but for those to keep; ties go by id."""
    listed = g.symbols.groupBy("symbol_id").agg(F.count_distinct("path").alias("frequency"))
    due = listed.agg(F.floor(F.count("*") * share).alias("due"))
    placed = in_order(listed, "frequency", "symbol_id").crossJoin(F.broadcast(due))
    return placed.where((F.col("number") > F.col("due")) | (F.lit(False) if keep is None else keep)).select("symbol_id")


def symbols_by_dependency(g: Graph, edges: DataFrame, keep: Column | None = None) -> DataFrame:
    """(symbol_id) of symbols at either end of an edge (src, dst) between symbols, and of those to keep."""
    touched = edges.select(F.explode(F.array("src", "dst")).alias("symbol_id")).distinct().withColumn("linked", F.lit(True))
    found = g.symbols.select("symbol_id").distinct().join(touched, "symbol_id", "left")
    return found.where(F.col("linked").isNotNull() | (F.lit(False) if keep is None else keep)).select("symbol_id")


def by_dependency(g: Graph, keep: Column) -> DataFrame:
    """Files at either end of an edge."""
    touched = g.edges.select(F.explode(F.array("src", "dst")).alias("path")).distinct()
    linked = g.files.join(touched, "path", "left_semi").select("path")
    return linked.unionByName(g.files.where(keep).join(touched, "path", "left_anti").select("path"))


def weight() -> Column:
    return F.col("size") + 10 * F.col("symbol_count") + F.col("lines")


def by_size(g: Graph, keep: Column, most: float) -> DataFrame:
    """Without the largest files, until the weights of the rest are ``most`` or less; ties go by path."""
    f = g.files.withColumn("w", weight())
    total = f.agg(F.sum("w").alias("total"))
    placed = in_order(f.where(~keep), F.desc("w"), "path", value="w").crossJoin(F.broadcast(total))
    return g.files.join(placed.where(F.col("total") - F.col("before") > most), "path", "left_anti").select("path")


def by_hybrid(g: Graph, keep: Column) -> DataFrame:
    """Relevance, then frequency, then dependency, each on what the one before kept."""
    one = g.kept(stored(by_relevance(g, keep).select("path"), "relevant"))
    two = one.kept(stored(by_frequency(one, keep), "frequent"))
    return by_dependency(two, keep)


def characteristics(g: Graph) -> dict[str, float]:
    """Edges for each pair of files, and mean size: scalars of two counts."""
    row = g.files.agg(F.count("*").alias("n"), F.avg("size").alias("size")).first()
    edges = g.edges.count()
    return {"files": row["n"], "connectivity": edges / max(1, row["n"] * (row["n"] - 1)), "mean_size": row["size"] or 0.0}


def by_adaptive(g: Graph, keep: Column, unused: float = 0.3) -> tuple[str, DataFrame]:
    c = characteristics(g)
    if c["connectivity"] > 0.1:
        return "dependency", by_dependency(g, keep)
    if c["mean_size"] > 10_000:
        return "size", by_size(g, keep, c["files"] * c["mean_size"] / 2)
    return ("frequency", by_frequency(g, keep)) if unused > 0.2 else ("relevance", by_relevance(g, keep))


#: Levels and tasks, and what each level keeps of the tokens.
LEVELS = {"minimal": "relevance", "balanced": "hybrid", "aggressive": "size"}
TASKS = {"debugging": "dependency", "refactoring": "hybrid", "documentation": "relevance"}
REDUCTION = {"minimal": 0.3, "balanced": 0.6, "aggressive": 0.15}


def strategy_for(level: str | None = None, task: str | None = None) -> str:
    return TASKS.get(task or "") or LEVELS.get(level or "", "hybrid")


def pick(size: int, files: int, preserves: bool) -> str:
    """The controller's choice where none is asked for."""
    return "size" if size > 50_000 else "dependency" if files > 1000 else "relevance" if preserves else "hybrid"


def compact(g: Graph, strategy: str | None = None, names: list[str] | None = None, parts: list[str] | None = None, most: float = 10_000, enabled: bool = True) -> tuple[str, Graph]:
    """(strategy, compacted graph). Without a strategy one is picked by size; when switched off the graph stays."""
    if g is None:
        raise ValueError("no graph to compact")
    if not enabled:
        return "none", g
    keep = preserved(F.col("path"), names or [], parts or [])
    strategy = strategy or pick(g.size(), g.files.count(), bool(names or parts))
    if strategy == "adaptive":
        strategy, paths = by_adaptive(g, keep)
        return strategy, g.kept(paths)
    ways = {"relevance": by_relevance, "frequency": by_frequency, "dependency": by_dependency, "hybrid": by_hybrid}
    if strategy == "size":
        return strategy, g.kept(by_size(g, keep, most))
    if strategy not in ways:
        raise ValueError(f"unknown strategy {strategy!r}")
    return strategy, g.kept(ways[strategy](g, keep))


def compact_many(graphs: dict[str, Graph], **options) -> dict[str, tuple[str, Graph]]:
    return {name: compact(g, **options) for name, g in graphs.items()}
