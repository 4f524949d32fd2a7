"""Two versions of files compared in one call: declarations added, deleted, changed and renamed, and dependencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators import diff as D
from loomgraph.operators.rename import detect_renames
from loomgraph.shared import stored
from loomgraph.sources.symbols import extract_imports, extract_symbols

CHANGE = "path string, category string, kind string, name string, old_value string, new_value string, impact string, breaking boolean"


def declared(files: DataFrame) -> DataFrame:
    """(path, kind, name, nth, line, size, signature, visibility): a file's declarations; those of one kind and name are told apart by which one they are."""
    nth = F.row_number().over(Window.partitionBy("path", "type", "name").orderBy("start_line", "symbol_id"))
    words = lambda *some: F.col("signature").rlike(r"^(?:" + "|".join(some) + r")\b")
    visibility = F.when(words("private"), "private").when(words("protected"), "protected").when(words("export", "public", "pub"), "public").otherwise("internal")
    return extract_symbols(files).select("path", F.col("type").alias("kind"), "name", nth.alias("nth"), F.col("start_line").alias("line"), (F.col("end_line") - F.col("start_line") + 1).alias("size"), "signature", visibility.alias("visibility"))


def compare_files(old: DataFrame, new: DataFrame, min_score: float = 0.8) -> DataFrame:
    """(path, category, kind, name, old_value, new_value, impact, breaking): all changes between two versions of files (path, content).

    Categories are addition, deletion, modification (of a signature, or of size by more than 20 lines), rename and dependency; kinds are those of declarations, and of
    modifications what has changed. A declaration that a rename takes from one name to another is neither deleted nor added. Files of one
    version only are compared with nothing. Names and signatures of a rename are the values, of a dependency its path.
    """
    a, b = stored(declared(old), "old"), stored(declared(new), "new")
    key = ["path", "kind", "name", "nth"]
    side = lambda df, p: df.select(*key, *(F.col(c).alias(f"{p}_{c}") for c in ("line", "size", "signature", "visibility")))
    both = stored(side(a, "old").join(side(b, "new"), key, "full"), "matched")
    gone, come = both.where("new_line is null"), both.where("old_line is null")
    named = lambda df, p: df.select(F.concat_ws("\x00", "path", "kind", "name", F.col("nth").cast("string")).alias("id"), "name", F.col(f"{p}_signature").alias("signature"), "kind", F.col(f"{p}_visibility").alias("visibility"), F.col(f"{p}_size").alias("size"), F.col(f"{p}_line").alias("line"), F.lit("").alias("doc"), "path")
    renamed = stored(detect_renames(named(gone, "old"), named(come, "new"), min_score=min_score).select("old_id", "new_id", F.col("old_path").alias("path"), F.col("old_kind").alias("kind"), "old_name", "new_name", "risk"), "renamed")
    left = lambda df, c: df.withColumn("id", F.concat_ws("\x00", "path", "kind", "name", F.col("nth").cast("string"))).join(renamed.select(F.col(c).alias("id")), "id", "left_anti")
    none = F.lit(None).cast("string")

    def rows(df: DataFrame, category: str, kind, name, before, after, impact, breaking) -> DataFrame:
        return df.select("path", F.lit(category).alias("category"), kind.alias("kind"), name.alias("name"), before.alias("old_value"), after.alias("new_value"), impact.alias("impact"), breaking.alias("breaking"))

    c = F.col
    kept = both.where("old_line is not null and new_line is not null")
    breaks = D.breaking_signature(c("old_signature"), c("new_signature"))
    grown = c("new_size") - c("old_size")
    out = rows(left(come, "new_id"), "addition", c("kind"), c("name"), none, c("new_signature"), F.when(c("new_visibility") == "public", "medium").otherwise("low"), F.lit(False))
    out = out.unionByName(rows(left(gone, "old_id"), "deletion", c("kind"), c("name"), c("old_signature"), none, D.visibility_impact(c("old_visibility")), c("old_visibility") == "public"))
    out = out.unionByName(rows(kept.where("old_signature <> new_signature"), "modification", F.lit("signature"), c("name"), c("old_signature"), c("new_signature"), F.when(breaks, "high").otherwise("medium"), breaks))
    sized = kept.where(F.abs(grown) > 20)
    out = out.unionByName(rows(sized, "modification", F.lit("size"), c("name"), c("old_size").cast("string"), c("new_size").cast("string"), D.size_impact(grown), F.lit(False)))
    out = out.unionByName(rows(renamed, "rename", c("kind"), c("new_name"), c("old_name"), c("new_name"), c("risk"), F.lit(True)))
    deps = lambda df: extract_imports(df).select(F.col("path").alias("source"), F.col("import_path").alias("target"), (~F.col("import_path").startswith(".")).alias("external"))
    changed = D.dependency_changes(deps(old), deps(new)).withColumnRenamed("source", "path")
    return out.unionByName(rows(changed, "dependency", c("change"), c("target"), F.when(c("change") != "added", c("target")), F.when(c("change") != "removed", c("target")), c("impact"), c("change") == "removed"))


def change_summary(changes: DataFrame) -> DataFrame:
    """(path, additions, deletions, modifications, renames, dependencies, breaking, complexity): counts for each file, and the mean weight of impacts: low 1, medium 2, high 3."""
    n = lambda c: F.count_if(F.col("category") == c)
    weight = F.when(F.col("impact") == "high", 3).when(F.col("impact") == "medium", 2).otherwise(1)
    return changes.groupBy("path").agg(n("addition").alias("additions"), n("deletion").alias("deletions"), n("modification").alias("modifications"), n("rename").alias("renames"), n("dependency").alias("dependencies"), F.count_if("breaking").alias("breaking"), F.avg(weight).alias("complexity"))
