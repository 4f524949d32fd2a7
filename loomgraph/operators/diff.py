"""Differences of two versions: files, symbols, properties and dependencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import similarity as S
from loomgraph.operators.graph import strongly_connected
from loomgraph.shared import stored


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, compared: list[str]) -> DataFrame:
    """(key, change, old_*, new_*): added, removed and modified rows of two versions, by one full outer join; equal rows are left out."""
    a = old.select(key, *(F.col(c).alias(f"old_{c}") for c in compared), F.lit(True).alias("in_old"))
    b = new.select(key, *(F.col(c).alias(f"new_{c}") for c in compared), F.lit(True).alias("in_new"))
    same = F.lit(True)
    for c in compared:
        same = same & F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}"))
    change = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(~same, "modified")
    return a.join(b, key, "full").withColumn("change", change).where("change is not null").drop("in_old", "in_new")


def property_changes(diff: DataFrame, key: str, compared: list[str]) -> DataFrame:
    """(key, property, old, new): a row for each property that a modified row changes."""
    rows = F.array(*(F.struct(F.lit(c).alias("property"), F.col(f"old_{c}").cast("string").alias("old"), F.col(f"new_{c}").cast("string").alias("new")) for c in compared))
    changed = F.filter(rows, lambda r: ~r["old"].eqNullSafe(r["new"]))
    return diff.where("change = 'modified'").select(key, F.explode(changed).alias("p")).select(key, "p.*")


def level(steps: list[tuple[Column, str]], rest: str) -> Column:
    out = None
    for condition, name in steps:
        out = F.when(condition, name) if out is None else out.when(condition, name)
    return out.otherwise(rest)


def size_impact(delta: Column) -> Column:
    return level([(F.abs(delta) > 100, "high"), (F.abs(delta) > 20, "medium")], "low")


def complexity_impact(delta: Column) -> Column:
    return level([(delta > 10, "high"), (delta > 5, "medium")], "low")


def count_impact(kind: Column, delta: Column) -> Column:
    return F.when((kind.isin("class", "interface") & (delta != 0)) | (kind.isin("function", "method") & (F.abs(delta) > 5)), "medium").otherwise("low")


def visibility_impact(visibility: Column) -> Column:
    return level([(visibility == "public", "high"), (visibility == "protected", "medium")], "low")


def complexity(signature: Column, lines: Column) -> Column:
    """1, a point for each comma of the signature, and one for each ten lines."""
    return (1 + F.length(signature) - F.length(F.replace(signature, F.lit(","), F.lit(""))) + F.floor(lines / 10)).cast("long")


def breaking_signature(old: Column, new: Column) -> Column:
    """Fewer parameters, new ones without a default, or another return type."""
    a, b = S.parameters(old), S.parameters(new)
    optional = F.forall(F.slice(b, F.size(a) + 1, F.greatest(F.lit(0), F.size(b) - F.size(a))), lambda p: p.contains("=") | p.contains("?"))
    return (F.size(b) < F.size(a)) | ((F.size(b) > F.size(a)) & ~optional) | (S.return_type(old) != S.return_type(new))


def breaking_visibility(old: Column, new: Column) -> Column:
    return F.coalesce(S.visibility_level(new) < S.visibility_level(old), F.lit(False))


def semantic_changes(diff: DataFrame, key: str) -> DataFrame:
    """(key, kind, impact, breaking) of a diff of signature, visibility and doc: additions, deletions, and a row for each property changed."""
    added = diff.where("change = 'added'").select(key, F.lit("addition").alias("kind"), F.when(F.col("new_visibility") == "public", "medium").otherwise("low").alias("impact"), F.lit(False).alias("breaking"))
    removed = diff.where("change = 'removed'").select(key, F.lit("deletion").alias("kind"), visibility_impact(F.col("old_visibility")).alias("impact"), (F.col("old_visibility") == "public").alias("breaking"))
    modified = diff.where("change = 'modified'")
    sig_break, vis_break = breaking_signature(F.col("old_signature"), F.col("new_signature")), breaking_visibility(F.col("old_visibility"), F.col("new_visibility"))
    rows = F.array_compact(
        F.array(
            F.when(F.col("old_signature") != F.col("new_signature"), F.struct(F.lit("signature").alias("kind"), F.when(sig_break, "high").otherwise("medium").alias("impact"), sig_break.alias("breaking"))),
            F.when(F.col("old_visibility") != F.col("new_visibility"), F.struct(F.lit("visibility").alias("kind"), F.when(vis_break, "high").otherwise("low").alias("impact"), vis_break.alias("breaking"))),
            F.when(F.col("old_doc") != F.col("new_doc"), F.struct(F.lit("documentation").alias("kind"), F.lit("low").alias("impact"), F.lit(False).alias("breaking"))),
        )
    )
    return added.unionByName(removed).unionByName(modified.select(key, F.explode(rows).alias("r")).select(key, "r.*"))


def complexity_metrics(changes: DataFrame, group: str) -> DataFrame:
    """For each group its additions, deletions and modifications, and the mean weight of impacts: low 1, medium 2, high 3, critical 5."""
    weight = F.when(F.col("impact") == "critical", 5).when(F.col("impact") == "high", 3).when(F.col("impact") == "medium", 2).otherwise(1)
    return changes.groupBy(group).agg(
        F.count_if(F.col("kind") == "addition").alias("additions"), F.count_if(F.col("kind") == "deletion").alias("deletions"),
        F.count_if(~F.col("kind").isin("addition", "deletion")).alias("modifications"), F.avg(weight).alias("complexity"),
    )


def dependency_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(source, target, change, impact) of two sets of dependencies (source, target, external): by one full outer join."""
    a = old.select("source", "target", F.col("external").alias("was")).distinct()
    b = new.select("source", "target", F.col("external").alias("now")).distinct()
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "modified")
    ext = F.coalesce("now", "was")
    impact = F.when(change == "added", F.when(ext, "medium").otherwise("low")).when(change == "removed", F.when(ext, "high").otherwise("medium")).otherwise("high")
    return a.join(b, ["source", "target"], "full").select("source", "target", change.alias("change"), impact.alias("impact")).where("change is not null")


def import_order_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(source, old_order, new_order, impact) of files whose imports come in another order, where one of them is for its side effects, so that order matters; (source, target, position, side_effect) in."""
    def ordered(df: DataFrame, name: str) -> DataFrame:
        put = F.transform(F.sort_array(F.collect_list(F.struct("position", "target"))), lambda x: x["target"])
        return df.groupBy("source").agg(put.alias(f"{name}_order"), F.max("side_effect").alias(f"{name}_matters"))

    both = ordered(old, "old").join(ordered(new, "new"), "source")
    return both.where("(old_matters or new_matters) and old_order <> new_order").select("source", "old_order", "new_order", F.lit("low").alias("impact"))


def cycle_risks(old: DataFrame, new: DataFrame) -> DataFrame:
    """(component, files, added, impact): cycles of the new dependencies (source, target) that hold a dependency the old ones lack, with how many such."""
    new = stored(new.select("source", "target").distinct(), "new")
    found = stored(strongly_connected(new.select(F.col("source").alias("src"), F.col("target").alias("dst"))), "cycles")
    a, b = found.select(F.col("node").alias("source"), "component"), found.select(F.col("node").alias("target"), F.col("component").alias("other"))
    fresh = new.join(old.select("source", "target").distinct(), ["source", "target"], "left_anti")
    added = fresh.join(a, "source").join(b, "target").where("component = other").groupBy("component").agg(F.count("*").alias("added"))
    return found.groupBy("component").agg(F.count("*").alias("files")).join(added, "component").withColumn("impact", F.lit("high"))
