"""Neighborhoods of files: merging, recommendations, scores and clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.ladders import priority
from loomgraph.operators.components import connected_components
from loomgraph.shared import stored


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets as arrays; two empty ones have 0."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def shared_members(sets: DataFrame, key: str = "id", members: str = "members") -> DataFrame:
    """(a, b, both, jaccard) of sets that share a member, a < b: counted over the members, so sets that share none never meet."""
    one = sets.select(F.col(key).alias("k"), F.explode(F.array_distinct(members)).alias("m"))
    sizes = one.groupBy("k").agg(F.count("*").alias("n"))
    pairs = one.select(F.col("k").alias("a"), "m").join(one.select(F.col("k").alias("b"), "m"), "m").where("a < b").groupBy("a", "b").agg(F.count("*").alias("both"))
    out = pairs.join(sizes.select(F.col("k").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("k").alias("b"), F.col("n").alias("nb")), "b")
    return out.select("a", "b", "both", (F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("jaccard"))


def similar_sets(sets: DataFrame, least: float, key: str = "id", members: str = "members") -> DataFrame:
    """(a, b, both, jaccard) of sets with a Jaccard similarity of ``least`` (over 0) or more, a < b.

    With members in one order, rare ones first, two such sets share one of the first of either: all but ``least`` of its size, and one more. So only those meet,
    within a band of sizes, and a member of very many sets, being last, is seldom among them. What meets is compared whole. Null members
    and repeated ones don't count; two empty sets have 0.
    """
    one = sets.select(F.col(key).alias("k"), F.explode(F.array_distinct(members)).alias("m")).where("m is not null")
    often = one.groupBy("m").agg(F.count("*").alias("n"))
    whole = one.join(often, "m").groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "m"))), lambda x: x["m"]).alias("ms"))
    whole = stored(whole.withColumn("size", F.size("ms")), "sets")
    first = (F.col("size") - F.ceil(F.lit(least) * F.col("size") - 1e-9) + 1).cast("int")
    keyed = lambda s: whole.select(F.col("k").alias(s), F.col("size").alias(f"n{s}"), F.explode(F.slice("ms", F.lit(1), first)).alias("m"))
    band = (F.col("na") >= F.lit(least) * F.col("nb") - 1e-9) & (F.col("nb") >= F.lit(least) * F.col("na") - 1e-9)
    pairs = keyed("a").join(keyed("b"), "m").where((F.col("a") < F.col("b")) & band).select("a", "b").distinct()
    side = lambda s: whole.select(F.col("k").alias(s), F.col("ms").alias(f"m{s}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", F.size(F.array_intersect("ma", "mb")).cast("long").alias("both"), (F.size("ma") + F.size("mb")).alias("sizes"))
    return met.withColumn("jaccard", F.col("both") / (F.col("sizes") - F.col("both"))).where(F.col("jaccard") >= least).drop("sizes")


def greedy_keep(items: DataFrame, conflicts: DataFrame) -> DataFrame:
    """(id) of what a pass in order keeps, when each kept one excludes those it conflicts with; conflicts are (a, b), a the earlier.

    Rounds decide all that have no undecided earlier one against them: the same result as the pass. There are as many as the longest chain of
    conflicts needs, for each decides the earliest one at least.
    """
    open_, against = stored(items.select("id"), "open"), stored(conflicts.select("a", "b"), "against")
    kept, rounds = open_.where("false"), 0
    while open_.limit(1).count():
        blocked = against.select(F.col("b").alias("id")).distinct()
        now = stored(open_.join(blocked, "id", "left_anti"), "kept")
        rounds += 1
        kept = kept.unionByName(now) if rounds % 16 else stored(kept.unionByName(now), "kept")  # so that plans stay small
        gone = against.join(now.withColumnRenamed("id", "a"), "a").select(F.col("b").alias("id")).distinct()
        open_ = stored(open_.join(now, "id", "left_anti").join(gone, "id", "left_anti"), "open")
        a, b = open_.withColumnRenamed("id", "a"), open_.withColumnRenamed("id", "b")
        against = stored(against.join(a, "a", "left_semi").join(b, "b", "left_semi"), "against")
    return kept


def merge_similar(neighborhoods: DataFrame, overlap: float = 0.8) -> DataFrame:
    """Neighborhoods (id, strength, members) left when, from the strongest (ties by id), each one drops later ones that overlap it by more than ``overlap``."""
    own = stored(neighborhoods, "neighborhoods")
    place = lambda c: own.select(F.col("id").alias(c), F.struct((-F.col("strength")).alias("s"), F.col("id").alias("i")).alias(f"p{c}"))
    close = similar_sets(own, overlap).where(F.col("jaccard") > overlap).join(place("a"), "a").join(place("b"), "b")
    first = F.col("pa") < F.col("pb")
    conflicts = close.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("b"))
    return own.join(greedy_keep(own, conflicts), "id")


def summary(neighborhoods: DataFrame, patterns: DataFrame, relationships: DataFrame) -> DataFrame:
    """One row: distinct files of all neighborhoods (members), how many neighborhoods and patterns there are, and relationships by strength."""
    files = neighborhoods.select(F.explode("members").alias("file")).agg(F.count_distinct("file").alias("files"))
    found = neighborhoods.agg(F.count("*").alias("neighborhoods"))
    by = [F.count_if(F.col("strength") == s).alias(s) for s in ("strong", "moderate", "weak")]
    return files.crossJoin(found).crossJoin(patterns.agg(F.count("*").alias("patterns"))).crossJoin(relationships.agg(*by))


def strongest(neighborhoods: DataFrame) -> DataFrame:
    """(file, id, others, strength, priority): for each file its strongest neighborhood, and that one's other files."""
    one = neighborhoods.select("id", "strength", "members", F.explode("members").alias("file"))
    best = one.groupBy("file").agg(F.max_by(F.struct("id", "strength", "members"), F.struct("strength", F.col("id"))).alias("n"))
    return best.select("file", "n.id", F.array_sort(F.array_except("n.members", F.array("file"))).alias("others"), "n.strength", priority(F.col("n.strength")).alias("priority"))


def combined_score(correlation: Column, dependency: Column, structure: Column, weights: tuple[float, float, float] = (0.6, 0.3, 0.1)) -> Column:
    """Weighted mean of the parts that are known."""
    parts = list(zip((correlation, dependency, structure), weights, strict=True))
    total = sum((F.when(c.isNotNull(), F.lit(w)).otherwise(0.0) for c, w in parts), F.lit(0.0))
    return F.try_divide(sum((F.coalesce(c, F.lit(0.0)) * w for c, w in parts), F.lit(0.0)), total)


def cluster_edges(files: DataFrame, deps: DataFrame, patterns: DataFrame, least: float = 0.1) -> DataFrame:
    """(a, b, weight, type) of neighborhoods: .6, .3 and .1 of the Jaccards of files, dependencies and name patterns; all three in are (id, members)."""
    parts = [("git", files, 0.6), ("dep", deps, 0.3), ("struct", patterns, 0.1)]
    out = None
    for name, sets, _ in parts:
        one = shared_members(sets).select("a", "b", F.col("jaccard").alias(name))
        out = one if out is None else out.join(one, ["a", "b"], "full")
    out = out.na.fill(0.0, [n for n, _, _ in parts])
    weight = sum((F.col(n) * w for n, _, w in parts), F.lit(0.0))
    kind = F.when((F.col("dep") >= F.col("struct")) & (F.col("dep") >= F.col("git")), "dependency").when(F.col("struct") >= F.col("git"), "structural").otherwise("git_pattern")
    return out.withColumn("weight", weight).where(F.col("weight") > least).select("a", "b", "weight", kind.alias("type"))


def spanning_forest(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(a, b, distance): a minimum spanning forest by Boruvka's rounds; ties go by (a, b). Components at least halve in each round."""
    edges = stored(edges.where("a <> b").groupBy("a", "b").agg(F.min("distance").alias("distance")), "mst-edges")
    left = edges.select("a", "b", "distance", F.col("a").alias("ca"), F.col("b").alias("cb"))
    forest = None
    for _ in range(max_rounds):
        side = F.explode(F.array(F.col("ca"), F.col("cb"))).alias("c")
        best = left.select(side, F.struct("distance", "a", "b").alias("e")).groupBy("c").agg(F.min("e").alias("e")).select("e.*").distinct()
        best = stored(best, "mst-best")
        forest = best if forest is None else forest.unionByName(best)
        forest = stored(forest.distinct(), "mst-forest")
        labels = connected_components(forest, "a", "b")
        la = labels.select(F.col("node").alias("a"), F.col("component").alias("ca"))
        lb = labels.select(F.col("node").alias("b"), F.col("component").alias("cb"))
        left = stored(edges.join(la, "a").join(lb, "b").where("ca <> cb").select("a", "b", "distance", "ca", "cb"), "mst-left")
        if left.limit(1).count() == 0:
            return forest.select("a", "b", "distance")
    raise RuntimeError(f"no forest after {max_rounds} rounds")


def single_linkage(nodes: DataFrame, edges: DataFrame, clusters: int) -> DataFrame:
    """(id, cluster): single-linkage clusters of nodes (id) by edges (a, b, distance), merged until ``clusters`` are left: the spanning forest without its longest edges. Nodes that no edge joins stay apart."""
    forest = stored(spanning_forest(edges), "forest")
    pieces = nodes.count() - forest.count()
    longest = forest.orderBy(F.desc("distance"), F.desc("a"), F.desc("b")).limit(max(0, clusters - pieces)).select("a", "b")
    cut = forest.join(longest, ["a", "b"], "left_anti")
    labels = connected_components(cut, "a", "b").select(F.col("node").alias("id"), F.col("component").alias("cluster"))
    return nodes.join(labels, "id", "left").select("id", F.coalesce("cluster", "id").alias("cluster"))


def with_unlinked(nodes: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """(a, b, distance) of all pairs of nodes (id, score, strength): that of their edge, or half the sum of their differences.

    Every pair is needed to merge down to any number of clusters. Clustering is of the ``most`` best nodes
    by score (ties by id), as many as are reported, so they are put together in one row.
    """
    top = nodes.orderBy(F.desc("score"), "id").limit(most)
    row = top.agg(F.sort_array(F.collect_list(F.struct("id", "score", "strength"))).alias("v"))
    later = lambda x, i: F.transform(F.slice("v", i + 2, F.size("v")), lambda y: F.struct(x["id"].alias("a"), y["id"].alias("b"), ((F.abs(x["score"] - y["score"]) + F.abs(x["strength"] - y["strength"])) / 2).alias("apart")))
    pairs = row.select(F.explode(F.flatten(F.transform("v", later))).alias("p")).select("p.*")
    return pairs.join(edges.select("a", "b", "distance"), ["a", "b"], "left").select("a", "b", F.coalesce("distance", "apart").alias("distance"))


def cluster_metrics(clusters: DataFrame, scores: DataFrame, edges: DataFrame) -> DataFrame:
    """For each cluster its size, density (edges of both directions over n(n - 1)), least, mean and greatest distance, cohesion 1 / (1 + mean), and strength (mean score + cohesion) / 2.

    Three indices of quality go with them: silhouette (the cohesion), davies_bouldin (what the density
    lacks of 1) and calinski_harabasz (strength times size).
    """
    a = clusters.select(F.col("id").alias("a"), F.col("cluster").alias("ca"))
    b = clusters.select(F.col("id").alias("b"), F.col("cluster").alias("cb"))
    inner = edges.join(a, "a").join(b, "b").where("ca = cb").groupBy(F.col("ca").alias("cluster")).agg(F.count("*").alias("edges"), F.avg("distance").alias("mean"), F.min("distance").alias("nearest"), F.max("distance").alias("farthest"))
    own = clusters.join(scores, "id").groupBy("cluster").agg(F.count("*").alias("size"), F.avg("score").alias("score"))
    out = own.join(inner, "cluster", "left").na.fill(0, ["edges"]).na.fill(0.0, ["mean", "nearest", "farthest"])
    cohesion = 1 / (1 + F.col("mean"))
    density = F.when(F.col("size") > 1, 2.0 * F.col("edges") / (F.col("size") * (F.col("size") - 1))).otherwise(0.0)
    out = out.select("cluster", "size", "nearest", "mean", "farthest", density.alias("density"), cohesion.alias("cohesion"), ((F.col("score") + cohesion) / 2).alias("strength"))
    return out.withColumns({"silhouette": F.col("cohesion"), "davies_bouldin": 1 - F.col("density"), "calinski_harabasz": F.col("strength") * F.col("size")})


#: Words that name nothing.
COMMON_WORDS = tuple(
    """
    the and is are was were have has had will would could should can may might must do does did be been being to of in on
    at by for with from as but or if when where why how what which who whom whose this that these those a an it its they
    them their theirs we us our ours you your yours he him his she her hers i me my mine all any each every no none some
    many much few little more most less least other another same different new old good bad big small long short high low
    first last next previous before after during while since until now then here there anywhere everywhere somewhere nowhere
    """.split()
)


def cluster_names(members: DataFrame, cluster: str, name: str) -> DataFrame:
    """(cluster, name): the most frequent word of a cluster's names that is not a common one, ties in order of the alphabet; a plain name without any."""
    words = F.filter(F.split(F.lower(name), "[^a-z]+"), lambda w: (F.length(w) > 2) & ~w.isin(*COMMON_WORDS))
    counted = members.select(cluster, F.explode_outer(words).alias("word")).groupBy(cluster, "word").agg(F.count("*").alias("n"))
    best = counted.groupBy(cluster).agg(F.min_by("word", F.struct(F.col("word").isNull(), -F.col("n"), "word")).alias("word"))
    return best.select(cluster, F.when(F.col("word").isNull(), "cluster").otherwise(F.concat("word", F.lit("-cluster"))).alias("name"))


def describe_cluster(neighborhoods: Column, files: Column, score: Column) -> Column:
    return F.format_string("Cluster of %d neighborhoods containing %d files with %.2f average combined score", neighborhoods, files, score)
