"""Mining of files that change together.

Inputs are ``commit_files(hash, path, ts)``: a row for each file of each commit; repeated rows count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.ladders import strength
from loomgraph.operators.components import connected_components


def change_frequency(commit_files: DataFrame) -> DataFrame:
    return commit_files.select("hash", "path").distinct().groupBy("path").agg(F.count("*").alias("changes"))


def last_modified(commit_files: DataFrame) -> DataFrame:
    return commit_files.groupBy("path").agg(F.max("ts").alias("last_modified"))


def commit_sets(commit_files: DataFrame, most_files: int | None = None) -> DataFrame:
    """(hash, ts, files): each commit's files in order; with ``most_files`` larger commits are left out (sweeping changes say little, and pairs grow with the square)."""
    sets = commit_files.where("path is not null").groupBy("hash").agg(F.max("ts").alias("ts"), F.sort_array(F.collect_set("path")).alias("files"))
    return sets if most_files is None else sets.where(F.size("files") <= most_files)


def dealt(df: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """``df`` by keys in a given number of tasks; as it is without one."""
    return df if tasks is None else df.repartition(tasks, *keys)


def pair_counts(sets: DataFrame, tasks: int | None = None) -> DataFrame:
    """(file1, file2, frequency, first_ts, last_ts) of files of one commit, file1 < file2.

    Commits are put together by one shuffle, and pairs made where they lie, a file at a time. With ``tasks``, for files so many that
    few pairs come twice, pairs are moved as they are and counted by that many tasks; else each task counts its own pairs first.
    """
    one = sets.where(F.size("files") >= 2).select("ts", "files", F.posexplode("files").alias("i", "file1"))
    pairs = one.select("ts", "file1", F.explode(F.slice("files", F.col("i") + 2, F.size("files"))).alias("file2"))
    return dealt(pairs, tasks, "file1", "file2").groupBy("file1", "file2").agg(F.count("*").alias("frequency"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def apply_history(commit_files: DataFrame, batch: DataFrame, tasks: int | None = None) -> DataFrame:
    """(hash, path, ts) after a batch of (hash, path, ts, sign): rows of sign 1 are added and those of -1 withdrawn; rows of one (hash, path) add up, and it is there if the sum is positive."""
    both = commit_files.select("hash", "path", "ts", F.lit(1).alias("sign")).distinct().unionByName(batch.select("hash", "path", "ts", "sign"))
    return dealt(both, tasks, "hash").groupBy("hash", "path").agg(F.max("ts").alias("ts"), F.sum("sign").alias("sign")).where("sign > 0").drop("sign")


def pair_deltas(before: DataFrame, after: DataFrame, tasks: int | None = None) -> DataFrame:
    """(file1, file2, frequency): how common changes of pairs grow or shrink from one state of some commits to another; pairs that don't change are left out."""
    signed = lambda cf, sign: pair_counts(commit_sets(cf), tasks).select("file1", "file2", (F.col("frequency") * sign).alias("frequency"))
    return dealt(signed(before, -1).unionByName(signed(after, 1)), tasks, "file1", "file2").groupBy("file1", "file2").agg(F.sum("frequency").alias("frequency")).where("frequency <> 0")


def maintain_pairs(commit_files: DataFrame, counts: DataFrame, batch: DataFrame, tasks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The history and its pair counts (file1, file2, frequency) after a batch of signed rows.

    Only commits that the batch names are mined again, as they were and as they are, and the difference is added to the stored counts.
    Pairs that no commit holds any more go. Withdrawing what isn't there changes nothing.
    """
    commit_files, batch = dealt(commit_files, tasks, "hash"), dealt(batch, tasks, "hash")
    named = batch.select("hash").distinct()
    touched = commit_files.join(named, "hash", "left_semi").select("hash", "path", "ts")
    now = apply_history(touched, batch, tasks)
    merged = counts.select("file1", "file2", "frequency").unionByName(pair_deltas(touched, now, tasks))
    kept = commit_files.join(named, "hash", "left_anti").select("hash", "path", "ts").unionByName(now)
    return kept, dealt(merged, tasks, "file1", "file2").groupBy("file1", "file2").agg(F.sum("frequency").alias("frequency")).where("frequency <> 0")


def file_counts(sets: DataFrame, least: int = 1) -> DataFrame:
    return sets.where(F.size("files") >= least).select(F.explode("files").alias("path")).groupBy("path").agg(F.count("*").alias("changes"))


def with_file_counts(pairs: DataFrame, counts: DataFrame) -> DataFrame:
    one = counts.select(F.col("path").alias("file1"), F.col("changes").alias("n1"))
    two = counts.select(F.col("path").alias("file2"), F.col("changes").alias("n2"))
    return pairs.join(one, "file1").join(two, "file2")


def mine_pairs(commit_files: DataFrame, min_support: float = 0.05, min_confidence: float = 0.3, most_files: int | None = None) -> DataFrame:
    """Frequent pairs with their confidence, both / max(changes of either), over commits of two files or more.

    A pair needs max(1, floor(min_support * commits)) common changes.
    """
    sets = commit_sets(commit_files, most_files).where(F.size("files") >= 2)
    total = sets.agg(F.greatest(F.lit(1), F.floor(F.count("*") * F.lit(min_support))).alias("least"))
    found = with_file_counts(pair_counts(sets), file_counts(sets)).crossJoin(F.broadcast(total)).where("frequency >= least")
    return found.withColumn("confidence", F.col("frequency") / F.greatest("n1", "n2").cast("double")).where(F.col("confidence") >= min_confidence).drop("least")


def pair_name(a: str | Column, b: str | Column) -> Column:
    base = lambda c: F.regexp_replace(F.regexp_replace(c, r"^.*/", ""), r"\.[^.]*$", "")
    cols = [F.col(x) if isinstance(x, str) else x for x in (a, b)]
    return F.array_join(F.sort_array(F.array(*map(base, cols))), " + ")


def interval_seconds(first: str, last: str, n: str) -> Column:
    """Mean gap between changes: (last - first) / (n - 1), 0 for a single one."""
    gap = F.unix_seconds(F.col(last).cast("timestamp")) - F.unix_seconds(F.col(first).cast("timestamp"))
    return F.when(F.col(n) > 1, F.floor(gap / (F.col(n) - 1))).otherwise(0).cast("long")


def change_patterns(commit_files: DataFrame, min_support: float = 0.05, min_confidence: float = 0.3) -> DataFrame:
    """Mined pairs with a name, mean interval and support over all commits."""
    commits = commit_files.agg(F.count_distinct("hash").alias("commits"))
    found = mine_pairs(commit_files, min_support, min_confidence).crossJoin(F.broadcast(commits))
    return found.select(
        "file1", "file2", pair_name("file1", "file2").alias("name"), "frequency", F.round("confidence", 6).alias("confidence"),
        F.col("last_ts").alias("last_occurrence"), interval_seconds("first_ts", "last_ts", "frequency").alias("avg_interval_s"),
        F.round(F.col("frequency") / F.col("commits"), 6).alias("support"),
    )


def together_share(commit_files: DataFrame) -> DataFrame:
    """(file1, file2, together, separate, share): commits with both files against commits with one of them only."""
    sets = commit_sets(commit_files)
    found = with_file_counts(pair_counts(sets), file_counts(sets))
    separate = F.col("n1") + F.col("n2") - 2 * F.col("frequency")
    return found.select("file1", "file2", F.col("frequency").alias("together"), separate.alias("separate"), (F.col("frequency") / (F.col("frequency") + separate).cast("double")).alias("share"))


def cooccurrences(commit_files: DataFrame, least: int = 2, tasks: int | None = None) -> DataFrame:
    """(path, partner, n, rank): partners changed with a file at least ``least`` times, most frequent first."""
    from pyspark.sql import Window

    pairs = pair_counts(commit_sets(commit_files), tasks).where(F.col("frequency") >= least)
    both = pairs.select(F.explode(F.array(F.struct(F.col("file1").alias("path"), F.col("file2").alias("partner")), F.struct(F.col("file2").alias("path"), F.col("file1").alias("partner")))).alias("p"), F.col("frequency").alias("n"))
    order = Window.partitionBy("path").orderBy(F.desc("n"), "partner")
    return dealt(both.select("p.path", "p.partner", "n"), tasks, "path").withColumn("rank", F.row_number().over(order))


def file_relationships(commit_files: DataFrame, least: int = 2, steps: list[tuple[float, str]] | None = None) -> DataFrame:
    """Pairs with Jaccard correlation n / (n1 + n2 - n), and its strength."""
    sets = commit_sets(commit_files)
    found = with_file_counts(pair_counts(sets).where(F.col("frequency") >= least), file_counts(sets))
    joint = F.try_divide(F.col("frequency"), F.col("n1") + F.col("n2") - F.col("frequency"))
    return found.select("file1", "file2", "frequency", joint.alias("correlation")).withColumn("strength", strength(F.col("correlation"), steps))


def file_relationships_flat(commit_files: DataFrame, least: int = 2) -> DataFrame:
    """The same pairs with the compatible correlation 1 / (n1 + n2 - 1), which counts one common change whatever their number."""
    sets = commit_sets(commit_files)
    found = with_file_counts(pair_counts(sets).where(F.col("frequency") >= least), file_counts(sets))
    return found.select("file1", "file2", F.try_divide(F.lit(1), F.col("n1") + F.col("n2") - 1).alias("correlation")).withColumn("strength", strength(F.col("correlation")))


def module_groups(relationships: DataFrame) -> DataFrame:
    """(node, component): files that strong relationships join; ``relationships`` has file1 and file2."""
    return connected_components(relationships, "file1", "file2")


def module_metrics(groups: DataFrame, edges: DataFrame) -> DataFrame:
    """For each group its files, edges inside and to other files, their frequencies, and cohesion: the share that is inside."""
    a = groups.select(F.col("node").alias("file1"), F.col("component").alias("c1"))
    b = groups.select(F.col("node").alias("file2"), F.col("component").alias("c2"))
    touched = edges.join(a, "file1", "left").join(b, "file2", "left").where("c1 is not null or c2 is not null")
    inside = F.col("c1").eqNullSafe(F.col("c2"))
    sides = touched.select(F.explode(F.array_distinct(F.array_compact(F.array("c1", "c2")))).alias("component"), inside.alias("inside"), "frequency", "last_ts")
    sums = sides.groupBy("component").agg(F.count_if("inside").alias("internal"), F.count_if(~F.col("inside")).alias("external"), F.sum(F.when(F.col("inside"), F.col("frequency")).otherwise(0)).alias("changes"), F.max("last_ts").alias("last_changed"))
    sizes = groups.groupBy("component").agg(F.count("*").alias("files"))
    return sizes.join(sums, "component").withColumn("cohesion", F.try_divide(F.col("internal"), F.col("internal") + F.col("external")))
