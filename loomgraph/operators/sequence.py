"""Sequence diffs: which nodes of a file stay in order, move, change, come and go between two versions."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructType


def longest_increasing(values: np.ndarray) -> np.ndarray:
    """A mask of one longest run of increasing values (distinct numbers) that keeps their order: least last values by length, then back along predecessors."""
    tails: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    for i, v in enumerate(values.tolist()):
        k = bisect_left(tails, v)
        before.append(ends[k - 1] if k else -1)
        if k == len(tails):
            tails.append(v)
            ends.append(i)
        else:
            tails[k], ends[k] = v, i
    mask = np.zeros(len(values), bool)
    at = ends[-1] if ends else -1
    while at >= 0:
        mask[at] = True
        at = before[at]
    return mask


def node_diff(old: DataFrame, new: DataFrame, file: str, node: str, place: str, content: str) -> DataFrame:
    """(file, node, nth, old_place, new_place, in_order, edited) of all nodes of two versions of files.

    A node that stands several times in a file is told apart by which one it is, so the k-th of the old version is the
    k-th of the new. Nodes of both versions that are in a longest common subsequence of the file are ``in_order``;
    others of both have moved. ``edited`` is whether the content of a node of both differs; both flags are null
    for inserted and removed nodes. Content may be null, a null file or node is a value like others. A file's nodes are in one task;
    files follow each other in a task's batches, so many small ones cost no more than few large ones.
    """
    nth = F.row_number().over(Window.partitionBy(file, node).orderBy(place))
    side = lambda df, p: df.select(F.col(file).alias("f"), F.col(node).alias("n"), nth.alias("nth"), F.col(place).cast("long").alias(f"{p}_place"), F.col(content).alias(f"{p}_content"))
    a, b = side(old, "old").alias("a"), side(new, "new").alias("b")
    both = a.join(b, F.col("a.f").eqNullSafe(F.col("b.f")) & F.col("a.n").eqNullSafe(F.col("b.n")) & (F.col("a.nth") == F.col("b.nth")), "full_outer")
    kept = F.col("old_place").isNotNull() & F.col("new_place").isNotNull()
    one = lambda c: F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c)
    edited = F.when(kept, ~F.col("old_content").eqNullSafe(F.col("new_content")))
    joined = both.select(one("f"), one("n"), one("nth"), "old_place", "new_place", edited.alias("edited"))

    def ordered(batches):
        held: list[pa.RecordBatch] = []  # the last file so far, which may go on in the next batch

        def done(pieces):
            table = pa.Table.from_batches(pieces)
            places = table.column("new_place").to_numpy()
            starts = np.flatnonzero(table.column("at").to_numpy() == 1)
            masks = [longest_increasing(places[i:j]) for i, j in zip(starts, [*starts[1:], len(places)])]
            return table.drop_columns(["at"]).append_column("in_order", pa.array(np.concatenate(masks))).to_batches()

        for batch in batches:
            starts = np.flatnonzero(batch.column("at").to_numpy() == 1)
            if len(starts):
                if held or starts[-1]:
                    yield from done([*held, batch.slice(0, starts[-1])])
                held = []
            held.append(batch.slice(starts[-1] if len(starts) else 0))
        if held := [x for x in held if x.num_rows]:
            yield from done(held)

    schema = StructType(joined.schema.fields).add("in_order", BooleanType())
    placed = joined.where(F.col("edited").isNotNull()).withColumn("at", F.row_number().over(Window.partitionBy("f").orderBy("old_place")))
    matched = placed.mapInArrow(ordered, schema)
    rest = joined.where(F.col("edited").isNull()).withColumn("in_order", F.lit(None).cast("boolean"))
    return matched.unionByName(rest).select(F.col("f").alias(file), F.col("n").alias(node), "nth", "old_place", "new_place", "in_order", "edited")


def diff_summary(diff: DataFrame, file: str) -> DataFrame:
    """(file, old_nodes, new_nodes, in_order, moved, edited, inserted, removed, similarity): counts for each file, and the Jaccard similarity of the two versions' nodes."""
    old, new = F.col("old_place").isNotNull(), F.col("new_place").isNotNull()
    counts = diff.groupBy(file).agg(
        F.count_if(old).alias("old_nodes"), F.count_if(new).alias("new_nodes"), F.count_if("in_order").alias("in_order"), F.count_if(~F.col("in_order")).alias("moved"),
        F.count_if("edited").alias("edited"), F.count_if(~old).alias("inserted"), F.count_if(~new).alias("removed"), F.count_if(old & new).alias("both"), F.count("*").alias("all"),
    )
    return counts.withColumn("similarity", F.col("both") / F.col("all")).drop("both", "all")
