"""Incremental maintenance: applying changes, plans of patches, impact, batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from loomgraph.operators.diff import snapshot_diff
from loomgraph.operators.order import in_order, in_order_within
from loomgraph.shared import shared_dir

#: What a change weighs in the order of a batch, and patches' order.
CHANGE_PRIORITY = {"file_delete": 1, "symbol_delete": 2, "file_add": 3, "symbol_add": 4, "file_modify": 5, "symbol_modify": 6}
PATCH_PRIORITY = {"added": 1, "modified": 2, "removed": 3}
MS_PER_PATCH, TOKENS_PER_FILE, TOKENS_PER_SYMBOL = 10, 100, 50
MANY_PATCHES, WARN_PATCHES = 10, 1000


def by_map(key: Column, values: dict[str, int], rest: int) -> Column:
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(rest))


def last_changes(changes: DataFrame, key: str, ts: str, order: str) -> DataFrame:
    """The last change of each key, by time and then by ``order``: one aggregation that combines on the map side."""
    rest = [c for c in changes.columns if c != key]
    return changes.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(ts, order)).alias("last")).select(key, "last.*")


def apply_changes(state: DataFrame, changes: DataFrame, key: str, deleted: Column, ts: str = "ts", order: str = "change_id") -> DataFrame:
    """State after upserts and deletes: the last change of each key wins, keys that it deletes go, others stay."""
    last = last_changes(changes, key, ts, order)
    values = [c for c in state.columns if c != key]
    touched = last.select(key).distinct()
    upserts = last.where(~deleted).select(key, *values)
    return state.join(touched, key, "left_anti").unionByName(upserts)


def patch_plan(actual: DataFrame, shadow: DataFrame, key: str, compared: list[str]) -> DataFrame:
    """(key, change, priority, update_order): what leads from actual to shadow: additions, then modifications, then removals."""
    diff = snapshot_diff(actual, shadow, key, compared).select(key, "change").withColumn("priority", by_map(F.col("change"), PATCH_PRIORITY, 9))
    return in_order(diff, "priority", key).select(key, "change", "priority", F.col("number").alias("update_order"))


def plan_summary(plan: DataFrame) -> DataFrame:
    """One row: patches, estimated milliseconds, and notes on large plans."""
    n = F.count("*")
    note = F.when(n > WARN_PATCHES, "split the plan").when(n > MANY_PATCHES, "apply in batches").otherwise("")
    return plan.agg(n.alias("patches"), (n * MS_PER_PATCH).alias("estimated_ms"), note.alias("note"))


def plan_conflicts(plan: DataFrame, key: str) -> DataFrame:
    """(key, patches, message, severity): targets that several patches of a plan name, so that the plan isn't valid; a null target is one like others."""
    found = plan.groupBy(key).agg(F.count("*").alias("patches")).where("patches > 1")
    return found.select(key, "patches", F.concat(F.lit("several patches of one target: "), F.coalesce(F.col(key).cast("string"), F.lit("none"))).alias("message"), F.lit("high").alias("severity"))


def plan_validity(plan: DataFrame, key: str) -> DataFrame:
    """One row: patches, targets that several name, whether the plan is valid, and whether it is large."""
    sizes = plan.groupBy(key).agg(F.count("*").alias("n"))
    return sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("patches"), F.count_if(F.col("n") > 1).alias("conflicts")).select("patches", "conflicts", (F.col("conflicts") == 0).alias("valid"), (F.col("patches") > WARN_PATCHES).alias("large"))


def token_delta(diff: DataFrame, per_row: int) -> DataFrame:
    added, removed = F.count_if(F.col("change") == "added"), F.count_if(F.col("change") == "removed")
    return diff.agg((added * per_row).alias("tokens_added"), (removed * per_row).alias("tokens_removed"), ((added - removed) * per_row).alias("tokens_net"))


def impact_summary(diff: DataFrame, structural: Column) -> DataFrame:
    """One row: risk (.8 for a removal, .5 for a structural modification, .1 for an addition), high-impact changes, and advice."""
    removed, added = F.col("change") == "removed", F.col("change") == "added"
    heavy = (F.col("change") == "modified") & structural
    tenths = F.sum(F.when(removed, 8).when(heavy, 5).when(added, 1).otherwise(0))
    high = F.count_if(removed | heavy)
    risk = tenths / F.lit(10.0)
    return diff.agg(F.count("*").alias("changes"), high.alias("high_impact"), risk.alias("risk"), F.when(risk > 2.0, "review before merging").when(high > 0, "review high-impact changes").otherwise("none").alias("advice"))


def ast_risk(diff: DataFrame, group: str) -> DataFrame:
    """(group, added, removed, modified, risk): .5 removed + .3 modified + .1 added."""
    a, r, m = (F.count_if(F.col("change") == c) for c in ("added", "removed", "modified"))
    return diff.groupBy(group).agg(a.alias("added"), r.alias("removed"), m.alias("modified"), (0.5 * r + 0.3 * m + 0.1 * a).alias("risk"))


def sessions(events: DataFrame, gap: str, keys: list[str], ts: str = "ts") -> DataFrame:
    """(keys, start, end, n): runs of events with less than ``gap`` between them, the meaning of a debounce."""
    w = F.session_window(ts, gap)
    return events.groupBy(*keys, w).agg(F.count("*").alias("n")).select(*keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def session_last(events: DataFrame, gap: str, key: str, op: str, ts: str, order: str) -> DataFrame:
    """(key, start, op): the last operation of each key's session."""
    w = F.session_window(ts, gap)
    return events.groupBy(key, w).agg(F.max_by(op, F.struct(ts, order)).alias("op")).select(key, F.col("session_window.start").alias("start"), "op")


def count_batches(events: DataFrame, key: str, size: int, ts: str, order: str) -> DataFrame:
    """Each key's events in batches of ``size``, in order."""
    return in_order_within(events, key, ts, order).withColumn("batch", F.floor((F.col("number") - 1) / size)).drop("number")


def moving_average(events: DataFrame, key: str, value: str, ts: str, order: str, alpha: float = 0.1) -> DataFrame:
    """(key, n, ema): exponential moving average of each key's values in order, from the first; null if one of them is.

    Events are dealt by ranges of (key, time, order), so a key of very many events is spread over tasks. A
    piece of a key's events comes down to its count n, its first value and its sum of alpha (1 - alpha)^later
    value, and the average after a piece is that before times (1 - alpha)^n plus its sum.
    """
    rows = events.select(F.col(key).alias("key"), F.col(ts).alias("ts"), F.col(order).alias("order"), F.col(value).cast("double").alias("value"))
    dealt = rows.repartitionByRange("key", "ts", "order").sortWithinPartitions("key", "ts", "order")

    def reduced(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, values = batch.column("key"), batch.column("value")
            codes = keys.dictionary_encode(null_encoding="encode").indices.to_numpy()
            starts = np.nonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))[0]
            n = np.diff(np.append(starts, len(codes)))
            later = np.repeat(starts + n - 1, n) - np.arange(len(codes))
            missing = values.is_null().to_numpy(zero_copy_only=False)
            known = np.where(missing, 0.0, values.to_numpy(zero_copy_only=False))
            sums = np.add.reduceat(known * alpha * np.power(1 - alpha, later), starts)
            unknown = np.add.reduceat(missing.astype(np.int64), starts) > 0
            at = pa.array(starts)
            yield pa.RecordBatch.from_arrays([keys.take(at), batch.column("ts").take(at), batch.column("order").take(at), pa.array(n.astype(np.int64)), values.take(at), pa.array(sums, mask=unknown)], names=["key", "ts", "order", "n", "first", "total"])

    fields = dealt.schema.fields
    schema = StructType([*(StructField(f.name, f.dataType) for f in fields[:3]), StructField("n", LongType()), StructField("first", DoubleType()), StructField("total", DoubleType())])
    pieces = dealt.mapInArrow(reduced, schema).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("ts", "order", "n", "first", "total"))).alias("v"), F.sum("n").cast("int").alias("n"))
    ema = F.aggregate("v", F.element_at("v", 1)["first"], lambda s, x: s * F.pow(F.lit(1 - alpha), x["n"]) + x["total"])
    return pieces.select(F.col("key").alias(key), "n", ema.alias("ema"))


class VersionedTable:
    """Versions of a table as Parquet folders under one path; the newest is read, and a rollback points back to an older one."""

    def __init__(self, spark, name: str, root: str | None = None):
        self.spark, self.root = spark, f"{(root or shared_dir(spark)).rstrip('/')}/{name}"

    def _names(self) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def versions(self) -> list[int]:
        return [int(n[1:]) for n in self._names() if n.startswith("v")]

    def current(self) -> int:
        marks = [n for n in self._names() if n.startswith("current-")]
        return int(max(marks).rsplit("-", 1)[1]) if marks else -1

    def _point(self, version: int) -> None:
        marks = sum(n.startswith("current-") for n in self._names())
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/current-{marks:09d}-{version:09d}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(path).close()

    def write(self, df: DataFrame) -> int:
        version = max(self.versions(), default=-1) + 1
        df.write.parquet(f"{self.root}/v{version:09d}")
        self._point(version)
        return version

    def read(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/v{self.current() if version is None else version:09d}")

    def rollback(self, version: int) -> None:
        if version not in self.versions():
            raise ValueError(f"no version {version}")
        self._point(version)
