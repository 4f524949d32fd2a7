"""Watching a source tree: debounced batches of changes, count-or-time batches, and a table kept up to date."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import paths as P
from loomgraph.operators.incremental import CHANGE_PRIORITY, VersionedTable, apply_changes

CHANGES = "change_id long, ts timestamp, path string, op string"
COMMITS = "hash string, path string, commit_ts timestamp"
NO_PRIORITY = 10  # of operations without one


def change_stream(spark: SparkSession, folder: str, schema: str = CHANGES, files_per_trigger: int = 100) -> DataFrame:
    """Changes that arrive as JSON files in a folder. Load is shed by taking fewer files at a time, never by dropping any."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def watched(changes: DataFrame) -> DataFrame:
    return changes.where(P.watched(F.col("path")))


def debounced(changes: DataFrame, gap: str = "500 milliseconds", late: str = "10 seconds", key: str = "path") -> DataFrame:
    """(key, start, end, n, op): a row for each run of a key's changes with less than ``gap`` between them, with its last operation.

    Event time, with a watermark: a run is given out once ``late`` has passed after it; changes later than
    that are dropped.
    """
    if changes.isStreaming:
        changes = changes.withWatermark("ts", late)
    w = F.session_window("ts", gap)
    out = changes.groupBy(key, w).agg(F.count("*").alias("n"), F.max_by("op", F.struct("ts", "change_id")).alias("op"))
    return out.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", "op")


class Batcher:
    """Groups a key's changes until there are ``size`` of them, or ``wait_ms`` have passed since the first (the watermark's time), or half of that if one of them is urgent.

    A change is urgent if its operation's priority is ``URGENT`` or less. One state holds both deadlines: the changes, the first one's time and the
    least priority so far. A change after the deadline starts a batch of its own, even if the timer has not fired yet.
    """

    URGENT = 2

    def __init__(self, size: int = 5, wait_ms: int = 500):
        self.size, self.wait_ms = size, wait_ms

    def wait(self, priority: int) -> tuple[int, str]:
        return (self.wait_ms // 2, "priority") if priority <= self.URGENT else (self.wait_ms, "time")

    def __call__(self, key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held, since, priority = (list(state.get[0]), *state.get[1:]) if state.exists else ([], 0, NO_PRIORITY)
        if state.hasTimedOut:
            state.remove()
            yield self.row(key, held, self.wait(priority)[1])
            return
        out = []
        for frame in frames:
            for row in frame.sort_values(["ts", "change_id"]).itertuples():
                at = int(row.ts.value // 1_000_000)
                limit, why = self.wait(priority)
                if held and at > since + limit:
                    out.append(self.row(key, held, why))
                    held = []
                if not held:
                    since, priority = at, NO_PRIORITY
                held.append(int(row.change_id))
                priority = min(priority, CHANGE_PRIORITY.get(row.op, NO_PRIORITY))
                if len(held) >= self.size:
                    out.append(self.row(key, held, "size"))
                    held = []
        if held:
            state.update((held, since, priority))
            state.setTimeoutTimestamp(max(since + self.wait(priority)[0], state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield from out

    @staticmethod
    def row(key: tuple, held: list[int], why: str) -> pd.DataFrame:
        return pd.DataFrame({"path": [key[0]], "changes": [held], "n": [len(held)], "reason": [why]})


def batched(changes: DataFrame, size: int = 5, wait_ms: int = 500, late: str = "10 seconds", key: str = "path") -> DataFrame:
    """(path, changes, n, reason): a stream's changes of each key in batches by count, by time, or by half the time where an operation is urgent (``CHANGE_PRIORITY``)."""
    return changes.withWatermark("ts", late).groupBy(key).applyInPandasWithState(Batcher(size, wait_ms), "path string, changes array<long>, n long, reason string", "held array<long>, since long, priority long", "append", "EventTimeTimeout")


def followed_by_commits(changes: DataFrame, commits: DataFrame, within: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(change_id, path, ts, hash, commit_ts): each change with every commit of its path that follows within a time; null where none does.

    ``changes`` has (change_id, path, ts) and ``commits`` (hash, path, commit_ts). Either side may be a stream. Both sides of a stream have a watermark, and the
    interval bounds what is kept: a change waits until no commit can follow it any more, a commit until no change can come before it. Rows later than
    ``late`` are dropped, as in any stream. A null path or time is never followed.
    """
    if changes.isStreaming:
        changes = changes.withWatermark("ts", late)
    if commits.isStreaming:
        commits = commits.withWatermark("commit_ts", late)
    a, b = changes.select("change_id", "path", "ts"), commits.select("hash", F.col("path").alias("of"), "commit_ts")
    follows = (F.col("path") == F.col("of")) & (F.col("commit_ts") >= F.col("ts")) & (F.col("commit_ts") <= F.col("ts") + F.expr(f"interval {within}"))
    return a.join(b, follows, "left_outer").select("change_id", "path", "ts", "hash", "commit_ts")


def keep_table(changes: DataFrame, table: VersionedTable, key: str, deleted: Column, checkpoint: str, available_now: bool = True):
    """A stream that applies each batch of changes to a versioned table; a batch that is done again after a failure gives the same version's content."""

    def merge(batch: DataFrame, _: int) -> None:
        table.write(apply_changes(table.read(), batch, key, deleted))

    writer = changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def refresh_on_change(changes: DataFrame, refresh: Callable[[DataFrame], None], checkpoint: str):
    """Call ``refresh`` with each batch of debounced changes."""
    return changes.writeStream.foreachBatch(lambda batch, _: refresh(batch)).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
