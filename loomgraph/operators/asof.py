"""As-of joins: the version of a key that is valid at each event."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from loomgraph.shared import stored


def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (k, e, v) in order, those with an event, with the last version of their key so far; then one row without event: the last key with its last version.

    Rows are those of a range of (key, time), so only its last key can go on in the next one.
    """
    part, key, held = TaskContext.get().partitionId(), None, None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        k, v, e = batch.column("k"), batch.column("v"), batch.column("e")
        codes = k.dictionary_encode().indices.to_numpy()
        new = np.concatenate([[True], codes[1:] != codes[:-1]])
        start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        last = np.maximum.accumulate(np.where(v.is_valid().to_numpy(zero_copy_only=False), np.arange(n), -1))
        at = np.where(last >= start, last + 1, 0)  # place 0 is for what earlier batches hold
        own = at > 0
        goes_on = (start == 0) & ~own & (k[0].as_py() == key)
        versions = pa.concat_arrays([pa.nulls(1, v.type) if held is None else held, v])
        picked = versions.take(pa.array(np.where(own | goes_on, at, 0), mask=~(own | goes_on)))
        out = pa.RecordBatch.from_arrays([k, e, picked, pa.array(np.full(n, part, np.int32)), pa.array(picked.is_null())], names=["k", "e", "v", "part", "open"])
        if own[-1]:
            held = v.slice(int(at[-1]) - 1, 1)
        elif not goes_on[-1]:
            held = None
        key = k[n - 1].as_py()
        yield out.filter(e.is_valid())
    if held is not None and held.is_valid()[0].as_py():
        yield pa.RecordBatch.from_arrays([pa.array([key], k.type), pa.nulls(1, e.type), held, pa.array([part], pa.int32()), pa.array([False])], names=["k", "e", "v", "part", "open"])


def as_of(events: DataFrame, versions: DataFrame, key: str, event_time: str, version_time: str, event_order: str, version_order: str, strict: bool = False, ranges: int | None = None) -> DataFrame:
    """The events' columns, and ``version``: a struct of the columns of the key's last version at or before the event, null if there is none.

    At equal times a version comes before an event, or with ``strict`` after it, and of versions at one time the last by ``version_order`` counts. Both sides are put
    together and dealt by ranges of (key, time, order), so a key of very many rows is spread over tasks; what is valid at a range's
    end goes to the ranges after it in one row a range. An event whose key or time is null has no version, and versions
    of such are never valid. Columns of the two sides may share names. Repeated events keep a row each.
    """
    timed = lambda df, t: df.where(F.col(key).isNotNull() & F.col(t).isNotNull())
    row = lambda df, t, o, side, e, v: df.select(F.col(key).alias("k"), F.col(t).alias("t"), F.lit(side).alias("side"), F.col(o).alias("o"), e.alias("e"), v.alias("v"))
    whole = {c: F.struct(*df.columns) for c, df in (("e", events), ("v", versions))}
    none = {c: F.lit(None).cast(df.schema) for c, df in (("e", events), ("v", versions))}
    both = row(timed(versions, version_time), version_time, version_order, int(strict), none["e"], whole["v"]).unionByName(row(timed(events, event_time), event_time, event_order, int(not strict), whole["e"], none["v"]))
    order = ["k", "t", "side", "o"]
    dealt = (both.repartitionByRange(ranges, *order) if ranges else both.repartitionByRange(*order)).sortWithinPartitions(*order).select("k", "e", "v")
    fields = [dealt.schema["k"], StructField("e", dealt.schema["e"].dataType), StructField("v", dealt.schema["v"].dataType), StructField("part", IntegerType()), StructField("open", BooleanType())]
    found = stored(dealt.mapInArrow(filled, StructType(fields)), "as-of")
    edges = found.where("e is null").select(F.col("k").alias("ek"), F.col("v").alias("carried"), F.col("part").alias("from"), F.lead("part").over(Window.partitionBy("k").orderBy("part")).alias("to"))
    events_only = found.where("e is not null")
    valid = (F.col("k") == F.col("ek")) & (F.col("part") > F.col("from")) & (F.col("part") <= F.coalesce("to", F.lit(2**31 - 1)))
    open_rows = events_only.where("open").join(F.broadcast(edges), valid, "left").select("e", F.col("carried").alias("version"))  # a row a range at most
    rest = events.where(F.col(key).isNull() | F.col(event_time).isNull()).select(whole["e"].alias("e"), none["v"].alias("version"))
    return events_only.where("not open").select("e", F.col("v").alias("version")).unionByName(open_rows).unionByName(rest).select("e.*", "version")
