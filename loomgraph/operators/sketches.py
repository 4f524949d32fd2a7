"""Mergeable summaries of a history: distinct authors and gaps between changes, kept by week and merged for any range.

A week's row holds a HyperLogLog sketch of its authors and a KLL sketch of the seconds since each file's change before. Both
merge without loss, so a range of weeks is summed up from its rows alone, and a new week only adds one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.asof import as_of

#: 2**LG_AUTHORS registers: a relative error of 1.04 / sqrt of that, or 1.6 %, in two thirds of cases; ERROR is three times as much.
LG_AUTHORS, ERROR = 12, 0.05
#: A quantile is one whose rank is off by RANK_ERROR at most, with 99 % certainty.
KLL_SIZE, RANK_ERROR = 400, 0.01


def weekly_sketches(changes: DataFrame, path: str = "path", author: str = "author", ts: str = "ts") -> DataFrame:
    """(week, changes, authors, gaps): for each week, its changes, a sketch of their authors, and one of the seconds since the same file's last change at an earlier time.

    A null author counts as none, and a file's first change has no gap; changes without a time are left out. Gaps come from
    an as-of join, so a file of very many changes is spread over tasks.
    """
    rows = changes.where(F.col(ts).isNotNull()).select(F.col(path).alias("path"), F.col(ts).alias("ts"), F.col(author).cast("string").alias("author"), F.lit(0).alias("tie"))
    found = as_of(rows, rows.select("path", "ts", "tie").distinct(), "path", "ts", "ts", "tie", "tie", strict=True)
    seconds = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    found = found.select(F.date_trunc("week", "ts").cast("date").alias("week"), "author", (seconds("ts") - seconds("version.ts")).alias("gap"))
    return found.groupBy("week").agg(F.count("*").alias("changes"), F.hll_sketch_agg("author", F.lit(LG_AUTHORS)).alias("authors"), F.kll_sketch_agg_bigint("gap", F.lit(KLL_SIZE)).alias("gaps"))


def over_ranges(sketches: DataFrame, by: Column) -> DataFrame:
    """(range, changes, authors, gaps): weeks put together by ``by``, an expression of their columns; the result is of the same kind and can be put together again."""
    return sketches.groupBy(by.alias("range")).agg(F.sum("changes").alias("changes"), F.hll_union_agg("authors").alias("authors"), F.kll_merge_agg_bigint("gaps").alias("gaps"))


def author_count(authors: str = "authors") -> Column:
    return F.hll_sketch_estimate(authors)


def gap_quantile(share: float, gaps: str = "gaps") -> Column:
    return F.kll_sketch_get_quantile_bigint(F.col(gaps), F.lit(share))
