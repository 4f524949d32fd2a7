"""Connected components and label spreading as DataFrame loops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.shared import stored


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 200) -> DataFrame:
    """Label every endpoint of ``edges`` with the smallest node it can reach (undirected).

    Each round, an edge offers the label at either end both to the other end and to that end's
    present label (so whole trees hook at once), then labels are followed one step further; rounds
    grow with the logarithm of the diameter. Only labels are kept between rounds, as a stored table.
    Null endpoints are dropped, self loops give a component of one, repeated edges count once.
    Returns (node, component); an empty input gives an empty table.
    """
    both = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    both = stored(both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = stored(
        both.select(F.explode(F.array("a", "b")).alias("node"), F.col("a").alias("component")).groupBy("node").agg(F.min("component").alias("component")),
        "labels",
    )
    for _ in range(max_rounds):
        at_a = labels.select(F.col("node").alias("a"), F.col("component").alias("la"))
        at_b = labels.select(F.col("node").alias("b"), F.col("component").alias("lb"))
        unequal = both.join(at_a, "a").join(at_b, "b").where("la <> lb")
        low = F.least("la", "lb")
        offers = unequal.select(F.explode(F.array("a", "b", "la", "lb")).alias("node"), low.alias("offer"))
        best = offers.groupBy("node").agg(F.min("offer").alias("offer"))
        hooked = labels.join(best, "node", "left").select("node", F.least("component", F.coalesce("offer", "component")).alias("component"), F.col("offer").isNotNull().alias("moved"))
        hooked = stored(hooked, "hooked")
        if hooked.where("moved").limit(1).count() == 0:
            return labels
        jump = hooked.select(F.col("node").alias("component"), F.col("component").alias("next"))
        labels = stored(hooked.join(jump, "component", "left").select("node", F.least("component", F.coalesce("next", "component")).alias("component")), "labels")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
