"""Connected components by alternating star contractions, one written table a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import skew_join, store


def _mins(directed: DataFrame) -> DataFrame:
    """Per `a`, the least of itself and its neighbours `b`; combined before the shuffle."""
    return directed.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("_m"))


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Components of undirected `links` (`a`, `b` long): one row (`node`, `root`) per linked node.

    `root` is the least node of the component. Each round does a large-star step (hang
    every larger neighbour under the least one) and a small-star step (hang the
    smaller neighbours under it too); it ends when a round changes nothing,
    after a number of rounds that grows with the logarithm of the longest chain. Links
    stay distributed: a node with very many neighbours costs one row
    a task in the aggregation, and the joins can be split at it. Self-links and
    repeats are ignored; null ends are dropped; no links give no rows.
    """
    links = store(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    print_of = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    seen = print_of(links)
    for _ in range(most_rounds):
        if not seen[0]:
            break
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = skew_join(both, _mins(both), ["a"]).where("b > a").select(F.col("b").alias("a"), F.col("_m").alias("b")).where("a <> b").distinct()
        large = store(large, "large")
        # Here a > b on every row, so the smaller neighbours of a are its rows.
        low = _mins(large)
        small = skew_join(large, low, ["a"]).select(F.col("b").alias("a"), F.col("_m").alias("b")).unionByName(low.select("a", F.col("_m").alias("b")))
        links = store(small.where("a <> b").distinct(), "small")
        now = print_of(links)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components are not done after {most_rounds} rounds")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
