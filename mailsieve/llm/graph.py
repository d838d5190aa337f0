"""Connected components of links between ids, by alternating star contraction.

Only minima are gathered per node, never its neighbours, so a node may have any
number of links; each round is written to the shared folder, which cuts the
lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import dropped, written


def components(links: DataFrame) -> DataFrame:
    """From ``u`` and ``v`` (long) to one row per linked id: ``id`` and ``root``, the smallest id it reaches."""
    edges = written(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = None
    while True:  # ends: each round lowers what a node points to
        sign = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if sign == before:
            break
        before = sign
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")).select("w", F.least("w", "m").alias("m"))
        # each node hands its larger neighbours to the smallest of them all
        large = both.join(least, F.col("u") == F.col("w")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        # each node hands its smaller neighbours, and itself, to the smallest
        small = large.join(least, F.col("u") == F.col("w")).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        now = written(small.select("e.u", "e.v").where("u <> v").distinct(), "links")
        dropped(edges)
        edges = now
    roots = edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return roots.union(edges.select(F.col("v"), F.col("v")).distinct())
