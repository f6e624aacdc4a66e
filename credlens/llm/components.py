"""Connected components of a table of links by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import discard
from .common import written


def _links(a, b) -> list:
    return [F.greatest(a, b).alias("u"), F.least(a, b).alias("v")]


def components(links: DataFrame) -> DataFrame:
    """id and component (smallest id reachable) for each id in links (two columns a and b) that isn't its own component.

    A step only ever groups to a minimum, which is combined before the shuffle, and joins it back; AQE splits hot ids. The
    steps needed grow with the logarithm of the number of links. Tables are written after each, in the shared folder.
    """
    edges = written(links.where("a <> b").select(*_links(F.col("a"), F.col("b"))).distinct(), "edges")
    before = None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == before or not now["n"]:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
        before = now
        # large star: larger neighbours are linked to the smallest one around
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(*_links(F.col("v"), F.col("m"))).where("u <> v").distinct()
        # small star: smaller neighbours and the node itself are linked to the smallest
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(*_links(F.col("v"), F.col("m"))).where("u <> v")
        old, edges = edges, written(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(old)
