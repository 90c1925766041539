"""Connected components of a link table by smallest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in links (a, b): the smallest id reachable.

    Each round takes the smallest label among the neighbours, then the label's own label, so chains shorten by
    doubling. A hub's links are aggregated before the shuffle and only ever joined against one row per id.
    """
    both = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    nearest = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("near"))
    labels = stored(nearest.select("id", F.least("id", "near").alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(
            F.min("component").alias("near"))
        better = labels.join(near, "id").select(
            "id", F.least("component", "near").alias("component"), F.col("component").alias("old"))
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("next"))
        labels = stored(
            better.join(jump, "component").select("id", F.least("component", "next").alias("component"), "old"), "labels")
        if labels.filter("component <> old").isEmpty():
            return labels.select("id", "component")
        labels = labels.drop("old")
