"""Connected components as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilscan.llm.common import cut


def components(links: DataFrame) -> DataFrame:
    """``(a, b)`` links to ``(id, component)``: the smallest id that links lead to.

    Each round every id takes the smallest label among its own and its
    neighbours', then its label's label, until nothing changes. Ids without a
    link are not in the result.
    """
    both = cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = both.groupBy("a").agg(F.least("a", F.min("b")).alias("component")).withColumnRenamed("a", "id")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("near"))
        lower = labels.join(near, labels["id"] == near["a"]).select("id", "component", F.least("component", "near").alias("low"))
        onward = labels.select(F.col("id").alias("low"), F.col("component").alias("onward"))
        stepped = cut(
            lower.join(onward, "low", "left").select(
                "id", F.col("component").alias("before"), F.least("low", F.coalesce("onward", "low")).alias("component")
            )
        )
        labels = stepped.select("id", "component")
        if stepped.where("component <> before").isEmpty():
            return labels
