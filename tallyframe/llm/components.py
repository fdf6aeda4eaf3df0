"""Connected components of a link table by rounds of joins; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyframe.plans.durable import durable


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b bigint); the root is the least node of its component.

    Each round a node takes the least root among itself and its neighbours, then the root of that root, so
    stars finish in two or three rounds and long chains shorten by half each time. The rounds' tables are
    written, and only whether anything changed comes to the driver. Repeated links and a = b are harmless.
    """
    both = durable(links.select("a", "b").union(links.select("b", "a")).toDF("a", "b").distinct(), "links")
    roots = durable(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).withColumnRenamed("a", "node"), "roots")
    while True:
        near = both.join(roots.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("root").alias("near"))
        lower = roots.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("mid"))
        above = roots.select(F.col("node").alias("mid"), F.col("root").alias("top"))
        lower = durable(lower.join(above, "mid").select("node", "old", F.least("mid", "top").alias("root")), "roots")
        if not lower.filter("old <> root").limit(1).count():
            return lower.select("node", "root")
        roots = lower.select("node", "root")
