"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import remove, save

#: Steps after which the loop gives up; the method needs O(log^2 n) of them.
MAX_STEPS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over links (a, b) with b < a.

    Large-star: each node u sends its larger neighbours to the least of its neighbourhood.
    Small-star: each node u sends itself and its smaller neighbours there.
    The least is a partial aggregate; the join that hands it out has one row a node on its right,
    so a hub's rows on the left can be split at run time.
    """
    if large:
        view = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = view.groupBy("u").agg(F.min("v").alias("v0")).select("u", F.least("u", "v0").alias("m"))
        out = view.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        view = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
        least = view.groupBy("u").agg(F.min("v").alias("m"))
        out = view.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """links: (a long, b long), either order, repeats allowed.  Returns (node, component): one row for each
    node that has a link, with the smallest node it can reach.  Null ends and self-links are ignored.

    Every step is written to the shared folder, so a lost executor costs one step.  No group is gathered
    anywhere and nothing but two sums reaches the driver.
    """
    spark = links.sparkSession
    first = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    path = save(first, "links")
    state = None
    for _ in range(MAX_STEPS):
        edges = spark.read.schema("a long, b long").parquet(path)
        after = save(_star(_star(edges, large=True), large=False), "links")
        remove(spark, path)
        path = after
        row = spark.read.schema("a long, b long").parquet(path).select(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (row["n"], row["h"]) == state:
            break
        state = (row["n"], row["h"])
    else:
        raise RuntimeError("the components did not settle")
    stars = spark.read.schema("a long, b long").parquet(path)
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).union(stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
