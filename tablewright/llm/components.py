"""Connected components of a link table by hooking to smaller neighbours and contracting, all in joins and minima."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import shared


def _flattened(hooks: DataFrame) -> DataFrame:
    """(node, root) where chains of hooks are followed to their end, twice as far with every pass."""
    while True:
        ahead = hooks.select(F.col("node").alias("root"), F.col("root").alias("further"))
        moved = shared.stored(hooks.join(ahead, "root", "left").select(
            "node", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "hooks")
        hooks = moved.select("node", "root")
        if moved.where("moved").isEmpty():
            return hooks


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b) that is not the smallest of its component, its root.

    Each round hooks every node to its smallest neighbour if that is smaller, and contracts; only nodes smaller than
    all their neighbours stay, so at most half of each component is left. A hub's links are combined before the
    shuffle, and both sides of every join come straight from storage, so that skewed keys can be split.
    """
    def tidy(df: DataFrame) -> DataFrame:
        return shared.stored(df.where(F.col("a") != F.col("b")).select(
            F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")

    links, member = tidy(links), None
    while True:
        hooks = _flattened(shared.stored(links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")), "hooks"))
        if member is None:
            member = hooks
        else:
            further = hooks.select(F.col("node").alias("root"), F.col("root").alias("further"))
            member = shared.stored(member.join(further, "root", "left").select(
                "node", F.coalesce("further", "root").alias("root")).union(hooks), "members")
        for end in ("a", "b"):
            links = links.join(hooks.withColumnRenamed("node", end), end, "left").withColumn(
                end, F.coalesce("root", end)).drop("root")
        links = tidy(links)
        if links.isEmpty():
            return member
