"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coursemill.session import release, stash

MOST_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b: long): the smallest node that can be reached.

    In every round each node points to its smallest neighbour, if that is smaller, then to what that
    one points to; then links are drawn between what their ends point to, and those within one node
    go. So a node that has many links leaves them behind in the first round. Each round's labels and
    links are written to the shared folder, and removed once the next round has read them. Rounds
    grow with the logarithm of the longest path in practice; RuntimeError after 60.
    """
    links = links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    links = stash(links.distinct(), "links")
    found: DataFrame | None = None
    for _ in range(MOST_ROUNDS):
        ends = links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select("b", "a"))
        near = stash(ends.groupBy("node").agg(F.least("node", F.min("other")).alias("up")), "near")
        jumped = near.join(near.select(F.col("node").alias("up"), F.col("up").alias("component")), "up")
        labels = stash(jumped.select("node", "component"), "labels")
        if found is None:
            found = stash(labels, "components")
        else:
            later = labels.select(F.col("node").alias("component"), F.col("component").alias("next"))
            before, found = found, stash(found.join(later, "component", "left").select("node", F.coalesce("next", "component").alias("component")), "components")
            release(before)
        one = links.join(labels.select(F.col("node").alias("a"), F.col("component").alias("x")), "a")
        both = one.join(labels.select(F.col("node").alias("b"), F.col("component").alias("y")), "b").filter("x <> y")
        before, links = links, stash(both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
        release(before, near, labels)
        if links.isEmpty():
            return found
    raise RuntimeError("the components did not settle")
