"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b); the label is the smallest node of its component.

    In each round a node takes the least label among its neighbours and hands it to the node that its old label
    names, too; then labels are replaced by their own labels. Trees of labels are so hooked together at their roots,
    and the number of rounds grows with the logarithm of the number of nodes, however long the paths. Rounds are
    written; a hub is only ever a join key or an aggregated one.
    """
    both = materialise(edges.select("a", "b").unionByName(edges.selectExpr("b AS a", "a AS b")).distinct(), "edges")
    labels = materialise(both.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a AS node", "least(a, m) AS label"), "labels")
    while True:
        near = both.join(labels.selectExpr("node AS b", "label AS m"), "b").groupBy("a").agg(F.min("m").alias("m"))
        known = labels.join(near.withColumnRenamed("a", "node"), "node")
        offers = known.selectExpr("inline(array(struct(node AS node, least(label, m) AS label, label AS old), struct(label AS node, m AS label, CAST(NULL AS BIGINT) AS old)))")
        hooked = materialise(offers.groupBy("node").agg(F.min("label").alias("label"), F.max("old").alias("old")), "labels")
        if not hooked.where("label <> old").limit(1).count():
            return hooked.select("node", "label")
        further = hooked.selectExpr("node AS label", "label AS further")
        labels = materialise(hooked.join(further, "label").selectExpr("node", "least(label, further) AS label"), "labels")
