"""Connected components by hooking trees of labels and pointer jumping, as joins over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuspack.session import materialised


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component): for every node of ``links`` (a, b), the least node it can reach.

    Every node has a label, a node no greater that it can reach. A round takes the labels of all neighbours' labels; the
    least of them becomes the node's label and also that of its label, if less (so whole trees move, as in FastSV, and a
    component's width takes few rounds), as does the label of its own label. Rounds end when no label changes.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = materialised(both.where("a <> b").distinct(), "component-edges")
    labels = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
    labels = materialised(labels.select("node", F.least("node", "least").alias("label")), "component-labels")
    while True:
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("beyond"))
        jumped = labels.join(jump, "label").select("node", "label", "beyond")
        near = edges.join(jumped.select(F.col("node").alias("b"), "beyond"), "b").groupBy("a").agg(F.min("beyond").alias("near"))
        step = jumped.join(near.withColumnRenamed("a", "node"), "node")
        own = F.struct("node", F.least("beyond", "near").alias("least"), F.col("label").alias("old"))
        tree = F.struct(F.col("label").alias("node"), F.col("near").alias("least"), F.lit(None).cast(labels.schema["label"].dataType).alias("old"))
        hooks = step.select(F.explode(F.array(own, tree)).alias("x")).select("x.*")
        found = hooks.groupBy("node").agg(F.min("least").alias("least"), F.max("old").alias("old"))
        found = materialised(found.select("node", "old", F.least("least", "old").alias("label")), "component-labels")
        labels = found.select("node", "label")
        if found.where("old <> label").isEmpty():
            return labels.withColumnRenamed("label", "component")
