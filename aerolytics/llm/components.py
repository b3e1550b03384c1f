"""Connected components of an edge table by min-label spreading with pointer jumping.

Each round joins, aggregates with partial sums and writes its labels to the shared folder, so
a lost executor costs one round at most.  No group is gathered: a hub's edges meet in a min, and a hub's or a
giant component's rows are dealt to parts wherever they are joined to their one label, which is broadcast below a size that is
checked and copied to the parts beyond.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolytics.llm.common import stored
from aerolytics.llm.survivors import dealt
from aerolytics.operators.attach import merge_join


def component_labels(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (u, v): label is the smallest node reachable.

    An empty edge table gives an empty result; loops and repeated edges do no harm.
    """
    both = stored(edges.select("u", "v").union(edges.select("v", "u")).where(F.col("u") != F.col("v")).distinct())
    labels = stored(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("near")).select("node", F.least("node", "near").alias("label")))
    while True:
        near = dealt(both, labels.withColumnRenamed("node", "v"), ["v"], "u").groupBy("u").agg(F.min("label").alias("near"))
        spread = merge_join(labels, near, F.col("node") == F.col("u"), "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("then"))
        new = stored(dealt(spread, jump, ["label"], "node", "left").select("node", "old", F.least("label", F.coalesce("then", "label")).alias("label")))
        labels = new.select("node", "label")
        if new.where("old <> label").isEmpty():
            return labels
