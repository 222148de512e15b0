"""Connected components over an edge table, by minimum labels, hooking of roots and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, staged


@staged
def components(edges: DataFrame) -> DataFrame:
    """id and comp (the least id reachable) of every end of an edge (src, dst; longs without nulls).

    Each round takes the least label among the neighbours, gives it to the node and to the node's label (so a tree's
    root is hooked at once, not reached hop by hop), and takes the label of the label, until no label changes.
    On paths the rounds grow with the logarithm of the length.  Sums combine on the map side, joins on ids are
    split by adaptive execution, every round is a table in the shared folder.
    """
    both = stage(edges.select("src", "dst").union(edges.select("dst", "src")).where("src <> dst").distinct(), "edges")
    labels = stage(both.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("low")).select("id", F.least("id", "low").alias("comp")), "labels")
    while True:
        near = both.join(labels, both["dst"] == labels["id"]).groupBy(F.col("src").alias("id")).agg(F.min("comp").alias("low"))
        own = F.struct("id", F.least("comp", "low").alias("low"), F.col("comp").alias("was"))
        root = F.struct(F.col("comp").alias("id"), "low", F.lit(None).cast("long").alias("was"))
        step = labels.join(near, "id").select(F.explode(F.array(own, root)).alias("r")).groupBy("r.id").agg(F.min("r.low").alias("next"), F.max("r.was").alias("was"))
        jump = labels.select(F.col("id").alias("_id"), F.col("comp").alias("_comp"))
        moved = stage(step.join(jump, F.col("next") == F.col("_id")).select("id", F.least("next", "_comp").alias("comp"), "was"), "labels")
        labels = moved.select("id", "comp")
        if moved.where("comp <> was").limit(1).count() == 0:
            labels._staged_at = moved._staged_at
            return labels
