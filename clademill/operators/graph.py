"""Connected components of an edge list by joins with the smallest neighbour."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts lineage through the folder that spark.checkpoint.dir names; where it is unset, through one in the warehouse, or in local mode a temporary one."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and context.master.startswith("local") and not context.master.startswith("local-cluster"):
            folder = tempfile.mkdtemp(prefix="clademill-")
        context.setCheckpointDir(folder or f"{df.sparkSession.conf.get('spark.sql.warehouse.dir').rstrip('/')}/clademill-checkpoints")
    return df.checkpoint()


#: Rows of a task, and of a key that goes to one task.
ROWS = 1 << 20


def _looked_up(rows: DataFrame, known: DataFrame, key: str, parts: int) -> DataFrame:
    """An inner join with `known`, which has a key once. What is known of keys with more than ROWS rows, at most one for each task, is broadcast."""
    hot = checkpointed(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > ROWS).select(key))
    if hot.isEmpty():
        return rows.repartition(parts, key).join(known, key)
    few = F.broadcast(known.join(F.broadcast(hot), key, "left_semi"))
    return rows.join(F.broadcast(hot), key, "left_anti").repartition(parts, key).join(known, key).unionByName(rows.join(few, key))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node that can be reached. Labels go to the neighbours, then to the label's own label, so rounds grow with the logarithm of the longest path.

    The number of tasks follows the number of edges, so a task's memory doesn't; a component or a hub isn't one task."""
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    parts = max(1, -(-2 * both.count() // ROWS))
    both = checkpointed(both.unionAll(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).repartition(parts, "u", "v").distinct())
    label = checkpointed(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("l")))
    while True:
        near = _looked_up(both, label.select(F.col("u").alias("v"), "l"), "v", parts).groupBy("u").agg(F.min("l").alias("m"))
        far = _looked_up(label, label.select(F.col("u").alias("l"), F.col("l").alias("far")), "l", parts)
        new = checkpointed(far.join(near, "u").select("u", F.least("l", "far", "m").alias("l"), (F.least("far", "m") < F.col("l")).alias("moved")))
        label = new.select("u", "l")
        if new.where("moved").isEmpty():
            return label.select(F.col("u").alias("node"), F.col("l").alias("component"))
