"""Connected components of an edge table by min-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourloom.llm.store import materialise

#: Tasks that the nodes of one component are dealt to when its label changes.
SALTS = 64


def components(edges: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """id, comp (smallest id reachable) for each end of edges(a, b, parts). labels: id, comp of an earlier call with fewer edges.

    A round gives each node the smallest label around it (summed up before the shuffle) and then the label of its label; the
    number of rounds grows with the logarithm of a component's width on chains, and is two or three on stars. Neither a hub
    nor a large component is one task's work: a hub's edges are dealt to `parts` tasks and its label is sent to each, and
    the new labels of components are sent to SALTS tasks.
    """
    part = F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part")
    both = materialise(edges.select("a", "b", part).union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(0).alias("part"))).distinct(), "cc-edges")
    heads = both.select("a", "part").distinct()
    nodes = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("comp"))
    if labels is not None:
        old = labels.select(F.col("id").alias("old_id"), F.col("comp").alias("old"))
        nodes = nodes.join(old, nodes["id"] == old["old_id"], "left").select("id", F.least("comp", "old").alias("comp"))
        nodes = nodes.unionByName(labels.join(nodes, "id", "left_anti"))
    now = materialise(nodes, "cc-labels")
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt")
    while True:
        sent = heads.join(now.withColumnRenamed("id", "a"), "a")
        near = both.join(sent, ["a", "part"]).groupBy("b").agg(F.min("comp").alias("m"))
        # A node also tells its label what it has heard, so that two labels that meet anywhere become one.
        heard = now.join(near, now["id"] == near["b"], "left").select("id", "comp", F.least("comp", "m").alias("new"), salt)
        told = heard.groupBy(F.col("comp").alias("to")).agg(F.min("new").alias("t")).where("t < to")
        told = told.select("to", "t", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("slot"))
        step = heard.join(told, (heard["comp"] == told["to"]) & (heard["salt"] == told["slot"]), "left").select("id", "comp", F.least("new", "t").alias("new"))
        new = materialise(step, "cc-labels")
        if new.where(F.col("new") < F.col("comp")).isEmpty():
            return now
        now = new.select("id", F.col("new").alias("comp"))
