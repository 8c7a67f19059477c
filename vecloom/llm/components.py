"""Connected components of an undirected graph by hooking and contraction.

Every round each label hooks to its smallest smaller neighbour, the forest so made is flattened by pointer
jumping, and the edges are rewritten to the roots and made distinct. A label that has a smaller neighbour is gone
after the round, and so, a round later, is each that had larger ones only (a star whose centre is the largest):
over two rounds a component that isn't finished loses at least half of its labels. Tables stay distributed and are written between rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.durable import materialize, release


def _flatten(parent: DataFrame) -> DataFrame:
    """(node, root, moved) of a forest given as (node, root) with root < node: roots are replaced by their own roots.

    The table passed in and all but the last of those made here are deleted.
    """
    while True:
        links = parent.select("node", "root")
        up = links.select(F.col("node").alias("root"), F.col("root").alias("above"))
        jumped = links.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved"))
        jumped = materialize(jumped, "jump")
        release(parent)
        parent = jumped
        if jumped.filter("moved").isEmpty():
            return jumped


def connected_components(edges: DataFrame) -> DataFrame:
    """From edges (a, b) of any orderable type: (node, root) for every node that has an edge to another.

    root is the smallest node of the component. Loops, repeated and reversed edges are harmless, edges with
    a null end are ignored; no edges give an empty table. Tables of finished rounds are deleted.
    """

    def clean(pairs: DataFrame) -> DataFrame:
        return materialize(pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")

    edges, known = clean(edges), None
    while not edges.isEmpty():
        hooked = edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))
        flat = _flatten(materialize(hooked, "hook"))
        roots = flat.select("node", "root")
        up = roots.select(F.col("node").alias("root"), F.col("root").alias("above"))
        before, known = known, roots
        if before is not None:
            moved = before.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"))
            # labels that hook for the first time were roots until now and have no row yet
            known = moved.unionByName(roots.join(before.select("node"), "node", "left_anti"))
        known = materialize(known, "labels")
        rewritten = edges
        for end in ("a", "b"):
            renamed = roots.select(F.col("node").alias(end), F.col("root").alias("above"))
            rewritten = rewritten.join(renamed, end, "left").withColumn(end, F.coalesce("above", end)).drop("above")
        contracted = clean(rewritten)
        for done in (edges, flat, before):
            release(done)
        edges = contracted
    if known is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    tops = known.select(F.col("root").alias("node")).distinct()
    return materialize(known.unionByName(tops.withColumn("root", F.col("node"))), "components")
