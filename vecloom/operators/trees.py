"""Exact nearest neighbours by a tree of several levels.

The tree is a table of nodes, each with its box; node n has the children 2n and 2n + 1. Every node of more than ``leaf`` points is
cut at the median of the coordinate that varies most: level by level over the whole table while a node is more than a task
may hold, then each subtree in a task of its own. Points to be asked for walk down to their own leaf, whose nearest point
bounds their distance; then blocks of them meet blocks of the tree, which stand by leaf, and pass over every block and leaf whose
box is farther than that. No pair of a point and a leaf becomes a row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.durable import broadcast_if_small, materialize
from vecloom.operators.dense import matrix
from vecloom.operators.evaluate import best_of, nearest_in_group, search_within
from vecloom.shipping import ship

#: Nodes that go to every executor at most; the points of a level are shuffled to more.
MAX_NODES = 20_000


@dataclass
class Tree:
    """nodes: (node, n, low, high, at, cut), at and cut null for a leaf; points: (id, x, label, node) with the leaf of each."""

    nodes: DataFrame
    points: DataFrame


#: Values of a subtree that a task builds at most.
TASK_VALUES = 4_000_000


def _side(node: Column, x: Column, at: Column, cut: Column) -> Column:
    return F.when(at.isNull(), node).otherwise(node * 2 + (F.get(x, at) > cut).cast("long"))


def build(points: DataFrame, leaf: int = 64, most_levels: int = 50) -> Tree:
    """The tree of (id, x, label). A node whose points are all equal is a leaf of any size."""
    ship(points.sparkSession)
    points = points.select("id", "x", "label")
    most = max(leaf, TASK_VALUES // (points.agg(F.max(F.size("x")).alias("d")).first()["d"] or 1))
    tops, here = [], points.withColumn("node", F.lit(1).cast("long"))
    for level in range(most_levels):
        made = _cut(here.filter(F.col("node") >= 1 << level), most)
        if made is None:
            break
        tops.append(made)
        here = walked(_union(tops), points, level + 1)
    ready, alike = here, None
    if tops:
        alike = _union(tops).filter("at IS NULL").select("node")
        ready, alike = here.join(F.broadcast(alike), "node", "left_anti"), here.join(F.broadcast(alike), "node", "left_semi")
    kind = "id long, x array<double>, label int, node long, n long, low array<double>, high array<double>, at int, cut double"
    grown = ready.groupBy("node").applyInArrow(lambda table: _subtree(table, leaf, most_levels), kind)
    if tops:
        grown = grown.unionByName(alike, allowMissingColumns=True).unionByName(_union(tops), allowMissingColumns=True)
    grown = materialize(grown, "tree")
    return Tree(grown.filter("n IS NOT NULL").select("node", "n", "low", "high", "at", "cut"), grown.filter("n IS NULL").select("id", "x", "label", "node"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _cut(here: DataFrame, most: int) -> DataFrame | None:
    """(node, n, low, high, at, cut) of the nodes of more than ``most`` points, ``at`` null where all are equal; none: no such nodes."""
    large = materialize(here.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most), "tree-large")
    if large.isEmpty():
        return None
    inside = here.join(broadcast_if_small(large, MAX_NODES), "node")
    sides = inside.select("node", "n", F.posexplode("x").alias("pos", "v")).groupBy("node", "pos")
    sides = sides.agg(F.max("n").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.var_pop("v").alias("spread"))
    varies = F.when(F.col("low") < F.col("high"), F.struct("spread", -F.col("pos")))
    box = F.sort_array(F.collect_list(F.struct("pos", "low", "high")))  # one entry a coordinate
    made = sides.groupBy("node").agg(F.max("n").alias("n"), F.max_by(F.struct("pos", "high"), varies).alias("w"), box.alias("box"))
    low, high = F.transform("box", lambda b: b["low"]).alias("low"), F.transform("box", lambda b: b["high"]).alias("high")
    made = materialize(made.select("node", "n", low, high, F.col("w.pos").alias("at"), F.col("w.high").alias("top")), "tree-nodes")
    values = here.join(broadcast_if_small(made.select("node", "at", "top"), MAX_NODES), "node").filter("at IS NOT NULL").select("node", "top", F.get("x", "at").alias("v"))
    middle = values.groupBy("node").agg(F.percentile_approx("v", 0.5, F.lit(1000)).alias("middle"), F.max(F.when(F.col("v") < F.col("top"), F.col("v"))).alias("below"))
    # a median that is the largest value would leave one side empty
    cut = F.when(F.col("middle") < F.col("top"), F.col("middle")).otherwise(F.col("below"))
    return materialize(made.join(middle, "node", "left").select("node", "n", "low", "high", "at", cut.alias("cut")), "tree-cuts")


def _subtree(table: pa.Table, leaf: int, most_levels: int) -> pa.Table:
    """The points below a node, by leaf, and the nodes there."""
    x = matrix(table.column("x"))
    stack, order, places, nodes = [(table.column("node")[0].as_py(), np.arange(len(x)))], [], [], []
    while stack:
        node, rows = stack.pop()
        part = x[rows]
        low, high, at, cut = part.min(axis=0), part.max(axis=0), None, None
        if len(rows) > leaf and node < 1 << most_levels and (low < high).any():
            at = int(np.where(low < high, part.var(axis=0), -1.0).argmax())
            v = part[:, at]
            cut = float(np.partition(v, (len(v) - 1) // 2)[(len(v) - 1) // 2])
            cut = float(v[v < cut].max()) if cut == high[at] else cut
            stack += [(2 * node + 1, rows[v > cut]), (2 * node, rows[v <= cut])]
        else:
            order.append(rows)
            places.append(np.full(len(rows), node))
        nodes.append((node, len(rows), low.tolist(), high.tolist(), at, cut))
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.int32(), pa.float64()]
    names, own = ["node", "n", "low", "high", "at", "cut"], ["id", "x", "label"]
    made = {c: pa.array(v, k) for c, k, v in zip(names, kinds, zip(*nodes))}
    placed = table.select(own).take(pa.array(np.concatenate(order)))
    parts = [placed.append_column("node", pa.array(np.concatenate(places), pa.int64())), pa.table(made)]
    columns = own + names
    types = {**{c: placed.schema.field(c).type for c in own}, **dict(zip(names, kinds))}
    return pa.concat_tables([pa.table({c: p.column(c).cast(types[c]) if c in p.column_names else pa.nulls(p.num_rows, types[c]) for c in columns}) for p in parts])


def walked(nodes: DataFrame, points: DataFrame, levels: int | None = None) -> DataFrame:
    """Points with the ``node`` of their leaf: one join a level."""
    if levels is None:
        levels = (nodes.agg(F.max("node")).first()[0] or 1).bit_length() - 1
    cuts = broadcast_if_small(materialize(nodes.filter("at IS NOT NULL").select("node", "at", "cut"), "tree-cuts"), MAX_NODES)
    out = points.withColumn("node", F.lit(1).cast("long"))
    for _ in range(levels):
        side = _side(F.col("node"), F.col("x"), F.col("at"), F.col("cut"))
        out = out.join(cuts, "node", "left").select(*points.columns, side.alias("node"))
    return out


def searches(tree: Tree, test: DataFrame, rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(id, train_id, label, d2) of the first search, in each point's own leaf, and with ``compared`` of all that follow."""
    asked = materialize(walked(tree.nodes, test.select("id", "x")), "tree-asked")
    first = materialize(nearest_in_group(tree.points, asked, "node", rows), "tree-first")
    bounded = asked.join(first.select("id", F.col("d2").alias("best")), "id").select("id", "x", F.col("node").alias("own"), "best")
    return first, search_within(bounded, tree.points, rows)


def one_nn_in_tree(train: DataFrame, test: DataFrame, leaf: int = 64, rows: int | None = None) -> DataFrame:
    """The nearest of all training points, exactly; the smallest id of ties. No training points give no rows."""
    first, again = searches(build(train, leaf), test, rows)
    return best_of(first.unionByName(again.drop("compared")))


def distances_computed(tree: Tree, test: DataFrame) -> int:
    """How many pairs of points a search compares."""
    sizes = tree.points.groupBy("node").agg(F.count(F.lit(1)).alias("compared"))
    _, again = searches(tree, test)
    own = walked(tree.nodes, test.select("id", "x")).join(sizes, "node")
    return int(own.select("compared").unionByName(again.select("compared")).agg(F.sum("compared")).first()[0] or 0)
