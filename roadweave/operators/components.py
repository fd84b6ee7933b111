"""Connected components by least labels with pointer jumping, on tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadweave.plans.scratch import Scratch


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component) of every node of the undirected edges; a component is named by its smallest node.

    Every round takes the least label among a node's neighbours, then the label of its label, and is written before the
    next begins: labels at distance 2^k are reached after about k rounds. Joins read two plain tables, so a hub's rows can
    be split over tasks. Null ends are ignored; an edge of a node to itself gives a component of its own.
    """
    scratch = Scratch(edges.sparkSession, "components")
    e = edges.select(F.col(u).alias("a"), F.col(v).alias("b")).where("a is not null and b is not null")
    e = scratch.table(e.select("a", "b").union(e.select("b", "a")).distinct(), "edges")
    labels = scratch.table(e.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("c")), "labels-0")
    total = _total(labels)
    step = 0
    while True:
        step += 1
        near = e.join(labels, F.col("a") == F.col("node")).select(F.col("b").alias("node"), "c")
        least = scratch.table(labels.union(near).groupBy("node").agg(F.min("c").alias("c")), f"least-{step}")
        of = least.select(F.col("node").alias("c"), F.col("c").alias("c2"))
        jumped = scratch.table(least.join(of, "c").select("node", F.least("c", "c2").alias("c")), f"labels-{step}")
        scratch.drop(f"labels-{step - 1}", f"least-{step}")
        now = _total(jumped)
        if now == total:
            scratch.drop("edges")
            return jumped.select("node", F.col("c").alias("component"))
        labels, total = jumped, now


def _total(labels: DataFrame):
    """Labels only ever fall; they are final when two rounds agree on every one, which sums of ranks can't hide."""
    kind = dict(labels.dtypes)["c"]
    if kind in ("bigint", "int"):
        return labels.agg(F.sum(F.col("c").cast("decimal(38,0)"))).first()[0]
    return labels.agg(F.sum(F.xxhash64("node", "c").cast("decimal(38,0)"))).first()[0]
