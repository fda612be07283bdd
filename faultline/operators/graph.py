"""Iterated joins: layers, shortest routes, ancestors and connected components. Each round is written out."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from faultline.session import cut_lineage


def shortest_routes(edges: DataFrame, roots: DataFrame, by: list[str]) -> DataFrame:
    """(by, node, depth, route): breadth-first from the roots, one route per node (the smallest of equal length).

    edges: by, src, dst. Stops when a round reaches nobody new.
    """
    edges = cut_lineage(edges.select(*by, "src", "dst").distinct())
    frontier = cut_lineage(roots.select(*by, "node").distinct()
                           .select(*by, "node", F.lit(0).alias("depth"), F.array("node").alias("route")))
    seen = frontier
    depth = 0
    while True:
        depth += 1
        step = (frontier.join(edges.withColumnRenamed("src", "node"), [*by, "node"])
                .select(*by, F.col("dst").alias("node"), F.array_append("route", F.col("dst")).alias("route"))
                .groupBy(*by, "node").agg(F.min("route").alias("route"))
                .join(seen.select(*by, "node"), [*by, "node"], "left_anti"))
        frontier = cut_lineage(step.select(*by, "node", F.lit(depth).alias("depth"), "route"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def weakest_routes(edges: DataFrame, starts: DataFrame, by: list[str]) -> DataFrame:
    """(by, node, depth, grade, middle, last): for each node reached, the best of its routes by length, then by the grade
    of its weakest hop, then by name; ``middle`` lists the nodes between start and end, ``last`` is the last hop's row.

    edges: by, src, dst, grade (better ones sort first) and further columns, one row for each (by, src, dst). Routes form
    a semiring: hops add up and grades combine by their maximum, alternatives by the minimum, so one row a node goes on.
    """
    rest = [c for c in edges.columns if c not in (*by, "src", "dst")]
    edges = cut_lineage(edges)
    hop = edges.select(*by, F.col("src").alias("node"), "dst", F.col("grade").alias("_grade"), F.struct(*rest).alias("_hop"))
    frontier = cut_lineage(starts.select(*by, "node").distinct().select(
        *by, "node", F.lit(0).alias("depth"), F.lit("").alias("grade"), F.array("node").alias("route"), F.lit(None).cast(hop.schema["_hop"].dataType).alias("last")))
    seen, depth = frontier, 0
    while True:
        depth += 1
        label = F.struct(F.greatest("grade", "_grade").alias("grade"), F.array_append("route", F.col("dst")).alias("route"), F.col("_hop").alias("last"))
        step = (frontier.select(*by, "node", "grade", "route").join(hop, [*by, "node"]).join(
            seen.select(*by, F.col("node").alias("dst")), [*by, "dst"], "left_anti")
            .groupBy(*by, F.col("dst").alias("node")).agg(F.min_by(label, F.struct(label["grade"], label["route"])).alias("b")))
        frontier = cut_lineage(step.select(*by, "node", F.lit(depth).alias("depth"), "b.grade", "b.route", "b.last"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.where("depth > 0").select(*by, F.col("route")[0].alias("start"), "node", "depth", "grade",
                                          F.slice("route", 2, F.size("route") - 2).alias("middle"), "last")


def ancestors(parents: DataFrame) -> DataFrame:
    """(node, ancestor, depth) over a parent pointer, up to the last ancestor; a chain stops at a node it has already passed."""
    p = parents.where("parent is not null").select(F.col("node").alias("_c"), F.col("parent").alias("_p"))
    p = cut_lineage(p)
    level = cut_lineage(p.select(F.col("_c").alias("node"), F.col("_p").alias("ancestor"), F.lit(1).alias("depth"),
                                 F.array("_c", "_p").alias("_seen")).where("node <> ancestor"))
    out = level
    while not level.isEmpty():
        step = level.join(p, level["ancestor"] == p["_c"]).where(~F.array_contains("_seen", F.col("_p")))
        level = cut_lineage(step.select("node", F.col("_p").alias("ancestor"), (F.col("depth") + 1).alias("depth"),
                                        F.array_append("_seen", F.col("_p")).alias("_seen")))
        out = out.unionByName(level)
    return out.drop("_seen")


def connected_components(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, node, component): smallest reachable label; minimum of the neighbours plus pointer jumping per round,
    so the number of rounds grows with the logarithm of the diameter. pairs: by, a, b."""
    by = by or []
    both = pairs.select(*by, "a", "b").where("a <> b")
    both = cut_lineage(both.unionByName(both.select(*by, F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    written = labels = cut_lineage(pairs.select(*by, F.explode(F.array("a", "b")).alias("node")).distinct()
                                   .withColumn("component", F.col("node")))
    while True:
        near = (both.join(labels.select(*by, F.col("node").alias("b"), F.col("component").alias("_l")), [*by, "b"])
                .groupBy(*by, F.col("a").alias("node")).agg(F.min("_l").alias("_near")))
        pulled = (labels.join(near, [*by, "node"], "left")
                  .withColumn("_new", F.least("component", F.coalesce("_near", F.col("component")))))
        jump = pulled.select(*by, F.col("node").alias("_new"), F.col("_new").alias("_far"))
        written = cut_lineage(pulled.join(jump, [*by, "_new"], "left")
                          .select(*by, "node", F.least("_new", F.coalesce("_far", F.col("_new"))).alias("component"),
                                  (F.least("_new", F.coalesce("_far", F.col("_new"))) != F.col("component")).alias("_moved")), instead_of=written)
        labels = written.drop("_moved")
        if written.where("_moved").isEmpty():
            return labels
