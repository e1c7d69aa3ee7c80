"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.store import drop, written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has an edge; a component is named by its smallest node.

    Each round points every node to its least neighbour (or itself), follows the pointers once more, and
    contracts the graph: edges between what nodes now point to stay, the others go. So the graph shrinks
    round by round, and the least node of a component is what is left of it. The rounds' pointers are
    composed at the end. Graphs and pointers are tables in the shared folder; loops, repeated edges and
    nulls are dropped.
    """
    graph = written(edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where(F.col("u") != F.col("v")).distinct(), "graph")
    rounds: list[DataFrame] = []
    while graph.limit(1).count():
        ends = graph.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        up = written(ends.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("v")).select("node", F.least("node", "v").alias("to")), "pointers")
        further = up.join(up.select(F.col("node").alias("to"), F.col("to").alias("far")), "to").select("node", F.col("far").alias("to"))
        rounds.append(written(further, "pointers"))
        drop(up)
        at = lambda end, name: rounds[-1].select(F.col("node").alias(end), F.col("to").alias(name))  # noqa: E731, B023
        moved = graph.join(at("u", "p"), "u").join(at("v", "q"), "v").where(F.col("p") != F.col("q"))
        smaller = written(moved.select(F.least("p", "q").alias("u"), F.greatest("p", "q").alias("v")).distinct(), "graph")
        drop(graph)
        graph = smaller
    if not rounds:
        return graph.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = rounds[0].select("node", F.col("to").alias("component"))
    for r in rounds[1:]:
        out = out.join(r.select(F.col("node").alias("component"), F.col("to").alias("__to")), "component", "left").select("node", F.coalesce("__to", "component").alias("component"))
    return written(out, "components")
