"""Connected components of a graph given as a table of edges, by contraction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanfate.llm.common import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long); a component is one of its nodes.

    Each round maps every node to the least of itself and its neighbours, follows that map
    once more, and replaces the nodes of all edges by what they map to. Edges within one
    node fall away, so the graph shrinks until no edge is left; the maps of all rounds are
    then applied one after the other. The first round orders nodes by value, which is best
    for stars around their least node; later ones by a hash that changes with the round, so
    no numbering of nodes can make the rounds many.

    Each round is written to the shared folder. Nothing but a round's number of edges
    reaches the driver. Sums over a node's edges are pre-aggregated by task; the joins that
    replace a node with a great many edges are split by adaptive execution. An edge from a
    node to itself makes a component of one. Null ends, and their edges, are left out.
    """
    whole = edges.filter("a IS NOT NULL AND b IS NOT NULL")
    given = stored(whole.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    loops = given.filter("a = b").select(F.col("a").alias("node"), F.col("a").alias("next"))
    graph = given.filter("a <> b")
    maps: list[DataFrame] = []
    while not graph.isEmpty():
        number = len(maps)
        maps.append(stored(_least_neighbours(graph, number), f"map-{number}"))
        graph = stored(_contract(graph, maps[-1]), f"edges-{number + 1}")
    if not maps:
        return loops.select("node", F.col("next").alias("component"))
    found = reduce(_follow, maps[1:], maps[0])
    alone = loops.join(found, "node", "left_anti")
    return found.unionByName(alone).select("node", F.col("next").alias("component"))


def _rank(node: str, number: int):
    value = F.col(node)
    order = F.xxhash64(value, F.lit(number)) if number else value
    return F.struct(order.alias("order"), value.alias("node"))


def _least_neighbours(graph: DataFrame, number: int) -> DataFrame:
    """(node, next) of one round, followed twice."""
    both = graph.select(F.col("a").alias("node"), _rank("b", number).alias("other")).unionByName(
        graph.select(F.col("b").alias("node"), _rank("a", number).alias("other"))
    )
    least = both.groupBy("node").agg(F.min("other").alias("other")).select(
        "node", F.least("other", _rank("node", number))["node"].alias("next")
    )
    return _follow(least, least)


def _follow(first: DataFrame, then: DataFrame) -> DataFrame:
    """(node, next): ``then`` applied to what ``first`` maps to; what it lacks stays."""
    step = then.select(F.col("node").alias("via"), F.col("next").alias("beyond"))
    joined = first.withColumnRenamed("next", "via").join(step, "via", "left")
    return joined.select("node", F.coalesce("beyond", "via").alias("next"))


def _contract(graph: DataFrame, step: DataFrame) -> DataFrame:
    a = step.select(F.col("node").alias("a"), F.col("next").alias("na"))
    b = step.select(F.col("node").alias("b"), F.col("next").alias("nb"))
    moved = graph.join(a, "a").join(b, "b").filter("na <> nb")
    return moved.select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).distinct()
