"""Connected components of a link table by alternating star steps; every step is joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import Scratch

#: Nodes that one task's union-find holds before it hands on what it has.
NODES = 500_000


def _contract(batches):
    """Union-find over the links of one partition, as far as they fit a fixed table: links become links to a root."""
    import pandas as pd

    def flush(parent):
        nodes = list(parent)
        roots = []
        for x in nodes:
            r = x
            while parent[r] != r:
                r = parent[r]
            parent[x] = r
            roots.append(r)
        out = pd.DataFrame({"u": nodes, "v": roots})
        return out[out.u != out.v]

    parent: dict[int, int] = {}

    def root(x):
        r = parent.setdefault(x, x)
        while parent[r] != r:
            parent[r] = parent[parent[r]]
            r = parent[r]
        parent[x] = r
        return r

    for pdf in batches:
        for a, b in zip(pdf.u.tolist(), pdf.v.tolist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > NODES:
            yield flush(parent)
            parent = {}
    yield flush(parent)


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one link upwards or is a root: then each link leads to the least node of its component."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))).alias("e")).select("e.*")
    counts = ends.groupBy("node").agg(F.sum("up").alias("up"), F.count("*").alias("n"))
    return counts.where("up > 1 or (up = 1 and n > 1)").isEmpty()


def connected_components(links: DataFrame, scratch: Scratch, name: str = "links", most_rounds: int = 60) -> DataFrame:
    """Component of every node that has a link to another node: columns ``node``, ``component`` (its least node).

    ``links``: long columns ``u`` and ``v``, in any order, with repeats; nulls and loops are ignored. Partitions of links
    contract by union-find, then large-star and small-star steps alternate (Kiveris et al., 2014): the minimum of a node's
    neighbours is a partial aggregate, so a hub with very many links is combined before it is shuffled, and the join back
    on the hub is one that adaptive execution may split. Each round is a written table of ``scratch``.
    """
    clean = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = scratch.keep(clean.mapInPandas(_contract, "u long, v long").distinct(), f"{name}0")
    for k in range(1, most_rounds):
        if _settled(edges):
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))  # every neighbour in ``large`` is smaller
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        edges = scratch.keep(small.mapInPandas(_contract, "u long, v long").distinct(), f"{name}{k}")
        scratch.drop(f"{name}{k - 1}")
    raise RuntimeError(f"components not settled after {most_rounds} rounds")
