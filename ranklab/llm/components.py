"""Connected components of a graph in tables, by alternating star steps; every step is a few shuffles of the edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ranklab.llm.common import written
from ranklab.session import union_all


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 64) -> DataFrame:
    """Rows (node, component) for all nodes of the undirected `edges` (two bigint columns): the component is the
    smallest node reachable. Self-links and repeats do no harm, edges with a null end are ignored; no edges, no rows.

    A round ties every node's larger neighbours to its smallest one (large star), then does the same with its smaller
    neighbours (small star), until nothing changes; a path of n nodes takes O(log n) rounds. Minima are combined before
    the shuffle, and the join of a hub's edges with its one minimum is an ordinary equi-join that adaptive execution
    may split. Each round is written to the shared folder, so lineage stays short and nothing reaches the driver.
    """
    links = (edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
             .select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).distinct())
    links = written(links, "links")
    before = None
    for _ in range(max_rounds):
        both = union_all([links.select(F.col("lo").alias("v"), F.col("hi").alias("u")), links.select(F.col("hi").alias("v"), F.col("lo").alias("u"))])
        least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = both.join(least, "v").filter("u > v").select(F.col("m").alias("lo"), F.col("u").alias("hi")).filter("lo < hi").distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        joined = large.join(low, "hi")
        small = union_all([joined.select(F.col("m").alias("lo"), F.col("lo").alias("hi")).filter("lo < hi"), low.select(F.col("m").alias("lo"), "hi")])
        links = written(small.distinct(), "links")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = links.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return union_all([links.select(F.col("hi").alias("node"), F.col("lo").alias("component")), roots])

