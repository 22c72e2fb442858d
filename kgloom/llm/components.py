"""Connected components of a table of links, by alternating star contraction."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

#: Links that a task holds at a time while it contracts its own.
FOREST_LINKS = 1_000_000


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the given links that is not the least of its component, and that least node."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    x, y = at[: len(u)], at[len(u) :]
    least = np.arange(len(ids))
    while True:
        a, b = least[x], least[y]
        if (a == b).all():
            break
        low = np.minimum(a, b)
        np.minimum.at(least, a, low)
        np.minimum.at(least, b, low)
        while ((up := least[least]) != least).any():
            least = up
    rest = np.flatnonzero(least != np.arange(len(ids)))
    return ids[rest], ids[least[rest]]


def contracted(links: DataFrame) -> DataFrame:
    """The links ``u, v`` with those of each task replaced by a forest of stars with the same components."""

    def run(batches):
        us, vs, held = [], [], 0
        for batch in batches:
            us.append(batch.column(0).to_numpy())
            vs.append(batch.column(1).to_numpy())
            held += batch.num_rows
            if held > FOREST_LINKS:
                yield from emit(us, vs)
                us, vs, held = [], [], 0
        if held:
            yield from emit(us, vs)

    def emit(us, vs):
        u, v = forest(np.concatenate(us), np.concatenate(vs))
        for x in range(0, len(u), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(u[x : x + 100_000]), pa.array(v[x : x + 100_000])], ["u", "v"])

    return links.mapInArrow(run, "u long, v long")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` of every node with a link to another (long ids); the root is the least node reachable.

    Large and small stars alternate until every node is a root (all its neighbours
    are larger) or a leaf (it has one neighbour, and that is smaller), in about
    log(n) rounds.  Each step turns a link into one with smaller ends, and every
    task contracts its links to a forest before it writes them, so links never
    grow in number.  A hub's neighbours are never gathered: minima aggregate
    partially and are joined back, with the hub's rows split by adaptive
    execution.  Before each round the links that are left are put in as few tasks
    as hold ``FOREST_LINKS`` each, so a forest spans as many of them as it may.
    Null ends and loops are ignored.
    """
    edges = saved(contracted(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v")), "edges")
    while True:
        edges = saved(contracted(edges.coalesce(max(1, -(-edges.count() // FOREST_LINKS)))), "edges")
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = saved(both.groupBy("u").agg(F.min("v").alias("low"), F.max("v").alias("high")), "stars")
        if least.filter("low < u and low < high").isEmpty():
            return least.select(F.col("u").alias("node"), F.least("u", "low").alias("root"))
        ends = least.select("u", F.least("u", "low").alias("m"))
        large = saved(contracted(both.filter("v > u").join(ends, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))), "large")
        down = saved(large.groupBy("u").agg(F.min("v").alias("m")), "stars")
        small = large.join(down, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = saved(contracted(small), "edges")
