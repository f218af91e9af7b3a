"""Connected components of a table of links: in one task where a count shows that they are few, else by alternating large and small stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.llm.common import Scratch, trim

#: Links up to which one task takes them all, 16 bytes each; each round of stars costs the driver some ten shuffles.
AT_ONCE = 1 << 20


def smallest_of_component(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links (u, v), ascending, and the smallest node of each one's component."""
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at.reshape(2, -1)
    root = np.arange(len(names))
    while True:
        a, b = root[a], root[b]
        a, b = np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]
        if not len(a):
            return names, names[root]
        np.minimum.at(root, b, a)
        while (root[root] != root).any():
            root = root[root]


def _in_one_task(links: DataFrame) -> DataFrame:
    schema = pa.schema([("node", pa.int64()), ("component", pa.int64())])

    def run(it):
        held = [b for b in it if b.num_rows]
        if held:
            u, v = (np.concatenate([b.column(k).to_numpy() for b in held]) for k in range(2))
            names, least = smallest_of_component(u, v)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(least)], schema=schema)
        trim()

    return links.select("u", "v").coalesce(1).mapInArrow(run, "node long, component long")


def connected_components(links: DataFrame, scratch: Scratch, keep: bool = False) -> DataFrame:
    """links: u and v (long). One row per node that has a link to another one: node, component (its smallest node).

    Each round of stars is two joins with minima that were combined before the shuffle, so a node with very many links is
    one row on the side that is not split; rounds are logarithmic in the nodes; each is written and its predecessor deleted.
    Few links are read once, by one task. links should be a table that was written: it is counted first. keep: the result outlives the scratch.
    """
    apart = links.where("u <> v")
    if apart.count() <= AT_ONCE:
        return scratch.written(_in_one_task(apart), "components", keep)
    edges = apart.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = scratch.written(edges, "edges")
    state = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = scratch.written(joined.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        scratch.drop(edges)
        edges = small
        new = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if new == state:
            break
        state = new
    found = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    found = scratch.written(found.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "components", keep)
    scratch.drop(edges)
    return found
