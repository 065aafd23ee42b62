"""Connected components of a link table, with joins and partial aggregates only.

Alternating stars: "large star" moves every larger neighbour of a node to the
smallest node it sees, "small star" does so for the smaller ones; the links end
as stars around the smallest node of each component. A hub is aggregated inside
the tasks first, and its rows are joined by key with Spark's skew handling.

Before that, chunks of at most ``CHUNK`` links are each reduced to stars by
union-find in a task of its own, which leaves little for the rounds to do; one
chunk alone is finished by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, stored


CHUNK = 1_000_000


def _stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The links of one task as stars around the smallest node of each of its components."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        for a, b in zip(batch["a"].tolist(), batch["b"].tolist()):
            one, two = root(a), root(b)
            if one != two:
                parent[max(one, two)] = min(one, two)
    pairs = [(x, root(x)) for x in parent]
    yield pd.DataFrame([p for p in pairs if p[0] != p[1]], columns=["a", "b"], dtype="int64")


def _labels(stars: DataFrame) -> DataFrame:
    return stars.select(F.col("a").alias("node"), F.col("b").alias("label")).union(
        stars.select("b", "b").distinct().toDF("node", "label")
    )


def _large(links: DataFrame) -> DataFrame:
    both = links.union(links.select("b", "a"))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("_a"), F.least("a", "m").alias("m"))
    out = both.join(low, F.col("a") == F.col("_a")).where("b > a")
    return out.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "_a")
    out = down.join(low, F.col("a") == F.col("_a"))
    return out.select("b", "m").union(low.select("_a", "m")).toDF("a", "b").where("a <> b")


def _state(links: DataFrame):
    return links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b; stored); the label is the component's smallest node."""
    chunks = links.count() // CHUNK + 1
    now = stored(links.where("a <> b").select("a", "b").repartition(chunks).mapInPandas(_stars, "a long, b long"), "links")
    if chunks == 1:
        return _labels(now)
    before, after = None, _state(now)
    while before != after:
        step = stored(_small(_large(now).distinct()).distinct(), "links")
        drop_stored(now)
        now, before, after = step, after, _state(step)
    return _labels(now)
