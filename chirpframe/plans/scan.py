"""Prefix scans of affine recurrences over long orders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 64


def affine_prefix(
    rows: DataFrame, keys: Sequence[str], place: str = "place", factor: str = "factor", term: str = "term",
    width: int = WIDTH,
) -> DataFrame:
    """(keys, place, carry): the state before each place under ``m -> factor * m + term``, from 0.

    Affine maps compose to affine maps, so runs of ``width`` places are folded to one map
    each, the maps are scanned the same way (as many levels as needed), and
    every run is unrolled from the state it starts with. No list is longer than
    ``width``. Places are whole numbers from 0, unique per key; gaps stand for the identity.
    """
    keys = list(keys)
    step = F.struct(F.col(place).alias("p"), F.col(factor).alias("a"), F.col(term).alias("b"))
    runs = rows.groupBy(*keys, F.floor(F.col(place) / width).alias("_run")).agg(
        F.array_sort(F.collect_list(step)).alias("_steps"))
    if (rows.agg(F.max(place)).first()[0] or 0) < width:
        runs = runs.withColumn("_start", F.lit(0.0))
    else:
        none = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))
        whole = F.aggregate("_steps", none, lambda m, s: F.struct(
            (m["a"] * s["a"]).alias("a"), (m["b"] * s["a"] + s["b"]).alias("b")))
        maps = runs.select(*keys, "_run", whole.alias("_m")).select(
            *keys, "_run", F.col("_m.a").alias("factor"), F.col("_m.b").alias("term"))
        starts = affine_prefix(maps, keys, "_run", width=width).withColumnRenamed("carry", "_start")
        runs = runs.join(starts, [*keys, "_run"])
    first = F.struct(F.col("_start").alias("m"), F.array().cast("array<double>").alias("seen"))
    states = F.aggregate("_steps", first, lambda m, s: F.struct(
        (m["m"] * s["a"] + s["b"]).alias("m"), F.array_append(m["seen"], m["m"]).alias("seen")))["seen"]
    each = F.arrays_zip(F.transform("_steps", lambda s: s["p"]).alias("p"), states.alias("m"))
    return runs.select(*keys, F.explode(each).alias("_e")).select(
        *keys, F.col("_e.p").alias(place), F.col("_e.m").alias("carry"))
