"""Connected components of rows along one axis."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import order_rows, running, with_previous
from .session import cut_lineage


def interval_clusters(rows: DataFrame, keys: Sequence[str], low: Column, high: Column) -> DataFrame:
    """Add ``cluster``: rows of a key whose spans [low, high] touch, directly or through others, share it.

    Rows are ordered by (key, low) once, over ranges. Where a span starts beyond
    the running maximum of all ends before it, a new cluster begins. Unlike the propagation of
    labels along links, this takes no more jobs for longer chains. Edges of
    any graph whose nodes have a place on the axis can be given as spans between their two
    places: edges that share a node touch there, so no component is cut.
    """
    # the tie is unique, so that all passes over the stored ranges see one order
    placed = rows.withColumns({"_low": low, "_high": high, "_tie": F.monotonically_increasing_id()})
    ordered = order_rows(placed, keys, [("_low", False), ("_tie", False)])
    reached = running(ordered, maxima={"_top": F.col("_high")})
    before = with_previous(reached, "_before", "_top")
    fresh = F.when(F.col("_before").isNull() | (F.col("_low") > F.col("_before")), 1).otherwise(0).cast("bigint")
    marked = before.with_rows(cut_lineage(before.rows.withColumn("_new", fresh).drop("_top", "_before")))
    return running(marked, sums={"cluster": F.col("_new")}).clean().drop("_low", "_high", "_tie", "_new")
