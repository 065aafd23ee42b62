"""User plug-ins by dotted path: conditions, transforms, affinities, metrics, steps.

A plug-in is any callable or class of the shape its place expects – a condition
with ``column(row)``, an ``EventTransform``, an affinity with ``span`` and
``column``, or a function DataFrame → DataFrame. Row code belongs in a
``pandas_udf`` inside it.
"""

from __future__ import annotations

from importlib import import_module
from typing import Any


def load(target: str, **arguments: Any) -> Any:
    """Import ``package.module.name``; with arguments, or for a class, call it."""
    path, _, name = target.rpartition(".")
    if not path:
        raise ValueError(f"Not a dotted path: {target!r}")
    found = getattr(import_module(path), name)
    if arguments or isinstance(found, type):
        return found(**arguments)
    return found


def register_scorer(spark, name: str, function, returns: str = "array<double>") -> None:
    """Register a pandas Series → Series scorer for SQL use."""
    from pyspark.sql import functions as F

    spark.udf.register(name, F.pandas_udf(function, returns))
