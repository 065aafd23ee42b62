"""Registry and the binding of the test tables to acoustic shapes.

The view texts are valid in Spark SQL and in DuckDB, so both sides of a pair
start from the same rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CLASSES = ["click", "purchase", "signup"]
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

VIEWS: dict[str, str] = {
    "ann": """select event_id as ann_id, user_id as clip_id,
 cast((event_id*7919)%10000 as double)/1000 as start_time,
 cast((event_id*7919)%10000 + 2 + event_id%9 as double)/1000 as end_time,
 cast(20000+((event_id*37)%40)*1000 as double) as low_freq,
 cast(25000+((event_id*37)%40)*1000+(event_id%7)*3000 as double) as high_freq,
 event_type <> 'error' as is_target,
 case when event_type in ('click','purchase','signup') then event_type end as class_name
from events""",
    # one detection per event; those of every fifth event miss it by three seconds
    "det": """select event_id as det_id, user_id as clip_id,
 cast((event_id*7919 + case when event_id%5 = 0 then 3000 else 0 end)%10000 + (event_id*13)%41 - 20 as double)/1000 as start_time,
 cast((event_id*7919 + case when event_id%5 = 0 then 3000 else 0 end)%10000 + (event_id*13)%41 - 18 + event_id%9 as double)/1000 as end_time,
 cast(20000+((event_id*41)%40)*1000 as double) as low_freq,
 cast(26000+((event_id*41)%40)*1000+(event_id%5)*3000 as double) as high_freq,
 cast((event_id*31)%1009 as double)/1009 as detection_score,
 cast((event_id*17 + case when event_type='click' then 400 else 0 end)%1013 as double)/1013 as s_click,
 cast((event_id*19 + case when event_type='purchase' then 400 else 0 end)%1013 as double)/1013 as s_purchase,
 cast((event_id*23 + case when event_type='signup' then 400 else 0 end)%1013 as double)/1013 as s_signup
from events""",
    "cells": """select cast(floor(event_id/1000) as bigint) as clip_id,
 cast(floor((event_id%1000)/50) as bigint) as f, event_id%50 as t,
 cast((event_id*7919)%997 as double)/997 as value
from events""",
    "whole_cells": """select cast(floor(event_id/1000) as bigint) as clip_id,
 cast(floor((event_id%1000)/50) as bigint) as f, event_id%50 as t,
 cast((event_id*7919)%997 as double) as value
from events""",
    "samples": """select cast(floor(event_id/1000) as bigint) as clip_id, event_id%1000 as idx,
 cast((event_id*31)%2001-1000 as double)/1000 as x
from events""",
    # waveforms as chunks of 64 samples, sixteen to a clip
    "waves": """select cast(floor(vec_id/16) as bigint) as clip_id, vec_id%16 as chunk, embedding as samples
from embeddings""",
    "recordings": """select c_custkey as recording_id, cast(10+(c_custkey*37)%300 as double)/10 as duration,
 case when c_nationkey%3=0 then 192000 when c_nationkey%3=1 then 256000 else 384000 end as samplerate,
 concat('site', cast(c_nationkey as varchar(10)), '/rec', cast(c_custkey as varchar(20)), '.wav') as path
from customer""",
    "clips": """select distinct user_id as clip_id, cast(0 as double) as clip_start, cast(10 as double) as clip_end
from events""",
    "tags": """select event_id as ann_id, 'event' as key,
 case when event_type='error' then 'Social' else 'Echolocation' end as value from events
union all select event_id as ann_id, 'class' as key, event_type as value from events
where event_type in ('click','purchase','signup')""",
    # detections on the cell grid, one per event: column, row from the top, size in cells
    "grid_det": """select event_id as det_id, cast(floor(event_id/1000) as bigint) as clip_id,
 (event_id*3)%50 as x_pos, (event_id*5)%20 as y_pos,
 1+event_id%9 as bb_width, event_id%8 as bb_height
from events""",
    # annotations of recordings: two recordings per user, ten events a second long recording
    "rec_ann": """select event_id as ann_id, cast(floor(event_id/4) as bigint)%500 as recording_id,
 event_type as class_name,
 cast((event_id*7919)%30000 as double)/1000 as start_time,
 cast((event_id*7919)%30000 + 200 + (event_id%9)*50 as double)/1000 as end_time
from events""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = VIEWS[name]
    used = [t for t in TABLES if re.search(rf"\bfrom {t}\b", text)]
    for t in used:
        text = re.sub(rf"\bfrom {t}\b", f"from {{{t}}}", text)
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in used})


def scored(dets: DataFrame) -> DataFrame:
    """Class scores as one array in class order."""
    return dets.withColumn("class_scores", F.array(*[f"s_{c}" for c in CLASSES]))


def tagged(anns: DataFrame) -> DataFrame:
    """Tag array and shape type next to each annotation; the same tags as the ``tags`` view."""
    def one(key: str, value):
        return F.struct(F.lit(key).alias("key"), value.alias("value"))

    kind = F.when(F.col("is_target"), "Echolocation").otherwise("Social")
    every = F.array(one("event", kind), one("class", F.col("class_name")))
    return anns.withColumn("tags", F.filter(every, lambda t: t["value"].isNotNull())).withColumn(
        "geom_type", F.lit("BoundingBox")
    )


def query(name: str, sql: str | None = None, needs: str = ""):
    """Register a query; ``sql`` is its twin on top of the views named in ``needs``."""

    def register(function):
        if name in QUERIES:
            raise ValueError(f"twice: {name}")
        QUERIES[name] = function
        if sql is not None:
            heads = [f"{v} as ({VIEWS[v]})" for v in needs.split()]
            body = sql.strip()
            if heads and body.lower().startswith("with recursive "):
                body = "with recursive " + ", ".join(heads) + ", " + body[15:]
            elif heads and body.lower().startswith("with "):
                body = "with " + ", ".join(heads) + ", " + body[5:]
            elif heads:
                body = "with " + ", ".join(heads) + " " + body
            ORACLES[name] = body
        return function

    return register


class Inputs:
    """Short access to views and tables of one scale folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return view(self.spark, self.sf_dir, name)
        return table(self.spark, self.sf_dir, name)


def on_inputs(function):
    """Turn ``f(inputs)`` into the (spark, sf_dir) form of the registry."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(Inputs(spark, sf_dir))

    run.__name__ = function.__name__
    return run


def pair(name: str, sql: str | None = None, needs: str = ""):
    return lambda f: query(name, sql, needs)(on_inputs(f))
