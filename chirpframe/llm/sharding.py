"""Shards by a two-pass external shuffle, in DataFrame functions only.

Pass one scatters rows into buckets by seeded hashes: the shard is the
one with the highest hash of the id among all shards (so one more shard takes rows only
into itself), the bucket is a hash of the id, the text and the row's number, modulo the number of buckets that
keeps a bucket near ``bucket_bytes``. Pass two collects each bucket, puts it in
a fixed order, shuffles it with Spark's own Fisher-Yates ``shuffle`` and writes
it. Buckets are bounded by their mean size plus the spread of a hash, so no
task ever holds a shard.

Defined cases: a null id hashes like any other value, so all rows without an id
share a shard (law ``key``), as do the rows of a repeated id; they are spread over its buckets. Null text has size 8 and the checksum of an empty text. Repeated rows are
written each. A text longer than ``bucket_bytes`` makes its bucket as much larger. Columns of the input travel inside a struct, so their names
cannot clash. An empty table writes nothing and gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.session import shared_path
from .common import join_checked, text_of

BUCKET_BYTES = 8 << 20
#: Bytes of records that one task of the second pass reads, whatever the size of the table.
TASK_BYTES = 16 << 20


def size_of(text: str | Column) -> Column:
    return (F.octet_length(text_of(text)) + F.lit(8)).cast("long")


def shard_of(key: Column, n_shards: int, seed: int = 7) -> Column:
    """Rendezvous hashing: the shard whose hash with the key is highest."""
    draws = F.array(*[F.xxhash64(key, F.lit(seed), F.lit(k)) for k in range(n_shards)])
    return (F.array_position(draws, F.array_max(draws)) - 1).cast("int")


def write_shards(
    docs: DataFrame, path: str, n_shards: int = 24, bucket_bytes: int = BUCKET_BYTES, seed: int = 7
) -> DataFrame:
    """Write (shard, bucket, pos, record) as Parquet under ``path`` and return it as read back.

    ``record`` is the whole input row. Within a shard, bucket then pos is the shuffled order.
    """
    total = docs.agg(F.sum(size_of("text"))).first()[0] or 0
    n_buckets = max(1, math.ceil(total / (n_shards * bucket_bytes)))
    record = F.struct(*[docs[c] for c in docs.columns])
    spread = [F.col("doc_id"), F.col("text"), F.monotonically_increasing_id()]  # rows of one id or one text part, too
    placed = docs.select(
        shard_of(F.col("doc_id"), n_shards, seed).alias("shard"),
        F.pmod(F.xxhash64(F.lit(seed + 1), *spread), F.lit(n_buckets)).cast("int").alias("bucket"),
        F.struct(F.xxhash64("doc_id", "text", F.lit(seed)).alias("order"), record.alias("record")).alias("item"),
    )
    tasks = max(1, math.ceil(total / max(TASK_BYTES, bucket_bytes)))
    placed = placed.repartition(tasks, "shard", "bucket")  # a count that follows the data: a task holds few buckets
    buckets = placed.groupBy("shard", "bucket").agg(F.sort_array(F.collect_list("item")).alias("items"))
    dealt = buckets.select("shard", "bucket", F.posexplode(F.shuffle("items", seed)).alias("pos", "item"))
    dealt.select("shard", "bucket", "pos", F.col("item.record").alias("record")).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def with_slots(written: DataFrame) -> DataFrame:
    """Add ``slot``: 0-based place of each row in its shard."""
    counts = written.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    # a broadcast after counting the buckets: else the records would be shuffled once more
    return join_checked(written, starts, ["shard", "bucket"], "inner").withColumn(
        "slot", (F.col("_start") + F.col("pos")).cast("long")
    ).drop("_start")


def sharded(spark: SparkSession, docs: DataFrame, n_shards: int = 24, seed: int = 7) -> DataFrame:
    """Shards of ``docs``, written and read back: shard, bucket, pos, record, slot, grown_shard."""
    written = write_shards(docs, shared_path(spark, "shards"), n_shards, seed=seed)
    return with_slots(written).withColumn("grown_shard", shard_of(F.col("record.doc_id"), n_shards + 1, seed))
