"""Shared pieces of the text operators: stored tables, checked broadcasts, salted groups.

Row identity: ``doc_id`` may repeat or be null. Operators that decide about rows
number them once (``row``), in a table that is written before it is read twice.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import shared_path

SPACES = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SALTS = 32
#: Rows up to which a table of a few numbers is broadcast (about 32 bytes each, so some 16 MB).
SMALL_ROWS = 500_000


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(*tables: DataFrame) -> None:
    """Delete tables written by ``stored`` that nothing will read again."""
    for table in tables:
        spark = table.sparkSession
        jvm = spark._jvm
        for name in table.inputFiles()[:1]:
            folder = jvm.org.apache.hadoop.fs.Path(name).getParent()
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str | Column) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def numbered(df: DataFrame) -> DataFrame:
    """Add ``row``, unique per row. Store the result before using it twice."""
    return df.withColumn("row", F.monotonically_increasing_id())


def small(df: DataFrame, limit: int = SMALL_ROWS) -> bool:
    """True if ``df`` has at most ``limit`` rows; looks at no more than that."""
    return df.limit(limit + 1).count() <= limit


def join_checked(left: DataFrame, right: DataFrame, on, how: str) -> DataFrame:
    """Join that broadcasts ``right`` if a count shows it is small, else leaves the choice to Spark.

    ``right`` should be a stored or cheap table of few short columns.
    """
    return left.join(F.broadcast(right) if small(right) else right, on, how)


def per_group(
    rows: DataFrame, key: Sequence[str], first: Mapping[str, Column], merge: Mapping[str, Column], salt: str = "row"
) -> DataFrame:
    """Add aggregates of each group to its rows, also where one group holds most of them.

    ``first`` aggregates rows to columns, ``merge`` aggregates those columns
    again. Groups are cut by a salt of column ``salt``; the result of a group is
    repeated for the salts it has, so the join back never meets in one task.
    Null keys form a group of their own.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int"))
    parts = salted.groupBy(*key, "_salt").agg(*[c.alias(n) for n, c in first.items()])
    totals = parts.groupBy(*key).agg(
        *[c.alias(f"_m_{n}") for n, c in merge.items()], F.collect_list("_salt").alias("_salts")
    )
    spread = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in key], *[F.col(f"_m_{n}").alias(n) for n in merge],
        F.explode("_salts").alias("_s"),
    )
    same = F.col("_salt") == F.col("_s")
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return salted.join(spread, same, "inner").drop("_salt", "_s", *[f"_k_{k}" for k in key])


def keep_decided(docs: DataFrame, decisions: DataFrame, token: Column, every: str | None = None) -> DataFrame:
    """Rows of ``docs`` that ``decisions`` (doc_id, token, kept) keeps, columns as they were.

    ``token`` computes the decisions' ``token`` from a row of ``docs`` (say, a
    digest of its text). Ids of which every row goes are removed by an anti-join. Ids with
    rows of both kinds (repeated ids) keep one row per kept token, and all rows of the token ``every``.
    """
    by_id = decisions.groupBy("doc_id").agg(
        F.sum(F.col("kept").cast("long")).alias("_kept"), F.count(F.lit(1)).alias("_all")
    ).where("_kept < _all")
    by_id = stored(by_id.select(F.col("doc_id").alias("_id"), "_kept"), "dropped")
    same = docs["doc_id"].eqNullSafe(F.col("_id"))
    rest = join_checked(docs, by_id.select("_id"), same, "left_anti")
    mixed = by_id.where("_kept > 0").select("_id")
    if mixed.isEmpty():
        return rest
    ours = join_checked(docs, mixed, same, "left_semi").withColumn("_token", token)
    good = decisions.where("kept").select(F.col("doc_id").alias("_id"), F.col("token").alias("_t")).distinct()
    both = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_token") == F.col("_t"))
    ours = ours.join(good, both, "left_semi")
    if every is None:
        return rest.unionByName(ours.dropDuplicates(["doc_id", "_token"]).drop("_token"))
    one = ours.where(F.col("_token") != every).dropDuplicates(["doc_id", "_token"])
    return rest.unionByName(one.union(ours.where(F.col("_token") == every)).drop("_token"))
