"""Train/test splits. Draws are md5 of (seed, id): the same for every run and partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.draws import draw
from ..plans.ordered import hashed_rank


def majority_class(events: DataFrame, key: str = "recording_id", column: str = "class_name") -> DataFrame:
    """Most frequent class per recording, alphabetical on ties."""
    counts = events.groupBy(key, column).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(key).agg(F.min_by(column, F.struct(-F.col("_n"), F.col(column))).alias(column))


def split_by_recordings(
    recordings: DataFrame, events: DataFrame, train_size: float = 0.75, seed: str = "split",
    key: str = "recording_id", column: str = "class_name",
) -> DataFrame:
    """Recordings with ``split`` train or test, stratified on their majority class.

    Each class gives exactly ``round(train_size × n)`` recordings to train;
    recordings without a class form a stratum of their own.
    """
    majority = majority_class(events, key, column)
    strata = recordings.select(key).distinct().join(majority, key, "left").withColumn("_u", draw(seed, F.col(key)))
    ranked = hashed_rank(strata.withColumn("_s", F.coalesce(F.col(column), F.lit(""))), ["_s"], "_u", key, "_rank")
    sizes = ranked.groupBy("_s").agg(F.count(F.lit(1)).alias("_size"))
    quota = F.floor(F.col("_size") * F.lit(float(train_size)) + F.lit(0.5))
    return ranked.join(sizes, "_s").select(
        key, column, F.when(F.col("_rank") <= quota, "train").otherwise("test").alias("split")
    )


def clips_of_split(clips: DataFrame, split: DataFrame, name: str, key: str = "recording_id") -> DataFrame:
    return clips.join(split.where(F.col("split") == name).select(key), key, "left_semi")


def group_folds(
    events: DataFrame, n_splits: int = 5, seed: str = "0", key: str = "file_id", column: str = "class_name"
) -> DataFrame:
    """Fold per file, with classes spread evenly and every file on one side.

    Files are dealt to folds by random rank inside their stratum (majority
    class), each stratum starting at a random fold. Nothing is decided in one
    task: ranks come from draw buckets.
    """
    files = majority_class(events, key, column).withColumn("_u", draw(seed, F.col(key)))
    ranked = hashed_rank(files, [column], "_u", key, "_rank")
    shift = F.floor(draw(f"{seed}-shift", F.col(column)) * n_splits)
    return ranked.select(key, column, F.pmod(F.col("_rank") + shift, F.lit(n_splits)).cast("int").alias("fold"))


def first_fold(folds: DataFrame) -> DataFrame:
    return folds.withColumn("split", F.when(F.col("fold") == 0, "test").otherwise("train"))


def split_from_lists(files: DataFrame, train: DataFrame, test: DataFrame, key: str = "id") -> DataFrame:
    """Explicit lists win over any rule; a file on both lists appears on both sides."""
    sides = train.select(F.col(train.columns[0]).alias(key), F.lit("train").alias("split")).unionByName(
        test.select(F.col(test.columns[0]).alias(key), F.lit("test").alias("split"))
    ).distinct()
    return files.join(sides, key)


def class_mismatch(events: DataFrame, split: DataFrame, key: str = "file_id", column: str = "class_name") -> DataFrame:
    """Classes that occur on one side only. Empty when the split is sound."""
    sides = events.join(split.select(key, "split"), key).select("split", column).distinct()
    return sides.groupBy(column).agg(F.count(F.lit(1)).alias("_n"), F.min("split").alias("only_in")).where(
        F.col("_n") == 1
    ).drop("_n")


def require_same_classes(events: DataFrame, split: DataFrame, **names: str) -> None:
    """Action: raises when a class is missing on one side."""
    if not class_mismatch(events, split, **names).isEmpty():
        raise RuntimeError("Some classes are not in both the training and test sets. Try a different seed.")


def named_split(datasets: DataFrame, split_name: str, load_extra: bool = True) -> DataFrame:
    """Rows of a dataset registry (split_name, dataset_name, is_test, is_binary, paths).

    Binary (extra) training sets can be left out. An unknown name fails.
    """
    rows = datasets.where(F.col("split_name") == split_name)
    if rows.isEmpty():
        raise ValueError(f"Split not defined: {split_name}")
    return rows if load_extra else rows.where(F.col("is_test") | ~F.col("is_binary"))
