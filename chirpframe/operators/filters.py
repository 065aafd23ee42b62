"""Filters over annotations, tasks, files and detections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.conditions import Condition

UUID_PATTERN = "^[0-9a-fA-F]{8}-?([0-9a-fA-F]{4}-?){3}[0-9a-fA-F]{12}$"


def keep(df: DataFrame, condition: Condition) -> DataFrame:
    return df.where(condition.column())


def filter_events(clips: DataFrame, condition: Condition, events: str = "events") -> DataFrame:
    """Filter the nested events of each clip; clips left without events stay."""
    return clips.withColumn(events, F.filter(events, lambda e: condition.column(lambda n: e[n])))


def filter_flat_events(clips: DataFrame, events: DataFrame, condition: Condition, key: str = "clip_id") -> DataFrame:
    """Flat form: clips without a surviving event keep one row with null event columns."""
    return clips.join(keep(events, condition), key, "left")


# --- id and path lists -----------------------------------------------------

def id_in_list(df: DataFrame, ids: DataFrame, column: str, negate: bool = False) -> DataFrame:
    """Semi join on an id list, anti join when negated. The list may be of any size."""
    wanted = ids.select(ids.columns[0]).toDF(column)
    return df.join(wanted, column, "left_anti" if negate else "left_semi")


def flag_in_list(df: DataFrame, ids: DataFrame, column: str, flag: str) -> DataFrame:
    """Boolean column instead of a filter, for use inside ``AnyOf`` through ``Flag``."""
    wanted = ids.select(ids.columns[0]).toDF(column).distinct().withColumn(flag, F.lit(True))
    return df.join(wanted, column, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def checked_uuids(ids: DataFrame, position: str = "position") -> DataFrame:
    """Canonical ids; a malformed one fails the job and names its position."""
    value = F.col(ids.columns[0])
    plain = F.lower(F.regexp_replace(value, "-", ""))
    dashed = F.regexp_replace(plain, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    where = F.col(position).cast("string") if position in ids.columns else F.lit("?")
    message = F.concat(F.lit("entry "), where, F.lit(" is no id: "), value)
    return ids.withColumn(
        ids.columns[0],
        F.when(value.rlike(UUID_PATTERN), dashed).otherwise(F.raise_error(message).cast("string")),
    )


def path_under_base(path: Column, base_dir: str | None) -> tuple[Column, Column]:
    """(path relative to ``base_dir``, whether an absolute path lies outside it)."""
    if base_dir is None:
        return path, F.lit(False)
    base = base_dir.rstrip("/")
    absolute = path.startswith("/")
    inside = path.startswith(base + "/")
    relative = F.when(absolute & inside, path.substr(F.lit(len(base) + 2), F.length(path))).otherwise(path)
    return relative, absolute & ~inside


def path_in_list(
    df: DataFrame,
    paths: DataFrame,
    base_dir: str | None = None,
    on_outside: str = "allow",
    column: str = "path",
) -> DataFrame:
    """Keep recordings whose path is listed. ``allow`` and ``warn`` also keep paths
    outside ``base_dir``, ``error`` fails on them; ``warn`` marks them in ``_outside``."""
    if on_outside not in ("allow", "warn", "error"):
        raise ValueError(f"Invalid on_outside {on_outside}")
    listed, _ = path_under_base(F.col(paths.columns[0]), base_dir)
    wanted = paths.select(listed.alias("_listed")).distinct().withColumn("_hit", F.lit(True))
    relative, outside = path_under_base(F.col(column), base_dir)
    if on_outside == "error":
        message = F.concat(F.lit("path outside the base folder: "), F.col(column))
        outside = F.when(outside, F.raise_error(message).cast("boolean")).otherwise(F.lit(False))
    rows = df.withColumns({"_listed": relative, "_outside": outside}).join(wanted, "_listed", "left")
    kept = rows.where(F.col("_outside") | F.coalesce("_hit", F.lit(False))).drop("_listed", "_hit")
    return kept if on_outside == "warn" else kept.drop("_outside")


# --- tasks, files, sources -------------------------------------------------

def task_is_ready(
    badges: Column, only_completed: bool = True, only_verified: bool = False, exclude_issues: bool = True
) -> Column:
    """Status rule over the badge array of an annotation task."""

    def has(state: str) -> Column:
        return F.coalesce(F.exists(badges, lambda b: b["state"] == state), F.lit(False))

    ready = F.lit(True)
    if exclude_issues:
        ready = ready & ~has("rejected")
    if only_verified:
        ready = ready & has("verified")
    if only_completed:
        ready = ready & has("completed")
    return ready


def select_tasks(tasks: DataFrame, badges: str = "badges", **rules: bool) -> DataFrame:
    return tasks.where(task_is_ready(F.col(badges), **rules))


def ready_clips(clips: DataFrame, tasks: DataFrame, key: str = "clip_id", badges: str = "badges", **rules: bool) -> DataFrame:
    return clips.join(select_tasks(tasks, badges, **rules).select(key), key, "left_semi")


def annotated_files(files: DataFrame, only_annotated: bool = True, exclude_issues: bool = True) -> DataFrame:
    out = files
    if only_annotated:
        out = out.where(F.coalesce("annotated", F.lit(False)))
    if exclude_issues:
        out = out.where(~F.coalesce("issues", F.lit(False)))
    return out


def source_selected(name: str, include: Sequence[str] | None = None, exclude: Sequence[str] | None = None) -> bool:
    """Decide on a source before it is scanned."""
    if include and name not in include:
        return False
    return not (exclude and name in exclude)


def by_source(df: DataFrame, include=None, exclude=None, column: str = "source") -> DataFrame:
    """The same choice on rows that already carry their source."""
    out = df
    if include:
        out = out.where(F.col(column).isin(*include))
    if exclude:
        out = out.where(~F.col(column).isin(*exclude))
    return out


def without_test_items(train: DataFrame, test: DataFrame, key: str = "id") -> DataFrame:
    return train.join(test.select(key), key, "left_anti")


# --- detections ------------------------------------------------------------

def by_frequency(dets: DataFrame, min_freq: float = 0.0, max_freq: float = float("inf"), mode: str = "both") -> DataFrame:
    """Closed range on one bound; ``both`` keeps low ≥ min OR high ≤ max."""
    low, high = F.lit(float(min_freq)), F.lit(float(max_freq))
    if mode in ("low_freq", "high_freq"):
        return dets.where(F.col(mode).between(low, high))
    return dets.where((F.col("low_freq") >= low) | (F.col("high_freq") <= high))


def by_duration(dets: DataFrame, min_duration: float = 0.0, max_duration: float = float("inf")) -> DataFrame:
    span = F.col("end_time") - F.col("start_time")
    return dets.where(span.between(F.lit(float(min_duration)), F.lit(float(max_duration))))


def below_nyquist(dets: DataFrame, recordings: DataFrame | None = None, key: str = "recording_id", mode: str = "high_freq", buffer: float = 0.0) -> DataFrame:
    """Strict bound ``samplerate / 2 - buffer``; joins the rate unless it is a column already."""
    rows = dets if recordings is None else dets.join(recordings.select(key, "samplerate"), key)
    kept = rows.where(F.col(mode) < F.col("samplerate") / 2 - F.lit(float(buffer)))
    return kept if recordings is None else kept.drop("samplerate")


def at_or_below_nyquist(dets: DataFrame, recordings: DataFrame, key: str = "recording_id") -> DataFrame:
    """Older inclusive rule on the whole-number high frequency of the real sample rate."""
    rate = F.col("samplerate") * F.coalesce(F.col("time_expansion"), F.lit(1.0))
    rows = dets.join(recordings.select(key, (rate / 2).alias("_nyquist")), key)
    return rows.where(F.col("high_freq").cast("int") <= F.col("_nyquist")).drop("_nyquist")


def away_from_edges(dets: DataFrame, clips: DataFrame, buffer: float = 0.1, mode: str = "both", key: str = "clip_id") -> DataFrame:
    rows = dets.join(clips.select(key, "clip_start", "clip_end"), key)
    first, last = F.col("clip_start") + F.lit(buffer), F.col("clip_end") - F.lit(buffer)
    if mode in ("start_time", "end_time"):
        inside = F.col(mode).between(first, last)
    else:
        inside = (F.col("start_time") >= first) & (F.col("end_time") <= last)
    return rows.where(inside).drop("clip_start", "clip_end")


def in_bounds(rows: DataFrame, clips: DataFrame, buffer: float = 0.01, key: str = "clip_id") -> DataFrame:
    """Evaluation bounds: only the start time has to lie inside the shrunk clip."""
    near = rows.join(clips.select(key, "clip_start", "clip_end"), key)
    return near.where(
        F.col("start_time").between(F.col("clip_start") + F.lit(buffer), F.col("clip_end") - F.lit(buffer))
    ).drop("clip_start", "clip_end")
