"""Precision–recall, average precision, ROC and score distributions.

Input rows ("observations") carry key columns, ``score``, ``row_id`` (breaks
ties) and ``is_true``. Everything is grouped by ``keys``; with no keys there is
one curve over all rows, still computed by many tasks (see ``plans.ordered``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ordered import RANGE, Ordered, order_rows, running, with_rank

NAN = float("nan")


def nan() -> Column:
    return F.lit(NAN)


def ratio(part: Column, whole: Column) -> Column:
    """Division that yields NaN on an empty denominator."""
    return F.when(whole > 0, part / whole).otherwise(nan())


def attach(df: DataFrame, other: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join per key, or attach the single row when there are no keys."""
    if keys:
        return df.join(other, list(keys), how)
    return df.crossJoin(F.broadcast(other))  # one row


def count_positives(obs: DataFrame, keys: Sequence[str]) -> DataFrame:
    return obs.groupBy(*keys).agg(F.sum(F.col("is_true").cast("bigint")).alias("n_pos"))


def _curve(obs: DataFrame, keys: Sequence[str], positives: DataFrame | None) -> Ordered:
    rows = obs.select(*keys, "row_id", "score", F.col("is_true").cast("bigint").alias("hit"))
    ordered = order_rows(rows, keys, [("score", True), ("row_id", False)])
    base = ordered.rows.withColumn("is_true", F.col("hit") == 1)
    n_pos = positives if positives is not None else count_positives(base, keys)
    ordered = running(ordered, sums={"rank": F.lit(1).cast("bigint"), "tp": F.col("hit")})
    found = F.when(F.col("n_pos") > 0, F.col("tp") / F.col("n_pos")).otherwise(F.lit(0.0))
    curve = attach(ordered.rows, n_pos, keys).withColumns(
        {
            "fp": F.col("rank") - F.col("tp"),
            "precision": F.col("tp") / F.col("rank"),
            "recall": found,
        }
    )
    return ordered.with_rows(curve)


def pr_curve(obs: DataFrame, keys: Sequence[str] = (), positives: DataFrame | None = None) -> DataFrame:
    """One point per observation, highest score first.

    ``positives`` (keys, n_pos) gives the number of ground truths; without it
    the true observations are counted. Checkpoints the ordered rows once.
    """
    return _curve(obs, keys, positives).clean().drop("hit", "n_pos")


def curve_areas(
    obs: DataFrame, keys: Sequence[str] = (), positives: DataFrame | None = None, level: float = 0.95
) -> DataFrame:
    """Average precision, ROC AUC and recall at ``level`` precision per key, from one ordering.

    Average precision is the area under the precision envelope: NaN when given
    positives are zero, 0 when derived positives are zero. AUC counts pairs of
    true and false observations in the right order, ties half; NaN when one
    kind is missing. Keys of ``positives`` without observations give 0, NaN, 0.
    """
    envelope = running(_curve(obs, keys, positives), maxima={"envelope": F.col("precision")}, reverse=True)
    hit = F.col("hit") == 1
    good = F.col("precision") > F.lit(float(level))
    tied = envelope.rows.groupBy(*keys, "score").agg(
        F.sum("hit").alias("_p"),
        F.sum(1 - F.col("hit")).alias("_n"),
        F.max("fp").alias("_fp"),
        F.sum(F.when(hit, F.col("envelope"))).alias("_area"),
        F.max(F.when(good, F.col("recall"))).alias("_good"),
    )
    # recall never falls along the curve, so its maximum is the last good point
    sums = tied.groupBy(*keys).agg(
        F.sum("_area").alias("_area"), F.sum("_p").alias("_p"), F.sum("_n").alias("_n"),
        F.sum(F.col("_p") * (F.col("_n") / 2 - F.col("_fp"))).alias("_pairs"), F.max("_good").alias("_good"),
    )
    if positives is None:
        rows = sums.withColumn("n_pos", F.coalesce("_p", F.lit(0)))
    else:
        rows = attach(positives, sums, keys, "left")
    all_pairs = F.col("_p").cast("double") * F.col("_n")
    empty = F.lit(0.0) if positives is None else nan()
    return rows.select(
        *keys, "n_pos",
        F.when(F.col("n_pos") > 0, F.coalesce("_area", F.lit(0.0)) / F.col("n_pos")).otherwise(empty)
        .alias("average_precision"),
        F.coalesce(ratio(F.col("_pairs") + all_pairs, all_pairs), nan()).alias("roc_auc"),
        F.coalesce("_good", F.lit(0.0)).alias("recall_at_x"),
    )


def average_precision(
    obs: DataFrame, keys: Sequence[str] = (), positives: DataFrame | None = None
) -> DataFrame:
    """Average precision per key, see :func:`curve_areas`."""
    return curve_areas(obs, keys, positives).select(*keys, "average_precision")


def recall_at_precision(curve: DataFrame, keys: Sequence[str] = (), level: float = 0.95) -> DataFrame:
    """Recall of the last point whose precision exceeds ``level``, 0 when none does."""
    good = F.col("precision") > F.lit(level)
    return curve.groupBy(*keys).agg(
        F.coalesce(F.max_by(F.col("recall"), F.when(good, F.col("rank"))), F.lit(0.0)).alias("recall_at_x")
    )


def curve_points(
    curve: DataFrame, thresholds: Sequence[float], keys: Sequence[str] = (), legacy: bool = False
) -> DataFrame:
    """Curve row at each operating threshold.

    The point lies one past the scores at or above the threshold (strictly
    above with ``legacy``), at the last row at most. ``legacy`` also moves a
    point that would be the first row to the last one.
    """
    steps = [
        F.struct(
            F.lit(float(t)).alias("threshold"),
            F.sum((F.col("score") > F.lit(float(t)) if legacy else F.col("score") >= F.lit(float(t)))
                  .cast("bigint")).alias("_above"),
        )
        for t in thresholds
    ]
    counted = curve.groupBy(*keys).agg(F.array(*steps).alias("_steps"), F.count(F.lit(1)).alias("_n"))
    above = F.col("_above")
    edge = (above == 0) | (above == F.col("_n")) if legacy else above == F.col("_n")
    wanted = counted.select(*keys, "_n", F.explode("_steps").alias("_s")).select(
        *keys, "_n", "_s.threshold", "_s._above"
    ).select(*keys, "threshold", F.when(edge, F.col("_n")).otherwise(above + 1).alias("rank"))
    return wanted.join(curve.select(*keys, "rank", "score", "precision", "recall"), [*keys, "rank"])


# --- ROC -------------------------------------------------------------------

def _score_counts(obs: DataFrame, keys: Sequence[str]) -> DataFrame:
    hit = F.col("is_true").cast("bigint")
    return obs.groupBy(*keys, "score").agg(F.sum(hit).alias("pos"), F.sum(1 - hit).alias("neg"))


def _totals(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    return counts.groupBy(*keys).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))


def roc_curve(obs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One point per distinct score, plus the origin at an infinite threshold."""
    ordered = order_rows(_score_counts(obs, keys), keys, [("score", True)])
    totals = _totals(ordered.rows, keys)
    rows = running(ordered, sums={"tp": F.col("pos"), "fp": F.col("neg")}).clean()
    points = rows.select(*keys, F.col("score").alias("threshold"), "tp", "fp")
    origin = totals.select(
        *keys, F.lit(float("inf")).alias("threshold"), F.lit(0).cast("bigint").alias("tp"),
        F.lit(0).cast("bigint").alias("fp"),
    )
    return attach(points.unionByName(origin), totals, keys).select(
        *keys, "threshold",
        ratio(F.col("fp"), F.col("n_neg")).alias("fpr"), ratio(F.col("tp"), F.col("n_pos")).alias("tpr"),
    )


def roc_auc(obs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Tie-aware area alone, from counts per distinct score: scores are reduced before they are ordered."""
    ordered = order_rows(_score_counts(obs, keys), keys, [("score", False)])
    rows = running(ordered, sums={"below": F.col("neg")}).rows
    good = F.col("pos") * (F.col("below") - F.col("neg") / 2)
    return rows.groupBy(*keys).agg(
        F.sum(good).alias("_good"), F.sum("pos").alias("_p"), F.sum("neg").alias("_n")
    ).select(
        *keys,
        ratio(F.col("_good"), F.col("_p").cast("double") * F.col("_n")).alias("roc_auc"),
    )


def score_distribution(obs: DataFrame, width: float = 0.025, keys: Sequence[str] = ()) -> DataFrame:
    """Share of each score bin within its true / false group; the last bin includes 1."""
    bins = round(1 / width)
    index = F.least(F.floor(F.col("score") / F.lit(width)), F.lit(bins - 1)).cast("int")
    counts = (
        obs.where(F.col("score").between(F.lit(0.0), F.lit(1.0)))
        .withColumn("bin", index)
        .groupBy(*keys, "is_true", "bin").agg(F.count(F.lit(1)).alias("n"))
    )
    totals = counts.groupBy(*keys, "is_true").agg(F.sum("n").alias("_total"))
    return counts.join(totals, [*keys, "is_true"]).select(
        *keys, "is_true", "bin", "n", (F.col("n") / F.col("_total")).alias("probability")
    )


def quantile_edges(rows: DataFrame, keys: Sequence[str], n: int, tie: str = "row_id") -> DataFrame:
    """Edges of ``n`` score quantile bins per key: (keys, _edges, _size).

    Reads the few rows at the quantile ranks from the distributed order instead
    of holding all scores of a key in one task.
    """
    keys = list(keys)
    slim = rows.select(*keys, tie, "score")
    ranked = with_rank(order_rows(slim, keys, [("score", False), (tie, False)])).clean()
    sizes = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    at = F.explode(F.array(*[F.lit(i / n) for i in range(n + 1)])).alias("_q")
    spots = sizes.select(*keys, "_size", at).withColumn("_pos", F.col("_q") * (F.col("_size") - 1))
    value = ranked.select(*keys, "rank", "score")
    low = spots.withColumn("rank", F.floor("_pos") + 1).join(value, [*keys, "rank"]).drop("rank")
    both = low.withColumnRenamed("score", "_lo").withColumn("rank", F.ceil("_pos") + 1).join(
        value, [*keys, "rank"]
    )
    edge = F.col("_lo") + (F.col("score") - F.col("_lo")) * (F.col("_pos") - F.floor("_pos"))
    return both.groupBy(*keys).agg(
        F.array_sort(F.collect_set(edge)).alias("_edges"), F.max("_size").alias("_size")
    )


def binned_sample(
    rows: DataFrame, keys: Sequence[str], n: int = 5, seed: str = "sample", tie: str = "row_id",
) -> DataFrame:
    """One random row per score quantile bin and key; keys with fewer than ``n`` rows stay whole.

    Bin edges are exact quantiles, linear between ranks; equal edges merge.
    """
    from ..functions.draws import draw

    keys = list(keys)
    edges = quantile_edges(rows, keys, n, tie)
    bin_no = F.greatest(
        F.size(F.filter("_edges", lambda e: e < F.col("score"))), F.lit(1)
    )
    binned = attach(rows, edges, keys).withColumn("bin", bin_no)
    small = binned.where(F.col("_size") < n).withColumn("bin", F.lit(None).cast("int"))
    picked = binned.where(F.col("_size") >= n).withColumn("_draw", draw(seed, F.col(tie)))
    chosen = picked.groupBy(*keys, "bin").agg(
        F.min_by(F.struct(*[c for c in rows.columns if c not in keys]), F.struct("_draw", tie)).alias("_r")
    ).select(*keys, "_r.*", "bin")
    return chosen.unionByName(small.select(chosen.columns))


def random_rows(df: DataFrame, n: int, key: str, seed: str = "examples") -> DataFrame:
    """``n`` random rows by seeded draw (a sampling operator; top-n runs per partition first)."""
    from ..functions.draws import draw

    return df.withColumn("_draw", draw(seed, F.col(key))).orderBy("_draw", key).limit(n).drop("_draw")


__all__ = [
    "RANGE", "average_precision", "binned_sample", "curve_points", "pr_curve", "random_rows",
    "recall_at_precision", "roc_auc", "roc_curve", "score_distribution",
]
