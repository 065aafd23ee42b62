"""Mix sources to target weights: iterative proportional fitting, then sampling.

Documents fall into cells (source, language, topic) with token totals. Raking
scales the cells' weights so that weighted tokens meet the target share of every
source, language and topic in turn, again and again; after each round weights are
cut to ``LIMIT`` (weights average 1), so that a rare cell cannot dictate how little
the others keep. A document is kept with probability weight / LIMIT: about
1 / LIMIT of the tokens stay, with the target shares in expectation as far as
the limit allows. Cells are aggregated inside the scan's tasks first; the
loop then works on cells only, and the rows meet their cell's weight again by a
join that broadcasts cells after counting them.

Defined cases: null source or language is the category ``(none)``; null or
empty text has 0 tokens and topic ``empty``. Documents are drawn by a hash of id
and seed, so repeated rows are kept or dropped together and a null id draws like
an id of its own. Targets that no document has are left out and the rest scaled
to 1; categories without a target get weight 0. Where targets contradict each
other over the cells that exist, the loop ends after ``rounds`` with the last
weights. An empty table gives an empty result. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import draw
from .common import WORD, join_checked, stored, text_of

DIMS = ("source", "lang", "topic")
ROUNDS = 12
LIMIT = 1.5
TEMPERATURE = 0.8


def topic_of(text: Column, tokens: Column) -> Column:
    """Coarse form of a text, from its own characters: empty, table, symbols, short, medium or long."""
    bars = F.length(text) - F.length(F.translate(text, "|", ""))
    marks = F.length(text) - F.length(F.translate(text, "#$%&*!", ""))
    return (
        F.when(tokens == 0, "empty").when(bars * 5 >= tokens, "table").when(marks >= tokens, "symbols")
        .when(tokens < 150, "short").when(tokens < 600, "medium").otherwise("long")
    )


def attributes(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """doc_id, source, lang, topic, tokens (words) and a uniform draw per document."""
    text = text_of("text")
    base = docs.select(
        "doc_id", *[F.coalesce(F.col(c).cast("string"), F.lit("(none)")).alias(c) for c in ("source", "lang")],
        text.alias("text"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("tokens"),
    )
    return base.select(
        "doc_id", "source", "lang", topic_of(F.col("text"), F.col("tokens")).alias("topic"), "tokens",
        draw(seed, F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias("draw"),
    )


def shares(cells: DataFrame, dim: str, targets: Mapping[str, float] | None, temperature: float) -> Column:
    """Target share of the row's category: given, or its own share to the power ``temperature``; adds to 1."""
    own = F.sum("tokens").over(Window.partitionBy(dim))
    if targets is None:
        return F.pow(own.cast("double"), F.lit(float(temperature)))
    given = F.create_map(*[F.lit(x) for pair in targets.items() for x in pair])
    return F.coalesce(F.element_at(given, F.col(dim)), F.lit(0.0)).cast("double")


def rake(
    cells: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, temperature: float = TEMPERATURE,
    rounds: int = ROUNDS, limit: float = LIMIT,
) -> DataFrame:
    """``weight`` (0 to ``limit``) per cell (source, lang, topic, tokens); cells without tokens have weight 1."""
    targets = targets or {}
    raw = cells.withColumn("_w", F.lit(1.0))
    for dim in DIMS:
        raw = raw.withColumn(f"_t_{dim}", shares(cells, dim, targets.get(dim), temperature))
        # each category counts once in the total of the targets
        first = F.row_number().over(Window.partitionBy(dim).orderBy(*DIMS)) == 1
        raw = raw.withColumn(f"_f_{dim}", F.when(first, F.col(f"_t_{dim}")).otherwise(F.lit(0.0)))
    sums = raw.agg(F.sum("tokens").alias("all"), *[F.sum(f"_f_{d}").alias(d) for d in DIMS]).first()
    state = raw
    for dim in DIMS:
        scale = float(sums["all"] or 0) / float(sums[dim] or 1)
        state = state.withColumn(f"_t_{dim}", F.col(f"_t_{dim}") * F.lit(scale)).drop(f"_f_{dim}")
    for done in range(rounds):
        for dim in DIMS:
            have = F.sum(F.col("_w") * F.col("tokens")).over(Window.partitionBy(dim))
            state = state.withColumn("_w", F.when(have > 0, F.col("_w") * F.col(f"_t_{dim}") / have).otherwise(F.col("_w")))
        state = state.withColumn("_w", F.least("_w", F.lit(float(limit))))
        if done % 4 == 3:
            state = stored(state, "raked")
    return state.withColumnRenamed("_w", "weight").drop(*[f"_t_{d}" for d in DIMS])


def mixed(
    docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, temperature: float = TEMPERATURE,
    limit: float = LIMIT, seed: str = "mix",
) -> DataFrame:
    """Per document: its cell, tokens, weight, probability and whether it is sampled."""
    rows = stored(attributes(docs, seed), "attributes")
    cells = stored(rows.groupBy(*DIMS).agg(F.sum("tokens").alias("tokens")), "cells")
    weights = stored(rake(cells, targets, temperature, limit=limit), "weights")
    by_cell = weights.select(*DIMS, "weight", (F.col("weight") / F.lit(float(limit))).alias("probability"))
    joined = join_checked(rows, by_cell, list(DIMS), "inner")
    return joined.select(
        "doc_id", *DIMS, "tokens", "weight", "probability", (F.col("draw") < F.col("probability")).alias("sampled")
    )


def sample(docs: DataFrame, **options) -> DataFrame:
    """The sampled rows of ``docs``, columns unchanged.

    A cell and an id decide, so rows of one id and cell go or stay together; rows of one id in other cells on their own.
    """
    rows = mixed(docs, **options).select("doc_id", _cell(*DIMS).alias("cell"), F.col("sampled").alias("kept"))
    by_cell = stored(rows.groupBy("doc_id", "cell").agg(F.max("kept").alias("kept")), "mix")
    gone = by_cell.groupBy("doc_id").agg(
        F.sum(F.col("kept").cast("long")).alias("_kept"), F.count(F.lit(1)).alias("_all")).where("_kept < _all")
    gone = stored(gone.select(F.col("doc_id").alias("_id"), "_kept"), "dropped")
    same = docs["doc_id"].eqNullSafe(F.col("_id"))
    rest = join_checked(docs, gone.select("_id"), same, "left_anti")
    split = gone.where("_kept > 0").select("_id")
    if split.isEmpty():
        return rest
    text = text_of("text")
    tokens = F.regexp_count(text, F.lit(WORD)).cast("long")
    source, lang = (F.coalesce(F.col(c).cast("string"), F.lit("(none)")) for c in ("source", "lang"))
    ours = join_checked(docs, split, same, "left_semi").withColumn("_cell", _cell(source, lang, topic_of(text, tokens)))
    good = by_cell.where("kept").select(F.col("doc_id").alias("_id"), F.col("cell").alias("_c"))
    both = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_cell") == F.col("_c"))
    return rest.unionByName(join_checked(ours, good, both, "left_semi").drop("_cell"))


def _cell(*parts: Column | str) -> Column:
    return F.to_json(F.struct(*[(F.col(p) if isinstance(p, str) else p).alias(d) for p, d in zip(parts, DIMS)]))
