"""Class-score arrays: argmax, sorting, thresholds, decoding to tags."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .conditions import Tag, tag_struct

TAG_TYPE = "array<struct<key:string,value:string>>"


def top_index(scores: Column) -> Column:
    """0-based position of the highest score; the lowest index wins ties."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def top_score(scores: Column) -> Column:
    return F.array_max(scores)


def class_at(class_names: Sequence[str], index: Column) -> Column:
    """Class name at a 0-based index; null outside the list."""
    return F.get(F.array(*[F.lit(c) for c in class_names]), index)


def class_index(class_names: Sequence[str], name: Column) -> Column:
    """0-based index of a class name, -1 when it is not in the list."""
    found = F.array_position(F.array(*[F.lit(c) for c in class_names]), name)
    return (F.coalesce(found, F.lit(0)) - 1).cast("int")


def ranked_scores(scores: Column, class_names: Sequence[str], sort: bool = True) -> Column:
    """Array of (class_name, score), highest first, class order on ties."""
    names = F.array(*[F.lit(c) for c in class_names])
    zipped = F.transform(
        scores,
        lambda s, i: F.struct(
            (-s).alias("neg"), i.alias("idx"), F.get(names, i).alias("class_name"), s.alias("score")
        ),
    )
    ordered = F.array_sort(zipped) if sort else zipped
    return F.transform(ordered, lambda x: F.struct(x["class_name"], x["score"]))


def first_scores(scores: Column, n: int) -> Column:
    """Drop trailing background scores, keeping the first ``n``."""
    return F.slice(scores, 1, n)


def tag_map(decoding: Mapping[str, Sequence[Tag]]) -> Column:
    """Class name → tags, as a literal map (its size is the class list)."""
    parts: list[Column] = []
    for name, tags in decoding.items():
        body = F.array(*[tag_struct(k, v) for k, v in tags]) if tags else F.array()
        parts += [F.lit(name), body.cast(TAG_TYPE)]
    return F.create_map(*parts)


def decode_class(name: Column, decoding: Mapping[str, Sequence[Tag]], raise_on_unknown: bool = False) -> Column:
    tags = F.element_at(tag_map(decoding), name)
    if raise_on_unknown:
        return F.coalesce(tags, F.raise_error(F.concat(F.lit("no class is called "), F.coalesce(name, F.lit("null")))).cast(TAG_TYPE))
    return F.coalesce(tags, F.array().cast(TAG_TYPE))


def _scored(tags: Column, score: Column) -> Column:
    return F.transform(
        tags,
        lambda t: F.struct(
            t["key"].alias("key"), t["value"].alias("value"), score.cast("double").alias("score")
        ),
    )


def class_tags(
    scores: Column,
    class_names: Sequence[str],
    decoding: Mapping[str, Sequence[Tag]],
    threshold: float | None = 0.1,
    top_class_only: bool = False,
    top_k: int | None = None,
) -> Column:
    """Predicted tags in falling score order, below-threshold classes dropped.

    ``top_k`` cuts before the threshold, ``top_class_only`` after it.
    """
    ranked = ranked_scores(scores, class_names)
    if top_k is not None:
        ranked = F.slice(ranked, 1, top_k)
    if threshold is not None:
        ranked = F.filter(ranked, lambda x: x["score"] >= F.lit(float(threshold)))
    if top_class_only:
        ranked = F.slice(ranked, 1, 1)
    lookup = tag_map(decoding)
    empty = F.array().cast(TAG_TYPE)
    return F.flatten(
        F.transform(
            ranked,
            lambda x: _scored(F.coalesce(F.element_at(lookup, x["class_name"]), empty), x["score"]),
        )
    )


def detection_tags(tags: Sequence[Tag], score: Column) -> Column:
    """Tags of the generic detection class, all with the detection score."""
    base = F.array(*[tag_struct(k, v) for k, v in tags]) if tags else F.array().cast(TAG_TYPE)
    return _scored(base, score)


def named_features(features: Column, prefix: str = "f") -> Column:
    return F.transform(
        features,
        lambda x, i: F.struct(
            F.concat(F.lit(prefix), i.cast("string")).alias("name"), x.cast("double").alias("value")
        ),
    )


def rebuild_scores(top_class: Column, top: Column, class_names: Sequence[str]) -> Column:
    """Score array that is zero but for the stored top class."""
    return F.transform(
        F.array(*[F.lit(c) for c in class_names]),
        lambda c: F.when(c == top_class, top).otherwise(F.lit(0.0)),
    )
