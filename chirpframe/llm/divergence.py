"""How far the sources of a language use its vocabulary differently, on run-length columns.

The vocabulary of a language is the terms that enough of its documents have. A
source's share of a term is ``p = 1 + floor(10^9 (count + 1) / (N + V))``, and the
divergence of p from q is ``floor((p - q)^2 / q)``, summed over the vocabulary for
a pair of sources, or by term against the whole language. All of it is integer
arithmetic (decimals where a long could overflow), so results are exact.

1. **Counts.** Tasks count the terms of their documents, per language and source, in
   bounded tables; one shuffle by (language, term) gives each kept term its vector of
   counts over the sources.
2. **Run-length columns.** Terms with equal vectors become one run; the vocabulary is
   reordered by vector, so runs of a source's equal counts lie together. The order
   is cut into blocks, and in each block a source is one column: the
   starts of its runs and their p. Sources that lack all terms of a block have one run.
3. **Pairs.** Per block, the run borders of two sources are intersected, f is
   taken once per common run and multiplied by its length. Sums over blocks are the
   result; a block holds at most ``BLOCK`` runs of each source of one language.

A sum fits a long: ``sum (p - 1) <= 10^9`` for every source, so ``sum |p - q| <= 2 * 10^9``
and ``sum f <= 10^9 * 2 * 10^9``.

Defined cases: null text, lang and source are ''. A language whose vocabulary is
empty has pairs of value 0 and no terms; a group without terms takes part
with counts of 0. Very long texts are counted in slices. Repeated rows are documents each.
Null ids do not matter (ids are not read). An empty table gives an empty result. Only
``text``, ``lang`` and ``source`` are read, so further columns cannot clash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ordered import RANGE, order_rows
from .common import join_checked, stored

SCALE = 1_000_000_000
SLICE = 1 << 20
#: Distinct (group, term) entries a task holds before it hands them on.
HELD = 150_000
BLOCK = 16_384
#: A byte is a letter (A-Z in lower case), part of a longer character, or a border.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def terms(raw: bytes, limit: int = SLICE) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, in slices cut at borders."""
    marked = raw.translate(_LETTERS)
    at = 0
    while at < len(marked):
        end = marked.find(b" ", at + limit)
        end = len(marked) if end < 0 else end
        yield marked[at:end].split()
        at = end


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, c, df) of parts of the documents; sums over equal keys are the counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (uses, docs_with) in held.items():
                names = list(uses)
                for a in range(0, len(names), 20_000):
                    part = names[a:a + 20_000]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([lang] * len(part), pa.string()), pa.array([source] * len(part), pa.string()),
                        pa.array(part, pa.binary()), pa.array([uses[t] for t in part], pa.int64()),
                        pa.array([docs_with[t] for t in part], pa.int64()),
                    ], names=["lang", "source", "term", "c", "df"])
            held.clear()

        for batch in batches:
            for lang, source, text in zip(*(column.to_pylist() for column in batch.columns)):
                uses, docs_with = held.setdefault((lang, source), (Counter(), Counter()))
                seen: set[bytes] = set()
                for found in terms(text):
                    uses.update(found)
                    seen.update(found)
                docs_with.update(seen)
                if sum(len(u) for u, _ in held.values()) > HELD:
                    yield from flush()
        yield from flush()

    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(blank("lang").alias("lang"), blank("source").alias("source"), blank("text").cast("binary").alias("text"))
    return rows.mapInArrow(count, "lang string, source string, term binary, c long, df long")


def vocabulary(docs: DataFrame, least_docs: int = 3) -> DataFrame:
    """Stored: lang, term, counts (source and count, by source) of every kept term."""
    rows = counted(docs).repartition("lang", "term")  # both groupings below keep this partitioning
    by_source = rows.groupBy("lang", "term", "source").agg(F.sum("c").alias("c"), F.sum("df").alias("df"))
    by_term = by_source.groupBy("lang", "term").agg(
        F.sum("df").alias("df"), F.array_sort(F.collect_list(F.struct("source", "c"))).alias("counts"))
    return stored(by_term.where(F.col("df") >= least_docs).select("lang", "term", "counts"), "vocabulary")


def group_totals(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Stored: lang, source, n (uses of kept terms), v (kept terms of the language), lang_n."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    groups = docs.select(blank("lang"), blank("source")).distinct()
    uses = kept.select("lang", F.explode("counts").alias("e")).groupBy("lang", F.col("e.source").alias("source")).agg(
        F.sum("e.c").alias("n"))
    size = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    totals = groups.join(uses, ["lang", "source"], "left").join(size, "lang", "left").fillna(0, ["n", "v"])
    whole = totals.groupBy("lang").agg(F.sum("n").alias("lang_n"))
    return stored(totals.join(whole, "lang"), "groups")


def share(count: Column, uses: Column, size: Column) -> Column:
    """``1 + floor(10^9 (count + 1) / (uses + size))``."""
    wide = F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)")
    return F.call_function("div", wide, (uses + size).cast("decimal(20,0)")) + F.lit(1)


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def ranked(rows: DataFrame, most: int | None = None) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    out = rows.withColumn("rank", F.row_number().over(order).cast("int"))
    return out.where(F.col("rank") <= most) if most else out


def term_part(kept: DataFrame, totals: DataFrame, most: int = 200) -> DataFrame:
    """Terms that a source uses more than its language, by divergence."""
    all_uses = F.aggregate("counts", F.lit(0).cast("long"), lambda a, e: a + e["c"])
    rows = kept.select("lang", "term", all_uses.alias("all"), F.explode("counts").alias("e"))
    rows = rows.select("lang", "term", "all", F.col("e.source").alias("source"), F.col("e.c").alias("c"))
    rows = join_checked(rows, totals, ["lang", "source"], "inner")
    rows = rows.select(
        "lang", "source", F.col("term").alias("item"), share(F.col("c"), F.col("n"), F.col("v")).alias("p"),
        share(F.col("all"), F.col("lang_n"), F.col("v")).alias("q"))
    rows = rows.where("p > q").select("lang", "source", "item", divergence(F.col("p"), F.col("q")).alias("value"))
    return ranked(rows, most).withColumn("item", F.col("item").cast("string"))


def runs(starts: np.ndarray, lengths: np.ndarray, values: np.ndarray, rest: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(run starts, run values) over [0, width): the given runs, ``rest`` elsewhere, equal neighbours joined."""
    ends = starts + lengths
    after = np.append(starts[1:], width)
    at = np.concatenate([[0], np.stack([starts, ends], axis=1).ravel()])
    value = np.concatenate([[rest], np.stack([values, np.full(len(values), rest, np.int64)], axis=1).ravel()])
    filled = np.concatenate([[len(starts) == 0 or starts[0] > 0], np.stack([lengths > 0, ends < after], axis=1).ravel()])
    at, value = at[filled], value[filled]
    new = np.concatenate([[True], value[1:] != value[:-1]])
    return at[new], value[new]


def intersect(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray], width: int) -> tuple[int, int]:
    """Sums of f over the common runs of two columns: of the first from the second, and the other way."""
    cuts = np.union1d(one[0], two[0])
    p = one[1][np.searchsorted(one[0], cuts, "right") - 1]
    q = two[1][np.searchsorted(two[0], cuts, "right") - 1]
    length = np.diff(np.append(cuts, width))
    square = (p - q) * (p - q)
    return int((square // q * length).sum()), int((square // p * length).sum())


def columns(kept: DataFrame, totals: DataFrame) -> DataFrame:
    """Run-length columns: lang, block, width, source, rest (p of count 0), and runs (start, length, p)."""
    vectors = kept.groupBy("lang", "counts").agg(F.count(F.lit(1)).alias("length"))
    vectors = stored(vectors, "vectors")
    ranges = int(kept.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(ranges, vectors.count() // (4 * BLOCK) + 1)
    ordered = order_rows(vectors, [], [("lang", False), ("counts", False)], ranges).rows
    inside = Window.partitionBy("lang", RANGE).orderBy("counts")
    rows = ordered.withColumn("part", F.floor((F.row_number().over(inside) - 1) / F.lit(BLOCK)).cast("int"))
    block = Window.partitionBy("lang", RANGE, "part").orderBy("counts").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum("length").over(block)).select(
        "lang", F.struct(RANGE, "part").alias("block"), (F.col("end") - F.col("length")).alias("start"), "length", "counts")
    rows = stored(rows, "ordered")
    blocks = rows.groupBy("lang", "block").agg(F.sum("length").alias("width"))
    entries = rows.select("lang", "block", "start", "length", F.explode("counts").alias("e")).select(
        "lang", "block", F.col("e.source").alias("source"), "start", "length", F.col("e.c").alias("c"))
    entries = join_checked(entries, totals.select("lang", "source", "n", "v"), ["lang", "source"], "inner")
    run = F.struct("start", "length", share(F.col("c"), F.col("n"), F.col("v")).alias("p"))
    filled = entries.groupBy("lang", "block", "source").agg(F.array_sort(F.collect_list(run)).alias("runs"))
    every = blocks.join(totals, "lang").select(
        "lang", "block", "width", "source", share(F.lit(0), F.col("n"), F.col("v")).alias("rest"))
    return every.join(filled, ["lang", "block", "source"], "left")


def pair_part(kept: DataFrame, totals: DataFrame) -> DataFrame:
    """Every ordered pair of sources of a language with the divergence of the first from the second."""

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        width, out = int(frame["width"].iloc[0]), []
        names, ready = frame["source"].tolist(), []
        for found, rest in zip(frame["runs"], frame["rest"].tolist()):
            numbers = [] if found is None else [(r["start"], r["length"], r["p"]) for r in found]
            start, length, p = np.array(numbers, np.int64).reshape(-1, 3).T
            ready.append(runs(start, length, p, rest, width))
        for i in range(len(names)):
            for j in range(i):
                forth, back = intersect(ready[i], ready[j], width)
                out += [(names[i], names[j], forth), (names[j], names[i], back)]
        result = pd.DataFrame(out, columns=["source", "item", "value"])
        result.insert(0, "lang", frame["lang"].iloc[0])
        return result

    sums = columns(kept, totals).groupBy("lang", "block").applyInPandas(
        compare, "lang string, source string, item string, value long")
    sums = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    names = totals.select("lang", "source")
    pairs = names.join(names.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    return ranked(pairs.join(sums, ["lang", "source", "item"], "left").fillna(0, ["value"]))


def audited(docs: DataFrame, least_docs: int = 3, most: int = 200) -> DataFrame:
    """Rows of both parts: lang, source, part, item, value, rank."""
    kept = vocabulary(docs, least_docs)
    totals = group_totals(docs, kept)
    out = ["lang", "source", "part", "item", "value", "rank"]
    pairs = pair_part(kept, totals).withColumn("part", F.lit("pair")).select(*out)
    return pairs.union(term_part(kept, totals, most).withColumn("part", F.lit("term")).select(*out))
