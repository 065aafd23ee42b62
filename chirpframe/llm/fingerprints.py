"""I-Match fingerprints in DataFrame functions only.

Terms (lower-cased words) hash to 64 bits, and document frequencies are counted
per term. What lies outside the chosen band of inverse document frequency is taken
from a text: terms above it are few (at most the words of a text times N ** 0.25) and
become a constant; terms below it come with the documents that have them, as their
count keeps the smallest and the largest of these (beyond two, a join finds them); the
two words that an edit cuts are looked up in the stored frequencies. A text
keeps its distinct terms inside the band, sorted by their hash, and hashes
randomised subsets of the lexicon: for every replicate there is a chain of
subsets, each keeping a random half of the one before, and a text uses the last one
in which it has a term, so short and long texts hash subsets of a few terms. A
fingerprint is the hash of all kept terms and one hash per replicate; its
likeness to another is the share of places at which they agree.

Defined cases: null text is empty. A text without a term inside the band uses
all its terms; a text without words has an empty fingerprint, and two of those
are alike (1.0). Documents are ordered by descending id, null ids last, equal ids by a hash of
their text; rows that repeat id and text are one document and each get its
result. Of one document alone, the next is itself. An empty table gives an empty
result. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ordered import order_rows, with_previous
from .common import SPACES, stored, text_of

REPLICATES = 12
#: Band of ln(N / df) / ln(N): above 0.25 leaves out the commonest, below 0.95 the terms of one document.
BAND = (0.25, 0.95)
_LAST = -(1 << 63)


def term_hashes(text: Column) -> Column:
    """Distinct 64-bit hashes of the lower-cased words."""
    words = F.filter(F.split(F.lower(text), SPACES + "+"), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def frequencies(base: DataFrame) -> DataFrame:
    """Stored: term, df (rows), and the smallest and largest key of a document with the term."""
    rows = base.select(F.explode(term_hashes(F.col("text"))).alias("term"), key_of().alias("key"))
    return stored(rows.groupBy("term").agg(
        F.count(F.lit(1)).alias("df"), F.min("key").alias("low"), F.max("key").alias("high")), "frequencies")


def key_of(id: str = "id", tie: str = "tie") -> Column:
    return F.xxhash64(id, tie)


def limits(n: int, band: tuple[float, float] = BAND) -> tuple[float, float]:
    """Smallest and largest document frequency inside the band, of ``n`` documents."""
    n = max(2, n)
    return n ** (1 - band[1]), n ** (1 - band[0])


def rare_terms(base: DataFrame, counts: DataFrame, low: float) -> DataFrame:
    """(key, rare): per document its terms of a frequency under ``low``."""
    few = counts.where(F.col("df") < low)
    if math.ceil(low) - 1 <= 2:
        rows = few.select("term", F.explode(F.array_distinct(F.array("low", "high"))).alias("key"))
    else:
        rows = base.select(F.explode(term_hashes(F.col("text"))).alias("term"), key_of().alias("key")).join(
            few.select("term"), "term").distinct()
    return rows.groupBy("key").agg(F.collect_list("term").alias("rare"))


def common_terms(counts: DataFrame, high: float) -> list[int]:
    return [r["term"] for r in counts.where(F.col("df") > high).select("term").collect()]


def subset_hashes(rows: DataFrame, text: str, common: list[int], outside: Column, name: str) -> DataFrame:
    """Add ``name``: hash of all kept terms, then one per replicate (null: no term).

    Kept are the terms that are neither in ``common`` nor in the row's array ``outside``.
    """

    def drawn(replicate: int):
        """A term's uniform 63-bit draw: it is in the k-th subset of the chain if its first k bits are 0."""
        return lambda h: F.xxhash64(h, F.lit(replicate)).bitwiseAND(F.lit((1 << 63) - 1))

    def top(draws: str) -> Column:
        """Largest draw with as many leading zeros as the smallest one."""
        digits = F.length(F.bin(F.array_min(draws)))
        return F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), 64 - digits)

    def sparsest(replicate: int) -> Column:
        """Hash of the last subset of the chain that has a term."""
        bound = F.col(f"_t{replicate}")  # named twice below, else the plan moves its formula into the lambda
        return F.hash(F.sort_array(F.filter(f"_d{replicate}", lambda v: (v <= bound) & bound.isNotNull())))

    out = rows.withColumn("_all", term_hashes(F.col(text)))
    out = out.withColumn("_kept", F.array_except("_all", outside))
    if common:  # a constant set, looked up by hash
        out = out.withColumn("_kept", F.expr(f"filter(_kept, h -> h not in ({', '.join(f'{h}L' for h in common)}))"))
    out = out.withColumn("_terms", F.sort_array(F.when(F.size("_kept") > 0, F.col("_kept")).otherwise(F.col("_all"))))
    out = out.drop("_all", "_kept")
    numbers = range(1, REPLICATES + 1)
    out = out.withColumns({f"_d{j}": F.transform("_terms", drawn(j)) for j in numbers})
    # bounds are columns of their own: inside the lambda they would be found anew for every term
    out = out.withColumns({f"_t{j}": top(f"_d{j}") for j in numbers})
    some = F.size("_terms") > 0
    hashes = [F.hash("_terms"), *[sparsest(j) for j in numbers]]
    out = out.withColumn(name, F.array(*[F.when(some, h) for h in hashes]))
    return out.drop("_terms", *[f"_{c}{j}" for c in "dt" for j in numbers])


def likeness(one: str, two: str) -> Column:
    """Share of places with equal hashes; two empty fingerprints are alike (1.0)."""
    same = F.zip_with(one, two, lambda x, y: x.eqNullSafe(y).cast("int"))
    return F.aggregate(same, F.lit(0), lambda a, e: a + e).cast("double") / F.size(same)


def printed(hashes: str) -> Column:
    """The fingerprint as text: eight hex digits per subset, ``-`` for an empty one."""
    word = lambda x: F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")
    return F.array_join(F.transform(hashes, lambda x: F.coalesce(word(x), F.lit("-"))), ".")


def with_next(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents as id, tie, text; ids with the id and tie of the next document)."""
    text = text_of("text")
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("id"), F.xxhash64(text).alias("tie"),
                       text.alias("text"))
    ids = base.select("id", "tie", F.floor(F.length("text") / 3).cast("int").alias("third")).distinct()
    ids = ids.withColumn("me", F.struct("id", "tie"))
    ordered = order_rows(ids, [], [("id", False), ("tie", False)])
    first = ordered.rows.agg(F.max("me").alias("m")).first()["m"]
    following = with_previous(ordered, "next", "me").clean()
    if first is not None:
        top = F.struct(F.lit(first["id"]).cast("long").alias("id"), F.lit(first["tie"]).cast("long").alias("tie"))
        following = following.withColumn("next", F.coalesce("next", top))
    return base, stored(following.select(
        "id", "tie", "third", F.col("next.id").alias("next_id"), F.col("next.tie").alias("next_tie")), "next")


def cut_terms(base: DataFrame, heads: DataFrame, counts: DataFrame, low: float) -> DataFrame:
    """(key, cut): the words at both ends of the inserted head (all others are of one text), if their frequency is under ``low``."""
    length = F.length("text")
    ends = base.select("id", "tie", F.element_at(F.split(
        F.substr("text", F.lit(1), (length - F.floor(length / 3)).cast("int")), SPACES), -1).alias("left"))
    pieces = F.split("head", SPACES)
    heads = heads.select("id", "tie", F.element_at(pieces, 1).alias("right"), F.element_at(pieces, -1).alias("last"))
    both = ends.dropDuplicates(["id", "tie"]).join(heads, ["id", "tie"])
    words = F.array(F.concat("left", "right"), F.col("last"))
    rows = both.select(key_of().alias("key"), F.explode(F.transform(words, lambda w: F.xxhash64(F.lower(w)))).alias("term"))
    unknown = rows.join(counts.where(F.col("df") >= low).select("term"), "term", "left_anti")
    return unknown.groupBy("key").agg(F.collect_list("term").alias("cut"))


def compared(docs: DataFrame) -> DataFrame:
    """Per row: fingerprints of the text and of its edited form, and their likenesses."""
    base, following = with_next(docs)
    counts = frequencies(base)
    low, high = limits(base.count())
    common = common_terms(counts, high)
    there = following.select(
        F.col("id").alias("to_id"), F.col("tie").alias("to_tie"), "third",
        F.col("next_id").alias("id"), F.col("next_tie").alias("tie"))
    heads = stored(there.join(base, ["id", "tie"]).select(
        F.col("to_id").alias("id"), F.col("to_tie").alias("tie"), "third",
        F.substr("text", F.lit(1), F.col("third")).alias("head")
    ).dropDuplicates(["id", "tie"]), "heads")
    nothing = F.array().cast("array<bigint>")
    rare = stored(rare_terms(base, counts, low), "rare")
    sides = following.select("id", "tie", key_of().alias("key"), key_of("next_id", "next_tie").alias("next_key"))
    sides = sides.join(rare, "key", "left").join(
        rare.select(F.col("key").alias("next_key"), F.col("rare").alias("next_rare")), "next_key", "left").join(
        cut_terms(base, heads, counts, low), "key", "left")
    sides = sides.select("id", "tie", *[F.coalesce(c, nothing).alias(c) for c in ("rare", "next_rare", "cut")])
    edited = base.join(heads, ["id", "tie"]).withColumn("n_chars", F.length("text").cast("long"))
    edited = edited.withColumn(
        "edited", F.concat(F.substr("text", F.lit(1), (F.col("n_chars") - F.col("third")).cast("int")), F.col("head")))
    edited = edited.drop("head").join(sides, ["id", "tie"])
    prints = subset_hashes(edited, "text", common, F.col("rare"), "prints")
    prints = subset_hashes(prints, "edited", common, F.concat("rare", "next_rare", "cut"), "edited_prints")
    done = stored(prints.select(
        "id", "tie", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "prints", "edited_prints"
    ), "prints")
    others = done.select(F.col("id").alias("next_id"), F.col("tie").alias("next_tie"), F.col("prints").alias("next_prints"))
    named = following.select("id", "tie", "next_id", "next_tie").join(
        others.dropDuplicates(["next_id", "next_tie"]), ["next_id", "next_tie"])
    return done.join(named.drop("next_id", "next_tie"), ["id", "tie"]).select(
        F.nullif("id", F.lit(_LAST)).alias("doc_id"), "n_chars", "edited_sha256", printed("prints").alias("fingerprint"),
        printed("edited_prints").alias("edited_fingerprint"), likeness("prints", "edited_prints").alias("near_edited"),
        likeness("prints", "next_prints").alias("near_next"),
    )
