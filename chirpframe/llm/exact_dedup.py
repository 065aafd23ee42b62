"""Exact duplicates through a cuckoo-filter index of live digests.

Texts are equal when they are the same after deleting every character of
``[\\x20\\x09-\\x0D]``. Each row becomes a SHA-256 digest of its normalised text.
Tasks stream digests through a ``DigestIndex``: a cuckoo filter answers "never
seen" at once; a hit is verified against the bucket of full digests; a filter
that overflows is rebuilt at twice the size from the stored digests. The first
pass runs inside the scan's tasks, so a digest that fills a third of the table
leaves every task as one row; the second pass runs on digests dealt by hash.

Defined cases: null text is an empty text; empty texts are one group. A null
``doc_id`` sorts after all others. Rows that repeat an id count one by one, and
exactly one row per group is kept. An empty table gives an empty result. Only
``doc_id`` and ``text`` are read, so other columns may have any name.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SALTS, SPACES, join_checked, keep_decided, numbered, stored, text_of

SLOTS = 4
KICKS = 200
_NO_ID = (1 << 63) - 1
_PARTIAL = "digest binary, cp long, doc_id long, row long, n long, salts long"


class CuckooFilter:
    """Set of 16-bit fingerprints in two candidate buckets per key; 0 marks a free slot."""

    def __init__(self, buckets: int = 1024):
        self.mask = buckets - 1
        self.cells = array("H", bytes(2 * SLOTS * buckets))

    def _places(self, key: int) -> tuple[int, int, int]:
        mark = (key >> 48) or 1
        one = key & self.mask
        return mark, one, one ^ (mark * 0x5BD1E995 & self.mask)

    def __contains__(self, key: int) -> bool:
        mark, one, two = self._places(key)
        cells = self.cells
        return mark in cells[one * SLOTS:one * SLOTS + SLOTS] or mark in cells[two * SLOTS:two * SLOTS + SLOTS]

    def _put(self, mark: int, bucket: int) -> bool:
        for cell in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
            if not self.cells[cell]:
                self.cells[cell] = mark
                return True
        return False

    def insert(self, key: int) -> bool:
        """False if no slot could be freed: the filter is full and must be rebuilt."""
        mark, one, two = self._places(key)
        if self._put(mark, one) or self._put(mark, two):
            return True
        bucket = two
        for kick in range(KICKS):
            cell = bucket * SLOTS + (mark + kick) % SLOTS
            mark, self.cells[cell] = self.cells[cell], mark
            bucket ^= mark * 0x5BD1E995 & self.mask
            if self._put(mark, bucket):
                return True
        return False

    def delete(self, key: int) -> None:
        mark, one, two = self._places(key)
        for bucket in (one, two):
            for cell in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.cells[cell] == mark:
                    self.cells[cell] = 0
                    return


class DigestIndex:
    """Live digests of one task: filter in front, full digests in buckets behind.

    An entry is [digest, code points, doc_id, row, count, salts]; the best row
    has the most code points, then the smallest id, then the smallest row.
    """

    def __init__(self):
        self.filter = CuckooFilter()
        self.content: list[list] = [[] for _ in range(1024)]
        self.size = 0

    @staticmethod
    def key(digest: bytes) -> int:
        return int.from_bytes(digest[:8], "little")

    def find(self, digest: bytes):
        key = self.key(digest)
        if key in self.filter:
            for entry in self.content[key & len(self.content) - 1]:
                if entry[0] == digest:
                    return entry
        return None

    def add(self, digest: bytes, cp: int, doc_id: int, row: int, n: int, salts: int) -> None:
        entry = self.find(digest)
        if entry is None:
            key = self.key(digest)
            self.content[key & len(self.content) - 1].append([digest, cp, doc_id, row, n, salts])
            self.size += 1
            if not self.filter.insert(key):
                self.grow()
            return
        if (-cp, doc_id, row) < (-entry[1], entry[2], entry[3]):
            entry[1:4] = cp, doc_id, row
        entry[4] += n
        entry[5] |= salts

    def remove(self, digest: bytes, n: int) -> None:
        """Take ``n`` rows of a digest out; a digest without rows leaves filter and bucket."""
        entry = self.find(digest)
        if entry is not None:
            entry[4] -= n
            if entry[4] <= 0:
                key = self.key(digest)
                self.content[key & len(self.content) - 1].remove(entry)
                self.filter.delete(key)
                self.size -= 1

    def grow(self) -> None:
        """Rebuild with twice the buckets from the stored digests, until all fit."""
        entries = list(self.entries())
        buckets = len(self.content)
        fits = False
        while not fits:
            buckets *= 2
            self.filter = CuckooFilter(buckets)
            fits = all(self.filter.insert(self.key(e[0])) for e in entries)
        self.content = [[] for _ in range(buckets)]
        for entry in entries:
            self.content[self.key(entry[0]) & buckets - 1].append(entry)

    def entries(self) -> Iterator[list]:
        for bucket in self.content:
            yield from bucket


def _collapse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (or partial groups) to one row per digest of this task; negative n removes."""
    index = DigestIndex()
    for batch in batches:
        for digest, cp, doc_id, row, n, salts in zip(*(batch[c].tolist() for c in batch.columns)):
            if n >= 0:
                index.add(digest, cp, doc_id, row, n, salts)
            else:
                index.remove(digest, -n)
    names = ["digest", "cp", "doc_id", "row", "n", "salts"]
    run: list[list] = []
    for entry in index.entries():
        run.append(entry)
        if len(run) == 20_000:
            yield pd.DataFrame(run, columns=names)
            run = []
    if run:
        yield pd.DataFrame(run, columns=names)


def digest_of(text: Column) -> Column:
    """SHA-256 (binary) of the text without ASCII white space."""
    return F.unhex(F.sha2(F.regexp_replace(text_of(text), SPACES + "+", "").cast("binary"), 256))


def digest_rows(docs: DataFrame) -> DataFrame:
    """(row, doc_id, digest, cp), stored."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), digest_of(F.col("text")).alias("digest"),
        F.length(text_of("text")).cast("long").alias("cp"),
    )
    return stored(numbered(rows), "digests")


def build_index(rows: DataFrame) -> DataFrame:
    """One row per live digest: best cp, doc_id and row, number of rows, salts they have."""
    salt = F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")
    marked = rows.select(
        "digest", "cp", F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc_id"), "row",
        F.lit(1).cast("long").alias("n"), F.call_function("shiftleft", F.lit(1).cast("long"), salt).alias("salts"),
    )
    local = marked.mapInPandas(_collapse, _PARTIAL)
    return local.repartition("digest").mapInPandas(_collapse, _PARTIAL)


def update_index(
    index: DataFrame, added: DataFrame | None = None, removed: DataFrame | None = None, remaining: DataFrame | None = None
) -> DataFrame:
    """The index after adding and removing rows (as from ``digest_rows``).

    Additions come before removals; removing an unknown digest does nothing. Where the best row of a group
    goes, its entry is made anew from ``remaining``, the rows that are left, which removals need.
    """
    changes = index
    if added is not None:
        changes = changes.unionByName(build_index(added))
    if removed is None:
        return changes.repartition("digest").mapInPandas(_collapse, _PARTIAL)
    if remaining is None:
        raise ValueError("Removals need the rows that remain.")
    gone = removed.groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    zero = F.lit(0).cast("long")
    changes = changes.unionByName(gone.select(
        "digest", zero.alias("cp"), zero.alias("doc_id"), zero.alias("row"), (-F.col("n")).alias("n"), zero.alias("salts")
    ))
    kept = stored(changes.repartition("digest").sortWithinPartitions(F.col("n") < 0).mapInPandas(_collapse, _PARTIAL), "index")
    stale = stored(kept.join(removed.select("digest", "row"), ["digest", "row"], "left_semi").select("digest"), "stale")
    fresh = build_index(join_checked(remaining, stale, "digest", "left_semi"))
    return join_checked(kept, stale, "digest", "left_anti").unionByName(fresh)


def dedup(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, digest (binary)."""
    rows = digest_rows(docs)
    index = build_index(rows)
    salts = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda s: F.getbit(F.col("salts"), s) == 1)
    groups = index.select(
        F.col("digest").alias("_digest"), F.nullif("doc_id", F.lit(_NO_ID)).alias("keep_id"),
        F.col("row").alias("_best"), F.col("n").alias("group_size"), F.explode(salts).alias("_s"),
    )
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
    joined = salted.join(groups, (F.col("digest") == F.col("_digest")) & (F.col("_salt") == F.col("_s")))
    return joined.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("_best")).alias("kept"), "digest")


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row per group of equal texts, columns unchanged."""
    decisions = stored(dedup(docs).withColumnRenamed("digest", "token"), "exact")
    return keep_decided(docs, decisions, digest_of(F.col("text")))
