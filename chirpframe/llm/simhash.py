"""SimHash near-duplicates through an inverted index of byte positions with count filtering.

Every word shingle, repeats included, votes with the bits of its 64-bit hash; a
fingerprint bit is 1 if more than half of the shingles have it. Documents with
one fingerprint are one *node*. Two fingerprints that differ in at most k bits
differ in at most k of their eight bytes, so ``8 - k`` positional bytes are shared:
that is the guaranteed minimum of the count filter.

1. **Lists.** A list per single (position, byte) would hold 1/256 of all nodes, and
   tallying those pairs is quadratic in the corpus. The minimum allows a longer
   key: of k + 2 groups of positions at least two are shared whole, so the lists are
   keyed by two groups (four bytes for k = 2), and no linked pair lies outside them.
2. **Long lists** (over ``LONG`` nodes; a third of all nodes may share four bytes)
   are keyed again by further shared positions up to the whole minimum. Such a list
   leaves k bytes free, so for k = 2 it has at most 65 536 nodes, whatever the data.
3. **Tally.** Inside a list the shared positional bytes of each pair are counted, pairs
   below the minimum go, the rest is verified by the number of differing bits.
   A list hands on a spanning forest of its links and never all its pairs.

Components of the links are found by ``components``; every document gets the
smallest id of its own.

Defined cases: null text is empty; a text without words has fingerprint zero and
links like any other; fewer words than a shingle are one shingle. Texts of any
length are read in slices cut at white space. A null id takes part like any
other; a component's id is its smallest non-null id (null if it has none).
Repeated rows each get their row. An empty table gives an empty result. Only
``doc_id`` and ``text`` are read, so further columns cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SALTS, join_checked, numbered, stored
from .components import components

SEED = 42
SLICE = 1 << 20
LONG = 4096
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def slices(raw: bytes, limit: int = SLICE) -> Iterator[bytes]:
    """The text in parts of about ``limit`` bytes; no word is cut."""
    at = 0
    while at < len(raw):
        found = _SPACE.search(raw, at + limit)
        end = found.start() if found else len(raw)
        yield raw[at:end]
        at = end


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 of every run of ``size`` words, joined by one space."""
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    digest = xxhash.xxh64_intdigest
    found = (digest(line[a:b], SEED) for a, b in zip(starts[:len(words) - size + 1].tolist(), ends[size - 1:].tolist()))
    return np.fromiter(found, np.uint64, len(words) - size + 1)


def fingerprint(raw: bytes | None, size: int = 3) -> int:
    """The 64-bit fingerprint of one text in UTF-8."""
    ones, total, words = np.zeros(64, np.int64), 0, []
    for part in slices(raw or b""):
        words = words[max(0, len(words) - size + 1):] + part.lower().split()  # only A-Z change in bytes
        if len(words) >= size:
            bits = shingle_hashes(words, size).astype("<u8").view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(bits, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            total += len(bits)
    if not total and words:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprinted(docs: DataFrame, size: int = 3) -> DataFrame:
    """Stored: row, doc_id, fp (the fingerprint as a signed long)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(t.as_py(), size) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return stored(numbered(rows.mapInArrow(read, "doc_id long, fp long")), "prints")


def list_masks(distance: int) -> list[tuple[int, list[int]]]:
    """Per list kind the mask of its bytes, and the masks that a long list is keyed by again."""
    if not 1 <= distance <= 6:
        raise ValueError("The distance lies between 1 and 6 bits.")
    groups = [range(8)[g::distance + 2] for g in range(distance + 2)]
    mask = lambda places: sum(0xFF << 8 * p for p in places)
    found = []
    for one, two in combinations(groups, 2):
        have = [*one, *two]
        rest = [p for p in range(8) if p not in have]
        more = [mask([*have, *extra]) for extra in combinations(rest, max(0, 8 - distance - len(have)))]
        found.append((mask(have), more))
    return found


def signed(mask: int) -> Column:
    return F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")


def postings(nodes: DataFrame, distance: int) -> DataFrame:
    """(kind, bytes, fp): the lists that hold every linked pair of ``nodes`` (fp)."""
    masks = list_masks(distance)
    entry = lambda kind, mask: F.struct(
        F.lit(kind).alias("kind"), F.col("fp").bitwiseAND(signed(mask)).alias("bytes"))
    first = nodes.select("fp", F.explode(F.array(*[entry(i, m) for i, (m, _) in enumerate(masks)])).alias("e"))
    first = stored(first.select("e.kind", "e.bytes", "fp"), "postings")
    sizes = first.groupBy("kind", "bytes").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sizes = stored(sizes.select("kind", "bytes", (F.col("n") > LONG).alias("long")), "lists")
    used = first.join(sizes, ["kind", "bytes"])
    numbers = {m: len(masks) + i for i, m in enumerate(sorted({m for _, more in masks for m in more}))}
    again = F.element_at(F.array(*[F.array(*[entry(numbers[m], m) for m in more]) for _, more in masks]), F.col("kind") + 1)
    deeper = used.where("long").select("fp", F.explode(again).alias("e")).select("e.kind", "e.bytes", "fp").distinct()
    return used.where("not long").select("kind", "bytes", "fp").union(deeper)


def list_links(prints: np.ndarray, distance: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links in one list of distinct fingerprints (unsigned)."""
    n = len(prints)
    octets = prints.astype("<u8").view(np.uint8).reshape(n, 8)
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    step = max(1, (1 << 20) // n)
    for a in range(0, n, step):
        mine = octets[a:a + step]
        tally = np.zeros((len(mine), n - a), np.uint8)
        for place in range(8):
            tally += mine[:, place, None] == octets[None, a:, place]
        i, j = np.nonzero(tally >= 8 - distance)
        ahead = j > i
        i, j = i[ahead] + a, j[ahead] + a
        good = np.bitwise_count(prints[i] ^ prints[j]) <= distance
        for x, y in zip(i[good].tolist(), j[good].tolist()):
            one, two = root(x), root(y)
            if one != two:
                parent[two] = one
                yield x, y


def links(nodes: DataFrame, distance: int = 2) -> DataFrame:
    """(a, b): links whose components are those of all pairs within ``distance`` bits."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.empty((0, 3), np.int64)

        def found(table: np.ndarray) -> pa.RecordBatch:
            cut = np.flatnonzero(np.any(table[1:, :2] != table[:-1, :2], axis=1)) + 1
            out = []
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(table)]):
                if b - a > 1:
                    prints = np.ascontiguousarray(table[a:b, 2])
                    out += [(int(prints[x]), int(prints[y])) for x, y in list_links(prints.view(np.uint64), distance)]
            pairs = np.array(out, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for batch in batches:
            table = np.stack([np.asarray(c).astype(np.int64) for c in batch.columns], axis=1)
            table = np.concatenate([rest, table])
            if not len(table):
                continue
            last = np.flatnonzero(np.any(table[:, :2] != table[-1, :2], axis=1))
            start = int(last[-1]) + 1 if len(last) else 0  # the last list may go on in the next batch
            rest = table[start:]
            if start:
                yield found(table[:start])
        if len(rest):
            yield found(rest)

    lists = postings(nodes, distance).repartition("kind", "bytes").sortWithinPartitions("kind", "bytes")
    pairs = lists.mapInArrow(tally, "a long, b long")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, size: int = 3, distance: int = 2) -> DataFrame:
    """Per document: row, doc_id, fp, node_docs (documents of that fingerprint), label and component_id."""
    rows = fingerprinted(docs, size)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
    parts = salted.groupBy("fp", "_salt").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("n"))
    nodes = stored(parts.groupBy("fp").agg(
        F.min("id").alias("id"), F.sum("n").alias("n"), F.collect_list("_salt").alias("salts")), "nodes")
    near = stored(links(nodes.select("fp"), distance), "links")
    labels = components(near).withColumnRenamed("node", "fp")
    known = nodes.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    ids = known.groupBy("label").agg(F.min("id").alias("component_id"))
    spread = known.join(ids, "label").select(
        F.col("fp").alias("_fp"), F.col("n").alias("node_docs"), "label", "component_id", F.explode("salts").alias("_s"))
    same = (F.col("fp") == F.col("_fp")) & (F.col("_salt") == F.col("_s"))
    return join_checked(salted, stored(spread, "spread"), same, "inner").select(
        "row", "doc_id", "fp", "node_docs", "label", "component_id")


def printed(fp: str | Column) -> Column:
    """A signed long as 16 hexadecimal digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
