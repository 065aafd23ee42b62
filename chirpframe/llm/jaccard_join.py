"""Jaccard join of word n-gram sets, exact, with a token-group matrix.

A document's set holds the 64-bit hashes of its distinct shingles. Documents
with equal sets are one *node*. The join finds every link between nodes:

1. **Groups of similar sets.** Two sets that link differ in at most D tokens, so
   of D + 1 token classes (by hash) one is the same in both. Each node emits a
   signature per non-empty class for its size band, and for the next band if
   that can hold a partner. Nodes with a common signature form a group; no link
   lies outside the groups. (Classes may be empty: a few spare classes make sure
   that a non-empty one agrees; a node with more empty classes than spares emits
   those too.)
2. **Stars.** In each group every node is compared with the group's smallest and
   largest node. Verified links give components.
3. **Token-group matrix.** Where a group still holds several components, each
   component's part of it has a row in the matrix: the union of its members'
   tokens, as a hashed bitmap. A node opens only the rows whose bound
   ``|tokens outside the union| <= (1 - t) |tokens|`` it meets, and there only members
   whose own bitmaps differ in at most D places. Both bounds never exclude a
   link. What is left is verified on the full sets, and the components merged.

A component that is complete after the stars costs nothing more, so a group of
thousands of near copies is never paired out. Groups over ``BLOCK`` rows are cut
into blocks, each pair of blocks in its own task unit.

Defined cases: null text has an empty set, as has a text without words; empty sets link with nothing. Texts
with fewer words than a shingle have their word sequence as only element. A null id takes part like any other; a
component's id is its smallest non-null id. Repeated rows are separate documents
with equal sets. An empty table gives an empty result. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SALTS, drop_stored, join_checked, keep_decided, numbered, stored, text_of
from .components import components
from .words import byte_chunks, mix, shingle_sets, split_words

BLOCK = 2048
#: Small sets get sparse bitmaps, so that two sets just beyond the limit rarely pass for linked ones.
LEAST_BITS = 4096


class Bands:
    """Size bands for a threshold in percent: no band reaches further than one linked partner can."""

    def __init__(self, percent: int):
        self.percent = percent
        low = [1]
        while low[-1] < 1 << 40:
            low.append(low[-1] * 100 // percent + 1)
        self.low = np.array(low, np.int64)
        worst = 2 * (self.low[1:] - 1) * (100 - percent) // (100 + percent)  # tokens in which two linked sets differ
        self.spare = np.where(worst > 0, worst // 10 + 1, 0)
        self.classes = np.where(worst > 0, worst + 1 + self.spare, 0)  # no difference allowed: equal sets, one node

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, n, "right") - 1

    def bits(self, n: int) -> int:
        """Bitmap size: a power of two, at least ``LEAST_BITS`` and twice the tokens of the band's largest set."""
        top = int(self.low[int(self.of(np.array([n]))[0]) + 1]) * 2
        return max(LEAST_BITS, 1 << (top - 1).bit_length())


def node_of(tokens: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes())).astype(np.int64))


def bitmap(tokens: np.ndarray, bits: int) -> bytes:
    flags = np.zeros(bits, np.uint8)
    flags[(tokens & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little").tobytes()


def signatures(sets: list[np.ndarray], bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(signature, index of its set) for all sets."""
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    own = bands.of(np.maximum(n, 1))
    who = np.arange(len(sets))
    upward = bands.low[own + 1] * bands.percent <= 100 * n
    sides = [(who, own), (who[upward], own[upward] + 1)]
    out, owner = [], []
    for index, band in sides:
        m = bands.classes[band]
        live = (m > 0) & (n[index] > 0)
        index, band, m = index[live], band[live], m[live]
        if not len(index):
            continue
        tokens = np.concatenate([sets[i] for i in index])
        start = np.concatenate([[0], np.cumsum(m)])
        of = np.repeat(np.arange(len(index)), n[index])
        cell = start[of] + ((tokens >> np.uint64(20)) % m[of].astype(np.uint64)).astype(np.int64)
        total = np.zeros(start[-1], np.uint64)
        np.add.at(total, cell, mix(tokens))
        full = np.bincount(cell, minlength=start[-1]) > 0
        holder = np.repeat(np.arange(len(index)), m)
        empty = m - np.add.reduceat(full.astype(np.int64), start[:-1])
        use = full | (empty > bands.spare[band])[holder]
        place = np.arange(start[-1]) - start[holder]
        salt = mix((band[holder].astype(np.uint64) << np.uint64(40)) + place.astype(np.uint64) + np.uint64(1))
        out.append(mix(total + salt)[use])
        owner.append(index[holder[use]])
    if not out:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(out), np.concatenate(owner)


def _set_runs(texts, size: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    for start, run in byte_chunks(texts):
        yield start, list(shingle_sets(split_words(run), size))


def nodes(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Stored: row, doc_id, node, n (tokens), bits (hashed bitmap)."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bands = Bands(percent)
        for batch in batches:
            for start, sets in _set_runs(batch["text"], size):
                part = batch.iloc[start:start + len(sets)][["doc_id"]]
                yield part.assign(
                    node=[node_of(s) for s in sets], n=[len(s) for s in sets],
                    bits=[bitmap(s, bands.bits(len(s))) if len(s) else b"" for s in sets],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"))
    found = rows.mapInPandas(build, "doc_id long, node long, n long, bits binary")
    return stored(numbered(found), "sets")


def shared_signatures(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Stored: sig, node, low, high for signatures of at least two nodes."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bands = Bands(percent)
        seen: set[int] = set()  # equal sets of a task emit once
        for batch in batches:
            for _, sets in _set_runs(batch["text"], size):
                names = [node_of(s) for s in sets]
                fresh = [i for i, (s, v) in enumerate(zip(sets, names)) if len(s) and v not in seen]
                fresh = list({names[i]: i for i in fresh}.values())
                seen.update(names[i] for i in fresh)
                if fresh:
                    sig, owner = signatures([sets[i] for i in fresh], bands)
                    node = np.array([names[i] for i in fresh], np.int64)[owner]
                    yield pd.DataFrame({"sig": sig.view(np.int64), "node": node})

    rows = docs.select(text_of("text").alias("text")).mapInPandas(emit, "sig long, node long")
    group = Window.partitionBy("sig")
    found = rows.withColumns({"low": F.min("node").over(group), "high": F.max("node").over(group)})
    return stored(found.where("low < high"), "signatures")


def _limit(a, b, percent: int):
    """Most tokens in which linked sets of these sizes differ."""
    return (a + b) * (100 - percent) // (100 + percent)


def _matrix(bits: list[bytes]) -> np.ndarray:
    """Bitmaps as rows of 64-bit words; larger ones are folded to the smallest size (sizes are powers of two)."""
    width = min(map(len, bits))
    if all(len(b) == width for b in bits):
        return np.frombuffer(b"".join(bits), np.uint64).reshape(len(bits), -1)
    return np.stack([np.bitwise_or.reduce(np.frombuffer(b, np.uint64).reshape(-1, width // 8), axis=0) for b in bits])


def _count(words: np.ndarray) -> np.ndarray:
    return np.bitwise_count(words).sum(axis=-1, dtype=np.int64)


def may_link(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes and bitmaps do not exclude a link."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            na, nb = batch["na"].to_numpy(), batch["nb"].to_numpy()
            good = np.minimum(na, nb) * 100 >= np.maximum(na, nb) * percent
            bound = _limit(na, nb, percent)
            bits_a, bits_b = batch["bits_a"].tolist(), batch["bits_b"].tolist()
            for i in np.flatnonzero(good).tolist():
                both = _matrix([bits_a[i], bits_b[i]])
                good[i] = int(_count(both[0] ^ both[1])) <= bound[i]
            yield batch.loc[good, ["a", "b"]]

    left = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("bits").alias("bits_a"))
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bits_b"))
    return pairs.join(left, "a").join(right, "b").mapInPandas(check, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, sets: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs of ``pairs`` (a, b; stored) that link, checked on full token sets; stored."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, run in _set_runs(batch["text"], size):
                yield pd.DataFrame({"node": [node_of(s) for s in run], "tokens": [s.tobytes() for s in run]})

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            good = np.zeros(len(batch), bool)
            for i, (one, two) in enumerate(zip(batch["tokens_a"], batch["tokens_b"])):
                one, two = np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64)
                common = len(np.intersect1d(one, two, assume_unique=True))
                good[i] = 100 * common >= percent * (len(one) + len(two) - common)
            yield batch.loc[good, ["a", "b"]]

    wanted = pairs.select("a").union(pairs.select("b")).distinct().toDF("node")
    ids = stored(sets.join(wanted, "node", "left_semi").select(F.col("id").alias("_id")).distinct(), "wanted")
    texts = docs.select(F.col("doc_id").cast("long").alias("_doc"), text_of("text").alias("text"))
    texts = join_checked(texts, ids, F.col("_doc").eqNullSafe(F.col("_id")), "left_semi")
    found = texts.select("text").mapInPandas(build, "node long, tokens binary")
    full = stored(found.join(wanted, "node", "left_semi").dropDuplicates(["node"]), "tokens")
    left = full.select(F.col("node").alias("a"), F.col("tokens").alias("tokens_a"))
    right = full.select(F.col("node").alias("b"), F.col("tokens").alias("tokens_b"))
    links = stored(pairs.join(left, "a").join(right, "b").mapInPandas(check, "a long, b long"), "verified")
    drop_stored(full, ids)
    return links


def open_groups(
    node: np.ndarray, label: np.ndarray, n: np.ndarray, block: np.ndarray, bits: list[bytes], percent: int
) -> Iterator[tuple[int, int]]:
    """Pairs of one signature group, in different components, that the matrix does not exclude.

    Rows come sorted by ``label``. If the group is a pair of blocks, rows of one block were compared elsewhere.
    """
    first = np.flatnonzero(np.concatenate([[True], label[1:] != label[:-1]]))
    if len(first) < 2:
        return
    apart = bool((block != block[0]).any())
    rows = _matrix(bits)
    union = np.bitwise_or.reduceat(rows, first, axis=0)  # the token-group matrix
    last = np.append(first[1:], len(node))
    step = max(1, (1 << 22) // max(1, union.size))
    for a in range(0, len(node), step):
        mine = rows[a:a + step]
        outside = _count(mine[:, None, :] & ~union[None, :, :])
        opened = outside * 100 <= (100 - percent) * n[a:a + step, None]
        opened &= first[None, :] > np.arange(a, a + len(mine))[:, None]  # later components only: each pair once
        for q, g in zip(*np.nonzero(opened)):
            q += a
            members = np.arange(first[g], last[g])
            if apart:
                members = members[block[members] != block[q]]
            differ = _count(rows[members] ^ rows[q])
            sizes = np.minimum(n[members], n[q]) * 100 >= np.maximum(n[members], n[q]) * percent
            for hit in members[sizes & (differ <= _limit(n[members], n[q], percent))]:
                yield int(node[q]), int(node[hit])


def rest_pairs(members: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs between components that share a signature and pass the matrix."""
    labelled = members.select("sig", "node").join(labels, "node", "left").select(
        "sig", "node", F.coalesce("label", "node").alias("label")
    )
    mixed = labelled.groupBy("sig").agg(
        F.min("label").alias("one"), F.max("label").alias("two"), F.count(F.lit(1)).alias("size")
    ).where("one < two").select("sig", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    rows = labelled.join(mixed, "sig").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    rows = rows.select("sig", "node", "label", "block", other).select(
        "sig", "node", "label", "block", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q")
    )
    rows = rows.join(sets.select("node", "n", "bits"), "node")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None

        def pairs_of(frame: pd.DataFrame) -> pd.DataFrame:
            keys = frame[["sig", "p", "q"]].to_numpy()
            cut = (np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1).tolist()
            node, label, n, block = (frame[c].to_numpy() for c in ("node", "label", "n", "block"))
            bits = frame["bits"].tolist()
            found = {
                pair for a, b in zip([0, *cut], [*cut, len(frame)])
                for pair in open_groups(node[a:b], label[a:b], n[a:b], block[a:b], bits[a:b], percent)
            }
            return pd.DataFrame(sorted(found), columns=["a", "b"], dtype="int64")

        for batch in batches:
            if rest is not None:
                batch = pd.concat([rest, batch], ignore_index=True)
            keys = batch[["sig", "p", "q"]].to_numpy()
            tail = np.flatnonzero(np.all(keys == keys[-1], axis=1)) if len(batch) else [0]
            rest, done = batch.iloc[tail[0]:], batch.iloc[:tail[0]]
            if len(done):
                yield pairs_of(done)
        if rest is not None and len(rest):
            yield pairs_of(rest)

    grouped = rows.repartition("sig", "p", "q").sortWithinPartitions("sig", "p", "q", "label")
    found = grouped.mapInPandas(search, "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def links_of(docs: DataFrame, rows: DataFrame, sets: DataFrame, size: int, percent: int) -> DataFrame:
    """(node, label) for every node with a link."""
    members = shared_signatures(docs, size, percent)
    stars = members.select(F.col("low").alias("a"), F.col("node").alias("b")).union(members.select("node", "high"))
    near = stored(may_link(stars.where("a <> b").distinct(), sets, percent), "near")
    links = verified(near, docs, sets, size, percent)
    labels = stored(components(links), "labels")
    rest = stored(rest_pairs(members, labels, sets, percent), "rest")
    if rest.isEmpty():
        return labels
    more = verified(rest, docs, sets, size, percent)
    if more.isEmpty():
        return labels
    return stored(components(links.union(more)), "labels")


def joined(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Per document: row, doc_id, n_shingles, node, label (smallest node of its component; null for empty sets) and
    component_id (smallest id reachable by links)."""
    rows = nodes(docs, size, percent)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
    parts = salted.where("n > 0").groupBy("node", "_salt").agg(
        F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("bits").alias("bits"))
    sets = stored(parts.groupBy("node").agg(
        F.min("id").alias("id"), F.first("n").alias("n"), F.first("bits").alias("bits"),
        F.collect_list("_salt").alias("salts")), "nodes")
    labels = links_of(docs, rows, sets, size, percent)
    known = sets.select("node", "id", "salts").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    ids = known.groupBy("label").agg(F.min("id").alias("component_id"))
    spread = known.join(ids, "label").select(
        F.col("node").alias("_node"), "label", "component_id", F.explode("salts").alias("_s"))
    same = (F.col("node") == F.col("_node")) & (F.col("_salt") == F.col("_s")) & (F.col("n") > 0)
    return salted.join(spread, same, "left").select(
        "row", "doc_id", F.col("n").alias("n_shingles"), "node", "label",
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def one_per_component(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row per component (one of the smallest id), columns unchanged; empty sets all stay.

    Components are told apart by their label: all ids of one may be null.
    """
    found = stored(joined(docs, size, percent), "joined")
    first = found.where("n_shingles > 0").groupBy("label").agg(
        F.min(F.when(F.col("doc_id").eqNullSafe(F.col("component_id")), F.col("row"))).alias("_row"))
    lone = found.where("n_shingles = 0").select("doc_id", F.lit("").alias("token"), F.lit(True).alias("kept"))
    chosen = found.where("n_shingles > 0").join(
        first.select(F.col("_row")), F.col("row") == F.col("_row"), "left"
    ).select("doc_id", F.col("node").cast("string").alias("token"), F.col("_row").isNotNull().alias("kept"))
    # empty sets have the token '': all of them stay, also those that share an id
    return keep_decided(docs, lone.union(chosen), node_token(size)(text_of("text")), every="")


def node_token(size: int):
    """Column function: a text's node as text, empty for an empty set."""

    @F.pandas_udf("string")
    def token(texts: pd.Series) -> pd.Series:
        out: list[str] = []
        for _, sets in _set_runs(texts, size):
            out += [str(node_of(s)) if len(s) else "" for s in sets]
        return pd.Series(out, dtype=object)

    return token
