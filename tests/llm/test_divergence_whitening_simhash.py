"""Source divergence, whitening and SimHash against plain Python on small tables."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from chirpframe.llm import divergence, simhash, whitening
from chirpframe.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["row", "node", "fp", "label", "term", "c", "df", "p", "q", "rank", "_salt", "block", "index", "x", "part", "_range"]
SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    base = [[f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(n)] for n in (2, 3, 50, 200, 500)]
    rows = [" ".join(b) for b in base]
    for b in base[2:]:
        for edits in (1, 2, 20):
            copy = list(b)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(50)}"
            rows.append("\t ".join(copy))
    rows += [rows[3], rows[3].upper(), None, "", " \n\t", "one", "ONE", "two words", "1234 5678 ...", "é Ü ü 漢字 😀 é",
             "\x00a\x7fb\x7f", " ".join(rng.choice(base[4]) for _ in range(30_000)), "z" * 5000, "same " * 400, "same " * 400]
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    langs, sources = ["en", "de", None, ""], ["s0", "s1", "s2", None, ""]
    rows = [(i, t, langs[i % 4], sources[i % 5], 1) for i, t in enumerate(texts)]
    rows += [(None, texts[3], "en", "s0", None), (3, texts[3], "en", "s1", None), (3, texts[3], "en", "s1", None),
             (900, None, "fr", "alone", 0), (901, "a b", "it", "s0", 0), (902, "c", "it", "s1", 0)]
    frame = spark.createDataFrame(rows, DOCS)
    return frame.withColumns({c: F.lit("x") for c in CLASH}).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# --- divergence -----------------------------------------------------------------------------------


def plain_divergence(rows, least=3, most=200):
    uses, having, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered(text))
        groups[lang or ""].add(source or "")
        uses[lang or "", source or ""].update(found)
        having[lang or ""].update(set(found))
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in having[lang].items() if n >= least]
        whole = Counter()
        for s in sources:
            whole.update({t: uses[lang, s][t] for t in kept})

        def share(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // (total + len(kept)) for t in kept}

        shares, q = {s: share(uses[lang, s]) for s in sources}, share(whole)
        f = lambda p, q: (p - q) ** 2 // q
        for s in sources:
            p = shares[s]
            pairs = [(-sum(f(p[t], shares[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            terms = [(-f(p[t], q[t]), t.encode(), t) for t in kept if uses[lang, s][t] and p[t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:most])):
                out |= {(lang, s, part, name, -value, k + 1) for k, (value, _, name) in enumerate(found)}
    return out


def test_divergence(docs, empty, monkeypatch):
    rows = [(r.text, r.lang, r.source) for r in docs.collect()]
    got = [tuple(r) for r in divergence.audited(docs).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_divergence(rows)
    assert {r[4] for r in got if r[0] == "it"} == {0}  # no term in three documents
    assert {r[0] for r in got if r[2] == "pair"} >= {"en", "de", "", "it"} and not [r for r in got if r[0] == "fr"]
    assert divergence.audited(empty).count() == 0
    monkeypatch.setattr(divergence, "BLOCK", 7)  # many blocks, the same sums
    monkeypatch.setattr(divergence, "HELD", 10)
    few = [tuple(r) for r in divergence.audited(docs, most=5).collect()]
    assert set(few) == plain_divergence(rows, most=5)


def test_term_slices():
    text = "Ab1cd éÜ-x " * 1000
    whole = [t for part in divergence.terms(text.encode()) for t in part]
    assert whole == [t for part in divergence.terms(text.encode(), 17) for t in part]
    assert whole[:4] == [b"ab", b"cd", "éÜ".encode(), b"x"]


def test_runs_and_common_runs():
    rng = np.random.default_rng(3)
    for _ in range(200):
        width = int(rng.integers(1, 60))
        sides = []
        for _ in range(2):
            full = rng.integers(1, 4, width) * 10  # 10 stands for the share of count 0
            edges = np.flatnonzero(full != 10)
            column = divergence.runs(edges, np.ones(len(edges), np.int64), full[edges], 10, width)
            assert (np.repeat(column[1], np.diff(np.append(column[0], width))) == full).all()
            assert (np.diff(column[1]) != 0).all()
            sides.append((full, column))
        (p, one), (q, two) = sides
        want = int(((p - q) ** 2 // q).sum()), int(((p - q) ** 2 // p).sum())
        assert divergence.intersect(one, two, width) == want


def test_share_is_exact_beyond_a_long(spark):
    big = 3 * 10**13
    got = spark.range(1).select(divergence.share(F.lit(big), F.lit(7 * 10**13), F.lit(11))).first()[0]
    assert got == 1 + 10**9 * (big + 1) // (7 * 10**13 + 11)


# --- whitening ------------------------------------------------------------------------------------


def plain_whitening(vectors, most=4):
    """{row number: (deviation, coordinates)}, explained shares."""
    x = [tuple(math.floor(256 * float(np.float32(c))) for c in v) for v in vectors]
    fit = sorted(set(x))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array(fit, float) - np.array(sums) / n
    values, units = np.linalg.eigh(centred.T @ centred / n)
    lead = np.argsort(values)[::-1][:most]
    scale = units[:, lead] / np.sqrt(values[lead])
    rows = {i: (sum((n * a - s) ** 2 for a, s in zip(v, sums)), (np.array(v) - np.array(sums) / n) @ scale)
            for i, v in enumerate(x)}
    return rows, values[lead] / values.sum(), n


def check_whitening(got, vectors):
    rows, explained, n = plain_whitening(vectors)
    found = defaultdict(dict)
    for r in got:
        found[r.vec_id][r.component] = r
    assert set(found) == set(rows)
    for k in range(len(explained)):
        ours = np.array([found[i][k + 1].whitened for i in sorted(rows)])
        theirs = np.array([rows[i][1][k] for i in sorted(rows)])
        assert min(np.abs(ours - theirs).max(), np.abs(ours + theirs).max()) < 1e-7
    for i, cells in found.items():
        assert set(cells) == set(range(1, len(explained) + 1))
        for k, r in cells.items():
            assert r.n == n and int(r.deviation) == rows[i][0] and r.identity_error < 1e-9
            assert abs(r.explained - explained[k - 1]) < 1e-12


def test_whitening(spark, monkeypatch):
    rng = np.random.default_rng(8)
    good = (rng.normal(size=(300, 6)) * [3, 2, 1.5, 1, .5, .2] + 40).astype("float32").tolist()
    good += good[:3] * 40  # a hot vector
    rows = [(i, v) for i, v in enumerate(good)]
    bad = [None, [], [1.0, None, 1.0, 1.0, 1.0, 1.0], [float("nan")] * 6, [float("inf")] + [0.0] * 5, [1.0, 2.0],
           [3e38] + [0.0] * 5]
    frame = spark.createDataFrame(rows + [(5000 + i, v) for i, v in enumerate(bad)], "vec_id long, embedding array<float>")
    frame = frame.withColumns({c: F.lit("x") for c in CLASH + ["y", "first", "n", "h1", "cells"]}).repartition(5)
    check_whitening(whitening.whitened(frame).collect(), good)
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 16)
    monkeypatch.setattr(whitening, "BLOCK_COLS", 4)
    monkeypatch.setattr(whitening, "MIDDLE", 2)
    check_whitening(whitening.whitened(frame).collect(), good)


def test_whitening_without_directions(spark):
    schema = "vec_id long, embedding array<float>"
    for vectors in ([], [[1.0, 2.0]], [[1.0, 2.0]] * 5, [None, None]):
        frame = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], schema)
        assert whitening.whitened(frame).count() == 0
    line = spark.createDataFrame([(None, [float(i), 2.0 * i, 0.0]) for i in range(9)] + [(1, [4.0, 8.0, 0.0])], schema)
    got = whitening.whitened(line).collect()  # one direction only; null ids and a repeat
    assert len(got) == 10 and {r.component for r in got} == {1} and got[0].n == 9
    assert all(abs(r.explained - 1) < 1e-12 for r in got)


def test_deviation_beyond_a_long(spark):
    vectors = [[float(10**9 * i), float(i % 2)] for i in range(6)]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    x = [[math.floor(256 * c) for c in v] for v in vectors]
    sums = [sum(c) for c in zip(*x)]
    got = {r.vec_id: int(r.deviation) for r in whitening.whitened(frame).collect()}
    assert got == {i: sum((6 * a - s) ** 2 for a, s in zip(v, sums)) for i, v in enumerate(x)}


def test_whitening_query(spark):
    table = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").orderBy("vec_id").collect()
    assert [r.vec_id for r in table] == list(range(len(table)))
    check_whitening(QUERIES["op12_whitening"](spark, SF_DIR).collect(), [r.embedding for r in table])


# --- SimHash --------------------------------------------------------------------------------------


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, distance=2):
    """Component number of every fingerprint, by comparing all pairs."""
    names = sorted(set(prints))
    parent = {p: p for p in names}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for i, p in enumerate(names):
        for q in names[:i]:
            if (p ^ q).bit_count() <= distance:
                parent[root(p)] = root(q)
    return {p: root(p) for p in names}


def check_simhash(rows, got):
    """``rows`` and ``got`` hold (id, text) and (id, fingerprint, component)."""
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    label = plain_components([p for _, p in prints])
    least = {}
    for i, p in prints:
        if i is not None:
            least[label[p]] = min(i, least.get(label[p], i))
    want = Counter((i, f"{p:016x}", least.get(label[p])) for i, p in prints)
    assert Counter(got) == want


def test_simhash(docs, empty):
    got = simhash.near_duplicates(docs).select("doc_id", simhash.printed("fp"), "component_id").collect()
    check_simhash([(r.doc_id, r.text) for r in docs.collect()], [tuple(r) for r in got])
    assert simhash.near_duplicates(empty).count() == 0


def test_simhash_query(spark):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    check_simhash([tuple(r) for r in rows], [tuple(r) for r in QUERIES["op13_simhash"](spark, SF_DIR).collect()])


def test_fingerprint_of_slices(monkeypatch, texts):
    want = [simhash.fingerprint((t or "").encode()) for t in texts]
    assert want == [plain_fingerprint(t) for t in texts]
    monkeypatch.setattr(simhash.slices, "__defaults__", (7,))
    assert want == [simhash.fingerprint((t or "").encode()) for t in texts]


def test_shingles_hash_as_in_spark(spark):
    got = spark.range(1).select(F.xxhash64(F.lit("a b ü"))).first()[0]
    assert got % (1 << 64) == int(simhash.shingle_hashes("a b ü".encode().split(), 3)[0])


@pytest.mark.parametrize("distance", [1, 2, 3, 5])
def test_lists_reach_every_link(spark, monkeypatch, distance):
    """Random fingerprints with neighbours at each distance, and a crowd that shares its upper half."""
    rng = random.Random(distance)
    prints = {rng.getrandbits(64) for _ in range(150)}
    for p in list(prints):
        for k in range(1, distance + 2):
            q = p
            for b in rng.sample(range(64), k):
                q ^= 1 << b
            prints.add(q)
    prints |= {0xABCDEF0102030405 ^ rng.getrandbits(12) ^ rng.getrandbits(6) << 24 for _ in range(400)}
    want = plain_components(prints, distance)
    frame = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    for long in (4096, 20):  # also with long lists keyed again
        monkeypatch.setattr(simhash, "LONG", long)
        pairs = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(frame, distance).collect()]
        assert all((a ^ b).bit_count() <= distance for a, b in pairs)
        parent = {p: p for p in prints}

        def root(p):
            while parent[p] != p:
                p = parent[p]
            return p

        for a, b in pairs:
            parent[root(a)] = root(b)
        assert len({root(p) for p in prints}) == len(set(want.values()))
        assert len({(root(p), want[p]) for p in prints}) == len(set(want.values()))
    with pytest.raises(ValueError):
        simhash.list_masks(0)


def test_list_hands_on_a_forest():
    crowd = np.array([1 << i | 1 << j for i in range(16) for j in range(i)], np.uint64)  # each differs from many by two bits
    found = list(simhash.list_links(crowd, 2))
    assert len(found) == len(crowd) - 1


def test_prints_are_hex(spark):
    got = spark.createDataFrame([(0,), (-1,), (10,)], "fp long").select(simhash.printed("fp")).collect()
    assert [r[0] for r in got] == ["0" * 16, "f" * 16, "000000000000000a"]
