"""Edge cases and brute-force comparisons of the text operators on small tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chirpframe.llm import (
    bpe, components, exact_dedup, fingerprints, jaccard_join, mixing, passages, piece_counts, quality, sharding, warc,
)
from chirpframe.llm import words as words_module
from chirpframe.llm.queries import QUERIES, vocabulary

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns with the names that operators use inside.
CLASH = ["row", "node", "ids", "shard", "kept", "digest", "token", "_salt", "score", "record", "draw", "label"]


def words(rng, n, size=4000):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    """Texts with nulls, empties, repeats, near copies, shared passages and one very long text."""
    rng = random.Random(5)
    base = [words(rng, n) for n in (3, 12, 60, 120, 300, 900)]
    rows = [" ".join(b) for b in base]
    passage = words(rng, 70, 10**6)
    for b in base[2:]:
        for edits in (1, 3, 12):
            copy = list(b)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            rows.append(" ".join(copy))
        rows.append(" ".join(words(rng, 40) + passage + words(rng, 40)))
    rows += [rows[3], rows[3] + " ", rows[4].upper(), None, "", " \t\n", "one", "ONE", "é ü 漢字 😀", "a" * 3000]
    rows += [" ".join(words(rng, 20_000)), " ".join(["same"] * 400), " ".join(["same"] * 400)]
    return list(enumerate(rows))


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}", len(t or "")) for i, t in texts]
    rows += [(None, "nobody owns this text", None, None, None), (3, texts[3][1], "en", "s0", 1), (3, texts[3][1], "en", "s0", 1)]
    frame = spark.createDataFrame(rows, DOCS)
    return frame.withColumns({c: F.lit("x") for c in CLASH}).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def split(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def test_exact_dedup(docs, empty):
    got = exact_dedup.dedup(docs).collect()
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t)].append((-len(t), 1 << 62 if i is None else i))
    want = Counter()
    for members in groups.values():
        best = min(members)
        for k, member in enumerate(sorted(members)):
            shown = [None if x == 1 << 62 else x for x in (member[1], best[1])]
            want[(shown[0], shown[1], len(members), k == 0)] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == want
    kept = exact_dedup.drop_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup.dedup(empty).count() == 0 and exact_dedup.drop_duplicates(empty).count() == 0


def test_cuckoo_filter_grows_and_forgets():
    index = exact_dedup.DigestIndex()
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(20_000)]
    for i, key in enumerate(keys):
        index.add(key, 1, i, i, 1, 1)
    assert index.size == len(keys) and len(index.content) > 1024
    assert all(index.find(k)[2] == i for i, k in enumerate(keys))
    for key in keys[::2]:
        index.remove(key, 1)
    assert all((index.find(k) is None) == (i % 2 == 0) for i, k in enumerate(keys))


def test_index_update(docs):
    rows = exact_dedup.digest_rows(docs)
    index = exact_dedup.build_index(rows)
    double = exact_dedup.update_index(index, added=rows)
    assert double.agg(F.sum("n")).first()[0] == 2 * rows.count()
    assert exact_dedup.update_index(index, removed=rows, remaining=rows.limit(0)).count() == 0
    with pytest.raises(ValueError):
        exact_dedup.update_index(index, removed=rows)
    best = index.where("n > 1").select("row")  # the best row of every group goes
    gone, left = rows.join(best, "row", "left_semi"), rows.join(best, "row", "left_anti")
    assert gone.count() > 1
    entry = lambda r: (bytes(r.digest), r.cp, r.doc_id, r.row, r.n)
    got = exact_dedup.update_index(index, removed=gone, remaining=left).collect()
    assert set(map(entry, got)) == set(map(entry, exact_dedup.build_index(left).collect()))


def test_capture_times_in_any_time_zone(spark, tmp_path):
    zone = spark.conf.get("spark.sql.session.timeZone")
    autumn = 1_604_210_000  # around the repeated hour
    pages = spark.createDataFrame([(k, f"http://a/{k}", "x", autumn + 1800 * k) for k in range(8)],
                                  "page_id long, url string, html string, at long")
    try:
        for name in ("America/New_York", "Asia/Kolkata", "UTC"):
            spark.conf.set("spark.sql.session.timeZone", name)
            path = str(tmp_path / name.replace("/", "-"))
            warc.write_archives(pages, path, F.col("at"))
            got = {r.page_id: r.captured for r in warc.read_archives(spark, path).collect()}
            assert got == {k: autumn + 1800 * k for k in range(8)}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_one_hot_id_is_spread_over_buckets(spark, tmp_path):
    """Rows of one id, or without id and all alike, share a shard but not a bucket."""
    for id in (7, None):
        docs = spark.range(2000).select(F.lit(id).cast("long").alias("doc_id"), F.lit("x" * 2000).alias("text"))
        written = sharding.write_shards(docs, str(tmp_path / f"s{id}"), n_shards=4, bucket_bytes=100_000)
        sizes = written.groupBy("shard", "bucket").agg(F.sum(sharding.size_of("record.text")).alias("b")).collect()
        assert len({r.shard for r in sizes}) == 1 and len(sizes) >= 10 and max(r.b for r in sizes) < 800_000


def test_bpe(docs, empty):
    import tiktoken

    path, pattern = vocabulary("byte_bpe_multi_50k.tiktoken")
    public = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    coded = bpe.decode(bpe.encode(docs, path, pattern, offsets=True), path)
    assert [c for c in coded.columns if c in docs.columns and c != "ids"] == [c for c in docs.columns if c != "ids"]
    for r in coded.collect():
        text = r.text or ""
        assert r.ids == public.encode_ordinary(text)
        assert bytes(r.decoded) == text.encode() and r.decoded_text == text
        assert len(r.starts) == len(r.ids) == len(r.ends)
        assert all(a < b for a, b in zip(r.starts, r.ends)) and (not r.ids or r.ends[-1] == len(text))
    assert bpe.encode(empty, path, pattern, round_trip=True).count() == 0
    decoder = bpe.decoder(path)
    ids = public.encode_ordinary("漢字 and 😀")
    assert "".join(decoder.decode_pieces(ids)) == "漢字 and 😀"
    assert decoder.decode(ids[:1]) + decoder.decode(ids[1:]) == "漢字 and 😀".encode()


def test_bpe_repetitive_pieces():
    import tiktoken

    path, pattern = vocabulary("byte_bpe_multi_50k.tiktoken")
    public = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    rng = random.Random(2)
    for _ in range(3000):
        unit = "".join(rng.choice("ab -=\n.é漢😀'sT1") for _ in range(rng.randint(1, 4)))
        text = unit * rng.randint(1, 30) + "".join(rng.choice("aab =\n") for _ in range(rng.randint(0, 9)))
        assert bpe.encoder(path, pattern).encode(text).tolist() == public.encode_ordinary(text)


def test_piece_counts(docs, empty):
    path, _ = vocabulary("byte_bpe_50k.tiktoken")
    entries = bpe.read_ranks(path)
    longest = max(map(len, entries))

    def greedy(word):
        n = at = 0
        while at < len(word):
            end = min(len(word), at + longest)
            while word[at:end] not in entries:
                end -= 1
            at, n = end, n + 1
        return n

    for r in piece_counts.count_tokens(docs, path).collect():
        found = (r.text or "").encode().split()
        assert (r.n_words, r.n_tokens) == (len(found), sum(greedy(b" " + w) for w in found))
    assert piece_counts.count_tokens(empty, path).count() == 0


def test_piece_counts_keep_clashing_columns(spark):
    path, _ = vocabulary("byte_bpe_50k.tiktoken")
    docs = spark.createDataFrame([(1, "a b", 7, 8)], "doc_id long, text string, _counts int, _COUNTS_ int")
    row = piece_counts.count_tokens(docs, path).first()
    assert (row["_counts"], row["_COUNTS_"], row["n_words"]) == (7, 8, 2)


def test_piece_counter_unknown_and_backtracking():
    entries = [b"ab", b"abcd", b"c", b"d", b"a", b"cde", b"e"]
    counter = piece_counts.PieceCounter(entries)
    assert [counter.count(w) for w in (b"abcd", b"abce", b"abc", b"abcde", b"abx", b"", b"aab")] == [1, 2 + 1, 2, 2, 1, 0, 2]


def test_quality_on_planted_labels(spark, empty):
    rng = random.Random(1)
    rows = []
    for i in range(400):
        bad = i % 4 == 0
        w = words(rng, 60, 500)
        rows.append((i, " ".join(x + "!!" for x in w) if bad else " ".join(w), "en", "s", 0))
    rows += [(1000, None, None, None, None), (1001, "", None, None, None), (None, "w1 w2", None, None, None)]
    frame = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in CLASH})
    labels = spark.createDataFrame([(i, 0 if i % 4 == 0 else 1, 0) for i in range(400)] + [(5, None, 0), (None, 1, 0), (7, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    got = quality.scored(frame, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 400]
    assert held and np.mean([r.predicted == (r.doc_id % 4 != 0) for r in held]) > 0.97
    kept = quality.keep_good(frame, labels)
    assert kept.columns == frame.columns
    assert {r.doc_id for r in kept.collect()} >= {i for i in range(400) if i % 4 and i % 40}
    assert quality.scored(empty, labels).count() == 0
    none = quality.scored(frame, labels.where("false")).collect()
    assert {round(r.score, 6) for r in none} == {0.5}


def test_warc(spark):
    html = "<p>" + "é" * 60 + "</p>\r\n\r\nWARC/1.1\r\n"
    rows = [
        (5, "http://B.example.com/x?y#z", html), (2, "https://b.example.com/x?y", html), (9, None, html), (None, "http://a/", html),
        (3, "http://a.org/\r\nInjected: 1", "short"), (4, "u", "short"), (7, "", None), (8, "http://c/", ""), (2, "http://d/", html),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("x"))
    got = warc.archived(pages).orderBy("range_id", "range_pos").collect()
    assert len(got) == len(rows)
    keys = [(r.url_key, r.captured) for r in got]
    assert keys == sorted(keys)
    size, digest = len(html.encode()), hashlib.sha256(html.encode()).hexdigest()
    seen = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got)
    nothing, short = hashlib.sha256(b"").hexdigest(), hashlib.sha256(b"short").hexdigest()
    assert seen == Counter({
        (5, size, digest, "revisit", 2): 1, (2, size, digest, "response", None): 2, (9, size, digest, "revisit", 2): 1,
        (None, size, digest, "revisit", 2): 1, (3, 5, short, "response", None): 1, (4, 5, short, "response", None): 1,
        (7, 0, nothing, "response", None): 1, (8, 0, nothing, "response", None): 1,
    })
    assert warc.archived(pages.where("false")).count() == 0


def test_loser_tree():
    rng = random.Random(3)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(20))) for _ in range(k)]
        merged = [runs[r][p] for r, p in warc.LoserTree(runs)]
        assert merged == sorted(x for run in runs for x in run)


def test_fingerprints(docs, empty):
    got = fingerprints.compared(docs).collect()
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    order = sorted({(-1 if r.doc_id is None else r.doc_id, r.text or "") for r in rows}, key=lambda x: -x[0])
    following = {a: b for a, b in zip(order, order[1:] + order[:1])}
    prints = {}
    for r in got:
        own = next(x for x in order if x[0] == (-1 if r.doc_id is None else r.doc_id))
        k = len(own[1]) // 3
        edited = own[1][:len(own[1]) - k] + following[own][1][:k]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and r.n_chars == len(own[1])
        assert prints.setdefault(own[1], r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if edited == own[1]:
            assert r.near_edited == 1 and r.fingerprint == r.edited_fingerprint
    assert np.mean([r.near_edited for r in got]) > 0.2 + np.mean([r.near_next for r in got if r.near_next < 1])
    assert fingerprints.compared(empty).count() == 0


def test_fingerprint_band_counts_terms(spark):
    """The band is that of terms: a word of one document changes nothing, whatever class of hashes it falls in."""
    rng = random.Random(4)
    base = [words(rng, 40, 60) for _ in range(30)]
    known = sorted({w for b in base for w in b})
    hashed = lambda frame: frame.withColumn("h", F.xxhash64("w"))
    low = (F.col("h").bitwiseAND(F.lit((1 << 18) - 1))).alias("class")
    classes = hashed(spark.createDataFrame([(w,) for w in known], "w string")).select(low)
    fresh = hashed(spark.range(400_000).select(F.concat(F.lit("once"), "id").alias("w")))
    twins = [r.w for r in fresh.select("w", low).join(F.broadcast(classes), "class", "left_semi").select("w").collect()]
    assert len(twins) >= 20
    texts = [" ".join(b) for b in base] + [" ".join(base[k] + [w]) for k, w in enumerate(twins[:20])]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, "Own words w1 w2"), (99, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in fingerprints.compared(docs).collect()}
    assert all(got[k].fingerprint == got[30 + k].fingerprint for k in range(20))
    # every fingerprint against one whose terms were kept by a count in plain Python
    order = sorted(set(rows), key=lambda x: -1 if x[0] is None else x[0], reverse=True)
    edited = []
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        t, k = t or "", len(t or "") // 3
        edited.append((i, t, t[:len(t) - k] + (after or "")[:k]))
    df = Counter(w for _, t in rows for w in set((t or "").lower().split()))
    least, most = fingerprints.limits(len(rows))
    seen = {w for _, a, b in edited for w in (a + " " + b).lower().split()}
    out = [(w,) for w in seen if not least <= df[w] <= most]
    outside = F.lit([r.h for r in hashed(spark.createDataFrame(out, "w string")).collect()])
    frame = spark.createDataFrame(edited, "doc_id long, a string, b string")
    for text, name in (("a", "fingerprint"), ("b", "edited_fingerprint")):
        want = fingerprints.subset_hashes(frame, text, [], outside, "p").select("doc_id", fingerprints.printed("p").alias("p"))
        assert {r.doc_id: r.p for r in want.collect()} == {i: getattr(r, name) for i, r in got.items()}


def test_fingerprint_rare_terms_by_join(spark):
    """Beyond two documents the rare terms come by a join, with the same result as counted keys give."""
    rows = [(i, " ".join(["all", f"a{i // 2}", f"b{i}", f"c{i // 3}"])) for i in range(12)]
    base = spark.createDataFrame(rows, "id long, text string").withColumn("tie", F.xxhash64("text"))
    counts = fingerprints.frequencies(base)
    name = {r.h: r.w for r in spark.createDataFrame([(w,) for w in {w for _, t in rows for w in t.split()}], "w string")
            .select("w", F.xxhash64("w").alias("h")).collect()}
    for low, first in ((2.5, "ab"), (3.5, "abc")):
        got = {frozenset(name[h] for h in r.rare) for r in fingerprints.rare_terms(base, counts, low).collect()}
        assert got == {frozenset(w for w in t.split() if w[0] in first and w != "all") for _, t in rows}


def brute_components(rows, size, percent):
    sets = []
    for _, text in rows:
        w = split(text)
        sets.append({tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if sets[a] and 100 * common >= percent * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    low = {}
    for i, (doc_id, _) in enumerate(rows):
        known = [x for x in (low.get(root(i)), doc_id) if x is not None]
        low[root(i)] = min(known, default=None)
    return Counter((rows[i][0], len(sets[i]), low[root(i)]) for i in range(len(rows)))


@pytest.mark.parametrize("size,percent", [(3, 90), (5, 80)])
def test_jaccard_join(docs, empty, size, percent):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = jaccard_join.joined(docs, size, percent).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows, size, percent)
    if size == 5:
        kept = jaccard_join.one_per_component(docs, size, percent)
        assert kept.columns == docs.columns
        want = brute_components(rows, size, percent)
        whole = sum(n for (_, k, _), n in want.items() if k == 0)
        assert kept.count() == len({c for _, k, c in want if k}) + whole
        assert jaccard_join.joined(empty).count() == 0 and jaccard_join.one_per_component(empty).count() == 0


def test_jaccard_join_near_the_threshold():
    """Sets at the edge of linking always share a signature."""
    rng = np.random.default_rng(4)
    for percent in (80, 90):
        bands = jaccard_join.Bands(percent)
        for n in (*range(1, 60), 100, 333, 1000):
            one = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            for extra in range(0, n * (100 - percent) // percent + 1, max(1, n // 40)):
                for lost in range(0, n + 1, max(1, n // 40)):
                    two = np.unique(np.concatenate([one[lost:], rng.integers(0, 1 << 63, extra, dtype=np.uint64)]))
                    if not len(two) or 100 * (n - lost) < percent * (n + extra):
                        break
                    sig, owner = jaccard_join.signatures([one, two], bands)
                    same = one.tobytes() == two.tobytes()
                    assert same or set(sig[owner == 0].tolist()) & set(sig[owner == 1].tolist()), (percent, n, lost, extra)


@pytest.mark.parametrize("chunk", [1_000_000, 40])
def test_components(spark, monkeypatch, chunk):
    monkeypatch.setattr(components, "CHUNK", chunk)
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(80)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}


def test_mixing(docs, empty, spark):
    rows = mixing.mixed(docs).collect()
    assert len(rows) == docs.count() and all(0 <= r.probability <= 1 for r in rows)
    assert {r.source for r in rows} >= {"(none)"}
    assert mixing.sample(docs).columns == docs.columns
    assert mixing.mixed(empty).count() == 0 and mixing.sample(empty).count() == 0
    rng = random.Random(9)
    made = [(i, " ".join(words(rng, 200)), "en" if rng.random() < 0.8 else "de", "a" if rng.random() < 0.7 else "b", 0)
            for i in range(400)]
    frame = spark.createDataFrame(made, DOCS)
    goal = {"source": {"a": 0.5, "b": 0.5, "absent": 1.0}, "lang": {"en": 0.7, "de": 0.3}}
    mixed = mixing.mixed(frame, targets=goal, limit=4.0).toPandas()
    share = lambda c, v: (mixed.weight * mixed.tokens)[mixed[c] == v].sum() / (mixed.weight * mixed.tokens).sum()
    assert abs(share("source", "a") - 0.5) < 1e-3 and abs(share("lang", "de") - 0.3) < 1e-3


def test_near_copies_without_ids(spark):
    """Components whose ids are all null stay apart; one row of each is kept, and every empty set."""
    rng = random.Random(6)
    a, b, c, d = (" ".join(words(rng, 80, 10**6)) for _ in range(4))
    rows = [(None, a), (None, a + " tail"), (None, b), (None, c), (7, c), (7, d), (7, d), (7, ""), (7, None), (None, ""), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = [tuple(r) for r in jaccard_join.one_per_component(docs).collect()]
    assert sum(1 for _, t in kept if t in (a, a + " tail")) == 1
    assert Counter(x for x in kept if x[1] in (b, c, d)) == Counter([(None, b), (7, c), (7, d)])
    assert Counter(x for x in kept if not x[1]) == Counter(x for x in rows if not x[1])


def test_sample_of_repeated_and_null_ids(spark):
    """Rows of one id in different cells are sampled as their own cell says, all of them."""
    rng = random.Random(7)
    rows = []
    for i in range(300):
        for source, n in (("big", 200), ("small", 40)):
            rows += [(None if i % 10 == 0 else i, f"n{i} " + " ".join(words(rng, n)), source)] * (2 if i % 3 == 0 else 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("lang", F.lit("en")).repartition(3)
    goal = {"targets": {"source": {"big": 0.3, "small": 0.7}}}
    sampled = Counter((r.doc_id, r.source) for r in mixing.mixed(docs, **goal).where("sampled").collect())
    ids = lambda s: {i for i, x in sampled if x == s}
    assert ids("big") != ids("small") and ids("big") | ids("small") < {r[0] for r in rows}
    kept = Counter(tuple(r) for r in mixing.sample(docs, **goal).select("doc_id", "text", "source").collect())
    assert kept == Counter(r for r in rows if (r[0], r[2]) in sampled)


def test_passages(docs, empty, texts):
    got = passages.repeated_passages(docs).collect()
    rows = [(k, r.doc_id, split(r.text)) for k, r in enumerate(docs.select("doc_id", "text").collect())]
    seen = defaultdict(set)
    for k, _, w in rows:
        for a in range(len(w) - 49):
            seen[tuple(w[a:a + 50])].add(k)
    want = {rows[k][1] for ks in seen.values() if len(ks) > 1 for k in ks}
    flagged = {r.doc_id for r in got}
    assert want <= flagged
    clean = {i for i, t in texts if len(split(t)) == 20_000} | {None}
    assert not clean & flagged
    sizes = {i: len(w) for _, i, w in rows}
    assert all(0 <= r.start_word < r.end_word <= sizes[r.doc_id] for r in got)
    assert passages.repeated_passages(empty).count() == 0


def test_passages_with_partial_overlaps(spark):
    """Documents that hold only the first part of a passage do not hide those that share all of it."""
    rng = random.Random(3)
    rows, whole = [], set()
    for n, part in ((50, 40), (60, 48)) * 12:
        passage = words(rng, n, 10**7)
        whole |= {len(rows), len(rows) + 1}
        made = [passage, passage] + [passage[:part] + words(rng, 30, 10**7) for _ in range(4)]
        for text in made:
            rows.append((len(rows), " ".join(words(rng, 20, 10**7) + text + words(rng, 20, 10**7))))
    seen = defaultdict(set)
    for i, text in rows:
        w = text.split()
        for a in range(len(w) - 49):
            seen[tuple(w[a:a + 50])].add(i)
    assert {i for ids in seen.values() if len(ids) > 1 for i in ids} == whole
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id for r in got} == whole
    assert all(r.with_doc == r.doc_id ^ 1 and r.partners == 1 for r in got if r.doc_id % 6 < 2)


def test_near_passages_at_the_limit(spark):
    """One changed word in a passage of 50 leaves a similarity of 41 / 51; every pair is found."""
    rng = random.Random(11)
    rows = []
    for _ in range(60):
        one = words(rng, 50, 10**7)
        two = one[:]
        two[rng.randrange(5, 45)] = "changed"
        for text in (one, two):
            rows.append((len(rows), " ".join(words(rng, 20, 10**7) + text + words(rng, 20, 10**7))))
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id for r in got} == set(range(len(rows)))
    assert all(r.with_doc == r.doc_id ^ 1 for r in got)


def test_near_passages_beside_partial_overlaps(spark, monkeypatch):
    """Documents with a part of a passage, first in its groups, hide no pair that is similar on the whole."""
    monkeypatch.setattr(passages, "BLOCK", 2)
    rng = random.Random(13)
    rows, whole = [], set()
    for n in range(20):
        passage = words(rng, 50, 10**7)
        near = passage[:]
        near[20 + n % 10] = "changed"
        whole |= {len(rows), len(rows) + 1}
        made = [passage, near]
        for k in range(12):
            made += [passage[:39] + words(rng, 11, 10**7), words(rng, 11, 10**7) + passage[11:]]
        for text in made:
            rows.append((len(rows), " ".join(words(rng, 20, 10**7) + text + words(rng, 20, 10**7))))
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id for r in got} == whole
    assert all(r.with_doc == r.doc_id + (1, -1)[r.doc_id % 26] for r in got)


def test_matching_parts_lose_no_similar_window():
    """Every 46 tokens that are similar and end in common tokens are in a part, wherever the spans differ besides."""
    rng = np.random.default_rng(23)
    least, share = passages.WORDS - passages.SIZE + 1, 0.8
    for trial in range(60):
        n = int(rng.integers(46, 200))
        one = rng.integers(2, 1 << 32, n).astype(np.uint32) if trial % 3 else rng.integers(2, 60, n).astype(np.uint32)
        two = one.copy()
        for at in rng.choice(n, int(rng.integers(0, n // 8)), replace=False):  # a changed word changes five tokens
            two[at:at + 5] = rng.integers(2, 1 << 32, len(two[at:at + 5]))
        parts = passages.matching_parts(one, two, least, share)
        for s in range(n - least + 1):
            mine = set(one[s:s + least].tolist())
            there = [k for k in range(max(0, s - 16), min(n, s + least + 16)) if int(two[k]) in mine]
            if not {int(one[s]), int(one[s + least - 1])} <= set(two.tolist()):
                continue
            yours = set(two[there[0]:there[-1] + 1].tolist()) if there else set()
            if len(mine & yours) >= share * len(mine | yours) - 1e-9:
                assert any(set(range(s, s + least)) <= covered for covered in joined(parts)), (trial, s)


def joined(parts):
    """The places of overlapping parts, together."""
    out = []
    for a, b, *_ in sorted(parts):
        if out and a <= max(out[-1]) + 1:
            out[-1] |= set(range(a, b + 1))
        else:
            out.append(set(range(a, b + 1)))
    return out


def test_a_passage_beside_text_that_differs_more(spark):
    """The rest of the span has the longer gaps or as long ones, before and after: the passage is found all the same."""
    rng = random.Random(29)
    rows = []
    for k in range(24):
        one = words(rng, 150, 10**7)
        two = one[:]
        for at in (25, *range(52, 150, 6)):  # the first 50 words are similar, the rest is not
            two[at] = f"new{at}"
        if k % 2:
            one, two = one[::-1], two[::-1]
        for text in (one, two):
            rows.append((len(rows), " ".join(words(rng, 20, 10**7) + text + words(rng, 20, 10**7))))
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id for r in got} == set(range(len(rows)))
    assert all(r.with_doc == r.doc_id ^ 1 for r in got)


def test_near_copies_are_not_paired_out(spark):
    """Copies of a passage with one changed word are all found, with a few partners each, beside parts that come first."""
    rng = random.Random(17)
    passage = words(rng, 50, 10**7)
    made = [passage[:25] + words(rng, 1, 10**7) + passage[26:] for _ in range(30)]
    for _ in range(100):
        made += [passage[:39] + words(rng, 11, 10**7), words(rng, 11, 10**7) + passage[11:]]
    rows = [(i, " ".join(words(rng, 20, 10**7) + w + words(rng, 20, 10**7))) for i, w in enumerate(made)]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert set(range(30)) <= {r.doc_id for r in got}
    assert sum(r.partners for r in got if r.doc_id < 30) <= 8 * 30


def test_passages_mark_every_equal_word(spark):
    """Every word of a 50-word sequence that another document has is marked, runs of one word too."""
    rng = random.Random(5)
    line, frequent = words(rng, 30, 10**7), words(rng, 12, 10**7)
    made = []
    for i in range(60):
        w = words(rng, rng.randrange(0, 60), 10**7) + line[:rng.randrange(5, 30)] + frequent * 2
        for _ in range(rng.randrange(0, 3)):
            if made:
                other = rng.choice(made)
                a = rng.randrange(0, max(1, len(other) - 49))
                w += words(rng, 3, 10**7) + other[a:a + rng.randrange(40, 120)]
        made.append(w + words(rng, 30, 10**7))
    made += [words(rng, 30, 10**7) + ["same"] * n + words(rng, 30, 10**7) for n in (120, 120, 75)]
    want = [set() for _ in made]
    seen = defaultdict(list)
    for i, w in enumerate(made):
        for a in range(len(w) - 49):
            seen[tuple(w[a:a + 50])].append((i, a))
    for places in seen.values():
        if len({i for i, _ in places}) > 1:
            for i, a in places:
                want[i] |= set(range(a, a + 50))
    rows = [(i, " ".join(w)) for i, w in enumerate(made)]
    got = [set() for _ in made]
    for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect():
        got[r.doc_id] |= set(range(r.start_word, r.end_word))
    assert all(x <= y for x, y in zip(want, got))
    assert [(min(x), max(x)) for x in got[-3:]] == [(30, 149), (30, 149), (30, 104)]
    assert sum(map(len, got)) <= 1.25 * sum(map(len, want))  # a similarity of 0.8 lets a passage outgrow its equal part by that


def test_pieces_hold_the_minima_of_every_start():
    """Trees of a run of texts equal those of each text; each start is in one piece a pair, with both its minima."""
    rng = np.random.default_rng(2)
    h = words_module.mix(rng.integers(0, 200, 900).astype(np.uint64))
    h[300:420] = h[300]
    first, last = np.array([0, 250, 296]), np.array([249, 295, 899])
    brute = {(a + x, a + c, a + y) for a, b in zip(first.tolist(), last.tolist())
             for x, c, y in passages.compact_windows(h[a:b + 1], 46)}
    assert {tuple(x) for x in passages.run_windows(h, first, last, 46).tolist()} == brute
    value, text, a, b, c = passages.pieces(h, first, last, 46)
    by_start, starts = defaultdict(list), Counter()
    for v, t, x, y, m in zip(value.tolist(), text.tolist(), a.tolist(), b.tolist(), c.tolist()):
        assert first[t] <= x <= m <= x + 45 and y + 45 <= last[t]
        for s in range(x, y + 1):
            starts[s] += 1
            by_start[tuple(h[s:s + 46].tolist())].append(v)
    assert starts == {s: 6 for f, e in zip(first.tolist(), last.tolist()) for s in range(f, e - 44)}
    assert all(len(set(v)) == 6 for v in by_start.values())
    same = passages.content_hashes(h, 46)
    assert len(same) == 855 and len(set(same.tolist())) == len({tuple(h[s:s + 46].tolist()) for s in range(855)})


def test_compact_windows():
    rng = np.random.default_rng(6)
    for n, top in ((1, 5), (40, 3), (60, 1000), (200, 8)):
        h = rng.integers(0, top, n).astype(np.uint64)
        brute = set()
        for c in range(n):
            lo = c
            while lo > 0 and h[lo - 1] > h[c]:
                lo -= 1
            hi = c
            while hi + 1 < n and h[hi + 1] >= h[c]:
                hi += 1
            if hi - lo + 1 >= 5:
                brute.add((lo, c, hi))
        assert set(passages.compact_windows(h, 5)) == brute == set(passages._windows_by_stack(h.tolist(), 5))


def test_sharding(spark, docs, empty):
    rows = sharding.sharded(spark, docs, n_shards=4).collect()
    assert len(rows) == docs.count()
    places = defaultdict(list)
    for r in rows:
        places[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 4)
    assert all(sorted(v) == list(range(len(v))) for v in places.values()) and set(places) <= set(range(4))
    ids = defaultdict(set)
    for r in rows:
        ids[r.record.doc_id].add(r.shard)
    assert all(len(v) == 1 for v in ids.values())
    assert Counter(r.record.text for r in rows) == Counter(r.text for r in docs.collect())
    assert sharding.sharded(spark, empty).count() == 0


def test_every_operator_has_a_query():
    assert [sum(q.startswith(f"op{n}_") for q in QUERIES) for n in range(1, 14)] == [1] * 13


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        path = f"{tmp_path}/{name}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert now <= ids and now
        ids = now
        if name != "byte_bpe":
            assert docs.columns == columns
    assert docs.where("round_trip").count() == docs.count() == len(ids)


def test_pipeline_stages_take_odd_rows(spark, docs, empty):
    import corpus_pipeline

    rows = docs.select(*[f.split()[0] for f in DOCS.split(", ")])
    assert isinstance(rows.schema["doc_id"].dataType, T.LongType)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "/root/testdata/sf0.001").count() == 0
        # the labels are those of other texts, so the classifier may reject anything here
        assert stage(spark, rows, "/root/testdata/sf0.001").count() > 0 or name == "quality_classifier"


def test_rows_of_a_text_are_listed_before_they_are_joined(spark, monkeypatch):
    monkeypatch.setattr(passages, "SPANS", 4)
    nodes = spark.createDataFrame([(7, 70), (8, 80), (9, None)], "node long, id long")
    wanted = spark.createDataFrame([(n, k, -k) for n, size in ((7, 9), (8, 4), (9, 1)) for k in range(size)], "node long, pair long, start long")
    found = passages.lists_by_text(nodes, wanted, ["pair", "start"])
    got = found.collect()
    assert sorted((r["node"], r["_id"], len(r["pair"])) for r in got if r["node"] != 9) == [(7, 70, 1), (7, 70, 4), (7, 70, 4), (8, 80, 4)]
    assert sorted(k for r in got if r["node"] == 7 for k in r["pair"]) == list(range(9))
    assert all(s == -k for r in got for k, s in zip(r["pair"], r["start"])) and [r["_id"] for r in got if r["node"] == 9] == [None]
    lines = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    joins = [n for n, line in enumerate(lines) if "Join" in line]
    assert len(joins) == 1 and any("Aggregate" in line for line in lines[joins[0]:])
