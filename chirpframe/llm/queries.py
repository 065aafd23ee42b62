"""Queries of the text operators, over whole tables, with SQL twins where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bpe, divergence, exact_dedup, fingerprints, jaccard_join, mixing, passages, piece_counts, quality, sharding, simhash,
    warc, whitening,
)
from .common import table, text_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return put


def vocabulary(name: str) -> tuple[str, str]:
    """Path and pattern of an installed public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


@query("op1_byte_bpe")
def op1_byte_bpe(spark, sf_dir):
    path, pattern = vocabulary("byte_bpe_multi_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, path, pattern, round_trip=True, keep=["doc_id"])
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op2_piece_counts")
def op2_piece_counts(spark, sf_dir):
    path, _ = vocabulary("byte_bpe_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return piece_counts.count_tokens(docs, path).select("doc_id", "n_words", "n_tokens")


@query("op3_exact_dedup", """
with rows as (
  select doc_id, length(coalesce(text, '')) as cp,
    sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) as text_sha256
  from documents),
best as (
  select text_sha256, count(*) as group_size, first(doc_id order by cp desc, doc_id) as keep_id
  from rows group by text_sha256)
select r.doc_id, b.keep_id, cast(b.group_size as bigint) as group_size, r.doc_id = b.keep_id as kept, r.text_sha256
from rows r join best b using (text_sha256)""")
def op3_exact_dedup(spark, sf_dir):
    found = exact_dedup.dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@query("op4_quality")
def op4_quality(spark, sf_dir):
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op5_warc_index", """
with p as (
  select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha256(coalesce(html, '')) as payload_digest
  from pages),
g as (
  select payload_digest, min(page_id) as low from p where payload_bytes >= 100 group by payload_digest)
select p.page_id, cast(p.payload_bytes as bigint) as payload_bytes, p.payload_digest,
  case when g.low is not null and g.low <> p.page_id then 'revisit' else 'response' end as record_type,
  case when g.low is not null and g.low <> p.page_id then g.low end as refers_to
from p left join g using (payload_digest)""")
def op5_warc_index(spark, sf_dir):
    return warc.archived(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query("op6_imatch")
def op6_imatch(spark, sf_dir):
    return fingerprints.compared(table(spark, sf_dir, "documents"))


@query("op7_jaccard_join", """
with recursive words as (
  select doc_id, [x for x in regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+') if x <> ''] as w
  from documents),
shingles as (
  select distinct doc_id, unnest(case when len(w) >= 3 then [array_to_string(w[i:i + 2], ' ') for i in range(1, len(w) - 1)]
    when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s
  from words),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
common as (
  select a.doc_id as x, b.doc_id as y, count(*) as c
  from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
links as (
  select x, y from common join sizes p on p.doc_id = x join sizes q on q.doc_id = y
  where 100 * c >= 90 * (p.n + q.n - c)),
both_ways as (select x, y from links union all select y, x from links),
reach(doc_id, other) as (
  select doc_id, doc_id from documents union select r.doc_id, b.y from reach r join both_ways b on b.x = r.other)
select d.doc_id, cast(coalesce(n, 0) as bigint) as n_shingles, r.low as component_id
from documents d left join sizes using (doc_id) join (select doc_id, min(other) as low from reach group by doc_id) r using (doc_id)""")
def op7_jaccard_join(spark, sf_dir):
    found = jaccard_join.joined(table(spark, sf_dir, "documents"), size=3, percent=90)
    return found.select("doc_id", "n_shingles", "component_id")


def _mixing_sql() -> str:
    """The rounds of ``mixing.rake`` written out as one common table expression per step."""
    steps, last = [], "targets"
    for number in range(mixing.ROUNDS):
        for dim in mixing.DIMS:
            have = f"sum(w * tokens) over (partition by {dim})"
            name = f"{dim}{number}"
            steps.append(f"{name} as (select * replace (case when {have} > 0 then w * t_{dim} / {have} else w end as w) from {last})")
            last = name
        steps.append(f"limited{number} as (select * replace (least(w, {mixing.LIMIT}) as w) from {last})")
        last = f"limited{number}"
    powers = ", ".join(
        f"pow(cast(sum(tokens) over (partition by {d}) as double), {mixing.TEMPERATURE}) as p_{d}" for d in mixing.DIMS)
    scaled = ", ".join(
        f"p_{d} * sum(tokens) over () / (select sum(x) from (select max(p_{d}) as x from powers group by {d})) as t_{d}"
        for d in mixing.DIMS)
    return f"""with base as (
  select doc_id, coalesce(source, '(none)') as source, coalesce(lang, '(none)') as lang, coalesce(text, '') as text,
    cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) as tokens,
    cast(cast('0x' || substr(md5('mix-' || coalesce(cast(doc_id as varchar), 'none')), 1, 13) as bigint) as double) / pow(2, 52) as draw
  from documents),
rows as (
  select doc_id, source, lang, tokens, draw, case when tokens = 0 then 'empty'
    when (length(text) - length(translate(text, '|', ''))) * 5 >= tokens then 'table'
    when length(text) - length(translate(text, '#$%&*!', '')) >= tokens then 'symbols'
    when tokens < 150 then 'short' when tokens < 600 then 'medium' else 'long' end as topic
  from base),
cells as (select source, lang, topic, cast(sum(tokens) as bigint) as tokens, cast(1 as double) as w from rows group by source, lang, topic),
powers as (select *, {powers} from cells),
targets as (select *, {scaled} from powers),
{", ".join(steps)}
select doc_id, source, lang, topic, r.tokens, round(w, 6) as weight, round(w / {mixing.LIMIT}, 6) as probability,
  draw < w / {mixing.LIMIT} as sampled
from rows r join {last} using (source, lang, topic)"""


@query("op8_source_mixing", _mixing_sql())
def op8_source_mixing(spark, sf_dir):
    return mixing.mixed(table(spark, sf_dir, "documents")).withColumns({
        "weight": F.round("weight", 6), "probability": F.round("probability", 6),
    })


@query("op9_repeated_passages")
def op9_repeated_passages(spark, sf_dir):
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


@query("op10_shards")
def op10_shards(spark, sf_dir):
    rows = sharding.sharded(spark, table(spark, sf_dir, "documents"), n_shards=24)
    text = F.col("record.text")
    return rows.select(
        F.col("record.doc_id").alias("doc_id"), sharding.size_of(text).alias("size"),
        F.crc32(text_of(text).cast("binary")).alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot",
        "grown_shard",
    )


@query("op11_source_divergence", """
with docs as (
  select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as found
  from documents),
uses as (select r, lang, source, unnest(found) as term from docs),
kept as (select lang, term from uses group by lang, term having count(distinct r) >= 3),
counts as (select lang, source, term, count(*) as c from uses join kept using (lang, term) group by lang, source, term),
groups as (
  select g.lang, g.source, coalesce(n, 0) as n, coalesce(v, 0) as v
  from (select distinct lang, source from docs) g
  left join (select lang, source, sum(c) as n from counts group by lang, source) using (lang, source)
  left join (select lang, count(*) as v from kept group by lang) using (lang)),
cells as (
  select g.lang, g.source, k.term, coalesce(c, 0) as c,
    cast(1 + cast(1000000000 as hugeint) * (coalesce(c, 0) + 1) // (n + v) as hugeint) as p
  from groups g join kept k using (lang) left join counts using (lang, source, term)),
whole as (
  select lang, term, cast(1 + cast(1000000000 as hugeint) * (sum(c) + 1) // (max(m) + max(v)) as hugeint) as q
  from counts join (select lang, sum(n) as m, max(v) as v from groups group by lang) using (lang) group by lang, term),
pairs as (
  select g.lang, g.source, h.source as item, coalesce(value, 0) as value
  from groups g join groups h on g.lang = h.lang and g.source <> h.source
  left join (
    select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value
    from cells a join cells b on a.lang = b.lang and a.term = b.term and a.source <> b.source
    group by a.lang, a.source, b.source) s on s.lang = g.lang and s.source = g.source and s.item = h.source),
terms as (
  select lang, source, term as item, (p - q) * (p - q) // q as value
  from cells join whole using (lang, term) where c > 0 and p > q),
parts as (select lang, source, 'pair' as part, item, value from pairs union all select lang, source, 'term', item, value from terms),
ranks as (
  select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from parts)
select lang, source, part, item, cast(value as bigint) as value, cast(rank as integer) as rank
from ranks where part = 'pair' or rank <= 200""")
def op11_source_divergence(spark, sf_dir):
    return divergence.audited(table(spark, sf_dir, "documents"))


@query("op12_whitening")
def op12_whitening(spark, sf_dir):
    found = whitening.whitened(table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").cast("long"))


@query("op13_simhash")
def op13_simhash(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.printed("fp").alias("fingerprint"), "component_id")
