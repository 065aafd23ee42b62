"""WARC archives from pages, and an index of their captures in global order.

Writing is a plain Spark text write: a record is one string, the separator of
the writer is the two line ends that close a WARC record, and files are gzipped
and bounded in records. Reading parses each archive by ``Content-Length``.

The index merges externally: captures of one archive form a run sorted by
(url key, time, page); runs are cut at common range borders, and every task
merges the slices of its range with a loser tree. Hot hosts and hot URLs are
cut too, because the borders also run through time and page id.

Defined cases: null html is an empty payload, null url an empty URL without a
target header. Control characters of a URL are percent-encoded. Payloads under ``MIN_REVISIT`` bytes never refer to
others. Rows that repeat the smallest page id of a group are all responses; a
null page id is written as an empty one and refers to the smallest id that is
not null (if no row of the group has an id, all are responses). An
empty table writes no record. Only page_id, url and html (and the date) are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import shared_path
from .common import join_checked, numbered, per_group, stored, text_of

MIN_REVISIT = 100
RECORDS_PER_FILE = 5_000
FIRST_CAPTURE = 1_704_067_200  # 2024-01-01, for pages without a date
END = "\r\n\r\n"
_CAPTURE = (
    "page_id long, url string, captured long, record_type string, refers_to long, payload_bytes long, "
    "payload_digest string, archive string, offset long, length long"
)


def url_key(url: Column) -> Column:
    """Sortable key: host labels reversed, ``)``, path and query; no scheme, user, port or fragment."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    host = F.regexp_replace(host, r"^www\.", "")
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(rest == "", "/").otherwise(rest))


def revisits(pages: DataFrame) -> DataFrame:
    """(row-wise page_id, refers_to) of pages whose payload a smaller page id has."""
    facts = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.sha2(text_of("html").cast("binary"), 256).alias("digest"),
        F.octet_length(text_of("html")).alias("bytes"),
    ).where(F.col("bytes") >= MIN_REVISIT)
    facts = stored(numbered(facts.drop("bytes")), "payloads")
    grouped = per_group(facts, ["digest"], {"low": F.min("page_id")}, {"low": F.min("low")})
    return grouped.where(~F.col("page_id").eqNullSafe(F.col("low")) & F.col("low").isNotNull()).select(
        F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), F.col("low").alias("_low")
    ).distinct()


def utc_text(seconds: str) -> Column:
    """Seconds since 1970 as a date in UTC, whatever the session's time zone."""
    plain = f"cast(timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, {seconds}) as string)"
    return F.concat(F.replace(F.expr(plain), F.lit(" "), F.lit("T")), F.lit("Z"))


def write_archives(pages: DataFrame, path: str, captured: Column | None = None) -> None:
    """One record per page under ``path``: responses with their payload, revisits with its digest only."""
    when = captured if captured is not None else F.coalesce(F.col("page_id"), F.lit(0)) + FIRST_CAPTURE
    base = pages.select(
        F.col("page_id").cast("long").alias("page_id"), text_of("url").alias("url"), text_of("html").alias("payload"),
        when.cast("long").alias("captured"),
    ).withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256))
    again = stored(revisits(pages), "revisits")
    rows = join_checked(
        base, again,
        F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest")), "left",
    )
    repeat = F.col("_low").isNotNull()
    size = F.octet_length("payload")
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    uri = F.regexp_replace(F.regexp_replace(F.col("url"), "\r", "%0D"), "\n", "%0A")
    uri = F.regexp_replace(uri, r"[\x00-\x1F\x7F]", "%00")
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        size.cast("string"), F.lit(END), F.when(repeat, "").otherwise(F.col("payload")),
    )
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(repeat, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), page, F.lit(">\r\nWARC-Date: "),
        utc_text("captured"),
        F.when(uri == "", "").otherwise(F.concat(F.lit("\r\nWARC-Target-URI: "), uri)),
        F.when(repeat, F.concat(
            F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
                  "\r\nWARC-Refers-To: <urn:page:"), F.col("_low").cast("string"), F.lit(">"),
        )).otherwise(""),
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("digest"),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length("block").cast("string"), F.lit(END), F.col("block"),
    )
    records = rows.withColumn("block", http).select(head.alias("value"))
    records.write.option("lineSep", END).option("compression", "gzip").option(
        "maxRecordsPerFile", RECORDS_PER_FILE
    ).text(path)


def _inflate(content: bytes) -> bytes:
    """Plain archives as they are, gzipped ones (also one member per record) inflated."""
    if content[:2] != b"\x1f\x8b":
        return content
    parts = []
    while content:
        unzip = zlib.decompressobj(31)
        parts.append(unzip.decompress(content))
        content = unzip.unused_data
    return b"".join(parts)


def _urn(value: bytes | None) -> int | None:
    digits = (value or b"").removeprefix(b"<urn:page:").rstrip(b">")
    return int(digits) if digits else None


def parse_archive(name: str, content: bytes) -> Iterator[tuple]:
    """Captures of one archive; offsets are those of the inflated file."""
    from hashlib import sha256
    from datetime import datetime, timezone

    data = _inflate(content)
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        fields = dict(line.split(b": ", 1) for line in data[at:stop].split(b"\r\n")[1:])
        begin = stop + 4
        end = begin + int(fields[b"Content-Length"])
        http_end = data.index(b"\r\n\r\n", begin) + 4
        http = dict(line.split(b": ", 1) for line in data[begin:http_end - 4].split(b"\r\n")[1:])
        kind = fields[b"WARC-Type"].decode()
        digest = fields[b"WARC-Payload-Digest"].decode().removeprefix("sha256:")
        if kind == "response":
            found = sha256(data[http_end:end]).hexdigest()
            if found != digest:
                raise ValueError(f"{name} at {at}: payload does not match its digest")
        when = datetime.strptime(fields[b"WARC-Date"].decode(), "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=timezone.utc)
        yield (
            _urn(fields[b"WARC-Record-ID"]), fields.get(b"WARC-Target-URI", b"").decode("utf-8"), int(when.timestamp()),
            kind, _urn(fields.get(b"WARC-Refers-To")), int(http[b"Content-Length"]), digest, name, at, end + 4 - at,
        )
        at = end + 4


_NAMES = [c.split()[0] for c in _CAPTURE.split(", ")]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=_NAMES)
    return frame.astype({"page_id": "Int64", "refers_to": "Int64"})


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for name, content in zip(batch["path"], batch["content"]):
            rows = list(parse_archive(name, content))
            if rows:
                yield _frame(rows)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Captures of all archives under ``path``; each task holds one archive at a time."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    return files.mapInPandas(_read, _CAPTURE)


class LoserTree:
    """k-way merge: inner nodes remember the loser of their match, the winner is at the top."""

    def __init__(self, runs: list[list]):
        self.runs = runs
        self.at = [0] * len(runs)
        self.k = max(1, len(runs))
        self.tree = [-1] * self.k
        for run in range(len(runs)):
            self._replay(run)

    def _beats(self, a: int, b: int) -> bool:
        if self.at[a] >= len(self.runs[a]):
            return False
        if self.at[b] >= len(self.runs[b]):
            return True
        return (self.runs[a][self.at[a]], a) < (self.runs[b][self.at[b]], b)

    def _replay(self, run: int) -> None:
        """Play from the leaf of ``run`` to the top; an empty node parks the climber while the tree fills."""
        node = (run + self.k) // 2
        while node > 0:
            if self.tree[node] == -1:
                self.tree[node] = run
                return
            if self._beats(self.tree[node], run):
                run, self.tree[node] = self.tree[node], run
            node //= 2
        self.tree[0] = run

    def __iter__(self) -> Iterator[tuple[int, int]]:
        """(run, place in the run) in merged order."""
        for _ in range(sum(map(len, self.runs))):
            run = self.tree[0]
            yield run, self.at[run]
            self.at[run] += 1
            self._replay(run)


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    frames = [b for b in batches if len(b)]
    if not frames:
        return
    rows = pd.concat(frames, ignore_index=True)
    low = -(1 << 62)
    key = list(zip(
        rows["url_key"].tolist(), rows["captured"].tolist(), rows["page_id"].astype("Int64").fillna(low).tolist(),
        rows["offset"].tolist(),
    ))
    runs, places = [], []
    for index in rows.groupby("archive", sort=True).indices.values():
        run = [key[i] for i in index]
        if any(a > b for a, b in zip(run, run[1:])):  # a fetch may deliver a slice in pieces
            index = np.array(sorted(index.tolist(), key=key.__getitem__))
            run = [key[i] for i in index]
        runs.append(run)
        places.append(index)
    order = np.fromiter((places[r][p] for r, p in LoserTree(runs)), np.int64, len(rows))
    out = rows.iloc[order].assign(range_id=TaskContext.get().partitionId(), range_pos=np.arange(len(rows)))
    for a in range(0, len(out), 10_000):
        yield out.iloc[a:a + 10_000]


def capture_history(captures: DataFrame, ranges: int | None = None) -> DataFrame:
    """All captures in one global order: by range_id, then range_pos.

    ``captures`` gains ``url_key`` and is first stored as runs, each archive's captures sorted.
    """
    spark = captures.sparkSession
    keyed = captures.withColumn("url_key", url_key(F.col("url")))
    runs = stored(keyed.sortWithinPartitions("archive", "url_key", "captured", "page_id", "offset"), "runs")
    n = ranges or max(int(spark.conf.get("spark.sql.shuffle.partitions")), runs.count() // 250_000 + 1)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in runs.schema)
    cut = runs.repartitionByRange(n, "url_key", "captured", "page_id", "archive", "offset")
    return cut.mapInPandas(_merge, schema + ", range_id int, range_pos long")


def archived(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the shared folder, read them back and merge the index."""
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write_archives(pages, path)
    return capture_history(read_archives(spark, path))
