"""Audio catalogue and sample chunks of PCM / float WAV files."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.waves import Waves
from ..plans.session import cut_lineage
from .ranges import RANGE_BYTES, list_files, open_file, spread_rows

CHUNKS = "recording_id string, chunk_idx bigint, samplerate int, samples array<float>"


WAV_FILES = "*.[wW][aA][vV]"


@dataclass(frozen=True)
class WavFormat:
    """What the header of a WAV file says; ``data_start`` is the 0-based place of the first sample byte."""

    format_code: int
    channels: int
    samplerate: int
    bits: int
    data_bytes: int
    data_start: int

    @property
    def frame(self) -> int:
        return self.channels * self.bits // 8

    @property
    def n_samples(self) -> int:
        return self.data_bytes // self.frame


#: (format code, bits) → full scale. 8-bit samples are unsigned around 128.
FULL_SCALE = {(1, 8): 2.0**7, (1, 16): 2.0**15, (1, 24): 2.0**23, (1, 32): 2.0**31, (3, 32): 1.0, (3, 64): 1.0}
EXTENSIBLE = 0xFFFE
#: Stands for a size that another chunk holds.
NO_SIZE = 0xFFFFFFFF
BLOCK = 1 << 20


def parse_wav(file: BinaryIO, length: int) -> WavFormat:
    """Walk the RIFF chunks by id and size, seeking from one to the next; ValueError names what is wrong.

    Chunks may come in any order and number before the samples. An extensible
    format names its code in the first two bytes of its sub-format. Files over 4 GB (RF64) give the size
    of their samples in a chunk of its own. A data chunk that claims more than the file holds ends with the file.
    """
    file.seek(0)
    top = file.read(12)
    if top[:4] not in (b"RIFF", b"RF64") or top[8:12] != b"WAVE":
        raise ValueError("not a RIFF WAVE file")
    at, kind, data, large = 12, None, None, None
    while at + 8 <= length and (kind is None or data is None):
        file.seek(at)
        tag, size = struct.unpack("<4sI", file.read(8))
        body = at + 8
        if tag == b"ds64" and size >= 16:
            large = struct.unpack("<QQ", file.read(16))[1]
        elif tag == b"fmt " and size >= 16 and body + 16 <= length:
            head = file.read(min(size, 40))
            code, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", head)
            if code == EXTENSIBLE and len(head) >= 26:
                code = struct.unpack_from("<H", head, 24)[0]
            kind = (code, channels, rate, bits)
        elif tag == b"data":
            if size == NO_SIZE and large is not None:
                size = large
            data = (min(size, length - body), body)
        at = body + size + size % 2
    if kind is None:
        raise ValueError("no format chunk")
    if data is None:
        raise ValueError("no data chunk")
    code, channels, rate, bits = kind
    if (code, bits) not in FULL_SCALE or not channels or not rate:
        raise ValueError(f"unsupported format: code {code}, {bits} bits, {channels} channels, {rate} Hz")
    return WavFormat(code, channels, rate, bits, *data)


def first_channel(raw: bytes, form: WavFormat) -> np.ndarray:
    """float32 samples of channel 0 from the bytes of whole frames."""
    raw = np.frombuffer(raw, np.uint8).reshape(-1, form.frame)
    raw = raw[:, : form.bits // 8]
    if form.bits == 8:
        values = raw[:, 0].astype(np.float64) - 128
    elif form.bits == 24:
        wide = np.zeros((len(raw), 4), np.uint8)
        wide[:, 1:] = raw
        values = wide.view("<i4")[:, 0] / 256.0
    else:
        values = np.ascontiguousarray(raw).view(("<f" if form.format_code == 3 else "<i") + str(form.bits // 8))[:, 0]
    return (values / FULL_SCALE[form.format_code, form.bits]).astype(np.float32)


def _headers(spark: SparkSession, path: str, pattern: str, hashes: bool = True) -> DataFrame:
    """One row per file: path, hash, header fields, and ``error`` for files that cannot be read.

    The header takes a few reads at the start; the hash reads the file once, block by block.
    """
    names = ["format_code", "channels", "samplerate", "bits", "data_bytes", "data_start"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, length in zip(batch["path"], batch["length"].tolist()):
                with open_file(name) as file:
                    try:
                        form, error = parse_wav(file, length), None
                    except ValueError as wrong:
                        form, error = None, str(wrong)
                    digest = hashlib.md5()
                    file.seek(0)
                    while hashes and (block := file.read(BLOCK)):
                        digest.update(block)
                rows.append((name, digest.hexdigest(), *[getattr(form, n) if form else -1 for n in names], error))
            yield pd.DataFrame(rows, columns=["path", "hash", *names, "error"])

    schema = "path string, hash string, " + ", ".join(
        f"{n} {'bigint' if n.startswith('data') else 'int'}" for n in names) + ", error string"
    size = F.col("length") if hashes else F.least(F.col("length"), F.lit(BLOCK))
    return spread_rows(cut_lineage(list_files(spark, path, pattern)), size).mapInPandas(run, schema)


def catalogue(spark: SparkSession, path: str, pattern: str = WAV_FILES) -> tuple[DataFrame, DataFrame]:
    """(recordings, unreadable files with their ``error``).

    Nothing but the header and the hash of a file leaves the task that reads it. Whatever
    ``sample_chunks`` cannot decode is in the second table.
    """
    rows = _headers(spark, path, pattern).dropDuplicates(["path"])
    frame = F.floor(F.col("channels") * F.col("bits") / 8)
    good = rows.where(F.col("error").isNull()).drop("error").withColumn(
        "file_name", F.url_decode(F.element_at(F.split("path", "/"), -1))
    ).withColumn("n_samples", F.floor(F.col("data_bytes") / frame)).withColumn(
        "duration", F.col("n_samples") / F.col("samplerate")
    )
    return good, rows.where(F.col("error").isNotNull()).select("path", "error")


RUN = ["path", "format_code", "channels", "samplerate", "bits", "data_bytes", "data_start", "step", "first", "last"]


def sample_runs(
    spark: SparkSession, path: str, chunk_seconds: float = 1.0, pattern: str = WAV_FILES, range_bytes: int = RANGE_BYTES
) -> DataFrame:
    """What to read: runs of chunks [first, last) of ``step`` samples, about ``range_bytes`` each, with the header of their file."""
    good = _headers(spark, path, pattern, hashes=False).where(F.col("error").isNull()).dropDuplicates(["path"])
    frame = F.floor(F.col("channels") * F.col("bits") / 8).cast("long")
    step = F.greatest(F.floor(F.col("samplerate") * F.lit(float(chunk_seconds))), F.lit(1)).cast("long")
    sized = good.withColumns({"frame": frame, "step": step}).withColumn("n", F.floor(F.col("data_bytes") / F.col("frame")))
    run_chunks = F.greatest(F.floor(F.lit(range_bytes) / (F.col("step") * F.col("frame"))), F.lit(1)).cast("long")
    chunks = F.ceil(F.col("n") / F.col("step"))
    return sized.withColumn("run", run_chunks).where("n > 0").withColumn(
        "first", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1, F.col("run")))).withColumn(
        "last", F.least(F.col("first") + F.col("run"), chunks)).select(*RUN)


def read_runs(runs: DataFrame) -> DataFrame:
    """Channel 0 of each run, chunk by chunk; a task seeks to its runs."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0  # short chunks leave the task together
        for batch in batches:
            for name, *numbers in batch[RUN].itertuples(index=False):
                *head, step, first, last = map(int, numbers)
                form = WavFormat(*head)
                with open_file(name) as file:
                    for k in range(first, last):
                        file.seek(form.data_start + k * step * form.frame)
                        count = min(step, form.n_samples - k * step)
                        samples = first_channel(file.read(count * form.frame), form)
                        held.append((name, k, form.samplerate, samples))
                        size += samples.nbytes
                        if size >= BLOCK or len(held) == 4096:
                            yield pd.DataFrame(held, columns=["recording_id", "chunk_idx", "samplerate", "samples"])
                            held, size = [], 0
        if held:
            yield pd.DataFrame(held, columns=["recording_id", "chunk_idx", "samplerate", "samples"])

    size = (F.col("last") - F.col("first")) * F.col("step") * F.floor(F.col("channels") * F.col("bits") / 8)
    return spread_rows(cut_lineage(runs), size).mapInPandas(read, CHUNKS)


def sample_chunks(
    spark: SparkSession, path: str, chunk_seconds: float = 1.0, pattern: str = WAV_FILES, range_bytes: int = RANGE_BYTES
) -> DataFrame:
    """Channel 0 as float32 chunks: (recording_id = path, chunk_idx, samplerate, samples).

    A recording of any length is read by many tasks, none of which holds more than a
    chunk. Files that do not decode give no rows; ``catalogue`` lists them.
    """
    return read_runs(sample_runs(spark, path, chunk_seconds, pattern, range_bytes))


def as_waves(chunks: DataFrame, samplerate: int, chunk_seconds: float = 1.0) -> Waves:
    """Chunks of recordings of one sample rate as ``Waves`` (key ``recording_id``)."""
    rows = chunks.where(F.col("samplerate") == samplerate).select(
        "recording_id", F.col("chunk_idx").alias("chunk"), F.col("samples").cast("array<double>").alias("samples"))
    return Waves(rows, max(1, int(samplerate * chunk_seconds)), "recording_id")


def chunk_samples(chunks: DataFrame, chunk_seconds: float = 1.0) -> DataFrame:
    """Long form: (recording_id, idx, x)."""
    step = F.floor(F.col("samplerate") * F.lit(chunk_seconds)).cast("bigint")
    return chunks.select("recording_id", "chunk_idx", step.alias("_n"), F.posexplode("samples").alias("_i", "x")).select(
        "recording_id", (F.col("chunk_idx") * F.col("_n") + F.col("_i")).alias("idx"), "x"
    )


def cut_clips(chunks: DataFrame, clips: DataFrame, chunk_seconds: float = 1.0) -> DataFrame:
    """Samples of each clip in [start, end): (clip_id, chunk_idx, samplerate, samples).

    A clip meets the chunks it touches by an equi-join on (recording, chunk)
    and takes a slice of each.
    """
    s = F.lit(float(chunk_seconds))
    wanted = clips.select(
        "clip_id", "recording_id", "clip_start", "clip_end",
        F.explode(F.sequence(F.floor(F.col("clip_start") / s), F.ceil(F.col("clip_end") / s) - 1)).alias("chunk_idx"),
    )
    rate = F.col("samplerate")
    step = F.floor(rate * s)
    base = F.col("chunk_idx") * step
    first = F.greatest(F.floor(F.col("clip_start") * rate + F.lit(0.5)) - base, F.lit(0))
    last = F.least(F.floor(F.col("clip_end") * rate + F.lit(0.5)) - base, F.size("samples").cast("bigint"))
    return (
        chunks.join(wanted, ["recording_id", "chunk_idx"])
        .withColumns({"_a": first, "_b": last}).where(F.col("_b") > F.col("_a"))
        .select(
            "clip_id", "recording_id", "chunk_idx", "samplerate",
            F.slice("samples", (F.col("_a") + 1).cast("int"), (F.col("_b") - F.col("_a")).cast("int")).alias("samples"),
        )
    )
