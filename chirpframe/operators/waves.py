"""Waveforms as rows of chunk arrays.

``Waves.rows`` is (clip_id, chunk, samples): chunk k holds samples
``[k * size, (k + 1) * size)`` of the clip, and only a clip's last chunk may be
shorter. Steps work inside the arrays. What crosses a chunk border (a frame of a
spectrum, an echo) travels as a short halo of border samples; statistics of a
clip are sums over chunks. There is never a row per sample, unless ``to_samples``
is asked for.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import coords
from ..plans.stats import attach
from ..plans.tiles import spread

CLIP = "clip_id"
CHUNK = 1 << 16


@dataclass(frozen=True)
class Waves:
    rows: DataFrame
    size: int = CHUNK
    key: str = CLIP

    def with_rows(self, rows: DataFrame) -> Waves:
        return Waves(rows.select(self.key, "chunk", "samples"), self.size, self.key)

    def lengths(self) -> DataFrame:
        """(clip, n_samples, n_chunks)."""
        return self.rows.groupBy(self.key).agg(
            F.sum(F.size("samples")).cast("bigint").alias("n_samples"), (F.max("chunk") + 1).cast("bigint").alias("n_chunks"))


# --- rows and pieces -------------------------------------------------------

def join_pieces(pieces: DataFrame, size: int = CHUNK, key: str = CLIP) -> Waves:
    """Waves from pieces (clip, start, samples) that follow each other without gaps, in any cut.

    A piece is sliced at chunk borders; the slices of a chunk meet in one row.
    """
    start, n = F.col("start"), F.size("samples")
    rows = spread(pieces.where(n > 0), "chunk", F.floor(start / size), F.floor((start + n - 1) / size))
    low = F.greatest(F.col("chunk") * size - start, F.lit(0))
    high = F.least((F.col("chunk") + 1) * size - start, n)
    part = F.struct((start + low).alias("at"), F.slice("samples", (low + 1).cast("int"), (high - low).cast("int")).alias("part"))
    chunks = rows.groupBy(key, "chunk").agg(F.array_sort(F.collect_list(part)).alias("_parts"))
    return Waves(chunks.select(key, "chunk", F.flatten(F.transform("_parts", lambda p: p["part"])).alias("samples")), size, key)


def from_samples(samples: DataFrame, size: int = CHUNK, key: str = CLIP, value: str = "x") -> Waves:
    """Waves from one row per sample (clip, idx, x)."""
    return join_pieces(samples.select(key, F.col("idx").alias("start"), F.array(value).alias("samples")), size, key)


def to_samples(waves: Waves, value: str = "x") -> DataFrame:
    """(clip, idx, x)."""
    return waves.rows.select(waves.key, "chunk", F.posexplode("samples").alias("_i", value)).select(
        waves.key, (F.col("chunk") * waves.size + F.col("_i")).cast("bigint").alias("idx"), value)


# --- steps -----------------------------------------------------------------

def center(waves: Waves) -> Waves:
    """Subtract the mean of the clip."""
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x)
    means = waves.rows.groupBy(waves.key).agg((F.sum(total) / F.sum(F.size("samples"))).alias("_mean"))
    rows = attach(waves.rows, means, [waves.key])
    return waves.with_rows(rows.withColumn("samples", F.transform("samples", lambda x: x - F.col("_mean"))))


def peak_normalize(waves: Waves) -> Waves:
    """Divide by the largest magnitude of the clip; silent clips stay 0."""
    top = F.aggregate("samples", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))
    peaks = waves.rows.groupBy(waves.key).agg(F.max(top).alias("_peak"))
    rows = attach(waves.rows, peaks.withColumn("_peak", F.when(F.col("_peak") == 0, 1.0).otherwise(F.col("_peak"))), [waves.key])
    return waves.with_rows(rows.withColumn("samples", F.transform("samples", lambda x: x / F.col("_peak"))))


def fix_duration(waves: Waves, samplerate: int, duration: float) -> Waves:
    """Every clip gets exactly int(samplerate * duration) samples."""
    return pad_to(waves, F.lit(int(samplerate * duration)).cast("bigint"))


def pad_to(waves: Waves, target: Column) -> Waves:
    """Cut or zero-pad to ``target`` samples, which may use ``n_samples`` of the clip."""
    sizes = waves.lengths().withColumn("_target", target)
    left = F.col("_target") - F.col("chunk") * waves.size  # samples of this chunk and of all after it
    room = F.greatest(F.least(left, F.lit(waves.size)), F.lit(0)).cast("int")
    short = F.greatest(room - F.size("samples"), F.lit(0)).cast("int")
    kept = attach(waves.rows, sizes, [waves.key]).where(left > 0)
    filled = F.slice(F.concat("samples", F.array_repeat(F.lit(0.0), short)), F.lit(1), room)
    # the last chunk fills up, then whole chunks of zeros follow
    more = spread(sizes, "chunk", F.col("n_chunks"), F.ceil(F.col("_target") / waves.size) - 1)
    more = more.withColumn("samples", F.array_repeat(F.lit(0.0), room))
    return waves.with_rows(kept.withColumn("samples", filled).select(waves.key, "chunk", "samples").unionByName(
        more.select(waves.key, F.col("chunk").cast(waves.rows.schema["chunk"].dataType), "samples")))


def pad_for_network(waves: Waves, **params) -> Waves:
    return pad_to(waves, coords.padded_length(F.col("n_samples").cast("double"), **params))


def mix(waves: Waves, pairs: DataFrame, partners: Waves | None = None) -> Waves:
    """weight * own + (1 - weight) * partner; the partner is cut or zero-padded to the own length.

    ``pairs`` is (clip, partner_id, weight). Chunks of both sides meet by an equi-join on (partner, chunk).
    """
    other = partners or waves
    if other.size != waves.size:
        raise ValueError("Both sides need chunks of one size.")
    key = waves.key
    own = attach(waves.rows, pairs.select(key, "partner_id", "weight"), [key])
    theirs = other.rows.select(F.col(other.key).alias("partner_id"), "chunk", F.col("samples").alias("_y"))
    rows = own.join(theirs, ["partner_id", "chunk"], "left")
    cut = F.slice(F.coalesce("_y", F.array().cast("array<double>")), F.lit(1), F.size("samples"))
    blend = F.zip_with("samples", cut, lambda x, y: F.col("weight") * x + (1 - F.col("weight")) * F.coalesce(y, F.lit(0.0)))
    return waves.with_rows(rows.withColumn("samples", blend))


def echo(waves: Waves, settings: DataFrame) -> Waves:
    """weight * x[i] + (1 - weight) * x[i - delay], silence before the start; ``settings`` is (clip, delay, weight).

    Of ``delay = q * size + r`` samples, chunk k needs the last r samples of chunk k - q - 1 (the
    halo) and the first ones of chunk k - q, which for q = 0 it has itself.
    """
    key, size = waves.key, waves.size
    rows = attach(waves.rows, settings.select(key, "delay", "weight"), [key])
    whole, rest = F.floor(F.col("delay") / size), (F.col("delay") % size).cast("int")
    kind = rows.schema["chunk"].dataType
    tails = rows.where((rest > 0) & (F.size("samples") == size)).select(
        key, (F.col("chunk") + whole + 1).cast(kind).alias("chunk"), F.slice("samples", F.lit(size) - rest + 1, rest).alias("_tail"))
    heads = rows.where(whole > 0).select(
        key, (F.col("chunk") + whole).cast(kind).alias("chunk"), F.slice("samples", F.lit(1), F.lit(size) - rest).alias("_head"))
    near = rows.join(tails, [key, "chunk"], "left").join(heads, [key, "chunk"], "left")
    quiet = F.array_repeat(F.lit(0.0), rest)
    nothing = F.array().cast("array<double>")
    late = F.concat(F.coalesce("_tail", quiet), F.when(whole == 0, F.col("samples")).otherwise(F.coalesce("_head", nothing)))
    blend = F.zip_with("samples", F.slice(late, F.lit(1), F.size("samples")), lambda x, y: (
        F.col("weight") * x + (1 - F.col("weight")) * F.coalesce(y, F.lit(0.0))))
    return waves.with_rows(near.withColumn("samples", blend))


# --- spectra ---------------------------------------------------------------

def window_values(name: str, n: int) -> np.ndarray:
    """Periodic window of length n."""
    makers = {
        "hann": np.hanning, "hamming": np.hamming, "blackman": np.blackman,
        "bartlett": np.bartlett, "kaiser": lambda m: np.kaiser(m, 12.0),
    }
    if name not in makers:
        raise NotImplementedError(f"no window named {name!r}")
    return makers[name](n + 1)[:-1]


def spectra(x: np.ndarray, at: int, low: int, high: int, n_fft: int, hop: int, weights: np.ndarray) -> tuple[int, np.ndarray]:
    """(first frame, magnitudes) of the frames that start in [low, high) and lie inside ``x``.

    ``x[0]`` is sample ``at`` of the clip; frame t starts at ``t * hop - n_fft // 2``.
    """
    half = n_fft // 2
    first = -(-(max(low, at) + half) // hop)
    last = (min(high - 1, at + len(x) - n_fft) + half) // hop
    if last < first:
        return first, np.empty((0, n_fft // 2 + 1))
    begin = first * hop - half - at
    frames = np.lib.stride_tricks.sliding_window_view(x[begin:begin + (last - first) * hop + n_fft], n_fft)[::hop]
    return first, np.abs(np.fft.rfft(frames * weights, axis=1))


def chunk_spectra(x: np.ndarray, k: int, n: int, size: int, n_fft: int, hop: int, weights: np.ndarray) -> tuple[int, np.ndarray]:
    """Frames that chunk k of a clip of n samples can make by itself, the mirrored start and end included."""
    half, chunks = n_fft // 2, -(-n // size)
    left = half if k == 0 else 0
    right = half if k == chunks - 1 and (chunks == 1 or len(x) > n_fft) else 0
    at = k * size
    whole = np.pad(x, (left, right), mode="reflect") if left or right else x
    # a frame that starts in the chunk before belongs to the joint
    return spectra(whole, at - left, at - left, at + len(x) + right, n_fft, hop, weights)


def joint_spectra(
    tail: np.ndarray, head: np.ndarray, k: int, n: int, size: int, n_fft: int, hop: int, weights: np.ndarray
) -> list[tuple[int, np.ndarray]]:
    """Frames over the border of chunks k - 1 and k, and those of the mirrored end if the last chunk is too short for it."""
    border = k * size
    x, at = np.concatenate([tail, head]), border - len(tail)
    over = spectra(x, at, border - n_fft + 1, border, n_fft, hop, weights)
    if border + size < n or len(head) > n_fft or border + len(head) < n:
        return [over]
    whole = np.pad(x, (0, n_fft // 2), mode="reflect")
    over = spectra(whole, at, border - n_fft + 1, border, n_fft, hop, weights)
    rest = spectra(whole, at, max(border, n - n_fft + 1), n + n_fft, n_fft, hop, weights)
    return [over, rest]


def _numbers(column: pa.Array) -> list[np.ndarray]:
    flat, ends = np.asarray(column.flatten(), dtype=float), np.asarray(column.offsets) - column.offsets[0].as_py()
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]


def _frame_batch(keys: pa.Array, row: int, first: int, values: np.ndarray) -> pa.RecordBatch:
    count, bins = values.shape
    offsets = pa.array(np.arange(count + 1, dtype=np.int32) * bins)
    return pa.RecordBatch.from_arrays([
        keys.take(pa.array([row] * count, pa.int64())), pa.array(np.arange(first, first + count)),
        pa.ListArray.from_arrays(offsets, pa.array(values.ravel())),
    ], names=["key", "t", "values"])


def magnitude_stft(waves: Waves, n_fft: int, hop: int, window: str = "hann") -> DataFrame:
    """Magnitude spectrum per centred frame, mirrored at the ends: (clip, t, values of n_fft // 2 + 1 bins).

    A chunk makes the frames inside it where it lies. Only the ``n_fft`` samples on both
    sides of a chunk border are exchanged, and their join makes the frames across.
    """
    key, size = waves.key, waves.size
    if size < 2 * n_fft:
        raise ValueError("A chunk must hold at least two frames.")
    weights = window_values(window, n_fft)
    kind = waves.rows.schema[key].dataType.simpleString()
    schema = f"key {kind}, t long, values array<double>"
    sized = attach(waves.rows, waves.lengths(), [key]).select(
        key, F.col("chunk").cast("long").alias("chunk"), "n_samples", "n_chunks", F.col("samples").cast("array<double>").alias("samples"))

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = zip(batch.column("chunk").to_pylist(), batch.column("n_samples").to_pylist())
            for row, ((k, n), x) in enumerate(zip(places, _numbers(batch.column("samples")))):
                if len(x):
                    yield _frame_batch(batch.column(0), row, *chunk_spectra(x, k, n, size, n_fft, hop, weights))

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = zip(batch.column("chunk").to_pylist(), batch.column("n_samples").to_pylist())
            sides = zip(_numbers(batch.column("tail")), _numbers(batch.column("head")))
            for row, ((k, n), (tail, head)) in enumerate(zip(places, sides)):
                for first, values in joint_spectra(tail, head, k, n, size, n_fft, hop, weights):
                    yield _frame_batch(batch.column(0), row, first, values)

    tails = sized.where(F.col("chunk") < F.col("n_chunks") - 1).select(
        key, (F.col("chunk") + 1).alias("chunk"), F.slice("samples", size - n_fft, n_fft + 1).alias("tail"))
    # one sample more than a frame tells a head that is a whole last chunk from a cut one
    heads = sized.where(F.col("chunk") > 0).select(
        key, "chunk", "n_samples", F.slice("samples", 1, n_fft + 1).alias("head"))
    joints = heads.join(tails, [key, "chunk"]).select(key, "chunk", "n_samples", "tail", "head")
    found = sized.mapInArrow(inside, schema).unionByName(joints.mapInArrow(across, schema))
    return found.withColumnRenamed("key", key)
