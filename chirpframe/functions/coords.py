"""Coordinate maps between seconds, samples, columns, bins and Hz."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default audio and spectrogram parameters.
SAMPLERATE = 256000
WINDOW_S = 512 / 256000.0
OVERLAP = 0.75
RESIZE = 0.5
DIVIDE = 32
MIN_FREQ = 10000
MAX_FREQ = 120000


def fft_sizes(samplerate: Column | float, window: float = WINDOW_S, overlap: float = OVERLAP) -> tuple[Column, Column, Column]:
    """(window length, overlap, step) in samples."""
    rate = samplerate if isinstance(samplerate, Column) else F.lit(float(samplerate))
    n_fft = F.floor(F.lit(window) * rate).cast("double")
    n_overlap = F.floor(F.lit(overlap) * n_fft).cast("double")
    return n_fft, n_overlap, n_fft - n_overlap


def time_to_column(time: Column, samplerate=SAMPLERATE, window=WINDOW_S, overlap=OVERLAP) -> Column:
    rate = samplerate if isinstance(samplerate, Column) else F.lit(float(samplerate))
    _, n_overlap, step = fft_sizes(samplerate, window, overlap)
    return (time * rate - n_overlap) / step


def column_to_time(x: Column, samplerate=SAMPLERATE, window=WINDOW_S, overlap=OVERLAP) -> Column:
    rate = samplerate if isinstance(samplerate, Column) else F.lit(float(samplerate))
    _, n_overlap, step = fft_sizes(samplerate, window, overlap)
    return (x * step + n_overlap) / rate


def column_to_sample(x: Column, samplerate=SAMPLERATE, window=WINDOW_S, overlap=OVERLAP, resize=RESIZE) -> Column:
    _, n_overlap, step = fft_sizes(samplerate, window, overlap)
    whole = (x / F.lit(float(resize))).cast("bigint")
    return (whole * step + n_overlap).cast("bigint")


def spectrogram_width(length: Column, samplerate=SAMPLERATE, window=WINDOW_S, overlap=OVERLAP, resize=RESIZE) -> Column:
    _, n_overlap, step = fft_sizes(samplerate, window, overlap)
    return (F.floor((length - n_overlap) / step) * F.lit(float(resize))).cast("bigint")


def bin_to_frequency(index: Column, height: int, min_freq=MIN_FREQ, max_freq=MAX_FREQ) -> Column:
    """Hz of a row counted from the top."""
    share = (F.lit(height) - index) / F.lit(float(height))
    return F.round(share * F.lit(float(max_freq - min_freq)) + F.lit(float(min_freq)), 2).cast("int")


def axis_value(index: Column, start: Column | float, stop: Column | float, size: Column | int) -> Column:
    """Value of cell ``index`` on a half-open axis with ``size`` cells."""
    lo = start if isinstance(start, Column) else F.lit(float(start))
    hi = stop if isinstance(stop, Column) else F.lit(float(stop))
    n = size if isinstance(size, Column) else F.lit(float(size))
    return lo + index * ((hi - lo) / n)


def to_pixel(value: Column, size: int, low: Column | float, high: Column | float) -> Column:
    """Cell index of a value, clamped at the axis ends (``size`` at the upper end)."""
    lo = low if isinstance(low, Column) else F.lit(float(low))
    hi = high if isinstance(high, Column) else F.lit(float(high))
    share = F.least(F.greatest((value - lo) / (hi - lo), F.lit(0.0)), F.lit(1.0))
    return F.floor(share * F.lit(float(size))).cast("int")


def crop_index(freq: float, n_fft: int, samplerate: int) -> int | None:
    """Bin of a frequency limit, None when it does not cut anything."""
    height = n_fft // 2 + 1
    index = int(freq * 2 / samplerate * height)
    return index if 0 < index < height else None


def padded_length(length: Column, samplerate=SAMPLERATE, window=WINDOW_S, overlap=OVERLAP, resize=RESIZE, divide=DIVIDE, fixed_width: int | None = None) -> Column:
    """Samples needed so that the spectrogram width fits the network."""
    args = dict(samplerate=samplerate, window=window, overlap=overlap, resize=resize)
    width = spectrogram_width(length, **args)
    if fixed_width:
        target = column_to_sample(F.lit(float(fixed_width)), **args)
        return F.when(width == fixed_width, length).otherwise(target).cast("bigint")
    shortest = int(divide / resize)
    multiple = F.ceil(width / F.lit(float(divide))) * F.lit(divide)
    return (
        F.when(width < shortest, column_to_sample(F.lit(float(shortest)), **args))
        .when(width % divide == 0, length)
        .otherwise(column_to_sample(multiple.cast("double"), **args))
        .cast("bigint")
    )
