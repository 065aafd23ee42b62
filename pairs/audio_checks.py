"""Waveforms, spectrogram steps, coordinates and augmentation."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from chirpframe.functions import coords
from chirpframe.operators import augment, signal, waves

from .base import pair
from .dataset_checks import duck_draw


def six(frame, *names):
    return frame.withColumns({n: F.round(n, 6) for n in names or ("value",)})


def resized(n_in: str, n_out: str, axis: str) -> str:
    return f"""greatest(({axis} + cast(0.5 as double)) * ({n_in} / cast({n_out} as double)) - 0.5, 0)"""


# --- waveform --------------------------------------------------------------

SAMPLES = """samples as (select clip_id, chunk*64 + i as idx, cast(samples[i + 1] as double) as x from waves, (select unnest(range(64)) as i) r),
    sz as (select clip_id, count(*) as n from samples group by clip_id)"""


def chunked(i) -> waves.Waves:
    return waves.Waves(i.waves.withColumn("samples", F.col("samples").cast("array<double>")), 64)


def rows_of(found: waves.Waves):
    return six(waves.to_samples(found), "x")


@pair("sig01_center", f"with {SAMPLES} select clip_id, idx, round(x - avg(x) over (partition by clip_id), 6) as x from samples", "waves")
def _(i):
    return rows_of(waves.center(chunked(i)))


@pair("sig01_center_rows", "select clip_id, idx, round(x - avg(x) over (partition by clip_id), 6) as x from samples", "samples")
def _(i):
    """From one row per sample, cut into chunks first."""
    return rows_of(waves.center(waves.from_samples(i.samples, 300)))


@pair(
    "sig02_peak_normalize",
    f"""with {SAMPLES} select clip_id, idx, round(x / max(abs(x)) over (partition by clip_id), 6) as x from samples""",
    "waves",
)
def _(i):
    return rows_of(waves.peak_normalize(chunked(i)))


@pair(
    "sig03_fix_duration",
    f"""with {SAMPLES} select clip_id, idx, round(x, 6) as x from samples where clip_id%2 = 1 and idx < 1200
    union all select clip_id, cast(k as bigint), 0 from sz, (select unnest(range(1200)) as k) r where clip_id%2 = 1 and k >= n
    union all select clip_id, idx, round(x, 6) from samples where clip_id%2 = 0 and idx < 700
    union all select clip_id, cast(k as bigint), 0 from sz, (select unnest(range(700)) as k) r where clip_id%2 = 0 and k >= n""",
    "waves",
)
def _(i):
    every = chunked(i)
    odd, even = (every.with_rows(every.rows.where(f"clip_id % 2 = {k}")) for k in (1, 0))
    return rows_of(waves.fix_duration(odd, 1000, 1.2)).unionByName(rows_of(waves.fix_duration(even, 1000, 0.7)))


STFT = f"""placed as (select clip_id, n, idx + 16 as spot, x from samples join sz using (clip_id) union all select clip_id, n, 16 - idx, x from samples join sz using (clip_id) where idx between 1 and 16
      union all select clip_id, n, 2*(n - 1) - idx + 16, x from samples join sz using (clip_id) where idx between n - 17 and n - 2),
    fr as (select clip_id, t, spot - t*8 as n, x from placed, (select unnest(range(0, 129)) as t) r where t*8 <= placed.n and spot >= t*8 and spot < t*8 + 32),
    sp as (select clip_id, k as f, t, sum(x * (0.5 - 0.5*cos({2 * math.pi!r}*n/32)) * cos({2 * math.pi!r}*k*n/32)) as re, sum(x * (0.5 - 0.5*cos({2 * math.pi!r}*n/32)) * sin({2 * math.pi!r}*k*n/32)) as im
      from fr, (select unnest(range(0, 17)) as k) q group by all)"""


@pair(
    "sig04_stft",
    f"""with {SAMPLES}, {STFT} select clip_id, f, t, round(sqrt(re*re + im*im), 5) as value from sp""",
    "waves",
)
def _(i):
    cells = signal.to_cells(waves.magnitude_stft(chunked(i), 32, 8))
    return cells.withColumn("value", F.round("value", 5))


@pair(
    "sig05_frequency_crop",
    "select clip_id, f - 2 as f, t, round(value, 6) as value from cells where f >= 2 and f < 15",
    "cells",
)
def _(i):
    return six(signal.frequency_crop(i.cells, 256000, 38, 15000, 100000))


@pair(
    "sig06_resize",
    f"""with g as (select clip_id, a.f, b.t from (select distinct clip_id from cells), (select unnest(range(0, 32)) as f) a, (select unnest(range(0, 25)) as t) b),
    s as (select *, {resized('20', '32', 'f')} as sf, {resized('50', '25', 't')} as st from g),
    w as (select *, cast(floor(sf) as bigint) as f0, least(cast(floor(sf) as bigint) + 1, 19) as f1, cast(floor(st) as bigint) as t0, least(cast(floor(st) as bigint) + 1, 49) as t1 from s)
    select w.clip_id, w.f, w.t, round((1-(sf-f0))*((1-(st-t0))*a.value + (st-t0)*b.value) + (sf-f0)*((1-(st-t0))*c.value + (st-t0)*d.value), 6) as value
    from w join cells a on a.clip_id = w.clip_id and a.f = f0 and a.t = t0 join cells b on b.clip_id = w.clip_id and b.f = f0 and b.t = t1
    join cells c on c.clip_id = w.clip_id and c.f = f1 and c.t = t0 join cells d on d.clip_id = w.clip_id and d.f = f1 and d.t = t1""",
    "cells",
)
def _(i):
    return six(signal.resize(i.cells, 32, 0.5))


@pair(
    "sig07_pcen",
    """with p as (select clip_id, f, t, value * 2147483648 as s from cells),
    m as (select a.clip_id, a.f, a.t, max(a.s) as s, sum(cast(0.3 as double) * pow(cast(0.7 as double), a.t - b.t) * b.s) as m from p a join p b on b.clip_id = a.clip_id and b.f = a.f and b.t <= a.t group by all)
    select clip_id, f, t, round(sqrt(cast(2 as double)) * (sqrt(1 + s * exp(-0.98 * (ln(cast(1e-6 as double)) + ln(1 + m / cast(1e-6 as double)))) / 2) - 1), 5) as value from m""",
    "cells",
)
def _(i):
    return signal.pcen(i.cells, 0.3).withColumn("value", F.round("value", 5)).select("clip_id", "f", "t", "value")


@pair(
    "sig08_amplitude",
    "select clip_id, f, t, round(value*value, 6) as power, round(10*log10(greatest(value, 1e-10)), 6) as db from cells",
    "cells",
)
def _(i):
    return i.cells.select(
        "clip_id", "f", "t", F.round(signal.scale_amplitude(F.col("value"), "power"), 6).alias("power"),
        F.round(signal.scale_amplitude(F.col("value")), 6).alias("db"),
    )


@pair(
    "sig09_mean_subtraction",
    "select clip_id, f, t, round(greatest(value - avg(value) over (partition by clip_id, f), 0), 6) as value from cells",
    "cells",
)
def _(i):
    return six(signal.spectral_mean_subtraction(i.cells)).select("clip_id", "f", "t", "value")


@pair(
    "sig10_log_and_max_scale",
    """with l as (select clip_id, f, t, ln(1 + cast(0.25 as double) * value) as value from cells)
    select clip_id, f, t, round(value / (max(value) over (partition by clip_id) + cast(0.00001 as double)), 6) as value from l""",
    "cells",
)
def _(i):
    return six(signal.max_scale(signal.log_scale(i.cells, 0.25))).select("clip_id", "f", "t", "value")


SMOOTH = signal.pcen_smoothing(16000)
CHAIN = STFT.replace("from samples", "from centred")


@pair(
    "sig11_preprocess",
    f"""with {SAMPLES}, centred as (select clip_id, idx, x - avg(x) over (partition by clip_id) as x from samples), {CHAIN},
    cr as (select clip_id, f - 2 as f, t, sqrt(re*re + im*im) * 2147483648 as s from sp where f >= 2 and f < 14),
    m as (select a.clip_id, a.f, a.t, max(a.s) as s, sum(cast({SMOOTH!r} as double) * pow(cast({(1 - SMOOTH)!r} as double), a.t - b.t) * b.s) as m
      from cr a join cr b on b.clip_id = a.clip_id and b.f = a.f and b.t <= a.t group by all),
    pc as (select clip_id, f, t, sqrt(cast(2 as double)) * (sqrt(1 + s * exp(-0.98 * (ln(cast(1e-6 as double)) + ln(1 + m / cast(1e-6 as double)))) / 2) - 1) as v from m),
    ms as (select clip_id, f, t, greatest(v - avg(v) over (partition by clip_id, f), 0) as value from pc),
    wd as (select clip_id, max(t) + 1 as w0, cast(floor((max(t) + 1) * cast(0.5 as double)) as bigint) as w from ms group by clip_id),
    g as (select clip_id, w0, w, a.f, b.t from wd, (select unnest(range(0, 16)) as f) a, (select unnest(range(0, 65)) as t) b where b.t < w),
    sg as (select *, {resized('12', '16', 'f')} as sf, {resized('w0', 'w', 't')} as st from g),
    w as (select *, cast(floor(sf) as bigint) as f0, least(cast(floor(sf) as bigint) + 1, 11) as f1, cast(floor(st) as bigint) as t0, least(cast(floor(st) as bigint) + 1, w0 - 1) as t1 from sg)
    select w.clip_id, w.f, w.t, round((1-(sf-f0))*((1-(st-t0))*a.value + (st-t0)*b.value) + (sf-f0)*((1-(st-t0))*c.value + (st-t0)*d.value), 4) as value
    from w join ms a on a.clip_id = w.clip_id and a.f = f0 and a.t = t0 join ms b on b.clip_id = w.clip_id and b.f = f0 and b.t = t1
    join ms c on c.clip_id = w.clip_id and c.f = f1 and c.t = t0 join ms d on d.clip_id = w.clip_id and d.f = f1 and d.t = t1""",
    "waves",
)
def _(i):
    """Whole chain on a small window (16 kHz, n_fft 32): centre, STFT, crop, PCEN, mean subtraction, resize."""
    out = signal.preprocess(chunked(i), 16000, [waves.center], min_freq=1000, max_freq=7000, height=16)
    return out.withColumn("value", F.round("value", 4))


@pair(
    "sig12_coordinates",
    """with n as (select recording_id, duration, samplerate, floor(cast(0.002 as double) * samplerate) as nf, floor(0.75 * floor(cast(0.002 as double) * samplerate)) as ov from recordings)
    select recording_id, round((duration * samplerate - ov) / (nf - ov), 6) as x, round((recording_id * (nf - ov) + ov) / samplerate, 6) as time,
    cast(floor(recording_id / cast(0.5 as double)) * (nf - ov) + ov as bigint) as sample, cast(floor(floor((duration * samplerate - ov) / (nf - ov)) * 0.5) as bigint) as width,
    cast(floor(round((128 - recording_id%128) / cast(128 as double) * 110000 + 10000, 2)) as integer) as hertz, round(0.5 + recording_id%50 * (duration / 50), 6) as axis from n""",
    "recordings",
)
def _(i):
    rate, n = F.col("samplerate").cast("double"), F.col("recording_id")
    return i.recordings.select(
        "recording_id", F.round(coords.time_to_column(F.col("duration"), rate), 6).alias("x"),
        F.round(coords.column_to_time(n.cast("double"), rate), 6).alias("time"),
        coords.column_to_sample(n.cast("double"), rate).alias("sample"),
        coords.spectrogram_width(F.col("duration") * rate, rate).alias("width"),
        coords.bin_to_frequency(n % 128, 128).alias("hertz"),
        F.round(coords.axis_value(n % 50, 0.5, F.col("duration") + 0.5, 50), 6).alias("axis"),
    )


PAD = """with n as (select recording_id, cast(recording_id * 37 % 30000 + 400 as bigint) as len from recordings),
    w as (select *, cast(floor(floor((len - 384) / cast(128 as double)) * 0.5) as bigint) as width from n)"""


@pair(
    "sig13_padded_length",
    PAD + """ select recording_id, case when width < 64 then cast(floor(64 / cast(0.5 as double)) * 128 + 384 as bigint) when width % 32 = 0 then len
    else cast(floor(ceil(width / cast(32 as double)) * 32 / cast(0.5 as double)) * 128 + 384 as bigint) end as padded,
    case when width = 100 then len else cast(200 * 128 + 384 as bigint) end as fixed from w""",
    "recordings",
)
def _(i):
    length = (F.col("recording_id") * 37 % 30000 + 400).cast("double")
    return i.recordings.select(
        "recording_id", coords.padded_length(length).alias("padded"), coords.padded_length(length, fixed_width=100).alias("fixed")
    )


# --- augmentation ----------------------------------------------------------

PARTNER = f"""od as (select clip_id, row_number() over (order by {duck_draw('partner', 'clip_id')}, clip_id) as r, count(*) over () as n from (select distinct clip_id from samples)),
    pt as (select a.clip_id, b.clip_id as partner_id, cast(0.3 as double) + {duck_draw('mix', 'a.clip_id')} * (cast(0.7 as double) - 0.3) as weight from od a join od b on b.r = a.r % a.n + 1)"""


@pair(
    "aug01_combine_annotations",
    f"""with od as (select clip_id, row_number() over (order by {duck_draw('partner', 'clip_id')}, clip_id) as r, count(*) over () as n from clips),
    pt as (select a.clip_id, b.clip_id as partner_id from od a join od b on b.r = a.r % a.n + 1)
    select ann_id, clip_id, round(start_time, 6) as start_time, false as mixed from ann
    union all select a.ann_id, pt.clip_id, round(start_time + (pt.clip_id%5 - pt.partner_id%5), 6), true from ann a join pt on pt.partner_id = a.clip_id""",
    "ann clips",
)
def _(i):
    clips = i.clips.withColumn("clip_start", (F.col("clip_id") % 5).cast("double"))
    out = augment.combine_annotations(i.ann, clips, augment.partners(clips))
    return out.select("ann_id", "clip_id", F.round("start_time", 6).alias("start_time"), "mixed")


def _mix_pairs(i):
    return augment.mix_weights(augment.partners(i.waves.select("clip_id").distinct()))


@pair(
    "aug02_mix_samples",
    f"""with {SAMPLES}, {PARTNER} select s.clip_id, s.idx, round(weight * s.x + (1 - weight) * coalesce(o.x, 0), 6) as x
    from samples s join pt using (clip_id) left join (select * from samples where idx < 900) o on o.clip_id = partner_id and o.idx = s.idx""",
    "waves",
)
def _(i):
    """Partners end after 900 samples; the rest mixes with silence."""
    own = chunked(i)
    return rows_of(waves.mix(own, _mix_pairs(i), waves.pad_to(own, F.least(F.col("n_samples"), F.lit(900)))))


@pair(
    "aug02_mix_whole",
    f"""with {SAMPLES}, {PARTNER} select s.clip_id, s.idx, round(weight * s.x + (1 - weight) * coalesce(o.x, 0), 6) as x
    from samples s join pt using (clip_id) left join samples o on o.clip_id = partner_id and o.idx = s.idx""",
    "waves",
)
def _(i):
    return rows_of(waves.mix(chunked(i), _mix_pairs(i)))


ECHO = f"""select clip_id, cast(floor({duck_draw('echo-delay', 'clip_id')} * {{}}) as integer) as delay, {duck_draw('echo-weight', 'clip_id')} as weight from (select distinct clip_id from samples)"""


@pair(
    "aug03_echo",
    f"""with {SAMPLES}, st as ({ECHO.format(50)})
    select s.clip_id, s.idx, round(weight * s.x + (1 - weight) * coalesce(o.x, 0), 6) as x from samples s join st using (clip_id) left join samples o on o.clip_id = s.clip_id and o.idx = s.idx - delay""",
    "waves",
)
def _(i):
    settings = augment.echo_settings(i.waves.select("clip_id").distinct(), 10000)
    return rows_of(waves.echo(chunked(i), settings))


@pair(
    "aug03_long_echo",
    f"""with {SAMPLES}, st as ({ECHO.format(400)})
    select s.clip_id, s.idx, round(weight * s.x + (1 - weight) * coalesce(o.x, 0), 6) as x from samples s join st using (clip_id) left join samples o on o.clip_id = s.clip_id and o.idx = s.idx - delay""",
    "waves",
)
def _(i):
    """Delays of several chunks."""
    settings = augment.echo_settings(i.waves.select("clip_id").distinct(), 10000, max_delay=0.04)
    return rows_of(waves.echo(chunked(i), settings))


@pair(
    "aug04_scale_volume",
    f"select clip_id, f, t, round(value * {duck_draw('volume', 'clip_id')} * 2, 6) as value from cells",
    "cells",
)
def _(i):
    return six(augment.scale_volume(i.cells))


FACTOR = f"(cast(0.96 as double) + {duck_draw('warp', 'clip_id')} * (cast(1.04 as double) - 0.96))"


@pair(
    "aug05_warp_annotations",
    f"""select ann_id, round(1 + (start_time - 1) * (1 / {FACTOR}), 6) as start_time, round(1 + (end_time - 1) * (1 / {FACTOR}), 6) as end_time from ann""",
    "ann",
)
def _(i):
    clips = augment.warp_factors(i.clips.withColumn("clip_start", F.lit(1.0)))
    return six(augment.warp_annotations(i.ann, clips), "start_time", "end_time").select("ann_id", "start_time", "end_time")


@pair(
    "aug05_warp_cells",
    f"""with nw as (select clip_id, cast(floor(50 * {FACTOR}) as bigint) as n from (select distinct clip_id from cells)),
    s as (select clip_id, f, t, n, greatest((t + cast(0.5 as double)) * (n / cast(50 as double)) - 0.5, 0) as src from cells join nw using (clip_id)),
    w as (select *, cast(floor(src) as bigint) as t0, least(cast(floor(src) as bigint) + 1, n - 1) as t1 from s)
    select w.clip_id, w.f, w.t, round((1 - (src - t0)) * coalesce(a.value, 0) + (src - t0) * coalesce(b.value, 0), 6) as value
    from w left join cells a on a.clip_id = w.clip_id and a.f = w.f and a.t = t0 left join cells b on b.clip_id = w.clip_id and b.f = w.f and b.t = t1""",
    "cells",
)
def _(i):
    factors = augment.warp_factors(i.cells.select("clip_id").distinct())
    return six(augment.warp_cells(i.cells, factors))


def mask_sql(seed: str, axis: str, size: int, share: float) -> str:
    top = math.floor(size * share)
    bands = []
    for k in range(3):
        width = f"floor({duck_draw(f'{seed}-size{k}', 'clip_id')} * {max(top, 1)})"
        start = f"floor({duck_draw(f'{seed}-start{k}', 'clip_id')} * greatest({size} - {width}, 1))"
        count = f"(1 + floor({duck_draw(f'{seed}-count', 'clip_id')} * 3))"
        bands.append(f"({k} < {count} and {axis} >= {start} and {axis} < {start} + {width})")
    return " or ".join(bands)


@pair(
    "aug06_masks",
    f"""select clip_id, f, t, round(case when {mask_sql('time', 't', 50, 0.3)} or {mask_sql('freq', 'f', 20, 0.4)} then 0 else value end, 6) as value from cells""",
    "cells",
)
def _(i):
    clips = i.cells.select("clip_id").distinct()
    out = augment.apply_masks(i.cells, augment.draw_masks(clips, 50, 0.3, seed="time"), "t")
    return six(augment.apply_masks(out, augment.draw_masks(clips, 20, 0.4, seed="freq"), "f"))


@pair(
    "aug07_maybe_apply",
    f"""with s1 as (select clip_id, f, t, case when {duck_draw('augment-0', 'clip_id')} <= 0.6 then value * {duck_draw('volume', 'clip_id')} * 2 else value end as value from cells)
    select clip_id, f, t, round(case when {duck_draw('augment-1', 'clip_id')} <= 0.4 then value * value else value end, 6) as value from s1""",
    "cells",
)
def _(i):
    square = lambda c: c.withColumn("value", F.col("value") * F.col("value"))
    return six(augment.augment(i.cells, [(augment.scale_volume, 0.6), (square, 0.4)]))
