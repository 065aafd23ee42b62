"""Affinities and box anchors as column arithmetic."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .conditions import TIME_ONLY, Row

# Size scaling and anchor names of the box encoding.
TIME_SCALE = 1000.0
FREQUENCY_SCALE = 1 / 859.375
CENTRES = ("center", "centroid", "point_on_surface")
ANCHORS = (
    "bottom-left", "bottom-right", "top-left", "top-right", "center-left",
    "center-right", "top-center", "bottom-center", *CENTRES,
)
POSITIONS = {"start": 0.0, "end": 1.0, "center": 0.5}


def zero() -> Column:
    return F.lit(0.0)


def overlap(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    return F.greatest(F.least(end_a, end_b) - F.greatest(start_a, start_b), zero())


def safe_ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(zero())


def point_in_time(row: Row, ratio: float) -> Column:
    """Position inside an event: 0 is its start, 1 its end."""
    if ratio == 0:
        return row("start_time")
    return row("start_time") + F.lit(float(ratio)) * (row("end_time") - row("start_time"))


def _check_buffer(**buffers: float) -> None:
    for name, value in buffers.items():
        if value < 0:
            raise ValueError(f"{name} is below 0")


@dataclass(frozen=True)
class TimeAffinity:
    """1 at equal positions, falling linearly to 0 at ``max_distance``."""

    max_distance: float = 0.01
    position: str | float = "start"

    @property
    def ratio(self) -> float:
        return POSITIONS[self.position] if isinstance(self.position, str) else float(self.position)

    def from_distance(self, distance: Column) -> Column:
        return F.greatest(zero(), F.lit(1.0) - F.abs(distance) / F.lit(float(self.max_distance)))

    def column(self, det: Row, gt: Row) -> Column:
        return self.from_distance(point_in_time(det, self.ratio) - point_in_time(gt, self.ratio))

    def distance(self, det: Row, gt: Row) -> Column:
        """What the affinity falls with; it keeps apart what rounding makes equal in the affinity."""
        return F.abs(point_in_time(det, self.ratio) - point_in_time(gt, self.ratio))

    def span(self, row: Row, side: str) -> tuple[Column, Column]:
        """Time span such that two events with positive affinity have touching spans."""
        point = point_in_time(row, self.ratio)
        reach = F.lit(self.max_distance if side == "gt" else 0.0)
        return point - reach, point + reach


@dataclass(frozen=True)
class IntervalIOU:
    time_buffer: float = 0.0

    def __post_init__(self) -> None:
        _check_buffer(time_buffer=self.time_buffer)

    def span(self, row: Row, side: str) -> tuple[Column, Column]:
        return (
            F.greatest(row("start_time") - F.lit(self.time_buffer), zero())
            if self.time_buffer else row("start_time"),
            row("end_time") + F.lit(self.time_buffer) if self.time_buffer else row("end_time"),
        )

    def column(self, det: Row, gt: Row) -> Column:
        (ds, de), (gs, ge) = self.span(det, "det"), self.span(gt, "gt")
        shared = overlap(ds, de, gs, ge)
        return safe_ratio(shared, (de - ds) + (ge - gs) - shared)


@dataclass(frozen=True)
class BBoxIOU:
    time_buffer: float = 0.0
    freq_buffer: float = 0.0

    def __post_init__(self) -> None:
        _check_buffer(time_buffer=self.time_buffer, freq_buffer=self.freq_buffer)

    def span(self, row: Row, side: str) -> tuple[Column, Column]:
        return IntervalIOU(self.time_buffer).span(row, side)

    def band(self, row: Row) -> tuple[Column, Column]:
        if not self.freq_buffer:
            return row("low_freq"), row("high_freq")
        pad = F.lit(self.freq_buffer)
        return F.greatest(row("low_freq") - pad, zero()), row("high_freq") + pad

    def column(self, det: Row, gt: Row) -> Column:
        (ds, de), (gs, ge) = self.span(det, "det"), self.span(gt, "gt")
        (dl, dh), (gl, gh) = self.band(det), self.band(gt)
        shared = overlap(ds, de, gs, ge) * overlap(dl, dh, gl, gh)
        return safe_ratio(shared, (de - ds) * (dh - dl) + (ge - gs) * (gh - gl) - shared)


@dataclass(frozen=True)
class GeometricIOU(BBoxIOU):
    """Area IoU of the real shapes; the same as ``BBoxIOU`` for boxes.

    Rows with ``geom_type`` Polygon go through an Arrow helper that works on
    the ``geometry`` JSON; time-only shapes compare on time alone. The
    frequency buffer is honoured. Polygons take no buffer.
    """

    shapes: bool = False

    def band(self, row: Row) -> tuple[Column, Column]:
        low, high = super().band(row)
        if not self.shapes:
            return low, high
        # time-only shapes meet every frequency
        timed = row("geom_type").isin(*TIME_ONLY)
        top = F.lit(5000000.0)
        return F.when(timed, zero()).otherwise(low), F.when(timed, top).otherwise(high)

    def column(self, det: Row, gt: Row) -> Column:
        boxes = BBoxIOU(self.time_buffer, self.freq_buffer).column(det, gt)
        if not self.shapes:
            return boxes
        from .polygons import shape_iou

        timed = det("geom_type").isin(*TIME_ONLY) | gt("geom_type").isin(*TIME_ONLY)
        plain = (det("geom_type") == "BoundingBox") & (gt("geom_type") == "BoundingBox")
        exact = shape_iou(
            F.when(~plain & ~timed, det("geometry")), F.when(~plain & ~timed, gt("geometry"))
        )
        return (
            F.when(timed, IntervalIOU(self.time_buffer).column(det, gt))
            .when(plain, boxes)
            .otherwise(exact)
        )


def scaled_box_iou(det: Row, gt: Row) -> Column:
    """Box IoU of the older evaluation. It scales frequencies to 10 MHz, which cancels out but for its rounding, so they stay as they are."""
    shared = overlap(det("start_time"), det("end_time"), gt("start_time"), gt("end_time")) * overlap(
        det("low_freq"), det("high_freq"), gt("low_freq"), gt("high_freq")
    )

    def area(row: Row) -> Column:
        return F.abs((row("end_time") - row("start_time")) * (row("high_freq") - row("low_freq")))

    return F.when(shared == 0, zero()).otherwise(shared / (area(det) + area(gt) - shared))


def _anchor_parts(anchor: str) -> tuple[str, str]:
    if anchor not in ANCHORS:
        raise ValueError(f"no anchor {anchor!r}; there are {list(ANCHORS)}")
    if anchor in CENTRES:
        return "center", "center"
    vertical, horizontal = anchor.split("-")
    return vertical, horizontal


def encode_anchor(
    row: Row,
    anchor: str = "bottom-left",
    time_scale: float = TIME_SCALE,
    frequency_scale: float = FREQUENCY_SCALE,
) -> dict[str, Column]:
    """Reference point of a box and its scaled size."""
    vertical, horizontal = _anchor_parts(anchor)
    start, end, low, high = (row(n) for n in ("start_time", "end_time", "low_freq", "high_freq"))
    time = {"left": start, "right": end, "center": (start + end) / 2}[horizontal]
    freq = {"bottom": low, "top": high, "center": (low + high) / 2}[vertical]
    return {
        "time": time,
        "frequency": freq,
        "width": (end - start) * F.lit(time_scale),
        "height": (high - low) * F.lit(frequency_scale),
    }


def decode_anchor(
    row: Row,
    anchor: str = "bottom-left",
    time_scale: float = TIME_SCALE,
    frequency_scale: float = FREQUENCY_SCALE,
) -> dict[str, Column]:
    """Box from reference point and size; sizes and coordinates never go below 0."""
    vertical, horizontal = _anchor_parts(anchor)
    span = F.greatest(zero(), row("width") / F.lit(time_scale))
    band = F.greatest(zero(), row("height") / F.lit(frequency_scale))
    time, freq = row("time"), row("frequency")
    start = {"left": time, "center": time - span / 2, "right": time - span}[horizontal]
    low = {"bottom": freq, "center": freq - band / 2, "top": freq - band}[vertical]
    return {
        "start_time": F.greatest(zero(), start),
        "low_freq": F.greatest(zero(), low),
        "end_time": F.greatest(zero(), start + span),
        "high_freq": F.greatest(zero(), low + band),
    }


def encode_peak(
    row: Row, time_scale: float = TIME_SCALE, frequency_scale: float = FREQUENCY_SCALE
) -> dict[str, Column]:
    """Four scaled distances from the peak (``peak_time``, ``peak_freq``) to the box sides."""
    return {
        "time": row("peak_time"),
        "frequency": row("peak_freq"),
        "left": (row("peak_time") - row("start_time")) * F.lit(time_scale),
        "bottom": (row("peak_freq") - row("low_freq")) * F.lit(frequency_scale),
        "right": (row("end_time") - row("peak_time")) * F.lit(time_scale),
        "top": (row("high_freq") - row("peak_freq")) * F.lit(frequency_scale),
    }


def decode_peak(
    row: Row, time_scale: float = TIME_SCALE, frequency_scale: float = FREQUENCY_SCALE
) -> dict[str, Column]:
    def side(name: str, scale: float) -> Column:
        return F.greatest(zero(), row(name)) / F.lit(scale)

    return {
        "start_time": row("time") - side("left", time_scale),
        "low_freq": row("frequency") - side("bottom", frequency_scale),
        "end_time": row("time") + side("right", time_scale),
        "high_freq": row("frequency") + side("top", frequency_scale),
    }
