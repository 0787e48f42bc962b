"""Pitch, box and calibration geometry as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LENGTH, WIDTH = 105.0, 68.0


def oriented(x: Column, side: Column) -> Column:
    """A coordinate turned by 180 degrees where attack goes right to left; three decimals."""
    return F.round(F.when(side == "right_to_left", -x).otherwise(x), 3)


def from_corner(x: Column, y: Column, side: Column) -> tuple[Column, Column]:
    """Oriented coordinates with the origin moved from the centre to a corner."""
    turned = lambda c: F.when(side == "right_to_left", -c).otherwise(c)
    return F.round(turned(x) + LENGTH / 2, 3), F.round(turned(y) + WIDTH / 2, 3)


def rescaled(x: Column, y: Column, from_length: float = 120.0, from_width: float = 80.0) -> tuple[Column, Column]:
    """A point of another pitch size in metres; four decimals."""
    return F.round(x / from_length * LENGTH, 4), F.round(y / from_width * WIDTH, 4)


def unit(x: Column, y: Column, sign: Column) -> tuple[Column, Column]:
    """Centred metres as 0..1 along the attack."""
    return (sign * x + LENGTH / 2) / LENGTH, (sign * y + WIDTH / 2) / WIDTH


def realigned(position: Column, velocity: Column, turn: Column) -> tuple[Column, Column]:
    """A 0..1 position and velocity seen from the other direction where ``turn``."""
    return F.when(turn, 1 - position).otherwise(position), F.when(turn, -velocity).otherwise(velocity)


def clipped(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def display_point(x: Column, y: Column) -> tuple[Column, Column]:
    """0..1 coordinates on a 100 by 68 drawing, kept inside it."""
    return clipped(x * 100, 0.0, 100.0), clipped(y * WIDTH, 0.0, WIDTH)


def canvas(x: Column, y: Column, width: float, height: float, margin: float) -> tuple[Column, Column]:
    """Centred metres as pixels of a canvas with a margin."""
    return margin + (x + LENGTH / 2) / LENGTH * (width - 2 * margin), margin + (y + WIDTH / 2) / WIDTH * (height - 2 * margin)


def points(flat: Column) -> Column:
    """A flat list x, y, x, y, ... as a list of points; a last odd number is left out."""
    return F.transform(F.filter(F.sequence(F.lit(0), F.floor(F.size(flat) / 2).cast("int") - 1), lambda k: k >= 0), lambda k: F.array(F.get(flat, 2 * k), F.get(flat, 2 * k + 1)))


def corners(*pairs: Column) -> Column:
    """A polygon of the corners that are known."""
    return F.filter(F.array(*pairs), lambda p: p.isNotNull())


def opposite_side(side: Column) -> Column:
    bad = F.raise_error(F.concat(F.lit("no attacking side: "), F.coalesce(side, F.lit("null"))))
    return F.when(side == "left_to_right", "right_to_left").when(side == "right_to_left", "left_to_right").otherwise(bad)


def box_iou(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union of boxes (x1, y1, x2, y2); 0 where neither has an area."""
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    area = lambda c: F.greatest(F.lit(0.0), c[2] - c[0]) * F.greatest(F.lit(0.0), c[3] - c[1])
    return F.coalesce(F.try_divide(w * h, area(a) + area(b) - w * h), F.lit(0.0))


def unproject(h: list[Column], u: Column, v: Column, limit: tuple[float, float]) -> tuple[Column, Column]:
    """The ground point of an image point by the inverse (adjugate) of a row-major 3x3 homography; null outside the limits."""
    a, b, c, d, e, f, g, k, m = h
    x = (e * m - f * k) * u + (c * k - b * m) * v + (b * f - c * e)
    y = (f * g - d * m) * u + (a * m - c * g) * v + (c * d - a * f)
    w = (d * k - e * g) * u + (b * g - a * k) * v + (a * e - b * d)
    px, py = F.try_divide(x, w), F.try_divide(y, w)
    inside = (F.abs(px) <= limit[0]) & (F.abs(py) <= limit[1]) & ~F.isnan(px) & ~F.isnan(py)
    return F.when(inside, px), F.when(inside, py)


def calibration_scale(centre_x: Column, centre_y: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """Factors from an image's pixels to the calibration's, whose image is twice its principal point; 1 where something isn't positive."""
    good = F.coalesce((centre_x > 0) & (centre_y > 0) & (width > 0) & (height > 0), F.lit(False))
    return F.when(good, 2 * centre_x / width).otherwise(1.0), F.when(good, 2 * centre_y / height).otherwise(1.0)


def camera_homography(focal_x: Column, focal_y: Column, centre_x: Column, centre_y: Column, rotation: list[Column], position: list[Column]) -> list[Column]:
    """The row-major homography from the ground plane to the image: intrinsics times the rotation's first two columns and the shifted origin."""
    r = [rotation[k : k + 3] for k in (0, 3, 6)]
    shift = [-(row[0] * position[0] + row[1] * position[1] + row[2] * position[2]) for row in r]
    columns = [[row[0], row[1], s] for row, s in zip(r, shift, strict=True)]
    return [
        *[focal_x * x + centre_x * z for x, z in zip(columns[0], columns[2], strict=True)],
        *[focal_y * y + centre_y * z for y, z in zip(columns[1], columns[2], strict=True)],
        *columns[2],
    ]


def reliable_calibration(keypoints: Column, lines: Column, focal: Column) -> Column:
    """Enough keypoints and lines, and a focal length that a broadcast camera can have."""
    return F.coalesce((keypoints >= 6) & (lines >= 2) & focal.between(1000, 20000), F.lit(False))


def possession_confidence(nearest: Column, margin: Column, start: float = 0.72, reach: float = 12.0, lead: float = 12.0) -> Column:
    """0..1 from the holder's distance to the ball and its lead over the nearest opponent."""
    return clipped(start - nearest / reach + margin / lead, 0.0, 1.0)


def on_pitch(x: Column, y: Column, half_length: float, half_width: float) -> Column:
    return F.coalesce((F.abs(x) <= half_length) & (F.abs(y) <= half_width) & ~F.isnan(x) & ~F.isnan(y), F.lit(False))


def torso(x1: Column, y1: Column, x2: Column, y2: Column) -> list[Column]:
    """The torso part of a body box: the middle of its width, from below the head to above the legs, in whole pixels."""
    w, h = F.greatest(F.lit(1.0), x2 - x1), F.greatest(F.lit(1.0), y2 - y1)
    whole = lambda c: F.floor(c).cast("int")
    return [F.greatest(F.lit(0), whole(x1 + 0.16 * w)), F.greatest(F.lit(0), whole(y1 + 0.08 * h)), whole(x2 - 0.16 * w), whole(y1 + 0.55 * h)]


def foot_point(x1: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
    return (x1 + x2) / 2, y2


def sample_frames(start: Column, end: Column, n: int = 5, pad: int = 5) -> Column:
    """n evenly spaced frame numbers over the padded span, ties to even."""
    low, high = F.greatest(F.lit(0), start - pad), end + pad
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.bround(low + (high - low) * k / (n - 1)).cast("long"))


def shot_quality(green: Column, people: Column, wide: Column) -> Column:
    return 0.48 * green + 0.42 * people + 0.10 * wide


def centred_excerpt(start: Column, end: Column, seconds: float) -> tuple[Column, Column]:
    """An excerpt of at most ``seconds`` around the middle of a window."""
    middle, half = (start + end) / 2, F.least((end - start) / 2, F.lit(seconds / 2))
    return middle - half, middle + half
