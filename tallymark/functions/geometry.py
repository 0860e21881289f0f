"""Boxes and five-point landmarks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quad_to_box(points: Column) -> Column:
    """ARRAY<ARRAY<DOUBLE>> of (x, y) to [x0, y0, x1, y1]; null below two points."""
    xs = F.transform(points, lambda p: p[0])
    ys = F.transform(points, lambda p: p[1])
    return F.when(
        F.size(points) >= 2,
        F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)),
    )


def flat_to_box(coords: Column) -> Column:
    """Four numbers are a box already; more are x, y pairs; an odd or shorter list is null."""
    size = F.size(coords)
    xs = F.filter(coords, lambda _, i: i % 2 == 0)
    ys = F.filter(coords, lambda _, i: i % 2 == 1)
    return F.when(size == 4, coords).when(
        (size > 4) & (size % 2 == 0),
        F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)),
    )


def _clip90(angle: Column) -> Column:
    return F.when(angle.isNotNull(), F.greatest(F.lit(-90.0), F.least(F.lit(90.0), angle)))


def eye_distance(landmarks: Column) -> Column:
    """Landmarks are [left eye, right eye, nose, mouth left, mouth right], each [x, y]."""
    dx = landmarks[1][0] - landmarks[0][0]
    dy = landmarks[1][1] - landmarks[0][1]
    return F.sqrt(dx * dx + dy * dy)


def yaw_deg(landmarks: Column) -> Column:
    eye_mid_x = (landmarks[0][0] + landmarks[1][0]) / 2.0
    return _clip90((landmarks[2][0] - eye_mid_x) / (eye_distance(landmarks) + 1e-6) * 60.0)


def pitch_deg(landmarks: Column) -> Column:
    eye_mid_y = (landmarks[0][1] + landmarks[1][1]) / 2.0
    drop = (landmarks[3][1] + landmarks[4][1]) / 2.0 - eye_mid_y
    expected = eye_mid_y + drop * 0.45
    return _clip90((expected - landmarks[2][1]) / (F.abs(drop) + 1e-6) * 40.0)
