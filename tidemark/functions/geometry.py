"""Face geometry from a landmark array, as column expressions without any Python per row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numeric import as_column

EPS = 1e-6


@dataclass(frozen=True)
class LandmarkIndices:
    """Positions in the landmark array (fixed values of the 468-point face mesh)."""

    left_eye: tuple[int, ...] = (33, 160, 158, 133, 153, 144)
    right_eye: tuple[int, ...] = (362, 385, 387, 263, 373, 380)
    left_eye_outer: int = 33
    right_eye_outer: int = 263
    mouth_left: int = 61
    mouth_right: int = 291
    mouth_upper: int = 13
    mouth_lower: int = 14
    nose_tip: int = 4
    forehead: int = 10
    chin: int = 152
    left_ear: int = 234
    right_ear: int = 454


FACE_MESH = LandmarkIndices()


def point(points: Column | str, i: int) -> Column:
    return F.get(as_column(points), F.lit(i))


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance in the image plane."""
    dx, dy = a["x"] - b["x"], a["y"] - b["y"]
    return F.sqrt(dx * dx + dy * dy)


def _if_present(points: Column | str, needed: list[int], value: Column) -> Column:
    """``value`` when every needed point exists, otherwise 0."""
    enough = F.size(as_column(points)) > max(needed)
    return F.when(enough, F.coalesce(value, F.lit(0.0))).otherwise(F.lit(0.0))


def eye_aspect_ratio(points: Column | str, eye: tuple[int, ...]) -> Column:
    """(|p2 p6| + |p3 p5|) / (2 |p1 p4|); 0 when the eye is incomplete or has no width."""
    if len(eye) != 6:
        return F.lit(0.0)
    p = [point(points, i) for i in eye]
    width = distance(p[0], p[3])
    value = F.when(width >= EPS, (distance(p[1], p[5]) + distance(p[2], p[4])) / (2.0 * width))
    return _if_present(points, list(eye), value)


def eye_center(points: Column | str, at: LandmarkIndices = FACE_MESH) -> tuple[Column, Column]:
    needed = [at.left_eye_outer, at.right_eye_outer]
    left, right = (point(points, i) for i in needed)
    x = _if_present(points, needed, (left["x"] + right["x"]) / 2.0)
    y = _if_present(points, needed, (left["y"] + right["y"]) / 2.0)
    return x, y


def mouth_aspect_ratio(points: Column | str, at: LandmarkIndices = FACE_MESH) -> Column:
    needed = [at.mouth_left, at.mouth_right, at.mouth_upper, at.mouth_lower]
    left, right, upper, lower = (point(points, i) for i in needed)
    width = distance(left, right)
    return _if_present(points, needed, F.when(width >= EPS, distance(upper, lower) / width))


def head_roll(points: Column | str, at: LandmarkIndices = FACE_MESH) -> Column:
    needed = [at.left_eye_outer, at.right_eye_outer]
    left, right = (point(points, i) for i in needed)
    return _if_present(points, needed, F.atan2(right["y"] - left["y"], right["x"] - left["x"]))


def head_pitch(points: Column | str, at: LandmarkIndices = FACE_MESH) -> Column:
    needed = [at.forehead, at.chin]
    forehead, chin = (point(points, i) for i in needed)
    dy, dz = chin["y"] - forehead["y"], chin["z"] - forehead["z"]
    return _if_present(points, needed, F.when(F.abs(dy) >= EPS, F.atan2(dz, dy)))


def head_yaw(points: Column | str, at: LandmarkIndices = FACE_MESH) -> Column:
    needed = [at.nose_tip, at.left_ear, at.right_ear]
    nose, left, right = (point(points, i) for i in needed)
    middle = (left["x"] + right["x"]) / 2.0
    width = F.abs(right["x"] - left["x"])
    return _if_present(points, needed, F.when(width >= EPS, F.atan2(nose["x"] - middle, width / 2.0)))


def face_box(points: Column | str, margin: float = 0.2, pixels: bool = True) -> Column:
    """Bounding box struct (x, y, w, h) widened by ``margin``; whole pixels or plain doubles."""
    pts = as_column(points)

    def edge(f, axis: str) -> Column:
        value = f(F.transform(pts, lambda p: p[axis]))
        return value.cast("bigint") if pixels else value

    def cut(c: Column) -> Column:
        return c.cast("bigint") if pixels else c

    x0, x1 = edge(F.array_min, "x"), edge(F.array_max, "x")
    y0, y1 = edge(F.array_min, "y"), edge(F.array_max, "y")
    w, h = x1 - x0, y1 - y0
    mx, my = cut(w * F.lit(margin)), cut(h * F.lit(margin))
    kind = "bigint" if pixels else "double"
    zero, one = F.lit(0).cast(kind), F.lit(1).cast(kind)
    box = F.struct(
        F.greatest(zero, x0 - mx).alias("x"),
        F.greatest(zero, y0 - my).alias("y"),
        (w + 2 * mx).alias("w"),
        (h + 2 * my).alias("h"),
    )
    empty = F.struct(zero.alias("x"), zero.alias("y"), one.alias("w"), one.alias("h"))
    return F.when(F.size(pts) > 0, box).otherwise(empty)


def frame_features(landmarks: DataFrame, at: LandmarkIndices = FACE_MESH, fps: float = 30.0) -> DataFrame:
    """One frame record per landmark row; an all-zero invalid record where no face was detected."""
    pts = F.col("points")
    left, right = eye_aspect_ratio(pts, at.left_eye), eye_aspect_ratio(pts, at.right_eye)
    cx, cy = eye_center(pts, at)
    values = {
        "ear_left": left,
        "ear_right": right,
        "ear_mean": (left + right) / 2.0,
        "brightness": F.col("brightness"),
        "quality": F.col("quality"),
        "eye_center_x": cx,
        "eye_center_y": cy,
        "mouth_mar": mouth_aspect_ratio(pts, at),
        "roll": head_roll(pts, at),
        "pitch": head_pitch(pts, at),
        "yaw": head_yaw(pts, at),
    }
    detected = F.coalesce(F.col("detected"), F.lit(False)) & pts.isNotNull()
    return landmarks.select(
        "user_id",
        "task",
        "frame_idx",
        (F.col("frame_idx") / F.lit(fps)).alias("timestamp_s"),
        *[F.when(detected, c).otherwise(F.lit(0.0)).alias(n) for n, c in values.items()],
        detected.alias("valid"),
    )
