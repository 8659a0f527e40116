"""Geometry as Column expressions: boxes in 2D and 3D, rigid transforms, projection, interpolation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = Sequence[Column]


def box(prefix: str = "", names: str = "x1 y1 x2 y2") -> list[Column]:
    return [F.col(f"{prefix}{n}").cast("double") for n in names.split()]


def clip(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), x)))


def norm(*parts: Column) -> Column:
    total = parts[0] * parts[0]
    for p in parts[1:]:
        total = total + p * p
    return F.sqrt(total)


def _positive(x: Column) -> Column:
    return F.greatest(F.lit(0.0), x)


def area2d(a: Box) -> Column:
    return _positive(a[2] - a[0]) * _positive(a[3] - a[1])


def overlap2d(a: Box, b: Box) -> Column:
    return _positive(F.least(a[2], b[2]) - F.greatest(a[0], b[0])) * _positive(F.least(a[3], b[3]) - F.greatest(a[1], b[1]))


def iou2d(a: Box, b: Box, zero: str = "empty") -> Column:
    """Intersection over union; ``zero`` names what stands where the union is none: ``empty`` (0 without overlap), a floor
    of the denominator as a number's text, or ``positive`` (0 unless the denominator is)."""
    both = overlap2d(a, b)
    union = area2d(a) + area2d(b) - both
    if zero == "empty":
        return F.when(both <= 0, 0.0).otherwise(both / F.greatest(union, F.lit(1e-300)))
    if zero == "positive":
        return F.when(union > 0, both / F.when(union > 0, union)).otherwise(0.0)
    return both / F.greatest(union, F.lit(float(zero)))


def containment(parent: Box, child: Box) -> Column:
    """Share of the child's pixels inside the parent, both ends counting."""
    w = _positive(F.least(parent[2], child[2]) - F.greatest(parent[0], child[0]) + 1)
    h = _positive(F.least(parent[3], child[3]) - F.greatest(parent[1], child[1]) + 1)
    return w * h / ((child[2] - child[0] + 1) * (child[3] - child[1] + 1))


def touches(a: Box, width: float, height: float, margin: float) -> list[Column]:
    """Whether the left, top, right and bottom sides lie within ``margin`` of the image's border."""
    return [a[0] <= margin, a[1] <= margin, a[2] >= width - 1 - margin, a[3] >= height - 1 - margin]


def ownership(parent: Box, child: Box) -> dict[str, Column]:
    """How far a child belongs to a parent box: center inside, coverage, normalized distance, and their score in [0, 3]."""
    pw, ph = F.greatest(parent[2] - parent[0], F.lit(1.0)), F.greatest(parent[3] - parent[1], F.lit(1.0))
    cx, cy = (child[0] + child[2]) * 0.5, (child[1] + child[3]) * 0.5
    px, py = (parent[0] + parent[2]) * 0.5, (parent[1] + parent[3]) * 0.5
    inside = (parent[0] <= cx) & (cx <= parent[2]) & (parent[1] <= cy) & (cy <= parent[3])
    own = area2d(child)
    coverage = F.when(own <= 0, 0.0).otherwise(overlap2d(parent, child) / F.when(own > 0, own))
    distance = norm((cx - px) / pw, (cy - py) / ph)
    return {"inside": inside, "coverage": coverage, "distance": distance, "score": inside.cast("double") + coverage + F.exp(-distance)}


def iou3d(a: Sequence[Column], b: Sequence[Column], pad_m: float | None = None, pad_share: float = 0.01) -> Column:
    """Boxes as (x1 y1 z1 x2 y2 z2). With ``pad_m`` each box grows by the greater of it and a share of its extent on every
    side; without, an empty union gives 0."""
    if pad_m is not None:
        def grown(v: Sequence[Column]) -> list[Column]:
            pads = [F.greatest(F.lit(pad_m), (v[i + 3] - v[i]) * pad_share) for i in range(3)]
            return [v[i] - pads[i] for i in range(3)] + [v[i + 3] + pads[i] for i in range(3)]

        a, b = grown(a), grown(b)
    both = volume = other = F.lit(1.0)
    for i in range(3):
        both = both * _positive(F.least(a[i + 3], b[i + 3]) - F.greatest(a[i], b[i]))
        volume = volume * _positive(a[i + 3] - a[i])
        other = other * _positive(b[i + 3] - b[i])
    union = volume + other - both
    return F.when(union > 0, both / F.when(union > 0, union)).otherwise(0.0)


def gap3d(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Distance between the surfaces of two axis-aligned boxes; 0 where they meet."""
    return norm(*(_positive(F.greatest(a[i] - b[i + 3], b[i] - a[i + 3])) for i in range(3)))


def rotation(qw: Column, qx: Column, qy: Column, qz: Column) -> list[Column]:
    """Row-major rotation matrix of a quaternion, scalar first."""
    n = norm(qw, qx, qy, qz)
    w, x, y, z = qw / n, qx / n, qy / n, qz / n
    return [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y), 2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x), 2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]


def turned(r: Sequence[Column], v: Sequence[Column]) -> list[Column]:
    return [r[3 * i] * v[0] + r[3 * i + 1] * v[1] + r[3 * i + 2] * v[2] for i in range(3)]


def inverse_pose(r: Sequence[Column], t: Sequence[Column]) -> tuple[list[Column], list[Column]]:
    back = [r[3 * j + i] for i in range(3) for j in range(3)]
    return back, [-x for x in turned(back, t)]


def back_projected(u: Column, v: Column, z: Column, fx: Column, fy: Column, cx: Column, cy: Column) -> list[Column]:
    return [(u - cx) * z / fx, (v - cy) * z / fy, z]


def projected(p: Sequence[Column], fx: Column, fy: Column, cx: Column, cy: Column) -> tuple[Column, Column, Column]:
    """u, v, and whether the camera-space point lies before the camera."""
    front = p[2] > 1e-6
    z = F.when(front, p[2])
    return p[0] * fx / z + cx, p[1] * fy / z + cy, front


def axis_angle(v: Sequence[Column]) -> list[Column]:
    """Row-major rotation matrix of a rotation vector (Rodrigues)."""
    angle = norm(*v)
    safe = F.when(angle > 1e-12, angle).otherwise(1.0)
    x, y, z = (c / safe for c in v)
    s, c = F.sin(angle), F.cos(angle)
    k = 1 - c
    full = [c + x * x * k, x * y * k - z * s, x * z * k + y * s, y * x * k + z * s, c + y * y * k, y * z * k - x * s, z * x * k - y * s, z * y * k + x * s, c + z * z * k]
    return [F.when(angle > 1e-12, e).otherwise(float(i % 4 == 0)) for i, e in enumerate(full)]


def between(a: Column, b: Column, share: Column) -> Column:
    return a + (b - a) * share


def moved_box3d(r: Sequence[Column], t: Sequence[Column], b: Sequence[Column]) -> list[Column]:
    """The axis-aligned box around the eight mapped corners."""
    low, high = [], []
    for i in range(3):
        terms = [(r[3 * i + j] * b[j], r[3 * i + j] * b[j + 3]) for j in range(3)]
        low.append(t[i] + sum((F.least(*p) for p in terms[1:]), F.least(*terms[0])))
        high.append(t[i] + sum((F.greatest(*p) for p in terms[1:]), F.greatest(*terms[0])))
    return low + high


def to_inference(a: Box, scale: float, left: float, top: float) -> list[Column]:
    return [a[0] * scale - left, a[1] * scale - top, a[2] * scale - left, a[3] * scale - top]


def from_inference(a: Box, scale: float, left: float, top: float) -> list[Column]:
    return [(a[0] + left) / scale, (a[1] + top) / scale, (a[2] + left) / scale, (a[3] + top) / scale]


def segment_distance(p: Sequence[Column], a: Sequence[Column], b: Sequence[Column]) -> Column:
    d = [y - x for x, y in zip(a, b, strict=True)]
    length = sum((x * x for x in d[1:]), d[0] * d[0])
    along = sum(((q - x) * y for q, x, y in list(zip(p, a, d, strict=True))[1:]), (p[0] - a[0]) * d[0])
    share = F.when(length > 0, clip(along / F.when(length > 0, length), 0, 1)).otherwise(0.0)
    return norm(*(q - (x + share * y) for q, x, y in zip(p, a, d, strict=True)))
