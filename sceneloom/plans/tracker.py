"""The map of a sequence as keyed state: observations matched to nodes by four clues, geometry fused or refused, identity
kept without geometry, births, promotion, stable parents.

A sequence is one serial state, kept in the state store: a row a node, its points apart, so that a micro-batch rewrites only
nodes that it saw. Micro-batches bring ranges of frames; inside one, a sequence's frames go in order. A frame that is not
after the sequence's last one is late and changes nothing, so a batch that runs again gives what it gave. Sequences run in
parallel; what a task holds is one sequence's nodes and one batch of its frames, never the sequence.

An observation is a row: sequence, frame_idx, det_id, role, label, score, quality, status (reliable, provisional,
low_quality, rejected), imputed, border, points (array of x, y, z arrays), hist, feature (arrays), x1..y2, and the frame's
pose as tx, ty, tz (the camera looks along z). It may have: near (points for association; else ``points``), parents (det_ids
of its parents in the frame), witness (whether it repeats another role), depth (the frame's depth image as rows, in the
camera's proportions). Rows without points are left out; of rows with one det_id in a frame each counts.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass, field, fields
from functools import cached_property
from itertools import groupby
from operator import attrgetter

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.scores import IDENTITY_FLOOR
from ..operators.assign import best_pairs
from ..shared import scratch

SIGHT = ("reliable", "provisional")


@dataclass(frozen=True)
class Camera:
    fx: float = 500.0
    fy: float = 500.0
    cx: float = 320.0
    cy: float = 240.0
    width: int = 640
    height: int = 480


@dataclass(frozen=True)
class Settings:
    """A mapping run's parameters."""

    voxel: dict = field(default_factory=lambda: {"O": 0.005, "C": 0.004, "U": 0.004})
    near_voxel: float = 0.004
    most_points: int = 20_000
    most_near: int = 4096
    history: int = 12
    spread_over: int = 5
    spread: float = 0.08
    ema: float = 0.25
    appearance: float = 0.3
    residual: float = 0.12
    expansion: float = 2.5
    expansion_after: int = 2
    least_quality: float = 0.35
    stable_quality: float = 0.55
    support: int = 2
    sigma: float = 0.08
    least_score: float = 0.45
    distance: tuple = (0.03, 0.15, 0.5)  # floor, cap, share of the larger extent
    depth_tolerance: float = 0.08
    least_projected: int = 3
    parent_conflict: bool = True
    parent_support: int = 2
    identity: bool = False
    identity_semantic: float = 0.5
    identity_distance: tuple = (0.25, 0.5)


def iou(a: np.ndarray, b: np.ndarray) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return float(w * h / union) if union > 1e-9 else 0.0


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    n = np.linalg.norm(a) * np.linalg.norm(b)
    return float(np.clip(a @ b / n, 0, 1)) if n > 1e-12 else 0.0


def unit(a: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(a)
    return a / n if n > 1e-12 else np.zeros_like(a)


def _places(n: int) -> tuple:
    """Of n values in order, those about the 2nd and 98th percentile, and the shares between them."""
    at = (n - 1) * np.true_divide([2.0, 98.0], 100.0)
    low = np.floor(at).astype(np.int64)
    share = (at - low)[:, None]
    return low, np.minimum(low + 1, n - 1), share, 1 - share, share >= 0.5


def in_order(points: np.ndarray) -> np.ndarray:
    """Each coordinate in order; not numbers throughout where one is none, as of any statistic of them."""
    ordered = np.sort(points, axis=0)
    gone = np.isnan(ordered[-1])
    return np.where(gone, np.nan, ordered) if gone.any() else ordered


def bounds(points: np.ndarray, ordered: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The 2nd and 98th percentile of each coordinate: ``np.percentile``'s own steps, without its checks, which cost ten
    times as much on some dozen points."""
    ordered = in_order(points) if ordered is None else ordered
    low, high, share, rest, upper = _places(len(ordered))
    a, b = ordered[low], ordered[high]
    wide = b - a
    out = np.where(upper, b - wide * rest, a + wide * share)
    return out[0], out[1]


def middle(ordered: np.ndarray) -> np.ndarray:
    n = len(ordered)
    return ordered[n // 2].copy() if n % 2 else (ordered[n // 2 - 1] + ordered[n // 2]) / 2


def diagonal(low: np.ndarray, high: np.ndarray) -> float:
    return float(np.linalg.norm(np.maximum(high - low, 0)))


def voxel_means(points: np.ndarray, size: float, most: int) -> np.ndarray:
    cell = np.floor(points / size).astype(np.int64)
    order = np.lexsort(cell.T[::-1])
    cell = cell[order]
    at = np.empty(len(points), np.int64)
    at[order] = np.cumsum(np.append(False, (cell[1:] != cell[:-1]).any(axis=1)))
    means = np.stack([np.bincount(at, points[:, k]) for k in range(3)], axis=1) / np.bincount(at)[:, None]
    return means if len(means) <= most else means[np.linspace(0, len(means) - 1, most).round().astype(int)]


def seen_box(points: np.ndarray, at: np.ndarray, camera: Camera, depth: np.ndarray | None, s: Settings) -> np.ndarray | None:
    """The 2-98 percentile box, within the image, of the points near it; of those that nothing hides, where enough are."""
    p = points - at
    p = p[np.isfinite(p).all(axis=1) & (p[:, 2] > 1e-6)]
    uv = np.stack([camera.fx * p[:, 0] / p[:, 2] + camera.cx, camera.fy * p[:, 1] / p[:, 2] + camera.cy], axis=1)
    size = np.array([camera.width, camera.height])
    close = ((uv >= -size) & (uv <= 2 * size - 1)).all(axis=1)
    uv, z = uv[close], p[close, 2]
    if len(uv) < s.least_projected:
        return None
    if depth is not None and depth.size:
        cell = np.clip(np.round(uv).astype(np.int64), 0, size - 1) * np.array(depth.shape[::-1]) // size
        there = depth[cell[:, 1], cell[:, 0]]
        clear = np.isfinite(there) & (there > 0) & (z <= there + s.depth_tolerance)
        if clear.sum() >= s.least_projected:
            uv = uv[clear]
    return np.concatenate(bounds(np.clip(uv, 0, size - 1)))


@dataclass
class Node:
    """What the state store has of a node beside its points: histories that would grow with the sequence are counts."""

    role: str
    votes: dict
    hist: list
    feature: list
    weight: float
    center: list
    low: list
    high: list
    reach: float
    state: str
    anchor_frame: int
    anchor_det: int
    anchor_quality: float
    anchor_border: bool
    ema: float
    accepts: int
    rejects: int
    last_reject: str | None
    seen: int
    first_frame: int
    last_frame: int
    last_box: list
    support: int
    real: int
    imputed: int
    identity: int
    last_identity: int | None
    witnesses: int
    centers: list
    boxes: list
    qualities: list
    object_votes: dict
    carrier_votes: dict
    object_parent: str | None
    carrier_parent: str | None

    @property
    def label(self) -> str:
        return min(self.votes, key=lambda x: (-self.votes[x], x))


NODE = (
    "role string, votes map<string,double>, hist array<double>, feature array<double>, weight double, center array<double>, low array<double>, high array<double>, "
    "reach double, state string, anchor_frame long, anchor_det long, anchor_quality double, anchor_border boolean, ema double, accepts long, rejects long, last_reject string, "
    "seen long, first_frame long, last_frame long, last_box array<double>, support long, real long, imputed long, identity long, last_identity long, witnesses long, "
    "centers array<array<double>>, boxes array<array<double>>, qualities array<double>, object_votes map<string,long>, carrier_votes map<string,long>, object_parent string, carrier_parent string"
)
POINTS = "points binary, near binary, anchor binary"
EVENT = "sequence long, frame_idx long, det_id long, node_id string, kind string, fusion string, score double"


class Seen:
    """An observation with its arrays as numpy, which are made when first asked for: most observations are refused unseen."""

    def __init__(self, row):
        self.row = row

    def __getattr__(self, name: str):
        return getattr(self.row, name)

    def array(self, name: str) -> np.ndarray | None:
        rows = getattr(self.row, name, None)
        return None if rows is None else np.array(np.concatenate(rows), float).reshape(len(rows), -1) if len(rows) else np.empty((0, 0))

    @cached_property
    def points(self) -> np.ndarray:
        return self.array("points").reshape(-1, 3)

    @cached_property
    def near(self) -> np.ndarray:
        near = self.array("near")
        return self.points if near is None or not len(near) else near.reshape(-1, 3)

    @cached_property
    def depth(self) -> np.ndarray | None:
        return self.array("depth")

    @cached_property
    def hist(self) -> np.ndarray:
        return np.asarray(self.row.hist, float)

    @cached_property
    def feature(self) -> np.ndarray:
        return np.asarray(self.row.feature, float)

    @cached_property
    def center(self) -> np.ndarray:
        return self.points.mean(axis=0)

    @cached_property
    def low(self) -> np.ndarray:
        return self.points.min(axis=0)

    @cached_property
    def high(self) -> np.ndarray:
        return self.points.max(axis=0)

    @cached_property
    def reach(self) -> float:
        return diagonal(*bounds(self.near))

    @cached_property
    def box(self) -> np.ndarray:
        return np.array([self.row.x1, self.row.y1, self.row.x2, self.row.y2], float)

    @cached_property
    def parents(self) -> list[int]:
        parents = getattr(self.row, "parents", None)
        return [] if parents is None else [int(p) for p in parents]

    @cached_property
    def witness(self) -> bool:
        return bool(getattr(self.row, "witness", False) or False)


class Sequence:
    """The nodes of one sequence, and those that changed since they were read."""

    def __init__(self, camera: Camera, settings: Settings):
        self.camera, self.s = camera, settings
        self.nodes: dict[str, Node] = {}
        self.points: dict[str, list[np.ndarray]] = {}
        self.ids = {"O": 0, "C": 0, "U": 0}
        self.changed: set[str] = set()

    # one observation and one node

    def conflict(self, o: Seen, n: Node, found: dict[int, str]) -> bool:
        """Whether all stable parents that the frame gives the observation are others than the node's stable parent."""
        if not self.s.parent_conflict or o.role == "O":
            return False
        stable = [p for p in (found.get(d) for d in o.parents) if p and self.nodes[p].state == "stable"]
        other = lambda mine, role: mine and (own := [p for p in stable if self.nodes[p].role == role]) and mine not in own
        return bool(other(n.object_parent, "O") or (o.role == "U" and other(n.carrier_parent, "C")))

    def pair(self, o: Seen, k: str, found: dict[int, str], identity: bool) -> tuple[float, str]:
        """The four-clue score of an observation and a node, and the first gate that refuses the pair."""
        s, n = self.s, self.nodes[k]
        distance = float(np.linalg.norm(o.center - np.array(n.center)))
        semantic = cosine(o.feature, np.array(n.feature))
        if identity and n.state != "stable":
            return 0.0, "node_not_identity_eligible"
        refused = "stable_parent_conflict" if self.conflict(o, n, found) else ""
        box = None if refused else seen_box(self.points[k][1], np.array([o.tx, o.ty, o.tz], float), self.camera, o.depth, s)
        overlap = 0.0 if box is None else iou(o.box, box)
        total = 0.5 * overlap + (float(np.exp(-distance * distance / (2 * s.sigma**2))) + cosine(o.hist, np.array(n.hist)) + semantic) / 6
        floor, cap, share = s.distance
        far, share_of_own = s.identity_distance
        gates = [
            (bool(refused), refused),
            (box is None, "not_projectable"),
            (not identity and not distance < min(cap, max(floor, share * max(n.reach, o.reach))), "distance_gate"),
            (not overlap > 0, "iou_gate"),
            (total < s.least_score, "score_gate"),
            (identity and semantic < s.identity_semantic, "semantic_gate"),
            (identity and not distance < max(IDENTITY_FLOOR.get(o.role, 0.0), min(far, share_of_own * diagonal(np.array(n.low), np.array(n.high)))), "identity_distance_gate"),
        ]
        return total, next((why for hit, why in gates if hit), "")

    def fusion(self, o: Seen, n: Node) -> str:
        """``accepted``, or the first gate that keeps an observation's points out."""
        s, low, high = self.s, np.array(n.low), np.array(n.high)
        grown = diagonal(np.minimum(low, o.low), np.maximum(high, o.high)) / max(diagonal(low, high), 1e-6)
        gates = [
            (o.status not in SIGHT, f"obs_{o.status}"),
            (o.imputed and n.state == "stable", "imputed_geometry_not_fused_into_stable"),
            (o.quality < s.least_quality, "quality_gate"),
            (np.linalg.norm(o.center - np.array(n.center)) > s.residual, "centroid_residual_gate"),
            (n.seen >= s.expansion_after and grown > s.expansion, "bbox_expansion_gate"),
        ]
        return next((why for hit, why in gates if hit), "accepted")

    # changes of a node

    def born(self, o: Seen) -> str:
        self.ids[o.role] += 1
        k = f"{o.role}{self.ids[o.role]:06d}"
        f, real = int(o.frame_idx), int(not o.imputed)
        low, high = o.low.tolist(), o.high.tolist()
        self.nodes[k] = Node(
            o.role, {o.label: float(o.score)}, o.hist.tolist(), o.feature.tolist(), float(o.score), o.center.tolist(), low, high, o.reach, "provisional", f, int(o.det_id), float(o.quality), bool(o.border), float(o.quality),
            1, 0, None, 1, f, f, o.box.tolist(), 1, real, 1 - real, 0, None, int(o.witness), [o.center.tolist()], [low + high], [float(o.quality)], {}, {}, None, None,
        )
        self.points[k] = [o.points, o.near, o.points]
        self.changed.add(k)
        return k

    def update(self, k: str, o: Seen) -> str:
        s, n, f = self.s, self.nodes[k], int(o.frame_idx)
        how = self.fusion(o, n)
        if how == "accepted":
            own, near, _ = self.points[k]
            own = voxel_means(np.concatenate([own, o.points]), s.voxel[n.role], s.most_points)
            near = voxel_means(np.concatenate([near, o.near]), s.near_voxel, s.most_near)
            self.points[k][:2] = own, near
            ordered = in_order(own)
            low, high = bounds(own, ordered)
            n.center, n.low, n.high, n.reach = middle(ordered).tolist(), low.tolist(), high.tolist(), diagonal(*bounds(near))
            n.accepts, n.last_reject = n.accepts + 1, None
        else:
            n.rejects, n.last_reject = n.rejects + 1, how
        n.hist = unit((1 - s.appearance) * np.array(n.hist) + s.appearance * o.hist).tolist()
        n.feature = unit(np.array(n.feature) * n.weight + o.feature * o.score).tolist()
        n.weight += float(o.score)
        n.votes[o.label] = n.votes.get(o.label, 0.0) + float(o.score)
        new = f != n.last_frame
        n.seen, n.last_frame, n.last_box = n.seen + 1, f, o.box.tolist()
        n.witnesses += int(o.witness and new)
        if o.quality > n.anchor_quality and not o.imputed and o.status in SIGHT:
            n.anchor_frame, n.anchor_det, n.anchor_quality, n.anchor_border = f, int(o.det_id), float(o.quality), bool(o.border)
            self.points[k][2] = o.points
        n.support, n.real, n.imputed = n.support + new, n.real + int(new and not o.imputed), n.imputed + int(new and bool(o.imputed))
        n.centers = [*n.centers, o.center.tolist()][-s.history :]
        n.boxes = [*n.boxes, [*o.low.tolist(), *o.high.tolist()]][-s.history :]
        n.qualities = [*n.qualities, float(o.quality)][-s.history :]
        n.ema = (1 - s.ema) * n.ema + s.ema * float(o.quality)
        last = np.array(n.centers[-s.spread_over :])
        spread = float(np.linalg.norm(last - np.median(last, axis=0), axis=1).max())
        if n.support >= s.support and n.real >= s.support and n.ema >= s.stable_quality and spread <= s.spread:
            n.state = "stable"
        self.changed.add(k)
        return how

    def vote(self, o: Seen, k: str, found: dict[int, str]) -> None:
        """A frame's stable parents of a node; the one ahead by a frame or more becomes its stable parent."""
        n = self.nodes[k]
        for p in sorted({found[d] for d in o.parents if d in found}):
            role = self.nodes[p].role
            if self.nodes[p].state != "stable" or (n.role, role) not in (("C", "O"), ("U", "O"), ("U", "C")):
                continue
            votes = n.object_votes if role == "O" else n.carrier_votes
            votes[p] = votes.get(p, 0) + 1
            (best, name), *rest = sorted(((v, q) for q, v in votes.items()), reverse=True)
            if best >= self.s.parent_support and best - (rest[0][0] if rest else 0) >= 1:
                if role == "O":
                    n.object_parent = name
                else:
                    n.carrier_parent = name
            self.changed.add(k)

    # a frame

    def matched(self, seen: list[Seen], known: list[str], found: dict[int, str], identity: bool) -> dict[int, tuple[str, float]]:
        """The node and score of each observation that has one, for the greatest total score."""
        score, valid = np.zeros((len(seen), len(known))), np.zeros((len(seen), len(known)), bool)
        if not seen or not known:
            return {}
        # no gate lets a pair through beyond the largest distance, so that only pairs within it are scored
        most = max(self.s.identity_distance[0], *IDENTITY_FLOOR.values()) if identity else self.s.distance[1]
        apart = np.linalg.norm(np.array([o.center for o in seen])[:, None] - np.array([self.nodes[k].center for k in known])[None], axis=2)
        for i, j in zip(*np.nonzero(apart < most)):
            score[i, j], why = self.pair(seen[i], known[j], found, identity)
            valid[i, j] = not why
        return {i: (known[j], float(score[i, j])) for i, j in best_pairs(score, valid)}

    def frame(self, observations: list[Seen]) -> list[tuple]:
        """det_id, node_id, kind, fusion, score of each observation: objects, carriers, units in turn."""
        out, found = [], {}
        for role in "OCU":
            own = sorted((o for o in observations if o.role == role), key=lambda o: o.det_id)
            good, weak = [o for o in own if o.status in SIGHT], [o for o in own if o.status == "low_quality"]
            out += [(o.det_id, None, "rejected", None, None) for o in own if o.status not in (*SIGHT, "low_quality")]
            same = sorted(k for k, n in self.nodes.items() if n.role == role)
            hits = self.matched(good, same, found, False)
            for i, (k, score) in sorted(hits.items()):
                out.append((good[i].det_id, k, "match", self.update(k, good[i]), round(score, 6)))
            found |= {good[i].det_id: k for i, (k, _) in hits.items()}
            kept = self.matched(weak, [k for k in same if self.nodes[k].state == "stable"], found, True) if self.s.identity else {}
            for i, o in enumerate(weak):
                if i not in kept:
                    out.append((o.det_id, None, "skipped", None, None))
                    continue
                k, score = kept[i]
                n = self.nodes[k]
                n.identity, n.last_identity = n.identity + int(n.last_identity != int(o.frame_idx)), int(o.frame_idx)
                self.changed.add(k)
                found[o.det_id] = k
                out.append((o.det_id, k, "identity", "not_attempted_identity_only", round(score, 6)))
            for i, o in enumerate(good):
                if i not in hits:
                    found[o.det_id] = self.born(o)
                    out.append((o.det_id, found[o.det_id], "birth", "accepted", None))
        for o in observations:
            if o.parents and o.det_id in found:
                self.vote(o, found[o.det_id], found)
        return out


_bytes = lambda a: np.ascontiguousarray(a, np.float64).tobytes()
_points = lambda b: np.frombuffer(bytes(b), np.float64).reshape(-1, 3)


class Tracker(StatefulProcessor):
    """State of a sequence: its last frame and numbers given, a row a node, and each node's points."""

    def __init__(self, camera: Camera, settings: Settings):
        self.camera, self.settings = camera, settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.clock = handle.getValueState("clock", "frame long, O long, C long, U long")
        self.nodes = handle.getMapState("nodes", "node_id string", NODE)
        self.points = handle.getMapState("points", "node_id string", POINTS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        m, last = Sequence(self.camera, self.settings), None
        if self.clock.exists():
            last, *ids = self.clock.get()
            m.ids = dict(zip("OCU", map(int, ids)))
        for k, v in self.nodes.iterator():
            values = {f.name: x for f, x in zip(fields(Node), v)}
            m.nodes[k[0]] = Node(**{n: dict(x) if isinstance(x, dict) else [list(y) if isinstance(y, list | Row | tuple) else y for y in x] if isinstance(x, list | Row | tuple) else x for n, x in values.items()})
        for k, v in self.points.iterator():
            m.points[k[0]] = [_points(b) for b in v]
        batch, out = pd.concat(list(rows), ignore_index=True), []
        batch = batch[batch["frame_idx"].notna()].sort_values("frame_idx", kind="stable")
        for f, frame in groupby(batch.itertuples(index=False), attrgetter("frame_idx")):  # one pass: a frame has few rows
            seen = [Seen(r) for r in frame if r.points is not None and len(r.points)]
            if last is not None and f <= last:
                out += [(key[0], int(f), o.det_id, None, "late", None, None) for o in seen]
                continue
            out += [(key[0], int(f), *r) for r in m.frame(seen)]
            last = int(f)
        if last is not None:
            self.clock.update((last, m.ids["O"], m.ids["C"], m.ids["U"]))
        for k in sorted(m.changed):
            n = m.nodes[k]
            self.nodes.updateValue((k,), tuple(getattr(n, f.name) for f in fields(Node)))
            self.points.updateValue((k,), tuple(map(_bytes, m.points[k])))
        events = pd.DataFrame(out, columns=[c.split()[0] for c in EVENT.split(", ")])
        yield events.assign(node=[None] * len(events))
        now = [(key[0], last, None, k, "node", None, None, _snapshot(m.nodes[k], len(m.points[k][0]))) for k in sorted(m.changed)]
        yield pd.DataFrame(now, columns=[*events.columns, "node"])

    def close(self) -> None:
        pass


SNAPSHOT = (
    "role string, label string, state string, n_points long, cx double, cy double, cz double, x1 double, y1 double, z1 double, x2 double, y2 double, z2 double, quality_ema double, "
    "anchor_frame long, anchor_det long, anchor_quality double, border boolean, n_seen long, n_support long, n_real long, n_imputed long, n_identity long, n_witness long, accepts long, refusals long, last_refusal string, "
    "first_frame long, last_frame long, object_parent string, carrier_parent string"
)


def _snapshot(n: Node, points: int) -> tuple:
    return (
        n.role, n.label, n.state, points, *n.center, *n.low, *n.high, n.ema, n.anchor_frame, n.anchor_det, n.anchor_quality, n.anchor_border, n.seen, n.support, n.real, n.imputed, n.identity, n.witnesses,
        n.accepts, n.rejects, n.last_reject, n.first_frame, n.last_frame, n.object_parent, n.carrier_parent,
    )


def used(observations: DataFrame, settings: Settings) -> DataFrame:
    """Observations without the arrays that no step reads: a refused one is an event and no more. A point without coordinates
    stands for its points, so that it is told from those that have none."""
    read = F.coalesce(F.col("status").isin(*SIGHT, *(["low_quality"] if settings.identity else [])), F.lit(False))
    kinds = {f.name: f.dataType for f in observations.schema}
    out = {c: F.when(read, F.col(c)) for c in ("near", "hist", "feature", "depth") if c in kinds}
    return observations.withColumns(out | {"points": F.when(read | (F.coalesce(F.size("points"), F.lit(0)) < 1), F.col("points")).otherwise(F.array(F.array()).cast(kinds["points"]))})


def track(stream: DataFrame, camera: Camera = Camera(), settings: Settings = Settings()) -> DataFrame:
    """A stream of observations as one of events (``node`` null) and of nodes that a batch changed (kind ``node``)."""
    # Spark asks for the state's schema in a process of the driver that does not see shipped packages, so this one is sent whole
    package = sys.modules[__package__.split(".")[0]]
    cloudpickle.register_pickle_by_value(package)
    try:
        return used(stream, settings).groupBy("sequence").transformWithStateInPandas(Tracker(camera, settings), f"{EVENT}, node struct<{SNAPSHOT.replace(' ', ':').replace(',:', ',')}>", "Append", "None")
    finally:
        cloudpickle.unregister_pickle_by_value(package)


def drain(spark, folder: str, schema, camera: Camera = Camera(), settings: Settings = Settings(), each=None) -> DataFrame:
    """Runs the tracker over the files in ``folder``/in that it has not read, from its checkpoint there, and gives the rows of
    all batches so far. ``each``: called again and again before a batch, to bring files; false when there are no more."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rows = track(spark.readStream.schema(schema).parquet(f"{folder}/in"), camera, settings)
        put = lambda batch, i: batch.write.mode("overwrite").parquet(f"{folder}/out/batch={i}")  # noqa: E731  a batch that runs again writes the same
        q = rows.writeStream.outputMode("append").foreachBatch(put).option("checkpointLocation", f"{folder}/state")
        if each is None:
            q.trigger(availableNow=True).start().awaitTermination()
        else:
            running = q.start()
            try:
                while each():
                    running.processAllAvailable()
            finally:
                running.stop()
    finally:
        spark.conf.set(name, before)
    return spark.read.schema(rows.schema.add("batch", "long")).parquet(f"{folder}/out")


def replayed(observations: DataFrame, batches: int = 4, camera: Camera = Camera(), settings: Settings = Settings()) -> DataFrame:
    """The tracker's rows over a table of observations, brought in ``batches`` ranges of frames one after another."""
    spark = observations.sparkSession
    folder = scratch(spark, "track")
    observations.write.parquet(f"{folder}/all")
    rows = spark.read.schema(observations.schema).parquet(f"{folder}/all")
    low, high = rows.agg(F.min("frame_idx"), F.max("frame_idx")).first()
    rows.limit(0).write.parquet(f"{folder}/in")
    todo = iter([] if low is None else range(batches))
    range_of = F.floor((F.col("frame_idx") - F.lit(low)) * F.lit(batches) / F.lit(1 if low is None else high - low + 1))

    def bring() -> bool:
        i = next(todo, None)
        if i is None:
            return False
        rows.filter(range_of == i).write.mode("append").parquet(f"{folder}/in")
        return True

    spark.createDataFrame([], f"{EVENT}, node struct<{SNAPSHOT.replace(' ', ':').replace(',:', ',')}>").write.parquet(f"{folder}/out/batch=-1")
    return drain(spark, folder, observations.schema, camera, settings, bring)


def events(rows: DataFrame) -> DataFrame:
    """sequence, frame_idx, det_id, node_id, kind, fusion, score of each observation that has points."""
    return rows.where("kind <> 'node'").drop("node", "batch")


def nodes(rows: DataFrame) -> DataFrame:
    """The nodes of each sequence after its last frame so far."""
    newest = rows.where("kind = 'node'").groupBy("sequence", "node_id").agg(F.max_by("node", "batch").alias("node"))
    return newest.select("sequence", "node_id", "node.*")


def covisible(rows: DataFrame) -> DataFrame:
    """sequence, a, b, frames: nodes that frames show together."""
    seen = events(rows).where("node_id is not null").select("sequence", "frame_idx", "node_id").distinct()
    other = seen.withColumnRenamed("node_id", "b")
    return seen.withColumnRenamed("node_id", "a").join(other, ["sequence", "frame_idx"]).where("a < b").groupBy("sequence", "a", "b").agg(F.count("*").alias("frames"))


def tracked(observations: DataFrame, camera: Camera = Camera(), settings: Settings = Settings(), batches: int = 4) -> DataFrame:
    return events(replayed(observations, batches, camera, settings))


def built(observations: DataFrame, camera: Camera = Camera(), settings: Settings = Settings(), batches: int = 4) -> DataFrame:
    return nodes(replayed(observations, batches, camera, settings))
