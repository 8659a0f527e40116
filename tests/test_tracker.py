"""The tracker on keyed state: equal to a plain serial computation, whatever the batches; restarts; each gate."""

from __future__ import annotations

import itertools
import math
from collections import defaultdict

import numpy as np
import pytest

from sceneloom.plans import tracker as K

SCHEMA = (
    "sequence long, frame_idx long, det_id long, role string, label string, score double, quality double, status string, imputed boolean, border boolean, points array<array<double>>, hist array<double>, "
    "feature array<double>, x1 double, y1 double, x2 double, y2 double, tx double, ty double, tz double, parents array<long>, witness boolean, depth array<array<double>>"
)


def seen(frame, det, at, role="U", label="handle", quality=0.8, status="reliable", imputed=False, feature=(1.0, 0.0), half=0.02, sequence=0, parents=None, witness=None, depth=None):
    """An observation of a small box about a place, seen by a camera at the origin."""
    points = [[at[0] + a, at[1] + b, at[2] + c] for a in (-half, 0.0, half) for b in (-half, half) for c in (-half, half)]
    u, v, r = 500 * at[0] / at[2] + 320, 500 * at[1] / at[2] + 240, 500 * half / at[2]
    return (sequence, frame, det, role, label, 0.9, quality, status, imputed, False, points, [1.0, 0.0], list(feature), u - r, v - r, u + r, v + r, 0.0, 0.0, 0.0, parents, witness, depth)


# a plain serial map: rows in, (events, nodes) out; pairs are chosen by trying all


def percentile(values, q):
    values = sorted(values)
    at = (len(values) - 1) * q / 100
    low = math.floor(at)
    return values[low] + (values[min(low + 1, len(values) - 1)] - values[low]) * (at - low)


def box3(points):
    return [[percentile([p[k] for p in points], q) for k in range(3)] for q in (2, 98)]


def size(low, high):
    return math.sqrt(sum(max(b - a, 0) ** 2 for a, b in zip(low, high)))


def cells(points, voxel):
    groups = defaultdict(list)
    for p in points:
        groups[tuple(math.floor(x / voxel) for x in p)].append(p)
    return [[sum(p[k] for p in g) / len(g) for k in range(3)] for _, g in sorted(groups.items())]


def cos(a, b):
    n = math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
    return min(1.0, max(0.0, sum(x * y for x, y in zip(a, b)) / n)) if n > 1e-12 else 0.0


def normed(a):
    n = math.sqrt(sum(x * x for x in a))
    return [x / n for x in a] if n > 1e-12 else [0.0] * len(a)


def projected(points, depth):
    uv = [(500 * x / z + 320, 500 * y / z + 240, z) for x, y, z in points if z > 1e-6]
    uv = [p for p in uv if -640 <= p[0] <= 1279 and -480 <= p[1] <= 959]
    if len(uv) < 3:
        return None
    if depth:
        rows, cols = len(depth), len(depth[0])
        clip = lambda x, n: min(max(int(np.round(x)), 0), n - 1)
        open_ = [p for p in uv if 0 < (d := depth[clip(p[1], 480) * rows // 480][clip(p[0], 640) * cols // 640]) and p[2] <= d + 0.08]
        uv = open_ if len(open_) >= 3 else uv
    xs, ys = [min(max(p[0], 0), 639) for p in uv], [min(max(p[1], 0), 479) for p in uv]
    return [percentile(xs, 2), percentile(ys, 2), percentile(xs, 98), percentile(ys, 98)]


def overlap(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    return w * h / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h)


def best(score):
    """The subset of legal pairs of greatest total, by trying all. score: {(i, j): value}."""
    rows = sorted({i for i, _ in score})
    options = [[None, *(j for (a, j) in score if a == i)] for i in rows]
    found, most = {}, 0.0
    for choice in itertools.product(*options):
        used = [j for j in choice if j is not None]
        total = sum(score[i, j] for i, j in zip(rows, choice) if j is not None)
        if len(set(used)) == len(used) and total > most + 1e-12:
            found, most = {i: j for i, j in zip(rows, choice) if j is not None}, total
    return found


def serial(rows, identity=False):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    events, everything = [], {}
    sequences = defaultdict(lambda: defaultdict(list))
    for r in rows:
        r = dict(zip(names, r))
        sequences[r["sequence"]][r["frame_idx"]].append(r)
    for s, frames in sorted(sequences.items()):
        nodes, ids = {}, {"O": 0, "C": 0, "U": 0}
        for f, obs in sorted(frames.items()):
            place = {}
            for o in obs:
                o["c"] = [sum(p[k] for p in o["points"]) / len(o["points"]) for k in range(3)]
                o["lo"], o["hi"] = [min(p[k] for p in o["points"]) for k in range(3)], [max(p[k] for p in o["points"]) for k in range(3)]
                o["xy"] = [o["x1"], o["y1"], o["x2"], o["y2"]]
            for role in "OCU":
                mine = sorted((o for o in obs if o["role"] == role), key=lambda o: o["det_id"])
                good = [o for o in mine if o["status"] in ("reliable", "provisional")]
                for o in mine:
                    if o["status"] not in ("reliable", "provisional", "low_quality"):
                        events.append((s, f, o["det_id"], None, "rejected", None, None))

                def scores(group, weak):
                    out = {}
                    for i, o in enumerate(group):
                        for k, n in nodes.items():
                            if n["role"] != role or (weak and n["state"] != "stable"):
                                continue
                            parents = [place[d] for d in o["parents"] or [] if d in place and nodes[place[d]]["state"] == "stable"]
                            over = [p for p in parents if nodes[p]["role"] == "O"]
                            with_ = [p for p in parents if nodes[p]["role"] == "C"]
                            if role != "O" and ((n["po"] and over and n["po"] not in over) or (role == "U" and n["pc"] and with_ and n["pc"] not in with_)):
                                continue
                            d = math.dist(o["c"], n["c"])
                            box = projected(n["near"], o["depth"])
                            iou = overlap(o["xy"], box) if box else 0.0
                            sem = cos(o["feature"], n["feature"])
                            total = iou / 2 + (math.exp(-d * d / 0.0128) + cos(o["hist"], n["hist"]) + sem) / 6
                            reach = min(0.15, max(0.03, 0.5 * max(size(*box3(n["near"])), size(*box3(o["points"])))))
                            if weak:
                                reach = max({"O": 0.08, "C": 0.05, "U": 0.03}[role], min(0.25, 0.5 * size(n["lo"], n["hi"])))
                            if d < reach and iou > 0 and total >= 0.45 and (not weak or sem >= 0.5):
                                out[i, k] = total
                    return out

                score = scores(good, False)
                hits = best(score)
                for i, k in sorted(hits.items()):
                    o, n = good[i], nodes[k]
                    grown = size([min(a, b) for a, b in zip(n["lo"], o["lo"])], [max(a, b) for a, b in zip(n["hi"], o["hi"])]) / max(size(n["lo"], n["hi"]), 1e-6)
                    why = "accepted"
                    if o["imputed"] and n["state"] == "stable":
                        why = "imputed_geometry_not_fused_into_stable"
                    elif o["quality"] < 0.35:
                        why = "quality_gate"
                    elif math.dist(o["c"], n["c"]) > 0.12:
                        why = "centroid_residual_gate"
                    elif n["count"] >= 2 and grown > 2.5:
                        why = "bbox_expansion_gate"
                    if why == "accepted":
                        n["points"] = cells(n["points"] + o["points"], 0.005 if role == "O" else 0.004)
                        n["near"] = cells(n["near"] + o["points"], 0.004)
                        n["c"] = [percentile([p[k] for p in n["points"]], 50) for k in range(3)]
                        n["lo"], n["hi"] = box3(n["points"])
                    n["hist"] = normed([0.7 * a + 0.3 * b for a, b in zip(n["hist"], o["hist"])])
                    n["feature"] = normed([a * n["w"] + b * o["score"] for a, b in zip(n["feature"], o["feature"])])
                    n["w"] += o["score"]
                    n["count"] += 1
                    n["frames"].add(f)
                    n["real"] |= set() if o["imputed"] else {f}
                    n["centers"].append(o["c"])
                    n["ema"] = 0.75 * n["ema"] + 0.25 * o["quality"]
                    last = n["centers"][-5:]
                    mid = [percentile([p[k] for p in last], 50) for k in range(3)]
                    if len(n["frames"]) >= 2 and len(n["real"]) >= 2 and n["ema"] >= 0.55 and max(math.dist(p, mid) for p in last) <= 0.08:
                        n["state"] = "stable"
                    place[o["det_id"]] = k
                    events.append((s, f, o["det_id"], k, "match", why, round(score[i, k], 6)))
                weak = [o for o in mine if o["status"] == "low_quality"]
                score = scores(weak, True) if identity else {}
                kept = best(score)
                for i, o in enumerate(weak):
                    if i in kept:
                        place[o["det_id"]] = kept[i]
                        events.append((s, f, o["det_id"], kept[i], "identity", "not_attempted_identity_only", round(score[i, kept[i]], 6)))
                    else:
                        events.append((s, f, o["det_id"], None, "skipped", None, None))
                for i, o in enumerate(good):
                    if i not in hits:
                        ids[role] += 1
                        k = f"{role}{ids[role]:06d}"
                        nodes[k] = {"role": role, "state": "provisional", "points": o["points"], "near": o["points"], "c": o["c"], "lo": o["lo"], "hi": o["hi"], "hist": o["hist"], "feature": o["feature"], "w": o["score"], "count": 1, "frames": {f}, "real": set() if o["imputed"] else {f}, "centers": [o["c"]], "ema": o["quality"], "po": None, "pc": None, "hist_o": defaultdict(set), "hist_c": defaultdict(set)}
                        place[o["det_id"]] = k
                        events.append((s, f, o["det_id"], k, "birth", "accepted", None))
            for o in obs:
                if o["det_id"] in place:
                    n = nodes[place[o["det_id"]]]
                    for p in {place[d] for d in o["parents"] or [] if d in place}:
                        role = nodes[p]["role"]
                        if nodes[p]["state"] == "stable" and (n["role"], role) in {("C", "O"), ("U", "O"), ("U", "C")}:
                            which, slot = ("hist_o", "po") if role == "O" else ("hist_c", "pc")
                            n[which][p].add(f)
                            ranked = sorted(((len(v), q) for q, v in n[which].items()), reverse=True)
                            if ranked[0][0] >= 2 and ranked[0][0] - (ranked[1][0] if len(ranked) > 1 else 0) >= 1:
                                n[slot] = ranked[0][1]
        everything[s] = nodes
    return events, everything


def made_up():
    """Three sequences: drifting things in three roles with parents, weak and imputed sightings, hidden and missing frames."""
    rng = np.random.default_rng(11)
    rows = []
    for s in range(3):
        for f in range(14):
            if f == 6 and s == 1:
                continue
            for i in range(4):
                if rng.uniform() < 0.15:
                    continue
                shift = rng.normal(0, 0.006, 3)
                at = tuple(map(float, (0.28 * i - 0.4 + shift[0] + 0.002 * f, 0.1 * (i % 2) + shift[1], 1.5 + shift[2] + (0.4 if i == 3 and f > 9 else 0.0))))
                role = "OCUU"[i]
                quality = float(rng.choice([0.9, 0.7, 0.5, 0.3]))
                status = {0.9: "reliable", 0.7: "reliable", 0.5: "provisional", 0.3: str(rng.choice(["low_quality", "provisional", "rejected"]))}[quality]
                parents = [[], [0], [0, 1], [1] if f < 8 else [0, 1]][i]
                depth = [[1.3 if x < 40 else 9.0 for x in range(64)] for _ in range(48)] if f % 4 == 3 else None
                rows.append(seen(f, i, at, role, ["desk", "door", "handle", "knob"][i] if rng.uniform() < 0.8 else "thing", quality, status, bool(rng.uniform() < 0.2), tuple(map(float, rng.uniform(0.4, 1, 2))), half=float(rng.choice([0.02, 0.03])), sequence=s, parents=parents, witness=bool(i == 2), depth=depth))
    return rows


def rounded(events):
    return sorted((tuple(round(x, 5) if isinstance(x, float) else x for x in e) for e in events), key=str)


@pytest.mark.parametrize("identity,batches", [(False, 3), (True, 1)])
def test_same_as_serial(spark, identity, batches):
    rows = made_up()
    want, maps = serial(rows, identity)
    out = K.replayed(spark.createDataFrame(rows, SCHEMA), batches, settings=K.Settings(identity=identity))
    assert rounded(map(tuple, K.events(out).collect())) == rounded(want)
    got = {(r["sequence"], r["node_id"]): r for r in K.nodes(out).collect()}
    assert set(got) == {(s, k) for s, nodes in maps.items() for k in nodes}
    for (s, k), r in got.items():
        n = maps[s][k]
        assert (r["state"], r["n_points"], r["n_support"], r["n_real"], r["n_seen"], r["object_parent"], r["carrier_parent"]) == (n["state"], len(n["points"]), len(n["frames"]), len(n["real"]), n["count"], n["po"], n["pc"])
        assert [r["cx"], r["cy"], r["cz"], r["x1"], r["z2"], r["quality_ema"]] == pytest.approx([*n["c"], n["lo"][0], n["hi"][2], n["ema"]], abs=1e-9)
    assert {e[4] for e in want} >= {"match", "birth", "skipped", "rejected"} | ({"identity"} if identity else set())
    assert any(r["object_parent"] for r in got.values()) and any(r["carrier_parent"] for r in got.values())


def test_restart_between_frames(spark, tmp_path):
    """A stream that is stopped after each range of frames goes on from its checkpoint; what comes late changes nothing."""
    rows = made_up()
    want, _ = serial(rows)
    df, at = spark.createDataFrame(rows, SCHEMA), str(tmp_path / "t")
    for low, high in ((0, 4), (5, 8), (9, 20)):
        df.where(f"frame_idx BETWEEN {low} AND {high}").coalesce(1).write.mode("append").parquet(f"{at}/in")
        out = K.drain(spark, at, df.schema)
    assert rounded(map(tuple, K.events(out).collect())) == rounded(want)
    df.where("frame_idx = 3").coalesce(1).write.mode("append").parquet(f"{at}/in")
    after = K.drain(spark, at, df.schema)
    late = K.events(after).where("kind = 'late'")
    assert late.count() == df.where("frame_idx = 3").count() and K.nodes(after).count() == K.nodes(out).count()
    pairs = {(r["sequence"], r["a"], r["b"]) for r in K.covisible(after).collect()}
    together = defaultdict(set)
    for e in want:
        if e[3]:
            together[e[:2]].add(e[3])
    assert pairs == {(s, a, b) for (s, _), k in together.items() for a in k for b in k if a < b}


def test_gates(spark):
    at = (0.0, 0.0, 1.5)
    base = [seen(0, 0, at), seen(1, 0, at)]

    def last(*cases, identity=False):
        """Each case is a frame 2 of a sequence of its own."""
        rows = [(s, *r[1:]) for s, case in enumerate(cases) for r in [*base, *case]]
        out = K.tracked(spark.createDataFrame(rows, SCHEMA), settings=K.Settings(identity=identity), batches=1).where("frame_idx = 2").collect()
        return [{r["det_id"]: (r["node_id"], r["kind"], r["fusion"]) for r in out if r["sequence"] == s} for s in range(len(cases))]

    far = list(seen(2, 0, at))
    far[13:17] = [0.0, 0.0, 9.0, 9.0]
    got = last([seen(2, 0, at, imputed=True)], [seen(2, 0, (0.0, 0.0, 1.51), quality=0.3, status="provisional")], [seen(2, 0, (0.004, 0.0, 1.5), half=0.055)], [tuple(far)], [seen(2, 0, at, quality=0.25, status="low_quality")])
    assert got[0] == {0: ("U000001", "match", "imputed_geometry_not_fused_into_stable")}
    assert got[1] == {0: ("U000001", "match", "quality_gate")}
    assert got[2] == {0: ("U000001", "match", "bbox_expansion_gate")}
    assert got[3] == {0: ("U000002", "birth", "accepted")}  # without an overlap in the image there is no match, however near
    assert got[4] == {0: (None, "skipped", None)}  # off as configured
    weak = last([seen(2, 0, at, quality=0.25, status="low_quality")], [seen(2, 0, at, quality=0.25, status="low_quality", feature=(0.0, 1.0)), seen(2, 1, (0.3, 0.0, 1.5), status="low_quality"), seen(2, 2, at, status="rejected")], identity=True)
    assert weak[0] == {0: ("U000001", "identity", "not_attempted_identity_only")}
    assert weak[1] == {0: (None, "skipped", None), 1: (None, "skipped", None), 2: (None, "rejected", None)}


def test_empty_and_missing_points(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert K.tracked(none).count() == 0 and K.built(none).count() == 0
    bare = list(seen(0, 0, (0.0, 0.0, 1.5)))
    bare[10] = None
    assert K.tracked(spark.createDataFrame([tuple(bare), seen(0, 1, (0.0, 0.0, 1.5))], SCHEMA), batches=1).count() == 1
