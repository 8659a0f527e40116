"""Mapping plans: clusters and normals of point sets, tracking, consolidation, immediate parents, reports."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as G
from ..functions import labels as L
from ..functions import scores as S
from ..operators.aggregates import gap as box_gap
from ..operators.aggregates import with_groups
from ..operators.fixpoint import saved, stored
from ..operators.joins import alike_sized, sized_boxes, within
from ..operators.windows import evenly, top_with_margin

BOX = ("x1", "y1", "z1", "x2", "y2", "z2")


def normals(points: DataFrame, by: str) -> DataFrame:
    """by, n, nx, ny, nz: the direction of least spread about the median; its greatest part is positive."""
    m = points.groupBy(by).agg(F.count("*").alias("n"), *[F.median(c).alias(f"m{c}") for c in "xyz"])
    d = points.join(m, by).select(by, "n", *[(F.col(c) - F.col(f"m{c}")).alias(c) for c in "xyz"])
    pairs = [(a, b) for i, a in enumerate("xyz") for b in "xyz"[i:]]
    sums = d.groupBy(by, "n").agg(*[F.avg(F.col(a) * F.col(b)).alias(a + b) for a, b in pairs])

    def eigen(batches):
        for g in batches:
            c = np.zeros((len(g), 3, 3))
            for a, b in pairs:
                i, j = "xyz".index(a), "xyz".index(b)
                c[:, i, j] = c[:, j, i] = g[a + b]
            v = np.linalg.eigh(c)[1][:, :, 0] if len(g) else np.empty((0, 3))
            big = np.abs(v).argmax(axis=1)
            v = v * np.where(v[np.arange(len(v)), big] < 0, -1.0, 1.0)[:, None]
            yield pd.DataFrame({by: g[by], "n": g["n"], "nx": v[:, 0].round(6), "ny": v[:, 1].round(6), "nz": v[:, 2].round(6)})

    return sums.mapInPandas(eigen, f"{by} {dict(points.dtypes)[by]}, n long, nx double, ny double, nz double")


def close_pairs(xyz: np.ndarray, eps: float, at_once: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of places at most eps apart, each place with itself too; only cells side by side are compared."""
    cell = np.floor(xyz / eps).astype(np.int64)
    cell -= cell.min(axis=0) - 1
    span = cell.max(axis=0) + 2
    key = (cell[:, 0] * span[1] + cell[:, 1]) * span[2] + cell[:, 2]
    order = np.argsort(key, kind="stable")
    steps = np.array([(a * span[1] + b) * span[2] - 1 for a in (-1, 0, 1) for b in (-1, 0, 1)])  # three cells in a row each
    low = np.searchsorted(key[order], (key[:, None] + steps).ravel())
    count = np.searchsorted(key[order], (key[:, None] + steps + 2).ravel(), side="right") - low
    ends, out, begin = np.cumsum(count), [], 0
    while begin < len(count):
        to = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + at_once, side="right")))
        n = count[begin:to]
        i = np.repeat(np.arange(begin, to) // len(steps), n)
        j = order[np.repeat(low[begin:to] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
        near = ((xyz[i] - xyz[j]) ** 2).sum(axis=1) <= eps * eps
        out.append((i[near], j[near]))
        begin = to
    return np.concatenate([i for i, _ in out]), np.concatenate([j for _, j in out])


def dense(xyz: np.ndarray, eps: float, least: int) -> np.ndarray:
    """Cluster numbers by density, in order of their first core, -1 for noise; a border place is the first such cluster's."""
    n = len(xyz)
    if not n:
        return np.empty(0, np.int64)
    i, j = close_pairs(xyz, eps)
    core = np.bincount(i, minlength=n) >= least
    label, inner = np.arange(n), core[i] & core[j]
    a, b = i[inner], j[inner]
    while True:  # the least core of each cluster, by spreading and shortening
        new = label.copy()
        np.minimum.at(new, a, label[b])
        new = new[new]
        if (new == label).all():
            break
        label = new
    first = np.full(n, n)
    np.minimum.at(first, i[core[j]], label[j[core[j]]])
    first[core] = label[core]
    leads = np.unique(label[core])
    return np.where(first < n, np.searchsorted(leads, first), -1)


def main_cluster(points: DataFrame, by: str, eps: float, least: int, most: int = 4096) -> DataFrame:
    """The points of each group's largest density cluster, from at most ``most`` evenly spaced ones, as lifting takes."""

    def keep(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("pid")
        c = dense(g[["x", "y", "z"]].to_numpy(float), eps, least)
        if not (c >= 0).any():
            return g
        return g[c == np.bincount(c[c >= 0]).argmax()]

    return evenly(points, [by], ["pid"], most).groupBy(by).applyInPandas(keep, points.schema)


def labelled(points: DataFrame, by: str, eps: str, least: int) -> DataFrame:
    """points and ``cluster``: each group's density clusters at the radius in column ``eps``, -1 for noise. For groups that an
    even sample bounds."""

    def work(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("pid")
        return g.assign(cluster=dense(g[["x", "y", "z"]].to_numpy(float), float(g[eps].iloc[0]), least).astype("int64"))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema.fields)
    return points.groupBy(by).applyInPandas(work, f"{kinds}, cluster long")


def in_best_cluster(points: DataFrame, by: str, focal: float, center: tuple[float, float], pixels: float = 12.0, low: float = 0.008, high: float = 0.06, least: int = 8, keep: int = 4, most: int = 4096) -> DataFrame:
    """The points of each group's best cluster: that in the parent's depth band, else nearest the center in the image, then
    flattest, then largest. The radius is some pixels at the group's median depth. A group of fewer than ``least`` points
    stays whole; one without a cluster of ``keep`` points goes.

    points: by, pid, x, y, z in the camera, u, v in the image, parent (depth; null without one), band."""
    sample = saved(evenly(points, [by], ["pid"], most))
    depth = sample.groupBy(by).agg(F.median("z").alias("_mid"), F.count("*").alias("_n"))
    radius = F.least(F.lit(high), F.greatest(F.lit(low), pixels * F.col("_mid") / max(focal, 1e-6)))
    own = saved(labelled(sample.join(depth.withColumn("_eps", radius), by), by, "_eps", least))
    few = own.where(F.col("_n") < max(2, least))
    found = own.where(F.col("_n") >= max(2, least)).where("cluster >= 0")
    middle = found.groupBy(by, "cluster").agg(F.count("*").alias("size"), F.median("z").alias("depth"), F.median("u").alias("cu"), F.median("v").alias("cv"), F.first("parent").alias("of"), F.first("band").alias("reach"))
    middle = middle.where(F.col("size") >= keep)
    spread = found.join(middle.select(by, "cluster", "depth"), [by, "cluster"]).groupBy(by, "cluster").agg(F.median(F.abs(F.col("z") - F.col("depth"))).alias("mad"))
    fits = F.coalesce(F.abs(F.col("depth") - F.col("of")) <= F.col("reach"), F.lit(False))
    order = Window.partitionBy(by).orderBy(fits.desc(), F.hypot(F.col("cu") - center[0], F.col("cv") - center[1]), "mad", F.desc("size"), "cluster")
    best = middle.join(spread, [by, "cluster"]).withColumn("_rank", F.row_number().over(order)).where("_rank = 1").select(by, "cluster")
    return few.unionByName(found.join(best, [by, "cluster"], "left_semi")).select(*points.columns)


def in_main_cluster(points: DataFrame, by: str, eps: float, least: int, ratio: float, voxel: float = 0.0, most: int = 4096) -> DataFrame:
    """The points of each group within one and a half radii of its largest cluster, which is found on voxels' means; without
    voxels, or where each point has its own, the cluster's points. A group stays whole if it or its voxels are fewer than
    ``least``, or what would stay is less than ``ratio`` of the voxels or of the points."""
    whole = saved(evenly(points, [by], ["pid"], most))
    place = [F.floor(F.col(c) / F.lit(voxel)).alias(f"_v{c}") for c in "xyz"] if voxel > 0 else [F.col("pid").alias("_vx")]
    means = whole.groupBy(by, *place).agg(F.min("pid").alias("_pid"), *[F.avg(c).alias(c) for c in "xyz"])
    order = Window.partitionBy(by).orderBy(*(["_vx", "_vy", "_vz"] if voxel > 0 else ["_pid"]))
    means = means.withColumn("pid", F.row_number().over(order)).withColumn("_eps", F.lit(eps))
    sample = saved(labelled(means.select(by, "pid", "_pid", "x", "y", "z", "_eps"), by, "_eps", least))
    sizes = sample.groupBy(by, "cluster").agg(F.count("*").alias("size"))
    main = sizes.where("cluster >= 0").groupBy(by).agg(F.min(F.struct((-F.col("size")).alias("size"), "cluster")).alias("m")).select(by, "m.cluster", (-F.col("m.size")).alias("size"))
    counts = whole.groupBy(by).agg(F.count("*").alias("n")).join(sizes.groupBy(by).agg(F.sum("size").alias("k")), by)
    chosen = saved(main.join(counts, by).where((F.col("k") >= max(2, least)) & (F.col("size") >= ratio * F.col("k"))).select(by, "cluster", F.col("k").alias("_k"), F.col("n").alias("_n")))
    core = sample.join(chosen, [by, "cluster"]).select(by, "_pid", *[F.col(c).alias(f"_{c}") for c in "xyz"], "_k", "_n")
    single = core.where("_k = _n").select(by, F.col("_pid").alias("pid"))
    near = within(whole.join(chosen.where("_k < _n").select(by), by, "left_semi"), core.where("_k < _n"), ["x", "y", "z"], ["_x", "_y", "_z"], 1.5 * eps, [by]).select(by, "pid")
    held = saved(single.unionByName(near).distinct())
    enough = held.groupBy(by).agg(F.count("*").alias("_h")).join(counts, by).where((F.col("k") == F.col("n")) | ((F.col("_h") >= ratio * F.col("n")) & (F.col("_h") >= max(2, least)))).select(by)
    stays = whole.join(enough, by, "left_anti").unionByName(whole.join(enough, by, "left_semi").join(held, [by, "pid"], "left_semi"))
    return stays.select(*points.columns)


FEW = 1000


def consolidated(boxes: DataFrame, sightings: DataFrame, iou: float = 0.30) -> DataFrame:
    """source, target: tracks merged while two of one role and label, never seen together, have boxes of enough padded
    overlap. Each round merges pairs that are best for both; the merged box, sightings and ids make the next round.

    boxes: node_id, role, label, bx1..bz2; sightings: frame, node_id. Both stay as they are: what merges makes of them is kept
    beside them, ``members`` (source, target) of all merged tracks, and their boxes: ``new`` of the last round's, ``rest`` of
    those before. A round meets only pairs with a new one.
    """
    spark = boxes.sparkSession
    rows = boxes.select("node_id", "role", L.track_label(F.col("label")).alias("key"), *[F.col(f"b{c}").alias(c) for c in BOX])
    on, ends = ["role", "key"], ("a_node_id", "b_node_id")
    sized = lambda d: sized_boxes(d, "", "b_", iou, 0.005, on)
    # a small table is read by few tasks, and each of its boxes stands in many cells
    base = stored(sized(rows.repartition("node_id")), "boxes")
    seen = stored(sightings.select("frame", "node_id").distinct(), "sightings")
    members = rest = new = links = None
    count = 0

    def side(d: DataFrame, p: str) -> DataFrame:
        d = d.select(*on, "_at", "_k", "_cx", "_cy", "_cz", "node_id", *[f"b_{c}" for c in (*BOX, "v")])
        return d.withColumnsRenamed({"node_id": f"{p}_node_id", **{f"b_{c}": f"{p}_{c}" for c in (*BOX, "v")}})

    while True:
        if new is None:
            met = saved(alike_sized(side(base, "a"), side(base, "b"), "a_", "b_", iou, on, ends))
        else:
            tables = [(base, 0), (new, 2), *([(rest, 1)] if rest is not None else [])]
            partners = functools.reduce(DataFrame.unionByName, [side(d, "b").withColumn("kind", F.lit(k)) for d, k in tables])
            met = saved(alike_sized(side(new, "a"), partners, "a_", "b_", iou, on, few=count <= FEW).where("kind < 2 or a_node_id < b_node_id"))
            changed = members.select(F.col("source").alias("b_node_id")).union(members.select("target")).distinct()
            met = met.where("kind > 0").unionByName(met.where("kind = 0").join(changed, "b_node_id", "left_anti"))
        # the exact share is computed after the join, whose condition stays small
        shared = F.round(G.iou3d([F.col(f"a_{c}") for c in BOX], [F.col(f"b_{c}") for c in BOX]), 9)
        j = saved(met.select(F.least(*ends).alias("a_node_id"), F.greatest(*ends).alias("b_node_id"), shared.alias("iou")).where(F.col("iou") >= iou))
        # only tracks that overlap some other are looked up in the frames, and only pairs that overlap, not all that a frame shows
        ids = j.select(F.col("a_node_id").alias("node_id")).union(j.select("b_node_id")).distinct()
        own = ids.withColumn("track", F.col("node_id"))
        if members is not None:
            own = own.unionByName(members.join(ids, F.col("target") == F.col("node_id"), "left_semi").select(F.col("source").alias("node_id"), F.col("target").alias("track")))
        frames = saved(with_groups(seen, saved(own), ["node_id"]).select("track", "frame").distinct())
        of = lambda p: frames.select("frame", F.col("track").alias(f"{p}_node_id")).hint("merge")
        both = j.drop("iou").join(of("a"), "a_node_id").join(of("b"), ["frame", "b_node_id"], "left_semi").select(*ends).distinct()
        apart = j.join(both, list(ends), "left_anti")
        links = saved(apart if links is None else links.unionByName(apart))
        best_of = lambda own: links.select(F.col(own).alias("n"), F.struct((-F.col("iou")).alias("i"), *ends).alias("p"))
        best = best_of("a_node_id").unionByName(best_of("b_node_id")).groupBy("n").agg(F.min("p").alias("p"))
        mutual = saved(best.groupBy("p.a_node_id", "p.b_node_id").agg(F.count("*").alias("k")).where("k = 2").select(F.col("a_node_id").alias("target"), F.col("b_node_id").alias("source")))
        count = mutual.count()
        if not count:
            break
        touched = saved(mutual.select("target", F.col("target").alias("node_id")).unionByName(mutual.select("target", F.col("source").alias("node_id"))))
        gone = touched.select("node_id")
        if members is None:
            parts = with_groups(base, touched, ["node_id"])
            members = mutual.select("source", "target")
        else:
            standing = new if rest is None else rest.unionByName(new)
            kept = saved(touched.join(changed.withColumnRenamed("b_node_id", "node_id"), "node_id", "left_anti"))
            parts = with_groups(base, kept, ["node_id"]).unionByName(standing.join(touched, "node_id").select(*base.columns, "target"))
            moved = members.withColumnRenamed("target", "was").join(mutual.withColumnRenamed("source", "was"), "was", "left").select("source", F.coalesce("target", "was").alias("target"))
            members = saved(moved.unionByName(mutual.select("source", "target")))
            rest = saved(standing.join(gone, "node_id", "left_anti"))
        new = saved(sized(parts.groupBy(F.col("target").alias("node_id"), *on).agg(*[(F.min if c[1] == "1" else F.max)(c).alias(c) for c in BOX])))
        for end in ends:
            links = links.join(gone.withColumnRenamed("node_id", end), end, "left_anti")
    if members is None:
        return spark.createDataFrame([], "source string, target string")
    return members.select("source", "target")


def carriers(candidates: DataFrame, boxes: DataFrame, reach: float = 0.08, least: float = 0.80, margin: float = 0.05) -> DataFrame:
    """unit, carrier, score, margin, status: the best carrier of each unit among those with a prior and within reach."""
    a = candidates.where("edge_type = 'C-U'").groupBy(F.col("parent_node_id").alias("carrier"), F.col("child_node_id").alias("unit")).agg(F.count_if("selected").alias("strong"), (F.max("coverage") * 3).alias("own"), F.collect_set("semantic_source").alias("sources"))
    side = lambda p, k: boxes.select(F.col("node_id").alias(k), *[F.col(f"b{c}").alias(f"{p}{c}") for c in BOX])
    j = a.join(side("c_", "carrier"), "carrier").join(side("u_", "unit"), "unit").withColumns({"gap": box_gap("c_", "u_"), "prior": S.prior_of(F.col("sources"))})
    j = j.where(F.col("prior").isNotNull() & (F.col("gap") <= reach))
    s = j.select("unit", "carrier", F.round("gap", 6).alias("gap"), F.round(S.hierarchy(F.col("prior"), F.col("gap"), F.col("strong"), F.col("own")), 6).alias("score"))
    best = top_with_margin(s, ["unit"], "score", ["gap", "carrier"]).withColumn("margin", F.round("margin", 6))
    weak = (F.col("score") <= least) | F.coalesce(F.col("margin") < margin, F.lit(False))
    return best.select("unit", "carrier", "score", "margin", F.when(weak, "provisional").otherwise("confirmed").alias("status"))


def carrier_gates(cu: DataFrame, objects: DataFrame, ou: DataFrame, labels: DataFrame, atlas: DataFrame, boxes: DataFrame, reach: float = 0.08) -> DataFrame:
    """carrier, unit, reason: the first gate that keeps a carrier from a unit, empty where none does.

    cu, ou: parent_node_id, child_node_id, strong (2D sightings) of C-U and O-U pairs; objects: child_node_id, parent_node_id,
    status of object edges; labels: node_id, label; atlas: edge_type, parent_label, child_label, object_context, owner_kind.
    Priors meet pairs by word suffixes of both labels.
    """
    from ..operators.joins import by_suffix

    def with_priors(pairs: DataFrame, kind: str) -> DataFrame:
        named = pairs.join(labels.select(F.col("node_id").alias("parent_node_id"), F.col("label").alias("plabel")), "parent_node_id").join(labels.select(F.col("node_id").alias("child_node_id"), F.col("label").alias("clabel")), "child_node_id")
        a = atlas.where(F.col("edge_type") == kind).drop("edge_type")
        hit = by_suffix(named.select("parent_node_id", "child_node_id", "plabel", "clabel"), "clabel", a, "child_label").where(L.compatible(F.col("plabel"), F.col("parent_label")))
        sets = hit.groupBy("parent_node_id", "child_node_id").agg(F.collect_set("object_context").alias("contexts"), F.collect_set("owner_kind").alias("kinds"))
        return named.join(sets, ["parent_node_id", "child_node_id"], "left")

    of = lambda p, k: objects.select(F.col("child_node_id").alias(k), F.col("parent_node_id").alias(f"{p}_object"), F.col("status").alias(f"{p}_status"))
    direct = with_priors(ou, "O-U").where("strong > 0 and array_contains(kinds, 'direct')").where(F.exists("contexts", lambda c: L.compatible(F.col("plabel"), c))).select(F.col("parent_node_id").alias("u_object"), F.col("child_node_id").alias("unit"), F.lit(True).alias("direct"))
    j = with_priors(cu, "C-U").select(F.col("parent_node_id").alias("carrier"), F.col("child_node_id").alias("unit"), "strong", "contexts").join(of("c", "carrier"), "carrier", "left").join(of("u", "unit"), "unit", "left")
    j = j.join(direct, ["u_object", "unit"], "left").join(labels.select(F.col("node_id").alias("c_object"), F.col("label").alias("owner")), "c_object", "left")
    side = lambda p, k: boxes.select(F.col("node_id").alias(k), *[F.col(f"b{c}").alias(f"{p}{c}") for c in BOX])
    j = j.join(side("p_", "carrier"), "carrier").join(side("q_", "unit"), "unit")
    firm = F.coalesce(F.col("u_status") != "provisional", F.lit(False))
    other = F.col("u_object").isNotNull() & ~F.col("u_object").eqNullSafe(F.col("c_object")) & (F.col("strong") <= 0)
    match = F.exists("contexts", lambda c: L.compatible(F.col("owner"), c) | L.compatible(c, F.col("owner")))
    reason = S.first_of(
        (firm & F.col("direct"), "direct_object_context_preferred"),
        (other & F.col("c_object").isNull(), "unobserved_carrier_cannot_replace_measured_object"),
        (other & firm, "cross_object_candidate"),
        (F.col("owner").isNotNull() & (F.size("contexts") > 0) & ~match & (F.col("strong") <= 0), "semantic_object_context_mismatch"),
        (F.col("contexts").isNull(), "no_semantic_cu_support"),
        (box_gap("p_", "q_") > reach, "aabb_gate_above_threshold"),
    )
    return j.select("carrier", "unit", reason.alias("reason"))


def final_hierarchy(edges: DataFrame) -> DataFrame:
    """Chosen edges (edge_type, parent_node_id, child_node_id, relation_text, provisional) as the final graph's: whether they
    are complete, and for a unit's carrier the object above it and how sure that is. A child with two parents is an error."""
    many = edges.groupBy("child_node_id").agg(F.count("*").alias("n")).where("n > 1").orderBy("child_node_id").limit(20).collect()
    if many:
        raise ValueError("immediate parents must be resolved before: " + ", ".join(r["child_node_id"] for r in many))
    above = edges.where("edge_type = 'O-C'").select(F.col("child_node_id").alias("parent_node_id"), F.col("parent_node_id").alias("owner"), F.col("provisional").alias("unsure"))
    cu = F.col("edge_type") == "C-U"
    j = edges.join(above, "parent_node_id", "left")
    status = F.when(cu, F.when(F.col("owner").isNull(), "unknown").when(F.col("unsure"), "provisional").otherwise("confirmed"))
    return j.select("edge_type", "parent_node_id", "child_node_id", F.when(F.trim("relation_text") != "", "complete").otherwise("pending").alias("functional_status"), F.when(cu, F.col("owner")).alias("object_parent_id"), status.alias("object_parent_status"))


def hierarchy_audit(final: DataFrame) -> DataFrame:
    """One row: edges, units whose carrier has an object, and units whose carrier has none."""
    cu = F.col("edge_type") == "C-U"
    return final.agg(F.count("*").alias("edges"), F.count_if(cu & F.col("object_parent_id").isNotNull()).alias("anchored"), F.count_if(cu & F.col("object_parent_id").isNull()).alias("unanchored"))
