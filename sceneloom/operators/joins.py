"""Joins between detections, nodes, poses, priors and boxes.

Similarity and range joins meet by equality first (role, label, grid cell, word suffix), so that Spark plans a hash or
sort-merge join and the exact condition is a filter; nothing is a cross join of two growing tables.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as G
from ..functions import labels as L
from .fixpoint import saved


def looked_up(left: DataFrame, right: DataFrame, first: str, second: list[str], value: str) -> DataFrame:
    """left with ``value`` of right: by a content key, else by a composite key."""
    by_key = right.where(F.col(first).isNotNull()).select(F.col(first).alias("_k"), F.col(value).alias("_v1")).dropDuplicates(["_k"])
    w = Window.partitionBy(*second).orderBy(F.col(first).asc_nulls_last())
    by_ends = right.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select(*[F.col(c).alias(f"_{c}") for c in second], F.col(value).alias("_v2"))
    j = left.join(by_key, F.col(first) == F.col("_k"), "left").join(by_ends, [F.col(c) == F.col(f"_{c}") for c in second], "left")
    return j.withColumn(value, F.coalesce("_v1", "_v2")).drop("_k", "_v1", "_v2", *[f"_{c}" for c in second])


def cells(df: DataFrame, xyz: list[str], size: float, name: str = "cell", reach: int = 0) -> DataFrame:
    """Adds the grid cell of a point; with ``reach``, a row for each cell within so many steps."""
    base = [F.floor(F.col(c) / size).cast("long") for c in xyz]
    if not reach:
        return df.withColumn(name, F.struct(*[b.alias(f"c{i}") for i, b in enumerate(base)]))
    steps = F.array(*[F.struct(*[F.lit(s).cast("long").alias(f"d{i}") for i, s in enumerate(t)]) for t in _steps(len(xyz), reach)])
    near = df.withColumn("_s", F.explode(steps))
    return near.withColumn(name, F.struct(*[(b + F.col(f"_s.d{i}")).alias(f"c{i}") for i, b in enumerate(base)])).drop("_s")


def _steps(n: int, reach: int) -> list[tuple[int, ...]]:
    out: list[tuple[int, ...]] = [()]
    for _ in range(n):
        out = [(*t, s) for t in out for s in range(-reach, reach + 1)]
    return out


def within(a: DataFrame, b: DataFrame, xyz_a: list[str], xyz_b: list[str], radius: float, on: list[str] = ()) -> DataFrame:
    """Pairs of points at most ``radius`` apart with equal ``on`` columns, by grid cells of that size; adds ``distance``. The
    side that stands in all cells about it is larger than Spark estimates and must not be broadcast."""
    left = cells(a, xyz_a, radius, "_cell")
    right = cells(b, xyz_b, radius, "_cell", 1).hint("merge")
    j = left.join(right, ["_cell", *on]).drop("_cell")
    return j.withColumn("distance", G.norm(*[F.col(x) - F.col(y) for x, y in zip(xyz_a, xyz_b, strict=True)])).where(F.col("distance") <= radius)


RANGE_ROWS = 500_000


def as_of(points: DataFrame, track: DataFrame, time: str, values: list[str], by: list[str] = ()) -> DataFrame:
    """points with the track's latest row at or before, and its first at or after, their time: one sort of the union, no
    range join. Adds before_<v>, after_<v>, before_<time>, after_<time>.

    Without ``by`` the union is sorted into ranges of time, each a task's; what a range has of the track last and first is
    carried over to the ranges beside it."""
    cols = [time, *values]
    keyed = track.select(*by, time, F.struct(*cols).alias("_row"), F.lit(0).alias("_kind"))
    row, point = keyed.schema["_row"].dataType, points.select(F.struct(*points.columns)).schema[0].dataType
    both = points.select(*by, time, F.lit(None).cast(row).alias("_row"), F.lit(1).alias("_kind"), F.struct(*points.columns).alias("_p")).unionByName(keyed.withColumn("_p", F.lit(None).cast(point)))
    keys = list(by)
    if not keys:
        both = saved(both)
        parts = max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), both.count() // RANGE_ROWS)
        both, keys = saved(both.repartitionByRange(parts, time).withColumn("_part", F.spark_partition_id())), ["_part"]
    back = Window.partitionBy(*keys).orderBy(F.col(time), F.col("_kind")).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys).orderBy(F.col(time).desc(), F.col("_kind")).rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumns({"_b": F.last("_row", True).over(back), "_a": F.last("_row", True).over(ahead)}).where("_kind = 1")
    if not by:
        ends = both.groupBy("_part").agg(F.max("_row").alias("_last"), F.min("_row").alias("_first"))  # a row a range
        order = Window.orderBy("_part")
        ends = ends.select(F.col("_part").alias("_at"), F.last("_last", True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_from"), F.first("_first", True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("_to"))
        seen = seen.join(F.broadcast(ends), F.col("_part") == F.col("_at")).withColumns({"_b": F.coalesce("_b", "_from"), "_a": F.coalesce("_a", "_to")})
    return seen.select("_p.*", *[F.col(f"_b.{c}").alias(f"before_{c}") for c in cols], *[F.col(f"_a.{c}").alias(f"after_{c}") for c in cols])


def nearest(found: DataFrame, time: str, tolerance: float) -> DataFrame:
    """What ``as_of`` gives, with the time of the nearest row, the earlier of two as near: none outside the track's range or
    beyond the tolerance."""
    t, a, b = F.col(time), F.col(f"before_{time}"), F.col(f"after_{time}")
    near = F.when(t - a <= b - t, a).otherwise(b)
    return found.where(a.isNotNull() & b.isNotNull()).withColumn(f"nearest_{time}", near).where(F.abs(F.col(f"nearest_{time}") - t) <= tolerance)


def interpolated(found: DataFrame, time: str, values: list[str], tolerance: float) -> DataFrame:
    """What ``as_of`` gives: values between the two neighbours where both lie within the tolerance; exact ones as they are."""
    t, a, b = F.col(time), F.col(f"before_{time}"), F.col(f"after_{time}")
    share = F.when(b > a, (t - a) / F.when(b > a, b - a)).otherwise(0.0)
    ok = a.isNotNull() & b.isNotNull() & (((t == a) | (t == b)) | ((t - a <= tolerance) & (b - t <= tolerance)))
    return found.where(ok).withColumns({v: F.when(t == b, F.col(f"after_{v}")).otherwise(G.between(F.col(f"before_{v}"), F.col(f"after_{v}"), share)) for v in values})


def by_suffix(instances: DataFrame, label: str, priors: DataFrame, prior: str) -> DataFrame:
    """Instances joined to the priors whose label ends theirs: each word suffix is a key."""
    keyed = instances.withColumn("_suffix", F.explode(L.word_suffixes(F.col(label))))
    return keyed.join(priors.withColumn("_suffix", L.prior_label(F.col(prior))).where("_suffix <> ''"), "_suffix").drop("_suffix")


def expanded(children: DataFrame, parents: DataFrame, priors: DataFrame, observed: DataFrame, top: int = 2) -> DataFrame:
    """For children without an observed parent of an edge type, the best ``top`` parents of the frame that a prior allows.

    children, parents: frame_idx, det_id, role, label, box; priors: edge_type, parent_label, child_label; observed:
    frame_idx, edge_type, child_det_id.
    """
    c = by_suffix(children.select("frame_idx", F.col("det_id").alias("child_det_id"), F.col("role").alias("child_role"), F.col("label").alias("clabel"), *[F.col(x).alias(f"c_{x}") for x in ("x1", "y1", "x2", "y2")]), "clabel", priors, "child_label")
    c = c.where(F.col("child_role") == F.substring_index("edge_type", "-", -1)).join(observed.select("frame_idx", "edge_type", "child_det_id").distinct(), ["frame_idx", "edge_type", "child_det_id"], "left_anti")
    p = parents.select("frame_idx", F.col("det_id").alias("parent_det_id"), F.col("role").alias("parent_role"), F.col("label").alias("plabel"), *[F.col(x).alias(f"p_{x}") for x in ("x1", "y1", "x2", "y2")])
    j = c.join(p, "frame_idx").where((F.col("parent_role") == F.substring_index("edge_type", "-", 1)) & L.compatible(F.col("plabel"), F.col("parent_label")))
    j = j.withColumn("score", F.round(G.ownership(G.box("p_"), G.box("c_"))["score"], 6)).select("frame_idx", "edge_type", "child_det_id", "parent_det_id", "score").distinct()
    w = Window.partitionBy("frame_idx", "edge_type", "child_det_id").orderBy(F.desc("score"), "parent_det_id")
    return j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def closed_triangles(edges: DataFrame) -> DataFrame:
    """edges (child, parent): rows (unit, carrier, object) with unit->carrier, carrier->object and unit->object."""
    a = edges.select(F.col("child").alias("unit"), F.col("parent").alias("carrier"))
    b = edges.select(F.col("child").alias("carrier"), F.col("parent").alias("object"))
    return a.join(b, "carrier").join(edges.select(F.col("child").alias("unit"), F.col("parent").alias("object")), ["unit", "object"], "left_semi").distinct()


def owner_closure(cu: DataFrame, oc: DataFrame, ou: DataFrame) -> DataFrame:
    """Units that own a carrier's object through it, where no unit->object edge is there: (unit, object, carrier)."""
    j = cu.select(F.col("child").alias("unit"), F.col("parent").alias("carrier")).join(oc.select(F.col("child").alias("carrier"), F.col("parent").alias("object")), "carrier")
    return j.join(ou.select(F.col("child").alias("unit"), F.col("parent").alias("object")), ["unit", "object"], "left_anti")


def co_observed(rows: DataFrame, frame: str, item: str) -> DataFrame:
    """Distinct pairs a < b of items of one frame."""
    r = rows.select(frame, item).distinct()
    return r.select(frame, F.col(item).alias("a")).join(r.select(frame, F.col(item).alias("b")), frame).where("a < b").select("a", "b").distinct()


BOX3D = ("x1", "y1", "z1", "x2", "y2", "z2")
CELL = 0.5  # metres


def box_columns(prefix: str) -> list[Column]:
    return [F.col(f"{prefix}{c}") for c in BOX3D]


def near_boxes(a: DataFrame, b: DataFrame, of_a: str, of_b: str, gap: float, on: list[str] = ()) -> DataFrame:
    """Pairs of 3D boxes (columns x1..z2 under a prefix) with equal ``on`` that may be at most ``gap`` apart: each box stands
    in all cells that it reaches, and a pair is met once, in the first cell that both do. Both sides are then larger than
    Spark estimates, and are not broadcast."""
    low = lambda p, c, room: F.floor((F.col(f"{p}{c}1") - room) / CELL).cast("long")
    high = lambda p, c, room: F.floor((F.col(f"{p}{c}2") + room) / CELL).cast("long")

    def placed(df: DataFrame, p: str, room: float) -> DataFrame:
        for c in "xyz":
            df = df.withColumn(f"_c{c}", F.explode(F.sequence(low(p, c, room), high(p, c, room))))
        return df

    j = placed(a, of_a, gap).hint("merge").join(placed(b, of_b, 0.0), [*on, "_cx", "_cy", "_cz"])
    once = [F.col(f"_c{c}") == F.greatest(low(of_a, c, gap), low(of_b, c, 0.0)) for c in "xyz"]
    return j.where(once[0] & once[1] & once[2]).drop("_cx", "_cy", "_cz")


def sized_boxes(df: DataFrame, of: str, p: str, share: float, pad: float | None, on: list[str]) -> DataFrame:
    """For ``alike_boxes``: the grown box under a prefix, its volume, its class of size and the cell of its center, in which
    it stands as a partner."""
    step = max(2.0, 1 / (share - 1e-6))
    for c in "xyz":
        low, high = F.col(f"{of}{c}1"), F.col(f"{of}{c}2")
        grow = F.lit(0.0) if pad is None else F.greatest(F.lit(pad), (high - low) * 0.01)
        df = df.withColumns({f"{p}{c}1": low - grow, f"{p}{c}2": high + grow})
    extent = [F.col(f"{p}{c}2") - F.col(f"{p}{c}1") for c in "xyz"]
    df = df.withColumns({"_k": F.floor(F.log(F.greatest(*extent)) / math.log(step)).cast("int"), f"{p}v": extent[0] * extent[1] * extent[2]})
    size = F.pow(F.lit(step), F.col("_k") + 1)
    df = df.withColumns({f"_c{c}": F.floor((F.col(f"{p}{c}1") + F.col(f"{p}{c}2")) / 2 / size).cast("long") for c in "xyz"})
    return df.withColumn("_at", F.xxhash64(*on, "_k", "_cx", "_cy", "_cz"))


def alike_sized(a: DataFrame, b: DataFrame, p: str, q: str, share: float, on: list[str], once: tuple[str, str] | None = None, few: bool = False) -> DataFrame:
    """Pairs of ``sized_boxes`` of one share under two prefixes with equal ``on`` that share at least ``share`` of their union,
    but for rounding; each pair is met once. With ``once`` (the ids of a and b) both are one table, and a pair is met in one of
    its two orders. ``few``: a has at most some thousand boxes, whose cells, at most 125 each in a class, may be broadcast.

    Such boxes have extents within 1 / share of each other on every axis, and centers that are near for their extents: a box
    of b stands in its own cell, and one of a in the cells near it of three classes (two with ``once``). Cells are sorted by
    one number. A pair in a cell is held against the share by a few products, so that what a pair takes stays small."""
    least = share - 1e-6
    step = max(2.0, 1 / least)
    near = 0.5 - least / (1 + least)
    keys = [*on, "_k", "_cx", "_cy", "_cz"]
    size = F.pow(F.lit(step), F.col("_k") + 1)
    some = a.drop("_at", "_cx", "_cy", "_cz").withColumn("_own", F.col("_k")).withColumn("_k", F.explode(F.array(*[F.col("_k") + d for d in ((0, 1) if once else (-1, 0, 1))])))
    for c in "xyz":
        low, high = F.col(f"{p}{c}1"), F.col(f"{p}{c}2")
        reach = (high - low + size) * near
        cell = lambda x: F.floor(x / size).cast("long")
        some = some.withColumn(f"_c{c}", F.explode(F.sequence(cell((low + high) / 2 - reach), cell((low + high) / 2 + reach))))
    j = some.withColumn("_at", F.xxhash64(*keys)).hint("broadcast" if few else "merge").join(b, ["_at", *keys])
    both = [F.least(f"{p}{c}2", f"{q}{c}2") - F.greatest(f"{p}{c}1", f"{q}{c}1") for c in "xyz"]
    enough = (both[0] > 0) & (both[1] > 0) & (both[2] > 0) & (both[0] * both[1] * both[2] >= (F.col(f"{p}v") + F.col(f"{q}v")) * (least / (1 + least)))
    if once:
        enough = ((F.col("_own") < F.col("_k")) | (F.col(once[0]) < F.col(once[1]))) & enough
    return j.where(enough).drop("_at", "_own", "_k", "_cx", "_cy", "_cz")


def alike_boxes(a: DataFrame, b: DataFrame, of_a: str, of_b: str, share: float, pad: float | None, on: list[str] = ()) -> DataFrame:
    """Pairs of 3D boxes (columns x1..z2 under a prefix) with equal ``on`` that, grown by the greater of ``pad`` and a hundredth
    of their extent on every side (None: as they are), share at least ``share`` (above 0) of their union, but for rounding;
    each pair is met once."""
    sides = [sized_boxes(d, of, p, share, pad, on) for d, of, p in ((a, of_a, "_a"), (b, of_b, "_b"))]
    return alike_sized(*sides, "_a", "_b", share, on).drop("_av", "_bv", *[f"_{q}{c}{i}" for q in "ab" for c in "xyz" for i in (1, 2)])


def nearest_points(left: DataFrame, right: DataFrame, on: list[str], of_left: str, of_right: str, key: list[str], cell: float, grow: int = 2) -> DataFrame:
    """on, key and ``distance`` to the nearest of right's points with equal ``on``, for each of left's points, without a radius.

    Columns x, y, z stand under a prefix. A round looks into a point's cell and those around it, so that all points within a
    cell's size are met; who has one that near is done, and the others go on with cells ``grow`` times as large. Only the
    points still to do are joined, and a point whose partner group is empty has no row."""
    axes = lambda p: [F.col(f"{p}{c}") for c in "xyz"]
    at = lambda p, size: [F.floor(c / F.lit(size)).cast("long") for c in axes(p)]
    right = saved(right.select(*on, *(f"{of_right}{c}" for c in "xyz")))
    todo = saved(left.select(*on, *key, *(f"{of_left}{c}" for c in "xyz")).join(right.select(*on).distinct(), on, "left_semi"))
    square = sum((a - b) * (a - b) for a, b in zip(axes(of_left), axes(of_right)))
    done, size, cells = None, cell, ["_cx", "_cy", "_cz"]
    while True:
        around = todo
        for name, c in zip(cells, at(of_left, size)):
            around = around.withColumn(name, F.explode(F.sequence(c - 1, c + 1)))
        placed = right.withColumns(dict(zip(cells, at(of_right, size))))
        best = around.hint("merge").join(placed, [*on, *cells]).groupBy(*on, *key).agg(F.sqrt(F.min(square)).alias("distance"))
        met = saved(best.where(F.col("distance") <= size))
        done = met if done is None else saved(done.unionByName(met))
        todo = saved(todo.join(met.select(*on, *key), [*on, *key], "left_anti"))
        if not todo.limit(1).count():
            return done
        size *= grow


def projected_boxes(points: DataFrame, by: str, camera: tuple[float, float, float, float], width: int, height: int, least: int = 3, tolerance: float = 0.08, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """by, p_x1..p_y2: the percentile box, within the image, of each node's projected points.

    points: by, x, y, z in the camera, depth (the measured depth at the point's pixel). Points before the camera and within
    an image's size of it count; of these only the visible ones, if there are enough.
    """
    u, v, front = G.projected([F.col(c) for c in "xyz"], *[F.lit(k) for k in camera])
    near = u.between(-width, 2 * width - 1) & v.between(-height, 2 * height - 1)
    seen = F.coalesce((F.col("depth") > 0) & (F.col("z") <= F.col("depth") + tolerance), F.lit(False))
    p = points.where(front).select(by, u.alias("u"), v.alias("v"), seen.alias("seen"), near.alias("near")).where("near")
    w = Window.partitionBy(by)
    p = p.withColumns({"n": F.count("*").over(w), "k": F.count_if("seen").over(w)}).where((F.col("n") >= least) & (F.col("seen") | (F.col("k") < least)))
    side = lambda c, most: F.least(F.lit(most - 1.0), F.greatest(F.lit(0.0), F.col(c)))
    return p.groupBy(by).agg(*[F.percentile(side(c, m), q).alias(f"p_{x}{i}") for i, q in ((1, low), (2, high)) for x, c, m in (("x", "u", width), ("y", "v", height))])


def contradicted(seen: DataFrame, own: DataFrame) -> DataFrame:
    """frame_idx, child_node_id, parents: children whose own parent of a role is none of the frame's parents of that role.
    seen: frame_idx, child_node_id, child_role, parent_role, parent_node_id; own: child_node_id, parent_role, own."""
    j = seen.where("child_role = 'U' or parent_role = 'O'").join(own, ["child_node_id", "parent_role"])
    c = j.groupBy("frame_idx", "child_node_id", "parent_role").agg(F.count("*").alias("parents"), F.bool_and(F.col("parent_node_id") != F.col("own")).alias("against"))
    return c.where("against").groupBy("frame_idx", "child_node_id").agg(F.sum("parents").alias("parents"))


def recovered(seen: DataFrame, linked: DataFrame, known: DataFrame, boxes: DataFrame, reach: float, covered: float, top: int) -> DataFrame:
    """unit, carrier, distance, rank: for units without a link the ``top`` nearest carriers that were seen with them (seen:
    pairs and the share of the unit's mask in the carrier's), are not known as a pair, and lie within reach."""
    k = seen.where(F.col("coverage") > covered).select("parent_node_id", "child_node_id").distinct()
    k = k.join(linked, "child_node_id", "left_anti").join(known, ["parent_node_id", "child_node_id"], "left_anti")
    side = lambda p, name: boxes.select(F.col("node_id").alias(name), *[F.col(f"b{c}").alias(f"{p}{c}") for c in BOX3D])
    j = k.join(side("p_", "parent_node_id"), "parent_node_id").join(side("q_", "child_node_id"), "child_node_id")
    j = j.select(F.col("child_node_id").alias("unit"), F.col("parent_node_id").alias("carrier"), F.round(G.gap3d(box_columns("p_"), box_columns("q_")), 6).alias("distance")).where(F.col("distance") <= reach)
    w = Window.partitionBy("unit").orderBy("distance", "carrier")
    return j.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= top)


def retired(points: DataFrame, most: int = 1024, floor: float = 0.03, ratio: float = 0.35, near: float = 0.01, both: float = 0.45, one: float = 0.80) -> DataFrame:
    """carrier, unit, distance, mutual, one_way: carriers that a unit duplicates, each with its best witness: the greatest lesser
    and greater share of points near the other's, then the nearest centroid.

    points: id, role (C, or U of a witness), pid, x, y, z. Centroids meet by cells of the larger one's gate, points by cells."""
    from .windows import evenly

    c = saved(points.groupBy("id", "role").agg(*[F.avg(k).alias(f"c{k}") for k in "xyz"], G.norm(*[F.max(k) - F.min(k) for k in "xyz"]).alias("extent")))
    reach = F.greatest(F.lit(floor), ratio * F.greatest("extent", "u_extent"))
    # by sizes: a pair meets in cells of the larger one's reach, so that one large thing does not make all cells large
    c = c.withColumn("size", F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.lit(floor), ratio * F.col("extent")) / F.lit(floor)))).cast("int"))
    u = c.where("role = 'U'").select(F.col("id").alias("unit"), F.col("extent").alias("u_extent"), F.col("size").alias("u_size"), *[F.col(f"c{k}").alias(f"u_{k}") for k in "xyz"])
    carriers = c.where("role = 'C'").select(F.col("id").alias("carrier"), "extent", "size", "cx", "cy", "cz")
    pairs = None
    for k in range((c.agg(F.max("size")).first()[0] or 0) + 1):
        for a, b in ((carriers.where(f"size = {k}"), u.where(f"u_size <= {k}")), (carriers.where(f"size < {k}"), u.where(f"u_size = {k}"))):
            met = within(a, b, ["cx", "cy", "cz"], ["u_x", "u_y", "u_z"], floor * 2.0**k * 1.0000001).where(F.col("distance") <= reach).select("carrier", "unit", "distance")
            pairs = met if pairs is None else pairs.unionByName(met)
    pairs = saved(pairs)
    s = saved(evenly(points, ["id"], ["pid"], most).select("id", "pid", "x", "y", "z"))
    side = lambda name, p: s.select(F.col("id").alias(name), F.col("pid").alias(f"{p}pid"), *[F.col(k).alias(f"{p}{k}") for k in "xyz"])
    a = pairs.select("carrier", "unit").join(side("carrier", "a_"), "carrier")
    b = pairs.select("carrier", "unit").join(side("unit", "b_"), "unit")
    square = sum(((F.col(f"a_{k}") - F.col(f"b_{k}")) * (F.col(f"a_{k}") - F.col(f"b_{k}")) for k in "yz"), (F.col("a_x") - F.col("b_x")) * (F.col("a_x") - F.col("b_x")))
    hit = saved(within(a, b, ["a_x", "a_y", "a_z"], ["b_x", "b_y", "b_z"], near * 1.0000001, ["carrier", "unit"]).where(square <= near * near).select("carrier", "unit", "a_pid", "b_pid"))
    n = s.groupBy("id").agg(F.count("*").alias("n"))
    share = lambda name, pid: hit.groupBy("carrier", "unit").agg(F.count_distinct(pid).alias("k")).join(n.withColumnRenamed("id", name), name).select("carrier", "unit", (F.col("k") / F.col("n")).alias(f"{name}_share"))
    o = share("carrier", "a_pid").join(share("unit", "b_pid"), ["carrier", "unit"]).join(pairs, ["carrier", "unit"])
    o = o.select("carrier", "unit", "distance", F.least("carrier_share", "unit_share").alias("mutual"), F.greatest("carrier_share", "unit_share").alias("one_way")).where((F.col("mutual") >= both) & (F.col("one_way") >= one))
    w = Window.partitionBy("carrier").orderBy(*[F.round(x, 6).desc() for x in ("mutual", "one_way")], F.round("distance", 6), "unit")
    return o.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def hint_links(hints: DataFrame, seen: DataFrame, nodes: DataFrame, gap: float = 0.12, dot: float = 0.90, iou: float = 1e-4, frames: int = 1) -> DataFrame:
    """owner, a, b, frames, n_overlaps, normal_dot, gap: carriers with a common owner hint (owner, frame, parent), boxes that
    overlap in enough of these frames, like normals and a small gap.

    hints: owner, frame_idx, parent_det_id, node_id; seen: frame_idx, node_id, x1..y2; nodes: node_id, nx, ny, nz, x1..z2.
    """
    h = hints.select("owner", "frame_idx", "parent_det_id", "node_id").distinct()
    shared = h.withColumnRenamed("node_id", "a").join(h.withColumnRenamed("node_id", "b"), ["owner", "frame_idx", "parent_det_id"]).where("a < b").select("owner", "a", "b", "frame_idx").distinct()
    box = lambda k: seen.select("frame_idx", F.col("node_id").alias(k), *[F.col(c).alias(f"{k}_{c}") for c in ("x1", "y1", "x2", "y2")])
    j = shared.join(box("a"), ["frame_idx", "a"]).join(box("b"), ["frame_idx", "b"])
    k = j.groupBy("owner", "a", "b").agg(F.count("*").alias("frames"), F.count_if(G.iou2d(G.box("a_"), G.box("b_")) > iou).alias("n_overlaps")).where(F.col("n_overlaps") >= frames)
    side = lambda k: nodes.select(F.col("node_id").alias(k), *[F.col(c).alias(f"{k}_{c}") for c in ("nx", "ny", "nz", *BOX3D)])
    m = k.join(side("a"), "a").join(side("b"), "b")
    like = F.abs(F.col("a_nx") * F.col("b_nx") + F.col("a_ny") * F.col("b_ny") + F.col("a_nz") * F.col("b_nz"))
    m = m.withColumns({"normal_dot": like, "gap": G.gap3d(box_columns("a_"), box_columns("b_"))})
    return m.where((F.col("normal_dot") >= dot) & (F.col("gap") <= gap)).select("owner", "a", "b", "frames", "n_overlaps", "normal_dot", "gap")
