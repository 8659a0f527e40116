"""Work that has to stay bounded on large tables: plans that broadcast no side which is many rows a row of its table, rows of
text in many splits, shapes of many masks at once."""

from __future__ import annotations

from pyspark.sql import functions as F


def joins_by(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_runs_of_masks_are_not_broadcast(spark):
    from sceneloom.operators import masks as K

    runs = spark.range(40).select(F.col("id").alias("frame_idx"), F.lit(0).cast("long").alias("det_id"), F.explode(F.sequence(F.lit(0), F.lit(11))).alias("row"), F.lit(3).alias("start"), F.lit(4).alias("length"))
    runs = runs.unionByName(runs.withColumns({"det_id": F.lit(1).cast("long"), "start": F.lit(5)}))
    pairs = spark.range(40).select(F.col("id").alias("frame_idx"), F.lit(0).cast("long").alias("parent_det_id"), F.lit(1).cast("long").alias("child_det_id"))
    c = K.coverage(runs, pairs)
    assert "Broadcast" not in joins_by(c)
    assert {(r["parent_det_id"], r["child_det_id"], r["coverage"]) for r in c.collect()} == {(0, 1, 0.5)}


def test_cells_about_points_are_not_broadcast(spark):
    from sceneloom.operators import joins as J

    p = lambda k: spark.range(30).select(F.col("id").alias(k), *[(F.col("id") * 0.1).alias(f"{k}{c}") for c in "xyz"])
    j = J.within(p("a"), p("b"), ["ax", "ay", "az"], ["bx", "by", "bz"], 0.18)
    assert "Broadcast" not in joins_by(j)
    assert j.count() == 30 + 2 * 29


def test_ply_of_many_splits_and_files(spark, tmp_path):
    from sceneloom.sources import files as S

    p = spark.range(20_000).select("id", (F.col("id") % 1000).cast("double").alias("x"), (F.col("id") * 0.5).alias("y"), F.lit(0.25).alias("z"), *[(F.col("id") % 200).cast("int").alias(c) for c in "rgb"])
    S.write_ply(p.repartition(7), str(tmp_path / "ply"), ["id"])
    whole = "".join(f.read_text() for f in sorted((tmp_path / "ply").glob("part-*.txt")))
    (tmp_path / "one.ply").write_text(whole + "3 0 1 2\n")
    assert [x.split()[1] for x in whole.splitlines()[whole.splitlines().index("end_header") + 1 :]] == [str(i * 0.5) for i in range(20_000)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        for name in ("ply", "one.ply"):
            got = S.ply(spark, str(tmp_path / name)).agg(F.count("*"), F.sum("y"), F.sum("r")).first()
            assert tuple(got) == (20_000, 20_000 * 19_999 / 4, 100 * sum(range(200)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_support_is_one_pass_over_many_masks(spark):
    import numpy as np

    from sceneloom.operators import masks as K

    rng = np.random.default_rng(5)
    shapes = [m for m in (rng.random((9, 11)) < share for share in np.linspace(0.3, 0.95, 60)) if m.any()]
    runs = [K.to_runs(m, 2, 3) for m in shapes]
    column = lambda c: np.concatenate([r[c].to_numpy(np.int64) for r in runs])
    mask, row, start, end = K.filled_runs((np.repeat(np.arange(len(runs)), [len(r) for r in runs]), column("row"), column("start"), column("start") + column("length")))
    for i, m in enumerate(shapes):
        got = np.zeros_like(m)
        for r, s, e in zip(row[mask == i], start[mask == i], end[mask == i]):
            got[r - 2, s - 3 : e - 3] = True
        assert (got == K.filled(m)).all()
    table = spark.createDataFrame([(0, 0, 1, 1, 4)], K.RUN)
    boxes = spark.createDataFrame([(0, 0, 0, 0, 9, 9)], "frame_idx long, det_id long, x1 int, y1 int, x2 int, y2 int")
    plan = joins_by(K.support(table, boxes, 2, 20, 20))
    assert plan.count("MapInPandas") == 1 and "FlatMapGroupsInPandas" not in plan


def test_tasks_grow_with_masks(spark, monkeypatch):
    from sceneloom.operators import masks as K

    runs = spark.range(90).select(F.col("id").alias("frame_idx"), F.lit(0).cast("long").alias("det_id"), F.lit(1).alias("row"), F.lit(2).alias("start"), F.lit(3).alias("length"))
    monkeypatch.setattr(K, "TASK_ROWS", 10)
    parts = K.shaped(runs, "main")
    assert parts.rdd.getNumPartitions() == 10 and parts.count() == 90


def test_boxes_in_cells_are_not_broadcast(spark):
    from sceneloom.operators import joins as J

    b = lambda k: spark.range(20).select(F.col("id").alias(k), *[(F.col("id") * 0.4 + (0.0 if c[1] == "1" else 0.5)).alias(f"{k}{c}") for c in J.BOX3D])
    j = J.near_boxes(b("a"), b("b"), "a", "b", 0.01)
    assert "Broadcast" not in joins_by(j)
    assert j.where("abs(a - b) <= 1").count() == 20 + 2 * 19


def test_alike_boxes_are_met_once_whatever_their_size(spark):
    """Boxes of 0.02 to 3000 metres; near_boxes would place the large ones in billions of cells."""
    import random

    from sceneloom.functions import geometry as G
    from sceneloom.operators import joins as J

    r, rows = random.Random(3), []
    for k in range(240):
        scale = r.choice([0.02, 1.0, 1000.0])
        low, extent = [scale * r.uniform(-1, 1) for _ in "xyz"], [scale * r.uniform(0.2, 3) for _ in "xyz"]
        rows.append((k, *low, *[v + e for v, e in zip(low, extent, strict=True)]))
    box = spark.createDataFrame(rows, ["a", *[f"a{c}" for c in J.BOX3D]])
    other = box.toDF("b", *[f"b{c}" for c in J.BOX3D])
    iou = G.iou3d(J.box_columns("a"), J.box_columns("b"), 0.005)
    met = J.alike_boxes(box, other, "a", "b", 0.3, 0.005)
    pairs = [tuple(x) for x in met.where(iou >= 0.3).select("a", "b").collect()]
    assert len(pairs) == len(set(pairs)) > 300
    assert set(pairs) == {tuple(x) for x in box.crossJoin(other).where(iou >= 0.3).select("a", "b").collect()}
    assert "Broadcast" not in joins_by(met)


def test_points_of_balls_are_made_by_many_tasks(spark):
    from sceneloom.operators import artifacts as A

    nodes = spark.range(50).coalesce(1).select(F.col("id").cast("string").alias("node_id"), *[F.lit(0.5).alias(c) for c in ("cx", "cy", "cz")])
    p = A.shell(nodes)
    plan = joins_by(p)
    assert plan.index("Generate") < plan.index("Exchange hashpartitioning") and p.count() == 50 * 24


def test_tasks_grow_with_pairs_of_detections(spark, sf_dir, monkeypatch):
    from sceneloom import fixtures
    from sceneloom.operators import filters as P

    def kept():
        d, r = (fixtures.scene(spark, sf_dir, name) for name in ("detections", "relations_2d"))
        return r, P.linked_or_inside(d, r).select("frame_idx", "det_id")

    _, before = kept()
    monkeypatch.setattr(fixtures, "TASK_ROWS", 100)
    r, after = kept()
    parts = fixtures.scene(spark, sf_dir, "events").count() // 100 + 1
    plan = joins_by(after)
    assert parts > 4 and plan.count(", REPARTITION_BY_NUM") == 2 and r.rdd.getNumPartitions() == parts
    assert sorted(before.collect()) == sorted(after.collect())


def test_tracker_statistics_are_those_of_numpy():
    import numpy as np

    from sceneloom.plans import tracker as K

    rng = np.random.default_rng(3)
    for n in [*range(1, 60), 500, 4096]:
        p = rng.normal(size=(n, 3)) * 0.02
        if n % 7 == 3:
            p[rng.integers(n), rng.integers(3)] = np.nan
        assert np.array_equal(np.percentile(p, [2, 98], axis=0), np.array(K.bounds(p)), equal_nan=True)
        assert np.array_equal(np.median(p, axis=0), K.middle(K.in_order(p)), equal_nan=True)
        p = np.nan_to_num(p)
        cells, at = np.unique(np.floor(p / 0.005).astype(np.int64), axis=0, return_inverse=True)
        means = np.stack([np.bincount(at.ravel(), p[:, k]) for k in range(3)], axis=1) / np.bincount(at.ravel())[:, None]
        assert np.array_equal(means, K.voxel_means(p, 0.005, 10_000)) and len(K.voxel_means(p, 0.005, 5)) == min(5, len(cells))


def test_refused_observations_bring_no_arrays(spark, sf_dir):
    from sceneloom.plans import queries_state as Q
    from sceneloom.plans import tracker as K

    o = Q._observed(spark, sf_dir)
    o = o.withColumn("points", F.when(F.col("det_id") % 5 == 0, F.lit(None)).when(F.col("det_id") % 5 == 1, F.array().cast(o.schema["points"].dataType)).otherwise(F.col("points")))
    for identity in (False, True):
        u = K.used(o, K.Settings(identity=identity))
        assert {f.name: f.dataType for f in u.schema} == {f.name: f.dataType for f in o.schema}
        read = ["reliable", "provisional", *(["low_quality"] if identity else [])]
        assert u.where(F.col("status").isin(read)).exceptAll(o).isEmpty() and u.count() == o.count()
        refused = u.where(~F.col("status").isin(read))
        assert not refused.isEmpty() and refused.where("feature is not null or hist is not null or size(flatten(points)) > 0").isEmpty()
        has = lambda d: {r[0] for r in d.where("size(points) > 0").select("det_id").collect()}
        assert has(u) == has(o)


def test_refused_observations_are_not_computed():
    from collections import namedtuple

    from sceneloom.plans import tracker as K

    row = namedtuple("row", ["det_id", "role", "status", "points", "parents"])(1, "U", "rejected", [[0.0, 0.0, 1.0]], None)
    seen = K.Seen(row)
    assert K.Sequence(K.Camera(), K.Settings()).frame([seen]) == [(1, None, "rejected", None, None)]
    assert not {"points", "center", "reach", "hist"} & set(vars(seen))


def test_tracker_goes_whole_to_processes_without_the_package(tmp_path):
    import subprocess
    import sys

    from pyspark import cloudpickle

    import sceneloom
    from sceneloom.plans import tracker as K

    cloudpickle.register_pickle_by_value(sceneloom)
    try:
        data = cloudpickle.dumps((K.Tracker(K.Camera(), K.Settings()), K.bounds, K.Seen))
    finally:
        cloudpickle.unregister_pickle_by_value(sceneloom)
    (tmp_path / "tracker").write_bytes(data)
    code = "import pickle; _, bounds, _ = pickle.load(open('tracker', 'rb')); import numpy as np; assert bounds(np.eye(3))[0].shape == (3,)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin", "PYTHONPATH": ""}, check=True)


def test_remote_sources_are_lists_not_pairs(spark, sf_dir, monkeypatch):
    from sceneloom.fixtures import scene
    from sceneloom.plans import graph

    n = scene(spark, sf_dir, "nodes").withColumns({"observed": F.col("n") % 3, "confidence": F.when(F.col("n") % 9 > 0, F.col("confidence"))})
    links = lambda: graph.remote_links(n, scene(spark, sf_dir, "templates"), lambda s, t: (s["n"] + t["n"]) % 4, ["scene"])
    plan = joins_by(links())
    assert plan.count("explode(slice(") == 1 and "NOT (s_node_id" not in plan
    whole = sorted(links().collect(), key=str)
    monkeypatch.setattr(graph, "BLOCK", 3)
    assert whole and sorted(links().collect(), key=str) == whole


def test_alike_boxes_are_sifted_by_a_small_condition(spark):
    """A pair that only stands in one cell is dropped in the join, by a condition small enough for the JVM to compile."""
    import random

    from sceneloom.functions import geometry as G
    from sceneloom.operators import joins as J

    r, rows = random.Random(5), []
    for k in range(400):
        low, extent = [r.uniform(0, 4) for _ in "xyz"], [r.uniform(0.5, 2) for _ in "xyz"]
        rows.append((k, "x", *low, *[v + e for v, e in zip(low, extent, strict=True)]))
    box = spark.createDataFrame(rows, ["a", "key", *[f"a{c}" for c in J.BOX3D]])
    other = box.toDF("b", "key", *[f"b{c}" for c in J.BOX3D])
    met = J.alike_boxes(box, other, "a", "b", 0.3, 0.005, ["key"])
    iou = G.iou3d(J.box_columns("a"), J.box_columns("b"), 0.005)
    assert met.where(iou >= 0.3).count() > 800 and met.where(iou < 0.3 - 1e-5).isEmpty()
    side = lambda d, of, p: J.sized_boxes(d, of, p, 0.3, 0.005, ["key"])
    one = J.alike_sized(side(box, "a", "p"), side(other, "b", "q"), "p", "q", 0.3, ["key"], ("a", "b"))
    pairs = lambda d: sorted(tuple(sorted(x)) for x in d.where("a <> b").select("a", "b").collect())
    assert pairs(one) == sorted(set(pairs(met))) and 2 * len(pairs(one)) == len(pairs(met))


def test_consolidation_keeps_its_tables_and_equals_a_replay(spark, monkeypatch):
    """Tracks merged by rounds in plain Python; boxes and sightings are stored once, whatever the rounds."""
    import random

    from sceneloom.plans import mapping as M

    r, rows, seen = random.Random(11), [], []
    for k in range(160):
        low = [r.uniform(0, 2.5), r.uniform(0, 2.5), r.uniform(0, 0.3)]
        rows.append((f"{'OC'[k % 2]}{k:03d}", "OC"[k % 2], r.choice(["door", "desk"]), *low, *[v + r.uniform(0.7, 1.1) for v in low]))
        seen += [(r.randrange(60), rows[-1][0]) for _ in range(r.randint(1, 3))]

    def share(a, b):
        grown = [[x for k in range(3) for x in (v[k] - max(0.005, (v[k + 3] - v[k]) * 0.01), v[k + 3] + max(0.005, (v[k + 3] - v[k]) * 0.01))] for v in (a, b)]
        both, volume = 1.0, [1.0, 1.0]
        for k in (0, 2, 4):
            both *= max(0.0, min(g[k + 1] for g in grown) - max(g[k] for g in grown))
            volume = [v * (g[k + 1] - g[k]) for v, g in zip(volume, grown, strict=True)]
        return round(both / (sum(volume) - both), 9)

    now, frames, want, rounds = {x[0]: x[1:] for x in rows}, {x[0]: {f for f, n in seen if n == x[0]} for x in rows}, {}, 0
    while True:
        best = {}
        for a in now:
            for b in now:
                if a < b and now[a][:2] == now[b][:2] and not frames[a] & frames[b] and share(now[a][2:], now[b][2:]) >= 0.3:
                    p = (-share(now[a][2:], now[b][2:]), a, b)
                    best = {**best, **{n: min(p, best.get(n, p)) for n in (a, b)}}
        mutual = [p for n, p in best.items() if n == p[1] and best[p[2]] == p]
        if not mutual:
            break
        rounds += 1
        for _, a, b in mutual:
            x, y = now[a], now.pop(b)
            now[a] = (*x[:2], *[min(p, q) for p, q in zip(x[2:5], y[2:5], strict=True)], *[max(p, q) for p, q in zip(x[5:], y[5:], strict=True)])
            frames[a] |= frames.pop(b)
            want = {s: a if t == b else t for s, t in want.items()} | {b: a}
    assert rounds >= 3 and len(want) > 30
    boxes = spark.createDataFrame(rows, "node_id string, role string, label string, bx1 double, by1 double, bz1 double, bx2 double, by2 double, bz2 double")
    kept, stored = [], M.stored
    monkeypatch.setattr(M, "stored", lambda df, name: kept.append(name) or stored(df, name))
    for few in (1000, 0):
        monkeypatch.setattr(M, "FEW", few)
        got = M.consolidated(boxes, spark.createDataFrame(seen, "frame long, node_id string"))
        assert {x["source"]: x["target"] for x in got.collect()} == want
    assert kept == ["boxes", "sightings"] * 2


def test_quantiles_are_counted_in_bins_and_equal_percentile(spark, monkeypatch):
    """Whatever the values: ties, far outliers, infinities, NaN, nulls, groups of one row."""
    import random

    from sceneloom.operators import aggregates as A

    r, inf, nan = random.Random(2), float("inf"), float("nan")
    groups = {
        0: [r.gauss(0, 1) for _ in range(900)],
        1: [r.choice([0.5, 0.25, -3.0]) for _ in range(400)],
        2: [10.0 ** r.uniform(-300, 300) * r.choice([1, -1]) for _ in range(300)],
        3: [r.random() for _ in range(200)] + [inf, inf, -inf, nan],
        4: [7.0],
        5: [1.0, 2.0],
        6: [5e-324, 1e-323, 0.0, -0.0, 5e-324],
        7: [1.7e308, -1.7e308, 0.0, 1.0],
        8: [nan, nan, inf],
        9: [None, 3.0, None, 4.0, 9.0],
    }
    rows = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k long, v double")
    shares = {"a": 0.0, "b": 0.02, "c": 0.5, "d": 0.98, "e": 1.0}
    want = {x["k"]: x for x in rows.groupBy("k").agg(*[F.percentile("v", q).alias(n) for n, q in shares.items()]).collect()}
    same = lambda x, y: x == y or (x != x and y != y) or abs(x - y) <= 1e-12 * max(abs(x), abs(y))
    for most, groups_ in ((50_000, 100_000), (3, 100_000), (3, 0)):
        monkeypatch.setattr(A, "SORTED", most)
        monkeypatch.setattr(A, "FEW_GROUPS", groups_)
        got = {x["k"]: x for x in A.quantiles(rows, ["k"], F.col("v"), shares).collect()}
        assert got.keys() == want.keys()
        for k in want:
            assert all(same(got[k][n], want[k][n]) for n in shares), (k, got[k], want[k])


def test_lifting_holds_no_detections_values(spark, sf_dir, monkeypatch):
    """No percentile's map of a detection's depths stands in a plan, and narrowing by bins leaves the result as it was."""
    from sceneloom.operators import aggregates as A
    from sceneloom.plans import queries_artifacts as Q

    plans, saved = [], A.saved
    monkeypatch.setattr(A, "saved", lambda df: plans.append(joins_by(df)) or saved(df))
    whole = sorted(map(tuple, Q.lifted_observations(spark, sf_dir).collect()))
    few = len(plans)
    monkeypatch.setattr(A, "SORTED", 5)
    assert sorted(map(tuple, Q.lifted_observations(spark, sf_dir).collect())) == whole and len(whole) > 50
    assert few > 0 and len(plans) > 2 * few and not any("percentile" in p or "median" in p for p in plans)
