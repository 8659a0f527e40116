"""Operators whose results SQL does not express, against brute force and invariants; edge cases; files."""

from __future__ import annotations

from itertools import permutations

import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sceneloom.functions import geometry as G
from sceneloom.functions import labels as L
from sceneloom.functions import texts as X
from sceneloom.operators import aggregates as A
from sceneloom.operators import assign as O
from sceneloom.operators import filters as Q
from sceneloom.operators import fixpoint as P
from sceneloom.operators import fold as T
from sceneloom.operators import joins as J
from sceneloom.operators import windows as W
from sceneloom.plans import mapping as M
from sceneloom.sources import files as S


@given(st.integers(1, 4), st.integers(1, 4), st.randoms(use_true_random=False))
@settings(max_examples=60, deadline=None)
def test_best_pairs_is_the_best(n, m, rnd):
    score = np.array([[rnd.random() for _ in range(m)] for _ in range(n)])
    valid = np.array([[rnd.random() > 0.3 for _ in range(m)] for _ in range(n)])
    total = sum(score[i, j] for i, j in O.best_pairs(score, valid))
    best, most = 0.0, 0
    for p in permutations([*range(m), *[None] * n], n):
        pairs = [(i, j) for i, j in enumerate(p) if j is not None and valid[i, j]]
        best, most = max(best, sum(score[i, j] for i, j in pairs)), max(most, len(pairs))
    assert total == pytest.approx(best)
    assert len(O.most_pairs(score, valid)) == most


def test_suppression_leaves_no_overlap(spark, sf_dir):
    from sceneloom.fixtures import scene

    d = scene(spark, sf_dir, "detections")
    kept = O.suppressed(d, ["frame_idx"], 0.5).toPandas()
    for _, g in kept.groupby("frame_idx"):
        b = g[["x1", "y1", "x2", "y2"]].to_numpy(float)
        for i in range(len(b)):
            both = O._overlap(b[i], b)
            iou = both / np.maximum(O._area(b[i]) + O._area(b) - both, 1e-9)
            iou[i] = 0
            assert (iou <= 0.5).all()
    # each dropped detection overlaps a kept one of at least its score
    every = d.toPandas()
    gone = every.merge(kept[["frame_idx", "det_id"]], how="left", indicator=True).query("_merge == 'left_only'")
    for r in gone.itertuples():
        k = kept[(kept.frame_idx == r.frame_idx) & (kept.score >= r.score)]
        both = O._overlap(np.array([r.x1, r.y1, r.x2, r.y2], float), k[["x1", "y1", "x2", "y2"]].to_numpy(float))
        assert (both > 0).any()


def test_posterior_closed_form(spark):
    """With one scored frame and unscored ones after it, logits are a geometric sum of ratio temporal / (entropy + temporal)."""
    rows = [(0, "c", "p1", 0.6), (0, "c", "p2", 0.45)] + [(t, "x", "y", None) for t in range(1, 4)]
    post = T.posteriors(spark.createDataFrame(rows, "frame_idx long, child_node_id string, parent_node_id string, s2d_score double")).orderBy("frame_idx").collect()
    odds = np.array([np.log(p / (1 - p)) for p in (0.6, 0.45)] + [0.0])[np.argsort(["p1", "p2", T.NULL_PARENT])]
    logit = np.zeros(3)
    for row in post:
        logit = odds / 0.15 + logit / 3
        want = np.exp(logit - logit.max())
        assert row["p"] == pytest.approx(list(want / want.sum()))
    assert len(post) == 4


def test_unscored_children_have_no_posterior(spark):
    df = spark.createDataFrame([(0, "c", "p", None)], "frame_idx long, child_node_id string, parent_node_id string, s2d_score double")
    assert T.posteriors(df).count() == 0


def test_alias_chains_and_cycles(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (10, 11), (11, 10)], "source long, target long")
    assert {r["source"]: r["canonical"] for r in P.canonical(df).collect()} == {1: 4, 2: 4, 3: 4, 10: 10, 11: 10}


def test_components(spark):
    links = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (9, 8), (7, 8)], "a long, b long")
    assert {r["node"]: r["label"] for r in P.components(links).collect()} == {5: 2, 4: 2, 3: 2, 2: 2, 9: 7, 8: 7, 7: 7}


def test_dense_clusters_match_brute_force():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 0.02, (60, 3)), rng.normal(1, 0.02, (40, 3)), rng.uniform(-3, 3, (15, 3))])
    got = M.dense(x, 0.05, 4)
    near = ((x[:, None] - x[None]) ** 2).sum(axis=2) <= 0.05**2
    core = near.sum(axis=1) >= 4
    for i in range(len(x)):
        for j in range(len(x)):
            if core[i] and core[j] and near[i, j]:
                assert got[i] == got[j] >= 0
    assert ((got < 0) == ~(near & core[None]).any(axis=1)).all()


def test_normals_of_a_plane(spark):
    rng = np.random.default_rng(1)
    p = pd.DataFrame({"node": 1, "x": rng.uniform(size=200), "y": rng.uniform(size=200), "z": 0.5})
    r = M.normals(spark.createDataFrame(p), "node").collect()[0]
    assert (r["nx"], r["ny"], r["nz"]) == (0.0, 0.0, 1.0)


def test_consolidation_ends_in_disjoint_tracks(spark):
    rows = [(f"C{i:06d}", "C", "door", 0.0 + 0.01 * i, 0.0, 0.0, 1.0 + 0.01 * i, 1.0, 1.0) for i in range(4)] + [("C000009", "C", "door", 5.0, 5.0, 5.0, 6.0, 6.0, 6.0)]
    boxes = spark.createDataFrame(rows, "node_id string, role string, label string, bx1 double, by1 double, bz1 double, bx2 double, by2 double, bz2 double")
    seen = spark.createDataFrame([(0, "C000000"), (0, "C000009")], "frame long, node_id string")
    assert {(r["source"], r["target"]) for r in M.consolidated(boxes, seen).collect()} == {(f"C{i:06d}", "C000000") for i in (1, 2, 3)}
    together = spark.createDataFrame([(0, f"C{i:06d}") for i in range(4)], "frame long, node_id string")
    assert M.consolidated(boxes, together).count() == 0


def test_labels(spark):
    df = spark.createDataFrame([("Cabinet_Door", "door"), ("door", "cabinet door"), ("T.V.", "tv"), ("", "x"), (None, "x"), ("a-b  c", "b c")], "a string, b string")
    r = df.select(L.prior_label(F.col("a")).alias("p"), L.track_label(F.col("a")).alias("t"), L.compatible(F.col("a"), F.col("b")).alias("c")).collect()
    assert [x["p"] for x in r] == ["cabinet door", "door", "t v", "", "", "a b c"]
    assert [x["t"] for x in r][2] == "t.v."
    assert [x["c"] for x in r] == [True, False, False, False, False, True]
    t = spark.createDataFrame([("Turn the knob",), ("turn on the lamp",), ("push/pull a door",)], "t string")
    assert [x[0] for x in t.select(L.canonical_text(F.col("t"), [F.lit("knob"), F.lit("door")])).collect()] == ["rotate", "turn on lamp", "push or pull"]
    g = spark.createDataFrame([("kitchen utensils",), ("utensil holder",), ("small thing",), ("knife",), ("",)], "t string")
    assert [x[0] for x in g.select(L.generic(F.col("t"))).collect()] == [True, False, True, False, True]


def test_scores_in_answers(spark):
    texts = ['{"s2d_score": 0.7}', '```json\n{"s2d_score": "score 0.2"}\n```', '{"s2d_score": 1.5, "reason": "cut', "a score of 0.9", None, '{"other": 1}']
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(X.score(F.col("t"))).collect()]
    assert got == [0.7, 0.2, 0.99, None, None, None]
    assert X.first_object('noise {bad {"a": "}"} tail') == '{"a": "}"}'


def test_rotation_is_orthonormal(spark):
    df = spark.createDataFrame([(0.3, -0.2, 0.9), (0.0, 0.0, 0.0)], "x double, y double, z double")
    for r in df.select(F.array(*G.axis_angle([F.col(c) for c in "xyz"])).alias("m")).collect():
        m = np.array(r["m"]).reshape(3, 3)
        assert m @ m.T == pytest.approx(np.eye(3))
    q = df.select(F.array(*G.rotation(F.lit(0.5), F.lit(-0.5), F.lit(0.5), F.lit(0.5))).alias("m")).first()["m"]
    assert np.linalg.det(np.array(q).reshape(3, 3)) == pytest.approx(1)


@pytest.mark.parametrize(("n", "k"), [(1, 3), (3, 3), (10, 4), (97, 10), (1000, 7)])
def test_evenly_is_linspace(spark, n, k):
    df = spark.range(n).withColumn("g", F.lit(0))
    got = sorted(r["id"] for r in W.evenly(df, ["g"], ["id"], k).collect())
    assert got == (list(range(n)) if n <= k else sorted(set(np.floor(np.linspace(0, n - 1, k) + 1e-9).astype(int).tolist())))


def test_empty_inputs(spark, sf_dir):
    from sceneloom.fixtures import scene
    from sceneloom.operators import filters as FI

    d, r = scene(spark, sf_dir, "detections").limit(0), scene(spark, sf_dir, "relations_2d").limit(0)
    assert FI.border_single_units(d, r).count() == FI.small_unsure_units(d, r).count() == FI.linked_or_inside(d, r).count() == 0
    assert O.suppressed(d, ["frame_idx"], 0.5).count() == 0
    assert P.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "cameras.txt").write_text("# cameras\n1 PINHOLE 640 480 500 510 320 240\n2 SIMPLE_RADIAL 100 50 80 50 25 0.1\n")
    c = {r["camera_id"]: r for r in S.rescaled(S.cameras(spark, str(tmp_path / "cameras.txt")), 320, 240).collect()}
    assert (c[1]["fx"], c[1]["fy"], c[1]["cx"], c[1]["cy"]) == (250.0, 255.0, 160.0, 120.0) and c[2]["fy"] == 80 * 240 / 50
    (tmp_path / "bad.txt").write_text("1 MAGIC 1 1 1\n")
    with pytest.raises(Exception, match="MAGIC"):
        S.cameras(spark, str(tmp_path / "bad.txt")).collect()
    (tmp_path / "images.txt").write_text("# images\n1 1 0 0 0 0.1 0.2 0.3 1 a2.png\n10 20 -1\n2 1 0 0 0 1 2 3 1 a10.png\n\n")
    p = S.poses(spark, str(tmp_path / "images.txt"))
    assert sorted(r["stem"] for r in p.collect()) == ["a10", "a2"]
    for folder in ("rgb", "depth"):
        (tmp_path / folder).mkdir()
        for n in ("a2", "a10", "b"):
            (tmp_path / folder / f"{n}.png").write_bytes(b"x")
    frames = S.posed_frames(S.image_files(spark, str(tmp_path / "rgb")), S.image_files(spark, str(tmp_path / "depth")), p).orderBy("source_index").collect()
    assert [f["frame_key"] for f in frames] == ["a2", "a10"]
    assert [r["stem"] for r in S.rgb_folder(spark, str(tmp_path / "rgb"), 0, None, 2).orderBy("source_index").collect()] == ["a2", "b"]
    (tmp_path / "x.traj").write_text("0.1 0 0 1 1 2 3\n0.2 0 0 2 2 3 4\n")
    assert [r["rz"] for r in S.trajectory(spark, str(tmp_path / "x.traj")).orderBy("t").collect()] == [1.0, 2.0]
    (tmp_path / "split.txt").write_text("# all\nscene/1\n\nscene/2 # two\n")
    assert [r[0] for r in S.split_list(spark, str(tmp_path / "split.txt")).collect()] == ["scene/1", "scene/2"]
    (tmp_path / "none.txt").write_text("# none\n")
    with pytest.raises(ValueError, match="no entries"):
        S.split_list(spark, str(tmp_path / "none.txt"))
    assert S.json_lines(spark, str(tmp_path / "missing.jsonl"), "a int").count() == 0
    (tmp_path / "in.ply").write_text("ply\nformat ascii 1.0\nelement vertex 3\nproperty float x\nend_header\n1 2 3 4 5 6\n0 0 0\nnan 0 0 1 1 1\n")
    pts = S.ply(spark, str(tmp_path / "in.ply"))
    assert sorted(tuple(r) for r in pts.collect()) == [(0.0, 0.0, 0.0, 180, 180, 180), (1.0, 2.0, 3.0, 4, 5, 6)]
    S.write_ply(pts.withColumn("k", F.col("x")), str(tmp_path / "out"), ["k"])
    assert S.ply(spark, str(tmp_path / "out")).count() == 2
    (tmp_path / "base.yaml").write_text("a: {b: 1, c: 2}\nd: ${SCENE_X}\n")
    (tmp_path / "own.yaml").write_text("inherit_from: base.yaml\na: {c: 3}\n")
    import os

    os.environ["SCENE_X"] = "seven"
    assert S.config(str(tmp_path / "own.yaml")) == {"a": {"b": 1, "c": 3}, "d": "seven"}


def test_late_rows_are_dropped(spark, tmp_path):
    """A row later than the watermark allows is not counted; one inside it is."""
    from sceneloom.streaming import streams as R

    base = pd.Timestamp("2024-01-01")
    for i, hours in enumerate([[0, 1, 30], [26], [2]]):
        rows = [((base + pd.Timedelta(hours=h)).to_pydatetime(), "a") for h in hours]
        spark.createDataFrame(rows, "ts timestamp, k string").coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
        import shutil

        part = next((tmp_path / "in" / f"p{i}").glob("part-*.parquet"))
        shutil.move(part, tmp_path / f"f{i}.parquet")
    (tmp_path / "s").mkdir()
    for i in range(3):
        (tmp_path / f"f{i}.parquet").rename(tmp_path / "s" / f"f{i}.parquet")
    e = spark.readStream.schema("ts timestamp, k string").option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "s"))
    w = R.drained(R.window_counts(e, "ts", ["k"], "1 hour", "5 hours"), str(tmp_path / "out"), "append")
    assert {r["start"].hour for r in w.collect()} >= {0, 1}
    assert all(r["n"] == 1 for r in w.collect())


def test_a_cut_off_checkpoint_leaves_the_one_before(spark, tmp_path, monkeypatch):
    from sceneloom.operators import artifacts as A

    at, df = str(tmp_path / "c"), lambda n: spark.range(n).withColumnRenamed("id", "v")
    A.save_checkpoint({"state": df(2), "points": df(5)}, at, {"a": "1"})
    assert (A.checkpointed(spark, at, {"a": "1"}).count(), A.checkpointed(spark, at, {"a": "1"}, "points").count()) == (2, 5)
    with monkeypatch.context() as m:  # the run stops after its tables, before the manifest
        m.setattr(A, "put_text", lambda *x: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            A.save_checkpoint({"state": df(3), "points": df(6)}, at, {"a": "1"})
    assert (A.checkpointed(spark, at, {"a": "1"}).count(), A.checkpointed(spark, at, {"a": "1"}, "points").count()) == (2, 5)
    for n in (7, 8, 9):
        A.save_checkpoint(df(n), at, {"a": str(n)})
    assert A.checkpointed(spark, at, {"a": "9"}).count() == 9 and len(list((tmp_path / "c").glob("v-*"))) == 2
    A.put_text(spark, f"{at}/note.json", "x" * 9)
    A.put_text(spark, f"{at}/note.json", '{"ü": 1}')
    assert A.get_text(spark, f"{at}/note.json") == '{"ü": 1}' and A.get_text(spark, f"{at}/none.json") is None


def test_masks(spark):
    from sceneloom.operators import masks as K

    m = np.zeros((9, 12), bool)
    m[1:6, 1:6] = True
    m[3, 3] = False
    m[7:9, 9:12] = True
    runs = spark.createDataFrame(K.to_runs(m, 10, 20).assign(frame_idx=0, det_id=0)[["frame_idx", "det_id", "row", "start", "length"]].astype({"row": "int32", "start": "int32", "length": "int32"}))
    area = lambda how: sum(r["area"] for r in K.areas(K.shaped(runs, how)).collect())
    assert (area("main"), area("fill"), area("erode"), area("close")) == (24, 31, 0, 31)
    assert area("dilate") == 49 + 4 * 5
    p = K.parts(m)
    assert p.max() == 2 and (p > 0).sum() == m.sum()
    assert (K.to_runs(*K.grid(K.to_runs(m, 10, 20))).to_numpy() == K.to_runs(m, 10, 20).to_numpy()).all()


def test_artifacts(spark, tmp_path):
    from sceneloom import schema as C
    from sceneloom.operators import artifacts as A

    f = spark.createDataFrame([("a", 1), ("b", 2)], "frame_key string, v int")
    assert A.unique_frames(f).count() == 2
    with pytest.raises(Exception, match="repeated frame key a"):
        A.unique_frames(f.union(f.limit(1))).collect()
    assert sorted(map(tuple, A.associations(spark.createDataFrame([("f", {"0": "O1", "2": "U1"})], "frame_key string, det_to_node map<string,string>")).collect())) == [("f", 0, "O1"), ("f", 2, "U1")]
    rel = spark.createDataFrame([(1, 2)], "first long, second long")
    notes = spark.createDataFrame([(i,) for i in range(1, 6)], "annot_id long")
    assert A.snapshot(notes, rel, "annot_id", 3).count() == 3
    with pytest.raises(ValueError, match="after the snapshot"):
        A.snapshot(notes, rel, "annot_id", 1)
    size = lambda rows: spark.createDataFrame(rows, "frame_key string, width int, height int")
    assert [r[0] for r in A.aligned(size([("a", 4, 3), ("b", 4, 3), ("c", 4, 3)]), size([("a", 4, 3), ("b", 2, 3)]), size([("a", 4, 3)])).orderBy("frame_key").collect()] == ["b", "c"]
    state = str(tmp_path / "state")
    prints = {"frames": A.fingerprint(f)}
    assert prints == {"frames": A.fingerprint(f.orderBy("v", ascending=False))} and A.checkpointed(spark, state, prints) is None
    A.save_checkpoint(f, state, prints)
    assert A.checkpointed(spark, state, prints).count() == 2
    with pytest.raises(ValueError, match="other inputs"):
        A.checkpointed(spark, state, {"frames": "0"})
    old = spark.createDataFrame([(1, [1.0]), (3, [2.0])], "schema_version int, box_xyxy array<double>")
    assert {tuple(r["box"]) for r in C.migrated(old).collect()} == {(1.0,), (2.0,)}
    with pytest.raises(ValueError, match="schema_version"):
        C.migrated(spark.createDataFrame([(9, [1.0])], "schema_version int, box_xyxy array<double>"))
    A.write_rows(f, str(tmp_path / "rows"), "v")
    A.write_rows(f, str(tmp_path / "log"), mode="append", fmt="json")
    A.write_rows(f, str(tmp_path / "log"), mode="append", fmt="json")
    assert spark.read.parquet(str(tmp_path / "rows")).count() == 2 and spark.read.json(str(tmp_path / "log")).count() == 4
    for ddl in C.TABLES.values():
        assert spark.createDataFrame([], ddl).columns


def test_nulls_stay_missing(spark):
    """Unscored rows add nothing, null labels match nothing, null boxes give null scores."""
    from sceneloom.operators.aggregates import log_odds
    from sceneloom.operators.artifacts import scored

    e = spark.createDataFrame([("c", "p", "f1", 0.5), ("c", "p", "f2", None), ("c", "q", "f2", None)], "child_node_id string, parent_node_id string, frame_key string, s2d_score double")
    assert [tuple(r) for r in log_odds(e).collect()] == [("c", "p", 0.0, 1, 1)]
    c = spark.createDataFrame([(1, ""), (2, "self_loop"), (3, "")], "cache_key long, fail_reason string")
    k = spark.createDataFrame([(1, 0.4), (3, None)], "cache_key long, s2d_score double")
    assert sorted((r["cache_key"], r["s2d_score"], r["error"]) for r in scored(c, k).collect()) == [(1, 0.4, ""), (2, None, "self_loop"), (3, None, "cache_miss")]
    b = spark.createDataFrame([(None, 0.0, 1.0, 1.0)], "x1 double, y1 double, x2 double, y2 double")
    assert b.select(G.ownership(G.box(), G.box())["score"].alias("s")).first()["s"] is None


def test_features_of_every_embedding(spark, sf_dir):
    from sceneloom.catalogue import QUERIES

    unit = lambda x: x / np.sqrt((x * x).sum())
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("label", "vec_id", "embedding").toPandas().sort_values("vec_id")
    assert (e.vec_id >= 200).any()
    for name, step in (("feature_ema", lambda a, x, _: 0.7 * a + 0.3 * x), ("weighted_feature_mean", lambda a, x, i: a + (i % 7 + 1) / 8 * x)):
        want = {}
        for label, i, x in zip(e.label, e.vec_id, e.embedding, strict=True):
            x = np.asarray(x, float)
            want[label] = unit(step(want[label], x, i) if label in want else x)
        got = {r["label"]: (r["first"], r["last"]) for r in QUERIES[name](spark, sf_dir).collect()}
        assert got.keys() == want.keys()
        assert all(got[k] == pytest.approx((v[0], v[63]), abs=2e-6) for k, v in want.items())


def test_label_norm_of_whole_texts(spark, sf_dir, tmp_path):
    import hashlib

    from sceneloom.catalogue import QUERIES

    texts = ["a b_c-D " * 10 + end for end in ("One!", "Two?")]
    spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["prior"], r["hash"], r["md5"]) for r in QUERIES["label_norm"](spark, str(tmp_path)).collect()}
    assert got == {n: (("a b c d " * 10 + ("one", "two")[n]), hashlib.sha256(t.encode()).hexdigest(), hashlib.md5(t.encode()).hexdigest()) for n, t in enumerate(texts)}


def _relations(spark, rows):
    """rows: parent, child, parent_role, child_role, contain; all of frame 1 and passing."""
    return spark.createDataFrame([(1, p, c, a, b, f"{a}-{b}", float(x), True) for p, c, a, b, x in rows], "frame_idx long, parent_det_id long, child_det_id long, parent_role string, child_role string, edge_type string, contain double, pass_threshold boolean")


def test_role_suppression_crosses_roles(spark):
    """A carrier with an object's box suppresses it; two objects of one score that overlap both go, with what the first overlaps."""
    rows = [(1, 0, "O", 0.9, 0, 0, 99, 99), (1, 1, "C", 0.3, 0, 0, 99, 99), (2, 0, "O", 0.5, 0, 0, 99, 99), (2, 1, "O", 0.5 + 5e-7, 0, 0, 99, 90), (2, 2, "O", 0.4, 0, 0, 99, 95), (3, 0, "O", 0.5, 0, 0, 99, 99), (3, 1, "O", 0.4, 0, 0, 99, 99), (4, 0, "U", 0.5, 0, 0, 9, 9), (4, 1, "U", 0.4, 7, 0, 16, 9)]
    d = spark.createDataFrame(rows, "frame_idx long, det_id long, role string, score double, x1 long, y1 long, x2 long, y2 long")
    got = sorted((r["frame_idx"], r["det_id"]) for r in O.suppressed_by_role(d, ["frame_idx"], 0.17).collect())
    assert got == [(1, 1), (3, 0), (4, 0)]  # 30 of 170 inclusive pixels are more than 0.17
    assert (4, 1) in [(r["frame_idx"], r["det_id"]) for r in O.suppressed_by_role(d, ["frame_idx"], 0.18).collect()]


def test_units_are_judged_by_their_best_parent(spark):
    """A carrier before an object that contains more; a score equal to the threshold is not sure."""
    box = lambda i, role, score, side: (1, i, role, score, 100, 100, 100 + side - 1, 100 + side - 1)
    d = spark.createDataFrame([box(0, "O", 0.9, 300), box(1, "C", 0.9, 200), box(2, "U", 0.5, 10), box(3, "U", 0.8, 40), box(4, "U", 0.9, 60), box(5, "U", 0.7, 40)], "frame_idx long, det_id long, role string, score double, x1 long, y1 long, x2 long, y2 long")
    by_carrier = [(1, 2, "C", "U", 0.6), (0, 2, "O", "U", 0.9)]
    sure = lambda p, role: [(p, 3, role, "U", 0.9), (p, 4, role, "U", 0.9)]
    small = lambda rows: [r["det_id"] for r in Q.small_unsure_units(d, _relations(spark, rows)).collect()]
    assert small(by_carrier + sure(1, "C")) == [2]
    assert small(by_carrier + sure(0, "O")) == []  # the object is not its best parent
    assert small([(0, 2, "O", "U", 0.9)] + sure(0, "O")) == [2]
    assert small([(1, 2, "C", "U", 0.6), (1, 3, "C", "U", 0.9), (1, 5, "C", "U", 0.9)]) == []  # one sure sibling only


def test_border_unit_of_its_best_parent(spark):
    d = spark.createDataFrame([(1, 0, "O", 10, 10, 300, 300), (1, 1, "C", 10, 10, 200, 200), (1, 2, "U", 0, 10, 20, 20), (1, 3, "U", 50, 50, 60, 60), (1, 4, "O", 5, 5, 400, 400)], "frame_idx long, det_id long, role string, x1 long, y1 long, x2 long, y2 long")
    gone = lambda rows: sorted(r["det_id"] for r in Q.border_single_units(d, _relations(spark, rows)).collect())
    assert gone([(1, 2, "C", "U", 0.6), (0, 2, "O", "U", 0.9), (4, 1, "O", "C", 0.9)]) == [1, 2, 4]
    # the best parent, a carrier, has another unit: the sole object is no reason
    assert gone([(1, 2, "C", "U", 0.6), (1, 3, "C", "U", 0.9), (0, 2, "O", "U", 0.9)]) == []


def test_remote_candidates_are_exempt(spark):
    d = spark.createDataFrame([(1, 0, "O", "lamp"), (1, 1, "C", "panel"), (2, 0, "C", "panel"), (1, 2, "O", "desk")], "frame_idx long, det_id long, role string, label string")
    allowed = spark.createDataFrame([("panel", "lamp")], "child_label string, parent_label string")
    assert sorted(map(tuple, Q.remote_exempt(d, ["lamp"], allowed).collect())) == [(1, 0), (1, 1)]


def test_nearest_pose_keeps_range_and_tolerance(spark, monkeypatch):
    monkeypatch.setattr(J, "RANGE_ROWS", 3)
    track = [(t, float(t)) for t in (10, 20, 40, 100)]
    p = spark.createDataFrame([(t,) for t in (5, 10, 15, 29, 33, 60, 81, 100, 101)], "t long")
    f = J.as_of(p, spark.createDataFrame(track, "t long, x double"), "t", ["x"])
    assert sorted((r["t"], r["before_x"], r["after_x"]) for r in f.where("t = 60 or t = 100").collect()) == [(60, 40.0, 100.0), (100, 100.0, 100.0)]
    assert sorted((r["t"], r["nearest_t"]) for r in J.nearest(f, "t", 19).collect()) == [(10, 10), (15, 10), (29, 20), (33, 40), (81, 100), (100, 100)]


def test_generic_labels(spark):
    want = {"electric device": True, "stuff": True, "box": True, "cardboard box": True, "office furniture": False, "kitchen utensils": True, "utensil holder": False, "dishwasher": False, "red thing": True, "": True, "counter top": True, "household kitchen appliances": True}
    got = spark.createDataFrame([(x,) for x in want], "l string").select("l", L.generic(F.col("l")).alias("g")).collect()
    assert {r["l"]: r["g"] for r in got} == want


def test_switches_follow_the_posterior(spark):
    """A parent that scores best in one frame does not come first while another's evidence outweighs it."""
    rows = [(1, "U1", "A", 0.95), (2, "U1", "B", 0.7), (3, "U1", "B", 0.9999), (4, "U1", "B", None)]
    out = T.switches(T.posteriors(spark.createDataFrame(rows, "frame_idx long, child_node_id string, parent_node_id string, s2d_score double"))).orderBy("frame_idx").collect()
    assert [(r["frame_idx"], r["top"], r["switched"]) for r in out] == [(1, "A", False), (2, "A", False), (3, "B", True), (4, "B", False)]


def test_main_parts_are_those_of_the_grid(spark):
    """Parts found on runs are the parts of the pixels, of many masks at once."""
    from sceneloom.operators import masks as K

    rng = np.random.default_rng(5)
    rows, want = [], {}
    for i in range(60):
        m = rng.random((rng.integers(1, 9), rng.integers(1, 12))) < rng.choice([0.25, 0.5, 0.75])
        if not m.any():
            continue
        m = m[np.ix_(np.flatnonzero(m.any(axis=1)).min() + np.arange(np.ptp(np.flatnonzero(m.any(axis=1))) + 1), np.flatnonzero(m.any(axis=0)).min() + np.arange(np.ptp(np.flatnonzero(m.any(axis=0))) + 1))]
        p = K.parts(m)
        center = p[m.shape[0] // 2, m.shape[1] // 2]
        sizes = np.bincount(p[m], minlength=p.max() + 1)
        part = center if m[m.shape[0] // 2, m.shape[1] // 2] else np.flatnonzero(sizes == sizes.max()).max()
        want[i] = {(y + 3, x + 7) for y, x in zip(*np.nonzero(m & (p == part)), strict=True)}
        rows += [(i // 7, i, int(r.row), int(r.start), int(r.length)) for r in K.to_runs(m, 3, 7).itertuples()]
    got = {}
    for r in K.shaped(spark.createDataFrame(rows, "frame_idx long, det_id long, row int, start int, length int"), "main").collect():
        got.setdefault(r["det_id"], set()).update((r["row"], x) for x in range(r["start"], r["start"] + r["length"]))
    assert got == want


def _pixels(df):
    got = {}
    for r in df.collect():
        got.setdefault(r["det_id"], set()).update((r["row"], x) for x in range(r["start"], r["start"] + r["length"]))
    return got


def test_runs_grow_shrink_close_as_pixels(spark):
    """Random masks, some at the image's border: spans against a grid of pixels; hulls against half planes."""
    from sceneloom.operators import masks as K

    rng, rows, masks = np.random.default_rng(12), [], {}
    h, w = 14, 17
    for i in range(24):
        m = rng.random((h, w)) < rng.choice([0.05, 0.2, 0.6])
        if m.any():
            masks[i] = m
            rows += [(0, i, int(r.row), int(r.start), int(r.length)) for r in K.to_runs(m, 0, 0).itertuples()]
    runs = spark.createDataFrame(rows, K.RUN)
    around = K.ellipse(2)
    assert around == [(-2, 0), (-1, 2), (0, 2), (1, 2), (2, 0)] and K.ellipse(1) == [(-1, 0), (0, 1), (1, 0)]
    offsets = [(dy, dx) for dy, n in around for dx in range(-n, n + 1)]
    spots = lambda m: {(int(y), int(x)) for y, x in zip(*np.nonzero(m))}
    grow = lambda s: {(y + dy, x + dx) for y, x in s for dy, dx in offsets}
    shrink = lambda s, ok: {(y, x) for y, x in s if all((y + dy, x + dx) in s or not ok(y + dy, x + dx) for dy, dx in offsets)}
    inside = lambda y, x: 0 <= y < h and 0 <= x < w
    assert _pixels(K.grown(runs, around)) == {i: grow(spots(m)) for i, m in masks.items()}
    assert _pixels(K.shrunk(runs, around)) == {i: s for i, m in masks.items() if (s := shrink(spots(m), lambda y, x: True))}
    assert _pixels(K.closed(runs, 2, w, h)) == {i: shrink({p for p in grow(spots(m)) if inside(*p)}, inside) for i, m in masks.items()}
    want = {}
    for i, m in masks.items():
        points = sorted(spots(m))
        if len(points) < 3:
            want[i] = set(points)
            continue
        lines = [(a, b) for a in points for b in points if a != b and all((b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]) >= 0 for p in points)]
        box = [(y, x) for y in range(h) for x in range(w) if points[0][0] <= y <= points[-1][0] and min(p[1] for p in points) <= x <= max(p[1] for p in points)]
        want[i] = {p for p in box if all((b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]) >= 0 for a, b in lines)}
    assert _pixels(K.hulls(runs)) == want


def test_support_of_a_mask(spark):
    from sceneloom.operators import masks as K

    m = np.zeros((20, 20), bool)
    m[3:12, 3:12] = True
    m[5, 5] = m[7, 3:12] = False  # a hole, and a gap that the largest part does not cross
    m[16, 16] = True
    runs = spark.createDataFrame([(0, 0, int(r.row), int(r.start), int(r.length)) for r in K.to_runs(m, 0, 0).itertuples()], K.RUN)
    box = lambda *b: spark.createDataFrame([(0, 0, *b)], "frame_idx long, det_id long, x1 int, y1 int, x2 int, y2 int")
    area = lambda b, r: sum(x["area"] for x in K.areas(K.support(runs, box(*b), r, 20, 20)).collect())
    assert area((0, 0, 20, 20), 0) == area((0, 0, 20, 20), 1) == 36  # rows 3 to 6 or 8 to 11: the first of equal parts, the larger by the hole
    assert area((4, 0, 9, 20), 0) == 20 and area((14, 14, 20, 20), 1) == 1


def _density_clusters(xyz, eps, least):
    """Brute force: core points within eps of each other are one cluster; others join their first core neighbour's."""
    near = ((xyz[:, None] - xyz[None]) ** 2).sum(axis=2) <= eps * eps
    core = near.sum(axis=1) >= least
    out, now = np.full(len(xyz), -1), 0
    for i in np.flatnonzero(core):
        if out[i] < 0:
            todo = [i]
            out[i] = now
            while todo:
                for j in np.flatnonzero(near[todo.pop()] & (out < 0)):
                    out[j] = now
                    if core[j]:
                        todo.append(j)
            now += 1
    return out


def test_clusters_stay_or_fall_by_their_rules(spark):
    rng = np.random.default_rng(3)
    big, small, far = rng.normal(0, 0.01, (60, 3)), rng.normal(0.5, 0.005, (20, 3)), rng.uniform(2, 9, (10, 3))
    xyz = np.concatenate([big, small, far])
    assert (M.dense(xyz, 0.02, 4) == _density_clusters(xyz, 0.02, 4)).all()
    c = _density_clusters(xyz, 0.02, 4)
    main = c == np.bincount(c[c >= 0]).argmax()

    def frame(*groups):
        rows = [(n, i, *map(float, p), float(p[0] * 500), float(p[1] * 500), parent, 0.05) for n, (ps, parent) in enumerate(groups) for i, p in enumerate(ps)]
        return spark.createDataFrame(rows, "node long, pid long, x double, y double, z double, u double, v double, parent double, band double")

    def held(df):
        out = {}
        for r in df.collect():
            out.setdefault(r["node"], set()).add(r["pid"])
        return out

    some = frame((xyz, None), (far, None), (xyz[:1], None))
    got = held(M.in_main_cluster(some, "node", 0.02, 4, 0.3))
    assert got == {0: set(np.flatnonzero(main)), 1: set(range(10)), 2: {0}}
    assert held(M.in_main_cluster(some, "node", 0.02, 4, 0.9)) == {0: set(range(90)), 1: set(range(10)), 2: {0}}
    # on voxels all points near the main cluster's means stay, and none of the others
    means = {}
    for p in xyz:
        means.setdefault(tuple(np.floor(p / 0.005).astype(int)), []).append(p)
    sample = np.array([np.mean(v, axis=0) for _, v in sorted(means.items())])
    k = _density_clusters(sample, 0.02, 2)
    core = sample[k == np.bincount(k[k >= 0]).argmax()]
    near = {i for i, p in enumerate(xyz) if (np.linalg.norm(core - p, axis=1) <= 0.03).any()}
    assert held(M.in_main_cluster(some, "node", 0.02, 2, 0.1, 0.005))[0] == near and len(near) < 70
    deep = xyz + np.array([0.0, 0.0, 1.0])
    best = lambda center, **more: held(M.in_best_cluster(frame((deep, None), (deep, 1.5), (far, None), (far[:3], None)), "node", 600.0, center, low=0.02, high=0.02, least=4, **more))
    at_big, at_small = best((0.0, 0.0)), best((250.0, 250.0))
    own = lambda k: set(np.flatnonzero(c == k))
    first, second = c[0] if c[0] >= 0 else 0, c[60:80].max()
    assert at_big == {0: own(first), 1: own(second), 3: {0, 1, 2}} and at_small == {0: own(second), 1: own(second), 3: {0, 1, 2}}
    assert best((250.0, 250.0), keep=30)[0] == own(first)



def test_binary_ply_and_sequences(spark, tmp_path):
    v = np.array([(1, 2, 3, 4, 5, 6), (np.nan, 0, 0, 1, 1, 1), (7, 8, 9, 10, 11, 12)], [(c, "<f4") for c in "xyz"] + [(c, "u1") for c in ("red", "green", "blue")])
    head = "ply\nformat binary_little_endian 1.0\ncomment x\nelement vertex 3\n" + "".join(f"property float {c}\n" for c in "xyz") + "".join(f"property uchar {c}\n" for c in ("red", "green", "blue")) + "element face 0\nproperty list uchar int vertex_indices\nend_header\n"
    (tmp_path / "b.ply").write_bytes(head.encode() + v.tobytes())
    plain = np.array([(1, 2, 3)], [(c, ">f8") for c in "xyz"])
    (tmp_path / "p.ply").write_bytes(b"ply\nformat binary_big_endian 1.0\nelement vertex 1\nproperty double x\nproperty double y\nproperty double z\nend_header\n" + plain.tobytes())
    got = sorted(tuple(r) for r in S.ply_binary(spark, str(tmp_path / "*.ply")).collect())
    assert got == [(1.0, 2.0, 3.0, 4, 5, 6), (1.0, 2.0, 3.0, 180, 180, 180), (7.0, 8.0, 9.0, 10, 11, 12)]
    with pytest.raises(ValueError, match="unknown kind of sequence"):
        S.create_sequence(spark, "nothing")


def test_final_hierarchy_refuses_two_parents(spark):
    rows = [("O-C", "O1", "C1", "open", True), ("C-U", "C1", "U1", " ", False), ("C-U", "C2", "U2", "pull", False)]
    e = spark.createDataFrame(rows, "edge_type string, parent_node_id string, child_node_id string, relation_text string, provisional boolean")
    f = M.final_hierarchy(e)
    assert {r["child_node_id"]: (r["functional_status"], r["object_parent_id"], r["object_parent_status"]) for r in f.collect()} == {"C1": ("complete", None, None), "U1": ("pending", "O1", "provisional"), "U2": ("complete", None, "unknown")}
    assert tuple(M.hierarchy_audit(f).first()) == (3, 1, 1)
    with pytest.raises(ValueError, match="U1"):
        M.final_hierarchy(e.union(spark.createDataFrame([("O-U", "O1", "U1", "", False)], e.schema)))


def test_nearest_without_a_radius(spark):
    """Clumps, far points and partners of other groups: as by brute force, each point once."""
    rng = np.random.default_rng(8)
    near, far = rng.normal(0, 0.03, (150, 3)), rng.uniform(-40, 40, (12, 3))
    left = [(g, int(i), *map(float, p)) for g in (1, 2, 3) for i, p in enumerate(np.concatenate([near, far]))]
    points = {1: rng.normal(0, 0.03, (300, 3)), 2: rng.uniform(-60, 60, (4, 3))}
    right = [(g, *map(float, p)) for g, ps in points.items() for p in ps]
    got = J.nearest_points(spark.createDataFrame(left, "g long, i long, a_x double, a_y double, a_z double"), spark.createDataFrame(right, "g long, b_x double, b_y double, b_z double"), ["g"], "a_", "b_", ["i"], 0.01).collect()
    want = {(g, i): float(np.sqrt(((points[g] - np.array(p)) ** 2).sum(axis=1)).min()) for g, i, *p in left if g in points}
    assert len(got) == len(want) and {(r["g"], r["i"]): round(r["distance"], 9) for r in got} == {k: round(v, 9) for k, v in want.items()}


def test_hits_of_many_blocks(spark):
    """Blocks on both sides, many equal vectors: as one product over all."""
    from sceneloom.plans import evaluate as E

    rng = np.random.default_rng(9)
    base = rng.normal(size=(60, 5))
    vectors = np.concatenate([base, np.repeat(base[:1], 40, axis=0), -base[:10]])
    v = [(int(i), [float(x) for x in e]) for i, e in enumerate(vectors)]
    q = [(int(i), [float(x) for x in e]) for i, e in enumerate(vectors) if i % 3 == 0]
    got = E.hits(spark.createDataFrame(q, "query_id long, q array<double>"), spark.createDataFrame(v, "vec_id long, embedding array<double>"), 3, 0.9, 7, 11).collect()
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    want = set()
    for i, _ in q:
        s = np.round(unit @ unit[i], 6)
        order = sorted(range(len(v)), key=lambda j: (-s[j], j))
        want |= {(i, j, r) for r, j in enumerate(order, 1) if r <= 3 or s[j] > 0.9}
    assert {(r["query_id"], r["vec_id"], r["rank"]) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("k", [1, 3, 50])
def test_first_of_equal_ones(k):
    from sceneloom.plans import evaluate as E

    s = np.random.default_rng(k).integers(0, 4, (20, 40)) / 4.0
    want = np.zeros(s.shape, bool)
    for i, row in enumerate(s):
        want[i, sorted(range(40), key=lambda j: (-row[j], j))[:k]] = True
    assert (E.first_of(s, k) == want).all()


def test_sparse_fold_is_the_fold_of_every_frame(spark):
    """Long runs of frames without a child's evidence: as by going through each frame, with far fewer runs than frames."""
    rng = random.Random(5)
    rows = [(f, "other", "P", 0.5) for f in range(400)] + [(f, c, rng.choice(["A", "B", "C"]), rng.uniform(0.02, 0.98)) for c in ("x", "y") for f in rng.sample(range(400), 5)] + [(7, "z", "A", None)]
    df = spark.createDataFrame(rows, "frame_idx long, child_node_id string, parent_node_id string, s2d_score double").repartition(3)
    want = {}
    for c in ("x", "y", "other"):
        odds, p = {T.NULL_PARENT: 0.0}, {}
        for f in range(400):
            for _, _, parent, s in (r for r in rows if r[0] == f and r[1] == c):
                odds[parent] = odds.get(parent, 0.0) + np.log(s / (1 - s))
            if len(odds) == 1:
                continue
            before = {k: p.get(k, 1.0 / len(odds)) for k in odds}
            total = sum(before.values())
            e = {k: np.exp((odds[k] + 0.05 * np.log(max(before[k] / total, 1e-9))) / 0.15) for k in odds}
            p = {k: v / sum(e.values()) for k, v in e.items()}
            want[c, f] = p
    got = {(r["child_node_id"], r["frame_idx"]): dict(zip(r["parents"], r["p"])) for r in T.posteriors(df).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k][n] - v) < 1e-9 for k, w in want.items() for n, v in w.items())
    runs = T.segments(df, T.calendar(df))
    assert runs.where("child_node_id <> 'other'").count() < 0.6 * sum(c != "other" for c, _ in want)
    assert [tuple(r) for r in T.calendar(df).orderBy("t").collect()] == [(f, f + 1) for f in range(400)]


def test_merged_priors_keep_what_says_most(spark):
    kind = "n long, object string, carriers array<struct<carrier:string,oc_relation:string,units:array<struct<unit:string,cu_relation:string>>>>"
    rows = [
        (1, "desk", [("drawer", "part of", [("knob", "pull"), ("knob", " ")]), ("", "x", [("a", "b")])]),
        (2, "desk", [("drawer", "hold", [("knob", "turn"), ("lock", None)]), ("drawer", "", [("knob", "part of")])]),
        (3, "desk", [("drawer", "open", [("lock", "part of")]), ("lid", None, [])]),
        (4, " ", [("drawer", "open", [("lock", "x")])]),
    ]
    got = {tuple(r) for r in A.merged_priors(spark.createDataFrame(rows, kind), "n").collect()}
    assert got == {("desk", "drawer", "knob", "hold", "pull"), ("desk", "drawer", "lock", "hold", "part of")}


def test_retirement_meets_things_of_all_sizes(spark):
    """Pairs by classes of size are all pairs within the larger one's gate: tiny, middling and very large things."""
    rng = np.random.default_rng(4)
    points, at = [], {}
    for i in range(40):
        size, role = float(rng.choice([0.01, 0.1, 0.5, 6.0])), "CU"[i % 2]
        place = rng.uniform(0, 0.4, 3)
        cloud = place + rng.uniform(-size / 2, size / 2, (30, 3))
        at[f"{role}{i}"] = (role, cloud)
        points += [(f"{role}{i}", role, j, *map(float, p)) for j, p in enumerate(cloud)]
    got = {r["carrier"]: (r["unit"], round(r["mutual"], 6)) for r in J.retired(spark.createDataFrame(points, "id string, role string, pid long, x double, y double, z double"), near=0.3, both=0.05, one=0.05).collect()}
    want = {}
    for c, (role, a) in at.items():
        found = []
        for u, (other, b) in at.items():
            if role != "C" or other != "U":
                continue
            size = lambda p: float(np.linalg.norm(p.max(axis=0) - p.min(axis=0)))
            apart = float(np.linalg.norm(a.mean(axis=0) - b.mean(axis=0)))
            near = (((a[:, None] - b[None]) ** 2).sum(axis=2) <= 0.09)
            one, two = near.any(axis=1).mean(), near.any(axis=0).mean()
            if apart <= max(0.03, 0.35 * max(size(a), size(b))) and min(one, two) >= 0.05:
                found.append((-round(min(one, two), 6), -round(max(one, two), 6), round(apart, 6), u))
        if found:
            want[c] = (min(found)[3], -min(found)[0])
    assert got == want and len(want) > 10
