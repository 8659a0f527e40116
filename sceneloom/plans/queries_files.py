"""Queries: what the file readers and writers give back, over files that are written into the shared folder first."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import schema as C
from ..fixtures import scene, with_sql
from ..operators import artifacts as A
from ..registry import query
from ..shared import drop_at_exit, shared_dir
from ..sources import files as S


def _path(spark, name: str) -> str:
    """A new path in the shared folder; it goes when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/sceneloom-{name}-{uuid.uuid4().hex}"
    drop_at_exit(spark, path)
    return path


def _text(lines, path: str, one: bool = False) -> str:
    """Lines (value, and k, their order, for files in which it counts) as text; those are lists of an image set's size."""
    (lines.coalesce(1).sortWithinPartitions("k") if one else lines).select("value").write.text(path)
    return path


@query(
    "camera_files",
    """WITH c AS (SELECT p_partkey AS id, p_partkey % 3 AS m, 600 + p_size AS w, 400 + p_size AS h, p_retailprice AS f FROM part),
    k AS (SELECT id, w, h, f AS fx, CASE m WHEN 1 THEN f + 1 ELSE f END AS fy, CASE m WHEN 1 THEN f + 2 ELSE f + 1 END AS cx, CASE m WHEN 1 THEN f + 3 ELSE f + 2 END AS cy FROM c)
    SELECT id::INT AS camera_id, round(fx * 320 / w, 6) AS fx, round(fy * 240 / h, 6) AS fy, round(cx * 320 / w, 6) AS cx, round(cy * 240 / h, 6) AS cy FROM k""",
)
def camera_files(spark, sf_dir):
    """Cameras of a text export of three models, rescaled to another image size."""
    p = scene(spark, sf_dir, "part")
    f, m = F.col("p_retailprice"), F.col("p_partkey") % 3
    params = F.when(m == 1, F.concat_ws(" ", f, f + 1, f + 2, f + 3)).when(m == 0, F.concat_ws(" ", f, f + 1, f + 2)).otherwise(F.concat_ws(" ", f, f + 1, f + 2, F.lit("0.1")))
    model = F.when(m == 1, "PINHOLE").when(m == 0, "SIMPLE_PINHOLE").otherwise("SIMPLE_RADIAL")
    lines = p.select(F.concat_ws(" ", "p_partkey", model, F.col("p_size") + 600, F.col("p_size") + 400, params).alias("value")).unionByName(spark.createDataFrame([("# cameras",), ("",)], "value string"))
    c = S.rescaled(S.cameras(spark, _text(lines, _path(spark, "cameras"))), 320, 240)
    return c.select("camera_id", *[F.round(x, 6).alias(x) for x in ("fx", "fy", "cx", "cy")])


@query("pose_files", "SELECT c_custkey::INT AS image_id, c_nationkey::INT AS camera_id, round(c_acctbal / 100, 6) AS tx, 'img' || c_custkey AS stem FROM customer")
def pose_files(spark, sf_dir):
    """Poses of a text export, in which a line of points follows each image's."""
    c = scene(spark, sf_dir, "customer")
    image = F.concat_ws(" ", "c_custkey", F.lit("1 0 0 0"), F.col("c_acctbal") / 100, F.lit("0 0"), "c_nationkey", F.concat(F.lit("img"), "c_custkey", F.lit(".png")))
    lines = c.select((F.col("c_custkey") * 2).alias("k"), image.alias("value")).unionByName(c.select((F.col("c_custkey") * 2 + 1).alias("k"), F.when(F.col("c_custkey") % 3 == 0, "").otherwise("10 20 -1").alias("value")))
    head = spark.createDataFrame([(-1, "# images")], "k long, value string")
    p = S.poses(spark, _text(lines.unionByName(head), _path(spark, "images"), one=True))
    return p.select("image_id", "camera_id", F.round("tx", 6).alias("tx"), "stem")


@query("trajectory_files", with_sql("pose_track") + "z AS (SELECT 1) SELECT t_us // 1000 AS t_ms, round(rz, 6) AS rz, round(tx, 6) AS tx FROM pose_track")
def trajectory_files(spark, sf_dir):
    """A trajectory of rotation vectors and translations."""
    p = scene(spark, sf_dir, "pose_track").select(F.concat_ws(" ", F.floor(F.col("t_us") / 1000), F.lit("0 0"), "rz", "tx", "ty", F.lit("0")).alias("value"))
    t = S.trajectory(spark, _text(p, _path(spark, "trajectory")))
    return t.select(F.col("t").cast("long").alias("t_ms"), F.round("rz", 6).alias("rz"), F.round("tx", 6).alias("tx"))


@query("json_line_files", with_sql("edge_candidates") + "z AS (SELECT 1) SELECT evidence_id, edge_type, s2d_score FROM edge_candidates")
def json_line_files(spark, sf_dir):
    """Candidates appended to JSON Lines in two writes, and read back by schema."""
    e, path = scene(spark, sf_dir, "edge_candidates").select("evidence_id", "edge_type", "s2d_score"), _path(spark, "lines")
    for half in (0, 1):
        A.write_rows(e.where(F.col("evidence_id") % 20000 < 10000 if half else F.col("evidence_id") % 20000 >= 10000), path, mode="append", fmt="json")
    return S.json_lines(spark, path, "evidence_id long, edge_type string, s2d_score double")


@query("split_files", "SELECT 'scene/' || s_suppkey AS entry FROM supplier WHERE s_suppkey % 4 <> 1")
def split_files(spark, sf_dir):
    """Entries of a split list with comments and blank lines."""
    s = scene(spark, sf_dir, "supplier")
    line = F.when(F.col("s_suppkey") % 4 == 1, F.when(F.col("s_suppkey") % 8 == 1, "").otherwise(F.concat(F.lit("# scene/"), "s_suppkey"))).when(F.col("s_suppkey") % 4 == 2, F.concat(F.lit("  scene/"), "s_suppkey", F.lit(" # held out"))).otherwise(F.concat(F.lit("scene/"), "s_suppkey"))
    return S.split_list(spark, _text(s.select(line.alias("value")), _path(spark, "split")))


@query("ply_files", with_sql("points") + "z AS (SELECT 1) SELECT round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, count(*) AS n, sum(hue)::BIGINT AS r FROM points GROUP BY 1, 2, 3")
def ply_files(spark, sf_dir):
    """Points written as a PLY and read back."""
    p = scene(spark, sf_dir, "points").select("pid", "x", "y", "z", F.col("hue").cast("int").alias("r"), F.col("sat").cast("int").alias("g"), F.col("val").cast("int").alias("b"))
    path = _path(spark, "ply")
    S.write_ply(p, path, ["pid"])
    return S.ply(spark, path).groupBy(*[F.round(c, 6).alias(c) for c in "xyz"]).agg(F.count("*").alias("n"), F.sum("r").alias("r"))


@query("association_files", with_sql("detections") + "z AS (SELECT 1) SELECT 'f' || frame_idx AS frame_key, det_id, role || label AS node_id FROM detections")
def association_files(spark, sf_dir):
    """Maps from detections to nodes, a JSON object a frame, and the rows that they hold."""
    d = scene(spark, sf_dir, "detections").groupBy(F.concat(F.lit("f"), "frame_idx").alias("frame_key"))
    maps = d.agg(F.map_from_entries(F.collect_list(F.struct(F.col("det_id").cast("string"), F.concat("role", "label")))).alias("det_to_node"))
    path = _path(spark, "associations")
    A.write_rows(maps, path, fmt="json")
    return A.associations(S.json_lines(spark, path, "frame_key string, det_to_node map<string,string>"))


@query("frame_artifacts", with_sql("detections") + "z AS (SELECT 1) SELECT frame_idx, det_id, x1::DOUBLE AS x1, y2::DOUBLE AS y2 FROM detections")
def frame_artifacts(spark, sf_dir):
    """Detections written a partition a role by an older schema, read and brought to the newest one."""
    d, path = scene(spark, sf_dir, "detections"), _path(spark, "frames")
    box = F.array(*[F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2")])
    A.write_rows(d.select("frame_idx", "det_id", "role", F.lit(1).alias("schema_version"), box.alias("box_xyxy")), path, "role")
    m = C.migrated(spark.read.parquet(path))
    return m.select("frame_idx", "det_id", F.get("box", F.lit(0)).alias("x1"), F.get("box", F.lit(3)).alias("y2"))


@query("observation_files", with_sql("observations") + "z AS (SELECT 1) SELECT node_id, count(*) AS n, round(sum(quality), 6) AS quality FROM observations GROUP BY node_id")
def observation_files(spark, sf_dir):
    """Observations written by node and read back with the nodes that are asked for only."""
    path = _path(spark, "observations")
    o = scene(spark, sf_dir, "observations")
    A.write_rows(o.select("node_id", "seq", "quality").repartition("node_id"), path, "node_id")
    return spark.read.schema("seq long, quality double, node_id string").parquet(path).groupBy("node_id").agg(F.count("*").alias("n"), F.round(F.sum("quality"), 6).alias("quality"))


@query("checkpoint_files", with_sql("nodes") + "z AS (SELECT 1) SELECT node_id, state, quality_ema FROM nodes")
def checkpoint_files(spark, sf_dir):
    """A state that is resumed only with the fingerprints of its inputs."""
    n, path = scene(spark, sf_dir, "nodes").select("node_id", "state", "quality_ema"), _path(spark, "state")
    prints = {"nodes": A.fingerprint(n)}
    if A.checkpointed(spark, path, prints) is None:
        A.save_checkpoint(n, path, prints)
    return A.checkpointed(spark, path, prints)


@query("resumed_frames", with_sql("detections") + "z AS (SELECT 1) SELECT frame_idx, count(*) AS n FROM detections GROUP BY frame_idx")
def resumed_frames(spark, sf_dir):
    """Two runs of a job over frames: the second works only on what the first has not written."""
    d, path = scene(spark, sf_dir, "detections"), _path(spark, "resumed")
    work = lambda rows: rows.groupBy("frame_idx").agg(F.count("*").alias("n"))
    A.write_rows(work(d.where("frame_idx % 3 = 0")), path, mode="append")
    A.write_rows(work(A.unprocessed(d, spark.read.parquet(path), ["frame_idx"])), path, mode="append")
    return spark.read.parquet(path)


@query("frame_alignment", with_sql("detections") + "f AS (SELECT DISTINCT frame_idx FROM detections) SELECT 'f' || frame_idx AS frame_key FROM f WHERE frame_idx % 7 = 3 OR frame_idx % 11 = 5 OR frame_idx % 13 = 6")
def frame_alignment(spark, sf_dir):
    """Frames whose image, depth and masks differ in size."""
    f = scene(spark, sf_dir, "detections").select("frame_idx").distinct()
    size = lambda d, w: d.select(F.concat(F.lit("f"), "frame_idx").alias("frame_key"), w.cast("int").alias("width"), F.lit(480).alias("height"))
    odd = lambda k, r: F.when(F.col("frame_idx") % k == r, 320).otherwise(640)
    return A.aligned(size(f, F.lit(640)), size(f.where("frame_idx % 13 <> 6"), odd(7, 3)), size(f.where("frame_idx % 2 = 0 or frame_idx % 11 = 5"), odd(11, 5)))


@query("folder_frames", "SELECT 'rgb' || n_nationkey AS stem, row_number() OVER (ORDER BY n_nationkey) - 1 AS source_index FROM nation QUALIFY source_index % 2 = 1")
def folder_frames(spark, sf_dir):
    """Every second image of a folder from the second on, in the order of the numbers in their names."""
    folder = _path(spark, "rgb")
    for r in scene(spark, sf_dir, "nation").select("n_nationkey").collect():  # a fixed table of 25 rows
        S.put(spark, f"{folder}/rgb{r[0]}.png", b"\\x89PNG")
    S.put(spark, f"{folder}/notes.txt", b"no image")
    return S.create_sequence(spark, "rgb_folder", folder=folder, start=1, stride=2).select("stem", F.col("source_index").cast("long").alias("source_index"))
