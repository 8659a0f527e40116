"""Run artifacts: frames and associations read, evidence gathered, scores cached, results written."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import labels as L
from .aggregates import unanimous_text


def unique_frames(frames: DataFrame, key: str = "frame_key") -> DataFrame:
    """The frames; a repeated key is an error when they are read."""
    n = F.count("*").over(Window.partitionBy(key))
    ok = F.when(n == 1, F.col(key)).otherwise(F.raise_error(F.concat(F.lit("repeated frame key "), F.col(key))).cast("string"))
    return frames.withColumn(key, ok)


def aligned(rgb: DataFrame, depth: DataFrame, masks: DataFrame) -> DataFrame:
    """Frames whose image, depth and mask sizes differ: (frame_key, width, height) each."""
    j = rgb.join(depth.withColumnsRenamed({"width": "dw", "height": "dh"}), "frame_key", "left").join(masks.withColumnsRenamed({"width": "mw", "height": "mh"}), "frame_key", "left")
    return j.where("not (width <=> dw and height <=> dh and (mw is null or (width = mw and height = mh)))").select("frame_key")


def associations(rows: DataFrame) -> DataFrame:
    """rows (frame_key, det_to_node map<string,string>): frame_key, det_id, node_id."""
    return rows.select("frame_key", F.explode("det_to_node")).select("frame_key", F.col("key").cast("long").alias("det_id"), F.col("value").alias("node_id"))


def truth(annotations: DataFrame, relations: DataFrame, scenes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Annotations of the scenes, and relations both of whose endpoints are among them."""
    a = annotations.join(scenes, "scene_id", "left_semi")
    known = a.select("scene_id", F.col("annot_id").alias("first")).distinct()
    r = relations.join(known, ["scene_id", "first"], "left_semi").join(known.withColumnRenamed("first", "second"), ["scene_id", "second"], "left_semi")
    return a, r


def snapshot(annotations: DataFrame, relations: DataFrame, order: str, first: int) -> DataFrame:
    """The first rows of an annotation table; rows after them must touch no relation, else reading is an error."""
    n = annotations.withColumn("_n", F.row_number().over(Window.orderBy(order)))
    ends = relations.select(F.col("first").alias("annot_id")).union(relations.select("second")).distinct()
    bad = n.where(F.col("_n") > first).join(ends, "annot_id", "left_semi").limit(1).count()
    if bad:
        raise ValueError("an annotation after the snapshot is an end of a relation")
    return n.where(F.col("_n") <= first).drop("_n")


def instance_boxes(annotations: DataFrame, points: DataFrame) -> DataFrame:
    """annotations (annot_id, indices), points (idx, x, y, z): the box of each annotation's points."""
    j = annotations.select("annot_id", F.explode("indices").alias("idx")).join(points, "idx")
    return j.groupBy("annot_id").agg(F.count("*").alias("n"), *[f(c).alias(f"{c}{i}") for c in "xyz" for i, f in ((1, F.min), (2, F.max))])


def remote_evidence(observed: DataFrame, nodes: DataFrame) -> DataFrame:
    """observed (frame_key, from_det, to_det, score), nodes (frame_key, det_id, node_id): count, sum and distinct frames of
    each (source, target)."""
    a = nodes.select("frame_key", F.col("det_id").alias("from_det"), F.col("node_id").alias("source"))
    b = nodes.select("frame_key", F.col("det_id").alias("to_det"), F.col("node_id").alias("target"))
    j = observed.join(a, ["frame_key", "from_det"]).join(b, ["frame_key", "to_det"]).where("source <> target")
    return j.groupBy("source", "target").agg(F.count("*").alias("count"), F.round(F.sum("score"), 6).alias("evidence"), F.count_distinct("frame_key").alias("frames"))


def directed(pairs: DataFrame, sources: list[str]) -> DataFrame:
    """pairs (from_label, to_label, relation): swapped if only the target looks like a source of control; pairs of two sources,
    of equal or of empty labels go."""
    looks = lambda c: L.prior_label(c).rlike("|".join(sources))
    a, b = L.prior_label(F.col("from_label")), L.prior_label(F.col("to_label"))
    swap = ~looks(F.col("from_label")) & looks(F.col("to_label"))
    out = pairs.where((a != "") & (b != "") & (a != b) & ~(looks(F.col("from_label")) & looks(F.col("to_label"))))
    return out.select(F.when(swap, b).otherwise(a).alias("from_label"), F.when(swap, a).otherwise(b).alias("to_label"), F.trim("relation").alias("relation"))


def candidate_hash(*parts: Column) -> Column:
    """SHA-256 of compact JSON of a candidate's key."""
    return F.sha2(F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]")), 256)


def quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), c, F.lit('"'))


def scored(candidates: DataFrame, cache: DataFrame, key: str = "cache_key") -> DataFrame:
    """Cached scores; without one the prefilter's reason, or a miss. No score is made up."""
    c = cache.where("s2d_score is not null").select(F.col(key).alias("_k"), F.col("s2d_score").alias("_s")).dropDuplicates(["_k"])
    j = candidates.join(c, F.col(key) == F.col("_k"), "left")
    error = F.when(F.col("_s").isNotNull(), "").when(F.col("fail_reason") != "", F.col("fail_reason")).otherwise("cache_miss")
    return j.withColumns({"s2d_score": F.col("_s"), "available": F.col("_s").isNotNull(), "error": error}).drop("_k", "_s")


def mock_features(label: Column, dim: int = 8) -> Column:
    """A deterministic stand-in for a text encoder: a vector from the label's letters, of length 1."""
    from ..functions.vectors import unit

    t = L.track_label(label)
    seed = F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(t))), lambda i: i * F.ascii(F.substr(t, i, F.lit(1)))), F.lit(0).cast("long"), lambda a, x: a + x)
    # the seed is computed once a label, not once a component
    return F.get(F.transform(F.array(seed), lambda s: unit(F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: ((s + 37 * i) % 101) / 100.0))), F.lit(0))


def predicate_text(evidence: DataFrame, by: list[str], prior: Column) -> DataFrame:
    """The relation text of an edge and where it is from: its instances, else its pair's history, else the prior.

    evidence: by, instance_text and history_text (nullable), and what ``prior`` reads.
    """
    g = evidence.groupBy(*by).agg(F.count_if(F.trim("instance_text") != "").alias("n"), F.count_if(F.trim("history_text") != "").alias("m"), unanimous_text(F.coalesce("instance_text", F.lit(""))).alias("own"), unanimous_text(F.coalesce("history_text", F.lit(""))).alias("past"), F.max(prior).alias("prior"))
    text = F.when(F.col("n") > 0, F.col("own")).when(F.col("m") > 0, F.col("past")).otherwise(F.coalesce("prior", F.lit("")))
    told = text != ""
    source = F.when(F.col("n") > 0, F.when(told, "instance").otherwise("instance_conflict")).when(F.col("m") > 0, F.when(told, "pair_history").otherwise("pair_history_conflict")).otherwise(F.when(told, "contextual_semantics").otherwise("unresolved"))
    return g.select(*by, text.alias("relation_text"), source.alias("predicate_source"))


def shell(nodes: DataFrame, n: int = 24, radius: float = 0.02) -> DataFrame:
    """Points of a ball about each node for a drawing: a Fibonacci lattice. Nodes are dealt out first: their table is small and
    read by few tasks, their points are many."""
    i = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i")
    z = 1 - 2 * (F.col("i") + 0.5) / n
    turn = F.col("i") * 2.399963229728653  # the golden angle
    r = F.sqrt(1 - z * z)
    return nodes.select("node_id", "cx", "cy", "cz").repartition("node_id").select("*", i).select("node_id", "i", (F.col("cx") + radius * r * F.cos(turn)).alias("x"), (F.col("cy") + radius * r * F.sin(turn)).alias("y"), (F.col("cz") + radius * z).alias("z"))


def tube(edges: DataFrame, n: int = 16) -> DataFrame:
    """Points along each edge (a*, b* endpoints)."""
    t = F.col("i") / F.lit(float(n - 1))
    return edges.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select("edge_id", "i", *[(F.col(f"a{c}") + (F.col(f"b{c}") - F.col(f"a{c}")) * t).alias(c) for c in "xyz"])


def write_rows(df: DataFrame, path: str, partition: str | None = None, mode: str = "error", fmt: str = "parquet") -> None:
    """Rows under Spark's commit protocol: a reader sees a whole write or none."""
    w = df.write.mode(mode).format(fmt)
    (w.partitionBy(partition) if partition else w).save(path)


def unprocessed(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys a former run has not written, so that a run goes on where it was stopped."""
    return rows.join(done.select(*keys).distinct(), keys, "left_anti")


def fingerprint(df: DataFrame) -> str:
    """A digest of a table's rows that does not depend on their order."""
    row = F.xxhash64(*df.columns)
    r = df.agg(F.count("*").alias("n"), F.sum(row.cast("decimal(38,0)")).alias("s"), F.bit_xor(row).alias("x")).first()
    return f"{r['n']}-{r['s']}-{r['x']}"


def _files(spark: SparkSession, path: str):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, conf, at, at.getFileSystem(conf)


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small document so that a reader sees the former one or this one, whole: beside it, then moved over it."""
    jvm, conf, at, fs = _files(spark, path)
    beside = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(beside)
    out.write(bytearray(text.encode()))
    out.close()
    over = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(over, 1)
    how[0] = over.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(beside), fs.makeQualified(at), how)


def get_text(spark: SparkSession, path: str) -> str | None:
    """A small document, or None where there is none."""
    jvm, _, at, fs = _files(spark, path)
    if not fs.exists(at):
        return None
    into = fs.open(at)
    try:
        return bytes(into.readAllBytes()).decode()
    finally:
        into.close()


def checkpointed(spark: SparkSession, path: str, prints: dict[str, str], table: str = "state") -> DataFrame | None:
    """A table of the state saved last at a path if its fingerprints are these; None without a state; others are an error."""
    text = get_text(spark, f"{path}/manifest.json")
    if text is None:
        return None
    found = json.loads(text)
    if found["prints"] != prints:
        raise ValueError(f"the checkpoint at {path} is of other inputs: {sorted(k for k in {*found['prints'], *prints} if found['prints'].get(k) != prints.get(k))}")
    return spark.read.parquet(f"{path}/{found['version']}/{table}")


def save_checkpoint(state: DataFrame | dict[str, DataFrame], path: str, prints: dict[str, str]) -> None:
    """One or more tables as a new version of the state: each in a folder of the version, and the manifest that names it last,
    so that a write that is cut off leaves the version before. Of former versions the last stays."""
    tables = state if isinstance(state, dict) else {"state": state}
    spark = next(iter(tables.values())).sparkSession
    before = get_text(spark, f"{path}/manifest.json")
    last = json.loads(before)["version"] if before else None
    version = f"v-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{path}/{version}/{name}")
    put_text(spark, f"{path}/manifest.json", json.dumps({"version": version, "prints": prints, "tables": sorted(tables)}, sort_keys=True))
    jvm, _, at, fs = _files(spark, path)
    for found in fs.listStatus(at):
        name = found.getPath().getName()
        if name.startswith("v-") and name not in (version, last):
            fs.delete(found.getPath(), True)
