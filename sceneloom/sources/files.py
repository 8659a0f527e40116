"""Readers and writers of the file formats of posed RGB-D sequences, as DataFrames."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The camera models of a COLMAP text export and the number of parameters of each.
CAMERA_MODELS = {"SIMPLE_PINHOLE": 3, "PINHOLE": 4, "SIMPLE_RADIAL": 4, "RADIAL": 5, "OPENCV": 8, "OPENCV_FISHEYE": 8, "FULL_OPENCV": 12, "FOV": 5, "SIMPLE_RADIAL_FISHEYE": 4, "RADIAL_FISHEYE": 5, "THIN_PRISM_FISHEYE": 12}


def natural_key(name: Column, width: int = 20) -> Column:
    """A name with every run of digits padded, so that it sorts by number."""
    parts = F.regexp_extract_all(name, F.lit("([0-9]+|[^0-9]+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.lpad(p, width, "0")).otherwise(F.lower(p))), "")


def sliced(df: DataFrame, key: Column, start: int = 0, end: int | None = None, stride: int = 1) -> DataFrame:
    """Rows start:end:stride in the order of a key, with their place in the whole order as source_index."""
    i = F.row_number().over(Window.orderBy(key)) - 1
    out = df.withColumn("source_index", i).where((F.col("source_index") >= start) & ((F.col("source_index") - start) % stride == 0))
    return out if end is None else out.where(F.col("source_index") < end)


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, "([^/]+)$", 1), "\\.[^.]*$", "")


def image_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, stem, length of the files in a folder; contents are not read until they are asked for."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", stem(F.col("path")).alias("stem"), "length", "content")


def rgb_folder(spark: SparkSession, folder: str, start: int = 0, end: int | None = None, stride: int = 1) -> DataFrame:
    f = image_files(spark, folder).drop("content").where(F.lower("path").rlike("\\.(jpg|jpeg|png)$"))
    return sliced(f, natural_key(F.col("stem")), start, end, stride)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """value and its place ``at``: files by name, in a file by its splits, in a split by line. Spark reads splits in any order
    and numbers lines with gaps between its tasks, so places only compare; ``numbered`` counts them."""
    return spark.read.text(path).select("value", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line")).alias("at"))


def numbered(rows: DataFrame) -> DataFrame:
    """Rows of ``_lines`` with ``i``, their number from 0 without gaps: splits are counted, then each counts on from those before."""
    split = rows.select("at").groupBy("at.file", "at.split").agg(F.min("at.line").alias("_first"), F.count("*").alias("_n"))
    before = split.select("file", "split", "_first", (F.sum("_n").over(Window.orderBy("file", "split")) - F.col("_n")).alias("_before"))  # a row a split
    j = rows.join(F.broadcast(before), (F.col("at.file") == F.col("file")) & (F.col("at.split") == F.col("split")))
    return j.withColumn("i", F.col("_before") + F.col("at.line") - F.col("_first")).select("value", "at", "i")


def cameras(spark: SparkSession, path: str) -> DataFrame:
    """camera_id, model, width, height, params, fx, fy, cx, cy of a cameras.txt; an unknown model is an error."""
    t = F.split(F.trim("value"), "\\s+")
    rows = _lines(spark, path).where("trim(value) <> '' and not value like '#%'").select(t.alias("t"))
    known = F.col("t")[1].isin(*CAMERA_MODELS)
    params = F.transform(F.slice("t", 5, 100), lambda x: x.cast("double"))
    model = F.when(known, F.col("t")[1]).otherwise(F.raise_error(F.concat(F.lit("unknown camera model "), F.col("t")[1])).cast("string"))
    c = rows.select(F.col("t")[0].cast("int").alias("camera_id"), model.alias("model"), F.col("t")[2].cast("int").alias("width"), F.col("t")[3].cast("int").alias("height"), params.alias("params"))
    one = F.col("model").isin("SIMPLE_PINHOLE", "SIMPLE_RADIAL", "RADIAL", "SIMPLE_RADIAL_FISHEYE", "RADIAL_FISHEYE")
    p = F.col("params")
    return c.withColumns({"fx": p[0], "fy": F.when(one, p[0]).otherwise(p[1]), "cx": F.when(one, p[1]).otherwise(p[2]), "cy": F.when(one, p[2]).otherwise(p[3])})


def poses(spark: SparkSession, path: str) -> DataFrame:
    """image_id, quaternion, translation, camera_id, name of an images.txt; the line after each image is skipped."""
    rows = _lines(spark, path).where("not value like '#%'").withColumn("i", F.row_number().over(Window.orderBy("at")) - 1).where("i % 2 = 0 and trim(value) <> ''")
    t = F.split(F.trim("value"), "\\s+")
    names = ["image_id", "qw", "qx", "qy", "qz", "tx", "ty", "tz", "camera_id", "name"]
    kinds = ["int", *["double"] * 7, "int", "string"]
    return rows.select(*[t[i].cast(k).alias(n) for i, (n, k) in enumerate(zip(names, kinds, strict=True))]).withColumn("stem", stem(F.col("name")))


def trajectory(spark: SparkSession, path: str) -> DataFrame:
    """t, rotation vector and translation of a .traj file."""
    v = F.split(F.trim("value"), "\\s+")
    return spark.read.text(path).where("trim(value) <> ''").select(*[v[i].cast("double").alias(n) for i, n in enumerate(("t", "rx", "ry", "rz", "tx", "ty", "tz"))])


def rescaled(cams: DataFrame, width: int, height: int) -> DataFrame:
    """Intrinsics for images of another size."""
    kx, ky = F.lit(float(width)) / F.col("width"), F.lit(float(height)) / F.col("height")
    return cams.withColumns({"fx": F.col("fx") * kx, "cx": F.col("cx") * kx, "fy": F.col("fy") * ky, "cy": F.col("cy") * ky, "width": F.lit(width), "height": F.lit(height)})


def posed_frames(rgb: DataFrame, depth: DataFrame, pose: DataFrame, start: int = 0, end: int | None = None, stride: int = 1) -> DataFrame:
    """Frames that have an image, a depth map and a pose of one stem, in natural order."""
    j = rgb.select("stem", F.col("path").alias("rgb_path")).join(depth.select("stem", F.col("path").alias("depth_path")), "stem").join(pose, "stem")
    return sliced(j, natural_key(F.col("stem")), start, end, stride).withColumnRenamed("stem", "frame_key")


def colmap_frames(spark: SparkSession, root: str, start: int = 0, end: int | None = None, stride: int = 1) -> DataFrame:
    """Frames of a folder with rgb, depth and images.txt."""
    return posed_frames(image_files(spark, f"{root}/rgb"), image_files(spark, f"{root}/depth"), poses(spark, f"{root}/images.txt"), start, end, stride)


#: What ``create_sequence`` knows, by name.
SEQUENCES = {"rgb_folder": rgb_folder, "colmap": colmap_frames}


def create_sequence(spark: SparkSession, dataset: str, **kwargs) -> DataFrame:
    """The frames of a sequence by the name of its kind; an unknown name is an error."""
    name = dataset.lower()
    if name not in SEQUENCES:
        raise ValueError(f"unknown kind of sequence {dataset!r}; known are {', '.join(sorted(SEQUENCES))}")
    return SEQUENCES[name](spark, **kwargs)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON Lines file; blank lines are skipped, a missing file is empty."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def split_list(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a split file without comments; an empty one is an error."""
    s = spark.read.text(path).select(F.trim(F.regexp_replace("value", "#.*$", "")).alias("entry")).where("entry <> ''")
    if s.isEmpty():
        raise ValueError(f"{path}: no entries")
    return s


def put(spark: SparkSession, path: str, content: bytes) -> None:
    """A small file, through the file system of its path."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(content))
    out.close()


#: A PLY's number types as numpy names them.
PLY_TYPES = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}


def ply_binary(spark: SparkSession, path: str) -> DataFrame:
    """x, y, z, r, g, b of the vertices of binary PLY files; a missing colour is 180, rows that are not finite go."""

    def vertices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                head, _, body = content.as_py().partition(b"end_header\n")
                lines = [x.split() for x in head.decode("ascii").splitlines()]
                if ["format", "binary_little_endian", "1.0"] not in lines and ["format", "binary_big_endian", "1.0"] not in lines:
                    raise ValueError("no binary PLY")
                order = "<" if ["format", "binary_little_endian", "1.0"] in lines else ">"
                first = next(i for i, x in enumerate(lines) if x[:2] == ["element", "vertex"])
                fields = []
                for x in lines[first + 1 :]:
                    if x[0] == "element":
                        break
                    if x[0] == "property":
                        fields.append((x[2], order + PLY_TYPES[x[1]]))
                v = np.frombuffer(body, np.dtype(fields), int(lines[first][2]))
                keep = np.isfinite(v["x"]) & np.isfinite(v["y"]) & np.isfinite(v["z"])
                colour = [v[c][keep].astype(np.int32) if c in v.dtype.names else np.full(int(keep.sum()), 180, np.int32) for c in ("red", "green", "blue")]
                for at in range(0, max(1, int(keep.sum())), 100_000):
                    yield pa.RecordBatch.from_arrays([*(pa.array(v[c][keep][at : at + 100_000].astype(np.float64)) for c in "xyz"), *(pa.array(c[at : at + 100_000]) for c in colour)], list("xyzrgb"))

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(vertices, "x double, y double, z double, r int, g int, b int")


def ply(spark: SparkSession, path: str) -> DataFrame:
    """x, y, z, r, g, b of an ASCII PLY's vertices; a missing colour is 180, rows that are not finite go."""
    v = F.split(F.trim("value"), "\\s+")
    rows = numbered(_lines(spark, path))
    end = rows.where("trim(value) = 'end_header'").agg(F.min("i")).first()[0]
    count = rows.where((F.col("i") < end) & F.col("value").like("element vertex%")).select(F.element_at(F.split("value", " "), -1).cast("long")).first()[0]
    inside = (F.col("i") > end) & (F.col("i") <= end + count)
    v = F.when(inside, v)  # so that no other line is cast, wherever Spark puts the filters
    p = rows.where(inside).select(*[F.get(v, F.lit(i)).cast("double").alias(c) for i, c in enumerate("xyz")], *[F.coalesce(F.get(v, F.lit(i + 3)).cast("int"), F.lit(180)).alias(c) for i, c in enumerate("rgb")])
    return p.where(" and ".join(f"not isnan({c}) and abs({c}) < double('infinity')" for c in "xyz"))


def write_ply(points: DataFrame, path: str, order: list[str]) -> None:
    """An ASCII PLY of x, y, z, r, g, b in the order of columns, as text files in a folder: one after another by name they are
    the PLY, the first begins with its head. Each range of the order is written by a task of its own."""
    n = points.count()
    head = ["ply", "format ascii 1.0", f"element vertex {n}", *[f"property float {c}" for c in "xyz"], *[f"property uchar {c}" for c in ("red", "green", "blue")], "end_header"]
    spark = points.sparkSession
    lines = points.select(F.struct(F.lit(1).alias("part"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(order)]).alias("k"), F.concat_ws(" ", *[F.col(c).cast("string") for c in "xyzrgb"]).alias("value"))
    top = spark.createDataFrame([(i, v) for i, v in enumerate(head)], "i int, value string").select(F.struct(F.lit(0).alias("part"), *[F.lit(None).cast(points.schema[c].dataType).alias(f"k{i}") for i, c in enumerate(order)]).alias("k"), "value", "i")
    lines.withColumn("i", F.lit(0)).unionByName(top).orderBy("k.part", "i", *[f"k.k{i}" for i in range(len(order))]).select("value").write.mode("overwrite").text(path)


def config(path: str) -> dict:
    """A YAML file with what it inherits from (``inherit_from`` or ``defaults``) merged under it and ${NAME} expanded."""
    import yaml

    def merged(low: dict, high: dict) -> dict:
        return {**low, **{k: merged(low[k], v) if isinstance(v, dict) and isinstance(low.get(k), dict) else v for k, v in high.items()}}

    def expanded(x):
        if isinstance(x, dict):
            return {k: expanded(v) for k, v in x.items()}
        if isinstance(x, list):
            return [expanded(v) for v in x]
        return re.sub(r"\$\{(\w+)\}", lambda m: os.environ.get(m[1], m[0]), x) if isinstance(x, str) else x

    def loaded(file: Path, seen: tuple[Path, ...]) -> dict:
        if file in seen:
            raise ValueError(f"{file} inherits from itself")
        own = yaml.safe_load(file.read_text()) or {}
        base = own.pop("inherit_from", None) or own.pop("defaults", None) or []
        out: dict = {}
        for b in [base] if isinstance(base, str) else base:
            out = merged(out, loaded((file.parent / b).resolve(), (*seen, file)))
        return merged(out, own)

    return expanded(loaded(Path(path).resolve(), ()))
