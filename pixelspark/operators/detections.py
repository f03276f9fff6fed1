"""Tables of detected tags and of poses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelspark.functions import geometry as g

#: Tag size of each unit, all 6.5 inches.
TAG_SIZES = {"in": 6.5, "m": 0.1651, "cm": 16.51}


def fields(column: str, names: list[str]) -> list:
    """The first elements of an array column under names of their own."""
    return [F.element_at(column, i + 1).alias(n) for i, n in enumerate(names)]


def vector_fields(df: DataFrame, keys: list[str], vec: str | None = None, quat: str | None = None, line: str | None = None, values: str | None = None, text: str | None = None) -> DataFrame:
    """keys, and of each named column its parts: x, y, z of a vector; qx .. qw of a quaternion; x0, y0, x1, y1 of a line; v0 .. v11 of a tuple,
    null beyond its end, and its length; the length of a text in bytes."""
    out = [F.col(k) for k in keys]
    for column, names in ((vec, ["x", "y", "z"]), (quat, ["qx", "qy", "qz", "qw"]), (line, ["x0", "y0", "x1", "y1"])):
        out += fields(column, names) if column else []
    if values:
        out += [*[F.get(values, F.lit(i)).alias(f"v{i}") for i in range(12)], F.size(values).alias("len")]
    if text:
        out.append(F.octet_length(text).alias("text_len"))
    return df.select(*out)


def inner(df: DataFrame, keys: list[str], held: str) -> DataFrame:
    """keys and the fields of the struct that a shared value holds."""
    return df.select(*keys, f"{held}.*")


def detection_fields(dets: DataFrame) -> DataFrame:
    """cx, cy and p0x .. p3y from center (2 doubles) and corners (8 doubles), and h0 .. h8 of a homography (9 doubles) where there is one."""
    if "homography" in dets.columns:
        dets = dets.select("*", *fields("homography", [f"h{i}" for i in range(9)]))
    out = dets.withColumn("cx", F.element_at("center", 1)).withColumn("cy", F.element_at("center", 2))
    for i in range(4):
        out = out.withColumn(f"p{i}x", F.element_at("corners", 2 * i + 1)).withColumn(f"p{i}y", F.element_at("corners", 2 * i + 2))
    return out


def tag_filter(dets: DataFrame, ids: list[int] | None = None, max_hamming: int = 2, families: list[str] | None = None) -> DataFrame:
    if ids is not None:
        dets = dets.where(F.col("id").isin(ids))
    if families is not None:
        dets = dets.where(F.col("family").isin(families))
    return dets.where(F.col("hamming") <= max_hamming)


def found(frames: DataFrame, dets: DataFrame, key: str) -> DataFrame:
    """(key, found): detections of each frame, 0 where there are none."""
    n = dets.groupBy(key).agg(F.count("*").alias("n"))
    return frames.select(key).distinct().join(n, key, "left").select(key, F.coalesce("n", F.lit(0)).cast("bigint").alias("found"))


def pose_parameters(dets: DataFrame, cameras: DataFrame, unit: str = "m") -> DataFrame:
    """dets joined to their camera: centre, focal length tan(fov / 2) * cx with fov in radians (as the pose solver takes it) and tag size.

    The camera table has one row per stream; Spark broadcasts it only while it is small.
    """
    cams = cameras.where("fov is not null").select("stream", (F.col("width") / 2).alias("center_x"), (F.col("height") / 2).alias("center_y"), F.col("fov").alias("fov_radians"))
    return dets.join(cams, "stream").withColumn("focal", F.tan(F.col("fov_radians") / 2) * F.col("center_x")).withColumn("tag_size", F.lit(TAG_SIZES[unit]))


def missing_parameters(streams: DataFrame, cameras: DataFrame) -> DataFrame:
    """Streams without a camera row, or whose camera has no field of view."""
    return streams.select("stream").distinct().join(cameras.where("fov is not null"), "stream", "left_anti")


def match_detections(expected: DataFrame, got: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """(image, id, status): expected and got (image, id, corners) pair up where every coordinate differs by less than tolerance.

    A grid join: the first point's cell, of four times the tolerance's size, is a key; an expected detection is asked for in the cells
    that its tolerance reaches, mostly one or two, at most four. Only whether a partner exists matters, so it is a semi join on distinct detections, and one aggregation of flags gives the
    states. An id of an image that is on both sides without a pair is missed and extra.
    """
    sides = [df.select("image", "id", F.col("corners").cast("array<double>").alias("corners")).distinct() for df in (expected, got)]
    cell = lambda i, shift=0.0: F.coalesce(F.floor((F.get("corners", F.lit(i)) + shift) / (4 * tolerance)), F.lit(0))
    reached = lambda i: F.sequence(cell(i, -tolerance), cell(i, tolerance))
    a = sides[0].withColumn("gx", F.explode(reached(0))).withColumn("gy", F.explode(reached(1))).withColumnRenamed("corners", "a")
    b = sides[1].select("image", "id", F.col("corners").alias("b"), cell(0).alias("gx"), cell(1).alias("gy"))
    near = F.forall(F.zip_with("a", "b", lambda x, y: F.abs(x - y)), lambda d: d < tolerance)
    keys = ["image", "id", "gx", "gy"]
    a, b = a.alias("a"), b.alias("b")
    same = near
    for k in keys:
        same = same & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    paired = a.join(b, same, "left_semi").select("image", "id", F.lit(3).alias("flag"))
    seen = [df.select("image", "id", F.lit(flag).alias("flag")) for df, flag in zip(sides, (1, 2))]
    flags = paired.unionByName(seen[0]).unionByName(seen[1]).groupBy("image", "id").agg(*[F.bool_or(F.col("flag") == k).alias(n) for k, n in ((3, "matched"), (1, "missed"), (2, "extra"))])
    states = F.when(F.col("matched"), F.array(F.lit("matched"))).otherwise(F.array_compact(F.array(F.when(F.col("missed"), "missed"), F.when(F.col("extra"), "extra"))))
    return flags.select("image", "id", F.explode(states).alias("status"))


def pose_features(poses: DataFrame) -> DataFrame:
    """Quaternion, Euler angles, determinant and scale of each pose (pose_id, translation, rotation), and its error where it has one."""
    r = F.col("rotation")
    return poses.select("pose_id", *[c for c in ("error",) if c in poses.columns], g.to_quat(r).alias("quat"), g.to_euler(r).alias("euler"), g.det(r).alias("det"), g.scale(r).alias("scale"), g.length(F.col("translation")).alias("distance"))


def transform_points(points: DataFrame, poses: DataFrame) -> DataFrame:
    """points (pose_id, point) moved by their pose: rotation * point + translation."""
    return points.join(poses, "pose_id").select("pose_id", "point", g.add(g.mul_vec(F.col("rotation"), F.col("point")), F.col("translation")).alias("moved"))


def compose_poses(first: DataFrame, second: DataFrame, on: str) -> DataFrame:
    """Poses of first seen through second, joined on a key: second * first."""
    b = second.select(on, F.col("rotation").alias("r2"), F.col("translation").alias("t2"))
    return first.join(b, on).select(on, g.mul_mat(F.col("r2"), F.col("rotation")).alias("rotation"), g.add(g.mul_vec(F.col("r2"), F.col("translation")), F.col("t2")).alias("translation"))


def invert_poses(poses: DataFrame) -> DataFrame:
    """Inverse rotation and translation; null where the matrix is singular."""
    inv = g.inverse(F.col("rotation"))
    return poses.select("pose_id", inv.alias("rotation"), g.neg(g.mul_vec(inv, F.col("translation"))).alias("translation"))


def order_detections(dets: DataFrame, keys: list[str], place: str = "place") -> DataFrame:
    """Detections numbered from 1 inside keys: by id, then centre, then order of finding."""
    return dets.withColumn(place, F.row_number().over(Window.partitionBy(*keys).orderBy("id", "cx", "cy", "seq")))


def flat_corners(dets: DataFrame, corners: str = "corners") -> DataFrame:
    """points (arrays of x and y) as one list of coordinates; a list of coordinates stays."""
    kind = dets.schema[corners].dataType.elementType.typeName()
    return dets.withColumn(corners, F.flatten(corners)) if kind == "array" else dets
