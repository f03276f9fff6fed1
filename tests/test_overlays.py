"""Lines, boxes and matches against plain loops, at sizes where the plans matter."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelspark.operators import detections as dt
from pixelspark.operators import overlay


def walked(x0, y0, x1, y1):
    """Bresenham's line, step by step, without its last point."""
    dx, dy = abs(x1 - x0), -abs(y1 - y0)
    sx, sy, e, out = (1 if x0 < x1 else -1), (1 if y0 < y1 else -1), dx + dy, []
    while (x0, y0) != (x1, y1):
        out.append((x0, y0))
        right, down = 2 * e >= dy, 2 * e <= dx
        e += dy * right + dx * down
        x0, y0 = x0 + sx * right, y0 + sy * down
    return out


def test_lines_equal_walked_ones(spark):
    rng = np.random.default_rng(1)
    lines = [tuple(map(int, rng.integers(0, 14, 4))) for _ in range(400)] + [(3, 3, 3, 3), (0, 0, 9, 0), (0, 9, 0, 0), (0, 0, 7, 7), (7, 0, 0, 7)]
    frame = spark.createDataFrame([(i, *v) for i, v in enumerate(lines)], "frame_id long, x0 int, y0 int, x1 int, y1 int")
    got = {}
    for r in overlay.rasterize_lines(frame).collect():
        got.setdefault(r["frame_id"], set()).add((r["x"], r["y"]))
    assert got == {i: set(walked(*v)) for i, v in enumerate(lines) if walked(*v)}


@pytest.mark.parametrize("at_once", [1, 1 << 18])
def test_listed_points_are_the_pixels_in_order(spark, at_once, monkeypatch):
    """Every direction, with places off the frame, lines without points and a null end, in slices of any size; no pixel is grouped."""
    monkeypatch.setattr(overlay, "POINTS_AT_ONCE", at_once)
    rng = np.random.default_rng(2)
    lines = [tuple(map(int, rng.integers(-6, 14, 4))) for _ in range(300)] + [(3, 3, 3, 3), (-9, -9, -2, -2), (0, 9, 4, 0), (4, 0, 0, 9), (4, 9, 0, 0), (7, 2, 7, -3)]
    frame = spark.createDataFrame([*((i, *v) for i, v in enumerate(lines)), (-1, 0, 0, None, 5)], "frame_id long, x0 int, y0 int, x1 int, y1 int")
    listed = overlay.point_lists(frame)
    want = {i: sorted(p for p in walked(*v) if min(p) >= 0) for i, v in enumerate(lines)}
    assert {r["frame_id"]: (r["n"], r["points"]) for r in listed.collect()} == {i: (len(p), " ".join(f"{x},{y}" for x, y in p)) for i, p in want.items() if p}
    assert "Exchange" not in listed._jdf.queryExecution().toString()


def test_lists_that_share_text_lie_together(spark, tmp_path):
    """Written files hold shared text once: they are well smaller than those of the same rows in another order."""
    lines = spark.range(60_000, numPartitions=2).selectExpr("id as frame_id", "cast(pmod(xxhash64(id), 50) * 10 as int) as x0", "cast(pmod(xxhash64(id, 1), 900) as int) as y0").selectExpr("*", "cast(x0 + pmod(frame_id, 32) as int) as x1", "y0 + 20 as y1")
    listed = overlay.point_lists(lines)
    mixed = spark.createDataFrame(listed.toPandas().sample(frac=1, random_state=1), listed.schema).coalesce(2)
    size = {}
    for name, df in (("listed", listed), ("mixed", mixed)):
        df.write.option("compression", "snappy").parquet(f"{tmp_path}/{name}")
        size[name] = sum(f.stat().st_size for f in (tmp_path / name).glob("*.parquet"))
    assert size["listed"] < 0.75 * size["mixed"]


def test_long_lines_take_linear_time(spark):
    frame = spark.range(400).select(F.col("id").alias("frame_id"), F.lit(0).alias("x0"), F.lit(0).alias("y0"), F.lit(10_000).alias("x1"), F.lit(3_333).alias("y1"))
    began = time.time()
    assert overlay.rasterize_lines(frame).agg(F.count("*"), F.max("y")).first()[:] == (4_000_000, 3_333)
    assert time.time() - began < 60


def test_points_are_computed_as_rows(spark):
    """No list of points is built inside a row by a lambda, which Spark interprets."""
    plan = overlay.rasterize_lines(spark.range(3).selectExpr("id as frame_id", "0 as x0", "0 as y0", "cast(id as int) as x1", "2 as y1"))._jdf.queryExecution().toString()
    assert "lambda" not in plan and "explode(sequence(" in plan


def painted(canvas, boxes):
    out = canvas.astype(int).copy()
    for _, x0, x1, y0, y1, fill, color in sorted(boxes):
        for y in range(max(y0, 0), min(y1 + 1, out.shape[0])):
            for x in range(max(x0, 0), min(x1, out.shape[1])):
                edge = x in (x0, x1 - 1) or y in (y0, y1)
                out[y, x] = color if edge or fill >= 1 else int(out[y, x] * (1 - fill) + color * fill)
    return out


@pytest.mark.parametrize("n", [0, 1, 200])
def test_boxes_equal_painted_ones(spark, n):
    rng = np.random.default_rng(n)
    canvas = rng.integers(0, 256, (3, 40, 50))
    boxes = [(f, i, *sorted(map(int, rng.choice(np.arange(-3, 56), 2, False))), *sorted(map(int, rng.choice(np.arange(-3, 46), 2, False))), float(rng.choice([0.0, 0.25, 0.5, 1.0])), int(rng.integers(0, 256))) for f in (0, 2) for i in range(n)]
    boxes += [(1, 0, 5, 5, 2, 9, 0.5, 9), (1, 1, 9, 4, 2, 9, 0.5, 9)]  # boxes of no width
    px = spark.createDataFrame([(f, y, x, int(canvas[f, y, x])) for f in range(3) for y in range(40) for x in range(50)], "frame_id long, y int, x int, c0 int").repartition(5)
    frame = spark.createDataFrame([(*b[:-1], [b[-1]]) for b in boxes], "frame_id long, seq int, min_x int, max_x int, min_y int, max_y int, fill double, color array<int>")
    got = np.zeros(canvas.shape, int)
    for r in overlay.draw_boxes(px, frame).collect():
        got[r["frame_id"], r["y"], r["x"]] = r["c0"]
    for f in range(3):
        assert (got[f] == painted(canvas[f], [b[1:] for b in boxes if b[0] == f and b[2] < b[3]])).all()


def test_matches_of_one_crowded_id(spark):
    """20,000 detections of one id on either side, far apart but for one pair; and the states of other ids."""
    far = spark.range(20_000).select(F.lit("a").alias("image"), F.lit(1).alias("id"), F.array((F.col("id") * 3).cast("double"), F.lit(0.0)).alias("corners"))
    other = far.withColumn("corners", F.transform("corners", lambda v: v + 1.5))
    close = spark.createDataFrame([("b", 1, [1.0, 2.0, 3.0, 4.0]), ("b", 2, [1.0, 2.0]), ("b", 3, [0.0, 0.0]), ("b", 5, [-0.2, 0.4])], "image string, id int, corners array<double>")
    seen = spark.createDataFrame([("b", 1, [1.9, 1.1, 3.0, 4.9]), ("b", 2, [2.0, 2.0]), ("b", 4, [0.0, 0.0]), ("b", 5, [0.7, -0.5])], "image string, id int, corners array<double>")
    began = time.time()
    got = sorted(tuple(r) for r in dt.match_detections(far.unionByName(close), other.unionByName(seen)).collect())
    assert got == [("a", 1, "extra"), ("a", 1, "missed"), ("b", 1, "matched"), ("b", 2, "extra"), ("b", 2, "missed"), ("b", 3, "missed"), ("b", 4, "extra"), ("b", 5, "matched")]
    assert time.time() - began < 60
    one = spark.createDataFrame([("a", 1, [300.9, 0.9])], "image string, id int, corners array<double>")
    assert [tuple(r) for r in dt.match_detections(far, one).collect()] == [("a", 1, "matched")]


def test_matches_meet_in_few_cells(spark):
    """Random places and whole multiples of the tolerance, against all pairs; an expected detection stands in at most four cells."""
    rng = np.random.default_rng(5)
    sides = [[("a", int(i % 40), [float(v) for v in (rng.integers(-8, 9, 2) * 0.5 if i % 2 else rng.uniform(-4, 4, 2))]) for i in range(300)] for _ in range(2)]
    frames = [spark.createDataFrame(s, "image string, id int, corners array<double>") for s in sides]
    matched = {(i, k) for i, k, p in sides[0] for _, m, q in sides[1] if k == m and all(abs(x - y) < 0.5 for x, y in zip(p, q))}
    out = dt.match_detections(*frames, 0.5)
    assert {(r["image"], r["id"]) for r in out.where("status = 'matched'").collect()} == matched and 0 < len(matched) < 40
    reached = next(line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Generate explode(sequence" in line)
    assert "/ 2.0" in reached
