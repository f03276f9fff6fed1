"""Golden literals and properties of the frame operators."""

import datetime
import struct
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pixelspark.functions import color
from pixelspark.operators import blobs as bl
from pixelspark.operators import groups, pixels
from pixelspark.plans import fixtures as fx
from pixelspark.sources import frames as fr

# Masks and the boxes (min_x, max_x, min_y, max_y, pixels) of their blobs.
MASKS = {
    "1x1": ("1", [(0, 1, 0, 1, 1)]),
    "2x2": ("11/11", [(0, 2, 0, 2, 4)]),
    "cross_2x2": ("10/01", [(0, 2, 0, 2, 2)]),
    "two_regions": ("100/001", [(0, 1, 0, 1, 1), (2, 3, 1, 2, 1)]),
    "one_row": ("101", [(0, 1, 0, 1, 1), (2, 3, 0, 1, 1)]),
    "big_u": ("1001/1001/0110", [(0, 4, 0, 3, 6)]),
    "big_arch": ("0110/1001/1001", [(0, 4, 0, 3, 6)]),
    "zigzag": ("010101010101/101010101010", [(0, 12, 0, 2, 12)]),
    "fermata": ("01110/10001/00100", [(0, 5, 0, 2, 5), (2, 3, 2, 3, 1)]),
}


def masks(spark):
    rows = [(k, y, x, 255 * int(c)) for k, (name, (mask, _)) in enumerate(MASKS.items()) for y, row in enumerate(mask.split("/")) for x, c in enumerate(row)]
    return spark.createDataFrame(rows, "frame_id bigint, y int, x int, c0 int")


@pytest.mark.parametrize("strip_rows", [1, 2, bl.STRIP_ROWS])
def test_blob_goldens(spark, strip_rows):
    got = {}
    for r in bl.blobs(masks(spark), strip_rows).collect():
        got.setdefault(r["frame_id"], []).append(tuple(r[c] for c in ("min_x", "max_x", "min_y", "max_y", "pixels")))
    for k, (name, (_, expected)) in enumerate(MASKS.items()):
        assert sorted(got[k]) == sorted(expected), name


def flood(mask):
    """Boxes of a mask's components, pixel by pixel."""
    seen, out = set(), []
    for y, x in zip(*np.nonzero(mask)):
        if (y, x) in seen:
            continue
        todo, part = [(y, x)], []
        seen.add((y, x))
        while todo:
            a, b = todo.pop()
            part.append((a, b))
            for c in range(max(0, a - 1), min(mask.shape[0], a + 2)):
                for d in range(max(0, b - 1), min(mask.shape[1], b + 2)):
                    if mask[c, d] and (c, d) not in seen:
                        seen.add((c, d))
                        todo.append((c, d))
        ys, xs = zip(*part)
        out.append((min(xs), max(xs) + 1, min(ys), max(ys) + 1, len(part)))
    return sorted(out)


@pytest.mark.parametrize("strip_rows", [3, 7, 64])
def test_blobs_equal_a_flood_fill(spark, monkeypatch, strip_rows):
    """Frames of several densities, a spiral whose arms cross all strips, and frames without foreground; in Spark, and in tables of few rows at a time."""
    rng = np.random.default_rng(strip_rows)
    frames = [(rng.random((23, 31)) < p).astype(int) for p in (0.0, 0.1, 0.35, 0.45, 0.6, 1.0)]
    spiral = np.zeros((25, 25), int)
    y, x, dy, dx = 0, 0, 0, 1
    for length in [24, 24, 24, 22, 22, 20, 20, 18, 18, 16, 16, 14, 14, 12, 12, 10, 10, 8, 8]:
        for _ in range(length):
            spiral[y, x] = 1
            y, x = y + dy, x + dx
        dy, dx = dx, -dy
    frames.append(spiral)
    rows = [(k, int(y), int(x), 9) for k, f in enumerate(frames) for y, x in zip(*np.nonzero(f))]
    px = spark.createDataFrame(rows, "frame_id bigint, y int, x int, c0 int").orderBy("x", "y")
    got = {}
    for r in bl.blobs(px, strip_rows).collect():
        got.setdefault(r["frame_id"], []).append(tuple(r)[1:])
    want = {k: flood(f) for k, f in enumerate(frames) if f.any()}
    assert {k: sorted(v) for k, v in got.items()} == want and len(want[6]) == 1
    monkeypatch.setattr(bl, "whole_groups", partial(groups.whole_groups, rows_at_once=40))
    rows = pa.table(dict(zip(("frame_id", "strip", "y", "x"), zip(*sorted((k, y // strip_rows, y, x) for k, y, x, _ in rows)))))
    parts = pa.Table.from_batches(bl._label_strips(strip_rows)(iter(rows.to_batches(7)))).sort_by([("frame_id", "ascending"), ("strip", "ascending")])
    merged = pa.Table.from_batches(bl._merge_strips(iter(parts.to_batches(7)))).to_pylist()
    assert sorted(tuple(r.values()) for r in merged) == sorted((k, *box) for k, boxes in want.items() for box in boxes)


def test_blob_pixels_sum_to_mask(spark, sf):
    mask = fx.px_mask(spark, sf)
    assert bl.blobs(mask).agg(F.sum("pixels")).first()[0] == mask.count()


def test_blobs_of_nothing(spark):
    assert bl.blobs(masks(spark).where("c0 = 7")).count() == 0


def convert(spark, values, source, target):
    df = spark.createDataFrame([values], [f"c{i}" for i in range(len(values))])
    return tuple(df.select(*[e.alias(f"o{i}") for i, e in enumerate(color.convert([F.col(c) for c in df.columns], source, target))]).first())


def near(a, b, tolerance=10):
    return all(abs(x - y) <= tolerance for x, y in zip(a, b))


def test_color_goldens(spark):
    teal = (28, 58, 58)
    assert near(convert(spark, teal, "rgb", "ycc"), (46, 130, 122))
    assert near(convert(spark, teal, "rgb", "hsv"), (128, 133, 59))
    assert near(convert(spark, teal, "rgb", "luma"), (46,))
    assert near(convert(spark, convert(spark, teal, "rgb", "ycc"), "ycc", "rgb"), teal)
    assert near(convert(spark, convert(spark, teal, "rgb", "hsv"), "hsv", "rgb"), teal)
    assert near(convert(spark, (149, 79, 146), "ycc", "rgb"), (175, 153, 63))


@pytest.mark.parametrize("size", [10, 1])
def test_windows_keep_constant_frames(spark, size):
    px = fr.monochrome_frames(spark, size, size, "rgb", [255, 0, 128], 1)
    for out in (pixels.percentile_filter(px, 3, 3, 0), pixels.percentile_filter(px, 15, 15, 0), pixels.box_blur(px, 3, 5), pixels.gaussian_blur(px, 1.0, 3, 3), pixels.median_filter(px, 3, 3)):
        assert [tuple(r) for r in out.select("c0", "c1", "c2").distinct().collect()] == [(255, 0, 128)]
        assert out.count() == size * size


def test_erode_median_dilate_are_ordered(spark, sf):
    px = fx.px_luma(spark, sf).where("frame_id < 20")
    named = lambda df, n: df.withColumnRenamed("c0", n)
    both = named(pixels.erode(px, 3, 3), "lo").join(named(pixels.median_filter(px, 3, 3), "mid"), pixels.PLACE).join(named(pixels.dilate(px, 3, 3), "hi"), pixels.PLACE)
    assert both.where("lo > mid or mid > hi").count() == 0


@pytest.mark.parametrize("width,height,index,strip_rows", [(3, 3, 4, 256), (15, 15, 0, 256), (15, 15, 112, 4), (1, 5, 3, 3), (7, 1, 6, 2), (5, 31, 40, 8)])
def test_percentile_equals_sorted_windows(spark, monkeypatch, width, height, index, strip_rows):
    """Clipped windows, windows wider than the frame, strips lower than a window, and pixels that are missing."""
    monkeypatch.setattr(pixels, "STRIP_ROWS", strip_rows)
    monkeypatch.setattr(pixels, "PIXELS_AT_ONCE", 30)
    rng = np.random.default_rng(width)
    rows = [(f, y, x, int(rng.integers(0, 256)), int(rng.integers(0, 3))) for f, (h, w) in enumerate([(20, 9), (1, 1), (3, 30)]) for y in range(h) for x in range(w) if rng.random() < 0.9]
    px = spark.createDataFrame(rows, "frame_id bigint, y int, x int, c0 int, c1 int")
    got = {tuple(r)[:3]: tuple(r)[3:] for r in pixels.percentile_filter(px, width, height, index).collect()}
    assert len(got) == len(rows)
    for f, y, x, *_ in rows:
        near = [r for r in rows if r[0] == f and abs(r[1] - y) <= height // 2 and abs(r[2] - x) <= width // 2]
        assert got[f, y, x] == tuple(sorted(r[c] for r in near)[index * len(near) // (width * height)] for c in (3, 4))


def test_percentile_of_dealt_frames_has_one_exchange(spark, sf):
    plan = pixels.median_filter(fx.px_luma(spark, sf, by_frame=True), 3, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_chain_of_windows_has_one_exchange(spark, sf):
    px = pixels.by_frame(fx.px_luma(spark, sf))
    plan = pixels.erode(pixels.box_blur(px, 3, 3), 3, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_pack_unpack_round_trip(spark, sf):
    px = fx.px_luma(spark, sf)
    again = fr.unpack_frames(fr.pack_frames(px), "luma")
    assert again.exceptAll(px.select(*again.columns)).count() == 0 and again.count() == px.count()


def test_unpack_leaves_out_wrong_sizes(spark):
    frames = spark.createDataFrame([(1, 2, 2, b"abcd"), (2, 2, 2, b"abc"), (3, 0, 0, b""), (4, None, 2, None)], "frame_id bigint, width int, height int, data binary")
    assert {r[0] for r in fr.unpack_frames(frames, "luma").select("frame_id").distinct().collect()} == {1}


def test_yuyv_needs_even_width(spark):
    px = fr.monochrome_frames(spark, 3, 1, "rgb", [1, 2, 3], 1)
    with pytest.raises(Exception, match="even width"):
        pixels.color_space(px, "rgb", "yuyv").collect()


def png(width, height, rows):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + bytes(v for p in row for v in p) for row in rows)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_read_images(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png(2, 1, [[(1, 2, 3), (250, 5, 9)]]))
    (tmp_path / "b.txt").write_bytes(b"no image")
    images = fr.read_images(spark, str(tmp_path))
    assert {r["origin"].rsplit("/", 1)[1]: r["kind"] for r in images.collect()} == {"a.png": "png", "b.txt": None}
    got = fr.image_pixels(images, F.lit(1)).orderBy("x").collect()
    assert [tuple(r) for r in got] == [(1, 0, 0, 1, 2, 3), (1, 0, 1, 250, 5, 9)]


def test_export_is_ordered_in_bounded_files(spark, tmp_path):
    """A busy hour of one stream, equal times, and streams that share the hour: parts in order are the sequence, and the manifest tells of them."""
    rows = [(i, "cam-0" if i % 5 else "cam-1", 1_704_085_200 + i // 3 * (1 if i < 400 else 30), bytes([i % 256])) for i in range(500)]
    frames = spark.createDataFrame(rows, "frame_id long, stream string, s long, data binary").withColumn("ts", F.timestamp_seconds("s")).drop("s").repartition(7)
    manifest = fr.write_export(frames, str(tmp_path / "out"), 50)
    back = fr.read_export(spark, str(tmp_path / "out"), "frame_id long, data binary, ts timestamp").withColumn("file", F.input_file_name()).collect()
    assert len(back) == 500
    for stream in ("cam-0", "cam-1"):
        got = sorted((r["hour"], r["part"], r["ts"], r["frame_id"]) for r in back if r["stream"] == stream)
        assert [g[3] for g in got] == [r[0] for r in sorted(rows, key=lambda r: (r[2], r[0])) if r[1] == stream]
    sizes = {}
    for r in back:
        sizes.setdefault((r["stream"], r["hour"], r["part"]), set()).add(r["file"])
    told = {(r["stream"], r["hour"], r["part"]): r for r in manifest.collect()}
    assert set(told) == set(sizes) and all(len(files) == 1 for files in sizes.values())
    assert sum(r["n_frames"] for r in told.values()) == 500 and all(r["n_frames"] <= 50 and r["first_ts"] <= r["last_ts"] for r in told.values())


def test_png_files_share_folders(spark, tmp_path):
    px = fr.painted(spark.range(-2, 40).withColumnRenamed("id", "frame_id"), 3, 2, [F.lit(9), F.pmod("frame_id", F.lit(256)), F.lit(255)])
    fr.write_png(px, str(tmp_path / "png"), 30)
    assert len([p for p in (tmp_path / "png").iterdir() if p.is_dir()]) == 2
    images = fr.read_images(spark, str(tmp_path / "png"))
    again = fr.image_pixels(images, F.col("frame_id"))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, px.select(*again.columns).collect()))


def test_tasks_do_not_grow_with_the_table(spark, sf, monkeypatch):
    """Camera frames and detections are dealt out by their number, so that the largest task has a few frames or some rows."""
    from pyspark.sql import functions as F

    from pixelspark.plans import fixtures as fx

    monkeypatch.setattr(fx, "CAMERA_WIDTH", 40)
    monkeypatch.setattr(fx, "CAMERA_HEIGHT", 30)
    monkeypatch.setattr(fx, "ROWS_PER_TASK", 100)
    sizes = lambda df: df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).agg(F.sum("n"), F.max("n")).first()
    n, most = sizes(fx.px_camera(spark, sf))
    assert n == spark.read.parquet(f"{sf}/lineitem.parquet").count() * 8 and most < 12 * 1200
    n, most = sizes(fx.dets(spark, sf))
    assert n * 8 == sizes(fx.px_camera(spark, sf))[0] and most < 250


def test_detections_of_odd_rows(spark, tmp_path):
    """Few bytes of a row travel, and detections are those of the whole rows: nulls, negative and large keys, zeros of either sign and ties included."""
    kind = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_shipdate timestamp"
    day = [datetime.datetime(2000, 1, d) for d in (1, 2, 3)]
    odd = [None, -1, 0, 7, 2**24 - 1, 2**24, 2**32 - 1, 2**32, 2**62, -(2**63)]
    rows = [(1, p, s, n, 2.0, 300.0, day[0]) for p in odd for s in odd for n in (None, -1, 0, 127, 128, 2**31 - 1)]
    rows += [(2, 5, 6, 1, q, p, d) for d in day for q in (None, 1.0, 0.0, -0.0, float("nan")) for p in (None, 9.5, -0.0, 0.0)] + [(None, 1, 1, 1, 1.0, 1.0, None)] * 2
    spark.createDataFrame(rows, kind).repartition(3).write.parquet(f"{tmp_path}/lineitem.parquet")
    whole = spark.sql(fx.DETS_SQL.replace("from lineitem", "from {lineitem}"), lineitem=spark.read.parquet(f"{tmp_path}/lineitem.parquet").coalesce(1))
    got = fx.dets(spark, str(tmp_path))
    assert sorted(map(str, got.collect())) == sorted(map(str, whole.collect())) and got.schema == whole.schema
    sent = got._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression")[1].splitlines()[1]
    assert "AS packed" in sent and "AS wide" in sent and sent.split("CASE WHEN")[0].count("#") == 3


def test_orders_are_dealt_out_with_their_detections(spark, sf):
    """Orders grow with the table, so they are joined where they lie, and no task holds all of them."""
    from pixelspark.plans import telemetry_queries as tq

    plan = tq.parts_of_orders(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_triggers_of_images_do_not_grow_with_frames(spark, tmp_path):
    from pixelspark.plans import telemetry_queries as tq

    for n, files in ((100, 250), (256_000, 250), (25_600_000, 25_000)):
        spark.range(n - 1, n).withColumnRenamed("id", "event_id").write.parquet(f"{tmp_path}/{n}/events.parquet")
        assert tq.files_per_trigger(spark, f"{tmp_path}/{n}") == files
