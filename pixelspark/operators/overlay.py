"""Line and box overlays: elements become pixel rows and are joined to the canvas."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelspark.functions.color import idiv

from .groups import in_order, same_as_before, whole_groups
from .pixels import PLACE, channel_columns, color_space


def rasterize_lines(lines: DataFrame) -> DataFrame:
    """lines (frame_id, x0, y0, x1, y1, other columns) to pixel rows (frame_id, y, x, other columns); negative places are skipped.

    The Bresenham points of a line without its last point, each from its number alone: point i is i steps along the longer side; along
    the shorter one it is (2 i short + long) div (2 long) steps, where ties go on. Points become rows before they are computed.
    """
    ends = ["x0", "y0", "x1", "y1"]
    rest = [c for c in lines.columns if c not in ("frame_id", *ends)]
    x0, y0, x1, y1 = (F.col(c) for c in ends)
    dx, dy, n, i = F.abs(x1 - x0), F.abs(y1 - y0), F.col("_n"), F.col("_i")
    whole = lines.select("frame_id", *rest, *[F.col(c).cast("int").alias(c) for c in ends]).withColumn("_n", F.greatest(dx, dy)).where("_n > 0")
    numbered = whole.select("*", F.explode(F.sequence(F.lit(0), n - 1)).alias("_i"))
    steps = lambda side: F.when(side == n, i).otherwise(idiv(2 * i.cast("long") * side + n, 2 * n)).cast("int")
    along = lambda start, side, end: start + F.when(start < end, 1).otherwise(-1) * steps(side)
    return numbered.select("frame_id", along(y0, dy, y1).alias("y"), along(x0, dx, x1).alias("x"), *rest).where("x >= 0 and y >= 0")


def detection_edges(detections: DataFrame) -> DataFrame:
    """The four edges, corner i to i + 1, of detections (frame_id, corners of 8 doubles, other columns); coordinates are truncated."""
    at = lambda i, k: F.element_at("corners", i % 4 * 2 + k + 1).cast("int")
    edges = F.array(*[F.struct(at(i, 0).alias("x0"), at(i, 1).alias("y0"), at(i + 1, 0).alias("x1"), at(i + 1, 1).alias("y1")) for i in range(4)])
    rest = [c for c in detections.columns if c not in ("frame_id", "corners")]
    return detections.select("frame_id", *rest, F.posexplode(edges).alias("edge", "e")).select("frame_id", *rest, "edge", "e.*")


def rasterize_detections(detections: DataFrame) -> DataFrame:
    return rasterize_lines(detection_edges(detections))


#: Points that `point_lists` holds at once, unless one line has more.
POINTS_AT_ONCE = 1 << 18


def _point_texts(x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """How many points of each line lie on the frame, and their text, in order of x and y.

    A line is walked from its smaller x on, so only points of one x may still be out of order: where y falls, they are turned round.
    """
    dx, dy = np.abs(x1 - x0), np.abs(y1 - y0)
    n = np.maximum(dx, dy)
    line, back = np.repeat(np.arange(len(n)), n), x0 > x1
    i = np.arange(len(line)) - np.repeat(np.cumsum(n) - n, n)
    i = np.where(back[line], n[line] - 1 - i, i)
    at = lambda start, side, end: start[line] + np.where(start < end, 1, -1)[line] * np.where((side == n)[line], i, (2 * i * side[line] + n[line]) // (2 * n[line]))
    x, y = at(x0, dx, x1), at(y0, dy, y1)
    new = np.flatnonzero(np.append(True, (line[1:] != line[:-1]) | (x[1:] != x[:-1])))[: len(line)]
    size = np.diff(np.append(new, len(line)))
    turned = np.repeat(2 * new + size - 1, size) - np.arange(len(line))
    y = np.where(((y0 < y1) == back)[line], y[turned], y)
    seen = (x >= 0) & (y >= 0)
    counts = np.bincount(line[seen], minlength=len(n))
    texts = pc.binary_join_element_wise(pa.array(x[seen]).cast(pa.string()), pa.array(y[seen]).cast(pa.string()), ",")
    return counts, pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), texts), " ")


def _listed(rest: list[str]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("x0", "y0", "x1", "y1")]
            total = np.cumsum(np.maximum(np.abs(ends[2] - ends[0]), np.abs(ends[3] - ends[1])))
            first = 0
            while first < len(total):
                last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + POINTS_AT_ONCE, "right")))
                counts, texts = _point_texts(*[e[first:last] for e in ends])
                some = pa.array(counts > 0)
                kept = batch.slice(first, last - first).filter(some)
                yield pa.RecordBatch.from_arrays([*[kept.column(c) for c in rest], pa.array(counts[counts > 0]), texts.filter(some)], names=[*rest, "n", "points"])
                first = last

    return rows


def point_lists(lines: DataFrame) -> DataFrame:
    """lines as rasterize_lines takes them to one row for each line with pixels: (frame_id, other columns, n, points).

    points lists the n pixels that rasterize_lines gives for the line as "x,y x,y ..", in order of x and y. Made from the line itself,
    so no pixel becomes a row and nothing is grouped; lines with a null end have none. A task puts lines of like ends together: their
    lists share text, which files then hold once.
    """
    ends = ["x0", "y0", "x1", "y1"]
    rest = [c for c in lines.columns if c not in ends]
    whole = lines.select(*rest, *[F.col(c).cast("int").alias(c) for c in ends]).dropna(subset=ends)
    near = sum((F.shiftleft(F.col(c).cast("long").bitwiseAND(0xFFFF), 48 - 16 * k) for k, c in enumerate(ends)), F.lit(0))  # one number, so that Spark sorts by radix
    kinds = ", ".join(f"`{c}` {lines.schema[c].dataType.simpleString()}" for c in rest)
    return whole.sortWithinPartitions(near).mapInArrow(_listed(rest), f"{kinds}, n bigint, points string")


def draw_points(canvas: DataFrame, points: DataFrame, color: list[int], source: str | None = None, target: str | None = None) -> DataFrame:
    """canvas, converted from its format to that of the colour where both are named, with the pixels of points (frame_id, y, x, ...) in the colour."""
    if source and target:
        canvas = color_space(canvas, source, target)
    have = channel_columns(canvas)
    hit = points.select(*PLACE).distinct().withColumn("hit", F.lit(True))
    return canvas.join(hit, PLACE, "left").select(*PLACE, *[F.when(F.col("hit"), F.lit(v)).otherwise(F.col(c)).alias(c) for c, v in zip(have, color)])


def draw_colored_points(canvas: DataFrame, points: DataFrame) -> DataFrame:
    """As draw_points for points (frame_id, y, x, seq, color array): of several on a pixel the one of the greatest seq wins."""
    have = channel_columns(canvas)
    last = points.groupBy(*PLACE).agg(F.max_by("color", "seq").alias("color"))
    return canvas.join(last, PLACE, "left").select(*PLACE, *[F.coalesce(F.get("color", F.lit(i)), F.col(c)).cast("int").alias(c) for i, c in enumerate(have)])


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of boxes, sorted by frame and y -> the x at which the set of boxes changes, with the layers from there on.

    A row is swept once: a box of the row begins and ends segments (its border columns are segments of their own), and stands in the
    layers of those it covers only.
    """
    for t in whole_groups(batches, ["frame_id", "y"]):
        row = np.append(0, np.cumsum(~same_as_before(t.column("frame_id").combine_chunks(), t.column("y").combine_chunks())))
        low, high = (t.column(c).to_numpy().astype(np.int64) for c in ("min_x", "max_x"))
        least, span = int(low.min()), int(high.max() - low.min()) + 2
        at = lambda x: row * span + x - least  # noqa: B023, E731
        cuts = np.unique(np.concatenate([at(low), at(np.minimum(low + 1, high)), at(np.maximum(high - 1, low)), at(high)]))
        first, last = np.searchsorted(cuts, at(low)), np.searchsorted(cuts, at(high))
        box = np.repeat(np.arange(len(row)), last - first)
        cut = np.arange(len(box)) - np.repeat(np.cumsum(last - first) - (last - first), last - first) + first[box]
        order = np.lexsort((box, t.column("seq").to_numpy()[box], cut))
        box, cut = box[order], cut[order]
        x = cuts[cut] % span + least
        border = t.column("edge").to_numpy(zero_copy_only=False)[box] | (x == low[box]) | (x == high[box] - 1)
        fill = np.where(border, 1.0, t.column("fill").to_numpy()[box])
        layer = pa.StructArray.from_arrays([pa.array(fill), t.column("color").combine_chunks().take(pa.array(box))], ["fill", "color"])
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(cut, np.arange(len(cuts) + 1)).astype(np.int32)), layer)
        lead = pa.array(np.searchsorted(row, cuts // span))
        yield pa.RecordBatch.from_arrays([t.column("frame_id").combine_chunks().take(lead), t.column("y").combine_chunks().take(lead), pa.array((cuts % span + least).astype(np.int32)), lists], names=["frame_id", "y", "x", "layers"])


def box_segments(boxes: DataFrame) -> DataFrame:
    """(frame_id, y, x, layers): from x on, up to the row's next segment, the layers (fill, color) of boxes in order of seq; none where the last box ends."""
    kind, color = boxes.schema["frame_id"].dataType.simpleString(), "array<int>"
    rows = boxes.where("min_x < max_x and min_y <= max_y").select("frame_id", F.explode(F.sequence(F.col("min_y").cast("int"), F.col("max_y").cast("int"))).alias("y"), "seq", F.col("min_x").cast("int").alias("min_x"), F.col("max_x").cast("int").alias("max_x"), F.col("min_y"), F.col("max_y"), F.col("fill").cast("double").alias("fill"), F.col("color").cast(color).alias("color"))
    rows = rows.select("frame_id", "y", F.col("seq").cast("long").alias("seq"), "min_x", "max_x", ((F.col("y") == F.col("min_y")) | (F.col("y") == F.col("max_y"))).alias("edge"), "fill", "color")
    return in_order(rows, ["frame_id", "y"], ["seq"]).mapInArrow(_segments, f"frame_id {kind}, y int, x int, layers array<struct<fill:double,color:{color}>>")


def draw_boxes(canvas: DataFrame, boxes: DataFrame) -> DataFrame:
    """canvas under boxes (frame_id, seq, min_x, max_x, min_y, max_y, fill, color array), drawn in order of seq.

    Borders are opaque; inside, each channel becomes trunc(old * (1 - fill) + new * fill). Row max_y, one below the half-open box,
    belongs to the border. Each row of the canvas is swept with the segments of its boxes: a pixel takes the layers of the last
    segment that begins at or before it, so no pixel meets a box that does not cover it.
    """
    have = channel_columns(canvas)
    none = F.lit(None).cast("array<struct<fill:double,color:array<int>>>")
    pixels = canvas.select(*[F.col(c).cast("int").alias(c) if c in ("y", "x") else F.col(c) for c in PLACE], *have, F.lit(1).alias("_kind"), none.alias("layers"))
    marks = box_segments(boxes).select(*PLACE, *[F.lit(None).cast(canvas.schema[c].dataType).alias(c) for c in have], F.lit(0).alias("_kind"), "layers")
    before = Window.partitionBy("frame_id", "y").orderBy("x", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    under = pixels.unionByName(marks).withColumn("layers", F.last("layers", ignorenulls=True).over(before)).where("_kind = 1")

    def blended(i: int) -> Column:
        new = lambda l: F.get(l["color"], F.lit(i))  # noqa: E731, E741
        return F.aggregate("layers", F.col(f"c{i}").cast("int"), lambda old, l: F.when(l["fill"] >= 1, new(l)).otherwise((old * (1 - l["fill"]) + new(l) * l["fill"])).cast("int"))  # noqa: E741

    return under.select(*PLACE, *[F.when(F.coalesce(F.size("layers"), F.lit(0)) < 1, F.col(h)).otherwise(blended(i)).alias(h) for i, h in enumerate(have)])
