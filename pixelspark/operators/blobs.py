"""Connected components (8-connectivity) of foreground pixels, as boxes.

Frames are cut into strips of rows, which tasks label by themselves: the pixels of many strips at a time become runs [x0, x1), runs of
neighbouring rows touch when a.x0 <= b.x1 and b.x0 <= a.x1, and union-find over arrays joins them. A component leaves its strip
as one row: its box, its size, and its runs on the strip's first and last rows, by which it may go on in the next strips. The
second step is small: a frame's components meet, those of neighbouring strips touch by these border runs, and boxes are united.
One plan serves frames of any size: a task of the first step holds strips, one of the second the border runs of a frame.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .groups import in_order, same_as_before, whole_groups
from .pixels import foreground

STRIP_ROWS = 256


def runs(px: DataFrame) -> DataFrame:
    """(frame_id, y, x0, x1) of consecutive foreground pixels."""
    w = Window.partitionBy("frame_id", "y").orderBy("x")
    islands = foreground(px).select("frame_id", "y", "x", (F.col("x") - F.row_number().over(w)).alias("island"))
    return islands.groupBy("frame_id", "y", "island").agg(F.min("x").alias("x0"), (F.max("x") + 1).alias("x1")).drop("island")


def union_find(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node of the component of each of n nodes; a and b are the ends of edges."""
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    return root


def touching(row: np.ndarray, x0: np.ndarray, x1: np.ndarray, under: np.ndarray, u0: np.ndarray, u1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places (i, j) where run i touches run j, of row under[j], seen from the row below. Runs are sorted by row and x; rows are numbers from 0."""
    span = int(max(x1.max(initial=0), u1.max(initial=0))) + 2
    first = np.searchsorted(row * span + x1, under * span + u0, "left")
    last = np.searchsorted(row * span + x0, under * span + u1, "right")
    many = np.maximum(last - first, 0)
    offset = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    return np.repeat(first, many) + offset, np.repeat(np.arange(len(many)), many)


def _united(root: np.ndarray, box: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of boxes (rows min_x, max_x, min_y, max_y) and sizes by node: the roots, each node's place among them, their united boxes, their summed sizes."""
    roots, place = np.unique(root, return_inverse=True)
    out = np.stack([np.full(len(roots), np.iinfo(np.int64).max), np.zeros(len(roots), np.int64)] * 2)
    for i, f in enumerate((np.minimum, np.maximum) * 2):
        f.at(out[i], place, box[i])
    total = np.zeros(len(roots), np.int64)
    np.add.at(total, place, size)
    return roots, place, out, total


def _run_lists(place: np.ndarray, chosen: np.ndarray, x0: np.ndarray, x1: np.ndarray, n: int) -> pa.ListArray:
    """Lists, one for each of n components, of its chosen runs."""
    order = chosen[np.argsort(place[chosen], kind="stable")]
    edges = np.searchsorted(place[order], np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(edges), pa.StructArray.from_arrays([pa.array(x0[order].astype(np.int32)), pa.array(x1[order].astype(np.int32))], ["x0", "x1"]))


BOX = ("min_x", "max_x", "min_y", "max_y")


def _label_strips(strip_rows: int):
    """Pixels of whole strips, sorted -> components, with their runs on the first and last row of the strip."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["frame_id", "strip"]):
            frame, strip, y, x = (t.column(c).combine_chunks() for c in ("frame_id", "strip", "y", "x"))
            same = same_as_before(frame, strip)
            y, x, strip = y.to_numpy().astype(np.int64), x.to_numpy().astype(np.int64), strip.to_numpy()
            new_row = np.append(True, ~same | (y[1:] != y[:-1]))
            starts = np.append(True, new_row[1:] | (x[1:] > x[:-1] + 1))
            at = np.flatnonzero(starts)
            x0, x1 = x[at], x[np.append(at[1:], len(x)) - 1] + 1
            size = x1 - x0
            row = (np.cumsum(new_row) - 1)[at]
            lead = np.flatnonzero(new_row)
            above = np.append(False, same[lead[1:] - 1] & (y[lead[1:]] == y[lead[:-1]] + 1))  # the row before is the one above
            below = np.flatnonzero(above[row])
            i, j = touching(row, x0, x1, row[below] - 1, x0[below], x1[below])
            roots, place, box, total = _united(union_find(len(at), i, below[j]), np.stack([x0, x1, y[at], y[at] + 1]), size)
            inside = y[at] - strip[at] * strip_rows
            lists = [_run_lists(place, np.flatnonzero(inside == edge), x0, x1, len(roots)) for edge in (0, strip_rows - 1)]
            yield pa.RecordBatch.from_arrays([frame.take(pa.array(at[roots])), pa.array(strip[at[roots]]), *[pa.array(v.astype(np.int32)) for v in box], pa.array(total), *lists], names=["frame_id", "strip", *BOX, "pixels", "top", "bottom"])

    return rows


def _merge_strips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of whole frames, sorted by frame and strip -> united boxes."""
    for t in whole_groups(batches, ["frame_id"]):
        frame, strip = t.column("frame_id").combine_chunks(), t.column("strip").to_numpy()
        same = same_as_before(frame)
        group = np.append(0, np.cumsum(~same | (strip[1:] != strip[:-1])))  # strips, numbered
        lead = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        follows = np.append(False, same[lead[1:] - 1] & (strip[lead[1:]] == strip[lead[:-1]] + 1))

        def border(name: str, chosen: np.ndarray) -> tuple[np.ndarray, ...]:
            lists = t.column(name).combine_chunks()  # noqa: B023
            node = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            flat = lists.flatten()
            a, b = (flat.field(k).to_numpy().astype(np.int64) for k in ("x0", "x1"))
            keep = chosen[node]
            node, a, b = node[keep], a[keep], b[keep]
            order = np.lexsort((a, group[node]))  # noqa: B023
            return node[order], a[order], b[order]

        low, l0, l1 = border("bottom", np.append(follows[1:], False)[group])
        high, h0, h1 = border("top", follows[group])
        i, j = touching(group[low], l0, l1, group[high] - 1, h0, h1)
        box = np.stack([t.column(c).to_numpy().astype(np.int64) for c in BOX])
        roots, _, box, total = _united(union_find(t.num_rows, low[i], high[j]), box, t.column("pixels").to_numpy())
        yield pa.RecordBatch.from_arrays([frame.take(pa.array(roots)), *[pa.array(v.astype(np.int32)) for v in box], pa.array(total)], names=["frame_id", *BOX, "pixels"])


def blobs(px: DataFrame, strip_rows: int = STRIP_ROWS) -> DataFrame:
    """(frame_id, min_x, max_x, min_y, max_y, pixels) of every component."""
    kind = px.schema["frame_id"].dataType.simpleString()
    boxes = ", ".join(f"{c} int" for c in BOX) + ", pixels bigint"
    edge = "array<struct<x0:int,x1:int>>"
    found = foreground(px).select("frame_id", F.expr(f"cast(floor(y / {strip_rows}) as int)").alias("strip"), F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"))
    parts = in_order(found, ["frame_id", "strip"], ["y", "x"]).mapInArrow(_label_strips(strip_rows), f"frame_id {kind}, strip int, {boxes}, top {edge}, bottom {edge}")
    return in_order(parts, ["frame_id"], ["strip"]).mapInArrow(_merge_strips, f"frame_id {kind}, {boxes}")


def boxes_of(labelled: DataFrame) -> DataFrame:
    """Box union and pixel sum of the runs of each (frame_id, label)."""
    return labelled.groupBy("frame_id", "label").agg(F.min("x0").alias("min_x"), F.max("x1").alias("max_x"), F.min("y").alias("min_y"), (F.max("y") + 1).alias("max_y"), F.sum(F.col("x1") - F.col("x0")).cast("bigint").alias("pixels")).drop("label")


def blob_fields(boxes: DataFrame) -> DataFrame:
    """width, height, area and filled share of each box."""
    w, h = F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")
    return boxes.withColumn("width", w).withColumn("height", h).withColumn("area", (w * h).cast("bigint")).withColumn("filled", F.col("pixels") / (w * h))


def blob_filter(boxes: DataFrame, width=(0, None), height=(0, None), pixels=(0, None), aspect=(0.0, None), fill=(0.0, None)) -> DataFrame:
    """Boxes inside all inclusive bounds (None: open); aspect is height / width, infinite where that is not a number."""
    full = blob_fields(boxes)
    ratio = F.when(F.col("width") == 0, F.lit(float("inf"))).otherwise(F.col("height") / F.col("width"))
    for value, (low, high) in ((F.col("width"), width), (F.col("height"), height), (F.col("pixels"), pixels), (ratio, aspect), (F.col("filled"), fill)):
        full = full.where(value >= low) if high is None else full.where(value.between(low, high))
    return full.select(boxes.columns)


def blob_filter_min(boxes: DataFrame, width: int = 0, height: int = 0, area: int = 0, fill: float = 0.0) -> DataFrame:
    """Boxes of at least this width, height, area and filled share."""
    return blob_fields(boxes).where((F.col("width") >= width) & (F.col("height") >= height) & (F.col("area") >= area) & (F.col("filled") >= fill)).select(boxes.columns)


def largest(boxes: DataFrame, k: int | None) -> DataFrame:
    """The k blobs of most pixels of each frame, or all, with their rank; ties by place."""
    w = Window.partitionBy("frame_id").orderBy(F.desc("pixels"), "min_y", "min_x", "max_y", "max_x")
    ranked = boxes.withColumn("rank", F.row_number().over(w))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def touching_runs(found: DataFrame) -> DataFrame:
    """Each run with the runs (u0, u1) of the row above that touch it, corners included."""
    above = found.select("frame_id", (F.col("y") + 1).alias("y"), F.col("x0").alias("u0"), F.col("x1").alias("u1"))
    return found.join(above, ["frame_id", "y"]).where("x0 <= u1 and u0 <= x1")


def as_lists(boxes: DataFrame) -> DataFrame:
    """(frame_id, vec, n): each frame's boxes as one list, from the top left."""
    return boxes.groupBy("frame_id").agg(F.array_sort(F.collect_list(F.struct("min_y", "min_x", "max_y", "max_x", "pixels"))).alias("vec")).withColumn("n", F.size("vec").cast("bigint"))
