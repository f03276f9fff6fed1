"""Operators on pixel relations (frame_id, y, x, c0, ...): conversion, filters, swizzling, resampling and windows.

A pixel relation should be hash-partitioned by frame_id before a chain of window operators (`by_frame`): every window below
partitions by frame_id first, so the whole chain then needs one exchange.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelspark.functions.color import channels, convert, idiv

from .groups import in_order, same_as_before, whole_groups

PLACE = ["frame_id", "y", "x"]


def names(n: int) -> list[str]:
    return [f"c{i}" for i in range(n)]


def channel_columns(px: DataFrame) -> list[str]:
    return [c for c in px.columns if c[0] == "c" and c[1:].isdigit()]


def by_frame(px: DataFrame) -> DataFrame:
    return px.repartition("frame_id")


# colour


def color_space(px: DataFrame, source: str, target: str) -> DataFrame:
    """px in another pixel format. To and from yuyv, two neighbouring pixels of a row share one row of the relation."""
    if source == target:
        return px
    if source == "yuyv":
        return color_space(unpack_yuyv(px), "ycc", target)
    if target == "yuyv":
        return pack_yuyv(color_space(px, source, "ycc"))
    made = convert([F.col(c) for c in names(channels(source))], source, target)
    return px.select(*PLACE, *[e.cast("int").alias(f"c{i}") for i, e in enumerate(made)])


def pack_yuyv(ycc: DataFrame) -> DataFrame:
    """(frame_id, y, x of the pair, y1, u, y2, v) with the floored mean chroma of both pixels; rows must have an even width."""
    even = F.col("x") % 2 == 0
    pick = lambda c, first: F.max(F.when(even if first else ~even, F.col(c)))
    mean = lambda c: idiv(pick(c, True) + pick(c, False), 2)
    whole = F.when(F.count("*") == 2, pick("c0", True)).otherwise(F.raise_error(F.lit("yuyv needs an even width")).cast("int"))
    return ycc.groupBy("frame_id", "y", idiv(F.col("x"), 2).alias("x")).agg(whole.alias("c0"), mean("c1").alias("c1"), pick("c0", False).alias("c2"), mean("c2").alias("c3"))


def unpack_yuyv(yuyv: DataFrame) -> DataFrame:
    """The two ycc pixels of each pair."""
    pixel = lambda i, y: F.struct((F.col("x") * 2 + i).alias("x"), F.col(y).alias("c0"), F.col("c1"), F.col("c3").alias("c2"))
    return yuyv.select("frame_id", "y", F.explode(F.array(pixel(0, "c0"), pixel(1, "c2"))).alias("p")).select("frame_id", "y", "p.*").select(*PLACE, "c0", "c1", "c2")


def swizzle(px: DataFrame, extract: list[int]) -> DataFrame:
    """Channels in the given order; an index out of range gives 0."""
    channels(f"?{len(extract)}")
    have = channel_columns(px)
    return px.select(*PLACE, *[(F.col(f"c{i}") if f"c{i}" in have else F.lit(0)).alias(f"c{k}") for k, i in enumerate(extract)])


def swizzle_yuyv(yuyv: DataFrame, extract: list[int]) -> DataFrame:
    """As swizzle, per pixel: 0 is its own y, 1 is u, 2 is v."""
    return swizzle(unpack_yuyv(yuyv), extract)


# filters


def within(values: list[Column], low: list[int], high: list[int]) -> Column:
    """Every channel in its inclusive range; the shorter list decides how many are tested."""
    out = F.lit(True)
    for v, a, b in zip(values, low, high):
        out = out & v.between(a, b)
    return out


def color_filter(px: DataFrame, source: str, space: str, low: list[int], high: list[int]) -> DataFrame:
    """Luma mask: 255 where the pixel, in the filter's space, lies in the range of every channel, else 0."""
    if source == "yuyv":
        px, source = unpack_yuyv(px), "ycc"
    if space == "yuyv":
        space = "ycc"
    inside = within(convert([F.col(c) for c in names(channels(source))], source, space), low, high)
    return px.select(*PLACE, F.when(inside, 255).otherwise(0).alias("c0"))


def foreground(px: DataFrame) -> DataFrame:
    have = [F.col(c) for c in channel_columns(px)]
    return px.where((F.greatest(*have) if len(have) > 1 else have[0]) > 0)


# resampling


def resize(px: DataFrame, width: int, height: int) -> DataFrame:
    """Nearest neighbour: target (x, y) takes the source at (x * W div width, y * H div height).

    Turned round, a source pixel gives the targets from ceil(x * width / W) to before ceil((x + 1) * width / W): no join, and
    one partitioning by frame for its size.
    """
    frame = Window.partitionBy("frame_id")
    sized = px.withColumn("_w", F.max("x").over(frame) + 1).withColumn("_h", F.max("y").over(frame) + 1)
    up = lambda c, to, size: idiv(c * to + size - 1, size)
    for c, to, size in (("y", height, "_h"), ("x", width, "_w")):
        low, high = up(F.col(c), to, F.col(size)), up(F.col(c) + 1, to, F.col(size)) - 1
        sized = sized.where(low <= high).withColumn(c, F.explode(F.sequence(low, high)))
    return sized.select("frame_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), *channel_columns(px))


def resize_yuyv(yuyv: DataFrame, width: int, height: int) -> DataFrame:
    """As resize, in pixels; the width is rounded up to an even one."""
    return pack_yuyv(resize(unpack_yuyv(yuyv), width + width % 2, height))


def crop(px: DataFrame, x0: int, y0: int, x1: int, y1: int) -> DataFrame:
    """The pixels of [x0, x1) x [y0, y1), at their old places."""
    return px.where(F.col("x").between(x0, x1 - 1) & F.col("y").between(y0, y1 - 1))


# windows over neighbours


def _line(along: str, size: int):
    across = "x" if along == "y" else "y"
    return Window.partitionBy("frame_id", across).orderBy(along).rowsBetween(-(size // 2), size // 2)


def _odd(*sizes: int) -> None:
    if any(s % 2 == 0 or s < 1 for s in sizes):
        raise ValueError("window sizes are odd")


def box_blur(px: DataFrame, width: int, height: int) -> DataFrame:
    """Mean of a column, truncated, then of a row; windows are clipped at the frame's edges."""
    _odd(width, height)
    have = channel_columns(px)
    for along, size in (("y", height), ("x", width)):
        if size > 1:
            w = _line(along, size)
            px = px.select(*PLACE, *[idiv(F.sum(c).over(w), F.count(c).over(w)).alias(c) for c in have])
    return px


#: Fixed value: the scale of the integer Gaussian weights.
GAUSSIAN_SCALE = 26145.082


def gaussian_weights(sigma: float, size: int) -> list[int]:
    """Integer weights for offsets -size//2 .. size//2."""
    return [int(math.exp(-d * d / (2 * sigma * sigma)) * GAUSSIAN_SCALE / sigma) for d in range(-(size // 2), size // 2 + 1)]


def gaussian_blur(px: DataFrame, sigma: float, width: int, height: int) -> DataFrame:
    """As box_blur with Gaussian integer weights, renormalised where the window is clipped. sigma <= 0 changes nothing."""
    _odd(width, height)
    if sigma <= 0:
        return px
    have = channel_columns(px)
    for along, size in (("y", height), ("x", width)):
        if size == 1:
            continue
        w = Window.partitionBy("frame_id", "x" if along == "y" else "y").orderBy(along)
        total, norm = {c: F.lit(0) for c in have}, F.lit(0)
        for d, k in zip(range(-(size // 2), size // 2 + 1), gaussian_weights(sigma, size)):
            at = lambda c: F.lead(c, d).over(w) if d > 0 else F.lag(c, -d).over(w) if d < 0 else F.col(c)  # noqa: B023, E731
            norm = norm + F.when(at(have[0]).isNotNull(), k).otherwise(0)
            total = {c: t + F.coalesce(at(c) * k, F.lit(0)) for c, t in total.items()}
        px = px.select(*PLACE, *[idiv(total[c], norm).alias(c) for c in have])
    return px


#: Rows of a strip that is filtered by itself, besides the rows its windows reach into, and pixels filtered at once.
STRIP_ROWS = 256
PIXELS_AT_ONCE = 1 << 15


def _selected(width: int, height: int, index: int, n_channels: int, pixels_at_once: int):
    """Pixels of whole strips and of the rows around them -> the chosen value of each window of the strips.

    A column of histograms, one for each row of all strips at hand, slides over them: it gains the histograms of a column's vertical
    windows, which are differences of running counts, and loses those of the column that leaves. So a pixel costs the same for any window.
    """
    dx, dy = width // 2, height // 2

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["frame_id", "strip"], pixels_at_once):
            y, x, own = (t.column(c).to_numpy() for c in ("y", "x", "own"))
            same = same_as_before(t.column("frame_id").combine_chunks(), t.column("strip").combine_chunks())
            new_row = np.append(True, ~same | (y[1:] != y[:-1]))
            row, lead = np.cumsum(new_row) - 1, np.flatnonzero(new_row)
            span = int(y.max()) - int(y.min()) + height + 1
            at_row = np.append(0, np.cumsum(~same)).astype(np.int64)[lead] * span + y[lead] - int(y.min())
            low, high = np.searchsorted(at_row, at_row - dy), np.searchsorted(at_row, at_row + dy, "right")
            n_rows, x0 = len(lead), int(x.min())
            n_cols = int(x.max()) - x0 + 1
            order = np.argsort(x, kind="stable")
            edges = np.searchsorted(x[order] - x0, np.arange(n_cols + 1))
            kind = np.int16 if max(n_rows, width * height) < 1 << 15 else np.int32
            out = []
            for c in range(n_channels):
                value = t.column(f"c{c}").to_numpy()
                chosen = np.zeros(len(x), np.int32)
                held: dict[int, list[np.ndarray]] = {}
                total = [np.zeros((n_rows, bins), kind) for bins in (256, 16)]
                for k in range(n_cols + dx):
                    if k < n_cols:
                        at = order[edges[k] : edges[k + 1]]
                        held[k] = []
                        for sums, v in zip(total, (value[at], value[at] >> 4)):
                            counts = np.zeros((n_rows + 1, sums.shape[1]), kind)
                            counts[row[at] + 1, v] = 1  # a place holds one pixel
                            np.cumsum(counts, axis=0, out=counts)
                            held[k].append(counts[high] - counts[low])
                            sums += held[k][-1]
                    for sums, gone in zip(total, held.pop(k - width, ())):
                        sums -= gone
                    if k >= dx:
                        at = order[edges[k - dx] : edges[k - dx + 1]]
                        line = np.arange(len(at))
                        below = np.cumsum(total[1][row[at]], axis=1, dtype=np.int64)
                        rank = index * below[:, -1:] // (width * height)
                        tens = (below <= rank).sum(axis=1)  # of sixteens
                        rest = rank - np.where(tens > 0, below[line, tens - 1], 0)[:, None]
                        ones = np.cumsum(total[0].reshape(n_rows, 16, 16)[row[at], tens], axis=1, dtype=np.int64)
                        chosen[at] = 16 * tens + (ones <= rest).sum(axis=1)
                out.append(pa.array(chosen[own]))
            place = t.select(PLACE).filter(pa.array(own)).combine_chunks()
            yield pa.RecordBatch.from_arrays([*[c.combine_chunks() for c in place.columns], *out], names=[*PLACE, *names(n_channels)])

    return rows


def percentile_filter(px: DataFrame, width: int, height: int, index: int) -> DataFrame:
    """The index-th smallest value (from 0) of the window per channel; a clipped window of n takes index * n div (width * height).

    Values are 0 to 255. Strips of rows, with the rows around them that their windows reach, are filtered by themselves, so that a
    task holds a strip and not a frame; pixels dealt out by frame are not shuffled again. For the extremes `erode` and `dilate` are cheaper.
    """
    _odd(width, height)
    if width == height == 1:
        return px
    have, reach = channel_columns(px), height // 2
    rows = max(STRIP_ROWS, height)
    strip = lambda shift: F.floor((F.col("y") + shift) / rows)
    dealt = px.select(*PLACE, *have, F.explode(F.array_distinct(F.array(strip(0), strip(-reach), strip(reach)))).alias("strip"))
    dealt = dealt.withColumn("own", F.col("strip") == strip(0))
    kind = px.schema["frame_id"].dataType.simpleString()
    spread = dealt.select("frame_id", "strip", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), "own", *[F.col(c).cast("int").alias(c) for c in have])
    return in_order(spread, ["frame_id", "strip"], ["y", "x"]).mapInArrow(_selected(width, height, index, len(have), PIXELS_AT_ONCE), f"frame_id {kind}, y int, x int, " + ", ".join(f"{c} int" for c in have))


def median_filter(px: DataFrame, width: int, height: int) -> DataFrame:
    return percentile_filter(px, width, height, width * height // 2)


def _extreme(px: DataFrame, width: int, height: int, f) -> DataFrame:
    _odd(width, height)
    have = channel_columns(px)
    for along, size in (("y", height), ("x", width)):
        if size > 1:
            px = px.select(*PLACE, *[f(c).over(_line(along, size)).alias(c) for c in have])
    return px


def erode(px: DataFrame, width: int, height: int) -> DataFrame:
    """Minimum of the window."""
    return _extreme(px, width, height, F.min)


def dilate(px: DataFrame, width: int, height: int) -> DataFrame:
    """Maximum of the window."""
    return _extreme(px, width, height, F.max)
