"""Frame rates and throttling over ticks (stream, ts_us).

A stream may hold most ticks of a table, so nothing here orders a whole stream in one task: ticks are dealt out by stream and
time bucket, a bucket sees the ticks of the bucket before it where a window reaches back, and what crosses buckets is one
small row per bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelspark.session import discard, written

from .groups import in_order

BUCKET_US = 3_600_000_000
CHUNK_GAPS = 256
BUCKET_CHUNKS = 256


def _bucketed(ticks: DataFrame, bucket_us: int, halo: bool = False) -> DataFrame:
    """ticks with their time bucket; with halo each one also stands, marked, in the bucket after its own."""
    own = F.expr(f"cast(floor(ts_us / {bucket_us}) as bigint)")
    if not halo:
        return ticks.withColumn("_bucket", own)
    return ticks.withColumn("_halo", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn("_bucket", own + F.col("_halo").cast("int"))


def intervals(ticks: DataFrame, bucket_us: int = BUCKET_US) -> DataFrame:
    """gap_us: the time since the stream's tick before; null at its first. A bucket's first tick looks to the last of the bucket before that has any."""
    cut = _bucketed(ticks, bucket_us)
    ends = cut.groupBy("stream", "_bucket").agg(F.max("ts_us").alias("_end"))
    before = ends.withColumn("_before", F.lag("_end").over(Window.partitionBy("stream").orderBy("_bucket"))).select("stream", "_bucket", "_before")  # a row per bucket
    w = Window.partitionBy("stream", "_bucket").orderBy("ts_us")
    joined = cut.join(before, ["stream", "_bucket"]).withColumn("gap_us", F.col("ts_us") - F.coalesce(F.lag("ts_us").over(w), F.col("_before")))
    return joined.select(*ticks.columns, "gap_us")


def _reach(window_us: int) -> Column:
    """Of a bucketed tick with halo: its own time, or for one of the bucket before the last time whose window reaches back to it.

    A window of a bucket's length is thus all own ticks up to its time and all others from its time on: running sums and extremes
    from either end, which cost the same for any number of ticks to a window.
    """
    return F.col("ts_us") + F.when(F.col("_halo"), F.lit(window_us)).otherwise(F.lit(0))


def rolling_fps(ticks: DataFrame, window_us: int = 10_000_000) -> DataFrame:
    """fps at each tick: ticks in (ts - window, ts] inclusive of the edge, over the elapsed time up to the window; null at a stream's first tick."""
    cut = _bucketed(ticks, window_us, halo=True).withColumn("_at", _reach(window_us))
    bucket = Window.partitionBy("stream", "_bucket")
    until, own = bucket.orderBy("_at").rangeBetween(Window.unboundedPreceding, 0), F.count_if(~F.col("_halo"))
    since = bucket.orderBy(F.desc("_at")).rangeBetween(Window.unboundedPreceding, 0)
    counted = cut.withColumn("_n", own.over(until)).withColumn("_n", F.col("_n") + F.count_if("_halo").over(since)).where("not _halo")
    first = ticks.groupBy("stream").agg(F.min("ts_us").alias("_first"))  # a row per stream
    elapsed = F.least(F.lit(window_us), F.col("ts_us") - F.col("_first"))
    return counted.join(first, "stream").withColumn("fps", F.col("_n") / F.nullif(elapsed, F.lit(0)) * 1e6).select(*ticks.columns, "fps")


def fps_extremes(ticks: DataFrame, window_us: int = 10_000_000) -> DataFrame:
    """fps_min and fps_max: one over the longest and the shortest gap between ticks inside the window; 0 for under two ticks or a zero gap.

    A gap stands at the tick it begins at: those that begin inside the window, before its last time, end inside it too.
    """
    bucket = Window.partitionBy("stream", "_bucket")
    by_time = bucket.orderBy("ts_us")
    own = F.when(~F.col("_halo"), F.col("_gap"))
    before = by_time.rangeBetween(Window.unboundedPreceding, -1)
    cut = _bucketed(ticks, window_us, halo=True).withColumn("_gap", F.lead("ts_us").over(by_time) - F.col("ts_us")).withColumn("_tied", F.col("_gap").eqNullSafe(0) | F.lag("ts_us").over(by_time).eqNullSafe(F.col("ts_us")))
    cut = cut.withColumn("_longest", F.max(own).over(before)).withColumn("_shortest", F.min(own).over(before)).withColumn("_at", _reach(window_us))
    since = bucket.orderBy(F.desc("_at")).rangeBetween(Window.unboundedPreceding, 0)
    old = F.when(F.col("_halo"), F.col("_gap"))
    tie = F.when(F.col("_tied"), F.lit(0))
    longest, shortest = F.greatest("_longest", F.max(old).over(since)), F.least("_shortest", F.min(old).over(since))
    seen = cut.withColumn("_longest", F.coalesce(longest, tie)).withColumn("_shortest", F.coalesce(tie, shortest)).where("not _halo")
    rate = lambda gap: F.coalesce(F.when(gap > 0, 1e6 / gap), F.lit(0.0))
    return seen.select(*ticks.columns, rate(F.col("_longest")).alias("fps_min"), rate(F.col("_shortest")).alias("fps_max"))


def fps_pretty(low: Column, high: Column, fps: Column) -> Column:
    return F.format_string("%.2f/%.2f/%.2f FPS", low, high, fps)


def following(t: np.ndarray, min_gap_us: int) -> tuple[np.ndarray, np.ndarray]:
    """For sorted times the place of the next one a gap later (len(t) for none), and of the last one that steps of these lead to."""
    after = np.searchsorted(t, t + min_gap_us)
    last = np.where(after < len(t), after, np.arange(len(t)))
    while (further := last[last]).tolist() != last.tolist():  # each round squares the steps taken
        last = further
    return after, last


def _entries(chunk_us: int, min_gap_us: int):
    """A chunk's times -> those at which a throttled stream can enter it, and the last time it keeps in the chunk from there."""

    def rows(table: pa.Table) -> pa.Table:
        t = np.unique(table.column("ts_us").to_numpy())
        start = table.column("chunk")[0].as_py() * chunk_us
        _, last = following(t, min_gap_us)
        n = min(len(t), int(np.searchsorted(t, start + min_gap_us)) + 1)  # the last kept time lies before the chunk, so a gap later is within its first gap
        return pa.table({"stream": table.column("stream").slice(0, 1), "chunk": table.column("chunk").slice(0, 1), "entries": pa.array([t[:n]], pa.list_(pa.int64())), "ends": pa.array([t[last[:n]]], pa.list_(pa.int64()))})

    return rows


def _through(last: np.ndarray, maps: list[tuple[np.ndarray, np.ndarray]], min_gap_us: int) -> np.ndarray:
    """The last times kept after the maps (entries, ends) in order, each from a last time kept before."""
    for entries, ends in maps:
        k = np.searchsorted(entries, last + min_gap_us)
        inside = k < len(entries)
        last = np.where(inside, ends[np.minimum(k, len(entries) - 1)], last)
    return last


def _maps_of(table: pa.Table, by: str) -> tuple[list[int], list[tuple[np.ndarray, np.ndarray]]]:
    table = table.sort_by(by)
    return table.column(by).to_pylist(), [(e.values.to_numpy(), f.values.to_numpy()) for e, f in zip(table.column("entries"), table.column("ends"))]


def _composed(chunk_us: int, min_gap_us: int):
    """The maps of a bucket's chunks -> the map of the bucket, from the times at which it can be entered."""

    def rows(table: pa.Table) -> pa.Table:
        chunks, maps = _maps_of(table, "chunk")
        entries = maps[0][0]
        if len(maps) > 1 and entries[-1] < chunks[0] * chunk_us + min_gap_us:  # a stream may be let into the next chunk first
            entries = np.append(entries, maps[1][0][0])
        ends = _through(entries - min_gap_us, maps, min_gap_us)
        return pa.table({"stream": table.column("stream").slice(0, 1), "bucket": table.column("bucket").slice(0, 1), "entries": pa.array([entries], pa.list_(pa.int64())), "ends": pa.array([ends], pa.list_(pa.int64()))})

    return rows


def _walk(min_gap_us: int):
    """Maps of buckets, in order of stream and time -> the last time kept before each bucket (null before a stream's first)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, None
        for batch in batches:
            before: list[int | None] = []
            for stream, entries, ends in zip(batch.column("stream").to_pylist(), batch.column("entries"), batch.column("ends")):
                if stream != now:
                    now, last = stream, None
                before.append(last)
                entries, ends = entries.values.to_numpy(), ends.values.to_numpy()
                k = 0 if last is None else int(np.searchsorted(entries, last + min_gap_us))
                if k < len(entries):
                    last = int(ends[k])
            yield pa.RecordBatch.from_arrays([batch.column("stream"), batch.column("bucket"), pa.array(before, pa.int64())], names=["stream", "bucket", "before"])

    return rows


def _entered(min_gap_us: int):
    """The maps of a bucket's chunks and the last time kept before the bucket -> the time at which each chunk is entered."""

    def rows(table: pa.Table) -> pa.Table:
        chunks, maps = _maps_of(table, "chunk")
        last, out = table.column("before")[0].as_py(), []
        for chunk, (entries, ends) in zip(chunks, maps):
            k = 0 if last is None else int(np.searchsorted(entries, last + min_gap_us))
            if k < len(entries):
                last = int(ends[k])
                out.append((chunk, int(entries[k])))
        stream = pa.array(table.column("stream").slice(0, 1).to_pylist() * len(out), pa.string())
        return pa.table({"stream": stream, "chunk": pa.array([r[0] for r in out], pa.int64()), "entry": pa.array([r[1] for r in out], pa.int64())})

    return rows


def _kept(min_gap_us: int, columns: list[str]):
    """A chunk's rows and its entry -> the rows kept."""

    def rows(table: pa.Table) -> pa.Table:
        order = pc.sort_indices(table, [(c, "ascending") for c in ("ts_us", *[c for c in columns if c not in ("stream", "ts_us")])], null_placement="at_start")
        table = table.take(order)
        times = table.column("ts_us").to_numpy()
        k, kept = int(np.searchsorted(times, table.column("entry")[0].as_py())), []
        while k < len(times):
            kept.append(k)
            k = int(np.searchsorted(times, times[k] + min_gap_us))
        return table.take(pa.array(kept, pa.int64())).select(columns)

    return rows


def throttle(ticks: DataFrame, min_gap_us: int) -> DataFrame:
    """The ticks that a greedy minimum gap keeps: the first of a stream, then each at least min_gap_us after the last kept; of ticks at one time the least row.

    Streams are cut into chunks of CHUNK_GAPS gaps. A chunk is a map from the time it is entered at to the last time it keeps. Maps
    are composed as a tree: BUCKET_CHUNKS of them to the map of a bucket, buckets side by side; only bucket maps are taken in order
    of their stream, one number after the other; then every bucket tells where its chunks are entered, and every chunk is filtered
    by itself, with whole rows. So no task holds a stream, and the one pass in order reads a row for CHUNK_GAPS * BUCKET_CHUNKS gaps.
    """
    if min_gap_us <= 0:
        return ticks
    chunk_us = CHUNK_GAPS * min_gap_us
    dealt = ticks.withColumn("stream", F.col("stream").cast("string")).withColumn("_chunk", F.expr(f"cast(floor(ts_us / {chunk_us}) as bigint)"))
    lists = "entries array<bigint>, ends array<bigint>"
    maps = dealt.select("stream", "ts_us", F.col("_chunk").alias("chunk")).groupBy("stream", "chunk").applyInArrow(_entries(chunk_us, min_gap_us), f"stream string, chunk bigint, {lists}")
    maps = written(maps.withColumn("bucket", F.expr(f"cast(floor(chunk / {BUCKET_CHUNKS}) as bigint)")), "maps")
    buckets = maps.groupBy("stream", "bucket").applyInArrow(_composed(chunk_us, min_gap_us), f"stream string, bucket bigint, {lists}")
    before = in_order(buckets, ["stream"], ["bucket"]).drop("_place").mapInArrow(_walk(min_gap_us), "stream string, bucket bigint, before bigint")
    entered = written(maps.join(before, ["stream", "bucket"]).groupBy("stream", "bucket").applyInArrow(_entered(min_gap_us), "stream string, chunk bigint, entry bigint"), "entered")
    discard(maps)
    chosen = dealt.withColumnRenamed("_chunk", "chunk").join(entered, ["stream", "chunk"]).groupBy("stream", "chunk")
    return chosen.applyInArrow(_kept(min_gap_us, ticks.columns), ticks.withColumn("stream", F.col("stream").cast("string")).schema)


def stream_stats(ticks: DataFrame) -> DataFrame:
    """(stream, frames, min_gap_us, max_gap_us, mean_gap_us)."""
    return intervals(ticks).groupBy("stream").agg(F.count("*").alias("frames"), F.min("gap_us").alias("min_gap_us"), F.max("gap_us").alias("max_gap_us"), F.avg("gap_us").alias("mean_gap_us"))


def latest_per_key(images: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key; of rows at one time the greatest by the other columns."""
    rest = [c for c in images.columns if c not in keys]
    return images.groupBy(*keys).agg(F.max(F.struct(order, *[c for c in rest if c != order])).alias("r")).select(*keys, *[f"r.{c}" for c in rest])


def keep_newest(frames: DataFrame, k: int) -> DataFrame:
    """The k newest rows of each stream: what an overloaded run takes of a batch; of rows at one time the greatest by the other columns."""
    w = Window.partitionBy("stream").orderBy(F.desc("ts_us"), *[F.desc(c) for c in frames.columns if c not in ("stream", "ts_us")])
    return frames.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")


def debug_events(df: DataFrame, noisy: bool = False) -> DataFrame:
    """Logged events; quiet logging keeps one of each (component, file, line)."""
    return df if noisy else df.dropDuplicates(["component", "file", "line"])
