"""Structured Streaming twins. Event time is ts_us; timers on the watermark drop what state no later row can need.

Order of arrival does not matter inside the watermark. Rows wait in state (RocksDB) until the watermark has passed them and are
then taken in order of event time, so a stream gives the rows of its batch twin up to the watermark whatever the files and
triggers were; a source that ends sends a heartbeat to give out the rest, as a row of the null key, which gets no result. One rule holds everywhere for late rows: what comes after the watermark has passed it is dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pixelspark.operators.telemetry import latest_per_key
from pixelspark.session import discard, shared_dir
from pixelspark.sources.frames import read_images

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """A Parquet folder, or one file, as a stream, one file after the other in a trigger each."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}*")  # a pattern matches a single file too


def replay(events: DataFrame, order: str, parts: int = 4) -> DataFrame:
    """events as a stream of that many slices in the order of a number, a column or an expression, so that state crosses micro-batches.

    Where the number is the time, no slice brings rows that are late after the one before. A slice is written side by side into the same number of files, a small one's number being made up by empty files, and is read in one trigger.
    """
    spark = events.sparkSession
    path = f"{shared_dir(spark)}-replay"
    at = F.expr(order)
    low, high = events.agg(F.min(at), F.max(at)).first()  # two numbers
    if low is None:
        slices = [events]
    else:
        step = (high - low) // parts + 1
        slices = [events.where(at.between(low + k * step, low + (k + 1) * step - 1)) for k in range(parts)]
    files = min(spark.sparkContext.defaultParallelism, 8)
    for k, part in enumerate(slices):
        part.repartition(files).write.mode("append").parquet(path)
        for _ in range(len(spark.read.schema(events.schema).parquet(path).inputFiles()), (k + 1) * files):
            spark.createDataFrame([], events.schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(f"{path}/")


def with_heartbeat(events: DataFrame, number: str, time: str, after: str) -> DataFrame:
    """events and one row after the last, of nulls but for its number and time: it moves the watermark past all of them, so that a stream that ends gives out its rest."""
    last = events.agg(F.max(number).alias(number), F.max(time).alias(time)).where(F.col(number).isNotNull())
    beat = {number: F.col(number) + 1, time: F.col(time) + F.expr(f"interval {after}")}
    return events.unionByName(last.select(*[beat.get(c, F.lit(None)).cast(t).alias(c) for c, t in events.dtypes]))


def tick_stream(events: DataFrame, *more: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    return events.select("event_id", F.concat(F.lit("cam-"), (F.col("user_id") % 8).cast("string")).alias("stream"), F.unix_micros(ts).alias("ts_us"), ts.alias("event_time"), *map(F.expr, more))


def _started(writer, spark: SparkSession):
    """Starts a stream with state in RocksDB, runs it over all that is there now, and returns its query."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, STATE_STORE)
    try:
        q = writer.trigger(availableNow=True).start()
        q.awaitTermination()
        return q
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there now and returns the rows of its Parquet sink."""
    spark = stream.sparkSession
    out = f"{shared_dir(spark)}-stream"
    _started(stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}-state").format("parquet").option("path", out), spark)
    return spark.read.schema(stream.schema).parquet(out)


def drain_batches(stream: DataFrame, each: Callable[[DataFrame], DataFrame], schema) -> DataFrame:
    """Runs a stream by foreachBatch: each turns a micro-batch into the rows kept of it. A batch that is repeated overwrites itself."""
    spark = stream.sparkSession
    out = f"{shared_dir(spark)}-batches"
    _started(stream.writeStream.option("checkpointLocation", f"{out}-state").foreachBatch(lambda df, n: each(df).write.mode("overwrite").parquet(f"{out}/batch={n}")), spark)
    return spark.read.schema(schema).parquet(f"{out}/batch=*")


FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def drain_images(spark: SparkSession, path: str, each: Callable[[DataFrame], DataFrame], schema: str, files_per_trigger: int = 1000) -> DataFrame:
    """Runs a stream of image files: each turns the images of a trigger, as read_images gives them, into rows.

    A trigger takes files_per_trigger files at most, whose names, no more, come to the driver; the images are read and decoded by tasks.
    """
    files = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).load(path)
    return drain_batches(files.select("path"), lambda df: each(read_images(spark, [r["path"] for r in df.collect()])), schema)


def drain_latest(stream: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key over the whole run, by an upsert sink: version n is version n - 1 with the last rows of batch n.

    Versions are named by batch numbers, so a repeated batch makes its version anew; older ones than the one before go.
    """
    spark = stream.sparkSession
    out, last = f"{shared_dir(spark)}-latest", [-1]
    version = lambda n: spark.read.schema(stream.schema).parquet(f"{out}/version={n}")

    def upsert(df: DataFrame, n: int) -> None:
        merged = latest_per_key(df.unionByName(version(n - 1)) if n else df, keys, order).select(stream.columns)
        merged.write.mode("overwrite").parquet(f"{out}/version={n}")
        if n > 1:
            discard(version(n - 2))
        last[0] = n

    _started(stream.writeStream.option("checkpointLocation", f"{out}-state").foreachBatch(upsert), spark)
    return version(last[0])


def drain_appended(stream: DataFrame, each: Callable[[DataFrame, DataFrame | None], DataFrame], schema: str) -> DataFrame:
    """Runs a stream into a table that grows: each turns a micro-batch and what the batches before it have added into the rows to add.

    Rows are kept by batch number, so a batch that is repeated sees what it saw and overwrites what it added.
    """
    spark = stream.sparkSession
    out = f"{shared_dir(spark)}-appended"

    def add(df: DataFrame, n: int) -> None:
        before = spark.read.schema(schema).parquet(*[f"{out}/batch={k}" for k in range(n)]) if n else None
        each(df, before).write.mode("overwrite").parquet(f"{out}/batch={n}")

    _started(stream.writeStream.option("checkpointLocation", f"{out}-state").foreachBatch(add), spark)
    return spark.read.schema(schema).parquet(f"{out}/batch=*")


class InOrder(StatefulProcessor):
    """Rows of a key, held until the watermark has passed them and then given to `take` in order of (ts_us, the other fields).

    State of a key: the rows that wait, in blocks that are an Arrow value each, named by their first time and a number; one timer, at the
    first of them; what a subclass holds. `take` gets ripe rows, many at a time, and a time (us): they are all that are left up to it. It
    returns the rows to give out and the time at which its own state can go, or None; `drop` removes that.
    """

    #: Rows of a block, and rows that are put in order at a time. Rows that come together are cut into blocks by time, so these overlap little.
    block, at_once = 1 << 13, 1 << 17

    def __init__(self, fields: str, out: list[str]):
        self.out = out
        kinds = {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}
        self.schema = pa.schema([(name, kinds[kind]) for name, kind in map(str.split, fields.split(", "))])
        self.names = self.schema.names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "first_us bigint, number bigint", "rows binary")
        self.blocks = handle.getValueState("blocks", "number bigint")
        self.timer = handle.getValueState("timer", "at_ms bigint")
        self.opened(handle)

    def opened(self, handle: StatefulProcessorHandle) -> None: ...

    def take(self, key: tuple, rows: pd.DataFrame, upto_us: int) -> tuple[pd.DataFrame, int | None]:
        raise NotImplementedError

    def drop(self) -> None: ...

    def _wake(self, at_ms: int | None) -> None:
        """Exactly one timer, at the given time or none."""
        old = self.timer.get()[0] if self.timer.exists() else None
        if old is not None and old != at_ms:
            self.handle.deleteTimer(old)
            self.timer.clear()
        if at_ms is not None and old != at_ms:
            self.handle.registerTimer(at_ms)
            self.timer.update((at_ms,))

    def _put(self, rows: pd.DataFrame) -> None:
        table = pa.Table.from_pandas(rows.sort_values("ts_us"), self.schema, preserve_index=False).replace_schema_metadata(None)
        number = self.blocks.get()[0] if self.blocks.exists() else 0
        for k in range(0, len(table), self.block):
            part, sink = table.slice(k, self.block), pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, self.schema) as writer:
                writer.write_table(part)
            self.waiting.updateValue((part.column("ts_us")[0].as_py(), number), (sink.getvalue().to_pybytes(),))
            number += 1
        self.blocks.update((number,))

    def _ripe(self, now_us: int) -> Iterator[tuple[pd.DataFrame, int]]:
        """Rows in order and the time up to which they are all that are left, at last now_us. Blocks are read and removed by their first times;
        rows that later blocks may precede are held, at least as many given out as stay held. What is not ripe goes back."""
        names = sorted(b for b in self.waiting.keys() if b[0] <= now_us)
        held, n, enough = [self.schema.empty_table().to_pandas()], 0, self.at_once
        for name, after in zip(names, [*names[1:], None]):
            held.append(pa.ipc.open_stream(self.waiting.getValue(name)[0]).read_pandas())
            self.waiting.removeKey(name)
            n += len(held[-1])
            if after is None or n < enough:
                continue
            rows = pd.concat(held, ignore_index=True)
            early = rows["ts_us"] < after[0]
            yield rows[early].sort_values(self.names, ignore_index=True), after[0] - 1
            held, n = [rows[~early]], int((~early).sum())
            enough = max(self.at_once, 2 * n)
        rows = pd.concat(held, ignore_index=True)
        early = rows["ts_us"] <= now_us
        yield rows[early].sort_values(self.names, ignore_index=True), now_us
        if not early.all():
            self._put(rows[~early])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first, held, n = None, [], 0
        for pdf in rows:
            if len(pdf) and not all(map(pd.isna, key)):  # rows of the null key only move the watermark
                first = min(int(pdf["ts_us"].min()), first) if first is not None else int(pdf["ts_us"].min())
                held.append(pdf[self.names])
                n += len(pdf)
                if n >= self.at_once:
                    self._put(pd.concat(held))
                    held, n = [], 0
        if held:
            self._put(pd.concat(held))
        if first is not None:
            at = -(-first // 1000)
            self._wake(min(at, self.timer.get()[0]) if self.timer.exists() else at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now_us = timerValues.getCurrentWatermarkInMs() * 1000
        self.timer.clear()
        until = None
        for rows, upto_us in self._ripe(now_us):
            out, until = self.take(key, rows, upto_us)
            if len(out):
                yield out[self.out]
        first = min((b[0] for b in self.waiting.keys()), default=None)
        if first is not None:
            self._wake(-(-first // 1000))
            return
        self.blocks.clear()
        if until is not None and until > now_us:
            self._wake(-(-until // 1000))
        else:
            self.drop()

    def close(self) -> None: ...


class RollingFps(InOrder):
    """State: the stream's first tick, one number, and the ticks of one window before the last, one value."""

    def __init__(self, window_us: int):
        super().__init__("ts_us bigint, event_id bigint", ["event_id", "stream", "ts_us", "fps"])
        self.window_us = window_us

    def opened(self, handle) -> None:
        self.first = handle.getValueState("first", "ts_us bigint")
        self.seen = handle.getValueState("seen", "times binary")

    def take(self, key, rows, upto_us):
        now = rows["ts_us"].to_numpy("int64")
        if len(now) and not self.first.exists():
            self.first.update((int(now[0]),))
        before = np.frombuffer(self.seen.get()[0] if self.seen.exists() else b"", "int64")
        times = np.concatenate([before, now])
        n = np.searchsorted(times, now, "right") - np.searchsorted(times, now - self.window_us, "left")
        elapsed = np.minimum(self.window_us, now - (self.first.get()[0] if self.first.exists() else 0))
        rate = np.where(elapsed > 0, n / np.maximum(elapsed, 1) * 1e6, np.nan)
        kept = times[times > upto_us - self.window_us]
        if len(kept):
            self.seen.update((kept.tobytes(),))
        else:
            self.seen.clear()
        out = pd.DataFrame({"event_id": rows["event_id"].astype("int64"), "stream": key[0], "ts_us": now, "fps": rate})
        return out, int(kept[-1]) + self.window_us if len(kept) else None

    def drop(self) -> None:
        self.seen.clear()


def rolling_fps_stream(ticks: DataFrame, window_us: int, delay: str) -> DataFrame:
    """(event_id, stream, ts_us, fps) of each tick that the watermark has passed: as the batch twin."""
    slim = ticks.withWatermark("event_time", delay).select("stream", "ts_us", "event_id", "event_time")
    return slim.groupBy("stream").transformWithStateInPandas(RollingFps(window_us), "event_id bigint, stream string, ts_us bigint, fps double", "append", "eventTime")


class Throttle(InOrder):
    """State: the time of the last row kept, until a gap has passed."""

    def __init__(self, keys: list[str], min_gap_us: int):
        super().__init__("ts_us bigint, event_id bigint", ["event_id", *keys, "ts_us"])
        self.keys, self.min_gap_us = keys, min_gap_us

    def opened(self, handle) -> None:
        self.last = handle.getValueState("last", "ts_us bigint")

    def take(self, key, rows, upto_us):
        times = rows["ts_us"].to_numpy("int64")
        last = self.last.get()[0] if self.last.exists() else None
        kept, at = [], 0 if last is None else int(np.searchsorted(times, last + self.min_gap_us))
        while at < len(times):  # a step for each row kept
            kept.append(at)
            last = int(times[at])
            at = int(np.searchsorted(times, last + self.min_gap_us))
        if kept:
            self.last.update((last,))
        out = rows.iloc[kept].astype("int64").assign(**dict(zip(self.keys, key)))
        return out, last + self.min_gap_us if last is not None else None

    def drop(self) -> None:
        self.last.clear()


def throttle_stream(ticks: DataFrame, min_gap_us: int, delay: str, keys: tuple[str, ...] = ("stream",)) -> DataFrame:
    """(event_id, keys, ts_us) of the rows that a greedy minimum gap keeps of each key, of those that the watermark has passed: as the batch twin."""
    keys = list(keys)
    slim = ticks.withWatermark("event_time", delay).select(*keys, "ts_us", "event_id", "event_time")
    schema = "event_id bigint, " + ", ".join(f"{k} {slim.schema[k].dataType.simpleString()}" for k in keys) + ", ts_us bigint"
    return slim.groupBy(*keys).transformWithStateInPandas(Throttle(keys, min_gap_us), schema, "append", "eventTime")


class StickyType(InOrder):
    """State: a topic's first type, one word, kept for as long as the stream runs; until it is known, the messages that wait."""

    def __init__(self):
        super().__init__("ts_us bigint, type string, value double", ["topic", "ts_us", "type", "value"])

    def opened(self, handle) -> None:
        self.first = handle.getValueState("first", "type string")

    def handleInputRows(self, key, rows, timerValues):
        if not self.first.exists():
            yield from super().handleInputRows(key, rows, timerValues)
            return
        for pdf in rows:
            yield pdf.loc[pdf["type"] == self.first.get()[0], self.out]

    def take(self, key, rows, upto_us):
        if not len(rows):
            return rows, None
        if not self.first.exists():
            self.first.update((rows["type"][0],))
        return rows[rows["type"] == self.first.get()[0]].assign(topic=key[0]), None


def sticky_type_stream(messages: DataFrame, delay: str) -> DataFrame:
    """(topic, ts_us, type, value) of the type of a topic's first message, which is known once the watermark has passed that."""
    slim = messages.withWatermark("event_time", delay).select("topic", "ts_us", "type", "value", "event_time")
    return slim.groupBy("topic").transformWithStateInPandas(StickyType(), "topic string, ts_us bigint, type string, value double", "append", "eventTime")


def gather_stream(ticks: DataFrame, window: str, delay: str) -> DataFrame:
    """Values of each stream gathered per event-time window; a group closes when the watermark passes it."""
    grouped = ticks.withWatermark("event_time", delay).groupBy("stream", F.window("event_time", window).alias("w"))
    return grouped.agg(F.count("*").alias("n"), F.max_by("event_id", "ts_us").alias("last_event")).select("stream", F.unix_micros("w.start").alias("start_us"), "n", "last_event")


def keep_newest_stream(frames: DataFrame, k: int, slot: str, delay: str) -> DataFrame:
    """The k newest frames of each stream in every slot of event time: what an overloaded run admits. A slot is given out when the watermark passes its end.

    State of a slot: its ticks (numbers, no images).
    """
    grouped = frames.withWatermark("event_time", delay).groupBy("stream", F.window("event_time", slot).alias("w"))
    newest = F.slice(F.sort_array(F.collect_list(F.struct("ts_us", "event_id")), asc=False), 1, k)
    return grouped.agg(newest.alias("kept")).select("stream", F.explode("kept").alias("f")).select("f.event_id", "stream", "f.ts_us")


def suppress_repeats(events: DataFrame, keys: list[str], repeat_us: int, delay: str) -> DataFrame:
    """(event_id, keys, ts_us): an event is given out unless one of its key was less than repeat_us before it."""
    return throttle_stream(events, repeat_us, delay, tuple(keys))
