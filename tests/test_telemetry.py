"""Goldens of branching, geometry, detections and telemetry."""

import math

import pytest
from pyspark.sql import functions as F

from pixelspark.functions import geometry as g
from pixelspark.operators import branching as br
from pixelspark.operators import detections as dt
from pixelspark.operators import telemetry as te
from pixelspark.operators import topics as tp
from pixelspark.streaming import streams as st

NESTED = [[1, 2, 3], [4, 5, 6], [7, 8, 9]]


def nested(spark):
    df = spark.createDataFrame([([0], NESTED)], "run_id array<bigint>, v array<array<int>>")
    return br.broadcast_vec(br.broadcast_vec(df, "v", "inner"), "inner", "x")


def test_nested_gather(spark):
    assert br.collect_vec(nested(spark), "x", 1, True).first()["values"] == list(range(1, 10))
    assert sorted(r["values"] for r in br.collect_vec(nested(spark), "x", 2, True).collect()) == NESTED
    assert br.select_last(nested(spark), "x", 1).first()["value"] == 9
    assert br.select_first(nested(spark), "x", 1).first()["value"] == 1


def test_runs_are_numbered_over_partitions(spark):
    df = spark.range(1000).selectExpr("id", "(id * 37) % 1000 as at", "concat('s', id % 3) as stream").repartition(5)
    assert sorted((r["at"], r["run_id"][0]) for r in br.assign_runs(df, ["at"]).collect()) == [(i, i) for i in range(1000)]
    got = br.assign_runs(df, ["at"], "stream").collect()
    for s in ("s0", "s1", "s2"):
        mine = sorted((r["at"], r["run_id"][0]) for r in got if r["stream"] == s)
        assert [n for _, n in mine] == list(range(len(mine)))
    assert br.assign_runs(df.limit(0), ["at"]).count() == 0


def test_empty_groups_survive_a_reference(spark):
    ref = spark.createDataFrame([([0, i],) for i in range(4)], "run_id array<bigint>")
    got = {tuple(r["run_id"]): r["values"] for r in br.collect_by_reference(ref, nested(spark), "x", 2).collect()}
    assert got[(0, 3)] == [] and got[(0, 1)] == [4, 5, 6]


def test_membership(spark):
    df = spark.createDataFrame([([1, 2, 3], i) for i in (1, 2, 3)], "vec array<int>, elem int")
    assert br.contains(df, "vec", "elem").where("found").count() == 3


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


def arr(*v):
    return F.array(*[F.lit(float(x)) for x in v])


def test_geometry_goldens(spark):
    close = lambda a, b: all(abs(x - y) < 1e-10 for x, y in zip(a, b))
    assert one(spark, g.dot(arr(1, 2, 3), arr(4, 5, 6))) == 32
    assert one(spark, g.length(arr(3, 4, 0))) == 5
    m = arr(2, 0, 0, 0, 3, 0, 0, 0, 4)
    assert one(spark, g.det(m)) == 24
    assert close(one(spark, g.inverse(m)), [0.5, 0, 0, 0, 1 / 3, 0, 0, 0, 0.25])
    assert one(spark, g.inverse(arr(*[1] * 9))) is None
    assert one(spark, g.scale(m)) == [2, 3, 4] and one(spark, g.without_scale(m)) == g.EYE
    z90 = arr(0, -1, 0, 1, 0, 0, 0, 0, 1)
    assert close(one(spark, g.to_quat(z90)), [0, 0, math.sqrt(0.5), math.sqrt(0.5)])
    assert close(one(spark, g.to_euler(z90)), [0, 0, math.pi / 2])
    assert close(one(spark, g.mul_mat(z90, z90)), [-1, 0, 0, 0, -1, 0, 0, 0, 1])
    assert close(one(spark, g.mul_vec(z90, arr(1, 0, 0))), [0, 1, 0])


@pytest.mark.parametrize("angles", [(3.0, 0.2, 0.1), (0.1, 3.0, 0.2), (0.2, 0.1, 3.0), (0.4, 0.3, -0.2)])
def test_quaternion_branches_rotate_alike(spark, angles):
    m = g.from_euler(*[F.lit(a) for a in angles])
    x, y, z, w = one(spark, g.to_quat(m))
    got = [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)]
    assert all(abs(a - b) < 1e-9 for a, b in zip(got, one(spark, m)[:3]))


def test_gimbal_lock(spark):
    e = one(spark, g.to_euler(g.from_euler(F.lit(0.3), F.lit(math.pi / 2), F.lit(0.0))))
    assert e[2] == 0 and abs(e[0] - 0.3) < 1e-6


def test_match_detections(spark):
    kind = "image string, id int, corners array<double>"
    a = spark.createDataFrame([("p", 1, [0.0, 0.0]), ("p", 2, [5.0, 5.0]), ("q", 1, [1.0, 1.0])], kind)
    b = spark.createDataFrame([("p", 1, [0.9, 0.0]), ("p", 2, [6.1, 5.0]), ("r", 4, [0.0, 0.0])], kind)
    got = sorted((r["image"], r["id"], r["status"]) for r in dt.match_detections(a, b).collect())
    assert got == [("p", 1, "matched"), ("p", 2, "extra"), ("p", 2, "missed"), ("q", 1, "missed"), ("r", 4, "extra")]


def test_throttle_is_the_sequential_rule(spark):
    import random

    rng = random.Random(4)
    rows = [(i, f"s{rng.randint(0, 2)}", rng.randint(0, 400)) for i in range(300)]
    got = sorted(r["event_id"] for r in te.throttle(spark.createDataFrame(rows, "event_id bigint, stream string, ts_us bigint"), 10).collect())
    kept, last = [], {}
    for i, s, t in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        if s not in last or t - last[s] >= 10:
            last[s] = t
            kept.append(i)
    assert got == sorted(kept)


@pytest.mark.parametrize("gap,span", [(3, 5_000), (10, 400), (700, 300_000)])
def test_throttle_over_many_chunks(spark, gap, span, monkeypatch):
    """Dense and sparse streams whose whole history is one run without a pause, cut into small chunks."""
    import random

    monkeypatch.setattr(te, "CHUNK_GAPS", 4)
    monkeypatch.setattr(te, "BUCKET_CHUNKS", 5)
    rng = random.Random(gap)
    rows = [(i, f"s{i % 3}", rng.randint(-span, span)) for i in range(3000)]
    got = {r["event_id"] for r in te.throttle(spark.createDataFrame(rows, "event_id bigint, stream string, ts_us bigint"), gap).collect()}
    kept, last = set(), {}
    for i, s, t in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        if s not in last or t - last[s] >= gap:
            last[s] = t
            kept.add(i)
    assert got == kept


def test_throttle_of_one_dense_stream(spark):
    """10,000,000 ticks of one stream within 3,000 gaps: what is kept is known."""
    ticks = spark.range(10_000_000).select(F.col("id").alias("event_id"), F.lit("s").alias("stream"), (F.col("id") * 3).alias("ts_us"))
    got = te.throttle(ticks, 10_000).agg(F.count("*"), F.sum(F.col("ts_us") % 10_002)).first()
    assert tuple(got) == (-(-10_000_000 * 3 // 10_002), 0)


def test_windows_over_buckets(spark):
    """Rates, extremes and gaps against plain lists, with ties, long silences and negative times."""
    import random

    rng = random.Random(9)
    rows = [(i, f"s{i % 2}", rng.choice([-5000, 0, 90_000]) + rng.randint(0, 600)) for i in range(500)]
    ticks, window = spark.createDataFrame(rows, "event_id bigint, stream string, ts_us bigint"), 100
    fps = {r["event_id"]: r["fps"] for r in te.rolling_fps(ticks, window).collect()}
    ends = {r["event_id"]: (r["fps_min"], r["fps_max"]) for r in te.fps_extremes(ticks, window).collect()}
    gaps = sorted((r["stream"], r["ts_us"], r["gap_us"] if r["gap_us"] is not None else -1) for r in te.intervals(ticks, 50).collect())
    want_gaps = []
    for s in ("s0", "s1"):
        t = sorted(r[2] for r in rows if r[1] == s)
        want_gaps += [(s, b, b - a) for a, b in zip(t, t[1:])] + [(s, t[0], -1)]
        for i, _, now in (r for r in rows if r[1] == s):
            near = [x for x in t if now - window <= x <= now]
            elapsed = min(window, now - t[0])
            assert fps[i] == (pytest.approx(len(near) / elapsed * 1e6) if elapsed else None)
            between = [b - a for a, b in zip(near, near[1:])]
            rate = lambda g: 1e6 / g if g else 0.0
            assert ends[i] == pytest.approx((rate(max(between)), rate(min(between))) if between else (0.0, 0.0))
    assert gaps == sorted(want_gaps)


def test_crowded_windows_take_linear_time(spark):
    """400,000 ticks of one stream, 100,000 to a window: what each sees is known, and no window is gone through again for each tick."""
    import time

    window = 1_000_000
    ticks = spark.range(400_000).select(F.col("id").alias("event_id"), F.lit("s").alias("stream"), (F.col("id") * 10).alias("ts_us"))
    began = time.time()
    assert te.rolling_fps(ticks, window).where("ts_us >= 1000000").agg(F.min("fps"), F.max("fps")).first()[:] == (pytest.approx(100_001), pytest.approx(100_001))
    slow = ticks.withColumn("ts_us", F.expr("ts_us + if(event_id >= 150000, 7, 0)"))
    got = te.fps_extremes(slow, window).agg(F.count_if(F.abs(F.col("fps_min") - 1e6 / 17) < 1e-6), F.count_if(F.abs(F.col("fps_max") - 1e5) < 1e-6)).first()
    assert got[:] == (99_999, 399_999)  # the longer gap begins at 1,499,990
    assert time.time() - began < 60


def test_gathering_takes_many_prefixes_at_once(spark):
    """Two keys with nulls, a long prefix and many short ones: each is whole, and calls are far fewer than prefixes."""
    import numpy as np
    import pyarrow as pa

    from pixelspark.functions import udf

    df = spark.range(60_000).selectExpr("if(id < 30000, null, if(id % 3 = 0, 'a', 'b')) as stream", "id div 20 * cast(id >= 40000 as int) as run", "id").repartition(5)

    def many(t: pa.Table, first: np.ndarray) -> pa.Table:
        return pa.table({"stream": t.column("stream").take(pa.array(first)), "run": t.column("run").take(pa.array(first)), "n": pa.array(np.diff(np.append(first, t.num_rows))), "least": pa.array(np.minimum.reduceat(t.column("id").to_numpy(), first)), "call": pa.array(np.full(len(first), int(t.column("id")[0].as_py())))})

    def one(t: pa.Table) -> pa.Table:
        return pa.table({"stream": t.column("stream").slice(0, 1), "run": t.column("run").slice(0, 1), "n": pa.array([t.num_rows]), "least": pa.array([min(t.column("id").to_pylist())]), "call": pa.array([0])})

    kind, keys = "stream string, run bigint, n bigint, least bigint, call bigint", ["stream", "run"]
    want = sorted((tuple(r) for r in df.groupBy(*keys).agg(F.count("*"), F.min("id")).collect()), key=str)
    got = udf.gathering(df, keys, many, kind).collect()
    assert sorted((tuple(r)[:4] for r in got), key=str) == want
    assert len(want) > 2000 and len({r["call"] for r in got}) <= 8
    assert sorted((tuple(r)[:4] for r in udf.gathering(df, keys, udf.each(one), kind).collect()), key=str) == want


def test_newest_rows_of_every_batch(spark):
    """The newest frames of each stream of every drained batch."""
    rows = [(i, f"s{i % 2}", "c", 1000 + i // 2) for i in range(40)]
    frames = spark.createDataFrame(rows, "event_id bigint, stream string, component string, ts_us bigint")
    got = st.drain_batches(st.replay(frames, "event_id"), lambda df: te.keep_newest(df.select("event_id", "stream", "ts_us"), 2), "event_id bigint, stream string, ts_us bigint")
    assert sorted(r["event_id"] for r in got.collect()) == [i for b in range(4) for i in range(10 * b + 6, 10 * b + 10)]


def timed(spark, rows):
    return spark.createDataFrame(rows, "event_id bigint, stream string, ts_us bigint").withColumn("event_time", F.timestamp_micros("ts_us"))


def test_streams_with_late_ticks_and_silences(spark):
    """A stream that falls silent for longer than its state is held, and ticks out of order inside a batch."""
    times = [5, 3, 9, 12, 41, 40, 905, 900, 902, 2000, 2003, 2001]
    rows = [(i, "s", t * 1_000_000) for i, t in enumerate(times)]
    ticks = timed(spark, [*rows, (len(rows), None, 3_000_000_000)])  # the last one is a heartbeat
    alone = timed(spark, rows).drop("event_time")
    batch = {r["event_id"]: r["fps"] for r in te.rolling_fps(alone, 10_000_000).collect()}
    stream = {r["event_id"]: r["fps"] for r in st.drain(st.rolling_fps_stream(st.replay(ticks, "event_id"), 10_000_000, "5 seconds")).collect()}
    assert stream == {i: pytest.approx(v) if v is not None else None for i, v in batch.items()}
    kept = sorted(r["event_id"] for r in st.drain(st.throttle_stream(st.replay(ticks, "event_id"), 3_000_000, "5 seconds")).collect())
    assert kept == sorted(r["event_id"] for r in te.throttle(alone, 3_000_000).collect())


@pytest.mark.parametrize("n_files", [1, 4, 16])
def test_streams_do_not_depend_on_files(spark, few_partitions, n_files):
    """Arrivals shuffled inside the watermark and dealt over 1, 4 and 16 triggers; every stream equals its batch twin, and its state goes after a silence."""
    import random

    from pixelspark.session import shared_dir

    rng = random.Random(3)
    rows = [(i, f"s{rng.randint(0, 2)}", i * 700_000 + rng.randint(-4_000_000, 4_000_000) + 10_000_000) for i in range(400)]
    rows = [(i, s, t, "c" if i % 3 else "d", "int" if rng.random() < 0.4 else "double", float(i)) for i, s, t in rows]
    kind = "event_id bigint, stream string, ts_us bigint, component string, type string, value double"
    path = f"{shared_dir(spark)}-arrivals"
    step = -(-len(rows) // n_files)
    beats = [[(len(rows) + k, None, (400 + 40 * k) * 1_000_000, None, None, None)] for k in (0, 1)]
    for part in [*(rows[k : k + step] for k in range(0, len(rows), step)), *beats]:
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(path)
    events = lambda: st.event_stream(spark, path, kind).withColumn("event_time", F.timestamp_micros("ts_us"))
    all_rows = spark.createDataFrame(rows, kind)
    pairs = lambda df, *c: sorted((tuple(r) for r in df.select(*c).collect()), key=str)
    alone = all_rows.select("event_id", "stream", "ts_us")
    assert pairs(st.drain(st.rolling_fps_stream(events(), 6_000_000, "10 seconds")).withColumn("fps", F.round("fps", 9)), "event_id", "stream", "fps") == pairs(te.rolling_fps(alone, 6_000_000).withColumn("fps", F.round("fps", 9)), "event_id", "stream", "fps")
    assert pairs(st.drain(st.throttle_stream(events(), 3_000_000, "10 seconds")), "event_id", "stream", "ts_us") == pairs(te.throttle(alone, 3_000_000), "event_id", "stream", "ts_us")
    assert spark.streams.active == []
    latest = st.drain_latest(events().where("stream is not null").select("stream", "component", "event_id", "ts_us"), ["stream", "component"], "ts_us")
    assert pairs(latest, *latest.columns) == pairs(te.latest_per_key(all_rows.select("stream", "component", "event_id", "ts_us"), ["stream", "component"], "ts_us"), *latest.columns)
    if n_files == 16:
        return
    topics = lambda df: df.withColumn("topic", F.concat("stream", "component"))
    assert pairs(st.drain(st.sticky_type_stream(topics(events()), "10 seconds")), "topic", "ts_us", "type", "value") == pairs(tp.sticky_types(topics(all_rows).select("topic", "ts_us", "type", "value")), "topic", "ts_us", "type", "value")
    want, last = [], {}
    for i, s, t, c, *_ in sorted(rows, key=lambda r: (r[2], r[0])):
        if (s, c) not in last or t - last[s, c] >= 5_000_000:
            last[s, c] = t
            want.append((i, s, c, t))
    assert pairs(st.drain(st.suppress_repeats(events(), ["stream", "component"], 5_000_000, "10 seconds")), "event_id", "stream", "component", "ts_us") == sorted(want, key=str)
    slots = {}
    for i, s, t, *_ in rows:
        slots.setdefault((s, t // 20_000_000), []).append((t, i))
    assert pairs(st.drain(st.keep_newest_stream(events(), 3, "20 seconds", "10 seconds")).where("stream is not null"), "event_id", "stream", "ts_us") == sorted([(i, s, t) for (s, _), v in slots.items() for t, i in sorted(v)[-3:]], key=str)


def test_state_goes_after_a_silence_and_late_rows_are_dropped(spark, few_partitions):
    from pixelspark.session import shared_dir

    path, kind = f"{shared_dir(spark)}-silence", "event_id bigint, stream string, ts_us bigint"
    parts = [[(i, "s", (i + 1) * 1_000_000) for i in range(50)], [(50, None, 1_000_000_000)], [(51, "s", 3_000_000), (52, None, 1_001_000_000)], [(53, None, 1_100_000_000)]]
    for part in parts:
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(path)
    ticks = st.event_stream(spark, path, kind).withColumn("event_time", F.timestamp_micros("ts_us"))
    for stream, most in ((st.throttle_stream(ticks, 2_000_000, "5 seconds"), 0), (st.rolling_fps_stream(ticks, 6_000_000, "5 seconds"), 1)):
        out = f"{shared_dir(spark)}-out"
        q = st._started(stream.writeStream.outputMode("append").option("checkpointLocation", f"{out}-state").format("parquet").option("path", out), spark)
        got = [r["event_id"] for r in spark.read.parquet(out).collect()]
        assert sorted(got) == (list(range(0, 50, 2)) if most == 0 else list(range(50)))
        state = spark.read.format("statestore").option("stateVarName", "waiting").option("flattenCollectionTypes", True).load(f"{out}-state")
        assert state.count() == 0
        held = spark.read.format("statestore").option("stateVarName", "last" if most == 0 else "first").load(f"{out}-state")
        assert held.count() == most and q.lastProgress is not None


class Memory:
    """State of one key in a dictionary, as a handle and as its variables."""

    def __init__(self):
        self.of, self.timers = {}, set()

    def getValueState(self, name, *schema):
        return self.of.setdefault(name, Memory())

    getMapState = getValueState

    def registerTimer(self, at):
        self.timers.add(at)

    deleteTimer = lambda self, at: self.timers.discard(at)
    exists = lambda self: bool(self.of)
    get = lambda self: self.of.get(None)
    update = lambda self, value: self.of.update({None: value})
    clear = lambda self: self.of.clear()
    keys = lambda self: iter(list(self.of))
    getValue = lambda self, k: self.of.get(k)
    updateValue = lambda self, k, value: self.of.update({k: value})
    removeKey = lambda self, k: self.of.pop(k)


@pytest.mark.parametrize("block, at_once", [(1 << 13, 1 << 17), (16, 64)])
def test_rows_wait_in_blocks(block, at_once):
    """3,000 ticks in 10 triggers, out of order inside the watermark: they wait in blocks, are given out many at a time, and rates equal a plain count."""
    import types

    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(5)
    times = np.arange(3000) // 2 * 500_000 + rng.integers(-4, 5, 3000) * 250_000 + 10_000_000
    op, memory, window = st.RollingFps(6_000_000), Memory(), 6_000_000
    op.block, op.at_once = block, at_once
    op.init(memory)
    got, most, mark = [], 0, 0
    for k in range(0, 3300, 300):
        part = pd.DataFrame({"ts_us": times[k : k + 300], "event_id": np.arange(k, min(k + 300, 3000))})
        assert list(op.handleInputRows(("s",), iter([part[:150], part[150:]]), None)) == []
        most = max(most, len(memory.of["waiting"].of))
        assert len(memory.timers) == (1 if memory.of["waiting"].of else 0)
        mark = times[: k + 300].max() - 3_000_000 if k < 3000 else times.max() + 1
        memory.timers.clear()
        got += list(op.handleExpiredTimer(("s",), types.SimpleNamespace(getCurrentWatermarkInMs=lambda m=mark: int(m // 1000)), None))
    rows = pd.concat(got).set_index("event_id")["fps"]
    assert len(rows) == 3000 and not memory.of["waiting"].of and not memory.of["blocks"].of
    assert most <= 2 * (300 // block + 2) and max(map(len, got)) <= (3000 if block > 3000 else 3 * at_once)
    want = [((times <= t) & (times >= t - window)).sum() / min(window, t - times.min()) * 1e6 if t > times.min() else None for t in times]
    assert [None if np.isnan(v) else v for v in rows.sort_index()] == [None if v is None else pytest.approx(v) for v in want]


def test_waiting_ticks_are_few_values_of_state(spark, few_partitions):
    """3,000 ticks that the watermark has not passed are a block for each batch of their stream, not a value each."""
    from pixelspark.session import shared_dir

    out = f"{shared_dir(spark)}-waiting"
    ticks = timed(spark, [(i, "s", i + 1) for i in range(3000)])
    stream = st.rolling_fps_stream(st.replay(ticks, "event_id", 1), 1_000_000, "5 seconds")
    st._started(stream.writeStream.outputMode("append").option("checkpointLocation", f"{out}-state").format("parquet").option("path", out), spark)
    state = spark.read.format("statestore").option("stateVarName", "waiting").option("flattenCollectionTypes", True).load(f"{out}-state")
    assert 1 <= state.count() <= 2


def test_replayed_ticks_come_by_time(spark, few_partitions, sf, tmp_path):
    """Events whose numbers do not follow their times: none is late, each has its rate."""
    from pixelspark.plans.telemetry_queries import QUERIES

    events = spark.read.parquet(f"{sf}/events.parquet")
    n = events.count()
    events.unionByName(events.withColumn("event_id", F.col("event_id") + n)).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    rows = {name: sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).collect())) for name in ("t2_fps_stream", "w7_fps")}
    assert len(rows["t2_fps_stream"]) == 2 * n and [r[:2] for r in rows["t2_fps_stream"]] == [r[:2] for r in rows["w7_fps"]]
    assert [r[2] for r in rows["t2_fps_stream"]] == [r[2] if r[2] is None else pytest.approx(r[2]) for r in rows["w7_fps"]]


def test_registry_over_batches(spark):
    """Ids of one batch and of four are the same when topics come in order, and ids once given never change when they do not."""
    rows = [(f"/t/{(i * 7) % 23 if i % 3 else i % 11}", 1000 + i, "int" if i % 5 else "double") for i in range(200)]
    kind = "topic string, ts_us long, type string"
    whole = {r["topic"]: tuple(r) for r in tp.registry(spark.createDataFrame(rows, kind)).collect()}
    assert sorted(r[1] for r in whole.values()) == list(range(len(whole)))
    ordered = sorted(whole.values(), key=lambda r: r[1])
    assert [r[3] for r in ordered] == sorted(r[3] for r in ordered)
    for parts in ([rows[k : k + 50] for k in range(0, 200, 50)], [rows[100:], rows[:100], rows[:1]]):
        known = None
        for part in parts:
            new = tp.registry(spark.createDataFrame(part, kind), known)
            known = spark.createDataFrame([*(known.collect() if known else []), *new.collect()], tp.REGISTRY_SCHEMA)
        got = {r["topic"]: tuple(r) for r in known.collect()}
        assert sorted(r[1] for r in got.values()) == list(range(len(whole))) and set(got) == set(whole)
        if parts[0] == rows[:50]:
            assert got == whole


def test_topic_names(spark):
    f = lambda p, c: one(spark, tp.format_topic(F.lit(p), F.lit(c), F.lit(7), F.lit("cam")))
    assert f("%N/fps", "min") == "/cam/fps/min"
    assert f("/a/", "/b") == "/a/b"
    assert f("%%i-%i", "x") == "/%i-7/x"
