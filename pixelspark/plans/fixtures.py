"""Views over the given tables that the reference queries start from, each as a DataFrame and as a DuckDB common table expression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelspark.functions.geometry import from_euler
from pixelspark.session import table


def px_luma(spark: SparkSession, sf_dir: str, by_frame: bool = False) -> DataFrame:
    """8x8 luma frames from the 64 floats of embeddings; by_frame deals the packed frames out before they become pixels."""
    e = table(spark, sf_dir, "embeddings").selectExpr("vec_id as frame_id", "embedding")
    e = (e.repartition("frame_id") if by_frame else e).selectExpr("frame_id", "posexplode(embedding) as (pos, v)")
    return e.selectExpr("frame_id", "cast(pos div 8 as int) as y", "cast(pos % 8 as int) as x", "cast(least(255, greatest(0, floor((cast(v as double) + 0.5) * 255))) as int) as c0")


def px_mask(spark: SparkSession, sf_dir: str, by_frame: bool = False) -> DataFrame:
    return px_luma(spark, sf_dir, by_frame).where("c0 >= 160")


CAMERA_WIDTH, CAMERA_HEIGHT = 446, 295


#: Camera frames and detections that a task gets, so that its memory does not grow with the table.
FRAMES_PER_TASK, ROWS_PER_TASK = 4, 1 << 17


def px_camera(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Camera-size luma frames of all lineitem rows: a row is 8 pixels of one value, and a frame the rows of one hash value, about 446 x 295 pixels."""
    lines = table(spark, sf_dir, "lineitem")
    n_frames = max(1, -(-lines.count() * 8 // (CAMERA_WIDTH * CAMERA_HEIGHT)))
    rows = lines.selectExpr(f"pmod(xxhash64(l_orderkey, l_linenumber, l_partkey, l_suppkey), {n_frames}) as frame_id", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "cast(pmod(l_partkey * 7 + l_suppkey * 13 + l_orderkey, 256) as int) as c0").repartition(-(-n_frames // FRAMES_PER_TASK), "frame_id")
    placed = rows.selectExpr("frame_id", "c0", "row_number() over (partition by frame_id order by l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 as place")
    return placed.selectExpr("frame_id", "c0", "explode(sequence(8 * place, 8 * place + 7)) as i").selectExpr("frame_id", f"cast(i div {CAMERA_WIDTH} as int) as y", f"cast(i % {CAMERA_WIDTH} as int) as x", "c0")


#: Generated, so that filters on colours are not pushed below the expressions and evaluate them again and again.
RGB_OF_EVENT = "inline(array(named_struct('c0', cast(cast(round(value * 100) as bigint) % 256 as int), 'c1', cast((user_id * 7) % 256 as int), 'c2', cast(regexp_extract(props, '([0-9]+)', 1) as int) * 2)))"


def px_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16x16 RGB frames of 256 consecutive events; the last one is filled up with black pixels."""
    events = table(spark, sf_dir, "events")
    rest = events.agg(F.max("event_id").alias("m")).where("m % 256 < 255").select(F.explode(F.expr("sequence(m + 1, m div 256 * 256 + 255)")).alias("event_id"))
    filled = events.selectExpr("event_id", RGB_OF_EVENT).unionByName(rest.selectExpr("event_id", "0 as c0", "0 as c1", "0 as c2"))
    return filled.selectExpr("event_id div 256 as frame_id", "cast((event_id % 256) div 16 as int) as y", "cast(event_id % 16 as int) as x", "c0", "c1", "c2")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("event_id", "concat('cam-', cast(user_id % 8 as string)) as stream", "unix_micros(cast(ts as timestamp)) as ts_us")


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("concat('/', event_type, '/', cast(user_id % 4 as string)) as topic", "unix_micros(cast(ts as timestamp)) as ts_us", "case when event_id % 11 = 0 then 'int' else 'double' end as type", "value")


DETS_SQL = """select l_orderkey as run,
    cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) - 1 as int) as seq,
    cast(l_partkey % 32 as int) as id, cast(l_suppkey % 3 as int) as hamming, cast(l_quantity as double) * 10 as cx, cast(l_extendedprice as double) / 100 as cy from lineitem"""


#: What detections are ordered by before price and quantity, in bits of one number where it fits; a row that does not fit travels with all its columns.
#: Without its date a row loses nothing: rows that differ in it alone are equal detections. Zeros keep theirs, as -0.0 and 0.0 are equal only in order.
PACKED = "shiftleft(cast(l_linenumber as bigint), 56) | shiftleft(cast(l_partkey as bigint), 24) | l_suppkey"
FITS = "coalesce(l_linenumber between 0 and 127 and l_partkey between 0 and 4294967295 and l_suppkey between 0 and 16777215 and l_quantity <> 0 and l_extendedprice <> 0, false)"
UNPACKED = {"l_linenumber": "cast(shiftright(packed, 56) as int)", "l_partkey": "shiftright(packed, 24) & 4294967295", "l_suppkey": "packed & 16777215", "l_shipdate": "null"}


def dealt_lines(lines: DataFrame, n_tasks: int) -> DataFrame:
    """The columns of lineitem that detections are made of, an order's rows in one task; few bytes of a row travel."""
    wide = f"struct({', '.join(UNPACKED)})"
    narrow = lines.selectExpr("l_orderkey", "l_quantity", "l_extendedprice", f"case when {FITS} then {PACKED} end as packed", f"case when not {FITS} then {wide} end as wide")
    return narrow.repartition(n_tasks, "l_orderkey").selectExpr("l_orderkey", "l_quantity", "l_extendedprice", *[f"case when wide is null then {v} else wide.{c} end as {c}" for c, v in UNPACKED.items()])


def dets(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    lines = dealt_lines(lines, max(spark.sparkContext.defaultParallelism, -(-lines.count() // ROWS_PER_TASK)))
    return spark.sql(DETS_SQL.replace("from lineitem", "from {lineitem}"), lineitem=lines)


def text_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as luma frames of 16 columns; the last row is filled up with zeros."""
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id as frame_id", "encode(text, 'UTF-8') as b").selectExpr("*", "cast((length(b) + 15) div 16 as int) as height")
    return docs.selectExpr("frame_id", "16 as width", "height", "rpad(b, 16 * height, x'00') as data")


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Translation: the first three floats of a vector; rotation: of the next three as roll, pitch and yaw."""
    e = table(spark, sf_dir, "embeddings").selectExpr("vec_id as pose_id", "transform(embedding, v -> cast(v as double)) as e")
    angles = [F.element_at("e", i) for i in (4, 5, 6)]
    return e.select("pose_id", F.slice("e", 1, 3).alias("translation"), from_euler(*angles).alias("rotation"), F.slice("e", 4, 3).alias("angles"))


CAMERAS = [(f"cam-{i}", None if i == 7 else 0.6 + 0.1 * i, 640, 480, 30.0 - i) for i in range(8)]


def cameras(spark: SparkSession, sf_dir: str | None = None) -> DataFrame:
    return spark.createDataFrame(CAMERAS, "stream string, fov double, width int, height int, max_fps double")


CTE = {
    "px_luma": "px_luma as (select vec_id as frame_id, cast((i - 1) // 8 as int) as y, cast((i - 1) % 8 as int) as x, cast(least(255, greatest(0, floor((cast(embedding[i] as double) + 0.5) * 255))) as int) as c0 from embeddings, range(1, 65) t(i))",
    "px_mask": "px_mask as (select * from px_luma where c0 >= 160)",
    "px_rgb": """filled as (select event_id, cast(cast(round(value * 100) as bigint) % 256 as int) as c0, cast((user_id * 7) % 256 as int) as c1, cast(regexp_extract(props, '([0-9]+)', 1) as int) * 2 as c2 from events
        union all select unnest(range(m + 1, m // 256 * 256 + 256)), 0, 0, 0 from (select max(event_id) as m from events)),
    px_rgb as (select event_id // 256 as frame_id, cast((event_id % 256) // 16 as int) as y, cast(event_id % 16 as int) as x, c0, c1, c2 from filled)""",
    "ticks": "ticks as (select event_id, concat('cam-', cast(user_id % 8 as varchar)) as stream, epoch_us(ts) as ts_us from events)",
    "topics": "topics as (select concat('/', event_type, '/', cast(user_id % 4 as varchar)) as topic, epoch_us(ts) as ts_us, case when event_id % 11 = 0 then 'int' else 'double' end as type, value from events)",
    "dets": f"dets as ({DETS_SQL})",
    "text_frames": "text_frames as (select doc_id as frame_id, 16 as width, cast((octet_length(encode(text)) + 15) // 16 as int) as height, rpad(hex(encode(text)), cast(32 * ((octet_length(encode(text)) + 15) // 16) as int), '0') as data_hex from documents)",
    "cameras": "cameras as (select * from (values " + ", ".join(f"('{s}', {'cast(null as double)' if f is None else f'cast({f!r} as double)'}, {w}, {h}, cast({m!r} as double))" for s, f, w, h, m in CAMERAS) + ") t(stream, fov, width, height, max_fps))",
    "poses": """poses as (select vec_id as pose_id, [t[1], t[2], t[3]] as translation, t[4:6] as angles,
        [cos(t[5]) * cos(t[6]), -cos(t[5]) * sin(t[6]), sin(t[5]),
         cos(t[4]) * sin(t[6]) + sin(t[4]) * sin(t[5]) * cos(t[6]), cos(t[4]) * cos(t[6]) - sin(t[4]) * sin(t[5]) * sin(t[6]), -sin(t[4]) * cos(t[5]),
         sin(t[4]) * sin(t[6]) - cos(t[4]) * sin(t[5]) * cos(t[6]), sin(t[4]) * cos(t[6]) + cos(t[4]) * sin(t[5]) * sin(t[6]), cos(t[4]) * cos(t[5])] as rotation
        from (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as t from embeddings))""",
}


def cte(*views: str, more: str = "", recursive: bool = False) -> str:
    """A WITH clause of these views (px_mask brings px_luma) and further expressions."""
    names = [v for v in CTE if v in views or v == "px_luma" and "px_mask" in views]
    return f"with {'recursive ' if recursive else ''}" + ",\n".join([*(CTE[n] for n in names), *([more] if more else [])]) + "\n"
