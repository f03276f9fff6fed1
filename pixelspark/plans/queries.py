"""Registered reference queries, part one: frames, colour, filters, windows, blobs. Each has a DuckDB twin where SQL expresses it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelspark.functions.color import idiv
from pixelspark.operators import blobs as bl
from pixelspark.operators import overlay, pixels, topics
from pixelspark.session import shared_dir, table, tidy
from pixelspark.sources import frames as fr

from . import fixtures as fx
from .fixtures import cte

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = tidy(f)
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


# SQL text of the colour formulas


def sql_clamp(x: str) -> str:
    return f"greatest(0, least(255, {x}))"


def sql_luma(r: str, g: str, b: str) -> str:
    return f"((77*({r}) + 150*({g}) + 29*({b})) >> 8)"


def sql_ycc(r: str, g: str, b: str) -> list[str]:
    return [sql_clamp(f"(77*({r}) + 150*({g}) + 29*({b})) // 256"), sql_clamp(f"(-43*({r}) - 85*({g}) + 128*({b})) // 256 + 128"), sql_clamp(f"(128*({r}) - 107*({g}) - 21*({b})) // 256 + 128")]


def sql_rgb_of_ycc(y: str, u: str, v: str) -> list[str]:
    return [sql_clamp(f"(256*({y}) + 359*(({v}) - 128)) // 256"), sql_clamp(f"(256*({y}) - (88*(({u}) - 128) + 183*(({v}) - 128))) // 256"), sql_clamp(f"(256*({y}) + 454*(({u}) - 128)) // 256")]


def sql_hsv(r: str, g: str, b: str) -> list[str]:
    top, low = f"greatest({r}, {g}, {b})", f"least({r}, {g}, {b})"
    d = f"({top} - {low})"
    return [
        f"case when {d} = 0 then 0 when {top} = {r} then (43*({g} - {b}) // {d}) & 255 when {top} = {g} then (85 + 43*({b} - {r}) // {d}) & 255 else (171 + 43*({r} - {g}) // {d}) & 255 end",
        f"case when {d} = 0 then 0 else 255*{d} // {top} end",
        top,
    ]


SQL_RGB_OF_HSV = """(select frame_id, y, x,
    case when s = 0 then v else case reg when 0 then a+m when 1 then b+m when 2 then m when 3 then m when 4 then b+m else a+m end end as c0,
    case when s = 0 then v else case reg when 0 then b+m when 1 then a+m when 2 then a+m when 3 then b+m when 4 then m else m end end as c1,
    case when s = 0 then v else case reg when 0 then m when 1 then m when 2 then b+m when 3 then a+m when 4 then a+m else b+m end end as c2
    from (select *, v - a as m, a * (43 - abs(h % 85 - 43)) // 43 as b from (select frame_id, y, x, c0 as h, c1 as s, c2 as v, c0 // 43 as reg, (c2 * c1) >> 8 as a from {src})))"""


def select_sql(exprs: list[str], source: str = "px_rgb", where: str = "") -> str:
    return "select frame_id, y, x, " + ", ".join(f"cast({e} as int) as c{i}" for i, e in enumerate(exprs)) + f" from {source} {where}"


C = ("c0", "c1", "c2")


# sources and sinks


@query("s1_read_images", cte("px_rgb") + "select * from px_rgb")
def s1(spark, sf):
    """Frames written as PNG files, many to a folder, and read back as images."""
    path = f"{shared_dir(spark)}-images"
    fr.write_png(fx.px_rgb(spark, sf), path)
    images = fr.read_images(spark, path).where("kind = 'png'")
    return fr.image_pixels(images, F.col("frame_id"))


@query("s2_unpack_frames", cte("text_frames") + """select frame_id, cast(list_sum(list_transform(range(0, length(data_hex) // 2), lambda i: cast('0x' || substr(data_hex, cast(2 * i + 1 as bigint), 2) as int))) as bigint) as total, cast(length(data_hex) // 2 as bigint) as n
    from text_frames where length(data_hex) > 0""")  # fmt: skip
def s2(spark, sf):
    return fr.unpack_frames(fx.text_frames(spark, sf), "luma").groupBy("frame_id").agg(F.sum("c0").alias("total"), F.count("*").alias("n"))


@query("s3_pack_frames", cte("px_luma") + "select frame_id, cast(max(x) + 1 as int) as width, cast(max(y) + 1 as int) as height, string_agg(printf('%02X', c0), '' order by y, x) as data_hex from px_luma group by frame_id")
def s3(spark, sf):
    return fr.pack_frames(fx.px_luma(spark, sf)).select("frame_id", "width", "height", F.hex("data").alias("data_hex"))


@query("s4_monochrome_frames", "select s_suppkey as frame_id, cast(y as int) as y, cast(x as int) as x, cast(s_suppkey % 256 as int) as c0, 255 as c1, cast(s_nationkey as int) as c2 from supplier, range(0, 3) a(y), range(0, 4) b(x)")
def s4(spark, sf):
    frames = table(spark, sf, "supplier").withColumn("frame_id", F.col("s_suppkey"))
    return fr.painted(frames, 4, 3, [F.col("s_suppkey") % 256, F.lit(255), F.col("s_nationkey")])


@query("s5_zeroed_frames", "select s_suppkey as frame_id, cast(y as int) as y, cast(x as int) as x, 0 as c0 from supplier, range(0, 3) a(y), range(0, 4) b(x)")
def s5(spark, sf):
    return fr.painted(table(spark, sf, "supplier").withColumn("frame_id", F.col("s_suppkey")), 4, 3, [F.lit(0)])


@query("s6_camera_dim", cte("ticks", "cameras") + "select t.stream, c.width, c.height, cast(round(1e6 / c.max_fps) as bigint) as min_gap_us, count(*) as n from ticks t join cameras c using (stream) group by all")
def s6(spark, sf):
    cams = fx.cameras(spark, sf).withColumn("resize_width", F.lit(None).cast("int")).withColumn("resize_height", F.lit(None).cast("int"))
    return fx.ticks(spark, sf).join(fr.camera_dim(cams), "stream").groupBy("stream", "width", "height", "min_gap_us").agg(F.count("*").alias("n"))


@query("s6_camera_resize", cte("px_rgb", "cameras") + """select c.stream, p.frame_id, cast(ty as int) as y, cast(tx as int) as x, c0, c1, c2
    from (select stream, case when stream = 'cam-7' then 16 else 4 + 3 * cast(right(stream, 1) as int) end as w, case when stream = 'cam-7' then 16 else 9 end as h from cameras) c, range(0, 30) a(tx), range(0, 20) b(ty), px_rgb p
    where c.stream = 'cam-' || (p.frame_id % 8) and tx < w and ty < h and p.x = tx * 16 // w and p.y = ty * 16 // h""")  # fmt: skip
def s6_resize(spark, sf):
    """Frames of eight streams in the sizes their cameras ask for; the last camera keeps its frames' own size."""
    n = F.substring("stream", -1, 1).cast("int")
    cams = fx.cameras(spark, sf).where("stream <> 'cam-7'").withColumn("resize_width", 4 + 3 * n).withColumn("resize_height", F.lit(9))
    px = fx.px_rgb(spark, sf).withColumn("stream", F.concat(F.lit("cam-"), (F.col("frame_id") % 8).cast("string")))
    return fr.resize_to_camera(px, fr.camera_dim(cams))


@query("s7_select_streams", cte("ticks") + "select * from ticks where regexp_matches(stream, '^cam-[0-3]$')")
def s7(spark, sf):
    return fr.select_streams(fx.ticks(spark, sf), "^cam-[0-3]$")


@query("s10_export_frames", cte("px_rgb") + f"""select frame_id, 16 as width, 16 as height, 'rgb24' as layout, string_agg(printf('%02X%02X%02X', c0, c1, c2), '' order by y, x) as data_hex from {SQL_RGB_OF_HSV.format(src='px_rgb')} group by frame_id""")
def s10(spark, sf):
    return fr.export_frames(fx.px_rgb(spark, sf), "hsv").select("frame_id", "width", "height", "layout", F.hex("data").alias("data_hex"))


@query("s10_written_export", cte("px_rgb") + f"""select '3cam-' || (frame_id % 3) as stream, strftime(make_timestamp(frame_id * 600000000), '%Y-%m-%d-%H') as hour, cast((row_number() over (partition by frame_id % 3, frame_id * 600 // 3600 order by frame_id) - 1) // 2 as int) as part, frame_id, data_hex
    from (select frame_id, string_agg(printf('%02X%02X%02X', c0, c1, c2), '' order by y, x) as data_hex from {SQL_RGB_OF_HSV.format(src='px_rgb')} group by frame_id)""")  # fmt: skip
def s10_written(spark, sf):
    """Frames of three streams, one every ten minutes, written in order as parts of two frames and read back."""
    path = f"{shared_dir(spark)}-export"
    frames = fr.export_frames(fx.px_rgb(spark, sf), "hsv").selectExpr("frame_id", "data", "concat('3cam-', frame_id % 3) as stream", "timestamp_seconds(frame_id * 600) as ts")
    fr.write_export(frames, path, 2)
    return fr.read_export(spark, path, "frame_id bigint, data binary, ts timestamp").select("stream", "hour", "part", "frame_id", F.hex("data").alias("data_hex"))


# colour

query("p1_color_space", cte("px_rgb") + select_sql(sql_ycc(*C)))(lambda s, d: pixels.color_space(fx.px_rgb(s, d), "rgb", "ycc"))
query("p2_rgb2hsv", cte("px_rgb") + select_sql(sql_hsv(*C)))(lambda s, d: pixels.color_space(fx.px_rgb(s, d), "rgb", "hsv"))
query("p3_hsv2rgb", cte("px_rgb") + select_sql(list(C), SQL_RGB_OF_HSV.format(src="px_rgb")))(lambda s, d: pixels.color_space(fx.px_rgb(s, d), "hsv", "rgb"))
query("p4_rgb2ycc_luma_grid", cte("px_luma") + select_sql(sql_ycc("c0", "255 - c0", "c0 // 2"), "px_luma"))(lambda s, d: pixels.color_space(fx.px_luma(s, d).withColumns({"c1": 255 - F.col("c0"), "c2": idiv(F.col("c0"), 2)}), "rgb", "ycc"))
query("p5_ycc2rgb", cte("px_rgb") + select_sql(sql_rgb_of_ycc(*C)))(lambda s, d: pixels.color_space(fx.px_rgb(s, d), "ycc", "rgb"))
query("p6_rgb2luma", cte("px_rgb") + select_sql([sql_luma(*C)]))(lambda s, d: pixels.color_space(fx.px_rgb(s, d), "rgb", "luma"))


@query("p7_luma_to_others", cte("px_luma") + "select frame_id, y, x, c0 as r, c0 as g, c0 as b, 255 as a, 0 as h, 0 as s, c0 as v, 128 as cb, 128 as cr from px_luma")
def p7(spark, sf):
    from pixelspark.functions.color import luma_to

    y = F.col("c0")
    rgba, hsv, ycc = luma_to(y, "rgba"), luma_to(y, "hsv"), luma_to(y, "ycc")
    return fx.px_luma(spark, sf).select("frame_id", "y", "x", *[e.alias(n) for e, n in zip([*rgba, *hsv, *ycc[1:]], ["r", "g", "b", "a", "h", "s", "v", "cb", "cr"])])


query("p8_rgba_rgb", cte("px_rgb") + select_sql([*C, "255"]))(lambda s, d: pixels.color_space(pixels.color_space(pixels.color_space(fx.px_rgb(s, d), "rgb", "rgba"), "rgba", "rgb"), "rgb", "rgba"))
query("p9_hsv_to_ycc", cte("px_rgb") + select_sql(sql_ycc(*C), SQL_RGB_OF_HSV.format(src="px_rgb")))(lambda s, d: pixels.color_space(fx.px_rgb(s, d), "hsv", "ycc"))
query("p9_ycc_to_hsv", cte("px_rgb", more=f"q as ({select_sql(sql_rgb_of_ycc(*C))})") + select_sql(sql_hsv(*C), "q"))(lambda s, d: pixels.color_space(fx.px_rgb(s, d), "ycc", "hsv"))
query("p9_ycc_to_luma", cte("px_rgb") + select_sql([sql_luma(*sql_rgb_of_ycc(*C))]))(lambda s, d: pixels.color_space(fx.px_rgb(s, d), "ycc", "luma"))
SQL_YUYV = f"q as ({select_sql(sql_ycc(*C))}), yuyv as (select a.frame_id, a.y, cast(a.x // 2 as int) as x, a.c0, cast((a.c1 + b.c1) // 2 as int) as c1, b.c0 as c2, cast((a.c2 + b.c2) // 2 as int) as c3 from q a join q b on a.frame_id = b.frame_id and a.y = b.y and a.x + 1 = b.x where a.x % 2 = 0)"
SQL_PAIRS = SQL_YUYV + ", pair as (select frame_id, y, x * 2 as x, c0, c1, c3 as c2 from yuyv union all select frame_id, y, x * 2 + 1, c2, c1, c3 from yuyv)"
query("p10_pack_yuyv", cte("px_rgb", more=SQL_YUYV) + "select * from yuyv")(lambda s, d: pixels.color_space(fx.px_rgb(s, d), "rgb", "yuyv"))
query("p11_unpack_yuyv", cte("px_rgb", more=SQL_PAIRS) + select_sql(sql_rgb_of_ycc(*C), "pair"))(lambda s, d: pixels.color_space(pixels.color_space(fx.px_rgb(s, d), "rgb", "yuyv"), "yuyv", "rgb"))
query("p12_anonymous_cast", cte("px_rgb") + select_sql([*C, "0", "0"]))(lambda s, d: pixels.color_space(pixels.color_space(fx.px_rgb(s, d), "rgb", "?5"), "?5", "?5"))
query("p13_swizzle", cte("px_rgb") + select_sql(["c2", "c0", "0", "c1"]))(lambda s, d: pixels.swizzle(fx.px_rgb(s, d), [2, 0, 7, 1]))
query("p14_swizzle_yuyv", cte("px_rgb", more=SQL_PAIRS) + select_sql(["c2", "c0", "0", "c1"], "pair"))(lambda s, d: pixels.swizzle_yuyv(pixels.color_space(fx.px_rgb(s, d), "rgb", "yuyv"), [2, 0, 3, 1]))


@query("p15_format_dim", """with f as (select p_partkey, case when p_partkey % 8 < 6 then ['luma', 'rgb', 'hsv', 'ycc', 'rgba', 'yuyv'][p_partkey % 8 + 1] when p_partkey % 8 = 6 then '?' || (p_partkey % 300) else 'other' end as format from part),
    d(format, alias, channels, pretty) as (values ('luma', 'gray', 1, 'Luma'), ('rgb', 'rgb24', 3, 'RGB'), ('hsv', 'hsv', 3, 'HSV'), ('ycc', 'ycbcr', 3, 'YCbCr'), ('rgba', 'rgba32', 4, 'RGBA'), ('yuyv', 'yuyv422', 4, 'YUYV')),
    a as (select f.*, case when regexp_matches(format, '^\\?[0-9]+$') then cast(substr(format, 2) as int) end as n from f)
    select p_partkey, a.format, alias, coalesce(channels, case when n between 1 and 200 then n end) as channels, coalesce(pretty, case when n between 1 and 200 then a.format end) as pretty from a left join d using (format)""")  # fmt: skip
def p15(spark, sf):
    k = F.col("p_partkey")
    named = F.get(F.array(*[F.lit(f) for f in ("luma", "rgb", "hsv", "ycc", "rgba", "yuyv")]), (k % 8).cast("int"))
    fmt = F.when(k % 8 < 6, named).when(k % 8 == 6, F.concat(F.lit("?"), (k % 300).cast("string"))).otherwise("other")
    return fr.with_format(table(spark, sf, "part").select("p_partkey", fmt.alias("format"))).select("p_partkey", "format", "alias", "channels", "pretty")


@query("p17_frame_fields", cte("text_frames") + "select frame_id, width, height, cast(width * height as bigint) as pixels, cast(length(data_hex) // 2 as bigint) as raw_size, 'luma' as format from text_frames")
def p17(spark, sf):
    return fr.frame_fields(fx.text_frames(spark, sf), "luma")


# filters

query("f1_color_filter_rgb", cte("px_rgb") + select_sql(["case when c0 between 40 and 200 and c1 between 0 and 180 and c2 between 20 and 255 then 255 else 0 end"]))(lambda s, d: pixels.color_filter(fx.px_rgb(s, d), "rgb", "rgb", [40, 0, 20], [200, 180, 255]))
query("f1_color_filter_hsv", cte("px_rgb", more=f"q as ({select_sql(sql_hsv(*C))})") + select_sql(["case when c0 between 30 and 160 and c1 between 50 and 255 and c2 between 40 and 255 then 255 else 0 end"], "q"))(
    lambda s, d: pixels.color_filter(fx.px_rgb(s, d), "rgb", "hsv", [30, 50, 40], [160, 255, 255])
)
query("f2_yuyv_filter", cte("px_rgb", more=SQL_PAIRS) + select_sql(["case when c0 between 60 and 200 and c1 between 100 and 160 and c2 between 90 and 170 then 255 else 0 end"], "pair"))(
    lambda s, d: pixels.color_filter(pixels.color_space(fx.px_rgb(s, d), "rgb", "yuyv"), "yuyv", "yuyv", [60, 100, 90], [200, 160, 170])
)
query("f3_anonymous_filter", cte("px_rgb") + select_sql(["case when c0 between 40 and 200 and c1 between 0 and 180 then 255 else 0 end"]))(lambda s, d: pixels.color_filter(fx.px_rgb(s, d), "?3", "?3", [40, 0], [200, 180, 9]))
query("f4_foreground", cte("px_rgb") + "select * from px_rgb where greatest(c0, c1, c2) > 0")(lambda s, d: pixels.foreground(fx.px_rgb(s, d)))

# geometry on frames

query("g1_resize", cte("px_rgb") + "select f.frame_id, cast(ty as int) as y, cast(tx as int) as x, c0, c1, c2 from (select distinct frame_id from px_rgb) f, range(0, 7) a(ty), range(0, 10) b(tx), px_rgb p where p.frame_id = f.frame_id and p.x = tx * 16 // 10 and p.y = ty * 16 // 7")(
    lambda s, d: pixels.resize(fx.px_rgb(s, d), 10, 7)
)
SQL_RESIZED = """small as (select f.frame_id, ty as y, tx as x, c0, c1, c2 from (select distinct frame_id from pair) f, range(0, 7) a(ty), range(0, 10) b(tx), pair p where p.frame_id = f.frame_id and p.x = tx * 16 // 10 and p.y = ty * 16 // 7)"""
query("g1_resize_yuyv", cte("px_rgb", more=f"{SQL_PAIRS}, {SQL_RESIZED}") + "select a.frame_id, cast(a.y as int) as y, cast(a.x // 2 as int) as x, a.c0, cast((a.c1 + b.c1) // 2 as int) as c1, b.c0 as c2, cast((a.c2 + b.c2) // 2 as int) as c3 from small a join small b on a.frame_id = b.frame_id and a.y = b.y and a.x + 1 = b.x where a.x % 2 = 0")(
    lambda s, d: pixels.resize_yuyv(pixels.color_space(fx.px_rgb(s, d), "rgb", "yuyv"), 9, 7)
)
query("g2_crop", cte("px_rgb") + "select * from px_rgb where x >= 3 and x < 9 and y >= 2 and y < 20")(lambda s, d: pixels.crop(fx.px_rgb(s, d), 3, 2, 9, 20))

SQL_LINES = """lines as (select l_orderkey as frame_id, l_linenumber as seq, cast(l_quantity as int) as x0, cast(l_partkey % 40 as int) - 5 as y0, cast(l_suppkey % 50 as int) as x1, cast(l_partkey % 37 as int) as y1 from lineitem)"""
SQL_BRESENHAM = """b(frame_id, seq, x1, y1, dx, dy, sx, sy, x, y, e, left_n) as (
    select frame_id, seq, x1, y1, abs(x1 - x0), -abs(y1 - y0), case when x0 < x1 then 1 else -1 end, case when y0 < y1 then 1 else -1 end, x0, y0, abs(x1 - x0) - abs(y1 - y0), greatest(abs(x1 - x0), abs(y1 - y0)) from {src}
    union all
    select frame_id, seq, x1, y1, dx, dy, sx, sy, case when 2 * e >= dy then x + sx else x end, case when 2 * e <= dx then y + sy else y end, e + case when 2 * e >= dy then dy else 0 end + case when 2 * e <= dx then dx else 0 end, left_n - 1 from b where left_n > 0)"""


def lines(spark, sf):
    return table(spark, sf, "lineitem").selectExpr("l_orderkey as frame_id", "l_linenumber as seq", "cast(l_quantity as int) as x0", "cast(l_partkey % 40 as int) - 5 as y0", "cast(l_suppkey % 50 as int) as x1", "cast(l_partkey % 37 as int) as y1")


query("g3_rasterize_lines", f"with recursive {SQL_LINES}, {SQL_BRESENHAM.format(src='lines')} select frame_id, seq, cast(y as int) as y, cast(x as int) as x from b where left_n > 0 and x >= 0 and y >= 0")(lambda s, d: overlay.rasterize_lines(lines(s, d)))

CORNERS = "array(cx, cy, cx + id, cy + 1, cx + id + 2, cy + 20.7, cx - 3.2, cy + 15)"


def corner_dets(spark, sf):
    return fx.dets(spark, sf).selectExpr("run as frame_id", "seq", "id", "hamming", "cx", "cy", f"{CORNERS} as corners")


SQL_EDGES = """k as (select run as frame_id, seq * 4 as seq4, [cx, cy, cx + id, cy + 1, cx + id + 2, cy + 20.7, cx - 3.2, cy + 15] as c from dets),
    edges as (select frame_id, seq4 + i as seq, cast(trunc(c[2*i+1]) as int) as x0, cast(trunc(c[2*i+2]) as int) as y0, cast(trunc(c[2*((i+1)%4)+1]) as int) as x1, cast(trunc(c[2*((i+1)%4)+2]) as int) as y1 from k, range(0, 4) t(i))"""


@query("g4_rasterize_detections", cte("dets", more=f"{SQL_EDGES}, {SQL_BRESENHAM.format(src='edges')}", recursive=True)
    + "select frame_id, cast(seq // 4 as int) as seq, cast(seq % 4 as int) as edge, count(*) as n, string_agg(x || ',' || y, ' ' order by x, y) as points from b where left_n > 0 and x >= 0 and y >= 0 group by frame_id, seq")
def g4(spark, sf):
    """Every pixel of every edge, as a list of each edge."""
    edges = overlay.detection_edges(corner_dets(spark, sf).select("frame_id", "seq", "corners"))
    return overlay.point_lists(edges)


# windows


def sql_line_window(along: str, size: int, name: str, source: str, columns: list[str], f: str) -> str:
    across = "x" if along == "y" else "y"
    return f"{name} as (select frame_id, y, x, " + ", ".join(f.format(c=c) + f" as {c}" for c in columns) + f" from {source} window w as (partition by frame_id, {across} order by {along} rows between {size // 2} preceding and {size // 2} following))"


def sql_two_lines(height: int, width: int, source: str, columns: list[str], f: str) -> str:
    return sql_line_window("y", height, "v", source, columns, f) + ", " + sql_line_window("x", width, "h", "v", columns, f)


MEAN = "cast(sum({c}) over w // count({c}) over w as int)"
query("w1_box_blur", cte("px_luma", more=sql_two_lines(3, 5, "px_luma", ["c0"], MEAN)) + "select * from h")(lambda s, d: pixels.box_blur(fx.px_luma(s, d, by_frame=True), 5, 3))
query("w1_box_blur_rgb", cte("px_rgb", more=sql_two_lines(3, 3, "px_rgb", list(C), MEAN)) + "select * from h")(lambda s, d: pixels.box_blur(pixels.by_frame(fx.px_rgb(s, d)), 3, 3))


def sql_gaussian(along: str, size: int, sigma: float, name: str, source: str) -> str:
    across = "x" if along == "y" else "y"
    at = lambda d: f"lead(c0, {d}) over w" if d > 0 else f"lag(c0, {-d}) over w" if d < 0 else "c0"
    ks = list(zip(range(-(size // 2), size // 2 + 1), pixels.gaussian_weights(sigma, size)))
    total = " + ".join(f"coalesce({at(d)} * {k}, 0)" for d, k in ks)
    norm = " + ".join(f"case when {at(d)} is null then 0 else {k} end" for d, k in ks)
    return f"{name} as (select frame_id, y, x, cast(({total}) // ({norm}) as int) as c0 from {source} window w as (partition by frame_id, {across} order by {along}))"


query("w2_gaussian_blur", cte("px_luma", more=sql_gaussian("y", 5, 1.2, "v", "px_luma") + ", " + sql_gaussian("x", 3, 1.2, "h", "v")) + "select * from h")(lambda s, d: pixels.gaussian_blur(fx.px_luma(s, d, by_frame=True), 1.2, 3, 5))


def sql_percentile(size: int, index: int) -> str:
    half = size // 2
    return f"""select a.frame_id, a.y, a.x, list_sort(list(b.c0))[cast({index} * count(*) // {size * size} as int) + 1] as c0
        from px_luma a join px_luma b on a.frame_id = b.frame_id and b.y between a.y - {half} and a.y + {half} and b.x between a.x - {half} and a.x + {half} group by a.frame_id, a.y, a.x"""


query("w3_percentile", cte("px_luma") + sql_percentile(3, 2))(lambda s, d: pixels.percentile_filter(fx.px_luma(s, d, by_frame=True), 3, 3, 2))
query("w4_median", cte("px_luma") + sql_percentile(3, 4))(lambda s, d: pixels.median_filter(fx.px_luma(s, d, by_frame=True), 3, 3))
query("w4_median_camera")(lambda s, d: pixels.median_filter(fx.px_camera(s, d), 15, 15))
query("w5_erode", cte("px_luma", more=sql_two_lines(3, 3, "px_luma", ["c0"], "min({c}) over w")) + "select * from h")(lambda s, d: pixels.erode(fx.px_luma(s, d, by_frame=True), 3, 3))
query("w5_dilate", cte("px_luma", more=sql_two_lines(5, 3, "px_luma", ["c0"], "max({c}) over w")) + "select * from h")(lambda s, d: pixels.dilate(fx.px_luma(s, d, by_frame=True), 3, 5))
SQL_RUNS = "runs as (select frame_id, y, cast(min(x) as int) as x0, cast(max(x) + 1 as int) as x1 from (select frame_id, y, x, x - row_number() over (partition by frame_id, y order by x) as g from px_mask) group by frame_id, y, g)"
query("w6_runs", cte("px_mask", more=SQL_RUNS) + "select * from runs")(lambda s, d: bl.runs(fx.px_mask(s, d, by_frame=True)))

# blobs

SQL_BLOBS = """m as (select frame_id, y, x, y * 8 + x as p from px_mask),
    reach(frame_id, p, q) as (select frame_id, p, p from m union
        select r.frame_id, r.p, b.p from reach r join m a on a.frame_id = r.frame_id and a.p = r.q join m b on b.frame_id = a.frame_id and abs(b.y - a.y) <= 1 and abs(b.x - a.x) <= 1),
    label as (select frame_id, p, min(q) as l from reach group by frame_id, p),
    blobs as (select frame_id, min(x) as min_x, cast(max(x) + 1 as int) as max_x, min(y) as min_y, cast(max(y) + 1 as int) as max_y, count(*) as pixels from label join m using (frame_id, p) group by frame_id, l)"""


def sql_blobs(tail: str, more: str = "") -> str:
    return cte("px_mask", more=SQL_BLOBS + more, recursive=True) + tail


def mask_blobs(spark, sf):
    return bl.blobs(fx.px_mask(spark, sf, by_frame=True))


query("j5_touching_runs", cte("px_mask", more=SQL_RUNS) + "select a.frame_id, a.y, a.x0, a.x1, b.x0 as u0, b.x1 as u1 from runs a join runs b on a.frame_id = b.frame_id and a.y = b.y + 1 and a.x0 <= b.x1 and b.x0 <= a.x1")(
    lambda s, d: bl.touching_runs(bl.runs(fx.px_mask(s, d, by_frame=True)))
)
query("a8_blobs", sql_blobs("select * from blobs"))(mask_blobs)
query("a8_blobs_iterative", sql_blobs("select * from blobs"))(lambda s, d: bl.blobs(fx.px_mask(s, d, by_frame=True), strip_rows=2))
query("a8_blobs_camera")(lambda s, d: bl.blobs(fx.px_camera(s, d).where("c0 >= 212")))
query("a7_box_union", sql_blobs("select frame_id, min(min_x) as min_x, max(max_x) as max_x, min(min_y) as min_y, max(max_y) as max_y, cast(sum(pixels) as bigint) as pixels from blobs group by frame_id"))(
    lambda s, d: bl.boxes_of(bl.runs(fx.px_mask(s, d, by_frame=True)).withColumn("label", F.lit(0)))
)
query("p18_blob_fields", sql_blobs("select *, max_x - min_x as width, max_y - min_y as height, cast((max_x - min_x) * (max_y - min_y) as bigint) as area, pixels / ((max_x - min_x) * (max_y - min_y)) as filled from blobs"))(lambda s, d: bl.blob_fields(mask_blobs(s, d)))
query("f5_blob_filter", sql_blobs("select * from blobs where max_x - min_x between 2 and 7 and pixels >= 3 and (max_y - min_y) / (max_x - min_x) between 0.5 and 2.0 and pixels / ((max_x - min_x) * (max_y - min_y)) >= 0.4"))(
    lambda s, d: bl.blob_filter(mask_blobs(s, d), width=(2, 7), pixels=(3, None), aspect=(0.5, 2.0), fill=(0.4, None))
)
query("f6_blob_filter_min", sql_blobs("select * from blobs where max_x - min_x >= 2 and max_y - min_y >= 2 and (max_x - min_x) * (max_y - min_y) >= 6 and pixels / ((max_x - min_x) * (max_y - min_y)) >= 0.5"))(
    lambda s, d: bl.blob_filter_min(mask_blobs(s, d), 2, 2, 6, 0.5)
)
query("o4_largest_blobs", sql_blobs("select *, cast(row_number() over (partition by frame_id order by pixels desc, min_y, min_x, max_y, max_x) as int) as rank from blobs qualify rank <= 2"))(lambda s, d: bl.largest(mask_blobs(s, d), 2))
query("a10_vec", sql_blobs("select frame_id, string_agg(min_y || ',' || min_x || ',' || pixels, ';' order by min_y, min_x, max_y, max_x) as vec, count(*) as n from blobs group by frame_id"))(
    lambda s, d: bl.as_lists(mask_blobs(s, d)).select("frame_id", F.array_join(F.transform("vec", lambda b: F.concat_ws(",", b["min_y"].cast("string"), b["min_x"].cast("string"), b["pixels"].cast("string"))), ";").alias("vec"), "n")
)

# overlays


@query("j3_draw_lines", cte("px_rgb", more=f"lines as (select frame_id, 0 as seq, 1 as x0, 2 as y0, 14 as x1, cast(frame_id % 16 as int) as y1 from (select distinct frame_id from px_rgb)), {SQL_BRESENHAM.format(src='lines')}, d as (select distinct frame_id, x, y from b where left_n > 0)", recursive=True)
    + "select p.frame_id, p.y, p.x, case when d.x is null then c0 else 255 end as c0, case when d.x is null then c1 else 0 end as c1, case when d.x is null then c2 else 10 end as c2 from px_rgb p left join d on d.frame_id = p.frame_id and d.x = p.x and d.y = p.y")
def j3(spark, sf):
    px = fx.px_rgb(spark, sf)
    element = px.select("frame_id").distinct().selectExpr("frame_id", "0 as seq", "1 as x0", "2 as y0", "14 as x1", "cast(frame_id % 16 as int) as y1")
    return overlay.draw_points(px, overlay.rasterize_lines(element), [255, 0, 10])


@query("j3_draw_on_converted_canvas", cte("px_rgb", more=f"lines as (select frame_id, 0 as seq, 1 as x0, 2 as y0, 14 as x1, cast(frame_id % 16 as int) as y1 from (select distinct frame_id from px_rgb)), {SQL_BRESENHAM.format(src='lines')}, d as (select distinct frame_id, x, y from b where left_n > 0), q as ({select_sql(sql_hsv(*C))})", recursive=True)
    + "select p.frame_id, p.y, p.x, case when d.x is null then c0 else 20 end as c0, case when d.x is null then c1 else 200 end as c1, case when d.x is null then c2 else 250 end as c2 from q p left join d on d.frame_id = p.frame_id and d.x = p.x and d.y = p.y")
def j3_converted(spark, sf):
    px = fx.px_rgb(spark, sf)
    element = px.select("frame_id").distinct().selectExpr("frame_id", "0 as seq", "1 as x0", "2 as y0", "14 as x1", "cast(frame_id % 16 as int) as y1")
    return overlay.draw_points(px, overlay.rasterize_lines(element), [20, 200, 250], "rgb", "hsv")


SQL_ELEMENTS = """lines as (select frame_id, cast(i as int) as seq, cast(i * 3 as int) as x0, 2 as y0, cast((frame_id + 5 * i) % 16 as int) as x1, 15 as y1 from (select distinct frame_id from px_rgb), range(0, 4) t(i))"""


@query("j3_draw_colored_points", cte("px_rgb", more=f"{SQL_ELEMENTS}, {SQL_BRESENHAM.format(src='lines')}, d as (select frame_id, x, y, max(seq) as seq from b where left_n > 0 group by all)", recursive=True)
    + "select p.frame_id, p.y, p.x, coalesce(seq * 60, c0) as c0, coalesce(255 - seq * 60, c1) as c1, case when d.x is null then c2 else 7 end as c2 from px_rgb p left join d on d.frame_id = p.frame_id and d.x = p.x and d.y = p.y")
def j3_colored(spark, sf):
    """Four lines a frame that cross, each in a colour of its own: the last one wins."""
    px = fx.px_rgb(spark, sf)
    elements = px.select("frame_id").distinct().selectExpr("frame_id", "explode(sequence(0, 3)) as seq").selectExpr("frame_id", "seq", "seq * 3 as x0", "2 as y0", "cast((frame_id + 5 * seq) % 16 as int) as x1", "15 as y1")
    points = overlay.rasterize_lines(elements).withColumn("color", F.expr("array(seq * 60, 255 - seq * 60, 7)"))
    return overlay.draw_colored_points(px, points)


@query("j4_draw_boxes", sql_blobs("""select p.frame_id, p.y, p.x, coalesce(c, p.c0) as c0 from px_luma p left join (select frame_id, y, x, arg_max(c, i) as c from fold group by all) r on r.frame_id = p.frame_id and r.y = p.y and r.x = p.x""",
    """, ranked as (select *, row_number() over (partition by frame_id order by pixels desc, min_y, min_x, max_y, max_x) as seq from blobs),
    k as (select p.frame_id, p.y, p.x, c0, row_number() over (partition by p.frame_id, p.y, p.x order by seq) as i, 40 + 25 * (seq % 8) as color, pixels / ((max_x - min_x) * (max_y - min_y)) as fill, p.x = min_x or p.x = max_x - 1 or p.y = min_y or p.y = max_y as border
        from px_luma p join ranked b on p.frame_id = b.frame_id and p.x >= min_x and p.x < max_x and p.y between min_y and max_y),
    fold(frame_id, y, x, i, c) as (select frame_id, y, x, 0, c0 from k where i = 1 union all
        select k.frame_id, k.y, k.x, k.i, cast(case when border or fill >= 1 then color else trunc(c * (1 - fill) + color * fill) end as int) from fold f join k on k.frame_id = f.frame_id and k.y = f.y and k.x = f.x and k.i = f.i + 1)"""))  # fmt: skip
def j4(spark, sf):
    """All blobs' boxes, which overlap, drawn from the largest down, each in a colour of its rank."""
    ranked = bl.blob_fields(bl.largest(mask_blobs(spark, sf), None))
    return overlay.draw_boxes(fx.px_luma(spark, sf), ranked.selectExpr("frame_id", "rank as seq", "min_x", "max_x", "min_y", "max_y", "filled as fill", "array(40 + 25 * (rank % 8)) as color"))


# flagship


def tracked(px: DataFrame) -> DataFrame:
    """Coloured objects of each whole frame of px as topic rows: found count and the largest object's place and size."""
    mask = pixels.color_filter(px, "rgb", "hsv", [0, 40, 60], [255, 255, 255])
    boxes = bl.blob_filter(bl.blobs(mask), pixels=(4, None))
    per_frame = boxes.groupBy("frame_id").agg(F.count("*").alias("found"), F.max("pixels").alias("largest"), F.max_by(F.struct("min_x", "min_y"), F.struct("pixels", "min_y", "min_x")).alias("at"))
    rows = px.select("frame_id").distinct().join(per_frame, "frame_id", "left").select(F.col("frame_id").alias("ts_us"), F.lit("objects").alias("stream"), F.lit(1).alias("stream_id"), F.coalesce("found", F.lit(0)).cast("bigint").alias("found"), "largest", F.col("at.min_x").alias("x"), F.col("at.min_y").alias("y"))
    return topics.publish(rows, ["ts_us", "stream", "stream_id"], ["found", "largest", "x", "y"], "%N/tracked")


def track_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracked(fx.px_rgb(spark, sf_dir))


SQL_TRACK = f"""q as ({select_sql(sql_hsv(*C))}), m as (select frame_id, y, x, y * 16 + x as p from q where c1 >= 40 and c2 >= 60),
    reach(frame_id, p, q) as (select frame_id, p, p from m union
        select r.frame_id, r.p, b.p from reach r join m a on a.frame_id = r.frame_id and a.p = r.q join m b on b.frame_id = a.frame_id and abs(b.y - a.y) <= 1 and abs(b.x - a.x) <= 1),
    label as (select frame_id, p, min(q) as l from reach group by frame_id, p),
    blobs as (select frame_id, min(x) as min_x, min(y) as min_y, count(*) as pixels from label join m using (frame_id, p) group by frame_id, l having count(*) >= 4),
    f as (select frame_id, count(*) as found, max(pixels) as largest, arg_max(min_x, (pixels, min_y, min_x)) as at_x, arg_max(min_y, (pixels, min_y, min_x)) as at_y from blobs group by frame_id),
    w as (select frame_id, coalesce(found, 0) as found, largest, at_x, at_y from (select distinct frame_id from px_rgb) left join f using (frame_id))
    select '/objects/tracked/' || channel as topic, frame_id as ts_us, 'int' as type, cast(val as varchar) as value
    from w, lateral (select * from (values ('found', found), ('largest', largest), ('x', at_x), ('y', at_y)) t(channel, val)) u where val is not null"""
query("flagship_track_objects", cte("px_rgb", recursive=True).rstrip() + ", " + SQL_TRACK)(track_objects)
