"""Integer colour expressions on channel columns. Everything is built-in Catalyst arithmetic: `div` truncates toward zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Channels of each pixel format; `?n` has n.
CHANNELS = {"luma": 1, "rgb": 3, "hsv": 3, "ycc": 3, "rgba": 4, "yuyv": 4}


def idiv(a: Column, b: Column | int) -> Column:
    """Truncating integer division, as INT."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b)).cast("int")


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(255), x))


def channels(fmt: str) -> int:
    if fmt.startswith("?"):
        n = int(fmt[1:])
        if not 1 <= n <= 200:
            raise ValueError(f"pixel format {fmt} has {n} channels, not 1 to 200")
        return n
    return CHANNELS[fmt]


def rgb_to_luma(r: Column, g: Column, b: Column) -> list[Column]:
    return [F.shiftright(77 * r + 150 * g + 29 * b, 8)]


def rgb_to_ycc(r: Column, g: Column, b: Column) -> list[Column]:
    return [
        clamp(idiv(77 * r + 150 * g + 29 * b, 256)),
        clamp(idiv(-43 * r - 85 * g + 128 * b, 256) + 128),
        clamp(idiv(128 * r - 107 * g - 21 * b, 256) + 128),
    ]


def ycc_to_rgb(y: Column, cb: Column, cr: Column) -> list[Column]:
    b, r = cb - 128, cr - 128
    return [clamp(idiv(256 * y + 359 * r, 256)), clamp(idiv(256 * y - (88 * b + 183 * r), 256)), clamp(idiv(256 * y + 454 * b, 256))]


def rgb_to_hsv(r: Column, g: Column, b: Column) -> list[Column]:
    """Hue 0..255 in six sectors of 43; 255 * delta is computed wide."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    delta = top - low
    hue = F.when(top == r, idiv(43 * (g - b), delta)).when(top == g, 85 + idiv(43 * (b - r), delta)).otherwise(171 + idiv(43 * (r - g), delta))
    return [F.when(delta == 0, F.lit(0)).otherwise(hue.bitwiseAND(255)), F.when(delta == 0, F.lit(0)).otherwise(idiv(255 * delta, top)), top]


def hsv_to_rgb(h: Column, s: Column, v: Column) -> list[Column]:
    region = idiv(h, 43)
    c = F.shiftright(v * s, 8)
    x = idiv(c * (43 - F.abs(h % 85 - 43)), 43)
    m = v - c
    top, mid, low = c + m, x + m, m
    # Red, green and blue in each of the six hue sectors.
    sectors = [[top, mid, low], [mid, top, low], [low, top, mid], [low, mid, top], [mid, low, top], [top, low, mid]]
    out = []
    for k in range(3):
        e = F.when(s == 0, v)
        for i in range(5):
            e = e.when(region == i, sectors[i][k])
        out.append(e.otherwise(sectors[5][k]))
    return out


def luma_to(y: Column, fmt: str) -> list[Column]:
    zero, half = F.lit(0), F.lit(128)
    return {"rgb": [y, y, y], "hsv": [zero, zero, y], "ycc": [y, half, half], "rgba": [y, y, y, F.lit(255)]}[fmt]


def to_rgb(c: list[Column], fmt: str) -> list[Column]:
    if fmt == "luma":
        return luma_to(c[0], "rgb")
    if fmt == "hsv":
        return hsv_to_rgb(*c)
    if fmt == "ycc":
        return ycc_to_rgb(*c)
    return c[:3]


def convert(c: list[Column], source: str, target: str) -> list[Column]:
    """Channel expressions of target from those of source (yuyv goes through the pixel-pair operators).

    An anonymous target `?n` truncates or pads with zeros; an anonymous source is read as the target's channels.
    """
    if source == target:
        return c
    if target.startswith("?") or source.startswith("?"):
        n = channels(target)
        return [c[i] if i < len(c) else F.lit(0) for i in range(n)]
    if source == "luma" and target in ("rgb", "hsv", "ycc", "rgba"):
        return luma_to(c[0], target)
    rgb = to_rgb(c, source)
    if target == "rgb":
        return rgb
    if target == "rgba":
        return [*rgb, F.lit(255)]
    return {"luma": rgb_to_luma, "hsv": rgb_to_hsv, "ycc": rgb_to_ycc}[target](*rgb)
