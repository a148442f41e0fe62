"""Colour maths on '#rrggbb' columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def channels(color: Column) -> list[Column]:
    return [F.conv(F.substring(color, i, 2), 16, 10).cast("double") for i in (2, 4, 6)]


def linear(c: Column) -> Column:
    x = c / 255
    return F.when(x <= 0.04045, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, 2.4))


def luminance(color: Column) -> Column:
    r, g, b = map(linear, channels(color))
    return 0.2126 * r + 0.7152 * g + 0.0722 * b


def oklab(color: Column) -> tuple[Column, Column, Column]:
    return _lab(*_cones(*map(linear, channels(color))))


def _cones(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    # The two matrices of the colour space.
    return (F.cbrt(0.4122214708 * r + 0.5363325363 * g + 0.0514459929 * b), F.cbrt(0.2119034982 * r + 0.6806995451 * g + 0.1073969566 * b), F.cbrt(0.0883024619 * r + 0.2817188376 * g + 0.6299787005 * b))


def _lab(l_: Column, m_: Column, s_: Column) -> tuple[Column, Column, Column]:
    return (0.2104542553 * l_ + 0.793617785 * m_ - 0.0040720468 * s_, 1.9779984951 * l_ - 2.428592205 * m_ + 0.4505937099 * s_, 0.0259040371 * l_ + 0.7827717662 * m_ - 0.808675766 * s_)


def with_oklab(df: DataFrame) -> DataFrame:
    """``df`` with l, a and b of its hex: as oklab(), but each part is a column that is worked out once a row, where one expression would repeat its parts dozens of times."""
    out, names = df, df.columns
    steps = [lambda: channels(F.col("hex")), lambda: map(linear, parts), lambda: _cones(*parts), lambda: _lab(*parts)]
    for k, step in enumerate(steps):
        found = [x.alias(n if k == len(steps) - 1 else f"_{n}{k}") for x, n in zip(step(), "lab", strict=True)]
        out = out.select(*names, *found)
        parts = [F.col(f"_{n}{k}") for n in "lab"]
    return out


def oklch(color: Column) -> tuple[Column, Column, Column]:
    lightness, a, b = oklab(color)
    hue = F.degrees(F.atan2(b, a))
    return lightness, F.hypot(a, b), F.when(hue < 0, hue + 360).otherwise(hue)


def lstar(color: Column) -> Column:
    y = luminance(color)
    return F.when(y > 0.008856, 116 * F.cbrt(y) - 16).otherwise(903.3 * y)


def contrast(x: Column, y: Column) -> Column:
    a, b = luminance(x), luminance(y)
    return (F.greatest(a, b) + 0.05) / (F.least(a, b) + 0.05)


def is_neutral(lightness: Column, chroma: Column) -> Column:
    return chroma < F.when(lightness < 0.3, 0.075).when(lightness > 0.92, 0.04).otherwise(0.048)


def hue_difference(a: Column, b: Column) -> Column:
    d = F.abs(a - b) % 360
    return F.when(d > 180, 360 - d).otherwise(d)


def bin5(color: Column) -> Column:
    """The 15-bit histogram bin of a colour: five bits a channel."""
    r, g, b = (c.cast("int") for c in channels(color))
    return (F.shiftleft(F.shiftright(r, 3), 10) + F.shiftleft(F.shiftright(g, 3), 5) + F.shiftright(b, 3)).cast("long")
