"""Per-pixel colour conversions in single precision, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import clamp, ratio, real


def _byte() -> Column:
    return real(255.0)


def _unit() -> Column:
    return ratio(1.0, 255.0)


def grey(r: Column, g: Column, b: Column) -> Column:
    """8-bit luma by 14-bit fixed-point weights."""
    return F.shiftright(r * 4899 + g * 9617 + b * 1868 + 8192, 14)


def rgb_to_hsv(r: Column, g: Column, b: Column, hue_max: int = 255) -> list[Column]:
    """Hue, saturation and value; hue 0 for black and grey."""
    top = F.greatest(r, g, b)
    fr, fg, fb = (real(c) * _unit() for c in (r, g, b))
    f_top, f_low = real(top) * _unit(), real(F.least(r, g, b)) * _unit()
    delta = f_top - f_low
    turn = ratio(1.0, real(6.0) * delta)
    raw = (F.when(top == r, (fg - fb) * turn)
           .when(top == g, ratio(2.0, 6.0) + (fb - fr) * turn)
           .otherwise(ratio(4.0, 6.0) + (fr - fg) * turn))
    raw = F.when(raw < 0, raw + real(1.0)).otherwise(raw)
    raw = F.when(raw >= 1, raw - real(1.0)).otherwise(raw)
    hue = F.when(delta == 0, real(0.0)).otherwise(raw)
    saturation = F.when(top == 0, real(0.0)).otherwise(ratio(delta, f_top))

    def byte(c: Column) -> Column:
        return clamp((real(0.5) + c * _byte()).cast("int"), 0, 255)

    h = byte(hue)
    if hue_max != 255:
        h = F.floor(h * hue_max / 255).cast("int")
    return [h.alias("hue"), byte(saturation).alias("sat"), byte(f_top).alias("val")]


def hsv_to_rgb(h: Column, s: Column, v: Column, hue_max: int = 255) -> list[Column]:
    """Red, green and blue; truncates, and hue 255 wraps to 0."""
    if hue_max != 255:
        h = F.floor(h * 255 / hue_max).cast("int")
    fh, fs, fv = (real(c) * _unit() for c in (h, s, v))
    fh = F.when(fh >= 1, real(0.0)).otherwise(fh)
    turn = real(fh.cast("double") * 6.0)
    sector = turn.cast("int")
    part = turn - real(F.floor(turn))
    one = real(1.0)
    p, q, t = fv * (one - fs), fv * (one - fs * part), fv * (one - fs * (one - part))
    wheel = [(fv, t, p), (q, fv, p), (p, fv, t), (p, q, fv), (t, p, fv)]

    def channel(i: int) -> Column:
        c = F.when(s == 0, fv)
        for number, triple in enumerate(wheel):
            c = c.when(sector == number, triple[i])
        return clamp((c.otherwise((fv, p, q)[i]) * _byte()).cast("int"), 0, 255)

    return [channel(i).alias(name) for i, name in enumerate(("red", "green", "blue"))]


# Chroma minima and the YIQ matrix (I and Q weights per channel).
MIN_I, MIN_Q = -0.5957, -0.5226
YIQ_WEIGHTS = {"red": (0.9563, 0.6210), "green": (-0.2721, -0.6474), "blue": (-1.1070, 1.7046)}


def yiq_to_rgb(y: Column, i: Column, q: Column) -> list[Column]:
    span = lambda low: ratio(real(-2.0) * real(low), 255.0)
    fy = real(y) * _unit()
    fi = real(i) * span(MIN_I) + real(MIN_I)
    fq = real(q) * span(MIN_Q) + real(MIN_Q)
    return [clamp(((fy + real(a) * fi + real(b) * fq) * _byte()).cast("int"), 0, 255).alias(name)
            for name, (a, b) in YIQ_WEIGHTS.items()]
