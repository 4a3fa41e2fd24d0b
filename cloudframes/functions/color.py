"""Tone curves, luma and quantisation as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Published constants of the log curve (fixed values).
LOG_BREAK, LOG_TOE, LOG_SLOPE, LOG_MID, LOG_RANGE, LOG_OFFSET, LOG_GAIN = 0.14, 0.0929, 6.025, 0.584555, 0.256663, 0.0108, 0.9892


def luma601(r: Column, g: Column, b: Column) -> Column:
    return F.shiftright((77 * r + 150 * g + 29 * b + 128).cast("long"), 8)


def quantize_color(c: Column) -> Column:
    """A colour in 0..1 as 0..255, half up."""
    return F.floor(F.least(F.greatest(c * 255 + 0.5, F.lit(0.0)), F.lit(255.0))).cast("long")


def dlog_decode(y: Column) -> Column:
    """Scene-linear light of a log code value."""
    return F.when(y <= LOG_BREAK, (y - LOG_TOE) / LOG_SLOPE).otherwise((F.pow(F.lit(10.0), (y - LOG_MID) / LOG_RANGE) - LOG_OFFSET) / LOG_GAIN)


def srgb_encode(x: Column) -> Column:
    return F.when(x <= 0.0031308, 12.92 * x).otherwise(1.055 * F.pow(x, F.lit(1 / 2.4)) - 0.055)


def dlog_to_rec709(y: Column) -> Column:
    return srgb_encode(F.least(F.greatest(dlog_decode(y), F.lit(0.0)), F.lit(1.0)))


def activations(logit: Column) -> dict[str, Column]:
    """Depth, confidence and field of view from their logits."""
    return {"depth": F.exp(logit), "conf": 1 + F.exp(logit), "fov": F.greatest(logit, F.lit(0.0)) + 0.01}
