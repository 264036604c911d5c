"""Sizes and per-value arithmetic of rasters and tensors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Detector normalisation, by channel position.
DETECTOR_MEAN = (0.485, 0.456, 0.406)
DETECTOR_STD = (0.229, 0.224, 0.225)
DETECTOR_LONG_SIDE = 960
STRIDE = 32


def detector_side(side: Column, longest: Column) -> Column:
    """A side after limiting the longest to 960: to the nearest multiple of 32 (half to even), 32 at least."""
    limited = F.when(longest > DETECTOR_LONG_SIDE, F.floor(side * DETECTOR_LONG_SIDE / longest)).otherwise(side)
    return F.greatest(F.lit(STRIDE), (F.rint(limited / F.lit(float(STRIDE))) * STRIDE).cast("int"))


def padded_side(side: Column, width: Column, height: Column) -> Column:
    """Images with width + height below 64 are padded to 32 on each side."""
    return F.when(width + height < 64, F.greatest(side, F.lit(32))).otherwise(side)


def single(column: Column) -> Column:
    return column.cast("float")


def detector_scale(tensor: Column, padded: Column) -> Column:
    return single(single(tensor) / single(padded))


def on_white(value: Column, alpha: Column) -> Column:
    return F.floor((value * alpha + 255 * (255 - alpha) + 127) / 255).cast("int")


def detector_value(value: Column, channel: int) -> Column:
    scaled = single(single(value) / single(F.lit(255.0)))
    return single(single(scaled - single(F.lit(DETECTOR_MEAN[channel]))) / single(F.lit(DETECTOR_STD[channel])))


def recogniser_value(value: Column) -> Column:
    return single(single(single(value) / single(F.lit(127.5))) - single(F.lit(1.0)))


def bilinear_tap(target: Column, source_size: int, target_size: int) -> dict[str, Column]:
    """Left source index and both 11-bit weights of a target position (pixel centres, clamped edges)."""
    position = (target + 0.5) * F.lit(source_size / target_size) - 0.5
    low = F.floor(position).cast("int")
    fraction = single(position - low)
    before, after = position < 0, low >= source_size - 1
    edge = before | after if source_size > 1 else F.lit(True)
    left = F.when(before if source_size > 1 else F.lit(True), 0).when(after, source_size - 1).otherwise(low)
    return {
        "left": left.cast("int"),
        "w0": F.when(edge, 2048).otherwise(F.rint(single(single(F.lit(1.0)) - fraction) * single(F.lit(2048.0))).cast("int")),
        "w1": F.when(edge, 0).otherwise(F.rint(fraction * single(F.lit(2048.0))).cast("int")),
    }
