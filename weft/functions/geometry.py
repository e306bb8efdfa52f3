"""Arithmetic of image tiles and letterboxes; no pixels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TILE, UPSCALED, SMALL = 448, 528, 800


def work_size(w: Column, h: Column) -> tuple[Column, Column]:
    """Width and height after small images are enlarged."""
    side = F.least(w, h)
    scale = F.lit(float(UPSCALED)) / F.greatest(side, F.lit(1))
    up = lambda x: F.greatest(F.lit(2), F.bround(x * scale, 0).cast("long"))
    return F.when(side < TILE, up(w)).otherwise(w), F.when(side < TILE, up(h)).otherwise(h)


def overlap(w: Column, h: Column) -> Column:
    side = F.least(w, h)
    wish = F.bround(F.when(side < SMALL, 0.2).otherwise(0.1) * side, 0).cast("long")
    cap = F.least(F.floor(w / 2), F.floor(h / 2)) - 1
    return F.when(cap < 0, F.lit(0)).otherwise(F.greatest(F.lit(0), F.least(wish, cap))).cast("long")


def tile_boxes(w: Column, h: Column) -> Column:
    """array of struct<x0, y0, x1, y1>: two by two overlapping tiles, then the whole image."""
    mx, my, ov = F.floor(w / 2), F.floor(h / 2), overlap(w, h)
    box = lambda a, b, c, d: F.struct(*[x.cast("long").alias(n) for x, n in zip((a, b, c, d), ("x0", "y0", "x1", "y1"), strict=True)])
    zero = F.lit(0)
    return F.array(box(zero, zero, mx + ov, my + ov), box(mx - ov, zero, w, my + ov), box(zero, my - ov, mx + ov, h), box(mx - ov, my - ov, w, h), box(zero, zero, w, h))


def letterbox(w: Column, h: Column, target: int = TILE) -> Column:
    """struct of the scaled size and its offset on a square canvas."""
    scale = F.least(F.lit(float(target)) / w, F.lit(float(target)) / h)
    nw, nh = F.greatest(F.lit(1), F.bround(w * scale, 0).cast("long")), F.greatest(F.lit(1), F.bround(h * scale, 0).cast("long"))
    return F.struct(nw.alias("new_w"), nh.alias("new_h"), F.floor((target - nw) / 2).alias("off_x"), F.floor((target - nh) / 2).alias("off_y"))


def patch_coverage(x0: Column, y0: Column, x1: Column, y1: Column, grid: int = 16, target: int = TILE) -> Column:
    """Share of patches of a square grid that the content box covers at least in half."""
    side = target // grid
    span = lambda i, a, b: F.greatest(F.lit(0), F.least(b, (i + 1) * side) - F.greatest(a, i * side))
    cells = F.transform(F.sequence(F.lit(0), F.lit(grid * grid - 1)), lambda k: (span(F.floor(k / grid), y0, y1) * span(k % grid, x0, x1) * 2 >= side * side).cast("int"))
    return F.aggregate(cells, F.lit(0), lambda a, x: a + x) / float(grid * grid)
