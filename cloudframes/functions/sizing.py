"""Sizes and crops of frames at model resolution, as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

PATCH, TOKENS, EXTRA_TOKENS = 16, 1024.0, 17
LEAST_ASPECT, MOST_ASPECT = 0.5, 2.0
#: Known aspect ratios in the order in which they are tried (fixed values).
RATIOS = ((16, 9), (9, 16), (3, 2), (2, 3), (4, 3), (3, 4), (1, 1), (21, 9))


def _int(c: Column) -> Column:
    return F.round(c).cast("long")


def clamp_aspect(w: Column, h: Column) -> tuple[Column, Column]:
    """Width and height cropped so that height over width lies in [0.5, 2]."""
    ar = h / w
    return F.when(ar < LEAST_ASPECT, _int(h / LEAST_ASPECT)).otherwise(w).cast("long"), F.when(ar > MOST_ASPECT, _int(w * MOST_ASPECT)).otherwise(h).cast("long")


def balanced_grid(w: Column, h: Column) -> tuple[Column, Column]:
    """Patches across and down, about 1024 in all; the height uses the unrounded width."""
    exact = F.sqrt(F.lit(TOKENS) / (h / w))
    return F.greatest(_int(exact), F.lit(1)).cast("long"), F.greatest(_int(F.lit(TOKENS) / exact), F.lit(1)).cast("long")


def target_size(w: Column, h: Column) -> tuple[Column, Column]:
    cols, rows = balanced_grid(*clamp_aspect(w, h))
    return cols * PATCH, rows * PATCH


def crop_to_aspect(w: Column, h: Column, aspect: Column) -> tuple[Column, Column]:
    tall = h / w > aspect
    return F.when(tall, w).otherwise(_int(h / aspect)).cast("long"), F.when(tall, _int(w * aspect)).otherwise(h).cast("long")


def centered_crop(w: Column, h: Column, tw: Column, th: Column, scale: Column) -> dict[str, Column]:
    """x, y, width and height of a centred crop with the target's shape, shrunk by a scale in [0.05, 1]."""
    cw, ch = crop_to_aspect(w, h, th / tw)
    s = F.least(F.greatest(scale, F.lit(0.05)), F.lit(1.0))
    cw2 = F.least(F.greatest(_int(cw * s), F.lit(PATCH)), cw)
    ch2 = F.least(F.greatest(_int(cw2 * ch / cw), F.lit(1)), ch)
    return {"crop_x": F.floor((w - cw2) / 2).cast("long"), "crop_y": F.floor((h - ch2) / 2).cast("long"), "crop_w": cw2, "crop_h": ch2}


def crop_loss(w: Column, h: Column, cw: Column, ch: Column) -> Column:
    """The part of the source's pixels that a crop loses."""
    return F.lit(1.0) - cw * ch / (w * h)


def patch_tokens(w: Column, h: Column) -> Column:
    """Patches of a frame, null where a side isn't a multiple of 16."""
    return F.when((w % PATCH == 0) & (h % PATCH == 0), F.floor(w / PATCH) * F.floor(h / PATCH)).cast("long")


def frame_tokens(w: Column, h: Column) -> Column:
    return patch_tokens(w, h) + EXTRA_TOKENS


def even_height(w: Column, h: Column, out_w: Column) -> Column:
    """The even height nearest to the source's shape at a width, at least 2."""
    return F.greatest(_int(h * out_w / w / 2) * 2, F.lit(2)).cast("long")


def crop_scale_clamp(scale: Column, selected: Column | None = None) -> Column:
    """A zoom in [0.3, 1]; frames that aren't selected keep null."""
    clamped = F.least(F.greatest(scale, F.lit(0.3)), F.lit(1.0))
    return clamped if selected is None else F.when(selected, clamped)


def ratio_label(w: Column, h: Column) -> Column:
    out = F.concat(w.cast("string"), F.lit("×"), h.cast("string"))
    for a, b in reversed(RATIOS):
        out = F.when(F.abs(w / h - a / b) < 0.02, F.lit(f"{a}:{b}")).otherwise(out)
    return out


def est_cost_s(n: Column) -> Column:
    """Seconds that a session of n frames takes."""
    r = n / F.lit(120.0)
    return F.lit(227.0) * r * r + F.lit(100.0) * r


def wire_size(w: Column, h: Column, frames: Column) -> dict[str, Column]:
    """Bytes of an RGB frame, and of a chunk of half-precision depth and confidence."""
    return {"rgb_bytes": (w * h * 3).cast("long"), "chunk_bytes": (w * h * frames * 4).cast("long")}


def candidate_step(fps: Column) -> Column:
    """Frames from one candidate to the next: about two a second."""
    return F.greatest(F.round(fps / 2), F.lit(1.0)).cast("long")
