"""Dense frame kernels: scores, thumbnails, colour tables and resampling. Numpy works on one batch of frames inside a task."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.color import dlog_to_rec709

CORNERS = 8


#: Steps a channel that a colour table has at most, so that it can be sent to all tasks.
MOST_STEPS = 129


def lut_apply(colors: DataFrame, lattice: DataFrame, keys: tuple = ("id",)) -> DataFrame:
    """colors (keys, cr, cg, cb) through a colour table's lattice, trilinear, inputs clamped to its domain; keys with o_r, o_g, o_b.

    The lattice, whose size is tested, goes to all tasks as one array, and pixels are looked up where they are: no exchange. A colour
    with a null or NaN channel has null results; an empty lattice gives no rows; a lattice with a cell missing is an error.
    """
    spark = colors.sparkSession
    rows = colors.select(*keys, *[F.col(c).cast("double").alias(f"_{c}") for c in ("cr", "cg", "cb")])
    outputs = [StructField(c, DoubleType()) for c in ("o_r", "o_g", "o_b")]
    schema = StructType([*rows.schema.fields[: len(keys)], *outputs])
    head = lattice.select("size", "dmin", "dmax").first()
    if head is None:
        return spark.createDataFrame([], schema)
    n = int(head["size"])
    if not 2 <= n <= MOST_STEPS:
        raise ValueError(f"a colour table has 2 to {MOST_STEPS} steps, not {n}")
    cells = lattice.select("r", "g", "b", "o_r", "o_g", "o_b").limit(n**3 + 1).toArrow()
    table = np.full((n, n, n, 3), np.nan)
    r, g, b = (np.asarray(cells.column(c)).astype(int) for c in ("r", "g", "b"))
    table[b, g, r] = np.stack([np.asarray(cells.column(c)) for c in ("o_r", "o_g", "o_b")], 1)
    if len(cells) != n**3 or np.isnan(table).any():
        raise ValueError(f"a colour table of {n} steps has {n**3} cells, not {len(cells)}")
    shared = spark.sparkContext.broadcast((table, list(head["dmin"]), list(head["dmax"])))

    def run(batches):
        table, low, high = shared.value
        for batch in batches:
            rgb = np.stack([batch.column(f"_{c}").to_numpy(zero_copy_only=False).astype(float) for c in ("cr", "cg", "cb")], 1)
            unknown = np.isnan(rgb).any(1)
            out = lut_numpy(np.where(unknown[:, None], 0.0, rgb), table, low, high)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *(pa.array(out[:, k], mask=unknown) for k in range(3))], names=[*keys, "o_r", "o_g", "o_b"])

    return rows.mapInArrow(run, schema)


def lut_numpy(rgb: np.ndarray, table: np.ndarray, dmin=(0, 0, 0), dmax=(1, 1, 1)) -> np.ndarray:
    """The same for an array (..., 3) and a table of shape (n, n, n, 3), blue outermost."""
    n = len(table)
    t = np.clip((rgb - np.asarray(dmin)) / (np.asarray(dmax) - np.asarray(dmin)), 0, 1) * (n - 1)
    i = np.minimum(np.floor(t).astype(int), n - 1)
    f, j = t - i, np.minimum(i + 1, n - 1)
    out = np.zeros_like(t)
    for corner in range(CORNERS):
        up = [corner >> k & 1 for k in range(3)]
        at = [np.where(up[k], j[..., k], i[..., k]) for k in range(3)]
        out += np.prod([f[..., k] if up[k] else 1 - f[..., k] for k in range(3)], axis=0)[..., None] * table[at[2], at[1], at[0]]
    return out


def tonemap(c: Column, kind: Column, looked_up: Column, is_video: Column) -> Column:
    """A channel by its tone map: of a colour table, parametric or none; photos stay as they are."""
    return F.when(~is_video, c).when(kind == "cube", looked_up).when(kind == "parametric", dlog_to_rec709(c)).otherwise(c)


def luma(rgb: np.ndarray) -> np.ndarray:
    return (77 * rgb[..., 0].astype(int) + 150 * rgb[..., 1].astype(int) + 29 * rgb[..., 2].astype(int) + 128) >> 8


def sharpness(gray: np.ndarray) -> float:
    h, w = gray.shape
    if w < 3 or h < 3:
        return 0.0
    g = gray.astype(np.int64)
    lap = g[1:-1, :-2] + g[1:-1, 2:] + g[:-2, 1:-1] + g[2:, 1:-1] - 4 * g[1:-1, 1:-1]
    s, n = float(lap.sum()), lap.size
    return (float((lap * lap).sum()) - s * s / n) / n


def box_thumb(pixels: np.ndarray, out_w: int) -> np.ndarray:
    """Box averages, truncated; the height keeps the shape, rounded up."""
    h, w = pixels.shape[:2]
    ow = max(1, min(out_w, w))
    oh = -(-h * ow // w)
    ys, xs = np.arange(oh) * h // oh, np.arange(ow) * w // ow
    sums = np.add.reduceat(np.add.reduceat(pixels.astype(np.int64), ys, axis=0), xs, axis=1)
    area = np.diff(np.append(ys, h))[:, None] * np.diff(np.append(xs, w))[None, :]
    return (sums // (area if pixels.ndim == 2 else area[..., None])).astype(np.uint8)


def _frames(batch: pa.RecordBatch):
    """Rows of a batch, with the pixels as a view of its memory."""
    rest = batch.drop_columns(["rgb"]).to_pylist()
    for row, rgb in zip(rest, batch.column("rgb"), strict=True):
        yield row | {"rgb": np.frombuffer(rgb.as_buffer(), np.uint8)}


def score_frames(frames: DataFrame) -> DataFrame:
    """session, frame, sharpness and thumbnails of frames (session, frame, width, height, rgb): one pass, a batch of frames at a time."""

    def run(batches):
        for batch in batches:
            rows = []
            for f in _frames(batch):
                rgb = f["rgb"].reshape(f["height"], f["width"], 3)
                gray = luma(box_thumb(rgb, 480))
                rows.append({"session": f["session"], "frame": f["frame"], "sharpness": sharpness(gray), "gray_thumb": box_thumb(gray, 64).tobytes(), "rgb_thumb": box_thumb(rgb, 320).tobytes()})
            yield pa.RecordBatch.from_pylist(rows, schema=_SCORED)

    return frames.select("session", "frame", "width", "height", "rgb").mapInArrow(run, "session string, frame long, sharpness double, gray_thumb binary, rgb_thumb binary")


_SCORED = pa.schema([("session", pa.string()), ("frame", pa.int64()), ("sharpness", pa.float64()), ("gray_thumb", pa.binary()), ("rgb_thumb", pa.binary())])


def oriented(pixels: np.ndarray, orientation: int) -> np.ndarray:
    """Pixels as orientation 1 to 8 says they should be seen."""
    if orientation in (5, 6, 7, 8):
        pixels = np.swapaxes(pixels, 0, 1)
    if orientation in (3, 4, 7, 8):
        pixels = pixels[::-1]
    if orientation in (2, 3, 6, 7):
        pixels = pixels[:, ::-1]
    return pixels


def lanczos_weights(n: int, out: int, a: int = 3) -> np.ndarray:
    """A matrix (out, n) of normalised Lanczos weights; the kernel widens when shrinking."""
    scale = max(n / out, 1.0)
    x = (np.arange(n)[None, :] + 0.5 - (np.arange(out)[:, None] + 0.5) * n / out) / scale
    w = np.where(np.abs(x) < a, np.sinc(x) * np.sinc(x / a), 0.0)
    return w / w.sum(1, keepdims=True)


def resample(pixels: np.ndarray, w: int, h: int) -> np.ndarray:
    return np.einsum("yY,YXc,xX->yxc", lanczos_weights(pixels.shape[0], h), pixels, lanczos_weights(pixels.shape[1], w), optimize=True)


def prepare_frames(frames: DataFrame) -> DataFrame:
    """session, frame and RGB bytes at target size of frames (…, crop_x, crop_y, crop_w, crop_h, target_w, target_h, orientation, parametric)."""

    def curve(y):
        linear = np.where(y <= 0.14, (y - 0.0929) / 6.025, (10 ** ((y - 0.584555) / 0.256663) - 0.0108) / 0.9892)
        linear = np.clip(linear, 0, 1)
        return np.where(linear <= 0.0031308, 12.92 * linear, 1.055 * linear ** (1 / 2.4) - 0.055)

    def run(batches):
        for batch in batches:
            for f in _frames(batch):
                rgb = oriented(f["rgb"].reshape(f["height"], f["width"], 3), f["orientation"])
                part = rgb[f["crop_y"] : f["crop_y"] + f["crop_h"], f["crop_x"] : f["crop_x"] + f["crop_w"]] / 255.0
                out = resample(curve(part) if f["parametric"] else part, f["target_w"], f["target_h"])
                yield pa.RecordBatch.from_pylist([{"session": f["session"], "frame": f["frame"], "rgb": np.floor(np.clip(out * 255 + 0.5, 0, 255)).astype(np.uint8).tobytes()}], schema=_PREPARED)

    return frames.mapInArrow(run, "session string, frame long, rgb binary")


_PREPARED = pa.schema([("session", pa.string()), ("frame", pa.int64()), ("rgb", pa.binary())])
