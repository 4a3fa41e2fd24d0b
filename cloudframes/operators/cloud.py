"""Point clouds from depth, confidence, colour and pose tables, and their filters.

Windows along rows and along columns of a frame both find their rows together once pixels are dealt out by frame: one exchange.
"""

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pose import decode_pose, unproject

EDGE = 0.03
#: Bins of a pass of the exact quantile.
BINS = 1 << 15


def finite(c: Column) -> Column:
    """Not null, not NaN and not infinite; Spark orders NaN above all numbers, so comparisons alone don't tell."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def finite_filter(pixels: DataFrame, mode: str = "viewer") -> DataFrame:
    """Finite depth; offline, finite confidence too."""
    keep = finite(F.col("depth"))
    return pixels.where(keep & finite(F.col("conf")) if mode == "offline" else keep)


def conf_filter(points: DataFrame, threshold: Column) -> DataFrame:
    return points.where((F.col("conf") >= threshold) & ~F.isnan("conf"))


def frame_group(rows: DataFrame, group: str = "all") -> DataFrame:
    """All, even or odd frames."""
    return rows if group == "all" else rows.where(F.col("frame") % 2 == (0 if group == "even" else 1))


def frame_group_counts(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("n_all"), F.count_if(F.col("frame") % 2 == 0).alias("n_even"), F.count_if(F.col("frame") % 2 == 1).alias("n_odd"))


def _extremes(rows: DataFrame, lo: str, hi: str, across: str, along: str) -> DataFrame:
    w = Window.partitionBy("frame", across).orderBy(along).rowsBetween(-1, 1)
    return rows.withColumn(lo, F.min(lo).over(w)).withColumn(hi, F.max(hi).over(w))


def depth_edge_mask(pixels: DataFrame, threshold: float = EDGE, dealt: bool = False) -> DataFrame:
    """Adds edge_keep: whether depths of the 3 x 3 pixels around differ by no more than a part of the pixel's own.

    Two passes of three pixels each, along rows and then columns, in place of a join of nine; NaN neighbours don't count. Pixels that
    are `dealt` out by frame already stay where they are.
    """
    pixels = pixels if dealt else pixels.repartition("frame")
    d = F.when(~F.isnan("depth"), F.col("depth"))
    rows = _extremes(_extremes(pixels.withColumn("lo", d).withColumn("hi", d), "lo", "hi", "y", "x"), "lo", "hi", "x", "y")
    keep = (F.col("hi") - F.col("lo")) / F.greatest(F.abs("depth"), F.lit(1e-6)) <= threshold
    return rows.withColumn("edge_keep", F.coalesce(keep & ~F.isnan("depth"), F.lit(False))).drop("lo", "hi")


def grid_neighbors(pixels: DataFrame, value: str = "depth") -> DataFrame:
    """Least, greatest and number of values in the 3 x 3 pixels around, clipped at the borders."""
    rows = pixels.repartition("frame").withColumn("lo", F.col(value)).withColumn("hi", F.col(value)).withColumn("n", F.lit(1))
    w = lambda a, b: Window.partitionBy("frame", a).orderBy(b).rowsBetween(-1, 1)
    rows = _extremes(rows, "lo", "hi", "y", "x").withColumn("n", F.sum("n").over(w("y", "x")))
    return _extremes(rows, "lo", "hi", "x", "y").withColumn("n", F.sum("n").over(w("x", "y")))


def laplacian(gray: DataFrame) -> DataFrame:
    """Interior pixels' left + right + up + down - 4 * own of gray (frame, x, y, v)."""
    row, col = Window.partitionBy("frame", "y").orderBy("x"), Window.partitionBy("frame", "x").orderBy("y")
    rows = gray.repartition("frame").withColumn("l", F.lag("v").over(row) + F.lead("v").over(row)).withColumn("l", F.col("l") + F.lag("v").over(col) + F.lead("v").over(col) - 4 * F.col("v"))
    return rows.where("l is not null")


def laplacian_var(gray: DataFrame) -> DataFrame:
    """frame and its sharpness; 0 for frames without an interior. Sums of integers, so any order gives the same."""
    n, s, ss = F.count("l"), F.sum(F.col("l").cast("double")), F.sum((F.col("l") * F.col("l")).cast("double"))
    found = laplacian(gray).groupBy("frame").agg(((ss - s * s / n) / n).alias("sharpness"))
    return gray.select("frame").distinct().join(found, "frame", "left").withColumn("sharpness", F.coalesce("sharpness", F.lit(0.0)))


def thumb_box(gray: DataFrame, w: int, h: int, out_w: int) -> DataFrame:
    """Box averages of gray (frame, x, y, v), w x h pixels, at out_w pixels across; truncated as integers."""
    ow = max(1, min(out_w, w))
    oh = -(-h * ow // w)
    box = lambda c, o, n: F.floor(((F.col(c) + 1) * o - 1) / n).cast("long")
    return gray.groupBy("frame", box("x", ow, w).alias("tx"), box("y", oh, h).alias("ty")).agg(F.floor(F.sum("v") / F.count("v")).cast("long").alias("v"))


def chunk_assign(frames: DataFrame, size: int = 8) -> DataFrame:
    """Chunk number, first frame and number of frames of each run of `size` frames."""
    return frames.groupBy(F.floor(F.col("frame") / size).cast("long").alias("chunk")).agg(F.min("frame").alias("first_frame"), F.count(F.lit(1)).alias("n_frames"))


def conf_quantile(points: DataFrame, q: float, value: str = "conf") -> DataFrame:
    """One row with `threshold`: the value of rank floor((n - 1) * q) of all finite ones, -infinity if there are none.

    Nothing is sorted. A pass counts the values by bin and finds the bin that holds the rank; the next one splits that bin's range,
    until it has one value. The first pass bins by sign, binary exponent and leading bits, so outliers can't crowd the rest into one
    bin; later ones split between the bin's least and greatest value. A pass gives the driver one row. The values are computed once
    and kept on the executors' disks while this runs.
    """
    q = min(1.0, max(0.0, q))
    v = points.select(F.col(value).cast("double").alias("v")).where(finite(F.col("v"))).persist(StorageLevel.DISK_ONLY)
    try:
        low, high, n = v.agg(F.min("v"), F.max("v"), F.count("v")).first()
        rank, inside, first = int((n - 1) * q), v, True
        while n and low < high:
            if first:
                size = F.abs("v")
                exponent = F.least(F.floor(F.log2(size)), F.lit(1023))
                key = F.when(F.col("v") == 0, 0).otherwise(F.signum("v") * ((exponent + 1100) * 256 + F.floor((size / F.pow(F.lit(2.0), exponent) - 1) * 256)))
            else:  # halves, so that the range of any two doubles is one
                key = F.floor((F.col("v") / 2 - low / 2) / (high / 2 - low / 2) * BINS)
            counts = inside.groupBy(key.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("low"), F.max("v").alias("high"))
            upto = counts.withColumn("before", F.sum("c").over(Window.orderBy("bin")) - F.col("c"))
            low, high, before = upto.where((F.col("before") <= rank) & (F.col("before") + F.col("c") > rank)).select("low", "high", "before").first()
            rank, inside, first = rank - before, v.where(F.col("v").between(low, high)), False
    finally:
        v.unpersist()
    return points.sparkSession.range(1).select(F.lit(float(low) if n else float("-inf")).alias("threshold"))


def cameras(pose: DataFrame) -> DataFrame:
    """pose (frame, width, height, enc) as cameras with rotation, translation and intrinsics."""
    c = decode_pose(F.col("enc"), F.col("width"), F.col("height"))
    return pose.select("frame", "width", "height", *[v.alias(k) for k, v in c.items()])


def build_cloud(depth: DataFrame, rgb: DataFrame, pose: DataFrame, mode: str = "viewer", quantile: float | None = None, edge: float = EDGE) -> DataFrame:
    """points(frame, px, py, x, y, z, r, g, b, conf) of all pixels that pass the finite and edge filters, and a confidence quantile if one is given.

    Offline, the quantile is over all finite confidences; in the viewer, over the retained points. Depth and colours (each has a pixel
    once) are dealt out by frame together, meet there by a sum over each pixel, and stay for the edge filter and the cameras.
    """
    columns = {"depth": "double", "conf": "double", "has_depth": "boolean", "r": "long", "g": "long", "b": "long"}
    side = lambda rows, have: rows.select("frame", "x", "y", *[have[c].cast(t).alias(c) if c in have else F.lit(None).cast(t).alias(c) for c, t in columns.items()])
    both = side(depth, {"depth": F.col("depth"), "conf": F.col("conf"), "has_depth": F.lit(True)}).union(side(rgb, {c: F.col(c) for c in "rgb"}))
    pixels = both.repartition("frame").groupBy("frame", "x", "y").agg(*[F.max(c).alias(c) for c in columns]).where("has_depth").drop("has_depth")
    kept = finite_filter(depth_edge_mask(pixels, edge, dealt=True).where("edge_keep"), mode).where("r is not null")
    if quantile is not None:
        threshold = conf_quantile(depth if mode == "offline" else kept, quantile)
        kept = conf_filter(kept.crossJoin(F.broadcast(threshold)), F.col("threshold")).drop("threshold")
    rows = kept.join(cameras(pose), "frame")
    x, y, z = unproject(F.col("x"), F.col("y"), F.col("depth"))
    return rows.select("frame", F.col("x").alias("px"), F.col("y").alias("py"), x.alias("wx"), y.alias("wy"), z.alias("wz"), "r", "g", "b", "conf")


def refilter_cloud(points: DataFrame, quantile: float, group: str = "all") -> DataFrame:
    """Stored points under another quantile or frame group; nothing is unprojected again."""
    chosen = frame_group(points, group)
    return conf_filter(chosen.crossJoin(F.broadcast(conf_quantile(points, quantile))), F.col("threshold")).drop("threshold")


def cloud_stats(points: DataFrame, kept: DataFrame, chunk: int = 8) -> DataFrame:
    """Numbers of points, chunks and cameras, and the percentage kept."""
    n = kept.agg(F.count(F.lit(1)).alias("n_kept"))
    return points.agg(F.count(F.lit(1)).alias("n_points"), F.count_distinct(F.floor(F.col("frame") / chunk)).alias("n_chunks"), F.count_distinct("frame").alias("n_cameras")).crossJoin(n).withColumn("kept_pct", F.coalesce(F.try_divide(F.col("n_kept") * 100.0, F.col("n_points")), F.lit(0.0)))


def depth_consistency_vote(pixels: DataFrame, cams: DataFrame, depth: DataFrame, tolerance: float = 0.05, reach: int = 1) -> DataFrame:
    """Pixels (frame, x, y, wx, wy, wz) with how many of the `reach` frames before and after see the same depth at their place.

    A frame's depth is one row of arrays that goes to the frames beside it with its camera, so what is exchanged beside each pixel once
    is frames times reach. One frame's pixels and its neighbours' are one task's at a time.
    """
    known = depth.where(finite(F.col("depth")))
    grids = known.groupBy("frame").agg(F.collect_list(F.struct("x", "y", F.col("depth").cast("double").alias("depth"))).alias("grid"))
    beside = F.explode(F.filter(F.sequence(F.col("of") - reach, F.col("of") + reach), lambda k: k != F.col("of")))
    near = grids.join(cams, "frame").withColumnRenamed("frame", "of").select(beside.alias("frame"), "*")

    def vote(own: pa.Table, others: pa.Table) -> pa.Table:
        world = np.stack([np.asarray(own.column(c), float) for c in ("wx", "wy", "wz")])
        votes = np.zeros(own.num_rows, np.int64)
        for k in range(others.num_rows if own.num_rows else 0):
            at = {c: others.column(c)[k].as_py() for c in others.column_names if c not in ("frame", "of", "grid")}
            grid = others.column("grid")[k].values
            x, y, d = (np.asarray(grid.field(c)) for c in ("x", "y", "depth"))
            if not len(d):
                continue
            there = np.full((y.max() + 1, x.max() + 1), np.nan)
            there[y, x] = d
            turn = np.array([[at[f"r{i}{j}"] for j in range(3)] for i in range(3)])
            cx, cy, expected = turn @ world + np.array([at[f"t{i}"] for i in range(3)])[:, None]
            with np.errstate(all="ignore"):
                px, py = cx / expected * at["fx"] + at["cx"], cy / expected * at["fy"] + at["cy"]
                px, py = (np.sign(v) * np.floor(np.abs(v) + 0.5) for v in (px, py))
                inside = np.flatnonzero((px >= 0) & (py >= 0) & (px < there.shape[1]) & (py < there.shape[0]))
                seen = there[py[inside].astype(np.int64), px[inside].astype(np.int64)]
                votes[inside] += np.abs(seen - expected[inside]) <= tolerance * np.abs(expected[inside])
        return pa.table({"frame": own.column("frame"), "x": own.column("x"), "y": own.column("y"), "votes": votes})

    of = pixels.select(*[F.col(c).cast("long").alias(c) for c in ("frame", "x", "y")], "wx", "wy", "wz")
    return of.groupBy("frame").cogroup(near.groupBy("frame")).applyInArrow(vote, "frame long, x long, y long, votes long")
