"""Keyframe selection: sharpest of each window, redundancy pruning, budgets, bursts and the reference frame."""

from math import asin, cos, radians, sin, sqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import timestamp_secs

WINDOW, MIN_MOVE_M, MIN_YAW_DEG, MIN_DIFF, BURST_GAP_S = 4, 0.5, 5.0, 4.0, 2


def sharpest_per_window(candidates: DataFrame, size: int = WINDOW, keys: tuple = ("video",)) -> DataFrame:
    """The sharpest of every `size` candidates in order of ci, ties to the earlier; one sort by (keys, window)."""
    w = Window.partitionBy(*keys, "win").orderBy(F.desc("sharpness"), "ci")
    rows = candidates.withColumn("win", F.floor(F.col("ci") / size).cast("long"))
    return rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn", "win")


def mean_abs_diff(a: Column, b: Column) -> Column:
    """Mean absolute difference of two equally long pixel arrays."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("double")), F.lit(0.0), lambda s, x: s + x)
    return total / F.size(a)


def differs(a: tuple, b: tuple, move: float = MIN_MOVE_M, yaw: float = MIN_YAW_DEG, diff: float = MIN_DIFF) -> bool:
    """Whether frames (lat, lon, yaw, px) are far enough apart: by place and heading if both have a fix, else by pixels, if both have some."""
    if a[0] is None or b[0] is None:
        return a[3] is not None and b[3] is not None and sum(abs(x - y) for x, y in zip(a[3], b[3], strict=True)) / max(1, len(b[3])) >= diff
    p, q = radians(b[0] - a[0]) / 2, radians(b[1] - a[1]) / 2
    dist = 2 * 6_371_000.0 * asin(sqrt(sin(p) ** 2 + cos(radians(a[0])) * cos(radians(b[0])) * sin(q) ** 2))
    turn = (a[2] - b[2]) % 360 if a[2] is not None and b[2] is not None else 0.0
    return dist >= move or abs(turn - 360 if turn > 180 else turn) >= yaw


def prune_redundant(survivors: DataFrame, keys: tuple = ("video",), move: float = MIN_MOVE_M, yaw: float = MIN_YAW_DEG, diff: float = MIN_DIFF) -> DataFrame:
    """Survivors (keys, ci, lat, lon, yaw and px, if there are thumbs) that differ from the last one kept; the last always stays.

    A fold over rows sorted by (keys, ci) inside partitions, from batch to batch: a task holds the last kept row and the last one, however
    long a video is. Without a px column, frames without a fix count as alike.
    """
    thumbs = "px" in survivors.columns
    number = [F.col(c).cast("double").alias(c) for c in ("lat", "lon", "yaw")]
    rows = survivors.select(*keys, "ci", *number, *([F.col("px").cast("array<int>").alias("px")] if thumbs else []))
    schema, m = rows.select(*keys, "ci").schema, len(keys)

    def fold(batches):
        key = kept = last = None
        for batch in batches:
            out = []
            columns = [batch.column(k).to_pylist() for k in range(batch.num_columns)]
            for row in zip(*columns, strict=True):
                if row[:m] != key:
                    if last is not None:
                        out.append((*key, last))
                    key, kept = row[:m], None
                place = (*row[m + 1 : m + 4], row[m + 4] if thumbs else None)
                last = row[m]
                if kept is None or differs(kept, place, move, yaw, diff):
                    out.append((*key, last))
                    kept, last = place, None
            yield pa.RecordBatch.from_pydict({f.name: [r[k] for r in out] for k, f in enumerate(schema)}, schema=pa.schema([(f.name, batch.schema.field(f.name).type) for f in schema]))
            kinds = batch.schema
        if last is not None:
            yield pa.RecordBatch.from_pydict({f.name: [v] for f, v in zip(schema, (*key, last), strict=True)}, schema=pa.schema([(f.name, kinds.field(f.name).type) for f in schema]))

    return rows.repartition(*keys).sortWithinPartitions(*keys, "ci").mapInArrow(fold, schema)


def decimate(kept: DataFrame, budget: Column, keys: tuple = ("video",), order: str = "ci") -> DataFrame:
    """Evenly spread rows within a budget for each key, first and last among them; null or 0 keeps none."""
    w = Window.partitionBy(*keys)
    rows = kept.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("pos", F.row_number().over(w.orderBy(order)) - 1).withColumn("b", budget.cast("long"))
    # position p is taken if it is the rounding of k * (n - 1) / (b - 1) for some k: the nearest k is one of two
    step = (F.col("n") - 1) / (F.col("b") - 1)
    k = F.round(F.col("pos") / step)
    hit = lambda j: j.between(0, F.col("b") - 1) & (F.round(j * (F.col("n") - 1) / (F.col("b") - 1)) == F.col("pos"))
    spread = hit(k) | hit(k - 1) | hit(k + 1)
    take = F.when(F.col("n") <= F.col("b"), True).when(F.col("b") <= 0, False).when(F.col("b") == 1, F.col("pos") == 0).otherwise(spread)
    return rows.where(F.coalesce(take, F.lit(False))).drop("n", "pos", "b")


def select_keyframes(candidates: DataFrame, budget: int, size: int = WINDOW) -> DataFrame:
    """Sharpest of each window, without redundant ones, within a budget for each video."""
    return decimate(prune_redundant(sharpest_per_window(candidates, size)), F.lit(budget))


def split_budget(counts: DataFrame, keys: tuple = ("session",), source: str = "video") -> DataFrame:
    """counts (keys, source, n, total) with share: the total split by n. Largest remainders, ties to the smaller source; at least two of each source where it has them; then trimmed from the largest, ties from the greater source.

    Windows over a key's sources, one shuffle. Quotas never exceed n unless the total exceeds all, and then all are taken, so one
    round gives out what rounding left. Trimming one after the other ends at one level, which the sorted shares give in closed form.
    """
    w = Window.partitionBy(*keys)
    zero = F.lit(0).cast("long")
    rows = counts.withColumn("all", F.sum("n").over(w)).withColumn("quota", F.coalesce(F.try_divide(F.col("total").cast("double") * F.col("n"), F.col("all")), F.lit(0.0)))
    rows = rows.withColumn("base", F.least(F.floor("quota"), F.col("n").cast("long"))).withColumn("room", (F.col("base") < F.col("n")).cast("long"))
    turns = w.orderBy(F.desc(F.col("quota") - F.floor("quota")), source).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("left", F.col("total") - F.sum("base").over(w)).withColumn("turn", F.sum("room").over(turns))
    given = F.col("base") + F.when((F.col("room") == 1) & (F.col("turn") <= F.col("left")), 1).otherwise(0)
    rows = rows.withColumn("v", F.greatest(given, F.least(F.lit(2), F.col("n"))).cast("long")).withColumn("over", F.greatest(F.sum("v").over(w) - F.col("total"), zero))
    # the k largest shares are those above the level: the fewest that can bear the surplus
    by_share = w.orderBy(F.desc("v"), source)
    rows = rows.withColumn("k", F.row_number().over(by_share)).withColumn("sum", F.sum("v").over(by_share.rowsBetween(Window.unboundedPreceding, 0))).withColumn("next", F.coalesce(F.lead("v").over(by_share), zero))
    bears = F.when(F.col("sum") - F.col("k") * F.col("next") >= F.col("over"), F.struct("k", "sum"))
    rows = rows.withColumn("cut", F.min(bears).over(w)).withColumn("rest", F.col("cut.sum") - F.col("over")).withColumn("top", F.col("k") <= F.col("cut.k"))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys, "top").orderBy(source)))
    level = F.floor(F.col("rest") / F.col("cut.k"))
    trimmed = F.when(F.col("top"), level + (F.col("place") <= F.col("rest") - level * F.col("cut.k")).cast("long")).otherwise(F.col("v"))
    return rows.withColumn("share", F.when((F.col("all") > 0) & (F.col("total") > 0), trimmed).otherwise(zero).cast("long")).select(*counts.columns, "share")


def burst_dedup(photos: DataFrame, keys: tuple = ("session",), gap_s: int = BURST_GAP_S) -> DataFrame:
    """The sharpest photo of each burst, ties to the earlier. A gap of gap_s or a missing time begins a burst."""
    w = Window.partitionBy(*keys).orderBy(F.coalesce("capture_time", F.lit("")), "path")
    t = timestamp_secs(F.col("capture_time"))
    rows = photos.withColumn("t", t).withColumn("rn", F.row_number().over(w))
    rows = rows.withColumn("new", F.coalesce(F.col("t") - F.lag("t").over(w) >= gap_s, F.lit(True)).cast("int"))
    rows = rows.withColumn("burst", F.sum("new").over(w))
    best = Window.partitionBy(*keys, "burst").orderBy(F.desc("sharpness"), "rn")
    return rows.withColumn("best", F.row_number().over(best)).where("best = 1").drop("t", "rn", "new", "burst", "best")


def pick_reference(selected: DataFrame, keys: tuple = ("session",)) -> DataFrame:
    """keys and pos of the reference: the highest of the middle half of a session's video frames, ties to the earlier; without altitudes the slice's centre; without videos the first frame.

    selected: keys, pos, kind, rel_alt.
    """
    w = Window.partitionBy(*keys)
    rows = selected.withColumn("is_video", (F.col("kind") == "video").cast("int")).withColumn("n", F.sum("is_video").over(w))
    rows = rows.withColumn("i", F.when(F.col("is_video") == 1, F.sum("is_video").over(w.orderBy("pos")) - 1).otherwise(F.row_number().over(w.orderBy("pos")) - 1))
    lo = F.floor(F.col("n") / 4)
    hi = F.greatest(F.floor(3 * F.col("n") / 4), lo + 1)
    rows = rows.where((F.col("n") == 0) & (F.col("i") == 0) | (F.col("is_video") == 1) & (F.col("i") >= lo) & (F.col("i") < hi))
    center = lo + F.floor((hi - lo) / 2)
    best = w.orderBy(F.desc_nulls_last("rel_alt"), F.when(F.col("rel_alt").isNull() & (F.col("i") == center), 0).otherwise(1), "i")
    return rows.withColumn("rn", F.row_number().over(best)).where("rn = 1").select(*keys, "pos")


def batch_order(selected: DataFrame, keys: tuple = ("session",)) -> DataFrame:
    """selected (keys, pos, is_reference) with batch_index: the reference first, the rest in order."""
    w = Window.partitionBy(*keys).orderBy(F.desc("is_reference"), "pos")
    return selected.withColumn("batch_index", F.row_number().over(w) - 1)


def log_tail(log: DataFrame, keys: tuple = ("session",), keep: int = 200) -> DataFrame:
    """The last lines (keys, seq, line) of each log once lines equal to the one before are gone."""
    w = Window.partitionBy(*keys).orderBy("seq")
    rows = log.withColumn("prev", F.lag("line").over(w)).where("prev is null or prev <> line").drop("prev")
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("seq")))).where(F.col("rn") <= keep).drop("rn")


def timeline_position(rows: DataFrame, keys: tuple = ("video",), order: str = "ci") -> DataFrame:
    """Each row's place from 0 to 100 along its key; a single row stands at 0."""
    w = Window.partitionBy(*keys)
    return rows.withColumn("position", F.coalesce(F.try_divide((F.row_number().over(w.orderBy(order)) - 1) * 100.0, F.count(F.lit(1)).over(w) - 1), F.lit(0.0)))
