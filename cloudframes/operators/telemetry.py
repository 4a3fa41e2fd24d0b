"""Telemetry of recordings: which text counts, and which entry belongs to a moment."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SLACK_MS = 500
FIELDS = ("lat", "lon", "rel_alt", "yaw")


def choose_source(videos: DataFrame, sidecar: DataFrame, embedded: DataFrame) -> DataFrame:
    """video, source and error: a sidecar (video, n_entries) beats an embedded track; one without entries is an error, an embedded one without entries is no telemetry."""
    rows = videos.select("video").join(sidecar.select("video", F.col("n_entries").alias("s")), "video", "left").join(embedded.select("video", F.col("n_entries").alias("e")), "video", "left")
    source = F.when(F.col("s") > 0, "sidecar").when(F.col("s").isNull() & (F.col("e") > 0), "embedded")
    return rows.select("video", source.alias("source"), F.when(F.col("s") == 0, "sidecar without entries").alias("error"))


def asof(probes: DataFrame, entries: DataFrame, key: str = "video", slack_ms: int = SLACK_MS, fields: tuple = FIELDS) -> DataFrame:
    """probes (key, probe, t_ms) with the entry (key, seq, start_ms, end_ms, fields) that holds at t.

    Only the last entry that starts at or before t and the next one count: the former if it lasts past t, else the nearer of its end
    and the other's start within the slack, ties to the former. One sort by (key, time) over both tables; no range join.
    """
    entry = F.struct("seq", "start_ms", "end_ms", *fields)
    e = entries.select(key, F.lit(None).cast("long").alias("probe"), F.col("start_ms").alias("t"), F.lit(0).alias("side"), F.col("seq").alias("tie"), entry.alias("entry"))
    p = probes.select(key, F.col("probe").cast("long").alias("probe"), F.col("t_ms").alias("t"), F.lit(1).alias("side"), F.col("probe").cast("long").alias("tie"), F.lit(None).cast(e.schema["entry"].dataType).alias("entry"))
    order = Window.partitionBy(key).orderBy("t", "side", "tie")
    rows = e.unionByName(p)
    rows = rows.withColumn("before", F.last("entry", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("after", F.first("entry", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))).where("side = 1")
    back, ahead = F.col("t") - F.col("before.end_ms"), F.col("after.start_ms") - F.col("t")
    near = lambda c: c.isNotNull() & (c <= slack_ms)
    chosen = F.when(F.col("before.end_ms") > F.col("t"), F.col("before")).when(near(back) & (ahead.isNull() | (back <= ahead)), F.col("before")).when(near(ahead), F.col("after"))
    return rows.withColumn("chosen", chosen).select(key, "probe", F.col("t").alias("t_ms"), F.col("chosen.seq").cast("long").alias("seq"), *[F.col(f"chosen.{f}").alias(f) for f in fields])


def frame_probes(frames: DataFrame, fps: str = "fps") -> DataFrame:
    """The middle of each frame in milliseconds, as probes."""
    return frames.withColumn("t_ms", F.floor((F.col("source_frame") + 0.5) / F.col(fps) * 1000).cast("long"))


def candidate_telemetry(candidates: DataFrame, entries: DataFrame, slack_ms: int = SLACK_MS) -> DataFrame:
    """Candidates (video, ci, t_ms) with position and yaw of the entry at their moment; null where there is none."""
    found = asof(candidates.select("video", F.col("ci").alias("probe"), "t_ms"), entries, slack_ms=slack_ms)
    return candidates.join(found.withColumnRenamed("probe", "ci").drop("t_ms"), ["video", "ci"], "left")
