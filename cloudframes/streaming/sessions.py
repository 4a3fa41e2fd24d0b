"""Streams of session messages and telemetry as Structured Streaming operators; each has a batch form that tests compare it with."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.pose import decode_pose, unproject
from ..operators.cloud import finite_filter
from ..operators.keyframes import WINDOW, differs

BINS, LOW, HIGH = 4096, 1e-3, 1e3
#: Frames of a chunk of depth, and lines that a status log keeps.
CHUNK_FRAMES, LOG_LINES = 8, 200


class _Waiting(StatefulProcessor):
    """Holds a frame's pixels until its camera comes, then lets them and all later ones through with the camera; the last camera counts."""

    PIXEL = "x long, y long, depth double, conf double"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.camera = handle.getValueState("camera", "width int, height int, enc array<double>")
        self.waiting = handle.getListState("waiting", self.PIXEL)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        camera = self.camera.get() if self.camera.exists() else None
        held: list[pd.DataFrame] = []
        for pdf in rows:
            cams, pixels = pdf[pdf["is_camera"]], pdf[~pdf["is_camera"]]
            if len(cams):
                last = cams.iloc[-1]
                camera = (int(last.width), int(last.height), [float(v) for v in last.enc])
            if len(pixels):
                held.append(pixels[["x", "y", "depth", "conf"]])
        number = lambda v: None if pd.isna(v) else float(v)
        if camera is None:
            for pdf in held:
                self.waiting.appendList([(int(p.x), int(p.y), number(p.depth), number(p.conf)) for p in pdf.itertuples()])
            return
        self.camera.update(camera)
        if self.waiting.exists():
            held.insert(0, pd.DataFrame([tuple(p) for p in self.waiting.get()], columns=["x", "y", "depth", "conf"]))
            self.waiting.clear()
        for pdf in held:
            yield pdf.assign(frame=key[0], width=camera[0], height=camera[1], enc=[camera[2]] * len(pdf))[["frame", "x", "y", "depth", "conf", "width", "height", "enc"]]

    def close(self) -> None:
        pass


def _with_camera(pixels: DataFrame, pose: DataFrame) -> DataFrame:
    """Pixels with width, height and enc of their frame's camera. Two streams meet in a state by frame, in whatever order they come."""
    pixels = pixels.select("frame", "x", "y", F.col("depth").cast("double").alias("depth"), F.col("conf").cast("double").alias("conf"))
    if not pose.isStreaming:
        return pixels.join(pose.select("frame", "width", "height", "enc"), "frame")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("width", "int"), ("height", "int"), ("enc", "array<double>"))]
    left = pixels.select("frame", F.lit(False).alias("is_camera"), "x", "y", "depth", "conf", *none)
    right = pose.select("frame", F.lit(True).alias("is_camera"), *[F.lit(None).cast(t).alias(c) for c, t in (("x", "long"), ("y", "long"), ("depth", "double"), ("conf", "double"))], F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), "enc")
    return left.unionByName(right).groupBy("frame").transformWithStateInPandas(_Waiting(), "frame long, x long, y long, depth double, conf double, width int, height int, enc array<double>", "append", "none")


def stream_cloud(chunks: DataFrame, pose: DataFrame) -> DataFrame:
    """Points of arriving depth pixels (frame, x, y, depth, conf) in append mode.

    pose (frame, width, height, enc) is a static table, or a stream: then pixels wait in a state until their frame's camera is there.
    """
    rows = _with_camera(finite_filter(chunks), pose)
    camera = decode_pose(F.col("enc"), F.col("width"), F.col("height"))
    rows = rows.select("frame", F.col("x").alias("px"), F.col("y").alias("py"), "x", "y", "depth", "conf", *[v.alias(k) for k, v in camera.items()])
    x, y, z = unproject(F.col("x"), F.col("y"), F.col("depth"))
    return rows.select("frame", "px", "py", x.alias("wx"), y.alias("wy"), z.alias("wz"), "conf")


def conf_bin(conf):
    """One of 4096 bins, evenly spaced in the logarithm."""
    t = (F.log(F.least(F.greatest(conf, F.lit(LOW)), F.lit(HIGH))) - F.log(F.lit(LOW))) / (F.log(F.lit(HIGH)) - F.log(F.lit(LOW)))
    return F.floor(t * (BINS - 1)).cast("int")


def stream_conf_hist(chunks: DataFrame) -> DataFrame:
    """Running counts of confidences by session and bin; update or complete mode."""
    return chunks.where("conf is not null and not isnan(conf)").groupBy("session", conf_bin(F.col("conf")).alias("bin")).count()


def hist_threshold(hist: DataFrame, q: float) -> DataFrame:
    """session, the bin that holds the quantile of a histogram (session, bin, count), and the number of values: the batch form."""
    w = Window.partitionBy("session")
    rows = hist.withColumn("n", F.sum("count").over(w)).withColumn("upto", F.sum("count").over(w.orderBy("bin")))
    return rows.where(F.col("upto") > F.floor((F.col("n") - 1) * q)).groupBy("session").agg(F.min("bin").alias("bin"), F.first("n").alias("n"))


class _Threshold(StatefulProcessor):
    """BINS counts of a session, and the bin of the quantile after each batch."""

    def __init__(self, q: float):
        self.q = q

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getValueState("counts", "counts array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        counts = np.array(self.counts.get()[0], np.int64) if self.counts.exists() else np.zeros(BINS, np.int64)
        for pdf in rows:
            np.add.at(counts, pdf["bin"].to_numpy(np.int64), pdf["count"].to_numpy(np.int64))
        self.counts.update((counts.tolist(),))
        upto = np.cumsum(counts)
        at = int(np.searchsorted(upto, int((int(upto[-1]) - 1) * self.q), side="right"))
        yield pd.DataFrame([(key[0], at, int(upto[-1]))], columns=["session", "bin", "n"])

    def close(self) -> None:
        pass


def stream_conf_threshold(chunks: DataFrame, q: float) -> DataFrame:
    """The confidence threshold of each session, refined with each batch: session, the bin of the quantile, and the values so far (n).

    Values of chunks (session, conf) are counted by bin inside tasks before they go to the session's state, which is BINS counts.
    """

    def count(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch]).group_by(["session", "bin"]).aggregate([([], "count_all")]).rename_columns(["session", "bin", "count"])
            yield from table.to_batches()

    binned = chunks.where("conf is not null and not isnan(conf)").select("session", conf_bin(F.col("conf")).alias("bin"))
    counted = binned.mapInArrow(count, "session string, bin int, count long")
    return counted.groupBy("session").transformWithStateInPandas(_Threshold(q), "session string, bin int, n long", "append", "none")


def last_uploads(uploads: DataFrame) -> DataFrame:
    """The last upload of each (session, frame_idx) in order of seq, and how many acknowledgements it had: the batch form."""
    w = Window.partitionBy("session", "frame_idx")
    return uploads.withColumn("acks", F.count(F.lit(1)).over(w)).withColumn("rn", F.row_number().over(w.orderBy(F.desc("seq")))).where("rn = 1").drop("rn")


class _Uploads(StatefulProcessor):
    """Keeps the last digest of each frame, and acknowledges every upload."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.frames = handle.getMapState("frames", "frame_idx long", "digest string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            out = []
            for r in pdf.sort_values("seq").itertuples():
                again = self.frames.containsKey((int(r.frame_idx),))
                self.frames.updateValue((int(r.frame_idx),), (r.digest,))
                out.append((key[0], int(r.seq), int(r.frame_idx), bool(again)))
            yield pd.DataFrame(out, columns=["session", "seq", "frame_idx", "replaced"])

    def close(self) -> None:
        pass


def stream_uploads(uploads: DataFrame) -> DataFrame:
    """An acknowledgement for each upload (session, seq, frame_idx, digest), told whether it replaced one."""
    return uploads.groupBy("session").transformWithStateInPandas(_Uploads(), "session string, seq long, frame_idx long, replaced boolean", "append", "none")


#: What may come after what in a session.
NEXT = {"": {"open"}, "open": {"frame"}, "frame": {"frame", "start"}, "start": {"progress"}, "progress": {"progress", "cameras"}, "cameras": {"chunk"}, "chunk": {"chunk", "done"}, "done": set(), "failed": set()}
#: States in which a session can be cancelled, and those in which the engine can fail.
LIVE = {"open", "frame", "start", "progress", "cameras", "chunk"}
COMPUTING = {"start", "progress", "cameras", "chunk"}


def advance(state: str, last_chunk: int, tag: str, frame: int) -> tuple[str, int, str | None]:
    """(state, last chunk, error code) after a message. A cancel of a session that isn't live is stale and changes nothing."""
    if tag == "cancel":
        return ("failed", last_chunk, "cancelled") if state in LIVE else (state, last_chunk, None)
    if tag == "error" and state in COMPUTING:
        return "failed", last_chunk, "internal"
    if tag not in NEXT[state]:
        return "failed", last_chunk, "protocol"
    if tag == "chunk" and frame <= last_chunk:
        return "failed", last_chunk, "validation"
    return tag, frame if tag == "chunk" else last_chunk, None


#: States that wait for something more.
ENDED = {"done", "failed"}


class _Session(StatefulProcessor):
    """The session's state, its last chunk, and when the last message came. With a limit, a timer ends a session that has gone silent."""

    def __init__(self, limit_ms: int | None = None):
        self.limit = limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "state string, chunk long, seq long, ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state, chunk, seq, ms = self.at.get() if self.at.exists() else ("", -1, 0, None)
        before, out = ms, []
        passed = timerValues.getCurrentWatermarkInMs() if self.limit is not None else None
        for pdf in rows:
            for r in pdf.sort_values("seq").itertuples():
                now = int(r.ms)
                if passed is not None and now < passed:
                    continue
                if self.limit is not None and ms is not None and state not in ENDED and now - ms > self.limit:
                    state = "failed"  # it was silent for too long before this message
                    out.append((key[0], seq, state, "stalled"))
                if state != "failed":
                    state, chunk, error = advance(state, chunk, r.tag, int(r.frame))
                    out.append((key[0], int(r.seq), state, error))
                seq, ms = int(r.seq), now
        if self.limit is not None and ms != before:
            if before is not None:
                self.handle.deleteTimer(before + self.limit)
            if state not in ENDED:
                self.handle.registerTimer(ms + self.limit)
        if ms is not None:
            self.at.update((state, chunk, seq, ms))
        yield pd.DataFrame(out, columns=["session", "seq", "state", "error"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state, chunk, seq, ms = self.at.get()
        out = []
        if state not in ENDED:
            self.at.update(("failed", chunk, seq, ms))
            out.append((key[0], seq, "failed", "stalled"))
        yield pd.DataFrame(out, columns=["session", "seq", "state", "error"])

    def close(self) -> None:
        pass


_STATES = "session string, seq long, state string, error string"


def stream_session_fsm(messages: DataFrame, silent: str | None = None, delay: str = "10 seconds") -> DataFrame:
    """State and error code after each message (session, seq, tag, frame) until a session fails.

    With `silent`, an interval such as `30 seconds`, messages also have an event time ts: a session that is neither done nor failed and
    has no message for longer fails as `stalled`, with the seq of its last message, once the watermark has passed; messages later than
    the delay are dropped.
    """
    if silent is None:
        return messages.select("session", "seq", "tag", "frame", F.lit(0).cast("long").alias("ms")).groupBy("session").transformWithStateInPandas(_Session(), _STATES, "append", "none")
    limit = int(pd.Timedelta(silent).total_seconds() * 1000)
    timed = messages.select("session", "seq", "tag", "frame", "ts", F.unix_millis("ts").alias("ms")).withWatermark("ts", delay)
    return timed.groupBy("session").transformWithStateInPandas(_Session(limit), _STATES, "append", "eventTime")


def stream_progress(messages: DataFrame) -> DataFrame:
    """The latest (done, total) of each session and stage; update or complete mode."""
    return messages.groupBy("session", "stage").agg(F.max(F.struct("seq", "done", "total")).alias("m")).select("session", "stage", "m.done", "m.total")


def timeline_check(messages: DataFrame) -> DataFrame:
    """Whether each session's cameras come before its chunks, progress before the cameras, chunks rise, there is one for each CHUNK_FRAMES
    of its different frames (the last may have less), and done is last."""
    w = Window.partitionBy("session", "tag").orderBy("seq")
    rows = messages.withColumn("rises", F.when(F.col("tag") == "chunk", F.coalesce(F.col("frame") > F.lag("frame").over(w), F.lit(True))))
    at = lambda f, tag: f(F.when(F.col("tag") == tag, F.col("seq")))
    out = rows.groupBy("session").agg(at(F.min, "cameras").alias("cam"), at(F.min, "chunk").alias("first_chunk"), at(F.min, "progress").alias("first_progress"), at(F.max, "done").alias("done"), F.max("seq").alias("last"), F.bool_and("rises").alias("chunks_rise"), F.count_if(F.col("tag") == "chunk").alias("chunks"), F.count_distinct(F.when(F.col("tag") == "frame", F.col("frame_idx"))).alias("frames"))
    complete = F.col("chunks") == F.ceil(F.col("frames") / CHUNK_FRAMES)
    return out.select("session", (F.col("cam") < F.col("first_chunk")).alias("cameras_first"), (F.col("first_progress") < F.col("cam")).alias("progress_first"), "chunks_rise", complete.alias("chunks_complete"), (F.col("done") == F.col("last")).alias("done_last"))


def stage_timings(messages: DataFrame) -> DataFrame:
    """Milliseconds of each stage of a session, and its peak memory."""
    return messages.groupBy("session", "stage").agg((F.max("t_ms") - F.min("t_ms")).alias("ms"), F.max("n_bytes").alias("peak_bytes"))


def stream_peak(samples: DataFrame) -> DataFrame:
    """The highest memory sample of each session; update or complete mode."""
    return samples.groupBy("session").agg(F.max("n_bytes").alias("peak_bytes"))


def stream_telemetry_asof(frames: DataFrame, entries: DataFrame, slack_ms: int = 500, longest_ms: int = 10_000, delay: str = "5 seconds") -> DataFrame:
    """video, probe and seq: for each frame (video, probe, ts) its nearest entry (video, seq, start_ts, end_ts) within the slack, or null.

    An outer join of two streams by intervals, then the best entry of each probe, both in append mode: a probe comes out once, when the
    watermarks (delay behind the latest frame and the latest entry) are past all entries that could still hold it, and its state goes.
    Entries last at most longest_ms. Rows later than the delay are dropped. An entry that holds is preferred, the last to start of these;
    else the nearest, ties to the earlier, as in the batch form.
    """
    us = lambda c: F.unix_micros(c)
    f = frames.select("video", "probe", "ts").withWatermark("ts", delay)
    e = entries.select(F.col("video").alias("of"), "seq", "start_ts", us("start_ts").alias("start"), us("end_ts").alias("end")).withWatermark("start_ts", delay)
    slack = F.expr(f"interval {slack_ms} milliseconds")
    near = (F.col("video") == F.col("of")) & (F.col("ts") >= F.col("start_ts") - slack) & (F.col("ts") <= F.col("start_ts") + F.expr(f"interval {longest_ms + slack_ms} milliseconds")) & (us("ts") <= F.col("end") + slack_ms * 1000)
    at = us("ts")
    holds = (F.col("start") <= at) & (at < F.col("end"))
    gap = F.when(holds, 0).when(F.col("start") > at, F.col("start") - at).otherwise(at - F.col("end"))
    best = F.struct(gap.alias("gap"), F.when(holds, -F.col("start")).otherwise(F.col("start")).alias("tie"), "seq")
    pairs = f.join(e, near, "leftOuter").select("video", "probe", "ts", F.when(F.col("seq").isNotNull(), best).alias("best"))
    return pairs.groupBy("ts", "video", "probe").agg(F.min("best").alias("best")).select("video", "probe", "best.seq")


class _Keyframes(StatefulProcessor):
    """Sharpest of each window, emitted when it differs from the last one emitted; at a video's end the last of all in any case."""

    FRAME = "ci long, sharpness double, lat double, lon double, yaw double, px array<int>"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getValueState("best", "win long, " + self.FRAME)
        self.kept = handle.getValueState("kept", self.FRAME)
        self.missed = handle.getValueState("missed", "ci long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        get = lambda state: tuple(state.get()) if state.exists() else None
        best, kept, missed = get(self.best), get(self.kept), get(self.missed)
        out = []

        def close():
            nonlocal best, kept, missed
            if best is not None:
                missed = (best[1],)
                if kept is None or differs(kept[2:], best[3:]):
                    out.append((key[0], best[1]))
                    kept, missed = best[1:], None
                best = None

        for pdf in rows:
            for r in pdf.sort_values("ci").itertuples():
                win = int(r.ci) // WINDOW
                if best is not None and best[0] != win:
                    close()
                if best is None or r.sharpness > best[2]:
                    number = lambda x: None if pd.isna(x) else float(x)
                    best = (win, int(r.ci), float(r.sharpness), number(r.lat), number(r.lon), number(r.yaw), None if r.px is None else [int(x) for x in r.px])
                if r.last:
                    close()
                    if missed is not None:
                        out.append((key[0], missed[0]))
                    kept = missed = None
        for state, value in ((self.best, best), (self.kept, kept), (self.missed, missed)):
            if value is None:
                state.clear()
            else:
                state.update(value)
        yield pd.DataFrame(out, columns=["video", "ci"])

    def close(self) -> None:
        pass


def stream_keyframes(candidates: DataFrame) -> DataFrame:
    """video and ci of keyframes among candidates (video, ci, sharpness, lat, lon, yaw, px, last) as they arrive, each video in order of ci.

    `last` marks the end of a video, which keeps its last survivor; fixes, headings and thumbnails may be null.
    """
    return candidates.groupBy("video").transformWithStateInPandas(_Keyframes(), "video long, ci long", "append", "none")


def stream_bursts(photos: DataFrame, delay: str = "10 seconds", gap: str = "1999999 microseconds") -> DataFrame:
    """The sharpest photo of each burst of photos (session, ts, path, sharpness); a gap of two seconds begins a burst.

    In append mode a burst comes out when the watermark has passed its end, and its state goes; photos later than the delay are dropped.
    """
    best = F.max(F.struct("sharpness", (-F.unix_micros("ts")).alias("early"), "path"))["path"]
    return photos.withWatermark("ts", delay).groupBy("session", F.session_window("ts", gap).alias("w")).agg(best.alias("path"), F.count(F.lit(1)).alias("n"), F.max("sharpness").alias("sharpness")).drop("w")


class _Log(StatefulProcessor):
    """The last line, and the numbers of the lines that the log holds."""

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "line string")
        self.held = handle.getListState("held", "seq long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        held = [x[0] for x in self.held.get()] if self.held.exists() else []
        out = []
        for pdf in rows:
            for r in pdf.sort_values("seq").itertuples():
                if r.line != last:
                    held.append(int(r.seq))
                    out.append((key[0], int(r.seq), r.line, held.pop(0) if len(held) > self.keep else None))
                last = r.line
        if last is not None:
            self.last.update((last,))
        if held:
            self.held.put([(x,) for x in held])
        yield pd.DataFrame(out, columns=["session", "seq", "line", "gone"]).astype({"gone": "Int64"})

    def close(self) -> None:
        pass


def stream_log_dedup(log: DataFrame, keep: int = LOG_LINES) -> DataFrame:
    """Lines (session, seq, line) that differ from the one before; `gone` is the seq of the line that leaves the log for one, for it holds
    `keep` lines. `log_lines` are those that it holds in the end."""
    return log.groupBy("session").transformWithStateInPandas(_Log(keep), "session string, seq long, line string, gone long", "append", "none")


def log_lines(changes: DataFrame) -> DataFrame:
    """session, seq and line of what the logs hold after all changes (session, seq, line, gone)."""
    gone = changes.where("gone is not null").select("session", F.col("gone").alias("seq"))
    return changes.select("session", "seq", "line").join(gone, ["session", "seq"], "left_anti")


def run_available(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """All that is there now of a stream, through a Parquet table beside the checkpoint; no row passes the driver.

    In complete mode each batch replaces the table.
    """
    spark, path = stream.sparkSession, f"{checkpoint}-rows"
    out = stream.writeStream.queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        out = out.format("parquet").option("path", path)
    else:
        spark.createDataFrame([], stream.schema).write.parquet(path)
        out = out.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(path))
    out.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
