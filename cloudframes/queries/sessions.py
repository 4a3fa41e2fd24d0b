"""Session queries: plans, manifests, messages and streams over the given tables."""

import uuid

from pyspark.sql import functions as F

from ..fixtures import duck, view
from ..operators import cloud, keyframes
from ..plans import selection as plan
from ..sources import readers, sinks
from ..streaming import sessions as st
from . import query
from .capture import ASOF, DECIMATE, FOLD, SHARP
from .clouds import BUILD, RAW, WORLD
from .scalars import DUCK_CAMS, TH, TW

_msg = lambda s, d: view(s, d, "messages")

# --- plans
query("plan_validate", duck("candidates") + ", v_s AS (SELECT video AS session, ci FROM v_candidates WHERE sharpness > 90), v_b AS (SELECT DISTINCT video AS session FROM v_candidates), v_n AS (SELECT session, count(v_s.ci) AS n, count(*) FILTER (ci % 5 = 0) AS refs FROM v_b LEFT JOIN v_s USING (session) GROUP BY session) SELECT session, n AS n_selected, array_to_string(list_filter([CASE WHEN n = 0 THEN 'nothing selected' END, CASE WHEN n > 0 AND refs = 0 THEN 'reference not selected' END], lambda x: x IS NOT NULL), ',') AS errors, array_to_string(list_filter([CASE WHEN n > 0 AND n < 2 THEN 'fewer than 2 frames' END, CASE WHEN n > 8 THEN 'over budget' END], lambda x: x IS NOT NULL), ',') AS warnings FROM v_n")(
    lambda s, d: plan.validate(view(s, d, "candidates").where("sharpness > 90").selectExpr("video as session", "ci % 5 = 0 as is_reference"), view(s, d, "candidates").selectExpr("video as session", "8 as budget").distinct()).select("session", F.col("n_selected").cast("long").alias("n_selected"), F.array_join("errors", ",").alias("errors"), F.array_join("warnings", ",").alias("warnings"))
)


@query("session_validate", duck("messages") + """, v_s AS (SELECT DISTINCT session, CASE WHEN session % 5 = 0 THEN 630 ELSE 624 END AS w, 416 AS h, 6 AS n FROM v_messages), v_p AS (SELECT session, count(*) FILTER (NOT frame_idx BETWEEN 0 AND n - 1) AS r, count(*) FILTER (seq % 9 = 0) AS z, count(DISTINCT CASE WHEN frame_idx BETWEEN 0 AND n - 1 THEN frame_idx END) AS t FROM v_messages JOIN v_s USING (session) WHERE tag = 'frame' GROUP BY session)
SELECT session, array_to_string(list_filter([CASE WHEN session % 5 = 0 THEN 'dimensions' END, CASE WHEN coalesce(r, 0) > 0 THEN 'frame index' END, CASE WHEN coalesce(z, 0) > 0 THEN 'frame size' END, CASE WHEN coalesce(t, 0) < n THEN 'missing frames' END], lambda x: x IS NOT NULL), ',') AS errors, greatest(n - coalesce(t, 0), 0)::BIGINT AS n_missing FROM v_s LEFT JOIN v_p USING (session)""")
def session_validate(s, d):
    m = _msg(s, d)
    sessions = m.select("session").distinct().withColumns({"width": F.when(F.col("session") % 5 == 0, 630).otherwise(624), "height": F.lit(416), "n_frames": F.lit(6)})
    good = F.when(F.col("session") % 5 == 0, 630).otherwise(624) * 416 * 3
    frames = m.where("tag = 'frame'").select("session", "frame_idx", F.when(F.col("seq") % 9 == 0, 1).otherwise(good).alias("n_bytes"))
    out = plan.session_checks(sessions, frames)
    return out.select("session", F.array_join("errors", ",").alias("errors"), F.col("n_missing").cast("long").alias("n_missing"))


@query("footage_warnings", """WITH v_v AS (SELECT s_nationkey AS session, s_suppkey AS video FROM supplier) SELECT session, video::VARCHAR AS source, 'hdr transfer' AS code FROM v_v WHERE video % 4 = 0 UNION ALL SELECT session, video::VARCHAR, 'log without tonemap' FROM v_v WHERE video % 3 = 0 AND video % 2 = 0
UNION ALL SELECT DISTINCT session, NULL, 'photos fill the budget' FROM v_v WHERE session % 10 >= 5 UNION ALL SELECT session, video::VARCHAR, 'crop loss' FROM v_v WHERE video % 7 > 1 AND video % 2 = 1""")
def footage_warnings(s, d):
    v = s.read.parquet(f"{d}/supplier.parquet").selectExpr("s_nationkey as session", "s_suppkey as video")
    videos = v.selectExpr("session", "video", "case when video % 4 = 0 then 'smpte2084' else 'bt709' end as color_transfer", "case when video % 3 = 0 then 'd_log' end as color_md", "case when video % 2 = 0 then 'none' else 'parametric' end as tonemap")
    return plan.footage_warnings(videos, v.selectExpr("session", "5 as budget", "session % 10 as n_photos").distinct(), v.selectExpr("session", "cast(video as string) as source", "(video % 7) / 100.0 as loss", "case when video % 2 = 1 then 1.0 else 0.9 end as crop_scale"))


SELECTED = ", v_sel AS (SELECT session, video::VARCHAR AS source, ci FROM v_candidates WHERE sharpness > 60)"
query("selection_stats", duck("candidates") + SELECTED + """, v_c AS (SELECT session, video::VARCHAR AS source, count(*) AS n, max(ci * 15 / 30.0e0) AS l FROM v_candidates GROUP BY ALL), v_k AS (SELECT session, source, count(*) AS k FROM v_sel GROUP BY ALL)
SELECT session, source, n AS n_candidates, round(n / nullif(l, 0), 6) AS per_s, coalesce(k, 0) AS n_selected, sum(coalesce(k, 0)) OVER w::BIGINT AS used, greatest(600 - sum(coalesce(k, 0)) OVER w, 0)::BIGINT AS remaining, round(least(sum(coalesce(k, 0)) OVER w / 600.0e0, 1.0), 6) AS fraction FROM v_c LEFT JOIN v_k USING (session, source) WINDOW w AS (PARTITION BY session)""")(
    lambda s, d: plan.selection_stats(view(s, d, "candidates").selectExpr("session", "cast(video as string) source", "ci * 15 / 30 as time_s"), view(s, d, "candidates").where("sharpness > 60").selectExpr("session", "cast(video as string) source"), 600).withColumns({"per_s": F.round("per_s", 6), "fraction": F.round("fraction", 6)})
)


@query("dominant_source", duck("candidates") + " SELECT session, source, 1000 + source::BIGINT AS width, 700 AS height FROM (SELECT session, video::VARCHAR AS source, row_number() OVER (PARTITION BY session ORDER BY count(*) DESC, video::VARCHAR) AS rn FROM v_candidates WHERE sharpness > 60 GROUP BY session, video) WHERE rn = 1")
def dominant_source(s, d):
    c = view(s, d, "candidates").where("sharpness > 60").selectExpr("session", "'video' as kind", "cast(video as string) as source", "video")
    return plan.dominant_source(c, c.select("session", "kind", "source", (F.col("video") + 1000).alias("width"), F.lit(700).cast("long").alias("height")).distinct())


query("top_source", duck("candidates") + " SELECT video FROM v_candidates GROUP BY video ORDER BY count(*) DESC, video LIMIT 1")(lambda s, d: view(s, d, "candidates").groupBy("video").count().orderBy(F.desc("count"), "video").limit(1).select("video"))


@query("aspect_options", duck("photos") + f""", v_a AS (SELECT session, path, CASE WHEN event_id % 2 = 0 THEN 'video' ELSE 'photo' END AS kind, width, height, {TW} AS tw, {TH} AS th FROM v_photos),
v_f AS (SELECT session, kind AS other, width AS w, height AS h FROM (SELECT *, row_number() OVER (PARTITION BY session, kind ORDER BY path) AS rn FROM v_a) WHERE rn = 1)
SELECT session, path AS source, tw::BIGINT AS tw, th::BIGINT AS th, round(1.0e0 - least(greatest(round(cw), 16), cw) * least(greatest(round(least(greatest(round(cw), 16), cw) * ch / cw::DOUBLE), 1), ch) / (w * h)::DOUBLE, 6) AS loss
FROM (SELECT *, CASE WHEN h / w::DOUBLE > th / tw::DOUBLE THEN w ELSE round(h / (th / tw::DOUBLE)) END AS cw, CASE WHEN h / w::DOUBLE > th / tw::DOUBLE THEN round(w * (th / tw::DOUBLE)) ELSE h END AS ch FROM v_a JOIN v_f USING (session) WHERE kind <> other)""")
def aspect_options(s, d):
    rows = view(s, d, "photos").selectExpr("session", "path as source", "case when event_id % 2 = 0 then 'video' else 'photo' end as kind", "width", "height")
    return plan.aspect_options(rows).withColumn("loss", F.round("loss", 6))


def _edits(s, d):
    """All view, click, purchase and signup events as edits of frames of their own video; a signup selects anew."""
    n = view(s, d, "candidates").groupBy("video").agg(F.count(F.lit(1)).alias("n"))
    events = view(s, d, "events_k").where("event_type in ('view', 'click', 'purchase', 'signup')").withColumnRenamed("user_id", "video")
    return events.join(n, "video").selectExpr("video as session", "event_id as seq", "case event_type when 'view' then 'include' when 'click' then 'exclude' when 'purchase' then 'crop' else 'reselect' end as op", "cast(k % n as int) as ci", "value / 50 as value")


PICK = "(SELECT CASE WHEN len(h) > 0 THEN h[1].ci ELSE m[len(m) // 2 + 1].ci END FROM (SELECT m, list_sort(list_transform(list_filter(m, lambda x: x.alt IS NOT NULL), lambda x: {{'a': -x.alt, 'ci': x.ci}})) AS h FROM (SELECT {0}[len({0}) // 4 + 1:greatest(3 * len({0}) // 4, len({0}) // 4 + 1)] AS m)))"
EDITS = """, v_auto AS (SELECT video, list(struct_pack(ci := ci, scale := 1.0::DOUBLE, alt := rel_alt) ORDER BY ci) AS sel FROM v_take JOIN v_candidates USING (video, ci) GROUP BY video),
v_log AS (SELECT e.user_id AS video, event_type, value, e.k % n AS ci, c.rel_alt AS alt, row_number() OVER (PARTITION BY e.user_id ORDER BY e.event_id) AS i
  FROM v_events_k e JOIN (SELECT video, count(*) AS n FROM v_candidates GROUP BY video) t ON t.video = e.user_id JOIN v_candidates c ON c.video = e.user_id AND c.ci = e.k % n WHERE event_type IN ('view', 'click', 'purchase', 'signup')),
v_edit AS (SELECT video, 0::BIGINT AS i, sel, """ + PICK.format("sel") + """ AS ref FROM v_auto
  UNION ALL SELECT video, i, CASE WHEN event_type = 'signup' THEN auto WHEN event_type = 'view' AND NOT has THEN added WHEN event_type = 'click' AND has THEN rest WHEN event_type = 'purchase' THEN scaled ELSE sel END,
    CASE WHEN event_type = 'signup' THEN """ + PICK.format("auto") + """ WHEN event_type = 'click' AND has AND ref = ci AND len(rest) > 0 THEN """ + PICK.format("rest") + """ ELSE ref END
  FROM (SELECT s.video, l.i, l.event_type, l.ci, s.sel, s.ref, a.sel AS auto, list_contains(list_transform(s.sel, lambda x: x.ci), l.ci) AS has, list_sort(list_append(s.sel, struct_pack(ci := l.ci::INT, scale := 1.0::DOUBLE, alt := l.alt))) AS added,
      list_filter(s.sel, lambda x: x.ci <> l.ci) AS rest, list_transform(s.sel, lambda x: struct_pack(ci := x.ci, scale := CASE WHEN x.ci = l.ci THEN least(greatest(l.value / 50, 0.3), 1.0) ELSE x.scale END, alt := x.alt)) AS scaled
    FROM v_edit s JOIN v_log l ON l.video = s.video AND l.i = s.i + 1 JOIN v_auto a ON a.video = s.video)),
v_end AS (SELECT video, arg_max(sel, i) AS sel, arg_max(ref, i) AS ref FROM v_edit GROUP BY video)
SELECT video AS session, u.ci, round(u.scale, 6) AS crop_scale, u.ci = ref AS is_reference FROM (SELECT video, ref, unnest(sel) AS u FROM v_end)"""


@query("apply_edits", duck("candidates", "events_k") + SHARP + FOLD + DECIMATE + EDITS)
def apply_edits(s, d):
    """A fold with a path-dependent reference over all videos, each a session with its keyframes."""
    c = view(s, d, "candidates")
    rows = keyframes.select_keyframes(c, 6).select("video", "ci").join(c.select("video", "ci", "rel_alt"), ["video", "ci"]).selectExpr("video as session", "ci as pos", "'video' as kind", "rel_alt")
    auto = rows.join(keyframes.pick_reference(rows).withColumn("is_reference", F.lit(True)), ["session", "pos"], "left")
    auto = auto.select("session", F.col("pos").alias("ci"), F.coalesce("is_reference", F.lit(False)).alias("is_reference"))
    return plan.apply_edits(auto, _edits(s, d), c.selectExpr("video as session", "ci", "rel_alt")).withColumn("crop_scale", F.round("crop_scale", 6))


#: Sessions of five videos with all of their candidates; the sixth frame is the reference.
UNITS = ", v_m AS (SELECT video // 5 AS session, video, ci, sharpness, row_number() OVER (PARTITION BY video // 5 ORDER BY video, ci) - 1 AS pos FROM v_candidates)"
FRAMES = duck("candidates") + UNITS + " SELECT session, row_number() OVER (PARTITION BY session ORDER BY (pos = 5) DESC, pos) - 1 AS batch_index, video::VARCHAR AS source, ci * 15 AS source_frame, round(sharpness, 6) AS sharpness FROM v_m"


def _manifest(s, d):
    c = view(s, d, "candidates").selectExpr("video div 5 as session", "video", "ci", "sharpness", "row_number() over (partition by video div 5 order by video, ci) - 1 as pos")
    c = c.selectExpr("session", "pos", "'video' as kind", "cast(video as string) as source", "ci", "ci * 15 as source_frame", "pos = 5 as is_reference", "sharpness")
    details = c.selectExpr("session", "kind", "source", "ci", "ci * 15 / 30 as time_s", "sharpness", "cast(960 as bigint) as width", "cast(540 as bigint) as height")
    return plan.build_manifest(c.drop("sharpness"), details, 624, 416, 30)


def _frames_of(manifests):
    rows = manifests.select(F.col("session").cast("long").alias("session"), F.explode("frames").alias("f"))
    return rows.select("session", F.col("f.batch_index").cast("long").alias("batch_index"), "f.source", "f.source_frame", F.round("f.sharpness", 6).alias("sharpness"))


@query("build_manifest", duck("candidates") + UNITS + " SELECT session, 1 AS version, 30 AS budget, max(CASE WHEN pos = 5 THEN 5 END) AS reference_original_pos, count(*) AS n_frames, arg_max(ci * 15, CASE WHEN pos = 5 THEN 2 WHEN pos = 0 THEN 1 ELSE 0 END) AS first_frame, round(sum(sharpness), 4) AS sharpness, 75 AS crop_x FROM v_m GROUP BY session")
def build_manifest(s, d):
    f = F.col("frames")
    total = F.aggregate(F.transform(f, lambda x: x["sharpness"]), F.lit(0.0), lambda a, b: a + b)
    return _manifest(s, d).select("session", "version", "budget", "reference_original_pos", F.size(f).cast("long").alias("n_frames"), F.get(f, F.lit(0))["source_frame"].alias("first_frame"), F.round(total, 4).alias("sharpness"), F.get(F.get(f, F.lit(0))["crop"], F.lit(0)).alias("crop_x"))


query("manifest_source", FRAMES)(lambda s, d: _frames_of(_manifest(s, d)))

# --- messages, in batch
query("upload_lastwins", duck("messages") + " SELECT session, frame_idx, max(seq) AS seq, count(*) AS acks FROM v_messages WHERE tag = 'frame' GROUP BY ALL")(lambda s, d: st.last_uploads(_msg(s, d).where("tag = 'frame'").select("session", "frame_idx", "seq")).select("session", "frame_idx", "seq", "acks"))
query("progress", duck("messages") + " SELECT session, stage, arg_max(done, seq) AS done, arg_max(total, seq) AS total FROM v_messages WHERE tag = 'progress' GROUP BY ALL")(lambda s, d: st.stream_progress(_msg(s, d).where("tag = 'progress'")))
query("peak_memory", duck("messages") + " SELECT session, max(n_bytes) AS peak_bytes FROM v_messages GROUP BY session")(lambda s, d: st.stream_peak(_msg(s, d)))
query("stage_timings", duck("messages") + " SELECT session, stage, max(t_ms) - min(t_ms) AS ms, max(n_bytes) AS peak_bytes FROM v_messages GROUP BY ALL")(lambda s, d: st.stage_timings(_msg(s, d)))
query("stream_timeline_check", duck("messages") + """, v_r AS (SELECT *, CASE WHEN tag = 'chunk' THEN coalesce(frame > lag(frame) OVER (PARTITION BY session, tag ORDER BY seq), true) END AS rises FROM v_messages)
SELECT session, count(*) FILTER (tag = 'chunk') = ceil(count(DISTINCT frame_idx) FILTER (tag = 'frame') / 8.0e0) AS chunks_complete, min(seq) FILTER (tag = 'cameras') < min(seq) FILTER (tag = 'chunk') AS cameras_first, min(seq) FILTER (tag = 'progress') < min(seq) FILTER (tag = 'cameras') AS progress_first, bool_and(rises) AS chunks_rise, max(seq) FILTER (tag = 'done') = max(seq) AS done_last FROM v_r GROUP BY session""")(lambda s, d: st.timeline_check(_msg(s, d)))


# --- streams: what is there of the given tables, read as a stream
def stream_of(s, d, name: str, late: str, df=None):
    """A view's rows as a stream of two batches or more; those of the condition `late` come after the others.

    The view is written to a scratch folder, for it orders rows, which a stream can't, and read from there in order of the files' age.
    """
    folder = f"{_scratch(s)}/{name}-{uuid.uuid4().hex}"
    df = view(s, d, name) if df is None else df
    df.where(f"not ({late})").write.parquet(folder)
    files = len(s.read.parquet(folder).inputFiles())
    df.where(late).write.mode("append").parquet(folder)
    return s.readStream.schema(df.schema).option("maxFilesPerTrigger", max(1, files)).parquet(folder)


def stream_in_time(s, df, ts: str, name: str, end=None, batches: int = 3):
    """Rows as a stream of batches in order of the timestamp ts, so that none is late; a last batch has the rows `end`, which say that time goes on.

    The driver gets two bounds of time. Each batch is written as FILES files, so that all streams of a query advance alike.
    """
    folder = f"{_scratch(s)}/{name}-{uuid.uuid4().hex}"
    us = F.unix_micros(ts)
    bounds = df.agg(F.percentile_approx(us, [(k + 1) / batches for k in range(batches - 1)], 10_000)).first()[0] or []
    edges = [None, *bounds, None]
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        part = df if low is None else df.where(us > low)
        part = part if high is None else part.where(us <= high)
        part.repartition(FILES).write.mode("append").parquet(folder)
    if end is not None:
        end.select(df.columns).coalesce(1).write.mode("append").parquet(folder)
    return s.readStream.schema(df.schema).option("maxFilesPerTrigger", FILES).parquet(folder)


#: Files of a batch of a stream in time.
FILES = 4


def _scratch(s) -> str:
    """The folder that driver and executors share; only a local master may do without the setting."""
    import tempfile

    path = s.conf.get("spark.checkpoint.dir", None)
    if not path and not s.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (path or f"file://{tempfile.mkdtemp(prefix='cloudframes-')}").rstrip("/")


def run(s, stream, mode: str = "append"):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = s.conf.get(key, None)
    s.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        name = f"out_{uuid.uuid4().hex}"
        return st.run_available(stream, name, f"{_scratch(s)}/{name}", mode)
    finally:
        s.conf.unset(key) if before is None else s.conf.set(key, before)


_messages = lambda s, d: stream_of(s, d, "messages", "seq > 10")
_text_session = lambda df: df.withColumn("session", F.col("session").cast("string"))
_long_session = lambda df: df.withColumn("session", F.col("session").cast("long"))
query("stream_peak", duck("messages") + " SELECT session, max(n_bytes) AS peak_bytes FROM v_messages GROUP BY session")(lambda s, d: run(s, st.stream_peak(_messages(s, d)), "complete"))
query("stream_progress", duck("messages") + " SELECT session, stage, arg_max(done, seq) AS done, arg_max(total, seq) AS total FROM v_messages WHERE tag = 'progress' GROUP BY ALL")(lambda s, d: run(s, st.stream_progress(_messages(s, d).where("tag = 'progress'")), "complete"))
query("stream_upload_lastwins", duck("messages") + " SELECT session, seq, frame_idx, row_number() OVER (PARTITION BY session, frame_idx ORDER BY seq) > 1 AS replaced FROM v_messages WHERE tag = 'frame'")(lambda s, d: _long_session(run(s, st.stream_uploads(_text_session(_messages(s, d).where("tag = 'frame'").select("session", "seq", "frame_idx", F.md5(F.col("n_bytes").cast("string")).alias("digest")))))))
#: A session's messages: it begins as it should, then chunks come, some of them late, ends, cancels and failures.
TAG = """CASE WHEN seq = 1 THEN 'open' WHEN seq < 4 THEN 'frame' WHEN seq = 4 THEN 'start' WHEN seq < 7 THEN 'progress' WHEN seq = 7 THEN 'cameras'
    WHEN tag = 'done' AND seq > 8 THEN 'done' WHEN tag = 'cameras' AND frame % 3 = 0 THEN 'cancel' WHEN tag = 'purchase' AND frame % 5 = 0 THEN 'error' WHEN frame % 13 = 0 THEN 'frame' ELSE 'chunk' END"""
CHUNK = "CASE WHEN frame % 11 = 0 THEN 3 ELSE seq END"
FSM = f""", v_t AS (SELECT session, seq, {TAG} AS tag, {CHUNK} AS frame FROM v_messages), v_s AS (SELECT session, 0::BIGINT AS seq, '' AS state, -1::BIGINT AS chunk, NULL::VARCHAR AS error FROM (SELECT DISTINCT session FROM v_messages)
  UNION ALL SELECT session, seq, s.e[1], CASE WHEN s.e[1] = 'chunk' THEN frame ELSE chunk END, s.e[2] FROM (SELECT t.session, t.seq, t.frame, p.chunk, CASE
    WHEN tag = 'cancel' THEN CASE WHEN state IN ('', 'done') THEN [state, NULL] ELSE ['failed', 'cancelled'] END
    WHEN tag = 'error' AND state IN ('start', 'progress', 'cameras', 'chunk') THEN ['failed', 'internal']
    WHEN NOT ((state, tag) IN (('', 'open'), ('open', 'frame'), ('frame', 'frame'), ('frame', 'start'), ('start', 'progress'), ('progress', 'progress'), ('progress', 'cameras'), ('cameras', 'chunk'), ('chunk', 'chunk'), ('chunk', 'done'))) THEN ['failed', 'protocol']
    WHEN tag = 'chunk' AND t.frame <= chunk THEN ['failed', 'validation'] ELSE [tag, NULL] END AS e FROM v_s p JOIN v_t t ON t.session = p.session AND t.seq = p.seq + 1 AND p.state <> 'failed') s)
SELECT session, seq, state, error FROM v_s WHERE seq > 0"""
query("stream_session_fsm", duck("messages") + FSM)(lambda s, d: _long_session(run(s, st.stream_session_fsm(_text_session(_messages(s, d).select("session", "seq", F.expr(TAG).alias("tag"), F.expr(CHUNK).alias("frame")))))))
#: The same with sessions that fail when they are silent for longer than SILENT_DAYS, also at the end, for time goes on after the last message.
SILENT_DAYS = 1
GONE = f"(p.ms IS NOT NULL AND p.state <> 'done' AND t.ms - p.ms > {SILENT_DAYS * 86_400_000})"
STALLED = f""", v_t AS (SELECT session, seq, t_ms AS ms, {TAG} AS tag, {CHUNK} AS frame FROM v_messages), v_s AS (SELECT session, 0::BIGINT AS seq, '' AS state, -1::BIGINT AS chunk, NULL::VARCHAR AS error, NULL::BIGINT AS ms FROM (SELECT DISTINCT session FROM v_messages)
  UNION ALL SELECT session, seq, s.e[1], CASE WHEN s.e[1] = 'chunk' THEN frame ELSE chunk END, s.e[2], ms FROM (SELECT t.session, t.seq, t.frame, t.ms, p.chunk, CASE WHEN {GONE} THEN ['failed', 'stalled']
    WHEN tag = 'cancel' THEN CASE WHEN state IN ('', 'done') THEN [state, NULL] ELSE ['failed', 'cancelled'] END
    WHEN tag = 'error' AND state IN ('start', 'progress', 'cameras', 'chunk') THEN ['failed', 'internal']
    WHEN NOT ((state, tag) IN (('', 'open'), ('open', 'frame'), ('frame', 'frame'), ('frame', 'start'), ('start', 'progress'), ('progress', 'progress'), ('progress', 'cameras'), ('cameras', 'chunk'), ('chunk', 'chunk'), ('chunk', 'done'))) THEN ['failed', 'protocol']
    WHEN tag = 'chunk' AND t.frame <= chunk THEN ['failed', 'validation'] ELSE [tag, NULL] END AS e FROM v_s p JOIN v_t t ON t.session = p.session AND t.seq = p.seq + 1 AND p.state <> 'failed') s),
v_z AS (SELECT session, arg_max(state, seq) AS state, max(seq) AS seq FROM v_s GROUP BY session)
SELECT session, CASE WHEN error = 'stalled' THEN seq - 1 ELSE seq END AS seq, state, error FROM v_s WHERE seq > 0 UNION ALL SELECT session, seq, 'failed', 'stalled' FROM v_z WHERE seq > 0 AND state NOT IN ('done', 'failed')"""


@query("stream_session_stalls", duck("messages") + STALLED)
def stream_session_stalls(s, d):
    """The states of sessions with timers, over three batches in time and a last message of another session a year later."""
    m = _text_session(view(s, d, "messages").select("session", "seq", F.expr(TAG).alias("tag"), F.expr(CHUNK).alias("frame"), F.col("ts").cast("timestamp").alias("ts")))
    end = m.agg(F.max("ts").alias("ts")).select(F.lit("end").alias("session"), F.lit(1).cast("long").alias("seq"), F.lit("open").alias("tag"), F.lit(0).cast("long").alias("frame"), (F.col("ts") + F.expr("interval 365 days")).alias("ts"))
    rows = run(s, st.stream_session_fsm(stream_in_time(s, m, "ts", "stalls", end), f"{SILENT_DAYS} days"))
    return _long_session(rows.where("session <> 'end'"))


@query("stream_log_dedup", duck("messages") + """, v_d AS (SELECT session, seq, line FROM (SELECT session, seq, tag AS line, lag(tag) OVER (PARTITION BY session ORDER BY seq) AS p FROM v_messages) WHERE p IS NULL OR p <> line)
SELECT session, seq, line FROM v_d QUALIFY row_number() OVER (PARTITION BY session ORDER BY seq DESC) <= 20""")
def stream_log_dedup(s, d):
    """What logs of twenty lines hold in the end."""
    changes = run(s, st.stream_log_dedup(_text_session(_messages(s, d).select("session", "seq", F.col("tag").alias("line"))), 20))
    return _long_session(st.log_lines(changes))


_pixels = lambda s, d: stream_of(s, d, "depth", "frame % 3 = 0")
@query("stream_cloud", duck("depth", "pose") + f", {DUCK_CAMS} SELECT frame, x AS px, y AS py, {WORLD} FROM v_depth JOIN v_cams USING (frame) WHERE NOT isnan(depth)")
def stream_cloud(s, d):
    """Pixels and cameras are both streams; the cameras of every second frame come a batch later than their pixels."""
    cams = stream_of(s, d, "pose", "frame % 2 = 0")
    return run(s, st.stream_cloud(stream_of(s, d, "depth", "frame % 3 = 0"), cams)).select("frame", "px", "py", *[F.round(c, 5).alias(c) for c in ("wx", "wy", "wz")])


@query("stream_conf_threshold", duck("depth") + """, v_h AS (SELECT 's' || frame % 5 AS session, floor((ln(least(greatest(conf, 1e-3), 1e3)) - ln(1e-3)) / (ln(1e3) - ln(1e-3)) * 4095)::BIGINT AS bin, count(*) AS c FROM v_depth WHERE NOT isnan(conf) GROUP BY ALL),
v_u AS (SELECT *, sum(c) OVER (PARTITION BY session ORDER BY bin) AS upto, sum(c) OVER (PARTITION BY session) AS n FROM v_h) SELECT session, min(bin) AS bin, any_value(n)::BIGINT AS n FROM v_u WHERE upto > floor((n - 1) * 0.3e0) GROUP BY session""")
def stream_conf_threshold(s, d):
    """The last threshold of each session, the bin of the quantile 0.3."""
    rows = run(s, st.stream_conf_threshold(_pixels(s, d).withColumn("session", F.concat(F.lit("s"), (F.col("frame") % 5).cast("string"))), 0.3))
    return rows.groupBy("session").agg(F.max_by("bin", "n").cast("long").alias("bin"), F.max("n").alias("n"))


query("stream_conf_hist", duck("depth") + " SELECT 's' AS session, floor((ln(least(greatest(conf, 1e-3), 1e3)) - ln(1e-3)) / (ln(1e3) - ln(1e-3)) * 4095)::BIGINT AS bin, count(*) AS count FROM v_depth WHERE NOT isnan(conf) GROUP BY ALL")(lambda s, d: run(s, st.stream_conf_hist(_pixels(s, d).withColumn("session", F.lit("s"))), "complete").withColumn("bin", F.col("bin").cast("long")))


@query("stream_keyframes", duck("candidates") + SHARP + FOLD + " SELECT video, ci FROM v_kept")
def stream_keyframes(s, d):
    """All candidates, with and without a fix, until their videos end: the same rows as prune_redundant has."""
    c = view(s, d, "candidates").selectExpr("video", "cast(ci as bigint) as ci", "sharpness", "lat", "lon", "yaw", "cast(null as array<int>) as px", "ci = max(ci) over (partition by video) as last")
    return run(s, st.stream_keyframes(stream_of(s, d, "candidates", "ci > 9", c))).select("video", F.col("ci").cast("int").alias("ci"))


BURSTS = """, v_t AS (SELECT *, CASE WHEN epoch(CAST(capture_time AS TIMESTAMP)) - lag(epoch(CAST(capture_time AS TIMESTAMP))) OVER o < 600 THEN 0 ELSE 1 END AS new FROM v_photos WHERE capture_time IS NOT NULL WINDOW o AS (PARTITION BY session ORDER BY capture_time, path)),
v_b AS (SELECT *, sum(new) OVER (PARTITION BY session ORDER BY capture_time, path) AS burst FROM v_t) SELECT session, count(*) AS n, round(max(sharpness), 6) AS sharpness, arg_max(path, struct_pack(a := sharpness, b := -epoch(CAST(capture_time AS TIMESTAMP)), c := path)) AS path FROM v_b GROUP BY session, burst"""
@query("stream_bursts", duck("photos") + BURSTS)
def stream_bursts(s, d):
    """Bursts as the watermark, ten seconds behind, passes their ends; the last row says that time goes on."""
    p = view(s, d, "photos").where("capture_time is not null").select("session", F.to_timestamp("capture_time").alias("ts"), "path", "sharpness")
    end = p.agg(F.max("ts").alias("ts")).select(F.lit(-1).cast(p.schema["session"].dataType).alias("session"), (F.col("ts") + F.expr("interval 1 day")).alias("ts"), F.lit("").alias("path"), F.lit(0.0).alias("sharpness"))
    rows = run(s, st.stream_bursts(stream_in_time(s, p, "ts", "bursts", end), gap="599999999 microseconds"))
    return rows.where("session >= 0").select("session", "n", F.round("sharpness", 6).alias("sharpness"), "path")


@query("stream_telemetry_asof", duck("telemetry", "probes") + ASOF + " SELECT video, probe, seq::BIGINT AS seq FROM v_pick")
def stream_telemetry_asof(s, d):
    """All probes, those without an entry too, with watermarks of ten seconds; a last row of each stream says that time goes on."""
    at = lambda c: F.timestamp_millis(F.col(c) + 1_700_000_000_000)
    frames = view(s, d, "probes").select("video", "probe", at("t_ms").alias("ts"))
    entries = view(s, d, "telemetry").select("video", F.col("seq").cast("long").alias("seq"), at("start_ms").alias("start_ts"), at("end_ms").alias("end_ts"))
    last = frames.select("ts").union(entries.select("start_ts")).agg((F.max("ts") + F.expr("interval 1 day")).alias("ts"))
    none = F.lit(-1).cast(frames.schema["video"].dataType).alias("video")
    f = stream_in_time(s, frames, "ts", "probes", last.select(none, F.lit(-1).cast(frames.schema["probe"].dataType).alias("probe"), "ts"))
    e = stream_in_time(s, entries, "start_ts", "entries", last.select(none, F.lit(-1).cast("long").alias("seq"), F.col("ts").alias("start_ts"), F.col("ts").alias("end_ts")))
    return run(s, st.stream_telemetry_asof(f, e, 900_000, 200_000, "10 seconds")).where("probe >= 0")


# --- sinks: written to the shared folder and read back
def _folder(s, name: str) -> str:
    return f"{_scratch(s)}/{name}-{uuid.uuid4().hex}"


def _cloud(s, d):
    points = cloud.build_cloud(view(s, d, "depth"), view(s, d, "rgb"), view(s, d, "pose"))
    return points.select(F.col("wx").alias("x"), F.col("wy").alias("y"), F.col("wz").alias("z"), "r", "g", "b", "conf", "frame")


#: What a point file holds, as single precision.
_XYZ = lambda *names: ", ".join(f"round(CAST({n} AS FLOAT)::DOUBLE, 4) AS {a}" for n, a in zip(names, ("x", "y", "z", "conf"), strict=True))


def _read_points(s, path):
    back = sinks.read_ply_files(s, path)
    return back.select("frame", *[F.col(c).cast("long").alias(c) for c in ("r", "g", "b")], *[F.round(F.col(c).cast("double"), 4).alias(c) for c in ("x", "y", "z", "conf")])


POINTS = BUILD + f", v_all AS (SELECT frame, r, g, b, conf, {RAW} FROM v_ok JOIN v_rgb USING (frame, x, y) JOIN v_cams USING (frame)) SELECT frame, r, g, b, {_XYZ('w0', 'w1', 'w2', 'conf')} FROM v_all"


@query("ply_sink", POINTS)
def ply_sink(s, d):
    path = _folder(s, "ply")
    sinks.write_ply(_cloud(s, d), path, 10_000, wide_frames=True)
    return _read_points(s, path)


@query("stream_ply", duck("depth", "pose") + f", {DUCK_CAMS}, v_all AS (SELECT frame, x AS r, y AS g, 0::BIGINT AS b, CASE WHEN isnan(conf) THEN 0 ELSE conf END AS conf, {RAW} FROM v_depth JOIN v_cams USING (frame) WHERE NOT isnan(depth)) SELECT frame, r, g, b, {_XYZ('w0', 'w1', 'w2', 'conf')} FROM v_all")
def stream_ply(s, d):
    """Points as they arrive, with the pixel's place for a colour."""
    path = _folder(s, "stream-ply")
    points = st.stream_cloud(_pixels(s, d), view(s, d, "pose"))
    sinks.stream_ply(points.select(F.col("wx").alias("x"), F.col("wy").alias("y"), F.col("wz").alias("z"), F.col("px").alias("r"), F.col("py").alias("g"), F.lit(0).alias("b"), F.nanvl(F.coalesce("conf", F.lit(0.0)), F.lit(0.0)).alias("conf"), "frame"), path, _folder(s, "check"), wide_frames=True)
    return _read_points(s, path)


@query("manifest_sink", FRAMES)
def manifest_sink(s, d):
    path = _folder(s, "manifests")
    sinks.write_manifests(_manifest(s, d), path)
    return _frames_of(readers.read_manifests(s, path))


#: Digests of rows whose values both engines write alike: their JSON, in order of the columns.
BUNDLE = f""", {DUCK_CAMS}, v_px AS (SELECT frame // 100 AS session, count(*) AS n, sum(round(depth, 3)) AS total FROM v_depth WHERE NOT isnan(depth) AND NOT isnan(conf) GROUP BY ALL),
v_sha AS (SELECT session, sharpness, sha256('{{"video":' || video || ',"ci":' || ci || ',"event_id":' || event_id || '}}') AS sha FROM v_candidates)
SELECT 'candidates' AS part, session, count(*) AS n, round(sum(sharpness), 3) AS total, min(sha) AS first_sha, max(sha) AS last_sha FROM v_sha GROUP BY session
UNION ALL SELECT 'cameras', frame // 100, count(*), round(sum(fx), 3), NULL, NULL FROM v_cams GROUP BY ALL
UNION ALL SELECT 'depth', session, n, round(total, 3), NULL, NULL FROM v_px
UNION ALL SELECT 'settings', session, 1, 1000, sha256('{{"budget":1000}}'), sha256('{{"budget":1000}}') FROM (SELECT DISTINCT session FROM v_candidates)"""


@query("session_bundle", duck("candidates", "pose", "depth") + BUNDLE)
def session_bundle(s, d):
    """Candidates, cameras, depth with confidence, and settings, written as one bundle and read back: a row for each part of a session.

    Of parts that have whole numbers alone, the least and the greatest digest; a row whose digest isn't that of its content fails the query.
    """
    path = _folder(s, "bundle")
    c = view(s, d, "candidates")
    by_hundred = lambda df: df.withColumn("session", F.expr("frame div 100"))
    cams, px = by_hundred(cloud.cameras(view(s, d, "pose"))), by_hundred(cloud.finite_filter(view(s, d, "depth"), "offline"))
    tables = {"candidates": c.select("session", "video", "ci", "event_id"), "sharpness": c.select("session", "sharpness"), "cameras": cams, "depth": px, "settings": c.select("session").distinct().withColumn("budget", F.lit(1000))}
    sinks.write_bundle(tables, path)
    total = {"candidates": F.lit(0.0), "sharpness": F.col("sharpness"), "cameras": F.col("fx"), "depth": F.round("depth", 3), "settings": F.col("budget").cast("double")}
    session = F.col("session").cast("long").alias("session")
    parts = {}
    for k, x in total.items():
        rows = s.read.parquet(f"{path}/{k}")
        content = F.sha2(F.to_json(F.struct(*[n for n in tables[k].columns if n != "session"])), 256)
        checked = F.when(F.col("row_sha256") == content, F.col("row_sha256")).otherwise(F.raise_error(F.lit(f"a row of {k} isn't what was written")))
        parts[k] = rows.withColumn("sha", checked).groupBy(session).agg(F.count("sha").alias("n"), F.round(F.sum(x), 3).alias("total"), F.min("sha").alias("first_sha"), F.max("sha").alias("last_sha"))
    none = F.lit(None).cast("string")
    out = parts["candidates"].drop("total").join(parts["sharpness"].select("session", "total"), "session").select(F.lit("candidates").alias("part"), "session", "n", "total", "first_sha", "last_sha")
    for k in ("cameras", "depth", "settings"):
        own = k == "settings"
        out = out.unionByName(parts[k].select(F.lit(k).alias("part"), "session", "n", "total", *[(F.col(c) if own else none).alias(c) for c in ("first_sha", "last_sha")]))
    return out
