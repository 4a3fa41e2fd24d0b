"""Catalogue, telemetry and keyframe queries."""

from pyspark.sql import functions as F

from ..fixtures import duck, view
from ..operators import catalog, keyframes, telemetry
from ..plans import selection as plan
from ..sources import readers
from . import query

# --- catalogue
MEDIA = """, v_media AS (SELECT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, lower(regexp_extract(regexp_extract(path, '([^/]*)$', 1), '^(.+?)(\\.[^.]*)?$', 1)) AS stem, ext,
    CASE WHEN ext IN ('mp4', 'mov') THEN 'video' WHEN ext IN ('jpg', 'jpeg', 'png', 'tif', 'tiff', 'heic', 'heif') OR ext = 'dng' THEN 'photo' END AS kind, ext = 'dng' AS is_raw
    FROM (SELECT DISTINCT path, lower(regexp_extract(regexp_extract(path, '([^/]*)$', 1), '^.+\\.([^.]*)$', 1)) AS ext FROM v_listing WHERE NOT regexp_matches(path, '(^|/)\\.[^/]')) WHERE ext <> 'txt')"""
_media = lambda s, d: catalog.classify(view(s, d, "listing"))
query("media_scan", duck("listing") + MEDIA + " SELECT * FROM v_media")(_media)
query("path_distinct", duck("listing") + " SELECT DISTINCT path FROM v_listing")(lambda s, d: view(s, d, "listing").distinct())
PAIRED = ", v_raw AS (SELECT DISTINCT dir, stem FROM v_media WHERE is_raw), v_pairs AS (SELECT path FROM v_media SEMI JOIN v_raw USING (dir, stem) WHERE kind = 'photo' AND NOT is_raw)"
query("raw_pair_dedup", duck("listing") + MEDIA + PAIRED + " SELECT * FROM v_media WHERE path NOT IN (SELECT path FROM v_pairs)")(lambda s, d: catalog.drop_paired(_media(s, d)).select("path", "dir", "stem", "ext", "kind", "is_raw"))
query("raw_pair_count", duck("listing") + MEDIA + PAIRED + " SELECT count(*) AS n_paired FROM v_pairs")(lambda s, d: catalog.paired_count(_media(s, d)))


@query("exclusion_filter", duck("listing") + MEDIA + " SELECT path FROM v_media WHERE dir NOT LIKE '%/src1' AND NOT (kind = 'video' AND stem LIKE 'f4%')")
def exclusion_filter(s, d):
    m = _media(s, d)
    return catalog.exclude(m, m.where("dir like '%/src1'").select("dir").distinct(), m.where("stem like 'f4%'").select("path")).select("path")


query("dir_rollup", duck("listing") + MEDIA + " SELECT dir, count(*) FILTER (kind = 'video') AS n_clips, count(*) FILTER (kind = 'photo') AS n_photos, count(*) FILTER (is_raw) AS n_raw, count(DISTINCT dir) AS n_dirs, grouping(dir)::BIGINT AS is_total FROM v_media GROUP BY ROLLUP (dir)")(lambda s, d: catalog.dir_rollup(_media(s, d)))
query("photo_order", duck("photos") + " SELECT session, path, row_number() OVER (PARTITION BY session ORDER BY coalesce(capture_time, ''), path)::BIGINT AS place FROM v_photos")(lambda s, d: view(s, d, "photos").selectExpr("session", "path", "cast(row_number() over (partition by session order by coalesce(capture_time, ''), path) as bigint) place"))
query("frame_limit", duck("photos") + " SELECT path FROM v_photos ORDER BY path LIMIT 64")(lambda s, d: view(s, d, "photos").select("path").orderBy("path").limit(64))

# --- telemetry
FIELDS = ("lat", "lon", "rel_alt", "yaw")
ASOF = """, v_near AS (SELECT p.video, p.probe, p.t_ms, (SELECT max(struct_pack(a := start_ms, b := seq)) FROM v_telemetry e WHERE e.video = p.video AND e.start_ms <= p.t_ms) AS b,
    (SELECT min(struct_pack(a := start_ms, b := seq)) FROM v_telemetry e WHERE e.video = p.video AND e.start_ms > p.t_ms) AS a FROM v_probes p),
v_pick AS (SELECT video, probe, t_ms, CASE WHEN b.a + 200000 > t_ms THEN b.b WHEN t_ms - b.a - 200000 <= 900000 AND (a IS NULL OR t_ms - b.a - 200000 <= a.a - t_ms) THEN b.b WHEN a.a - t_ms <= 900000 THEN a.b END AS seq FROM v_near)"""


def _asof(s, d):
    found = telemetry.asof(view(s, d, "probes"), view(s, d, "telemetry"), slack_ms=900_000)
    return found.select("video", "probe", "t_ms", "seq", *[F.round(c, 6).alias(c) for c in FIELDS])


query("telemetry_asof", duck("telemetry", "probes") + ASOF + " SELECT v_pick.video, probe, t_ms, seq::BIGINT AS seq, round(lat, 6) AS lat, round(lon, 6) AS lon, round(rel_alt, 6) AS rel_alt, round(yaw, 6) AS yaw FROM v_pick LEFT JOIN v_telemetry USING (video, seq)")(_asof)


@query("candidate_telemetry", duck("telemetry", "probes") + ASOF + " SELECT v_pick.video, probe AS ci, t_ms, round(lat, 6) AS lat FROM v_pick LEFT JOIN v_telemetry USING (video, seq)")
def candidate_telemetry(s, d):
    rows = telemetry.candidate_telemetry(view(s, d, "probes").withColumnRenamed("probe", "ci"), view(s, d, "telemetry"), 900_000)
    return rows.select("video", "ci", "t_ms", F.round("lat", 6).alias("lat"))


def srt_blocks(s, d):
    """v_telemetry written as subtitle texts, one a video, in two styles by the video's parity."""
    t = view(s, d, "telemetry")
    stamp = lambda ms: F.format_string("%02d:%02d:%02d,%d", F.floor(F.col(ms) / 3600000), F.floor(F.col(ms) / 60000) % 60, F.floor(F.col(ms) / 1000) % 60, F.col(ms) % 1000)
    new = F.format_string("<font size=\"28\">[iso : %d] [latitude: %s] [longtitude: %s] [rel_alt: %s abs_alt: 100.5] [gb_yaw : %s]</font>", "iso", F.col("lat").cast("string"), F.col("lon").cast("string"), F.col("rel_alt").cast("string"), F.col("yaw").cast("string"))
    old = F.format_string("GPS(%s,%s,19) BAROMETER:%s ISO:%d GB_YAW:%s", F.col("lon").cast("string"), F.col("lat").cast("string"), F.col("rel_alt").cast("string"), "iso", F.col("yaw").cast("string"))
    block = F.concat_ws("\n", (F.col("seq") + 1).cast("string"), F.concat(stamp("start_ms"), F.lit(" --> "), stamp("end_ms")), F.when(F.col("video") % 2 == 0, new).otherwise(old))
    rows = t.groupBy("video").agg(F.sort_array(F.collect_list(F.struct("seq", block.alias("b")))).alias("x"))
    return rows.select("video", F.array_join(F.transform("x", lambda x: x["b"]), "\r\n\r\n").alias("text"))


@query("srt_parse", duck("telemetry") + " SELECT video, seq, start_ms, end_ms, round(lat, 6) AS lat, round(lon, 6) AS lon, round(rel_alt, 6) AS rel_alt, round(yaw, 6) AS yaw, iso FROM v_telemetry")
def srt_parse(s, d):
    return readers.srt_parse(srt_blocks(s, d), "video").select("video", "seq", "start_ms", "end_ms", *[F.round(c, 6).alias(c) for c in FIELDS], "iso")


@query("srt_kv", duck("telemetry") + " SELECT video, seq, iso, CASE WHEN video % 2 = 0 THEN 100.5::DOUBLE END AS abs_alt FROM v_telemetry")
def srt_kv(s, d):
    return readers.srt_parse(srt_blocks(s, d), "video").select("video", "seq", "iso", "abs_alt")


@query("srt_gps_paren", duck("telemetry") + " SELECT video, seq, round(lat, 6) AS lat, round(lon, 6) AS lon FROM v_telemetry WHERE video % 2 = 1")
def srt_gps_paren(s, d):
    return readers.srt_parse(srt_blocks(s, d).where("video % 2 = 1"), "video").select("video", "seq", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


_PROBE = """format_string('{"streams":[{"index":0,"codec_type":"%s","width":%d,"height":%d,"avg_frame_rate":"%d/%d","r_frame_rate":"30/1","nb_frames":"%d"},{"index":2,"codec_type":"subtitle"}],"format":{"duration":"%s"}}',
    case when p_partkey % 11 = 0 then 'audio' else 'video' end, cast(p_size as int) * (case when p_partkey % 7 = 0 then 0 else 16 end), cast(p_size as int) * 9, 24000 + cast(p_size as int), case when p_partkey % 5 = 0 then 0 else 1001 end, cast(p_partkey as int), cast(p_retailprice as string))"""


@query("probe_json", """SELECT p_partkey AS path, CASE WHEN e IS NULL THEN p_size * 16 END::BIGINT AS width, CASE WHEN e IS NULL THEN p_size * 9 END::BIGINT AS height, CASE WHEN e IS NULL THEN round(CASE WHEN p_partkey % 5 = 0 THEN 30.0 ELSE (24000 + p_size) / 1001.0 END, 6) END::DOUBLE AS fps,
    CASE WHEN e IS NULL THEN p_partkey END::BIGINT AS n_frames, CASE WHEN e IS NULL THEN round(p_retailprice, 6) END AS duration_s, CASE WHEN e IS NULL THEN 2 END::BIGINT AS subtitle_stream, e AS error
    FROM (SELECT *, CASE WHEN p_partkey % 11 = 0 THEN 'no video stream' WHEN p_partkey % 7 = 0 THEN 'bad dimensions' END AS e FROM part)""")
def probe_json(s, d):
    docs = s.read.parquet(f"{d}/part.parquet").selectExpr("p_partkey as path", f"{_PROBE} as json")
    return readers.probe_json(docs).select("path", "width", "height", F.round("fps", 6).alias("fps"), "n_frames", F.round("duration_s", 6).alias("duration_s"), "subtitle_stream", "error")


@query("exif_pivot", """SELECT s_suppkey AS path, CASE WHEN s_suppkey % 5 <> 0 THEN '2025-06-23T08:25:' || lpad((s_suppkey % 60)::VARCHAR, 2, '0') END AS capture_time,
    CASE WHEN s_suppkey % 5 <> 0 THEN round((s_nationkey + 30 / 60.0 + (s_suppkey % 60) / 3600.0) * CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE -1 END, 6) END::DOUBLE AS lat,
    CASE WHEN s_suppkey % 5 <> 0 THEN round(-(s_nationkey + 100 + 15 / 60.0), 6) END::DOUBLE AS lon, CASE WHEN s_suppkey % 5 <> 0 THEN round(abs(s_acctbal) * CASE WHEN s_suppkey % 3 = 0 THEN -1 ELSE 1 END, 6) END AS abs_alt,
    CASE WHEN s_suppkey % 5 <> 0 AND s_suppkey % 10 BETWEEN 1 AND 8 THEN s_suppkey % 10 ELSE 1 END::BIGINT AS orientation FROM supplier""")
def exif_pivot(s, d):
    sup = s.read.parquet(f"{d}/supplier.parquet").withColumnRenamed("s_suppkey", "path")
    row = lambda tag, vals, text="cast(null as string)": f"struct('{tag}' as tag, cast({vals} as array<double>) as vals, {text} as text)"
    none = "cast(null as array<double>)"
    tags = [row("GPSLatitude", "array(s_nationkey, 30, path % 60)"), row("GPSLatitudeRef", none, "case when path % 2 = 0 then 'N' else 'S' end"), row("GPSLongitude", "array(s_nationkey + 100, 15, 0)"), row("GPSLongitudeRef", none, "'W'"), row("GPSAltitude", "array(abs(s_acctbal))"), row("GPSAltitudeRef", "array(case when path % 3 = 0 then 1 else 0 end)"), row("Orientation", "array(path % 10)"), row("DateTimeOriginal", none, "concat('2025:06:23 08:25:', lpad(cast(path % 60 as string), 2, '0'))")]
    wide = sup.where("path % 5 <> 0").selectExpr("path", f"explode(array({', '.join(tags)})) as t").select("path", "t.*")
    meta = readers.exif_pivot(wide, sup)
    return meta.select("path", "capture_time", *[F.round(c, 6).alias(c) for c in ("lat", "lon", "abs_alt")], "orientation")


@query("telemetry_source", duck("telemetry") + """ , v_n AS (SELECT video, count(*) AS n FROM v_telemetry GROUP BY video), v_u AS (SELECT DISTINCT user_id AS video FROM events)
SELECT video, CASE WHEN video % 3 = 0 THEN 'sidecar' WHEN video % 3 = 2 AND n > 0 THEN 'embedded' END AS source, CASE WHEN video % 3 = 1 THEN 'sidecar without entries' END AS error FROM v_u LEFT JOIN v_n USING (video) WHERE video IN (SELECT video FROM v_n)""")
def telemetry_source(s, d):
    n = view(s, d, "telemetry").groupBy("video").agg(F.count(F.lit(1)).alias("n_entries"))
    side = n.where("video % 3 <> 2").withColumn("n_entries", F.when(F.col("video") % 3 == 1, 0).otherwise(F.col("n_entries")))
    return telemetry.choose_source(n, side, n)


# --- keyframes
_cands = lambda s, d: view(s, d, "candidates")
SHARP = ", v_sharp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video, ci // 4 ORDER BY sharpness DESC, ci) AS rn FROM v_candidates) WHERE rn = 1)"
FOLD = """, v_walk AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY ci) AS i, count(*) OVER (PARTITION BY video) AS n FROM v_sharp),
v_fold AS (SELECT video, i, ci, lat AS klat, lon AS klon, yaw AS kyaw, true AS kept FROM v_walk WHERE i = 1
  UNION ALL SELECT w.video, w.i, w.ci, CASE WHEN k THEN w.lat ELSE f.klat END, CASE WHEN k THEN w.lon ELSE f.klon END, CASE WHEN k THEN w.yaw ELSE f.kyaw END, k
  FROM v_fold f JOIN v_walk w ON w.video = f.video AND w.i = f.i + 1, LATERAL (SELECT CASE WHEN f.klat IS NOT NULL AND w.lat IS NOT NULL
    THEN 2 * 6371000.0e0 * asin(sqrt(power(sin(radians(w.lat - f.klat) / 2), 2) + cos(radians(f.klat)) * cos(radians(w.lat)) * power(sin(radians(w.lon - f.klon) / 2), 2))) >= 0.5
      OR least((f.kyaw - w.yaw) - 360 * floor((f.kyaw - w.yaw) / 360), 360 - ((f.kyaw - w.yaw) - 360 * floor((f.kyaw - w.yaw) / 360))) >= 5
    ELSE false END AS k)),
v_kept AS (SELECT f.video, f.ci FROM v_fold f JOIN v_walk w ON w.video = f.video AND w.i = f.i WHERE kept OR w.i = w.n)"""
DECIMATE = """, v_pos AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY ci) - 1 AS pos, count(*) OVER (PARTITION BY video) AS n FROM v_kept),
v_take AS (SELECT video, ci FROM v_pos WHERE n <= 6 OR pos IN (SELECT round(k * (n - 1) / 5.0e0) FROM range(6) AS r(k)))"""
_kept = lambda s, d: keyframes.prune_redundant(keyframes.sharpest_per_window(_cands(s, d)))
query("sharpest_per_window", duck("candidates") + SHARP + " SELECT video, ci, sharpness FROM v_sharp")(lambda s, d: keyframes.sharpest_per_window(_cands(s, d)).select("video", "ci", "sharpness"))
query("prune_redundant", duck("candidates") + SHARP + FOLD + " SELECT video, ci FROM v_kept")(_kept)
query("decimate", duck("candidates") + SHARP + FOLD + DECIMATE + " SELECT video, ci FROM v_take")(lambda s, d: keyframes.decimate(_kept(s, d), F.lit(6)))
query("select_keyframes", duck("candidates") + SHARP + FOLD + DECIMATE + " SELECT video, ci FROM v_take")(lambda s, d: keyframes.select_keyframes(_cands(s, d), 6))


THUMBS = """, v_px AS (SELECT s.*, px FROM v_sharp s JOIN v_thumbs t ON t.vec_id = s.event_id % (SELECT count(*) FROM v_thumbs)), v_walk AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY ci) AS i, count(*) OVER (PARTITION BY video) AS n FROM v_px),
v_fold AS (SELECT video, i, ci, lat AS klat, lon AS klon, yaw AS kyaw, px AS kpx, true AS kept FROM v_walk WHERE i = 1
  UNION ALL SELECT w.video, w.i, w.ci, CASE WHEN k THEN w.lat ELSE f.klat END, CASE WHEN k THEN w.lon ELSE f.klon END, CASE WHEN k THEN w.yaw ELSE f.kyaw END, CASE WHEN k THEN w.px ELSE f.kpx END, k
  FROM v_fold f JOIN v_walk w ON w.video = f.video AND w.i = f.i + 1, LATERAL (SELECT CASE WHEN f.klat IS NOT NULL AND w.lat IS NOT NULL
    THEN 2 * 6371000.0e0 * asin(sqrt(power(sin(radians(w.lat - f.klat) / 2), 2) + cos(radians(f.klat)) * cos(radians(w.lat)) * power(sin(radians(w.lon - f.klon) / 2), 2))) >= 0.5
      OR least((f.kyaw - w.yaw) - 360 * floor((f.kyaw - w.yaw) / 360), 360 - ((f.kyaw - w.yaw) - 360 * floor((f.kyaw - w.yaw) / 360))) >= 5
    ELSE list_sum(list_transform(list_zip(f.kpx, w.px), lambda z: abs(z[1] - z[2])))::DOUBLE / len(w.px) >= 30 END AS k))
SELECT f.video, f.ci FROM v_fold f JOIN v_walk w ON w.video = f.video AND w.i = f.i WHERE kept OR w.i = w.n"""


@query("prune_with_thumbs", duck("candidates", "thumbs") + SHARP + THUMBS)
def prune_with_thumbs(s, d):
    """Frames without a fix are told apart by their thumbnails."""
    px = view(s, d, "thumbs")
    rows = keyframes.sharpest_per_window(_cands(s, d)).withColumn("vec_id", F.col("event_id") % px.count())
    return keyframes.prune_redundant(rows.join(px, "vec_id").drop("vec_id"), diff=30.0)


query("mean_abs_diff", duck("thumbs") + " SELECT a.vec_id, round(list_sum(list_transform(list_zip(a.px, b.px), lambda z: abs(z[1] - z[2])))::DOUBLE / len(a.px), 6) AS diff FROM v_thumbs a JOIN v_thumbs b ON b.vec_id = a.vec_id + 1")(
    lambda s, d: view(s, d, "thumbs").join(view(s, d, "thumbs").selectExpr("vec_id - 1 as vec_id", "px as other"), "vec_id").select("vec_id", F.round(keyframes.mean_abs_diff(F.col("px"), F.col("other")), 6).alias("diff"))
)
BURST = """, v_t AS (SELECT *, epoch(CAST(capture_time AS TIMESTAMP)) AS t, row_number() OVER (PARTITION BY session ORDER BY coalesce(capture_time, ''), path) AS rn FROM v_photos),
v_b AS (SELECT *, sum(new) OVER (PARTITION BY session ORDER BY rn) AS burst FROM (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY session ORDER BY rn) < 600 THEN 0 ELSE 1 END AS new FROM v_t)),
v_best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session, burst ORDER BY sharpness DESC, rn) AS best FROM v_b) WHERE best = 1)"""
_bursts = lambda s, d: keyframes.burst_dedup(view(s, d, "photos"), gap_s=600)
query("burst_dedup", duck("photos") + BURST + " SELECT session, path FROM v_best")(lambda s, d: _bursts(s, d).select("session", "path"))
query("timeline_position", duck("candidates") + " SELECT video, ci, round(CASE WHEN count(*) OVER (PARTITION BY video) > 1 THEN ci * 100.0e0 / (count(*) OVER (PARTITION BY video) - 1) ELSE 0 END, 6) AS position FROM v_candidates")(lambda s, d: keyframes.timeline_position(_cands(s, d)).select("video", "ci", F.round("position", 6).alias("position")))


SPLIT = """, v_q AS (SELECT *, coalesce(total * n / nullif(sum(n) OVER (PARTITION BY session), 0)::DOUBLE, 0) AS q FROM v_n),
v_f AS (SELECT *, least(floor(q), n)::BIGINT AS base, sum((least(floor(q), n) < n)::INT) OVER (PARTITION BY session ORDER BY q - floor(q) DESC, video) AS turn FROM v_q),
v_g AS (SELECT *, greatest(base + (base < n AND turn <= total - sum(base) OVER (PARTITION BY session))::INT, least(2, n))::BIGINT AS v FROM v_f),
v_h AS (SELECT *, sum(v) OVER (PARTITION BY session) - total AS surplus FROM v_g),
v_u AS (SELECT session, video, surplus, row_number() OVER (PARTITION BY session ORDER BY u DESC, video DESC) AS rn FROM (SELECT *, unnest(range(1, v + 1)) AS u FROM v_h)),
v_share AS (SELECT session, video, CASE WHEN total > 0 THEN coalesce(s, 0) ELSE 0 END::BIGINT AS share FROM v_h LEFT JOIN (SELECT session, video, count(*) AS s FROM v_u WHERE rn > surplus GROUP BY ALL) USING (session, video))"""


@query("budget_split", duck("candidates") + ", v_n AS (SELECT session, video, count(*) AS n, 40 AS total FROM v_candidates GROUP BY ALL)" + SPLIT + " SELECT session, video, share FROM v_share")
def budget_split(s, d):
    """All candidates under a budget of 40, which brings the floor of two and the trim into play."""
    c = _cands(s, d)
    return plan.shares(c.select("session", "video", "ci"), c.select("session").distinct().withColumn("video_budget", F.lit(40)))


#: Kept photos within the budget, its rest over the videos' survivors, their order, and the reference.
AUTO = """, v_pp AS (SELECT session, path, row_number() OVER (PARTITION BY session ORDER BY path) - 1 AS pos, count(*) OVER (PARTITION BY session) AS n FROM v_best),
v_photo AS (SELECT session, path FROM v_pp WHERE n <= {budget} OR pos IN (SELECT round(k * (n - 1) / ({budget} - 1.0e0)) FROM range({budget}) AS r(k))),
v_surv AS (SELECT c.session, c.video, c.ci, c.ci * 15 AS source_frame, c.rel_alt FROM v_kept JOIN v_candidates c USING (video, ci)),
v_n AS (SELECT session, video, count(*) AS n, any_value({budget} - coalesce(p, 0)) AS total FROM v_surv LEFT JOIN (SELECT session, count(*) AS p FROM v_photo GROUP BY session) USING (session) GROUP BY session, video)""" + SPLIT + """,
v_vp AS (SELECT *, row_number() OVER (PARTITION BY session, video ORDER BY ci) - 1 AS pos, count(*) OVER (PARTITION BY session, video) AS n FROM v_surv JOIN v_share USING (session, video)),
v_video AS (SELECT * FROM v_vp WHERE n <= share OR share = 1 AND pos = 0 OR share > 1 AND pos IN (SELECT round(k * (n - 1) / (share - 1)::DOUBLE) FROM range({budget}) AS r(k) WHERE k < share)),
v_all AS (SELECT session, 'video' AS kind, video::VARCHAR AS source, ci, source_frame, rel_alt FROM v_video UNION ALL SELECT session, 'photo', path, NULL, NULL, NULL FROM v_photo),
v_sel AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY kind <> 'video', length(source), source, source_frame) - 1 AS pos, count(*) FILTER (kind = 'video') OVER (PARTITION BY session) AS n FROM v_all),
v_mid AS (SELECT *, n // 4 AS lo, greatest(3 * n // 4, n // 4 + 1) AS hi FROM v_sel),
v_ref AS (SELECT session, pos FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY rel_alt DESC NULLS LAST, CASE WHEN rel_alt IS NULL AND pos = lo + (hi - lo) // 2 THEN 0 ELSE 1 END, pos) AS rn FROM v_mid WHERE n = 0 AND pos = 0 OR kind = 'video' AND pos >= lo AND pos < hi) WHERE rn = 1)
SELECT v_sel.session, kind, source, ci, source_frame, rel_alt, v_sel.pos, r.pos IS NOT NULL AS is_reference FROM v_sel LEFT JOIN v_ref r ON v_sel.session = r.session AND v_sel.pos = r.pos"""  # fmt: skip


@query("auto_select", duck("candidates", "photos") + SHARP + FOLD + BURST + AUTO.format(budget=1000))
def auto_select(s, d):
    """Kept photos first, the rest of the budget over the videos' survivors, and the reference."""
    c = _cands(s, d)
    survivors = _kept(s, d).join(c, ["video", "ci"]).select("session", "video", "ci", (F.col("ci") * 15).alias("source_frame"), "rel_alt")
    return plan.auto_select(survivors, _bursts(s, d), 1000)


@query("reference_pick", duck("candidates") + """, v_p AS (SELECT video AS session, ci AS pos, rel_alt, count(*) OVER (PARTITION BY video) AS n FROM v_candidates), v_m AS (SELECT * FROM v_p WHERE pos >= n // 4 AND pos < greatest(3 * n // 4, n // 4 + 1)),
v_r AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY rel_alt DESC NULLS LAST, CASE WHEN rel_alt IS NULL AND pos = n // 4 + (greatest(3 * n // 4, n // 4 + 1) - n // 4) // 2 THEN 0 ELSE 1 END, pos) AS rn FROM v_m) SELECT session, pos FROM v_r WHERE rn = 1""")
def reference_pick(s, d):
    return keyframes.pick_reference(_cands(s, d).selectExpr("video as session", "ci as pos", "'video' as kind", "rel_alt"))


@query("batch_order", duck("candidates") + " SELECT video AS session, ci AS pos, (row_number() OVER (PARTITION BY video ORDER BY (ci = 3) DESC, ci) - 1)::BIGINT AS batch_index FROM v_candidates")
def batch_order(s, d):
    rows = keyframes.batch_order(_cands(s, d).selectExpr("video as session", "ci as pos", "ci = 3 as is_reference"))
    return rows.select("session", "pos", F.col("batch_index").cast("long").alias("batch_index"))


@query("preview_subset", duck("candidates") + " SELECT video AS session, ci AS pos FROM (SELECT *, row_number() OVER (PARTITION BY video ORDER BY (ci = 3) DESC, ci) - 1 AS b FROM v_candidates) WHERE b % 4 = 0")
def preview_subset(s, d):
    return plan.preview(keyframes.batch_order(_cands(s, d).selectExpr("video as session", "ci as pos", "ci = 3 as is_reference"))).select("session", "pos")


@query("log_dedup_tail", duck("messages") + """, v_l AS (SELECT session, seq, tag, lag(tag) OVER (PARTITION BY session ORDER BY seq) AS p FROM v_messages), v_k AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY seq DESC) AS rn FROM v_l WHERE p IS NULL OR p <> tag)
SELECT session, seq, tag AS line FROM v_k WHERE rn <= 20""")
def log_dedup_tail(s, d):
    return keyframes.log_tail(view(s, d, "messages").selectExpr("session", "seq", "tag as line"), keep=20)


query("chrono_order", duck("candidates", "photos") + " SELECT session, source, row_number() OVER (PARTITION BY session ORDER BY k, v, f, source)::BIGINT AS place FROM (SELECT session, 0 AS k, video AS v, ci AS f, video::VARCHAR || ':' || ci AS source FROM v_candidates UNION ALL SELECT session, 1, 0, 0, path FROM v_photos)")(
    lambda s, d: _cands(s, d).selectExpr("session", "0 k", "video v", "ci f", "concat(video, ':', ci) source").unionByName(view(s, d, "photos").selectExpr("session", "1 k", "cast(0 as bigint) v", "0 f", "path source")).selectExpr("session", "source", "cast(row_number() over (partition by session order by k, v, f, source) as bigint) place")
)
query("selection_union", duck("candidates", "photos") + " SELECT session, 'video' AS kind, video::VARCHAR AS source, ci::BIGINT AS ci FROM v_candidates UNION ALL SELECT session, 'photo', path, NULL FROM v_photos")(
    lambda s, d: _cands(s, d).selectExpr("session", "'video' kind", "cast(video as string) source", "cast(ci as bigint) ci").unionByName(view(s, d, "photos").selectExpr("session", "'photo' kind", "path source"), allowMissingColumns=True)
)
