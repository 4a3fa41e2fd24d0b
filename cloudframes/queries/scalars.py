"""Scalar functions over whole views."""

from pyspark.sql import functions as F

from ..fixtures import duck, view
from ..functions import color, geo, pose, sizing, text
from . import query


def scalar(name: str, of: str, keys: str, columns, sql: dict[str, str], where: str | None = None):
    """A query that adds columns to the keys of a view; doubles are rounded to six digits on both sides."""

    def run(spark, sf_dir):
        df = view(spark, sf_dir, of)
        df = df.where(where) if where else df
        made = columns()
        out = df.select(*keys.split(), *[c.alias(n) for n, c in made.items()])
        for f in out.schema.fields:
            if f.name in made:
                kind = f.dataType.simpleString()
                out = out.withColumn(f.name, F.round(f.name, 6) if kind == "double" else F.col(f.name).cast("long") if kind in ("int", "bigint") else F.col(f.name))
        return out

    parts = ", ".join(f"{e} AS {n}" for n, e in sql.items())
    query(name, f"{duck(of)} SELECT {', '.join(keys.split())}, {parts} FROM v_{of}" + (f" WHERE {where}" if where else ""))(run)


def d(e: str) -> str:
    return f"round(CAST({e} AS DOUBLE), 6)"


def i(e: str) -> str:
    return f"CAST({e} AS BIGINT)"


c, lit = F.col, F.lit


_hav = "2 * 6371000.0e0 * asin(sqrt(power(sin(radians(60.0005e0 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(60.0005e0)) * power(sin(radians(25.0004e0 - lon) / 2), 2)))"
scalar("haversine_m", "candidates", "event_id", lambda: {"m": F.round(geo.haversine_m(c("lat"), c("lon"), lit(60.0005), lit(25.0004)), 3)}, {"m": f"round({_hav}, 3)"})
scalar("wrap180", "candidates", "event_id", lambda: {"deg": geo.wrap180(c("yaw") * 3 - 500)}, {"deg": d("CASE WHEN ((yaw * 3 - 500) - 360 * floor((yaw * 3 - 500) / 360)) > 180 THEN ((yaw * 3 - 500) - 360 * floor((yaw * 3 - 500) / 360)) - 360 ELSE ((yaw * 3 - 500) - 360 * floor((yaw * 3 - 500) / 360)) END")})
scalar("gps_sentinel", "candidates", "event_id", lambda: {"has_fix": geo.gps_or_null(F.when(c("event_id") % 3 != 0, c("lat")).otherwise(0.0), F.when(c("event_id") % 3 != 0, c("lon")).otherwise(0.0)).isNotNull()}, {"has_fix": "event_id % 3 <> 0 AND lat IS NOT NULL"})
scalar("luma601", "rgb", "frame x y", lambda: {"luma": color.luma601(c("r"), c("g"), c("b"))}, {"luma": i("(77 * r + 150 * g + 29 * b + 128) >> 8")})
CA_W, CA_H = "CASE WHEN height / width::DOUBLE < 0.5 THEN round(height / 0.5) ELSE width END", "CASE WHEN height / width::DOUBLE > 2 THEN round(width * 2.0) ELSE height END"
scalar("clamp_aspect", "photos", "path", lambda: dict(zip(("cw", "ch"), sizing.clamp_aspect(c("width"), c("height")))), {"cw": i(CA_W), "ch": i(CA_H)})
_EX = "sqrt(1024.0e0 / (height / width::DOUBLE))"
scalar("balanced_grid", "photos", "path", lambda: dict(zip(("cols", "rows"), sizing.balanced_grid(c("width"), c("height")))), {"cols": i(f"greatest(round({_EX}), 1)"), "rows": i(f"greatest(round(1024.0e0 / {_EX}), 1)")})
_EX2 = f"sqrt(1024.0e0 / (({CA_H}) / ({CA_W})::DOUBLE))"
TW, TH = f"greatest(round({_EX2}), 1) * 16", f"greatest(round(1024.0e0 / {_EX2}), 1) * 16"
scalar("target_size", "photos", "path", lambda: dict(zip(("tw", "th"), sizing.target_size(c("width"), c("height")))), {"tw": i(TW), "th": i(TH)})
CR_W, CR_H = "CASE WHEN height / width::DOUBLE > 0.75 THEN width ELSE round(height / 0.75) END", "CASE WHEN height / width::DOUBLE > 0.75 THEN round(width * 0.75) ELSE height END"
scalar("crop_to_aspect", "photos", "path", lambda: dict(zip(("cw", "ch"), sizing.crop_to_aspect(c("width"), c("height"), lit(0.75)))), {"cw": i(CR_W), "ch": i(CR_H)})
CC_W = f"least(greatest(round(({CR_W}) * 0.8e0), 16), {CR_W})"
CC_H = f"least(greatest(round(({CC_W}) * ({CR_H}) / ({CR_W})::DOUBLE), 1), {CR_H})"
scalar("centered_crop", "photos", "path", lambda: sizing.centered_crop(c("width"), c("height"), lit(400), lit(300), lit(0.8)), {"crop_x": i(f"floor((width - {CC_W}) / 2)"), "crop_y": i(f"floor((height - {CC_H}) / 2)"), "crop_w": i(CC_W), "crop_h": i(CC_H)})
scalar("crop_loss", "photos", "path", lambda: {"loss": sizing.crop_loss(c("width"), c("height"), *sizing.crop_to_aspect(c("width"), c("height"), lit(0.75)))}, {"loss": d(f"1.0e0 - ({CR_W}) * ({CR_H}) / (width * height)::DOUBLE")})
scalar("patch_tokens", "photos", "path", lambda: {"patches": sizing.patch_tokens(c("width"), c("height")), "tokens": sizing.frame_tokens(c("width"), c("height"))}, {"patches": i("CASE WHEN width % 16 = 0 AND height % 16 = 0 THEN (width // 16) * (height // 16) END"), "tokens": i("CASE WHEN width % 16 = 0 AND height % 16 = 0 THEN (width // 16) * (height // 16) + 17 END")})
scalar("frame_tokens", "photos", "path", lambda: {"tokens": sizing.frame_tokens(c("width") - c("width") % 16, c("height"))}, {"tokens": i("CASE WHEN height % 16 = 0 THEN (width // 16) * (height // 16) + 17 END")})
scalar("even_height", "photos", "path", lambda: {"h": sizing.even_height(c("width"), c("height"), lit(480))}, {"h": i("greatest(round(height * 480 / width::DOUBLE / 2) * 2, 2)")})
scalar("ratio_label", "photos", "path", lambda: {"label": sizing.ratio_label(c("width"), c("height"))}, {"label": "CASE " + " ".join(f"WHEN abs(width / height::DOUBLE - {a}::DOUBLE / {b}) < 0.02 THEN '{a}:{b}'" for a, b in sizing.RATIOS) + " ELSE width || '×' || height END"})
scalar("est_cost_s", "events_k", "event_id", lambda: {"cost": sizing.est_cost_s(c("k"))}, {"cost": d("227.0e0 * (k / 120.0e0) * (k / 120.0e0) + 100.0e0 * (k / 120.0e0)")})
scalar("wire_size", "photos", "path", lambda: sizing.wire_size(c("width"), c("height"), lit(8)), {"rgb_bytes": i("width * height * 3"), "chunk_bytes": i("width * height * 32")})
scalar("crop_scale_clamp", "events_k", "event_id", lambda: {"scale": sizing.crop_scale_clamp(c("value") / 50, c("event_type") != "error")}, {"scale": d("CASE WHEN event_type <> 'error' THEN least(greatest(value / 50, 0.3), 1.0) END")})
scalar("frame_stride", "events_k", "event_id", lambda: {"step": sizing.candidate_step(c("k") / 2.0)}, {"step": i("greatest(round(k / 2.0 / 2), 1)")})
scalar("quantize_color", "events_k", "event_id", lambda: {"q": color.quantize_color(c("value") / 40 - 0.2)}, {"q": i("floor(least(greatest((value / 40 - 0.2e0) * 255 + 0.5e0, 0), 255))")})
DLY = "CASE WHEN value / 60 <= 0.14 THEN (value / 60 - 0.0929e0) / 6.025e0 ELSE (power(10.0e0, (value / 60 - 0.584555e0) / 0.256663e0) - 0.0108e0) / 0.9892e0 END"
CLAMPED = DLY.replace("value / 60", "least(value, 80) / 60")
scalar("dlog_decode", "events_k", "event_id", lambda: {"light": color.dlog_decode(F.least(c("value"), lit(80.0)) / 60)}, {"light": d(CLAMPED)})
SR = "CASE WHEN {0} <= 0.0031308 THEN 12.92e0 * {0} ELSE 1.055e0 * power({0}, 1 / 2.4e0) - 0.055e0 END"
scalar("srgb_encode", "events_k", "event_id", lambda: {"v": color.srgb_encode(c("k") / 100.0)}, {"v": d(SR.format("(k / 100.0e0)"))})
scalar("dlog_to_rec709", "events_k", "event_id", lambda: {"v": color.dlog_to_rec709(c("value") / 60)}, {"v": d(SR.format(f"least(greatest({DLY}, 0.0e0), 1.0e0)"))})
scalar("activations", "depth", "frame x y", lambda: color.activations(c("conf") - 2), {"depth": d("exp(conf - 2)"), "conf": d("1 + exp(conf - 2)"), "fov": d("greatest(conf - 2, 0) + 0.01e0")}, "not isnan(conf)")
scalar("exif_datetime", "events_k", "event_id", lambda: {"iso": text.exif_datetime(F.translate(F.translate("iso", "-", ":"), "T", " "))}, {"iso": "iso"})
scalar("timestamp_secs", "events_k", "event_id", lambda: {"secs": text.timestamp_secs(F.when(c("k") % 10 == 0, F.regexp_replace("iso", "-01-", "-13-")).otherwise(c("iso")))}, {"secs": i("CASE WHEN k % 10 = 0 AND contains(iso, '-01-') THEN NULL ELSE epoch(CAST(iso AS TIMESTAMP)) END")})
# whole hundredths, for halves of them are rounded in two ways
_seconds = lambda: (c("ms") % 100000000 - c("ms") % 10) / 1000 * 1.0
scalar("timecode", "events_k", "event_id", lambda: {"long": text.timecode(_seconds()), "short": text.mmss(_seconds())}, {"long": "format('{:02d}:{:02d}:{:05.2f}', (ms % 100000000) // 3600000, (ms % 100000000) // 60000 % 60, (ms % 100000000 - ms % 10) / 1000 % 60)", "short": "format('{:02d}:{:02d}', (ms % 100000000) // 60000, (ms % 100000000) // 1000 % 60)"})
scalar("mmss", "events_k", "event_id", lambda: {"short": text.mmss(c("k") * 7.0)}, {"short": "format('{:02d}:{:02d}', k * 7 // 60, k * 7 % 60)"})
_N = "(event_id * 997 - event_id * 997 % 100 + 1)"
scalar("point_label", "events_k", "event_id", lambda: {"label": text.point_label(F.expr(_N))}, {"label": f"CASE WHEN {_N} >= 1000000 THEN format('{{:.1f}} M', {_N} / 1e6) WHEN {_N} >= 1000 THEN format('{{:.1f}} k', {_N} / 1e3) ELSE CAST({_N} AS VARCHAR) END"})
scalar("path_parts", "listing", "path", lambda: {k: v for k, v in text.path_parts(c("path")).items() if k != "name"}, {"dir": "regexp_extract(path, '^(.*)/[^/]*$', 1)", "stem": "lower(regexp_extract(regexp_extract(path, '([^/]*)$', 1), '^(.+?)(\\.[^.]*)?$', 1))", "ext": "lower(regexp_extract(regexp_extract(path, '([^/]*)$', 1), '^.+\\.([^.]*)$', 1))"})
scalar("sha256_hex", "listing", "path", lambda: {"sha": F.sha2("path", 256)}, {"sha": "sha256(path)"})
scalar("srt_timestamp", "telemetry", "video seq", lambda: {"ms": text.srt_timestamp(F.format_string("%02d:%02d:%02d,%d", F.floor(c("start_ms") / 3600000), F.floor(c("start_ms") / 60000) % 60, F.floor(c("start_ms") / 1000) % 60, c("start_ms") % 1000))}, {"ms": "start_ms"})
scalar("srt_strip_tags", "listing", "path", lambda: {"plain": text.strip_tags(F.concat(lit("<b>"), c("path"), lit("</b> > x <i")))}, {"plain": "path || '  x '"})
_s = "2.0e0 / (enc[4] * enc[4] + enc[5] * enc[5] + enc[6] * enc[6] + enc[7] * enc[7])"
R = [[f"(1 - {_s} * (enc[5] * enc[5] + enc[6] * enc[6]))", f"({_s} * (enc[4] * enc[5] - enc[6] * enc[7]))", f"({_s} * (enc[4] * enc[6] + enc[5] * enc[7]))"], [f"({_s} * (enc[4] * enc[5] + enc[6] * enc[7]))", f"(1 - {_s} * (enc[4] * enc[4] + enc[6] * enc[6]))", f"({_s} * (enc[5] * enc[6] - enc[4] * enc[7]))"], [f"({_s} * (enc[4] * enc[6] - enc[5] * enc[7]))", f"({_s} * (enc[5] * enc[6] + enc[4] * enc[7]))", f"(1 - {_s} * (enc[4] * enc[4] + enc[5] * enc[5]))"]]
scalar("quat_to_mat", "pose", "frame", lambda: pose.quat_to_mat(*[F.get("enc", lit(k)) for k in range(3, 7)]), {f"r{a}{b}": d(R[a][b]) for a in range(3) for b in range(3)})
FX, FY = "(width / 2.0e0 / tan(enc[9] / 2))", "(height / 2.0e0 / tan(enc[8] / 2))"
DUCK_CAMS = "v_cams AS (SELECT frame, width, height, " + ", ".join(f"{R[a][b]} AS r{a}{b}" for a in range(3) for b in range(3)) + f", enc[1] AS t0, enc[2] AS t1, enc[3] AS t2, {FX} AS fx, {FY} AS fy, width / 2.0e0 AS cx, height / 2.0e0 AS cy FROM v_pose)"
scalar("decode_pose", "pose", "frame", lambda: pose.decode_pose(c("enc"), c("width"), c("height")), {**{f"r{a}{b}": d(R[a][b]) for a in range(3) for b in range(3)}, "t0": d("enc[1]"), "t1": d("enc[2]"), "t2": d("enc[3]"), "fx": d(FX), "fy": d(FY), "cx": d("width / 2.0e0"), "cy": d("height / 2.0e0")})
