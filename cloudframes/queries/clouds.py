"""Point cloud, frame and alignment queries."""

from pyspark.sql import functions as F

from ..fixtures import duck, view
from ..functions import pose
from ..operators import align, cloud, frames
from ..sources import readers, sinks
from . import query
from .scalars import DLY, DUCK_CAMS, SR

GOOD = "depth IS NOT NULL AND NOT isnan(depth)"
_depth = lambda s, d: view(s, d, "depth")
r6 = lambda *names: [F.round(n, 6).alias(n) for n in names]
query("finite_filter", duck("depth") + f" SELECT frame, x, y FROM v_depth WHERE {GOOD} AND NOT isnan(conf)")(lambda s, d: cloud.finite_filter(_depth(s, d), "offline").select("frame", "x", "y"))
query("conf_filter", duck("depth") + " SELECT frame, x, y FROM v_depth WHERE conf >= 2 AND NOT isnan(conf)")(lambda s, d: cloud.conf_filter(_depth(s, d), F.lit(2.0)).select("frame", "x", "y"))
query("frame_group", duck("depth") + " SELECT count(*) AS n_all, count(*) FILTER (frame % 2 = 0) AS n_even, count(*) FILTER (frame % 2 = 1) AS n_odd FROM v_depth")(lambda s, d: cloud.frame_group_counts(_depth(s, d)))
NEAR = ", v_near AS (SELECT a.frame, a.x, a.y, min(b.depth) FILTER (NOT isnan(b.depth)) AS lo, max(b.depth) FILTER (NOT isnan(b.depth)) AS hi, count(*) AS n, any_value(a.depth) AS own FROM v_depth a JOIN v_depth b ON a.frame = b.frame AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY ALL)"
query("grid_neighbors", duck("depth") + NEAR + " SELECT frame, x, y, round(lo, 6) AS lo, round(hi, 6) AS hi, n FROM v_near")(lambda s, d: cloud.grid_neighbors(_depth(s, d).withColumn("depth", F.when(~F.isnan("depth"), F.col("depth")))).select("frame", "x", "y", *r6("lo", "hi"), "n"))
EDGE = ", v_edge AS (SELECT frame, x, y, NOT isnan(own) AND (hi - lo) / greatest(abs(own), 1e-6) <= 0.03 AS keep FROM v_near)"
query("depth_edge_mask", duck("depth") + NEAR + EDGE + " SELECT frame, x, y, keep AS edge_keep FROM v_edge")(lambda s, d: cloud.depth_edge_mask(_depth(s, d)).select("frame", "x", "y", "edge_keep"))
LAP = ", v_gray AS (SELECT frame, x, y, (77 * r + 150 * g + 29 * b + 128) >> 8 AS v FROM v_rgb), v_lap AS (SELECT c.frame, c.x, c.y, l.v + r.v + u.v + d.v - 4 * c.v AS l FROM v_gray c JOIN v_gray l ON l.frame = c.frame AND l.y = c.y AND l.x = c.x - 1 JOIN v_gray r ON r.frame = c.frame AND r.y = c.y AND r.x = c.x + 1 JOIN v_gray u ON u.frame = c.frame AND u.x = c.x AND u.y = c.y - 1 JOIN v_gray d ON d.frame = c.frame AND d.x = c.x AND d.y = c.y + 1)"
_gray = lambda s, d: view(s, d, "rgb").selectExpr("frame", "x", "y", "shiftright(77 * r + 150 * g + 29 * b + 128, 8) as v")
query("laplacian", duck("rgb") + LAP + " SELECT frame, x, y, l::BIGINT AS l FROM v_lap")(lambda s, d: cloud.laplacian(_gray(s, d)).select("frame", "x", "y", F.col("l").cast("long").alias("l")))
query("laplacian_var", duck("rgb") + LAP + " SELECT frame, round((sum(l * l)::DOUBLE - sum(l)::DOUBLE * sum(l) / count(*)) / count(*), 4) AS sharpness FROM v_lap GROUP BY frame")(lambda s, d: cloud.laplacian_var(_gray(s, d)).select("frame", F.round("sharpness", 4).alias("sharpness")))
query("thumb_box", duck("rgb") + LAP + " SELECT frame, ((x + 1) * 3 - 1) // 8 AS tx, ((y + 1) * 3 - 1) // 8 AS ty, (sum(v) // count(*))::BIGINT AS v FROM v_gray GROUP BY ALL")(lambda s, d: cloud.thumb_box(_gray(s, d), 8, 8, 3))
query("chunk_assign", duck("pose") + " SELECT frame // 8 AS chunk, min(frame) AS first_frame, count(*) AS n_frames FROM v_pose GROUP BY ALL")(lambda s, d: cloud.chunk_assign(view(s, d, "pose")))
QUANT = ", v_q AS (SELECT list_sort(list(conf))[CAST(floor((count(*) - 1) * {q}) AS BIGINT) + 1] AS threshold FROM {of} WHERE NOT isnan(conf))"
query("conf_quantile", duck("depth") + QUANT.format(q=0.3, of="v_depth") + " SELECT round(threshold, 6) AS threshold FROM v_q")(lambda s, d: cloud.conf_quantile(_depth(s, d), 0.3).select(*r6("threshold")))
UNP = "round(r0{0} * ((x - cx) / fx * depth - t0) + r1{0} * ((y - cy) / fy * depth - t1) + r2{0} * (depth - t2), 5) AS {1}"
WORLD = ", ".join(UNP.format(k, n) for k, n in enumerate(("wx", "wy", "wz")))
_cams = lambda s, d: cloud.cameras(view(s, d, "pose"))


def _world(rows):
    x, y, z = pose.unproject(F.col("x"), F.col("y"), F.col("depth"))
    return [x.alias("wx"), y.alias("wy"), z.alias("wz")]


def _rounded(df, keep, digits=5):
    return df.select(*keep, *[F.round(c, digits).alias(c) for c in df.columns if c not in keep])


query("unproject", duck("depth", "pose") + f", {DUCK_CAMS} SELECT frame, x, y, {WORLD} FROM v_depth JOIN v_cams USING (frame) WHERE {GOOD}")(lambda s, d: _rounded(cloud.finite_filter(_depth(s, d)).join(_cams(s, d), "frame").select("frame", "x", "y", *_world(None)), ("frame", "x", "y")))
query("camera_pixels", duck("depth", "pose") + f", {DUCK_CAMS} SELECT frame, x, y, round(fx, 6) AS fx FROM v_depth JOIN v_cams USING (frame)")(lambda s, d: _depth(s, d).join(_cams(s, d), "frame").select("frame", "x", "y", *r6("fx")))


@query("project", duck("depth", "pose") + f" SELECT frame, x, y, x::DOUBLE AS px, y::DOUBLE AS py, round(depth, 4) AS pz FROM v_depth WHERE {GOOD}")
def project(s, d):
    """Unprojecting and projecting again gives the pixel back."""
    cams = _cams(s, d)
    points = cloud.finite_filter(_depth(s, d)).join(cams, "frame").select("*", *_world(None))
    px, py, pz = pose.project(F.col("wx"), F.col("wy"), F.col("wz"))
    return points.select("frame", "x", "y", F.abs(F.round(px, 4)).alias("px"), F.abs(F.round(py, 4)).alias("py"), F.round(pz, 4).alias("pz"))


query("camera_center", duck("pose") + f", {DUCK_CAMS} SELECT frame, " + ", ".join(f"round(-(r0{k} * t0 + r1{k} * t1 + r2{k} * t2), 6) AS c{k}" for k in range(3)) + " FROM v_cams")(lambda s, d: _cams(s, d).select("frame", *[F.round(c, 6).alias(f"c{k}") for k, c in enumerate(pose.camera_center())]))
query("frusta_corners", duck("pose") + f", {DUCK_CAMS} , v_c AS (SELECT v_cams.*, k AS corner, CASE WHEN k IN (1, 2) THEN width ELSE 0 END AS x, CASE WHEN k >= 2 THEN height ELSE 0 END AS y, 0.15e0 AS depth FROM v_cams, range(4) AS r(k)), v_w AS (SELECT frame, corner, {WORLD} FROM v_c) SELECT frame, corner, wx AS x, round(-wy, 5) AS y, round(-wz, 5) AS z FROM v_w")(
    lambda s, d: _cams(s, d).select("frame", F.explode(pose.frusta_corners(F.col("width"), F.col("height"))).alias("p")).select("frame", F.col("p.corner").cast("long").alias("corner"), *[F.round(f"p.{c}", 5).alias(c) for c in "xyz"])
)
query("pixel_color", duck("depth", "rgb") + f" SELECT frame, x, y, r, g, b FROM v_depth JOIN v_rgb USING (frame, x, y) WHERE {GOOD}")(lambda s, d: cloud.finite_filter(_depth(s, d)).join(view(s, d, "rgb"), ["frame", "x", "y"]).select("frame", "x", "y", "r", "g", "b"))
BUILD = duck("depth", "rgb", "pose") + NEAR + EDGE + f", {DUCK_CAMS}, v_ok AS (SELECT d.* FROM v_depth d JOIN v_edge e USING (frame, x, y) WHERE keep AND {GOOD})"
OFF = BUILD + QUANT.format(q=0.2, of="v_depth")
query("build_cloud", BUILD + f" SELECT frame, x AS px, y AS py, {WORLD}, r, g, b FROM v_ok JOIN v_rgb USING (frame, x, y) JOIN v_cams USING (frame)")(lambda s, d: _rounded(cloud.build_cloud(_depth(s, d), view(s, d, "rgb"), view(s, d, "pose")).drop("conf"), ("frame", "px", "py", "r", "g", "b")))
query("build_cloud_offline", OFF + f" SELECT frame, x AS px, y AS py, {WORLD}, r, g, b, round(conf, 5) AS conf FROM v_ok JOIN v_rgb USING (frame, x, y) JOIN v_cams USING (frame), v_q WHERE NOT isnan(conf) AND conf >= threshold")(lambda s, d: _rounded(cloud.build_cloud(_depth(s, d), view(s, d, "rgb"), view(s, d, "pose"), "offline", 0.2), ("frame", "px", "py", "r", "g", "b")))
query("refilter_cloud", BUILD + QUANT.format(q=0.5, of="v_ok") + " SELECT frame, x AS px, y AS py FROM v_ok, v_q WHERE frame % 2 = 0 AND NOT isnan(conf) AND conf >= threshold")(lambda s, d: cloud.refilter_cloud(cloud.build_cloud(_depth(s, d), view(s, d, "rgb"), view(s, d, "pose")), 0.5).where("frame % 2 = 0").select("frame", "px", "py"))


@query("cloud_stats", BUILD + QUANT.format(q=0.5, of="v_ok") + " SELECT count(*) AS n_points, count(DISTINCT frame // 8) AS n_chunks, count(DISTINCT frame) AS n_cameras, count(*) FILTER (NOT isnan(conf) AND conf >= threshold) AS n_kept, round(count(*) FILTER (NOT isnan(conf) AND conf >= threshold) * 100.0e0 / count(*), 6) AS kept_pct FROM v_ok, v_q")
def cloud_stats(s, d):
    points = cloud.build_cloud(_depth(s, d), view(s, d, "rgb"), view(s, d, "pose"))
    return cloud.cloud_stats(points, cloud.refilter_cloud(points, 0.5)).withColumn("kept_pct", F.round("kept_pct", 6))


HALF = "round_even({0} * 1024 / power(2, floor(log2({0}))), 0) * power(2, floor(log2({0}))) / 1024"


@query("depth_chunk_decode", duck("depth") + f" SELECT frame, x, y, {HALF.format('depth')} AS depth, {HALF.format('conf')} AS conf FROM v_depth WHERE {GOOD} AND NOT isnan(conf)")
def depth_chunk_decode(s, d):
    """Pixels as chunks of half floats, which have eleven significant bits, and back."""
    back = readers.depth_chunk_decode(sinks.half_chunks(_depth(s, d).withColumn("session", F.lit("s")), 8, 8))
    return cloud.finite_filter(back, "offline").select("frame", "x", "y", "depth", "conf")


RAW = ", ".join(f"r0{k} * ((x - cx) / fx * depth - t0) + r1{k} * ((y - cy) / fy * depth - t1) + r2{k} * (depth - t2) AS w{k}" for k in range(3))
CAM = [f"(o.r{k}0 * w0 + o.r{k}1 * w1 + o.r{k}2 * w2 + o.t{k})" for k in range(3)]
VOTE = f""", v_p AS (SELECT frame, x, y, {RAW} FROM v_depth JOIN v_cams USING (frame) WHERE {GOOD}),
v_s AS (SELECT p.frame, p.x, p.y, o.frame AS other, round({CAM[0]} / {CAM[2]} * o.fx + o.cx) AS ox, round({CAM[1]} / {CAM[2]} * o.fy + o.cy) AS oy, {CAM[2]} AS expected FROM v_p p JOIN v_cams o ON o.frame IN (p.frame - 1, p.frame + 1)),
v_v AS (SELECT s.frame, s.x, s.y, count(*) AS votes FROM v_s s JOIN v_depth d ON d.frame = s.other AND d.x = s.ox AND d.y = s.oy WHERE abs(d.depth - expected) <= 0.05 * abs(expected) AND NOT isnan(d.depth) GROUP BY ALL)
SELECT frame, x, y, coalesce(votes, 0) AS votes FROM v_p LEFT JOIN v_v USING (frame, x, y)"""


@query("depth_consistency_vote", duck("depth", "pose") + f", {DUCK_CAMS}" + VOTE)
def depth_consistency_vote(s, d):
    """How many neighbouring frames see a pixel's depth."""
    cams = _cams(s, d)
    pixels = cloud.finite_filter(_depth(s, d)).join(cams, "frame").select("frame", "x", "y", *_world(None))
    return cloud.depth_consistency_vote(pixels, cams, _depth(s, d)).withColumn("votes", F.col("votes").cast("long"))


# --- colour tables
def _cube(s, d, key):
    """Lattices of five steps a channel as texts, one for each key of the parts: squares of the steps, scaled by the parts' mean size."""
    p = s.read.parquet(f"{d}/part.parquet").groupBy(key.alias("lut")).agg(F.round(F.avg("p_size") / 50, 3).alias("k"))
    step = lambda i, n: F.pow(F.floor(i / n) % 5 / 4, F.lit(2)) * F.col("k")
    cells = F.transform(F.sequence(F.lit(0), F.lit(124)), lambda i: F.concat_ws(" ", *[step(i, n).cast("string") for n in (1, 5, 25)]))
    head = F.array(F.lit("# table"), F.concat(F.lit("TITLE "), F.col("lut")), F.lit("LUT_3D_SIZE 5"), F.lit("DOMAIN_MIN 0 0 0"), F.concat_ws(" ", F.lit("DOMAIN_MAX"), *[F.col("k") * 2] * 3))
    return p.select("lut", F.array_join(F.concat(head, cells), "\n").alias("text"))


query("cube_lattice", "WITH p AS (SELECT p_brand AS lut, round(avg(p_size) / 50, 3) AS k FROM part GROUP BY p_brand) SELECT lut, r::BIGINT AS r, g::BIGINT AS g, b::BIGINT AS b, round(power(r / 4.0e0, 2) * k, 6) AS o_r, round(power(g / 4.0e0, 2) * k, 6) AS o_g, round(power(b / 4.0e0, 2) * k, 6) AS o_b, round(2 * k, 6) AS top FROM p, range(5) AS x(r), range(5) AS y(g), range(5) AS z(b)")(
    lambda s, d: readers.cube_lattice(_cube(s, d, F.col("p_brand"))).select("lut", *[F.col(c).cast("long").alias(c) for c in "rgb"], *r6("o_r", "o_g", "o_b"), F.round(F.get("dmax", F.lit(0)), 6).alias("top"))
)
CUBE = ", v_k AS (SELECT round(avg(p_size) / 50, 3) AS k FROM part)"
#: A channel from 0 to 255 through the lattice, whose domain ends at 2 * k: linear between the squares of five steps.
LUT1 = "(k * (power(floor({0}), 2) / 16 + ({0} - floor({0})) * (power(least(floor({0}) + 1, 4), 2) - power(floor({0}), 2)) / 16))"
STEPS = "(4 * least({0} / 255.0e0 / (k * 2), 1.0e0))"
_looked_up = lambda s, d, *more: frames.lut_apply(view(s, d, "rgb").selectExpr("frame", "x", "y", "r", "r / 255 as cr", "g / 255 as cg", "b / 255 as cb"), readers.cube_lattice(_cube(s, d, F.lit("all"))), ("frame", "x", "y", *more))
query("lut_apply", duck("rgb") + CUBE + " SELECT frame, x, y, " + ", ".join(f"round({LUT1.format(STEPS.format(c))}, 6) AS o_{c}" for c in "rgb") + " FROM v_rgb, v_k")(lambda s, d: _rounded(_looked_up(s, d), ("frame", "x", "y"), 6))
REC709 = SR.format(f"least(greatest({DLY.replace('value / 60', 'r / 255.0e0')}, 0.0e0), 1.0e0)")


@query("tonemap_apply", duck("rgb") + CUBE + f" SELECT frame, x, y, round(CASE frame % 4 WHEN 1 THEN {LUT1.format(STEPS.format('r'))} WHEN 2 THEN {REC709} ELSE r / 255.0e0 END, 6) AS v FROM v_rgb, v_k")
def tonemap_apply(s, d):
    """Photos (frame % 4 = 0), a colour table, the log curve and none, on the red channel."""
    rows = _looked_up(s, d, "r")
    kind = F.when(F.col("frame") % 4 == 1, "cube").when(F.col("frame") % 4 == 3, "none").otherwise("parametric")
    return rows.select("frame", "x", "y", F.round(frames.tonemap(F.col("r") / 255.0, kind, F.col("o_r"), F.col("frame") % 4 != 0), 6).alias("v"))


def _frame_rows(s, d):
    """Frames of 8 x 8 pixels as bytes."""
    px = view(s, d, "rgb").withColumn("v", F.concat(*[F.lpad(F.hex(c), 2, "0") for c in "rgb"]))
    rows = px.groupBy("frame").agg(F.sort_array(F.collect_list(F.struct("y", "x", "v"))).alias("p"))
    return rows.select(F.lit("s").alias("session"), "frame", F.lit(8).alias("width"), F.lit(8).alias("height"), F.unhex(F.array_join(F.transform("p", lambda p: p["v"]), "")).alias("rgb"))


query("score_frames", duck("rgb") + LAP + " SELECT frame, round((sum(l * l)::DOUBLE - sum(l)::DOUBLE * sum(l) / count(*)) / count(*), 4) AS sharpness FROM v_lap GROUP BY frame")(lambda s, d: frames.score_frames(_frame_rows(s, d)).select("frame", F.round("sharpness", 4).alias("sharpness")))


def _weights(name: str, n: int, out: int) -> str:
    """Lanczos weights of three lobes from n to out >= n samples as a table (o, i, w)."""
    x = f"(i + 0.5e0 - (o + 0.5e0) * {n} / {out})"
    sinc = lambda t: f"CASE WHEN {t} = 0 THEN 1 ELSE sin(pi() * {t}) / (pi() * {t}) END"
    return f"{name}_raw AS (SELECT o, i, CASE WHEN abs({x}) < 3 THEN ({sinc(x)}) * ({sinc(f'({x} / 3)')}) ELSE 0 END AS w FROM range({out}) AS a(o), range({n}) AS b(i)), {name} AS (SELECT o, i, w / sum(w) OVER (PARTITION BY o) AS w FROM {name}_raw)"


PREPARE = f""", v_t AS (SELECT frame, x, y, r, g, b AS blue, frame % 8 + 1 AS t FROM v_rgb), v_s AS (SELECT *, CASE WHEN t >= 5 THEN x ELSE y END AS a, CASE WHEN t >= 5 THEN y ELSE x END AS b FROM v_t),
v_u AS (SELECT frame, CASE WHEN t IN (3, 4, 7, 8) THEN 7 - a ELSE a END - 1 AS y, CASE WHEN t IN (2, 3, 6, 7) THEN 7 - b ELSE b END AS x, unnest([0, 1, 2]) AS c, unnest([r, g, b_]) AS r FROM (SELECT frame, x AS x0, y AS y0, t, a, b, r, g, blue AS b_ FROM v_s)),
v_in AS (SELECT frame, x, y, c, CASE WHEN frame % 2 = 0 THEN {REC709} ELSE r / 255.0e0 END AS p FROM v_u WHERE y BETWEEN 0 AND 5), {_weights("v_wx", 8, 16)}, {_weights("v_wy", 6, 12)},
v_row AS (SELECT frame, c, y, v_wx.o AS ox, sum(p * w) AS p FROM v_in JOIN v_wx ON v_wx.i = x GROUP BY ALL), v_out AS (SELECT frame, c, ox, v_wy.o AS oy, sum(p * w) AS p FROM v_row JOIN v_wy ON v_wy.i = y GROUP BY ALL)
SELECT 's' AS session, frame, sha256(unhex(string_agg(printf('%02x', floor(least(greatest(p * 255 + 0.5, 0), 255))::INT), '' ORDER BY oy, ox, c))) AS sha FROM v_out GROUP BY frame"""


@query("frame_prepare", duck("rgb") + PREPARE)
def frame_prepare(s, d):
    crop = {"crop_x": 0, "crop_y": 1, "crop_w": 8, "crop_h": 6, "target_w": 16, "target_h": 12}
    return frames.prepare_frames(_frame_rows(s, d).withColumns({k: F.lit(v) for k, v in crop.items()}).withColumn("orientation", (F.col("frame") % 8 + 1).cast("int")).withColumn("parametric", F.col("frame") % 2 == 0)).select("session", "frame", F.sha2("rgb", 256).alias("sha"))


# --- alignment
def _pairs(s, d):
    """Correspondences: points of the embeddings, and the same moved by a known transform, with every ninth one off."""
    e = s.read.parquet(f"{d}/embeddings.parquet").select(F.concat(F.lit("s"), F.col("label")).alias("session"), F.col("vec_id").alias("frame"), *[(F.get("embedding", F.lit(k)).cast("double") * 50).alias(c) for k, c in enumerate("xyz")])
    off = F.when(F.col("frame") % 9 == 0, 40.0).otherwise(0.0)
    return e.select("*", (-2.0 * F.col("y") + 10 + off).alias("e"), (2.0 * F.col("x") - 5).alias("n"), (2.0 * F.col("z") + 3 - off).alias("u"))


query("umeyama", "SELECT 's' || label AS session, 0::BIGINT AS h, 2.0e0 AS s, 10.0e0 AS v0, -5.0e0 AS v1, 3.0e0 AS v2 FROM embeddings WHERE vec_id % 9 <> 0 GROUP BY label")(lambda s, d: align.umeyama(_pairs(s, d).where("frame % 9 <> 0").withColumn("h", F.lit(0).cast("long"))).select("session", "h", *[F.round(c, 4).alias(c) for c in ("s", "v0", "v1", "v2")]))
query("ransac_sim3", "SELECT 's' || label AS session, 2.0e0 AS s, 10.0e0 AS v0, count(*) FILTER (vec_id % 9 <> 0) AS n_in FROM embeddings GROUP BY label")(lambda s, d: align.ransac(_pairs(s, d)).select("session", *[F.round(c, 4).alias(c) for c in ("s", "v0")], "n_in"))


def _known(s, d):
    names = ["s", "m00", "m01", "m02", "m10", "m11", "m12", "m20", "m21", "m22", "v0", "v1", "v2"]
    values = [2.0, 0.0, -1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 10.0, -5.0, 3.0]
    return _pairs(s, d).select("session").distinct().select("session", F.lit(0).cast("long").alias("h"), *[F.lit(v).alias(n) for n, v in zip(names, values, strict=True)])


query("ransac_cross", "SELECT vec_id AS frame, round(CASE WHEN vec_id % 9 = 0 THEN sqrt(3200.0e0) ELSE 0 END, 4) AS res FROM embeddings")(lambda s, d: align.residuals(_pairs(s, d), _known(s, d)).select("frame", F.round("res", 4).alias("res")))
query("ransac_inliers", "SELECT 's' || label AS session, 0::BIGINT AS h, count(*) FILTER (vec_id % 9 <> 0) AS n_in, count(*) AS n, round(count(*) FILTER (vec_id % 9 <> 0) / count(*)::DOUBLE, 6) AS ratio FROM embeddings GROUP BY label")(lambda s, d: align.inliers(align.residuals(_pairs(s, d), _known(s, d)), F.lit(2.0)).select("session", "h", "n_in", "n", *r6("ratio")))
query("apply_sim3", "SELECT vec_id AS frame, round(-2.0e0 * embedding[2]::DOUBLE * 50 + 10, 4) AS wx, round(2.0e0 * embedding[1]::DOUBLE * 50 - 5, 4) AS wy, round(2.0e0 * embedding[3]::DOUBLE * 50 + 3, 4) AS wz FROM embeddings")(lambda s, d: _rounded(align.apply_to_points(_pairs(s, d).selectExpr("session", "frame", "x wx", "y wy", "z wz"), _known(s, d)).drop("session"), ("frame",), 4))
query("known_distance_scale", "SELECT vec_id AS session, round(12.5e0 / (50 * sqrt(power(embedding[1]::DOUBLE - embedding[4], 2) + power(embedding[2]::DOUBLE - embedding[5], 2) + power(embedding[3]::DOUBLE - embedding[6], 2))), 6) AS scale FROM embeddings")(
    lambda s, d: align.known_distance_scale(s.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("session"), *[(F.get("embedding", F.lit(k)).cast("double") * 50).alias(n) for k, n in enumerate(("ax", "ay", "az", "bx", "by", "bz"))]), F.lit(12.5)).select("session", *r6("scale"))
)
query("enu", duck("candidates") + """, v_o AS (SELECT video, arg_min(lat, ci) AS lat0, arg_min(lon, ci) AS lon0, arg_min(rel_alt, ci) AS alt0 FROM v_candidates WHERE lat IS NOT NULL GROUP BY video)
SELECT video AS session, ci AS frame, round(radians(lon - lon0) * 6371000.0e0 * cos(radians(lat0)), 4) AS e, round(radians(lat - lat0) * 6371000.0e0, 4) AS n, round(rel_alt - alt0, 4) AS u FROM v_candidates JOIN v_o USING (video) WHERE lat IS NOT NULL""")(
    lambda s, d: align.local_positions(view(s, d, "candidates").selectExpr("video as session", "ci as frame", "lat", "lon", "rel_alt")).select("session", "frame", *[F.round(c, 4).alias(c) for c in "enu"])
)
_SIDECAR = {"fx": "$.intrinsics.fx", "fy": "$.intrinsics.fy", "cx": "$.intrinsics.cx", "cy": "$.intrinsics.cy", **{f"r{i}{j}": f"$.extrinsic.r[{i}][{j}]" for i in range(3) for j in range(3)}, **{f"t{k}": f"$.extrinsic.t[{k}]" for k in range(3)}, **{f"c{k}": f"$.center[{k}]" for k in range(3)}}
query("camera_sidecar", duck("pose") + f", {DUCK_CAMS} SELECT frame, " + ", ".join(f"round({n}, 6) AS {n}" for n in _SIDECAR if n[0] != "c" or n in ("cx", "cy")) + ", " + ", ".join(f"round(-(r0{k} * t0 + r1{k} * t1 + r2{k} * t2), 6) AS c{k}" for k in range(3)) + " FROM v_cams")(
    lambda s, d: sinks.camera_documents(_cams(s, d)).select("frame", *[F.round(F.get_json_object("json", at).cast("double"), 6).alias(n) for n, at in _SIDECAR.items()])
)
