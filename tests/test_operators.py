"""Operators on literal cases and invariants."""

import json
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cloudframes.fixtures import view
from cloudframes.functions import color, geo, pose, sizing, text
from cloudframes.operators import align, catalog, cloud, frames, keyframes, telemetry, tensors
from cloudframes.plans import selection as plan
from cloudframes.queries import QUERIES
from cloudframes.sources import readers, sinks
from cloudframes.streaming import sessions as st


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_sizes(spark):
    for (w, h), want in {(960, 540): (688, 384), (600, 400): (624, 416), (100, 900): (368, 720)}.items():
        cw, ch = sizing.clamp_aspect(F.lit(w), F.lit(h))
        tw, th = sizing.target_size(F.lit(w), F.lit(h))
        r = one(spark, tw.alias("tw"), th.alias("th"), cw.alias("cw"), ch.alias("ch"))
        assert r.tw % 16 == 0 and r.th % 16 == 0 and 0.45 <= r.th / r.tw <= 2.2
        if (w, h) != (100, 900):
            assert (r.tw, r.th) == want


def test_crops(spark):
    for (w, h), want in {(960, 540): [75, 0, 810, 540], (600, 800): [0, 200, 600, 400]}.items():
        c = sizing.centered_crop(F.lit(w), F.lit(h), F.lit(624), F.lit(416), F.lit(1.0))
        assert list(one(spark, *[v.alias(k) for k, v in c.items()])) == want


def test_steps(spark):
    got = [one(spark, sizing.candidate_step(F.lit(f)).alias("s")).s for f in (29.97, 30.0, 25.0, 24.0, 60.0, 2.0, 0.5)]
    assert got == [15, 15, 13, 12, 30, 1, 1]


def test_text(spark):
    f = lambda c: one(spark, c.alias("x")).x
    assert f(text.srt_timestamp(F.lit("00:00:22,254"))) == 22254 and f(text.srt_timestamp(F.lit("01:00:00.5"))) == 3600005 and f(text.srt_timestamp(F.lit("1:2:3:4,5"))) is None
    assert f(text.strip_tags(F.lit("a<b>c</b> > d <open"))) == "ac  d "
    assert f(text.exif_datetime(F.lit("2025:06:23 08:25:01"))) == "2025-06-23T08:25:01" and f(text.exif_datetime(F.lit("2025"))) is None
    assert f(text.timestamp_secs(F.lit("2025-02-30T00:00:10"))) == f(text.timestamp_secs(F.lit("2025-03-02T00:00:10"))) and f(text.timestamp_secs(F.lit("2025-13-01T00:00:00"))) is None
    assert f(text.timecode(F.lit(3725.5))) == "01:02:05.50" and f(text.mmss(F.lit(65.0))) == "01:05"
    assert f(sizing.ratio_label(F.lit(1920), F.lit(1080))) == "16:9" and f(sizing.ratio_label(F.lit(1000), F.lit(100))) == "1000×100"


def test_curve(spark):
    v = [one(spark, color.dlog_decode(F.lit(y)).alias("v")).v for y in (0.0929, 0.584555)]
    assert abs(v[0]) < 1e-9 and abs(v[1] - 1) < 1e-6
    assert one(spark, geo.wrap180(F.lit(-190.0)).alias("a"), geo.wrap180(F.lit(180.0)).alias("b")) == (170.0, 180.0)


SRT = '1\r\n00:00:00,000 --> 00:00:00,040\r\n<font size="28">[iso : 100] [shutter : 1/640.0] [fnum : 540] [latitude: 61.498611] [longtitude: 23.760556] [rel_alt: 30.700 abs_alt: 142.986] [gb_yaw : -12.3 gb_pitch : -89.9] [color_md : d_log]</font>\r\n\r\nrubbish\r\n\r\n2\r\n00:00:00.040 --> 00:00:00.080\r\nGPS(23.760556,61.498611,19) BAROMETER:30.1\r\n\r\n3\r\n00:00:00,080 --> 00:00:00,120\r\n[latitude: 0.0] [longitude: 0.0]'


def test_srt(spark):
    got = readers.srt_parse(spark.createDataFrame([("a", SRT), ("b", "")], "path string, text string")).orderBy("seq").collect()
    a, b, c = got
    assert (a.start_ms, a.end_ms, a.lat, a.lon, a.rel_alt, a.abs_alt, a.yaw, a.pitch, a.iso, a.shutter, a.fnum, a.color_md) == (0, 40, 61.498611, 23.760556, 30.7, 142.986, -12.3, -89.9, 100, "1/640.0", 5.4, "d_log")
    assert (b.start_ms, b.lat, b.lon, b.rel_alt) == (40, 61.498611, 23.760556, 30.1) and c.lat is None
    assert [r.path for r in readers.srt_errors(spark.createDataFrame([("a", SRT), ("b", "")], "path string, text string")).collect()] == ["b"]


def test_gps_order(spark):
    lat, lon = text.gps_paren(F.lit("GPS(37.795,-122.397,19)"))
    assert tuple(one(spark, lat.alias("a"), lon.alias("b"))) == (37.795, -122.397)


def test_probe(spark):
    good = {"streams": [{"index": 0, "codec_type": "video", "width": 2688, "height": 1512, "avg_frame_rate": "30000/1001", "nb_frames": "8991", "color_range": "tv", "color_transfer": "bt709"}, {"index": 2, "codec_type": "subtitle"}], "format": {"duration": "299.966333"}}
    docs = [("a", json.dumps(good)), ("b", "junk"), ("c", "{}"), ("d", json.dumps({"streams": [{"codec_type": "video", "width": 0, "height": 5}]})), ("e", json.dumps({"streams": [{"codec_type": "video", "width": 5, "height": 5, "avg_frame_rate": "0/0"}]}))]
    got = {r.path: r for r in readers.probe_json(spark.createDataFrame(docs, "path string, json string")).collect()}
    assert (got["a"].width, round(got["a"].fps, 5), got["a"].n_frames, got["a"].duration_s, got["a"].subtitle_stream, got["a"].error) == (2688, 29.97003, 8991, 299.966333, 2, None)
    assert all(got[k].error and got[k].fps is None for k in "bcde")


def test_cube(spark):
    ident = "TITLE x\nLUT_3D_SIZE 2\n" + "\n".join(f"{r} {g} {b}" for b in (0, 1) for g in (0, 1) for r in (0, 1))
    bad = [("one", "LUT_1D_SIZE 2"), ("none", "0 0 0"), ("short", "LUT_3D_SIZE 2\n0 0 0"), ("flat", ident + "\nDOMAIN_MAX 0 1 1"), ("word", ident.replace("1 1 1", "1 1 x1"))]
    got = readers.cube_lattice(spark.createDataFrame([("ok", ident), *bad], "lut string, text string")).cache()
    assert got.where("lut = 'ok' and error is null and o_r = r and o_g = g and o_b = b").count() == 8
    assert {r.lut for r in got.where("error is not null").collect()} == {n for n, _ in bad}
    colors = spark.createDataFrame([(1, 0.25, 0.75, 0.5), (2, -1.0, 2.0, 0.0)], "id int, cr double, cg double, cb double")
    out = {r.id: [round(x, 9) for x in (r.o_r, r.o_g, r.o_b)] for r in frames.lut_apply(colors, got.where("lut = 'ok'")).collect()}
    assert out == {1: [0.25, 0.75, 0.5], 2: [0.0, 1.0, 0.0]}
    table = np.stack(np.meshgrid([0, 1], [0, 1], [0, 1], indexing="ij")[::-1], -1)
    assert np.allclose(frames.lut_numpy(np.array([[0.25, 0.75, 0.5]]), table), [[0.25, 0.75, 0.5]])


def test_catalog(spark):
    rows = [("/a/x.JPG",), ("/a/x.dng",), ("/a/y.jpg",), ("/a/.z.jpg",), ("/.h/q.mp4",), ("/b/c.MOV",), ("/b/t.txt",), ("/a/y.jpg",)]
    m = catalog.classify(spark.createDataFrame(rows, "path string"))
    assert {r.path for r in m.collect()} == {"/a/x.JPG", "/a/x.dng", "/a/y.jpg", "/b/c.MOV"}
    assert {r.path for r in catalog.drop_paired(m).collect()} == {"/a/x.dng", "/a/y.jpg", "/b/c.MOV"}
    total = catalog.dir_rollup(m).where("is_total = 1").first()
    assert (total.n_clips, total.n_photos, total.n_raw, total.n_dirs) == (1, 3, 1, 2)


def test_media_scan(spark, tmp_path):
    for n in ("a.mp4", "b.JPG", ".c.jpg", "d.txt"):
        (tmp_path / n).write_bytes(b"x")
    assert {r.stem for r in readers.media_scan(spark, str(tmp_path)).collect()} == {"a", "b"}


def brute_asof(t, entries, slack):
    prev = max((e for e in entries if e[1] <= t), key=lambda e: (e[1], e[0]), default=None)
    after = min((e for e in entries if e[1] > t), key=lambda e: (e[1], e[0]), default=None)
    if prev and t < prev[2]:
        return prev[0]
    a, b = (t - prev[2] if prev else math.inf), (after[1] - t if after else math.inf)
    return None if min(a, b) > slack else prev[0] if a <= b else after[0]


def test_asof(spark):
    rng = np.random.default_rng(1)
    entries = [(v, s, int(a), int(a + rng.integers(0, 400))) for v in range(4) for s, a in enumerate(np.sort(rng.integers(0, 20_000, 30)))]
    probes = [(v, p, int(t)) for v in range(4) for p, t in enumerate(rng.integers(-1000, 22_000, 100))]
    e = spark.createDataFrame([(*x, 1.0, 2.0, 3.0, 4.0) for x in entries], "video int, seq int, start_ms long, end_ms long, lat double, lon double, rel_alt double, yaw double")
    got = {(r.video, r.probe): r.seq for r in telemetry.asof(spark.createDataFrame(probes, "video int, probe long, t_ms long"), e).collect()}
    assert got == {(v, p): brute_asof(t, [x[1:] for x in entries if x[0] == v], 500) for v, p, t in probes}


def walk(spark, rows):
    df = spark.createDataFrame([(0, i, *r) for i, r in enumerate(rows)], "video int, ci int, sharpness double, lat double, lon double, yaw double, px array<int>")
    return sorted(r.ci for r in keyframes.prune_redundant(keyframes.sharpest_per_window(df)).collect())


def test_pruning(spark):
    sharp = lambda i: float(i % 4 == 3)
    assert walk(spark, [(sharp(i), 60.0, 25.0, 0.0, [0]) for i in range(12)]) == [3, 11]
    assert walk(spark, [(sharp(i), 60.0, 25.0, 10.0 * i, [0]) for i in range(12)]) == [3, 7, 11]
    assert walk(spark, [(sharp(i), 60 + 3e-5 * i, 25.0, 0.0, [0]) for i in range(12)]) == [3, 7, 11]
    assert walk(spark, [(sharp(i), None, None, None, [9]) for i in range(12)]) == [3, 11]
    assert walk(spark, [(sharp(i), None, None, None, [9 * i]) for i in range(12)]) == [3, 7, 11]
    ties = spark.createDataFrame([(0, i, float(s)) for i, s in enumerate((1, 5, 3, 2, 7, 7, 1, 0))], "video int, ci int, sharpness double")
    assert sorted(r.ci for r in keyframes.sharpest_per_window(ties).collect()) == [1, 4]


def test_pruning_carries_over_batches(spark):
    """One long video among short ones, in Arrow batches of seven rows, equals a walk over each."""
    rng = np.random.default_rng(2)
    rows = []
    for v, n in enumerate([400, 1, 2, 30, 7, 14]):
        lat = 60 + np.cumsum(rng.choice([0, 2e-6, 6e-6], n))
        rows += [(v, k, *((None, None) if rng.random() < 0.2 else (float(lat[k]), 25.0)), float(rng.choice([0, 3, 355])), None if rng.random() < 0.2 else [int(x) for x in rng.integers(0, 12, 4)]) for k in range(n)]
    want = set()
    for v in range(6):
        own = sorted(r for r in rows if r[0] == v)
        kept = None
        for r in own:
            if kept is None or keyframes.differs(kept[2:], r[2:]):
                want.add(r[:2])
                kept = r
        want.add(own[-1][:2])
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = keyframes.prune_redundant(spark.createDataFrame(rows, "video long, ci int, lat double, lon double, yaw double, px array<int>").repartition(4)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert keyframes.prune_redundant(spark.createDataFrame([], "video long, ci int, lat double, lon double, yaw double")).count() == 0


def brute_decimate(n, b):
    if n <= b:
        return list(range(n))
    if b <= 1:
        return [0][:b]
    return sorted({math.floor(k * (n - 1) / (b - 1) + 0.5) for k in range(b)})


def test_decimation(spark):
    rows = [(n * 100 + b, i, b) for n in range(1, 40, 3) for b in range(12) for i in range(n)]
    out = {}
    for r in keyframes.decimate(spark.createDataFrame(rows, "video int, ci int, budget int"), F.col("budget")).collect():
        out.setdefault(r.video, []).append(r.ci)
    for n in range(1, 40, 3):
        for b in range(12):
            assert sorted(out.get(n * 100 + b, [])) == brute_decimate(n, b), (n, b)


@pytest.mark.parametrize(("counts", "total", "want"), [([30, 10], 20, [15, 5]), ([30, 1], 20, [19, 1]), ([5, 5, 5], 4, [2, 1, 1]), ([0, 8], 10, [0, 8]), ([3, 4], 100, [3, 4]), ([], 5, []), ([4], 0, [0])])
def test_budget(spark, counts, total, want):
    df = spark.createDataFrame([("s", k, n, total) for k, n in enumerate(counts)], "session string, video int, n long, total int")
    assert [r.share for r in keyframes.split_budget(df).orderBy("video").collect()] == want


def brute_budget(counts, total):
    """Step by step: remainders, floors of two, and one less of the largest as long as there are too many."""
    n = sum(counts)
    if not n or total <= 0:
        return [0] * len(counts)
    quota = [float(total) * c / n for c in counts]
    share = [min(math.floor(x), c) for x, c in zip(quota, counts, strict=True)]
    left = total - sum(share)
    for k in sorted(range(len(counts)), key=lambda k: (-(quota[k] - math.floor(quota[k])), k)) * 3:
        if left > 0 and share[k] < counts[k]:
            share[k], left = share[k] + 1, left - 1
    share = [max(x, min(2, c)) for x, c in zip(share, counts, strict=True)]
    while sum(share) > total:
        top = max(range(len(share)), key=lambda k: (share[k], k))
        share[top] -= 1
    return share


def test_budgets_step_by_step(spark):
    rng = np.random.default_rng(3)
    cases = [(rng.integers(0, 30, rng.integers(1, 12)).tolist(), int(rng.integers(0, 60))) for _ in range(300)]
    df = spark.createDataFrame([(i, k, n, total) for i, (counts, total) in enumerate(cases) for k, n in enumerate(counts)], "session int, video int, n long, total int")
    got = {}
    for r in keyframes.split_budget(df).orderBy("session", "video").collect():
        got.setdefault(r.session, []).append(r.share)
    assert got == {i: brute_budget(*c) for i, c in enumerate(cases)}


def test_bursts(spark):
    rows = [("s", f"p{i}", None if t is None else f"2025-01-01T00:{t // 60:02d}:{t % 60:02d}", float(x)) for i, (t, x) in enumerate([(100, 5), (101, 9), (102, 1), (200, 3), (None, 2)])]
    assert {r.path for r in keyframes.burst_dedup(spark.createDataFrame(rows, "session string, path string, capture_time string, sharpness double")).collect()} == {"p1", "p3", "p4"}


def session(spark):
    """One video of 8 candidates, highest at 4, and two photos."""
    c = spark.createDataFrame([("s", "v", i, i * 15, 10.0 - abs(i - 4)) for i in range(8)], "session string, video string, ci int, source_frame int, rel_alt double")
    return c, plan.auto_select(c, spark.createDataFrame([("s", "a.jpg"), ("s", "b.jpg")], "session string, path string"), 30)


def test_auto_select(spark):
    _, sel = session(spark)
    rows = sel.orderBy("pos").collect()
    assert [r.kind for r in rows] == ["video"] * 8 + ["photo"] * 2 and [r.ci for r in rows if r.is_reference] == [4]
    ordered = keyframes.batch_order(sel).orderBy("batch_index").collect()
    assert ordered[0].ci == 4 and [r.pos for r in ordered[1:]] == [0, 1, 2, 3, 5, 6, 7, 8, 9]


def test_edits(spark):
    c, sel = session(spark)
    auto = sel.where("kind = 'video'").select("session", "ci", "is_reference")

    def after(*edits):
        df = spark.createDataFrame([("s", k, *e) for k, e in enumerate(edits)], "session string, seq long, op string, ci int, value double")
        return {r.ci: (r.crop_scale, r.is_reference) for r in plan.apply_edits(auto, df, c.select("session", "ci", "rel_alt")).collect()}

    out = after(("exclude", 4, None))
    assert 4 not in out and [k for k, v in out.items() if v[1]] in ([3], [5])
    back = after(("exclude", 4, None), ("include", 4, None))
    assert 4 in back and not back[4][1]
    assert after(("crop", 2, 0.1))[2][0] == 0.3 and after(("crop", 2, 0.1), ("reselect", None, None))[2][0] == 1.0
    assert after(("exclude", 4, None), ("reselect", None, None))[4][1]


def test_quantile(spark):
    q = lambda values, p: cloud.conf_quantile(spark.createDataFrame([(v,) for v in values], "conf double"), p).first().threshold
    values = [float(i) for i in range(1, 101)] + [float("nan"), float("inf")]
    assert q(values, 0) == 1 and q(values, 1) == 100 and q(values, 0.5) == 50 and q([float(i) for i in range(10)], 0.31) == 2
    wide = [-1e308, 1e308, 0.0, 5e-324, -3.0] + [1.0 + k * 2.0**-52 for k in range(300)] + [1e300] * 3
    assert all(q(wide, p) == sorted(wide)[int((len(wide) - 1) * p)] for p in (0.0, 0.01, 0.3, 0.999, 1.0))
    assert q([], 0.5) == float("-inf") and q([float("nan")], 0.5) == float("-inf") and q([2.0] * 5, 0.9) == 2


def test_edges(spark):
    step = [(0, x, y, 1.0 if x < 3 else 2.0) for x in range(6) for y in range(6)] + [(1, x, y, 1.01**x) for x in range(6) for y in range(6)]
    got = cloud.depth_edge_mask(spark.createDataFrame(step, "frame long, x long, y long, depth double"))
    assert {r.x for r in got.where("frame = 0 and not edge_keep").collect()} == {2, 3} and got.where("frame = 1 and not edge_keep").count() == 0


def test_reprojection(spark):
    enc = [[0.4, -0.2, 1.5, 0.11, -0.32, 0.05, 0.92, 0.8, 1.1], [0, 0, 0, 0, 0, 0, 0, 1, 1], [1, 2, 3, 0, 0, 2, 2, 1, 1]]
    cams = cloud.cameras(spark.createDataFrame([(i, 640, 480, [float(x) for x in e]) for i, e in enumerate(enc)], "frame long, width int, height int, enc array<float>"))
    x, y, z = pose.unproject(F.lit(123.0), F.lit(45.0), F.lit(2.5))
    px, py, d = pose.project(F.col("x"), F.col("y"), F.col("z"))
    for r in cams.withColumns({"x": x, "y": y, "z": z}).select(px.alias("px"), py.alias("py"), d.alias("d")).collect():
        assert abs(r.px - 123) < 1e-3 and abs(r.py - 45) < 1e-3 and abs(r.d - 2.5) < 1e-5


def test_similarity(spark):
    rng = np.random.default_rng(0)
    src = rng.normal(size=(40, 3))
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    dst = 3.5 * src @ q.T + [10, -4, 2]
    s, rot, v = align.similarity(src, dst)
    assert abs(s - 3.5) < 1e-9 and np.allclose(rot, q) and np.allclose(v, [10, -4, 2])
    dst[::5] += 50
    rows = [("s", i, *map(float, src[i]), *map(float, dst[i])) for i in range(40)]
    got = align.ransac(spark.createDataFrame(rows, "session string, frame long, x double, y double, z double, e double, n double, u double"), 24).first()
    assert abs(got.s - 3.5) < 1e-6 and got.n_in == 32 and not got.few


def test_moved_scene_keeps_its_pixels(spark):
    cams = cloud.cameras(spark.createDataFrame([(0, 640, 480, [0.4, -0.2, 1.5, 0.11, -0.32, 0.05, 0.92, 0.8, 1.1])], "frame long, width int, height int, enc array<double>")).withColumn("session", F.lit("s"))
    rot = [[0.0, -1.0, 0.0], [1.0, 0.0, 0.0], [0.0, 0.0, 1.0]]
    t = spark.createDataFrame([("s", 0, 2.0, *[x for r in rot for x in r], 1.0, 2.0, 3.0)], align.SIM3)
    x, y, z = pose.unproject(F.lit(100.0), F.lit(50.0), F.lit(2.0))
    pts = cams.select("session", "frame", x.alias("wx"), y.alias("wy"), z.alias("wz"))
    px, py, d = pose.project(F.col("wx"), F.col("wy"), F.col("wz"))
    r = align.apply_to_cameras(cams, t).join(align.apply_to_points(pts, t), ["session", "frame"]).select(px.alias("px"), py.alias("py"), d.alias("d")).first()
    assert abs(r.px - 100) < 1e-6 and abs(r.py - 50) < 1e-6 and abs(r.d - 4) < 1e-6


def test_tensors(spark):
    v = [1.0, -2.0, 3.0, 0.5]
    rows = [("same", x, x) for x in v] + [("double", 2 * x, x) for x in v] + [("minus", -x, x) for x in v] + [("nan", float("nan"), x) for x in v]
    m = tensors.metrics(spark.createDataFrame(rows, "name string, ours double, ref double"))
    got = {r.name: r for r in m.collect()}
    assert got["same"].max_abs == 0 and abs(got["same"].cosine - 1) < 1e-12 and got["double"].max_abs == 3 and abs(got["minus"].cosine + 1) < 1e-12
    assert {r.name for r in tensors.gate(m, "tight").where("passed").collect()} == {"same"}


def test_frame_kernels(spark):
    flat, checker = np.full((32, 32), 100, np.uint8), (np.indices((32, 32)).sum(0) % 2 * 255).astype(np.uint8)
    ramp = np.tile(np.arange(32, dtype=np.uint8), (32, 1))
    assert frames.sharpness(flat) == 0 and frames.sharpness(checker) > frames.sharpness(ramp) and frames.sharpness(ramp) < 1 and frames.sharpness(flat[:2]) == 0
    img = (np.arange(64 * 32) % 256).astype(np.uint8).reshape(32, 64)
    assert frames.box_thumb(img, 16).shape == (8, 16)
    px = [(0, x, y, int(img[y, x])) for y in range(32) for x in range(64)]
    got = {(r.tx, r.ty): r.v for r in cloud.thumb_box(spark.createDataFrame(px, "frame long, x long, y long, v long"), 64, 32, 16).collect()}
    assert all(got[x, y] == frames.box_thumb(img, 16)[y, x] for x in range(16) for y in range(8))
    sharp = cloud.laplacian_var(spark.createDataFrame(px, "frame long, x long, y long, v long")).first().sharpness
    assert abs(sharp - frames.sharpness(img)) < 1e-6
    a = np.arange(6).reshape(2, 3)
    assert [frames.oriented(a, o)[0, 0] for o in range(1, 9)] == [0, 2, 5, 3, 0, 3, 5, 2]
    assert np.allclose(frames.resample(np.full((9, 7, 3), 0.4), 16, 5), 0.4)


POINT = "x double, y double, z double, r int, g int, b int, conf double, frame long"


def test_ply(spark, tmp_path):
    rows = [(float(i), 2.0, 3.0, 10, 20, 30, 0.5, i) for i in range(7)]
    sinks.write_ply(spark.createDataFrame(rows, POINT).coalesce(1), str(tmp_path / "out"), 3)
    manifest = json.loads((tmp_path / "out" / "_manifest.json").read_text())
    data = np.concatenate([sinks.read_ply((tmp_path / "out" / m["file"]).read_bytes()) for m in manifest])
    assert [m["vertices"] for m in manifest] == [3, 3, 1] and sinks.RECORD.itemsize == 21 and sorted(data["x"].tolist()) == [float(i) for i in range(7)]
    sinks.write_ply(spark.createDataFrame([], POINT), str(tmp_path / "none"))
    assert json.loads((tmp_path / "none" / "_manifest.json").read_text()) == [] and sinks.read_ply_files(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("wrong", [{"frame": 65_536}, {"frame": -1}, {"r": 256}, {"g": -2}, {"b": None}])
def test_point_values_that_do_not_fit_are_errors(spark, tmp_path, wrong):
    row = {"x": 1.0, "y": 2.0, "z": 3.0, "r": 255, "g": 0, "b": 1, "conf": 0.5, "frame": 65_535} | wrong
    names = [c.split()[0] for c in POINT.split(", ")]
    batch = pa.RecordBatch.from_pydict({c: [row[c]] for c in names})
    with pytest.raises(ValueError, match=next(iter(wrong))):
        sinks.ply_records(batch, sinks.RECORD)


def test_wide_frames(spark, tmp_path):
    rows = [(1.0, None, 3.0, 1, 2, 3, 0.5, f) for f in (0, 65_535, 70_000, 4_000_000_000)]
    sinks.write_ply(spark.createDataFrame(rows, POINT), str(tmp_path / "wide"), wide_frames=True)
    back = sinks.read_ply_files(spark, str(tmp_path / "wide")).collect()
    assert sorted(r.frame for r in back) == [0, 65_535, 70_000, 4_000_000_000] and all(r.y != r.y and (r.r, r.g, r.b) == (1, 2, 3) for r in back)
    with pytest.raises(Exception, match="wide_frames"):
        sinks.write_ply(spark.createDataFrame(rows, POINT), str(tmp_path / "narrow"))


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_colour_tables(spark):
    lattice = readers.cube_lattice(spark.createDataFrame([("t", "LUT_3D_SIZE 2\n" + "\n".join(f"{r} {g * 0.5} {b * b}" for b in (0, 1) for g in (0, 1) for r in (0, 1)))], "lut string, text string"))
    rows = [(1, "keep", 0.25, 0.5, 1.0), (2, None, -3.0, 9.0, 0.5), (3, "null", None, 0.5, 0.5), (4, "nan", float("nan"), 0.5, 0.5)]
    out = frames.lut_apply(spark.createDataFrame(rows, "id int, note string, cr double, cg double, cb double"), lattice, ("id", "note"))
    got = {r.id: tuple(r)[1:] for r in out.collect()}
    assert got[1] == ("keep", 0.25, 0.25, 1.0) and got[2] == (None, 0.0, 0.5, 0.5) and got[3] == ("null", None, None, None) and got[4] == ("nan", None, None, None)
    assert "Exchange" not in plan_of(out)
    with pytest.raises(ValueError, match="8 cells, not 7"):
        frames.lut_apply(out.withColumnsRenamed({"o_r": "cr", "o_g": "cg", "o_b": "cb"}), lattice.where("not (r = 1 and g = 1 and b = 0)"))
    assert frames.lut_apply(spark.createDataFrame(rows, "id int, note string, cr double, cg double, cb double"), lattice.where("false")).count() == 0


def test_transforms_from_sums(spark):
    """Groups of many points in several partitions, far from the origin; nulls and NaN don't count, and no group passes to Python."""
    rng = np.random.default_rng(4)
    src = rng.normal(size=(3000, 3)) * 20 + [4000.0, -9000.0, 300.0]
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    dst = 0.7 * src @ q.T + [10, -4, 2] + rng.normal(size=src.shape) * 0.01
    rows = [("a" if k % 3 else "b", k % 2, *map(float, src[k]), *map(float, dst[k])) for k in range(3000)] + [("a", 0, None, 1.0, 1.0, 1.0, 1.0, 1.0), ("a", 0, float("nan"), 1.0, 1.0, 1.0, 1.0, 1.0), ("none", 0, None, 1.0, 1.0, 1.0, 1.0, 1.0)]
    out = align.umeyama(spark.createDataFrame(rows, "session string, h long, x double, y double, z double, e double, n double, u double").repartition(5))
    assert "FlatMapGroups" not in plan_of(out)
    got = {(r.session, r.h): r for r in out.collect()}
    assert len(got) == 4
    for (s, h), r in got.items():
        at = np.array([k for k in range(3000) if (("a" if k % 3 else "b"), k % 2) == (s, h)])
        scale, rot, v = align.similarity(src[at], dst[at])
        assert abs(r.s - scale) < 1e-7 and np.allclose([[r[f"m{i}{j}"] for j in range(3)] for i in range(3)], rot, atol=1e-7) and np.allclose([r.v0, r.v1, r.v2], v, atol=1e-3)


def test_clouds_are_dealt_out_by_frame_alone(spark):
    px = [(f, x, y, 1.0 + 0.001 * x, 2.0) for f in range(3) for x in range(4) for y in range(4)]
    depth = spark.createDataFrame([*px, (3, 0, 0, 1.0, 1.0)], "frame long, x long, y long, depth double, conf double")
    rgb = spark.createDataFrame([(f, x, y, f, x, y) for f, x, y, *_ in px if (f, x, y) != (1, 2, 2)] + [(0, 9, 9, 1, 1, 1)], "frame long, x long, y long, r long, g long, b long")
    poses = spark.createDataFrame([(f, 4, 4, [0.1, 0.2, 0.3, 0.0, 0.0, 0.0, 1.0, 0.8, 1.1]) for f in range(4)], "frame long, width int, height int, enc array<double>")
    out = cloud.build_cloud(depth, rgb, poses)
    assert {(r.frame, r.px, r.py) for r in out.collect()} == {(f, x, y) for f, x, y, *_ in px} - {(1, 2, 2)} and all((r.r, r.g, r.b) == (r.frame, r.px, r.py) for r in out.collect())
    assert all("hashpartitioning(frame" in line and "x#" not in line.partition("hashpartitioning")[2] for line in plan_of(out).split("\n") if "Exchange hashpartitioning" in line)


def test_bundle_and_manifest(spark, tmp_path):
    _, sel = session(spark)
    details = sel.select("session", "kind", "source", "ci", F.lit(1.0).alias("time_s"), F.lit(2.0).alias("sharpness"), F.lit(960).alias("width"), F.lit(540).alias("height")).where("ci is not null")
    m = plan.build_manifest(sel.where("ci is not null"), details, 624, 416, 30)
    sinks.write_manifests(m, str(tmp_path / "m"))
    back = readers.read_manifests(spark, str(tmp_path / "m")).first()
    assert back.reference_original_pos == 4 and back.frames[0].source_frame == 60 and list(back.frames[0].crop) == [75, 0, 810, 540]
    sinks.write_bundle({"sel": sel}, str(tmp_path / "b"))
    assert spark.read.parquet(str(tmp_path / "b" / "sel")).where("length(row_sha256) = 64").count() == 10


def test_session_states():
    state, chunk = "", -1
    for tag, frame in (("open", 0), ("frame", 0), ("frame", 1), ("start", 0), ("progress", 0), ("cameras", 0), ("chunk", 0), ("chunk", 8), ("done", 0)):
        state, chunk, error = st.advance(state, chunk, tag, frame)
        assert error is None
    assert st.advance("done", 8, "cancel", 0) == ("done", 8, None) and st.advance("failed", 8, "cancel", 0) == ("failed", 8, None) and st.advance("", -1, "cancel", 0) == ("", -1, None)
    assert st.advance("chunk", 8, "error", 0) == ("failed", 8, "internal") and st.advance("frame", 8, "error", 0)[2] == "protocol"
    assert st.advance("chunk", 8, "chunk", 0)[2] == "validation" and st.advance("open", -1, "chunk", 0)[2] == "protocol" and st.advance("frame", -1, "cancel", 0)[2] == "cancelled"


def test_keyframes_differ_by_pixels_without_a_fix():
    near, far = [10] * 4, [30] * 4
    assert st.differs((60.0, 25.0, 0.0, near), (60.1, 25.0, 0.0, near)) and st.differs((60.0, 25.0, 0.0, None), (60.0, 25.0, 9.0, None)) and not st.differs((60.0, 25.0, None, near), (60.0, 25.0, 9.0, far))
    assert st.differs((None, None, None, near), (60.0, 25.0, 0.0, far)) and not st.differs((None, None, None, near), (60.0, 25.0, 0.0, near)) and not st.differs((None, None, None, None), (60.0, 25.0, 0.0, far))


def test_timeline(spark):
    tags = ["open", *["frame"] * 10, "progress", "cameras", "chunk", "chunk", "done"]
    good = [("a", i, t, i, i) for i, t in enumerate(tags)]
    bad = [("b", i, t, -i, i) for i, t in enumerate(["chunk", "cameras", "chunk", "done", "progress"])]
    again = [("c", i, t, i, i % 8) for i, t in enumerate(tags)]
    got = {r.session: tuple(r)[1:] for r in st.timeline_check(spark.createDataFrame(good + bad + again, "session string, seq long, tag string, frame long, frame_idx long")).collect()}
    assert got["a"] == (True, True, True, True, True) and got["b"] == (False, False, False, False, False)
    assert got["c"] == (True, True, True, False, True)  # ten uploads of eight frames make one chunk


@pytest.mark.parametrize("mode", ["append", "complete"])
@pytest.mark.parametrize("n", [0, 500])
def test_streams_end_in_files(spark, tmp_path, mode, n):
    spark.range(n).selectExpr("id", "id % 7 as k").repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long, k long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    stream, want = (stream, {(i, i % 7) for i in range(n)}) if mode == "append" else (stream.groupBy("k").count(), {(k, len(range(k, n, 7))) for k in range(7) if n})
    got = st.run_available(stream, f"rows_{mode}_{n}", f"file://{tmp_path}/check", mode)
    assert len(rows := got.collect()) == len(want) and {tuple(r) for r in rows} == want
    assert not spark.catalog.tableExists(f"rows_{mode}_{n}") and bool(got.inputFiles()) >= (n > 0)


def _pick(sel, alt):
    mid = sel[len(sel) // 4 : max(3 * len(sel) // 4, len(sel) // 4 + 1)]
    high = [(-alt[c], c) for c in mid if alt.get(c) is not None]
    return min(high)[1] if high else mid[len(mid) // 2]


def replay(auto, first, edits, alt):
    """{ci: (crop, is_reference)} after edits (op, ci, value), one by one."""
    sel, ref = dict.fromkeys(auto, 1.0), first
    for op, c, value in edits:
        if op == "reselect":
            sel, ref = dict.fromkeys(auto, 1.0), first
        elif op == "include":
            sel.setdefault(c, 1.0)
        elif op == "exclude" and c in sel:
            del sel[c]
            if c == ref and sel:
                ref = _pick(sorted(sel), alt)
        elif op == "crop" and c in sel:
            sel[c] = min(max(0.0 if value is None else value, 0.3), 1.0)
    return {c: (round(x, 6), c == ref) for c, x in sel.items()}


def test_edits_of_all_videos(spark):
    """The registered query against a replay of every video's edits in Python."""
    data = "/root/testdata/sf0.001"
    alts, autos, edits = {}, {}, {}
    for r in view(spark, data, "candidates").collect():
        alts.setdefault(r.video, {})[r.ci] = r.rel_alt
    for r in QUERIES["select_keyframes"](spark, data).collect():
        autos.setdefault(r.video, []).append(r.ci)
    kinds = {"view": "include", "click": "exclude", "purchase": "crop", "signup": "reselect"}
    for r in view(spark, data, "events_k").orderBy("event_id").collect():
        edits.setdefault(r.user_id, []).append((kinds.get(r.event_type), r.k % len(alts[r.user_id]), r.value / 50))
    want = {(v, c, *x) for v, auto in autos.items() for c, x in replay(auto, _pick(sorted(auto), alts[v]), edits[v], alts[v]).items()}
    rows = QUERIES["apply_edits"](spark, data).collect()
    assert "reselect" in {e[0] for v in edits.values() for e in v}
    assert len(rows) == len(want) and {(r.session, r.ci, round(r.crop_scale, 6), r.is_reference) for r in rows} == want


def test_edits_of_few_units_by_replay(spark):
    """Many edits of few units: the reference goes often, selections run empty, crops come before, between and after."""
    rng = np.random.default_rng(9)
    autos, edits, want = [], [], set()
    alt = {c: None if c == 3 else float(c % 3) for c in range(6)}
    for k in range(60):
        s, auto = f"s{k}", sorted(rng.choice(6, int(rng.integers(1, 5)), replace=False).tolist())
        first = _pick(auto, alt)
        own = [(str(rng.choice(["include", "exclude", "exclude", "crop", "reselect"], p=[0.3, 0.3, 0.15, 0.2, 0.05])), int(rng.integers(6)), None if rng.random() < 0.1 else float(rng.random() * 1.5)) for _ in range(int(rng.integers(0, 25)))]
        autos += [(s, c, c == first) for c in auto]
        edits += [(s, n, *e) for n, e in enumerate(own)]
        want |= {(s, c, *x) for c, x in replay(auto, first, own, alt).items()}
    edits += [("unknown", 1, "include", 1, None)]
    candidates = [(s, c, a) for s in {x[0] for x in autos} for c, a in alt.items()]
    out = plan.apply_edits(spark.createDataFrame(autos, "session string, ci int, is_reference boolean"), spark.createDataFrame(edits, "session string, seq long, op string, ci int, value double"), spark.createDataFrame(candidates, "session string, ci int, rel_alt double"))
    rows = out.collect()
    assert len(rows) == len(want) and {(r.session, r.ci, round(r.crop_scale, 6), r.is_reference) for r in rows} == want


def test_auto_select_of_all_photos(spark):
    """The registered query takes all kept photos of each session, as far as the budget goes, and fills the rest from the videos."""
    data = "/root/testdata/sf0.001"
    kept, taken, videos = {}, {}, {}
    for r in keyframes.burst_dedup(view(spark, data, "photos"), gap_s=600).collect():
        kept[r.session] = kept.get(r.session, 0) + 1
    for r in QUERIES["auto_select"](spark, data).collect():
        of = taken if r.kind == "photo" else videos
        of[r.session] = of.get(r.session, 0) + 1
    assert taken == {k: min(n, 1000) for k, n in kept.items()}
    assert all(videos.get(k, 0) <= 1000 - n for k, n in taken.items())
