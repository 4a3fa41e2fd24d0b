"""Streams over several batches: state that waits, is evicted or expires, and rows that come too late."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cloudframes.operators import telemetry
from cloudframes.streaming import sessions as st

POSE = [0.4, -0.2, 1.5, 0.11, -0.32, 0.05, 0.92, 0.8, 1.1]


@pytest.fixture
def play(spark, tmp_path):
    """A stream of given batches, one file each; `out` runs a stream to its end."""
    count = iter(range(100))

    class Play:
        def __call__(self, schema, *batches):
            path = f"{tmp_path}/in{next(count)}"
            for rows in batches:
                spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
            return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)

        def out(self, stream, mode="append"):
            k = next(count)
            return st.run_available(stream, f"played_{k}", f"file://{tmp_path}/check{k}", mode)

    return Play()


def at(seconds):
    return dt.datetime(2025, 1, 1) + dt.timedelta(seconds=seconds)


def test_pixels_wait_for_their_camera(spark, play):
    pixels = [(f, x, y, 1.0 + x, None if x == 2 else 0.5) for f in range(4) for x in range(3) for y in range(2)]
    late, poses = [(1, 9, 9, 2.0, 1.0), (3, 9, 9, 2.0, 1.0)], [(f, 8, 8, [v + f for v in POSE[:3]] + POSE[3:]) for f in range(3)]
    schema, of = "frame long, x long, y long, depth double, conf double", "frame long, width int, height int, enc array<double>"
    chunks = play(schema, pixels, late, late[:1])
    # frame 0 has its camera at once, 1 and 2 a batch later, 3 never
    cameras = play(of, poses[:1], poses[1:])
    got = play.out(st.stream_cloud(chunks, cameras))
    everything, static = spark.createDataFrame(pixels + late + late[:1], schema), spark.createDataFrame(poses, of)
    rounded = lambda df: sorted(tuple(None if v is None else round(v, 9) for v in r) for r in df.select("frame", "px", "py", "wx", "wy", "wz", F.coalesce("conf", F.lit(-1.0)).alias("conf")).collect())
    want = rounded(st.stream_cloud(everything, static))
    assert rounded(got) == want and {r[0] for r in want} == {0, 1, 2}


def test_silent_sessions_end(play):
    schema = "session string, seq long, tag string, frame long, ts timestamp"
    first = [("a", 1, "open", 0, at(0)), ("b", 1, "open", 0, at(1)), ("c", 1, "open", 0, at(2)), ("d", 1, "open", 0, at(3))]
    second = [("a", 2, "frame", 0, at(20)), ("c", 2, "start", 0, at(25)), ("d", 2, "frame", 0, at(70)), ("e", 1, "open", 0, at(100))]
    third = [("b", 2, "frame", 0, at(101)), ("a", 3, "start", 0, at(102)), ("late", 1, "open", 0, at(10)), ("e", 2, "frame", 0, at(200))]
    got = play.out(st.stream_session_fsm(play(schema, first, second, third), "60 seconds", "10 seconds"))
    rows = sorted(tuple(r) for r in got.collect())
    assert rows == [
        ("a", 1, "open", None), ("a", 2, "failed", "stalled"), ("a", 2, "frame", None),  # its timer went off at 80 seconds, for the watermark was at 90
        ("b", 1, "failed", "stalled"), ("b", 1, "open", None), ("c", 1, "open", None), ("c", 2, "failed", "protocol"),
        ("d", 1, "failed", "stalled"), ("d", 1, "open", None),  # silent between two messages
        ("e", 1, "failed", "stalled"), ("e", 1, "open", None),  # and "late" was dropped
    ]


def test_a_finished_session_does_not_stall(play):
    tags = ["open", "frame", "start", "progress", "cameras", "chunk", "done"]
    schema = "session string, seq long, tag string, frame long, ts timestamp"
    rows = [("a", k + 1, t, k, at(k)) for k, t in enumerate(tags)]
    got = play.out(st.stream_session_fsm(play(schema, rows, [("z", 1, "open", 0, at(10_000))], [("z", 2, "frame", 0, at(10_001))]), "60 seconds"))
    assert {r.error for r in got.where("session = 'a'").collect()} == {None} and got.where("session = 'a'").count() == 7


def test_threshold_is_refined(spark, play):
    values = [[0.01 * k for k in range(1, 50)], [5.0] * 100 + [float("nan"), None], [1e9, 0.0]]
    batches = [[("s", v) for v in part] + [("t", 1.0)] for part in values]
    got = play.out(st.stream_conf_threshold(play("session string, conf double", *batches), 0.3))
    seen = [(r.n, r.bin) for r in got.where("session = 's'").orderBy("n").collect()]
    for k in range(3):
        rows = spark.createDataFrame([r for part in batches[: k + 1] for r in part], "session string, conf double").where("conf is not null and not isnan(conf)")
        hist = rows.groupBy("session", st.conf_bin(F.col("conf")).alias("bin")).count()
        want = st.hist_threshold(hist, 0.3).where("session = 's'").first()
        assert seen[k] == (want.n, want.bin)
    assert len(seen) == 3 and len({b for _, b in seen}) > 1


def test_nearest_entries_of_a_live_stream(spark, play):
    entries = [[("v", 0, at(0), at(1)), ("v", 1, at(1), at(2))], [("v", 2, at(4), at(5)), ("w", 0, at(4), at(6))], [("v", 5, at(7), at(8))], [("v", 3, at(1.4), at(1.6)), ("v", 4, at(500), at(501))]]
    probes = [[("v", 10, at(0.5)), ("v", 11, at(1.5)), ("v", 12, at(3))], [("v", 13, at(4.6)), ("w", 14, at(6.4)), ("x", 15, at(5))], [("v", 18, at(7))], [("v", 16, at(2.2)), ("v", 17, at(400)), ("end", 99, at(999))]]
    f = play("video string, probe long, ts timestamp", *probes)
    e = play("video string, seq long, start_ts timestamp, end_ts timestamp", *entries, [("end", 9, at(999), at(999))])
    got = play.out(st.stream_telemetry_asof(f, e, 500, 2_000, "1 second"))
    found = {r.probe: r.seq for r in got.where("probe <> 99").collect()}
    # probe 16 and entry 3 came after the watermark had passed them
    assert found == {10: 0, 11: 1, 12: None, 13: 2, 14: 0, 15: None, 17: None, 18: 5} and got.count() == len(found)
    ms = lambda t: int((t - at(0)).total_seconds() * 1000)
    have = [(v, k, ms(a), ms(b), 0.0, 0.0, 0.0, 0.0, 0) for part in entries for v, k, a, b in part if (v, k) != ("v", 3)]
    batch = telemetry.asof(spark.createDataFrame([(v, k, ms(t)) for part in probes for v, k, t in part if k in found], "video string, probe long, t_ms long"), spark.createDataFrame(have, "video string, seq long, start_ms long, end_ms long, lat double, lon double, rel_alt double, yaw double, iso long"), slack_ms=500)
    assert {r.probe: r.seq for r in batch.collect()} == found


def test_bursts_come_out_as_time_passes(play):
    schema = "session string, ts timestamp, path string, sharpness double"
    first = [("s", at(0), "a", 1.0), ("s", at(1), "b", 5.0), ("s", at(30), "c", 2.0)]
    second = [("s", at(31.5), "d", 1.0), ("s", at(100), "e", 1.0)]
    third, fourth = [("s", at(150), "f", 1.0)], [("s", at(20), "late", 9.0), ("s", at(300), "end", 0.0)]
    got = play.out(st.stream_bursts(play(schema, first, second, third, fourth)))
    assert sorted((r.path, r.n) for r in got.collect()) == [("b", 2), ("c", 2), ("e", 1), ("f", 1)]


def test_logs_keep_so_many_lines(play):
    batches = [[("s", k, f"line {k // 2}") for k in range(p, p + 6)] + [("t", p, "same")] for p in (0, 6, 12)]
    got = play.out(st.stream_log_dedup(play("session string, seq long, line string", *batches), 3))
    assert got.where("session = 's'").count() == 9
    assert sorted(tuple(r) for r in st.log_lines(got).collect()) == [("s", 12, "line 6"), ("s", 14, "line 7"), ("s", 16, "line 8"), ("t", 0, "same")]
    assert st.LOG_LINES == 200
