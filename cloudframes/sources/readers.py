"""Readers: media listings, subtitles, probe documents, EXIF tags, colour tables, depth chunks and manifests."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.geo import gps_or_null
from ..operators.catalog import classify

PROBE = "streams array<struct<index:int,codec_type:string,width:int,height:int,avg_frame_rate:string,r_frame_rate:string,nb_frames:string,duration:string,color_range:string,color_transfer:string>>, format struct<duration:string>"


def media_scan(spark: SparkSession, *roots: str) -> DataFrame:
    """media of all files under the roots; only the listing is read, never the files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(roots)).select("path")
    return classify(files.select(F.regexp_replace("path", r"^file:(//)?", "").alias("path")))


def srt_texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def srt_parse(texts: DataFrame, key: str = "path") -> DataFrame:
    """Entries (key, seq, start_ms, end_ms, lat, lon, rel_alt, abs_alt, yaw, pitch, iso, shutter, fnum, color_md) of subtitle texts (key, text).

    Blocks stand between blank lines; a block without a valid time line is skipped. Named values override the older GPS(a,b,alt).
    """
    rows = texts.select(key, F.posexplode(F.split(F.regexp_replace("text", "\r", ""), r"\n[ \t]*\n\s*")).alias("seq", "block"))
    lines = F.filter(F.transform(F.split("block", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    rows = rows.withColumn("lines", lines).withColumn("at", F.array_position(F.transform("lines", lambda x: x.contains("-->")), True))
    rows = rows.where("at > 0").withColumn("times", F.split(F.get("lines", F.col("at").cast("int") - 1), "-->"))
    rows = rows.withColumn("start_ms", T.srt_timestamp(F.get("times", F.lit(0)))).withColumn("end_ms", T.srt_timestamp(F.regexp_extract(F.trim(F.get("times", F.lit(1))), r"^(\S+)", 1)))
    body = F.array_join(F.transform(F.slice("lines", F.col("at").cast("int") + 1, F.size("lines")), lambda x: T.strip_tags(x)), " ")
    rows = rows.where("start_ms is not null and end_ms is not null").withColumn("body", body).withColumn("tok", T.srt_tokens(F.col("body")))
    value = lambda *names: T.srt_value(F.col("tok"), *names)
    number = lambda *names: value(*names).try_cast("double")
    said = lambda fallback, *names: F.when(value(*names).isNotNull(), number(*names)).otherwise(fallback)
    lat0, lon0 = T.gps_paren(F.col("body"))
    none = F.lit(None).cast("double")
    fix = gps_or_null(said(lat0, "lat", "latitude"), said(lon0, "lon", "longitude", "longtitude"), said(none, "rel_alt", "barometer"), F.coalesce(said(none, "abs_alt"), number("altitude")))
    fnum = number("fnum")
    return rows.withColumn("fix", fix).select(
        key, "seq", "start_ms", "end_ms", F.col("fix.lat").alias("lat"), F.col("fix.lon").alias("lon"), F.col("fix.rel_alt_m").alias("rel_alt"), F.col("fix.abs_alt_m").alias("abs_alt"),
        number("gb_yaw").alias("yaw"), number("gb_pitch").alias("pitch"), value("iso").try_cast("long").alias("iso"), value("shutter").alias("shutter"), F.when(fnum > 90, fnum / 100).otherwise(fnum).alias("fnum"), value("color_md").alias("color_md"),
    )


def srt_errors(texts: DataFrame, key: str = "path") -> DataFrame:
    """Texts without a single entry."""
    return texts.select(key).join(srt_parse(texts, key).select(key).distinct(), key, "left_anti").withColumn("error", F.lit("no entries"))


def _ratio(c: Column) -> Column:
    a, b = F.split(c, "/").getItem(0).try_cast("double"), F.try_element_at(F.split(c, "/"), F.lit(2)).try_cast("double")
    return F.when((a > 0) & (b > 0), a / b)


def probe_json(docs: DataFrame, key: str = "path") -> DataFrame:
    """video_meta of probe documents (key, json): first video stream, frame rate, counts, colour tags, first subtitle stream; else an error."""
    d = F.from_json("json", PROBE)
    rows = docs.withColumn("d", d).withColumn("v", F.get(F.filter("d.streams", lambda s: s["codec_type"] == "video"), F.lit(0)))
    rows = rows.withColumn("sub", F.get(F.filter("d.streams", lambda s: s["codec_type"] == "subtitle"), F.lit(0))["index"]).withColumn("fps", F.coalesce(_ratio(F.col("v.avg_frame_rate")), _ratio(F.col("v.r_frame_rate"))))
    error = F.when(F.col("d.streams").isNull(), "no streams").when(F.col("v").isNull(), "no video stream").when(~((F.col("v.width") > 0) & (F.col("v.height") > 0)) | F.col("v.width").isNull() | F.col("v.height").isNull(), "bad dimensions").when(F.col("fps").isNull(), "bad frame rate")
    good = lambda c: F.when(F.col("error").isNull(), c)
    duration = F.coalesce(F.col("v.duration").try_cast("double"), F.col("d.format.duration").try_cast("double"))
    return rows.withColumn("error", error).select(
        key, good(F.col("v.width")).cast("long").alias("width"), good(F.col("v.height")).cast("long").alias("height"), good(F.col("fps")).alias("fps"), good(F.col("v.nb_frames").try_cast("long")).alias("n_frames"),
        good(duration).alias("duration_s"), good(F.col("v.color_range")).alias("color_range"), good(F.col("v.color_transfer")).alias("color_transfer"), good(F.col("sub")).cast("long").alias("subtitle_stream"), "error",
    )


def exif_pivot(tags: DataFrame, files: DataFrame) -> DataFrame:
    """photo_meta of files (path) from tags (path, tag, vals, text): position in degrees, signed altitude, orientation 1 to 8, time."""
    names = ["GPSLatitude", "GPSLatitudeRef", "GPSLongitude", "GPSLongitudeRef", "GPSAltitude", "GPSAltitudeRef", "Orientation", "DateTimeOriginal"]
    wide = tags.groupBy("path").pivot("tag", names).agg(F.first(F.struct("vals", "text"), ignorenulls=True))
    deg = lambda t: F.get(F.col(t)["vals"], F.lit(0)) + F.get(F.col(t)["vals"], F.lit(1)) / 60 + F.get(F.col(t)["vals"], F.lit(2)) / 3600
    sign = lambda t, neg: F.when(F.col(t)["text"] == neg, -1.0).otherwise(1.0)
    first = lambda t: F.get(F.col(t)["vals"], F.lit(0))
    alt = first("GPSAltitude") * F.when(first("GPSAltitudeRef") == 1, -1.0).otherwise(1.0)
    fix = gps_or_null(deg("GPSLatitude") * sign("GPSLatitudeRef", "S"), deg("GPSLongitude") * sign("GPSLongitudeRef", "W"), None, alt)
    turn = first("Orientation")
    meta = wide.withColumn("fix", fix).select("path", T.exif_datetime(F.col("DateTimeOriginal")["text"]).alias("capture_time"), F.col("fix.lat").alias("lat"), F.col("fix.lon").alias("lon"), F.col("fix.abs_alt_m").alias("abs_alt"), F.when(turn.between(1, 8), turn.cast("long")).alias("turn"))
    return files.select("path").join(meta, "path", "left").withColumn("orientation", F.coalesce("turn", F.lit(1)).cast("long")).drop("turn")


def cube_lattice(texts: DataFrame, key: str = "lut") -> DataFrame:
    """Lattice rows (key, size, r, g, b, o_r, o_g, o_b, dmin, dmax) of colour tables (key, text); tables with an error have one row with `error`."""
    rows = texts.select(key, F.posexplode(F.split("text", "\r?\n")).alias("ln", "line")).select(key, "ln", F.split(F.trim("line"), r"\s+").alias("t"), F.trim("line").alias("line")).where("line <> '' and not startswith(line, '#')")
    word = F.get("t", F.lit(0))
    three = lambda at: F.transform(F.slice("t", at, 3), lambda x: x.try_cast("double"))
    head = rows.groupBy(key).agg(
        F.max(F.when(word == "LUT_3D_SIZE", F.get("t", F.lit(1)).try_cast("int"))).alias("size"), F.count_if(word == "LUT_1D_SIZE").alias("one_d"),
        F.coalesce(F.max(F.when(word == "DOMAIN_MIN", three(2))), F.array(*[F.lit(0.0)] * 3)).alias("dmin"), F.coalesce(F.max(F.when(word == "DOMAIN_MAX", three(2))), F.array(*[F.lit(1.0)] * 3)).alias("dmax"),
        F.count_if(~word.rlike("^[A-Za-z]")).alias("n_rows"), F.count_if(~word.rlike("^[A-Za-z]") & ((F.size("t") != 3) | F.exists(three(1), lambda x: x.isNull()))).alias("n_bad"),
    )
    n3 = F.col("size") * F.col("size") * F.col("size")
    narrow = F.exists(F.zip_with("dmin", "dmax", lambda a, b: F.coalesce(b <= a, F.lit(True))), lambda x: x)
    error = F.when(F.col("one_d") > 0, "one-dimensional").when(F.col("size").isNull(), "no size").when(~F.col("size").between(2, 129), "bad size").when(F.col("n_bad") > 0, "bad row").when(F.col("n_rows") != n3, "bad number of rows").when(narrow, "empty domain")
    data = rows.where(~word.rlike("^[A-Za-z]")).withColumn("i", F.row_number().over(Window.partitionBy(key).orderBy("ln")) - 1).select(key, "i", *[F.get("t", F.lit(k)).try_cast("double").alias(c) for k, c in enumerate(("o_r", "o_g", "o_b"))])
    known = head.withColumn("error", error).select(key, "size", "dmin", "dmax", "error")
    place = lambda d: (F.floor(F.col("i") / d) % F.col("size")).cast("int")
    good = known.where("error is null").drop("error").join(data, key).select(key, "size", place(F.lit(1)).alias("r"), place(F.col("size")).alias("g"), place(F.col("size") * F.col("size")).alias("b"), "o_r", "o_g", "o_b", "dmin", "dmax", F.lit(None).cast("string").alias("error"))
    bad = known.where("error is not null").select(key, "size", *[F.lit(None).cast(t).alias(c) for c, t in (("r", "int"), ("g", "int"), ("b", "int"), ("o_r", "double"), ("o_g", "double"), ("o_b", "double"))], "dmin", "dmax", "error")
    return good.unionByName(bad)


def depth_chunk_decode(chunks: DataFrame) -> DataFrame:
    """Pixels (session, frame, x, y, depth, conf) of chunks (session, first_frame, n, w, h, depth, conf) of little-endian half floats."""

    def run(batches):
        for batch in batches:
            for c in batch.to_pylist():
                n, w, h = c["n"], c["w"], c["h"]
                size = n * w * h
                i = np.arange(size)
                cols = [np.frombuffer(c[k], "<f2", size).astype(np.float64) for k in ("depth", "conf")]
                yield pa.RecordBatch.from_arrays([pa.array([c["session"]] * size), pa.array(c["first_frame"] + i // (w * h), pa.int64()), pa.array(i % w, pa.int64()), pa.array(i // w % h, pa.int64()), *map(pa.array, cols)], names=["session", "frame", "x", "y", "depth", "conf"])

    return chunks.select("session", "first_frame", "n", "w", "h", "depth", "conf").mapInArrow(run, "session string, frame long, x long, y long, depth double, conf double")


MANIFEST = "session string, version int, budget int, reference_original_pos int, frames array<struct<batch_index:int,source:string,kind:string,source_frame:int,time_s:double,sharpness:double,crop:array<int>>>"


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(path)


def tensor_manifest(docs: DataFrame) -> DataFrame:
    """name, shape and dtype of each tensor of manifest documents (json)."""
    return docs.select(F.explode(F.from_json("json", "tensors map<string,struct<shape:array<int>,dtype:string>>")["tensors"]).alias("name", "t")).select("name", "t.shape", "t.dtype")
