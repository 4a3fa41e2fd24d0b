"""Media catalogue: classification, pairing, exclusions and rollups of file listings."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import path_parts

#: File extensions by kind (fixed values).
VIDEO = ("mp4", "mov")
PHOTO = ("jpg", "jpeg", "png", "tif", "tiff", "heic", "heif")
RAW = ("dng", "arw", "nef", "nrw", "cr2", "cr3", "raf", "orf", "rw2", "pef", "srw", "iiq")


def classify(listing: DataFrame, raw: tuple = RAW) -> DataFrame:
    """media(path, dir, stem, ext, kind, is_raw) of the distinct paths that are media; names with a leading dot, of files or folders, are out."""
    p = path_parts(F.col("path"))
    is_raw = p["ext"].isin(*raw)
    kind = F.when(p["ext"].isin(*VIDEO), "video").when(p["ext"].isin(*PHOTO) | is_raw, "photo")
    rows = listing.select("path").distinct().where(~F.col("path").rlike(r"(^|/)\.[^/]"))
    return rows.select("path", p["dir"].alias("dir"), p["stem"].alias("stem"), p["ext"].alias("ext"), kind.alias("kind"), is_raw.alias("is_raw")).where("kind is not null")


def drop_paired(media: DataFrame) -> DataFrame:
    """Without photos that have a RAW file of the same name beside them."""
    raw = media.where("is_raw").select("dir", "stem").distinct()
    plain = media.where("kind = 'photo' and not is_raw").join(raw, ["dir", "stem"], "left_anti")
    return media.where("kind <> 'photo' or is_raw").unionByName(plain)


def paired_count(media: DataFrame) -> DataFrame:
    raw = media.where("is_raw").select("dir", "stem").distinct()
    return media.where("kind = 'photo' and not is_raw").join(raw, ["dir", "stem"], "left_semi").agg(F.count(F.lit(1)).alias("n_paired"))


def exclude(media: DataFrame, dirs: DataFrame, videos: DataFrame) -> DataFrame:
    """Without files in excluded folders (dir) and without excluded videos (path); Spark picks the join by the lists' sizes."""
    return media.join(dirs.select("dir"), "dir", "left_anti").join(videos.select("path", F.lit("video").alias("kind")), ["path", "kind"], "left_anti")


def dir_rollup(media: DataFrame) -> DataFrame:
    """Clips, photos and RAW files of each folder, and the totals in a row without one."""
    return media.rollup("dir").agg(
        F.count_if(F.col("kind") == "video").alias("n_clips"), F.count_if(F.col("kind") == "photo").alias("n_photos"),
        F.count_if(F.col("is_raw")).alias("n_raw"), F.count_distinct("dir").alias("n_dirs"), F.grouping("dir").cast("long").alias("is_total"),
    )
