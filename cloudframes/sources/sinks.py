"""Writers: binary point files, camera documents, manifests, session bundles."""

import json

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

#: Records of a point file, which bounds what a task holds: 21 MB.
VERTICES = 1_000_000
_FIELDS = [("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("r", "u1"), ("g", "u1"), ("b", "u1"), ("conf", "<f4"), ("frame", "<u2")]
#: One record of a binary point file: 21 bytes. The wide form has frame numbers of 32 bits, 23 bytes.
RECORD, WIDE_RECORD = np.dtype(_FIELDS), np.dtype([*_FIELDS[:-1], ("frame", "<u4")])
_PROPERTIES = "property float x\nproperty float y\nproperty float z\nproperty uchar red\nproperty uchar green\nproperty uchar blue\nproperty float confidence\n"


def ply_header(n: int, wide: bool = False) -> bytes:
    return f"ply\nformat binary_little_endian 1.0\nelement vertex {n}\n{_PROPERTIES}property {'uint' if wide else 'ushort'} frame\nend_header\n".encode()


def ply_records(batch: pa.RecordBatch, kind: np.dtype) -> np.ndarray:
    """A batch's rows as records. Whole numbers that don't fit are an error, never wrapped; null coordinates are NaN."""
    rows = np.empty(batch.num_rows, kind)
    for c in kind.names:
        column = batch.column(c)
        if kind[c].kind == "u":
            values = np.asarray(column.cast(pa.int64()).fill_null(-1))
            most = int(np.iinfo(kind[c]).max)
            if len(values) and (values.min() < 0 or values.max() > most):
                wrong = values[(values < 0) | (values > most)][0]
                raise ValueError(f"{c} must be from 0 to {most}, not {wrong if wrong != -1 else 'null or -1'}" + ("; write with wide_frames" if c == "frame" and most < 1 << 31 else ""))
            rows[c] = values
        else:
            rows[c] = column.to_numpy(zero_copy_only=False)
    return rows


class PlyWriter(DataSourceArrowWriter):
    """Files of at most `most` records, in the folder that options name; a task holds one file's records and writes each to an attempt's
    name, and the commit renames them.

    The folder is a path or a URI of a file system that Arrow knows (file, hdfs, s3, gs); driver and executors must see it.
    """

    def __init__(self, path: str, most: int, wide: bool):
        self.path, self.most, self.wide = path, most, wide

    def write(self, iterator):
        from pyspark import TaskContext

        task = TaskContext.get()
        kind = WIDE_RECORD if self.wide else RECORD
        system, folder = FileSystem.from_uri(self.path)
        system.create_dir(folder)
        files, held, size = [], [], 0

        def put():
            nonlocal held, size
            name = f"part-{task.partitionId():05d}-{len(files):05d}"
            draft = f"{folder}/.{name}-{task.taskAttemptId()}"
            with system.open_output_stream(draft) as f:
                f.write(ply_header(size, self.wide))
                for rows in held:
                    f.write(rows.tobytes())
            files.append((draft, f"{folder}/{name}.ply", size))
            held, size = [], 0

        for batch in iterator:
            rows = ply_records(batch, kind)
            while len(rows):
                part, rows = rows[: self.most - size], rows[self.most - size :]
                held.append(part)
                size += len(part)
                if size == self.most:
                    put()
        if size:
            put()
        return PlyMessage(files)

    def commit(self, messages):
        done = [f for m in messages if m is not None for f in m.files]
        system, folder = FileSystem.from_uri(self.path)
        system.create_dir(folder)
        for draft, final, _ in done:
            system.move(draft, final)
        with system.open_output_stream(f"{folder}/_manifest.json") as f:
            f.write(json.dumps([{"file": final.rpartition("/")[2], "vertices": n} for _, final, n in done]).encode())

    def abort(self, messages):
        system, _ = FileSystem.from_uri(self.path)
        for m in messages:
            for draft, _, _ in m.files if m is not None else []:
                try:
                    system.delete_file(draft)
                except FileNotFoundError:
                    pass


class PlyMessage(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, str, int]]):
        self.files = files


class PlySource(DataSource):
    """df.write.format("ply").mode("append").save(path); the path must be one that all executors see. Parquet stays the main sink."""

    @classmethod
    def name(cls):
        return "ply"

    def writer(self, schema, overwrite):
        return PlyWriter(self.options["path"], int(self.options.get("records", VERTICES)), self.options.get("wide", "false") == "true")


def write_ply(points: DataFrame, path: str, vertices_per_file: int = VERTICES, wide_frames: bool = False) -> None:
    """points(x, y, z, r, g, b, conf, frame) as point files of at most so many vertices, in one pass: a file is cut when it is full.

    Frame numbers have 16 bits, with wide_frames 32; one that doesn't fit, or a colour beyond 0 to 255, fails the write. No points make
    no file but an empty manifest.
    """
    points.sparkSession.dataSource.register(PlySource)
    rows = points.select(*[F.col(c).cast("float") for c in ("x", "y", "z")], *[F.col(c).cast("int") for c in ("r", "g", "b")], F.col("conf").cast("float"), F.col("frame").cast("long"))
    rows.write.format("ply").option("records", vertices_per_file).option("wide", str(wide_frames).lower()).mode("append").save(path)


def read_ply(data: bytes) -> np.ndarray:
    head, _, body = data.partition(b"end_header\n")
    n = int(head.split(b"element vertex ")[1].split(b"\n")[0])
    return np.frombuffer(body, WIDE_RECORD if b"property uint frame" in head else RECORD, n)


def read_ply_files(spark, path: str) -> DataFrame:
    """x, y, z, r, g, b, conf and frame of all point files of a folder; a file is one task's."""

    def run(batches):
        for batch in batches:
            for data in batch.column("content"):
                rows = read_ply(data.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(rows[c].astype(np.int32) if c in ("r", "g", "b") else rows[c].astype(np.int64) if c == "frame" else rows[c]) for c in RECORD.names], names=list(RECORD.names))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ply").option("recursiveFileLookup", "true").load(path)
    return files.select("content").mapInArrow(run, "x float, y float, z float, r int, g int, b int, conf float, frame long")


def stream_ply(points: DataFrame, path: str, checkpoint: str, wide_frames: bool = False) -> None:
    """Whatever points have arrived as point files, a folder for each batch; a batch that is run again replaces its own."""

    def put(batch: DataFrame, number: int) -> None:
        write_ply(batch, f"{path}/{number}", wide_frames=wide_frames)

    points.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def camera_documents(cams: DataFrame) -> DataFrame:
    """frame and a JSON document with rotation, translation, intrinsics and centre of each camera."""
    from ..functions.pose import camera_center

    r = F.array(*[F.array(*[F.col(f"r{i}{j}") for j in range(3)]) for i in range(3)])
    doc = F.struct("frame", F.struct(r.alias("r"), F.array("t0", "t1", "t2").alias("t")).alias("extrinsic"), F.struct("fx", "fy", "cx", "cy").alias("intrinsics"), F.array(*camera_center()).alias("center"))
    return cams.select("frame", F.to_json(doc).alias("json"))


def write_manifests(manifest: DataFrame, path: str) -> None:
    manifest.write.mode("overwrite").json(path)


def write_bundle(tables: dict[str, DataFrame], path: str) -> None:
    """Tables with a session column as bundle/<table>/session=..., each row with a digest of its content."""
    for name, df in tables.items():
        rest = [c for c in df.columns if c != "session"]
        df.withColumn("row_sha256", F.sha2(F.to_json(F.struct(*rest)), 256)).write.mode("overwrite").partitionBy("session").parquet(f"{path}/{name}")


def half_chunks(pixels: DataFrame, w: int, h: int, frames: int = 8) -> DataFrame:
    """Depth pixels (session, frame, x, y, depth, conf) as chunks of half floats; a chunk is one group of at most frames * w * h rows."""

    def pack(table: pa.Table) -> pa.Table:
        d = {c: np.asarray(table.column(c)) for c in ("frame", "x", "y", "depth", "conf")}
        first, n = int(d["frame"].min()), int(d["frame"].max() - d["frame"].min() + 1)
        at = ((d["frame"] - first) * h + d["y"]) * w + d["x"]
        out = {}
        for c in ("depth", "conf"):
            grid = np.zeros(n * w * h, "<f2")
            grid[at] = d[c]
            out[c] = grid.tobytes()
        return pa.table({"session": [table.column("session")[0].as_py()], "first_frame": pa.array([first], pa.int64()), "n": pa.array([n], pa.int32()), "w": pa.array([w], pa.int32()), "h": pa.array([h], pa.int32()), "depth": [out["depth"]], "conf": [out["conf"]]})

    grouped = pixels.withColumn("chunk", F.floor(F.col("frame") / frames)).groupBy("session", "chunk")
    return grouped.applyInArrow(pack, "session string, first_frame long, n int, w int, h int, depth binary, conf binary")
