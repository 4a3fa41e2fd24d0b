"""GIF media columns: bytes as palette samples, LZW code streams, palettes, disposal, transparency and timed frames."""

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import doc_text, documents

WIDTH = 64
#: Rows of a frame at most: 256 KB of samples, so that a long payload is an animation and a canvas stays small.
FRAME_ROWS = 4096
CLEAR, END, FIRST, FULL = 256, 257, 258, 4096
#: Pixels of a canvas or a frame at most; larger ones are errors, before anything is allocated.
MOST_PIXELS = 1 << 24
#: Width in bits of the i-th code after a clear code.
_WIDTHS = np.array([9] + [min(12, max(9, (257 + i).bit_length())) for i in range(1, FULL - FIRST + 2)], np.int64)

_ENDS = np.cumsum(_WIDTHS)


def lzw_codes(samples: bytes) -> list[list[int]]:
    """Codes of 8-bit samples times 256, as one list for each run between clear codes."""
    runs, out, table, free, limit = [], [], {}, FIRST << 8, FULL << 8
    data = iter(samples)
    prefix = next(data, None)
    if prefix is None:
        return [[]]
    prefix <<= 8
    get, put = table.get, out.append
    for c in data:
        key = prefix + c
        code = get(key)
        if code:
            prefix = code
        else:
            put(prefix)
            table[key] = free
            prefix = c << 8
            free += 256
            if free == limit:
                runs.append(out)
                out, free = [], FIRST << 8
                put = out.append
                table.clear()
    put(prefix)
    runs.append(out)
    return runs


def lzw_encode(samples: bytes) -> bytes:
    """The bit stream of a GIF image with 8-bit samples: clear, codes of growing width, end."""
    codes, widths = [np.array([CLEAR])], [_WIDTHS[:1]]
    runs = lzw_codes(samples)
    for k, run in enumerate(runs):
        codes += [np.array(run, np.int64) >> 8, np.array([END if k == len(runs) - 1 else CLEAR])]
        widths.append(_WIDTHS[: len(run) + 1])
    codes, widths = np.concatenate(codes), np.concatenate(widths)
    at = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(widths, out=at[1:])
    n, bits, byte = (int(at[-1]) + 7) // 8, codes << (at[:-1] & 7), at[:-1] >> 3
    out = sum(np.bincount(byte + k, (bits >> 8 * k) & 255, n + 3) for k in range(3))
    return out[:n].astype(np.uint8).tobytes()


def _strings(codes: np.ndarray) -> np.ndarray:
    """The samples of one run of codes. Code 258 + j stands for what code j of the run gave and the first sample of what follows it."""
    n, here = len(codes), np.arange(len(codes))
    literal = codes < CLEAR
    parent = np.where(literal, here, codes - FIRST)
    if (literal < (parent >= here)).any():
        raise ValueError("an LZW code stands before its definition")
    root, depth = parent.copy(), (~literal).astype(np.int64)
    while not literal[root].all():  # pointer jumping: twice as far up each time
        depth += depth[root]
        root = root[root]
    first = codes[root]
    last = np.where(literal, codes, first[np.minimum(parent + 1, n - 1)]).astype(np.uint8)
    ends = np.cumsum(depth + 1)
    out = np.empty(int(ends[-1]) if n else 0, np.uint8)
    node, at, left = here, ends - 1, depth
    while len(node):  # from each string's last sample back to its first
        out[at] = last[node]
        more = np.flatnonzero(left > 0)
        node, at, left = parent[node[more]], at[more] - 1, left[more] - 1
    return out


def lzw_decode(stream: bytes, least: int = 8, most: int | None = None) -> np.ndarray:
    """Samples of a code stream with a minimum code size of 2 to 8, early or late clear codes, and a full table kept in use.

    From `most` samples on, no further run between clear codes is read.
    """
    if not 2 <= least <= 8:
        raise ValueError(f"an LZW code size of {least}")
    clear, out, p, size = 1 << least, [], 0, 0
    end, first = clear + 1, clear + 2
    if least == 8:
        widths, sums = _WIDTHS, _ENDS
    else:
        widths = np.array([least + 1] + [min(12, max(least + 1, (first - 1 + i).bit_length())) for i in range(1, FULL - first + 2)], np.int64)
        sums = np.cumsum(widths)
    padded = np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.int64)
    total = len(stream) * 8
    run: list[np.ndarray] = []
    done = 0
    while True:
        if done < len(widths):
            base = p - (int(sums[done - 1]) if done else 0)
            w = widths[done : int(np.searchsorted(sums, total - base, side="right"))]
            at = base + sums[done : done + len(w)] - w
        else:
            w = np.full(max(0, min(4096, (total - p) // 12)), 12, np.int64)
            at = p + 12 * np.arange(len(w))
        if not len(w):
            break
        b = at >> 3
        codes = ((padded[b] | padded[b + 1] << 8 | padded[b + 2] << 16) >> (at & 7)) & ((1 << w) - 1)
        stops = np.flatnonzero((codes == clear) | (codes == end))
        k = int(stops[0]) if len(stops) else len(codes)
        if k:
            run.append(codes[:k])
        if not len(stops):
            p, done = int(at[-1] + w[-1]), done + k
            continue
        if run:
            out.append(_strings_of(np.concatenate(run), clear))
            size += len(out[-1])
        run, done, p = [], 0, int(at[k] + w[k])
        if codes[k] == end or most is not None and size >= most:
            break
    if run:
        out.append(_strings_of(np.concatenate(run), clear))
    return np.concatenate(out) if out else np.zeros(0, np.uint8)


def _strings_of(codes: np.ndarray, clear: int) -> np.ndarray:
    return _strings(codes if clear == CLEAR else np.where(codes >= clear, codes + (CLEAR - clear), codes))


GREY = np.repeat(np.arange(256, dtype=np.uint8), 3).tobytes()


def gif_of(samples: bytes, width: int = WIDTH, frame_rows: int = FRAME_ROWS, delay_cs: int = 4) -> bytes:
    """A GIF whose pixels are these samples on a grey palette, row by row, frame after frame; whole rows are needed."""
    rows = len(samples) // width
    if not rows or rows * width != len(samples):
        raise ValueError("samples must fill a positive number of rows")
    parts = [b"GIF89a", struct.pack("<HHBBB", width, min(rows, frame_rows), 0xF7, 0, 0), GREY]
    for at in range(0, rows, frame_rows):
        h = min(frame_rows, rows - at)
        parts += [struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 1 << 2, delay_cs, 0, 0), struct.pack("<BHHHHB", 0x2C, 0, 0, width, h, 0), b"\x08"]
        stream = lzw_encode(samples[at * width : (at + h) * width])
        parts += [bytes([len(stream[i : i + 255])]) + stream[i : i + 255] for i in range(0, len(stream), 255)]
        parts.append(b"\0")
    return b"".join([*parts, b";"])


def _blocks(data: bytes, p: int) -> tuple[bytes, int]:
    parts = []
    while n := data[p]:
        if p + 1 + n > len(data):
            raise ValueError("a file that breaks off")
        parts.append(data[p + 1 : p + 1 + n])
        p += 1 + n
    return b"".join(parts), p + 1


def _interlaced(h: int) -> np.ndarray:
    return np.concatenate([np.arange(a, h, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])


def frames(data: bytes):
    """The composed frames of a GIF: dicts with index, delay_ms, disposal, left, top, width, height, canvas and indices.

    canvas is the whole picture as shown (height, width, RGB and alpha); indices are the frame's own samples. Transparent
    samples leave what is below; disposal 2 clears the frame's place afterwards, 3 restores what stood there. A file that breaks
    off, a missing palette or entry of it, a code size outside 2 to 8 and a canvas or frame of over MOST_PIXELS raise errors.
    """
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    w, h, flags, _, _ = struct.unpack("<HHBBB", data[6:13])
    if w * h > MOST_PIXELS:
        raise ValueError(f"a canvas of {w} x {h}")
    p, shared = 13, None
    if flags & 0x80:
        n = 3 * 2 ** ((flags & 7) + 1)
        shared, p = np.frombuffer(data[p : p + n], np.uint8).reshape(-1, 3), p + n
    canvas = np.zeros((h, w, 4), np.uint8)
    disposal, delay, clear_index, index = 0, 0, None, 0
    while p < len(data) and data[p] != 0x3B:
        if data[p] == 0x21:
            label = data[p + 1]
            body, p = _blocks(data, p + 2)
            if label == 0xF9 and len(body) >= 4:
                disposal, delay = body[0] >> 2 & 7, struct.unpack("<H", body[1:3])[0] * 10
                clear_index = body[3] if body[0] & 1 else None
            continue
        if data[p] != 0x2C:
            raise ValueError("an unknown GIF block")
        left, top, fw, fh, flags = struct.unpack("<HHHHB", data[p + 1 : p + 10])
        p, palette = p + 10, shared
        if flags & 0x80:
            n = 3 * 2 ** ((flags & 7) + 1)
            palette, p = np.frombuffer(data[p : p + n], np.uint8).reshape(-1, 3), p + n
        if palette is None:
            raise ValueError("no palette")
        if fw * fh > MOST_PIXELS:
            raise ValueError(f"a frame of {fw} x {fh}")
        stream, after = _blocks(data, p + 1)
        samples = lzw_decode(stream, data[p], fw * fh)[: fw * fh]
        p = after
        if len(samples) < fw * fh:
            raise ValueError("a code stream that ends early")
        samples = samples.reshape(fh, fw)
        if flags & 0x40:
            samples = samples[np.argsort(_interlaced(fh))]
        place = canvas[top : top + fh, left : left + fw]
        kept = place.copy() if disposal == 3 else None
        shown = samples[: place.shape[0], : place.shape[1]]
        colour = np.full((*shown.shape, 4), 255, np.uint8)
        colour[..., :3] = palette[shown]
        if clear_index is None:
            place[...] = colour
        else:
            seen = shown != clear_index
            place[seen] = colour[seen]
        yield {"index": index, "delay_ms": delay, "disposal": disposal, "left": left, "top": top, "width": fw, "height": fh, "canvas": canvas, "indices": samples}
        if disposal == 2:
            place[...] = 0
        elif disposal == 3:
            place[...] = kept
        disposal, delay, clear_index, index = 0, 0, None, index + 1
    if p >= len(data):
        raise ValueError("a file that breaks off")


def colour_histogram(canvas: np.ndarray) -> np.ndarray:
    """Eight bins for each of red, green and blue over the visible pixels."""
    pixels = canvas.reshape(-1, canvas.shape[-1])
    if canvas.shape[-1] == 4 and not pixels[:, 3].all():
        pixels = pixels[pixels[:, 3] > 0]
    return np.concatenate([np.bincount(pixels[:, k] >> 5, minlength=8) for k in range(3)])


FRAME_SCHEMA = "doc_id long, frame int, start_ms long, delay_ms long, width int, height int, rgb binary, histogram array<long>, error string"


def gif_frames(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """A row for each composed frame of GIF columns, with its start time, RGB bytes and colour histogram.

    A null or broken file, also one that breaks in a later frame, breaks off before its trailer or has a code stream that ends early,
    gives one row with `error` and no frame; a file without a frame and an empty table give none; equal rows give equal rows; other
    columns are ignored.
    """
    import pyspark.sql.functions as F

    def run(batches):
        for batch in batches:
            for doc, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, start = [], 0
                try:
                    if data is None:
                        raise ValueError("no media")
                    for f in frames(data):
                        rgb = np.ascontiguousarray(f["canvas"][..., :3])
                        rows.append((doc, f["index"], start, f["delay_ms"], rgb.shape[1], rgb.shape[0], rgb.tobytes(), colour_histogram(f["canvas"]).tolist(), None))
                        start += f["delay_ms"]
                except (ValueError, IndexError, struct.error) as e:
                    rows = [(doc, None, None, None, None, None, None, None, str(e) or type(e).__name__)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _FRAME_TYPES, strict=True)], names=[x.split()[0] for x in FRAME_SCHEMA.split(", ")]) if rows else _NO_FRAMES

    return media.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).alias("media")).mapInArrow(run, FRAME_SCHEMA)


_FRAME_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.string()]
_NO_FRAMES = pa.RecordBatch.from_arrays([pa.array([], t) for t in _FRAME_TYPES], names=[x.split()[0] for x in FRAME_SCHEMA.split(", ")])

OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("n_frames", pa.int32()), ("duration_ms", pa.int64())])


def text_payload(text: bytes) -> bytes:
    return text + b"\0" * ((-len(text)) % WIDTH if text else WIDTH)


def digest(text: bytes) -> tuple:
    """What op1 says of one text: the stored GIF, and what comes out of its composed frames."""
    media = gif_of(text_payload(text))
    payload, histogram, count, duration = [], np.zeros(24, np.int64), 0, 0
    for f in frames(media):
        seen = f["canvas"][f["top"] : f["top"] + f["height"], f["left"] : f["left"] + f["width"]]
        payload.append(np.ascontiguousarray(seen[..., 0]).tobytes())
        histogram += colour_histogram(seen)
        count, duration = count + 1, duration + f["delay_ms"]
    back = b"".join(payload)
    feature = f"{WIDTH}x{len(back) // WIDTH};frames={count};ms={duration};hist=" + ",".join(map(str, histogram[:8].tolist()))
    return len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature, count, duration


def gif_payloads(docs: DataFrame) -> DataFrame:
    """Stores every text as a GIF, reads it back and returns digests and features, a row for each row.

    Null and empty text are one row of 64 zero samples; equal texts give equal values; other columns are ignored.
    """

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for at in range(0, len(texts), 256):
                rows = [digest((t or "").encode()) for t in texts[at : at + 256].to_pylist()]
                yield pa.RecordBatch.from_arrays([ids[at : at + 256], *(pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), list(OUT)[1:], strict=True))], schema=OUT)

    return doc_text(docs).mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames int, duration_ms long")


def op1_gif_media(spark, sf_dir: str) -> DataFrame:
    return gif_payloads(documents(spark, sf_dir))
