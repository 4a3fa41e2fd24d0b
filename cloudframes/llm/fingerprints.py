"""Document fingerprints by consistent weighted sampling: the rate at which two signatures agree is their generalised Jaccard similarity.

A document's terms are its pairs of neighbouring words, in lower case (the word itself if it has one alone); a term's weight is its
count. For each of SAMPLES, every term has its own r and c of a gamma distribution of shape two, and a uniform b, all of them functions
of the term and the sample alone. With t = floor(ln w / r + b), the term of least c exp(-r (t - b + 1)) is drawn together with its t.
Two documents draw the same with a chance of sum of lesser weights over sum of greater weights (Ioffe's scheme).

Terms and weights that a tile of texts has in common are sampled once, and signatures are minima over a document's rows of that table.
For the edited texts, documents are dealt out and sorted by doc_id, so that a document and the next one meet in one task's stream; only
the first and the last document of each partition meet in a second, small step.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch_of, doc_text, documents, frugal, ids_of, lowered, mixed, range_codes, text_bytes, tiles, words, written

#: Samples of a signature, each kept as 16 bits (so two different ones agree with a chance of 1/65,536).
SAMPLES = 64
#: Terms that are sampled at once, rows of minima at once, and bytes of a tile.
TERMS, ROWS, TILE = 512, 2_048, 1 << 19
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def weighted_terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, code, weight) of the distinct terms of each document of a tile, by owner."""
    data = lowered(data)
    starts, ends, row = words(data, offsets)
    word = range_codes(data, starts, ends)
    inside = row[1:] == row[:-1]
    pairs = mixed(word[:-1] * _A + word[1:])[inside] if len(word) else word
    alone = np.ones(len(row), bool)
    alone[1:] &= ~inside
    alone[:-1] &= ~inside
    owner, code = np.concatenate([row[:-1][inside], row[alone]]) if len(row) else row, np.concatenate([pairs, mixed(word[alone])])
    order = np.lexsort((code, owner))
    owner, code = owner[order], code[order]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return owner[at], code[at], np.diff(np.append(at, len(code)))


def gamma_levels(bits: int = 16) -> np.ndarray:
    """Quantiles of the gamma distribution of shape two at the middles of 2**bits equal steps, by bisection."""
    level = (np.arange(1 << bits) + 0.5) / (1 << bits)
    low, high = np.zeros(len(level)), np.full(len(level), 64.0)
    for _ in range(60):
        x = (low + high) / 2
        below = 1 - (1 + x) * np.exp(-x) < level
        low, high = np.where(below, x, low), np.where(below, high, x)
    return (low + high) / 2


_LEVELS = gamma_levels()
_R, _LOG_C = _LEVELS.astype(np.float32), np.log(_LEVELS).astype(np.float32)
_SAMPLE = mixed(np.arange(1, SAMPLES + 1, dtype=np.uint64) * _B)


def draws(code: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """A row for each term and a column for each sample: an integer whose order is that of the sampled values and whose last 16 bits
    name the term and its t. r and c are drawn by level from 2**16 quantiles, b has 32 bits."""
    h = code[:, None] ^ _SAMPLE
    h *= _C
    h ^= h >> np.uint64(32)
    h *= _B
    h ^= h >> np.uint64(29)
    r = _R[h & np.uint64(0xFFFF)]
    value = _LOG_C[(h >> np.uint64(16)) & np.uint64(0xFFFF)]
    b = (h >> np.uint64(32)).astype(np.float32)
    b *= np.float32(2.0**-32)
    name = h * _A
    many = np.flatnonzero(weight > 1)
    if len(many):  # ln 1 / r + b is under 1, so t is 0 for the others
        t = np.floor(np.log(weight[many].astype(np.float32))[:, None] / r[many] + b[many])
        b[many] -= t
        name[many] += t.astype(np.int64).view(np.uint64) * _B
    b -= np.float32(1)
    b *= r
    value += b
    order = value.view(np.int32)
    order ^= (order >> 31) & np.int32(0x7FFFFFFF)
    return (order.astype(np.int64) << 16) | (name >> np.uint64(48)).view(np.int64)


def signatures(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """For each document 16 bits of each sample; no bytes for a document without a word."""
    owner, code, weight = weighted_terms(data, offsets)
    out = [b""] * (len(offsets) - 1)
    if not len(owner):
        return out
    pair, place = _distinct(code, weight)
    table = np.concatenate([draws(pair[0][k : k + TERMS], pair[1][k : k + TERMS]) for k in range(0, len(pair[0]), TERMS)])
    cuts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1], [True]]))
    i = 0
    while i < len(cuts) - 1:
        j = max(i + 1, int(np.searchsorted(cuts, cuts[i] + ROWS, side="right")) - 1)
        if cuts[j] - cuts[i] <= ROWS:
            least = np.minimum.reduceat(table[place[cuts[i] : cuts[j]]], cuts[i:j] - cuts[i], axis=0)
        else:  # a long document
            least = np.stack([table[place[k : k + ROWS][: cuts[j] - k]].min(0) for k in range(cuts[i], cuts[j], ROWS)]).min(0)[None]
        for k, x in zip(owner[cuts[i:j]].tolist(), (least & 0xFFFF).astype("<u2"), strict=True):
            out[k] = x.tobytes()
        i = j
    return out


def _distinct(code: np.ndarray, weight: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """Distinct (code, weight), and where each row's is."""
    order = np.lexsort((weight, code))
    c, w = code[order], weight[order]
    new = np.ones(len(c), bool)
    new[1:] = (c[1:] != c[:-1]) | (w[1:] != w[:-1])
    place = np.empty(len(c), np.int64)
    place[order] = np.cumsum(new) - 1
    return (c[new], w[new]), place


def likeness(x: bytes, y: bytes) -> float:
    """The share of equal samples; of documents without a word 1 among themselves, 0 to all others."""
    if not x or not y:
        return float(x == y)
    return float((np.frombuffer(x, "<u2") == np.frombuffer(y, "<u2")).mean())


def edited(text: bytes, after: bytes) -> tuple[int, bytes]:
    """(code points of text, text with its last third replaced by the first as many code points of after)."""
    points = np.flatnonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
    n, third = len(points), len(points) // 3
    if not third:
        return n, text
    head = np.frombuffer(after, np.uint8)[: 4 * third]
    starts = np.flatnonzero((head & 0xC0) != 0x80)
    return n, text[: points[n - third]] + (after[: starts[third]] if len(starts) > third else after[: 4 * third])


RESULT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
RESULT_DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
PLACED = pa.schema([*RESULT, ("part", pa.int32()), ("first", pa.bool_()), ("text", pa.binary())])
_NULL = -(1 << 63)


def _flat(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def _signed(texts: list[bytes]) -> list[bytes]:
    data, offsets = _flat(texts)
    return [x for i, j in tiles(offsets, TILE) for x in signatures(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])]


def _results(ids: list[int], texts: list[bytes], after: list[bytes]) -> list:
    """Columns of RESULT for documents and those after them; only the last of these isn't among texts."""
    changed = [edited(t, a) for t, a in zip(texts, after, strict=True)]
    n = len(texts)
    signed = _signed([x for t, (_, c) in zip(texts, changed, strict=True) for x in (t, c)] + [after[-1]])
    own, other = signed[0::2], signed[1::2]
    return [pa.array([None if i == _NULL else i for i in ids], pa.int64()), [k for k, _ in changed], [hashlib.sha256(c).hexdigest() for _, c in changed], own[:n], other, [likeness(x, y) for x, y in zip(own, other, strict=False)], [likeness(x, y) for x, y in zip(own, own[1:], strict=False)]]


def in_order(batches):
    """Results of all documents of a sorted partition but its last; its first and its last one come with their texts."""
    part, held = TaskContext.get().partitionId(), None
    edge = lambda i, t, first: batch_of(PLACED, [*[pa.array([v], k.type) for v, k in zip((None if i == _NULL else i, None, None, None, None, None, None), RESULT, strict=True)], [part], [first], [t]])
    for batch in batches:
        ids, (data, offsets) = ids_of(batch), text_bytes(batch.column(1))
        for i, j in tiles(offsets, TILE):
            texts = [data[offsets[k] : offsets[k + 1]].tobytes() for k in range(i, j)]
            number = ids[i:j].tolist()
            if held is None:
                yield edge(number[0], texts[0], True)
            else:
                number, texts = [held[0], *number], [held[1], *texts]
            n = len(number) - 1
            held = number[n], texts[n]
            if n:
                yield batch_of(PLACED, [*_results(number[:n], texts[:n], texts[1:]), pa.nulls(n, pa.int32()), pa.nulls(n, pa.bool_()), pa.nulls(n, pa.binary())])
    if held is not None:
        yield edge(held[0], held[1], False)


def at_edges(batches):
    """Results of the last documents of partitions: doc_id, text, after."""
    for batch in batches:
        for k in range(batch.num_rows):
            text, after = batch.column("text")[k].as_py(), batch.column("after")[k].as_py()
            yield batch_of(RESULT, _results([_NULL if (i := batch.column("doc_id")[k].as_py()) is None else i], [text], [after]))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """The columns of op12, a row for each row of docs (doc_id, text): fingerprints of every text and of its edited text.

    The next document is the one of next lower doc_id, a null doc_id comes last, rows of one doc_id follow by a hash of their texts, then
    by the texts; after the last comes the first, so a table of one row is followed by itself. Null texts are empty; texts without a
    word have an empty fingerprint, like only each other; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    few = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64(F.coalesce("text", F.lit(""))), F.coalesce("text", F.lit(""))]
    placed = doc_text(docs).repartitionByRange(few, *order[:2]).sortWithinPartitions(*order).mapInArrow(frugal(in_order), f"{RESULT_DDL}, part int, first boolean, text binary")
    placed = written(placed, "fingerprints")
    edges = placed.where(F.col("part").isNotNull())
    # at most as many numbers as there are partitions
    parts = sorted(r.part for r in edges.where("first").select("part").collect())
    after = {p: q for p, q in zip(parts, parts[1:] + parts[:1], strict=True)}
    whole = placed.where(F.col("part").isNull()).select(*RESULT.names)
    if not parts:
        return whole
    follows = spark.createDataFrame(list(after.items()), "part int, next int")
    heads = edges.where("first").select(F.col("part").alias("next"), F.col("text").alias("after"))
    pairs = edges.where("not first").select("doc_id", "text", "part").join(F.broadcast(follows), "part").join(heads, "next").select("doc_id", "text", "after")
    return whole.union(pairs.mapInArrow(frugal(at_edges), RESULT_DDL))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (binary, two bytes a sample) of every text, a map without an exchange; cases as in edited_fingerprints."""

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for i, j in tiles(offsets, TILE):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(signatures(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), pa.binary())], names=["doc_id", "fingerprint"])

    return doc_text(docs).mapInArrow(frugal(run), "doc_id long, fingerprint binary")


def similarity(x: Column, y: Column) -> Column:
    """The likeness of two fingerprints as a column expression: equal pairs of bytes among all."""
    at = F.sequence(F.lit(1), F.lit(2 * SAMPLES - 1), F.lit(2))
    equal = F.aggregate(at, F.lit(0), lambda n, k: n + (F.substring(x, k, F.lit(2)) == F.substring(y, k, F.lit(2))).cast("int"))
    empty = (F.length(x) == 0) | (F.length(y) == 0)
    return F.when(empty, (F.length(x) == F.length(y)).cast("double")).otherwise(equal / F.lit(SAMPLES))


def op12_fingerprints(spark, sf_dir: str) -> DataFrame:
    rows = edited_fingerprints(documents(spark, sf_dir))
    return rows.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})
