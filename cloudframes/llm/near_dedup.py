"""Near-duplicates by bottom-k sketches from one hash function.

Every document's shingles have 64-bit codes; its sketch is the KEEP least of them. Codes choose candidates; shingles are counted and
links verified by the words themselves. Equal shingle sets, by a cryptographic digest of their words, are one class, which its smallest
doc_id stands for. Then

1. inverted lists of the FIRST least codes of each class. Similar sets have SHARED of these in common, so of each class's codes, by
   ascending length of their lists, all but the SHARED - 1 last are enough: two similar classes have one of these in common. Lists
   of up to SHORT classes give candidates among all of their members. Longer lists, such as those of a passage that very many
   documents share, are left only to classes of which they make up a large part.
2. estimates: candidates whose sketches' union doesn't rule out the similarity are left.
3. verification on full sets, of each class's most similar candidates first; of the rest, only pairs in different components.
4. long lists: their members are compared with a few representatives first, which joins most of a group of near copies. That is only
   a head start: then the members' full sets are looked up by the codes of ascending frequency, so many that any two similar sets
   share one, and all members of a list that still are in different components are candidates, in pairs of blocks.

Components come from min-label propagation with pointer jumping over written tables.
"""

import hashlib
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .common import TILE_BYTES, distinct_slices, doc_text, documents, equal_rows, frugal, lowered, mixed, per_doc, range_codes, small, text_tiles, words, written
from .suffix_dedup import packed

SHINGLE, SIMILAR = 5, 75
#: Codes of a sketch, and codes that are looked up in lists.
KEEP, FIRST = 64, 32


def _least(size: int, chance: float) -> int:
    """How many of `size` codes of a union two sets have in common at the similarity that is sought, but for this chance."""
    return next(k for k in range(size) if sum(comb(size, i) * 3**i for i in range(k + 1)) > chance * 4**size)


#: Common codes of two similar classes among the FIRST least of their union.
SHARED = _least(FIRST, 1e-9)
#: What an estimate may be too low by: the chance of a lower one is below 1e-6.
SLACK = 0.75 - _least(KEEP, 1e-6) / KEEP
#: Members of a list up to which all are candidates of each other.
SHORT = 64
#: The head start of longer lists: lists of the least members that a class is compared in, alone and each together with the one of most
#: members, and a list's representatives beside the smallest doc_id and the smallest set, drawn anew for each list.
LONG, DRAWN = 6, 8
#: Of its representatives in one list those that a member is compared with in full.
NEAREST = 3
#: Buckets of each of the two counts of codes in full sets (a power of two); members in a block of an exact list.
COUNTS, BLOCK = 1 << 19, 400
#: Candidates of each class that are verified first; rows for a task of list members; pairs that are
#: estimated at once; the most ids that are broadcast.
BEST, ROWS, CHUNK, BROADCAST_IDS = 2, 10_000, 4_000, 1_000_000


class Shingles:
    """The distinct shingles of each document of a tile, one document after the other (cuts), by 64-bit codes.

    Shingles are compared by their words, and these by their bytes: two with one code are still two. words has a row for each shingle,
    with the numbers of its words in values (-1 where a short document has fewer).
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(offsets) - 1
        lower = lowered(data)
        starts, ends, row = words(lower, offsets)
        number, self.values = distinct_slices(lower, starts, ends)
        _, at, flat = self.values.buffers() if len(self.values) else (None, None, None)
        at = np.frombuffer(at, np.int64)[: len(self.values) + 1] if at is not None else np.zeros(1, np.int64)
        word = (range_codes(np.frombuffer(flat, np.uint8)[: at[-1]], at[:-1], at[1:]) if len(self.values) else np.zeros(0, np.uint64)) & common.CODE
        count = per_doc(row, n)
        first = np.concatenate([[0], np.cumsum(count)])[:-1]
        size = np.where(count >= SHINGLE, SHINGLE, count)
        amount = np.where(count > 0, count - size + 1, 0)
        owner = np.repeat(np.arange(n), amount)
        place = np.repeat(first - np.cumsum(amount) + amount, amount) + np.arange(int(amount.sum()))
        codes, of = np.zeros(len(place), np.uint64), np.full((len(place), SHINGLE), -1, np.int32)
        for k in range(SHINGLE):
            inside = np.flatnonzero(k < size[owner])
            of[inside, k] = number[place[inside] + k]
            codes[inside] = mixed(codes[inside] * np.uint64(0x9E3779B97F4A7C15) + word[of[inside, k]] + np.uint64(k + 1))
        order = np.lexsort((codes, owner))
        self.one_code = False
        codes, owner, of, same = self._ordered(codes, owner, of, order)
        if (same & (of[1:] != of[:-1]).any(1)).any():  # different shingles with one code: in the order of their words' bytes
            self.one_code = True
            rank = np.empty(len(self.values) + 1, np.int64)
            rank[np.asarray(pc.sort_indices(self.values))] = np.arange(len(self.values))
            rank[-1] = -1
            codes, owner, of, same = self._ordered(codes, owner, of, np.lexsort((*rank[of].T[::-1], codes, owner)))
            same &= (of[1:] == of[:-1]).all(1)
        new = np.ones(len(codes), bool)
        new[1:] = ~same
        self.codes, self.words = codes[new], of[new]
        self.cuts = np.concatenate([[0], np.cumsum(per_doc(owner[new], n))])

    @staticmethod
    def _ordered(codes, owner, of, order):
        codes, owner, of = codes[order], owner[order], of[order]
        return codes, owner, of, (codes[1:] == codes[:-1]) & (owner[1:] == owner[:-1])

    def numbers(self) -> np.ndarray:
        """A number for each shingle, the same for equal ones in different documents only."""
        order, same = equal_rows(list(self.words.T), self.codes)
        out = np.empty(len(order), np.int64)
        out[order] = np.cumsum(~same)
        return out

    def digests(self):
        """Of each document's set 128 bits of BLAKE2b over its shingles' words in order, each word by such a digest of its bytes."""
        of_word = [hashlib.blake2b(w, digest_size=16).digest() for w in self.values.to_pylist()]
        table = np.frombuffer(b"".join([*of_word, bytes(16)]), np.uint64).reshape(-1, 2)
        for a, b in zip(self.cuts[:-1].tolist(), self.cuts[1:].tolist(), strict=True):
            yield hashlib.blake2b(table[self.words[a:b]].tobytes(), digest_size=16).digest()


def sketches(batches):
    """doc_id, n_shingles, set digest, the first codes, and the sketch as the upper 32 bits of its codes."""
    for batch in batches:
        for i, j, data, offsets in text_tiles(batch.column(1)):
            sets = Shingles(data, offsets)
            rows = []
            for a, b, digest in zip(sets.cuts[:-1].tolist(), sets.cuts[1:].tolist(), sets.digests(), strict=True):
                low = np.unique(sets.codes[a:b])[:KEEP] if sets.one_code else sets.codes[a : min(b, a + KEEP)]
                rows.append((b - a, digest, low.view(np.int64).tolist(), (low >> np.uint64(32)).astype("<u4").tobytes()))
            n, digest, first, sketch = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(first, pa.list_(pa.int64())), pa.array(sketch, pa.binary())], names=["doc_id", "n", "digest", "first", "sketch"])


SKETCH_DDL = "doc_id long, n long, digest binary, first array<long>, sketch binary"
PAIR_DDL = "a long, b long, estimate double"
_PAD = 1 << 32


def _matrix(column: list[bytes]) -> np.ndarray:
    """Sketches as rows; short ones, which hold the whole set, are filled up with values that equal nothing."""
    out = np.full((len(column), KEEP), _PAD, np.int64)
    for k, x in enumerate(column):
        s = np.frombuffer(x, "<u4")
        out[k, : len(s)] = s
    return out


def estimates(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(Jaccard estimates, whether exact) of rows of two matrices of sketches, from the KEEP least codes of their union."""
    both = np.sort(np.concatenate([x, y], 1), axis=1)
    again = np.zeros(both.shape, bool)
    again[:, 1:] = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] < _PAD)
    rank = np.cumsum(~again & (both < _PAD), axis=1)
    size = np.minimum(rank[:, -1], KEEP)
    return (again & (rank <= KEEP)).sum(1) / np.maximum(size, 1), (x[:, -1] == _PAD) & (y[:, -1] == _PAD)


def _likely(x, y, nx, ny) -> tuple[np.ndarray, np.ndarray]:
    value, exact = estimates(x, y)
    return value, (100 * np.minimum(nx, ny) >= SIMILAR * np.maximum(nx, ny)) & (value >= np.where(exact, SIMILAR / 100 - 1e-9, SIMILAR / 100 - SLACK))


def _pairs(a: np.ndarray, b: np.ndarray, value: np.ndarray) -> pa.Table:
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    real = lo < hi
    return pa.table({"a": lo[real], "b": hi[real], "estimate": value[real]})


def list_pairs(table: pa.Table) -> pa.Table:
    """Candidates among the members of short lists; a table holds whole lists."""
    code, doc, n = (np.asarray(table.column(c)) for c in ("code", "doc", "n"))
    order = np.lexsort((doc, code))
    code, doc, n = code[order], doc[order], n[order]
    sketch = _matrix(table.column("sketch").take(pa.array(order)).to_pylist())
    cuts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1], [True]]))
    found: list = []
    held: list = []
    size = 0

    def flush():
        i, j = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
        value, good = _likely(sketch[i], sketch[j], n[i], n[j])
        found.append(np.stack([doc[i[good]], doc[j[good]]]))
        values.append(value[good])

    values: list = []
    for p, q in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if q - p > 1:
            i, j = np.triu_indices(q - p, 1)
            held.append((i + p, j + p))
            size += len(i)
            if size > CHUNK:
                flush()
                held, size = [], 0
    if held:
        flush()
    if not found:
        return _pairs(doc[:0], doc[:0], np.zeros(0))
    pairs, value = np.concatenate(found, 1), np.concatenate(values)
    lo, hi = pairs.min(0), pairs.max(0)
    order = np.lexsort((hi, lo))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(lo[order]) != 0) | (np.diff(hi[order]) != 0)
    return _pairs(lo[order][new], hi[order][new], value[order][new])


def star_pairs(batches):
    """Candidates of members of long lists with the lists' representatives."""
    for batch in batches:
        doc, n, sketch = np.asarray(batch.column("doc")), np.asarray(batch.column("n")), _matrix(batch.column("sketch").to_pylist())
        reps = batch.column("reps")
        size = np.diff(np.asarray(reps.offsets))
        flat = reps.flatten()
        other, other_n, other_sketch = np.asarray(flat.field("doc")), np.asarray(flat.field("n")), _matrix(flat.field("sketch").to_pylist())
        row, at = np.repeat(np.arange(len(doc)), size), np.arange(len(other))
        for k in range(0, len(row), CHUNK):
            i, j = row[k : k + CHUNK], at[k : k + CHUNK]
            pair, once = np.unique(np.stack([doc[i], other[j]]), axis=1, return_index=True)
            i, j = i[once], j[once]
            value, good = _likely(sketch[i], other_sketch[j], n[i], other_n[j])
            # of a member's representatives in a list its nearest ones; the exact look-up knows of none of the others
            i, value, pair = i[good], value[good], pair[:, good]
            order = np.lexsort((-value, i))
            first = np.flatnonzero(np.concatenate([[True], np.diff(i[order]) != 0])) if len(order) else order
            near = order[np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order)))) < NEAREST]
            yield from _pairs(pair[0, near], pair[1, near], value[near]).to_batches()


def verified(batches):
    """Pairs whose full sets of shingles are similar enough, compared by their words."""
    expand = zstandard.ZstdDecompressor()
    for batch in batches:
        a, b = np.asarray(batch.column("a")), np.asarray(batch.column("b"))
        keep = np.zeros(len(a), bool)
        texts: list[bytes] = []
        size, begin = 0, 0
        for k in range(len(a)):
            texts += [expand.decompress(batch.column(c)[k].as_py()) for c in ("packed_a", "packed_b")]
            size += len(texts[-1]) + len(texts[-2])
            if size >= 2 * TILE_BYTES or k == len(a) - 1:
                sets = Shingles(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64))
                number, cuts = sets.numbers(), sets.cuts
                for p in range(k + 1 - begin):
                    x, y = (number[cuts[2 * p + q] : cuts[2 * p + q + 1]] for q in (0, 1))
                    common_ones = len(np.intersect1d(x, y, assume_unique=True))
                    keep[begin + p] = len(x) + len(y) > 0 and 100 * common_ones >= SIMILAR * (len(x) + len(y) - common_ones)
                texts, size, begin = [], 0, k + 1
        yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs (a, b) that are similar on full sets; texts: doc_id, packed."""
    of = lambda side: texts.select(F.col("doc_id").alias(side), F.col("packed").alias(f"packed_{side}"))
    return written(pairs.select("a", "b").join(of("b"), "b").join(of("a"), "a").mapInArrow(frugal(verified), "a long, b long"), "near-links").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, label) of all nodes of links (a, b); label is the smallest node that can be reached.

    Each round takes the least label of all neighbours, then the label's own label; rounds grow with the logarithm of the longest
    path. A node's neighbours are merged before they are shuffled, and labels meet links in joins that Spark splits at hot keys.
    """
    both = written(links.select("a", "b").union(links.select("b", "a")).toDF("node", "other").distinct(), "near-both")
    labels = written(both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("label")), "near-labels")
    while True:
        near = both.join(labels.toDF("other", "of"), "other").groupBy("node").agg(F.min("of").alias("of"))
        step = labels.join(near, "node", "left").select("node", "label", F.least("label", "of").alias("lower"))
        up = labels.toDF("lower", "top")
        moved = written(step.join(up, "lower", "left").select("node", F.col("label").alias("was"), F.least("lower", "top").alias("label")), "near-labels")
        labels = moved.select("node", "label")
        if moved.where("was <> label").isEmpty():
            return labels


def lists_of(classes: DataFrame) -> DataFrame:
    """Classes (doc, n, sketch) with the codes by which they must be looked up: `rare` ones of short lists, and keys of `long` ones.

    A class of n < FIRST codes shares at least 3n/4 of them with a similar one. Codes that no other class has come first in order, so
    of the shared ones all but the SHARED - 1 last remain. Long keys are the LONG lists of least members, alone and each together
    with the one of most members: in a list of those that hold both, a smallest set is nearer to all; each with its number of tasks.
    """
    codes = classes.select("doc", F.explode(F.slice("first", 1, FIRST)).alias("code"))
    shared = codes.groupBy("code").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    mine = codes.join(shared, "code").groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("members", "code"))).alias("of"))
    rows = classes.select("doc", "n", "sketch").join(mine, "doc")
    needed = F.greatest(F.size("of") - F.least(F.lit(SHARED), F.ceil(F.col("n") * 3 / 4).cast("int")) + 1, F.lit(0))
    rows = rows.withColumn("of", F.slice("of", 1, needed)).where(F.size("of") > 0)
    key = lambda x, code: F.struct(code.alias("code"), F.ceil(x["members"] / ROWS).cast("int").alias("tasks"))
    common = F.element_at("long", -1)["code"]
    least = F.slice("long", 1, LONG)
    keys = F.array_distinct(F.concat(F.transform(least, lambda x: key(x, x["code"])), F.transform(least, lambda x: key(x, F.xxhash64(x["code"], common)))))
    return rows.select(
        "doc", "n", "sketch", F.transform(F.filter("of", lambda x: x["members"] <= SHORT), lambda x: x["code"]).alias("rare"),
        F.filter("of", lambda x: x["members"] > SHORT).alias("long"),
    ).withColumn("long", F.when(F.size("long") > 0, keys))


def candidates(lists: DataFrame) -> DataFrame:
    """(a, b, estimate) of all pairs that short lists and representatives of long ones give and the sketches don't rule out."""
    member = F.struct("doc", "n", "sketch")
    total = lists.agg(F.sum(F.size("rare"))).first()[0] or 0
    buckets = max(16, -(-total // ROWS))
    short = lists.select(F.explode("rare").alias("code"), "doc", "n", "sketch").withColumn("bucket", F.pmod("code", F.lit(buckets)).cast("int"))
    near = short.groupBy("bucket").applyInArrow(frugal(list_pairs), PAIR_DDL)
    long = lists.where(F.col("long").isNotNull()).select(F.explode("long").alias("key"), "doc", "n", "sketch").select("key.code", "key.tasks", "doc", "n", "sketch")
    drawn = [F.min(F.struct(F.xxhash64("doc", "code", F.lit(k)).alias("by"), member.alias("m")))["m"] for k in range(DRAWN)]
    reps = long.groupBy("code", "tasks").agg(F.array_distinct(F.array(F.min(F.struct("doc", member.alias("m")))["m"], F.min(F.struct("n", "doc", member.alias("m")))["m"], *drawn)).alias("reps"))
    # a list's members are dealt out to tasks of about ROWS each, the representatives go to all of them
    reps = reps.withColumn("task", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1))).drop("tasks")
    dealt = long.withColumn("task", F.pmod(F.xxhash64("doc"), F.col("tasks")).cast("int")).drop("tasks")
    star = dealt.join(reps, ["code", "task"]).select("doc", "n", "sketch", "reps").mapInArrow(frugal(star_pairs), PAIR_DDL)
    return near.union(star).groupBy("a", "b").agg(F.max("estimate").alias("estimate"))


def _buckets(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of codes in the two counts, which lie one after the other."""
    low = np.uint64(COUNTS - 1)
    return (codes & low).astype(np.int64), ((codes >> np.uint64(32)) & low).astype(np.int64) + COUNTS


def code_counts(batches):
    """(bucket, count) of all codes of texts in a task."""
    total = np.zeros(2 * COUNTS, np.int64)
    for batch in batches:
        for _, _, data, offsets in text_tiles(batch.column(1)):
            for at in _buckets(Shingles(data, offsets).codes):
                total += np.bincount(at, minlength=2 * COUNTS)
    some = np.flatnonzero(total)
    for k in range(0, len(some), 100_000):
        at = some[k : k + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "count"])


def prefixes(counts: np.ndarray):
    """A function of batches (doc_id, text) to (code, doc, n, place): the first codes of each full set by ascending count.

    Two sets of n >= m codes with a similarity of 3/4 share at least 3n/4 and 6m/7, so the first code that they share is among the
    first n/4 + 1 of the larger and m/7 + 1 of the smaller set, in any order of codes. The counts are never too low, so a code that is
    counted once is in one set alone.
    """

    def of(batches):
        for batch in batches:
            for i, j, data, offsets in text_tiles(batch.column(1)):
                sets = Shingles(data, offsets)
                codes, cuts = sets.codes, sets.cuts
                size = np.diff(cuts)
                owner = np.repeat(np.arange(j - i), size)
                first, second = _buckets(codes)
                often = np.minimum(counts[first], counts[second])
                order = np.lexsort((codes, often, owner))
                place = np.arange(len(codes)) - cuts[:-1][owner]
                keep = (place <= size[owner] // 4) & (often[order] > 1)
                doc = np.asarray(batch.column(0).slice(i, j - i))[owner[keep]]
                yield pa.RecordBatch.from_arrays([pa.array(codes[order][keep].view(np.int64)), pa.array(doc), pa.array(size[owner[keep]]), pa.array(place[keep])], names=["code", "doc", "n", "place"])

    return of


def block_pairs(table: pa.Table) -> pa.Table:
    """Pairs (a, b) of members of exact lists that can be similar and have different labels; a table holds whole pairs of blocks."""
    names = ("code", "band", "i", "j", "doc", "n", "place", "label", "block", "own")
    order = np.lexsort([np.asarray(table.column(c)) for c in ("n", "j", "i", "band", "code")])
    code, band, i, j, doc, n, place, label, block, own = (np.asarray(table.column(c))[order] for c in names)
    new = (code[1:] != code[:-1]) | (band[1:] != band[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
    cuts = np.flatnonzero(np.concatenate([[True], new, [True]]))
    found: list = [np.zeros((2, 0), np.int64)]
    held, size = [], 0

    def flush():
        x, y = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
        # x is the smaller set; what they share after this code, if it is the first one, must be enough
        good = (label[x] != label[y]) & ((block[x] != block[y]) | (i[x] == j[x])) & own[x] & (place[x] <= n[x] // 7) & (100 * n[x] >= SIMILAR * n[y])
        good &= 7 * np.minimum(n[x] - place[x], n[y] - place[y]) >= 3 * (n[x] + n[y])
        # sets of one size can have either role, and then both places are small enough
        a, b = doc[x[good]], doc[y[good]]
        found.append(np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1))

    for p, q in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if q - p > 1 and (label[p:q] != label[p]).any():
            x, y = np.triu_indices(q - p, 1)
            held.append((x + p, y + p))
            size += len(x)
            if size > 100 * CHUNK:
                flush()
                held, size = [], 0
    if held:
        flush()
    a, b = np.unique(np.concatenate(found, 1), axis=1)
    return pa.table({"a": a, "b": b})


def likely_pairs(batches):
    """Pairs (a, b, na, nb, sketch_a, sketch_b) that their sketches don't rule out."""
    for batch in batches:
        for k in range(0, batch.num_rows, CHUNK):
            part = batch.slice(k, CHUNK)
            a, b, na, nb = (np.asarray(part.column(c)) for c in ("a", "b", "na", "nb"))
            value, good = _likely(_matrix(part.column("sketch_a").to_pylist()), _matrix(part.column("sketch_b").to_pylist()), na, nb)
            yield from _pairs(a[good], b[good], value[good]).to_batches()


def exact_candidates(common: DataFrame, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b, estimate) of classes common (doc, n, sketch) in different components that share a code which similar sets must share."""
    mine = docs.join(small(common.select(F.col("doc").alias("doc_id")), BROADCAST_IDS), "doc_id").select("doc_id", "text")
    counted = mine.mapInArrow(frugal(code_counts), "bucket int, count long").groupBy("bucket").agg(F.sum("count").alias("count")).toArrow()
    counts = np.zeros(2 * COUNTS, np.int64)
    counts[np.asarray(counted.column("bucket"))] = np.asarray(counted.column("count"))
    label_of = common.select("doc").join(labels.toDF("doc", "label"), "doc", "left").select("doc", F.coalesce("label", "doc").alias("label"))
    firsts = mine.mapInArrow(frugal(prefixes(counts)), "code long, doc long, n long, place long")
    rows = written(firsts.join(small(written(label_of, "near-label-of"), BROADCAST_IDS), "doc"), "near-prefixes")
    # codes whose members all are in one component already have nothing to look up
    open_codes = rows.groupBy("code").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l < h").select("code")
    rows = rows.join(open_codes, "code", "left_semi")
    # a set is at most a third larger than a similar one, so it lies in the same band of sizes or the next: each band's list holds both
    band = F.floor(F.log("n") / F.log(F.lit(4 / 3))).cast("int")
    rows = rows.select("code", "doc", "n", "place", "label", F.explode(F.array(F.struct(band.alias("band"), F.lit(True).alias("own")), F.struct((band - 1).alias("band"), F.lit(False).alias("own")))).alias("at")).select("*", "at.*").drop("at")
    lists = rows.groupBy("code", "band").agg(F.count(F.lit(1)).alias("members"), F.min("label").alias("l"), F.max("label").alias("h"), F.bool_or("own").alias("any")).where("l < h and any")
    lists = written(lists.select("code", "band", "members", F.ceil(F.col("members") / BLOCK).alias("blocks")), "near-exact-lists")
    block = rows.join(lists.drop("members"), ["code", "band"]).withColumn("block", F.pmod(F.xxhash64("doc", "code"), "blocks"))
    dealt = block.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select("code", "band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "doc", "n", "place", "label", "block", "own")
    members = lists.agg(F.sum(F.col("members") * F.col("blocks"))).first()[0] or 0
    buckets = max(16, -(-members // (4 * ROWS)))
    pairs = dealt.withColumn("bucket", F.pmod(F.xxhash64("code", "band", "i", "j"), F.lit(buckets)).cast("int")).groupBy("bucket").applyInArrow(frugal(block_pairs), "a long, b long")
    pairs = written(pairs.distinct(), "near-exact-pairs")
    of = lambda s: common.select(F.col("doc").alias(s), F.col("n").alias(f"n{s}"), F.col("sketch").alias(f"sketch_{s}"))
    return pairs.join(of("b"), "b").join(of("a"), "a").mapInArrow(frugal(likely_pairs), PAIR_DDL)


def linked(likely: DataFrame, docs: DataFrame, links: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(links, labels) after verifying candidates likely (a, b, estimate), beside links that are there already."""
    needed = written(likely.select("a").union(likely.select("b")).toDF("doc_id").distinct(), "near-needed")
    texts = written(docs.join(small(needed, BROADCAST_IDS), "doc_id").select("doc_id", "text").mapInArrow(frugal(packed), "doc_id long, packed binary"), "near-texts")
    by_estimate = Window.partitionBy("b").orderBy(F.desc("estimate"), "a")
    best = likely.withColumn("place", F.row_number().over(by_estimate)).where(F.col("place") <= BEST)
    found = verify(best, texts)
    links = found if links is None else links.union(found)
    labels = components(links)
    tried = best.select("a", "b")
    label_of = lambda side: labels.select(F.col("node").alias(side), F.col("label").alias(f"label_{side}"))
    rest = likely.join(tried, ["a", "b"], "left_anti").join(label_of("a"), "a", "left").join(label_of("b"), "b", "left")
    rest = rest.where(F.coalesce("label_a", "a") != F.coalesce("label_b", "b"))
    more = verify(rest, texts)
    if not more.isEmpty():
        links = links.union(more)
        labels = components(links)
    return links, labels


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, a row for each row of docs (doc_id, text).

    Sets of five-word shingles of lower-cased texts; fewer words are one shingle; texts without a word, null ones too, have none
    and are linked with nothing. Sets with a similarity of 0.75 or more are linked. Rows with equal doc_id are one document; a null
    doc_id is less than all others; an empty table gives no rows; other columns are ignored.
    """
    docs = doc_text(docs).select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"), "text")
    sketched = written(docs.mapInArrow(frugal(sketches), SKETCH_DDL), "near-sketches")
    classes = written(sketched.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("doc"), *[F.first(c).alias(c) for c in ("n", "first", "sketch")]), "near-classes")
    lists = written(lists_of(classes), "near-lists")
    likely = written(candidates(lists), "near-candidates")
    links, labels = linked(likely, docs)
    common = lists.where(F.col("long").isNotNull()).select("doc", "n", "sketch")
    if not common.isEmpty():
        # of the candidates before, all pairs in different components were verified and aren't similar
        beyond = written(exact_candidates(common, docs, labels).join(likely.select("a", "b"), ["a", "b"], "left_anti"), "near-exact")
        if not beyond.isEmpty():
            links, labels = linked(beyond, docs, links)
    of_class = classes.select("digest", "doc").join(labels.toDF("doc", "label"), "doc", "left").select("digest", F.coalesce("label", "doc").alias("component"))
    result = sketched.select("doc_id", "n", "digest").join(of_class, "digest", "left")
    own = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    given = lambda c: F.when(c > -(1 << 63), c)
    return result.select(given(F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"), given(own).alias("component_id"), (F.col("doc_id") == own).alias("kept"))


def op10_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def stage_near_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest doc_id; null and empty texts and other columns stay.

    Rows of one doc_id are one document: all rows of a kept one stay, those with a null doc_id too, and equal texts under other ids go.
    An empty table gives no rows.
    The ids that go are broadcast where their counted number is within BROADCAST_IDS, else both sides are shuffled.
    """
    gone = written(near_duplicates(docs).where(~F.col("kept")).select(F.col("doc_id")).distinct(), "near-gone")
    return docs.join(small(gone, BROADCAST_IDS), "doc_id", "left_anti").select(*docs.columns)


#: The links of all pairs that share a shingle, and all documents that each one reaches.
OP10_SQL = r"""
WITH RECURSIVE ws AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS sh FROM ws),
n AS (SELECT doc_id, len(sh) AS n FROM s),
e AS (SELECT doc_id, unnest(sh) AS g FROM s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM e x JOIN e y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS label FROM n UNION SELECT b, label FROM r JOIN both_ways ON r.doc_id = a)
SELECT doc_id, n AS n_shingles, min(label) AS component_id, min(label) = doc_id AS kept FROM n JOIN r USING (doc_id) GROUP BY doc_id, n
"""
