"""Groups of spelling variants by blocked Gram matrices of letter counts.

1. Runs of letters are counted inside tasks, then by word. What is left is the vocabulary, far smaller than the text.
2. A word's letters fall into a few groups of about equal weight, and its counts by group are its cell; words of one cell have one
   length. Two words at one edit are in one cell, or differ by a letter that moved from one group to another (equal lengths) or by one
   letter more (adjacent lengths): so a cell meets only these neighbours, each pair of cells once. The number of groups rises with the
   logarithm of the vocabulary, so cells stay small.
3. Cells are cut into blocks of words. For two blocks with letter counts X and Y, the squared distances are |x|^2 + |y|^2 - 2 X Y^T; one
   edit changes them by at most two. Pairs within two are verified letter by letter.
4. A word's best partners are merged within a task before they are exchanged; roots come from pointer jumping over written tables.
"""

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, distinct_slices, doc_text, documents, frugal, lowered, text_tiles, written

#: Least code points and occurrences of a word; one run in MODULUS of a document loses a code point; a form is RATIO times as frequent.
LEAST_CHARS, LEAST_COUNT, MODULUS, RATIO = 7, 2, 31, 10
#: Words and bytes of a block; counted words that a task holds; letters that are compared at once.
BLOCK, BLOCK_BYTES, HELD, COMPARED = 1024, 1 << 20, 250_000, 4 << 20
_LETTERS = np.concatenate([np.arange(97, 123), np.arange(0xC0, 0x100)])
_COLUMN = np.zeros(256, np.int64)
_COLUMN[_LETTERS] = np.arange(len(_LETTERS))
_IS_LETTER = np.zeros(256, bool)
_IS_LETTER[97:123] = True
_IS_LETTER[0xC3] = True  # the first byte of all of U+00C0 to U+00FF


# --- counting
def letter_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, code points and document rows of the maximal runs of letters of lower-cased bytes."""
    wide = np.zeros(len(data) + 1, bool)
    wide[1:] = data == 0xC3
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = _IS_LETTER[data] | wide[:-1]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside[:-1]
    starts, ends = np.flatnonzero(inside & (~before | cut)), np.flatnonzero(before & (~inside | cut))
    second = np.concatenate([[0], np.cumsum(wide[: len(data)])])
    return starts, ends, ends - starts - (second[ends] - second[starts]), np.searchsorted(offsets, starts, side="right") - 1


_CRC = np.array([zlib.crc32(bytes([k])) for k in range(256)], np.uint32)
_CRC ^= _CRC[0]  # the table of a step by one byte
_SHIFTS: dict[int, np.ndarray] = {}


def _shift(length: int) -> np.ndarray:
    """Four tables by which a checksum is carried over so many bytes: what it adds to the checksum of bytes that follow."""
    if length not in _SHIFTS:
        basis = np.uint32(1) << np.arange(32, dtype=np.uint32)
        for _ in range(length):
            basis = _CRC[basis & np.uint32(0xFF)] ^ (basis >> np.uint32(8))
        bit = (np.arange(256)[:, None] >> np.arange(8)) & 1
        _SHIFTS[length] = np.stack([np.bitwise_xor.reduce(np.where(bit == 1, basis[8 * k : 8 * k + 8], np.uint32(0)), axis=1) for k in range(4)])
    return _SHIFTS[length]


def joined_crc(first: np.ndarray, second: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Checksums of first bytes followed by second ones, from the checksums of both and the second ones' lengths."""
    out = np.empty(len(first), np.uint32)
    for length in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == length)
        t, x = _shift(length), first[at]
        out[at] = t[0][x & 0xFF] ^ t[1][(x >> 8) & 0xFF] ^ t[2][(x >> 16) & 0xFF] ^ t[3][x >> 24] ^ second[at]
    return out


def tile_words(ids: list, data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(words, counts) of a tile, after the deletions; a word may come twice."""
    data = lowered(data)
    starts, ends, points, row = letter_runs(data, offsets)
    enough = points >= LEAST_CHARS
    starts, ends, points, row = starts[enough], ends[enough], points[enough], row[enough]
    number, values = distinct_slices(data, starts, ends)
    if not len(values):
        return values, np.zeros(0, np.int64)
    size = np.asarray(pc.binary_length(values))
    key, count = np.unique(row * len(values) + number, return_counts=True)
    row, number = key // len(values), key % len(values)
    prefix = [f"{'' if i is None else i}:".encode() for i in ids]
    raw = values.to_pylist()
    first = np.fromiter(map(zlib.crc32, prefix), np.uint32, len(prefix))
    second = np.fromiter(map(zlib.crc32, raw), np.uint32, len(raw))
    h = np.zeros(len(key), np.uint32)
    short = size[number] <= 64
    h[short] = joined_crc(first[row[short]], second[number[short]], size[number[short]])
    for k in np.flatnonzero(~short).tolist():
        h[k] = zlib.crc32(raw[number[k]], zlib.crc32(prefix[row[k]]))
    cut = h % MODULUS == 0
    whole = np.bincount(number[~cut], count[~cut], len(values)).astype(np.int64)
    some = np.flatnonzero(whole)
    words, counts = [values.take(pa.array(some))], [whole[some]]
    changed = []
    for k in np.flatnonzero(cut).tolist():
        word = raw[number[k]].decode()
        at = int(h[k]) % len(word)
        changed.append((word[:at] + word[at + 1 :]).encode())
    long = [k for k, w in enumerate(changed) if len(w) >= LEAST_CHARS and len(w.decode()) >= LEAST_CHARS]
    words.append(pa.array([changed[k] for k in long], pa.large_binary()))
    counts.append(count[cut][long])
    return pa.concat_arrays(words), np.concatenate(counts)


def task_words(batches):
    """(word, n) of a task's texts; words are merged while there is room for them."""
    held: list = []
    size = 0

    def merged():
        return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

    def out(table):
        return [batch_of(pa.schema([("word", pa.string()), ("n", pa.int64())]), [b.column(0).cast(pa.binary()).cast(pa.string()), b.column(1)]) for b in table.to_batches(max_chunksize=50_000)]

    for batch in batches:
        ids = batch.column(0).to_pylist()
        for i, j, data, offsets in text_tiles(batch.column(1)):
            words, n = tile_words(ids[i:j], data, offsets)
            held.append(pa.table({"word": words, "n": n}))
            size += len(n)
            if size > 2 * HELD:
                table = merged()
                held, size = [table], len(table)
                if size > HELD:
                    yield from out(table)
                    held, size = [], 0
    if held:
        yield from out(merged())


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): the words of docs (doc_id, text) with the occurrences that they need."""
    rows = doc_text(docs).mapInArrow(frugal(task_words), "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


# --- cells and blocks
def letters_of(column) -> tuple[np.ndarray, np.ndarray]:
    """(letters as one byte each, offsets) of words, all of whose code points are below 256."""
    raw = [w.encode("latin-1") for w in column.to_pylist()]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(w) for w in raw])]).astype(np.int64)


def letter_sums(batches):
    total = np.zeros(256, np.int64)
    for batch in batches:
        total += np.bincount(letters_of(batch.column(0))[0], minlength=256)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["letter", "n"])


def letter_groups(sums: dict[int, int], n: int) -> np.ndarray:
    """The group of each letter, by descending sums each time to the lightest group."""
    group, weight = np.zeros(256, np.int64), [0] * n
    for k in sorted(sums, key=lambda k: (-sums[k], k)):
        group[k] = weight.index(min(weight))
        weight[group[k]] += sums[k]
    return group


def cells(group: np.ndarray, n: int):
    """A function of batches (word, n) to (cell, word, n); a cell is its counts as four bytes each."""

    def of(batches):
        for batch in batches:
            data, offsets = letters_of(batch.column(0))
            owner = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            counts = np.bincount(owner * n + group[data], minlength=batch.num_rows * n).astype(">u4").reshape(-1, n)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in counts], pa.binary()), batch.column(0), batch.column(1)], names=["cell", "word", "n"])

    return of


def toward(cell: bytes) -> list[bytes]:
    """The cell and those of its neighbours that it is to meet: of two neighbours one meets the other."""
    x = np.frombuffer(cell, ">u4").astype(np.int64)
    one = np.eye(len(x), dtype=np.int64)
    moved = [x - one[i] + one[j] for i in range(len(x)) if x[i] for j in range(i + 1, len(x))]
    return [y.astype(">u4").tobytes() for y in (x, *moved, *(x + e for e in one))]


def blocks(batches):
    """Blocks of words of one cell from words sorted by cell: id, cell, letters, counts, the cells to meet."""
    part, number = TaskContext.get().partitionId() << 33, 0
    cell, words, counts, size = None, [], [], 0

    def block():
        nonlocal number, words, counts, size
        out = pa.RecordBatch.from_arrays([pa.array([part + number]), pa.array([cell], pa.binary()), pa.array([b"".join(words)], pa.binary()), pa.array([counts], pa.list_(pa.int64())), pa.array([toward(cell)], pa.list_(pa.binary()))], names=["id", "cell", "letters", "n", "toward"])
        number, words, counts, size = number + 1, [], [], 0
        return out

    for batch in batches:
        for c, w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            w = w.encode("latin-1")
            if words and (c != cell or len(words) == BLOCK or size + len(w) > BLOCK_BYTES):
                yield block()
            cell = c
            words.append(w)
            counts.append(n)
            size += len(w)
    if words:
        yield block()


# --- Gram matrices
class Block:
    """The words of a block as a matrix of letters, with their letter counts and squared lengths."""

    def __init__(self, letters: bytes, counts: list[int]):
        m = len(counts)
        self.words = np.frombuffer(letters, np.uint8).reshape(m, -1)
        self.n = np.array(counts, np.int64)
        width = self.words.shape[1]
        kind = np.float32 if width <= 2000 else np.float64  # sums of squares stay exact
        owner = np.repeat(np.arange(m), width)
        self.x = np.bincount(owner * len(_LETTERS) + _COLUMN[self.words.ravel()], minlength=m * len(_LETTERS)).reshape(m, -1).astype(kind)
        self.square = (self.x * self.x).sum(1)

    def text(self, k: int) -> str:
        return self.words[k].tobytes().decode("latin-1")


def close(a: Block, b: Block, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) of words of two blocks (or of one, each pair once) that differ by exactly one edit. b's words may be shorter by one."""
    gram = a.x @ b.x.T
    gram *= 2
    gram += 2
    near = gram >= a.square[:, None] + b.square[None, :]
    if same:
        near = np.triu(near, 1)
    i, j = np.nonzero(near)
    width = a.words.shape[1]
    good = np.zeros(len(i), bool)
    step = max(1, COMPARED // max(1, width))
    for k in range(0, len(i), step):
        x, y = a.words[i[k : k + step]], b.words[j[k : k + step]]
        if x.shape[1] == y.shape[1]:
            good[k : k + step] = (x != y).sum(1) == 1
        else:  # what x and y have in common from the left and from the right covers y
            left = np.logical_and.accumulate(x[:, :-1] == y, axis=1).sum(1)
            right = np.logical_and.accumulate((x[:, 1:] == y)[:, ::-1], axis=1).sum(1)
            good[k : k + step] = left + right >= y.shape[1]
    return i[good], j[good]


def _best(of: Block, other: Block, i: np.ndarray, j: np.ndarray) -> list[tuple]:
    """(word, number of near words, -n and the word of the best one) of words i of a block with near words j of another."""
    rank = np.empty(len(other.n), np.int64)
    rank[np.lexsort(other.words.T[::-1])] = np.arange(len(other.n))
    order = np.lexsort((rank[j], -other.n[j], i))
    i, j = i[order], j[order]
    first = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
    number = np.diff(np.append(first, len(i)))
    return [(of.text(p), m, -int(other.n[q]), other.text(q)) for p, q, m in zip(i[first].tolist(), j[first].tolist(), number.tolist(), strict=True)]


NEAR_DDL = "word string, n_near long, less long, best string"


def near_words(batches):
    """Of pairs of blocks (id, letters, n, other_id, other_letters, other_n): a row for each word with a near word in the other block."""
    kept: dict[int, Block] = {}

    def block(number, letters, counts):
        if number not in kept:
            if len(kept) >= 32:
                kept.clear()
            kept[number] = Block(letters, counts)
        return kept[number]

    schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("less", pa.int64()), ("best", pa.string())])
    for batch in batches:
        rows = []
        for k in range(batch.num_rows):
            p, letters, n, q, other_letters, other_n = (batch.column(c)[k].as_py() for c in range(6))
            a, b = block(p, letters, n), block(q, other_letters, other_n)
            i, j = close(a, b, p == q)
            if len(i):
                if p == q:
                    rows += _best(a, a, np.concatenate([i, j]), np.concatenate([j, i]))
                else:
                    rows += _best(a, b, i, j) + _best(b, a, j, i)
            if len(rows) > 20_000:
                yield batch_of(schema, list(zip(*rows, strict=True)))
                rows = []
        if rows:
            yield batch_of(schema, list(zip(*rows, strict=True)))


def near_of(words: DataFrame) -> DataFrame:
    """(word, n_near, form_n, best) of the words of a written vocabulary (word, n) that have near words."""
    total = words.count()
    n = max(1, total.bit_length() // 4)
    sums = {r.letter: r.n for r in words.select("word").mapInArrow(letter_sums, "letter int, n long").groupBy("letter").agg(F.sum("n").alias("n")).collect()}  # 90 letters at most
    placed = words.mapInArrow(cells(letter_groups(sums, n), n), "cell binary, word string, n long")
    cut = placed.repartitionByRange("cell", F.xxhash64("word")).sortWithinPartitions("cell").mapInArrow(frugal(blocks), "id long, cell binary, letters binary, n array<long>, toward array<binary>")
    cut = written(cut, "spelling-blocks")
    one = cut.select("id", "letters", "n", "cell")
    other = cut.select(F.col("id").alias("other_id"), F.col("letters").alias("other_letters"), F.col("n").alias("other_n"), F.col("cell").alias("own"), F.explode("toward").alias("cell"))
    pairs = one.join(other, "cell").where((F.col("cell") != F.col("own")) | (F.col("id") <= F.col("other_id"))).select("id", "letters", "n", "other_id", "other_letters", "other_n")
    found = pairs.mapInArrow(frugal(near_words), NEAR_DDL)
    best = F.min(F.struct("less", "best"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.less")).alias("form_n"), "b.best")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of a written table (word, form): where following forms ends. Each round doubles the steps; a form is at least ten
    times as frequent as its word, so there are no cycles and few steps."""
    at = forms.select("word", F.col("form").alias("root"))
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        step = written(at.join(ahead, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "spelling-roots")
        at = step.select("word", "root")
        if step.where("moved").isEmpty():
            return at


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n: a row for each word of docs (doc_id, text).

    Null and empty texts have no words; a null doc_id is written as nothing before the colon of the checksum; rows of one doc_id lose the
    same code points, and each row counts; ties go to the smaller word; an empty table gives no rows; other columns are ignored.
    """
    words = written(vocabulary(docs), "spelling-words")
    near = written(near_of(words), "spelling-near")
    joined = words.join(near, "word", "left")
    formed = F.col("form_n") >= RATIO * F.col("n")
    joined = joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("best")).alias("form"), F.when(formed, F.col("form_n")).alias("form_n"))
    joined = written(joined, "spelling-forms")
    ends = roots(joined.where("form IS NOT NULL").select("word", "form"))
    return joined.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark, sf_dir: str) -> DataFrame:
    return variants(documents(spark, sf_dir))


_LOWER_SQL = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Checksums by their table of 256 steps; near words have a deletion in common with the other word, or with it at one place.
OP11_SQL = rf"""
WITH RECURSIVE bits AS (SELECT i AS byte, 0 AS k, i::BIGINT AS c FROM range(256) r(i)
                        UNION ALL SELECT byte, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM bits WHERE k < 8),
t AS (SELECT list(c ORDER BY byte) AS t FROM bits WHERE k = 8),
r AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all({_LOWER_SQL}, '[a-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents) WHERE length(run) >= 7 GROUP BY ALL),
b AS (SELECT run, n, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
             lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195::BIGINT, unicode(x)::BIGINT % 64 + 128] END)) AS bytes FROM r),
h AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, x: xor(c // 256, t[xor(c, x) % 256 + 1])), 4294967295) AS h FROM b, t),
e AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM h),
w AS (SELECT word, sum(n)::BIGINT AS n FROM e WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
d AS (SELECT DISTINCT word, left(word, (i - 1)::INT) || substr(word, (i + 1)::INT) AS less FROM w, range(1, length(word) + 1) x(i)),
s AS (SELECT word, left(word, (i - 1)::INT) || '*' || substr(word, (i + 1)::INT) AS like_it FROM w, range(1, length(word) + 1) x(i)),
p AS (SELECT a.word, b.word AS other FROM s a JOIN s b USING (like_it) WHERE a.word <> b.word
      UNION SELECT d.word, w.word FROM d JOIN w ON d.less = w.word UNION SELECT w.word, d.word FROM d JOIN w ON d.less = w.word),
q AS (SELECT p.word, other, w.n AS m, row_number() OVER (PARTITION BY p.word ORDER BY w.n DESC, other) AS place, count(*) OVER (PARTITION BY p.word) AS n_near FROM p JOIN w ON w.word = p.other),
f AS (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= 10 * w.n THEN other END AS form, CASE WHEN m >= 10 * w.n THEN m END AS form_n FROM w LEFT JOIN q ON q.word = w.word AND place = 1),
c AS (SELECT word, word AS top, 0 AS k FROM f UNION ALL SELECT c.word, f.form, k + 1 FROM c JOIN f ON f.word = c.top WHERE f.form IS NOT NULL),
z AS (SELECT word, arg_max(top, k) AS root FROM c GROUP BY word)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN z ON z.word = f.word
"""
