"""Collocations: phrases of two to four words that occur more often than their parts suggest, mined by partitions (SON).

1. Documents fall into SHARDS shards. Each shard is mined completely, level by level, with a support that is lowered to its share of the
   language's words: a phrase that occurs SUPPORT times in all has at least its share of them in some shard. Mining works on 64-bit codes
   of phrases that are counted inside tasks first, then by (language, shard, code); a phrase goes on only if its parts are frequent in
   this shard. Tasks know these from a bitmap of bounded size, which may let a phrase through but never stops one.
2. The union of the locally frequent phrases, but for those whose counts in these shards and less than the support in all others can't
   come to SUPPORT, is counted in all shards, exactly, by the words themselves: codes only prune.
3. Scores, and the longer phrases that stand for shorter ones, are joins among counted phrases.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import distinct_slices, documents, frugal, lowered, mixed, range_codes, small, small_batches, text_tiles, written

#: Occurrences of a candidate, words of the longest one, results a language, and the share of a longer one that makes a shorter one go.
SUPPORT, LONGEST, TOP, INSIDE = 30, 4, 2000, 80
#: Shards; bits for each entry of a bitmap, and the least and most bits (as powers of two); rows that a task holds.
SHARDS, BITS_EACH, LEAST_BITS, MOST_BITS, HELD = 4, 16, 16, 27, 1_000_000
_LANGS = 1_000_000
_SHARD = [int(x) for x in mixed(np.arange(1, SHARDS + 1, dtype=np.uint64)).view(np.int64)]
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_STOP = np.zeros(256, bool)
_STOP[[*range(10, 14), *b".,;:!?"]] = True
_GAP = _STOP.copy()
_GAP[[9, 32]] = True


class Tile:
    """The words of a tile of texts, and the codes of phrases that begin with each of them.

    code(k)[i] is the code of the k words from word i on; inside(k)[i] tells whether these lie in one piece.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, salt: np.ndarray):
        self.data = data = lowered(data)
        word = np.zeros(len(data) + 1, bool)
        word[:-1] = ~_GAP[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[offsets] = True
        before = np.zeros(len(data) + 1, bool)
        before[1:] = word[:-1]
        self.starts, self.ends = np.flatnonzero(word & (~before | cut)), np.flatnonzero(before & (~word | cut))
        self.row = np.searchsorted(offsets, self.starts, side="right") - 1
        stops = np.cumsum(_STOP[data])
        self.piece = stops[self.starts] + self.row if len(self.starts) else self.starts
        self.codes = range_codes(data, self.starts, self.ends)
        self.first = mixed(self.codes ^ salt[self.row])

    def inside(self, k: int) -> np.ndarray:
        n = max(0, len(self.piece) - k + 1)
        return self.piece[:n] == self.piece[k - 1 :]

    def code(self, k: int) -> np.ndarray:
        out = self.first
        for j in range(1, k):
            out = mixed(out[:-1] * _A + self.codes[j:]) if len(out) else out
        return out


def has(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which codes are in a bitmap (packed, a power of two of bits)."""
    at = at & np.uint64(8 * len(bits) - 1)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def bitmap(codes: DataFrame, at) -> np.ndarray:
    """The bits `at` (a column of longs) of a written table: BITS_EACH for each row, but within bounds, so that its size has one too."""
    size = 1 << min(MOST_BITS, max(LEAST_BITS, (BITS_EACH * codes.count()).bit_length()))
    at = at.bitwiseAND(F.lit(size - 1))
    rows = codes.select(F.shiftright(at, 6).alias("word"), F.expr("1L").alias("one"), at.bitwiseAND(F.lit(63)).cast("int").alias("bit")).select("word", F.expr("shiftleft(one, bit)").alias("bits"))
    found = rows.groupBy("word").agg(F.expr("bit_or(bits)").alias("bits")).toArrow()
    out = np.zeros(size // 64, np.int64)
    out[np.asarray(found.column("word"))] = np.asarray(found.column("bits"))
    return out.view(np.uint8)


def local(code: str = "code"):
    """A code as it is known in its own shard alone."""
    return F.col(code).bitwiseXOR(F.element_at(F.array(*map(F.lit, _SHARD)), F.col("shard") + 1))


def _texts(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))


def _tiles(batch):
    """(langs, number of each row's language, shard of each row, tile) for each tile of a batch (doc_id, lang, text)."""
    ids = np.asarray(pc.fill_null(batch.column(0), 0)).astype(np.uint64)
    shard = (mixed(ids + _B) >> np.uint64(32)).astype(np.int64) % SHARDS
    named = batch.column(1).dictionary_encode()
    number = np.asarray(named.indices).astype(np.int64)
    names = [x.encode() for x in named.dictionary.to_pylist()]
    flat, ends = np.frombuffer(b"".join(names), np.uint8), np.cumsum([len(x) for x in names]).astype(np.int64)
    salt = mixed(range_codes(flat, np.concatenate([[0], ends])[:-1], ends) + _B)  # unlike the code of a word that equals the name
    for i, j, data, offsets in text_tiles(batch.column(2)):
        yield named.dictionary, number[i:j], shard[i:j], Tile(data, offsets, salt[number[i:j]])


MINED_DDL = "lang string, shard int, code long, n long"


class Counts:
    """A task's counts by language and other columns, merged while there is room; languages are numbers until the rows go out."""

    def __init__(self, keys: list[str]):
        self.keys, self.held, self.size, self.names = keys, [], 0, {}

    def add(self, langs: pa.Array, number: np.ndarray, columns: list, n: np.ndarray):
        """Counts n by columns; number: each row's place in langs."""
        of = np.array([self.names.setdefault(x, len(self.names)) for x in langs.to_pylist()], np.int32)
        self.held.append(pa.table([pa.array(of[number]), *columns, pa.array(n)], names=["lang", *self.keys, "n"]))
        self.size += len(n)
        if self.size > 2 * HELD:
            table = self.merged()
            self.held, self.size = [table], len(table)
            if self.size > HELD:
                yield from self.rest()

    def merged(self) -> pa.Table:
        names = ["lang", *self.keys]
        return pa.concat_tables(self.held).group_by(names, use_threads=False).aggregate([("n", "sum")]).rename_columns([*names, "n"]).select([*names, "n"])

    def rest(self):
        if self.held:
            langs = pa.array(list(self.names), pa.string())
            for b in self.merged().to_batches(max_chunksize=50_000):
                yield b.set_column(0, "lang", langs.take(b.column(0)))
        self.held, self.size = [], 0


def miner(lengths: tuple[int, ...], frequent):
    """A function of batches (doc_id, lang, text) to (lang, shard, code, n): counts of the phrases of these lengths in a task.

    frequent: None, or a broadcast (length, bitmap) of shorter phrases of the same shard; phrases with others are left out.
    """
    shards = np.array(_SHARD, np.int64).view(np.uint64)

    def of(batches):
        counts = Counts(["shard", "code"])
        for batch in batches:
            for langs, number, shard, tile in _tiles(batch):
                known = None
                if frequent is not None:
                    part, bits = frequent.value
                    known = has(bits, tile.code(part) ^ shards[shard[tile.row[: max(0, len(tile.row) - part + 1)]]])
                for k in lengths:
                    good = tile.inside(k)
                    if known is not None:
                        for j in range(k - part + 1):
                            good = good & known[j : j + len(good)]
                    at = np.flatnonzero(good)
                    code, row = tile.code(k)[at], tile.row[at]
                    _, once, n = np.unique(code ^ shards[shard[row]], return_index=True, return_counts=True)
                    code, row = code[once].view(np.int64), row[once]
                    yield from counts.add(langs, number[row], [pa.array(shard[row], pa.int32()), pa.array(code)], n)
        yield from counts.rest()

    return of


def mine(docs: DataFrame, lengths: tuple[int, ...], frequent=None) -> DataFrame:
    return docs.mapInArrow(frugal(miner(lengths, frequent)), MINED_DDL).groupBy("lang", "shard", "code").agg(F.sum("n").alias("n"))


def counter(bits):
    """A function of batches (doc_id, lang, text) to (lang, phrase, words, n): exact counts of phrases whose code is in a broadcast bitmap."""

    def of(batches):
        counts = Counts(["phrase", "words"])
        for batch in batches:
            for langs, number, _, tile in _tiles(batch):
                word, values = distinct_slices(tile.data, tile.starts, tile.ends)
                if not len(values):
                    continue
                values = values.cast(pa.binary()).cast(pa.string())
                of_word = [word.astype(np.int64)]
                shorter = None
                for k in range(1, LONGEST + 1):
                    good = tile.inside(k) & has(bits.value, tile.code(k))
                    if shorter is not None:
                        good = good & shorter[: len(good)] & shorter[1 : len(good) + 1]
                    shorter = good
                    at = np.flatnonzero(good)
                    if not len(at):
                        break
                    # the phrase as a number, word by word: numbers of what came before and of the next word make the next number
                    key = number[tile.row[at]]
                    for j in range(k):
                        _, key = np.unique(key * len(values) + of_word[0][at + j], return_inverse=True)
                    _, once, n = np.unique(key, return_index=True, return_counts=True)
                    at = at[once]
                    words = [values.take(pa.array(word[at + j])) for j in range(k)]
                    phrase = pc.binary_join_element_wise(*words, " ") if k > 1 else words[0]
                    yield from counts.add(langs, number[tile.row[at]], [phrase, pa.array(np.full(len(at), k, np.int32))], n)
        yield from counts.rest()

    return of


def frequent_phrases(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, words, a), (lang, n)): all phrases of up to LONGEST words with SUPPORT occurrences, and each language's words."""
    spark = docs.sparkSession
    docs = _texts(docs)
    one = written(mine(docs, (1,)), "phrases-1")
    sums = written(one.groupBy("lang", "shard").agg(F.sum("n").alias("n")), "phrases-sums")
    total = sums.groupBy("lang").agg(F.sum("n").alias("n"))
    wanted = sums.join(total.withColumnRenamed("n", "all"), "lang").select("lang", "shard", F.ceil(F.lit(SUPPORT) * F.col("n").cast("decimal(30,0)") / F.col("all")).cast("long").alias("support"))
    wanted = wanted.withColumn("others", F.sum(F.col("support") - 1).over(Window.partitionBy("lang")))
    wanted = small(written(wanted, "phrases-support"), _LANGS)
    often = lambda rows, name: written(rows.join(wanted, ["lang", "shard"]).where(F.col("n") >= F.col("support")), name)
    frequent = [often(one, "phrases-often-1")]
    known = spark.sparkContext.broadcast((1, bitmap(frequent[0], local())))
    frequent.append(often(mine(docs, (2,), known), "phrases-often-2"))
    known = spark.sparkContext.broadcast((2, bitmap(frequent[1], local())))
    frequent.append(often(mine(docs, tuple(range(3, LONGEST + 1)), known), "phrases-often-3"))
    # a shard in which a phrase isn't frequent has less than the shard's support of it, so a phrase that can't come to SUPPORT is left out
    most = F.sum("n") + F.first("others") - F.sum(F.col("support") - 1)
    union = frequent[0].union(frequent[1]).union(frequent[2]).groupBy("lang", "code").agg(most.alias("most")).where(F.col("most") >= SUPPORT)
    union = written(union.select("code"), "phrases-union")
    bits = spark.sparkContext.broadcast(bitmap(union, F.col("code")))
    counted = docs.mapInArrow(frugal(counter(bits)), "lang string, phrase string, words int, n long").groupBy("lang", "phrase", "words").agg(F.sum("n").alias("a")).where(F.col("a") >= SUPPORT)
    return written(counted, "phrases-counted"), total


def scored(counted: DataFrame) -> DataFrame:
    """(lang, phrase, words, a, l, r, score) of counted phrases of two words or more, by their lowest-scoring cut (ties: the first)."""
    words = F.split("phrase", " ")
    cuts = counted.where("words > 1").select("lang", "phrase", "words", "a", words.alias("w"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "words", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"), F.array_join(F.slice("w", F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("rest"))
    part = lambda name, of: counted.select("lang", F.col("phrase").alias(name), F.col("a").alias(of))
    cuts = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    score = F.expr("(2000000 * cast(a AS decimal(20, 0))) div (cast(l AS decimal(20, 0)) + r)")
    return cuts.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")).select("lang", "phrase", "words", "a", "cut.l", "cut.r", "cut.score")


def standing_for(candidates: DataFrame) -> DataFrame:
    """(lang, phrase, longer): for phrases of two words or more inside longer candidates, the count of the most frequent one."""
    w = F.split("phrase", " ")
    at = F.expr("flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), i -> named_struct('i', i, 'm', m))))")
    inside = candidates.where("words > 2").select("lang", "a", w.alias("w"), F.explode(at).alias("x")).select("lang", "a", F.array_join(F.slice("w", F.col("x.i"), F.col("x.m")), " ").alias("phrase"))
    return inside.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))


def collocations(docs: DataFrame) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's TOP collocations of docs (doc_id, lang, text).

    Null texts are empty, a null lang is `und`, doc_id only chooses the shard (null too); repeated rows count again; ties go by a, then
    by the phrase; languages without a candidate and an empty table give no rows; other columns are ignored.
    """
    counted, total = frequent_phrases(docs)
    candidates = scored(counted)
    kept = candidates.join(standing_for(counted), ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < INSIDE * F.col("a")))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = kept.withColumn("rank", place.cast("long")).where(F.col("rank") <= TOP)
    return ranked.join(small(written(total, "phrases-total"), _LANGS), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


OP13_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
q AS (SELECT row_number() OVER () AS id, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
w AS (SELECT id, lang, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM q),
g AS (SELECT lang, w AS w1, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4 FROM w WINDOW o AS (PARTITION BY id ORDER BY i)),
f AS (SELECT lang, [w1] AS ws, count(*) AS f FROM g GROUP BY ALL
      UNION ALL SELECT lang, [w1, w2], count(*) FROM g WHERE w2 IS NOT NULL GROUP BY lang, w1, w2 HAVING count(*) >= 30
      UNION ALL SELECT lang, [w1, w2, w3], count(*) FROM g WHERE w3 IS NOT NULL GROUP BY lang, w1, w2, w3 HAVING count(*) >= 30
      UNION ALL SELECT lang, [w1, w2, w3, w4], count(*) FROM g WHERE w4 IS NOT NULL GROUP BY lang, w1, w2, w3, w4 HAVING count(*) >= 30),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE len(ws) = 1 GROUP BY lang),
c AS (SELECT lang, ws, f AS a FROM f WHERE len(ws) > 1),
k AS (SELECT lang, ws, a, unnest(range(1, len(ws))) AS k FROM c),
s AS (SELECT k.lang, k.ws, a, k, x.f AS l, y.f AS r, (2000000::HUGEINT * a // (x.f + y.f))::BIGINT AS score
      FROM k JOIN f x ON x.lang = k.lang AND x.ws = k.ws[1:k] JOIN f y ON y.lang = k.lang AND y.ws = k.ws[k + 1:]),
b AS (SELECT lang, ws, a, l, r, score FROM s QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, k) = 1),
i AS (SELECT lang, a, ws, unnest(range(1, len(ws))) AS i FROM c WHERE len(ws) > 2),
j AS (SELECT lang, a, ws, i, unnest(range(i + 1, least(len(ws), i + len(ws) - 2) + 1)) AS j FROM i),
d AS (SELECT lang, ws[i:j] AS ws, max(a) AS longer FROM j GROUP BY lang, ws[i:j]),
z AS (SELECT b.*, array_to_string(b.ws, ' ') AS phrase FROM b LEFT JOIN d ON d.lang = b.lang AND d.ws = b.ws WHERE longer IS NULL OR 100 * longer < 80 * a),
t AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score FROM z)
SELECT lang, rank, phrase, a, l, r, n, score FROM t JOIN n USING (lang) WHERE rank <= 2000
"""
