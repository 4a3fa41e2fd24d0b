"""Language identification: averaged hashed subword embeddings and a linear softmax, trained with stochastic gradient descent."""

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import code_points
from .common import doc_text, documents, frugal, small_batches, text_tiles

#: Hash buckets of subwords, width of their embeddings, and lengths of subwords in letters.
BUCKETS, DIM, ORDERS = 1 << 15, 12, (1, 2, 3)
#: The bounded sample of labelled documents: so many for each language, none longer than so many bytes.
PER_LANGUAGE, LONGEST = 600, 8000
#: The most languages that are learned: those with most labelled documents, ties to the first name.
MOST_LANGUAGES = 1000
EPOCHS, RATE, SEED = 4, 0.5, 7
#: The part of correctly labelled calibration documents that a rejection may cost, and the highest threshold.
COST, HIGHEST = 0.001, 0.5
NONE = "und"


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """For each code point its lower-case letter, or 0."""
    return np.array([0 if not (s := chr(c)).isalpha() else ord(s.lower()) if len(s.lower()) == 1 else c for c in range(0x110000)], np.uint32)


def subwords(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, document row of each, letters of each document). A subword lies inside a word with its borders; no other text counts."""
    points, _, docs = code_points(data, offsets)
    letters = letter_table()[points]
    n = len(offsets) - 1
    row = np.repeat(np.arange(n), np.diff(docs))
    count = np.bincount(row[letters > 0], minlength=n)
    x = letters.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
    buckets, rows = [], []
    for k in ORDERS:
        m = len(x) - k + 1
        if m <= 0:
            continue
        h = np.full(m, k, np.uint64)
        for j in range(k):
            h = (h ^ x[j : m + j]) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
        good = row[:m] == row[k - 1 :] if k > 1 else np.ones(m, bool)
        middle = letters[k // 2 : m + k // 2] > 0 if k > 1 else letters[:m] > 0
        good = good & middle
        buckets.append((h[good] >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64))
        rows.append(row[:m][good])
    if not buckets:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), count
    return np.concatenate(buckets), np.concatenate(rows), count


@dataclass
class LanguageModel:
    languages: list[str]
    scores: np.ndarray  # embeddings times the linear layer: a row of logits for each bucket
    temperature: float
    threshold: float

    def logits(self, column):
        """For each tile of a string column: mean logits and numbers of letters of its documents."""
        width = len(self.languages)
        for _, _, data, offsets in text_tiles(column, max(1 << 14, (1 << 19) // max(1, width // 8))):
            buckets, rows, letters = subwords(data, offsets)
            n = len(offsets) - 1
            sums = np.stack([np.bincount(rows, self.scores[buckets, k], n) for k in range(width)], 1)
            yield sums / np.maximum(np.bincount(rows, minlength=n), 1)[:, None], letters

    def predict(self, column) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, calibrated probabilities and rejections."""
        names, best, none = [], [], []
        for logits, letters in self.logits(column):
            p = softmax(logits / self.temperature)
            k = p.argmax(1)
            names += [self.languages[i] if c else NONE for i, c in zip(k, letters)]
            best.append(np.where(letters > 0, p.max(1), 0.0))
            none.append(letters == 0)
        score = np.concatenate(best) if best else np.zeros(0)
        return names, score, (np.concatenate(none) if none else np.zeros(0, bool)) | (score < self.threshold)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(texts: list[str], labels: list[str]) -> LanguageModel:
    """Fits embeddings and the linear layer on four fifths of the documents, then temperature and threshold on the rest."""
    languages = sorted(set(labels))
    if not languages:
        return LanguageModel([NONE], np.zeros((BUCKETS, 1)), 1.0, 0.0)
    rng = np.random.default_rng(SEED)
    embeddings = rng.normal(0, 0.1, (BUCKETS, DIM))
    linear = rng.normal(0, 0.1, (DIM, len(languages)))
    docs = []
    for t in texts:
        b, _, _ = subwords(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))
        docs.append(np.unique(b, return_counts=True))
    y = np.array([languages.index(x) for x in labels])
    fit = np.array([i for i in range(len(docs)) if i % 5 != 4 and len(docs[i][0])])
    held = [i for i in range(len(docs)) if i % 5 == 4 and len(docs[i][0])]
    steps, done = EPOCHS * max(1, len(fit)), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(fit):
            rate = RATE * (1 - done / steps)
            done += 1
            at, n = docs[i]
            w = n / n.sum()
            x = w @ embeddings[at]
            p = softmax((x @ linear)[None])[0]
            p[y[i]] -= 1
            gradient = linear @ p
            linear -= rate * np.outer(x, p)
            embeddings[at] -= rate * 20 * w[:, None] * gradient
    scores = embeddings @ linear
    model = LanguageModel(languages, scores.astype(np.float64), 1.0, 0.0)
    if held:
        logits = np.stack([(docs[i][1] / docs[i][1].sum()) @ scores[docs[i][0]] for i in held])
        truth = y[held]
        loss = lambda t: -np.log(softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean()
        model.temperature = min(np.geomspace(0.05, 5, 47).tolist(), key=loss)
        p = softmax(logits / model.temperature)
        right = np.sort(p.max(1)[p.argmax(1) == truth])
        if len(right):
            model.threshold = min(HIGHEST, float(right[int(COST * len(right))]) * 0.9)
    return model


def bucket_of_five():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5


def training_sample(docs: DataFrame, per_language: int = PER_LANGUAGE, longest: int = LONGEST) -> tuple[list[str], list[str]]:
    """Texts and labels of at most so many labelled documents of each language, the same in every run.

    A first pass counts the documents by language (a row for each of MOST_LANGUAGES at most comes to the driver); a second takes those
    whose hash is under the language's rate. Documents with crc32(doc_id) mod 5 = 0 are never read for training. Equal rows count once
    in the sample; different rows of one doc_id share its hash. A language all of whose labelled texts are longer than `longest` bytes
    isn't learned, and its documents are told as the nearest of the others or rejected.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (bucket_of_five() != 0) & (F.octet_length("text") <= longest))
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()}
    if not counts:
        return [], []
    rates = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, per_language / n))])
    u = (F.xxhash64(F.col("doc_id").cast("long"), F.lit(SEED)).bitwiseAND((1 << 30) - 1)) / float(1 << 30)
    taken = labelled.where(u < F.element_at(rates, F.col("lang"))).select(u.alias("u"), F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").distinct()
    rows = taken.orderBy("u", "doc_id", "text", "lang").limit(2 * per_language * len(counts)).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"], r["lang"]))
    return [r["text"] for r in rows], [r["lang"] for r in rows]


OUT = "doc_id long, lang_pred string, score double, rejected boolean"


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score and rejected, a row for each row of docs, from whole texts alone.

    Null and empty texts and those without a letter are `und` with score 0, and rejected; ties go to the first language in order;
    equal texts give equal rows; an empty table gives none; other columns are ignored.
    """

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                names, score, rejected = model.predict(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

    return doc_text(docs).mapInArrow(frugal(run), OUT)


def accepted(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """docs, all columns as they are, without the rows that the model rejects.

    Null and empty texts and those without a letter are rejected; whole texts count; equal rows have the same fate; an empty table gives
    none; further columns, whatever their names, are passed on.
    """

    def run(batches):
        for batch in batches:
            _, _, rejected = model.predict(batch.column("text"))
            yield batch.filter(pa.array(~rejected))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(frugal(run), docs.schema)


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    """A row for each document; one without a doc_id is in no fold, so it is neither learned from nor held out."""
    docs = documents(spark, sf_dir)
    found = identify(docs, train(*training_sample(docs)))
    return found.select("doc_id", F.coalesce(bucket_of_five() == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def stage_language(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those that the classifier rejects go, as `accepted` says: null and empty texts among them.

    It learns from the labels of the same documents; without any label all texts with a letter stay.
    """
    return accepted(docs, train(*training_sample(docs)))
