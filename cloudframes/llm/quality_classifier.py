"""Quality classifier: a regularised quadratic discriminant over transformed document statistics."""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_text, documents
from .doc_stats import stats

#: The bounded sample of labelled documents, and the longest text in it in bytes.
SAMPLE, LONGEST, SEED = 4000, 60000, 11
#: Shrinkage of each class's covariance towards the pooled one, then towards its own mean variance.
POOL, RIDGE = 0.3, 0.05
THRESHOLD = 0.7


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    """Transformed statistics: logarithms of counts, square roots of shares; defined for empty texts too."""
    f = {k: v.astype(float) for k, v in s.items()}
    words, chars, lines = f["n_words"] + 1, f["n_chars"] + 1, f["n_lines"] + 1
    mean = f["word_chars"] / words
    return np.stack(
        [
            np.log(words), np.log1p(mean), np.sqrt(np.maximum(0, f["square_chars"] / words - mean**2)), np.sqrt(f["n_symbols"] / words),
            np.sqrt(f["n_digits"] / chars), np.sqrt(f["n_upper"] / chars), np.sqrt(f["n_stops"] / words), np.sqrt(f["n_wide"] / chars),
            np.log((f["n_distinct"] + 1) / words), np.sqrt(f["n_repeat_words"] / words), np.sqrt(f["n_dup_lines"] / lines), np.log(words / lines),
        ],
        1,
    )


@dataclass
class Discriminant:
    """For each class: log prior, mean, inverse Cholesky factor of the covariance and its log determinant."""

    center: np.ndarray
    scale: np.ndarray
    classes: list[tuple[float, np.ndarray, np.ndarray, float]]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 from the difference of log densities."""
        if len(self.classes) < 2:
            return np.full(len(x), 0.5)
        z = (x - self.center) / self.scale
        logs = [prior - 0.5 * (((z - mean) @ inverse.T) ** 2).sum(1) - 0.5 * logdet for prior, mean, inverse, logdet in self.classes]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, pool: float = POOL, ridge: float = RIDGE) -> Discriminant:
    """With one class or none in the labels, every score is 0.5."""
    if len(set(y.tolist())) < 2:
        return Discriminant(np.zeros(x.shape[1] if x.ndim == 2 else 1), np.ones(1), [])
    center, scale = x.mean(0), x.std(0) + 1e-6
    z = (x - center) / scale
    parts = [z[y == c] for c in (0, 1)]
    scatter = [(p - p.mean(0)).T @ (p - p.mean(0)) for p in parts]
    pooled = sum(scatter) / max(1, len(z) - 2)
    classes = []
    for p, s in zip(parts, scatter, strict=True):
        cov = (1 - pool) * s / max(1, len(p) - 1) + pool * pooled
        cov = (1 - ridge) * cov + ridge * np.trace(cov) / len(cov) * np.eye(len(cov)) + 1e-6 * np.eye(len(cov))
        factor = np.linalg.cholesky(cov)
        classes.append((float(np.log(len(p) / len(z))), p.mean(0), np.linalg.inv(factor), float(2 * np.log(np.diag(factor)).sum())))
    return Discriminant(center, scale, classes)


def fold():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4


def training_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, longest: int = LONGEST) -> tuple[list[str], np.ndarray]:
    """At most so many labelled texts in hash order of doc_id, the same in every run; rows with crc32(doc_id) mod 4 = 2 are never among them.

    A doc_id with several labels has the least of them. Equal rows count once; different texts of one doc_id have its label.
    """
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold() != 2)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    by_hash = F.xxhash64(F.col("doc_id"), F.lit(SEED))
    chosen = {r["doc_id"]: r["quality"] for r in usable.orderBy(by_hash, "doc_id").limit(sample).collect()}
    if not chosen:
        return [], np.zeros(0, int)
    rows = doc_text(docs).where(F.col("doc_id").isin(list(chosen)) & F.col("text").isNotNull() & (F.octet_length("text") <= longest)).distinct()
    rows = rows.orderBy(by_hash, "doc_id", "text").limit(2 * sample).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    return [r["text"] for r in rows], np.array([int(chosen[r["doc_id"]]) for r in rows])


def train(texts: list[str], y: np.ndarray) -> Discriminant:
    return fit(features(stats(pa.array(texts))), y) if texts else fit(np.zeros((0, 1)), y)


def quality_scores(docs: DataFrame, model: Discriminant, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and predicted, a row for each row of docs.

    Null and empty texts are scored as texts without words; equal texts give equal scores; an empty table gives none; other
    columns, labels and languages among them, are ignored.
    """

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                score = model.score(features(stats(part.column(1))))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32), pa.int32())], names=["doc_id", "score", "predicted"])

    return doc_text(docs).mapInArrow(run, "doc_id long, score double, predicted int")


def op7_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """A row for each document; one without a doc_id is in no fold, so it is neither learned from nor held out."""
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scores = quality_scores(docs, train(*training_sample(docs, labels)))
    return scores.select("doc_id", F.coalesce(fold() == 2, F.lit(False)).alias("held_out"), "score", "predicted")
