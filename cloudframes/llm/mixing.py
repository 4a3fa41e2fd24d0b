"""Mixing sources to target weights with hash-threshold histograms, in DataFrame functions only.

Every document has a hash; a source's mix is all of its documents whose hash lies under a threshold. The threshold is found
without sorting: word counts are summed by source and hash bucket, the bucket in which the budget ends is split into finer
buckets, and so on. A smaller budget gives a lower threshold, so mixes of growing budgets are nested.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, small, written

WORD = r"[^\x20\x09-\x0D]+"
#: Weights by the source's place in code point order, null last, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MOST = 1.5, 2.0
#: Bits of the hash that one pass tells apart, and the passes: 2 ** 40 thresholds are fine enough for any one source.
BITS, PASSES = 10, 4
#: Sources up to which their plan is broadcast to the texts.
SOURCES = 100_000


def targets(sizes: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple = WEIGHTS) -> DataFrame:
    """source, source_size and target of each source, from a row (source, source_size) for each.

    The share of all words goes to the sources by weight; what is above `most` times a source's size goes to the others by
    weight until none is above. The level at which this ends is found in closed form: sources in order of size over weight are
    full as long as the level that the rest would get is above theirs. Rows are one for each source.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    by_level = Window.orderBy("level", "place")
    everything = Window.partitionBy(F.lit(1))
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    levels = (
        sizes.withColumn("place", F.row_number().over(order) - 1)
        .withColumn("weight", w)
        .withColumn("cap", F.col("source_size") * F.lit(most))
        .withColumn("level", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything) * F.lit(share))
        .withColumn("full", F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("rest", (F.col("total") - F.col("full")) / F.col("open"))
    )
    level = F.min(F.when(F.col("rest") <= F.col("level"), F.struct("level", "place", "rest"))).over(everything)["rest"]
    return levels.withColumn("at", level).select("source", "source_size", F.when(F.col("at").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("at") * F.col("weight"))).alias("target"))


def _bucket(passes: int) -> Column:
    """The top bits of the hash that so many passes have told apart."""
    return F.shiftrightunsigned("hash", 64 - BITS * passes)


def thresholds(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, limit): documents whose top bits of the hash are under limit make up a source's partial budget.

    sized: source, size, hash; budgets: source, budget. Only sums by source and bucket are shuffled, and from the second pass on
    only documents of the bucket in which the budget ends take part.
    """
    state = budgets.select("source", F.col("budget").alias("left"), F.lit(0).cast("long").alias("limit"))
    running = Window.partitionBy("source").orderBy("bucket")
    for k in range(1, PASSES + 1):
        sums = _within(sized, state, k).groupBy("source", "left", F.col("bucket")).agg(F.sum("size").alias("words"))
        cumulative = sums.withColumn("above", F.sum("words").over(running)).withColumn("below", F.col("above") - F.col("words"))
        ends = cumulative.where((F.col("below") < F.col("left")) & (F.col("above") >= F.col("left")))
        if k < PASSES:
            found = ends.select("source", (F.col("left") - F.col("below")).alias("left"), F.col("bucket").alias("limit"))
        else:  # the last bucket is in where that comes nearer to the budget
            found = ends.select("source", F.lit(0.0).alias("left"), (F.col("bucket") + (F.col("above") - F.col("left") < F.col("left") - F.col("below")).cast("long")).alias("limit"))
        state = written(found, "mix-limits")
    return state.select("source", "limit")


def _within(sized: DataFrame, state: DataFrame, k: int) -> DataFrame:
    s = state.select(F.struct("source").alias("of"), "left", "limit")
    docs = sized.select(F.struct("source").alias("of"), "source", "size", _bucket(k).alias("bucket"), _bucket(k - 1).alias("before") if k > 1 else F.lit(0).cast("long").alias("before"))
    return docs.join(s, (docs["of"] == s["of"]) & (docs["before"] == s["limit"])).select("source", "left", "bucket", "size")


def sized_documents(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.col("doc_id").cast("long")).alias("hash"),
    )


def plan(sized: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple = WEIGHTS) -> DataFrame:
    """of (a struct of the source, so that null joins null), source_size, target, copies and limit, a row for each source.

    A target of r times its source's size takes every document floor(r) times, and once more those whose hash is under limit, at
    which the remaining words are reached as nearly as whole documents allow.
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ratio = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size") + 1e-12), F.lit(int(most)))).otherwise(0).cast("long")
    goals = written(targets(sizes, share, most, weights).withColumn("copies", ratio), "mix-targets")
    budgets = goals.select("source", (F.col("target") - F.col("copies") * F.col("source_size")).alias("budget")).where("budget >= 0.5")
    limits = thresholds(sized, budgets).select(F.struct("source").alias("of"), "limit")
    return goals.withColumn("of", F.struct("source")).join(limits, "of", "left").select("of", "source_size", "target", "copies", "limit")


def _taken() -> Column:
    """How many times the mix takes a document."""
    return F.col("copies") + F.when(_bucket(PASSES) < F.col("limit"), 1).otherwise(0)


def mix(docs: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple = WEIGHTS) -> DataFrame:
    """doc_id, size, source_size, target and taken, a row for each row of docs (doc_id, source, text).

    The hash is of doc_id alone: reruns agree, and rows with equal ids go together. Null text has size 0; a null source is one
    source, last in order; an empty table gives no rows; other columns are ignored.
    """
    sized = written(sized_documents(docs), "mix-sizes")
    per_source = plan(sized, share, most, weights)
    return sized.withColumn("of", F.struct("source")).join(per_source, "of").select("doc_id", "size", "source_size", "target", (F.col("size") * _taken()).alias("taken"))


def mix_rows(docs: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple = WEIGHTS) -> DataFrame:
    """docs, all columns as they are, each row as many times as the mix takes it (up to `most` times, or not at all).

    Documents without words stay once: they weigh nothing. The plan, a row for each source, is broadcast where its counted rows are
    within SOURCES; else texts are shuffled by source, and Spark splits the hot ones.
    """
    sized = written(sized_documents(docs), "mix-sizes")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.struct(F.col("source").cast("string").alias("source")).alias("of"), F.xxhash64(F.col("doc_id").cast("long")).alias("hash"))
    times = F.when(F.coalesce(F.col("row.text").rlike(WORD), F.lit(False)), _taken()).otherwise(1).cast("int")
    per_source = written(plan(sized, share, most, weights), "mix-plan")
    return keyed.join(small(per_source, SOURCES), "of").select(F.explode(F.array_repeat("row", times)).alias("row")).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))
