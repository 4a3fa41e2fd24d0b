"""Numeric QA of tensor tables: error metrics, gates, schema differences and precision scans."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Gates: the greatest relative error, or none, and the least cosine (fixed values).
GATES = {"tight": (1e-4, 1 - 1e-6), "deep": (0.5, 1 - 1e-4), "half": (None, 0.999)}
HALF_MAX, HALF_ERROR, HALF_SHARE = 65504.0, 1e-2, 1e-3


def align(ours: DataFrame, reference: DataFrame) -> DataFrame:
    """(name, idx, ours, ref) of tensors of equal length; those of unequal length are in length_errors."""
    bad = length_errors(ours, reference).select("name")
    return ours.join(reference, ["name", "idx"]).join(bad, "name", "left_anti")


def length_errors(ours: DataFrame, reference: DataFrame) -> DataFrame:
    n = lambda df, c: df.groupBy("name").agg(F.count(F.lit(1)).alias(c))
    return n(ours, "n_ours").join(n(reference, "n_ref"), "name", "full").where("n_ours is distinct from n_ref")


def metrics(pairs: DataFrame) -> DataFrame:
    """Errors of each tensor (name, ours, ref) in one aggregation; NaN anywhere shows as NaN."""
    e = F.abs(F.col("ours") - F.col("ref"))
    dot, aa, bb = F.sum(F.col("ours") * F.col("ref")), F.sum(F.col("ours") * F.col("ours")), F.sum(F.col("ref") * F.col("ref"))
    out = pairs.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.max(e).alias("max_abs"), F.avg(e).alias("mean_abs"), (dot / F.greatest(F.sqrt(aa) * F.sqrt(bb), F.lit(1e-30))).alias("cosine"), F.max(F.abs("ref")).alias("ref_scale"))
    return out.withColumn("rel_max", F.col("max_abs") / F.greatest("ref_scale", F.lit(1e-30)))


def gate(measured: DataFrame, preset: str = "deep") -> DataFrame:
    """measured with `passed`; NaN never passes."""
    rel, cosine = GATES[preset]
    ok = (F.col("cosine") >= cosine) & ~F.isnan("cosine") & ~F.isnan("max_abs")
    if rel is not None:
        ok = ok & (F.col("rel_max") <= rel)
    return measured.withColumn("passed", F.coalesce(ok, F.lit(False)))


def self_calibrated(ours: DataFrame, variants: DataFrame, floor: float = 1e-3) -> DataFrame:
    """name, drift, allowed and passed: the drift may be twice the reference's own between variants, or the floor."""
    own = metrics(variants).select("name", F.col("rel_max").alias("own"))
    rows = metrics(ours).select("name", F.col("rel_max").alias("drift")).join(own, "name")
    return rows.withColumn("allowed", F.greatest(F.lit(floor), 2 * F.col("own"))).withColumn("passed", (F.col("drift") <= F.col("allowed")) & ~F.isnan("drift")).drop("own")


def nonfinite(values: DataFrame, value: str = "ours") -> DataFrame:
    v = F.col(value)
    return values.groupBy("name").agg(F.count_if(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))).alias("n_nonfinite"))


def report(pairs: DataFrame, preset: str = "deep") -> DataFrame:
    """Every failing tensor with its metrics and number of values that aren't finite."""
    return gate(metrics(pairs), preset).join(nonfinite(pairs), "name").where("not passed or n_nonfinite > 0")


def pose_check(ours: DataFrame, reference: DataFrame, tolerance: float) -> DataFrame:
    """frame, worst and n_bad of pose encodings (frame, enc) by component."""
    flat = lambda df, c: df.select("frame", F.posexplode("enc").alias("k", c))
    e = F.abs(F.col("a").cast("double") - F.col("b").cast("double"))
    return flat(ours, "a").join(flat(reference, "b"), ["frame", "k"]).groupBy("frame").agg(F.max(e).alias("worst"), F.count_if(e > tolerance).alias("n_bad"))


def schema_diff(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """name and problem of each tensor (name, shape, dtype) that is missing, unexpected or of another shape or type."""
    j = expected.select("name", F.struct("shape", "dtype").alias("e")).join(actual.select("name", F.struct("shape", "dtype").alias("a")), "name", "full")
    problem = F.when(F.col("a").isNull(), "missing").when(F.col("e").isNull(), "unexpected").when(~F.col("e.shape").eqNullSafe(F.col("a.shape")), "shape").when(~F.col("e.dtype").eqNullSafe(F.col("a.dtype")), "dtype")
    return j.select("name", problem.alias("problem")).where("problem is not null")


def key_except(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("name").subtract(b.select("name"))


def key_intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """Shared names whose shapes differ."""
    shared = a.select("name").intersect(b.select("name"))
    return shared.join(a.select("name", F.col("shape").alias("s1")), "name").join(b.select("name", F.col("shape").alias("s2")), "name").where(~F.col("s1").eqNullSafe(F.col("s2"))).select("name")


def mask_fold(tensors: DataFrame, suffix: str = ".mask") -> DataFrame:
    """tensors (name, idx, value) with every bias times the mask of its name, and without the masks."""
    masks = tensors.where(F.col("name").endswith(suffix)).select(F.expr(f"substring(name, 1, length(name) - {len(suffix)})").alias("name"), "idx", F.col("value").alias("mask"))
    rest = tensors.where(~F.col("name").endswith(suffix))
    return rest.join(masks, ["name", "idx"], "left").select("name", "idx", (F.col("value") * F.coalesce("mask", F.lit(1.0))).alias("value"))


def mask_patterns(masks: DataFrame) -> DataFrame:
    """pattern and its number of masks (name, idx, n, value): all zero, only the middle third zero, or other."""
    third = F.floor(F.col("idx") * 3 / F.col("n")).cast("int")
    by = masks.withColumn("third", third).groupBy("name").agg(*[f(F.when(F.col("third") == k, F.col("value"))).alias(f"{n}{k}") for k in range(3) for f, n in ((F.min, "lo"), (F.max, "hi"))])
    flat = lambda k: F.col(f"lo{k}") == F.col(f"hi{k}")
    plain = flat(0) & flat(1) & flat(2) & (F.col("lo0") == F.col("lo2")) & (F.col("lo1") == 0) & F.col("lo0").isin(0.0, 1.0)
    pattern = F.when(plain & (F.col("lo0") == 0), "all_zero").when(plain, "k_only").otherwise("other")
    return by.select(pattern.alias("pattern")).groupBy("pattern").agg(F.count(F.lit(1)).alias("n_masks"))


@F.pandas_udf(DoubleType())
def half_round_trip(v: pd.Series) -> pd.Series:
    """Values as half floats hold them."""
    with np.errstate(over="ignore"):
        return pd.Series(v.to_numpy(dtype="float64", na_value=np.nan).astype(np.float16).astype(np.float64))


def half_outliers(tensors: DataFrame, value: str = "value") -> DataFrame:
    """name, max_abs, overflow, bad_share and keep_full: whether half precision would lose the tensor."""
    v = F.col(value)
    rows = tensors.withColumn("half", half_round_trip(v))
    err = F.abs(F.col("half") - v) / F.abs(v)
    out = rows.groupBy("name").agg(F.max(F.abs(v)).alias("max_abs"), F.count_if((v != 0) & (err > HALF_ERROR)).alias("n_bad"), F.count(F.lit(1)).alias("n"))
    out = out.withColumn("overflow", F.col("max_abs") > HALF_MAX).withColumn("bad_share", F.col("n_bad") / F.col("n"))
    return out.withColumn("keep_full", F.col("overflow") | (F.col("bad_share") > HALF_SHARE)).drop("n_bad", "n")


def precision_policy(meta: DataFrame, scans: DataFrame, always: str = r"norm|scale|bias") -> DataFrame:
    """name and dtype of each tensor (name, shape): full where the name or one dimension asks for it or a scan does, else half."""
    full = F.col("name").rlike(always) | (F.size("shape") <= 1) | F.coalesce("keep_full", F.lit(False))
    return meta.join(scans.select("name", "keep_full"), "name", "left").select("name", F.when(full, "f32").otherwise("f16").alias("dtype"))
