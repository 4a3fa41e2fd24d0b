"""Metric alignment: similarity transforms from camera centres to positions, found by hypotheses and inliers."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import enu

SIM3 = "session string, h long, s double, " + ", ".join(f"m{i}{j} double" for i in range(3) for j in range(3)) + ", v0 double, v1 double, v2 double"
LEAST_TAU_M, FEW = 2.0, 0.6


def local_positions(fixes: DataFrame) -> DataFrame:
    """fixes (session, frame, lat, lon, rel_alt) with e, n, u in metres from the session's first fix."""
    w = Window.partitionBy("session").orderBy("frame").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    o = [F.first(c, ignorenulls=True).over(w) for c in ("lat", "lon", "rel_alt")]
    e, n, u = enu(F.col("lat"), F.col("lon"), F.col("rel_alt"), *o)
    return fixes.where("lat is not null").withColumns({"e": e, "n": n, "u": u})


def from_moments(cov: np.ndarray, spread: np.ndarray, src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scales, rotations and translations of groups from covariances (dst by src), the variance of src, and both means."""
    u, d, vt = np.linalg.svd(cov)
    sign = np.ones((len(cov), 3))
    flip = np.sign(np.linalg.det(u) * np.linalg.det(vt))
    sign[:, 2] = np.where(flip == 0, 1.0, flip)
    rot = (u * sign[:, None, :]) @ vt
    scale = (d * sign).sum(1) / np.maximum(spread, 1e-30)
    return scale, rot, dst - scale[:, None] * (rot @ src[:, :, None])[:, :, 0]


def similarity(src: np.ndarray, dst: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Least-squares scale, rotation and translation from src to dst, points in rows."""
    a, b = src - src.mean(0), dst - dst.mean(0)
    s, rot, v = from_moments((b.T @ a / len(a))[None], np.array([(a**2).sum() / len(a)]), src.mean(0)[None], dst.mean(0)[None])
    return float(s[0]), rot[0], v[0]


def umeyama(points: DataFrame) -> DataFrame:
    """A transform for each (session, h) of correspondences (session, h, x, y, z, e, n, u), however many a group has.

    Groups are summed up as means, covariances and variances, which Spark merges from partial ones; Python only has 3 x 3 matrices.
    Correspondences with a null or NaN don't count; groups without any have no transform.
    """
    src, dst = ("x", "y", "z"), ("e", "n", "u")
    known = points.where(" and ".join(f"{c} is not null and not isnan({c})" for c in (*src, *dst)))
    sums = known.groupBy("session", "h").agg(
        *[F.covar_pop(d, s).alias(f"c_{d}{s}") for d in dst for s in src], sum((F.var_pop(s) for s in src[1:]), F.var_pop(src[0])).alias("spread"), *[F.avg(c).alias(f"a_{c}") for c in (*src, *dst)]
    )

    def fit(batches):
        for pdf in batches:
            take = lambda names: pdf[names].to_numpy(float)
            s, rot, v = from_moments(take([f"c_{d}{s}" for d in dst for s in src]).reshape(-1, 3, 3), pdf["spread"].to_numpy(float), take([f"a_{c}" for c in src]), take([f"a_{c}" for c in dst]))
            out = pd.DataFrame(np.concatenate([s[:, None], rot.reshape(-1, 9), v], 1), columns=[c.split()[0] for c in SIM3.split(", ")[2:]])
            out.insert(0, "h", pdf["h"].to_numpy())
            out.insert(0, "session", pdf["session"].to_numpy())
            yield out

    return sums.mapInPandas(fit, SIM3)


def moved(x: str = "x", y: str = "y", z: str = "z") -> list[Column]:
    p = [F.col(x), F.col(y), F.col(z)]
    return [F.col("s") * sum((F.col(f"m{i}{j}") * p[j] for j in range(1, 3)), F.col(f"m{i}0") * p[0]) + F.col(f"v{i}") for i in range(3)]


def residuals(points: DataFrame, transforms: DataFrame) -> DataFrame:
    """Every point under every hypothesis of its session: hypotheses, a fixed number for each session, times points."""
    q = moved()
    d = [(q[k] - F.col(c)) * (q[k] - F.col(c)) for k, c in enumerate(("e", "n", "u"))]
    return points.join(transforms, "session").select("session", "h", "frame", F.sqrt(d[0] + d[1] + d[2]).alias("res"))


def inliers(res: DataFrame, tau: Column) -> DataFrame:
    """Inliers, their share and root mean square of each (session, h)."""
    inside = F.col("res") <= tau
    return res.groupBy("session", "h").agg(F.count_if(inside).alias("n_in"), F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.when(inside, F.col("res") * F.col("res")))).alias("rms")).withColumn("ratio", F.col("n_in") / F.col("n")).withColumn("few", F.col("ratio") < FEW)


def best_hypothesis(scored: DataFrame) -> DataFrame:
    w = Window.partitionBy("session").orderBy(F.desc("n_in"), F.asc_nulls_last("rms"), "h")
    return scored.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def ransac(points: DataFrame, hypotheses: int = 32, sigma: float = 1.0, seed: int = 1) -> DataFrame:
    """The refitted transform of each session of correspondences (session, frame, x, y, z, e, n, u) with its inliers.

    Hypothesis h takes the three points of least hash with h, so that reruns agree and nothing loops on the driver.
    """
    tau = F.lit(max(LEAST_TAU_M, 2 * sigma))
    draws = points.withColumn("h", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(hypotheses - 1).cast("long"))))
    w = Window.partitionBy("session", "h").orderBy(F.xxhash64("session", "h", "frame", F.lit(seed)))
    tried = umeyama(draws.withColumn("rn", F.row_number().over(w)).where("rn <= 3"))
    res = residuals(points, tried)
    best = best_hypothesis(inliers(res, tau))
    chosen = res.join(best.select("session", "h"), ["session", "h"], "left_semi").where(F.col("res") <= tau)
    refit = umeyama(points.join(chosen.select("session", "frame", "h"), ["session", "frame"]))
    return refit.join(best.select("session", "n_in", "ratio", "rms", "few"), "session")


def apply_to_points(points: DataFrame, transforms: DataFrame) -> DataFrame:
    """points (session, wx, wy, wz, ...) moved by their session's transform."""
    x, y, z = moved("wx", "wy", "wz")
    return points.join(transforms.drop("h"), "session").select(*[c for c in points.columns if c not in ("wx", "wy", "wz")], x.alias("wx"), y.alias("wy"), z.alias("wz"))


def apply_to_cameras(cams: DataFrame, transforms: DataFrame) -> DataFrame:
    """R' = R S^T and t' = s t - R' v, so that moved points fall on the same pixels."""
    rot = {f"r{i}{j}": sum((F.col(f"r{i}{k}") * F.col(f"m{j}{k}") for k in range(1, 3)), F.col(f"r{i}0") * F.col(f"m{j}0")) for i in range(3) for j in range(3)}
    rows = cams.join(transforms.drop("h"), "session")
    t = {f"t{i}": F.col("s") * F.col(f"t{i}") - sum((rot[f"r{i}{j}"] * F.col(f"v{j}") for j in range(1, 3)), rot[f"r{i}0"] * F.col("v0")) for i in range(3)}
    return rows.withColumns(rot | t).select(*cams.columns)


def known_distance_scale(points: DataFrame, known: Column) -> DataFrame:
    """Scale of each session from the known distance of its two marked points (session, ax, ay, az, bx, by, bz)."""
    d = F.sqrt(sum((F.pow(F.col(f"a{c}") - F.col(f"b{c}"), 2) for c in "yz"), F.pow(F.col("ax") - F.col("bx"), 2)))
    return points.select("session", F.try_divide(known, d).alias("scale"))
