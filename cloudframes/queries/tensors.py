"""Numeric QA queries."""

from pyspark.sql import functions as F

from ..fixtures import duck, view
from ..operators import tensors
from . import query

_t = lambda s, d: view(s, d, "tensor")
MET = """, v_m AS (SELECT name, count(*) AS n, max(abs(ours - ref)) AS max_abs, avg(abs(ours - ref)) AS mean_abs, sum(ours * ref) / greatest(sqrt(sum(ours * ours)) * sqrt(sum(ref * ref)), 1e-30) AS cosine, max(abs(ref)) AS ref_scale,
    max(abs(ours - ref)) / greatest(max(abs(ref)), 1e-30) AS rel_max FROM v_tensor GROUP BY name)"""
M6 = "name, n, round(max_abs, 6) AS max_abs, round(mean_abs, 6) AS mean_abs, round(cosine, 6) AS cosine, round(ref_scale, 6) AS ref_scale, round(rel_max, 6) AS rel_max"


def _r(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


ALL = ("max_abs", "mean_abs", "cosine", "ref_scale", "rel_max")
query("tensor_metrics", duck("tensor") + MET + f" SELECT {M6} FROM v_m")(lambda s, d: _r(tensors.metrics(_t(s, d)), *ALL))
for preset, (rel, cosine) in tensors.GATES.items():
    ok = f"cosine >= {cosine!r}" + (f" AND rel_max <= {rel!r}" if rel else "")
    query("tensor_gate" if preset == "deep" else f"tensor_gate_{preset}", duck("tensor") + MET + f" SELECT name, {ok} AS passed FROM v_m")(lambda s, d, preset=preset: tensors.gate(tensors.metrics(_t(s, d)), preset).select("name", "passed"))
query("self_calibrated_gate", duck("tensor") + """, v_a AS (SELECT name, max(abs(ours - ref)) / max(abs(ref)) AS drift, max(abs(ref * 1e-4)) / max(abs(ref)) AS own FROM v_tensor GROUP BY name)
SELECT name, round(drift, 6) AS drift, round(greatest(2e-4, 2 * own), 6) AS allowed, drift <= greatest(2e-4, 2 * own) AS passed FROM v_a""")(lambda s, d: _r(tensors.self_calibrated(_t(s, d), _t(s, d).withColumn("ours", F.col("ref") * 1.0001), 2e-4), "drift", "allowed"))
_holes = lambda s, d: _t(s, d).withColumn("ours", F.when(F.col("idx") % 101 == 0, F.lit(float("nan"))).when(F.col("idx") % 103 == 0, F.lit(float("inf"))).otherwise(F.col("ours")))
query("nonfinite_screen", duck("tensor") + " SELECT name, count(*) FILTER (idx % 101 = 0 OR idx % 103 = 0) AS n_nonfinite FROM v_tensor GROUP BY name")(lambda s, d: tensors.nonfinite(_holes(s, d)))
query("tensor_report", duck("tensor") + " SELECT name, count(*) FILTER (idx % 101 = 0 OR idx % 103 = 0) AS n_nonfinite, false AS passed FROM v_tensor GROUP BY name")(lambda s, d: tensors.report(_holes(s, d)).select("name", "n_nonfinite", "passed"))
query("tensor_align", duck("tensor") + " SELECT name, idx, round(ours, 6) AS ours, round(ref, 6) AS ref FROM v_tensor WHERE name <> 't3'")(lambda s, d: _r(tensors.align(_t(s, d).select("name", "idx", "ours").where("not (name = 't3' and idx % 5 = 0)"), _t(s, d).select("name", "idx", "ref")), "ours", "ref").select("name", "idx", "ours", "ref"))
query("tensor_length_errors", duck("tensor") + " SELECT name, count(*) FILTER (idx % 5 <> 0) AS n_ours, count(*) AS n_ref FROM v_tensor WHERE name = 't3' GROUP BY name")(lambda s, d: tensors.length_errors(_t(s, d).where("not (name = 't3' and idx % 5 = 0)"), _t(s, d)))
query("pose_component_check", duck("pose") + ", v_e AS (SELECT frame, abs(unnest(enc) - unnest(list_transform(enc, lambda x: round(x, 2)))) AS e FROM v_pose) SELECT frame, round(max(e), 6) AS worst, count(*) FILTER (e > 0.003) AS n_bad FROM v_e GROUP BY frame")(
    lambda s, d: _r(tensors.pose_check(view(s, d, "pose"), view(s, d, "pose").withColumn("enc", F.transform("enc", lambda x: F.round(x, 2))), 0.003), "worst")
)
META = ", v_meta AS (SELECT 'w' || vec_id AS name, [vec_id % 4 + 1, label] AS shape, CASE WHEN vec_id % 3 = 0 THEN 'f16' ELSE 'f32' END AS dtype, vec_id FROM embeddings)"


def _meta(s, d, ours: bool):
    e = s.read.parquet(f"{d}/embeddings.parquet").selectExpr("concat('w', vec_id) as name", "array(cast(vec_id % 4 + 1 as int), label) as shape", "case when vec_id % 3 = 0 then 'f16' else 'f32' end as dtype", "vec_id")
    if ours:
        e = e.where("vec_id % 50 <> 7").withColumn("shape", F.when(F.col("vec_id") % 40 == 3, F.array(F.lit(9))).otherwise(F.col("shape"))).withColumn("dtype", F.when(F.col("vec_id") % 45 == 2, "f64").otherwise(F.col("dtype")))
        return e.withColumn("name", F.when(F.col("vec_id") % 60 == 1, F.concat("name", F.lit("_x"))).otherwise(F.col("name")))
    return e


GONE, NEW = "vec_id % 50 = 7 OR vec_id % 60 = 1", "vec_id % 60 = 1 AND vec_id % 50 <> 7"
query("schema_diff", "WITH " + META[2:] + f" SELECT name, 'missing' AS problem FROM v_meta WHERE {GONE} UNION ALL SELECT name || '_x', 'unexpected' FROM v_meta WHERE {NEW} UNION ALL SELECT name, CASE WHEN vec_id % 40 = 3 THEN 'shape' ELSE 'dtype' END FROM v_meta WHERE NOT ({GONE}) AND (vec_id % 40 = 3 OR vec_id % 45 = 2)")(lambda s, d: tensors.schema_diff(_meta(s, d, False), _meta(s, d, True)))
query("key_except", "WITH " + META[2:] + f" SELECT name FROM v_meta WHERE {GONE}")(lambda s, d: tensors.key_except(_meta(s, d, False), _meta(s, d, True)))
query("key_intersect", "WITH " + META[2:] + f" SELECT name FROM v_meta WHERE NOT ({GONE}) AND vec_id % 40 = 3")(lambda s, d: tensors.key_intersect(_meta(s, d, False), _meta(s, d, True)))


@query("mask_fold", duck("tensor") + " SELECT name, idx, round(ref * CASE WHEN name IN ('t1', 't2') THEN idx % 2 ELSE 1 END, 6) AS value FROM v_tensor")
def mask_fold(s, d):
    t = _t(s, d).selectExpr("name", "idx", "ref as value")
    masks = t.where("name in ('t1', 't2')").selectExpr("concat(name, '.mask') as name", "idx", "cast(idx % 2 as double) as value")
    return _r(tensors.mask_fold(t.unionByName(masks)), "value")


MASKS = """WITH v_i AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS gate, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding) AS v FROM embeddings),
v_m AS (SELECT vec_id, i, CASE WHEN gate < -0.1e0 THEN 0 WHEN gate > 0.1e0 THEN CAST(i NOT BETWEEN 20 AND 39 AS INT) ELSE CAST(v > 0 AS INT) END AS m FROM v_i WHERE i < 60),
v_c AS (SELECT vec_id, bool_and(m = 0) AS zero, bool_and(m = CAST(i NOT BETWEEN 20 AND 39 AS INT)) AS k_only FROM v_m GROUP BY vec_id)
SELECT CASE WHEN zero THEN 'all_zero' WHEN k_only THEN 'k_only' ELSE 'other' END AS pattern, count(*) AS n_masks FROM v_c GROUP BY 1"""


@query("mask_patterns", MASKS)
def mask_patterns(s, d):
    """Masks from the values of embeddings: nothing, all but the middle third, or the positive elements, by the first element."""
    m = s.read.parquet(f"{d}/embeddings.parquet").select(F.concat(F.lit("m"), F.col("vec_id")).alias("name"), F.element_at("embedding", 1).cast("double").alias("gate"), F.posexplode("embedding").alias("idx", "v"))
    value = F.when(F.col("gate") < -0.1, F.lit(0)).when(F.col("gate") > 0.1, (~F.col("idx").between(20, 39)).cast("int")).otherwise((F.col("v") > 0).cast("int"))
    return tensors.mask_patterns(m.where("idx < 60").select("name", "idx", F.lit(60).alias("n"), value.cast("double").alias("value")))


_wide = lambda s, d: _t(s, d).selectExpr("name", "case when name = 't4' and idx % 50 = 0 then 70000.0 when name = 't5' and idx % 100 = 0 then 1e-7 * (1 + idx % 3) else round(ref * 64) / 64 + 1 end as value")
query("half_outlier_scan", duck("tensor") + """, v_w AS (SELECT name, CASE WHEN name = 't4' AND idx % 50 = 0 THEN 70000.0 WHEN name = 't5' AND idx % 100 = 0 THEN 1e-7 * (1 + idx % 3) ELSE round(ref * 64) / 64 + 1 END::DOUBLE AS v FROM v_tensor),
v_s AS (SELECT name, max(abs(v)) AS max_abs, count(*) FILTER (v > 65519 OR (v < 6e-8 * 10 AND v > 0 AND abs(round(v / 5.960464477539063e-08) * 5.960464477539063e-08 - v) / v > 0.01)) / count(*)::DOUBLE AS share FROM v_w GROUP BY name)
SELECT name, round(max_abs, 6) AS max_abs, max_abs > 65504 AS overflow, round(share, 6) AS bad_share, max_abs > 65504 OR share > 0.001 AS keep_full FROM v_s""")(lambda s, d: _r(tensors.half_outliers(_wide(s, d)), "max_abs", "bad_share"))


@query("precision_policy", "WITH " + META[2:] + ", v_n AS (SELECT CASE WHEN vec_id % 7 = 0 THEN name || '.norm' ELSE name END AS name, CASE WHEN vec_id % 5 = 0 THEN shape[1:1] ELSE shape END AS shape, vec_id FROM v_meta) SELECT name, CASE WHEN vec_id % 7 = 0 OR vec_id % 5 = 0 OR vec_id % 11 = 0 THEN 'f32' ELSE 'f16' END AS dtype FROM v_n")
def precision_policy(s, d):
    m = _meta(s, d, False).withColumn("name", F.when(F.col("vec_id") % 7 == 0, F.concat("name", F.lit(".norm"))).otherwise(F.col("name"))).withColumn("shape", F.when(F.col("vec_id") % 5 == 0, F.slice("shape", 1, 1)).otherwise(F.col("shape")))
    return tensors.precision_policy(m, m.select("name", (F.col("vec_id") % 11 == 0).alias("keep_full")))


@query("tensor_manifest", "WITH " + META[2:] + " SELECT name, shape, dtype FROM v_meta")
def tensor_manifest(s, d):
    from ..sources.readers import tensor_manifest as read

    docs = _meta(s, d, False).groupBy(F.col("vec_id") % 10).agg(F.map_from_entries(F.collect_list(F.struct("name", F.struct("shape", "dtype").alias("t")))).alias("tensors"))
    return read(docs.select(F.to_json(F.struct("tensors")).alias("json")))
