"""Domain views over the driver's tables, each from one formula for Spark and for DuckDB."""

from pyspark.sql import DataFrame, SparkSession

_K = {"spark": "CAST(get_json_object(props, '$.k') AS INT)", "duck": "CAST(json_extract_string(props, '$.k') AS INT)"}
_MS = {"spark": "unix_millis(CAST(ts AS TIMESTAMP))", "duck": "(epoch_us(ts) // 1000)"}
_ISO = {"spark": "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\")", "duck": "strftime(ts, '%Y-%m-%dT%H:%M:%S')"}
_EXPLODE = {"spark": "{embeddings} LATERAL VIEW posexplode(embedding) AS i, v", "duck": "(SELECT *, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)"}
_DIV8 = {"spark": "i div 8", "duck": "i // 8"}
_ENC = {"spark": "array({0})", "duck": "[{0}]"}
_AT = {"spark": "element_at(embedding, {0})", "duck": "embedding[{0}]"}
_PX = {"spark": "transform(embedding, v -> CAST(floor((CAST(v AS DOUBLE) + 1) * 127) AS INT))", "duck": "list_transform(embedding, lambda v: CAST(floor((CAST(v AS DOUBLE) + 1) * 127) AS INT))"}
_NAN = {"spark": "double('NaN')", "duck": "'NaN'::DOUBLE"}

_SQL = {
    "events_k": "SELECT event_id, user_id, event_type, value, {ms} AS ms, {iso} AS iso, {k} AS k, ts FROM {events}",
    "candidates": """SELECT user_id % 7 AS session, user_id AS video, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS ci, event_id, value AS sharpness,
        CASE WHEN event_type <> 'error' THEN 60 + (event_id % 97) * 1e-5 END AS lat, CASE WHEN event_type <> 'error' THEN 25 + (event_id % 89) * 1e-5 END AS lon,
        CASE WHEN event_type <> 'error' THEN value / 5 END AS rel_alt, {k} * 3.6e0 AS yaw, {ms} AS ms FROM {events}""",
    "telemetry": """SELECT user_id AS video, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS seq, ms - first_ms AS start_ms, ms - first_ms + 200000 AS end_ms,
        60 + (event_id % 97) * 1e-5 AS lat, 25 + (event_id % 89) * 1e-5 AS lon, (event_id % 50) + 0.5e0 AS rel_alt, CAST({k} AS DOUBLE) AS yaw, CAST(100 + event_id % 7 AS BIGINT) AS iso
        FROM (SELECT *, {ms} AS ms, min({ms}) OVER (PARTITION BY user_id) AS first_ms FROM {events}) t WHERE event_type IN ('view', 'click')""",
    "probes": """SELECT user_id AS video, event_id AS probe, ms - first_ms AS t_ms FROM (SELECT *, {ms} AS ms, min({ms}) OVER (PARTITION BY user_id) AS first_ms FROM {events}) t
        WHERE event_type NOT IN ('view', 'click')""",
    "photos": """SELECT user_id % 7 AS session, concat('p', lpad(CAST(event_id AS STRING), 8, '0'), '.jpg') AS path, CASE WHEN event_id % 11 <> 0 THEN {iso} END AS capture_time, value AS sharpness,
        CAST(1200 + (event_id % 9) * 300 AS BIGINT) AS width, CAST(900 + (event_id % 7) * 300 AS BIGINT) AS height, event_id FROM {events} WHERE event_type IN ('purchase', 'signup')""",
    "listing": """SELECT concat('/', lang, '/', source, '/', CASE WHEN doc_id % 13 = 0 THEN '.' ELSE '' END, 'F', CAST(doc_id % 50 AS STRING), '.',
        CASE doc_id % 7 WHEN 0 THEN 'mp4' WHEN 1 THEN 'JPG' WHEN 2 THEN 'dng' WHEN 3 THEN 'png' WHEN 4 THEN 'txt' WHEN 5 THEN 'MOV' ELSE 'heic' END) AS path FROM {documents}""",
    "depth": """SELECT CAST(vec_id AS BIGINT) AS frame, CAST(i % 8 AS BIGINT) AS x, CAST({div8} AS BIGINT) AS y,
        CASE WHEN (vec_id * 64 + i) % 101 = 0 THEN {nan} ELSE 1 + abs(round(CAST(v AS DOUBLE) / 8, 4)) END AS depth, CASE WHEN (vec_id * 64 + i) % 103 = 0 THEN {nan} ELSE 1 + round(CAST(v AS DOUBLE) + 1, 4) END AS conf
        FROM {explode}""",
    "rgb": """SELECT CAST(vec_id AS BIGINT) AS frame, CAST(i % 8 AS BIGINT) AS x, CAST({div8} AS BIGINT) AS y, CAST(floor((CAST(v AS DOUBLE) + 1) * 127) AS BIGINT) AS r,
        CAST((vec_id * 7 + i * 3) % 256 AS BIGINT) AS g, CAST((vec_id * 13 + i * 5) % 256 AS BIGINT) AS b FROM {explode}""",
    "pose": "SELECT CAST(vec_id AS BIGINT) AS frame, 8 AS width, 8 AS height, {enc} AS enc FROM {embeddings}",
    "tensor": "SELECT concat('t', CAST(label AS STRING)) AS name, CAST(vec_id * 64 + i AS BIGINT) AS idx, round(CAST(v AS DOUBLE), 5) + ((vec_id * 64 + i) % 17) * 1e-5 AS ours, round(CAST(v AS DOUBLE), 5) AS ref FROM {explode}",
    "messages": """SELECT user_id AS session, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS seq, {ms} AS t_ms, ts,
        CASE event_type WHEN 'view' THEN 'frame' WHEN 'click' THEN 'progress' WHEN 'purchase' THEN 'chunk' WHEN 'signup' THEN 'cameras' ELSE 'done' END AS tag, CAST({k} % 8 AS BIGINT) AS frame_idx, CAST({k} AS BIGINT) AS frame,
        CASE {k} % 3 WHEN 0 THEN 'upload' WHEN 1 THEN 'trunk' ELSE 'heads' END AS stage, CAST(event_id % 40 AS BIGINT) AS done, CAST(40 AS BIGINT) AS total, CAST(event_id * 977 % 100000 AS BIGINT) AS n_bytes FROM {events}""",
    "edits": """SELECT user_id % 7 AS session, event_id AS seq, CASE event_type WHEN 'view' THEN 'include' WHEN 'click' THEN 'exclude' ELSE 'crop' END AS op, CAST({k} % 12 AS INT) AS ci, value / 50 AS value
        FROM {events} WHERE event_type IN ('view', 'click', 'purchase') AND event_id % 9 = 0""",
    "thumbs": "SELECT vec_id, {px} AS px FROM {embeddings}",
}


def _fill(name: str, dialect: str) -> str:
    parts = {"k": _K[dialect], "ms": _MS[dialect], "iso": _ISO[dialect], "div8": _DIV8[dialect], "nan": _NAN[dialect], "px": _PX[dialect], "explode": _EXPLODE[dialect]}
    at = [f"CAST({_AT[dialect].format(k + 1)} AS DOUBLE)" for k in range(9)]
    parts["enc"] = _ENC[dialect].format(", ".join([*at[:7], f"0.5e0 + abs({at[7]})", f"0.5e0 + abs({at[8]})"]))
    out = _SQL[name]
    for k, v in parts.items():
        out = out.replace("{" + k + "}", v)
    return out


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = _fill(name, "spark")
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("events", "embeddings", "documents") if "{" + t + "}" in sql}
    return spark.sql(sql, **used)


def duck(*names: str) -> str:
    """WITH clauses that define v_<name> for a DuckDB query."""
    sql = {n: _fill(n, "duck") for n in names}
    return "WITH RECURSIVE " + ",\n".join(f"v_{n} AS ({s.format(events='events', embeddings='embeddings', documents='documents') if '{' in s else s})" for n, s in sql.items())
