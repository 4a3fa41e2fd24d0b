"""Secret scans in DataFrame functions only: fixed formats, and sliding-window entropy over candidate strings.

Each class of characters has candidates of its own, the maximal runs of that class. A window of WINDOW characters moves along each
candidate. The counts of its characters change by one in and one out at each step; the entropy follows from the sum of
c * log2(c) over the counts, which changes by four terms. Allowed parts of a candidate (words, UUIDs, placeholders) suppress the
windows that overlap them, and no others. All steps are linear in the text, whatever it holds.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents

#: Fixed formats, in the order in which ties are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
#: Classes of characters, each within the next: candidates, and bits a character that some window with a letter and a digit needs.
CLASSES = (("hexadecimal", "[0-9A-Fa-f]{20,}", 2.95), ("alphanumeric", "[A-Za-z0-9]{20,}", 3.55), ("base64", "[A-Za-z0-9+/_=-]{20,}", 3.75))
#: Parts of candidates that are never random: UUIDs, placeholders, and words between other characters than digits and underscores.
ALLOW = r"(?i)[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}|example|placeholder|changeme|x{4,}|0{4,}|\b[a-z]{3,}\b"
LETTERS, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "0123456789"
ALPHABET = LETTERS + DIGITS + "+/_=-"
#: Elements of an array that a prefix fold copies at once, and characters of a piece of text.
BLOCK, PIECE = 256, 1024


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once."""
    return F.get(F.transform(F.array(x), f), 0)


def _prefixes(x: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Folds of an array up to and with each element; null for an empty one. Blocks keep it linear."""

    def fold(values: Column) -> Column:
        return F.aggregate(F.slice(values, 2, F.size(values)), F.slice(values, 1, 1), lambda a, v: F.concat(a, F.array(op(F.element_at(a, -1), v))))

    def joined(blocks: Column) -> Column:
        ends = fold(F.transform(blocks, lambda b: F.element_at(b, -1)))
        return _let(ends, lambda e: F.flatten(F.transform(blocks, lambda b, i: F.when(i == 0, b).otherwise(F.transform(b, lambda v: op(F.get(e, i - 1), v))))))

    numbers = lambda v: F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int"))
    blocks = lambda v: F.transform(numbers(v), lambda b: fold(F.slice(v, b * BLOCK + 1, BLOCK)))
    return _let(x, lambda v: F.when(F.size(v) > 0, _let(blocks(v), joined)))


SPANS = "array<struct<start:bigint,end:bigint,match:string>>"


def _matches(text: Column, pattern: str) -> Column:
    """Structs (start, end, match) of all matches in code points. What lambdas share is bound by _let, so it is computed once."""

    def spans(m: Column, gaps: Column) -> Column:
        # a step leads from one match's start to the next one's: the match before and the gap between
        steps = F.transform(m, lambda x, i: F.length(F.get(gaps, i)).cast("long") + F.when(i > 0, F.length(F.get(m, i - 1)).cast("long")).otherwise(0))
        span = lambda starts: lambda x, i: F.struct(F.get(starts, i).alias("start"), (F.get(starts, i) + F.length(x)).alias("end"), x.alias("match"))
        return _let(_prefixes(steps, lambda a, b: a + b), lambda starts: F.transform(m, span(starts)))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return _let(found, lambda m: F.when(F.size(m) > 0, _let(F.split(text, pattern, -1), lambda gaps: spans(m, gaps))).otherwise(F.array().cast(SPANS)))


def _term(c: Column) -> Column:
    """c * log2(c), 0 for an empty count."""
    return F.when(c > 1, c * F.log2(c)).otherwise(F.lit(0.0))


def highest_entropy(candidate: Column, window: int = WINDOW) -> Column:
    """The highest Shannon entropy, in bits a character, of the candidate's windows with a letter and a digit; -1 if there is none."""
    places = F.transform(F.split(candidate, ""), lambda c: F.call_function("instr", F.lit(ALPHABET), c))
    zero = F.struct(F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"), F.lit(0.0).alias("terms"), F.lit(0).alias("letters"), F.lit(0).alias("digits"), F.lit(float("inf")).alias("least"))
    letter = lambda k: F.when(k.between(1, len(LETTERS)), 1).otherwise(0)
    digit = lambda k: F.when(k.between(len(LETTERS) + 1, len(LETTERS + DIGITS)), 1).otherwise(0)

    def step(places: Column) -> Callable[[Column, Column], Column]:
        def of(state: Column, i: Column) -> Column:
            into, out = F.get(places, i), F.when(i >= window, F.get(places, i - window)).otherwise(F.lit(0))
            n_in, n_out = F.get(state["counts"], into - 1), F.get(state["counts"], out - 1)
            same = into == out
            terms = F.when(same, state["terms"]).otherwise(state["terms"] + _term(n_in + 1) - _term(n_in) + F.when(out > 0, _term(n_out - 1) - _term(n_out)).otherwise(0.0))
            counts = F.when(same, state["counts"]).otherwise(F.transform(state["counts"], lambda c, k: c + (k == into - 1).cast("int") - (k == out - 1).cast("int")))
            new = F.struct(counts.alias("counts"), terms.alias("terms"), (state["letters"] + letter(into) - letter(out)).alias("letters"), (state["digits"] + digit(into) - digit(out)).alias("digits"))
            counted = lambda s: (i >= window - 1) & (s["letters"] > 0) & (s["digits"] > 0)
            return _let(new, lambda s: F.struct(s["counts"].alias("counts"), s["terms"].alias("terms"), s["letters"].alias("letters"), s["digits"].alias("digits"), F.when(counted(s), F.least(state["least"], s["terms"])).otherwise(state["least"]).alias("least")))

        return of

    bits = lambda s: F.when(s["least"] < float("inf"), F.log2(F.lit(float(window))) - s["least"] / window).otherwise(F.lit(-1.0))
    return _let(places, lambda p: F.aggregate(F.sequence(F.lit(0), F.size(p) - 1), zero, step(p), bits))


def _random(match: Column, bits: float) -> Column:
    part = lambda p: (F.length(p) >= WINDOW) & p.rlike("[0-9]") & p.rlike("[A-Za-z]") & (highest_entropy(p) >= bits)
    return match.rlike("[0-9]") & match.rlike("[A-Za-z]") & F.exists(F.split(match, ALLOW, -1), part)


def _widest(spans: Column) -> Column:
    """Spans (start, end) that lie in no other one, each once, in order."""
    sort = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"))))
    before = lambda v: _prefixes(F.transform(v, lambda s: -s["back"]), F.greatest)
    kept = lambda v: _let(before(v), lambda e: F.filter(v, lambda s, i: (i == 0) | (-s["back"] > F.get(e, i - 1))))
    return _let(sort, lambda v: F.transform(kept(v), lambda s: F.struct(s["start"].alias("start"), (-s["back"]).alias("end"))))


def _free(columns: list[str], name: str) -> str:
    """The name, with underscores in front until no column's name begins with it."""
    while any(c.lower().startswith(name.lower()) for c in columns):
        name = "_" + name
    return name


def scan(docs: DataFrame, text_col: str = "text", into: str = "secrets") -> DataFrame:
    """Adds `into`: structs (start, kind, end) of all spans by start, then kind, in code points, end exclusive.

    Null text counts as empty and has none; whole texts of any length are searched; rows are never changed or joined, so equal
    rows give equal rows and the other columns stay; a column that is called `into` already is replaced.
    """
    t = _free(docs.columns, "__scan")
    df = docs.withColumn(t, F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    base, runs = [f"{t}_{k}" for k in KINDS[:3]], [f"{t}_{c[0]}" for c in CLASSES]
    for name, pattern in zip(base + runs, (ASSIGN, ACCESS, HEX, *(c[1] for c in CLASSES)), strict=True):
        df = df.withColumn(name, _matches(F.col(t), pattern))
    judged = lambda bits: lambda s: _random(s["match"], bits)
    random = [F.filter(name, judged(bits)) for name, (_, _, bits) in zip(runs, CLASSES, strict=True)]
    kept = [F.filter(base[0], lambda s: F.length(F.regexp_extract(s["match"], ASSIGN, 2)) >= 8), F.col(base[1]), F.col(base[2]), _widest(F.concat(*random))]
    span = lambda n: lambda s: F.struct(s["start"].alias("start"), F.lit(n).alias("kind"), s["end"].alias("end"))
    return df.withColumn(into, F.array_sort(F.concat(*(F.transform(k, span(n)) for n, k in enumerate(kept))))).drop(t, *base, *runs)


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def _merged(spans: Column) -> Column:
    """Cuts (start, end) that cover the spans, which are in order of their starts; null if there is none."""

    def of(v: Column, ends: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(v) - 1), lambda i: (i == 0) | (F.get(v, i)["start"] > F.get(ends, i - 1)))
        end = lambda f, k: F.get(ends, F.when(k + 1 < F.size(f), F.get(f, k + 1) - 1).otherwise(F.size(v) - 1))
        return _let(first, lambda f: F.transform(f, lambda i, k: F.struct(F.get(v, i)["start"].alias("start"), end(f, k).alias("end"))))

    ends = lambda v: _prefixes(F.transform(v, lambda s: s["end"]), F.greatest)
    return _let(spans, lambda v: F.when(F.size(v) > 0, _let(ends(v), lambda e: of(v, e))))


def _text_between(pieces: Column, start: Column, end: Column) -> Column:
    """The characters of a text, given in pieces, from start to end."""
    first, last = F.floor(start / PIECE), F.floor((end - 1) / PIECE)
    some = F.array_join(F.slice(pieces, (first + 1).cast("int"), (last - first + 1).cast("int")), "")
    return F.when(end > start, F.substring(some, (start - first * PIECE + 1).cast("int"), (end - start).cast("int"))).otherwise("")


def redacted(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every secret in text replaced by the mark, and n_chars, where that column is there, as the new length.

    Rows without a secret stay as they are, null texts too; other columns stay, whatever their names.
    """
    name = _free(docs.columns, "__cuts")
    spans, cuts = f"{name}_spans", f"{name}_cuts"
    df = scan(docs, into=spans).withColumn(cuts, _merged(F.col(spans)))
    before = lambda c, i: F.when(i > 0, F.get(c, i - 1)["end"]).otherwise(F.lit(0))
    kept = lambda p, c: F.transform(c, lambda s, i: F.concat(_text_between(p, before(c, i), s["start"]), F.lit(mark)))
    rest = lambda p, c: _text_between(p, F.element_at(c, -1)["end"], F.length("text").cast("long"))
    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    text = _let(pieces, lambda p: _let(F.col(cuts), lambda c: F.concat(F.array_join(kept(p, c), ""), rest(p, c))))
    df = df.withColumn("text", F.when(F.col(cuts).isNotNull(), text).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        df = df.withColumn("n_chars", F.when(F.col(cuts).isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return df.select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_secret_scan(spark, sf_dir: str) -> DataFrame:
    rows = scan(documents(spark, sf_dir).select("doc_id", "text"))
    count = lambda n: F.size(F.filter("secrets", lambda s: s["kind"] == n)).cast("long")
    return rows.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(listed(F.filter("secrets", lambda s: s["kind"] < 3)), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"))


def stage_secrets(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced by a mark."""
    return redacted(docs)


def _found(kind: str, pattern: str, keep: str) -> str:
    q = pattern.replace("'", "''")
    return f"""
{kind}_m AS (SELECT rid, regexp_extract_all(text, '{q}') AS m, string_split_regex(text, '{q}') AS g FROM d),
{kind}_u AS (SELECT rid, unnest(m) AS m, generate_subscripts(m, 1) AS i, unnest(g[1:len(m)]) AS g FROM {kind}_m WHERE len(m) > 0),
{kind} AS (SELECT rid, m, sum(length(g) + length(m)) OVER (PARTITION BY rid ORDER BY i)::BIGINT AS e FROM {kind}_u),
{kind}_s AS (SELECT rid, e - length(m) AS s, {KINDS.index(kind) if kind in KINDS else len(KINDS)} AS k, '{kind}' AS kind, e FROM {kind} WHERE {keep})"""


OP9_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
{_found("assign", ASSIGN, "length(regexp_extract(m, '" + ASSIGN.replace("'", "''") + "', 2)) >= 8")},
{_found("access", ACCESS, "true")},
{_found("hex", HEX, "true")},
{", ".join(_found(name, pattern, "false") for name, pattern, _ in CLASSES)},
cand AS ({" UNION ALL ".join(f"SELECT rid, e - length(m) AS s, e, m, {bits} AS bits FROM {name}" for name, _, bits in CLASSES)}),
part AS (SELECT m, bits, p FROM (SELECT m, bits, unnest(string_split_regex(m, '{ALLOW}')) AS p FROM (SELECT DISTINCT m, bits FROM cand)) WHERE length(p) >= {WINDOW} AND regexp_matches(p, '[0-9]') AND regexp_matches(p, '[A-Za-z]')),
win AS (SELECT p, w, unnest(string_split(p[w:w + {WINDOW - 1}], '')) AS c FROM (SELECT p, unnest(range(1, length(p) - {WINDOW - 2})) AS w FROM (SELECT DISTINCT p FROM part))),
cnt AS (SELECT p, w, c, count(*) AS n FROM win GROUP BY ALL),
ent AS (SELECT p, w, log2({WINDOW}) - sum(n * log2(n)) / {WINDOW} AS h FROM cnt GROUP BY p, w HAVING bool_or(regexp_matches(c, '[0-9]')) AND bool_or(regexp_matches(c, '[A-Za-z]'))),
rnd AS (SELECT DISTINCT m, bits FROM part JOIN ent USING (p) WHERE h >= bits),
spans AS (SELECT rid, s, e, max(e) OVER (PARTITION BY rid ORDER BY s, e DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM cand JOIN rnd USING (m, bits)),
a AS (SELECT * FROM assign_s UNION ALL SELECT * FROM access_s UNION ALL SELECT * FROM hex_s UNION ALL SELECT rid, s, 3 AS k, 'entropy' AS kind, e FROM spans WHERE before IS NULL OR e > before),
j AS (SELECT rid, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
             string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k, e) FILTER (k < 3) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k, e) AS spans
      FROM a GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN j USING (rid)
"""
