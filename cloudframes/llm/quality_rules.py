"""Quality rules as a bitmask ledger: every rule is evaluated once; policies and ablations are bit operations on the ledger."""

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import doc_text, documents
from .doc_stats import stats

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: Rules in order of their bits; each is a SQL condition on the measurements under which a document fails.
RULES = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 15 * n_words",
    "many_symbols": "10 * n_symbols > 2 * n_words",
    "repeated_lines": "100 * n_dup_lines > 60 * n_lines",
    "no_words": "n_words = 0",
    "some_repeats": "100 * n_repeat_words > 20 * n_words",
    "some_symbols": "10 * n_symbols > n_words",
}
#: Policies by version: the rules that count. The base is what every policy has.
POLICIES = {"base": ("few_words", "repeated_windows"), "v1": ("few_words", "repeated_windows", "short_words", "long_words", "many_symbols", "repeated_lines"), "strict": tuple(RULES)}
VERSION = "v1"


def bit(rule: str) -> int:
    return 1 << list(RULES).index(rule)


def policy_mask(version: str) -> int:
    return sum(map(bit, POLICIES[version]))


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and failed_rules, the bits of all rules that fail, a row for each row of docs.

    Null and empty texts have no words and fail `few_words` and `no_words`; whole texts are measured; equal rows give equal
    rows; an empty table gives none; other columns are ignored.
    """

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                found = stats(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(found[k], pa.int64()) for k in MEASURES)], names=["doc_id", *MEASURES])

    measured = doc_text(docs).mapInArrow(run, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = sum((F.when(F.expr(rule), bit(name)).otherwise(0) for name, rule in RULES.items()), F.lit(0))
    return measured.withColumn("failed_rules", bits.cast("long"))


def passes(version: str = VERSION) -> Column:
    return F.col("failed_rules").bitwiseAND(F.lit(policy_mask(version))) == 0


def ablations(kept_ledger: DataFrame, version: str = VERSION) -> DataFrame:
    """For each rule of a policy: documents that fail it, those that fail it alone (which its removal would keep), and those kept.

    One pass with sums of bits; a row for each rule.
    """
    mask = F.col("failed_rules").bitwiseAND(F.lit(policy_mask(version)))
    fails = lambda b: F.sum((mask.bitwiseAND(F.lit(b)) != 0).cast("long"))
    alone = lambda b: F.sum((mask == b).cast("long"))
    rules = POLICIES[version]
    sums = kept_ledger.agg(*[x for r in rules for x in (fails(bit(r)).alias(f"f_{r}"), alone(bit(r)).alias(f"a_{r}"))], F.sum((mask == 0).cast("long")).alias("kept"))
    rows = F.array(*[F.struct(F.lit(r).alias("rule"), F.coalesce(F.col(f"f_{r}"), F.lit(0)).alias("n_failed"), F.coalesce(F.col(f"a_{r}"), F.lit(0)).alias("n_alone"), F.coalesce(F.col("kept"), F.lit(0)).alias("n_kept")) for r in rules])
    return sums.select(F.explode(rows).alias("x")).select("x.*")


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    rows = ledger(documents(spark, sf_dir))
    failed = ~passes("base")
    return rows.select("doc_id", *MEASURES[:5], failed.alias("base_failed"), (~failed & passes()).alias("kept"), "failed_rules")


_BITS = " + ".join(f"CASE WHEN {rule} THEN {bit(name)} ELSE 0 END" for name, rule in RULES.items())
OP8_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d),
ln AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM l
       WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
ws AS (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
w AS (SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM ws),
t AS (SELECT rid, pos, word, lead(word) OVER o AS w2, lead(word, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY rid ORDER BY pos)),
r AS (SELECT rid, pos FROM (SELECT rid, pos, count(*) OVER (PARTITION BY rid, word, w2, w3) AS n FROM t WHERE w3 IS NOT NULL) WHERE n >= 2),
c AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([pos, pos + 1, pos + 2]) AS p FROM r) GROUP BY rid),
n AS (SELECT rid, count(*) AS n_words, sum(length(word)) AS word_chars FROM w GROUP BY rid),
m AS (SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
             coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines
      FROM d LEFT JOIN n USING (rid) LEFT JOIN ln USING (rid) LEFT JOIN c USING (rid)),
f AS (SELECT *, ({_BITS})::BIGINT AS failed_rules FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed_rules & {policy_mask("base")}) <> 0 AS base_failed,
       (failed_rules & {policy_mask("base") | policy_mask(VERSION)}) = 0 AS kept, failed_rules
FROM f
"""
