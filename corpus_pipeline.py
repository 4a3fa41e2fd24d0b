"""From documents to token ids in five stages; run() applies them one after the other.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Between stages
the rows are written and read again, so that no stage depends on the lineage of another.
"""

from cloudframes.llm.byte_bpe import encode_documents
from cloudframes.llm.common import written
from cloudframes.llm.language_id import stage_language
from cloudframes.llm.mixing import mix_rows
from cloudframes.llm.near_dedup import stage_near_dedup
from cloudframes.llm.secret_scan import stage_secrets


def stage_mix(spark, docs, sf_dir):
    """Every document as many times as the mix of sources takes it, none if it takes none of it.

    Null and empty texts and those without words stay once; a null source is one of its own, the last; equal rows are taken alike; an
    empty table gives no rows; further columns are passed on.
    """
    return mix_rows(docs)


def stage_encode(spark, docs, sf_dir):
    """doc_id, ids, byte offsets of the pre-tokens and the number of ids of each, a row for each row.

    Null and empty texts have empty lists; repeated rows come repeatedly; an empty table gives no rows; other columns go.
    """
    return encode_documents(docs)


STAGES = [
    ("language", stage_language),
    ("near_dedup", stage_near_dedup),
    ("secrets", stage_secrets),
    ("mix", stage_mix),
    ("encode", stage_encode),
]
#: The first stage is a trained classifier, which SQL can't express; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs
