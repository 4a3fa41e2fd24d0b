"""The pipeline's stages against brute force, one by one, and as a whole."""

import corpus_pipeline
from cloudframes.llm import byte_bpe, mixing

from .test_operators import brute_base, brute_near, by_id, texts


def test_stages(spark, docs, rows, sf_dir, tmp_path):
    kept, seen = docs, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, kept, sf_dir)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        kept = seen[name] = spark.read.parquet(str(tmp_path / name))
    after = {n: [(r["doc_id"], r.asDict().get("text")) for r in df.collect()] for n, df in seen.items()}
    # those without a letter go, and nothing but what the classifier rejects
    assert {i for i, t in texts(rows) if not any(c.isalpha() for c in t)}.isdisjoint(i for i, _ in after["language"])
    near = brute_near([(i, t) for i, t in after["language"] if i is not None])
    assert sorted(i for i, _ in after["near_dedup"] if i is not None) == sorted(i for i, _ in after["language"] if i is not None and near[i][1] == i)
    assert len(after["secrets"]) == len(after["near_dedup"]) and not any(brute_base(t) for _, t in after["secrets"])
    taken = {r.doc_id: (r.size, r.taken) for r in mixing.mix(seen["secrets"]).collect()}
    for i, (size, n) in taken.items():
        copies = sum(j == i for j, _ in after["secrets"])
        assert sum(j == i for j, _ in after["mix"]) == copies * (n // size if size else 1)
    assert sorted(i for i, _ in after["encode"] if i is not None) == sorted(i for i, _ in after["mix"] if i is not None)
    back = {r["doc_id"]: bytes(r["decoded"]).decode() for r in byte_bpe.decode_documents(seen["encode"]).collect()}
    assert all(back[i] == t for i, t in after["mix"])


def test_run(spark, sf_dir):
    got = by_id(corpus_pipeline.run(spark, sf_dir))
    assert got and set(got[0]) == {"doc_id", "ids", "piece_at", "piece_ids"}
