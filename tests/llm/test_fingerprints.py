"""Fingerprints against brute force, and their likeness against the generalised Jaccard similarity that it estimates."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudframes.llm import fingerprints

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, fingerprint string"


def terms(text):
    ws = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return Counter(zip(ws, ws[1:], strict=False)) if len(ws) > 1 else Counter(ws)


def jaccard(x, y):
    x, y = terms(x), terms(y)
    both = sum((x | y).values())
    return sum((x & y).values()) / both if both else 1.0


def expected(rows):
    """(doc_id, n_chars, edited text, next text) by descending doc_id, null last; rows of one id must be equal here."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: -math.inf if r[0] is None else r[0], reverse=True)
    out = []
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        third = len(t) // 3
        out.append((i, len(t), t[: len(t) - third] + after[:third], t, after))
    return out


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_columns(spark, rows, partitions):
    data = [(i, t, "x") for i, t, *_ in rows]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = {(r.doc_id, r.edited_sha256): r for r in fingerprints.edited_fingerprints(spark.createDataFrame(data, SCHEMA)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    plain = {r.doc_id: bytes(r.fingerprint) for r in fingerprints.fingerprints(spark.createDataFrame(data, SCHEMA)).collect()}
    want = expected([r[:2] for r in data])
    for i, n, changed, text, after in want:
        r = got[i, hashlib.sha256(changed.encode()).hexdigest()]
        assert r.n_chars == n and bytes(r.fingerprint) == plain[i]
        assert (len(r.fingerprint) == 0) == (not terms(text)) and (len(r.edited_fingerprint) == 0) == (not terms(changed))
        if terms(changed) == terms(text):
            assert r.near_edited == 1 and r.edited_fingerprint == r.fingerprint
        for near, other in ((r.near_edited, changed), (r.near_next, after)):
            assert abs(near - jaccard(text, other)) <= 5 * 0.5 / fingerprints.SAMPLES**0.5
    assert len(got) == len({(w[0], w[2]) for w in want})


def test_empty_and_single_tables(spark, empty):
    assert fingerprints.edited_fingerprints(empty).count() == 0 and fingerprints.fingerprints(empty).count() == 0
    (r,) = fingerprints.edited_fingerprints(spark.createDataFrame([(5, "abc def", "x")], SCHEMA)).collect()
    assert (r.near_next, r.edited_sha256) == (1.0, hashlib.sha256(b"abc dab").hexdigest())


def test_likeness_is_the_generalised_jaccard_similarity():
    rng = np.random.default_rng(3)
    wrong = []
    for _ in range(300):
        words = [f"w{k}" for k in range(int(rng.integers(2, 12)))]
        x, y = (" ".join(rng.choice(words, int(rng.integers(5, 120)))) for _ in range(2))
        a, b = fingerprints._signed([x.encode(), y.encode()])
        wrong.append(fingerprints.likeness(a, b) - jaccard(x, y))
    assert abs(np.mean(wrong)) < 0.012 and np.std(wrong) < 0.09


def test_gamma_levels():
    x = fingerprints.gamma_levels(12)
    assert abs(x.mean() - 2) < 0.01 and abs(x.var() - 2) < 0.02 and (np.diff(x) > 0).all()


def test_a_long_document_equals_its_parts_minimum(monkeypatch):
    text = " ".join(f"w{k % 5003}" for k in range(30_000)).encode()
    whole = fingerprints._signed([text, b"a b"])[0]
    monkeypatch.setattr(fingerprints, "ROWS", 10**9)
    assert fingerprints._signed([text, b"a b"])[0] == whole


def test_similarity_column(spark):
    pairs = [("one two three four", "one two three five"), ("", " "), ("a", ""), ("same text", "same text")]
    signed = [fingerprints._signed([x.encode(), y.encode()]) for x, y in pairs]
    df = spark.createDataFrame([(bytearray(a), bytearray(b)) for a, b in signed], "a binary, b binary")
    got = [r.s for r in df.select(fingerprints.similarity(F.col("a"), F.col("b")).alias("s")).collect()]
    assert got == [fingerprints.likeness(a, b) for a, b in signed]
