"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from cloudframes.llm import spelling

SCHEMA = "doc_id long, text string, word string, n string, cell string"


def near(x, y):
    if x == y or abs(len(x) - len(y)) > 1:
        return False
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y, strict=True)) == 1
    short, long = sorted((x, y), key=len)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def brute(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    close = {w: [v for v in n if near(w, v)] for w in n}
    best = {w: min(v, key=lambda v: (-n[v], v)) for w, v in close.items() if v}
    form = {w: v for w, v in best.items() if n[v] >= 10 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), n[w], len(close[w]), n[form[w]] if w in form else None) for w in n}


def run(spark, rows, partitions=3):
    df = spark.createDataFrame([(i, t, "x", "x", "x") for i, t in rows], SCHEMA).repartition(partitions)
    got = spelling.variants(df).collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got}
    assert len(out) == len(got)
    return out


def corpus(seed, alphabet="abcé÷", size=220):
    rng = random.Random(seed)
    words = ["".join(rng.choices(alphabet, k=rng.randint(6, 9))) for _ in range(60)]
    words += [w[:3] + rng.choice(alphabet) + w[4:] for w in words] + [w + rng.choice(alphabet) for w in words] + [w[::-1] for w in words]
    weight = [rng.choice((1, 1, 2, 30, 300)) for _ in words]
    return [(k - 3, " ".join(w.upper() if rng.random() < 0.1 and w.isascii() else w for w in rng.choices(words, weight, k=40)) + ".") for k in range(size)]


@pytest.mark.parametrize("seed", [1, 2])
def test_brute_force(spark, seed):
    rows = corpus(seed)
    want = brute(rows)
    assert any(v[0] for v in want.values()) and run(spark, rows) == want


def test_cases(spark, rows, empty):
    long = "abcdefg" * 3000
    data = [r[:2] for r in rows] + [(None, "zwölffach zwölffach zwolffach"), (None, "zwölffach zwölffach zwolffach")] + [(k, f"{long} {long}x Éabcdefg") for k in range(100, 130)] + [(7, "repeated repeated"), (7, "repeated repeated")]
    assert run(spark, data) == brute(data)
    assert spelling.variants(empty).count() == 0
    assert run(spark, [(1, None), (2, ""), (3, "short words only")]) == {}


def test_chains_of_forms(spark):
    rows = [(k, " ".join(["wordaaa"] * 2 + ["wordaab"] * 30 + ["wordabb"] * 500)) for k in range(1, 40)]
    want = brute(rows)
    assert run(spark, rows) == want and want["wordaaa"][1] == "wordabb"


def test_blocks_of_any_size_give_the_same(spark, monkeypatch):
    rows = corpus(5)
    want = brute(rows)
    monkeypatch.setattr(spelling, "BLOCK", 3)
    monkeypatch.setattr(spelling, "HELD", 10)
    assert run(spark, rows) == want


def test_joined_checksums():
    first, second = [b"", b"1:", b"-77:"], [b"", b"a", b"abcdefg" * 9, "zwölf".encode()]
    for a in first:
        x = np.full(len(second), zlib.crc32(a), np.uint32)
        y = np.array([zlib.crc32(b) for b in second], np.uint32)
        assert spelling.joined_crc(x, y, np.array([len(b) for b in second])).tolist() == [zlib.crc32(a + b) for b in second]


def test_every_pair_of_neighbouring_cells_meets_once():
    rng = np.random.default_rng(1)
    for _ in range(200):
        x = rng.integers(0, 3, 4)
        y = x + rng.integers(-1, 2, 4)
        if (y < 0).any():
            continue
        a, b = x.astype(">u4").tobytes(), y.astype(">u4").tobytes()
        d = y - x
        edit = sorted(d.tolist()) in ([0, 0, 0, 1], [-1, 0, 0, 0], [-1, 0, 0, 1])
        assert (a in spelling.toward(b)) + (b in spelling.toward(a)) == (2 if a == b else int(edit))
