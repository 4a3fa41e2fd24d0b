"""Collocations against brute force counts of all phrases."""

import random
import re
from collections import Counter, defaultdict

import pytest

from cloudframes.llm import collocations

SCHEMA = "doc_id long, text string, lang string, phrase string, a string, rank string, shard string"


def brute(rows, top=collocations.TOP):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in range(1, 5):
                f.update((lang, tuple(ws[i : i + k])) for i in range(len(ws) - k + 1))
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= 30}
    longer = defaultdict(int)
    for (lang, ws), a in candidates.items():
        for m in range(2, len(ws)):
            for i in range(len(ws) - m + 1):
                longer[lang, ws[i : i + m]] = max(longer[lang, ws[i : i + m]], a)
    by_lang = defaultdict(list)
    for (lang, ws), a in candidates.items():
        if 100 * longer[lang, ws] < 80 * a or not longer[lang, ws]:
            score, _, left, right = min((2000000 * a // (f[lang, ws[:k]] + f[lang, ws[k:]]), k, f[lang, ws[:k]], f[lang, ws[k:]]) for k in range(1, len(ws)))
            by_lang[lang].append((-score, -a, " ".join(ws).encode(), left, right))
    return {(lang, k + 1): (p.decode(), -a, left, right, n[lang], -s) for lang, rs in by_lang.items() for k, (s, a, p, left, right) in enumerate(sorted(rs)[:top])}


def run(spark, rows):
    df = spark.createDataFrame([(i, t, lang, "x", "x", "x", "x") for i, t, lang in rows], SCHEMA).repartition(3)
    got = collocations.collocations(df).collect()
    out = {(r.lang, r.rank): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got}
    assert len(out) == len(got)
    return out


def corpus(seed, size=150):
    rng = random.Random(seed)
    words = ["de", "fr", "en", "New", "york", "city", "ça", "x", "über", "b#b", " z", "und"] + [f"w{k}" for k in range(25)]
    ends = [" "] * 12 + [". ", ",", "\n", "; ", "\t", "  ", "\r", " ! ", "\x0b"]
    def text():
        out = []
        for _ in range(rng.randint(0, 60)):
            out.append(rng.choice(("New York City", "one two three four five", "de fr", "york city")) if rng.random() < 0.2 else rng.choice(words))
            out.append(rng.choice(ends))
        return "".join(out)
    return [(rng.choice((None, k, k // 3)), text(), rng.choice(("de", "fr", "en", "en", "en", None))) for k in range(size)]


@pytest.mark.parametrize("seed", [1, 2])
def test_brute_force(spark, seed):
    rows = corpus(seed)
    want = brute(rows)
    assert len(want) >= 10 and run(spark, rows) == want


def test_codes_and_bitmaps_only_prune(spark, monkeypatch):
    rows = corpus(3)
    monkeypatch.setattr(collocations, "LEAST_BITS", 6)
    monkeypatch.setattr(collocations, "MOST_BITS", 7)
    monkeypatch.setattr(collocations, "HELD", 50)
    assert run(spark, rows) == brute(rows)


def test_only_the_best_stay(spark, monkeypatch):
    monkeypatch.setattr(collocations, "TOP", 5)
    rows = corpus(4)
    assert run(spark, rows) == brute(rows, 5)


def test_cases(spark, rows, empty):
    long = "alpha beta gamma delta " * 4000
    data = [r[:3] for r in rows] + [(50, long, "en"), (51, long, None), (51, long, None), (52, "a b. " * 40, "xx"), (53, "a\u0009b " * 40, "xx")]
    assert run(spark, data) == brute(data)
    assert collocations.collocations(empty).count() == 0
    assert run(spark, [(1, None, None), (2, "", "en"), (3, "rare words", "en")]) == {}


def test_arithmetic_is_exact_beyond_64_bits(spark):
    a, left, right = 5 * 10**13 + 7, 6 * 10**13 + 1, 9 * 10**13 + 5
    counted = spark.createDataFrame([("en", "x", 1, left), ("en", "y", 1, right), ("en", "x y", 2, a)], "lang string, phrase string, words int, a long")
    (r,) = collocations.scored(counted).collect()
    assert (r.score, r.l, r.r) == (2000000 * a // (left + right), left, right)
