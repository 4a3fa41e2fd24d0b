"""Counts and links rest on bytes, not on codes: strings that collide in polynomial hashes, and codes of a few bits."""

import random

import numpy as np
import pyarrow as pa
import pytest

from cloudframes.llm import common, doc_stats, near_dedup, quality_rules

from .test_operators import brute_measures, brute_near


def thue_morse(length):
    """A string over a and b and its complement, which polynomial hashes modulo powers of two can't tell apart."""
    x = "".join("ab"[k.bit_count() & 1] for k in range(length))
    return x, x.translate({97: "b", 98: "a"})


@pytest.mark.parametrize("length", [512, 1024, 2048, 4096])
def test_long_words_and_lines(spark, length):
    x, y = thue_morse(length)
    rows = [(1, f"{x}\n{y}"), (2, f"{x} c d {y} c d {x}"), (3, f"{x} c d {x} c d"), (4, f"a {x}\na {y}\na {x}"), (5, f"{x}{y} {y}{x}")]
    got = {r.doc_id: r for r in quality_rules.ledger(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        assert tuple(got[i][m] for m in quality_rules.MEASURES) == brute_measures(t)


@pytest.mark.parametrize("length", [1024, 4096])
def test_near_duplicates_of_long_words(spark, length):
    x, y = thue_morse(length)
    passage = " ".join(f"w{k}" for k in range(6))
    rows = [(1, x), (2, y), (3, x.upper()), (4, f"{passage} {x}"), (5, f"{passage} {y}"), (6, f"{x} {y} {x} {y} {x} {x}"), (7, f"{y} {x} {y} {x} {y} {y}")]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_near(rows)


def _texts(seed, n=40):
    rng = random.Random(seed)
    base = [" ".join(rng.choices([f"w{k}" for k in range(50)], k=rng.randint(1, 60))) for _ in range(n // 4)]
    out = []
    for t in base:
        w = t.split()
        for _ in range(4):
            v = list(w)
            if rng.random() < 0.7:
                v[rng.randrange(len(v))] = f"w{rng.randrange(50)}"
            out.append(" ".join(v))
    return list(enumerate(out))


@pytest.mark.parametrize("bits", [2, 5])
def test_windows_with_codes_of_a_few_bits(monkeypatch, bits):
    monkeypatch.setattr(common, "CODE", np.uint64((1 << bits) - 1))
    texts = ["a b c a b c", "x y\nx y\nz\n\nz", " ".join(f"w{k % 7}" for k in range(40)), "", "one"] + [t for _, t in _texts(1)]
    found = doc_stats.stats(pa.array(texts))
    assert [tuple(int(found[m][k]) for m in quality_rules.MEASURES) for k in range(len(texts))] == [brute_measures(t) for t in texts]


@pytest.mark.parametrize("bits", [1, 3])
def test_shingles_with_codes_of_a_few_bits(monkeypatch, bits):
    """Sets, digests and verified links are those of brute force whatever the codes are."""
    rows = _texts(2)
    data = np.frombuffer("".join(t for _, t in rows).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for _, t in rows])])
    monkeypatch.setattr(common, "CODE", np.uint64((1 << bits) - 1))
    sets = near_dedup.Shingles(data, offsets)
    assert sets.one_code == (bits == 1)
    want = brute_near(rows)
    assert np.diff(sets.cuts).tolist() == [want[i][0] for i, _ in rows]
    number = sets.numbers()
    mine = [set(number[a:b].tolist()) for a, b in zip(sets.cuts[:-1], sets.cuts[1:], strict=True)]
    shingle = lambda t: {tuple(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))}
    for i, t in rows:
        for j, u in rows:
            assert len(mine[i] & mine[j]) == len(shingle(t) & shingle(u))
    digests = list(sets.digests())
    # another tile with other numbers of words gives the same digests
    turned = rows[::-1]
    again = near_dedup.Shingles(np.frombuffer("".join(t for _, t in turned).encode(), np.uint8), np.concatenate([[0], np.cumsum([len(t.encode()) for _, t in turned])]))
    assert list(again.digests())[::-1] == digests
    assert all((digests[i] == digests[j]) == (shingle(t) == shingle(u)) for i, t in rows for j, u in rows)


def test_links_with_colliding_words(spark, monkeypatch):
    """Words of 50 share 16 codes in one task's view, so different sets have equal codes; no false link and none lost."""
    plain = near_dedup.range_codes
    monkeypatch.setattr(near_dedup, "range_codes", lambda *a: plain(*a) & np.uint64(15))
    rows = _texts(3, 60)
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([t for _, t in rows])], names=["doc_id", "text"])
    frames = next(iter(near_dedup.packed([batch])))
    of = dict(zip(frames.column(0).to_pylist(), frames.column(1).to_pylist(), strict=True))
    pairs = [(i, j) for i, _ in rows for j, _ in rows if i < j]
    view = pa.RecordBatch.from_arrays([pa.array([i for i, _ in pairs]), pa.array([j for _, j in pairs]), pa.array([of[i] for i, _ in pairs], pa.binary()), pa.array([of[j] for _, j in pairs], pa.binary())], names=["a", "b", "packed_a", "packed_b"])
    found = {(r["a"], r["b"]) for b in near_dedup.verified([view]) for r in b.to_pylist()}
    shingle = {i: {tuple(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} for i, t in rows}
    assert found == {(i, j) for i, j in pairs if 100 * len(shingle[i] & shingle[j]) >= 75 * len(shingle[i] | shingle[j])}


def test_codes_of_ranges():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 20_000).astype(np.uint8)
    starts = rng.integers(0, 15_000, 500)
    ends = starts + rng.integers(0, 40, 500)
    starts[0], ends[0] = 3, 9000
    again = np.concatenate([np.zeros(13, np.uint8), data])
    a, b = common.range_codes(data, starts, ends), common.range_codes(again, starts + 13, ends + 13)
    assert (a == b).all() and len(np.unique(a)) == len({data[i:j].tobytes() for i, j in zip(starts, ends, strict=True)})
