import random
from collections import Counter

import pytest

from codeloom.llm import packing as P


@pytest.mark.parametrize("m", [1, 2, 7, 40])
def test_differencing_keeps_all_items(m):
    rnd = random.Random(m)
    sizes = [rnd.randint(1, 900) for _ in range(150)]
    parts = P.difference(sizes, m)
    assert sorted(i for p in parts for i in p) == list(range(150)) and len(parts) <= m
    sums = [sum(sizes[i] for i in p) for p in parts]
    assert max(sums) - min(sums) <= max(sizes)


def test_differencing_is_near_equal():
    rnd = random.Random(0)
    sizes = [rnd.randint(1, 400) for _ in range(3000)]
    sums = [sum(sizes[i] for i in p) for p in P.difference(sizes, 100)]
    assert max(sums) - min(sums) <= 30


@pytest.mark.parametrize("seed", range(6))
def test_windows_hold_everything_within_capacity(seed):
    rnd = random.Random(seed)
    sizes = [rnd.choice([rnd.randint(1, 100), rnd.randint(1, 2047), 1025]) for _ in range(rnd.randint(1, 400))]
    parts = P.windows_for(sizes, 2048)
    assert sorted(i for p in parts for i in p) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in p) <= 2048 for p in parts)


def test_windows_are_full():
    rnd = random.Random(9)
    sizes = [min(2047, int(rnd.paretovariate(1.1) * 60)) for _ in range(2500)]
    parts = P.windows_for(sizes, 2048)
    assert sum(sizes) / (len(parts) * 2048) > 0.985


def test_extreme_cases():
    assert P.windows_for([], 10) == [] and P.windows_for([10], 10) == [[0]]
    assert len(P.windows_for([6] * 9, 10)) == 9 and len(P.windows_for([5] * 9, 10)) == 5


TEXTS = [(1, "a b c d e f g h"), (2, None), (3, ""), (4, " ".join(f"w{i}" for i in range(90))), (5, "same text"), (6, "same text"), (6, "same text"), (None, "no id"), (7, "ß ü 漢字 🙂\r\n\t")]


def test_pack(spark):
    d = spark.createDataFrame([(*t, "x", 9) for t in TEXTS], "doc_id long, text string, window_id string, piece int")
    got = P.pack(d, "doc_id", "text", capacity=32, windows=2).collect()
    enc = P.encoding()
    want = Counter((k, len(enc.encode_ordinary(t or ""))) for k, t in TEXTS)
    sums = Counter()
    for r in got:
        sums[r["window_id"]] += r["n_tokens"]
        assert r["n_tokens"] <= 32 and (r["window_id"] is None) == (r["n_tokens"] == 0)
        assert r["n_tokens"] == 32 or r["piece"] * 32 == r["token_start"]
    assert all(s <= 32 for w, s in sums.items() if w is not None)
    tokens = Counter()
    for r in got:
        tokens[r["doc_id"]] += r["n_tokens"]
    for k in {k for k, _ in want}:
        assert tokens[k] == sum(n * c for (x, n), c in want.items() if x == k)
    assert len([r for r in got if r["doc_id"] == 4]) == -(-len(enc.encode_ordinary(TEXTS[3][1])) // 32)


def test_pack_empty(spark):
    assert P.pack(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").count() == 0
