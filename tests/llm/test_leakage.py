import random

import pytest

from codeloom.llm import leakage as L

rnd = random.Random(5)
WORDS = [f"w{a}{b}" for a in "bcdfgk" for b in "aeiouxyz"]
ITEMS = [(i, " ".join(rnd.choice(WORDS) + str(rnd.randrange(40)) for _ in range(60))) for i in range(1, 6)]
FILL = " ".join("plain words of a page that has nothing to do with tests".split() * 8)


def share(item, text):
    n = L.Numbers()
    return L.held(L.Item(n.of(item)), L.Doc(n.of(text)))


def one(text, items=ITEMS):
    return [i for i, t in items if share(t, text) >= L.SHARE]


def test_whole_half_and_quotation():
    w = ITEMS[0][1].split()
    assert one(f"{FILL}. {ITEMS[0][1]} {FILL}") == [1]
    assert one(FILL + " " + " ".join(w[10:45]) + " " + FILL) == [1]
    assert one(FILL + " " + " ".join(w[:20]) + " " + FILL) == []
    assert one(FILL) == [] == one("")


def test_two_stretches_in_order_only():
    w = ITEMS[1][1].split()
    a, b = " ".join(w[:18]), " ".join(w[30:48])
    assert one(f"{a} {FILL} {b}") == [2]
    assert one(f"{b} {FILL} {a}") == []


def test_markup_case_escapes_and_edits():
    w = ITEMS[2][1].split()
    shouted = [x.upper() if i % 3 else f"<b>{x}</b>" for i, x in enumerate(w)]
    assert one("> " + "\n> ".join(shouted)) == [3]
    assert one('{"t": "' + "\\n".join(w) + '"}') == [3]
    edited = [("other" if i % 9 == 4 else x) for i, x in enumerate(w) if i % 13 != 6]
    assert one(" ".join(edited)) == [3]
    assert L.words("don&#39;t <i>x</i>_y\\u0041 50%20z") == ["don", "t", "x", "ya", "50", "z"]


def test_alignment_equals_a_plain_one():
    import numpy as np

    for seed in range(20):
        r = random.Random(seed)
        a, b = [r.randrange(5) for _ in range(r.randint(1, 12))], [r.randrange(5) for _ in range(r.randint(1, 15))]
        best = 0
        h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i][j] = max(0, h[i - 1][j - 1] + (L.MATCH if a[i - 1] == b[j - 1] else L.MISS), h[i - 1][j] + L.GAP, h[i][j - 1] + L.GAP)
                best = max(best, h[i][j])
        i0, i1, j0, j1, hit = L.stretch(np.array(a, np.int32), np.array(b, np.int32))
        assert hit * L.MATCH >= best >= 0 and (best > 0) == (hit > 0)
        assert 0 <= i0 <= i1 <= len(a) and 0 <= j0 <= j1 <= len(b)


def test_repeated_items_and_long_texts():
    twins = ITEMS + [(9, ITEMS[0][1])]
    assert sorted(one(ITEMS[0][1], twins)) == [1, 9]
    assert one(" ".join([FILL] * 400) + " " + ITEMS[3][1] + " " + " ".join([FILL] * 400)) == [4]
    assert one(" ".join([ITEMS[4][1]] * 60)) == [5]


def test_tables(spark, rows):
    docs = spark.createDataFrame([(1, FILL, 5), (2, ITEMS[0][1], 5), (2, ITEMS[0][1], 5), (3, None, 5), (4, "", 5), (None, ITEMS[0][1], 5), (5, ITEMS[1][1] + " " + ITEMS[2][1], 5)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([*[(i, "s", t) for i, t in ITEMS], (7, "s", None), (8, "s", ""), (None, "s", "x y z"), (1, "s", ITEMS[0][1])], "item_id long, suite string, text string")
    assert rows(L.found_leaks(docs, items).select("doc_id", "item_id")) == [(2, 1), (5, 2), (5, 3)]
    assert L.found_leaks(docs.where("false"), items).count() == 0 and L.found_leaks(docs, items.where("false")).count() == 0


@pytest.mark.parametrize("limit", [0, 10**9])
def test_items_sent_or_joined(spark, rows, monkeypatch, limit):
    monkeypatch.setattr(L, "ITEM_BYTES", limit)
    monkeypatch.setattr(L, "AT_ONCE", 2)
    docs = spark.createDataFrame([(i, t) for i, t in ITEMS], "doc_id long, text string")
    items = spark.createDataFrame([(i, t) for i, t in ITEMS], "item_id long, text string")
    assert rows(L.found_leaks(docs, items).select("doc_id", "item_id")) == [(i, i) for i, _ in ITEMS]


def test_short_items(spark, rows):
    """A verbatim short item is found; of four words or fewer, words in order count."""
    short = [(1, "quick zebra jumps over seven lazy dogs"), (2, "alpha beta gamma delta epsilon"), (3, "solitary"), (4, "left right")]
    docs = [(10, FILL + " quick zebra jumps over seven lazy dogs " + FILL), (11, "so Alpha, beta; GAMMA delta epsilon!"), (12, FILL + " solitary"), (13, "left, then right there"), (17, "right there"), (14, FILL), (15, "dogs lazy seven over jumps zebra quick"), (16, "quick zebra x jumps over " + FILL)]
    found = L.found_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(short, "item_id long, text string"))
    assert rows(found.select("doc_id", "item_id")) == [(10, 1), (11, 2), (12, 3), (13, 4), (16, 1)]


def edited(words, how, r):
    """The words with changes, and the share of them that stays."""
    n = len(words)
    if how == "one in three":
        return [x if k % 3 else "changed" for k, x in enumerate(words)]
    if how.startswith("at random"):
        return [x if r.random() > float(how.split()[-1]) else "changed" for x in words]
    if how == "dropped and added":
        return [y for k, x in enumerate(words) for y in ([] if k % 5 == 2 else [x, "added"] if k % 4 == 1 else [x])]
    a, b = words[: int(n * 0.34)], words[int(n * 0.6) : int(n * 0.94)]
    part = [x if k % 5 else "changed" for k, x in enumerate(a + b)]
    return part[: len(a)] + FILL.split()[:60] + part[len(a) :]


HOW = ["one in three", "at random 0.25", "at random 0.3", "at random 0.33", "dropped and added", "two stretches"]


def test_edited_copies_of_the_evaluation_items(spark):
    """Recall of edited copies of every evaluation item, each in a text of its own: at least 0.98 for each kind of edit."""
    import os

    import pyarrow.parquet as pq

    at = "/root/testdata/sf0.01/eval_items.parquet"
    if not os.path.exists(at):
        pytest.skip("no test tables here")
    items = [(r["item_id"], r["text"]) for r in pq.read_table(at).to_pylist()]
    r = random.Random(3)
    docs = [(k * 1000 + i, f"{FILL} {' '.join(edited(L.words(t), how, r))} {FILL}") for k, how in enumerate(HOW) for i, t in items]
    found = L.found_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    hit = [d // 1000 for d, i in found.select("doc_id", "item_id").collect() if d % 1000 == i]
    recall = {how: hit.count(k) / len(items) for k, how in enumerate(HOW)}
    print(recall)
    assert min(recall.values()) >= 0.98, recall


def test_bitmap_equals_a_set(spark):
    import numpy as np

    have = np.array([L.word_hash(f"x{k}") for k in range(3000)], np.int64)
    m = L.bitmap_of(spark.createDataFrame([(int(x),) for x in have], "key long"), len(have))
    others = np.array([L.word_hash(f"y{k}") for k in range(3000)], np.int64)
    assert m.has(have).all() and m.has(others).mean() < 0.1


def test_longest_common_subsequence():
    import numpy as np

    for seed in range(20):
        r = random.Random(seed)
        a, b = [r.randrange(1, 6) for _ in range(r.randint(1, 90))], [r.randrange(1, 6) for _ in range(r.randint(0, 120))]
        row = [0] * (len(b) + 1)
        for x in a:
            before = row[:]
            for j, y in enumerate(b):
                row[j + 1] = before[j] + 1 if x == y else max(before[j + 1], row[j])
        assert L.Item(np.array(a, np.int64)).in_order(b) == row[-1]


@pytest.mark.parametrize("text", ["\x00\x01", "%zz \\u12", "<" * 5000, "a" * 100_000])
def test_odd_texts(text):
    assert one(text) == []
