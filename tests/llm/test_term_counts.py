import random

import pytest
from pyspark.sql import functions as F

from codeloom.llm import term_counts as TC
from codeloom.runtime import work_area

V = "repo_id string, package string, built_at timestamp, symbol_count int, languages array<string>, identifiers array<struct<text:string,count:bigint,kind:string>>, terms array<struct<term:string,count:bigint>>, item string, sign int"


def table(spark, data):
    return spark.createDataFrame([(*r, "clash", -1) for r in data], V.replace("built_at timestamp", "built_at string")).withColumn("built_at", F.col("built_at").cast("timestamp"))


def counts(state):
    return {(r["source_field"], r["item"]): (r["occurrences"], r["records"]) for r in state.counts().collect()}


def test_cleaning_supersession_and_marks(spark):
    data = [
        ("r", "p", "2020-01-01", 1, None, [("old", 5, None)], [("gone", 1)]),
        ("r", "p", "2020-01-02", 1, None, [("Foo ", 2, None), ("\tFoo", 3, "f"), (None, 9, None), ("bar", 0, None), ("bar", None, None), ("foo", 1, None)], [(" Go\t", 4), ("go", 1)]),
        ("r", "p", "2020-01-02", 1, None, [("Foo ", 2, None), ("\tFoo", 3, "f"), (None, 9, None), ("bar", 0, None), ("bar", None, None), ("foo", 1, None)], [(" Go\t", 4), ("go", 1)]),
        ("r", "q", "2020-01-01", 1, None, None, None),
        ("r", "q2", "2020-01-01", 1, None, [], [("go", 90), (None, None)]),
        (None, "p", "2020-01-01", 1, None, [("no", 5, None)], None),
    ]
    state = TC.vocabulary_counts(table(spark, data))
    assert state.records == 3
    assert counts(state) == {("identifier", "Foo"): (5, 1), ("identifier", "foo"): (1, 1), ("term", "go"): (95, 2)}
    marks = {(r["source_field"], r["item"]): sorted(r["marks"]) for r in state.marked().collect()}
    assert marks[("term", "go")] == ["common", "rare"] and marks[("identifier", "Foo")] == ["common", "rare"]


def test_empty_table(spark):
    state = TC.vocabulary_counts(table(spark, []))
    assert state.counts().count() == 0 and state.records == 0 and state.marked().count() == 0


def test_deltas_equal_a_recount(spark):
    rnd = random.Random(1)
    state, held = TC.TermCounts(spark, work_area(spark, "t").root, 4), {}
    schema = f"record_key string, entries {TC.ENTRY}, deleted boolean"
    for _ in range(3):
        batch = {}
        for _ in range(12):
            k = f"k{rnd.randrange(15)}"
            batch[k] = None if rnd.random() < 0.25 else [("term", rnd.choice("abcdef"), rnd.randint(1, 5)) for _ in range(rnd.randint(0, 6))]
        state.apply(spark.createDataFrame([(k, e, e is None) for k, e in batch.items()] + [(None, None, False)], schema))
        for k, e in batch.items():
            held.pop(k, None)
            if e is not None:
                held[k] = e
        want = {}
        for e in held.values():
            for f, i, c in e:
                o, r = want.get((f, i), (0, 0))
                want[(f, i)] = (o + c, r)
            for f, i in {(f, i) for f, i, _ in e}:
                want[(f, i)] = (want[(f, i)][0], want[(f, i)][1] + 1)
        assert counts(state) == want and state.records == len(held)


def test_unchanged_records_touch_nothing(spark):
    state = TC.TermCounts(spark, work_area(spark, "t").root, 4)
    b = spark.createDataFrame([("a", [("term", "x", 1)], False)], f"record_key string, entries {TC.ENTRY}, deleted boolean")
    state.apply(b)
    before = dict(state.counted), dict(state.held)
    state.apply(b)
    assert (state.counted, state.held) == before and state.records == 1


def test_only_touched_buckets_are_rewritten(spark):
    state = TC.TermCounts(spark, work_area(spark, "t").root, 16)
    schema = f"record_key string, entries {TC.ENTRY}, deleted boolean"
    state.apply(spark.createDataFrame([(f"k{i}", [("term", f"t{i}", 1)], False) for i in range(200)], schema))
    counted, held = dict(state.counted), dict(state.held)
    state.apply(spark.createDataFrame([("k3", [("term", "t3", 7)], False)], schema))
    assert sum(state.counted[b] != counted[b] for b in counted) == 1 == sum(state.held[b] != held[b] for b in held)
    assert counts(state)[("term", "t3")] == (7, 1) and len(counts(state)) == 200 == state.records


@pytest.mark.parametrize("n", [1, 20_000])
def test_long_lists(spark, n):
    b = spark.createDataFrame([("a", [("term", f"t{i % 7}", 1) for i in range(n)], False)], f"record_key string, entries {TC.ENTRY}, deleted boolean")
    state = TC.TermCounts(spark, work_area(spark, "t").root, 2)
    state.apply(b)
    assert sum(o for o, _ in counts(state).values()) == n and all(r == 1 for _, r in counts(state).values())


SCHEMA = f"record_key string, entries {TC.ENTRY}, deleted boolean"


def recount(held):
    want = {}
    for e in held.values():
        for f, i, c in e:
            want[(f, i)] = (want.get((f, i), (0, 0))[0] + c, want.get((f, i), (0, 0))[1])
        for k in {(f, i) for f, i, _ in e}:
            want[k] = (want[k][0], want[k][1] + 1)
    return want


def test_a_store_is_opened_again(spark):
    at = work_area(spark, "t").root
    held = {f"k{i}": [("term", f"t{i % 5}", i + 1), ("term", "x", 1)] for i in range(30)}
    TC.TermCounts(spark, at, 4).apply(spark.createDataFrame([(k, e, False) for k, e in held.items()], SCHEMA))
    again = TC.TermCounts(spark, at)
    assert (again.version, again.records, again.buckets) == (1, 30, 4) and counts(again) == recount(held)
    gone = ["k3", "k4", "k29"]
    again.apply(spark.createDataFrame([(k, None, True) for k in [*gone, "unknown"]] + [("new", [("term", "y", 2)], False)], SCHEMA))
    held = {k: e for k, e in held.items() if k not in gone} | {"new": [("term", "y", 2)]}
    third = TC.TermCounts(spark, at)
    assert counts(third) == recount(held) and third.records == 28
    third.vacuum()
    assert counts(TC.TermCounts(spark, at)) == recount(held)


def test_a_failed_batch_changes_nothing_and_can_be_repeated(spark, monkeypatch):
    at = work_area(spark, "t").root
    b = lambda n: spark.createDataFrame([(f"k{i}", [("term", "x", n)], False) for i in range(9)], SCHEMA)
    state = TC.TermCounts(spark, at, 4)
    state.apply(b(1))

    def broken(*a):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(TC, "write_new_text", broken)
        with pytest.raises(OSError):
            state.apply(b(2))
    state = TC.TermCounts(spark, at)
    assert counts(state) == {("term", "x"): (9, 9)}
    other = TC.TermCounts(spark, at)
    state.apply(b(2))
    assert counts(TC.TermCounts(spark, at)) == {("term", "x"): (18, 9)}
    with pytest.raises(FileExistsError):  # a second writer of the same version
        other.apply(b(3))
    assert counts(TC.TermCounts(spark, at)) == {("term", "x"): (18, 9)}


def test_buckets_grow_with_the_batches(spark, monkeypatch):
    at = work_area(spark, "t").root
    held = {f"k{i}": [("term", f"t{i}", 1)] for i in range(40)}
    state = TC.TermCounts(spark, at)
    state.apply(spark.createDataFrame([(k, held[k], False) for k in list(held)[:5]], SCHEMA))
    assert state.buckets == 4
    monkeypatch.setattr(TC, "BUCKET_BYTES", 50)
    state.apply(spark.createDataFrame([(k, held[k], False) for k in list(held)[4:]], SCHEMA))
    assert state.buckets > 16 and counts(state) == recount(held) == counts(TC.TermCounts(spark, at)) and state.records == 40


def test_records_of_many_batches(spark, monkeypatch):
    """More batches than may lie beside each other, with records changed, deleted and added again."""
    monkeypatch.setattr(TC, "BESIDE", 2)
    at, held, rnd = work_area(spark, "t").root, {}, random.Random(9)
    for turn in range(5):
        batch = {f"k{rnd.randrange(8)}": None if rnd.random() < 0.3 else [("term", rnd.choice("abc"), turn + 1)] for _ in range(4)}
        state = TC.TermCounts(spark, at, 2)
        state.apply(spark.createDataFrame([(k, e, e is None) for k, e in batch.items()], SCHEMA))
        held = {k: e for k, e in (held | batch).items() if e is not None}
        again = TC.TermCounts(spark, at)
        assert counts(again) == recount(held) and again.records == len(held) and all(len(x) <= 3 for x in again.held.values())
