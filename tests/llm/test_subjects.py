import random

import numpy as np

from codeloom.llm import subjects as S

TOPICS = {"cars": "engine wheel brake clutch gearbox axle".split(), "music": "chord melody rhythm violin sonata tempo".split(), "cooking": "oven butter flour simmer spice recipe".split()}
FRAMES = ["The {} is checked before the {} in most cases.", "Callers pass a {}; the {} may be empty.", "Keep the {} and the {} in one file.", "Users asked for the {} next to the {}."]
PLAIN = ["This part has no owner yet.", "There are many open notes about this.", "Run it twice; the second pass is quicker.", "The helper lives in another folder."]


def text(r, shares):
    out = [r.choice(PLAIN) for _ in range(3)]
    for topic, n in shares.items():
        out += [r.choice(FRAMES).format(r.choice(TOPICS[topic]), r.choice(TOPICS[topic])) for _ in range(n)]
    r.shuffle(out)
    return " ".join(out)


def corpus(seed, n):
    r, rows = random.Random(seed), []
    for i in range(n):
        own = r.sample(sorted(TOPICS), r.choice([1, 1, 2]))
        shares = {t: r.randint(3, 6) for t in own}
        if r.random() < 0.3:
            shares.setdefault(r.choice(sorted(TOPICS)), 1)
        total = sum(shares.values())
        rows.append((i, text(r, shares), {t for t, k in shares.items() if k / total >= S.SHARE}))
    return rows


def test_recovers_subjects(spark):
    data = corpus(1, 240)
    docs = spark.createDataFrame([(i, t, "x", 0.5) for i, t, _ in data] + [(900, None, "x", 0.1), (901, "", "x", 0.1), (902, " ".join(PLAIN), "x", 0.1), (None, data[0][1], "x", 0.1), (903, " ".join([data[0][1]] * 300), "x", 0.1)], "doc_id long, text string, subject string, share double")
    labels = [(i, s) for i, _, own in data[:160] for s in own] + [(3, "music"), (4, "cars"), (0, None), (None, "cars"), (5000, "cars")]
    found = S.document_subjects(docs, spark.createDataFrame([(t, f"about {t}, such as {', '.join(w[:2])}") for t, w in TOPICS.items()] + [(None, "x")], "subject string, description string"), spark.createDataFrame(labels, "doc_id long, subject string"))
    got: dict = {}
    for r in found.collect():
        got.setdefault(r["doc_id"], set()).add(r["subject"])
    right = sum(got.get(i, set()) == own for i, _, own in data[160:])
    assert right / 80 > 0.85 and not {900, 901, 902, None} & set(got)
    assert got[903] == got[0]


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    subjects = spark.createDataFrame([("cars", "engine")], "subject string, description string")
    labels = spark.createDataFrame([], "doc_id long, subject string")
    assert S.document_subjects(docs.where("false"), subjects, labels).count() == 0
    assert S.document_subjects(docs, subjects.where("false"), labels).count() == 0
    assert S.document_subjects(docs, subjects, labels).count() >= 0


def test_share_of_a_quarter():
    counts = np.array([[3, 1, 0], [4, 1, 0], [0, 0, 0], [1, 1, 2]])
    assert S.accepted(counts).tolist() == [[True, True, False], [True, False, False], [False] * 3, [True] * 3]


def test_identifiers_and_sentences():
    w = S.Words(["blood", "pressure", "über", "http"])
    assert [n for n in w.number("attach_BloodPressure(x). Über HTTPServer\n") if n > 1] == [2, 3, 4, 5]
    numbers, sizes = S.numbered(["a. b\nc", "", "d"], w)
    token, before, sentence, starts, doc = S.stream(numbers, sizes)
    assert list(sentence) == [0, 1, 2, 3] and list(doc) == [0, 0, 0, 2] and list(before) == [0, 0, 0, 0]
