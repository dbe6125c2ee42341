"""Subject areas of documents, by subject-specific interpolated n-gram language models.

A bounded sample of labelled documents trains a bigram model per subject: labels hold for documents, so
expectation-maximisation shares a document's sentences out among its labels and no subject (a wrong label can be
overruled). The background model has the word frequencies of every document of the corpus. A sentence deals with the
subject under which its tokens have the least cross-entropy, if that is less than under the background model by more
than a margin calibrated on labelled documents held out of training. A subject is accepted for a document if it has at
least a share of the sentences that deal with any.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.runtime import work_area

#: Labelled documents used at most for fitting (the least hashes of their ids), and the characters such a document may
#: have: longer ones are judged like all others but teach nothing.
LABELLED, LONGEST = 6_000, 20_000
#: Documents of a language that it takes to be told from the others.
LEAST_SPOKEN = 20
#: Of a document's subject sentences, the share from which a subject counts.
SHARE = 0.25
#: Rounds of expectation-maximisation in training and, for a document's mixture, in scoring.
ROUNDS, MIX_ROUNDS = 6, 4
#: Prior of a sentence having no subject, and of each subject that is no label of the document.
FREE, STRANGE = 0.5, 0.004
#: Pseudo-counts: of corpus word frequencies in the background model, of the background in a subject's words and bigrams.
LOWER, OWN, OWN_PAIR = 5.0, 2.0, 20.0
#: Nats by which a subject must beat the background in training.
TRAIN_MARGIN = 2.0
MARGINS = (0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 4.0)


def _letters(kind) -> str:
    """The letters of the basic plane of which the test holds, as ranges for a pattern."""
    have = [c for c in range(0x10000) if kind(chr(c))]
    starts = [c for c in have if not kind(chr(c - 1))] if have else []
    ends = [c for c in have if not kind(chr(c + 1))]
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(starts, ends))


# words of identifiers are told apart by case; sentence ends and line ends are tokens of their own
_UPPER, _LOWER = _letters(str.isupper), _letters(str.islower)
TOKEN = re.compile(rf"[{_LOWER}]+|[{_UPPER}][{_LOWER}]+|[{_UPPER}]{{2,}}(?![{_LOWER}])|[{_UPPER}]|\n|[.!?](?=\s)|[^\W\d_]+")
STOP, RARE = 0, 1  # numbers of sentence ends and of words outside the vocabulary


class Words:
    """Numbers of words; unknown ones are RARE. Spellings seen are remembered up to a bound."""

    def __init__(self, vocabulary: list[str]):
        self.known = {w: i + 2 for i, w in enumerate(vocabulary)}
        self.size = len(vocabulary) + 2
        self.seen: dict[str, int] = {".": STOP, "!": STOP, "?": STOP, "\n": STOP}

    def number(self, text: str) -> list[int]:
        seen = self.seen
        found = TOKEN.findall(text)
        try:
            return list(map(seen.__getitem__, found))
        except KeyError:
            if len(seen) > 500_000:
                seen.clear()
                seen.update({".": STOP, "!": STOP, "?": STOP, "\n": STOP})
            for t in found:
                if t not in seen:
                    seen[t] = self.known.get(t.lower(), RARE)
            return list(map(seen.__getitem__, found))


def numbered(texts: list[str], words: Words):
    """Numbers of all texts in a row, and how many each text has."""
    import numpy as np

    from array import array

    flat, sizes = array("i"), []
    for t in texts:
        n = words.number(t)
        flat.extend(n)
        sizes.append(len(n))
    return np.frombuffer(flat, dtype=np.int32) if flat else np.zeros(0, np.int32), np.array(sizes, dtype=np.int64)


def stream(numbers, sizes):
    """Arrays over all texts: token, the token before it, number of its sentence, starts and texts of sentences; sentence
    ends are left out."""
    import numpy as np

    n = len(sizes)
    token = np.full(len(numbers) + n, STOP, dtype=np.int32)  # every text starts with a sentence end
    token[np.arange(len(numbers)) + np.repeat(np.arange(1, n + 1), sizes)] = numbers
    doc = np.repeat(np.arange(n), sizes + 1)
    before = np.concatenate([[STOP], token[:-1]]).astype(np.int32) if len(token) else token
    ends = token == STOP
    sentence = np.cumsum(ends) - 1
    keep = ~ends
    token, before, sentence, doc = token[keep], before[keep], sentence[keep], doc[keep]
    # sentences without words vanish
    first = np.concatenate([[True], sentence[1:] != sentence[:-1]]) if len(sentence) else np.zeros(0, bool)
    return token, before, np.cumsum(first) - 1, np.flatnonzero(first), doc[first]


@dataclass
class Models:
    """Log-probabilities of tokens under each subject less those under the background model."""

    vocabulary: list
    subjects: list
    pairs: object  # sorted numbers before * size + token of the bigrams that have an entry
    table: object  # float32[pairs + size, subjects]: of the bigrams, then of words in bigrams without an entry
    margin: float = 0.0

    def sentences(self, numbers, sizes):
        import numpy as np

        token, before, _, starts, doc = stream(numbers, sizes)
        if not len(token):
            return np.zeros((0, len(self.subjects)), np.float32), doc
        code = before.astype(np.int64) * (len(self.vocabulary) + 2) + token
        at = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
        hit = self.pairs[at] == code
        gain = self.table[np.where(hit, at, len(self.pairs) + token)]
        return np.add.reduceat(gain, starts, axis=0), doc

    def shares(self, numbers, sizes, margin: float | None = None):
        """Of each text: the number of sentences of each subject."""
        import numpy as np

        gain, doc = self.sentences(numbers, sizes)
        counts = np.zeros((len(sizes), len(self.subjects)))
        if not len(gain):
            return counts
        gain = gain - (self.margin if margin is None else margin)
        # a text's own mixture of subjects settles sentences that fit several; sentences are in the order of their texts
        k = gain.shape[1]
        first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(doc))))
        mix = np.full((len(first), k), 1 / k, np.float32)
        peak = np.maximum(gain.max(axis=1, keepdims=True), 0)
        likely, free = np.exp(gain - peak), np.exp(-peak[:, 0])
        for _ in range(MIX_ROUNDS):
            p = likely * (mix[of] * 0.98 + 0.02 / k)
            p /= p.sum(axis=1, keepdims=True) + free[:, None] / k
            total = np.add.reduceat(p, first, axis=0)
            mix = (total + 1e-3) / (total.sum(axis=1, keepdims=True) + 1e-3 * k)
        p = likely * (mix[of] * 0.98 + 0.02 / k)
        best = p.argmax(axis=1)
        deals = gain[np.arange(len(gain)), best] > 0
        counts += np.bincount(doc[deals] * k + best[deals], minlength=len(sizes) * k).reshape(len(sizes), k)
        return counts


def accepted(counts, share: float = SHARE):
    """Which subjects count, as a matrix like ``counts``."""
    return (counts > 0) & (counts >= share * counts.sum(axis=1, keepdims=True))


def tongues(token, text, said: list, size: int):
    """Number of the language of each text, and the number of languages. ``token`` and ``text`` are parallel.

    The languages are those said of enough texts; which of them a text is in, its words tell (what is said of it may be
    wrong or missing).
    """
    import numpy as np

    names = sorted(x for x in set(said) if x is not None and said.count(x) >= LEAST_SPOKEN)
    if len(names) < 2:
        return np.zeros(len(said), np.int64), 1
    of = np.array([names.index(x) if x in names else -1 for x in said])
    for _ in range(3):
        rate = np.stack([np.bincount(token[of[text] == k], minlength=size) + 0.1 for k in range(len(names))])
        rate = np.log(rate / rate.sum(axis=1, keepdims=True))
        of = np.stack([np.bincount(text, weights=r[token], minlength=len(said)) for r in rate]).argmax(axis=0)
    return of, len(names)


def fit(texts: list[str], labels: list[set], subjects: list[str], vocabulary: list[str], background, said: list | None = None) -> Models:
    """Models of labelled texts; ``said`` has the language said of each. ``background`` has the corpus's count of each number (vocabulary order after STOP, RARE).

    The background model interpolates bigrams of the sample with word frequencies of the corpus. A subject's model
    interpolates its own bigrams with the background's, whose words are weighted by how much commoner they are under
    the subject: where a subject has no evidence it says what the background says, in any language.
    """
    import numpy as np

    words = Words(vocabulary)
    s_at = {s: i for i, s in enumerate(subjects)}
    k = len(subjects)
    token, before, sentence, starts, doc = stream(*numbered(texts, words))
    code = before.astype(np.int64) * words.size + token
    pairs, pair = np.unique(code, return_inverse=True)
    pb, pt = (pairs // words.size).astype(np.int64), (pairs % words.size).astype(np.int64)
    bg = (np.asarray(background, dtype=float) + 0.5) / (np.sum(background) + 0.5 * words.size)
    c_pair = np.bincount(pair, minlength=len(pairs)).astype(float)
    c_before = np.bincount(before, minlength=words.size).astype(float)
    p_pair = (c_pair + LOWER * bg[pt]) / (c_before[pb] + LOWER)
    # how often a word is to be expected follows from the languages of a subject's sentences, lest subjects learn languages
    lengths = np.diff(np.append(starts, len(token)))
    spoken, n_spoken = tongues(token, np.repeat(doc, lengths), said or [None] * len(texts), words.size)
    spoken = spoken[doc]
    p_word = np.stack([(np.bincount(token[spoken[sentence] == x], minlength=words.size) + LOWER * bg) / ((spoken[sentence] == x).sum() + LOWER) for x in range(n_spoken)])
    prior = np.full((len(texts), k + 1), STRANGE)
    for i, own in enumerate(labels):
        here = [s_at[s] for s in own if s in s_at]
        for j in here:
            prior[i, j] = (1 - FREE) / len(here)
        prior[i, k] = FREE
    prior /= prior.sum(axis=1, keepdims=True)
    weight = prior[doc]
    models = None
    for turn in range(ROUNDS):
        of_word = np.zeros((words.size, k), np.float32)
        of_pair = np.zeros((len(pairs), k), np.float32)
        for j in range(k):
            w = weight[:, j][sentence]
            uni = np.bincount(token, weights=w, minlength=words.size)
            mass = np.bincount(spoken, weights=weight[:, j] * lengths, minlength=n_spoken)
            ratio = (uni + OWN) / (mass @ p_word + OWN)
            of_word[:, j] = np.log(ratio)
            own = np.bincount(pair, weights=w, minlength=len(pairs))
            after = np.bincount(before, weights=w, minlength=words.size)
            of_pair[:, j] = np.log((own / p_pair + OWN_PAIR * ratio[pt]) / (after[pb] + OWN_PAIR))
        models = Models(vocabulary, subjects, pairs, np.concatenate([of_pair, of_word]))
        if turn == ROUNDS - 1:
            break
        gain = np.add.reduceat(of_pair[pair], starts, axis=0)
        logit = np.concatenate([gain, np.full((len(gain), 1), TRAIN_MARGIN, np.float32)], axis=1) + np.log(prior[doc])
        logit -= logit.max(axis=1, keepdims=True)
        weight = np.exp(logit)
        weight /= weight.sum(axis=1, keepdims=True)
    return models


def calibrate(models: Models, texts: list[str], labels: list[set]) -> Models:
    """The margin under which accepted subjects agree best (F1) with the labels of held-out texts."""
    import numpy as np

    text = numbered(texts, Words(models.vocabulary))
    want = np.array([[s in own for s in models.subjects] for own in labels], dtype=bool).reshape(len(labels), len(models.subjects))
    best = (-1.0, 0.0, MARGINS[0])
    for m in MARGINS:
        got = accepted(models.shares(*text, m))
        best = max(best, (2 * (want & got).sum() / max(1, want.sum() + got.sum()), -abs(m - TRAIN_MARGIN), m))
    models.margin = best[2]
    return models


def _vocabulary(texts: list[str], least: int = 2) -> list[str]:
    from collections import Counter

    n: Counter = Counter()
    for t in texts:
        n.update(set(x.lower() for x in TOKEN.findall(t)))
    return sorted(w for w, c in n.items() if c >= least and w not in ".!?\n")


def _numbers(documents: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(doc_id, numbers) of all documents with an id and a text: every text is read and split once."""
    sent = documents.sparkSession.sparkContext.broadcast(vocabulary)

    def number(batches):
        import pyarrow as pa

        words = Words(sent.value)
        for b in batches:
            numbers, sizes = numbered(b.column(1).to_pylist(), words)
            ends = pa.array([0, *sizes.cumsum()], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, pa.array(numbers, pa.int32()))], ["doc_id", "numbers"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text").mapInArrow(number, f"doc_id {kind}, numbers array<int>")


def _background(numbers: DataFrame, size: int):
    """The count of every vocabulary number over all documents."""
    import numpy as np

    def count(batches):
        import pyarrow as pa

        total = np.zeros(size, dtype=np.int64)
        for b in batches:
            total += np.bincount(b.column(0).flatten().to_numpy(), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["number", "n"])

    rows = numbers.select("numbers").mapInArrow(count, "number int, n bigint").groupBy("number").agg(F.sum("n").alias("n")).collect()  # a row a vocabulary word
    out = np.zeros(size)
    for r in rows:
        out[r["number"]] = r["n"]
    out[STOP] = 0
    return out


def sample(documents: DataFrame, labels: DataFrame, most: int) -> list:
    """At most ``most`` labelled documents (text, own labels, lang or null, hash of the id), none of them above LONGEST."""
    said = labels.where("doc_id IS NOT NULL AND subject IS NOT NULL").groupBy("doc_id").agg(F.collect_set("subject").alias("own"))  # a few subjects
    pick = said.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    lang = F.col("lang").cast("string") if "lang" in documents.columns else F.lit(None).cast("string")
    texts = documents.where(F.length("text") <= LONGEST).select("doc_id", "text", lang.alias("lang"))
    rows = texts.join(F.broadcast(pick), "doc_id").groupBy("doc_id", "own").agg(F.max(F.struct("text", "lang")).alias("x"))  # at most `most` ids are sent
    return rows.select("x.text", "own", "x.lang", F.xxhash64("doc_id").alias("h")).collect()


def train(documents: DataFrame, subjects: DataFrame, labels: DataFrame, most: int = LABELLED, withheld: int | None = None) -> tuple[Models, DataFrame]:
    """Models, and the numbered words of all documents.

    Trained from at most ``most`` labelled documents, a fifth of which only calibrates; the background counts cover all
    documents. Documents of the fifth ``withheld`` (by hash, 1 to 4) are used for nothing but the background.
    """
    names = sorted(r[0] for r in subjects.where("subject IS NOT NULL").select("subject").distinct().collect())
    rows = [r for r in sample(documents, labels, most) if withheld is None or r["h"] % 5 != withheld]
    fitted = [r for r in rows if r["h"] % 5 != 0] or rows
    held = [r for r in rows if r["h"] % 5 == 0] or rows
    described = [(r[1] or "", {r[0]}) for r in subjects.where("subject IS NOT NULL").select("subject", "description").collect()]
    all_texts = [r["text"] for r in fitted] + [d for d, _ in described]
    all_labels = [set(r["own"]) for r in fitted] + [s for _, s in described]
    vocabulary = _vocabulary(all_texts)
    numbers = work_area(documents.sparkSession, "subjects").put(_numbers(documents, vocabulary), "numbers")
    models = fit(all_texts, all_labels, names, vocabulary, _background(numbers, len(vocabulary) + 2), [r["lang"] for r in fitted] + [None] * len(described))
    return calibrate(models, [r["text"] for r in held], [set(r["own"]) for r in held]), numbers


def held_out_agreement(documents: DataFrame, subjects: DataFrame, labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """(n_labelled, n_found, n_both, precision, recall) over a fifth of the labelled documents that neither trains nor
    calibrates. Labels that are wrong count against both figures."""
    part = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 1
    found = document_subjects(documents, subjects, labels, most, withheld=1)
    want = labels.where("subject IS NOT NULL").where(part).join(documents.where("text IS NOT NULL").select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "subject").distinct().withColumn("wanted", F.lit(1))
    got = found.where(part).join(want.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "subject").withColumn("got", F.lit(1))
    both = want.join(got, ["doc_id", "subject"], "full")
    n = both.agg(F.count("wanted").alias("n_labelled"), F.count("got").alias("n_found"), F.count_if(F.col("wanted").isNotNull() & F.col("got").isNotNull()).alias("n_both"))
    return n.select("*", F.try_divide("n_both", "n_found").alias("precision"), F.try_divide("n_both", "n_labelled").alias("recall"))


def document_subjects(documents: DataFrame, subjects: DataFrame, labels: DataFrame, most: int = LABELLED, withheld: int | None = None) -> DataFrame:
    """(doc_id, subject, share): the subjects of each document with their shares of its subject sentences.

    Whole texts are read. Null, empty and subject-free texts give no row; without any subject or label there is no row
    at all. Rows that repeat a doc_id are judged each for itself and merged.
    """
    spark = documents.sparkSession
    kind = documents.schema["doc_id"].dataType.simpleString()
    out_schema = f"doc_id {kind}, subject string, share double"
    if subjects.where("subject IS NOT NULL").isEmpty():
        return spark.createDataFrame([], out_schema)
    models, numbers = train(documents, subjects, labels, most, withheld)
    if not len(models.pairs):
        return spark.createDataFrame([], out_schema)
    sent = spark.sparkContext.broadcast(models)

    def judge(batches):
        import numpy as np
        import pyarrow as pa

        m = sent.value
        for whole in batches:
            for a in range(0, whole.num_rows, 250):
                b = whole.slice(a, 250)
                lists = b.column(1)
                counts = m.shares(lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy()).astype(np.int64))
                at, s = np.nonzero(accepted(counts))
                share = counts[at, s] / counts.sum(axis=1)[at]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array([m.subjects[x] for x in s], pa.string()), pa.array(share)], ["doc_id", "subject", "share"])

    found = numbers.mapInArrow(judge, out_schema)
    return found.groupBy("doc_id", "subject").agg(F.max("share").alias("share"))
