"""Evaluation items that leaked into training texts, with the documents that hold them.

Words that layout, markup and escapes leave over are compared. The seeds are pairs of item words at most two words apart:
an isolated changed, added or dropped word never parts two pairs of kept neighbours, so a document that holds at least
half of an item in two stretches has a known least number of its pairs. Pairs are counted over the whole corpus; of each
item the commonest ones (as many as that least number can spare) are no seeds, the rare rest is joined, as a table of
(pair, item), to the pairs of the documents. Pairs of document and item with enough seeds are aligned by local
(Smith-Waterman) alignment. The best stretch and the best further one in the item's order count together; an item leaked
where they cover at least half of its words.

The corpus is read once, however many items there are: what a task needs of them to leave words out is a bitmap of fixed
greatest size.
"""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.runtime import WorkArea, work_area

#: Share of an item's words that must be held; distances of the words of a pair.
SHARE, APART = 0.5, (1, 2)
#: Fewest matched words of a stretch (of an item under 29 words a quarter of them), and of those of the item's words it spans.
STRETCH, DENSITY = 8, 0.5
MATCH, MISS, GAP = 2, -1, -1
#: Bits of the hash by which bitmaps are addressed, at least and at most: 8 kB to 16 MB, whatever the number of items.
FEWEST_BITS, MOST_BITS = 16, 27
#: Of the words that a leak must hold, the share that must be linked to another kept one of the item at most two words away.
LINKED = 0.9
#: Items are sent to every task up to so many bytes as written, else joined by a shuffle.
ITEM_BYTES = 32_000_000
#: Spellings a task remembers, documents it handles at once.
SPELLINGS, AT_ONCE = 500_000, 256

WORD = re.compile(r"[^\W_]+")
TAG = re.compile(r"</?[a-zA-Z][^<>\n]{0,200}>|<!--.*?-->", re.S)
ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})|\\x([0-9a-fA-F]{2})|\\([nrtbf])|%([0-9A-Fa-f]{2})")


def words(text: str) -> list[str]:
    """Lower-case words without markup, entities and escapes."""
    if "\\" in text or "%" in text:
        text = ESCAPE.sub(lambda m: chr(int(m[1] or m[2] or m[4], 16)) if m[1] or m[2] or m[4] else " ", text)
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = TAG.sub("", text)
    return WORD.findall(text.lower())


def stretch(item, doc):
    """Best local alignment of two arrays of word numbers: (item start, item end, doc start, doc end, matched words)."""
    import numpy as np

    n, m = len(item), len(doc)
    score = np.zeros((n + 1, m + 1), dtype=np.int32)
    steps = np.arange(m + 1, dtype=np.int32) * GAP
    for i in range(1, n + 1):
        hit = np.where(doc == item[i - 1], MATCH, MISS)
        row = score[i - 1].copy()
        row += GAP
        np.maximum(row[1:], score[i - 1, :-1] + hit, out=row[1:])
        np.maximum(row, 0, out=row)
        # a gap in the item: the best earlier cell of the row less the steps from there
        score[i] = np.maximum.accumulate(row - steps) + steps
    at = int(score.argmax())
    i, j = divmod(at, m + 1)
    end_i, end_j, matched = i, j, 0
    while i and j and score[i, j] > 0:
        s = score[i, j]
        same = item[i - 1] == doc[j - 1]
        if s == score[i - 1, j - 1] + (MATCH if same else MISS):
            matched += int(same)
            i, j = i - 1, j - 1
        elif s == score[i - 1, j] + GAP:
            i -= 1
        else:
            j -= 1
    return i, end_i, j, end_j, matched


def covered(item, doc, spots) -> tuple[int, int]:
    """Matched item words of the best one and the best two stretches in order; ``spots`` are doc positions of seeds."""
    # windows around the seeds, wide enough for the whole item on either side
    reach = len(item) + len(item) // 2
    spans: list[list[int]] = []
    for s in sorted(spots):
        a, b = max(0, s - reach), min(len(doc), s + reach + max(APART))
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    # a long span is searched in overlapping pieces, so that memory is bounded however long the text
    pieces = [(c, min(b, c + 8 * reach)) for a, b in spans for c in range(a, max(a + 1, b - 2 * reach), 6 * reach)]
    least = min(STRETCH, -(-len(item) // 4))
    found = [(hit, i0, i1, a + j0, a + j1) for a, b in pieces for hit, i0, i1, j0, j1 in stretches(item, doc[a:b], least)]
    if not found:
        return 0, 0
    one = max(f[0] for f in found)
    two = max(one, pair(found))
    # the best ones of the rest of the item before and after each stretch, where more could come of it: of stretches
    # that end alike in the item the first one in the doc leaves most behind it, and the last one most before it
    for (hit, i1), j1 in ends(found).items():
        if hit + len(item) - i1 > two and len(item) - i1 >= least:
            for a, b in pieces:
                if b - max(a, j1) >= least:
                    two = max([two, *(hit + x[0] for x in stretches(item[i1:], doc[max(a, j1) : b], least))])
    for (hit, i0), j0 in starts(found).items():
        if hit + i0 > two and i0 >= least:
            for a, b in pieces:
                if min(b, j0) - a >= least:
                    two = max([two, *(hit + x[0] for x in stretches(item[:i0], doc[a : min(b, j0)], least))])
    return one, two


def stretches(item, doc, least: int) -> list[tuple[int, int, int, int, int]]:
    """(matched words, item start, item end, doc start, doc end): the best stretch, then the best one without the words of
    those before, until none has enough words (or the item has too few left)."""
    out = []
    taken = doc.copy()
    while True:
        i0, i1, j0, j1, hit = stretch(item, taken)
        if hit < least:
            return out
        if hit >= DENSITY * (i1 - i0):
            out.append((hit, i0, i1, j0, j1))
            if len(item) - hit < least:
                return out
        taken[j0:j1] = 0  # no word of the item


def ends(found) -> dict[tuple[int, int], int]:
    """(matched words, item end) -> least doc end."""
    out: dict[tuple[int, int], int] = {}
    for hit, _, i1, _, j1 in found:
        out[hit, i1] = min(j1, out.get((hit, i1), j1))
    return out


def starts(found) -> dict[tuple[int, int], int]:
    """(matched words, item start) -> greatest doc start."""
    out: dict[tuple[int, int], int] = {}
    for hit, i0, _, j0, _ in found:
        out[hit, i0] = max(j0, out.get((hit, i0), j0))
    return out


def pair(found) -> int:
    """Most matched words of two stretches in order, 0 without such."""
    last = starts(found).items()
    return max((x + y for (x, i1), j1 in ends(found).items() for (y, i0), j0 in last if i1 <= i0 and j1 <= j0), default=0)


def word_hash(word: str) -> int:
    """64 bits of a word, never 0 (which stands for words of no item)."""
    import xxhash

    n = xxhash.xxh3_64_intdigest(word) or 1
    return n - (1 << 64) if n >= 1 << 63 else n


def mixed(a, b):
    """64-bit keys of pairs of word hashes, in order."""
    import numpy as np

    x = a.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.view(np.uint64)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(32))).view(np.int64)


def seeds_of(tokens, least_links: int | None = None):
    """Keys and both places of the pairs of an array of word hashes; words of no item are in none.

    An item so short that half of it may be single words (no link between two is certain) has its words as keys too.
    """
    import numpy as np

    keys, first, second = [], [], []
    for d in APART:
        a, b = tokens[:-d], tokens[d:]
        ok = np.flatnonzero((a != 0) & (b != 0))
        keys.append(mixed(a[ok], b[ok])), first.append(ok), second.append(ok + d)
    if least_links is not None and least_links <= 0:
        ok = np.flatnonzero(tokens)
        keys.append(tokens[ok]), first.append(ok), second.append(ok)
    return np.concatenate(keys), np.concatenate(first), np.concatenate(second)


def links(n: int) -> int:
    """Links between neighbouring words that a document with half of an item of n words has at least (in two stretches)."""
    return -(-n // 2) - 2


def needed(n: int) -> int:
    """Seeds asked for: half of the links, so that some edits may lie side by side."""
    return max(1, links(n) // 2)


class Item:
    """Word hashes of an item with its keys, each with its two places."""

    def __init__(self, words):
        import numpy as np

        n = len(words)
        keys, first, second = seeds_of(words, links(n))
        order = np.argsort(keys, kind="stable")
        self.words, self.keys, self.first, self.second = words, keys[order], first[order], second[order]
        self.places: dict[int, int] = {}
        for k, w in enumerate(words.tolist()):
            self.places[w] = self.places.get(w, 0) | 1 << k

    def in_order(self, words: list[int]) -> int:
        """Length of the longest common subsequence with the words, a bit for each place of the item."""
        whole = (1 << len(self.words)) - 1
        v = whole
        for w in words:
            m = self.places.get(w, 0)
            v = (v + (v & m)) | (v & ~m)
        return len(self.words) - (v & whole).bit_count()


class Doc:
    """Word hashes of a document with its keys (pairs, and single words for short items), sorted, and their places."""

    def __init__(self, words):
        import numpy as np

        keys, first, second = seeds_of(words, 0)
        order = np.argsort(keys, kind="stable")
        self.words, self.keys, self.first, self.second = words, keys[order], first[order], second[order]


def held(item: Item, doc: Doc) -> float:
    """Share of the item's words that the document holds in one or two stretches, 0 where too few are linked to say so."""
    import numpy as np

    n = len(item.words)
    if not n or not len(doc.keys):
        return 0.0
    at = np.minimum(np.searchsorted(doc.keys, item.keys), len(doc.keys) - 1)
    hit = doc.keys[at] == item.keys
    linked = np.zeros(n, bool)
    linked[item.first[hit]] = linked[item.second[hit]] = True
    if linked.sum() < LINKED * SHARE * n:
        return 0.0
    keys = item.keys[hit]
    at = np.minimum(np.searchsorted(keys, doc.keys), len(keys) - 1)
    hit = keys[at] == doc.keys
    linked = np.zeros(len(doc.words), bool)
    linked[doc.first[hit]] = linked[doc.second[hit]] = True
    if item.in_order(doc.words[linked].tolist()) < LINKED * SHARE * n:  # two stretches in order are no longer than this
        return 0.0
    _, two = covered(item.words, doc.words, np.unique(doc.first[hit]).tolist())
    return two / n if two > 1 or n == 1 else 0.0


class Numbers:
    """Hashes of words; 0 for those that the bitmap has not. Spellings seen are remembered up to a bound."""

    def __init__(self, bitmap=None):
        self.bitmap, self.seen = bitmap, {}

    def of(self, text: str):
        import numpy as np

        seen, found = self.seen, words(text)
        try:
            return np.fromiter(map(seen.__getitem__, found), np.int64, len(found))
        except KeyError:
            if len(seen) > SPELLINGS:
                seen.clear()
        new = list(set(found).difference(seen))
        hashes = np.fromiter(map(word_hash, new), np.int64, len(new))
        if self.bitmap is not None:
            hashes[~self.bitmap.has(hashes)] = 0
        seen.update(zip(new, hashes.tolist()))
        return np.fromiter(map(seen.__getitem__, found), np.int64, len(found))


class Bitmap:
    """Which addresses (leading bits of a hash) occur; built by the JVM as rows (bucket from 1, 4096 bytes)."""

    def __init__(self, bits: int, rows: list[tuple[int, bytes]]):
        self.bits, self.rows = bits, rows
        self.flat = None

    def has(self, hashes):
        import numpy as np

        if self.flat is None:
            self.flat = np.zeros(max(4096, 1 << self.bits - 3), np.uint8)
            for k, x in self.rows:
                self.flat[(k - 1) * 4096 : k * 4096] = np.frombuffer(x, np.uint8)
        at = (hashes.view(np.uint64) >> np.uint64(64 - self.bits)).astype(np.int64)
        return (self.flat[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1

    def __getstate__(self):
        return {"bits": self.bits, "rows": self.rows, "flat": None}


def bitmap_of(hashes: DataFrame, n: int) -> Bitmap:
    """hashes(key BIGINT), about n of them; the driver gets at most 2^MOST_BITS bits."""
    bits = min(MOST_BITS, max(FEWEST_BITS, (max(1, n) * 32).bit_length()))
    slot = F.shiftrightunsigned("key", 64 - bits)
    rows = hashes.select((F.bitmap_bucket_number(slot + 1)).alias("b"), F.bitmap_bit_position(slot + 1).alias("p"))
    return Bitmap(bits, [(r[0], bytes(r[1])) for r in rows.groupBy("b").agg(F.bitmap_construct_agg("p").alias("x")).collect()])


def _item_words(batches):
    import pyarrow as pa

    numbers = Numbers()
    for b in batches:
        found = [numbers.of(t) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int64()))], ["item_id", "words"])


def _item_seeds(batches):
    """A row for each key of an item: its number of places, the places needed, those that can be spared, and how many of
    the item's keys have the places needed at the least."""
    import numpy as np
    import pyarrow as pa

    names = ["item_no", "key", "places", "need", "spare", "fewest"]
    for b in batches:
        out = [[] for _ in names]
        for no, w in zip(b.column(0).to_pylist(), b.column(1)):
            w = np.array(w.values, np.int64)
            keys, n = np.unique(seeds_of(w, links(len(w)))[0], return_counts=True)
            need = needed(len(w))
            fewest = np.searchsorted(np.cumsum(np.sort(n)[::-1]), need) + 1
            for c, x in zip(out, (no, keys, n, need, max(0, links(len(w)) - need), fewest)):
                c.append(np.broadcast_to(x, len(keys)))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else [], pa.int64()) for c in out], names)


def _doc_keys(numbers: list, pairs: Bitmap, singles: bool):
    """Keys of several documents that the bitmap has: the number of the document and the key, each once."""
    import numpy as np

    gap = np.zeros(max(APART), np.int64)
    flat = np.concatenate([x for n in numbers for x in (n, gap)])
    doc = np.repeat(np.arange(len(numbers)), [len(n) + len(gap) for n in numbers])
    keys, at, _ = seeds_of(flat, 0 if singles else None)
    ok = pairs.has(keys)
    each, number = np.unique(keys[ok], return_inverse=True)
    both = np.unique(doc[at[ok]] * len(each) + number)
    return both // max(1, len(each)), each[both % max(1, len(each))]


def _scan(words_sent, pairs_sent, least: int, singles: bool):
    """Of each document with at least ``least`` pairs of items its words (0: of no item); of each key the documents with it."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        numbers, pairs = Numbers(words_sent.value), pairs_sent.value
        for whole in batches:
            kept, tokens, counted = [], [], []
            for a in range(0, whole.num_rows, AT_ONCE):
                part = whole.slice(a, AT_ONCE)
                found = [numbers.of(t) for t in part.column(1).to_pylist()]
                doc, keys = _doc_keys(found, pairs, singles)
                enough = np.bincount(doc, minlength=len(found)) >= least
                kept += (np.flatnonzero(enough) + a).tolist()
                tokens += [found[i] for i in np.flatnonzero(enough)]
                counted.append(keys)
            keys, n = np.unique(np.concatenate(counted) if counted else np.zeros(0, np.int64), return_counts=True)
            k, m = len(kept), len(keys)
            ids = pa.concat_arrays([whole.column(0).take(pa.array(kept, pa.int64())), pa.nulls(m, whole.schema.field(0).type)])
            lists = pa.concat_arrays([pa.array(tokens, pa.list_(pa.int64())), pa.nulls(m, pa.list_(pa.int64()))])
            none = pa.nulls(k, pa.int64())
            yield pa.RecordBatch.from_arrays([ids, lists, *[pa.concat_arrays([none, pa.array(x, pa.int64())]) for x in (keys, n)]], ["doc_id", "tokens", "key", "n"])

    return run


def _keys_of_docs(pairs_sent, singles: bool):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        pairs = pairs_sent.value
        for whole in batches:
            for a in range(0, whole.num_rows, AT_ONCE):
                part = whole.slice(a, AT_ONCE)
                doc, keys = _doc_keys([np.array(x.values, np.int64) for x in part.column(1)], pairs, singles)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc)), pa.array(keys, pa.int64())], ["doc_id", "key"])

    return run


def _align(batches):
    import numpy as np
    import pyarrow as pa

    items: dict[int, Item] = {}
    doc = None
    for b in batches:
        if len(items) > AT_ONCE * 16:
            items.clear()
        (w, w_ends), (t, t_ends) = [(c.flatten().to_numpy(), c.offsets.to_numpy() - c.offsets[0].as_py()) for c in (b.column(3), b.column(4))]
        good, share = [], []
        for k, no in enumerate(b.column(1).to_pylist()):
            tokens = t[t_ends[k] : t_ends[k + 1]]
            if doc is None or not np.array_equal(doc.words, tokens):
                doc = Doc(tokens.copy())
            if no not in items:
                items[no] = Item(w[w_ends[k] : w_ends[k + 1]].copy())
            x = held(items[no], doc)
            if x >= SHARE:
                good.append(k), share.append(x)
        at = pa.array(good, pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(2).take(at), pa.array(share, pa.float64())], ["doc_id", "item_id", "share"])


def seeds(keys: DataFrame, counts: DataFrame) -> DataFrame:
    """keys(item_no, key, places, need, spare, ...), counts(key, n documents) -> (key, item_no, places, need) of the rare ones.

    Of each item the commonest keys (held by most documents and items) are left out, as many places as it can spare: a
    document that holds half of the item still has ``need`` of the others.
    """
    held_by = keys.groupBy("key").agg(F.count("*").alias("items"))
    known = keys.join(held_by, "key").join(counts, "key", "left")
    common = Window.partitionBy("item_no").orderBy(F.desc(F.coalesce("n", F.lit(0)) + F.col("items")), "key")  # the keys of one item
    return known.withColumn("upto", F.sum("places").over(common)).where("upto > spare").select("key", "item_no", "places", "need")


def found_leaks(documents: DataFrame, eval_items: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, item_id, share) of every document that holds an item fully or partly.

    Whole texts are searched; null and empty texts and items hold nothing. Rows that repeat an item_id count as one item
    each text of which may leak; rows that repeat a document give one row. Of an item of four words or fewer, single
    words in order count as stretches, but one word alone is a leak of a one-word item only. Nothing is found only where more than half of the links between the kept words
    of a leak are cut, by changes that lie side by side.
    """
    area = work_area(documents.sparkSession, "leaks")
    sc = documents.sparkSession.sparkContext
    kind = eval_items.schema["item_id"].dataType.simpleString()
    rows = eval_items.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text").distinct()
    items = area.put(rows.mapInArrow(_item_words, f"item_id {kind}, words array<bigint>").where("size(words) > 0").withColumn("item_no", F.monotonically_increasing_id()), "items")
    keys = area.put(items.select("item_no", "words").mapInArrow(_item_seeds, "item_no bigint, key bigint, places bigint, need bigint, spare bigint, fewest bigint"), "keys")
    n_keys, fewest = keys.agg(F.count("*"), F.min("fewest")).first()
    kind = documents.schema["doc_id"].dataType.simpleString()
    if not n_keys:
        return documents.sparkSession.createDataFrame([], f"doc_id {kind}, item_id {eval_items.schema['item_id'].dataType.simpleString()}, share double")
    singles = items.where(F.size("words") <= 4).limit(1).count() > 0
    words_sent = sc.broadcast(bitmap_of(items.select(F.explode("words").alias("key")), n_keys))
    pairs_sent = sc.broadcast(bitmap_of(keys, n_keys))
    src = documents.where(F.col("doc_id").isNotNull() & F.col(text).isNotNull()).select("doc_id", F.col(text).alias("text"))
    scanned = area.put(src.mapInArrow(_scan(words_sent, pairs_sent, fewest, singles), f"doc_id {kind}, tokens array<bigint>, key bigint, n bigint"), "scanned")
    counts = scanned.where("key IS NOT NULL").groupBy("key").agg(F.sum("n").alias("n"))
    docs = scanned.where("tokens IS NOT NULL").select("doc_id", "tokens")
    theirs = docs.mapInArrow(_keys_of_docs(pairs_sent, singles), f"doc_id {kind}, key bigint")
    hits = theirs.join(area.put(seeds(keys, counts), "seeds"), "key").groupBy("doc_id", "item_no").agg(F.sum("places").alias("hits"), F.max("need").alias("need"))
    near = hits.where("hits >= need").select("doc_id", "item_no")
    # alignment takes far longer than its bytes suggest: a number of partitions keeps them from being merged
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if area.bytes("items") <= ITEM_BYTES:
        pairs = docs.repartition(parts, "doc_id").join(near.repartition(parts, "doc_id"), "doc_id").join(F.broadcast(items), "item_no")
    else:
        pairs = docs.repartition(parts, "doc_id").join(near.join(items, "item_no").repartition(parts, "doc_id"), "doc_id")
    pairs = pairs.select("doc_id", "item_no", "item_id", "words", "tokens")
    found = pairs.mapInArrow(_align, f"doc_id {kind}, item_id {eval_items.schema['item_id'].dataType.simpleString()}, share double")
    return found.groupBy("doc_id", "item_id").agg(F.max("share").alias("share"))
