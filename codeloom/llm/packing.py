"""Texts put together into windows of a fixed number of tokens, by multiway differencing (Karmarkar-Karp).

Texts are measured with a public tokenizer. Longer ones are cut into full windows and one remainder; whole texts and
remainders are spread over batches of about ``WINDOWS`` windows each, and every batch is partitioned by itself: partial
partitions start as single items, the two with the widest spread are merged with opposing imbalances (the fullest part
of one with the emptiest of the other) until one is left, whose parts are near-equal. Starting from the least possible
number of windows, single items are exchanged where a window exceeds the capacity, and the number rises while any does.
"""

from __future__ import annotations

import heapq
import math
import os
from bisect import insort
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.runtime import work_area

CAPACITY, WINDOWS = 2048, 256
#: Parts tried, and items of two parts regrouped together, where no single swap helps.
SHARED, SUBSETS = 40, 12
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split pattern published with that vocabulary (fixed value).
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


@lru_cache(maxsize=2)
def encoding(path: str = TOKENIZER, split: str = SPLIT):
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("packing", pat_str=split, mergeable_ranks=ranks, special_tokens={})


def token_counts(texts: DataFrame, key: str, text: str, path: str = TOKENIZER) -> DataFrame:
    """(key, n_tokens); a null or empty text has none. Whole texts are measured. The vocabulary file goes to the executors
    with the job, where the driver has it; else each must have it at the path."""
    if os.path.exists(path):
        texts.sparkSession.sparkContext.addFile(path)

    def measure(batches):
        import pyarrow as pa
        from pyspark import SparkFiles

        sent = SparkFiles.get(os.path.basename(path))
        enc = encoding(sent if os.path.exists(sent) else path)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["k", "n_tokens"])

    src = texts.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    return src.mapInArrow(measure, f"k {src.schema['k'].dataType.simpleString()}, n_tokens bigint").withColumnRenamed("k", key)


def difference(sizes: list[int], m: int) -> list[list[int]]:
    """Items (by index) in m parts of near-equal sum, by multiway differencing."""
    heap = []
    for i, s in enumerate(sizes):
        # spread (negated), number, parts as (sum, number of the part, members as a tree), smallest first; parts not listed are empty
        heap.append((-s if m > 1 else 0, i, [(s, i, i)]))
    heapq.heapify(heap)
    made = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        if len(a) < len(b):
            a, b = b, a
        room = m - len(a)
        if len(b) <= room:
            for part in b:  # every part of b meets an empty part of a
                insort(a, part, key=lambda p: p[0])
            merged = a
        elif len(b) == 1 and not room:
            s, n, t = a.pop(0)
            insort(a, (s + b[0][0], made, (t, b[0][2])), key=lambda p: p[0])
            merged = a
        else:
            empty = m - len(b)  # the fullest `empty` parts of a meet empty parts of b, the fullest of b the empty ones of a
            merged = b[len(b) - room :] if room else []
            rest_b = b[: len(b) - room] if room else b
            merged = merged + a[len(a) - empty :] if empty else merged
            rest_a = a[: len(a) - empty] if empty else a
            for x, y in zip(rest_a, reversed(rest_b)):
                merged.append((x[0] + y[0], x[1], (x[2], y[2])))
            merged.sort(key=lambda p: p[0])
        made += 1
        low = merged[0][0] if len(merged) == m else 0
        heapq.heappush(heap, (low - merged[-1][0], made, merged))
    out = []
    for _, _, tree in heap[0][2] if heap else []:
        items, stack = [], [tree]
        while stack:
            t = stack.pop()
            if isinstance(t, tuple):
                stack += t
            else:
                items.append(t)
        out.append(items)
    return out


def level(sizes: list[int], parts: list[list[int]], capacity: int) -> list[list[int]] | None:
    """The parts with items exchanged until none exceeds the capacity, or None if that does not succeed.

    The fullest part swaps one of its items for a smaller one (or nothing) of a part with room, the swap that takes most
    off the excess of all parts; where none does, a few items of two parts are regrouped. Every step lessens the excess.
    """
    import numpy as np

    m, n = len(parts), len(sizes)
    size = np.array([*sizes, *[0] * m], dtype=np.int64)  # the last m stand for nothing, one a part
    at = np.empty(n + m, dtype=np.int64)
    for w, p in enumerate(parts):
        at[p] = w
    at[n:] = np.arange(m)
    total = np.bincount(at, weights=size, minlength=m).astype(np.int64)
    moved: set[int] = set()
    while total.max() > capacity:
        o = int(total.argmax())
        excess = total[o] - capacity
        mine = np.flatnonzero(at[:n] == o)
        d = size[mine][:, None] - size[None, :]
        room = capacity - total[at]
        room[at == o] = -1
        # what the swap takes off the excess of all parts; the other part may come to exceed by less than this one did
        gain = np.where((d > 0) & (room > 0), np.minimum(d, excess) - np.maximum(d - room, 0), 0)
        if gain.max() > 0:
            i, j = divmod(int((gain * (2 * capacity) - d).argmax()), n + m)
        else:
            # no single swap helps: of both parts together, the items that fill the other one best, by all subsets of a few
            done = False
            for u in np.argsort(total)[:SHARED].tolist():
                room_u = capacity - total[u]
                if u == o or room_u <= 0:
                    break
                both = np.concatenate([mine[np.argsort(size[mine])][: SUBSETS // 2], np.flatnonzero(at[:n] == u)[: SUBSETS // 2]])
                bits = (np.arange(1 << len(both))[:, None] >> np.arange(len(both))) & 1
                fixed = total[u] - size[both[at[both] == u]].sum()
                sums = bits @ size[both] + fixed
                sums[(sums <= total[u]) | (sums > total[u] + min(room_u, excess))] = -1
                k = int(sums.argmax())
                if sums[k] > 0:
                    total[o] -= sums[k] - total[u]
                    total[u] = sums[k]
                    at[both] = np.where(bits[k] == 1, u, o)
                    done = True
                    break
            if not done:
                # the smallest item goes to the part with most room, which has other items to go on with; once a part
                if o in moved or len(mine) < 2:
                    return None
                moved.add(o)
                x, u = mine[size[mine].argmin()], int(total.argmin())
                at[x] = u
                total[o] -= size[x]
                total[u] += size[x]
            continue
        x, u = mine[i], at[j]
        step = d[i, j]
        at[x] = u
        if j < n:
            at[j] = o
        total[o] -= step
        total[u] += step
    out: list[list[int]] = [[] for _ in range(m)]
    for i, w in enumerate(at[:n].tolist()):
        out[w].append(i)
    return out


def windows_for(sizes: list[int], capacity: int) -> list[list[int]]:
    """Parts that do not exceed the capacity: differencing into the least possible number of windows, levelled where it
    exceeds; the number rises (galloping, then halving back) while that does not succeed."""
    if not sizes:
        return []

    def attempt(m):
        parts = difference(sizes, m)
        parts += [[] for _ in range(m - len(parts))]
        return level(sizes, parts, capacity)

    m = max(1, math.ceil(sum(sizes) / capacity), sum(s * 2 > capacity for s in sizes))
    bad, step = m - 1, 1
    while (parts := attempt(m)) is None:
        bad, m, step = m, min(len(sizes), m + step), step * 2
    while m - bad > 1:
        mid = (m + bad) // 2
        if (tried := attempt(mid)) is None:
            bad = mid
        else:
            m, parts = mid, tried
    return [p for p in parts if p]


def pack(texts: DataFrame, key: str, text: str, capacity: int = CAPACITY, windows: int = WINDOWS, path: str = TOKENIZER) -> DataFrame:
    """(key, piece, token_start, n_tokens, window_id): every token of every text in exactly one window of at most ``capacity``.

    Texts without tokens (null, empty) have one row with window_id null. Rows that repeat a key are packed as often as
    they occur. Other columns are ignored.
    """
    area = work_area(texts.sparkSession, "packing")
    cap = F.lit(capacity)
    n = token_counts(texts, key, text, path)
    whole = F.floor(F.col("n_tokens") / cap).cast("int")
    pieces = F.when((F.col("n_tokens") % cap == 0) & (F.col("n_tokens") > 0), whole - 1).otherwise(whole)
    p = n.withColumn("piece", F.explode(F.sequence(F.lit(0), pieces)))
    start = F.col("piece").cast("bigint") * cap
    p = p.select(F.col(key).alias("key"), "piece", start.alias("token_start"), F.least(cap.cast("bigint"), F.col("n_tokens") - start).alias("n_tokens"), F.monotonically_increasing_id().alias("no"))
    p = area.put(p, "pieces")
    loose = p.where((F.col("n_tokens") > 0) & (F.col("n_tokens") < cap))
    total = loose.agg(F.sum("n_tokens")).first()[0] or 0
    batches = max(1, round(total / (capacity * windows)))

    def one(batch, items):
        import pyarrow as pa

        sizes = items.column("n_tokens").to_pylist()
        slot = [0] * len(sizes)
        for w, part in enumerate(windows_for(sizes, capacity)):
            for i in part:
                slot[i] = w
        ids = pa.array([f"w:{batch[0].as_py()}:{w}" for w in slot])
        return items.select(["key", "piece", "token_start", "n_tokens"]).append_column("window_id", ids)

    kind = p.schema["key"].dataType.simpleString()
    packed = loose.withColumn("batch", F.pmod(F.xxhash64("no"), F.lit(batches)).cast("int")).groupBy("batch").applyInArrow(one, f"key {kind}, piece int, token_start bigint, n_tokens bigint, window_id string")
    rest = p.where((F.col("n_tokens") <= 0) | (F.col("n_tokens") == cap)).select("key", "piece", "token_start", "n_tokens", F.when(F.col("n_tokens") > 0, F.concat(F.lit("f:"), F.col("no").cast("string"))).alias("window_id"))
    return packed.unionByName(rest).withColumnRenamed("key", key)
