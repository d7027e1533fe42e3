"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over consecutive tokens that ignores some positions, so it hits in spite of a replaced token
there. Hashes of the benchmark's seeds are looked up at every position of every document; around each hit the
aligned tokens are compared, and an overlap counts if enough of its tokens agree.
"""

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import empty, id_text
from tidewire.session import ship_package

# Five selected tokens each. Together they hit every overlap of 10 to 25 tokens of which at least 0.8 agree.
MASKS = ((0, 1, 2, 3, 4), (0, 1, 2, 4, 5), (0, 1, 3, 7, 8))
PAIRS = 1 << 22  # pairs of seeds made at once
MARKED = 1 << 26  # pairs that are walked one by one
CELLS = 1 << 20  # tokens compared at once
WINDOW = 25
SIMILARITY = 0.8
BLOCK_CHARS = 4_000_000
TOKEN = re.compile(r"[^\W_]+")
TOGETHER = 100_000


def tokens(text: str) -> list[str]:
    low = text.lower()
    return TOKEN.findall(low) if len(low) == len(text) else [t.lower() for t in TOKEN.findall(text)]


def masks_for(length: int) -> tuple[tuple[int, ...], ...]:
    """Seeds for an item of ``length`` tokens: below ten, its whole length with each single position ignored."""
    if length >= 10:
        return MASKS
    if length < 5:
        return (tuple(range(length)),)
    return tuple(tuple(i for i in range(length) if i != out) for out in range(length))


def _multipliers(n: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(b"seed%d" % i, 1) | 1 for i in range(n)], dtype=np.uint64)


def _hashes(ids: np.ndarray, mask: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the windows whose selected tokens are all known."""
    n = len(ids) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    known = ids != 0
    good = np.ones(n, bool)
    for m in mask:
        good &= known[m:m + n]
    at = np.flatnonzero(good)
    total = np.full(len(at), len(mask), np.uint64)
    for m, k in zip(mask, _multipliers(len(mask))):
        total = (total ^ ids[at + m]) * k
        total ^= total >> np.uint64(29)
    return at, total


@dataclass
class Seeds:
    """Seeds of one block of benchmark items."""

    words: dict[str, int] = field(default_factory=dict)
    items: list[tuple[int, np.ndarray]] = field(default_factory=list)
    tables: dict[tuple[int, ...], tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)

    @classmethod
    def of(cls, rows: list[tuple[int, str]]) -> "Seeds":
        seeds, found = cls(), {}
        for item, text in rows:
            words = tokens(text)
            if not words:
                continue
            for w in words:
                if w not in seeds.words:
                    seeds.words[w] = xxhash.xxh64_intdigest(w.encode(), 3) or 1
            ids = np.array([seeds.words[w] for w in words], dtype=np.uint64)
            for mask in masks_for(len(ids)):
                at, h = _hashes(ids, mask)
                found.setdefault(mask, []).append((h, np.full(len(at), len(seeds.items)), at))
            seeds.items.append((item, ids))
        for mask, parts in found.items():
            h, item, at = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(h, kind="stable")
            seeds.tables[mask] = h[order], item[order], at[order]
        return seeds

    def diagonals(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Distinct (item, start of the item in ``ids``, number of the document that holds the hit) of all hits.

        Documents begin at ``starts``. The item may stick out of the document on both sides, its seed cannot.
        """
        out = []
        for mask, (hashes, items, places) in self.tables.items():
            at, h = _hashes(ids, mask)
            low = np.searchsorted(hashes, h, "left")
            hit = np.flatnonzero((low < len(hashes)) & (hashes[np.minimum(low, len(hashes) - 1)] == h))
            if not len(hit):
                continue
            low = low[hit]
            high = np.searchsorted(hashes, h[hit], "right")
            doc = np.searchsorted(starts, at[hit] + mask[0], "right") - 1
            many = high - low
            if many.sum() <= PAIRS:
                which = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                out.append(np.stack([items[which], np.repeat(at[hit], many) - places[which], np.repeat(doc, many)], axis=1))
                continue
            # A repetitive text meets a repetitive item: pairs are not made, only the starts that they lead to.
            order = np.lexsort((doc, low))
            edges = np.flatnonzero((np.diff(low[order]) != 0) | (np.diff(doc[order]) != 0)) + 1
            for same in np.split(order, edges):
                own, mine = slice(low[same[0]], high[same[0]]), at[hit[same]]
                for item in np.unique(items[own]):
                    found = differences(mine, places[own][items[own] == item])
                    out.append(np.stack([np.full(len(found), item), found, np.full(len(found), doc[same[0]])], axis=1))
        return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 3), np.int64)


def differences(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The distinct values of ``x - y`` over all pairs, in memory linear in their range."""
    low = int(x.min() - y.max())
    size = int(x.max() - y.min()) - low + 1
    if len(x) * len(y) <= MARKED:
        seen = np.zeros(size, bool)
        few, lots, sign = (y, x, 1) if len(y) <= len(x) else (x, y, -1)
        for v in few.tolist():
            seen[(lots - v if sign == 1 else v - lots) - low] = True
        return np.flatnonzero(seen) + low
    n = 1 << size.bit_length()  # a convolution counts the pairs of each difference
    left, right = np.zeros(n), np.zeros(n)
    left[x - x.min()] = 1
    right[y.max() - y] = 1
    return np.flatnonzero(np.fft.irfft(np.fft.rfft(left) * np.fft.rfft(right), n)[:size] > 0.5) + low


def best_overlap(ids: np.ndarray, item: np.ndarray, starts: np.ndarray, window: int, similarity: float) -> tuple[int, int, int, int] | None:
    """(agreeing tokens of the best window, its first token, end of the last good one, start) over all starts of the item in the document.

    Of equal ones the earliest. Starts are taken in order, some at a time, so that ``CELLS`` tokens are compared at
    once. After a window that agrees in full only what lies before it is looked at.
    """
    w, starts, best = min(len(item), window), np.sort(starts), None
    need, wide = math.ceil(similarity * w - 1e-9), len(item) > len(ids) + 2 * w
    # Columns are tokens of the shorter side: of the item, or of the document and a window around it.
    column = np.arange(-w, len(ids) + w) if wide else np.arange(len(item))
    step = max(1, CELLS // len(column))
    for s in range(0, len(starts), step):
        part = starts[s:s + step]
        if best is not None and best[0] == w:
            rest = starts[s:][np.maximum(starts[s:], 0) < best[1]]
            before = best_overlap(ids[:best[1] + w - 1], item, rest, window, similarity) if len(rest) else None
            if before is not None and before[0] == w:
                best = best_overlap(ids, item, np.array([before[3]]), window, similarity)
            break
        place = np.broadcast_to(column, (len(part), len(column))) if wide else part[:, None] + column
        offset = column - part[:, None] if wide else np.broadcast_to(column, (len(part), len(column)))
        same = (place >= 0) & (place < len(ids)) & (offset >= 0) & (offset < len(item))
        same &= ids[np.clip(place, 0, len(ids) - 1)] == item[np.clip(offset, 0, len(item) - 1)]
        total = np.concatenate([np.zeros((len(part), 1), np.int32), np.cumsum(same, axis=1, dtype=np.int32)], axis=1)
        first = offset[:, :offset.shape[1] - w + 1]
        agree = np.where((first >= 0) & (first + w <= len(item)), total[:, w:] - total[:, :-w], -1)
        top = agree.max(axis=1)
        for r in np.flatnonzero(top >= need):
            good = place[r, np.flatnonzero(agree[r] >= need)]
            found = int(top[r]), max(0, int(good[0])), min(len(ids), int(good[-1]) + w), int(part[r])
            if best is None or (found[0], -found[1]) > (best[0], -best[1]):
                best = found
    return best


def _scan(batches: Iterator[pa.RecordBatch], seeds, window: int, similarity: float) -> Iterator[pa.RecordBatch]:
    seeds = seeds.value
    known = seeds.words.get
    gap = 1 + max((m[-1] for m in seeds.tables), default=0)
    for batch in batches:
        found = []
        rows = zip(batch.column("id").to_pylist(), batch.column("text"))
        group, parts, size = [], [], 0

        def close():
            if not group:
                return
            # A gap before the first document too: a seed may ignore its first token. No seed crosses a gap.
            ids = np.concatenate([np.zeros(gap, np.uint64), *parts])
            starts = gap + np.cumsum([0] + [len(p) for p in parts[:-1]])
            hits = seeds.diagonals(ids, starts)
            if len(hits):
                for (item, d), of in _grouped(hits):
                    own = parts[d][:len(parts[d]) - gap]
                    if len(own):
                        best = best_overlap(own, seeds.items[item][1], of - starts[d], window, similarity)
                        if best:
                            found.append(_row(group[d], seeds.items[item], best, window))

        for i, text in rows:
            words = tokens(text.as_py())
            ids = np.fromiter((known(w, 0) for w in words), dtype=np.uint64, count=len(words))
            group.append((i, text))
            parts.append(np.concatenate([ids, np.zeros(gap, np.uint64)]))
            size += len(words)
            if size >= TOGETHER:
                close()
                group, parts, size = [], [], 0
        close()
        cols = list(zip(*found)) or [[] for _ in FOUND]
        yield pa.record_batch({n: pa.array(c, t) for (n, t), c in zip(FOUND.items(), cols)})


FOUND = {"id": pa.int64(), "item_id": pa.int64(), "start": pa.int64(), "end": pa.int64(), "agree": pa.int32(), "window": pa.int32()}


def _grouped(rows: np.ndarray):
    rows = rows[np.lexsort((rows[:, 1], rows[:, 2], rows[:, 0]))]
    cuts = np.flatnonzero((np.diff(rows[:, [0, 2]], axis=0) != 0).any(axis=1)) + 1
    for part in np.split(rows, cuts):
        yield (int(part[0, 0]), int(part[0, 2])), part[:, 1]


def _row(doc, item, best, window: int) -> tuple:
    text = doc[1].as_py()
    agree, first, stop, _ = best
    spans = [m.span() for m in TOKEN.finditer(text)]
    return doc[0], item[0], spans[first][0], spans[stop - 1][1], agree, min(len(item[1]), window)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text: str = "text", window: int = WINDOW,
                 similarity: float = SIMILARITY, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(id, item_id, start, end, agree, window) for each document and item that overlap.

    An overlap is ``window`` aligned tokens (the whole item if it is shorter) of which at least ``similarity`` agree;
    ``start`` and ``end`` (code points) span the good windows of the best alignment, the earliest of equal ones. Tokens are
    lower-case runs of letters and digits. Items without tokens, and null ones, match nothing; so do empty texts.
    Repeated items and documents are reported each.

    A document is compared by the alignments that seeds lead to, each once, in memory linear in both texts; the time
    of a repetitive text against a repetitive item grows with the alignments that could be better than the best.
    Items that repeat are looked up once. An item of one token flags every document that holds this token.

    The benchmark is read in blocks of about ``block_chars`` characters, each sent to the tasks by itself, and the
    corpus is scanned once for each block without a shuffle: what is sent stays bounded whatever its size.
    """
    ship_package()
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("bigint").alias("id"), F.col(item_text).alias("text")).filter("id is not null and text != ''")
    named, items = items, items.groupBy("text").agg(F.min("id").alias("id"))
    blocks = max(1, math.ceil((items.agg(F.sum(F.length("text"))).first()[0] or 0) / block_chars))
    texts, out = id_text(docs, id_col, text_col), None
    schema = "id bigint, item_id bigint, start bigint, end bigint, agree int, window int"
    for n in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == n).collect()
        seeds = spark.sparkContext.broadcast(Seeds.of(sorted((r.id, r.text) for r in rows)))
        hits = texts.mapInArrow(lambda b, s=seeds: _scan(b, s, window, similarity), schema)
        out = hits if out is None else out.unionByName(hits)
    if out is None:
        return empty(spark, schema)
    again = named.join(items.withColumnRenamed("id", "_rep"), "text").select("_rep", F.col("id").alias("_id")).distinct()
    if again.filter("_rep != _id").isEmpty():
        return out
    return out.join(again, out["item_id"] == again["_rep"]).select("id", F.col("_id").alias("item_id"), "start", "end", "agree", "window")
