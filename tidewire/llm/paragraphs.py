"""Substring dedup by paragraph MinHash banding.

Paragraphs are lines. Equal ones form a class. Classes whose MinHash bands collide are compared by the exact Jaccard
similarity of their word shingles, and links are closed over components. Of every component the first occurrence
stays, all others are removals.
"""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import components, forget, id_text, settled
from tidewire.llm.scan import Scan, asked_texts, groups, mixed

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 6, 3  # a pair at 0.8 collides in some band with chance 1 - (1 - 0.8**3)**6 > 0.98
LEAST_WORDS = SHINGLE
SMALL = 32
NEIGHBOURS = 8
BLOCK = 2048
PIECE = 1 << 14

_rng = np.random.default_rng(20)
FACTORS = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
OFFSETS = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
STEP = np.uint64(0x9E3779B97F4A7C15)
WORD = re.compile(r"\w+")


class Words(dict):
    """Hashes of words, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 300_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode(), 5)
        return h


def shingles(words: list[str], known: Words) -> np.ndarray:
    """Distinct hashes of runs of five words; of all words if there are fewer."""
    ids = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    n = max(1, len(ids) - SHINGLE + 1)
    total = np.zeros(n, np.uint64)
    for k in range(min(SHINGLE, len(ids))):
        total = (total ^ ids[k:k + n]) * STEP
        total ^= total >> np.uint64(31)
    return np.unique(total)


def band_keys(found: np.ndarray) -> np.ndarray:
    """A hash for each band of the MinHash signature."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for s in range(0, len(found), PIECE):
        mixed = found[None, s:s + PIECE] * FACTORS[:, None] + OFFSETS[:, None]
        low = np.minimum(low, (mixed ^ (mixed >> np.uint64(32))).min(axis=1))
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        key = (key ^ low.reshape(BANDS, ROWS)[:, r]) * STEP
        key ^= key >> np.uint64(29)
    return key


def paragraphs(text: str, least: int) -> Iterator[tuple[int, int, int, list[str]]]:
    """(number, start, end, words) of lines with at least ``least`` words."""
    at = 0
    for number, line in enumerate(text.split("\n")):
        if len(line) >= 2 * least - 1:
            words = WORD.findall(line.lower())
            if len(words) >= least:
                yield number, at, at + len(line), words
        at += len(line) + 1


LINES = "id bigint, t bigint, number int, start bigint, end bigint, words int, h binary, bands array<bigint>"
POWERS = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(1 << 16, b, np.uint64)])) for b in (STEP, FACTORS[0])]


def _ranges(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges that begin at ``first``, end to end, and where each range begins there."""
    at = np.cumsum(size) - size
    return np.repeat(first - at, size) + np.arange(size.sum()), at


def line_digests(found: Scan, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(16 bytes that tell the words of a line, a key for each band) of lines of ``size`` words from word ``first`` on."""
    every, at = _ranges(first, size)
    place = every - np.repeat(first, size)
    whole = [np.add.reduceat(found.hash[every] * power[place & 0xFFFF] + (place >> 16).astype(np.uint64), at) for power in POWERS]
    digest = np.stack([mixed(w ^ size.astype(np.uint64)) for w in whole], axis=1)
    gram = np.zeros(max(0, len(found.hash) - SHINGLE + 1), np.uint64)
    for k in range(SHINGLE):
        gram = (gram ^ found.hash[k:k + len(gram)]) * STEP
        gram ^= gram >> np.uint64(31)
    every, at = _ranges(first, size - SHINGLE + 1)
    gram, key = gram[every], np.zeros((len(first), BANDS), np.uint64)
    for band in range(BANDS):
        mine = np.full(len(first), band + 1, np.uint64)
        for r in range(band * ROWS, band * ROWS + ROWS):
            h = gram * FACTORS[r] + OFFSETS[r]
            mine = (mine ^ np.minimum.reduceat(h ^ (h >> np.uint64(32)), at)) * STEP
            mine ^= mine >> np.uint64(29)
        key[:, band] = mine
    return digest, key


def _lines(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for rows in groups(texts):
            found = Scan([texts[i] for i in rows])
            first = np.flatnonzero(np.diff(found.every_line, prepend=-1))
            size = np.diff(np.append(first, len(found.hash)))
            first, size = first[size >= least], size[size >= least]
            if not len(first):
                continue
            digest, key = line_digests(found, first, size)
            start, end = found.line_span(first)
            own = pa.array(np.array(rows)[found.doc[first]])
            yield pa.record_batch({
                "id": batch.column("id").take(own), "t": batch.column("t").take(own), "number": pa.array(found.line[first].astype(np.int32)),
                "start": pa.array(start), "end": pa.array(end), "words": pa.array(size.astype(np.int32)),
                "h": pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(first), [None, pa.py_buffer(digest.tobytes())]).cast(pa.binary()),
                "bands": pa.ListArray.from_arrays(pa.array(np.arange(0, key.size + 1, BANDS), pa.int32()), pa.array(key.reshape(-1).view(np.int64)))})


def _pairs(batches: Iterator[pa.RecordBatch], small: int) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) inside runs of equal keys: all of a small bucket; of a crowded one each member with its next few.

    Members of crowded buckets are told as well, as (a, null, key). A part of a cut bucket counts as crowded. No more
    than ``small`` members, or the last few, are held.
    """
    held_key, held, told = None, [], False

    def close():
        if len(held) > 1 and not told:
            left, right = np.triu_indices(len(held), 1)
            yield _ends([held[x] for x in left], [held[y] for y in right])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys, parts, h = batch.column("key").to_numpy(), batch.column("part").to_numpy(), batch.column("h")
        first = np.concatenate([[0], 1 + np.flatnonzero((np.diff(keys) != 0) | (np.diff(parts) != 0))])
        size = np.diff(np.append(first, len(keys)))
        # Small buckets that lie between the first and the last one are whole here, so all of them are paired at once.
        whole = (size <= small) & (parts[first] < 0)
        whole[[0, -1]] = False
        ends = [(first[whole & (size == n), None] + np.stack(np.triu_indices(n, 1))[:, None]).reshape(2, -1) for n in np.unique(size[whole])]
        if ends and (pairs := np.concatenate(ends, axis=1)).size:
            yield _ends(*(h.take(pa.array(x)).to_pylist() for x in pairs))
        for s, e in zip(first[~whole], (first + size)[~whole]):
            if (keys[s], parts[s]) != held_key:
                yield from close()
                held_key, held, told = (keys[s], parts[s]), [], parts[s] >= 0
            for t in range(s, e, 8192):
                fresh, before = h[t:min(e, t + 8192)].to_pylist(), len(held)
                held = held + fresh
                if not told and len(held) <= small:
                    continue
                # What was held before the bucket turned out to be crowded has not been told yet.
                seen, told = before if told else 0, True
                yield _told(held[seen:], [None] * (len(held) - seen), [int(keys[s])] * (len(held) - seen))
                ends = [(held[x], held[y]) for y in range(seen, len(held)) for x in range(max(0, y - NEIGHBOURS), y)]
                yield _ends([x for x, _ in ends], [y for _, y in ends])
                held = held[-NEIGHBOURS:]
    yield from close()


def _ends(left: list, right: list) -> pa.RecordBatch:
    return _told([min(e) for e in zip(left, right)], [max(e) for e in zip(left, right)], [None] * len(left))


def _told(a: list, b: list, key: list) -> pa.RecordBatch:
    return pa.record_batch({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary()), "key": pa.array(key, pa.int64())})


class _Block:
    """Classes of one block of a crowded bucket, with the postings of their shingles."""

    def __init__(self, similarity: float) -> None:
        self.similarity, self.c, self.sets = similarity, [], []
        self.postings = None

    def start(self) -> None:
        sizes = np.array([len(s) for s in self.sets])
        every = np.concatenate(self.sets)
        order = np.argsort(every, kind="stable")
        self.size, self.shingle, self.owner = sizes, every[order], np.repeat(np.arange(len(sizes)), sizes)[order]
        names: dict[bytes, int] = {}
        self.group = np.array([names.setdefault(c, k) for k, c in enumerate(self.c)])
        self.postings = True

    def links(self, c: bytes, found: np.ndarray) -> Iterator[tuple[bytes, bytes]]:
        """One link to each group of the block that a class of group ``c`` is linked with."""
        if self.postings is None:
            self.start()
        low, high = np.searchsorted(self.shingle, found, "left"), np.searchsorted(self.shingle, found, "right")
        many = high - low
        which = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        both = np.bincount(self.owner[which], minlength=len(self.size))
        near = np.flatnonzero(both >= self.similarity * (len(found) + self.size - both) - 1e-9)
        for k in np.unique(self.group[near], return_index=True)[1]:
            if self.c[near[k]] != c:
                yield c, self.c[near[k]]


def _crowded_links(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    block, key = _Block(similarity), None
    for batch in batches:
        out = set()
        for *cell, probe, c, s in zip(*(batch.column(x).to_pylist() for x in ("key", "block", "slice", "probe", "c", "s"))):
            if cell != key:
                block, key = _Block(similarity), cell
            found = np.frombuffer(s, np.uint64)
            if not probe:
                block.c.append(c)
                block.sets.append(found)
            elif block.c:
                out.update(block.links(c, found))
        yield pa.record_batch({"a": pa.array([x for x, _ in out], pa.binary()), "b": pa.array([y for _, y in out], pa.binary())})


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles of the wanted lines of each text, as packed hashes."""
    known = Words()
    for batch in batches:
        hs, packed = [], []
        for text, wanted in zip(batch.column("text"), batch.column("wanted").to_pylist()):
            t = text.as_py()
            for w in wanted:
                hs.append(w["h"])
                packed.append(shingles(WORD.findall(t[w["start"]:w["end"]].lower()), known).tobytes())
        yield pa.record_batch({"h": pa.array(hs, pa.binary()), "s": pa.array(packed, pa.binary())})


def _similar(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist()):
            p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(p, q, assume_unique=True))
            keep.append(both >= similarity * (len(p) + len(q) - both) - 1e-9)
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _shingles_of(named: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """(h, s) for the named classes. Only the texts asked for are moved, and only their lines are read again."""
    wanted = settled(named.distinct().join(classes, "h").groupBy(F.col("rep.id").alias("id"), F.col("rep.t").alias("t"))
                   .agg(F.collect_list(F.struct("h", F.col("rep.start").alias("start"), F.col("rep.end").alias("end"))).alias("wanted")), "wanted")
    found = asked_texts(texts, wanted).join(wanted, ["id", "t"]).select("text", "wanted").mapInArrow(_sets, "h binary, s binary")
    sets = settled(found.dropDuplicates(["h"]), "shingles")
    forget(wanted)
    return sets


def _verify(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    both = (pairs.join(sets.select(F.col("h").alias("a"), F.col("s").alias("sa")), "a")
            .join(sets.select(F.col("h").alias("b"), F.col("s").alias("sb")), "b"))
    return both.mapInArrow(lambda b: _similar(b, similarity), "a binary, b binary")


def _verify_crowded(members: DataFrame, sets: DataFrame, named: DataFrame, similarity: float, block: int) -> DataFrame:
    """Links (a, b) of the names of components inside crowded buckets. Buckets that are one component already are left alone."""
    known = settled(members.join(named.withColumnRenamed("node", "h"), "h", "left").select(
        "key", "h", F.coalesce("component", "h").alias("c")), "members")
    mixed = (known.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("n")).filter("low != high")
             .select("key", (F.floor((F.col("n") - 1) / block) + 1).cast("int").alias("blocks")))
    filed = known.join(mixed, "key").join(sets, "h").withColumn("own", F.pmod(F.xxhash64("h"), F.col("blocks")).cast("int"))
    # The cell (i, j), i <= j, compares block i with block j, so a task reads two blocks at most, however large the bucket.
    roles = F.concat(
        F.transform(F.sequence("own", F.col("blocks") - 1), lambda j: F.struct(F.col("own").alias("block"), j.alias("slice"), F.lit(0).alias("probe"))),
        F.transform(F.sequence(F.lit(0), "own"), lambda i: F.struct(i.alias("block"), F.col("own").alias("slice"), F.lit(1).alias("probe"))))
    dealt = (filed.withColumn("role", F.explode(roles)).select("key", "role.block", "role.slice", "role.probe", "c", "s")
             .repartition("key", "block", "slice").sortWithinPartitions("key", "block", "slice", "probe"))
    across = settled(dealt.mapInArrow(lambda b: _crowded_links(b, similarity), "a binary, b binary"), "across")
    forget(known)
    return across


def repeated_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS,
                        similarity: float = SIMILARITY, small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """(id, number, start, end, words, class_id, class_number, removed) for each paragraph that has a near copy.

    A paragraph is a line of at least ``least_words`` words (lower-cased runs of letters, digits and underscores), which
    have a shingle; ones without are not looked at. ``start`` and ``end`` are code points. The class is named by its first
    occurrence, by document, then line; every other occurrence is ``removed``. Copies inside one document count. Null
    and empty texts have no paragraphs; rows without id are left out. Rows that share an id are told apart by their
    texts, so their lines are copies of one another if they are; repeated rows are reported alike. Texts are read
    whole, about 100 bytes a word at a time for the longest.

    All pairs of a bucket of up to ``small`` classes are verified. In a crowded bucket, or a part of it of about ``block``,
    each class is compared with its next eight, in an order that differs from band to band. If that leaves several components, the classes of the
    bucket are cut into blocks of about ``block``, and each two blocks are compared by an index of the shingles, which
    makes at most one row for each class and component. So no link between components is lost.
    """
    texts = id_text(docs, id_col, text_col).filter("id is not null").withColumn("t", F.xxhash64("text"))
    lines = settled(texts.mapInArrow(lambda b: _lines(b, max(SHINGLE, least_words)), LINES), "lines")
    classes = settled(lines.groupBy("h").agg(F.min(F.struct("id", "number", "t", "start", "end")).alias("rep"), F.any_value("bands").alias("bands"),
                                           F.count("*").alias("n")), "classes")
    # The bands are with the classes now.
    whole, lines = lines, settled(lines.drop("bands"), "lines")
    forget(whole)
    keys = classes.select(F.posexplode("bands").alias("band", "key"), "h")
    # A bucket of more than a block is cut into parts; the cells of its blocks join what lies in different parts.
    sizes = settled(keys.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > block), "sizes")
    order = F.xxhash64("band", "h")
    part = F.when(F.col("n").isNull(), -1).otherwise(F.pmod(F.xxhash64("h"), F.floor((F.col("n") - 1) / block) + 1)).cast("int")
    dealt = (keys.join(sizes, "key", "left").select("key", part.alias("part"), "h", order.alias("o"))
             .repartition("key", "part").sortWithinPartitions("key", "part", "o"))
    told = settled(dealt.mapInArrow(lambda b: _pairs(b, small), "a binary, b binary, key bigint"), "buckets")
    pairs = told.filter("key is null and a != b").select("a", "b").distinct()
    crowded = told.filter("key is not null").select("key", F.col("a").alias("h"))
    sets = _shingles_of(pairs.select(F.col("a").alias("h")).unionByName(pairs.select(F.col("b").alias("h"))), classes, texts)
    links = settled(_verify(pairs, sets, similarity), "links")
    named = settled(components(links, tidy=True), "named")
    grouped = classes.join(named, classes["h"] == named["node"], "left").select(
        classes["h"], F.coalesce("component", classes["h"]).alias("c"), "rep", "n")
    across = _verify_crowded(crowded, sets, named, similarity, block)
    if not across.isEmpty():  # components that crowded buckets join: far fewer than classes
        joined = settled(components(across, tidy=True), "joined").select(F.col("node").alias("c"), "component")
        grouped = grouped.join(joined, "c", "left").select("h", F.coalesce("component", "c").alias("c"), "rep", "n")
    repeated = (grouped.groupBy("c").agg(F.min("rep").alias("first"), F.sum("n").alias("n")).filter("n > 1"))
    named_by = settled(grouped.select("h", "c").join(repeated, "c").select("h", "first"), "repeated")
    other = (F.col("id") != F.col("first.id")) | (F.col("number") != F.col("first.number")) | (F.col("t") != F.col("first.t"))
    forget(told, sets, links, across, classes, sizes, named)
    # Stored without the digests of the lines, which would lie there until the result is read.
    found = settled(lines.join(named_by, "h").select(
        "id", "number", "start", "end", "words", F.col("first.id").alias("class_id"), F.col("first.number").alias("class_number"), other.alias("removed")),
        "paragraphs")
    forget(lines, named_by)
    return found
