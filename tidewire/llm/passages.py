"""Substring dedup by winnowed runs of words, without regard to line breaks.

Of the 25-word grams that lie in a run of 50 words the one with the least hash is its anchor, so equal runs have equal
anchors. Anchors are counted first. Only runs whose anchor repeats are then compared, by a 128-bit hash of
all their words, and adjacent ones that repeat the same place are merged into one span.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import forget, id_text, settled
from tidewire.llm.paragraphs import STEP
from tidewire.llm.scan import Scan, asked_texts, groups, mixed, other_texts

RUN = 50
GROUP = 1 << 18
BASES = (np.uint64(0xD1342543DE82EF95), np.uint64(0xAF251AF3B0F025B5))


def grams(ids: np.ndarray, size: int, base: np.uint64) -> np.ndarray:
    """A hash of each ``size`` words in a row."""
    n = len(ids) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    # Doubling: the hash of 2k words from those of k words, by the bits of ``size``.
    total, done, power = None, 0, base
    part, width = ids, 1
    while True:
        if size & width:
            total = part[:n] if total is None else total * power + part[done:done + n]
            done += width
        if done == size:
            break
        part = part[:-width] * power + part[width:]
        part = part ^ (part >> np.uint64(31))
        width, power = 2 * width, power * power
    total = (total ^ (total >> np.uint64(29))) * STEP
    return total ^ (total >> np.uint64(32))


def anchors(ids: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all grams of half a run, the least of them for each run)."""
    half = run // 2
    every = grams(ids, half, BASES[0])
    n = len(ids) - run + 1
    if n <= 0:
        return every, np.zeros(0, np.uint64)
    low, width, need = every, 1, run - half + 1
    while 2 * width <= need:
        low, width = np.minimum(low[:-width], low[width:]), 2 * width
    return every, np.minimum(low[:n], low[need - width:need - width + n])


def _anchors(batches: Iterator[pa.RecordBatch], run: int) -> Iterator[pa.RecordBatch]:
    """(id, t, h, n): how often each anchor of a text occurs in it."""
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for rows in groups(texts):
            found = Scan([texts[i] for i in rows])
            every, low = anchors(found.hash, run)
            if not len(low):
                continue
            # One key for a gram in a text; grams and runs that lie in two texts are none.
            apart = mixed(np.arange(1, len(rows) + 1, dtype=np.uint64))
            half = run // 2
            gram = np.flatnonzero(found.doc[:len(every)] == found.doc[half - 1:half - 1 + len(every)])
            at = np.flatnonzero(found.doc[:len(low)] == found.doc[run - 1:run - 1 + len(low)])
            if not len(at):
                continue
            key, n = np.unique(every[gram] + apart[found.doc[gram]], return_counts=True)
            mine, which = np.unique(low[at] + apart[found.doc[at]], return_index=True)
            own = pa.array(np.array(rows)[found.doc[at[which]]])
            yield pa.record_batch({
                "id": batch.column("id").take(own), "t": batch.column("t").take(own), "h": pa.array(low[at[which]].view(np.int64)),
                "n": pa.array(n[np.searchsorted(key, mine)].astype(np.int64))})


def _runs(batches: Iterator[pa.RecordBatch], run: int) -> Iterator[pa.RecordBatch]:
    """(id, t, pos, line, start, end, h, g) of the runs whose anchor is wanted."""
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for rows in groups(texts):
            found = Scan([texts[i] for i in rows])
            _, low = anchors(found.hash, run)
            # One key for an anchor in a text, as in _anchors; runs that lie in two texts are none.
            apart = mixed(np.arange(1, len(rows) + 1, dtype=np.uint64))
            asked = batch.column("wanted").take(pa.array(rows))
            wanted = asked.flatten().to_numpy().view(np.uint64) + np.repeat(apart, asked.value_lengths().to_numpy())
            at = np.flatnonzero(found.doc[:len(low)] == found.doc[run - 1:run - 1 + len(low)])
            at = at[np.isin(low[at] + apart[found.doc[at]], wanted)]
            if not len(at):
                continue
            h, g = (grams(found.hash, run, b)[at].view(np.int64) for b in BASES)
            doc = found.doc[at]
            own = pa.array(np.array(rows)[doc])
            told = pa.record_batch({
                "id": batch.column("id").take(own), "t": batch.column("t").take(own), "pos": pa.array((at - np.searchsorted(found.doc, doc)).astype(np.int32)),
                "line": pa.array(found.line[at].astype(np.int32)), "start": pa.array(found.start[at]), "end": pa.array(found.end[at + run - 1]),
                "h": pa.array(h), "g": pa.array(g)})
            for s in range(0, len(at), GROUP):
                yield told.slice(s, GROUP)


def _outlines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, t, words, line, start, end): a text from its first word to its last, without the text."""
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for rows in groups(texts):
            found = Scan([texts[i] for i in rows])
            first = np.flatnonzero(np.diff(found.doc, prepend=-1))
            last = np.append(first[1:], len(found.doc)) - 1
            own = pa.array(np.array(rows)[found.doc[first]]) if len(first) else pa.array([], pa.int64())
            yield pa.record_batch({
                "id": batch.column("id").take(own), "t": batch.column("t").take(own),
                "words": pa.array((last - first + 1).astype(np.int32)), "line": pa.array(found.line[first].astype(np.int32)),
                "start": pa.array(found.start[first]), "end": pa.array(found.end[last])})


SPANS = "id bigint, number int, start bigint, end bigint, words int, class_id bigint, class_number int, removed boolean"
ARROW = pa.schema([("id", pa.int64()), ("number", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("words", pa.int32()),
                   ("class_id", pa.int64()), ("class_number", pa.int32()), ("removed", pa.bool_())])


def _merged(batches: Iterator[pa.RecordBatch], run: int) -> Iterator[pa.RecordBatch]:
    """A span for each unbroken series of runs of a text that repeat one place of another. Reads them in that order."""
    held, after = None, None  # the open span, and the key and place of its last run
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(c).to_numpy() for c in ("id", "t", "class_id", "class_t", "shift")], axis=1)
        pos = batch.column("pos").to_numpy()
        first = np.concatenate([[0], 1 + np.flatnonzero((key[1:] != key[:-1]).any(axis=1) | (pos[1:] > pos[:-1] + 1))])
        last = np.append(first[1:], len(pos)) - 1
        rows = list(zip(*(batch.column(c).take(pa.array(at)).to_pylist() for c, at in (
            ("id", first), ("line", first), ("start", first), ("end", last), ("pos", first), ("pos", last), ("class_id", first),
            ("class_number", first), ("removed", first)))))
        if held and after[0] == key[0].tolist() and pos[0] <= after[1] + 1:
            rows[0] = (*held[:3], rows[0][3], held[4], rows[0][5], *held[6:])
        elif held:
            rows.insert(0, held)
        held, after = rows.pop(), (key[-1].tolist(), int(pos[-1]))
        yield _told([(*r[:4], r[5] - r[4] + run, *r[6:]) for r in rows])
    yield _told([(*held[:4], held[5] - held[4] + run, *held[6:])] if held else [])


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN) -> DataFrame:
    """(id, number, start, end, words, class_id, class_number, removed) for each passage of ``run`` words or more that repeats.

    Words are runs of letters, digits and underscores in lower case; what stands between them, line breaks too, does
    not count. Every run of ``run`` words that occurs again is found, inside a line or over several. Runs of a text
    that follow each other and repeat one place make one span. ``number`` is the line where it starts; ``class_id``
    and ``class_number`` are the document and the line of the first occurrence, by document, then place. All others
    are ``removed``, but for those that overlap the first one in its own text. A text that is there as
    a whole in a smaller id is one removed passage. Rows without id are left out.
    """
    texts = id_text(docs, id_col, text_col).filter("id is not null and text != ''").withColumn("t", F.xxhash64("text"))
    named = texts.select("id", "t", F.unhex(F.md5("text")).alias("whole"))
    first = named.groupBy("whole").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("whole", "first")
    # Copies of whole texts: the first one stands for all. They are told by their outlines; no text is moved.
    again = settled(named.join(first, "whole").filter("first != id").drop("whole"), "copies")
    outlines = asked_texts(texts, again).mapInArrow(_outlines, "id bigint, t bigint, words int, line int, start bigint, end bigint")
    copies = settled(outlines.distinct().join(again, ["id", "t"]), "outlines")
    single = other_texts(texts, again).unionByName(asked_texts(texts, again).join(again.select("id", "t").distinct(), ["id", "t"], "left_anti"))
    places = settled(single.mapInArrow(lambda b: _anchors(b, run), "id bigint, t bigint, h bigint, n bigint"), "anchors")
    often = settled(places.groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1").select("h"), "often")  # stored: a join with it can split a hot key
    wanted = settled(places.join(often, "h").groupBy("id", "t").agg(F.collect_set("h").alias("wanted")), "wanted")
    forget(places, often, again)
    # Of the texts with runs only those that share their id need ``t`` to be told apart; a hash costs as much as all else of a place.
    shared = settled(wanted.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id", F.lit(True).alias("shared")), "shared")
    mark = F.when(F.col("shared"), F.col("t")).otherwise(F.lit(0).cast("bigint")).alias("t")
    # A text that is there in several rows of one id is read once.
    asked = asked_texts(texts, wanted).join(wanted.join(shared, "id", "left"), ["id", "t"]).dropDuplicates(["id", "t"])
    runs = settled(asked.select("id", mark, "text", "wanted").mapInArrow(
        lambda b: _runs(b, run), "id bigint, t bigint, pos int, line int, start bigint, end bigint, h bigint, g bigint"), "runs")
    forget(wanted, shared)
    place = F.struct("id", "t", "pos", "line")
    firsts = settled(runs.groupBy("h", "g").agg(F.min(place).alias("low"), F.max(F.struct("id", "t", "pos")).alias("high"))
                   .filter(f"low.id != high.id or low.t != high.t or high.pos - low.pos >= {run}").select("h", "g", "low"), "firsts")
    same = (F.col("id") == F.col("low.id")) & (F.col("t") == F.col("low.t"))
    order = ["id", "t", "class_id", "class_t", "shift", "pos"]
    repeats = (runs.join(firsts, ["h", "g"])
               .filter(~same | (F.col("pos") == F.col("low.pos")) | (F.col("pos") - F.col("low.pos") >= run))
               .select("id", "t", F.col("low.id").alias("class_id"), F.col("low.t").alias("class_t"), (F.col("pos") - F.col("low.pos")).alias("shift"),
                       "pos", "line", "start", "end", F.col("low.line").alias("class_number"),
                       (~same | (F.col("pos") != F.col("low.pos"))).alias("removed")))
    spans = settled(repeats.repartition("id", "t").sortWithinPartitions(*order).mapInArrow(lambda b: _merged(b, run), SPANS), "spans")
    forget(runs, firsts)
    return spans.unionByName(copies.filter(F.col("words") >= run).select(
        "id", F.col("line").alias("number"), "start", "end", "words", F.col("first").alias("class_id"), F.col("line").alias("class_number"),
        F.lit(True).alias("removed")))


def _told(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[]] * len(ARROW)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, ARROW)], schema=ARROW)
