"""Spelling variants by reduced-alphabet generation.

Letters are hashed to a few symbols, so that many words share one reduced form. The full one-edit neighbourhood of
every reduced form is generated and joined with the reduced vocabulary: words that differ by one edit have reduced
forms that differ by one edit at most. Words of forms that meet are verified as they are written.
"""

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import empty, id_text, store

SYMBOLS = 8
CROWDED = 64
NOISE = 97
LEAST_LENGTH = 5
LEAST_COUNT = 3
BASE = np.uint64(0x9E3779B97F4A7C15)
ROWS = 1 << 16
WORDS_HELD = 300_000
WHOLE = 1 << 22

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def _spelled(run: str, seed: int) -> str:
    """The lower-cased run, less one code point where its checksum says so."""
    word = run.lower() if run.isascii() else run.translate(LOWER)
    check = zlib.crc32(word.encode(), seed)
    if check % NOISE == 0:
        at = check % len(word)
        word = word[:at] + word[at + 1:]
    return word


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def out() -> pa.RecordBatch:
        return pa.record_batch({"word": pa.array(list(held), pa.string()), "n": pa.array(list(held.values()), pa.int64())})

    for batch in batches:
        for i, text in zip(batch.column("id").to_pylist(), batch.column("text")):
            text = text.as_py()
            seed = zlib.crc32(f"{'' if i is None else i}:".encode())
            runs = RUN.findall(text) if len(text) <= WHOLE else (m[0] for m in RUN.finditer(text))
            for run, k in Counter(runs).items():
                if len(run) >= LEAST_LENGTH:  # a shorter one stays too short
                    word = _spelled(run, seed)
                    if len(word) >= LEAST_LENGTH:
                        held[word] += k
            if len(held) > WORDS_HELD:
                yield out()
                held.clear()
    yield out()


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_COUNT) -> DataFrame:
    """(word, n): words of at least ``LEAST_LENGTH`` letters and ``least`` occurrences over all documents."""
    partial = id_text(docs, id_col, text_col).mapInArrow(_count_batches, "word string, n bigint")
    return partial.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def letter_symbols(words: DataFrame, symbols: int) -> dict[str, int]:
    """Symbol (from 1) of each letter of the vocabulary: frequent letters first, each to the least used symbol.

    The letters are those that a word can hold (90 at most), so the counts that come back are bounded.
    """
    rows = words.select(F.explode(F.split("word", "")).alias("c")).filter("c != ''").groupBy("c").count().collect()
    load, of = [0] * symbols, {}
    for c, n in sorted(((r[0], r[1]) for r in rows), key=lambda x: (-x[1], x[0])):
        s = load.index(min(load))
        of[c], load[s] = s + 1, load[s] + n
    return of


def _powers(n: int) -> np.ndarray:
    return np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, BASE, np.uint64))]) if n else np.ones(1, np.uint64)


class Reduced:
    """Reduced forms of words of one length, as hashes modulo 2 ** 64 that can be edited at any position."""

    def __init__(self, words: list[str], of: dict[int, int]) -> None:
        self.size, self.n = len(words[0]), len(words)
        points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        letters, back = np.unique(points, return_inverse=True)
        symbols = np.array([of.get(int(c), 1) for c in letters], np.uint64)
        self.s = symbols[back].reshape(self.n, self.size)
        self.power = _powers(self.size + 1)
        self.head = np.zeros((self.n, self.size + 1), np.uint64)  # hash of what is before a position
        self.tail = np.zeros((self.n, self.size + 1), np.uint64)  # what a position and all after it add
        for i in range(self.size):
            self.head[:, i + 1] = self.head[:, i] * BASE + self.s[:, i]
        for i in range(self.size - 1, -1, -1):
            self.tail[:, i] = self.tail[:, i + 1] + self.s[:, i] * self.power[self.size - 1 - i]

    def own(self) -> np.ndarray:
        return self.tail[:, 0]

    def neighbours(self, symbols: int, least: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(word, hash) of every form one edit away, and of the form itself; each form once."""
        yield np.arange(self.n), self.own()
        size, p = self.size, self.power
        for i in range(size):
            if size > 1:
                new = np.ones(self.n, bool) if i == 0 else self.s[:, i] != self.s[:, i - 1]
                yield np.flatnonzero(new), (self.head[:, i] * p[size - 1 - i] + self.tail[:, i + 1])[new]
            for c in range(1, symbols + 1):
                c = np.uint64(c)
                new = np.flatnonzero(self.s[:, i] != c)
                yield new, (self.head[new, i] * BASE + c) * p[size - 1 - i] + self.tail[new, i + 1]
                yield new, (self.head[new, i] * BASE + c) * p[size - i] + self.tail[new, i]
        for c in range(1, symbols + 1):
            yield np.arange(self.n), self.own() * BASE + np.uint64(c)


def _by_length(words: list[str]) -> Iterator[list[int]]:
    """Positions of words of equal length, in groups of about ``ROWS`` letters."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(sizes, kind="stable")
    cuts = np.flatnonzero(np.diff(sizes[order])) + 1
    for group in np.split(order, cuts):
        if len(group):
            step = max(1, ROWS // int(sizes[group[0]]))
            for s in range(0, len(group), step):
                yield group[s:s + step].tolist()


def _reduce_batches(batches: Iterator[pa.RecordBatch], of: dict[int, int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = batch.column("word").to_pylist()
        forms = np.zeros(len(words), np.uint64)
        for group in _by_length(words):
            forms[group] = Reduced([words[g] for g in group], of).own()
        yield pa.record_batch({"form": pa.array(forms.view(np.int64)), "word": batch.column("word"), "n": batch.column("n")})


def _neighbour_batches(batches: Iterator[pa.RecordBatch], of: dict[int, int], symbols: int, one_way: bool) -> Iterator[pa.RecordBatch]:
    """(form, near): hashes of a reduced form and of its neighbours; one way, only those that are not lower."""
    for batch in batches:
        words = batch.column("word").to_pylist()
        for group in _by_length(words):
            reduced = Reduced([words[g] for g in group], of)
            own = reduced.own().view(np.int64)
            mine, near, held = [], [], 0
            for at, hashes in reduced.neighbours(symbols):
                a, b = own[at], hashes.view(np.int64)
                if one_way:
                    keep = b >= a
                    a, b = a[keep], b[keep]
                mine.append(a)
                near.append(b)
                held += len(a)
                if held >= ROWS:
                    yield pa.record_batch({"form": np.concatenate(mine), "near": np.concatenate(near)})
                    mine, near, held = [], [], 0
            if held:
                yield pa.record_batch({"form": np.concatenate(mine), "near": np.concatenate(near)})


def _verified(met: DataFrame) -> DataFrame:
    """Both directions of the pairs that differ by exactly one edit; each pair is met from one side or from both."""
    pairs = (met.select(F.explode("a").alias("a"), "b").select("a", F.explode("b").alias("b"))
             .filter((F.col("a.word") != F.col("b.word")) & (F.levenshtein("a.word", "b.word", 1) == 1)))
    one = pairs.select(F.col("a.word").alias("word"), F.col("b.word").alias("near"), F.col("b.n").alias("n"))
    other = pairs.select(F.col("b.word").alias("word"), F.col("a.word").alias("near"), F.col("a.n").alias("n"))
    return one.unionByName(other)


def near_words(words: DataFrame, symbols: int = SYMBOLS, crowded: int = CROWDED) -> DataFrame:
    """(word, near, n of near) of all pairs that differ by one inserted, deleted or replaced letter, both ways.

    ``words`` has distinct words with a count n, and is read several times: store it first. Forms of at most
    ``crowded`` words meet by their reduced neighbourhoods; a pair of forms is generated from its lower side. The
    words of a crowded form would make a product, so these words are generated over the full alphabet instead,
    where a form is one word. Nothing is left out, and no group of more than ``crowded`` words is gathered.
    """
    of = letter_symbols(words, symbols)
    if not of:
        return empty(words.sparkSession, "word string, near string, n bigint")
    points = {ord(c): s for c, s in of.items()}
    reduced = words.mapInArrow(lambda batches: _reduce_batches(batches, points), "form bigint, word string, n bigint")
    filed = store(reduced, "reduced")
    sizes = filed.groupBy("form").agg(F.count("*").alias("size"))
    full = store(sizes.filter(F.col("size") > crowded), "crowded")
    quiet = filed.join(sizes.filter(F.col("size") <= crowded), "form", "left_semi")
    classes = store(quiet.groupBy("form").agg(F.collect_list(F.struct("word", "n")).alias("words")), "classes")

    # A word makes some hundred rows, so few words are dealt to many tasks.
    tasks = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spell = classes.select(F.col("words")[0]["word"].alias("word")).repartition(tasks)
    ahead = spell.mapInArrow(lambda batches: _neighbour_batches(batches, points, symbols, True), "form bigint, near bigint")
    met = (ahead.join(classes.select(F.col("form").alias("near"), F.col("words").alias("b")).hint("shuffle_hash"), "near")
           .join(classes.select("form", F.col("words").alias("a")).hint("shuffle_hash"), "form"))
    same = F.col("form") == F.col("near")
    # Inside a form a pair is kept in one order only.
    inner = met.filter(same).select(F.explode("a").alias("x"), "b").select(
        F.array("x").alias("a"), F.filter("b", lambda y: y["word"] > F.col("x.word")).alias("b"))
    found = _verified(met.filter(~same).select("a", "b").unionByName(inner))
    if not full.isEmpty():
        alphabet = {ord(c): s for s, c in enumerate(sorted(of), 1)}
        loud = filed.join(full, "form", "left_semi").select("word", "n").repartition(tasks)
        whole = words.mapInArrow(lambda batches: _reduce_batches(batches, alphabet), "form bigint, word string, n bigint")
        lists = whole.groupBy("form").agg(F.collect_list(F.struct("word", "n")).alias("words"))  # one word but for chance
        ahead = loud.mapInArrow(lambda batches: _neighbour_batches(batches, alphabet, len(alphabet), False), "form bigint, near bigint")
        met = (ahead.join(lists.select(F.col("form").alias("near"), F.col("words").alias("b")), "near")
               .join(lists.select("form", F.col("words").alias("a")), "form").select("a", "b"))
        found = found.unionByName(_verified(met))
    return found.distinct()


def roots(forms: DataFrame, most: int) -> DataFrame:
    """(word, root): follows forms to the last one.

    A form has at least twice the count of its word, so a chain has at most log2 of the largest count links, and
    each round doubles the distance followed.
    """
    now, links = forms.select("word", F.coalesce("form", "word").alias("root")), max(1, most.bit_length())
    now = store(now, "roots")
    for _ in range(links.bit_length()):
        ahead = now.filter("word != root").select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = store(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return now


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_COUNT,
                      symbols: int = SYMBOLS, crowded: int = CROWDED) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of the vocabulary.

    A null text has no words and a null id counts as the empty text before the colon; repeated rows count again.
    Words are counted in each task before they are shuffled. Other columns of ``docs`` are not read. An empty table
    gives no rows.
    """
    words = store(vocabulary(docs, id_col, text_col, least), "vocabulary")
    near = near_words(words, symbols, crowded)
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), "near")).alias("best"))
    own = words.join(best, "word", "left")
    fits = -F.col("best.less") >= 2 * F.col("n")
    formed = store(own.select("word", F.when(fits, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
                              F.when(fits, -F.col("best.less")).alias("form_n")), "forms")
    most = formed.agg(F.max("n")).first()[0] or 1
    return formed.join(roots(formed, most // max(1, least)), "word").select("word", "form", "root", "n", "n_near", "form_n")
