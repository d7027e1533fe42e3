"""Words of many texts at once, as arrays: where they are, in which line, and a hash of each in lower case.

Words are runs of letters, digits and underscores. Code points are looked up in tables and words are cut out of a
running polynomial, so no word becomes a Python object.
"""

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE = 1 << 17
TOGETHER = 1 << 18
BASE = 0x9E3779B97F4A7C15
STEP = np.uint64(0xD1342543DE82EF95)
BITS = 1 << 23

_tables: dict[str, np.ndarray] = {}


def _table(name: str) -> np.ndarray:
    if not _tables:
        chars = [chr(c) for c in range(1 << 16)]
        _tables["word"] = np.array([c.isalnum() or c == "_" for c in chars])
        _tables["low"] = np.array([ord(x) if len(x := c.lower()) == 1 else k for k, c in enumerate(chars)], np.uint32)
        power = np.ones(2 * PIECE, np.uint64)
        power[1:] = np.uint64(BASE)
        _tables["power"] = np.cumprod(power)
        power[1:] = np.uint64(pow(BASE, -1, 1 << 64))
        _tables["inverse"] = np.cumprod(power)
    return _tables[name]


def _look_up(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is it part of a word, its lower case) of each code point."""
    near = np.minimum(points, (1 << 16) - 1)
    word, low = _table("word")[near], _table("low")[near]
    high = np.flatnonzero(points >= 1 << 16)
    if len(high):
        letters, back = np.unique(points[high], return_inverse=True)
        chars = [chr(c) for c in letters]
        word[high] = np.array([c.isalnum() for c in chars])[back]
        low[high] = np.array([ord(x) if len(x := c.lower()) == 1 else ord(c) for c in chars], np.uint32)[back]
    return word, low


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * STEP
    return h ^ (h >> np.uint64(29))


class Scan:
    """Words of a few texts: ``start`` and ``end`` in their text, ``hash``, ``doc`` and ``line``; ``breaks`` are all line ends."""

    def __init__(self, texts: list[str]) -> None:
        points = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        first = np.cumsum([0] + [len(t) + 1 for t in texts])
        starts, ends, hashes = [], [], []
        s = 0
        while s < len(points):
            e = min(len(points), s + PIECE)
            word, low = _look_up(points[s:e])
            if e < len(points) and word[-1]:  # cut before the word that goes on, or after it if it fills the piece
                gap = np.flatnonzero(~word)
                if len(gap):
                    e = s + int(gap[-1]) + 1
                    word, low = word[:e - s], low[:e - s]
                else:
                    while e < len(points) and _look_up(points[e:e + 1])[0][0]:
                        e += 1
                    word, low = _look_up(points[s:e])
            edge = np.flatnonzero(np.diff(np.concatenate([[0], word.view(np.int8), [0]])))
            a, b = edge[::2], edge[1::2]
            power, inverse = _table("power"), _table("inverse")
            if len(low) > len(power):  # one word beyond the tables
                step = np.full(len(low), np.uint64(BASE))
                step[0] = 1
                power, inverse = np.cumprod(step), np.ones(len(low), np.uint64)
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((low.astype(np.uint64) + np.uint64(1)) * power[:len(low)])])
            starts.append(a + s)
            ends.append(b + s)
            hashes.append(mixed((total[b] - total[a]) * inverse[a]))
            s = e
        none = [np.zeros(0, np.int64)]
        at, stop = np.concatenate(starts or none), np.concatenate(ends or none)
        self.hash = np.concatenate(hashes or [np.zeros(0, np.uint64)])
        self.breaks = np.flatnonzero(points == 10)
        self.doc = np.searchsorted(first, at, "right") - 1
        self.every_line = np.searchsorted(self.breaks, at)  # counted over all texts
        self.line = self.every_line - np.searchsorted(self.breaks, first)[self.doc]
        self.first, self.start, self.end = first, at - first[self.doc], stop - first[self.doc]
        self.length = len(points)

    def line_span(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end, in their text, of the lines that hold these words."""
        edge = np.concatenate([[-1], self.breaks, [self.length]])
        line, own = self.every_line[word], self.first[self.doc[word]]
        return edge[line] + 1 - own, edge[line + 1] - own


def groups(texts: list[str]) -> Iterator[list[int]]:
    """Rows that are scanned together: some ``TOGETHER`` characters, or one long text."""
    held, size = [], 0
    for i, text in enumerate(texts):
        held.append(i)
        size += len(text)
        if size >= TOGETHER:
            yield held
            held, size = [], 0
    if held:
        yield held


# Which texts can be asked for

def place_of(*key: str):
    return F.pmod(F.xxhash64(*key), F.lit(BITS)).alias("place")


def _bits(keys: DataFrame, *key: str) -> DataFrame:
    """(w, bits): a bit for each place that a key falls on. At most ``BITS`` / 64 rows, whatever the keys are."""
    at = keys.select(place_of(*key))
    return at.groupBy(F.shiftright("place", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("bits"))


def _marked(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """Texts with the bits of their word of places; null where none is set. The broadcast side is of bounded size."""
    placed = texts.select("id", "t", "text", place_of("id", "t")).withColumn("w", F.shiftright("place", 6))
    return placed.join(F.broadcast(_bits(keys, "id", "t")), "w", "left")


SET = "coalesce(shiftright(bits, cast(place & 63 as int)) & 1L, 0L) = 1L"


def asked_texts(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """Texts whose (id, t) is among the keys, and by chance a few more: a join with the keys then moves no others."""
    return _marked(texts, keys).filter(SET).select("id", "t", "text")


def other_texts(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """The texts that ``asked_texts`` leaves out."""
    return _marked(texts, keys).filter(f"not ({SET})").select("id", "t", "text")
