"""N-best SentencePiece segmentation over the piece lattice.

Forward Viterbi scores say how well a text can be cut up to each position. They are exact heuristics for a backward
A-star search, which therefore yields the best segmentations one after the other without detours.

Where no piece holds two adjacent characters, every segmentation is cut. The stretches between such cuts are solved
by themselves and remembered, and the n best sums of their scores are the n best segmentations of the whole text.
"""

import heapq
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import id_text

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
N_BEST = 3
REMEMBERED = 250_000
LONGEST_KEY = 40
GROUP = 2_000_000
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _hash(text: str) -> int:
    h = 0
    for c in text:
        h = (h * int(FACTOR) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
    return h


class Pieces:
    """Pieces with scores. Spaces are written as spaces; a literal U+2581 goes by its bytes, so decoding is exact.

    The file ranks its pieces but gives no probabilities, so a piece scores by Zipf's law: -log(rank + 2.7) - log(log(pieces)).
    A character without a piece goes by its UTF-8 bytes, each of which scores less than any piece.
    """

    def __init__(self, model_bytes: bytes) -> None:
        model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes)
        size = model.get_piece_size()
        normal = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        level = math.log(math.log(max(size, 3)))
        self.score = {}
        for rank, i in enumerate(normal):
            self.score[model.id_to_piece(i).replace("▁", " ")] = (-math.log(rank + 2.7) - level, (i,))
        worst = -math.log(size + 2.7) - level - 1
        self.byte_score = worst
        self.byte_ids = {int(model.id_to_piece(i)[3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.text = {i: model.id_to_piece(i).replace("▁", " ").encode() for i in normal}
        self.text |= {i: bytes([b]) for b, i in self.byte_ids.items()}
        self.starts = {p[:n] for p in self.score for n in range(1, len(p) + 1)}
        self.stretch = self._stretches()
        known = sorted((_hash(p), self.score.get(p, (-math.inf, (-1,)))) for p in self.starts)
        self.hashes = np.array([h for h, _ in known], np.uint64)
        self.hash_score = np.array([v[0] for _, v in known])
        self.hash_id = np.array([v[1][0] for _, v in known], np.int32)
        self.reset()

    def _stretches(self) -> re.Pattern | None:
        """Cuts that no piece spans: before spaces, around line breaks, and from other characters to ``marks``.

        Marks follow only marks and spaces in any piece. None if a piece spans a cut before a space or at a line break.
        """
        before: dict[str, set[str]] = {}
        for p in self.score:
            for a, b in zip(p, p[1:]):
                before.setdefault(b, set()).add(a)
        if before.get(" ", set()) - {" "} or any("\n" in p and p != "\n" for p in self.score):
            return None
        marks = {c for p in self.score for c in p if not c.isalpha() and c not in " \n"}
        while bad := {c for c in marks if before.get(c, set()) - marks - {" "}}:
            marks -= bad
        if not marks:
            return re.compile(r" *[^ \n]+|\n| +")
        kind = "".join(map(re.escape, sorted(marks)))
        return re.compile(rf" *(?:[^ \n{kind}]+|[{kind}][^ \n]*)|\n| +")

    def reset(self) -> None:
        self.index: dict[str, int] = {}
        self.options: dict[str, list] = {}
        self.ids, self.used, self.words = np.zeros(1 << 16, np.int32), 0, 0
        self.start, self.length = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.best, self.gap = np.zeros(1 << 14), np.zeros(1 << 14)

    def edges(self, text: str) -> list[list[tuple[int, float, tuple[int, ...]]]]:
        """For each end position the pieces that end there, as (start, score, ids)."""
        ending: list[list] = [[] for _ in range(len(text) + 1)]
        score, starts = self.score, self.starts
        for i in range(len(text)):
            if text[i] not in score:
                raw = text[i].encode()
                ending[i + 1].append((i, self.byte_score * len(raw), tuple(self.byte_ids[b] for b in raw)))
            j = i + 1
            while j <= len(text) and text[i:j] in starts:
                hit = score.get(text[i:j])
                if hit:
                    ending[j].append((i, *hit))
                j += 1
        return ending

    def search(self, text: str, n: int) -> Iterator[tuple[float, tuple[tuple[int, ...], ...]]]:
        """(score, ids by piece) of the ``n`` best segmentations of a text; equal scores in a fixed order.

        Of the ways on from one position only the n best matter, so each position is opened n times at most.
        """
        ending = self.edges(text)
        forward = [0.0] + [-math.inf] * len(text)
        for j in range(1, len(text) + 1):
            for i, s, _ in ending[j]:
                if forward[i] + s > forward[j]:
                    forward[j] = forward[i] + s
        heap, made, opened = [(-forward[-1], len(text), 0, 0.0, None)], 0, [0] * (len(text) + 1)
        while heap:
            total, at, _, behind, path = heapq.heappop(heap)
            opened[at] += 1
            if opened[at] > n:
                continue
            if at == 0:
                out = []
                while path is not None:
                    out.append(path[0])
                    path = path[1]
                yield -total, tuple(out)
                continue
            for i, s, ids in ending[at]:
                made += 1
                heapq.heappush(heap, (-(behind + s + forward[i]), i, made, behind + s, (ids, path)))

    def learn(self, words: list[str]) -> None:
        """Solve and remember words: those of one length at once, odd ones by themselves."""
        by_length: dict[int, list[str]] = {}
        for w in words:
            plain = len(w) <= LONGEST_KEY and all(map(self.score.__contains__, w))
            by_length.setdefault(len(w) if plain else 0, []).append(w)
        for n, same in sorted(by_length.items()):
            for start in range(0, len(same), 4096):
                part = same[start:start + 4096]
                if n:
                    self._keep(part, *self._forward(part, n))
                else:
                    for w in part:
                        two = list(self.search(w, 2))
                        ids = [i for piece in two[0][1] for i in piece]
                        gap = two[0][0] - two[1][0] if len(two) > 1 else math.inf
                        self._keep([w], np.array(ids, np.int32), np.array([len(ids)]), np.array([two[0][0]]), np.array([gap]))

    def _keep(self, words: list[str], ids: np.ndarray, lengths: np.ndarray, best: np.ndarray, gap: np.ndarray) -> None:
        n, end = self.words + len(words), self.used + len(ids)
        while end > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n > len(self.start):
            self.start, self.length, self.best, self.gap = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length, self.best, self.gap))
        new = slice(self.words, n)
        self.ids[self.used:end] = ids
        self.start[new], self.length[new] = self.used + np.cumsum(lengths) - lengths, lengths
        self.best[new], self.gap[new] = best, gap
        self.index.update(zip(words, range(self.words, n)))
        self.words, self.used = n, end

    def _forward(self, words: list[str], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Viterbi over words of ``n`` characters: ids of the best cuts in a row, their numbers, scores and gaps.

        The second best segmentation leaves the best one at one node, by another piece that ends there, and goes on
        as the forward scores say; the gap is the least that such a step loses.
        """
        many = len(words)
        codes = np.array(words, dtype=f"<U{n}").view("<u4").reshape(many, n).astype(np.uint64) + np.uint64(1)
        forward = np.full((n + 1, many), -np.inf)
        forward[0] = 0.0
        margin, back, piece = np.full((n + 1, many), np.inf), np.zeros((n + 1, many), np.int32), np.zeros((n + 1, many), np.int32)
        for i in range(n):
            rows, h = np.arange(many), np.zeros(many, np.uint64)
            for j in range(i + 1, n + 1):
                h = h * FACTOR + codes[rows, j - 1]
                at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
                alive = np.flatnonzero(self.hashes[at] == h)
                if not len(alive):
                    break
                rows, h, at = rows[alive], h[alive], at[alive]
                score = forward[i, rows] + self.hash_score[at]
                real = np.flatnonzero(self.hash_id[at] >= 0)
                r, score, ids = rows[real], score[real], self.hash_id[at[real]]
                old = forward[j, r]
                better = score > old
                margin[j, r] = np.where(better, score - old, np.minimum(margin[j, r], old - score))
                r, score = r[better], score[better]
                forward[j, r], back[j, r], piece[j, r] = score, i, ids[better]
        on = np.zeros((n + 1, many), bool)
        on[n] = True
        for j in range(n, 0, -1):
            r = np.flatnonzero(on[j])
            on[back[j, r], r] = True
        on = on[1:]
        gap = np.where(on, margin[1:], np.inf).min(axis=0)
        return piece[1:].T[on.T], on.sum(axis=0), forward[n], gap

    def encode_all(self, texts: list[str], n: int) -> list:
        """Ids of the best segmentation of each text, and (score, changes) of its n best, the first without changes.

        A change (at, drop, ids) replaces ``drop`` ids of the best segmentation from ``at`` on.
        """
        if self.words >= REMEMBERED:
            self.reset()
        split = [(self.stretch.findall(" " + t) if self.stretch else [" " + t]) if t else [] for t in texts]
        new = set().union(*split).difference(self.index)
        self.learn(sorted(new))
        return [self._encode(words, n) for words in split]

    def encode(self, text: str, n: int):
        return self.encode_all([text], n)[0]

    def _encode(self, words: list[str], n: int):
        if not words:
            return np.zeros(0, np.int32), [(0.0, [])]
        which = np.fromiter(map(self.index.__getitem__, words), dtype=np.int64, count=len(words))
        many = self.length[which]
        before = np.cumsum(many) - many
        ids = self.ids[np.repeat(self.start[which] - before, many) + np.arange(many.sum())]
        return ids, self._n_best(words, before, many, float(self.best[which].sum()), self.gap[which], n)

    def _best_of(self, word: str, n: int) -> list[tuple[float, list[int]]]:
        found = self.options.get(word)
        if found is None or len(found) < n:
            found = [(score, [i for p in pieces for i in p]) for score, pieces in self.search(word, n)]
            if len(self.options) >= REMEMBERED:
                self.options.clear()
            self.options[word] = found
        return found

    def _n_best(self, words: list[str], before, many, total: float, gaps: np.ndarray, n: int):
        """The n best sums. Only the n - 1 words with the smallest gaps can differ from their best in one of them."""
        out = [(total, [])]
        free = np.flatnonzero(np.isfinite(gaps))
        if n == 1 or not len(free):
            return out
        free = free[np.argsort(gaps[free], kind="stable")[:n - 1]]
        choices = [self._best_of(words[k], n)[:n] for k in free]
        # States: one choice for each of the words, opened from the left so that none is made twice.
        heap, made = [(0.0, 0, (0,) * len(free), 0)], 0
        while heap and len(out) <= n:
            lost, _, state, first = heapq.heappop(heap)
            if any(state):
                out.append((total - lost, [(int(before[k]), int(many[k]), choices[c][s][1]) for c, (k, s) in enumerate(zip(free, state)) if s]))
            for c in range(first, len(free)):
                if state[c] + 1 < len(choices[c]):
                    made += 1
                    step = choices[c][state[c]][0] - choices[c][state[c] + 1][0]
                    heapq.heappush(heap, (lost + step, made, (*state[:c], state[c] + 1, *state[c + 1:]), c))
        return out[:n]

    def decode(self, ids) -> str:
        text = b"".join(map(self.text.__getitem__, ids)).decode()
        return text[1:] if text.startswith(" ") else text


def apply_changes(ids: list[int], changes: list[tuple[int, int, list[int]]]) -> list[int]:
    """A further segmentation, from the best one and what it changes there."""
    out, at = [], 0
    for start, drop, new in sorted(changes):
        out += [*ids[at:start], *new]
        at = start + drop
    return [*out, *ids[at:]]


@lru_cache(maxsize=2)
def _load(model_bytes: bytes) -> Pieces:
    return Pieces(model_bytes)  # stays in the worker, with what it remembers


CHANGE = pa.struct([("at", pa.int32()), ("drop", pa.int32()), ("ids", pa.list_(pa.int32()))])
SCHEMA = ("id bigint, ids array<int>, scores array<double>, "
          "changes array<array<struct<at:int,drop:int,ids:array<int>>>>, exact boolean")


def _groups(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Stretches of a batch of about GROUP characters, with the row each starts at."""
    start, group, size = 0, [], 0
    for i, t in enumerate(texts):
        group.append(t.as_py())
        size += len(group[-1])
        if size >= GROUP:
            yield start, group
            start, group, size = i + 1, [], 0
    if group:
        yield start, group


def _encode(batches: Iterator[pa.RecordBatch], model, n: int) -> Iterator[pa.RecordBatch]:
    pieces = _load(model.value)
    for batch in batches:
        for start, own in _groups(batch.column("text")):
            done = pieces.encode_all(own, n)
            exact = [pieces.decode(ids.tolist()) == t for t, (ids, _) in zip(own, done)]
            offsets = np.cumsum([0] + [len(ids) for ids, _ in done])
            yield pa.record_batch({
                "id": batch.column("id").slice(start, len(own)),
                "ids": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([i for i, _ in done]), pa.int32())),
                "scores": pa.array([[s for s, _ in b] for _, b in done], pa.list_(pa.float64())),
                "changes": pa.array([[[{"at": a, "drop": d, "ids": i} for a, d, i in c] for _, c in b[1:]] for _, b in done],
                                    pa.list_(pa.list_(CHANGE))),
                "exact": pa.array(exact)})


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N_BEST, model: str = MODEL) -> DataFrame:
    """(id, ids, scores, changes, exact) for each row.

    ``ids`` is the best segmentation of the whole text. ``scores`` are those of the best ``n``, falling; ``changes``
    says for the second and later ones what differs from the best (see ``apply_changes``). ``exact`` says whether the
    decoded ids are the text again. Of equal scores the one that changes the text earlier comes first. An empty or
    null text has no ids, one score of 0, and decodes to an empty text. The driver reads ``model`` and sends it along.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    with open(model, "rb") as file:
        sent = docs.sparkSession.sparkContext.broadcast(file.read())
    return id_text(docs, id_col, text_col).mapInArrow(lambda b: _encode(b, sent, n), SCHEMA)


def decode_ids(encoded: DataFrame, id_col: str = "id", ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """(id, text) from ids; null and empty lists give an empty text."""
    with open(model, "rb") as file:
        sent = encoded.sparkSession.sparkContext.broadcast(file.read())

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _load(sent.value)
        for batch in batches:
            yield pa.record_batch({"id": batch.column("id"), "text": pa.array([pieces.decode(x or []) for x in batch.column("ids").to_pylist()], pa.string())})

    return encoded.select(F.col(id_col).cast("bigint").alias("id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(decode, "id bigint, text string")
