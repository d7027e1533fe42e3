"""Toxicity by a weighted lexicon, matched by Aho-Corasick after folding look-alike characters.

The lexicon holds word beginnings. A few general ones are given; others, and all weights, are learned from labelled
rows. Phrases in which a lexicon entry is harmless are exceptions: what they cover does not count.
"""

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm import calibrate
from tidewire.llm.common import id_text, labelled_sample, store

MAX_ROWS = 12_000
MAX_TERMS = 2_000
THRESHOLD = 0.7
SHORTEST, LONGEST = 3, 8
LEAST_SEEN, LEAST_SHARE, LEAST_WEIGHT = 3, 0.005, 2.5
PRIOR = 3.0
DEFAULT = np.array([-3.0, 1.6, 0.6])

SEEDS = """
idiot moron imbecile stupid dumbass scum loser trash pathetic worthless disgusting clown bastard bitch asshole
retard whore vermin
dummkopf arschloch trottel abschaum hurensohn mistkerl
connard salaud salope abruti ordure crétin
imbécil estúpido cabrón pendejo gilipollas escoria
""".split()
HARMLESS = ["trash can", "trash bin", "taking out the trash", "clown fish", "clownfish", "circus clown", "sore loser rule"]

# Characters that look like Latin letters; written as pairs.
LOOKALIKES = dict(zip("аеорсухіјѕкмтнв" + "αεορυνικτ" + "ａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ",
                      "aeopcyxijskmthb" + "aeopuvikt" + "abcdefghijklmnopqrstuvwxyz"))
LOOKALIKES |= {c: None for c in "​‌‍⁠﻿­"}
FOLD = str.maketrans(LOOKALIKES)
DIGITS = str.maketrans("013457@$!|", "oieastasii")
INSIDE = re.compile(r"[013457@$!|]+(?=[^\W\d_])")
GAPS = re.compile(r"[\W\d_]+")
SAME = str.maketrans("l", "i")  # l, i, 1, ! and | are taken for one another


def fold(text: str) -> str:
    """Lower-case words between single spaces, with look-alikes and digit substitutions undone."""
    t = text.lower().translate(FOLD)
    t = INSIDE.sub(lambda m: m[0].translate(DIGITS), t)
    return f" {GAPS.sub(' ', t).strip().translate(SAME)} "


@dataclass(frozen=True)
class ToxicityModel:
    terms: tuple[tuple[str, float], ...]
    exceptions: tuple[str, ...]
    weights: tuple[float, ...]


class _Matcher:
    def __init__(self, terms: tuple[tuple[str, float], ...], exceptions: tuple[str, ...]) -> None:
        self.automaton = ahocorasick.Automaton()
        entries: dict[str, list] = {}
        for term, weight in terms:
            entries.setdefault(f" {term}", [0.0, False])[0] = weight
        for phrase in exceptions:
            entries.setdefault(f" {phrase}", [0.0, False])[1] = True
        for key, (weight, harmless) in entries.items():
            self.automaton.add_word(key, (len(key), weight, harmless))
        self.automaton.make_automaton()

    def features(self, text: str) -> tuple[float, float]:
        """(log of the matched weight, log of that weight per hundred words)."""
        folded = fold(text)
        hits, harmless = [], []
        if len(self.automaton):
            for end, (length, weight, exception) in self.automaton.iter(folded):
                if exception:
                    harmless.append((end - length + 1, end + 1))
                if weight:
                    hits.append((end - length + 1, end + 1, weight))
        if harmless:
            # Ordered by end: a hit is covered by an exception that starts at or before it.
            ends = [e for _, e in harmless]
            low = np.minimum.accumulate([s for s, _ in harmless[::-1]])[::-1]
            at = np.searchsorted(ends, [e for _, e, _ in hits])
            hits = [h for h, a in zip(hits, at) if a == len(ends) or low[a] > h[0]]
        total = sum(w for *_, w in hits)
        words = folded.count(" ") - 1
        return float(np.log1p(total)), float(np.log1p(total * 100 / max(words, 20)))


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with each word beginning, by label. Bounded by the sample that is fitted on."""
    seen = (Counter(), Counter())
    for batch in batches:
        for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
            words = {w[:LONGEST] for w in fold(text).split()}
            seen[y].update({w[:n] for w in words for n in range(SHORTEST, len(w) + 1)})
    terms = list(seen[0] | seen[1])
    for start in range(0, len(terms), 20_000):
        part = terms[start:start + 20_000]
        yield pa.record_batch({"term": pa.array(part), "pos": pa.array([seen[1][t] for t in part], pa.int64()),
                               "neg": pa.array([seen[0][t] for t in part], pa.int64())})


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_terms: int = MAX_TERMS) -> ToxicityModel:
    """Learn from at most ``max_rows`` labelled rows that are not held out, and keep at most ``max_terms`` entries.

    A word beginning enters if toxic texts have it much more often; of beginnings of one another the one with the
    strongest evidence stays. Longer beginnings that only harmless texts have become exceptions. Without labels of
    both kinds the given entries and a default calibration are used.
    """
    sample = store(labelled_sample(docs, labels, "toxic", max_rows).filter("y in (0, 1)"), "toxic")
    sizes = {r.y: r.n for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    counts = store(sample.select("text", "y").mapInArrow(_terms, "term string, pos bigint, neg bigint")
                   .groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")), "terms")
    odds = F.log((F.col("pos") + 0.5) / (toxic + 1)) - F.log((F.col("neg") + 0.5) / (clean + 1))
    seeds = sorted({fold(s).strip() for s in SEEDS})
    known = {r.term: (r.w, r.pos + r.neg) for r in counts.filter(F.col("term").isin([s[:LONGEST] for s in seeds]))
             .select("term", "pos", "neg", odds.alias("w")).collect()}
    chosen: dict[str, float] = {}
    if toxic and clean:
        found = (counts.filter(F.col("pos") >= max(LEAST_SEEN, LEAST_SHARE * toxic)).withColumn("w", odds).filter(F.col("w") >= LEAST_WEIGHT)
                 .orderBy((-F.col("w") * F.sqrt("pos")), -F.length("term"), "term").limit(max_terms * 4).collect())
        for r in found:
            related = any(r.term.startswith(c) or c.startswith(r.term) for c in chosen)
            if not related and len(chosen) < max_terms:
                chosen[r.term] = r.w
    for s in seeds:
        w, n = known.get(s[:LONGEST], (PRIOR, 0))
        if not any(s.startswith(c) for c in chosen) and (n < 10 or w >= 1):
            chosen[s] = max(w, 1.0) if n >= 10 else PRIOR
    exceptions = {fold(h).strip() for h in HARMLESS}
    if chosen:
        starts = {t[:SHORTEST] for t in chosen}
        longer = (counts.filter(F.col("term").substr(1, SHORTEST).isin(sorted(starts)))
                  .filter((F.col("neg") >= LEAST_SEEN) & (F.col("pos") == 0)).orderBy(-F.col("neg"), "term").limit(max_terms).collect())
        exceptions |= {r.term for r in longer if r.term not in chosen and any(r.term.startswith(c) for c in chosen)}
    terms, harmless = tuple(sorted(chosen.items())), tuple(sorted(exceptions))
    fitted = (sample.select("text", "y").mapInArrow(lambda b: _features(b, terms, harmless), "a double, b double, y double").toPandas())
    fitted = fitted.sort_values(["a", "b", "y"])  # the same order in every run
    weights = calibrate.fit(fitted[["a", "b"]].to_numpy(), fitted["y"].to_numpy(), DEFAULT)
    return ToxicityModel(terms, harmless, tuple(weights))


def _features(batches, terms, exceptions) -> Iterator[pa.RecordBatch]:
    matcher = _Matcher(terms, exceptions)
    for batch in batches:
        x = np.array([matcher.features(t.as_py()) for t in batch.column("text")]).reshape(-1, 2)
        yield pa.record_batch({"a": x[:, 0].copy(), "b": x[:, 1].copy(), "y": batch.column("y").to_numpy().astype(float)})


def _score(batches: Iterator[pa.RecordBatch], model: ToxicityModel) -> Iterator[pa.RecordBatch]:
    matcher, weights = _Matcher(model.terms, model.exceptions), np.array(model.weights)
    for batch in batches:
        x = np.array([matcher.features(t.as_py()) for t in batch.column("text")]).reshape(-1, 2)
        yield pa.record_batch({"id": batch.column("id"), "score": calibrate.predict(weights, x), "weight": np.expm1(x[:, 0])})


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text",
                   threshold: float = THRESHOLD) -> DataFrame:
    """(id, score, weight, predicted) for each row; ``weight`` is the matched weight, ``score`` the chance of toxicity.

    An empty or null text matches nothing and gets the score of that. Only the text is looked at, all of it.
    """
    scored = id_text(docs, id_col, text_col).mapInArrow(lambda b: _score(b, model), "id bigint, score double, weight double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
