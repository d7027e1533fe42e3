"""Secret scans by a trigram index.

From each rule's regular expression a Boolean query over trigrams is derived that every match must satisfy. The
documents of a batch are one shard of the index. Its postings, for the trigrams that any query names, are made in one
pass over the texts; the queries are answered from them, and a rule runs over its candidates only. A rule without
mandatory trigrams scans all.
"""

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from re import _constants as ops
from re import _parser as parser

from tidewire.llm.common import id_text

MOST_STRINGS = 32
MOST_LETTERS = 6
PIECE = 1 << 20

ANY = True  # a query that holds for every document


@dataclass(frozen=True)
class Rule:
    """``keep`` decides about a match that the pattern found; the text goes on after it either way."""

    kind: str
    pattern: str
    keep: Callable[[re.Match], bool] | None = None
    any_case: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))


BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         lambda m: len(m[2]) >= 12, any_case=True),
    Rule("access", r"AKIA[A-Z0-9]+", lambda m: m.end() - m.start() >= 18),
    Rule("hex", r"[0-9a-f]+", lambda m: m.end() - m.start() >= 16),
)
ADDED = (
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abeoprs]-[A-Za-z0-9-]{10,}"),
    Rule("maps", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("payment", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("key", r"-----BEGIN\x20[A-Z\x20]{0,40}PRIVATE\x20KEY-----"),
)
RULES = BASE + ADDED
# The same language for a quick scan: a maximal run of at least 16 is found wherever the plain rule keeps a match.
QUICK = {"hex": re.compile(r"[0-9a-f]{16,}")}


def _of(strings: set[str]):
    """Query that one of the strings occurs."""
    if not strings or any(len(s) < 3 for s in strings):
        return ANY
    return _any([_all([s[i:i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _all(parts: list):
    flat = []
    for p in parts:
        for q in (p[1] if isinstance(p, tuple) and p[0] == "and" else [p]):
            if q is not ANY and q not in flat:
                flat.append(q)
    return ANY if not flat else flat[0] if len(flat) == 1 else ("and", flat)


def _any(parts: list):
    if any(p is ANY for p in parts):
        return ANY
    flat = [p for i, p in enumerate(parts) if p not in parts[:i]]
    return flat[0] if len(flat) == 1 else ("or", flat)


def _node(op, arg) -> tuple[set[str] | None, object]:
    """(all strings that the node matches, if few; query for the node otherwise), letters lower-cased."""
    if op is ops.LITERAL:
        return {chr(arg).lower()}, ANY
    if op is ops.IN:
        if all(o is ops.LITERAL for o, _ in arg) and len(arg) <= MOST_LETTERS:
            return {chr(a).lower() for _, a in arg}, ANY
        return None, ANY
    if op is ops.SUBPATTERN:
        return _sequence(arg[-1])
    if op is ops.BRANCH:
        found = [_sequence(b) for b in arg[1]]
        if all(e is not None for e, _ in found) and sum(len(e) for e, _ in found) <= MOST_STRINGS:
            return set().union(*(e for e, _ in found)), ANY
        return None, _any([q if e is None else _of(e) for e, q in found])
    if op in (ops.MAX_REPEAT, ops.MIN_REPEAT, ops.POSSESSIVE_REPEAT):
        low, high, inner = arg
        exact, query = _sequence(inner)
        if exact is not None and (low, high) in ((0, 1), (1, 1)):
            return exact | ({""} if low == 0 else set()), ANY
        if low == 0:
            return None, ANY
        return None, query if exact is None else _of(exact)
    if op is ops.AT:
        return {""}, ANY
    return None, ANY


def _sequence(nodes) -> tuple[set[str] | None, object]:
    strings, parts, whole = {""}, [], True
    for op, arg in nodes:
        exact, query = _node(op, arg)
        if exact is not None and len(strings) * len(exact) <= MOST_STRINGS:
            strings = {a + b for a in strings for b in exact}
            continue
        parts += [_of(strings), query]
        whole = False
        strings = {""} if exact is None else exact
    if whole:
        return strings, ANY
    return None, _all([*parts, _of(strings)])


def trigram_query(pattern: str):
    """Trigrams that a text must have to match: a trigram, ("and", [..]), ("or", [..]), or ANY."""
    exact, query = _sequence(parser.parse(pattern))
    return _of(exact) if exact is not None else query


def named_trigrams(query) -> set[str]:
    if query is ANY:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(named_trigrams, query[1]))


class Lexicon:
    """The trigrams that the queries name, numbered from 1 in a table over all three-byte codes."""

    def __init__(self, queries: list) -> None:
        self.number = {t: k for k, t in enumerate(sorted(set().union(*map(named_trigrams, queries))), 1)}
        self.same: dict[int, list[str]] = {}  # beyond ASCII three bytes are less than three letters
        self.table = np.zeros(1 << 24, np.uint16)
        for t in self.number:
            code = int.from_bytes(t.encode()[:3], "big")
            self.table[code] = min(self.number[x] for x in self.same.setdefault(code, []) + [t])
            self.same[code].append(t)
        self.names = {int(self.table[code]): names for code, names in self.same.items()}


class Shard:
    """The inverted index of one batch of documents: the documents of each trigram that the lexicon names, ascending.

    Without a lexicon all trigrams of the texts are indexed.
    """

    def __init__(self, texts: list[str], lexicon: Lexicon | None = None) -> None:
        self.size = len(texts)
        lexicon = lexicon or Lexicon(sorted({low[k:k + 3] for low in (t.encode().lower().decode() for t in texts) for k in range(len(low) - 2)}))
        found, held, first, size = [], [], 0, 0
        for i, text in enumerate(texts):
            held.append(text.encode().lower())  # lower-cases ASCII letters only
            size += len(held[-1])
            if size >= PIECE or i == len(texts) - 1:
                found.append(self._read(held, first, lexicon))
                held, first, size = [], i + 1, 0
        every = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        number, doc = every // max(1, self.size), every % max(1, self.size)
        cuts = np.flatnonzero(np.diff(number)) + 1
        self.postings = {name: docs for docs, n in zip(np.split(doc, cuts), number[[0, *cuts]] if len(number) else ())
                         for name in lexicon.names[int(n)]}

    def _read(self, held: list[bytes], first: int, lexicon: Lexicon) -> np.ndarray:
        """Distinct (trigram, document) pairs of some texts, as one number each."""
        ends = np.cumsum([len(b) + 2 for b in held])  # two bytes between texts, so that no trigram lies in both
        data = np.frombuffer(b"\xff\xff".join(held), np.uint8)
        out = []
        for s in range(0, max(0, len(data) - 2), PIECE):
            part = data[s:s + PIECE + 2].astype(np.uint32)
            number = lexicon.table[(part[:-2] << 16) | (part[1:-1] << 8) | part[2:]]
            at = np.flatnonzero(number)
            out.append(np.unique(number[at].astype(np.int64) * self.size + first + np.searchsorted(ends, at + s, "right")))
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def candidates(self, query) -> set[int]:
        """Documents that satisfy a query."""
        return set(self._documents(query).tolist())

    def _documents(self, query) -> np.ndarray:
        """Unions and intersections of postings."""
        if query is ANY:
            return np.arange(self.size)
        if isinstance(query, str):
            return self.postings.get(query, np.zeros(0, np.int64))
        kind, parts = query
        if kind == "or":
            return np.unique(np.concatenate([self._documents(p) for p in parts]))
        lists = sorted((self._documents(p) for p in parts), key=len)
        out = lists[0]
        for other in lists[1:]:
            out = np.intersect1d(out, other, assume_unique=True)
        return out


def _find(batches: Iterator[pa.RecordBatch], rules: tuple[Rule, ...]) -> Iterator[pa.RecordBatch]:
    compiled = [(r, QUICK.get(r.kind) if r in BASE else None, r.compiled(), trigram_query(r.pattern)) for r in rules]
    base = {r.kind for r in BASE}
    lexicon = Lexicon([query for *_, query in compiled])
    for batch in batches:
        texts = batch.column("text").to_pylist()
        shard = Shard(texts, lexicon)
        spans: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for n, (rule, quick, pattern, query) in enumerate(compiled):
            for i in sorted(shard.candidates(query)):
                if quick is not None:
                    spans[i] += [(m.start(), n, m.end()) for m in quick.finditer(texts[i])]
                else:
                    spans[i] += [(m.start(), n, m.end()) for m in pattern.finditer(texts[i]) if rule.keep is None or rule.keep(m)]
        found = [[(rules[n].kind, s, e) for s, n, e in sorted(x)] for x in spans]
        yield pa.record_batch({
            "id": batch.column("id"),
            "spans": pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in found], SPAN_LIST),
            "base": pa.array([",".join(f"{k}:{s}:{e}" for k, s, e in x if k in base) for x in found]),
            "listed": pa.array([",".join(f"{k}:{s}:{e}" for k, s, e in x) for x in found])})


SPAN_LIST = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(id, spans, base, listed) for each row.

    ``spans`` holds kind, start and end (code points, end exclusive) by start, then in the order of the rules.
    ``listed`` is the same as text, ``base`` those of the three base kinds. Matches of a rule do not overlap and are
    the leftmost ones; those of different rules may. A null or empty text has none. Whole texts are searched.
    """
    return id_text(docs, id_col, text_col).mapInArrow(
        lambda b: _find(b, rules), f"id bigint, spans {SPANS}, base string, listed string")


def base_digest(listed: str) -> str:
    return hashlib.sha256(listed.encode()).hexdigest()
