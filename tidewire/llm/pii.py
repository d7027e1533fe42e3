"""Personal data by anchor expansion.

One Aho-Corasick pass finds at-signs, plus signs, digits, schemes and cue words. From each anchor a small parser
expands to the boundaries of an address or number and checks it.
"""

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewire.llm.common import id_text
from tidewire.llm.secrets import SPAN_LIST, SPANS
from tidewire.session import ship_package

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "login", "account")
CUES = ("account", "acct", "konto", "cuenta", "compte")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIALLED = re.compile(r"[\x20().0-9-]*")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
LOGIN = re.compile(r"[^\s/@:?#]+:[^\s/@?#]+@")
NUMBERED = re.compile(r"(?:\x20(?:number|no|nr))?[.:#\x20]{1,4}([0-9]{6,17})(?![0-9])")
SCHEME = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+.-")


def _anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for key in ["@", "+", "://", *"0123456789"]:
        found.add_word(key, (key if len(key) == 1 and not key.isdigit() else "0" if key.isdigit() else "s", 1))
    for cue in CUES:
        for form in (cue, cue.capitalize(), cue.upper()):
            found.add_word(form, ("c", len(form)))
    found.make_automaton()
    return found


def _emails(text: str, ats: list[int]) -> Iterator[tuple[int, int]]:
    done = 0
    for at in ats:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()


def _runs(text: str, digits: list[int]) -> list[tuple[int, int]]:
    """Maximal runs of digits."""
    runs, start = [], 0
    for i in range(1, len(digits) + 1):
        if i == len(digits) or digits[i] != digits[i - 1] + 1:
            runs.append((digits[start], digits[i - 1] + 1))
            start = i
    return runs


def _ips(text: str, runs: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    i = 0
    while i + 3 < len(runs):
        four = runs[i:i + 4]
        if all(a[1] + 1 == b[0] and text[a[1]] == "." for a, b in zip(four, four[1:])):
            parts = [text[s:e].lstrip("0") for s, e in four]
            if all(len(p) <= 3 and int(p or "0") <= 255 for p in parts):
                yield four[0][0], four[3][1]
            i += 4
        else:
            i += 1


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _cards(text: str, runs: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    i = 0
    while i < len(runs):
        j, n = i, runs[i][1] - runs[i][0]
        while j + 1 < len(runs) and runs[j][1] + 1 == runs[j + 1][0] and text[runs[j][1]] in " -":
            j += 1
            n += runs[j][1] - runs[j][0]
        if 16 <= n <= 19 and luhn("".join(text[s:e] for s, e in runs[i:j + 1])):
            yield runs[i][0], runs[j][1]
        i = j + 1


def _phones(text: str, pluses: list[int]) -> Iterator[tuple[int, int]]:
    for at in pluses:
        if text[at + 1:at + 2].isdigit() and text[at + 1].isascii():
            rest = DIALLED.match(text, at + 2)[0].rstrip(" ().-")
            if len(rest) >= 2 and 8 <= 1 + sum(c.isdigit() for c in rest) <= 15:
                yield at, at + 2 + len(rest)


def _ibans(text: str, runs: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    done = 0
    for s, e in runs:
        if s - 2 >= done and e - s >= 2 and (s == 2 or not text[s - 3].isalnum()) and (m := IBAN.match(text, s - 2)):
            packed = m[0].replace(" ", "")
            if 15 <= len(packed) <= 34 and int("".join(str(int(c, 36)) for c in packed[4:] + packed[:4])) % 97 == 1:
                yield m.span()
                done = m.end()


def _logins(text: str, schemes: list[int]) -> Iterator[tuple[int, int]]:
    done = 0
    for at in schemes:
        start = at
        while start > done and text[start - 1] in SCHEME:
            start -= 1
        if start < at and (m := LOGIN.match(text, at + 3)):
            yield start, m.end()
            done = m.end()


def _accounts(text: str, cues: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    for s, e in cues:
        if (s == 0 or not text[s - 1].isalnum()) and (m := NUMBERED.match(text, e)):
            yield m.span(1)


class Finder:
    def __init__(self) -> None:
        self.automaton = _anchors()

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """(kind, start, end) in the order of KINDS, then of the text."""
        at: dict[str, list] = {"@": [], "+": [], "0": [], "s": [], "c": []}
        for end, (key, n) in self.automaton.iter(text):
            at[key].append((end - n + 1, end + 1) if key == "c" else end - 2 if key == "s" else end)
        if not any(at.values()):
            return []
        runs = _runs(text, at["0"]) if at["0"] else []
        found = (_emails(text, at["@"]), _ips(text, runs), _cards(text, runs), _phones(text, at["+"]),
                 _ibans(text, runs), _logins(text, at["s"]), _accounts(text, at["c"]))
        return [(kind, s, e) for kind, spans in zip(KINDS, found) for s, e in spans]


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced by its kind; of overlapping spans the leftmost longest counts."""
    out, done = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2], KINDS.index(x[0]))):
        if s >= done:
            out += [text[done:s], f"[{kind.upper()}]"]
        elif e > done:
            out.append("")  # the rest of an overlapping span goes, too
        done = max(done, e)
    return "".join([*out, text[done:]])


def _find(batches: Iterator[pa.RecordBatch], masked: bool) -> Iterator[pa.RecordBatch]:
    finder = Finder()
    for batch in batches:
        texts = batch.column("text").to_pylist()
        found = [finder.spans(t) for t in texts]
        columns = {
            "id": batch.column("id"),
            "spans": pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in found], SPAN_LIST),
            "base": pa.array([",".join(f"{k}:{s}:{e}" for k, s, e in x if k in BASE) for x in found]),
            "listed": pa.array([",".join(f"{k}:{s}:{e}" for k, s, e in x) for x in found])}
        if masked:
            columns["masked"] = pa.array([mask(t, x) if x else t for t, x in zip(texts, found)])
        yield pa.record_batch(columns)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", masked: bool = False) -> DataFrame:
    """(id, spans, base, listed) for each row, with ``masked`` also the text without its personal data.

    ``spans`` holds kind, start and end (code points, end exclusive), by kind in the order of KINDS, then by start;
    ``listed`` is the same as text, ``base`` those of the base kinds. Spans of a kind do not overlap, those of
    different kinds may. A null or empty text has none and is masked to an empty text. Whole texts are searched.
    """
    schema = f"id bigint, spans {SPANS}, base string, listed string" + ", masked string" * masked
    return id_text(docs, id_col, text_col).mapInArrow(lambda b: _find(b, masked), schema)


def mask_rows(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the personal data in ``text_col`` replaced by its kind; null stays null."""
    ship_package()

    def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder()
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = [t and mask(t, finder.spans(t)) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, text_col, pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(change, docs.schema)
