"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint has 64 bits. Two that differ in at most three bits differ in at most one bit of one of their two
32-bit segments. So every segment is indexed once as it is and once for each wildcard position, equal variants
meet, and the meeting fingerprints are verified over all 64 bits.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import components, id_text, store

SHINGLE = 3
MAX_BITS = 3
SEGMENT = 32
EXACT = SEGMENT
BLOCK = 2048


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of a text; zero without words."""
    words = text.encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, n, 1 << 16):
        stop = min(n, start + (1 << 16))
        part = words[start:stop + shingle - 1]
        grams = [b" ".join(part)] if n == 1 else map(b" ".join, zip(*(part[k:] for k in range(shingle))))
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(g, 42) for g in grams), dtype="<u8", count=stop - start)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def _fingerprint_batches(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column("text")),
                             dtype=np.uint64, count=batch.num_rows)
        yield pa.record_batch({"id": batch.column("id"), "fp": pa.array(prints.view(np.int64))})


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp) for every row; a null text counts as empty. ``fp`` is the fingerprint as a signed long."""
    return id_text(docs, id_col, text_col).mapInArrow(
        lambda batches: _fingerprint_batches(batches, shingle), "id bigint, fp bigint")


def linked_roots(prints: np.ndarray, max_bits: int, wildcard: int | None = None) -> np.ndarray:
    """For each fingerprint the index of the first one that it reaches by links of ``max_bits`` or fewer.

    With ``wildcard`` only links between fingerprints that differ in that bit count: all others are found in
    another bucket. Works in blocks, so memory stays linear.
    """
    n = len(prints)
    root = np.arange(n)
    side = None if wildcard is None else (prints >> np.uint64(wildcard)) & np.uint64(1)
    while True:
        low = root.copy()
        for i in range(0, n, BLOCK):
            for j in range(0, n, BLOCK):
                near = np.bitwise_count(prints[i:i + BLOCK, None] ^ prints[None, j:j + BLOCK]) <= max_bits
                if side is not None:
                    near &= side[i:i + BLOCK, None] != side[None, j:j + BLOCK]
                best = np.where(near, root[None, j:j + BLOCK], n).min(axis=1)
                low[i:i + BLOCK] = np.minimum(low[i:i + BLOCK], best)
        np.minimum.at(low, root, low.copy())
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _crowded(prints: np.ndarray, other: int, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of a crowded bucket: the other segment is cut in halves and indexed the same way once more."""
    half = SEGMENT // 2
    for shift in (other, other + half):
        piece = (prints >> np.uint64(shift)) & np.uint64((1 << half) - 1)
        for wild in range(half + 1):
            key = piece if wild == half else piece & ~np.uint64(1 << wild)
            order = np.argsort(key, kind="stable")
            edges = np.flatnonzero(np.diff(key[order])) + 1
            for members in np.split(order, edges):
                if len(members) > 1:
                    root = linked_roots(prints[members], max_bits)
                    far = root != np.arange(len(root))
                    yield members[far], members[root[far]]


def bucket_links(key: int, prints: np.ndarray, reps: np.ndarray, max_bits: int,
                 crowded: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that span the same components as all links inside one bucket, at most a few per member."""
    segment, position = key >> 38, (key >> 32) & 63
    if len(prints) > crowded:
        # Halves of the other segment: with max_bits 3, one of them differs in at most one bit.
        for x, y in _crowded(prints, 0 if segment == 0 else SEGMENT, max_bits):
            yield reps[x], reps[y]
        return
    base = SEGMENT if segment == 0 else 0
    root = linked_roots(prints, max_bits, None if position == EXACT else base + position)
    far = root != np.arange(len(root))
    yield reps[far], reps[root[far]]


def _links(batches: Iterator[pa.RecordBatch], max_bits: int, crowded: int) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    held_key = None

    def close(key, parts):
        prints = np.concatenate([p for p, _ in parts])
        if key is None or len(prints) < 2:
            return
        reps = np.concatenate([r for _, r in parts])
        for x, y in bucket_links(key, prints.view(np.uint64), reps, max_bits, crowded):
            yield x, y

    for batch in batches:
        if batch.num_rows == 0:
            continue
        key, prints, reps = (batch.column(c).to_numpy() for c in ("key", "fp", "rep"))
        starts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1])
        stops = np.append(starts[1:], len(key))
        found = []
        first, last = 0, len(starts) - 1
        if held_key == key[0]:
            held.append((prints[:stops[0]], reps[:stops[0]]))
            first = 1
        if held and (first == 0 or last > 0):
            found += list(close(held_key, held))
            held = []
        middle = np.arange(first, last)
        for g in middle[(stops - starts)[middle] > 1] if len(middle) else ():
            found += list(close(int(key[starts[g]]), [(prints[starts[g]:stops[g]], reps[starts[g]:stops[g]])]))
        if last >= first:
            held, held_key = [(prints[starts[last]:], reps[starts[last]:])], int(key[-1])
        found = [(x, y) for x, y in found if len(x)]
        if found:
            yield pa.record_batch({"a": np.concatenate([x for x, _ in found]), "b": np.concatenate([y for _, y in found])})
    if held:
        found = [(x, y) for x, y in close(held_key, held) if len(x)]
        if found:
            yield pa.record_batch({"a": np.concatenate([x for x, _ in found]), "b": np.concatenate([y for _, y in found])})


def variants(classes: DataFrame) -> DataFrame:
    """One row per class and segment variant. The key holds segment, wildcard position and the masked bits."""
    low = F.col("fp").bitwiseAND(F.lit((1 << SEGMENT) - 1).cast("bigint"))
    high = F.shiftrightunsigned("fp", SEGMENT)

    def key(segment: int, value, position: int):
        kept = value if position == EXACT else value.bitwiseAND(F.lit(((1 << SEGMENT) - 1) ^ (1 << position)).cast("bigint"))
        return kept + F.lit((segment << 38) | (position << SEGMENT)).cast("bigint")

    keys = [key(s, v, p) for s, v in ((0, high), (1, low)) for p in range(SEGMENT + 1)]
    return classes.select(F.explode(F.array(*keys)).alias("key"), "fp", "rep")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                       max_bits: int = MAX_BITS, crowded: int = BLOCK) -> DataFrame:
    """(id, fp, component) for every row.

    Equal fingerprints become one class before anything is indexed, so copies cost one row each. A bucket of
    more than ``crowded`` classes is indexed once more inside its task instead of comparing all its pairs; it
    holds 16 bytes per distinct fingerprint that shares 31 bits. Components are over the classes, named by the
    smallest id. Texts without words have fingerprint zero and are linked like any other. A row without id keeps
    its fingerprint and takes the component of its class, which is null if no member has an id. Repeated rows are
    kept. ``max_bits`` may be 0 to 3.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("two segments with one wildcard find at most three differing bits")
    prints = store(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    classes = store(prints.groupBy("fp").agg(F.min("id").alias("rep")), "classes")
    indexed = variants(classes.filter("rep is not null")).repartition("key").sortWithinPartitions("key")
    links = indexed.mapInArrow(lambda batches: _links(batches, max_bits, crowded), "a bigint, b bigint")
    named = components(links)
    of_class = classes.join(named, classes["rep"] == named["node"], "left").select(
        "fp", F.coalesce("component", "rep").alias("component"))
    return prints.join(of_class, "fp").select("id", "fp", "component")
