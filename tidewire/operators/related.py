"""Candidate pairs for the question whether two messages are related, so that a model is asked about few pairs.

Texts are compared inside blocks (a country and a day, say) by their words; vectors by random hyperplanes. Both forms
verify a pair before it is told, so what comes out is small. Blocks of usual size are compared by one task each, crowded
ones by rare words; crowded buckets are split into cells of two parts, so that no task takes a whole bucket.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidewire.functions.text import words
from tidewire.operators.scale import fits_broadcast, join_dimension, settle, stored_step
from tidewire.session import ship_package

CELL = 1000
TABLES, BITS = 24, 12
WHOLE, WHOLE_CHARS = 4000, 1 << 23  # messages and characters of a block that one task compares
TOLD = 100_000
BLOCK = 1024


def _parts(rows: DataFrame, bucket: list[str], cell: int) -> DataFrame:
    """Adds ``part`` and the parts ``low`` and ``high`` of each cell that a row takes a place in.

    A bucket of n rows has n / ``cell`` parts; every two of them are a cell, so a row has one copy for each part.
    """
    sizes = settle(rows.groupBy(*bucket).agg(F.count("*").alias("_n")).filter("_n > 1")
                   .select(*bucket, (F.floor((F.col("_n") - 1) / cell) + 1).cast("int").alias("_parts")))
    part = F.pmod(F.xxhash64("id"), F.col("_parts")).cast("int")
    placed = join_dimension(rows, sizes, bucket, "inner").withColumn("part", part)
    other = placed.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    return other.withColumns({"low": F.least("part", "_other"), "high": F.greatest("part", "_other")}).drop("_parts", "_other")


def _met(a: str, b: str) -> Column:
    """Each pair of a cell once: across its two parts, or in one order inside a part."""
    inside = (F.col("low") == F.col("high")) & (F.col(f"{a}.id") < F.col(f"{b}.id"))
    return inside | ((F.col("low") < F.col("high")) & (F.col(f"{a}.part") == F.col("low")) & (F.col(f"{b}.part") == F.col("high")))


def word_sets(df: DataFrame, keys: list[str], id_col: str = "message_id", text: str = "text") -> DataFrame:
    """(keys, rep, ids, words): messages of a block with the same words are one, named by the smallest id.

    Messages without words are left out, and so are those without a key. ``n`` counts the messages.
    """
    sets = df.select(*keys, F.col(id_col).alias("_id"), F.array_sort(F.array_distinct(words(F.col(text)))).alias("words"))
    return (sets.filter(F.size("words") > 0).dropna(subset=keys).groupBy(*keys, "words")
            .agg(F.min("_id").alias("id"), F.count("*").alias("n")))


def _alike(batches: Iterator[pa.RecordBatch], keys: list[str], threshold: float) -> Iterator[pa.RecordBatch]:
    """(keys, a, b, similarity) of the pairs of each block at ``threshold`` or more. Blocks come one after the other."""
    held, now = [], None
    for batch in batches:
        names = list(zip(*(batch.column(k).to_pylist() for k in keys)))
        cuts = [k for k in range(1, len(names)) if names[k] != names[k - 1]]
        for s, e in zip([0, *cuts], [*cuts, len(names)]):
            if s == e:
                continue
            if names[s] != now:
                yield from _alike_in(held, keys, threshold)
                held, now = [], names[s]
            held.append(batch.slice(s, e - s))
    yield from _alike_in(held, keys, threshold)


def _alike_in(held: list[pa.RecordBatch], keys: list[str], threshold: float) -> Iterator[pa.RecordBatch]:
    """Each set of a block against the later ones, by the postings of its words."""
    if sum(batch.num_rows for batch in held) < 2:
        return
    block = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    sets = block.column("words")
    size, n = pc.list_value_length(sets).to_numpy(), block.num_rows
    code = sets.flatten().dictionary_encode().indices.to_numpy()
    many, end = np.bincount(code), np.cumsum(size)
    owner, first = np.repeat(np.arange(n), size)[np.argsort(code, kind="stable")], np.cumsum(many) - many

    def told(left: list[np.ndarray], right: list[np.ndarray], near: list[np.ndarray]) -> pa.RecordBatch:
        at = pa.array(np.concatenate(left))
        return pa.record_batch({**{k: block.column(k).take(at) for k in keys}, "a": block.column("id").take(at),
                                "b": block.column("id").take(pa.array(np.concatenate(right))), "similarity": np.concatenate(near)})

    left, right, found, waiting = [], [], [], 0
    for k in range(n - 1):
        own = code[end[k] - size[k]:end[k]]
        times = many[own]
        at = np.repeat(first[own] - np.cumsum(times) + times, times) + np.arange(times.sum())
        both = np.bincount(owner[at], minlength=n)[k + 1:]
        near = both / (size[k] + size[k + 1:] - both)
        hit = np.flatnonzero(near >= threshold)
        if len(hit):
            left.append(np.full(len(hit), k))
            right.append(hit + k + 1)
            found.append(near[hit])
            waiting += len(hit)
        if waiting >= TOLD:
            yield told(left, right, found)
            left, right, found, waiting = [], [], [], 0
    if waiting:
        yield told(left, right, found)


def _whole_blocks(said: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """``block_pairs`` of blocks that a task can hold. Texts are shuffled once, by block; words are read after that."""
    ship_package()
    dealt = said.repartition(*keys)
    sets = (dealt.select(*keys, "_id", F.coalesce(F.array_sort(F.array_distinct(words(F.col("_text")))), F.array().cast("array<string>")).alias("words"))
            .groupBy(*keys, "words").agg(F.min("_id").alias("id")).filter("id is not null").sortWithinPartitions(*keys))
    id_type = said.schema["_id"].dataType
    schema = StructType([*[said.schema[k] for k in keys], StructField("a", id_type), StructField("b", id_type), StructField("similarity", DoubleType())])
    pairs = sets.mapInArrow(lambda batches: _alike(batches, keys, threshold), schema)
    return pairs.filter("a != b").select(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity")


def block_pairs(df: DataFrame, keys: list[str], id_col: str = "message_id", text: str = "text", threshold: float = 0.5,
                cell: int = CELL, whole: int = WHOLE) -> DataFrame:
    """(keys, a, b, similarity) of all pairs in a block whose word sets have a Jaccard similarity of ``threshold`` or more.

    Exact. Blocks of up to ``whole`` messages (and some megabytes of text) are compared by one task each, which counts
    the words that two sets share. Larger ones are compared by prefixes: with words ordered from rare to common, two such sets share one of the first
    ``size - ceil(threshold * size) + 1`` words of each; pairs of too different sizes are passed over, and words that
    more than ``cell`` sets begin with are split into cells. Equal word sets are one class (``word_sets``), so copies
    make no pairs. Ids name one message each.
    """
    if not 0 < threshold <= 1:
        raise ValueError("a threshold above 0, at most 1")
    if not keys:
        return _prefix_pairs(df, keys, id_col, text, threshold, cell)
    said = df.select(*keys, F.col(id_col).alias("_id"), F.col(text).alias("_text")).dropna(subset=keys)
    sizes = said.groupBy(*keys).agg(F.count("*").alias("_n"), F.sum(F.length("_text")).alias("_chars"))
    crowded = settle(sizes.filter((F.col("_n") > whole) | (F.col("_chars") > WHOLE_CHARS)).select(*keys))
    if crowded.isEmpty():
        return _whole_blocks(said, keys, threshold)
    small = fits_broadcast(crowded)
    few, many = (join_dimension(said, crowded, keys, how, small=small) for how in ("left_anti", "left_semi"))
    return _whole_blocks(few, keys, threshold).unionByName(_prefix_pairs(many, keys, "_id", "_text", threshold, cell))


def _prefix_pairs(df: DataFrame, keys: list[str], id_col: str, text: str, threshold: float, cell: int) -> DataFrame:
    """``block_pairs`` by prefixes, for blocks of any size."""
    sets = settle(word_sets(df, keys, id_col, text))
    exploded = sets.select("id", F.size("words").alias("size"), F.explode("words").alias("word"))
    seen = settle(exploded.groupBy("word").agg(F.count("*").alias("df")))
    length = (F.col("size") - F.ceil(F.lit(threshold) * F.col("size") - 1e-9) + 1).cast("int")
    # Rows of single words from here on: a text's words are met again only for the pairs that are compared.
    ordered = F.array_sort(F.collect_list(F.struct("df", "word")))
    prefix = (join_dimension(exploded, seen, ["word"], "inner").groupBy("id", "size").agg(ordered.alias("order"))
              .select("id", "size", F.explode(F.slice(F.transform("order", lambda x: x["word"]), F.lit(1), length)).alias("word")))
    bucket = [*keys, "word"]
    filed = settle(_parts(prefix.join(sets.select(*keys, "id"), "id"), bucket, cell))
    joined = filed.alias("x").join(filed.alias("y"), [*bucket, "low", "high"]).filter(
        _met("x", "y") & (F.least("x.size", "y.size") >= F.lit(threshold) * F.greatest("x.size", "y.size") - 1e-9))
    pairs = joined.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()
    words_of = lambda name: sets.select(F.col("id").alias(name), F.col("words").alias(f"_{name}"))
    both = F.size(F.array_intersect("_a", "_b"))
    compared = pairs.join(sets.select(*keys, F.col("id").alias("a"), F.col("words").alias("_a")), "a").join(words_of("b"), "b")
    return (compared.withColumn("_both", both)
            .withColumn("similarity", F.col("_both") / (F.size("_a") + F.size("_b") - F.col("_both")))
            .filter(F.col("similarity") >= threshold).select(*keys, "a", "b", "similarity"))


# Vectors

def _hashed(batches: Iterator[pa.RecordBatch], tables: int, bits: int, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, unit vectors, a bucket for each table by the sides of random hyperplanes) of the usable vectors, by their length."""
    planes: dict[int, np.ndarray] = {}
    weight = 1 << np.arange(bits, dtype=np.int64)
    for batch in batches:
        ids, rows = [], []
        for i, v in zip(batch.column("id").to_pylist(), batch.column("v").to_pylist()):
            if i is not None and v and None not in v:
                x = np.asarray(v, np.float64)
                top = np.abs(x).max()
                if np.isfinite(top) and top > 0 and not np.isnan(x).any():
                    x = x / top
                    ids.append(i)
                    rows.append(x / np.sqrt((x * x).sum()))
        for size in sorted({len(x) for x in rows}):
            at = [k for k, x in enumerate(rows) if len(x) == size]
            if size not in planes:
                planes[size] = np.random.default_rng(seed).normal(size=(size, tables * bits))
            x = np.stack([rows[k] for k in at])
            keys = ((x @ planes[size] > 0).reshape(len(x), tables, bits) * weight).sum(axis=2)
            yield np.array([ids[k] for k in at], np.int64), x, keys


def _signatures(batches: Iterator[pa.RecordBatch], tables: int, bits: int, seed: int) -> Iterator[pa.RecordBatch]:
    """(table, bucket, id, vec) for every table."""
    for ids, x, keys in _hashed(batches, tables, bits, seed):
        vecs, own = pa.array([row.tobytes() for row in x], pa.binary()), pa.array(ids)
        for t in range(tables):
            yield pa.record_batch({"tab": pa.array(np.full(len(x), t), pa.int32()), "size": pa.array(np.full(len(x), x.shape[1]), pa.int32()),
                                   "bucket": pa.array(keys[:, t], pa.int64()), "id": own, "vec": vecs})


PACKED = "size int, ids binary, vecs binary, buckets binary"


def _packed(batches: Iterator[pa.RecordBatch], tables: int, bits: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Blocks of vectors of one length, with their buckets."""
    for ids, x, keys in _hashed(batches, tables, bits, seed):
        keys = keys.astype(np.min_scalar_type((1 << bits) - 1))
        for s in range(0, len(x), BLOCK):
            yield pa.record_batch({"size": pa.array([x.shape[1]], pa.int32()), **{
                name: pa.array([part[s:s + BLOCK].tobytes()], pa.binary()) for name, part in (("ids", ids), ("vecs", x), ("buckets", keys))}})


def _met_blocks(batches: Iterator[pa.RecordBatch], threshold: float, tables: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Pairs of two blocks, or inside one, at ``threshold`` or more that share the bucket of a table."""
    kind = np.min_scalar_type((1 << bits) - 1)
    for batch in batches:
        for row in batch.to_pylist():
            ids = [np.frombuffer(row[f"{side}_ids"], np.int64) for side in "xy"]
            x, y = (np.frombuffer(row[f"{side}_vecs"]).reshape(-1, row["size"]) for side in "xy")
            own, other = (np.frombuffer(row[f"{side}_buckets"], kind).reshape(-1, tables) for side in "xy")
            p, q = np.nonzero((near := x @ y.T) >= threshold)
            if row["alone"]:
                p, q = p[q < p], q[q < p]
            for s in range(0, len(p), TOLD):
                i, j = p[s:s + TOLD], q[s:s + TOLD]
                shared = (own[i] == other[j]).any(axis=1)
                i, j = i[shared], j[shared]
                yield pa.record_batch({"a": np.minimum(ids[0][i], ids[1][j]), "b": np.maximum(ids[0][i], ids[1][j]), "similarity": near[i, j]})


def _pairs_by_blocks(distinct: DataFrame, threshold: float, tables: int, bits: int, seed: int) -> DataFrame:
    """Every two blocks met once, without a copy of a vector: blocks are stored, and a task reads its share of both sides."""
    blocks = stored_step(distinct.mapInArrow(lambda b: _packed(b, tables, bits, seed), PACKED)
                         .withColumn("block", F.monotonically_increasing_id()), "blocks")
    side = lambda name: [F.col(f"{name}.{c}").alias(f"{name}_{c}") for c in ("ids", "vecs", "buckets")]
    # Not an equality of columns, by which all blocks would go to the task of their length.
    met = (F.col("x.block") <= F.col("y.block")) & (F.col("x.size") - F.col("y.size") == 0)
    return blocks.alias("x").join(blocks.alias("y"), met).select(
        "x.size", (F.col("x.block") == F.col("y.block")).alias("alone"), *side("x"), *side("y")).mapInArrow(
        lambda b: _met_blocks(b, threshold, tables, bits), "a bigint, b bigint, similarity double")


def _close(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Pairs of a cell at ``threshold`` or more. Cells come sorted; the low part is held, the high part streams past."""
    now, ids, held = None, np.zeros(0, np.int64), None

    def told(a: np.ndarray, b: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch({"a": np.minimum(a, b), "b": np.maximum(a, b), "similarity": s})

    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(c).to_numpy() for c in ("tab", "size", "bucket", "low", "high")], axis=1)
        part, own = batch.column("part").to_numpy(), batch.column("id").to_numpy()
        cuts = np.flatnonzero((np.diff(key, axis=0) != 0).any(axis=1)) + 1
        for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)]):
            if now is None or (now != key[s]).any():
                now, ids, held = key[s], np.zeros(0, np.int64), None
            x = np.frombuffer(b"".join(batch.column("vec").slice(s, e - s).to_pylist())).reshape(e - s, -1)
            low, alone = part[s:e] == now[3], now[3] == now[4]
            fresh, names = (x, own[s:e]) if alone else (x[~low], own[s:e][~low])
            grown = np.concatenate([held, x[low]]) if held is not None else x[low]
            before = len(ids)
            ids, held = np.concatenate([ids, own[s:e][low]]), grown
            near = fresh @ held.T
            if alone:  # each new vector against those before it
                order = before + np.arange(len(fresh))
                near = np.where(np.arange(len(ids))[None, :] < order[:, None], near, -1.0)
            p, q = np.nonzero(near >= threshold)
            if len(p):
                yield told(names[p], ids[q], near[p, q])


def vector_pairs(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.9, tables: int = TABLES,
                 bits: int = BITS, cell: int = CELL, seed: int = 3) -> DataFrame:
    """(a, b, similarity) of pairs of vectors with a cosine of ``threshold`` or more that share a bucket of some table.

    At an angle of x degrees a table finds a pair with probability ``(1 - x / 180) ** bits``; the defaults find 98 in
    100 at a cosine of 0.9, and nearer pairs more often. Vectors that are null, zero or not finite take no part, those of
    different length do not meet. Equal vectors are one class, named by the smallest id, so copies make no pairs.

    With as many tables as a table has buckets, or more, two vectors would meet in one bucket or more on average. Then
    all are compared once, block by block, and pairs that share no bucket are left out: the same pairs, without copies
    of vectors for each table and cell.
    """
    ship_package()
    kept = F.col(vec_col) if dict(vectors.dtypes)[vec_col] == "array<float>" else F.col(vec_col).cast("array<double>")
    one = vectors.select(F.col(id_col).cast("bigint").alias("id"), kept.alias("v"))
    distinct = one.filter("id is not null and v is not null").groupBy("v").agg(F.min("id").alias("id"))
    if tables >= 1 << bits:
        return _pairs_by_blocks(distinct, threshold, tables, bits, seed).groupBy("a", "b").agg(F.max("similarity").alias("similarity"))
    distinct = settle(distinct)
    filed = settle(distinct.mapInArrow(lambda b: _signatures(b, tables, bits, seed), "tab int, size int, bucket bigint, id bigint, vec binary"))
    cells = _parts(filed, ["tab", "size", "bucket"], cell).select("tab", "size", "bucket", "low", "high", "part", "id", "vec")
    dealt = cells.repartition("tab", "size", "bucket", "low", "high").sortWithinPartitions("tab", "size", "bucket", "low", "high", "part")
    found = dealt.mapInArrow(lambda b: _close(b, threshold), "a bigint, b bigint, similarity double")
    return found.groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


def chance(cosine: float, tables: int = TABLES, bits: int = BITS) -> float:
    """How likely ``vector_pairs`` finds a pair at this cosine."""
    return 1 - (1 - (1 - math.acos(cosine) / math.pi) ** bits) ** tables
