"""Near-duplicate embeddings by an inverted multi-index.

Two codebooks, one for each half of the vectors, form a product grid of cells. Every vector is filed under its own
cell and probes the cells nearest to it, in the order of the summed half distances, as many as the target recall
takes. The vectors of a cell are then verified with exact cosines.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import components, store
from tidewire.session import ship_package

THRESHOLD = 0.9
SAMPLE = 20_000
QUERIES = 256
PER_CELL = 128
MAX_WORDS = 512
RECALL = 0.99
BLOCK = 2048


def codebook(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Plain k-means; a centre that loses all its points stays where it is."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = half_distances(x, centres).argmin(axis=1)
        count = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        centres[count > 0] = total[count > 0] / count[count > 0, None]
    return centres


def half_distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None, :])


def nearest_cells(x: np.ndarray, books: tuple[np.ndarray, np.ndarray], visits: int) -> np.ndarray:
    """The ``visits`` nearest cells of each row, nearest first.

    A multi-sequence traversal: with both codebooks sorted by distance, the n nearest cells of the grid all have
    (i + 1) * (j + 1) <= n in sorted ranks, so only that corner of the grid is summed and ordered.
    """
    half = len(books[0][0])
    d1, d2 = half_distances(x[:, :half], books[0]), half_distances(x[:, half:], books[1])
    o1, o2 = np.argsort(d1, axis=1, kind="stable"), np.argsort(d2, axis=1, kind="stable")
    k1, k2 = d1.shape[1], d2.shape[1]
    visits = min(visits, k1 * k2)
    corner = np.array([(i, j) for i in range(min(k1, visits)) for j in range(min(k2, visits // (i + 1)))])
    s1, s2 = np.take_along_axis(d1, o1, 1), np.take_along_axis(d2, o2, 1)
    total = s1[:, corner[:, 0]] + s2[:, corner[:, 1]]
    pick = np.argsort(total, axis=1, kind="stable")[:, :visits]
    c1 = np.take_along_axis(o1, corner[pick, 0], 1)
    c2 = np.take_along_axis(o2, corner[pick, 1], 1)
    return c1 * k2 + c2


def _unit(vectors: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(vectors), dtype="<f8").reshape(len(vectors), -1)
    return x / np.linalg.norm(x, axis=1)[:, None]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Usable vectors as (id, vec, dim), scaled by their largest component so that no square overflows."""
    for batch in batches:
        ids, vecs, dims = [], [], []
        for i, v in zip(batch.column("id").to_pylist(), batch.column("v").to_pylist()):
            if i is None or not v or any(c is None for c in v):
                continue
            x = np.asarray(v, dtype=np.float64)
            top = np.abs(x).max()
            if np.isfinite(top) and top > 0 and np.isfinite(x).all():
                ids.append(i)
                vecs.append((x / 2.0 ** np.floor(np.log2(top))).astype("<f8").tobytes())
                dims.append(len(x))
        yield pa.record_batch({"id": pa.array(ids, pa.int64()), "vec": pa.array(vecs, pa.binary()), "dim": pa.array(dims, pa.int32())})


def _true_links(batches, queries, threshold, books):
    for batch in batches:
        x = _unit(batch.column("vec").to_pylist()) if batch.num_rows else np.zeros((0, queries.shape[1]))
        q, r = np.nonzero(queries @ x.T >= threshold)
        cell = nearest_cells(x, books, 1)[:, 0] if len(x) else np.zeros(0, int)
        yield pa.record_batch({"q": pa.array(q, pa.int32()), "cell": pa.array(cell[r], pa.int64())})


def _visits(pool: np.ndarray, books, found: list, queries: np.ndarray, threshold: float, recall: float) -> int:
    """How many cells a query visits: enough for ``recall`` of the measured links of the sampled queries, and
    for nine tenths of sampled vectors moved half as far as the threshold allows."""
    cells = len(books[0]) * len(books[1])
    rank = np.argsort(nearest_cells(queries, books, cells), axis=1)
    seen = np.repeat([rank[r.q, r.cell] for r in found], [r.n for r in found]) if found else np.zeros(1, int)
    rng = np.random.default_rng(11)
    base = pool[:2048]
    step = rng.normal(size=base.shape)
    step -= (step * base).sum(1)[:, None] * base
    step /= np.maximum(np.linalg.norm(step, axis=1), 1e-12)[:, None]
    cos = 1 - (1 - threshold) / 2
    moved = cos * base + np.sqrt(1 - cos * cos) * step
    order = np.argsort(nearest_cells(moved, books, cells), axis=1)
    ranks = order[np.arange(len(base)), nearest_cells(base, books, 1)[:, 0]]
    return int(min(cells, 1 + max(np.quantile(seen, recall, method="higher"), np.quantile(ranks, 0.9, method="higher"))))


def _filed(batches, books, visits, dim):
    """Each class under its own cell (with the cells it probes), and once under each cell that it probes."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        ids, mult = batch.column("id").to_numpy(), batch.column("mult").to_numpy()
        vecs = batch.column("vec")
        if books is None:  # too few vectors of this length for a grid: one cell
            cells = np.zeros((len(ids), 1), dtype=np.int64)
        else:
            cells = nearest_cells(_unit(vecs.to_pylist()), books, visits)
        t = cells.shape[1]
        cells = cells.astype("<i8")
        lists = pa.array([c.tobytes() for c in cells], pa.binary())
        own = pa.array(np.full(len(ids), dim, np.int32))
        yield pa.record_batch({"dim": own, "cell": cells[:, 0], "probe": pa.array(np.zeros(len(ids), np.int32)), "id": ids,
                               "mult": mult, "vec": vecs, "cells": lists, "home": cells[:, 0]})
        at = np.repeat(np.arange(len(ids)), t)
        for s in range(0, len(at), 8192):
            part = at[s:s + 8192]
            yield pa.record_batch({"dim": pa.array(np.full(len(part), dim, np.int32)), "cell": cells.reshape(-1)[s:s + 8192],
                                   "probe": pa.array(np.ones(len(part), np.int32)), "id": ids[part], "mult": mult[part],
                                   "vec": vecs.take(pa.array(part)), "cells": pa.nulls(len(part), pa.binary()),
                                   "home": cells[part, 0]})


FILED = "dim int, cell bigint, probe int, id bigint, mult bigint, vec binary, cells binary, home bigint"


class _Block:
    """The filed vectors of one block of a cell, against the probes that stream past."""

    def __init__(self, threshold: float) -> None:
        self.threshold, self.ids, self.mult, self.x, self.cells = threshold, [], [], [], []
        self.ready = False

    def file(self, ids, mult, vecs, cells) -> None:
        self.ids.append(ids)
        self.mult.append(mult)
        self.x.append(_unit(vecs))
        self.cells += [np.frombuffer(c, "<i8") for c in cells]

    def start(self) -> None:
        if not self.ready and self.ids:
            self.ids, self.mult, self.x = np.concatenate(self.ids), np.concatenate(self.mult), np.concatenate(self.x)
            self.cells = np.stack(self.cells)
            self.parent, self.credit = np.arange(len(self.ids)), np.zeros(len(self.ids), np.int64)
        self.ready = True

    def _root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def probe(self, ids, mult, vecs, home) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(vector, a vector it is linked with, vectors linked with it in this block)."""
        self.start()
        if not len(self.ids):
            return
        for s in range(0, len(ids), 1024):
            q = slice(s, s + 1024)
            near = _unit(vecs[q]) @ self.x.T >= self.threshold
            near &= ids[q][:, None] != self.ids[None, :]
            rows = np.flatnonzero(near.any(axis=1))
            if not len(rows):
                continue
            near = near[rows]
            counts = near @ self.mult
            first = near.argmax(axis=1)
            for r in range(len(rows)):
                linked = np.flatnonzero(near[r])
                # The partner counts this link itself where it probes the cell of this vector.
                unseen = ~(self.cells[linked] == home[q][rows[r]]).any(axis=1)
                self.credit[linked[unseen]] += mult[q][rows[r]]
                if len(linked) > 1 and len(np.unique(self.parent[linked])) > 1:
                    roots = [self._root(i) for i in linked]
                    low = min(roots)
                    self.parent[roots] = low
                    self.parent[linked] = low
            yield ids[q][rows], self.ids[first], counts

    def end(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        if self.ready and len(self.ids):
            roots = np.array([self._root(i) for i in range(len(self.ids))])
            told = np.flatnonzero((roots != np.arange(len(roots))) | (self.credit > 0))
            if len(told):
                yield self.ids[told], self.ids[roots[told]], self.credit[told]


def _verified(batches, threshold):
    block, key = _Block(threshold), None
    out = lambda x: pa.record_batch({"a": pa.array(x[0], pa.int64()), "b": pa.array(x[1], pa.int64()), "n": pa.array(x[2], pa.int64())})
    for batch in batches:
        if batch.num_rows == 0:
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in ("dim", "cell", "block", "probe")], axis=1)
        cuts = np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1
        for s, e in zip([0, *cuts], [*cuts, len(keys)]):
            if key != tuple(keys[s, :3]):
                yield from map(out, block.end())
                block, key = _Block(threshold), tuple(keys[s, :3])
            part = batch.slice(s, e - s)
            ids, mult, vecs = part.column("id").to_numpy(), part.column("mult").to_numpy(), part.column("vec").to_pylist()
            if keys[s, 3] == 0:
                block.file(ids, mult, vecs, part.column("cells").to_pylist())
            else:
                yield from map(out, block.probe(ids, mult, vecs, part.column("home").to_numpy()))
    yield from map(out, block.end())


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD,
                    sample: int = SAMPLE, recall: float = RECALL, per_cell: int = PER_CELL, block: int = BLOCK) -> DataFrame:
    """(id, n_links, component) for every row.

    A null, empty or zero vector, and one with null or non-finite components, links with nothing; so do vectors of
    different length. Equal vectors are one class with a count, so copies are not expanded. The grid grows with the
    classes (about ``per_cell`` each), its codebooks are fitted on at most ``sample`` vectors, and the number of
    cells to visit is set by the links of a bounded set of queries, measured against all vectors. Every class is
    indexed. A crowded cell is split into blocks of about ``block`` classes; probes stream past one block, so memory
    stays bounded. A link that only one side finds counts for both. A row without id links with nothing and has
    itself a null component. Repeated ids are treated as one vector each row; all get the sum of their links.
    """
    ship_package()
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    packed = rows.mapInArrow(_pack, "id bigint, vec binary, dim int")
    members = store(packed, "vectors")
    classes = store(members.groupBy("dim", "vec").agg(F.min("id").alias("id"), F.count("*").alias("mult")), "classes")
    parts = []
    for dim, n in sorted((r.dim, r.n) for r in classes.groupBy("dim").agg(F.count("*").alias("n")).collect()):
        mine = classes.filter(F.col("dim") == dim)
        books, visits = None, 1
        if n > 4 * per_cell and dim >= 2:
            k = int(np.clip(round((n / per_cell) ** 0.5), 2, MAX_WORDS))
            pool = _unit([r.vec for r in mine.select("vec").orderBy(F.xxhash64("vec"), "id").limit(sample).collect()])
            half = dim // 2
            books = codebook(pool[:, :half], k), codebook(pool[:, half:], k)
            queries = pool[:QUERIES]
            found = (mine.select("vec").mapInArrow(lambda b, q=queries, g=books: _true_links(b, q, threshold, g), "q int, cell bigint")
                     .groupBy("q", "cell").agg(F.count("*").alias("n")).collect())
            visits = _visits(pool, books, found, queries, threshold, recall)
        parts.append(mine.select("id", "mult", "vec").mapInArrow(
            lambda b, g=books, t=visits, d=dim: _filed(b, g, t, d), FILED))
    if not parts:
        return rows.select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component"))
    filed = parts[0]
    for p in parts[1:]:
        filed = filed.unionByName(p)
    # Blocks per cell: at most MAX_WORDS squared rows for each length of vector.
    sizes = filed.filter("probe = 0").groupBy("dim", "cell").agg((F.floor((F.count("*") - 1) / block) + 1).cast("int").alias("blocks"))
    spread = filed.join(F.broadcast(sizes), ["dim", "cell"]).withColumn("block", F.explode(F.when(
        F.col("probe") == 0, F.array(F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")))
        .otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))))
    dealt = (spread.select("dim", "cell", "block", "probe", "id", "mult", "vec", "cells", "home")
             .repartition("dim", "cell", "block").sortWithinPartitions("dim", "cell", "block", "probe"))
    links = store(dealt.mapInArrow(lambda b: _verified(b, threshold), "a bigint, b bigint, n bigint"), "links")
    named = components(links)
    counts = links.groupBy("a").agg(F.sum("n").alias("n"))
    told = (classes.join(counts, classes["id"] == counts["a"], "left").join(named, classes["id"] == named["node"], "left")
            .select("dim", "vec", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"),
                    F.coalesce("component", classes["id"]).alias("component")))
    linked = members.join(told, ["dim", "vec"]).groupBy("id").agg(F.max("n_links").alias("n_links"), F.min("component").alias("component"))
    return (rows.select("id").join(linked, "id", "left")
            .select("id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component", "id").alias("component")))
