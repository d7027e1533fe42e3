"""Approximate nearest neighbours by a hierarchical k-means tree.

The tree is fitted on a bounded sample; every vector is filed under the leaf that it descends to. A query walks the
tree best bin first: a priority queue holds the branches passed by, the nearest goes next, and leaves are visited until
the number calibrated against brute force is reached. The vectors of visited leaves are scored exactly. Neighbouring
leaves lie in one shard, and a query is sent to a shard once, with the leaves that it visits there.
"""

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.common import empty, store
from tidewire.operators.scale import join_dimension
from tidewire.session import ship_package

SAMPLE = 32_768
QUERIES = 256
BRANCH = 8
PER_LEAF = 192
LEAST_FITTED = 8
RECALL = 0.96
SHARD = 4096
CHUNK = 256
RESULT = "query_id bigint, rank int, vec_id bigint, score double"


# The tree

def _squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None, :]


def _split(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(centres, own centre of each row) of plain k-means; centres that lose all rows are dropped."""
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = _squared(x, centres).argmin(axis=1)
        count = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        centres = total[count > 0] / count[count > 0, None]
    return centres, _squared(x, centres).argmin(axis=1)


class Tree:
    """Hierarchical k-means. ``kids[node]`` are the children of an inner node, ``leaf[node]`` the number of a leaf."""

    def __init__(self, x: np.ndarray, per_leaf: int, branch: int = BRANCH, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.kids: list[np.ndarray | None] = [None]
        self.centres: list[np.ndarray | None] = [None]  # of the children of each node
        self.leaf, self.leaves = [-1], 0
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            centres, own = _split(x[rows], branch, rng) if len(rows) > per_leaf else (None, None)
            if centres is None or len(np.unique(own)) < 2:
                self.leaf[node], self.leaves = self.leaves, self.leaves + 1
                continue
            first = len(self.kids)
            self.kids[node] = np.arange(first, first + len(centres))
            self.centres[node] = centres
            self.kids += [None] * len(centres)
            self.centres += [None] * len(centres)
            self.leaf += [-1] * len(centres)
            todo += [(first + c, rows[own == c]) for c in range(len(centres))]

    def file(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: the nearest child at every node."""
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.kids[node] is None:
                out[rows] = self.leaf[node]
                continue
            own = _squared(x[rows], self.centres[node]).argmin(axis=1)
            todo += [(int(self.kids[node][c]), rows[own == c]) for c in np.unique(own)]
        return out

    def visit(self, q: np.ndarray, visits: int, sizes: np.ndarray | None = None, least: int = 0) -> list[int]:
        """Leaves in best-bin-first order: ``visits`` of them, and more until they hold ``least`` vectors."""
        queue, found, held = [(0.0, 0)], [], 0
        while queue and (len(found) < visits or held < least):
            _, node = heapq.heappop(queue)
            while (kids := self.kids[node]) is not None:
                off = self.centres[node] - q
                far = np.einsum("ij,ij->i", off, off)
                near = int(far.argmin())
                for c, d in enumerate(far.tolist()):
                    if c != near:
                        heapq.heappush(queue, (d, int(kids[c])))
                node = int(kids[near])
            found.append(self.leaf[node])
            held += least if sizes is None else int(sizes[found[-1]])
        return found


# Vectors

def _pack(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    """Usable vectors as (id, vec): an id, and components that are all finite and not all zero."""
    for batch in batches:
        ids, vecs = [], []
        for i, v in zip(batch.column("id").to_pylist(), batch.column("v")):
            if i is None or not v.is_valid or not len(v.values) or v.values.null_count:
                continue
            x = v.values.to_numpy()
            if np.isfinite(x).all() and x.any():
                ids.append(i)
                vecs.append((x + 0.0).astype(kind).tobytes())  # one zero only
        yield pa.record_batch({"id": pa.array(ids, pa.int64()), "vec": pa.array(vecs, pa.binary())})


def _rows(vecs: list[bytes], kind: str) -> np.ndarray:
    """Vectors of one length in double precision, scaled by powers of two so that no square overflows."""
    x = np.frombuffer(b"".join(vecs), kind).reshape(len(vecs), -1).astype(np.float64)
    top = np.abs(x).max(axis=1, initial=0)
    return x / 2.0 ** np.floor(np.log2(np.where(top > 0, top, 1)))[:, None] if len(x) else x


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", x, x))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / _norms(x)[:, None]


def _by_length(vecs: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    sizes = np.fromiter(map(len, vecs), np.int64, len(vecs))
    for size in np.unique(sizes):
        yield int(size), np.flatnonzero(sizes == size)


def _measured(batches: Iterator[pa.RecordBatch], kind: str, trees: dict[int, Tree], asked: dict[int, np.ndarray], k: int) -> Iterator[pa.RecordBatch]:
    """For calibration: vectors in each leaf (q -1), and the leaves of the k nearest vectors of each asked one."""
    count: dict[tuple[int, int], int] = {}
    best = {size: (np.full((len(q), k), -2.0), np.full((len(q), k), -1)) for size, q in asked.items()}
    for batch in batches:
        vecs = batch.column("vec").to_pylist()
        for size, at in _by_length(vecs):
            if size not in trees:
                count[size, 0] = count.get((size, 0), 0) + len(at)
                continue
            x = _unit(_rows([vecs[i] for i in at], kind))
            leaf = trees[size].file(x)
            for cell, n in zip(*np.unique(leaf, return_counts=True)):
                count[size, int(cell)] = count.get((size, int(cell)), 0) + int(n)
            if size in asked:
                score, where = best[size]
                all_s = np.concatenate([score, asked[size] @ x.T], axis=1)
                all_w = np.concatenate([where, np.broadcast_to(leaf, (len(score), len(leaf)))], axis=1)
                pick = np.argpartition(-all_s, k - 1, axis=1)[:, :k]
                best[size] = np.take_along_axis(all_s, pick, 1), np.take_along_axis(all_w, pick, 1)
    rows = [(size, -1, leaf, float(n)) for (size, leaf), n in count.items()]
    for size, (score, where) in best.items():
        rows += [(size, q, int(w), float(s)) for q in range(len(score)) for s, w in zip(score[q], where[q]) if w >= 0]
    size, q, leaf, value = zip(*rows) if rows else ((), (), (), ())
    yield pa.record_batch({"size": pa.array(size, pa.int32()), "q": pa.array(q, pa.int32()), "leaf": pa.array(leaf, pa.int64()),
                           "value": pa.array(value, pa.float64())})


def calibrate(trees: dict[int, Tree], asked: dict[int, np.ndarray], truth: list, recall: float) -> int:
    """Leaf visits that hold ``recall`` of the true neighbours of the asked vectors; widened until they do."""
    order = {(size, q): {leaf: r for r, leaf in enumerate(trees[size].visit(x, trees[size].leaves))}
             for size, qs in asked.items() for q, x in enumerate(qs)}
    ranks = np.array([order[r.size, r.q][r.leaf] for r in truth])
    visits, most = 1, max(t.leaves for t in trees.values())
    while visits < most and (ranks < visits).mean() < recall:
        visits += max(1, visits // 8)
    return min(visits, most)


def shards_of(sizes: np.ndarray, most: int) -> np.ndarray:
    """Shard of each leaf: runs of neighbouring leaves that hold some ``most`` vectors."""
    return np.maximum(np.cumsum(sizes) - 1, 0) // most


FILED = "size int, shard bigint, probe int, key binary, ids array<bigint>, leaves binary, vec binary"


def _filed(batches: Iterator[pa.RecordBatch], kind: str, trees: dict[int, Tree], shards: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vecs = batch.column("vec").to_pylist()
        size, leaf, shard = np.zeros(len(vecs), np.int32), np.zeros(len(vecs), "<i4"), np.zeros(len(vecs), np.int64)
        for n, at in _by_length(vecs):
            size[at] = n
            if n in trees:
                leaf[at] = trees[n].file(_unit(_rows([vecs[i] for i in at], kind)))
                shard[at] = shards[n][leaf[at]]
        yield pa.record_batch({"size": size, "shard": shard, "probe": pa.array(np.zeros(len(vecs), np.int32)), "key": batch.column("key"),
                               "ids": batch.column("ids"), "leaves": pa.array([x.tobytes() for x in leaf], pa.binary()), "vec": batch.column("vec")})


def _probes(batches: Iterator[pa.RecordBatch], kind: str, trees: dict[int, Tree], sizes: dict[int, np.ndarray], shards: dict[int, np.ndarray],
            visits: int, least: int) -> Iterator[pa.RecordBatch]:
    """Each query once for every shard that it visits, with the leaves it visits there."""
    for batch in batches:
        vecs, keys, rows = batch.column("vec").to_pylist(), batch.column("key").to_pylist(), []

        def out() -> pa.RecordBatch:
            size, shard, at, leaves = zip(*rows) if rows else ((), (), (), ())
            return pa.record_batch({"size": pa.array(size, pa.int32()), "shard": pa.array(shard, pa.int64()),
                                    "probe": pa.array(np.ones(len(rows), np.int32)), "key": pa.array([keys[i] for i in at], pa.binary()),
                                    "ids": pa.nulls(len(rows), pa.list_(pa.int64())), "leaves": pa.array(leaves, pa.binary()),
                                    "vec": pa.array([vecs[i] for i in at], pa.binary())})

        for n, at in _by_length(vecs):
            x = _unit(_rows([vecs[i] for i in at], kind)) if n in trees else None
            for k, i in enumerate(at.tolist()):
                leaves = np.sort(trees[n].visit(x[k], visits, sizes[n], least)) if n in trees else np.zeros(1, int)
                own = shards[n][leaves] if n in trees else leaves
                for part in np.split(np.arange(len(leaves)), np.flatnonzero(np.diff(own)) + 1):
                    rows.append((n, int(own[part[0]]), i, leaves[part].astype("<i4").tobytes()))
                if len(rows) > 8192:
                    yield out()
                    rows = []
        yield out()


class _Shard:
    """The filed vectors of one block of a shard, against the queries that stream past."""

    def __init__(self, kind: str, k: int) -> None:
        self.kind, self.k, self.vecs, self.lists, self.leaves, self.x = kind, k, [], [], [], None

    def file(self, part: pa.RecordBatch) -> None:
        self.vecs += part.column("vec").to_pylist()
        self.lists += part.column("ids").to_pylist()
        self.leaves += part.column("leaves").to_pylist()

    def _start(self) -> None:
        leaf = np.frombuffer(b"".join(self.leaves), "<i4")
        order = np.argsort(leaf, kind="stable")
        self.x = _rows([self.vecs[i] for i in order], self.kind)
        self.lists = [self.lists[i] for i in order]
        self.norms = np.sqrt((self.x * self.x).sum(axis=1))
        cuts = [0, *(np.flatnonzero(np.diff(leaf[order])) + 1).tolist(), len(order)]
        self.at = {int(leaf[order[s]]): slice(s, e) for s, e in zip(cuts, cuts[1:])}
        self.vecs = self.leaves = []

    def search(self, part: pa.RecordBatch) -> Iterator[tuple]:
        if self.x is None:
            if not self.vecs:
                return
            self._start()
        keys, wanted = part.column("key").to_pylist(), part.column("leaves").to_pylist()
        q = _rows(part.column("vec").to_pylist(), self.kind)
        unit, approx, visitors = _unit(q), np.full((len(q), len(self.x)), -3.0), {}
        for r, leaves in enumerate(wanted):
            for leaf in np.frombuffer(leaves, "<i4").tolist():
                visitors.setdefault(leaf, []).append(r)
        for leaf, rows in visitors.items():
            if leaf in self.at:
                own = self.at[leaf]
                approx[np.array(rows), own] = unit[rows] @ self.x[own].T / self.norms[own]
        for r in range(len(q)):
            yield from self._best(q[r], keys[r], approx[r])

    def _best(self, q: np.ndarray, key: bytes, approx: np.ndarray) -> Iterator[tuple]:
        n = min(self.k, len(approx))
        least = max(np.partition(approx, len(approx) - n)[len(approx) - n], -2.0)
        at = np.flatnonzero(approx >= least - 1e-9)
        # Scored pair by pair: a matrix product can round the same pair differently in another block.
        score = (self.x[at] * q).sum(axis=1) / (self.norms[at] * np.sqrt((q * q).sum()))
        found = sorted((-s, i) for s, a in zip(score.tolist(), at.tolist()) for i in self.lists[a])
        return ((key, i, -s) for s, i in found[:self.k])


def _searched(batches: Iterator[pa.RecordBatch], kind: str, k: int) -> Iterator[pa.RecordBatch]:
    """The k best (key, id, score) of each query in each block of a shard."""
    now, shard = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        parts = np.stack([batch.column(c).to_numpy() for c in ("size", "shard", "block", "probe")], axis=1)
        cuts = np.flatnonzero((np.diff(parts, axis=0) != 0).any(axis=1)) + 1
        for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(parts)]):
            if now != tuple(parts[s, :3]):
                now, shard = tuple(parts[s, :3]), _Shard(kind, k)
            if parts[s, 3] == 0:
                shard.file(batch.slice(s, e - s))
                continue
            for c in range(s, e, CHUNK):
                yield _found(list(shard.search(batch.slice(c, min(CHUNK, e - c)))))


def _found(rows: list[tuple]) -> pa.RecordBatch:
    key, i, score = zip(*rows) if rows else ((), (), ())
    return pa.record_batch({"key": pa.array(key, pa.binary()), "id": pa.array(i, pa.int64()), "score": pa.array(score, pa.float64())})


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", sample: int = SAMPLE,
            recall: float = RECALL, per_leaf: int = PER_LEAF, shard: int = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest by cosine of each row whose id is divisible by ``every``.

    A null, empty or zero vector, one with null or non-finite components and a row without id take no part; vectors
    of another length are no candidates. Rows of one id with different vectors are one vector that is as near as its
    nearest row; repeated rows count once. Equal vectors are filed and searched once, with their smallest ids. Ties go
    to the smaller id. An empty table gives no rows, other columns are not read.

    The tree is fitted on at most ``sample`` vectors, so beyond some ``sample / 8`` leaves the leaves grow with the
    table. The number of leaf visits is the least that holds ``recall`` of the true neighbours of ``QUERIES`` queries,
    found by brute force over all vectors. Shards have some ``shard`` vectors; one with twice as many is split into
    blocks, and a task holds one block.
    """
    ship_package()
    spark = vectors.sparkSession
    kind = "<f4" if dict(vectors.dtypes)[vec_col] == "array<float>" else "<f8"
    given = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast(f"array<{'float' if kind == '<f4' else 'double'}>").alias("v"))
    packed = given.mapInArrow(lambda batches: _pack(batches, kind), "id bigint, vec binary").withColumn("key", F.unhex(F.md5("vec")))
    # Ids first, without vectors: a group of copies is met by its smallest ids only.
    named = store(packed.select("key", "id").distinct(), "named")
    lowest = Window.partitionBy("key").orderBy("id")
    ids = named.withColumn("place", F.row_number().over(lowest)).filter(F.col("place") <= k + 1).groupBy("key").agg(F.collect_list("id").alias("ids"))
    asks = named.filter(F.col("id") % every == 0)
    classes = store(packed.select("key", "vec").dropDuplicates(["key"]).join(ids, "key")
                    .join(asks.select("key").distinct().withColumn("asks", F.lit(True)), "key", "left"), "classes")
    total = classes.count()
    chosen = classes.orderBy(F.xxhash64("key"), "key").limit(sample).select("vec").collect()
    if not chosen:
        return empty(spark, RESULT)
    trees = {}
    for size, at in _by_length(vecs := [r.vec for r in chosen]):
        fitted = max(LEAST_FITTED, per_leaf * len(chosen) // total)
        if len(at) > 2 * fitted:
            trees[size] = Tree(_unit(_rows([vecs[i] for i in at], kind)), fitted)
    queries = classes.filter("asks")
    picked = [r.vec for r in queries.orderBy(F.xxhash64("key"), "key").limit(QUERIES).select("vec").collect()]
    asked = {size: _unit(_rows([picked[i] for i in at], kind)) for size, at in _by_length(picked) if size in trees}
    found = store(classes.select("vec").mapInArrow(lambda b: _measured(b, kind, trees, asked, k + 1), "size int, q int, leaf bigint, value double"), "measured")
    counts = found.filter("q < 0").groupBy("size", "leaf").agg(F.sum("value").cast("bigint").alias("n"))
    sizes = {size: np.zeros(t.leaves, np.int64) for size, t in trees.items()}
    for r in counts.filter(F.col("size").isin(list(trees))).collect():  # at most one row for each leaf of the trees
        sizes[r.size][r.leaf] = r.n
    closest = Window.partitionBy("size", "q").orderBy(F.desc("value"), "leaf")
    # The nearest is the asked vector itself, which is always found: it does not count.
    truth = found.filter("q >= 0").withColumn("place", F.row_number().over(closest)).filter(F.col("place").between(2, k + 1)).collect()
    visits = calibrate(trees, asked, truth, recall) if truth else 1

    shards = {size: shards_of(n, shard) for size, n in sizes.items()}
    filed = classes.select("key", "ids", "vec").mapInArrow(lambda b: _filed(b, kind, trees, shards), FILED)
    probes = queries.select("key", "vec").mapInArrow(lambda b: _probes(b, kind, trees, sizes, shards, visits, k + 1), FILED)
    full = [(size, int(c), int(n)) for size, of in shards.items() for c, n in enumerate(np.bincount(of, sizes[size]))]
    held = counts.filter(~F.col("size").isin(list(trees))).select("size", F.col("leaf").alias("shard"), "n").unionByName(
        spark.createDataFrame(full, "size int, shard bigint, n bigint"))  # at most a row for each leaf
    blocks = held.select("size", "shard", (F.floor((F.col("n") - 1) / (2 * shard)) + 1).cast("int").alias("blocks"))
    spread = join_dimension(filed.unionByName(probes), blocks, ["size", "shard"], "inner").withColumn("block", F.explode(
        F.when(F.col("probe") == 0, F.array(F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))))
    dealt = (spread.select("size", "shard", "block", "probe", "key", "ids", "leaves", "vec").repartition("size", "shard", "block")
             .sortWithinPartitions("size", "shard", "block", "probe"))
    scored = dealt.mapInArrow(lambda b: _searched(b, kind, k + 1), "key binary, id bigint, score double")
    top = Window.partitionBy("key").orderBy(F.desc("score"), "id")
    near = scored.withColumn("place", F.row_number().over(top)).filter(F.col("place") <= k + 1).drop("place")
    pairs = (asks.withColumnRenamed("id", "query_id").join(near, "key").filter("query_id != id")
             .groupBy("query_id", "id").agg(F.max("score").alias("score")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return (pairs.withColumn("rank", rank).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score"))
