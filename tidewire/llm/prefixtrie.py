"""Prefix trie of conversations in balanced parentheses.

Conversations become sequences of turn digests. Sorted and dealt by range, they form shards; the trie of a shard is a
string of balanced parentheses with a range min-max tree over its excess. Findclose gives the extent of every
subtree, the rank of leaf pairs its leaves, and cumulative arrays its members and savings. Nodes on the outer paths
of a shard (spines) can be shared with its neighbours, so they leave a shard as partial sums and are merged in rounds.
"""

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.common import store
from tidewire.operators.scale import join_dimension
from tidewire.session import ship_package

DIGEST = 16
LEAD_TURNS = 32
SHARD_NODES = 1 << 15
BLOCK = 256
FAN = 64
IDS = 4096
ROWS = 8192
NONE = np.iinfo(np.int64).max


# Balanced parentheses

class Parens:
    """A trie by the depths of its nodes in preorder (the root first, depth 0), as balanced parentheses."""

    def __init__(self, depth: np.ndarray, block: int = BLOCK) -> None:
        n = len(depth)
        self.block = block
        self.open = 2 * np.arange(n) - depth  # k opens and k - depth closes come before node k
        bits = np.full(2 * n, -1, np.int64)
        bits[self.open] = 1
        self.excess = np.cumsum(bits)
        self.blocks = -(-2 * n // block)
        padded = np.full(self.blocks * block, NONE)
        padded[:2 * n] = self.excess
        self.rows = padded.reshape(self.blocks, block)
        self.width = 1 << (self.blocks - 1).bit_length()
        self.low = np.full(2 * self.width, NONE)  # range minima: node k covers 2k and 2k + 1
        self.low[self.width:self.width + self.blocks] = self.rows.min(axis=1)
        for k in range(self.width - 1, 0, -1):
            self.low[k] = min(self.low[2 * k], self.low[2 * k + 1])

    def findclose(self, at: np.ndarray) -> np.ndarray:
        """Position of the parenthesis that closes each opening one."""
        goal, found = self.excess[at] - 1, np.full(len(at), -1)
        todo = np.arange(len(at))
        for step in range(1, self.block):  # the own block; most subtrees end here, soon
            spot = at[todo] + step
            inside = spot // self.block == at[todo] // self.block
            todo, spot = todo[inside & (spot < len(self.excess))], spot[inside & (spot < len(self.excess))]
            hit = self.excess[spot] == goal[todo]
            found[todo[hit]] = spot[hit]
            todo = todo[~hit]
            if not len(todo):
                break
        far = np.flatnonzero(found < 0)
        if not len(far):
            return found
        node, want = at[far] // self.block + self.width, goal[far]
        up = np.ones(len(far), bool)
        while up.any():  # to the nearest range on the right that falls to the goal
            right = up & (node % 2 == 0) & (self.low[np.minimum(node + 1, len(self.low) - 1)] <= want)
            node = np.where(right, node + 1, np.where(up, node // 2, node))
            up &= ~right
        down = node < self.width
        while down.any():
            left = 2 * node
            node = np.where(down, np.where(self.low[np.where(down, left, 1)] <= want, left, left + 1), node)
            down = node < self.width
        block = node - self.width
        for s in range(0, len(far), 4096):
            part = slice(s, s + 4096)
            first = (self.rows[block[part]] <= want[part][:, None]).argmax(axis=1)
            found[far[part]] = block[part] * self.block + first
        return found

    def ends(self) -> tuple[np.ndarray, np.ndarray]:
        """(end, leaf): the preorder number after each node's subtree, and whether the node is a pair ``()``."""
        close = self.findclose(self.open)
        return (close + 1 + self.excess[close]) // 2, close == self.open + 1


def range_min(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Minimum of ``values[start:end]`` for non-empty ranges, by a sparse table."""
    out, size, level, table = np.empty(len(start), values.dtype), end - start, 0, values
    while True:
        mine = np.flatnonzero((size >> level) == 1)
        out[mine] = np.minimum(table[start[mine]], table[end[mine] - (1 << level)])
        if not (size >> (level + 1)).any():
            return out
        table = np.minimum(table[:-(1 << level)], table[1 << level:])
        level += 1


# Sequences

def digests(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(c, turn, role, digest, words) of every turn; null role and text are empty, rows without conversation are left out."""
    said = conversations.select(F.col(conv).cast("bigint").alias("c"), F.col(turn).cast("bigint").alias("turn"),
                                F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    both = F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")
    return said.filter("c is not null").select("c", "turn", "role", F.unhex(F.md5(both)).alias("digest"),
                                               F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).alias("words"))


def _with_openings(rows: DataFrame, family: int, most: int) -> DataFrame:
    """Own turns (src 1) and, before them, the opening turns (src 0) of the first conversation of each family."""
    first = Window.partitionBy("c").orderBy("turn", "role", "digest")
    heads = (rows.filter(F.col("c") % family == 0).withColumn("place", F.row_number().over(first)).filter(F.col("place") < most)
             .select(F.col("c").alias("p"), "place", "digest", "words"))
    members = (rows.select("c").distinct().withColumn("p", F.col("c") - F.col("c") % family)
               .withColumn("h", F.crc32(F.col("c").cast("string")) % most))
    opening = members.join(heads, "p").filter("place <= h").select(
        "c", F.lit(0).alias("src"), F.col("place").cast("bigint").alias("turn"), F.lit("").alias("role"), "digest", "words")
    return rows.select("c", F.lit(1).alias("src"), "turn", "role", "digest", "words").unionByName(opening)


def _sequence_batches(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """One row for each conversation: the digests of its turns, end to end, and the words of each."""
    done: list[tuple] = []
    now, skip, held, words = None, 0, [], []

    def close() -> None:
        key = b"".join(held)
        done.append((now, key, np.array(words, "<i4").tobytes(), hashlib.md5(key).digest()))

    def out() -> pa.RecordBatch:
        c, key, said, end = zip(*done) if done else ((), (), (), ())
        return pa.record_batch({"c": pa.array(c, pa.int64()), "key": pa.array(key, pa.binary()), "words": pa.array(said, pa.binary()),
                                "end": pa.array(end, pa.binary())})

    for batch in batches:
        for c, src, digest, n in zip(*(batch.column(x).to_pylist() for x in ("c", "src", "digest", "words"))):
            if c != now:
                if now is not None:
                    close()
                now, held, words = c, [], []
                skip = zlib.crc32(str(c).encode()) % most if most else 0
            if src and skip:
                skip -= 1
            else:
                held.append(digest)
                words.append(n)
        if sum(len(d[1]) for d in done) > 1 << 22 or len(done) > ROWS:
            yield out()
            done = []
    if now is not None:
        close()
    yield out()


# Digests of the members that end at a node

def _joined_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of comma-joined ids of one end, ascending, at most ``IDS`` of them."""
    now, ids, done = None, [], []

    def out() -> pa.RecordBatch:
        end, first, n, text = zip(*done) if done else ((), (), (), ())
        return pa.record_batch({"end": pa.array(end, pa.binary()), "c": pa.array(first, pa.int64()), "n": pa.array(n, pa.int64()),
                                "ids": pa.array(text, pa.binary())})

    for batch in batches:
        for end, c in zip(batch.column("end").to_pylist(), batch.column("c").to_pylist()):
            if ids and (end != now or len(ids) == IDS):
                done.append((now, ids[0], len(ids), ",".join(map(str, ids)).encode()))
                ids = []
            now = end
            ids.append(c)
        if len(done) > ROWS:
            yield out()
            done = []
    if ids:
        done.append((now, ids[0], len(ids), ",".join(map(str, ids)).encode()))
    yield out()


def _hashed_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(smallest id, members, SHA-256) of each end, fed block by block, so that a large end is never held."""
    now, first, n, sha, done = None, None, 0, None, []

    def out() -> pa.RecordBatch:
        c, count, text = zip(*done) if done else ((), (), ())
        return pa.record_batch({"c": pa.array(c, pa.int64()), "n": pa.array(count, pa.int64()), "sha": pa.array(text, pa.string())})

    for batch in batches:
        for end, c, count, ids in zip(*(batch.column(x).to_pylist() for x in ("end", "c", "n", "ids"))):
            if end != now:
                if now is not None:
                    done.append((first, n, sha.hexdigest()))
                now, first, n, sha = end, c, 0, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(ids)
            n += count
        if len(done) > ROWS:
            yield out()
            done = []
    if now is not None:
        done.append((first, n, sha.hexdigest()))
    yield out()


def members(sequences: DataFrame) -> DataFrame:
    """(c, n, sha) of each distinct sequence: its smallest conversation, its members, the digest of their ids.

    A digest reads its ids in order, so that last step is one task for an end however many members it has; it
    gets them in blocks, joined where the range shuffle has dealt them.
    """
    blocks = (sequences.select("end", "c").repartitionByRange("end", "c").sortWithinPartitions("end", "c")
              .mapInArrow(_joined_batches, "end binary, c bigint, n bigint, ids binary"))
    return blocks.repartition("end").sortWithinPartitions("end", "c").mapInArrow(_hashed_batches, "c bigint, n bigint, sha string")


# Shards and spines

NODE = ("kind int, shard int, seq int, id binary, parent_id binary, parent bigint, depth bigint, words bigint, n bigint, "
        "first bigint, kids bigint, leaves bigint, saved bigint, sha string")
COLUMNS = [x.split(" ")[0] for x in NODE.split(", ")]
TYPES = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "string": pa.string()}
ARROW = pa.schema([(x.split(" ")[0], TYPES[x.split(" ")[1]]) for x in NODE.split(", ")])
DONE, OPEN = 0, 1


class Node:
    """A node on a spine: what is known of its members and of its finished children."""

    __slots__ = ("id", "parent_id", "depth", "words", "n", "first", "kids", "leaves", "saved", "sha", "kept")

    def __init__(self, id, parent_id, depth, words, n, first, kids, leaves, saved, sha) -> None:
        self.id, self.parent_id, self.depth, self.words, self.n = id, parent_id, depth, words, n
        self.first, self.kids, self.leaves, self.saved, self.sha, self.kept = first, kids, leaves, saved, sha, False

    def add(self, other: "Node") -> None:
        """The same node, as another shard knows it."""
        self.n, self.first, self.kids = self.n + other.n, min(self.first, other.first), self.kids + other.kids
        self.leaves, self.saved, self.sha = self.leaves + other.leaves, self.saved + other.saved, self.sha or other.sha

    def take(self, child: "Node") -> None:
        self.n, self.first, self.kids = self.n + child.n, min(self.first, child.first), self.kids + 1
        self.leaves, self.saved = self.leaves + child.leaves, self.saved + child.saved

    def row(self, kind: int, shard: int, seq: int) -> tuple:
        return (kind, shard, seq, self.id, self.parent_id, None, self.depth, self.words, self.n, self.first, self.kids,
                self.leaves, self.saved, self.sha)


class Merger:
    """Merges spines that come in trie order; a node is finished once the path has left it.

    Unless this is the last round, the path of the first sequence stays open, as earlier shards can share it.
    """

    def __init__(self, last: bool) -> None:
        self.last, self.path, self.kept, self.fresh = last, [], [], True

    def add(self, node: Node) -> Iterator[Node]:
        if self.fresh and self.path and node.depth <= self.path[-1].depth:
            self.fresh = False
        d = node.depth
        if d < len(self.path) and self.path[d].id == node.id:
            self.path[d].add(node)
            return
        yield from self._leave(d)
        if self.fresh and not self.last:
            node.kept = True
            self.kept.append(node)
        self.path.append(node)

    def _leave(self, depth: int) -> Iterator[Node]:
        while len(self.path) > depth:
            node = self.path.pop()
            if node.kept:
                continue
            node.leaves = node.leaves or 1
            node.saved += (node.n - 1) * node.words
            if self.path:
                self.path[-1].take(node)
            yield node

    def end(self) -> tuple[list[Node], list[Node]]:
        """(finished, open) nodes; the open ones in trie order."""
        if self.last:
            return list(self._leave(0)), []
        return [], self.kept + [x for x in self.path if not x.kept]


def _table(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(ARROW), ARROW.types)], schema=ARROW)


def _path_ids(key: bytes) -> list[bytes]:
    """The node ids on the path of a sequence: the digest of each of its prefixes."""
    md5 = hashlib.md5()
    ids = [md5.digest()]
    for d in range(0, len(key), DIGEST):
        md5.update(key[d:d + DIGEST])
        ids.append(md5.digest())
    return ids


class Shard:
    """Sorted distinct sequences until they have some ``SHARD_NODES`` nodes."""

    def __init__(self) -> None:
        self.depth, self.words, self.parent, self.n, self.first, self.sha = [0], [0], [-1], [0], [NONE], [None]
        self.path, self.key, self.lead, self.first_path = [0], None, None, None

    def add(self, c: int, key: bytes, words: bytes, n: int, sha: str) -> None:
        said, size, same = np.frombuffer(words, "<i4"), len(key) // DIGEST, 0
        if self.key is not None:
            most = min(len(self.key), len(key)) // DIGEST
            while same < most and self.key[DIGEST * same:DIGEST * same + DIGEST] == key[DIGEST * same:DIGEST * same + DIGEST]:
                same += 1
        del self.path[same + 1:]
        for d in range(same, size):
            self.parent.append(self.path[-1])
            self.path.append(len(self.depth))
            self.depth.append(d + 1)
            self.words.append(int(said[d]))
            self.n.append(0)
            self.first.append(NONE)
            self.sha.append(None)
        at = self.path[-1]
        self.n[at], self.first[at], self.sha[at] = n, c, sha
        self.key = key
        if self.lead is None:
            self.lead, self.first_path = key, list(self.path)

    def solve(self, shard: int) -> tuple[pa.RecordBatch, list[Node]]:
        """The finished nodes as rows, and the nodes of the two outer paths in trie order."""
        depth, words, parent = np.array(self.depth), np.array(self.words), np.array(self.parent)
        own_n, own_first = np.array(self.n), np.array(self.first)
        size = len(depth)
        end, leaf = Parens(depth).ends()
        at = np.arange(size)

        def within(values: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(values)])
            return total[end] - total[at]

        n, leaves, first = within(own_n), within(leaf), range_min(own_first, at, end)
        kids = np.bincount(parent[1:], minlength=size)
        spine = np.zeros(size, bool)
        spine[self.first_path] = spine[self.path] = True
        saved = within((n - 1) * words)  # of spine nodes this is not used
        ids = dict(zip(self.first_path, _path_ids(self.lead))) | dict(zip(self.path, _path_ids(self.key)))

        inner = np.flatnonzero(~spine)
        hangs = spine[parent[inner]]
        no = lambda t: pa.nulls(len(inner), t)
        full = lambda x: pa.array(np.full(len(inner), x), pa.int32())
        done = pa.RecordBatch.from_arrays([
            full(DONE), full(shard), full(0), no(pa.binary()),
            pa.array([ids[p] if h else None for p, h in zip(parent[inner].tolist(), hangs.tolist())], pa.binary()),
            pa.array(first[parent[inner]], pa.int64(), mask=hangs), *(pa.array(x[inner], pa.int64()) for x in (depth, words, n, first, kids, leaves, saved)),
            pa.array([self.sha[i] for i in inner.tolist()], pa.string())], schema=ARROW)

        under = inner[hangs]
        to = parent[under]
        part_n, part_first = own_n.copy(), own_first.copy()
        part_kids, part_leaves, part_saved = (np.zeros(size, np.int64) for _ in range(3))
        np.add.at(part_n, to, n[under])
        np.minimum.at(part_first, to, first[under])
        np.add.at(part_kids, to, 1)
        np.add.at(part_leaves, to, leaves[under])
        np.add.at(part_saved, to, saved[under])
        nodes = [Node(ids[i], ids[self.parent[i]] if i else None, self.depth[i], self.words[i], int(part_n[i]), int(part_first[i]),
                      int(part_kids[i]), int(part_leaves[i]), int(part_saved[i]), self.sha[i])
                 for i in np.flatnonzero(spine).tolist()]
        return done, nodes


def _shard_batches(batches: Iterator[pa.RecordBatch], nodes: int) -> Iterator[pa.RecordBatch]:
    number, merger = TaskContext.get().partitionId(), Merger(False)
    now = Shard()

    def solved(shard: Shard) -> Iterator[pa.RecordBatch]:
        done, spine = shard.solve(number)
        yield done
        left = [x.row(DONE, number, 0) for node in spine for x in merger.add(node)]
        if left:
            yield _table(left)

    for batch in batches:
        for row in zip(*(batch.column(x).to_pylist() for x in ("c", "key", "words", "n", "sha"))):
            now.add(*row)
            if len(now.depth) >= nodes:
                yield from solved(now)
                now = Shard()
    if now.key is not None:
        yield from solved(now)
    yield _table([x.row(OPEN, number, k) for k, x in enumerate(merger.end()[1])])


def _spine_batches(batches: Iterator[pa.RecordBatch], fan: int, last: bool) -> Iterator[pa.RecordBatch]:
    """Merges the spines of ``fan`` neighbouring shards into those of one."""
    group, merger, rows = None, None, []

    def close() -> Iterator[tuple]:
        done, left = merger.end()
        yield from (x.row(DONE, group, 0) for x in done)
        yield from (x.row(OPEN, group, k) for k, x in enumerate(left))

    fields = ("shard", "id", "parent_id", "depth", "words", "n", "first", "kids", "leaves", "saved", "sha")
    for batch in batches:
        for shard, *values in zip(*(batch.column(x).to_pylist() for x in fields)):
            if shard // fan != group:
                if merger is not None:
                    rows += close()
                group, merger = shard // fan, Merger(last)
            rows += (x.row(DONE, group, 0) for x in merger.add(Node(*values)))
        if len(rows) > ROWS:
            yield _table(rows)
            rows = []
    if merger is not None:
        rows += close()
    yield _table(rows)


def conversation_trie(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                      family: int | None = None, most: int = 4, nodes: int = SHARD_NODES, fan: int = FAN) -> DataFrame:
    """One row for each distinct opening (node): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.

    Turns are ordered by ``turn`` (null first), ties by role and then by digest of the text, so repeated rows are
    turns of their own and the result does not depend on row order. A null role or text is empty; rows without
    ``conv`` are left out, as no member could be named; other columns are not read. An empty table gives no rows.
    With ``family`` every conversation takes over the first h turns of the first conversation of its family (its id
    less the remainder by ``family``) in place of its own first h, where h is the id's checksum modulo ``most``.

    Only digests and word counts of turns are shuffled, never texts. Copies are one sequence with a count. A hot
    opening is spread over the shards by range (of the first ``LEAD_TURNS`` turns). A task holds one conversation
    (20 bytes a turn) and about ``nodes`` nodes at a time.
    """
    ship_package()
    rows = digests(conversations, conv, turn, role, text)
    rows = rows.withColumn("src", F.lit(1)) if family is None else _with_openings(rows, family, most)
    dealt = rows.repartition("c").sortWithinPartitions("c", "src", "turn", "role", "digest")
    skip = 0 if family is None else most
    sequences = store(dealt.select("c", "src", "digest", "words").mapInArrow(
        lambda batches: _sequence_batches(batches, skip), "c bigint, key binary, words binary, end binary"), "sequences")
    distinct = store(sequences.select("c", "key", "words").join(members(sequences), "c"), "distinct")
    tasks = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = (distinct.withColumn("lead", F.substring("key", 1, DIGEST * LEAD_TURNS)).repartitionByRange(tasks, "lead")
              .sortWithinPartitions("key").select("c", "key", "words", "n", "sha"))
    steps = [store(ranged.mapInArrow(lambda batches: _shard_batches(batches, nodes), NODE), "shards")]
    top = steps[0].filter(F.col("kind") == OPEN).agg(F.max("shard")).first()[0]
    while top is not None:
        last = top < fan
        spines = (steps[-1].filter(F.col("kind") == OPEN).withColumn("group", F.floor(F.col("shard") / fan))
                  .repartition("group").sortWithinPartitions("group", "shard", "seq").drop("group"))
        steps.append(store(spines.mapInArrow(lambda batches, end=last: _spine_batches(batches, fan, end), NODE), "spines"))
        top = None if last else top // fan
    done = steps[0]
    for step in steps[1:]:
        done = done.unionByName(step)
    done = done.filter(F.col("kind") == DONE)
    spine = done.filter("id is not null").select(F.col("id").alias("parent_id"), F.col("first").alias("above"))
    known = done.filter("parent_id is null").withColumn("above", F.col("parent"))
    under = join_dimension(done.filter("parent_id is not null"), spine, ["parent_id"], "inner")
    both = known.unionByName(under)
    return both.select(F.col("first").alias("conv_id"), "depth", F.col("above").alias("parent_conv_id"), F.col("n").alias("n_convs"),
                       F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
                       F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
