"""Spelling variants, the k-means tree and the prefix trie against brute force, and the registered queries against SQL."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from tidewire.llm import prefixtrie, queries, spelling, vectortree

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, word string, n bigint, form string"


# Spelling variants

def plain_variants(rows, least=3):
    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % 97 == 0:
                word = word[:h % len(word)] + word[h % len(word) + 1:]
            count[word] += 1
    n = {w: k for w, k in count.items() if len(w) >= 5 and k >= least}

    def one_edit(a, b):
        if len(a) > len(b):
            a, b = b, a
        k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
        return a != b and (a[k + 1:] == b[k + 1:] if len(a) == len(b) else len(b) == len(a) + 1 and a[k:] == b[k + 1:])

    out = {}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n.get(form[w]))
    return out


@pytest.mark.parametrize("symbols, crowded", [(8, 64), (2, 3), (1, 1)])
def test_spelling_variants(frame, symbols, crowded):
    rng = random.Random(1)
    letters = "abcdeéÿ÷"
    stems = ["".join(rng.choice(letters) for _ in range(rng.randrange(5, 9))) for _ in range(25)]

    def edited(w):
        k = rng.randrange(len(w))
        return rng.choice([w, w, w, w[:k] + w[k + 1:], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1:]])

    rows = [(i, ", ".join(edited(rng.choice(stems)).title() for _ in range(60))) for i in range(40)]
    long = "".join(rng.choice("ab") for _ in range(3000))
    rows += [(90, None), (91, ""), (None, "Straßenbahn Straßenbahn straßenbahn"), (3, rows[3][1]), (92, " ".join([long] * 4 + [long[1:]] * 3))]
    got = spelling.spelling_variants(frame([(i, t, "w", 1, "f") for i, t in rows], DOCS), symbols=symbols, crowded=crowded).collect()
    expected = plain_variants(rows)
    assert len(got) == len(expected) and {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == expected
    assert any(r.form for r in got) and long in expected
    assert spelling.spelling_variants(frame([], DOCS)).count() == 0


def test_reduced_neighbourhood_has_each_form_once():
    rng = random.Random(4)
    of = {ord(c): s for s, c in enumerate("abc", 1)}

    def plain(w):
        edits = {w} | {w[:k] + w[k + 1:] for k in range(len(w))}
        edits |= {w[:k] + c + w[k + 1:] for k in range(len(w)) for c in "abc"}
        return edits | {w[:k] + c + w[k:] for k in range(len(w) + 1) for c in "abc"}

    for size in (2, 3, 7):
        word = "".join(rng.choice("abc") for _ in range(size))
        got = [int(h[0]) for at, h in spelling.Reduced([word], of).neighbours(3) if len(at)]
        assert len(got) == len(set(got))
        assert set(got) == {int(spelling.Reduced([e], of).own()[0]) for e in plain(word)}


def test_roots_of_a_long_chain(frame):
    chain = [(f"w{k}", f"w{k + 1}" if k < 20 else None) for k in range(21)]
    got = spelling.roots(frame(chain, "word string, form string"), 1 << 20).collect()
    assert {r.root for r in got} == {"w20"} and len(got) == 21


# Nearest neighbours

def plain_nearest(rows, every, k):
    usable = [(i, np.array(v, float)) for i, v in rows
              if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for q, x in usable:
        if q % every:
            continue
        for i, y in usable:
            if i != q and len(y) == len(x):
                a, b = x / np.abs(x).max(), y / np.abs(y).max()
                s = float((a * b).sum() / (math.sqrt((a * a).sum()) * math.sqrt((b * b).sum())))
                out.setdefault(q, {})[i] = max(s, out.get(q, {}).get(i, -2))
    return {q: sorted((-round(s, 9), i) for i, s in found.items())[:k] for q, found in out.items()}


def vectors_of(frame, rows, kind="float"):
    return frame([(i, v, 3, "k", 0.5) for i, v in rows], f"vec_id bigint, embedding array<{kind}>, label int, key string, score double")


@pytest.mark.parametrize("kind, shard", [("float", 4096), ("double", 7)])
def test_nearest_with_every_leaf_visited(frame, kind, shard):
    rng = np.random.default_rng(2)
    rows = [(i, rng.integers(-3, 4, 6).astype(float).tolist()) for i in range(400)]
    rows += [(i, [1.0, 2.0, 3.0, 0.0, 0.0, 1.0]) for i in range(400, 560)]  # one large group of copies
    rows += [(i, rows[10][1]) for i in (50, 600, 650)] + [(7, rows[8][1]), (7, rows[8][1])]
    rows += [(700, None), (701, []), (702, [0.0] * 6), (703, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (704, [float("nan")] * 6),
             (None, [1.0] * 6), (705, [float("inf")] * 6), (750, [1.0, 2.0]), (751, [2.0, 1.0]), (-50, [3.0, 4.0, 5.0])]
    got = vectortree.nearest(vectors_of(frame, rows, kind), every=10, recall=2.0, per_leaf=8, shard=shard).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((-round(r.score, 9), r.vec_id))
        assert r.rank == len(found[r.query_id])
    expected = plain_nearest(rows, 10, 5)
    assert found.keys() == expected.keys()
    for q, near in expected.items():
        assert [s for s, _ in found[q]] == [s for s, _ in near]
        cut = near[-1][0]  # among equal scores rounding may part what is a tie on paper
        assert {i for s, i in found[q] if s < cut} == {i for s, i in near if s < cut}
    assert len(found[750]) == 1 and -50 not in found


def test_ties_go_to_the_smaller_id(frame):
    rows = [(i, [1.0, 0.0, 0.5]) for i in range(1, 300)] + [(50 * k, [1.0, 0.0, 0.5]) for k in range(6, 9)]
    got = vectortree.nearest(vectors_of(frame, rows)).collect()
    for q in (50, 100, 300, 350, 400):
        assert [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == [1, 2, 3, 4, 5]
    assert vectortree.nearest(vectors_of(frame, [])).count() == 0
    assert vectortree.nearest(vectors_of(frame, [(50, [1.0]), (51, None)])).count() == 0
    assert vectortree.nearest(vectors_of(frame, [(1, [1.0]), (2, [2.0])])).count() == 0


def test_best_bin_first_order_and_recall(frame):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(60, 16))
    x = np.concatenate([c + 0.2 * rng.normal(size=(60, 16)) for c in centres])
    tree = vectortree.Tree(vectortree._unit(x), 24)
    assert sorted(tree.visit(x[0], tree.leaves)) == list(range(tree.leaves)) and tree.leaves > 100
    assert tree.visit(vectortree._unit(x[:1])[0], 1) == tree.file(vectortree._unit(x[:1])).tolist()
    assert len(tree.visit(x[0], 1, np.ones(tree.leaves, int), 6)) == 6  # goes on until it holds enough
    visits = []
    plain = vectortree.calibrate
    vectortree.calibrate = lambda *a: visits.append(plain(*a)) or visits[-1]
    try:
        rows = [(i, v) for i, v in enumerate(x.tolist())]
        got = vectortree.nearest(vectors_of(frame, rows, "double"), every=20, per_leaf=24).collect()
    finally:
        vectortree.calibrate = plain
    expected = plain_nearest(rows, 20, 5)
    hits = sum(len({r.vec_id for r in got if r.query_id == q} & {i for _, i in near}) for q, near in expected.items())
    assert hits >= 0.95 * 5 * len(expected) and visits[0] < tree.leaves / 2


# Prefix trie

def plain_trie(rows, family=None, most=4):
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            turns.setdefault(c, []).append((turn is not None, turn or 0, role, digest, text))
    turns = {c: [(x[2], x[4]) for x in sorted(t)] for c, t in turns.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % most if family else 0
        lead = turns.get(c - int(math.fmod(c, family)), []) if family else []
        built[c] = lead[:h] + own[h:]
    at = {}
    for c, t in built.items():
        for d in range(len(t) + 1):
            at.setdefault(tuple(t[:d]), []).append(c)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    out = set()
    for path, cs in at.items():
        below = [p for p in at if p[:len(path)] == path]
        kids = [p for p in below if len(p) == len(path) + 1]
        leaves = sum(1 for p in below if not any(len(q) > len(p) and q[:len(p)] == p for q in below))
        saved = sum((len(at[p]) - 1) * words(p[-1][1]) for p in below if p)
        ends = ",".join(str(c) for c in sorted(c for c in cs if len(built[c]) == len(path)))
        out.add((min(cs), len(path), min(at[path[:-1]]) if path else None, len(cs), len(kids), leaves, saved,
                 hashlib.sha256(ends.encode()).hexdigest()))
    return out, len(at)


@pytest.mark.parametrize("nodes, fan, family", [(1 << 15, 64, None), (5, 2, None), (9, 2, 20)])
def test_conversation_trie(frame, nodes, fan, family):
    rng = random.Random(nodes)
    rows = []
    for c in range(-30, 130):
        for turn in range(rng.randrange(1, 6)):
            rows.append((c, turn, rng.choice(["user", "bot", None]), rng.choice(["a b", "c", "", None, "long " * 5])))
    rows += [(200, None, "user", "first"), (200, 1, "user", "x y z"), (200, 1, "bot", "x"), (200, 1, "bot", "x"), (None, 1, "user", "lost"),
             (201, 5, None, None)] + [(300, t, "u", f"turn {t % 7}") for t in range(400)]
    rows += [(c, t, "user", f"same {t}") for c in range(1000, 1150) for t in range(3)]  # one large group of copies
    df = frame([(*r, 1, b"x", 2) for r in rows], "conv_id bigint, turn bigint, role string, text string, n bigint, key binary, c int")
    got = prefixtrie.conversation_trie(df, family=family, nodes=nodes, fan=fan).collect()
    expected, n = plain_trie(rows, family)
    assert len(got) == n and {tuple(r) for r in got} == expected
    assert prefixtrie.conversation_trie(df.limit(0), family=family).count() == 0


def test_findclose_over_many_blocks():
    rng = np.random.default_rng(3)
    for size, most in ((1, 1), (900, 3), (3000, 2000)):
        depth = [0]
        for _ in range(size - 1):
            depth.append(int(rng.integers(max(1, depth[-1] - 40 if rng.random() < 0.02 else depth[-1] - 1), min(depth[-1] + 1, most) + 1)))
        depth = np.array(depth)
        for block in (2, 16, 256):
            end, leaf = prefixtrie.Parens(depth, block).ends()
            plain = [next((j for j in range(i + 1, size) if depth[j] <= depth[i]), size) for i in range(size)]
            assert end.tolist() == plain and leaf.tolist() == [e == i + 1 for i, e in enumerate(plain)]
            values = rng.integers(0, 1000, size)
            assert prefixtrie.range_min(values, np.arange(size), end).tolist() == [values[i:e].min() for i, e in enumerate(plain)]


# The registered queries

@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, cursor = queries.QUERIES[name](spark, SF), con.execute(queries.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect()), key=repr) == sorted((tuple(r[k] for k in order) for r in cursor.fetchall()), key=repr)


def test_neighbour_query_reaches_its_recall(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = queries.op12_neighbours(spark, SF)
    assert dict(got.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"}
    got = got.collect()
    expected = plain_nearest(rows, 50, 5)
    hits = sum(len({r.vec_id for r in got if r.query_id == q} & {i for _, i in near}) for q, near in expected.items())
    assert len(got) == 5 * len(expected) and hits >= 0.9 * len(got)
    exact = {(q, i): s for q, near in expected.items() for s, i in near}
    assert all(abs(r.score + exact[r.query_id, r.vec_id]) < 1e-8 for r in got if (r.query_id, r.vec_id) in exact)
