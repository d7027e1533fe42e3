"""Each operator against a brute-force version, and on nulls, empty and long texts, repeats and clashing columns."""

import hashlib
import itertools
import math
import os
import random
import re
import string

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tidewire.llm import (decontaminate, embeddings, lattice, paragraphs, passages, pii, quality, secrets, simhash, toxicity,
                          urlfilter)

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, id bigint, spans string, component int"


def docs_of(frame, rows):
    """Documents with further columns whose names the operators use themselves."""
    return frame([(i, t, "en", "s", None, 7, "x", 1) for i, t in rows], DOCS)


def components_of(ids, links):
    """Smallest id reachable for each id."""
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "of", "the", "omega", "nu", "rho", "tau"]) for _ in range(n))


# SimHash

def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("crowded", [2048, 3])
def test_simhash_components(frame, crowded):
    rng = random.Random(3)
    base = words(rng, 120)
    texts = [None, "", " \t\n", "One", "one", "É x", base, base, base + " z", base.upper(), words(rng, 70_000)]
    for _ in range(25):
        w = base.split()
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(3, "")]
    got = simhash.simhash_components(docs_of(frame, rows), crowded=crowded).collect()
    prints = {i: plain_fingerprint(t) for i, t in rows}
    links = [(a, b) for a, b in itertools.combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 3]
    expected = components_of(prints, links)
    assert len(got) == len(rows)
    assert {(r.id, r.fp % (1 << 64), r.component) for r in got} == {(i, prints[i], expected[i]) for i in prints}
    assert len(set(expected.values())) < len(expected) - 5


def test_crowded_buckets_link_the_same(frame):
    rng = np.random.default_rng(5)
    base = np.uint64(rng.integers(1 << 62))
    prints = [base]
    for _ in range(150):
        flips = rng.choice(32, rng.integers(0, 4), replace=False)
        prints.append(prints[rng.integers(len(prints))] ^ np.bitwise_or.reduce(np.uint64(1) << flips.astype(np.uint64), initial=np.uint64(0)))
    prints, reps = np.unique(np.array(prints)), np.arange(1000)
    reps = reps[:len(prints)]
    key = simhash.EXACT << 32  # all agree in the high segment
    found = [components_of(reps.tolist(), [(int(a), int(b)) for x, y in simhash.bucket_links(key, prints, reps, 3, crowded)
                                           for a, b in zip(x, y)]) for crowded in (1, 10_000)]
    brute = [(int(a), int(b)) for a, b in itertools.combinations(reps, 2) if int(prints[a] ^ prints[b]).bit_count() <= 3]
    assert found[0] == found[1] == components_of(reps.tolist(), brute)


def test_empty_tables(frame, spark):
    none = docs_of(frame, [])
    assert simhash.simhash_components(none).count() == 0
    assert paragraphs.repeated_paragraphs(none).count() == 0
    assert secrets.find_secrets(none).count() == 0 and pii.find_pii(none).count() == 0
    assert lattice.encode_texts(none).count() == 0
    bench = frame([], "item_id bigint, text string")
    assert decontaminate.contaminated(none, bench).count() == 0
    assert decontaminate.contaminated(docs_of(frame, [(1, "a b c")]), bench).count() == 0
    assert embeddings.near_duplicates(frame([], "vec_id bigint, embedding array<float>")).count() == 0
    labels = frame([], "doc_id bigint, quality int, toxic int")
    assert [r.score for r in quality.score_quality(docs_of(frame, [(1, "x"), (2, None)]), quality.train(none, labels)).collect()] == [0.5, 0.5]
    model = toxicity.train(none, labels)
    assert [r.predicted for r in toxicity.score_toxicity(docs_of(frame, [(1, "you stupid 1d10t, you moron"), (2, None)]), model).orderBy("id").collect()] == [1, 0]
    pages = frame([], "page_id bigint, url string")
    assert urlfilter.judge_urls(pages, [("block", "net", "/")], frame([], "host string")).count() == 0


# Paragraphs

@pytest.mark.parametrize("small, block", [(32, 4096), (2, 3)])
def test_repeated_paragraphs(frame, small, block):
    rng = random.Random(8)
    passage = [rng.choice(string.ascii_lowercase) + str(rng.randrange(500)) for _ in range(60)]
    rows = [(1, None), (2, ""), (3, "short\n" + " ".join(passage)), (4, " ".join(passage) + "\nshort"), (4, "short")]
    for i in range(5, 25):
        w = list(passage)
        for _ in range(rng.randrange(3)):
            w[rng.randrange(60)] = "edit"
        rows.append((i, "other\n" + " ".join(w).title() + "\n" + " ".join(rng.choice(string.ascii_lowercase) + str(rng.randrange(500)) for _ in range(50))))
    known, lines = paragraphs.Words(), []
    for i, t in rows:
        lines += [((i, n), set(paragraphs.shingles(w, known).tolist())) for n, _, _, w in paragraphs.paragraphs(t or "", 40)]
    links = [(a, b) for (a, x), (b, y) in itertools.combinations(lines, 2) if len(x & y) >= 0.8 * len(x | y)]
    named = components_of([a for a, _ in lines], links)
    many = {a: c for a, c in named.items() if list(named.values()).count(c) > 1}
    got = paragraphs.repeated_paragraphs(docs_of(frame, rows), small=small, block=block).collect()
    assert {((r.id, r.number), (r.class_id, r.class_number)) for r in got} == set(many.items())
    assert all(r.removed == ((r.id, r.number) != (r.class_id, r.class_number)) for r in got)
    first = next(r for r in got if r.id == 3)
    assert rows[2][1][first.start:first.end] == " ".join(passage)


def test_crowded_bands_are_passed_on_without_being_held():
    import pyarrow as pa

    told, ends = 0, 0

    def batches():
        for n in range(50):
            # A bucket told only at its end would have yielded nothing yet.
            assert told >= 100 * max(0, n - 1)
            h = [xxhash.xxh3_128_digest(b"%d" % (100 * n + k)) for k in range(100)]
            yield pa.record_batch({"key": pa.array([7] * 100, pa.int64()), "part": pa.array([-1] * 100, pa.int32()), "h": pa.array(h, pa.binary())})

    for out in paragraphs._pairs(batches(), 32):
        told += out.num_rows - out.column("key").null_count
        ends += out.column("key").null_count
    assert told == 5000 and ends == 8 * 5000 - 36


def test_repeated_passages_equal_brute_force(frame):
    rng = random.Random(4)

    def fresh(n):
        return [f"W{rng.randrange(10 ** 9)}" for _ in range(n)]

    a, b, short = fresh(75), fresh(50), fresh(49)
    rows = [(1, None), (2, " ".join(fresh(60) + a + fresh(9))), (3, " ".join(fresh(5) + short + fresh(60))), (3, "one\n" + " ".join(fresh(10) + b)),
            (4, "two words\n" + "\n".join(" ".join(a[k:k + 7]).lower() for k in range(0, 75, 7)) + "\n" + " ".join(fresh(40))),
            (5, ". ".join(fresh(200) + b + fresh(30) + a[:60] + fresh(20) + a[10:] + fresh(3))), (6, " ".join(short)), (7, "ha " * 120),
            (8, "İx " + " ".join(b)), (9, "ha\n" * 130 + " ".join(a))]
    rows += [(10, rows[4][1]), (11, rows[4][1])]
    got = passages.repeated_passages(docs_of(frame, rows)).collect()

    seen, expected = {}, set()
    for n, (i, t) in enumerate(rows):
        w = [m[0].lower() for m in re.finditer(r"\w+", t or "")]
        for p in range(len(w) - 49):
            seen.setdefault(tuple(w[p:p + 50]), []).append((i, n, p))
    for places in seen.values():
        i, n, p = min(places)
        expected |= {(x[0], k) for x in places if x[1] != n or x[2] - p >= 50 for k in range(x[2], x[2] + 50)}
    texts = {i: t for i, t in rows if i != 3}
    texts[3] = rows[3][1]  # the row of the repeated id with a passage
    covered = set()
    for r in got:
        spans = [m.span() for m in re.finditer(r"\w+", texts[r.id])]
        inside = [k for k, (s, e) in enumerate(spans) if r.start <= s and e <= r.end]
        assert spans[inside[0]][0] == r.start and spans[inside[-1]][1] == r.end and len(inside) == r.words >= 50
        assert texts[r.id].count("\n", 0, r.start) == r.number
        if r.removed:
            covered |= {(r.id, k) for k in inside}
    assert covered == expected and {i for i, _ in covered} == {4, 5, 7, 8, 9, 10, 11}
    assert {(r.class_id, r.class_number, r.words) for r in got if r.id == 4 and r.removed} == {(2, 0, 75)}
    assert passages.repeated_passages(docs_of(frame, [])).count() == 0


# Secrets and personal data

def plain_secrets(t):
    rules = [("assign", r"""(?ai:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", lambda m: len(m[2]) >= 12),
             ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18), ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 16)]
    found = sorted((m.start(), n, m.end()) for n, (_, p, ok) in enumerate(rules) for m in re.finditer(p, t) if ok(m))
    return ",".join(f"{rules[n][0]}:{s}:{e}" for s, n, e in found)


def plain_pii(t):
    def digits(m):
        return re.sub("[^0-9]", "", m[0])

    def card(m):
        d = digits(m)[::-1]
        return 16 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 * (int(c) > 4)) for i, c in enumerate(d)) % 10 == 0

    rules = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
             ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x[-4:]) <= 255 and not x[:-3].strip("0") for x in m[0].split("."))),
             ("card", r"[0-9]([\x20-]?[0-9])+", card), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15)]
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p, ok in rules for m in re.finditer(p, t) if ok(m))


def noisy_texts():
    rng = random.Random(1)
    letters = "0123456789" * 2 + ".@+-() a.bAKIAtoken:= \"'deF0é\n"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 120))) for _ in range(1500)]
    return texts + [None, "", "paſſword=abcdefghijklmnop", "api_KEY: 'abcdefghijkl'", "AKIA" + "Z9" * 8, "0" * 5000,
                    "1" * 6_000 + ".2.3.4", "a@b." * 3000 + "c", "4111 1111-1111 1111", "x " * 100_000 + " +1 (017) 555-7713"]


def test_secrets_equal_the_regular_expressions(frame):
    rows = list(enumerate(noisy_texts()))
    got = {r.id: r for r in secrets.find_secrets(docs_of(frame, rows)).collect()}
    assert {i: r.base for i, r in got.items()} == {i: plain_secrets(t or "") for i, t in rows}
    assert secrets.base_digest("") == hashlib.sha256(b"").hexdigest()


def test_trigram_queries_are_necessary():
    assert secrets.trigram_query("[0-9a-f]+") is secrets.ANY and secrets.trigram_query("a?b") is secrets.ANY
    assert secrets.trigram_query("abcd") == ("and", ["abc", "bcd"])
    shard = secrets.Shard(["x TOKEN", "tok", "ghp_", ""])
    assert shard.candidates(secrets.trigram_query("token|ghp_")) == {0, 2}
    added = {"forge": "ghp_" + "a1" * 18, "maps": "AIza" + "b" * 35, "key": "-----BEGIN RSA PRIVATE KEY-----"}
    for rule in secrets.ADDED:
        if rule.kind in added:
            assert secrets.Shard([added[rule.kind]]).candidates(secrets.trigram_query(rule.pattern)) == {0}
            assert rule.compiled().search(added[rule.kind])


def test_pii_equals_the_regular_expressions(frame):
    rows = list(enumerate(noisy_texts()))
    got = {r.id: r for r in pii.find_pii(docs_of(frame, rows), masked=True).collect()}
    assert {i: r.base for i, r in got.items()} == {i: plain_pii(t or "") for i, t in rows}
    assert got[len(rows) - 1].masked.endswith(" [PHONE]") and got[1500].masked == ""


def test_added_kinds_and_masking():
    text = "IBAN DE89 3704 0044 0532 0130 00, https://bob:pw1@h.io/ Account no. 123456789"
    kinds = {k: text[s:e] for k, s, e in pii.Finder().spans(text)}
    assert kinds["iban"] == "DE89 3704 0044 0532 0130 00" and kinds["account"] == "123456789" and kinds["login"] == "https://bob:pw1@"
    assert "pw1" not in pii.mask(text, pii.Finder().spans(text)) and "123456789" not in pii.mask(text, pii.Finder().spans(text))


# Embeddings

@pytest.mark.parametrize("block", [2048, 16])
def test_near_duplicate_vectors(frame, block):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 16))
    x[100:300] = x[:200] + 0.15 * rng.normal(size=(200, 16))
    x[300:360] = x[0] + 0.2 * rng.normal(size=(60, 16))
    x[360:380] = x[1]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [None] + [1.0] * 15, [float("inf")] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0], [1e30] * 16]
    rows = [(i, v.astype(np.float32).tolist(), "a") for i, v in enumerate(x)] + [(2000 + i, v, "a") for i, v in enumerate(odd)]
    got = {r.id: r for r in embeddings.near_duplicates(frame(rows, "vec_id bigint, embedding array<float>, id string"), block=block, per_cell=16).collect()}
    y = np.array([v for _, v, _ in rows[:900]])
    y /= np.linalg.norm(y, axis=1)[:, None]
    links = [(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(y @ y.T >= 0.9, 1)))]
    count = np.bincount(np.array(links).ravel(), minlength=900)
    assert sum(got[i].n_links for i in range(900)) >= 0.97 * count.sum()
    assert all(got[i].n_links <= count[i] for i in range(900))
    assert all(got[i].n_links == count[i] and got[i].component == 1 for i in range(360, 380))
    assert len(got) == len(rows) and all(got[2000 + i].n_links == 0 and got[2000 + i].component == 2000 + i for i in (0, 1, 2, 3, 4, 5))
    assert got[2007].component == 2006 and got[2007].n_links == 1


def test_nearest_cells_are_the_nearest():
    rng = np.random.default_rng(4)
    books, x = (rng.normal(size=(5, 3)), rng.normal(size=(4, 3))), rng.normal(size=(7, 6))
    d = embeddings.half_distances(x[:, :3], books[0])[:, :, None] + embeddings.half_distances(x[:, 3:], books[1])[:, None, :]
    assert (embeddings.nearest_cells(x, books, 9) == np.argsort(d.reshape(7, -1), axis=1, kind="stable")[:, :9]).all()


# URLs

@pytest.mark.parametrize("max_bits", [1 << 22, 64])
def test_urls(frame, max_bits):
    rules = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/x/")]
    listed = ["bad.example.org", "pills.com", "a.b.c.d", None, ""] + [f"h{i}.io" for i in range(40)]
    hosts = ["A.Example.NET", "net", "x.net:80", "example.com", "www.example.com", "www.bad.example.org", "example.org", "h3.io", "x.h4.io", "h99.io", "b.c.d"]
    paths = ["", "/", "/en", "/en/", "/en/1?q=/de/", "/de/#x", "/fr/x/y", "/fr//x/", "/DE/", "?a", "#/en/"]
    urls = [None, "", "no scheme", "://", "http:///en/", "://net/x://y"] + [f"https://{h}{p}" for h in hosts for p in paths] + ["http://net/" + "a/" * 20_000]
    rows = [(i, u, "r", "v") for i, u in enumerate(urls + urls[:3])]
    got = urlfilter.judge_urls(frame(rows, "page_id bigint, url string, rule string, host string"), rules, frame([(h,) for h in listed], "host string"), max_bits=max_bits).collect()

    def judge(u):
        host = path = ""
        if u and "://" in u:
            m = re.match(r"([^/?#]*)([^?#]*)", u.split("://", 1)[1])
            host, path = m[1].lower(), m[2]
        fit = [(h + p, k) for k, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        if fit:
            return host, path, *max(fit, key=lambda f: len(f[0]))
        return host, path, None, "block" if any(h and (host == h or host.endswith("." + h)) for h in listed) else "allow"

    assert {(r.id, r.host, r.path, r.rule, r.verdict) for r in got} == {(i, *judge(u)) for i, u, *_ in rows} and len(got) == len(rows)


# SentencePiece

def plain_n_best(p, text, n):
    out = []

    def go(i, score, ids):
        if i == len(text):
            out.append((score, ids))
            return
        if text[i] not in p.score:
            raw = text[i].encode()
            go(i + 1, score + p.byte_score * len(raw), ids + [p.byte_ids[b] for b in raw])
        for j in range(i + 1, len(text) + 1):
            if text[i:j] in p.score:
                go(j, score + p.score[text[i:j]][0], ids + list(p.score[text[i:j]][1]))

    go(0, 0.0, [])
    return sorted(out, key=lambda x: -x[0])[:n]


def test_n_best_segmentations(frame):
    with open(lattice.MODEL, "rb") as file:
        p = lattice.Pieces(file.read())
    texts = ["the cat", "a  b", "éa\n ▁x", "to be or", "日本 ok", " ", "Theand.!!", "x\ty", "😀", "12,5", "a" * 12]
    for n in (1, 3, 6):
        for t in texts:
            ids, best = p.encode(t, n)
            brute = plain_n_best(p, " " + t, n)
            assert np.allclose([s for s, _ in best], [s for s, _ in brute]), t
            cuts = [tuple(lattice.apply_changes(ids.tolist(), c)) for _, c in best]
            assert len(set(cuts)) == len(cuts) and all(p.decode(c) == t for c in cuts)
    rows = [(i, t) for i, t in enumerate([None, "", *texts, "w" * 50_000, "the and " * 20_000])] + [(0, "the cat")]
    encoded = lattice.encode_texts(docs_of(frame, rows))
    assert all(r.exact for r in encoded.collect()) and encoded.count() == len(rows)
    back = sorted((r.id, r.text) for r in lattice.decode_ids(encoded).collect())
    assert back == sorted((i, t or "") for i, t in rows)


# Decontamination

def test_masks_hit_every_tolerated_overlap():
    for length in range(10, 22):
        masks = [sum(1 << (o + i) for i in m) for m in decontaminate.MASKS for o in range(length - m[-1])]
        for lost in itertools.combinations(range(length), length - math.ceil(0.8 * length)):
            gone = sum(1 << i for i in lost)
            assert any(not m & gone for m in masks)


def test_contamination_equals_all_alignments(frame):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(1, None), (2, ""), (3, "w1 w2 w3"), (4, " ".join(rng.choices(vocabulary, k=7))), (5, " ".join(rng.choices(vocabulary, k=12))),
             (6, " ".join(rng.choices(vocabulary, k=60))), (6, "w9 w9 w9 w9 w9")]
    rows = [(0, None), (1, "")]
    for i in range(2, 60):
        text = rng.choices(vocabulary, k=30)
        _, item = items[rng.randrange(2, 7)]
        part = item.split()
        if len(part) > 40:
            part = part[10:10 + rng.randint(20, 40)]
        part = [rng.choice(vocabulary) if rng.random() < 0.12 else w for w in part]
        at = rng.randrange(30)
        rows.append((i, ", ".join(text[:at] + [w.upper() for w in part] + text[at:])))

    def overlap(text, item):
        t, w = (text or "").lower().split(", "), (item or "").split()
        if not w or not text:
            return False
        n = min(len(w), 25)
        need = math.ceil(0.8 * n - 1e-9)
        return any(sum(0 <= d + k < len(t) and t[d + k] == w[k] for k in range(s, s + n)) >= need
                   for d in range(-len(w), len(t)) for s in range(len(w) - n + 1))

    expected = {(i, k) for i, t in rows for k, item in items if overlap(t, item)}
    for size in (4_000_000, 100):
        got = decontaminate.contaminated(docs_of(frame, rows), frame(items, "item_id bigint, text string"), block_chars=size).collect()
        assert {(r.id, r.item_id) for r in got} == expected
    assert len(expected) > 20


def test_contamination_of_the_middle_of_an_item_and_of_a_changed_first_token(frame):
    item = [f"i{k}" for k in range(59)]
    short = [f"s{k}" for k in range(7)]
    other = [" ".join(f"o{n}x{k}" for k in range(100)) for n in range(3)]
    rows = [(0, " ".join(short[1:])), (1, other[0]), (2, " ".join(item[15:45])), (3, other[1]), (4, " ".join(["unseen", *short[1:], "z"])),
            (5, " ".join(item[1:30])), (6, " ".join(item[30:58])), (7, other[2]), (8, " ".join(short[:6]))]
    got = decontaminate.contaminated(docs_of(frame, rows).coalesce(1), frame([(1, " ".join(item)), (2, " ".join(short))], "item_id bigint, text string"))
    assert {(r.id, r.item_id) for r in got.collect()} == {(2, 1), (5, 1), (6, 1), (0, 2), (4, 2), (8, 2)}


# Classifiers

def test_folding():
    assert toxicity.fold("  An 1D10T, сlоwn!!") == toxicity.fold("an idiot clown")
    assert toxicity.fold("") == "  " and toxicity.fold("$$$ 100%") == "  "
    matcher = toxicity._Matcher((("trash", 2.0),), ("trash can",))
    assert matcher.features("the trash can")[0] == 0 and matcher.features("trash, the trash can")[0] == pytest.approx(np.log1p(2.0))


def test_held_out_accuracy(spark):
    import zlib
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    told = {r.doc_id: r for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1}
    few = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    for field, scored in (("toxic", toxicity.score_toxicity(few, toxicity.train(docs, labels))),
                          ("quality", quality.score_quality(few, quality.train(docs, labels)))):
        pairs = [(r.predicted, told[r.id][field]) for r in scored.collect() if r.id in told]
        assert sum(p == y for p, y in pairs) > 0.985 * len(pairs)
        assert sum(p and y for p, y in pairs) > 0.92 * sum(y for _, y in pairs)


@pytest.mark.parametrize("n, m, unit", [(30_000, 30_000, ["a"]), (20_000, 3_000, ["a", "b"]), (30_000, 30_000, None)])
def test_repetitive_and_long_items_are_compared_in_linear_memory(n, m, unit):
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(0)
    item = (unit * m)[:m] if unit else [f"w{k}" for k in rng.integers(0, 50_000, m)]
    doc = (unit * n)[:n] if unit else item
    seeds = decontaminate.Seeds.of([(1, " ".join(item))])
    texts = [" ".join(doc), "x " + " ".join(doc[:30]), "x y"]
    batch = pa.record_batch({"id": pa.array([5, 6, 7]), "text": pa.array(texts)})
    tracemalloc.start()
    found = [r for b in decontaminate._scan(iter([batch]), type("S", (), {"value": seeds}), 25, 0.8) for r in b.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(r["id"], r["agree"]) for r in found] == [(5, 25), (6, 25)] and found[0]["start"] == 0
    assert peak < 300 << 20


@pytest.mark.parametrize("size", [5, 9, 39])
def test_short_lines_are_found(frame, size):
    rng = random.Random(size)
    line = " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(size))
    rows = [(k, f"head {k}\n{line}\ntail {rng.random()} of {rng.random()}") for k in range(20)]
    got = paragraphs.repeated_paragraphs(docs_of(frame, [*rows, (99, "a b c d"), (98, "a b c d")])).collect()
    assert {(r.id, r.number, r.words, r.class_id, r.removed) for r in got} == {(k, 1, size, 0, k > 0) for k in range(20)}


def test_rows_that_share_an_id_give_one_answer(frame):
    line = [f"w{k}" for k in range(60)]
    near = [*line[:30], "changed", *line[31:]]
    rows = [(1, " ".join(line)), (1, "another text of the same id without any line in common"), (2, " ".join(near))]
    for order in itertools.permutations(rows):
        for parts in (1, 3):
            got = paragraphs.repeated_paragraphs(docs_of(frame, list(order)).repartition(parts)).collect()
            assert sorted((r.id, r.class_id, r.removed) for r in got) == [(1, 1, False), (2, 1, True)]


def test_long_and_repetitive_texts(frame):
    rng = random.Random(6)
    lines = [" ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(rng.randrange(5, 60))) for _ in range(6000)]
    one = " ".join(f"v{rng.randrange(10 ** 6)}" for _ in range(200_000))  # a line of its own
    rows = [(1, "\n".join(lines)), (2, one), (3, "start\n" + lines[4000] + "\n" + one), (4, "la " * 50_000), (5, "LA " * 50_000)]
    got = paragraphs.repeated_paragraphs(docs_of(frame, rows)).collect()
    assert {(r.id, r.number, r.class_id, r.class_number) for r in got} == {(1, 4000, 1, 4000), (3, 1, 1, 4000), (2, 0, 2, 0), (3, 2, 2, 0), (4, 0, 4, 0), (5, 0, 4, 0)}
    spans = passages.repeated_passages(docs_of(frame, rows)).collect()
    assert {(r.id, r.number, r.words) for r in spans if r.removed and r.class_id == 2} == {(3, 2, 200_000)}
    assert {r.id for r in spans if r.removed} >= {3, 4, 5} and 1 not in {r.id for r in spans if r.removed}


def test_scan_equals_the_regular_expression():
    from tidewire.llm import scan

    rng = random.Random(8)
    texts = ["".join(rng.choice("abAB_9é İß\n.,\U0001d504\U0001f600 ") for _ in range(rng.randrange(60))) for _ in range(300)]
    texts += ["", " ", "x" * (3 * scan.PIECE) + " y", ("word " * 70_000) + "\n end"]
    known = {}
    for rows in scan.groups(texts):
        found = scan.Scan([texts[i] for i in rows])
        for d, i in enumerate(rows):
            at = np.flatnonzero(found.doc == d)
            spans = [m.span() for m in re.finditer(r"\w+", texts[i])]
            assert list(zip(found.start[at].tolist(), found.end[at].tolist())) == spans
            assert found.line[at].tolist() == [texts[i].count("\n", 0, s) for s, _ in spans] if len(texts[i]) < 1000 else True
            low = ["".join(c.lower() if len(c.lower()) == 1 else c for c in texts[i][s:e]) for s, e in spans]
            for w, h in zip(low, found.hash[at].tolist()):
                assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)


def test_band_recall_at_the_threshold():
    """Pairs of lines at a similarity of 0.8 to 0.9 share a band nearly always."""
    rng, hits, n = random.Random(3), 0, 0
    while n < 400:
        w = [f"w{rng.randrange(10 ** 6)}" for _ in range(100)]
        v = list(w)
        for _ in range(2):
            v[rng.randrange(100)] = "edit"
        known = paragraphs.Words()
        x, y = (set(paragraphs.shingles(u, known).tolist()) for u in (w, v))
        if 0.8 <= len(x & y) / len(x | y) <= 0.9:
            from tidewire.llm.scan import Scan

            found = Scan([" ".join(w), " ".join(v)])
            _, key = paragraphs.line_digests(found, np.array([0, 100]), np.array([100, 100]))
            hits, n = hits + bool((key[0] == key[1]).any()), n + 1
    assert hits >= 0.96 * n


def test_the_trigram_index_reads_every_text_once():
    reads = []

    class Text(str):
        def encode(self, *a):
            reads.append(1)
            return super().encode(*a)

    rng = random.Random(2)
    queries_ = [secrets.trigram_query(r.pattern) for r in secrets.RULES] + [secrets.trigram_query("éàx"), secrets.trigram_query("ab(cde|fgh)i")]
    texts = ["".join(rng.choice("abcdefghiAKIAtokensecretéàx_-=: ") for _ in range(rng.randrange(200))) for _ in range(400)]
    texts += ["", "ab", "my token = x", "ghp_", "éàx", "abcdei", "xx abfghi", "AKIA", "a" * 3_000_000 + "akia"]
    shard = secrets.Shard([Text(t) for t in texts], secrets.Lexicon(queries_))
    assert len(reads) == len(texts)

    def holds(query, low):
        if query is secrets.ANY:
            return True
        if isinstance(query, str):
            return query in low
        return (all if query[0] == "and" else any)(holds(q, low) for q in query[1])

    for query in queries_:
        if "é" not in str(query):  # there the index may name more documents
            assert shard.candidates(query) == {i for i, t in enumerate(texts) if holds(query, t.lower())}
    assert {i for i, t in enumerate(texts) if "éàx" in t} <= shard.candidates(queries_[-2])
    assert len(reads) == len(texts) and secrets.Shard([], secrets.Lexicon(queries_)).candidates("abc") == set()


def test_repeated_items_are_reported_each(frame):
    words_ = " ".join(f"w{k}" for k in range(20))
    got = decontaminate.contaminated(docs_of(frame, [(1, words_)]), frame([(4, words_), (5, words_), (5, words_), (6, "other")], "item_id bigint, text string"))
    assert sorted(r.item_id for r in got.collect()) == [4, 5]


def test_runs_of_unique_ids_carry_no_hash_of_their_text(frame, monkeypatch):
    run = " ".join(f"w{k}" for k in range(60))
    rows = [(1, f"a {run} b"), (2, f"c {run} d"), (3, f"e {run} f"), (3, f"g h {run}"), (4, "alone")]
    steps, plain = {}, passages.settled
    monkeypatch.setattr(passages, "settled", lambda df, name: steps.setdefault(name, [plain(df, name), None])[0] if name != "runs" else keep(df))

    def keep(df):
        steps["runs"] = plain(df, "runs"), df.select("id", "t").distinct().collect()
        return steps["runs"][0]

    spans = passages.repeated_passages(docs_of(frame, rows)).collect()
    marks = [(r.id, r.t) for r in steps["runs"][1]]
    assert {t for i, t in marks if i != 3} == {0} and len({t for i, t in marks if i == 3} - {0}) == 2
    assert sorted((r.id, r.words, r.class_id, r.removed) for r in spans) == [(1, 60, 1, False), (2, 60, 1, True), (3, 60, 1, True), (3, 60, 1, True)]


def test_small_buckets_of_a_batch_are_paired_at_once():
    rng = random.Random(4)
    rows = [(key, -1, bytes([key // 256, key % 256, k])) for key in range(2000) for k in range(rng.choice([1, 1, 2, 5]))]
    rows += [(2000, part, bytes([9, part, k])) for part in (0, 1) for k in range(1 + part)]
    rows += [(2001, -1, bytes([10, 0, k])) for k in range(40)] + [(2002, -1, b"x"), (2003, -1, b"y"), (2003, -1, b"z")]
    batch = pa.record_batch({"key": pa.array([k for k, *_ in rows], pa.int64()), "part": pa.array([p for _, p, _ in rows], pa.int32()),
                             "h": pa.array([h for *_, h in rows], pa.binary())})
    wanted = {(a, b) for _, same in itertools.groupby(rows[:-43], key=lambda r: r[0] if r[1] < 0 else None) for a, b in
              itertools.combinations([h for _, p, h in same if p < 0], 2)}
    for cut in (1, 7, 1000, len(rows)):
        out = [b.to_pylist() for b in paragraphs._pairs((batch.slice(s, cut) for s in range(0, len(rows), cut)), 32)]
        pairs = [(r["a"], r["b"]) for b in out for r in b if r["key"] is None and r["a"][0] < 9]
        assert len(pairs) == len(set(pairs)) and set(pairs) == wanted
        assert {r["a"] for b in out for r in b if r["key"] is not None} == {h for k, _, h in rows if k in (2000, 2001)}
        assert [(r["a"], r["b"]) for b in out for r in b if r["key"] is None][-1] == (b"y", b"z")
        assert cut < 1000 or len(out) < 20  # not a batch for each bucket


def test_runs_of_many_texts_are_listed_together(monkeypatch):
    rng = random.Random(6)
    texts = [words(rng, n) + f"\n  {i} é " + words(rng, n) for i, n in enumerate([0, 1, 9, 40, 3, 70, 12, 5] * 4)]
    each = [passages.anchors(passages.Scan([t]).hash, 10)[1] for t in texts]
    asked = [np.unique(low[::3]).view(np.int64).tolist() for low in each]
    batch = pa.record_batch({"id": pa.array(range(len(texts))), "t": pa.array([7] * len(texts)), "text": pa.array(texts),
                             "wanted": pa.array(asked, pa.list_(pa.int64()))})
    alone = [r for i in range(len(texts)) for b in passages._runs(iter([batch.slice(i, 1)]), 10) for r in b.to_pylist()]
    scans, plain = [], passages.Scan
    monkeypatch.setattr(passages, "Scan", lambda found: scans.append(found) or plain(found))
    together = [r for b in passages._runs(iter([batch]), 10) for r in b.to_pylist()]
    assert together == alone and len(scans) == 1
    wanted = [(i, p) for i, low in enumerate(each) for p in np.flatnonzero(np.isin(low.view(np.int64), asked[i])).tolist()]
    assert [(r["id"], r["pos"]) for r in together] == wanted
    assert all(texts[r["id"]][r["start"]:r["end"]].split() == texts[r["id"]].split()[r["pos"]:r["pos"] + 10] for r in together)
    assert all(texts[r["id"]][:r["start"]].count("\n") == r["line"] for r in together)


def test_only_the_result_of_paragraphs_stays_stored(frame, monkeypatch):
    steps, plain = [], paragraphs.settled
    monkeypatch.setattr(paragraphs, "settled", lambda df, name: steps.append((name, plain(df, name))) or steps[-1][1])
    line = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen"
    got = paragraphs.repeated_paragraphs(docs_of(frame, [(1, line), (2, f"x\n{line}"), (3, line + " nineteen"), (4, "none of these words is there twice")]))
    left = [name for name, df in steps if os.path.exists(df.stored_at.removeprefix("file:"))]
    assert {"lines", "wanted", "repeated"} <= {name for name, _ in steps} and left == ["paragraphs"]
    assert sorted((r.id, r.number, r.class_id, r.removed) for r in got.collect()) == [(1, 0, 1, False), (2, 1, 1, True), (3, 0, 1, True)]
