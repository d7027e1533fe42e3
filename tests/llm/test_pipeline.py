"""The corpus pipeline, stage by stage, against plain versions of what each stage decides."""

import itertools

import corpus_pipeline
from test_operators import components_of, plain_fingerprint, plain_pii

from tidewire.llm import lattice, pii, quality

SF = "/root/testdata/sf0.001"


def test_each_stage_takes_effect(spark):
    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), {}
    columns = docs.columns
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    packer = quality._Packer(model.good, model.bad)
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        docs = stage(spark, docs, SF).checkpoint()
        after = {r.doc_id: r for r in docs.collect()}
        if n < 4:
            assert docs.columns == columns
        if n == 0:
            good = {i for i, r in before.items() if quality.calibrate.predict(
                quality.np.array(model.weights), quality.np.array([packer.features(r.text)]))[0] >= 0.5}
            assert set(after) == good and len(good) > 0.8 * len(before)
        elif n == 1:
            prints = {i: plain_fingerprint(r.text) for i, r in before.items()}
            links = [(a, b) for a, b in itertools.combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 3]
            assert set(after) == set(components_of(prints, links).values())
        elif n == 2:
            assert all(i in after or any(b.split()[0].lower() in r.text.lower() for b in bench) for i, r in before.items())
            assert not any(b in r.text for b in bench for r in after.values())
        elif n == 3:
            assert set(after) == set(before) and not any(plain_pii(r.text) for r in after.values())
            assert all(after[i].text == pii.mask(r.text, pii.Finder().spans(r.text)) for i, r in before.items())
        else:
            assert set(after) == set(before) and all(r.exact and r.n_ids == len(r.ids) for r in after.values())
            texts = {r.id: r.text for r in lattice.decode_ids(docs, "doc_id").collect()}
            assert texts == {i: r.text for i, r in before.items()}
        seen[name] = len(after)
    assert list(seen.values()) == sorted(seen.values(), reverse=True)
    assert corpus_pipeline.run(spark, SF).count() == len(after)


def test_odd_documents(spark, frame):
    rows = [(1, None, "en", "s", None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "a b c", None, None, None), (3, "x " * 40_000, "en", "s", 1)]
    docs = frame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).checkpoint()
        docs.count()
    empty = frame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF).checkpoint()
        assert empty.count() == 0


def test_unique_rows_stay_whatever_their_id(spark, frame):
    """Rows that share an id or have none are told apart by their text; of copies one row stays, the one with the smallest id."""
    texts = [f"{w} stands alone among the others because of its own {w} words and {w} nothing else {w}" for w in ("first", "second", "third", "fourth", "fifth")]
    long = " ".join(f"w{k}" for k in range(400))
    rows = [(7, texts[0]), (7, texts[1]), (None, texts[2]), (None, texts[3]), (9, long), (None, long), (8, long), (8, long), (12, texts[4]), (10, None), (11, "")]
    docs = frame([(i, t, "en", "s", 1, "mine") for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, component string")
    got = corpus_pipeline.keep_first(spark, docs, SF)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted(
        [*rows[:4], (8, long), (12, texts[4]), (10, None)], key=repr)
    bench = " ".join(r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").limit(1).collect())
    leaky = frame([(7, bench, "en", "s", 1, "mine"), (7, texts[0], "en", "s", 1, "mine"), (None, bench, "en", "s", 1, "mine"), (None, texts[1], "en", "s", 1, "mine")],
                  "doc_id bigint, text string, lang string, source string, n_chars bigint, component string")
    assert sorted(r.text for r in corpus_pipeline.keep_unseen(spark, leaky, SF).collect()) == sorted(texts[:2])
