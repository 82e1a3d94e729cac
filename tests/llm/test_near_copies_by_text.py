"""Rows are told apart by id and text; very long texts and few partitions."""

import random

import comparing
import corpus_pipeline
import numpy as np

from quartzite.llm import ngram_join, queries

WORDS = [f"w{i}" for i in range(400)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def text(rnd, n=60):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def test_unrelated_text_of_a_repeated_id_stays(spark):
    rnd = random.Random(1)
    a, b, c = text(rnd), text(rnd), text(rnd)
    rows = [(4, a), (7, a + " z"), (7, b), (9, c), (9, c), (None, a), (11, None), (12, ""), (3, c + " y")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    kept = sorted((r.doc_id or -1, r.text or "") for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect())
    assert kept == sorted([(4, a), (7, b), (-1, a), (11, ""), (12, ""), (3, c + " y")])
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in ngram_join.near_duplicates(docs).collect())
    n = lambda t: len({tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)})
    assert got == sorted([(4, n(a), 4), (7, n(a + " z"), 4), (7, n(b), 7), (9, n(c), 3), (9, n(c), 3), (-1, n(a), -1), (11, 0, 11), (12, 0, 12), (3, n(c + " y"), 3)])


def test_texts_of_megabytes(spark):
    """Copies and near copies of texts longer than a batch, beside short ones."""
    rnd = random.Random(2)
    vocabulary = [f"{rnd.getrandbits(40):x}" for _ in range(50_000)]
    long = [rnd.choice(vocabulary) for _ in range(450_000)]
    cut = list(long)
    for k in range(0, len(cut), 2000):
        cut[k] = "changed"
    other = [rnd.choice(vocabulary) for _ in range(450_000)]
    short = text(rnd)
    rows = [(1, " ".join(long)), (2, " ".join(cut)), (3, " ".join(other)), (4, " ".join(long)), (5, short), (6, short + " more")]
    assert len(rows[0][1]) > 4_000_000
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 1, 5: 5, 6: 5}


def test_bitmaps_count_common_grams():
    rnd = np.random.default_rng(3)
    sets = [np.unique(rnd.integers(0, 400, int(rnd.integers(1, 200)), dtype=np.uint64)) for _ in range(40)]
    bits = ngram_join.bitmaps(sets)
    for i in range(0, 40, 7):
        for j in range(40):
            if i != j:
                assert np.bitwise_count(bits[i] & bits[j]).sum() == len(np.intersect1d(sets[i], sets[j]))


def test_components_of_whole_table_without_links_to_blocks(spark, monkeypatch):
    """The same components where blocks, bundles and batches are very small."""
    want = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(queries.table(spark, comparing.DATA, "documents")).collect()}
    for name, value in {"BATCH_BYTES": 1 << 14, "BLOCK_GRAMS": 4000, "BUNDLE_GRAMS": 20_000}.items():
        monkeypatch.setattr(ngram_join, name, value)
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(queries.table(spark, comparing.DATA, "documents"), block_docs=4).collect()}
    assert got == want
