import random
import zlib
from collections import defaultdict

import comparing
import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from quartzite.llm import packing, queries
from quartzite.llm.bytebpe import encoder

PATH = "/opt/tokenizers/byte_bpe_50k.json"
SCHEMA = "doc_id long, text string, ids string, start string, sig long"


def library():
    return Tokenizer.from_file(PATH)


def ids_of(t, text):
    return t.encode(text or "", add_special_tokens=False).ids


#: What texts of the pre-token rules are put together from.
PARTS = ["'", "s", "re", "'ll", " ", "  ", "\n", "\t", "a", "B", "é", "中", "1", "²", "٣", "!", "…", " ", "　", "😀", "̀", "<|endoftext|>", "\x1c", "\x85", "𝒜", "\U0001fae0", "​", "\r\n", "Ⅷ", "͸", "\U0001e900", "x" * 300, "  \n \t"]


def test_ids_equal_the_librarys(spark):
    rnd, t = random.Random(4), library()
    texts = ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 40))) for _ in range(3000)] + ["", None, "'", "don't 's", " \n"]
    texts += [r.text for r in queries.table(spark, comparing.DATA, "documents").collect()]
    for most in (1 << 10, 1 << 22):
        got = [x.tolist() for _, _, ids, n in encoder(PATH).encode(pa.array(texts, pa.string()), most) for x in np.split(ids, np.cumsum(n)[:-1])]
        assert got == [ids_of(t, x) for x in texts]


def check(rows, texts, window=2048):
    """Every id in exactly one piece, sequences full or of a length that is a power of two."""
    t = library()
    want = {i: np.array(ids_of(t, x) + [1], "<u4") for i, x in texts.items()}
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(docs) == set(want)
    for i, pieces in docs.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(want[i])
            assert r.ids_crc32 == zlib.crc32(want[i][r.start : r.start + r.length].tobytes())
            at += r.length
        assert at == len(want[i])
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window and at & (at - 1) == 0
    return docs, sequences


def test_whole_table(spark):
    rows = queries.op13_packing(spark, comparing.DATA).collect()
    check(rows, {r.doc_id: r.text for r in queries.table(spark, comparing.DATA, "documents").collect()})


def packed(spark, docs, **more):
    from pyspark.sql import functions as F

    return packing.packed(docs, queries.piece_model(spark, "byte_bpe_50k.json"), **more).withColumn("ids_crc32", F.crc32("ids"))


def test_nulls_long_texts_and_small_shards(spark):
    rnd = random.Random(6)
    texts = {i: " ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "Zq9"]) + str(rnd.randint(0, 50)) for _ in range(rnd.randint(0, 120))) for i in range(150)}
    texts |= {200: None, 201: "", 202: " ", 203: "long text of words, " * 20000, 204: "a" * 50000, 205: "<|endoftext|> x"}
    d = spark.createDataFrame([(i, x, "x", "y", 1) for i, x in texts.items()], SCHEMA)
    for more in ({}, {"window": 64, "shard_tokens": 500, "task_tokens": 5000}):
        check(packed(spark, d, **more).collect(), texts, more.get("window", 2048))
    assert packed(spark, d.limit(0)).count() == 0


def test_repeated_rows_and_null_ids(spark):
    d = spark.createDataFrame([(7, "one two", "", "", 1)] * 3 + [(None, "one two", "", "", 1)], SCHEMA)
    rows = packed(spark, d).collect()
    n = len(ids_of(library(), "one two")) + 1
    assert sum(r.length for r in rows if r.doc_id == 7) == 3 * n and sum(r.length for r in rows if r.doc_id is None) == n


def plain_bm25(docs, query, idf, mean):
    out = []
    for d in docs:
        score = 0.0
        for term in set(query):
            tf = d.count(term)
            score += idf[term] * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(d) / mean))
        out.append(score)
    return out


def test_index_equals_plain_bm25():
    rnd = random.Random(8)
    docs = [[min(int(rnd.expovariate(0.05)), 299) for _ in range(rnd.randint(1, 80))] for _ in range(90)]
    idf, mean = np.random.default_rng(1).random(300) * 3, 40.0
    sizes = np.array([len(d) for d in docs])
    index = packing.Index(np.array(sum(docs, []), np.int32), np.cumsum(sizes) - sizes, sizes, idf, mean)
    for q in docs[:20]:
        assert index.scores(np.array(q)) == pytest.approx(plain_bm25(docs, q, idf, mean), rel=1e-4, abs=1e-4)


def test_greedy_fill_by_plain_search():
    """Each sequence of one shard: the seed, then its unused neighbours by falling score, the last one cut."""
    rnd = random.Random(9)
    docs = [[min(int(rnd.expovariate(0.03)), 299) for _ in range(rnd.randint(1, 60))] for _ in range(120)]
    idf, window = np.random.default_rng(2).random(300) * 3, 64
    sizes = np.array([len(d) for d in docs])
    mean = float(sizes.mean())
    pieces, rest = packing.Packer(idf, mean, window, 0).shard(np.array(sum(docs, []), np.int32), sizes)
    by = defaultdict(list)
    for d, start, _, n, number, offset in pieces:
        by[number].append((offset, d, start, n))
    left = {i: 0 for i in range(len(docs))}
    index = packing.Index(np.array(sum(docs, []), np.int32), np.cumsum(sizes) - sizes, sizes, idf, mean)
    cut = None
    for number in sorted(by):
        got = [x[1:] for x in sorted(by[number])]
        seed = cut if cut is not None else min(left)
        scores = index.scores(np.array(docs[seed][left[seed] :]))
        order = [seed] + sorted((d for d in left if d != seed), key=lambda d: (-scores[d], d))
        want, filled, cut = [], 0, None
        for d in order:
            n = min(len(docs[d]) - left[d], window - filled)
            want.append((d, left[d], n))
            filled += n
            left[d] += n
            if left[d] == len(docs[d]):
                del left[d]
            else:
                cut = d
            if filled == window:
                break
        assert got == want
    assert sorted(r[0] for r in rest) == sorted(left)


def test_packing_brings_similar_documents_together(spark):
    """Documents of one topic share sequences more often than chance."""
    rnd = random.Random(10)
    topics = [[f"{chr(97 + k)}{chr(97 + i)}word{k * 31 + i}" for i in range(20)] for k in range(8)]
    rows = [(i, " ".join(rnd.choice(topics[i % 8]) for _ in range(40)), "", "", 1) for i in range(400)]
    got = packed(spark, spark.createDataFrame(rows, SCHEMA), window=512).collect()
    by = defaultdict(set)
    for r in got:
        by[r.sequence_id].add(r.doc_id)
    pairs = [(a, b) for s in by.values() for a in s for b in s if a < b]
    assert sum(a % 8 == b % 8 for a, b in pairs) / len(pairs) > 0.6
