from collections import Counter, defaultdict

import corpus_pipeline
from pyspark.sql import functions as F

from quartzite.llm import mixing


def rows():
    made = [(i, " ".join(f"d{i}.{k}" for k in range((1 + i % 7) * 13)), f"s{i % 4}" if i % 3 else "hot") for i in range(120)]
    return [*made, (900, "long " * 700, "s1"), (1000, None, None), (1001, "", None), (1002, "x y", None), (1003, "x y z", ""), (1003, "x y z", "")]


def test_mix_is_the_stream_of_each_source_cut_into_the_blocks_of_its_slots(spark):
    d = spark.createDataFrame(rows(), "doc_id long, text string, source string")
    got = mixing.mix(d, block=32).collect()
    sources = mixing.with_blocks(mixing.targets(mixing.sizes(d)), 32)
    slots = {(r.key if not r.unnamed else None, r["rank"]): r.slot for r in mixing.schedule(sources).collect()}
    block = {r.source: r.block for r in sources.collect()}
    assert block["hot"] == 32 and block[None] == 1
    size = defaultdict(int)
    for _, text, source in rows():
        size[source] += len((text or "").split())
    streams, by_slot = defaultdict(list), defaultdict(list)
    for r in got:
        assert slots[r.source, r["rank"]] == r.slot and 0 <= r["from"] < r.to <= r.size
        streams[r.source].append(r)
        by_slot[r.slot].append(r)
    assert set(slots.values()) == set(range(len(slots)))
    for source, held in streams.items():
        at = 0
        for r in sorted(held, key=lambda r: (r.slot, r.round, r.start)):
            assert at == r.round * size[source] + r.start + r["from"] and r["rank"] == at // block[source]
            at += r.to - r["from"]
        assert at == min(3 * size[source], block[source] * sum(s == source for s, _ in slots))
    for held in by_slot.values():
        assert len({r.source for r in held}) == 1 and sum(r.to - r["from"] for r in held) <= block[held[0].source]
    taken = defaultdict(int)
    for r in got:
        taken[r.doc_id] += r.to - r["from"]
    counts = mixing.mixed(d, block=32).collect()
    assert len(counts) == len(rows())
    want = Counter()
    for r in counts:
        want[r.doc_id] += r.taken
    assert dict(taken) == {k: v for k, v in want.items() if v}
    assert mixing.mix(d.limit(0)).count() == 0


def test_small_tables_come_near_their_targets(spark):
    for rows in ([(1, "a b c d", "a"), (2, "x y z", "b"), (3, "e f g h", "a"), (4, "i j k l", "a")], [(k, "w " * (k % 9), "abc"[k % 3]) for k in range(20)], [(k, "w " * 40, "big") for k in range(500)] + [(900, "a b", "tiny")]):
        d = spark.createDataFrame(rows, "doc_id long, text string, source string")
        source = {r[0]: r[2] for r in rows}
        taken, target = defaultdict(int), {}
        for r in mixing.mixed(d).collect():
            taken[source[r.doc_id]] += r.taken
            target[source[r.doc_id]] = r.target
            assert r.taken <= 3 * r.size
        for k, t in target.items():
            assert abs(taken[k] - t) <= max(2.5, 0.1 * t)


def test_pipeline_gives_the_words_that_are_mixed(spark):
    made = [(i, f" a{i}\t中{i}\n" * (200 + i), "en", f"s{i % 3}", 0) for i in range(30)]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long")
    got = defaultdict(int)
    texts = {r[0]: r[1] for r in made}
    cut = 0
    for r in corpus_pipeline.mix_sources(spark, docs, "").collect():
        got[r.doc_id] += len(r.text.split())
        assert texts[r.doc_id].startswith(r.text)
        if r.text != texts[r.doc_id]:
            assert r.n_chars == len(r.text)
            cut += 1
    want = {r.doc_id: r.taken for r in mixing.mixed(docs).where(F.col("taken") > 0).collect()}
    assert got == want and cut > 0
