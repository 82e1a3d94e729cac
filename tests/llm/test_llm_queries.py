import zlib

import comparing
import pytest

from quartzite.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_sql(spark, name):
    assert comparing.assert_same(queries.QUERIES[name](spark, comparing.DATA), queries.ORACLE[name]) > 0


def test_quality_on_held_out_labels(spark):
    got = {r.doc_id: r for r in queries.op7_quality(spark, comparing.DATA).collect()}
    assert len(got) == queries.table(spark, comparing.DATA, "documents").count()
    right, held = 0, 0
    for r in queries.table(spark, comparing.DATA, "labels").collect():
        if r.doc_id in got and zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r.quality is not None:
            assert got[r.doc_id].held_out
            held += 1
            right += got[r.doc_id].predicted == r.quality
    assert held > 0 and right / held >= 0.6
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())


def test_segmentations_of_whole_table_round_trip(spark):
    rows = queries.op2_sentencepiece(spark, comparing.DATA).collect()
    docs = queries.table(spark, comparing.DATA, "documents").count()
    assert all(r.round_trip for r in rows)
    assert len({r.doc_id for r in rows}) == docs
    assert len({(r.doc_id, r["sample"]) for r in rows}) == len(rows)


def test_shards_of_whole_table(spark):
    rows = queries.op10_sharding(spark, comparing.DATA).collect()
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 16)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    texts = {r.doc_id: r.text or "" for r in queries.table(spark, comparing.DATA, "documents").collect()}
    assert len(rows) == len(texts)
    assert all(r.size == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in rows)
