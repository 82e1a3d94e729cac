import zlib

import comparing
import numpy as np

from quartzite.llm import queries, sentencepiece_sampling


def test_op2_gives_segmentations_that_decode_to_the_texts(spark):
    v = sentencepiece_sampling.load("/opt/tokenizers/piece_bpe_32k.model")
    texts = {r.doc_id: r.text or "" for r in queries.table(spark, comparing.DATA, "documents").collect()}
    rows = queries.op2_sentencepiece(spark, comparing.DATA).collect()
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        ids = np.frombuffer(r.ids, "<i4")
        assert len(ids) == r.n_pieces and zlib.crc32(ids.tobytes()) == r.ids_crc32
        t = texts[r.doc_id]
        assert sentencepiece_sampling.decode(ids, v) == ((" " + t).encode() if t else b"")
    assert len({(r.doc_id, bytes(r.ids)) for r in rows}) == len(rows)


def test_packed_ids_are_the_ids(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, None), (3, "x"), (4, "zz中")], "doc_id long, text string")
    model = queries.piece_model(spark)
    plain = {(r.doc_id, r["sample"]): r.ids for r in sentencepiece_sampling.segmentations(docs, model, k=6, with_ids=True).collect()}
    packed = {(r.doc_id, r["sample"]): np.frombuffer(r.ids, "<i4").tolist() for r in sentencepiece_sampling.segmentations(docs, model, k=6, with_ids="packed").collect()}
    assert packed == plain and len(plain) > 10
