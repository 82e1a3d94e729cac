import hashlib
import re
from collections import Counter

import comparing
import corpus_pipeline

from quartzite.llm import queries, secrets, warc


def test_warc_round_trip_of_segments_and_chunks(spark, tmp_path):
    big = "".join(f"<p>line {i} ä中</p>\r\n" for i in range(4000))
    rows = [(1, "http://a.org/x y", big, 1), (2, None, big, 2), (3, "u", None, 3), (4, "u", "", 4), (5, "u", "short", 5), (6, "u", "short", 6), (7, "u", "z" * 1000, 7), (9, "u", "z" * 1000, 8), (8, "u", "0\r\n\r\n" * 300, 9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest long")
    path = warc.write_archives(pages, f"file://{tmp_path}/w", segment_bytes=1000, chunk=700)
    got = {r.page_id: r for r in warc.responses(spark, path).collect()}
    assert len(got) == len(rows)
    winners = {1: 2, 7: 9}
    for page_id, _, html, _ in rows:
        body = (html or "").encode()
        r = got[page_id]
        assert r.declared_digest == hashlib.sha1(body).hexdigest()
        if page_id in winners:
            assert (r.record_type, r.refers_to, r.declared_bytes, r.payload) == ("revisit", winners[page_id], len(body), None)
        else:
            assert (r.record_type, bytes(r.payload), r.complete) == ("response", body, True)
    empty = warc.write_archives(pages.limit(0), f"file://{tmp_path}/e")
    assert warc.responses(spark, empty).count() == 0


def test_warc_segments_that_do_not_add_up(spark):
    segments = [
        ("a", None, 1, None, b"ab"), ("a2", "a", 2, 4, b"cd"),
        ("b", None, 1, None, b"ab"), ("b3", "b", 3, 4, b"cd"),
        ("c", None, 1, None, b"ab"), ("c2", "c", 2, 5, b"cd"),
        ("d", None, 1, None, b"ab"), ("d2", "d", 2, None, b"cd"),
        ("e", None, 1, None, b"ab"), ("e2", "e", 2, 4, b"cd"), ("e2", "e", 2, 4, b"cd"),
    ]
    records = spark.createDataFrame(segments, "record_id string, origin string, segment int, total_bytes long, block binary")
    got = {r.record_id: r.block and bytes(r.block) for r in warc.reassembled(records).collect()}
    assert got == {"a": b"abcd", "b": None, "c": None, "d": None, "e": None}


def test_broken_chunked_framing():
    assert warc.unchunked(warc.chunked(b"x" * 1500, 700)) == b"x" * 1500
    for broken in (b"", b"5\r\nabc", b"zz\r\nab\r\n0\r\n\r\n", b"2\r\nabXX0\r\n\r\n", b"2\r\nab\r\n"):
        assert warc.unchunked(broken) is None


def base_by_brute_force(text):
    assign = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found = [(m.start(), 0, m.end(), "assign") for m in re.finditer(assign, text, re.IGNORECASE | re.ASCII) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return [(s, e, kind) for s, _, e, kind in sorted(found)]


def test_secrets_of_whole_table_by_brute_force(spark):
    docs = queries.table(spark, comparing.DATA, "documents")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = queries.op5_secrets(spark, comparing.DATA).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in docs.collect())
    some = 0
    for r in got:
        want = base_by_brute_force(texts[r.doc_id])
        kinds = Counter(k for _, _, k in want)
        assert (r.n_assign, r.n_access, r.n_hex) == (kinds["assign"], kinds["access"], kinds["hex"])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in want).encode()).hexdigest()
        assert {f"{k}:{s}:{e}" for s, e, k in want} <= set(r.spans.split(",") if r.spans else [])
        some += len(want)
    assert some > 0


def test_weak_parts_only_together(spark):
    key = "aB3" * 10
    texts = [None, "", f"client_id = abcd1234 {key} https://x.org/a", f"{key} https://x.org/a", "client_id = abcd1234 https://x.org", f"client_id = abcd1234\n\n{key}", f"client_id = abcd1234 {'w ' * 400}{key}", f"client_id = abcd1234\n{key}"]
    d = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, found int")
    want = {0: [], 1: [], 2: ["weak_id", "bare_key", "endpoint"], 3: [], 4: [], 5: [], 6: [], 7: ["weak_id", "bare_key"]}
    for reach, far in ((256, []), (None, ["weak_id", "bare_key"])):
        got = {r.doc_id: [s.kind for s in r.found] for r in secrets.found_secrets(d, reach=reach).collect()}
        assert got == want | {6: far}
    assert secrets.found_secrets(d.limit(0)).count() == 0


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def grams(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def test_pipeline_stages_one_by_one(spark):
    docs = queries.table(spark, comparing.DATA, "documents")
    stages = [f for _, f in corpus_pipeline.STAGES]
    good = stages[0](spark, docs, comparing.DATA)
    assert sorted(good.columns) == sorted(docs.columns)
    scores = {r.doc_id: r.predicted for r in queries.op7_quality(spark, comparing.DATA).collect()}
    assert {r.doc_id for r in good.collect()} == {d for d, p in scores.items() if p == 1}

    rows = good.select("doc_id", "text").collect()
    kept = stages[1](spark, good, comparing.DATA)
    best = {}
    for r in rows:
        best[lower(r.text)] = max(r.doc_id, best.get(lower(r.text), r.doc_id))
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(best.values())

    rows = kept.select("doc_id", "text").collect()
    sets = {r.doc_id: grams(r.text) for r in rows}
    holders = {}
    for d, s in sets.items():
        for g in s:
            holders.setdefault(g, []).append(d)
    common = Counter((a, b) for ds in holders.values() for a in ds for b in ds if a < b)
    up = {d: d for d in sets}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    for (a, b), n in common.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    apart = stages[2](spark, kept, comparing.DATA)
    assert sorted(r.doc_id for r in apart.select("doc_id").collect()) == sorted({root(d) for d in sets})

    mixed = stages[3](spark, apart, comparing.DATA)
    assert mixed.columns == corpus_pipeline.COLUMNS
    texts = {r.doc_id: r.text for r in apart.collect()}
    times = Counter(r.doc_id for r in mixed.select("doc_id").collect())
    assert set(times) <= set(texts) and max(times.values()) <= 3

    encoded = stages[4](spark, mixed, comparing.DATA).collect()
    assert {r.doc_id for r in encoded} == set(times)
    assert all(r.round_trip and len(r.ids) == 4 * r.n_pieces and r["sample"] in (0, 1) for r in encoded)


def test_warc_lost_first_segment_and_references(spark, tmp_path):
    big = "".join(f"line {i}\n" for i in range(2000))
    pages = spark.createDataFrame([(1, "u1", big), (2, "u2", big), (3, "u3", big[:-1]), (4, None, "z" * 1200), (4, None, "z" * 1200), (5, None, "z" * 1200)], "page_id long, url string, html string")
    path = warc.write_archives(pages, f"file://{tmp_path}/w", segment_bytes=1000, chunk=700)
    records = warc.read_archives(spark, path).collect()
    names = [r.record_id for r in records]
    assert len(names) == len(set(names))
    as_files = warc.read_archives(spark, path, None).collect()
    assert sorted(names) == sorted(r.record_id for r in as_files)
    lost = spark.createDataFrame([r for r in records if not (r.page_id == 3 and r.segment == 1)], warc.SCHEMA)
    got = {r.page_id: r for r in warc.reassembled(lost).collect()}
    assert {2, 3} <= set(got)
    assert got[3].block is None and got[3].record_type == "response" and got[3].url == "u3"
    assert got[2].block is not None


def test_warc_revisits_name_records(spark, tmp_path):
    import gzip
    from pathlib import Path

    pages = spark.createDataFrame([(1, "u", "z" * 1200), (4, "u", "z" * 1200), (4, "v", "z" * 1200), (2, "u", "y" * 1200), (7, "u", "y" * 1200)], "page_id long, url string, html string")
    warc.write_archives(pages.coalesce(1), f"file://{tmp_path}/w")
    text = b"".join(gzip.decompress(p.read_bytes()) for p in Path(tmp_path, "w").glob("part-*")).decode()
    names = set(re.findall(r"WARC-Record-ID: (\S+)", text))
    refers = re.findall(r"WARC-Refers-To: (\S+)", text)
    assert len(names) == 5 and len(refers) == 2 and set(refers) <= names
