from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quartzite.llm import exact_dedup, line_dedup, mixing, sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, keep_id string"
ROWS = [
    (1, "Alpha beta", "en", "a", 1, "x", "y"),
    (2, "alpha BETA", "en", "a", 1, "x", "y"),
    (3, "ÄLPHA", "de", "b", 1, "x", "y"),
    (4, "älpha", "de", "b", 1, "x", "y"),
    (5, None, "de", None, 1, "x", "y"),
    (6, "", None, None, 1, None, None),
    (7, "one two three " * 4000, "en", "c", 1, "x", "y"),
    (8, "one two three " * 4000, "en", "c", 1, "x", "y"),
    (8, "repeated", "en", "c", 1, "x", "y"),
    (8, "repeated", "en", "c", 1, "x", "y"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def test_exact_groups_by_brute_force(docs):
    groups = defaultdict(list)
    for r in ROWS:
        groups[lower(r[1])].append(r[0])
    want = sorted((r[0], max(groups[lower(r[1])]), len(groups[lower(r[1])]), r[0] == max(groups[lower(r[1])])) for r in ROWS)
    got = exact_dedup.exact_groups(docs).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == want


def test_exact_null_ids_and_empty(spark, docs):
    d = spark.createDataFrame([(None, "a"), (None, "A"), (3, "b"), (None, "b")], "doc_id long, text string")
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(d).collect()}
    assert got == {(None, None, 2, False), (3, 3, 2, True), (None, 3, 2, False)}
    assert exact_dedup.exact_groups(docs.limit(0)).count() == 0


def test_deduplicated_keeps_columns(docs):
    kept = exact_dedup.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.select("doc_id").distinct().collect()) == [2, 3, 4, 6, 8]


def test_mixing_targets_and_takes(spark, docs):
    rows = [(i, "w " * (1 + i % 7) * 40, f"s{i % 5}" if i % 3 else "hot") for i in range(600)] + [(1000, None, None), (1001, "", None), (1002, "x y", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mixed(d, block=32).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    source = {r[0]: r[2] for r in rows}
    for r in got:
        by[source[r.doc_id]].append(r)
        assert 0 <= r.taken <= 3 * r.size
    for rs in by.values():
        assert sum(r.size for r in rs) == rs[0].source_size
        assert rs[0].target <= 3 * rs[0].source_size + 1e-6
        assert abs(sum(r.taken for r in rs) - rs[0].target) <= 32 * 4
    assert sum(rs[0].target for rs in by.values()) == pytest.approx(sum(r.size for r in got))
    again = mixing.mixed(d, block=32).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    assert mixing.mixed(d.limit(0)).count() == 0


def test_water_filling_by_loop(spark):
    sizes = {"a": 10, "b": 1000, "c": 5, "d": 400, None: 3}
    sized = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(sizes.items())], "id long, source string, size long")
    got = {r.source: r.target for r in mixing.targets(sized).collect()}
    order = sorted(k for k in sizes if k is not None) + [None]
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(order)}
    left, open_, want = float(sum(sizes.values())), set(sizes), {}
    while True:
        total = sum(weight[k] for k in open_)
        over = [k for k in open_ if left * weight[k] / total > 3 * sizes[k] + 1e-12]
        if not over:
            break
        for k in over:
            want[k] = 3.0 * sizes[k]
            open_.remove(k)
        left = sum(sizes.values()) - sum(want.values())
    want |= {k: left * weight[k] / total for k in open_}
    assert got == pytest.approx(want)


def test_shards(spark, docs):
    rows = [(i, "t" * (i % 50)) for i in range(3000)] + [(None, None), (5, "again")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.slots(sharding.write_shards(d, bucket_bytes=2048)).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r._shard].append(r)
        assert r._grown in (r._shard, 16)
        assert r._size == len(r.text or "") + 1
    assert len(by) == 16
    for rs in by.values():
        assert sorted(r._slot for r in rs) == list(range(len(rs)))
        ids = [r.doc_id for r in sorted(rs, key=lambda r: r._slot) if r.doc_id is not None]
        assert ids != sorted(ids)
        assert len(rs) == pytest.approx(len(rows) / 16, rel=0.4)
    moved = sum(r._grown == 16 for r in got) / len(got)
    assert 0.02 < moved < 0.12
    again = sharding.slots(sharding.write_shards(d.repartition(7), bucket_bytes=2048)).collect()
    key = lambda r: (r.doc_id, r.text, r._shard, r._slot)
    assert {key(r) for r in got} == {key(r) for r in again}
    assert sharding.slots(sharding.write_shards(d.limit(0))).count() == 0


def test_line_dedup_by_brute_force(spark):
    rng = np.random.default_rng(3)
    pages = [(i, f"http://h{i % 4 if i % 3 else 0}.org/{i}", "\n".join(["head", f"own {i}", *(f"l{k}" for k in rng.integers(0, 6, 4)), "foot" if i % 2 else ""])) for i in range(80)] + [(80, None, None), (81, "http://lone.org/", "a\nb")]
    d = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["row"].page_id: r for r in line_dedup.without_boilerplate(d, line_dedup.text_lines(F.col("html")), line_dedup.host_of(F.col("url"))).collect()}
    host = lambda u: (u or "://").split("/")[2] if u else ""
    count, total = defaultdict(int), defaultdict(int)
    for _, u, t in pages:
        total[host(u)] += 1
        for line in set((t or "").split("\n")):
            count[host(u), line] += 1
    for i, u, t in pages:
        lines = t.split("\n") if t is not None else []
        keep = [x for x in lines if x == "" or not (count[host(u), x] >= 2 and count[host(u), x] > 0.5 * total[host(u)])]
        assert got[i].n_lines == len(lines) and got[i].n_dropped == len(lines) - len(keep)
        assert (got[i].clean or "") == "\n".join(keep)
    assert line_dedup.without_boilerplate(d.limit(0), line_dedup.text_lines(F.col("html")), line_dedup.host_of(F.col("url"))).count() == 0


def test_deduplicated_with_repeated_and_null_ids(spark):
    rows = [(8, "same", 1), (8, "SAME", 2), (8, "x", 3), (9, "x", 4), (None, "lone", 5), (None, "Lone", 6), (None, "x", 7), (8, "same", 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, d int")
    got = sorted((r.doc_id or 0, lower(r.text)) for r in exact_dedup.deduplicated(d).collect())
    assert got == [(0, "lone"), (8, "same"), (9, "x")]
    assert exact_dedup.deduplicated(d).columns == d.columns
    assert exact_dedup.deduplicated(d.limit(0)).count() == 0


def test_shards_with_clashing_names_and_a_hot_id(spark):
    rows = [(5, f"text {i}", i, "s") for i in range(400)] + [(i, "t" * (i % 9), i, None) for i in range(400)] + [(7, "w " * 50000, 1, "long")]
    d = spark.createDataFrame(rows, "doc_id long, text string, _size int, _SLOT string")
    got = sharding.slots(sharding.write_shards(d, bucket_bytes=512)).collect()
    assert len(got) == len(rows) and {"_size_", "_SLOT_"} <= set(got[0].asDict())
    assert sorted((r.doc_id, r.text, r._size_) for r in got) == sorted((r[0], r[1], r[2]) for r in rows)
    assert all(r._size == len(r.text) + 1 for r in got)
    hot = [r for r in got if r.doc_id == 5 and r.text.startswith("text")]
    assert len({r._shard for r in hot}) == 1 and len({r._bucket for r in hot}) > 5
    by = defaultdict(list)
    for r in got:
        by[r._shard].append(r._slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


def test_sharding_is_a_rendezvous_and_a_shuffle(spark):
    d = spark.createDataFrame([(i, "t") for i in range(2000)], "doc_id long, text string")
    weights = [[F.xxhash64("doc_id", F.lit(j), F.lit(7)).alias(f"w{j}") for j in range(17)]]
    want = {r.doc_id: [r[f"w{j}"] for j in range(17)] for r in d.select("doc_id", *weights[0]).collect()}
    got = sharding.slots(sharding.write_shards(d)).collect()
    for r in got:
        w = want[r.doc_id]
        assert r._shard == max(range(16), key=lambda j: w[j]) and r._grown == max(range(17), key=lambda j: w[j])
    ahead = [sum(a < b for a, b in zip(ids, ids[1:], strict=False)) / len(ids) for ids in ([r.doc_id for r in sorted(got, key=lambda r: r._slot) if r._shard == s] for s in range(16))]
    assert all(0.3 < x < 0.7 for x in ahead)  # neither in order nor reversed
