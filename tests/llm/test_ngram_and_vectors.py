import re

import numpy as np

from quartzite.llm import embedding_join, ngram_join
from quartzite.llm.components import components


def shingles(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)])


def closure(ids, links):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def near_texts(rng, n):
    words = [f"w{k}" for k in range(300)]
    base = [list(rng.choice(words, m)) for m in (3, 4, 5, 9, 30, 80, 200)]
    passage = list(rng.choice(words, 40))
    out = []
    for _ in range(n):
        t = list(base[rng.integers(len(base))])
        for _ in range(rng.integers(0, 3)):
            t[rng.integers(len(t))] = str(rng.choice(words))
        if rng.random() < 0.2:
            t = t + passage
        out.append((" " if rng.random() < 0.5 else "\n\t").join(t))
    return out


def test_ngram_components_by_brute_force(spark):
    rng = np.random.default_rng(5)
    texts = near_texts(rng, 260) + ["", None, "  \n", "One", "one", "x" * 50000]
    rows = [(i * 3 + 1, t, "c") for i, t in enumerate(texts)]
    d = spark.createDataFrame(rows, "doc_id long, text string, digest string").repartition(5)
    sets = {i: shingles(t) for i, t, _ in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = closure(list(sets), links)
    assert len(links) > 300
    for block in (4, 128):  # small blocks: links across blocks by queries
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(d, block_docs=block).collect()}
        assert got == {i: (len(sets[i]), want[i]) for i in sets}
    assert ngram_join.near_duplicates(d.limit(0)).count() == 0


def test_hot_ngrams_travel_as_flags(spark):
    """More sets of a batch share n-grams than are sent one by one."""
    rng = np.random.default_rng(6)
    words = [f"v{k}" for k in range(500)]
    base = list(rng.choice(words, 60))
    texts = []
    for i in range(150):
        t = list(base)
        t[i % 60] = f"u{i}"
        texts.append(" ".join(t))
    rows = [(i, t) for i, t in enumerate(texts + [" ".join(base[:30] + ["z"] * 30)])]
    d = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = closure(list(sets), links)
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(d, block_docs=16).collect()}
    assert got == want


def test_null_and_repeated_ids(spark):
    text = "a b c d e f g h i j"
    d = spark.createDataFrame([(None, text), (7, text), (7, text), (4, text + " k"), (9, None)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in ngram_join.near_duplicates(d).collect())
    assert got == sorted([("None", 6, "None"), ("7", 6, "4"), ("7", 6, "4"), ("4", 7, "4"), ("9", 0, "9")])


def test_tree_finds_what_brute_force_finds():
    rng = np.random.default_rng(1)
    base = [rng.integers(0, 2**45, m).astype(np.uint64) for m in (3, 10, 50, 200)]
    sets = []
    for _ in range(120):
        b = base[rng.integers(len(base))]
        sets.append(np.unique(np.append(b[rng.random(len(b)) > rng.choice([0, 0.02, 0.05, 0.1])], rng.integers(0, 2**45, rng.integers(1, 8)).astype(np.uint64))))
    sizes = np.array([len(s) for s in sets])

    def link(i, j):
        x = len(np.intersect1d(sets[i], sets[j]))
        return 100 * x >= 80 * (sizes[i] + sizes[j] - x)

    want = {(i, j) for i in range(120) for j in range(i) if link(i, j)}
    assert {(max(p), min(p)) for p in ngram_join.linked(sets, sizes, None, 80)} == want
    mask = rng.random(120) < 0.3
    assert {(max(p), min(p)) for p in ngram_join.linked(sets, sizes, mask, 80)} == {p for p in want if mask[p[0]] != mask[p[1]]}


def test_components_of_a_chain(spark):
    rng = np.random.default_rng(2)
    order = rng.permutation(200)
    edges = [(int(order[i]), int(order[i + 1])) for i in range(149)] + [(int(order[i]), int(order[i + 1])) for i in range(150, 199)] + [(5, 5), (None, 3)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = closure(range(200), [e for e in edges if e[0] is not None])
    assert got == want


def test_vectors_by_brute_force(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(40, 16))
    rows = []
    for i in range(300):
        v = base[rng.integers(40)] + rng.normal(size=16) * rng.choice([0, 0.05, 0.3])
        rows.append((i, [float(x) for x in np.float32(v)], "x"))
    rows += [(300, None, "x"), (301, [0.0] * 16, "x"), (302, [float("nan")] * 16, "x"), (303, [None] * 16, "x"), (304, [], "x"), (305, [1.0, 0.0], "x"), (306, [2.0, -0.0], "x"), (307, rows[0][1], "x")]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, component string")
    ok = {i: np.array(v, np.float32).astype(float) for i, v, _ in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links = [(a, b) for a in ok for b in ok if a < b and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / np.linalg.norm(ok[a]) / np.linalg.norm(ok[b]) >= 0.9]
    want = closure([r[0] for r in rows], links)
    count = {i: 0 for i, _, _ in rows}
    for a, b in links:
        count[a] += 1
        count[b] += 1
    for tile, per in ((4096, 16384), (16, 64)):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_join.near_vectors(d, tile=tile, vectors_per_pivot=per).collect()}
        assert got == {i: (count[i], want[i], want[i] == i) for i in count}
    assert embedding_join.near_vectors(d.limit(0)).count() == 0
