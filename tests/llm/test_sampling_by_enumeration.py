"""Sampled segmentations against the list of all segmentations of short texts."""

import itertools
import math
import os
import random
import re
from collections import Counter

import numpy as np
import pytest

from quartzite.llm import sentencepiece_sampling as sp

#: What a word is, as a pattern.
WORDS = re.compile(r"\n| *[^ \n]+| +")
MODEL = os.environ.get("QUARTZITE_TOKENIZERS", "/opt/tokenizers") + "/piece_bpe_32k.model"


def all_paths(text, v, alpha):
    """Every segmentation of the text as a tuple of ids, with its log-probability."""
    number = {}
    for i, t in enumerate(v.texts):
        if t and i not in set(v.byte_ids.tolist()):
            number.setdefault(t.decode(), i)
    words = WORDS.findall(" " + text)

    def of_word(w):
        if not w:
            return [((), 0.0)]
        out = []
        for size in range(1, len(w) + 1):
            if w[:size] in number and v.log_p[number[w[:size]]] > -1e6:
                i = number[w[:size]]
                out += [((i, *rest), alpha * v.log_p[i] + lp) for rest, lp in of_word(w[size:])]
        if w[0] not in number:
            ids = tuple(int(v.byte_ids[b]) for b in w[0].encode())
            out += [((*ids, *rest), alpha * v.byte_log_p * len(ids) + lp) for rest, lp in of_word(w[1:])]
        return out

    paths = {}
    for parts in itertools.product(*map(of_word, words)):
        paths[tuple(itertools.chain.from_iterable(p for p, _ in parts))] = sum(lp for _, lp in parts)
    whole = math.log(sum(math.exp(x) for x in paths.values()))
    return {p: x - whole for p, x in paths.items()}


def test_words_are_those_of_the_pattern_and_numbered_by_text():
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("  \n\nabc中😀") for _ in range(rnd.randint(0, 30))) for _ in range(400)]
    lexicon = sp.Lexicon(sp.load(MODEL), 0.5, 64)
    seen = {}
    for k in range(0, 400, 50):
        some = texts[k : k + 50]
        codes, sizes = sp._codes("".join(some)), [len(t) for t in some]
        starts = sp.words_of(codes, np.concatenate([[0], np.cumsum(sizes)]).astype(int))
        want = [w for t in some for w in WORDS.findall(t)]
        ends = np.append(starts[1:], len(codes))
        assert ["".join(map(chr, codes[a:b])) for a, b in zip(starts, ends, strict=True)] == want
        for w, number in zip(want, lexicon.numbered(codes, starts).tolist(), strict=True):
            assert seen.setdefault(w, number) == number
    assert sorted(seen.values()) == list(range(len(seen)))


def test_samples_of_short_texts_by_enumeration():
    v = sp.load(MODEL)
    for text, k in (("the", 3), ("a to", 4), ("zz中", 3), ("it", 50)):
        want = all_paths(text, v, 0.5)
        n = 3000
        first, weighted = Counter(), Counter()
        for s, threshold, _ in sp.sampled_batch(list(range(n)), [text] * n, sp.Lexicon(v, 0.5), k, 3):
            per_doc = [[] for _ in s.texts]
            for number, sample in enumerate(s.samples):
                flat, begin = s.ids(number)
                for d in np.flatnonzero(sample.value > -np.inf):
                    path = tuple(flat[begin[d] : begin[d + 1]].tolist())
                    per_doc[d].append((path, sample.value[d]))
                    assert sample.total[d] == pytest.approx(want[path], abs=1e-9)
            for d, found in enumerate(per_doc):
                assert len({p for p, _ in found}) == len(found) == min(k, len(want))
                assert all(a >= b for (_, a), (_, b) in itertools.pairwise(found))
                first[found[0][0]] += 1
                for p, value in found:
                    assert value >= threshold[d]
                    inclusion = 1.0 if np.isinf(threshold[d]) else -math.expm1(-math.exp(want[p] - threshold[d]))
                    weighted[p] += 1 / inclusion
        for p, lp in want.items():
            share = math.exp(lp)
            assert abs(first[p] - n * share) <= 5 * math.sqrt(n * share * (1 - share)) + 3
            if share > 0.05:  # weights of 1 / inclusion count every path once a row on average
                assert weighted[p] / n == pytest.approx(1.0, abs=0.25)


def test_edge_cases_of_segmentations(spark):
    spark.sparkContext.addFile(MODEL)
    rows = [(1, None, 5), (2, "", 6), (3, "ab", 7), (3, "ab", 7), (None, "ab", 8), (4, "word " * 30000, 9), (5, "▁ a\n\n b", 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, sample int")
    got = sp.segmentations(d, MODEL, with_ids=True).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert all(r.round_trip for r in got) and set(by) == {1, 2, 3, 4, 5, None}
    for i in (1, 2):
        assert [(r.n_pieces, r.log_prob, r.log_inclusion, r.ids) for r in by[i]] == [(0, 0.0, 0.0, [])]
    twice = Counter((r["sample"], tuple(r.ids), r.perturbed) for r in by[3])
    assert set(twice.values()) == {2}
    assert len({tuple(r.ids) for r in by[4]}) == 4 and min(r.n_pieces for r in by[4]) >= 30000
    assert sp.segmentations(d.limit(0), MODEL, with_ids=True).count() == 0
