"""SentencePiece encoding and decoding: distinct sampled segmentations by perturbed A* search.

A text is a path through the lattice of all its segmentations; the weight of a path is the product
of its pieces' probabilities. Every path has a Gumbel-perturbed log-probability, and the search
emits the k largest in order: k samples without replacement. Nothing is enumerated. A set of paths
with a common beginning has a mass, known from backward sums over the lattice, and the largest
perturbed value in the set is one truncated Gumbel draw, which is an exact bound for the search.
The first sample walks down the lattice by the conditional probabilities of pieces and keeps the
root's value; at each step the pieces not taken form a set that goes on the agenda with its own
largest value. The next sample is the best set on the agenda: it branches there and walks on. The
value left on top of the agenda after k samples is the threshold t of the inclusion scores
log(1 - exp(-exp(log p - t))), the log-probability that a path is among the k.

All draws are hashes of (seed, row key, sample, position), so a row's samples do not depend on its
neighbours, its task or the number of tasks.

Pieces never reach over a space after other characters or over a line end, so the lattice is built
once for each distinct word that a task meets, and texts share it; past `lexicon_chars` characters
of distinct words a task begins a new one. What a sample leaves goes on the agenda only where it can
be among the k largest: a Gumbel value is at most 37 above its mean. Scores: a unigram model's
scores are log-probabilities; a BPE model's are ranks, which are taken as log-probabilities by
Zipf's law, -log(rank + 3) less the log of their sum. `alpha` sharpens or flattens both.
Characters without a piece fall back to byte pieces. A text begins with the dummy space.

Defined results: null and empty texts have one segmentation, without pieces, of probability 1; a
text with fewer than k segmentations gives them all, with inclusion score 0; texts are encoded whole
and every encoding decodes to its text, U+2581 included (by byte pieces); a null row key is hashed
as the empty string; repeated rows give the same samples again; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .codepoints import distinct_words, equal_words, spread
from .textblocks import mix, release

END = -1
#: Marks of the first byte of UTF-8 forms by their length (fixed values).
LEAD = np.array([0, 0, 0xC0, 0xE0, 0xF0])
_MULT = np.uint64(0x9E3779B97F4A7C15)
_PIECE_BASE = np.uint64(0xD6E8FEB86659FD93)


def uniform(keys: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from 64-bit keys, at most 1 - 2**-53."""
    return ((mix(keys) >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


#: -log(-log(u)) of the largest number that uniform() gives is 36.7.
HIGHEST = 37.0


def spans(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1, ... of each span, one span after the other."""
    end = np.cumsum(size)
    return np.repeat(first - end + size, size) + np.arange(int(end[-1]) if len(end) else 0)


NOTHING, PREFIX = -2, -1


class Table:
    """Hashes of pieces and of their beginnings, with open addressing: a piece's id, PREFIX, or NOTHING."""

    def __init__(self, found: dict[int, int], bits: int = 19) -> None:
        self.mask = (1 << bits) - 1
        self.keys = np.zeros(1 << bits, np.uint64)
        self.values = np.full(1 << bits, NOTHING, np.int64)
        if 2 * len(found) > self.mask:
            raise ValueError("the vocabulary is too large for the table")
        for h, value in found.items():
            at = h & self.mask
            while self.values[at] != NOTHING:
                at = (at + 1) & self.mask
            self.keys[at], self.values[at] = h, value

    def get(self, h: np.ndarray) -> np.ndarray:
        at = (h & np.uint64(self.mask)).astype(np.int64)
        out = self.values[at]
        open_ = np.flatnonzero((self.keys[at] != h) & (out != NOTHING))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            out[open_] = self.values[at[open_]]
            open_ = open_[(self.keys[at[open_]] != h[open_]) & (out[open_] != NOTHING)]
        return out


@dataclass
class Vocabulary:
    """Pieces by hash of their code points."""

    texts: list[bytes]
    log_p: np.ndarray
    table: Table
    spelling: np.ndarray  # the bytes of all pieces
    spelled: np.ndarray  # where each piece begins in them, one more at the end
    byte_ids: np.ndarray
    longest: int
    byte_log_p: float


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _spread(codes: np.ndarray) -> np.ndarray:
    return mix(codes.astype(np.uint64) * _MULT + np.uint64(1))


@functools.lru_cache(maxsize=2)
def load(model_file: str) -> Vocabulary:
    """The vocabulary of a model file; a Python worker reads it once."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    n = sp.vocab_size()
    plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    text = {i: sp.id_to_piece(i).replace("▁", " ") for i in plain}
    if any(re.search(r"[^ ] |.\n|\n.", t) for t in text.values()):
        raise ValueError("a piece reaches over a space or line end: words can't be taken by themselves")
    score = np.array([sp.get_score(i) for i in range(n)])
    usable = np.array([i for i in plain if score[i] > -1e8])
    if (score[usable] == np.rint(score[usable])).all() and score[usable].min() < -1000:  # ranks of merges
        score = -np.log(3.0 - np.minimum(score, 0))
    elif usable.size == 0:
        raise ValueError("the model has no pieces")
    log_p = score - np.log(np.exp(score[usable]).sum())
    lowest = float(log_p[usable].min())
    byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
    if not all(sp.is_byte(int(i)) for i in byte_ids):
        raise ValueError("the model has no byte pieces")
    log_p[byte_ids] = lowest - 1.0
    texts = [b""] * n
    for b, i in enumerate(byte_ids.tolist()):
        texts[i] = bytes([b])
    for i in usable.tolist():
        texts[i] = text[i].encode()
    spread = _spread(_codes("".join([text[i] for i in usable.tolist()])))
    sizes = np.array([len(text[i]) for i in usable.tolist()])
    first, h = np.cumsum(sizes) - sizes, np.zeros(len(usable), np.uint64)
    found: dict[int, int] = {}
    for size in range(1, int(sizes.max()) + 1):
        live = np.flatnonzero(sizes >= size)
        h[live] = h[live] * _PIECE_BASE + spread[first[live] + size - 1]
        found |= dict.fromkeys(h[live].tolist(), PREFIX)
    found |= dict(zip(h.tolist(), usable.tolist(), strict=True))
    spelling, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    return Vocabulary(texts, log_p, Table(found), spelling, ends, byte_ids, max(len(text[i]) for i in usable.tolist()), lowest - 1.0)


@dataclass
class Lattice:
    """Lattices of many words. Nodes are characters; edges are sorted by node and lead to a node or END."""

    first: np.ndarray  # edges of a node begin here, one more at the end
    target: np.ndarray
    piece: np.ndarray  # of an edge; below 0: -1 - code point that falls back to bytes
    share: np.ndarray  # conditional probability of an edge at its node
    log_share: np.ndarray
    below: np.ndarray  # sum of the shares of the node's edges up to and with this one
    starts: np.ndarray  # first node of each word
    ends: np.ndarray  # node after the last of each word


def words_of(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where a word begins, in texts that begin at first: a line end, or spaces with what follows them up to a space or line end."""
    begin = np.zeros(len(codes) + 1, bool)
    begin[first] = True
    line, space = codes == 10, codes == 32
    begin[:-1] |= line
    begin[1:] |= line
    begin[1:-1] |= space[1:] & ~space[:-1]
    return np.flatnonzero(begin[:-1])


def build(codes: np.ndarray, lengths: np.ndarray, v: Vocabulary, alpha: float = 1.0) -> Lattice:
    """The lattice of words that follow each other in codes."""
    starts = np.cumsum(lengths) - lengths
    n = len(codes)
    left = np.repeat(starts + lengths, lengths) - np.arange(n)  # characters to the end of the word
    spread = _spread(codes)
    nodes, sizes, pieces = [], [], []
    at, h = np.arange(n), np.zeros(n, np.uint64)
    single = np.zeros(n, bool)
    for size in range(1, v.longest + 1):
        if not len(at):
            break
        h = h * _PIECE_BASE + spread[at + size - 1]
        k = v.table.get(h)
        got = np.flatnonzero(k >= 0)
        nodes.append(at[got])
        sizes.append(np.full(len(got), size))
        pieces.append(k[got])
        if size == 1:
            single[at[got]] = True
        more = np.flatnonzero((k != NOTHING) & (left[at] > size))
        at, h = at[more], h[more]
    rest = np.flatnonzero(~single)
    node = np.concatenate([*nodes, rest])
    size = np.concatenate([*sizes, np.ones(len(rest), np.int64)])
    piece = np.concatenate([*pieces, -1 - codes[rest].astype(np.int64)])
    counts = np.bincount(node, minlength=n)
    first = np.concatenate([[0], np.cumsum(counts)])
    rank = np.empty(len(node), np.int64)  # shorter pieces first: more segmentations follow them
    taken, at = np.zeros(n, np.int64), 0
    for group in [*nodes, rest]:
        rank[at : at + len(group)] = taken[group]
        taken[group] += 1
        at += len(group)
    place = first[node] + rank
    width = np.where(codes[rest] < 0x80, 1, np.where(codes[rest] < 0x800, 2, np.where(codes[rest] < 0x10000, 3, 4)))
    plain = len(node) - len(rest)
    log_p, target = np.empty(len(node)), np.empty(len(node), np.int64)
    log_p[place[:plain]] = alpha * v.log_p[piece[:plain]]
    log_p[place[plain:]] = alpha * v.byte_log_p * width
    goal = node + size
    goal[size == left[node]] = n  # whose sum is 0
    target[place] = goal
    kept = np.empty(len(node), np.int64)
    kept[place] = piece
    node, piece = np.repeat(np.arange(n), counts), kept
    beta = np.zeros(n + 1)  # of the node before which it stands; the end of a word counts 0
    weight = np.empty(len(node))
    by_left = np.argsort(left, kind="stable")
    bounds = np.searchsorted(left[by_left], np.arange(1, (int(left.max()) if n else 0) + 2))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        mine = by_left[a:b]
        counts = first[mine + 1] - first[mine]
        cut = np.cumsum(counts) - counts
        e = np.repeat(first[mine] - cut, counts) + np.arange(int(counts.sum()))
        w = log_p[e] + beta[target[e]]
        top = np.maximum.reduceat(w, cut)
        total = top + np.log(np.add.reduceat(np.exp(w - np.repeat(top, counts)), cut))
        beta[mine] = total
        weight[e] = w
    log_share = weight - beta[node]
    share = np.exp(log_share)
    run = np.cumsum(share)
    before = np.concatenate([[0.0], run])[first[:-1]] if n else np.zeros(0)
    below = run - before[node]
    below[first[1:] - 1] = np.inf
    return Lattice(first, np.where(target == n, END, target), piece, share, log_share, below, starts, starts + lengths)


class Lexicon:
    """Numbers of the words met so far and one lattice of them all, which grows."""

    #: Field, type, and whether it has an entry for each node, edge or word.
    PARTS = (("first", np.int64, 0), ("codes", np.uint32, 0), ("target", np.int32, 1), ("piece", np.int32, 1), ("share", np.float64, 1), ("log_share", np.float64, 1), ("below", np.float64, 1), ("starts", np.int64, 2), ("ends", np.int64, 2))

    def __init__(self, v: Vocabulary, alpha: float, piece_chars: int = 1 << 16) -> None:
        self.v, self.alpha, self.piece_chars = v, alpha, piece_chars
        self.space = {name: np.zeros(1024, kind) for name, kind, _ in self.PARTS}
        self.empty()

    def empty(self) -> None:
        self.keys, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # by key
        self.used = [0, 0, 0]

    @property
    def chars(self) -> int:
        return self.used[0]

    def _add(self, codes: np.ndarray, lengths: np.ndarray) -> None:
        new = build(codes, lengths, self.v, self.alpha)
        nodes, edges, _ = self.used
        columns = new.__dict__ | {
            "codes": codes,
            "first": new.first[:-1] + edges,
            "target": np.where(new.target == END, END, new.target + nodes),
            "starts": new.starts + nodes,
            "ends": new.ends + nodes,
        }
        for name, _, of in self.PARTS:
            column, begin = columns[name], self.used[of]
            if begin + len(column) >= len(self.space[name]):
                larger = np.empty(2 * (begin + len(column)), self.space[name].dtype)
                larger[:begin] = self.space[name][:begin]
                self.space[name] = larger
            self.space[name][begin : begin + len(column)] = column
        self.used = [u + len(columns[name]) for u, name in zip(self.used, ("first", "target", "starts"), strict=True)]
        self.space["first"][self.used[0]] = self.used[1]

    def numbered(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The numbers of the words that begin at starts and fill codes; the lattice gets those that are new."""
        sizes = np.diff(np.append(starts, len(codes)))
        if not len(starts):
            return np.zeros(0, np.int64)
        keys, same, own = distinct_words(codes, starts, sizes)
        key, at, size = keys[own], starts[own], sizes[own]
        place = np.searchsorted(self.keys, key)
        number = np.full(len(own), -1)
        hit = np.flatnonzero(place < len(self.keys))
        hit = hit[self.keys[place[hit]] == key[hit]]
        known = self.numbers[place[hit]]
        held = self.space["starts"][known]
        right = equal_words(codes, at[hit], size[hit], self.space["codes"], held, self.space["ends"][known] - held)
        number[hit[right]] = known[right]
        fresh = np.flatnonzero(number < 0)
        number[fresh] = self.used[2] + np.arange(len(fresh))
        ends = np.cumsum(size[fresh])
        i = 0
        while i < len(fresh):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + self.piece_chars, "right")))
            some = fresh[i:j]
            self._add(codes[spread(at[some], size[some])], size[some])
            i = j
        order = np.argsort(key[fresh])  # a key that is there already stays with its first word
        self.keys, self.numbers = (np.insert(old, np.searchsorted(self.keys, key[fresh][order], "right"), new[order]) for old, new in ((self.keys, key[fresh]), (self.numbers, number[fresh])))
        out = np.empty(len(starts), np.int64)
        out[own] = number
        return out[same]

    def lattice(self) -> Lattice:
        return Lattice(**{name: self.space[name][: self.used[of] + (name == "first")] for name, _, of in self.PARTS if name != "codes"})


def choose(lat: Lattice, nodes: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The edge of each node that u falls on."""
    edge = lat.first[nodes]
    open_ = np.flatnonzero(lat.below[edge] <= u)
    while len(open_):
        edge[open_] += 1
        open_ = open_[lat.below[edge[open_]] <= u[open_]]
    return edge


def truncated(mean: np.ndarray, top: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel values about mean, given that they are at most top."""
    return mean - np.log(np.exp(np.minimum(mean - top, 700)) - np.log(u))


def _walk(lat: Lattice, occ: np.ndarray, node: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Paths from the given nodes to their words' ends: occurrence, step within the walk and edge of every step taken."""
    occs, levels, edges = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    level = 0
    while len(occ):
        edge = choose(lat, node, uniform(key + np.uint64(4 * level)))
        occs.append(occ)
        levels.append(np.full(len(occ), level))
        edges.append(edge)
        node = lat.target[edge]
        go = np.flatnonzero(node != END)
        occ, node, key = occ[go], node[go], key[go]
        level += 1
    return np.concatenate(occs), np.concatenate(levels), np.concatenate(edges)


@dataclass
class _Sample:
    edge: np.ndarray  # of each step
    begin: np.ndarray  # first step of each document, one more at the end
    total: np.ndarray  # log-probability, by document
    value: np.ndarray  # perturbed, by document; -inf: no such sample
    branch: np.ndarray  # the step at which it left its parent, or -1
    without: list[tuple[int, ...]]  # edges that were gone at that step before it chose


class Sampler:
    """The samples of one chunk of texts."""

    def __init__(self, texts: list[str], keys: np.ndarray, v: Vocabulary, lattice: Lattice, word: np.ndarray, counts: np.ndarray) -> None:
        self.texts, self.keys, self.v, self.lat = texts, keys, v, lattice
        self.word = word  # the words of all texts
        self.doc = np.repeat(np.arange(len(texts)), counts)
        self.first_occ = np.concatenate([[0], np.cumsum(counts)])
        size = (lattice.ends - lattice.starts)[self.word]
        run = np.cumsum(size) - size
        self.at = (run - self._base(run)).astype(np.uint64)  # where a word begins in its text
        self.samples: list[_Sample] = []
        self.agenda: list[np.ndarray] = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)]  # document, largest value, sample, step

    def _base(self, run: np.ndarray) -> np.ndarray:
        padded = np.append(run, 0)
        return padded[np.minimum(self.first_occ[:-1], len(run))][self.doc]

    def _key(self, sample: int, purpose: int) -> np.ndarray:
        return mix(self.keys + np.uint64((sample * 4 + purpose) * int(_MULT) % 2**64))

    def _open(self, doc: np.ndarray, value: np.ndarray, step: np.ndarray) -> None:
        new = (doc, value, np.full(len(doc), len(self.samples)), step)
        self.agenda = [np.concatenate(pair) for pair in zip(self.agenda, new, strict=True)]

    def _finish(self, edge: np.ndarray, begin: np.ndarray, old: np.ndarray, value: np.ndarray, branch: np.ndarray, without: list[tuple[int, ...]], most: int, near: int = 64) -> None:
        """Adds a sample, whose first `old` steps of each document aren't its own, and opens what the others did not take.

        Of each document at most `most` values will be asked for. Behind the first `near` steps those are left
        out at which the path has become so improbable that none of them can be among the largest.
        """
        run = np.concatenate([[0.0], np.cumsum(self.lat.log_share[edge])])
        base = run[begin[:-1]]
        key = self._key(len(self.samples), 2)

        def opened(doc: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            doc, step = np.repeat(doc, size), spans(first, size)
            share = self.lat.share[edge[step]]
            some = np.flatnonzero(share < 1 - 1e-12)
            doc, step, share = doc[some], step[some], share[some]
            u = uniform(key[doc] + (step - begin[doc]).astype(np.uint64) * np.uint64(4))
            return doc, truncated(run[step] - base[doc] + np.log1p(-share), value[doc], u), step

        docs = np.arange(len(self.texts))
        first = begin[:-1] + old
        size = np.maximum(begin[1:] - first, 0)
        doc, high, step = opened(docs, first, np.minimum(size, near))
        self._open(doc, high, step)
        longer = docs[size > near]
        if len(longer):
            ordered = high[np.lexsort((-high, doc))]
            count = np.bincount(doc, minlength=len(docs))
            least = np.full(len(docs), -np.inf)
            enough = docs[count >= most]
            least[enough] = ordered[(np.cumsum(count) - count)[enough] + most - 1]
            end = np.searchsorted(-run[:-1], HIGHEST - least[longer] - base[longer])  # behind it no value can be as large
            more = np.minimum(end, begin[longer + 1]) - first[longer] - near
            if len(longer := longer[more > 0]):
                self._open(*opened(longer, first[longer] + near, more[more > 0]))
        self.samples.append(_Sample(edge, begin, run[begin[1:]] - base, value, branch, without))

    def first(self, most: int) -> None:
        n = len(self.texts)
        key = self._key(0, 1)[self.doc] + self.at * np.uint64(4)
        occ, level, edge = _walk(self.lat, np.arange(len(self.word)), self.lat.starts[self.word], key)
        per = np.concatenate([[0], np.cumsum(np.bincount(occ, minlength=len(self.word)))])
        place = per[occ] + level
        steps, occs = np.empty(len(edge), np.int64), np.empty(len(edge), np.int64)
        steps[place], occs[place] = edge, occ
        self.occ = [occs]
        root = -np.log(-np.log(uniform(self._key(0, 3))))
        self._finish(steps, per[self.first_occ], np.zeros(n, np.int64), root, np.full(n, -1), [()] * n, most)

    def best(self) -> tuple[np.ndarray, np.ndarray]:
        """By document: the largest value on the agenda and its place there."""
        doc, value = self.agenda[:2]
        top, place = np.full(len(self.texts), -np.inf), np.zeros(len(self.texts), np.int64)
        np.maximum.at(top, doc, value)
        hit = np.flatnonzero(value == top[doc])[::-1]
        place[doc[hit]] = hit
        return top, place

    def next(self, most: int) -> bool:
        """One more sample for every text that has one; whether any has."""
        top, place = self.best()
        go = np.flatnonzero(top > -np.inf)
        if not len(go):
            return False
        n, number, lat = len(self.texts), len(self.samples), self.lat
        value = np.full(n, -np.inf)
        value[go] = top[go]
        which, step = np.zeros(n, np.int64), np.zeros(n, np.int64)
        which[go], step[go] = self.agenda[2][place[go]], self.agenda[3][place[go]]
        self.agenda[1][place[go]] = -np.inf
        u = uniform(self._key(number, 0))
        turn = np.zeros(n, np.int64)  # the edge taken at the branch
        branch_occ = np.full(n, -1)
        keep = np.zeros(n, np.int64)  # steps kept from the parent
        without: list[tuple[int, ...]] = [()] * n
        rest = np.zeros(n)  # share that stays untaken at the branch
        out = np.zeros(n, np.int64)  # the edge that the parent took there
        again = np.zeros(n, bool)  # the parent branched there too, so more than one edge is gone
        before = np.zeros(n)  # log-probability of the path up to the branch
        for k, s in enumerate(self.samples):
            mine = go[which[go] == k]
            t = step[mine]
            out[mine], again[mine] = s.edge[t], s.branch[mine] == t
            keep[mine], branch_occ[mine] = t - s.begin[mine], self.occ[k][t]
        once = go[~again[go]]
        node = np.searchsorted(lat.first, out[once], "right") - 1
        share, first, last = lat.share[out[once]], lat.first[node], lat.first[node + 1] - 1
        point = u[once] * (1 - share)
        below = np.where(out[once] > first, lat.below[np.maximum(out[once] - 1, 0)], 0.0)  # the share before the edge that is gone
        point = np.where(point >= below, point + share, point)
        edge = choose(lat, node, point)
        missed = edge == out[once]  # by rounding, next to the edge that is gone
        edge = np.where(missed, np.where(edge < last, edge + 1, edge - 1), edge)
        turn[once], rest[once] = edge, np.where(last - first > 1, np.maximum(1 - share - lat.share[edge], 0.0), 0.0)
        for d, e in zip(once.tolist(), out[once].tolist(), strict=True):
            without[d] = (e,)
        for d in go[again[go]].tolist():
            gone = (int(out[d]), *self.samples[which[d]].without[d])
            at = int(np.searchsorted(lat.first, gone[0], "right")) - 1
            edges = [e for e in range(int(lat.first[at]), int(lat.first[at + 1])) if e not in gone]
            shares = lat.share[edges]
            cum = np.cumsum(shares)
            pick = min(int(np.searchsorted(cum, u[d] * cum[-1], "right")), len(edges) - 1)
            turn[d], without[d], rest[d] = edges[pick], gone, float(cum[-1] - shares[pick]) if len(edges) > 1 else 0.0
        # Fresh walks: the rest of the branch's word, and all later words.
        count = self.first_occ[go + 1] - branch_occ[go] - 1
        later = spans(branch_occ[go] + 1, count)
        inside = go[lat.target[turn[go]] != END]
        start_occ = np.concatenate([branch_occ[inside], later])
        start_node = np.concatenate([lat.target[turn[inside]], lat.starts[self.word[later]]])
        key = self._key(number, 1)[np.concatenate([inside, np.repeat(go, count)])] + self.at[start_occ] * np.uint64(4)
        occ, level, edge = _walk(lat, start_occ, start_node, key)
        per = np.concatenate([[0], np.cumsum(np.bincount(occ, minlength=len(self.word)))])
        length = np.zeros(n, np.int64)
        length[go] = keep[go] + 1
        fresh = np.diff(per[self.first_occ])
        begin = np.concatenate([[0], np.cumsum(length + fresh)])
        steps, occs = np.empty(int(begin[-1]), np.int64), np.empty(int(begin[-1]), np.int64)
        for k, s in enumerate(self.samples):  # what each parent's path has before the branch
            mine = go[which[go] == k]
            source, to = spans(s.begin[mine], keep[mine]), spans(begin[mine], keep[mine])
            steps[to], occs[to] = s.edge[source], self.occ[k][source]
            run = np.concatenate([[0.0], np.cumsum(lat.log_share[s.edge[source]])])
            ends = np.cumsum(keep[mine])
            before[mine] = run[ends] - run[ends - keep[mine]]
        at_branch = begin[go] + keep[go]
        steps[at_branch], occs[at_branch] = turn[go], branch_occ[go]
        shift = begin[:-1] + length - per[self.first_occ[:-1]]
        to = (per[:-1] + shift[self.doc])[occ] + level
        steps[to], occs[to] = edge, occ
        branch = np.full(n, -1)
        branch[go] = at_branch
        left = go[rest[go] > 1e-12]
        draw = uniform(self._key(number, 3))[left]
        self._open(left, truncated(before[left] + np.log(rest[left]), value[left], draw), branch[left])
        self._finish(steps, begin, length, value, branch, without, most)
        self.occ.append(occs)
        return True

    def run(self, k: int) -> np.ndarray:
        """Draws up to k samples a text; returns the thresholds."""
        self.first(k)
        while len(self.samples) < k and self.next(k):
            pass
        return self.best()[0]

    def ids(self, sample: int) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all texts in one array, and where each text begins."""
        s = self.samples[sample]
        piece = self.lat.piece[s.edge]
        back = np.flatnonzero(piece < 0)
        if not len(back):
            return piece, s.begin
        codes = -1 - piece[back]
        width = np.where(codes < 0x80, 1, np.where(codes < 0x800, 2, np.where(codes < 0x10000, 3, 4)))
        sizes = np.ones(len(piece), np.int64)
        sizes[back] = width
        ends = np.cumsum(sizes)
        out = np.repeat(piece, sizes)
        at = ends[back] - width
        for j in range(4):  # byte j of the characters' UTF-8 forms
            k = np.flatnonzero(width > j)
            high = codes[k] >> 6 * (width[k] - 1 - j)
            out[at[k] + j] = self.v.byte_ids[LEAD[width[k]] | high if j == 0 else 0x80 | high & 0x3F]
        return out, np.concatenate([[0], ends])[s.begin]


def decode(ids: np.ndarray, v: Vocabulary) -> bytes:
    """The text of piece ids with its dummy space."""
    first = v.spelled[ids]
    return v.spelling[spread(first, v.spelled[ids + 1] - first)].tobytes()


def row_keys(values: list, seed: int) -> np.ndarray:
    return np.array([zlib.crc32(b"%d:%s" % (seed, b"" if x is None else str(x).encode())) | zlib.crc32(b"%s/%d" % (b"" if x is None else str(x).encode(), seed)) << 32 for x in values], np.uint64)


def sampled_batch(ids: list, texts: list[str], lexicon: Lexicon, k: int, seed: int, part: int = 1 << 17) -> Iterator[tuple[Sampler, np.ndarray, int]]:
    """Samplers over runs of texts of about `part` characters, with their thresholds and first text."""
    sizes = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
    codes = _codes("".join([" " + t for t in texts if t]))
    first = np.concatenate([[0], np.cumsum(sizes)])
    starts = words_of(codes, first)
    counts = np.diff(np.searchsorted(starts, first))
    word = lexicon.numbered(codes, starts)
    lattice = lexicon.lattice()
    keys = row_keys(ids, seed)
    i = at = 0
    while i < len(texts):
        j, held = i, 0
        while j < len(texts) and (j == i or held + len(texts[j]) <= part):
            held += len(texts[j])
            j += 1
        words = int(counts[i:j].sum())
        s = Sampler(texts[i:j], keys[i:j], lexicon.v, lattice, word[at : at + words], counts[i:j])
        yield s, s.run(k), i
        i, at = j, at + words


RESULT = "id long, sample int, n_pieces int, log_prob double, perturbed double, log_inclusion double, ids_crc32 long, round_trip boolean"


def segmentations(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", k: int = 4, alpha: float = 0.5, seed: int = 11, with_ids: bool | str = False, batch_chars: int = 1 << 19, lexicon_chars: int = 1 << 20) -> DataFrame:
    """Up to k rows a document: the id, sample (0: the largest perturbed value), n_pieces, log_prob, perturbed,
    log_inclusion, ids_crc32 (of the ids as 32-bit little-endian numbers), round_trip, and ids if asked for: as an array, or
    with "packed" as those numbers in one binary value, which is far cheaper to write and read.

    model_file is a path that every executor can open, or the name of a file given to SparkContext.addFile.
    """
    names = [x.split()[0] for x in RESULT.split(", ")] + ["ids"] * bool(with_ids)

    def rows(ids: list, texts: list[str], lexicon: Lexicon) -> Iterator[pa.RecordBatch]:
        for s, threshold, base in sampled_batch(ids, texts, lexicon, k, seed):
            whole = [(" " + t).encode("utf-8", "surrogatepass") if t else b"" for t in s.texts]
            for number, sample in enumerate(s.samples):
                flat, begin = s.ids(number)
                have = np.flatnonzero(sample.value > -np.inf)
                back = decode(flat, lexicon.v)
                narrow = flat.astype("<i4")
                same = np.zeros(len(whole), bool)
                if back == b"".join([whole[d] for d in have.tolist()]):
                    same[have] = True
                else:
                    same[have] = [decode(flat[begin[d] : begin[d + 1]], lexicon.v) == whole[d] for d in have.tolist()]
                with np.errstate(over="ignore", divide="ignore"):
                    log_in = np.where(np.isinf(threshold), 0.0, np.log(-np.expm1(-np.exp(np.minimum(sample.total - threshold, 700)))))
                columns = [
                    pa.array([ids[base + d] for d in have.tolist()], pa.int64()),
                    pa.array(np.full(len(have), number, np.int32)),
                    pa.array(np.diff(begin)[have].astype(np.int32)),
                    pa.array(sample.total[have]),
                    pa.array(sample.value[have]),
                    pa.array(log_in[have]),
                    pa.array([zlib.crc32(narrow[begin[d] : begin[d + 1]].tobytes()) for d in have.tolist()], pa.int64()),
                    pa.array(same[have]),
                ]
                if with_ids == "packed":
                    bounds = pa.py_buffer((begin * 4).astype(np.int32))
                    columns.append(pa.Array.from_buffers(pa.binary(), len(begin) - 1, [None, bounds, pa.py_buffer(narrow)]))
                    if len(have) < len(begin) - 1:
                        columns[-1] = columns[-1].take(pa.array(have))
                elif with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(narrow, pa.int32())).take(pa.array(have)))
                yield pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = load(model_file if "/" in model_file else SparkFiles.get(model_file))
        lexicon = Lexicon(v, alpha)
        for b in batches:
            ids, texts, held = [], [], 0
            for x, t in zip(b.column(0), b.column(1), strict=True):
                text = t.as_py() or ""
                if ids and held + len(text) > batch_chars:
                    yield from rows(ids, texts, lexicon)
                    ids, texts, held = [], [], 0
                    if lexicon.chars > lexicon_chars:
                        lexicon.empty()
                ids.append(x.as_py())
                texts.append(text)
                held += len(text)
            if ids:
                yield from rows(ids, texts, lexicon)
        release()

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, RESULT + ("" if not with_ids else ", ids binary" if with_ids == "packed" else ", ids array<int>")).withColumnRenamed("id", id_col)
